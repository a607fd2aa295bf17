"""Canonical quality tables derived from the raw tables, as lazy DataFrames.

Every view is a narrow projection of one raw scan (no shuffle), so column pruning
and filters reach the Parquet reader. Row identities are built from the row's own
columns rather than by numbering rows: numbering would sort the whole fact table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import session
from plumbline.sources import tables

MONEY = "decimal(18,2)"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = session.configure(spark)
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return tables.scan(self.spark, self.sf_dir, name)

    def sql(self, text: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
        """Spark SQL over canonical views: every ``{view}`` in the text is bound to a frame."""
        names = {n for n in _VIEW_NAMES if "{" + n + "}" in text}
        bound = {n: getattr(self, n) for n in names if n not in frames}
        return self.spark.sql(text, args=args, **bound, **frames)

    # ---- suppliers and the event tables -------------------------------------------------
    @cached_property
    def suppliers(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("supplier_id"),
            F.col("s_name").alias("supplier_name"),
            F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("s_nationkey") % 3 + 1).alias("tier"),
            (F.col("s_acctbal") >= 0).alias("active"),
            F.add_months(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") % 24).cast("int")).alias("onboarded_at"),
        )

    @cached_property
    def li(self) -> DataFrame:
        raw = self.raw("lineitem")
        return raw.withColumn(
            "line_id",
            F.concat_ws(
                "-",
                "l_orderkey",
                "l_linenumber",
                "l_partkey",
                "l_suppkey",
                F.col("l_quantity").cast("int"),
                F.date_format("l_shipdate", "yyyyMMdd"),
            ),
        )

    @cached_property
    def ncrs(self) -> DataFrame:
        ship = F.col("l_shipdate").cast("date")
        price, disc = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
        return self.li.where("l_returnflag = 'R'").select(
            F.col("line_id").alias("ncr_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.element_at(
                F.array(*[F.lit(c) for c in ("dimensional", "cosmetic", "material", "functional")]),
                F.col("l_linenumber") % 4 + 1,
            ).alias("category"),
            (1 + F.col("l_quantity").cast("int") % 5).alias("severity"),
            F.col("l_partkey").alias("part_number"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.when(disc != 0, F.round(price * disc, 2)).cast(MONEY).alias("cost"),
            F.col("l_shipdate").alias("discovered_at"),
            F.when(F.col("l_linestatus") == "F", F.date_add(ship, (F.col("l_partkey") % 30 + 1).cast("int"))).alias(
                "closed_at"
            ),
        )

    @cached_property
    def inspections(self) -> DataFrame:
        return self.li.select(
            F.col("line_id").alias("inspection_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_partkey").alias("part_number"),
            F.col("l_shipdate").alias("inspected_at"),
            (F.col("l_returnflag") != "R").alias("passed"),
        )

    @cached_property
    def purchase_orders(self) -> DataFrame:
        ship = F.col("l_shipdate").cast("date")
        return self.li.select(
            F.col("line_id").alias("po_line_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_partkey").alias("part_number"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.when(
                F.col("l_partkey") % 97 != 0, F.date_add(ship, (F.col("l_partkey") % 11 - 5).cast("int"))
            ).alias("promised_date"),
        )

    @cached_property
    def goods_receipts(self) -> DataFrame:
        return self.li.select(
            F.concat(F.lit("G-"), "line_id").alias("goods_receipt_id"),
            F.col("line_id").alias("po_line_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_shipdate").alias("received_at"),
            F.col("l_quantity").cast("int").alias("quantity"),
        )

    @cached_property
    def order_supplier(self) -> DataFrame:
        """Orders with the supplier they are assigned to (a one-row count is joined on)."""
        n = self.raw("supplier").agg(F.count("*").alias("n_suppliers"))
        return self.raw("orders").join(F.broadcast(n)).withColumn("supplier_id", F.col("o_custkey") % F.col("n_suppliers"))

    @cached_property
    def audits(self) -> DataFrame:
        cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
        return self.order_supplier.select(
            F.col("o_orderkey").alias("audit_id"),
            "supplier_id",
            F.col("o_orderdate").cast("date").alias("audit_date"),
            ((4000 + cents % 6100) / 100).alias("audit_score"),
        )

    @cached_property
    def cars(self) -> DataFrame:
        opened = F.col("o_orderdate").cast("date")
        return self.order_supplier.where("o_orderstatus <> 'P'").select(
            F.col("o_orderkey").alias("car_id"),
            "supplier_id",
            F.col("o_orderpriority").alias("cause_code"),
            F.concat(F.lit("reviewer-"), F.col("o_orderkey") % 7).alias("reviewer"),
            opened.alias("opened_at"),
            F.when(F.col("o_orderstatus") == "F", F.date_add(opened, (F.col("o_custkey") % 200 + 1).cast("int"))).alias(
                "closed_at"
            ),
        )

    @cached_property
    def bill_of_materials(self) -> DataFrame:
        return self.raw("part").where("p_partkey > 0").select(
            F.col("p_partkey").alias("part_id"),
            F.floor(F.col("p_partkey") / 3).alias("parent_id"),
            F.col("p_size").alias("quantity"),
        )

    # ---- event streams ------------------------------------------------------------------
    @cached_property
    def audit_events(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id"),
            F.col("user_id").alias("trace_id"),
            "ts",
            F.col("event_type").alias("event"),
            F.col("value").cast("decimal(12,2)").alias("amount"),
            F.col("props").alias("record"),
        )

    @cached_property
    def daily(self) -> DataFrame:
        """Share of non-error events and volume per user and day."""
        return (
            self.raw("events")
            .groupBy(F.col("user_id").alias("entity_id"), F.col("ts").cast("date").alias("day"))
            .agg(
                F.count("*").alias("units"),
                F.sum((F.col("event_type") != "error").cast("int")).alias("ok"),
                F.sum(F.col("value").cast("decimal(12,2)")).alias("amount"),
            )
            .withColumn("rate", F.col("ok") / F.col("units"))
        )

    # ---- documents ------------------------------------------------------------------------
    @cached_property
    def chunks(self) -> DataFrame:
        """One chunk row per document, with scope metadata, parent and validity interval."""
        d = self.raw("documents")
        day0 = F.lit("2024-01-01").cast("date")
        start = F.date_add(day0, (F.col("doc_id") % 5 * 30).cast("int"))
        metadata = (
            F.when(F.col("doc_id") % 7 == 0, F.lit('{"visibility":"shared"}'))
            .when(F.col("doc_id") % 7 == 1, F.lit('{"owner":"unset"}'))
            .otherwise(
                F.concat(F.lit('{"visibility":"program","program":"P'), F.col("doc_id") % 3, F.lit('"}'))
            )
        )
        return d.select(
            F.col("doc_id").alias("id"),
            F.floor(F.col("doc_id") / 4).alias("document_id"),
            (F.col("doc_id") % 2).alias("document_revision"),
            F.element_at(
                F.array(*[F.lit(c) for c in ("manual", "car", "audit", "standard")]),
                (F.length("source") + F.col("doc_id")).cast("int") % 4 + 1,
            ).alias("source_type"),
            F.floor(F.col("doc_id") % 4 / 2).alias("chunk_index"),
            F.col("text").alias("content"),
            F.col("lang"),
            F.when(F.col("doc_id") % 11 == 0, "space-b").otherwise("space-a").alias("embed_model"),
            metadata.alias("metadata"),
            start.alias("valid_from"),
            F.when(F.col("doc_id") % 5 < 2, F.date_add(start, 45)).alias("valid_to"),
            F.when(F.col("doc_id") % 10 != 9, F.floor(F.col("doc_id") / 10) * 10).alias("parent_id"),
        )

    # ---- derived operational tables -------------------------------------------------------
    @cached_property
    def recurrence_events(self) -> DataFrame:
        causes = F.array(*[F.lit(c) for c in CAUSES])
        return self.ncrs.select(
            "ncr_id",
            "supplier_id",
            F.element_at(causes, (F.col("part_number") % 5 + 1).cast("int")).alias("cause_code"),
            F.col("discovered_at").cast("date").alias("discovered_at"),
            F.date_add(F.col("discovered_at").cast("date"), 30).alias("adjudicated_at"),
        )

    @cached_property
    def cycles(self) -> DataFrame:
        """Machine cycles: start, when the inspection result became known, and the result."""
        return self.raw("events").select(
            F.col("event_id").alias("serial"),
            F.col("user_id").alias("machine_id"),
            F.col("ts").alias("cycle_start"),
            (F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 5 + 2).cast("int"))).alias(
                "inspection_completed_at"
            ),
            (F.col("event_type") == "error").cast("int").alias("failed"),
            F.col("value").cast("decimal(12,2)").alias("value"),
        )

    @cached_property
    def gateway_events(self) -> DataFrame:
        """Lifecycle rows of request traces (four raw events make one trace)."""
        cents = F.round(F.col("value") * 100).cast("bigint")
        step, kind = F.col("event_id") % 4, F.col("event_type")
        event = (
            F.when(step == 0, "received")
            .when((step == 1) & (F.col("value") >= 100), "intent")
            .when(step == 1, "blocked")
            .when((step == 2) & (kind == "error"), "failed")
            .when((step == 2) & (kind != "view"), "completed")
        )
        codes = F.filter(
            F.array(
                F.when(cents % 3 == 0, "GW-PII"), F.when(cents % 5 == 0, "GW-MARK"), F.when(cents % 7 == 0, "GW-INJECT")
            ),
            lambda c: c.isNotNull(),
        )
        record = F.when(event.isin("blocked", "failed") & (cents % 11 != 0), F.to_json(F.struct(codes.alias("block_codes"))))
        return (
            self.raw("events")
            .select(
                F.floor(F.col("event_id") / 4).alias("trace_id"),
                "ts",
                event.alias("event"),
                F.coalesce(record, F.lit("{}")).alias("record"),
            )
            .where("event IS NOT NULL")
        )

    @cached_property
    def classifications(self) -> DataFrame:
        """Model decisions on incidents: some rejected (all result fields NULL), some breaking rules."""
        part, qty = F.col("part_number"), F.col("quantity")
        ok = part % 17 != 0
        confidence = (70 + (qty * 7 + part) % 31).cast("decimal(5,2)") / 100
        severity = F.when(part % 13 == 0, 5).otherwise(F.col("severity"))
        owner = F.when(part % 6 != 0, F.concat(F.lit("owner"), F.col("supplier_id") % 9, F.lit("@example.com")))
        auto = (part % 19 == 0) | ((severity <= 3) & (confidence >= 0.9) & owner.isNotNull() & ok)
        pick = lambda values, n: F.element_at(F.array(*[F.lit(x) for x in values]), (n % len(values) + 1).cast("int"))
        return self.ncrs.select(
            F.concat(F.lit("D-"), "ncr_id").alias("decision_id"),
            "ncr_id",
            pick(["fast", "standard", "frontier"], part).alias("model"),
            F.when(ok, F.when(part % 10 == 0, "cosmetic").when(part % 101 == 0, "other").otherwise(F.col("category"))).alias(
                "category"
            ),
            F.when(ok, severity).alias("severity"),
            F.when(ok, F.col("supplier_id")).alias("supplier_id"),
            F.when(ok, pick(["use-as-is", "rework", "scrap", "return-to-supplier"], qty)).alias("suggested_disposition"),
            owner.alias("car_owner_email"),
            F.when(ok, confidence.cast("double")).alias("confidence"),
            F.when(ok & (part % 103 != 0), F.concat(F.lit("seen on part "), part)).alias("reasoning"),
            F.date_add(F.col("discovered_at").cast("date"), 1).alias("classified_at"),
            F.when(auto, "auto").otherwise("review").alias("routed"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        done = self.ncrs.where("part_number % 3 = 0")
        return done.select(
            F.concat(F.lit("R-"), "ncr_id").alias("review_id"),
            F.concat(F.lit("D-"), "ncr_id").alias("decision_id"),
            F.date_add(F.col("discovered_at").cast("date"), 3).alias("reviewed_at"),
        )


# The order-priority labels double as cause codes.
CAUSES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

_VIEW_NAMES = [k for k, v in vars(Views).items() if isinstance(v, cached_property)]
