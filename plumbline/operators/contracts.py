"""Contracts on tables: columns, row validation, constraint reports, fingerprints, check tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import ContractError

# Identifier patterns of the intake boundary.
NCR_ID = r"\ANCR-[0-9]{4}-[0-9]{4,6}\z"
SUPPLIER_ID = r"\AS-[0-9]{4}\z"
INTAKE_NCR_ID = r"\ANCR-[0-9]{4}-[0-9]{4,}\z"
EVENT_ID = r"\A[A-Za-z0-9_.:-]{1,128}\z"
MAX_PAYLOAD = 10_000


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Lower-case all names, refuse names that then collide, and name every missing column."""
    lowered = [c.lower() for c in df.columns]
    twice = sorted({c for c in lowered if lowered.count(c) > 1})
    if twice:
        raise ContractError(f"duplicate column names: {twice}")
    missing = sorted(set(required) - set(lowered))
    if missing:
        raise ContractError(f"missing required columns: {missing}")
    return df.toDF(*lowered)


def reasons(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row breaks, in the given order (an unknown outcome is a break)."""
    found = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return F.filter(found, lambda r: r.isNotNull())


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantined rows with their reasons)."""
    judged = df.withColumn("reasons", reasons(rules))
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def incident_rules() -> dict[str, Column]:
    return {
        "ncr_id": F.col("ncr_id").rlike(NCR_ID),
        "supplier_id": F.col("supplier_id").rlike(SUPPLIER_ID),
        "defect_description": F.length("defect_description") > 0,
        "quantity": F.col("quantity") > 0,
        "discovered_at": F.col("discovered_at").isNotNull(),
    }


def intake(raw: DataFrame) -> DataFrame:
    """Intake verdict per raw event (principal, body): status code, ids and the dedup key."""
    body = F.from_json("body", "ncr_id string, event_id string", {"mode": "PERMISSIVE"})
    parsed = raw.withColumn("b", body)
    ok = (
        (F.length("body") <= MAX_PAYLOAD)
        & F.col("b.ncr_id").rlike(INTAKE_NCR_ID)
        & F.col("b.event_id").rlike(EVENT_ID)
    )
    known = F.coalesce(F.length("principal") > 0, F.lit(False))
    status = F.when(~known, 401).when(F.coalesce(ok, F.lit(False)), 202).otherwise(400)
    return parsed.withColumn("status", status).select(
        *raw.columns,
        "status",
        F.when(F.col("status") == 202, F.col("b.ncr_id")).alias("ncr_id"),
        F.when(F.col("status") == 202, F.col("b.event_id")).alias("event_id"),
        F.when(F.col("status") == 202, F.sha2(F.concat_ws(":", "principal", "b.event_id"), 256)).alias("dedup_key"),
    )


def violations(df: DataFrame, row_id: str, constraints: Mapping[str, Column]) -> DataFrame:
    """One row per (row, broken CHECK). As in SQL, an unknown (NULL) outcome passes."""
    cells = [F.struct(F.lit(n).alias("rule"), F.coalesce(ok, F.lit(True)).alias("ok")) for n, ok in constraints.items()]
    return df.select(row_id, F.inline(F.array(*cells))).where(~F.col("ok")).select(row_id, "rule")


RESULT_FIELDS = ("category", "severity", "supplier_id", "confidence", "reasoning", "suggested_disposition")


def classification_constraints() -> dict[str, Column]:
    """CHECK constraints of the decision table."""
    none, every = F.lit(True), F.lit(True)
    for c in RESULT_FIELDS:
        none, every = none & F.col(c).isNull(), every & F.col(c).isNotNull()
    return {
        "complete_result": none | every,
        "category_enum": F.col("category").isin("cosmetic", "dimensional", "material", "functional"),
        "severity_range": F.col("severity").between(1, 5),
        "confidence_range": F.col("confidence").between(0, 1),
        "disposition_enum": F.col("suggested_disposition").isin("use-as-is", "rework", "scrap", "return-to-supplier"),
        "routed_enum": F.col("routed").isin("auto", "review"),
        "auto_has_result": (F.col("routed") != "auto")
        | (
            F.col("category").isNotNull()
            & (F.col("severity") <= 3)
            & (F.col("confidence") >= 0.9)
            & F.col("car_owner_email").isNotNull()
        ),
    }


def chunk_constraints() -> dict[str, Column]:
    kind = F.get_json_object("metadata", "$.visibility")
    return {
        "interval_order": F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")),
        "visibility": kind.isNotNull()
        & ((kind == "shared") | ((kind == "program") & F.get_json_object("metadata", "$.program").isNotNull())),
        "chunk_index": F.col("chunk_index") >= 0,
    }


#: Digests are sums of hashes modulo this prime, so rows can be added and taken away in any order.
FINGERPRINT_PRIME = (1 << 61) - 1
WHOLE = "*"


def _hashes(tagged: Column) -> list[Column]:
    """Two 60-bit numbers of a text."""
    digest = F.md5(tagged.cast("binary"))
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(2)]


def fingerprint(df: DataFrame) -> DataFrame:
    """``column_name, rows, present, digest_a, digest_b``: a multiset hash of every column and (``*``) of whole rows.

    Each is a sum over rows modulo a prime: it does not depend on order or partitioning, equal
    rows count as often as they occur, and :func:`combined` adds or takes away another
    frame's rows. Values are hashed as text; a null differs from an empty text.
    """
    cell = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(c).cast("string")))
    # Lengths in front of the cells keep their borders.
    row = F.concat_ws("|", *[F.concat(F.length(cell(c)).cast("string"), F.lit(":"), cell(c)) for c in df.columns])
    prime = F.lit(FINGERPRINT_PRIME).cast("decimal(38,0)")
    sums = lambda tagged: [(F.coalesce(F.sum(h), F.lit(0)) % prime).cast("bigint") for h in _hashes(tagged)]
    tagged = {c: (F.concat(F.lit(f"{c}="), cell(c)), F.count(c)) for c in df.columns} | {WHOLE: (row, F.count(F.lit(1)))}
    lines = []
    for name, (text, present) in tagged.items():
        one, two = sums(text)
        lines.append(F.struct(F.lit(name).alias("column_name"), F.count(F.lit(1)).alias("rows"), present.alias("present"), one.alias("digest_a"), two.alias("digest_b")))
    return df.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


def combined(manifest: DataFrame, other: DataFrame, sign: int = 1) -> DataFrame:
    """The manifest of both frames' rows together, or (``sign`` -1) without the other's rows."""
    signed = lambda df, k: df.select("column_name", *[(F.col(c) * k).cast("decimal(38,0)").alias(c) for c in ("rows", "present", "digest_a", "digest_b")])
    prime = F.lit(FINGERPRINT_PRIME).cast("decimal(38,0)")
    both = signed(manifest, 1).unionByName(signed(other, sign)).groupBy("column_name")
    return both.agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("rows", "present")], *[F.pmod(F.sum(c), prime).cast("bigint").alias(c) for c in ("digest_a", "digest_b")]
    )


def fingerprint_differences(got: DataFrame, expected: DataFrame) -> DataFrame:
    """``column_name, problem`` of every line that differs: missing, unexpected, rows, present or content."""
    a, b = got.alias("a"), expected.alias("b")
    same = lambda c: F.col(f"a.{c}") == F.col(f"b.{c}")
    problem = (
        F.when(F.col("a.column_name").isNull(), "missing").when(F.col("b.column_name").isNull(), "unexpected").when(~same("rows"), "rows")
        .when(~same("present"), "present").when(~(same("digest_a") & same("digest_b")), "content")
    )
    lines = a.join(b, F.col("a.column_name") == F.col("b.column_name"), "full_outer")
    return lines.select(F.coalesce("a.column_name", "b.column_name").alias("column_name"), problem.alias("problem")).where("problem IS NOT NULL")


def verify_fingerprint(df: DataFrame, expected: DataFrame, before: DataFrame | None = None) -> None:
    """Compare with a manifest, or raise. With ``before``, ``df`` holds the appended rows only and the older ones are not read."""
    got = fingerprint(df) if before is None else combined(before, fingerprint(df))
    wrong = fingerprint_differences(got, expected).collect()  # at most one line per column
    if wrong:
        raise ContractError("content differs from its manifest: " + ", ".join(sorted(f"{r['column_name']} ({r['problem']})" for r in wrong)))


def check(df_one_row: DataFrame, name: str, value: Column, expected, op: str = "==") -> DataFrame:
    """One line of a checks table from a one-row aggregate."""
    want = F.lit(expected).cast("double")
    got = value.cast("double")
    passed = {"==": got == want, ">=": got >= want, "<=": got <= want}[op]
    return df_one_row.select(
        F.lit(name).alias("check"), got.alias("value"), want.alias("expected"), F.coalesce(passed, F.lit(False)).alias("passed")
    )
