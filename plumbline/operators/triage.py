"""Rule triage of incident texts, and the review workflow around it, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.windows import top_per_group

# Keyword patterns of the deterministic first pass.
SAFETY = r"(?iU)\b(crack|cracked|fracture|delamination|burn.?through|embrittlement|foreign object debris|FOD)\b"
MATERIAL = r"(?iU)\b(wrong alloy|wrong material|mill cert|heat treat|missing cert|certificate of conformance)\b"
COSMETIC = r"(?iU)\b(scratch|scuff|blemish|paint|handling mark)\b"
DIMENSIONAL = r"(?iU)\b(tolerance|out of tol|oversize|undersize|mm|inch|diameter|position|true position)\b"
MARKED = r"(?iU)\b(ITAR|CUI|export controlled)\b"
# Identifier patterns that may not appear in stored reasoning.
REASONING_PII = (
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b\d{13,16}\b",
    r"\b[\w.+-]+@[\w-]+\.[\w.]+\b",
    r"\b\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}\b",
)
PROBE_RATE = 0.05


def _some(*names: Column) -> Column:
    return F.filter(F.array(*names), lambda n: n.isNotNull())


def rule_fields(df: DataFrame, text: str, family_supplier: str | None = None) -> DataFrame:
    """Fields a rule decides (``rule_severity``, ``rule_category``, ``rule_supplier``) and the rules that fired."""
    t = F.col(text)
    safety, material = t.rlike(SAFETY), t.rlike(MATERIAL)
    cosmetic = t.rlike(COSMETIC) & ~material & ~safety
    supplier = F.col(family_supplier) if family_supplier else F.lit(None).cast("bigint")
    return (
        df.withColumn("rule_severity", F.when(safety, 5))
        .withColumn("rule_category", F.when(material, "material").when(cosmetic, "cosmetic"))
        .withColumn("rule_supplier", supplier)
        .withColumn(
            "rules_fired",
            _some(
                F.when(safety, "safety_keyword"),
                F.when(material, "mat_kw"),
                F.when(cosmetic, "cos_kw"),
                F.when(supplier.isNotNull(), "part_family"),
            ),
        )
    )


def decide(df: DataFrame, allow_auto: bool = True) -> DataFrame:
    """Merge rule fields over model fields and route.

    Needs the rule columns plus ``category, severity, supplier_id, confidence, reasoning,
    shortlist, owner``. A missing or rejected model result leaves every result field NULL
    and goes to review with the reason; nothing rejected is kept.
    """
    category, severity = F.coalesce("rule_category", "category"), F.coalesce("rule_severity", "severity")
    supplier = F.coalesce("rule_supplier", "supplier_id")
    reasoning_pii = F.lit(False)
    for p in REASONING_PII:
        reasoning_pii = reasoning_pii | F.col("reasoning").rlike("(?U)" + p)
    failure = (
        F.when(F.col("category").isNull() | F.col("severity").isNull() | F.col("confidence").isNull() | F.col("reasoning").isNull(), "ValidationError")
        .when(reasoning_pii | F.col("reasoning").rlike(MARKED), "SchemaError:reasoning")
        .when(~F.coalesce(F.array_contains("shortlist", supplier), F.lit(False)), "SchemaError:supplier_id")
    )
    conflict = (
        F.coalesce(F.col("rule_category") != F.col("category"), F.lit(False))
        | F.coalesce(F.col("rule_severity") != F.col("severity"), F.lit(False))
        | F.coalesce(F.col("rule_supplier") != F.col("supplier_id"), F.lit(False))
    )
    notes = _some(
        F.when(conflict, "rule_model_conflict"),
        F.when(severity >= 4, "high_severity"),
        F.when(F.col("confidence") < 0.90, "low_confidence"),
        F.when(F.col("owner").isNull(), "owner_lookup_missing"),
        F.lit(None if allow_auto else "shadow_mode").cast("string"),
    )
    judged = df.withColumn("failure", failure).withColumn("notes", F.when(F.col("failure").isNull(), notes))
    keep = lambda c: F.when(F.col("failure").isNull(), c)
    return judged.select(
        *[c for c in df.columns if c not in {"category", "severity", "supplier_id", "confidence", "reasoning", "owner"}],
        keep(category).alias("category"),
        keep(severity).alias("severity"),
        keep(supplier).alias("supplier_id"),
        keep(F.col("confidence")).alias("confidence"),
        keep(F.col("reasoning")).alias("reasoning"),
        keep(F.col("owner")).alias("car_owner_email"),
        F.when(F.size("rules_fired") > 0, "rules+model").otherwise("model").alias("stage"),
        F.when(F.col("failure").isNull() & (F.size("notes") == 0), "auto").otherwise("review").alias("routed"),
        F.coalesce("failure", F.nullif(F.array_join("notes", ","), F.lit(""))).alias("review_notes"),
    )


def smells(text: Column, category: Column, severity: Column, confidence: Column) -> Column:
    """Soft warnings: dimensional words under another category, severe and overconfident."""
    return _some(
        F.when(text.rlike(DIMENSIONAL) & (category != "dimensional"), "category_smell"),
        F.when((severity >= 4) & (confidence >= 0.99), "overconfident"),
    )


def hash_fraction(col: Column, seed: str) -> Column:
    """A uniform value in [0, 1) fixed by the row's id: the same on every run and partitioning."""
    digest = F.sha2(F.concat(col.cast("string"), F.lit(f":{seed}")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def review_tasks(decisions: DataFrame, probes: DataFrame, rate: float = PROBE_RATE, seed: str = "probe") -> DataFrame:
    """A live task per routed row, and probes so that probes / all tasks tends to ``rate``.

    Probes carry a dense ``probe_no`` from 0; a drawn row picks one by hash, an equality join.
    """
    routed = decisions.where("routed = 'review'")
    live = routed.select("decision_id", F.lit("live").alias("kind"), F.lit(None).cast("bigint").alias("probe_no"))
    size = probes.agg(F.count("*").alias("n_probes"))
    drawn = (
        routed.where(hash_fraction(F.col("decision_id"), seed) < rate / (1 - rate))
        .join(F.broadcast(size))
        .where("n_probes > 0")
        .withColumn("probe_no", F.floor(hash_fraction(F.col("decision_id"), seed + "-pick") * F.col("n_probes")).cast("bigint"))
    )
    probe = drawn.join(probes, "probe_no").select("decision_id", F.lit("probe").alias("kind"), "probe_no")
    return live.unionByName(probe)


def confidence_tier(scores: DataFrame, key: str, cutoffs: Sequence[tuple[str, float]]) -> DataFrame:
    """First tier (in order) whose confidence reaches its cutoff, else the last tier."""
    order = F.lit(None).cast("int")
    cutoff = F.lit(None).cast("double")
    for i, (tier, limit) in enumerate(cutoffs):
        order = F.when(F.col("tier") == tier, i).otherwise(order)
        cutoff = F.when(F.col("tier") == tier, float(limit)).otherwise(cutoff)
    ranked = scores.withColumn("o", order).withColumn("passes", F.col("confidence") >= cutoff).where("o IS NOT NULL")
    pick = F.struct("tier", "confidence")
    first = F.min_by(pick, F.when(F.col("passes"), F.col("o")))
    last = F.max_by(pick, F.col("o"))
    got = ranked.groupBy(key).agg(
        F.when(F.max(F.col("passes").cast("int")) == 1, first).otherwise(last).alias("s")
    )
    return got.select(key, F.col("s.tier").alias("tier"), F.col("s.confidence").alias("confidence"))


def notes_asof(notes: DataFrame, coverage: DataFrame, summaries: DataFrame, cutoff: Column, latest: int = 20) -> DataFrame:
    """Working notes recorded before the cutoff and not covered by a summary recorded before it."""
    known = summaries.where(F.col("recorded_at") < cutoff).select("summary_id")
    covered = coverage.join(known, "summary_id", "left_semi").select("note_id")
    working = notes.where(F.col("recorded_at") < cutoff).join(covered, "note_id", "left_anti")
    return top_per_group(working, ["scope"], [F.desc("recorded_at"), F.desc("note_id")], latest)


def latest_summaries(summaries: DataFrame, cutoff: Column, latest: int = 3) -> DataFrame:
    known = summaries.where(F.col("recorded_at") < cutoff)
    return top_per_group(known, ["scope"], [F.desc("recorded_at"), F.desc("summary_id")], latest)


def compaction_groups(notes: DataFrame, coverage: DataFrame, max_working: int = 20) -> DataFrame:
    """Scopes with more than ``max_working`` uncovered notes give their oldest half to one summary group."""
    open_notes = notes.join(coverage.select("note_id").distinct(), "note_id", "left_anti")
    sizes = open_notes.groupBy("scope").count().where(F.col("count") > max_working).select("scope")
    oldest = top_per_group(
        open_notes.join(sizes, "scope", "left_semi"), ["scope"], ["recorded_at", "note_id"], max_working // 2
    )
    return oldest.groupBy("scope").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "note_id"))), lambda s: s["note_id"]).alias("note_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_ids")))).alias("source_ids"),
    )


def golden_agreement(decisions: DataFrame, golden: DataFrame, floor: float = 0.92) -> DataFrame:
    """Category agreement against labels and missed severity-5 rows, with the verdict."""
    both = golden.join(decisions, "ncr_id", "left")
    got = both.agg(
        F.count("*").alias("n"),
        F.avg(F.coalesce(F.col("category") == F.col("golden_category"), F.lit(False)).cast("int")).alias("agreement"),
        F.sum(((F.col("golden_severity") == 5) & (F.coalesce("severity", F.lit(0)) != 5)).cast("int")).alias("missed_severe"),
    )
    return got.withColumn("passed", (F.col("agreement") >= floor) & (F.col("missed_severe") == 0))
