"""Structural checks of structured answers and of drafted reports, one row of problems per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text


def _problems(*pairs: tuple[Column, str]) -> Column:
    found = F.array(*[F.when(cond, F.lit(message)) for cond, message in pairs])
    return F.filter(found, lambda m: m.isNotNull())


def cited_numbers(answer: str | Column) -> Column:
    """Distinct citation numbers in order of first appearance."""
    found = F.regexp_extract_all(text.as_col(answer), F.lit(text.CITATION), F.lit(1))
    return F.transform(F.array_distinct(found), lambda x: x.cast("int"))


def claim_problems(claims: DataFrame, n_sources) -> DataFrame:
    """One row per (answer, claim, problem)."""
    limit = n_sources if isinstance(n_sources, Column) else F.lit(n_sources)
    outside = F.exists("citations", lambda x: (x < 1) | (x > limit))
    found = _problems(
        (~F.col("text").rlike(r"\S"), "blank text"),
        (F.col("text").rlike(text.CITATION), "embedded citation marker"),
        (F.size(F.array_distinct("citations")) != F.size("citations"), "duplicate citations"),
        (outside, "citation outside supplied sources"),
    )
    return claims.select("answer_id", "claim_id", F.posexplode(found).alias("o", "message"))


def structural_problems(claims: DataFrame, n_sources) -> DataFrame:
    rows = claim_problems(claims, n_sources).withColumn(
        "line", F.concat(F.lit("claim "), "claim_id", F.lit(": "), "message")
    )
    listed = F.array_sort(F.collect_list(F.struct("claim_id", "o", "line")))
    return rows.groupBy("answer_id").agg(F.array_join(F.transform(listed, lambda s: s["line"]), "; ").alias("problems"))


def coverage_problems(claims: DataFrame, checks: DataFrame) -> DataFrame:
    """Claims and checker verdicts must match one to one; unsupported claims are problems too."""
    counts = checks.groupBy("answer_id", "claim_id").agg(
        F.count("*").alias("n"), F.min(F.col("supported").cast("int")).alias("supported")
    )
    both = claims.select("answer_id", "claim_id", F.lit(True).alias("claimed")).join(counts, ["answer_id", "claim_id"], "full_outer")
    broken = F.col("claimed").isNull() | F.col("n").isNull() | (F.col("n") > 1)
    return both.groupBy("answer_id").agg(
        F.max(broken).alias("coverage_broken"),
        F.array_sort(F.collect_list(F.when(F.col("supported") == 0, F.col("claim_id")))).alias("unsupported"),
    )


def answer_shape(answers: DataFrame, claims: DataFrame, max_words: int = 250) -> DataFrame:
    """A refusal has no claims, an answer has some, and the claims stay within the word limit."""
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    sums = claims.groupBy("answer_id").agg(F.count("*").alias("n_claims"), F.sum(words).alias("words"))
    n = F.coalesce("n_claims", F.lit(0))
    return answers.join(sums, "answer_id", "left").select(
        "answer_id",
        _problems(
            (F.col("refused") == (n > 0), "refusal has no claims; an answer must have claims"),
            (F.coalesce("words", F.lit(0)) > max_words, f"answer exceeds {max_words} words"),
        ).alias("problems"),
    )


def draft_reference_failures(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per draft section: references absent from its evidence, duplicate causes, incoherent links.

    ``links``: draft_id, section, cause, status, answer, refs, gap. ``evidence``: draft_id, source_id.
    """
    status, refs = F.col("status"), F.size("refs")
    incoherent = F.when(
        status == "unknown", (F.col("answer") != "UNKNOWN") | (refs > 0) | F.coalesce(F.trim("gap") == "", F.lit(True))
    ).otherwise(refs == 0)
    cited = links.select("draft_id", "section", F.explode("refs").alias("source_id")).distinct()
    absent = cited.join(evidence, ["draft_id", "source_id"], "left_anti").groupBy("draft_id", "section").agg(F.count("*").alias("absent_refs"))
    shape = links.groupBy("draft_id", "section").agg(
        F.sum(incoherent.cast("int")).alias("incoherent_links"),
        (F.count("cause") - F.count_distinct(F.lower(F.trim("cause")))).alias("duplicate_causes"),
        F.array_sort(F.collect_set("gap")).alias("gaps"),
    )
    return shape.join(absent, ["draft_id", "section"], "left").na.fill(0, ["absent_refs"])
