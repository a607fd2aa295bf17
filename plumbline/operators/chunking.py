"""Documents to chunks: one table function for any chunker, joined laterally (a row in, its chunks out)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from plumbline.functions import text
from plumbline.operators.retrieval import SPACE, embedding_udf, hash_embed

# Preferred cut points, best first.
SEPARATORS = ("\n\n", "\n", ". ", " ")
SIZE, OVERLAP = 800, 100


def spans(value: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Half-open spans of at most ``size`` characters that together cover the whole text."""
    if not 0 <= overlap < size:
        raise ValueError("require 0 <= overlap < size")
    length, begin = len(value), 0
    earliest = max(overlap + 1, size // 2)
    while begin < length:
        stop = begin + size
        if stop >= length:
            yield begin, length
            return
        found = ((value.rfind(s, begin + earliest, stop), len(s)) for s in SEPARATORS)
        stop = next((at + width for at, width in found if at >= 0), stop)
        yield begin, stop
        begin = max(begin + 1, stop - overlap)


def pieces(value: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    return [value[a:b] for a, b in spans(value, size, overlap) if value[a:b].strip()]


Chunker = Callable[[str], Iterable[tuple[int, str]]]


def chunk_table(chunker: Chunker):
    """A table function ``(text, detail)`` over any chunker, for LATERAL joins in SQL or the DataFrame API.

    ``chunker`` turns a text into (begin, piece) pairs. The function is polymorphic: with
    the constant ``detail`` 'text' it returns ``chunk_index, content``, with 'spans' also
    ``begin_at``. A null text has no chunks.
    """

    class Chunks:
        @staticmethod
        def analyze(value: AnalyzeArgument, detail: AnalyzeArgument) -> AnalyzeResult:
            if detail.value not in ("text", "spans"):
                raise ValueError("detail must be the constant 'text' or 'spans'")
            schema = StructType().add("chunk_index", IntegerType()).add("content", StringType())
            return AnalyzeResult(schema=schema.add("begin_at", IntegerType()) if detail.value == "spans" else schema)

        def eval(self, value: str, detail: str):
            for i, (begin, piece) in enumerate(chunker(value) if value is not None else ()):
                yield (i, piece, begin) if detail == "spans" else (i, piece)

    return udtf(Chunks)


def chunks(docs: DataFrame, content: str, chunker: Chunker, detail: str = "text") -> DataFrame:
    """The rows of ``docs`` with their chunks beside them; ``content`` becomes the chunk's text."""
    whole = docs.withColumnRenamed(content, "__text")
    return whole.lateralJoin(chunk_table(chunker)(F.col("__text").outer(), F.lit(detail))).drop("__text")


def recursive(size: int = SIZE, overlap: int = OVERLAP) -> Chunker:
    return lambda value: [(a, value[a:b]) for a, b in spans(value, size, overlap) if value[a:b].strip()]


def recursive_chunks(docs: DataFrame, key: str, content: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    made = chunks(docs.select(key, content), content, recursive(size, overlap))
    return made.select(key, "chunk_index", F.lit(None).cast("string").alias("clause"), F.lit("").alias("heading"), "content")


def sections(docs: DataFrame, key: str, content: str) -> DataFrame:
    """Documents cut at numbered headings; text before the first heading is section 0.

    Lines are exploded, headings flagged, and a running sum names the section. A group
    here is one document's lines, and a document already fits one row.
    """
    lines = docs.select(key, F.posexplode(F.split(content, "\r?\n")).alias("line_no", "line"))
    clean = F.trim("line")
    is_heading = clean.rlike(text.HEADING)
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = (
        lines.withColumn("number", F.when(is_heading, F.regexp_extract(clean, text.HEADING, 1)))
        .withColumn("title", F.when(is_heading, F.regexp_extract(clean, text.HEADING, 2)))
        .withColumn("section", F.sum(is_heading.cast("int")).over(upto))
    )
    body = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("number").isNull(), F.struct("line_no", "line")))), lambda s: s["line"]
    )
    return marked.groupBy(key, "section").agg(
        F.max("number").alias("clause"), F.max("title").alias("heading"), F.array_join(body, "\n").alias("body")
    )


def clause_chunks(docs: DataFrame, key: str, content: str, size: int = SIZE) -> DataFrame:
    """Section-wise chunks; a split section repeats its heading line on every piece."""
    parts = sections(docs, key, content)
    head = F.concat("clause", F.lit(" "), "heading", F.lit("\n"))
    parts = parts.select(key, "section", "clause", "heading", F.coalesce(head, F.lit("")).alias("prefix"), F.concat(F.coalesce(head, F.lit("")), "body").alias("content"))

    cut = chunks(parts, "content", recursive(size)).withColumnRenamed("chunk_index", "piece")
    titled = F.length("prefix") > 0
    body = F.when(~titled | F.startswith("content", "prefix"), F.col("content")).otherwise(F.concat("prefix", "content"))
    return cut.select(
        key, F.col("section").cast("int").alias("section"), "piece", F.when(titled, F.col("clause")).alias("clause"),
        F.when(titled, F.col("heading")).otherwise("").alias("heading"), body.alias("content"),
    )


_SENTENCE = re.compile(text.SENTENCE_END)


def semantic(threshold: float = 0.5, size: int = SIZE, embed=hash_embed) -> Chunker:
    def cut(value: str) -> list[tuple[int, str]]:
        found = [s for s in _SENTENCE.split(value) if s.strip()]
        if not found:
            return []
        vecs = embed(pd.Series(found))
        groups = [[found[0]]]
        for left, right, sentence in zip(vecs[:-1], vecs[1:], found[1:], strict=True):
            if float(left @ right) < threshold:
                groups.append([])
            groups[-1].append(sentence)
        # Sentences are put together anew, so a piece has no one place in the text.
        return [(-1, p) for g in groups for p in pieces(" ".join(g), size)]

    return cut


def semantic_chunks(docs: DataFrame, key: str, content: str, threshold: float = 0.5, size: int = SIZE, embed=hash_embed) -> DataFrame:
    """Break where neighbouring sentences are less alike than ``threshold``, then split long groups."""
    if not -1 <= threshold <= 1:
        raise ValueError("cosine threshold outside [-1,1]")

    made = chunks(docs.select(key, content), content, semantic(threshold, size, embed))
    return made.select(key, "chunk_index", F.lit(None).cast("string").alias("clause"), F.lit("").alias("heading"), "content")


def build_index(docs: DataFrame, key: str, content: str, structured: str, size: int = SIZE, embed=hash_embed) -> DataFrame:
    """Index rows: structured documents by clause, the rest recursively, each with its vector and byte count."""
    by_clause = clause_chunks(docs.where(structured), key, content, size)
    order = Window.partitionBy(key).orderBy("section", "piece")
    by_clause = by_clause.withColumn("chunk_index", F.row_number().over(order) - 1)
    flat = recursive_chunks(docs.where(~F.expr(structured)), key, content, size)
    columns = [key, "chunk_index", "clause", "heading", "content"]
    rows = by_clause.select(*columns).unionByName(flat.select(*columns)).where(F.size(text.tokens("content")) > 0)
    return (
        rows.withColumn("token_count", F.octet_length("content"))
        .withColumn("embed_model", F.lit(SPACE))
        .withColumn("embedding", embedding_udf(embed)("content"))
        .join(docs.drop(content), key)
    )
