"""Identities in texts replaced by stable tokens, and put back, as joins.

A text is an array of pieces: runs of word characters, and every other character on its
own. An identity may stand only between such pieces, so finding it is an equality join:
runs of as many pieces as some identity has, in lower case, against the identity table.
Overlaps are settled by a fold over a text's hits (leftmost first, the longest at one
place), and the text is rebuilt from its pieces. The table may hold any number of
identities: it is never collected, and Spark broadcasts it only while it is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import ordered

PIECES = r"(?U)\w+|(?s:\W)"
#: Fixed value: the form of a token.
TOKEN = r"\[\[SUPPLIER_\d+\]\]"


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def _joined(parts: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(parts, start, length), "")


def identities(names: DataFrame, key: str, name: str, aliases: DataFrame | None = None, alias: str = "alias", code: str | None = None) -> DataFrame:
    """``key, name, token, alias, folded, size``: one row per key and way to write it; written.

    ``names`` has one row per key; ``aliases`` has ``key, alias``. Texts write a key as its ``code`` (the key
    itself if there is none). Tokens number the keys in the order of their codes, equal codes in that of keys;
    a code that several keys share is ambiguous.
    """
    known = names.select(F.col(key).alias("key"), F.col(name).alias("name"), F.col(code or key).alias("__code"))
    numbered = ordered.numbered(known, ["__code", "key"], "__n")
    digits = F.when(F.col("__n") < 10_000, F.lpad(F.col("__n").cast("string"), 4, "0")).otherwise(F.col("__n").cast("string"))
    known = numbered.select("key", "name", F.concat(F.lit("[[SUPPLIER_"), digits, F.lit("]]")).alias("token"), "__code")
    ways = known.select("key", "name", "token", F.explode(F.array("__code", "name")).alias("alias"))
    if aliases is not None:
        ways = ways.unionByName(known.drop("__code").join(aliases.select(F.col(key).alias("key"), F.col(alias).alias("alias")), "key"))
    folded = ways.withColumn("folded", F.lower("alias")).dropDuplicates(["key", "folded"])
    return session.written(folded.withColumn("size", F.size(pieces(F.col("folded")))), "identities")


def identity_violations(table: DataFrame) -> DataFrame:
    """``problem, alias``: blank identities, ones that look like tokens, and ones that name several keys."""
    shape = F.when(F.trim("alias") == "", "blank").when(F.contains(F.col("alias"), F.lit("[[SUPPLIER_")), "reserved")
    odd = table.select(shape.alias("problem"), "alias").where("problem IS NOT NULL")
    shared = table.groupBy("folded").agg(F.count_distinct("key").alias("__k")).where("__k > 1")
    return odd.unionByName(shared.select(F.lit("ambiguous").alias("problem"), F.col("folded").alias("alias"))).distinct()


def text_violations(texts: DataFrame, keys: Sequence[str], text: str, table: DataFrame | None = None) -> DataFrame:
    """``*keys, problem, token``: tokens in raw texts, or (with the identity table) tokens nobody has in texts to restore."""
    found = texts.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).alias("token"))
    if table is None:
        return found.select(*keys, F.lit("reserved").alias("problem"), "token").distinct()
    known = table.select("token").distinct()
    return found.join(known, "token", "left_anti").select(*keys, F.lit("unknown").alias("problem"), "token").distinct()


def hits(texts: DataFrame, keys: Sequence[str], text: str, table: DataFrame) -> DataFrame:
    """``*keys, hits``: per text with any, its hits ``(at, size, token, alias)``, leftmost-longest, in order."""
    # An ambiguous identity is no identity.
    usable = table.join(identity_violations(table).select(F.col("alias").alias("folded")), "folded", "left_anti").select("folded", "size", "token")
    sizes = sorted(r["size"] for r in usable.select("size").distinct().collect())  # as many as identities have lengths
    if not sizes:
        return texts.select(*keys, F.array().cast("array<struct<at:int,size:int,token:string,alias:string>>").alias("hits")).limit(0)
    parts = texts.select(*keys, pieces(F.lower(text)).alias("__p"))
    wordy = lambda c: c.rlike(r"(?U)^\w")
    grams = parts.select(*keys, "__p", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("size")).where(F.size("__p") >= F.col("size"))
    at = grams.select(*keys, "size", "__p", F.posexplode(F.sequence(F.lit(1), F.size("__p") - F.col("size") + 1)).alias("at", "__i"))
    before = F.when(F.col("__i") > 1, F.element_at("__p", F.col("__i") - 1)).otherwise(F.lit(""))
    after = F.coalesce(F.try_element_at("__p", F.col("__i") + F.col("size")), F.lit(""))
    spans = at.where(~wordy(before) & ~wordy(after)).select(*keys, "at", "size", _joined(F.col("__p"), F.col("__i"), F.col("size")).alias("folded"))
    found = spans.join(usable, ["folded", "size"]).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("at", (-F.col("size")).alias("down"), "token", F.col("folded").alias("alias")))).alias("__h")
    )
    kind = "array<struct<at:int,size:int,token:string,alias:string>>"
    first_free = lambda done: F.when(F.size(done) == 0, F.lit(0)).otherwise(F.element_at(done, -1)["at"] + F.element_at(done, -1)["size"])
    fold = F.aggregate(
        "__h", F.array().cast(kind),
        lambda done, h: F.when(h["at"] >= first_free(done), F.concat(done, F.array(F.struct(h["at"].alias("at"), (-h["down"]).alias("size"), h["token"].alias("token"), h["alias"].alias("alias"))).cast(kind))).otherwise(done),
    )
    return found.select(*keys, fold.alias("hits"))


def hide(texts: DataFrame, keys: Sequence[str], text: str, table: DataFrame, name: str = "hidden") -> DataFrame:
    """``texts`` with ``name``: identities of ``table`` replaced by tokens. ``keys`` name a row; a null text stays null."""
    found = texts.join(hits(texts, keys, text, table), list(keys), "left").withColumn("__p", pieces(F.col(text)))
    state = "struct<at:int,out:string>"
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(state)
    step = lambda acc, h: F.struct(
        (h["at"] + h["size"]).alias("at"),
        F.concat(acc["out"], _joined(F.col("__p"), acc["at"] + 1, h["at"] - acc["at"]), h["token"]).alias("out"),
    ).cast(state)
    rest = lambda acc: F.concat(acc["out"], _joined(F.col("__p"), acc["at"] + 1, F.size("__p") - acc["at"]))
    made = F.when(F.col("hits").isNull(), F.col(text)).otherwise(F.aggregate("hits", start, step, rest))
    return found.withColumn(name, made).drop("__p", "hits")


def show(texts: DataFrame, keys: Sequence[str], text: str, table: DataFrame, name: str = "shown") -> DataFrame:
    """``texts`` with ``name``: tokens replaced by the registered names; a token nobody has stays (see :func:`text_violations`)."""
    tokens = F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))
    asked = texts.select(*keys, F.posexplode(tokens).alias("__at", "token"))
    names = table.select("token", "name").distinct()
    told = asked.join(names, "token", "left").groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__at", F.coalesce("name", "token").alias("n")))), lambda s: s["n"]).alias("__names")
    )
    cut = texts.join(told, list(keys), "left").withColumn("__cut", F.split(text, TOKEN, -1))
    woven = F.array_join(F.flatten(F.zip_with("__cut", "__names", lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return cut.withColumn(name, F.when(F.col("__names").isNull(), F.col(text)).otherwise(woven)).drop("__cut", "__names")


def leaks(texts: DataFrame, keys: Sequence[str], text: str, table: DataFrame) -> DataFrame:
    """``*keys, leaks``: identities that still stand in a text (only texts with any)."""
    return hits(texts, keys, text, table).select(*keys, F.array_distinct(F.transform("hits", lambda h: h["alias"])).alias("leaks"))
