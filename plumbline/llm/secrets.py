"""Secret scans with multipart credential linking, as DataFrame work only.

Strong findings stand alone (``assign``, ``access``, ``hex``). Weak ones mean nothing by
themselves: a short access identifier, a short or quoted value behind a key word, an
address with a user or a port. They are parts of one credential, and a weak part is
reported only if complementary parts stand close to it: an identifier with a secret, a
secret with an identifier or an endpoint, an endpoint with an identifier and a secret.
Strong findings count as parts too.

Closeness is an interval join: every part is copied to the stretches (of ``scope`` code
points) that its own interval, widened by ``scope`` on both sides, touches; parts of one
document in the same stretch meet in an equality join and are then compared exactly. A
stretch has room for few parts, so a long document forms no square of pairs.

Match positions need no Python: the pieces between matches (``split``) and the matches
(``regexp_extract_all``) alternate, so starts are running sums of their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common

#: The base patterns, and the least length of the whole match or of a group.
KEYWORDS = "password|passwd|secret|token|api_?key"
ASSIGN = rf"""((?i:{KEYWORDS}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
STRONG = ("assign", "access", "hex")

#: Weak parts: kind, its role in a credential, its pattern.
WEAK = (
    ("weak_access", "id", r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{4,}(?![A-Z0-9])"),
    ("weak_user", "id", r"""(?i:\b(?:user(?:_?name)?|login|account|client_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""),
    ("weak_secret", "secret", rf"""(?i:{KEYWORDS}|pwd|passphrase)["']?\x20*[:=]\x20*(?:"[^"\n]{{4,}}"|'[^'\n]{{4,}}'|[A-Za-z0-9+/_.=!@#%^&*-]{{4,}})"""),
    ("weak_endpoint", "endpoint", r"(?i:\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3))://[A-Za-z0-9._@:-]{4,}"),
)
ROLES = {"assign": "secret", "hex": "secret", "access": "id"} | {kind: role for kind, role, _ in WEAK}
#: A text without one of these has no match of a weak or strong pattern with letters.
HINT = rf"(?i:{KEYWORDS}|pwd|passphrase|user|login|account|client)|://|AKIA|ASIA|AROA|AIDA"


def matches(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of ``(kind, start, end)`` in code points of the leftmost, non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep else found
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    both = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), value.alias("value"))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(F.coalesce(x["hit"], F.lit("")))
        one = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end")))
        good = x["hit"].isNotNull()
        if keep:
            good = good & (F.char_length(x["value"]) >= keep)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    scanned = F.aggregate(both, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)["spans"]
    return F.when(text.rlike(pattern), scanned).otherwise(empty)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column) -> Column:
    """By start, then kind: the strong ones as listed, then the weak ones."""
    order = F.create_map(*[x for i, k in enumerate([*STRONG, *[w[0] for w in WEAK]]) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def linked(parts: DataFrame, scope: int) -> DataFrame:
    """The weak parts that complementary parts stand near; ``parts``: ``_row, kind, start, end``."""
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    named = parts.withColumn("role", F.element_at(roles, F.col("kind")))
    reach = lambda d: F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("start") - d) / scope), F.floor((F.col("end") + d) / scope)))
    weak = named.where(F.col("kind").startswith("weak_")).withColumn("_cell", reach(scope))
    # Of one document, stretch, role and place one part is enough to vouch for others.
    near = named.withColumn("_cell", reach(0)).select(
        "_row", "_cell", F.col("role").alias("_role"), F.col("start").alias("_s"), F.col("end").alias("_e")
    ).distinct()
    met = weak.join(near, ["_row", "_cell"]).where(
        (F.col("role") != F.col("_role")) & (F.col("_s") <= F.col("end") + scope) & (F.col("_e") >= F.col("start") - scope)
        & ((F.col("_e") <= F.col("start")) | (F.col("_s") >= F.col("end")))
    )
    have = lambda role: F.max((F.col("_role") == role).cast("int")) == 1
    parts_of = met.groupBy("_row", "kind", "start", "end", "role").agg(
        have("id").alias("_id_near"), have("secret").alias("_secret_near"), have("endpoint").alias("_endpoint_near")
    )
    return parts_of.where(
        ((F.col("role") == "id") & F.col("_secret_near"))
        | ((F.col("role") == "secret") & (F.col("_id_near") | F.col("_endpoint_near")))
        | ((F.col("role") == "endpoint") & F.col("_id_near") & F.col("_secret_near"))
    ).select("_row", "kind", "start", "end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 256) -> DataFrame:
    """One row per input row: the id, ``strong`` and ``spans``: arrays of ``(start, rank, end, kind)``.

    ``strong`` holds the findings that stand alone; ``spans`` adds the weak ones that
    complementary parts confirm and that overlap no strong one. Positions are code points
    of the whole text, ends exclusive. A null text counts as empty and has no spans.
    Repeated rows are scanned each for itself. An empty table gives no rows. Other columns
    are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    hinted = text.rlike(HINT)
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    only = lambda spans: F.when(hinted, spans).otherwise(none)
    found = common.written(
        docs.select(
            F.col(f"`{id_col}`").alias("_id"),
            F.concat(only(matches(text, ASSIGN, "assign", keep=12)), only(matches(text, ACCESS, "access")), matches(text, HEX, "hex")).alias("_strong"),
            only(F.concat(*[matches(text, p, k) for k, _, p in WEAK])).alias("_weak"),
        ).withColumn("_row", F.monotonically_increasing_id()),
        "secret-parts",
    )
    # A weak part inside or across a strong one is no finding of its own.
    own = F.filter("_weak", lambda w: ~F.exists("_strong", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    parts = found.where(F.size("_weak") > 0).select("_row", F.explode(F.concat("_strong", own)).alias("_p")).select("_row", "_p.*")
    confirmed = linked(parts, scope).groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_more"))
    return found.join(confirmed, "_row", "left").select(
        F.col("_id").alias(id_col), in_order(F.col("_strong")).alias("strong"),
        in_order(F.concat("_strong", F.coalesce("_more", none))).alias("spans"),
    )
