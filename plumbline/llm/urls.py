"""URL filters with redirect equivalence, as DataFrame work only.

Addresses that lead to the same page are one: edges are redirects and canonical links,
and connected components over them propagate a block from any member to all aliases.
Precedence: a rule that fits the address itself decides; else, if any alias is explicitly
allowed, the address is allowed; else it is blocked if any alias is blocked by a rule.

Edges come from three places: a table of observed redirects, where there is one; the
page's own ``<link rel="canonical">``, ``og:url`` and refresh targets; and the address's
canonical form (no scheme, ``www.`` or ``m.`` prefix, fragment, tracking parameter, index
file, ``.html`` ending or closing slash), to which sites redirect such variants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.components import components

#: (verdict, host, path), fixed values of the registered query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Query parameters that only track (fixed values).
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_[a-z]+|sessionid|sid"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path) that fits, as text, and its verdict; nulls if none fits.

    Of equally long rules, allow wins, then the first in order.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in order]
    rule = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, order, strict=True)], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, order, strict=True)], F.lit(None).cast("string"))
    return rule, verdict


def canonical(url: Column) -> Column:
    """The form to which the usual variants of an address redirect; null without ``://``."""
    host, path = host_path(url)
    host = F.regexp_replace(host, r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.[a-z]+$", "/"), r"(?:\.html?|/)$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(rf"^(?:{TRACKING})(?:=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, tail))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted or not; empty without one."""
    pattern = rf"""(?is)(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(F.concat(*[F.coalesce(F.regexp_extract(tag, pattern, i), F.lit("")) for i in (1, 2, 3)]))


def without_dots(path: Column) -> Column:
    """``path`` (with its leading slash) without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/", -1)
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)), none,
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    closed = F.concat(kept, F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(closed, "/"))).otherwise(path)


def resolved(target: Column, base: Column) -> Column:
    """The absolute address of ``target`` on a page at ``base``; empty if there is none."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1), F.lit("/"))
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    full = (
        F.when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target))
        .when((target == "") | target.startswith("#") | (site == ""), F.lit(""))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("?"), F.concat(site, path, target))
        .when(target.startswith("/"), F.concat(site, without_dots(own), rest))
        .otherwise(F.concat(site, without_dots(F.concat(folder, own)), rest))
    )
    return F.coalesce(full, F.lit(""))


def link_targets(html: Column, url: Column) -> Column:
    """Absolute addresses that the page at ``url`` names as its own: canonical link, ``og:url``, refresh.

    Relative and scheme-relative ones are resolved against the page's ``base``, or else its address.
    """
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    own = F.filter(tags, lambda t: t.rlike(r"""(?i)rel\s*=\s*["']?canonical|property\s*=\s*["']?og:url|http-equiv\s*=\s*["']?refresh"""))
    named = resolved(attribute(F.regexp_extract(html, r"(?i)<base\b[^>]*>", 0), "href"), url)
    base = F.when(named != "", named).otherwise(url)

    def target(t: Column) -> Column:
        refresh = F.regexp_extract(attribute(t, "content"), r"""(?is)url\s*=\s*["']?\s*([^"'\s;]+)""", 1)
        value = F.when(t.rlike(r"(?i)^<link"), attribute(t, "href")).when(t.rlike(r"""(?i)http-equiv\s*=\s*["']?refresh"""), refresh).otherwise(attribute(t, "content"))
        plain = F.regexp_extract(t, r"""(?i)([a-z][a-z0-9+.-]*://[^\s"'<>;]+)""", 1)
        return F.when(plain != "", plain).otherwise(resolved(value, base))

    return F.when(html.rlike(r"(?i)canonical|og:url|refresh"), F.filter(F.transform(own, target), lambda u: u != ""))


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html",
) -> DataFrame:
    """One row per input row: the id, ``host, path, rule, verdict, group_url, via``.

    ``redirects`` has columns ``from_url, to_url``. ``rule`` is null where none fits the
    address itself; ``via`` says what decided: ``rule``, ``alias`` (propagated), or
    ``default`` (allow). A null address, or one without ``://``, has an empty host and
    path, no aliases, and is allowed. A null page has no links. Repeated rows are judged
    alike, each for itself. An empty table gives no rows. Rules also apply to aliases that
    are only named by a redirect or a link and are no page themselves.
    """
    url = F.col(f"`{url_col}`")
    host, path = host_path(url)
    rule, verdict = ruled(host, path, rules)
    targets = link_targets(F.col(f"`{html_col}`"), url) if html_col else F.lit(None).cast("array<string>")
    rows = common.written(
        pages.select(
            F.col(f"`{id_col}`").alias("_id"), url.alias("_url"), canonical(url).alias("_canon"), host.alias("host"), path.alias("path"),
            rule.alias("rule"), verdict.alias("_own"), targets.alias("_links"),
        ),
        "url-rows",
    )
    # A node is a canonical form: an address and its plain variants are equal from the start.
    named = rows.where("_links IS NOT NULL").select(F.col("_url").alias("from_url"), F.explode("_links").alias("to_url"))
    if redirects is not None:
        named = named.unionByName(redirects.select("from_url", "to_url"))
    named = common.written(named, "url-edges")
    found = components(named.select(canonical(F.col("from_url")).alias("a"), canonical(F.col("to_url")).alias("b")), "a", "b")
    ends = named.select(F.col("from_url").alias("_url")).unionByName(named.select(F.col("to_url").alias("_url")))
    end_host, end_path = host_path(F.col("_url"))
    ended = ends.select(canonical(F.col("_url")).alias("_canon"), ruled(end_host, end_path, rules)[1].alias("_own"))
    # The variants' rules first meet per node (partial aggregates), then per component.
    nodes = (
        rows.select("_canon", "_own").unionByName(ended).where("_canon IS NOT NULL")
        .groupBy("_canon")
        .agg(F.max((F.col("_own") == "allow").cast("int")).alias("_allow"), F.max((F.col("_own") == "block").cast("int")).alias("_block"))
    )
    joined = nodes.join(found, nodes["_canon"] == found["node"], "left").withColumn("_group", F.coalesce("component", "_canon"))
    joined = common.written(joined.select("_canon", "_group", "_allow", "_block"), "url-nodes")
    groups = joined.groupBy("_group").agg(F.max("_allow").alias("_any_allow"), F.max("_block").alias("_any_block"))
    judged = joined.join(groups, "_group").select(
        "_canon", "_group", F.when(F.coalesce("_any_allow", F.lit(0)) == 1, "allow").when(F.coalesce("_any_block", F.lit(0)) == 1, "block").alias("_alias")
    )
    return rows.join(judged, "_canon", "left").select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_own", "_alias", F.lit("allow")).alias("verdict"), F.col("_group").alias("group_url"),
        F.when(F.col("_own").isNotNull(), "rule").when(F.col("_alias").isNotNull(), "alias").otherwise("default").alias("via"),
    )
