"""URL filter by redirect equivalence.

Pages that name one another as redirect target or canonical link are aliases. A rule list judges
urls by host and path prefix; a block of one alias reaches all of them over connected components,
and an explicit allow goes before any block that only arrives over an alias.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, stored

#: (verdict, host, path) of the contract's rule list.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Tags that name another url of the page: the tag, what makes it one, and where the url stands.
_LINKS = (
    (r"(?is)<link\b[^>]*>", r"(?is)\brel\s*=\s*[\"']?canonical\b", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"),
    (r"(?is)<meta\b[^>]*>", r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"),
)


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; ties go to allow."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]))
    out = None
    for verdict, h, p in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def node_of(url: Column) -> Column:
    """The identity of a url as a node: host, path and query; scheme and fragment do not tell pages apart."""
    return F.concat(host_of(url), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), F.lit("")))


def without_dots(path: Column) -> Column:
    """A path without its segments . and .., the latter with the segment before it."""
    last = F.element_at(F.split(path, "/"), -1)
    kept = F.aggregate(
        F.slice(F.split(path, "/"), 2, 1 << 30),
        F.array().cast("array<string>"),
        lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolved(url: Column, to: Column) -> Column:
    """The absolute url of a link on the page ``url``; null for other schemes and for places within the page."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(to, r"(?s)^[^?#]*(\?[^#]*)", 1)
    way = F.regexp_extract(to, r"(?s)^([^?#]*)", 1)
    full = F.when(way.startswith("/"), way).otherwise(F.concat(F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1)), way))
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("#") | to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (host == ""), F.lit(None))
        .when(to.startswith("?"), F.concat(F.lit("http://"), host, path, query))
        .otherwise(F.concat(F.lit("http://"), host, without_dots(full), query))
    )


def _named(tag: str, kind: str, where: str) -> Column:
    tags = F.filter(F.regexp_extract_all("html", F.lit(tag), 0), lambda x: x.rlike(kind))
    return F.transform(tags, lambda x: F.regexp_extract(x, where, 1))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b) nodes of each page and of every canonical or redirect target its html names, relative ones resolved."""
    base = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = [_named(tag, kind, where) for tag, kind, where in _LINKS]
    out = base.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.explode(F.array_distinct(F.concat(*found))).alias("to")).where("`to` <> ''")
    target = resolved(F.col("url"), F.replace("to", F.lit("&amp;"), F.lit("&")))
    return out.select(node_of(F.col("url")).alias("a"), node_of(target).alias("b")).where("a is not null and b is not null and a <> b and a <> '' and b <> ''")


def url_verdicts(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for each row of ``pages``.

    A page's own rule decides. A page without one takes its component's: allow if any alias is
    explicitly allowed, else block if any alias is blocked, else allow. ``redirects`` adds (a, b) url
    pairs. Null, empty or scheme-less urls have empty host and path, fit no rule and have no alias;
    repeated rows are judged each for itself; null html has no links; urls of any length are judged whole;
    of several rules as long as one another an allow wins; further columns are left out.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    base = base.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    edges = link_edges(pages)  # few beside the pages
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("a")), node_of(F.col("b"))))
    edges = stored(edges, "links")
    number = F.xxhash64  # components are of numbers
    hashed = components(edges.select(number(F.col("a")).alias("a"), number(F.col("b")).alias("b")))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("h", number(F.col("node")))
    members = nodes.join(hashed.select(F.col("node").alias("h"), F.col("component").alias("top")), "h", "left").select("node", F.coalesce("top", "h").alias("component"))
    bare = F.regexp_extract("node", r"(?s)^([^/?#]*)", 1)
    way = F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1)
    ruled = members.select("component", matching_rule(bare, way, rules)["verdict"].alias("v"))
    spread = ruled.groupBy("component").agg(F.max(F.col("v") == "allow").alias("any_allow"), F.max(F.col("v") == "block").alias("any_block"))
    # both sides tables: Spark splits a large component's partition
    judged = stored(members, "aliases").join(stored(spread, "spread"), "component").select("node", "component", F.when(F.col("any_allow"), "allow").when(F.col("any_block"), "block").otherwise("allow").alias("spread"))
    bare = base.where("node = ''").withColumns({"component": F.lit(None).cast("long"), "spread": F.lit(None).cast("string")})  # all the same key
    out = base.where("node <> ''").join(judged, "node", "left").unionByName(bare)
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("hit")["rule"].alias("rule"),
        F.coalesce(F.col("hit")["verdict"], F.col("spread"), F.lit("allow")).alias("verdict"),
        F.coalesce("component", F.when(F.col("node") != "", F.xxhash64("node"))).alias("component"),
    )
