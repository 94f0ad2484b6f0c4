"""Verdicts on urls by rules on hosts and paths, carried over to aliases, in SQL functions only.

A rule names a host and the start of a path and fits that host and its subdomains; the
longest rule that fits a url decides. A url that no rule fits is judged by its aliases:
pages point to others by canonical links and by redirects (``meta`` refreshes, and a table
of redirects if there is one); urls that hang together by such edges are one resource.
If any url of the resource is explicitly allowed, the others without a rule are allowed;
else, if any is blocked, they are; without either they are allowed. A rule of a url's own
always stands.

Only edges move: digests of the urls at their ends, whose components are found by
labels that spread and jump (see ``ngram_join.connected``). The urls that go to ``block`` by
an alias are broadcast up to ``BROADCAST_BYTES``, beyond that joined.

Urls are compared with scheme and host in lower case, without fragment, an empty path as
``/``. Defined results: of a null url, or one without ``://``, host and path are empty, it
fits no rule, has no alias and is allowed; a relative link is resolved against the page's
url, its dots not; links within comments don't count; equal urls are one, whatever rows they stand
in; a null page id is a row like others; an empty table gives an empty table; an id column
called like a column of the result gets an underscore behind its name; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ._store import id_name, size_of, staged
from .ngram_join import connected

Rule = tuple[str, str, str]
#: (verdict, host, start of the path)
RULES: tuple[Rule, ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Lists of aliases or rules are broadcast up to this size.
BROADCAST_BYTES = 64 << 20
#: Up to so many rules are compared one after the other; of more the ones that may fit are found by host.
FEW = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1)


def plain(url: Column) -> Column:
    """A url as it is compared; null for none."""
    cut = F.regexp_extract(rest(url), r"^[^/?#]*[^#]*", 0)
    after = F.regexp_extract(cut, r"(?s)^[^/?#]*(.*)", 1)
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host(url), F.when(after.startswith("/"), after).otherwise(F.concat(F.lit("/"), after))))


def resolved(target: Column, url: Column) -> Column:
    """A link's target seen from a page; null for an empty one, or on a page without a url."""
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path(url), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when((target == "") | ~url.contains("://"), F.lit(None))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path(url), target))
        .when(target.startswith("#"), F.lit(None))
        .otherwise(F.concat(site, folder, target))
    )


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not; empty without one."""
    value = F.regexp_extract(tag, rf"""(?i)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.replace(F.regexp_replace(value, r"""^["']|["']$""", ""), F.lit("&amp;"), F.lit("&"))


def targets(html: Column) -> Column:
    """The targets of a page's canonical links and refreshes, as they are written."""
    html = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"(?i)<{name}[\s/][^>]*>"), F.lit(0))
    links = F.filter(tags("link"), lambda t: F.array_contains(F.split(F.lower(F.trim(_attribute(t, "rel"))), r"\s+"), "canonical"))
    turns = F.filter(tags("meta"), lambda t: F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh")
    return F.concat(
        F.transform(links, lambda t: F.trim(_attribute(t, "href"))),
        F.transform(turns, lambda t: F.trim(F.regexp_replace(F.regexp_extract(_attribute(t, "content"), r"(?is)^[^;,]*[;,]\s*url\s*=\s*(.*)$", 1), r"""^["']|["']$""", ""))),
    )


def _ordered(rules: Sequence[Rule]) -> list[Rule]:
    """The longest first; of equal ones the first by name, allow before block."""
    if any(v not in ("allow", "block") for v, _, _ in rules):
        raise ValueError("a rule's verdict is allow or block")
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))


def ruled(urls: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``urls`` (host, path, ...) with rule and decision: those of the longest rule that fits, else null."""
    rules = _ordered(rules)
    if len(rules) <= FEW:
        fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        found = F.lit(None).cast("struct<rule:string,decision:string>")
        for v, h, p in reversed(rules):
            found = F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("decision"))).otherwise(found)
        return urls.withColumn("_found", found).withColumns({"rule": F.col("_found.rule"), "decision": F.col("_found.decision")}).drop("_found")
    listed = urls.sparkSession.createDataFrame([(k, h, p, h + p, v) for k, (v, h, p) in enumerate(rules)], "place long, suffix string, start string, rule string, decision string")
    listed = F.broadcast(listed) if sum(len(h + p) for _, h, p in rules) * 4 <= BROADCAST_BYTES else listed
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    some = urls.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes)).join(listed, "suffix").where(F.col("path").startswith(F.col("start")))
    best = some.groupBy("host", "path").agg(F.min(F.struct("place", "rule", "decision")).alias("best"))
    return urls.join(best, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "decision": F.col("best.decision")}).drop("best")


def _node(url: Column) -> Column:
    return F.unhex(F.sha2(plain(url), 256))


def aliases(pages: DataFrame, url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Links (url, to): what pages, and the rows (source, target) of ``redirects``, point to, themselves perhaps."""
    edges = pages.select(F.col(url_col).alias("url"), F.explode(targets(F.col(html_col))).alias("to")).select("url", resolved(F.col("to"), F.col("url")).alias("to"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("source").alias("url"), resolved(F.trim("target"), F.col("source")).alias("to")))
    return edges.where("to is not null")


def blocked_by_alias(edges: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame | None:
    """The digests (node) of urls in resources of which one is blocked and none allowed; None without edges."""
    edges = staged(edges, "links").select("url", "to", _node(F.col("url")).alias("a"), _node(F.col("to")).alias("b"))
    edges = staged(edges.where("a != b"), "edges")
    if not edges.limit(1).count():
        return None
    label = connected(edges)
    ends = edges.select(F.col("url").alias("u"), F.col("a").alias("id")).union(edges.select("to", "b"))
    judged = ends.groupBy("id").agg(F.min(plain(F.col("u"))).alias("u"))
    judged = ruled(judged.select("id", host(F.col("u")).alias("host"), path(F.col("u")).alias("path")), rules)
    judged = judged.where("decision is not null").join(label, "id").groupBy("component")
    bad = judged.agg(F.bool_or(F.col("decision") == "allow").alias("allowed")).where("not allowed").select("component")
    return staged(label.join(bad, "component", "left_semi").select(F.col("id").alias("node")), "blocked")


def verdicts(
    pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict."""
    blocked = blocked_by_alias(aliases(pages, url_col, html_col, redirects), rules)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    text = F.coalesce("url", F.lit(""))
    rows = ruled(rows.select("id", host(text).alias("host"), path(text).alias("path"), "url"), rules)
    if blocked is not None:
        some = F.broadcast(blocked) if size_of(blocked) <= BROADCAST_BYTES else blocked
        rows = rows.withColumn("node", F.when(F.col("rule").isNull(), _node(F.col("url"))))
        rows = rows.join(some.withColumn("alias", F.lit("block")), "node", "left").withColumn("decision", F.coalesce("decision", "alias"))
    results = ["host", "path", "rule", "verdict"]
    return rows.withColumn("verdict", F.coalesce("decision", F.lit("allow"))).select(F.col("id").alias(id_name(id_col, results)), *results)
