"""URL filters with redirect equivalence (operator 3).

An explicit rule decides where one fits. Elsewhere the decision is that of the
page's aliases: connected components over redirects and canonical links carry
block decisions to all addresses of a page, and one explicit allow among them
wins over any number of blocks. Expressions, joins and aggregates only.

Null urls and urls without `://` have empty host and path, fit no rule, have no
aliases and are allowed. Repeated rows are judged alike; an empty table gives
an empty result; extra columns are carried by `filter_urls`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
Rule = tuple[str, str, str]
_TAG = r"(?is)<{tag}\b[^>]*\b{key}\s*=\s*[\"']?{value}\b[^>]*>"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"(?s)^[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """What names a resource: host, path (none is `/`) and query; null where there is no host."""
    tail = F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"(?s)^[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(tail.startswith("/"), "").otherwise("/"), tail))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    fit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fit = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fit)
    return fit


def _resolved(base: Column, href: Column) -> Column:
    """href against the page's url: absolute, scheme-relative, from the root, a query, or relative to the page's folder; other schemes and bare fragments name nothing."""
    href = F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))
    site, path = F.concat(F.lit("http://"), host_of(base)), path_of(base)
    folder = F.concat(F.when(path.startswith("/"), "").otherwise("/"), F.regexp_replace(path, "[^/]*$", ""))
    file, query = F.regexp_extract(href, r"(?s)^[^?#]*", 0), F.regexp_extract(href, r"(?s)^[^?#]*(.*)", 1)
    return (
        F.when(F.locate("://", file) > 0, href).when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | href.startswith("#"), F.lit(None))
        .when(href.startswith("/"), F.concat(site, _folded(file), query)).when(href.startswith("?"), F.concat(site, path, href))
        .otherwise(F.concat(site, _folded(F.concat(folder, file)), query))
    )


def _folded(path: Column) -> Column:
    """A path from the root without `.` and `..` segments."""
    ends = F.when(path.rlike(r"/\.{1,2}$"), F.concat(path, F.lit("/"))).otherwise(path)
    kept = F.aggregate(F.split(ends, "/"), F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x))))
    return F.array_join(kept, "/")


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) addresses that a page's own html declares equal: canonical links and immediate redirects."""
    canonical = F.regexp_extract(F.regexp_extract("html", _TAG.format(tag="link", key="rel", value="canonical"), 0), r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(F.regexp_extract("html", _TAG.format(tag="meta", key="http-equiv", value="refresh"), 0), r"(?is)\bcontent\s*=\s*[\"']?\s*0+(?:\.0*)?\s*[;,]\s*url\s*=\s*[\"']?([^\"'\s>]+)", 1)
    told = pages.filter(F.col("html").isNotNull() & (F.contains(F.col("html"), F.lit("anonical")) | F.contains(F.col("html"), F.lit("CANONICAL")) | F.col("html").rlike("(?i)http-equiv")))
    found = told.select("url", F.explode(F.array(canonical, refresh)).alias("href")).filter("href <> ''")
    return found.select(address(F.col("url")).alias("src"), address(_resolved(F.col("url"), F.col("href"))).alias("dst")).filter("src is not null and dst is not null and src <> dst")


def filter_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; input columns of these names give way.

    redirects: (src, dst) urls seen to lead to one another, beside what the
    pages' html declares (read only if there is a column html).
    """
    links = page_links(pages.withColumnRenamed(url, "url")) if "html" in pages.columns else None
    if redirects is not None:
        seen = redirects.select(address(F.col("src")).alias("src"), address(F.col("dst")).alias("dst"))
        links = seen if links is None else links.union(seen)
    own = ("host", "path", "rule", "verdict")
    carried = [c for c in pages.columns if c not in own or c == url]
    judged = pages.select(*carried, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("__ns_fit", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.col("__ns_fit.verdict")
    if links is not None:
        of = connected_components(links)
        # Every linked address is judged, crawled or not, and its component takes the strongest decision.
        node = F.concat(F.lit("x://"), F.col("node"))
        known = of.withColumn("v", rule_for(host_of(node), path_of(node), rules)["verdict"])
        decided = known.groupBy("component").agg(F.max(F.when(F.col("v") == "allow", 2).when(F.col("v") == "block", 1).otherwise(0)).alias("d"))
        aliases = cut(of.join(decided, "component").select(F.col("node").alias("__ns_node"), F.col("d").alias("__ns_alias")))
        if not aliases.isEmpty():
            judged = judged.withColumn("__ns_at", address(F.col(url))).join(aliases, F.col("__ns_at") == F.col("__ns_node"), "left")
            verdict = F.coalesce(verdict, F.when(F.col("__ns_alias") == 1, "block"))
    return judged.select(*carried, "host", "path", F.col("__ns_fit.rule").alias("rule"), F.coalesce(verdict, F.lit("allow")).alias("verdict"))
