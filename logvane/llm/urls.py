"""URL filters: rules by host and path, and block decisions that follow redirects.

Pages name each other by `<link rel="canonical">` and `<meta http-equiv="refresh">`; further redirects
may be given as a table. Connected pages are aliases. A page that fits a rule has the verdict of the
longest such rule (of equally long ones, allow). Any other page takes its aliases' decision: allowed
if an alias fits an allow rule, else blocked if one fits a block rule, else allowed.

Pages are the same if host, path and query are; scheme and fragment don't count. Link targets needn't
be pages themselves. Relative links are resolved against the page.

Defined results: a null url, or one without `://`, has empty host and path, fits no rule, has no
aliases and is allowed; null html has no links; repeated rows give repeated results; an empty table
gives no rows. Columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.llm.common import computed_once
from logvane.llm.components import components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        on_host = (host == self.host) | host.endswith("." + self.host)
        return on_host & path.startswith(self.path)


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def parsed(df: DataFrame, url: Column) -> DataFrame:
    """`df` with host, path and `node`: what tells pages apart, null without a host."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    cut = computed_once(df, df.columns, _rest=F.coalesce(rest, F.lit("")))
    host = F.translate(
        F.regexp_extract("_rest", "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase
    )
    split = computed_once(
        cut,
        df.columns,
        host=host,
        path=F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1),
        _query=F.regexp_extract("_rest", r"^[^?#]*(\?[^#]*)?", 1),
    )
    node = F.when(F.col("host") != "", F.concat("host", "path", "_query"))
    return split.withColumn("node", node).drop("_query")


def _resolved(host: Column, path: Column, link: Column) -> Column:
    """A link as an absolute url."""
    site = F.concat(F.lit("http://"), host)
    folder = F.regexp_replace(path, "[^/]*$", "")
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path, link))
        .when(F.length(link) > 0, F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
    )


_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*http-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""


def links(pages: DataFrame) -> DataFrame:
    """(a, b): urls of a page and of the page its html names as canonical or goes on to."""
    found = F.concat(
        *[
            F.when(F.lower("html").contains(word), F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))
            .otherwise(F.array().cast("array<string>"))
            for word, pattern in (("canonical", _CANONICAL), ("refresh", _REFRESH))
        ]
    )
    named = pages.where("url is not null and html is not null").select("url", F.explode(found).alias("link"))
    return parsed(named, F.col("url")).select(
        F.col("url").alias("a"),
        _resolved(F.col("host"), F.col("path"), F.regexp_replace("link", "&amp;", "&")).alias("b"),
    )


def _ruled(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """`df` (with host and path) with `rule` and `ruled` (its verdict), null where none fits."""
    longest = sorted(rules, key=lambda r: (-len(r.name), r.verdict))
    name = verdict = F.when(F.lit(False), F.lit(""))
    for rule in longest:
        fits = rule.fits(F.col("host"), F.col("path"))
        name, verdict = name.when(fits, rule.name), verdict.when(fits, rule.verdict)
    return df.withColumn("rule", name).withColumn("ruled", verdict)


def judge(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and `aliases` (pages connected with it)."""
    edges = links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("a", "b"))
    left = parsed(edges, F.col("a")).select(F.col("node").alias("a"), "b")
    named = parsed(left, F.col("b")).select("a", F.col("node").alias("b"))
    alias = components(named.where("a is not null and b is not null"))
    decided = (
        _ruled(parsed(alias.select("root", "node").withColumnRenamed("node", "page"), F.concat(F.lit("http://"), "page")), rules)
        .groupBy("root")
        .agg(
            F.max(F.when(F.col("ruled") == "allow", 1)).alias("allowed"),
            F.max(F.when(F.col("ruled") == "block", 1)).alias("blocked"),
            F.count("*").alias("aliases"),
        )
    )
    own = _ruled(parsed(pages.select("page_id", "url"), F.col("url")), rules)
    known = alias.join(decided, "root").drop("root")
    taken = F.when(F.col("allowed").isNull() & (F.col("blocked") == 1), "block").otherwise("allow")
    return own.join(known, "node", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", taken).alias("verdict"),
        F.coalesce("aliases", F.lit(1)).alias("aliases"),
    )
