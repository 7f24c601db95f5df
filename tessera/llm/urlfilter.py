"""URL filtering by rules and by redirect equivalence, in DataFrame operations only.

A rule names a host (with all its subdomains) and a path prefix; the longest that fits decides. A URL that no rule fits
takes the decision of its aliases: URLs are joined by canonical links and by refresh redirects, connected components
over those edges are the aliases, and within a component an explicit allow goes before an explicit block.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """What two spellings of one resource share: host, path and query, without scheme and fragment."""
    return F.concat(host_of(url), path_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Name of the longest rule that fits, else null."""
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    return reduce(lambda rest, r: F.when(fits(r), F.lit(r.name)).otherwise(rest), reversed(ordered), F.lit(None).cast("string"))


def verdict_of(rule: Column, rules: tuple[Rule, ...]) -> Column:
    return reduce(lambda rest, r: F.when(rule == r.name, F.lit(r.verdict)).otherwise(rest), rules, F.lit(None).cast("string"))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): keys of a page and of what its canonical link or refresh points to. Relative targets are resolved against
    the page's host or folder."""
    u, text = F.col(url), F.col(html)
    canonical = F.regexp_extract(F.regexp_extract(text, CANONICAL, 0), HREF, 1)
    refresh = F.regexp_extract(F.regexp_extract(text, REFRESH, 0), TARGET, 1)
    some = pages.where(u.contains("://") & text.isNotNull()).select(u.alias("u"), F.explode(F.array(canonical, refresh)).alias("to")).where("to <> ''")
    scheme, origin = F.regexp_extract("u", r"(?s)^(.*?):", 1), F.regexp_extract("u", r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract("u", r"(?s)^.*?://[^/?#]*(?:[^?#]*/)?", 0)
    to = F.col("to")
    full = (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(origin, to))
        .when(to.startswith("#"), F.col("u"))
        .otherwise(F.concat(F.when(folder.endswith("/") & (folder != F.concat(scheme, F.lit("://"))), folder).otherwise(F.concat(origin, F.lit("/"))), to))
    )
    return some.select(key_of(F.col("u")).alias("src"), key_of(full).alias("dst"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", html: str = "html", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (columns of these names are replaced). A null url, or one
    without ``://``, has an empty host and path, no rule and no alias. Only URLs that have an edge take part in the
    components; the decisions of aliases come back by a join on the URL's key."""
    made = ("host", "path", "rule", "verdict")
    rows = pages.drop(*made).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    nodes = connected_components(link_edges(pages, url, html))
    host, path = F.regexp_extract("node", r"(?s)^[^/?]*", 0), F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1)
    ruled = nodes.withColumn("said", verdict_of(rule_of(host, path, rules), rules))
    groups = ruled.groupBy("component").agg(F.max((F.col("said") == "allow").cast("int")).alias("allowed"), F.max((F.col("said") == "block").cast("int")).alias("blocked"))
    told = groups.where("allowed = 1 or blocked = 1").select("component", F.when(F.col("allowed") == 1, "allow").otherwise("block").alias("__alias"))
    aliases = nodes.join(told, "component").select(F.col("node").alias("__key"), "__alias")
    key = F.when(F.col("rule").isNull() & F.col(url).contains("://"), key_of(F.col(url)))
    out = rows.withColumn("__key", key).join(aliases, "__key", "left")
    return out.withColumn("verdict", F.coalesce(verdict_of(F.col("rule"), rules), "__alias", F.lit(default))).drop("__key", "__alias")
