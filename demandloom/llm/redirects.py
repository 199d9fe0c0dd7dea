"""URL rules that follow redirects and canonical links to aliases, in DataFrame functions only.

Pages name their aliases by `<link rel="canonical">` and `<meta http-equiv="refresh">`. Distributed
connected components over these edges, and over given redirects, join the urls that stand for one
resource. A rule decides its own urls; a block then reaches every alias that has no rule of its own,
unless a url of the same component is explicitly allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .frames import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules are part of the plan; more are a table that urls are joined with.
PLANNED_RULES = 1000


@dataclass(frozen=True)
class Rule:
    """`verdict` is "allow" or "block"; the path begins with "/"."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, path).otherwise("")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null.

    A rule fits its host and all subdomains of it where the path begins with the rule's.
    """
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name = F.when(fits, rule.name) if name is None else name.when(fits, rule.name)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def with_rules(df: DataFrame, rules: list[Rule] | DataFrame, planned: int = PLANNED_RULES) -> DataFrame:
    """`df` with `rule` and `verdict` of the longest rule that fits its `host` and `path`, else null.

    `rules` is a list, or a table `(verdict, host, path)` of any size; of two verdicts for one rule
    "allow" counts. With a table, the suffixes of each distinct host meet the lengths of the paths that
    rules of that suffix have, so a url becomes a few rows, which are joined with the rules by host and
    path. Nothing grows with urls times rules.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= planned:
            name, verdict = rule_of(F.col("host"), F.col("path"), rules)
            return df.select("*", name.alias("rule"), verdict.alias("verdict"))
        cells = [(r.verdict, r.host, r.path) for r in rules]
        rules = df.sparkSession.createDataFrame(cells, "verdict string, host string, path string")
    table = rules.groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(
        F.min("verdict").alias("verdict")
    )
    table = staged(table, "rules")
    lengths = table.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("sizes"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    urls = df.select("host", "path").distinct()
    tried = (
        urls.select("host", "path", F.explode(suffixes).alias("rule_host"))
        .join(lengths, "rule_host")
        .select("host", "path", "rule_host", F.explode("sizes").alias("size"))
        .where("size <= length(path)")
        .select("host", "path", "rule_host", F.expr("left(path, size)").alias("rule_path"))
    )
    name = F.concat("rule_host", "rule_path")
    longest = F.min(F.struct((-F.length(name)).alias("order"), name.alias("name"), F.col("verdict").alias("verdict")))
    best = tried.join(table, ["rule_host", "rule_path"]).groupBy("host", "path").agg(longest.alias("best"))
    found = df.join(best, ["host", "path"], "left")
    return found.select(*df.columns, F.col("best.name").alias("rule"), F.col("best.verdict").alias("verdict"))


def resource(url: Column) -> Column:
    """The node of a url: what it names without scheme, fragment and the case of its host; null without `://`."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*([^#]*)", 1)
    named = F.concat(host_of(url), F.when(tail == "", F.lit("/")).otherwise(tail))
    return F.when(F.instr(url, "://") > 0, named)


def folded(path: Column) -> Column:
    """A path that begins with `/`, with its `.` and `..` segments carried out."""
    parts = F.split(F.substring(path, 2, 2**31 - 1), "/")
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """`(source, target)` urls of canonical links and refresh redirects; relative targets are resolved.

    Targets without a scheme are relative to the page's url; `base` elements do not count. Links within
    the page, and schemes without `://`, have no target.
    """
    tags = F.filter(
        F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0),
        lambda tag: tag.rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?\s*canonical\b")
        | tag.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"),
    )
    target = F.regexp_extract("tag", r"(?is)\b(?:href|url)\s*=\s*[\"']?\s*([^\"'>\s]+)", 1)
    scheme = F.regexp_extract(F.col("source"), r"(?s)^(.*?://)", 1)
    own = F.when(path_of(F.col("source")) == "", F.lit("/")).otherwise(path_of(F.col("source")))
    to = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    query = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    beside = F.concat(F.regexp_extract(own, r"(?s)^(.*/)", 1), to)
    path = F.when(to == "", own).otherwise(folded(F.when(to.startswith("/"), to).otherwise(beside)))
    full = (
        F.when(target.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), target))
        .when((target != "") & ~target.rlike(r"(?i)^(?:#|[a-z][a-z0-9+.\-]*:)"), F.concat(scheme, host_of(F.col("source")), path, query))
    )
    return (
        pages.where(F.col(url).contains("://") & F.col(html).rlike(r"(?i)canonical|http-equiv"))
        .select(F.col(url).alias("source"), F.explode(tags).alias("tag"))
        .select("source", full.alias("target"))
        .where("target is not null")
    )


def judge_urls(
    pages: DataFrame,
    rules: list[Rule] | DataFrame,
    redirects: DataFrame | None = None,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    planned: int = PLANNED_RULES,
) -> DataFrame:
    """`(key, host, path, rule, verdict)` of every row of `pages`, with `alias_root` of linked urls.

    `rules` is a list or a table, see `with_rules`. `redirects`, if given, has string columns `source` and
    `target`. `verdict` is the rule's, where
    one fits. Else it is "block" if a url of the component is blocked by a rule and none is allowed by
    one, and "allow" otherwise. Urls at the far end of an edge count even if they are no page. Null
    urls, and urls without `://`, have no host, path, rule or alias and are allowed. Null html has no
    edges; repeated rows are judged alike; columns of other names do not matter.
    """
    found = alias_edges(pages, url, html)
    if redirects is not None:
        found = found.unionByName(redirects.select("source", "target"))
    found = staged(found.dropna().distinct(), "aliases")
    edges = found.select(resource(F.col("source")).alias("a"), resource(F.col("target")).alias("b"))
    roots = staged(connected_components(edges), "roots")

    ends = found.select(F.explode(F.array("source", "target")).alias("url"))
    named = ends.unionByName(pages.select(F.col(url).alias("url"))).select(
        resource(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    linked = with_rules(named, rules, planned).select("node", F.col("verdict").alias("own"))
    # Only urls in a component pass a decision on; the sums are combined before the shuffle.
    decided = (
        linked.where("own is not null")
        .distinct()
        .join(roots, "node")
        .groupBy("root")
        .agg((F.max(F.col("own") == "block") & ~F.max(F.col("own") == "allow")).alias("blocked"))
    )
    members = roots.join(decided, "root", "left").select("node", "root", "blocked")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select(
        "key", host.alias("host"), path.alias("path"), resource(F.col("url")).alias("node")
    )
    passed_on = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return with_rules(judged, rules, planned).join(members, "node", "left").select(
        F.col("key").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("verdict", passed_on).alias("verdict"),
        F.col("root").alias("alias_root"),
    )
