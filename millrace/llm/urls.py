"""URL filters: rules by host and path, and block decisions that reach aliases.

Pages that redirect to each other, or name each other as canonical, are one
resource.  Components over those edges carry a block to the aliases that no rule
names; an explicit allow goes before a block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize
from millrace.llm.graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ATTRIBUTE = r"""(?i)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and what follows it (query and fragment); all empty where the url is null or has no ://."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, "(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(text, "(?s)^.*?://[^/?#]*([^?#]*)", 1)
    more = F.regexp_extract(text, "(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1)
    return F.translate(host, UPPER, LOWER), path, more


def node(url: Column) -> Column:
    """A url's name in the graph: host, path and query; null if it has no host."""
    host, path, more = split_url(url)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), F.regexp_extract(more, r"^\?[^#]*", 0)))


def _best_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equally long ones, the first); null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _attribute(tag: Column, name: str) -> Column:
    pattern = _ATTRIBUTE.format(name=name)
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.regexp_replace(F.trim(value), "&amp;", "&")


def _resolve(host: Column, path: Column, link: Column) -> Column:
    """link as an absolute url, seen from the page at host and path."""
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "(?s)^(.*/)", 1))
    return (
        F.when(link == "", F.lit(None).cast("string"))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(F.lit("http://"), host, link))
        .when(link.rlike("^[?#]"), F.concat(F.lit("http://"), host, path, link))
        .otherwise(F.concat(F.lit("http://"), host, folder, link))
    )


def links(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes of canonical links and of refresh redirects in pages (url, html)."""
    tags = F.regexp_extract_all("html", F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    relevant = F.filter(tags, lambda t: t.rlike(r"(?i)canonical|refresh"))
    tag = F.col("tag")
    target = F.when(
        tag.rlike(r"(?i)^<link") & F.lower(_attribute(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)"), _attribute(tag, "href")
    ).when(
        tag.rlike(r"(?i)^<meta") & (F.lower(_attribute(tag, "http-equiv")) == "refresh"),
        F.trim(F.regexp_extract(_attribute(tag, "content"), r"""(?i)url\s*=\s*["']?([^"']*)""", 1)),
    )
    found = pages.where(F.col("html").rlike(r"(?i)canonical|refresh")).select("url", F.explode(relevant).alias("tag"))
    host, path, _ = split_url(F.col("url"))
    aimed = found.select(node(F.col("url")).alias("src"), host.alias("host"), path.alias("path"), target.alias("target"))
    there = aimed.select("src", _resolve(F.col("host"), F.col("path"), F.col("target")).alias("there"))
    return there.select("src", node(F.col("there")).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")


def judge(spark: SparkSession, pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url, html).

    A page's own rule decides.  Without one, its component does: allow if a member has an
    allow rule, else block if a member has a block rule, else allow.  redirects (src, dst)
    are further edges between urls.  Null urls and urls without :// have empty host and path,
    fit no rule, belong to no component and are allowed; a null html has no links.  Repeated
    rows are judged one by one; an empty table gives no rows; other columns are ignored.
    """
    url = F.col("url")
    host, path, _ = split_url(url)
    seen = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = links(seen)
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("src")), node(F.col("dst"))))
    text, verdict = _best_rule(F.col("host"), F.col("path"), rules)
    judged = seen.select("page_id", host.alias("host"), path.alias("path"), node(url).alias("node")).select(
        "page_id", "host", "path", "node", text.alias("rule"), verdict.alias("own")
    )
    named = components(spark, materialize(spark, edges.distinct(), "links"))
    of_node_host, of_node_path, _ = split_url(F.concat(F.lit("x://"), F.col("node")))
    _, node_verdict = _best_rule(F.col("node_host"), F.col("node_path"), rules)
    members = named.withColumns({"node_host": of_node_host, "node_path": of_node_path}).withColumn("own", node_verdict)
    decided = members.groupBy("component").agg(
        F.when(F.max(F.col("own") == "allow"), "allow").when(F.max(F.col("own") == "block"), "block").alias("passed_on")
    ).where("passed_on = 'block'")
    blocked = named.join(decided, "component").select(F.col("node"), F.col("passed_on"))
    return judged.join(blocked, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", "passed_on", F.lit("allow")).alias("verdict")
    )
