"""Queries over raw web pages: extraction, links, url parts, expected counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import title_form
from millrace.plans.base import query
from millrace.sources.tables import table

BODY = r"regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')"


def pages(spark, d):
    return table(spark, d, "pages")


def visible_text(html):
    """Without scripts, styles and tags; white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(?:script|style)>", " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


@query("html_extract", rf"SELECT page_id, md5(trim(regexp_replace({BODY}, '[ \t\r\n]+', ' ', 'g'))) AS text_md5 FROM pages")
def html_extract(spark, d):
    return pages(spark, d).select("page_id", F.md5(visible_text(F.col("html"))).alias("text_md5"))


@query("page_title", r"SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages")
def page_title(spark, d):
    return pages(spark, d).select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"))


@query("title_match", r"SELECT page_id, contains(n, substr(n, 1, 45)) AND length(n) > 0 AS found, n AS title FROM (SELECT page_id, trim(regexp_replace(lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '[^a-z0-9]+', ' ', 'g')) AS n FROM pages)")
def title_match(spark, d):
    """A title's normal form contains its own first 45 characters; the match that sources are verified by."""
    n = pages(spark, d).select("page_id", title_form(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"))
    return n.select("page_id", (F.contains("title", F.substring("title", 1, 45)) & (F.length("title") > 0)).alias("found"), "title")


@query("page_links", r"SELECT page_id, count(*) AS links, md5(string_agg(link, ' ' ORDER BY i)) AS links_md5 FROM (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\s+href=\x22([^\x22]*)\x22', 1) AS l FROM pages)) GROUP BY page_id")
def page_links(spark, d):
    found = F.regexp_extract_all("html", F.lit(r'(?i)<a\s+href="([^"]*)"'), F.lit(1))
    return pages(spark, d).select("page_id", found.alias("l")).where(F.size("l") > 0).select("page_id", F.size("l").cast("long").alias("links"), F.md5(F.array_join("l", " ")).alias("links_md5"))


@query("url_parts", r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages")
def url_parts(spark, d):
    u = "url"
    return pages(spark, d).select(
        "page_id", F.regexp_extract(u, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(u, "^[a-z]+://([^/?#]*)", 1).alias("host"),
        F.regexp_extract(u, "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract(u, r"\?([^#]*)", 1).alias("query"),
    )


@query("regex_expect", r"WITH c AS (SELECT page_id, len(regexp_extract_all(html, '<p>')) AS p, len(regexp_extract_all(html, '<li>')) AS li, len(regexp_extract_all(html, '<h1>')) AS h1 FROM pages) SELECT count(*) AS pages, count(*) FILTER (p BETWEEN 1 AND 200) AS p_ok, count(*) FILTER (li BETWEEN 1 AND 20) AS li_ok, count(*) FILTER (h1 = 1) AS h1_ok FROM c")
def regex_expect(spark, d):
    """How many pages have as many marks as expected."""
    n = lambda p: F.regexp_count("html", F.lit(p))
    return pages(spark, d).agg(F.count("*").alias("pages"), F.count_if(n("<p>").between(1, 200)).alias("p_ok"), F.count_if(n("<li>").between(1, 20)).alias("li_ok"), F.count_if(n("<h1>") == 1).alias("h1_ok"))


@query("xml_records", r"SELECT page_id, i AS place, r AS entry FROM (SELECT page_id, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS l FROM pages))")
def xml_records(spark, d):
    """Records between marks, with their place."""
    l = F.regexp_extract_all("html", F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1))  # noqa: E741
    return pages(spark, d).select("page_id", F.posexplode(l).alias("at", "entry")).select("page_id", (F.col("at") + 1).cast("long").alias("place"), "entry")


@query("host_counts", r"SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1")
def host_counts(spark, d):
    return pages(spark, d).groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).cast("long").alias("chars"))
