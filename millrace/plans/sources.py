"""Queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.plans.base import query
from millrace.session import importable
from millrace.sources import paged
from millrace.sources.tables import table, with_defaults


@query("scan_defaults", "SELECT doc_id, text IS NOT NULL AS has_text, 'web' AS type FROM documents")
def scan_defaults(spark, d):
    """Optional columns get their default."""
    return with_defaults(table(spark, d, "documents"), type="web").select("doc_id", F.col("text").isNotNull().alias("has_text"), "type")


@query("scan_cap_min", "SELECT doc_id, substr(text, 1, 600) AS head FROM documents WHERE length(text) >= 60")
def scan_cap_min(spark, d):
    """The exporter's scan: what a page shows of texts that are long enough."""
    return table(spark, d, "documents").where(F.length("text") >= 60).select("doc_id", F.substring("text", 1, 600).alias("head"))


@query("scan_lane_cap", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE source <> 'src3' AND length(text) > 200) WHERE r <= 40")
def scan_lane_cap(spark, d):
    """Forty documents of each lane, one partition excluded, short ones left out."""
    docs = table(spark, d, "documents").where((F.col("source") != "src3") & (F.length("text") > 200)).select("doc_id", "lang")
    return docs.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("r <= 40").drop("r")


@query("budget_stream", "SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 500000")
def budget_stream(spark, d):
    """Documents in order until a budget of characters is met."""
    return paged.within_budget(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 500_000).select("doc_id")


@query("repeat_to_length", "WITH r AS (SELECT k * (SELECT max(item_id) + 1 FROM benchmark) + item_id AS k2, length(text) AS n FROM benchmark, range(0, 5) AS t(k)) SELECT CAST(k2 AS BIGINT) AS \"at\" FROM (SELECT k2, coalesce(sum(n) OVER (ORDER BY k2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r) WHERE before < 30000")
def repeat_to_length(spark, d):
    """A small source again and again until a length is met."""
    b = table(spark, d, "benchmark")
    size = b.agg((F.max("item_id") + 1).alias("m"))
    r = b.crossJoin(F.broadcast(size)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select((F.col("k") * F.col("m") + F.col("item_id")).alias("at"), F.length("text").alias("n"))
    return paged.within_budget(r, "n", "at", 30_000).select("at")


@query("paged_rows", "SELECT CAST(i AS BIGINT) AS row, 'row ' || i AS value FROM range(0, 250) AS t(i)")
def paged_rows(spark, d):
    """A paged service with a page a task; every page fails once and is asked again."""
    importable(spark)
    spark.dataSource.register(paged.PagedRows)
    return spark.read.format("paged_rows").option("rows", 250).option("fail_first", 1).load()


@query("log_events", r"SELECT regexp_extract(l, '^\[(EVENT|PASS|FAIL)\]', 1) AS kind, count(*) AS lines FROM (SELECT CASE event_type WHEN 'error' THEN '[FAIL] ' WHEN 'signup' THEN '[PASS] ' ELSE '[EVENT] ' END || event_type || ' -- user ' || user_id AS l FROM events) GROUP BY 1")
def log_events(spark, d):
    """Log lines back to fields."""
    tag = F.when(F.col("event_type") == "error", "[FAIL] ").when(F.col("event_type") == "signup", "[PASS] ").otherwise("[EVENT] ")
    lines = table(spark, d, "events").select(F.concat(tag, "event_type", F.lit(" -- user "), "user_id").alias("l"))
    return lines.groupBy(F.regexp_extract("l", r"^\[(EVENT|PASS|FAIL)\] (\S+) -- (.*)$", 1).alias("kind")).agg(F.count("*").alias("lines"))


@query("cell_split", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), c AS (SELECT *, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS cell FROM l) SELECT doc_id, CAST(cell AS BIGINT) AS cell, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY i)) AS cell_md5 FROM c GROUP BY ALL")
def cell_split(spark, d):
    """Lines into cells: a short line opens one; a cell's number is the running count of openings."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    cell = F.sum(F.when(F.length("line") < 40, 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("i"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n")
    return lines.withColumn("cell", cell).groupBy("doc_id", "cell").agg(F.count("*").alias("lines"), F.md5(joined).alias("cell_md5"))


@query("markdown_report", "SELECT '| event_type | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || event_type || ' | ' || n || ' |', chr(10) ORDER BY '| ' || event_type || ' | ' || n || ' |') AS report FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def markdown_report(spark, d):
    return paged.markdown(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")))


@query("table_digest", "SELECT count(*) AS n, bit_xor(('0x' || substr(md5(doc_id || '|' || text), 1, 15))::BIGINT) AS x FROM documents")
def table_digest(spark, d):
    """A digest that no order changes: what a cache is verified by."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "doc_id", "text")), 1, 15), 16, 10).cast("long")
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"))


@query("template_fill", "SELECT source, replace('<b>@SOURCE@</b>: @N@', '@SOURCE@', source) AS half, replace(replace('<b>@SOURCE@</b>: @N@', '@SOURCE@', source), '@N@', CAST(count(*) AS VARCHAR)) AS page FROM documents GROUP BY source")
def template_fill(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    half = F.replace(F.lit("<b>@SOURCE@</b>: @N@"), F.lit("@SOURCE@"), F.col("source"))
    return n.select("source", half.alias("half"), F.replace(half, F.lit("@N@"), F.col("n").cast("string")).alias("page"))
