"""Batch twins of the streaming operators; tests run the streams and compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.mixture import BUFFER, KEEP_PERCENTILE, WARM
from millrace.plans.base import query
from millrace.sources.tables import table
from millrace.streaming import windows as W


def stamp(df):
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return stamp(W.tumbling(table(spark, d, "events")))


@query("stream_sliding", "WITH w AS (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s, value FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY s")
def stream_sliding(spark, d):
    return stamp(W.sliding(table(spark, d, "events")))


@query("stream_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k")
def stream_session(spark, d):
    return stamp(W.sessions(table(spark, d, "events")))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour FROM events")
def stream_dedup(spark, d):
    return W.deduplicated(table(spark, d, "events")).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query("stream_threshold", "SELECT event_type, event_id, round(CASE WHEN count(*) OVER w >= 8 THEN quantile_cont(value, 0.6) OVER w END, 6) AS thr FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING)")
def stream_threshold(spark, d):
    """The batch twin of the stateful threshold."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(-BUFFER, -1)
    e = table(spark, d, "events").withColumns({"n": F.count("*").over(w), "p": F.percentile("value", F.lit(KEEP_PERCENTILE)).over(w)})
    return e.select("event_type", "event_id", F.round(F.when(F.col("n") >= WARM, F.col("p")), 6).alias("thr"))
