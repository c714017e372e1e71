"""Evidence: checks of requirements, recomputed by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.plans import firewall, ledger, mixture, packing, shards
from millrace.plans.base import ORACLES, query
from millrace.operators import ledger as L
from millrace.operators import mixture as M
from millrace.operators import packing as P
from millrace.operators import shards as S
from millrace.operators.runs import in_blocks, numbered
from millrace.sources.tables import table


def checks(df, **named):
    """One row (requirement-independent): each named boolean aggregate, as rows check, passed."""
    one = df.agg(*[c.alias(k) for k, c in named.items()])
    rows = ", ".join(f"'{k}', {k}" for k in named)
    return one.selectExpr(f"stack({len(named)}, {rows}) AS (name, passed)")


def sql_checks(source: str, **named: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS name, ({v}) AS passed FROM {source}" for k, v in named.items())


def cte(body: str, rest: str) -> str:
    return f"WITH {body} {rest}"


@query("evidence_tokenizer", cte(shards.PLACED, sql_checks("m", all_hashed="bool_and(length(content_hash) = 64)", one_width="count(DISTINCT length(content_hash)) = 1")))
def evidence_tokenizer(spark, d):
    h = F.length("content_hash")
    return checks(S.manifests(shards.placed(spark, d)), all_hashed=F.bool_and(h == 64), one_width=F.countDistinct(h) == 1)


@query("evidence_firewall", f"WITH {firewall.HITS}, never AS (SELECT DISTINCT doc_id FROM hit WHERE n >= 5), served AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM never)) SELECT 'never_served' AS name, (SELECT count(*) FROM served JOIN never USING (doc_id)) = 0 AS passed UNION ALL SELECT 'some_blocked', (SELECT count(*) FROM never) > 0")
def evidence_firewall(spark, d):
    from millrace.operators import firewall as W

    never = W.hits(firewall.docs(spark, d), firewall.registry(spark, d)).where("n >= 5").select("doc_id").distinct()
    flags = firewall.docs(spark, d).select("doc_id").join(never.withColumn("never", F.lit(True)), "doc_id", "left").withColumn("served", F.col("never").isNull())
    return checks(flags, never_served=F.count_if(F.col("served") & F.col("never").isNotNull()) == 0, some_blocked=F.count("never") > 0)


@query("evidence_packing", cte(packing.TOKENS, sql_checks("p", adds_up="count(*) FILTER (segment_id < 0) + count(*) FILTER (segment_id >= 0) = count(*)", no_loss_on_padding="count(*) FILTER (loss_mask AND segment_id < 0) = 0", utilized="count(*) FILTER (segment_id >= 0)::DOUBLE / count(*) BETWEEN 0 AND 1")))
def evidence_packing(spark, d):
    p = P.positions(packing.token_rows(spark, d))
    used = F.col("segment_id") >= 0
    return checks(p, adds_up=F.count_if(~used) + F.count_if(used) == F.count("*"), no_loss_on_padding=F.count_if(F.col("loss_mask") & ~used) == 0, utilized=(F.count_if(used) / F.count("*")).between(0, 1))


@query("evidence_mixture", cte(ledger.L, "SELECT lane, round(n::DOUBLE / sum(n) OVER (), 6) AS share, abs(n::DOUBLE / sum(n) OVER () - 0.2) <= 0.05 AS within FROM (SELECT lane, count(*) AS n FROM eff GROUP BY lane)"))
def evidence_mixture(spark, d):
    t = ledger.effective(spark, d).groupBy("lane").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return t.select("lane", F.round(share, 6).alias("share"), (F.abs(share - 0.2) <= 0.05).alias("within"))


@query("evidence_selection", cte(mixture.DECIDED, sql_checks("k", known_status="bool_and(status IN ('accepted', 'protected', 'deferred', 'rejected'))", protected_has_floor="bool_and(status <> 'protected' OR floor)", scored="count(*) FILTER (score IS NULL) = 0")))
def evidence_selection(spark, d):
    k = M.decide(M.thresholds(mixture.scores(spark, d)))
    return checks(k, known_status=F.bool_and(F.col("status").isin("accepted", "protected", "deferred", "rejected")), protected_has_floor=F.bool_and((F.col("status") != "protected") | F.col("floor")), scored=F.count_if(F.col("score").isNull()) == 0)


@query("evidence_resume", cte(ledger.L, "SELECT count(*) AS places, count(*) FILTER (a.unit = b.unit) AS same_unit, count(*) FILTER (b.offset_ > a.offset_) AS later FROM (SELECT * FROM l WHERE attempt = 1 AND type = 'consumption') a JOIN (SELECT * FROM l WHERE attempt = 2 AND type = 'consumption') b USING (branch, step, rank, microbatch)"))
def evidence_resume(spark, d):
    """First and second attempts at the same place."""
    rows = ledger.ledger(spark, d).where("type = 'consumption'")
    a, b = rows.where("attempt = 1").alias("a"), rows.where("attempt = 2").alias("b")
    on = ["branch", *L.KEY]
    met = a.join(b, on)
    return met.agg(F.count("*").alias("places"), F.count_if(F.expr("a.unit = b.unit")).alias("same_unit"), F.count_if(F.expr("b.offset > a.offset")).alias("later"))


@query("evidence_replay", ORACLES["ledger_replay_compare"])
def evidence_replay(spark, d):
    return ledger.ledger_replay_compare(spark, d)


@query("evidence_learning", cte(ledger.LEARN, sql_checks("k", no_orphans="count(*) FILTER (lane IS NULL) = 0", classes_known="bool_and(class IN ('useful', 'neutral', 'harmful'))", finite="bool_and(isfinite(mean))")))
def evidence_learning(spark, d):
    k = ledger.learning(spark, d)
    return checks(k, no_orphans=F.count_if(F.col("lane").isNull()) == 0, classes_known=F.bool_and(F.col("class").isin("useful", "neutral", "harmful")), finite=F.bool_and(~F.isnan("mean") & (F.abs("mean") < 1e300)))


@query("evidence_throughput", "WITH a AS (SELECT event_type, sum(value) / count(*) AS x, avg(value) AS y FROM events GROUP BY event_type) SELECT event_type, abs(x - y) / greatest(abs(y), 1e-9) <= 0.02 AS within FROM a")
def evidence_throughput(spark, d):
    a = table(spark, d, "events").groupBy("event_type").agg((F.sum("value") / F.count("*")).alias("x"), F.avg("value").alias("y"))
    return a.select("event_type", (F.abs(F.col("x") - F.col("y")) / F.greatest(F.abs("y"), F.lit(1e-9)) <= 0.02).alias("within"))


@query("evidence_bundle", cte(ledger.LEARN, "SELECT bool_and(passed) AS passed, count(*) AS checks, count(*) FILTER (passed) AS passing FROM (" + sql_checks("k", no_orphans="count(*) FILTER (lane IS NULL) = 0", classes_known="bool_and(class IN ('useful', 'neutral', 'harmful'))", finite="bool_and(isfinite(mean))") + ")"))
def evidence_bundle(spark, d):
    return evidence_learning(spark, d).agg(F.bool_and("passed").alias("passed"), F.count("*").alias("checks"), F.count_if("passed").alias("passing"))


@query("reconcile_lists", "SELECT coalesce(a.doc_id, b.item_id) AS id, CASE WHEN b.item_id IS NULL THEN 'missing_right' WHEN a.doc_id IS NULL THEN 'missing_left' WHEN length(a.text) <> length(b.text) THEN 'differs' ELSE 'same' END AS finding FROM documents a FULL JOIN (SELECT item_id + 30 AS item_id, text FROM benchmark) b ON a.doc_id = b.item_id")
def reconcile_lists(spark, d):
    """Two lists by key: what either lacks, and what differs."""
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("x"))
    b = table(spark, d, "benchmark").select((F.col("item_id") + 30).alias("id"), F.length("text").alias("y"))
    finding = F.when(F.col("y").isNull(), "missing_right").when(F.col("x").isNull(), "missing_left").when(F.col("x") != F.col("y"), "differs").otherwise("same")
    return a.join(b, "id", "full").select("id", finding.alias("finding"))


@query("chronology_check", "WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m') ELSE strftime(ts, '%Y-%m-%d') END AS d FROM events), p AS (SELECT event_id, d, lag(d) OVER (ORDER BY event_id) AS b FROM e) SELECT count(*) AS pairs, count(*) FILTER (substr(d, 1, least(length(d), length(b))) < substr(b, 1, least(length(d), length(b)))) AS out_of_order FROM p WHERE b IS NOT NULL")
def chronology_check(spark, d):
    """Neighbours in order, at the coarser of two dates' precisions."""
    day = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    dated = in_blocks(numbered(table(spark, d, "events").select("event_id", day.alias("d")), [], ["event_id"]), back=1)
    p = dated.withColumn("b", F.lag("d").over(Window.partitionBy("block").orderBy("i"))).where("own AND b IS NOT NULL")
    k = F.least(F.length("d"), F.length("b"))
    one = F.lit(1)
    return p.agg(F.count("*").alias("pairs"), F.count_if(F.substring(F.col("d"), one, k) < F.substring(F.col("b"), one, k)).alias("out_of_order"))


@query("fetch_batches", "SELECT CAST((r - 1) // 12 AS BIGINT) AS batch, count(*) AS ids, min(doc_id) AS first_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) GROUP BY 1")
def fetch_batches(spark, d):
    ids = numbered(table(spark, d, "documents").select("doc_id"), [], ["doc_id"]).select("doc_id", F.floor((F.col("i") - 1) / 12).alias("batch"))
    return ids.groupBy("batch").agg(F.count("*").alias("ids"), F.min("doc_id").alias("first_id"))


@query("lane_dashboard", "WITH d AS (SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source), q AS (SELECT source, count(*) FILTER (quality = 1) AS good FROM documents JOIN labels USING (doc_id) GROUP BY source), t AS (SELECT source, count(*) FILTER (toxic = 1) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT d.source, docs, chars, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN q USING (source) LEFT JOIN t USING (source)")
def lane_dashboard(spark, d):
    docs = table(spark, d, "documents")
    lab = docs.select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic")
    )
    base = docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return base.join(lab, "source", "left").na.fill(0, ["good", "toxic"])


@query("stage_tags", f"WITH {mixture.STAGE}, ev AS (SELECT event_id // 125 % 80 AS step, value FROM events) SELECT stage, count(*) AS rows_, round(avg(value), 6) AS mean FROM ev JOIN st ON ev.step >= step_start AND ev.step < step_end GROUP BY stage")
def stage_tags(spark, d):
    """Steps in stages: a range join against a table of five rows."""
    st = F.broadcast(M.stage_table(spark, M.Schedule()))
    s = table(spark, d, "events").select((F.floor(F.col("event_id") / 125) % 80).alias("step"), "value")
    return s.join(st, F.expr("step >= step_start AND step < step_end")).groupBy("stage").agg(F.count("*").alias("rows_"), F.round(F.avg("value"), 6).alias("mean"))


@query("loss_curve", "SELECT event_id // 50 AS step, round(avg(value), 6) AS loss FROM events GROUP BY 1")
def loss_curve(spark, d):
    return table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 50).alias("step")).agg(F.round(F.avg("value"), 6).alias("loss"))


@query("tally", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def tally(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "event_type")


@query("stride_sample", "WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS back FROM events) SELECT event_id, event_type FROM r WHERE rn % 100 = 0 OR back = 1")
def stride_sample(spark, d):
    """Every hundredth of each type, and the last."""
    w = Window.partitionBy("event_type")
    r = table(spark, d, "events").select("event_id", "event_type", F.row_number().over(w.orderBy("event_id")).alias("rn"), F.row_number().over(w.orderBy(F.col("event_id").desc())).alias("back"))
    return r.where("rn % 100 = 0 OR back = 1").select("event_id", "event_type")


@query("batch_anatomy", cte(packing.TOKENS, "SELECT arg_max(seq, segments::HUGEINT * 4611686018427387904 - seq) AS most_segments, arg_max(seq, context::HUGEINT * 4611686018427387904 - seq) AS most_context FROM (SELECT seq, count(DISTINCT segment_id) FILTER (segment_id >= 0) AS segments, count(*) FILTER (segment_id >= 0 AND NOT loss_mask) AS context FROM p GROUP BY seq)"))
def batch_anatomy(spark, d):
    p = P.positions(packing.token_rows(spark, d))
    used = F.col("segment_id") >= 0
    s = p.groupBy("seq").agg(F.countDistinct(F.when(used, F.col("segment_id"))).alias("segments"), F.count_if(used & ~F.col("loss_mask")).alias("context"))
    return s.agg(F.max_by("seq", F.struct("segments", -F.col("seq"))).alias("most_segments"), F.max_by("seq", F.struct("context", -F.col("seq"))).alias("most_context"))
