"""Queries over series, losses, schedules, routing, and small tables of arithmetic."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators.runs import in_blocks, numbered
from millrace.plans.base import both, query
from millrace.sources.tables import table

# a series for each event type: its values by event_id
S = "s AS (SELECT event_type AS series, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events)"


def series(spark, d):
    return numbered(table(spark, d, "events").select(F.col("event_type").alias("series"), "event_id", "value"), ["series"], ["event_id"])


def spikes(df, k: float = 3.5, window: int = 20):
    """Values more than k median absolute deviations above the trailing median (the upper one, as is).

    Both medians come from the row's own frame, an array of `window` values, in blocks of the series."""
    frame = Window.partitionBy("series", "block").orderBy("i").rowsBetween(-window, -1)
    upper = lambda a: F.element_at(F.array_sort(a), F.expr("CAST(size(past) div 2 + 1 AS INT)"))
    blocks = in_blocks(df, back=window)
    seen = blocks.withColumn("past", F.collect_list("value").over(frame)).where("own").where(F.size("past") == window).drop("block", "own")
    mid = seen.withColumn("m", upper(F.col("past")))
    mad = mid.withColumn("mad", upper(F.transform("past", lambda x: F.abs(x - F.col("m")))))
    return mad.where(F.col("value") > F.col("m") + k * F.col("mad"))


MAD = f"{S}, p AS (SELECT *, list(value) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS past FROM s), m AS (SELECT *, list_sort(past)[11] AS m FROM p WHERE len(past) = 20), k AS (SELECT *, list_sort(list_transform(past, lambda x: abs(x - m)))[11] AS mad FROM m), sp AS (SELECT * FROM k WHERE value > m + 3.5 * mad)"


@query("spike_mad", f"WITH {MAD} SELECT series, event_id, round(value - m, 4) AS above FROM sp")
def spike_mad(spark, d):
    return spikes(series(spark, d)).select("series", "event_id", F.round(F.col("value") - F.col("m"), 4).alias("above"))


@query("lead_lag", f"WITH {MAD} SELECT a.series, a.i AS \"at\", min(b.i) - a.i AS lag_ FROM sp a JOIN sp b ON a.series = b.series AND b.i > a.i AND b.i <= a.i + 5 GROUP BY a.series, a.i")
def lead_lag(spark, d):
    """The next spike within five values of each: the next row suffices, no interval join."""
    s = in_blocks(spikes(series(spark, d)).select("series", "i"), ahead=5)
    nxt = s.withColumn("n", F.lead("i").over(Window.partitionBy("series", "block").orderBy("i")))
    return nxt.where("own AND n <= i + 5").select("series", F.col("i").alias("at"), (F.col("n") - F.col("i")).alias("lag_"))


@query("rolling_median", f"WITH {S} SELECT series, event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), 6) AS smooth FROM s")
def rolling_median(spark, d):
    w = Window.partitionBy("series", "block").orderBy("i").rowsBetween(-10, 0)
    smooth = in_blocks(series(spark, d), back=10).select("series", "event_id", "own", F.round(F.percentile("value", F.lit(0.5)).over(w), 6).alias("smooth"))
    return smooth.where("own").drop("own")


both("converged_at", "events", "WITH s AS (SELECT event_type AS series, event_id, value FROM events), v AS (SELECT series, max(CASE WHEN value > 150 THEN event_id END) AS last_bad FROM s GROUP BY series) SELECT s.series, min(event_id) AS first_good FROM s JOIN v ON s.series = v.series WHERE event_id > coalesce(last_bad, -1) GROUP BY s.series")
both("first_within", "events", "SELECT event_type AS series, min(CASE WHEN value <= 1 THEN event_id END) AS first_within FROM events GROUP BY event_type")
both("weighted_vs_batch_mean", "events", "WITH b AS (SELECT user_id, count(*) AS n, avg(value) AS m FROM events GROUP BY user_id) SELECT round(sum(n * m) / sum(n), 6) AS token_mean, round(avg(m), 6) AS batch_mean FROM b")
both("masked_loss", "events", "SELECT event_type, round(avg(CASE WHEN event_id % 2 = 0 THEN value END), 6) AS even_only, round(avg(CASE WHEN event_id % 3 <> 0 THEN value END), 6) AS no_thirds, round(avg(value), 6) AS all_, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) AS n_even FROM events GROUP BY event_type",
     "SELECT event_type, round(avg(CASE WHEN event_id % 2 = 0 THEN value END), 6) AS even_only, round(avg(CASE WHEN event_id % 3 <> 0 THEN value END), 6) AS no_thirds, round(avg(value), 6) AS all_, CAST(sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_even FROM events GROUP BY event_type")
both("bits_per_byte", "documents", "SELECT lang, round(sum(n_chars * 2.0) / ln(2) / sum(octet_length(text)), 6) AS bits_per_byte, round(sum(n_chars * 2.0) / ln(2) / sum(length(text)), 6) AS bits_per_char FROM documents GROUP BY lang",
     "SELECT lang, round(sum(n_chars * 2.0) / ln(2) / sum(strlen(text)), 6) AS bits_per_byte, round(sum(n_chars * 2.0) / ln(2) / sum(length(text)), 6) AS bits_per_char FROM documents GROUP BY lang")
both("rank_agreement", "documents", "WITH r AS (SELECT lang, rank() OVER (ORDER BY avg(n_chars)) AS a, rank() OVER (ORDER BY max(n_chars)) AS b FROM documents GROUP BY lang) SELECT count(*) AS langs, sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS same FROM r",
     "WITH r AS (SELECT lang, rank() OVER (ORDER BY avg(n_chars)) AS a, rank() OVER (ORDER BY max(n_chars)) AS b FROM documents GROUP BY lang) SELECT count(*) AS langs, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) AS same FROM r")


@query("sharded_logsumexp", "SELECT event_type, round(max(value) + ln(sum(exp(value - mx))), 6) AS lse FROM (SELECT event_type, value, max(value) OVER (PARTITION BY event_type) AS mx FROM events) GROUP BY event_type")
def sharded_logsumexp(spark, d):
    """Stable in two phases: maxima by shard, then scaled sums; both combine before the shuffle."""
    e = table(spark, d, "events").select("event_type", "value", (F.col("user_id") % 4).alias("shard"))
    top = e.groupBy("event_type").agg(F.max("value").alias("m"))
    s = e.join(F.broadcast(top), "event_type").groupBy("event_type").agg(F.first("m").alias("m"), F.sum(F.exp(F.col("value") - F.col("m"))).alias("z"))
    return s.select("event_type", F.round(F.col("m") + F.ln("z"), 6).alias("lse"))


both("per_step_spread", "events", "WITH p AS (SELECT CAST(floor(event_id / 100) AS BIGINT) AS step, user_id % 4 AS rank, avg(value) AS v FROM events GROUP BY CAST(floor(event_id / 100) AS BIGINT), user_id % 4) SELECT step, round(avg(v), 6) AS mean, round(max(v), 6) AS most, round(max(v) - min(v), 6) AS spread FROM p GROUP BY step",
     "WITH p AS (SELECT CAST(floor(event_id / 100) AS BIGINT) AS step, user_id % 4 AS rank_, avg(value) AS v FROM events GROUP BY ALL) SELECT step, round(avg(v), 6) AS mean, round(max(v), 6) AS most, round(max(v) - min(v), 6) AS spread FROM p GROUP BY step")

LR = """SELECT step, round(CASE WHEN step < 20 THEN 0.001 * (step + 1) / 20 ELSE 0.0001 + 0.5 * 0.0009 * (1 + cos(pi() * (step - 20) / 180)) END, 9) AS cosine,
 round(CASE WHEN step < 20 THEN 0.001 * (step + 1) / 20 WHEN step < 160 THEN 0.001 ELSE 0.001 * (200 - step) / 40 END, 9) AS wsd, 0.001 AS const_ FROM r"""


@query("lr_schedule", "WITH r AS (SELECT CAST(i AS DOUBLE) AS step FROM range(0, 200) AS t(i)) " + LR.replace("0.001 AS const_", "CAST(0.001 AS DOUBLE) AS const_").replace("0.001 *", "0.001::DOUBLE *").replace("THEN 0.001 ELSE", "THEN 0.001::DOUBLE ELSE"))
def lr_schedule(spark, d):
    """Warmup and cosine, warmup-stable-decay, constant."""
    s = F.col("step")
    warm = F.lit(0.001) * (s + 1) / 20
    cosine = F.lit(0.0001) + F.lit(0.5) * 0.0009 * (1 + F.cos(F.pi() * (s - 20) / 180))
    return spark.range(200).select(F.col("id").cast("double").alias("step")).select(
        "step", F.round(F.when(s < 20, warm).otherwise(cosine), 9).alias("cosine"),
        F.round(F.when(s < 20, warm).when(s < 160, F.lit(0.001)).otherwise(F.lit(0.001) * (200 - s) / 40), 9).alias("wsd"), F.lit(0.001).alias("const_"),
    )


@query("adam_scalar", "WITH RECURSIVE f AS (SELECT 0 AS t, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v, 1.0::DOUBLE AS x UNION ALL SELECT t + 1, 0.9::DOUBLE * m + 0.1::DOUBLE * 2 * x, 0.999::DOUBLE * v + 0.001::DOUBLE * (2 * x) * (2 * x), x - 0.1::DOUBLE * ((0.9::DOUBLE * m + 0.1::DOUBLE * 2 * x) / (1 - pow(0.9::DOUBLE, t + 1))) / (sqrt((0.999::DOUBLE * v + 0.001::DOUBLE * (2 * x) * (2 * x)) / (1 - pow(0.999::DOUBLE, t + 1))) + 1e-8) FROM f WHERE t < 50) SELECT t, round(x, 6) AS x FROM f WHERE t > 0")
def adam_scalar(spark, d):
    """The optimiser's recurrence on x**2, as a fold over the step numbers."""
    state = "struct<m:double,v:double,x:double>"

    def step(acc, t):
        g = acc["x"] * 2
        m = acc["m"] * 0.9 + g * 0.1
        v = acc["v"] * 0.999 + g * g * 0.001
        x = acc["x"] - F.lit(0.1) * (m / (1 - F.pow(F.lit(0.9), t))) / (F.sqrt(v / (1 - F.pow(F.lit(0.999), t))) + 1e-8)
        return F.struct(m.alias("m"), v.alias("v"), x.alias("x")).cast(state)

    start = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("v"), F.lit(1.0).alias("x")).cast(state)
    upto = F.sequence(F.lit(1), F.col("t"))
    return spark.range(1, 51).select(F.col("id").cast("int").alias("t")).select("t", F.round(F.aggregate(upto, start, step)["x"], 6).alias("x"))


@query("parabola_min", "WITH g AS (SELECT CAST(event_id // 500 AS BIGINT) AS x, round(avg(value), 6) AS y FROM events GROUP BY 1), n AS (SELECT x, y, lag(y) OVER (ORDER BY x) AS a, lead(y) OVER (ORDER BY x) AS b FROM g), m AS (SELECT * FROM n WHERE a IS NOT NULL AND b IS NOT NULL ORDER BY y, x LIMIT 1) SELECT x, round(x + 0.5 * (a - b) / (a - 2 * y + b), 4) AS vertex FROM m")
def parabola_min(spark, d):
    """The least point of a grid, refined by the parabola through its neighbours."""
    g = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 500).alias("x")).agg(F.round(F.avg("value"), 6).alias("y"))
    w = Window.orderBy("x")
    n = g.withColumns({"a": F.lag("y").over(w), "b": F.lead("y").over(w)}).where("a IS NOT NULL AND b IS NOT NULL").orderBy("y", "x").limit(1)
    return n.select("x", F.round(F.col("x") + 0.5 * (F.col("a") - F.col("b")) / (F.col("a") - 2 * F.col("y") + F.col("b")), 4).alias("vertex"))


BITS = "SELECT event_id, CASE WHEN value < 0 THEN 1 ELSE 0 END AS sign, CAST(floor(log2(abs(value))) AS INTEGER) + 15 AS exponent, CAST({round}((abs(value) / pow(2, floor(log2(abs(value)))) - 1) * 1024{zero}) AS INTEGER) AS mantissa FROM events WHERE abs(value) > 0.001"
both("float_format", "events", BITS.format(round="bround", zero=""), BITS.format(round="round_even", zero=", 0"))
both("accounting", "events", "SELECT d, v, 12 * d * d * 12 + v * d AS params, 16 * (12 * d * d * 12 + v * d) AS bytes_dp, round(16.0 * (12 * d * d * 12 + v * d) / 32 / 1e6, 4) AS mb_z3 FROM (SELECT 256 AS d, 8192 AS v UNION ALL SELECT 512, 8192 UNION ALL SELECT 768, 32000)",
     "SELECT d, v, 12 * d * d * 12 + v * d AS params, 16 * (12 * d * d * 12 + v * d) AS bytes_dp, round(16.0::DOUBLE * (12 * d * d * 12 + v * d) / 32 / 1e6, 4) AS mb_z3 FROM (SELECT 256 AS d, 8192 AS v UNION ALL SELECT 512, 8192 UNION ALL SELECT 768, 32000)")


@query("match_params", "WITH c AS (SELECT d * 16 AS width, l AS layers, abs(12 * d * 16 * d * 16 * l - 5000000) AS err FROM range(4, 65) AS a(d), range(2, 13) AS b(l)) SELECT CAST(layers AS INTEGER) AS layers, CAST(arg_min(width, err * 10000 + width) AS INTEGER) AS width FROM c GROUP BY layers")
def match_params(spark, d):
    """For each depth the width whose parameter count is nearest to five million."""
    g = spark.range(4, 65).select((F.col("id") * 16).alias("width")).crossJoin(spark.range(2, 13).select(F.col("id").alias("layers")))
    err = F.abs(12 * F.col("width") * F.col("width") * F.col("layers") - 5000000)
    return g.groupBy(F.col("layers").cast("int").alias("layers")).agg(F.min_by(F.col("width").cast("int"), F.struct(err, "width")).alias("width"))


ROUTE = "r AS (SELECT user_id AS tok, event_type AS expert, sum(value) AS score FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY tok ORDER BY score DESC, expert) AS rn FROM r), t AS (SELECT tok, expert, score, score / sum(score) OVER (PARTITION BY tok) AS w FROM k WHERE rn <= 2)"


def exact_sum(c: str):
    """The sum of doubles that have up to nine decimals, as decimals, so that no order of rows moves its last bit; of
    any other doubles, one too large or not finite included, their plain sum."""
    fits = F.col(c).try_cast("decimal(28,9)")
    all_fit = F.count(F.when(fits.cast("double") == F.col(c), 1)) == F.count(c)
    return F.when(all_fit, F.sum(fits).cast("double")).otherwise(F.sum(c))


def routed(spark, d, bias=None):
    """The two best experts of each token with renormalised weights; a bias steers the choice only.

    Scores are exact sums: experts of equal scores go by name, and a weight halfway between two roundings goes up,
    however the rows are dealt."""
    r = table(spark, d, "events").groupBy(F.col("user_id").alias("tok"), F.col("event_type").alias("expert")).agg(exact_sum("value").alias("score"))
    by = F.col("score") + (bias if bias is not None else F.lit(0.0))
    k = r.withColumn("rn", F.row_number().over(Window.partitionBy("tok").orderBy(by.desc(), "expert"))).where("rn <= 2")
    return k.withColumn("w", F.col("score") / F.sum("score").over(Window.partitionBy("tok")))


@query("topk_routing", f"WITH {ROUTE} SELECT tok, expert, round(w, 6) AS w FROM t")
def topk_routing(spark, d):
    return routed(spark, d).select("tok", "expert", F.round("w", 6).alias("w"))


@query("load_stats", f"WITH {ROUTE}, e AS (SELECT DISTINCT event_type AS expert FROM events), n AS (SELECT expert, count(tok) AS n FROM e LEFT JOIN t USING (expert) GROUP BY expert) SELECT round(max(n) / avg(n) - 1, 6) AS max_violation, count(*) FILTER (n = 0) AS dead, count(*) FILTER (n < 0.1 * (SELECT avg(n) FROM n)) AS starved FROM n")
def load_stats(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("expert")).distinct()
    n = e.join(routed(spark, d).groupBy("expert").agg(F.count("*").alias("n")), "expert", "left").na.fill(0, ["n"])
    mean = F.avg("n").over(Window.partitionBy())
    return n.withColumn("mean", mean).agg(F.round(F.max("n") / F.avg("n") - 1, 6).alias("max_violation"), F.count_if(F.col("n") == 0).alias("dead"), F.count_if(F.col("n") < 0.1 * F.col("mean")).alias("starved"))


@query("bias_routing", "WITH r AS (SELECT user_id AS tok, event_type AS expert, sum(value) AS score FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY tok ORDER BY score + CASE WHEN expert = 'click' THEN 200.0::DOUBLE ELSE 0.0::DOUBLE END DESC, expert) AS rn FROM r), n AS (SELECT expert, count(*) AS n FROM k WHERE rn <= 2 GROUP BY expert) SELECT expert, n, sign(avg(n) OVER () - n) AS update_ FROM n", )
def bias_routing(spark, d):
    bias = F.when(F.col("expert") == "click", 200.0).otherwise(0.0)
    n = routed(spark, d, bias).groupBy("expert").agg(F.count("*").alias("n"))
    return n.select("expert", "n", F.signum(F.avg("n").over(Window.partitionBy()) - F.col("n")).cast("tinyint").alias("update_"))


@query("gumbel_topk", "WITH g AS (SELECT doc_id, source, ln(n_chars::DOUBLE) - ln(-ln((('0x' || substr(md5('g' || doc_id), 1, 7))::BIGINT + 0.5::DOUBLE) / 268435456)) AS k FROM documents WHERE n_chars > 0) SELECT doc_id, source FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY k DESC, doc_id) <= 5")
def gumbel_topk(spark, d):
    """Five documents of each source without replacement, by length, with hash-made uniforms."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit("g"), "doc_id")), 1, 7), 16, 10).cast("long") + 0.5) / 268435456
    g = table(spark, d, "documents").where("n_chars > 0").select("doc_id", "source", (F.ln("n_chars") - F.ln(-F.ln(u))).alias("k"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.col("k").desc(), "doc_id"))).where("r <= 5").select("doc_id", "source")


COLOURS = [("ink", "1a1a2e"), ("sea", "2a9d8f"), ("sun", "e9c46a"), ("clay", "e76f51"), ("sky", "8ecae6")]
_C = ", ".join(f"({i}, '{n}', '{h}')" for i, (n, h) in enumerate(COLOURS))
LIN = "CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"


@query("palette_contrast", f"WITH c AS (SELECT i, name, ('0x' || substr(h, 1, 2))::INT / 255.0::DOUBLE AS r, ('0x' || substr(h, 3, 2))::INT / 255.0::DOUBLE AS g, ('0x' || substr(h, 5, 2))::INT / 255.0::DOUBLE AS b FROM (VALUES {_C}) AS t(i, name, h)), l AS (SELECT i, name, 0.2126::DOUBLE * {LIN.format(c='r')} + 0.7152::DOUBLE * {LIN.format(c='g')} + 0.0722::DOUBLE * {LIN.format(c='b')} AS y FROM c) SELECT a.name AS a, b.name AS b, round((greatest(a.y, b.y) + 0.05) / (least(a.y, b.y) + 0.05), 4) AS contrast FROM l a JOIN l b ON a.i < b.i")
def palette_contrast(spark, d):
    """Contrast of every two colours of a small palette."""
    c = spark.createDataFrame([(i, n, h) for i, (n, h) in enumerate(COLOURS)], "i int, name string, h string")
    ch = lambda at: F.conv(F.substring("h", at, 2), 16, 10).cast("int") / 255.0
    lin = lambda x: F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))
    y = c.select("i", "name", (0.2126 * lin(ch(1)) + 0.7152 * lin(ch(3)) + 0.0722 * lin(ch(5))).alias("y"))
    a, b = y.alias("a"), y.alias("b")
    return a.join(b, F.expr("a.i < b.i")).select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), F.round((F.greatest("a.y", "b.y") + 0.05) / (F.least("a.y", "b.y") + 0.05), 4).alias("contrast"))


both("keyword_facets", "documents", "SELECT lang, count(*) AS docs, sum(CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) AS hits FROM documents WHERE source IN ('src1', 'src2', 'src3') GROUP BY lang",
     "SELECT lang, count(*) AS docs, CAST(sum(CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM documents WHERE source IN ('src1', 'src2', 'src3') GROUP BY lang")


@query("gates", "WITH g AS (SELECT count(*) > 0 AS has_rows, count(DISTINCT event_type) = 5 AS five_types, min(value) >= 0 AS not_negative, max(user_id) < 100 AS few_users FROM events) SELECT name, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT unnest(['has_rows', 'five_types', 'not_negative', 'few_users']) AS name, unnest([has_rows, five_types, not_negative, few_users]) AS ok FROM g)")
def gates(spark, d):
    """Named booleans as PASS or FAIL, by unpivot."""
    g = table(spark, d, "events").agg((F.count("*") > 0).alias("has_rows"), (F.countDistinct("event_type") == 5).alias("five_types"), (F.min("value") >= 0).alias("not_negative"), (F.max("user_id") < 100).alias("few_users"))
    return g.unpivot([], ["has_rows", "five_types", "not_negative", "few_users"], "name", "ok").select("name", F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("verdict"))


both("load_windows", "events", "SELECT CAST(floor(event_id / 250) AS BIGINT) AS win, event_type, count(*) AS n FROM events GROUP BY CAST(floor(event_id / 250) AS BIGINT), event_type")
both("sequence_windows", "documents", "SELECT doc_id, CAST(n_chars AS BIGINT) AS n, CAST(floor(n_chars / 128) AS BIGINT) AS windows, n_chars - 128 * CAST(floor(n_chars / 128) AS BIGINT) AS tail FROM documents")
