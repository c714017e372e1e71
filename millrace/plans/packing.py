"""Queries of units, placements, masks and batch plans; words stand in for tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import packing as O
from millrace.plans.base import query
from millrace.sources.tables import table

NW = r"CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS BIGINT)"
UNITS = f"u AS (SELECT doc_id // 8 AS seq, doc_id AS unit, {NW} AS n FROM documents)"
TURN = f"t AS (SELECT conv_id AS sample, turn, role = 'assistant' AS is_target, {NW} AS n FROM conversations)"
TOKENS = f"""{TURN}, o AS (SELECT *, CAST(sum(n) OVER (PARTITION BY sample ORDER BY turn) AS BIGINT) AS e, CAST(sum(n) OVER (PARTITION BY sample) AS BIGINT) AS total FROM t),
i AS (SELECT *, unnest(range(e - n, CASE WHEN e = total THEN (e + 255) // 256 * 256 ELSE e END)) AS i FROM o WHERE n > 0),
k AS (SELECT sample * 16777216 + i // 256 AS seq, i % 256 AS pos, CASE WHEN i < e THEN CAST(turn // 2 AS BIGINT) ELSE -1 END AS segment_id, is_target AND i < e AS is_target FROM i),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY seq, segment_id ORDER BY pos) - 1 AS INTEGER) AS position_id,
  coalesce(lead(is_target) OVER (PARTITION BY seq ORDER BY pos) AND lead(segment_id) OVER (PARTITION BY seq ORDER BY pos) = segment_id AND segment_id >= 0, false) AS loss_mask FROM k)"""
#: Words of a sequence; and the bits of seq that number the windows of one conversation.
WINDOW, WINDOW_BITS = 256, 24


def n_words(text="text"):
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def units(spark, d):
    return table(spark, d, "documents").select(F.floor(F.col("doc_id") / 8).alias("seq"), F.col("doc_id").alias("unit"), n_words().alias("n"))


def turns(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("sample"), "turn", (F.col("role") == "assistant").alias("is_target"), n_words().alias("n"))


def token_rows(spark, d):
    """Every word of each conversation in consecutive windows of WINDOW positions, each a sequence of its own.

    seq holds the conversation in its upper bits and the window in its lower ones.  Segments are exchanges (two
    turns); one that crosses windows goes on in the next.  Only what the last window lacks is padding."""
    from pyspark.sql import Window

    sample, i, e = Window.partitionBy("sample"), F.col("i"), F.col("e")
    o = turns(spark, d).withColumns({"e": F.sum("n").over(sample.orderBy("turn")), "total": F.sum("n").over(sample)}).where("n > 0")
    last = F.when(e == F.col("total"), F.ceil(e / WINDOW) * WINDOW).otherwise(e) - 1
    at = o.select("sample", "turn", "is_target", "e", F.explode(F.sequence(e - F.col("n"), last)).alias("i"))
    window = F.floor(i / WINDOW)
    return at.select(
        (F.shiftleft("sample", WINDOW_BITS) + window).alias("seq"), (i - window * WINDOW).alias("pos"),
        F.when(i < e, F.floor(F.col("turn") / 2)).otherwise(-1).cast("long").alias("segment_id"), (F.col("is_target") & (i < e)).alias("is_target"),
    )


@query("pack_windows", f"WITH s AS (SELECT source AS shard, CAST(sum({NW}) AS BIGINT) AS n FROM documents GROUP BY source), x AS (SELECT shard, i * 256 AS a, least(n, i * 256 + 256) AS b FROM s, range(0, 100000) AS r(i) WHERE i * 256 < n) SELECT shard, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM x WHERE b - a >= 32")
def pack_windows(spark, d):
    s = table(spark, d, "documents").groupBy(F.col("source").alias("shard")).agg(F.sum(n_words()).alias("n_tokens"))
    return O.window_units(s, 256)


@query("pack_turn_units", f"WITH {TURN}, o AS (SELECT *, CAST(sum(n) OVER (PARTITION BY sample ORDER BY turn) AS BIGINT) AS e FROM t), c AS (SELECT sample, turn, e - n AS s, least(e, e - n + 64) AS stop FROM o WHERE is_target) SELECT sample, turn, greatest(0, s - (64 - (stop - s))) AS a, stop AS b FROM c WHERE stop - greatest(0, s - (64 - (stop - s))) >= 8")
def pack_turn_units(spark, d):
    return O.turn_units(turns(spark, d), 64)


@query("pack_placements", f"WITH {UNITS}, e AS (SELECT *, CAST(sum(n) OVER (PARTITION BY seq ORDER BY unit) AS BIGINT) AS e FROM u) SELECT CAST(seq AS BIGINT) AS seq, unit, CAST(row_number() OVER (PARTITION BY seq ORDER BY unit) - 1 AS INTEGER) AS segment_id, e - n AS dst_a, least(e, 1024) AS dst_b FROM e WHERE e - n < 1024")
def pack_placements(spark, d):
    return O.policy("concat_chop")(units(spark, d), 1024)


def fold(order: str) -> str:
    return f"""WITH RECURSIVE {UNITS}, r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY {order}) AS k FROM u),
f AS (SELECT seq, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS cnt, CAST(NULL AS BIGINT) AS unit, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM (SELECT DISTINCT seq FROM u)
 UNION ALL SELECT f.seq, r.k, CASE WHEN f.used + r.n <= 1024 AND f.cnt < 8 THEN f.used + r.n ELSE f.used END, CASE WHEN f.used + r.n <= 1024 AND f.cnt < 8 THEN f.cnt + 1 ELSE f.cnt END,
  CASE WHEN f.used + r.n <= 1024 AND f.cnt < 8 THEN r.unit END, f.used, f.used + r.n FROM f JOIN r ON r.seq = f.seq AND r.k = f.k + 1)
SELECT CAST(seq AS BIGINT) AS seq, CAST(cnt - 1 AS INTEGER) AS segment_id, unit, a AS dst_a, b AS dst_b FROM f WHERE unit IS NOT NULL"""


@query("pack_structure_preserving", fold("unit"))
def pack_structure_preserving(spark, d):
    return O.policy("structure_preserving")(units(spark, d), 1024)


@query("pack_best_fit", fold("n DESC, unit"))
def pack_best_fit(spark, d):
    return O.policy("best_fit")(units(spark, d), 1024)


@query("pack_positions", f"WITH {TOKENS} SELECT seq, pos, segment_id, position_id FROM p")
def pack_positions(spark, d):
    return O.positions(token_rows(spark, d)).select("seq", "pos", "segment_id", "position_id")


@query("loss_mask", f"WITH {TOKENS} SELECT seq, count(*) AS positions, count(*) FILTER (loss_mask) AS loss_bearing, CAST(sum(CASE WHEN loss_mask THEN pos ELSE 0 END) AS BIGINT) AS checksum FROM p GROUP BY seq")
def loss_mask(spark, d):
    p = O.positions(token_rows(spark, d))
    return p.groupBy("seq").agg(F.count("*").alias("positions"), F.count_if("loss_mask").alias("loss_bearing"), F.sum(F.when(F.col("loss_mask"), F.col("pos")).otherwise(0)).alias("checksum"))


@query("mask_audit", f"WITH {TOKENS} SELECT count(*) FILTER (loss_mask AND segment_id < 0) AS on_padding, count(*) FILTER (position_id < 0) AS bad_positions, count(*) FILTER (loss_mask AND nt IS DISTINCT FROM true) AS not_target, count(*) FILTER (loss_mask AND ns <> segment_id) AS across, count(*) FILTER (loss_mask AND ns IS NULL) AS at_end FROM (SELECT *, lead(is_target) OVER (PARTITION BY seq ORDER BY pos) AS nt, lead(segment_id) OVER (PARTITION BY seq ORDER BY pos) AS ns FROM p)")
def mask_audit(spark, d):
    """Five counts that must be 0."""
    from pyspark.sql import Window

    w = Window.partitionBy("seq").orderBy("pos")
    p = O.positions(token_rows(spark, d)).withColumns({"nt": F.lead("is_target").over(w), "ns": F.lead("segment_id").over(w)})
    m = F.col("loss_mask")
    return p.agg(
        F.count_if(m & (F.col("segment_id") < 0)).alias("on_padding"), F.count_if(F.col("position_id") < 0).alias("bad_positions"), F.count_if(m & ~F.coalesce("nt", F.lit(False))).alias("not_target"),
        F.count_if(m & (F.col("ns") != F.col("segment_id"))).alias("across"), F.count_if(m & F.col("ns").isNull()).alias("at_end"),
    )


@query("attention_pairs", f"WITH {TOKENS} SELECT seq, CAST(sum(n * (n + 1) // 2) AS BIGINT) AS visible FROM (SELECT seq, segment_id, count(*) AS n FROM p WHERE segment_id >= 0 GROUP BY ALL) GROUP BY seq")
def attention_pairs(spark, d):
    return O.visible_pairs(token_rows(spark, d))


@query("batch_stats", f"WITH {TOKENS} SELECT count(*) AS positions, count(*) FILTER (segment_id < 0) AS pad_positions, count(*) FILTER (segment_id >= 0) AS used_positions, count(*) FILTER (loss_mask) AS loss_bearing, count(*) FILTER (segment_id >= 0 AND NOT loss_mask) AS context_positions, round(count(*) FILTER (segment_id >= 0)::DOUBLE / count(*), 6) AS utilization, count(DISTINCT CASE WHEN segment_id >= 0 THEN seq || '/' || segment_id END) AS segments FROM p")
def batch_stats(spark, d):
    return O.batch_stats(O.positions(token_rows(spark, d)))


@query("batch_hash", f"WITH {UNITS} SELECT CAST(seq AS BIGINT) AS seq, sha256(string_agg(unit || ':' || n, ',' ORDER BY unit)) AS batch_hash FROM u GROUP BY seq")
def batch_hash(spark, d):
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit", "n"))), lambda s: F.concat_ws(":", s["unit"].cast("string"), s["n"].cast("string"))), ",")
    return units(spark, d).groupBy("seq").agg(F.sha2(listed, 256).alias("batch_hash"))


@query("policy_comparison", rf"WITH {UNITS}, e AS (SELECT *, sum(n) OVER (PARTITION BY seq ORDER BY unit) AS e FROM u) SELECT 'concat_chop' AS policy, count(*) AS placements, CAST(sum(least(e, 1024) - (e - n)) AS BIGINT) AS used FROM e WHERE e - n < 1024")
def policy_comparison(spark, d):
    return O.policy("concat_chop")(units(spark, d), 1024).agg(F.count("*").alias("placements"), F.sum(F.col("dst_b") - F.col("dst_a")).alias("used")).select(F.lit("concat_chop").alias("policy"), "placements", "used")


def _grid(name: str) -> str:
    if name in ("structure_preserving", "greedy", "best_fit"):
        return f"SELECT '{name}' AS policy, count(*) AS placements, CAST(coalesce(sum(dst_b - dst_a), 0) AS BIGINT) AS used FROM ({fold('n DESC, unit' if name == 'best_fit' else 'unit')})"
    only = "" if name == "concat_chop" else "WHERE unit % 8 = 0"
    return f"SELECT '{name}', count(*), CAST(coalesce(sum(least(e, 1024) - (e - n)), 0) AS BIGINT) FROM (WITH {UNITS} SELECT *, sum(n) OVER (PARTITION BY seq ORDER BY unit) AS e FROM u {only}) WHERE e - n < 1024"


GRID = sorted(set(O.POLICIES.values()) | {"pad_only", "greedy"})


@query("policy_grid", " UNION ALL ".join(_grid(name) for name in GRID))
def policy_grid(spark, d):
    """Every policy over the same units."""
    u, out = units(spark, d), None
    for name in GRID:
        one = O.policy(name)(u, 1024).agg(F.count("*").alias("placements"), F.coalesce(F.sum(F.col("dst_b") - F.col("dst_a")), F.lit(0)).alias("used")).select(F.lit(name).alias("policy"), "placements", "used")
        out = one if out is None else out.unionByName(one)
    return out


@query("plan_batch", "WITH s AS (SELECT step, lane, slot FROM range(0, 40) AS a(step), (VALUES ('code', 3), ('general_web', 4), ('indic', 1)) AS q(lane, k), range(0, 4) AS b(slot) WHERE slot < k), o AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY lane, slot) - 1 AS i FROM s) SELECT CAST(step AS INTEGER) AS step, lane, CAST(slot AS INTEGER) AS slot, CAST(i // 2 AS INTEGER) AS microbatch, CAST((i // 2) % 2 AS INTEGER) AS rank, c AS cand, CAST(('0x' || substr(md5(concat_ws('|', 'b0', step, lane, slot, c)), 1, 7))::BIGINT % 1000 AS INTEGER) AS unit_no FROM o, (VALUES (0), (1)) AS t(c)")
def plan_batch(spark, d):
    """Slots of a step by lane, dealt to microbatches and ranks; candidates by a hash of their place."""
    from pyspark.sql import Window

    q = spark.createDataFrame([("code", 3), ("general_web", 4), ("indic", 1)], "lane string, k int")
    s = spark.range(40).select(F.col("id").cast("int").alias("step")).crossJoin(q).withColumn("slot", F.explode(F.expr("sequence(0, k - 1)")))
    i = F.row_number().over(Window.partitionBy("step").orderBy("lane", "slot")) - 1
    o = s.withColumn("i", i).withColumn("cand", F.explode(F.array(F.lit(0), F.lit(1))))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("b0"), "step", "lane", "slot", "cand")), 1, 7), 16, 10).cast("long") % 1000
    return o.select("step", "lane", "slot", F.expr("CAST(i div 2 AS INT)").alias("microbatch"), F.expr("CAST((i div 2) % 2 AS INT)").alias("rank"), "cand", draw.cast("int").alias("unit_no"))
