"""Queries of string codes, collisions and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import codecs as O
from millrace.operators.runs import numbered
from millrace.plans.base import query
from millrace.session import importable
from millrace.sources.tables import table

W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
TOKENS = f"t AS (SELECT token, count(*) AS n FROM (SELECT unnest({W}) AS token FROM documents) GROUP BY token)"
COS = "(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))))"


def tokens(spark, d):
    return table(spark, d, "documents").select(F.explode(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def unit_vectors(spark, d, every: int = 1):
    v = table(spark, d, "embeddings").where(F.col("vec_id") % every == 0)
    return v.select("vec_id", "label", O.unit("embedding").alias("u"))


@query("collision_census", f"WITH {TOKENS}, k AS (SELECT hex(encode(token)[1:6]) AS key, token FROM t) SELECT key, count(*) AS n, min(token) AS least FROM k GROUP BY key HAVING count(*) > 1")
def collision_census(spark, d):
    """Tokens that a code cropping at 6 bytes can't tell apart."""
    return O.collisions(tokens(spark, d).select("token"), 6)


@query("collision_by_length", f"WITH {TOKENS}, p AS (SELECT unnest([4, 6, 8, 12]) AS len_), k AS (SELECT len_, hex(encode(token)[1:len_]) AS key, count(*) AS n FROM t, p GROUP BY ALL) SELECT CAST(len_ AS INTEGER) AS len_, count(*) FILTER (n > 1) AS groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS tokens FROM k GROUP BY len_")
def collision_by_length(spark, d):
    t = tokens(spark, d).select(F.explode(F.array(*[F.lit(x) for x in (4, 6, 8, 12)])).alias("len_"), "token")
    k = t.groupBy("len_", F.substring(F.encode("token", "UTF-8"), F.lit(1), F.col("len_")).alias("key")).agg(F.count("*").alias("n"))
    return k.groupBy("len_").agg(F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("tokens"))


@query("length_coverage", f"WITH {TOKENS} SELECT CASE WHEN strlen(token) <= 4 THEN 'a:<=4' WHEN strlen(token) <= 8 THEN 'b:<=8' WHEN strlen(token) <= 16 THEN 'c:<=16' ELSE 'd:>16' END AS bucket, count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens FROM t GROUP BY 1")
def length_coverage(spark, d):
    b = F.octet_length("token")
    bucket = F.when(b <= 4, "a:<=4").when(b <= 8, "b:<=8").when(b <= 16, "c:<=16").otherwise("d:>16")
    return tokens(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))


@query("max_cosine", f"SELECT round(max({COS}), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE a.label = b.label")
def max_cosine(spark, d):
    """The largest cosine of two vectors of a label, block by block."""
    return O.extreme_cosines(unit_vectors(spark, d)).select(F.round("most_same", 6).alias("cosine"))


@query("max_cosine_all", f"SELECT round(max({COS}), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def max_cosine_all(spark, d):
    """The largest cosine of any two vectors, block by block."""
    return O.extreme_cosines(unit_vectors(spark, d)).select(F.round("most", 6).alias("cosine"))


@query("nearest_neighbor", f"SELECT a.vec_id AS query_id, arg_max(b.vec_id, {COS}) AS nearest, round(max({COS}), 4) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id")
def nearest_neighbor(spark, d):
    """The stated query set (ids divisible by 20) against all rows, block by block."""
    found = O.nearest(unit_vectors(spark, d, 20), unit_vectors(spark, d), "u")
    return found.select("query_id", "nearest", F.round("value", 4).alias("cosine"))


@query("nearest_label_rate", "WITH p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), m AS (SELECT vec_id, any_value(la) AS la, arg_min(lb, dist) AS lb FROM p GROUP BY vec_id) SELECT count(*) AS queries, count(*) FILTER (la = lb) AS same_label FROM m")
def nearest_label_rate(spark, d):
    """How many vectors have another one to ask (each has, unless it is alone), and how many the label of their nearest."""
    m = O.nearest_labels(table(spark, d, "embeddings"), "embedding")
    return m.agg(F.when(F.count("*") > 1, F.count("*")).otherwise(F.lit(0)).alias("queries"), F.count_if(F.col("label") == F.col("nearest_label")).alias("same_label"))


@query("family_distance", f"SELECT a.label = b.label AS same, count(*) AS pairs, round(avg({COS}), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id GROUP BY 1")
def family_distance(spark, d):
    """Mean cosine within and across labels, over all pairs, from sums of unit vectors and no pairs.

    The cosines of all pairs of a set add up to half of |sum|^2 less the number of vectors.  Pairs
    with a label that is null are a group by themselves."""
    part = unit_vectors(spark, d).select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    known, square = F.col("label").isNotNull(), lambda c: F.sum(F.col(c) * F.col(c))
    by_label = part.groupBy("label").agg(square("s").alias("q"), F.max("n").alias("n"))
    own = by_label.agg(
        F.sum(F.when(known, F.col("q") - F.col("n")) / 2).alias("c_in"), F.sum(F.when(known, F.expr("n * (n - 1) div 2"))).alias("p_in"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_known"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"),
    )
    sums = part.groupBy("i").agg(F.sum("s").alias("all"), F.sum(F.when(known, F.col("s"))).alias("known"))
    total = own.crossJoin(sums.agg(square("all").alias("q_all"), square("known").alias("q_known")))
    cosine = lambda k: (F.col(f"q_{k}") - F.col(f"n_{k}")) / 2
    count = lambda k: F.expr(f"n_{k} * (n_{k} - 1) div 2")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = [(True, F.col("p_in"), F.col("c_in")), (False, count("known") - F.col("p_in"), cosine("known") - F.col("c_in")), (None, count("all") - zero(count("known")), cosine("all") - zero(cosine("known")))]
    row = F.explode(F.array(*[F.struct(F.lit(k).cast("boolean").alias("same"), p.cast("long").alias("pairs"), c.cast("double").alias("c")) for k, p, c in rows])).alias("r")
    return total.select(row).where("r.pairs > 0").select("r.same", "r.pairs", F.round(F.col("r.c") / F.col("r.pairs"), 6).alias("cosine"))


@query("kronecker_codes")
def kronecker_codes(spark, d):
    """Codes of the vocabulary; floating sums in NumPy's order, so rows only."""
    importable(spark)
    c = O.coded(tokens(spark, d).select("token"), O.ByteCodec())
    return c.select("token", F.size("code").alias("dims"), F.round(F.element_at("code", 1), 6).alias("first"))


@query("phase_codes")
def phase_codes(spark, d):
    importable(spark)
    c = O.coded(tokens(spark, d).select("token"), O.PhaseCodec(64))
    return c.select("token", F.size("code").alias("dims"), F.round(F.element_at("code", 1), 6).alias("first"))


@query("byte_fallback", r"SELECT item_id, lower(hex(CASE WHEN item_id % 2 = 0 THEN unhex(printf('%02X', item_id % 256)) ELSE encode('t' || item_id) END)) AS bytes FROM benchmark")
def byte_fallback(spark, d):
    t = F.when(F.col("item_id") % 2 == 0, F.format_string("<0x%02X>", F.col("item_id") % 256)).otherwise(F.concat(F.lit("t"), "item_id"))
    return table(spark, d, "benchmark").select("item_id", F.lower(F.hex(O.token_bytes(t))).alias("bytes"))


@query("zipf_bands", f"WITH {TOKENS}, r AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS rank FROM t) SELECT CASE WHEN rank <= 100 THEN 'head' WHEN rank <= 1000 THEN 'torso' ELSE 'tail' END AS band, count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens, round(sum(1.0 / rank), 6) AS weight FROM r GROUP BY 1")
def zipf_bands(spark, d):
    """Bands by rank in the order of counts."""
    t = tokens(spark, d)
    r = numbered(t, [], [F.col("n").desc(), F.col("token")], "rank")
    band = F.when(F.col("rank") <= 100, "head").when(F.col("rank") <= 1000, "torso").otherwise("tail")
    return r.groupBy(band.alias("band")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), F.round(F.sum(1.0 / F.col("rank")), 6).alias("weight"))


@query("majority_ceiling", "WITH c AS (SELECT substr(text, 1, 1) AS g, lang, count(*) AS n FROM documents GROUP BY ALL), m AS (SELECT g, max(n) AS best, sum(n) AS total FROM c GROUP BY g) SELECT round(sum(best)::DOUBLE / sum(total), 6) AS ceiling_ FROM m")
def majority_ceiling(spark, d):
    """How often the majority language of a first letter is right."""
    c = table(spark, d, "documents").groupBy(F.substring("text", 1, 1).alias("g"), "lang").agg(F.count("*").alias("n"))
    m = c.groupBy("g").agg(F.max("n").alias("best"), F.sum("n").alias("total"))
    return m.agg(F.round(F.sum("best") / F.sum("total"), 6).alias("ceiling_"))


@query("special_tokens", f"WITH {TOKENS} SELECT CASE WHEN regexp_matches(token, '^<.*>$') THEN 'special' WHEN regexp_matches(token, '^[^\\p{{L}}\\p{{N}}]+$') THEN 'punctuation' ELSE 'word' END AS kind, count(*) AS types FROM t GROUP BY 1")
def special_tokens(spark, d):
    kind = F.when(F.col("token").rlike("^<.*>$"), "special").when(F.col("token").rlike(r"^[^\p{L}\p{N}]+$"), "punctuation").otherwise("word")
    return tokens(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("types"))


@query("pca_2d")
def pca_2d(spark, d):
    """Two principal components; signs are a solver's choice, so rows only."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    got = PCA(k=2, inputCol="x", outputCol="p").fit(v).transform(v)
    return got.select("vec_id", F.round(F.abs(vector_to_array("p")[0]), 4).alias("x"), F.round(F.abs(vector_to_array("p")[1]), 4).alias("y"))


@query("synthetic_rings", "SELECT CAST(i AS BIGINT) AS id, CAST(i % 2 AS INTEGER) AS label, round((1 + i % 2) * cos(2 * pi() * i / 100), 6) AS x, round((1 + i % 2) * sin(2 * pi() * i / 100), 6) AS y FROM range(0, 200) AS r(i)")
def synthetic_rings(spark, d):
    r, a = 1 + F.col("id") % 2, 2 * F.pi() * F.col("id") / 100
    return spark.range(200).select("id", (F.col("id") % 2).cast("int").alias("label"), F.round(r * F.cos(a), 6).alias("x"), F.round(r * F.sin(a), 6).alias("y"))
