"""Exact and near duplicates: copies, shingles, MinHash bands, greedy and component keeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import let, words
from millrace.sources.tables import cut

PRIME = (1 << 31) - 1


@dataclass(frozen=True)
class Lsh:
    words: int = 5
    bands: int = 16
    rows: int = 4

    def permutations(self) -> list[tuple[int, int]]:
        """Coefficients (a, b) of a*h + b modulo PRIME, by a linear congruential rule."""
        out, x = [], 4
        for _ in range(self.bands * self.rows):
            x = (x * 48271 + 11) % PRIME
            a = x or 1
            x = (x * 48271 + 11) % PRIME
            out.append((a, x))
        return out


def first_copies(df: DataFrame, text: str, order: str) -> DataFrame:
    """One row of each text: the first by order.  Digests go through the shuffle as the key."""
    digest = F.sha1(F.col(text))
    return df.withColumn("copy_", F.row_number().over(Window.partitionBy(digest).orderBy(order))).where("copy_ = 1").drop("copy_")


def hash28(x: Column) -> Column:
    """28 bits of md5, the same in any engine."""
    return F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long")


def shingle_hashes(text: Column, k: int) -> Column:
    """Distinct hashes of k words in a row; of the whole text if it has fewer."""
    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: hash28(F.array_join(F.slice(w, i, k), " ")))
        return F.array_distinct(F.when(F.size(w) >= k, many).otherwise(F.array(hash28(text))))

    return let(words(text), of)


def signatures(docs: DataFrame, p: Lsh) -> DataFrame:
    """(doc_id, s): the minima of every permutation over a document's shingles.

    One row a shingle and one generated loop of minima, which combine before the shuffle, instead of
    a lambda for each permutation and shingle."""
    rows = docs.select("doc_id", F.explode(shingle_hashes(F.col("text"), p.words)).alias("h"))
    least = [F.min((F.col("h") * a + b) % PRIME).alias(f"m{i}") for i, (a, b) in enumerate(p.permutations())]
    mins = rows.groupBy("doc_id").agg(*least)
    return mins.select("doc_id", F.array(*[f"m{i}" for i in range(len(least))]).alias("s"))


def band_keys(docs: DataFrame, p: Lsh = Lsh()) -> DataFrame:
    """(doc_id, band, key): the bands of every document's signature."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda b: F.array_join(F.slice("s", b * p.rows + 1, p.rows), "-"))
    return signatures(docs, p).select("doc_id", F.posexplode(keys).alias("band", "key"))


def text_classes(docs: DataFrame, *extra: Column) -> DataFrame:
    """(doc_id, copies, ...) of the first document of each text, by doc_id; extra aggregates see all its copies."""
    return docs.groupBy(F.sha1("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *extra).drop("digest")


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """(a, b), a < b, of documents that share a band.  For keys of one document of each text: copies
    would be expanded into all their pairs."""
    x, y = keys.alias("x"), keys.alias("y")
    met = x.join(y, F.expr("x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id"))
    return met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()


def later_members(keys: DataFrame) -> DataFrame:
    """doc_ids that share a band with an earlier document: those that aren't the first of each of their bands."""
    first = keys.groupBy("band", "key").agg(F.min("doc_id").alias("first"))
    return keys.join(first, ["band", "key"]).where("doc_id > first").select("doc_id").distinct()


def greedy_duplicates(keys: DataFrame) -> DataFrame:
    """doc_ids that a scan by doc_id drops: those that share a band with an earlier kept one.

    Each round keeps the documents that come first in all their bands and drops all others of these
    bands; both leave.  Rounds go on until none is left, as many as the longest chain of partners asks
    for; what a round leaves and what it drops are written, so that plans stay short."""
    shared = keys.groupBy("band", "key").count().where("count > 1").select("band", "key")
    left, dropped = cut(keys.join(shared, ["band", "key"]).select("doc_id", "band", "key"), "bands"), None
    while not left.isEmpty():
        led = left.join(left.groupBy("band", "key").agg(F.min("doc_id").alias("first")), ["band", "key"])
        kept = led.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") == F.col("first")).alias("leads")).where("leads").select(F.col("doc_id").alias("first"))
        gone = cut(led.where("doc_id <> first").join(kept, "first").select("doc_id").distinct(), "gone")
        dropped = gone if dropped is None else dropped.union(gone)
        settled = gone.union(kept.select(F.col("first").alias("doc_id")))
        left = cut(left.join(settled, "doc_id", "left_anti"), "bands")
    return dropped if dropped is not None else keys.sparkSession.createDataFrame([], "doc_id long")


def component_duplicates(keys: DataFrame) -> DataFrame:
    """doc_ids that are not the least of their component of documents that share bands.

    A band's members are linked to its first.  Every document takes the least name among its own and its
    neighbours', then that name's own name, until no name changes."""
    first = keys.groupBy("band", "key").agg(F.min("doc_id").alias("b"))
    pairs = keys.join(first, ["band", "key"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    both = cut(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    names = cut(both.groupBy(F.col("a").alias("doc_id")).agg(F.least("doc_id", F.min("b")).alias("name")), "names")
    while True:
        of = names.select(F.col("doc_id").alias("b"), F.col("name").alias("m"))
        near = both.join(of, "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("m").alias("m"))
        least = names.join(near, "doc_id").select("doc_id", "name", F.least("name", "m").alias("m"))
        jump = names.select(F.col("doc_id").alias("m"), F.col("name").alias("next"))
        after = cut(least.join(jump, "m").select("doc_id", F.col("name").alias("was"), F.least("m", "next").alias("name")), "names")
        names = after.select("doc_id", "name")
        if after.where("name <> was").isEmpty():
            return names.where("doc_id <> name").select("doc_id")


def duplicate_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds the first row's id among those of equal key, or null for the first itself."""
    first = F.first(order).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("duplicate_of", F.when(first != F.col(order), first))
