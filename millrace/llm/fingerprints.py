"""Quartile bucket digests of documents, and a bounded score of how alike two are.

Byte triplets are hashed into buckets and counted.  Each bucket's count is written
as the quartile that it falls in among the document's own buckets, in two bits; the
logarithm of the length goes before.  Equal texts have equal digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import python_batches, range_id, ranges
from millrace.llm.kernels import slices, texts

BUCKETS = 256
#: Steps of log-length that count as a whole difference, and the length's share of the score.
LENGTH_SPAN, LENGTH_SHARE = 32, 0.1


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, how many of its byte triplets hash into each bucket; one or two bytes count as a triplet that ends
    in zero bytes."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.int64)
    for a, b, piece, at in slices(data, offsets):
        if len(piece) < 3:
            continue
        x = piece.astype(np.uint32)
        h = ((x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(24)
        doc = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(at))
        whole = doc[:-2] == doc[2:]
        out[a:b] = np.bincount(doc[:-2][whole] * BUCKETS + h[whole], minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)
    size = np.diff(offsets)
    short = np.flatnonzero((size == 1) | (size == 2))
    if len(short):
        at = offsets[short]
        second = np.where(size[short] == 2, data[np.minimum(at + 1, len(data) - 1)], 0).astype(np.uint32)
        h = ((data[at].astype(np.uint32) << np.uint32(16) | second << np.uint32(8)) * np.uint32(0x9E3779B1)) >> np.uint32(24)
        out[short, h] = 1
    return out


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of bytes for each text: its length's logarithm, then two bits for each bucket.

    A bucket's code is how many of the three quartiles of the text's counts it exceeds.
    An empty text's codes are 0."""
    table = counts(data, offsets)
    ordered = np.sort(table, axis=1)
    quartiles = ordered[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (table[:, :, None] > quartiles[:, None, :]).sum(axis=2).astype(np.uint8)
    four = codes.reshape(len(table), BUCKETS // 4, 4)
    length = np.minimum(np.round(8 * np.log2(np.diff(offsets) + 1)), 255).astype(np.uint8)
    return np.concatenate([length[:, None], four[:, :, 0] << 6 | four[:, :, 1] << 4 | four[:, :, 2] << 2 | four[:, :, 3]], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, down to 0, row by row.

    Codes differ by 0 to 3 each; two unrelated texts' codes differ by 1.25 on average, and
    from there on the likeness is 0.  Lengths count up to LENGTH_SPAN steps.  Texts of up to three
    bytes have one triplet or none, which no average says anything about: two such are alike, 1, if
    their digests are equal, and not at all, 0, otherwise."""
    shifts = np.array([6, 4, 2, 0], np.uint8)
    x, y = (((d[:, 1:, None] >> shifts) & 3).astype(np.int16) for d in (a, b))
    apart = np.abs(x - y).reshape(len(a), -1).mean(axis=1) / 1.25
    length = np.minimum(np.abs(a[:, 0].astype(np.int16) - b[:, 0]) / LENGTH_SPAN, 1)
    score = np.round(1 - np.minimum((1 - LENGTH_SHARE) * apart + LENGTH_SHARE * length, 1), 6)
    few = np.maximum(a[:, 0], b[:, 0]) <= 16  # 8 log2(3 + 1)
    return np.where(few, (a == b).all(axis=1).astype(float), score)


def fingerprint(texts_column: pa.Array) -> np.ndarray:
    return digests(*texts(texts_column))


def hexed(rows: np.ndarray) -> list[str]:
    width = rows.shape[1]
    raw = np.ascontiguousarray(rows).tobytes().hex()
    return [raw[i:i + 2 * width] for i in range(0, len(raw), 2 * width)]


def with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(part, guard, doc_id, text) with every document right before its next by descending doc_id.

    Ranges of doc_id are dealt to tasks; each ends with a guard row, a copy of the first
    document of the range after it (after the last range: of the first).  Documents with
    equal doc_id are ordered by text; those without one come last."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    splits = ranges(rows, "doc_id", parts)
    rows = rows.withColumn("part", (F.lit(len(splits)) - range_id("doc_id", splits)).cast("int"))
    # a row for each range: its greatest doc_id, and of the documents that have it the least text
    tops = rows.groupBy("part").agg(F.max("doc_id").alias("top")).toPandas().sort_values("part")
    used = [int(p) for p in tops["part"]]
    if not used:
        return rows.withColumn("guard", F.lit(0))
    before = {p: used[i - 1] for i, p in enumerate(used)}  # the first range's is the last range
    ids = [int(t) for t in tops["top"].dropna()]
    tied = rows.where(F.col("doc_id").isin(ids)).groupBy("doc_id", "part").agg(F.min("text").alias("text"))
    if len(ids) < len(used):  # only documents without doc_id in the last range
        tied = tied.unionByName(rows.where(F.col("doc_id").isNull()).groupBy("doc_id", "part").agg(F.min("text").alias("text")))
    earlier = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part"))
    guards = tied.select("doc_id", "text", earlier.cast("int").alias("part"), F.lit(1).alias("guard"))
    both = rows.withColumn("guard", F.lit(0)).unionByName(guards)
    return both.repartitionById(parts, "part").sortWithinPartitions("part", "guard", F.col("doc_id").desc_nulls_last(), "text")


def compare(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Digests of every document, of its edited text, and their likenesses.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.  The edited text has the last third replaced by the start of the next
    document (descending doc_id, ties by text; after the last, the first; a lone document is
    its own next).  Null texts are empty; empty texts have equal digests; long texts count whole; rows
    that repeat are documents of their own; an empty table gives no rows; other columns, whatever
    their names, are ignored."""
    import hashlib

    python_batches(spark)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def made(rows: pa.Table) -> pa.RecordBatch | None:
            """For every row but the last, which it only looks at; guards give nothing."""
            text = rows.column("text").to_pylist()
            guard = rows.column("guard").to_pylist()
            own = [i for i in range(len(text) - 1) if not guard[i]]
            if not own:
                return None
            edited = []
            for i in own:
                third = len(text[i]) // 3
                edited.append(text[i][:len(text[i]) - third] + text[i + 1][:third])
            d = fingerprint(pa.array(text, pa.large_string()))
            e = fingerprint(pa.array(edited, pa.large_string()))
            at = np.array(own)
            columns = [
                rows.column("doc_id").combine_chunks().take(pa.array(at)), pa.array([len(text[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]), pa.array(hexed(d[at])), pa.array(hexed(e)),
                pa.array(likeness(d[at], e)), pa.array(likeness(d[at], d[at + 1])),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            got = made(rows)
            if got is not None:
                yield got
            held = rows.slice(rows.num_rows - 1)

    return with_next(spark, docs).select("guard", "doc_id", "text").mapInArrow(
        one, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
