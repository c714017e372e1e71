"""Exact top-k by inner product, score at a time over an impact-ordered index.

The vectors of a block are held as postings: for each dimension and sign, segments of
vectors of about equal magnitude there, the quantised impact.  A query takes the
segments by descending greatest contribution and adds them to its accumulators, one for
the score and one for the part of a vector's norm that has been read.  What a vector can
still gain or lose is bounded by the norms of what is left of it and of the query; the
query stops only when these bounds prove that all but a few vectors can't be among the
best.  Those few are scored again, exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize, python_batches

#: Vectors of an index block and queries of a query block; levels of impact; segments that are added between two
#: attempts at a proof; the share of a block (1 / FEW) that a proof must leave at most.
BLOCK, QUERY_BLOCK, LEVELS, PROVE_EVERY, FEW = 32768, 256, 2, 32, 16
SCALE = 256
LONG = (1 << 63) - 1


def whole(x: float) -> int:
    """floor(256 x) of a finite x, exactly."""
    return int(x) * SCALE if abs(x) > 2.0**53 else math.floor(x * SCALE)


def wide_key(score: int) -> bytes:
    """Bytes that sort as the scores beyond a long do; empty for the others."""
    if -LONG - 1 <= score <= LONG:
        return b""
    n = (abs(score).bit_length() + 7) // 8
    size = abs(score).to_bytes(n, "big")
    return (0x8000 + n).to_bytes(2, "big") + size if score > 0 else (0x8000 - n).to_bytes(2, "big") + bytes(255 - b for b in size)


class Index:
    """Postings of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.raw = ids[order], vectors[order]
        with np.errstate(over="ignore"):
            self.vectors = np.floor(self.raw * SCALE)
        n, self.dims = self.vectors.shape
        size = np.abs(self.vectors)
        self.largest = size.max(axis=1, initial=0)
        with np.errstate(over="ignore", invalid="ignore"):
            self.squares = (self.vectors * self.vectors).sum(axis=1)
        usual = np.isfinite(self.squares)
        #: rows beyond what doubles can bound are members of every result until they are scored exactly
        self.beyond = np.flatnonzero(~usual)
        top = size[usual].max(initial=0.0) + 1
        dim, low, high, rows, values = [], [], [], [], []
        for d in range(self.dims):
            column = np.where(usual, self.vectors[:, d], 0)
            level = (np.sign(column) * (np.floor(np.abs(column) * (LEVELS / top)) + 1)).astype(np.int8)
            by_level = np.argsort(level, kind="stable")
            cuts = np.flatnonzero(np.diff(level[by_level])) + 1
            for at in np.split(by_level, cuts):
                v = column[at]
                if v.any():
                    dim.append(d)
                    low.append(v.min())
                    high.append(v.max())
                    rows.append(at)
                    values.append(v)
        self.dim, self.low, self.high = np.array(dim, np.int64), np.array(low, float), np.array(high, float)
        self.rows, self.values = rows, values
        #: segments read and segments there, over all queries
        self.read, self.there = 0, 0

    def _exact(self, members: np.ndarray, query: np.ndarray, raw: np.ndarray) -> list[int]:
        """Scores of the members: in 64 bits where no sum can leave them, in whole numbers of any size elsewhere."""
        with np.errstate(over="ignore", invalid="ignore"):
            fits = self.largest[members] * np.abs(query).max(initial=0) * max(1, self.dims) < 2.0**62
            fits &= (self.largest[members] < 2.0**62) & bool(np.abs(query).max(initial=0) < 2.0**62)
        out = np.zeros(len(members), object)
        if fits.any():
            out[fits] = self.vectors[members[fits]].astype(np.int64) @ query.astype(np.int64)
        if not fits.all():
            ints = [whole(x) for x in raw.tolist()]
            for i in np.flatnonzero(~fits).tolist():
                out[i] = sum(a * whole(b) for a, b in zip(ints, self.raw[members[i]].tolist(), strict=True))
        return [int(s) for s in out]

    def search(self, raw: np.ndarray, own: int | None, k: int) -> list[tuple[int, int, int]]:
        """The k best (score, id, row of the block), without the vectors whose id is own; ties to the smaller id."""
        n = len(self.ids)
        with np.errstate(over="ignore", invalid="ignore"):
            query = np.floor(raw * SCALE)
            squares = query * query
        mine = slice(0, 0) if own is None else slice(*np.searchsorted(self.ids, [own, own + 1]).tolist())
        others = n - (mine.stop - mine.start)
        members = np.arange(n)
        if np.isfinite(squares.sum()) and len(self.dim) and others > k:
            members = self._members(query, squares, mine, others, k)
        if mine.stop > mine.start:
            members = members[(members < mine.start) | (members >= mine.stop)]
        exact = self._exact(members, query, raw)
        best = sorted(range(len(members)), key=lambda j: (-exact[j], self.ids[members[j]]))[:k]
        return [(exact[j], int(self.ids[members[j]]), int(members[j])) for j in best]

    def _members(self, query: np.ndarray, squares: np.ndarray, mine: slice, others: int, k: int) -> np.ndarray:
        """Rows that can be among the k best of the others; all rows if the segments end before a proof."""
        n = len(self.ids)
        with np.errstate(over="ignore", invalid="ignore"):
            weight = query[self.dim]
            order = np.argsort(-np.maximum(np.abs(weight * self.low), np.abs(weight * self.high)), kind="stable")
            order = order[weight[order] != 0]
            unread = np.bincount(self.dim[order], minlength=self.dims)
            score, read = np.zeros(n), np.zeros(n)  # and the squares of what has been read
            slack = 4e-16 * (self.dims + 4) * np.sqrt(self.squares * squares.sum()) + 1  # of sums of doubles
        self.there += len(order)
        few = max(4 * k, n // FEW)
        for start in range(0, len(order), PROVE_EVERY):
            stride = order[start:start + PROVE_EVERY].tolist()
            rows, values = np.concatenate([self.rows[s] for s in stride]), np.concatenate([self.values[s] for s in stride])
            size = [len(self.rows[s]) for s in stride]
            score += np.bincount(rows, values * np.repeat(weight[stride], size), n)
            read += np.bincount(rows, values * values, n)
            np.subtract.at(unread, self.dim[stride], 1)
            left = np.maximum(self.squares - read, 0) + 1e-9 * self.squares
            more = np.sqrt(left * squares[unread > 0].sum()) * (1 + 1e-9) + slack
            reach = score + more
            bound = score - more
            bound[mine] = -np.inf
            bound[self.beyond] = -np.inf
            # a vector's own score, less what doubles may err, bounds it better: take it of those that lead
            lead = np.argpartition(bound, n - min(n, 4 * k))[n - min(n, 4 * k):]
            lead = lead[bound[lead] > -np.inf]
            bound[lead] = np.maximum(bound[lead], self.vectors[lead] @ query - slack[lead])
            kth = np.partition(bound, n - k)[n - k]
            reach[self.beyond], reach[mine] = np.inf, -np.inf
            possible = np.flatnonzero(~(reach < kth) & (reach > -np.inf))
            if len(possible) <= few + len(self.beyond):
                self.read += start + len(stride)
                return possible
        self.read += len(order)
        return np.arange(n)


def search(spark: SparkSession, vectors: DataFrame, query_modulus: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query.

    vectors: vec_id, embedding; other columns, whatever their names, are ignored.  Components x
    count as floor(256 x).  Queries are the rows whose vec_id is divisible by query_modulus,
    candidates all rows with another vec_id than the query's; ties go to the smaller vec_id.
    Rows without vec_id or vector, and vectors with null or non-finite components, take no
    part; all finite ones do, of any size.  Scores are compared exactly; one beyond a long is
    given as the long nearest to it.  A candidate of another dimension than a query's is none
    of its candidates; empty vectors are candidates of each other, with score 0.
    Rows that repeat a vec_id are each a candidate of others, and one query together: a
    candidate's score is its greatest over them.  An empty table gives no rows.

    Vectors and queries go in blocks.  Every block of vectors meets every block of queries; its
    index is built once for each stripe of query blocks, which are streamed past it."""
    python_batches(spark)
    x = F.col("embedding")
    usable = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("v"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def blocks(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, number = TaskContext.get().partitionId(), 0
            held: dict[int, list] = {}

            def made(dims: int) -> pa.RecordBatch:
                nonlocal number
                ids = np.concatenate([h[0] for h in held[dims]])
                values = np.concatenate([h[1] for h in held[dims]])
                held[dims] = []
                number += 1
                return pa.RecordBatch.from_arrays(
                    [pa.array([part << 32 | number], pa.int64()), pa.array([dims], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([values.astype("<f8").tobytes()])],
                    names=["block", "dims", "ids", "values"],
                )

            for batch in batches:
                dims = batch.column("dims").to_numpy()
                ids = batch.column("vec_id").to_numpy()
                flat, at = batch.column("v").flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)])
                for d in np.unique(dims).tolist():
                    which = np.flatnonzero(dims == d)
                    values = np.stack([flat[at[i]:at[i + 1]] for i in which.tolist()])
                    for lo in range(0, len(which), most):
                        held.setdefault(d, []).append((ids[which[lo:lo + most]], values[lo:lo + most]))
                        if sum(len(h[0]) for h in held[d]) >= most:
                            yield made(d)
            for d in list(held):
                if held[d]:
                    yield made(d)

        return run

    schema = "block long, dims int, ids binary, values binary"
    asked_rows = rows.where(F.col("vec_id") % query_modulus == 0).distinct()
    n, asks = rows.count(), asked_rows.count()
    # blocks are filled by tasks; as few as fill them, and more, smaller blocks of queries where there are few
    dealt = rows.withColumn("dims", F.size("v")).repartition(max(1, -(-n // (4 * BLOCK))))
    index = materialize(spark, dealt.mapInArrow(blocks(BLOCK), schema), "index")
    n_blocks = max(1, index.count())
    per = max(16, min(QUERY_BLOCK, -(-asks * n_blocks // tasks)))
    asked = asked_rows.withColumn("dims", F.size("v")).repartition(max(1, -(-asks // (4 * QUERY_BLOCK))))
    asked = materialize(spark, asked.mapInArrow(blocks(per), schema), "queries")
    stripes = max(1, min(-(-asks // per), -(-2 * tasks // n_blocks)))
    # numbers of blocks, one for some thousand vectors, deal the query blocks out
    shown = index.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).select("block", "stripe", F.lit(0).cast("long").alias("with"), "dims", "ids", "values")
    stripe = F.pmod(F.col("with") + F.shiftright("with", 32), F.lit(stripes)).cast("int")
    met = asked.withColumnRenamed("block", "with").join(index.select("block", "dims"), "dims").select("block", stripe.alias("stripe"), "with", "dims", "ids", "values")
    pairs = shown.unionByName(met).repartition(tasks, "block", "stripe").sortWithinPartitions("block", "stripe", "with")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            for i in range(batch.num_rows):
                dims, block = batch.column("dims")[i].as_py(), batch.column("block")[i].as_py()
                ids = np.frombuffer(batch.column("ids")[i].as_py(), "<i8")
                values = np.frombuffer(batch.column("values")[i].as_py(), "<f8").reshape(len(ids), dims)
                if batch.column("with")[i].as_py() == 0:  # a block of vectors; its queries follow
                    index = Index(ids, values)
                    continue
                best: dict[tuple[int, int], tuple[int, int]] = {}
                for q, vector in zip(ids.tolist(), values, strict=True):
                    for s, v, row in index.search(vector, q, k):
                        if (q, row) not in best or best[q, row][0] < s:
                            best[q, row] = (s, v)
                if best:
                    out = [(q, v, block, row, max(-LONG - 1, min(LONG, s)), wide_key(s)) for (q, row), (s, v) in best.items()]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["query_id", "vec_id", "block", "row", "score", "wide"])

    found = pairs.mapInArrow(score, "query_id long, vec_id long, block long, row long, score long, wide binary")
    found = found.groupBy("query_id", "vec_id", "block", "row").agg(F.max(F.struct("score", "wide")).alias("s")).select("query_id", "vec_id", "s.score", "s.wide")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("wide").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
