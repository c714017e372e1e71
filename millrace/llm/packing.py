"""Bounded-space online packing of token ids into windows of a fixed length.

Each partition keeps a fixed number of open windows.  A piece goes to the open
window that it fills best; when none has room, the fullest is emitted (filled up
first with the head of the piece, if its gap is worth a cut).  What is still
open at the end of all partitions is merged in groups of bounded size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, python_batches
from millrace.llm.kernels import texts
from millrace.llm.tokens import encoder

#: Open windows of a partition; the gap from which the fullest is filled with a cut; partitions whose leftovers one task merges.
OPEN, CUT_GAP, MERGED_PARTS = 32, 16, 128
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Windows:
    """The open windows of one partition.  Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, most: int = OPEN, cut_gap: int = CUT_GAP):
        self.size, self.most, self.cut_gap = size, most, cut_gap
        self.gaps: list[int] = []
        self.pieces: list[list[tuple]] = []

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> Iterator[list[tuple]]:
        """Takes one document's ids; yields the windows that it closes."""
        n, size = len(ids), self.size
        whole = n - n % size
        for a in range(0, whole, size):
            yield [(doc, start + a, ids[a:a + size], total)]
        start, ids = start + whole, ids[whole:]
        while len(ids):
            n = len(ids)
            best = -1
            for i, gap in enumerate(self.gaps):
                if gap >= n and (best < 0 or gap < self.gaps[best]):
                    best = i
            if best < 0 and len(self.gaps) < self.most:
                self.gaps.append(size)
                self.pieces.append([])
                best = len(self.gaps) - 1
            if best >= 0:
                self.pieces[best].append((doc, start, ids, total))
                self.gaps[best] -= n
                if not self.gaps[best]:
                    self.gaps.pop(best)
                    yield self.pieces.pop(best)
                return
            full = min(range(len(self.gaps)), key=self.gaps.__getitem__)
            gap = self.gaps.pop(full)
            window = self.pieces.pop(full)
            if gap >= self.cut_gap:
                window.append((doc, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            yield window


def _rows(window: list[tuple], sequence: int) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, total in window:
        yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset
        offset += len(ids)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0) -> DataFrame:
    """The pieces of all docs (doc_id, text): PIECE.

    Null and empty texts are the end id alone.  Rows that share a doc_id, or have none,
    are packed as documents of their own.  Other columns are ignored.  An empty table
    gives no pieces.  Sequences hold size ids, but for those emitted with a gap below
    CUT_GAP and the last of each merged group."""
    python_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        windows, number = Windows(size), 0

        def batch_of(made: list[tuple], left: list[bytes | None]) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*made, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(made), pa.int64()), *columns, pa.array(left, pa.binary())], names=["part", *NAMES, "ids"])

        for batch in batches:
            ids, at = tokens.encode(*texts(batch.column("text")))
            made: list[tuple] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id))
                for window in windows.add(doc, 0, own, len(own)):
                    made += _rows(window, part << 32 | number)
                    number += 1
            if made:
                yield batch_of(made, [None] * len(made))
        made, left = [], []
        for i, window in enumerate(windows.pieces):
            made += _rows(window, i)
            left += [p[2].astype("<u4").tobytes() for p in window]
        if made:
            yield batch_of(made, left)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        """Leftover windows of one group of partitions, end to end; cut at every size ids."""
        group = group.sort_values(["part", "sequence_id", "offset"])
        sequence = (int(group["part"].iloc[0]) // MERGED_PARTS | 1 << 30) << 32
        out, at = [], 0
        for doc, start, total, raw in zip(group["doc_id"], group["start"], group["doc_tokens"], group["ids"], strict=True):
            ids = np.frombuffer(raw, "<u4")
            while len(ids):
                head = ids[:size - at]
                out += [(None if pd.isna(doc) else int(doc), start, len(head), zlib.crc32(head.tobytes()), total, sequence, at)]
                start, ids, at = start + len(head), ids[len(head):], at + len(head)
                if at == size:
                    sequence, at = sequence + 1, 0
        made = pd.DataFrame(out, columns=NAMES)
        made["doc_id"] = made["doc_id"].astype("Int64")
        return made

    placed = materialize(spark, rows.mapInArrow(place, f"part long, {PIECE}, ids binary"), "pieces")
    leftovers = placed.where(F.col("ids").isNotNull()).withColumn("merged", F.expr(f"part div {MERGED_PARTS}"))
    merged = leftovers.groupBy("merged").applyInPandas(lambda g: merge(g), PIECE)
    return placed.where(F.col("ids").isNull()).select(*NAMES).unionByName(merged)
