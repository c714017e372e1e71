"""Token ids in a binary file format with Re-Pair grammar compression.

A shard is a run of whole documents in ascending doc_id order.  Its repeated id pairs
become nonterminals, round after round, until no pair occurs MIN_COUNT times; the shard
stores the rules, the length that each expands to, and the symbols that are left.  A round
takes all such pairs at once: where two overlap the more frequent goes first, and a run of
one id is paired off from its left end, so a run of n ids takes about log n rules.  One row
of the files is one shard, so a document, or a part of one, is read without decoding the
rest of its shard.

Payload, all little-endian: 7 uint32 (format, bits of a symbol, bytes of an expansion
length, documents, rules, symbols, first nonterminal), then as uint32 the ids and the
symbols of each document, then the expansion length of each rule, and then, in so many
bits each, the left and right sides of the rules and the symbols of the documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import python_batches, range_id, ranges, write_table
from millrace.llm.kernels import mix, pack, packed, repeat_ranges, texts
from millrace.llm.tokens import encoder

FORMAT = 0x52505232
#: Ids of a shard (a longer document is a shard of its own), and what a pair must count to get a rule.
SHARD_IDS, MIN_COUNT = 1 << 18, 2
_HASH_BITS = 18
LEAST = -(1 << 63)


def _bucket(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)


def _repeated(keys: np.ndarray, bucket: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that count least or more, the most frequent first; and the places where one of them
    can be.  Ties go by a hash of the pair: neighbours of equal count then yield to each other at
    random places, not all in a row.

    A table of hashed counts first sets aside what can't repeat; the rest is counted exactly."""
    places = np.flatnonzero((np.bincount(bucket, minlength=1 << _HASH_BITS) >= least)[bucket])
    maybe = np.sort(keys[places])
    if not len(maybe):
        return maybe, places
    first = np.flatnonzero(np.append(True, maybe[1:] != maybe[:-1]))
    count = np.diff(np.append(first, len(maybe)))
    keep = count >= least
    pairs, count = maybe[first[keep]], count[keep]
    return pairs[np.lexsort((mix(pairs), -count))], places


def _index(pairs: np.ndarray, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Which of the pairs each key is, or -1.  A bucket leads to one pair, the first of those that fall in it; keys
    of the others are searched for."""
    own, each = _bucket(pairs), np.arange(len(pairs), dtype=np.int32)
    first = np.full(1 << _HASH_BITS, -1, np.int32)
    first[own[::-1]] = each[::-1]
    found = first[bucket]
    other = np.flatnonzero(pairs[found] != keys)  # with no pair in its bucket, a key is compared with the last one
    found[other] = -1
    behind = each[first[own] != each]
    if len(behind) and len(other):
        behind = behind[np.argsort(pairs[behind])]
        at = np.minimum(np.searchsorted(pairs[behind], keys[other]), len(behind) - 1)
        there = pairs[behind[at]] == keys[other]
        found[other[there]] = behind[at[there]]
    return found


def _second(seq: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places are pairs of one symbol with itself; and which of these overlap the one before, counting a
    run's places from its left end."""
    same = np.zeros(len(seq), bool)
    same[:-1] = (seq[:-1] == seq[1:]) & inner[:-1]
    at = np.flatnonzero(same)
    start = at[np.maximum.accumulate(np.where(np.append(True, np.diff(at) > 1), np.arange(len(at)), 0))] if len(at) else at
    odd = np.zeros(len(seq), bool)
    odd[at[(at - start) % 2 == 1]] = True
    return same, odd


def compress(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, symbols of each document, rules (left, right), first nonterminal.

    No pair reaches over the end of a document."""
    seq = ids.astype(np.uint32)
    base = int(seq.max(initial=0)) + 1
    last = np.zeros(len(seq), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    live = ~last  # places whose pair may repeat: one that doesn't never will, but for new neighbours
    rules: list[np.ndarray] = []
    n_rules = 0
    while True:
        same, overlaps = _second(seq, ~last)
        at = np.flatnonzero((live | same) & ~overlaps)
        keys = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
        bucket = _bucket(keys)
        pairs, places = _repeated(keys, bucket, MIN_COUNT)
        if not len(pairs):
            break
        found = _index(pairs, keys[places], bucket[places])
        hit = found >= 0
        at, own = at[places[hit]], found[hit]
        rank = np.full(len(seq) + 2, len(pairs), np.int32)  # of a place, one on; the best pair meets no better neighbour, so it gets all its places
        rank[at + 1] = own
        live = rank[1:-1] < len(pairs)
        best = (own < rank[at]) & (own < rank[at + 2])
        taken, own = at[best], own[best]
        often = np.bincount(own, minlength=len(pairs)) >= MIN_COUNT
        used = np.flatnonzero(often)
        enough, which = taken[often[own]], (np.cumsum(often) - 1)[own[often[own]]]
        rules.append(pairs[used])
        seq[enough] = base + n_rules + which
        n_rules += len(used)
        last[enough] = last[enough + 1]
        live[enough] = True
        live[np.maximum(enough - 1, 0)] = True
        gone = np.zeros(len(seq), bool)
        gone[enough + 1] = True
        seq, last, live = seq[~gone], last[~gone], live[~gone] & ~last[~gone]
    sides = np.concatenate(rules) if rules else np.empty(0, np.uint64)
    left, right = (sides >> np.uint64(32)).astype(np.uint32), sides.astype(np.uint32)
    symbols = np.zeros(len(sizes), np.int64)
    symbols[sizes > 0] = np.diff(np.concatenate([[-1], np.flatnonzero(last)]))
    return seq, symbols, np.stack([left, right]), base


def _expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids of each rule.  Rules are taken in runs whose sides all lie before the run, of which there are no more than rounds."""
    sides = rules.astype(np.int64) - base
    latest, n = sides.max(axis=0, initial=-1), sides.shape[1]
    out = np.ones(n + 1, np.int64)  # the last one stands for any id
    a = 0
    while a < n:
        later = latest[a:] >= a
        b = a + int(later.argmax()) if later.any() else n
        out[a:b] = out[np.maximum(sides[:, a:b], -1)].sum(axis=0)
        a = b
    return out[:n]


def _bits(values: np.ndarray, width: int) -> bytes:
    """width bits of each value, the lowest first, end to end."""
    each = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(each[:, :width].ravel(), bitorder="little").tobytes()


def _from_bits(data: np.ndarray, first: int, count: int, width: int) -> np.ndarray:
    """count values from the first-th on; reads only the bytes that hold them."""
    start = first * width
    raw = np.unpackbits(data[start // 8:(start + count * width + 7) // 8], bitorder="little")[start % 8:start % 8 + count * width]
    each = np.zeros((count, 32), np.uint8)
    each[:, :width] = raw.reshape(count, width)
    return np.packbits(each, axis=1, bitorder="little").view("<u4").ravel().astype(np.int64)


def write_shard(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    seq, symbols, rules, base = compress(ids, sizes)
    width = max(1, int(base + rules.shape[1] - 1).bit_length())
    lengths = _expansion_lengths(rules, base)
    wide = 1 if lengths.max(initial=0) < 1 << 8 else 2 if lengths.max(initial=0) < 1 << 16 else 4
    head = np.array([FORMAT, width, wide, len(sizes), rules.shape[1], len(seq), base], "<u4")
    numbers = np.concatenate([sizes, symbols]).astype("<u4")
    return head.tobytes() + numbers.tobytes() + lengths.astype(f"<u{wide}").tobytes() + _bits(rules.ravel(), width) + _bits(seq, width)


class Shard:
    """Reads a payload; documents, and parts of them, decode by themselves."""

    def __init__(self, payload: bytes):
        head = np.frombuffer(payload, "<u4", 7)
        if int(head[0]) != FORMAT:
            raise ValueError("not a shard of this format")
        self.width, wide, docs, n_rules, self.n_symbols, self.base = (int(x) for x in head[1:])
        numbers = np.frombuffer(payload, "<u4", 2 * docs, 28).astype(np.int64)
        at = 28 + 4 * len(numbers)
        self.lengths = np.frombuffer(payload, f"<u{wide}", n_rules, at).astype(np.int64)
        at += wide * n_rules
        data = np.frombuffer(payload, np.uint8)
        self.rules = _from_bits(data[at:], 0, 2 * n_rules, self.width).reshape(2, n_rules)
        self.data = data[at + (2 * n_rules * self.width + 7) // 8:]
        self.sizes, count = numbers[:docs], numbers[docs:]
        self.first = np.concatenate([[0], np.cumsum(count)])

    def symbols(self, first: int, end: int) -> np.ndarray:
        return _from_bits(self.data, first, end - first, self.width)

    def _decode(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of the symbols: rules are put in until only ids are left; no others are looked at."""
        while True:
            rule = symbols >= self.base
            if not rule.any():
                return symbols.astype(np.uint32)
            at = np.arange(len(symbols)) + np.cumsum(rule) - rule
            out = np.empty(len(symbols) + int(rule.sum()), np.int64)
            out[at] = symbols
            sides = self.rules[:, symbols[rule] - self.base]
            out[at[rule]], out[at[rule] + 1] = sides
            symbols = out

    def all_ids(self) -> np.ndarray:
        """Each rule is expanded once, not at each of its symbols; but where rules within rules add up to more than
        the documents, symbols are expanded."""
        symbols = self.symbols(0, self.n_symbols)
        if self.lengths.sum() > self.sizes.sum():
            return self._decode(symbols)
        expanded = self._decode(self.base + np.arange(len(self.lengths)))
        begin, size = len(expanded) + np.arange(len(symbols)), np.ones(len(symbols), np.int64)
        rule = np.flatnonzero(symbols >= self.base)
        which = symbols[rule] - self.base
        begin[rule], size[rule] = (np.cumsum(self.lengths) - self.lengths)[which], self.lengths[which]
        return np.concatenate([expanded, symbols.astype(np.uint32)])[repeat_ranges(begin, size)]

    def ids(self, doc: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """ids[start:end] of one document; only the symbols that cover them, and the rules they reach, are expanded."""
        symbols = self.symbols(int(self.first[doc]), int(self.first[doc + 1]))
        end = int(self.sizes[doc]) if end is None else min(end, int(self.sizes[doc]))
        if start >= end:
            return np.empty(0, np.uint32)
        size = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        size[rule] = self.lengths[symbols[rule] - self.base]
        ends = np.cumsum(size)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, end, "left")) + 1
        before = int(ends[a] - size[a])
        return self._decode(symbols[a:b])[start - before:end - before]


def write(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> str:
    """Encode docs (doc_id, text) into shards in ascending doc_id order; returns the files' path.

    Null and empty texts are documents of the end id alone.  Documents that share a doc_id
    are all kept, next to each other, ordered by their ids' bytes; null doc_ids come first.  Other columns are
    ignored.  Ranges of doc_id are dealt to tasks once, after encoding, as packed ids;
    no task holds more than a shard."""
    python_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    splits = ranges(rows, "doc_id", parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        kind = np.uint16 if tokens.library.get_vocab_size() <= 1 << 16 else np.uint32
        for batch in batches:
            ids, at = tokens.encode(*texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), pack(ids.astype(kind), at)], names=["part", "doc_id", "ids"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint16 if encoder(tokenizer).library.get_vocab_size() <= 1 << 16 else np.uint32
        part, number, start = None, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        size = 0

        def emit() -> pa.RecordBatch:
            nonlocal number, start, held, size
            ids, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            doc_ids = pa.concat_arrays([h[2] for h in held])
            known = [x for x in doc_ids.to_pylist() if x is not None]
            row = [[part], [number], [start], [len(ids)], [min(known, default=None)], [max(known, default=None)], [doc_ids.to_pylist()], [write_shard(ids, sizes)]]
            number, start, held, size = number + 1, start + len(ids), [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.binary()), strict=True)],
                names=["part", "shard", "start_in_part", "n_ids", "first_doc", "last_doc", "doc_ids", "payload"],
            )

        for batch in batches:
            values, at = packed(batch.column("ids"), kind)
            parts = batch.column("part").to_numpy()
            a = 0
            while a < len(parts):
                if parts[a] != part:
                    if held:
                        yield emit()
                    part, number, start = int(parts[a]), 0, 0
                b = a + int(np.searchsorted(parts[a:], part, "right"))
                room = SHARD_IDS - size
                ends = at[a + 1:b + 1] - at[a] + np.arange(1, b - a + 1)  # with the end ids
                take = int(np.searchsorted(ends, room, "right"))
                if not take and held:
                    yield emit()
                    continue
                b = a + max(1, take)
                ids = np.insert(values[at[a]:at[b]].astype(np.uint32), (at[a + 1:b + 1] - at[a]), end_id)
                held.append((ids, np.diff(at[a:b + 1]) + 1, batch.column("doc_id").slice(a, b - a)))
                size += len(ids)
                a = b
        if held:
            yield emit()

    encoded = rows.withColumn("part", range_id("doc_id", splits).cast("int")).mapInArrow(encode, "part int, doc_id long, ids binary")
    dealt = encoded.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "ids")
    made = dealt.mapInArrow(shards, "part int, shard int, start_in_part long, n_ids long, first_doc long, last_doc long, doc_ids array<long>, payload binary")
    return write_table(spark, made, "shards")


def fetch(spark: SparkSession, path: str, doc_ids: list[int], start: int = 0, end: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): ids[start:end] of the documents with these doc_ids, from the files at path.

    Only shards whose range of doc_ids holds one of them are read, and of these only the symbols that
    cover the asked ids are decoded.  Rows that share a doc_id all come; an unknown one gives no row."""
    python_batches(spark)
    wanted = sorted(set(doc_ids))
    shards = spark.read.parquet(path)
    holds = F.lit(False)
    for i in wanted:
        holds |= (F.col("first_doc") <= i) & (F.col("last_doc") >= i)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                known = np.array([LEAST if x is None else x for x in batch.column("doc_ids")[row].as_py()], np.int64)
                at = np.flatnonzero(np.isin(known, wanted))
                if len(at):
                    shard = Shard(batch.column("payload")[row].as_py())
                    got = [shard.ids(int(i), start, end).tolist() for i in at]
                    yield pa.RecordBatch.from_arrays([pa.array(known[at]), pa.array(shard.sizes[at]), pa.array(got, pa.list_(pa.int64()))], names=["doc_id", "n_tokens", "ids"])

    return shards.where(holds).select("doc_ids", "payload").mapInArrow(pick, "doc_id long, n_tokens long, ids array<long>")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at path."""
    python_batches(spark)
    shards = spark.read.parquet(path)
    # a row for each range of doc_id, of which there are as many as shuffle partitions
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).toPandas().sort_values("part")
    before = dict(zip(totals["part"].tolist(), (totals["n"].cumsum() - totals["n"]).tolist(), strict=True))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column("payload")[row].as_py())
                ids = memoryview(shard.all_ids().astype("<u4").tobytes())
                ends = np.cumsum(shard.sizes)
                starts = ends - shard.sizes
                sums = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                base = before[batch.column("part")[row].as_py()] + batch.column("start_in_part")[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[row].values, pa.array(base + starts), pa.array(shard.sizes), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.select("part", "start_in_part", "doc_ids", "payload").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
