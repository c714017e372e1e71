"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

Documents with the same set of word shingles are one class.  Each class has a signature
in every tree of the forest.  A tree is a trie of signatures; its subtrees at the floor's
depth are dealt by their prefix, and hold their members by the rest of the signature, so
that sizes and least members of prefix groups of any depth are aggregates over sorted
labels.  Every class starts with its whole signature as the prefix that a partner must
match, and shortens it, in the trees where this brings the fewest new partners, until a
partner at the threshold would be met in some tree with the target recall.  A prefix
group is as open as any of its members asks for; whoever shares an open group is a
candidate.

Candidates are verified on whole shingle sets, in blocks of bounded size.  A component of
candidates is dealt to blocks in an order that keeps those together that share their longest
prefixes; two blocks meet only if some open group has members in both.  Pairs stay inside the task that counts them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import drop_table, materialize, python_batches
from millrace.llm.graph import components
from millrace.llm.kernels import mix, slices, texts, window_hashes, word_hashes
from millrace.operators.runs import numbered

#: Bytes of text and documents of a block; two blocks meet in a task.
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 512


@dataclass(frozen=True)
class Forest:
    """trees of depth values each; a matched prefix is never shorter than floor."""

    words: int = 5
    similarity: float = 0.8
    trees: int = 24
    depth: int = 6
    floor: int = 4
    recall: float = 0.9999

    def __post_init__(self) -> None:
        if not 1 <= self.floor < self.depth <= self.floor + 8:
            raise ValueError("floor must be 1 or more, and depth 1 to 8 above it")
        if self.gain(self.floor) * self.trees < self.need():
            raise ValueError("the target recall can't be met with these trees")

    @property
    def bits(self) -> int:
        """Of each value below the floor, in the label that sorts a subtree."""
        return 62 // (self.depth - self.floor)

    def gain(self, prefix: int) -> float:
        """What a tree adds to need(): -ln of the chance that a partner at the threshold has another prefix there."""
        return -math.log1p(-(self.similarity**prefix))

    def need(self) -> float:
        return -math.log1p(-self.recall)

    def shorten(self, sizes: np.ndarray) -> np.ndarray:
        """The prefix length of each class in each tree.

        sizes: (classes, trees, depth - floor + 1), members of the class's prefix groups from the
        floor on down.  All start at full depth; steps that bring the fewest new members come
        first, until the gains of all trees meet the need."""
        n, trees, levels = sizes.shape
        gains = np.array([self.gain(self.floor + k) for k in range(levels)])
        cost = (sizes[:, :, :-1] - sizes[:, :, -1:])[:, :, ::-1].reshape(n, -1)  # of one step up, two, ...
        step = np.tile((gains[:-1] - gains[1:])[::-1], trees)
        order = np.argsort(cost, axis=1, kind="stable")  # a tree's steps cost more and more, so they keep their order
        had = trees * gains[-1] + np.cumsum(step[order], axis=1) - step[order]
        taken = np.zeros(cost.shape, bool)
        np.put_along_axis(taken, order, had < self.need(), axis=1)
        return self.depth - taken.reshape(n, trees, levels - 1).sum(axis=2)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, end to end; and their offsets.

    A shingle is k words in a row; a text of fewer words has one, of all its words; a text
    without words has none."""
    parts, counts = [], []
    for a, b, piece, at in slices(data, offsets):
        words, first = word_hashes(piece, at)
        n = np.diff(first)
        windows = window_hashes(words, k)
        doc = np.repeat(np.arange(b - a), n)
        whole = doc[:len(windows)] == doc[k - 1:] if len(windows) else np.zeros(0, bool)
        h, of = windows[whole], doc[:len(windows)][whole]
        for i in np.flatnonzero((n > 0) & (n < k)).tolist():
            h = np.append(h, window_hashes(words[first[i]:first[i + 1]], int(n[i])))
            of = np.append(of, i)
        order = np.argsort(h)
        order = order[np.argsort(of[order], kind="stable")]
        h, of = h[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[new], of[new]
        parts.append(h)
        counts.append(np.bincount(of, minlength=b - a))
    count = np.concatenate(counts) if counts else np.empty(0, np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


def signatures(sets: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """n minima for each set that is not empty, and zeros for the others."""
    out = np.zeros((len(offsets) - 1, n), np.uint32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    x = (sets >> np.uint64(32)).astype(np.uint32)
    y = sets.astype(np.uint32)
    seeds = mix(np.arange(1, n + 1, dtype=np.uint64))
    for i in range(n):
        a, b = np.uint32(int(seeds[i]) >> 32 | 1), np.uint32(int(seeds[i]) & 0xFFFFFFFF | 1)
        h = x * a + y * b
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        out[full, i] = np.minimum.reduceat(h, offsets[full])
    return out


def _alike(sets: np.ndarray, offsets: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sets have at least that Jaccard similarity, as a matrix."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    order = np.argsort(sets, kind="stable")
    s, d = sets[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number) >= 2
    column = np.cumsum(shared) - 1
    keep = shared[number]
    d, column = d[keep], column[number[keep]]
    common = np.zeros((n, n), np.float32)
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        dense = np.zeros((n, min(width, int(shared.sum()) - lo)), np.float32)
        dense[d[a:b], column[a:b] - lo] = 1
        common += dense @ dense.T
    union = size[:, None] + size[None, :] - common
    out = common >= similarity * union - 1e-6
    np.fill_diagonal(out, False)
    return out


def _roots(links: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    root = np.arange(len(links))
    while True:
        least = np.where(links, root[None, :], len(links)).min(axis=1, initial=len(links))
        after = np.minimum(root, least)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _sizes(entries: DataFrame, p: Forest) -> DataFrame:
    """(key, label) of subtrees with two members or more; size and least member of every prefix group
    from the floor's (n0, h0) to the whole signature's.  Aggregates combine before they are
    shuffled, so a hot prefix sends a row for each task and label."""
    top = p.depth - p.floor
    leaves = entries.groupBy("key", "label").agg(F.count("*").alias(f"n{top}"), F.min("node").alias(f"h{top}"))
    group = lambda df, by, k: df.groupBy(*by).agg(F.sum(f"n{top}").alias(f"n{k}"), F.min(f"h{top}").alias(f"h{k}"))
    sizes = leaves.join(group(leaves, ["key"], 0).where("n0 > 1"), "key")
    for k in range(1, top):
        cut = F.shiftright("label", p.bits * (top - k)).alias("cut")
        by = group(sizes.select("key", cut, f"n{top}", f"h{top}"), ["key", "cut"], k)
        sizes = sizes.withColumn("cut", cut).join(by, ["key", "cut"]).drop("cut")
    return sizes


def _open(spark: SparkSession, asked: DataFrame, p: Forest) -> DataFrame:
    """(node, group, head, leaf) of every class in every open prefix group of more than one member."""
    top = p.depth - p.floor
    cols = [f"n{k}" for k in range(top + 1)]
    by_node = asked.groupBy("node").agg(F.collect_list(F.struct("key", "label", *cols)).alias("in"))  # as many as trees at most

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("in")
            count = np.diff(lists.offsets.to_numpy())
            if not len(count):
                continue
            items = lists.flatten()
            row = np.repeat(np.arange(len(count)), count)
            tree = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            sizes = np.ones((len(count), p.trees, top + 1), np.int64)  # alone in the trees that aren't listed
            for k, c in enumerate(cols):
                sizes[row, tree, k] = items.field(c).to_numpy()
            depth = p.shorten(sizes)[row, tree]
            yield pa.RecordBatch.from_arrays([items.field("key"), items.field("label"), pa.array(depth)], names=["key", "label", "depth"])

    wanted = by_node.mapInArrow(choose, "key long, label long, depth long").groupBy("key", "label").agg(F.min("depth").alias("depth"))
    wanted = materialize(spark, wanted, "wanted")
    # a group is open if any member asks for it
    depth = F.lit(p.depth)
    full = wanted.select("key", "label")
    for k in range(top - 1, -1, -1):
        cut = F.shiftright("label", p.bits * (top - k)) if k else F.lit(0).cast("long")
        asks = wanted.where(F.col("depth") <= p.floor + k).select("key", cut.alias("cut"), F.lit(True).alias(f"o{k}")).distinct()
        full = full.withColumn("cut", cut).join(asks, ["key", "cut"], "left").drop("cut")
        depth = F.when(F.col(f"o{k}"), p.floor + k).otherwise(depth)
    full = full.select("key", "label", depth.alias("depth"))
    at = [F.col("depth") == p.floor + k for k in range(top + 1)]
    pick = lambda c: F.coalesce(*[F.when(x, F.col(f"{c}{k}")) for k, x in enumerate(at)])
    prefix = F.coalesce(*[F.when(x, F.shiftright("label", p.bits * (top - k)) if k else F.lit(0).cast("long")) for k, x in enumerate(at)])
    rows = asked.join(full, ["key", "label"])
    return rows.where(pick("n") > 1).select("node", F.xxhash64("key", "depth", prefix).alias("group"), pick("h").alias("head"), F.col(f"h{top}").alias("leaf"))


def join(spark: SparkSession, docs: DataFrame, keep: list[str], forest: Forest = Forest()) -> DataFrame:
    """keep columns of every row of docs (doc_id, text), class_id, n_links and first.

    Two rows are linked if their shingle sets have the forest's similarity or more.  n_links
    counts a row's links; class_id is the least doc_id that links lead to; first marks one
    row of each such group, the one with that doc_id.  Texts without words (null, empty,
    white space) have no links and are groups of their own; texts of fewer words than a
    shingle have one shingle, of all their words; long texts count whole.  Rows are told apart
    by a key written with them, so repeated rows and ids are safe; of rows with the same least
    doc_id, the first read is first.  A group without any doc_id has class_id null.  Columns of
    keep that are named class_id, n_links or first give way to the operator's; others may have
    any name.  An empty table gives no rows."""
    python_batches(spark)
    keep = [c for c in keep if c.lower() not in ("class_id", "n_links", "first")]
    k, n_hashes = forest.words, forest.trees * forest.depth

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            sets, at = shingles(data, offsets, k)
            sig = signatures(sets, at, n_hashes).astype("<u4")
            raw = sets.astype("<u8").tobytes()
            named = [hashlib.md5(raw[8 * a:8 * b]).hexdigest() if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(named, pa.string()), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(np.diff(offsets))],
                names=[*batch.schema.names, "set", "sig", "n_bytes"],
            )

    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    kept_type = rows.schema["kept"].dataType.simpleString()
    signed = rows.mapInArrow(sign, f"kept {kept_type}, doc_id long, text string, row long, set string, sig binary, n_bytes long")
    signed = materialize(spark, signed, "signed")
    classes = materialize(spark, signed.where("set IS NOT NULL").groupBy("set").agg(
        F.min("row").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"), F.count("*").alias("size")
    ), "classes")

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class in each tree: its subtree at the floor, and the label that sorts it there."""
        salt = mix(np.arange(1, forest.trees + 1, dtype=np.uint64))
        for batch in batches:
            node = batch.column("node").to_numpy()
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(len(node), forest.trees, forest.depth)
            key = np.broadcast_to(salt, (len(node), forest.trees)).copy()
            for i in range(forest.floor):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i])
            label = np.zeros(key.shape, np.int64)
            for i in range(forest.floor, forest.depth):
                label = label << forest.bits | (sig[:, :, i] >> np.uint32(max(0, 32 - forest.bits)))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int64)), pa.array(label.ravel()), pa.array(np.repeat(node, forest.trees))], names=["key", "label", "node"])

    of_class = classes.select("node").join(signed.select(F.col("row").alias("node"), "sig"), "node")
    entries = materialize(spark, of_class.mapInArrow(tries, "key long, label long, node long"), "tries")
    sizes = materialize(spark, _sizes(entries, forest), "sizes")
    asked = materialize(spark, entries.join(sizes, ["key", "label"]), "asked")
    opened = materialize(spark, _open(spark, asked, forest), "open")
    drop_table(spark, entries)
    groups = materialize(spark, components(spark, opened.where("node <> head").select(F.col("node").alias("src"), F.col("head").alias("dst")).distinct()), "groups")

    # blocks: runs of a component's classes, those next to each other that share their longest prefixes with one
    # class, and before that any open group; each block is full but for a component's last
    near = opened.groupBy("node").agg(F.min("head").alias("near"), F.min("leaf").alias("family"))
    weight = F.greatest(F.col("n_bytes"), F.lit(-(-BLOCK_BYTES // BLOCK_DOCS)))
    member = groups.join(near, "node").join(classes.select("node", "size"), "node").join(signed.select(F.col("row").alias("node"), weight.alias("weight")), "node")
    placed_at = numbered(member, ["component"], ["near", "family", "node"], "upto", add="weight")
    block = F.xxhash64("component", F.floor((F.col("upto") - F.col("weight")) / BLOCK_BYTES))
    member = materialize(spark, placed_at.select("node", "size", block.alias("block")), "members")
    held = opened.select("node", "group").join(member.select("node", "block"), "node").select("group", "block").distinct()
    held = materialize(spark, held, "held")
    meet = held.withColumnRenamed("block", "a").join(held.withColumnRenamed("block", "b"), "group").where("a <= b").select("a", "b").distinct()
    meet = materialize(spark, meet, "meet")
    sides = meet.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("block"))
    placed = sides.join(member, "block").join(signed.select(F.col("row").alias("node"), "text"), "node").select("a", "b", "block", "node", "size", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def one(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            node, size, block = (group.column(c).to_numpy() for c in ("node", "size", "block"))
            sets, at = shingles(*texts(group.column("text")), k)
            alike = _alike(sets, at, forest.similarity)
            if group.column("a")[0].as_py() != group.column("b")[0].as_py():  # pairs within a block are another task's
                alike &= block[:, None] != block[None, :]
            return node, alike @ size, node[_roots(alike)]

        def of(table: pa.Table, final: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
            keys = np.stack([table.column(c).to_numpy() for c in ("a", "b")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            ends = [*cuts.tolist(), *([table.num_rows] if final else [])]
            got, start = [], 0
            for end in ends:
                if end - start > 1:
                    got.append(one(table.slice(start, end - start)))
                start = end
            rest = table.slice(start) if start < table.num_rows else None
            if not got:
                return None, rest
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got, strict=True)], names=["node", "links", "root"]), rest

        for batch in batches:
            table = pa.Table.from_batches([batch])
            made, held = of(pa.concat_tables([held, table]) if held is not None else table, False)
            if made is not None:
                yield made
        if held is not None:
            made, _ = of(held, True)
            if made is not None:
                yield made

    verified = materialize(spark, dealt.mapInArrow(verify, "node long, links long, root long"), "verified")
    for gone in (opened, asked, sizes):
        drop_table(spark, gone)
    counted = verified.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(spark, verified.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")).distinct())
    full = classes.join(named, "node", "left").join(counted, "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = full.groupBy("group").agg(F.min("least").alias("best"))
    final = full.join(least, "group").select("set", F.col("best.doc_id").alias("class_id"), F.col("best.row").alias("best_row"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    final = materialize(spark, final, "final")
    out = signed.select("kept", "doc_id", "row", "set").join(final, "set", "left")
    alone = F.col("set").isNull()
    return out.select(
        "kept.*", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("row") == F.col("best_row"))).alias("first"),
    )
