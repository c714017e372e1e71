"""Substring dedup: word windows that start earlier in the corpus are removed.

Equal windows pick the same anchor, the least hash of the short n-grams in them, so
consecutive windows of one anchor travel as one segment, and every two equal windows meet
under their anchor.  Hashes only route; what repeats is decided on words:

* Segments of equal hash are claims that a later document holds an earlier passage.  A
  document's claims that lie end to end in one earlier document are one passage; its words
  are fetched there, and the document is streamed past them: by comparison word for word,
  and by the passage's suffix automaton should they differ.
* Where an anchor has segments of different words, these form a reference shard of bounded
  size: one suffix automaton in the task that owns it, past which they are streamed in
  corpus order for matching statistics.  An anchor with more of them than a shard takes is
  split by a finer key, the whole window, which makes claims of the first kind.

(Broadcasting automata of all reference shards to all documents would send the corpus to
every executor, as every document is a reference for later ones; routing by anchor sends
each segment to the one shard that can match it.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import BATCH_BYTES, materialize, python_batches
from millrace.llm.kernels import _WORDS, mix, pack, repeat_ranges, slices, sliding_min, texts, window_hashes, word_hashes, word_spans

LAST = (1 << 63) - 1
_LEAD = ["lead_doc", "lead_mark", "lead_first"]


@dataclass(frozen=True)
class Spans:
    window: int = 20  # words
    gram: int = 6  # words of an anchor
    shard_words: int = 50_000  # of one automaton
    group_most: int = 1024  # segments of an anchor in a shard; more are dealt window by window


class Automaton:
    """A generalised suffix automaton over words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.words = 0

    def _clone(self, q: int, length: int) -> int:
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(length)
        return len(self.next) - 1

    def add(self, sequence: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            p, q = last, nxt[last].get(c)
            if q is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
            else:
                cur = None
            if q is not None and length[q] != length[p] + 1:
                clone = self._clone(q, length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            if cur is None:
                last = q
            else:
                link[cur] = 0 if q is None else q
                last = cur
        self.words += len(sequence)

    def statistics(self, sequence: list[int]) -> list[int]:
        """For each end, the length of the longest match of what ends there."""
        nxt, link, length = self.next, self.link, self.length
        out, state, size = [], 0, 0
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(c)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out


def segments(data: np.ndarray, offsets: np.ndarray, p: Spans, seen: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first window, windows, anchor, content) of every segment, slice by slice; the hashes of
    each slice's words and the number of each document's go to seen."""
    for a, b, piece, at in slices(data, offsets):
        words, first = word_hashes(piece, at)
        seen.append((words, np.diff(first)))
        n = len(words) - p.window + 1
        if n < 1:
            continue
        doc = np.repeat(np.arange(b - a), np.diff(first))
        grams = window_hashes(words, p.gram)
        placed = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64)
        at_anchor = (sliding_min(placed, p.window - p.gram + 1)[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        whole = doc[:n] == doc[p.window - 1:]
        new = np.ones(n, bool)
        new[1:] = (at_anchor[1:] != at_anchor[:-1]) | ~whole[:-1]
        starts = np.flatnonzero(new & whole)
        if not len(starts):
            continue
        cut = np.flatnonzero(new | ~whole)
        ends = np.append(cut, n)[np.searchsorted(cut, starts) + 1]
        count = ends - starts
        up, down = _WORDS.upto(len(words) + 1)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words) * up[:-1], out=sums[1:])
        stop = starts + count + p.window - 1
        content = mix((sums[stop] - sums[starts]) * down[starts] + mix(count.astype(np.uint64)))
        yield doc[starts] + a, starts - first[doc[starts]], count, grams[at_anchor[starts]], content


def _keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []
    return docs.select(*kept, text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("at_doc"), F.xxhash64(text).alias("mark"))


def _same_words(words: np.ndarray, at: np.ndarray, lead: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size words at each place are those at lead."""
    equal = words[repeat_ranges(at, size)] == words[repeat_ranges(lead, size)]
    return np.logical_and.reduceat(equal, np.cumsum(size) - size) if len(size) else np.zeros(0, bool)


def _claims(spark: SparkSession, rows: DataFrame, p: Spans) -> tuple[DataFrame, DataFrame]:
    """Runs of windows that are known to repeat, (at_doc, mark, first, windows); and claims that windows repeat
    those of an earlier passage, with lead_doc, lead_mark and lead_first."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = ["at_doc", "mark", "first", "windows"]
    runs = ", ".join(f"{c} long" for c in place)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments by anchor.  Of those in a batch with the same words only the first goes on; the later are repeats."""
        for batch in batches:
            at_doc, mark = batch.column("at_doc").to_numpy(), batch.column("mark").to_numpy()
            seen: list[tuple[np.ndarray, np.ndarray]] = []
            got = list(segments(*texts(batch.column("text")), p, seen))
            if not got:
                continue
            words, n_words = (np.concatenate(x) for x in zip(*seen, strict=True))
            begin = np.cumsum(n_words) - n_words
            doc, first, count, anchor, content = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((mark[doc], first, at_doc[doc], content, anchor))
            doc, first, count, anchor, content = (x[order] for x in (doc, first, count, anchor, content))
            doc_key = at_doc[doc]
            new = np.ones(len(doc), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = np.flatnonzero((doc_key != doc_key[lead]) | (first != first[lead]))
            at = begin[doc] + first
            equal = np.zeros(len(doc), bool)
            equal[later] = (count[later] == count[lead[later]]) & _same_words(words, at[later], at[lead[later]], np.minimum(count[later], count[lead[later]]) + p.window - 1)
            again = np.zeros(len(doc), bool)  # rows of one doc_id and text are one
            again[1:] = ~new[1:] & (doc_key[1:] == doc_key[:-1]) & (first[1:] == first[:-1]) & (mark[doc[1:]] == mark[doc[:-1]])
            out = ~again
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[out].astype(np.int64), mask=equal[out]), *[pa.array(x[out]) for x in (content.astype(np.int64), doc_key, mark[doc], first, count)]],
                names=["anchor", "content", *place],
            )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By anchor, content and order: later segments claim to repeat the first of their content; of an anchor with
        several contents the first of each is for a shard, with its anchor."""
        held: list[np.ndarray] | None = None  # the last content's first rows, not yet judged
        shared_before = False

        def judged(cols: list[np.ndarray], final: bool):
            nonlocal held, shared_before
            anchor, content, at_doc, mark, first, windows = cols
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            tie = (at_doc == at_doc[lead]) & (first == first[lead])
            heads = np.flatnonzero(new)
            same = np.zeros(len(heads), bool)
            same[1:] |= anchor[heads[1:]] == anchor[heads[:-1]]
            same[:-1] |= anchor[heads[1:]] == anchor[heads[:-1]]
            same[0] |= shared_before
            keep_from = len(anchor)
            if not final:  # whether the last content's anchor has another is not known yet
                keep_from = heads[-1]
                held_rows = tie & (np.arange(len(anchor)) >= keep_from)
                held = [c[held_rows] for c in cols]
                shared_before = bool(same[-1])
            ask = tie & same[np.cumsum(new) - 1] & (np.arange(len(anchor)) < keep_from)
            out = ask | ~tie
            if not out.any():
                return None
            claim = [pa.array(c[lead[out]], mask=ask[out]) for c in (at_doc, mark, first)]
            return pa.RecordBatch.from_arrays([pa.array(anchor[out], mask=~ask[out]), *[pa.array(c[out]) for c in (at_doc, mark, first, windows)], *claim], names=["anchor", *place, *_LEAD])

        for batch in batches:
            loose = batch.column("anchor").is_null().to_numpy(zero_copy_only=False)
            if loose.any():
                known = batch.filter(pa.array(loose))
                none = pa.nulls(known.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none, *[known.column(c) for c in place], none, none, none], names=["anchor", *place, *_LEAD])
                batch = batch.filter(pa.array(~loose))
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("anchor", "content", *place)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            got = judged(cols, False)
            if got is not None:
                yield got
        if held is not None:
            got = judged(held, True)
            if got is not None:
                yield got

    emitted = rows.mapInArrow(emit, f"anchor long, content long, {runs}")
    dealt = emitted.repartition(parts, F.coalesce("anchor", F.xxhash64("mark", "first"))).sortWithinPartitions("anchor", "content", "at_doc", "first")
    settled = materialize(spark, dealt.mapInArrow(settle, f"anchor long, {runs}, lead_doc long, lead_mark long, lead_first long"), "settled")
    known = settled.where("anchor IS NULL AND lead_doc IS NULL").select(*place)
    claims = settled.where("lead_doc IS NOT NULL").select(*place, *_LEAD)
    asked = settled.where("anchor IS NOT NULL").select("anchor", *place)

    # an automaton knows no starts: where texts share a doc_id, windows are dealt singly, so that ties stay ties
    twins = rows.select("at_doc", "mark").distinct().groupBy("at_doc").count().where("count > 1").select("at_doc")
    tied = asked.join(twins, "at_doc", "left_semi").select("anchor", F.lit(True).alias("tied")).distinct()
    many = asked.groupBy("anchor").count().where(F.col("count") > p.group_most).select("anchor", F.lit(True).alias("many"))
    asked = asked.join(many, "anchor", "left").join(tied, "anchor", "left").withColumn("singly", F.coalesce("many", "tied", F.lit(False)))
    wanted = asked.groupBy("at_doc", "mark").agg(F.collect_set(F.struct("anchor", "first", "windows", "singly")).alias("asked"))
    fetched = rows.join(wanted, ["at_doc", "mark"]).mapInArrow(_fetch(p), "anchor long, singly boolean, at_doc long, mark long, first long, windows long, words binary")
    fetched = materialize(spark, fetched, "segments")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments by anchor and order: one is asked for what earlier ones hold, then added."""
        automaton, anchor, before = Automaton(), None, None
        for batch in batches:
            out = []
            for key, at_doc, mark, first, words in zip(*[batch.column(c).to_pylist() for c in ("anchor", "at_doc", "mark", "first", "words")], strict=True):
                if before == (key, at_doc, mark, first):  # a row that is there twice
                    continue
                before, listed = (key, at_doc, mark, first), words.split()
                if key != anchor:
                    if automaton.words > p.shard_words:
                        automaton = Automaton()
                    anchor = key
                else:
                    out += [(at_doc, mark, first + start, n) for start, n in _matched(automaton, listed, p.window)]
                automaton.add(listed)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=place)

    usual = fetched.where("NOT singly").select("anchor", "at_doc", "mark", "first", "words")
    matched = usual.repartition(parts, "anchor").sortWithinPartitions("anchor", "at_doc", "first", "mark").mapInArrow(stream, runs)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("words")
            hashes, begin = word_hashes(*texts(column))
            n = batch.column("windows").to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            at = repeat_ranges(begin[:-1], n)
            h = window_hashes(hashes, p.window)[at].astype(np.int64) if len(at) else np.empty(0, np.int64)
            first = batch.column("first").to_numpy()[row] + at - begin[:-1][row]
            yield pa.RecordBatch.from_arrays([pa.array(h), *[pa.array(batch.column(c).to_numpy()[row]) for c in ("at_doc", "mark")], pa.array(first)], names=["window", "at_doc", "mark", "first"])

    single = fetched.where("singly").mapInArrow(windows, "window long, at_doc long, mark long, first long")
    single = materialize(spark, single, "windows")
    least = single.groupBy("window").agg(F.min(F.struct("at_doc", "first", "mark")).alias("least"))
    later = single.join(least, "window").where(F.struct("at_doc", "first") > F.struct("least.at_doc", "least.first"))
    later = later.select("at_doc", "mark", "first", F.lit(1).cast("long").alias("windows"), F.col("least.at_doc").alias("lead_doc"), F.col("least.mark").alias("lead_mark"), F.col("least.first").alias("lead_first"))
    return known.unionByName(matched), claims.unionByName(later)


def _fetch(p: Spans):
    """Of texts with asked places (structs with first and windows), the words there as they stand in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            start, end, begin = word_spans(data, offsets)
            lists = batch.column("asked")
            per, items = np.diff(lists.offsets.to_numpy()), lists.flatten()
            first, windows = (items.field(c).to_numpy() for c in ("first", "windows"))
            doc = np.repeat(np.arange(batch.num_rows), per)
            at = begin[doc] + first
            a, b = start[at], end[at + windows + p.window - 2]
            names = [f.name for f in items.type if f.name not in ("first", "windows")]
            for lo, hi in _runs(b - a):
                size = b[lo:hi] - a[lo:hi]
                raw = pack(data[repeat_ranges(a[lo:hi], size)], np.concatenate([[0], np.cumsum(size)]))
                keys = [pa.array(batch.column(c).to_numpy()[doc[lo:hi]]) for c in ("at_doc", "mark")]
                yield pa.RecordBatch.from_arrays(
                    [*[items.field(c).slice(lo, hi - lo) for c in names], *keys, pa.array(first[lo:hi]), pa.array(windows[lo:hi]), raw],
                    names=[*names, "at_doc", "mark", "first", "windows", "words"],
                )

    return run


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's claims that lie end to end, here and in one earlier document, as one."""
    for batch in batches:
        lists = batch.column("claims")
        per, items = np.diff(lists.offsets.to_numpy()), lists.flatten()
        if not len(items):
            continue
        row = np.repeat(np.arange(batch.num_rows), per)
        first, windows, doc, mark, lead = (items.field(c).to_numpy() for c in ("first", "windows", "lead_doc", "lead_mark", "lead_first"))
        order = np.lexsort((first, first - lead, mark, doc, row))
        row, first, windows, doc, mark, lead = (x[order] for x in (row, first, windows, doc, mark, lead))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (first[1:] - lead[1:] != first[:-1] - lead[:-1]) | (first[1:] != first[:-1] + windows[:-1])
        at = np.flatnonzero(new)
        keys = [pa.array(batch.column(c).to_numpy()[row[at]]) for c in ("at_doc", "mark")]
        yield pa.RecordBatch.from_arrays(
            [*keys, pa.array(first[at]), pa.array(np.add.reduceat(windows, at)), pa.array(doc[at]), pa.array(mark[at]), pa.array(lead[at])],
            names=["at_doc", "mark", "first", "windows", "lead_doc", "lead_mark", "lead_first"],
        )


def repeats(spark: SparkSession, docs: DataFrame, p: Spans = Spans()) -> DataFrame:
    """(at_doc, mark, runs, passages) of the documents that may hold windows whose words also start earlier:
    runs of windows that do, and the words of earlier passages that others are to be held against.

    Earlier is a smaller doc_id, or the same doc_id and a smaller start; documents without
    doc_id come last, as one.  mark is a hash of the text."""
    python_batches(spark)
    rows = _keyed(docs, [])
    known, claims = _claims(spark, rows, p)
    by_doc = claims.groupBy("at_doc", "mark").agg(F.collect_set(F.struct("first", "windows", "lead_doc", "lead_mark", "lead_first")).alias("claims"))
    stretches = by_doc.mapInArrow(_stretches, "at_doc long, mark long, first long, windows long, lead_doc long, lead_mark long, lead_first long")
    stretches = materialize(spark, stretches, "stretches")
    asked = stretches.groupBy(F.col("lead_doc").alias("at_doc"), F.col("lead_mark").alias("mark")).agg(F.collect_set(F.struct(F.col("lead_first").alias("first"), "windows")).alias("asked"))
    passages = rows.join(asked, ["at_doc", "mark"]).mapInArrow(_fetch(p), "at_doc long, mark long, first long, windows long, words binary")
    passages = passages.select(F.col("at_doc").alias("lead_doc"), F.col("mark").alias("lead_mark"), F.col("first").alias("lead_first"), "windows", "words").dropDuplicates([*_LEAD, "windows"])
    held = stretches.join(materialize(spark, passages, "passages"), [*_LEAD, "windows"])
    passages_of = held.groupBy("at_doc", "mark").agg(F.collect_list(F.struct("first", "windows", "words")).alias("passages"))
    runs_of = known.groupBy("at_doc", "mark").agg(F.collect_set(F.struct("first", "windows")).alias("runs"))
    return runs_of.join(passages_of, ["at_doc", "mark"], "full")


def _held(words: list, first: int, windows: int, passage: list, window: int) -> list[tuple[int, int]]:
    """Which of the windows from first on the passage holds."""
    mine = words[first:first + windows + window - 1]
    if mine == passage:
        return [(first, windows)]
    a = Automaton()
    a.add(passage)
    return [(first + start, n) for start, n in _matched(a, mine, window)]


def _matched(automaton: Automaton, words: list, window: int) -> list[tuple[int, int]]:
    """(first, windows) of the runs of windows that the automaton holds whole."""
    out, start = [], None
    for i, n in enumerate([*automaton.statistics(words)[window - 1:], 0]):
        if n >= window:
            start = i if start is None else start
        elif start is not None:
            out.append((start, i - start))
            start = None
    return out


def _runs(sizes: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of about so many bytes."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lo, hi
        lo = hi


def remove(spark: SparkSession, docs: DataFrame, keep: list[str], p: Spans = Spans()) -> DataFrame:
    """keep columns of every row, n_words, n_removed, kept_text and spans (start, end in words).

    Words are runs of bytes other than 0x20 and 0x09-0x0D.  A word goes if a window of
    p.window words covers it whose words also start earlier, in the input; kept words are
    joined by one space.  Null and empty texts have no words.  Documents of fewer words than a
    window stay whole; long texts are read whole.  Rows that share doc_id and text are treated alike, and neither is
    earlier than the other.  Columns of keep that are named as the operator's give way to them;
    others may have any name.  An empty table gives no rows."""
    keep = [c for c in keep if c.lower() not in ("n_words", "n_removed", "kept_text", "spans")]
    found = materialize(spark, repeats(spark, docs, p), "repeats")
    rows = _keyed(docs, keep).join(found, ["at_doc", "mark"], "left").select("kept", "text", "runs", "passages")
    kept_type = rows.schema["kept"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for text, runs, passages in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), batch.column("passages").to_pylist(), strict=True):
                words = text.split()
                found = [(r["first"], r["windows"]) for r in runs or ()]
                for x in passages or ():
                    found += _held(words, x["first"], x["windows"], x["words"].split(), p.window)
                gone: list[list[int]] = []
                for r in sorted((first, first + windows + p.window - 1) for first, windows in found):
                    if gone and r[0] <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], r[1])
                    else:
                        gone.append(list(r))
                left, at = [], 0
                for a, b in gone:
                    left += words[at:a]
                    at = b
                left += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
                spans.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["kept", "n_words", "n_removed", "kept_text", "spans"],
            )

    made = rows.mapInArrow(cut, f"kept {kept_type}, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long>>")
    return made.select("kept.*", "n_words", "n_removed", "kept_text", "spans")
