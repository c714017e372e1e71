"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram is the product of its
letters' vectors, each rotated by its place; a text is the sum of its trigrams, and
a language the sum of its texts.  A text has the language whose prototype has the
greatest cosine with it.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import python_batches
from millrace.llm.kernels import slices, texts

DIMENSIONS, UNKNOWN = 1024, "und"
#: Labelled documents of each language that a profile is learned from, at most; chosen by a hash of the text.
LEARNED_A_LANGUAGE = 20_000


@functools.cache
def _letter_codes() -> np.ndarray:
    """The lower-case code point of every letter, or 0 for what is none."""
    out = np.zeros(sys.maxunicode + 1, np.int32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if unicodedata.category(x)[0] == "L":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@functools.lru_cache(4096)
def letter_vector(code: int) -> np.ndarray:
    """The vector of a lower-case letter; 0 is the gap between words."""
    return np.random.default_rng([code, 20]).choice(np.array([-1, 1], np.int8), DIMENSIONS)


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and each text's first."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    code = data[at].astype(np.int32)
    wide = np.flatnonzero(code >= 0xC0)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        b0, b1, b2, b3 = (padded[at[wide] + i] for i in range(4))
        code[wide] = np.where(
            b0 < 0xE0, (b0 & 31) << 6 | b1 & 63,
            np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63),
        )
    return np.minimum(code, sys.maxunicode), np.searchsorted(at, offsets)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram, count) of every trigram of each text, by text.

    Letters are lower-cased; whatever lies between words, and a text's ends, is one gap.
    A trigram is 21 bits for each of its letters; gaps alone make none."""
    code, first = _code_points(data, offsets)
    letters = _letter_codes()[code].astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    # one gap before each text, and one for each run of other characters
    gap = letters == 0
    repeated = np.zeros(len(gap), bool)
    repeated[1:] = gap[1:] & gap[:-1] & (doc[1:] == doc[:-1])
    keep = ~repeated
    letters, doc = letters[keep], doc[keep]
    starts = np.searchsorted(doc, np.arange(len(offsets) - 1))
    letters, doc = np.insert(letters, starts, 0), np.insert(doc, starts, np.arange(len(offsets) - 1))
    letters, doc = np.append(letters, [0, 0]), np.append(doc, [-1, -1])
    # the gap before the next text also closes this one
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    c = np.where(doc[2:] == doc[:-2], c, 0)
    whole = (doc[1:-1] == doc[:-2]) & (b != 0) | (doc[:-2] == doc[2:]) & ((a != 0) | (c != 0))
    gram, of = (a << 42 | b << 21 | c)[whole], doc[:-2][whole]
    order = np.argsort(gram, kind="stable")
    order = order[np.argsort(of[order], kind="stable")]
    gram, of = gram[order], of[order]
    if not len(gram):
        return of, gram, np.empty(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])]))
    return of[new], gram[new], np.diff(np.append(new, len(gram)))


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of trigrams, a row each."""
    mask = (1 << 21) - 1
    out = np.ones((len(grams), DIMENSIONS), np.float32)
    for shift, place in ((42, 2), (21, 1), (0, 0)):
        codes, which = np.unique((grams >> shift) & mask, return_inverse=True)
        table = np.stack([np.roll(letter_vector(int(c)), place) for c in codes]).astype(np.float32)
        out *= table[which]
    return out


def bundles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The vector of each text; all 0 for one without a letter."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMENSIONS), np.float32)
    for a, b, piece, at in slices(data, offsets):
        of, gram, count = trigrams(piece, at)
        if not len(gram):
            continue
        distinct, which = np.unique(gram, return_inverse=True)
        first = np.searchsorted(of, np.arange(b - a + 1))
        weights = count.astype(np.float32)
        # sums over distinct trigrams, in blocks of them so that their vectors stay small
        for lo in range(0, len(distinct), 4096):
            vectors = gram_vectors(distinct[lo:lo + 4096])
            here = (which >= lo) & (which < lo + 4096)
            table = np.zeros((b - a, len(vectors)), np.float32)
            table[of[here], which[here] - lo] = weights[here]
            out[a:b] += table @ vectors
        del first
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, bool)
    for a, b, piece, at in slices(data, offsets):
        code, first = _code_points(piece, at)
        total = np.concatenate([[0], np.cumsum(_letter_codes()[code] != 0)])
        out[a:b] = total[first[1:]] > total[first[:-1]]
    return out


def learn(spark: SparkSession, labelled: DataFrame) -> dict[str, np.ndarray]:
    """A prototype of each language of labelled (text, lang), both not null.

    Each text counts alike: its vector is scaled to length 1.  Of a language with more than
    LEARNED_A_LANGUAGE texts, about so many are taken, by a hash of the text.  Rows with a null are
    left out, repeated rows count each time, long texts whole; other columns, whatever their names, are
    ignored; an empty table teaches nothing."""
    python_batches(spark)
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    shares = {k: LEARNED_A_LANGUAGE / n for k, n in totals.items() if n > LEARNED_A_LANGUAGE}
    if shares:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("lang")), F.lit(1.0))
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            vectors = bundles(*texts(batch.column("text")))
            size = np.linalg.norm(vectors, axis=1)
            vectors = vectors / np.maximum(size, 1e-9)[:, None]
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = rows.mapInArrow(sums, "lang string, v array<double>")
    flat = parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    got = flat.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).collect()
    return {r["lang"]: np.array([p["x"] for p in r["v"]]) for r in sorted(got, key=lambda r: r["lang"])}


def predict(spark: SparkSession, docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """All columns of docs (with text), lang_pred and score; columns of docs with these names give way.

    Prototypes are taken against their mean, which holds what all languages share; the
    score is the cosine with the best one, 0 at least.  Ties go to the smaller language.
    Null texts, texts without a letter, and any text if nothing was learned, are und, 0.  Long texts
    count whole; rows that repeat are told alike; an empty table gives no rows."""
    python_batches(spark)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    langs = sorted(prototypes)
    if langs:
        table = np.stack([prototypes[k] / max(np.linalg.norm(prototypes[k]), 1e-9) for k in langs])
        mean = table.mean(axis=0) if len(langs) > 1 else np.zeros(DIMENSIONS)
        centred = table - mean
        centred /= np.maximum(np.linalg.norm(centred, axis=1), 1e-9)[:, None]
    schema = f"{', '.join(f'`{n}` {t}' for n, t in docs.dtypes)}, lang_pred string, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(batch.schema.get_field_index("text")))
            known = has_letter(data, offsets)
            pred, best = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
            if langs and known.any():
                vectors = bundles(data, offsets).astype(np.float64)
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
                rest = vectors - mean
                rest /= np.maximum(np.linalg.norm(rest, axis=1), 1e-9)[:, None]
                cosine = np.round(rest @ centred.T, 9)
                top = cosine.argmax(axis=1)
                pred = np.where(known, np.array(langs, object)[top], UNKNOWN)
                best = np.where(known, np.clip(cosine[np.arange(len(top)), top], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred.tolist(), pa.string()), pa.array(best)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(score, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 of 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def crc_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
