"""Deterministic codes of strings as vectors: Kronecker byte codes, phase (Fourier) codes."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import importable

CROP = 32


def collision_key(token: Column, length: int = CROP) -> Column:
    """What a code that crops at so many bytes sees of a token."""
    return F.hex(F.substring(F.encode(token, "UTF-8"), 1, length))


def collisions(tokens: DataFrame, length: int = CROP) -> DataFrame:
    """(key, n, least): keys that more than one distinct token has."""
    keyed = tokens.select("token", collision_key(F.col("token"), length).alias("key")).distinct()
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("token").alias("least")).where("n > 1")


def utf8_truncate(data: bytes, n: int) -> bytes:
    """At most n bytes, without a character that is cut."""
    cut = data[:n]
    while n and len(data) > n and cut and (data[len(cut)] & 0xC0) == 0x80:
        cut = cut[:-1]
    return cut


def token_bytes(text: Column) -> Column:
    """A byte-fallback token <0xNN> is that byte; any other its UTF-8."""
    return F.when(text.rlike("^<0x[0-9A-Fa-f]{2}>$"), F.unhex(F.regexp_extract(text, "^<0x([0-9A-Fa-f]{2})>$", 1))).otherwise(F.encode(text, "UTF-8"))


class ByteCodec:
    """Bytes bound to positions: one-hot places that crop, or sinusoids that don't; scaled and z-normalised."""

    def __init__(self, places: int = 16, sinusoid: bool = True):
        self.places, self.sinusoid = places, sinusoid

    def encode_one(self, text: str) -> np.ndarray:
        data = text.encode()
        bits = np.array([[(b >> i & 1) * 2 - 1 for i in range(8)] for b in data], float).reshape(-1, 8)
        at = np.arange(len(data))
        if self.sinusoid:
            k = np.arange(self.places // 2)
            angle = at[:, None] / (10_000 ** (2 * k / self.places))
            place = np.concatenate([np.sin(angle), np.cos(angle)], axis=1)
        else:
            bits, at = bits[:self.places], at[:self.places]
            place = np.eye(self.places)[at]
        code = (place[:, :, None] * bits[:, None, :]).sum(axis=0).ravel() / np.sqrt(max(len(data), 1))
        spread = code.std()
        return (code - code.mean()) / spread if spread > 0 else code


class PhaseCodec:
    """Bytes as unit phases, positions as phase ramps; a string is the sum of its bound bytes."""

    def __init__(self, dims: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.symbol = np.exp(2j * np.pi * rng.random((256, dims)))
        self.ramp = rng.random(dims) * 2 * np.pi
        self.policy = {"codec": "phase", "dims": dims, "seed": seed}

    def spectrum(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return (self.symbol[data] * np.exp(1j * self.ramp * np.arange(len(data))[:, None])).sum(axis=0)

    def encode_one(self, text: str) -> np.ndarray:
        return np.fft.irfft(np.concatenate([[0], self.spectrum(text)]))

    def rotate(self, spectrum: np.ndarray, by: int) -> np.ndarray:
        return spectrum * np.exp(1j * self.ramp * by)

    def concat(self, a: str, b: str) -> np.ndarray:
        return self.spectrum(a) + self.rotate(self.spectrum(b), len(a.encode()))

    def score(self, spectrum: np.ndarray, byte: int, at: int) -> float:
        return float((spectrum * np.conj(self.symbol[byte] * np.exp(1j * self.ramp * at))).real.mean())

    def decode(self, spectrum: np.ndarray, length: int) -> bytes:
        out = []
        for i in range(length):
            scores = (np.conj(self.symbol) * (spectrum * np.exp(-1j * self.ramp * i))).real.mean(axis=1)
            out.append(int(scores.argmax()))
        return bytes(out)

    def policy_id(self) -> str:
        return json.dumps(self.policy, sort_keys=True)


def coded(tokens: DataFrame, codec) -> DataFrame:
    """Adds code to (token), in Arrow batches."""

    @F.pandas_udf("array<double>")
    def encode(t: pd.Series) -> pd.Series:
        return t.map(codec.encode_one)

    return tokens.withColumn("code", encode("token"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def unit(v: str) -> Column:
    """A vector scaled to length 1, so that pairs need one product."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


#: Vectors of a block, of which two meet in one product; and what stands for a null label there.
BLOCK, NO_LABEL = 1024, -(1 << 63)
#: Bytes of one Arrow batch on its way to Python: a row holds two blocks, so a number of rows bounds no memory.
BATCH_BYTES = 8 << 20


def _blocks(vectors: DataFrame, v: str) -> tuple[DataFrame, int]:
    """(block, id, label, v): about BLOCK rows of (vec_id, label, v) in each, end to end; and how many blocks."""
    n = -(-vectors.count() // BLOCK) or 1
    label = F.coalesce(F.col("label").cast("long"), F.lit(NO_LABEL))
    row = F.struct(F.col("vec_id").cast("long").alias("id"), label.alias("label"), F.col(v).cast("array<double>").alias("v"))
    held = vectors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(row).alias("r"))
    return held.select("block", F.col("r.id").alias("id"), F.col("r.label").alias("label"), F.flatten(F.col("r.v")).alias("v")), n


def _meet(a: DataFrame, b: DataFrame, first, last, ring: int | None = None) -> DataFrame:
    """Each block of a with the blocks of b from first to last: an equi-join on the block's number.  On a ring of so
    many blocks, the first follows the last.

    By sort and merge: Spark's estimate of a leaves out its copies, so that a few queries, copied for every block of b,
    would pass for small enough to be broadcast through the driver.  Rows go to Python a few at a time: with Spark's own
    bounds, the batches of eight tasks didn't fit in 1 GB outside the heap."""
    a.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    numbers = F.sequence(first, last)
    if ring:
        numbers = F.transform(numbers, lambda k: F.pmod(k, F.lit(ring)))
    left = a.select(F.explode(numbers).alias("with"), *[F.col(c).alias(f"{c}_a") for c in a.columns])
    return left.hint("merge").join(b.select(F.col("block").alias("with"), *[F.col(c).alias(f"{c}_b") for c in b.columns]), "with")


def _sides(row: dict) -> tuple[np.ndarray, ...]:
    a, b = ((np.asarray(row[f"id_{s}"]), np.asarray(row[f"label_{s}"]), np.asarray(row[f"v_{s}"], float)) for s in "ab")
    return a[0], a[1], a[2].reshape(len(a[0]), -1), b[0], b[1], b[2].reshape(len(b[0]), -1)


def extreme_cosines(units: DataFrame) -> DataFrame:
    """One row (least_same, most_same, most_other, most): of all pairs of (vec_id, label, u), the extreme cosines
    within labels, the largest across labels, and the largest of all.

    Every two blocks meet once, in one product.  Pairs with a null label count only for most; where there is no
    such pair, the cosine is null."""
    importable(units.sparkSession)
    dealt, n = _blocks(units, "u")
    met = _meet(dealt, dealt, F.col("block"), F.lit(n - 1))

    def extremes(batches):
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                i, k, u, j, m, w = _sides(r)
                cos = u @ w.T
                pair = i[:, None] != j[None, :]
                known = pair & (k[:, None] != NO_LABEL) & (m[None, :] != NO_LABEL)
                same = k[:, None] == m[None, :]
                most = lambda which: np.max(cos, where=which, initial=-np.inf)  # noqa: B023, E731
                out.append((np.min(cos, where=known & same, initial=np.inf), most(known & same), most(known & ~same), most(pair)))
            yield pd.DataFrame(out, columns=["least_same", "most_same", "most_other", "most"], dtype=float)

    found = met.mapInPandas(extremes, "least_same double, most_same double, most_other double, most double")
    finite = lambda c: F.when(F.abs(c) <= 2, c)
    return found.agg(finite(F.min("least_same")).alias("least_same"), *[finite(F.max(c)).alias(c) for c in ("most_same", "most_other", "most")])


def nearest(asked: DataFrame, vectors: DataFrame, v: str) -> DataFrame:
    """(query_id, nearest, label, nearest_label, value): of all vectors but the query's own the one of the largest dot
    product, of unit vectors.

    asked and vectors: (vec_id, label, v).  Blocks of queries meet blocks of vectors in one product; the best of
    each block is measured again directly, and one row a query and block goes on."""
    importable(vectors.sparkSession)
    left, _ = _blocks(asked, v)
    right, n = _blocks(vectors, v)
    met = _meet(left, right, F.lit(0), F.lit(n - 1))

    def best(batches):
        for batch in batches:
            for r in batch.to_dict("records"):
                i, k, u, j, m, w = _sides(r)
                score = u @ w.T
                score[i[:, None] == j[None, :]] = -np.inf
                at = score.argmax(axis=1)
                value = np.where(np.isfinite(score.max(axis=1)), (u * w[at]).sum(axis=1), -np.inf)
                yield pd.DataFrame({"query_id": i, "label": k, "nearest": j[at], "nearest_label": m[at], "value": value})[np.isfinite(value)]

    found = met.mapInPandas(best, "query_id long, label long, nearest long, nearest_label long, value double")
    top = found.groupBy("query_id", "label").agg(F.max(F.struct("value", (-F.col("nearest")).alias("nearest"), "nearest_label")).alias("t"))
    known = lambda c: F.when(c != NO_LABEL, c)
    return top.select("query_id", (-F.col("t.nearest")).alias("nearest"), known(F.col("label")).alias("label"), known(F.col("t.nearest_label")).alias("nearest_label"), F.col("t.value").alias("value"))


#: Vectors of a block where every vector asks; rows of one product; pairs measured at once; components that are squared
#: safely stay below HUGE; and the largest id.
WIDE, TILE, MEASURED, HUGE, LAST = 2048, 256, 1 << 14, 1e150, (1 << 63) - 1


def _ragged(vectors: DataFrame, v: str) -> tuple[DataFrame, int]:
    """(block, id, label, size, v, gaps): about WIDE rows of (vec_id, label, v) in each, end to end, where v may be null,
    of any length, and hold nulls, whose places are the gaps; and how many blocks."""
    n = -(-vectors.count() // WIDE) or 1
    zero = F.lit(0).cast(vectors.schema[v].dataType.elementType)
    label = F.coalesce(F.col("label").cast("long"), F.lit(NO_LABEL))
    row = F.struct(F.col("vec_id").cast("long").alias("id"), label.alias("label"), F.col(v).alias("v"))
    held = vectors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(row).alias("r"))
    size = F.transform("r.v", lambda x: F.coalesce(F.array_size(x), F.lit(0)))
    flat = F.flatten(F.filter("r.v", lambda x: x.isNotNull()))
    end_to_end = held.select("block", F.col("r.id").alias("id"), F.col("r.label").alias("label"), size.alias("size"), flat.alias("v"))
    gaps = F.array_compact(F.transform("v", lambda x, at: F.when(x.isNull(), at)))
    return end_to_end.select("block", "id", "label", "size", F.transform("v", lambda x: F.coalesce(x, zero)).alias("v"), gaps.alias("gaps")), n


class _Vectors:
    """A block's rows by their different vectors: x and which of its components are there, of each; of its rows with a
    label the least id and the next one, with their labels."""

    def __init__(self, row: dict, side: str, width: int):
        self.ids, labels, size, flat, gaps = (np.asarray(row[f"{c}_{side}"]) for c in ("id", "label", "size", "v", "gaps"))
        there = np.ones(len(flat), bool)
        there[gaps.astype(int)] = False
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        used, row_of = at < width, np.repeat(np.arange(len(size)), size)
        x, has = np.zeros((len(size), width)), np.zeros((len(size), width), bool)
        x[row_of[used], at[used]] = flat[used].astype(float) + 0.0  # no -0.0
        has[row_of[used], at[used]] = there[used]
        first, self.kind = self.different(x, has)
        self.x, self.has = x[first], has[first]
        self.id1, self.label1, self.id2, self.label2 = (np.full(len(first), z) for z in (LAST, NO_LABEL) * 2)
        known = np.flatnonzero(labels != NO_LABEL)
        known = known[np.lexsort((labels[known], self.ids[known], self.kind[known]))]
        kinds, lead = np.unique(self.kind[known], return_index=True)
        self.id1[kinds], self.label1[kinds] = self.ids[known[lead]], labels[known[lead]]
        known = known[self.ids[known] != self.id1[self.kind[known]]]
        kinds, lead = np.unique(self.kind[known], return_index=True)
        self.id2[kinds], self.label2[kinds] = self.ids[known[lead]], labels[known[lead]]
        self.known, self.alone = self.label1 != NO_LABEL, self.label2 == NO_LABEL

    @staticmethod
    def different(x: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row of each different vector, and each row's number among these; by hashes, if they tell all apart."""
        odd = np.random.default_rng(7).integers(1 << 63, size=2 * x.shape[1], dtype=np.uint64) | np.uint64(1)
        mixed = (x.view(np.uint64) >> np.uint64(29) ^ x.view(np.uint64)) * odd[: x.shape[1]]
        if len(np.unique(mixed.sum(axis=1) + (has * odd[x.shape[1] :]).sum(axis=1))) == len(x):
            return np.arange(len(x)), np.arange(len(x))
        whole = np.ascontiguousarray(np.hstack([x.view(np.uint8), has.view(np.uint8), np.zeros((len(x), 1), np.uint8)]))
        _, first, kind = np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
        return first, kind.ravel()


class _Best:
    """Of what is offered to each of n: the least distance (not a number: last), of those the least id."""

    def __init__(self, n: int):
        self.value, self.nearest, self.label = np.full(n, np.nan), np.full(n, LAST), np.full(n, NO_LABEL)

    def offer(self, to, value, nearest, label):
        order = np.lexsort((nearest, value, to))
        to, lead = np.unique(to[order], return_index=True)
        value, nearest, label = (c[order[lead]] for c in (value, nearest, label))
        old, none, was_none = self.value[to], np.isnan(value), np.isnan(self.value[to])
        better = (value < old) | (was_none & ~none) | (((value == old) | (was_none & none)) & (nearest < self.nearest[to]))
        for mine, c in ((self.value, value), (self.nearest, nearest), (self.label, label)):
            mine[to[better]] = c[better]

    def rows(self, ids, kind) -> pd.DataFrame:
        got = pd.DataFrame({"query_id": ids, "nearest": self.nearest[kind], "nearest_label": self.label[kind], "value": self.value[kind]})
        return got[got["nearest_label"] != NO_LABEL]


def _close(a, b, known_a, known_b, barred=None):
    """Yields (i, j, squared distance) of rows of a and b, each (x, has): among them all the nearest known rows of b to
    each of a, and of a to each of b, but for pairs that are barred.

    One product gives distances but for its rounding; what may be nearest is measured component by component, in their
    order.  Where there are no components in common, there is no distance; what is not finite is measured with all."""
    (x, hx), (w, hw) = a, b
    whole = bool(hx.all() and hw.all())

    def measured(i, j):
        for s in range(0, len(i), MEASURED):
            p, q = i[s : s + MEASURED], j[s : s + MEASURED]
            if barred is not None:
                free = ~barred(p, q)
                p, q = p[free], q[free]
            with np.errstate(invalid="ignore", over="ignore"):
                d = (x[p] - w[q]) ** 2
            if not whole:
                both = hx[p] & hw[q]
                d = np.where(both, d, 0.0)[any_ := both.any(axis=1)]
                p, q = p[any_], q[any_]
            if len(p):
                yield p, q, np.cumsum(d, axis=1)[:, -1]

    fine_x, fine_w = (np.abs(x) < HUGE).all(axis=1), (np.abs(w) < HUGE).all(axis=1)
    rows, cols = np.flatnonzero(fine_x), np.flatnonzero(fine_w)
    if len(rows) and len(cols):
        u, v, kx, kw = x[rows], w[cols], known_a[rows], known_b[cols]
        u2, v2 = u * u, v * v
        nu, nv = u2.sum(axis=1), v2.sum(axis=1)
        if whole:
            left, right = np.column_stack([-2 * u, nu, np.ones(len(u))]), np.column_stack([v, np.ones(len(v)), nv])
        else:
            left, right = np.hstack([u2, -2 * u, hx[rows]]), np.hstack([hw[cols], v, v2])
        finite = lambda bound: np.where(bound < np.inf, bound, -np.inf)
        slack = 16 * (x.shape[1] + 4) * np.finfo(float).eps
        most = np.full(len(cols), np.inf)
        for s in range(0, len(rows), TILE):
            at = slice(s, s + TILE)
            d = left[at] @ right.T
            if not whole:
                d[hx[rows[at]].astype(float) @ hw[cols].T == 0] = np.inf
            if barred is not None:
                d[barred(rows[at, None], cols[None, :])] = np.inf
            of_rows = d if kw.all() else np.where(kw, d, np.inf)
            of_cols = d if kx[at].all() else np.where(kx[at, None], d, np.inf)
            near = of_rows <= finite(of_rows.min(axis=1) + slack * (nu[at] + nv.max()))[:, None]
            np.minimum(most, of_cols.min(axis=0) + slack * (nv + nu.max()), out=most)
            near |= of_cols <= finite(most)
            i, j = near.nonzero()
            yield from measured(rows[at][i], cols[j])
    for i in np.flatnonzero(~fine_x):
        yield from measured(np.full(len(w), i), np.arange(len(w)))
    for j in np.flatnonzero(~fine_w):
        yield from measured(rows, np.full(len(rows), j))


def nearest_labels(vectors: DataFrame, v: str) -> DataFrame:
    """(query_id, label, nearest, nearest_label, value): for every vec_id of (vec_id, label, v) the nearest vector by
    squared distance that has a label and another vec_id; of equally near ones the least vec_id.

    Distances are sums over the components that both vectors have; nulls and what a shorter vector lacks take no part,
    and a distance that is not a number comes last.  Where none is left, nearest is null.  Rows of one vec_id ask
    together, with their least label; a null vec_id takes no part.

    Every two blocks meet once, in products that serve both; copies within a block meet as one.  All pairs are looked
    at, so time grows with the square of the rows."""
    importable(vectors.sparkSession)
    vectors = vectors.where("vec_id IS NOT NULL").select("vec_id", "label", v)
    dealt, n = _ragged(vectors, v)
    half = F.lit(n // 2) if n % 2 else F.when(F.col("block") < n // 2, n // 2).otherwise(n // 2 - 1)
    met = _meet(dealt, dealt, F.col("block"), F.col("block") + half, n)

    def best(batches):
        held, b, to_b = None, None, None
        for batch in batches:
            for r in batch.to_dict("records"):
                own = r["block_a"] == r["block_b"]
                longest = np.sort(r["size_a"])[-2:] if own else [r["size_a"].max(), r["size_b"].max()]
                width = int(min(longest)) if len(longest) > 1 else 0  # beyond that no two have a component
                if width == 0:
                    continue
                if held != (r["block_b"], width):
                    if held:
                        yield to_b.rows(b.ids, b.kind)
                    held, b = (r["block_b"], width), _Vectors(r, "b", width)
                    to_b = _Best(len(b.x))
                if own:
                    to_a, each = _Best(len(b.ids)), np.arange(len(b.ids))
                    barred = lambda i, j: (b.ids[i] == b.id1[j]) & b.alone[j]  # noqa: B023, E731
                    for i, j, d in _close((b.x[b.kind], b.has[b.kind]), (b.x, b.has), np.zeros(len(each), bool), b.known, barred):
                        ok = b.known[j]
                        i, j, d = i[ok], j[ok], d[ok]
                        other = b.id1[j] != b.ids[i]
                        to_a.offer(i, d, np.where(other, b.id1[j], b.id2[j]), np.where(other, b.label1[j], b.label2[j]))
                    yield to_a.rows(b.ids, each)
                    continue
                a = _Vectors(r, "a", width)
                to_a = _Best(len(a.x))
                for i, j, d in _close((a.x, a.has), (b.x, b.has), a.known, b.known):
                    ok = b.known[j]
                    to_a.offer(i[ok], d[ok], b.id1[j[ok]], b.label1[j[ok]])
                    ok = a.known[i]
                    to_b.offer(j[ok], d[ok], a.id1[i[ok]], a.label1[i[ok]])
                yield to_a.rows(a.ids, a.kind)
        if held:
            yield to_b.rows(b.ids, b.kind)

    found = met.mapInPandas(best, "query_id long, nearest long, nearest_label long, value double")
    asked = vectors.select(F.col("vec_id").cast("long").alias("query_id"), F.col("label").cast("long").alias("label"))
    nearest = F.when(F.col("nearest").isNotNull(), F.struct("value", "nearest", "nearest_label"))
    top = asked.unionByName(found, allowMissingColumns=True).groupBy("query_id").agg(F.min("label").alias("label"), F.min(nearest).alias("t"))
    return top.select("query_id", "label", "t.nearest", "t.nearest_label", "t.value")
