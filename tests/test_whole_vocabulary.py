"""Training looks at every word: against plain Python over the whole word table."""

from __future__ import annotations

from collections import Counter

from millrace.operators import vocabulary as V
from millrace.sources.tables import table


def train(rows, merges):
    by_lang: dict = {}
    for lang, word, n in rows:
        by_lang.setdefault(lang, []).append([list(word.encode()), n])
    live, out = set(by_lang), []
    while len(out) < merges and live:
        lang = max(sorted(live), key=lambda k: sum(len(w) * n for w, n in by_lang[k]) / sum(n for _, n in by_lang[k]))
        pairs: Counter = Counter()
        for w, n in by_lang[lang]:
            for p in zip(w, w[1:]):
                pairs[p] += n
        best = min(pairs, key=lambda p: (-pairs[p], p), default=None)
        if best is None or pairs[best] < 2:
            live.discard(lang)
            continue
        out.append((*best, 256 + len(out)))
        for of in by_lang.values():
            for row in of:
                row[0] = V._merge(row[0], *out[-1])
    return out


def test_rare_words_count(spark):
    """A pair that only many rare words share beats one of few frequent words."""
    rows = [("a", f"zq{chr(0x4E00 + i)}", 1) for i in range(6000)] + [("a", f"{chr(0x600 + i)}xy", 2) for i in range(1200)] + [("b", "aaaa", 3), ("b", "aaaé", 2), ("c", "x", 5)]
    df = spark.createDataFrame(rows, "lang string, word string, n long")
    assert V.train(df, 12) == train(rows, 12)
    assert (ord("z"), ord("q")) in {m[:2] for m in V.train(df, 3)}


def test_training_equals_plain_python(spark, sf):
    t = V.word_table(table(spark, sf, "documents"))
    rows = [tuple(r) for r in t.select("lang", "word", "n").collect()]
    assert V.train(t, 20) == train(rows, 20)
