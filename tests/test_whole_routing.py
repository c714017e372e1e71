"""Routing where scores tie, against exact sums."""

from __future__ import annotations

import random
from collections import defaultdict
from fractions import Fraction

from millrace.plans.registry import queries


def test_equal_scores_go_by_name(spark, tmp_path):
    deal, rows = random.Random(5), []
    for tok in range(200):
        s = deal.randrange(30_000, 60_000)
        for expert, cents in (("c", 2 * s), ("b", s), ("a", s)):
            cuts = [0, *sorted(deal.randrange(cents + 1) for _ in range(12)), cents]
            rows += [(tok, expert, (y - x) / 100) for x, y in zip(cuts, cuts[1:])]
    rows += [(-1, "a", 1e300), (-1, "b", float("inf")), (-1, "c", None), (-2, "a", 1e300), (-2, "b", 1e-30), (-2, "c", 0.5)]
    deal.shuffle(rows)
    spark.createDataFrame(rows, "user_id long, event_type string, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["tok"], r["expert"]): r["w"] for r in queries()["topk_routing"](spark, str(tmp_path)).collect()}
    score: dict = defaultdict(lambda: defaultdict(Fraction))
    for tok, expert, v in rows:
        if tok >= 0:
            score[tok][expert] += Fraction(str(v))
    want = {}
    for tok, by in score.items():
        best = sorted(by, key=lambda e: (-by[e], e))[:2]  # noqa: B023
        want |= {(tok, e): round(float(by[e] / sum(by[x] for x in best)), 6) for e in best}
    assert {k: w for k, w in got.items() if k[0] >= 0} == want
    assert {k[1] for k in got if k[0] == -1} == {"a", "b"} and {k[1] for k in got if k[0] == -2} == {"a", "c"}
