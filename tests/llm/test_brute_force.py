"""Operators of the llm subpackage against plain Python that does the whole job the long way."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import fingerprints, langid, mixing, oracles, packing, secretscan, urls
from millrace.llm.registry import RULES, tokenizer_path
from tests.llm.test_llm_operators import ASSIGN, base_spans, ids_of, library, rows_of  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def planted_pages(n=1000, seed=2):
    """Chains, stars and cycles of redirects and canonical links over hosts with and without rules."""
    rng = random.Random(seed)
    hosts = ["a.org", "b.net", "www.example.com", "example.com", "x.example.com", "c.io", "sub.b.net", "d.com", "e.org", "f.org", "g.org"]
    paths = ["/es/", "/fr/", "/en/", "/x/", "/"]
    urls_ = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}{i}" for i in range(n)]
    pages = []
    for i, u in enumerate(urls_):
        kind, there = rng.random(), None
        if kind < 0.25 and i % 50:  # a chain
            there = urls_[i - 1]
        elif kind < 0.4:  # a star
            there = urls_[i - i % 50]
        elif kind < 0.45:
            there = rng.choice(urls_)
        html = "<p>text</p>"
        if there and rng.random() < 0.5:
            html = f'<head><link rel="canonical" href="{there}"></head>'
        elif there:
            html = f'<meta http-equiv="refresh" content="0; url={there}">'
        if rng.random() < 0.03:
            html += f'<link rel="canonical" href="/{rng.choice(["x", "en", "es"])}/{rng.randrange(n)}">'
        pages.append((i, u, html))
    return pages


def parts_of(url):
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return host.lower(), re.match("[^?#]*", rest[len(host):])[0]


def test_op2_planted_links_against_reachability_and_sql(spark):
    pages = planted_pages()
    rule = lambda host, path: max((r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(r.text), default=None)
    node = lambda u: parts_of(u)
    near = defaultdict(set)
    for _, u, html in pages:
        for m in re.finditer(r'(?:href="|url=)([^"]+)"', html):
            there = m[1] if "://" in m[1] else f"http://{parts_of(u)[0]}{m[1]}"
            near[node(u)].add(node(there))
            near[node(there)].add(node(u))
    passed_on, done = {}, set()
    for start in list(near):
        if start in done:
            continue
        seen, stack = {start}, [start]
        while stack:
            for x in near[stack.pop()] - seen:
                seen.add(x)
                stack.append(x)
        own = [r.verdict for x in seen if (r := rule(*x))]
        for x in seen:
            passed_on[x] = "allow" if "allow" in own else "block" if own else None
        done |= seen
    want = {}
    for i, u, _ in pages:
        host, path = parts_of(u)
        r = rule(host, path)
        want[i] = (host, path, r and r.text, r.verdict if r else passed_on.get((host, path)) or "allow")
    inherited = [i for i, u, _ in pages if not rule(*parts_of(u)) and passed_on.get(parts_of(u))]
    assert len(inherited) > 50 and {want[i][3] for i in inherited} == {"allow", "block"}
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(spark, df, RULES).collect()}
    assert got == want
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    told = con.sql(oracles.op2(RULES))
    assert {r[0]: r[1:] for r in told.fetchall()} == {i: tuple(None if x is None else x for x in w) for i, w in want.items()} and told.columns == ["page_id", "host", "path", "rule", "verdict"]


def digest_by_hand(text):
    data = text.encode()
    grams = [data[i:i + 3] for i in range(len(data) - 2)] or ([data.ljust(3, b"\0")] if data else [])
    count = [0] * 256
    for g in grams:
        count[(int.from_bytes(g, "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 24] += 1
    q = sorted(count)
    codes = [sum(c > q[k] for k in (63, 127, 191)) for c in count]
    return min(255, round(8 * float(np.log2(len(data) + 1)))), codes


def likeness_by_hand(x, y):
    (m, a), (n, b) = digest_by_hand(x), digest_by_hand(y)
    if max(m, n) <= 16:
        return float((m, a) == (n, b))
    apart = sum(abs(p - q) for p, q in zip(a, b, strict=True)) / 256 / 1.25
    return max(0.0, 1 - (0.9 * apart + 0.1 * min(abs(m - n) / 32, 1)))


def test_op6_likeness_by_hand(spark, edges, sample):
    for docs in (edges, sample.limit(60)):
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        rows = sorted(rows_of(docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
        texts, want = [t or "" for _, t in rows], []
        for k, (i, _) in enumerate(rows):
            t, nxt = texts[k], texts[(k + 1) % len(texts)]
            edited = t[:len(t) - len(t) // 3] + nxt[:len(t) // 3]
            code = lambda x: bytes([digest_by_hand(x)[0]]) + bytes(a << 6 | b << 4 | c << 2 | d for a, b, c, d in np.reshape(digest_by_hand(x)[1], (-1, 4)).tolist())
            want.append((i, hashlib.sha256(edited.encode()).hexdigest(), code(t).hex(), code(edited).hex(), round(likeness_by_hand(t, edited), 5), round(likeness_by_hand(t, nxt), 5)))
        got = [(r["doc_id"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 5), round(r["near_next"], 5)) for r in fingerprints.compare(spark, docs).collect()]
        assert Counter(x[:4] for x in got) == Counter(x[:4] for x in want)
        assert sorted(got, key=str) == [tuple(pytest.approx(v, abs=2e-5) if isinstance(v, float) else v for v in w) for w in sorted(want, key=str)]


def test_op6_short_texts():
    d = fingerprints.fingerprint(fingerprints.pa.array(["ab", "zz", "ab", "", "", "abc", "abd"]))
    near = lambda i, j: fingerprints.likeness(d[i:i + 1], d[j:j + 1])[0]
    assert near(0, 1) == 0 and near(0, 2) == 1 and near(3, 4) == 1 and near(0, 3) == 0 and near(5, 6) == 0


def spans_by_hand(text):
    """All pairs of spans of a text, positions and all."""
    weak = []
    for k, kind in enumerate(secretscan.KINDS):
        if not kind.strong:
            weak += [(m.start(), k, m.end()) for m in re.finditer(kind.pattern, text, re.A)]
    strong = [(a, k, b) for a, k, b in base_spans(text)]
    part = lambda k: secretscan.KINDS[k].part
    every, kept = strong + weak, list(strong)
    for a, k, b in weak:
        near = [(s, j, e) for s, j, e in every if s <= b + secretscan.SCOPE and e >= a - secretscan.SCOPE]
        apart = {part(j) for s, j, e in near if not (s < b and e > a)}
        covered = any(secretscan.KINDS[j].strong and s < b and e > a for s, j, e in near)
        needs = {"id": {"secret"}, "secret": {"id"}, "endpoint": {"id", "secret"}}[part(k)]
        if not covered and needs <= apart:
            kept.append((a, k, b))
    return ",".join(f"{secretscan.KINDS[k].name}:{a}:{b}" for a, k, b in sorted(kept))


def test_op7_links_by_hand(spark):
    rng = random.Random(7)
    bits = ["client_id=web1", "user_name: someone@x.org", "q9w8e7r6t5y4u3", "AKIA" + "Z9" * 8, "password=hunter2222", "https://h.example/a?b=1", "0123456789abcdef01234567", "postgres://u@h/db", "login=ab", "x" * 90 + "1"]
    rows = []
    for i in range(250):
        pieces = []
        for _ in range(rng.randrange(1, 9)):
            pieces.append(rng.choice(bits))
            pieces.append(" é😀 " * rng.randrange(0, 60) if rng.random() < 0.7 else rng.choice([" ", "\n", ", "]))
        rows.append((i, "".join(pieces)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secretscan.digests(secretscan.scan(spark, df, keep=["doc_id"])).collect()}
    assert got == {i: spans_by_hand(t) for i, t in rows}
    assert sum("weak" in s for s in got.values()) > 30 and sum("endpoint" in s for s in got.values()) > 10


def bundle_by_hand(text):
    total = np.zeros(langid.DIMENSIONS)
    words = " ".join("".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split())
    padded = f" {words} "
    vector = lambda ch, by: np.roll(langid.letter_vector(ord(ch) if ch != " " else 0), by).astype(float)
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        total += vector(a, 2) * vector(b, 1) * vector(c, 0)
    return total / max(np.linalg.norm(total), 1e-9)


def test_op9_by_hand(spark, sample):
    docs = spark.createDataFrame(sample.where("length(text) < 3000").limit(60).collect(), sample.schema)
    rows = docs.select("doc_id", "text", "lang").collect()
    learned = defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and langid.crc_of(r["doc_id"]) % 3 != 1:
            learned[r["lang"]] += bundle_by_hand(r["text"])
    langs = sorted(learned)
    table = np.stack([learned[k] / np.linalg.norm(learned[k]) for k in langs])
    table = table - table.mean(axis=0)
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    mean = np.mean([learned[k] / np.linalg.norm(learned[k]) for k in langs], axis=0)
    prototypes = langid.learn(spark, docs.where(~langid.held_out(F.col("doc_id"))).select("text", "lang"))
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark, docs.select("doc_id", "text"), prototypes).collect()}
    checked = 0
    for r in rows:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert told[r["doc_id"]] == ("und", 0)
            continue
        v = bundle_by_hand(r["text"]) - mean
        cosine = table @ (v / np.linalg.norm(v))
        best = np.sort(cosine)
        assert told[r["doc_id"]][1] == pytest.approx(max(0, best[-1]), abs=1e-4)
        if len(best) < 2 or best[-1] - best[-2] > 1e-4:
            assert told[r["doc_id"]][0] == langs[int(cosine.argmax())]
            checked += 1
    assert checked > 20


def test_op9_and_op5_names_that_clash(spark, sample):
    named = sample.selectExpr("doc_id", "text", "lang", "source", "1 AS score", "2 AS LANG_PRED", "3 AS taken", "4 AS target", "5 AS rank")
    told = langid.predict(spark, named, {})
    assert told.columns == ["doc_id", "text", "lang", "source", "taken", "target", "rank", "lang_pred", "score"] and {r[0] for r in told.select("score").collect()} == {0.0}
    mixed = mixing.mix(spark, named, [1, 2, 3], 3, keep=["doc_id", "taken", "target", "rank", "score"])
    assert mixed.columns == ["doc_id", "rank", "score", "size", "source_size", "target", "taken"] and mixed.where("rank = 5 AND score = 1").count() == sample.count()
    spans = secretscan.scan(spark, named.withColumn("spans", F.lit("x")), keep=["doc_id", "spans", "rank"])
    assert spans.columns == ["doc_id", "rank", "spans"]


def windows_by_hand(sizes, size, most, cut_gap):
    """Best fit into open windows, one document after the other; (document, start, length) of each closed window, and of the open ones."""
    closed, open_ = [], []
    for doc, n in enumerate(sizes):
        start = 0
        while n - start >= size:
            closed.append([(doc, start, size)])
            start += size
        while start < n:
            left = n - start
            fit = [w for w in open_ if w[0] >= left]
            if fit:
                w = min(fit, key=lambda w: w[0])
            elif len(open_) < most:
                w = [size, []]
                open_.append(w)
            else:
                w = min(open_, key=lambda w: w[0])
                open_.remove(w)
                if w[0] >= cut_gap:
                    w[1].append((doc, start, w[0]))
                    start += w[0]
                closed.append(w[1])
                continue
            w[1].append((doc, start, left))
            w[0] -= left
            start = n
            if not w[0]:
                open_.remove(w)
                closed.append(w[1])
    return closed, [w[1] for w in open_]


@pytest.mark.parametrize("seed", range(4))
def test_op10_placement_by_hand(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60 if seed % 2 else 400, 500).tolist()
    w, got = packing.Windows(128, 5, 8), []
    for doc, n in enumerate(sizes):
        got += [[(d, start, len(ids)) for d, start, ids, _ in window] for window in w.add(doc, 0, np.arange(n, dtype=np.uint32), n)]
    closed, left = windows_by_hand(sizes, 128, 5, 8)
    assert got == closed and [[(d, start, len(ids)) for d, start, ids, _ in window] for window in w.pieces] == left


def test_op10_leftovers_are_merged(spark, sample, library):  # noqa: F811
    """Every sequence but the last of a merged group is full to less than the gap that is cut."""
    pieces = packing.pack(spark, sample, tokenizer_path()).collect()
    used = Counter()
    for r in pieces:
        used[r["sequence_id"]] += r["length"]
    total = sum(len(ids_of(library, t)) for _, t in rows_of(sample))
    assert sum(used.values()) == total and sum(n < 1024 - packing.CUT_GAP for n in used.values()) <= 1


def test_pipeline_by_hand(spark, sample, tmp_path, library):  # noqa: F811
    """Every stage's rows are those that plain Python makes of the rows before."""
    import corpus_pipeline as p
    from millrace.llm.common import materialize
    from tests.llm.test_llm_operators import check_pieces, jaccard_links, water

    folder = str(tmp_path)
    sample.select(*p.COLUMNS).write.parquet(f"{folder}/documents.parquet")
    docs, tables = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in p.STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, folder), "stage")
        tables.append([tuple(r) for r in docs.collect()])
    told, single, masked, mixed = tables
    assert Counter((i, t) for i, t, *_ in told) == Counter((i, t) for i, t in rows_of(sample) if any(c.isalpha() for c in t or ""))
    groups = jaccard_links([(r[0], r[1]) for r in told])
    assert sorted(r[0] for r in single) == sorted({g for _, g, _ in groups}) and {r[0] for r in single} < {r[0] for r in told}
    assert set(single) <= set(told)
    want = {}
    for i, text, *_ in single:
        out, at = [], 0
        merged = []
        for a, b in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans_by_hand(text).split(",") if x):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            out += [text[at:a], "[SECRET]"]
            at = b
        want[i] = "".join(out) + text[at:]
    assert {r[0]: r[1] for r in masked} == want and all(r[4] == len(r[1]) for r in masked)
    sizes = Counter()
    for r in masked:
        sizes[r[3]] += len(WORD.findall(r[1]))
    goal, got = water(sizes, [1, 2, 3], 3), Counter()
    for r in mixed:
        got[r[3]] += len(WORD.findall(r[1]))
        full = want[r[0]]
        assert r[1] == full or WORD.findall(full)[:len(WORD.findall(r[1]))] == WORD.findall(r[1])
    assert all(abs(got[s] - goal[s]) <= 1 for s in goal) and max(Counter(r[0] for r in mixed).values()) <= 3
    check_pieces(p.STAGES[-1][1](spark, docs, folder).collect(), [(r[0], r[1]) for r in mixed], library)
