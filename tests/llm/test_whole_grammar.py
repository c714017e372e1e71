"""Kernels of the shards do no work twice, and give what plain Python gives."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.llm import grammar


@pytest.fixture
def decoded(monkeypatch):
    """How many ids each call of Shard._decode has made."""
    made, plain = [], grammar.Shard._decode

    def counted(self, symbols):
        out = plain(self, symbols)
        made.append(len(out))
        return out

    monkeypatch.setattr(grammar.Shard, "_decode", counted)
    return made


def test_rules_are_expanded_once(decoded):
    """200 documents of 20 phrases: rules hold few ids, symbols stand for many."""
    rng = np.random.default_rng(3)
    phrases = [rng.integers(0, 5000, 6) for _ in range(20)]
    docs = [np.concatenate([np.append(phrases[k], rng.integers(0, 5000, 3)) for k in rng.integers(0, 20, 15)]) for _ in range(200)]
    ids, sizes = np.concatenate(docs).astype(np.uint32), np.array([len(d) for d in docs])
    assert (grammar.Shard(grammar.write_shard(ids, sizes)).all_ids() == ids).all()
    assert sum(decoded) < len(ids) / 4


def test_rules_within_rules_are_not_all_expanded(decoded):
    """Of two equal documents every round has rules for all ids; together these are many times the documents."""
    one = np.random.default_rng(4).integers(0, 50_000, 4096).astype(np.uint32)
    ids, sizes = np.concatenate([one, one]), np.array([4096, 4096])
    shard = grammar.Shard(grammar.write_shard(ids, sizes))
    assert shard.lengths.sum() > 2 * len(ids)
    assert (shard.all_ids() == ids).all()
    assert sum(decoded) == len(ids)


@pytest.mark.parametrize("bits", [1, 4, 18])
def test_keys_find_their_pairs_in_full_buckets(monkeypatch, bits):
    monkeypatch.setattr(grammar, "_HASH_BITS", bits)
    rng = np.random.default_rng(bits)
    some = rng.choice(1 << 40, 300, replace=False).astype(np.uint64)
    pairs, keys = some[:200], rng.choice(some, 5000)
    where = {p: i for i, p in enumerate(pairs.tolist())}
    got = grammar._index(pairs, keys, grammar._bucket(keys))
    assert got.tolist() == [where.get(k, -1) for k in keys.tolist()]


@pytest.mark.parametrize("ids", [[], [7], [3] * 1000, [1, 2, 3] * 300, list(range(40)) * 5])
def test_expansion_lengths(ids):
    _, _, rules, base = grammar.compress(np.array(ids, np.uint32), np.array([len(ids)]))
    want: list[int] = []
    for a, b in rules.T.tolist():
        want.append(sum(1 if x < base else want[x - base] for x in (a, b)))
    assert grammar._expansion_lengths(rules, base).tolist() == want
    assert (grammar.Shard(grammar.write_shard(np.array(ids, np.uint32), np.array([len(ids)]))).all_ids() == np.array(ids, np.uint32)).all()
