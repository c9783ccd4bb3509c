"""op12: targets against plain water-filling, exact quotas, disjoint draws, reruns."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

import kestrel.llm.mixing as mixing
from kestrel.llm.mixing import Mix, leaves, share_out, word_counts
from kestrel.llm.words import utf8


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights, repeat=3):
    """Bisection on the level per weight instead of rounds."""
    total = sum(sizes)
    lo, hi = 0.0, float(repeat * total + 1)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(mid * w, repeat * s) for s, w in zip(sizes, weights, strict=True)) < total else (lo, mid)
    return [min(hi * w, repeat * s) for s, w in zip(sizes, weights, strict=True)]


@pytest.mark.parametrize("sizes", [[10, 1, 1], [5], [0, 0], [1, 100, 3, 0, 70], [7, 7, 7, 7]])
def test_targets(sizes):
    weights = [i % 3 + 1 for i in range(len(sizes))]
    got = share_out(sizes, weights, 3)
    assert sum(got) == sum(sizes) and all(g <= 3 * s for g, s in zip(got, sizes, strict=True))
    assert [float(g) for g in got] == pytest.approx(targets(sizes, weights), abs=1e-6)
    assert all(isinstance(g, Fraction) for g in got)


def test_tree_counts_are_exact_and_disjoint():
    quotas = np.array([0, 13, 400, 1, 77])
    whole = list(leaves(quotas, 9, 5, 0, 9))
    total = int(quotas.sum())
    assert [k for k, _, _ in whole] == list(range(9))
    assert (sum(c for _, c, _ in whole) == quotas).all()
    assert [int(c.sum()) for _, c, _ in whole] == [total * (k + 1) // 9 - total * k // 9 for k in range(9)]
    for s in range(len(quotas)):
        drawn = [x for _, c, o in whole for x in range(o[s], o[s] + c[s])]
        assert sorted(drawn) == list(range(quotas[s]))
    part = list(leaves(quotas, 9, 5, 3, 5))  # a task's own leaves are the same
    assert all((a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(part, whole[3:5], strict=True))


def test_draws_are_hypergeometric():
    quotas = np.array([30, 50, 20])
    got = np.array([next(leaves(quotas, 4, seed, 0, 1))[1] for seed in range(2000)])
    assert got.mean(axis=0) == pytest.approx([7.5, 12.5, 5.0], abs=0.2)
    p = 0.5
    assert got[:, 1].var() == pytest.approx(25 * p * (1 - p) * 75 / 99, rel=0.12)


def test_word_counts(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(mixing, "BATCH_BYTES", 3)
    texts = [None, "", " ", "a", "aa bb", "\tx\n\x0by ", "é  日本 z", "b" * 11, " c"]
    assert word_counts(*utf8(pa.array(texts))).tolist() == [n_words(t) for t in texts]


def check_mix(base_rows, rows, source_of):
    sizes = Counter()
    for r in base_rows:
        sizes[r[3]] += n_words(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, targets([sizes[s] for s in order], [i % 3 + 1 for i in range(len(order))]), strict=True))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r[0], n_words(r[1])) for r in base_rows)
    taken = defaultdict(int)
    cut = Counter()
    for r in rows:
        assert r.taken <= 3 * r.size
        key = (r.source_size, round(r.target, 3))
        taken[key] += r.taken
        cut[key] += bool(r.size and r.taken % r.size)
    assert sorted(taken) == sorted({(sizes[s], round(want[s], 3)) for s in order})
    same = Counter((sizes[s], round(want[s], 3)) for s in order)
    for key, words in taken.items():
        assert abs(words - key[1] * same[key]) <= 0.5001 * same[key] + 0.01  # the target, rounded
        assert cut[key] <= same[key]  # at most one document of a source is cut


@pytest.mark.parametrize("block", [1 << 16, 300])
def test_whole_table(docs, base_rows, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", block)
    monkeypatch.setattr(mixing, "RUN", 4)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 8)
    mix = Mix(docs, seed=3, carry=("text",))
    rows = mix.taken().collect()
    check_mix(base_rows, rows, None)
    slots = mix.slots().collect()
    places = defaultdict(list)
    for s in slots:
        places[s.shard].append(s.position)
        assert 0 < s.taken <= s.size == n_words(s.text)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(Counter((s.key, s.copy, s["pass"]) for s in slots).values()) == 1
    assert sum(s.taken for s in slots) == sum(r.taken for r in rows)
    if block == 300:
        assert len(places) > 5
        again = Mix(docs.repartition(3, "n_chars"), seed=3).taken().collect()  # other tasks, same result
        assert Counter(again) == Counter(rows)
        other = Mix(docs, seed=4).taken().collect()
        assert Counter(other) != Counter(rows)


def test_repeated_rows_and_small_sources(spark, tmp_path):
    rows = [(1, "a b c", "s")] * 50 + [(2, None, "s"), (3, "", "empty"), (None, "x y", None), (4, "one", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mix = Mix(df, seed=1)
    check_mix([(r[0], r[1], "en", r[2]) for r in rows], mix.taken().collect(), None)
    mix.write(str(tmp_path / "mix"))
    assert spark.read.parquet(str(tmp_path / "mix")).agg({"taken": "sum"}).first()[0] == sum(r.taken for r in mix.taken().collect())


def test_empty_table(no_docs):
    assert Mix(no_docs).taken().collect() == []
