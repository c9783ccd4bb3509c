"""op13 against brute force, with flushes, segments and partitions of every size."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import kestrel.llm.phrases as phrases
from kestrel.llm.phrases import Summary, collocations, scored

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, threshold=10, inside=50, first=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= threshold}
        top = []
        for p, a in cand.items():
            if any(len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= inside * a for q, b in cand.items() if len(q) > len(p)):
                continue
            s, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            top.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(top)[:first], 1)]
    return sorted(out)


@pytest.mark.parametrize("flush,piece,part", [(1_500_000, 1 << 20, 1 << 25), (50, 300, 20_000), (3, 1 << 20, 1 << 22)])
def test_whole_table(spark, docs, base_rows, monkeypatch, flush, piece, part):
    monkeypatch.setattr(phrases, "FLUSH_WORDS", flush)
    monkeypatch.setattr(phrases, "PIECE_BYTES", piece)
    monkeypatch.setattr(phrases, "PART_BYTES", part)
    monkeypatch.setattr(phrases, "MERGE", 500)
    if flush == 3:  # every word or so is a flush: fewer rows
        base_rows = [r for r in base_rows if len(r[1] or "") < 3000][:60]
        docs = spark.createDataFrame([(r[2], r[1]) for r in base_rows], "lang string, text string").repartition(2)
    got = collocations(docs, threshold=4, first=50)
    assert got.columns == NAMES
    want = brute([(r[2], r[1]) for r in base_rows], threshold=4, first=50)
    assert len(want) > 20
    assert sorted(tuple(r) for r in got.collect()) == want


def test_words_with_equal_hashes(spark, monkeypatch):
    real = phrases.span_hashes
    monkeypatch.setattr(phrases, "span_hashes", lambda raw, solid, begin, seeds: [h % np.uint64(3) if k == 0 else h for k, h in enumerate(real(raw, solid, begin, seeds))])
    rows = [("en", f"w{i % 7} w{i % 5} w{i % 3}, x{i % 11} y") for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert sorted(tuple(r) for r in collocations(df, threshold=5).collect()) == brute(rows, threshold=5)


def test_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(3)
    keys = np.concatenate([rng.zipf(1.3, 60_000) % 5000, np.repeat(7777, 10), rng.integers(10_000, 60_000, 30_000)]).astype(np.uint32)
    rng.shuffle(keys)
    for threshold in (10, 50):
        s = Summary(len(keys), threshold)
        for part in np.array_split(keys, 37):
            s.add(*(x.astype(t) for x, t in zip(np.unique(part, return_counts=True), (np.uint32, np.int64), strict=True)))
            s.merge()
            assert len(s.keys) <= s.capacity
        own, counts = np.unique(keys, return_counts=True)
        assert set(own[counts >= threshold]) <= set(s.keys)
        assert len(s.keys) < len(own)


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**14
    rows = [("en", "a", 1, 5 * big), ("en", "b", 1, 7 * big + 1), ("en", "c", 1, 2 * big + 5), ("en", "a b", 2, 2 * big), ("en", "b c", 2, big + 1), ("en", "a b c", 3, big - 7)]
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in scored(spark.createDataFrame(rows, "lang string, phrase string, size int, f long"), 50).collect()}
    f = {p: n for _, p, _, n in rows}
    assert set(got) == {"a b", "a b c"}  # "b c" is mostly inside the longer one
    assert got["a b"] == (f["a b"], f["a"], f["b"], 10**6 * f["a b"] ** 2 // (f["a"] * f["b"]))
    cuts = [(10**6 * f["a b c"] ** 2 // (f[x] * f[y]), f[x], f[y]) for x, y in (("a", "b c"), ("a b", "c"))]
    assert got["a b c"] == (f["a b c"], *min(cuts, key=lambda c: c[0])[1:], min(cuts)[0])


def test_ties_at_the_last_rank(spark):
    rows = [("en", f"p{i} q{i}") for i in range(40) for _ in range(12)] + [(None, "x y")] * 10
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations(df, first=7).collect()) == brute(rows, first=7)


def test_empty(no_docs):
    assert collocations(no_docs).collect() == []


def test_rows_hold_what_they_say():
    keys = np.array([0, 5, 5, 2**32 - 1], np.uint64)
    assert (np.cumsum(phrases.unplanes(phrases.planes(np.diff(keys, prepend=np.uint64(0)))).astype(np.int64)) == keys).all()
    assert phrases.opened(phrases.parcels(b"", b"abc", b"x")) == [b"", b"abc", b"x"]
    assert phrases.widened(phrases.narrow(np.array([1, 70_000])), 2).tolist() == [1, 70_000]
