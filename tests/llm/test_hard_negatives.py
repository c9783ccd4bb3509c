"""op11 against brute force: nulls, non-finite values, repeated rows and ids, short and empty vectors, ties."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from kestrel.llm.hard_negatives import inner_products, mine, plane_bytes, plane_values, subset_sums

COLUMNS = "vec_id long, embedding array<float>, label int, row string, a int, id int, score int, rank int"


def brute(rows, every, positives=5, negatives=10, low=30, high=90):
    f32 = lambda x: float(np.float32(x))
    used = [(i, lab, [math.floor(256 * f32(x)) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda p, q: sum(x * y for x, y in zip(p, q, strict=False))  # noqa: E731  the shorter is padded with zeros
    out = []
    for k, (i, lab, v) in enumerate(used):
        if i % every:
            continue
        others = sorted((-dot(v, w), j, m) for n, (j, m, w) in enumerate(used) if n != k)
        for s, j, m in [o for o in others if o[2] == lab][:positives]:
            fit = [(t, n) for t, n, m2 in others if m2 != lab and 30 * -s <= 100 * -t <= 90 * -s] if (low, high) == (30, 90) else []
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(fit[:negatives], 1)]
    return Counter(out)


def odd_vectors(seed):
    rnd = random.Random(seed)
    vec = lambda n=10: [rnd.uniform(-1, 1) + 0.4 for _ in range(n)]
    rows = [(i, vec(), rnd.randrange(3)) for i in range(150)]
    twin = vec()
    rows += [(200, twin, 1)] * 4 + [(201, twin, 2)] * 12 + [(202, twin, 0)] * 3   # repeated anchors and rows, ties
    rows += [(0, vec(), 1), (10, vec(), 2), (10, vec(), 2)]                      # ids given twice
    rows += [(300, None, 1), (310, vec(), None), (None, vec(), 1), (320, [1.0, None], 1), (330, [float("nan")], 1),
             (340, [float("inf"), 1.0], 0), (350, [], 1), (360, [0.5, -0.25], 2), (370, [0.0] * 10, 0), (-10, vec(), 2), (380, vec(23), 0)]
    rnd.shuffle(rows)
    return rows


def result(df):
    return Counter(tuple(r) for r in df.collect())


def test_lookup_tables_give_the_inner_products():
    rnd = np.random.default_rng(1)
    a, c = rnd.integers(-700, 700, (5, 24)), rnd.integers(-1024, 1024, (40, 24))
    planes = plane_bytes(c, 11)
    assert (plane_values(planes) == c).all()
    assert (inner_products(subset_sums(a, np.int64), planes) == a @ c.T).all()


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    if small:  # many cells
        import kestrel.llm.hard_negatives as h
        monkeypatch.setattr(h, "CANDIDATES", 60)
        monkeypatch.setattr(h, "ANCHORS", 7)
        monkeypatch.setattr(h, "TOGETHER", 3)
    rows = odd_vectors(3)
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], COLUMNS).repartition(4)
    got = mine(df, every=10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, 10)
    assert sum(want.values()) > 100
    assert result(got) == want


def test_empty_and_without_anchors(spark):
    assert mine(spark.createDataFrame([], COLUMNS)).count() == 0
    one = spark.createDataFrame([(1, [1.0], 1, "x", 1, 2, 3, 4), (100, None, 1, "x", 1, 2, 3, 4)], COLUMNS)
    assert mine(one).collect() == []


def test_too_large_values_are_refused(spark):
    df = spark.createDataFrame([(100, [1e30], 1, "x", 1, 2, 3, 4)], COLUMNS)
    with pytest.raises(ValueError, match="64 bits"):
        mine(df)
