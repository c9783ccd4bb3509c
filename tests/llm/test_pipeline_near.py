import random
from collections import Counter

import corpus_pipeline as c

from test_repeats import LOWER, WORD


def share(a, b, size):
    x, y = ({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} for w in (WORD.findall(t.translate(LOWER)) for t in (a, b)))
    return len(x & y) / len(x | y)


def brute(rows, size=5, least=0.8):
    """Ids that are the smallest of their component."""
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if share(rows[i][1], rows[j][1], size) >= least:
                up[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return Counter(low.values())


def test_near_stage_takes_five_words_and_four_fifths(spark):
    rnd = random.Random(17)
    fresh = lambda n: [f"w{rnd.randrange(10 ** 6)}" for _ in range(n)]
    rows, between, apart = [], [], []
    for k in range(12):
        base = fresh(200)
        added, changed, far = base + fresh(30), base.copy(), base + fresh(70)
        for at in (20, 70, 120, 170):  # 2 % of the words, one by one
            changed[at] = f"x{k}"
        new = added if k % 3 == 0 else changed if k % 3 == 1 else far
        (apart if new is far else between).append((base, new))
        rows += [(100 + 2 * k, " ".join(base)), (101 + 2 * k, " ".join(new))]
    for a, b in between:
        assert share(" ".join(a), " ".join(b), 5) >= 0.8 and share(" ".join(a), " ".join(b), 3) < 0.9
    for a, b in apart:
        assert share(" ".join(a), " ".join(b), 5) < 0.8
    out = c.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    want = brute(rows)
    assert len(want) == len(rows) - len(between)
    assert Counter(r.doc_id for r in out.collect()) == want
