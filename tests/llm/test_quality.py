import itertools
import zlib

import numpy as np

from kestrel.llm.quality_crf import Chains, line_stats, score_quality, with_neighbours


def test_line_stats():
    stats, chars, text = line_stats(["a b\n\nAB ab\na b", "", " \n x", "foo foo bar #"])
    assert text.tolist() == [0, 0, 0, 2, 3] and chars.tolist() == [3, 5, 3, 2, 13]
    assert stats[:, 8].tolist() == [0, 0, 1, 0, 0]          # equal to an earlier line
    assert np.allclose(stats[4, 2:4], [3 / 4, 1 / 4])       # distinct and repeated words
    assert line_stats([])[0].shape == line_stats(["", "\n"])[0].shape == (0, 12)
    one = line_stats(["x y z\nw", "long " * 5000])
    assert np.allclose(one[0][:2], line_stats(["x y z\nw"])[0])


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    text = np.array([0, 0, 0, 0, 1, 2, 2])
    emit, trans = rng.normal(size=(7, 2)), rng.normal(size=(2, 2))
    p, pair, z = Chains(text).marginals(emit, trans)
    want, pairs, logz = np.zeros((7, 2)), np.zeros((2, 2)), 0.0
    for t in range(3):
        at = np.flatnonzero(text == t)
        paths = list(itertools.product((0, 1), repeat=len(at)))
        s = np.array([np.exp(sum(emit[i, y] for i, y in zip(at, path, strict=True)) + sum(trans[a, b] for a, b in itertools.pairwise(path))) for path in paths])
        logz += np.log(s.sum())
        for path, w in zip(paths, s / s.sum(), strict=True):
            for i, y in zip(at, path, strict=True):
                want[i, y] += w
            for a, b in itertools.pairwise(path):
                pairs[a, b] += w
    assert np.allclose(p, want) and np.allclose(pair, pairs) and np.isclose(z, logz)
    x = with_neighbours(np.arange(7.0)[:, None], text)
    assert x[4].tolist() == [4, 0, 0, 1] and x[1].tolist() == [1, 0, 2, 1]


def test_scores(spark, docs, no_docs, base_rows):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = score_quality(big, labels)
    m = got.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in m) >= 0.95 * len(m) > 30
    rows = score_quality(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).collect()
    assert len(rows) == len(base_rows)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert len({r.score for r in rows if r.doc_id in (1000, 1001, 1002)}) == 1
    assert score_quality(no_docs, labels).count() == 0
    none = labels.limit(0)
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5}
