"""The bounded dense run against a full matrix product; rewards from text with their second pass."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import retrieval as RT

NO_EX = "qid bigint, doc_id bigint"


def brute(qv, dv, excluded, k):
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    s = np.round(unit(qv) @ unit(dv).T, 9) + 0.0
    return {i: [(float(-v), j) for v, j in sorted((-s[i, j], j) for j in range(len(dv)) if (i, j) not in excluded)[:k]] for i in range(len(qv))}


def answer(df, k):
    w = RT.top_k(df.withColumn("score", F.round("score", 9) + F.lit(0.0)), k)
    got = {}
    for r in w.collect():
        got.setdefault(r.qid, []).append((r.score, r.doc_id))
    return {q: sorted(v, key=lambda x: (-x[0], x[1])) for q, v in got.items()}


def frames(spark, qv, dv):
    rows = lambda m: [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return (spark.createDataFrame(rows(qv), "qid bigint, vec array<double>"),
            spark.createDataFrame(rows(dv), "doc_id bigint, vec array<double>").repartition(4))


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 12))
    dv = np.repeat(centres, 50, axis=0) + 0.05 * rng.normal(size=(3000, 12))
    dv[17] = 0
    dv[100:140] = dv[100]  # equal documents
    qv = centres[:20] + 0.05 * rng.normal(size=(20, 12))
    qv[3] = 0
    return qv, dv


@pytest.mark.parametrize("k", [1, 10, 300])
def test_same_as_full_product(spark, clustered, monkeypatch, k):
    monkeypatch.setattr(RT, "BLOCK_DOCS", 40)
    qv, dv = clustered
    ex = {(i, j) for i in range(0, 20, 2) for j in range(50 * i, 50 * i + 30)} | {(5, 999_999)}
    qs, ds = frames(spark, qv, dv)
    got = answer(RT.dense_run(qs, ds, spark.createDataFrame(sorted(ex), NO_EX), k, max_queries=7), k)
    want = brute(qv, dv, ex, k)
    assert {q: [j for _, j in v] for q, v in got.items()} == {q: [j for _, j in v] for q, v in want.items()}


def test_few_cells_are_visited(spark, clustered):
    qv, dv = clustered
    qs, ds = frames(spark, qv, dv)
    index = RT.DenseIndex(ds, order="doc_id")
    RT.dense_run(qs, ds, spark.createDataFrame([], NO_EX), 10, index=index).collect()
    met = index.visited.filter(F.col("q") != 3).join(spark.createDataFrame(index.cells[["cell", "n"]]), "cell").agg(F.sum("n")).first()[0]
    assert index.visited.count() == index.visited.distinct().count()
    assert 5 * met < 19 * len(dv), met  # of all pairs of a query and a document


def test_empty_sides_and_missing_vectors(spark):
    qs, ds = frames(spark, np.ones((2, 3)), np.ones((4, 3)))
    none = spark.createDataFrame([], NO_EX)
    assert RT.dense_run(qs, ds.limit(0), none, 3).collect() == []
    assert RT.dense_run(qs.limit(0), ds, none, 3).collect() == []
    holes = ds.withColumn("vec", F.when(F.col("doc_id") > 1, F.col("vec")))
    assert sorted((r.qid, r.doc_id) for r in RT.dense_run(qs, holes, none, 3).collect()) == [(0, 2), (0, 3), (1, 2), (1, 3)]


def test_gated_reward_searches_again_with_the_full_response(spark):
    enc = RT.hashed_bow_encoder(64, element="double")
    texts = ["red fox runs far away", "blue whale swims deep", "green tree grows tall", "old house stands empty"] + [f"filler{i} zz word{i}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").select("doc_id", enc(F.col("text")).alias("vec"))
    qrels = spark.createDataFrame([(i, i, 1) for i in range(4)], "qid bigint, doc_id bigint, rel int")
    good, wrong = "Assistant: <think>a</think><query>blue whale swims deep</query>", "Assistant: blue whale"
    again = f"Assistant: <think>{' '.join([texts[0]] * 5)}</think><query>zz</query>"
    lost = f"Assistant: <think> {'zz ' * 20} </think><query>zz</query>"
    rows = [(1, 1, good), (2, 1, wrong), (3, 0, again), (4, 3, lost), (5, 99, good), (6, 2, None)]
    df = spark.createDataFrame(rows, "rollout_id bigint, qid bigint, response string")
    got = {r.rollout_id: r.reward for r in RT.gated_dense_reward(df, docs, qrels, spark.createDataFrame([], NO_EX), enc).collect()}
    assert got.keys() == {1, 2, 3, 4, 6}  # item 99 has no relevant document
    assert got[1] == 1.0 and got[2] == -1.0 and got[6] == -1.0
    assert got[3] in {0.5 / math.log2(i + 1) for i in range(1, 11)} and got[4] == 0.0
    plain = {r.rollout_id: r.reward for r in RT.dense_reward(
        spark.createDataFrame([(1, 2, f"x{RT.CHAT_MARK}green tree grows tall"), (2, 2, "green tree grows tall")], df.schema), docs, qrels, spark.createDataFrame([], NO_EX), enc).collect()}
    assert plain == {1: 1.0, 2: 1.0}


def test_encoder_counts_runs(spark):
    import hashlib
    text = "a b b  c\na a a d" + " e" * 300
    want = np.zeros(16)
    for w in text.split():
        want[int(hashlib.md5(f"3:{w}".encode()).hexdigest()[:7], 16) % 16] += 1
    enc = RT.hashed_bow_encoder(16, 3, "double")
    rows = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(enc(F.col("t")).alias("v")).collect()
    assert rows[0].v == pytest.approx((want / np.linalg.norm(want)).tolist())
    assert rows[1].v == rows[2].v == [0.0] * 16
