from pyspark.sql import functions as F
"""BM25 run with zero fill and nDCG against a brute-force Python version."""

import math

import pytest
import regex

from kestrel.operators import retrieval as RT
from kestrel.operators.batch import index_within

DOCS = [(0, "apple banana"), (1, "banana cherry cherry"), (2, "dog"), (3, "apple apple apple pie"),
        (4, "the of and"), (5, "cherry pie"), (6, "egg"), (7, "fig apple")]
QUERIES = [(10, "apple pie"), (11, "cherry"), (12, "unknownword")]
EXCLUDED = [(10, 3), (11, 6)]
QRELS = [(10, 7, 1), (10, 2, 1), (11, 5, 2), (11, 0, 1), (12, 4, 1)]
K, CUT, K1, B = 5, 3, 0.9, 0.4


def toks(t):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w and w not in RT.STOPWORDS_EN]


def brute():
    dt = {d: toks(t) for d, t in DOCS}
    n = len(DOCS)
    avgdl = sum(len(v) for v in dt.values()) / n
    df = {}
    for v in dt.values():
        for w in set(v):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    runs, nd = {}, {}
    for q, text in QUERIES:
        qt = [w for w in toks(text) if w in df]
        ql = len(qt)
        wq = {w: idf[w] * qt.count(w) / (qt.count(w) + K1 * (1 - B + B * ql / avgdl)) for w in set(qt)}
        scores = []
        for d, _ in DOCS:
            if (q, d) in EXCLUDED:
                continue
            s = sum(wq[w] * idf[w] * dt[d].count(w) / (dt[d].count(w) + K1 * (1 - B + B * len(dt[d]) / avgdl))
                    for w in wq)
            scores.append((round(s, 9), d))
        run = sorted(scores, key=lambda x: (-x[0], x[1]))[:K]       # ties in corpus order
        runs[q] = [d for _, d in run]
        ev = sorted(run, key=lambda x: (x[0], str(x[1])), reverse=True)[:CUT]   # score desc, id desc
        rel = {d: r for qq, d, r in QRELS if qq == q}
        dcg = sum(rel.get(d, 0) / math.log2(i + 2) for i, (_, d) in enumerate(ev))
        ideal = sorted(rel.values(), reverse=True)[:CUT]
        idcg = sum(r / math.log2(i + 2) for i, r in enumerate(ideal))
        nd[q] = dcg / idcg
    return runs, nd


def test_bm25_run_and_ndcg(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string").selectExpr("*", "'all' AS task")
    qs = spark.createDataFrame(QUERIES, "qid bigint, text string").selectExpr("*", "'all' AS task")
    docs, qs = RT.tokenize(docs), RT.tokenize(qs)
    post = RT.postings(docs)
    stats = RT.corpus_stats(docs)
    qw = RT.query_weights(qs, post, stats, k1=K1, b=B)
    scores = RT.bm25_scores(qw, post, k1=K1, b=B).selectExpr("task", "qid", "doc_id", "round(score, 9) AS score")
    pos = index_within(docs.select("task", "doc_id"), "task", "doc_id", "doc_order")
    ex = spark.createDataFrame(EXCLUDED, "qid bigint, doc_id bigint")
    run = RT.ranked_run(scores, qs, ex, pos, K)
    got = {}
    for r in run.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.doc_id)
    qr = spark.createDataFrame(QRELS, "qid bigint, doc_id bigint, rel int")
    nd = {r.qid: r.ndcg for r in RT.ndcg_at_k(run, qr, CUT).collect()}
    runs, exp_nd = brute()
    assert got == runs
    assert nd == pytest.approx(exp_nd)


def test_postings_in_row_counts(spark):
    docs = spark.createDataFrame([(1, "y x y z y"), (2, ""), (3, "the of")], "doc_id bigint, text string") \
        .selectExpr("*", "'t0' AS task")
    docs = RT.tokenize(docs)
    got = sorted((r.doc_id, r.term, r.tf, r.dl) for r in RT.postings(docs).collect())
    assert got == [(1, "x", 1, 5), (1, "y", 3, 5), (1, "z", 1, 5)]
    st = RT.corpus_stats_from_postings(RT.postings(docs), docs.select("task", "doc_id")).first()
    assert st.n_docs == 3 and st.avgdl == pytest.approx(5 / 3)


def test_dense_topk_across_batches(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    qv, dv = rng.normal(size=(5, 8)), rng.normal(size=(60, 8))
    qs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(qv)], "qid bigint, vec array<double>")
    ds = spark.createDataFrame([(100 + j, [float(x) for x in v], j) for j, v in enumerate(dv)],
                               "doc_id bigint, vec array<double>, doc_order bigint").repartition(2)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = RT.dense_run(qs, ds, spark.createDataFrame([], "qid bigint, doc_id bigint"), k=4, max_queries=2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    cos = (qv / np.linalg.norm(qv, axis=1)[:, None]) @ (dv / np.linalg.norm(dv, axis=1)[:, None]).T
    got = {}
    for r in out:
        got.setdefault(r.qid, []).append((r.score, r.doc_id))
    for i in range(5):
        best = sorted(got[i], reverse=True)[:4]
        exp = sorted(((cos[i, j], 100 + j) for j in range(60)), reverse=True)[:4]
        assert [d for _, d in best] == [d for _, d in exp]


def test_same_query_id_in_two_tasks(spark):
    scores = spark.createDataFrame([("a", 1, 10, 0.5), ("a", 1, 11, 0.4), ("b", 1, 10, 0.9), ("b", 1, 12, 0.1)],
                                   "task string, qid bigint, doc_id bigint, score double")
    qs = scores.select("task", "qid").distinct()
    docs = spark.createDataFrame([(t, d) for t in "ab" for d in range(10, 16)], "task string, doc_id bigint")
    ex = spark.createDataFrame([("a", 1, 10)], "task string, qid bigint, doc_id bigint")
    run = RT.ranked_run(scores, qs, ex, docs, 3).collect()
    assert sorted((r.task, r["rank"], r.doc_id) for r in run) == [("a", 1, 11), ("a", 2, 12), ("a", 3, 13), ("b", 1, 10), ("b", 2, 12), ("b", 3, 11)]
    qr = spark.createDataFrame([("a", 1, 11, 1), ("b", 1, 12, 1)], "task string, qid bigint, doc_id bigint, rel int")
    nd = {r.task: r.ndcg for r in RT.ndcg_at_k(RT.ranked_run(scores, qs, ex, docs, 3), qr).collect()}
    assert nd["a"] == 1.0 and 0 < nd["b"] < 1


def test_excluded_documents_cost_no_place(spark, monkeypatch):
    monkeypatch.setattr(RT, "BLOCK_DOCS", 6)
    qs = spark.createDataFrame([(1, [1.0, 0.0])], "qid bigint, vec array<double>")
    ds = spark.createDataFrame([(j, [1.0, j / 10]) for j in range(20)], "doc_id bigint, vec array<double>")
    ex = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "qid bigint, doc_id bigint")
    run = RT.ranked_run(RT.dense_run(qs, ds, ex, 4).drop("doc_order").withColumn("task", F.lit("t")), qs, ex, ds, 4, fill=False)
    assert sorted(r.doc_id for r in run.collect()) == [3, 4, 5, 6]


def test_cache_keeps_live_documents_only(spark):
    enc = lambda c: F.array(F.length(c).cast("float"))
    old = spark.createDataFrame([("t", 1, "same"), ("t", 2, "before"), ("t", 3, "deleted")], "task string, doc_id bigint, text string")
    cache = RT.refresh_vectors(old.limit(0).select("task", "doc_id", F.lit("").alias("content_hash"), F.array(F.lit(0.0).cast("float")).alias("vec")), old, enc)
    new = spark.createDataFrame([("t", 1, "same"), ("t", 2, "after it")], "task string, doc_id bigint, text string")
    assert sorted((r.doc_id, r.vec[0]) for r in RT.refresh_vectors(cache, new, enc).collect()) == [(1, 4.0), (2, 8.0)]


def test_two_queries_in_one_ground_truth_fail(spark):
    df = spark.createDataFrame([(1, '{"qrels":{"a":{"d":1},"b":{"d":1}}}')], "rollout_id int, ground_truth string")
    with pytest.raises(Exception, match="exactly one query"):
        RT.qrels_from_json(df).collect()
