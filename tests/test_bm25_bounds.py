"""The bounded BM25 run against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from kestrel.operators import retrieval as RT
from kestrel.session import cut_lineage


@pytest.fixture(scope="module")
def index(spark):
    """3000 documents of Zipf words, 30 queries with common and rare words."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    weights = [1 / (i + 1) for i in range(2000)]
    docs = [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(0, 60)))) for i in range(3000)]
    docs += [(3000 + i, docs[i][1]) for i in range(40)] + [(4000, None), (4001, "")]  # ties and empty texts
    queries = [(q, " ".join(rnd.choices(words[:8], k=3) + rnd.choices(words[20:], k=2))) for q in range(29)] + [(29, "absent words only")]
    t = lambda rows, key: RT.tokenize(spark.createDataFrame(rows, f"{key} long, text string").withColumn("task", F.lit("t")))
    d, q = t(docs, "doc_id"), t(queries, "qid")
    post = cut_lineage(RT.postings(d))
    stats = RT.corpus_stats(d)
    qw = cut_lineage(RT.query_weights(q, post, stats))
    return post, qw, cut_lineage(RT.impact_postings(post, stats))


def run(scores, excluded, k):
    s = RT.exclude(scores.withColumn("score", F.round("score", 9)), excluded)
    return sorted((r.qid, r.rank, r.doc_id, r.score) for r in RT.top_k(s.withColumn("doc_order", F.col("doc_id")), k).collect())


@pytest.mark.parametrize("k,share", [(1, 2.0), (10, 2.0), (200, 2.0), (10, 0.0), (200, 0.5)])  # bounds, every pair, as planned
def test_same_run(spark, index, monkeypatch, k, share):
    monkeypatch.setattr(RT, "DIRECT_SHARE", share)
    post, qw, impact = index
    top = {r[0]: r[2] for r in run(RT.bm25_scores(qw, post), spark.createDataFrame([], "qid long, doc_id long"), 1)}
    excluded = spark.createDataFrame([(q, d) for q, d in top.items() if q % 2] + [(q, d) for q in range(0, 30, 5) for d in range(0, 400)], "qid long, doc_id long")
    want = run(RT.bm25_scores(qw, post), excluded, k)
    assert run(RT.bm25_top_k(qw, impact, excluded, k), excluded, k) == want
    assert len({r[0] for r in want}) == 29


def test_few_postings_are_read(spark, index):
    post, qw, impact = index
    none = spark.createDataFrame([], "qid long, doc_id long")
    terms = cut_lineage(qw.select("task", "qid", "term", (F.col("wq") * F.col("idf")).alias("g")))
    plan = RT.bm25_plan(terms, impact, none, 10)
    counted = plan.agg(F.sum("n_head").alias("head"), F.sum("n_all").alias("every")).first()
    assert counted.every == post.join(qw, ["task", "term"]).count() and counted.head < RT.DIRECT_SHARE * counted.every
    cuts = RT.bm25_cuts(plan, impact, none, 10)
    read = impact.join(cuts, ["task", "term"]).filter(F.col("level") >= F.col("cut")).count()
    every = post.join(qw, ["task", "term"]).count()
    assert 10 * read < every, (read, every)


def sent(df):
    """Rows that the result's shuffles write."""
    df.collect()
    plans, n = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        p = plans.pop()
        name = p.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            n += p.metrics().apply("shuffleRecordsWritten").value()
        if name == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            plans.append(p.plan())
        kids = p.children()
        plans += [kids.apply(i) for i in range(kids.size())]
    return n


def test_pairs_are_not_sent(spark, index):
    """Long queries of common words: nearly every document can be a candidate."""
    rnd, k = random.Random(5), 5
    rows = index[2].select("term", "doc_id", "tfp").collect()
    df = {w: sum(r.term == w for r in rows) for w in {f"w{i}" for i in range(40)}}
    asked = {q: {w: rnd.uniform(1, 2) for w in rnd.sample(sorted(df), 20)} for q in range(60)}
    qw = cut_lineage(spark.createDataFrame([("t", q, w, g, 1.0, df[w]) for q, ws in asked.items() for w, g in ws.items()], "task string, qid long, term string, wq double, idf double, df long"))
    want = []
    for q, ws in asked.items():
        scores = {}
        for r in rows:
            if r.term in ws and r.doc_id % 60 != q:
                scores[r.doc_id] = scores.get(r.doc_id, 0.0) + ws[r.term] * r.tfp
        want += [(q, d) for d, x in sorted(scores.items(), key=lambda e: (-round(e[1], 9), e[0]))[:k]]
    excluded = spark.range(3041).select((F.col("id") % 60).alias("qid"), F.col("id").alias("doc_id"))
    best = RT.bm25_top_k(qw, index[2], excluded, k)
    n, postings = sent(best), sum(r.term in df for r in rows)
    assert n < 2 * postings < len(asked) * 3000 / 2, (n, postings)  # about 180,000 pairs
    got = RT.top_k(best.withColumn("score", F.round("score", 9)).withColumn("doc_order", F.col("doc_id")), k)
    assert sorted((r.qid, r.doc_id) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("most", [50, 2_000_000])
def test_queries_in_blocks_exclusions_of_other_types(spark, index, monkeypatch, most):
    monkeypatch.setattr(RT, "DIRECT_SHARE", 0.0)
    monkeypatch.setattr(RT, "BROADCAST_MAX_ROWS", most)
    monkeypatch.setattr(RT, "PAIR_ROWS", 500)
    post, qw, impact = index
    none = spark.createDataFrame([], "qid long, doc_id long")
    named = [(q, x) for q in range(29) for x in ("N/A", "7x", "007", None, *map(str, range(0, 3000, 7)))]
    excluded = spark.createDataFrame(named, "qid long, doc_id string")
    want = run(RT.bm25_scores(qw, post).filter((F.col("doc_id") % 7 != 0) | (F.col("doc_id") >= 3000)), none, 15)
    best = RT.bm25_top_k(qw, impact, excluded, 15, order="doc_id")
    assert run(best, none, 15) == want and best.count() == len(want)
