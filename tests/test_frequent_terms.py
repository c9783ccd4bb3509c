"""Frequent terms are joined without a shuffle, others by term."""

import pytest

from kestrel.operators import tokens as TK

DOCS = [(i, ["common", f"rare{i % 50}", "x" * (2000 if i < 3 else 1)]) for i in range(100)] + [(100, []), (101, ["common", "common"])]


@pytest.mark.parametrize("most", [1, 4, 8192])
def test_join_terms_equals_the_plain_join(spark, monkeypatch, most):
    monkeypatch.setattr(TK, "FREQUENT_TERMS", most)
    docs = spark.createDataFrame(DOCS, "doc_id long, tokens array<string>")
    voc = TK.build_dictionary(docs)
    ids = {r.term: r.term_id for r in voc.collect()}
    assert sorted(ids, key=ids.get) == sorted({t for _, ts in DOCS for t in ts})
    got = sorted(tuple(r) for r in TK.bag_of_words(docs, voc).select("doc_id", "term_id", "tf").collect())
    assert got == sorted((d, ids[t], ts.count(t)) for d, ts in DOCS for t in set(ts))
    assert TK.bag_of_words(docs.limit(0), voc).count() == 0
    assert TK.bag_of_words(docs, voc.limit(0)).count() == 0


def test_a_frequent_term_is_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(TK, "FREQUENT_TERMS", 4)
    post = spark.createDataFrame([(t, d) for d, ts in DOCS for t in set(ts)], "term string, doc_id long")
    voc = post.groupBy("term").count().withColumnRenamed("count", "df")
    out = TK.join_terms(post, voc)
    assert out.count() == post.count()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and "strategy=broadcast" in plan
