"""Passages found inside documents, short ones included, against plain search."""

from kestrel.plans.retrieval_queries import qrels


def test_short_passages(spark, tmp_path):
    docs = ["alpha beta gamma delta", "xalphax", "a", "", None, "Größe 日本語 text", "be ta", "alpha  beta", "delta alpha beta gamma end"]
    passages = ["alpha", "a", "", "日本", "e t", "beta gamma delta", "alpha beta gamma", "zz", "Größ", "a  b", "nowhere to be"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.qid, r.doc_id, r.rel) for r in qrels(spark, str(tmp_path)).collect())
    assert got == sorted((q, d, 1) for q, p in enumerate(passages) for d, t in enumerate(docs) if t is not None and p in t)


def test_documents_stay_where_they_are(spark, tmp_path, monkeypatch):
    import kestrel.plans.retrieval_queries as RQ
    docs = [(1, "a long word here and a long word there"), (1, "no such"), (2, "a long word here and a long word there"), (2, "a long word here and a long word there"), (3, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    passages = [(5, "long word here"), (5, "long word here"), (6, "word there and"), (7, None), (8, "a long word")]
    spark.createDataFrame(passages, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted((q, d, 1) for q, p in passages for d, t in docs if p and t and p in t)
    found = RQ.qrels(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == want
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(RQ, "PASSAGE_CHARS", 1)
    assert sorted(map(tuple, RQ.qrels(spark, str(tmp_path)).collect())) == want
