"""Figures that must not grow faster than the input, on rows made here."""

import numpy as np
from pyspark.sql import functions as F

from kestrel.operators import retrieval as RT


def test_dense_run_returns_little_more_than_its_best(spark, monkeypatch):
    monkeypatch.setattr(RT, "BLOCK_DOCS", 100)
    rng = np.random.default_rng(3)
    rows = lambda n: [(i, i % 5, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 16)))]
    qs = spark.createDataFrame(rows(30), "qid bigint, m bigint, vec array<double>")
    docs = spark.createDataFrame(rows(1500), "doc_id bigint, m bigint, vec array<double>")
    pairs = qs.select("qid", "m").join(docs.select("doc_id", "m"), "m").select("qid", "doc_id")
    k = 40
    by_pair = RT.dense_run(qs, docs, pairs, k)
    by_list = RT.dense_run(qs, docs, docs.select("m", "doc_id"), k, exclusion_list="m")
    answer = lambda df: sorted(map(tuple, RT.top_k(df, k).select("qid", "doc_id", "rank").collect()))
    assert answer(by_pair) == answer(by_list) and by_list.join(pairs, ["qid", "doc_id"]).isEmpty()
    # blocks of 100 documents alone would give 40 rows for each of 15 blocks and more for the exclusions
    assert 30 * k <= by_list.count() < 2 * 30 * k


def test_dense_exclusions_have_a_row_per_document(spark, tmp_path):
    from kestrel.plans.retrieval_queries import dense_inputs
    spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"), (F.col("id") % 10).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    _, docs, _, excluded = dense_inputs(spark, str(tmp_path))
    assert excluded.count() == docs.count()


def test_batches_are_counted_in_state_and_held_beside_it(spark, tmp_path):
    import glob

    from kestrel.streaming.jobs import count_batch_fn, stream_step_metrics
    from tests.test_streaming import FakeState
    import pandas as pd
    names = ["batch_id", "score", "n_expected"]
    fn, st = count_batch_fn(names, {"batch_id", "n_expected"}, "batch_id", "n_expected", 100), FakeState()
    chunk = lambda n: pd.DataFrame([(7, 1.0, 5000)] * n, columns=names).assign(_arrived=pd.Timestamp(st.now, unit="ms"))
    put = lambda *n: [(len(o), o.status.iloc[0]) for o in fn((7,), iter([chunk(x) for x in n]), st)]
    assert put(2000, 2000) == [(2000, "held"), (2000, "held")]
    assert len(str(st.get)) < 100  # no rows in state
    assert put(1000) == [(1000, "held"), (1, "complete")] and put(3) == [(3, "late")]
    fn, st = count_batch_fn(names, {"batch_id", "n_expected"}, "batch_id", "n_expected", 100), FakeState()
    put(1)
    (timed,) = st.fire(fn)
    assert timed.status.tolist() == ["partial"] and timed.batch_id.tolist() == [0]  # FakeState's key

    schema = "batch_id int, uid long, data_source string, score double, n_expected long"
    rows = [(b, u, None if u == 4 else "s", float(b + u % 3), 9 if u % 2 else None) for b in range(2) for u in range(9)]
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] % 3 == k and (r[0] == 0 or k < 2)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: stream_step_metrics(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/ckpt", late_dir=f"{tmp_path}/late")
    out = lambda: sorted((r.batch_id, r.n_rows, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    run()
    assert out() == [(0, 9, "complete")]
    # the rest of batch 1 comes in another run, and a row of batch 0 too late
    spark.createDataFrame([r for r in rows if r[1] % 3 == 2 and r[0] == 1] + rows[:1], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    spark.createDataFrame([(9, 0, "s", 1.0, 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert out() == [(0, 9, "complete"), (1, 9, "complete"), (9, 1, "complete")]
    assert [r.batch_id for r in spark.read.parquet(f"{tmp_path}/late").collect()] == [0]
    held = glob.glob(f"{tmp_path}/ckpt/held/epoch=*/status=held")
    assert len(held) <= 1, held  # at most that of the last micro-batch


def test_reverse_index_of_odd_batches(spark, tmp_path):
    from kestrel.plans.batch_queries import l6
    docs = spark.range(513 + 7).filter(F.col("id") != 3).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), (F.col("id") * 7 % 100).alias("n_chars"))
    docs.filter("doc_id < 515").write.parquet(f"{tmp_path}/documents.parquet")  # batches of 511 and 3
    for name in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split():
        spark.range(0).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(map(tuple, l6(spark, str(tmp_path)).collect()))
    assert got == [(i // 512, i % 512, i) for i in range(515) if i != 3]  # with a gap, too
