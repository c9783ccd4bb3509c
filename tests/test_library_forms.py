"""Functions of the library that queries only call: B15, V14, M7, M9, R12."""

import pytest

from kestrel.operators import batch as B
from kestrel.operators import metrics as M
from kestrel.operators import retrieval as RT
from kestrel.operators import scoring as S


def test_rows_and_slices_as_python_takes_them(spark):
    sizes = {1: 7, 2: 3, 3: 1, None: 4}
    df = spark.createDataFrame([(b, i, f"{b}-{i}") for b, n in sizes.items() for i in range(n)], "batch_id int, row_idx int, x string").coalesce(1)
    lists = {b: [f"{b}-{i}" for i in range(n)] for b, n in sizes.items()}
    got = lambda item: sorted(r.x for r in B.take_rows(df, item).collect())
    for i in (0, 2, 6, -1, -3, 9, -9):
        assert got(i) == sorted(x[i] for x in lists.values() if -len(x) <= i < len(x)), i
    for s in (slice(None), slice(2), slice(1, 5, 2), slice(-3, None), slice(-5, -1, 2), slice(None, -2), slice(4, 2), slice(-2, 50)):
        assert got(s) == sorted(x for v in lists.values() for x in v[s]), s
    assert {r.batch_id: r.n for r in B.row_counts(df).collect()} == sizes
    assert B.take_rows(df, 0).columns == df.columns
    with pytest.raises(ValueError):
        B.take_rows(df, slice(None, None, -1))


def test_model_scores_replace_rules_once(spark):
    scored = spark.createDataFrame([(1, 0.0), (2, 3.0), (3, None), (None, 1.0)], "rollout_id long, score double")
    model = spark.createDataFrame([(1, 0.25), (1, 0.75), (2, None), (9, 5.0), (None, 8.0)], "rollout_id long, rm_score double")
    out = S.prefer_model_scores(scored, model)
    assert out.columns == ["rollout_id", "score", "reward"]
    assert {r.rollout_id: r.reward for r in out.collect()} == {1: 0.75, 2: 3.0, 3: None, None: 1.0} and out.count() == 4


def test_means_and_valid_tokens(spark):
    m = spark.createDataFrame([(0, 1, "loss", 1.0), (0, 1, "loss", 2.0), (0, 1, "kl", None), (0, 2, "loss", 4.0)], "run int, step int, metric string, value double")
    assert {(r.step, r.metric): r.value for r in M.reduce_metrics(m).collect()} == {(1, "loss"): 1.5, (1, "kl"): None, (2, "loss"): 4.0}
    t = spark.createDataFrame([(1, 10, 1), (1, 10, 0), (1, 11, 1), (2, 12, 0)], "batch_id int, rollout_id int, mask int")
    assert {r.batch_id: (r.valid_tokens, r.n_rows) for r in M.valid_tokens(t).collect()} == {1: (2, 2), 2: (0, 1)}


@pytest.mark.parametrize("stem", [False, True])
def test_bm25_reward_of_rollouts(spark, stem):
    docs = spark.createDataFrame([("t", 1, "relational operators"), ("t", 2, "cloud weather"), ("t", 3, "weather maps")], "task string, doc_id long, text string")
    rows = [(10, 1, "t", "Assistant: <think>a</think><query>relating operations</query>"), (11, 1, "t", "Assistant: relational"),
            (20, 2, "t", "Assistant: <think>a</think><query>weather</query>"), (30, 3, "t", "Assistant: no judgment")]
    ro = spark.createDataFrame(rows, "rollout_id long, qid long, task string, response string")
    qrels = spark.createDataFrame([(1, 1, 1), (2, 3, 1)], "qid long, doc_id long, rel int")
    excluded = spark.createDataFrame([(2, 2)], "qid long, doc_id long")
    got = {r.rollout_id: (round(r.ndcg, 6), r.format_ok, round(r.reward, 6))
           for r in RT.bm25_rewards(ro, RT.tokenize(docs, stem=stem), qrels, excluded, stem=stem).collect()}
    assert got.keys() == {10, 11, 20}
    assert got[11] == (1.0, False, 0.0) and got[20] == (1.0, True, 2.0)
    assert got[10][1] and (got[10][0] == 1.0) == stem  # other forms are met by stems alone
