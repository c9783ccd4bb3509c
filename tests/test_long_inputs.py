"""Long runs, long texts and frequent tokens."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from kestrel.functions import distance
from kestrel.functions.distance import edit_distance, text_distance
from kestrel.operators import prep as P
from kestrel.operators import retrieval as RT
from kestrel.operators import rl as R
from kestrel.operators import tokens as TK

from test_similarity_letters import distance as plain_distance


# ------------------------------------------------------------------ A13

def controller(kls, n, init, target, horizon):
    out, v = [], init
    for kl in kls:
        out.append(v)
        v *= 1 + np.clip(kl / target - 1, -0.2, 0.2) * n / horizon
    return out


def test_prefix_product_levels_equal_the_recursion(spark, monkeypatch):
    monkeypatch.setattr(R, "PREFIX_WIDTH", 7)
    rnd, rows, want = random.Random(2), [], {}
    for run, places in (("a", range(900)), ("b", [-30, -8, -7, 0, 1, 50_000, 9_000_000_000]), (None, range(20)), ("one", [5])):
        kls = [rnd.random() * 12 for _ in places]
        want.update({(run, s): v for s, v in zip(places, controller(kls, 3, 0.2, 6.0, 100.0), strict=True)})
        rows += [(run, s, kl, 3) for s, kl in zip(places, kls, strict=True)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, step long, current_kl double, n_rows int")
    got = R.kl_coefficients(df, init=0.2, horizon=100.0)
    assert got.columns == ["run", "step", "current_kl", "n_rows", "kl_coef", "kl_coef_next"]
    found = {(r.run, r.step): r.kl_coef for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(abs(found[k] / v - 1) < 1e-9 for k, v in want.items())
    assert R.kl_coefficients(df.limit(0)).count() == 0


def test_a_long_run_fills_no_window(spark):
    n = 300_000
    steps = spark.range(n).select(F.lit("r").alias("run"), F.col("id").alias("step"),
                                  F.expr("double(5.5 + pmod(hash(id), 100) / 100.0)").alias("current_kl"), F.lit(1).alias("n_rows"))
    out = R.kl_coefficients(steps, horizon=1000.0)
    last = out.orderBy(F.desc("step")).first()
    kl = np.array([r[0] for r in steps.orderBy("step").select("current_kl").collect()])
    assert abs(last.kl_coef / (0.001 * np.prod(1 + (kl[:-1] / 6.0 - 1) / 1000.0)) - 1) < 1e-9
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 3  # in a block, in a block of blocks, over those
    block = steps.groupBy(F.floor(F.col("step") / R.PREFIX_WIDTH)).count().agg(F.max("count")).first()[0]
    assert block == R.PREFIX_WIDTH


# ------------------------------------------------------------------ V16

def test_edit_distance_equals_the_plain_matrix():
    rnd = random.Random(8)
    for letters in ("ab", "abcdefgh", "àé日本😀 x", "".join(map(chr, range(200, 900)))):
        for _ in range(60):
            a, b = ("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 90))) for _ in range(2))
            assert edit_distance(a, b) == plain_distance(a, b), (a, b)
    assert edit_distance("", "") == 0 and edit_distance("", "abc") == 3 == edit_distance("abc", "")


def test_long_and_short_pairs_agree(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [("".join(rnd.choice("é日ab ") for _ in range(rnd.randint(0, 40))), "".join(rnd.choice("é日ab ") for _ in range(40))) for _ in range(40)]
    rows += [(None, "a"), ("a", None), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    monkeypatch.setattr(distance, "NATIVE_CELLS", 400)
    got = [r.d for r in df.select(text_distance("a", "b").alias("d")).collect()]
    assert got == [None if a is None or b is None else plain_distance(a, b) for a, b in rows]


def test_texts_of_20000_words_finish():
    rnd = random.Random(10)
    words = [rnd.choice(["alpha", "été", "日本", "gamma", "of"]) for _ in range(20_000)]
    a = " ".join(words)
    for k in range(0, 20_000, 200):
        words[k] = "changed"
    start = time.time()
    d = edit_distance(a, " ".join(words))
    assert 100 <= d <= 700 and time.time() - start < 120


# ------------------------------------------------------------------ T18

def decode_rows(spark):
    rnd = random.Random(11)
    vocab = [(i, f"p{i}é") for i in range(0, 60, 2)] + [(7, None), (99, "<pad>")]
    rows = [(r, t, rnd.choice([i for i, _ in vocab] + [1, -4, 10**12, None])) for r in range(30) for t in range(rnd.randint(1, 20))]
    rnd.shuffle(rows)
    pieces = dict(vocab)
    want = {}
    for r, _, i in sorted(rows, key=lambda x: x[:2]):
        want.setdefault(r, []).append(pieces.get(i) or "")
    want = {r: " ".join(x).replace("<pad>", "") for r, x in want.items()}
    ids = spark.createDataFrame(rows, "row_id long, t int, token_id long").repartition(3)
    return ids, spark.createDataFrame(vocab, "token_id long, piece string"), want


def test_decode_by_table_and_by_join(spark, monkeypatch):
    ids, vocab, want = decode_rows(spark)
    for limit in (TK.PIECE_TABLE_BYTES, 0):
        monkeypatch.setattr(TK, "PIECE_TABLE_BYTES", limit)
        got = {r.row_id: r.text for r in TK.decode(ids, vocab, pad_piece="<pad>").collect()}
        assert got == want
    assert {r.text for r in TK.decode(ids, vocab.limit(0)).collect()} <= {" " * n for n in range(20)}


def test_decode_shuffles_by_row_only(spark):
    ids, vocab, _ = decode_rows(spark)
    plan = TK.decode(ids, vocab)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(row_id" in plan and "Join" not in plan
    assert "hashpartitioning(token_id" not in plan and "hashpartitioning(_id" not in plan


# ------------------------------------------------------------------ P20, R15

def test_a_million_exclusions_of_one_example(spark):
    gold = spark.createDataFrame([(1, "7"), (1, "7"), (1, "999999"), (1, "-1"), (2, "7"), (3, None)], "qid long, doc_id string")
    excluded = spark.range(1_000_000).selectExpr("1L AS qid", "cast(id AS string) AS doc_id").unionByName(
        spark.createDataFrame([(2, "8"), (3, None)], "qid long, doc_id string"))
    got = P.overlap_violations(gold, excluded)
    assert got.schema.simpleString() == "struct<qid:bigint,n_overlap:int>"
    assert [tuple(r) for r in got.collect()] == [(1, 2)]
    assert P.overlap_violations(gold, excluded.limit(0)).count() == 0


def test_gold_sets_equal_pairs(spark):
    rnd = np.random.default_rng(3)
    vec = lambda: rnd.normal(size=6).tolist()
    docs = spark.createDataFrame([(i % 3, vec()) for i in range(40)] + [(0, [0.0] * 6), (1, None)], "label int, doc_vec array<double>")
    qs = spark.createDataFrame([(i, i % 5, vec(), vec()) for i in range(20)], "rollout_id int, label int, question_vec array<double>, rewritten_vec array<double>")
    key = lambda df: {r.rollout_id: (round(r.delta_reward, 9), r.n_docs) for r in df.collect()}
    want = key(RT.delta_similarity(qs.join(docs, "label")))
    assert len(want) == 12 and key(RT.delta_similarity_sets(qs, docs, "label")) == want
