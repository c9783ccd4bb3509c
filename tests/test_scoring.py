"""Rule-based scorers: hand-worked cases from the scoring rules."""

import pytest
from pyspark.sql import functions as F

from kestrel.operators import scoring as S

SOL = "(1) Ann is a knight\n(2) Bob is a knave"


def _score_puzzle(spark, rows):
    df = spark.createDataFrame(rows, "id int, response string, solution_text_format string")
    return {r.id: r.score for r in S.score_puzzle(df).collect()}


def test_puzzle_scores(spark):
    rows = [
        (1, "User: q Assistant: <think>x</think><answer>(1) Ann is a knight\n(2) Bob is a knave</answer>", SOL),
        (2, "User: q Assistant: <think>x</think><answer>(1) Ann is a knave\n(2) Bob is a knave</answer>", SOL),
        (3, "User: q Assistant: <think>x</think><answer>Ann is a knight, Bob is a knave or knight</answer>", SOL),
        (4, "User: q Assistant: <think>x</think><answer></answer><answer>Ann is a knight</answer>", SOL),
        (5, "no header <think>x</think><answer>(1) Ann is a knight\n(2) Bob is a knave</answer>", SOL),
        (6, "<|im_start|>assistant<think>x</think><answer> ann IS A Knight\n bob is a KNAVE </answer>", SOL),
        (7, "Assistant: <think>x</think><answer>anything</answer>", "no roles here"),
        (8, "Assistant: <answer>(1) Ann is a knight</answer><think>x</think>", SOL),
    ]
    got = _score_puzzle(spark, rows)
    assert got == {1: 3.0, 2: -0.5, 3: -1.0, 4: -3.0, 5: -1.0, 6: 3.0, 7: -1.0, 8: -3.0}


def test_puzzle_truth_later_duplicates_win(spark):
    df = spark.createDataFrame([(1, "x", "Ann is a knight\nAnn is a knave\nBob is a knight")],
                               "id int, response string, solution_text_format string")
    t = S.score_puzzle(df, keep_intermediate=True).select(F.inline("_truth")).collect()
    assert [(r.name, r.role) for r in t] == [("Ann", "knave"), ("Bob", "knight")]


@pytest.mark.parametrize("resp,strict,flex", [
    ("so #### 42", "42", "42"),
    ("#### 1,234 then #### 7", "1234", "7"),
    ("#### -3.", "-3.", "-3."),
    ("no number", None, None),
    ("value . and 12 .", None, "12"),
])
def test_gsm8k_answers(spark, resp, strict, flex):
    df = spark.createDataFrame([(resp,)], "r string")
    r = df.select(S.gsm8k_answer("r", "strict").alias("s"), S.gsm8k_answer("r", "flexible").alias("f")).first()
    assert (r.s, r.f) == (strict, flex)


@pytest.mark.parametrize("resp,gt,score", [
    ("Assistant: <answer>42</answer>", "42", 1.0),
    ("Assistant: <answer> 41 </answer>", "42", 0.1),
    ("Assistant: <answer>x</answer>", "42", 0.0),
    ("no header <answer>42</answer>", "42", 0.0),
    ("Assistant: <answer>1</answer><answer>\n42</answer>", "42", 0.1),
    ("Assistant: <answer>+012345678901234567890</answer>", "12345678901234567890", 1.0),
    ("Assistant: <answer>-0</answer>", "0", 1.0),
])
def test_multiply(spark, resp, gt, score):
    df = spark.createDataFrame([(resp, gt)], "r string, g string")
    assert df.select(S.multiply_score("r", "g").alias("s")).first().s == score


def test_safe_arith():
    assert S.safe_arith("(1 + 2) / 3") == 1.0
    assert S.safe_arith("2 ** 3") == 8.0
    assert S.safe_arith("7 // 2") == 3.0
    assert S.safe_arith("9 ** 9 ** 9") == float("inf")  # too large for any target, held by its logarithm
    assert S.safe_arith("(2**65)/(2**64)") == 2.0
    assert S.safe_arith("1" + " " * 600 + "+ 1") == 2.0
    assert S.safe_arith("1000001**1") == 1000001.0
    assert S.safe_arith("9**9**9 - 9**9**9 + 3") == 3.0
    assert S.safe_arith("1 / 0") is None
    assert S.safe_arith("__import__('os')") is None
    assert S.safe_arith("05") is None                  # not a Python literal


@pytest.mark.parametrize("resp,target,nums,score", [
    ("Assistant: think\n<answer>3 + 4</answer>", 7, [3, 4], 1.0),
    ("Assistant: think\n<answer>3 * 4</answer>", 7, [3, 4], 0.1),
    ("Assistant: think\n<answer>3 + 5</answer>", 8, [3, 4], 0.1),
    ("Assistant: <answer>3 + 4</answer>\nlast line", 7, [3, 4], 0.0),
    ("no header <answer>3 + 4</answer>", 7, [3, 4], 0.0),
    ("Assistant: <answer>(4 - 3) / 0</answer>", 7, [4, 3, 0], 0.1),
])
def test_countdown(spark, resp, target, nums, score):
    df = spark.createDataFrame([(resp, target, nums)], "r string, t bigint, n array<bigint>")
    assert df.select(S.countdown_score("r", "t", "n").alias("s")).first().s == score


def test_math_rules():
    assert S.normalize_math("\\frac12") == "\\frac{1}{2}"
    assert S.normalize_math("0.5") == "\\frac{1}{2}"
    assert S.normalize_math("x = 3") == "3"
    assert S.normalize_math("\\sqrt2") == "\\sqrt{2}"
    assert S.normalize_math("10\\%") == "10"
    assert S.math_score_one("so \\boxed{\\dfrac{1}{2}}", "0.5") == 1.0
    assert S.math_score_one("\\boxed 7$ x", "7") == 1.0
    assert S.math_score_one("no box", "7") == 0.0
    assert S.last_boxed("a \\fbox{1} b") == "\\fbox{1}"


@pytest.mark.parametrize("a,b,same", [
    ("x / 2", "x/2", False), ("\\pi / 2", "\\pi/2", False), ("3 / 4", "\\frac{3}{4}", True), ("\\sqrt", "\\sqrt ", False),
    ("\\left(3\\right)", "(3)", True), ("5\\text{ cm}", "5", True), ("90^{\\circ}", "90", True), (".5", "\\frac{1}{2}", True),
    ("\\tfrac1{72}", "\\frac{1}{72}", True), ("k=\\dfrac34", "\\frac{3}{4}", True), ("abc=4", "4", False)])
def test_math_equality(a, b, same):
    assert S.math_equiv(a, b) is same


def test_dispatch_scores_every_known_source(spark):
    rows = [(1, "openai/gsm8k", "#### 7", "7"), (2, "lighteval/MATH", "\\boxed{\\frac12}", "0.5"), (3, "BRIGHT_bm25_reasoner_x", "q", "{}"),
            (4, "countdown", "Assistant: x\n<answer>3+4</answer>", '{"target":7,"numbers":[3,4]}'), (5, "yolo/multiply-3_digit", "Assistant: <answer>6</answer>", "6")]
    df = spark.createDataFrame(rows, "rollout_id int, data_source string, response string, ground_truth string")
    given = spark.createDataFrame([(3, 0.25)], "rollout_id int, score double")
    got = {r.rollout_id: r.score for r in S.dispatch_scores(df, strict=True, scored=given).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.25, 4: 1.0, 5: 1.0}
    with pytest.raises(Exception):
        S.dispatch_scores(df, strict=True).collect()


def test_registered_reward_is_used(spark, monkeypatch):
    from kestrel.operators import inference as I
    monkeypatch.setitem(I.REWARD_FUNCTIONS, "gsm8k", lambda r, gt: F.lit(9.0))
    df = spark.createDataFrame([("openai/gsm8k", "#### 7", "7")], "data_source string, response string, ground_truth string")
    assert S.dispatch_scores(df).first().score == 9.0


def test_digit_reward_golden(spark):
    # prompt 9,10:20,2 -> expected "11,12"; response "11,12,13": 5 chars match, 1/6 each
    from kestrel.operators.generators import digit_completion_answer
    df = spark.createDataFrame([("9,10:20,2", "11,12,13")], "p string, r string")
    out = S.digit_prefix_reward(df.withColumn("e", digit_completion_answer("p")), "e", "r").first()
    assert out.e == "11,12" and out.n_match == 5
    assert out.token_rewards[:5] == pytest.approx([1 / 6] * 5) and out.token_rewards[5:] == [0.0] * 3


def test_dispatch_unknown_source(spark):
    df = spark.createDataFrame([("nope", "x", "1")], "data_source string, response string, ground_truth string")
    assert S.dispatch_scores(df).first().score is None
    with pytest.raises(Exception):
        S.dispatch_scores(df, strict=True).collect()
