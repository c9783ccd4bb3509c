"""Rule-based response scoring (V*), as column expressions over a rollout table.

Every scorer is row-local (no shuffle): it adds columns to the input
DataFrame, so scoring a billion rollouts is one narrow stage.  Only the
arithmetic evaluation of countdown answers needs Python, done in an Arrow
``pandas_udf`` on rows that pass the native checks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.operators.arithmetic import safe_arith
from kestrel.operators.math_answers import boxed_answer, last_boxed, math_equiv, math_score, math_score_one, normalize_math  # noqa: F401
from kestrel.functions.text import (
    ASSISTANT_HEADER, CHATML_ASSISTANT_HEADER, THINK_ANSWER_TAGS, after_first,
    col, contains, count_substr, last_tag_content, py_strip, split_header, tags_in_order,
)

# ---------------------------------------------------------------- GSM8K (V1, V2)

GSM8K_STRICT = r"#### (\-?[0-9\.\,]+)"
NUMBER_RUN = r"(\-?[0-9\.\,]+)"


def gsm8k_answer(response, method: str = "strict") -> Column:
    r = col(response)
    if method == "strict":
        hit = F.regexp_extract(r, GSM8K_STRICT, 1)
        return F.when(hit != "", F.replace(F.replace(hit, F.lit(","), F.lit("")), F.lit("$"), F.lit("")))
    if method == "flexible":
        runs = F.regexp_extract_all(r, F.lit(NUMBER_RUN), 1)
        valid = F.filter(runs, lambda x: ~x.isin("", "."))
        return (F.when(F.size(valid) > 0, F.element_at(valid, -1))
                .when(F.size(runs) > 0, F.element_at(runs, 1)))
    raise ValueError(f"unknown method {method!r}")


def gsm8k_score(response, ground_truth, method="strict", format_score=0.0, score=1.0) -> Column:
    a = gsm8k_answer(response, method)
    return (F.when(a.isNull(), F.lit(0.0))
            .when(a == col(ground_truth), F.lit(float(score)))
            .otherwise(F.lit(float(format_score))))


# ------------------------------------------------------------ multiply (V5)

def multiply_score(response, ground_truth, format_score=0.1, score=1.0) -> Column:
    a = _int_answer(response)
    gt = F.col(ground_truth).cast("string") if isinstance(ground_truth, str) else ground_truth
    return (F.when(a.isNull(), F.lit(0.0))
            .when(a == whole_number(py_strip(gt)), F.lit(float(score)))
            .otherwise(F.lit(float(format_score))))


def whole_number(c: Column) -> Column:
    """A whole number of any length in one spelling (no plus sign, no leading
    zeros, no negative zero); null where it is none."""
    digits = F.regexp_replace(F.regexp_replace(c, "^[+-]", ""), "^0+(?=.)", "")
    return F.when(c.rlike("^[+-]?[0-9]+$"), F.when(c.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits))


def _int_answer(response) -> Column:
    r = col(response)
    body = F.when(contains(r, ASSISTANT_HEADER), after_first(r, ASSISTANT_HEADER))
    return whole_number(py_strip(last_tag_content(body, "answer", dotall=False)))


# ----------------------------------------------------------- countdown (V6)

# characters an answer expression may contain (Unicode digits/space, as Python)
ALLOWED_EXPR = r"(?U)^[\d+\-*/().\s]+$"


@F.pandas_udf(T.DoubleType())
def arith_value(s: pd.Series) -> pd.Series:
    return s.map(safe_arith, na_action="ignore").astype("float64")


def countdown_answer(response) -> Column:
    r = col(response)
    body = F.when(contains(r, ASSISTANT_HEADER), after_first(r, ASSISTANT_HEADER)) \
        .when(contains(r, CHATML_ASSISTANT_HEADER), after_first(r, CHATML_ASSISTANT_HEADER))
    last_line = F.element_at(F.split(body, "\n"), -1)
    return py_strip(last_tag_content(last_line, "answer", dotall=False))


def countdown_score(response, target, numbers, format_score=0.1, score=1.0) -> Column:
    eq = countdown_answer(response)
    used = F.array_sort(F.transform(F.regexp_extract_all(eq, F.lit(r"(?U)(\d+)"), 1), whole_number))
    given = F.array_sort(F.transform(col(numbers), lambda x: whole_number(x.cast("string"))))
    nums_ok = F.coalesce(used == given, F.lit(False))
    chars_ok = eq.rlike(ALLOWED_EXPR)
    value = arith_value(F.when(nums_ok & chars_ok, eq))
    return (F.when(eq.isNull(), F.lit(0.0))
            .when(~nums_ok, F.lit(float(format_score)))
            .when(value.isNull(), F.lit(float(format_score)))
            .when(F.abs(value - col(target).cast("double")) < 1e-5, F.lit(float(score)))
            .otherwise(F.lit(float(format_score))))


# ------------------------------------------------- knights and knaves

GT_LINE = r"(?is)\b([A-Za-z]+)\b.*?\b(knight|knave)\b"


def score_puzzle(df: DataFrame, response="response", solution_text="solution_text_format",
                 format_reward: int = 1, keep_intermediate: bool = False) -> DataFrame:
    """V7-V10 as staged columns: every intermediate (header split, answer,
    parsed truth, predictions) is computed once per row and referenced by
    name, so no regex runs twice.  Adds ``format_ok`` and ``score``."""
    h = split_header(response)
    x = df.withColumn("_proc", h)
    proc = F.col("_proc.processed")
    x = x.withColumns({
        "_ans": F.when(F.col("_proc.has_header"), py_strip(last_tag_content(proc, "answer"))),
        "format_ok": tags_in_order(proc, THINK_ANSWER_TAGS),
        "_lines": F.filter(F.transform(F.split(col(solution_text), "\n"), lambda l: py_strip(l)),
                           lambda l: (l != "") & l.rlike(GT_LINE)),
    })
    x = x.withColumn("_parsed", F.transform("_lines", lambda l: F.struct(
        F.regexp_extract(l, GT_LINE, 1).alias("name"), F.lower(F.regexp_extract(l, GT_LINE, 2)).alias("role"))))
    x = x.withColumn("_truth", F.filter("_parsed", lambda e, i: ~F.exists(
        F.slice(F.col("_parsed"), i + 2, F.size("_parsed")), lambda o: o["name"] == e["name"])))
    low = F.lower(F.col("_ans"))
    x = x.withColumns({
        "_n_roles": count_substr(low, "knight") + count_substr(low, "knave"),
        "_preds": F.transform("_truth", lambda e: F.lower(F.call_function(
            "regexp_extract", F.col("_ans"),
            F.concat(F.lit(r"(?i)\b"), e["name"], F.lit(r"\b\s+is\s+a\s+\b(knight|knave)\b")), F.lit(1)))),
    })
    n_truth = F.size("_truth")
    all_found = F.forall("_preds", lambda p: p != "")
    all_right = F.forall(F.arrays_zip(F.col("_truth").alias("t"), F.col("_preds").alias("p")),
                         lambda z: z["t"]["role"] == z["p"])
    ans = F.col("_ans")
    answer_score = (F.when(~F.col("format_ok") | ans.isNull() | (ans == ""), F.lit(-2.0))
                    .when(n_truth == 0, F.lit(-2.0))
                    .when(F.col("_n_roles") != n_truth, F.lit(-2.0))
                    .when(~all_found, F.lit(-2.0))
                    .when(all_right, F.lit(2.0))
                    .otherwise(F.lit(-1.5)))
    fmt_score = F.when(F.col("format_ok"), F.lit(float(format_reward))).otherwise(F.lit(-abs(float(format_reward))))
    x = x.withColumn("score", fmt_score + answer_score)
    if keep_intermediate:
        return x
    return x.drop("_proc", "_ans", "_lines", "_parsed", "_truth", "_n_roles", "_preds")


# ---------------------------------------------------- scorer dispatch

def scorer_name(data_source) -> Column:
    """Exact names first, then substrings, in the reference's order."""
    ds = col(data_source)
    return (F.when(ds == "openai/gsm8k", "gsm8k")
            .when(ds == "lighteval/MATH", "math")
            .when(ds.contains("multiply") | ds.contains("arithmetic"), "multiply")
            .when(ds.contains("countdown"), "countdown")
            .when(ds.contains("kk"), "kk")
            .when(ds.contains("bm25_reasoner"), "retrieval"))


def eval_scorer_name(data_source) -> Column:
    """Scorer choice of the offline evaluator (MATH or puzzle only)."""
    ds = col(data_source)
    return F.when(ds == "lighteval/MATH", "math").when(ds.contains("kk"), "kk")


def dispatch_scores(df: DataFrame, data_source="data_source", response="response",
                    ground_truth="ground_truth", strict: bool = False,
                    scored: DataFrame | None = None, row_key=("rollout_id",)) -> DataFrame:
    """Score a mixed-source rollout table in one pass (V12 + U1).

    ``ground_truth`` is the canonical JSON string.  The registered reward
    functions score by scorer name; retrieval rows, which need the corpus, take
    their reward from ``scored`` (row key, score).  Rows without a score raise
    (``strict``) or keep null, to be routed to a quarantine table.
    """
    from kestrel.operators.inference import REWARD_FUNCTIONS
    gt = col(ground_truth)
    x = df.withColumn("scorer", scorer_name(data_source))
    x = x.withColumn("_kk_sol", F.when(F.col("scorer") == "kk", F.get_json_object(gt, "$.solution_text_format")))
    x = score_puzzle(x.withColumn("_kk_resp", F.when(F.col("scorer") == "kk", col(response))),
                     "_kk_resp", "_kk_sol").withColumnRenamed("score", "_kk_score").drop("format_ok")
    name = F.col("scorer")
    s = F.when(name == "kk", F.col("_kk_score"))
    if scored is not None:  # scores of a source that needs other tables, by row key
        x = x.join(scored.select(*row_key, F.col("score").alias("_given")), list(row_key), "left")
        s = s.when(name == "retrieval", F.col("_given"))
    for known, fn in REWARD_FUNCTIONS.items():
        s = s.when(name == known, fn(col(response), gt))
    x = x.withColumn("_score", s)  # a column of its own, so that the check does not score again
    s = F.col("_score")
    if strict:
        s = F.when(s.isNull(), F.raise_error(F.concat(F.lit("no score for "), col(data_source)))
                   .cast("double")).otherwise(s)
    return x.withColumn("score", s).drop("_score", "_kk_sol", "_kk_resp", "_kk_score", "_given")


# ------------------------------------------------ digit completion

def prefer_model_scores(scored: DataFrame, model_scores: DataFrame, key="rollout_id", score="score",
                        model_score="rm_score", out="reward") -> DataFrame:
    """``out`` is the model's score where there is one, else the rule's.
    Null model scores are none; of several of a rollout the highest counts, so
    no row is doubled."""
    own = model_scores.groupBy(F.col(key).alias("__key")).agg(F.max(model_score).alias("__model"))
    return (scored.join(own, F.col(key) == F.col("__key"), "left")
            .withColumn(out, F.coalesce(F.col("__model"), col(score))).drop("__key", "__model"))


def digit_prefix_reward(df: DataFrame, expected="expected", response="response",
                        sequence_reward: float = 1.0) -> DataFrame:
    """Each leading character equal to the expected answer earns
    ``sequence_reward / (len(expected) + 1)``; stops at the first mismatch.

    Adds ``n_match`` (matched prefix length), ``reward`` (total) and
    ``token_rewards`` (per response character, zeros after the prefix).
    """
    e, r = col(expected), col(response)
    n = F.least(F.length(e), F.length(r))
    eq = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                     lambda i: F.substring(r, i, 1) == F.substring(e, i, 1))
    first_bad = F.array_position(eq, False)
    n_match = F.when(n == 0, F.lit(0)).when(first_bad == 0, n).otherwise(first_bad - 1).cast("int")
    per = F.lit(float(sequence_reward)) / (F.length(e) + 1)
    return (df.withColumn("n_match", n_match)
              .withColumn("reward", F.col("n_match") * per)
              .withColumn("token_rewards", F.transform(
                  F.sequence(F.lit(0), F.greatest(F.length(r) - 1, F.lit(0))),
                  lambda i: F.when(i < F.col("n_match"), per).otherwise(F.lit(0.0))))
              .withColumn("token_rewards", F.when(F.length(r) == 0, F.array().cast("array<double>"))
                          .otherwise(F.col("token_rewards"))))
