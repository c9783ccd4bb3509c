"""Registered generator queries (G*).  Rows are keyed by the driver tables
(one task per order / part / document), so work grows with the data; hash
draws have no DuckDB twin, so the oracles check invariants (sizes, ranges)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import generators as G
from kestrel.sources.tables import read_table

Q: dict = {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


@reg("G1_countdown_tasks", "SELECT count(*) AS n_tasks, true AS all_in_range FROM orders")
def g1(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    t = G.countdown_rows(o, "id")
    ok = (F.col("target").between(1, 1000)) & F.forall("nums", lambda x: x.between(1, 100)) & (F.size("nums") == 6)
    return t.agg(F.count(F.lit(1)).alias("n_tasks"), F.bool_and(ok).alias("all_in_range"))


@reg("G2_arithmetic_pairs", """
SELECT count(*) AS n_pairs, true AS valid FROM orders""")
def g2(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    p = G.pair_rows(o, "id", 3, ops=("*", "+", "-"), seed=42)
    ok = (F.col("num1").between(0, 999)) & (F.col("num2").between(0, 999)) & \
        ((F.col("op") != "-") | (F.col("num1") >= F.col("num2")))
    return p.agg(F.count(F.lit(1)).alias("n_pairs"), F.bool_and(ok).alias("valid"))


@reg("G3_multiply_pairs", "SELECT count(*) AS n_pairs, true AS valid FROM part")
def g3(spark, sf):
    ids = read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    p = G.pair_rows(ids, "id", 3, ops=("*",), seed=11)
    ok = (F.col("op") == "*") & F.col("num1").between(0, 999) & F.col("num2").between(0, 999)
    return p.agg(F.count(F.lit(1)).alias("n_pairs"), F.bool_and(ok).alias("valid"))


PARAMS_SQL = "SELECT p_partkey, 5 + p_partkey % 7 AS max_number, p_size % 4 AS max_diff, 3 AS max_num_in_response FROM part"


def _params(spark, sf):
    p = read_table(spark, sf, "part")
    return p.select("p_partkey", (5 + F.col("p_partkey") % 7).alias("max_number"), (F.col("p_size") % 4).alias("max_diff"),
                    F.lit(3).alias("max_num_in_response"))


@reg("G4_digit_prompts", f"""
WITH p AS ({PARAMS_SQL}),
x AS (SELECT p_partkey, max_number, unnest(range(0, max_number + 1)) AS f, max_diff FROM p),
y AS (SELECT p_partkey, max_number, f, unnest(range(0, max_diff + 1)) AS d FROM x),
z AS (SELECT p_partkey, CAST(f AS VARCHAR) || ',' || CAST((f + d) % max_number AS VARCHAR) || ':' || CAST(max_number AS VARCHAR) || ',' || CAST(n AS VARCHAR) AS prompt
      FROM (SELECT *, unnest(range(0, 4)) AS n FROM y) w)
SELECT p_partkey, count(*) AS n_prompts, CAST(sum(length(prompt)) AS BIGINT) AS n_chars FROM z GROUP BY p_partkey""")
def g4(spark, sf):
    x = G.digit_completion_space(_params(spark, sf))
    return x.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n_prompts"), F.sum(F.length("prompt")).cast("bigint").alias("n_chars"))


@reg("G5_digit_sample", "SELECT count(*) AS n, true AS well_formed FROM orders")
def g5(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey")
    s = G.digit_completion_sample(o, "o_orderkey", 20, 3, 5, seed=1)
    ok = F.col("prompt").rlike(r"^[0-9]+,[0-9]+:20,[0-5]$")
    return s.agg(F.count(F.lit(1)).alias("n"), F.bool_and(ok).alias("well_formed"))


@reg("G6_digit_answers", f"""
WITH p AS ({PARAMS_SQL}),
x AS (SELECT p_partkey, max_number, unnest(range(0, max_number + 1)) AS f, max_diff FROM p),
y AS (SELECT p_partkey, max_number, f, unnest(range(0, max_diff + 1)) AS d FROM x),
z AS (SELECT p_partkey, max_number AS m, f AS a, (f + d) % max_number AS b, n FROM (SELECT *, unnest(range(0, 4)) AS n FROM y) w),
e AS (SELECT p_partkey, array_to_string(list_transform(range(1, n + 1), lambda k: CAST((b + k * (((b - a) % m + m) % m)) % m AS VARCHAR)), ',') AS answer FROM z)
SELECT p_partkey, count(*) AS n_prompts, CAST(sum(length(answer)) AS BIGINT) AS n_chars FROM e GROUP BY p_partkey""")
def g6(spark, sf):
    x = G.digit_completion_space(_params(spark, sf))
    a = x.select("p_partkey", G.digit_completion_answer("prompt").alias("answer"))
    return a.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n_prompts"), F.sum(F.length("answer")).cast("bigint").alias("n_chars"))


@reg("G7_random_mask", "SELECT count(*) AS n_rows, true AS valid FROM documents")
def g7(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))
    m = d.select("ids", G.random_attention_mask("ids", "doc_id", 0.9, 0.1, 0.5, seed=3).alias("m"))
    ones = F.aggregate("m", F.lit(0), lambda s, x: s + x)
    L = F.size("ids")
    ok = (F.size("m") == L) & (ones <= F.greatest(F.floor(L * 0.9), F.lit(1))) & ((L == 0) | (ones >= 1))
    return m.agg(F.count(F.lit(1)).alias("n_rows"), F.bool_and(ok).alias("valid"))
