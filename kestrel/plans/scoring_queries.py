"""Registered scoring queries (V*, M6) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions.text import split_header, tags_in_order, THINK_ANSWER_TAGS
from kestrel.operators import metrics as M
from kestrel.operators import scoring as S
from kestrel.sources.tables import fixture, read_table, with_fixtures

Q: dict = {}


def register(name, sql=None, fixtures=()):
    def deco(fn):
        Q[name] = (fn, with_fixtures(sql, *fixtures) if (sql and fixtures) else sql)
        return fn
    return deco


# ----------------------------------------------------------------- shared SQL

# DuckDB twin of the puzzle scorer (V7-V10), over fx_puzzle.
PUZZLE_SQL = r"""
h AS (
  SELECT rollout_id, uid, solution_text_format AS sol,
         (strpos(response, 'Assistant:') > 0 OR strpos(response, '<|im_start|>assistant') > 0) AS has_header,
         CASE WHEN strpos(response, 'Assistant:') > 0 THEN substr(response, strpos(response, 'Assistant:') + 10)
              WHEN strpos(response, '<|im_start|>assistant') > 0 THEN substr(response, strpos(response, '<|im_start|>assistant') + 21)
              ELSE response END AS processed
  FROM fx_puzzle),
f AS (
  SELECT *,
    (length(processed) - length(replace(processed, '<think>', ''))) // 7 = 1
    AND (length(processed) - length(replace(processed, '</think>', ''))) // 8 = 1
    AND (length(processed) - length(replace(processed, '<answer>', ''))) // 8 = 1
    AND (length(processed) - length(replace(processed, '</answer>', ''))) // 9 = 1
    AND strpos(processed, '<think>') <= strpos(processed, '</think>')
    AND strpos(processed, '</think>') <= strpos(processed, '<answer>')
    AND strpos(processed, '<answer>') <= strpos(processed, '</answer>') AS format_ok,
    CASE WHEN has_header THEN regexp_replace(regexp_extract_all(processed, '(?s)<answer>(.*?)</answer>', 1)[-1], '^\s+|\s+$', '', 'g') END AS answer,
    list_filter(list_transform(string_split(sol, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')),
                lambda l: l <> '' AND regexp_matches(l, '(?is)\b([A-Za-z]+)\b.*?\b(knight|knave)\b')) AS lines
  FROM h),
g AS (
  SELECT *, list_transform(lines, lambda l: {'name': regexp_extract(l, '(?is)\b([A-Za-z]+)\b.*?\b(knight|knave)\b', 1),
                                              'role': lower(regexp_extract(l, '(?is)\b([A-Za-z]+)\b.*?\b(knight|knave)\b', 2))}) AS parsed
  FROM f),
t AS (
  SELECT *, list_filter(parsed, lambda e, i: NOT coalesce(list_contains(list_transform(list_slice(parsed, i + 1, len(parsed)), lambda o: o.name), e.name), false)) AS truth
  FROM g),
p AS (
  SELECT *, list_transform(truth, lambda e: lower(regexp_extract(answer, '(?i)\b' || e.name || '\b\s+is\s+a\s+\b(knight|knave)\b', 1))) AS preds
  FROM t),
s AS (
  SELECT rollout_id, uid, format_ok, answer, truth, preds,
    CAST((CASE WHEN format_ok THEN 1.0 ELSE -1.0 END) +
    (CASE WHEN NOT format_ok OR answer IS NULL OR answer = '' THEN -2.0
          WHEN len(truth) = 0 THEN -2.0
          WHEN (length(lower(answer)) - length(replace(lower(answer), 'knight', ''))) // 6
             + (length(lower(answer)) - length(replace(lower(answer), 'knave', ''))) // 5 <> len(truth) THEN -2.0
          WHEN NOT coalesce(list_bool_and(list_transform(preds, lambda x: x <> '')), true) THEN -2.0
          WHEN coalesce(list_bool_and(list_transform(truth, lambda e, i: e.role = preds[i])), true) THEN 2.0
          ELSE -1.5 END) AS DOUBLE) AS score
  FROM p)
"""


def _puzzle_scored(spark, sf):
    df = fixture(spark, sf, "fx_puzzle")
    return S.score_puzzle(df).select("rollout_id", "uid", "format_ok", "score")


# -------------------------------------------------------------------- queries

def m6_pass_at_k(spark, sf):
    """Minimum slice: rollouts -> puzzle scores -> best per prompt -> pass rate."""
    return M.pass_at_k(_puzzle_scored(spark, sf), prompt_key="uid", threshold=3.0)


def _puzzle_sql(select: str) -> str:
    return with_fixtures("", "fx_puzzle").rstrip() + ",\n" + PUZZLE_SQL.strip() + "\n" + select


Q["M6_pass_at_k"] = (m6_pass_at_k, _puzzle_sql(
    "SELECT count(*) AS n_prompts, CAST(sum(CASE WHEN best = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_pass, "
    "round(avg(CASE WHEN best = 3 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate "
    "FROM (SELECT uid, max(score) AS best FROM s GROUP BY uid) x"))


def v10_puzzle_score(spark, sf):
    return _puzzle_scored(spark, sf).select("rollout_id", "format_ok", "score")


Q["V10_puzzle_score"] = (v10_puzzle_score, _puzzle_sql("SELECT rollout_id, format_ok, score FROM s"))


def v7_header_split(spark, sf):
    df = fixture(spark, sf, "fx_puzzle")
    h = split_header("response")
    return df.select("rollout_id", h["has_header"].alias("has_header"), h["processed"].alias("processed"))


Q["V7_header_split"] = (v7_header_split, _puzzle_sql("SELECT rollout_id, has_header, processed FROM h"))


def v8_structure(spark, sf):
    df = fixture(spark, sf, "fx_puzzle")
    h = split_header("response")
    return df.select("rollout_id", tags_in_order(h["processed"], THINK_ANSWER_TAGS).alias("format_ok"))


Q["V8_structure"] = (v8_structure, _puzzle_sql("SELECT rollout_id, format_ok FROM f"))


def v9_truth(spark, sf):
    df = fixture(spark, sf, "fx_puzzle")
    t = S.score_puzzle(df, keep_intermediate=True)
    return t.select("rollout_id", F.inline("_truth"))


Q["V9_puzzle_truth"] = (v9_truth, _puzzle_sql(
    "SELECT rollout_id, e.name AS name, e.role AS role FROM (SELECT rollout_id, unnest(truth) AS e FROM t) x"))


# GSM8K
def _gsm(spark, sf, method):
    df = fixture(spark, sf, "fx_gsm8k")
    return df.select("rollout_id", S.gsm8k_answer("response", method).alias("answer"),
                     S.gsm8k_score("response", "ground_truth", method).alias("score"))


register("V1_gsm8k_strict", r"""
SELECT rollout_id, answer, CAST(CASE WHEN answer IS NULL THEN 0.0 WHEN answer = ground_truth THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score
FROM (SELECT rollout_id, ground_truth,
             replace(replace(nullif(regexp_extract(response, '#### (\-?[0-9\.\,]+)', 1), ''), ',', ''), '$', '') AS answer
      FROM fx_gsm8k) x""", ("fx_gsm8k",))(lambda spark, sf: _gsm(spark, sf, "strict"))

register("V2_gsm8k_flexible", r"""
SELECT rollout_id, answer, CAST(CASE WHEN answer IS NULL THEN 0.0 WHEN answer = ground_truth THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score
FROM (SELECT rollout_id, ground_truth,
             CASE WHEN len(list_filter(runs, lambda x: x NOT IN ('', '.'))) > 0 THEN list_filter(runs, lambda x: x NOT IN ('', '.'))[-1]
                  WHEN len(runs) > 0 THEN runs[1] END AS answer
      FROM (SELECT *, regexp_extract_all(response, '(\-?[0-9\.\,]+)', 1) AS runs FROM fx_gsm8k) r) x""",
         ("fx_gsm8k",))(lambda spark, sf: _gsm(spark, sf, "flexible"))


# multiply (V5): response variants derived from orders, same text on both sides.
FX_MULTIPLY = """
SELECT rollout_id, CAST(uid * 7 AS VARCHAR(20)) AS ground_truth,
       CONCAT(CASE WHEN rollout_id % 9 = 0 THEN 'q ' ELSE 'User: q Assistant: ' END, '<answer>',
              CASE CAST(rollout_id % 4 AS INT) WHEN 0 THEN CAST(uid * 7 AS VARCHAR(20)) WHEN 1 THEN CAST(uid * 7 + 1 AS VARCHAR(20))
                   WHEN 2 THEN 'x1' ELSE CONCAT(' +', CAST(uid * 7 AS VARCHAR(20)), ' ') END, '</answer>',
              CASE WHEN rollout_id % 5 = 0 THEN CONCAT('<answer>', chr(10), '5</answer>') ELSE '' END) AS response
FROM (SELECT o_orderkey AS rollout_id, o_custkey AS uid FROM orders) r"""


def v5_multiply(spark, sf):
    from kestrel.sources.tables import register_tables
    register_tables(spark, sf, ["orders"])
    df = spark.sql(FX_MULTIPLY)
    return df.select("rollout_id", S.multiply_score("response", "ground_truth").alias("score"))


Q["V5_multiply_score"] = (v5_multiply, "WITH fx_multiply AS (" + FX_MULTIPLY + r""")
SELECT rollout_id, CAST(CASE WHEN a IS NULL THEN 0.0 WHEN a = CAST(ground_truth AS BIGINT) THEN 1.0 ELSE 0.1 END AS DOUBLE) AS score
FROM (SELECT rollout_id, ground_truth,
             CASE WHEN regexp_matches(ans, '^[+-]?[0-9]+$') THEN TRY_CAST(ans AS BIGINT) END AS a
      FROM (SELECT rollout_id, ground_truth,
                   regexp_replace(regexp_extract_all(CASE WHEN strpos(response, 'Assistant:') > 0
                                  THEN substr(response, strpos(response, 'Assistant:') + 10) END, '<answer>([^\n]*?)</answer>', 1)[-1],
                                  '^\s+|\s+$', '', 'g') AS ans
            FROM fx_multiply) y) x""")


def v6_countdown(spark, sf):
    df = fixture(spark, sf, "fx_countdown").withColumn("numbers", F.array("a", "b"))
    return df.select("rollout_id", S.countdown_score("response", "target", "numbers").alias("score"))


register("V6_countdown_score", r"""
SELECT rollout_id,
       CAST(CASE WHEN eq IS NULL THEN 0.0
            WHEN list_sort(list_transform(regexp_extract_all(eq, '(\d+)', 1), lambda x: CAST(x AS BIGINT))) <> list_sort([a, b]) THEN 0.1
            WHEN abs((CASE op WHEN '+' THEN CAST(x1 + x2 AS DOUBLE) WHEN '*' THEN CAST(x1 * x2 AS DOUBLE) ELSE CAST(x1 - x2 AS DOUBLE) END) - target) < 1e-5 THEN 1.0
            ELSE 0.1 END AS DOUBLE) AS score
FROM (SELECT *, CAST(regexp_extract(eq, '^(\d+) ([-+*]) (\d+)$', 1) AS BIGINT) AS x1,
                regexp_extract(eq, '^(\d+) ([-+*]) (\d+)$', 2) AS op,
                CAST(regexp_extract(eq, '^(\d+) ([-+*]) (\d+)$', 3) AS BIGINT) AS x2
      FROM (SELECT rollout_id, a, b, target,
                   regexp_replace(regexp_extract_all(string_split(substr(response, strpos(response, 'Assistant:') + 10), chr(10))[-1],
                                  '<answer>(.*?)</answer>', 1)[-1], '^\s+|\s+$', '', 'g') AS eq
            FROM fx_countdown) y) x""", ("fx_countdown",))(v6_countdown)


# V12 dispatch: scorer chosen per data source, unknown ones quarantined.
def v12_dispatch(spark, sf):
    df = fixture(spark, sf, "fx_rollouts")
    return (df.select("rollout_id", "data_source", S.scorer_name("data_source").alias("scorer"))
            .groupBy("data_source", "scorer").agg(F.count("*").alias("n")))


register("V12_scorer_dispatch", """
SELECT data_source, CASE WHEN data_source = 'openai/gsm8k' THEN 'gsm8k' WHEN data_source = 'lighteval/MATH' THEN 'math'
            WHEN contains(data_source, 'multiply') OR contains(data_source, 'arithmetic') THEN 'multiply'
            WHEN contains(data_source, 'countdown') THEN 'countdown' WHEN contains(data_source, 'kk') THEN 'kk'
            WHEN contains(data_source, 'bm25_reasoner') THEN 'retrieval' END AS scorer, count(*) AS n
FROM fx_rollouts GROUP BY ALL""", ("fx_rollouts",))(v12_dispatch)


# Model score overrides the rule score when present.
def v14_rm_override(spark, sf):
    df = fixture(spark, sf, "fx_rollouts")
    model = df.filter(F.col("rollout_id") % 3 == 0).select("rollout_id", (F.col("score") / 2).alias("rm_score"))
    return S.prefer_model_scores(df, model).select("rollout_id", "reward")


register("V14_rm_override", """
SELECT rollout_id, coalesce(CASE WHEN rollout_id % 3 = 0 THEN score / 2 END, score) AS reward FROM fx_rollouts""",
         ("fx_rollouts",))(v14_rm_override)


# First n examples per data source for inspection.
def v15_examine(spark, sf):
    df = fixture(spark, sf, "fx_rollouts")
    return M.first_n_per_group(df, "data_source", "rollout_id", 3).select("data_source", "rollout_id", "score")


register("V15_examine_first_n", """
SELECT data_source, rollout_id, score FROM fx_rollouts
QUALIFY row_number() OVER (PARTITION BY data_source ORDER BY rollout_id) <= 3""", ("fx_rollouts",))(v15_examine)


# Two generations compared by edit distance: each reply and the next
# turn of its conversation, whole texts.
def v16_similarity(spark, sf):
    c = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return M.generations_similar(c.withColumnRenamed("text", "a").join(nxt, ["conv_id", "turn"]), "a", "b", 0.1)


# DuckDB's levenshtein counts bytes: every pair's distinct characters are
# renamed to one-byte characters of their own (up to 127 per pair) first.
register("V16_generation_similarity", """
SELECT CAST(sum(dist) AS BIGINT) AS total_distance, CAST(sum(len) AS BIGINT) AS total_length,
       round(sum(dist) / nullif(sum(len), 0), 6) AS ratio, coalesce(sum(dist) / nullif(sum(len), 0), 0) <= 0.1 AS similar
FROM (SELECT CASE WHEN len(chars) > 127 THEN error('too many characters') ELSE levenshtein(translate(a, f, t), translate(b, f, t)) END AS dist, greatest(length(a), length(b)) AS len
      FROM (SELECT a, b, chars, array_to_string(chars, '') AS f, array_to_string(list_transform(range(1, len(chars) + 1), lambda i: chr(CAST(i AS INT))), '') AS t
            FROM (SELECT x.text AS a, y.text AS b, list_sort(list_distinct(string_split(x.text || y.text, ''))) AS chars
                  FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1) p) q) z""")(v16_similarity)


# V11 + G6: dense digit-completion reward.
FX_DIGITS = """
SELECT rollout_id, CONCAT(CAST(x AS VARCHAR(20)), ',', CAST((x + d) % 20 AS VARCHAR(20)), ':20,', CAST(k AS VARCHAR(20))) AS prompt,
       CASE CAST(rollout_id % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN CONCAT(CAST((x + 2 * d) % 20 AS VARCHAR(20)), ',9') ELSE CAST((x + 2 * d) % 20 AS VARCHAR(20)) END AS response
FROM (SELECT o_orderkey AS rollout_id, o_custkey % 21 AS x, o_orderkey % 4 AS d, o_custkey % 6 AS k FROM orders) r"""


def v11_digit_reward(spark, sf):
    from kestrel.operators import generators as G
    from kestrel.sources.tables import register_tables
    register_tables(spark, sf, ["orders"])
    df = spark.sql(FX_DIGITS)
    gt = G.digit_completion_answer("prompt")
    out = df.select("rollout_id", gt.alias("expected"), "response")
    return S.digit_prefix_reward(out, "expected", "response").select(
        "rollout_id", "expected", "n_match", F.round("reward", 6).alias("reward"))


Q["V11_digit_reward"] = (v11_digit_reward, "WITH fx_digits AS (" + FX_DIGITS + """),
p AS (SELECT rollout_id, response, CAST(split_part(split_part(prompt, ':', 1), ',', 1) AS BIGINT) AS a,
             CAST(split_part(split_part(prompt, ':', 1), ',', 2) AS BIGINT) AS b,
             CAST(split_part(split_part(prompt, ':', 2), ',', 1) AS BIGINT) AS m,
             CAST(split_part(split_part(prompt, ':', 2), ',', 2) AS BIGINT) AS n FROM fx_digits),
e AS (SELECT rollout_id, response,
             array_to_string(list_transform(range(1, n + 1), lambda k: CAST((b + k * (((b - a) % m + m) % m)) % m AS VARCHAR)), ',') AS expected
      FROM p),
c AS (SELECT rollout_id, response, expected,
             coalesce(list_position(list_transform(range(1, least(length(response), length(expected)) + 1),
                      lambda i: substr(response, i, 1) = substr(expected, i, 1)), false) - 1,
                      least(length(response), length(expected))) AS n_match FROM e)
SELECT rollout_id, expected, CAST(n_match AS INT) AS n_match, round(n_match / (length(expected) + 1.0), 6) AS reward FROM c""")


# MATH (V3, V4): responses with boxed answers derived from the benchmark ids.
FX_MATH = r"""
SELECT item_id AS rollout_id,
       CASE CAST(item_id % 4 AS INT)
            WHEN 0 THEN CONCAT(text, ' so \boxed{', CAST(item_id AS VARCHAR(20)), '} and \boxed{\dfrac{', CAST(item_id AS VARCHAR(20)), '}{2}}')
            WHEN 1 THEN CONCAT(text, ' answer \boxed ', CAST(item_id AS VARCHAR(20)), '/2$ done')
            WHEN 2 THEN CONCAT(text, ' \fbox{', CAST(item_id + 1 AS VARCHAR(20)), '}')
            ELSE CONCAT(text, ' no box') END AS response,
       CONCAT('\frac{', CAST(item_id AS VARCHAR(20)), '}{2}') AS ground_truth
FROM benchmark"""


def v3_boxed(spark, sf):
    # built with the DataFrame API: Spark SQL literals would read "\\b" as an escape
    b = read_table(spark, sf, "benchmark")
    i = F.col("item_id").cast("string")
    resp = (F.when(F.col("item_id") % 4 == 0, F.concat("text", F.lit(" so \\boxed{"), i, F.lit("} and \\boxed{\\dfrac{"), i, F.lit("}{2}}")))
            .when(F.col("item_id") % 4 == 1, F.concat("text", F.lit(" answer \\boxed "), i, F.lit("/2$ done")))
            .when(F.col("item_id") % 4 == 2, F.concat("text", F.lit(" \\fbox{"), (F.col("item_id") + 1).cast("string"), F.lit("}")))
            .otherwise(F.concat("text", F.lit(" no box"))))
    df = b.select(F.col("item_id").alias("rollout_id"), resp.alias("response"),
                  F.concat(F.lit("\\frac{"), i, F.lit("}{2}")).alias("ground_truth"))
    return df.select("rollout_id", S.boxed_answer("response").alias("answer"),
                     S.math_score("response", "ground_truth").alias("score"))


Q["V3_V4_math_score"] = (v3_boxed, "WITH fx_math AS (" + FX_MATH + r""")
SELECT rollout_id,
       CASE CAST(rollout_id % 4 AS INT) WHEN 0 THEN '\dfrac{' || CAST(rollout_id AS VARCHAR) || '}{2}'
            WHEN 1 THEN CAST(rollout_id AS VARCHAR) || '/2' WHEN 2 THEN NULL ELSE NULL END AS answer,
       CAST(CASE WHEN rollout_id % 4 IN (0, 1) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score
FROM fx_math""")


# The sequence score placed at the last valid response token.
V13_SQL = with_fixtures("""
WITH r AS (SELECT rollout_id, CAST(sum(mask) AS INT) AS valid, count(*) AS n, CAST(rollout_id % 7 - 3 AS DOUBLE) AS score
           FROM fx_tokens GROUP BY rollout_id)
SELECT rollout_id, CAST(n AS INT) AS n, CAST(CASE WHEN score <> 0 THEN valid - 1 END AS INT) AS pos, score AS total FROM r""",
                        "fx_tokens")


def v13_token_scores(spark, sf):
    from kestrel.operators.tokens import expand_to_tokens, to_arrays
    arr = to_arrays(fixture(spark, sf, "fx_tokens"), "rollout_id", "t", ["mask"])
    arr = arr.withColumn("valid", F.aggregate("mask", F.lit(0), lambda a, x: a + x)) \
             .withColumn("score", (F.col("rollout_id") % 7 - 3).cast("double")) \
             .withColumn("n", F.size("mask"))
    tok = arr.withColumn("scores", expand_to_tokens("score", F.col("valid") - 1, "n"))
    nz = F.array_position(F.transform("scores", lambda x: x != 0), True)
    return tok.select("rollout_id", "n", F.when(nz > 0, nz - 1).cast("int").alias("pos"),
                      F.aggregate("scores", F.lit(0.0), lambda a, x: a + x).alias("total"))


Q["V13_token_level_scores"] = (v13_token_scores, V13_SQL)
