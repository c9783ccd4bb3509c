"""Registered dataset-preparation queries (P*).

Raw task tables are derived from the driver tables (conversations,
benchmark, documents, orders); prompt rows are compared flattened:
``data_source, role, content, ability, style, ground_truth, split, idx``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import templates as TPL
from kestrel.operators import prep as P
from kestrel.operators.batch import index_within
from kestrel.sources.tables import FIXTURES, fixture, read_table, with_fixtures

Q: dict = {}


def reg(name, sql=None, fixtures=()):
    def deco(fn):
        Q[name] = (fn, with_fixtures(sql, *fixtures) if (sql and fixtures) else sql)
        return fn
    return deco


def sql_str(s: str) -> str:
    """A Python string as a DuckDB literal (newlines via chr(10))."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def sql_render(template: str, **slots) -> str:
    out, rest = [], template
    while rest:
        i = rest.find("{")
        j = rest.find("}", i) if i >= 0 else -1
        name = rest[i + 1:j] if i >= 0 and j > i else None
        if name is None or name not in slots:
            if i < 0 or j < 0:
                out.append(sql_str(rest))
                break
            out.append(sql_str(rest[:j + 1]))
            rest = rest[j + 1:]
            continue
        if i:
            out.append(sql_str(rest[:i]))
        out.append(f"({slots[name]})")
        rest = rest[j + 1:]
    return " || ".join(out) if out else "''"


def flat(df, idx="index"):
    return df.select("data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"),
                     "ability", F.col("reward_model.style").alias("style"),
                     F.col("reward_model.ground_truth").alias("ground_truth"),
                     F.col("extra_info.split").alias("split"), F.col(f"extra_info.{idx}").alias("idx"))


def split_mod(key: str) -> str:
    return f"CASE WHEN {key} % 5 < 4 THEN 'train' ELSE 'test' END"


# ------------------------------------------------------------------ P1, P2

USER_TURNS = "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'"


@reg("P1_prompt_rows", f"""
SELECT 'chat' AS data_source, 'user' AS role, text AS content, 'dialog' AS ability, 'model' AS style, '' AS ground_truth,
       {split_mod('conv_id')} AS split, CAST(row_number() OVER (PARTITION BY {split_mod('conv_id')} ORDER BY conv_id, turn) - 1 AS BIGINT) AS idx
FROM ({USER_TURNS}) u""")
def p1(spark, sf):
    u = read_table(spark, sf, "conversations").filter(F.col("role") == "user")
    u = u.withColumn("split", P.hash_split("conv_id", method="modulo"))
    u = P.with_split_index(u, ["conv_id", "turn"])
    return flat(P.to_prompt_rows(u, P.prompt_struct("chat", F.col("text"), "dialog", "model", F.lit(""),
                                                    F.col("split"), F.col("index"))))


PAIRS_TEXT = """
SELECT u.conv_id, u.turn, u.text AS question, a.text AS reply
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'"""


def pairs_text(spark, sf):
    c = read_table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("reply"))
    return u.join(a, ["conv_id", "turn"])


@reg("P2_gsm8k_prompts", f"""
WITH p AS ({PAIRS_TEXT}),
x AS (SELECT *, reply || ' #### ' || CAST(conv_id * 7 + turn AS VARCHAR) || ',000' AS answer, {split_mod('conv_id')} AS split FROM p)
SELECT 'openai/gsm8k' AS data_source, 'user' AS role, question || ' ' || {sql_str(TPL.GSM8K_INSTRUCTION)} AS content,
       'math' AS ability, 'rule' AS style, replace(regexp_extract(answer, '#### (\\-?[0-9\\.\\,]+)', 1), ',', '') AS ground_truth,
       split, CAST(row_number() OVER (PARTITION BY split ORDER BY conv_id, turn) - 1 AS BIGINT) AS idx FROM x""")
def p2(spark, sf):
    x = pairs_text(spark, sf).withColumn(
        "answer", F.concat(F.col("reply"), F.lit(" #### "), (F.col("conv_id") * 7 + F.col("turn")).cast("string"), F.lit(",000")))
    x = P.with_split_index(x.withColumn("split", P.hash_split("conv_id", method="modulo")), ["conv_id", "turn"])
    return flat(P.gsm8k_prompts(x))


@reg("P3_math_prompts", f"""
SELECT 'lighteval/MATH' AS data_source, 'user' AS role, text || ' ' || {sql_str(TPL.MATH_INSTRUCTION)} AS content,
       'math' AS ability, 'rule' AS style, '\\frac{{' || CAST(item_id AS VARCHAR) || '}}{{7}}' AS ground_truth,
       {split_mod('item_id')} AS split, CAST(row_number() OVER (PARTITION BY {split_mod('item_id')} ORDER BY item_id) - 1 AS BIGINT) AS idx
FROM benchmark""")
def p3(spark, sf):
    b = read_table(spark, sf, "benchmark")
    sol = F.concat(F.lit("So \\boxed{"), F.col("item_id").cast("string"), F.lit("} and finally \\boxed{\\frac{"),
                   F.col("item_id").cast("string"), F.lit("}{7}}"))
    x = b.select("item_id", F.col("text").alias("problem"), sol.alias("solution"),
                 P.hash_split("item_id", method="modulo").alias("split"))
    x = P.with_split_index(x, "item_id")
    return flat(P.math_prompts(x))


@reg("P4_kk_prompts", f"""
WITH x AS (SELECT *, row_number() OVER (ORDER BY rollout_id) - 1 AS pos, count(*) OVER () AS n FROM fx_puzzle)
SELECT 'kk_logic' AS data_source, 'user' AS role, {sql_render(TPL.KK_QWEN, quiz='response')} AS content, 'logic' AS ability,
       'rule' AS style, CAST(to_json({{'solution_text_format': solution_text_format, 'statements': CAST(uid AS VARCHAR)}}) AS VARCHAR) AS ground_truth,
       CASE WHEN pos < n - n // 10 THEN 'train' ELSE 'test' END AS split,
       CAST(CASE WHEN pos < n - n // 10 THEN pos ELSE pos - (n - n // 10) END AS BIGINT) AS idx
FROM x""", ("fx_puzzle",))
def p4(spark, sf):
    x = fixture(spark, sf, "fx_puzzle").select("rollout_id", F.col("response").alias("quiz"), "solution_text_format",
                                                F.col("uid").cast("string").alias("statements"))
    n = x.count()
    x = P.positional_split(x, "rollout_id", n - n // 10, n // 10, n=n)
    return flat(P.kk_prompts(x, "qwen-instruct"))


@reg("P5_countdown_prompts", f"""
WITH x AS (SELECT *, row_number() OVER (ORDER BY rollout_id) - 1 AS pos, count(*) OVER () AS n FROM fx_countdown)
SELECT 'countdown' AS data_source, 'user' AS role,
       {sql_render(TPL.COUNTDOWN_BASE, numbers="'[' || CAST(a AS VARCHAR) || ', ' || CAST(b AS VARCHAR) || ']'", target='CAST(target AS VARCHAR)')} AS content,
       'math' AS ability, 'rule' AS style, CAST(to_json({{'target': target, 'numbers': [a, b]}}) AS VARCHAR) AS ground_truth,
       CASE WHEN pos < n - n // 10 THEN 'train' ELSE 'test' END AS split,
       CAST(CASE WHEN pos < n - n // 10 THEN pos ELSE pos - (n - n // 10) END AS BIGINT) AS idx
FROM x""", ("fx_countdown",))
def p5(spark, sf):
    x = fixture(spark, sf, "fx_countdown").select("rollout_id", F.array("a", "b").alias("nums"), "target")
    n = x.count()
    x = P.positional_split(x, "rollout_id", n - n // 10, n // 10, n=n)
    return flat(P.countdown_prompts(x, "base"))


PAIRS_NUM = """SELECT DISTINCT o_custkey % 1000 AS num1, o_orderkey % 100 AS num2,
       CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN '*' WHEN 1 THEN '+' ELSE '-' END AS op FROM orders"""


def _num_pairs(spark, sf):
    o = read_table(spark, sf, "orders")
    x = o.select((F.col("o_custkey") % 1000).alias("num1"), (F.col("o_orderkey") % 100).alias("num2"),
                 F.when(F.col("o_orderkey") % 3 == 0, "*").when(F.col("o_orderkey") % 3 == 1, "+").otherwise("-").alias("op"))
    return P.dedupe(x)


@reg("P6_arithmetic_prompts", f"""
WITH x AS (SELECT *, row_number() OVER (ORDER BY num1, num2, op) - 1 AS pos, count(*) OVER () AS n FROM ({PAIRS_NUM}) d)
SELECT 'yolo/arithmetic-3_digit' AS data_source, 'user' AS role,
       {sql_render(TPL.ARITH, num1='CAST(num1 AS VARCHAR)', op='op', num2='CAST(num2 AS VARCHAR)')} AS content, 'math' AS ability,
       'rule' AS style, CAST(CASE op WHEN '*' THEN num1 * num2 WHEN '+' THEN num1 + num2 ELSE num1 - num2 END AS VARCHAR) AS ground_truth,
       CASE WHEN pos < n - n // 5 THEN 'train' ELSE 'test' END AS split,
       CAST(CASE WHEN pos < n - n // 5 THEN pos ELSE pos - (n - n // 5) END AS BIGINT) AS idx
FROM x""")
def p6(spark, sf):
    x = _num_pairs(spark, sf)
    n = x.count()
    s = P.positional_split(x, ["num1", "num2", "op"], n - n // 5, n // 5, "head_tail", n=n)
    return flat(P.arithmetic_prompts(s))


@reg("P7_multiply_prompts", f"""
WITH x AS (SELECT *, row_number() OVER (ORDER BY num1, num2, op) - 1 AS pos, count(*) OVER () AS n FROM ({PAIRS_NUM}) d)
SELECT 'yolo/multiply-3_digit' AS data_source, 'user' AS role,
       {sql_render(TPL.MULTIPLY, num1='CAST(num1 AS VARCHAR)', num2='CAST(num2 AS VARCHAR)')} AS content, 'math' AS ability,
       'rule' AS style, CAST(num1 * num2 AS VARCHAR) AS ground_truth,
       CASE WHEN pos < n - n // 5 THEN 'train' ELSE 'test' END AS split,
       CAST(CASE WHEN pos < n - n // 5 THEN pos ELSE pos - (n - n // 5) END AS BIGINT) AS idx
FROM x""")
def p7(spark, sf):
    x = _num_pairs(spark, sf)
    n = x.count()
    s = P.positional_split(x, ["num1", "num2", "op"], n - n // 5, n // 5, "head_tail", n=n)
    return flat(P.arithmetic_prompts(s, multiply=True))


def _clean_sql(e: str) -> str:
    return (f"replace(regexp_replace(replace(regexp_replace({e}, '^\\s+|\\s+$', '', 'g'), ' [title]', '. '), "
            f"'\\[[^\\n]*?\\]', '', 'g'), '  ', ' ')")


@reg("P8_hellaswag_prompts", f"""
WITH x AS (SELECT doc_id, lang AS activity_label, text AS ctx_a, source AS ctx_b, string_split(text, chr(10)) AS endings,
                  CASE WHEN doc_id % 7 = 0 THEN '' ELSE CAST(doc_id % 4 AS VARCHAR) END AS label,
                  {split_mod('doc_id')} AS split FROM documents),
y AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS idx FROM x WHERE length(label) > 0)
SELECT {_clean_sql("activity_label || ': ' || ctx_a || ' ' || upper(left(ctx_b, 1)) || lower(substr(ctx_b, 2))")} AS query,
       array_to_string(list_transform(endings, lambda e: {_clean_sql('e')}), '|') AS choices,
       'Rowan/hellaswag' AS data_source, CAST(label AS INT) AS ground_truth, split, CAST(idx AS BIGINT) AS idx FROM y""")
def p8(spark, sf):
    d = read_table(spark, sf, "documents")
    x = d.select("doc_id", F.col("lang").alias("activity_label"), F.col("text").alias("ctx_a"), F.col("source").alias("ctx_b"),
                 F.split("text", "\n").alias("endings"),
                 F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise((F.col("doc_id") % 4).cast("string")).alias("label"),
                 P.hash_split("doc_id", method="modulo").alias("split"))
    out = P.hellaswag_prompts(P.with_split_index(P.labelled(x), "doc_id"))
    return out.select(F.col("prompt")[0]["content"].alias("query"), F.array_join("reward_model.choices", "|").alias("choices"),
                      "data_source", F.col("reward_model.ground_truth").alias("ground_truth"), F.col("extra_info.split").alias("split"),
                      F.col("extra_info.index").alias("idx"))


@reg("P9_sft_rows", f"""
WITH p AS ({PAIRS_TEXT})
SELECT conv_id * 1000 + turn AS row_id, 0 AS variant, question AS prompt, reply AS response FROM p
UNION ALL SELECT conv_id * 1000 + turn, 1, question, reverse(reply) FROM p""")
def p9(spark, sf):
    p = pairs_text(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("question").alias("prompt"),
                                     F.col("reply").alias("chosen"), F.reverse("reply").alias("rejected"))
    return P.sft_rows(p)


@reg("P10_rm_split", f"""
WITH x AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos, count(*) OVER () AS n FROM ({USER_TURNS}) u)
SELECT conv_id, turn, CASE WHEN pos < floor(n * 0.75) THEN 'train' ELSE 'test' END AS split,
       CAST(CASE WHEN pos < floor(n * 0.75) THEN pos ELSE pos - floor(n * 0.75) END AS BIGINT) AS "index" FROM x""")
def p10(spark, sf):
    u = read_table(spark, sf, "conversations").filter(F.col("role") == "user").select("conv_id", "turn")
    return P.rm_split(u, ["conv_id", "turn"]).select("conv_id", "turn", "split", "index")


@reg("P11_rl_prompts", f"""
WITH p AS ({PAIRS_TEXT}), x AS (SELECT *, {split_mod('conv_id')} AS split FROM p)
SELECT 'Dahoas/full-hh-rlhf' AS data_source, 'user' AS role, question AS content, 'alignment' AS ability, 'model' AS style,
       reply AS ground_truth, split, CAST(row_number() OVER (PARTITION BY split ORDER BY conv_id, turn) - 1 AS BIGINT) AS idx FROM x""")
def p11(spark, sf):
    x = pairs_text(spark, sf).withColumn("split", P.hash_split("conv_id", method="modulo"))
    x = P.with_split_index(x, ["conv_id", "turn"]).withColumnRenamed("question", "prompt").withColumnRenamed("reply", "response")
    return flat(P.rl_prompts(x))


# retrieval examples: benchmark passages as queries, gold = documents containing them
EXAMPLES_SQL = f"""
SELECT b.item_id AS qid, b.text AS query, 't' || CAST(b.item_id % 3 AS VARCHAR) AS task,
       list_sort(coalesce(list(CAST(q.doc_id AS VARCHAR)) FILTER (WHERE q.doc_id IS NOT NULL), [])) AS gold_ids,
       list_sort(coalesce((SELECT list(CAST(e.doc_id AS VARCHAR)) FROM ({FIXTURES['fx_excluded']}) e WHERE e.qid = b.item_id), [])) AS excluded_ids
FROM benchmark b LEFT JOIN ({FIXTURES['fx_qrels']}) q ON q.qid = b.item_id GROUP BY b.item_id, b.text"""


def examples(spark, sf):
    b = read_table(spark, sf, "benchmark")
    from kestrel.plans.retrieval_queries import qrels
    qr = qrels(spark, sf).groupBy("qid").agg(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))).alias("gold_ids"))
    e = b.select(F.col("item_id").alias("qid"), F.col("text").alias("query"),
                 F.concat(F.lit("t"), (F.col("item_id") % 3).cast("string")).alias("task"))
    e = e.join(qr, "qid", "left")
    return e.select("qid", "query", "task", F.coalesce("gold_ids", F.array().cast("array<string>")).alias("gold_ids"))


def _qrels_json_sql() -> str:
    return ("CAST(to_json({'qrels': map_from_entries([(CAST(qid AS VARCHAR), "
            "map_from_entries(list_transform(gold_ids, lambda g: (g, 1))))])}) AS VARCHAR)")


@reg("P12_retrieval_prompts", f"""
WITH e AS ({EXAMPLES_SQL}),
s AS (SELECT *, unnest(['train', 'test']) AS split FROM e),
i AS (SELECT *, row_number() OVER (PARTITION BY task, split ORDER BY qid) - 1 AS idx FROM s)
SELECT 'BRIGHT_bm25_reasoner_' || task AS data_source, 'user' AS role, {sql_render(TPL.RETRIEVAL_QUERY, query='query')} AS content,
       'math' AS ability, 'rule' AS style, {_qrels_json_sql()} AS ground_truth, split, CAST(idx AS BIGINT) AS idx FROM i""")
def p12(spark, sf):
    e = P.all_splits(examples(spark, sf))
    e = index_within(e, ["task", "split"], "qid", "idx")
    return flat(P.retrieval_prompts(e, "query"), idx="idx")


@reg("P14_raw_search_prompts", f"""
WITH e AS ({EXAMPLES_SQL}),
s AS (SELECT *, unnest(['train', 'test']) AS split FROM e),
i AS (SELECT *, row_number() OVER (PARTITION BY task, split ORDER BY qid) - 1 AS idx FROM s)
SELECT 'BRIGHT_bm25_reasoner_' || task AS data_source, 'user' AS role,
       {sql_render(TPL.CHATML_USER, prompt=sql_render(TPL.RAW_SEARCH_PROMPT, query='query'))} AS content,
       'math' AS ability, 'rule' AS style, {_qrels_json_sql()} AS ground_truth, split, CAST(idx AS BIGINT) AS idx FROM i""")
def p14(spark, sf):
    e = P.all_splits(examples(spark, sf))
    e = index_within(e, ["task", "split"], "qid", "idx")
    return flat(P.retrieval_prompts(e, "raw"), idx="idx")


DELTA_SQL = f"""
WITH e AS ({EXAMPLES_SQL}),
g AS (SELECT e.qid, list(d.text ORDER BY u.pos) AS docs
      FROM (SELECT qid, unnest(gold_ids) AS gid, unnest(generate_series(1, len(gold_ids))) AS pos FROM e) u
      JOIN documents d ON CAST(d.doc_id AS VARCHAR) = u.gid JOIN e ON e.qid = u.qid GROUP BY e.qid),
x AS (SELECT e.*, coalesce(g.docs, []) AS pos_docs_list FROM e LEFT JOIN g USING (qid))"""


@reg("P13_delta_prompts", DELTA_SQL + f""",
s AS (SELECT *, 'train' AS split, row_number() OVER (PARTITION BY task ORDER BY qid) - 1 AS idx FROM x)
SELECT 'BRIGHT_bm25_reasoner_' || task AS data_source, 'user' AS role,
       {sql_render(TPL.CHATML_USER, prompt=sql_render(TPL.DELTA_PROMPT, query='query'))} AS content, 'math' AS ability, 'rule' AS style,
       CAST(to_json({{'query': query, 'pos_docs_list': pos_docs_list}}) AS VARCHAR) AS ground_truth, split, CAST(idx AS BIGINT) AS idx FROM s""")
def p13(spark, sf):
    e = examples(spark, sf).withColumn("split", F.lit("train"))
    e = index_within(e, "task", "qid", "idx")
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return flat(P.delta_prompts(e, docs), idx="idx")


@reg("P15_chat_only_prompts", DELTA_SQL + f"""
SELECT qid, 'system' AS role0, {sql_str(TPL.SYSTEM_HELPFUL)} AS content0, {sql_render(TPL.DELTA_PROMPT, query='query')} AS content1,
       CAST(to_json({{'query': query, 'pos_docs_list': pos_docs_list}}) AS VARCHAR) AS answer FROM x""")
def p15(spark, sf):
    e = examples(spark, sf).withColumn("split", F.lit("train")).withColumn("idx", F.lit(0))
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = P.delta_prompts(e, docs, chat_only=True)
    return out.select("qid", F.col("prompt")[0]["role"].alias("role0"), F.col("prompt")[0]["content"].alias("content0"),
                      F.col("prompt")[1]["content"].alias("content1"), "answer")


@reg("P16_all_tasks_splits", f"""
WITH e AS ({EXAMPLES_SQL}) SELECT task, split, count(*) AS n FROM (SELECT task, unnest(['train', 'test']) AS split FROM e) x GROUP BY ALL""")
def p16(spark, sf):
    e = P.all_splits(examples(spark, sf))
    return e.groupBy("task", "split").agg(F.count(F.lit(1)).alias("n"))


@reg("P17_index_within_split", f"""
SELECT doc_id, {split_mod('doc_id')} AS split, CAST(row_number() OVER (PARTITION BY {split_mod('doc_id')} ORDER BY doc_id) - 1 AS BIGINT) AS "index"
FROM documents""")
def p17(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", P.hash_split("doc_id", method="modulo").alias("split"))
    return P.with_split_index(d, "doc_id")


@reg("P18_positional_split", """
WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN pos < n - n // 5 THEN 'train' ELSE 'test' END AS split,
       CAST(CASE WHEN pos < n - n // 5 THEN pos ELSE pos - (n - n // 5) END AS BIGINT) AS "index"
FROM x""")
def p18(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    n = d.count()
    return P.positional_split(d, "doc_id", n - n // 5, n // 5, "head_next", n=n).select("doc_id", "split", "index")


@reg("P19_longest_query", f"""
WITH e AS ({EXAMPLES_SQL}) SELECT task, max(length(query)) AS max_chars, max(length(query)) > 8000 AS too_long FROM e GROUP BY task""")
def p19(spark, sf):
    return P.longest_query(examples(spark, sf)).select("task", F.col("max_chars").cast("bigint").alias("max_chars"), "too_long")


@reg("P20_gold_excluded_overlap", f"""
WITH e AS ({EXAMPLES_SQL})
SELECT qid, CAST(len(list_intersect(gold_ids, list_concat(excluded_ids, gold_ids[1:1]))) AS INT) AS n_overlap FROM e
WHERE len(list_intersect(gold_ids, list_concat(excluded_ids, gold_ids[1:1]))) > 0""")
def p20(spark, sf):
    # the check must flag a planted violation: add each example's first gold id to its exclusions
    from kestrel.plans.retrieval_queries import qrels
    ids = lambda df: df.select("qid", F.col("doc_id").cast("string").alias("doc_id"))
    gold = ids(qrels(spark, sf))
    planted = gold.groupBy("qid").agg(F.min("doc_id").alias("doc_id"))
    return P.overlap_violations(gold, ids(fixture(spark, sf, "fx_excluded")).unionByName(planted))


@reg("P21_dedupe", "SELECT DISTINCT sha256(text) AS content_hash FROM documents")
def p21(spark, sf):
    d = read_table(spark, sf, "documents").select(F.sha2("text", 256).alias("content_hash"))
    return P.dedupe(d)


@reg("P22_length_filter", f"""
SELECT false AS enabled, count(*) AS n FROM ({USER_TURNS}) u
UNION ALL SELECT true, count(*) FROM ({USER_TURNS}) u WHERE len(string_split(text, ' ')) <= 64""")
def p22(spark, sf):
    u = read_table(spark, sf, "conversations").filter(F.col("role") == "user").withColumn("prompt_ids", F.split("text", " "))
    off = P.filter_long_prompts(u, max_len=64, enabled=False).agg(F.count(F.lit(1)).alias("n"))
    on = P.filter_long_prompts(u, max_len=64, enabled=True).agg(F.count(F.lit(1)).alias("n"))
    return off.select(F.lit(False).alias("enabled"), "n").unionByName(on.select(F.lit(True).alias("enabled"), "n"))


@reg("P23_nested_field", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def p23(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", F.array(F.from_json("props", "k bigint")).alias("wrapped"))
    return e.select("event_id", P.nested_field(P.unwrap_single("wrapped"), ["k"]).alias("k"))


@reg("P24_index_default", f"""
WITH e AS ({EXAMPLES_SQL}) SELECT CAST(0 AS BIGINT) AS "index", count(*) * 2 AS n FROM e""")
def p24(spark, sf):
    e = P.all_splits(examples(spark, sf))
    e = index_within(e, ["task", "split"], "qid", "idx")
    rows = P.retrieval_prompts(e, "query")
    return rows.select(P.row_index(rows).alias("index")).groupBy("index").agg(F.count(F.lit(1)).alias("n"))


@reg("P25_hash_split", """
SELECT CASE WHEN o_orderkey % 5 * 20 < 80 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM orders GROUP BY ALL""")
def p25(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.groupBy(P.hash_split("o_orderkey", 80, method="modulo").alias("split")).agg(F.count(F.lit(1)).alias("n"))
