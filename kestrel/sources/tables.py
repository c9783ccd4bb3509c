"""Driver tables and the derived fixture views.

Each fixture is one SQL text that runs unchanged in Spark SQL and DuckDB,
so the same derived input feeds both the Spark operator and its oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


# Fixture views (shared text with the oracle SQL).
FIXTURES = {
    "fx_rollouts": """
SELECT CAST(o_orderkey AS BIGINT) AS rollout_id, CAST(o_custkey AS BIGINT) AS uid, CAST(o_custkey % 8 AS INT) AS batch_id,
       CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'kk_logic' WHEN 1 THEN 'openai/gsm8k' WHEN 2 THEN 'countdown' ELSE 'yolo/multiply-3_digit' END AS data_source,
       CAST(CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 3 WHEN 1 THEN -0.5 WHEN 2 THEN -1 ELSE 0 END AS DOUBLE) AS score,
       CAST(5 + o_orderkey % 60 AS INT) AS response_len, CAST(20 + o_custkey % 100 AS INT) AS prompt_len
FROM orders""",
    "fx_tokens": """
SELECT rollout_id, batch_id, t, n, CASE WHEN t < n - rollout_id % 20 THEN 1 ELSE 0 END AS mask,
       CASE WHEN t = n - rollout_id % 20 - 1 THEN value ELSE 0.0E0 END AS reward,
       value / 8.0E0 AS v, -(value / 64.0E0) AS old_lp, -(value / 64.0E0) - (t % 5) / 32.0E0 AS lp, -(value / 64.0E0) + (t % 3) / 16.0E0 AS ref_lp
FROM (SELECT CAST(user_id AS BIGINT) AS rollout_id, CAST(user_id % 4 AS INT) AS batch_id, value,
             CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS t,
             CAST(COUNT(*) OVER (PARTITION BY user_id) AS INT) AS n FROM events) x""",
    "fx_gsm8k": """
SELECT rollout_id, uid,
       CASE CAST(rollout_id % 5 AS INT) WHEN 0 THEN CONCAT('so #### ', CAST(uid AS VARCHAR(20)))
            WHEN 1 THEN CONCAT('#### ', CAST(uid + 1 AS VARCHAR(20)), ' then #### ', CAST(uid AS VARCHAR(20)))
            WHEN 2 THEN CONCAT('#### -', CAST(uid AS VARCHAR(20)), '.') WHEN 3 THEN CONCAT('about ', CAST(uid AS VARCHAR(20)), ' . no mark')
            ELSE CONCAT('#### 1,', CAST(uid AS VARCHAR(20))) END AS response, CAST(uid AS VARCHAR(20)) AS ground_truth
FROM (SELECT o_orderkey AS rollout_id, o_custkey AS uid FROM orders) r""",
    "fx_puzzle": """
SELECT rollout_id, uid,
       CONCAT('(1) Ann is a ', CASE WHEN uid % 2 = 0 THEN 'knight' ELSE 'knave' END, chr(10), '(2) Bob is a ', CASE WHEN uid % 3 = 0 THEN 'knight' ELSE 'knave' END) AS solution_text_format,
       CONCAT(CASE WHEN rollout_id % 11 = 0 THEN 'no header ' ELSE 'User: q Assistant: ' END, '<think>z</think>', CASE WHEN rollout_id % 7 = 0 THEN '<answer></answer>' ELSE '' END,
              '<answer>(1) Ann is a ', CASE WHEN rollout_id % 2 = 0 THEN 'knight' ELSE 'knave' END, chr(10), '(2) Bob is a ', CASE WHEN rollout_id % 3 = 0 THEN 'Knight' ELSE 'knave' END,
              CASE WHEN rollout_id % 13 = 0 THEN ' or knight' ELSE '' END, '</answer>') AS response
FROM (SELECT o_orderkey AS rollout_id, o_custkey AS uid FROM orders) r""",
    "fx_countdown": """
SELECT rollout_id, a, b, CASE WHEN rollout_id % 4 = 0 THEN a * b ELSE a + b END AS target,
       CONCAT('Assistant: think', chr(10), '<answer>', CAST(a AS VARCHAR(20)), CASE CAST(rollout_id % 3 AS INT) WHEN 0 THEN ' + ' WHEN 1 THEN ' * ' ELSE ' - ' END,
              CAST(CASE WHEN rollout_id % 10 = 0 THEN b + 1 ELSE b END AS VARCHAR(20)), '</answer>') AS response
FROM (SELECT o_orderkey AS rollout_id, o_custkey % 90 + 1 AS a, o_orderkey % 50 + 1 AS b FROM orders) r""",
    "fx_qrels": """
SELECT b.item_id AS qid, d.doc_id, 1 AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text)""",
    "fx_excluded": """
SELECT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id AND NOT contains(d.text, b.text)""",
    "fx_lengths": """
SELECT doc_id AS row_id, CAST(doc_id % 512 AS INT) AS row_idx, CAST(FLOOR(doc_id / 512) AS INT) AS batch_id, CAST(n_chars % 512 + 1 AS INT) AS seqlen FROM documents""",
    "fx_metrics": """
SELECT CAST(event_id % 4 AS INT) AS run, CAST(FLOOR(event_id / 200) AS INT) AS step, event_type AS metric, value FROM events""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_tables(spark, sf_dir)
    return spark.sql(FIXTURES[name])


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix an oracle query with the fixture CTEs it uses."""
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n]}\n)" for n in names)
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{sql}"
