"""Registered source/sink (S*), user-function (U*) and streaming (ST*) queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.operators import inference as U
from kestrel.operators import scoring as S
from kestrel.operators import tokens as TK
from kestrel.plans import prep_queries as PQ
from kestrel.plans import scoring_queries as SQ
from kestrel.sources import io as IO
from kestrel.sources.tables import FIXTURES, fixture, read_table, register_tables, with_fixtures

Q: dict = {}


def reg(name, sql=None, fixtures=()):
    def deco(fn):
        Q[name] = (fn, with_fixtures(sql, *fixtures) if (sql and fixtures) else sql)
        return fn
    return deco


def path_of(sf, name):
    return f"{sf.rstrip('/')}/{name}.parquet"


# ------------------------------------------------------------------- sources

@reg("S1_read_parquet_union", """
SELECT count(*) AS n_rows, count(text) AS n_text, count(quality) AS n_quality
FROM (SELECT * FROM documents UNION ALL BY NAME SELECT * FROM labels) u""")
def s1(spark, sf):
    u = IO.read_parquet_many(spark, [path_of(sf, "documents"), path_of(sf, "labels")])
    return u.agg(F.count(F.lit(1)).alias("n_rows"), F.count("text").alias("n_text"), F.count("quality").alias("n_quality"))


CONV_SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                            T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


@reg("S2_read_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def s2(spark, sf):
    p = IO.shared_path(spark, "jsonl")
    read_table(spark, sf, "conversations").write.mode("overwrite").json(p)
    return IO.read_jsonl(spark, p, CONV_SCHEMA)


@reg("S3_read_split", "SELECT doc_id, lang FROM documents WHERE source = 'src3'")
def s3(spark, sf):
    return IO.read_split(spark, path_of(sf, "documents"), "source", "src3").select("doc_id", "lang")


@reg("S4_write_splits", f"""
SELECT {PQ.split_mod('doc_id')} AS split, count(*) AS n FROM documents GROUP BY ALL""")
def s4(spark, sf):
    from kestrel.operators import prep as P
    d = read_table(spark, sf, "documents").select("doc_id", "text", P.hash_split("doc_id", method="modulo").alias("split"))
    p = IO.write_splits(d, IO.shared_path(spark, "splits"))
    return spark.read.parquet(p).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@reg("S5_save_load_batch", """
SELECT rollout_id, CAST(count(*) AS INT) AS n, CAST(sum(mask * (t + 1)) AS BIGINT) AS chk FROM fx_tokens GROUP BY rollout_id""",
     ("fx_tokens",))
def s5(spark, sf):
    arr = TK.to_arrays(fixture(spark, sf, "fx_tokens"), "rollout_id", "t", ["mask", "v"])
    p = IO.save_batch(arr, IO.shared_path(spark, "batch"))
    back = IO.load_batch(spark, p)
    chk = F.aggregate(F.transform("mask", lambda x, i: (x * (i + 1)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return back.select("rollout_id", F.size("mask").alias("n"), chk.alias("chk"))


@reg("S6_dump_append", """
SELECT name, count(*) AS n, round(sum(value), 6) AS total
FROM (SELECT 'before' AS name, value FROM fx_metrics UNION ALL SELECT 'after', value * 2 FROM fx_metrics) x GROUP BY name""",
     ("fx_metrics",))
def s6(spark, sf):
    m = fixture(spark, sf, "fx_metrics")
    base = IO.shared_path(spark, "dump")
    IO.dump(m, base, "before")
    IO.dump(m.withColumn("value", F.col("value") * 2), base, "after")
    IO.dump(m, base, "disabled", enabled=False)
    back = spark.read.parquet(base)
    return back.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def _step_metrics(spark, sf):
    m = fixture(spark, sf, "fx_metrics")
    return m.groupBy("run", "step", "metric").agg(F.avg("value").alias("value"))


@reg("S7_metrics_sink", """
SELECT run, step, metric, round(avg(value), 6) AS value FROM fx_metrics GROUP BY ALL""", ("fx_metrics",))
def s7(spark, sf):
    p = IO.shared_path(spark, "metrics")
    IO.log_metrics(_step_metrics(spark, sf), p)
    return spark.read.parquet(p).select("run", "step", "metric", F.round("value", 6).alias("value"))


S8_SQL = """
WITH a AS (SELECT run, step, metric, avg(value) AS v FROM fx_metrics GROUP BY ALL)
SELECT run, step, 'step:' || CAST(step AS VARCHAR) || ' - ' || string_agg(metric || ':' || printf('%.3f', v), ' - ' ORDER BY metric) AS line
FROM a GROUP BY run, step"""


@reg("S8_format_step", S8_SQL, ("fx_metrics",))
def s8(spark, sf):
    return IO.format_steps(_step_metrics(spark, sf))


@reg("S9_parse_logs", """
WITH a AS (SELECT run, step, avg(value) AS v FROM fx_metrics WHERE metric = 'view' GROUP BY ALL)
SELECT run, max(CAST(printf('%.3f', v) AS DOUBLE)) AS best, max(CAST(printf('%.3f', v) AS DOUBLE)) > 200.0 AS passed
FROM a GROUP BY run""", ("fx_metrics",))
def s9(spark, sf):
    lines = IO.format_steps(_step_metrics(spark, sf))
    p = IO.shared_path(spark, "logs")
    # one text log per run, read back with the text source
    lines.select(F.concat(F.col("run").cast("string"), F.lit("|"), F.col("line")).alias("value")).write.mode("overwrite").text(p)
    back = IO.read_logs(spark, p).select(F.split("line", r"\|").getItem(0).cast("int").alias("run"),
                                         F.split("line", r"\|").getItem(1).alias("line"))
    return IO.best_from_logs(back, "view", 200.0)


# -------------------------------------------------------------- user functions

def _mixed_rollouts(spark, sf):
    ro = fixture(spark, sf, "fx_rollouts").select("rollout_id", "data_source")
    pz = fixture(spark, sf, "fx_puzzle").select("rollout_id", F.col("response").alias("r_kk"), "solution_text_format")
    gs = fixture(spark, sf, "fx_gsm8k").select("rollout_id", F.col("response").alias("r_gsm"), F.col("ground_truth").alias("gt_gsm"))
    cd = fixture(spark, sf, "fx_countdown").select("rollout_id", F.col("response").alias("r_cd"), "target", "a", "b")
    register_tables(spark, sf, ["orders"])
    mu = spark.sql(SQ.FX_MULTIPLY).select("rollout_id", F.col("response").alias("r_mu"), F.col("ground_truth").alias("gt_mu"))
    x = ro.join(pz, "rollout_id").join(gs, "rollout_id").join(cd, "rollout_id").join(mu, "rollout_id")
    ds = F.col("data_source")
    resp = (F.when(ds == "kk_logic", F.col("r_kk")).when(ds == "openai/gsm8k", F.col("r_gsm"))
            .when(ds == "countdown", F.col("r_cd")).otherwise(F.col("r_mu")))
    gt = (F.when(ds == "kk_logic", F.to_json(F.struct("solution_text_format")))
          .when(ds == "openai/gsm8k", F.col("gt_gsm"))
          .when(ds == "countdown", F.to_json(F.struct("target", F.array("a", "b").alias("numbers"))))
          .otherwise(F.col("gt_mu")))
    return x.select("rollout_id", "data_source", resp.alias("response"), gt.alias("ground_truth"))


def _sub(name):
    return "(" + SQ.Q[name][1] + ")"


@reg("U1_reward_registry", f"""
WITH fx_rollouts AS ({FIXTURES['fx_rollouts']}),
k AS (SELECT rollout_id, score FROM {_sub('V10_puzzle_score')} t),
g AS (SELECT rollout_id, score FROM {_sub('V1_gsm8k_strict')} t),
c AS (SELECT rollout_id, score FROM {_sub('V6_countdown_score')} t),
m AS (SELECT rollout_id, score FROM {_sub('V5_multiply_score')} t)
SELECT r.data_source, count(*) AS n,
       round(avg(CASE r.data_source WHEN 'kk_logic' THEN k.score WHEN 'openai/gsm8k' THEN g.score
                                    WHEN 'countdown' THEN c.score ELSE m.score END), 6) AS mean_score
FROM fx_rollouts r JOIN k USING (rollout_id) JOIN g USING (rollout_id) JOIN c USING (rollout_id) JOIN m USING (rollout_id)
GROUP BY r.data_source""")
def u1(spark, sf):
    scored = S.dispatch_scores(_mixed_rollouts(spark, sf), strict=True)
    return scored.groupBy("data_source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@reg("U2_row_mapper_registry", PQ.Q["P2_gsm8k_prompts"][1])
def u2(spark, sf):
    from kestrel.operators import prep as P
    x = PQ.pairs_text(spark, sf).withColumn(
        "answer", F.concat(F.col("reply"), F.lit(" #### "), (F.col("conv_id") * 7 + F.col("turn")).cast("string"), F.lit(",000")))
    x = P.with_split_index(x.withColumn("split", P.hash_split("conv_id", method="modulo")), ["conv_id", "turn"])
    return PQ.flat(U.map_rows(x, "gsm8k"))


def _count_words(pdf):
    return pdf.assign(n_words=pdf["text"].map(lambda t: len(t.split(" "))).astype("int32"),
                      n_chars=pdf["text"].map(len).astype("int32"))[["doc_id", "n_words", "n_chars"]]


@reg("U3_map_in_pandas", """
SELECT doc_id, CAST(len(string_split(text, ' ')) AS INT) AS n_words, CAST(length(text) AS INT) AS n_chars FROM documents""")
def u3(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return U.execute_on_chunks(d, _count_words, "doc_id long, n_words int, n_chars int")


@reg("U4_generate_samples", """
SELECT item_id AS row_idx, 3 AS n_responses,
       reverse(text) || ' #0' || chr(1) || reverse(text) || ' #1' || chr(1) || reverse(text) || ' #2' AS joined FROM benchmark""")
def u4(spark, sf):
    b = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("row_idx"), F.col("text").alias("prompt"))
    g = U.generate(b, U.echo_generator, 3)
    return g.select("row_idx", F.size("responses").alias("n_responses"), F.array_join("responses", "\u0001").alias("joined"))


@reg("U5_reward_model_scores", """
WITH r AS (SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) AS rendered
           FROM conversations GROUP BY conv_id),
i AS (SELECT conv_id, list_transform(string_split(rendered, ' '), lambda w: CAST(length(w) AS INT)) AS ids FROM r)
SELECT conv_id, round(CAST(list_sum(ids[1:256]) AS DOUBLE) / 256.0, 6) AS rm_score,
       CAST(least(len(ids), 256) - 1 AS INT) AS last_index FROM i""")
def u5(spark, sf):
    c = read_table(spark, sf, "conversations")
    r = TK.render_chat(c)
    ids = F.transform(F.split("rendered", " "), lambda w: F.length(w))
    x = r.select("conv_id", TK.truncate(ids, 256, "right").alias("ids"))
    x = x.select("conv_id", TK.pad_to_length("ids", 256, 0).alias("padded"), (F.size("ids") - 1).alias("last_index"))
    x = x.withColumn("rm_score", U.model_scores(x, "padded", 256, U.length_scorer(256)))
    return x.select("conv_id", F.round("rm_score", 6).alias("rm_score"), F.col("last_index").cast("int").alias("last_index"))


# ----------------------------------------------------------------- streaming

ROLLOUT_SCHEMA = T.StructType([T.StructField("rollout_id", T.LongType()), T.StructField("uid", T.LongType()),
                               T.StructField("batch_id", T.IntegerType()), T.StructField("data_source", T.StringType()),
                               T.StructField("score", T.DoubleType()), T.StructField("response_len", T.IntegerType()),
                               T.StructField("prompt_len", T.IntegerType())])


@reg("ST1_stream_step_metrics", """
WITH s AS (SELECT uid, count(*) AS n, avg(score) AS m, stddev_samp(score) AS sd FROM fx_rollouts GROUP BY uid),
a AS (SELECT r.*, (score - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE sd END + 1e-6) AS adv
      FROM fx_rollouts r JOIN s USING (uid))
SELECT batch_id, round(avg(score), 6) AS reward_mean, round(avg(CASE WHEN score = 0 THEN 1.0 ELSE 0.0 END), 6) AS recall_fail_ratio,
       round(avg(adv), 6) + 0.0 AS adv_mean, count(*) AS n_rows FROM a GROUP BY batch_id""", ("fx_rollouts",))
def st1(spark, sf):
    from kestrel.streaming.jobs import stream_step_metrics
    src = IO.shared_path(spark, "rollouts")
    rollouts = fixture(spark, sf, "fx_rollouts")
    sizes = rollouts.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_expected"))
    # every batch spans all files, and every file is a micro-batch
    rollouts.join(sizes, "batch_id").repartition(4, "rollout_id").write.mode("overwrite").parquet(src)
    sink, ckpt = IO.shared_path(spark, "st1-sink"), IO.shared_path(spark, "st1-ckpt")
    schema = T.StructType([*ROLLOUT_SCHEMA.fields, T.StructField("n_expected", T.LongType())])
    stream_step_metrics(spark, src, schema, sink, ckpt, test_freq=2,
                        validation_dir=IO.shared_path(spark, "st1-validation"))
    return spark.read.parquet(sink).select("batch_id", "reward_mean", "recall_fail_ratio",
                                           (F.round("adv_mean", 6) + F.lit(0.0)).alias("adv_mean"), "n_rows")


KL_STEP_SCHEMA = T.StructType([T.StructField("run", T.IntegerType()), T.StructField("step", T.IntegerType()),
                               T.StructField("current_kl", T.DoubleType()), T.StructField("n_rows", T.LongType())])


@reg("ST2_stream_adaptive_kl", """
WITH s AS (SELECT run, step, avg(value) / 1000.0 AS current_kl, count(*) AS n_rows FROM fx_metrics GROUP BY run, step),
f AS (SELECT *, 1 + greatest(least(current_kl / 0.05 - 1, 0.2), -0.2) * n_rows / 100.0 AS fac FROM s)
SELECT run, step, round(0.2 * coalesce(exp(sum(ln(fac)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0), 6) AS kl_coef
FROM f""", ("fx_metrics",))
def st2(spark, sf):
    from kestrel.streaming.jobs import stream_kl_coefficients
    m = fixture(spark, sf, "fx_metrics")
    steps = m.groupBy("run", "step").agg((F.avg("value") / 1000.0).alias("current_kl"), F.count(F.lit(1)).alias("n_rows"))
    src = IO.shared_path(spark, "kl-steps")
    # steps arrive out of order: files hold steps 2,5,8,... then 1,4,... then 0,3,...
    for r in (2, 1, 0):
        steps.filter(F.col("step") % 3 == r).coalesce(1).write.mode("append").parquet(src)
    sink, ckpt = IO.shared_path(spark, "st2-sink"), IO.shared_path(spark, "st2-ckpt")
    stream_kl_coefficients(spark, src, KL_STEP_SCHEMA, sink, ckpt, init=0.2, target=0.05, horizon=100.0)
    out = spark.read.parquet(sink).filter(F.col("status") == "step")
    return out.select("run", "step", F.round("kl_coef", 6).alias("kl_coef"))
