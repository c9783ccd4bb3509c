"""Registered metrics queries (M*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import metrics as M
from kestrel.operators import rl as R
from kestrel.operators.tokens import to_arrays
from kestrel.sources.tables import fixture, read_table, with_fixtures

Q: dict = {}


def register(name, sql=None, fixtures=()):
    def deco(fn):
        Q[name] = (fn, with_fixtures(sql, *fixtures) if (sql and fixtures) else sql)
        return fn
    return deco


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


@register("M1_response_info", """
SELECT rollout_id, CAST(sum(CASE WHEN t < 10 THEN mask ELSE 0 END) AS INT) AS prompt_length,
       CAST(sum(CASE WHEN t >= 10 THEN mask ELSE 0 END) AS INT) AS response_length FROM fx_tokens GROUP BY rollout_id""",
          ("fx_tokens",))
def m1(spark, sf):
    arr = to_arrays(fixture(spark, sf, "fx_tokens"), "rollout_id", "t", ["mask"])
    out = M.response_info(arr.withColumn("prompt_width", F.lit(10)), "mask")
    return out.select("rollout_id", "prompt_length", "response_length")


def _m2_inputs(spark, sf):
    tok = fixture(spark, sf, "fx_tokens")
    tok = tok.select("batch_id", "rollout_id", "t", "mask", F.col("reward").alias("score_tok"),
                     (F.col("reward") - 0.1 * (F.col("old_lp") - F.col("ref_lp")) * F.col("mask")).alias("reward_tok"),
                     (F.col("v") - 4.0).alias("advantage"), (F.col("reward") + F.col("v")).alias("returns"),
                     F.col("v").alias("values"), "n")
    rows = tok.groupBy("batch_id", "rollout_id").agg(
        F.sum("mask").alias("response_length"), F.max("n").alias("_n"))
    widths = rows.groupBy("batch_id").agg(F.max("_n").alias("max_response_length"))
    rows = rows.join(widths, "batch_id").select(
        "batch_id", "rollout_id", "response_length", "max_response_length",
        (20 + F.col("rollout_id") % 7).alias("prompt_length"), F.lit(26).alias("max_prompt_length"))
    return tok, rows


M2_SQL = """
WITH tok AS (SELECT batch_id, rollout_id, t, mask, n, reward AS score_tok, reward - 0.1 * (old_lp - ref_lp) * mask AS reward_tok,
                    v - 4.0 AS advantage, reward + v AS returns, v AS vals FROM fx_tokens),
rw AS (SELECT batch_id, rollout_id, sum(mask) AS rl, max(n) AS nn, 20 + rollout_id % 7 AS pl, sum(score_tok) AS s, sum(reward_tok) AS r
       FROM tok GROUP BY batch_id, rollout_id),
wd AS (SELECT batch_id, max(nn) AS mrl FROM rw GROUP BY batch_id),
a AS (SELECT batch_id, avg(s) AS "critic/score/mean", max(s) AS "critic/score/max", min(s) AS "critic/score/min",
             avg(r) AS "critic/rewards/mean", max(r) AS "critic/rewards/max", min(r) AS "critic/rewards/min",
             avg(rl) AS "response_length/mean", max(rl) AS "response_length/max", min(rl) AS "response_length/min",
             avg(CASE WHEN rl = mrl THEN 1.0 ELSE 0.0 END) AS "response_length/clip_ratio",
             avg(pl) AS "prompt_length/mean", max(pl) AS "prompt_length/max", min(pl) AS "prompt_length/min",
             avg(CASE WHEN pl = 26 THEN 1.0 ELSE 0.0 END) AS "prompt_length/clip_ratio"
      FROM rw JOIN wd USING (batch_id) GROUP BY batch_id),
b AS (SELECT batch_id, avg(advantage) AS "critic/advantages/mean", max(advantage) AS "critic/advantages/max",
             min(advantage) AS "critic/advantages/min", avg(returns) AS "critic/returns/mean", max(returns) AS "critic/returns/max",
             min(returns) AS "critic/returns/min", avg(vals) AS "critic/values/mean", max(vals) AS "critic/values/max",
             min(vals) AS "critic/values/min", 1.0 - var_samp(returns - vals) / (var_samp(returns) + 1e-5) AS "critic/vf_explained_var"
      FROM tok WHERE mask <> 0 GROUP BY batch_id),
w AS (SELECT * FROM a JOIN b USING (batch_id)),
u AS (UNPIVOT (SELECT batch_id, COLUMNS(* EXCLUDE (batch_id))::DOUBLE FROM w) ON COLUMNS(* EXCLUDE (batch_id)) INTO NAME metric VALUE value)
SELECT batch_id, metric, round(value, 6) + 0.0 AS value FROM u"""


@register("M2_data_metrics", M2_SQL, ("fx_tokens",))
def m2(spark, sf):
    tok, rows = _m2_inputs(spark, sf)
    out = M.data_metrics(tok, rows)
    return out.select("batch_id", "metric", r6(F.col("value")).alias("value"))


def _timings(spark, sf):
    ev = read_table(spark, sf, "events")
    name = (F.when(F.col("event_type") == "view", "gen").when(F.col("event_type") == "click", "ref")
            .when(F.col("event_type") == "error", "values").when(F.col("event_type") == "signup", "adv")
            .otherwise("update_actor"))
    return (ev.groupBy((F.col("event_id") % 8).cast("int").alias("batch_id"), name.alias("name"))
              .agg((F.sum("value") / 1000.0).alias("seconds")))


@register("M3_timing_metrics", """
WITH tm AS (SELECT CAST(event_id % 8 AS INT) AS batch_id,
                   CASE event_type WHEN 'view' THEN 'gen' WHEN 'click' THEN 'ref' WHEN 'error' THEN 'values'
                        WHEN 'signup' THEN 'adv' ELSE 'update_actor' END AS name, sum(value) / 1000.0 AS seconds
            FROM events GROUP BY ALL),
tt AS (SELECT batch_id, sum(prompt_len) AS pt, sum(response_len) AS rt FROM fx_rollouts GROUP BY batch_id)
SELECT batch_id, 'timing_s/' || name AS metric, round(seconds, 6) + 0.0 AS value FROM tm JOIN tt USING (batch_id)
UNION ALL
SELECT batch_id, 'timing_per_token_ms/' || name AS metric,
       round(seconds * 1000 / CASE WHEN name = 'gen' THEN rt ELSE pt + rt END, 6) + 0.0 AS value FROM tm JOIN tt USING (batch_id)""",
          ("fx_rollouts",))
def m3(spark, sf):
    ro = fixture(spark, sf, "fx_rollouts")
    tt = ro.groupBy("batch_id").agg(F.sum("prompt_len").alias("prompt_tokens"), F.sum("response_len").alias("response_tokens"))
    out = M.timing_metrics(_timings(spark, sf), tt)
    return out.select("batch_id", "metric", r6(F.col("value")).alias("value"))


@register("M4_reward_metrics", """
SELECT batch_id, round(avg(score), 6) AS reward_mean, round(avg(CASE WHEN score = 0 THEN 1.0 ELSE 0.0 END), 6) AS recall_fail_ratio
FROM fx_rollouts GROUP BY batch_id""", ("fx_rollouts",))
def m4(spark, sf):
    return M.reward_metrics(fixture(spark, sf, "fx_rollouts"), by=["batch_id"])


@register("M5_accuracy_by_source", """
SELECT data_source, count(*) AS n, round(avg(CASE WHEN score = 3 THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM fx_rollouts GROUP BY data_source""", ("fx_rollouts",))
def m5(spark, sf):
    return M.accuracy_by_source(fixture(spark, sf, "fx_rollouts"))


@register("M7_reduce_metrics", """
SELECT run, step, metric, round(avg(value), 6) AS value FROM fx_metrics GROUP BY ALL""", ("fx_metrics",))
def m7(spark, sf):
    m = fixture(spark, sf, "fx_metrics")
    return M.reduce_metrics(m).withColumn("value", F.round("value", 6))


# Model dimension table used by the FLOPs estimate (one row per model).
MODEL_DIMS = [("qwen2-0.5b", 896, 151936, 24, 2, 14, 4864), ("llama-7b", 4096, 32000, 32, 32, 32, 11008)]


@register("M8_flops", """
WITH m AS (SELECT * FROM (VALUES ('qwen2-0.5b', 896.0, 151936.0, 24.0, 2.0, 14.0, 4864.0),
                                 ('llama-7b', 4096.0, 32000.0, 32.0, 32.0, 32.0, 11008.0))
           t(model, hs, vs, nl, kvh, nh, inter)),
s AS (SELECT batch_id, CASE WHEN row_id % 2 = 0 THEN 'qwen2-0.5b' ELSE 'llama-7b' END AS model,
             sum(seqlen)::DOUBLE AS tok, sum(seqlen::DOUBLE * seqlen) AS sq FROM fx_lengths GROUP BY ALL),
d AS (SELECT *, floor(hs / nh) AS hd FROM m),
f AS (SELECT batch_id, model,
       (6 * ((hs * inter * 3 + hs * (nh * hd + kvh * hd + kvh * hd + nh * hd)) * nl + vs * hs * 2) * tok
              + 12 * sq * hd * nh * nl) / 2.0 / 1e12 AS t,
       CASE WHEN model = 'llama-7b' THEN 989.0 ELSE 312.0 END AS peak FROM s JOIN d USING (model))
SELECT batch_id, model, round(t, 6) AS tflops_achieved, round(t * 1 / peak / 8, 6) AS mfu FROM f""", ("fx_lengths",))
def m8(spark, sf):
    lens = fixture(spark, sf, "fx_lengths").select(
        "batch_id", "seqlen", F.when(F.col("row_id") % 2 == 0, "qwen2-0.5b").otherwise("llama-7b").alias("model"),
        F.lit(2.0).alias("delta_time"))
    models = spark.createDataFrame(MODEL_DIMS, "model string, hidden_size int, vocab_size int, num_hidden_layers int, "
                                               "num_key_value_heads int, num_attention_heads int, intermediate_size int")
    out = M.estimate_flops(lens, models)
    dev = F.when(F.col("model") == "llama-7b", "NVIDIA H100 80GB HBM3").otherwise("NVIDIA A100-SXM4-80GB")
    out = M.mfu(out.withColumn("device", dev), "device", world_size=8, epochs=1)
    return out.select("batch_id", "model", F.round("tflops_achieved", 6).alias("tflops_achieved"),
                      F.round("mfu", 6).alias("mfu"))


@register("M9_valid_tokens", """
SELECT batch_id, CAST(sum(mask) AS BIGINT) AS valid_tokens, count(DISTINCT rollout_id) AS n_rows FROM fx_tokens GROUP BY batch_id""",
          ("fx_tokens",))
def m9(spark, sf):
    return M.valid_tokens(fixture(spark, sf, "fx_tokens"))


@register("M10_best_metric", """
SELECT run, max(v) AS best, max(v) > 200.0 AS passed
FROM (SELECT run, step, avg(value) AS v FROM fx_metrics WHERE metric = 'view' GROUP BY run, step) x GROUP BY run""",
          ("fx_metrics",))
def m10(spark, sf):
    m = fixture(spark, sf, "fx_metrics").groupBy("run", "step", "metric").agg(F.avg("value").alias("value"))
    return M.best_metric(m, "view", 200.0)


@register("M11_flatten_config", """
SELECT event_id, k AS path, json_extract_string(props, '$."' || k || '"') AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) x""")
def m11(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "props")
    return M.flatten_json(ev, "event_id", "props").select("event_id", "path", "value")


@register("M12_validation_loss", f"""
WITH b AS (SELECT vec_id % 4 AS batch_id,
       sum(-(CAST(embedding[label + 1] AS DOUBLE) - (list_max(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))
            + ln(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - list_max(list_transform(embedding, lambda y: CAST(y AS DOUBLE)))))))))
            * CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END) / sum(CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END) AS l
       FROM embeddings GROUP BY ALL)
SELECT round(avg(l), 6) AS val_loss, count(*) AS n_batches FROM b""")
def m12(spark, sf):
    x = read_table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 4).alias("batch_id"), F.when(F.col("vec_id") % 5 != 0, 1).otherwise(0).alias("loss_mask"),
        R.logprob_of_label("embedding", "label").alias("logprob"))
    per = R.sft_loss(x)
    return per.agg(F.round(F.avg("sft_loss"), 6).alias("val_loss"), F.count(F.lit(1)).alias("n_batches"))


# ---------------------------------------------------------------- step plan

STEP_SQL = """
WITH tok AS (SELECT batch_id, rollout_id, rollout_id % 37 AS uid, t, mask, n, reward AS score, v,
                    reward - 0.1 * (old_lp - ref_lp) * mask AS rw, (old_lp - ref_lp) * mask AS kld FROM fx_tokens),
sc AS (SELECT batch_id, rollout_id, uid, sum(rw) AS s FROM tok GROUP BY ALL),
g AS (SELECT batch_id, uid, count(*) AS gn, avg(s) AS gm, stddev_samp(s) AS gsd FROM sc GROUP BY ALL),
a AS (SELECT sc.batch_id, sc.rollout_id, (s - CASE WHEN gn = 1 THEN 0 ELSE gm END) / (CASE WHEN gn = 1 THEN 1 ELSE gsd END + 1e-6) AS adv
      FROM sc JOIN g USING (batch_id, uid)),
ta AS (SELECT tok.*, a.adv * tok.mask AS advantage, a.adv * tok.mask AS returns FROM tok JOIN a USING (batch_id, rollout_id)),
rw AS (SELECT batch_id, rollout_id, sum(mask) AS rl, max(n) AS nn, 20 + rollout_id % 7 AS pl, sum(score) AS s, sum(rw) AS r
       FROM ta GROUP BY batch_id, rollout_id),
wd AS (SELECT batch_id, max(nn) AS mrl FROM rw GROUP BY batch_id),
ra AS (SELECT batch_id, avg(s) AS "critic/score/mean", max(s) AS "critic/score/max", min(s) AS "critic/score/min",
             avg(r) AS "critic/rewards/mean", max(r) AS "critic/rewards/max", min(r) AS "critic/rewards/min",
             avg(rl) AS "response_length/mean", max(rl) AS "response_length/max", min(rl) AS "response_length/min",
             avg(CASE WHEN rl = mrl THEN 1.0 ELSE 0.0 END) AS "response_length/clip_ratio",
             avg(pl) AS "prompt_length/mean", max(pl) AS "prompt_length/max", min(pl) AS "prompt_length/min",
             avg(CASE WHEN pl = 26 THEN 1.0 ELSE 0.0 END) AS "prompt_length/clip_ratio"
      FROM rw JOIN wd USING (batch_id) GROUP BY batch_id),
tb AS (SELECT batch_id, avg(advantage) AS "critic/advantages/mean", max(advantage) AS "critic/advantages/max",
             min(advantage) AS "critic/advantages/min", avg(returns) AS "critic/returns/mean", max(returns) AS "critic/returns/max",
             min(returns) AS "critic/returns/min", avg(v) AS "critic/values/mean", max(v) AS "critic/values/max",
             min(v) AS "critic/values/min", 1.0 - var_samp(returns - v) / (var_samp(returns) + 1e-5) AS "critic/vf_explained_var"
      FROM ta WHERE mask <> 0 GROUP BY batch_id),
w AS (SELECT * FROM ra JOIN tb USING (batch_id)),
u AS (UNPIVOT (SELECT batch_id, COLUMNS(* EXCLUDE (batch_id))::DOUBLE FROM w) ON COLUMNS(* EXCLUDE (batch_id)) INTO NAME metric VALUE value),
k AS (SELECT batch_id, avg(row_kl) AS kl FROM (SELECT batch_id, rollout_id, sum(kld * mask) / sum(mask) AS row_kl FROM tok GROUP BY ALL) x
      GROUP BY batch_id)
SELECT batch_id, metric, round(value, 6) + 0.0 AS value FROM u
UNION ALL SELECT batch_id, 'critic/kl', round(kl, 6) + 0.0 FROM k
UNION ALL SELECT batch_id, 'critic/kl_coeff', 0.1 FROM k"""


@register("A18_training_step", STEP_SQL, ("fx_tokens",))
def a18_step(spark, sf):
    from kestrel.plans.step import training_step
    tok = fixture(spark, sf, "fx_tokens").select(
        "batch_id", "rollout_id", (F.col("rollout_id") % 37).alias("uid"), "t", "mask", "n",
        F.col("reward").alias("score"), "old_lp", "ref_lp", "v")
    rows = tok.groupBy("batch_id", "rollout_id").agg(F.sum("mask").alias("response_length"), F.max("n").alias("_n"))
    widths = rows.groupBy("batch_id").agg(F.max("_n").alias("max_response_length"))
    rows = rows.join(widths, "batch_id").select(
        "batch_id", "rollout_id", "response_length", "max_response_length",
        (20 + F.col("rollout_id") % 7).alias("prompt_length"), F.lit(26).alias("max_prompt_length"))
    _, metrics = training_step(tok, rows, kl_coef=0.1, estimator="grpo")
    return metrics.select("batch_id", "metric", r6(F.col("value")).alias("value"))
