"""Registered RL analytics queries (A*) over fx_tokens / fx_rollouts / embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import rl as R
from kestrel.sources.tables import fixture, read_table, with_fixtures

Q: dict = {}


def register(name, sql=None, fixtures=()):
    def deco(fn):
        Q[name] = (fn, with_fixtures(sql, *fixtures) if (sql and fixtures) else sql)
        return fn
    return deco


def tok(spark, sf):
    return fixture(spark, sf, "fx_tokens")


def r6(c):
    # + 0.0 turns -0.0 into 0.0 so both engines print the same value
    return F.round(c, 6) + F.lit(0.0)


GAMMA, LAM = 0.99, 0.95


@register("A1_masked_sum", """
SELECT batch_id, round(sum(v * mask), 6) AS masked_sum FROM fx_tokens GROUP BY batch_id""", ("fx_tokens",))
def a1(spark, sf):
    return tok(spark, sf).groupBy("batch_id").agg(r6(R.masked_sum("v", "mask")).alias("masked_sum"))


@register("A2_masked_mean", """
SELECT rollout_id, round(sum(v * mask) / nullif(sum(mask), 0), 6) AS row_mean FROM fx_tokens GROUP BY rollout_id""",
          ("fx_tokens",))
def a2(spark, sf):
    return tok(spark, sf).groupBy("rollout_id").agg(r6(R.masked_mean("v", "mask")).alias("row_mean"))


@register("A3_masked_var", """
SELECT batch_id, round(var_samp(CASE WHEN mask <> 0 THEN v END), 6) AS masked_var FROM fx_tokens GROUP BY batch_id""",
          ("fx_tokens",))
def a3(spark, sf):
    return tok(spark, sf).groupBy("batch_id").agg(r6(R.masked_var("v", "mask")).alias("masked_var"))


@register("A4_masked_whiten", """
SELECT t.rollout_id, t.t, round((t.v - s.m) / sqrt(s.var + 1e-8), 6) AS whitened
FROM fx_tokens t JOIN (SELECT batch_id, sum(v * mask) / sum(mask) AS m, var_samp(CASE WHEN mask <> 0 THEN v END) AS var
                       FROM fx_tokens GROUP BY batch_id) s USING (batch_id)""", ("fx_tokens",))
def a4(spark, sf):
    w = R.masked_whiten(tok(spark, sf), "v", "mask", "batch_id", out="whitened")
    return w.select("rollout_id", "t", r6(F.col("whitened")).alias("whitened"))


@register("A5_clip_by_value", """
SELECT rollout_id, t, greatest(least(lp, old_lp + 0.0625), old_lp - 0.0625) AS clipped FROM fx_tokens""", ("fx_tokens",))
def a5(spark, sf):
    x = tok(spark, sf)
    return x.select("rollout_id", "t", R.clip_by_value("lp", F.col("old_lp") - 0.0625,
                                                        F.col("old_lp") + 0.0625).alias("clipped"))


@register("A10_kl_penalty", """
SELECT rollout_id, t, round(lp - ref_lp, 6) AS kl, round(abs(lp - ref_lp), 6) AS kl_abs,
       round(0.5 * (lp - ref_lp) * (lp - ref_lp), 6) AS kl_mse,
       round(greatest(least(exp(ref_lp - lp) - (ref_lp - lp) - 1, 10.0), -10.0), 6) AS kl_low_var
FROM fx_tokens""", ("fx_tokens",))
def a10(spark, sf):
    x = tok(spark, sf)
    return x.select("rollout_id", "t", *[r6(R.kl_penalty("lp", "ref_lp", k)).alias(n) for k, n in
                                        [("kl", "kl"), ("abs", "kl_abs"), ("mse", "kl_mse"), ("low_var_kl", "kl_low_var")]])


@register("A11_kl_shaped_rewards", """
WITH k AS (SELECT *, (old_lp - ref_lp) * mask AS kld FROM fx_tokens),
r AS (SELECT batch_id, rollout_id, sum(kld * mask) / nullif(sum(mask), 0) AS row_kl, sum(reward - 0.1 * kld) AS reward_sum
      FROM k GROUP BY batch_id, rollout_id)
SELECT batch_id, round(avg(row_kl), 6) AS current_kl, CAST(0.1 AS DOUBLE) AS kl_coeff, round(sum(reward_sum), 6) AS reward_sum
FROM r GROUP BY batch_id""", ("fx_tokens",))
def a11(spark, sf):
    toks, per_batch = R.apply_kl_penalty(tok(spark, sf), 0.1, score="reward")
    sums = toks.groupBy("batch_id").agg(r6(F.sum("reward")).alias("reward_sum"))
    return per_batch.join(sums, "batch_id").select("batch_id", r6(F.col("current_kl")).alias("current_kl"),
                                                   "kl_coeff", "reward_sum")


@register("A12_unmasked_kl_rewards", """
SELECT rollout_id, t, reward - (old_lp - ref_lp) * 0.5 AS shaped FROM fx_tokens""", ("fx_tokens",))
def a12(spark, sf):
    return tok(spark, sf).select("rollout_id", "t", R.kl_rewards_unmasked("reward", "old_lp", "ref_lp", 0.5).alias("shaped"))


def _kl_steps(spark, sf):
    m = fixture(spark, sf, "fx_metrics")
    return m.groupBy("run", "step").agg((F.avg("value") / 1000.0).alias("current_kl"),
                                        F.count(F.lit(1)).alias("n_rows"))


@register("A13_adaptive_kl", """
WITH s AS (SELECT run, step, avg(value) / 1000.0 AS current_kl, count(*) AS n_rows FROM fx_metrics GROUP BY run, step),
f AS (SELECT *, 1 + greatest(least(current_kl / 0.05 - 1, 0.2), -0.2) * n_rows / 100.0 AS fac FROM s)
SELECT run, step, round(0.2 * coalesce(exp(sum(ln(fac)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0), 6) AS kl_coef
FROM f""", ("fx_metrics",))
def a13(spark, sf):
    k = R.kl_coefficients(_kl_steps(spark, sf), init=0.2, target=0.05, horizon=100.0)
    return k.select("run", "step", r6(F.col("kl_coef")).alias("kl_coef"))


GAE_SQL = f"""
WITH d AS (SELECT batch_id, rollout_id, t, mask, v,
                  reward + {GAMMA} * coalesce(lead(v) OVER (PARTITION BY rollout_id ORDER BY t), 0) - v AS delta FROM fx_tokens),
a AS (SELECT x.batch_id, x.rollout_id, x.t, x.mask, x.v, sum(pow({GAMMA * LAM}, y.t - x.t) * y.delta) AS adv
      FROM d x JOIN d y ON x.rollout_id = y.rollout_id AND y.t >= x.t GROUP BY ALL),
s AS (SELECT batch_id, sum(adv * mask) / sum(mask) AS m, var_samp(CASE WHEN mask <> 0 THEN adv END) AS var FROM a GROUP BY batch_id)
SELECT rollout_id, t, round((adv - m) / sqrt(var + 1e-8), 6) AS advantage, round(adv + v, 6) AS returns FROM a JOIN s USING (batch_id)"""


@register("A15_gae", GAE_SQL, ("fx_tokens",))
def a15(spark, sf):
    out = R.gae_advantage(tok(spark, sf), GAMMA, LAM)
    return out.select("rollout_id", "t", r6(F.col("advantage")).alias("advantage"), r6(F.col("returns")).alias("returns"))


@register("A16_grpo_advantage", """
WITH s AS (SELECT uid, count(*) AS n, avg(score) AS m, stddev_samp(score) AS sd FROM fx_rollouts GROUP BY uid)
SELECT rollout_id, round((score - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE sd END + 1e-6), 6) AS advantage
FROM fx_rollouts JOIN s USING (uid)""", ("fx_rollouts",))
def a16(spark, sf):
    out = R.grpo_advantage(fixture(spark, sf, "fx_rollouts"), "score", ["batch_id", "uid"])
    return out.select("rollout_id", r6(F.col("advantage")).alias("advantage"))


RPP_SQL = f"""
WITH b AS (SELECT *, sum(CASE WHEN mask = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY rollout_id ORDER BY t DESC
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg FROM fx_tokens),
c AS (SELECT x.batch_id, x.rollout_id, x.t, x.mask, sum(pow({GAMMA}, y.t - x.t) * y.reward) AS ret
      FROM b x JOIN b y ON x.rollout_id = y.rollout_id AND y.t >= x.t AND coalesce(y.seg, 0) = coalesce(x.seg, 0) GROUP BY ALL),
s AS (SELECT batch_id, sum(ret * mask) / sum(mask) AS m, var_samp(CASE WHEN mask <> 0 THEN ret END) AS var FROM c GROUP BY batch_id)
SELECT rollout_id, t, round((ret - m) / sqrt(var + 1e-8) * mask, 6) + 0.0 AS advantage, round(ret, 6) + 0.0 AS returns FROM c JOIN s USING (batch_id)"""


@register("A17_reinforce_pp", RPP_SQL, ("fx_tokens",))
def a17(spark, sf):
    out = R.reinforce_pp_advantage(tok(spark, sf), GAMMA)
    return out.select("rollout_id", "t", r6(F.col("advantage")).alias("advantage"), r6(F.col("returns")).alias("returns"))


@register("A18_compute_advantage_grpo", """
WITH sc AS (SELECT batch_id, rollout_id, rollout_id % 37 AS uid, sum(reward) AS score FROM fx_tokens GROUP BY ALL),
s AS (SELECT batch_id, uid, count(*) AS n, avg(score) AS m, stddev_samp(score) AS sd FROM sc GROUP BY ALL),
a AS (SELECT rollout_id, (score - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE sd END + 1e-6) AS adv
      FROM sc JOIN s USING (batch_id, uid))
SELECT t.rollout_id, t.t, round(a.adv * t.mask, 6) + 0.0 AS advantage FROM fx_tokens t JOIN a USING (rollout_id)""", ("fx_tokens",))
def a18(spark, sf):
    x = tok(spark, sf).withColumn("uid", F.col("rollout_id") % 37)
    out = R.compute_advantage(x, "grpo")
    return out.select("rollout_id", "t", r6(F.col("advantage")).alias("advantage"))


@register("A19_policy_loss", """
WITH x AS (SELECT batch_id, mask, -(v - 4.0) * exp(lp - old_lp) AS l1,
                  -(v - 4.0) * greatest(least(exp(lp - old_lp), 1.2), 0.8) AS l2, old_lp - lp AS kl FROM fx_tokens)
SELECT batch_id, round(sum(greatest(l1, l2) * mask) / sum(mask), 6) AS pg_loss,
       round(sum(CASE WHEN l2 > l1 THEN 1.0 ELSE 0.0 END * mask) / sum(mask), 6) AS pg_clipfrac,
       round(sum(kl * mask) / sum(mask), 6) AS ppo_kl FROM x GROUP BY batch_id""", ("fx_tokens",))
def a19(spark, sf):
    x = tok(spark, sf).withColumn("advantage", F.col("v") - 4.0)
    out = R.policy_loss(x, clip=0.2)
    return out.select("batch_id", *[r6(F.col(c)).alias(c) for c in ("pg_loss", "pg_clipfrac", "ppo_kl")])


@register("A20_value_loss", """
WITH x AS (SELECT batch_id, coalesce(lag(mask) OVER (PARTITION BY rollout_id ORDER BY t), 1) AS mask, v + (t % 3) / 16.0 AS vpred, v, reward AS ret FROM fx_tokens),
y AS (SELECT *, greatest(least(vpred, v + 0.0625), v - 0.0625) AS vc FROM x),
z AS (SELECT batch_id, mask, (vpred - ret) * (vpred - ret) AS l1, (vc - ret) * (vc - ret) AS l2 FROM y)
SELECT batch_id, round(0.5 * sum(greatest(l1, l2) * mask) / sum(mask), 6) AS vf_loss,
       round(sum(CASE WHEN l2 > l1 THEN 1.0 ELSE 0.0 END * mask) / sum(mask), 6) AS vf_clipfrac FROM z GROUP BY batch_id""",
          ("fx_tokens",))
def a20(spark, sf):
    x = tok(spark, sf).withColumn("vpred", F.col("v") + (F.col("t") % 3) / 16.0)
    out = R.value_loss(R.shifted_mask(x), "vpred", "reward", "v", "mask_at", clip=0.0625)
    return out.select("batch_id", r6(F.col("vf_loss")).alias("vf_loss"), r6(F.col("vf_clipfrac")).alias("vf_clipfrac"))


@register("A21_actor_loss", """
WITH x AS (SELECT batch_id, mask, -(v - 4.0) * exp(lp - old_lp) AS l1,
                  -(v - 4.0) * greatest(least(exp(lp - old_lp), 1.2), 0.8) AS l2, -lp AS ent,
                  greatest(least(exp(ref_lp - lp) - (ref_lp - lp) - 1, 10.0), -10.0) AS kld FROM fx_tokens),
y AS (SELECT batch_id, sum(greatest(l1, l2) * mask) / sum(mask) AS pg, sum(ent * mask) / sum(mask) AS el,
             sum(kld * mask) / sum(mask) AS kl FROM x GROUP BY batch_id)
SELECT batch_id, round(pg, 6) AS pg_loss, round(el, 6) AS entropy_loss, round(kl, 6) AS kl_loss,
       round(pg - el * 0.001 - kl * 0.001, 6) AS policy_loss FROM y""", ("fx_tokens",))
def a21(spark, sf):
    x = tok(spark, sf).withColumn("advantage", F.col("v") - 4.0).withColumn("entropy", -F.col("lp"))
    out = R.actor_loss(x)
    return out.select("batch_id", *[r6(F.col(c)).alias(c) for c in ("pg_loss", "entropy_loss", "kl_loss", "policy_loss")])


@register("A24_shifted_values", """
SELECT rollout_id, t, coalesce(lag(v) OVER (PARTITION BY rollout_id ORDER BY t), 0.0)
       * coalesce(lag(mask) OVER (PARTITION BY rollout_id ORDER BY t), 1) AS value_at FROM fx_tokens""",
          ("fx_tokens",))
def a24(spark, sf):
    return R.shifted_values(tok(spark, sf)).select("rollout_id", "t", "value_at")


# ----------------------------------------------------- logits (embeddings table)

def lse_sql(c="embedding"):
    return (f"(list_max(list_transform({c}, lambda x: CAST(x AS DOUBLE))) + ln(list_sum(list_transform({c}, "
            f"lambda x: exp(CAST(x AS DOUBLE) - list_max(list_transform({c}, lambda y: CAST(y AS DOUBLE))))))))")


LSE = lse_sql()


def emb(spark, sf):
    return read_table(spark, sf, "embeddings")


@register("A6_logprob_of_label", f"""
SELECT vec_id, round(CAST(embedding[label + 1] AS DOUBLE) - {LSE}, 6) AS logprob FROM embeddings""")
def a6(spark, sf):
    return emb(spark, sf).select("vec_id", r6(R.logprob_of_label("embedding", "label")).alias("logprob"))


@register("A7_entropy", f"""
WITH e AS (SELECT vec_id, {LSE} AS lse, embedding FROM embeddings),
h AS (SELECT vec_id, lse - list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - lse) * CAST(x AS DOUBLE))) AS ent FROM e)
SELECT vec_id % 4 AS batch_id, round(sum(ent * CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END) / sum(CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END), 6) AS entropy_loss,
       round(max(ent), 6) AS max_entropy FROM h GROUP BY ALL""")
def a7(spark, sf):
    x = emb(spark, sf).select((F.col("vec_id") % 4).alias("batch_id"),
                              F.when(F.col("vec_id") % 5 != 0, 1).otherwise(0).alias("mask"),
                              R.entropy_from_logits("embedding").alias("ent"))
    return x.groupBy("batch_id").agg(r6(R.masked_mean("ent", "mask")).alias("entropy_loss"),
                                     r6(F.max("ent")).alias("max_entropy"))


@register("A8_response_logprobs", f"""
WITH s AS (SELECT vec_id // 50 AS seq, vec_id % 50 AS pos, label, embedding FROM embeddings),
p AS (SELECT seq, pos, label, lag(embedding) OVER (PARTITION BY seq ORDER BY pos) AS prev,
             count(*) OVER (PARTITION BY seq) AS n FROM s)
SELECT seq, pos, round(CAST(prev[label + 1] AS DOUBLE) - {lse_sql('prev')}, 6) AS logprob
FROM p WHERE pos >= n - 20 AND pos >= 1""")
def a8(spark, sf):
    x = emb(spark, sf).select((F.col("vec_id") / 50).cast("bigint").alias("seq"),
                              (F.col("vec_id") % 50).alias("pos"), "label", "embedding")
    return R.response_logprobs(x, 20).select("seq", "pos", r6(F.col("logprob")).alias("logprob"))


@register("A9_topk_next_token", f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
k AS (SELECT vec_id, x, list_reverse_sort(x)[5] AS thr, list_max(x) AS mx FROM e)
SELECT vec_id, CAST(list_position(x, mx) - 1 AS INT) AS greedy_token,
       round(1.0 / list_sum(list_transform(list_filter(x, lambda v: v >= thr), lambda v: exp((v - mx) / 0.7))), 6) AS p_greedy,
       CAST(len(list_filter(x, lambda v: v >= thr)) AS INT) AS n_kept
FROM k""")
def a9(spark, sf):
    x = emb(spark, sf)
    nt = R.next_token("embedding", R.hash_uniform(7, "vec_id"), 0.7, 5)
    return x.select("vec_id", nt["greedy_token"].alias("greedy_token"), r6(nt["p_greedy"]).alias("p_greedy"),
                    nt["n_kept"].alias("n_kept"))


@register("A22_sft_loss", f"""
SELECT vec_id % 4 AS batch_id,
       round(sum(-(CAST(embedding[label + 1] AS DOUBLE) - {LSE}) * CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END)
             / sum(CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END), 6) AS sft_loss FROM embeddings GROUP BY ALL""")
def a22(spark, sf):
    x = emb(spark, sf).select((F.col("vec_id") % 4).alias("batch_id"),
                              F.when(F.col("vec_id") % 5 != 0, 1).otherwise(0).alias("loss_mask"),
                              R.logprob_of_label("embedding", "label").alias("logprob"))
    return R.sft_loss(x).select("batch_id", r6(F.col("sft_loss")).alias("sft_loss"))


@register("A23_preference_pairs", """
SELECT uid, arg_max(rollout_id, (score, -rollout_id)) AS chosen_id, arg_min(rollout_id, (score, rollout_id)) AS rejected_id,
       max(score) AS chosen_score, min(score) AS rejected_score
FROM fx_rollouts GROUP BY uid HAVING max(score) > min(score)""", ("fx_rollouts",))
def a23(spark, sf):
    return R.preference_pairs(fixture(spark, sf, "fx_rollouts"))
