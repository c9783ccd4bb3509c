"""One training step's data work as a single Spark plan (no driver loop).

token rows (scores already placed at the last valid token)
  -> KL-shaped rewards and the batch KL (A10/A11)
  -> advantages and returns (A18: grpo / gae / reinforce_plus_plus)
  -> batch metrics (M2) plus the KL metrics, as one long metrics table.

Statistics are per ``batch_id`` throughout, so many batches (and runs) are
processed together; the only row-level shuffles are the per-rollout
aggregates and the per-batch statistics joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import metrics as M
from kestrel.operators import rl as R


def training_step(tokens: DataFrame, rows: DataFrame, kl_coef: float = 0.001, kl_kind: str = "kl",
                  estimator: str = "grpo", gamma: float = 1.0, lam: float = 1.0, batch="batch_id",
                  row_key="rollout_id", uid="uid") -> tuple[DataFrame, DataFrame]:
    """Returns (token table with reward/advantage/returns, long metrics table).

    ``tokens``: batch, rollout, uid, t, mask, score (token-level scores),
    old_lp, ref_lp, v.  ``rows``: one row per rollout with prompt/response
    lengths and padded widths (see ``metrics.data_metrics``).
    """
    shaped, kl = R.apply_kl_penalty(tokens, kl_coef, score="score", kind=kl_kind, row_key=row_key, batch_key=batch)
    adv = R.compute_advantage(shaped.drop("kld", "kl_coeff"), estimator, gamma, lam, reward="reward", value="v",
                              mask="mask", row_key=(batch, row_key), uid=uid, batch_key=batch)
    # what an estimator's result does not carry comes back from the shaped tokens
    absent = [c for c in ("mask", "score", "reward", "v") if c not in adv.columns]
    toks = adv.join(shaped.select(batch, row_key, "t", *absent), [batch, row_key, "t"]) if absent else adv
    m = M.data_metrics(toks.withColumn("values", F.col("v")), rows, batch, row_key, "mask",
                       score="score", reward="reward", advantage="advantage", returns="returns", values="values")
    klm = kl.select(batch, F.lit("critic/kl").alias("metric"), F.col("current_kl").cast("double").alias("value")) \
        .unionByName(kl.select(batch, F.lit("critic/kl_coeff").alias("metric"), F.col("kl_coeff").cast("double").alias("value")))
    return toks, m.unionByName(klm)
