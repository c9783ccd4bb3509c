"""Run metrics and evaluation (M*).

All metrics are aggregates over a batch / run key: partial aggregation runs
map-side, so only one small row per key and partition is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.distance import text_distance
from kestrel.functions.text import col


def pass_at_k(scored: DataFrame, prompt_key="uid", score="score", threshold: float = 3.0,
              by=()) -> DataFrame:
    """M6: a prompt passes when its best response reaches ``threshold``.

    Two-level aggregate: best per prompt (partial agg map-side), then the
    share of passing prompts (optionally per ``by`` keys such as data_source).
    """
    by = list(by)
    best = scored.groupBy(*by, prompt_key).agg(F.max(score).alias("best"))
    # a prompt passes when its best score equals the threshold (3 for puzzles)
    hit = F.when(F.col("best") == F.lit(threshold), 1).otherwise(0)
    return best.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_prompts"),
        F.sum(hit).cast("bigint").alias("n_pass"),
        F.round(F.avg(hit.cast("double")), 6).alias("pass_rate"))


def accuracy_by_source(scored: DataFrame, data_source="data_source", score="score",
                       target: float = 3.0) -> DataFrame:
    """M5: share of rows whose reward equals ``target`` per data source."""
    hit = F.when(F.col(score) == F.lit(target), 1.0).otherwise(0.0)
    return scored.groupBy(data_source).agg(F.count(F.lit(1)).alias("n"),
                                           F.round(F.avg(hit), 6).alias("accuracy"))


def first_n_per_group(df: DataFrame, group, order, n: int) -> DataFrame:
    """First ``n`` rows per group (top-k per key; Catalyst adds a
    WindowGroupLimit so only ``n`` rows per key and partition are shuffled)."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def generations_similar(pairs: DataFrame, a="a", b="b", max_ratio: float = 0.1) -> DataFrame:
    """Sum of edit distances over sum of max lengths, below ``max_ratio``.
    Texts are whole: long pairs are compared by bit-parallel columns."""
    d = text_distance(a, b)
    m = F.greatest(F.length(col(a)), F.length(col(b)))
    agg = pairs.agg(F.sum(d).cast("bigint").alias("total_distance"),
                    F.sum(m).cast("bigint").alias("total_length"))
    ratio = F.try_divide(F.col("total_distance").cast("double"), F.col("total_length").cast("double"))
    return agg.select("total_distance", "total_length", F.round(ratio, 6).alias("ratio"),
                      (F.coalesce(ratio, F.lit(0.0)) <= max_ratio).alias("similar"))


def reward_metrics(scored: DataFrame, score="score", by=()) -> DataFrame:
    """M4: mean reward and the share of rows scoring exactly 0."""
    return scored.groupBy(*by).agg(
        F.round(F.avg(score), 6).alias("reward_mean"),
        F.round(F.avg(F.when(F.col(score) == 0, 1.0).otherwise(0.0)), 6).alias("recall_fail_ratio"))


def reduce_metrics(rows: DataFrame, by=("run", "step"), metric="metric", value="value") -> DataFrame:
    """M7: mean of each metric's values over the micro-batches of a step; nulls
    are left out, and a metric with nulls alone has a null mean."""
    return rows.groupBy(*by, metric).agg(F.avg(value).alias(value))


def valid_tokens(tokens: DataFrame, by="batch_id", row_key="rollout_id", mask="mask") -> DataFrame:
    """M9: tokens that the mask keeps, and rows, per batch.  Tokens are summed
    per row first, so the count of rows needs no distinct set."""
    rows = tokens.groupBy(by, row_key).agg(F.sum(mask).cast("bigint").alias("row_tokens"))
    return rows.groupBy(by).agg(F.sum("row_tokens").alias("valid_tokens"), F.count(row_key).alias("n_rows"))


def round6(c) -> Column:
    return F.round(col(c), 6)


def _unpivot(df: DataFrame, ids, names) -> DataFrame:
    return df.select(*ids, *[F.col(f"`{n}`").cast("double").alias(n) for n in names]) \
             .unpivot(ids, names, "metric", "value")


def data_metrics(tokens: DataFrame, rows: DataFrame, batch="batch_id", row_key="rollout_id",
                 mask="mask", score="score_tok", reward="reward_tok", advantage="advantage",
                 returns="returns", values="values", use_critic: bool = True) -> DataFrame:
    """M2: per-batch training metrics as a long ``(batch, metric, value)`` table.

    ``tokens``: one row per response token; ``rows``: one row per rollout with
    ``prompt_length``, ``response_length``, ``max_prompt_length``,
    ``max_response_length`` (the padded widths).  Sequence sums are a
    row-level aggregate, token statistics a batch-level one over valid
    tokens; both are partial aggregates joined on the batch key.
    """
    seq = tokens.groupBy(batch, row_key).agg(F.sum(score).alias("_s"), F.sum(reward).alias("_r"))
    seq = seq.join(rows, [batch, row_key])
    rl = F.col("response_length")
    pl = F.col("prompt_length")
    r_agg = seq.groupBy(batch).agg(
        F.avg("_s").alias("critic/score/mean"), F.max("_s").alias("critic/score/max"), F.min("_s").alias("critic/score/min"),
        F.avg("_r").alias("critic/rewards/mean"), F.max("_r").alias("critic/rewards/max"), F.min("_r").alias("critic/rewards/min"),
        F.avg(rl).alias("response_length/mean"), F.max(rl).alias("response_length/max"), F.min(rl).alias("response_length/min"),
        F.avg(F.when(rl == F.col("max_response_length"), 1.0).otherwise(0.0)).alias("response_length/clip_ratio"),
        F.avg(pl).alias("prompt_length/mean"), F.max(pl).alias("prompt_length/max"), F.min(pl).alias("prompt_length/min"),
        F.avg(F.when(pl == F.col("max_prompt_length"), 1.0).otherwise(0.0)).alias("prompt_length/clip_ratio"))
    v = tokens.filter(col(mask) != 0)
    t_exprs = [F.avg(advantage).alias("critic/advantages/mean"), F.max(advantage).alias("critic/advantages/max"),
               F.min(advantage).alias("critic/advantages/min"), F.avg(returns).alias("critic/returns/mean"),
               F.max(returns).alias("critic/returns/max"), F.min(returns).alias("critic/returns/min")]
    if use_critic:
        t_exprs += [F.avg(values).alias("critic/values/mean"), F.max(values).alias("critic/values/max"),
                    F.min(values).alias("critic/values/min"),
                    (1.0 - F.var_samp(col(returns) - col(values)) / (F.var_samp(returns) + 1e-5))
                    .alias("critic/vf_explained_var")]
    t_agg = v.groupBy(batch).agg(*t_exprs)
    wide = r_agg.join(t_agg, batch)
    names = [c for c in wide.columns if c != batch]
    return _unpivot(wide, [batch], names)


def response_info(rows: DataFrame, mask="attention_mask", prompt_width="prompt_width") -> DataFrame:
    """M1: prompt and response lengths of each row from its attention mask."""
    from kestrel.operators.tokens import prompt_response_lengths
    lens = prompt_response_lengths(mask, F.col(prompt_width) if isinstance(prompt_width, str) else prompt_width)
    return rows.withColumns(lens)


def timing_metrics(timings: DataFrame, token_totals: DataFrame, batch="batch_id") -> DataFrame:
    """M3: ``timing_s/<name>`` and ``timing_per_token_ms/<name>``.

    ``timings``: (batch, name, seconds); ``token_totals``: (batch,
    prompt_tokens, response_tokens).  Generation is normalised by response
    tokens, the other known sections by all tokens; unknown names get only
    the seconds metric.
    """
    per_tok_sections = ["gen", "ref", "values", "adv", "update_critic", "update_actor"]
    j = timings.join(token_totals, batch)
    tokens = F.when(F.col("name") == "gen", F.col("response_tokens")) \
        .otherwise(F.col("prompt_tokens") + F.col("response_tokens"))
    secs = j.select(batch, F.concat(F.lit("timing_s/"), "name").alias("metric"), F.col("seconds").alias("value"))
    per = j.filter(F.col("name").isin(per_tok_sections)).select(
        batch, F.concat(F.lit("timing_per_token_ms/"), "name").alias("metric"),
        (F.col("seconds") * 1000 / tokens).alias("value"))
    return secs.unionByName(per)


# Peak dense throughput per device family (FLOP/s), matched by
# substring in this order; unknown devices count as infinite.
DEVICE_PEAK_FLOPS = [("H100", 989e12), ("H800", 989e12), ("A100", 312e12), ("A800", 312e12),
                     ("L40", 181.05e12), ("L20", 119.5e12), ("H20", 148e12), ("910B", 354e12)]


def device_peak_flops(device_name) -> Column:
    d = col(device_name)
    out = None
    for name, flops in DEVICE_PEAK_FLOPS:
        out = (F.when(d.contains(name), F.lit(flops)) if out is None else out.when(d.contains(name), F.lit(flops)))
    return out.otherwise(F.lit(float("inf")))


def estimate_flops(seqlens: DataFrame, models: DataFrame, batch="batch_id", seqlen="seqlen",
                   delta_time="delta_time") -> DataFrame:
    """M8: achieved TFLOP/s per batch for decoder models.

    ``6 * N_dense * tokens + 12 * sum(len^2) * head_dim * heads * layers``
    divided by the step time.  ``models`` holds one row per model config
    (hidden_size, vocab_size, num_hidden_layers, num_key_value_heads,
    num_attention_heads, intermediate_size) keyed by ``model``; ``seqlens``
    carries the model key, so the join is on a tiny dimension table.
    """
    per = seqlens.groupBy(batch, "model").agg(F.sum(seqlen).cast("double").alias("tokens_sum"),
                                              F.sum(col(seqlen).cast("double") * col(seqlen)).alias("sq_sum"),
                                              F.max(delta_time).alias("delta_time"))
    m = models.select("model", *[F.col(c).cast("double").alias(c) for c in (
        "hidden_size", "vocab_size", "num_hidden_layers", "num_key_value_heads", "num_attention_heads",
        "intermediate_size")])
    head_dim = F.floor(F.col("hidden_size") / F.col("num_attention_heads"))
    q = F.col("num_attention_heads") * head_dim
    kv = F.col("num_key_value_heads") * head_dim
    mlp = F.col("hidden_size") * F.col("intermediate_size") * 3
    attn_lin = F.col("hidden_size") * (q + kv + kv + F.col("num_attention_heads") * head_dim)
    emb = F.col("vocab_size") * F.col("hidden_size") * 2
    dense = (mlp + attn_lin) * F.col("num_hidden_layers") + emb
    j = per.join(F.broadcast(m), "model")
    flops = 6 * dense.cast("double") * F.col("tokens_sum") + \
        12 * F.col("sq_sum") * head_dim * F.col("num_attention_heads") * F.col("num_hidden_layers")
    return j.select(batch, "model", (flops / F.col("delta_time") / 1e12).alias("tflops_achieved"))


def mfu(flops: DataFrame, device="device", world_size: int = 1, epochs: int = 1,
        achieved="tflops_achieved") -> DataFrame:
    """M8: model FLOPs utilisation = achieved TFLOP/s * epochs / device peak
    (TFLOP/s) / world size; unknown devices have an infinite peak (MFU 0)."""
    peak_t = device_peak_flops(device) / F.lit(1e12)
    return flops.withColumn("mfu", F.col(achieved) * epochs / peak_t / F.lit(world_size))


LEVELS = 8  # levels of a JSON document flattened between two looks at the data


def flatten_json(df: DataFrame, key, json_col, sep: str = "/") -> DataFrame:
    """Flatten a nested JSON document to ``a/b/c`` leaf keys.

    The document is parsed once into a VARIANT, so JSON types survive: only
    real objects and arrays are expanded (a string that merely looks like
    JSON stays a leaf).  Lists contribute ``list_len`` plus index keys.
    Each level is one ``explode`` over a linear chain (finished leaves are
    carried along).  After every LEVELS levels one look at the data says
    whether a container is left, so documents of any depth reach their
    leaves.  Malformed documents give one null leaf.
    """
    def node(path, v, done):
        return F.struct(path.alias("path"), v.alias("v"), F.lit(done).alias("done"))

    def child(parent, k):
        return F.when(parent == "", k).otherwise(F.concat(parent, F.lit(sep), k))

    def is_open():
        as_map, as_arr = F.try_variant_get("v", "$", "map<string,variant>"), F.try_variant_get("v", "$", "array<variant>")
        return ~F.col("done") & ((as_map.isNotNull() & (F.size(as_map) > 0)) | as_arr.isNotNull())

    cur = df.select(key, F.inline(F.array(node(F.lit(""), F.try_parse_json(col(json_col)), False))))
    while True:
        for _ in range(LEVELS):
            as_map = F.try_variant_get("v", "$", "map<string,variant>")
            as_arr = F.try_variant_get("v", "$", "array<variant>")
            path = F.col("path")
            kids_obj = F.transform(F.map_entries(as_map), lambda e: node(child(path, e["key"]), e["value"], False))
            kids_arr = F.concat(
                F.transform(as_arr, lambda x, i: node(child(path, i.cast("string")), x, False)),
                F.array(node(child(path, F.lit("list_len")), F.parse_json(F.size(as_arr).cast("string")), True)))
            keep = F.array(node(path, F.col("v"), True))
            nxt = (F.when(F.col("done"), keep)
                   .when(as_map.isNotNull() & (F.size(as_map) > 0), kids_obj)
                   .when(as_arr.isNotNull(), kids_arr)
                   .otherwise(keep))
            cur = cur.select(key, F.inline(nxt))
        if cur.filter(is_open()).isEmpty():
            break
    as_map = F.try_variant_get("v", "$", "map<string,variant>")
    return cur.select(key, "path", F.when(as_map.isNotNull(), F.to_json("v")).otherwise(F.col("v").cast("string")).alias("value"))


def best_metric(metrics: DataFrame, metric_name: str, threshold: float, run="run", step="step",
                metric="metric", value="value") -> DataFrame:
    """Best value of one metric over a run and whether it passes."""
    x = metrics.filter(col(metric) == metric_name).groupBy(run).agg(F.max(value).alias("best"))
    return x.withColumn("passed", F.col("best") > threshold)
