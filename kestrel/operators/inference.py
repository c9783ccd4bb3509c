"""User functions and model calls as Spark jobs (U*).

* U1: a registry of reward functions, each ``DataFrame -> score column``,
  dispatched per data source in one pass (see ``scoring.dispatch_scores``).
* U2: a registry of row mappers (prompt builders) by dataset name.
* U3: ship a pandas function to every partition (``mapInPandas``).
* U4: batch generation: repeat prompts n times, call a pluggable generator
  per Arrow batch, gather the samples back per prompt in order.
* U5: model scoring of (prompt, response) with ``predict_batch_udf``.

Model serving itself is out of scope; generators and scorers are
pluggable callables (deterministic stubs in tests).
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.operators import batch as B


# ------------------------------------------------------------------- U1, U2

REWARD_FUNCTIONS: dict[str, Callable] = {}
ROW_MAPPERS: dict[str, Callable] = {}


def register_reward(name: str):
    def deco(fn):
        REWARD_FUNCTIONS[name] = fn
        return fn
    return deco


def register_mapper(name: str):
    def deco(fn):
        ROW_MAPPERS[name] = fn
        return fn
    return deco


def map_rows(df: DataFrame, dataset: str, **kw) -> DataFrame:
    """Apply the row mapper registered for ``dataset``."""
    if dataset not in ROW_MAPPERS:
        raise KeyError(f"no row mapper for {dataset!r}")
    return ROW_MAPPERS[dataset](df, **kw)


def _register_defaults():
    from kestrel.operators import prep as P
    from kestrel.operators import scoring as S
    register_mapper("gsm8k")(P.gsm8k_prompts)
    register_mapper("math")(P.math_prompts)
    register_mapper("kk")(P.kk_prompts)
    register_mapper("countdown")(P.countdown_prompts)
    register_reward("gsm8k")(lambda r, gt: S.gsm8k_score(r, gt))
    register_reward("multiply")(lambda r, gt: S.multiply_score(r, gt))
    register_reward("math")(lambda r, gt: S.math_score(r, gt))

    def countdown(r, gt):
        truth = F.from_json(gt, "target bigint, numbers array<bigint>")
        return S.countdown_score(r, truth["target"], truth["numbers"])

    register_reward("countdown")(countdown)


_register_defaults()


# ---------------------------------------------------------------------- U3

def execute_on_chunks(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """Run ``fn`` on every Arrow batch of every partition and
    concatenate the outputs (the partitions are the chunks)."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


# ---------------------------------------------------------------------- U4

def generate(prompts: DataFrame, generator: Callable[[pd.Series, pd.Series], pd.Series], n_samples: int,
             prompt_key="row_idx", prompt="prompt", pad_token: str | None = None) -> DataFrame:
    """U4: ``n_samples`` responses per prompt gathered as an ordered array.

    B7 repeats each prompt (interleaved), ``generator(prompts, sample_idx)``
    runs once per Arrow batch in ``mapInPandas``, the pad token is stripped
    and samples are collected back per prompt in sample order (a group is
    bounded by ``n_samples``).
    """
    rep = B.repeat(prompts.select(prompt_key, prompt), n_samples, interleave=True, row_key=prompt_key)
    rep = rep.withColumn("sample", (F.col(prompt_key) % n_samples).cast("int")) \
             .withColumn("_src", (F.col(prompt_key) / n_samples).cast("bigint"))
    schema = T.StructType([T.StructField("_src", T.LongType()), T.StructField("sample", T.IntegerType()),
                           T.StructField("response", T.StringType())])

    def run(it):
        for pdf in it:
            out = generator(pdf[prompt], pdf["sample"])
            if pad_token is not None:
                out = out.str.replace(pad_token, "", regex=False)
            yield pd.DataFrame({"_src": pdf["_src"], "sample": pdf["sample"], "response": out})
    gen = rep.select("_src", "sample", prompt).mapInPandas(run, schema)
    g = gen.groupBy("_src").agg(F.sort_array(F.collect_list(F.struct("sample", "response"))).alias("_l"))
    out = g.select(F.col("_src").alias(prompt_key), F.transform("_l", lambda s: s["response"]).alias("responses"))
    return prompts.join(out, prompt_key)


def echo_generator(prompts: pd.Series, sample: pd.Series) -> pd.Series:
    """Deterministic stand-in for a model: the reversed prompt and the sample index."""
    return pd.Series([p[::-1] + f" #{s}" for p, s in zip(prompts, sample)])


# ---------------------------------------------------------------------- U5

def length_scorer(width: int):
    """Stand-in reward model for ``predict_batch_udf``: mean token id over
    the padded width (any callable batch -> scores fits here)."""
    def make_predict_fn():
        def predict(ids: np.ndarray) -> np.ndarray:
            return ids.astype(np.float64).sum(axis=1) / float(width)
        return predict
    return make_predict_fn


def model_scores(df: DataFrame, ids_col: str, width: int, make_predict_fn, batch_size: int = 256) -> Column:
    """Model score per row through ``predict_batch_udf`` (Arrow batches,
    model loaded once per Python worker)."""
    from pyspark.ml.functions import predict_batch_udf
    udf = predict_batch_udf(make_predict_fn, return_type=T.DoubleType(), batch_size=batch_size,
                            input_tensor_shapes=[[width]])
    return udf(F.col(ids_col))
