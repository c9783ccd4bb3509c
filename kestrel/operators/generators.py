"""Synthetic task generators (G*).

Randomness comes from ``xxhash64(seed, row id, draw)``, so every row is
reproducible under any partitioning (unlike ``rand()``, whose stream depends
on the partition layout).  Rows are produced by ``spark.range`` and spread
over all executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.text import col


def uniform_int(seed: int, key, draw: int, lo, hi) -> Column:
    """Deterministic integer in [lo, hi] from a hash of (seed, key, draw)."""
    span = (F.lit(hi) - F.lit(lo) + 1).cast("bigint")
    return (F.lit(lo) + F.pmod(F.xxhash64(F.lit(seed), col(key), F.lit(draw)), span)).cast("bigint")


def countdown_rows(df: DataFrame, key, num_operands: int = 6, max_target: int = 1000, min_number: int = 1,
                   max_number: int = 100, seed: int = 42) -> DataFrame:
    """G1 on existing key rows: target in [1, max_target], ``num_operands``
    numbers in [min_number, max_number]."""
    nums = F.array(*[uniform_int(seed, key, i + 1, min_number, max_number) for i in range(num_operands)])
    return df.select(col(key).alias("row_id"), uniform_int(seed, key, 0, 1, max_target).alias("target"),
                     nums.alias("nums"))


def countdown_tasks(spark: SparkSession, num_samples: int, num_operands: int = 6,
                    max_target: int = 1000, min_number: int = 1, max_number: int = 100,
                    seed: int = 42) -> DataFrame:
    """G1: ``num_samples`` generated tasks (``spark.range`` rows)."""
    return countdown_rows(spark.range(num_samples), "id", num_operands, max_target, min_number, max_number, seed)


def arith_number(seed: int, key, draw: int, digit: int, less_or_equal: bool = True) -> Column:
    """One operand: r in {1,2,3}; r == 1 draws below 10^(DIGIT-1), otherwise
    below 10^DIGIT.  The lower bound is 0 with ``less_or_equal`` (default),
    else a tenth of the upper bound (no leading-zero shortening)."""
    r = uniform_int(seed, key, draw, 1, 3)
    hi = F.when(r == 1, F.lit(10 ** (digit - 1))).otherwise(F.lit(10 ** digit)).cast("bigint")
    lo = F.lit(0).cast("bigint") if less_or_equal else (hi / 10).cast("bigint")
    return (lo + F.pmod(F.xxhash64(F.lit(seed), col(key), F.lit(draw + 100)), hi - lo)).cast("bigint")


def pair_rows(df: DataFrame, key, digit: int = 3, ops=("*",), seed: int = 42, less_or_equal: bool = True) -> DataFrame:
    """G2/G3 on existing key rows: (num1, num2, op), larger number first for '-'."""
    op = F.element_at(F.array(*[F.lit(o) for o in ops]), uniform_int(seed, key, 9, 1, len(ops)).cast("int"))
    x = df.select(col(key).alias("_k"), arith_number(seed, key, 1, digit, less_or_equal).alias("_a"),
                  arith_number(seed, key, 2, digit, less_or_equal).alias("_b"), op.alias("op"))
    return x.select(F.col("_k").alias("row_id"),
                    F.when(F.col("op") == "-", F.greatest("_a", "_b")).otherwise(F.col("_a")).alias("num1"),
                    F.when(F.col("op") == "-", F.least("_a", "_b")).otherwise(F.col("_b")).alias("num2"), "op")


def arithmetic_pairs(spark: SparkSession, n: int, digit: int = 3, ops=("*",), seed: int = 42,
                     less_or_equal: bool = True) -> DataFrame:
    """``n`` generated pairs (``spark.range`` rows)."""
    return pair_rows(spark.range(n), "id", digit, ops, seed, less_or_equal)


def digit_completion_prompts(spark: SparkSession, max_number: int, max_diff: int,
                             max_num_in_response: int) -> DataFrame:
    """Every prompt ``"a,b:max,n"`` with b = (a + diff) % max."""
    a = F.explode(F.sequence(F.lit(0), F.lit(max_number))).alias("first")
    df = spark.range(1).select(a)
    df = df.select("first", F.explode(F.sequence(F.lit(0), F.lit(max_diff))).alias("diff"))
    df = df.select("first", "diff", F.explode(F.sequence(F.lit(0), F.lit(max_num_in_response))).alias("n"))
    second = F.pmod(F.col("first") + F.col("diff"), F.lit(max_number))
    return df.select(F.concat_ws(",", F.col("first").cast("string"), second.cast("string")).alias("nums"),
                     "n").select(F.concat(F.col("nums"), F.lit(f":{max_number},"), F.col("n").cast("string")).alias("prompt"))


def digit_completion_answer(prompt) -> Column:
    """Next ``n`` terms of the modular sequence, comma-joined."""
    p = col(prompt)
    number = lambda text, at: F.split_part(text, F.lit(","), F.lit(at)).cast("bigint")
    nums, info = F.split_part(p, F.lit(":"), F.lit(1)), F.split_part(p, F.lit(":"), F.lit(2))
    parsed = F.struct(number(nums, 1).alias("a"), number(nums, 2).alias("b"), number(info, 1).alias("m"), number(info, 2).alias("n"))
    # the prompt is parsed once; a reference inside the lambda would parse it for every term
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    terms = once(parsed, lambda q: F.when(q["n"] <= 0, F.lit("")).otherwise(once(F.pmod(q["b"] - q["a"], q["m"]), lambda diff: F.array_join(
        F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(q["n"], F.lit(1).cast("bigint"))),
                    lambda k: F.pmod(q["b"] + k * diff, q["m"]).cast("string")), ","))))
    return F.when(p.isNotNull(), terms)


def digit_completion_space(params: DataFrame, max_number="max_number", max_diff="max_diff",
                           max_n="max_num_in_response") -> DataFrame:
    """G4 per parameter row: every prompt of the space (first x diff x n),
    generated with ``explode(sequence)`` on the executors."""
    # few parameter rows make many prompts: they are dealt out before
    x = params.repartition(int(params.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = x.withColumn("first", F.explode(F.sequence(F.lit(0), col(max_number).cast("int"))))
    x = x.withColumn("diff", F.explode(F.sequence(F.lit(0), col(max_diff).cast("int"))))
    x = x.withColumn("n", F.explode(F.sequence(F.lit(0), col(max_n).cast("int"))))
    second = F.pmod(F.col("first") + F.col("diff"), col(max_number))
    return x.withColumn("prompt", F.concat(F.col("first").cast("string"), F.lit(","), second.cast("string"), F.lit(":"),
                                           col(max_number).cast("string"), F.lit(","), F.col("n").cast("string")))


def digit_completion_sample(keys: DataFrame, key, max_number: int, max_diff: int, max_n: int,
                            seed: int = 0) -> DataFrame:
    """One prompt per key row, drawn from G4's space with hash uniforms."""
    first = uniform_int(seed, key, 1, 0, max_number)
    diff = uniform_int(seed, key, 2, 0, max_diff)
    n = uniform_int(seed, key, 3, 0, max_n)
    second = F.pmod(first + diff, F.lit(max_number))
    return keys.withColumn("prompt", F.concat(first.cast("string"), F.lit(","), second.cast("string"),
                                              F.lit(f":{max_number},"), n.cast("string")))


def random_attention_mask(ids, key, max_ratio_valid: float, max_ratio_left_pad: float,
                          min_ratio_valid: float = 0.0, seed: int = 0) -> Column:
    """Per row a random left pad in [0, max_left] and a valid length in
    [min_valid, max_valid] (ratios of the row length), hash-derived."""
    if not (0 < max_ratio_valid <= 1 and 0 <= max_ratio_left_pad < 1 and min_ratio_valid <= max_ratio_valid):
        raise ValueError("invalid ratios")
    L = F.size(col(ids))
    max_valid = F.floor(L * max_ratio_valid).cast("bigint")
    min_valid = F.greatest(F.lit(1), F.floor(L * min_ratio_valid)).cast("bigint")
    max_left = F.floor(L * max_ratio_left_pad).cast("bigint")
    h1 = F.pmod(F.xxhash64(F.lit(seed), col(key), F.lit(1)), max_left + 1)
    # short rows: the valid length is clamped so it never exceeds the row
    max_valid = F.greatest(max_valid, min_valid)
    h2 = min_valid + F.pmod(F.xxhash64(F.lit(seed), col(key), F.lit(2)), max_valid - min_valid + 1)
    return F.transform(col(ids), lambda x, i: F.when((i >= h1) & (i < h1 + h2), 1).otherwise(0))
