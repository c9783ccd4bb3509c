"""Sources and sinks (S*).

Every write goes below a shared folder: ``spark.checkpoint.dir`` of the
session (set by the cluster), never a machine-local path; tests without a
cluster setting get a scratch folder from ``kestrel.session``.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/kestrel-io/{name}-{uuid.uuid4().hex[:12]}"


def read_parquet_many(spark: SparkSession, paths) -> DataFrame:
    """Read one or many parquet paths and concatenate; columns missing
    in some inputs become null."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines with an explicit schema (no inference pass)."""
    return spark.read.schema(schema).json(path)


def read_split(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    """S3: one split/task of an exported dataset; the predicate reaches the
    parquet scan (partition pruning / PushedFilters)."""
    return spark.read.parquet(path).filter(F.col(column) == value)


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> str:
    """One parquet folder per split."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)
    return path


def save_batch(df: DataFrame, path: str) -> str:
    """Lossless save of a batch table (parquet, no pickle)."""
    df.write.mode("overwrite").parquet(path)
    return path


def load_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dump(df: DataFrame, base: str, name: str, enabled: bool = True) -> None:
    """Append intermediate results under ``name`` (off unless enabled)."""
    if enabled:
        df.withColumn("name", F.lit(name)).write.mode("append").partitionBy("name").parquet(base)


def log_metrics(metrics: DataFrame, path: str) -> None:
    """Append a long ``(run, step, metric, value)`` table."""
    metrics.select("run", "step", "metric", F.col("value").cast("double").alias("value")) \
        .write.mode("append").parquet(path)


@F.pandas_udf(T.StringType())
def fmt3(v: pd.Series) -> pd.Series:
    """Python ``f"{v:.3f}"`` (exact binary value, round half even)."""
    return v.map(lambda x: f"{x:.3f}", na_action="ignore")


def format_steps(metrics: DataFrame, run="run", step="step", metric="metric", value="value") -> DataFrame:
    """One line per (run, step): ``step:N - key:value - ...`` with values
    printed to 3 decimals; keys in name order.  A step's metrics are few."""
    pieces = metrics.select(run, step, F.struct(F.col(metric).alias("k"),
                                                F.concat(F.col(metric), F.lit(":"), fmt3(F.col(value).cast("double")))
                                                .alias("kv")).alias("_p"))
    g = pieces.groupBy(run, step).agg(F.sort_array(F.collect_list("_p")).alias("_l"))
    line = F.concat(F.lit("step:"), F.col(step).cast("string"), F.lit(" - "),
                    F.array_join(F.transform("_l", lambda p: p["kv"]), " - "))
    return g.select(run, step, line.alias("line"))


def metric_from_line(line, key: str):
    """Value of ``key`` in a ``k:v - k:v`` line, scanning pieces in order.

    The first piece that does not split into exactly ``k`` and ``v`` makes
    the whole line -inf, unless the key was found before it; a value that
    is not a number is -inf too."""
    pieces = F.split(F.col(line) if isinstance(line, str) else line, " - ")
    kv = F.transform(pieces, lambda p: F.split(p, ":"))
    pos_bad = F.array_position(F.transform(kv, lambda x: F.size(x) != 2), True)
    pos_hit = F.array_position(F.transform(kv, lambda x: (F.size(x) == 2) & (x[0] == key)), True)
    num = F.element_at(F.element_at(kv, F.greatest(pos_hit, F.lit(1)).cast("int")), 2).try_cast("double")
    return (F.when(pos_hit == 0, F.lit(float("-inf")))
            .when((pos_bad != 0) & (pos_bad < pos_hit), F.lit(float("-inf")))
            .when(num.isNull(), F.lit(float("-inf")))
            .otherwise(num))


def best_from_logs(lines: DataFrame, key: str, threshold: float, run="run", line="line") -> DataFrame:
    """S9 + M10: lines starting with ``step``; best value per run; passes
    when above the threshold."""
    x = lines.filter(F.col(line).startswith("step")).select(run, metric_from_line(line, key).alias("v"))
    return x.groupBy(run).agg(F.max("v").alias("best")).withColumn("passed", F.col("best") > threshold)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """S9 source: plain text logs, one line per row."""
    return spark.read.text(path).withColumnRenamed("value", "line")
