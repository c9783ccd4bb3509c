"""Spark session helpers.

Library code never creates its own session: every operator takes the
caller's DataFrames.  ``get_spark`` is for tests, ``bench.py`` and scripts.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale.  AQE re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed ones; the broadcast
# threshold stays at a fixed, small bound so nothing that grows with the
# data is ever broadcast implicitly.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "kestrel", extra: dict | None = None) -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; without one a cluster job is refused, since a folder of one machine
    would lose tables.  Only in local mode a scratch folder is made.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = sc.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="kestrel-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


#: Shuffle files of a query go as soon as its result is written.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df, name: str = "table", compression: str = "snappy"):
    """Cut the lineage by writing a parquet table under the shared
    ``spark.checkpoint.dir`` and reading it back.

    Reliable like ``checkpoint()`` (survives executor loss, never a local
    checkpoint), but columnar: later reads prune columns and push filters.
    The write's shuffle files are removed with its end, not when the driver
    happens to collect its garbage."""
    import uuid
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kestrel-tables/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.parquet(path)
    out._kestrel_path = path
    return out


def drop_tables(*tables) -> None:
    """Delete tables that ``cut_lineage`` wrote and that nothing lazy reads any
    more; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "_kestrel_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
