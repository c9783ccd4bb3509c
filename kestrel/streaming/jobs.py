"""Incremental jobs (ST*) with Structured Streaming.

ST1: rollout files arrive in a folder; the rows of a training batch are held
in a table beside the checkpoint until all are there, however many files and
micro-batches they span, then scored with the batch functions and written once
(``foreachBatch``, exactly-once through the checkpoint).  State has the counts
and timers of batches, not their rows, so a batch may be of any size.

ST2: the adaptive KL coefficient as running state per run: steps may arrive
out of order; they wait in state until contiguous, then apply in order.

Both use ``applyInPandasWithState`` with a timer on the files' times of arrival
(a watermark over ``_metadata.file_modification_time``), so a missing row or
step holds nothing for ever, a drained folder ends the job, and a replay gives
the same result.  A timer fires once later files have been read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType, LongType, StringType, StructField, StructType

from kestrel.operators import metrics as M
from kestrel.operators import rl as R

ARRIVED = "_arrived"
LATENESS = "10 minutes"  # by which a file's time may lie before that of a file read earlier


def arriving(spark: SparkSession, source_dir: str, schema, max_files: int) -> DataFrame:
    """A folder's rows with their file's time as event time.  Timers therefore
    fire LATENESS later than set; a file older than that is not read."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)
    return src.withColumn(ARRIVED, F.col("_metadata.file_modification_time")).withWatermark(ARRIVED, LATENESS)


def _set_timer(state: GroupState, at: int) -> None:
    state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))


def _last(frames: list[pd.DataFrame]) -> int:
    """The last arrival, in milliseconds."""
    return max((int(f[ARRIVED].max().timestamp() * 1000) for f in frames if len(f)), default=0)


HOLD_STATE = "rows string, closed boolean, deadline long"


def hold_batch_fn(names: list[str], expected: str, wait_ms: int):
    """State function per batch small enough for one state row: its rows until ``expected`` of them are there.

    Rows leave together with ``status`` ``complete``, or ``partial`` when
    ``wait_ms`` have passed since the first; rows that come after that leave
    at once as ``late``.  A closed batch keeps a flag alone.  Repeated rows
    count each; a null or non-positive ``expected`` closes the batch with the
    micro-batch that brings it.  Columns hold numbers, strings or booleans."""
    at = names.index(expected)

    def frame(rows, status):
        return pd.DataFrame(rows, columns=names).assign(status=status)

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        kept, closed, deadline = state.get if state.exists else ("[]", False, 0)
        if state.hasTimedOut:
            if not closed:
                state.update(("[]", True, 0))
                yield frame(json.loads(kept), "partial")
            return
        frames = list(pdfs)
        new = [[None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in r] for f in frames for r in f[names].itertuples(index=False)]
        if closed:
            yield frame(new, "late")
            return
        rows = json.loads(kept) + new
        if len(rows) >= max((r[at] or 0 for r in rows), default=0):
            state.update(("[]", True, 0))
            yield frame(rows, "complete")
            return
        deadline = deadline or _last(frames) + wait_ms
        state.update((json.dumps(rows), False, deadline))
        _set_timer(state, deadline)
    return fn


COUNT_STATE = "n long, most long, closed boolean, deadline long"


def count_batch_fn(names: list[str], whole: set[str], key_name: str, expected: str, wait_ms: int):
    """ST1 state function per batch, by the rules of ``hold_batch_fn``, but with
    counts for state.  Rows go through with ``status`` ``held`` (``late`` after
    the batch has closed), chunk by chunk; the micro-batch that closes a batch
    gets one more row, with the key and ``complete`` or ``partial`` alone.
    ``whole``: columns of whole numbers, which may have nulls."""
    def typed(f):
        return f.astype({c: "Int64" for c in names if c in whole})

    def mark(key, status):
        return typed(pd.DataFrame({c: pd.Series([key[0] if c == key_name else None], dtype="Int64" if c in whole else object) for c in names})).assign(status=status)

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        n, most, closed, deadline = state.get if state.exists else (0, 0, False, 0)
        if state.hasTimedOut:
            if not closed:
                state.update((n, most, True, 0))
                yield mark(key, "partial")
            return
        last = 0
        for f in pdfs:
            top = f[expected].max()
            n, most, last = n + len(f), most if pd.isna(top) else max(most, int(top)), max(last, _last([f]))
            yield typed(f[names]).assign(status="late" if closed else "held")
        if closed:
            return
        if n >= most:
            state.update((n, most, True, 0))
            yield mark(key, "complete")
            return
        deadline = deadline or last + wait_ms
        state.update((n, most, False, deadline))
        _set_timer(state, deadline)
    return fn


def counted_batches(stream: DataFrame, key: str = "batch_id", expected: str = "n_expected", wait_ms: int = 600_000) -> DataFrame:
    """The rows of ``stream`` with ``status``, as they come, and a row for each batch that closes."""
    fields = [StructField(f.name, f.dataType) for f in stream.schema.fields if f.name != ARRIVED]
    whole = {f.name for f in fields if isinstance(f.dataType, IntegralType)}
    return stream.groupBy(key).applyInPandasWithState(
        count_batch_fn([f.name for f in fields], whole, key, expected, wait_ms), StructType([*fields, StructField("status", StringType())]),
        COUNT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


class HeldRows:
    """Rows of open batches as a table of folders, one per micro-batch and
    status; a micro-batch that runs again replaces its own."""

    def __init__(self, path: str, key: str):
        self.path, self.key = path, key

    def add(self, got: DataFrame, epoch_id: int) -> None:
        got.write.mode("overwrite").partitionBy("status").parquet(f"{self.path}/epoch={epoch_id}")
        schema = StructType([*got.schema.fields, StructField("epoch", LongType())])
        self.rows = got.sparkSession.read.schema(schema).parquet(self.path).filter(F.col("epoch") <= epoch_id)

    def closed(self) -> DataFrame:
        """(key, epoch, status) of the batches closed so far."""
        return self.rows.filter(F.col("status").isin("complete", "partial")).select(F.col(self.key).alias("_key"), F.col("epoch").alias("_epoch"), F.col("status").alias("_status"))

    def closing(self, epoch_id: int) -> DataFrame:
        """All rows, with ``status``, of the batches that this micro-batch closes."""
        now = F.broadcast(self.closed().filter(F.col("_epoch") == epoch_id))
        held = self.rows.filter(F.col("status") == "held").drop("status", "epoch")
        return held.join(now, F.col(self.key).eqNullSafe(F.col("_key"))).withColumnRenamed("_status", "status").drop("_key", "_epoch")

    def late(self, epoch_id: int) -> DataFrame:
        return self.rows.filter((F.col("status") == "late") & (F.col("epoch") == epoch_id)).drop("epoch")

    def drop_done(self, epoch_id: int) -> None:
        """Delete the rows of earlier micro-batches without an open batch; what
        earlier ones closed is committed by now, what this one closes is not."""
        done = F.broadcast(self.closed().filter(F.col("_epoch") < epoch_id))
        held = self.rows.filter((F.col("status") == "held") & (F.col("epoch") < epoch_id)).select(self.key, "epoch").distinct()
        there = {r.epoch for r in held.select("epoch").distinct().collect()}
        needed = {r.epoch for r in held.join(done, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti").select("epoch").distinct().collect()}
        spark = self.rows.sparkSession
        for epoch in there - needed:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/epoch={epoch}/status=held")
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def whole_batches(stream: DataFrame, key: str = "batch_id", expected: str = "n_expected", wait_ms: int = 600_000) -> DataFrame:
    """The rows of ``stream`` with ``status``, batch by batch as each closes,
    for batches that fit one state row; ``counted_batches`` has no such bound."""
    schema = StructType([f for f in stream.schema.fields if f.name != ARRIVED])
    return stream.groupBy(key).applyInPandasWithState(
        hold_batch_fn(schema.fieldNames(), expected, wait_ms), StructType([*schema.fields, StructField("status", StringType())]),
        HOLD_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_step_metrics(spark: SparkSession, source_dir: str, schema, sink_dir: str, checkpoint_dir: str,
                        max_files_per_trigger: int = 1, test_freq: int = 0, validation_dir: str | None = None,
                        target_score: float = 3.0, expected: str = "n_expected", wait_ms: int = 600_000,
                        late_dir: str | None = None) -> None:
    """ST1: file source -> whole batches -> reward metrics and GRPO advantage
    statistics, one row per batch -> parquet table.  ``expected`` is the column
    with a batch's row count.  Every ``test_freq``-th micro-batch also writes
    validation accuracy per data source (M5) to ``validation_dir``; late rows
    go to ``late_dir``.  Runs until the folder is drained (``availableNow``);
    what is not complete stays in state for the next run."""
    src = arriving(spark, source_dir, schema, max_files_per_trigger)
    held = HeldRows(f"{checkpoint_dir.rstrip('/')}/held", "batch_id")

    def per_batch(got: DataFrame, epoch_id: int) -> None:
        held.add(got, epoch_id)
        df = held.closing(epoch_id)
        rm = M.reward_metrics(df, "score", by=["batch_id"])
        adv = R.grpo_advantage(df, "score", ["batch_id", "uid"]).groupBy("batch_id").agg(
            F.avg("advantage").alias("adv_mean"), F.count(F.lit(1)).alias("n_rows"))
        status = df.groupBy("batch_id").agg(F.first("status").alias("status"))
        # one folder per epoch, overwritten on a retry: a re-run micro-batch
        # replaces its own output instead of appending duplicates
        rm.join(adv, "batch_id").join(status, "batch_id").write.mode("overwrite").parquet(f"{sink_dir}/epoch={epoch_id}")
        if test_freq and validation_dir and epoch_id % test_freq == 0:
            M.accuracy_by_source(df, "data_source", "score", target_score) \
                .write.mode("overwrite").parquet(f"{validation_dir}/epoch={epoch_id}")
        if late_dir:
            held.late(epoch_id).write.mode("overwrite").parquet(f"{late_dir}/epoch={epoch_id}")
        held.drop_done(epoch_id)

    q = (counted_batches(src, "batch_id", expected, wait_ms).writeStream.outputMode("append").foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()


KL_STATE = "next_step int, coef double, pending string, deadline long"
KL_OUT = "run int, step int, kl_coef double, status string"


def kl_state_fn(init: float, target: float, horizon: float, wait_ms: int = 600_000, max_pending: int | None = None):
    """ST2 state function: per run, apply steps strictly in order.

    Steps wait in state, however many, until those before them are there.  A
    gap is released ``wait_ms`` after it opened (with ``max_pending``, also as
    soon as more steps than that wait): the missing steps count as not having
    changed the coefficient, a row with status ``gap`` names the first of them,
    and the run goes on.  Steps that come after that, or twice, and rows with a
    null change nothing."""
    def advance(run, nxt, coef, pending, out):
        while nxt in pending:
            kl, n = pending.pop(nxt)
            out.append((run, nxt, coef, "step"))
            coef *= 1.0 + min(max(kl / target - 1.0, -0.2), 0.2) * n / horizon
            nxt += 1
        return nxt, coef

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        run, out = int(key[0]), []
        nxt, coef, kept, deadline = state.get if state.exists else (0, init, "[]", 0)
        pending = {s: (kl, n) for s, kl, n in json.loads(kept)}
        start, frames = nxt, [] if state.hasTimedOut else list(pdfs)
        skip = lambda: out.append((run, nxt, coef, "gap"))
        if state.hasTimedOut:
            if pending:
                skip()
                nxt, coef = advance(run, min(pending), coef, pending, out)
        else:
            for f in frames:
                for step, kl, n in f[["step", "current_kl", "n_rows"]].dropna().itertuples(index=False):
                    if step >= nxt:
                        pending.setdefault(int(step), (float(kl), int(n)))
                    nxt, coef = advance(run, nxt, coef, pending, out)
                    while max_pending is not None and len(pending) > max_pending:
                        skip()
                        nxt, coef = advance(run, min(pending), coef, pending, out)
        if not pending:
            deadline = 0
        elif not deadline or nxt != start:  # every gap has its own, since it opened
            deadline = (_last(frames) or state.getCurrentWatermarkMs()) + wait_ms
        state.update((nxt, coef, json.dumps([(s, *v) for s, v in sorted(pending.items())]), deadline))
        if pending:
            _set_timer(state, deadline)
        if out:
            yield pd.DataFrame(out, columns=["run", "step", "kl_coef", "status"])
    return fn


def stream_kl_coefficients(spark: SparkSession, source_dir: str, schema, sink_dir: str, checkpoint_dir: str,
                           init: float, target: float, horizon: float, wait_ms: int = 600_000, max_pending: int | None = None) -> None:
    """ST2: running adaptive KL coefficient per run from a stream of
    (run, step, current_kl, n_rows) rows; output = coefficient used at each
    step, identical to the batch result of A13 where no step is missing, with
    status ``step``, and a row with status ``gap`` per released gap."""
    src = arriving(spark, source_dir, schema, 1)
    out = src.groupBy("run").applyInPandasWithState(
        kl_state_fn(init, target, horizon, wait_ms, max_pending), KL_OUT, KL_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    q = (out.writeStream.outputMode("append").format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
