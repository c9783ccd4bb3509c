"""Batch operators (B*): the column/row manipulations of a training batch.

A DataFrame is unordered, so every batch table carries an explicit row
index.  Position-based operators never use an un-partitioned window (that
funnels all rows into one task): ``global_index`` numbers rows after a
distributed range sort, partition by partition, with a tiny per-partition
offset table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.text import col


def global_index(df: DataFrame, order, name: str = "row_idx") -> DataFrame:
    """0-based contiguous index in ``order`` (ties numbered in an arbitrary but fixed order).

    Range-sorted (distributed), then each row gets its partition's offset
    plus its position inside the partition.  Partition ids are
    non-deterministic expressions, so the numbered rows are materialised
    once as a parquet table under ``spark.checkpoint.dir`` (``cut_lineage``) before the
    per-partition counts are taken; the offset table has one row per
    partition and is broadcast.
    """
    from kestrel.session import cut_lineage
    order = [order] if isinstance(order, (str, Column)) else list(order)
    s = (df.orderBy(*order)
           .withColumn("__gi_pid", F.spark_partition_id())
           .withColumn("__gi_mid", F.monotonically_increasing_id()))
    s = cut_lineage(s)
    s = s.withColumn("__gi_pos", F.col("__gi_mid") - F.shiftleft(F.col("__gi_pid").cast("bigint"), 33))
    counts = s.groupBy("__gi_pid").agg(F.count(F.lit(1)).alias("__gi_cnt"))
    w = Window.orderBy("__gi_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("__gi_off", F.coalesce(F.sum("__gi_cnt").over(w), F.lit(0))).select("__gi_pid", "__gi_off")
    return (s.join(F.broadcast(offs), "__gi_pid")
             .withColumn(name, (F.col("__gi_off") + F.col("__gi_pos")).cast("bigint"))
             .drop("__gi_pid", "__gi_mid", "__gi_pos", "__gi_off"))


GROUPS_SENT = 100_000  # rows of a table with a row per group that are sent to every task


def join_groups(rows: DataFrame, groups: DataFrame, by) -> DataFrame:
    """Rows joined to a table with a row per group.  Few groups, of which one
    may be very large, are broadcast, so rows stay where they are."""
    from kestrel.session import cut_lineage
    groups = cut_lineage(groups, "groups")
    return rows.join(F.broadcast(groups) if groups.count() <= GROUPS_SENT else groups, list(by))


def index_within(df: DataFrame, by, order, name: str = "row_idx") -> DataFrame:
    """0-based index inside each ``by`` group (P17), skew-proof: a global
    index minus the group's first index (a one-row-per-group aggregate)."""
    by = [by] if isinstance(by, str) else list(by)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    g = global_index(df, [*by, *order], "_gi")
    first = g.groupBy(*by).agg(F.min("_gi").alias("_g0"))
    return join_groups(g, first, by).withColumn(name, F.col("_gi") - F.col("_g0")).drop("_gi", "_g0")


# ------------------------------------------------------------------ columns

def select_keys(df: DataFrame, keys, row_key="row_idx") -> DataFrame:
    """B1: keep some columns (the row key is always kept)."""
    return df.select(row_key, *[k for k in keys if k != row_key])


def pop(df: DataFrame, keys, row_key="row_idx"):
    """B2: returns (popped, rest); a missing key is an error."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyError(f"pop: missing keys {missing}")
    rest = [c for c in df.columns if c not in keys and c != row_key]
    return df.select(row_key, *keys), df.select(row_key, *rest)


def rename(df: DataFrame, old_keys, new_keys) -> DataFrame:
    """Rename columns; both lists must have equal length."""
    if isinstance(old_keys, str):
        old_keys, new_keys = [old_keys], [new_keys]
    if len(old_keys) != len(new_keys):
        raise ValueError("rename: old and new keys differ in length")
    return df.withColumnsRenamed(dict(zip(old_keys, new_keys)))


def union_columns(a: DataFrame, b: DataFrame, row_key="row_idx"):
    """Merge the columns of two aligned batches.

    Same-named columns must be equal (null-safe); returns (merged table,
    conflicts table with one row per differing (row, column)).
    """
    shared = [c for c in a.columns if c in b.columns and c != row_key]
    only_b = [c for c in b.columns if c not in a.columns]
    j = a.alias("a").join(b.alias("b"), row_key, "full_outer")
    merged = j.select(row_key, *[(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in shared else F.col(f"a.{c}")).alias(c)
                                 for c in a.columns if c != row_key],
                      *[F.col(f"b.{c}") for c in only_b])
    if shared:
        conflicts = j.select(row_key, F.explode(F.array(*[
            F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in shared])).alias("column")) \
            .filter(F.col("column").isNotNull())
    else:
        conflicts = j.select(row_key, F.lit(None).cast("string").alias("column")).filter(F.lit(False))
    return merged, conflicts


# --------------------------------------------------------------------- rows

def concat(parts, row_key="row_idx") -> DataFrame:
    """Stack batches in list order; the row index continues across parts
    (offsets from one count per part)."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    u = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)
    sizes = u.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_part", "_off")
    return (u.join(F.broadcast(offs), "_part")
             .withColumn(row_key, F.col(row_key) + F.col("_off")).drop("_off", "_part"))


def divided(total, k: int, what: str) -> Column:
    """``total / k``; an error where it is not whole."""
    n = col(total)
    return F.when(n % k != 0, F.raise_error(F.concat(F.lit(f"{what} not divisible by {k}: "), n.cast("string"))).cast("bigint")).otherwise(F.floor(n / k))


def chunk(df: DataFrame, k: int, n: int | None = None, row_key="row_idx", by=()) -> DataFrame:
    """Split into k equal contiguous chunks; not divisible -> error.

    With ``by`` (e.g. batch_id) chunks are formed inside every batch.
    """
    by = list(by)
    if by:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        x = df.join(sizes, by)
        size = divided("_n", k, "chunk: batch size")  # within the result, so the check always runs
        return x.withColumn("chunk_id", F.floor(F.col(row_key) / size).cast("int")).drop("_n")
    if n is None:
        n = df.count()
    if n % k != 0:
        raise ValueError(f"chunk: {n} rows not divisible by {k}")
    return df.withColumn("chunk_id", (F.col(row_key) / F.lit(n // k)).cast("int"))


def repeat(df: DataFrame, times: int, interleave: bool = True, n: int | Column | None = None,
           row_key="row_idx") -> DataFrame:
    """Each row ``times`` times; interleaved (aabb) or tiled (abab)."""
    x = df.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        idx = F.col(row_key) * times + F.col("_rep")
    else:
        n_c = n if isinstance(n, Column) else F.lit(n if n is not None else df.count())
        idx = F.col("_rep") * n_c + F.col(row_key)
    return x.withColumn(row_key, idx.cast("bigint")).drop("_rep")


def reorder(df: DataFrame, indices: DataFrame, row_key="row_idx", src="src_idx", by=()) -> DataFrame:
    """New position p takes old row ``indices[p]`` (index table
    ``(by..., row_idx, src_idx)``)."""
    by = list(by)
    idx = indices.select(*by, F.col(row_key).alias("_new"), F.col(src).alias(row_key))
    return df.join(idx, [*by, row_key]).drop(row_key).withColumnRenamed("_new", row_key)


def pad_to_divisor(df: DataFrame, divisor: int, row_key="row_idx", by=()):
    """Pad rows to a multiple of ``divisor`` by repeating the first rows
    (cycling when the pad is larger than the batch).  Returns the padded
    table with ``is_pad`` and the pad size per batch.  With ``by``, row keys
    may have gaps: pads follow the last one."""
    by = list(by)
    if by:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.max(row_key).alias("_top"))
        sizes = sizes.withColumn("pad_size", F.pmod(-F.col("_n"), F.lit(divisor)))
        rank = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last(row_key))).cast("bigint")
        x = df.join(sizes, by).withColumn("_at", F.when(F.col(row_key).isNotNull(), rank - 1))
    else:  # one batch: its size is a scalar
        n = df.count()
        sizes = df.sparkSession.createDataFrame([(n, (-n) % divisor)], "_n bigint, pad_size bigint")
        x = df.withColumn("_n", F.lit(n).cast("bigint")).withColumn("pad_size", F.lit((-n) % divisor).cast("bigint"))
        x = x.withColumn("_at", F.col(row_key)).withColumn("_top", F.lit(None).cast("bigint"))
    # each source row i is copied for k = i, i+n, i+2n, ... < pad_size
    copies = x.withColumn("_k", F.explode(F.sequence(F.col("_at"),
                                                    F.greatest(F.col("pad_size") - 1, F.col("_at")),
                                                    F.greatest(F.col("_n"), F.lit(1)))))
    copies = copies.filter(F.col("_k") < F.col("pad_size"))
    pads = copies.withColumn(row_key, F.greatest(F.col("_n"), F.col("_top") + 1) + F.col("_k")).withColumn("is_pad", F.lit(True)).drop("_k")
    base = x.withColumn("is_pad", F.lit(False))
    out = base.unionByName(pads).drop("_n", "_at", "_top")
    return out, sizes.drop("_n", "_top")


def unpad(df: DataFrame, pad_size: int | Column, n: int | Column, row_key="row_idx") -> DataFrame:
    """Drop the last ``pad_size`` rows."""
    ps = pad_size if isinstance(pad_size, Column) else F.lit(pad_size)
    nn = n if isinstance(n, Column) else F.lit(n)
    return df.filter(F.col(row_key) < nn - ps)


def fold(df: DataFrame, new_batch: int, n: int, cols, row_key="row_idx") -> DataFrame:
    """``[n] -> [m, n/m]``: row groups of n/m consecutive rows, each
    column becoming an ordered array (groups are bounded by n/m rows)."""
    if n % new_batch:
        raise ValueError(f"fold: {n} rows cannot form {new_batch} equal groups")
    size = n // new_batch
    g = df.withColumn("_g", (F.col(row_key) / F.lit(size)).cast("bigint"))
    packed = F.sort_array(F.collect_list(F.struct(F.col(row_key).alias("_o"), *[F.col(c) for c in cols])))
    out = g.groupBy("_g").agg(packed.alias("_s"))
    return out.select(F.col("_g").alias(row_key), *[F.col(f"_s.{c}").alias(c) for c in cols])


def unfold(df: DataFrame, cols, row_key="row_idx") -> DataFrame:
    """Nested rows back to flat rows (posexplode)."""
    z = F.arrays_zip(*[F.col(c) for c in cols])
    x = df.select(F.col(row_key).alias("_g"), F.size(F.col(cols[0])).alias("_w"), F.posexplode(z).alias("_p", "_z"))
    return x.select((F.col("_g") * F.col("_w") + F.col("_p")).cast("bigint").alias(row_key),
                    *[F.col(f"_z.{c}").alias(c) for c in cols])


def shuffle_order(seed: int, *keys) -> Column:
    """Seeded, partition-independent shuffle key."""
    return F.xxhash64(F.lit(seed), *[col(k) for k in keys])


def mini_batches(df: DataFrame, mini_batch_size: int, epochs: int = 1, seed: int = 0,
                 row_key="row_idx", by=(), drop_last: bool = False, exact: bool = False) -> DataFrame:
    """One copy per epoch, shuffled with a seeded hash, cut into
    mini-batches of ``mini_batch_size``; ``drop_last`` removes the final
    partial batch; ``exact`` (B13) fails where a batch does not divide."""
    by = list(by)
    if exact:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        whole = divided("_n", mini_batch_size, "mini-batches: batch size")
        if by:
            df = df.join(sizes.select(*by, whole.alias("_w")), by)
            df = df.filter(F.col("_w") >= 0).drop("_w")
        else:
            n = sizes.first()["_n"]
            if n % mini_batch_size:
                raise ValueError(f"mini-batches: {n} rows not divisible by {mini_batch_size}")
    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    e = e.withColumn("_h", shuffle_order(seed, "epoch", row_key))
    e = index_within(e, [*by, "epoch"], ["_h", row_key], "_pos")
    e = e.withColumn("mini_batch_id", (F.col("_pos") / F.lit(mini_batch_size)).cast("bigint"))
    if drop_last:
        n = e.groupBy(*by, "epoch").agg(F.count(F.lit(1)).alias("_n"))
        e = join_groups(e, n, [*by, "epoch"]).filter(
            F.col("mini_batch_id") < F.floor(F.col("_n") / F.lit(mini_batch_size))).drop("_n")
    return e.drop("_h", "_pos")


def check_consistency(df: DataFrame, array_cols, row_key="row_idx") -> DataFrame:
    """Rows whose array columns differ in length (violations table)."""
    sizes = [F.size(F.col(c)) for c in array_cols]
    bad = reduce(lambda a, b: a | b, [s != sizes[0] for s in sizes[1:]], F.lit(False))
    return df.filter(bad).select(row_key, *[s.alias(f"len_{c}") for s, c in zip(sizes, array_cols)])


def size_report(df: DataFrame, widths: dict[str, int], by=()) -> DataFrame:
    """Size in GB per column group: sum(size(array) * element width)."""
    exprs = []
    for c, w in widths.items():
        dt = dict(df.dtypes)[c]
        n = F.size(F.col(c)) if dt.startswith("array") else F.lit(1)
        exprs.append(F.sum(n.cast("bigint") * w).alias(f"bytes_{c}"))
    out = df.groupBy(*by).agg(*exprs)
    total = reduce(lambda a, b: a + b, [F.col(f"bytes_{c}") for c in widths])
    return out.withColumn("size_gb", total / F.lit(1024.0 ** 3))


def row_counts(df: DataFrame, by="batch_id") -> DataFrame:
    """B15 length: rows per batch."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def take_rows(df: DataFrame, item: int | slice, by="batch_id", row_key="row_idx") -> DataFrame:
    """B15 row and slice access in every batch at once, as Python indexes a
    sequence: negative places count from the batch's end (only they need the
    batches' lengths), a slice is cut to what is there and has a positive step.
    A single place outside a batch gives no row of it.  Rows keep their index."""
    one = not isinstance(item, slice)
    low, high, step = (item, item, 1) if one else (item.start or 0, item.stop, 1 if item.step is None else item.step)
    if step < 1:
        raise ValueError("the step of a slice of a batch must be positive")
    out = df
    if low < 0 or (high or 0) < 0:
        sizes = row_counts(df, by).select(F.col(by).alias("__by"), F.col("n").alias("__n"))
        out = df.join(sizes, F.col(by).eqNullSafe(F.col("__by")))
    place = lambda x: F.lit(x) if x >= 0 else F.col("__n") + x
    at = col(row_key)
    if one:
        keep = at == place(low)
    else:
        first = F.greatest(place(low), F.lit(0))
        keep = (at >= first) & ((at - first) % step == 0)
        if high is not None:
            keep = keep & (at < place(high))
    return out.filter(keep).select(*df.columns)


def prompt_uid(*keys) -> Column:
    """Deterministic id per prompt, shared by all its samples."""
    return F.sha2(F.concat_ws("\u0001", *[col(k).cast("string") for k in keys]), 256)
