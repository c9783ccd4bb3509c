"""Registered batch (B*) and balancing (L*) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import balance as L
from kestrel.operators import batch as B
from kestrel.operators.tokens import to_arrays
from kestrel.sources.tables import fixture, read_table, with_fixtures

Q: dict = {}


def reg(name, sql=None, fixtures=()):
    def deco(fn):
        Q[name] = (fn, with_fixtures(sql, *fixtures) if (sql and fixtures) else sql)
        return fn
    return deco


def nation(spark, sf):
    return read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("row_idx"),
                                                  "n_name", "n_regionkey")


def lengths(spark, sf):
    return fixture(spark, sf, "fx_lengths").withColumn("row_idx", F.col("row_idx").cast("bigint"))


@reg("B1_select_keys", "SELECT CAST(n_nationkey AS BIGINT) AS row_idx, n_name FROM nation")
def b1(spark, sf):
    return B.select_keys(nation(spark, sf), ["n_name"])


@reg("B2_pop", "SELECT CAST(n_nationkey AS BIGINT) AS row_idx, n_regionkey FROM nation")
def b2(spark, sf):
    popped, rest = B.pop(nation(spark, sf), ["n_name"])
    return rest


@reg("B3_rename", "SELECT CAST(n_nationkey AS BIGINT) AS row_idx, n_name AS name, n_regionkey AS region FROM nation")
def b3(spark, sf):
    return B.rename(nation(spark, sf), ["n_name", "n_regionkey"], ["name", "region"])


@reg("B4_union_conflicts", """
SELECT o_orderkey AS row_idx, 'o_orderstatus' AS "column" FROM orders WHERE o_orderkey % 5 = 0 AND lower(o_orderstatus) <> o_orderstatus""")
def b4(spark, sf):
    o = read_table(spark, sf, "orders")
    a = o.select(F.col("o_orderkey").alias("row_idx"), "o_orderstatus", "o_totalprice")
    b = o.select(F.col("o_orderkey").alias("row_idx"),
                 F.when(F.col("o_orderkey") % 5 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
                 .alias("o_orderstatus"), "o_orderpriority")
    merged, conflicts = B.union_columns(a, b)
    return conflicts


@reg("B5_concat", """
SELECT doc_id, CAST(CASE WHEN lang = 'en' THEN row_number() OVER (PARTITION BY lang = 'en' ORDER BY doc_id) - 1
            ELSE (SELECT count(*) FROM documents WHERE lang = 'en') + row_number() OVER (PARTITION BY lang = 'en' ORDER BY doc_id) - 1 END AS BIGINT) AS row_idx
FROM documents""")
def b5(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang")
    en = B.global_index(d.filter(F.col("lang") == "en"), "doc_id").select("doc_id", "row_idx")
    other = B.global_index(d.filter(F.col("lang") != "en"), "doc_id").select("doc_id", "row_idx")
    return B.concat([en, other])


@reg("B6_chunk_after_pad", """
WITH l AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS n FROM fx_lengths),
p AS (SELECT batch_id, row_idx, n, (8 - n % 8) % 8 AS pad FROM l
      UNION ALL SELECT batch_id, n + row_idx AS row_idx, n, (8 - n % 8) % 8 AS pad FROM l WHERE row_idx < (8 - n % 8) % 8)
SELECT batch_id, CAST(row_idx // ((n + pad) // 4) AS INT) AS chunk_id, count(*) AS n_rows FROM p GROUP BY ALL""",
     ("fx_lengths",))
def b6(spark, sf):
    padded, _ = B.pad_to_divisor(lengths(spark, sf), 8, by=["batch_id"])
    ch = B.chunk(padded, 4, by=["batch_id"])
    return ch.groupBy("batch_id", "chunk_id").agg(F.count(F.lit(1)).alias("n_rows"))


@reg("B7_repeat", """
SELECT CAST(o_orderkey AS BIGINT) AS rollout_id, o_orderkey * 3 + j AS row_idx, CAST(j AS INT) AS sample
FROM (SELECT o_orderkey, unnest([0, 1, 2]) AS j FROM orders) x""")
def b7(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("rollout_id"),
                                               F.col("o_orderkey").alias("row_idx"))
    r = B.repeat(o, 3, interleave=True)
    return r.select("rollout_id", "row_idx", (F.col("row_idx") - F.col("rollout_id") * 3).cast("int").alias("sample"))


@reg("B8_reorder", """
SELECT batch_id, CAST(count(*) OVER (PARTITION BY batch_id) - 1 - row_idx AS BIGINT) AS row_idx, row_id FROM fx_lengths""",
     ("fx_lengths",))
def b8(spark, sf):
    d = lengths(spark, sf)
    n = d.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    idx = d.join(n, "batch_id").select("batch_id", "row_idx", (F.col("n") - 1 - F.col("row_idx")).alias("src_idx"))
    out = B.reorder(d, idx, by=["batch_id"])
    return out.select("batch_id", F.col("row_idx").cast("bigint").alias("row_idx"), "row_id")


@reg("B9_pad_to_divisor", """
WITH l AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS n FROM fx_lengths)
SELECT batch_id, CAST(n + row_idx AS BIGINT) AS row_idx, row_id FROM l WHERE row_idx < (7 - n % 7) % 7""", ("fx_lengths",))
def b9(spark, sf):
    padded, sizes = B.pad_to_divisor(lengths(spark, sf), 7, by=["batch_id"])
    return padded.filter("is_pad").select("batch_id", "row_idx", "row_id")


@reg("B10_unpad", "SELECT batch_id, count(*) AS n FROM fx_lengths GROUP BY batch_id", ("fx_lengths",))
def b10(spark, sf):
    d = lengths(spark, sf)
    padded, sizes = B.pad_to_divisor(d, 7, by=["batch_id"])
    n = d.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n0"))
    x = padded.join(n, "batch_id")
    un = B.unpad(x, F.col("pad_size"), F.col("_n0") + F.col("pad_size"))
    return un.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@reg("B11_fold_unfold", """
WITH n AS (SELECT count(*) AS n FROM orders)
SELECT o_orderkey AS row_idx, o_totalprice, false AS is_pad FROM orders
UNION ALL SELECT n + o_orderkey, o_totalprice, true FROM orders, n WHERE o_orderkey < (3 - n % 3) % 3""")
def b11(spark, sf):
    # pad to a multiple of 3 first (as before any fold), so every row is kept
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_idx"), "o_totalprice")
    padded, sizes = B.pad_to_divisor(o, 3)
    total = o.count() + int(sizes.first()["pad_size"])
    f = B.fold(padded, total // 3, total, ["o_totalprice", "is_pad"])
    return B.unfold(f, ["o_totalprice", "is_pad"])


@reg("B13_mini_batches", """
WITH n AS (SELECT batch_id, count(*) AS n FROM fx_lengths GROUP BY batch_id),
e AS (SELECT batch_id, n, unnest([0, 1]) AS epoch FROM n),
m AS (SELECT batch_id, epoch, n, unnest(range(0, n // 4)) AS mb FROM e)
SELECT batch_id, CAST(epoch AS INT) AS epoch, CAST(mb AS BIGINT) AS mini_batch_id, CAST(4 AS BIGINT) AS n_rows FROM m""",
     ("fx_lengths",))
def b13(spark, sf):
    mb = B.mini_batches(lengths(spark, sf), 4, epochs=2, seed=7, by=["batch_id"], drop_last=True)
    return mb.groupBy("batch_id", F.col("epoch").cast("int").alias("epoch"), "mini_batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"))


@reg("B14_shuffled_loader", """
SELECT CAST(count(*) // 16 * 16 AS BIGINT) AS n_kept, CAST(count(*) // 16 AS BIGINT) AS n_batches FROM orders""")
def b14(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_idx"))
    mb = B.mini_batches(o, 16, epochs=1, seed=3, drop_last=True)
    return mb.agg(F.count(F.lit(1)).alias("n_kept"), F.countDistinct("mini_batch_id").alias("n_batches"))


@reg("B15_len_getitem", """
SELECT batch_id, count(*) AS n, max(CASE WHEN row_idx = 2 THEN row_id END) AS third_row FROM fx_lengths GROUP BY batch_id""",
     ("fx_lengths",))
def b15(spark, sf):
    d = lengths(spark, sf)
    third = B.take_rows(d, 2).select("batch_id", F.col("row_id").alias("third_row"))
    return B.row_counts(d).join(third, "batch_id", "left")


@reg("B16_consistency_check", """
SELECT rollout_id AS row_idx, CAST(count(*) AS INT) AS len_mask, CAST(count(*) - rollout_id % 3 AS INT) AS len_v
FROM fx_tokens GROUP BY rollout_id HAVING rollout_id % 3 <> 0""", ("fx_tokens",))
def b16(spark, sf):
    arr = to_arrays(fixture(spark, sf, "fx_tokens"), "rollout_id", "t", ["mask", "v"])
    arr = arr.withColumn("v", F.slice("v", 1, F.size("v") - F.col("rollout_id") % 3))
    return B.check_consistency(arr.withColumnRenamed("rollout_id", "row_idx"), ["mask", "v"])


@reg("B17_size_report", """
SELECT batch_id, CAST(count(*) * 4 AS BIGINT) AS bytes_mask, CAST(count(*) * 8 AS BIGINT) AS bytes_v,
       count(*) * 12 / 1073741824.0 AS size_gb FROM fx_tokens GROUP BY batch_id""", ("fx_tokens",))
def b17(spark, sf):
    arr = to_arrays(fixture(spark, sf, "fx_tokens"), ["batch_id", "rollout_id"], "t", ["mask", "v"])
    return B.size_report(arr, {"mask": 4, "v": 8}, by=["batch_id"])


@reg("B18_prompt_uid", """
SELECT conv_id, turn, sha256(concat_ws(chr(1), CAST(conv_id AS VARCHAR), text)) AS uid FROM conversations WHERE role = 'user'""")
def b18(spark, sf):
    c = read_table(spark, sf, "conversations").filter(F.col("role") == "user")
    return c.select("conv_id", "turn", B.prompt_uid("conv_id", "text").alias("uid"))


# ---------------------------------------------------------------- balancing

@reg("L3_balanced_partitions", """
SELECT batch_id, CAST(4 AS BIGINT) AS n_partitions, count(*) AS n_items, CAST(sum(seqlen) AS BIGINT) AS total_seqlen
FROM fx_lengths GROUP BY batch_id""", ("fx_lengths",))
def l3(spark, sf):
    a = L.assign_partitions(lengths(spark, sf), 4, False)
    return a.groupBy("batch_id").agg(F.countDistinct("partition").alias("n_partitions"),
                                     F.count(F.lit(1)).alias("n_items"),
                                     F.sum("seqlen").cast("bigint").alias("total_seqlen"))


PADDED2 = """
WITH l AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS n FROM fx_lengths),
p AS (SELECT batch_id, row_idx, seqlen, n FROM l
      UNION ALL SELECT batch_id, n + row_idx, seqlen, n FROM l WHERE row_idx < (2 - n % 2) % 2)"""


@reg("L1_karmarkar_karp_equal", PADDED2 + """
SELECT batch_id, CAST(2 AS BIGINT) AS n_parts, CAST((n + n % 2) / 2 AS BIGINT) AS min_items,
       CAST((n + n % 2) / 2 AS BIGINT) AS max_items, CAST(sum(seqlen) AS BIGINT) AS total FROM p GROUP BY batch_id, n""",
     ("fx_lengths",))
def l1(spark, sf):
    # equal-size largest differencing: every part gets the same number of rows
    padded, _ = B.pad_to_divisor(lengths(spark, sf), 2, by=["batch_id"])
    a = L.assign_partitions(padded.select("batch_id", "row_idx", "seqlen"), 2, True)
    per = a.groupBy("batch_id", "partition").agg(F.count(F.lit(1)).alias("c"), F.sum("seqlen").alias("s"))
    return per.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_parts"), F.min("c").alias("min_items"),
                                       F.max("c").alias("max_items"), F.sum("s").cast("bigint").alias("total"))


@reg("L1_karmarkar_karp_sums", """
SELECT batch_id, CAST(4 AS BIGINT) AS n_parts, CAST(sum(seqlen) AS BIGINT) AS total, count(*) AS n_items, true AS tight
FROM fx_lengths GROUP BY batch_id""", ("fx_lengths",))
def l1_sums(spark, sf):
    # largest differencing: the parts' sums differ by less than the longest row
    a = L.assign_partitions(lengths(spark, sf), 4, False)
    per = a.groupBy("batch_id", "partition").agg(F.sum("seqlen").alias("s"), F.count(F.lit(1)).alias("n"), F.max("seqlen").alias("m"))
    return per.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("s").cast("bigint").alias("total"),
                                       F.sum("n").cast("bigint").alias("n_items"), (F.max("s") - F.min("s") <= F.max("m")).alias("tight"))


@reg("L2_greedy_partition", """
SELECT batch_id, CAST(2 AS BIGINT) AS n_partitions, count(*) AS n_items FROM fx_lengths GROUP BY batch_id""", ("fx_lengths",))
def l2(spark, sf):
    a = L.assign_partitions(lengths(spark, sf), 2, False, method="greedy")
    return a.groupBy("batch_id").agg(F.countDistinct("partition").alias("n_partitions"), F.count(F.lit(1)).alias("n_items"))


@reg("L4_unbalance_before", """
WITH l AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS n FROM fx_lengths),
c AS (SELECT batch_id, floor(row_idx / floor(n / 4)) AS ch, sum(seqlen) AS s FROM l GROUP BY ALL)
SELECT batch_id, CAST(min(s) AS BIGINT) AS "seqlen/min", CAST(max(s) AS BIGINT) AS "seqlen/max",
       CAST(max(s) - min(s) AS BIGINT) AS "seqlen/minmax_diff", sum(s) / 4.0 AS "seqlen/mean" FROM c GROUP BY batch_id""",
     ("fx_lengths",))
def l4(spark, sf):
    return L.unbalance_stats(lengths(spark, sf), 4, partition=None)


@reg("L5_micro_batches", """
SELECT batch_id, CAST(ceil(sum(seqlen) / 2048.0) AS BIGINT) AS n_micro_batches, count(*) AS n_items FROM fx_lengths GROUP BY batch_id""",
     ("fx_lengths",))
def l5(spark, sf):
    mb = L.micro_batches(lengths(spark, sf), 2048, max_seq_len=512)
    return mb.groupBy("batch_id").agg(F.countDistinct("micro_batch").alias("n_micro_batches"),
                                      F.count(F.lit(1)).alias("n_items"))


@reg("L6_reverse_index", "SELECT batch_id, CAST(row_idx AS BIGINT) AS row_idx, row_id FROM fx_lengths", ("fx_lengths",))
def l6(spark, sf):
    # equal rows per rank: padded as for L7, and the pads removed at the end
    padded, _ = B.pad_to_divisor(lengths(spark, sf), 2, by=["batch_id"])
    bal = L.balance_batch(padded, 2)
    rev = L.reverse_index(bal.select("batch_id", "row_idx", "new_idx"))
    # applying the inverse restores the original order
    restored = bal.select("batch_id", F.col("new_idx").alias("row_idx"), "row_id", "is_pad").join(rev, ["batch_id", "row_idx"])
    return restored.filter(~F.col("is_pad")).select("batch_id", F.col("reverse_idx").alias("row_idx"), "row_id")


@reg("L7_balance_batch", PADDED2 + """
SELECT batch_id, CAST(2 AS BIGINT) AS n_ranks, CAST((n + n % 2) / 2 AS BIGINT) AS rows_per_rank,
       CAST(sum(seqlen) AS BIGINT) AS tokens, CAST(count(*) - 1 AS BIGINT) AS max_new_idx FROM p GROUP BY batch_id, n""",
     ("fx_lengths",))
def l7(spark, sf):
    # equal rows per rank needs a batch size divisible by the world size:
    # pad each batch first (as the reference pads to the data-parallel size)
    padded, _ = B.pad_to_divisor(lengths(spark, sf), 2, by=["batch_id"])
    bal = L.balance_batch(padded.select("batch_id", "row_idx", "row_id", "seqlen"), 2)
    per = bal.groupBy("batch_id", "rank").agg(F.count(F.lit(1)).alias("c"))
    tot = bal.groupBy("batch_id").agg(F.sum("seqlen").cast("bigint").alias("tokens"), F.max("new_idx").alias("max_new_idx"))
    return per.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_ranks"), F.max("c").alias("rows_per_rank"),
                                       F.min("c").alias("_min")) \
        .filter(F.col("_min") == F.col("rows_per_rank")).drop("_min").join(tot, "batch_id")


@reg("B12_unfold", """
SELECT batch_id, CAST(row_idx AS BIGINT) AS row_idx, row_id FROM fx_lengths""", ("fx_lengths",))
def b12(spark, sf):
    # collate each batch into groups of 8 ordered rows (nested), then unfold back to flat rows
    d = lengths(spark, sf).withColumn("part", (F.col("row_idx") / 8).cast("bigint"))
    nested = to_arrays(d, ["batch_id", "part"], "row_idx", ["row_idx", "row_id"])
    flat = nested.select("batch_id", F.inline(F.arrays_zip("row_idx", "row_id")))
    return flat.select("batch_id", F.col("row_idx").cast("bigint").alias("row_idx"), "row_id")
