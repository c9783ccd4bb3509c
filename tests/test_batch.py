"""Batch operators: golden cases asserted by the reference's own tests."""

import pytest
from pyspark.sql import functions as F

from kestrel.operators import batch as B
from kestrel.operators import tokens as TK


def rows(spark, labels):
    return spark.createDataFrame([(i, i + 1, l) for i, l in enumerate(labels)], "row_idx bigint, obs int, labels string")


def ordered(df, col="labels"):
    return [r[col] for r in df.orderBy("row_idx").collect()]


def test_reorder(spark):
    df = rows(spark, list("abcdef"))
    idx = spark.createDataFrame(list(enumerate([3, 4, 2, 0, 1, 5])), "row_idx bigint, src_idx bigint")
    out = B.reorder(df, idx)
    assert ordered(out, "obs") == [4, 5, 3, 1, 2, 6] and ordered(out) == list("decabf")


def test_chunk_and_concat(spark):
    df = rows(spark, list("abcdef"))
    with pytest.raises(ValueError):
        B.chunk(df, 5)
    ch = B.chunk(df, 2)
    parts = [ch.filter(F.col("chunk_id") == k).drop("chunk_id") for k in range(2)]
    assert [ordered(p, "obs") for p in parts] == [[1, 2, 3], [4, 5, 6]]
    back = B.concat([parts[0], parts[1].withColumn("row_idx", F.col("row_idx") - 3)])
    assert ordered(back) == list("abcdef")


def test_pop(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0)], "row_idx bigint, obs double, act double")
    popped, rest = B.pop(df, ["obs"])
    assert popped.columns == ["row_idx", "obs"] and rest.columns == ["row_idx", "act"]
    with pytest.raises(KeyError):
        B.pop(df, ["missing"])


@pytest.mark.parametrize("interleave,expected", [(True, list("aabbcc")), (False, list("abcabc"))])
def test_repeat(spark, interleave, expected):
    assert ordered(B.repeat(rows(spark, list("abc")), 2, interleave=interleave)) == expected


def test_pad_unpad(spark):
    df = rows(spark, list("abc"))
    padded, sizes = B.pad_to_divisor(df, 2)
    assert ordered(padded) == list("abca") and sizes.first().pad_size == 1
    assert ordered(B.unpad(padded, 1, 4)) == list("abc")
    _, sizes3 = B.pad_to_divisor(df, 3)
    assert sizes3.first().pad_size == 0
    # pad larger than the batch cycles through it
    p7, _ = B.pad_to_divisor(df, 7)
    assert ordered(p7) == list("abcabca")


def test_fold_reorder_unfold(spark):
    df = rows(spark, list("aabbcc"))
    f = B.fold(df, 3, 6, ["labels"])
    idx = spark.createDataFrame(list(enumerate([1, 2, 0])), "row_idx bigint, src_idx bigint")
    out = B.unfold(B.reorder(f, idx), ["labels"])
    assert ordered(out) == list("bbccaa")


def test_union_conflict(spark):
    a = spark.createDataFrame([(0, 1.0)], "row_idx bigint, x double")
    b = spark.createDataFrame([(0, 2.0)], "row_idx bigint, x double")
    _, conflicts = B.union_columns(a, b)
    assert [r.column for r in conflicts.collect()] == ["x"]
    _, none = B.union_columns(a, a)
    assert none.count() == 0


def test_len(spark):
    assert rows(spark, list("abc")).count() == 3


def test_eos_mask_golden(spark):
    df = spark.createDataFrame([([0, 0, 2, 42, 3, 5, 1, 0, 0],)], "ids array<int>")
    assert df.select(TK.eos_mask("ids", 1).alias("m")).first().m == [1, 1, 1, 1, 1, 1, 1, 0, 0]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_global_index_any_partitioning(spark, parts):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(parts)
    g = B.global_index(df, "k", "i")
    got = {r.k: r.i for r in g.collect()}
    assert got == {k: k for k in range(1000)}


def test_index_within(spark):
    df = spark.createDataFrame([(g, v) for g in "ab" for v in range(5)], "g string, v int").repartition(3)
    out = {(r.g, r.v): r.i for r in B.index_within(df, "g", "v", "i").collect()}
    assert out == {(g, v): v for g in "ab" for v in range(5)}


def test_flatten_nested_config(spark):
    from kestrel.operators.metrics import flatten_json
    df = spark.createDataFrame([(1, '{"a": {"b": 1, "c": [5, 6]}, "d": "x"}')], "id int, cfg string")
    got = {r.path: r.value for r in flatten_json(df, "id", "cfg").collect()}
    assert got == {"a/b": "1", "a/c/list_len": "2", "a/c/0": "5", "a/c/1": "6", "d": "x"}


def test_flatten_keeps_json_looking_strings(spark):
    from kestrel.operators.metrics import flatten_json
    df = spark.createDataFrame([(1, '{"s": "[not a list", "o": "{x", "n": null, "b": true, "l": [[1], {"q": 2}]}')],
                               "id int, cfg string")
    got = {r.path: r.value for r in flatten_json(df, "id", "cfg").collect()}
    assert got == {"s": "[not a list", "o": "{x", "n": None, "b": "true", "l/list_len": "2",
                   "l/0/list_len": "1", "l/0/0": "1", "l/1/q": "2"}


def test_sizes_that_do_not_divide_fail(spark):
    df = spark.createDataFrame([(0, i) for i in range(7)], "batch_id int, row_idx bigint")
    with pytest.raises(Exception, match="not divisible"):
        B.chunk(df, 2, by=["batch_id"]).collect()
    with pytest.raises(ValueError):
        B.fold(df, 2, 7, ["batch_id"])
    with pytest.raises(Exception, match="not divisible"):
        B.mini_batches(df, 2, by=["batch_id"], exact=True).collect()
    assert B.mini_batches(df, 7, by=["batch_id"], exact=True).count() == 7


def test_json_of_any_depth_reaches_its_leaves(spark):
    import json

    from kestrel.operators.metrics import flatten_json
    doc = {"leaf": 1}
    for _ in range(19):
        doc = {"k": doc}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "[]"), (3, "{}")], "id int, j string")
    got = {(r.id, r.path): r.value for r in flatten_json(df, "id", "j").collect()}
    assert got == {(1, "k/" * 19 + "leaf"): "1", (2, "list_len"): "0", (3, ""): "{}"}
