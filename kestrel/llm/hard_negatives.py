"""Hard negatives for anchor vectors, scored exactly by Four-Russians tables.

1. A component becomes ``floor(scale * x)``.  Every vector is written once as
   bit planes: plane ``b`` holds bit ``b`` of all its components (two's
   complement), eight components to a byte.
2. Anchors meet all rows in cells of a block grid: an anchor block and a
   candidate block, both of bounded size, whatever the table holds.
3. In a cell each anchor gets, for every group of eight dimensions, the sums of
   all 256 subsets of its eight components.  A candidate's plane byte indexes
   such a table; what the groups give is added, the planes are added by shifts
   (the sign plane is subtracted).  The result is the full inner product.
4. The first pass keeps an anchor's best rows of its own label (positives), the
   second the best rows of other labels between two shares of each positive's
   score.  A cell sends at most the wanted number of rows per anchor and window.

Defined results: rows with a null id, label or vector, or with any null or
non-finite component, take no part; shorter vectors count as padded with
zeros; an empty vector scores 0; repeated rows are rows of their own, and one
repeated row is the other's positive; equal scores are ordered by the smaller
id; a negative positive score has no window; an empty table gives an empty
table; other columns are not read.  Vectors whose inner products could pass 64
bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.session import cut_lineage

CANDIDATES = 16384  # rows of a candidate block
ANCHORS = 2048      # of an anchor block
TOGETHER = 64       # anchors whose tables are held at once
PACK_VALUES = 1 << 22
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def plane_bytes(values: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits, groups) bytes of whole numbers (rows, 8 * groups)."""
    return np.stack([np.packbits(((values >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)], axis=1)


def plane_values(planes: np.ndarray) -> np.ndarray:
    """The whole numbers of ``plane_bytes``."""
    bits = planes.shape[1]
    out = np.zeros((planes.shape[0], planes.shape[2] * 8), np.int64)
    for b in range(bits):
        own = np.unpackbits(planes[:, b], axis=1, bitorder="little").astype(np.int64)
        out += own * (-(1 << b) if b == bits - 1 else 1 << b)
    return out


def subset_sums(values: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): sums of every subset of eight components."""
    eight = values.reshape(len(values), -1, 8).transpose(1, 2, 0).astype(kind)
    out = np.zeros((eight.shape[0], 256, len(values)), kind)
    for j in range(8):
        out[:, 1 << j:2 << j] = out[:, :1 << j] + eight[:, j:j + 1]
    return out


def inner_products(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(anchors, candidates) inner products by lookups and shifts."""
    groups, _, anchors = tables.shape
    total = np.zeros((len(planes), anchors), tables.dtype)
    for b in reversed(range(planes.shape[1])):
        total <<= 1
        for g in range(groups):
            found = tables[g].take(planes[:, b, g], axis=0)
            if b == planes.shape[1] - 1:
                total -= found
            else:
                total += found
    return np.ascontiguousarray(total.T)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by falling score, then rising id."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at].astype(np.int64)))[:k]]


def packed_rows(rows: DataFrame, dims: int, bits: int) -> DataFrame:
    """A written table (row, id, label, planes); ``row`` tells repeated rows apart."""
    groups = -(-dims // 8)

    def run(batches):
        for whole in batches:
            step = max(1, PACK_VALUES // (8 * groups))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                vectors = batch.column(3)
                sizes = vectors.value_lengths().to_numpy()
                flat = np.floor(256.0 * vectors.flatten().to_numpy().astype(np.float64)) if sizes.sum() else np.zeros(0)
                values = np.zeros((batch.num_rows, 8 * groups), np.int64)
                line = np.repeat(np.arange(batch.num_rows), sizes)
                values[line, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.astype(np.int64)
                planes = pa.array([p.tobytes() for p in plane_bytes(values, bits)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], planes], ["row", "id", "label", "planes"])

    return cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "label", "vector")
                       .mapInArrow(run, "row long, id long, label long, planes binary"), "negatives-planes")


class Cells:
    """The two passes over a cell: Arrow functions (anchors, candidates) -> rows."""

    def __init__(self, bits: int, groups: int, kind: type, positives: int, negatives: int, low: int, high: int):
        self.bits, self.groups, self.kind = bits, groups, kind
        self.positives, self.negatives, self.low, self.high = positives, negatives, low, high

    def _planes(self, table: pa.Table) -> np.ndarray:
        blob = b"".join(table["planes"].to_pylist())
        return np.frombuffer(blob, np.uint8).reshape(table.num_rows, self.bits, self.groups)

    def own_label(self, anchors: pa.Table, others: pa.Table) -> pa.Table:
        """(row, anchor_id, self_score, positive_id, score)."""
        values, planes = plane_values(self._planes(anchors)), self._planes(others)
        row, name, of = (anchors[c].to_numpy() for c in ("row", "id", "label"))
        ids, labels = others["id"].to_numpy(), others["label"].to_numpy()
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for label in np.unique(of):
            mine, same = np.flatnonzero(of == label), np.flatnonzero(labels == label)
            if not same.size:
                continue
            for s in range(0, len(mine), TOGETHER):
                some = mine[s:s + TOGETHER]
                scores = inner_products(subset_sums(values[some], self.kind), planes[same])
                for a, score in zip(some.tolist(), scores, strict=True):
                    at = best(score, ids[same], self.positives + 1)
                    for c, x in zip(out, (np.full(len(at), row[a]), np.full(len(at), name[a]), np.full(len(at), int((values[a] ** 2).sum())),
                                          ids[same][at], score[at].astype(np.int64)), strict=True):
                        c.append(x)
        return pa.table([np.concatenate([np.zeros(0, np.int64), *c]) for c in out], ["row", "anchor_id", "self_score", "positive_id", "score"])

    def other_labels(self, anchors: pa.Table, others: pa.Table) -> pa.Table:
        """(row, window, negative_id, score); an anchor's ``scores`` are its positives'."""
        values, planes = plane_values(self._planes(anchors)), self._planes(others)
        row, of, windows = anchors["row"].to_numpy(), anchors["label"].to_numpy(), anchors["scores"].to_pylist()
        ids, labels = others["id"].to_numpy(), others["label"].to_numpy()
        out: list[list[np.ndarray]] = [[] for _ in range(4)]
        for s in range(0, len(row), TOGETHER):
            scores = inner_products(subset_sums(values[s:s + TOGETHER], self.kind), planes)
            for a, score in enumerate(scores, s):
                other = labels != of[a]
                for k, p in enumerate(windows[a]):
                    least, most = -(-self.low * p // 100), self.high * p // 100
                    at = np.flatnonzero(other & (score >= least) & (score <= most))
                    at = at[best(score[at], ids[at], self.negatives)]
                    for c, x in zip(out, (np.full(len(at), row[a]), np.full(len(at), k), ids[at], score[at].astype(np.int64)), strict=True):
                        c.append(x)
        return pa.table([np.concatenate([np.zeros(0, np.int64), *c]) for c in out], ["row", "window", "negative_id", "score"])


def _over_cells(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, fn, schema: str) -> DataFrame:
    """``fn`` over every cell of the grid of anchor and candidate blocks."""
    a, c = -(-n_anchors // ANCHORS), -(-n_rows // CANDIDATES)
    block = lambda salt, n: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.select(*(F.col(x).alias(x) for x in rows.columns))  # both sides come from one table
    left = anchors.withColumn("a", block(0, a)).withColumn("c", every(c))
    right = rows.withColumn("c", block(1, c)).withColumn("a", every(a))
    return left.groupBy("a", "c").cogroup(right.groupBy("a", "c")).applyInArrow(lambda mine, others: fn(mine, others), schema)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Anchors (ids divisible by ``every``), their ``positives`` best rows of
    the same label, and for each the ``negatives`` best rows of other labels
    with ``low * positive <= 100 * negative <= high * positive``."""
    spark = rows.sparkSession
    number = lambda e: e.cast("double")
    finite = F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(number(e)) & (F.abs(number(e)) != float("inf")))
    used = (rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vector"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite))
    shape = used.agg(F.max(F.size("vector")).alias("dims"), F.max(F.array_max(F.transform("vector", lambda e: F.abs(number(e))))).alias("most")).first()
    dims, largest = max(shape["dims"] or 0, 1), int(256 * (shape["most"] or 0.0)) + 1
    if 100 * dims * largest * largest >= 1 << 63:
        raise ValueError("inner products of these vectors may pass 64 bits")
    bits, groups = largest.bit_length() + 1, -(-dims // 8)
    kind = np.int32 if dims * largest * largest < 1 << 30 else np.int64
    packed = packed_rows(used, dims, bits)
    is_anchor = F.col("id") % every == 0
    sizes = packed.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("a")).first()
    if not sizes["a"]:
        return spark.createDataFrame([], RESULT)
    cells = Cells(bits, groups, kind, positives, negatives, low, high)
    anchors = packed.filter(is_anchor)

    near = _over_cells(anchors, packed, sizes["a"], sizes["n"], cells.own_label,
                       "row long, anchor_id long, self_score long, positive_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "positive_id")
    ranked = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= positives + 1)
    is_self = (F.col("positive_id") == F.col("anchor_id")) & (F.col("score") == F.col("self_score"))
    ranked = ranked.withColumn("own", F.min(F.when(is_self, F.col("r"))).over(Window.partitionBy("row")))
    chosen = cut_lineage(
        ranked.filter(~F.col("r").eqNullSafe(F.col("own")))
        .withColumn("window", F.col("r") - 1 - F.when(F.col("r") > F.col("own"), 1).otherwise(0)).filter(F.col("window") < positives)
        .select("row", "anchor_id", "window", "positive_id", F.col("score").alias("positive_score")), "negatives-positives")

    lists = chosen.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("window", "positive_score"))).alias("w"))  # at most ``positives``
    asked = anchors.join(lists, "row").select("row", "id", "label", "planes", F.col("w.positive_score").alias("scores"))
    far = _over_cells(asked, packed, sizes["a"], sizes["n"], cells.other_labels, "row long, window long, negative_id long, score long")
    first = Window.partitionBy("row", "window").orderBy(F.desc("score"), "negative_id")
    return (far.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
            .join(chosen.withColumn("window", F.col("window").cast("long")), ["row", "window"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
                    F.col("score").alias("negative_score")))
