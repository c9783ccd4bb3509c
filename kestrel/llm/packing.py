"""Best-fit packing planned on the length histogram.

Documents become token pieces of at most ``capacity`` ids (only longer
documents are cut).  The driver plans on counts: the histogram has at most
``capacity`` rows whatever the corpus, and best-fit decreasing runs over
groups of equal sequences instead of documents.  The plan says for ranks
``[first, first + n)`` of a length where they go; pieces then take their slots
by joining on their rank within the length.

Ranks are made without a hot task: a length with many pieces is divided into
salted groups of about RANK_ROWS rows, numbered in parallel, and shifted by a
running sum of the groups' counts.

The plan's size is bounded by the capacity alone: at most four groups of
sequences are opened or split per length, and a group is filled by pieces of
falling lengths whose sum is at most the capacity, so by fewer than
``sqrt(2 * capacity)`` of them.  That bounded table is broadcast.

Defined results: a null or empty text gives one piece with the end id alone;
repeated rows are packed each; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from kestrel.llm.text_tokens import encode_each, encoder
from kestrel.session import cut_lineage

CAPACITY = 2048
RANK_ROWS = 1024
OUT_BYTES = 8 << 20  # ids in one outgoing Arrow batch


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of pieces: id, piece, start, length, ids (little-endian
    unsigned 32-bit).  ``tokenizer`` is a path that every machine has."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            keys, out, held = batch.column(0), [], 0

            def made():
                take, piece, start, length, blobs = zip(*out, strict=True)
                return pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(blobs, pa.binary())],
                    [id_col, "piece", "start", "length", "ids"])

            for row, ids in enumerate(encode_each(enc, (x.as_py() for x in batch.column(1)))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    out.append((row, k, at, len(part), part.tobytes()))
                held += ids.nbytes
                if held >= OUT_BYTES:
                    yield made()
                    out, held = [], 0
            if out:
                yield made()

    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids binary"
    return cut_lineage(docs.select(id_col, text_col).mapInArrow(run, schema), "pieces", "zstd")


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.  Rows (length, first, n, per, sequence,
    offset): rank ``first + i`` of the length goes to ``sequence + i // per``,
    at ``offset + i % per * length``."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> groups (first sequence, how many)
    sizes: list[int] = []                        # the keys of room, ascending
    opened = 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(sizes, left)
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            i = bisect_left(sizes, length)
            if i < len(sizes):
                left = sizes[i]
                first, have = room[left].pop()
                if not room[left]:
                    del room[left], sizes[i]
            else:
                left, first, have = capacity, opened, -(-todo // (capacity // length))
                opened += have
            fit = left // length
            full = min(have, todo // fit)
            per, n = (fit, full) if full else (todo, 1)
            rows.append((length, rank, per * n, per, first, capacity - left))
            put(left - per * length, first, n)
            put(left, first + n, have - n)
            rank, todo = rank + per * n, todo - per * n
    return rows


def assign(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (a written table) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    if len(counted) > capacity:
        raise ValueError("a piece is longer than a sequence")
    histogram = {r["length"]: r["n"] for r in counted}
    names = ("length", "__first", "__n", "__per", "__sequence", "__offset")
    plan = spark.createDataFrame(plan_slots(histogram, capacity),
                                 StructType([StructField(c, LongType()) for c in names]))
    groups = spark.createDataFrame([(k, -(-n // RANK_ROWS)) for k, n in histogram.items()], "length long, __groups long")
    salted = (pieces.join(F.broadcast(groups), "length")
              .withColumn("__salt", F.pmod(F.xxhash64(*order, "start"), F.col("__groups"))).drop("__groups"))
    counts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__c"))
    below = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "__salt", F.coalesce(F.sum("__c").over(below), F.lit(0)).alias("__shift"))
    within = Window.partitionBy("length", "__salt").orderBy(*order)
    ranked = (salted.withColumn("__r", F.row_number().over(within) - 1)
              .join(shift, ["length", "__salt"])
              .withColumn("__rank", F.col("__r") + F.col("__shift")))
    inside = (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__first") + F.col("__n"))
    step = F.col("__rank") - F.col("__first")
    return (ranked.join(F.broadcast(plan).withColumnRenamed("length", "__length"), (F.col("length") == F.col("__length")) & inside)
            .withColumn("sequence_id", F.col("__sequence") + F.floor(step / F.col("__per")).cast("long"))
            .withColumn("offset", F.col("__offset") + step % F.col("__per") * F.col("length"))
            .select(*pieces.columns, "sequence_id", "offset"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY,
         id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Pieces with their place: id, piece, start, length, sequence_id, offset
    and ids, or with ``digest`` the CRC-32 of the ids instead of them."""
    pieces = token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col)
    if digest:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
        return assign(pieces, capacity, (id_col, "piece", "ids_crc32"))
    return assign(pieces, capacity, (id_col, "piece", "ids"))
