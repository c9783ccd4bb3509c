"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes (words) are counted per document; the recipe has one row per source:
   its weight, its size and its target.  Targets share all words by weight; one
   above ``repeat`` times its source's size stops there and the excess is
   shared again.
2. A source is read in passes.  In every pass a keyed hash deals its documents
   anew into blocks of about BLOCK_WORDS words.  Whole passes are taken in
   full; of the last one as many blocks as its quota of words needs, and of the
   last block the first words in hash order.  So every source's words are its
   rounded target, and no document is taken more than ``repeat`` times.
3. The blocks of all sources are split among output shards by a binary tree
   over shard numbers.  A node holds exact block counts per source; its left
   half's counts are one multivariate-hypergeometric draw, seeded by the node.
   A leaf's counts, and what lies to its left, give it disjoint runs of block
   numbers.  Every task walks from the root to its own leaves only.
4. Documents join their blocks' shards and are shuffled within the shard.

Everything is a function of rows and seed, so reruns agree.  Rows equal in id,
source and text are told apart by a dense number made in two levels.

Defined results: a null text has no words; a null source is a source of its
own, last in order; an empty document is never taken; repeated rows are
documents of their own; a null id is kept; an empty table gives an empty
table; other columns are read only if they are to be carried.  The recipe
(one row per source) is held by the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from kestrel.llm.words import BATCH_BYTES, SPACE, utf8
from kestrel.session import cut_lineage

BLOCK_WORDS = 1 << 16   # words, and documents, of a block on average
SHARD_BLOCKS = 64       # blocks of a shard
RUN = 1024              # blocks summed before their running sums


def word_counts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words (runs of bytes other than ``[\\x20\\x09-\\x0D]``) of every row."""
    counts = np.zeros(len(bounds) - 1, np.int64)
    for at in range(int(bounds[0]), int(bounds[-1]), BATCH_BYTES):
        part = raw[at:min(at + BATCH_BYTES, int(bounds[-1]))]
        solid = ~SPACE[part]
        new = solid.copy()
        new[1:] &= ~solid[:-1]
        if at > bounds[0]:
            new[0] &= SPACE[raw[at - 1]]
        rows = bounds[np.searchsorted(bounds, at):np.searchsorted(bounds, at + len(part))] - at
        new[rows] = solid[rows]
        counts += np.diff(np.searchsorted(np.flatnonzero(new) + at, bounds))
    return counts


def sized_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: tuple[str, ...]) -> DataFrame:
    """A written table (id, source, key, copy, size, carried columns); (key, copy) is unique."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            size = word_counts(*utf8(batch.column(4)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *batch.columns[5:], pa.array(size)], names)

    names = ["id", "source", "key", "part", *[f"c_{c}" for c in carry], "size"]
    schema = ", ".join([f"id {kind}, source string, key long, part int",
                        *[f"`c_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry], "size long"])
    source = F.col(source_col).cast("string")
    read = docs.select(F.col(id_col).alias("id"), source.alias("source"), F.xxhash64(F.col(id_col), source, F.col(text_col)).alias("key"),
                       F.spark_partition_id().alias("part"), F.col(text_col).alias("t"), *[F.col(c).alias(f"c_{c}") for c in carry])
    table = cut_lineage(read.mapInArrow(run, schema), "mix-sizes")
    # copies of a key: numbered within the task that read them, shifted by the tasks before
    within = F.row_number().over(Window.partitionBy("key", "part").orderBy("size")) - 1
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (table.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
             .select("key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift")))
    return cut_lineage(table.withColumn("copy", within).join(shift, ["key", "part"])
                       .withColumn("copy", F.col("copy") + F.col("shift")).drop("part", "shift"), "mix-rows")


@dataclass
class Source:
    """A line of the recipe: ``passes`` in full, then ``rest`` words; blocks of a pass."""

    name: str | None
    size: int
    weight: int
    blocks: int
    target: Fraction = Fraction(0)
    passes: int = 0
    rest: int = 0
    last: int = -1       # block of the last pass that is cut
    last_words: int = 0  # and the words taken of it

    @property
    def quota(self) -> int:
        return self.passes * self.blocks + self.last + 1


def share_out(sizes: list[int], weights: list[int], repeat: int) -> list[Fraction]:
    """All words by weight, none above ``repeat`` times its size."""
    left, open_, out = Fraction(sum(sizes)), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        per = left / sum(weights[i] for i in open_)
        above = {i for i in open_ if per * weights[i] > repeat * sizes[i]}
        for i in above or open_:
            out[i] = Fraction(repeat * sizes[i]) if above else per * weights[i]
        left -= sum(out[i] for i in above)
        open_ = open_ - above if above else set()
    return out


def recipe_of(rows: DataFrame, weight: Callable[[int], int], repeat: int) -> list[Source]:
    """Sources in code-point order, null last, with targets and quotas in words."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # a row per source
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    out = [Source(r["source"], r["size"], weight(i), -(-(r["size"] + r["n"]) // BLOCK_WORDS)) for i, r in enumerate(found)]
    for s, target in zip(out, share_out([s.size for s in out], [s.weight for s in out], repeat), strict=True):
        s.target = target
        s.passes, s.rest = divmod(int(target + Fraction(1, 2)), s.size) if s.size else (0, 0)
    return out


class Mix:
    """A planned mix.  ``slots()`` are its documents by shard and position,
    ``taken()`` the words that it takes of every row."""

    def __init__(self, docs: DataFrame, seed: int = 0, weight: Callable[[int], int] = lambda i: i % 3 + 1, repeat: int = 3,
                 id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()):
        self.spark, self.seed, self.id_col, self.carry = docs.sparkSession, seed, id_col, carry
        self.rows = sized_rows(docs, id_col, text_col, source_col, carry)
        self.recipe = recipe_of(self.rows, weight, repeat)
        self._cut_last_blocks()
        self.quotas = np.array([s.quota for s in self.recipe], np.int64)
        self.shards = int(-(-self.quotas.sum() // SHARD_BLOCKS))

    def _lines(self) -> DataFrame:
        """The recipe as a table; ``s`` numbers the sources."""
        data = [(i, s.name, s.size, s.blocks, s.passes, s.rest, s.last, s.last_words, str(float(s.target))) for i, s in enumerate(self.recipe)]
        long = [StructField(c, LongType()) for c in ("source_size", "blocks", "passes", "rest", "last", "last_words")]
        schema = StructType([StructField("s", LongType()), StructField("name", StringType()), *long, StructField("target", StringType())])
        return self.spark.createDataFrame(data, schema).withColumn("target", F.col("target").cast("double"))

    def _with_lines(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._lines(), F.col("source").eqNullSafe(F.col("name"))).drop("name")

    def _dealt(self, passes) -> DataFrame:
        """Rows with ``pass``, its hash ``u`` and ``block``; ``passes``: an array column."""
        dealt = self._with_lines(self.rows).withColumn("pass", F.explode(passes))
        dealt = dealt.withColumn("u", F.xxhash64(F.lit(self.seed), "pass", "key", "copy"))
        return dealt.withColumn("block", F.pmod("u", F.col("blocks")))

    def _cut_last_blocks(self) -> None:
        """Where the last pass of every source ends: running sums over blocks in two levels."""
        dealt = self._dealt(F.when(F.col("rest") > 0, F.array("passes")).otherwise(F.array().cast("array<bigint>")))
        sums = (dealt.groupBy("s", "rest", "block").agg(F.sum("size").alias("words"))
                .withColumn("run", F.floor(F.col("block") / RUN)))
        sums = cut_lineage(sums, "mix-blocks")
        before = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        runs = (sums.groupBy("s", "run").agg(F.sum("words").alias("words"))
                .select("s", "run", before(Window.partitionBy("s").orderBy("run")).alias("shift")))
        at = (sums.withColumn("before", before(Window.partitionBy("s", "run").orderBy("block"))).join(runs, ["s", "run"])
              .withColumn("before", F.col("before") + F.col("shift"))
              .filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))))
        for r in at.select("s", "block", (F.col("rest") - F.col("before")).alias("words")).collect():  # a row per source
            self.recipe[r["s"]].last, self.recipe[r["s"]].last_words = r["block"], r["words"]

    def block_shards(self) -> DataFrame:
        """(s, rank, shard): the shard of every drawn block of source ``s``; a
        block's rank is its pass times the blocks of a pass, plus its number."""
        quotas, shards, seed = self.quotas, self.shards, self.seed

        def run(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy()
                if not len(ids):
                    continue
                own = list(leaves(quotas, shards, seed, int(ids.min()), int(ids.max()) + 1))
                shard = np.repeat(np.array([k for k, _, _ in own], np.int64), len(quotas))
                s = np.tile(np.arange(len(quotas)), len(own))
                n, first = (np.concatenate([x[i] for x in own]) for i in (1, 2))
                has = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[has]) for x in (shard, s, first, n)], ["shard", "s", "first", "n"])

        drawn = self.spark.range(self.shards).mapInArrow(run, "shard long, s long, first long, n long")
        return drawn.select("s", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("rank"), "shard")

    def slots(self) -> DataFrame:
        """shard, position, id, pass, size, taken (the document's first words
        that the slot takes: all but for a source's last document), key, copy,
        and the carried columns."""
        last = F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1)
        dealt = self._dealt(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>")))
        dealt = dealt.withColumn("rank", F.col("pass") * F.col("blocks") + F.col("block"))
        met = dealt.filter(F.col("size") > 0).join(self.block_shards(), ["s", "rank"])
        is_last = (F.col("pass") == F.col("passes")) & (F.col("block") == F.col("last"))
        order = Window.partitionBy("s").orderBy("u", "key", "copy").rowsBetween(Window.unboundedPreceding, -1)  # one block per source
        cut = (met.filter(is_last).withColumn("left", F.col("last_words") - F.coalesce(F.sum("size").over(order), F.lit(0)))
               .withColumn("taken", F.least("size", "left")).filter(F.col("taken") > 0).drop("left"))
        both = met.filter(~is_last).withColumn("taken", F.col("size")).unionByName(cut)
        place = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(self.seed), "shard", "pass", "key", "copy"), "pass", "key", "copy")
        return both.select("shard", (F.row_number().over(place) - 1).cast("long").alias("position"), F.col("id").alias(self.id_col),
                           "pass", "size", "taken", "key", "copy", *[F.col(f"c_{c}").alias(c) for c in self.carry])

    def taken(self) -> DataFrame:
        """Every row of the table: id, size, source_size, target, taken."""
        if not self.shards:
            words = self.rows.withColumn("taken", F.lit(0).cast("long"))
        else:
            sums = self.slots().groupBy("key", "copy").agg(F.sum("taken").alias("taken"))
            words = self.rows.join(sums, ["key", "copy"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
        return self._with_lines(words).select(F.col("id").alias(self.id_col), "size", "source_size", "target", "taken")

    def write(self, path: str) -> None:
        """The mix as Parquet files, whole shards in order."""
        (self.slots().repartitionByRange("shard").sortWithinPartitions("shard", "position").drop("key", "copy")
         .write.mode("overwrite").parquet(path))


def leaves(quotas: np.ndarray, shards: int, seed: int, first: int, end: int):
    """(shard, counts, offsets) of shards ``first`` to ``end - 1``: blocks per
    source, and the number of the first.  Nodes are walked from the root; only
    those above the asked shards are drawn."""
    total = int(quotas.sum())
    todo = [(0, shards, quotas, np.zeros(len(quotas), np.int64))]
    while todo:
        lo, hi, counts, offset = todo.pop()
        if hi <= first or lo >= end:
            continue
        if hi - lo == 1:
            yield lo, counts, offset
            continue
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, lo, hi])))
        left = rng.multivariate_hypergeometric(counts, total * mid // shards - total * lo // shards, method="marginals")
        todo += [(mid, hi, counts - left, offset + left), (lo, mid, left, offset)]
