"""Connected components of an edge table by hashed hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import cut_lineage, drop_tables


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) to (node, label): every node of an edge, and the
    least node of its component.

    A round hooks every node to its least neighbour, jumps until the pointers
    are flat, and maps the edges to roots; edges within one root vanish.  The
    first round takes the numbers as they are, so stars around their least
    node and sorted paths fall together at once.  Every later round renames
    the live nodes by a new hash (of one long, so no two get the same name):
    only nodes whose new name is the least around them stay, half of them at
    most on average whatever the shape of the graph, so rounds grow with the
    logarithm of the largest component.  Everything is joins and aggregates with map-side
    combine, and every round is written to the shared folder; no edge reaches
    the driver.  Self-loops and nulls are ignored, repeated edges count once,
    the order of node numbers has no influence; no edges give an empty table."""
    live = cut_lineage(edges.select("u", "v").filter(F.col("u") != F.col("v"))
                       .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    labels = cut_lineage(live.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("label")), "cc-labels")
    turn = 0
    while not live.isEmpty():
        name = lambda c: (F.xxhash64(F.lit(turn), F.col(c)) if turn else F.col(c)).alias(c)  # noqa: E731, B023
        ends = live.select(name("u"), name("v"))
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-hook")
        while True:
            before, jumped = hook, hook.select("u", "m")
            for _ in range(2):
                up = jumped.select(F.col("u").alias("m"), F.col("m").alias("__up"))
                jumped = jumped.select("u", "m").join(up, "m").select("u", F.col("__up").alias("m"), (F.col("__up") != F.col("m")).alias("moved"))
            hook = cut_lineage(jumped, "cc-jump")
            drop_tables(before)
            if hook.filter("moved").isEmpty():
                break
        to = lambda c: hook.select(F.col("u").alias(c), F.col("m").alias(f"__{c}"))  # noqa: E731, B023
        done = live, labels, hook
        live = cut_lineage(ends.join(to("u"), "u").join(to("v"), "v").filter(F.col("__u") != F.col("__v"))
                           .select(F.least("__u", "__v").alias("u"), F.greatest("__u", "__v").alias("v")).distinct(), "cc-edges")
        labels = cut_lineage(labels.select("node", name("label")).join(to("label"), "label", "left")
                             .select("node", F.coalesce("__label", "label").alias("label")), "cc-labels")
        drop_tables(*done)
        turn += 1
    least = labels.groupBy("label").agg(F.min("node").alias("__least"))
    return labels.join(least, "label").select("node", F.col("__least").alias("label"))

