"""Rounds of connected_components on shapes with sorted numbers, and op8 on one large group of near copies."""

import random
import time

import numpy as np
import pytest

from kestrel.llm import components, jaccard
from kestrel.llm.components import connected_components
from kestrel.llm.jaccard import similar_components

SHAPES = {
    "sorted path": [(i, i + 1) for i in range(600)],
    "star at the least": [(0, i) for i in range(1, 600)],
    "star at the largest": [(i, 10_000) for i in range(600)],
    "grid": [(30 * i + j, 30 * i + j + d) for i in range(30) for j in range(30) for d in (1, 30) if (d == 30 and i < 29) or (d == 1 and j < 29)],
    "comb": [(i, i + 1) for i in range(300)] + [(i, 10_000 + i) for i in range(300)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_few_rounds(spark, monkeypatch, shape):
    names = []
    real = components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df, name, *a: (names.append(name), real(df, name, *a))[1])
    edges = SHAPES[shape] + [(-5, -4), (None, 3), (7, 7)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()}
    nodes = {x for e in SHAPES[shape] for x in e}
    assert got == {n: min(nodes) for n in nodes} | {-5: -5, -4: -5}
    assert names.count("cc-hook") <= 12  # 600 nodes: halved on average
    assert names.count("cc-jump") <= 24


def test_large_group_of_near_copies(spark):
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(3000):
        own = base.copy()
        own[rnd.randrange(90)] = f"x{rnd.randrange(500)}"
        rows.append((i, " ".join(own)))
    t = time.time()
    got = similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 3000
    assert time.time() - t < 240


def test_sets_that_share_a_name(spark, monkeypatch):
    real = jaccard.set_names
    rows = [(i, f"a{i % 40} b c d e f g{i % 40} h i") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(tuple(r) for r in similar_components(df).collect())
    monkeypatch.setattr(jaccard, "set_names", lambda g, s: (real(g, s)[0] % np.uint64(3), real(g, s)[1]))
    assert sorted(tuple(r) for r in similar_components(df).collect()) == want
    assert {r[2] for r in want} == set(range(40))
