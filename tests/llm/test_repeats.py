import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kestrel.llm import jaccard, substring
from kestrel.llm.components import connected_components
from kestrel.llm.jaccard import similar_components
from kestrel.llm.recompression import parse, words_parse
from kestrel.llm.substring import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_components(spark):
    rnd = random.Random(4)
    nodes = [rnd.getrandbits(60) for _ in range(400)]
    edges = [(nodes[i], nodes[i + 1]) for i in range(150)] + [(nodes[200], nodes[k]) for k in range(201, 300)] + [(nodes[300], nodes[301]), (nodes[310], nodes[310])]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for own in (nodes[:151], nodes[200:300], nodes[300:302]):
        assert {got[n] for n in own} == {min(own)}
    assert len(got) == 151 + 100 + 2
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def grams(t):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def components(rows):
    sets = [grams(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in by[g] if j < i)
        for j, n in common.items():
            if 100 * n >= 90 * (len(s) + len(sets[j]) - n):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return Counter((r[0], len(sets[i]), min(least[find(i)], default=None) if sets[i] else r[0]) for i, r in enumerate(rows))


def near_copies(rnd, start):
    words = [f"v{i}" for i in range(3000)]
    rows = []
    for n, copies in ((120, 60), (40, 25), (400, 12), (9, 6)):
        base = [rnd.choice(words) for _ in range(n)]
        for _ in range(copies):
            own = base.copy()
            for _ in range(rnd.randint(0, max(1, n // 45))):
                own[rnd.randrange(n)] = rnd.choice(words)
            rows.append((start + len(rows), " ".join(own)))
    return rows


def answer(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("block,group,leaders", [(512, 2048, 16), (8, 6, 2)])
def test_jaccard_components(spark, docs, base_rows, no_docs, monkeypatch, block, group, leaders):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    rows = near_copies(random.Random(block), 5000) + [(r[0], r[1]) for r in base_rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert answer(similar_components(df)) == components(rows)
    if block == 512:
        assert answer(similar_components(docs)) == components(base_rows)
        assert similar_components(no_docs).count() == 0


def test_prefix_tree_finds_every_link():
    rnd = random.Random(8)
    t = jaccard.Threshold(90, 100)
    base = [sorted(rnd.sample(range(300), rnd.randint(20, 60))) for _ in range(8)]
    sets = []
    for _ in range(150):
        s = set(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            s ^= {rnd.randrange(300)}
        sets.append(np.array(sorted(s)))
    forest = jaccard.Forest(len(sets))
    tree = jaccard.PrefixTree(t, forest, 300)
    for k, s in enumerate(sets):
        tree.walk(k, s)
        tree.insert(k, s)
    want = jaccard.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if t.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                want.join(i, j)
    same = lambda f: {frozenset(i for i in range(len(sets)) if f.label[i] == x) for x in set(f.label)}
    assert same(forest) == same(want)


def kept(rows, width):
    docs = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i:i + width]) for w in docs for i in range(len(w) - width + 1))
    out = []
    for r, w in zip(rows, docs, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        text = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_substring_dedup(docs, base_rows, no_docs):
    assert result(remove_repeats(docs)) == kept(base_rows, 35)
    assert remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_substring_dedup_on_few_words(spark, seed, monkeypatch):
    """Small alphabets: runs, periods and chance repeats of every length."""
    from kestrel.llm import words
    monkeypatch.setattr(words, "BATCH_BYTES", 400)
    rnd = random.Random(seed)
    rows = []
    for i in range(120):
        kind = rnd.randrange(4)
        alphabet = "abcde"[:rnd.randint(1, 5)]
        n = rnd.randint(0, 90)
        text = " ".join(rnd.choice(alphabet) for _ in range(n)) if kind else " ".join(("a b c d e f g".split() * 20)[:n])
        if rows and kind == 3:
            other = (rnd.choice(rows)[1] or "").split(" ")
            a = rnd.randrange(len(other))
            text += " " + " ".join(other[a:a + rnd.randint(1, 60)])
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for width in (35, 13):
        assert result(remove_repeats(df, width)) == kept(rows, width)


def test_equal_passages_have_equal_inner_symbols():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 2 ** 62, 80).astype(np.uint64)
    parts = [np.concatenate([rng.integers(0, 2 ** 62, k).astype(np.uint64), passage, rng.integers(0, 2 ** 62, 9).astype(np.uint64)]) for k in (0, 7, 30)]
    p = parse(words_parse(np.concatenate(parts), np.array([len(x) for x in parts])), 0, 5)
    begin = np.cumsum([0] + [len(x) for x in parts[:-1]]) + np.array([0, 7, 30])
    inner = [{(int(n), int(s - b)) for n, s, lo, hi in zip(p.name, p.start, p.left, p.right, strict=True) if lo >= b and hi <= b + 80} for b in begin]
    assert inner[0] == inner[1] == inner[2] and len(inner[0]) > 5
    assert substring.WIDTH == 35


def test_blocks_that_share_a_name_are_told_apart(docs, base_rows, monkeypatch):
    """All blocks get one 64-bit name: only their second names say which are equal."""
    true_parse = substring.checks_and_blocks

    def one_name(names, counts, width):
        *rest, blocks = true_parse(names, counts, width)
        blocks.name = np.full(len(blocks.name), 7, np.uint64)
        return *rest, blocks

    monkeypatch.setattr(substring, "checks_and_blocks", one_name)
    assert result(remove_repeats(docs)) == kept(base_rows, 35)
    assert sum(n for _, _, n, _ in kept(base_rows, 35)) > 0
