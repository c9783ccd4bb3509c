import re
from collections import Counter, defaultdict

import corpus_pipeline as c
from kestrel.session import cut_lineage

from test_exact_rules import norm
from test_repeats import LOWER, WORD


def near_components(rows, size=5, num=80, den=100):
    """Ids and the least id of their component: 5-word shingles, 0.8 or more."""
    def shingles(text):
        w = WORD.findall((text or "").translate(LOWER))
        return frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets, up, by = [shingles(t) for _, t in rows], list(range(len(rows))), defaultdict(list)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in by[g]).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                up[find(i)] = find(j)
        for g in s:
            by[g].append(i)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def test_stages_in_order():
    assert [n for n, _ in c.STAGES] == ["quality_rules", "exact_dedup", "ngram_jaccard", "pseudonyms", "best_fit_packing"]


def test_each_stage_takes_effect(spark, docs, no_docs):
    d = docs
    out = {}
    for name, stage in c.STAGES:
        before, d = d, cut_lineage(stage(spark, d, ""), "test")
        out[name] = d.collect()
        if name != "best_fit_packing":
            assert d.columns == before.columns
    assert 0 < len(out["quality_rules"]) < docs.count()
    left = out["exact_dedup"]
    assert len(left) == len({norm(r.text) for r in left}) == len({norm(r.text) for r in out["quality_rules"]})
    keep = {i for i, k in near_components([(r.doc_id, r.text) for r in left]) if i == k}
    assert Counter(r.doc_id for r in out["ngram_jaccard"]) == Counter(r.doc_id for r in left if r.doc_id in keep)
    assert len(out["pseudonyms"]) == len(out["ngram_jaccard"])
    old = {(r.doc_id, r.n_chars): r.text for r in out["ngram_jaccard"]}
    mails = [m for t in old.values() for m in re.findall(r"[\w.]+@mail\d", t or "")]
    text = " ".join(r.text or "" for r in out["pseudonyms"])
    assert not any(m in text for m in mails)
    ends = defaultdict(int)
    for r in out["best_fit_packing"]:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048
    assert {r.doc_id for r in out["best_fit_packing"]} == {r.doc_id for r in out["pseudonyms"]}
    for _, stage in c.STAGES:
        assert stage(spark, no_docs, "").count() == 0


def test_run_equals_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in c.STAGES:
        d = cut_lineage(stage(spark, d, sf), "test")
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, c.run(spark, sf).collect())) == sorted(map(key, d.collect()))
