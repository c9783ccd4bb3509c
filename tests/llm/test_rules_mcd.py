"""The verdict against a plain numpy estimate with the same steps, groups and fallbacks."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from kestrel.llm import rules
from kestrel.llm.rules import CHI2_CUT, CHI2_MEDIAN, FLOORS, MIN_GROUP, STEPS, SUPPORT, quality_rules

from test_exact_rules import WORD, base

WORDS = [a + b for a in ("al", "be", "ga", "de") for b in ("pha", "tas", "mma", "lta", "ver", "nor", "sil", "tem")]


def corpus(sizes, seed=4):
    rnd, rows = random.Random(seed), []
    for (lang, source), n in sizes.items():
        for i in range(n):
            words = [rnd.choice(WORDS) + (rnd.choice("#$") if rnd.random() < 0.02 else "") for _ in range(rnd.randint(30, 90))]
            if i % 9 == 0:  # marks, long words or repeated lines
                words = [(w + "##", w * 3, w)[i // 9 % 3] for w in words]
            text = "\n".join(" ".join(words[k:k + 5]) for k in range(0, len(words), 5))
            rows.append((len(rows), text + "\nend here" * (i % 4 if i % 9 else 12), lang, source))
    return rows


def statistics(text):
    n, chars, marks, dup, again, _ = base(text)
    lines = len([x for x in text.split("\n") if WORD.search(x)])
    return [math.log(max(chars, 1) / max(n, 1)), *(math.log1p(100 * c / max(d, 1)) for c, d in ((marks, n), (dup, lines), (again, n)))]


def quantile(x, q):
    """The smallest value whose share of values up to it reaches q."""
    return np.sort(x, axis=0)[max(math.ceil(q * len(x)) - 1, 0)]


def estimate(x):
    floor = np.diag(np.square(FLOORS))
    mean = quantile(x, 0.5)
    cov = np.diag(np.square(1.4826 * quantile(np.abs(x - mean), 0.5))) + floor
    dist = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    for _ in range(STEPS):
        d = dist(mean, cov)
        near = x[d <= quantile(d, SUPPORT)]
        mean, cov = near.mean(0), np.cov(near.T, bias=True) + floor
    scale = max(quantile(dist(mean, cov), 0.5) / CHI2_MEDIAN, 1.0)
    return lambda y: (y - mean) @ np.linalg.inv(cov) @ (y - mean) / scale


def verdicts(rows):
    """doc_id -> squared distance, or None where there is no estimate."""
    ok = [(r, np.array(statistics(r[1]))) for r in rows if not base(r[1])[-1]]
    within = lambda f: np.array([s for r, s in ok if f(r)])
    out, made = {}, {}
    for r, s in ((r, np.array(statistics(r[1]))) for r in rows):
        for name, f in (((r[2], r[3]), lambda q: q[2:] == r[2:]), ((r[2],), lambda q: q[2] == r[2]), ((), lambda q: True)):
            if len(within(f)) >= MIN_GROUP:
                if name not in made:
                    made[name] = estimate(within(f))
                out[r[0]] = made[name](s)
                break
        else:
            out[r[0]] = None
    return out


SIZES = {("en", "web"): 150, ("en", "few"): 20, ("en", None): 12, ("fr", "a"): 35, ("fr", "b"): 40, ("it", "x"): 15, (None, None): 8, ("en", "none"): 0}


def check(spark, rows):
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()
    want = verdicts(rows)
    assert len(got) == len(rows)
    for r in got:
        d = want[r.doc_id]
        if d is None:
            assert r.distance2 is None and r.kept == (not r.base_failed)
            continue
        assert abs(r.distance2 - d) <= 1e-6 * max(1.0, d), (r.doc_id, r.distance2, d)
        assert r.kept == (not r.base_failed and d <= CHI2_CUT)
    return got


def test_verdicts_with_every_fallback(spark):
    rows = corpus(SIZES)
    got = check(spark, rows)
    by = {r.doc_id: r for r in got}
    for lang in ("en", "fr", "it"):  # small groups, small languages: outliers go everywhere
        assert any(not by[r[0]].kept and not by[r[0]].base_failed for r in rows if r[2] == lang and r[3] != "web")


def test_a_table_below_the_least_group_is_kept(spark):
    got = check(spark, corpus({("en", "a"): 20, ("fr", "b"): 15}))
    assert all(r.kept for r in got if not r.base_failed)


def test_salted_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(rules, "BROADCAST_BYTES", 0)
    check(spark, corpus(SIZES, seed=9))


def test_a_group_is_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(rules, "BROADCAST_BYTES", 0)
    rows = spark.range(64, numPartitions=16).select(F.lit("one").alias("g"), F.col("id").alias("x"))
    table = spark.createDataFrame([("one", 1)], "g string, v int")
    out = rules._with(rows, table, "g").groupBy("g").agg(F.sum("x").alias("x"))
    assert out.collect()[0].x == 2016
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "__salt" in plan
