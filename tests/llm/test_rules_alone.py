import math
import random

from kestrel.llm.rules import quality_rules

from test_exact_rules import base

WORDS = [a + b for a in ("al", "be", "ga", "de") for b in ("pha", "tas", "mma", "lta", "ver", "nor", "sil", "tem")]
SCHEMA = "doc_id long, text string, lang string, source string"


def verdicts(spark, rows):
    return {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_each_statistic_rejects_alone(spark):
    rnd = random.Random(3)
    line = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))

    def clean():
        return "\n".join(line(4) for _ in range(40))

    def lines():  # most lines are repeats, no 8 words are
        few = [line(2) for _ in range(30)]
        return "\n".join(rnd.choice(few) for _ in range(150))

    def words():  # 13 of 100 words come twice, no line does
        again = line(13)
        return "\n".join((line(37), again, line(37) + " " + again))

    def symbols():
        return "\n".join(line(3) + " *" + line(1) for _ in range(40))

    def length():
        return "\n".join(" ".join(rnd.choice(WORDS) * 2 for _ in range(4)) for _ in range(40))

    def slight():  # one line of 42 twice: too little to stand out
        return "\n".join([line(4) for _ in range(40)]) + "\n" + "end here\nend here"

    rows = [(i, clean(), "en", "s") for i in range(300)]
    kinds = (lines, words, symbols, length)
    for k, kind in enumerate(kinds, 1):
        rows += [(1000 * k + i, kind(), "en", "s") for i in range(5)]
    rows += [(9000 + i, slight(), "en", "s") for i in range(5)]
    for i, text, _, _ in rows:
        n, _, marks, dup, repeat, failed = base(text)
        assert not failed
        if 1000 <= i < 2000:
            assert dup > 0 and repeat == marks == 0
        if 2000 <= i < 3000:
            assert 25 < 100 * repeat / n <= 30 and dup == marks == 0
    got = verdicts(spark, rows)
    assert all(got[i] for i in range(300)) and all(got[9000 + i] for i in range(5))
    for k in range(1, len(kinds) + 1):
        assert not any(got[1000 * k + i] for i in range(5)), kinds[k - 1].__name__
    assert math.log1p(100) ** 2 < 23.513 and math.log1p(30) ** 2 < 23.513  # with floors of 1, neither could
