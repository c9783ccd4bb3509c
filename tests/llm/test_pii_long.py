from pyspark.sql import functions as F

from kestrel.llm.pii import Feistel

from test_pii import run


def test_long_names_change_in_every_block(spark):
    names = ["abcdefghij" * 6, "abcdefghij" * 5 + "abcdefghia", "b" + "abcdefghij" * 5 + "bcdefghij"]
    got = [t for t, _ in run(spark, [n + "@mail.example.com" for n in names])]
    new = [t.split("@")[0] for t in got]
    for n, m in zip(names, new, strict=True):
        assert len(n) == len(m) and all(n[a:a + 22] != m[a:a + 22] for a in (0, 22, 44))
    assert len({m[:22] for m in new}) == len({m[44:] for m in new}) == 3  # each block follows the others


def test_long_text_is_a_permutation(spark):
    f = Feistel("key")
    text = F.concat(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("7" * 28), F.lpad((F.col("id") * 7 % 1000).cast("string"), 3, "0"))
    got = [r.y for r in spark.range(1000).select(f.text("t", text, "0123456789").alias("y")).collect()]
    assert len(set(got)) == 1000 and {len(y) for y in got} == {34}


def test_iban_letters_change(spark):
    (text, n), = run(spark, ["GB82 WEST 1234 5698 7654 32"])
    letters = text.split(" ")[1]
    assert n == 1 and letters != "WEST" and letters.isalpha() and letters.isupper()
    assert int("".join(str(int(c, 36)) for c in (text[4:] + text[:4]).replace(" ", ""))) % 97 == 1
