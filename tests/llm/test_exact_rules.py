import hashlib
import re
from collections import Counter, defaultdict

from kestrel.llm import rules
from kestrel.llm.exact import CHUNK_PATTERN, assign, exact_dedup, keep_first, recipes
from kestrel.llm.rules import keep_good, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup_against_brute_force(docs, base_rows):
    got = exact_dedup(docs).collect()
    groups = defaultdict(list)
    for r in base_rows:
        groups[norm(r[1])].append(r[0])
    want = Counter()
    for r in base_rows:
        own = groups[norm(r[1])]
        ids = [i for i in own if i is not None]
        want[(r[0], min(ids) if ids else None, len(own), hashlib.sha256(norm(r[1]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_keeps_one_row_with_its_columns(docs, base_rows):
    left = keep_first(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert len({norm(r.text) for r in rows}) == len(rows) == len({norm(r[1]) for r in base_rows})


def test_disputed_chunk_is_settled_by_the_whole_text(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alpha")], "doc_id long, text string")
    table = recipes(docs).withColumn("__recipe", recipes(docs).select("__recipe").schema["__recipe"] and __import__("pyspark").sql.functions.expr("array(5L)"))
    bad = spark.createDataFrame([(5,)], "__chunk_id long")
    got = {r.doc_id: (r.keep_id, r.kept) for r in assign(table, bad).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)}


def test_chunks_rebuild_the_text():
    text = norm("Some words, and more. " * 2000 + "x" * 20_000 + "é日 " * 50)
    parts = re.findall(CHUNK_PATTERN, text)
    assert "".join(parts) == text and max(map(len, parts)) <= 8194


def base(t):
    words = WORD.findall(t or "")
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), failed


def test_rules_base_counts(docs, base_rows):
    got = quality_rules(docs).collect()
    want = Counter((r[0], *base(r[1])) for r in base_rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def test_rules_reject_outliers_and_keep_clean(spark):
    import random
    rnd = random.Random(1)
    words = ["alpha", "beta", "of", "gamma", "the", "delta", "in", "epsilon"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(80)), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(rnd.choice(words) + "###" for _ in range(80)), "en", "s") for i in range(20)]
    rows += [(2000 + i, " ".join(rnd.choice(words) for _ in range(80)), "fr", f"few{i}") for i in range(5)]
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(20))
    assert all(got[2000 + i] for i in range(5))  # a pool too small to judge


def test_rules_keep_columns_and_empty_tables(docs, no_docs):
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    good = Counter(r.doc_id for r in quality_rules(docs).filter("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == good
    assert quality_rules(no_docs).count() == keep_good(no_docs).count() == 0
    assert exact_dedup(no_docs).count() == keep_first(no_docs).count() == 0
    assert rules.CHI2_CUT > 20
