"""R1 with stems: published word pairs, whole documents, BM25 over stems."""

import re
from collections import Counter

import __spark_entry__ as E
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from kestrel.functions.stemming import porter_stem, stem_terms
from kestrel.operators import retrieval as RT
from kestrel.operators.tokens import analyse

SF001 = "/root/testdata/sf0.001"
PAIRS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled
motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss
fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form
formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow
inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll generalizations gener oscillators oscil by by is is as as eed eed ing ing ion ion s s
syzygy syzygi yes ye été été 日本語 日本語 x86 x86""".split()


def test_published_pairs():
    for word, stem in zip(PAIRS[::2], PAIRS[1::2], strict=True):
        assert porter_stem(word) == stem, word


def test_arrays_with_nulls_and_empty(spark):
    rows = [(1, ["running", "cats", "running"]), (2, []), (3, None), (4, ["ponies", None])]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, t array<string>").coalesce(1).select("i", stem_terms(F.col("t")).alias("s")).collect()}
    assert got == {1: ["run", "cat", "run"], 2: [], 3: None, 4: ["poni", None]}


def test_possessive_goes_before_the_split(spark):
    df = spark.createDataFrame([("The dog's Ponies’s, dogs' it's 's-gravel",), (None,)], "text string")
    got = [r.s for r in df.coalesce(1).select(analyse("text", RT.STOPWORDS_EN, stem=True).alias("s")).collect()]
    assert got == [["dog", "poni", "dog", "gravel"], None]


def test_postings_of_whole_documents(spark):
    docs = pq.read_table(f"{SF001}/documents.parquet").to_pylist()
    want = Counter()
    for r in docs:
        text = re.sub(r"['’＇]s(?![^\W_])", "", (r["text"] or "").lower())
        words = [w for w in re.split(r"[\W_]+", text) if w and w not in RT.STOPWORDS_EN]
        want.update((r["doc_id"], porter_stem(w)) for w in words)
    got = E.queries()["R1_stemmed_terms"](spark, SF001)
    assert {(r.doc_id, r.term): r.tf for r in got.collect()} == want


def test_a_query_meets_other_forms(spark):
    docs = spark.createDataFrame([("t", 1, "Relational operators"), ("t", 2, "the weather"), ("t", 3, "related operations")], "task string, doc_id long, text string")
    qs = spark.createDataFrame([("t", 7, "relating an operation")], "task string, qid long, text string")
    hits = {}
    for stem in (False, True):
        d, q = RT.tokenize(docs, stem=stem), RT.tokenize(qs, stem=stem)
        post = RT.postings(d)
        w = RT.query_weights(q, post, RT.corpus_stats(d))
        hits[stem] = {r.doc_id for r in w.join(post, ["task", "term"]).collect()}
    assert hits == {False: set(), True: {1, 3}}
