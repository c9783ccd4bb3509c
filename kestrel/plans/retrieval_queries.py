"""Registered retrieval queries (R*, T1) over documents / benchmark / embeddings.

Corpus = ``documents``, queries = ``benchmark`` passages, relevance =
``fx_qrels`` (passages found inside documents), exclusions = ``fx_excluded``.
Dense retrieval uses ``embeddings`` with same-label vectors as relevant.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import retrieval as RT
from kestrel.sources.tables import FIXTURES, fixture, read_table

Q: dict = {}
K1, B = 0.9, 0.4
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in RT.STOPWORDS_EN) + "]"


def tok_sql(expr: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower({expr}), '[^\\p{{L}}\\p{{N}}]+'), "
            f"lambda x: x <> '' AND NOT list_contains({STOP_SQL}, x))")


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


# ------------------------------------------------------------ Spark inputs

def corpus(spark, sf, tasks: int = 1):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    task = F.concat(F.lit("t"), (F.col("doc_id") % tasks).cast("string"))
    return RT.tokenize(d.withColumn("task", task))


def bench_queries(spark, sf, tasks: int = 1, text="text"):
    q = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col(text).alias("text"))
    task = F.concat(F.lit("t"), (F.col("qid") % tasks).cast("string"))
    return RT.tokenize(q.withColumn("task", task))


def bm25_pipeline(spark, sf, queries=None, tasks: int = 1):
    from kestrel.session import cut_lineage
    docs = corpus(spark, sf, tasks)
    # the postings table is the index: materialised once in the shared folder
    post = cut_lineage(RT.postings(docs))
    stats = RT.corpus_stats_from_postings(post, docs.select("task", "doc_id"))
    queries = queries if queries is not None else bench_queries(spark, sf, tasks)
    qw = RT.query_weights(queries, post, stats, k1=K1, b=B)
    scores = RT.bm25_scores(qw, post, k1=K1, b=B, query_rows=RT.query_term_rows(queries)) \
        .withColumn("score", F.round("score", 9))
    return docs.select("task", "doc_id"), queries, scores


def bm25_hits(spark, sf, ex, queries=None, tasks: int = 1, k: int = 1000):
    """Documents, queries, and the scores of all that can be among a query's first ``k``."""
    from kestrel.session import cut_lineage
    docs = corpus(spark, sf, tasks)
    post = cut_lineage(RT.postings(docs))
    stats = cut_lineage(RT.corpus_stats_from_postings(post, docs.select("task", "doc_id")))
    queries = queries if queries is not None else bench_queries(spark, sf, tasks)
    qw = RT.query_weights(queries, post, stats, k1=K1, b=B)
    index = RT.impact_postings(post, stats, K1, B)  # two columns more on the written postings
    scores = RT.bm25_top_k(qw, index, ex, k, query_rows=RT.query_term_rows(queries), order="doc_id")
    return docs.select("task", "doc_id"), queries, scores.withColumn("score", F.round("score", 9))


def excluded(spark, sf):
    return fixture(spark, sf, "fx_excluded")


def written_excluded(spark, sf):
    """The exclusions of a run, which reads them several times; their text is read once."""
    from kestrel.session import cut_lineage
    return cut_lineage(excluded(spark, sf), "excluded")


KEY_CHARS = 4  # of a short passage's key
PASSAGE_CHARS = 16 << 20  # of all passages together, to be sent to the documents


def char_grams(text: str, n: int):
    """Distinct runs of ``n`` characters of a text, in one pass over them."""
    if n == 0:
        return F.when(F.col(text).isNotNull(), F.array(F.lit("")))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    grams = chars
    for k in range(1, n):  # shorter by one each time: the last place has no next character
        rest = F.slice(chars, F.lit(k + 1), F.greatest(F.size(chars) - k, F.lit(0)))
        grams = F.zip_with(F.slice(grams, F.lit(1), F.size(rest)), rest, lambda a, b: F.concat(a, b))
    return F.array_distinct(grams)


def qrels(spark, sf):
    """fx_qrels (benchmark passages found inside documents) without a
    nested-loop join: a passage contained in a document has each of its
    interior space-delimited words as a whole word of that document, so an
    equi-join on the passage's longest interior word gives exact candidates,
    verified with ``contains``.  Passages of PASSAGE_CHARS in all are sent to
    the documents, which stay where they are; more are joined by word first and
    meet the text after that.  Passages of fewer than three words are found
    the same way by their first KEY_CHARS characters (all, if fewer) among the
    character n-grams of the documents; an empty passage is in every document."""
    b = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("ptext"))
    d = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("dtext"))
    toks = F.split("ptext", " ")
    interior = F.slice(toks, 2, F.greatest(F.size(toks) - 2, F.lit(1)))
    anchor = F.element_at(F.array_sort(F.transform(interior, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    anchors = b.filter(F.size(toks) >= 3).select("qid", "ptext", anchor.alias("word"))
    words = d.select("doc_id", "dtext", F.explode(F.array_distinct(F.split("dtext", " "))).alias("word"))
    if (anchors.agg(F.sum(F.length("ptext"))).first()[0] or 0) <= PASSAGE_CHARS:
        hits = words.join(F.broadcast(anchors), "word")
    else:
        cand = words.drop("dtext").join(RT.bounded_broadcast(anchors.drop("ptext")), "word").select("qid", "doc_id").distinct()
        hits = cand.join(b, "qid").join(d, "doc_id")
    hits = hits.filter(F.col("dtext").contains(F.col("ptext"))).select("qid", "doc_id")
    short = b.filter(F.size(toks) < 3).withColumn("n", F.least(F.length("ptext"), F.lit(KEY_CHARS)))
    for n in sorted(r["n"] for r in short.select("n").distinct().collect()):  # at most KEY_CHARS + 1 lengths
        keys = short.filter(F.col("n") == n).select("qid", "ptext", F.substring("ptext", 1, n).alias("key"))
        found = d.select("doc_id", "dtext", F.explode(char_grams("dtext", n)).alias("key")).join(keys, "key")
        hits = hits.unionByName(found.filter(F.col("dtext").contains(F.col("ptext"))).select("qid", "doc_id"))
    return hits.select("qid", "doc_id", F.lit(1).alias("rel"))


def written_qrels(spark, sf):
    """The judgments of an evaluation, which reads them twice; the documents are searched once."""
    from kestrel.session import cut_lineage
    return cut_lineage(qrels(spark, sf), "qrels")


# ------------------------------------------------------------ DuckDB twins

def bm25_sql(tasks: int = 1, query_source: str = "SELECT item_id AS qid, text FROM benchmark",
             qrels_source: str | None = None, excluded_source: str | None = None) -> str:
    dtask = f"'t' || CAST(doc_id % {tasks} AS VARCHAR)"
    qtask = f"'t' || CAST(qid % {tasks} AS VARCHAR)"
    qrels_source = qrels_source or FIXTURES["fx_qrels"]
    excluded_source = excluded_source or FIXTURES["fx_excluded"]
    return f"""
fx_qrels AS ({qrels_source}),
fx_excluded AS ({excluded_source}),
d AS (SELECT doc_id, {dtask} AS task, {tok_sql('text')} AS tokens,
             row_number() OVER (PARTITION BY {dtask} ORDER BY doc_id) - 1 AS doc_order FROM documents),
q AS (SELECT qid, {qtask} AS task, {tok_sql('text')} AS tokens FROM ({query_source}) qs),
st AS (SELECT task, count(*) AS n_docs, sum(len(tokens)) / count(*) AS avgdl FROM d GROUP BY task),
p AS (SELECT task, term, doc_id, count(*) AS tf, any_value(dl) AS dl
      FROM (SELECT task, doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM d) x GROUP BY task, term, doc_id),
qt AS (SELECT task, qid, term, count(*) AS tfq FROM (SELECT task, qid, unnest(tokens) AS term FROM q) x GROUP BY ALL),
dfs AS (SELECT p.task, p.term, count(*) AS df FROM p JOIN (SELECT DISTINCT task, term FROM qt) u USING (task, term) GROUP BY ALL),
kn AS (SELECT qt.*, dfs.df FROM qt JOIN dfs USING (task, term)),
ql AS (SELECT task, qid, sum(tfq) AS ql FROM kn GROUP BY task, qid),
qw AS (SELECT kn.task, kn.qid, kn.term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf,
              ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tfq / (tfq + {K1} * (1 - {B} + {B} * ql / avgdl)) AS wq, avgdl
       FROM kn JOIN ql USING (task, qid) JOIN st USING (task)),
sc AS (SELECT qw.task, qid, doc_id, round(sum(wq * idf * tf / (tf + {K1} * (1 - {B} + {B} * dl / avgdl))), 9) AS score
       FROM qw JOIN p USING (task, term) GROUP BY ALL),
ex AS (SELECT sc.*, d.doc_order FROM sc JOIN d USING (task, doc_id)
       WHERE NOT EXISTS (SELECT 1 FROM fx_excluded e WHERE e.qid = sc.qid AND e.doc_id = sc.doc_id)),
hits AS (SELECT task, qid, doc_id, score, doc_order,
                row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_order ASC) AS rank FROM ex WHERE score > 0
         QUALIFY rank <= 1000),
blocked AS (SELECT qid, doc_id FROM hits UNION SELECT qid, doc_id FROM fx_excluded),
nq AS (SELECT q.task, q.qid, (SELECT count(*) FROM hits h WHERE h.qid = q.qid) AS n_pos FROM q),
zero AS (SELECT nq.task, nq.qid, d.doc_id, 0.0 AS score, d.doc_order,
                n_pos + row_number() OVER (PARTITION BY nq.qid ORDER BY d.doc_order) AS rank, n_pos
         FROM nq JOIN d ON d.task = nq.task
         WHERE n_pos < 1000 AND NOT EXISTS (SELECT 1 FROM blocked bl WHERE bl.qid = nq.qid AND bl.doc_id = d.doc_id)
         QUALIFY rank <= 1000),
run AS (SELECT task, qid, doc_id, score, doc_order, rank FROM hits
        UNION ALL SELECT task, qid, doc_id, score, doc_order, rank FROM zero),
er AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CAST(doc_id AS VARCHAR) DESC) AS erank FROM run),
dcg AS (SELECT er.qid, sum(rel / log2(erank + 1)) AS dcg FROM er JOIN fx_qrels USING (qid, doc_id) WHERE erank <= 10 AND rel > 0 GROUP BY er.qid),
idcg AS (SELECT qid, sum(rel / log2(i + 1)) AS idcg
         FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS i FROM fx_qrels WHERE rel > 0) x
         WHERE i <= 10 GROUP BY qid),
nd AS (SELECT idcg.qid, coalesce(dcg, 0) / idcg AS ndcg FROM idcg LEFT JOIN dcg USING (qid))
"""


def reg(name, sql=None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


@reg("R1_analyze", f"""
SELECT doc_id, CAST(len({tok_sql('text')}) AS INT) AS n_tokens, CAST(len(list_distinct({tok_sql('text')})) AS INT) AS n_distinct
FROM documents""")
def r1(spark, sf):
    d = RT.tokenize(read_table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"))


@reg("R1_stemmed_terms")
def r1_stemmed(spark, sf):
    d = RT.tokenize(read_table(spark, sf, "documents").select("doc_id", "text"), stem=True).withColumn("task", F.lit("t0"))
    return RT.postings(d).select("doc_id", "term", "tf", "dl")


@reg("R2_corpus_stats", "WITH " + bm25_sql().strip().rstrip(",") + """
SELECT count(*) AS n_docs, round(avg(len(tokens)), 6) AS avgdl,
       (SELECT count(DISTINCT term) FROM p) AS vocab_size FROM d""")
def r2(spark, sf):
    docs = corpus(spark, sf)
    st = RT.corpus_stats(docs)
    vocab = RT.postings(docs).groupBy("task").agg(F.countDistinct("term").alias("vocab_size"))
    return st.join(vocab, "task").select(
        "n_docs", r6(F.col("avgdl")).alias("avgdl"), "vocab_size")


@reg("T1_dictionary_bow", "WITH " + bm25_sql().strip().rstrip(",") + """,
voc AS (SELECT term, count(*) AS df, row_number() OVER (ORDER BY term) - 1 AS term_id FROM p GROUP BY term)
SELECT p.doc_id, voc.term_id, CAST(p.tf AS BIGINT) AS tf, voc.df FROM p JOIN voc USING (term)""")
def t1(spark, sf):
    from kestrel.operators.tokens import dictionary_from_postings, join_terms
    from kestrel.session import cut_lineage
    post = cut_lineage(RT.postings(corpus(spark, sf)))
    voc = cut_lineage(dictionary_from_postings(post.select("term", "doc_id")).select("term", "term_id", "df"), "terms")
    return join_terms(post, voc).select(
        "doc_id", "term_id", F.col("tf").cast("bigint").alias("tf"), "df")


@reg("R3_document_weights", "WITH " + bm25_sql().strip().rstrip(",") + f""",
adf AS (SELECT task, term, count(*) AS df FROM p GROUP BY task, term)
SELECT doc_id, term, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + {K1} * (1 - {B} + {B} * dl / avgdl)), 6) + 0.0 AS w
FROM p JOIN adf USING (task, term) JOIN st USING (task)""")
def r3(spark, sf):
    from kestrel.session import cut_lineage
    docs = corpus(spark, sf)
    post = cut_lineage(RT.postings(docs))  # read for the frequencies, the lengths and the weights
    stats = RT.corpus_stats_from_postings(post, docs.select("task", "doc_id"))
    w = RT.document_weights(post, stats, RT.document_frequency(post), K1, B)
    return w.select("doc_id", "term", r6(F.col("w")).alias("w"))


@reg("R4_bm25_scores", "WITH " + bm25_sql().strip().rstrip(",") + """
SELECT qid, doc_id, round(score, 6) + 0.0 AS score FROM sc""")
def r4(spark, sf):
    _, _, s = bm25_pipeline(spark, sf)
    return s.select("qid", "doc_id", r6(F.col("score")).alias("score"))


@reg("R5_exclude", "WITH " + bm25_sql().strip().rstrip(",") + """
SELECT qid, count(*) AS n_scored, round(sum(score), 6) + 0.0 AS score_sum FROM ex GROUP BY qid""")
def r5(spark, sf):
    _, _, s = bm25_pipeline(spark, sf)
    e = RT.exclude(s, excluded(spark, sf))
    return e.groupBy("qid").agg(F.count(F.lit(1)).alias("n_scored"), r6(F.sum("score")).alias("score_sum"))


@reg("R6_top1000_run", "WITH " + bm25_sql().strip().rstrip(",") + """
SELECT qid, doc_id, CAST(rank AS INT) AS rank, round(score, 6) + 0.0 AS score FROM run""")
def r6_run(spark, sf):
    ex = written_excluded(spark, sf)
    docs, qs, s = bm25_hits(spark, sf, ex)
    run = RT.ranked_run(s, qs, ex, docs, 1000)
    return run.select("qid", "doc_id", "rank", r6(F.col("score")).alias("score"))


@reg("R11_ndcg10", "WITH " + bm25_sql().strip().rstrip(",") + """
SELECT qid, round(ndcg, 6) + 0.0 AS ndcg FROM nd""")
def r11(spark, sf):
    ex = written_excluded(spark, sf)
    docs, qs, s = bm25_hits(spark, sf, ex)
    run = RT.ranked_run(s, qs, ex, docs, 1000)
    nd = RT.ndcg_at_k(run, written_qrels(spark, sf), 10)
    return nd.select("qid", r6(F.col("ndcg")).alias("ndcg"))


@reg("R16_task_routing", "WITH " + bm25_sql(tasks=2).strip().rstrip(",") + """
SELECT qid, round(ndcg, 6) + 0.0 AS ndcg FROM nd""")
def r16(spark, sf):
    ex = written_excluded(spark, sf)
    docs, qs, s = bm25_hits(spark, sf, ex, tasks=2)
    run = RT.ranked_run(s, qs, ex, docs, 1000)
    nd = RT.ndcg_at_k(run, written_qrels(spark, sf), 10)
    return nd.select("qid", r6(F.col("ndcg")).alias("ndcg"))


@reg("R10_qrels_json", f"""
WITH fx_qrels AS ({FIXTURES['fx_qrels']}),
g AS (SELECT qid, to_json({{'qrels': map_from_entries([(CAST(qid AS VARCHAR),
                  map_from_entries(list((CAST(doc_id AS VARCHAR), rel))))])}}) AS ground_truth FROM fx_qrels GROUP BY qid)
SELECT qid AS rollout_id, CAST(qid AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS doc_id, CAST(rel AS INT) AS rel FROM fx_qrels""")
def r10(spark, sf):
    qr = qrels(spark, sf)
    inner = F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), F.col("rel").cast("int"))))
    gt = qr.groupBy("qid").agg(F.to_json(F.struct(F.create_map(F.col("qid").cast("string"), inner).alias("qrels")))
                                .alias("ground_truth"))
    return RT.qrels_from_json(gt.withColumnRenamed("qid", "rollout_id"))


# BM25 reward (R12): rollouts = one per benchmark item and variant; each
# rollout is a query of its own, judged with its item's qrels.
ROLLOUTS_SQL = """
SELECT item_id * 2 + v AS rollout_id, item_id AS qid,
       CASE WHEN v = 0 THEN CONCAT('User: q Assistant: <think>t</think><query>', text, '</query>')
            ELSE CONCAT('Assistant: ', text) END AS response
FROM (SELECT item_id, text, unnest([0, 1]) AS v FROM benchmark) b"""

R12_QUERIES = f"""
SELECT rollout_id AS qid, CASE WHEN strpos(response, '<query>') > 0
     THEN regexp_extract_all(substr(response, strpos(response, 'Assistant:') + 10), '(?s)<query>(.*?)</query>', 1)[-1]
     ELSE substr(response, strpos(response, 'Assistant:') + 10) END AS text FROM ({ROLLOUTS_SQL}) r0"""
R12_QRELS = f"""
SELECT ro.rollout_id AS qid, x.doc_id, x.rel FROM ({ROLLOUTS_SQL}) ro JOIN ({FIXTURES['fx_qrels']}) x ON x.qid = ro.qid"""
R12_EXCLUDED = f"""
SELECT ro.rollout_id AS qid, x.doc_id FROM ({ROLLOUTS_SQL}) ro JOIN ({FIXTURES['fx_excluded']}) x ON x.qid = ro.qid"""


def _retrieval_rollouts(spark, sf):
    b = read_table(spark, sf, "benchmark").select("item_id", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    return b.select((F.col("item_id") * 2 + F.col("v")).alias("rollout_id"), F.col("item_id").alias("qid"),
                    F.when(F.col("v") == 0, F.concat(F.lit("User: q Assistant: <think>t</think><query>"),
                                                     F.col("text"), F.lit("</query>")))
                     .otherwise(F.concat(F.lit("Assistant: "), F.col("text"))).alias("response"))


@reg("R12_bm25_reward", "WITH " + bm25_sql(query_source=R12_QUERIES, qrels_source=R12_QRELS,
                                           excluded_source=R12_EXCLUDED).strip().rstrip(",") + f""",
ro AS ({ROLLOUTS_SQL}),
fmt AS (SELECT rollout_id,
          (length(p) - length(replace(p, '<think>', ''))) // 7 = 1 AND (length(p) - length(replace(p, '</think>', ''))) // 8 = 1
          AND (length(p) - length(replace(p, '<query>', ''))) // 7 = 1 AND (length(p) - length(replace(p, '</query>', ''))) // 8 = 1
          AND strpos(p, '<think>') <= strpos(p, '</think>') AND strpos(p, '</think>') <= strpos(p, '<query>')
          AND strpos(p, '<query>') <= strpos(p, '</query>') AS ok
        FROM (SELECT rollout_id, substr(response, strpos(response, 'Assistant:') + 10) AS p FROM ro) x)
SELECT ro.rollout_id, round(nd.ndcg + CASE WHEN ok THEN 1.0 ELSE -1.0 END, 6) + 0.0 AS reward
FROM ro JOIN fmt USING (rollout_id) JOIN nd ON nd.qid = ro.rollout_id""")
def r12(spark, sf):
    docs = corpus(spark, sf)
    ro = _retrieval_rollouts(spark, sf).withColumn("task", F.lit("t0"))
    out = RT.bm25_rewards(ro, docs, written_qrels(spark, sf), excluded(spark, sf), k1=K1, b=B)
    return out.select("rollout_id", r6(F.col("reward")).alias("reward"))


# ------------------------------------------------------------------ dense

def dense_inputs(spark, sf):
    e = read_table(spark, sf, "embeddings")
    qs = e.filter(F.col("vec_id") % 10 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"),
                                                    F.col("label").alias("qlabel"), F.lit("all").alias("task"))
    docs = e.filter(F.col("vec_id") % 10 != 0).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"),
                                                      "label", F.lit("all").alias("task"))
    qrels_d = qs.join(docs.select("doc_id", F.col("label").alias("qlabel")), "qlabel") \
        .select("qid", "doc_id", F.lit(1).alias("rel"))
    # a query excludes the documents of its remainder: one list per remainder, shared by its queries
    excl = docs.select((F.col("doc_id") % 37).alias("exclusion_list"), "doc_id")
    return qs.withColumn("exclusion_list", F.col("qid") % 37), docs, qrels_d, excl


DENSE_SQL = """
qs AS (SELECT vec_id AS qid, embedding AS vec, label AS qlabel, 'all' AS task FROM embeddings WHERE vec_id % 10 = 0),
ds AS (SELECT vec_id AS doc_id, embedding AS vec, label, 'all' AS task,
              row_number() OVER (ORDER BY vec_id) - 1 AS doc_order FROM embeddings WHERE vec_id % 10 <> 0),
qr AS (SELECT qid, doc_id, 1 AS rel FROM qs JOIN ds ON ds.label = qs.qlabel),
exd AS (SELECT qid, doc_id FROM qs JOIN ds ON ds.doc_id % 37 = qs.qid % 37),
sc AS (SELECT qid, doc_id, doc_order, round(list_cosine_similarity(list_transform(qs.vec, lambda x: CAST(x AS DOUBLE)),
                                                 list_transform(ds.vec, lambda x: CAST(x AS DOUBLE))), 9) AS score
       FROM qs JOIN ds ON qs.task = ds.task
       WHERE NOT EXISTS (SELECT 1 FROM exd WHERE exd.qid = qs.qid AND exd.doc_id = ds.doc_id)),
run AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_order) AS rank FROM sc QUALIFY rank <= 1000),
er AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CAST(doc_id AS VARCHAR) DESC) AS erank FROM run),
dcg AS (SELECT er.qid, sum(rel / log2(erank + 1)) AS dcg FROM er JOIN qr USING (qid, doc_id) WHERE erank <= 10 GROUP BY er.qid),
idcg AS (SELECT qid, sum(rel / log2(i + 1)) AS idcg
         FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS i FROM qr) x WHERE i <= 10 GROUP BY qid),
nd AS (SELECT idcg.qid, coalesce(dcg, 0) / idcg AS ndcg FROM idcg LEFT JOIN dcg USING (qid))
"""


def _dense_run(spark, sf, qs=None):
    q0, docs, qrels_d, excl = dense_inputs(spark, sf)
    qs = q0 if qs is None else qs
    s = RT.dense_run(qs, docs, excl, 1000, exclusion_list="exclusion_list")
    s = s.withColumn("score", F.round("score", 9)).withColumn("task", F.lit("all"))
    return RT.top_k(s, 1000), qrels_d


@reg("R8_l2_normalize", """
SELECT vec_id, CAST(i - 1 AS INT) AS i, round(x, 6) + 0.0 AS x
FROM (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS i,
             unnest(list_transform(embedding, lambda v: CAST(v AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))) AS x
      FROM embeddings) z""")
def r8(spark, sf):
    e = read_table(spark, sf, "embeddings").withColumn("u", RT.l2_normalize("embedding"))
    return e.select("vec_id", F.posexplode("u").alias("i", "x")).select(
        "vec_id", F.col("i").cast("int").alias("i"), r6(F.col("x")).alias("x"))


@reg("R9_dense_top10", "WITH " + DENSE_SQL.strip() + """
SELECT qid, doc_id, CAST(rank AS INT) AS rank, round(score, 6) + 0.0 AS score FROM run WHERE rank <= 10""")
def r9(spark, sf):
    run, _ = _dense_run(spark, sf)
    return run.filter(F.col("rank") <= 10).select("qid", "doc_id", "rank", r6(F.col("score")).alias("score"))


@reg("R9_dense_run", "WITH " + DENSE_SQL.strip() + """
SELECT qid, doc_id, CAST(rank AS INT) AS rank FROM run""")
def r9_run(spark, sf):
    run, _ = _dense_run(spark, sf)
    return run.select("qid", "doc_id", "rank")


# Dense rewards from text (R13, R14): rollouts of every benchmark item, each
# encoded (R7) and searched among the encoded documents.
CHAT_SQL = """
SELECT item_id * 3 + v AS rollout_id, item_id AS qid,
       CASE v WHEN 0 THEN CONCAT('<|im_start|>user q<|im_end|><|im_start|>assistant', text) WHEN 1 THEN text ELSE 'nothing of it' END AS response
FROM (SELECT item_id, text, unnest([0, 1, 2]) AS v FROM benchmark) b"""
GATED_SQL = """
SELECT item_id * 3 + v AS rollout_id, item_id AS qid,
       CASE v WHEN 0 THEN CONCAT('User: q Assistant: <think>t</think><query>', text, '</query>')
              WHEN 1 THEN CONCAT('Assistant: <think>', text, '</think><query>zz</query>') ELSE CONCAT('Assistant: ', text) END AS response
FROM (SELECT item_id, text, unnest([0, 1, 2]) AS v FROM benchmark) b"""


def bow_sql(name: str, rows: str, key: str) -> str:
    """Bucket counts of the default encoder, as CTE ``name`` (key, b, n, norm)."""
    return f"""
{name}_w AS (SELECT {key}, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')) AS w FROM {rows}),
{name}_c AS (SELECT {key}, CAST('0x' || substr(md5('0:' || w), 1, 7) AS BIGINT) % 64 AS b, CAST(count(*) AS DOUBLE) AS n FROM {name}_w GROUP BY ALL),
{name} AS (SELECT {key}, b, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM {name}_c)"""


def text_ndcg_sql(name: str, texts: str) -> str:
    """nDCG@10 of the dense run of (rollout_id, qid, text) as CTE ``name`` (rollout_id, ndcg)."""
    return f"""{bow_sql(name + '_q', texts, 'rollout_id')},
{name}_s AS (SELECT q.rollout_id, q.qid, d.doc_id, round(coalesce(sc.score, 0), 9) AS score
       FROM {texts} q CROSS JOIN documents d
       LEFT JOIN (SELECT rollout_id, doc_id, sum({name}_q.x * dv.x) AS score FROM {name}_q JOIN dv ON dv.b = {name}_q.b GROUP BY ALL) sc
         ON sc.rollout_id = q.rollout_id AND sc.doc_id = d.doc_id
       WHERE NOT EXISTS (SELECT 1 FROM fx_excluded e WHERE e.qid = q.qid AND e.doc_id = d.doc_id)),
{name}_r AS (SELECT * FROM {name}_s QUALIFY row_number() OVER (PARTITION BY rollout_id ORDER BY score DESC, doc_id) <= 1000),
{name}_e AS (SELECT *, row_number() OVER (PARTITION BY rollout_id ORDER BY score DESC, CAST(doc_id AS VARCHAR) DESC) AS i FROM {name}_r),
{name}_d AS (SELECT rollout_id, sum(rel / log2(i + 1)) AS dcg FROM {name}_e JOIN fx_qrels USING (qid, doc_id) WHERE i <= 10 GROUP BY rollout_id),
{name} AS (SELECT q.rollout_id, coalesce(dcg, 0) / idcg AS ndcg FROM {texts} q JOIN idcg USING (qid) LEFT JOIN {name}_d USING (rollout_id))"""


TEXT_DENSE_SQL = f"""
fx_qrels AS ({FIXTURES['fx_qrels']}),
fx_excluded AS ({FIXTURES['fx_excluded']}),
idcg AS (SELECT qid, sum(rel / log2(i + 1)) AS idcg
         FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS i FROM fx_qrels) x WHERE i <= 10 GROUP BY qid),{bow_sql('dv', 'documents', 'doc_id')}"""


def text_dense_inputs(spark, sf):
    enc = RT.hashed_bow_encoder(64, element="double")
    docs = read_table(spark, sf, "documents").select("doc_id", enc(F.col("text")).alias("vec"))
    items = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text", F.explode(F.array(*map(F.lit, range(3)))).alias("v"))
    return items.withColumn("rollout_id", F.col("qid") * 3 + F.col("v")), docs, qrels(spark, sf), excluded(spark, sf), enc


@reg("R13_dense_reward", "WITH " + TEXT_DENSE_SQL.strip() + f""",
ro AS ({CHAT_SQL}),
t AS (SELECT rollout_id, qid, CASE WHEN contains(response, '<|im_start|>assistant')
        THEN substr(response, strpos(response, '<|im_start|>assistant') + 21) ELSE response END AS text FROM ro),{text_ndcg_sql('nd', 't')}
SELECT rollout_id, round(ndcg, 6) + 0.0 AS reward FROM nd""")
def r13(spark, sf):
    items, docs, qr, ex, enc = text_dense_inputs(spark, sf)
    said = (F.when(F.col("v") == 0, F.concat(F.lit("<|im_start|>user q<|im_end|><|im_start|>assistant"), "text"))
            .when(F.col("v") == 1, F.col("text")).otherwise(F.lit("nothing of it")))
    out = RT.dense_reward(items.select("rollout_id", "qid", said.alias("response")), docs, qr, ex, enc)
    return out.select("rollout_id", r6(F.col("reward")).alias("reward"))


@reg("R14_gated_dense_reward", "WITH " + TEXT_DENSE_SQL.strip() + f""",
ro AS ({GATED_SQL}),
p AS (SELECT rollout_id, qid, substr(response, strpos(response, 'Assistant:') + 10) AS p FROM ro),
f AS (SELECT *, (length(p) - length(replace(p, '<think>', ''))) // 7 = 1 AND (length(p) - length(replace(p, '</think>', ''))) // 8 = 1
          AND (length(p) - length(replace(p, '<query>', ''))) // 7 = 1 AND (length(p) - length(replace(p, '</query>', ''))) // 8 = 1
          AND strpos(p, '<think>') <= strpos(p, '</think>') AND strpos(p, '</think>') <= strpos(p, '<query>')
          AND strpos(p, '<query>') <= strpos(p, '</query>') AS ok FROM p),
t1 AS (SELECT rollout_id, qid, CASE WHEN strpos(p, '<query>') > 0 THEN trim(regexp_extract_all(p, '(?s)<query>(.*?)</query>', 1)[-1]) ELSE p END AS text FROM f WHERE ok),{text_ndcg_sql('n1', 't1')},
t2 AS (SELECT f.rollout_id, f.qid, p AS text FROM f JOIN n1 USING (rollout_id) WHERE n1.ndcg = 0),{text_ndcg_sql('n2', 't2')}
SELECT f.rollout_id, round(CASE WHEN NOT ok THEN -1.0 WHEN n1.ndcg > 0 THEN n1.ndcg ELSE coalesce(n2.ndcg, 0) / 2 END, 6) + 0.0 AS reward
FROM f LEFT JOIN n1 USING (rollout_id) LEFT JOIN n2 USING (rollout_id) WHERE NOT ok OR n1.ndcg IS NOT NULL""")
def r14(spark, sf):
    items, docs, qr, ex, enc = text_dense_inputs(spark, sf)
    said = (F.when(F.col("v") == 0, F.concat(F.lit("User: q Assistant: <think>t</think><query>"), "text", F.lit("</query>")))
            .when(F.col("v") == 1, F.concat(F.lit("Assistant: <think>"), "text", F.lit("</think><query>zz</query>")))
            .otherwise(F.concat(F.lit("Assistant: "), "text")))
    out = RT.gated_dense_reward(items.select("rollout_id", "qid", said.alias("response")), docs, qr, ex, enc)
    return out.select("rollout_id", r6(F.col("reward")).alias("reward"))


@reg("R15_delta_reward", """
WITH qs AS (SELECT vec_id AS qid, embedding AS qv, label FROM embeddings WHERE vec_id % 10 = 0),
rw AS (SELECT vec_id - 1 AS qid, embedding AS rv FROM embeddings WHERE vec_id % 10 = 1),
ds AS (SELECT vec_id AS doc_id, embedding AS dv, label FROM embeddings WHERE vec_id % 10 > 1)
SELECT qs.qid AS rollout_id,
       round(sum(list_cosine_similarity(list_transform(rv, lambda x: CAST(x AS DOUBLE)), list_transform(dv, lambda x: CAST(x AS DOUBLE)))
               - list_cosine_similarity(list_transform(qv, lambda x: CAST(x AS DOUBLE)), list_transform(dv, lambda x: CAST(x AS DOUBLE)))), 6) + 0.0 AS delta_reward,
       count(*) AS n_docs
FROM qs JOIN rw USING (qid) JOIN ds ON ds.label = qs.label GROUP BY qs.qid""")
def r15(spark, sf):
    e = read_table(spark, sf, "embeddings")
    qs = e.filter(F.col("vec_id") % 10 == 0).select(F.col("vec_id").alias("rollout_id"),
                                                    F.col("embedding").alias("question_vec"), "label")
    rw = e.filter(F.col("vec_id") % 10 == 1).select((F.col("vec_id") - 1).alias("rollout_id"),
                                                    F.col("embedding").alias("rewritten_vec"))
    ds = e.filter(F.col("vec_id") % 10 > 1).select(F.col("embedding").alias("doc_vec"), "label")
    out = RT.delta_similarity_sets(qs.join(rw, "rollout_id"), ds, "label")
    return out.select("rollout_id", r6(F.col("delta_reward")).alias("delta_reward"), "n_docs")


@reg("R7_encode_documents", r"""
WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS w FROM documents),
c AS (SELECT doc_id, CAST('0x' || substr(md5('0:' || w), 1, 7) AS BIGINT) % 64 AS b, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY ALL),
v AS (SELECT doc_id, b, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM c)
SELECT d.doc_id, CAST(64 AS INT) AS dim, CAST(count(b) AS INT) AS nonzero, round(coalesce(sum(x), 0), 3) AS total,
       round(coalesce(sum(b * x), 0), 2) AS weighted FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id GROUP BY d.doc_id""")
def r7(spark, sf):
    enc = RT.hashed_bow_encoder(64)
    d = read_table(spark, sf, "documents").select("doc_id", enc(F.col("text")).alias("vec"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return d.select("doc_id", F.size("vec").alias("dim"), F.size(F.filter("vec", lambda x: x > 0)).alias("nonzero"),
                    F.round(total(F.col("vec")), 3).alias("total"),
                    F.round(total(F.transform("vec", lambda x, i: x.cast("double") * i)), 2).alias("weighted"))


@reg("R17_vector_cache", """
SELECT doc_id, sha256(text) AS content_hash, CAST(64 AS INT) AS dim FROM documents""")
def r17(spark, sf):
    enc = RT.hashed_bow_encoder(64)
    docs = read_table(spark, sf, "documents").select("doc_id", "text").withColumn("task", F.lit("all"))
    old = docs.filter(F.col("doc_id") % 2 == 0).select("task", "doc_id", F.sha2("text", 256).alias("content_hash"),
                                                        enc(F.col("text")).alias("vec"))
    vec = RT.refresh_vectors(old, docs, enc)
    return vec.select("doc_id", "content_hash", F.size("vec").alias("dim"))
