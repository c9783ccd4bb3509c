"""Retrieval and ranking (R*): BM25 and dense retrieval, exclusion, top-k
runs, nDCG@10 and the retrieval rewards.

Scale design
------------
* The corpus side is a **postings table** ``(task, term, doc_id, tf, dl)``
  built once; document frequencies are only computed for terms that occur
  in queries (a semi-join with the distinct query terms), so the postings
  table is never shuffled by term for the whole vocabulary.
* The query side (query terms with their weights) is small; it is
  broadcast only after a row-count check (``bounded_broadcast``), otherwise
  the join is a regular shuffle join that AQE may still convert.
* Scores are summed per (query, doc) right after the join, so partial
  aggregation runs map-side before any shuffle.  The best k of a query do not
  need all of them: impact-ordered blocks and a threshold per query
  (``bm25_top_k``) leave most postings of common terms unread.
* Top-1000 per query is a ``row_number`` filter: Catalyst inserts a
  WindowGroupLimit, so at most k rows per query and partition are shuffled.
* Zero-score fill (BM25 scores every document) is exact and bounded: only
  queries with fewer than k positive hits get candidates, taken from the
  first ``k + max |blocked|`` documents of their task in corpus order (a
  literal top-N per task, never a sort of the whole corpus; no cross join).
* Dense retrieval visits cells (pivot and ring of angles) only while their
  bound can beat a query's k-th score; a block of documents and a block of
  queries are scored in one task.  Blocks first tell scores at a few ranks,
  for a threshold near the k-th score; only documents that reach it are sent.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.text import THINK_QUERY_TAGS, col, last_tag_content, split_header, tags_in_order
from kestrel.operators.tokens import analyse, join_terms

# English stop words of the standard Lucene English analyser.
STOPWORDS_EN = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it",
                "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these",
                "they", "this", "to", "was", "will", "with")

BROADCAST_MAX_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, known_rows: int | None = None) -> DataFrame:
    """Broadcast hint only when the row count is proven small.

    ``known_rows`` is an upper bound already established (e.g. the query-term
    count bounds the query-weight rows), which saves a counting job."""
    n = df.count() if known_rows is None else known_rows
    return F.broadcast(df) if n <= max_rows else df


# ------------------------------------------------------------- corpus side

def tokenize(df: DataFrame, text="text", stopwords=STOPWORDS_EN, out="tokens", stem: bool = False) -> DataFrame:
    """Analysed tokens (lower case, split on non letters/digits, stop words
    removed; with ``stem`` English stems, to be set for corpus and queries alike)."""
    return df.withColumn(out, analyse(text, stopwords, stem))


POSTINGS_SENT = 1 << 16  # postings in an Arrow batch


def postings(docs: DataFrame, doc_key="doc_id", tokens="tokens", task="task") -> DataFrame:
    """(task, term, doc, tf, dl): term frequencies per document and the
    document length in tokens.

    A document is one row, so its terms are counted in the row, many rows at a
    time in Arrow batches: a term's number in the batch and its row make a key,
    and equal keys are counted.  The postings come out of a narrow map (no
    shuffle of the token stream), partitioned like the documents."""
    x = docs.select(col(task).alias("task"), col(doc_key).alias("doc"), col(tokens).alias("tokens"))
    kinds = dict(x.dtypes)

    def count(batches):
        for batch in batches:
            lists = batch.column(2)
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            terms = lists.flatten().dictionary_encode()
            if not len(terms):
                continue
            n = len(terms.dictionary)
            key, tf = np.unique(np.repeat(np.arange(len(length)) * n, length) + terms.indices.to_numpy(), return_counts=True)
            for at in range(0, len(key), POSTINGS_SENT):
                row, term = np.divmod(key[at:at + POSTINGS_SENT], n)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(row)), terms.dictionary.take(pa.array(term)), batch.column(1).take(pa.array(row)),
                    pa.array(tf[at:at + POSTINGS_SENT].astype(np.int64)), pa.array(length[row].astype(np.int32))], ["task", "term", "doc", "tf", "dl"])

    post = x.mapInArrow(count, f"task {kinds['task']}, term string, doc {kinds['doc']}, tf bigint, dl int")
    return post.select(F.col("task").alias(task), "term", F.col("doc").alias(doc_key), "tf", "dl")


def corpus_stats(docs: DataFrame, tokens="tokens", task="task") -> DataFrame:
    """R2: documents and average length per task."""
    return docs.groupBy(task).agg(F.count(F.lit(1)).alias("n_docs"),
                                  (F.sum(F.size(tokens)) / F.count(F.lit(1))).alias("avgdl"))


def corpus_stats_from_postings(post: DataFrame, doc_keys: DataFrame, doc_key="doc_id", task="task") -> DataFrame:
    """R2 without a second pass over the text: N from the document keys
    (documents without tokens count too), total length from the postings."""
    n = doc_keys.groupBy(task).agg(F.count(F.lit(1)).alias("n_docs"))
    tot = post.groupBy(task).agg(F.sum("tf").alias("_tot"))
    return n.join(tot, task, "left").select(task, "n_docs",
                                            (F.coalesce(F.col("_tot"), F.lit(0)) / F.col("n_docs")).alias("avgdl"))


def document_frequency(post: DataFrame, terms: DataFrame | None = None, doc_key="doc_id", task="task") -> DataFrame:
    """R2: df per term; restricted to ``terms`` (task, term) when given."""
    p = post
    if terms is not None:
        p = p.join(bounded_broadcast(terms.select(task, "term").distinct()), [task, "term"], "left_semi")
    return p.groupBy(task, "term").agg(F.count(F.lit(1)).alias("df"))


def lucene_idf(n_docs, df) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5))."""
    return F.log(1 + (col(n_docs) - col(df) + 0.5) / (col(df) + 0.5))


def tf_part(tf, dl, avgdl, k1: float, b: float) -> Column:
    return col(tf) / (col(tf) + k1 * (1 - b + b * col(dl) / col(avgdl)))


def document_weights(post: DataFrame, stats: DataFrame, dfs: DataFrame, k1: float = 0.9, b: float = 0.4,
                     task="task") -> DataFrame:
    """Lucene BM25 weight of every (doc, term); frequent terms are no hot keys."""
    from kestrel.session import cut_lineage
    j = join_terms(post, cut_lineage(dfs, "frequencies"), [task]).join(F.broadcast(stats), task)
    return j.withColumn("w", lucene_idf("n_docs", "df") * tf_part("tf", "dl", "avgdl", k1, b))


# -------------------------------------------------------------- query side

def query_weights(queries: DataFrame, post: DataFrame, stats: DataFrame, qid="qid", tokens="tokens",
                  task="task", k1: float = 0.9, b: float = 0.4, query_weighting: str = "bm25") -> DataFrame:
    """R4 query side: (task, qid, term, wq, idf, avgdl, df) over known terms only.

    ``bm25`` weights the query with the same model (idf enters twice and the
    query length term uses known tokens only); ``tf`` uses raw counts.
    """
    from kestrel.session import cut_lineage
    qt = queries.select(task, qid, F.explode(tokens).alias("term")).groupBy(task, qid, "term") \
        .agg(F.count(F.lit(1)).alias("tfq"))
    dfs = document_frequency(post, qt)
    known = cut_lineage(qt.join(dfs, [task, "term"]), "known-terms")  # a row per query and term, read twice
    ql = known.groupBy(task, qid).agg(F.sum("tfq").alias("ql"))
    k = known.join(ql, [task, qid]).join(F.broadcast(stats), task)
    idf = lucene_idf("n_docs", "df")
    if query_weighting == "bm25":
        wq = idf * tf_part("tfq", "ql", "avgdl", k1, b)
    elif query_weighting == "tf":
        wq = F.col("tfq").cast("double")
    else:
        raise ValueError(f"unknown query weighting {query_weighting!r}")
    return k.select(task, qid, "term", wq.alias("wq"), idf.alias("idf"), "avgdl", "df")


def query_term_rows(queries: DataFrame, qid="qid", tokens="tokens", task="task") -> int:
    """Upper bound of the query-weight rows: distinct (task, query, term)."""
    return queries.select(task, qid, F.explode(tokens).alias("term")).distinct().count()


def bm25_scores(qw: DataFrame, post: DataFrame, qid="qid", doc_key="doc_id", task="task",
                k1: float = 0.9, b: float = 0.4, query_rows: int | None = None) -> DataFrame:
    """Sparse dot product of query and document weights, (task, qid, doc, score).

    The query side is broadcast when its (bounded) row count is small, so
    the postings are never shuffled for scoring."""
    j = post.join(bounded_broadcast(qw, known_rows=query_rows), [task, "term"])
    contrib = F.col("wq") * F.col("idf") * tf_part("tf", "dl", "avgdl", k1, b)
    return j.groupBy(task, qid, doc_key).agg(F.sum(contrib).alias("score"))


IMPACT_LEVELS = 128  # of a posting's term-frequency part, which lies between 0 and 1


def impact_postings(post: DataFrame, stats: DataFrame, k1: float = 0.9, b: float = 0.4, task="task") -> DataFrame:
    """R3/R4 index: postings with their term-frequency part ``tfp`` and its
    ``level``.  The postings of a term and level are one impact-ordered block:
    each part lies in [level, level + 1) / IMPACT_LEVELS, so a block's bounds
    need neither a sort nor a look at its postings."""
    j = post.join(F.broadcast(stats.select(task, "avgdl")), task).withColumn("tfp", tf_part("tf", "dl", "avgdl", k1, b))
    return j.withColumn("level", F.floor(F.col("tfp") * IMPACT_LEVELS).cast("int")).drop("avgdl")


def _allowed(scores: DataFrame, excluded: DataFrame, qid: str, doc_key: str, task: str) -> DataFrame:
    """R5 for ids of any type: exclusions are compared as strings."""
    keys = query_keys(qid, task, scores, excluded)
    ex = excluded.select(*keys, F.col(doc_key).cast("string").alias("_x")).filter(F.col("_x") != "N/A").distinct()
    return scores.withColumn("_x", F.col(doc_key).cast("string")).join(ex, [*keys, "_x"], "left_anti").drop("_x")


DIRECT_SHARE = 0.5  # of the rows that scoring every pair makes: candidates that make as many are dearer
SENT_ROW = 8  # (posting, query) rows that are made in memory for the cost of one that is sent
PAIR_ROWS = 2_000_000  # (posting, query) rows of a task that scores every pair
SLICES = 16  # the best of one slice of the documents bound the best of all
SCORE_DIGITS = 9  # scores are ranked rounded to so many


def _small(df: DataFrame, query_rows: int | None) -> DataFrame:
    return bounded_broadcast(df, known_rows=query_rows) if query_rows is not None else df


def bm25_plan(terms: DataFrame, post: DataFrame, excluded: DataFrame, k: int = 1000, qid="qid", doc_key="doc_id",
              task="task", query_rows: int | None = None) -> DataFrame:
    """R6 planning: a written table (task, qid, term, g, head, n_head, n_all, most).

    The counts of the impact blocks say from which level (``head``) on a term
    has ``k`` postings beyond what the query excludes; ``n_head`` of its
    ``n_all`` postings lie there, and none adds more than ``most``."""
    from kestrel.session import cut_lineage
    keys = query_keys(qid, task, terms, excluded)
    n_ex = excluded.select(*keys, doc_key).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_nx"))
    blocks = (post.join(_small(terms.select(task, "term").distinct(), query_rows), [task, "term"], "left_semi")
              .groupBy(task, "term", "level").agg(F.count(F.lit(1)).alias("n")))
    per = Window.partitionBy(task, qid, "term")
    level = terms.join(n_ex, keys, "left").join(blocks, [task, "term"])
    level = (level.withColumn("_from_top", F.sum("n").over(per.orderBy(F.desc("level"))))
             .withColumn("_need", F.lit(k) + F.coalesce(F.col("_nx"), F.lit(0))))
    enough = F.col("_from_top") >= F.col("_need")
    return cut_lineage(level.groupBy(task, qid, "term", "g").agg(
        F.coalesce(F.max(F.when(enough, F.col("level"))), F.lit(0)).alias("head"),
        F.coalesce(F.min(F.when(enough, F.col("_from_top"))), F.max("_from_top")).alias("n_head"),
        F.max("_from_top").alias("n_all"),
        ((F.max("level") + 1) / IMPACT_LEVELS * F.col("g")).alias("most")), "bm25-plan")


def bm25_cuts(plan: DataFrame, post: DataFrame, excluded: DataFrame, k: int = 1000, qid="qid", doc_key="doc_id",
              task="task", query_rows: int | None = None) -> DataFrame:
    """R6 bounds: (task, qid, term, cut), the first level of each term's
    postings that must be looked at for a query's best ``k``; terms that need
    no look are absent.  ``plan``: of ``bm25_plan``.

    The heads of the plan are scored; the k-th best partial sum is a threshold that the k-th best score reaches.  Terms
    then give way in order of their largest possible contribution, the
    smallest first, while the sum of what is given up stays below the
    threshold: whole terms, then the low blocks of one more.  A document that
    occurs only in what was given up cannot reach the threshold.  A query with
    fewer than ``k`` matches has no threshold and keeps all."""
    heads = (post.join(_small(plan, query_rows), [task, "term"]).filter(F.col("level") >= F.col("head"))
             .groupBy(task, qid, doc_key).agg(F.sum(F.col("g") * F.col("tfp")).alias("score")))
    best = Window.partitionBy(task, qid).orderBy(F.desc("score"))
    # the margin covers rounded scores and the order of sums
    kth = (_allowed(heads, excluded, qid, doc_key, task).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == k)
           .select(task, qid, (F.col("score") * (1 - 1e-9) - 1e-8).alias("threshold")))

    order = Window.partitionBy(task, qid).orderBy("most", "term")
    given = (plan.join(kth, [task, qid], "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
             .withColumn("_sum", F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    slack = F.col("threshold") - (F.col("_sum") - F.col("most"))
    return (given.filter(F.col("_sum") >= F.col("threshold"))
            .withColumn("cut", F.when(slack > 0, F.floor(slack / F.col("g") * IMPACT_LEVELS).cast("int")).otherwise(F.lit(0)))
            .select(task, qid, "term", "cut"))


def _every_pair(terms: DataFrame, post: DataFrame, excluded: DataFrame, k: int, qid: str, doc_key: str, task: str,
                order: str | None, rows: int) -> DataFrame:
    """The best ``k`` of queries whose ``terms`` (task, qid, term, g) can be
    broadcast, every pair scored.  Postings of query terms and exclusions are
    dealt by document, so a task has all of a document's rows: pairs are made,
    summed and ranked where they are and never sent or written.  The k-th best
    score of one slice of the documents is reached by ``k`` of all; only pairs
    that reach it are sorted, and a task sends ``k`` of a query at most."""
    from kestrel.session import cut_lineage
    keys = query_keys(qid, task, terms, excluded)
    kind, by = dict(post.dtypes)[doc_key], dict(terms.dtypes)[qid]
    barred = (excluded.select(*keys, F.col(doc_key).cast("string").alias("_x")).filter(F.col("_x") != "N/A")
              .withColumn(doc_key, F.col("_x").try_cast(kind)).filter(F.col(doc_key).cast("string") == F.col("_x"))
              .join(F.broadcast(terms.select(task, qid).distinct()), keys))
    own = post.join(F.broadcast(terms.select(task, "term").distinct()), [task, "term"], "left_semi")
    dealt = own.select(task, "term", doc_key, "tfp", F.lit(None).cast(by).alias("_by")).unionByName(
        barred.select(task, F.lit(None).cast("string").alias("term"), doc_key, F.lit(None).cast("double").alias("tfp"), F.col(qid).cast(by).alias("_by")))
    least = int(post.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounded = F.round("score", SCORE_DIGITS)

    def pairs(some: DataFrame, rows: int) -> DataFrame:
        met = some.repartition(max(least, -(-rows // PAIR_ROWS)), doc_key).join(F.broadcast(terms), [task, "term"], "left")
        return (met.groupBy(task, F.coalesce(qid, "_by").alias(qid), doc_key)
                .agg(F.sum(F.col("g") * F.col("tfp")).alias("score"), F.max(F.col("_by").isNotNull()).alias("_barred"))
                .filter(~F.col("_barred")).drop("_barred"))

    def first(scores: DataFrame, *then) -> DataFrame:
        turn = (F.row_number() if then else F.rank()).over(Window.partitionBy(task, qid).orderBy(F.desc("_s"), *then))
        return scores.withColumn("_r", turn).filter(F.col("_r") <= k)

    part = first(pairs(dealt.filter(F.pmod(F.xxhash64(doc_key), F.lit(SLICES)) == 0), -(-rows // SLICES)).withColumn("_s", rounded), doc_key)
    bound = cut_lineage(part.filter(F.col("_r") == k).select(F.col(task).alias("_task"), F.col(qid).alias("_q"), F.col("_s").alias("_least")), "bm25-bounds")
    every = pairs(dealt, rows).withColumn("_s", rounded).join(
        F.broadcast(bound), F.col(task).eqNullSafe(F.col("_task")) & F.col(qid).eqNullSafe(F.col("_q")), "left")
    can = every.filter(F.col("_least").isNull() | (F.col("_s") >= F.col("_least")))
    return first(can, *([order] if order else [])).select(task, qid, doc_key, "score")


def bm25_every_pair(terms: DataFrame, post: DataFrame, excluded: DataFrame, k: int = 1000, qid="qid", doc_key="doc_id",
                    task="task", order: str | None = None) -> DataFrame:
    """``bm25_top_k`` by scoring every pair, for queries of BROADCAST_MAX_ROWS
    ``terms`` at a time (written, with ``df``)."""
    from kestrel.session import cut_lineage
    n = terms.count()
    blocks = max(1, -(-n // BROADCAST_MAX_ROWS))
    out = None
    for block in range(blocks):
        some = terms if blocks == 1 else terms.filter(F.pmod(F.xxhash64(task, qid), F.lit(blocks)) == block)
        rows = some.agg(F.sum("df")).first()[0] or 0
        best = _every_pair(some.select(task, qid, "term", "g"), post, excluded, k, qid, doc_key, task, order, int(rows))
        best = best if blocks == 1 else cut_lineage(best, "bm25-best")
        out = best if out is None else out.unionByName(best)
    return out


def bm25_top_k(qw: DataFrame, post: DataFrame, excluded: DataFrame, k: int = 1000, qid="qid", doc_key="doc_id",
               task="task", query_rows: int | None = None, order: str | None = None) -> DataFrame:
    """R4 + R6 without a table of every pair: (task, qid, doc, score) with the
    exact scores of all documents that can be among a query's first ``k``,
    excluded ones left out, ties with the k-th score (rounded to SCORE_DIGITS)
    included; with ``order``, a column of ``post`` that breaks ties, no more
    than ``k`` where every pair is scored.  ``qw``: of ``query_weights``; ``post``:
    ``impact_postings`` of a written table.

    Candidates come from the impact blocks that ``bm25_cuts`` leaves; they get
    their full scores by an equi-join on (document, term), so a common term's
    postings meet candidates only.  That sends a row per candidate and query
    term.  Where the frequencies, the plan or the cuts tell that these would
    cost DIRECT_SHARE of all (posting, query) rows (``k`` near the number of
    matches, long queries of common words), every pair is scored in memory."""
    from kestrel.session import cut_lineage
    terms = cut_lineage(qw.select(task, qid, "term", (F.col("wq") * F.col("idf")).alias("g"), "df"), "bm25-terms")
    lengths = terms.groupBy(F.col(task).alias("_task"), F.col(qid).alias("_q")).agg(F.count(F.lit(1)).alias("_terms"))
    of_query = lambda df: df.join(lengths, F.col(task).eqNullSafe(F.col("_task")) & F.col(qid).eqNullSafe(F.col("_q")))
    enough = lambda made, every: (made or 0) >= DIRECT_SHARE * (every or 0)
    direct = lambda: bm25_every_pair(terms, post, excluded, k, qid, doc_key, task, order)
    if enough(*of_query(terms).agg(F.sum(F.least("df", F.lit(SENT_ROW * k) * F.col("_terms"))), F.sum("df")).first()):
        return direct()
    weights = terms.drop("df")
    plan = bm25_plan(weights, post, excluded, k, qid, doc_key, task, query_rows)
    made, every = of_query(plan).agg(F.sum(F.least("n_all", SENT_ROW * F.col("n_head") * F.col("_terms"))), F.sum("n_all")).first()
    if enough(made, every):
        return direct()
    cuts = _small(cut_lineage(bm25_cuts(plan, post, excluded, k, qid, doc_key, task, query_rows), "bm25-cuts"), query_rows)
    found = post.select(task, "term", doc_key, "level").join(cuts, [task, "term"]).filter(F.col("level") >= F.col("cut"))
    looks = of_query(found.groupBy(task, qid).agg(F.count(F.lit(1)).alias("n"))).agg(F.sum(F.col("n") * F.col("_terms"))).first()[0] or 0
    if enough(min(every or 0, SENT_ROW * looks), every):
        return direct()
    candidates = _allowed(found.select(task, qid, doc_key).distinct(), excluded, qid, doc_key, task)
    return (candidates.join(weights, [task, qid])
            .join(post.select(task, "term", doc_key, "tfp"), [task, "term", doc_key])
            .groupBy(task, qid, doc_key).agg(F.sum(F.col("g") * F.col("tfp")).alias("score")))


def query_keys(qid: str, task: str, *tables: DataFrame) -> list[str]:
    """What names a query: its task and id, or its id alone where a table has no tasks."""
    return [task, qid] if all(task in t.columns for t in tables) else [qid]


def exclude(scores: DataFrame, excluded: DataFrame, qid="qid", doc_key="doc_id", task="task") -> DataFrame:
    """Drop each query's excluded documents before ranking ("N/A" ignored)."""
    keys = [*query_keys(qid, task, scores, excluded), doc_key]
    ex = excluded.select(*keys)
    if dict(ex.dtypes)[doc_key] == "string":
        ex = ex.filter(F.col(doc_key) != "N/A")
    return scores.join(ex, keys, "left_anti")


def top_k(scores: DataFrame, k: int = 1000, qid="qid", doc_key="doc_id", order="doc_order", task="task") -> DataFrame:
    """R6 (positive part): first k per query by score desc, corpus order asc."""
    w = Window.partitionBy(*query_keys(qid, task, scores)).orderBy(F.col("score").desc(), F.col(order).asc())
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def zero_fill(queries: DataFrame, hits: DataFrame, excluded: DataFrame, docs: DataFrame, k: int = 1000,
              qid="qid", doc_key="doc_id", task="task", order: str | None = None) -> DataFrame:
    """R6 (zero part): documents with score 0 that complete a run of ``k``.

    For a query with n positive hits, the run continues with the first
    ``k - n`` documents in corpus order (``order``, default the document id)
    that are neither hits nor excluded.  Those lie among the first
    ``N = k + max |blocked|`` documents of the task: the first N of each of
    many slices of the task, sorted side by side, then the first N of those.
    So the corpus is never sorted in one task, whatever N is; only queries
    that need a fill join these documents.
    """
    order = order or doc_key
    keys = query_keys(qid, task, queries, hits)
    npos = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pos"))
    if task in keys and task not in excluded.columns:
        excluded = excluded.join(queries.select(*keys).distinct(), qid)
    blocked = hits.select(*keys, doc_key).unionByName(excluded.select(*keys, doc_key)).distinct()
    nblk = blocked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocked"))
    q = (queries.select(task, qid).distinct().join(npos, keys, "left").join(nblk, keys, "left")
         .fillna(0, ["n_pos", "n_blocked"])
         .withColumn("need", F.lit(k) - F.col("n_pos")).filter(F.col("need") > 0))
    max_blocked = q.agg(F.max("n_blocked")).first()[0] or 0
    n_cand = k + int(max_blocked)
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cand_t = (docs.select(task, doc_key, F.col(order).alias("_ord"))
              .withColumn("_slice", F.pmod(F.xxhash64(doc_key), F.lit(slices)))
              .withColumn("_pos", F.row_number().over(Window.partitionBy(task, "_slice").orderBy("_ord")))
              .filter(F.col("_pos") <= n_cand).drop("_slice")
              .withColumn("_pos", F.row_number().over(Window.partitionBy(task).orderBy("_ord")))
              .filter(F.col("_pos") <= n_cand))
    cand = q.join(cand_t, task).filter(F.col("_pos") <= F.col("need") + F.col("n_blocked"))
    cand = cand.join(blocked, [*keys, doc_key], "left_anti")
    w = Window.partitionBy(*keys).orderBy("_ord")
    z = cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.col("need"))
    return z.select(task, qid, doc_key, F.lit(0.0).alias("score"), F.col("_ord").alias("doc_order"),
                    (F.col("n_pos") + F.col("_r")).cast("int").alias("rank"))


def ranked_run(scores: DataFrame, queries: DataFrame, excluded: DataFrame, docs: DataFrame, k: int = 1000,
               qid="qid", doc_key="doc_id", task="task", fill: bool = True, order: str | None = None) -> DataFrame:
    """R5 + R6: exclusion, top-k by score then corpus order, zero fill.

    Corpus order is ``order`` (default: the document id); ``docs`` lists the
    documents per task (task, doc id[, order])."""
    order = order or doc_key
    s = exclude(scores, excluded, qid, doc_key, task)
    if order != doc_key:
        s = s.join(docs.select(task, doc_key, order), [task, doc_key])
    s = s.withColumn("doc_order", F.col(order))
    hits = top_k(s.filter(F.col("score") > 0) if fill else s, k, qid, doc_key, task=task)
    hits = hits.select(task, qid, doc_key, "score", "doc_order", F.col("rank").cast("int").alias("rank"))
    if not fill:
        return hits
    # the hits feed the run, the hit counts and the blocked set: written once
    # (at most k rows per query), so scoring is not re-run per consumer
    from kestrel.session import cut_lineage
    hits = cut_lineage(hits, "hits")
    return hits.unionByName(zero_fill(queries, hits, excluded, docs, k, qid, doc_key, task, order))


def ndcg_at_k(run: DataFrame, qrels: DataFrame, k: int = 10, qid="qid", doc_key="doc_id", rel="rel", task="task") -> DataFrame:
    """nDCG@k with the evaluator's own order: score desc, document id
    desc (as strings) on ties; gain = relevance, discount log2(rank + 1);
    the ideal ranking comes from all judged documents.  Queries without
    relevant judgments are dropped."""
    keys = query_keys(qid, task, run, qrels)
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(doc_key).cast("string").desc())
    top = run.withColumn("_erank", F.row_number().over(w)).filter(F.col("_erank") <= k)
    pos = qrels.filter(F.col(rel) > 0).select(*keys, doc_key, rel)
    dcg = top.select(*keys, doc_key, "_erank").join(pos, [*keys, doc_key]).groupBy(*keys).agg(
        F.sum(F.col(rel) / F.log2(F.col("_erank") + 1)).alias("dcg"))
    wi = Window.partitionBy(*keys).orderBy(F.col(rel).desc())
    ideal = pos.withColumn("_i", F.row_number().over(wi)).filter(F.col("_i") <= k) \
        .groupBy(*keys).agg(F.sum(F.col(rel) / F.log2(F.col("_i") + 1)).alias("idcg"))
    out = ideal.join(dcg, keys, "left").fillna(0.0, ["dcg"])
    return out.select(*keys, (F.col("dcg") / F.col("idcg")).alias("ndcg"))


def qrels_from_json(df: DataFrame, key="rollout_id", ground_truth="ground_truth") -> DataFrame:
    """``{"qrels": {qid: {doc: rel}}}`` -> (key, qid, doc_id, rel);
    null queries dropped, relevance cast to int, exactly one query each."""
    m = F.from_json(col(ground_truth), "struct<qrels: map<string, map<string, int>>>")["qrels"]
    x = df.select(key, F.explode(m).alias("qid", "docs")).filter(F.col("docs").isNotNull())
    nq = x.groupBy(key).agg(F.count(F.lit(1)).alias("_nq"))
    one = F.when(F.col("_nq") != 1, F.raise_error(F.lit("qrels must hold exactly one query")).cast("string")).otherwise(F.col("qid"))
    x = x.join(nq, key).withColumn("qid", one)  # within the result, so the check always runs
    return x.select(key, "qid", F.explode("docs").alias("doc_id", "rel")) \
        .select(key, "qid", "doc_id", F.col("rel").cast("int").alias("rel"))


# -------------------------------------------------------------- dense side

def l2_normalize(vec) -> Column:
    """X / ||x||; a zero vector stays zero."""
    v = F.transform(col(vec), lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(col(vec), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # the norm is computed once and zipped in (a reference inside the lambda
    # would be re-evaluated per element)
    return F.zip_with(v, F.array_repeat(n, F.size(col(vec))),
                      lambda x, nn: F.when(nn > 0, x / nn).otherwise(F.lit(0.0)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine similarity of two vectors (sklearn convention: 0 for zero vectors)."""
    na = F.sqrt(dot(a, a))
    nb = F.sqrt(dot(b, b))
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


BLOCK_DOCS = 16384  # documents that meet a block of queries in one task
CHUNK_QUERIES = 512  # queries of a block scored at a time


def _unit_rows(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _places(values: pd.Series) -> dict:
    """The rows (index, rising) of every value; nulls have none."""
    return {x: i.index.to_numpy() for x, i in values.groupby(values)} if len(values) else {}


PIVOTS = 256       # at most; documents are grouped around their nearest
RINGS = 64         # equal ranges of the angle to the pivot, from 0 to pi
ANGLE_MARGIN = 1e-6


class DenseIndex:
    """R9 index: documents by cells, a cell being a pivot and a ring of angles
    around it.  At most PIVOTS pivots (documents chosen by hash) and PIVOTS *
    RINGS cells are held by the driver and sent to tasks; documents are a
    written table (doc, vec, order, cell).  A block is about BLOCK_DOCS
    documents of cells that follow each other, or of one large cell, so what
    is sent for scoring is a query per block and a document per block of
    queries, however small the cells are.  Documents without a vector are left
    out; a zero vector has cosine 0 with all."""

    def __init__(self, docs: DataFrame, doc_key="doc_id", dvec="vec", order="doc_order"):
        from kestrel.session import cut_lineage
        d = docs.select(F.col(doc_key).alias("d"), F.col(dvec).alias("v"), F.col(order).cast("bigint").alias("o"))
        d = cut_lineage(d, "dense-documents").filter(F.col("v").isNotNull())  # encoded once
        n = d.agg(F.count(F.lit(1)).alias("n")).first()["n"]
        chosen = d.orderBy(F.xxhash64("d"), "d").limit(max(1, min(PIVOTS, n // 64))).select("v").collect()
        pivots = self.pivots = _unit_rows([r["v"] for r in chosen]) if chosen else np.zeros((0, 1))
        kinds = dict(d.dtypes)

        def place(batches):
            for f in batches:
                if len(f):
                    cos = np.clip(_unit_rows(f["v"]) @ pivots.T, -1, 1)
                    near = cos.argmax(axis=1)
                    angle = np.arccos(cos[np.arange(len(f)), near])
                    ring = np.minimum((angle / np.pi * RINGS).astype(np.int64), RINGS - 1)
                    yield f.assign(cell=near * RINGS + ring, angle=angle)

        placed = cut_lineage(d.mapInPandas(place, f"d {kinds['d']}, v {kinds['v']}, o bigint, cell bigint, angle double"), "dense-placed")
        rings = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).orderBy("cell")
        self.cells = rings.toPandas()  # at most PIVOTS * RINGS rows
        self.cells["parts"] = (-(-self.cells["n"] // BLOCK_DOCS)).astype("int64")
        blocks, block, held = [], 0, 0
        for n, parts in zip(self.cells["n"], self.cells["parts"], strict=True):
            if held and (parts > 1 or held + n > BLOCK_DOCS):
                block, held = block + 1, 0
            blocks.append(block)
            block, held = (block + parts, 0) if parts > 1 else (block, held + n)
        self.cells["block"] = np.array(blocks, np.int64)
        self.docs, self.kind, self.spark = placed, kinds["d"], docs.sparkSession
        self.visited: DataFrame | None = None  # (qid, cell) of the last search

    def visits(self, queries: DataFrame) -> DataFrame:
        """(q, v, x, threshold, block, cells) for queries (q, v, x, need,
        threshold), the cells of a block in one row.  Without a threshold: the
        nearest cells that hold ``need`` documents.  With one: the cells that
        may hold a cosine of at least the threshold, by the triangle inequality
        of angles: a query at angle ``a`` to a pivot is at least ``a - hi`` and
        ``lo - a`` away from documents in a ring."""
        pivots, cells = self.pivots, self.cells
        kinds = dict(queries.dtypes)

        def plan(batches):
            of, lo, hi, n, cell, block, parts = (cells[c].to_numpy() for c in ("cell", "lo", "hi", "n", "cell", "block", "parts"))
            of = of // RINGS
            for whole in batches if len(of) else ():
                for at in range(0, len(whole), 256):
                    f = whole.iloc[at:at + 256]
                    a = np.arccos(np.clip(_unit_rows(f["v"]) @ pivots.T, -1, 1))[:, of]
                    least = np.maximum(0, np.maximum(a - hi, lo - a) - ANGLE_MARGIN)
                    rows, blocks, found = [], [], []
                    for i, (need, threshold) in enumerate(zip(f["need"].to_numpy(), f["threshold"].to_numpy(), strict=True)):
                        if np.isnan(threshold):
                            order = np.argsort(least[i], kind="stable")
                            own = np.sort(order[:int(np.searchsorted(np.cumsum(n[order]), need)) + 1])
                        else:
                            own = np.flatnonzero(np.cos(least[i]) >= threshold)
                        for some in np.split(own, np.flatnonzero(np.diff(block[own])) + 1) if len(own) else ():
                            for part in range(int(parts[some[0]])):
                                rows.append(i)
                                blocks.append(block[some[0]] + part)
                                found.append(cell[some])
                    if rows:
                        yield f.iloc[rows][["q", "v", "x", "threshold"]].assign(block=blocks, cells=found)

        return queries.select("q", "v", "x", "need", F.col("threshold").cast("double")).mapInPandas(
            plan, f"q {kinds['q']}, v {kinds['v']}, x {kinds['x']}, threshold double, block bigint, cells array<bigint>")

    def scored(self, visits: DataFrame, lists: DataFrame | None, q_blocks: int, found, schema: str) -> DataFrame:
        """``found(queries, documents, scores)`` of every block of queries with
        every block of documents that it visits, a few queries at a time; what
        is not visited or excluded by ``lists`` (d, xs: names of the exclusion
        lists that have the document) scores minus infinity."""
        places = self.spark.createDataFrame([tuple(map(int, x)) for x in self.cells[["cell", "block", "parts"]].to_numpy()], "cell long, block long, parts long")
        q = visits.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(q_blocks)))
        met = visits.select("block").distinct()
        d = self.docs.join(F.broadcast(places), "cell")
        d = d.withColumn("block", F.col("block") + F.pmod(F.xxhash64("d"), F.col("parts"))).join(F.broadcast(met), "block", "left_semi")
        d = d.join(lists, "d", "left") if lists is not None else d.withColumn("xs", F.lit(None).cast(f"array<{dict(q.dtypes)['x']}>"))
        d = (d.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint"))))
             .select("d", "v", "o", "cell", "xs", "block", "qb"))

        def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(left) and len(right):
                left, right = left.reset_index(drop=True), right.sort_values("o", kind="stable").reset_index(drop=True)
                queries, documents = _unit_rows(left["v"]), _unit_rows(right["v"]).T
                columns = _places(right["cell"])
                visitors = _places(left["cells"].explode())
                barred = _places(right["xs"].dropna().explode())
                askers = _places(left["x"]) if barred else {}
                barred = {x: ds for x, ds in barred.items() if x in askers}
                for at in range(0, len(left), CHUNK_QUERIES):
                    end = min(at + CHUNK_QUERIES, len(left))
                    own = {c: visitors[c][slice(*np.searchsorted(visitors[c], [at, end]))] - at for c in columns if c in visitors}
                    if len(own) == len(columns) and all(len(r) == end - at for r in own.values()):
                        sc = queries[at:end] @ documents
                    else:
                        sc = np.full((end - at, len(right)), -np.inf)
                        for c, rows in own.items():
                            sc[np.ix_(rows, columns[c])] = queries[at + rows] @ documents[:, columns[c]]
                    for x, ds in barred.items():
                        rows = askers[x][slice(*np.searchsorted(askers[x], [at, end]))] - at
                        if len(rows):
                            sc[np.ix_(rows, ds)] = -np.inf
                    out.append(found(left.iloc[at:end], right, sc))
            out = [f for f in out if len(f)]
            return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

        return q.groupBy("block", "qb").cogroup(d.groupBy("block", "qb")).applyInPandas(score, schema)

    def bounds(self, visits: DataFrame, lists: DataFrame | None, k: int, q_blocks: int) -> DataFrame:
        """(q, threshold) of the queries with ``k`` documents in what they
        visit: a score that ``k`` of them reach.  A block tells the scores at a
        few ranks (close for the first ones, then a quarter apart), so few
        numbers are sent and not many more than ``k`` documents reach it."""
        ranks = [1]
        while ranks[-1] < k:
            ranks.append(min(k, ranks[-1] + 1 + ranks[-1] // 4))

        def found(left, right, sc):
            at = np.array([r for r in ranks if r <= sc.shape[1]])
            best = -np.partition(-np.nan_to_num(sc, nan=-np.inf, neginf=-np.inf), at - 1, axis=1)[:, at - 1]
            n = np.broadcast_to(np.diff(at, prepend=0), best.shape)
            own = best >= np.maximum(np.nan_to_num(left["threshold"].to_numpy(), nan=-2.0), -2.0)[:, None]
            return pd.DataFrame({"q": np.repeat(left["q"].to_numpy(), own.sum(axis=1)), "score": best[own], "n": n[own]})

        told = self.scored(visits, lists, q_blocks, found, f"q {dict(visits.dtypes)['q']}, score double, n bigint")
        fall = Window.partitionBy("q").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        return (told.withColumn("_sum", F.sum("n").over(fall)).filter(F.col("_sum") >= k)
                .groupBy("q").agg((F.max("score") - 1e-8).alias("threshold")))  # covers rounded scores

    def scores(self, visits: DataFrame, lists: DataFrame | None, k: int, q_blocks: int) -> DataFrame:
        """(q, d, score, o): the documents that reach a query's threshold, of a block the best ``k``."""
        def found(left, right, sc):
            rows, at = np.nonzero(sc >= left["threshold"].to_numpy()[:, None])
            values = sc[rows, at]
            turn = np.lexsort((at, -np.round(values, 12), rows))
            rows, at, values = rows[turn], at[turn], values[turn]
            first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            rows, at, values = rows[first], at[first], values[first]
            return pd.DataFrame({"q": left["q"].to_numpy()[rows], "d": right["d"].to_numpy()[at], "score": values, "o": right["o"].to_numpy()[at]})

        return self.scored(visits, lists, q_blocks, found, f"q {dict(visits.dtypes)['q']}, d {self.kind}, score double, o bigint")


def dense_run(queries: DataFrame, docs: DataFrame, excluded: DataFrame, k: int = 1000, qid="qid", qvec="vec",
              doc_key="doc_id", dvec="vec", order="doc_id", max_queries: int = 4096, index: DenseIndex | None = None,
              exclusion_list: str | None = None) -> DataFrame:
    """R9 with exclusions: (qid, doc, score, doc_order) with each query's best
    ``k`` by cosine of the documents it does not exclude (rank afterwards).
    ``excluded``: (qid, doc); with ``exclusion_list``, a column of both
    ``queries`` and ``excluded``: (that column, doc), so that queries which
    exclude the same documents share one list and no pairs are made.

    Exact in three rounds over a ``DenseIndex``.  First each query visits the
    nearest cells that hold ``k`` documents beyond its exclusions; a score that
    ``k`` of them reach is a threshold.  Then it visits the cells that can
    still reach it, for a threshold that not many more than ``k`` of all
    documents reach.  Only those are returned.  Excluded documents are left out
    where scores are made, so they never cost a place."""
    from kestrel.session import cut_lineage
    index = index or DenseIndex(docs, doc_key, dvec, order)
    name = exclusion_list or qid
    barred = excluded.select(F.col(name).alias("x"), F.col(doc_key).alias("d")).filter(F.col("x").isNotNull() & F.col("d").isNotNull())
    lists = cut_lineage(barred.groupBy("d").agg(F.collect_set("x").alias("xs")), "dense-excluded")
    lengths = lists.select(F.explode("xs").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("_n"))
    q = queries.select(F.col(qid).alias("q"), F.col(qvec).alias("v"), F.col(name).alias("x")).filter(F.col("v").isNotNull())
    q = cut_lineage(q.join(lengths, "x", "left").select("q", "v", "x", (F.lit(k) + F.coalesce(F.col("_n"), F.lit(0))).alias("need")), "dense-queries")
    lists = None if lists.isEmpty() else lists
    q_blocks = max(1, -(-q.count() // max_queries))

    def visits(bounds: DataFrame | None) -> DataFrame:
        # fewer than k so far means that every cell was visited, or that exclusions are of other documents: visit all
        own = q.withColumn("threshold", F.lit(None)) if bounds is None else q.join(bounds, "q", "left").withColumn("threshold", F.coalesce("threshold", F.lit(-2.0)))
        return index.visits(own)

    near = visits(None)
    rest = visits(cut_lineage(index.bounds(near, lists, k, q_blocks), "dense-near"))
    index.visited = near.unionByName(rest).select("q", F.explode("cells").alias("cell")).distinct()
    last = visits(cut_lineage(index.bounds(rest, lists, k, q_blocks), "dense-bounds"))
    return (index.scores(last, lists, k, q_blocks)
            .select(F.col("q").alias(qid), F.col("d").alias(doc_key), "score", F.col("o").alias("doc_order")))


def hashed_bow_encoder(dim: int = 64, seed: int = 0, element: str = "float"):
    """R7 default encoder: a text's words counted in ``dim`` buckets of their
    MD5, L2-normalised (a stand-in for a sentence encoder; any function of a
    column plugs in, such as ``predict_batch_udf``).  Words are split in
    built-in expressions; Arrow batches hash each distinct word once."""
    kind = {"float": np.float32, "double": np.float64}[element]

    @F.arrow_udf(f"array<{element}>")
    def counted(lists: pa.Array) -> pa.Array:
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        bucket = np.array([int(hashlib.md5(f"{seed}:{w}".encode()).hexdigest()[:7], 16) % dim for w in words.dictionary.to_pylist()], np.int64)
        at = np.repeat(np.arange(len(length)) * dim, length) + bucket[words.indices.to_numpy()]
        unit = _unit_rows(np.bincount(at, minlength=len(length) * dim).reshape(-1, dim)) if len(length) else np.zeros((0, dim))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(length) + 1) * dim, pa.int32()), pa.array(unit.astype(kind).ravel()))

    def encode(text) -> Column:
        return counted(F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"(?U)\s+"), lambda w: w != ""))
    return encode


CHAT_MARK = "<|im_start|>assistant"


def dense_ndcg(texts: DataFrame, docs: DataFrame, qrels: DataFrame, excluded: DataFrame, encode, k: int = 1000, cut: int = 10,
               key="rollout_id", qid="qid", index: DenseIndex | None = None) -> DataFrame:
    """R7 + R9 + R11 from text: (key, ndcg) of rows (key, qid, text), each
    encoded and searched as a query of its own, judged by its item's qrels and
    without its item's excluded documents.  ``docs``: (doc_id, vec).  Rows
    whose item has no relevant document are dropped."""
    item = texts.select(F.col(key).alias("_key"), F.col(qid).alias("_item"))
    own = lambda df, *more: df.join(item, F.col(qid) == F.col("_item")).select(F.col("_key").alias(qid), "doc_id", *more)
    asked = texts.select(F.col(key).alias(qid), encode(F.col("text")).alias("vec"), F.col(qid).alias("_item"))
    found = dense_run(asked, docs, excluded.select(F.col(qid).alias("_item"), "doc_id"), k, qid=qid, order="doc_id", index=index, exclusion_list="_item")
    run = top_k(found.withColumn("score", F.round("score", 9)), k, qid=qid)
    return ndcg_at_k(run.select(qid, "doc_id", "score"), own(qrels, "rel"), cut, qid=qid).withColumnRenamed(qid, key)


def dense_reward(rollouts: DataFrame, docs: DataFrame, qrels: DataFrame, excluded: DataFrame, encode, k: int = 1000, cut: int = 10,
                 key="rollout_id", qid="qid", response="response", index: DenseIndex | None = None) -> DataFrame:
    """(key, reward), the nDCG of the dense run for what a response says
    after the first chat mark (the whole response without one)."""
    r = F.col(response)
    text = F.when(r.contains(CHAT_MARK), F.expr(f"substring({response}, locate('{CHAT_MARK}', {response}) + {len(CHAT_MARK)})")).otherwise(r)
    texts = rollouts.select(key, qid, text.alias("text"))
    return dense_ndcg(texts, docs, qrels, excluded, encode, k, cut, key, qid, index).select(key, F.col("ndcg").alias("reward"))


def gated_dense_reward(rollouts: DataFrame, docs: DataFrame, qrels: DataFrame, excluded: DataFrame, encode, k: int = 1000, cut: int = 10,
                       format_reward: float = 1.0, key="rollout_id", qid="qid", response="response", index: DenseIndex | None = None) -> DataFrame:
    """(key, reward).  A response of the wrong structure gets minus
    ``format_reward`` (only a penalty of 1 ends the scoring) and is not
    searched; else the nDCG of its tagged query (of the response, without
    one).  Rows whose nDCG is 0 are encoded and searched once more with their
    full response, and get half of what that finds."""
    from kestrel.functions.text import THINK_QUERY_TAGS, last_tag_content, split_header, tags_in_order
    from kestrel.session import cut_lineage
    h = split_header(response)
    parsed = cut_lineage(rollouts.select(key, qid, h["processed"].alias("full"),
                                         F.coalesce(last_tag_content(h["processed"], "query"), h["processed"]).alias("query"),
                                         F.coalesce(tags_in_order(h["processed"], THINK_QUERY_TAGS), F.lit(False)).alias("ok")), "gated")
    searched = parsed if abs(format_reward) != 1 else parsed.filter("ok")
    index = index or DenseIndex(docs, order="doc_id")
    first = cut_lineage(dense_ndcg(searched.select(key, qid, F.col("query").alias("text")), docs, qrels, excluded, encode, k, cut, key, qid, index), "gated-first")
    again = searched.join(first.filter(F.col("ndcg") == 0).select(key), key, "left_semi")
    second = dense_ndcg(again.select(key, qid, F.col("full").alias("text")), docs, qrels, excluded, encode, k, cut, key, qid, index)
    both = first.join(second.withColumnRenamed("ndcg", "_full"), key, "left")
    scored = both.select(key, F.when(F.col("ndcg") > 0, F.col("ndcg")).otherwise(F.coalesce("_full", F.lit(0.0)) / 2).alias("reward"))
    if abs(format_reward) != 1:
        return scored
    return scored.unionByName(parsed.filter(~F.col("ok")).select(key, F.lit(-1.0).alias("reward")))


def delta_similarity(pairs: DataFrame, rewritten="rewritten_vec", question="question_vec", doc="doc_vec",
                     key="rollout_id") -> DataFrame:
    """Sum over gold documents of sim(rewritten, d) - sim(question, d)
    (a sum, not a mean), with unit-normalised vectors."""
    d = dot(l2_normalize(rewritten), l2_normalize(doc)) - dot(l2_normalize(question), l2_normalize(doc))
    return pairs.groupBy(key).agg(F.sum(d).alias("delta_reward"), F.count(F.lit(1)).alias("n_docs"))


def bm25_rewards(rollouts: DataFrame, docs: DataFrame, qrels: DataFrame, excluded: DataFrame, key="rollout_id",
                 item="qid", response="response", task="task", doc_key="doc_id", rel="rel", k: int = 1000,
                 at: int = 10, format_reward: float = 1.0, k1: float = 0.9, b: float = 0.4, stem: bool = False) -> DataFrame:
    """(key, ndcg, format_ok, reward) of every rollout whose item has a
    relevant document.  A rollout (key, item, task, response) asks with the
    content of its last query tag, or with all of its response, and is judged
    by its item's ``qrels`` and ``excluded`` (item, doc).  ``docs``: (task, doc,
    tokens), analysed with the same ``stem``."""
    from kestrel.session import cut_lineage
    h = split_header(response)
    ro = rollouts.select(col(key).alias("_key"), col(item).alias("_item"), col(task).alias(task),
                         F.coalesce(last_tag_content(h["processed"], "query"), h["processed"]).alias("text"),
                         tags_in_order(h["processed"], THINK_QUERY_TAGS).alias("format_ok"))
    own = ro.select(F.col("_key").alias("qid"), "_item")
    of_item = lambda df, *cols: df.withColumnRenamed(item, "_item").join(own, "_item").select("qid", *cols)
    ex = cut_lineage(of_item(excluded.select(item, doc_key), doc_key), "excluded")  # read several times
    queries = tokenize(ro.select(F.col("_key").alias("qid"), task, "text"), stem=stem)
    post = cut_lineage(postings(docs, doc_key, task=task))
    stats = cut_lineage(corpus_stats_from_postings(post, docs.select(task, doc_key), doc_key, task))
    qw = query_weights(queries, post, stats, task=task, k1=k1, b=b)
    scores = bm25_top_k(qw, impact_postings(post, stats, k1, b, task), ex, k, "qid", doc_key, task, query_term_rows(queries, task=task), doc_key)
    scores = scores.withColumn("score", F.round("score", 9))
    run = ranked_run(scores, queries, ex, docs.select(task, doc_key), k, "qid", doc_key, task)
    nd = ndcg_at_k(run, of_item(qrels.select(item, doc_key, rel), doc_key, rel), at, "qid", doc_key, rel, task)
    reward = F.col("ndcg") + F.when(F.col("format_ok"), format_reward).otherwise(-format_reward)
    return (ro.join(nd.select(F.col("qid").alias("_key"), "ndcg"), "_key")
            .select(F.col("_key").alias(key), "ndcg", "format_ok", reward.alias("reward")))


def delta_similarity_sets(queries: DataFrame, docs: DataFrame, set_key, key="rollout_id", question="question_vec",
                          rewritten="rewritten_vec", doc="doc_vec") -> DataFrame:
    """R15 where many queries share a gold set (``set_key`` on both sides): the
    sum of a query's similarities is one inner product with the sum of the
    set's unit vectors, so no (query, document) pair is made.  A query whose
    set has no document has no row; documents without a vector count in
    ``n_docs`` alone."""
    n_docs = docs.groupBy(set_key).agg(F.count(F.lit(1)).alias("n_docs"))
    sums = (docs.select(set_key, F.posexplode(l2_normalize(doc)).alias("_i", "_x"))
            .groupBy(set_key, "_i").agg(F.sum("_x").alias("_s"))
            .groupBy(set_key).agg(F.sort_array(F.collect_list(F.struct("_i", "_s"))).alias("_l")))  # an entry per dimension
    sets = n_docs.join(sums.select(set_key, F.transform("_l", lambda e: e["_s"]).alias("_sum")), set_key, "left")
    d = dot(l2_normalize(rewritten), F.col("_sum")) - dot(l2_normalize(question), F.col("_sum"))
    return queries.join(sets, set_key).select(key, d.alias("delta_reward"), "n_docs")


def refresh_vectors(cache: DataFrame, docs: DataFrame, encoder, keys=("task", "doc_id"), text="text") -> DataFrame:
    """Vectors keyed by (keys, content_hash); only documents missing
    from the cache (anti join) are encoded, then unioned with the cache's rows
    of live documents: changed and deleted ones go."""
    keys = list(keys)
    d = docs.withColumn("content_hash", F.sha2(col(text), 256))
    missing = d.join(cache.select(*keys, "content_hash"), [*keys, "content_hash"], "left_anti")
    fresh = missing.select(*keys, "content_hash", encoder(col(text)).alias("vec"))
    live = cache.join(d.select(*keys, "content_hash"), [*keys, "content_hash"], "left_semi")
    return live.select(*keys, "content_hash", "vec").unionByName(fresh)
