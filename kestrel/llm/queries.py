"""Registered queries of the training-data operators: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrel.sources.tables import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.packing import pack
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=0, digest=True)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.langid import identify
    return identify(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.substring import remove_repeats
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op4_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by sampled segmentation, decoded again, and compared."""
    from pyspark.sql import functions as F

    from kestrel.llm.sampled_pieces import decode, encode
    docs, path = read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")
    coded = encode(docs, path, seed=2026).withColumn("ids_crc32", F.crc32("ids"))
    return decode(coded, path).select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.exact import exact_dedup
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents),
g AS (SELECT s, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY s)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.s AS text_sha256 FROM n JOIN g ON n.s = g.s"""


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.pii import pseudonymise
    return pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), key="kestrel")


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.quality_crf import score_quality
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.jaccard import similar_components
    return similar_components(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.rules import quality_rules
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from kestrel.llm.binary_ids import read_ids, work_folder, write_ids
    folder = work_folder(spark, "ids")
    write_ids(read_table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from kestrel.llm.hard_negatives import mine
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved))


OP11_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
             CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id
      WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.mixing import Mix
    return Mix(read_table(spark, sf_dir, "documents"), seed=2026).taken()


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.phrases import collocations
    return collocations(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
      UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
      UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, size, phrase, count(*) AS f, string_split(phrase, ' ') AS x FROM g GROUP BY lang, size, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, f AS a, 1 AS k, x[1] AS p, CASE size WHEN 2 THEN x[2] ELSE x[2] || ' ' || x[3] END AS q FROM c
         UNION ALL SELECT lang, phrase, f, 2, x[1] || ' ' || x[2], x[3] FROM c WHERE size = 3),
s AS (SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
      FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = p JOIN f r ON r.lang = cuts.lang AND r.phrase = q
      QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, unnest([x[1] || ' ' || x[2], x[2] || ' ' || x[3]]) AS phrase, f FROM c WHERE size = 3),
t AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank FROM s
      WHERE NOT EXISTS (SELECT 1 FROM longer g WHERE g.lang = s.lang AND g.phrase = s.phrase AND 100 * g.f >= 50 * s.a))
SELECT t.lang, rank, phrase, a, l, r, n, score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000"""


Q = {
    "op1_best_fit_packing": (op1_best_fit_packing, None),
    "op2_language_id": (op2_language_id, None),
    "op3_substring_dedup": (op3_substring_dedup, None),
    "op4_sampled_pieces": (op4_sampled_pieces, None),
    "op5_exact_dedup": (op5_exact_dedup, OP5_SQL),
    "op6_pseudonyms": (op6_pseudonyms, None),
    "op7_quality_crf": (op7_quality_crf, None),
    "op8_ngram_jaccard": (op8_ngram_jaccard, None),
    "op9_quality_rules": (op9_quality_rules, None),
    "op10_token_files": (op10_token_files, None),
    "op11_hard_negatives": (op11_hard_negatives, OP11_SQL),
    "op12_source_mix": (op12_source_mix, None),
    "op13_collocations": (op13_collocations, OP13_SQL),
}
