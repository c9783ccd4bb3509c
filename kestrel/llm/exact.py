"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

Every text is normalised (each run of ``[\\x20\\x09-\\x0D]`` becomes one space)
and cut into chunks at places that its own content defines.  Equal chunks get
one identifier, verified on the chunk's text; a document is then the ordered
list of its chunks' identifiers, and only these short lists are grouped and
joined.  Long texts are moved once, as chunks that map-side aggregation has
already made unique within a task.

Defined results: a null text counts as empty (an empty recipe; all empty texts
are equal); text that is only white space is one space and differs from the
empty text; a null id sorts after every other id; of rows equal in id and text
exactly one is kept; an empty table gives an empty table.  Other columns of the
input are neither read nor able to clash: working columns start with ``__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.session import cut_lineage

#: A chunk ends after the first punctuation mark and space that follows its
#: first CHUNK_MIN characters, and at CHUNK_MAX characters at the latest.
CHUNK_MIN, CHUNK_MAX = 512, 8192
CHUNK_PATTERN = f"(?s).{{{CHUNK_MIN},{CHUNK_MAX}}}?[.,;:!?] |.{{1,{CHUNK_MAX}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _chunks(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CHUNK_PATTERN), F.lit(0))


def recipes(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: the carried columns, ``__row`` (a number that is
    fixed once the table is written), ``__sha`` (SHA-256 of the normalised
    text) and ``__recipe`` (identifier candidates of its chunks, in order).
    The result is a written table."""
    norm = docs.select(*carry, normalised(F.col(text_col)).alias("__norm"))
    out = norm.select(
        *carry,
        F.monotonically_increasing_id().alias("__row"),
        F.sha2("__norm", 256).alias("__sha"),
        F.transform(_chunks(F.col("__norm")), lambda c: F.xxhash64(c)).alias("__recipe"),
    )
    return cut_lineage(out, "recipes")


def disputed_chunks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Identifiers that two different chunk texts share (``__chunk_id``): for
    every identifier the least and the greatest chunk text are compared."""
    chunks = (docs.select(F.explode(_chunks(normalised(F.col(text_col)))).alias("__chunk"))
              .select(F.xxhash64("__chunk").alias("__chunk_id"), "__chunk"))
    return (chunks.groupBy("__chunk_id")
            .agg(F.min("__chunk").alias("__least"), F.max("__chunk").alias("__greatest"))
            .filter(F.col("__least") != F.col("__greatest"))
            .select("__chunk_id"))


def assign(table: DataFrame, disputed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Compare recipes: ``table`` with ``keep_id``, ``group_size`` and ``kept``.

    A document with a disputed identifier is compared by the SHA-256 of its
    whole text besides."""
    doubtful = (table.select("__row", F.explode("__recipe").alias("__chunk_id"))
                .join(disputed, "__chunk_id", "left_semi")
                .select("__row").distinct()
                .select("__row", F.lit(True).alias("__doubt")))
    keyed = (table.join(doubtful, "__row", "left")
             .withColumn("__tie", F.when(F.col("__doubt"), F.col("__sha")).otherwise("")).drop("__doubt"))
    first = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("__row").alias("r"))
    groups = (keyed.groupBy("__recipe", "__tie")
              .agg(F.min(first).alias("__first"), F.count(F.lit(1)).alias("group_size")))
    return (keyed.drop("keep_id", "group_size", "kept").join(groups, ["__recipe", "__tie"])
            .withColumn("keep_id", F.col("__first.i"))
            .withColumn("kept", F.col("__row") == F.col("__first.r"))
            .drop("__first", "__tie"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    table = recipes(docs, text_col, (id_col,))
    return (assign(table, disputed_chunks(docs, text_col), id_col)
            .select(id_col, "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept",
                    F.col("__sha").alias("text_sha256")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns only.  The texts
    move once, to meet the list of (id, text hash) that stay."""
    table = recipes(docs, text_col, (id_col,))
    kept = (assign(table, disputed_chunks(docs, text_col), id_col).filter("kept")
            .select(F.col(id_col).alias("__kept_id"), F.col("__sha").alias("__kept_sha")))
    key = (F.col(id_col).eqNullSafe(F.col("__kept_id"))) & (F.col("__sha") == F.col("__kept_sha"))
    found = docs.withColumn("__sha", F.sha2(normalised(F.col(text_col)), 256)).join(kept, key, "left_semi")
    one = F.row_number().over(Window.partitionBy(id_col, "__sha").orderBy("__sha"))  # of rows equal in both
    return found.withColumn("__nth", one).filter(F.col("__nth") == 1).select(*docs.columns)
