"""Quality rules: base counts and robust multivariate outliers (DataFrame functions only).

Every text gets exact counts; from them a short vector of transformed
statistics.  Per language and source the vector's location and scatter are
estimated by the minimum covariance determinant: starting from median and
median absolute deviation, concentration steps refit mean and covariance on
the ``SUPPORT`` part of the group that lies nearest, until ``STEPS`` steps are
done.  A document whose Mahalanobis distance exceeds the cut is rejected.
All estimates are grouped aggregates with map-side combine; the tables of
estimates (one row per language and source) are broadcast up to a checked size
and joined on salted keys beyond it, so no group's rows meet in one task.

Defined results: a null text has no words (counts 0, base_failed); a null
language or source is a group of its own; a group with fewer than MIN_GROUP
rows that pass the base rules is judged by the estimates of its whole language,
and where that has fewer, too, by those of all rows; a table with fewer has
base rules only.  Equal rows get equal verdicts.  An empty table gives an empty
table.  Working columns start with ``__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.session import cut_lineage, drop_tables

WINDOW = 8                     # words of a repeated window
MIN_WORDS, MAX_REPEAT_PCT = 20, 30
SYMBOLS = "#*$%&|<>"
MIN_GROUP = 60                 # rows for estimates of their own
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 256  # estimates sent to every task; a row without its name
SALTS = 64                     # parts of a group where they are more
SUPPORT, STEPS = 0.75, 3       # share of the concentrated subset; concentration steps
#: Statistics: log mean word length; log share of symbols, repeated lines and
#: repeated words (per cent, plus 1).  A floor is the least standard deviation
#: that counts: a document within a few floors of the bulk is never an outlier.
#: Each is so low that its statistic alone can pass the cut in a clean group:
#: log1p(100) / 0.5 (lines) and log1p(MAX_REPEAT_PCT) / 0.5 (words) exceed sqrt(CHI2_CUT).
STATS = ("__s0", "__s1", "__s2", "__s3")
FLOORS = (0.05, 0.35, 0.5, 0.5)
#: Median and 0.9999 quantile of chi-square with 4 degrees of freedom.
CHI2_MEDIAN, CHI2_CUT = 3.3567, 23.513


def with_counts(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Carried columns with ``__n_words, __word_chars, __n_symbols,
    __n_dup_lines, __n_repeat_words, __n_lines`` of each whole text."""
    one = docs.select(*carry, F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    two = one.select(
        *carry,
        F.filter(F.split("__t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("__w"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("__n_symbols"),
        F.length(F.translate("__t", " \t\n\x0b\x0c\r", "")).cast("long").alias("__word_chars"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
    )
    three = two.select(
        *carry, "__n_symbols", "__word_chars",
        F.size("__w").cast("long").alias("__n_words"),
        F.size("__l").cast("long").alias("__n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("__n_dup_lines"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__hw"),
    )
    four = three.withColumn("__h", _windows(F.col("__hw"))).drop("__hw")
    return four.withColumn(
        "__n_repeat_words",
        F.when(F.size(F.array_distinct("__h")) == F.size("__h"), F.lit(0)).otherwise(_covered(F.col("__h"))).cast("long"),
    ).drop("__h")


def _windows(hw: Column) -> Column:
    """A hash for every window of WINDOW words."""
    return F.when(F.size(hw) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(hw) - WINDOW),
                    lambda i: F.xxhash64(*[F.get(hw, i + k) for k in range(WINDOW)])))


def _covered(h: Column) -> Column:
    """Words within windows whose hash the text has twice or more: sort the
    windows, mark equal neighbours, and sum the union of the marked places."""
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    n = F.size(h)
    same = F.zip_with(F.slice(pairs, 1, n - 1), F.slice(pairs, 2, n - 1), lambda a, b: a["h"] == b["h"])
    no = F.array(F.lit(False))
    mark = F.zip_with(F.concat(no, same), F.concat(same, no), lambda a, b: a | b)
    at = F.sort_array(F.array_compact(F.zip_with(pairs, mark, lambda p, m: F.when(m, p["i"]))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))  # words so far, end of the last window
    return F.aggregate(
        at, start,
        lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"), (i + WINDOW).alias("end")),
        lambda s: s["n"])


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PCT * n_words)


def with_stats(counted: DataFrame) -> DataFrame:
    """Add ``__base_failed`` and the transformed statistics STATS."""
    n, lines = F.greatest(F.col("__n_words"), F.lit(1)), F.greatest(F.col("__n_lines"), F.lit(1))
    share = lambda c, d: F.log1p(100.0 * F.col(c) / d)
    return counted.withColumns({
        "__base_failed": base_failed(F.col("__n_words"), F.col("__n_repeat_words")),
        "__s0": F.log(F.greatest(F.col("__word_chars"), F.lit(1)) / n),
        "__s1": share("__n_symbols", n),
        "__s2": share("__n_dup_lines", lines),
        "__s3": share("__n_repeat_words", n),
    })


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky
    factor ``__c{i}{j}`` and the location ``__m{i}``."""
    z: list[Column] = []
    for i in range(p):
        x = F.col(STATS[i]) - F.col(f"__m{i}")
        for j in range(i):
            x = x - F.col(f"__c{i}{j}") * z[j]
        z.append(x / F.col(f"__c{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _cholesky(est: DataFrame, p: int) -> DataFrame:
    """``__v{i}{j}`` (covariance) to its lower factor ``__c{i}{j}``; floors are
    added to the diagonal, so every pivot is positive."""
    for i in range(p):
        for j in range(i + 1):
            x = F.col(f"__v{i}{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                x = x - F.col(f"__c{i}{k}") * F.col(f"__c{j}{k}")
            est = est.withColumn(f"__c{i}{j}", F.sqrt(F.greatest(x, F.lit(FLOORS[i] ** 2))) if i == j else x / F.col(f"__c{j}{j}"))
    return est.select("__group", *[f"__m{i}" for i in range(p)], *[f"__c{i}{j}" for i in range(p) for j in range(i + 1)])


def _with(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Rows of a written table joined to a written table with a row per group.
    The salt is the row's input partition: the same again in a repeated task."""
    n, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(key)), F.lit(0))).first()
    if n * ROW_BYTES + size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key, how)
    parts = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(parts, [key, "__salt"], how).drop("__salt")


def estimates(rows: DataFrame) -> DataFrame:
    """Location and Cholesky factor per ``__group`` by concentration steps."""
    p = len(STATS)
    mid = rows.groupBy("__group").agg(*[F.percentile_approx(s, 0.5, 10000).alias(f"__m{i}") for i, s in enumerate(STATS)])
    mid = cut_lineage(mid, "mcd-median")
    dev = _with(rows, mid, "__group").groupBy("__group").agg(
        *[F.first(f"__m{i}").alias(f"__m{i}") for i in range(p)],
        *[F.percentile_approx(F.abs(F.col(s) - F.col(f"__m{i}")), 0.5, 10000).alias(f"__d{i}") for i, s in enumerate(STATS)])
    for i in range(p):
        for j in range(i + 1):
            dev = dev.withColumn(f"__v{i}{j}", F.pow(1.4826 * F.col(f"__d{i}"), 2) if i == j else F.lit(0.0))
    est = cut_lineage(_cholesky(dev, p), "mcd-start")
    for step in range(STEPS):
        near = _with(rows, est, "__group").select("__group", *STATS, _distance(p).alias("__dist"))
        cut = near.groupBy("__group").agg(F.percentile_approx("__dist", SUPPORT, 10000).alias("__cut"))
        cut = cut_lineage(cut, "mcd-cut")
        fit = _with(near, cut, "__group").filter(F.col("__dist") <= F.col("__cut"))
        est = fit.groupBy("__group").agg(
            *[F.avg(s).alias(f"__m{i}") for i, s in enumerate(STATS)],
            *[F.covar_pop(STATS[i], STATS[j]).alias(f"__v{i}{j}") for i in range(p) for j in range(i + 1)])
        est = cut_lineage(_cholesky(est, p), "mcd-step")
    # scale to chi-square by the median distance; the floors are not shrunk
    med = (_with(rows, est, "__group").select("__group", _distance(p).alias("__dist"))
           .groupBy("__group").agg(F.percentile_approx("__dist", 0.5, 10000).alias("__med")))
    return cut_lineage(est.join(med, "__group").withColumn(
        "__scale", F.greatest(F.col("__med") / CHI2_MEDIAN, F.lit(1.0))).drop("__med"), "mcd")


class Groups:
    """The names of a row's own group (language, source), its language's and that of all rows."""

    ALL = "*"

    def __init__(self, lang_col: str, source_col: str):
        name = lambda source: F.to_json(F.struct(F.col(lang_col).cast("string").alias("l"), source.alias("s")))
        self.own = name(F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-")))
        self.lang = name(F.lit("*"))


def fitted(table: DataFrame, groups: Groups) -> DataFrame:
    """Estimates per own group: ``__own`` and the columns of ``estimates``,
    from ``table`` (written, with counts and statistics)."""
    ok = table.filter(~F.col("__base_failed"))
    sizes = cut_lineage(ok.groupBy(groups.own.alias("__own"), groups.lang.alias("__lang")).agg(F.count(F.lit(1)).alias("__n")), "mcd-sizes")
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    # a row per language and source: the group by whose estimates its rows are judged
    homes = cut_lineage(
        sizes.join(sizes.groupBy("__lang").agg(F.sum("__n").alias("__m")), "__lang")
        .withColumn("__group", F.when(F.col("__n") >= MIN_GROUP, F.col("__own")).when(F.col("__m") >= MIN_GROUP, F.col("__lang"))
                    .when(F.lit(total >= MIN_GROUP), F.lit(groups.ALL)))
        .select("__own", "__lang", "__group").filter(F.col("__group").isNotNull()), "mcd-groups")
    # its rows count in each of its groups that somebody is judged by
    parts = cut_lineage(
        homes.select("__own", F.explode(F.array("__own", "__lang", F.lit(groups.ALL))).alias("__group"))
        .join(homes.select("__group").distinct(), "__group", "left_semi"), "mcd-parts")
    rows = _with(ok.withColumn("__own", groups.own), parts, "__own").select("__group", *STATS)
    return cut_lineage(homes.select("__own", "__group").join(estimates(rows), "__group").drop("__group"), "mcd-own")


def judge(counted: DataFrame, est: DataFrame, groups: Groups) -> DataFrame:
    """Rows with counts and statistics, and their ``__distance2`` and ``__kept``."""
    return (_with(counted.withColumn("__own", groups.own), est, "__own", "left")
            .withColumn("__distance2", _distance(len(STATS)) / F.col("__scale"))
            .withColumn("__kept", ~F.col("__base_failed") & F.coalesce(F.col("__distance2") <= CHI2_CUT, F.lit(True)))
            .select(*counted.columns, "__distance2", "__kept"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, distance2."""
    groups = Groups(lang_col, source_col)
    table = cut_lineage(with_stats(with_counts(docs, text_col, (id_col, lang_col, source_col))), "rules")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
    return judge(table, fitted(table, groups), groups).select(id_col, *[F.col(f"__{n}").alias(n) for n in names])


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns only.
    A verdict depends on text, language and source alone, so rejected rows are
    named by 128 bits of hashes of these, and no text is stored again."""
    groups = Groups(lang_col, source_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.withColumns({"__k1": F.xxhash64(text, groups.own), "__k2": F.xxhash64(groups.own, text)})
    table = cut_lineage(with_stats(with_counts(named, text_col, (lang_col, source_col, "__k1", "__k2"))), "rules")
    rejected = cut_lineage(judge(table, fitted(table, groups), groups).filter(~F.col("__kept")).select("__k1", "__k2").distinct(), "rejected")
    drop_tables(table)
    return named.join(rejected, ["__k1", "__k2"], "left_anti").select(*docs.columns)
