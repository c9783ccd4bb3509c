"""Substring deduplication: words within repeated passages are removed.

A window is ``width`` consecutive words of a text; every word of a window
whose words occur again anywhere is removed.  All windows are judged on the
input.  Recompression (see ``recompression``) makes this cheap and exact:

1. Every text is parsed.  *Checks* are small symbols whose context fits in a
   window: where a window occurs again, so does each check inside it.  Windows
   without a check among FINE_ROUNDS symbols get smaller ones.  *Blocks* are
   high-level symbols of at least ``width`` words: equal blocks are equal
   passages, and all windows inside are repeated.  A block carries a second
   name, a hash of its own words, so 128 bits say that two blocks are equal.
2. One shuffle on the symbols' names finds those that occur twice.  Within a
   slice of a task equal names are merged first, so a passage that a third of
   all documents share is a row per slice, not per document.
3. Only windows all of whose checks are repeated can be repeated.  Those
   inside a repeated block are repeated; they are sent on for one occurrence
   of the block alone, for windows outside to be compared with.  The others
   are sent as two hashes (96 bits) and compared exactly once more.
4. The windows found go back to their texts, whose other words are joined.

Rows are told apart by 96 bits of hashes of id and text, so rows equal in both
share their (equal) results.

Defined results: a null text has no words; fewer words than ``width`` leave a
text as it is; runs and periodic texts are treated like any other (a window
may repeat overlapping itself); repeated rows repeat all their windows; texts
of any length are whole; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.llm.recompression import Parse, parse, words_parse
from kestrel.llm.words import BASES, mix, utf8, word_batches, word_spans
from kestrel.session import cut_lineage, drop_tables

WIDTH = 35
FINE_ROUNDS, FINE_WORDS, FINER_ROUNDS = 7, 12, 5
BLOCK_ROUNDS = 18
CHECK, BLOCK, OPEN = 1, 2, 3  # kinds of symbol rows; OPEN: a text with windows that have no check
JOIN_WORDS = 1 << 18  # words joined at a time


def checks_and_blocks(names: np.ndarray, counts: np.ndarray, width: int) -> tuple[Parse, np.ndarray, np.ndarray, np.ndarray, Parse]:
    """Checks, their number within the text, which of them are small ones;
    the windows (by first word) that only small ones can judge; and blocks."""
    words = words_parse(names, counts)
    low = parse(words, 0, FINER_ROUNDS, FINE_WORDS)
    mid = parse(low, FINER_ROUNDS, FINE_ROUNDS, FINE_WORDS)
    fits = lambda p: np.flatnonzero(p.right - p.left <= width)
    take = lambda p, k: Parse(*(x[k] for x in (p.name, p.start, p.size, p.text, p.left, p.right)))
    fine = take(mid, fits(mid))
    ends = np.cumsum(counts)
    bare = (np.arange(len(names)) + width <= ends[words.text]) & ~_excluded(fine.left, fine.right, width, len(names))
    # smaller checks within windows that have none: one whose context lies in such a window
    some = np.concatenate([[0], np.cumsum(bare)])
    finer = take(low, fits(low))
    lo, hi = np.maximum(finer.right - width, 0), np.minimum(finer.left, len(names) - 1)
    finer = take(finer, np.flatnonzero((hi >= lo) & (some[np.maximum(hi, -1) + 1] > some[lo])))
    text = np.concatenate([fine.text, finer.text])
    order = np.argsort(text, kind="stable")
    both = Parse(*(np.concatenate(x)[order] for x in zip(*((p.name, p.start, p.size, p.text, p.left, p.right) for p in (fine, finer)), strict=True)))
    small = (np.arange(len(text)) >= len(fine.text))[order]
    nth = np.arange(len(both.text)) - np.searchsorted(both.text, both.text)
    top = parse(mid, FINE_ROUNDS, BLOCK_ROUNDS)
    return both, nth, small, bare, take(top, np.flatnonzero(top.size >= width))


def _excluded(left: np.ndarray, right: np.ndarray, width: int, n: int) -> np.ndarray:
    """Starts of the windows that contain one of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(right - width, 0), 1)
    np.add.at(change, np.minimum(left, n - 1) + 1, -1)
    return np.cumsum(change)[:n] > 0


def _spans_mask(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change)[:n] > 0


def _again(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: is it the first with its keys; do its keys occur again."""
    n = len(keys[0])
    order = np.lexsort(keys[::-1])  # stable: equal keys stay in order
    change = np.ones(n, bool)
    if n:
        change[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    start = np.flatnonzero(change)
    count = np.diff(np.append(start, n))
    is_first, again = np.zeros(n, bool), np.zeros(n, bool)
    is_first[order[start]] = True
    again[order] = np.repeat(count > 1, count)
    return is_first, again


def _span_hashes(h: np.ndarray, base: np.uint64, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits of the words of each span, whatever its place."""
    n = len(h)
    power = np.full(n + 1, base, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    back = np.full(n + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
    back[0] = 1
    back = np.cumprod(back, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)])
    return mix((sums[start + size] - sums[start]) * back[start])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Row names (``rk``, ``ck``), id and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(F.col(id_col), text).alias("rk"), F.hash(text, F.col(id_col)).alias("ck"), F.col(id_col).alias("id"), text.alias("text"))


def symbol_rows(rows: DataFrame, width: int) -> DataFrame:
    """A written table.  ``kind`` 0: a document with its words and the hash of
    all of them.  Else a symbol occurrence: name, second name (0 for checks), at, size; ``again`` where the
    slice has the name twice; ``first`` where it has to be looked up."""
    kind = rows.schema["id"].dataType.simpleString()
    fields = ["kind", "rk", "ck", "id", "n_words", "sha", "name", "second", "at", "size", "again", "first"]

    def run(batches):
        for batch in batches:
            rk, ck, ids = batch.column(0), batch.column(1), batch.column(2)
            raw, bounds = utf8(batch.column(3))
            for a, b, (names, others), counts in word_batches(batch.column(3), seeds=2):
                m = b - a
                begin, size, _ = word_spans(raw, bounds[a:b + 1])
                cut = np.concatenate([[0], np.cumsum(counts)])
                shas = [sha_of(raw, begin[cut[k]:cut[k + 1]], size[cut[k]:cut[k + 1]]) for k in range(m)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(m, np.int32)), rk.slice(a, m), ck.slice(a, m), ids.slice(a, m), pa.array(counts.astype(np.int64)), pa.array(shas),
                     pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.bool_())], fields)
                checks, nth, _, _, blocks = checks_and_blocks(names, counts, width)
                for what, p, at in ((CHECK, checks, nth), (BLOCK, blocks, blocks.start - cut[blocks.text])):
                    k = len(p.name)
                    if not k:
                        continue
                    # a check only sends windows on; a block decides, so its words vouch for its name
                    second = _span_hashes(others, BASES[1], p.start, p.size) if what == BLOCK else np.zeros(k, np.uint64)
                    first, again = _again(p.name, second) if what == BLOCK else _again(p.name)
                    row = pa.array(p.text + a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, what, np.int32)), rk.take(row), ck.take(row), pa.nulls(k, ids.type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()),
                         pa.array(mix(p.name + np.uint64(what)).view(np.int64)), pa.array(second.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(p.size.astype(np.int32)), pa.array(again), pa.array(first)], fields)

                open_at = (np.arange(len(names)) + width <= cut[1:][np.repeat(np.arange(m), counts)]) & ~_excluded(checks.left, checks.right, width, len(names))
                row = pa.array(np.unique(np.repeat(np.arange(m), counts)[open_at]) + a)
                k = len(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, OPEN, np.int32)), rk.take(row), ck.take(row), pa.nulls(k, ids.type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()),
                     pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.array([True] * k, pa.bool_()), pa.array([False] * k, pa.bool_())], fields)

    schema = f"kind int, rk long, ck int, id {kind}, n_words long, sha string, name long, second long, at int, size int, again boolean, first boolean"
    return cut_lineage(rows.mapInArrow(run, schema), "symbols", "zstd")


def repeated_symbols(symbols: DataFrame) -> DataFrame:
    """(kind, rk, ck, at, size, alone) of the occurrences of names that occur
    twice; ``alone`` is the one occurrence that stands for its name."""
    found = symbols.filter(F.col("kind") > 0).select("kind", "rk", "ck", "at", "size", "name", "second", "again", "first")
    same = Window.partitionBy("name", "second").orderBy("rk", "ck", "at")
    looked = (found.filter("first")
              .withColumns({"__before": F.lag("kind").over(same), "__after": F.lead("kind").over(same)})
              .filter(F.col("again") | F.col("__before").isNotNull() | F.col("__after").isNotNull())
              .withColumn("alone", F.col("__before").isNull()))
    rest = found.filter(~F.col("first")).withColumn("alone", F.lit(False))
    cols = ["kind", "rk", "ck", "at", "size", "alone"]
    return looked.select(*cols).unionByName(rest.select(*cols))


def _window_hashes(words: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of each window's words, whatever its place."""
    start = np.arange(max(0, len(words[0]) - width + 1))
    w1, w2 = (_span_hashes(h, base, start, width) for h, base in zip(words, BASES, strict=True))
    return w1, (w2 >> np.uint64(32)).astype(np.uint32)


def candidate_rows(rows: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """A written table of the documents with windows that are repeated, or may
    be: text, starts and ends of runs of windows known to be repeated, and the
    windows to look up (at, w1, w2, again)."""
    fields = ["rk", "ck", "text", "from", "to", "at", "w1", "w2", "again"]

    def run(batches):
        for batch in batches:
            for a, b, words, counts in word_batches(batch.column(2), seeds=2):
                n, ends = len(words[0]), np.cumsum(counts)
                begin = ends - counts
                if not n:
                    continue
                checks, _, small, bare, _ = checks_and_blocks(words[0], counts, width)
                known = batch.column(3).slice(a, b - a)
                blocks = batch.column(4).slice(a, b - a).to_pylist()
                base = np.searchsorted(checks.text, np.arange(b - a))
                flat = known.flatten().to_numpy(zero_copy_only=False)
                many = np.array([0 if v is None else v for v in known.value_lengths().to_pylist()], np.int64)
                repeated = np.zeros(len(checks.name), bool)
                repeated[np.repeat(base, many) + flat] = True
                odd, tiny = ~repeated & ~small, ~repeated & small
                text = np.repeat(np.arange(b - a), counts)
                may = (np.arange(n) + width <= ends[text]) & ~_excluded(checks.left[odd], checks.right[odd], width, n)
                may &= ~(bare & _excluded(checks.left[tiny], checks.right[tiny], width, n))
                spans = [(begin[k] + x["at"], begin[k] + x["at"] + x["size"] - width + 1, x["alone"]) for k, own in enumerate(blocks) for x in own or []]
                lo, hi, alone = (np.array(x) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 3
                inside = _spans_mask(lo, hi, n)
                # what stands for a block is looked up, also where a repeat of the row has it as another occurrence
                covered = _spans_mask(lo[alone == 0], hi[alone == 0], n) & ~_spans_mask(lo[alone == 1], hi[alone == 1], n)
                look = np.flatnonzero(may & ~covered)
                w1, w2 = _window_hashes(words, width)
                first, again = _again(w1[look], w2[look])
                inside[look[again]] = True
                again |= inside[look]
                look, again = look[first], again[first]
                edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
                edge_at = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                run_text = text[edge_at[0]] if edge_at[0].size else np.zeros(0, np.int64)
                r0, r1 = np.searchsorted(run_text, np.arange(b - a)), np.searchsorted(run_text, np.arange(b - a), side="right")
                c0, c1 = np.searchsorted(look, begin), np.searchsorted(look, ends)
                keep = np.flatnonzero((r1 > r0) | (c1 > c0))
                for some in np.array_split(keep, max(1, len(keep) // 256)):
                    lists = [[], [], [], [], [], []]
                    for k in some:
                        r, c = slice(r0[k], r1[k]), slice(c0[k], c1[k])
                        for out, values in zip(lists, ((edge_at[0][r] - begin[k]).astype(np.int32), (edge_at[1][r] - begin[k]).astype(np.int32),
                                                       (look[c] - begin[k]).astype(np.int32), w1[look[c]].view(np.int64), w2[look[c]].view(np.int32), again[c]), strict=True):
                            out.append(values)
                    at = pa.array(some + a)
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), *(pa.array(x, pa.list_(t)) for x, t in zip(lists, kinds, strict=True))], fields)

    # sets: the repeats of a row have the same marks
    checks = F.array_sort(F.collect_set(F.when(F.col("kind") == CHECK, F.col("at")))).alias("checks")
    blocks = F.collect_set(F.when(F.col("kind") == BLOCK, F.struct("at", "size", "alone"))).alias("blocks")
    found = marks.groupBy("rk", "ck").agg(checks, blocks)
    schema = "rk long, ck int, text string, `from` array<int>, `to` array<int>, at array<int>, w1 array<long>, w2 array<int>, again array<boolean>"
    return cut_lineage(rows.select("rk", "ck", "text").join(found, ["rk", "ck"]).mapInArrow(run, schema), "candidates", "zstd")


def sha_of(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> str:
    """SHA-256 of the words joined by one space."""
    digest = hashlib.sha256()
    for s in range(0, len(begin), JOIN_WORDS):
        at, n = begin[s:s + JOIN_WORDS], size[s:s + JOIN_WORDS] + 1  # a space before every word
        ends = np.cumsum(n)
        out = raw[np.maximum(np.arange(int(ends[-1])) + np.repeat(at - 1 - (ends - n), n), 0)]
        out[ends - n] = 32
        digest.update(out[1 if s == 0 else 0:].tobytes())
    return digest.hexdigest()


def removed_rows(candidates: DataFrame, hits: DataFrame, width: int) -> DataFrame:
    """(rk, ck, n_removed, kept_sha256) and the kept text's word numbers."""
    def run(batches):
        for batch in batches:
            raw, bounds = utf8(batch.column(2))
            get = lambda k: batch.column(k).to_pylist()
            removed, shas = [], []
            for k, (start, end, at) in enumerate(zip(get(3), get(4), get(5), strict=True)):
                begin, size, _ = word_spans(raw, bounds[k:k + 2])
                at = np.array(at or [], np.int64)
                gone = _spans_mask(np.concatenate([np.array(start, np.int64), at]), np.concatenate([np.array(end, np.int64), at + 1]) + width - 1, len(begin))
                removed.append(int(gone.sum()))
                shas.append(sha_of(raw, begin[~gone], size[~gone]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["rk", "ck", "n_removed", "kept_sha256"])

    joined = candidates.select("rk", "ck", "text", "from", "to").join(hits, ["rk", "ck"], "left")
    return joined.mapInArrow(run, "rk long, ck int, n_removed long, kept_sha256 string")


def repeated_windows(candidates: DataFrame) -> DataFrame:
    """(rk, ck, hits): starts of looked-up windows that occur elsewhere."""
    each = candidates.select("rk", "ck", F.inline(F.arrays_zip("at", "w1", "w2", "again")))
    same = Window.partitionBy("w1", "w2").orderBy("rk", "ck", "at")
    return (each.withColumns({"__before": F.lag("at").over(same), "__after": F.lead("at").over(same)})
            .filter(~F.col("again") & (F.col("__before").isNotNull() | F.col("__after").isNotNull()))
            .groupBy("rk", "ck").agg(F.collect_set("at").alias("hits")))


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of every document."""
    rows = _rows(docs, id_col, text_col)
    symbols = symbol_rows(rows, width)
    every = cut_lineage(symbols.filter(F.col("kind") == 0).select("rk", "ck", "id", "n_words", "sha"), "words", "zstd")
    marks = cut_lineage(repeated_symbols(symbols), "marks", "zstd")  # before the texts move
    drop_tables(symbols)
    candidates = candidate_rows(rows, marks, width)
    drop_tables(marks)
    hits = cut_lineage(repeated_windows(candidates), "hits", "zstd")
    removed = cut_lineage(removed_rows(candidates, hits, width).dropDuplicates(["rk", "ck"]), "removed", "zstd")
    drop_tables(candidates, hits)
    return every.join(removed, ["rk", "ck"], "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
