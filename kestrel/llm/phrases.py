"""Phrase collocations per language, by Misra-Gries summaries of hash partitions.

1. Every task counts the n-grams (one to three words) of a bounded number of
   words exactly, and sends them to hash partitions of the n-gram: as 32-bit
   keys with counts, and as words with counts.  The number of partitions
   follows the text, so that a partition's mass is bounded.
2. First pass over a partition: the keys go into one Misra-Gries summary.  Its
   capacity exceeds the partition's mass divided by the threshold, so what all
   reductions subtract from a key stays below the threshold, and every n-gram
   that is frequent enough survives.  (Keys that clash only add up.)
3. Second pass: the partition's n-grams whose keys survive are counted exactly,
   as strings.  Both passes stream the same sorted rows; memory holds the
   summary and the surviving n-grams.
4. Frequent n-grams meet their parts' counts by joins; scores are exact whole
   numbers.  A phrase inside a longer one that is frequent enough is dropped.

Defined results: a null text is empty; a null language is ``und``; no phrase
crosses a piece's end or a document; repeated rows count each; one very long
text is read in bounded segments; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.llm.words import BASES, LOWER, PIECE_BYTES, mix, powers, utf8
from kestrel.session import cut_lineage

PART_BYTES = 1 << 24      # bytes of text for one hash partition of n-grams
FLUSH_WORDS = 750_000     # words whose n-grams a task counts together
ID_BITS = 21              # of a word's number among them
MERGE = 1 << 18           # keys, or n-grams, gathered before they are summed: or as many as the sum has
MASS, KEYS, WORDS = 0, 1, 2  # kinds of rows, in the order they are read
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SENT_BYTES = 4 << 20      # of rows sent to Python together
NONE = (1 << ID_BITS) - 1
SHIFTS = (np.uint64(2 * ID_BITS), np.uint64(ID_BITS), np.uint64(0))
CHUNK = 1 << 19           # n-grams keyed together
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(10, 14)]] = True
GAPS = BREAKS.copy()
GAPS[[32, 9]] = True
ROWS = "lang string, part int, kind int, mass long, n_words long, head binary, body binary"


def span_hashes(raw: np.ndarray, solid: np.ndarray, begin: np.ndarray, seeds: int) -> list[np.ndarray]:
    """Hashes of the words that start at ``begin`` and end before the next gap."""
    if not begin.size:
        return [np.zeros(0, np.uint64) for _ in range(seeds)]
    at = begin - begin[0]
    code = raw[begin[0]:].astype(np.uint64) + np.uint64(1)
    code[~solid[begin[0]:]] = 0
    size = np.diff(np.append(begin, len(raw)))
    place = np.arange(len(code)) - np.repeat(at, size)
    length = np.add.reduceat(solid[begin[0]:].astype(np.int64), at).astype(np.uint64)
    longest = int(size.max())
    return [mix(np.add.reduceat(code * powers(longest, BASES[k])[place], at) + length * np.uint64(0xD6E8FEB86659FD93)) for k in range(seeds)]


def gram_keys(hashes: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    """64-bit keys of n-grams, from the hashes of their words."""
    key = np.zeros(len(ids[0]), np.uint64)
    for i in ids:
        key = mix(key * BASES[0] + hashes[i] + np.uint64(len(ids)))
    return key


def numbered(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words by both hashes, and a place of each distinct word."""
    order = np.argsort(h1)
    a, b = h1[order], h2[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs (1, 2, 4 or 8)."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def widened(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"<u{len(blob) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def parcels(*blobs: bytes) -> bytes:
    return np.array([len(blobs), *map(len, blobs)], "<u4").tobytes() + b"".join(blobs)


def opened(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(blob, "<u4", n, 4).astype(np.int64))
    return [blob[a:b] for a, b in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte: equal high bytes lie together."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Counter:
    """N-grams of up to FLUSH_WORDS words: counted, keyed and dealt to partitions."""

    def __init__(self, parts: int):
        self.parts = parts
        self.clear()

    def clear(self) -> None:
        """Begin anew, with the two last words: n-grams reach across."""
        carried = self.last_words() if getattr(self, "held", 0) else None
        self.h1, self.h2, self.piece, self.lang = [], [], [], []
        self.words: list[pa.Array] = []
        self.known: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.carried = 0
        self.names: dict[str, int] = {}
        if carried:
            h1, h2, piece, names, words = carried
            lang = np.array([self.names.setdefault(x, len(self.names)) for x in names], np.int64)
            for kept, x in ((self.h1, h1), (self.h2, h2), (self.piece, piece), (self.lang, lang)):
                kept.append(x)
            self.words.append(words)
            self.known.append((h1, h2))
            self.held = self.carried = len(h1)

    def last_words(self) -> tuple:
        """The two last words: hashes, pieces, languages and strings."""
        h1, h2, piece, lang = (np.concatenate(x[-2:])[-2:] for x in (self.h1, self.h2, self.piece, self.lang))
        known = [np.concatenate(x) for x in zip(*self.known, strict=True)]
        place = [int(np.flatnonzero((known[0] == a) & (known[1] == b))[0]) for a, b in zip(h1, h2, strict=True)]
        names = list(self.names)
        words = pa.chunked_array(self.words).take(pa.array(place)).combine_chunks()
        return h1, h2, piece, [names[k] for k in lang], words

    def add(self, raw: np.ndarray, piece: np.ndarray, begin: np.ndarray, solid: np.ndarray, lang: np.ndarray) -> None:
        """Words of one segment (lower-cased bytes): their places, pieces and languages."""
        h1, h2 = span_hashes(raw, solid, begin, 2)
        _, first = numbered(h1, h2)
        size = np.add.reduceat(solid[begin[0]:].astype(np.int64), begin - begin[0])[first]
        ends = np.cumsum(size)
        take = np.arange(int(ends[-1])) + np.repeat(begin[first] - (ends - size), size)
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        self.words.append(pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[take])]))
        self.known.append((h1[first], h2[first]))
        for kept, x in ((self.h1, h1), (self.h2, h2), (self.piece, piece), (self.lang, lang)):
            kept.append(x)
        self.held += len(begin)

    def rows(self) -> Iterator[tuple]:
        """Rows of ROWS for everything held; then it begins anew."""
        if self.held == self.carried:
            self.clear()
            return
        number, first = numbered(np.concatenate(self.h1), np.concatenate(self.h2))
        hashes = np.concatenate(self.h1)[first]
        _, place = numbered(*(np.concatenate(x) for x in zip(*self.known, strict=True)))
        words = pa.chunked_array(self.words).combine_chunks().take(pa.array(place))  # both numberings follow the hashes
        piece, lang, names, carried = np.concatenate(self.piece), np.concatenate(self.lang), list(self.names), self.carried
        self.clear()
        order = np.argsort(lang, kind="stable")
        number, piece, lang, fresh = number[order].astype(np.uint32), piece[order], lang[order], order >= carried
        del order, first, place
        cuts = [0, *(np.flatnonzero(np.diff(lang)) + 1).tolist(), len(lang)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield from self._language(names[lang[a]], number[a:b], piece[a:b], fresh[a:b], hashes, words)

    def _language(self, lang: str, number: np.ndarray, piece: np.ndarray, fresh: np.ndarray, hashes: np.ndarray, words: pa.Array) -> Iterator[tuple]:
        packed, count = _counted(number, piece, fresh)
        if not len(packed):
            return
        place = np.empty(len(packed), np.uint64)  # partition and 32-bit key
        for at in range(0, len(packed), CHUNK):
            some = packed[at:at + CHUNK]
            ids, size = _ids(some)
            key = np.empty(len(some), np.uint64)
            for k in (1, 2, 3):
                own = size == k
                key[own] = gram_keys(hashes, [i[own] for i in ids[:k]])
            place[at:at + CHUNK] = (key % np.uint64(self.parts)) << np.uint64(32) | key >> np.uint64(32)
        order = np.argsort(place)
        packed, count, place = packed[order], count[order], place[order]
        del order
        bounds = np.searchsorted(place, np.arange(self.parts + 1, dtype=np.uint64) << np.uint64(32))
        seen, local = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.uint32)
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            own = slice(bounds[p], bounds[p + 1])
            (ids, size), n = _ids(packed[own]), count[own]
            yield lang, p, MASS, int(n.sum()), int(n[size == 1].sum()), None, None
            yield lang, p, KEYS, None, None, planes(np.diff(place[own] & np.uint64(0xFFFFFFFF), prepend=np.uint64(0))), narrow(n)
            turn = np.argsort(size, kind="stable")
            sizes = np.bincount(size, minlength=4)[1:]
            cols = [ids[j][turn][sizes[:j].sum():] for j in range(3)]
            for c in cols:
                seen[c] = True
            used = np.flatnonzero(seen)
            seen[used] = False
            local[used] = np.arange(len(used))
            some = words.take(pa.array(used))
            lengths = pc.binary_length(some).to_numpy()
            text = some.buffers()[2].to_pybytes()[:int(lengths.sum())]
            kind = "<u2" if len(used) <= 1 << 16 else "<u4"
            yield (lang, p, WORDS, None, None, parcels(np.array([len(used)], "<u4").tobytes(), narrow(lengths), text),
                   parcels(sizes.astype("<u4").tobytes(), *[local[c].astype(kind).tobytes() for c in cols], narrow(n[turn])))


def _counted(number: np.ndarray, piece: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as three word numbers in 63 bits, and how often each occurs."""
    two, three = (piece[1:] == piece[:-1]) & fresh[1:], (piece[2:] == piece[:-2]) & fresh[2:]
    w, none = number.astype(np.uint64), np.uint64(NONE)
    packed = np.concatenate([w[fresh] << SHIFTS[0] | none << SHIFTS[1] | none,
                             w[:-1][two] << SHIFTS[0] | w[1:][two] << SHIFTS[1] | none,
                             w[:-2][three] << SHIFTS[0] | w[1:-1][three] << SHIFTS[1] | w[2:][three]])
    del w
    packed.sort()
    at = np.flatnonzero(np.concatenate([np.ones(min(len(packed), 1), bool), packed[1:] != packed[:-1]]))
    return packed[at], np.diff(np.append(at, len(packed))).astype(np.uint32)


def _ids(packed: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Word numbers of packed n-grams, and how many words each has."""
    ids = [(packed >> s & np.uint64(NONE)).astype(np.uint32) for s in SHIFTS]
    return ids, 1 + (ids[1] != NONE) + (ids[2] != NONE)


def segments(raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of the rows' bytes at row bounds or gaps, at most PIECE_BYTES apart but for longer words."""
    at, end = int(bounds[0]), int(bounds[-1])
    while at < end:
        cut = min(at + PIECE_BYTES, end)
        while cut < end:
            back = np.flatnonzero(GAPS[raw[at:cut]])
            row = int(bounds[np.searchsorted(bounds, cut, side="right") - 1])
            best = max(at + int(back[-1]) + 1 if back.size else at, row)
            if best > at:
                cut = best
                break
            cut = min(cut + PIECE_BYTES, end)
        yield at, cut
        at = cut


def count_rows(docs: DataFrame, lang_col: str, text_col: str, parts: int) -> DataFrame:
    """ROWS of all documents."""

    def run(batches):
        counter, pieces = Counter(parts), 0
        for batch in batches:
            langs = batch.column(0).fill_null("und").dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            raw, bounds = utf8(batch.column(1))
            for a, b in segments(raw, bounds):
                part = LOWER[raw[a:b]]
                solid = ~GAPS[part]
                breaks = BREAKS[part].astype(np.int64)
                rows = bounds[np.searchsorted(bounds, a):np.searchsorted(bounds, b)] - a
                edge = solid.copy()
                edge[1:] &= ~solid[:-1]
                edge[rows] = solid[rows]
                breaks[rows] += 1
                begin = np.flatnonzero(edge)
                piece = pieces + np.cumsum(breaks)
                if begin.size:
                    of = np.searchsorted(bounds, begin + a, side="right") - 1
                    number = np.array([counter.names.setdefault(x, len(counter.names)) for x in names], np.int64)
                    counter.add(part, piece[begin], begin, solid, number[code[of]])
                pieces = int(piece[-1])
                if counter.held >= FLUSH_WORDS:
                    yield from table(counter)
        yield from table(counter)

    def table(counter):
        rows, held = [], 0
        for r in counter.rows():
            rows.append(r)
            held += len(r[5] or b"") + len(r[6] or b"")
            if held > 4 << 20:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)
        pa.default_memory_pool().release_unused()

    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["lang", "part", "kind", "mass", "n_words", "head", "body"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col(lang_col).cast("string"), F.col(text_col)).mapInArrow(run, ROWS)


class Summary:
    """A Misra-Gries summary of weighted keys that never subtracts ``threshold``."""

    def __init__(self, mass: int, threshold: int):
        self.capacity = mass // threshold + 1
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held >= max(MERGE, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        """Sum what waits; beyond the capacity, subtract the first count that is too many from all."""
        if not self.waiting:
            return
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.held = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[at], np.add.reduceat(counts, at) if len(at) else counts
        if len(keys) > self.capacity:
            counts = counts - np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1]
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts


def surviving(head: bytes, body: bytes, keys: np.ndarray) -> pa.Table:
    """(phrase, size, f) of the n-grams of one row whose keys survived."""
    n_words, lengths, text = opened(head)
    sizes, *cols, counts = opened(body)
    sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
    n = int(sizes.sum())
    counts = widened(counts, n)
    ids = [np.frombuffer(c, f"<u{len(cols[0]) // n}").astype(np.int64) for c in cols]
    lengths = widened(lengths, int(np.frombuffer(n_words, "<u4")[0]))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    words = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text)])
    raw = np.frombuffer(text, np.uint8)
    (hashes,) = span_hashes(raw, np.ones(len(raw), bool), offsets[:-1], 1)
    out = []
    first = 0
    for k in (1, 2, 3):
        last = first + int(sizes[k - 1])
        own = [ids[j][first - int(sizes[:j].sum()):last - int(sizes[:j].sum())] for j in range(k)]
        short = (gram_keys(hashes, own) >> np.uint64(32)).astype(np.uint32)
        at = np.searchsorted(keys, short)
        hit = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, max(len(keys) - 1, 0))] == short)) if len(keys) else np.zeros(0, np.int64)
        parts = [words.take(pa.array(i[hit])) for i in own]
        phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        out.append(pa.table([phrase, pa.array(np.full(len(hit), k, np.int32)), pa.array(counts[first:last][hit])], ["phrase", "size", "f"]))
        first = last
    return pa.concat_tables(out)


def summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["phrase", "size"]).aggregate([("f", "sum")]).rename_columns(["phrase", "size", "f"])


def frequent(rows: DataFrame, threshold: int) -> DataFrame:
    """(lang, phrase, size, f) of all n-grams with f >= threshold, and rows
    with a null phrase whose f add up to a language's words."""

    def run(batches):
        key = mass = words = summary = None
        found: list[pa.Table] = []
        held = 0

        def done():
            out = []
            if found:
                t = summed(found)
                t = t.filter(pc.greater_equal(t["f"], threshold))
                out.append(pa.table([pa.array([key[0]] * len(t), pa.string()), t["phrase"].cast(pa.string()), t["size"], t["f"]], ["lang", "phrase", "size", "f"]))
            out.append(pa.table([pa.array([key[0]], pa.string()), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([words], pa.int64())],
                                ["lang", "phrase", "size", "f"]))
            for t in out:
                yield from t.to_batches(max_chunksize=1 << 16)

        for batch in batches:
            for r in range(batch.num_rows):
                lang, part, kind, m, w, head, body = (batch.column(c)[r].as_py() for c in range(7))
                if (lang, part) != key:
                    if key is not None:
                        yield from done()
                    key, mass, words, summary, found, held = (lang, part), 0, 0, None, [], 0
                if kind == MASS:
                    mass, words = mass + m, words + w
                    continue
                if summary is None:
                    summary = Summary(mass, threshold)
                if kind == KEYS:
                    keys = np.cumsum(unplanes(head).astype(np.int64)).astype(np.uint32)
                    summary.add(keys, widened(body, len(keys)))
                    continue
                summary.merge()
                t = surviving(head, body, summary.keys)
                found.append(t)
                held += len(t)
                if held >= max(MERGE, len(found[0])):
                    found = [summed(found)]
                    held = 0
        if key is not None:
            yield from done()

    return rows.mapInArrow(run, "lang string, phrase string, size int, f long")


def collocations(docs: DataFrame, threshold: int = 10, inside_pct: int = 50, first: int = 2000,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's ``first`` phrases: lang, rank, phrase, a, l, r, n, score."""
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0
    parts = max(1, -(-size // PART_BYTES))
    rows = count_rows(docs, lang_col, text_col, parts).repartition("lang", "part").sortWithinPartitions("lang", "part", "kind")
    spark = docs.sparkSession
    before = spark.conf.get(ARROW_BYTES, None)
    spark.conf.set(ARROW_BYTES, str(SENT_BYTES))  # the rows of a partition are long: few at a time
    try:
        counts = cut_lineage(frequent(rows, threshold), "phrases")
    finally:
        spark.conf.set(ARROW_BYTES, before) if before else spark.conf.unset(ARROW_BYTES)
    grams = counts.filter(F.col("phrase").isNotNull())
    totals = counts.filter(F.col("phrase").isNull()).groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked(scored(grams, inside_pct), totals, first)


def scored(grams: DataFrame, inside_pct: int) -> DataFrame:
    """A written table (lang, phrase, a, l, r, score) of the candidates that stay."""
    w = F.split("phrase", " ")
    join = lambda *i: F.concat_ws(" ", *[F.get(w, F.lit(k)) for k in i])
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    phrases = grams.filter(F.col("size") > 1)
    longer = (phrases.filter(F.col("size") == 3).select("lang", F.explode(F.array(join(0, 1), join(1, 2))).alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    stay = (phrases.join(longer, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (100 * F.col("longer") < inside_pct * F.col("f"))))
    cuts = stay.withColumn("cut", F.explode(F.when(F.col("size") == 2, F.array(cut(1, join(0), join(1))))
                                            .otherwise(F.array(cut(1, join(0), join(1, 2)), cut(2, join(0, 1), join(2))))))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "cut.k", "cut.left", "cut.right")
    known = lambda word, f: grams.filter(F.col("size") < 3).select("lang", F.col("phrase").alias(word), F.col("f").alias(f))
    both = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"])
    long = lambda c: F.col(c).cast("decimal(18,0)")
    both = both.withColumns({"over": long("a") * long("a") * F.lit(1_000_000).cast("decimal(7,0)"), "under": long("l") * long("r")})
    both = both.withColumn("score", F.expr("over div under").cast("long"))
    least = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return cut_lineage(least.select("lang", "phrase", "a", "m.l", "m.r", "m.score"), "phrases-scored")


def ranked(scores: DataFrame, totals: DataFrame, first: int) -> DataFrame:
    """The first of each language.  The last (score, a) that can be among them
    is found without phrases, so ties are never gathered in one task."""
    by = [F.desc("score"), F.desc("a")]
    per = Window.partitionBy("lang")
    edge = (scores.select("lang", "score", "a").withColumn("i", F.row_number().over(per.orderBy(*by))).filter(F.col("i") <= first)
            .groupBy("lang").agg(F.min(F.struct("score", "a")).alias("edge")))
    top = scores.join(edge, "lang").filter(F.struct("score", "a") >= F.col("edge"))
    return (top.withColumn("rank", F.row_number().over(per.orderBy(*by, "phrase")).cast("long")).filter(F.col("rank") <= first)
            .join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
