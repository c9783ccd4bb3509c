"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities for the pieces of one fixed public
vocabulary.  A word's probability is the sum over all its segmentations into
pieces (forward algorithm on the piece lattice), a text's the product over its
words; the prediction is the language with the greatest sum of logs, and the
score its share among the languages.

Learning: words are counted per language over every learning row (map-side
counts, one shuffle of distinct words).  Expectation maximisation then runs
over that table; each round sums expected piece counts, so at most one number
per piece and language reaches the driver, whatever the corpus.  Words of
equal spelling are scored once per worker (a bounded memo).

Defined results: a null text, or one without a letter, is ``und`` with score
0; without any learning row everything is ``und``; words are the runs of
letters, in lower case, of whole texts of any length; ties go to the language
first in sorted order; repeated rows are scored alike; an empty table gives an
empty table.  Language, source and id are no inputs of a prediction.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.lattice import MARK, Vocabulary, code_points, expected_pieces, forward, lattice, sentencepiece_pieces
from kestrel.llm.text_tokens import worker_state
from kestrel.session import cut_lineage

WORD = re.compile(r"[^\W\d_]+")
ROUNDS = 2            # of expectation maximisation
SMOOTH = 0.05         # added to every expected count
BATCH_CHARS = 2_000_000
BATCH_WORDS = 50_000  # words whose lattices are built together
MEMO_MAX = 700_000


def held_out(id_col: str = "doc_id") -> Column:
    """Every fourth document by CRC-32 of its id as text; never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def vocabulary(path: str) -> tuple[Vocabulary, np.ndarray]:
    """The letter pieces of a SentencePiece file and their first weights."""
    kept = worker_state("vocabulary")
    if path not in kept:
        pieces, _, _ = sentencepiece_pieces(path)
        own = sorted({p.lower() for p in pieces if p.replace(MARK, "", 1).isalpha() and MARK not in p[1:]} | {MARK})
        kept[path] = Vocabulary(own), np.full((len(own) + 1, 1), -np.log(len(own) + 1.0))
    return kept[path]


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n) of all rows, counted in each task first."""

    def run(batches):
        for batch in batches:
            counts: dict[str, Counter] = {}
            chars = 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                counts.setdefault(lang, Counter()).update(text.lower().split())
                chars += len(text)
                if chars >= 8 * BATCH_CHARS:
                    yield from send(counts)
                    counts, chars = {}, 0
            yield from send(counts)

    def send(counts):
        for lang, chunks in counts.items():
            words: Counter = Counter()
            for chunk, n in chunks.items():
                if chunk.isalpha():
                    words[chunk] += n
                else:
                    for w in WORD.findall(chunk):
                        words[w] += n
            if words:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col)).dropna()
    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, model_path: str, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities (pieces x languages)."""
    words = cut_lineage(word_counts(docs, text_col, lang_col), "lang-words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())  # one row per language
    column = {x: k for k, x in enumerate(langs)}
    weight = None

    def expect(batches):
        vocab, start = vocabulary(model_path)
        now = np.repeat(start, len(langs), axis=1) if weight is None else weight
        total = np.zeros_like(now)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_WORDS):
                part = batch.slice(at, BATCH_WORDS)
                own = [MARK + w for w in part.column(1).to_pylist()]
                times = np.zeros((len(own), len(langs)))
                times[np.arange(len(own)), [column[x] for x in part.column(0).to_pylist()]] = part.column(2).to_numpy()
                total += expected_pieces(lattice(code_points(own), np.array([len(w) for w in own]), vocab), now, times)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": piece, "lang": lang, "n": total[piece, lang]})

    for _ in range(ROUNDS if langs else 0):
        sums = (words.mapInArrow(expect, "piece long, lang long, n double")
                .groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas())  # at most pieces x languages
        vocab, _ = vocabulary(model_path)
        counts = np.full((vocab.size + 1, len(langs)), SMOOTH)
        np.add.at(counts, (sums["piece"].to_numpy(np.int64), sums["lang"].to_numpy(np.int64)), sums["n"].to_numpy())
        weight = np.log(counts / counts.sum(axis=0))
    return langs, weight


class Scorer:
    """Sums of word scores per whitespace-separated chunk, remembered."""

    def __init__(self, model_path: str, weight: np.ndarray):
        self.vocab, self.weight = vocabulary(model_path)[0], weight
        self._clear()

    def _clear(self):
        self.memo: dict[str, int] = {}
        self.score = np.zeros((1024, self.weight.shape[1]))
        self.letters = np.zeros(1024, bool)

    def words(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.weight.shape[1]))
        for at in range(0, len(words), BATCH_WORDS):
            own = [MARK + w for w in words[at:at + BATCH_WORDS]]
            lat = lattice(code_points(own), np.array([len(w) for w in own]), self.vocab)
            out[at:at + len(own)] = forward(lat, self.weight)[lat.last]
        return out

    def _learn(self, chunks: list[str]):
        parts = [[c] if c.isalpha() else [w for w in WORD.findall(c) if any(map(str.isalpha, w))] for c in chunks]
        flat = [w for p in parts for w in p]
        names = list(dict.fromkeys(flat))
        number = dict(zip(names, range(len(names)), strict=True))
        scores = self.words(names)
        chunk = np.repeat(np.arange(len(chunks)), [len(p) for p in parts])
        n, m = len(self.memo), len(self.memo) + len(chunks)
        while len(self.score) < m:
            self.score = np.concatenate([self.score, np.zeros_like(self.score)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.score[n:m], self.letters[n:m] = 0.0, False
        if flat:
            np.add.at(self.score, n + chunk, scores[[number[w] for w in flat]])
            self.letters[n + chunk] = True
        self.memo.update(zip(chunks, range(n, m), strict=True))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log scores (texts x languages), and whether a text has a letter."""
        if len(self.memo) > MEMO_MAX:
            self._clear()
        chunks: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = t.lower().split()
            counts[i] = len(own)
            chunks += own
        idx = np.fromiter(map(self.memo.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(idx < 0)
        if missing.size:
            absent = [chunks[i] for i in missing]
            self._learn(list(dict.fromkeys(absent)))
            idx[missing] = np.fromiter(map(self.memo.__getitem__, absent), np.int64, len(absent))
        text = np.repeat(np.arange(len(texts)), counts)
        sums = np.stack([np.bincount(text, self.score[idx, k], len(texts)) for k in range(self.weight.shape[1])], axis=1)
        return sums, np.bincount(text, self.letters[idx], len(texts)) > 0


def predict(docs: DataFrame, model_path: str, langs: list[str], weight: np.ndarray | None,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score of every row."""
    name = uuid.uuid4().hex

    def judged(scorer, texts):
        if not langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        sums, letters = scorer.texts([t or "" for t in texts])
        best = sums.argmax(axis=1)
        share = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return [langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)], np.where(letters, share, 0.0).tolist()

    def run(batches):
        scorer = None
        if langs:
            kept = worker_state("scorers")
            if name not in kept:
                kept.clear()
                kept[name] = Scorer(model_path, weight)
            scorer = kept[name]
        for batch in batches:
            lang, score, waiting, chars = [], [], [], 0
            for x in batch.column(2):
                waiting.append(x.as_py())
                chars += len(waiting[-1] or "")
                if chars >= BATCH_CHARS:
                    a, b = judged(scorer, waiting)
                    lang += a
                    score += b
                    waiting, chars = [], 0
            if waiting:
                a, b = judged(scorer, waiting)
                lang += a
                score += b
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
            .mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double"))


def identify(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, predict every row."""
    langs, weight = learn(docs.filter(~held_out(id_col)), model_path, text_col, lang_col)
    return predict(docs, model_path, langs, weight, id_col, text_col)
