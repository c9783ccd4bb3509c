"""Document quality from a linear-chain conditional random field over lines.

Every line with a word gets a vector of simple statistics; the field's
emissions see the line and both neighbours, its transitions tie neighbouring
labels (bad, good).  Forward-backward gives each line's probability of being
good; a document's score is their mean weighted by line length.

Learning uses a bounded sample: at most SAMPLE_DOCS labelled documents per
class, in the order of a hash of their id, of at most SAMPLE_LINES lines; a
line's label is its document's.  The sample's line vectors are fitted by
gradient ascent on the driver.  Scoring covers all documents, whole texts.

Defined results: a null or blank text has no line and gets the learnt prior of
a good document; without labels of both classes every score is 0.5; equal
texts get equal scores; very long texts are one chain, processed line by line
in bounded arrays; repeated rows are scored each; an empty table gives an
empty table.  Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.langid import held_out

SAMPLE_DOCS, SAMPLE_LINES = 2500, 400
STEPS, RATE, RIDGE = 200, 0.15, 1e-3
BATCH_CHARS = 3_000_000
GOOD = 0.7
SYMBOLS = "#*$%&|<>"
N_STATS = 12


def _classes() -> np.ndarray:
    """Per code point below 0x3000: 0 other, 1 white, 2 line feed, 3 lower or
    caseless letter, 4 upper-case letter, 5 digit, 6 symbol, 7 punctuation."""
    out = np.zeros(0x3000, np.uint8)
    for c in range(0x3000):
        x = chr(c)
        out[c] = (2 if x == "\n" else 1 if x.isspace() else 4 if x.isupper() else 3 if x.isalpha() else 5 if x.isdigit()
                  else 6 if x in SYMBOLS else 7 if x in ".,;:!?\"'()-" else 0)
    return out


CLASSES = _classes()
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, np.uint64))


def line_stats(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with a word: statistics, length in characters, text number."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not codes.size:
        return np.zeros((0, N_STATS)), np.zeros(0), np.zeros(0, np.int64)
    kind = CLASSES[np.minimum(codes, len(CLASSES) - 1)]
    kind[codes >= len(CLASSES)] = 3
    feed = kind == 2
    line = np.cumsum(feed) - feed
    n = int(line[-1]) + 1
    starts = np.concatenate([[0], np.flatnonzero(feed)[:-1] + 1])
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(text_ends, starts, side="right")
    by = np.bincount(line * 8 + kind, minlength=n * 8).reshape(n, 8).astype(np.float64)
    chars = by.sum(axis=1) - by[:, 2]
    solid = kind > 2
    solid |= kind == 0
    begin = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    keep = np.bincount(line[begin], minlength=n) > 0
    if not begin.size:
        return np.zeros((0, N_STATS)), np.zeros(0), np.zeros(0, np.int64)
    # a hash per word: its characters weighted by powers of their place
    place = np.arange(len(codes)) - np.repeat(begin, np.diff(np.append(begin, len(codes)))) if begin[0] == 0 else \
        np.concatenate([np.zeros(begin[0], np.int64), np.arange(begin[0], len(codes)) - np.repeat(begin, np.diff(np.append(begin, len(codes))))])
    part = np.where(solid, (codes.astype(np.uint64) + np.uint64(1)) * POWERS[place % 64] * (place // 64 + 1).astype(np.uint64), np.uint64(0))
    word = np.add.reduceat(part, begin)
    of = line[begin]
    nw = np.bincount(of, minlength=n).astype(np.float64)
    twice = np.bincount(of[1:][(word[1:] == word[:-1]) & (of[1:] == of[:-1])], minlength=n)
    order = np.lexsort((word, of))
    w, o = word[order], of[order]
    distinct = np.bincount(o[np.concatenate([[True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])])], minlength=n)
    # a hash per line: its words in order; equal to an earlier line of its text?
    nth = np.arange(len(begin)) - (np.cumsum(nw) - nw).astype(np.int64)[of]
    mixed = (word ^ (word >> np.uint64(29))) * (np.uint64(2) * nth.astype(np.uint64) + np.uint64(0xBF58476D1CE4E5B9))
    whole = np.zeros(n, np.uint64)
    np.add.at(whole, of, mixed)
    order = np.lexsort((np.arange(n), whole, text))
    again = np.zeros(n, bool)
    again[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (text[order[1:]] == text[order[:-1]]) & keep[order[1:]]
    stop_at = np.concatenate([starts[1:], [len(codes)]]) - 2
    end = kind[np.maximum(stop_at, 0)] == 7
    letters, one = by[:, 3] + by[:, 4], np.maximum(chars, 1.0)
    nw1 = np.maximum(nw, 1.0)
    stats = np.stack([
        np.log1p(nw), (chars - by[:, 1]) / nw1 / 5.0, distinct / nw1, twice / nw1, 10 * by[:, 6] / one,
        by[:, 4] / np.maximum(letters, 1.0), 5 * by[:, 5] / one, 5 * by[:, 7] / one, again, end,
        letters / one, by[:, 6] > 0], axis=1)
    return stats[keep], chars[keep], text[keep]


def with_neighbours(stats: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each line's vector, both neighbours' (zero outside the text), and 1."""
    n = len(stats)
    before, after = np.zeros_like(stats), np.zeros_like(stats)
    if n > 1:
        same = (text[1:] == text[:-1])[:, None]
        before[1:], after[:-1] = stats[:-1] * same, stats[1:] * same
    return np.concatenate([stats, before, after, np.ones((n, 1))], axis=1)


class Chains:
    """Line numbers of all chains, by step: chains sorted by falling length."""

    def __init__(self, text: np.ndarray):
        first = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1]) if len(text) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(text)))
        order = np.argsort(-size, kind="stable")
        self.first, self.size = first[order], size[order]
        longest = int(self.size[0]) if len(size) else 0
        self.alive = np.searchsorted(-self.size, -np.arange(1, longest + 1), side="right")

    def marginals(self, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Per line P(bad, good); expected transitions; log normaliser."""
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        for t, k in enumerate(self.alive):
            at = self.first[:k] + t
            ahead[at] = emit[at] if t == 0 else emit[at] + np.logaddexp(ahead[at - 1, :1] + trans[0], ahead[at - 1, 1:] + trans[1])
        for t in range(len(self.alive) - 2, -1, -1):
            at = self.first[:self.alive[t + 1]] + t
            v = emit[at + 1] + behind[at + 1]
            behind[at] = np.logaddexp(trans[:, 0] + v[:, :1], trans[:, 1] + v[:, 1:])
        last = self.first + self.size - 1
        z = np.logaddexp(ahead[last, 0], ahead[last, 1])
        z_line = np.zeros(len(emit))
        z_line[self.first] = z
        chain = np.zeros(len(emit), np.int64)
        chain[self.first] = np.arange(len(self.first))
        begin = np.zeros(len(emit), bool)
        begin[self.first] = True
        z_line = z[chain[np.maximum.accumulate(np.where(begin, np.arange(len(emit)), 0))]] if len(emit) else z_line
        p = np.exp(ahead + behind - z_line[:, None])
        inner = np.flatnonzero(~begin)
        pair = np.exp(ahead[inner - 1][:, :, None] + trans[None] + (emit[inner] + behind[inner])[:, None, :] - z_line[inner][:, None, None])
        return p, pair.sum(axis=0), float(z.sum())


def fit(stats: list[np.ndarray], labels: np.ndarray) -> dict:
    """The field's weights from the sample's documents (labels 0 or 1)."""
    text = np.repeat(np.arange(len(stats)), [len(s) for s in stats])
    raw = np.concatenate(stats)
    mean, spread = raw.mean(axis=0), np.maximum(raw.std(axis=0), 1e-3)
    x = with_neighbours((raw - mean) / spread, text)
    y = labels[text]
    chains = Chains(text)
    w, trans = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    target = np.zeros((len(y), 2))
    target[np.arange(len(y)), y] = 1.0
    seen = np.zeros((2, 2))
    inner = np.flatnonzero(text[1:] == text[:-1])
    np.add.at(seen, (y[inner], y[inner + 1]), 1.0)
    n = len(stats)
    m = [np.zeros_like(w), np.zeros_like(trans)]
    v = [np.zeros_like(w), np.zeros_like(trans)]
    for step in range(1, STEPS + 1):
        p, pair, _ = chains.marginals(x @ w, trans)
        for k, (par, grad) in enumerate(((w, x.T @ (target - p) / n - RIDGE * w), (trans, (seen - pair) / n - RIDGE * trans))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            par += RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return {"mean": mean, "spread": spread, "w": w, "trans": trans, "prior": float(labels.mean())}


def score_texts(model: dict | None, texts: list[str]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    stats, chars, text = line_stats(texts)
    x = with_neighbours((stats - model["mean"]) / model["spread"], text)
    p, _, _ = Chains(text).marginals(x @ model["w"], model["trans"])
    weight = np.bincount(text, chars, len(texts))
    good = np.bincount(text, chars * p[:, 1], len(texts))
    return np.clip(np.where(weight > 0, good / np.maximum(weight, 1e-9), model["prior"]), 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict | None:
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter(~held_out("__id") & F.col("__id").isNotNull())
    picks = [known.filter(F.col("__y") == y).dropDuplicates(["__id"]).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE_DOCS) for y in (0, 1)]
    sample = F.broadcast(picks[0].unionAll(picks[1]))  # at most 2 * SAMPLE_DOCS rows
    chosen = (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(sample, "__id")
              .filter(F.size(F.split("__text", "\n")) <= SAMPLE_LINES).dropDuplicates(["__id", "__y"]))

    def run(batches):
        for batch in batches:
            ids, ys, blobs = [], [], []
            for k, (y, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                stats, _, _ = line_stats([t.as_py()])
                if len(stats):
                    ids.append(k)
                    ys.append(y)
                    blobs.append(stats.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(blobs, pa.binary())], ["k", "y", "stats"])

    rows = chosen.select("__id", "__y", "__text").mapInArrow(run, "k long, y int, stats binary").orderBy(F.xxhash64("stats"), "y").toPandas()
    if rows["y"].nunique() < 2:
        return None
    stats = [np.frombuffer(b, "<f4").reshape(-1, N_STATS).astype(np.float64) for b in rows["stats"]]
    return fit(stats, rows["y"].to_numpy(np.int64))


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            scores, waiting, chars = [], [], 0
            for x in batch.column(2):
                waiting.append(x.as_py() or "")
                chars += len(waiting[-1])
                if chars >= BATCH_CHARS:
                    scores.append(score_texts(model, waiting))
                    waiting, chars = [], 0
            if waiting:
                scores.append(score_texts(model, waiting))
            s = np.concatenate([np.zeros(0), *scores])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= GOOD).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    return (docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
            .mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    return predict(docs, learn(docs, labels, id_col, text_col, label_col), id_col, text_col)
