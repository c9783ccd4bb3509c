"""SentencePiece encoding by sampled segmentations, and lossless decoding.

The lattice of a text over the vocabulary's pieces is cut at spaces (a space
is written as the mark and begins a chunk).  Forward sums are computed once
per distinct chunk; then every occurrence draws its own segmentation backwards
from the end, with probability proportional to the product of its pieces'
weights.  The draws are a hash of seed, row key, chunk number and step, so the
same row gets the same pieces in any partitioning or order.

A piece's weight is ``(RANK_SHIFT - score) ** -1`` normalised (the file's
scores are negative ranks), raised to ``sharpness``.  Characters outside the
vocabulary, and the mark itself where a text contains it, become byte pieces,
so decoding returns every text exactly.

Defined results: null and empty texts have no ids and decode to the empty
text; rows equal in key and text get equal ids; a null key is a key of its
own; very long texts are encoded in parts cut before spaces; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.lattice import MARK, Vocabulary, code_points, forward, lattice, sentencepiece_pieces
from kestrel.llm.text_tokens import worker_state

RANK_SHIFT = 100.0
BATCH_CHARS = 1_500_000
FOREIGN_MARK = 0x110000  # code point of a literal mark: above Unicode, in no piece


class Codec:
    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        pieces, ids, scores = sentencepiece_pieces(path)
        keep = [k for k, p in enumerate(pieces) if MARK not in p[1:]]
        self.vocab, self.ids = Vocabulary([pieces[k] for k in keep]), ids[keep]
        p = 1.0 / (RANK_SHIFT - scores[keep])
        logs = np.log(p / p.sum())
        self.weight = sharpness * np.append(logs, logs.min() - np.log(256.0))[:, None]
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_id = np.zeros(256, np.int64)
        self.bytes_of: dict[int, bytes] = {int(i): pieces[k].replace(MARK, " ").encode() for k, i in zip(keep, self.ids, strict=True)}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[1:-1], 16)
                self.byte_id[b], self.bytes_of[i] = i, bytes([b])

    def encode(self, keys: np.ndarray, texts: list[str], firsts: list[int]) -> list[np.ndarray]:
        """Ids of each text; ``firsts``: the number of each text's first chunk."""
        parts = [t.split(" ") if t else [] for t in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        # a chunk: its text, with the mark in front unless the text starts with it
        chunks = [c for p in parts for c in ([(p[0],)] + p[1:] if p else [])]
        number: dict = {}
        which = np.fromiter((number.setdefault(c, len(number)) for c in chunks), np.int64, len(chunks))
        if not len(chunks):
            return [np.zeros(0, np.int64) for _ in texts]
        words = [c[0] if isinstance(c, tuple) else MARK + c for c in number]
        sizes = np.array([len(w) for w in words], np.int64)
        codes = code_points(words).copy()
        begins = np.cumsum(sizes) - sizes
        own = codes == ord(MARK)
        marked = np.array([not isinstance(c, tuple) for c in number])
        own[begins[marked]] = False
        codes[own] = FOREIGN_MARK
        lat = lattice(codes, sizes, self.vocab)
        total = forward(lat, self.weight)[:, 0]
        order = np.argsort(lat.target, kind="stable")
        source, target, piece = lat.source[order], lat.target[order], lat.piece[order]
        share = np.exp(total[source] + self.weight[piece, 0] - total[target])
        run = np.cumsum(share)
        start = np.searchsorted(target, np.arange(len(total) + 1))
        cum = run - np.concatenate([[0.0], run])[start[target]]

        text = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(chunks)) - np.repeat(np.cumsum(counts) - counts, counts) + np.array(firsts, np.int64)[text]
        seed = _hash(keys[text] ^ _hash(nth.astype(np.uint64)))
        live = np.flatnonzero(sizes[which] > 0)
        node = lat.last[which]
        home = lat.first[which]
        taken, at, step = [], [], 0
        steps = np.zeros(len(chunks), np.int64)
        while live.size:
            u = (_hash(seed[live] + np.uint64(step + 1)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            arc = start[node[live]]
            last = start[node[live] + 1] - 1
            go = np.flatnonzero((u >= cum[arc]) & (arc < last))
            while go.size:
                arc[go] += 1
                go = go[(u[go] >= cum[arc[go]]) & (arc[go] < last[go])]
            taken.append(arc)
            at.append(live)
            node[live] = source[arc]
            steps[live] += 1
            live = live[node[live] != home[live]]
            step += 1
        base = np.cumsum(steps) - steps
        arcs = np.zeros(int(steps.sum()), np.int64)
        for k, (occ, arc) in enumerate(zip(at, taken, strict=True)):
            arcs[base[occ] + steps[occ] - 1 - k] = arc
        found = piece[arcs]
        lone = found == self.vocab.size
        out = np.where(lone, 0, self.ids[np.where(lone, 0, found)])
        width = np.ones(len(found), np.int64)
        raw: list[bytes] = []
        if lone.any():
            shift = np.searchsorted(lat.last, source[arcs[lone]])  # nodes to code points: one node more per word
            c = codes[source[arcs[lone]] - shift]
            raw = [(MARK if x == FOREIGN_MARK else chr(x)).encode("utf-8", "surrogatepass") for x in c.tolist()]
            width[lone] = [len(b) for b in raw]
        ids = np.repeat(out, width)
        if raw:
            ids[np.repeat(lone, width)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        of_text = np.bincount(np.repeat(np.repeat(text, steps), width), minlength=len(texts))
        return np.split(ids, np.cumsum(of_text)[:-1])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")


def _hash(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codec(path: str, sharpness: float) -> Codec:
    kept = worker_state("codecs")
    if (path, sharpness) not in kept:
        kept[path, sharpness] = Codec(path, sharpness)
    return kept[path, sharpness]


def _parts(text: str):
    """A long text in parts cut before spaces, and each part's first chunk."""
    at = nth = 0
    while len(text) - at > BATCH_CHARS and (cut := text.find(" ", at + BATCH_CHARS)) > 0:
        yield text[at:cut], nth
        nth += text.count(" ", at, cut) + (at == 0)
        at = cut
    yield text[at:], nth


def encode(docs: DataFrame, model_path: str, seed: int = 0, sharpness: float = 1.0,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and ids (little-endian unsigned 32-bit) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = codec(model_path, sharpness)
        for batch in batches:
            keys = _hash(batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64) ^ np.uint64(seed))
            out, rows = [], []
            waiting: list[str] = []
            chars = 0

            def flush(k):
                got = enc.encode(keys[k - len(waiting):k], waiting, [0] * len(waiting))
                out.extend(g.astype("<u4").tobytes() for g in got)

            def made():
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([len(b) // 4 for b in out], pa.int64()), pa.array(out, pa.binary())], [id_col, "n_tokens", "ids"])

            for k, x in enumerate(batch.column(2)):
                text = x.as_py() or ""
                if len(text) > BATCH_CHARS:
                    if waiting:
                        flush(k)
                        waiting, chars = [], 0
                    got = []
                    for part, nth in _parts(text):  # a later part begins with its space: the chunk after the cut
                        got += enc.encode(keys[k:k + 1], [part], [nth - 1 if nth else 0])
                    out.append(np.concatenate(got).astype("<u4").tobytes())
                    rows.append(k)
                    continue
                waiting.append(text)
                rows.append(k)
                chars += len(text)
                if chars >= BATCH_CHARS:
                    flush(k + 1)
                    waiting, chars = [], 0
                    yield made()
                    out, rows = [], []
            if waiting:
                flush(batch.num_rows)
            if rows:
                yield made()

    key = F.xxhash64(F.col(id_col)).alias("__key")
    return docs.select(F.col(id_col), key, F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, model_path: str, sharpness: float = 1.0) -> DataFrame:
    """``encoded`` with ``text`` in place of ``ids``."""
    names = [c for c in encoded.columns if c not in ("ids", "text")]
    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        enc = codec(model_path, sharpness)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(at, 512)
                text = [enc.decode(np.frombuffer(b.as_py(), "<u4").tolist()) for b in part.column(len(names))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(text, pa.string())], [*names, "text"])

    return encoded.select(*names, "ids").mapInArrow(run, f"{kinds}, text string")
