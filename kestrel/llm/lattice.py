"""Piece lattices over a fixed vocabulary, for many words at once.

A word's lattice has a node before each character and one after the last, and
an arc for every piece of the vocabulary that occurs in it; a character that
is no piece has an arc of its own (piece number ``len(vocabulary)``).  All
words are laid end to end in one array of code points; substrings are found by
rolling hashes, and the forward sums run over all words together, one local
end position after another.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
MARK = "▁"  # SentencePiece's stand-in for a space


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * MIX
    return x ^ (x >> np.uint64(29))


@dataclass
class Vocabulary:
    """Pieces by length: sorted hashes, their piece numbers, and a bitmap of
    the hashes' upper bits that most absent substrings fail."""

    pieces: list[str]

    def __post_init__(self):
        self.size = len(self.pieces)
        by: dict[int, list[int]] = {}
        for k, p in enumerate(self.pieces):
            by.setdefault(len(p), []).append(k)
        self.longest = max(by, default=0)
        self.of_length = {}
        for n, ks in by.items():
            codes = np.array([[ord(c) for c in self.pieces[k]] for k in ks], np.uint32)
            h = np.zeros(len(ks), np.uint64)
            for j in range(n):
                h = h * BASE + _mixed(codes[:, j])
            order = np.argsort(h)
            seen = np.zeros(1 << 16, bool)
            seen[h >> np.uint64(48)] = True
            self.of_length[n] = h[order], np.array(ks, np.int64)[order], seen


def sentencepiece_pieces(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The ordinary pieces of a SentencePiece file, their ids and scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [sp.id_to_piece(i) for i in ids], np.array(ids, np.int64), np.array([sp.get_score(i) for i in ids])


@dataclass
class Lattice:
    """Arcs sorted by local end position, then by end node."""

    first: np.ndarray    # each word's first node
    last: np.ndarray     # each word's last node
    source: np.ndarray   # arc: start node
    target: np.ndarray   # arc: end node
    piece: np.ndarray    # arc: piece number
    level: np.ndarray    # bounds of the arcs of each local end position


def code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


def lattice(codes: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> Lattice:
    """``codes``: the code points of all words; ``sizes``: of each word."""
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(sizes)), sizes)
    end = ends[word]
    mixed = _mixed(codes)
    at = np.arange(len(codes))
    h = np.zeros(len(codes), np.uint64)
    found = []
    for n in range(1, vocabulary.longest + 1):
        stay = at + n <= end[at]
        at, h = at[stay], h[stay]
        if not at.size:
            break
        h = h * BASE + mixed[at + n - 1]
        if n in vocabulary.of_length:
            hashes, ks, seen = vocabulary.of_length[n]
            may = np.flatnonzero(seen[h >> np.uint64(48)])
            place = np.minimum(np.searchsorted(hashes, h[may]), len(hashes) - 1)
            hit = hashes[place] == h[may]
            own, piece = at[may[hit]], ks[place[hit]]
        else:
            own, piece = at[:0], at[:0]
        if n == 1:
            lone = np.ones(len(codes), bool)
            lone[own] = False
            lone = np.flatnonzero(lone)
            own, piece = np.concatenate([own, lone]), np.concatenate([piece, np.full(len(lone), vocabulary.size)])
        found.append((own, np.full(len(own), n), piece))
    if not found:
        none = np.zeros(0, np.int64)
        node = np.cumsum(sizes + 1) - 1
        return Lattice(node - sizes, node, none, none, none, np.zeros(1, np.int64))
    start, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    local = start + length - (ends - sizes)[word[start]]
    source = start + word[start]
    order = np.lexsort((source + length, local))
    source, length, piece, local = source[order], length[order], piece[order], local[order]
    node = np.cumsum(sizes + 1) - 1
    level = np.searchsorted(local, np.arange(1, int(local[-1]) + 2))
    return Lattice(node - sizes, node, source, source + length, piece, level)


def _log_sums(v: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (equal ones adjacent) and the log of their summed exponentials."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1])
    top = np.maximum.reduceat(v, cut, axis=0)
    rows = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(v))))
    return node[cut], top + np.log(np.add.reduceat(np.exp(v - top[rows]), cut, axis=0))


def forward(lat: Lattice, weight: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all paths to each node; ``weight`` has
    a row per piece (and one for lone characters) and a column per model."""
    nodes = int(lat.last[-1]) + 1 if len(lat.last) else 0
    total = np.zeros((nodes, weight.shape[1]))
    for a, b in zip(lat.level[:-1], lat.level[1:], strict=True):
        if a < b:
            at, sums = _log_sums(total[lat.source[a:b]] + weight[lat.piece[a:b]], lat.target[a:b])
            total[at] = sums
    return total


def expected_pieces(lat: Lattice, weight: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (row) per model (column) when word ``i``
    occurs ``times[i]`` (a column per model): forward-backward."""
    ahead = forward(lat, weight)
    word = np.searchsorted(lat.last, lat.target)
    behind = np.zeros_like(ahead)
    local = lat.source - lat.first[word]
    order = np.lexsort((lat.source, local))
    level = np.searchsorted(local[order], np.arange(0, int(local.max(initial=-1)) + 2))
    for a, b in zip(level[-2::-1], level[:0:-1], strict=True):
        if a < b:
            k = order[a:b]
            at, sums = _log_sums(behind[lat.target[k]] + weight[lat.piece[k]], lat.source[k])
            behind[at] = sums
    share = np.exp(ahead[lat.source] + weight[lat.piece] + behind[lat.target] - ahead[lat.last][word]) * times[word]
    return np.stack([np.bincount(lat.piece, share[:, k], len(weight)) for k in range(weight.shape[1])], axis=1)
