"""Word hashes of whole texts, straight from Arrow's UTF-8 buffers.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``; its hash is a
polynomial over its bytes, mixed with its length.  Long texts are hashed in
pieces cut between words, so memory does not follow a text's length except for
eight bytes per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a string column; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds.astype(np.int64)


def _pieces(raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of the rows' bytes at row bounds or white space."""
    at, end = int(bounds[0]), int(bounds[-1])
    while at < end:
        cut = min(at + PIECE_BYTES, end)
        while cut < end:  # back to a place between words, or on to the next
            back = np.flatnonzero(SPACE[raw[at:cut]])
            row = bounds[np.searchsorted(bounds, cut, side="right") - 1]
            best = max(at + int(back[-1]) + 1 if back.size else at, int(row))
            if best > at:
                cut = best
                break
            cut = min(cut + PIECE_BYTES, end)
        yield at, cut
        at = cut


def word_hashes(raw: np.ndarray, bounds: np.ndarray, lower: bool = False, seeds: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """``seeds`` independent hashes of every word of all rows, in order; words per row."""
    out: list[list[np.ndarray]] = [[] for _ in range(seeds)]
    starts: list[np.ndarray] = []
    for a, b in _pieces(raw, bounds):
        part = raw[a:b]
        solid = ~SPACE[part]
        edge = np.empty(len(part), bool)
        edge[0] = True
        edge[1:] = ~solid[:-1]
        inner = bounds[np.searchsorted(bounds, a):np.searchsorted(bounds, b)] - a
        edge[inner] = True
        begin = np.flatnonzero(solid & edge)
        if not begin.size:
            continue
        code = (LOWER[part] if lower else part)[begin[0]:].astype(np.uint64) + np.uint64(1)
        code[~solid[begin[0]:]] = 0
        size = np.diff(np.append(begin, len(part)))
        place = np.arange(len(code)) - np.repeat(begin - begin[0], size)
        length = np.add.reduceat(solid[begin[0]:].astype(np.int64), begin - begin[0]).astype(np.uint64)
        longest = int(size.max())
        for k in range(seeds):
            h = np.add.reduceat(code * powers(longest, BASES[k])[place], begin - begin[0])
            out[k].append(mix(h + length * np.uint64(0xD6E8FEB86659FD93)))
        starts.append(begin + a)
    if not starts:
        return [np.zeros(0, np.uint64) for _ in range(seeds)], np.zeros(len(bounds) - 1, np.int64)
    at = np.concatenate(starts)
    counts = np.diff(np.searchsorted(at, bounds))
    return [np.concatenate(x) for x in out], counts


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and bytes of every word of all rows; words per row."""
    a, b = int(bounds[0]), int(bounds[-1])
    solid = np.zeros(b - a + 2, bool)
    solid[1:-1] = ~SPACE[raw[a:b]]
    inner = bounds[1:-1] - a
    inner = inner[(inner > 0) & (inner < b - a)]
    begin, end = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    begin[inner] = solid[inner + 1]
    end[inner - 1] = solid[inner]
    at = np.flatnonzero(begin)
    return at + a, np.flatnonzero(end) + 1 - at, np.diff(np.searchsorted(at, bounds - a))


def word_batches(column: pa.Array, lower: bool = False, seeds: int = 1) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """Row range, word hashes and words per row, for a few megabytes of rows at a time."""
    raw, bounds = utf8(column)
    group = (bounds[1:] - bounds[0]) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield a, b, *word_hashes(raw, bounds[a:b + 1], lower, seeds)
