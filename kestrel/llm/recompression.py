"""Locally consistent parsing of word sequences by recompression.

A sequence of names is shortened in rounds.  Every few rounds each run of
equal names becomes one name; in every round each adjacent pair whose left
name draws 0 and right name draws 1 becomes one name.  A new name is a hash
of the names it stands for, so all tasks give equal runs and pairs equal names
without asking each other, and equal substrings get equal symbols except near
their ends.  For every symbol the parse also says how far around it the text
decides it (its context): where two texts agree on the context, both have the
symbol there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from kestrel.llm.words import mix

RUN_EVERY = 8
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
FAR = 1 << 40


@dataclass
class Parse:
    name: np.ndarray   # of each symbol
    start: np.ndarray  # its first word
    size: np.ndarray   # its words
    text: np.ndarray   # its text's number
    left: np.ndarray   # the words that decide it: [left, right)
    right: np.ndarray


def words_parse(names: np.ndarray, counts: np.ndarray) -> Parse:
    at = np.arange(len(names))
    return Parse(names, at, np.ones(len(names), np.int64), np.repeat(np.arange(len(counts)), counts), at, at + 1)


def _neighbours(p: Parse) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether symbol i and i + 1 share a text; contexts of both neighbours."""
    same = p.text[1:] == p.text[:-1]
    before_l = np.concatenate([[-FAR], np.where(same, p.left[:-1], -FAR)])
    before_r = np.concatenate([[-FAR], np.where(same, p.right[:-1], -FAR)])
    after_l = np.concatenate([np.where(same, p.left[1:], FAR), [FAR]])
    after_r = np.concatenate([np.where(same, p.right[1:], FAR), [FAR]])
    return same, before_l, before_r, after_l, after_r


def run_round(p: Parse, tag: int) -> Parse:
    """Runs of equal names to one name; every symbol now depends on both neighbours."""
    if not len(p.name):
        return p
    same, before_l, before_r, after_l, after_r = _neighbours(p)
    first = np.concatenate([[True], ~(same & (p.name[1:] == p.name[:-1]))])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(p.name)) - 1
    n = last - at + 1
    name = np.where(n > 1, mix(p.name[at] * A + n.astype(np.uint64) * B + np.uint64(2 * tag)), p.name[at])
    return Parse(name, p.start[at], np.add.reduceat(p.size, at), p.text[at],
                 np.minimum(np.minimum(p.left[at], before_l[at]), np.minimum(p.left[last], after_l[last])),
                 np.maximum(np.maximum(p.right[last], after_r[last]), np.maximum(p.right[at], before_r[at])))


def pair_round(p: Parse, tag: int, longest: int) -> Parse:
    """Pairs that draw (0, 1) to one name, unless it would exceed ``longest`` words."""
    if not len(p.name):
        return p
    same, before_l, before_r, after_l, after_r = _neighbours(p)
    draw = (mix(p.name ^ np.uint64(tag * int(C) & (1 << 64) - 1)) >> np.uint64(63)).astype(bool)
    pair = np.concatenate([same & ~draw[:-1] & draw[1:] & (p.size[1:] + p.size[:-1] <= longest), [False]])
    second = np.concatenate([[False], pair[:-1]])
    lone = ~pair & ~second
    left = np.where(lone & draw, np.minimum(p.left, before_l), np.minimum(p.left, after_l))
    right = np.where(lone & draw, np.maximum(p.right, before_r), np.maximum(p.right, after_r))
    at = np.flatnonzero(~second)
    joined = pair[at]
    nxt = np.minimum(at + 1, len(p.name) - 1)
    name = np.where(joined, mix(p.name[at] * A + p.name[nxt] * B + np.uint64(2 * tag + 1)), p.name[at])
    return Parse(name, p.start[at], p.size[at] + np.where(joined, p.size[nxt], 0), p.text[at], left[at], right[at])


def parse(p: Parse, first: int, rounds: int, longest: int = FAR) -> Parse:
    for k in range(first, rounds):
        if k % RUN_EVERY == 0:
            p = run_round(p, k)
        p = pair_round(p, k, longest)
    return p
