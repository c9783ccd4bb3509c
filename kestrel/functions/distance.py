"""Edit distance of long texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kestrel.functions.text import col

NATIVE_CELLS = 1 << 18  # code point pairs up to which the built-in function is faster
KEPT_MASKS = 256


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements of code points from ``a`` to ``b``.

    Bit-parallel: a whole column of the distance matrix is held as the bits
    where it rises and where it falls, and a code point of the shorter text
    advances all of it by a few operations on integers of ``len(longer)`` bits."""
    if len(a) < len(b):
        a, b = b, a
    if not b or a == b:
        return 0 if a == b else len(a)
    m = len(a)
    points = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4")
    order = np.argsort(points, kind="stable")
    values, first = np.unique(points[order], return_index=True)
    places = dict(zip(map(chr, values.tolist()), np.split(order, first[1:]), strict=True))

    @lru_cache(KEPT_MASKS)
    def mask(ch: str) -> int:
        if ch not in places:
            return 0
        bits = np.zeros(m, np.uint8)
        bits[places[ch]] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    full, last = (1 << m) - 1, m - 1
    rise, fall, distance = full, 0, m
    for ch in b:
        same = mask(ch)
        diagonal = ((((same & rise) + rise) ^ rise) | same | fall) & full
        up = fall | (full & ~(diagonal | rise))
        down = diagonal & rise
        distance += (up >> last & 1) - (down >> last & 1)
        up = (up << 1 | 1) & full
        rise = (down << 1 | ~(diagonal | up)) & full
        fall = up & diagonal
    return distance


def text_distance(a, b) -> Column:
    """Edit distance over code points of whole texts; null where either is null.
    Short pairs take the built-in function, and only long ones go to Python."""
    a, b = col(a), col(b)
    short = F.length(a).cast("long") * F.length(b) <= NATIVE_CELLS

    @F.arrow_udf("long")
    def far(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x.to_pylist(), y.to_pylist(), strict=True)
        return pa.array([None if p is None or q is None else edit_distance(p, q) for p, q in pairs], pa.int64())

    return F.when(short, F.levenshtein(a, b).cast("long")).otherwise(far(F.when(~short, a), F.when(~short, b)))
