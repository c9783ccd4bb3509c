"""Exact evaluation of arithmetic over number literals (V6).

``+ - * / // **`` and signs, with Python's meaning: whole numbers are exact at
any size, ``/`` and decimals are floats.  A power whose result would not fit
in HUGE_BITS is kept as sign and logarithm; it is larger than any answer, and
sums, products, quotients and powers of such values go on by logarithm.
Evaluation walks the parsed expression with a stack, so nesting and length are
bounded by the parser alone.
"""

from __future__ import annotations

import ast
import math
import operator
from dataclasses import dataclass

HUGE_BITS = 1 << 24  # whole numbers beyond are held by their logarithm


@dataclass(frozen=True)
class Huge:
    sign: int
    log2: float  # of the size, at least HUGE_BITS


def _log2(x) -> float:
    if isinstance(x, Huge):
        return x.log2
    return math.log2(abs(x)) if x else -math.inf


def _sign(x) -> int:
    return x.sign if isinstance(x, Huge) else (x > 0) - (x < 0)


def _from_log(sign: int, log2: float):
    return Huge(sign, log2) if log2 >= HUGE_BITS else sign * 2.0 ** log2 if log2 < 1023 else sign * math.inf


def _add(a, b):
    if not (isinstance(a, Huge) or isinstance(b, Huge)):
        return a + b
    if isinstance(a, Huge) and isinstance(b, Huge) and a.sign != b.sign and a.log2 == b.log2:
        return 0
    return a if _log2(a) >= _log2(b) else b


def _negative(a):
    return Huge(-a.sign, a.log2) if isinstance(a, Huge) else -a


def _times(a, b):
    if not (isinstance(a, Huge) or isinstance(b, Huge)):
        return a * b
    return _from_log(_sign(a) * _sign(b), _log2(a) + _log2(b)) if _sign(a) and _sign(b) else 0


def _over(a, b, whole: bool):
    if not (isinstance(a, Huge) or isinstance(b, Huge)):
        return a // b if whole else a / b
    if not _sign(b):
        raise ZeroDivisionError
    if not _sign(a):
        return 0
    value = _from_log(_sign(a) * _sign(b), _log2(a) - _log2(b))
    return value if isinstance(value, Huge) or not whole else math.floor(value)


def _power(a, b):
    big = isinstance(a, Huge) or isinstance(b, Huge)
    if not big and not (isinstance(a, int) and isinstance(b, int) and b > 0 and abs(a) > 1 and b * _log2(a) > HUGE_BITS):
        return a ** b
    if not _sign(b):
        return 1
    if a in (0, 1):
        return a if _sign(b) > 0 or a else _over(1, 0, False)
    if isinstance(b, Huge):
        if _sign(a) < 0:
            raise OverflowError("sign of a power of unknown parity")
        grows = (_log2(a) > 0) == (b.sign > 0)
        return Huge(1, math.inf) if grows and a != 1 else 0.0
    sign = -1 if _sign(a) < 0 and b % 2 else 1
    return _from_log(sign, _log2(a) * b)


BINARY = {ast.Add: _add, ast.Sub: lambda a, b: _add(a, _negative(b)), ast.Mult: _times, ast.Div: lambda a, b: _over(a, b, False),
          ast.FloorDiv: lambda a, b: _over(a, b, True), ast.Pow: _power}
UNARY = {ast.UAdd: operator.pos, ast.USub: _negative}


def evaluate(expr: str):
    """The value, exact where Python's is; raises where there is none."""
    todo: list = [ast.parse(expr, mode="eval").body]
    values: list = []
    while todo:
        node = todo.pop()
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            values.append(node.value)
        elif isinstance(node, ast.BinOp) and type(node.op) in BINARY:
            todo += [(BINARY[type(node.op)], 2), node.right, node.left]
        elif isinstance(node, ast.UnaryOp) and type(node.op) in UNARY:
            todo += [(UNARY[type(node.op)], 1), node.operand]
        elif isinstance(node, tuple):
            args = values[-node[1]:]
            values[-node[1]:] = [node[0](*args)]
        else:
            raise ValueError("not arithmetic")
    return values[0]


def safe_arith(expr: str | None):
    """The value as a float (infinite where it exceeds one), null when invalid."""
    if expr is None:
        return None
    try:
        value = evaluate(expr)
        if isinstance(value, complex):
            return None
        if isinstance(value, Huge):
            return value.sign * math.inf
        try:
            value = float(value)
        except OverflowError:
            return math.inf if value > 0 else -math.inf
        return None if math.isnan(value) else value
    except Exception:  # noqa: BLE001 - any failure is "cannot evaluate"
        return None
