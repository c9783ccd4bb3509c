"""MATH answers (V3, V4): the boxed answer of a response, and equality after normalising.

Normalising reads an answer once into tokens (a command, a degree mark, or
one character), applies a rule per token, and then gives square roots and
fractions their braces.  An answer the rules cannot handle raises
``Malformed``; two answers of which one is malformed are compared as written.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Malformed(ValueError):
    """An answer outside the rules."""


# ------------------------------------------------------------------ V3: boxes

BRACES = re.compile(r"[{}]")


def last_boxed(text: str | None) -> str | None:
    """The last box with its command: ``\\boxed x`` up to the next ``$`` where
    that form occurs at all, else the last ``\\boxed`` (or, without one,
    ``\\fbox``) up to the brace that closes it; null if none closes."""
    if text is None:
        return None
    spaced = text.rfind("\\boxed ")
    if spaced >= 0:
        end = text.find("$", spaced)
        return text[spaced:] if end < 0 else text[spaced:end]
    start = text.rfind("\\boxed")
    start = text.rfind("\\fbox") if start < 0 else start
    if start < 0:
        return None
    open_now = 0
    for brace in BRACES.finditer(text, start):
        open_now += 1 if brace.group() == "{" else -1
        if brace.group() == "}" and open_now == 0:
            return text[start:brace.end()]
    return None


def box_content(box: str) -> str:
    found = re.fullmatch(r"\\boxed (?P<a>.*)|\\boxed\{(?P<b>.*)\}", box, re.S)
    if not found:
        raise Malformed(box)
    return found["a"] if found["a"] is not None else found["b"]


# ------------------------------------------------------- V4: normalised answers

# What the rules read.
TOKEN = re.compile(r"\^\{\\{1,2}circ\}|\^\\{1,2}circ|\\{1,2}[A-Za-z]+|\\{1,2}[!$%]|\\\\|.", re.S)
DEGREES = {"^{\\circ}", "^\\circ"}
SILENT = {"\\!", "\\$", "\\%"}
SIZES = ("\\left", "\\right")
FRACTIONS = {"\\tfrac", "\\dfrac"}
UNITS = "\\text{ "


def _tokens(answer: str):
    for m in TOKEN.finditer(answer.replace("\n", "")):
        token = m.group()
        yield token.replace("\\\\", "\\")


def _cleaned(answer: str) -> str:
    """Rules on single tokens; a dot after a space, a brace or nothing gets its zero."""
    out: list[str] = []
    for token in _tokens(answer):
        if token in SILENT or token in DEGREES:
            continue
        if token.startswith(SIZES):
            token = token.removeprefix(SIZES[0] if token.startswith(SIZES[0]) else SIZES[1])
        elif token in FRACTIONS:
            token = "\\frac"
        elif token == "." and out and out[-1][-1] in " {":
            token = "0."
        if token:
            out.append(token)
    text = "".join(out)
    head, units, tail = text.partition(UNITS)
    if UNITS in tail:
        raise Malformed("units twice")
    return "0" + head if head.startswith(".") else head


def _argument(text: str, command: str, rule) -> str:
    """``rule`` applied to what follows each ``command`` up to the next one."""
    pieces = re.split(f"({re.escape(command)})", text)
    for k in range(2, len(pieces), 2):
        if not pieces[k]:
            raise Malformed(f"{command} without argument")
        if pieces[k][0] != "{":
            pieces[k] = rule(pieces[k])
            if pieces[k] is None:
                return text
    return "".join(pieces)


def _root(after: str) -> str:
    return "{" + after[0] + "}" + after[1:]


def _fraction(after: str) -> str | None:
    if len(after) < 2:
        return None  # nothing to divide by: the answer stays as it is
    below = after[1] if after[1] == "{" else "{" + after[1] + "}"
    return "{" + after[0] + "}" + below + after[2:]


def _quotient(text: str) -> str:
    if text.count("/") != 1:
        return text
    try:
        a, b = (int(x) for x in text.split("/"))
    except ValueError as e:
        raise Malformed(text) from e
    return f"\\frac{{{a}}}{{{b}}}" if text == f"{a}/{b}" else text


def normalize_math(answer: str) -> str:
    text = _cleaned(answer)
    if text.count("=") == 1 and text.index("=") <= 2:
        text = text.partition("=")[2]
    text = _argument(text, "\\sqrt", _root).replace(" ", "")
    text = _argument(text, "\\frac", _fraction)
    return _quotient("\\frac{1}{2}" if text == "0.5" else text)


def math_equiv(a: str | None, b: str | None) -> bool:
    if a is None or b is None:
        return a is b
    try:
        return normalize_math(a) == normalize_math(b)
    except Malformed:
        return a == b


def math_score_one(response: str | None, truth: str | None) -> float:
    box = last_boxed(response)
    try:
        return float(box is not None and math_equiv(box_content(box), truth))
    except Malformed:
        return 0.0


def _content(text: str | None) -> str | None:
    box = last_boxed(text)
    try:
        return None if box is None else box_content(box)
    except Malformed:
        return None


@F.pandas_udf(T.StringType())
def boxed_answer(s: pd.Series) -> pd.Series:
    """V3 as a column: content of the last boxed expression (null if none)."""
    return s.map(_content)


@F.pandas_udf(T.DoubleType())
def math_score(response: pd.Series, truth: pd.Series) -> pd.Series:
    """V4: 1.0 when the last boxed answer equals the truth after normalising."""
    return pd.Series([math_score_one(r, t) for r, t in zip(response, truth, strict=True)], dtype="float64")
