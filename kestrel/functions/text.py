"""Column-level text helpers (all JVM-side expressions).

Python and Java regex differ: Python ``.`` excludes only ``\\n`` (use ``(?d)``
in Java), DOTALL is ``(?s)``, and Python ``\\d``/``\\s``/``\\b`` are Unicode
(``(?U)`` in Java).  Python ``str.strip()`` removes all Unicode whitespace,
Spark ``trim`` only spaces, hence ``py_strip``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Response header markers used by the rule-based scorers.
ASSISTANT_HEADER = "Assistant:"
CHATML_ASSISTANT_HEADER = "<|im_start|>assistant"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: drop leading/trailing Unicode whitespace."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def after_first(c, marker: str) -> Column:
    """Text after the first occurrence of ``marker`` (``str.split(m, 1)[1]``)."""
    return F.element_at(F.split(col(c), re.escape(marker), 2), 2)


def contains(c, marker: str) -> Column:
    return F.instr(col(c), marker) > 0


def count_substr(c, sub: str) -> Column:
    """Non-overlapping occurrences of a literal (``str.count``)."""
    c = col(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(sub), F.lit("")))) / len(sub)).cast("int")


def split_header(c, markers=(ASSISTANT_HEADER, CHATML_ASSISTANT_HEADER)) -> Column:
    """V7: struct(has_header, processed).

    The text after the first matching header (tried in order); without any
    header the whole string is kept and ``has_header`` is false.
    """
    c = col(c)
    processed = c
    has = F.lit(False)
    for m in reversed(markers):
        processed = F.when(contains(c, m), after_first(c, m)).otherwise(processed)
    for m in markers:
        has = has | contains(c, m)
    return F.struct(has.alias("has_header"), processed.alias("processed"))


def last_tag_content(c, tag: str, dotall: bool = True) -> Column:
    """Content of the last ``<tag>...</tag>`` (lazy match), null when absent."""
    flags = "(?s)" if dotall else "(?d)"
    pat = f"{flags}<{tag}>(.*?)</{tag}>"
    return F.try_element_at(F.regexp_extract_all(col(c), F.lit(pat), 1), F.lit(-1))


def tags_in_order(c, tags) -> Column:
    """V8: every tag occurs exactly once and in the given order."""
    c = col(c)
    ok = F.lit(True)
    for t in tags:
        ok = ok & (count_substr(c, t) == 1)
    pos = [F.instr(c, t) - 1 for t in tags]
    for a, b in zip(pos, pos[1:]):
        ok = ok & (a <= b)
    return ok


THINK_ANSWER_TAGS = ("<think>", "</think>", "<answer>", "</answer>")
THINK_QUERY_TAGS = ("<think>", "</think>", "<query>", "</query>")
