"""English suffix stripping (Porter 1980 with its author's later changes).

A rule replaces a suffix where what is left is long enough: its measure is the
number of times a vowel run is followed by a consonant run.  Of the rules of a
step the one with the longest suffix counts, also where its condition fails.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of the published algorithm and what replaces them.
LONG_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
MIDDLE_SUFFIXES = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST_SUFFIXES = dict.fromkeys(
    ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
     "ous", "ive", "ize"), "")

MEMO_TERMS = 1 << 16  # terms a worker remembers


def _shape(word: str) -> str:
    """``v`` for vowels (and y after a consonant), ``c`` for all else."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replace(word: str, rules: dict[str, str], least: int) -> str:
    for n in range(min(7, len(word)), 1, -1):
        suffix = word[-n:]
        if suffix in rules:
            rest = word[:-n]
            fits = _measure(rest) >= least and (suffix != "ion" or rest.endswith(("s", "t")))
            return rest + rules[suffix] if fits else word
    return word


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    rest = word[:-2] if word.endswith("ed") else word[:-3] if word.endswith("ing") else ""
    if "v" not in _shape(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if len(rest) > 1 and rest[-1] == rest[-2] and _shape(rest)[-1] == "c":
        return rest if rest[-1] in "lsz" else rest[:-1]
    return rest + "e" if _measure(rest) == 1 and _short_end(rest) else rest


def porter_stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules, least in ((LONG_SUFFIXES, 1), (MIDDLE_SUFFIXES, 1), (LAST_SUFFIXES, 2)):
        word = _replace(word, rules, least)
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stem_terms(terms: Column) -> Column:
    """Stems of an array of terms.  A batch's distinct terms are stemmed once
    (a worker remembers MEMO_TERMS of them), so nothing is shuffled by term."""
    memo: dict[str, str] = {}

    @F.arrow_udf("array<string>")
    def stems(lists: pa.Array) -> pa.Array:
        # flatten() leaves out what null lists may hide, unlike the raw offsets
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(lists.flatten())
        if len(memo) > MEMO_TERMS:
            memo.clear()
        found = []
        for term in coded.dictionary.to_pylist():
            if term not in memo:
                memo[term] = porter_stem(term)
            found.append(memo[term])
        flat = pa.array(found, pa.string()).take(coded.indices)
        ends = sizes.cumsum().astype("int32")
        starts = pa.array([0, *ends], pa.int32())
        out = pa.ListArray.from_arrays(starts, flat)
        return pc.if_else(lists.is_valid(), out, pa.nulls(len(lists), out.type)) if lists.null_count else out

    return stems(terms)
