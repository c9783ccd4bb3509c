"""Token and sequence operators (T*) plus long <-> array form conversion.

Array ops are higher-order functions on ``array<int>`` columns (row-local,
codegen'd).  Only the cumulative-sum position ids for long arrays use an
Arrow ``pandas_udf`` (numpy cumsum), because an array-HOF prefix sum is
O(L^2) per row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.stemming import stem_terms
from kestrel.functions.text import col
from kestrel.session import cut_lineage


# ---------------------------------------------------- layout conversion

def to_arrays(tokens: DataFrame, row_key, t="t", cols=()) -> DataFrame:
    """Long form -> one row per sequence with arrays ordered by ``t``.

    One shuffle on the row key; a sequence is bounded by its length, so no
    group is unbounded.
    """
    row_key = [row_key] if isinstance(row_key, str) else list(row_key)
    cols = list(cols)
    packed = F.sort_array(F.collect_list(F.struct(col(t).alias("_t"), *[col(c).alias(c) for c in cols])))
    g = tokens.groupBy(*row_key).agg(packed.alias("_seq"))
    return g.select(*row_key, *[F.col(f"_seq.{c}").alias(c) for c in cols])


def to_long(arrays: DataFrame, row_key, t="t", cols=()) -> DataFrame:
    """Array form -> one row per position (``posexplode``; no shuffle)."""
    row_key = [row_key] if isinstance(row_key, str) else list(row_key)
    cols = list(cols)
    z = F.arrays_zip(*[F.col(c) for c in cols])
    x = arrays.select(*row_key, F.posexplode(z).alias(t, "_z"))
    return x.select(*row_key, F.col(t).cast("int").alias(t), *[F.col(f"_z.{c}").alias(c) for c in cols])


# ----------------------------------------------------------- array operators

def pad_to_length(a, max_len: int, pad_id, left_pad: bool = False) -> Column:
    """Pad to ``max_len``; no-op when already at least that long."""
    a = col(a)
    fill = F.array_repeat(F.lit(pad_id).cast("int") if isinstance(pad_id, int) else col(pad_id),
                          F.greatest(F.lit(max_len) - F.size(a), F.lit(0)))
    return F.concat(fill, a) if left_pad else F.concat(a, fill)


def truncate(a, max_len: int, side: str = "right") -> Column:
    """``left`` keeps the last n, ``right`` the first n, ``error`` fails."""
    a = col(a)
    if side == "left":
        return F.when(F.size(a) > max_len, F.slice(a, -max_len, max_len)).otherwise(a)
    if side == "right":
        return F.when(F.size(a) > max_len, F.slice(a, 1, max_len)).otherwise(a)
    if side == "error":
        return F.when(F.size(a) > max_len, F.raise_error(F.lit(f"sequence longer than {max_len}"))
                      .cast(T.ArrayType(T.IntegerType()))).otherwise(a)
    raise NotImplementedError(f"unknown truncation {side!r}")


def attention_mask(ids, pad_id: int = 0) -> Column:
    return F.transform(col(ids), lambda x: F.when(x == pad_id, 0).otherwise(1))


def eos_mask(ids, eos_id: int = 2) -> Column:
    """T5: 1 up to and including the first EOS, 0 after; all 1 without EOS.

    Built as ones ++ zeros so the EOS position is found once per row (a
    reference inside a lambda would be re-evaluated for every element)."""
    n = F.size(col(ids))
    p = F.array_position(col(ids), eos_id)
    ones = F.when(p == 0, n).otherwise(p).cast("int")
    return F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), n - ones))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def position_ids(mask: pd.Series) -> pd.Series:
    """T4 (array form): max(cumsum(mask) - 1, 0), numpy per row."""
    return mask.map(lambda m: np.maximum(np.cumsum(np.asarray(m, dtype=np.int64)) - 1, 0).astype(np.int32),
                    na_action="ignore")


def position_ids_long(tokens: DataFrame, mask="mask", row_key="rollout_id", t="t", out="pos") -> DataFrame:
    """T4 (long form): running sum of the mask within a sequence."""
    w = Window.partitionBy(row_key).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn(out, F.greatest(F.sum(col(mask)).over(w) - 1, F.lit(0)).cast("int"))


def remove_left_pad(ids, mask) -> Column:
    """The last ``sum(mask)`` ids."""
    s = F.aggregate(col(mask), F.lit(0), lambda a, m: a + m)
    return F.when(s > 0, F.slice(col(ids), F.size(col(ids)) - s + 1, s)).otherwise(F.array().cast("array<int>"))


def strip_leading_pad(ids, pad_id: int) -> Column:
    """Start at the first id that is not the pad id (empty when all pad)."""
    p = F.array_position(F.transform(col(ids), lambda x: x != pad_id), True)
    return F.when(p > 0, F.slice(col(ids), p, F.size(col(ids)) - p + 1)).otherwise(F.array().cast("array<int>"))


def join_prompt_response(prompt_ids, prompt_mask, prompt_pos, response_ids, eos_id: int) -> dict[str, Column]:
    """Ids concat; response positions continue after the last prompt
    position; mask = prompt mask || EOS mask of the response."""
    last = F.element_at(col(prompt_pos), -1)
    rpos = F.transform(col(response_ids), lambda x, i: last + i + 1)
    return {"input_ids": F.concat(col(prompt_ids), col(response_ids)),
            "attention_mask": F.concat(col(prompt_mask), eos_mask(response_ids, eos_id)),
            "position_ids": F.concat(col(prompt_pos), rpos)}


def prompt_response_lengths(mask, prompt_width) -> dict[str, Column]:
    """Valid prompt and response lengths from one mask."""
    pw = prompt_width if isinstance(prompt_width, Column) else F.lit(prompt_width)
    m = col(mask)
    pl = F.aggregate(F.slice(m, 1, pw), F.lit(0), lambda a, x: a + x)
    rl = F.aggregate(F.slice(m, pw + 1, F.greatest(F.size(m) - pw, F.lit(1))), F.lit(0), lambda a, x: a + x)
    rl = F.when(F.size(m) > pw, rl).otherwise(F.lit(0))
    return {"prompt_length": pl, "response_length": rl}


def value_at_last_token(tokens: DataFrame, value="value", pos="pos", mask="mask", row_key="rollout_id",
                        t="t") -> DataFrame:
    """Value at argmax(pos * mask), first position on ties."""
    key = F.struct((col(pos) * col(mask)).alias("k"), (-col(t)).alias("nt"))
    return tokens.groupBy(row_key).agg(F.max_by(col(value), key).alias("last_value"),
                                       F.max_by(col(t), key).alias("last_t"))


def expand_to_tokens(score, last_index, length) -> Column:
    """Scalar score at ``last_index`` (0-based), zeros elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.greatest(col(length) - 1, F.lit(0))),
                       lambda i: F.when(i == col(last_index), col(score).cast("double")).otherwise(F.lit(0.0)))


def pad_packed(a, multiple: int) -> Column:
    """Pad a packed stream with zeros to a multiple of ``multiple``."""
    return F.concat(col(a), F.array_repeat(F.lit(0), F.pmod(-F.size(col(a)), F.lit(multiple))))


def sft_encode(prompt_ids, response_ids, eos_id: int, max_length: int, pad_id: int = 0,
               truncation: str = "error") -> dict[str, Column]:
    """Prompt + response + EOS, right padded; loss mask = attention mask
    with the prompt (first ``min(prompt_len, L) - 1`` positions, when the
    prompt is longer than one token) and the last valid position zeroed."""
    full = F.concat(col(prompt_ids), col(response_ids), F.array(F.lit(eos_id)))
    n = F.size(col(prompt_ids)) + F.size(col(response_ids)) + 1
    ids = truncate(full, max_length, "right" if truncation == "right" else
                   "left" if truncation == "left" else "error")
    att = F.transform(ids, lambda x: F.lit(1))
    ids_p = pad_to_length(ids, max_length, pad_id)
    att_p = pad_to_length(att, max_length, 0)
    pl = F.size(col(prompt_ids))
    cut = F.least(pl, F.lit(max_length)) - 1
    last = F.least(n, F.lit(max_length)) - 1
    loss = F.transform(att_p, lambda m, i: F.when((pl > 1) & (i < cut), 0).when(i == last, 0).otherwise(m))
    return {"input_ids": ids_p, "attention_mask": att_p, "loss_mask": loss}


def pair_encode(df: DataFrame, prompt_ids="prompt_ids", chosen_ids="chosen_ids", rejected_ids="rejected_ids",
                eos_id: int = 2, max_length: int = 512, pad_id: int = 0, row_key="row_id") -> DataFrame:
    """prompt+chosen(+eos) and prompt+rejected(+eos), padded with 0 and
    right-truncated, as two rows (chosen first) with their own masks."""
    def enc(r):
        s = F.concat(col(prompt_ids), col(r), F.array(F.lit(eos_id)))
        s = truncate(s, max_length, "right")
        return F.struct(pad_to_length(s, max_length, pad_id).alias("input_ids"),
                        pad_to_length(F.transform(s, lambda x: F.lit(1)), max_length, 0).alias("attention_mask"))
    pairs = F.array(enc(chosen_ids), enc(rejected_ids))
    x = df.select(row_key, F.posexplode(pairs).alias("is_rejected", "_e"))
    return x.select(row_key, "is_rejected", "_e.input_ids", "_e.attention_mask")


def render_chat(turns: DataFrame, conv_key="conv_id", order="turn", role="role", text="text",
                template: str = "<|{role}|>\n{text}\n", add_generation_prompt: str | None = None) -> DataFrame:
    """Ordered turns of a conversation rendered with a template.

    Each turn is rendered in place (narrow), then one ordered string per
    conversation is assembled.
    """
    pre, mid_rest = template.split("{role}")
    mid, post = mid_rest.split("{text}")
    piece = F.concat(F.lit(pre), col(role), F.lit(mid), col(text), F.lit(post))
    g = (turns.select(conv_key, F.struct(col(order).alias("o"), piece.alias("p")).alias("_s"))
              .groupBy(conv_key).agg(F.sort_array(F.collect_list("_s")).alias("_l")))
    out = F.array_join(F.transform(F.col("_l"), lambda s: s["p"]), "")
    if add_generation_prompt is not None:
        out = F.concat(out, F.lit(add_generation_prompt))
    return g.select(conv_key, out.alias("rendered"), F.size("_l").alias("n_turns"))


def retemplate(text, replacements, max_len_of=None, slack: int = 128) -> dict[str, Column]:
    """Literal replaces in order; flag when longer than original + slack."""
    out = col(text)
    for a, b in replacements:
        out = F.replace(out, F.lit(a), F.lit(b))
    ref = col(max_len_of) if max_len_of is not None else col(text)
    return {"text": out, "too_long": F.length(out) > F.length(ref) + slack}


#: Bytes of a vocabulary (pieces, and 16 per id) that every task may hold.
PIECE_TABLE_BYTES = 64 << 20


def decode(ids_long: DataFrame, vocab: DataFrame, row_key="row_id", t="t", token_id="token_id",
           piece="piece", pad_piece: str | None = None, sep: str = " ") -> DataFrame:
    """Ids -> text; ordered concat; pad removed; unknown and null ids are empty pieces.

    Ids are gathered per row as numbers and looked up in a piece table inside
    Arrow batches, so nothing is shuffled by token (a frequent token would be
    one hot key).  The table is sent to the tasks after a check of its bytes;
    a larger vocabulary is joined.  A vocabulary has each id once."""
    vocab = cut_lineage(vocab.select(col(token_id).cast("long").alias("_id"), F.coalesce(col(piece), F.lit("")).alias("_p")), "pieces")
    n, size = vocab.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_p")), F.lit(0))).first()
    if 16 * n + size <= PIECE_TABLE_BYTES:
        g = ids_long.groupBy(row_key).agg(F.sort_array(F.collect_list(F.struct(
            col(t).alias("t"), col(token_id).cast("long").alias("i")))).alias("_l"))
        out = _pieces_of(vocab, sep)(F.transform("_l", lambda s: s["i"]))
    else:
        j = ids_long.withColumn("_id", col(token_id).cast("long")).join(vocab, "_id", "left")
        g = j.groupBy(row_key).agg(F.sort_array(F.collect_list(F.struct(
            col(t).alias("t"), F.coalesce("_p", F.lit("")).alias("p")))).alias("_l"))
        out = F.array_join(F.transform("_l", lambda s: s["p"]), sep)
    if pad_piece is not None:
        out = F.replace(out, F.lit(pad_piece), F.lit(""))
    return g.select(row_key, out.alias("text"))


def _pieces_of(vocab: DataFrame, sep: str):
    """A function from id arrays to joined pieces, by a table sorted by id."""
    table = vocab.filter(F.col("_id").isNotNull()).toArrow().sort_by("_id")
    shared = vocab.sparkSession.sparkContext.broadcast(
        (table["_id"].to_numpy(), pa.array(table["_p"].to_pylist() + [""], pa.large_string())))

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        ids, pieces = shared.value
        flat = lists.flatten()
        wanted = flat.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.searchsorted(ids, wanted)
        known = np.zeros(len(wanted), bool) if not len(ids) else ids[np.minimum(at, len(ids) - 1)] == wanted
        known &= flat.is_valid().to_numpy(zero_copy_only=False)
        found = pieces.take(pa.array(np.where(known, at, len(ids))))
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), found), pa.scalar(sep, pa.large_string())).cast(pa.string())

    return text_of


# ------------------------------------------------------------ vocabulary

WORD_SPLIT = r"[^\p{L}\p{N}]+"


POSSESSIVE = r"['\u2019\uFF07]s(?![\p{L}\p{N}])"


def analyse(text, stopwords=(), stem: bool = False) -> Column:
    """R1/T1 analyser: lower case, split on non letters/digits, drop empty
    tokens and stop words.  ``stem`` also drops the possessive ``'s`` before the
    split and reduces each token to its English stem after it."""
    lower = F.lower(col(text))
    toks = F.split(F.regexp_replace(lower, POSSESSIVE, "") if stem else lower, WORD_SPLIT)
    if stopwords:  # a literal IN list becomes a hash-set lookup
        toks = F.filter(toks, lambda x: (x != "") & ~x.isin(*stopwords))
    else:
        toks = F.filter(toks, lambda x: x != "")
    return stem_terms(toks) if stem else toks


def build_dictionary(docs: DataFrame, doc_key="doc_id", tokens="tokens", by=()) -> DataFrame:
    """Term -> dense id (sorted term order), document frequency.

    Dense ids come from a distributed global index over the sorted
    vocabulary (numbered partition by partition, never in one task).
    """
    by = list(by)
    post = docs.select(*by, doc_key, F.explode(F.array_distinct(col(tokens))).alias("term"))
    if docs.groupBy(*by, doc_key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).isEmpty():
        return dictionary_from_postings(post, by)  # a row per document: terms are counted where they are
    return dictionary_from_postings(post.distinct(), by)


def dictionary_from_postings(post: DataFrame, by=()) -> DataFrame:
    """T1 from an existing postings table (one row per (term, doc)): the
    document frequency is a count per term, no second pass over the text."""
    from kestrel.operators.batch import global_index
    by = list(by)
    df = post.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    return global_index(df, [*by, "term"], "term_id")


#: Terms that are sent to every task: at most so many, of at most so many bytes.
FREQUENT_TERMS, FREQUENT_BYTES = 8192, 1024


def join_terms(post: DataFrame, terms: DataFrame, by=(), df="df") -> DataFrame:
    """Postings joined to a written table with a row per term and its document
    frequency.  Terms with a FREQUENT_TERMS-th of all postings or more are at
    most FREQUENT_TERMS: they are broadcast and their postings stay where they
    are.  The others are shuffled by term, none of them a large group."""
    on = [*by, "term"]
    total = terms.agg(F.sum(df)).first()[0] or 0
    frequent = (F.col(df) * FREQUENT_TERMS >= total) & (F.octet_length("term") <= FREQUENT_BYTES)
    hot, rest = F.broadcast(terms.filter(frequent)), terms.filter(~frequent)
    cold = post.join(F.broadcast(terms.filter(frequent).select(*on)), on, "left_anti").join(rest, on)
    return post.join(hot, on).unionByName(cold)


def bag_of_words(docs: DataFrame, dictionary: DataFrame, doc_key="doc_id", tokens="tokens", by=()) -> DataFrame:
    """T1 doc2bow: (doc, term_id, count); unknown tokens are dropped."""
    by = list(by)
    tf = docs.select(*by, doc_key, F.explode(col(tokens)).alias("term")).groupBy(*by, doc_key, "term") \
        .agg(F.count(F.lit(1)).alias("tf"))
    return join_terms(tf, dictionary.select(*by, "term", "term_id", "df"), by).drop("df")
