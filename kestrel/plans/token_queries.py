"""Registered token / sequence queries.

Token ids are derived from whole texts: the id of a word is its length
(``split(text, ' ')``), so every array op runs over every word of every
document.  Array results are compared through their size and a positional
checksum ``sum(x_i * (i + 1))``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import tokens as TK
from kestrel.sources.tables import fixture, read_table, with_fixtures
from kestrel.plans.retrieval_queries import corpus, tok_sql

Q: dict = {}


def reg(name, sql=None, fixtures=()):
    def deco(fn):
        Q[name] = (fn, with_fixtures(sql, *fixtures) if (sql and fixtures) else sql)
        return fn
    return deco


def checksum(a):
    return F.aggregate(F.transform(a, lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"),
                       lambda s, x: s + x)


def sq_checksum(expr):
    return f"CAST(coalesce(list_sum(list_transform({expr}, lambda x, i: CAST(x AS BIGINT) * i)), 0) AS BIGINT)"


def doc_ids(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))


DOC_IDS = "SELECT doc_id, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INT)) AS ids FROM documents"


@reg("T2_pad_left", f"""
WITH d AS ({DOC_IDS}), p AS (SELECT doc_id, list_concat(repeat([0], greatest(4096 - len(ids), 0)), ids) AS a FROM d)
SELECT doc_id, CAST(len(a) AS INT) AS n, {sq_checksum('a')} AS chk FROM p""")
def t2(spark, sf):
    a = TK.pad_to_length("ids", 4096, 0, left_pad=True)
    return doc_ids(spark, sf).select("doc_id", F.size(a).alias("n"), checksum(a).alias("chk"))


@reg("T3_truncate", f"""
WITH d AS ({DOC_IDS})
SELECT doc_id, {sq_checksum('CASE WHEN len(ids) > 256 THEN ids[-256:] ELSE ids END')} AS chk_left,
       {sq_checksum('CASE WHEN len(ids) > 256 THEN ids[1:256] ELSE ids END')} AS chk_right FROM d""")
def t3(spark, sf):
    d = doc_ids(spark, sf)
    return d.select("doc_id", checksum(TK.truncate("ids", 256, "left")).alias("chk_left"),
                    checksum(TK.truncate("ids", 256, "right")).alias("chk_right"))


@reg("T4_position_ids", f"""
WITH d AS ({DOC_IDS}),
x AS (SELECT doc_id, unnest(ids) AS v, unnest(generate_series(1, len(ids))) AS i FROM d),
c AS (SELECT doc_id, i, sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS cs FROM x)
SELECT doc_id, CAST(sum(greatest(cs - 1, 0) * i) AS BIGINT) AS chk FROM c GROUP BY doc_id""")
def t4(spark, sf):
    d = doc_ids(spark, sf).withColumn("mask", TK.attention_mask("ids", 0))
    return d.select("doc_id", checksum(TK.position_ids("mask")).alias("chk"))


@reg("T5_eos_mask", f"""
WITH d AS ({DOC_IDS}), m AS (SELECT doc_id, list_position(ids, 1) AS p, len(ids) AS n FROM d)
SELECT doc_id, CAST(CASE WHEN p IS NULL THEN n ELSE p END AS INT) AS n_ones,
       CAST(CASE WHEN p IS NULL THEN n * (n + 1) // 2 ELSE p * (p + 1) // 2 END AS BIGINT) AS chk FROM m""")
def t5(spark, sf):
    m = TK.eos_mask("ids", 1)
    d = doc_ids(spark, sf)
    return d.select("doc_id", F.aggregate(m, F.lit(0), lambda s, x: s + x).alias("n_ones"), checksum(m).alias("chk"))


@reg("T8_remove_left_pad", f"""
WITH d AS ({DOC_IDS}) SELECT doc_id, {sq_checksum('ids')} AS chk, CAST(len(ids) AS INT) AS n FROM d""")
def t8(spark, sf):
    d = doc_ids(spark, sf)
    padded = TK.pad_to_length("ids", 4096, 0, left_pad=True)
    mask = TK.pad_to_length(F.transform("ids", lambda x: F.lit(1)), 4096, 0, left_pad=True)
    x = d.select("doc_id", padded.alias("p"), mask.alias("m"))
    r = TK.remove_left_pad("p", "m")
    return x.select("doc_id", checksum(r).alias("chk"), F.size(r).alias("n"))


@reg("T9_strip_leading_pad", f"""
WITH d AS ({DOC_IDS}),
p AS (SELECT doc_id, ids, list_position(list_transform(ids, lambda x: x <> 0), true) AS f FROM d)
SELECT doc_id, CAST(CASE WHEN f IS NULL THEN 0 ELSE len(ids) - f + 1 END AS INT) AS n,
       {sq_checksum('CASE WHEN f IS NULL THEN [] ELSE ids[f:] END')} AS chk FROM p""")
def t9(spark, sf):
    s = TK.strip_leading_pad("ids", 0)
    return doc_ids(spark, sf).select("doc_id", F.size(s).alias("n"), checksum(s).alias("chk"))


# conversation pairs: user turn -> next assistant turn
def conv_pairs(spark, sf):
    c = read_table(spark, sf, "conversations")
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", ids.alias("prompt_ids"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      ids.alias("response_ids"))
    return u.join(a, ["conv_id", "turn"])


PAIRS = """
SELECT u.conv_id, u.turn, list_transform(string_split(u.text, ' '), lambda w: CAST(length(w) AS INT)) AS prompt_ids,
       list_transform(string_split(a.text, ' '), lambda w: CAST(length(w) AS INT)) AS response_ids
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'"""


@reg("T6_sft_encode", f"""
WITH p AS ({PAIRS}),
f AS (SELECT conv_id, turn, len(prompt_ids) AS pl, list_concat(prompt_ids, response_ids, [2]) AS fullseq FROM p),
t AS (SELECT *, CASE WHEN len(fullseq) > 128 THEN fullseq[1:128] ELSE fullseq END AS tr FROM f),
e AS (SELECT conv_id, turn, pl, len(fullseq) AS n, list_concat(tr, repeat([0], 128 - len(tr))) AS ids,
             list_concat(repeat([1], len(tr)), repeat([0], 128 - len(tr))) AS att FROM t),
l AS (SELECT *, list_transform(att, lambda m, i: CASE WHEN pl > 1 AND i - 1 < least(pl, 128) - 1 THEN 0
                                                     WHEN i - 1 = least(n, 128) - 1 THEN 0 ELSE m END) AS loss FROM e)
SELECT conv_id, turn, {sq_checksum('ids')} AS chk_ids, {sq_checksum('att')} AS chk_att, {sq_checksum('loss')} AS chk_loss FROM l""")
def t6(spark, sf):
    p = conv_pairs(spark, sf)
    e = TK.sft_encode("prompt_ids", "response_ids", 2, 128, 0, "right")
    return p.select("conv_id", "turn", checksum(e["input_ids"]).alias("chk_ids"),
                    checksum(e["attention_mask"]).alias("chk_att"), checksum(e["loss_mask"]).alias("chk_loss"))


@reg("T7_pair_encode", f"""
WITH p AS ({PAIRS}),
r AS (SELECT conv_id * 1000 + turn AS row_id, prompt_ids, response_ids AS chosen, list_reverse(response_ids) AS rejected FROM p),
x AS (SELECT row_id, 0 AS is_rejected, list_concat(prompt_ids, chosen, [2]) AS s FROM r
      UNION ALL SELECT row_id, 1, list_concat(prompt_ids, rejected, [2]) FROM r),
t AS (SELECT row_id, is_rejected, CASE WHEN len(s) > 96 THEN s[1:96] ELSE s END AS s FROM x)
SELECT row_id, CAST(is_rejected AS INT) AS is_rejected, {sq_checksum('list_concat(s, repeat([0], 96 - len(s)))')} AS chk_ids,
       {sq_checksum('list_concat(repeat([1], len(s)), repeat([0], 96 - len(s)))')} AS chk_att FROM t""")
def t7(spark, sf):
    p = conv_pairs(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "prompt_ids",
                                     F.col("response_ids").alias("chosen_ids"),
                                     F.reverse("response_ids").alias("rejected_ids"))
    e = TK.pair_encode(p, eos_id=2, max_length=96)
    return e.select("row_id", F.col("is_rejected").cast("int").alias("is_rejected"),
                    checksum("input_ids").alias("chk_ids"), checksum("attention_mask").alias("chk_att"))


@reg("T10_join_prompt_response", f"""
WITH p AS ({PAIRS}),
j AS (SELECT conv_id, turn, list_concat(prompt_ids, response_ids) AS ids, len(prompt_ids) AS pl,
             list_position(response_ids, 1) AS e, len(response_ids) AS rl FROM p)
SELECT conv_id, turn, {sq_checksum('ids')} AS chk_ids,
       CAST(pl + CASE WHEN e IS NULL THEN rl ELSE e END AS INT) AS n_attended,
       CAST(pl * (pl - 1) // 2 + rl * (pl - 1) + rl * (rl + 1) // 2 AS BIGINT) AS pos_sum FROM j""")
def t10(spark, sf):
    p = conv_pairs(spark, sf)
    pm = F.transform("prompt_ids", lambda x: F.lit(1))
    pp = F.transform("prompt_ids", lambda x, i: i)
    j = TK.join_prompt_response("prompt_ids", pm, pp, "response_ids", 1)
    return p.select("conv_id", "turn", checksum(j["input_ids"]).alias("chk_ids"),
                    F.aggregate(j["attention_mask"], F.lit(0), lambda s, x: s + x).alias("n_attended"),
                    F.aggregate(j["position_ids"], F.lit(0).cast("bigint"), lambda s, x: s + x).alias("pos_sum"))


@reg("T11_prompt_response_lengths", f"""
WITH p AS ({PAIRS}),
j AS (SELECT conv_id, turn, len(prompt_ids) AS pl, list_position(response_ids, 1) AS e, len(response_ids) AS rl FROM p)
SELECT conv_id, turn, CAST(pl AS INT) AS prompt_length, CAST(CASE WHEN e IS NULL THEN rl ELSE e END AS INT) AS response_length FROM j""")
def t11(spark, sf):
    p = conv_pairs(spark, sf)
    m = F.concat(F.transform("prompt_ids", lambda x: F.lit(1)), TK.eos_mask("response_ids", 1))
    lens = TK.prompt_response_lengths(m, F.size("prompt_ids"))
    return p.select("conv_id", "turn", lens["prompt_length"].alias("prompt_length"),
                    lens["response_length"].alias("response_length"))


@reg("T12_value_at_last_token", """
WITH p AS (SELECT *, greatest(sum(mask) OVER (PARTITION BY rollout_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 0) AS pos
           FROM fx_tokens)
SELECT rollout_id, arg_max(v, (pos * mask, -t)) AS last_value, CAST(arg_max(t, (pos * mask, -t)) AS INT) AS last_t FROM p GROUP BY rollout_id""",
     ("fx_tokens",))
def t12(spark, sf):
    t = TK.position_ids_long(fixture(spark, sf, "fx_tokens"))
    return TK.value_at_last_token(t, "v", "pos")


@reg("T13_expand_to_tokens", """
SELECT rollout_id, CAST(64 AS INT) AS n, round(score * response_len, 6) + 0.0 AS chk FROM fx_rollouts""", ("fx_rollouts",))
def t13(spark, sf):
    r = fixture(spark, sf, "fx_rollouts").withColumn("width", F.lit(64)).withColumn("last", F.col("response_len") - 1)
    a = TK.expand_to_tokens("score", "last", "width")
    chk = F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return r.select("rollout_id", F.size(a).alias("n"), (F.round(chk, 6) + F.lit(0.0)).alias("chk"))


@reg("T14_pad_packed", f"""
WITH d AS ({DOC_IDS}) SELECT doc_id, CAST(len(ids) + (128 - len(ids) % 128) % 128 AS INT) AS n FROM d""")
def t14(spark, sf):
    return doc_ids(spark, sf).select("doc_id", F.size(TK.pad_packed("ids", 128)).alias("n"))


@reg("T15_collate", """
SELECT batch_id, CAST(row_idx // 8 AS BIGINT) AS part, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_idx) AS row_ids
FROM fx_lengths GROUP BY ALL""", ("fx_lengths",))
def t15(spark, sf):
    d = fixture(spark, sf, "fx_lengths").withColumn("part", (F.col("row_idx") / 8).cast("bigint"))
    g = TK.to_arrays(d.withColumn("rid", F.col("row_id").cast("string")), ["batch_id", "part"], "row_idx", ["rid"])
    return g.select("batch_id", "part", F.array_join("rid", ",").alias("row_ids"))


@reg("T16_render_chat", """
SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) || '<|assistant|>' || chr(10) AS rendered,
       CAST(count(*) AS INTEGER) AS n_turns FROM conversations GROUP BY conv_id""")
def t16(spark, sf):
    c = read_table(spark, sf, "conversations")
    return TK.render_chat(c, add_generation_prompt="<|assistant|>\n")


@reg("T17_retemplate", """
SELECT conv_id, turn, CAST(length(replace(replace(text, chr(10), ' <nl> '), '.', ' . ')) AS INT) AS n_chars,
       length(replace(replace(text, chr(10), ' <nl> '), '.', ' . ')) > length(text) + 128 AS too_long FROM conversations""")
def t17(spark, sf):
    c = read_table(spark, sf, "conversations")
    r = TK.retemplate("text", [("\n", " <nl> "), (".", " . ")])
    return c.select("conv_id", "turn", F.length(r["text"]).alias("n_chars"), r["too_long"].alias("too_long"))


@reg("T18_decode", f"""
SELECT doc_id, array_to_string({tok_sql('text')}, ' ') AS text FROM documents""")
def t18(spark, sf):
    from kestrel.operators.tokens import build_dictionary, join_terms
    from kestrel.session import cut_lineage
    docs = corpus(spark, sf)
    voc = cut_lineage(build_dictionary(docs, "doc_id", "tokens"), "terms")
    long = join_terms(docs.select("doc_id", F.posexplode("tokens").alias("t", "term")), voc.select("term", "term_id", "df"))
    vocab = voc.select(F.col("term_id").alias("token_id"), F.col("term").alias("piece"))
    dec = TK.decode(long.select("doc_id", "t", F.col("term_id").alias("token_id")), vocab, row_key="doc_id")
    # documents without any token decode to the empty string
    return docs.select("doc_id").join(dec, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
