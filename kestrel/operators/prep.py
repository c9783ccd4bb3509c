"""Dataset preparation (P*): raw task tables -> the common prompt schema.

Every prompt row has ``data_source, prompt array<struct<role, content>>,
ability, reward_model struct<style, ground_truth string>, extra_info
struct<split, index>``.  The ground truth is always a JSON string so tasks
with different truth types can be unioned (``unionByName``).

Positional semantics (``index`` within a split, "first N rows") use the
skew-proof distributed index of ``kestrel.operators.batch`` instead of an
un-partitioned window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions import templates as TPL
from kestrel.functions.text import col, py_strip
from kestrel.operators.batch import global_index, index_within

GSM8K_SOLUTION = r"#### (\-?[0-9\.\,]+)"


def prompt_struct(data_source, content, ability, style, ground_truth, split, index,
                  system: Column | None = None, extra: dict | None = None) -> dict[str, Column]:
    """The five fields of a prompt row."""
    def c(x):
        return x if isinstance(x, Column) else F.lit(x)
    turns = [F.struct(F.lit("user").alias("role"), c(content).alias("content"))]
    if system is not None:
        turns.insert(0, F.struct(F.lit("system").alias("role"), system.alias("content")))
    extra_fields = [c(v).alias(k) for k, v in (extra or {}).items()]
    return {"data_source": c(data_source), "prompt": F.array(*turns), "ability": c(ability),
            "reward_model": F.struct(c(style).alias("style"), c(ground_truth).cast("string").alias("ground_truth")),
            "extra_info": F.struct(c(split).alias("split"), c(index).cast("bigint").alias("index"), *extra_fields)}


def to_prompt_rows(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    return df.select(*[v.alias(k) for k, v in fields.items()])


def with_split_index(df: DataFrame, order, split="split", name="index") -> DataFrame:
    """0-based row number within each split."""
    return index_within(df, split, order, name)


def positional_split(df: DataFrame, order, train_size: int, test_size: int, mode: str = "head_next",
                     n: int | None = None) -> DataFrame:
    """``head_next``: first train_size rows, then the next test_size;
    ``head_tail``: first train_size and last test_size.  Size checked."""
    g = global_index(df, order, "_pos")
    n = g.count() if n is None else n
    if n < train_size + test_size:
        raise ValueError(f"{n} rows < train {train_size} + test {test_size}")
    if mode == "head_next":
        test = (F.col("_pos") >= train_size) & (F.col("_pos") < train_size + test_size)
    elif mode == "head_tail":
        test = F.col("_pos") >= n - test_size
    else:
        raise ValueError(mode)
    out = g.withColumn("split", F.when(F.col("_pos") < train_size, "train").when(test, "test"))
    out = out.filter(F.col("split").isNotNull())
    return out.withColumn("index", F.when(F.col("split") == "train", F.col("_pos"))
                          .otherwise(F.col("_pos") - (train_size if mode == "head_next" else n - test_size))) \
              .drop("_pos")


def gsm8k_truth(answer) -> Column:
    """First ``#### number`` with commas removed; a missing marker is an error."""
    hit = F.regexp_extract(col(answer), GSM8K_SOLUTION, 1)
    return F.when(hit == "", F.raise_error(F.lit("no #### answer"))).otherwise(
        F.replace(hit, F.lit(","), F.lit("")))


def gsm8k_prompts(df: DataFrame, question="question", answer="answer", split="split", index="index") -> DataFrame:
    content = F.concat(col(question), F.lit(" " + TPL.GSM8K_INSTRUCTION))
    f = prompt_struct("openai/gsm8k", content, "math", "rule", gsm8k_truth(answer), col(split), col(index),
                      extra={"answer": col(answer), "question": col(question)})
    return to_prompt_rows(df, f)


def math_prompts(df: DataFrame, problem="problem", solution="solution", split="split", index="index") -> DataFrame:
    """Problem + instruction; ground truth = content of the last boxed answer."""
    from kestrel.operators.scoring import boxed_answer
    content = F.concat(col(problem), F.lit(" " + TPL.MATH_INSTRUCTION))
    return to_prompt_rows(df, prompt_struct("lighteval/MATH", content, "math", "rule", boxed_answer(col(solution)),
                                            col(split), col(index)))


def kk_prompts(df: DataFrame, template_type: str = "qwen-instruct", quiz="quiz",
               solution="solution_text_format", statements="statements") -> DataFrame:
    """Puzzle prompts; ground truth {solution_text_format, statements}."""
    tpl = {"base": TPL.KK_BASE, "qwen-instruct": TPL.KK_QWEN}[template_type]
    gt = F.to_json(F.struct(col(solution).alias("solution_text_format"), col(statements).alias("statements")))
    return to_prompt_rows(df, prompt_struct("kk_logic", TPL.render(tpl, quiz=col(quiz)), "logic", "rule", gt,
                                            F.col("split"), F.col("index")))


def py_list(nums) -> Column:
    """Python ``str(list)`` of integers: ``[1, 2, 3]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(col(nums), lambda x: x.cast("string")), ", "), F.lit("]"))


def countdown_prompts(df: DataFrame, template_type: str = "base", nums="nums", target="target") -> DataFrame:
    """P5: countdown prompts; ground truth {target, numbers}."""
    tpl = {"base": TPL.COUNTDOWN_BASE, "qwen-instruct": TPL.COUNTDOWN_QWEN}[template_type]
    gt = F.to_json(F.struct(col(target).alias("target"), col(nums).alias("numbers")))
    return to_prompt_rows(df, prompt_struct("countdown", TPL.render(tpl, numbers=py_list(nums), target=col(target).cast("string")),
                                            "math", "rule", gt, F.col("split"), F.col("index")))


# Data sources of the two arithmetic tasks.
ARITHMETIC_SOURCE, MULTIPLY_SOURCE = "yolo/arithmetic-3_digit", "yolo/multiply-3_digit"


def arithmetic_prompts(df: DataFrame, multiply: bool = False, data_source: str | None = None) -> DataFrame:
    """``{num1} {op} {num2}`` prompts; ground truth = the exact result."""
    data_source = data_source or (MULTIPLY_SOURCE if multiply else ARITHMETIC_SOURCE)
    n1, n2 = F.col("num1").cast("string"), F.col("num2").cast("string")
    if multiply:
        content = TPL.render(TPL.MULTIPLY, num1=n1, num2=n2)
        truth = (F.col("num1") * F.col("num2")).cast("string")
    else:
        content = TPL.render(TPL.ARITH, num1=n1, op=F.col("op"), num2=n2)
        truth = (F.when(F.col("op") == "*", F.col("num1") * F.col("num2"))
                 .when(F.col("op") == "+", F.col("num1") + F.col("num2"))
                 .otherwise(F.col("num1") - F.col("num2"))).cast("string")
    return to_prompt_rows(df, prompt_struct(data_source, content, "math", "rule", truth, F.col("split"), F.col("index")))


def hellaswag_clean(text) -> Column:
    """P8 ``preprocess``: strip, " [title]" -> ". ", drop ``[...]``, one pass of
    double space -> single space."""
    t = py_strip(text)
    t = F.replace(t, F.lit(" [title]"), F.lit(". "))
    t = F.regexp_replace(t, r"(?d)\[.*?\]", "")
    return F.replace(t, F.lit("  "), F.lit(" "))


def py_capitalize(s) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    return F.concat(F.upper(F.substring(col(s), 1, 1)), F.lower(F.substr(col(s), F.lit(2))))


def labelled(df: DataFrame, label="label") -> DataFrame:
    return df.filter(F.length(label) > 0)


def hellaswag_prompts(df: DataFrame) -> DataFrame:
    """Rows with an empty label dropped; query and endings cleaned.  The
    index (``labelled``) counts the labelled rows alone."""
    x = labelled(df)
    ctx = F.concat(F.col("ctx_a"), F.lit(" "), py_capitalize("ctx_b"))
    query = hellaswag_clean(F.concat(F.col("activity_label"), F.lit(": "), ctx))
    choices = F.transform("endings", lambda e: hellaswag_clean(e))
    f = {"data_source": F.lit("Rowan/hellaswag"),
         "prompt": F.array(F.struct(F.lit("user").alias("role"), query.alias("content"))),
         "ability": F.lit("nlp"),
         "reward_model": F.struct(F.lit("model").alias("style"), F.lit("multiple_choice").alias("eval"),
                                  F.col("label").cast("int").alias("ground_truth"), choices.alias("choices")),
         "extra_info": F.struct(F.col("split"), F.col("index").cast("bigint").alias("index"))}
    return to_prompt_rows(x, f)


def sft_rows(df: DataFrame, prompt="prompt", chosen="chosen", rejected="rejected", row_key="row_id") -> DataFrame:
    """Two SFT rows per pair (prompt + chosen first, then + rejected)."""
    x = df.select(row_key, prompt, F.posexplode(F.array(col(chosen), col(rejected))).alias("variant", "response"))
    return x.select(row_key, "variant", prompt, "response")


def rm_split(df: DataFrame, order, train_frac: float = 0.75) -> DataFrame:
    """P10: first 75 % of rows -> train, the rest -> test (row count as a scalar)."""
    g = global_index(df, order, "_pos")
    cut = int(g.count() * train_frac)
    return g.withColumn("split", F.when(F.col("_pos") < cut, "train").otherwise("test")) \
        .withColumn("index", F.when(F.col("_pos") < cut, F.col("_pos")).otherwise(F.col("_pos") - cut).cast("bigint")) \
        .drop("_pos")


def rl_prompts(df: DataFrame, prompt="prompt", response="response", data_source: str = "Dahoas/full-hh-rlhf") -> DataFrame:
    """RL prompts, reward style ``model``; ground truth = the response column (name is a parameter)."""
    return to_prompt_rows(df, prompt_struct(data_source, col(prompt), "alignment", "model", col(response),
                                            F.col("split"), F.col("index")))


def qrels_json(qid, gold_ids) -> Column:
    """``{"qrels": {qid: {gold: 1, ...}}}``."""
    inner = F.map_from_arrays(col(gold_ids), F.transform(col(gold_ids), lambda g: F.lit(1)))
    return F.to_json(F.struct(F.create_map(col(qid).cast("string"), inner).alias("qrels")))


def retrieval_prompts(examples: DataFrame, template: str = "query") -> DataFrame:
    """P12 (``query``) / P14 (``raw``): per task and split; data_source =
    prefix + task; extra_info carries ``idx`` (not ``index``), see P24."""
    if template == "query":
        content = TPL.render(TPL.RETRIEVAL_QUERY, query=F.col("query"))
    else:
        content = TPL.render(TPL.CHATML_USER, prompt=TPL.render(TPL.RAW_SEARCH_PROMPT, query=F.col("query")))
    f = {"data_source": F.concat(F.lit(TPL.RETRIEVAL_SOURCE_PREFIX), F.col("task")),
         "prompt": F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))),
         "ability": F.lit("math"),
         "reward_model": F.struct(F.lit("rule").alias("style"), qrels_json("qid", "gold_ids").alias("ground_truth")),
         "extra_info": F.struct(F.col("split"), F.col("idx").cast("bigint").alias("idx"), F.col("query"),
                                F.col("qid").cast("string").alias("qid"))}
    return to_prompt_rows(examples, f)


def gold_documents(examples: DataFrame, docs: DataFrame, qid="qid", gold_ids="gold_ids", doc_key="doc_id",
                   content="text", strict: bool = True) -> DataFrame:
    """P13 join: (qid -> gold document texts in gold order); a missing id is
    an error (strict) — one row per gold pair, then an ordered collect per
    example (bounded by its number of gold ids)."""
    g = examples.select(qid, F.posexplode(gold_ids).alias("_p", doc_key))
    j = g.join(docs.select(F.col(doc_key), F.col(content).alias("_c")), doc_key, "left")
    if strict:
        j = j.withColumn("_c", F.coalesce(F.col("_c"), F.raise_error(F.lit("gold id not in corpus")).cast("string")))
    agg = j.groupBy(qid).agg(F.sort_array(F.collect_list(F.struct("_p", "_c"))).alias("_l"))
    return agg.select(qid, F.transform("_l", lambda s: s["_c"]).alias("pos_docs_list"))


def delta_prompts(examples: DataFrame, docs: DataFrame, chat_only: bool = False) -> DataFrame:
    """Ground truth ``{query, pos_docs_list}``."""
    g = gold_documents(examples, docs)
    x = examples.join(g, "qid", "left").withColumn(
        "pos_docs_list", F.coalesce("pos_docs_list", F.array().cast("array<string>")))
    prompt = TPL.render(TPL.DELTA_PROMPT, query=F.col("query"))
    gt = F.to_json(F.struct(F.col("query"), F.col("pos_docs_list")))
    if chat_only:
        return x.select(F.array(F.struct(F.lit("system").alias("role"), F.lit(TPL.SYSTEM_HELPFUL).alias("content")),
                                F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("prompt"),
                        gt.alias("answer"), "qid")
    f = {"data_source": F.concat(F.lit(TPL.RETRIEVAL_SOURCE_PREFIX), F.col("task")),
         "prompt": F.array(F.struct(F.lit("user").alias("role"), TPL.render(TPL.CHATML_USER, prompt=prompt).alias("content"))),
         "ability": F.lit("math"),
         "reward_model": F.struct(F.lit("rule").alias("style"), gt.alias("ground_truth")),
         "extra_info": F.struct(F.col("split"), F.col("idx").cast("bigint").alias("idx"), F.col("query"),
                                F.col("qid").cast("string").alias("qid"))}
    return to_prompt_rows(x, f)


def all_splits(df: DataFrame, splits=("train", "test")) -> DataFrame:
    """Train and test are the same rows with a different tag."""
    return df.withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits])))


def longest_query(df: DataFrame, task="task", query="query", warn_chars: int = 8000) -> DataFrame:
    """Longest query per task and whether it passes the warning size."""
    return df.groupBy(task).agg(F.max(F.length(query)).alias("max_chars")) \
        .withColumn("too_long", F.col("max_chars") > warn_chars)


def overlap_violations(gold: DataFrame, excluded: DataFrame, key="qid", doc_key="doc_id") -> DataFrame:
    """P20: examples whose gold and excluded ids intersect, from one row per
    (example, id) on both sides.  Rows meet by example and id, so an example
    with millions of exclusions is spread like any others; repeated pairs count
    once, null ids never."""
    pair = [key, doc_key]
    both = gold.select(*pair).distinct().join(excluded.select(*pair), pair, "left_semi")
    return both.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n_overlap"))


def dedupe(df: DataFrame, cols=None) -> DataFrame:
    """Remove duplicate rows (all columns, or the given ones)."""
    return df.dropDuplicates(cols) if cols else df.dropDuplicates()


def filter_long_prompts(df: DataFrame, tokens="prompt_ids", max_len: int = 512, enabled: bool = False) -> DataFrame:
    """Drop prompts longer than ``max_len`` tokens, behind a flag (off
    by default, as the reference's filter is commented out)."""
    return df.filter(F.size(tokens) <= max_len) if enabled else df


def nested_field(c, keys) -> Column:
    """Follow a key path; length-1 arrays are unwrapped on the way."""
    out = col(c)
    for k in keys:
        out = out.getField(k)
    return out


def unwrap_single(c) -> Column:
    return F.when(F.size(col(c)) == 1, F.element_at(col(c), 1))


def row_index(df: DataFrame, extra_info="extra_info") -> Column:
    """``extra_info.index`` with default 0; rows whose extra_info has no
    ``index`` field (the retrieval sets write ``idx``) all get 0."""
    fields = df.schema[extra_info].dataType.fieldNames()
    if "index" not in fields:
        return F.lit(0).cast("bigint")
    return F.coalesce(F.col(extra_info).getField("index").cast("bigint"), F.lit(0).cast("bigint"))


def hash_split(key, train_pct: int = 80, seed: int = 42, method: str = "xxhash") -> Column:
    """P25: stable random split, independent of partitioning."""
    if method == "xxhash":
        bucket = F.pmod(F.xxhash64(F.lit(seed), col(key)), F.lit(100))
    elif method == "modulo":
        bucket = F.pmod(col(key), F.lit(5)) * 20
    else:
        raise ValueError(method)
    return F.when(bucket < train_pct, "train").otherwise("test")


def union_tasks(parts) -> DataFrame:
    """Concatenate prompt tables of several tasks (schema-tolerant)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
