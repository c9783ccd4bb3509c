"""Prompt templates of the task datasets.

Fixed values: these texts must equal the ones the trained models were
prompted with, so they are stated verbatim.  ``{...}`` marks the slots
filled per row (rendered with ``kestrel.functions.templates.render``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (prompt templates), in the order the datasets are listed.
KK_BASE = ("The user asks a question, and the Assistant solves it.The assistant first thinks about the reasoning process "
           "in the mind and then provides the user with the final answer. The reasoning process and answer are enclosed "
           "within <think> </think> and <answer> </answer> tags, respectively, i.e., <think> reasoning process here "
           "</think><answer> answer here </answer>. Now the user asks you to solve a logical reasoning problem. After "
           "thinking, when you finally reach a conclusion, clearly state the identity of each character within <answer> "
           "</answer> tags. List the identity of each person one by one, for example, <answer> (1) Zoey is a knight\n"
           "(2) Oliver is a knight\n(3)... </answer>.\n\nUser:{quiz}\nAssistant: <think>")
KK_QWEN = ("<|im_start|>system\nYou are a helpful assistant. The assistant first thinks about the reasoning process in "
           "the mind and then provides the user with the answer. The reasoning process and answer are enclosed within "
           "<think> </think> and<answer> </answer> tags, respectively, i.e., <think> reasoning process here </think>"
           "<answer> answer here </answer>.  Now the user asks you to solve a logical reasoning problem. After thinking, "
           "when you finally reach a conclusion, clearly state the identity of each character within <answer> </answer> "
           "tags. i.e., <answer> (1) Zoey is a knight\n(2) ... </answer>.\n<|im_end|>\n<|im_start|>user\n{quiz}\n"
           "<|im_end|>\n<|im_start|>assistant\n<think>")
COUNTDOWN_BASE = ("A conversation between User and Assistant. The user asks a question, and the Assistant solves it. The "
                  "assistant first thinks about the reasoning process in the mind and then provides the user with the "
                  "answer.\nUser: Using the numbers {numbers}, create an equation that equals {target}. You can use basic "
                  "arithmetic operations (+, -, *, /) and each number can only be used once. Show your work in <think> "
                  "</think> tags. And return the final answer in <answer> </answer> tags, for example <answer> (1 + 2) / 3 "
                  "</answer>.\nAssistant: Let me solve this step by step.\n<think>")
COUNTDOWN_QWEN = ("<|im_start|>system\nYou are a helpful assistant. You first thinks about the reasoning process in the "
                  "mind and then provides the user with the answer.<|im_end|>\n<|im_start|>user\n Using the numbers "
                  "{numbers}, create an equation that equals {target}. You can use basic arithmetic operations (+, -, *, /) "
                  "and each number can only be used once. Show your work in <think> </think> tags. And return the final "
                  "answer in <answer> </answer> tags, for example <answer> (1 + 2) / 3 </answer>.<|im_end|>\n"
                  "<|im_start|>assistant\nLet me solve this step by step.\n<think>")
ARITH = ("A conversation between User and Assistant. The user asks a question, and the Assistant solves it. The assistant "
         "first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning "
         "process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, i.e., "
         "<think> reasoning process here </think> <answer> RESULT_NUMBER </answer>. \nUser: Give me the answer of the "
         "following equation: {num1} {op} {num2}.\nAssistant: Let me solve this step by step.\n<think>")
MULTIPLY = ("A conversation between User and Assistant. The user asks a question, and the Assistant solves it. The "
            "assistant first thinks about the reasoning process in the mind and then provides the user with the answer. "
            "The reasoning process and answer are enclosed within <think> </think> and <answer> </answer> tags, "
            "respectively, i.e., <think> reasoning process here </think> <answer> RESULT_NUMBER </answer>. User: Give me "
            "the answer of the following equation: {num1} * {num2} = Assistant: Ok let me think about it.\n<think>")
GSM8K_INSTRUCTION = "Let's think step by step and output the final answer after \"####\"."
MATH_INSTRUCTION = "Let's think step by step and output the final answer within \\boxed{}."
HELLASWAG_INSTRUCTION = "Please complete the following sentence.\n"
RETRIEVAL_QUERY = ("<|im_start|>system\nYou are a helpful assistant. Now the user asks you to generate a query with the "
                   "given question. The query will be used for text retrieval to retrieve the correct to the query. \n The "
                   "reasoning process and the generated query are enclosed within <think> </think> and <query> </query> "
                   "tags, respectively, i.e., <think> reasoning process here </think><query> the generated query here "
                   "</query>.\n<|im_end|>\n<|im_start|>user\n{query}\n<|im_end|>\n<|im_start|>assistant\n<think>")
REASONING_STEPS = ("Instructions:\n1. Identify the essential problem.\n2. Think step by step to reason and describe what "
                   "information could be relevant and helpful to address the questions in detail.\n3. Draft an answer "
                   "with as many thoughts as you have.\n")
DELTA_PROMPT = REASONING_STEPS + "Query:{query}\n\n"
RAW_SEARCH_PROMPT = "{query}\n\n" + REASONING_STEPS
CHATML_USER = ("<|im_start|>system\nYou are a helpful assistant.\n<|im_end|>\n<|im_start|>user\n{prompt}\n<|im_end|>\n"
               "<|im_start|>assistant\n")
SYSTEM_HELPFUL = "You are a helpful assistant."
RETRIEVAL_SOURCE_PREFIX = "BRIGHT_bm25_reasoner_"


def render(template: str, **slots) -> Column:
    """Fill ``{name}`` slots with columns: one ``concat`` (JVM-side)."""
    parts: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        j = rest.find("}", i) if i >= 0 else -1
        name = rest[i + 1:j] if i >= 0 and j > i else None
        if name is None or name not in slots:
            if i < 0 or j < 0:
                parts.append(F.lit(rest))
                break
            parts.append(F.lit(rest[:j + 1]))
            rest = rest[j + 1:]
            continue
        if i:
            parts.append(F.lit(rest[:i]))
        v = slots[name]
        parts.append(F.col(v) if isinstance(v, str) else v)
        rest = rest[j + 1:]
    return F.concat(*parts) if parts else F.lit("")
