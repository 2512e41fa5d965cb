"""Rows of prompts with a checkable answer."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.choices import lettered_options, rendered_options, sorted_letters
from sieveworks.functions.rules import first_hit, staged
from sieveworks.functions.text import stripped

# What models are asked, by name.
PROMPTS = {
    "answer_with_reasons": """你是一名医学考试助手。请先进行简短分析，最后严格按照“答案：X”输出。

作答要求：
1. 单选题只能输出一个选项。
2. 多选题可以输出多个选项，但只能选择题干明确支持、符合标准定义或诊疗原则的选项。
3. 仅“可能相关”“不能完全排除”“也可考虑”的选项不要选择。
4. 最终答案只允许包含选项字母，例如：答案：A 或 答案：ABCD。

题目：{question}

选项：
{options_text}

请作答：""",
    "answer_only": """你是一名医学考试助手。请根据题目选择正确选项。

作答要求：
1. 最终只输出一行，格式必须为：答案：X
2. X 只能由选项字母组成，例如：答案：A 或 答案：ABCD
3. 单选题只能输出一个选项。
4. 多选题只能选择题干明确支持、符合标准定义或诊疗原则的选项。
5. 仅“可能相关”“不能完全排除”“也可考虑”的选项不要选择。
6. 不要输出分析过程，不要输出多余文字。

题目：{question}

选项：
{options_text}

请作答：""",
    "explain": """请为下面医学考试题生成解析。

输出 JSON 格式：
{
  "analysis": "简洁中文解析，不要包含最终答案标签",
  "answer": "{answer}"
}

题型：{question_type}
题目：{question}

选项：
{options_text}

标准答案：{answer}
""",
}

#: Columns that a prompt row carries on where the source has them.
CARRIED = ("exam_type", "exam_class", "exam_subject", "difficulty", "quality_score", "clean_flags")


def filled(template: str, **parts: Column) -> Column:
    """A template with the named places filled; other braces are text, null counts as empty."""
    pieces = re.split(r"\{(" + "|".join(parts) + r")\}", template)
    return F.concat(*[F.coalesce(parts[x], F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(pieces)])


def prompt_rows(
    rows: DataFrame, template: str, sample_id: Column, source: str, version: str = "v2", question: str = "question", options: str = "options", answer: str = "answer", carried: Sequence[str] = CARRIED
) -> DataFrame:
    """Every row as a prompt row, with reject_reason where it can't be one.

    Options count with a single letter for a key; the answer keeps the letters
    among them in the order of the alphabet. Reasons: empty_question,
    invalid_options, invalid_answer. ``template`` has {question} and
    {options_text}. Of ``carried`` and question_type (as source_question_type)
    those that ``rows`` has are carried on. Other columns are not read.
    """
    out = rows.select(
        sample_id.alias("sample_id"), stripped(F.col(question)).alias("question"), lettered_options(F.col(options)).alias("options"), F.col(answer).alias("__given"),
        *[F.col(c) for c in carried if c in rows.columns], *([F.col("question_type").alias("source_question_type")] if "question_type" in rows.columns else []),
    )
    out = staged(out, {"valid_options": F.array_sort(F.map_keys("options"))})
    out = staged(out, {"answer": F.when(F.col("valid_options").isNotNull(), sorted_letters(F.col("__given"), F.col("valid_options"))).otherwise("")}).drop("__given")
    reason = first_hit([("empty_question", F.col("question") == ""), ("invalid_options", F.col("options").isNull()), ("invalid_answer", F.col("answer") == "")])
    return out.withColumns(
        {
            "prompt": filled(template, question=F.col("question"), options_text=rendered_options(F.col("options"))), "answer_len": F.length("answer"),
            "question_type": F.when(F.length("answer") == 1, "single").otherwise("multi"), "source": F.lit(source), "prompt_version": F.lit(version), "reject_reason": reason,
        }
    )


def chat_prompt(system: str, question: Column) -> Column:
    """Messages of a system text and a question."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), F.coalesce(question, F.lit("")).alias("content")))


def solution_conversation(problem: Column, solution: Column, instruction: str, missing: str = "No solution available.") -> Column:
    """A problem with an instruction after it, and its solution or a fixed text."""
    given = F.when(F.coalesce(solution, F.lit("")) != "", solution).otherwise(missing)
    return F.array(
        F.struct(F.lit("human").alias("from"), F.concat(F.coalesce(problem, F.lit("")), F.lit(" " + instruction)).alias("value")), F.struct(F.lit("gpt").alias("from"), given.alias("value"))
    )
