"""Conversations: building, normal forms, pairing, expansion and checks.

A conversation is an array of struct(from, value), messages are an array of
struct(role, content). All functions are expressions on such columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.choices import lenient_answer, rendered_options
from sieveworks.functions.text import stripped

USER_ROLES = ("human", "user", "observation")
ASSISTANT_ROLES = ("gpt", "assistant", "function_call")
_MESSAGES = "array<struct<role:string,content:string>>"
_PAIRS = "array<array<string>>"


def turns(*parts: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("from"), value.alias("value")) for role, value in parts])


def exam_conversation(question: Column, options: Column, answer: Column, explanation: Column | None = None) -> Column:
    """Question with its options, then the answer; with an explanation of over 20 characters, its first 200 before it."""
    asked = F.concat(F.lit("请回答以下医学考试题，直接给出答案选项，不需要解释。\n\n题目："), F.coalesce(question, F.lit("")), F.lit("\n\n选项：\n"), rendered_options(options))
    plain = F.concat(F.lit("答案："), F.coalesce(answer, F.lit("")))
    if explanation is None:
        return turns(("human", asked), ("gpt", plain))
    reasoned = F.concat(F.lit("分析："), stripped(F.substring(explanation, 1, 200)), F.lit("...\n\n"), plain)
    return turns(("human", asked), ("gpt", F.when(F.length(explanation) > 20, reasoned).otherwise(plain)))


def with_direct_answer(conversation: Column, answer: Column, keys: Column) -> Column:
    """The last turn replaced by the plain answer; null if there is no turn or no valid answer."""
    letters = lenient_answer(answer, keys)
    last = turns(("gpt", F.concat(F.lit("答案："), letters)))
    n = F.size(conversation)
    return F.when((n > 0) & (letters != ""), F.concat(F.slice(conversation, 1, F.greatest(n - 1, F.lit(0))), last))


def with_reasoning(conversation: Column, analysis: Column, answer: Column, default_question: Column) -> Column:
    """First human turn (or the default) and a turn of analysis and answer."""
    first = F.get(F.filter(conversation, lambda t: t["from"] == "human"), F.lit(0))["value"]
    return turns(("human", F.coalesce(first, default_question)), ("gpt", F.concat(F.lit("分析："), analysis, F.lit("\n\n答案："), answer)))


def instruction_conversation(instruction: Column, given: Column, output: Column) -> Column:
    asked = F.when(stripped(given) != "", F.concat(instruction, F.lit("\n\n"), given)).otherwise(instruction)
    return turns(("human", asked), ("gpt", output))


def messages_of(conversation: Column, tools_text: Column | None = None) -> Column:
    """User and assistant messages; the last system turn, with tools after it, comes first. Other roles are left out."""
    role = lambda t: F.when(t["from"].isin(*USER_ROLES), F.lit("user")).when(t["from"].isin(*ASSISTANT_ROLES), F.lit("assistant"))
    value = lambda t: F.when(t["from"] == "observation", F.concat(F.lit("Observation: "), t["value"])).otherwise(t["value"])
    body = F.filter(F.transform(conversation, lambda t: F.struct(role(t).alias("role"), F.coalesce(value(t), F.lit("")).alias("content"))), lambda m: m["role"].isNotNull())
    system = _last_system(conversation)
    if tools_text is not None:
        tools = F.coalesce(tools_text, F.lit(""))
        system = F.when(tools == "", system).otherwise(F.concat(system, F.when(system != "", F.lit("\n\n")).otherwise(F.lit("")), tools))
    head = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))
    return F.when(system != "", F.concat(head, body)).otherwise(body)


def _last_system(conversation: Column) -> Column:
    found = F.filter(conversation, lambda t: t["from"] == "system")
    return F.coalesce(F.get(found, F.size(found) - 1)["value"], F.lit(""))


def prefixes(messages: Column) -> Column:
    """One array of messages for each assistant message that follows a user: all up to it."""
    n = F.size(messages)
    ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.coalesce(F.get(messages, i - 1)["role"] == "assistant", F.lit(False)) & F.exists(F.slice(messages, 1, i), lambda m: m["role"] == "user"))
    return F.transform(ends, lambda i: F.slice(messages, 1, i))


def paired(messages: Column, keep_dangling: bool = False) -> Column:
    """[user, assistant] pairs: users in a row are joined by line ends, assistants without a user are dropped.

    With ``keep_dangling`` a last user without an answer is paired with empty text.
    """
    start = F.struct(F.array().cast(_PAIRS).alias("pairs"), F.lit(None).cast("string").alias("user"))

    def step(s: Column, m: Column) -> Column:
        user = F.when(m["role"] == "user", F.when(s["user"].isNull(), m["content"]).otherwise(F.concat(s["user"], F.lit("\n"), m["content"])))
        answered = (m["role"] == "assistant") & s["user"].isNotNull()
        return F.struct(
            F.when(answered, F.concat(s["pairs"], F.array(F.array(s["user"], m["content"])))).otherwise(s["pairs"]).alias("pairs"),
            F.when(m["role"] == "user", user).when(answered, F.lit(None)).otherwise(s["user"]).alias("user"),
        )

    end = F.aggregate(messages, start, step)
    if not keep_dangling:
        return end["pairs"]
    return F.when(end["user"].isNotNull(), F.concat(end["pairs"], F.array(F.array(end["user"], F.lit(""))))).otherwise(end["pairs"])


def strictly_paired(conversation: Column) -> Column:
    """Pairs of strictly alternating human and gpt turns; null unless there are whole pairs.

    A first turn that is not human is dropped, reading stops at an unknown role,
    and a turn out of its place is left out.
    """
    first = F.get(conversation, F.lit(0))["from"]
    body = F.when(F.coalesce(first, F.lit("")) != "human", F.slice(conversation, F.lit(2), F.greatest(F.size(conversation), F.lit(0)))).otherwise(conversation)
    known = F.transform(body, lambda t: F.coalesce(t["from"].isin("human", "gpt"), F.lit(False)))
    stop = F.array_position(known, F.lit(False))
    body = F.when(stop > 0, F.slice(body, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(body)
    placed = F.filter(F.transform(body, lambda t, i: F.struct(t["from"].alias("role"), t["value"].alias("value"), i.alias("i"))), lambda t: F.when(t["i"] % 2 == 0, t["role"] == "human").otherwise(t["role"] == "gpt"))
    n = F.size(placed)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest((n / 2).cast("int") - 1, F.lit(0))), lambda k: F.array(F.get(placed, k * 2)["value"], F.get(placed, k * 2 + 1)["value"]))
    return F.when((n >= 2) & (n % 2 == 0), pairs)


def preference_texts(prompt: Column, chosen: Column, rejected: Column) -> Column:
    return F.struct(F.concat(prompt, chosen).alias("chosen_text"), F.concat(prompt, rejected).alias("rejected_text"))


def within_budget(text: Column, most: int) -> Column:
    return F.length(text).between(1, most)


def conversation_error(conversation: Column, roles: tuple[str, ...] = ("system", "human", "gpt")) -> Column:
    """Why a conversation is not valid: missing, empty turn fields or unknown roles; null if it is."""
    return (
        F.when(conversation.isNull() | (F.size(conversation) == 0), F.lit("no_conversation"))
        .when(F.exists(conversation, lambda t: t["from"].isNull() | t["value"].isNull()), F.lit("missing_field"))
        .when(~F.forall(conversation, lambda t: t["from"].isin(*roles)), F.lit("unknown_role"))
    )


def answered_pairs(conversation: Column) -> Column:
    """Each gpt turn with the human turn that comes last before it."""
    start = F.struct(F.array().cast("array<struct<question:string,answer:string>>").alias("pairs"), F.lit(None).cast("string").alias("human"))

    def step(s: Column, t: Column) -> Column:
        pair = F.array(F.struct(s["human"].alias("question"), t["value"].alias("answer")))
        return F.struct(
            F.when((t["from"] == "gpt") & s["human"].isNotNull(), F.concat(s["pairs"], pair)).otherwise(s["pairs"]).alias("pairs"),
            F.when(t["from"] == "human", t["value"]).otherwise(s["human"]).alias("human"),
        )

    return F.aggregate(conversation, start, step)["pairs"]


def spoken_turns(text: Column, speakers: dict[str, str]) -> Column:
    """Lines that begin with a speaker's name and a colon, as turns of that speaker's role; other lines are left out."""
    names = "|".join(speakers)
    roles = F.create_map(*[F.lit(x) for kv in speakers.items() for x in kv])
    found = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"^\\s*(?:{names})\\s*[:：]"))
    return F.transform(
        found,
        lambda x: F.struct(
            F.element_at(roles, F.regexp_extract(x, f"^\\s*({names})\\s*[:：]", 1)).alias("from"), stripped(F.regexp_replace(x, f"^\\s*(?:{names})\\s*[:：]", "")).alias("value")
        ),
    )


def numbered_items(text: Column) -> Column:
    """Items of a list whose parts are parted by blank lines, without their numbers; blank ones are left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\n"), lambda x: stripped(F.regexp_replace(stripped(x), r"^\d+\.\s*", ""))), lambda x: x != "")


def last_turns(history: Column, n: int) -> Column:
    return F.slice(history, F.greatest(F.size(history) - n + 1, F.lit(1)), F.lit(n))


def exploded_prefixes(rows: DataFrame, id_col: str, messages: Column) -> DataFrame:
    """(id, sample, messages): one row for each prefix."""
    return rows.select(id_col, F.posexplode(prefixes(messages)).alias("sample", "messages"))


def assistant_text(conversation: Column) -> Column:
    """Value of the last turn, whoever speaks; empty if there is none."""
    return F.coalesce(F.try_element_at(conversation, F.lit(-1))["value"], F.lit(""))


def source_format(conversation: Column, given: Column) -> Column:
    """The given format, else told from the labels in the last turn."""
    last = assistant_text(conversation)
    told = F.when(F.contains(last, F.lit("分析：")) & F.contains(last, F.lit("答案：")), "cot_teacher_deepseek").when(F.startswith(last, F.lit("答案：")), "direct_answer").otherwise("unknown")
    return F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(told)


def usable_messages(messages: Column) -> Column:
    """role and content of messages that end with the assistant; null for empty ones and others."""
    return F.when(F.try_element_at(messages, F.lit(-1))["role"] == "assistant", F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))


def system_and_rest(messages: Column) -> Column:
    """struct(system, rest): the text of a first system message (empty if there is none) and the messages after it."""
    first = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    return F.struct(F.when(first, F.get(messages, F.lit(0))["content"]).otherwise("").alias("system"), F.when(first, F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages).alias("rest"))


def conversations_only(rows: DataFrame, items: str = "items") -> DataFrame:
    """The column of conversations alone, under its usual name."""
    return rows.select(F.col(items if items in rows.columns else "conversations").alias("conversations"))


def validity_totals(rows: DataFrame, conversation: str) -> DataFrame:
    """(total, valid, invalid) of conversations."""
    bad = conversation_error(F.col(conversation)).isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"))


def row_key(sample_id: Column, question: Column) -> Column:
    """The id of a row, or its question where it has none; by this rows are told apart between sets."""
    return F.when(F.coalesce(sample_id, F.lit("")) != "", sample_id).otherwise(F.coalesce(question, F.lit("")))
