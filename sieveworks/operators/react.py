"""Thought, action and observation in one text: messages with calls folded into turns, and replies taken apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveworks.functions.text import stripped

# How a tool is described, and what a model is told of the format.
TOOL_TEXT = "{model_name}: Call this tool to interact with the {human_name} API. What is the {human_name} API useful for? {description} Parameters: {parameters}"
INSTRUCTION = """Answer the following questions as best you can. You have access to the following APIs:

{tools_text}

Use the following format:

Question: the input question you must answer
Thought: you should always think about what to do
Action: the action to take, should be one of [{tools_name_text}]
Action Input: the input to the action
Observation: the result of the action
... (this Thought/Action/Action Input/Observation can be repeated zero or more times)
Thought: I now know the final answer
Final Answer: the final answer to the original input question

Begin!"""
_TURNS = "array<struct<role:string,content:string>>"


def instruction(tools: Column) -> Column:
    """What a model is told of its tools, an array of struct(name, description, parameters as JSON text); empty without tools."""

    def described(t: Column) -> Column:
        before, *rest = TOOL_TEXT.split("{")
        parts, known = [F.lit(before)] if before else [], {"model_name": t["name"], "human_name": t["name"], "description": t["description"], "parameters": t["parameters"]}
        for piece in rest:
            name, after = piece.split("}", 1)
            parts += [F.coalesce(known[name], F.lit("")), F.lit(after)]
        return F.concat(*parts)

    head, rest = INSTRUCTION.split("{tools_text}")
    middle, end = rest.split("{tools_name_text}")
    text = F.concat(F.lit(head), F.array_join(F.transform(tools, described), "\n\n"), F.lit(middle), F.array_join(F.transform(tools, lambda t: t["name"]), ", "), F.lit(end))
    return F.when(F.coalesce(F.size(tools), F.lit(0)) > 0, text).otherwise("")


def folded(messages: Column, with_tools: bool) -> Column:
    """Turns of user and assistant of messages, an array of struct(role, content, call_name, call_arguments).

    A call is written after its thought, a function's result after the call it
    answers, and assistants in a row are one turn. A result that ends the
    messages is followed by the beginning of the next thought. The first
    message, if of the system, is left out.
    """
    body = F.when(F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False)), F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages)
    n = F.size(body)
    numbered = F.transform(body, lambda m, i: F.struct(m.alias("m"), (i == n - 1).alias("last")))

    def said(m: Column) -> Column:
        content = _trimmed(m["content"])
        final = F.concat(F.lit("Thought: I now know the final answer.\nFinal Answer: "), content) if with_tools else content
        thought = F.when(F.startswith(content, F.lit("Thought:")), content).otherwise(F.concat(F.lit("Thought: "), content))
        call = F.concat(thought, F.lit("\nAction: "), m["call_name"], F.lit("\nAction Input: "), F.coalesce(m["call_arguments"], F.lit("")))
        return (
            F.when(m["role"] == "function", F.concat(F.lit("Observation: "), content))
            .when((m["role"] == "assistant") & m["call_name"].isNotNull(), call)
            .when(m["role"] == "assistant", final)
            .otherwise(content)
        )

    def step(turns: Column, x: Column) -> Column:
        text = F.concat(said(x["m"]), F.when(x["last"] & (x["m"]["role"] == "function"), F.lit("\nThought:")).otherwise(F.lit("")))
        own = x["m"]["role"] == "user"
        previous = F.try_element_at(turns, F.lit(-1))
        opens = own | (F.coalesce(previous["role"], F.lit("")) != "assistant")
        added = F.array(F.struct(F.when(own, "user").otherwise("assistant").alias("role"), text.alias("content")))
        grown = F.array(F.struct(previous["role"].alias("role"), F.concat(previous["content"], F.lit("\n"), text).alias("content")))
        return F.when(opens, F.concat(turns, added)).otherwise(F.concat(F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0))), grown))

    return F.aggregate(numbered, F.array().cast(_TURNS), step)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\n+|\s+$", "")


def parsed(reply: Column) -> Column:
    """struct(content, call_name, call_arguments) of a reply: its call, if it has one, else its final answer.

    Arguments end where an observation begins, or with the text if the model has left that out.
    """
    t = F.coalesce(reply, F.lit(""))
    action, given, seen = (F.locate(mark, t) for mark in ("\nAction:", "\nAction Input:", "\nObservation:"))
    name = stripped(F.substring(t, action + len("\nAction:"), given - action - len("\nAction:")))
    begin = given + len("\nAction Input:")
    arguments = stripped(F.when(seen == 0, F.substring(t, begin, F.length(t))).when(seen > given, F.substring(t, begin, seen - begin)).otherwise(""))
    before = F.substring(t, F.lit(1), action - 1)
    thought = F.locate("Thought: ", before)
    calls = (action > 0) & (action < given) & (name != "")
    content = F.when(calls, stripped(F.when(thought > 0, F.substring(before, thought + len("Thought: "), F.length(before))).otherwise(before))).otherwise(F.substring_index(t, "\nFinal Answer: ", -1))
    return F.struct(content.alias("content"), F.when(calls, name).alias("call_name"), F.when(calls, arguments).alias("call_arguments"))


def without_stops(reply: Column, stops: tuple[str, ...]) -> Column:
    """The reply up to the first of its stop words, each looked for in what is left by those before."""
    out = reply
    for stop in stops:
        out = F.substring_index(out, stop, 1)
    return out
