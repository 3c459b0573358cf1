"""Adapters: heterogeneous records to one text, chosen from the schema before any job starts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions.text import first_text, join_parts, strip

Adapter = Callable[[DataFrame], Column]


def _strings(df: DataFrame, *names: str) -> list[Column]:
    """Those columns that are there and hold strings."""
    kinds = {f.name: f.dataType for f in df.schema}
    return [F.col(f"`{n}`") for n in names if isinstance(kinds.get(n), Y.StringType)]


def _first(df: DataFrame, *names: str) -> Column:
    return first_text(*(_strings(df, *names) or [F.lit(None).cast("string")]))


def plain_text(df: DataFrame) -> Column:
    return join_parts(_first(df, "title"), _first(df, "text", "content"))


def classification_text(df: DataFrame) -> Column:
    return F.nullif(_first(df, "text", "content"), F.lit(""))


def instruction_input_output(df: DataFrame) -> Column:
    return join_parts(_first(df, "instruction", "prompt", "question"), _first(df, "input", "context"), _first(df, "output", "answer", "response"))


def question_answer(df: DataFrame) -> Column:
    return join_parts(_first(df, "question", "query", "prompt"), _first(df, "answer", "output", "response"))


def question_answer_optional_think(df: DataFrame) -> Column:
    return join_parts(_first(df, "question", "query", "prompt"), _first(df, "think", "reasoning"), _first(df, "answer", "output", "response"))


def _turns(df: DataFrame, name: str, *fields: str) -> Column | None:
    """A list of turns, or a string, as the texts of its turns joined; null if the column is."""
    kind = {f.name: f.dataType for f in df.schema}.get(name)
    c = F.col(f"`{name}`")
    if isinstance(kind, Y.StringType):
        return F.when(c.isNotNull(), F.array(strip(c)))
    if not isinstance(kind, Y.ArrayType):
        return None
    if isinstance(kind.elementType, Y.StructType):
        there = [f for f in fields if isinstance({x.name: x.dataType for x in kind.elementType}.get(f), Y.StringType)]
        return F.transform(c, lambda t: first_text(*[t[f] for f in there] or [F.lit(None).cast("string")]))
    if isinstance(kind.elementType, Y.StringType):
        return F.transform(c, lambda t: F.coalesce(strip(t), F.lit("")))
    return F.transform(c, lambda t: F.lit(""))


def _joined(turns: Column) -> Column:
    return F.nullif(F.array_join(F.filter(turns, lambda t: t != ""), "\n\n"), F.lit(""))


def conversation(df: DataFrame) -> Column:
    """conversations, or conversation where that is null (not where it is empty)."""
    found = [t for n in ("conversations", "conversation") if (t := _turns(df, n, "content", "value", "text")) is not None]
    return _joined(F.coalesce(*found))


def tieba_thread(df: DataFrame) -> Column:
    head = [F.array(_first(df, "标题", "title")), F.array(_first(df, "楼主内容", "content", "text"))]
    replies = [t for n in ("回复列表", "replies") if (t := _turns(df, n, "content", "value", "text")) is not None]
    tail = [F.coalesce(*replies, F.array().cast("array<string>"))] if replies else []
    return _joined(F.concat(*head, *tail))


#: Name: (adapter, columns of which at least one must be there).
ADAPTERS: dict[str, tuple[Adapter, tuple[str, ...]]] = {
    "plain_text": (plain_text, ("title", "text", "content")),
    "classification_text": (classification_text, ("text", "content")),
    "instruction_input_output": (instruction_input_output, ("instruction", "prompt", "question", "input", "context", "output", "answer", "response")),
    "question_answer": (question_answer, ("question", "query", "prompt", "answer", "output", "response")),
    "question_answer_optional_think": (question_answer_optional_think, ("question", "query", "prompt", "think", "reasoning", "answer", "output", "response")),
    "sharegpt_conversations": (conversation, ("conversations", "conversation")),
    "openai_role_content_conversation": (conversation, ("conversations", "conversation")),
    "tieba_thread": (tieba_thread, ("标题", "title", "楼主内容", "content", "text", "回复列表", "replies")),
}


def adapted(df: DataFrame, adapter: str = "plain_text") -> Column:
    """The text column of an adapter; KeyError for an unknown one or if none of its columns is there."""
    make, columns = ADAPTERS[adapter]
    if not set(columns) & set(df.columns):
        raise KeyError(f"{adapter} needs one of {columns}")
    return make(df)


def compose_text(fields: list[Column], separator: str = "\n") -> Column:
    """Fields that aren't blank, joined; the first is left out if the second begins with it."""
    v = F.filter(F.array(*(strip(c) for c in fields)), lambda x: x != "")
    cut = F.when((F.size(v) >= 2) & F.coalesce(F.startswith(F.get(v, F.lit(1)), F.get(v, F.lit(0))), F.lit(False)), F.slice(v, F.lit(2), F.size(v))).otherwise(v)
    return F.array_join(cut, separator)
