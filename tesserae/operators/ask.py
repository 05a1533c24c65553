"""Questions: keyword retrieval, the prompt, and a pluggable model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ASK_CHARS, ASK_SOURCES, INSTRUCTIONS, NO_SOURCES, STOP_WORDS
from ..plans.query import parse
from ..plans.search import Index, results


def keywords(question: str) -> list[str]:
    """The words that a question is searched by."""
    return [t.text for t in parse(question).keywords(set(STOP_WORDS)).pos]


def sources(index: Index, question: str, now_ms: int, scope: list[str] | None = None) -> DataFrame:
    """The best chunks for any keyword of the question; filters of the question hold, exclusions don't."""
    return results(index, parse(question).keywords(set(STOP_WORDS)), now_ms, scope, ASK_SOURCES, snippets=False)


def excerpt(body: Column) -> Column:
    return F.regexp_replace(F.substring(body, 1, ASK_CHARS), r"^\s+|\s+$", "")


def prompt(index: Index, question: str, now_ms: int, scope: list[str] | None = None) -> DataFrame:
    """(prompt): the numbered sources and the question, in one row."""
    top = sources(index, question, now_ms, scope)
    met = F.broadcast(top).join(index.chunks.select("rowid", "body"), "rowid")  # at most ASK_SOURCES rows
    place = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] ("), "path", F.when(F.col("page") > 0, F.concat(F.lit(", page "), F.col("page").cast("string"))).otherwise(""), F.lit(")\n"))
    note = F.struct("place", F.concat(place, excerpt(F.col("body")), F.lit("\n\n")).alias("note"))
    return met.agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(note)), lambda x: x["note"]), ""), F.lit("Question: " + question)).alias("prompt"))


def answer(index: Index, question: str, now_ms: int, model: Callable[[str, str], str], scope: list[str] | None = None) -> tuple[str, list]:
    """The model's answer and the sources, or the fixed reply where there are none."""
    found = sources(index, question, now_ms, scope).collect()
    if not found:
        return NO_SOURCES, []
    return model(INSTRUCTIONS, prompt(index, question, now_ms, scope).first().prompt).strip(), found
