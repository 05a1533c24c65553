"""Typo correction and compound splitting against the vocabulary."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import osa
from ..plans.query import Query, Term

TOP = 3


def neighbours(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """(word, term, dist, doc, rank): up to three indexed words near each word (word), or with a beginning near it.

    Terms meet words by their first letter; the distance is at most 1, or 2 from eight letters on.
    """
    words = words.select("word", F.substring("word", 1, 1).alias("c1"), F.length("word").alias("n"), F.when(F.length("word") >= 8, 2).otherwise(1).alias("most"))
    near = vocab.select("term", "doc", F.substring("term", 1, 1).alias("c1")).join(F.broadcast(words), "c1").where(F.length("term") >= F.greatest(F.col("n") - F.col("most"), F.col("n") - 1, F.lit(1)))
    ends = F.sequence(F.greatest(F.col("n") - 1, F.lit(1)), F.least(F.col("n") + 1, F.length("term")))
    dist = F.array_min(F.transform(ends, lambda k: osa(F.col("word"), F.substring(F.col("term"), F.lit(1), k))))
    close = near.withColumn("dist", dist).where("dist <= most")
    rank = F.row_number().over(Window.partitionBy("word").orderBy("dist", F.desc("doc"), "term"))
    return close.select("word", "term", "dist", "doc", rank.alias("rank")).where(F.col("rank") <= TOP)


def known_prefixes(vocab: DataFrame, words: list[str]) -> set[str]:
    """Which of the words begin some indexed word; one scan for all, with the prefixes pushed down."""
    if not words:
        return set()
    row = vocab.agg(*[F.coalesce(F.bool_or(F.startswith("term", F.lit(w))), F.lit(False)).alias(f"w{i}") for i, w in enumerate(words)]).first()
    return {w for i, w in enumerate(words) if row[i]}


def similar(vocab: DataFrame, words: list[str]) -> dict[str, tuple[str, ...]]:
    if not words:
        return {}
    rows = neighbours(vocab, vocab.sparkSession.createDataFrame([(w,) for w in words], "word string")).collect()
    return {w: tuple(r.term for r in sorted(rows, key=lambda r: r["rank"]) if r.word == w) for w in words}


def exact_splits(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """(word, a, b): the first split of each word into two halves of at least three letters that both begin indexed words.

    Halves meet the vocabulary by their first three letters, all words in one plan.
    """
    cut = words.select("word", F.explode(F.sequence(F.lit(3), F.greatest(F.length("word") - 3, F.lit(2)))).alias("i")).where("i between 3 and length(word) - 3")
    cut = cut.select("word", "i", F.substring("word", F.lit(1), F.col("i")).alias("a"), F.substring("word", F.col("i") + 1, F.length("word")).alias("b"))
    halves = cut.select(F.explode(F.array("a", "b")).alias("half")).distinct().withColumn("p3", F.substring("half", 1, 3))
    known = vocab.select("term", F.substring("term", 1, 3).alias("p3")).join(F.broadcast(halves), "p3").where(F.startswith("term", F.col("half"))).select("half").distinct()
    both = cut.join(known.withColumnRenamed("half", "a"), "a").join(known.withColumnRenamed("half", "b"), "b")
    return both.groupBy("word").agg(F.min_by(F.struct("a", "b"), "i").alias("x")).select("word", "x.a", "x.b")


def splits(vocab: DataFrame, word: str) -> tuple[Term, Term] | None:
    """The first split into two halves of at least three letters that are both indexed, or else both near indexed words."""
    if whole := exact_splits(vocab, vocab.sparkSession.createDataFrame([(word,)], "word string")).first():
        return Term(whole.a), Term(whole.b)
    pairs = [(word[:i], word[i:]) for i in range(3, len(word) - 2)]
    halves = sorted({h for p in pairs for h in p})
    known = known_prefixes(vocab, halves)
    near = similar(vocab, [h for h in halves if h not in known])
    for a, b in pairs:
        if all(h in known or near[h] for h in (a, b)):
            return tuple(Term(h) if h in known else Term(h, alts=near[h]) for h in (a, b))
    return None


def corrected(vocab: DataFrame, query: Query) -> Query | None:
    """The query with unknown words replaced, or None if nothing was."""
    words = {t.text: t.text.lower() for t in query.pos if not t.phrase and len(t.text) >= 4 and all(c.isalpha() or c.isdecimal() for c in t.text)}
    known = known_prefixes(vocab, sorted(set(words.values())))
    unknown = sorted({w for w in words.values() if w not in known})
    near = similar(vocab, unknown)
    new: dict[str, Term] = {}
    for text, w in words.items():
        if w in known:
            continue
        if near[w]:
            new[text] = Term(text, alts=near[w])
        elif parts := splits(vocab, w):
            new[text] = Term(text, parts=parts)
    return replace(query, pos=[new.get(t.text, t) if not t.phrase else t for t in query.pos]) if new else None
