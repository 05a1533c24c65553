"""Markdown notes to sections, and lines within them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import frontmatter_tags, heading, image_urls, is_fence, is_heading, tags


def sections(notes: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, page, title, body): a section for each heading outside code fences, and what stands before the first.

    page is the 1-based line of the section's start; the title is its heading, its inline tags and, for the first
    section, the frontmatter's tags. Blank sections after the first are dropped. Lines of a note are numbered and
    grouped inside one task by its key; a section's text is bounded by its note.
    """
    notes = notes.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    lines = notes.select("key", F.posexplode(F.split("text", "\n")).alias("no", "line"), F.when(F.col("no") == 0, frontmatter_tags("text")).otherwise("").alias("front"))
    before = Window.partitionBy("key").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = is_fence("line")
    marked = lines.withColumn("fences", F.sum(fence.cast("int")).over(before))
    starts = marked.withColumn("head", is_heading("line") & ~fence & (F.col("fences") % 2 == 0))
    numbered = starts.withColumn("part", F.sum(F.col("head").cast("int")).over(before))
    whole = numbered.groupBy("key", "part").agg(
        F.min("no").alias("start"), F.array_sort(F.collect_list(F.struct("no", "line"))).alias("lines"), F.max(F.struct("head", "line")).alias("first"), F.max("front").alias("front"), F.bool_or("head").alias("headed")
    )
    body = F.array_join("lines.line", "\n")
    title = F.concat_ws(" ", F.filter(F.array(F.when(F.col("headed"), heading(F.col("lines.line")[0])), F.array_join(tags(body), " "), F.col("front")), lambda x: x.isNotNull() & (x != "")))
    kept = whole.where((F.col("start") == 0) | (F.trim(F.regexp_replace(body, r"\s+", " ")) != ""))
    return kept.select(F.col("key").alias(key), (F.col("start") + 1).alias("page"), title.alias("title"), body.alias("body"))


def embed_lines(notes: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, i, url, line): the 0-based line at which a note first has its i-th distinct remote image."""
    lines = notes.select(F.col(key).alias("key"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "words"))
    each = lines.select("key", "line", F.posexplode(image_urls("words")).alias("at", "url"))
    first = each.groupBy("key", "url").agg(F.min(F.struct("line", "at")).alias("first"))
    return first.select(F.col("key").alias(key), (F.row_number().over(Window.partitionBy("key").orderBy("first")) - 1).alias("i"), "url", "first.line")


def match_line(rows: DataFrame, word: str) -> DataFrame:
    """Adds match: the 0-based line at or after line of text that holds the word (any case), else line itself. rows: id, line, text."""
    lines = F.slice(F.split("text", "\n"), F.col("line") + 1, F.greatest(F.size(F.split("text", "\n")) - F.col("line"), F.lit(0)))
    place = F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), F.lit(word.lower()))), True)
    return rows.withColumn("match", F.when(place > 0, F.col("line") + place - 1).otherwise(F.col("line")).cast("int"))


def box_lines(boxes: DataFrame) -> DataFrame:
    """Recognised boxes (image, text, x, mid, height) to (image, text): boxes by falling mid are one line while closer to
    the line's first box than half the smaller height; lines left to right, joined by line breaks."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("mid")).alias("down"), "x", "height", "text")))
    last = lambda done: F.element_at(done, -1)

    def step(done, box):
        open_line = (F.size(done) > 0) & (F.abs(last(done)["down"] - box["down"]) < F.least(last(done)["height"], box["height"]) / 2)
        item = F.struct(box["x"].alias("x"), box["text"].alias("text"))
        longer = F.struct(last(done)["down"].alias("down"), last(done)["height"].alias("height"), F.concat(last(done)["items"], F.array(item)).alias("items"))
        new = F.struct(box["down"].alias("down"), box["height"].alias("height"), F.array(item).alias("items"))
        return F.when(open_line, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(new)))

    empty = F.array().cast("array<struct<down: double, height: double, items: array<struct<x: double, text: string>>>>")
    found = boxes.select("image", "text", *[F.col(c).cast("double").alias(c) for c in ("x", "mid", "height")]).groupBy("image").agg(order.alias("boxes"))
    lines = F.aggregate("boxes", empty, step)
    return found.select("image", F.array_join(F.transform(lines, lambda x: F.array_join(F.transform(F.array_sort(x["items"]), lambda i: i["text"]), " ")), "\n").alias("text"))
