"""Upgrades of tables that an earlier layout has written; each may be applied again without effect.

Settings rows (key, value) say what was done: remoteChunks once image texts have chunks of their own, and
pdf, which only earlier layouts have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .changes import first_status

#: The layout that the engine writes now; layouts under REBUILT had other chunks.
LAYOUT, REBUILT = 5, 2


def requeue_all(files: DataFrame) -> DataFrame:
    """All files wait again, each in its lane: their chunks are of a layout that can't be read."""
    return files.withColumn("status", first_status())


def requeue_merged_images(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Notes with image texts wait for recognition, so that each image gets a chunk of its own."""
    merged = chunks.where("source = 'ocr'").select(F.col("file_id").alias("id")).distinct().withColumn("merged", F.lit(True))
    again = (F.col("kind") == "text") & F.col("merged").isNotNull()
    met = files.join(merged, "id", "left")
    return met.withColumn("status", F.when(again, "ocr").otherwise(F.col("status"))).withColumn("error", F.when(again, "").otherwise(F.col("error"))).select(files.columns)


def requeue_pdfs(files: DataFrame, all_of_them: bool) -> DataFrame:
    """PDF files that wait for recognition, or all of them, wait in the fast lane."""
    return files.withColumn("status", F.when((F.col("kind") == "pdf") & (F.lit(all_of_them) | (F.col("status") == "ocr")), "pending").otherwise(F.col("status")))


def upgraded(layout: int, meta: dict[str, str], files: DataFrame, chunks: DataFrame) -> tuple[dict[str, str], DataFrame, DataFrame]:
    """(settings, files, chunks) in the layout of now. Texts of layouts from REBUILT on are kept; the index is built from them."""
    meta = dict(meta)
    if layout < REBUILT:
        files, chunks = requeue_all(files), chunks.limit(0)
    elif "remoteChunks" not in meta:
        files = requeue_merged_images(files, chunks)
    files = requeue_pdfs(files, "pdf" in meta)
    meta["remoteChunks"] = "v1"
    for old in ("pdf", "embed"):
        meta.pop(old, None)
    return meta, files, chunks
