"""Change feeds as streams: each micro-batch is applied to the last snapshot of the files table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import valid_path
from ..model import CHANGES
from ..operators import changes
from .store import Snapshots


def apply_batch(store: Snapshots) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: applies a batch once, even if it comes again after a failure (the snapshot names the batch). Invalid paths are left out."""

    def run(batch: DataFrame, number: int) -> None:
        if store.batch() < number:
            valid = batch.where(valid_path("path") & ((F.col("op") != "rename") | valid_path("old_path"))).persist()
            store.write({"files": changes.replay(store.read("files"), valid, store.scratch)}, number)
            store.clear_scratch()
            valid.unpersist()

    return run


def follow(spark: SparkSession, folder: str, store: Snapshots, checkpoint: str, seconds: int | None = 60, after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Applies change rows as they arrive as JSON files in folder; seconds None: all there is, then stop. after() is given (id, old path) of the files before a batch."""

    def run(batch: DataFrame, number: int) -> None:
        old = store.read("files").select("id", F.col("path").alias("old"))
        apply_batch(store)(batch, number)
        if after:
            after(old)

    stream = spark.readStream.schema(CHANGES).json(folder).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if seconds is None else stream.trigger(processingTime=f"{seconds} seconds")).start()
