"""A folder as a source: listing without contents, and contents of chosen files."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dotted, ignored, kind_of
from ..model import MAX_BYTES

SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:/")
LISTING = "path string, kind string, mtime bigint, size bigint"


def listing(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """(path, kind, mtime, size) of the indexable files under root; names with a dot in front and ignored folders are out.

    A folder without a scheme is walked on the driver, because Spark's own listing hides names with an underscore
    in front. A root with one (hdfs:, s3a:, file:) is listed by Spark, so that no single machine must see it.
    """
    if SCHEME.match(root):
        return stored_listing(spark, root, ignore)
    found = []
    for folder, subs, names in os.walk(root):
        subs[:] = [s for s in subs if not s.startswith(".")]
        for name in names:
            full = os.path.join(folder, name)
            try:
                stat = os.stat(full)
            except OSError:
                continue
            found.append((os.path.relpath(full, root).replace(os.sep, "/"), stat.st_mtime_ns // 1_000_000, stat.st_size))
    return _indexable(spark.createDataFrame(found, "path string, mtime bigint, size bigint"), list(ignore))


def stored_listing(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """The same from any store that Spark reads; only paths, times and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    path = F.regexp_replace("path", "^.*?" + base.split(":", 1)[-1].lstrip("/") + "/", "")
    return _indexable(files.select(path.alias("path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size")), list(ignore))


def _indexable(files: DataFrame, ignore: list[str]) -> DataFrame:
    kept = files.where(~dotted("path") & ~ignored("path", ignore)).withColumn("kind", kind_of("path"))
    return kept.where("kind is not null").select("path", "kind", "mtime", "size")


def contents(files: DataFrame, root: str) -> DataFrame:
    """Adds content (at most MAX_BYTES): each task opens the files of its own rows, those of a root with a scheme in its store."""

    def run(parts):
        if SCHEME.match(root):
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(root)
            opened = lambda path: store.open_input_stream(f"{base.rstrip('/')}/{path}")
        else:
            opened = lambda path: open(os.path.join(root, path), "rb")  # noqa: E731, SIM115

        def body(path: str) -> bytes | None:
            try:
                with opened(path) as f:
                    return f.read(MAX_BYTES)
            except OSError:
                return None

        for part in parts:
            for i in range(0, len(part), 16):
                yield (some := part.iloc[i : i + 16]).assign(content=[body(p) for p in some["path"]])

    return files.mapInPandas(run, f"{files.schema.simpleString()[7:-1].replace(':', ' ')}, content binary")
