"""Shared pieces of the training-data operators: scratch tables in the cluster's shared folder,
and vectorised word, line and window hashing over the UTF-8 buffers of Arrow batches."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern [^\x20\x09-\x0D]+ .
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Byte classes that fold case and digits.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_DIGITS = LOWER.copy()
LOWER_DIGITS[48:58] = 48
#: Odd multipliers of the polynomial hashes, and of the final mixing.
BASE = 0x9E3779B97F4A7C15
WORD = np.uint64(0xD1342543DE82EF95)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set: for a local master one that is removed at exit, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.startswith("local["):
        own = f"/tmp/checkpoints/tesserae-{os.getpid()}"
        if not os.path.isdir(own):
            os.makedirs(own)
            atexit.register(shutil.rmtree, own, True)
        found = f"file:{own}"
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir')}/tesserae-scratch").rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path for a table of that tag in the shared folder."""
    return f"{shared_dir(spark)}/tesserae-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: the lineage ends there, and lost executors lose nothing."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tesserae_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by stored() that no returned DataFrame reads."""
    spark, path = df.sparkSession, df._tesserae_path
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def met_by(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """left with the columns of right, which has one row for each value of key and the number of left's total rows that have it.

    The values of more than 1/4096 of the rows, so fewer than 4096, are broadcast: no task gets all rows of
    one of them. The others meet by a join of their own. Rows of left without a partner go.
    """
    hot = F.col(count) > max(total >> 12, 1 << 12)
    many = F.broadcast(right.where(hot))
    return left.join(many, key).unionByName(left.join(many.select(key), key, "left_anti").join(right.where(~hot), key))


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def text_blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about limit bytes of text (whole rows always): the slice, its bytes, its len+1 offsets. Null: empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
        n = len(col)
        if not n:
            continue
        _, o, d = col.buffers()
        off = np.frombuffer(o, np.int64)[col.offset : col.offset + n + 1]
        data = np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n, modulo 2^64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever it stands."""
    up, down = powers(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    return mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words [^\\x20\\x09-\\x0D]+; words never cross rows."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    start = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    at = edges[(edges > 0) & (edges < len(data))]
    start[at] = inside[1:-1][at]
    end[at - 1] = inside[1:-1][at - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def windows_of(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of n consecutive words of one row."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out * WORD + h[at + k]
    return mixed(out), at


def long_view(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """Values dealt to n rows; rows are ascending."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
