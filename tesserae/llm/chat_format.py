"""Chat formatting after cumulative-snapshot collapse, in DataFrame operations only.

Loggers often write a conversation again after every turn. Every turn gets two rolling 64-bit
hashes of all turns up to it (window aggregates); a conversation whose last hash is a hash inside
a longer one is a snapshot of that one and falls to an anti-join. Equal conversations leave one,
that of the lowest id. Those that are left are rendered with role markers.

Defined results: turns are ordered by (turn, role, text), nulls first; a row that repeats another
of its conversation counts once; roles are trimmed and lower-cased, null or empty: ``unknown``;
a null text is empty; rows without an id are one conversation with id null, the last of equal
ones; markers inside a text are broken by a blank; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(rows: DataFrame) -> DataFrame:
    role = F.coalesce(F.nullif(F.lower(F.trim("role")), F.lit("")), F.lit("unknown"))
    rows = rows.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00")).alias("key"), "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    before = F.lag(F.struct("turn", "role", "text")).over(order)
    rows = rows.withColumn("again", F.coalesce(before.eqNullSafe(F.struct("turn", "role", "text")), F.lit(False))).where(~F.col("again")).drop("again")
    return rows.withColumn("pos", F.row_number().over(order))


def marks(rows: DataFrame) -> DataFrame:
    """(conv_id, key, pos, n, h1, h2): for each turn the hashes of the conversation up to it."""
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _turns(rows).select(
        "conv_id", "key", "pos", F.count("*").over(Window.partitionBy("key")).alias("n"),
        F.bit_xor(F.xxhash64("pos", "role", "text")).over(so_far).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("second"), "text", "pos", "role")).over(so_far).alias("h2"),
    )


def maximal(rows: DataFrame) -> DataFrame:
    """(key, n, copies) of the conversations that no other one extends; of equal ones the lowest id."""
    turns = stored(marks(rows), "chat")
    whole = turns.where(F.col("pos") == F.col("n")).groupBy("n", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "key")).alias("who"), F.count("*").alias("copies"))
    inner = turns.where(F.col("pos") < F.col("n")).select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return whole.join(inner.withColumn("n", F.col("n").cast("long")), ["n", "h1", "h2"], "left_anti").select("who.key", "n", "copies")


def rendered(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text) of each maximal conversation."""
    said = F.concat(F.lit(OPEN), "role", F.lit("\n"), F.replace("text", F.lit("<|"), F.lit("< |")), F.lit(CLOSE + "\n"))
    kept = _turns(rows).join(maximal(rows), "key").select("key", "conv_id", "n", "copies", F.struct("pos", said.alias("said")).alias("turn"))
    whole = kept.groupBy("key").agg(F.any_value("conv_id").alias("conv_id"), F.any_value("n").alias("n_turns"), F.any_value("copies").alias("n_copies"), F.array_sort(F.collect_list("turn")).alias("turns"))
    return whole.select("conv_id", "n_turns", "n_copies", F.array_join("turns.said", "").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = rf"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(nullif(lower(trim(role)), ''), 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
      string_agg(role || chr(1) || text || chr(2), '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS said
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
whole AS (SELECT n, said, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos = n GROUP BY n, said),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = w.n AND p.said = w.said))
SELECT k.conv_id, k.n::BIGINT AS n_turns, k.copies::BIGINT AS n_copies,
       string_agg('{OPEN}' || p.role || chr(10) || replace(p.text, '<|', '< |') || '{CLOSE}' || chr(10), '' ORDER BY p.pos) AS text
FROM kept k JOIN p ON p.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY k.conv_id, k.n, k.copies
"""
