"""Keeping the tables current: snapshot differences, changes, renames, removals, guards, queues and settings."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import under
from ..model import SLOW_KINDS, STATUSES


def first_status(kind: str | Column = "kind") -> Column:
    """Images and audio wait for recognition, all else for the fast lane."""
    return F.when((F.col(kind) if isinstance(kind, str) else kind).isin(*SLOW_KINDS), "ocr").otherwise("pending")


def snapshot_diff(disk: DataFrame, files: DataFrame, retry_errors: bool = False) -> DataFrame:
    """(path, op, kind, mtime, size): insert, update, delete or same for each path of the listing or the table."""
    new, old = disk.select("path", F.struct("kind", "mtime", "size").alias("new")), files.select("path", F.struct("kind", "mtime", "size").alias("old"), "status")
    both = new.join(old, "path", "full_outer")
    again = (F.col("status") == "error") if retry_errors else F.lit(False)
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(~F.col("new").eqNullSafe(F.col("old")) | again, "update").otherwise("same")
    return both.select("path", op.alias("op"), F.coalesce("new", "old").alias("x")).select("path", "op", "x.*")


def numbered(rows: DataFrame, key: str, salts: int = 64) -> DataFrame:
    """Adds n: 1, 2, ... over all rows, by ranks within parts of the keys and the sizes of the parts before, so that no task sees all rows."""
    part = F.pmod(F.xxhash64(key), F.lit(salts)).alias("part")
    own = rows.select("*", part).withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(key)))
    before = own.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count")).drop("count")
    return own.join(F.broadcast(before), "part").withColumn("n", F.col("own") + F.col("before")).drop("part", "own", "before")


def upsert(files: DataFrame, changed: DataFrame) -> DataFrame:
    """The table with changed (path, kind, mtime, size) rows put in; known paths keep their id, changed or failed ones wait again."""
    base = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base"))
    both = files.withColumn("known", F.lit(True)).join(changed.select("path", F.struct("kind", "mtime", "size").alias("new")), "path", "full_outer")
    differs = F.col("new").isNotNull() & (F.col("known").isNull() | ~F.struct("kind", "mtime", "size").eqNullSafe(F.col("new")) | (F.col("status") == "error"))
    added = numbered(both.where(F.col("known").isNull()).select("path"), "path")
    met = both.join(added, "path", "left").crossJoin(F.broadcast(base))
    take = lambda c: F.when(differs, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
    return met.select(
        F.coalesce("id", F.col("base") + F.col("n")).alias("id"), "path", take("kind"), take("mtime"), take("size"),
        F.when(differs, first_status(F.col("new.kind"))).otherwise(F.col("status")).alias("status"), F.when(differs, "").otherwise(F.col("error")).alias("error"),
    )


def remove(files: DataFrame, paths: list[str]) -> DataFrame:
    """Without the files of these paths and those under them."""
    for p in paths:
        files = files.where(~under("path", p))
    return files


def rename(files: DataFrame, old: str, new: str) -> DataFrame:
    """Moves a file or all under a folder; what was at the new path goes; ids, and so all texts, stay."""
    moved = F.when(under("path", old), F.concat(F.lit(new), F.substring("path", F.lit(len(old) + 1), F.length("path")))).otherwise(F.col("path"))
    return files.where(~under("path", new) | under("path", old)).withColumn("path", moved)


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each path, by seq."""
    rest = [c for c in changes.columns if c != "path"]
    return changes.groupBy("path").agg(F.max_by(F.struct(*rest), "seq").alias("x")).select("path", "x.*")


def ancestors(path: str) -> Column:
    """A path and the folders that it lies in."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def apply(files: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after a batch of changes (seq, op, path, kind, mtime, size): of each path the last one counts, and applying twice changes nothing.

    A delete takes all that was under the path then. Paths meet the deletes above them by equality, folder by folder.
    """
    last = last_changes(changes)
    gone = changes.where("op = 'delete'").groupBy(F.col("path").alias("above")).agg(F.max("seq").alias("gone_at"))
    paths = files.select("path").unionByName(last.select("path"))
    hit = paths.select("path", F.explode(ancestors("path")).alias("above")).join(gone, "above").groupBy("path").agg(F.max("gone_at").alias("gone_at"))
    put = last.join(hit, "path", "left").where("op in ('insert', 'update') and (gone_at is null or gone_at < seq)").drop("gone_at")
    return upsert(files, put).join(hit.join(put, "path", "left_anti"), "path", "left_anti").select(*files.columns)


def checkpointed(df: DataFrame) -> DataFrame:
    """df without its lineage, in the folder that the session names for checkpoints; in one of its own where none is named."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        own = "file:" + tempfile.mkdtemp(prefix="tesserae-checkpoints-") if context.master.startswith("local[") else f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/tesserae-checkpoints"
        context.setCheckpointDir(named or own)
    return df.checkpoint()


def replay(files: DataFrame, batch: DataFrame, cut: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """The table after a batch of changes and renames (seq, op, path, old_path, kind, mtime, size), in the order of seq.

    Renames, which are user actions and few, reach the driver; the changes between two of them are applied
    together. As each step reads the table several times, cut() ends its lineage between two of them.
    """
    renames = batch.where("op = 'rename'").orderBy("seq").select("seq", "old_path", "path").collect()
    rest = batch.where("op <> 'rename'").drop("old_path")
    before = F.size(F.filter(F.lit([r.seq for r in renames]), lambda x: x < F.col("seq"))) if renames else F.lit(0)
    rest = rest.withColumn("epoch", before)
    epochs = {r.epoch for r in rest.select("epoch").distinct().collect()}
    for k in range(len(renames) + 1):
        if k in epochs:
            files = apply(files, rest.where(F.col("epoch") == k).drop("epoch"))
            files = cut(files) if k < max(epochs) else files
        if k < len(renames):
            files = rename(files, renames[k].old_path, renames[k].path)
    return files


def replace_chunks(files: DataFrame, done: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, ids, chunks) after extraction jobs done (id, mtime, size, status, error) gave new chunks: the files whose chunks they replace, and these.
    Jobs whose file changed meanwhile are void."""
    valid = done.join(files.select("id", "mtime", "size"), ["id", "mtime", "size"], "left_semi")
    taken = new.where("page >= 0 and page < 1048576").join(valid.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(new.columns)
    state = valid.select("id", F.col("status").alias("s"), F.col("error").alias("e"))
    after = files.join(state, "id", "left").withColumn("status", F.coalesce("s", "status")).withColumn("error", F.coalesce("e", "error")).select(files.columns)
    return after, valid.select("id"), taken


def status_counts(files: DataFrame) -> DataFrame:
    """(status, n) for all four states."""
    states = files.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return F.broadcast(states).join(files.groupBy("status").count(), "status", "left").select("status", F.coalesce("count", F.lit(0)).alias("n"))


def next_jobs(files: DataFrame, status: str, claimed: list[int], n: int = 1) -> DataFrame:
    """The oldest waiting files that no worker has claimed."""
    return files.where((F.col("status") == status) & ~F.col("id").isin(*claimed) if claimed else F.col("status") == status).orderBy("id").limit(n)


def claim(files: DataFrame, claims: DataFrame, status: str, worker: str, n: int = 1) -> DataFrame:
    """The claims (id, worker) with the n oldest waiting files that nobody has claimed given to a worker; a claimed file is given to no other."""
    free = files.where(F.col("status") == status).join(claims.select("id"), "id", "left_anti").orderBy("id").limit(n)
    return claims.unionByName(free.select("id", F.lit(worker).alias("worker")))


def release(claims: DataFrame, worker: str) -> DataFrame:
    """The claims without those of a worker that is done or lost: its files can be claimed again."""
    return claims.where(F.col("worker") != worker)


def scope_of(embeds: DataFrame, note: str) -> DataFrame:
    """(path): a note and all that it embeds. embeds: note, ord, dest."""
    own = embeds.where(F.col("note") == note).select(F.col("dest").alias("path"))
    return own.unionByName(embeds.sparkSession.createDataFrame([(note,)], "path string")).distinct()


def requeue_media(files: DataFrame, old: str, new: str) -> DataFrame:
    """Images and audio wait again if the recognition settings changed."""
    return files if old == new else files.withColumn("status", F.when(F.col("kind").isin(*SLOW_KINDS), "ocr").otherwise(F.col("status")))


def upgraded_settings(meta: DataFrame) -> DataFrame:
    """An old settings row `ocr` = app|language|flag becomes `media` = language, if there is none yet."""
    row = F.struct("key", "value")
    has = meta.agg(F.bool_or(F.col("key") == "media").alias("has"))
    out = meta.crossJoin(F.broadcast(has)).where(~((F.col("key") == "ocr") & F.col("has"))).select(F.when(F.col("key") == "ocr", F.struct(F.lit("media").alias("key"), F.split("value", r"\|")[1].alias("value"))).otherwise(row).alias("x"))
    return out.select("x.*")


def missing_urls(urls: DataFrame, memo: DataFrame) -> DataFrame:
    """The distinct URLs without a remembered text: each is to be fetched once."""
    return urls.select("url").distinct().join(memo.select("url"), "url", "left_anti")


def remember(memo: DataFrame, found: DataFrame) -> DataFrame:
    """The memo with new (url, body) rows; empty texts are not kept, new ones win."""
    rows = memo.select("url", "body", F.lit(0).alias("new")).unionByName(found.where("body <> ''").select("url", "body", F.lit(1).alias("new")))
    return rows.groupBy("url").agg(F.max_by("body", F.struct("new", "body")).alias("body"))


def backlog(queued: DataFrame, urls: DataFrame, memo: DataFrame) -> DataFrame:
    """(n): distinct URLs of queued files (id) that still have no text. urls: id, url."""
    return missing_urls(urls.join(queued.select("id"), "id", "left_semi"), memo).agg(F.count("*").alias("n"))


def first_notes(embeds: DataFrame) -> DataFrame:
    """(dest, note): the first note that embeds each attachment. embeds: note, ord, dest."""
    return embeds.groupBy("dest").agg(F.min_by("note", F.struct("ord", "note")).alias("note"))


def living(results: DataFrame, listing: DataFrame) -> DataFrame:
    """The results whose file is still there."""
    return results.join(listing.select("path"), "path", "left_semi")
