"""The engine's surface: open a folder, index it, search, ask, follow changes."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import image_urls, is_markdown, languages, stem
from .model import CHUNKS, DEFAULT_LIMIT, FILES, IMAGE_SLOT, MAX_IMAGES, META, REMOTE_OCR
from .operators import ask, changes, correct, index
from .operators.sections import sections
from .plans.query import parse
from .plans.search import Index, best, fetched, file_of, pack
from .sources import extract, vault
from .streaming.store import Snapshots

#: The index is built anew when more than one file in REBUILD has changed since it was; until then the changed files' rows lie beside it.
REBUILD = 16
FILE_COLUMNS = [c.split()[0] for c in FILES.split(", ")]
CHUNK_COLUMNS = [c.split()[0] for c in CHUNKS.split(", ")]


class Engine:
    """Tables of one corpus and what can be asked of them. After search(), corrected is the query that was run instead, or ''."""

    def __init__(self, spark: SparkSession, root: str = "", store: Snapshots | None = None, ignore: list[str] = (), backend: extract.Backend | None = None, now_ms: int | None = None, name_on_page0: bool = True):
        self.spark, self.root, self.store, self.ignore = spark, root, store, list(ignore)
        self.backend, self.now_ms, self.name_on_page0 = backend or extract.installed(), now_ms, name_on_page0
        self.paused, self.corrected, self._index = False, "", None

    @classmethod
    def open(cls, spark: SparkSession, root: str, store: str, **options) -> Engine:
        """A folder with its tables in store; made if there are none."""
        out = cls(spark, root, Snapshots(spark, store), **options)
        if not out.store.version():
            out._create()
        return out

    @classmethod
    def over(cls, tables: Index, now_ms: int | None = None) -> Engine:
        """An engine on given tables."""
        out = cls(tables.files.sparkSession, now_ms=now_ms)
        out._index = tables
        return out

    def load(self, files: DataFrame, chunks: DataFrame) -> None:
        """Takes tables of files and chunks from elsewhere in place of a folder, and builds the index."""
        own = self.store.scratch(chunks.select(CHUNK_COLUMNS))
        self.store.write({"files": files.select(FILE_COLUMNS)} | self._built(own) | {"sizes": index.file_sizes(own)})
        self.store.clear_scratch()
        self._index = None

    def _create(self) -> None:
        empty = lambda ddl: self.spark.createDataFrame([], ddl)
        chunks = empty(CHUNKS)
        self.store.write({"files": empty(FILES), "memo": empty(REMOTE_OCR)} | self._built(chunks) | {"sizes": index.file_sizes(chunks)})

    # -- indexing

    def scan(self, retry_errors: bool = False) -> None:
        """Compares the folder with the table: new and changed files wait for extraction, missing ones go with their chunks."""
        files = self.store.read("files")
        diff = changes.snapshot_diff(vault.listing(self.spark, self.root, self.ignore), files, retry_errors)
        gone = diff.where("op = 'delete'").select("path")
        after = changes.upsert(files.join(gone, "path", "left_anti").select(files.columns), diff.where("op in ('insert', 'update')"))
        if not retry_errors:  # failed files wait again only when asked for
            failed = files.where("status = 'error'").join(diff.where("op = 'same'"), "path", "left_semi").select("path", F.col("error").alias("old"))
            after = after.join(failed, "path", "left").withColumn("status", F.when(F.col("old").isNotNull(), "error").otherwise(F.col("status"))).withColumn("error", F.coalesce("old", "error")).drop("old")
        self._write(after.select(files.columns), files.join(gone, "path").select("id"))

    def extract(self, status: str = "pending") -> None:
        """One pass of a lane: reads all waiting files and replaces their chunks. Paused engines leave the slow lane alone."""
        if self.paused and status == "ocr":
            return
        files, memo = self.store.read("files"), self.store.read("memo")
        waiting = files.where(F.col("status") == status)
        notes = waiting.where(is_markdown("path"))
        read = extract.extracted(vault.contents(waiting.select("path"), self.root), self.backend)
        whole = read.join(waiting.select("id", "path", "mtime", "size"), "path").cache()
        body = whole.join(notes.select("id"), "id", "left_semi").select("id", F.col("pages")[0]["body"].alias("text"))
        parts = sections(body, "id").select("id", F.col("page").alias("n"), F.lit("text").alias("source"), "title", "body")
        urls = body.select("id", F.posexplode(F.slice(image_urls("text"), 1, MAX_IMAGES)).alias("i", "url"))
        if status == "ocr" and self.backend.fetch:
            memo = changes.remember(memo, extract.remote_texts(urls, memo, self.backend))
        images = urls.join(memo, "url").select("id", (F.lit(IMAGE_SLOT) + F.col("i")).alias("n"), F.lit("ocr").alias("source"), F.concat(F.lit("url:"), F.col("i").cast("string")).alias("title"), "body")
        others = whole.join(notes.select("id"), "id", "left_anti").select("id", F.inline("pages"))
        pages = parts.unionByName(images).unionByName(others)
        first = pages.groupBy("id").agg(F.min(F.when(F.col("n") < IMAGE_SLOT, F.col("n"))).alias("least"))
        named = pages.join(first, "id").join(files.select("id", "path", "kind"), "id")
        carries = (F.col("n") == F.col("least")) & (F.lit(self.name_on_page0) | (F.col("n") > 0))
        new = named.select(pack("id", "n").alias("rowid"), F.col("id").alias("file_id"), F.col("n").alias("page"), F.when(carries, stem("path", "kind")).otherwise("").alias("name"), "title", "body", "source")
        more = urls.select("id").distinct().withColumn("more", F.lit(status == "pending" and self.backend.fetch is not None))
        done = whole.join(more, "id", "left").select("id", "mtime", "size", F.when(F.col("error") != "", "error").when(F.col("more"), "ocr").otherwise("done").alias("status"), "error")
        after, touched, taken = changes.replace_chunks(self.store.read("files"), done, new)
        self._write(after, touched, taken, memo)
        whole.unpersist()

    def _built(self, chunks: DataFrame) -> dict[str, DataFrame]:
        """The tables of an index that is built anew, with nothing beside them: laid out by row id, and by term."""
        posts = index.postings(chunks)
        stale = chunks.select(F.col("file_id").alias("id")).limit(0)
        return {
            "chunks": chunks.repartitionByRange("rowid").sortWithinPartitions("rowid"), "postings": posts.repartitionByRange("term", "rowid").sortWithinPartitions("term", "rowid"),
            "recent_chunks": chunks.limit(0), "recent_postings": posts.limit(0), "stale": stale, "stats": index.corpus_stats(index.doc_stats(chunks)), "vocab": index.vocabulary(posts),
        }

    def _current(self, name: str) -> DataFrame:
        """A table of chunks or postings: the rows of files unchanged since the index was built, and the recent ones of the others."""
        base, recent, stale = self.store.read(name), self.store.read(f"recent_{name}"), self.store.read("stale")
        return base.join(stale, file_of() == F.col("id"), "left_anti").unionByName(recent)

    def _write(self, files: DataFrame, touched: DataFrame, chunks: DataFrame | None = None, memo: DataFrame | None = None) -> None:
        """Files, and the chunks that now belong to the touched ones (id). Only these files' chunks and postings are written, beside those
        of the others, until more than 1/REBUILD of all files have changed since the index was built; then it is built anew."""
        keep = self.store.scratch
        new_files, touched = keep(files), keep(touched.select("id").distinct())
        new = keep(chunks if chunks is not None else self.store.read("chunks").limit(0))
        drop = lambda df, by: df.join(touched, by == F.col("id"), "left_anti")
        stale = keep(self.store.read("stale").unionByName(touched).distinct())
        recent = keep(drop(self.store.read("recent_chunks"), F.col("file_id")).unionByName(new))
        out = {"files": new_files} | ({"memo": memo} if memo is not None else {})
        sizes = keep(drop(self.store.read("sizes"), F.col("file_id")).unionByName(index.file_sizes(new)))
        if stale.count() * REBUILD > max(sizes.count(), 1):
            base = self.store.read("chunks")
            out |= self._built(keep(base.join(stale, F.col("file_id") == F.col("id"), "left_anti").unionByName(recent)))
        else:
            was, now = self._current("postings").join(touched, file_of() == F.col("id"), "left_semi"), keep(index.postings(new))
            moved = index.vocabulary(now).unionByName(index.vocabulary(was).select("term", (-F.col("doc")).alias("doc"), (-F.col("cnt")).alias("cnt")))
            vocab = self.store.read("vocab").unionByName(moved).groupBy("term").agg(F.sum("doc").alias("doc"), F.sum("cnt").alias("cnt")).where("doc > 0")
            out |= {"recent_chunks": recent, "recent_postings": drop(self.store.read("recent_postings"), file_of()).unionByName(now), "stale": stale, "vocab": vocab}
            out["stats"] = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_tokens"))
        self.store.write(out | {"sizes": sizes})
        self.store.clear_scratch()
        self._index = None

    def refresh(self, retry_errors: bool = False) -> None:
        """Scan, then both lanes."""
        self.scan(retry_errors)
        for lane in ("pending", "ocr"):
            if self.store.read("files").where(F.col("status") == lane).limit(1).count():
                self.extract(lane)

    def apply_changes(self, feed: DataFrame) -> None:
        """Change rows (seq, op, path, old_path, kind, mtime, size); renamed files keep their texts."""
        from .streaming.feed import apply_batch

        old = self.store.read("files").select("id", F.col("path").alias("old"))
        apply_batch(self.store)(feed, self.store.batch() + 1)
        self.catch_up(old)

    def catch_up(self, old: DataFrame) -> None:
        """Chunks and postings after changes of the files table: old (id, old) are the paths that it had. For a stream's batches too."""
        files = self.store.read("files")
        both = old.join(files, "id", "left")
        touched = both.where("path is null or path <> old").select("id", stem("path", "kind").alias("stem"), "path")
        chunks = self._current("chunks").join(touched.where("path is not null").withColumnRenamed("id", "file_id"), "file_id")
        renamed = chunks.withColumn("name", F.when(F.col("name") != "", F.col("stem")).otherwise("")).select(CHUNK_COLUMNS)
        self._write(files, touched, renamed)

    def follow(self, folder: str, checkpoint: str, seconds: int | None = 60):
        """Applies change rows as they arrive as JSON files in a folder, to the files and to the index; changed files then wait for extract()."""
        from .streaming.feed import follow

        return follow(self.spark, folder, self.store, checkpoint, seconds, self.catch_up)

    def configure(self, settings: str) -> None:
        """Takes the JSON text of a settings file: its ignored folders, and its recognition languages; media wait again where these have changed."""
        row = self.spark.createDataFrame([(settings,)], "x string").select(extract.ignore_list(F.col("x")).alias("ignore"), F.coalesce(F.get_json_object("x", "$.ocrLang"), F.lit("")).alias("lang")).first()
        self.ignore = list(row.ignore or [])
        meta = {r.key: r.value for r in self.store.read("meta").collect()} if self.store.has("meta") else {}
        new = self.spark.createDataFrame([(row.lang,)], "x string").select(languages("x").alias("x")).first().x
        old = meta.get("media", new)
        self.backend = replace(self.backend, languages=new)
        tables = {"meta": self.spark.createDataFrame(sorted((meta | {"media": new}).items()), META)}
        if old != new:
            tables["files"] = changes.requeue_media(self.store.read("files"), old, new)
        self.store.write(tables)
        self._index = None

    def status(self) -> dict:
        files = self.store.read("files")
        kinds = {r.kind for r in files.select("kind").distinct().collect()}
        return {"counts": {r.status: r.n for r in changes.status_counts(files).collect()}, "paused": self.paused, "missing": extract.missing_tools(kinds, self.backend)}

    def reset(self) -> None:
        """Forgets everything stored, remembered image texts too."""
        self.store.reset()
        self._index = None
        self._create()

    # -- asking

    def tables(self) -> Index:
        if self._index is None:
            read = self.store.read
            self._index = Index(read("files"), self._current("chunks"), self._current("postings"), read("stats"), read("vocab"))
        return self._index

    def _now(self) -> int:
        return self.now_ms if self.now_ms is not None else int(time.time() * 1000)

    def search(self, text: str, scope: list[str] | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """Results in order; if there are none, those of the corrected query."""
        query, tables, self.corrected = parse(text), self.tables(), ""
        top = best(tables, query, self._now(), scope, limit)
        if query.pos and not top and (other := correct.corrected(tables.vocab, query)):
            query, self.corrected = other, other.shown()
            top = best(tables, query, self._now(), scope, limit)
        return fetched(tables, query, top)

    def ask(self, question: str, model: Callable[[str, str], str], scope: list[str] | None = None) -> tuple[str, list]:
        """The model's answer and the sources it was given; model(instructions, prompt) is any callable."""
        if not question.strip():
            raise ValueError("empty question")
        return ask.answer(self.tables(), question, self._now(), model, scope)
