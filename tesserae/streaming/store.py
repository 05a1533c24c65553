"""Snapshots of tables: a new folder for each version, and a pointer that is moved when all are written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    """Tables under root/<version>/<name>; one writer, many readers. Any store that Spark writes will do. Of each table the last keep versions stay."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[tuple[int, int]]:
        """(version, batch) of the complete versions, from the names of their markers."""
        folder = self._path(self.root)
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted((int(n.split("-")[1]), int(n.split("-")[2]) - 1) for n in names if n.startswith("done-"))

    def version(self) -> int:
        return max([0, *(v for v, _ in self._versions())])

    def batch(self) -> int:
        return max([-1, *(b for _, b in self._versions())])

    def read(self, name: str) -> DataFrame:
        """The table's latest version."""
        for v, _ in reversed(self._versions()):
            if self._fs.exists(self._path(f"{self.root}/v{v}/{name}")):
                return self.spark.read.parquet(f"{self.root}/v{v}/{name}")
        raise FileNotFoundError(f"{self.root}: {name}")

    def write(self, tables: dict[str, DataFrame], batch: int | None = None) -> int:
        """A new version with these tables; others keep their latest one."""
        v, batch = self.version() + 1, self.batch() if batch is None else batch
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v{v}/{name}")
        self._fs.create(self._path(f"{self.root}/done-{v}-{batch + 1}"), True).close()
        self._prune(tables)
        return v

    def _prune(self, names) -> None:
        """Deletes older versions of these tables; readers of the last ones are not disturbed. Markers stay."""
        for name in names:
            paths = [self._path(f"{self.root}/v{v}/{name}") for v, _ in self._versions()]
            for old in [p for p in paths if self._fs.exists(p)][: -self.keep]:
                self._fs.delete(old, True)

    def scratch(self, df: DataFrame) -> DataFrame:
        """df, written beside the versions and read again."""
        path = f"{self.root}/scratch/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear_scratch(self) -> None:
        self._fs.delete(self._path(f"{self.root}/scratch"), True)

    def has(self, name: str) -> bool:
        return any(self._fs.exists(self._path(f"{self.root}/v{v}/{name}")) for v, _ in self._versions())

    def reset(self) -> None:
        self._fs.delete(self._path(self.root), True)
