"""Partitions that appear whole or not at all, and runs that go on where they stopped.

Rows are written to a staging folder beside the table, checked, and moved into place partition by partition; a marker is set
when a partition is in place. Readers take marked partitions only, so a write that dies at any point leaves the partitions
it had published and nothing half-written. Moves are renames by Hadoop's file system: atomic on HDFS and local
disks; on object stores a rename copies, and the marker alone tells what is whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import LAYOUT, table_path

DONE, STAGING, OLD = "_done", "_staging", "_old"


class Folder:
    """A folder on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs, self.root = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path.rstrip("/")

    def at(self, *parts: str):
        return self.path("/".join([self.root, *parts]))

    def names(self, *parts: str) -> list[str]:
        at = self.at(*parts)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def below(self, depth: int, *parts: str) -> list[str]:
        """Partition folders ``depth`` levels down, as relative paths."""
        found = [""]
        for _ in range(depth):
            found = [f"{x}/{n}".lstrip("/") for x in found for n in self.names(*parts, *([x] if x else [])) if "=" in n]
        return found

    def move(self, source: list[str], target: list[str]) -> None:
        self.fs.mkdirs(self.at(*target).getParent())
        if not self.fs.rename(self.at(*source), self.at(*target)):
            raise OSError(f"can't move {'/'.join(source)} to {'/'.join(target)} in {self.root}")

    def drop(self, *parts: str) -> None:
        self.fs.delete(self.at(*parts), True)


def done_partitions(spark: SparkSession, root: str, kind: str, freq: str | None = None) -> list[str]:
    """Relative paths of the partitions that are in place."""
    return [unquote(n) for n in Folder(spark, table_path(root, kind, freq)).names(DONE) if not n.startswith(".")]


def publish(df: DataFrame, root: str, kind: str, mode: str = "overwrite", freq: str | None = None, checks: tuple[Callable[[], object], ...] = ()) -> list[str]:
    """Write ``df`` by the kind's partition columns and publish its partitions; gives their relative paths.

    overwrite: partitions of ``df`` replace those in place; skip: those in place stay and their rows of ``df`` go, so that a run
    that died is simply run again. ``checks`` (such as the verifications of ``operators.watch``) run after the rows are written and
    before the first partition is published; one that raises leaves the table as it was. No rows publish nothing.
    """
    spark, path, by = df.sparkSession, table_path(root, kind, freq), LAYOUT[kind]
    if not by:
        raise ValueError(f"{kind} has no partitions")
    folder, run = Folder(spark, path), uuid.uuid4().hex
    if mode == "skip":
        done = [_values(p) for p in done_partitions(spark, root, kind, freq)]
        if done:
            known = spark.createDataFrame(done, ", ".join(f"`_{c}` string" for c in by))  # a row per partition
            keys = [F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")) == F.col(f"_{c}") for c in by]
            df = df.join(F.broadcast(known), keys, "left_anti")
    df.hint("rebalance", *by).write.option("compression", "zstd").partitionBy(*by).parquet(f"{path}/{STAGING}/{run}")
    for check in checks:
        check()
    fresh = folder.below(len(by), STAGING, run)
    for part in fresh:
        mark = quote(part, safe="")
        folder.drop(DONE, mark)  # from here to the new mark the partition counts as not there
        if folder.fs.exists(folder.at(part)):
            folder.move([part], [OLD, run, part])
        folder.move([STAGING, run, part], [part])
        folder.fs.mkdirs(folder.at(DONE))
        folder.fs.create(folder.at(DONE, mark), True).close()
    for name in (STAGING, OLD):
        folder.drop(name, run)
    return fresh


def _values(part: str) -> tuple[str, ...]:
    return tuple(unquote(x.split("=", 1)[1]) for x in part.split("/"))


def read_published(spark: SparkSession, root: str, kind: str, freq: str | None = None, keep: Callable[[dict], bool] | None = None) -> DataFrame:
    """Rows of the partitions in place; ``keep`` chooses among them by their values before anything is listed or read."""
    path, by = table_path(root, kind, freq), LAYOUT[kind]
    parts = done_partitions(spark, root, kind, freq)
    if keep:
        parts = [p for p in parts if keep(dict(zip(by, _values(p), strict=True)))]
    if not parts:
        raise FileNotFoundError(f"no published {kind} under {root}")
    return spark.read.option("basePath", path).parquet(*[f"{path}/{p}" for p in parts])
