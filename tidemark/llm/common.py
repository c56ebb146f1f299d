"""Shared folder and stage tables used by several operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set on a single machine (tests); a cluster's executors couldn't
    read it, so there this raises.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return str(current.get())
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def at_once(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """For jobs run in here: so many rows go to a Python worker in one batch (None: as the session has it).

    A batch is held several times over, by the JVM and the worker; long rows at the session's 10,000 a batch take up to 64 MB each time.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    if rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        if rows and before is None:
            spark.conf.unset(name)
        elif rows:
            spark.conf.set(name, before)


def stage(df: DataFrame, rows: int | None = None, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back; ``rows``: see ``at_once``.

    Cuts the lineage and keeps work from being done twice; the files outlive lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    with at_once(spark, rows):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows, so many at a time: what a worker makes of texts isn't held for a whole batch."""
    for whole in batches:
        for a in range(0, max(whole.num_rows, 1), rows):
            yield whole.slice(a, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
