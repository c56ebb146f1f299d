"""Tables bucketed by the columns they are joined on: joins among them move no rows.

A table's folder holds its files and, beside them, ``NAME.layout`` with columns and number of buckets, so that another session can
open it. The catalog knows it under a name of its own for each time it is opened.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.checks import require_columns
from tidemark.sources.raw import _exists
from tidemark.sources.tables import read_json, write_json


def add_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int, by: list[str] | None = None) -> None:
    """Add rows to the table at ``path``, which is made if it isn't there; a partition (of ``by``) that it has already is replaced.

    Rows are dealt by the keys' hash once, as the buckets want them: a task writes one file for each of its buckets and partitions.
    Give keys that no single value fills (symbol and time, not symbol alone). A table keeps its keys, number of buckets and columns;
    rows with other columns, keys or buckets raise. Null keys have a bucket, too; no rows make an empty table.
    """
    spark, by = df.sparkSession, list(by or [])
    require_columns(df, [*keys, *by], "bucketed rows")
    df = df.select(*[f"`{c}`" for c in df.columns if c not in by], *by)
    layout = {"keys": list(keys), "buckets": buckets, "by": by, "columns": [[f.name, f.dataType.simpleString()] for f in df.schema]}
    if not _exists(spark, f"{path}.layout"):
        write_json(spark, layout, f"{path}.layout")
    elif read_json(spark, f"{path}.layout") != layout:
        raise ValueError(f"{path} has other keys, buckets or columns")
    name = _register(spark, path, layout)
    try:
        df.repartition(buckets, *keys).sortWithinPartitions(*by, *keys).write.insertInto(name, overwrite=bool(by))
    finally:
        spark.sql(f"DROP TABLE {name}")


def _register(spark: SparkSession, path: str, layout: dict) -> str:
    name, keys = f"bucketed_{uuid.uuid4().hex}", ", ".join(f"`{c}`" for c in layout["keys"])
    columns = ", ".join(f"`{c}` {kind}" for c, kind in layout["columns"])
    parts = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in layout['by'])})" if layout["by"] else ""
    # dynamic: an insert replaces the partitions that it has rows of
    options = "compression 'zstd', partitionOverwriteMode 'dynamic'"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS ({options}) {parts} CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    if layout["by"] and _exists(spark, path):
        spark.catalog.recoverPartitions(name)
    return name


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` with its buckets, as of now: what is added later is seen when it is opened again."""
    return spark.table(_register(spark, path, read_json(spark, f"{path}.layout")))


def join_bucketed(left: DataFrame, others: list[DataFrame], keys: list[str], how: str = "left") -> DataFrame:
    """``left`` with each of ``others`` joined on exactly the keys that all are bucketed by: bucket meets bucket, nothing is exchanged.

    Merge joins are asked for, since a side that looks small would otherwise be broadcast.
    """
    return reduce(lambda a, b: a.join(b.hint("merge"), keys, how), others, left)
