"""NPZ files as a Spark data source: a partition per file, folders pruned by filters; and a writer of float32 arrays.

A file lies under ``key=value`` folders. It holds one array per column, all of the same length: two-dimensional ``X_<split>``
arrays are the features named in ``feature_cols``, other arrays are columns of their own. Files are opened through
``pyarrow.fs``, so local folders, HDFS and object stores work alike; nothing is unpickled.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

#: Rows per batch that a reader hands on.
BATCH = 65_536


@dataclass
class NpzFile(InputPartition):
    path: str
    keys: dict


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", uri) else f"file://{quote(uri)}")


def _holds(f: Filter, keys: dict) -> bool:
    value = keys[f.attribute[0]]
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, GreaterThan):
        return value > f.value
    if isinstance(f, GreaterThanOrEqual):
        return value >= f.value
    if isinstance(f, LessThan):
        return value < f.value
    return value <= f.value


class NpzReader(DataSourceReader):
    def __init__(self, root: str, schema: StructType, keys: list[str]) -> None:
        self.root, self.schema, self.keys, self.filters = root, schema, keys, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of folder keys are done here, the others by Spark."""
        for f in filters:
            own = isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and len(f.attribute) == 1 and f.attribute[0] in self.keys
            if own:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """The files whose folders pass; folders that don't are never listed."""
        system, base = _open(self.root)
        level = [(base.rstrip("/"), {})]
        for k, key in enumerate(self.keys):
            below = []
            for path, keys in level:
                for x in system.get_file_info(fs.FileSelector(path, allow_not_found=k == 0)):
                    name, _, value = x.base_name.partition("=")
                    if x.type == fs.FileType.Directory and name == key:
                        found = keys | {key: None if value == "__null__" else unquote(value)}
                        if all(found[key] is not None and _holds(f, found) for f in self.filters if f.attribute[0] == key):
                            below.append((x.path, found))
            level = below
        files = []
        for path, keys in level:
            files += [NpzFile(x.path, keys) for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.base_name.endswith(".npz")]
        return sorted(files, key=lambda f: f.path)

    def read(self, partition: NpzFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file
            return
        schema = to_arrow_schema(self.schema)
        system, _ = _open(self.root)
        with system.open_input_file(partition.path) as source:
            held = np.load(io.BytesIO(source.read()), allow_pickle=False)
        names = held["feature_cols"].tolist() if "feature_cols" in held else []
        splits = [k[2:] for k in held.files if k.startswith("X_")] or [""]
        for split in splits:
            tail = f"_{split}" if split else ""
            wide = held[f"X{tail}"] if names else None
            columns, missing = {}, {}
            for field in self.schema:
                if field.name in partition.keys:
                    continue
                if field.name in names:
                    columns[field.name] = wide[:, names.index(field.name)]
                elif f"{field.name}{tail}" in held:
                    columns[field.name] = held[f"{field.name}{tail}"]
                    if f"{field.name}{tail}__null" in held:
                        missing[field.name] = held[f"{field.name}{tail}__null"]
            rows = len(wide) if wide is not None else len(next(iter(columns.values()), ()))
            for begin in range(0, rows, BATCH):
                n = min(BATCH, rows - begin)
                made = []
                for field in schema:
                    if field.name in partition.keys:
                        made.append(pa.array([partition.keys[field.name]] * n, field.type))
                    elif field.name in columns:
                        gaps = missing.get(field.name)
                        made.append(_column(columns[field.name][begin : begin + n], None if gaps is None else gaps[begin : begin + n], field.type))
                    elif field.name == "split":
                        made.append(pa.array([split or None] * n, field.type))
                    else:
                        made.append(pa.nulls(n, field.type))  # an older file lacks it
                yield pa.RecordBatch.from_arrays(made, schema=schema)


def _column(values: np.ndarray, missing: np.ndarray | None, kind: pa.DataType) -> pa.Array:
    if pa.types.is_timestamp(kind):
        return pa.array(values.astype("datetime64[us]")).cast(kind)
    if pa.types.is_string(kind):
        return pa.array(values.tolist(), kind, mask=missing)
    return pa.array(np.ascontiguousarray(values)).cast(kind)


class NpzSource(DataSource):
    """``spark.read.format("npz")`` with options ``path`` and ``keys`` (folder columns, outermost first) and a schema."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpzReader(self.options["path"], schema, [k for k in self.options.get("keys", "").split(",") if k])


def read_npz(spark: SparkSession, root: str, schema: str | StructType, keys: list[str] | None = None) -> DataFrame:
    """Rows of all files under ``root``: the folder ``keys`` (strings), and the columns of ``schema``.

    A column that a file lacks is null there; ``split`` is the name behind ``X_``. Filters on folder keys leave out
    folders before any file is opened. No file at all gives no rows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpzSource)
    own = StructType([StructField(k, StringType()) for k in keys or []])
    rest = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = StructType([*own, *rest])
    return spark.read.format("npz").schema(whole).option("path", root).option("keys", ",".join(keys or [])).load()


def write_npz(
    df: DataFrame,
    root: str,
    features: list[str],
    columns: dict[str, str],
    keys: list[str],
    order: list[str],
    split: str = "split",
    target: str | None = None,
    rows_per_file: int = 1_000_000,
    meta: dict | None = None,
) -> int:
    """Write ``X_<split>`` (float32), ``y_<split>`` and the other ``columns`` (name to type) as NPZ; gives the number of files.

    Each combination of the folder ``keys`` has a folder; rows beyond about ``rows_per_file`` go to further files of it, dealt
    by the hash of ``order``, each written by its own task in that order. A file gets its name when it is whole, so
    that readers never see half of one, and a repeated task writes the same name again. Nulls in features and target become
    NaN, null texts are marked in a ``__null`` array beside theirs; a null key has a folder that no filter on the key finds.
    """
    if not keys:
        raise ValueError("files need at least one folder key")
    spec, run, names = list(columns.items()), uuid.uuid4().hex[:8], [f"_k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.coalesce(F.col(k).cast("string"), F.lit("__null__")).alias(n) for k, n in zip(keys, names, strict=True)],
        F.coalesce(F.col(split).cast("string"), F.lit("")).alias("_split"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        *[F.col(c).cast("float").alias(f"_f{i}") for i, c in enumerate(features)],
        *([F.col(target).cast("float").alias("_y")] if target else []),
        *[F.col(c).cast(t).alias(f"_c{i}") for i, (c, t) in enumerate(spec)],
    )
    sizes = rows.groupBy(*names).agg(F.ceil(F.count("*") / rows_per_file).alias("_files"))
    rows = rows.join(sizes, names).withColumn("_part", F.pmod(F.xxhash64(*[f"_o{i}" for i in range(len(order))]), "_files").cast("int"))

    def save(group: pd.DataFrame) -> pd.DataFrame:
        held = {"feature_cols": np.array(features)}
        for name, part in group.sort_values([f"_o{i}" for i in range(len(order))]).groupby("_split"):
            held[f"X_{name}"] = part[[f"_f{i}" for i in range(len(features))]].to_numpy(dtype=np.float32)
            if target:
                held[f"y_{name}"] = part["_y"].to_numpy(dtype=np.float32)
            for i, (c, kind) in enumerate(spec):
                values = part[f"_c{i}"]
                if kind == "string":
                    held[f"{c}_{name}__null"] = values.isna().to_numpy()
                    values = values.fillna("").to_numpy(dtype=str)
                elif kind.startswith("timestamp"):
                    values = values.to_numpy(dtype="datetime64[us]")
                held[f"{c}_{name}"] = np.asarray(values)
        if meta:
            held["extra_meta_json"] = np.array([json.dumps(meta, sort_keys=True)])
        made = io.BytesIO()
        np.savez_compressed(made, **held)
        system, base = _open(root)
        folder = "/".join([base.rstrip("/"), *[f"{k}={_folder(group[n].iloc[0])}" for k, n in zip(keys, names, strict=True)]])
        system.create_dir(folder, recursive=True)
        final = f"{folder}/part-{int(group['_part'].iloc[0]):05d}-{run}.npz"
        half = f"{final}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(half) as out:
            out.write(made.getvalue())
        system.move(half, final)
        return pd.DataFrame({"path": [final]})

    return rows.groupBy(*names, "_part").applyInPandas(save, "path string").count()


def _folder(value: str) -> str:
    return value if value == "__null__" else quote(value, safe="")
