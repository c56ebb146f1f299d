import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources.arrays import read_npz, write_npz

SCHEMA = "symbol string, date string, split string, ts timestamp_ntz, id long, name string, a float, b float, y float"


def rows(n=500):
    out = []
    for k in range(n):
        symbol = ("BTC", "ETH", "a/b=c", None)[k % 4]
        out.append((symbol, f"2024-01-0{1 + k % 3}", ("train", "pred")[k % 5 == 0], dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=k * 17), k, None if k % 7 == 0 else f"n{k}é", k / 8, None if k % 11 == 0 else -float(k), float(k)))
    return out


def write(spark, path, **more):
    df = spark.createDataFrame(rows(), SCHEMA)
    return write_npz(df, path, ["a", "b"], {"ts": "timestamp_ntz", "id": "long", "name": "string"}, ["symbol", "date"], ["ts", "id"], target="y", meta={"k": 1}, **more)


@pytest.mark.parametrize("per_file", [1_000_000, 10])
def test_round_trip(spark, tmp_path, per_file):
    files = write(spark, str(tmp_path), rows_per_file=per_file)
    assert files == len(list(tmp_path.rglob("*.npz"))) and not list(tmp_path.rglob("*.tmp"))
    assert files == 12 if per_file > 500 else files > 40
    got = read_npz(spark, str(tmp_path), "split string, ts timestamp_ntz, id long, name string, a float, b float, y float, gone double", ["symbol", "date"]).collect()
    want = sorted(rows(), key=lambda r: r[4])
    got = sorted(got, key=lambda r: r.id)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g.symbol, g.date, g.split, g.ts, g.id, g.name, g.a, g.y, g.gone) == (w[0], w[1], w[2], w[3], w[4], w[5], w[6], w[8], None)
        assert np.isnan(g.b) if w[7] is None else g.b == w[7]


def test_plain_files_are_float32_arrays(spark, tmp_path):
    write(spark, str(tmp_path))
    (path,) = (tmp_path / "symbol=BTC" / "date=2024-01-01").glob("*.npz")
    held = np.load(path, allow_pickle=False)
    assert held["X_train"].dtype == held["y_pred"].dtype == np.float32
    assert held["feature_cols"].tolist() == ["a", "b"] and (np.diff(held["id_train"]) > 0).all()
    assert held["X_train"].shape == (len(held["y_train"]), 2) and '"k": 1' in held["extra_meta_json"][0]


def test_filters_leave_out_folders(spark, tmp_path):
    write(spark, str(tmp_path))
    # a file that can't be read, in a folder that filters leave out
    (tmp_path / "symbol=BTC" / "date=2024-01-03" / "bad.npz").write_bytes(b"no zip")
    df = read_npz(spark, str(tmp_path), "id long", ["symbol", "date"])
    with pytest.raises(Exception):
        df.count()
    day = df.where("symbol = 'BTC' and date <= '2024-01-02'")
    assert sorted(r.id for r in day.collect()) == [r[4] for r in rows() if r[0] == "BTC" and r[1] <= "2024-01-02"]
    assert day.rdd.getNumPartitions() == 2
    assert df.where(F.col("symbol").isin("ETH", "a/b=c") & (F.col("date") > "2024-01-01")).where("id % 2 = 1").count() == sum(r[0] in ("ETH", "a/b=c") and r[1] > "2024-01-01" and r[4] % 2 for r in rows())


def test_no_files(spark, tmp_path):
    assert read_npz(spark, str(tmp_path / "none"), "id long", ["symbol"]).collect() == []
    with pytest.raises(ValueError):
        write_npz(spark.createDataFrame(rows(3), SCHEMA), str(tmp_path), ["a"], {}, [], ["id"])
