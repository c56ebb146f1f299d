import gzip
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.factors import book_columns
from tidemark.sources import raw, tables


def snapshot_file(root, symbol="ABCUSDT", date="2024-01-02"):
    path = root / symbol / "book_snapshot_25"
    path.mkdir(parents=True)
    names = book_columns()
    us = 1_704_153_600_000_000
    lines = ["exchange,timestamp," + ",".join(names)]
    for k, t in enumerate([us, us + 20_000, us + 20_000, us + 60_000]):
        lines.append(f"x,{t}," + ",".join(str(k + i / 100) for i in range(100)))
    (path / f"binance-futures_book_snapshot_25_{date}_{symbol}.csv.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    return us


def test_snapshots(spark, tmp_path):
    us = snapshot_file(tmp_path)
    df = raw.load_snapshot(spark, str(tmp_path), "ABCUSDT", "2024-01-02")
    rows = df.orderBy("ts").collect()
    assert [r.timestamp - us for r in rows] == [0, 20_000, 60_000]
    assert rows[1]["asks[0].price"] == 2.0  # of equal times the last line
    grid = raw.load_snapshot(spark, str(tmp_path), "ABCUSDT", "2024-01-02", subsample="20ms").orderBy("ts").collect()
    assert [r["asks[0].price"] for r in grid] == [0.0, 2.0, 2.0, 3.0]
    two = raw.load_snapshot(spark, str(tmp_path), "ABCUSDT", "2024-01-02", columns=["bids[3].amount"], start=F.lit("2024-01-02 00:00:00.02").cast("timestamp_ntz"))
    assert two.count() == 2 and "bids[3].amount" in two.columns and "asks[0].price" not in two.columns
    with pytest.raises(FileNotFoundError):
        raw.load_snapshot(spark, str(tmp_path), "ABCUSDT", "2024-01-03")
    both = ["ABCUSDT", "NOUSDT"]
    assert raw.symbols_with_snapshots(spark, str(tmp_path), both, "2024-01-02", "skip") == ["ABCUSDT"]
    for day, how in (("2024-01-02", "raise"), ("2024-01-03", "skip")):
        with pytest.raises(FileNotFoundError):
            raw.symbols_with_snapshots(spark, str(tmp_path), both, day, how)


def test_volatility_files(spark, tmp_path):
    (tmp_path / "ABCUSDT").mkdir()
    data = np.zeros(5, dtype=[("timestamp", "i8"), *[(c, "f8") for c in raw.VOL_COLUMNS]])
    data["timestamp"] = 1_704_153_600_000_000_000 + np.arange(5) * 20_000_000
    data["vol_5m"] = np.arange(5)
    out = io.BytesIO()
    np.savez(out, data=data)
    (tmp_path / "ABCUSDT" / "2024-01-02_volatility.npz").write_bytes(out.getvalue())
    vol = raw.ingest_volatility(spark, f"{tmp_path}/*/*_volatility.npz")
    assert {(r.symbol, str(r.date)) for r in vol.collect()} == {("ABCUSDT", "2024-01-02")} and vol.count() == 5
    grid = raw.align_volatility(vol, "40ms", ["symbol", "date"]).orderBy("ts_grid").collect()
    assert [r.vol_5m for r in grid] == [0.0, 2.0, 4.0]
    with pytest.raises(ValueError):
        raw.align_volatility(vol.where("vol_5m <> 2"), "20ms", ["symbol", "date"])


def test_nanosecond_grid(spark):
    ns = 1_704_153_600_000_000_000
    vol = spark.createDataFrame([("a", ns + k, float(k)) for k in (0, 1, 20_000_000, 20_000_001)], "symbol string, timestamp long, vol_5m double")
    got = {r.ts_grid.microsecond: r.vol_5m for r in raw.align_volatility(vol, "20ms", ["symbol"], check=False).collect()}
    assert got == {0: 0.0, 20_000: 20_000_000.0, 40_000: 20_000_001.0}
    with pytest.raises(ValueError):  # uneven by a nanosecond
        raw.align_volatility(vol.where("vol_5m in (0, 20000000)").unionAll(vol.where("vol_5m = 20000001").withColumn("timestamp", F.col("timestamp") + 20_000_000)), "20ms", ["symbol"])


def test_snapshots_of_other_column_order(spark, tmp_path):
    names = book_columns()
    for name, order in (("a", names), ("b", names[::-1])):
        (tmp_path / f"{name}.csv").write_text(",".join(["timestamp", *order]) + "\n" + ",".join(["1000", *[str(names.index(c)) for c in order]]) + "\n")
    rows = raw.read_snapshots(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()
    assert len(rows) == 2 and all(r["bids[24].amount"] == names.index("bids[24].amount") and r["asks[0].price"] == 0 for r in rows)


def test_one_header_for_all_files_is_checked(spark, tmp_path):
    names = book_columns()
    for name, order in (("a", names), ("b", names), ("c", names[::-1])):
        (tmp_path / f"{name}.csv").write_text(",".join(["timestamp", *order]) + "\n" + ",".join(["1000", *[str(names.index(c)) for c in order]]) + "\n")
    files = [str(tmp_path / f"{n}.csv") for n in "abc"]
    assert raw.read_snapshots(spark, files[:2], ["bids[24].amount"], same_header=True).count() == 2
    with pytest.raises(Exception, match="header"):
        raw.read_snapshots(spark, files, same_header=True).collect()


def test_result_files_and_features(spark, tmp_path):
    for name, d in (("AAA", 1.0), ("BBB", 0.5)):
        spark.createDataFrame([(0.0, d), (1.0, 1 + d)], "y_true double, y_pred double").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    got = tables.evaluate_files(spark, [str(tmp_path)]).collect()
    assert [(r.symbol, r.rmse) for r in got] == [("BBB", 0.5), ("AAA", 1.0)]
    found = tables.read_features(spark, {"y_pred": f"{tmp_path}/AAA", "gone": f"{tmp_path}/CCC"}, ["y_true"])
    assert list(found) == ["y_pred"]


def test_previous_day_tail(spark, tmp_path):
    import datetime as dt

    rows = [(dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, h), h) for h in range(4)]
    tables.write_table(spark.createDataFrame(rows, "date date, block_start timestamp_ntz, x int"), str(tmp_path), "blocks")
    assert [t.hour for t in tables.previous_day_tail(spark, str(tmp_path), "2024-01-02", 2)] == [2, 3]
    assert tables.previous_day_tail(spark, str(tmp_path), "2024-01-05", 2) == []


def frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x long").withColumn("date", F.col("ts").cast("date"))


def test_tables_overwrite_and_skip_by_partition(spark, tmp_path):
    import datetime as dt

    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    root = str(tmp_path)
    tables.write_table(frame(spark, [("a", at(1), 1), ("b", at(1), 2), ("a", at(2), 3)]), root, "aligned")
    tables.write_table(frame(spark, [("a", at(1), 10)]), root, "aligned")  # replaces one partition
    got = lambda: sorted(r.x for r in tables.read_table(spark, root, "aligned").collect())
    assert got() == [2, 3, 10]
    tables.write_table(frame(spark, [("a", at(1), 99), ("c", at(2), 4)]), root, "aligned", mode="skip")
    spark.catalog.refreshByPath(root)
    assert got() == [2, 3, 4, 10]
    assert sorted(r.x for r in tables.read_aligned(spark, root, ["a"], ["2024-01-01"], ["x"]).collect()) == [10]
    with pytest.raises(FileNotFoundError):
        tables.read_aligned(spark, root, ["zz"])
    assert [str(d) for d in tables.list_partitions(spark, root, "aligned", "2024-01-01")] == ["2024-01-01"]
    plan = tables.read_table(spark, root, "aligned", where=F.col("date") == F.lit("2024-01-02").cast("date"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    own = tables.read_table(spark, root, "aligned")
    part, full = tables.read_history(own, F.lit("2024-01-02").cast("timestamp_ntz"), "1d", check=True)
    assert part.count() == 2 and full
    both = tables.read_results(spark, [f"{root}/aligned"])
    assert both.count() == 4 and "pred_file" in both.columns
    assert tables.feature_columns(own, target="x") == []


def test_json_and_lists(spark, tmp_path):
    tables.write_json(spark, {"a": 1, "p": tmp_path}, str(tmp_path / "c"))
    assert tables.read_json(spark, str(tmp_path / "c"))["a"] == 1
    assert tables.symbols_of_list("# all\n- BUSDT  # one\n- 'AUSDT'\n- BUSDT\nother\n- X\n") == ["BUSDT", "AUSDT"]
    assert tables.chunks(list(range(5)), 2) == [[0, 1], [2, 3], [4]]
    assert tables.named_groups(["a"]) == {"group_00": ["a"]}
    assert tables.table_path("/r/", "blocks", " 1H") == "/r/blocks_1h"
