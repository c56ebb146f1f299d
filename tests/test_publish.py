import datetime as dt

import pytest

from tidemark.operators.watch import watch_even
from tidemark.sources import publish as pub
from tidemark.sources.publish import done_partitions, publish, read_published


def rows(spark, days=3, value=0.0, step=10):
    made = [(dt.date(2024, 1, 1 + d), s, dt.datetime(2024, 1, 1 + d) + dt.timedelta(seconds=step * k), value + k) for d in range(days) for s in ("A", "b/c", "x=y z") for k in range(20)]
    return spark.createDataFrame(made, "date date, symbol string, ts timestamp_ntz, x double")


def test_published_rows_are_the_written_ones(spark, tmp_path):
    root = str(tmp_path)
    assert len(publish(rows(spark), root, "aligned")) == 9
    got = read_published(spark, root, "aligned").select("date", "symbol", "ts", "x")
    assert got.exceptAll(rows(spark)).count() == 0 and got.count() == 180
    assert len(publish(rows(spark, 1, 5.0), root, "aligned")) == 3  # replaced
    assert read_published(spark, root, "aligned").where("x >= 20").count() == 3 * 5
    one = read_published(spark, root, "aligned", keep=lambda v: v["symbol"] == "b/c" and v["date"] == "2024-01-02")
    assert one.count() == 20 and len(one.inputFiles()) == 1
    assert not [p for n in ("_staging", "_old") for p in (tmp_path / "aligned" / n).glob("*")]


def test_a_killed_write_is_not_taken_as_done_and_goes_on(spark, tmp_path, monkeypatch):
    root, moves = str(tmp_path), []
    real = pub.Folder.move

    def dies(self, source, target):
        if len(moves) == 4:
            raise KeyboardInterrupt
        moves.append(target)
        real(self, source, target)

    monkeypatch.setattr(pub.Folder, "move", dies)
    with pytest.raises(KeyboardInterrupt):
        publish(rows(spark), root, "aligned")
    monkeypatch.setattr(pub.Folder, "move", real)
    assert len(done_partitions(spark, root, "aligned")) == 4
    assert read_published(spark, root, "aligned").count() == 80
    assert len(publish(rows(spark), root, "aligned", "skip")) == 5  # only the others are written
    assert read_published(spark, root, "aligned").count() == 180
    assert publish(rows(spark), root, "aligned", "skip") == []


def test_moved_but_not_marked_is_written_again(spark, tmp_path):
    root = str(tmp_path)
    publish(rows(spark), root, "aligned")
    mark = next((tmp_path / "aligned" / "_done").glob("date*"))
    mark.unlink()
    assert read_published(spark, root, "aligned").count() == 160
    assert len(publish(rows(spark, value=1.0), root, "aligned", "skip")) == 1
    assert read_published(spark, root, "aligned").where("x = 20").count() == 1


def test_a_failing_check_publishes_nothing(spark, tmp_path):
    root = str(tmp_path)
    df, verify = watch_even(rows(spark, 1).where("x <> 7"), "10s", ["symbol"])
    with pytest.raises(ValueError):
        publish(df, root, "aligned", checks=(verify,))
    with pytest.raises(FileNotFoundError):
        read_published(spark, root, "aligned")
    df, verify = watch_even(rows(spark, 1), "10s", ["symbol"])
    assert len(publish(df, root, "aligned", checks=(verify,))) == 3


def test_no_rows(spark, tmp_path):
    assert publish(rows(spark).where("x < 0"), str(tmp_path), "aligned") == []
    with pytest.raises(ValueError):
        publish(rows(spark), str(tmp_path), "metrics")
