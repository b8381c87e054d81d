"""Erasure that really takes rows out, leaves other files alone, and can be undone from an archive."""

import os

import pytest

from tidemark.sources.snapshots import Snapshot


def files(path):
    return {os.path.join(d, f): (os.stat(os.path.join(d, f)).st_ino, os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(k % 40 if k % 7 else None, f"note {k}", k) for k in range(200)], "who long, note string, n long")


def test_erase_and_restore(spark, people, tmp_path):
    at, archive = f"{tmp_path}/t", f"{tmp_path}/archive"
    table = Snapshot(spark, at)
    table.create(people, "who", 16)
    everything, before = rows(people), files(at)
    assert rows(table.read()) == everything
    with pytest.raises(ValueError):
        table.create(people, "who")
    subjects = spark.createDataFrame([(3,), (3,), (None,), (12345,)], "id long")
    expect_gone = [r for r in everything if r[0] == 3]
    assert table.erase(subjects, archive) == len(expect_gone) > 0
    assert rows(table.read()) == [r for r in everything if r[0] != 3]
    after = files(at)
    assert all(after[f] == before[f] for f in before.keys() & after.keys()) and len(before.keys() & after.keys()) >= 14  # all buckets but one
    import pyarrow.parquet as pq

    assert all(3 not in pq.ParquetFile(f).read().column("who").to_pylist() for f in after)  # the rows are gone from the disk
    assert rows(spark.read.parquet(archive)) == expect_gone
    assert table.restore(archive) == len(expect_gone) and not os.path.exists(archive)
    assert rows(table.read()) == everything and Snapshot(spark, at).manifest()[0] == 3


def test_nothing_to_erase_changes_nothing(spark, people, tmp_path):
    table = Snapshot(spark, f"{tmp_path}/t")
    table.create(people, "who", 4)
    before = files(tmp_path)
    assert table.erase(spark.createDataFrame([(999,)], "id long")) == 0 and files(tmp_path) == before
    everyone = people.select("who").distinct()
    assert table.erase(everyone) == people.where("who is not null").count() and {r[0] for r in rows(table.read())} == {None}


def test_of_two_writers_one_fails(spark, people, tmp_path):
    table = Snapshot(spark, f"{tmp_path}/t")
    table.create(people, "who", 4)
    number, content = table.manifest()
    table._swap(number + 1, content)
    with pytest.raises(Exception, match="exist"):
        table._swap(number + 1, content)
    assert rows(table.read()) == rows(people)


def test_empty_tables(spark, people, tmp_path):
    table = Snapshot(spark, f"{tmp_path}/t")
    table.create(people.limit(0), "who", 4)
    assert table.read().count() == 0 and table.erase(people.select("who")) == 0
    with pytest.raises(ValueError):
        Snapshot(spark, f"{tmp_path}/none").read()
