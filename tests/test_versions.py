"""Versions that are written once, rows checked while they are written, replacement by generation."""

import pytest
from pyspark.sql import functions as F

from veritome.sources import versions
from veritome.sources.shared import new_path


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_of_two_writers_one_fails(spark):
    path = new_path(spark, "versions")
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    assert versions.latest(spark, path) == 0 and versions.read(spark, path) is None
    assert versions.commit(one, path, 0) == 1
    with pytest.raises(versions.Conflict):
        versions.commit(two, path, 0)
    assert versions.commit(one.unionByName(two), path, 1) == 2
    assert rows(versions.read(spark, path)) == [(1,), (2,)] and rows(versions.read(spark, path, 1)) == [(1,)]


def test_a_writer_overtaken_after_its_rows_were_written_fails_and_leaves_nothing(spark, monkeypatch):
    path = new_path(spark, "versions")
    mine = spark.createDataFrame([(1,)], "x int")
    write = versions.write_checked

    def overtaken(df, at, rules):
        told = write(df, at, rules)
        monkeypatch.setattr(versions, "write_checked", write)
        versions.commit(spark.createDataFrame([(9,)], "x int"), path, 0)
        return told

    monkeypatch.setattr(versions, "write_checked", overtaken)
    with pytest.raises(versions.Conflict):
        versions.commit(mine, path, 0)
    assert rows(versions.read(spark, path)) == [(9,)]
    at, store = versions.file_system(spark, path)
    assert len([x for x in store.listStatus(at) if "rows-" in str(x.getPath())]) == 1


def test_rows_that_break_a_rule_are_not_written(spark):
    path = new_path(spark, "versions")
    df = spark.createDataFrame([("a" * 64, "READY", 1), ("A" * 64, "READY", -1), (None, "OTHER", None)], "d string, s string, n int")
    rules = {"digest": versions.digest("d"), "state": versions.one_of("s", ("READY",)), "counter": versions.counter("n")}
    with pytest.raises(versions.Refused, match="counter: 2 of 3 rows, digest: 2 of 3 rows, state: 1 of 3 rows"):
        versions.commit(df, path, 0, rules)
    assert versions.latest(spark, path) == 0
    assert versions.commit(df.where("n = 1"), path, 0, rules) == 1
    assert versions.commit(df.where("false"), path, 1, rules) == 2 and versions.read(spark, path).count() == 0


def test_replacement_by_generation(spark):
    time = lambda x: F.lit(x).cast("timestamp")
    old, new = time("2024-01-01"), time("2026-01-01")
    entries = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 1, "x"), ("d", 1, "x")], "key string, generation long, payload string").withColumn("expires_at", F.when(F.col("key").isin("c", "d"), old).otherwise(new))
    asked = spark.createDataFrame([("a", 1, "yy"), ("b", 1, "yy"), ("c", 1, "yy"), ("n", 0, "yy"), ("m", 3, "yy")], "key string, expected_generation long, payload string").withColumn("expires_at", new)
    after, late = versions.replaced(entries, asked, time("2025-01-01"), 10, 100)
    assert rows(after.select("key", "generation", "payload")) == [("a", 2, "yy"), ("b", 2, "x"), ("c", 2, "yy"), ("n", 1, "yy")]
    assert rows(late) == [("b", 1, 2), ("m", 3, 0)]
    for entries_allowed, bytes_allowed in ((3, 100), (10, 6)):
        with pytest.raises(versions.Refused):
            versions.replaced(entries, asked, time("2025-01-01"), entries_allowed, bytes_allowed)
