"""Tables that change one version at a time."""

import pytest
from pyspark.sql import functions as F

from kbspark.operators import versions


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, data):
    return spark.createDataFrame(data, "id long, kind string, value string, day string")


FIRST = [(1, "a", "x", "d1"), (2, "a", "x", "d1"), (3, "b/ c=%", "x", "d1"), (4, "b/ c=%", "x", "d2"), (5, None, "x", "d2"), (6, "c", "x", "d3")]


def test_upsert_keeps_other_partitions_and_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.upsert(table(spark, FIRST), path, ["id"], ["day", "kind"]) == 1
    assert rows(versions.read(spark, path).select("id", "kind", "value", "day")) == sorted(FIRST, key=repr)
    before = versions.manifest(spark, path)
    new = [(1, "a", "new", "d1"), (9, "b/ c=%", "new", "d2"), (5, None, "new", "d2"), (7, "z", "new", "d9")]
    assert versions.upsert(table(spark, new), path, ["id"], ["day", "kind"]) == 2
    want = [r for r in FIRST if r[0] not in (1, 5)] + new
    assert rows(versions.read(spark, path).select("id", "kind", "value", "day")) == sorted(want, key=repr)
    assert rows(versions.read(spark, path, 1).select("id", "kind", "value", "day")) == sorted(FIRST, key=repr)
    after = versions.manifest(spark, path)
    assert after.parts["day=d3/kind=c"] == before.parts["day=d3/kind=c"]
    assert versions.expire(spark, path) == 0 and versions.versions(spark, path) == [2]  # the first folder still has partitions in use
    assert rows(versions.read(spark, path).select("id", "kind", "value", "day")) == sorted(want, key=repr)


def test_a_change_that_fails_midway_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.upsert(table(spark, FIRST), path, ["id"], ["day"])
    broken = table(spark, [(1, "a", "new", "d1"), (4, "b", "new", "d2")]).repartition(2, "day")
    broken = broken.withColumn("value", F.when(F.col("day") == "d2", F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        versions.upsert(broken, path, ["id"], ["day"])
    assert versions.versions(spark, path) == [1]
    assert rows(versions.read(spark, path).select("id", "kind", "value", "day")) == sorted(FIRST, key=repr)
    versions.upsert(table(spark, [(1, "a", "new", "d1")]), path, ["id"], ["day"])
    assert versions.expire(spark, path) >= 1  # what the failed change left
    assert versions.read(spark, path).where("value = 'new'").count() == 1 and versions.read(spark, path).count() == len(FIRST)


def test_two_writers_of_one_version_do_not_both_succeed(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.append(table(spark, FIRST), path, [])
    now = versions.manifest(spark, path)
    versions.append(table(spark, FIRST[:1]), path, [])
    now.version += 1
    with pytest.raises(versions.Conflict):
        versions._commit(spark, path, now)
    assert versions.read(spark, path).count() == len(FIRST) + 1


def test_repeated_batches_compaction_and_deletes(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in range(6):
        part = table(spark, [(batch, "a", "x", "d1"), (batch, "a", "x", "d1"), (batch // 2, "b", "x", "d2")]).repartition(3)
        versions.append(part, path, ["day"], mark=("log", batch))
        versions.append(part, path, ["day"], mark=("log", batch))  # a batch that is run again
    assert versions.read(spark, path).count() == 18
    versions.compact(spark, path, {"day=d1", "day=none"}, ["id", "kind"])
    now = versions.manifest(spark, path)
    assert len(now.parts["day=d1"]) == 1 and len(now.parts["day=d2"]) == 6
    got = versions.read(spark, path)
    assert got.where("day = 'd1'").count() == 6 and got.where("day = 'd2'").count() == 6
    files = {f for f in got.where("day = 'd1'").inputFiles() if "day=d1" in f}
    assert len([f for f in files if now.parts["day=d1"][0] in f]) == 1
    versions.delete(spark, path, spark.createDataFrame([(2,), (77,)], "id long"), ["id"])
    assert versions.read(spark, path).where("id = 2").count() == 0
    versions.delete(spark, path, table(spark, FIRST).select("id").unionByName(spark.range(100)), ["id"])
    assert versions.read(spark, path).count() == 0


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.upsert(table(spark, []), path, ["id"], ["day"])
    assert versions.read(spark, path).count() == 0
    versions.upsert(table(spark, FIRST), path, ["id"], ["day"])
    versions.upsert(table(spark, []), path, ["id"], ["day"])
    assert versions.read(spark, path).count() == len(FIRST)
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "none"))
