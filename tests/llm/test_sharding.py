"""Sharding: contents and sizes by brute force, commits that fail on the way, writers that meet, clashing columns."""

import collections

import pytest
from pyspark.sql import functions as F

from inkwell.llm import sharding
from inkwell.llm.common import scratch

SCHEMA = "doc_id long, text string, shard string, shard_bytes long, arrival int"


def rows(n):
    return [(i if i % 7 else None, None if i % 5 == 0 else "word " * (i % 90), f"s{i % 3}", i, i % 4) for i in range(n)] + [(1, "", None, None, None)] * 2


@pytest.fixture
def store(spark):
    table = spark.createDataFrame(rows(10), SCHEMA)
    return sharding.ShardStore.create(spark, scratch(spark), table.schema, target_bytes=8192, fan_in=3)


def content(df):
    return collections.Counter(tuple(r[:5]) for r in df.collect())


def test_contents_and_tiers(spark, store):
    want = collections.Counter()
    for k in range(6):
        batch = rows(40 + 60 * k)
        store.append(spark.createDataFrame(batch, SCHEMA).repartition(3))
        want.update(batch)
        assert content(store.read()) == want
    before = {r.path: r.bytes for r in store.manifest().collect()}
    last = store.version()
    store.compact()
    assert content(store.read()) == want == content(store.read(last))
    alive = store.manifest().collect()
    assert len(alive) < len(before) and sum(r.rows for r in alive) == sum(want.values())
    for tier in {r.tier for r in alive if r.tier > 0}:
        same = [r.bytes for r in alive if r.tier == tier]
        assert len(same) < store.fan_in and max(same) <= store.fan_in * min(same) * 1.01
    beside = store.read().select("_shard", "_shard_bytes").distinct().collect()
    assert {(r[0], r[1]) for r in beside} == {(r.path.rsplit("/", 1)[1], r.bytes) for r in alive if r.rows}


def test_arrivals(spark, store):
    table = spark.createDataFrame(rows(200), SCHEMA)
    assert store.append_arrivals(table, F.pmod(F.hash("shard_bytes"), F.lit(4)), 4) == 4
    assert content(store.read()) == collections.Counter(rows(200)) and store.read(0).count() == 0


def test_a_commit_that_dies(spark, store):
    store.append(spark.createDataFrame(rows(10), SCHEMA))
    store._staged(store.version() + 1, store.manifest())  # written, never published
    assert store.version() == 1 and content(store.read()) == collections.Counter(rows(10))
    assert store.append(spark.createDataFrame(rows(5), SCHEMA)) == 2
    assert content(store.read()) == collections.Counter(rows(10)) + collections.Counter(rows(5))


def test_two_writers(spark, store):
    """Both have read version 0 and staged version 1: one holds it, the other is told and comes next."""
    other = sharding.ShardStore(spark, store.root, store.schema, 8192, 3)
    mine, theirs = (w._staged(1, spark.createDataFrame([(f"p{i}", 1, 1, 0)], sharding.SHARDS)) for i, w in enumerate((store, other)))
    assert other._publish(theirs, 1) and not store._publish(mine, 1)
    assert [r.path for r in store.manifest(1).collect()] == ["p1"] and store.version() == 1
    assert store.append(spark.createDataFrame(rows(5), SCHEMA)) == 2
    assert {r.path for r in other.manifest().collect()} >= {"p1"}


def test_compaction_of_shards_that_are_gone(spark, store):
    for _ in range(3):
        store.append(spark.createDataFrame(rows(20), SCHEMA).coalesce(1))
    paths = [r.path for r in store.manifest().collect()]
    want, version = content(store.read()), store.compact()
    assert not store._replace(paths, spark.createDataFrame([("late", 1, 1, 0)], sharding.SHARDS))
    assert store.version() == version and content(store.read()) == want


def test_second_store_and_empty_rows(spark, store):
    with pytest.raises(FileExistsError):
        sharding.ShardStore.create(spark, store.root, store.schema)
    assert store.append(spark.createDataFrame([], SCHEMA)) == 1 and store.read().count() == 0
    assert store.compact() >= 1
