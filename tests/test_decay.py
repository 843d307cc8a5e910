"""Statuses that decay by timers: without new rows, for a busy person, for rows dated ahead."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from rapport.sinks.tables import Archive
from rapport.streaming.decay import bucketed, live_statuses, status_feed
from rapport.streaming.live import status_from_days

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "person_id string, occurred_at timestamp_ntz"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    yield
    spark.conf.set(PROVIDER, was)


def wait(condition, seconds=90):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.5)
    assert condition()


def test_status_decays_without_new_rows(spark, rocks, tmp_path):
    """Buckets of two seconds, windows of 10 and 20 of them."""
    src, archive = str(tmp_path / "in"), Archive(spark, str(tmp_path / "db"))
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    rows = [("busy", now - dt.timedelta(milliseconds=i)) for i in range(3_000)] + [("few", now)] * 3 + [("", now), (None, now), ("late", None)]
    rows += [("ahead", now + dt.timedelta(seconds=30))] * 6
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(src)
    stream = live_statuses(spark.readStream.schema(SCHEMA).parquet(src), width=2, short=10, long=20)
    handle = status_feed(archive)
    seen = []

    def keep(batch, number):
        handle(batch, number)
        seen.extend(archive.spark.read.parquet(f"{archive.root}/_staging/live/batch={number}").collect())

    query = (stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(processingTime="1 second").start())
    told = lambda who: [r.detail for r in archive.rows("live_feed").where(F.col("key") == who).orderBy("batch").collect()]
    try:
        wait(lambda: told("busy")[-1:] == ["Low Activity"] and told("few")[-1:] == ["Low Activity"])
        wait(lambda: len(told("ahead")) >= 2)
    finally:
        query.stop()
    # Nothing came in after the first batch; what happened since is time.
    assert told("busy")[0] in ("Very Active", "Occasional") and len(told("busy")) >= 2 and len(told("busy")) == len(set(told("busy")))
    assert told("ahead")[0] == "No Recent Activity" and told("ahead")[1] == "Active"
    assert {r.person_id for r in seen} == {"busy", "few", "ahead"}
    # Each row equals the batch form at its time.
    daily = spark.createDataFrame(rows, SCHEMA).where("person_id <> '' AND occurred_at IS NOT NULL").groupBy(
        "person_id", F.timestamp_seconds(F.floor(F.unix_seconds(F.col("occurred_at").cast("timestamp")) / 2) * 2).cast("timestamp_ntz").alias("day")).agg(
        F.count("*").alias("n"))
    for r in seen:
        past = [(d.day, d.n) for d in daily.where(F.col("person_id") == r.person_id).collect() if d.day <= r.as_of]
        age = lambda day: (r.as_of - day).total_seconds()
        assert r.interactions == sum(n for _, n in past) and r.last_at == max((d for d, _ in past), default=None)
        assert r.n14 == sum(n for d, n in past if age(d) <= 20) and r.n60 == sum(n for d, n in past if age(d) <= 40)


def test_days_equal_the_batch_form(spark, rocks, tmp_path):
    """Whole days, old and new rows in two batches, both ladders' counts."""
    src = str(tmp_path / "in")
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    rows = [(f"p{i % 7}", now - dt.timedelta(days=(i * i) % 97, hours=i % 5)) for i in range(140)] + [("p1", now + dt.timedelta(days=3))]
    counted = spark.createDataFrame(rows, SCHEMA)
    counted.where("person_id < 'p4'").coalesce(1).write.parquet(src)
    counted.where("person_id >= 'p3'").coalesce(1).write.mode("append").parquet(src)
    doubled = counted.unionByName(counted.where("person_id = 'p3'"))
    query = (live_statuses(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)).writeStream.outputMode("update")
             .format("memory").queryName("decaying").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    daily = doubled.groupBy("person_id", F.date_trunc("day", "occurred_at").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))
    got = {}
    for r in sorted(spark.sql("select * from decaying").collect(), key=lambda r: r.as_of):
        got[r.person_id] = r
    assert set(got) == {f"p{i}" for i in range(7)}
    want = {r.person_id: r for r in status_from_days(daily, str(max(r.as_of for r in got.values()))).collect()}
    for who, r in got.items():
        assert (r.interactions, r.n14, r.n60, r.last_at, r.status) == tuple(want[who][c] for c in ("interactions", "n14", "n60", "last_at", "status"))


def test_a_busy_person_is_added_up_before_the_shuffle(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame([("a", now)] * 500 + [("b", now)], SCHEMA).repartition(4)
    got = bucketed(rows).collect()
    assert sum(r.n for r in got if r.person_id == "a") == 500 and len(got) <= 8


def test_needs_the_right_state_store(spark):
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            live_statuses(spark.createDataFrame([], SCHEMA))
    finally:
        spark.conf.set(PROVIDER, was)
