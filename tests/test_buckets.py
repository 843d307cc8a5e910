"""Profiles kept by deltas equal those over the whole ledger, and only touched parts are read."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rapport.operators import buckets as B
from rapport.operators import profiles as P
from rapport.sinks import people as PL
from rapport.sinks.tables import Archive, slot_of

NOW = dt.datetime(2024, 3, 20, 13, 30, 0, 250)
PEOPLE = "person_id string, display_name string, aliases array<string>, is_user boolean, created_at timestamp_ntz"
EVENTS = "id string, person_id string, kind string, source string, occurred_at timestamp_ntz, summary string, record_id string"
MEMORIES = ("id string, person_id string, kind string, source string, occurred_at timestamp_ntz, text string, record_id string, "
            "citation string, topics array<string>")
CALENDAR = ("id string, title string, starts_at timestamp_ntz, ends_at timestamp_ntz, location string, description string, "
            "participants array<string>, person_ids array<string>, path string")


def moments(rng):
    """Times around every edge of both windows, exact hits and a microsecond beside them included."""
    day, tick = dt.timedelta(days=1), dt.timedelta(microseconds=1)
    for edge in (NOW, NOW - 14 * day, NOW - 60 * day):
        midnight = edge.replace(hour=0, minute=0, second=0, microsecond=0)
        yield from (edge, edge - tick, edge + tick, midnight, midnight - tick, midnight + day, midnight + day - tick)
    for _ in range(80):
        yield NOW - day * rng.uniform(-5, 90)
    yield None


def rows(spark):
    rng = random.Random(5)
    people = [(f"p{i}", f"Person {chr(65 + i)}{'x' * i}", ["robotics"] if i == 1 else None, False, None) for i in range(6)]
    events, memories = [], []
    for who in ["p0", "p1", "p2", "p3", None, ""]:
        for n, at in enumerate(moments(rng)):
            key = f"{who}-{n}"
            events.append((key, who, "message", rng.choice(["whatsapp", "email", "", None]), at, "s", key))
            memories.append((key, who, "message", "whatsapp", at, "t", key, "c",
                             rng.choice([None, [], ["robotics"], ["gardens", "robotics"], ["gardens", "the"]])))
    calendar = [("c1", "Past", NOW - dt.timedelta(days=1), None, None, None, None, ["p0"], None),
                ("c2", "Now", NOW, None, None, None, None, ["p0", "p1"], None),
                ("c3", "Next", NOW + dt.timedelta(days=40), None, None, None, None, ["p0"], None)]
    return (spark.createDataFrame(people, PEOPLE), spark.createDataFrame(events, EVENTS),
            spark.createDataFrame(memories, MEMORIES), spark.createDataFrame(calendar, CALENDAR))


def plain(df):
    return {r.person_id: r.asDict(recursive=True) for r in df.collect()}


@pytest.mark.parametrize("as_of", [NOW, NOW.replace(hour=0, minute=0, second=0, microsecond=0)])
def test_equal_to_the_whole_ledger(spark, as_of):
    people, events, memories, calendar = rows(spark)
    part = lambda df, i: df.where(F.pmod(F.hash("id"), F.lit(3)) == i)
    activity = B.activity_buckets(part(events, 0)).unionByName(B.activity_buckets(part(events, 1))).unionByName(
        B.activity_buckets(part(events, 2)))
    topics = B.topic_buckets(part(memories, 0)).unionByName(B.topic_buckets(memories.where(F.pmod(F.hash("id"), F.lit(3)) > 0)))
    got = plain(B.bucket_profiles(people, activity, topics, B.at_edges(events, as_of), B.at_edges(memories, as_of), calendar, as_of))
    want = plain(P.profiles(people, events, memories, calendar, as_of))
    assert got == want and got["p0"]["interactions_60d"] > got["p0"]["interactions_14d"] > 0
    assert "robotics" not in [t["topic"] for t in got["p1"]["topics"]]


def test_empty(spark):
    people, events, memories, calendar = rows(spark)
    none = lambda df: df.limit(0)
    got = plain(B.bucket_profiles(people, B.activity_buckets(none(events)), B.topic_buckets(none(memories)), none(events),
                                  none(memories), none(calendar), NOW))
    assert got == plain(P.profiles(people, none(events), none(memories), none(calendar), NOW)) and len(got) == 6


def test_upkeep_over_batches_and_merges(spark, tmp_path):
    people, events, memories, calendar = rows(spark)
    archive = Archive(spark, str(tmp_path / "db"))
    for batch in range(3):
        mine = lambda df: df.where(F.pmod(F.hash("id"), F.lit(3)) == batch)  # noqa: B023, E731
        archive.write("people", people if batch == 0 else people.limit(0), batch)
        archive.write("calendar", calendar if batch == 0 else calendar.limit(0), batch)
        new = archive.write("events", mine(events), batch), archive.write("memories", mine(memories), batch)
        archive.write("activity", B.activity_buckets(new[0]), batch)
        archive.write("topic_days", B.topic_buckets(new[1]), batch)
        archive.commit(batch)
    touched = spark.createDataFrame([("p0",), ("p1",)], "person_id string")
    full = lambda ids: plain(P.refresh_profiles(ids, *(PL.current(archive, n) for n in ("people", "events", "memories", "calendar")), NOW))
    kept = PL.kept_profiles(archive, touched, NOW)
    assert plain(kept) == full(touched)
    # Only the slots of the touched people and the months of the edge days are read.
    slots = {f"slot={r.s}" for r in touched.select(slot_of(F.col("person_id")).alias("s")).collect()}
    assert "slot#" in kept._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [", 1)[1]
    read = archive.of_slots("activity", [int(s.split("=")[1]) for s in slots]).select(F.input_file_name().alias("f")).distinct()
    assert all(any(f"/{s}/" in r.f for s in slots) for r in read.collect())
    # After a merge the keeper has the sums of both, under whichever id they were counted.
    PL.merge(archive, spark.createDataFrame([("p1", "p0")], "old_id string, new_id string"), 0, NOW)
    keeper = spark.createDataFrame([("p0",)], "person_id string")
    merged = plain(PL.kept_profiles(archive, keeper, NOW))
    assert merged == full(keeper) == {"p0": plain(PL.profiles(archive))["p0"]}
    assert merged["p0"]["interaction_count"] == 2 * events.where("person_id = 'p0'").count()
