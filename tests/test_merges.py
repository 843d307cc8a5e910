"""Merging people over a stored archive: labels, re-pointed tables, decisions, and what is imported afterwards."""

import os

import numpy as np
from pyspark.sql import functions as F

from rapport.sinks import people as PL
from rapport.sinks.tables import Archive
from rapport.streaming.ingest import run_ingest, text_index

AS_OF = "2024-01-10 00:00:00"
PAIRS = "old_id string, new_id string"


def put(folder, name, data):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(data)


def later(keeper, pairs):
    """One more version of merges over {id: keeper}, by hand."""
    now = lambda i: keeper.get(i, i)
    links = {(now(a), now(b)) for a, b in pairs} - {(now(a), now(a)) for a, _ in pairs}
    links = {(a, b) for a, b in links if a != b}
    nodes = {x for link in links for x in link}
    group = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            low = min(group[a], group[b])
            group[a] = group[b] = low
    out = dict(keeper)
    for label in set(group.values()):
        members = {n for n in nodes if group[n] == label}
        olds = {a for a, _ in links}
        head = min(members - olds or {b for a, b in links if b in members})
        for i in {*keeper, *nodes}:
            if now(i) in members and i != head:
                out[i] = head
            if i == head:
                out.pop(i, None)
    return out


def test_labels_grow_version_by_version(spark):
    """Random merges in several versions; each version touches the labels only through its own pairs."""
    rng = np.random.default_rng(3)
    known = spark.createDataFrame([], "id string, person_id string")
    keeper = {}
    for size in (6, 1, 8, 5):
        # No cycles within a version: there the keeper is a matter of definition.
        pairs = [tuple(f"p{x:02d}" for x in sorted(rng.choice(40, 2, replace=False).tolist(), reverse=True)) for _ in range(size)]
        changed = PL.extend_labels(known, spark.createDataFrame(pairs, PAIRS)).collect()
        want = later(keeper, pairs)
        assert {(r.id, r.person_id) for r in changed} == {(i, k) for i, k in want.items() if keeper.get(i) != k}
        assert len(changed) == len({r.id for r in changed})
        keeper = want
        known = spark.createDataFrame(list(want.items()), "id string, person_id string")
    assert PL.extend_labels(known, spark.createDataFrame(pairs, PAIRS)).isEmpty()          # said again: nothing new


def test_merge_people_of_an_archive(spark, tmp_path):
    inbox, root, check = str(tmp_path / "in"), str(tmp_path / "db"), str(tmp_path / "cp")
    put(inbox, "whatsapp/a_chat.txt", "02/01/24, 8:42 PM - Alice Doe: hi there\n02/01/24, 8:43 PM - Bob Roe: yes\n"
                                      "02/01/24, 8:44 PM - Carla Poe: no\n")
    put(inbox, "whatsapp/b_chat.txt", "03/01/24, 8:42 PM - AliceDoe: robotics\n03/01/24, 8:43 PM - Me: ok\n")
    put(inbox, "calendar/c.csv", "title,start,participants\nSync,2024-02-01T10:00:00,Alice Doe; AliceDoe; Bob Roe\n")
    archive = Archive(spark, root)
    run_ingest(spark, inbox, root, check, AS_OF).awaitTermination()
    ids = {r.display_name: r.person_id for r in archive.read("people").collect()}
    assert {"Alice Doe", "AliceDoe", "Bob Roe", "Carla Poe"} <= set(ids)

    # The import itself suggests the duplicate; accepting it merges the two.
    pair = {ids["Alice Doe"], ids["AliceDoe"]}
    waiting = [r for r in PL.open_suggestions(archive).collect() if r.person_b_id]
    assert len(waiting) == 1 and {waiting[0].person_a_id, waiting[0].person_b_id} == pair
    keeper = waiting[0].person_a_id
    gone = waiting[0].person_b_id
    profile = lambda who: {r.person_id: r for r in PL.profiles(archive).collect()}.get(who)
    before = profile(keeper).interaction_count, profile(gone).interaction_count
    moves = PL.decide(archive, spark.createDataFrame([(waiting[0].id, True)], "id string, merge boolean"), 0, AS_OF)
    moved = {r["name"]: r.moved for r in moves.collect()}
    raw = archive.read("messages").where(F.col("person_id") == gone).count()
    assert moved["messages"] == raw > 0 and moved["calendar"] == 1 and moved["notes"] == 0
    assert moved["events"] == archive.read("events").where(F.col("person_id") == gone).count()
    assert PL.open_suggestions(archive).where("person_b_id IS NOT NULL").isEmpty()

    # The index was kept up by the import; questions about the keeper find what the other one wrote.
    index = text_index(archive)
    merges = PL.labels(archive).select(F.col("id").alias("old_id"), F.col("person_id").alias("new_id"))
    asked = spark.createDataFrame([(1, "anything about robotics?", keeper)], "qid int, question string, person_id string")
    hits = index.search(asked, 5, merges).collect()
    assert len(hits) == 1 and hits[0].id in {r.id for r in archive.read("memories").where("text LIKE '%robotics%'").collect()}
    assert index.size().first().docs == archive.read("memories").count()

    # Every table reads with the keeper, and the attendee's list holds them once.
    for name in ("messages", "events", "memories", "identities"):
        assert PL.current(archive, name).where(F.col("person_id") == gone).isEmpty(), name
    assert gone not in {r.person_id for r in PL.current(archive, "people").collect()}
    assert sorted(PL.current(archive, "calendar").first().person_ids) == sorted({keeper, ids["Bob Roe"]})
    absorbed = next(name for name, i in ids.items() if i == gone)
    assert (keeper, absorbed) in {tuple(r) for r in PL.current(archive, "aliases").collect()}
    assert profile(gone) is None
    after = profile(keeper)
    # Both attended the meeting; each keeps the ledger row it had.
    assert after.interaction_count == sum(before)

    # Said again, or run again under its number: nothing moves twice.
    again = spark.createDataFrame([(gone, keeper)], PAIRS)
    assert {r.moved for r in PL.merge(archive, again, 1, AS_OF).collect()} == {0}
    assert {r["name"]: r.moved for r in PL.merge(archive, again, 0, AS_OF).collect()} == moved

    # A third person swallows the keeper; the first label follows without being named.
    PL.merge(archive, spark.createDataFrame([(keeper, ids["Carla Poe"])], PAIRS), 2, AS_OF)
    assert {r.id: r.person_id for r in PL.labels(archive).collect()} == {gone: ids["Carla Poe"], keeper: ids["Carla Poe"]}

    # New files of a merged name go to the keeper, and bring nobody back.
    put(inbox, "whatsapp/c_chat.txt", f"04/01/24, 8:42 PM - {absorbed}: again\n04/01/24, 8:43 PM - Bob Roe: yes\n")
    run_ingest(spark, inbox, root, check, AS_OF).awaitTermination()
    newest = archive.read("messages").where("content = 'again'").first()
    assert newest.person_id == ids["Carla Poe"]
    assert {r.person_id for r in PL.current(archive, "people").collect()} == set(ids.values()) - {gone, keeper}
    assert index.size().first().docs == archive.read("memories").count() and len(index.live()) == 2
    assert profile(ids["Carla Poe"]).interaction_count == PL.current(archive, "events").where(F.col("person_id") == ids["Carla Poe"]).count()


def test_moved_rows_travel_once(spark, monkeypatch):
    """every attendee of every meeting was shuffled to the merges with the meeting's id, and those found once more."""
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    changed = spark.createDataFrame([("p1", "p0"), ("p2", "p0")], "id string, person_id string")
    tables = {
        "notes": spark.createDataFrame([("n1", "p1"), ("n2", "p1"), ("n3", "p9"), ("n4", None)], "id string, person_id string"),
        "voice": spark.createDataFrame([("v1", "p9")], "id string, person_id string"),
        "calendar": spark.createDataFrame([("c1", ["p1", "p2"]), ("c2", ["p9", "p2"]), ("c2", ["p1"]), ("c3", ["p9"]), ("c4", None)],
                                          "id string, person_ids array<string>")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for people in (400_000, 1):
            monkeypatch.setattr(PL, "BROADCAST_PEOPLE", people)
            assert dict(PL.moved_rows(tables, changed).collect()) == {"notes": 2, "voice": 0, "calendar": 2}
        monkeypatch.setattr(PL, "BROADCAST_PEOPLE", 400_000)
        plan = PL.moved_rows({"calendar": tables["calendar"]}, changed)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
