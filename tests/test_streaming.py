"""Folder feed end to end, and live views equal to their batch form."""

import datetime as dt
import os
import time

from pyspark.sql import functions as F

from rapport.operators import ledger as L
from rapport.sinks.tables import Archive
from rapport.streaming.ingest import linked_media, run_ingest
from rapport.streaming.live import activity_windows, media_with_messages, split_future, status_changes, without_repeats

AS_OF = "2024-01-10 00:00:00"
CHAT = "02/01/24, 8:42 PM - Alice Doe: hi\n02/01/24, 8:43 PM - Me: IMG-1-WA1.jpg (file attached)\n"


def put(folder, name, data):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def test_folder_feed(spark, tmp_path):
    inbox, root, check = str(tmp_path / "in"), str(tmp_path / "db"), str(tmp_path / "cp")
    put(inbox, "whatsapp/a_chat.txt", CHAT)
    put(inbox, "whatsapp/copy_chat.txt", CHAT)
    put(inbox, "contacts/c.csv", "name,email,phone\nAlice Doe,alice@x.org,+1 555\n")
    put(inbox, "email/m.eml", "From: Alice <alice@x.org>\nSubject: plan\nDate: Tue, 02 Jan 2024 03:04:05 +0000\n\nbody\n")
    put(inbox, "calendar/c.csv", "title,start,participants\nSync,2024-02-01T10:00:00,Alice Doe; Bob Roe\n")
    put(inbox, "bad.json", "{not json")
    put(inbox, "b.crdownload", "x")
    archive = Archive(spark, root)
    run_ingest(spark, inbox, root, check, AS_OF).awaitTermination()
    names = {r.display_name for r in archive.read("people").collect()}
    assert names == {"Alice Doe", "Bob Roe"}
    assert archive.read("messages").count() == 2
    alice = archive.read("people").where("display_name = 'Alice Doe'").collect()[0].person_id
    assert {r.person_id for r in archive.read("messages").collect()} == {alice}
    assert archive.read("emails").collect()[0].person_id == alice
    assert {(r.kind, r.n) for r in archive.read("events").groupBy("kind").agg(F.count("*").alias("n")).collect()} == {
        ("message", 2), ("email", 1), ("meeting", 2)}
    jobs = {os.path.basename(r.path): r.status for r in archive.read("jobs").collect()}
    assert jobs["bad.json"] == "FAILED" and jobs["a_chat.txt"] == "COMPLETED" and jobs["copy_chat.txt"] == "SKIPPED"
    # A window reads its months only; a batch that broke off is not there for readers.
    plan = archive.window("events", "2024-01-01 00:00:00", "2024-01-31 00:00:00")
    assert plan.count() == 3 and "PartitionFilters" in plan._jdf.queryExecution().toString()
    assert archive.window("events", "2024-02-01 00:00:00", "2024-02-28 00:00:00").count() == 2
    assert all("month=2024-01" in r.f for r in plan.select(F.input_file_name().alias("f")).collect())
    pinned = archive.snapshot()
    archive.write("people", archive.read("people").withColumn("person_id", F.lit("half")), 9)
    assert archive.read("people").where("person_id = 'half'").isEmpty() and archive.committed() == pinned.at == 0
    archive.write("people", archive.read("people").limit(0), 9)
    profile = archive.latest("profiles", ["person_id"]).where(F.col("person_id") == alice).collect()[0]
    assert profile.interaction_count == 4 and profile.upcoming_events[0].title == "Sync"

    # Second run: media arrives late, an old chat comes again under a new name.
    put(inbox, "media/IMG-1-WA1.jpg", b"\xff\xd8jpeg")
    put(inbox, "whatsapp/renamed_chat.txt", CHAT + "03/01/24, 8:00 AM - Alice Doe: new\n")
    run_ingest(spark, inbox, root, check, AS_OF).awaitTermination()
    assert archive.read("messages").count() == 3 and pinned.read("messages").count() == 2
    media = linked_media(archive).collect()[0]
    assert media.status == "LINKED" and media.person_id == alice
    assert archive.latest("profiles", ["person_id"]).where(F.col("person_id") == alice).collect()[0].interaction_count == 5

    # Both runs left their durations and row counts, a moment after they ended.
    until = time.time() + 30
    while archive.read("progress").count() < 2 and time.time() < until:
        time.sleep(0.5)
    steps = archive.rows("progress").orderBy("batch").collect()
    assert [r.batch for r in steps] == [0, 1] and {r.stream for r in steps} == {"import"}
    assert steps[0].input_rows >= 7 and steps[1].input_rows >= 2 and len({r.run_id for r in steps}) == 2
    assert all(r.batch_ms > 0 and r.steps["addBatch"] <= r.batch_ms and r.started_at for r in steps)


def test_contacts_enrich_known_people(spark, tmp_path):
    """Nicknames, handles and further names of somebody who is known, from a later file and beside new people."""
    inbox, root, check = str(tmp_path / "in"), str(tmp_path / "db"), str(tmp_path / "cp")
    archive = Archive(spark, root)
    put(inbox, "contacts/a.csv", "name,email,phone,organization,nickname,telegram\nAlice Doe,alice@x.org,,Acme,,\n")
    run_ingest(spark, inbox, root, check, AS_OF).awaitTermination()
    alice = archive.read("people").first().person_id
    put(inbox, "contacts/b.csv", "name,email,phone,organization,nickname,telegram\n"
        "Alicia Smith,Alice@X.org,+1 555 0100,,Lissy,@AliceD\nALICE DOE!,alice@x.org,,,,\nBob Roe,bob@x.org,,,Bobby,\n")
    put(inbox, "whatsapp/a_chat.txt", "02/01/24, 8:42 PM - Lissy: hi\n02/01/24, 8:43 PM - Alicia Smith: yes\n02/01/24, 8:44 PM - Bobby: no\n")
    run_ingest(spark, inbox, root, check, AS_OF).awaitTermination()
    people = {r.display_name: r.person_id for r in archive.read("people").collect()}
    assert people.keys() == {"Alice Doe", "Bob Roe"} and people["Alice Doe"] == alice
    assert sorted(tuple(r) for r in archive.read("aliases").collect()) == sorted(
        [(alice, "Alicia Smith"), (alice, "Lissy"), (people["Bob Roe"], "Bobby")])
    mine = {(r.kind, r.value) for r in archive.read("identities").where(F.col("person_id") == alice).collect()}
    assert mine == {("name", "alice doe"), ("email", "alice@x.org"), ("name", "alicia smith"), ("phone", "15550100"), ("telegram", "aliced")}
    # The chat of the same import already goes by the names the contacts brought.
    assert {r.sender_label: r.person_id for r in archive.read("messages").collect()} == {
        "Lissy": alice, "Alicia Smith": alice, "Bobby": people["Bob Roe"]}
    # The same contacts in another file add nothing.
    put(inbox, "contacts/c.csv", "name,email,phone,organization,nickname,telegram\nAlicia Smith,alice@x.org,,,Lissy,@alicED\n")
    run_ingest(spark, inbox, root, check, AS_OF).awaitTermination()
    assert archive.read("aliases").count() == 3 and archive.read("identities").where(F.col("person_id") == alice).count() == 5


def events(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"p{i % 3}", start + dt.timedelta(hours=7 * i)) for i in range(60)]
    return spark.createDataFrame(rows, "person_id string, occurred_at timestamp_ntz")


def test_live_counters_and_status_changes(spark, tmp_path):
    src, root = str(tmp_path / "ev"), str(tmp_path / "db")
    archive = Archive(spark, root)
    start = dt.datetime(2024, 1, 1)

    def run():
        stream = spark.readStream.schema("person_id string, occurred_at timestamp").parquet(src)
        q = (stream.writeStream.foreachBatch(status_changes(archive, "2024-01-20 00:00:00"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        q.awaitTermination()

    def more(n, offset):
        rows = [("a", start + dt.timedelta(days=10, minutes=offset + i)) for i in range(n)]
        spark.createDataFrame(rows, "person_id string, occurred_at timestamp").coalesce(1).write.mode("append").parquet(src)

    more(6, 0)
    run()
    more(12, 100)
    run()
    changes = [r.detail for r in archive.rows("live_feed").where("topic = 'status'").orderBy("batch").collect()]
    assert changes == ["Active", "Very Active"]


def test_windows_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "ev")
    rows = events(spark).withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    rows.write.parquet(src)
    stream = spark.readStream.schema("person_id string, occurred_at timestamp").parquet(src)
    q = (activity_windows(stream).writeStream.outputMode("complete").format("memory").queryName("win")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.person_id, r.window_end, r.n) for r in spark.sql("select * from win").collect()}
    want = {(r.person_id, r.window_end, r.n) for r in L.activity_series(events(spark), 14).collect()}
    assert got == want


def test_repeats_future_and_late_media(spark, tmp_path):
    src = str(tmp_path / "seen")
    t = dt.datetime(2024, 1, 1, 10)
    spark.createDataFrame([("a", t), ("a", t), ("b", t)], "path string, seen_at timestamp").write.parquet(src)
    q = (without_repeats(spark.readStream.schema("path string, seen_at timestamp").parquet(src)).writeStream
         .format("memory").queryName("seen").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.sql("select * from seen").count() == 2
    now, future = split_future(events(spark), "2024-01-05 00:00:00")
    assert now.count() + future.count() == 60 and future.count() > 0
    refs, media = str(tmp_path / "r"), str(tmp_path / "m")
    spark.createDataFrame([("m1", "a.jpg", t)], "message_id string, filename_key string, sent_at timestamp").write.parquet(refs)
    spark.createDataFrame([("f1", "a.jpg", t + dt.timedelta(hours=2))], "media_id string, filename_key string, arrived_at timestamp").write.parquet(media)
    joined = media_with_messages(
        spark.readStream.schema("message_id string, filename_key string, sent_at timestamp").parquet(refs),
        spark.readStream.schema("media_id string, filename_key string, arrived_at timestamp").parquet(media))
    q = joined.writeStream.format("memory").queryName("linked").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.message_id, r.media_id) for r in spark.sql("select * from linked").collect()] == [("m1", "f1")]
