"""Folder feed: every micro-batch of files becomes rows in the archive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rapport.functions.dates import ntz
from rapport.functions.text import deterministic_id, duplicate_key
from rapport.operators import buckets as B
from rapport.operators import media_links as ML
from rapport.operators import resolution as R
from rapport.operators.hooks import Models, embed, spoken
from rapport.operators.timeline import memories_of, voice_memories
from rapport.sinks import people as PL
from rapport.sinks.changes import unprocessed
from rapport.sinks.segments import TextIndex
from rapport.sinks.tables import Archive
from rapport.streaming.progress import Progress
from rapport.sources.archive import expand_archives
from rapport.sources.files import FILE_SCHEMA, admitted
from rapport.sources.registry import parse_all
from rapport import constants as K


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 1000, glob: str | None = None) -> DataFrame:
    """New files below ``folder`` (a glob may name several folders)."""
    reader = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
              .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger))
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def run_ingest(spark: SparkSession, folder: str, root: str, checkpoint: str, as_of, per_trigger: int = 1000,
               once: bool = True, models: Models = Models()):
    """Start the feed. The checkpoint remembers which files were handed out, the
    processed table which contents were imported; a replayed batch rewrites itself.
    Durations and row counts of its batches go to the archive's ``progress`` table."""
    archive = Archive(spark, root)
    progress = Progress.of(archive, "import")
    query = (file_stream(spark, folder, per_trigger).writeStream.queryName(progress.name)
             .foreachBatch(lambda files, batch: ingest(archive, files, batch, as_of, folder, models))
             .option("checkpointLocation", checkpoint))
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="10 seconds")).start()


def unpacked(kept: DataFrame, root: str) -> DataFrame:
    """Admitted files, with the entries of ZIP archives in place of the archives.
    Entries share their archive's checksum in the processed table."""
    plain = kept.where(F.col("ext") != ".zip")
    entries = expand_archives(kept.where((F.col("ext") == ".zip") & (F.col("verdict") == "ok")))
    good = entries.where("verdict = 'ok'").select(
        "path", F.lit(None).cast("timestamp").alias("modificationTime"),
        F.length("content").cast("bigint").alias("length"), "content")
    bad = entries.where("verdict != 'ok'").select(
        "path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("bigint").alias("length"),
        F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("checksum"),
        F.lit(None).cast("string").alias("source"), F.lit(".zip").alias("ext"),
        F.concat(F.lit("quarantined: "), "verdict").alias("verdict"))
    return plain.unionByName(admitted(good, root)).unionByName(bad)


def ingest(archive: Archive, files: DataFrame, batch: int, as_of, root: str = "", models: Models = Models()) -> None:
    """One batch: admit, dedupe by content, parse, resolve people, insert what is new,
    emit ledger rows and memories, refresh the profiles that changed.

    Only what was admitted counts as processed: a half-written or out-of-scope copy
    neither hides a good one nor keeps a finished download from being imported.

    Every stage writes its table and later stages read the written rows, so no
    stage recomputes an earlier one and a lost executor costs one stage at most.
    Readers see the batch once all of it is there."""
    archive = archive.writing(batch)
    before = lambda name: archive.read(name, before=batch)
    kept = admitted(files, root).persist()
    taken = kept.where("verdict = 'ok'")
    fresh = unprocessed(taken, before("processed")).persist()
    archive.write("processed", fresh.select("checksum", "path"), batch)
    known = taken.join(fresh.select("path"), "path", "left_anti")          # imported before, or twice in this batch
    work = unpacked(fresh.unionByName(kept.where("verdict != 'ok'")), root).persist()
    _started(archive, work, batch)
    parsed = parse_all(work.where("verdict = 'ok'"), lambda name, rows: archive.stage(name, rows, batch))

    people, identities, aliases = (PL.current(archive, name, batch) for name in ("people", "identities", "aliases"))
    contacts = archive.stage("contacts", R.resolve_contacts(parsed["contacts"], people, identities), batch)
    created = ntz(as_of)
    met = R.contact_people(contacts).withColumn("created_at", created)
    named = archive.write("identities", R.contact_identities(contacts).join(
        identities, ["person_id", "kind", "value"], "left_anti"), batch)
    everyone, known_ids = people.unionByName(met), identities.unionByName(named)
    called = archive.stage("contact_aliases", R.contact_aliases(contacts, everyone, aliases.select("person_id", "alias")), batch)

    mails, meetings = parsed["emails"], parsed["calendar"]
    labels = (parsed["messages"].select(F.col("sender_label").alias("label"), F.lit(None).cast("string").alias("email"))
              .unionByName(mails.select(F.coalesce(F.nullif("from_label", F.lit("")), "from_address").alias("label"),
                                        F.col("from_address").alias("email")))
              .unionByName(meetings.select(F.explode("participants").alias("label"),
                                           F.lit(None).cast("string").alias("email"))))
    resolved = archive.stage("senders", R.resolve_senders(
        labels, everyone, known_ids, aliases=aliases.select("person_id", "alias").unionByName(called)), batch)
    archive.write("aliases", called.unionByName(R.new_aliases(resolved, everyone)).distinct(), batch)
    archive.insert_new("people", met.unionByName(R.new_people(resolved).withColumn("created_at", created)),
                       batch, ["display_name"])
    people = PL.current(archive, "people")

    messages = archive.insert_new("messages", R.assign_people(parsed["messages"], resolved), batch, ["path"])
    who = resolved.select(F.col("label").alias("_label"), "person_id")
    emails = archive.insert_new("emails", mails.withColumn("_label", F.coalesce(
        F.nullif("from_label", F.lit("")), "from_address")).join(who, "_label", "left"), batch, ["path"])
    guests = (meetings.select("id", F.posexplode("participants").alias("pos", "_label")).join(who, "_label")
              .where("person_id is not null").groupBy("id")
              .agg(F.array_sort(F.collect_set("person_id")).alias("person_ids")))
    calendar = archive.insert_new("calendar", meetings.join(guests, "id", "left"), batch, ["path"])
    notes = archive.insert_new("notes", parsed["notes"], batch, ["path"])
    documents = archive.insert_new("documents", parsed["documents"], batch, ["path"])
    is_media = F.col("ext").isin(list(K.MEDIA_TYPES)) & ~F.col("ext").isin(".zip", ".vcf", ".docx")
    media = archive.insert_new("media", ML.media_catalogue(work.where(is_media & (F.col("verdict") == "ok"))), batch, ["path"])
    voice = _recorded(archive, media, work, batch, models)

    # A recording in a chat is counted with its message; one of nobody's counts once the user says whose it is.
    archive.insert_new("events", R.ledger_events(messages, emails, calendar, notes, voice.where("person_id IS NULL")), batch, ["id"])
    written = archive.insert_new("memories", memories_of(messages, emails, calendar, notes, documents).unionByName(
        voice_memories(voice)), batch, ["id"])
    _embedded(archive, written, batch, models)
    archive.insert_new("suggestions", R.name_match_suggestions(resolved).unionByName(
        duplicates_of(archive.batch("people", batch), people, PL.current(archive, "events"))).unionByName(
        R.voice_mention_suggestions(voice.where("person_id IS NULL AND transcript IS NOT NULL"), people)), batch, ["label"])
    touched = archive.batch("events", batch).select("person_id").distinct()
    # Where no batch before has buckets (an archive from before there were any), they take up the whole ledger.
    first = before("activity").isEmpty()
    archive.write("activity", B.activity_buckets(archive.read("events") if first else archive.batch("events", batch)), batch)
    first = before("topic_days").isEmpty()
    archive.write("topic_days", B.topic_buckets(archive.read("memories") if first else written), batch)
    profiles = archive.write("profiles", PL.kept_profiles(archive, touched, as_of), batch)
    _finish(archive, work, known, parsed, batch, profiles)
    archive.commit(batch)
    index = text_index(archive)          # after the commit: a search finds nothing that cannot be read
    index.append(written, batch)
    index.merge()
    for frame in (kept, fresh, work):
        frame.unpersist()


def _recorded(archive: Archive, media: DataFrame, work: DataFrame, batch: int, models: Models) -> DataFrame:
    """Voice rows of the batch's new recordings, with what the user's model understands of them."""
    if ML.recordings(media).isEmpty():
        return archive.write("voice", archive.batch("voice", batch).limit(0), batch)
    keys = ML.recordings(media).select("filename_key").distinct()
    sent = ML.attachment_keys(PL.current(archive, "messages")).join(keys, "filename_key", "left_semi")
    rows = ML.voice_rows(media, sent, work)
    rows = rows.withColumn("transcript", F.lit(None).cast("string")) if models.transcribe is None else spoken(rows, models.transcribe)
    return archive.insert_new("voice", rows.drop("content"), batch, ["path"])


def text_key(text):
    return F.sha2(text, 256)


def _embedded(archive: Archive, memories: DataFrame, batch: int, models: Models) -> None:
    """Vectors of texts that the archive has none for; a text is given to the model once, however often it is said."""
    if models.embed is None:
        return
    texts = memories.where("text IS NOT NULL").groupBy(text_key(F.col("text")).alias("text_key")).agg(F.first("text").alias("text"))
    new = texts.join(archive.read("vectors", before=batch).select("text_key"), "text_key", "left_anti")
    # Staged first: filters must not make the model run a second time.
    vectors = archive.stage("vectors", embed(new, "text", models.embed).drop("text"), batch)
    archive.write("vectors", vectors.where("size(embedding) > 0"), batch)


def corpus(archive: Archive) -> DataFrame:
    """All memories with their vectors (NULL without one), as ``retrieval`` takes them."""
    vectors = archive.read("vectors").withColumnRenamed("text_key", "_key")
    return PL.current(archive, "memories").withColumn("_key", text_key(F.col("text"))).join(vectors, "_key", "left").drop("_key")


def text_index(archive: Archive) -> TextIndex:
    """The index of everything imported so far."""
    return TextIndex(archive.spark, f"{archive.root}/_index")


def duplicates_of(fresh: DataFrame, people: DataFrame, events: DataFrame) -> DataFrame:
    """Suggestions for new people whose name somebody else has too; only people of such names are looked at."""
    key = duplicate_key(F.col("display_name"))
    names = fresh.select(key.alias("_key")).where("_key <> ''").distinct()
    alike = people.withColumn("_key", key).join(names, "_key", "left_semi").drop("_key")
    own = events.join(alike.select("person_id"), "person_id", "left_semi")
    return R.duplicate_suggestions(R.duplicate_people(alike, own), alike)


def _job_id(batch: int):
    return F.concat(F.lit("job-"), deterministic_id(F.col("path"), F.lit(batch))).alias("id")


def _started(archive: Archive, work: DataFrame, batch: int) -> None:
    """Jobs of a running batch; its end overwrites them, and ``resumed`` queues those
    of a batch that broke off."""
    archive.write("jobs", work.select(_job_id(batch), "path", "checksum", "source", F.lit("PROCESSING").alias("status"),
                                      F.lit(batch).alias("version")), batch)


def _per_path(parts: list[DataFrame], name: str) -> DataFrame:
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("path").agg(F.count("*").alias(name))


def _finish(archive: Archive, work: DataFrame, known: DataFrame, parsed: dict[str, DataFrame], batch: int,
            profiles: DataFrame) -> None:
    """Job states per file, provenance and the progress feed. A file that gave rows is
    COMPLETED, or SKIPPED when the archive held all of them; one without rows FAILED."""
    new = _per_path([archive.batch(name, batch).select("path") for name in (
        "messages", "emails", "calendar", "notes", "documents", "media")] + [parsed["contacts"].select("path")], "imported")
    media = archive.batch("media", batch).select("path")
    read = _per_path([rows.select("path") for rows in parsed.values()] + [media], "records")
    refused = F.col("verdict") != "ok"
    found, stored = F.coalesce("records", F.lit(0)), F.coalesce("imported", F.lit(0))
    status = (F.when(F.col("verdict").startswith("quarantined"), "QUARANTINED").when(refused | (found == 0), "FAILED")
              .when(stored == 0, "SKIPPED").otherwise("COMPLETED"))
    error = F.when(refused, F.col("verdict")).when(found == 0, "no records found").when(stored == 0, "no new records")
    files = work.select("path", "checksum", "source", "ext", "verdict").join(read, "path", "left").join(new, "path", "left")
    jobs = files.select(_job_id(batch), "path", "checksum", "source", status.alias("status"), error.alias("error"),
                        stored.alias("imported"), F.lit(batch).alias("version"))
    again = known.select(_job_id(batch), "path", "checksum", "source", F.lit("SKIPPED").alias("status"),
                         F.lit("already imported").alias("error"), F.lit(0).alias("imported"), F.lit(batch).alias("version"))
    archive.write("provenance", files.where(found > 0).select(
        "checksum", F.col("path").alias("filename"), found.alias("record_count")), batch)
    jobs = archive.write("jobs", jobs.unionByName(again), batch)
    feed = jobs.select(F.lit("job").alias("topic"), F.col("path").alias("key"), F.col("status").alias("detail")).unionByName(
        profiles.select(F.lit("person").alias("topic"), F.col("person_id").alias("key"), F.col("status").alias("detail")))
    archive.write("feed", feed, batch)


def linked_media(archive: Archive) -> DataFrame:
    """Media with their messages over everything imported so far, whichever of the
    two arrived first."""
    return ML.link_media(archive.read("media"), ML.attachment_keys(archive.read("messages")))
