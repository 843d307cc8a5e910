"""Timelines, evidence records and the lookups between record kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rapport import constants as K
from rapport.functions.text import citation, clean_text
from rapport.functions.topics import extract_topics
from rapport.operators.ranking import positions, top_per_group

BODY_CHARS = 500


def _entry(df: DataFrame, kind: str, at: str, title, body, source, person="person_id") -> DataFrame:
    return df.select(
        F.lit(kind).alias("type"), F.col("id"), F.col(person).alias("person_id"),
        F.col(at).alias("at"), title.alias("title"), F.substring(body, 1, BODY_CHARS).alias("body"),
        source.alias("source"))


def timeline(messages: DataFrame, emails: DataFrame, calendar: DataFrame, notes: DataFrame,
             voice: DataFrame) -> DataFrame:
    """Every record kind in one shape; order by ``at`` descending to read it."""
    meetings = calendar.withColumn("person_id", F.explode("person_ids"))
    place = F.trim(F.concat_ws(" ", F.coalesce("location", F.lit("")), F.coalesce("description", F.lit(""))))
    parts = [
        _entry(messages, "message", "sent_at", F.col("sender_label"), F.col("content"), F.col("source")),
        _entry(emails, "email", "sent_at",
               F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.lit("(no subject)")),
               F.col("body"), F.lit("email")),
        _entry(meetings, "calendar", "starts_at", F.col("title"), place, F.lit("calendar")),
        _entry(notes, "note", "noted_at", F.col("title"), F.col("body"), F.lit("notes")),
        _entry(voice, "voice", "recorded_at", F.col("filename"),
               F.coalesce("transcript", F.lit("")), F.lit("voice")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def newest_first(df: DataFrame, at: str, unique: str = "id", limit: int | None = None) -> DataFrame:
    out = df.orderBy(F.col(at).desc_nulls_last(), F.col(unique))
    return out if limit is None else out.limit(limit)


def latest_per_person(df: DataFrame, at: str, n: int, unique: str = "id") -> DataFrame:
    """The newest ``n`` rows of every person."""
    return top_per_group(df.where(F.col("person_id").isNotNull()), ["person_id"],
                         [F.col(at).desc_nulls_last(), F.col(unique)], n)


def conversation_replay(messages: DataFrame) -> DataFrame:
    """Messages numbered in the order they were sent inside their conversation."""
    return positions(messages, ["conversation_id"], "sent_at", ["id"])


def event_people(calendar: DataFrame, people: DataFrame) -> DataFrame:
    """One row per attendee of every event."""
    bridge = calendar.select(F.explode("person_ids").alias("person_id"), "id", "title", "starts_at")
    return bridge.join(people.select("person_id", "display_name"), "person_id")


def entry_media(entries: DataFrame, media: DataFrame) -> DataFrame:
    """Timeline entries with their media, one row per (entry, media file); an
    entry without media appears once. Kept flat because the number of files on
    one message has no bound."""
    files = media.where(F.col("message_id").isNotNull()).select(
        F.col("message_id").alias("id"), F.lit("message").alias("type"),
        F.col("id").alias("media_id"), F.col("kind").alias("media_kind"))
    return entries.join(files, ["type", "id"], "left")


def evidence_records(memories: DataFrame, records: DataFrame, people: DataFrame) -> DataFrame:
    """Each memory with the record it came from and the person's name.

    ``records``: (kind, record_id, title, body), e.g. from :func:`records_of`;
    one equi-join serves every record kind."""
    named = people.select("person_id", F.col("display_name").alias("person_name"))
    return (memories.join(records, ["kind", "record_id"], "left")
            .join(named, "person_id", "left"))


def records_of(messages=None, emails=None, calendar=None, notes=None, voice=None, documents=None,
               media=None) -> DataFrame:
    """Original records keyed by (kind, record_id)."""
    shapes = [
        (messages, "message", "sender_label", "content"), (emails, "email", "subject", "body"),
        (calendar, "calendar", "title", "description"), (notes, "note", "title", "body"),
        (voice, "voice", "filename", "transcript"), (documents, "document", "title", "text"),
        (media, None, "filename", "filename_key"),
    ]
    out = None
    for df, kind, title, body in shapes:
        if df is None:
            continue
        part = df.select((F.col("kind") if kind is None else F.lit(kind)).alias("kind"),
                         F.col("id").alias("record_id"), F.col(title).alias("record_title"),
                         F.col(body).alias("record_body"))
        out = part if out is None else out.unionByName(part)
    return out


def memories_of(messages: DataFrame, emails: DataFrame, calendar: DataFrame, notes: DataFrame,
                documents: DataFrame | None = None) -> DataFrame:
    """The retrieval corpus: one memory per message, email, meeting attendee,
    note and document chunk. Texts are kept whole."""
    text = clean_text(F.col("content"))
    msg = messages.where(text != "").select(
        F.concat(F.lit("mem-"), F.col("id")).alias("id"), "person_id", F.lit("message").alias("kind"),
        "source", F.col("sent_at").alias("occurred_at"),
        F.when(F.coalesce("sender_label", F.lit("")) != "",
               F.concat("sender_label", F.lit(": "), text)).otherwise(text).alias("text"),
        F.col("id").alias("record_id"), citation(F.col("source"), F.col("sent_at")).alias("citation"),
        text.alias("topic_text"))
    body = clean_text(F.coalesce(F.nullif(F.col("body"), F.lit("")), F.col("subject")))
    mail = emails.where(body != "").select(
        F.concat(F.lit("mem-"), F.col("id")).alias("id"), "person_id", F.lit("email").alias("kind"),
        F.lit("email").alias("source"), F.col("sent_at").alias("occurred_at"),
        F.concat(F.col("subject"), F.lit("\n"), body).alias("text"),
        F.col("id").alias("record_id"),
        citation(F.lit("email"), F.col("sent_at"), F.col("subject")).alias("citation"),
        F.concat_ws(" ", F.col("subject"), body).alias("topic_text"))
    label = F.array_join("participants", " / ")
    event_text = clean_text(F.concat(F.col("title"), F.lit(". "), label, F.lit(". "),
                                     F.coalesce("description", F.lit("")), F.lit(" "),
                                     F.coalesce("location", F.lit(""))))
    attendee = F.posexplode_outer("person_ids").alias("n", "person_id")
    meeting = calendar.select("*", attendee).select(
        F.when(F.coalesce("n", F.lit(0)) == 0, F.concat(F.lit("mem-"), F.col("id")))
        .otherwise(F.concat(F.lit("mem-"), F.col("id"), F.lit("-"), F.col("person_id")))
        .alias("id"), "person_id", F.lit("calendar").alias("kind"), F.lit("calendar").alias("source"),
        F.col("starts_at").alias("occurred_at"), event_text.alias("text"), F.col("id").alias("record_id"),
        citation(F.lit("calendar"), F.col("starts_at"), F.col("title")).alias("citation"),
        event_text.alias("topic_text"))
    note_text = clean_text(F.concat_ws(". ", F.col("title"), F.col("body")))
    note = notes.where(note_text != "").select(
        F.concat(F.lit("mem-"), F.col("id")).alias("id"), "person_id", F.lit("note").alias("kind"),
        F.lit("notes").alias("source"), F.col("noted_at").alias("occurred_at"), note_text.alias("text"),
        F.col("id").alias("record_id"), citation(F.lit("notes"), F.col("noted_at")).alias("citation"),
        note_text.alias("topic_text"))
    out = msg.unionByName(mail).unionByName(meeting).unionByName(note)
    if documents is not None:
        out = out.unionByName(document_memories(documents))
    return out.withColumn("topics", extract_topics(F.col("topic_text"))).drop("topic_text")


def document_chunks(documents: DataFrame, size: int = K.CHUNK_CHARS,
                    limit: int | None = None) -> DataFrame:
    """(id, chunk_no, chunk): fixed-width pieces covering the whole cleaned text.
    ``limit`` keeps only the first pieces, for callers who want that."""
    clean = clean_text(F.col("text"))
    count = F.ceil(F.length(clean) / F.lit(size)).cast("int")
    if limit is not None:
        count = F.least(count, F.lit(limit))
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return (documents.withColumn("_clean", clean)
            .select("*", F.explode_outer(starts).alias("chunk_no")).where("chunk_no IS NOT NULL")
            .withColumn("chunk", F.substring(F.col("_clean"), F.col("chunk_no") * size + 1, F.lit(size)))
            .drop("_clean"))


def document_memories(documents: DataFrame) -> DataFrame:
    first = F.col("chunk_no") == 0
    null = F.lit(None)
    return document_chunks(documents).select(
        F.concat(F.lit("mem-"), F.col("id"), F.lit("-"), F.col("chunk_no").cast("string")).alias("id"),
        null.cast("string").alias("person_id"), F.lit("document").alias("kind"),
        F.lit("document").alias("source"), null.cast("timestamp_ntz").alias("occurred_at"),
        F.when(first, F.concat(F.col("title"), F.lit(": "), F.col("chunk"))).otherwise(F.col("chunk")).alias("text"),
        F.col("id").alias("record_id"), F.col("filename").alias("citation"), F.col("chunk").alias("topic_text"))


def voice_memories(voice: DataFrame) -> DataFrame:
    """One memory per recording with a transcript."""
    said = clean_text(F.col("transcript"))
    return voice.where(said != "").select(
        F.concat(F.lit("mem-"), F.col("id")).alias("id"), "person_id", F.lit("voice").alias("kind"),
        F.lit("voice").alias("source"), F.col("recorded_at").alias("occurred_at"),
        F.concat(F.lit("[Voice recording "), F.col("filename"), F.lit("] "), said).alias("text"),
        F.col("id").alias("record_id"), citation(F.lit("voice"), F.col("recorded_at"), F.col("filename")).alias("citation"),
        extract_topics(said).alias("topics"))
