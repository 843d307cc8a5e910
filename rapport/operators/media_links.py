"""Media files and the messages that refer to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rapport import constants as K
from rapport.functions.media import media_filename_key, media_kind, media_mime, sanitize_filename, basename


def media_catalogue(files: DataFrame, max_bytes: int | None = K.MEDIA_MAX_BYTES) -> DataFrame:
    """One row per distinct content (path, content, modified): the earliest path
    names it; empty files are left out, those above ``max_bytes`` are TOO_LARGE."""
    rows = files.where(F.length("content") > 0).select(
        F.sha2("content", 256).alias("checksum"), basename(F.col("path")).alias("name"), "path",
        F.length("content").cast("bigint").alias("size_bytes"))
    picked = rows.groupBy("checksum").agg(
        F.min_by(F.struct("name", "path", "size_bytes"), F.struct("path")).alias("f"))
    return picked.select(
        F.concat(F.lit("media-"), F.substring("checksum", 1, 24)).alias("id"),
        sanitize_filename(F.col("f.name")).alias("filename"),
        media_filename_key(F.col("f.name")).alias("filename_key"),
        media_kind(F.col("f.name")).alias("kind"), media_mime(F.col("f.name")).alias("mime_type"),
        F.col("f.size_bytes").alias("size_bytes"), "checksum", F.col("f.path").alias("path"),
        (F.lit("STORED") if max_bytes is None else F.when(F.col("f.size_bytes") > max_bytes, "TOO_LARGE").otherwise("STORED"))
        .alias("status"))


def attachment_keys(messages: DataFrame) -> DataFrame:
    """(message_id, person_id, sent_at, filename_key), one row per named attachment."""
    return (messages.select(F.col("id").alias("message_id"), "conversation_id", "person_id", "sent_at",
                            F.explode("attachments").alias("a"))
            .select("message_id", "conversation_id", "person_id", "sent_at",
                    F.col("a.filename_key").alias("filename_key"))
            .where(F.col("filename_key").isNotNull()))


def media_by_key(media: DataFrame) -> DataFrame:
    """The file a key stands for: the smallest id when several share it."""
    return media.groupBy("filename_key").agg(F.min("id").alias("media_id"))


def message_media(references: DataFrame, media: DataFrame) -> DataFrame:
    """(message_id, media_id) for every reference that has its file by now; the
    order in which chat and media arrived plays no part."""
    return references.join(media_by_key(media), "filename_key").select(
        "message_id", "media_id", "conversation_id", "person_id", "sent_at").distinct()


def link_media(media: DataFrame, references: DataFrame) -> DataFrame:
    """Media with the message that uses them: the latest message wins, its person
    is taken over, and a missing time is filled in. Unreferenced media are kept."""
    links = message_media(references, media)
    last = links.groupBy("media_id").agg(
        F.max_by(F.struct("message_id", "conversation_id", "person_id"),
                 F.struct("sent_at", "message_id")).alias("m"),
        F.min("sent_at").alias("first_sent"))
    old = {c: (F.col(c) if c in media.columns else F.lit(None)) for c in
           ("person_id", "occurred_at", "message_id", "conversation_id")}
    linked = F.col("m").isNotNull()
    out = media.join(last.withColumnRenamed("media_id", "id"), "id", "left").withColumns({
        "message_id": F.coalesce(F.col("m.message_id"), old["message_id"].cast("string")),
        "conversation_id": F.coalesce(F.col("m.conversation_id"), old["conversation_id"].cast("string")),
        "person_id": F.coalesce(F.col("m.person_id"), old["person_id"].cast("string")),
        "occurred_at": F.coalesce(old["occurred_at"].cast("timestamp_ntz"), "first_sent"),
        "status": F.when(linked, F.lit("LINKED")).otherwise(F.col("status"))})
    return out.drop("m", "first_sent")


def recordings(media: DataFrame) -> DataFrame:
    return media.where(F.col("kind").isin(*K.RECORDING_KINDS) & (F.col("status") != "TOO_LARGE"))


def voice_rows(media: DataFrame, references: DataFrame, files: DataFrame) -> DataFrame:
    """A voice row, with its content, for every recording of a media catalogue.

    ``files``: path, content, modificationTime. A recording sent in a chat belongs to the message and its sender and is as
    old as the message; any other one belongs to nobody yet and is as old as its file.
    """
    linked = link_media(recordings(media), references)
    return linked.join(files.select("path", "content", "modificationTime"), "path").select(
        F.concat(F.lit("voice-"), F.substring("checksum", 1, 24)).alias("id"), "person_id", "message_id", "filename",
        F.coalesce("occurred_at", F.col("modificationTime").cast("timestamp_ntz")).alias("recorded_at"), "path", "content")
