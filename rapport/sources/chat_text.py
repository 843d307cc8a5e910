"""Line-based chat exports and free-form transcripts, parsed natively.

A file is split where a line starts with a message header; everything up to the
next header, continuation lines included, is one message. No window, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rapport import constants as K
from rapport.functions.chat import ATTACHMENT, attachments, body_of, chat_content, is_noise_line, sender_of
from rapport.functions.dates import parse_any, parse_export_datetime
from rapport.functions.text import clean_text, message_id, slug, strip
from rapport.sources.files import file_stem

_GAP = r"[^\S\n]*"
_TIME = K.CHAT_TIME.replace(r"\s*", _GAP)
_DASHED = rf"{K.CHAT_DATE}{_GAP},{_GAP}{_TIME}{_GAP}(?:-|–)"
_BRACKETED = rf"\[{K.CHAT_DATE}{_GAP},{_GAP}{_TIME}\]"
HEADER = rf"(?:{_BRACKETED}|{_DASHED})"
HEADER_PARTS = rf"^\[?({K.CHAT_DATE}){_GAP},{_GAP}({_TIME})(?:\]|{_GAP}(?:-|–)){_GAP}"

MESSAGE_COLUMNS = ["id", "conversation_id", "sender_label", "sent_at", "content", "attachments",
                   "reply_to", "source", "path"]


def no_attachments() -> Column:
    return F.array().cast(f"array<{ATTACHMENT}>")


def parse_chat(files: DataFrame) -> DataFrame:
    """Messages of chat-text exports (path, text). The conversation id derives from
    the participants, so a renamed re-export gives the same ids."""
    text = F.regexp_replace("text", K.LINE_BREAK, "\n")
    entries = F.filter(F.split(text, rf"(?m)^(?={HEADER})"), lambda e: e.rlike("^" + HEADER))

    def entry(e: Column) -> Column:
        rest = F.regexp_replace(e, HEADER_PARTS, "")
        first = F.substring_index(rest, "\n", 1)
        tail = F.substring(rest, F.length(first) + 1, F.length(rest))
        return F.struct(
            F.regexp_extract(e, HEADER_PARTS, 1).alias("date"), F.regexp_extract(e, HEADER_PARTS, 2).alias("time"),
            sender_of(first).alias("sender"), strip(F.concat(body_of(first), tail)).alias("body"))

    parsed = files.select("path", F.transform(entries, entry).alias("entries"))
    senders = F.array_sort(F.array_distinct(F.filter(
        F.transform("entries", lambda e: e["sender"]), lambda s: s.isNotNull())))
    key = F.when(F.size(senders) > 0, F.concat(F.lit("whatsapp:d"), F.substring(F.sha2(
        F.array_join(F.transform(senders, F.lower), K.ID_SEPARATOR), 256), 1, 32))
    ).otherwise(F.concat(F.lit("whatsapp:"), F.lower(file_stem(F.col("path")))))
    rows = parsed.select("path", key.alias("conversation_id"), F.inline_outer("entries"))
    body = F.col("body")
    kept = rows.where(F.col("sender").isNotNull() & (body != "") & ~is_noise_line(body))
    sent = parse_export_datetime(F.col("date"), F.col("time"))
    return (kept.withColumn("sent_at", sent).select(
        message_id(F.lit("whatsapp"), F.col("conversation_id"), F.col("sent_at"), F.col("sender"), body).alias("id"),
        "conversation_id", F.col("sender").alias("sender_label"), "sent_at", chat_content(body).alias("content"),
        attachments(body).alias("attachments"), F.lit(None).cast("string").alias("reply_to"),
        F.lit("whatsapp").alias("source"), "path"))


def is_chat(text: Column) -> Column:
    return text.rlike(rf"(?m)^{HEADER}")


_TRANSCRIPT_START = "(?:" + "|".join("(?:" + p.lstrip("^").rstrip("$") + ")" for p in K.GENERIC_LINE_PATTERNS) + ")"


def parse_transcript(files: DataFrame) -> DataFrame:
    """Free-form transcripts ('time <Ann> hi', 'Ann: hi'): lines without a header
    continue the message above them; text before the first header is ignored."""
    text = F.regexp_replace("text", K.LINE_BREAK, "\n")
    lines = F.filter(F.split(text, rf"(?m)^(?={_TRANSCRIPT_START})"), lambda e: e.rlike("^" + _TRANSCRIPT_START))
    rows = files.select("path", F.explode_outer(lines).alias("entry")).where("entry IS NOT NULL")
    first = F.substring_index("entry", "\n", 1)
    when, sender, body = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern in reversed(K.GENERIC_LINE_PATTERNS):
        hit = first.rlike(pattern)
        when = F.when(hit, F.regexp_extract(first, pattern, 1)).otherwise(when)
        sender = F.when(hit, F.regexp_extract(first, pattern, 2)).otherwise(sender)
        body = F.when(hit, F.regexp_extract(first, pattern, 3)).otherwise(body)
    tail = F.substring("entry", F.length(first) + 1, F.length("entry"))
    key = F.concat(F.lit("chat:"), slug(file_stem(F.col("path"))))
    parsed = rows.select("path", key.alias("conversation_id"), clean_text(sender).alias("sender_label"),
                         parse_any(F.nullif(when, F.lit(""))).alias("sent_at"), strip(F.concat(body, tail)).alias("body"))
    return parsed.where("body != ''").select(
        message_id(F.lit("chat"), F.col("conversation_id"), F.col("sent_at"), F.col("sender_label"),
                   F.col("body")).alias("id"),
        "conversation_id", "sender_label", "sent_at", clean_text(F.col("body")).alias("content"),
        no_attachments().alias("attachments"), F.lit(None).cast("string").alias("reply_to"),
        F.lit("chat").alias("source"), "path")
