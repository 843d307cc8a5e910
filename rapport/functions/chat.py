"""Pieces of the chat-export line grammar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rapport import constants as K
from rapport.functions.media import media_filename_key, media_kind
from rapport.functions.text import clean_text, java_quote, let, strip

ATTACHMENT = "struct<kind:string,filename:string,filename_key:string,label:string>"


def sender_of(rest: Column) -> Column:
    """The name before the first colon, NULL for system lines, URLs and clock times."""
    head = strip(F.substring_index(rest, ":", 1))
    ok = (
        rest.contains(":") & (head != "") & ~head.rlike(r"^\d+$") & (F.length(head) < 100)
        & ~head.contains("://") & ~F.lower(head).rlike(r"^(www\.|http)")
        & ~head.rlike(K.CHAT_SYSTEM_VERBS)
    )
    return F.when(ok, head)


def body_of(rest: Column) -> Column:
    """What follows the sender's colon; the whole line when there is no sender."""
    after = F.substring(rest, F.instr(rest, ":") + 1, F.length(rest))
    return F.when(sender_of(rest).isNotNull(), strip(after)).otherwise(strip(rest))


def is_noise_line(body: Column) -> Column:
    """Notices the chat client writes into the export."""
    return F.lower(body).rlike("^(?:" + "|".join(java_quote(p) for p in K.CHAT_NOISE_PREFIXES) + ")")


def attachment_names(body: Column) -> Column:
    """File names a message refers to; explicit references win over bare names."""

    def found(pattern: str) -> Column:
        return F.regexp_extract_all(body, F.lit(pattern), F.lit(1))

    explicit = F.concat(found(K.ATTACHED_IN_ANGLES), found(K.FILE_ATTACHED))
    names = F.when(F.size(explicit) > 0, explicit).otherwise(found(K.MEDIA_FILENAME))

    def tidy(name: Column) -> Column:
        name = F.regexp_replace(strip(name), "^[\"']+|[\"']+$", "")
        name = F.regexp_replace(name, K.INVISIBLE_MARKS, "")
        return strip(F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1))

    return F.filter(F.transform(names, tidy), lambda n: n != "")


def attachments(body: Column) -> Column:
    """One entry per distinct file key; a bare 'media omitted' gives one unnamed entry."""
    def listed(inputs: Column) -> Column:
        keys = inputs["keys"]
        first = F.filter(inputs["names"], lambda n, i: F.array_position(keys, F.get(keys, i)) == i + 1)
        return F.transform(first, lambda n: F.struct(
            media_kind(n).alias("kind"), n.alias("filename"),
            media_filename_key(n).alias("filename_key"), body.alias("label")))

    named = let(attachment_names(body), lambda names: let(
        F.struct(names.alias("names"), F.transform(names, media_filename_key).alias("keys")), listed))
    null = F.lit(None).cast("string")
    omitted = F.array(F.struct(F.lit("media").alias("kind"), null.alias("filename"),
                               null.alias("filename_key"), body.alias("label")))
    lost = body.rlike(K.MEDIA_OMITTED) | body.rlike(K.MEDIA_WORD_ONLY)
    return let(named, lambda found: (
        F.when(F.size(found) > 0, found).when(lost, omitted)
        .otherwise(F.array().cast(f"array<{ATTACHMENT}>"))))


def caption(body: Column) -> Column:
    """The human text left once attachment references are removed."""
    text = body
    for pattern in (K.MEDIA_FILENAME, K.ATTACHED_IN_ANGLES, K.FILE_ATTACHED,
                    r"(?i)\(\s*file attached\s*\)", K.INVISIBLE_MARKS):
        text = F.regexp_replace(text, pattern, " ")
    return clean_text(text)


def chat_content(body: Column) -> Column:
    return F.when(F.size(attachment_names(body)) > 0, caption(body)).otherwise(clean_text(body))
