"""Files: reading, text decoding, routing, scope and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rapport import constants as K
from rapport.functions.media import basename, extension, stem_of
from rapport.functions.text import java_quote, lit_array, lit_map
from rapport.operators.hooks import PARSERS

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Every file under ``path`` with its bytes, recursively."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def decode_text(content: Column) -> Column:
    """Bytes to text: a byte-order mark decides first, then UTF-8 when valid,
    otherwise Latin-1 (which never fails)."""
    head = F.hex(F.substring(content, 1, 3))
    return (F.when(head.startswith("EFBBBF"), F.decode(F.substring(content, 4, 2147483647), "UTF-8"))
            .when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(content, "UTF-16"))
            .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
            .otherwise(F.decode(content, "ISO-8859-1")))


def with_text(files: DataFrame) -> DataFrame:
    return files.withColumn("text", decode_text(F.col("content")))


def parts_of(path: Column) -> Column:
    """Lower-case path segments, drive or scheme included."""
    return F.filter(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), lambda p: p != "")


def folders_of(path: Column) -> Column:
    parts = parts_of(path)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def is_in_progress(path: Column) -> Column:
    """Downloads and writes that are not finished, and system leftovers."""
    name = F.lower(basename(path))
    suffix = "(?:" + "|".join(java_quote(s) for s in K.IN_PROGRESS_SUFFIXES) + ")$"
    prefix = "^(?:" + "|".join(java_quote(s) for s in K.IN_PROGRESS_PREFIXES) + ")"
    return name.rlike(suffix) | name.isin(K.IN_PROGRESS_NAMES) | name.rlike(prefix)


def is_ingestible(path: Column, size: Column) -> Column:
    """Finished, visible and not empty."""
    return ~is_in_progress(path) & ~basename(path).startswith(".") & (size > 0)


def is_data_export(path: Column) -> Column:
    prefix = "^(?:" + "|".join(java_quote(p) for p in K.EXPORT_MARKER_PREFIXES) + ")"
    return F.exists(parts_of(path), lambda p: p.isin(K.EXPORT_MARKER_DIRS) | p.rlike(prefix))


def in_conversation_tree(path: Column) -> Column:
    parts, name = parts_of(path), F.lower(basename(path))
    inbox = F.lit(True)
    for folder in K.EXPORT_INBOX_DIRS:
        inbox = inbox & F.array_contains(parts, folder)
    message = name.startswith("message") & extension(name).isin(K.EXPORT_MESSAGE_SUFFIXES)
    attachment = (extension(name) != "") & F.arrays_overlap(folders_of(path), lit_array(K.EXPORT_ATTACHMENT_DIRS))
    return inbox & (message | attachment)


def skip_reason(path: Column) -> Column:
    """Why a file inside a data export is left out; NULL means it is taken."""
    return F.when(is_data_export(path) & ~in_conversation_tree(path),
                  F.when(extension(basename(path)) == "", "export directory marker")
                  .otherwise("not a conversation file in a Meta data export"))


def route(path: Column, head: Column, root: str = "") -> Column:
    """Source of a file: the first known folder below ``root``, then the file name,
    then the extension, then the first bytes of its content."""
    relative = F.regexp_replace(path, "^" + java_quote(root.rstrip("/")) + "/", "") if root else path
    known = F.filter(F.transform(folders_of(relative), lambda p: F.try_element_at(
        lit_map(K.SOURCE_BY_FOLDER), F.trim(p))), lambda s: s.isNotNull())
    name = F.lower(basename(path))
    ext = extension(name)
    by_name = (F.when(name.endswith("_chat.txt") | name.contains("whatsapp"), "whatsapp")
               .when(name.contains("telegram"), "telegram").when(name.contains("instagram"), "instagram")
               .when(name.startswith("direct-message") | name.contains("twitter")
                     | (name.endswith(".js") & name.contains("data")), "x"))
    by_extension = (F.when(ext == ".js", "x").when(ext.isin(".eml", ".mbox"), "email")
                    .when(ext == ".ics", "calendar").when(ext == ".vcf", "contacts")
                    .when(ext.isin(K.AUDIO_EXTENSIONS), "voice"))
    text = F.when(ext.isin(".json", ".txt"), head)
    by_content = (F.when(text.contains("sender_name") & text.contains("timestamp_ms"), "instagram")
                  .when(text.contains('"messages"') & text.contains('"from"'), "telegram")
                  .when(text.contains("participants") & text.contains("title"), "instagram")
                  .when(text.contains("message_create") | text.contains("YTD"), "x"))
    return F.coalesce(F.try_element_at(known, F.lit(1)), by_name, by_extension, by_content)


def verdict(path: Column, size: Column, max_bytes: int | None = K.MEDIA_MAX_BYTES) -> Column:
    """'ok', or the reason the file is refused. ``max_bytes`` holds for pictures and
    recordings only; text of any size is taken. Registered parsers add extensions."""
    ext = extension(basename(path))
    too_large = F.lit(False) if max_bytes is None else ext.isin(K.RECORDED_EXTENSIONS) & (size > max_bytes)
    return (F.when(~ext.isin([*K.ALLOWED_EXTENSIONS, *PARSERS]),
                   F.concat(F.lit("unsupported file type: "), F.when(ext == "", "(none)").otherwise(ext)))
            .when(size == 0, "empty file")
            .when(too_large, F.concat(F.lit("file too large ("), size.cast("string"),
                                             F.lit(f" > {max_bytes} bytes)")))
            .otherwise("ok"))


def admitted(files: DataFrame, root: str = "", max_bytes: int | None = K.MEDIA_MAX_BYTES) -> DataFrame:
    """Files with source, checksum, verdict and decoded head; scope and progress
    filters applied."""
    path, size = F.col("path"), F.length("content").cast("bigint")
    head = decode_text(F.substring("content", 1, K.SNIFF_BYTES))
    return (files.where(is_ingestible(path, size) & skip_reason(path).isNull())
            .withColumns({"checksum": F.sha2("content", 256), "source": route(path, head, root),
                          "ext": extension(basename(path)), "verdict": verdict(path, size, max_bytes)}))


def folder_report(files: DataFrame, root: str = "") -> DataFrame:
    """Dry run: (facet, value, files, bytes) by route, by parent folder and unrouted
    names, without parsing anything."""
    routed = files.select("path", F.length("content").cast("bigint").alias("size"), F.coalesce(
        route(F.col("path"), decode_text(F.substring("content", 1, K.SNIFF_BYTES)), root),
        F.lit("unrouted")).alias("route"),
        F.coalesce(F.try_element_at(folders_of(F.col("path")), F.lit(-1)), F.lit("")).alias("folder"))
    entries = F.explode(F.array(
        F.struct(F.lit("route").alias("facet"), F.col("route").alias("value")),
        F.struct(F.lit("folder").alias("facet"), F.col("folder").alias("value"))))
    return (routed.select("size", entries.alias("e")).groupBy("e.facet", "e.value")
            .agg(F.count("*").alias("files"), F.sum("size").alias("bytes")))


def file_stem(path: Column) -> Column:
    return stem_of(basename(path))
