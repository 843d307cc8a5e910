"""JSON chat exports, read as VARIANT and unnested natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rapport import constants as K
from rapport.functions.dates import parse_epoch, parse_iso
from rapport.functions.media import media_filename_key
from rapport.functions.text import clean_text, message_id, repair_mojibake, slug, strip
from rapport.sources.chat_text import no_attachments

LIST = "array<variant>"


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _first_list(v: Column, *paths: str) -> Column:
    return F.coalesce(*[get(v, p, LIST) for p in paths])


def _has(v: Column, path: str) -> Column:
    return get(v, path, "variant").isNotNull()


def flatten_text(v: Column) -> Column:
    """A string, or an array of strings and {text} segments, as one string."""
    segments = F.transform(get(v, "$.text", LIST), lambda s: F.when(
        is_object(s), F.coalesce(get(s, "$.text"), F.lit(""))).otherwise(get(s, "$")))
    return F.coalesce(F.array_join(segments, ""), get(v, "$.text"), F.lit(""))


def parse_telegram(files: DataFrame) -> DataFrame:
    """One chat, a list of chats, or ``chats.list``; service messages are dropped."""
    doc = files.select("path", F.try_parse_json("text").alias("v"))
    single = _has(F.col("v"), "$.messages") & (
        _has(F.col("v"), "$.name") | _has(F.col("v"), "$.title") | _has(F.col("v"), "$.id"))
    listed = F.filter(get(F.col("v"), "$", LIST), lambda c: is_object(c) & _has(c, "$.messages"))
    chats = F.coalesce(listed, F.when(single, F.array("v")),
                       _first_list(F.col("v"), "$.chats.list", "$.list", "$.conversations", "$.chats"))
    chat = doc.select("path", F.explode(chats).alias("c"))
    title = clean_text(F.coalesce(F.nullif(get(F.col("c"), "$.name"), F.lit("")),
                                  F.nullif(get(F.col("c"), "$.title"), F.lit("")), F.lit("conversation")))
    key = F.concat(F.lit("telegram:"), F.coalesce(F.nullif(slug(title), F.lit("")), F.lit("chat")))
    rows = chat.select("path", key.alias("conversation_id"), F.explode(get(F.col("c"), "$.messages", LIST)).alias("m"))
    m = F.col("m")
    media = [F.struct(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("filename"),
                      F.lit(None).cast("string").alias("filename_key"), get(m, f"$.{k}").alias("label"))
             for k in K.TELEGRAM_MEDIA_KEYS]
    rows = rows.where(F.coalesce(get(m, "$.type"), F.lit("message")) == "message").select(
        "path", "conversation_id", flatten_text(m).alias("body"),
        clean_text(F.coalesce(F.nullif(get(m, "$.from"), F.lit("")), get(m, "$.actor"))).alias("sender_label"),
        parse_iso(get(m, "$.date")).alias("sent_at"),
        F.filter(F.array(*media), lambda a: F.coalesce(a["label"], F.lit("")) != "").alias("attachments"),
        get(m, "$.reply_to_message_id").alias("reply_to"),
        (_has(m, "$.photo") | _has(m, "$.file")).alias("has_media"))
    kept = rows.where(((F.col("body") != "") | F.col("has_media")) & (F.col("sender_label") != ""))
    return kept.select(
        message_id(F.lit("telegram"), F.col("conversation_id"), F.col("sent_at"), F.col("sender_label"),
                   F.col("body")).alias("id"),
        "conversation_id", "sender_label", "sent_at", clean_text(F.col("body")).alias("content"),
        "attachments", "reply_to", F.lit("telegram").alias("source"), "path")


def _documents(text: Column) -> Column:
    """The JSON document as a list of items. A first line that is complete JSON with
    more lines after it makes the text NDJSON, read line by line."""
    body = strip(text)
    first = F.substring_index(body, "\n", 1)
    whole = F.try_parse_json(body)
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), lambda line: F.try_parse_json(F.trim(line))),
                     lambda v: v.isNotNull())
    many = whole.isNull() | (F.contains(body, F.lit("\n")) & F.try_parse_json(first).isNotNull())
    return F.when(many, lines).otherwise(F.coalesce(get(whole, "$", LIST), F.array(whole)))


def _threads(item: Column) -> Column:
    """An item as threads of (participants, title, messages)."""
    def thread(v: Column, messages: Column) -> Column:
        return F.struct(get(v, "$.participants", LIST).alias("participants"),
                        F.coalesce(get(v, "$.title"), get(v, "$.name")).alias("title"), messages.alias("messages"))

    nested = _first_list(item, "$.chats", "$.conversations", "$.inbox")
    return (F.when(get(item, "$.messages", LIST).isNotNull(), F.array(thread(item, get(item, "$.messages", LIST))))
            .when(nested.isNotNull(), F.transform(nested, lambda c: thread(c, get(c, "$.messages", LIST))))
            .otherwise(F.array(F.struct(F.lit(None).cast(LIST).alias("participants"),
                                        F.lit(None).cast("string").alias("title"),
                                        F.array(item).alias("messages")))))


def parse_instagram(files: DataFrame) -> DataFrame:
    """Threads, wrapped lists, NDJSON or bare messages; doubly encoded text repaired."""
    repaired = lambda c: clean_text(repair_mojibake(c))
    thread = (files.select("path", F.explode(_documents(F.col("text"))).alias("item"))
              .select("path", F.explode(_threads(F.col("item"))).alias("t")).select("path", "t.*"))
    rows = thread.select("path", "participants", "title", F.explode("messages").alias("m"))
    m = F.col("m")
    sender = repaired(get(m, "$.sender_name"))
    people = F.transform("participants", lambda p: F.when(
        is_object(p), repaired(get(p, "$.name"))).otherwise(clean_text(get(p, "$"))))
    rows = rows.withColumns({"sender_label": sender, "people": people}).where("sender_label != ''")
    names = F.when(F.size("people") > 0, F.col("people")).otherwise(F.array("sender_label"))
    base = F.coalesce(F.nullif(clean_text(F.col("title")), F.lit("")),
                      F.array_join(F.array_sort(F.filter(names, lambda p: p != "")), "/"))

    def field(name: str, kind: str) -> Column:
        def one(item: Column) -> Column:
            uri = F.when(is_object(item), get(item, "$.uri")).otherwise(get(item, "$"))
            name_of = F.element_at(F.split(F.regexp_replace(F.replace(uri, F.lit("\\"), F.lit("/")), "/+$", ""), "/"), -1)
            return F.struct(F.lit(kind).alias("kind"), name_of.alias("filename"),
                            media_filename_key(name_of).alias("filename_key"), name_of.alias("label"))
        return F.coalesce(F.transform(get(m, f"$.{name}", LIST), one), no_attachments())

    listed = F.filter(F.concat(*[field(n, k) for n, k in K.META_ATTACHMENT_FIELDS]),
                      lambda a: F.coalesce(a["filename"], F.lit("")) != "")
    kind = F.coalesce(get(m, "$.type"), F.lit("Generic"))
    content = repaired(get(m, "$.content"))
    shared = F.coalesce(F.nullif(clean_text(get(m, "$.share.text")), F.lit("")), F.lit("Shared a post"))
    action = F.replace(F.replace(kind, F.lit("Action:"), F.lit("Action")), F.lit("_"), F.lit(" "))
    body = (F.when(content != "", content).when(_has(m, "$.share"), shared)
            .when(kind.startswith("Action:"), action).otherwise(""))
    rows = rows.select(
        "path", "sender_label", F.concat(F.lit("instagram:"), slug(base)).alias("conversation_id"),
        parse_epoch(F.coalesce(get(m, "$.timestamp_ms"), get(m, "$.timestamp"))).alias("sent_at"),
        body.alias("content"), listed.alias("all_files"))
    keys = F.transform("all_files", lambda a: a["filename_key"])
    rows = rows.withColumn("_keys", keys).withColumn("attachments", F.filter(
        "all_files", lambda a, i: F.array_position(F.col("_keys"), a["filename_key"]) == i + 1))
    signature = F.concat(F.col("content"), F.lit("|"), F.array_join(
        F.transform("attachments", lambda a: a["filename"]), "|"))
    return rows.where((F.col("content") != "") | (F.size("attachments") > 0)).select(
        message_id(F.lit("instagram"), F.col("conversation_id"), F.col("sent_at"), F.col("sender_label"),
                   signature).alias("id"),
        "conversation_id", "sender_label", "sent_at", "content", "attachments",
        F.lit(None).cast("string").alias("reply_to"), F.lit("instagram").alias("source"), "path")


def parse_x(files: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Direct messages with or without their JavaScript wrapper, classic and flat.

    ``users``: (user_id, user_name) harvested from the account files."""
    body = F.regexp_replace(strip(F.col("text")), r";\s*$", "")
    unwrapped = F.regexp_replace(body, r"(?s)^[^\[{=]*=\s*", "")
    items = files.select("path", F.explode(_documents(unwrapped)).alias("item"))
    direct = _first_list(F.col("item"), "$.direct_messages", "$.dm", "$.conversations")
    thread = items.select("path", F.explode(F.when(
        get(F.col("item"), "$.messages", LIST).isNotNull(), F.array("item")).when(
        direct.isNotNull(), direct).otherwise(F.array("item"))).alias("t"))
    t = F.col("t")
    people = F.transform(get(t, "$.participants", LIST), lambda p: clean_text(F.when(
        is_object(p), F.coalesce(get(p, "$.participant"), get(p, "$.name"))).otherwise(get(p, "$"))))
    key = F.concat(F.lit("x:"), slug(F.array_join(F.array_sort(F.coalesce(people, F.array().cast("array<string>"))), "|")))
    rows = thread.select("path", key.alias("conversation_id"),
                         F.explode(F.coalesce(get(t, "$.messages", LIST), F.array(t))).alias("raw"))
    m = F.coalesce(get(F.col("raw"), "$.message_create", "variant"), F.col("raw"))
    urls = F.filter(F.transform(get(m, "$.message_data.urls", LIST), lambda u: get(u, "$.url")), lambda u: u.isNotNull())
    written = F.concat_ws("\n", F.nullif(get(m, "$.message_data.text"), F.lit("")), urls)
    plain = clean_text(F.coalesce(get(m, "$.text"), get(m, "$.body")))
    rows = rows.select(
        "path", "conversation_id",
        F.when(_has(m, "$.message_data"), written).otherwise(plain).alias("body"),
        F.coalesce(get(m, "$.senderId"), get(m, "$.sender_id"), F.lit("")).alias("user_id"),
        get(m, "$.sender_screen_name").alias("screen_name"),
        parse_iso(F.coalesce(get(m, "$.createdAt"), get(m, "$.send_timestamp"), get(m, "$.created_at"))).alias("sent_at"))
    rows = rows.where("body != ''")
    if users is not None:
        rows = rows.join(users.select("user_id", "user_name"), "user_id", "left")
    else:
        rows = rows.withColumn("user_name", F.lit(None).cast("string"))
    sender = F.coalesce(F.nullif("user_name", F.lit("")), "screen_name", F.nullif("user_id", F.lit("")), F.lit("unknown"))
    return rows.select(
        message_id(F.lit("x"), F.col("conversation_id"), F.col("sent_at"), sender, F.col("body")).alias("id"),
        "conversation_id", sender.alias("sender_label"), "sent_at", clean_text(F.col("body")).alias("content"),
        no_attachments().alias("attachments"), F.lit(None).cast("string").alias("reply_to"),
        F.lit("x").alias("source"), "path")


def x_users(files: DataFrame) -> DataFrame:
    """(user_id, user_name) from account files."""
    body = F.regexp_replace(F.regexp_replace(strip(F.col("text")), r";\s*$", ""), r"(?s)^[^\[{=]*=\s*", "")
    account = files.select(F.explode(_documents(body)).alias("item"))
    at = F.col("item")
    return account.select(
        get(at, "$.account.accountId").alias("user_id"),
        clean_text(F.coalesce(F.nullif(get(at, "$.account.userName"), F.lit("")), get(at, "$.account.fullName"))).alias("user_name")
    ).where("user_id is not null").dropDuplicates(["user_id"])
