"""Row-shaped imports (CSV, JSON rows, HTML tables) and the alias mapping on them.

Every reader yields (path, row_no, fields map<string,string>, columns array<string>);
what the columns mean is decided natively from the alias tables.
"""

from __future__ import annotations

import csv
import io
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rapport import constants as K
from rapport.functions.dates import parse_any, parse_iso
from rapport.functions.text import clean_text, deterministic_id, message_id, norm_email, norm_phone, slug
from rapport.session import spread
from rapport.sources.chat_json import LIST, get, is_object
from rapport.sources.chat_text import no_attachments
from rapport.sources.files import file_stem

ROWS = "path string, row_no int, columns array<string>, fields map<string,string>"


EMIT = 20000          # rows per Arrow batch handed back to Spark


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "row_no", "columns", "fields"])


def csv_rows(files: DataFrame) -> DataFrame:
    """Rows of CSV files (path, text); quoting and embedded line breaks respected.
    Files of one shape are read faster with ``spark.read.csv`` and :func:`frame_rows`."""
    def parse(batches):
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["text"]):
                reader = csv.DictReader(io.StringIO(text or ""))
                names = [n for n in (reader.fieldnames or []) if n is not None]
                for i, row in enumerate(reader):
                    out.append((path, i, names, {k: v for k, v in row.items()
                                                 if isinstance(k, str) and isinstance(v, str)}))
                    if len(out) >= EMIT:
                        yield _frame(out)
                        out = []
            yield _frame(out)

    return files.select("path", "text").mapInPandas(parse, ROWS)


class _Table(HTMLParser):
    """Cells of the first table; ``rows`` holds (has header cell, texts)."""

    def __init__(self):
        super().__init__()
        self.rows, self.depth, self.done, self.cell = [], 0, False, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        if self.done or not self.depth:
            return
        if tag == "tr":
            self.rows.append([False, []])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1][0] |= tag == "th"
            self.cell = []
            self.rows[-1][1].append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None
        elif tag == "table" and self.depth:
            self.depth -= 1
            self.done |= not self.depth

    def handle_data(self, data):
        if self.cell is not None and data.strip():
            self.cell.append(data.strip())


def html_table_rows(files: DataFrame) -> DataFrame:
    """Rows of the first HTML table; a first row without header cells is data."""
    def parse(batches):
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["text"]):
                table = _Table()
                table.feed(text or "")
                rows = [(head, [" ".join(c) for c in cells]) for head, cells in table.rows if cells]
                if not rows:
                    continue
                names = [c or f"col{i}" for i, c in enumerate(rows[0][1])]
                data = rows[1:] if rows[0][0] else rows
                out.extend((path, i, names, dict(zip(names, cells))) for i, (_, cells) in enumerate(data))
                if len(out) >= EMIT:
                    yield _frame(out)
                    out = []
            yield _frame(out)

    return spread(files.select("path", "text")).mapInPandas(parse, ROWS)


def json_rows(files: DataFrame) -> DataFrame:
    """Objects of a JSON array, or of the first list of objects inside the document."""
    doc = files.select("path", F.try_parse_json("text").alias("v"))
    v = F.col("v")
    objects = lambda c: F.filter(c, is_object)
    members = F.map_values(get(v, "$", "map<string,variant>"))
    lists = F.filter(F.transform(members, lambda m: objects(get(m, "$", LIST))), lambda a: F.size(a) > 0)
    single = F.when(F.coalesce(get(v, "$.text", "variant"), get(v, "$.message", "variant"),
                               get(v, "$.content", "variant")).isNotNull(), F.array(v))
    direct = objects(get(v, "$", LIST))
    inner = F.flatten(F.transform(get(v, "$", LIST), lambda i: F.flatten(F.transform(
        F.map_values(get(i, "$", "map<string,variant>")), lambda m: F.coalesce(
            objects(get(m, "$", LIST)), F.array().cast(LIST))))))
    rows = F.coalesce(F.when(F.size(direct) > 0, direct), F.when(F.size(inner) > 0, inner),
                      F.try_element_at(lists, F.lit(1)), single)
    as_map = F.transform(rows, lambda r: get(r, "$", "map<string,string>"))
    columns = F.array_distinct(F.flatten(F.transform(as_map, F.map_keys)))
    return doc.select("path", columns.alias("columns"), F.posexplode(as_map).alias("row_no", "fields")).select(
        "path", F.col("row_no").cast("int"), "columns", "fields")


def frame_rows(df: DataFrame, path: str) -> DataFrame:
    """A DataFrame with named columns (from ``spark.read.csv/json``) in row shape."""
    entries = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v"))
                                           for c in df.columns]))
    return df.select(F.lit(path).alias("path"), F.lit(0).alias("row_no"),
                     F.array(*[F.lit(c) for c in df.columns]).alias("columns"), entries.alias("fields"))


def detect_fields(rows: DataFrame) -> DataFrame:
    """(path, field) available for mapping, from every row of the file."""
    return rows.select("path", F.explode("columns").alias("field")).distinct()


def pick(names: list[str]) -> Column:
    """The first non-empty value among the aliases, header case and spaces ignored."""
    lowered = F.transform_keys("fields", lambda k, _: F.lower(F.trim(k)))
    return F.coalesce(*[F.nullif(F.try_element_at(lowered, F.lit(n)), F.lit("")) for n in names], F.lit(""))


def _mapped(canonical: str, mapping: dict[str, str] | None) -> Column:
    """Value of the mapped column; without a mapping, of the first alias the file has."""
    if mapping is not None:
        column = mapping.get(canonical)
        return F.try_element_at("fields", F.lit(column)) if column else F.lit(None).cast("string")
    lowered = F.transform("columns", F.lower)
    value = F.lit(None).cast("string")
    for alias in reversed(K.GENERIC_ALIASES[canonical]):
        at = F.array_position(lowered, alias)
        value = F.when(at > 0, F.try_element_at("fields", F.try_element_at("columns", at.cast("int")))).otherwise(value)
    return value


def parse_generic(rows: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Messages from any row-shaped file by column aliases or an explicit mapping."""
    body = clean_text(_mapped("content", mapping))
    sender = clean_text(_mapped("sender", mapping))
    conversation = F.nullif(clean_text(_mapped("conversation", mapping)), F.lit(""))
    key = F.concat(F.lit("chat:"), slug(F.coalesce(conversation, clean_text(file_stem(F.col("path"))))))
    out = rows.select("path", body.alias("content"), sender.alias("sender"),
                      parse_any(_mapped("timestamp", mapping)).alias("sent_at"), key.alias("conversation_id"))
    return out.where("content != ''").select(
        message_id(F.lit("chat"), F.col("conversation_id"), F.col("sent_at"), F.col("sender"), F.col("content")).alias("id"),
        "conversation_id", F.coalesce(F.nullif("sender", F.lit("")), F.lit("unknown")).alias("sender_label"),
        "sent_at", "content", no_attachments().alias("attachments"),
        F.lit(None).cast("string").alias("reply_to"), F.lit("chat").alias("source"), "path")


def _people_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[,;]"), clean_text), lambda p: p != "")


def parse_email_rows(rows: DataFrame) -> DataFrame:
    a = K.EMAIL_ALIASES
    sender = pick(a["from"])
    inside = F.regexp_extract(sender, r"<([^<>\s]+@[^<>\s]+)>", 1)
    address = F.lower(F.coalesce(F.nullif(inside, F.lit("")), sender))
    out = rows.select("path", sender.alias("from_label"), address.alias("from_address"),
                      _people_list(pick(a["to"])).alias("to"), clean_text(pick(a["subject"])).alias("subject"),
                      clean_text(pick(a["body"])).alias("body"), parse_iso(pick(a["date"])).alias("sent_at"))
    return with_email_id(out.where("body != '' OR subject != ''"))


def with_email_id(rows: DataFrame) -> DataFrame:
    when = F.coalesce(F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss"), F.lit("None"))
    return rows.withColumn("id", F.concat(F.lit("eml-"), deterministic_id(
        F.col("from_address"), F.col("subject"), when, F.col("body"))))


def parse_calendar_rows(rows: DataFrame) -> DataFrame:
    a = K.CALENDAR_ALIASES
    out = rows.select("path", clean_text(pick(a["title"])).alias("title"), parse_iso(pick(a["start"])).alias("starts_at"),
                      parse_iso(pick(a["end"])).alias("ends_at"), clean_text(pick(a["location"])).alias("location"),
                      clean_text(pick(a["description"])).alias("description"),
                      _people_list(pick(a["participants"])).alias("participants"))
    when = F.coalesce(F.date_format("starts_at", "yyyy-MM-dd HH:mm:ss"), F.lit("None"))
    return out.where("title != ''").withColumn("id", F.concat(F.lit("cal-"), deterministic_id(
        F.col("title"), when, F.col("location"), file_stem(F.col("path")))))


def parse_contact_rows(rows: DataFrame) -> DataFrame:
    a = K.CONTACT_ALIASES
    full = F.trim(F.concat_ws(" ", F.nullif(pick(a["first"]), F.lit("")), F.nullif(pick(a["last"]), F.lit(""))))
    nickname = F.filter(F.array(clean_text(pick(a["nickname"]))), lambda n: n != "")
    handles = F.filter(F.array(*[F.struct(F.lit(h).alias("kind"), F.regexp_replace(pick([h]), "^@+", "").alias("value"))
                                 for h in K.CONTACT_HANDLES]), lambda h: h["value"] != "")
    out = rows.select("path", clean_text(F.coalesce(F.nullif(pick(a["name"]), F.lit("")), full)).alias("name"),
                      norm_phone(pick(a["phone"])).alias("phone"), norm_email(pick(a["email"])).alias("email"),
                      clean_text(pick(a["organization"])).alias("organization"), nickname.alias("aliases"),
                      handles.alias("usernames"))
    return out.where("name != '' OR phone != '' OR email != ''")
