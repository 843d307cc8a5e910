"""Calendars, contacts, documents, notes and e-mail files."""

from __future__ import annotations

import base64
import email
import email.policy
import email.utils
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rapport import constants as K
from rapport.functions.dates import parse_calendar_stamp
from rapport.functions.media import basename, extension
from rapport.functions.text import (clean_text, deterministic_id, html_title, html_to_text, norm_email,
                                    norm_phone, strip)
from rapport.session import spread
from rapport.sources.files import file_stem
from rapport.sources.tabular import with_email_id


def _blocks(text: Column, name: str) -> Column:
    """BEGIN:name ... END:name blocks of an iCalendar or vCard text, lines unfolded."""
    unfolded = F.regexp_replace(text, r"\r?\n[ \t]", "")
    return F.regexp_extract_all(unfolded, F.lit(rf"(?s)BEGIN:{name}\r?\n(.*?)END:{name}"), F.lit(1))


def _line(block: Column, name: str) -> Column:
    """Unescaped value of a property line, '' when it is missing."""
    raw = F.regexp_extract(block, rf"(?mi)^(?:[\w-]+\.)?{name}(?:;[^:\n\r]*)?:([^\r\n]*)", 1)
    return _unescape(raw)


def _unescape(raw: Column) -> Column:
    for code, char in ((r"\n", "\n"), (r"\N", "\n"), (r"\,", ","), (r"\;", ";"), (r"\\", "\\")):
        raw = F.replace(raw, F.lit(code), F.lit(char))
    return raw


def parse_ics(files: DataFrame) -> DataFrame:
    """Events of iCalendar files (path, text)."""
    rows = files.select("path", F.explode(_blocks(F.col("text"), "VEVENT")).alias("b"))
    b = F.col("b")
    guests = F.regexp_extract_all(b, F.lit(r"(?mi)^(ATTENDEE[^\r\n]*)"), F.lit(1))

    def guest(line: Column) -> Column:
        name = F.regexp_extract(line, r'(?i);CN="?([^";:]*)"?', 1)
        address = F.regexp_replace(F.regexp_extract(line, r"(?i)(mailto:.*)$", 1), "(?i)^mailto:", "")
        return clean_text(F.when(name != "", name).otherwise(address))

    described = F.regexp_extract(_line(b, "DESCRIPTION"), r"(?i)participants?:\s*([^\r\n]+)", 1)
    fallback = F.filter(F.transform(F.split(described, "[,;]"), clean_text), lambda p: p != "")
    out = rows.select(
        "path", clean_text(_line(b, "SUMMARY")).alias("title"), parse_calendar_stamp(_line(b, "DTSTART")).alias("starts_at"),
        parse_calendar_stamp(_line(b, "DTEND")).alias("ends_at"), clean_text(_line(b, "LOCATION")).alias("location"),
        clean_text(_line(b, "DESCRIPTION")).alias("description"),
        F.when(F.size(guests) > 0, F.transform(guests, guest)).otherwise(fallback).alias("participants"))
    when = F.coalesce(F.date_format("starts_at", "yyyy-MM-dd HH:mm:ss"), F.lit("None"))
    return out.withColumn("id", F.concat(F.lit("cal-"), deterministic_id(F.col("title"), when, F.col("location")))
                          ).withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)")))


def parse_vcf(files: DataFrame) -> DataFrame:
    """Contacts of vCard files (path, text)."""
    rows = files.select("path", F.explode(_blocks(F.col("text"), "VCARD")).alias("b"))
    b = F.col("b")
    parts = F.split(_line(b, "N"), ";")
    given = clean_text(F.concat_ws(" ", F.get(parts, 1), F.get(parts, 0)))
    nicknames = F.filter(F.transform(F.split(_line(b, "NICKNAME"), ","), clean_text), lambda n: n != "")
    out = rows.select(
        "path", F.coalesce(F.nullif(clean_text(_line(b, "FN")), F.lit("")), given).alias("name"),
        norm_phone(_line(b, "TEL")).alias("phone"), norm_email(_line(b, "EMAIL")).alias("email"),
        clean_text(F.get(F.split(_line(b, "ORG"), ";"), 0)).alias("organization"),
        F.array_distinct(nicknames).alias("aliases"),
        F.array().cast("array<struct<kind:string,value:string>>").alias("usernames"))
    return (out.withColumn("aliases", F.array_remove("aliases", F.col("name")))
            .where("name != '' OR phone != '' OR email != ''"))


def parse_notes(files: DataFrame) -> DataFrame:
    """One note per file (path, text, modificationTime); the title is its first line."""
    text, name = F.col("text"), basename(F.col("path"))
    title = F.coalesce(F.nullif(F.substring(clean_text(F.substring_index(text, "\n", 1)), 1, 120), F.lit("")),
                       file_stem(F.col("path")))
    return files.where(strip(text) != "").select(
        F.concat(F.lit("note-"), deterministic_id(name, text)).alias("id"),
        F.lit(None).cast("string").alias("person_id"), title.alias("title"), strip(text).alias("body"),
        F.col("modificationTime").cast("timestamp_ntz").alias("noted_at"), "path")


def _first_line(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, K.LINE_BREAK), lambda line: strip(
        F.regexp_replace(strip(line), "^#+", ""))), lambda line: line != "")
    return F.substring(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), 1, 120)


_DOCX = "path string, content binary, docx_title string, docx_text string, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(files: DataFrame) -> DataFrame:
    """(path, docx_title, docx_text, error): paragraphs of Word files, one per line."""
    def read(content) -> tuple[str, str]:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
        paragraphs = ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p")]
        kept = [p for p in paragraphs if p.strip()]
        return (paragraphs[0].strip()[:120] if kept else ""), "\n".join(kept).strip()

    def parse(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out.append((path, *read(content), None))
                except Exception as e:  # one bad file is a row, not a failed job
                    out.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "docx_title", "docx_text", "error"])

    return files.select("path", "content").mapInPandas(
        parse, "path string, docx_title string, docx_text string, error string")


def parse_documents(files: DataFrame) -> DataFrame:
    """(id, filename, title, text, mime_type) for text, Markdown, HTML, CSV and JSON
    files (path, text)."""
    ext, text, stem = extension(basename(F.col("path"))), F.col("text"), file_stem(F.col("path"))
    is_html = ext.isin(".html", ".htm")
    title = (F.when(is_html, F.coalesce(F.nullif(html_title(text), F.lit("")), stem))
             .when(ext.isin(".txt", ".md"), F.coalesce(F.nullif(_first_line(text), F.lit("")), stem)).otherwise(stem))
    out = files.select("path", basename(F.col("path")).alias("filename"), title.alias("title"),
                       F.when(is_html, html_to_text(text)).otherwise(strip(text)).alias("text"), ext.alias("mime_type"))
    return with_document_id(out)


def with_document_id(rows: DataFrame) -> DataFrame:
    return rows.where("text != ''").withColumn("id", F.concat(F.lit("doc-"), deterministic_id(
        F.col("filename"), F.col("text"))))


# -- e-mail ---------------------------------------------------------------------------------

EMAIL_ROWS = ("path string, from_label string, from_address string, to array<string>, subject string, body string, "
              "sent_at timestamp, attachments array<struct<kind:string,label:string,size:bigint>>, error string")


def _text_of(part) -> str:
    """The text of a part, whatever its declared character set is worth."""
    try:
        content = part.get_content()
    except (LookupError, KeyError):
        content = part.get_payload(decode=True) or b""
    return content.decode("utf-8", "replace") if isinstance(content, bytes) else str(content)


def _files_in(part) -> Iterator[tuple[str, int]]:
    """Name and decoded size of every named part, at any depth, in the order of the message."""
    name = part.get_filename()
    if name:
        held = part.get_payload(decode=True)
        yield name, 0 if held is None else len(held)
    if part.is_multipart():
        for inner in part.iter_parts():
            yield from _files_in(inner)


_ATOM = r"[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*"
_ADDRESS = rf"{_ATOM}@{_ATOM}"
_HEAD = re.compile(rb"((?:[A-Za-z][A-Za-z0-9-]*: ?[\x21-\x7e](?:[\x20-\x7e]*[\x21-\x7e])?\n)+)\n([\x20-\x7e\t\n]*)")
_FROM = re.compile(rf"(?:[A-Za-z0-9]+(?: [A-Za-z0-9]+)* <({_ADDRESS})>|({_ADDRESS}))", re.ASCII)
_TO = re.compile(rf"{_ADDRESS}(?:, {_ADDRESS})*", re.ASCII)
_ENCODED = re.compile(r"=\?utf-8\?[bB]\?((?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?)\?=", re.ASCII)
_DATE = re.compile(r"(?:[A-Z][a-z]{2}, )?[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}", re.ASCII)


def _plain_email(content: bytes) -> tuple | None:
    """From as written, its address, To, Subject, body and date of a plain message, None for any other.

    Plain is an ASCII message of one part whose header lines are not folded, with simple addresses and a subject that is
    plain or one encoded word. Read so, it gives what :func:`_read_email` gets from the library, in a twentieth of the time."""
    parts = _HEAD.fullmatch(content)
    if parts is None:
        return None
    held: dict[str, str] = {}
    for line in parts[1].decode("ascii").splitlines():
        name, _, value = line.partition(":")
        name = name.lower()
        if name in held or name.startswith(("content-", "mime-")):
            return None
        held[name] = value.removeprefix(" ")
    sender, to, subject, date = (held.get(name, "") for name in ("from", "to", "subject", "date"))
    named, encoded = _FROM.fullmatch(sender), _ENCODED.fullmatch(subject)
    if (sender and named is None) or (to and _TO.fullmatch(to) is None) or (date and _DATE.fullmatch(date) is None):
        return None
    if encoded is not None:
        try:
            subject = base64.b64decode(encoded[1]).decode("utf-8")
        except UnicodeDecodeError:
            return None
        if subject and not subject.isprintable():
            return None
    elif "=?" in subject:
        return None
    address = (named[1] or named[2]).lower() if named else ""
    return sender, address, to.split(", ") if to else [], " ".join(subject.split()), parts[2].decode("ascii"), date


def _instant(date: str):
    """The moment of a date header in UTC, None when it is none."""
    try:
        sent = pd.Timestamp(email.utils.parsedate_to_datetime(date))
        return sent.tz_convert("UTC").tz_localize(None) if sent.tzinfo else sent
    except Exception:
        return None


def _read_email(path: str, content: bytes) -> tuple:
    """One message by the standard library's modern policy: it decodes headers, picks the
    body and finds the attachments. Plain messages need no such parser."""
    plain = _plain_email(content)
    if plain is not None:
        *fields, date = plain
        return (path, *fields, _instant(date), [], None)
    message = email.message_from_bytes(content, policy=email.policy.default)
    header = lambda name: " ".join(str(message.get(name, "")).split())
    sender = header("From")
    body = message.get_body(("plain", "html"))
    text = _text_of(body) if body is not None else ""
    if body is not None and body.get_content_subtype() == "html":
        text = re.sub("<[^>]+>", " ", text)
    files = [dict(zip(("kind", "label", "size"), ("attachment", *file))) for file in _files_in(message)]
    to = [entry.strip() for field in message.get_all("To", []) for entry in re.split("[,;]", " ".join(str(field).split()))]
    return (path, sender, email.utils.parseaddr(sender)[1].lower(), [entry for entry in to if entry],
            header("Subject"), text, _instant(str(message["Date"])), files, None)


def parse_email_files(files: DataFrame) -> DataFrame:
    """E-mails of .eml and .mbox files (path, content).

    Mailboxes are cut into messages natively (Latin-1 keeps every byte), so a big
    mailbox spreads over the cluster; only single messages reach Python."""
    box = F.decode("content", "ISO-8859-1")
    pieces = F.filter(F.split(box, r"(?m)^From [^\n]*\n"), lambda p: p.rlike(r"\S"))
    is_box = extension(basename(F.col("path"))) == ".mbox"
    single = files.where(~is_box).select("path", "content")
    boxed = files.where(is_box).select("path", F.explode(pieces).alias("t")).select(
        "path", F.encode("t", "ISO-8859-1").alias("content"))

    def parse(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out.append(_read_email(path, bytes(content)))
                except Exception as e:  # one bad message is a row, not a failed job
                    out.append((path, "", "", [], "", "", None, [], f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(out, columns=["path", "from_label", "from_address", "to", "subject", "body",
                                               "sent_at", "attachments", "error"])
            frame["sent_at"] = pd.to_datetime(frame["sent_at"])
            yield frame

    rows = spread(single.unionByName(boxed)).mapInPandas(parse, EMAIL_ROWS)
    rows = rows.withColumns({"sent_at": F.col("sent_at").cast("timestamp_ntz"), "body": clean_text(F.col("body"))})
    return with_email_id(rows).where("error is not null OR body != '' OR subject != '' OR size(attachments) > 0")
