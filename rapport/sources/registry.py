"""Which parser reads which file, and the fallback order when nothing names one."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rapport.functions.text import nfc
from rapport.operators.hooks import PARSERS
from rapport.sources import chat_json, chat_text, records, tabular
from rapport.sources.files import with_text

Parser = Callable[[DataFrame], DataFrame]
Keep = Callable[[str, DataFrame], DataFrame]

_ATTACHMENTS = "array<struct<kind:string,filename:string,filename_key:string,label:string>>"
SHAPES = {
    "messages": "id string, conversation_id string, sender_label string, sent_at timestamp_ntz, content string, "
                f"attachments {_ATTACHMENTS}, reply_to string, source string, path string",
    "emails": "id string, from_label string, from_address string, to array<string>, subject string, body string, "
              "sent_at timestamp_ntz, path string",
    "calendar": "id string, title string, starts_at timestamp_ntz, ends_at timestamp_ntz, location string, "
                "description string, participants array<string>, path string",
    "contacts": "name string, phone string, email string, organization string, aliases array<string>, "
                "usernames array<struct<kind:string,value:string>>, path string",
    "notes": "id string, person_id string, title string, body string, noted_at timestamp_ntz, path string",
    "documents": "id string, filename string, title string, text string, mime_type string, path string",
}


#: Columns with people's names: composed, so that one name is one string.
NAMES = {"messages": "sender_label", "emails": "from_label", "contacts": "name"}


def _docx(files: DataFrame) -> DataFrame:
    rows = records.docx_text(files).where("docx_text != ''").select(
        "path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("docx_title").alias("title"),
        F.col("docx_text").alias("text"), F.lit(".docx").alias("mime_type"))
    return records.with_document_id(rows)


# name -> (table, parser)
CATALOGUE: dict[str, tuple[str, Parser]] = {
    "chat": ("messages", chat_text.parse_chat),
    "transcript": ("messages", chat_text.parse_transcript),
    "telegram": ("messages", chat_json.parse_telegram),
    "instagram": ("messages", chat_json.parse_instagram),
    "x": ("messages", lambda f: chat_json.parse_x(f, chat_json.x_users(f))),
    "generic_json": ("messages", lambda f: tabular.parse_generic(tabular.json_rows(f))),
    "generic_csv": ("messages", lambda f: tabular.parse_generic(tabular.csv_rows(f))),
    "generic_html": ("messages", lambda f: tabular.parse_generic(tabular.html_table_rows(f))),
    "email_files": ("emails", lambda f: records.parse_email_files(f).where("error is null")),
    "email_csv": ("emails", lambda f: tabular.parse_email_rows(tabular.csv_rows(f))),
    "email_json": ("emails", lambda f: tabular.parse_email_rows(tabular.json_rows(f))),
    "ics": ("calendar", records.parse_ics),
    "calendar_csv": ("calendar", lambda f: tabular.parse_calendar_rows(tabular.csv_rows(f))),
    "vcf": ("contacts", records.parse_vcf),
    "contacts_csv": ("contacts", lambda f: tabular.parse_contact_rows(tabular.csv_rows(f))),
    "notes": ("notes", records.parse_notes),
    "documents": ("documents", records.parse_documents),
    "docx": ("documents", _docx),
}

# What a named source reads, by extension.
NAMED = {
    "whatsapp": {".txt": "chat"}, "telegram": {".json": "telegram"},
    "instagram": {".json": "instagram", ".txt": "instagram"}, "x": {".json": "x", ".js": "x"},
    "email": {".csv": "email_csv", ".json": "email_json"}, "calendar": {".csv": "calendar_csv"},
    "contacts": {".csv": "contacts_csv"}, "notes": {".txt": "notes", ".md": "notes"},
    "document": {e: "documents" for e in (".txt", ".md", ".html", ".htm", ".csv", ".json")},
}
# What is tried, in order, when the source does not decide.
FALLBACK = {
    ".txt": ("chat", "transcript"), ".md": ("chat", "transcript"),
    ".json": ("telegram", "instagram", "x", "generic_json"), ".js": ("x",),
    ".csv": ("contacts_csv", "calendar_csv", "email_csv", "generic_csv"),
    ".html": ("generic_html", "documents"), ".htm": ("generic_html", "documents"),
    ".eml": ("email_files",), ".mbox": ("email_files",), ".ics": ("ics",), ".vcf": ("vcf",), ".docx": ("docx",),
}


def chain_for(source: str | None, ext: str) -> tuple[str, ...]:
    """Parser names for a file, first choice first; empty for media."""
    if ext in PARSERS:
        return (f"registered {ext}",)
    named = NAMED.get(source or "", {}).get(ext)
    return (named,) if named else FALLBACK.get(ext, ())


def _as_is(_: str, rows: DataFrame) -> DataFrame:
    return rows


def parse_all(files: DataFrame, keep: Keep = _as_is) -> dict[str, DataFrame]:
    """Typed rows of admitted files (path, content, source, ext, modificationTime).

    Only the formats present are parsed (source and extension come from fixed
    lists, so there are a few dozen combinations at most). In a chain, files that
    gave the first parser no row go on to the next. ``keep`` may store each
    parser's rows and hand back the stored table."""
    groups: dict[tuple[str, ...], list[tuple[str, str]]] = defaultdict(list)
    for row in files.select(F.coalesce("source", F.lit("")).alias("source"), "ext").distinct().collect():
        groups[chain_for(row.source, row.ext)].append((row.source, row.ext))
    texts = with_text(files).withColumn("_kind", F.concat_ws("|", F.coalesce("source", F.lit("")), F.col("ext")))
    found: dict[str, list[DataFrame]] = defaultdict(list)
    for number, (chain, kinds) in enumerate(sorted(groups.items())):
        rest = texts.where(F.col("_kind").isin([f"{s}|{e}" for s, e in kinds]))
        for name in chain:
            table, parser = CATALOGUE.get(name) or ("messages", PARSERS[name.split(" ")[1]])
            columns = [c.split(" ")[0] for c in _columns(SHAPES[table])]
            own = parser(rest)
            if table in NAMES:
                own = own.withColumn(NAMES[table], nfc(F.col(NAMES[table])))
            rows = keep(f"{number}-{name}".replace(" ", "-"), own.select(*columns))
            found[table].append(rows)
            if name != chain[-1]:
                rest = rest.join(rows.select("path").distinct(), "path", "left_anti")
    out = {}
    for table, shape in SHAPES.items():
        rows = files.sparkSession.createDataFrame([], shape)
        for part in found[table]:
            rows = rows.unionByName(part)
        out[table] = rows
    return out


def _columns(ddl: str) -> list[str]:
    from rapport.sinks.tables import split_ddl

    return [f.strip() for f in split_ddl(ddl)]
