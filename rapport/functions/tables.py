"""Table functions for SQL users: ``SELECT ... FROM files, LATERAL parse_chat(text)``.

The DataFrame forms (``sources.chat_text``, ``operators.timeline.document_chunks``) are native and give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from rapport import constants as K
from rapport.sources.chat_text import HEADER, HEADER_PARTS

_START = re.compile(rf"^(?={HEADER})", re.ASCII | re.MULTILINE)
_PARTS = re.compile(HEADER_PARTS, re.ASCII)
_BREAK = re.compile(K.LINE_BREAK)
_SPACE = re.compile(K.WS_CLASS + "+")
_MARKS = re.compile("[\u200b\ufeff]")
_NOTICE = re.compile(K.CHAT_SYSTEM_VERBS, re.ASCII)


def _sender(line: str) -> str | None:
    """The name before a line's first colon, None for notices, addresses and clock times."""
    name, colon, _ = line.partition(":")
    name = name.strip()
    if not colon or not 0 < len(name) < 100 or re.fullmatch("[0-9]+", name):
        return None
    address = "://" in name or name.lower().startswith(("www.", "http"))
    return None if address or _NOTICE.search(line) else name


class ParseChat:
    """Entries of a chat export in their order: number from 0, date and time as written, sender (NULL for notices) and
    body with its continuation lines. A NULL text, or one without a message header, has none."""

    def eval(self, text: str) -> Iterator[tuple]:
        number = 0
        for entry in _START.split(_BREAK.sub("\n", text or "")):
            head = _PARTS.match(entry)
            if head is None:
                continue
            line, newline, more = entry[head.end():].partition("\n")
            sender = _sender(line)
            said = line if sender is None else line.partition(":")[2]
            yield number, head[1], head[2], sender, (said.strip() + newline + more).strip()
            number += 1


class TextChunks:
    """Pieces of ``width`` characters that cover the whole cleaned text; none for an empty or NULL text."""

    def eval(self, text: str, width: int) -> Iterator[tuple]:
        if width is None or width < 1:
            raise ValueError("chunks need a width of at least 1")
        clean = _SPACE.sub(" ", _MARKS.sub("", text or "")).strip(" ")
        for number, first in enumerate(range(0, len(clean), width)):
            yield number, clean[first:first + width]


def register_table_functions(spark: SparkSession) -> None:
    """Make ``parse_chat(text)`` and ``text_chunks(text, width)`` known to the session's SQL."""
    spark.udtf.register("parse_chat", udtf(ParseChat, returnType=(
        "entry_no int, sent_date string, sent_time string, sender string, body string"), useArrow=True))
    spark.udtf.register("text_chunks", udtf(TextChunks, returnType="chunk_no int, chunk string", useArrow=True))
