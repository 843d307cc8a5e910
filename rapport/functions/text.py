"""Text clean-up, names, identifiers, labels and trimming."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rapport import constants as K


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lit_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it
    inside a lambda (Spark would otherwise evaluate it there for every element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def java_quote(text: str) -> str:
    """Escape every regex metacharacter, for patterns assembled from fixed values."""
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}-/" else ch for ch in text)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{K.WS_CLASS}+|{K.WS_CLASS}+$", "")


def clean_text(c: Column) -> Column:
    """Drop zero-width marks, collapse whitespace, trim; NULL becomes ''."""
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[\u200b\ufeff]", "")
    return F.trim(F.regexp_replace(text, K.WS_CLASS + "+", " "))


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def nfc(c: Column) -> Column:
    """Canonical composition. Spark has no built-in for it, so text that holds
    combining marks (or other decomposable letters) goes through one Arrow
    function; everything else is passed to it as NULL and kept as it is."""
    needs = F.when(c.rlike(r"[\p{M}ᄀ-ᇿKÅΩ]"), c)
    return F.coalesce(_nfc(needs), c)


def repair_mojibake(c: Column, rounds: int = 1) -> Column:
    """Undo UTF-8 that was decoded as Latin-1; text that is not such a mistake
    comes back unchanged. ``rounds`` repeats the repair for doubly broken text."""

    # Every non-ASCII UTF-8 sequence has continuation bytes 0x80-0xBF, so text
    # without such characters cannot be the mistake.
    suspicious = c.rlike(r"[\x80-\xBF]")

    def once(text: Column) -> Column:
        candidate = F.when(
            text.rlike(r"[\x80-\xBF]") & text.rlike(r"^[\x00-\xFF]*$"),
            F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string")),
        )
        fixed = F.when((candidate != "") & ~candidate.contains("\ufffd"), candidate)
        return F.coalesce(fixed, text)

    if rounds == 1:
        return once(c)
    return F.when(suspicious, F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), c, lambda acc, _: once(acc))).otherwise(c)


def norm_name(c: Column) -> Column:
    """Lower-case ASCII letters and digits, single spaces between runs."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def norm_name_unicode(c: Column) -> Column:
    """Mojibake repaired, letters and digits of any script kept, punctuation dropped."""
    kept = F.regexp_replace(
        F.lower(repair_mojibake(F.coalesce(c, F.lit("")), rounds=4)), r"[^\p{L}\p{N}\s]", ""
    )
    return F.trim(F.regexp_replace(kept, K.WS_CLASS + "+", " "))


def duplicate_key(c: Column) -> Column:
    """Two names with the same key differ in punctuation, case or encoding only."""
    return F.regexp_replace(
        F.lower(repair_mojibake(F.coalesce(c, F.lit("")))), K.NON_WORD_CLASS, ""
    )


def norm_phone(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def norm_email(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def norm_username(c: Column) -> Column:
    """Profile-URL prefixes fall off one after another, then outer slashes."""
    name = norm_email(c)
    for prefix in K.USERNAME_PREFIXES:
        name = F.regexp_replace(name, "^" + java_quote(prefix), "")
    return F.regexp_replace(name, "^/+|/+$", "")


def deterministic_id(*parts: Column) -> Column:
    """32 hex digits of SHA-256 over the parts; NULL counts as empty."""
    joined = F.concat_ws(
        K.ID_SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    )
    return F.substring(F.sha2(joined, 256), 1, 32)


def iso_utc(ts: Column) -> Column:
    """ISO text of a UTC timestamp, microseconds only when there are any."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(base, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
                    F.lit("+00:00"))


def message_id(source, conversation, sent_at, sender, content) -> Column:
    when = F.coalesce(iso_utc(sent_at), F.lit("unknown-time"))
    return F.concat(F.lit("msg-"), deterministic_id(source, conversation, when, sender, content))


def conversation_key(source: Column, participants: Column) -> Column:
    """source + ':' + the sorted lower-case participants joined by '|'."""
    names = F.array_sort(F.transform(F.filter(participants, lambda p: p != ""), F.lower))
    return F.concat(source, F.lit(":"), F.array_join(names, "|"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def trim_at_word(c: Column, limit: int) -> Column:
    """Cut to ``limit`` characters at a word boundary when one lies beyond 60 %."""
    cut = F.substring(c, 1, limit)
    tail = F.instr(F.reverse(cut), " ")
    space = limit - tail                       # zero-based position of the last space
    shorter = F.when((tail > 0) & (space > limit * 0.6),
                     F.substring(cut, F.lit(1), space)).otherwise(cut)
    right_stripped = F.regexp_replace(shorter, K.WS_CLASS + "+$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(right_stripped, F.lit("…")))


def citation(source: Column, when: Column, extra: Column | None = None) -> Column:
    """'Source — extra — Jan 02, 2024 10:00' or '… — undated'."""
    label = F.coalesce(F.try_element_at(lit_map(K.SOURCE_LABELS), source), F.initcap(source))
    stamp = F.coalesce(F.date_format(when, "MMM dd, yyyy HH:mm"), F.lit("undated"))
    extra = F.nullif(extra, F.lit("")) if extra is not None else F.lit(None).cast("string")
    return F.concat_ws(" — ", label, extra, stamp)


def natural_key(c: Column) -> Column:
    """Sort key under which embedded numbers compare as numbers ('x2' < 'x10').

    Every digit run is written as a low separator, its length and its digits
    without leading zeros, so plain string comparison orders runs by value;
    names that begin with a digit go after names that begin with anything else.
    """
    low = F.lower(c)
    pieces = F.regexp_extract_all(low, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def piece(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(p.rlike("^[0-9]"),
                      F.concat(F.lit("\u0001"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits)
                      ).otherwise(p)

    last = F.when(low.rlike("^[0-9]"), F.lit("￿")).otherwise(F.lit(""))
    return F.concat(last, F.array_join(F.transform(pieces, piece), ""))


def starts_with_digit(c: Column) -> Column:
    """True when the first letter-or-digit of the name is a digit."""
    return F.coalesce(c, F.lit("")).rlike(r"^[^\p{L}\p{N}]*\p{N}")


def is_user_label(c: Column, user_labels=K.USER_LABELS) -> Column:
    return norm_name(c).isin([_norm(n) for n in user_labels])


def is_placeholder_label(c: Column) -> Column:
    """Deleted accounts, one-character labels and labels without letters or digits."""
    core = strip(F.coalesce(c, F.lit("")))
    return ((F.length(core) < 2) | ~core.rlike(r"[\p{L}\p{N}]")
            | norm_name(core).isin(K.PLACEHOLDER_LABELS))


def _norm(name: str) -> str:
    return " ".join("".join(ch if ch.isascii() and ch.isalnum() else " "
                            for ch in name.lower()).split())


def html_to_text(c: Column) -> Column:
    """Visible text: scripts, styles, comments and tags dropped, common
    entities decoded, whitespace collapsed."""
    text = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    return clean_text(decode_entities(text))


def html_title(c: Column) -> Column:
    return clean_text(decode_entities(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)))


def decode_entities(c: Column) -> Column:
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                         ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def sort_name_key(name: Column, person_id: Column) -> list[Column]:
    """Letters before digits, natural order, then the id."""
    return [starts_with_digit(name).cast("int"), natural_key(name), person_id]


def plural(n: Column, singular: Column | str, many: Column | str | None = None) -> Column:
    one = F.lit(singular) if isinstance(singular, str) else singular
    other = F.lit(many) if isinstance(many, str) else many
    return F.when(n == 1, one).otherwise(other if other is not None else F.concat(one, F.lit("s")))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)
