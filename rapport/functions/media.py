"""File names and media kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rapport import constants as K
from rapport.functions.text import lit_map, strip


def extension(name: Column) -> Column:
    """Lower-case suffix with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def sanitize_filename(name: Column) -> Column:
    """No path, no control or reserved characters, no leading dots, bounded length."""
    text = basename(F.regexp_replace(F.coalesce(name, F.lit("")), r"\x00", ""))
    text = F.regexp_replace(text, r"[\r\n\t]", "")
    text = F.regexp_replace(strip(F.regexp_replace(text, r'[<>:"|?*]', "_")), r"^\.+", "")
    text = F.when(text == "", F.lit("unnamed")).otherwise(text)
    reserved = F.upper(stem_of(text)).isin(K.RESERVED_FILE_STEMS)
    return F.substring(F.when(reserved, F.concat(F.lit("_"), text)).otherwise(text), 1, K.FILENAME_MAX)


def media_filename_key(name: Column) -> Column:
    """Lookup key under which a referenced file name meets the stored one."""
    visible = F.regexp_replace(strip(F.coalesce(name, F.lit(""))), K.INVISIBLE_MARKS, "")
    return F.lower(sanitize_filename(visible))


def media_kind(name: Column) -> Column:
    """Kind from the name prefix (IMG-, PTT-, ...), else from the extension."""
    kinds = lit_map({ext: kind for ext, (kind, _) in K.MEDIA_TYPES.items()})
    base = basename(name)
    prefix = F.regexp_extract(F.upper(base), "^(" + "|".join(K.MEDIA_PREFIX_KINDS) + ")[-_]", 1)
    return F.coalesce(F.try_element_at(lit_map(K.MEDIA_PREFIX_KINDS), prefix),
                      F.try_element_at(kinds, extension(base)), F.lit(K.MEDIA_DEFAULT[0]))


def media_mime(name: Column) -> Column:
    mimes = lit_map({ext: mime for ext, (_, mime) in K.MEDIA_TYPES.items()})
    return F.coalesce(F.try_element_at(mimes, extension(basename(name))), F.lit(K.MEDIA_DEFAULT[1]))
