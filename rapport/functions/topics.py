"""Search terms, topic extraction and the noise rules for topics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rapport import constants as K
from rapport.functions.text import let, norm_name_unicode

_FILLER = sorted(set(K.TOPIC_STOPWORDS + K.TOPIC_CHAT_FILLER + K.TOPIC_SYSTEM_EVENTS
                     + K.TOPIC_FILLER_STEMS))
_FILLER_PHRASES = sorted(set(K.TOPIC_STOPWORDS + K.TOPIC_CHAT_FILLER + K.TOPIC_SYSTEM_EVENTS))


def stem(w: Column) -> Column:
    """Crude suffix removal for words longer than five letters; the longest suffix goes.

    By ends, not by a pattern: this runs for every word of every text."""
    ends = F.when(F.length(w) <= 5, w)
    for suffix in K.STEM_SUFFIXES:
        ends = ends.when(w.endswith(suffix), F.substring(w, F.lit(1), F.length(w) - len(suffix)))
    return ends.otherwise(w)


def words(c: Column) -> Column:
    """Lower-case words (letters, digits, underscore) of a text, in order."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), K.NON_WORD_CLASS + "+"),
                    lambda w: w != "")


def content_terms(c: Column) -> Column:
    """Meaningful stemmed search terms of a question, distinct, in order."""
    kept = F.filter(
        words(c),
        lambda w: ~w.isin(K.SEARCH_STOPWORDS) & (F.length(w) >= 3) & ~w.rlike(r"^\p{N}+$"),
    )
    return F.array_distinct(F.transform(kept, stem))


def runs(tokens: Column, more_than_once: bool = False) -> Column:
    """Groups of equal tokens as 'w w w' strings, found in one linear pass over
    the sorted tokens (tokens must not contain spaces)."""
    text = F.array_join(F.array_sort(tokens), " ")
    times = "++" if more_than_once else "*+"
    return F.regexp_extract_all(text, F.lit(rf"(?<!\S)(\S++)(?: \1(?!\S)){times}"), F.lit(0))


def run_word(run: Column) -> Column:
    return F.substring_index(run, " ", 1)


def run_count(run: Column) -> Column:
    return ((F.length(run) + 1) / (F.length(run_word(run)) + 1)).cast("bigint")


def is_filler(phrase: Column) -> Column:
    """The phrase is a known filler, or consists of filler words only."""
    low = F.lower(F.trim(phrase))
    parts = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    return low.isin(_FILLER_PHRASES) | F.forall(parts, lambda w: w.isin(_FILLER))


def is_noise_topic(phrase: Column, person_names: Column | None = None) -> Column:
    """Not a subject: too short, filler, or naming somebody in ``person_names``
    (an array of lower-case names and name tokens)."""
    low = F.lower(F.trim(phrase))
    noise = (F.length(low) < 3) | is_filler(low)
    if person_names is not None:
        parts = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
        noise = noise | F.coalesce(F.arrays_overlap(parts, person_names), F.lit(False))
    return noise


def name_tokens(display_name: Column, aliases: Column) -> Column:
    """Lower-case full names and their ASCII tokens of three or more characters."""
    names = F.filter(
        F.transform(F.concat(F.array(display_name), F.coalesce(aliases, F.array().cast("array<string>"))),
                    lambda n: F.lower(F.trim(n))),
        lambda n: n.isNotNull() & (n != ""),
    )
    tokens = F.flatten(F.transform(names, lambda n: F.filter(
        F.split(n, "[^a-z0-9]+"), lambda t: F.length(t) >= 3)))
    return F.array_distinct(F.concat(names, tokens))


def extract_topics(text: Column, limit: int = 5) -> Column:
    """Capitalised phrases in order of appearance, then repeated words by count
    (first appearance breaks ties), ``limit`` in all."""
    text = F.coalesce(text, F.lit(""))
    phrases = F.slice(F.array_distinct(F.filter(
        F.regexp_extract_all(text, F.lit(K.TOPIC_PHRASE), F.lit(1)),
        lambda p: ~is_noise_topic(p))), 1, limit)
    tokens = F.filter(F.regexp_extract_all(F.lower(text), F.lit(K.TOPIC_TOKEN), F.lit(0)),
                      lambda w: ~w.isin(_FILLER))
    return let(phrases, lambda found: F.when(F.size(found) >= limit, found).otherwise(
        F.slice(F.concat(found, _repeated_words(tokens, found, limit)), 1, limit)))


def _repeated_words(tokens: Column, phrases: Column, limit: int) -> Column:
    """Words that occur at least twice, by count then first appearance, without
    those already among the phrases."""
    def ranked(inputs: Column) -> Column:
        line = inputs["line"]
        entries = F.transform(inputs["runs"], lambda r: F.struct(
            (-run_count(r)).alias("n"),
            F.instr(line, F.concat(F.lit(" "), run_word(r), F.lit(" "))).alias("at"),
            run_word(r).alias("w")))
        return F.transform(F.slice(F.array_sort(entries), 1, limit * 2), lambda s: s["w"])

    def inputs(t: Column) -> Column:
        line = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
        return F.struct(line.alias("line"), runs(t, more_than_once=True).alias("runs"))

    words_found = let(tokens, lambda t: let(inputs(t), ranked))
    return let(F.transform(phrases, F.lower), lambda low: F.filter(
        words_found, lambda w: ~F.array_contains(low, w)))


def content_terms_desktop(c: Column) -> Column:
    """The other dialect's terms: names normalised, no stemming."""
    return F.array_distinct(F.filter(
        F.split(norm_name_unicode(c), " "),
        lambda w: (F.length(w) >= 3) & ~w.isin(K.DESKTOP_STOPWORDS)))


def extract_topics_desktop(c: Column, limit: int = 8) -> Column:
    """Distinct terms of four or more letters; each counts once, so the order is
    alphabetical."""
    return F.slice(F.array_sort(F.filter(content_terms_desktop(c), lambda w: F.length(w) >= 4)),
                   1, limit)
