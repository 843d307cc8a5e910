"""Citations, evidence headers and how an item was matched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rapport import constants as K


def matched_by(vector_rank: Column, keyword_rank: Column) -> Column:
    return (F.when(vector_rank.isNotNull() & keyword_rank.isNotNull(), "hybrid")
            .when(vector_rank.isNotNull(), "semantic")
            .when(keyword_rank.isNotNull(), "keyword")
            .otherwise("none"))


def _cited(answer: Column, labels: Column) -> Column:
    groups = F.regexp_extract_all(answer, F.lit(K.CITATION), F.lit(1))
    return F.transform(groups, lambda g: F.filter(
        F.split(g, r"\s*,\s*"), lambda label: F.array_contains(labels, label)))


def used_labels(answer: Column, labels: Column) -> Column:
    """Existing labels the answer cites, in order of first use."""
    return F.array_distinct(F.flatten(_cited(answer, labels)))


def clean_citations(answer: Column, labels: Column) -> Column:
    """The answer with citations of unknown labels removed."""
    pieces = F.split(answer, K.CITATION, -1)
    marks = F.transform(_cited(answer, labels), lambda good: F.when(
        F.size(good) > 0, F.concat(F.lit("["), F.array_join(good, ", "), F.lit("]"))).otherwise(""))
    joined = F.array_join(F.zip_with(pieces, marks, lambda text, mark: F.concat(
        F.coalesce(text, F.lit("")), F.coalesce(mark, F.lit("")))), "")
    return F.regexp_replace(joined, "[ \t]{2,}", " ")


def evidence_entry(label, source, kind, occurred_at, person_name, text) -> Column:
    """'[S1] email message | 2024-01-02 10:00 | person: Ann' and the quoted text."""
    when = F.coalesce(F.date_format(occurred_at, "yyyy-MM-dd HH:mm"), F.lit("unknown"))
    header = F.concat(F.lit("["), label, F.lit("] "), source, F.lit(" "), kind, F.lit(" | "), when)
    person = F.when(person_name.isNotNull(), F.concat(F.lit(" | person: "), person_name)).otherwise("")
    return F.concat(header, person, F.lit('\n"'), text, F.lit('"'))
