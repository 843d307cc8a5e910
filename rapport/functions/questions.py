"""Reading a question: intent, time window, source hint and counted unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rapport import constants as K
from rapport.functions.text import plural, thousands


def _any(q: Column, phrases) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | q.contains(phrase)
    return hit


def _unit_alternatives() -> list[str]:
    return sorted(K.ACTIVITY_UNITS, key=len, reverse=True)


def intent(question: Column) -> Column:
    """One of nine intents; the first rule that applies wins."""
    q = F.lower(question)
    units = r"(?:" + "|".join(_unit_alternatives()) + r")\b"
    windowed = "|".join(pattern for pattern, _ in K.CUTOFF_PATTERNS)
    top_people = "|".join(f"(?:{p})" for p in K.TOP_PEOPLE_PATTERNS)
    counted = q.rlike(K.ACTIVITY_COUNT_LEAD + units) | q.rlike(K.ACTIVITY_TIMES)
    return (
        F.when(_any(q, K.PREPARE_PHRASES), "prepare")
        .when(~q.rlike(K.TOP_PEOPLE_EXCLUDE) & q.rlike(top_people), "top_people")
        .when(_any(q, K.SUMMARY_PHRASES), "summary")
        .when(~q.rlike(K.TOP_TOPICS_EXCLUDE) & q.rlike(K.TOP_TOPICS), "top_topics")
        .when(~q.rlike(K.LAST_INTERACTION_EXCLUDE) & q.rlike(K.LAST_INTERACTION), "last_interaction")
        .when(~q.rlike(K.ACTIVITY_EXCLUDE) & counted, "activity_count")
        .when(q.rlike(K.PEOPLE_COUNT), "people_count")
        .when(q.rlike(windowed) & ~q.rlike(K.RECENT_PEOPLE_EXCLUDE) & q.rlike(K.RECENT_PEOPLE),
              "recent_people")
        .otherwise("ask")
    )


def window_days(question: Column) -> Column:
    """Days of the first matching time window, NULL when the question has none."""
    q = F.lower(question)
    days = F.lit(None).cast("int")
    for pattern, value in reversed(K.CUTOFF_PATTERNS):
        days = F.when(q.rlike(pattern), F.lit(value)).otherwise(days)
    return days


def window_days_free(question: Column) -> Column:
    """The other dialect: any '<n> days|weeks|months|years', else last week/month/year."""
    q = F.lower(question)
    n = F.regexp_extract(q, r"(\d+)\s*(day|week|month|year)", 1).try_cast("int")
    unit = F.regexp_extract(q, r"(\d+)\s*(day|week|month|year)", 2)
    factor = F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).otherwise(365)
    return (F.when(n.isNotNull(), n * factor)
            .when(_any(q, ["last week", "past week"]), 7)
            .when(_any(q, ["last month", "past month"]), 30)
            .when(q.contains("last year"), 365))


def source_hint(question: Column) -> Column:
    """A source named in the question; voice wordings override."""
    q = F.lower(question)
    hint = F.lit(None).cast("string")
    for name in reversed(K.SOURCES):
        hint = F.when(q.rlike(rf"\b{name}\b"), F.lit(name)).otherwise(hint)
    return F.when(_any(q, K.VOICE_HINTS), F.lit("voice")).otherwise(hint)


def activity_unit(question: Column) -> Column:
    """The counted unit named in the question (longest wording first), or NULL."""
    q = F.lower(question)
    unit = F.lit(None).cast("string")
    for name in reversed(_unit_alternatives()):
        unit = F.when(q.rlike(rf"\b{name}\b"), F.lit(name)).otherwise(unit)
    return unit


def activity_kind(question: Column) -> Column:
    """Ledger kind behind the counted unit; NULL counts every kind."""
    kinds = [F.lit(x) for k, v in K.ACTIVITY_UNITS.items() if v for x in (k, v)]
    return F.try_element_at(F.create_map(*kinds), activity_unit(question))


def unit_label(kind: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in K.ACTIVITY_SINGULAR.items() for x in pair])
    return F.when(kind.isNull(), F.lit(K.ACTIVITY_ANY)).otherwise(
        F.coalesce(F.try_element_at(labels, kind), kind))


def window_phrase(days: Column) -> Column:
    return F.when(days.isNull(), F.lit("across your whole imported archive")).otherwise(
        F.concat(F.lit("in the last "), days.cast("string"), F.lit(" "), plural(days, "day")))


def counted(n: Column, singular: Column | str, many: str | None = None) -> Column:
    """'1,204 messages'."""
    return F.concat_ws(" ", thousands(n), plural(n, singular, many))
