"""Profiles kept up by deltas: counts per person and day that are added up, never recomputed.

An import adds one row per person, source and day of its own events (per topic and day of its own memories). The counts of
days that lie wholly inside a window come from these buckets; the days in which a window begins or ends are counted row by
row, so the result equals a count over the whole ledger to the microsecond. Buckets are additive: those of people who
became one are added up like those of several imports. Rows without a time count for the totals and for no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rapport.functions.dates import days_ago, ntz
from rapport.operators import profiles as P
from rapport.operators.ledger import has_person, stats_by_person

WINDOWS = (14, 60)


def day_of(at: Column) -> Column:
    return F.date_trunc("day", at).cast("timestamp_ntz")


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    return (rows.where(has_person(F.col("person_id"))).groupBy("person_id", *keys, day_of(F.col("occurred_at")).alias("day"))
            .agg(F.count("*").alias("n"), F.max("occurred_at").alias("last_at")))


def activity_buckets(events: DataFrame) -> DataFrame:
    """(person_id, source, day, n, last_at) of some events; a missing source is 'unknown'."""
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown"))
    return _added(events.select("person_id", "occurred_at", source.alias("source")), ["source"])


def topic_buckets(memories: DataFrame) -> DataFrame:
    """(person_id, topic, day, n, last_at) of some memories."""
    return _added(_by_topic(memories).where("topic IS NOT NULL"), ["topic"])


def _by_topic(memories: DataFrame) -> DataFrame:
    return memories.select("person_id", "occurred_at", F.explode("topics").alias("topic"))


def edge_days(as_of, windows=WINDOWS) -> list[tuple[Column, Column]]:
    """(first, last moment) of each day in which a window begins or ends."""
    now = ntz(as_of)
    days = [day_of(at) for at in (now, *(days_ago(now, d) for d in windows))]
    return [(day, day + F.expr("INTERVAL '1' DAY - INTERVAL '0.000001' SECOND")) for day in days]


def at_edges(rows: DataFrame, as_of, windows=WINDOWS) -> DataFrame:
    """The rows of those days, for a table that has no better way to find them."""
    hit = F.lit(False)
    for first, last in edge_days(as_of, windows):
        hit = hit | F.col("occurred_at").between(first, last)
    return rows.where(hit)


def _windowed(buckets: DataFrame, edges: DataFrame, keys: list[str], as_of, windows) -> DataFrame:
    """n, last_at and n<days> per key from buckets and the rows of the edge days."""
    now, day, at = ntz(as_of), F.col("day"), F.col("occurred_at")
    zero = F.lit(0).cast("bigint")
    inner = {f"n{d}": F.when((day > day_of(days_ago(now, d))) & (day < day_of(now)), F.col("n")).otherwise(zero) for d in windows}
    # The first day of one window lies inside a longer one: only days that are an edge of this window are counted by row.
    outer = {f"n{d}": F.when((at >= days_ago(now, d)) & (at <= now)
                             & day_of(at).isin(day_of(now), day_of(days_ago(now, d))), 1).otherwise(0).cast("bigint")
             for d in windows}
    rows = buckets.select("person_id", *keys, "n", "last_at", *[c.alias(k) for k, c in inner.items()]).unionByName(
        edges.where(has_person(F.col("person_id"))).select(
            "person_id", *keys, zero.alias("n"), F.lit(None).cast("timestamp_ntz").alias("last_at"),
            *[c.alias(k) for k, c in outer.items()]))
    return rows.groupBy("person_id", *keys).agg(
        F.sum("n").alias("n"), F.max("last_at").alias("last_at"), *[F.sum(k).alias(k) for k in inner]).where("n > 0")


def source_stats(activity: DataFrame, edge_events: DataFrame, as_of, windows=WINDOWS) -> DataFrame:
    """What ``person_source_stats`` counts, from buckets and the events of the edge days."""
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown"))
    return _windowed(activity, edge_events.select("person_id", "occurred_at", source.alias("source")), ["source"], as_of, windows)


def topic_counts(topics: DataFrame, edge_memories: DataFrame, people: DataFrame, as_of) -> DataFrame:
    """What ``profiles.topic_counts`` counts, from buckets and the memories of the edge days."""
    counts = _windowed(topics, _by_topic(edge_memories).where("topic IS NOT NULL"), ["topic"], as_of, (14,))
    return P.meaningful_topics(counts.withColumnsRenamed({"n14": "active_n", "last_at": "last_seen"}), people)


def bucket_profiles(people: DataFrame, activity: DataFrame, topics: DataFrame, edge_events: DataFrame,
                    edge_memories: DataFrame, calendar: DataFrame, as_of, rules: str = "classic") -> DataFrame:
    """Profiles of ``people``, equal to those over their whole ledger and all their memories."""
    stats = stats_by_person(source_stats(activity, edge_events, as_of), WINDOWS)
    return P.assembled(people, stats, topic_counts(topics, edge_memories, people, as_of), calendar, as_of, rules)
