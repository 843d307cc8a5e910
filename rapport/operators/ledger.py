"""Aggregates over the interaction ledger (person_id, kind, source, occurred_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rapport import constants as K
from rapport.functions.dates import days_ago, days_between, ntz
from rapport.operators.ranking import rolling_counts


def in_window(at: Column, as_of, since=None) -> Column:
    """Bounded on both sides: future-dated rows never count for a period."""
    upper = at <= ntz(as_of)
    return upper if since is None else (at >= ntz(since)) & upper


def has_person(person: Column) -> Column:
    return person.isNotNull() & (person != "")


def leaderboard(events: DataFrame, limit: int = 10, as_of=None, since=None) -> DataFrame:
    """(person_id, n, last_at) by volume. Without ``since`` the whole archive is
    ranked, future-dated rows included; with it the window is two-sided."""
    rows = events.where(has_person(F.col("person_id")))
    if since is not None:
        rows = rows.where(in_window(F.col("occurred_at"), as_of, since))
    return (rows.groupBy("person_id")
            .agg(F.count("*").alias("n"), F.max("occurred_at").alias("last_at"))
            .orderBy(F.desc("n"), F.asc("person_id")).limit(limit))


def recent_people(events: DataFrame, as_of, since, limit: int = 10) -> DataFrame:
    return leaderboard(events, limit, as_of, since)


def activity_totals(events: DataFrame, as_of, since=None, person_id=None, source=None) -> DataFrame:
    """(facet, value, n): the total (0 for an empty window), counts by kind and counts
    by source; missing values read 'unknown'. Without ``since`` there is no lower bound."""
    rows = events.where(in_window(F.col("occurred_at"), as_of, since))
    if person_id:
        rows = rows.where(F.col("person_id") == person_id)
    if source:
        rows = rows.where(F.col("source") == source)
    named = rows.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c)
                          for c in ("kind", "source")])
    kind, src = F.col("kind"), F.col("source")
    sets = named.groupBy(kind, src).agg(F.count("*").alias("n"))    # a few rows: kinds by sources
    total = lambda: F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n")
    parts = [sets.groupBy(c.alias("value")).agg(total()).select(F.lit(name).alias("facet"), "value", "n")
             for name, c in (("kind", kind), ("source", src))]
    whole = sets.agg(total()).select(F.lit("total").alias("facet"), F.lit("all").alias("value"), "n")
    return whole.unionByName(parts[0]).unionByName(parts[1])


def distinct_people(events: DataFrame, as_of, since=None, limit: int | None = None,
                    approximate: bool = False) -> DataFrame:
    """How many different people appear in the window; ``limit`` caps the number shown."""
    rows = events.where(has_person(F.col("person_id")) & in_window(F.col("occurred_at"), as_of, since))
    count = F.approx_count_distinct("person_id") if approximate else F.count_distinct("person_id")
    return rows.agg((count if limit is None else F.least(count, F.lit(limit))).cast("bigint").alias("people"))


def last_interaction(events: DataFrame, per_person: bool = False) -> DataFrame:
    last = F.max("occurred_at").alias("last_at")
    return events.groupBy("person_id").agg(last) if per_person else events.agg(last)


def event_counts(events: DataFrame) -> DataFrame:
    """Lifetime interactions per person."""
    return (events.where(F.col("person_id").isNotNull())
            .groupBy("person_id").agg(F.count("*").alias("n")))


def person_source_stats(events: DataFrame, as_of, windows=(14, 60)) -> DataFrame:
    """Per person and source: lifetime count, last time and two-sided window
    counts. The single pass the profile is rolled up from."""
    now, at = ntz(as_of), F.col("occurred_at")
    counts = [F.count_if((at >= days_ago(now, d)) & (at <= now)).alias(f"n{d}") for d in windows]
    return (events.where(has_person(F.col("person_id")))
            .groupBy("person_id", F.coalesce(F.nullif(F.col("source"), F.lit("")),
                                             F.lit("unknown")).alias("source"))
            .agg(F.count("*").alias("n"), F.max("occurred_at").alias("last_at"), *counts))


def person_stats(events: DataFrame, as_of, windows=(14, 60)) -> DataFrame:
    """Per person: total, last time, window counts and counts by source (a map,
    largest first)."""
    return stats_by_person(person_source_stats(events, as_of, windows), windows)


def stats_by_person(per_source: DataFrame, windows=(14, 60)) -> DataFrame:
    """Rows of (person, source) rolled up to one row per person."""
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("source"))))
    return per_source.groupBy("person_id").agg(
        F.sum("n").alias("interactions"), F.max("last_at").alias("last_at"),
        *[F.sum(f"n{d}").alias(f"n{d}") for d in windows],
        F.map_from_entries(F.transform(parts, lambda s: F.struct(s["source"], -s["k"]))).alias("by_source"))


def status_columns(n14: Column, n60: Column, last_at: Column, as_of, rules: str = "classic"):
    """(status, reason). Two published ladders: 'classic' and 'desktop'."""
    days = days_between(last_at, ntz(as_of))
    number = lambda c: c.cast("string")
    if rules == "desktop":
        status = (F.when(n14 >= 8, K.STATUS_VERY_ACTIVE).when(n14 >= 3, K.STATUS_ACTIVE)
                  .when(n60 >= 1, K.STATUS_OCCASIONAL).when(last_at.isNotNull(), K.STATUS_LOW)
                  .otherwise(K.STATUS_NONE))
        reason = (F.when(n14 >= 3, F.concat(number(n14), F.lit(" interactions in the last 14 days")))
                  .when(n60 >= 1, F.concat(number(n60), F.lit(" interactions in the last 60 days")))
                  .when(last_at.isNotNull(), F.concat(F.lit("last interaction "), number(days),
                                                      F.lit(" days ago")))
                  .otherwise("no recorded interactions"))
        return status, reason
    if rules != "classic":
        raise ValueError(f"unknown status rules {rules!r}")
    # One ladder of (condition, status, reason); the first condition that holds wins.
    recent = F.concat(number(n14), F.lit(" interactions in the last 14 days."))
    ladder = [
        (last_at.isNull(), K.STATUS_NONE, F.lit("No recorded interactions yet.")),
        (days > 45, K.STATUS_NONE,
         F.concat(F.lit("No interactions in the last "), number(days), F.lit(" days."))),
        (n14 >= 15, K.STATUS_VERY_ACTIVE, recent),
        (n14 >= 5, K.STATUS_ACTIVE, recent),
        (n60 >= 3, K.STATUS_OCCASIONAL,
         F.concat(number(n60), F.lit(" interactions in the last 60 days ("), number(n14),
                  F.lit(" in the last 14)."))),
        (days <= 30, K.STATUS_LOW,
         F.concat(number(n60), F.lit(" interactions in the last 60 days; last interaction "),
                  number(days), F.lit(" days ago."))),
    ]
    status = F.lit(K.STATUS_NONE)
    reason = F.concat(F.lit("Last interaction "), number(days), F.lit(" days ago."))
    for condition, name, text in reversed(ladder):
        status = F.when(condition, F.lit(name)).otherwise(status)
        reason = F.when(condition, text).otherwise(reason)
    return status, reason


def relationship_status(events: DataFrame, as_of, rules: str = "classic") -> DataFrame:
    """Per person: counts, recency, status and the reason for it."""
    now, at = ntz(as_of), F.col("occurred_at")
    stats = (events.where(has_person(F.col("person_id"))).groupBy("person_id").agg(
        F.count("*").alias("interactions"), F.max("occurred_at").alias("last_at"),
        F.count_if((at >= days_ago(now, 14)) & (at <= now)).alias("n14"),
        F.count_if((at >= days_ago(now, 60)) & (at <= now)).alias("n60")))
    status, reason = status_columns(F.col("n14"), F.col("n60"), F.col("last_at"), as_of, rules)
    return stats.withColumns({"status": status, "reason": reason})


def rolling_activity(events: DataFrame, days=(14, 60)) -> DataFrame:
    """Every event with its person's trailing counts at that moment."""
    return rolling_counts(events.where(has_person(F.col("person_id"))), ["person_id"],
                          "occurred_at", list(days))


def activity_series(events: DataFrame, width_days: int = 14) -> DataFrame:
    """Sliding windows moving one day at a time. Counts are folded to one row per
    person and day before each day is copied into the windows it belongs to."""
    day = F.date_trunc("day", F.col("occurred_at")).cast("timestamp_ntz")
    daily = (events.where(has_person(F.col("person_id")) & F.col("occurred_at").isNotNull())
             .groupBy("person_id", day.alias("day")).agg(F.count("*").alias("n")))
    ends = F.explode(F.sequence(F.lit(1), F.lit(width_days)))
    return (daily.withColumn("shift", ends)
            .withColumn("window_end", (F.col("day") + F.make_dt_interval(F.col("shift"))).cast("timestamp_ntz"))
            .groupBy("person_id", "window_end").agg(F.sum("n").alias("n")))


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def record_counts(**tables: DataFrame) -> DataFrame:
    """(person_id, <table> counts...) for any number of tables in one grouped pass."""
    names = sorted(tables)
    stacked = None
    for name in names:
        part = (tables[name].where(has_person(F.col("person_id")))
                .select("person_id", F.lit(name).alias("record")))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy("person_id").agg(
        *[F.count_if(F.col("record") == n).alias(n) for n in names])


def import_rollup(records: DataFrame) -> DataFrame:
    """Per file: imported, skipped and affected people.

    ``records``: path, person_id, is_new (False for a record already stored)."""
    return records.groupBy("path").agg(
        F.count_if(F.col("is_new")).alias("imported"),
        F.count_if(~F.col("is_new")).alias("skipped"),
        F.count_distinct(F.when(has_person(F.col("person_id")), F.col("person_id")))
        .alias("people"))
