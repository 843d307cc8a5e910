"""Relationship profiles, topic statistics and the upkeep of stored profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rapport.functions.dates import days_ago, ntz
from rapport.functions.topics import is_noise_topic, name_tokens
from rapport.operators.ledger import event_counts, has_person, person_stats, status_columns
from rapport.operators.ranking import top_per_group

TOPIC_LIMIT, ACTIVE_LIMIT, UPCOMING_LIMIT = 8, 6, 5


def topic_counts(memories: DataFrame, people: DataFrame, as_of) -> DataFrame:
    """(person_id, topic, n, active_n, last_seen) without noise and without the
    person's own names. Counts are folded per topic before names are looked up."""
    now = ntz(as_of)
    active = (F.col("occurred_at") >= days_ago(now, 14)) & (F.col("occurred_at") <= now)
    counts = (memories.where(has_person(F.col("person_id")))
              .select("person_id", "occurred_at", F.explode_outer("topics").alias("topic"))
              .where("topic IS NOT NULL")
              .groupBy("person_id", "topic")
              .agg(F.count("*").alias("n"), F.count_if(active).alias("active_n"),
                   F.max("occurred_at").alias("last_seen")))
    return meaningful_topics(counts, people)


def meaningful_topics(counts: DataFrame, people: DataFrame) -> DataFrame:
    """Counts of topics that are neither noise nor the person's own names."""
    counts = counts.where(~is_noise_topic(F.col("topic")))
    own = people.select("person_id", name_tokens(F.col("display_name"), F.col("aliases")).alias("own"))
    return (counts.join(own, "person_id", "left")
            .where(~is_noise_topic(F.col("topic"), F.coalesce("own", F.array().cast("array<string>"))))
            .drop("own"))


def top_topics(counts: DataFrame, limit: int = TOPIC_LIMIT) -> DataFrame:
    """Each person's most frequent topics; ties in alphabetical order."""
    return top_per_group(counts, ["person_id"], [F.desc("n"), F.asc("topic")], limit)


def active_topics(counts: DataFrame, limit: int = ACTIVE_LIMIT) -> DataFrame:
    return top_per_group(counts.where(F.col("active_n") > 0), ["person_id"],
                         [F.desc("active_n"), F.asc("topic")], limit)


def upcoming_events(calendar: DataFrame, as_of, limit: int = UPCOMING_LIMIT) -> DataFrame:
    """Each person's next events from ``as_of`` on, soonest first."""
    rows = (calendar.where(F.col("starts_at") >= ntz(as_of))
            .select(F.explode("person_ids").alias("person_id"), "id", "title", "starts_at"))
    return top_per_group(rows, ["person_id"], [F.asc("starts_at"), F.asc("id")], limit)


def profiles(people: DataFrame, events: DataFrame, memories: DataFrame, calendar: DataFrame,
             as_of, rules: str = "classic") -> DataFrame:
    """One profile per person, for everybody at once.

    Four aggregates joined on person_id. Nothing nested is unbounded: lists hold
    at most 8 topics, 6 active topics, 5 upcoming events, and one entry per source.
    """
    return assembled(people, person_stats(events, as_of), topic_counts(memories, people, as_of), calendar, as_of, rules)


def assembled(people: DataFrame, stats: DataFrame, counts: DataFrame, calendar: DataFrame, as_of,
              rules: str = "classic") -> DataFrame:
    """Profiles from finished statistics per person and topic."""
    topics = top_topics(counts).groupBy("person_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "topic", "n", "last_seen"))),
        lambda s: F.struct(s["topic"], s["n"].alias("count"), s["last_seen"])).alias("topics"))
    active = active_topics(counts).groupBy("person_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "topic", "active_n"))),
        lambda s: F.struct(s["topic"], s["active_n"].alias("count"))).alias("active_topics"))
    upcoming = upcoming_events(calendar, as_of).groupBy("person_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "id", "title", "starts_at"))),
        lambda s: F.struct(s["id"], s["title"], s["starts_at"])).alias("upcoming_events"))
    joined = people.select("person_id")
    for part in (stats, topics, active, upcoming):
        joined = joined.join(part, "person_id", "left")
    zero = F.lit(0).cast("bigint")
    n14, n60 = F.coalesce("n14", zero), F.coalesce("n60", zero)
    status, reason = status_columns(n14, n60, F.col("last_at"), as_of, rules)
    return joined.select(
        "person_id", status.alias("status"), reason.alias("status_reason"),
        F.coalesce("interactions", zero).alias("interaction_count"),
        n14.alias("interactions_14d"), n60.alias("interactions_60d"),
        F.col("last_at").alias("last_interaction_at"),
        F.col("by_source").alias("source_breakdown"), "topics", "active_topics", "upcoming_events",
        ntz(as_of).alias("updated_at"))


def global_topics(counts: DataFrame, people: DataFrame, limit: int = 10,
                  per_person: int = TOPIC_LIMIT) -> DataFrame:
    """Topics summed over everybody's profile, without anybody's name.

    The known names grow with the archive, so they are met by an equi-join on
    tokens rather than collected."""
    totals = (top_topics(counts, per_person)
              .withColumn("topic", F.trim("topic")).where(F.col("topic") != "")
              .groupBy("topic").agg(F.sum("n").alias("n")))
    return (drop_people_names(totals, people)
            .orderBy(F.desc("n"), F.asc("topic")).limit(limit))


def known_name_tokens(people: DataFrame) -> DataFrame:
    """Every display name, its tokens of three or more characters, and every alias."""
    lower = lambda c: F.lower(F.trim(c))
    tokens = F.filter(F.split(lower(F.col("display_name")), "[^a-z0-9]+"),
                      lambda t: F.length(t) >= 3)
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lower)
    names = F.concat(F.array(lower(F.col("display_name"))), tokens, aliases)
    return (people.where(F.col("display_name").isNotNull())
            .select(F.explode(names).alias("token")).where(F.col("token") != "").distinct())


def drop_people_names(topics: DataFrame, people: DataFrame) -> DataFrame:
    """Topics none of whose words is a known name."""
    words = (topics.where(~is_noise_topic(F.col("topic")))
             .select("topic", F.explode(F.regexp_extract_all(
                 F.lower("topic"), F.lit("[a-z0-9]+"), F.lit(0))).alias("token")))
    named = words.join(known_name_tokens(people), "token", "left_semi").select("topic").distinct()
    return topics.where(~is_noise_topic(F.col("topic"))).join(named, "topic", "left_anti")


def stale_profiles(stored: DataFrame, events: DataFrame) -> DataFrame:
    """Profiles whose stored count no longer equals the ledger."""
    counts = event_counts(events).withColumnRenamed("n", "ledger_count")
    return (stored.join(counts, "person_id")
            .where(F.coalesce("interaction_count", F.lit(-1)) != F.col("ledger_count"))
            .select("person_id", "interaction_count", "ledger_count"))


def refresh_profiles(affected: DataFrame, people: DataFrame, events: DataFrame, memories: DataFrame,
                     calendar: DataFrame, as_of, rules: str = "classic") -> DataFrame:
    """Profiles recomputed for the affected people only; their rows are selected
    by semi-join before anything is aggregated."""
    ids = affected.select("person_id").distinct()
    keep = lambda df: df.join(ids, "person_id", "left_semi")
    attended = calendar.where(F.col("starts_at") >= ntz(as_of)).select(
        "id", "title", "starts_at", F.explode("person_ids").alias("person_id"))
    mine = keep(attended).withColumn("person_ids", F.array("person_id")).drop("person_id")
    return profiles(keep(people), keep(events), keep(memories), mine, as_of, rules)


def recompute_stale(stored: DataFrame, people: DataFrame, events: DataFrame, memories: DataFrame,
                    calendar: DataFrame, as_of) -> DataFrame:
    """Maintenance: stale profiles, recomputed."""
    return refresh_profiles(stale_profiles(stored, events), people, events, memories, calendar, as_of)


def cleaned_topics(stored: DataFrame) -> DataFrame:
    """Stored profiles with noise topics filtered on read."""
    return stored.withColumn("topics", F.filter("topics", lambda t: ~is_noise_topic(t["topic"])))
