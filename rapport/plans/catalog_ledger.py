"""Queries over the ledger, people, calendar and timeline, each with its SQL twin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rapport.functions.dates import ntz
from rapport.functions.topics import extract_topics_desktop
from rapport.operators import buckets as B
from rapport.operators import ledger as L
from rapport.operators import match as M
from rapport.operators import people as P
from rapport.operators import profiles as R
from rapport.operators import timeline as TL
from rapport.operators.ranking import sorted_page, top_per_group
from rapport.operators.resolution import remove_member, replace_member
from rapport.plans import fixtures as X

NOW = f"TIMESTAMP '{X.AS_OF}'"
SINCE = f"TIMESTAMP '{X.SINCE}'"
CAL_NOW = f"TIMESTAMP '{X.AS_OF_CALENDAR}'"

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = (fn, X.with_views(sql) if sql else None)
        return fn
    return register


@query("relationship_status",
       "SELECT person_id, interactions, last_at, n14, n60, status, reason FROM v_status")
def relationship_status(spark, sf):
    return L.relationship_status(X.events(spark, sf), X.AS_OF)


@query("relationship_status_desktop", """
SELECT person_id, n14, n60,
       CASE WHEN n14 >= 8 THEN 'Very Active' WHEN n14 >= 3 THEN 'Active' WHEN n60 >= 1 THEN 'Occasional'
            ELSE 'Low Activity' END AS status,
       CASE WHEN n14 >= 3 THEN n14 || ' interactions in the last 14 days'
            WHEN n60 >= 1 THEN n60 || ' interactions in the last 60 days'
            ELSE 'last interaction ' || days || ' days ago' END AS reason FROM v_status""")
def relationship_status_desktop(spark, sf):
    return L.relationship_status(X.events(spark, sf), X.AS_OF, "desktop").select(
        "person_id", "n14", "n60", "status", "reason")


@query("a1_leaderboard_lifetime", """
SELECT person_id, count(*) AS n, max(occurred_at) AS last_at FROM v_events
WHERE person_id IS NOT NULL AND person_id <> '' GROUP BY person_id ORDER BY n DESC, person_id LIMIT 10""")
def a1_lifetime(spark, sf):
    return L.leaderboard(X.events(spark, sf), 10)


@query("a1_leaderboard_window", f"""
SELECT person_id, count(*) AS n, max(occurred_at) AS last_at FROM v_events
WHERE person_id <> '' AND occurred_at BETWEEN {SINCE} AND {NOW}
GROUP BY person_id ORDER BY n DESC, person_id LIMIT 10""")
def a1_window(spark, sf):
    return L.leaderboard(X.events(spark, sf), 10, X.AS_OF, X.SINCE)


@query("a2_activity_totals", f"""
WITH w AS (SELECT * FROM v_events WHERE occurred_at >= {SINCE} AND occurred_at <= {NOW})
SELECT 'kind' AS facet, kind AS value, count(*) AS n FROM w GROUP BY kind
UNION ALL SELECT 'source', source, count(*) FROM w GROUP BY source
UNION ALL SELECT 'total', 'all', count(*) FROM w""")
def a2_totals(spark, sf):
    return L.activity_totals(X.events(spark, sf), X.AS_OF, X.SINCE)


@query("a2_activity_totals_person", f"""
WITH w AS (SELECT * FROM v_events WHERE occurred_at <= {NOW}
           AND person_id = 'p8' AND source = 'src2')
SELECT 'kind' AS facet, kind AS value, count(*) AS n FROM w GROUP BY kind
UNION ALL SELECT 'source', source, count(*) FROM w GROUP BY source
UNION ALL SELECT 'total', 'all', count(*) FROM w""")
def a2_totals_person(spark, sf):
    return L.activity_totals(X.events(spark, sf), X.AS_OF, person_id="p8", source="src2")


@query("a3_distinct_people", f"""
SELECT count(DISTINCT person_id) AS people FROM v_events
WHERE person_id <> '' AND occurred_at >= {SINCE} AND occurred_at <= {NOW}""")
def a3_people(spark, sf):
    return L.distinct_people(X.events(spark, sf), X.AS_OF, X.SINCE)


@query("a4_last_interaction", "SELECT person_id, max(occurred_at) AS last_at FROM v_events GROUP BY person_id")
def a4_last(spark, sf):
    return L.last_interaction(X.events(spark, sf), per_person=True)


@query("a4_last_interaction_global", "SELECT max(occurred_at) AS last_at FROM v_events")
def a4_last_global(spark, sf):
    return L.last_interaction(X.events(spark, sf))


@query("a5_recent_people", f"""
SELECT person_id, count(*) AS n, max(occurred_at) AS last_at FROM v_events
WHERE person_id <> '' AND occurred_at BETWEEN TIMESTAMP '2024-01-18 00:00:00' AND {NOW}
GROUP BY person_id ORDER BY n DESC, person_id LIMIT 25""")
def a5_recent(spark, sf):
    return L.recent_people(X.events(spark, sf), X.AS_OF, "2024-01-18 00:00:00", 25)


@query("a6_event_counts", "SELECT person_id, count(*) AS n FROM v_events WHERE person_id IS NOT NULL GROUP BY person_id")
def a6_counts(spark, sf):
    return L.event_counts(X.events(spark, sf))


@query("a7_person_source_stats", f"""
SELECT person_id, source, count(*) AS n, max(occurred_at) AS last_at,
       count(*) FILTER (WHERE occurred_at >= {SINCE} AND occurred_at <= {NOW}) AS n14,
       count(*) FILTER (WHERE occurred_at >= TIMESTAMP '2023-11-26' AND occurred_at <= {NOW}) AS n60
FROM v_events WHERE person_id <> '' GROUP BY person_id, source""")
def a7_stats(spark, sf):
    return L.person_source_stats(X.events(spark, sf), X.AS_OF)


@query("a7_person_stats_map", """
SELECT s.person_id, interactions, n14, n60, string_agg(source || ':' || n, ',' ORDER BY n DESC, source) AS by_source
FROM v_stats s JOIN (SELECT person_id, source, count(*) AS n FROM v_events GROUP BY 1, 2) b ON b.person_id = s.person_id
GROUP BY s.person_id, interactions, n14, n60""")
def a7_map(spark, sf):
    entries = F.transform(F.map_entries("by_source"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return L.person_stats(X.events(spark, sf), X.AS_OF).select(
        "person_id", "interactions", "n14", "n60", F.array_join(entries, ",").alias("by_source"))


def _profiles(spark, sf):
    return R.profiles(X.people(spark, sf), X.events(spark, sf), X.memories(spark, sf), X.calendar(spark, sf), X.AS_OF)


PROFILE_SCALARS = """
SELECT p.person_id, coalesce(status, 'No Recent Activity') AS status,
       coalesce(reason, 'No recorded interactions yet.') AS status_reason,
       coalesce(interactions, 0) AS interaction_count, coalesce(n14, 0) AS interactions_14d,
       coalesce(n60, 0) AS interactions_60d, last_at AS last_interaction_at
FROM v_people p LEFT JOIN v_status s ON s.person_id = p.person_id"""


@query("a8_profile_scalars", PROFILE_SCALARS)
def a8_scalars(spark, sf):
    return _profiles(spark, sf).select(
        "person_id", "status", "status_reason", "interaction_count", "interactions_14d",
        "interactions_60d", "last_interaction_at")


IMPORTS = 4


def _imports(df):
    """The parts of a table as several imports bring them: rows of one person and day arrive in any of them."""
    return [df.where(F.pmod(F.xxhash64("occurred_at", "person_id"), F.lit(IMPORTS)) == i) for i in range(IMPORTS)]


@query("t4_profiles_by_deltas", PROFILE_SCALARS)
def t4_profiles(spark, sf):
    events, memories = X.events(spark, sf), X.memories(spark, sf)
    activity = reduce(DataFrame.unionByName, [B.activity_buckets(part) for part in _imports(events)])
    topics = reduce(DataFrame.unionByName, [B.topic_buckets(part) for part in _imports(memories)])
    return B.bucket_profiles(X.people(spark, sf), activity, topics, B.at_edges(events, X.AS_OF), B.at_edges(memories, X.AS_OF),
                             X.calendar(spark, sf), X.AS_OF).select(
        "person_id", "status", "status_reason", "interaction_count", "interactions_14d", "interactions_60d", "last_interaction_at")


@query("a8_profile_upcoming", f"""
SELECT p.person_id, string_agg(b.id, ',' ORDER BY rn) AS upcoming FROM v_people p JOIN (
  SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY starts_at, id) AS rn FROM v_bridge
  WHERE starts_at >= {CAL_NOW}) b ON b.person_id = p.person_id AND rn <= 5 GROUP BY p.person_id""")
def a8_upcoming(spark, sf):
    profiles = R.profiles(X.people(spark, sf), X.events(spark, sf), X.memories(spark, sf),
                          X.calendar(spark, sf), X.AS_OF_CALENDAR)
    return profiles.where(F.col("upcoming_events").isNotNull()).select(
        "person_id", F.array_join(F.transform("upcoming_events", lambda e: e["id"]), ",").alias("upcoming"))


@query("a8_profile_nested")
def a8_nested(spark, sf):
    return _profiles(spark, sf).select(
        "person_id", F.to_json("source_breakdown").alias("sources"), F.to_json("topics").alias("topics"),
        F.to_json("active_topics").alias("active"))


TOPIC_COUNTS = f"""
SELECT person_id, topic, count(*) AS n,
       count(*) FILTER (WHERE occurred_at >= {SINCE} AND occurred_at <= {NOW}) AS active_n,
       max(occurred_at) AS last_seen
FROM (SELECT person_id, occurred_at, unnest(topics) AS topic FROM v_topics) t WHERE {{keep}} GROUP BY person_id, topic"""


def _noise_sql(expr: str) -> str:
    from rapport.functions.topics import _FILLER, _FILLER_PHRASES
    quoted = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)
    words = f"regexp_extract_all(lower({expr}), '[a-z0-9]+')"
    return (f"(length(trim({expr})) < 3 OR lower(trim({expr})) IN ({quoted(_FILLER_PHRASES)}) "
            f"OR len(list_filter({words}, lambda x: x NOT IN ({quoted(_FILLER)}))) = 0)")


KEEP_TOPIC = f"NOT {_noise_sql('topic')}"
# A person is named by segment, number and customer code; topics hold letters only.
OWN_NAME = """NOT EXISTS (SELECT 1 FROM v_people p WHERE p.person_id = t.person_id AND
  (list_contains(regexp_extract_all(lower(t.topic), '[a-z0-9]+'), regexp_extract(lower(p.display_name), '^[a-z]+'))
   OR list_contains(regexp_extract_all(lower(t.topic), '[a-z0-9]+'), 'customer')
   OR list_contains(regexp_extract_all(lower(t.topic), '[a-z0-9]+'), substr(p.aliases[1], 10))))"""


def _topic_counts(spark, sf):
    return R.topic_counts(X.memories(spark, sf), X.people(spark, sf), X.AS_OF)


@query("a9_topic_counts", TOPIC_COUNTS.format(keep=f"{KEEP_TOPIC} AND {OWN_NAME}"))
def a9_topics(spark, sf):
    return _topic_counts(spark, sf)


@query("t4_topics_by_deltas", TOPIC_COUNTS.format(keep=f"{KEEP_TOPIC} AND {OWN_NAME}"))
def t4_topics(spark, sf):
    memories = X.corpus(spark, sf).withColumn("topics", extract_topics_desktop(F.col("text")))
    topics = reduce(DataFrame.unionByName, [B.topic_buckets(part) for part in _imports(memories)])
    return B.topic_counts(topics, B.at_edges(memories, X.AS_OF), X.people(spark, sf), X.AS_OF).select(
        "person_id", "topic", "n", "active_n", "last_seen")


@query("a9_top_topics", f"""
SELECT person_id, topic, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY n DESC, topic) AS rank
  FROM ({TOPIC_COUNTS.format(keep=f"{KEEP_TOPIC} AND {OWN_NAME}")})) WHERE rank <= 8""")
def a9_top(spark, sf):
    return R.top_topics(_topic_counts(spark, sf)).select("person_id", "topic", "n", F.col("rank").cast("bigint").alias("rank"))


@query("a10_global_topics", f"""
SELECT topic, sum(n)::BIGINT AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY n DESC, topic) AS rank
  FROM ({TOPIC_COUNTS.format(keep=f"{KEEP_TOPIC} AND {OWN_NAME}")})) t WHERE rank <= 8
AND NOT EXISTS (SELECT 1 FROM v_people p WHERE list_contains(regexp_extract_all(lower(t.topic), '[a-z0-9]+'),
  regexp_extract(lower(p.display_name), '^[a-z]+')))
GROUP BY topic ORDER BY n DESC, topic LIMIT 10""")
def a10_topics(spark, sf):
    return R.global_topics(_topic_counts(spark, sf), X.people(spark, sf), 10)


@query("j15_topics_without_names", f"""
SELECT DISTINCT topic FROM (SELECT unnest(topics) AS topic FROM v_topics) t WHERE {KEEP_TOPIC}
AND NOT EXISTS (SELECT 1 FROM v_people p WHERE list_contains(regexp_extract_all(lower(t.topic), '[a-z0-9]+'),
  regexp_extract(lower(p.display_name), '^[a-z]+')))""")
def j15_names(spark, sf):
    topics = X.memories(spark, sf).select(F.explode("topics").alias("topic")).distinct()
    return R.drop_people_names(topics, X.people(spark, sf))


@query("a11_jobs_by_status", "SELECT status, count(*) AS n FROM v_jobs GROUP BY status")
def a11_jobs(spark, sf):
    return L.jobs_by_status(X.jobs(spark, sf))


@query("a12_record_counts", """
SELECT person_id, count(*) FILTER (WHERE r = 'emails') AS emails, count(*) FILTER (WHERE r = 'events') AS events,
       count(*) FILTER (WHERE r = 'memories') AS memories, count(*) FILTER (WHERE r = 'notes') AS notes,
       count(*) FILTER (WHERE r = 'voice') AS voice
FROM (SELECT person_id, 'emails' AS r FROM v_emails UNION ALL SELECT person_id, 'events' FROM v_bridge
      UNION ALL SELECT person_id, 'memories' FROM v_corpus UNION ALL SELECT person_id, 'notes' FROM v_notes
      UNION ALL SELECT person_id, 'voice' FROM v_voice) GROUP BY person_id""")
def a12_counts(spark, sf):
    return L.record_counts(emails=X.emails(spark, sf), events=X.calendar_bridge(spark, sf),
                           memories=X.corpus(spark, sf), notes=X.notes(spark, sf), voice=X.voice(spark, sf))


@query("a13_people_seen_of_total", f"""
SELECT s.people AS seen, t.total, t.total - s.people AS unseen FROM
 (SELECT count(DISTINCT person_id) AS people FROM v_events WHERE person_id <> '' AND occurred_at >= {SINCE} AND occurred_at <= {NOW}) s,
 (SELECT count(*) AS total FROM v_people) t""")
def a13_seen(spark, sf):
    total = X.people(spark, sf).agg(F.count("*").alias("total"))
    seen = L.distinct_people(X.events(spark, sf), X.AS_OF, X.SINCE)
    return total.select(seen.scalar().alias("seen"), "total").withColumn("unseen", F.col("total") - F.col("seen"))


@query("a13_status_counts", "SELECT status, count(*) AS n FROM v_status GROUP BY status")
def a13_status(spark, sf):
    return L.relationship_status(X.events(spark, sf), X.AS_OF).groupBy("status").agg(F.count("*").alias("n"))


@query("a15_import_rollup", """
SELECT 'file-' || source AS path, count(*) FILTER (WHERE kind <> 'voice') AS imported,
       count(*) FILTER (WHERE kind = 'voice') AS skipped,
       count(DISTINCT person_id) FILTER (WHERE person_id <> '') AS people FROM v_events GROUP BY source""")
def a15_rollup(spark, sf):
    return L.import_rollup(X.events(spark, sf).select(
        F.concat(F.lit("file-"), "source").alias("path"), "person_id", (F.col("kind") != "voice").alias("is_new")))


@query("w1_rolling_counts", """
SELECT id, person_id,
 count(*) OVER (PARTITION BY person_id ORDER BY occurred_at RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND CURRENT ROW) AS n14,
 count(*) OVER (PARTITION BY person_id ORDER BY occurred_at RANGE BETWEEN INTERVAL 60 DAYS PRECEDING AND CURRENT ROW) AS n60
FROM v_events WHERE person_id <> ''""")
def w1_rolling(spark, sf):
    return L.rolling_activity(X.events(spark, sf)).select("id", "person_id", "n14", "n60")


@query("w2_latest_emails", """
SELECT person_id, id, sent_at, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY sent_at DESC, id) AS rank FROM v_emails) WHERE rank <= 5""")
def w2_latest(spark, sf):
    return TL.latest_per_person(X.emails(spark, sf), "sent_at", 5).select(
        "person_id", "id", "sent_at", F.col("rank").cast("bigint").alias("rank"))


@query("w3_conversation_replay", """
SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY sent_at, id) AS position FROM v_messages""")
def w3_replay(spark, sf):
    return TL.conversation_replay(X.messages(spark, sf)).select("conversation_id", "id", "position")


@query("w9_upcoming", f"""
SELECT person_id, id, title, starts_at, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY starts_at, id) AS rank FROM v_bridge
  WHERE starts_at >= {CAL_NOW}) WHERE rank <= 5""")
def w9_upcoming(spark, sf):
    return R.upcoming_events(X.calendar(spark, sf), X.AS_OF_CALENDAR).withColumn("rank", F.col("rank").cast("bigint"))


@query("t8_activity_series", """
SELECT person_id, window_end, sum(n)::BIGINT AS n FROM (
  SELECT person_id, date_trunc('day', occurred_at) + to_days(CAST(s AS INTEGER)) AS window_end, count(*) AS n
  FROM v_events, range(1, 15) r(s) WHERE person_id <> '' GROUP BY 1, 2) GROUP BY 1, 2""")
def t8_series(spark, sf):
    return L.activity_series(X.events(spark, sf))


@query("o1_sorted_page", """
SELECT id, person_id, occurred_at FROM v_events ORDER BY kind, occurred_at DESC, id LIMIT 50 OFFSET 25""")
def o1_page(spark, sf):
    return sorted_page(X.events(spark, sf), [F.asc("kind"), F.desc("occurred_at"), F.asc("id")], 50, 25).select(
        "id", "person_id", "occurred_at")


NATURAL = ("CAST(regexp_matches(display_name, '^[^A-Za-z0-9]*[0-9]') AS INTEGER), "
           "regexp_extract(lower(display_name), '^[^0-9]*'), "
           "CAST(regexp_extract(display_name, '[0-9]+') AS BIGINT), display_name, p.person_id")


@query("o2_people_page_interactions", f"""
SELECT p.person_id, display_name, coalesce(interaction_count, 0) AS interaction_count
FROM v_people p LEFT JOIN v_profiles s ON s.person_id = p.person_id WHERE NOT is_user
ORDER BY coalesce(interaction_count, 0) DESC, {NATURAL} LIMIT 50 OFFSET 20""")
def o2_interactions(spark, sf):
    return P.people_page(X.people(spark, sf), X.stored_profiles(spark, sf), sort="interactions",
                         limit=50, offset=20).select("person_id", "display_name", "interaction_count")


@query("o2_people_page_name", f"""
SELECT p.person_id, display_name FROM v_people p WHERE NOT is_user ORDER BY {NATURAL} LIMIT 200 OFFSET 10""")
def o2_name(spark, sf):
    return P.people_page(X.people(spark, sf), X.stored_profiles(spark, sf), sort="name", limit=500,
                         offset=10).select("person_id", "display_name")


@query("o2_people_page_recent", """
SELECT p.person_id, last_interaction_at FROM v_people p JOIN v_profiles s ON s.person_id = p.person_id
WHERE NOT is_user AND status = 'Occasional' ORDER BY last_interaction_at DESC, p.person_id DESC LIMIT 50""")
def o2_recent(spark, sf):
    return P.people_page(X.people(spark, sf), X.stored_profiles(spark, sf), status="Occasional",
                         sort="whatever", limit=50).select("person_id", "last_interaction_at")


@query("o2_people_total", """
SELECT count(*) AS total FROM v_people p LEFT JOIN v_profiles s ON s.person_id = p.person_id
WHERE NOT is_user AND (lower(display_name) LIKE '%build%' OR lower(aliases[1]) LIKE '%build%')""")
def o2_total(spark, sf):
    return P.people_total(X.people(spark, sf), X.stored_profiles(spark, sf), q="Build")


@query("o2_people_rail", f"""
SELECT p.person_id, display_name, coalesce(interaction_count, 0) AS interaction_count
FROM v_people p LEFT JOIN v_profiles s ON s.person_id = p.person_id WHERE NOT is_user
ORDER BY coalesce(interaction_count, 0) DESC, {NATURAL} LIMIT 6""")
def o2_rail(spark, sf):
    return P.people_rail(X.people(spark, sf), X.stored_profiles(spark, sf))


@query("o3_natural_sort", f"""
SELECT p.person_id, display_name FROM v_people p ORDER BY {NATURAL}""")
def o3_natural(spark, sf):
    people = X.people(spark, sf)
    return people.orderBy(*P.people_order("name")).select("person_id", "display_name")


@query("o4_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def o4_topk(spark, sf):
    return sorted_page(X.table(spark, sf, "part").select("p_partkey", "p_retailprice"),
                       [F.desc("p_retailprice"), F.asc("p_partkey")], 20)


@query("o5_newest_first", "SELECT id, noted_at FROM v_notes ORDER BY noted_at DESC, id LIMIT 40")
def o5_newest(spark, sf):
    return TL.newest_first(X.notes(spark, sf), "noted_at", limit=40).select("id", "noted_at")


def _find(spec, *columns):
    def run(spark, sf):
        return M.find(X.events(spark, sf), spec() if callable(spec) else spec).select(*columns)
    return run


query("p1_match_eq_in", "SELECT id FROM v_events WHERE person_id = 'p3' AND kind IN ('message', 'email')")(
    _find({"person_id": {"$eq": "p3"}, "kind": {"$in": ["message", "email"]}}, "id"))
query("p1_match_ne_nin", "SELECT id FROM v_events WHERE (kind IS NULL OR kind <> 'voice') AND source NOT IN ('src0', 'src1')")(
    _find({"kind": {"$ne": "voice"}, "source": {"$nin": ["src0", "src1"]}}, "id"))
query("p1_match_range", f"SELECT id FROM v_events WHERE occurred_at > {SINCE} AND occurred_at <= {NOW} AND id < 'ev-5'")(
    _find(lambda: {"occurred_at": {"$gt": ntz(X.SINCE), "$lte": ntz(X.AS_OF)}, "id": {"$lt": "ev-5"}}, "id"))
query("p1_match_or_and", "SELECT id FROM v_events WHERE (kind = 'note' OR (source = 'src4' AND person_id = 'p9')) AND person_id IS NOT NULL")(
    _find({"$or": [{"kind": "note"}, {"$and": [{"source": "src4"}, {"person_id": "p9"}]}],
           "person_id": {"$exists": True}}, "id"))


@query("p2_array_contains", "SELECT id FROM v_calendar WHERE list_contains(person_ids, 'p5')")
def p2_contains(spark, sf):
    return M.find(X.calendar(spark, sf), {"person_ids": "p5"}).select("id")


@query("p3_elem_match", "SELECT id FROM v_messages WHERE 'img-' || (seq * 7 % 150) || '-wa.jpg' = 'img-21-wa.jpg'")
def p3_elem(spark, sf):
    return M.find(X.attachments(spark, sf),
                  {"attachments": {"$elemMatch": {"filename_key": "img-21-wa.jpg", "kind": "image"}}}).select("id")


@query("p4_text_match", """
SELECT id FROM v_messages WHERE lower(sender_label) = 'machinery' OR contains(lower(content), 'tion 100%') OR contains(lower(content), 'ation')""")
def p4_regex(spark, sf):
    return M.find(X.messages(spark, sf), {"$or": [
        {"sender_label": {"$regex": "^MACHINERY$", "$options": "i"}},
        {"content": {"$regex": "tion 100%"}}, {"content": {"$regex": "ation"}}]}).select("id")


@query("p5_nested_path", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '29'")
def p5_nested(spark, sf):
    return M.find(X.table(spark, sf, "events").withColumnRenamed("props", "extra"), {"k": "29"}).select("event_id")


@query("p6_bounded_window", f"SELECT id, occurred_at FROM v_events WHERE occurred_at >= {SINCE} AND occurred_at <= {NOW}")
def p6_window(spark, sf):
    return X.events(spark, sf).where(L.in_window(F.col("occurred_at"), X.AS_OF, X.SINCE)).select("id", "occurred_at")


@query("p7_retrieval_filter", "SELECT id FROM v_corpus WHERE person_id = 'p7' AND occurred_at >= TIMESTAMP '2023-12-10'")
def p7_filter(spark, sf):
    spec = {"person_id": "p7", "source": None, "occurred_at": {"$gte": ntz("2023-12-10 00:00:00")}}
    return M.find(X.corpus(spark, sf), {k: v for k, v in spec.items() if v is not None}).select("id")


@query("p8_snippets", "SELECT id, substr(text, 1, 220) AS snippet FROM v_corpus")
def p8_snippets(spark, sf):
    return X.corpus(spark, sf).select("id", F.substring("text", 1, 220).alias("snippet"))


@query("p9_exclude_columns", "SELECT id, person_id, title, noted_at FROM v_notes")
def p9_exclude(spark, sf):
    return M.find(X.notes(spark, sf), exclude=["body"])


@query("p10_point_lookup", "SELECT id, filename_key FROM v_media WHERE filename_key IN (SELECT 'img-' || (seq * 7 % 150) || '-wa.jpg' FROM v_messages)")
def p10_lookup(spark, sf):
    keys = X.attachments(spark, sf).select(F.explode("attachments.filename_key").alias("filename_key"))
    return M.lookup(X.media(spark, sf), keys, ["filename_key"]).select("id", "filename_key")


@query("p11_people_filter", """
SELECT p.person_id, display_name FROM v_people p JOIN v_profiles s ON s.person_id = p.person_id
WHERE NOT is_user AND status = 'Occasional' AND (contains(lower(display_name), 'mach') OR contains(lower(aliases[1]), 'mach'))""")
def p11_people(spark, sf):
    return P.filtered_people(X.people(spark, sf), X.stored_profiles(spark, sf), "Mach", "Occasional").select(
        "person_id", "display_name")


@query("j1_identity_people", """
SELECT i.person_id, i.kind, i.value, display_name FROM v_identities i JOIN v_people p ON p.person_id = i.person_id
WHERE i.kind = 'email' AND i.value IN (SELECT lower(replace(s_name, 'Supplier#', 'customer.')) || '@x.org' FROM supplier)""")
def j1_identity(spark, sf):
    wanted = X.table(spark, sf, "supplier").select(F.concat(
        F.lower(F.replace("s_name", F.lit("Supplier#"), F.lit("customer."))), F.lit("@x.org")).alias("value"))
    return P.identity_people(X.people(spark, sf), X.identities(spark, sf), "email", wanted).select(
        "person_id", "kind", "value", "display_name")


@query("j2_event_people", """
SELECT b.person_id, b.id, b.title, b.starts_at, display_name FROM v_bridge b JOIN v_people p ON p.person_id = b.person_id""")
def j2_bridge(spark, sf):
    return TL.event_people(X.calendar(spark, sf), X.people(spark, sf))


@query("j4_people_with_profiles", """
SELECT p.person_id, s.status, coalesce(s.status_reason, 'No recorded interactions yet.') AS status_reason,
 coalesce(s.interaction_count, 0) AS interaction_count, coalesce(s.interactions_14d, 0) AS interactions_14d, s.last_interaction_at
FROM v_people p LEFT JOIN v_profiles s ON s.person_id = p.person_id""")
def j4_left(spark, sf):
    return P.with_profiles(X.people(spark, sf), X.stored_profiles(spark, sf)).select(
        "person_id", "status", "status_reason", "interaction_count", "interactions_14d", "last_interaction_at")


STALE = """
SELECT s.person_id, s.interaction_count, n AS ledger_count FROM v_profiles s
JOIN (SELECT person_id, count(*) AS n FROM v_events GROUP BY person_id) e ON e.person_id = s.person_id
WHERE coalesce(s.interaction_count, -1) <> n"""


@query("j5_stale_profiles", STALE)
def j5_stale(spark, sf):
    return R.stale_profiles(X.stored_profiles(spark, sf), X.events(spark, sf))


@query("m3_recompute_stale", f"""
SELECT s.person_id, interactions AS interaction_count, status FROM v_status s
JOIN v_people p ON p.person_id = s.person_id WHERE s.person_id IN (SELECT person_id FROM ({STALE}))""")
def m3_recompute(spark, sf):
    return R.recompute_stale(X.stored_profiles(spark, sf), X.people(spark, sf), X.events(spark, sf),
                             X.memories(spark, sf), X.calendar(spark, sf), X.AS_OF).select(
        "person_id", "interaction_count", "status")


@query("m4_cleaned_topics", f"""
SELECT id, string_agg(topic, ',' ORDER BY topic) AS topics FROM (SELECT id, unnest(topics) AS topic FROM v_topics)
WHERE {KEEP_TOPIC} GROUP BY id""")
def m4_cleaned(spark, sf):
    rows = X.memories(spark, sf).withColumn("topics", F.transform("topics", lambda t: F.struct(t.alias("topic"))))
    return R.cleaned_topics(rows).where(F.size("topics") > 0).select(
        "id", F.array_join(F.transform("topics", lambda t: t["topic"]), ",").alias("topics"))


@query("u1_timeline", """
SELECT 'message' AS type, id, NULL AS person_id, sent_at AS at, sender_label AS title, substr(content, 1, 500) AS body, source FROM v_messages
UNION ALL SELECT 'email', id, person_id, sent_at, CASE WHEN subject = '' THEN '(no subject)' ELSE subject END, substr(body, 1, 500), 'email' FROM v_emails
UNION ALL SELECT 'calendar', c.id, p, c.starts_at, c.title, trim(location || ' ' || description), 'calendar' FROM (SELECT *, unnest(person_ids) AS p FROM v_calendar) c
UNION ALL SELECT 'note', id, person_id, noted_at, title, body, 'notes' FROM v_notes
UNION ALL SELECT 'voice', id, person_id, recorded_at, filename, transcript, 'voice' FROM v_voice""")
def u1_timeline(spark, sf):
    messages = X.messages(spark, sf).withColumn("person_id", F.lit(None).cast("string"))
    return TL.timeline(messages, X.emails(spark, sf), X.calendar(spark, sf), X.notes(spark, sf), X.voice(spark, sf))


@query("u4_array_members", """
SELECT id, array_to_string(list_filter(person_ids, lambda x: x <> 'p5'), ',') AS without,
       array_to_string(list_transform(person_ids, lambda x: CASE WHEN x = 'p7' THEN 'kept' ELSE x END), ',') AS replaced
FROM v_calendar""")
def u4_members(spark, sf):
    rows = X.calendar(spark, sf).withColumn("original", F.col("person_ids"))
    out = remove_member(rows, "person_ids", "p5").withColumn("without", F.array_join("person_ids", ","))
    out = replace_member(out.withColumn("person_ids", F.col("original")), "person_ids", "p7", "kept")
    return out.select("id", "without", F.array_join("person_ids", ",").alias("replaced"))


@query("n6_top_values_per_group", """
SELECT o_orderpriority, o_orderstatus, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_orderstatus) AS rank
  FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE rank <= 2""")
def n6_most_common(spark, sf):
    counts = X.table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return top_per_group(counts, ["o_orderpriority"], [F.desc("n"), F.asc("o_orderstatus")], 2).withColumn(
        "rank", F.col("rank").cast("bigint"))
