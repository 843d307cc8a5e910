"""Archive tables derived from the star-schema test data, for Spark and, as CTEs,
for the SQL oracle. Every view covers its base tables whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rapport.functions.text import message_id
from rapport.functions.topics import extract_topics_desktop
from rapport.session import prepare, spread

AS_OF = "2024-01-25 00:00:00"            # ledger clock: the last days lie in the future
AS_OF_CALENDAR = "2000-01-01 00:00:00"
SINCE = "2024-01-11 00:00:00"


# Tables whose rows are long texts: per-row work dominates, so all cores share it.
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    prepare(spark)
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(rows) if name in TEXT_TABLES else rows


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger: each user's month is stretched and shifted by a different factor,
    so every status level occurs."""
    return table(spark, sf, "events").selectExpr(
        "concat('ev-', event_id) AS id",
        "CASE WHEN event_id % 97 = 0 THEN '' ELSE concat('p', user_id) END AS person_id",
        "CASE event_type WHEN 'click' THEN 'message' WHEN 'view' THEN 'email' "
        "WHEN 'purchase' THEN 'meeting' WHEN 'signup' THEN 'note' ELSE 'voice' END AS kind",
        "concat('src', cast(regexp_extract(props, '([0-9]+)', 1) AS int) % 5) AS source",
        "timestamp_ntz'2024-01-31 00:00:00' - (timestamp_ntz'2024-01-31 00:00:00' - ts) * (1 + user_id % 25)"
        " - make_dt_interval(cast(user_id % 7 * 10 AS int)) AS occurred_at",
        "event_type AS summary", "concat('rec-', event_id) AS record_id")


def people(spark: SparkSession, sf: str) -> DataFrame:
    """One person per customer; names collide up to punctuation on purpose."""
    return table(spark, sf, "customer").selectExpr(
        "concat('p', c_custkey) AS person_id",
        "concat(c_mktsegment, ' ', c_custkey % 40, CASE WHEN c_custkey % 3 = 0 THEN '!' ELSE '' END) AS display_name",
        "array(c_name) AS aliases", "c_custkey = 1 AS is_user",
        "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, cast(c_custkey % 1000 AS int)) AS created_at")


def identities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "concat('p', c_custkey) AS person_id",
        "inline(array(struct('phone' AS kind, cast(c_custkey + 9000000000 AS string) AS value),"
        " struct('email' AS kind, concat(lower(replace(c_name, '#', '.')), '@x.org') AS value)))")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").selectExpr(
        "concat('c', conv_id) AS conversation_id", "turn AS seq",
        "element_at(array('whatsapp', 'telegram', 'instagram', 'x'), cast(conv_id % 4 AS int) + 1) AS source",
        "CASE WHEN role = 'user' THEN 'Me' WHEN role = 'system' THEN 'system'"
        " WHEN conv_id % 5 = 0 THEN concat('Contact ', conv_id % 20)"
        " WHEN conv_id % 5 = 1 THEN concat('building  ', conv_id % 60)"
        " WHEN conv_id % 5 = 2 THEN concat('Customer#', lpad(conv_id, 9, '0'))"
        " WHEN conv_id % 5 = 3 THEN 'Machinery' ELSE 'Instagram User' END AS sender_label",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id AS int), cast(turn AS int)) AS sent_at",
        "text AS content")
    return rows.withColumn("id", message_id(
        F.col("source"), F.col("conversation_id"), F.col("sent_at"), F.col("sender_label"), F.col("content")))


def memories(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus: every document; those with an embedding of the same id carry it."""
    docs, vectors = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    rows = docs.selectExpr(
        "doc_id", "concat('mem-', doc_id) AS id", "concat('p', doc_id % 50) AS person_id",
        "'document' AS kind", "source",
        "timestamp_ntz'2023-12-01 00:00:00' + make_dt_interval(cast(doc_id % 60 AS int)) AS occurred_at",
        "text", "concat('doc-', doc_id) AS record_id", "concat('document ', doc_id) AS citation")
    rows = rows.withColumn("topics", extract_topics_desktop(F.col("text")))
    return rows.join(vectors.selectExpr("vec_id AS doc_id", "embedding"), "doc_id", "left").drop("doc_id")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Memories without vectors and topics, for text-only queries."""
    return table(spark, sf, "documents").selectExpr(
        "concat('mem-', doc_id) AS id", "concat('p', doc_id % 50) AS person_id",
        "'document' AS kind", "source",
        "timestamp_ntz'2023-12-01 00:00:00' + make_dt_interval(cast(doc_id % 60 AS int)) AS occurred_at", "text")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr(
        "concat('mem-', vec_id) AS id", "concat('p', vec_id % 50) AS person_id",
        "concat('src', vec_id % 20) AS source", "embedding")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Search questions: every benchmark passage, with the vector of the same id."""
    items, vecs = table(spark, sf, "benchmark"), table(spark, sf, "embeddings")
    return items.selectExpr("item_id AS qid", "text AS question").join(
        vecs.selectExpr("vec_id AS qid", "embedding AS query_vec"), "qid", "left")


TEMPLATES = [
    "who do I talk to the most",
    "how many messages did {} send me last week",
    "when did I last talk to {}",
    "who did I talk to in the last 7 days",
    "what are my top topics",
    "how many people have I talked to",
    "prepare me for meeting {}",
    "how is our relationship with {} going",
    "what did {} say about the internship",
    "how many emails did I get this month",
    "how many times did I talk to {}",
    "how many meetings do I have in the last 30 days",
    "who are my closest contacts",
    "any voice note from {} yesterday",
    "how many interactions this year on telegram",
    "how many contacts do I have today",
]


def asks(spark: SparkSession, sf: str) -> DataFrame:
    """Conversational questions: one per customer, naming that customer's segment."""
    templates = F.array(*[F.lit(t) for t in TEMPLATES])
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("qid"),
        F.replace(F.element_at(templates, (F.col("c_custkey") % len(TEMPLATES) + 1).cast("int")), F.lit("{}"),
                  F.concat(F.lower("c_mktsegment"), F.lit(" "), (F.col("c_custkey") % 45).cast("string"))
                  ).alias("question"))


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """One event per order line, with two or three attendees; the id names
    the whole line, since order and line number repeat in the data."""
    return table(spark, sf, "lineitem").selectExpr(
        "concat_ws('-', 'cal', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity AS bigint), date_format(l_shipdate, 'yyyyMMdd')) AS id",
        "concat('order ', l_orderkey) AS title", "l_shipdate AS starts_at",
        "l_returnflag AS location", "l_linestatus AS description",
        "array_sort(array_distinct(transform(array(l_suppkey, l_partkey % 100, l_orderkey % 150), x -> concat('p', x)))) AS person_ids")


def calendar_bridge(spark: SparkSession, sf: str) -> DataFrame:
    """The calendar in its flat form: one row per event and attendee."""
    return calendar(spark, sf).select("id", "title", "starts_at", F.explode("person_ids").alias("person_id"))


def emails(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "concat('eml-', o_orderkey) AS id", "concat('p', o_custkey) AS person_id",
        "CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('order ', o_orderstatus) END AS subject",
        "o_orderpriority AS body", "o_orderdate AS sent_at")


def notes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(
        "concat('note-', s_suppkey) AS id", "concat('p', s_suppkey) AS person_id", "s_name AS title",
        "concat('balance ', cast(floor(s_acctbal) AS bigint)) AS body",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(s_suppkey % 30 AS int)) AS noted_at")


def voice(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "concat('voice-', p_partkey) AS id", "concat('p', p_partkey % 150) AS person_id",
        "p_name AS filename",
        "concat('talked with ', CASE p_partkey % 3 WHEN 0 THEN 'Building ' ELSE 'nobody ' END, p_partkey % 40) AS transcript",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(p_partkey % 30 AS int)) AS recorded_at")


def media(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "concat('media-', p_partkey) AS id", "concat('IMG-', p_partkey % 150, '-WA.jpg') AS filename",
        "concat('img-', p_partkey % 150, '-wa.jpg') AS filename_key", "'image' AS kind", "'STORED' AS status")


def attachments(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with one attachment each, as the chat parser produces them."""
    return messages(spark, sf).withColumn("person_id", F.lit(None).cast("string")).withColumn(
        "attachments", F.array(F.struct(
            F.lit("image").alias("kind"),
            F.concat(F.lit("IMG-"), (F.col("seq") * 7 % 150).cast("string"), F.lit("-WA.jpg")).alias("filename"),
            F.concat(F.lit("img-"), (F.col("seq") * 7 % 150).cast("string"), F.lit("-wa.jpg")).alias("filename_key"))))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Import-job events: a job may have passed through several states."""
    return table(spark, sf, "orders").selectExpr(
        "concat('job-', o_orderkey % 5000) AS id", "sha2(concat('file ', o_orderkey % 5000), 256) AS checksum",
        "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'QUEUED' ELSE 'PROCESSING' END AS status",
        "o_orderdate AS created_at", "o_orderkey AS version")


def chat_files(spark: SparkSession, sf: str) -> DataFrame:
    """Chat exports written from the conversations: one file per conversation and
    run of 50 turns; bodies with line breaks become continuation lines."""
    rows = messages(spark, sf).withColumn("_line", F.concat(
        F.date_format("sent_at", "d/M/yy, h:mm a"), F.lit(" - "), F.col("sender_label"), F.lit(": "),
        F.col("content")))
    lines = F.array_sort(F.collect_list(F.struct("seq", "_line")))
    return (rows.groupBy("conversation_id", F.floor(F.col("seq") / 50).alias("part"))
            .agg(F.array_join(F.transform(lines, lambda s: s["_line"]), "\n").alias("text"))
            .select(F.concat("conversation_id", F.lit("-"), F.col("part").cast("string"), F.lit("_chat.txt")).alias("path"), "text"))


def stored_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles as an older run left them: every seventh count is off by one."""
    from rapport.operators.ledger import relationship_status

    rows = relationship_status(events(spark, sf), AS_OF)
    number = F.substring("person_id", 2, 20).cast("bigint")
    return rows.select(
        "person_id", "status", F.col("reason").alias("status_reason"),
        (F.col("interactions") - F.when(number % 7 == 0, 1).otherwise(0)).alias("interaction_count"),
        F.col("n14").alias("interactions_14d"), F.col("n60").alias("interactions_60d"),
        F.col("last_at").alias("last_interaction_at"))


# -- the same views for the SQL oracle --------------------------------------------------

STEMMED = "CASE WHEN length(w) > 5 THEN regexp_replace(w, '(ing|ed|es|s)$', '') ELSE w END"

VIEWS: dict[str, str] = {
    "v_events": """
SELECT 'ev-' || event_id AS id,
       CASE WHEN event_id % 97 = 0 THEN '' ELSE 'p' || user_id END AS person_id,
       CASE event_type WHEN 'click' THEN 'message' WHEN 'view' THEN 'email' WHEN 'purchase' THEN 'meeting'
            WHEN 'signup' THEN 'note' ELSE 'voice' END AS kind,
       'src' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 5) AS source,
       TIMESTAMP '2024-01-31 00:00:00' - (TIMESTAMP '2024-01-31 00:00:00' - ts) * (1 + user_id % 25)
         - to_days(CAST(user_id % 7 * 10 AS INTEGER)) AS occurred_at,
       event_type AS summary, 'rec-' || event_id AS record_id
FROM events""",
    "v_people": """
SELECT 'p' || c_custkey AS person_id,
       c_mktsegment || ' ' || (c_custkey % 40) || CASE WHEN c_custkey % 3 = 0 THEN '!' ELSE '' END AS display_name,
       [c_name] AS aliases, c_custkey = 1 AS is_user,
       TIMESTAMP '2020-01-01 00:00:00' + to_hours(c_custkey % 1000) AS created_at
FROM customer""",
    "v_identities": """
SELECT 'p' || c_custkey AS person_id, 'phone' AS kind, CAST(c_custkey + 9000000000 AS VARCHAR) AS value FROM customer
UNION ALL
SELECT 'p' || c_custkey, 'email', lower(replace(c_name, '#', '.')) || '@x.org' FROM customer""",
    "v_messages": """
SELECT 'msg-' || substr(sha256(concat_ws(chr(31), source, conversation_id,
         strftime(sent_at, '%Y-%m-%dT%H:%M:%S+00:00'), sender_label, content)), 1, 32) AS id, *
FROM (
  SELECT 'c' || conv_id AS conversation_id, turn AS seq,
         ['whatsapp', 'telegram', 'instagram', 'x'][CAST(conv_id % 4 AS INTEGER) + 1] AS source,
         CASE WHEN role = 'user' THEN 'Me' WHEN role = 'system' THEN 'system'
              WHEN conv_id % 5 = 0 THEN 'Contact ' || (conv_id % 20)
              WHEN conv_id % 5 = 1 THEN 'building  ' || (conv_id % 60)
              WHEN conv_id % 5 = 2 THEN 'Customer#' || lpad(CAST(conv_id AS VARCHAR), 9, '0')
              WHEN conv_id % 5 = 3 THEN 'Machinery' ELSE 'Instagram User' END AS sender_label,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS sent_at,
         text AS content
  FROM conversations)""",
    "v_corpus": """
SELECT 'mem-' || doc_id AS id, 'p' || (doc_id % 50) AS person_id, 'document' AS kind, source,
       TIMESTAMP '2023-12-01 00:00:00' + to_days(CAST(doc_id % 60 AS INTEGER)) AS occurred_at, text, doc_id
FROM documents""",
    "v_topics": """
SELECT id, person_id, occurred_at,
       list_sort(list_distinct(list_filter(
         string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '),
         lambda w: length(w) >= 4 AND w NOT IN ({stop}))))[1:8] AS topics
FROM v_corpus""",
    "v_questions": "SELECT item_id AS qid, text AS question, e.embedding AS query_vec "
                   "FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id",
    "v_asks": """
SELECT c_custkey AS qid, replace([{templates}][CAST(c_custkey % {n_templates} AS INTEGER) + 1], '{{}}',
       lower(c_mktsegment) || ' ' || (c_custkey % 45)) AS question
FROM customer""",
    "v_names": """
SELECT name, first(person_id ORDER BY created_at, person_id) AS person_id, min(created_at) AS created_at FROM (
  SELECT person_id, created_at, lower(display_name) AS name FROM v_people UNION ALL
  SELECT person_id, created_at, lower(aliases[1]) FROM v_people) GROUP BY name""",
    "v_hits": """
SELECT q.qid, lower(q.question) AS low, n.* FROM v_asks q JOIN v_names n ON contains(lower(q.question), n.name)""",
    "v_mention": """
SELECT qid, first(person_id ORDER BY length(name) DESC, created_at, person_id) AS person_id FROM v_hits
WHERE regexp_matches(low, '\\b' || regexp_escape(name) || '\\b') GROUP BY qid""",
    "v_calendar": """
SELECT concat_ws('-', 'cal', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS id, 'order ' || l_orderkey AS title,
       l_shipdate AS starts_at, l_returnflag AS location, l_linestatus AS description,
       list_sort(list_distinct(['p' || l_suppkey, 'p' || (l_partkey % 100), 'p' || (l_orderkey % 150)])) AS person_ids
FROM lineitem""",
    "v_bridge": "SELECT id, title, starts_at, unnest(person_ids) AS person_id FROM v_calendar",
    "v_emails": """
SELECT 'eml-' || o_orderkey AS id, 'p' || o_custkey AS person_id,
       CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'order ' || o_orderstatus END AS subject,
       o_orderpriority AS body, o_orderdate AS sent_at FROM orders""",
    "v_notes": """
SELECT 'note-' || s_suppkey AS id, 'p' || s_suppkey AS person_id, s_name AS title,
       'balance ' || CAST(floor(s_acctbal) AS BIGINT) AS body,
       TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(s_suppkey % 30 AS INTEGER)) AS noted_at FROM supplier""",
    "v_voice": """
SELECT 'voice-' || p_partkey AS id, 'p' || (p_partkey % 150) AS person_id, p_name AS filename,
       'talked with ' || CASE p_partkey % 3 WHEN 0 THEN 'Building ' ELSE 'nobody ' END || (p_partkey % 40) AS transcript,
       TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(p_partkey % 30 AS INTEGER)) AS recorded_at FROM part""",
    "v_media": """
SELECT 'media-' || p_partkey AS id, 'IMG-' || (p_partkey % 150) || '-WA.jpg' AS filename,
       'img-' || (p_partkey % 150) || '-wa.jpg' AS filename_key FROM part""",
    "v_jobs": """
SELECT 'job-' || (o_orderkey % 5000) AS id, sha256('file ' || (o_orderkey % 5000)) AS checksum,
       CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'QUEUED' ELSE 'PROCESSING' END AS status,
       o_orderdate AS created_at, o_orderkey AS version FROM orders""",
    "v_stats": """
SELECT person_id, count(*) AS interactions, max(occurred_at) AS last_at,
       count(*) FILTER (WHERE occurred_at >= TIMESTAMP '2024-01-11 00:00:00' AND occurred_at <= TIMESTAMP '2024-01-25 00:00:00') AS n14,
       count(*) FILTER (WHERE occurred_at >= TIMESTAMP '2023-11-26 00:00:00' AND occurred_at <= TIMESTAMP '2024-01-25 00:00:00') AS n60
FROM v_events WHERE person_id <> '' GROUP BY person_id""",
    "v_status": """
SELECT *, CASE WHEN days > 45 THEN 'No Recent Activity' WHEN n14 >= 15 THEN 'Very Active' WHEN n14 >= 5 THEN 'Active'
               WHEN n60 >= 3 THEN 'Occasional' WHEN days <= 30 THEN 'Low Activity' ELSE 'No Recent Activity' END AS status,
       CASE WHEN days > 45 THEN 'No interactions in the last ' || days || ' days.'
            WHEN n14 >= 5 THEN n14 || ' interactions in the last 14 days.'
            WHEN n60 >= 3 THEN n60 || ' interactions in the last 60 days (' || n14 || ' in the last 14).'
            WHEN days <= 30 THEN n60 || ' interactions in the last 60 days; last interaction ' || days || ' days ago.'
            ELSE 'Last interaction ' || days || ' days ago.' END AS reason
FROM (SELECT *, CAST(floor((epoch_us(TIMESTAMP '2024-01-25 00:00:00') - epoch_us(last_at)) / 86400000000.0) AS BIGINT) AS days
      FROM v_stats)""",
    "v_profiles": """
SELECT person_id, status, reason AS status_reason, n14 AS interactions_14d, n60 AS interactions_60d,
       last_at AS last_interaction_at,
       interactions - CASE WHEN CAST(substr(person_id, 2) AS BIGINT) % 7 = 0 THEN 1 ELSE 0 END AS interaction_count
FROM v_status""",
    "v_terms": """
SELECT DISTINCT qid, {stem} AS term FROM (
  SELECT qid, unnest(string_split_regex(lower(question), '[^\\p{L}\\p{N}_]+')) AS w FROM v_questions)
WHERE length(w) >= 3 AND NOT regexp_matches(w, '^\\p{N}+$') AND w NOT IN ({search_stop})""",
    "v_tokens": """
SELECT id, {stem} AS term FROM (
  SELECT id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+')) AS w FROM v_corpus) WHERE w <> ''""",
    "v_lengths": "SELECT c.id, coalesce(n, 0) AS doc_len FROM v_corpus c LEFT JOIN "
                 "(SELECT id, count(*) AS n FROM v_tokens GROUP BY id) t ON t.id = c.id",
    "v_scores": """
SELECT qid, p.id, sum(ln(1 + (n.docs - d.df + 0.5) / (d.df + 0.5)) * tf * 2.2
        / (tf + 1.2 * (1 - 0.75 + 0.75 * l.doc_len / n.avg_len))) AS score
FROM v_terms q
JOIN (SELECT id, term, count(*) AS tf FROM v_tokens GROUP BY id, term) p ON p.term = q.term
JOIN (SELECT term, count(DISTINCT id) AS df FROM v_tokens GROUP BY term) d ON d.term = q.term
JOIN v_lengths l ON l.id = p.id
CROSS JOIN (SELECT count(*) AS docs, avg(doc_len) AS avg_len FROM v_lengths) n
GROUP BY qid, p.id""",
    "v_vectors": "SELECT 'mem-' || vec_id AS id, 'p' || (vec_id % 50) AS person_id, 'src' || (vec_id % 20) AS source, "
                 "embedding FROM embeddings",
    "v_cosine": """
SELECT q.qid, v.id, v.person_id, v.source, round(list_dot_product(CAST(q.query_vec AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))
   / (sqrt(list_dot_product(CAST(q.query_vec AS DOUBLE[]), CAST(q.query_vec AS DOUBLE[])))
      * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))), 6) AS score
FROM v_questions q, v_vectors v WHERE q.query_vec IS NOT NULL""",
    "v_dups": """
SELECT r.key, k.keeper_id, r.person_id FROM v_keys r JOIN (
  SELECT key, first(person_id ORDER BY n DESC, person_id) AS keeper_id FROM v_keys GROUP BY key HAVING count(*) > 1) k
ON k.key = r.key AND k.keeper_id <> r.person_id""",
    "v_keys": """
SELECT p.person_id, regexp_replace(lower(display_name), '[^\\p{L}\\p{N}_]', '', 'g') AS key, coalesce(n, 0) AS n
FROM v_people p LEFT JOIN (SELECT person_id, count(*) AS n FROM v_events GROUP BY person_id) e ON e.person_id = p.person_id
WHERE NOT is_user""",
}


def with_views(body: str) -> str:
    """``body`` with the CTEs of every view it (transitively) names in front."""
    from rapport import constants as K

    quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    fills = {"stop": quoted(K.DESKTOP_STOPWORDS), "search_stop": quoted(K.SEARCH_STOPWORDS), "stem": STEMMED,
             "templates": quoted(TEMPLATES), "n_templates": str(len(TEMPLATES))}
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name, view in VIEWS.items():
            if name in needed or not _names(sql, name):
                continue
            visit(view)
            if name not in needed:
                needed.append(name)

    visit(body)
    ctes = []
    for name in needed:
        view = VIEWS[name]
        for key, value in fills.items():
            view = view.replace("{" + key + "}", value)
        ctes.append(f"{name} AS {'MATERIALIZED ' if name == 'v_hits' else ''}({view.replace('{{}}', '{}')})")
    if not ctes:
        return body
    joiner = ", " if body.lstrip().upper().startswith("WITH ") else " "
    if joiner == ", ":
        recursive = body.lstrip()[5:].lstrip()
        is_recursive = recursive.upper().startswith("RECURSIVE ")
        rest = recursive[10:] if is_recursive else recursive
        return ("WITH RECURSIVE " if is_recursive else "WITH ") + ",\n".join(ctes) + ",\n" + rest
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _names(sql: str, name: str) -> bool:
    import re

    return re.search(rf"\b{name}\b", sql) is not None
