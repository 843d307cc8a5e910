"""Queries for retrieval, question answering and identity resolution."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rapport import constants as K
from rapport.functions import questions as Q
from rapport.functions import text as T
from rapport.functions.evidence import clean_citations, used_labels
from rapport.functions.topics import content_terms, extract_topics, extract_topics_desktop
from rapport.operators import answers as A
from rapport.operators import media_links as ML
from rapport.operators import resolution as RS
from rapport.operators import retrieval as S
from rapport.operators import timeline as TL
from rapport.operators.profiles import topic_counts
from rapport.plans import fixtures as X
from rapport.session import cut_lineage, ensure_checkpoint_dir
from rapport.sinks import people as PL
from rapport.sinks import segments as SG

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = (fn, X.with_views(sql) if sql else None)
        return fn
    return register


def big(c):
    return F.col(c).cast("bigint").alias(c)


# -- retrieval ----------------------------------------------------------------------

@query("r1_inverted_index", """
SELECT t.id, t.term, count(*) AS tf, any_value(l.doc_len) AS doc_len FROM v_tokens t JOIN v_lengths l ON l.id = t.id
GROUP BY t.id, t.term""")
def r1_index(spark, sf):
    return S.postings(X.corpus(spark, sf)).select("id", "term", "tf", "doc_len")


@query("r1_term_statistics", """
SELECT term, count(DISTINCT id) AS df, count(*) AS occurrences FROM v_tokens GROUP BY term""")
def r1_terms(spark, sf):
    return S.postings(X.corpus(spark, sf)).groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


KEYWORD = """
SELECT qid, id, score, rank FROM (SELECT qid, id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM v_scores) WHERE rank <= {k}"""
VECTOR = """
SELECT qid, id, score, rank FROM (SELECT qid, id, score,
  row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM v_cosine) WHERE rank <= {k}"""


@query("r2_keyword_search", "SELECT qid, id, rank FROM (" + KEYWORD.format(k=12) + ")")
def r2_keyword(spark, sf):
    return S.keyword_search(X.questions(spark, sf), X.corpus(spark, sf), 12).select("qid", "id", big("rank"))


@query("r2_keyword_search_filtered", """
SELECT qid, id, rank FROM (SELECT qid, s.id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, s.id) AS rank
 FROM v_scores s JOIN v_corpus c ON c.id = s.id
 WHERE c.person_id = 'p' || (qid % 50) AND c.occurred_at >= TIMESTAMP '2023-12-10') WHERE rank <= 12""")
def r2_filtered(spark, sf):
    asked = X.questions(spark, sf).withColumn("person_id", F.concat(F.lit("p"), (F.col("qid") % 50).cast("string"))
        ).withColumn("after", F.lit("2023-12-10 00:00:00").cast("timestamp_ntz"))
    return S.keyword_search(asked, X.corpus(spark, sf), 12).select("qid", "id", big("rank"))


def _segments(spark, sf):
    """An index of the corpus in five segments, three of which were merged."""
    ensure_checkpoint_dir(spark)
    corpus = X.corpus(spark, sf)
    part = F.pmod(F.xxhash64("id"), F.lit(5))
    index = SG.indexed(spark, f"{spark.sparkContext.getCheckpointDir()}/segments-{uuid.uuid4().hex}", [corpus.where(part == i) for i in range(5)])
    index.merge([0, 2, 3])
    return index


@query("r1_segment_terms", """
SELECT term, count(DISTINCT id) AS df, count(*) AS occurrences FROM v_tokens GROUP BY term""")
def r1_segment_terms(spark, sf):
    return _segments(spark, sf).term_counts()


@query("r2_segment_search", "SELECT qid, id, rank FROM (" + KEYWORD.format(k=12) + ")")
def r2_segments(spark, sf):
    return _segments(spark, sf).search(X.questions(spark, sf), 12).select("qid", "id", big("rank"))


@query("j3_hits_with_memory", """
SELECT h.qid, h.id, c.source, c.person_id FROM (""" + KEYWORD.format(k=12) + """) h JOIN v_corpus c ON c.id = h.id
WHERE c.source IN ('src1', 'src2', 'src3')""")
def j3_hits(spark, sf):
    hits = S.keyword_search(X.questions(spark, sf), X.corpus(spark, sf), 12)
    return hits.join(X.corpus(spark, sf), "id").where(F.col("source").isin("src1", "src2", "src3")).select(
        "qid", "id", "source", "person_id")


@query("r3_substring_fallback", """
SELECT qid, id, round(1.0 / rank, 6) AS score FROM (
 SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS rank FROM (
  SELECT DISTINCT qid, c.id FROM v_corpus c JOIN (
    SELECT item_id AS qid, substr(regexp_extract(lower(text), '[a-z]{{6}}'), 2, 4) AS needle FROM benchmark) q
  ON length(needle) >= 3 AND regexp_matches(needle, '^[a-z]+$') AND needle NOT IN ({stop}) AND contains(lower(c.text), needle)))
WHERE rank <= 5""".format(stop=", ".join(f"'{w}'" for w in K.SEARCH_STOPWORDS)))
def r3_fallback(spark, sf):
    needles = F.substring(F.regexp_extract(F.lower("text"), "[a-z]{6}", 0), 2, 4)
    asked = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), needles.alias("question"))
    return S.substring_search(asked, X.corpus(spark, sf), 5).select("qid", "id", "score")


@query("r4_vector_search", VECTOR.format(k=10))
def r4_vector(spark, sf):
    return S.vector_search(X.questions(spark, sf), X.vectors(spark, sf), 10).withColumn("rank", big("rank"))


@query("r4_vector_search_filtered", """
SELECT qid, id, rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
 FROM v_cosine WHERE source = 'src' || (qid % 20)) WHERE rank <= 5""")
def r4_filtered(spark, sf):
    asked = X.questions(spark, sf).withColumn("source", F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")))
    return S.vector_search(asked, X.vectors(spark, sf), 5).select("qid", "id", big("rank"))


FUSED = """
SELECT coalesce(v.qid, k.qid) AS qid, coalesce(v.id, k.id) AS id, round({score}, 6) AS score,
       v.rank - 1 AS vector_rank, k.rank - 1 AS keyword_rank
FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM (""" + VECTOR.replace("{k}", "{nv}") + """)) v
FULL OUTER JOIN (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM (""" + KEYWORD.replace("{k}", "{nk}") + """)) k
ON v.qid = k.qid AND v.id = k.id"""
NORM = FUSED.format(nv=8, nk=8, score="coalesce(1.0::DOUBLE * (1 - (v.rank - 1) / v.n::DOUBLE), 0) "
                                      "+ coalesce(0.7::DOUBLE * (1 - (k.rank - 1) / k.n::DOUBLE), 0)")
RRF = FUSED.format(nv=20, nk=12, score="coalesce(1 / (60 + v.rank)::DOUBLE, 0) + coalesce(1 / (60 + k.rank)::DOUBLE, 0)")


def _fused(spark, sf, method):
    asked, vectors = X.questions(spark, sf), X.vectors(spark, sf)
    nv, nk = (8, 8) if method == "rank_norm" else (20, 12)
    return S.fuse(S.vector_search(asked, vectors, nv), S.keyword_search(asked, X.corpus(spark, sf), nk), method)


def _big_ranks(df):
    return df.withColumn("vector_rank", big("vector_rank")).withColumn("keyword_rank", big("keyword_rank"))


@query("r6_fusion_rank_norm", NORM)
def r6_fusion(spark, sf):
    return _big_ranks(_fused(spark, sf, "rank_norm"))


@query("r7_fusion_rrf", RRF)
def r7_fusion(spark, sf):
    return _big_ranks(_fused(spark, sf, "rrf"))


TRIM = """CASE WHEN length(t) <= {n} THEN t ELSE rtrim(CASE WHEN instr(reverse(substr(t, 1, {n})), ' ') > 0
  AND {n} - instr(reverse(substr(t, 1, {n})), ' ') > {n} * 0.6
  THEN substr(t, 1, {n} - instr(reverse(substr(t, 1, {n})), ' ')) ELSE substr(t, 1, {n}) END, ' ' || chr(10)) || '…' END"""


def evidence_sql(k, chars, total):
    return f"""
WITH RECURSIVE fused AS ({NORM}),
ranked AS (SELECT f.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, f.id) AS rn, {TRIM.format(n=chars)} AS snippet
           FROM fused f JOIN (SELECT id, trim(text, ' ' || chr(10)) AS t FROM v_corpus) c ON c.id = f.id),
fold AS (
  SELECT qid, 0::BIGINT AS rn, 0::BIGINT AS used, 0::BIGINT AS taken, FALSE AS pick FROM (SELECT DISTINCT qid FROM ranked)
  UNION ALL
  SELECT f.qid, r.rn, CASE WHEN g THEN f.used + length(r.snippet) ELSE f.used END,
         CASE WHEN g THEN f.taken + 1 ELSE f.taken END, g
  FROM (SELECT f.*, r.rn AS next, (f.taken < {k} AND (f.taken = 0 OR f.used + length(r.snippet) <= {total})) AS g
        FROM fold f JOIN ranked r ON r.qid = f.qid AND r.rn = f.rn + 1) f
  JOIN ranked r ON r.qid = f.qid AND r.rn = f.next)
SELECT r.qid, r.id, 'S' || f.taken AS label, r.snippet AS text,
  CASE WHEN vector_rank IS NOT NULL AND keyword_rank IS NOT NULL THEN 'hybrid' WHEN vector_rank IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS matched_by
FROM fold f JOIN ranked r ON r.qid = f.qid AND r.rn = f.rn WHERE f.pick"""


@query("r8_evidence_answer", evidence_sql(4, 240, 700))
def r8_evidence(spark, sf):
    rows = S.evidence(_fused(spark, sf, "rank_norm"), X.corpus(spark, sf), (4, 240, 700))
    return rows.select("qid", "id", "label", "text", "matched_by")


@query("r8_evidence_block", f"""
WITH picked AS ({evidence_sql(*K.BUDGET_ANSWER)})
SELECT qid, string_agg('[' || label || '] ' || source || ' ' || kind || ' | ' || strftime(occurred_at, '%Y-%m-%d %H:%M')
    || CASE WHEN display_name IS NULL THEN '' ELSE ' | person: ' || display_name END
    || chr(10) || '"' || picked.text || '"', chr(10) || chr(10) ORDER BY CAST(substr(label, 2) AS INTEGER)) AS evidence
FROM picked JOIN v_corpus c USING (id) LEFT JOIN v_people p ON p.person_id = c.person_id GROUP BY qid""")
def r8_block(spark, sf):
    corpus = X.corpus(spark, sf)
    rows = S.evidence(_fused(spark, sf, "rank_norm"), corpus, K.BUDGET_ANSWER, X.people(spark, sf))
    return S.evidence_block(rows)


@query("r14_search_person")
def r14_search(spark, sf):
    asked = X.questions(spark, sf).withColumn("person_id", F.concat(F.lit("p"), (F.col("qid") % 50).cast("string")))
    corpus = X.corpus(spark, sf).join(X.vectors(spark, sf).select("id", "embedding"), "id", "left")
    return S.search(asked, corpus, 5).select("qid", "id", "label", "snippet", "matched_by")


# -- questions ------------------------------------------------------------------------

@query("f15_content_terms", """
SELECT id, count(DISTINCT term) AS terms, min(term) AS lo, max(term) AS hi FROM (
 SELECT id, CASE WHEN length(w) > 5 THEN regexp_replace(w, '(ing|ed|es|s)$', '') ELSE w END AS term FROM (
  SELECT id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+')) AS w FROM v_corpus)
 WHERE length(w) >= 3 AND NOT regexp_matches(w, '^\\p{N}+$') AND w NOT IN (""" + ", ".join(f"'{w}'" for w in K.SEARCH_STOPWORDS) + """))
GROUP BY id""")
def f15_terms(spark, sf):
    rows = X.corpus(spark, sf).select("id", F.array_sort(content_terms(F.col("text"))).alias("t")).where(F.size("t") > 0)
    return rows.select("id", F.size("t").cast("bigint").alias("terms"), F.element_at("t", 1).alias("lo"),
                       F.element_at("t", -1).alias("hi"))


@query("f16_topics_desktop", "SELECT id, array_to_string(topics, ',') AS topics FROM v_topics")
def f16_desktop(spark, sf):
    return X.corpus(spark, sf).select("id", F.array_join(extract_topics_desktop(F.col("text")), ",").alias("topics"))


@query("f16_topics_classic")
def f16_classic(spark, sf):
    return X.corpus(spark, sf).select("id", F.array_join(extract_topics(F.col("text")), ",").alias("topics"))


def _window_sql(q="lower(question)"):
    arms = " ".join(f"WHEN regexp_matches({q}, '{p}') THEN {d}" for p, d in K.CUTOFF_PATTERNS)
    return f"CASE {arms} END"


def _source_sql(q="lower(question)"):
    voice = " OR ".join(f"contains({q}, '{v}')" for v in K.VOICE_HINTS)
    arms = " ".join(f"WHEN regexp_matches({q}, '\\b{s}\\b') THEN '{s}'" for s in K.SOURCES)
    return f"CASE WHEN {voice} THEN 'voice' {arms} END"


def _kind_sql(q="lower(question)"):
    arms = []
    for unit in sorted(K.ACTIVITY_UNITS, key=len, reverse=True):
        kind = K.ACTIVITY_UNITS[unit]
        arms.append(f"WHEN regexp_matches({q}, '\\b{unit}\\b') THEN " + (f"'{kind}'" if kind else "NULL"))
    return "CASE " + " ".join(arms) + " END"


@query("f22_f23_f24_question_reading",
       f"SELECT qid, {_window_sql()} AS window_days, {_source_sql()} AS source, {_kind_sql()} AS counted_kind FROM v_asks")
def f23_reading(spark, sf):
    q = F.col("question")
    return X.asks(spark, sf).select("qid", Q.window_days(q).alias("window_days"), Q.source_hint(q).alias("source"),
                                    Q.activity_kind(q).alias("counted_kind"))


INTENTS = ["top_people", "activity_count", "last_interaction", "recent_people", "top_topics", "people_count",
           "prepare", "summary", "ask", "activity_count", "activity_count", "activity_count", "top_people", "ask",
           "activity_count", "people_count"]


@query("f22_intent", "SELECT qid, [" + ", ".join(f"'{i}'" for i in INTENTS)
       + f"][CAST(qid % {len(X.TEMPLATES)} AS INTEGER) + 1] AS intent FROM v_asks")
def f22_intent(spark, sf):
    return X.asks(spark, sf).select("qid", Q.intent(F.col("question")).alias("intent"))


MENTION = "SELECT qid, person_id FROM v_mention"


@query("j8_person_in_question", MENTION)
def j8_mentions(spark, sf):
    return RS.person_in_question(X.asks(spark, sf), X.people(spark, sf))


@query("r10_question_plan", f"""
SELECT q.qid, [{", ".join(f"'{i}'" for i in INTENTS)}][CAST(q.qid % {len(X.TEMPLATES)} AS INTEGER) + 1] AS intent,
       {_window_sql()} AS window_days, {_source_sql()} AS source, {_kind_sql()} AS counted_kind, m.person_id
FROM v_asks q LEFT JOIN ({MENTION}) m ON m.qid = q.qid""")
def r10_plan(spark, sf):
    return A.plan_questions(X.asks(spark, sf), X.people(spark, sf)).drop("question")


PLAN = f"""
SELECT q.qid, [{", ".join(f"'{i}'" for i in INTENTS)}][CAST(q.qid % {len(X.TEMPLATES)} AS INTEGER) + 1] AS intent,
       {_window_sql()} AS window_days, {_source_sql()} AS source, {_kind_sql()} AS counted_kind, m.person_id,
       CASE WHEN {_window_sql()} IS NULL THEN 'across your whole imported archive'
            WHEN {_window_sql()} = 1 THEN 'in the last 1 day' ELSE 'in the last ' || ({_window_sql()}) || ' days' END AS scope
FROM v_asks q LEFT JOIN ({MENTION}) m ON m.qid = q.qid"""
IN_WINDOW = f"""e.occurred_at <= TIMESTAMP '{X.AS_OF}'
  AND (p.window_days IS NULL OR e.occurred_at >= TIMESTAMP '{X.AS_OF}' - to_days(CAST(p.window_days AS INTEGER)))"""


def _plan(spark, sf):
    return A.plan_questions(X.asks(spark, sf), X.people(spark, sf))


def _counts(spark, sf):
    return A.window_counts(X.events(spark, sf), X.AS_OF)


@query("a14_activity_answers", f"""
WITH plan AS ({PLAN}), c AS (
 SELECT p.qid, count(e.id) AS n FROM plan p LEFT JOIN v_events e ON {IN_WINDOW}
   AND (p.person_id IS NULL OR e.person_id = p.person_id) AND (p.source IS NULL OR e.source = p.source)
   AND (p.counted_kind IS NULL OR e.kind = p.counted_kind)
 WHERE p.intent = 'activity_count' GROUP BY p.qid)
SELECT p.qid, format('{{:,}}', n) || ' ' || CASE p.counted_kind WHEN 'voice' THEN 'voice note' ELSE coalesce(p.counted_kind, 'interaction') END
   || CASE WHEN n = 1 THEN '' ELSE 's' END || ' ' || coalesce('with ' || v.display_name, 'in your archive') || ' ' || scope || '.' AS snippet,
   p.person_id
FROM plan p JOIN c ON c.qid = p.qid LEFT JOIN v_people v ON v.person_id = p.person_id""")
def a14_activity(spark, sf):
    return A.activity_answers(_plan(spark, sf), _counts(spark, sf), X.people(spark, sf)).select(
        "qid", "snippet", "person_id")


@query("a14_people_count_answers", f"""
WITH plan AS ({PLAN})
SELECT p.qid, format('{{:,}}', count(DISTINCT e.person_id)) || ' distinct people ' || any_value(scope) || '.' AS snippet
FROM plan p LEFT JOIN v_events e ON {IN_WINDOW} AND e.person_id <> '' WHERE p.intent = 'people_count' GROUP BY p.qid""")
def a14_people(spark, sf):
    return A.people_count_answers(_plan(spark, sf), _counts(spark, sf)).select("qid", "snippet")


@query("a14_last_interaction_answers", f"""
WITH plan AS ({PLAN})
SELECT p.qid, p.person_id, max(e.occurred_at) AS occurred_at FROM plan p JOIN v_events e
 ON p.person_id IS NULL OR e.person_id = p.person_id WHERE p.intent = 'last_interaction' GROUP BY p.qid, p.person_id""")
def a14_last(spark, sf):
    return A.last_interaction_answers(_plan(spark, sf), _counts(spark, sf), X.people(spark, sf)).select(
        "qid", "person_id", "occurred_at")


@query("a14_ranking_answers", f"""
WITH plan AS ({PLAN}), r AS (
 SELECT window_days, person_id, n, last, row_number() OVER (PARTITION BY window_days ORDER BY n DESC, person_id) AS rank FROM (
  SELECT p.window_days, e.person_id, count(*) AS n, max(e.occurred_at) AS last
  FROM (SELECT DISTINCT window_days FROM plan WHERE intent IN ('top_people', 'recent_people')) p JOIN v_events e
  ON e.person_id <> '' AND (p.window_days IS NULL OR (e.occurred_at <= TIMESTAMP '{X.AS_OF}'
     AND e.occurred_at >= TIMESTAMP '{X.AS_OF}' - to_days(CAST(p.window_days AS INTEGER)))) GROUP BY 1, 2))
SELECT p.qid, p.intent, 'P' || r.rank AS label, r.person_id, r.last AS occurred_at,
  coalesce(v.display_name, 'Unknown contact') || ': ' || format('{{:,}}', n) || ' interactions' ||
  CASE WHEN p.intent = 'top_people' THEN ', last ' || strftime(r.last, '%b %d, %Y') ELSE ' ' || scope END AS citation
FROM plan p JOIN r ON r.window_days IS NOT DISTINCT FROM p.window_days AND rank <= CASE WHEN p.intent = 'top_people' THEN 5 ELSE 10 END
LEFT JOIN v_people v ON v.person_id = r.person_id WHERE p.intent IN ('top_people', 'recent_people')""")
def a14_ranking(spark, sf):
    return A.ranking_answers(_plan(spark, sf), X.events(spark, sf), X.people(spark, sf), X.AS_OF).select(
        "qid", "intent", "label", "person_id", "occurred_at", "citation")


@query("r11_route_outcome")
def r11_route(spark, sf):
    people, memories = X.people(spark, sf), X.memories(spark, sf)
    asked = X.asks(spark, sf).withColumn("query_vec", F.lit(None).cast("array<float>"))
    _, _, outcome = A.route(asked, X.events(spark, sf), people, topic_counts(memories, people, X.AS_OF),
                            X.corpus(spark, sf).withColumn("embedding", F.lit(None).cast("array<float>")), X.AS_OF)
    return outcome


@query("r12_brief_inputs")
def r12_brief(spark, sf):
    fused = S.keyword_search(X.questions(spark, sf), X.corpus(spark, sf), 12).select(
        "qid", "id", "score", F.lit(None).cast("int").alias("vector_rank"), (F.col("rank") - 1).alias("keyword_rank"))
    corpus = X.corpus(spark, sf).withColumn("citation", T.citation(F.col("source"), F.col("occurred_at")))
    rows = S.evidence(fused, corpus, K.BUDGET_BRIEF)
    return A.brief_inputs(X.stored_profiles(spark, sf), X.people(spark, sf), rows)


def _answers(spark, sf):
    """Draft answers built from the questions' own text, citing real and invented labels."""
    n = F.col("qid") % 4
    return X.questions(spark, sf).select("qid", F.concat(
        F.col("question"), F.when(n == 0, F.lit(" [S1, S9]")).when(n == 1, F.lit(" [S2]  and [S77] more [S1]"))
        .when(n == 2, F.lit(" [S50]")).otherwise(F.lit(""))).alias("answer"))


LABELS = "SELECT qid, unnest(['S1', 'S2', 'S3']) AS label FROM v_questions"


@query("r13_accept_answers", f"""
SELECT qid, CASE qid % 4 WHEN 0 THEN trim(regexp_replace(question, '[ \\t]{{2,}}', ' ', 'g') || ' [S1]')
  WHEN 1 THEN trim(regexp_replace(question, '[ \\t]{{2,}}', ' ', 'g') || ' [S2] and more [S1]')
  ELSE '{K.INSUFFICIENT.replace("'", "''")}' END AS answer,
  CASE qid % 4 WHEN 0 THEN 'S1' WHEN 1 THEN 'S2,S1' ELSE '' END AS used, qid % 4 > 1 AS insufficient FROM v_questions""")
def r13_accept(spark, sf):
    labels = X.questions(spark, sf).select("qid", F.explode(F.array(*[F.lit(f"S{i}") for i in (1, 2, 3)])).alias("label"))
    return A.accept_answers(_answers(spark, sf), labels).withColumn("used", F.array_join("used", ","))


@query("f30_validate_citations", """
SELECT qid, CASE qid % 4 WHEN 0 THEN 'S1' WHEN 1 THEN 'S2,S1' ELSE '' END AS used FROM v_questions""")
def f30_citations(spark, sf):
    known = F.array(F.lit("S1"), F.lit("S2"))
    return _answers(spark, sf).select("qid", F.array_join(used_labels(F.col("answer"), known), ",").alias("used"))


# -- resolution -------------------------------------------------------------------------

@query("x2_resolve_senders", """
WITH labels AS (SELECT DISTINCT sender_label AS label, regexp_replace(sender_label, '\\s+', ' ', 'g') AS clean,
   trim(regexp_replace(lower(sender_label), '[^a-z0-9]+', ' ', 'g')) AS norm FROM v_messages),
names AS (SELECT norm, first(person_id ORDER BY created_at, person_id) AS person_id FROM (
   SELECT person_id, created_at, trim(regexp_replace(lower(unnest([display_name, aliases[1]])), '[^a-z0-9]+', ' ', 'g')) AS norm
   FROM v_people) GROUP BY norm),
firsts AS (SELECT split_part(norm, ' ', 1) AS norm, count(DISTINCT person_id) AS c, first(person_id ORDER BY created_at, person_id) AS earliest
   FROM (SELECT person_id, created_at, trim(regexp_replace(lower(unnest([display_name, aliases[1]])), '[^a-z0-9]+', ' ', 'g')) AS norm
   FROM v_people) GROUP BY 1)
SELECT l.label, CASE WHEN l.norm IN ('me', 'instagram user') THEN NULL WHEN n.person_id IS NOT NULL THEN n.person_id
     WHEN f.c = 1 THEN f.earliest ELSE 'person-' || substr(sha256('sender' || chr(31) || l.norm), 1, 32) END AS person_id,
  CASE WHEN l.norm = 'me' THEN 'owner' WHEN l.norm = 'instagram user' THEN 'placeholder' WHEN n.person_id IS NOT NULL THEN 'name'
     WHEN f.c = 1 THEN 'first_name' ELSE 'new' END AS how,
  CASE WHEN n.person_id IS NULL AND f.c > 1 THEN f.earliest END AS suggested_id
FROM labels l LEFT JOIN names n ON n.norm = l.norm LEFT JOIN firsts f ON f.norm = l.norm""")
def x2_senders(spark, sf):
    return _resolved(spark, sf).select("label", "person_id", "how", "suggested_id")


def _resolved(spark, sf):
    labels = X.messages(spark, sf).select(F.col("sender_label").alias("label"))
    return RS.resolve_senders(labels, X.people(spark, sf), X.identities(spark, sf))


def _assigned(spark, sf):
    return RS.assign_people(X.messages(spark, sf), _resolved(spark, sf))


@query("j14_unknown_senders", """
SELECT DISTINCT sender_label AS label FROM v_messages WHERE trim(regexp_replace(lower(sender_label), '[^a-z0-9]+', ' ', 'g')) NOT IN (
  SELECT trim(regexp_replace(lower(unnest([display_name, aliases[1]])), '[^a-z0-9]+', ' ', 'g')) FROM v_people)
AND sender_label NOT IN ('Me', 'Instagram User')""")
def j14_unknown(spark, sf):
    return _resolved(spark, sf).where(F.col("how") == "new").select("label")


@query("x3_one_to_one_rule", """
WITH party AS (SELECT conversation_id, count(DISTINCT sender_label) AS c, min(sender_label) AS label FROM v_messages
  WHERE sender_label NOT IN ('Me', 'Instagram User') GROUP BY conversation_id)
SELECT m.id, coalesce(p.c = 1, FALSE) AS one_to_one,
   CASE WHEN m.sender_label NOT IN ('Me', 'Instagram User') OR p.c = 1 THEN TRUE ELSE FALSE END AS has_person
FROM v_messages m LEFT JOIN party p ON p.conversation_id = m.conversation_id""")
def x3_rule(spark, sf):
    return _assigned(spark, sf).select("id", "one_to_one", F.col("person_id").isNotNull().alias("has_person"))


@query("j10_conversation_participants", """
SELECT DISTINCT conversation_id, trim(regexp_replace(lower(sender_label), '[^a-z0-9]+', ' ', 'g')) AS party FROM v_messages
WHERE sender_label NOT IN ('Me', 'Instagram User')""")
def j10_participants(spark, sf):
    who = _resolved(spark, sf).select("person_id", F.col("norm").alias("party")).where("person_id is not null")
    return RS.conversation_participants(_assigned(spark, sf)).join(
        who.dropDuplicates(["person_id"]), "person_id").select("conversation_id", "party")


@query("x4_ledger_emission", """
SELECT kind, source, count(*) AS n, count(DISTINCT person_id) AS people FROM (
 SELECT 'email' AS kind, 'email' AS source, person_id FROM v_emails UNION ALL
 SELECT 'meeting', 'calendar', person_id FROM v_bridge UNION ALL SELECT 'note', 'notes', person_id FROM v_notes UNION ALL
 SELECT 'voice', 'voice', person_id FROM v_voice) GROUP BY kind, source""")
def x4_emission(spark, sf):
    rows = RS.ledger_events(_assigned(spark, sf), X.emails(spark, sf), X.calendar(spark, sf), X.notes(spark, sf),
                            X.voice(spark, sf))
    return rows.where(F.col("kind") != "message").groupBy("kind", "source").agg(
        F.count("*").alias("n"), F.count_distinct("person_id").alias("people"))


@query("x4_ledger_ids", """
SELECT 'evt-' || substr(sha256(concat_ws(chr(31), person_id, 'meeting', id, strftime(starts_at, '%Y-%m-%dT%H:%M:%S') || '.000000')), 1, 32) AS id,
   person_id, title AS summary, id AS record_id FROM v_bridge""")
def x4_ids(spark, sf):
    rows = RS.ledger_events(_assigned(spark, sf), X.emails(spark, sf), X.calendar(spark, sf), X.notes(spark, sf),
                            X.voice(spark, sf))
    return rows.where(F.col("kind") == "meeting").select("id", "person_id", "summary", "record_id")


def _contacts(spark, sf):
    """Suppliers as contacts: some share a customer's address, phone or name."""
    return X.table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "CASE WHEN s_suppkey % 4 = 2 THEN concat('customer ', lpad(s_suppkey, 9, '0')) ELSE s_name END AS name",
        "CASE WHEN s_suppkey % 4 = 0 THEN concat('Customer.', lpad(s_suppkey, 9, '0'), '@x.org ') ELSE '' END AS email",
        "CASE WHEN s_suppkey % 4 = 1 THEN concat('+91 ', s_suppkey + 9000000000) ELSE '' END AS phone",
        "'' AS organization")


@query("x1_contact_ingest", """
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'name' ELSE 'new' END AS how,
  CASE WHEN s_suppkey % 4 < 3 THEN 'p' || s_suppkey
       ELSE 'person-' || substr(sha256('contact' || chr(31) || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g'))), 1, 32) END AS person_id
FROM supplier""")
def x1_contacts(spark, sf):
    return RS.resolve_contacts(_contacts(spark, sf), X.people(spark, sf), X.identities(spark, sf)).select(
        "s_suppkey", "how", "person_id")


def _nicknamed(spark, sf):
    """The same contacts with a nickname, and a handle for every second one, resolved."""
    contacts = _contacts(spark, sf).withColumns({
        "aliases": F.array(F.concat(F.lit("nick "), F.col("s_suppkey").cast("string"))),
        "usernames": F.expr("IF(s_suppkey % 2 = 0, array(named_struct('kind', 'telegram', 'value', concat('Handle', s_suppkey))), NULL)")})
    return RS.resolve_contacts(contacts, X.people(spark, sf), X.identities(spark, sf))


#: Who a contact is, as in ``x1_contact_ingest``.
CONTACT_SQL = """WITH met AS (SELECT s_suppkey, s_name, s_suppkey % 4 AS way,
  trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS norm FROM supplier),
 who AS (SELECT *, CASE WHEN way < 3 THEN 'p' || s_suppkey ELSE 'person-' || substr(sha256('contact' || chr(31) || norm), 1, 32) END AS person_id FROM met)"""


@query("x1_contact_aliases", f"""{CONTACT_SQL}
SELECT person_id, 'nick ' || s_suppkey AS alias FROM who UNION
SELECT person_id, name FROM (SELECT person_id, CASE WHEN way = 2 THEN 'customer ' || lpad(s_suppkey::VARCHAR, 9, '0') ELSE s_name END AS name FROM who) n
JOIN v_people p USING (person_id)
WHERE trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) <> trim(regexp_replace(lower(display_name), '[^a-z0-9]+', ' ', 'g'))
  AND NOT list_contains(p.aliases, name)""")
def x1_aliases(spark, sf):
    resolved = _nicknamed(spark, sf)
    people = X.people(spark, sf)
    none = people.select("person_id", F.lit("").alias("alias")).limit(0)
    everyone = people.select("person_id", "display_name", "aliases").unionByName(
        RS.contact_people(resolved).select("person_id", "display_name", "aliases"))
    return RS.contact_aliases(resolved, everyone, none)


@query("x1_contact_identities", f"""{CONTACT_SQL}
SELECT DISTINCT person_id, kind, value FROM (
 SELECT person_id, 'name' AS kind, CASE WHEN way = 2 THEN 'customer ' || lpad(s_suppkey::VARCHAR, 9, '0') ELSE norm END AS value FROM who
 UNION ALL SELECT person_id, 'email', 'customer.' || lpad(s_suppkey::VARCHAR, 9, '0') || '@x.org' FROM who WHERE way = 0
 UNION ALL SELECT person_id, 'phone', '91' || (s_suppkey + 9000000000) FROM who WHERE way = 1
 UNION ALL SELECT person_id, 'telegram', 'handle' || s_suppkey FROM who WHERE s_suppkey % 2 = 0)""")
def x1_identities(spark, sf):
    return RS.contact_identities(_nicknamed(spark, sf))


@query("j7_phone_suffix", """
WITH n AS (SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN '0091' || (s_suppkey + 9000000000) WHEN 1 THEN CAST(s_suppkey + 9000000000 AS VARCHAR)
   ELSE right(CAST(s_suppkey + 9000000000 AS VARCHAR), 5) END AS digits FROM supplier)
SELECT digits, first(i.person_id ORDER BY created_at, i.person_id) AS person_id FROM n
JOIN v_identities i ON i.kind = 'phone' AND (ends_with(i.value, digits) OR ends_with(digits, i.value))
JOIN v_people p ON p.person_id = i.person_id GROUP BY digits""")
def j7_phones(spark, sf):
    numbers = X.table(spark, sf, "supplier").selectExpr(
        "CASE s_suppkey % 3 WHEN 0 THEN concat('00 91-', s_suppkey + 9000000000)"
        " WHEN 1 THEN concat('', s_suppkey + 9000000000) ELSE right(s_suppkey + 9000000000, 5) END AS phone")
    return RS.phone_matches(numbers, X.people(spark, sf), X.identities(spark, sf))


@query("x5_duplicate_people", "SELECT key, keeper_id, person_id FROM v_dups")
def x5_duplicates(spark, sf):
    return _duplicates(spark, sf)


def _duplicates(spark, sf):
    return RS.duplicate_people(X.people(spark, sf), X.events(spark, sf))


@query("w7_duplicate_keepers", "SELECT DISTINCT key, keeper_id FROM v_dups")
def w7_keepers(spark, sf):
    return _duplicates(spark, sf).select("key", "keeper_id").distinct()


@query("x6_suggestions", """
SELECT 'dup-' || keeper_id || '-' || d.person_id AS id, keeper_id AS person_a_id, display_name AS label,
  CASE CAST(substr(d.person_id, 2) AS BIGINT) % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status
FROM v_dups d JOIN v_people p ON p.person_id = d.person_id""")
def x6_suggestions(spark, sf):
    rows = _suggestions(spark, sf)
    return rows.select("id", "person_a_id", "label", "status")


def _suggestions(spark, sf):
    rows = RS.duplicate_suggestions(_duplicates(spark, sf), X.people(spark, sf))
    number = F.substring("person_b_id", 2, 20).cast("bigint") % 3
    decisions = rows.where(number < 2).select("id", (number == 0).alias("merge"))
    return RS.decide_suggestions(rows, decisions)


@query("x6_voice_mentions", """
WITH n AS MATERIALIZED (SELECT lower(display_name) AS name, first(person_id ORDER BY created_at, person_id) AS person_id,
    min(created_at) AS created_at FROM v_people GROUP BY 1),
h AS MATERIALIZED (SELECT v.id, v.filename, lower(transcript) AS low, n.* FROM v_voice v JOIN n ON contains(lower(transcript), n.name))
SELECT 'sug-voice-' || id || '-' || first(person_id ORDER BY length(name) DESC, created_at, person_id) AS id,
  first(person_id ORDER BY length(name) DESC, created_at, person_id) AS person_a_id, any_value(filename) AS label
FROM h WHERE regexp_matches(low, '\\b' || regexp_escape(name) || '\\b') GROUP BY h.id""")
def x6_voice(spark, sf):
    return RS.voice_mention_suggestions(X.voice(spark, sf), X.people(spark, sf)).select("id", "person_a_id", "label")


def _merges(spark, sf):
    return RS.accepted_merges(_suggestions(spark, sf))


@query("x7_merge_events", """
SELECT id, coalesce(d.keeper_id, e.person_id) AS person_id, d.keeper_id IS NOT NULL AS moved FROM v_events e LEFT JOIN v_dups d
ON d.person_id = e.person_id AND CAST(substr(d.person_id, 2) AS BIGINT) % 3 = 0""")
def x7_events(spark, sf):
    return RS.repoint(X.events(spark, sf), _merges(spark, sf)).select("id", "person_id", "moved")


@query("x7_merge_calendar", """
WITH m AS (SELECT person_id AS old, keeper_id AS new FROM v_dups WHERE CAST(substr(person_id, 2) AS BIGINT) % 3 = 0)
SELECT id, string_agg(DISTINCT coalesce(new, person_id), ',' ORDER BY coalesce(new, person_id)) AS person_ids FROM v_bridge LEFT JOIN m ON m.old = person_id GROUP BY id""")
def x7_calendar(spark, sf):
    rows = RS.repoint_array(X.calendar(spark, sf), _merges(spark, sf), "id", "person_ids")
    return rows.select("id", F.array_join(F.array_sort("person_ids"), ",").alias("person_ids"))


@query("x7_merge_people", """
SELECT p.person_id FROM v_people p WHERE p.person_id NOT IN (SELECT person_id FROM v_dups WHERE CAST(substr(person_id, 2) AS BIGINT) % 3 = 0)""")
def x7_people(spark, sf):
    return RS.surviving_people(X.people(spark, sf), _merges(spark, sf)).select("person_id")


@query("u3_gained_aliases", """
WITH m AS (SELECT person_id AS old, keeper_id AS new FROM v_dups WHERE CAST(substr(person_id, 2) AS BIGINT) % 3 = 0)
SELECT DISTINCT m.new AS person_id, n AS alias FROM m JOIN (SELECT person_id, unnest([display_name, aliases[1]]) AS n FROM v_people) p ON p.person_id = m.old
JOIN v_people k ON k.person_id = m.new WHERE n <> k.display_name AND n <> k.aliases[1]""")
def u3_aliases(spark, sf):
    return RS.gained_aliases(X.people(spark, sf), _merges(spark, sf))


@query("x7_merge_chains", """
SELECT 'p' || c_custkey AS old_id, 'p' || (c_custkey - c_custkey % 10) AS new_id FROM customer WHERE c_custkey % 10 <> 0""")
def x7_chains(spark, sf):
    """Everybody is merged into the person before them, except every tenth (who maps
    to themselves): chains of nine links."""
    k = F.col("c_custkey")
    rows = X.table(spark, sf, "customer").select(
        F.concat(F.lit("p"), k.cast("string")).alias("old_id"),
        F.concat(F.lit("p"), (k - F.sign(k % 10).cast("bigint")).cast("string")).alias("new_id"))
    return RS.resolve_merges(rows)


@query("x7_merge_components", """
WITH RECURSIVE m AS (SELECT 'p' || c_custkey AS a, 'p' || (c_custkey - c_custkey % 7) AS b FROM customer WHERE c_custkey % 7 > 0
  UNION ALL SELECT 'p' || c_custkey, 'p' || (c_custkey - 3) FROM customer WHERE c_custkey % 21 = 5),
e AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
k AS (SELECT a, min(b) FILTER (WHERE b NOT IN (SELECT a FROM m)) AS keeper FROM (SELECT a, b FROM reach UNION SELECT a, a FROM e) GROUP BY a)
SELECT a AS old_id, keeper AS new_id FROM k WHERE a <> keeper""")
def x7_components(spark, sf):
    """Six in seven are merged into the seventh, and some have a second target in the same family."""
    k = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    rows = X.table(spark, sf, "customer")
    first = rows.where(k % 7 > 0).select(name(k).alias("old_id"), name(k - k % 7).alias("new_id"))
    second = rows.where(k % 21 == 5).select(name(k).alias("old_id"), name(k - 3).alias("new_id"))
    return RS.resolve_merges(first.unionByName(second))


def _families(spark, sf, low: int, high: int):
    """Merges of customers who are a multiple of ``low`` but not of ``high`` into the multiple of ``high`` before them."""
    k = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    return X.table(spark, sf, "customer").where((k % low == 0) & (k % high > 0)).select(
        name(k).alias("old_id"), name(k - k % high).alias("new_id"))


def _labels(spark, sf):
    """Labels after two merges; the second names people whom the first merged away already, and repeats some of it."""
    nobody = spark.createDataFrame([], "id string, person_id string")
    first = PL.extend_labels(nobody, _families(spark, sf, 1, 7))
    again = _families(spark, sf, 1, 7).where(F.substring("old_id", 2, 20).cast("bigint") % 3 == 0)
    second = PL.extend_labels(first, _families(spark, sf, 7, 21).unionByName(again))
    return first.join(second, "id", "left_anti").withColumn("version", F.lit(1)).unionByName(second.withColumn("version", F.lit(2)))


@query("x7_incremental_merges", """
SELECT 'p' || c_custkey AS id, 'p' || (c_custkey - c_custkey % 21) AS person_id, CASE WHEN c_custkey % 21 < 7 THEN 1 ELSE 2 END AS version
FROM customer WHERE c_custkey % 21 > 0""")
def x7_incremental(spark, sf):
    return _labels(spark, sf).select("id", "person_id", "version")


MERGED = "'p' || (CAST(substr({0}, 2) AS BIGINT) - CAST(substr({0}, 2) AS BIGINT) % 21)"
IS_MERGED = "{0} IN (SELECT 'p' || c_custkey FROM customer WHERE c_custkey % 21 > 0)"


@query("x7_moved_rows", " UNION ALL ".join(
    f"SELECT '{name}' AS name, count(*) AS moved FROM v_{name} WHERE {IS_MERGED.format('person_id')}"
    for name in ("events", "emails", "notes", "voice", "identities")) + f"""
UNION ALL SELECT 'calendar', count(DISTINCT id) FROM v_bridge WHERE {IS_MERGED.format('person_id')}""")
def x7_moved(spark, sf):
    tables = {name: getattr(X, name)(spark, sf) for name in ("events", "emails", "notes", "voice", "identities", "calendar")}
    return PL.moved_rows(tables, _labels(spark, sf))


@query("x7_repointed_tables", f"""
SELECT name, id, CASE WHEN {IS_MERGED.format('person_id')} THEN {MERGED.format('person_id')} ELSE person_id END AS person_id FROM (
  SELECT 'events' AS name, id, person_id FROM v_events WHERE person_id <> '' UNION ALL SELECT 'emails', id, person_id FROM v_emails
  UNION ALL SELECT 'notes', id, person_id FROM v_notes UNION ALL SELECT 'voice', id, person_id FROM v_voice)
UNION ALL SELECT DISTINCT 'calendar', id, CASE WHEN {IS_MERGED.format('person_id')} THEN {MERGED.format('person_id')} ELSE person_id END FROM v_bridge""")
def x7_tables(spark, sf):
    """Every record with the person it belongs to after both merges; meetings give a row per attendee."""
    merges = cut_lineage(_labels(spark, sf).select(F.col("id").alias("old_id"), F.col("person_id").alias("new_id")))
    out = PL.repointed("calendar", X.calendar(spark, sf), merges).select(
        F.lit("calendar").alias("name"), "id", F.explode("person_ids").alias("person_id"))
    for name in ("events", "emails", "notes", "voice"):
        rows = getattr(X, name)(spark, sf).where("person_id <> ''")
        out = out.unionByName(PL.repointed(name, rows, merges).select(F.lit(name).alias("name"), "id", "person_id"))
    return out


@query("x8_repoint_record", """
SELECT c.id, CASE WHEN v.id IS NOT NULL THEN v.person_id ELSE c.person_id END AS person_id FROM v_corpus c
LEFT JOIN v_notes v ON 'doc-' || substr(v.id, 6) = 'doc-' || c.doc_id""")
def x8_record(spark, sf):
    from rapport.sinks.changes import set_fields
    links = X.notes(spark, sf).select(F.concat(F.lit("doc-"), F.substring("id", 6, 20)).alias("record_id"), "person_id")
    rows = X.corpus(spark, sf).withColumn("record_id", F.concat(F.lit("doc-"), F.substring("id", 5, 20)))
    return set_fields(rows, links, ["record_id"]).select("id", "person_id")


@query("x9_repair_names", """
SELECT person_id, display_name || ' é' AS display_name, CAST(substr(person_id, 2) AS BIGINT) % 3 = 0 AS changed FROM v_people""")
def x9_repair(spark, sf):
    """Every third name holds an accent whose bytes were read as Latin-1."""
    broken = F.col("person_id").substr(2, 20).cast("bigint") % 3 == 0
    people = X.people(spark, sf).withColumn("display_name", F.concat("display_name", F.when(broken, F.lit(" Ã©")).otherwise(F.lit(" é"))))
    return RS.repair_names(people).select("person_id", "display_name", "changed")


@query("j13_suggestion_evidence", """
SELECT d.id, d.person_a_id, coalesce(a.interaction_count, 0) AS interactions_a, coalesce(b.interaction_count, 0) AS interactions_b, e.id AS message_id
FROM (SELECT 'dup-' || keeper_id || '-' || person_id AS id, keeper_id AS person_a_id, person_id AS person_b_id FROM v_dups) d
LEFT JOIN v_profiles a ON a.person_id = d.person_a_id LEFT JOIN v_profiles b ON b.person_id = d.person_b_id
LEFT JOIN (SELECT person_id, id, row_number() OVER (PARTITION BY person_id ORDER BY sent_at DESC, id) AS rn FROM v_emails) e
ON e.person_id = d.person_b_id AND rn <= 4""")
def j13_evidence(spark, sf):
    mails = X.emails(spark, sf).select("id", "person_id", F.lit("nobody").alias("sender_label"),
                                       F.col("body").alias("content"), "sent_at")
    rows = RS.suggestion_evidence(_suggestions(spark, sf), X.people(spark, sf), X.stored_profiles(spark, sf), mails)
    return rows.select("id", "person_a_id", "interactions_a", "interactions_b", "message_id")


# -- media and records ----------------------------------------------------------------------

@query("j9_message_media", """
SELECT m.id AS message_id, k.media_id FROM v_messages m JOIN (SELECT filename_key, min(id) AS media_id FROM v_media GROUP BY filename_key) k
ON k.filename_key = 'img-' || (seq * 7 % 150) || '-wa.jpg'""")
def j9_links(spark, sf):
    refs = ML.attachment_keys(X.attachments(spark, sf))
    return ML.message_media(refs, X.media(spark, sf)).select("message_id", "media_id")


LINKED = """
SELECT f.id, m.id AS message_id, m.first_sent AS occurred_at, CASE WHEN m.id IS NULL THEN 'STORED' ELSE 'LINKED' END AS status FROM v_media f LEFT JOIN (
 SELECT media_id, arg_max(id, struct_pack(s := sent_at, i := id)) AS id, min(sent_at) AS first_sent FROM (
  SELECT m.id, m.sent_at, k.media_id FROM v_messages m JOIN (SELECT filename_key, min(id) AS media_id FROM v_media GROUP BY filename_key) k
  ON k.filename_key = 'img-' || (seq * 7 % 150) || '-wa.jpg') GROUP BY media_id) m ON m.media_id = f.id"""


@query("j9_link_media", LINKED)
def j9_media(spark, sf):
    refs = ML.attachment_keys(X.attachments(spark, sf))
    return ML.link_media(X.media(spark, sf), refs).select("id", "message_id", "occurred_at", "status")


@query("j12_entry_media", f"""
SELECT m.id, l.id AS media_id FROM v_messages m LEFT JOIN ({LINKED}) l ON l.message_id = m.id""")
def j12_media(spark, sf):
    refs = ML.attachment_keys(X.attachments(spark, sf))
    linked = ML.link_media(X.media(spark, sf), refs)
    entries = X.messages(spark, sf).select(F.lit("message").alias("type"), "id")
    return TL.entry_media(entries, linked).select("id", "media_id")


@query("j11_evidence_records", """
SELECT m.id, m.kind, r.title AS record_title, p.display_name AS person_name FROM (
  SELECT 'mem-' || id AS id, 'note' AS kind, id AS record_id, person_id FROM v_notes UNION ALL
  SELECT 'mem-' || id, 'email', id, person_id FROM v_emails UNION ALL SELECT 'mem-' || id, 'voice', id, person_id FROM v_voice) m
LEFT JOIN (SELECT id, title FROM v_notes UNION ALL SELECT id, subject FROM v_emails UNION ALL SELECT id, filename FROM v_voice) r ON r.id = m.record_id
LEFT JOIN v_people p ON p.person_id = m.person_id""")
def j11_records(spark, sf):
    parts = {"note": X.notes(spark, sf), "email": X.emails(spark, sf), "voice": X.voice(spark, sf)}
    memories = None
    for kind, df in parts.items():
        part = df.select(F.concat(F.lit("mem-"), "id").alias("id"), F.lit(kind).alias("kind"),
                         F.col("id").alias("record_id"), "person_id")
        memories = part if memories is None else memories.unionByName(part)
    records = TL.records_of(notes=parts["note"], emails=parts["email"], voice=parts["voice"])
    return TL.evidence_records(memories, records, X.people(spark, sf)).select("id", "kind", "record_title", "person_name")


@query("u2_memories_of_records", """
SELECT 'mem-' || id AS id, 'email' AS kind, person_id, subject || chr(10) || body AS text,
   'Email — ' || CASE WHEN subject = '' THEN '' ELSE subject || ' — ' END || strftime(sent_at, '%b %d, %Y %H:%M') AS citation FROM v_emails
UNION ALL SELECT 'mem-' || id, 'note', person_id, title || '. ' || body, 'Note — ' || strftime(noted_at, '%b %d, %Y %H:%M') FROM v_notes
UNION ALL SELECT 'mem-' || id || CASE WHEN n = 1 THEN '' ELSE '-' || p END, 'calendar', p,
   trim(title || '. . ' || description || ' ' || location), 'Calendar — ' || title || ' — ' || strftime(starts_at, '%b %d, %Y %H:%M')
 FROM (SELECT *, unnest(person_ids) AS p, generate_subscripts(person_ids, 1) AS n FROM v_calendar)""")
def u2_memories(spark, sf):
    messages = X.messages(spark, sf).withColumn("person_id", F.lit(None).cast("string"))
    calendar = X.calendar(spark, sf).withColumn("participants", F.array().cast("array<string>"))
    rows = TL.memories_of(messages, X.emails(spark, sf), calendar, X.notes(spark, sf))
    return rows.where(F.col("kind") != "message").select("id", "kind", "person_id", "text", "citation")
