"""Queries for parsers, routing, scalar functions and write semantics.

Export files are written from the test tables row by row (one small file per row or
run of rows), parsed back, and compared with the rows they came from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rapport import constants as K
from rapport.functions import chat as C
from rapport.functions import dates as D
from rapport.functions import media as ME
from rapport.functions import questions as Q
from rapport.functions import text as T
from rapport.functions.evidence import evidence_entry, matched_by
from rapport.functions.tables import register_table_functions
from rapport.functions.topics import is_noise_topic
from rapport.operators import media_links as ML
from rapport.operators import timeline as TL
from rapport.plans import fixtures as X
from rapport.session import spread
from rapport.sinks import changes as W
from rapport.sources import archive, chat_json, chat_text, files, records, tabular

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = (fn, X.with_views(sql) if sql else None)
        return fn
    return register


def clean_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


# -- sources ----------------------------------------------------------------------------

@query("s1_chat_text", f"""
SELECT conversation_id || '-' || (seq // 50) || '_chat.txt' AS path, sender_label, sent_at, {clean_sql('content')} AS content
FROM v_messages WHERE trim(content) <> ''""")
def s1_chat(spark, sf):
    return chat_text.parse_chat(X.chat_files(spark, sf)).select("path", "sender_label", "sent_at", "content")


@query("s1_chat_identity", """
SELECT path, sum(n)::BIGINT AS messages, 'whatsapp:d' || substr(sha256(string_agg(lower(sender_label), chr(31) ORDER BY sender_label)), 1, 32) AS conversation_id
FROM (SELECT conversation_id || '-' || (seq // 50) || '_chat.txt' AS path, sender_label, count(*) AS n FROM v_messages GROUP BY 1, 2) GROUP BY path""")
def s1_identity(spark, sf):
    return chat_text.parse_chat(X.chat_files(spark, sf)).groupBy("path", "conversation_id").agg(
        F.count("*").alias("messages"))


def _json_files(spark, sf, shape):
    rows = X.messages(spark, sf)
    return rows.select(F.concat("conversation_id", F.lit("/"), F.col("seq").cast("string"), F.lit(".json")).alias("path"),
                       shape(rows).alias("text"))


ISO = "yyyy-MM-dd'T'HH:mm:ss"


@query("s3_telegram_json", f"""
SELECT conversation_id || '/' || seq || '.json' AS path, 'telegram:' || conversation_id AS conversation_id,
  {clean_sql('sender_label')} AS sender_label, sent_at, {clean_sql('content')} AS content, CAST(seq AS VARCHAR) AS reply_to FROM v_messages""")
def s3_telegram(spark, sf):
    def shape(rows):
        message = F.struct(F.lit("message").alias("type"), F.date_format("sent_at", ISO).alias("date"),
                           F.col("sender_label").alias("from"), F.array(
                               F.substring("content", 1, 5),
                               F.to_json(F.struct(F.lit("bold").alias("type"), F.expr("substring(content, 6)").alias("text")))
                           ).alias("parts"), F.col("seq").alias("reply_to_message_id"))
        text = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("conversation_id").alias("name"), F.lit(1).alias("id"),
                                                            F.array(message).alias("messages"))).alias("list")).alias("chats")))
        # The second segment is an object in real exports, so its quoting is undone.
        segments = F.concat(F.lit('"text":['), F.to_json(F.array(F.substring("content", 1, 5))).substr(F.lit(2), F.length(
            F.to_json(F.array(F.substring("content", 1, 5)))) - 2), F.lit(","),
            F.to_json(F.struct(F.lit("bold").alias("type"), F.expr("substring(content, 6)").alias("text"))), F.lit("]"))
        head = F.to_json(F.struct(F.lit("message").alias("type"), F.date_format("sent_at", ISO).alias("date"),
                                  F.col("sender_label").alias("from"), F.col("seq").alias("reply_to_message_id")))
        body = F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(","), segments, F.lit("}"))
        return F.concat(F.lit('{"chats":{"list":[{"name":"'), F.col("conversation_id"), F.lit('","id":1,"messages":['),
                        body, F.lit(',{"type":"service","actor":"x"}]}]}}'))
    return chat_json.parse_telegram(_json_files(spark, sf, shape)).select(
        "path", "conversation_id", "sender_label", "sent_at", "content", "reply_to")


@query("s4_instagram_json", f"""
SELECT conversation_id || '/' || seq || '.json' AS path, 'instagram:' || conversation_id AS conversation_id,
  {clean_sql('sender_label')} AS sender_label, sent_at, {clean_sql('content')} AS content, 'p' || seq || '.jpg' AS filename_key FROM v_messages""")
def s4_instagram(spark, sf):
    def shape(rows):
        photo = F.struct(F.concat(F.lit("photos/P"), F.col("seq").cast("string"), F.lit(".JPG")).alias("uri"))
        return F.to_json(F.struct(
            F.array(F.struct(F.col("sender_label").alias("name"))).alias("participants"), F.col("conversation_id").alias("title"),
            F.array(F.struct(F.col("sender_label").alias("sender_name"),
                             F.unix_millis(F.col("sent_at").cast("timestamp")).alias("timestamp_ms"), "content",
                             F.array(photo, photo).alias("photos"))).alias("messages")))
    return chat_json.parse_instagram(_json_files(spark, sf, shape)).select(
        "path", "conversation_id", "sender_label", "sent_at", "content",
        F.array_join(F.transform("attachments", lambda a: a["filename_key"]), ",").alias("filename_key"))


@query("s5_x_direct_messages", f"""
SELECT conversation_id || '/' || seq || '.json' AS path, sender_label, sent_at, {clean_sql('content')} AS content FROM v_messages""")
def s5_x(spark, sf):
    def shape(rows):
        create = F.struct(F.col("sender_label").alias("senderId"), F.date_format("sent_at", ISO).alias("createdAt"),
                          F.struct(F.col("content").alias("text")).alias("message_data"))
        return F.concat(F.lit("window.YTD.direct_messages.part0 = "),
                        F.to_json(F.array(F.struct(create.alias("message_create")))), F.lit(";"))
    return chat_json.parse_x(_json_files(spark, sf, shape)).select("path", "sender_label", "sent_at", "content")


@query("s6_generic_json", f"""
SELECT conversation_id || '/' || seq || '.json' AS path, 'chat:' || conversation_id AS conversation_id,
  {clean_sql('sender_label')} AS sender_label, sent_at, {clean_sql('content')} AS content FROM v_messages""")
def s6_json(spark, sf):
    def shape(rows):
        return F.to_json(F.array(F.struct(
            F.date_format("sent_at", ISO).alias("created_at"), F.col("sender_label").alias("author"),
            F.col("content").alias("Body"), F.col("conversation_id").alias("thread"))))
    rows = tabular.json_rows(_json_files(spark, sf, shape))
    return tabular.parse_generic(rows).select("path", "conversation_id", "sender_label", "sent_at", "content")


@query("s6_generic_csv", f"""
SELECT conversation_id || '/' || seq || '.json' AS path, {clean_sql('sender_label')} AS sender_label, sent_at,
  {clean_sql('content')} AS content FROM v_messages""")
def s6_csv(spark, sf):
    def shape(rows):
        quoted = F.concat(F.lit('"'), F.replace("content", F.lit('"'), F.lit('""')), F.lit('"'))
        return F.concat(F.lit("timestamp,sender,content\n"), F.concat_ws(
            ",", F.date_format("sent_at", ISO), F.col("sender_label"), quoted))
    rows = tabular.csv_rows(_json_files(spark, sf, shape))
    return tabular.parse_generic(rows).select("path", "sender_label", "sent_at", "content")


@query("s6_html_table", "SELECT 'orders/' || o_orderkey AS path, o_orderstatus AS sender_label, o_orderpriority AS content FROM orders")
def s6_html(spark, sf):
    pages = X.table(spark, sf, "orders").select(
        F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path"),
        F.concat(F.lit("<html><table><tr><th>from</th><th>message</th></tr><tr><td>"), "o_orderstatus",
                 F.lit("</td><td><b>"), "o_orderpriority", F.lit("</b></td></tr></table></html>")).alias("text"))
    return tabular.parse_generic(tabular.html_table_rows(pages)).select("path", "sender_label", "content")


@query("s7_detected_fields", """
SELECT 'events' AS path, unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS field""")
def s7_fields(spark, sf):
    return tabular.detect_fields(tabular.frame_rows(X.table(spark, sf, "events"), "events"))


def _eml(spark, sf):
    return X.emails(spark, sf).select(
        F.concat("id", F.lit(".eml")).alias("path"), F.concat(
            F.lit("From: Cust Omer <"), "person_id", F.lit("@x.org>\nTo: a@x.org, b@x.org\nSubject: =?utf-8?B?"),
            F.base64(F.encode("subject", "UTF-8")), F.lit("?=\nDate: "),
            F.date_format("sent_at", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000\n\n"), "body").alias("text"))


@query("s8_email_files", """
SELECT id || '.eml' AS path, person_id || '@x.org' AS from_address, subject, sent_at, body, 2::BIGINT AS recipients FROM v_emails""")
def s8_eml(spark, sf):
    mails = _eml(spark, sf).select("path", F.encode("text", "UTF-8").alias("content"))
    return records.parse_email_files(mails).select(
        "path", "from_address", "subject", "sent_at", "body", F.size("to").cast("bigint").alias("recipients"))


@query("s8_email_rows", "SELECT id AS path, person_id || '@x.org' AS from_address, trim('x ' || subject) AS subject, sent_at FROM v_emails")
def s8_rows(spark, sf):
    rows = X.emails(spark, sf).select(F.col("id").alias("path"), F.lit(0).alias("row_no"),
        F.array(F.lit("From"), F.lit("Title"), F.lit("Date"), F.lit("Snippet")).alias("columns"),
        F.create_map(F.lit("From"), F.concat(F.lit("Ann <"), "person_id", F.lit("@X.org>")), F.lit("Title"),
                     F.concat(F.lit("x "), "subject"), F.lit("Date"), F.date_format("sent_at", ISO),
                     F.lit("Snippet"), F.col("body")).alias("fields"))
    return tabular.parse_email_rows(rows).select("path", "from_address", "subject", "sent_at")


@query("s9_calendar_ics", """
SELECT 'order ' || o_orderkey AS title, o_orderdate AS starts_at, o_orderpriority AS location, 'A B, c@x.org' AS participants FROM orders""")
def s9_ics(spark, sf):
    stamp = F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'")
    text = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:order \r\n "), F.col("o_orderkey").cast("string"),
                    F.lit("\r\nDTSTART:"), stamp, F.lit("\r\nLOCATION:"), F.col("o_orderpriority"),
                    F.lit("\r\nATTENDEE;CN=\"A B\";ROLE=X:mailto:a@x.org\r\nATTENDEE:mailto:c@x.org\r\nEND:VEVENT\r\nEND:VCALENDAR"))
    rows = X.table(spark, sf, "orders").select(F.lit("cal.ics").alias("path"), text.alias("text"))
    return records.parse_ics(rows).select("title", "starts_at", "location", F.array_join("participants", ", ").alias("participants"))


@query("s9_calendar_csv", """
SELECT 'order ' || o_orderkey AS title, o_orderdate AS starts_at, o_orderpriority AS location, 'a,' || o_orderstatus AS participants FROM orders""")
def s9_csv(spark, sf):
    rows = tabular.frame_rows(X.table(spark, sf, "orders").select(
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("Title"),
        F.date_format("o_orderdate", ISO).alias("start"), F.col("o_orderpriority").alias("room"),
        F.concat(F.lit("a; "), "o_orderstatus").alias("guests")), "calendar.csv")
    return tabular.parse_calendar_rows(rows).select("title", "starts_at", "location",
                                                    F.array_join("participants", ",").alias("participants"))


@query("s10_contacts_vcf", """
SELECT c_name AS name, '91' || c_custkey AS phone, lower(c_name) || '@x.org' AS email, c_mktsegment AS organization FROM customer""")
def s10_vcf(spark, sf):
    text = F.concat(F.lit("BEGIN:VCARD\nVERSION:3.0\nFN:"), F.col("c_name"), F.lit("\nTEL;TYPE=CELL:+91 "),
                    F.col("c_custkey").cast("string"), F.lit("\nEMAIL:"), F.col("c_name"), F.lit("@X.org\nORG:"),
                    F.col("c_mktsegment"), F.lit(";unit\nEND:VCARD\n"))
    rows = X.table(spark, sf, "customer").select(F.lit("c.vcf").alias("path"), text.alias("text"))
    return records.parse_vcf(rows).select("name", "phone", "email", "organization")


@query("s10_contacts_csv", "SELECT s_name || ' last' AS name, '00' || s_suppkey AS phone, 'handle' || s_suppkey AS handle FROM supplier")
def s10_csv(spark, sf):
    rows = tabular.frame_rows(X.table(spark, sf, "supplier").select(
        F.col("s_name").alias("Given Name"), F.lit("last").alias("Surname"),
        F.concat(F.lit("00-"), F.col("s_suppkey").cast("string")).alias("Cell"),
        F.concat(F.lit("@handle"), F.col("s_suppkey").cast("string")).alias("telegram")), "contacts.csv")
    return tabular.parse_contact_rows(rows).select("name", "phone", F.element_at("usernames", 1)["value"].alias("handle"))


HTML_SQL = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace({c}, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
  '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"""


@query("s11_html_documents", f"SELECT page_id, {HTML_SQL.format(c='html')} AS text FROM pages")
def s11_html(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("s11_text_documents", "SELECT 'd' || doc_id || '.md' AS filename, trim(text, ' ' || chr(10)) AS text FROM documents WHERE trim(text, ' ' || chr(10)) <> ''")
def s11_text(spark, sf):
    rows = X.table(spark, sf, "documents").select(
        F.concat(F.lit("/in/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    return records.parse_documents(rows).select("filename", "text")


@query("s12_notes", """
SELECT 'note-' || substr(sha256('n' || doc_id || '.txt' || chr(31) || text), 1, 32) AS id,
  trim(text, ' ' || chr(10)) AS body FROM documents WHERE trim(text, ' ' || chr(10)) <> ''""")
def s12_notes(spark, sf):
    rows = X.table(spark, sf, "documents").select(
        F.concat(F.lit("notes/n"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text",
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modificationTime"))
    return records.parse_notes(rows).select("id", "body")


@query("s14_media_catalogue", """
SELECT 'media-' || substr(sha256(text), 1, 24) AS id, count(*) AS copies FROM documents WHERE length(text) > 0 GROUP BY 1""")
def s14_media(spark, sf):
    rows = X.table(spark, sf, "documents").select(
        F.concat(F.lit("media/PTT-"), F.col("doc_id").cast("string"), F.lit(".opus")).alias("path"),
        F.encode("text", "UTF-8").alias("content"))
    copies = rows.groupBy(F.sha2("content", 256).alias("checksum")).agg(F.count("*").alias("copies"))
    return ML.media_catalogue(rows).join(copies, "checksum").select("id", "copies")


PATHS = [
    ("/in/whatsapp/{}_chat.txt", "whatsapp", None), ("/in/misc/{}-whatsapp-export.txt", "whatsapp", None),
    ("/in/x1/telegram_{}.json", "telegram", None), ("/in/data/tweets{}.js", "x", None),
    ("/in/your_instagram_activity/messages/inbox/t{}/message_1.json", None, None),
    ("/in/instagram-me/messages/inbox/t{}/photos/a.jpg", None, None),
    ("/in/instagram-me/connections/f{}.json", None, "not a conversation file in a Meta data export"),
    ("/in/mail/{}.eml", "email", None), ("/in/{}.ics", "calendar", None), ("/in/{}.vcf", "contacts", None),
    ("/in/{}.mp3.crdownload", None, None), ("/in/Documents/{}.pdf", "document", None), ("/in/.hidden{}", None, None),
    ("/in/meta-1/{}", None, "export directory marker"), ("/in/{}.ogg", "voice", None), ("/in/~${}.docx", None, None),
]


def _paths(spark, sf):
    n = len(PATHS)
    templates = F.array(*[F.lit(p) for p, _, _ in PATHS])
    return X.table(spark, sf, "part").select(
        F.replace(F.element_at(templates, (F.col("p_partkey") % n + 1).cast("int")), F.lit("{}"),
                  F.col("p_partkey").cast("string")).alias("path"),
        (F.col("p_size") % 5).cast("bigint").alias("size"))


def _paths_sql(column: int) -> str:
    values = ", ".join("NULL" if p[column] is None else "'" + p[column] + "'" for p in PATHS)
    return f"[{values}][CAST(p_partkey % {len(PATHS)} AS INTEGER) + 1]"


PATH_SQL = f"replace({_paths_sql(0)}, '{{}}', CAST(p_partkey AS VARCHAR))"


@query("s15_route_by_path", f"SELECT {PATH_SQL} AS path, {_paths_sql(1)} AS source FROM part")
def s15_route(spark, sf):
    return _paths(spark, sf).select("path", files.route(F.col("path"), F.lit(""), "/in").alias("source"))


@query("s15_route_by_content", """
SELECT conversation_id || '/' || seq || '.json' AS path, CASE WHEN seq % 2 = 0 THEN 'instagram' ELSE 'x' END AS source FROM v_messages""")
def s15_content(spark, sf):
    rows = _json_files(spark, sf, lambda r: F.when(F.col("seq") % 2 == 0, F.to_json(F.struct(
        F.col("sender_label").alias("sender_name"), F.lit(1).alias("timestamp_ms"), "content"))).otherwise(
        F.concat(F.lit('[{"message_create": '), F.to_json(F.struct("content")), F.lit("}]"))))
    return rows.select("path", files.route(F.col("path"), F.substring("text", 1, K.SNIFF_BYTES)).alias("source"))


@query("s17_export_scope", f"SELECT {PATH_SQL} AS path, {_paths_sql(2)} AS reason FROM part")
def s17_scope(spark, sf):
    return _paths(spark, sf).select("path", files.skip_reason(F.col("path")).alias("reason"))


@query("s18_ingestible", f"""
SELECT {PATH_SQL} AS path, p_partkey % {len(PATHS)} NOT IN (10, 12, 15) AND p_size % 5 > 0 AS ok FROM part""")
def s18_filter(spark, sf):
    return _paths(spark, sf).select("path", files.is_ingestible(F.col("path"), F.col("size")).alias("ok"))


@query("s19_verdict", f"""
SELECT {PATH_SQL} AS path, CASE p_partkey % {len(PATHS)}
 WHEN 10 THEN 'unsupported file type: .crdownload' WHEN 12 THEN 'unsupported file type: (none)' WHEN 13 THEN 'unsupported file type: (none)'
 ELSE CASE p_size % 5 WHEN 0 THEN 'empty file' WHEN 4 THEN CASE WHEN p_partkey % {len(PATHS)} IN (5, 14) THEN 'file too large (4 > 3 bytes)' ELSE 'ok' END ELSE 'ok' END END AS verdict FROM part""")
def s19_verdict(spark, sf):
    return _paths(spark, sf).select("path", files.verdict(F.col("path"), F.col("size"), 3).alias("verdict"))


@query("s20_folder_report", """
SELECT 'route' AS facet, 'notes' AS value, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents
UNION ALL SELECT 'folder', source, count(*), sum(strlen(text))::BIGINT FROM documents GROUP BY source""")
def s20_report(spark, sf):
    rows = X.table(spark, sf, "documents").select(
        F.concat(F.lit("/in/notes/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.encode("text", "UTF-8").alias("content"))
    return files.folder_report(rows, "/in")


# -- write semantics -----------------------------------------------------------------------

def _job_batch(spark, sf):
    return X.jobs(spark, sf)


@query("k1_insert_if_new", """
SELECT id, arg_min(version, version) AS version FROM v_jobs WHERE version % 7 > 0 AND id NOT IN (SELECT id FROM v_jobs WHERE version % 7 = 0) GROUP BY id""")
def k1_insert(spark, sf):
    jobs = _job_batch(spark, sf)
    stored, batch = jobs.where(F.col("version") % 7 == 0), jobs.where(F.col("version") % 7 > 0)
    return W.new_rows(batch, stored, ["id"], ["version"]).select("id", "version")


@query("k1_insert_counts", """
SELECT count(DISTINCT id) FILTER (WHERE NOT known) AS inserted, count(*) - count(DISTINCT id) FILTER (WHERE NOT known) AS skipped FROM (
 SELECT id, id IN (SELECT id FROM v_jobs WHERE version % 7 = 0) AS known FROM v_jobs WHERE version % 7 > 0)""")
def k1_counts(spark, sf):
    jobs = _job_batch(spark, sf)
    return W.insert_counts(jobs.where(F.col("version") % 7 > 0), jobs.where(F.col("version") % 7 == 0), ["id"])


@query("j6_anti_join_dedupe", """
SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')""")
def j6_dedupe(spark, sf):
    docs = X.table(spark, sf, "documents").withColumn("checksum", F.sha2("text", 256))
    return docs.join(docs.where("lang = 'en'").select("checksum"), "checksum", "left_anti").select("doc_id")


@query("k2_upsert_latest", "SELECT id, max(version) AS version, arg_max(status, version) AS status FROM v_jobs GROUP BY id")
def k2_latest(spark, sf):
    return W.latest(_job_batch(spark, sf), ["id"], "version").select("id", "version", "status")


@query("k3_changed_rows", """
WITH u AS (SELECT 'p' || s_suppkey AS person_id, s_name AS display_name FROM supplier
           UNION ALL SELECT person_id, display_name FROM v_people WHERE CAST(substr(person_id, 2) AS BIGINT) >= 1000)
SELECT p.person_id, coalesce(u.display_name, p.display_name) AS display_name,
  u.person_id IS NOT NULL AND u.display_name <> p.display_name AS changed FROM v_people p LEFT JOIN u ON u.person_id = p.person_id
WHERE u.person_id IS NULL OR CAST(substr(p.person_id, 2) AS BIGINT) < 1000 OR TRUE""")
def k3_changed(spark, sf):
    people = X.people(spark, sf)
    renamed = X.table(spark, sf, "supplier").selectExpr("concat('p', s_suppkey) AS person_id", "s_name AS display_name")
    same = people.where(F.substring("person_id", 2, 20).cast("bigint") >= 1000).select("person_id", "display_name")
    return W.set_fields(people, renamed.unionByName(same), ["person_id"], "changed").select(
        "person_id", "display_name", "changed")


@query("k4_delete", "SELECT id FROM v_notes WHERE id NOT IN (SELECT 'note-' || (c_custkey * 3) FROM customer)")
def k4_delete(spark, sf):
    gone = X.table(spark, sf, "customer").selectExpr("concat('note-', c_custkey * 3) AS id")
    return W.without_deleted(X.notes(spark, sf), gone, ["id"]).select("id")


@query("k5_unprocessed_files", """
SELECT 'd' || min(lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS path FROM documents WHERE lang <> 'en'
 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en') GROUP BY sha256(text)""")
def k5_unprocessed(spark, sf):
    docs = X.table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), "lang",
        F.sha2("text", 256).alias("checksum"))
    return W.unprocessed(docs.where("lang <> 'en'"), docs.where("lang = 'en'")).select("path")


@query("k6_job_states", """
SELECT id, CASE WHEN status = 'PROCESSING' THEN 'QUEUED' ELSE status END AS status FROM (
 SELECT id, arg_max(status, version) AS status FROM v_jobs GROUP BY id)""")
def k6_states(spark, sf):
    return W.resumed(W.job_states(_job_batch(spark, sf))).select("id", "status")


@query("k7_provenance", "SELECT checksum, id AS filename, count(*) AS record_count FROM v_jobs GROUP BY checksum, id")
def k7_provenance(spark, sf):
    return W.provenance(_job_batch(spark, sf).select("checksum", F.col("id").alias("filename")))


# -- scalar functions ------------------------------------------------------------------------

@query("f1_clean_text", f"SELECT doc_id, {clean_sql('text')} AS text FROM documents")
def f1_clean(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query("f3_f4_f5_names", """
SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS norm,
 regexp_replace(lower(c_name || '!'), '[^\\p{L}\\p{N}_]', '', 'g') AS dup, regexp_replace('+91 (' || c_custkey || ')', '[^0-9]', '', 'g') AS phone,
 lower(trim(c_name)) || '@x.org' AS email, lower(c_mktsegment) AS username FROM customer""")
def f3_names(spark, sf):
    c = F.col("c_name")
    return X.table(spark, sf, "customer").select(
        "c_custkey", T.norm_name(c).alias("norm"), T.duplicate_key(F.concat(c, F.lit("!"))).alias("dup"),
        T.norm_phone(F.concat(F.lit("+91 ("), F.col("c_custkey").cast("string"), F.lit(")"))).alias("phone"),
        T.norm_email(F.concat(F.lit(" "), c, F.lit("@X.org "))).alias("email"),
        T.norm_username(F.concat(F.lit(" https://Twitter.com/"), F.col("c_mktsegment"), F.lit("/"))).alias("username"))


@query("f6_deterministic_ids", "SELECT id, conversation_id, seq FROM v_messages")
def f6_ids(spark, sf):
    return X.messages(spark, sf).select("id", "conversation_id", "seq")


@query("f7_conversation_keys", """
SELECT o_orderkey, 'x:' || CASE WHEN lower(o_orderpriority) < lower(o_orderstatus) THEN lower(o_orderpriority) || '|' || lower(o_orderstatus)
  ELSE lower(o_orderstatus) || '|' || lower(o_orderpriority) END AS key FROM orders""")
def f7_keys(spark, sf):
    return X.table(spark, sf, "orders").select("o_orderkey", T.conversation_key(
        F.lit("x"), F.array("o_orderstatus", F.lit(""), "o_orderpriority")).alias("key"))


@query("f8_export_dates", "SELECT event_id, date_trunc('minute', ts) AS us, date_trunc('second', ts) AS eu, date_trunc('minute', ts) AS year_first FROM events")
def f8_dates(spark, sf):
    ts = F.col("ts")
    day_first = F.when(F.dayofmonth(ts) > 12, F.date_format(ts, "MM/dd/yy")).otherwise(F.date_format(ts, "d.M.yyyy"))
    return X.table(spark, sf, "events").select(
        "event_id", D.parse_export_datetime(day_first, F.date_format(ts, "h:mm a")).alias("us"),
        D.parse_export_datetime(F.date_format(ts, "dd/MM/yyyy"), F.date_format(ts, "HH:mm:ss")).alias("eu"),
        D.parse_export_datetime(F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "HH:mm")).alias("year_first"))


@query("f9_f10_iso_and_epoch", """
SELECT event_id, date_trunc('second', ts) AS z, date_trunc('second', ts) - INTERVAL 5 HOUR - INTERVAL 30 MINUTE AS shifted,
  date_trunc('second', ts) AS epoch_s, date_trunc('millisecond', ts) AS epoch_ms FROM events""")
def f9_iso(spark, sf):
    ts, text = F.col("ts"), F.date_format("ts", ISO)
    stamp = ts.cast("timestamp")
    return X.table(spark, sf, "events").select(
        "event_id", D.parse_iso(F.concat(text, F.lit("Z"))).alias("z"),
        D.parse_iso(F.concat(text, F.lit("+05:30"))).alias("shifted"),
        D.parse_epoch(F.unix_seconds(stamp).cast("string")).alias("epoch_s"),
        D.parse_epoch(F.unix_millis(stamp).cast("string")).alias("epoch_ms"))


@query("f11_f12_split_sender", """
SELECT conversation_id, seq, CASE seq % 4 WHEN 0 THEN sender_label ELSE NULL END AS sender,
 seq % 4 = 3 AS noise FROM v_messages""")
def f11_sender(spark, sf):
    n = F.col("seq") % 4
    line = (F.when(n == 0, F.concat("sender_label", F.lit(": hi: there"))).when(n == 1, F.lit("https://x.org/a: b"))
            .when(n == 2, F.lit("12: 30")).otherwise(F.lit("Left the group: bye")))
    return X.messages(spark, sf).select("conversation_id", "seq", C.sender_of(line).alias("sender"),
                                        C.is_noise_line(line).alias("noise"))


@query("f13_f14_attachments", """
SELECT p_partkey, 'img-' || p_partkey || '-wa.jpg' AS file_key, 'image' AS kind, p_name AS caption, 'image/jpeg' AS mime FROM part""")
def f13_attachments(spark, sf):
    name = F.concat(F.lit("IMG-"), F.col("p_partkey").cast("string"), F.lit("-WA.JPG"))
    body = F.concat(F.lit("‎"), name, F.lit(" (file attached)\n"), F.col("p_name"))
    rows = spread(X.table(spark, sf, "part")).select("p_partkey", name.alias("name"), body.alias("body"))
    return rows.withColumn("found", C.attachments(F.col("body"))).select(
        "p_partkey", F.array_join(F.transform("found", lambda a: a["filename_key"]), ",").alias("file_key"),
        F.element_at("found", 1)["kind"].alias("kind"), C.caption(F.col("body")).alias("caption"),
        ME.media_mime(F.col("name")).alias("mime"))


@query("f17_noise_topics", """
SELECT o_orderkey, o_orderkey % 3 = 0 AS noise FROM orders""")
def f17_noise(spark, sf):
    phrase = F.when(F.col("o_orderkey") % 3 == 0, "Thank you").when(F.col("o_orderkey") % 3 == 1, F.concat(
        F.lit("Machine "), "o_orderstatus", F.lit("arning"))).otherwise("Series")
    return X.table(spark, sf, "orders").select("o_orderkey", is_noise_topic(phrase).alias("noise"))


TRIM_SQL = """CASE WHEN length(text) <= 240 THEN text ELSE rtrim(CASE WHEN instr(reverse(substr(text, 1, 240)), ' ') > 0
  AND 240 - instr(reverse(substr(text, 1, 240)), ' ') > 144
  THEN substr(text, 1, 240 - instr(reverse(substr(text, 1, 240)), ' ')) ELSE substr(text, 1, 240) END, ' ' || chr(10)) || '…' END"""


@query("f19_trim", f"SELECT doc_id, {TRIM_SQL} AS snippet FROM documents")
def f19_trim(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.trim_at_word(F.col("text"), 240).alias("snippet"))


@query("f20_citations", "SELECT id, 'Email — ' || CASE WHEN subject = '' THEN '' ELSE subject || ' — ' END || strftime(sent_at, '%b %d, %Y %H:%M') AS citation FROM v_emails")
def f20_citation(spark, sf):
    return X.emails(spark, sf).select("id", T.citation(F.lit("email"), F.col("sent_at"), F.col("subject")).alias("citation"))


@query("f21_n5_chunks", f"""
SELECT doc_id AS id, n AS chunk_no, substr(c, CAST(n * 1200 + 1 AS BIGINT), 1200) AS chunk FROM (
 SELECT doc_id, c, unnest(range(CAST(ceil(length(c) / 1200.0) AS BIGINT))) AS n FROM (SELECT doc_id, {clean_sql('text')} AS c FROM documents))""")
def f21_chunks(spark, sf):
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return TL.document_chunks(docs).select("id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk")


#: A conversation turn as one entry of a chat export, and its sender and body by the grammar's rules.
TURN_SQL = f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') || ': ' || coalesce(text, '') AS said FROM conversations),
 entries AS (SELECT conv_id, turn, said, trim(split_part(said, ':', 1)) AS name, NOT regexp_matches(split_part(said, chr(10), 1), '{K.CHAT_SYSTEM_VERBS}') AS plain FROM turns),
 named AS (SELECT *, plain AND name <> '' AND length(name) < 100 AS known FROM entries)"""


@query("n4_parse_chat_function", f"""{TURN_SQL}
SELECT conv_id, turn, 0 AS entry_no, '8:05 PM' AS sent_time, CASE WHEN known THEN name END AS sender,
  {clean_sql("CASE WHEN known THEN substr(said, strpos(said, ':') + 1) ELSE said END")} AS body FROM named""")
def n4_parse_chat(spark, sf):
    """Every turn written as an export of one message, read back through ``parse_chat`` in SQL."""
    register_table_functions(spark)
    X.table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "concat('02/01/24, 8:05 PM - ', coalesce(role, ''), ': ', coalesce(text, '')) AS export"
    ).createOrReplaceTempView("rapport_exports")
    return spark.sql(r"""SELECT conv_id, turn, entry_no, sent_time, sender, trim(regexp_replace(body, '\\s+', ' ')) AS body
                         FROM rapport_exports, LATERAL parse_chat(export)""")


@query("n5_text_chunks_function", f"""
SELECT conv_id, turn, CAST(n AS INTEGER) AS chunk_no, substr(c, CAST(n * 200 + 1 AS BIGINT), 200) AS chunk FROM (
 SELECT conv_id, turn, c, unnest(range(CAST(ceil(length(c) / 200.0) AS BIGINT))) AS n
 FROM (SELECT conv_id, turn, {clean_sql('text')} AS c FROM conversations))""")
def n5_text_chunks(spark, sf):
    register_table_functions(spark)
    X.table(spark, sf, "conversations").createOrReplaceTempView("rapport_turns")
    return spark.sql("SELECT conv_id, turn, chunk_no, chunk FROM rapport_turns, LATERAL text_chunks(text, 200)")


@query("f25_labels", """
SELECT DISTINCT sender_label, sender_label = 'Me' AS owner, sender_label = 'Instagram User' AS placeholder FROM v_messages""")
def f25_labels(spark, sf):
    c = F.col("sender_label")
    return X.messages(spark, sf).select(c, T.is_user_label(c).alias("owner"),
                                        T.is_placeholder_label(c).alias("placeholder")).distinct()


@query("f26_counts_in_words", """
SELECT person_id, CASE WHEN interactions = 1 THEN '1 email' ELSE format('{:,}', interactions) || ' emails' END AS counted,
 CASE WHEN n14 = 1 THEN 'in the last 1 day' ELSE 'in the last ' || n14 || ' days' END AS phrase FROM v_stats""")
def f26_words(spark, sf):
    from rapport.operators.ledger import relationship_status
    return relationship_status(X.events(spark, sf), X.AS_OF).select(
        "person_id", Q.counted(F.col("interactions"), "email").alias("counted"), Q.window_phrase(F.col("n14")).alias("phrase"))


@query("f27_flatten_text", f"SELECT conversation_id || '/' || seq || '.json' AS path, content AS text FROM v_messages")
def f27_flatten(spark, sf):
    rows = _json_files(spark, sf, lambda r: F.to_json(F.struct(F.array(
        F.substring("content", 1, 7), F.expr("substring(content, 8)")).alias("text"))))
    return rows.select("path", chat_json.flatten_text(F.try_parse_json("text")).alias("text"))


@query("f28_html_title", """
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages""")
def f28_title(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query("f29_matched_by", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'semantic' WHEN 2 THEN 'keyword' ELSE 'none' END AS matched FROM events""")
def f29_matched(spark, sf):
    n = F.col("event_id") % 4
    return X.table(spark, sf, "events").select("event_id", matched_by(
        F.when(n.isin(0, 1), n), F.when(n.isin(0, 2), n)).alias("matched"))


@query("f31_evidence_entries", """
SELECT id, '[S1] email email | ' || strftime(sent_at, '%Y-%m-%d %H:%M') || ' | person: ' || person_id || chr(10) || '"' || body || '"' AS entry FROM v_emails""")
def f31_entries(spark, sf):
    return X.emails(spark, sf).select("id", evidence_entry(
        F.lit("S1"), F.lit("email"), F.lit("email"), F.col("sent_at"), F.col("person_id"), F.col("body")).alias("entry"))


@query("n1_embeddings")
def n1_embeddings(spark, sf):
    from rapport.operators.hooks import embed, hash_embedder
    rows = embed(X.corpus(spark, sf), "text", hash_embedder)
    return rows.select("id", F.size("embedding").alias("dims"), F.round(F.element_at("embedding", 1), 4).alias("first"))
