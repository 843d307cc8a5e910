"""Golden values for text, dates, topics, questions and citations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rapport.functions import chat as C
from rapport.functions import dates as D
from rapport.functions import media as M
from rapport.functions import questions as Q
from rapport.functions import text as T
from rapport.functions import topics as P
from rapport.functions.evidence import clean_citations, used_labels


def values(spark, rows, expr, schema="a string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_clean_and_names(spark):
    a = F.col("a")
    assert values(spark, ["  a\u200b b\u00a0\n c ", None], T.clean_text(a)) == ["a b c", ""]
    assert values(spark, ["Jineen 🐾", "O'Neil-Smith"], T.norm_name(a)) == ["jineen", "o neil smith"]
    assert values(spark, ["Jineen 🐾", "JINEEN!"], T.duplicate_key(a)) == ["jineen", "jineen"]
    assert values(spark, ["Søren  B.", "日本!"], T.norm_name_unicode(a)) == ["søren b", "日本"]
    assert values(spark, ["+91 (62816) 83480"], T.norm_phone(a)) == ["916281683480"]
    assert values(spark, [" https://instagram.com/Ann/ ", "@bob", "t.me/x"], T.norm_username(a)) == ["ann", "bob", "x"]
    assert values(spark, ["e\u0301", "plain", None], T.nfc(a)) == ["é", "plain", None]


def test_mojibake(spark):
    broken = "🌝".encode().decode("latin-1")
    twice = broken.encode().decode("latin-1")
    assert values(spark, [broken, "Søren", "plain", "日本"], T.repair_mojibake(F.col("a"))) == ["🌝", "Søren", "plain", "日本"]
    assert values(spark, [twice], T.repair_mojibake(F.col("a"), rounds=4)) == ["🌝"]


def test_ids_match_hashlib(spark):
    import hashlib
    want = hashlib.sha256("a\x1f\x1fb".encode()).hexdigest()[:32]
    assert values(spark, [("a", None, "b")], T.deterministic_id(F.col("a"), F.col("b"), F.col("c")),
                  "a string, b string, c string") == [want]


@pytest.mark.parametrize("date,time,want", [
    ("12/28/23", "8:42 PM", dt.datetime(2023, 12, 28, 20, 42)), ("28/12/2023", "20:42", dt.datetime(2023, 12, 28, 20, 42)),
    ("25/12/23", "10:00", dt.datetime(2023, 12, 25, 10)), ("12/25/23", "10:00", dt.datetime(2023, 12, 25, 10)),
    ("1/2/23", "12:05 am", dt.datetime(2023, 2, 1, 0, 5)), ("31.12.23", "11:59:59 PM", dt.datetime(2023, 12, 31, 23, 59, 59)),
    ("2023-12-31", "23:59", dt.datetime(2023, 12, 31, 23, 59)), ("99/99/20", "1:00", None), ("1/2/23", "25:00", None)])
def test_export_dates(spark, date, time, want):
    assert values(spark, [(date, time)], D.parse_export_datetime(F.col("a"), F.col("b")), "a string, b string") == [want]


def test_iso_and_epoch(spark):
    got = values(spark, ["2024-01-01T10:00:00Z", "2024-01-01T10:00:00+05:30", "2024", "nope"], D.parse_iso(F.col("a")))
    assert got == [dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 4, 30), None, None]
    got = values(spark, ["1700000000", "1700000000123", "0", "-5", "x", "1e300"], D.parse_epoch(F.col("a")))
    assert got == [dt.datetime(2023, 11, 14, 22, 13, 20), dt.datetime(2023, 11, 14, 22, 13, 20, 123000), None, None, None, None]


def test_attachments_and_captions(spark):
    body = "\u200eIMG-20240101-WA0001.jpg (file attached)\nlook at this"
    got = values(spark, [body], C.attachments(F.col("a")))[0]
    assert [(a.kind, a.filename_key) for a in got] == [("image", "img-20240101-wa0001.jpg")]
    assert values(spark, [body], C.caption(F.col("a"))) == ["look at this"]
    got = values(spark, ["<attached: 00000012-PHOTO-2024.jpg>", "<Media omitted>", "hello", "PTT-1-WA2.opus"], C.attachments(F.col("a")))
    assert [[a.filename for a in x] for x in got] == [["00000012-PHOTO-2024.jpg"], [None], [], ["PTT-1-WA2.opus"]]
    assert got[3][0].kind == "voice"


def test_senders(spark):
    lines = ["Alice: meet me at 5:30", "https://example.com/page", "Alice created group \"Team\"", "12: 30", "x" * 100 + ": hi"]
    assert values(spark, lines, C.sender_of(F.col("a"))) == ["Alice", None, None, None, None]
    assert values(spark, lines[:1], C.body_of(F.col("a"))) == ["meet me at 5:30"]


def test_file_names(spark):
    assert values(spark, ["../../CON.txt", "a\\b\\..c?.pdf", "", "\u200eA.JPG"], M.media_filename_key(F.col("a"))) == \
        ["_con.txt", "c_.pdf", "unnamed", "a.jpg"]
    assert values(spark, ["STK-1.webp", "x.m4a", "y.unknown"], M.media_kind(F.col("a"))) == ["sticker", "audio", "other"]


NOISE = ["Reacted", "Liked", "sent an attachment", "Everyone", "Guys", "Hmm", "Okay", "Bro", "JPG", "Good morning", "Thank you",
         "Enna", "Seri", "Tmrw", "Deiii", "Those", "ASAP", "Machan"]
SUBJECTS = ["Flipkart", "Machine Learning", "DBMS", "Unit Seminar", "Server", "Series", "Networking", "React Native", "WhatsApp", "Follow"]


def test_topic_noise(spark):
    assert all(values(spark, NOISE, P.is_noise_topic(F.col("a"))))
    assert not any(values(spark, SUBJECTS, P.is_noise_topic(F.col("a"))))
    known = F.array(F.lit("hitesh"))
    assert values(spark, ["Hitesh", "Placement"], P.is_noise_topic(F.col("a"), known)) == [True, False]


def test_topics(spark):
    text = "Reacted to your message. Liked. Flipkart interview. DBMS notes. kafka kafka streams streams streams"
    assert values(spark, [text, "", None], P.extract_topics(F.col("a"))) == [["Flipkart", "DBMS", "streams", "kafka"], [], []]
    assert values(spark, ["What did we discuss about the learning models? models 123"], P.content_terms(F.col("a"))) == \
        [["discus", "learn", "model"]]


TOP_PEOPLE = ["to which people i talk the most", "who do i talk to the most", "who do I speak with most often",
              "who are my closest contacts", "who have i spoken to the most", "which people do i message most frequently",
              "how often do i talk to each person", "who do i know best", "to whom i talk most", "to whom do i talk the most",
              "with whom do i speak most often", "whom do i talk to most", "who i talk most", "to whom i talk most in the last week"]
COUNTED = {"how many messages did I send last week": "activity_count", "how many emails did I get this month": "activity_count",
           "how many meetings do I have": "activity_count", "how many times did I talk to navaneedan": "activity_count",
           "how many people have I talked to": "people_count", "how many contacts do I have": "people_count",
           "when did I last talk to navaneedan": "last_interaction", "when was the last time I spoke with hitesh": "last_interaction",
           "who did I talk to in the last 7 days": "recent_people", "what are my top topics": "top_topics",
           "what do I talk about most": "top_topics", "prepare me for tomorrow": "prepare",
           "summarize my relationship with saravana": "summary"}
ASKED = ["how many messages did navaneedan say about the trip", "who did I talk to about the internship",
         "what did I discuss with Aravinth recently", "who is navaneedan", "what promises did i make to hitesh"]


def test_intents(spark):
    assert set(values(spark, TOP_PEOPLE, Q.intent(F.col("a")))) == {"top_people"}
    assert values(spark, list(COUNTED), Q.intent(F.col("a"))) == list(COUNTED.values())
    assert set(values(spark, ASKED, Q.intent(F.col("a")))) == {"ask"}


def test_windows_and_units(spark):
    q = F.col("a")
    assert values(spark, ["in the last week", "today", "this year", "ever"], Q.window_days(q)) == [7, 1, 365, None]
    assert values(spark, ["past 3 weeks", "last month", "x"], Q.window_days_free(q)) == [21, 30, None]
    assert values(spark, ["voice notes from ann", "how many calls", "how many interactions", "x"], Q.activity_kind(q)) == \
        ["voice", "meeting", None, None]
    assert values(spark, ["on telegram", "my voice memo on whatsapp", "x marks"], Q.source_hint(q)) == ["telegram", "voice", "x"]


def test_citations(spark):
    labels = F.array(F.lit("S1"), F.lit("S2"))
    text = "Yes [S2, S9] and  [S7] more [S1]"
    assert values(spark, [text], used_labels(F.col("a"), labels)) == [["S2", "S1"]]
    assert values(spark, [text], clean_citations(F.col("a"), labels)) == ["Yes [S2] and more [S1]"]


def test_trim(spark):
    assert values(spark, ["short", "one two three four five", "x" * 30], T.trim_at_word(F.col("a"), 15)) == \
        ["short", "one two three…", "x" * 15 + "…"]


def test_natural_order(spark):
    rows = [("x10",), ("x2",), ("xa",), ("9lives",), ("+91 5",), ("anna",)]
    df = spark.createDataFrame(rows, "a string")
    ordered = [r.a for r in df.orderBy(*T.sort_name_key(F.col("a"), F.col("a"))).collect()]
    assert ordered == ["anna", "x2", "x10", "xa", "+91 5", "9lives"]


def test_table_functions_give_the_native_rows(spark):
    from rapport.functions.tables import register_table_functions
    from rapport.operators.timeline import document_chunks
    from rapport.sources.chat_text import parse_chat

    register_table_functions(spark)
    chat = ("head\n12/28/23, 8:42 PM - Alice: one\ntwo: 2\r\n[28/12/23, 11:59:59 PM] Bob: at 5:30\n"
            "28/12/2023, 20:44 – Alice created group \"T\"\n12/28/23, 8:45 PM - https://a.b/c\n12/28/23, 8:46 PM - 12: x\n")
    files = spark.createDataFrame([("a_chat.txt", chat), ("b_chat.txt", ""), ("c_chat.txt", None), ("d_chat.txt", "prose\n")], "path string, text string")
    files.createOrReplaceTempView("chats")
    rows = spark.sql("SELECT path, t.* FROM chats, LATERAL parse_chat(text) t ORDER BY path, entry_no").collect()
    assert [(r.path, r.entry_no, r.sender) for r in rows] == [
        ("a_chat.txt", i, who) for i, who in enumerate(["Alice", "Bob", None, None, None])]
    assert rows[0].body == "one\ntwo: 2" and (rows[1].sent_date, rows[1].sent_time, rows[1].body) == ("28/12/23", "11:59:59 PM", "at 5:30")
    native = {(r.sender_label, r.content) for r in parse_chat(files).collect()}
    assert native == {(r.sender, " ".join(r.body.split())) for r in rows if r.sender}
    texts = spark.createDataFrame([("x", "ab\u200b  c\u00a0d" * 40), ("y", ""), ("z", None)], "id string, text string")
    texts.createOrReplaceTempView("texts")
    got = {tuple(r) for r in spark.sql("SELECT id, chunk_no, chunk FROM texts, LATERAL text_chunks(text, 7)").collect()}
    assert got == {(r.id, r.chunk_no, r.chunk) for r in document_chunks(texts, 7).collect()} and len(got) > 20
    with pytest.raises(Exception, match="width"):
        spark.sql("SELECT * FROM texts, LATERAL text_chunks(text, 0)").collect()
