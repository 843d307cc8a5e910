"""Parsers on small literal files."""

import base64
import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from rapport.sources import archive, chat_json, chat_text, files, records, tabular


def text_files(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, text string")


def test_chat_forms(spark):
    text = ("12/28/23, 8:42 PM - Messages and calls are end-to-end encrypted\n"
            "12/28/23, 8:42 PM - Alice: line one\nline two\nline three\n"
            "[28/12/23, 11:59:59 PM] Bob: meet at 5:30\n"
            "28/12/2023, 20:44 – Alice created group \"T\"\n12/28/23, 8:45 PM - https://a.b/c\n"
            "12/28/23, 8:46 PM - Alice: <Media omitted>\n")
    rows = chat_text.parse_chat(text_files(spark, ("a/x_chat.txt", text), ("b/renamed.txt", text))).collect()
    first = [r for r in rows if r.path.startswith("a/")]
    assert [(r.sender_label, r.content) for r in first] == [
        ("Alice", "line one line two line three"), ("Bob", "meet at 5:30"), ("Alice", "<Media omitted>")]
    assert first[1].sent_at == dt.datetime(2023, 12, 28, 23, 59, 59)
    assert first[2].attachments[0].kind == "media"
    assert {r.id for r in rows} == {r.id for r in first} and len({r.id for r in first}) == 3


def test_prose_is_not_a_chat(spark):
    assert chat_text.parse_chat(text_files(spark, ("r.txt", "just some text\nwith lines\n"))).count() == 0


def test_transcript(spark):
    text = "intro\n2023-12-31 23:59 <Alice> hi\nmore\nBob: yo there\n"
    rows = chat_text.parse_transcript(text_files(spark, ("t.txt", text))).collect()
    assert [(r.sender_label, r.content) for r in rows] == [("Alice", "hi more"), ("Bob", "yo there")]


def test_encodings(spark):
    raw = "12/28/23, 8:42 PM - A\u00e9ric: caf\u00e9"
    rows = [(raw.encode("utf-16"),), (raw.encode("utf-8"),), (raw.encode("utf-8-sig"),), (raw.encode("latin-1"),)]
    df = spark.createDataFrame(rows, "content binary")
    assert {r[0] for r in df.select(files.decode_text(F.col("content"))).collect()} == {raw}


def test_telegram_shapes(spark):
    chat = {"name": "Ann", "id": 1, "messages": [
        {"type": "message", "date": "2024-01-02T03:04:05", "from": "Ann", "text": ["a ", {"type": "bold", "text": "b"}], "reply_to_message_id": 7},
        {"type": "service", "actor": "x", "text": ""}, {"type": "message", "from": "Me", "text": "", "photo": "p.jpg"},
        {"type": "message", "from": "Me", "text": "[\"not a list\"]"}]}
    shapes = [("1", json.dumps(chat)), ("2", json.dumps([chat])), ("3", json.dumps({"chats": {"list": [chat]}}))]
    rows = chat_json.parse_telegram(text_files(spark, *shapes)).collect()
    for path in "123":
        mine = [r for r in rows if r.path == path]
        assert [(r.sender_label, r.content, r.reply_to) for r in mine] == [
            ("Ann", "a b", "7"), ("Me", "", None), ("Me", "[\"not a list\"]", None)]
        assert mine[1].attachments[0].kind == "photo"


def test_instagram(spark):
    broken = "🌝".encode().decode("latin-1")
    thread = {"participants": [{"name": "Ann"}, {"name": "Me"}], "title": "Ann", "messages": [
        {"sender_name": "Ann", "timestamp_ms": 1700000000123, "content": "hi " + broken,
         "photos": [{"uri": "a/b/P1.JPG"}, {"uri": "c/p1.jpg"}]},
        {"sender_name": "Me", "timestamp_ms": 1700000000124, "share": {"link": "x"}},
        {"sender_name": "", "content": "dropped"}]}
    nd = "\n".join(json.dumps(m) for m in thread["messages"])
    rows = chat_json.parse_instagram(text_files(spark, ("t", json.dumps(thread)), ("n", nd))).collect()
    mine = [r for r in rows if r.path == "t"]
    assert [(r.content, r.conversation_id) for r in mine] == [("hi 🌝", "instagram:ann"), ("Shared a post", "instagram:ann")]
    assert [a.filename_key for a in mine[0].attachments] == ["p1.jpg"]
    assert len([r for r in rows if r.path == "n"]) == 2


def test_x(spark):
    item = {"message_create": {"senderId": "42", "createdAt": "2024-01-02T03:04:05Z", "message_data": {"text": "hello", "urls": [{"url": "u"}]}}}
    js = "window.YTD.direct_messages.part0 = " + json.dumps([item]) + ";"
    users = chat_json.x_users(text_files(spark, ("users.js", json.dumps([{"account": {"accountId": "42", "userName": "ann"}}]))))
    row = chat_json.parse_x(text_files(spark, ("d.js", js)), users).collect()[0]
    assert (row.sender_label, row.content, row.sent_at) == ("ann", "hello u", dt.datetime(2024, 1, 2, 3, 4, 5))


def test_generic_csv_mapping(spark):
    text = 'When,Who,Said,Room\n2024-01-01T10:00:00,Ann,"a, ""b""\nc",R 1\n'
    rows = tabular.csv_rows(text_files(spark, ("f.csv", text)))
    got = tabular.parse_generic(rows, {"timestamp": "When", "sender": "Who", "content": "Said", "conversation": "Room"}).collect()[0]
    assert (got.sender_label, got.content, got.conversation_id) == ("Ann", 'a, "b" c', "chat:r-1")
    assert {r.field for r in tabular.detect_fields(rows).collect()} == {"When", "Who", "Said", "Room"}


def test_html_tables_of_one_file_are_read_by_all_cores(spark):
    """F20"""
    page = "<table><tr><th>message</th></tr><tr><td>hi</td></tr></table>"
    rows = tabular.html_table_rows(text_files(spark, ("a.html", page)).coalesce(1))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert [r.fields for r in rows.collect()] == [{"message": "hi"}]


def test_attachments_are_found_by_all_cores(spark):
    """F17"""
    from rapport.plans.catalog_sources import QUERIES
    rows = QUERIES["f13_f14_attachments"][0](spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_plain_emails_read_as_by_the_library(spark, monkeypatch):
    """the quick reader gives what the library gives, and mails of one small file are read by all cores."""
    word = lambda text: "=?utf-8?B?" + base64.b64encode(text.encode()).decode() + "?="
    heads = [f"From: {sender}\nTo: {to}\nSubject: {subject}\nDate: {date}\n" for sender in ("Ann B <A@x.org>", "a@x.org")
             for to in ("b@x.org", "b@x.org, c.d@y.org") for subject in ("hello", "two  spaces", word(""), word("é ü"), word(" x "))
             for date in ("02 Jan 1995 00:00:00 +0000", "Tue, 02 Jan 2024 03:04:05 +0530", "31 Feb 2020 00:00:00 +0000")]
    mails = [(head + "\n" + body).encode() for head in heads for body in ("", "a\nb\n", "\n<b>x</b>")]
    assert all(records._plain_email(m) for m in mails)
    quick = [records._read_email("p", m) for m in mails]
    odd = [b"Content-Type: text/html\n" + mails[0], b"Subject: again\n" + mails[0], mails[0].replace(b"\nTo", b"\n To"),
           mails[0] + "é".encode(), mails[0].replace(b"\n", b"\r\n")]
    assert not any(records._plain_email(m) for m in odd)
    monkeypatch.setattr(records, "_plain_email", lambda content: None)
    assert repr([records._read_email("p", m) for m in mails]) == repr(quick)
    files = spark.createDataFrame([("a.eml", mails[0])], "path string, content binary").coalesce(1)
    assert records.parse_email_files(files).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_email_files(spark):
    eml = (b"From: =?utf-8?q?Ann?= <ann@x.org>\nTo: b@x.org\nSubject: =?utf-8?b?SMOpbGxv?=\nDate: Tue, 02 Jan 2024 03:04:05 +0200\n"
           b"Content-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/html\n\n<p>html</p>\n--B\nContent-Type: text/plain\n\nplain text\n"
           b"--B\nContent-Type: text/plain\nContent-Disposition: attachment; filename=a.txt\n\nzz\n--B--\n")
    box = b"From a\nFrom: a@x.org\nSubject: one\n\nbody1\n\nFrom b\nFrom: b@x.org\nSubject: two\n\nbody2\n"
    df = spark.createDataFrame([("m.eml", eml), ("b.mbox", box)], "path string, content binary")
    rows = {(r.path, r.subject): r for r in records.parse_email_files(df).collect()}
    mail = rows[("m.eml", "Héllo")]
    assert (mail.from_address, mail.body, mail.sent_at) == ("ann@x.org", "plain text", dt.datetime(2024, 1, 2, 1, 4, 5))
    assert mail.attachments[0].label == "a.txt" and {s for p, s in rows if p == "b.mbox"} == {"one", "two"}


def test_calendar_and_contacts(spark):
    ics = ("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Long\r\n er title\r\nDTSTART:20240102T030405Z\r\nDESCRIPTION:Participants: A B\\, C\\nend\r\n"
           "END:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART;VALUE=DATE:20240105\r\nATTENDEE;CN=Ann;X=1:mailto:a@x.org\r\nEND:VEVENT\r\nEND:VCALENDAR")
    rows = records.parse_ics(text_files(spark, ("c.ics", ics))).collect()
    assert [(r.title, r.starts_at, r.participants) for r in rows] == [
        ("Longer title", dt.datetime(2024, 1, 2, 3, 4, 5), ["A B", "C"]), ("(untitled)", dt.datetime(2024, 1, 5), ["Ann"])]
    vcf = "BEGIN:VCARD\nVERSION:3.0\nN:Doe;Jane;;;\nitem1.TEL;TYPE=CELL:+1 (2) 3\nEMAIL:J@X.org\nNICKNAME:JJ,Janey\nEND:VCARD\n"
    card = records.parse_vcf(text_files(spark, ("c.vcf", vcf))).collect()[0]
    assert (card.name, card.phone, card.email, card.aliases) == ("Jane Doe", "123", "j@x.org", ["JJ", "Janey"])


def _zip(entries):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return buf.getvalue()


@pytest.mark.parametrize("content,verdicts", [
    (_zip({"a/b.txt": b"x", "n.zip": _zip({"c.txt": b"y"})}), ["ok", "ok"]), (b"not a zip", ["corrupt zip: File is not a zip file"]),
    (_zip({"../evil.txt": b"x"}), ["entry leaves the archive: ../evil.txt"]), (_zip({"/abs.txt": b"x"}), ["entry leaves the archive: /abs.txt"]),
    (_zip({"C:\\x.txt": b"x"}), ["entry leaves the archive: C:\\x.txt"]),
    (_zip({"1.zip": _zip({"2.zip": _zip({"3.zip": _zip({"4.txt": b""})})})}), ["archives nested too deeply"])])
def test_archives(spark, content, verdicts):
    df = spark.createDataFrame([("z.zip", content)], "path string, content binary")
    assert [r.verdict for r in archive.expand_archives(df).collect()] == verdicts


def test_documents(spark):
    page = "<html><head><title> T </title><style>p{}</style></head><body><script>x()</script><p>a &amp; b</p></body></html>"
    rows = {r.filename: r for r in records.parse_documents(text_files(spark, ("d/p.html", page), ("d/n.md", "\n# Head\nbody"))).collect()}
    assert (rows["p.html"].title, rows["n.md"].title, rows["n.md"].text) == ("T", "Head", "# Head\nbody")
    assert rows["p.html"].text.endswith("a & b") and "x()" not in rows["p.html"].text
    xml = ('<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p>'
           '<w:p><w:r><w:t>World</w:t></w:r></w:p></w:body></w:document>')
    df = spark.createDataFrame([("a.docx", _zip({"word/document.xml": xml})), ("bad.docx", b"zz")], "path string, content binary")
    got = {r.path: r for r in records.docx_text(df).collect()}
    assert got["a.docx"].docx_text == "Hello\nWorld" and got["bad.docx"].error
