"""The user's models in the feed: vectors and transcripts of an imported archive."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from rapport.operators import retrieval as S
from rapport.operators.hooks import Models, halved, hash_embedder
from rapport.sinks import people as PL
from rapport.sinks.tables import Archive
from rapport.streaming.ingest import corpus, run_ingest, text_key

AS_OF = "2024-01-10 00:00:00"
CHAT = ("02/01/24, 8:42 PM - Alice Doe: hi there\n02/01/24, 8:43 PM - Alice Doe: PTT-20240102-WA0002.opus (file attached)\n"
        "02/01/24, 8:44 PM - Me: hi there\n02/01/24, 8:45 PM - Alice Doe: poison pill\n")


def put(folder, name, data):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def models(log):
    """An embedder that writes down what it was given and fails on one text, and a transcriber that knows two recordings."""
    def vectors(texts):
        if any("poison" in t for t in texts):
            raise ValueError("poison")
        with open(log, "a") as f:
            f.writelines(t.replace("\n", " ") + "\n" for t in texts)
        return hash_embedder(texts)

    def words(contents):
        return [{b"OggS one": "see you at the harbour", b"RIFF two": "call Alice Doe about the boat"}[c] for c in contents]

    return Models(embed=vectors, transcribe=words)


@pytest.mark.parametrize("bad", [[], [0], [3], [0, 6], list(range(7))])
def test_halved(bad):
    calls = []

    def fn(rows):
        calls.append(len(rows))
        if set(rows) & set(bad):
            raise ValueError
        return [r * 10 for r in rows]

    assert halved(fn, list(range(7))) == [None if i in bad else i * 10 for i in range(7)]
    assert len(calls) <= 2 * 7 and halved(fn, []) == [] and halved(lambda rows: rows[:1], [1, 2]) == [1, 2]


def test_vectors_and_voice_of_an_archive(spark, tmp_path):
    inbox, root, check, log = (str(tmp_path / n) for n in ("in", "db", "cp", "log"))
    put(inbox, "whatsapp/WhatsApp Chat with Alice Doe.zip", zipped({"_chat.txt": CHAT, "PTT-20240102-WA0002.opus": b"OggS one"}))
    put(inbox, "voice/memo.wav", b"RIFF two")
    put(inbox, "voice/noise.wav", b"RIFF unknown")
    archive = Archive(spark, root)
    run_ingest(spark, inbox, root, check, AS_OF, models=models(log)).awaitTermination()

    alice = archive.read("people").where("display_name = 'Alice Doe'").first().person_id
    voice = {r.filename: r for r in archive.read("voice").collect()}
    assert set(voice) == {"PTT-20240102-WA0002.opus", "memo.wav", "noise.wav"}
    note, memo = voice["PTT-20240102-WA0002.opus"], voice["memo.wav"]
    assert note.person_id == alice and note.message_id and str(note.recorded_at) == "2024-01-02 20:43:00"
    assert note.transcript == "see you at the harbour" and memo.person_id is None and memo.recorded_at is not None
    assert voice["noise.wav"].transcript is None
    memories = {r.record_id: r for r in archive.read("memories").where("kind = 'voice'").collect()}
    assert set(memories) == {note.id, memo.id} and memories[note.id].person_id == alice
    assert memories[note.id].text == "[Voice recording PTT-20240102-WA0002.opus] see you at the harbour"
    # The voice note is counted with its message; a recording that names somebody is suggested to be theirs.
    assert {r.kind for r in archive.read("events").collect()} == {"message"}
    named = archive.read("suggestions").where("source = 'voice'").collect()
    assert [(r.person_a_id, r.label) for r in named] == [(alice, "memo.wav")]

    # Every text but the one that fails has its vector; equal texts were given to the model once.
    found = corpus(archive).collect()
    assert len(found) == archive.read("memories").count()
    assert {bool(r.embedding) for r in found if "poison" in r.text} == {False}
    assert all(len(r.embedding) == 16 for r in found if "poison" not in r.text)
    given = open(log).read().splitlines()
    assert len(given) == len(set(given))

    # A later import embeds what is new only.
    put(inbox, "whatsapp/later_chat.txt", "05/01/24, 8:42 PM - Alice Doe: hi there\n05/01/24, 8:43 PM - Alice Doe: brand new\n")
    put(inbox, "voice/again.wav", b"RIFF two")
    run_ingest(spark, inbox, root, check, AS_OF, models=models(log)).awaitTermination()
    assert open(log).read().splitlines()[len(given):] == ["Alice Doe: brand new"]
    assert archive.read("voice").count() == 3 and archive.read("vectors").groupBy("text_key").count().where("count > 1").isEmpty()
    rows = corpus(archive)
    assert rows.where("embedding IS NULL").count() == 1 and rows.count() == PL.current(archive, "memories").count()

    # The vector branch searches the imported archive.
    asked = hash_embedder(["Alice Doe: brand new"])[0]
    questions = spark.createDataFrame([(1, "brand new", asked)], "qid bigint, question string, query_vec array<float>")
    best = S.hybrid_search(questions, rows, 3).orderBy(F.desc("score"), "id").first()
    assert rows.where(F.col("id") == best.id).first().text == "Alice Doe: brand new"


def test_feed_without_models(spark, tmp_path):
    inbox, root = str(tmp_path / "in"), str(tmp_path / "db")
    put(inbox, "voice/memo.wav", b"RIFF two")
    archive = Archive(spark, root)
    run_ingest(spark, inbox, root, str(tmp_path / "cp"), AS_OF).awaitTermination()
    assert [(r.filename, r.transcript) for r in archive.read("voice").collect()] == [("memo.wav", None)]
    assert archive.read("memories").isEmpty() and corpus(archive).isEmpty()
    assert spark.range(1).select(text_key(F.lit("a")).alias("k")).first().k.startswith("ca978112")
