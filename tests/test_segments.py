"""The segmented text index: equal to one index over everything, whatever is merged, replayed or broken off."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rapport.operators import retrieval as S
from rapport.sinks.segments import FANOUT, TextIndex, _lists, indexed

COLUMNS = "id string, text string, person_id string, source string"
QUESTIONS = [(1, "where is the red boat?"), (2, "green lantern and boats"), (3, "nothing of the kind"), (4, "the")]


@pytest.fixture(scope="module")
def corpus(spark):
    words = ["red", "green", "boat", "boats", "lantern", "river", "kind", "Zürich", "the"]
    rows = [(f"m{i:03d}", " ".join(words[(i * j + j * j) % len(words)] for j in range(1, 2 + i % 7)) if i % 11 else ("" if i % 2 else None),
             f"p{i % 4}", "chat") for i in range(90)]
    return spark.createDataFrame(rows, COLUMNS).cache()


def parts(corpus, n):
    return [corpus.where(F.substring("id", 2, 3).cast("int") % n == i) for i in range(n)]


def hits(df):
    return sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())


def test_search_before_and_after_merges(spark, corpus, tmp_path):
    questions = spark.createDataFrame(QUESTIONS, "qid int, question string")
    want = hits(S.keyword_search(questions, corpus, 6))
    index = indexed(spark, str(tmp_path / "a"), parts(corpus, 4))
    assert want and hits(index.search(questions, 6)) == want and len(index.live()) == 4
    merged = index.merge([1, 3])
    assert hits(index.search(questions, 6)) == want and sorted(map(len, (s.batches for s in index.live()))) == [1, 1, 2]
    index.merge([0, 1])                              # one of them is a merged one already
    assert hits(index.search(questions, 6)) == want and merged not in {s.segment for s in index.live()}
    assert index.merge([0, 1]) is None and index.merge() is None
    own = S.postings(corpus).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))
    assert sorted(index.term_counts().collect()) == sorted(own.collect())
    assert index.size().first().docs == 90
    person = questions.withColumn("person_id", F.lit("p1"))
    assert hits(index.search(person, 6)) == hits(S.keyword_search(person, corpus, 6))
    moved = spark.createDataFrame([("p2", "p1")], "old_id string, new_id string")
    one = corpus.withColumn("person_id", F.when(F.col("person_id") == "p2", "p1").otherwise(F.col("person_id")))
    assert hits(index.search(person, 6, moved)) == hits(S.keyword_search(person, one, 6))


def test_only_asked_terms_are_read(spark, corpus, tmp_path):
    index = indexed(spark, str(tmp_path / "a"), parts(corpus, 2))
    asked = index.asked(spark.createDataFrame([(1, "where is the red boat?")], "qid int, question string"))
    plan = asked._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan
    assert {r.term for r in asked.select("term").distinct().collect()} <= {"red", "boat"}


def test_replays_and_broken_batches(spark, corpus, tmp_path):
    questions = spark.createDataFrame(QUESTIONS, "qid int, question string")
    index = indexed(spark, str(tmp_path / "a"), parts(corpus, 3))
    want = hits(index.search(questions, 6))
    index.append(parts(corpus, 3)[2], 2)             # replayed
    assert hits(index.search(questions, 6)) == want and len(index.live()) == 3
    index.merge([1, 2])
    index.append(parts(corpus, 3)[2], 2)             # replayed after the merge
    assert hits(index.search(questions, 6)) == want and len(index.live()) == 2

    def broken(*_):
        raise RuntimeError("lost")

    index._publish = broken
    with pytest.raises(RuntimeError):
        index.append(corpus, 9)
    again = TextIndex(spark, str(tmp_path / "a"))
    assert hits(again.search(questions, 6)) == want
    empty = TextIndex(spark, str(tmp_path / "b"))
    assert empty.search(questions).collect() == [] and empty.merge() is None
    empty.append(corpus.limit(0), 0)
    assert empty.search(questions).collect() == [] and empty.size().first().docs == 0


def test_small_segments_merge_by_size_class(spark, corpus, tmp_path):
    index = indexed(spark, str(tmp_path / "a"), [corpus.where(F.col("id") == f"m{i:03d}") for i in (3, 10, 17, 24, 31, 38, 45, 52)])
    assert len(index.live()) == FANOUT and index.merge() is not None and len(index.live()) == 1


def test_segments_are_written_and_merged_without_a_shuffle(spark, corpus, tmp_path, monkeypatch):
    """all postings went through a range shuffle in every segment and again in every merge."""
    def shuffled(*_):
        raise AssertionError("postings are shuffled")

    monkeypatch.setattr(type(corpus), "repartitionByRange", shuffled)
    index = indexed(spark, str(tmp_path / "a"), parts(corpus, 2))
    assert index.merge([0, 1]) and "Exchange" not in index.lists()._jdf.queryExecution().toString()


def test_lists_are_cut_by_blocks_and_say_what_they_hold(spark, corpus, tmp_path, monkeypatch):
    """lists of several blocks in one task count as postings of single memories do."""
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c", "d"]), pa.array([["x", "y", "x"], [], ["x"], ["z"] * 9])], names=["id", "tokens"])
    monkeypatch.setattr("rapport.sinks.segments.BLOCK", 4)
    found = [row for block in _lists([batch.slice(1), batch]) for row in block.to_pylist()]
    assert {r["term"]: (r["df"], r["occurrences"]) for r in found[:1] + found[1:2]} == {"x": (1, 1), "z": (1, 9)}
    assert [(r["term"], r["ids"], r["tfs"], r["lens"]) for r in found[2:]] == [
        ("x", ["a", "c"], [2, 1], [3, 1]), ("y", ["a"], [1], [3]), ("z", ["d"], [9], [9])]
    assert list(_lists([batch.slice(0, 0)])) == []


def test_kept_counts_are_used(spark, corpus, tmp_path, monkeypatch):
    """document frequencies come from the lists, and many asked terms travel to the lists, not the lists to them."""
    index = indexed(spark, str(tmp_path / "a"), parts(corpus, 2))
    many = spark.createDataFrame([(1, "red boat " + " ".join(f"word{i}x" for i in range(2_100)))], "qid int, question string")
    assert hits(index.search(many, 6)) == hits(S.keyword_search(many, corpus, 6))
    monkeypatch.setattr(index, "size", lambda: spark.createDataFrame([(90, 3.0)], "docs bigint, avg_len double"))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.search(many, 6)._jdf.queryExecution().executedPlan().toString()
        assert "count(" not in plan and "SortMergeJoin" not in index.asked(many)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
