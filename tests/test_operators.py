"""Operators on small literal tables, against brute force or by invariant."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from rapport.operators import answers as A
from rapport.operators import ledger as L
from rapport.operators import maintenance as MT
from rapport.operators import match as M
from rapport.operators import resolution as R
from rapport.operators import retrieval as S
from rapport.operators.hooks import embed, hash_embedder, map_prompts
from rapport.operators.ranking import positions, rolling_counts
from rapport.sinks import changes as W

NOW = dt.datetime(2024, 6, 1)


def ledger(spark):
    rows = [("A", 1), ("A", 2), ("A", 3), ("B", 1), ("A", -5), (None, 1), ("", 2)]
    return spark.createDataFrame([(p, "email" if p == "B" else "message", "s", NOW - dt.timedelta(days=d)) for p, d in rows],
                                 "person_id string, kind string, source string, occurred_at timestamp_ntz")


def test_leaderboard_bounds(spark):
    assert [tuple(r)[:2] for r in L.leaderboard(ledger(spark)).collect()] == [("A", 4), ("B", 1)]
    assert [tuple(r)[:2] for r in L.leaderboard(ledger(spark), 10, NOW, NOW - dt.timedelta(days=2)).collect()] == [("A", 2), ("B", 1)]
    totals = {(r.facet, r.value): r.n for r in L.activity_totals(ledger(spark), NOW).collect()}
    assert totals[("total", "all")] == 6 and totals[("kind", "email")] == 1
    assert L.distinct_people(ledger(spark), NOW).collect()[0].people == 2


@pytest.mark.parametrize("count,days,status", [(20, 3, "Very Active"), (12, 5, "Active"), (4, 40, "Occasional"), (1, 90, "No Recent Activity"),
                                               (1, 20, "Low Activity")])
def test_status_ladder(spark, count, days, status):
    rows = [("p", "k", "s", NOW - dt.timedelta(days=days, minutes=i)) for i in range(count)]
    df = spark.createDataFrame(rows, "person_id string, kind string, source string, occurred_at timestamp_ntz")
    assert L.relationship_status(df, NOW).collect()[0].status == status


def test_unknown_match_operator_raises(spark):
    with pytest.raises(NotImplementedError):
        M.match(ledger(spark), {"occurred_at": {"$near": [1, 2]}})
    assert M.find(ledger(spark), {}).count() == 7
    assert M.find(ledger(spark), {"person_id": {"$ne": "A"}}).count() == 3
    assert M.find(ledger(spark), {"person_id": {"$in": []}}).count() == 0


def test_positions_and_rolling_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 else "b", base + dt.timedelta(hours=int(rng.integers(0, 4000)))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, at timestamp_ntz")
    got = {r.id: r.position for r in positions(df, ["k"], "at", ["id"]).collect()}
    roll = {r.id: (r.n14, r.n60) for r in rolling_counts(df, ["k"], "at", [14, 60]).collect()}
    assert len(roll) == 400
    for key in ("hot", "b"):
        mine = sorted([r for r in rows if r[1] == key], key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in mine] == list(range(1, len(mine) + 1))
        for r in mine:
            want = tuple(sum(0 <= (r[2] - o[2]).total_seconds() <= d * 86400 for o in mine) for d in (14, 60))
            assert roll[r[0]] == want


def test_rolling_counts_keep_ties_null_times_and_null_keys(spark):
    base = dt.datetime(2024, 3, 1)
    at = [0, 0, 0, 14 * 86400, 14 * 86400 + 1, 60 * 86400, None, None, -5]
    rows = [(i, k, None if s is None else base + dt.timedelta(seconds=s)) for k in ("hot", None) for i, s in enumerate(at)]
    df = spark.createDataFrame(rows, "id int, k string, at timestamp_ntz").unionByName(
        spark.createDataFrame([(0, "hot", base)], "id int, k string, at timestamp_ntz"))         # a repeated row
    rows.append((0, "hot", base))
    for bucket in (3600, 30 * 86400):
        out = rolling_counts(df, ["k"], "at", [14, 60], bucket)
        assert out.columns == ["id", "k", "at", "n14", "n60"]
        want = sorted(((i, k or "", t or base.min) + tuple(
            None if t is None else sum(k == o and u is not None and 0 <= (t - u).total_seconds() <= d * 86400 for _, o, u in rows)
            for d in (14, 60)) for i, k, t in rows), key=str)
        assert sorted(((r.id, r.k or "", r.at or base.min, r.n14, r.n60) for r in out.collect()), key=str) == want
    assert rolling_counts(df.limit(0), ["k"], "at", [14]).count() == 0
    # No window runs over a group without its bucket, but for the one over bucket totals.
    plan = rolling_counts(df, ["k"], "at", [14, 60])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("_n" in line.split("windowspec")[0] for line in windows) == 1


def vectors(spark, n=60, q=9):
    rng = np.random.default_rng(1)
    corpus = [(f"m{i:03d}", "x" if i % 3 else "y", [float(v) for v in rng.normal(size=8)] if i % 7 else None) for i in range(n)]
    asks = [(i, "x" if i % 2 else None, [float(v) for v in rng.normal(size=8)]) for i in range(q)]
    return (spark.createDataFrame(asks, "qid bigint, source string, query_vec array<float>"),
            spark.createDataFrame(corpus, "id string, source string, embedding array<float>"), asks, corpus)


def test_vector_search_both_ways_match_brute_force(spark):
    q, c, asks, corpus = vectors(spark)
    want = set()
    for qid, src, v in asks:
        v = np.array(v, dtype="float32").astype(float)
        scored = []
        for mid, s, e in corpus:
            if e is None or (src and s != src):
                continue
            e = np.array(e, dtype="float32").astype(float)
            scored.append((-round(float(v @ e / np.linalg.norm(v) / np.linalg.norm(e)), 6), mid))
        want |= {(qid, mid, i + 1) for i, (_, mid) in enumerate(sorted(scored)[:5])}
    for block in (2048, 4):
        got = {(r.qid, r.id, r["rank"]) for r in S.vector_search(q, c, 5, question_block=block, corpus_block=16).collect()}
        assert got == want


def test_fusion_lengths(spark):
    hits = "qid bigint, id string, score double, rank int"
    v = spark.createDataFrame([(1, f"v{i}", 1.0, i + 1) for i in range(10)], hits)
    k = spark.createDataFrame([(1, "k0", 1.0, 1)], hits)
    best = S.fuse(v, k).orderBy(F.desc("score"), "id").collect()
    assert [b.id for b in best[:3]] == ["v0", "v1", "v2"] and best[0].score == 1.0
    assert {b.id: b.score for b in best}["k0"] == 0.7
    with pytest.raises(ValueError):
        S.fuse(v, k, "other")


def test_budget_skips_but_continues(spark):
    corpus = spark.createDataFrame([("a", "x" * 90), ("b", "y" * 60), ("c", "z" * 8)], "id string, text string")
    fused = spark.createDataFrame([(1, "a", 3.0, 0, None), (1, "b", 2.0, 1, 0), (1, "c", 1.0, None, 1)],
                                  "qid bigint, id string, score double, vector_rank int, keyword_rank int")
    rows = S.evidence(fused, corpus, (4, 240, 100)).orderBy("position").collect()
    assert [(r.id, r.label, r.matched_by) for r in rows] == [("a", "S1", "semantic"), ("c", "S2", "keyword")]
    assert [r.id for r in S.evidence(fused, corpus, (4, 240, 10)).collect()] == ["a"]


def test_fallback_only_without_hits(spark):
    q = spark.createDataFrame([(1, "interviews"), (2, "lipka")], "qid bigint, question string")
    c = spark.createDataFrame([("a", "the interview at Flipkart"), ("b", "nothing")], "id string, text string")
    assert {(r.qid, r.id) for r in S.keyword_search_with_fallback(q, c).collect()} == {(1, "a"), (2, "a")}


def people(spark):
    return spark.createDataFrame([("p1", "Aravinth K", [], False), ("p2", "Aravinth S", ["AS"], False), ("p3", "Hitesh", [], False),
                                  ("p4", "Jineen", [], False), ("p5", "Jineen 🐾", [], False)],
                                 "person_id string, display_name string, aliases array<string>, is_user boolean")


def test_senders_are_never_merged_silently(spark):
    ids = spark.createDataFrame([("p3", "email", "h@x.org"), ("p3", "phone", "916281683480")], "person_id string, kind string, value string")
    labels = spark.createDataFrame([("Aravinth", None, None), ("hitesh", None, None), ("H.", "H@x.org ", None), ("Q", None, None),
                                    ("Zed Z", None, "62816 83480"), ("me", None, None), ("🐾🐾", None, None), ("New One", None, None)],
                                   "label string, email string, phone string")
    rows = {r.label: r for r in R.resolve_senders(labels, people(spark), ids).collect()}
    assert rows["Aravinth"].how == "new" and rows["Aravinth"].suggested_id == "p1"
    assert (rows["hitesh"].person_id, rows["hitesh"].how) == ("p3", "name")
    assert (rows["H."].person_id, rows["Zed Z"].person_id) == ("p3", "p3")
    assert [rows[k].how for k in ("Q", "me", "🐾🐾", "New One")] == ["placeholder", "owner", "placeholder", "new"]


def test_duplicates_keep_the_busier(spark):
    events = spark.createDataFrame([("p5",), ("p5",), ("p4",)], "person_id string")
    rows = R.duplicate_people(people(spark), events).collect()
    assert [(r.keeper_id, r.person_id) for r in rows] == [("p5", "p4")]


def test_merge_chains_and_idempotence(spark):
    chain = [(f"n{i}", f"n{i - 1}") for i in range(1, 20)] + [("x", "y"), ("y", "z"), ("z", "x"), ("s", "s")]
    got = {r.old_id: r.new_id for r in R.resolve_merges(spark.createDataFrame(chain, "old_id string, new_id string")).collect()}
    assert all(got[f"n{i}"] == "n0" for i in range(1, 20)) and (got["y"], got["z"]) == ("x", "x") and "x" not in got
    merges = spark.createDataFrame([("b", "a")], "old_id string, new_id string")
    rows = spark.createDataFrame([("1", "b"), ("2", "a"), ("3", None)], "id string, person_id string")
    once = R.repoint(rows, merges)
    assert once.where("moved").count() == 1 and R.repoint(once.drop("moved"), merges).where("moved").count() == 0
    arrays = spark.createDataFrame([("1", ["b", "a", "c"]), ("2", ["c"])], "id string, person_ids array<string>")
    assert {r.id: r.person_ids for r in R.repoint_array(arrays, merges, "id", "person_ids").collect()} == {"1": ["a", "c"], "2": ["c"]}


def test_phone_suffix_both_ways(spark):
    ids = spark.createDataFrame([("p3", "phone", "12345"), ("p1", "phone", "9112345")], "person_id string, kind string, value string")
    asked = spark.createDataFrame([("0012345",), ("345",), ("777",)], "phone string")
    assert {r.digits: r.person_id for r in R.phone_matches(asked, people(spark), ids).collect()} == {"0012345": "p3", "345": "p1"}


def test_voice_mentions_broadcast_no_table_that_grows(spark):
    """names and transcripts of repeated values lie in small files and must not be broadcast for that."""
    people = spark.range(3).selectExpr("concat('p', id) AS person_id", "concat('Ann ', id) AS display_name",
                                       "array('Al') AS aliases", "timestamp_ntz'2020-01-01 00:00:00' AS created_at")
    voice = spark.range(6).selectExpr("concat('v', id) AS id", "concat('f', id) AS filename",
                                      "CASE WHEN id < 4 THEN concat('with ann ', id % 2, '.') ELSE 'nobody' END AS transcript")
    rows = R.voice_mention_suggestions(voice, people)
    assert "BroadcastExchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in rows.collect()} == {"sug-voice-v0-p0", "sug-voice-v1-p1", "sug-voice-v2-p0", "sug-voice-v3-p1"}


def test_name_mentions_need_boundaries(spark):
    q = spark.createDataFrame([(1, "what did Hitesh say"), (2, "hiteshs car"), (3, "ask aravinth s or as"), (4, "")], "qid bigint, question string")
    assert {r.qid: r.person_id for r in R.person_in_question(q, people(spark)).collect()} == {1: "p3", 3: "p2"}


def test_scoring_has_partitions_for_the_corpus(spark, monkeypatch):
    """F10 to F15: postings are few before they meet the questions and must not be put together for that."""
    corpus = spark.range(40).selectExpr("concat('m', id) AS id", "concat('alpha beta ', id) AS text")
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta 7")], "qid bigint, question string")
    monkeypatch.setattr(S, "TASK_TOKENS", 6, raising=False)
    scores = S.keyword_scores(asked, corpus)
    assert "REPARTITION_BY_NUM" in scores._jdf.queryExecution().executedPlan().toString()
    assert scores.count() == 80 and scores.rdd.getNumPartitions() == 20


def test_topic_deltas_read_documents_only(spark):
    """F8: topics come from the text; no import meets the vectors."""
    from rapport.plans.catalog import QUERIES
    plan = QUERIES["t4_topics_by_deltas"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "vec_id" not in plan


def test_repointing_members_moves_them_once(spark):
    """whoever is replaced, order and co-attendees stay; members are shuffled to the merges once."""
    rows = spark.createDataFrame([("a", ["p3", "p1", "p2"]), ("b", ["p4"]), ("c", ["p1", "p5", "p2", "p1"]), ("d", []), ("e", None)], "id string, person_ids array<string>")
    merges = spark.createDataFrame([("p1", "p2"), ("p5", "p6")], "old_id string, new_id string")
    out = R.repoint_array(rows, merges, "id", "person_ids")
    assert {r.id: (r.person_ids, r.moved) for r in out.collect()} == {
        "a": (["p3", "p2"], True), "b": (["p4"], False), "c": (["p2", "p6"], True), "d": ([], False), "e": (None, False)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1


def test_short_lists_of_members_stay_where_they_are(spark, monkeypatch):
    """members were shuffled to the merges with the meeting's id, and those that changed once more to their meeting."""
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = spark.createDataFrame([
        (1, "a", ["p3", "p1", "p2"]), (2, "b", ["p4"]), (3, "c", ["p1", "p5", "p2", "p1"]), (4, "d", []), (5, "e", None),
        (6, "f", ["p7", "p7"]), (7, "g", [None, "p5"]), (8, "h", ["p9", "p9", "p9", "p9", "p9", "p1"])], "n int, id string, person_ids array<string>")
    merges = spark.createDataFrame([("p1", "p2"), ("p5", "p6"), ("nobody", "p4")], "old_id string, new_id string")
    want = {"a": (["p3", "p2"], True), "b": (["p4"], False), "c": (["p2", "p6"], True), "d": ([], False), "e": (None, False),
            "f": (["p7", "p7"], False), "g": ([None, "p6"], True), "h": (["p9", "p2"], True)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for people, places in ((400_000, 8), (400_000, 3), (400_000, 1), (1, 8)):
            monkeypatch.setattr(R, "BROADCAST_MERGES", people, raising=False)
            monkeypatch.setattr(R, "PLACES", places, raising=False)
            out = R.repoint_array(rows, merges, "id", "person_ids")
            assert {r.id: (r.person_ids, r.moved) for r in out.collect()} == want, (people, places)
            ran = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert ("SortMergeJoin" in ran) == (people == 1 or places < 6), (people, places)
        monkeypatch.setattr(R, "BROADCAST_MERGES", 400_000)
        monkeypatch.setattr(R, "PLACES", 8)
        nobody = R.repoint_array(rows, merges.where("old_id = 'nobody'"), "id", "person_ids")
        assert {r.id: (r.person_ids, r.moved) for r in nobody.collect()} == {r.id: (r.person_ids, False) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_equal_questions_are_asked_once(spark):
    """F3"""
    q = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "a", "p1"), (4, None, None), (5, None, None)], "qid bigint, question string, person_id string")
    once, asked_as = A.asked_once(q)
    assert sorted((r.qid, r.question, r.person_id) for r in once.collect()) == [(1, "a", None), (2, "a", "p1"), (4, None, None)]
    assert {r.qid: r._as for r in asked_as.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}


def test_accepting_answers(spark):
    answers = spark.createDataFrame([(1, "Yes [S1] [S9]"), (2, "no citation"), (3, "I couldn't find enough evidence in your imported data.")],
                                    "qid bigint, answer string")
    rows = {r.qid: r for r in A.accept_answers(answers, spark.createDataFrame([(1, "S1"), (2, "S1")], "qid bigint, label string")).collect()}
    assert (rows[1].answer, rows[1].insufficient) == ("Yes [S1]", False) and rows[2].insufficient and rows[3].insufficient


def test_insert_twice_inserts_nothing(spark):
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), (None, 2)], "id string, v int")
    first = W.new_rows(batch, None, ["id"], ["v"])
    assert sorted((r.id or "", r.v) for r in first.collect()) == [("", 1), ("", 2), ("a", 1), ("b", 1)]
    assert W.insert_counts(batch.where("id is not null"), first.where("id is not null"), ["id"]).collect()[0].inserted == 0


def test_hooks_and_maintenance(spark):
    df = spark.createDataFrame([("hello",), (None,)], "text string")
    assert [len(r.embedding) for r in embed(df, "text", hash_embedder).collect()] == [16, 16]
    assert [r.answer for r in map_prompts(df, "text", lambda texts: 1 / 0).collect()] == [None, None]
    old = spark.createDataFrame([("a", "1", "x")], "id string, n string, gone string")
    ddl = "id string, n int, title string"
    assert MT.upgrade(old, ddl, {"title": F.col("id")}).collect()[0].asDict() == {"id": "a", "n": 1, "title": "a"}
    assert {(r.column, r.change) for r in MT.upgrade_report(old, ddl).collect()} == {("n", "rebuilt"), ("title", "added"), ("gone", "dropped")}
    demo = MT.demo_messages(spark, 500)
    assert demo.count() == 500 and demo.exceptAll(MT.demo_messages(spark, 500)).isEmpty()


def test_index_round_trip(spark, tmp_path):
    c = MT.demo_messages(spark, 200).select("id", F.col("content").alias("text"))
    MT.reindex(c, str(tmp_path / "ix"))
    index, size = S.read_index(spark, str(tmp_path / "ix"))
    q = spark.createDataFrame([(1, "which exam"), (2, "kubernetes")], "qid bigint, question string")
    assert sorted(map(tuple, S.keyword_search(q, c, 5, index, size).collect())) == sorted(map(tuple, S.keyword_search(q, c, 5).collect()))
