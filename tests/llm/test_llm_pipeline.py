"""The whole pipeline against a brute-force version, and the registered queries against their SQL."""

import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
import compare as cmp  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not on this machine")
    return cmp.connect(SF)


@pytest.mark.parametrize("name", ["op2_quality_rules", "op4_mixing", "op5_near_vectors", "op9_warc", "op10_ngram_join",
                                  "op11_prefix_trie", "op12_centroids", "op13_topk"])
def test_query_matches_sql(spark, con, name):
    from rapport.llm.catalog import QUERIES

    fn, sql = QUERIES[name]
    verdict, rows, _, note = cmp.compare(spark, con, SF, name, fn, sql)
    assert verdict == "OK" and rows > 0, note


def test_pipeline(spark, con):
    """Quality by SQL, language by the operator, near copies and mix by hand, ids by the library."""
    sentencepiece = pytest.importorskip("sentencepiece")
    import corpus_pipeline
    from rapport.llm import op1_language, op2_quality, op4_mixing, op8_sentencepiece

    from test_llm_operators import brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r[0] for r in con.execute(op2_quality.SQL).fetchall() if r[-2]}
    kept = docs.where(F.col("doc_id").isin(sorted(good)))
    kept = {r.doc_id: r for r in op1_language.stage(spark, kept, SF).collect()}
    assert len(kept) > 100
    label = brute_components([(i, r.text) for i, r in kept.items()], 5, 80, 100)
    kept = {i: r for i, r in kept.items() if label[i] == i}
    mixed = op4_mixing.mixed(docs.where(F.col("doc_id").isin(sorted(kept))))
    copies = {r.doc_id: r.mix.copies for r in mixed.collect() if r.mix.copies}
    library = sentencepiece.SentencePieceProcessor(model_file=op8_sentencepiece.MODEL)
    want = sorted((i, kept[i].source, library.encode(kept[i].text)) for i, n in copies.items() for _ in range(n))
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.source, r.ids) for r in got.collect()) == want
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "language ID", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]


def test_stages_take_what_the_stage_before_gave(spark):
    """Each stage on awkward rows, one after the other, and on none."""
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    words = " ".join(f"word{i} text{i}" for i in range(60))
    rows = [(1, words, "en", "a", 1), (1, words, "en", "a", 1), (2, words + " x", None, None, None), (None, words, "en", "a", 1),
            (3, None, "en", "a", 0), (4, "", "en", "b", 0), (5, "Q" * 100_000, "de", "b", 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            done = stage(spark, docs, SF)
            assert name.startswith("Sentence") or done.columns == docs.columns
            docs = done
        docs.count()


def test_nothing_else_needs_this_package():
    root = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "rapport")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "rapport.llm" not in f.read(), name
