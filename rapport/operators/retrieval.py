"""Keyword (BM25), vector (cosine) and hybrid retrieval for tables of questions.

A question table has ``qid`` and ``question`` (and ``query_vec`` for vectors),
plus optional filter columns ``person_id``, ``source``, ``kind`` and ``after``;
a NULL filter does not restrict. A corpus has ``id``, ``text`` and optionally
``summary``, ``topics``, ``person_id``, ``source``, ``kind``, ``occurred_at`` and
``embedding``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rapport import constants as K
from rapport.functions.evidence import evidence_entry, matched_by
from rapport.functions.text import strip, trim_at_word
from rapport.functions.topics import content_terms, run_count, run_word, runs, stem, words
from rapport.operators.ranking import top_per_group
from rapport.session import at_most

FILTERS = ("person_id", "source", "kind")
# Question tables up to this many rows travel to the corpus; larger ones are
# matched block against block.
QUESTION_BLOCK = 2048
CORPUS_BLOCK = 8192
# (question, term) rows up to this many are broadcast: about ten megabytes.
BROADCAST_TERMS = 200_000
# Tokens of the corpus behind one task of the scoring: a few thousand memories, whatever the questions match.
TASK_TOKENS = 1_000_000


# -- index ----------------------------------------------------------------------

def index_text(corpus: DataFrame) -> Column:
    """What is searchable of a memory: text, summary and topics."""
    parts = [F.col("text")]
    if "summary" in corpus.columns:
        parts.append(F.col("summary"))
    if "topics" in corpus.columns:
        parts.append(F.array_join("topics", " "))
    return F.concat_ws(" ", *parts)


def postings(corpus: DataFrame) -> DataFrame:
    """(id, term, tf, doc_len, filter columns...): the inverted index.

    Counting happens inside each row (equal tokens are adjacent once sorted), so
    building it needs no shuffle at all. (``explode_outer`` with a filter after it:
    for a plain ``explode`` Spark adds a size test below it and computes the tokens
    twice.)
    """
    kept = [c for c in (*FILTERS, "occurred_at") if c in corpus.columns]
    tokens = F.transform(words(index_text(corpus)), stem)
    return (corpus.select("id", *kept, tokens.alias("_tokens"))
            .select("id", *kept, F.size("_tokens").alias("doc_len"), F.explode_outer(runs(F.col("_tokens"))).alias("_run"))
            .where("_run IS NOT NULL")
            .select("id", run_word(F.col("_run")).alias("term"), run_count(F.col("_run")).alias("tf"),
                    F.col("doc_len").cast("bigint").alias("doc_len"), *kept))


def corpus_size(corpus: DataFrame) -> DataFrame:
    """One row: number of memories and their mean length in tokens."""
    return corpus.select(F.size(words(index_text(corpus))).alias("doc_len")).agg(
        F.count("*").alias("docs"), F.avg("doc_len").alias("avg_len"))


def write_index(corpus: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store postings clustered by term and the corpus size beside them."""
    rows = postings(corpus)
    rows = rows.repartitionByRange(partitions, "term", "id") if partitions else \
        rows.repartitionByRange("term", "id")
    rows.sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    corpus_size(corpus).coalesce(1).write.mode("overwrite").parquet(f"{path}/size")


def read_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/size")


# -- keyword branch -----------------------------------------------------------------

def question_terms(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.explode(content_terms(F.col("question"))).alias("term"))


def _passes(questions: DataFrame, corpus_columns: list[str], prefix: str = "q_") -> Column:
    """Per-question filters as a predicate over columns renamed with ``prefix``."""
    parts = [F.col(prefix + c).isNull() | (F.col(c) == F.col(prefix + c))
             for c in FILTERS if c in questions.columns and c in corpus_columns]
    if "after" in questions.columns and "occurred_at" in corpus_columns:
        parts.append(F.col(prefix + "after").isNull() | (F.col("occurred_at") >= F.col(prefix + "after")))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _filter_columns(questions: DataFrame, prefix: str = "q_") -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in (*FILTERS, "after") if c in questions.columns]


def keyword_scores(questions: DataFrame, corpus: DataFrame, index: DataFrame | None = None,
                   size: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(qid, id, score) for every memory sharing a term with the question.

    Only postings of asked terms leave the scan. They are shuffled once, by
    memory, and every later step up to the per-memory sum keeps that
    partitioning when the question terms are small enough for Spark to
    broadcast; corpus statistics stay global whatever the filters say. The number of
    partitions follows the corpus: a posting meets every question that asks for its term, so
    partitions put together for their small size before that would grow without bound.
    ``counts`` (term, df) saves counting the postings when an index has kept them.
    """
    index = postings(corpus) if index is None else index
    terms = question_terms(questions)
    # Few question terms (checked) are broadcast; more are joined as Spark sees fit.
    small = at_most(terms, BROADCAST_TERMS)
    ship = F.broadcast if small else (lambda df: df)
    of_corpus = (corpus_size(corpus) if size is None else size).select("docs", "avg_len").first()
    docs, avg_len = F.lit(of_corpus.docs), F.lit(of_corpus.avg_len).cast("double")
    parts = max(int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                -(-int(of_corpus.docs * (of_corpus.avg_len or 0)) // TASK_TOKENS))
    # One exchange by memory feeds the scores and, without ``counts``, the document frequencies.
    asked = index.join(ship(terms.select("term").distinct()), "term", "left_semi").repartition(parts, "id")
    df = asked.groupBy("term").agg(F.count("*").alias("df")) if counts is None else counts
    idf = F.log(F.lit(1.0) + (docs - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    weighted = terms.join(df, "term").select("qid", "term", idf.alias("idf"))
    filters = questions.select("qid", *_filter_columns(questions))
    if len(filters.columns) > 1:
        weighted = weighted.join(filters, "qid")
    hits = asked.join(ship(weighted), "term").where(_passes(questions, index.columns))
    norm = F.col("tf") + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * F.col("doc_len") / avg_len)
    part = F.col("idf") * F.col("tf") * (K.BM25_K1 + 1) / norm
    # Fixed-point partial scores make the sum independent of the order of rows.
    exact = F.sum(F.round(part * F.lit(1e12)).cast("bigint"))
    return hits.groupBy("id", "qid").agg((exact.cast("double") / F.lit(1e12)).alias("score"))


def keyword_search(questions: DataFrame, corpus: DataFrame, k: int = 12,
                   index: DataFrame | None = None, size: DataFrame | None = None,
                   counts: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank): the k best memories per question."""
    scores = keyword_scores(questions, corpus, index, size, counts)
    rounded = scores.withColumn("score", F.round("score", 6))
    return top_per_group(rounded, ["qid"], [F.desc("score"), F.asc("id")], k).select(
        "qid", "id", "score", "rank")


def _trigrams(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def substring_search(questions: DataFrame, corpus: DataFrame, k: int = 12) -> DataFrame:
    """Memories whose text contains a term of the question anywhere (also inside
    words), ranked 1, 1/2, 1/3, ... by id.

    A term holds word characters only, so it lies inside one word of the text.
    Terms meet the distinct words of the corpus on character trigrams (a word that
    contains the term contains the term's rarest trigram; a containment test
    settles the rest), and the words found lead back to the memories. No cross
    join, and the vocabulary grows far slower than the corpus.
    """
    terms = question_terms(questions)
    needles = terms.select("term").distinct().where(F.length("term") >= 3)
    kept = [c for c in (*FILTERS, "occurred_at") if c in corpus.columns]
    held = corpus.select("id", *kept, F.explode_outer(F.array_distinct(words(index_text(corpus)))).alias("word")
                         ).where("word IS NOT NULL")
    grams = (held.select("word").distinct()
             .select("word", F.explode(_trigrams(F.col("word"))).alias("gram")))
    asked_grams = needles.select("term", F.explode(_trigrams(F.col("term"))).alias("gram"))
    common = (grams.join(asked_grams.select("gram").distinct(), "gram", "left_semi")
              .groupBy("gram").agg(F.count("*").alias("n")))
    rarest = (asked_grams.join(common, "gram")
              .groupBy("term").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")))
    found = (grams.join(rarest, "gram").where(F.contains("word", F.col("term"))).select("word", "term"))
    asked = found.join(terms, "term").select("word", "qid").distinct()
    filters = questions.select("qid", *_filter_columns(questions))
    pairs = (held.join(asked, "word").join(filters, "qid")
             .where(_passes(questions, corpus.columns)).select("qid", "id").distinct())
    ranked = top_per_group(pairs, ["qid"], [F.asc("id")], k)
    return ranked.select("qid", "id", F.round(1.0 / F.col("rank"), 6).alias("score"), "rank")


def keyword_search_with_fallback(questions: DataFrame, corpus: DataFrame, k: int = 12) -> DataFrame:
    """Keyword search; questions without a single hit fall back to substrings."""
    hits = keyword_search(questions, corpus, k)
    missed = questions.join(hits.select("qid").distinct(), "qid", "left_anti")
    return hits.unionByName(substring_search(missed, corpus, k))


# -- vector branch --------------------------------------------------------------------

_HIT = T.StructType([T.StructField("qid", T.LongType()), T.StructField("id", T.StringType()),
                     T.StructField("score", T.DoubleType())])


def _matrix(vectors) -> np.ndarray:
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return m / norms


def _score_block(questions: pd.DataFrame, block: pd.DataFrame, k: int, rules: list[tuple[str, str]]):
    """The k best rows of one block for every question; the only Python in the
    vector branch: one matrix product and a partial sort."""
    if questions.empty or block.empty:
        return pd.DataFrame({"qid": [], "id": [], "score": []})
    scores = np.round(_matrix(questions["query_vec"]) @ _matrix(block["embedding"]).T, 6)
    ids = block["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    columns = {name: block[name].to_numpy() for name, _ in rules if name in block}
    qids, hit_ids, hit_scores = [], [], []
    for row, (_, question) in zip(scores, questions.iterrows()):
        allowed = np.ones(len(ids), dtype=bool)
        for name, rule in rules:
            wanted = question["q_" + ("after" if rule == "after" else name)]
            if pd.isna(wanted):
                continue
            allowed &= (columns[name] >= np.datetime64(wanted)) if rule == "after" \
                else (columns[name] == wanted)
        ranked = order[np.argsort(-row[order], kind="stable")]
        best = ranked[allowed[ranked]][:k]
        qids.extend([question["qid"]] * len(best))
        hit_ids.extend(ids[best])
        hit_scores.extend(row[best])
    return pd.DataFrame({"qid": np.array(qids, dtype="int64"), "id": hit_ids,
                         "score": np.array(hit_scores, dtype="float64")})


def vector_search(questions: DataFrame, corpus: DataFrame, k: int = 12,
                  question_block: int = QUESTION_BLOCK, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """(qid, id, score, rank): exact cosine top-k over all rows that pass the filters.

    Up to ``question_block`` questions (checked) are shipped to the corpus
    partitions, which are scanned in place: no corpus row is shuffled, only k
    candidates per partition and question. More questions than that are cut into
    blocks, the corpus likewise, and block meets block on an equi-key, each pair
    in a task of bounded size. Both ways are exact.
    """
    rules = [(c, "equal") for c in FILTERS if c in questions.columns and c in corpus.columns]
    if "after" in questions.columns and "occurred_at" in corpus.columns:
        rules.append(("occurred_at", "after"))
    kept = [name for name, _ in rules]
    asked = questions.where(F.col("query_vec").isNotNull()).select(
        F.col("qid").cast("bigint").alias("qid"), "query_vec", *_filter_columns(questions))
    rows = corpus.where(F.col("embedding").isNotNull()).select("id", "embedding", *kept)
    small = asked.limit(question_block + 1).toPandas()
    if len(small) <= question_block:
        shared = corpus.sparkSession.sparkContext.broadcast(small)

        def scan(batches):
            best = None                     # the partition's k best per question so far
            for block in batches:
                hits = _score_block(shared.value, block, k, rules)
                best = hits if best is None else pd.concat([best, hits])
                best = best.sort_values(["qid", "score", "id"], ascending=[True, False, True]).groupby("qid").head(k)
            if best is not None:
                yield best

        hits = rows.mapInPandas(scan, _HIT)
    else:
        hits = _block_join(asked, rows, k, rules, question_block, corpus_block)
    return top_per_group(hits, ["qid"], [F.desc("score"), F.asc("id")], k)


def _block_join(asked: DataFrame, rows: DataFrame, k: int, rules, question_block: int,
                corpus_block: int) -> DataFrame:
    q_blocks = -(-asked.count() // question_block)
    c_blocks = max(1, -(-rows.count() // corpus_block))

    def block_of(column: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")

    left = (asked.withColumn("qb", block_of("qid", q_blocks))
            .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))))
    right = (rows.withColumn("cb", block_of("id", c_blocks))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))
    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(
        lambda q, c: _score_block(q, c, k, rules), _HIT)


# -- fusion and evidence -----------------------------------------------------------------

def fuse(vector: DataFrame, keyword: DataFrame, method: str = "rank_norm") -> DataFrame:
    """(qid, id, score, vector_rank, keyword_rank), best first by (score, id).

    'rank_norm': weight x (1 - rank / list length) per branch; 'rrf':
    1 / (60 + rank). Ranks are reported from zero.
    """
    def branch(hits: DataFrame, name: str, weight: float) -> DataFrame:
        length = F.count("*").over(Window.partitionBy("qid"))      # the k rows of a question
        score = (F.lit(weight) * (1 - (F.col("rank") - 1) / length) if method == "rank_norm"
                 else 1 / (F.lit(K.RRF_K) + F.col("rank")))
        return hits.select(
            "qid", "id", score.alias(f"{name}_score"), (F.col("rank") - 1).alias(f"{name}_rank"))

    if method not in ("rank_norm", "rrf"):
        raise ValueError(f"unknown fusion {method!r}")
    both = branch(vector, "vector", K.VECTOR_WEIGHT).join(
        branch(keyword, "keyword", K.KEYWORD_WEIGHT), ["qid", "id"], "full_outer")
    total = F.coalesce("vector_score", F.lit(0.0)) + F.coalesce("keyword_score", F.lit(0.0))
    return both.select("qid", "id", F.round(total, 6).alias("score"), "vector_rank", "keyword_rank")


def hybrid_search(questions: DataFrame, corpus: DataFrame, k: int = 10, method: str = "rank_norm",
                  fallback: bool = False) -> DataFrame:
    """Both branches fused. Candidates per branch: 2k each for 'rank_norm',
    5k vector and 3k keyword for 'rrf'."""
    n_vector, n_keyword = (2 * k, 2 * k) if method == "rank_norm" else (5 * k, 3 * k)
    search = keyword_search_with_fallback if fallback else keyword_search
    return fuse(vector_search(questions, corpus, n_vector), search(questions, corpus, n_keyword), method)


def pick_within_budget(candidates: Column, k: int, total_chars: int) -> Column:
    """Fold over ranked candidates (structs with ``text``): take what still fits,
    skip what does not, always take the first, stop at k."""
    kind = "array<struct<item:bigint,used:bigint>>"

    def step(taken: Column, item: Column) -> Column:
        used = F.coalesce(F.try_element_at(taken, F.lit(-1))["used"], F.lit(0).cast("bigint"))
        size = F.length(item["text"]).cast("bigint")
        fits = F.lit(total_chars <= 0) | (used + size <= total_chars) | (F.size(taken) == 0)
        entry = F.array(F.struct(item["rank"].cast("bigint").alias("item"), (used + size).alias("used")))
        return F.when((F.size(taken) < k) & fits & (size > 0), F.concat(taken, entry)).otherwise(taken)

    return F.transform(F.aggregate(candidates, F.array().cast(kind), step), lambda s: s["item"])


def evidence(fused: DataFrame, corpus: DataFrame, budget=K.BUDGET_SEARCH,
             people: DataFrame | None = None) -> DataFrame:
    """The evidence set per question: rows labelled S1..Sk, trimmed, inside the
    character budget. The fold is over a question's fused candidates, which the
    searches before it bound (4k, or 8k for 'rrf')."""
    k, snippet_chars, total_chars = budget
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    ranked = fused.withColumn("rank", F.row_number().over(best))
    summary = F.col("summary") if "summary" in corpus.columns else F.lit(None).cast("string")
    text = strip(F.coalesce(F.nullif(summary, F.lit("")), F.col("text"), F.lit("")))
    meta = [c for c in ("person_id", "source", "kind", "occurred_at", "citation", "record_id")
            if c in corpus.columns]
    snippets = ranked.join(corpus.select("id", trim_at_word(text, snippet_chars).alias("text"), *meta), "id")
    # A question's candidates are few; they are folded whole, so nothing is joined back.
    rest = [c for c in snippets.columns if c not in ("qid", "rank", "text")]
    folded = snippets.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text", *rest))).alias("_all"))
    folded = folded.withColumn("_items", pick_within_budget(F.col("_all"), k, total_chars))
    picked = F.filter("_all", lambda c: F.array_contains("_items", c["rank"].cast("bigint")))
    out = folded.select("qid", F.posexplode(picked).alias("_pos", "_c")).select("qid", "_pos", "_c.*")
    out = (out.withColumn("label", F.concat(F.lit("S"), (F.col("_pos") + 1).cast("string")))
           .withColumn("matched_by", matched_by(F.col("vector_rank"), F.col("keyword_rank")))
           .withColumn("position", F.col("_pos") + 1))
    if people is not None:
        out = out.join(people.select("person_id", F.col("display_name").alias("person_name")),
                       "person_id", "left")
    return out.drop("_pos", "rank")


def evidence_block(rows: DataFrame) -> DataFrame:
    """(qid, evidence): the labelled, quoted block handed to a language model."""
    name = F.col("person_name") if "person_name" in rows.columns else F.lit(None).cast("string")
    entry = evidence_entry(F.col("label"), F.col("source"), F.col("kind"), F.col("occurred_at"),
                           name, F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("position"), entry.alias("entry"))))
    return rows.groupBy("qid").agg(
        F.array_join(F.transform(parts, lambda s: s["entry"]), "\n\n").alias("evidence"))


def search(questions: DataFrame, corpus: DataFrame, limit: int = 20, snippet: int = 400,
           method: str = "rank_norm") -> DataFrame:
    """Global or filtered search: labelled results with a short snippet."""
    rows = evidence(hybrid_search(questions, corpus, limit, method), corpus, (limit, 900, 0))
    return rows.withColumn("snippet", F.substring("text", 1, snippet)).drop("text")
