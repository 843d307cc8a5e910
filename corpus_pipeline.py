"""Documents to training shards: quality rules, language, near copies, source mix, SentencePiece ids.

Each stage works on all that the stage before kept; between stages the documents are a Parquet table in the folder that
``spark.checkpoint.dir`` names. The quality rules and the language stage drop documents, the join keeps one document of
each group of near copies (five words, similarity 0.8), the mix drops and repeats documents, and the last stage gives ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rapport.llm import op1_language, op2_quality, op4_mixing, op8_sentencepiece, op10_ngram_join
from rapport.llm.shared import staged

STAGES = [
    ("quality rules", op2_quality.stage),
    ("language ID", op1_language.stage),
    ("n-gram Jaccard join", op10_ngram_join.stage),
    ("mixing sources to target weights", op4_mixing.stage),
    ("SentencePiece encoding and decoding", op8_sentencepiece.stage),
]

#: Language identification and SentencePiece cannot be said in SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
