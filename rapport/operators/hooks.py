"""Places where the user's own models plug in; none is shipped.

A hook is a plain function over one batch. It runs inside an Arrow iterator UDF, so
a model is loaded once per Python worker. A batch that fails is halved until the rows
that fail stand alone: these give NULL, the others their result, and the job goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows that a hook is given at once.
CALL_ROWS = 64


@dataclass(frozen=True)
class Models:
    """The user's models for an import. ``embed``: texts to vectors; ``transcribe``: contents of recordings to texts."""

    embed: Callable[[list[str]], list] | None = None
    transcribe: Callable[[list[bytes]], list[str]] | None = None


def halved(fn: Callable[[list], list], rows: list) -> list:
    """``fn`` of all rows that it can be applied to; None for those that fail on their own."""
    out, waiting = [None] * len(rows), [(0, len(rows))]
    while waiting:
        first, last = waiting.pop()
        try:
            got = list(fn(rows[first:last]))
            if len(got) != last - first:
                raise ValueError("a hook gives one result a row")
            out[first:last] = got
        except Exception:
            middle = (first + last) // 2
            if last - first > 1:
                waiting += [(first, middle), (middle, last)]
    return out


def _batched(fn: Callable[[list], list], kind: T.DataType, missing: str | bytes = ""):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            rows = [missing if row is None else row for row in column]
            out: list = []
            for first in range(0, len(rows), CALL_ROWS):
                out += halved(fn, rows[first:first + CALL_ROWS])
            yield pd.Series(out, index=column.index, dtype="object")

    return run


def embed(df: DataFrame, text: str, fn: Callable[[list[str]], list], out: str = "embedding") -> DataFrame:
    """Adds ``fn``'s vectors; rows that fail keep a NULL vector."""
    return df.withColumn(out, _batched(fn, T.ArrayType(T.FloatType()))(F.col(text)))


def map_prompts(df: DataFrame, prompt: str, fn: Callable[[list[str]], list[str]], out: str = "answer") -> DataFrame:
    """Adds ``fn``'s answer to every prompt."""
    return df.withColumn(out, _batched(fn, T.StringType())(F.col(prompt)))


def transcribe(media: DataFrame, fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """Adds a transcript and a processing status to recordings that have none yet."""
    written = _batched(fn, T.StringType())(F.col("path"))
    out = media.withColumn("transcript", F.coalesce(F.col("transcript"), written)
                           if "transcript" in media.columns else written)
    done = F.coalesce(F.col("transcript"), F.lit("")) != ""
    return out.withColumn("processing_status", F.when(done, "COMPLETED").otherwise("FAILED"))


def spoken(recordings: DataFrame, fn: Callable[[list[bytes]], list[str]], out: str = "transcript") -> DataFrame:
    """Adds what is said in recordings, from their ``content``; NULL where nothing was understood."""
    return recordings.withColumn(out, F.nullif(_batched(fn, T.StringType(), b"")(F.col("content")), F.lit("")))


def hash_embedder(texts: list[str], dims: int = 16) -> list[list[float]]:
    """Deterministic stand-in for an embedding model: one SHA-256 byte per dimension."""
    def value(i: int, text: str) -> float:
        return hashlib.sha256(f"{i}:{text}".encode()).digest()[0] / 255.0 * 2.0 - 1.0

    return [[value(i, text) for i in range(dims)] for text in texts]


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_parser(extension: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Register a parser for an extension: files (path, text, content) to messages."""
    PARSERS[extension.lower()] = fn


def unit_vector(c: Column) -> Column:
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))
