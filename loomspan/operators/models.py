"""Contracts for model-backed operators: generators, scorers and judges are injected, and run on Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

#: Texts of a batch to texts, or to numbers.
Generator = Callable[[list[str]], list[str]]
Scorer = Callable[[list[str]], list[float]]


def _apply(df: DataFrame, f: Callable, column: str, out: str, kind: t.DataType, arrow: pa.DataType) -> DataFrame:
    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(column)).to_pylist()
            yield b.append_column(out, pa.array(f([x or "" for x in texts]) if texts else [], arrow))

    return df.mapInArrow(run, t.StructType([*df.schema.fields, t.StructField(out, kind)]))


def generate(df: DataFrame, generator: Generator, prompt: str, out: str = "response") -> DataFrame:
    """Add generated texts, the echo of the prompt stripped."""
    x = _apply(df, generator, prompt, out, t.StringType(), pa.string())
    echo = F.startswith(F.col(out), F.col(prompt))
    return x.withColumn(out, F.trim(F.when(echo, F.expr(f"substring(`{out}`, length(`{prompt}`) + 1)")).otherwise(F.col(out))))


def score(df: DataFrame, scorer: Scorer, column: str, out: str = "score") -> DataFrame:
    return _apply(df, scorer, column, out, t.DoubleType(), pa.float64())


def length_reward(response: Column) -> Column:
    """The reward where there is no model: characters by 100."""
    return F.length(response) / 100


def unigram_perplexity(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, perplexity) under add-one word frequencies of the table itself: a deterministic stand-in for a language model."""
    from ..functions import text as T

    ws = df.select(F.col(id_column).alias("id"), F.explode(T.words(F.col(text_column))).alias("w"))
    counts = ws.groupBy("w").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    by = ws.groupBy("id", "w").agg(F.count("*").alias("k")).join(counts, "w").join(F.broadcast(total))
    nll = -F.ln((F.col("c") + 1) / (F.col("n") + F.col("v")))
    return by.groupBy("id").agg(F.exp(F.sum(F.col("k") * nll) / F.sum("k")).alias("perplexity"))


def perplexity(df: DataFrame, scorer: Callable[[list[list[int]]], list[list[float]]], tokenizer: Callable[[str], list[int]], column: str, out: str = "perplexity", max_tokens: int = 1024) -> DataFrame:
    """Add exp of the mean negative log-likelihood of the tokens of a text, those beyond ``max_tokens`` left out; null for a text without tokens.

    The scorer takes the token lists of a batch and gives the likelihoods of each; it may leave out the first token of a text.
    """

    def run(batches):
        for b in batches:
            ids = [tokenizer(x)[:max_tokens] if x else [] for x in b.column(b.schema.get_field_index(column)).to_pylist()]
            nll = scorer(ids) if ids else []
            yield b.append_column(out, pa.array([math.exp(sum(x) / len(x)) if len(x) else None for x in nll], pa.float64()))

    return df.mapInArrow(run, t.StructType([*df.schema.fields, t.StructField(out, t.DoubleType())]))
