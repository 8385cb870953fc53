"""Requests, candidates, scores and choices."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingloom.functions import text as X

WORST = 25.0


class Scorer(Protocol):
    """An external scorer: texts in, one number a pair out. Made once in each Python worker."""

    def score(self, sources: list[str], candidates: list[str]) -> list[float]: ...


def scorer_udf(make):
    """An Arrow-batched column function of (source, candidate) around a scorer factory; scores are kept within 0..25."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = make()
        for s, c in batches:
            yield pd.Series(scorer.score(s.tolist(), c.tolist())).clip(0.0, WORST)

    return run


class SpanScorer(Protocol):
    """An external scorer that also marks error spans: for each pair a score and a list of (start, end, severity, confidence)."""

    def score(self, sources: list[str], candidates: list[str], references: list[str]) -> list[tuple[float, list[tuple[int, int, str, float]]]]: ...


SPAN_SCORE = "struct<score:double,spans:array<struct<start:int,end:int,severity:string,confidence:double>>>"


def span_scorer_udf(make):
    """An Arrow-batched column function of (source, candidate, reference) around a span scorer; missing texts are empty."""

    @F.pandas_udf(SPAN_SCORE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for s, c, r in batches:
            found = scorer.score(s.fillna("").tolist(), c.fillna("").tolist(), r.fillna("").tolist())
            names = ("start", "end", "severity", "confidence")
            yield pd.DataFrame({"score": [float(x) for x, _ in found], "spans": [[dict(zip(names, span)) for span in spans] for _, spans in found]})

    return run


def stub_candidate(source: Column, source_id: Column, index: Column) -> Column:
    """A deterministic stand-in for a generator: the source with its words turned round from a hashed position."""
    words = F.split(source, " ")
    k = (F.conv(F.substring(F.sha2(F.concat_ws(":", source_id, index.cast("string")), 256), 1, 6), 16, 10).cast("int") % F.size(words)).cast("int")
    return F.array_join(F.concat(F.slice(words, k + 1, F.size(words)), F.slice(words, F.lit(1), k)), " ")


def request_key(model: str, messages: Column, parameters: str, index: Column) -> Column:
    """Key of one request. The candidate index is part of it, so that candidates of a source are not confused."""
    return F.sha2(F.concat_ws("\u0001", F.lit(model), messages, F.lit(parameters), index.cast("string")), 256)


def expand_candidates(sources: DataFrame, n: int, done: DataFrame | None = None) -> DataFrame:
    """Every (source, candidate_index) that is not yet done."""
    out = sources.withColumn("candidate_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out if done is None else out.join(done.select("source_id", "candidate_index").distinct(), ["source_id", "candidate_index"], "left_anti")


def prefilter_rows(sources: DataFrame, completions: DataFrame) -> DataFrame:
    """Greedy and sampled completion of each source side by side; missing texts are empty, missing scores worst.

    ``completions`` is (source_id, mode, text, score) with modes greedy and sample;
    of repeated rows the best score counts, ties by text.
    """
    wide = completions.groupBy("source_id").pivot("mode", ["greedy", "sample"]).agg(F.min_by("text", F.struct("score", "text")).alias("text"), F.min("score").alias("score"))
    j = sources.join(wide, "source_id", "left")
    g, s = (F.coalesce(f"{m}_score", F.lit(WORST)) for m in ("greedy", "sample"))
    both = F.struct(
        F.coalesce("greedy_text", F.lit("")).alias("greedy_text"), F.coalesce("sample_text", F.lit("")).alias("sample_text"), g.alias("score_greedy"), s.alias("score_sample"), (g - s).alias("improvement")
    )
    return j.select(*[j[c] for c in sources.columns], both.alias("prefilter"))


def top_sources(df: DataFrame, improvement: Column, key: str, n: int, stage: str = "prefilter") -> DataFrame:
    """The ``n`` rows of greatest improvement, ties by key, with their rank. Bounded heaps, no full sort."""
    top = df.withColumn("_i", improvement).orderBy(F.desc("_i"), key).limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc("_i"), key))  # n rows
    chosen = top.withColumn("selection", F.struct(F.lit(True).alias("selected"), rank.alias("selection_rank"), F.col("_i").alias("selection_score"), F.lit(stage).alias("selection_stage")))
    return chosen.drop("_i")


def top_per_source(df: DataFrame, score: Column, k: int, key: str = "source_id", tie: str = "candidate_index") -> DataFrame:
    """The ``k`` (at least 1) lowest-scored candidates of each source, ties to the lower index, with ``rank``."""
    w = Window.partitionBy(key).orderBy(score.asc_nulls_last(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, k))


def scored(df: DataFrame, source: str, candidate: str, out: str = "score") -> DataFrame:
    return df.withColumn(out, X.heuristic_score(F.col(source), F.col(candidate)))


def score_once(df: DataFrame, keys: list[str], score) -> DataFrame:
    """Score each distinct combination of ``keys`` once and join the result back."""
    distinct = df.select(*keys).distinct()
    named = distinct.select(*[F.col(k).alias(f"_{k}") for k in keys], score(*[F.col(k) for k in keys]).alias("score"))
    on = [df[k].eqNullSafe(named[f"_{k}"]) for k in keys]
    return df.join(named, on, "left").drop(*[f"_{k}" for k in keys])
