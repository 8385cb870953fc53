"""Uniform samples of fixed size from data that arrives in pieces, without a count beforehand.

The records are numbered 0..N-1 through partition offsets. A seeded Feistel
network with cycle walking permutes the numbers, and a record is drawn if its
permuted number is below k. The records of a draw are therefore the images of
0..k-1 under the inverse permutation, which is computed for those k only and
joined. Each draw has exactly min(k, N) records, each equally likely, and does
not depend on the order or number of partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingloom.session import materialize


@dataclass(frozen=True)
class FixedSampleConfig:
    """rounds: of the Feistel network. bucket_rows: records numbered in one group, about; a piece with more is split.
    part: positions of a draw that are computed at once."""

    rounds: int = 6
    bucket_rows: int = 50_000
    part: int = 10_000


_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed multipliers of a public hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permute(position: np.ndarray, n: int, seed: int, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """The image of each of 0..n-1 under a permutation of 0..n-1 chosen by ``seed``, or under its inverse."""
    if n <= 1:
        return position.astype(np.uint64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    with np.errstate(over="ignore"):
        keys = _mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _mix(np.array([seed & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)))

        def once(x: np.ndarray) -> np.ndarray:
            left, right = x >> shift, x & low
            for k in keys:
                left, right = right, left ^ (_mix(right + k) & low)
            return (left << shift) | right

        def back(x: np.ndarray) -> np.ndarray:
            left, right = x >> shift, x & low
            for k in keys[::-1]:
                left, right = right ^ (_mix(left + k) & low), left
            return (left << shift) | right

        step = back if inverse else once
        out = step(position.astype(np.uint64))
        outside = np.flatnonzero(out >= n)  # the network permutes a power of four; walk until back inside
        while len(outside):
            out[outside] = step(out[outside])
            outside = outside[out[outside] >= n]
    return out


def number_densely(df: DataFrame, key: str, piece: str, config: FixedSampleConfig = FixedSampleConfig()) -> tuple[DataFrame, int]:
    """(key, position) with positions 0..N-1 over the distinct keys, and N.

    A key that arrives in several pieces belongs to the first. The bucket of a
    key is a function of piece and key, so a lost partition gets the same
    numbers again. A piece has as many buckets as its size asks for.
    """
    first = materialize(df.groupBy(F.col(key).alias("key")).agg(F.min(F.coalesce(F.col(piece).cast("long"), F.lit(-1))).alias("piece")))
    n = first.count()
    # hash buckets over all pieces, and by piece inside: each group has bucket_rows records or fewer
    buckets = max(1, math.ceil(n / config.bucket_rows))
    placed = first.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    counts = placed.groupBy("bucket", "piece").count()
    # offsets in two levels, so that no single task adds up all groups
    per_bucket = counts.groupBy("bucket").agg(F.sum("count").alias("_n")).withColumn("_level", F.floor(F.col("bucket") / max(1, math.isqrt(buckets))))
    per_level = per_bucket.groupBy("_level").agg(F.sum("_n").alias("_m"))
    before = lambda value, w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = per_level.select("_level", before("_m", Window.orderBy("_level")).alias("_from"))  # the square root of the buckets
    starts = per_bucket.withColumn("_in_level", before("_n", Window.partitionBy("_level").orderBy("bucket"))).join(levels, "_level").select("bucket", (F.col("_from") + F.col("_in_level")).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("piece", "key")) - 1
    numbered = placed.withColumn("_rank", rank).join(starts, "bucket")
    return numbered.select("key", (F.col("_start") + F.col("_rank")).cast("long").alias("position")), n


def drawn_positions(draws: DataFrame, n: int, config: FixedSampleConfig = FixedSampleConfig()) -> DataFrame:
    """(draw_id, position): for each draw the min(k, n) positions that its permutation sends below k.

    A draw is cut into parts, so that neither a long one nor many stay in one task.
    """
    rows = draws.select("draw_id", F.coalesce(F.col("draw_seed").cast("long"), F.lit(0)).alias("seed"), F.least(F.coalesce(F.col("sample_size").cast("long"), F.lit(0)), F.lit(n)).alias("k")).where("k > 0")
    parts = rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1, F.lit(config.part).cast("long")))).repartition("draw_id", "at")
    rounds, part = config.rounds, config.part

    def run(batches):
        for pdf in batches:
            for draw_id, seed, k, at in zip(pdf["draw_id"], pdf["seed"], pdf["k"], pdf["at"]):
                image = np.arange(at, min(k, at + part), dtype=np.uint64)
                yield pd.DataFrame({"draw_id": draw_id, "position": permute(image, n, int(seed), rounds, inverse=True).astype(np.int64)})

    return parts.mapInPandas(run, f"draw_id {draws.schema['draw_id'].dataType.simpleString()}, position long")


def fixed_size_samples(df: DataFrame, draws: DataFrame, key: str, piece: str, config: FixedSampleConfig = FixedSampleConfig()) -> DataFrame:
    """(draw_id, key) for each row of ``draws`` (draw_id, draw_seed, sample_size).

    Repeated keys count once; a null key is a key; a null piece comes first. A
    size over N takes all, a null, zero or negative size takes none, an empty
    table gives no rows.
    """
    numbered, n = number_densely(df, key, piece, config)
    return drawn_positions(draws, n, config).join(numbered, "position").select("draw_id", "key")
