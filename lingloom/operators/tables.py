"""Keyed tables that replace caches and progress stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(table: DataFrame, keys: list[str], at: str, tie: list[str] | None = None) -> DataFrame:
    """The newest row of each key; ties by ``tie``, else by a hash of the whole row. Rows of a key are merged before the shuffle by the window's group limit."""
    order = [F.desc(at), *([F.asc(t) for t in tie] if tie else [F.xxhash64(*table.columns)])]
    return table.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    return latest(table.unionByName(rows, allowMissingColumns=True), keys, at)


def hits(df: DataFrame, cache: DataFrame, keys: list[str], usable: Column | None = None) -> DataFrame:
    return df.join(cache if usable is None else cache.where(usable), keys)


def misses(df: DataFrame, cache: DataFrame, keys: list[str], usable: Column | None = None) -> DataFrame:
    """Rows without a usable entry; an entry that fails ``usable`` (say, a blank text) counts as none."""
    return df.join((cache if usable is None else cache.where(usable)).select(*keys), keys, "left_anti")


def pending(df: DataFrame, progress: DataFrame, stage: str, key: str, output_exists: bool = True) -> DataFrame:
    """Items not yet done in ``stage`` (stage_name, item_id); without an output everything is to be done again."""
    if not output_exists:
        return df
    done = progress.where(F.col("stage_name") == stage).select(F.col("item_id").alias("_id"))
    return df.join(done, df[key].cast("string") == done["_id"].cast("string"), "left_anti")


def progress_counts(progress: DataFrame) -> DataFrame:
    return progress.groupBy("stage_name").agg(F.count_distinct("item_id").alias("n"))
