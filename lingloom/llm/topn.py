"""The N best items of every group, with a fixed tie rule, by a hot-cold split.

Exact row counts of the groups are taken first. Heavy groups are sorted by
salted ranges: their rows are spread over range partitions of (group, score,
tie, salt), each partition keeps its own N best, and only those meet again.
Light groups go through an ordinary window, whose group limit also runs before
the shuffle. Both parts are united.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TopNConfig:
    """heavy_rows: rows from which a group counts as heavy. heavy_groups: bound of the broadcast list of
    heavy groups; if there are more, the largest are split and no other can dominate. ranges: range
    partitions of the heavy rows, None for the session's shuffle partitions."""

    heavy_rows: int = 20_000
    heavy_groups: int = 10_000
    ranges: int | None = None


def _best(df: DataFrame, keys: list[Column], order: list[Column], n: int) -> DataFrame:
    # dense_rank: replayed rows share a rank and take no place from others
    ranked = df.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def top_n(df: DataFrame, group: str, score: Column, tie: Column, n: int, config: TopNConfig = TopNConfig()) -> DataFrame:
    """The ``n`` rows with the lowest ``score`` of each value of ``group``: columns group, score, tie.

    Ties go to the lower ``tie``. Null and NaN scores take no part; a null group
    is a group; a null tie comes last. Rows repeated with equal (group, score,
    tie) count once. An empty table gives an empty result.
    """
    score = score.cast("double")
    rows = df.select(F.col(group).alias("group"), score.alias("score"), tie.alias("tie")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    counts = rows.groupBy("group").count().where(F.col("count") > config.heavy_rows)
    heavy_keys = [r["group"] for r in counts.orderBy(F.desc("count")).limit(config.heavy_groups).collect()]
    order = [F.asc("score"), F.asc_nulls_last("tie")]
    if not heavy_keys:
        return _best(rows, [F.col("group")], order, n).distinct()
    spark = df.sparkSession
    listed = spark.createDataFrame([(k,) for k in heavy_keys], rows.select("group").withColumnRenamed("group", "_key").schema)
    on = rows["group"].eqNullSafe(listed["_key"])
    light = _best(rows.join(F.broadcast(listed), on, "left_anti"), [F.col("group")], order, n)
    # replays are merged on the map side before anything of a heavy group moves
    heavy = rows.join(F.broadcast(listed), on, "left_semi").distinct().withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    ranges = config.ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = heavy.repartitionByRange(ranges, "group", "score", "tie", "_salt").drop("_salt").withColumn("_range", F.spark_partition_id())
    local = _best(spread, [F.col("group"), F.col("_range")], order, n).drop("_range").distinct()
    return light.unionByName(_best(local, [F.col("group")], order, n)).distinct()
