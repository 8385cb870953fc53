"""Length buckets, quotas, seeded sampling, splits and batches. Every random choice is a keyed hash."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingloom.functions.text import let
from lingloom.session import materialize

# Default bounds of the length buckets.
BOUNDARIES = [0, 10, 20, 40, 80, 120, 200, 400, 800, 999999]


def bucket_of(length: Column, boundaries: list[int] = BOUNDARIES) -> Column:
    """Index of the half-open interval; anything outside all of them is in the last."""
    if len(boundaries) < 2:
        return F.lit(0)

    def of(n: Column) -> Column:
        out = None
        for k in range(len(boundaries) - 1):
            hit = (n >= boundaries[k]) & (n < boundaries[k + 1])
            out = F.when(hit, k) if out is None else out.when(hit, k)
        return out.otherwise(len(boundaries) - 2)

    return let(length, of)  # a measured length is measured once, not once a bound


def quotas(size: int, buckets: int) -> list[int]:
    """Equal shares; the first buckets get what is left over."""
    share, rest = divmod(size, buckets)
    return [share + (k < rest) for k in range(buckets)]


def capacities(wanted: list[int], oversample: float) -> list[int]:
    return [max(q, int(q * max(1.0, oversample))) for q in wanted]


def can_fill(counts: dict[int, int], wanted: list[int], capacity: list[int], size: int) -> tuple[int, bool]:
    """(buffered, whether quotas plus extras reach the size)."""
    kept = [min(counts.get(k, 0), c) for k, c in enumerate(capacity)]
    base = sum(min(k, q) for k, q in zip(kept, wanted))
    return sum(kept), base + sum(max(0, k - q) for k, q in zip(kept, wanted)) >= size


def order_key(seed: int, salt: str, key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), key.cast("string")), 256)


@dataclass(frozen=True)
class BalancedConfig:
    size: int = 300
    seed: int = 7
    oversample: float = 2.0
    boundaries: tuple[int, ...] = tuple(BOUNDARIES)
    most_in_heap: int = 10_000  # larger samples are cut by a histogram, not by heaps of whole rows


def balanced_sample(df: DataFrame, key: str, bucket: Column, config: BalancedConfig = BalancedConfig(), salt: str = "") -> DataFrame:
    """A sample with equal shares of the buckets, deficits filled from the extras of others.

    The reservoir of a bucket is its lowest hashes: the same distribution as a
    one-pass reservoir, but reproducible. A histogram of the hashes' first digits
    tells below which digits a bucket's reservoir lies, so that only about
    ``oversample * size`` rows are shuffled and ranked, however many there are.
    """
    buckets = max(1, len(config.boundaries) - 1)
    wanted = quotas(config.size, buckets)
    room = capacities(wanted, config.oversample)
    rows = df.withColumn("_b", bucket).withColumn("_h", order_key(config.seed, f"{salt}keep", F.col(key)))
    cap, quota = (F.array(*[F.lit(x) for x in v]) for v in (room, wanted))
    digits = F.substring("_h", 1, 4)
    bins = rows.groupBy("_b", digits.alias("_d")).count()  # at most 65,536 a bucket
    upto = F.sum("count").over(Window.partitionBy("_b").orderBy("_d"))
    reached = F.when(F.col("_n") >= F.get(cap, F.col("_b")), F.col("_d"))
    cuts = bins.withColumn("_n", upto).groupBy("_b").agg(F.min(reached).alias("_d"), F.sum("count").alias("_n")).collect()
    by_bucket = {r["_b"]: r["_d"] for r in cuts if r["_d"] is not None}
    last = F.array(*[F.lit(by_bucket.get(k, "ffff")) for k in range(buckets)])
    ranked = rows.where(digits <= F.get(last, F.col("_b"))).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    kept = ranked.where(F.col("_r") <= F.get(cap, F.col("_b"))).withColumn("_extra", F.col("_r") > F.get(quota, F.col("_b")))
    # extras come after all quotas, in an order of their own
    first = kept.withColumn("_h2", order_key(config.seed, f"{salt}fill", F.col(key)))
    base = sum(min(r["_n"], wanted[r["_b"]]) for r in cuts)
    extras = sum(min(r["_n"], room[r["_b"]]) for r in cuts) - base
    if extras <= config.size - base:
        out = first
    elif config.size <= config.most_in_heap:
        out = first.orderBy("_extra", "_h2", key).limit(config.size)
    else:
        out = lowest_extras(materialize(first), key, config.size - base)
    return out.drop("_h", "_h2", "_r", "_extra", "_b")


DIGITS = 3  # hexadecimal digits looked at in one step: 4096 groups


@dataclass(frozen=True)
class Cut:
    """Where the ``k`` lowest of a column of hexadecimal hashes end: all below ``digits``, and ``rest`` of those that begin with it."""

    digits: str
    rest: int


def find_cut(hashes: DataFrame, column: str, k: int, edge: int = 50_000) -> Cut | None:
    """The cut below the ``k`` lowest hashes; None for all of them.

    Digits are added until the group that the cut falls into has ``edge`` rows
    or fewer, so what has to be ranked does not grow with the table. Each step is
    one count of 4096 groups.
    """
    prefix, rest = "", k
    while True:
        n = len(prefix)
        rows = hashes.where(F.col(column).startswith(prefix)) if prefix else hashes
        groups = sorted((r["_d"], r["count"]) for r in rows.groupBy(F.substring(column, 1, n + DIGITS).alias("_d")).count().collect())
        below = 0
        for d, count in groups:
            if below + count >= rest:
                break
            below += count
        else:
            return None
        prefix, rest = d, rest - below
        if count <= edge or len(prefix) + DIGITS > 64:
            return Cut(prefix, rest)


def lowest_extras(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The rows that are no ``_extra``, and the ``k`` of the extras with the lowest ``_h2``; only the group at the cut is ranked."""
    cut = find_cut(rows.where("_extra").select("_h2"), "_h2", k) if k > 0 else Cut("", 0)
    if cut is None:
        return rows
    d = F.substring("_h2", 1, len(cut.digits))
    edge = rows.where(F.col("_extra") & (d == cut.digits)).withColumn("_n", F.row_number().over(Window.orderBy("_h2", key)))
    return rows.where(~F.col("_extra") | (d < cut.digits)).unionByName(edge.where(F.col("_n") <= cut.rest).drop("_n"))


def bucket_stats(df: DataFrame, bucket: Column, config: BalancedConfig = BalancedConfig()) -> DataFrame:
    """Rows seen and quota kept by bucket; deficit fill is not counted."""
    wanted = quotas(config.size, max(1, len(config.boundaries) - 1))
    seen = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("seen"))
    return seen.select("bucket", "seen", F.least(F.col("seen"), F.get(F.array(*[F.lit(x) for x in wanted]), F.col("bucket"))).cast("long").alias("kept"))


def pool_mix(segs: DataFrame, blobs: DataFrame | None, size: int, sentence_ratio: float, config: BalancedConfig, key: str = "source_id") -> DataFrame:
    """Sentences and blobs by ratio; without blobs all are sentences. Seeds are s and s + 1."""
    n = size if blobs is None else int(size * sentence_ratio)
    bucket = lambda: bucket_of(F.col("length_approx"), list(config.boundaries))
    out = balanced_sample(segs, key, bucket(), BalancedConfig(n, config.seed, config.oversample, config.boundaries))
    if blobs is not None and size > n:
        out = out.unionByName(balanced_sample(blobs, key, bucket(), BalancedConfig(size - n, config.seed + 1, config.oversample, config.boundaries)), allowMissingColumns=True)
    return out


def eval_size(n: int, ratio: float) -> int:
    """Rows of the evaluation part: half-even rounding, at least 1 and less than all."""
    return 0 if n <= 1 else max(1, min(n - 1, round(n * ratio)))


def split_train_eval(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """``part`` of each row: exactly eval_size rows go to eval, those of lowest hash; only the group at the cut is ranked, not the table."""
    rows = df.withColumn("_h", order_key(seed, "split", F.col(key)))
    k = eval_size(df.count(), ratio)
    if k == 0:
        return rows.withColumn("part", F.lit("train")).drop("_h")
    cut = find_cut(rows.select("_h"), "_h", k)
    d = F.substring("_h", 1, len(cut.digits))
    sure = rows.where(d != cut.digits).withColumn("part", F.when(d < cut.digits, "eval").otherwise("train"))
    edge = rows.where(d == cut.digits).withColumn("_r", F.row_number().over(Window.orderBy("_h", key)))
    return sure.unionByName(edge.withColumn("part", F.when(F.col("_r") <= cut.rest, "eval").otherwise("train")).drop("_r")).drop("_h")


def epoch_batches(df: DataFrame, key: str, batch: int, seed: int, epoch: int = 0, group: int = 50_000) -> DataFrame:
    """``batch_id`` and ``slot`` of each row in a seeded order that changes with the epoch; the last batch may be short.

    Ranks are taken within groups of about ``group`` rows by the leading digits
    of the hash, as many digits as the number of rows asks for, and added up
    over the groups in two levels.
    """
    n = df.count()
    digits = 2
    while n > group * 16**digits:
        digits += 1
    rows = df.withColumn("_h", order_key(seed, f"epoch{epoch}", F.col(key))).withColumn("_d", F.substring("_h", 1, digits))
    sizes = rows.groupBy("_d").count()
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = F.substring("_d", 1, (digits + 1) // 2)
    heads = sizes.groupBy(head.alias("_g")).agg(F.sum("count").alias("_n"))
    heads = heads.select("_g", before("_n", Window.orderBy("_g")).alias("_from"))  # the root of the number of groups
    starts = sizes.withColumn("_g", head).withColumn("_in", before("count", Window.partitionBy("_g").orderBy("_d"))).join(heads, "_g").select("_d", (F.col("_from") + F.col("_in")).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_d").orderBy("_h", key)) - 1
    placed = rows.join(F.broadcast(starts) if 16**digits <= 65_536 else starts, "_d").withColumn("_p", F.col("_start") + rank)
    return placed.withColumn("batch_id", F.floor(F.col("_p") / batch)).withColumn("slot", F.col("_p") % batch).drop("_h", "_d", "_start", "_p")


def sample_batch(df: DataFrame, key: str, batch: int, seed: int, step: int) -> DataFrame:
    """A random batch for ``step``: ``batch`` rows drawn with replacement, ``draw`` numbers them; the whole table if it has no more.

    Rows are numbered by key; a draw is a hashed position, so only the rows drawn
    are joined.
    """
    placed = numbered(df, key)
    n = placed.count()
    if batch >= n:
        return placed.withColumn("draw", F.col("_p")).drop("_p")
    at = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(f"step{step}"), F.col("draw").cast("string")), 256), 1, 12), 16, 10).cast("long") % n
    draws = df.sparkSession.range(batch).withColumnRenamed("id", "draw").withColumn("_p", at)
    return placed.join(F.broadcast(draws) if batch <= 100_000 else draws, "_p").drop("_p")


def chunked(df: DataFrame, order: str, size: int) -> DataFrame:
    """``chunk``: rows in consecutive chunks of ``size`` by ``order``, the last with what remains."""
    return numbered(df, order).withColumn("chunk", F.floor(F.col("_p") / size)).drop("_p")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """``_p``: position of each row by ``order``, from range partitions and their sizes, not from one task."""
    placed = materialize(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").count()
    start = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return placed.join(F.broadcast(sizes.select("_part", start.alias("_start"))), "_part").withColumn("_p", F.col("_start") + rank).drop("_part", "_start")
