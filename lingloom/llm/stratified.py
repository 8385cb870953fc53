"""A sample whose strata have given shares, with minima, and a report of what could not be served.

Every item gets a pseudo-random priority. In one pass each task keeps, for every
stratum, a reservoir of the lowest priorities it saw, of a size that grows with
the rows seen, and counts. Reservoirs merge: below the lowest priority that any
task let go of, their union is complete. With the final counts the quotas are
known, and each stratum is trimmed to its quota by priority, which is uniform. If
a union were complete below fewer than the quota, the pass is repeated with more
room; so the result is always the exact one.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingloom.session import materialize


@dataclass(frozen=True)
class StratifiedConfig:
    """seed: of the priorities. bins: least number of bins in which the cut of a stratum is looked for. edge: priorities
    of a stratum that are ranked in one task. room: deviations above its expected share that a reservoir has room for."""

    seed: int = 17
    bins: int = 4096
    edge: int = 10_000
    room: float = 6.0


def normal_kind(kind: Column) -> Column:
    return F.lower(F.trim(kind))


def distinct_items(df: DataFrame, key: str = "source_id", kind: str = "kind", length: str = "length_approx") -> DataFrame:
    """(key, kind, length) once for each key; replays carry the same values."""
    return df.groupBy(F.col(key).alias("item")).agg(F.max(normal_kind(F.col(kind))).alias("kind"), F.max(F.col(length)).alias("length"))


@dataclass(frozen=True)
class Drawn:
    report: DataFrame  # plan_id, kind, length_from, length_to, wanted, available, quota, exhausted
    sample: DataFrame  # plan_id, kind, length_from, item


LAST = (1 << 60) - 1  # priorities have 60 bits


class Reservoir:
    """The lowest priorities seen of one stratum, and ``gone``, the lowest that was let go of."""

    def __init__(self, rate: float, least: int, room: float):
        self.rate, self.least, self.room = rate, least, room
        self.priorities, self.items = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object)
        self.seen, self.gone = 0, LAST

    def capacity(self, rows: int) -> int:
        expected = self.rate * rows
        return max(self.least, math.ceil(expected + self.room * math.sqrt(expected) + self.room))

    def add(self, priorities: np.ndarray, items: np.ndarray, rows: int) -> None:
        self.seen += len(priorities)
        low = priorities < self.gone
        self.priorities, self.items = np.concatenate([self.priorities, priorities[low]]), np.concatenate([self.items, items[low]])
        if len(self.priorities) > 2 * self.capacity(rows) + 1000:
            self.trim(rows)

    def trim(self, rows: int) -> None:
        k = self.capacity(rows)
        if len(self.priorities) > k:
            self.gone = min(self.gone, int(np.partition(self.priorities, k)[k]))
            low = self.priorities < self.gone
            self.priorities, self.items = self.priorities[low], self.items[low]


def fill_reservoirs(items: DataFrame, strata: list, config: StratifiedConfig, room: float) -> DataFrame:
    """(s, u, item, seen): the reservoirs of each task, and for each stratum a row without item that holds what was let go of and the count; s = -1 counts all rows."""
    item_type = items.schema["item"].dataType
    salts = [np.int64(int(hashlib.sha256(f"{config.seed}:{r['plan_id']}".encode()).hexdigest()[:15], 16)) for r in strata]
    schema = pa.schema([("s", pa.int32()), ("u", pa.int64()), items.sparkSession.createDataFrame([], T.StructType([T.StructField("item", item_type)])).toArrow().schema.field(0), ("seen", pa.int64())])

    def run(batches):
        kept = [Reservoir((r["target_share"] or 0.0) * (r["sample_fraction"] or 0.0), r["min_rows"] or 0, room) for r in strata]
        rows = 0
        for b in batches:
            rows += b.num_rows
            kind, length = np.array(b.column(1).to_pylist(), dtype=object), b.column(2).to_numpy(zero_copy_only=False).astype(float)
            item = np.array([*b.column(0).to_pylist(), None], dtype=object)[:-1]
            base = b.column(3).to_numpy()
            for r, salt, reservoir in zip(strata, salts, kept):
                if r["_kind"] is None or r["length_from"] is None or r["length_to"] is None:
                    continue
                inside = np.flatnonzero((kind == r["_kind"]) & (length >= r["length_from"]) & (length < r["length_to"]))
                reservoir.add(base[inside] ^ salt, item[inside], rows)
        for s, reservoir in enumerate(kept):
            reservoir.trim(rows)
            for at in range(0, len(reservoir.items), 20_000):
                u, i = reservoir.priorities[at : at + 20_000], reservoir.items[at : at + 20_000].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(i), type=pa.int32()), pa.array(u), pa.array(i, type=schema.field(2).type), pa.nulls(len(i), pa.int64())], schema=schema)
        totals = [(-1, LAST, rows), *[(s, r.gone, r.seen) for s, r in enumerate(kept)]]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in totals], type=pa.int32()), pa.array([x[1] for x in totals], type=pa.int64()), pa.nulls(len(totals), schema.field(2).type), pa.array([x[2] for x in totals], type=pa.int64())], schema=schema)

    # a keyed hash of the item, turned by that of the plan: uniform in each plan, and not the same items in all
    named = items.select("item", "kind", "length", F.conv(F.substring(F.sha2(F.concat(F.lit(f"{config.seed}:"), F.coalesce(F.col("item").cast("string"), F.lit(""))), 256), 1, 15), 16, 10).cast("long").alias("_u"))
    return materialize(named.mapInArrow(run, T.StructType([T.StructField("s", T.IntegerType()), T.StructField("u", T.LongType()), T.StructField("item", item_type), T.StructField("seen", T.LongType())])))


def draw(items: DataFrame, plan: DataFrame, config: StratifiedConfig = StratifiedConfig()) -> Drawn:
    """Draw by ``plan`` (plan_id, kind, length_from, length_to, target_share, min_rows, sample_fraction).

    ``items`` is (item, kind, length), one row an item. ``wanted`` is the larger
    of min_rows and target_share * sample_fraction * n with n all items; the
    quota is that, rounded half up, or what there is. An item with a null kind
    or length is in no stratum but counts in n. A stratum is exhausted if it has
    fewer items than wanted. No items: every stratum with a positive target is
    exhausted and the sample is empty. The plan, which does not grow with the
    items, is held on the driver.
    """
    spark = items.sparkSession
    chosen = plan.select("plan_id", "kind", normal_kind(F.col("kind")).alias("_kind"), "length_from", "length_to", F.col("target_share").cast("double"), F.col("min_rows").cast("long"), F.col("sample_fraction").cast("double"))
    strata = chosen.collect()
    room = config.room
    while True:
        kept = fill_reservoirs(items, strata, config, room)
        totals = {r["s"]: r for r in kept.where("seen is not null").groupBy("s").agg(F.sum("seen").alias("seen"), F.min("u").alias("gone")).collect()}
        n = totals[-1]["seen"] if -1 in totals else 0
        gone = {s: totals[s]["gone"] if s in totals else LAST for s in range(len(strata))}
        lines = []
        for s, r in enumerate(strata):
            # rounded, as a product of shares that is 60 in exact arithmetic may come out a hair above
            wanted = max(float(r["min_rows"] or 0), round((r["target_share"] or 0.0) * (r["sample_fraction"] or 0.0) * n, 6))
            available = totals[s]["seen"] if s in totals else 0
            lines.append((wanted, available, min(available, math.floor(wanted + 0.5))))
        complete = by_stratum(gone, T.LongType())
        whole = kept.where(F.col("seen").isNull() & (F.col("u") < complete))
        sizes = {r["s"]: r["count"] for r in whole.groupBy("s").count().collect()}
        if all(sizes.get(s, 0) >= q for s, (_, _, q) in enumerate(lines)):
            break
        room *= 4
    fields = [*[plan.schema[c] for c in ("plan_id", "kind", "length_from", "length_to")], T.StructField("wanted", T.DoubleType()), T.StructField("available", T.LongType()), T.StructField("quota", T.LongType()), T.StructField("exhausted", T.BooleanType())]
    report = spark.createDataFrame([(r["plan_id"], r["kind"], r["length_from"], r["length_to"], w, a, q, a < w) for r, (w, a, q) in zip(strata, lines)], T.StructType(fields))

    # trimmed to the quota: bins of priorities up to about where the cut must be; only the bin of the cut is ranked
    width = {s: max(1, math.ceil((q + 1) / (a + 1) * LAST / max(config.bins, q // config.edge))) for s, (_, a, q) in enumerate(lines)}
    binned = whole.select("s", "u", "item", F.floor(F.col("u") / by_stratum(width, T.LongType())).alias("_bin"))
    below = F.coalesce(F.sum("count").over(Window.partitionBy("s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = by_stratum({s: q for s, (_, _, q) in enumerate(lines)}, T.LongType())
    cuts = binned.groupBy("s", "_bin").count().withColumn("_below", below).where((F.col("_below") < quota) & (F.col("_below") + F.col("count") >= quota))
    # one row a stratum
    placed = binned.join(F.broadcast(cuts.select("s", F.col("_bin").alias("_cut"), (quota - F.col("_below")).alias("_rest"))), "s").where(F.col("_bin") <= F.col("_cut"))
    edge = placed.where(F.col("_bin") == F.col("_cut")).withColumn("_r", F.row_number().over(Window.partitionBy("s").orderBy("u", "item"))).where(F.col("_r") <= F.col("_rest"))
    drawn = placed.where(F.col("_bin") < F.col("_cut")).select("s", "item").unionByName(edge.select("s", "item"))
    named = spark.createDataFrame([(s, r["plan_id"], r["kind"], r["length_from"]) for s, r in enumerate(strata)], T.StructType([T.StructField("s", T.IntegerType()), *fields[:3]]))
    return Drawn(report, drawn.join(F.broadcast(named), "s").select("plan_id", "kind", "length_from", "item"))


def by_stratum(values: dict[int, int], kind: T.DataType) -> Column:
    """A number of each stratum as a column; null for none."""
    if not values:
        return F.lit(None).cast(kind)
    return F.get(F.array(*[F.lit(values[s]).cast(kind) for s in range(len(values))]), F.col("s"))
