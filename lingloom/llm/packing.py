"""Containers of fixed capacity, filled with whole documents.

Cost-balanced packing. The cost of an item of n tokens is n + n*n/quadratic, an
estimate of linear and attention work. Items go, largest first, to the open
container of lowest cost that still has room for them. Documents are spread by
hash over shards of bounded size, which are packed independently; a shard holds
so many containers that the last one, partly filled, hardly counts.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingloom.llm.tokens import TokenizerConfig, with_tokens
from lingloom.session import materialize


@dataclass(frozen=True)
class PackingConfig:
    """quadratic: tokens at which the attention term equals the linear one. shard_tokens: tokens of a shard
    (and at least shard_containers containers), and shard_items its items, so that neither large nor many empty
    documents gather in one task."""

    quadratic: float = 4096.0
    shard_tokens: int = 4_000_000
    shard_containers: int = 500
    shard_items: int = 200_000
    tokenizer: TokenizerConfig = TokenizerConfig()


def balanced(sizes: list[int], capacity: int, containers: int, quadratic: float) -> tuple[list[int], int]:
    """Container of each item (descending sizes), and how many were needed.

    Containers that cannot take the present item wait, ordered by room, until
    the items have become small enough.
    """
    room = [capacity] * containers
    ready = [(0.0, k) for k in range(containers)]
    waiting: list[tuple[int, int, float]] = []
    placed = []
    for n in sizes:
        while waiting and -waiting[0][0] >= n:
            free, k, cost = heapq.heappop(waiting)
            heapq.heappush(ready, (cost, k))
        while ready and room[ready[0][1]] < n:
            cost, k = heapq.heappop(ready)
            heapq.heappush(waiting, (-room[k], k, cost))
        if ready:
            cost, k = heapq.heappop(ready)
        else:
            cost, k = 0.0, len(room)
            room.append(capacity)
        room[k] -= n
        placed.append(k)
        heapq.heappush(ready, (cost + n + n * n / quadratic, k))
    return placed, len(room)


def tightest(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Best fit for descending sizes: the fullest container with room."""
    open_: list[tuple[int, int]] = []
    placed, n_open = [], 0
    for n in sizes:
        at = bisect_left(open_, (n, -1))
        if at == len(open_):
            free, k = capacity, n_open
            n_open += 1
        else:
            free, k = open_.pop(at)
        placed.append(k)
        insort(open_, (free - n, k))
    return placed, n_open


def pack(sizes: list[int], capacity: int, quadratic: float) -> list[int]:
    """Containers for descending sizes: cost-balanced, in as few as best fit needs."""
    least = max(1, -(-sum(sizes) // capacity))
    tight, most = tightest(sizes, capacity)
    for m in sorted({least, (least + most + 1) // 2, most}):
        placed, used = balanced(sizes, capacity, m, quadratic)
        if used <= most:
            return placed
    return tight


def fill_containers(docs: DataFrame, containers: DataFrame, key: str = "doc_id", text: str = "text", config: PackingConfig = PackingConfig()) -> DataFrame:
    """One row for each piece: container_kind, container_id, key, piece_no, start_token, n_tokens.

    A document is divided only if it exceeds the capacity, into full containers
    and a rest; piece_no counts from 0. A null or empty text is an item of no
    tokens. Repeated keys count once. A null or non-positive capacity gives no
    rows for that kind.
    """
    sized = with_tokens(docs.select(F.col(key).alias("key"), F.col(text).alias("n_tokens")), "n_tokens", config=config.tokenizer)
    sized = materialize(sized.groupBy("key").agg(F.max("n_tokens").alias("n")))
    # the kinds are a plan, which does not grow with the documents
    listed = containers.select("container_kind", F.col("capacity_tokens").cast("long").alias("cap")).where("cap > 0").distinct().collect()
    kinds = F.array(*[F.struct(F.lit(r["container_kind"]).alias("container_kind"), F.lit(r["cap"]).cast("long").alias("cap")) for r in listed])
    if not listed:
        kinds = F.array().cast("array<struct<container_kind:string,cap:long>>")
    whole = F.floor(F.col("n") / F.col("cap"))
    cut = sized.select("key", "n", F.explode(kinds).alias("k")).select("key", "n", "k.*")
    cut = cut.withColumn("full", whole).withColumn("rest", F.col("n") - F.col("full") * F.col("cap"))
    # full pieces fill containers of their own
    alone = cut.where("full > 0").select("container_kind", "cap", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece_no"))
    alone = alone.select(
        "container_kind", F.concat_ws("/", "container_kind", F.lit("whole"), F.xxhash64("key").cast("string"), F.col("key").cast("string"), F.col("piece_no").cast("string")).alias("container_id"),
        "key", F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * F.col("cap")).alias("start_token"), F.col("cap").alias("n_tokens"),
    )
    rest = cut.where("rest > 0 OR full = 0")
    per_kind = rest.groupBy("container_kind", "cap").agg(F.sum("rest").alias("tokens"), F.count("*").alias("items"))
    bound = F.greatest(F.lit(config.shard_tokens), F.col("cap") * config.shard_containers)
    shards = F.broadcast(per_kind.select("container_kind", F.greatest(F.lit(1), F.ceil(F.col("tokens") / bound), F.ceil(F.col("items") / config.shard_items)).alias("shards")))
    items = rest.join(shards, "container_kind").withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")))
    quadratic = config.quadratic

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rest", "key"], ascending=[False, True], kind="stable")
        placed = pack(pdf["rest"].tolist(), int(pdf["cap"].iloc[0]), quadratic)
        head = f"{pdf['container_kind'].iloc[0]}/{int(pdf['shard'].iloc[0])}/"
        return pd.DataFrame({
            "container_kind": pdf["container_kind"], "container_id": [head + str(k) for k in placed], "key": pdf["key"],
            "piece_no": pdf["full"].astype("int32"), "start_token": pdf["full"] * pdf["cap"], "n_tokens": pdf["rest"],
        })

    key_type = docs.schema[key].dataType.simpleString()
    packed = items.select("container_kind", "cap", "key", "full", "rest", "shard").groupBy("container_kind", "shard").applyInPandas(
        run, f"container_kind string, container_id string, key {key_type}, piece_no int, start_token long, n_tokens long"
    )
    return alone.unionByName(packed).withColumnRenamed("key", key)


def fill_report(pieces: DataFrame, kinds: DataFrame, config: PackingConfig = PackingConfig()) -> DataFrame:
    """container_kind, containers, tokens, fill, cost_spread: share of the room that is used, and the deviation of the cost of containers over its mean.

    ``kinds`` is (container_kind, cap). Containers without tokens, those of empty documents only, count as well.
    """
    n = F.col("n_tokens").cast("double")
    boxes = pieces.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.sum(n + n * n / config.quadratic).alias("cost"))
    by = boxes.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), (F.stddev_pop("cost") / F.avg("cost")).alias("cost_spread"))
    return by.join(F.broadcast(kinds), "container_kind").select("container_kind", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("cap"))).alias("fill"), "cost_spread")
