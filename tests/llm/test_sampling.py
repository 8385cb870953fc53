import numpy as np
import pytest
from pyspark.sql import functions as F

from lingloom.llm import fixed_sample as X
from lingloom.llm import stratified as S
from lingloom.llm import topn as N


def items(spark, rows):
    return S.distinct_items(spark.createDataFrame(rows, "source_id string, kind string, length_approx int").withColumn("quota", F.lit("clash")))


PLAN = "plan_id string, kind string, length_from int, length_to int, target_share double, min_rows int, sample_fraction double"


def test_quotas_are_met_and_shortfalls_reported(spark):
    rows = [(f"s{i}", " Sentence" if i % 2 else "SENTENCE ", 5 + i % 20) for i in range(400)] + [(f"b{i}", "blob", 50) for i in range(3)] + [("n1", None, 5), ("n2", "blob", None)] + [("s1", "sentence", 6)] * 50
    plan = spark.createDataFrame([("p", "sentence", 0, 10, 0.5, 1, 0.2), ("p", "sentence", 10, 30, 0.4, 1, 0.2), ("p", "blob", 0, 100, 0.1, 5, 0.2)], PLAN)
    got = S.draw(items(spark, rows), plan)
    report = {(r["kind"], r["length_from"]): r for r in got.report.collect()}
    n = 405
    assert report["sentence", 0]["wanted"] == pytest.approx(0.5 * 0.2 * n) and not report["sentence", 0]["exhausted"]
    assert report["blob", 0]["exhausted"] and report["blob", 0]["quota"] == 3
    counts = {(r["kind"], r["length_from"]): r["count"] for r in got.sample.groupBy("kind", "length_from").count().collect()}
    assert counts == {k: r["quota"] for k, r in report.items()}
    assert got.sample.distinct().count() == sum(counts.values())


def test_equal_number_suffices(spark):
    plan = spark.createDataFrame([("p", "a", 0, 10, 0.15, 1, 0.2)], PLAN)
    rows = [(f"x{i}", "a" if i < 60 else "b", 5) for i in range(2000)]
    assert not S.draw(items(spark, rows), plan).report.first()["exhausted"]


def test_sample_is_uniform_and_repeatable(spark):
    plan = spark.createDataFrame([(f"p{k}", "a", 0, 10, 1.0, 1, 0.25) for k in range(200)], PLAN)
    it = items(spark, [(f"x{i}", "a", 5) for i in range(40)])
    drawn = S.draw(it, plan, S.StratifiedConfig(bins=16)).sample
    per = [r["count"] for r in drawn.groupBy("item").count().collect()]
    assert sum(per) == 2000 and min(per) > 20 and max(per) < 85
    assert drawn.exceptAll(S.draw(it.repartition(3), plan).sample).count() == 0


def test_small_reservoirs_are_filled_again_until_complete(spark):
    plan = spark.createDataFrame([("p", "a", 0, 10, 1.0, 1, 0.5), ("p", "b", 0, 10, 0.9, 40, 0.5)], PLAN)
    it = items(spark, [(f"x{i}", "a" if i % 3 else "b", 5) for i in range(9000)]).repartition(5)
    full = S.draw(it, plan).sample
    assert full.exceptAll(S.draw(it, plan, S.StratifiedConfig(room=0.001, edge=10)).sample).count() == 0 and full.count() == 4500 + 3000


def test_reservoirs_merge_to_the_lowest_of_all():
    rng = np.random.default_rng(1)
    values = rng.permutation(10**6)[:60_000]
    parts = []
    for part in np.array_split(values, 3):
        r = S.Reservoir(0.1, 5, 6.0)
        for k, batch in enumerate(np.array_split(part, 10)):
            r.add(batch, batch.astype(object), (k + 1) * len(batch))
        r.trim(len(part))
        parts.append(r)
    gone = min(r.gone for r in parts)
    kept = np.sort(np.concatenate([r.priorities[r.priorities < gone] for r in parts]))
    assert sum(r.seen for r in parts) == len(values) and len(kept) >= 6000
    assert (kept == np.sort(values)[: len(kept)]).all()


def test_no_items(spark):
    got = S.draw(items(spark, []), spark.createDataFrame([("p", "a", 0, 10, 1.0, 1, 0.1)], PLAN))
    assert got.sample.count() == 0 and got.report.first()["exhausted"]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_permutation(n):
    p = X.permute(np.arange(n, dtype=np.uint64), n, 9)
    assert sorted(p.tolist()) == list(range(n))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_permutation_and_its_inverse(n):
    x = np.arange(n, dtype=np.uint64)
    assert (X.permute(X.permute(x, n, 4), n, 4, inverse=True) == x).all()


def test_draws_are_uniform(spark):
    df = spark.createDataFrame([(f"k{i}", i % 4) for i in range(40)], "source_id string, shard_id int")
    draws = spark.createDataFrame([(i, 1000 + i, 8) for i in range(1500)], "draw_id int, draw_seed int, sample_size int")
    got = X.fixed_size_samples(df, draws, "source_id", "shard_id", X.FixedSampleConfig(bucket_rows=7, part=3))
    assert {r["count"] for r in got.distinct().groupBy("draw_id").count().collect()} == {8}
    hits = [r["count"] for r in got.groupBy("key").count().collect()]
    # 300 expected; the chi-square of 39 degrees of freedom is under 80 but once in ten thousand
    assert len(hits) == 40 and sum((h - 300) ** 2 / 300 for h in hits) / 0.8 < 80


def test_every_position_is_as_likely():
    hits = np.zeros(50)
    for seed in range(2000):
        hits += X.permute(np.arange(50, dtype=np.uint64), 50, seed) < 5
    assert abs(hits - 200).max() < 70


def test_fixed_sizes(spark):
    rows = [(f"k{i % 100}", i % 3 if i % 100 else None) for i in range(300)] + [(None, 1)]
    df = spark.createDataFrame(rows, "source_id string, shard_id int").withColumn("position", F.lit("clash"))
    draws = spark.createDataFrame([(1, 11, 10), (2, 12, 1000), (3, 13, 1), (4, 14, 0), (5, 15, None)], "draw_id int, draw_seed int, sample_size int")
    got = X.fixed_size_samples(df, draws, "source_id", "shard_id")
    assert {r["draw_id"]: r["count"] for r in got.groupBy("draw_id").count().collect()} == {1: 10, 2: 101, 3: 1}
    assert got.distinct().count() == 112
    assert got.exceptAll(X.fixed_size_samples(df.repartition(7), draws, "source_id", "shard_id")).count() == 0
    assert X.fixed_size_samples(df.limit(0), draws, "source_id", "shard_id").count() == 0


def test_numbers_are_dense(spark):
    df = spark.createDataFrame([(f"k{i}", i % 4) for i in range(500)], "source_id string, shard_id int")
    numbered, n = X.number_densely(df, "source_id", "shard_id")
    assert n == 500 and sorted(r["position"] for r in numbered.collect()) == list(range(500))


def brute(rows, n):
    groups = {}
    for g, i, s in rows:
        if s is not None and s == s:
            groups.setdefault(g, set()).add((s, i))
    return {(g, i) for g, v in groups.items() for s, i in sorted(v)[:n]}


@pytest.mark.parametrize("heavy", [5, 1_000_000])
def test_top_n_like_brute_force(spark, heavy):
    rng = np.random.default_rng(3)
    rows = [("hot", int(i), float(rng.integers(0, 5))) for i in range(400)] + [(f"g{i % 30}", i, float(rng.integers(0, 3))) for i in range(300)]
    rows += rows[:50] + [("nan", 1, float("nan")), ("none", 1, None), ("one", 7, 0.0)] + [("same", 1, 2.0)] * 40
    df = spark.createDataFrame(rows, "source_id string, candidate_index int, score double").withColumn("group", F.lit("clash"))
    got = N.top_n(df, "source_id", F.col("score"), F.col("candidate_index"), 3, N.TopNConfig(heavy_rows=heavy))
    assert {(r["group"], r["tie"]) for r in got.collect()} == brute(rows, 3)
    assert got.count() == len(brute(rows, 3))
    assert N.top_n(df.limit(0), "source_id", F.col("score"), F.col("candidate_index"), 3).count() == 0
