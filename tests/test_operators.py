import math
import random

import pytest
from pyspark.sql import functions as F

from lingloom.operators import advantage as A
from lingloom.operators import candidates as C
from lingloom.operators import filters as R
from lingloom.operators import sample as B
from lingloom.operators import segment as G
from lingloom.operators import sft as S
from lingloom.operators import tables as KV


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string")


def test_list_of_lines_is_not_cut(spark):
    d = spark.createDataFrame([("doc1", ["This is the first line.", " And  a second one here. "])], "doc_id string, text array<string>")
    got = G.segments(d, config=G.SegmentConfig(3, 200, False)).orderBy("segment_index").collect()
    assert [r["source_id"] for r in got] == ["doc1:s:0", "doc1:s:1"] and got[1]["source_text"] == "And a second one here."


def test_segment_ids_keep_gaps_and_zero_is_an_id(spark):
    d = spark.createDataFrame([(0, "a long enough line here\nhttps://only.example/an-address\nanother long enough line")], "doc_id long, text string")
    got = G.segments(d, config=G.SegmentConfig(10, 200, False)).orderBy("segment_index").collect()
    assert [r["source_id"] for r in got] == ["0:s:0", "0:s:2"]


def merged_by_hand(lines, threshold):
    out, waiting = [], []
    for line in lines:
        waiting.append(line)
        if len(line) >= threshold:
            out.append(" ".join(waiting))
            waiting = []
    if waiting:
        if out:
            out[-1] = " ".join([out[-1], *waiting])
        else:
            out.append(" ".join(waiting))
    return out


def test_merging_short_lines_equals_a_fold(spark):
    rng = random.Random(3)
    made = {f"d{k}": ["x" * rng.randint(1, 12) for _ in range(rng.randint(1, 12))] for k in range(60)}
    lines = spark.createDataFrame([(k, i, x) for k, v in made.items() for i, x in enumerate(v)], "doc string, pos int, line string")
    got = {}
    for r in G.merge_short(lines, 6).orderBy("doc", "pos").collect():
        got.setdefault(r["doc"], []).append(r["line"])
    assert got == {k: merged_by_hand(v, 6) for k, v in made.items()}


def test_blobs_close_before_the_limit(spark):
    d = docs(spark, [("d", "one two three.\nfour five six.\nseven eight nine.\n" + "long " * 30)])
    config = G.SegmentConfig(3, 500, False, True, 8)
    got = G.blobs(G.segments(d, config=config), config).orderBy("source_id").collect()
    assert [(r["kind"], r["num_segments"]) for r in got] == [("blob", 2), ("blob", 1), ("blob", 1)]
    assert got[0]["source_text"] == "one two three.\nfour five six."


def test_segments_of_nothing(spark):
    assert G.segments(docs(spark, [("a", None), ("b", ""), ("c", " \n\t")])).count() == 0
    assert G.blobs(G.segments(docs(spark, []))).count() == 0


def test_buckets(spark):
    rows = spark.createDataFrame([(5,), (10,), (35,), (999,), (-1,)], "n int")
    assert [r[0] for r in rows.select(B.bucket_of(F.col("n"), [0, 10, 20, 40])).collect()] == [0, 1, 2, 2, 2]
    assert B.quotas(7, 3) == [3, 2, 2] and B.capacities([3, 2], 1.5) == [4, 3]
    assert B.can_fill({0: 20}, [2, 2], [2, 2], 4) == (2, False) and B.can_fill({0: 20}, [2, 2], [4, 4], 4) == (4, True)


def test_balanced_sample_fills_deficits(spark):
    rows = spark.createDataFrame([(f"r{i}", 5 if i < 20 else 15 if i < 22 else 25) for i in range(42)], "source_id string, n int")
    config = B.BalancedConfig(size=12, boundaries=(0, 10, 20, 30))
    pick = B.balanced_sample(rows, "source_id", B.bucket_of(F.col("n"), list(config.boundaries)), config)
    got = [r["n"] for r in pick.collect()]
    assert len(got) == 12 and got.count(15) == 2
    again = B.balanced_sample(rows.repartition(7), "source_id", B.bucket_of(F.col("n"), list(config.boundaries)), config)
    assert {r["source_id"] for r in pick.collect()} == {r["source_id"] for r in again.collect()}


@pytest.mark.parametrize("n,ratio,want", [(100, 0.05, 5), (1, 0.5, 0), (2, 0.01, 1), (10, 0.99, 9), (10, 0.25, 2)])
def test_split_sizes(spark, n, ratio, want):
    rows = spark.range(n)
    got = B.split_train_eval(rows, "id", ratio, 1).groupBy("part").count().collect()
    counts = {r["part"]: r["count"] for r in got}
    assert counts.get("eval", 0) == want == B.eval_size(n, ratio) and sum(counts.values()) == n


def test_epoch_batches_cover_all_once(spark):
    got = B.epoch_batches(spark.range(25), "id", 8, 1).collect()
    assert sorted((r["batch_id"], r["slot"]) for r in got) == [(i // 8, i % 8) for i in range(25)]


def test_prefilter_rows_fill_what_is_missing(spark):
    s = spark.createDataFrame([("a", "x"), ("b", "y")], "source_id string, source_text string")
    c = spark.createDataFrame([("a", "greedy", "g", 7.0), ("a", "sample", "s", 3.0)], "source_id string, mode string, text string, score double")
    got = {r["source_id"]: r["prefilter"] for r in C.prefilter_rows(s, c).collect()}
    assert got["a"]["improvement"] == 4.0 and got["b"]["improvement"] == 0.0 and got["b"]["greedy_text"] == ""


def test_ties_are_broken_by_key(spark):
    rows = spark.createDataFrame([("c", 1.0), ("a", 1.0), ("b", 2.0), ("d", 1.0)], "source_id string, i double")
    top = C.top_sources(rows, F.col("i"), "source_id", 3).collect()
    assert [(r["source_id"], r["selection"]["selection_rank"]) for r in sorted(top, key=lambda r: r["selection"]["selection_rank"])] == [("b", 1), ("a", 2), ("c", 3)]
    k = spark.createDataFrame([("a", 1, 0.0), ("a", 0, 0.0), ("a", 2, None)], "source_id string, candidate_index int, score double")
    assert [(r["candidate_index"], r["rank"]) for r in C.top_per_source(k, F.col("score"), 2).orderBy("rank").collect()] == [(0, 1), (1, 2)]


@pytest.mark.parametrize(
    "source,target,reason",
    [
        ("hello there", "안녕하세요 여러분", "pass"), ("hello", "  ", "empty"), ("hello", None, "empty"), ("hello", "Here is the translation: x", "blocked_substring"), ("a" * 100, "ab", "ratio_too_small"),
        ("ab", "c" * 100, "ratio_too_large"), ("one two three", "three two one", "copy_overlap"), ("x", "y" * 20001, "too_long"),
    ],
)
def test_rule_filter(spark, source, target, reason):
    rows = spark.createDataFrame([(source, target)], "s string, h string")
    v = rows.select(R.rule_verdict(F.col("s"), F.col("h")).alias("v")).first()["v"]
    assert (v["passed"], v["reason_code"]) == (reason == "pass", reason)


def test_judge_needs_a_boolean(spark):
    raw = ['{"pass": true, "reason_code": "pass", "notes": "ok"}', 'so: {"pass": false, "reason_code": "r"} end', '{"pass": "false"}', "no json", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").orderBy("i")
    strict = [tuple(r["v"])[:2] for r in rows.select(R.judge_verdict(F.col("r")).alias("v")).collect()]
    assert strict == [(True, "pass"), (False, "r"), (False, "judge_parse_failure"), (False, "judge_parse_failure"), (False, "judge_parse_failure")]
    assert rows.select(R.judge_verdict(F.col("r"), "permissive")["passed"]).collect()[3][0] is True


def test_routes_partition_the_rows(spark):
    rows = spark.createDataFrame([("hello", "안녕하세요"), ("hello", "")], "s string, h string")
    passed, rejected = R.route(R.apply_filters(rows, "s", "h"))
    assert passed.count() == rejected.count() == 1 and rejected.first()["filters"]["type"] == "rule_based"


def test_advantages(spark):
    rows = spark.createDataFrame([("u", "g", [1.0, 2.0]), ("u", "g", [3.0])], "batch string, g string, advantages array<double>")
    flat = [x for r in A.batch_advantage(rows, "batch").collect() for x in r["advantages"]]
    mean = sum(flat) / 3
    assert abs(mean) < 1e-6 and abs(math.sqrt(sum((x - mean) ** 2 for x in flat) / 3) - 1) < 1e-6
    shifted = sorted(r["advantages"] for r in A.group_advantage(rows, ["g"]).collect())
    assert [round(x, 5) for x in shifted[0]] == [0.0, 1.0] and [round(x, 5) for x in shifted[1]] == [4.0]
    one = spark.createDataFrame([("g", []), ("h", [5.0])], "g string, advantages array<double>")
    assert sorted(r["advantages"] for r in A.group_advantage(one, ["g"]).collect()) == [[], [5.0]]


def test_reports_of_nothing(spark):
    empty = spark.createDataFrame([], "a double, b double, r double, spans array<struct<severity:string>>, tokens array<string>")
    got = A.eval_report(empty, "a", "b", "r", "spans", "tokens").first().asDict()
    assert set(got.values()) == {0.0}


def test_non_finite_scores(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "s double")
    assert [r[0] for r in rows.select(A.sanitize_score(F.col("s"), 5.0)).collect()] == [1.0, 5.0, 5.0, 5.0]
    with pytest.raises(Exception, match="non-finite"):
        rows.select(A.sanitize_score(F.col("s"), 5.0, "error")).collect()


def test_running_best_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 3.0), (4, float("nan")), (5, 2.0), (6, 4.0)], "u int, s double").withColumn("run", F.lit("x"))
    assert [r["best_update"] for r in A.running_best(rows, ["run"], "u", "s").orderBy("u").collect()] == [1, 2, 2, 2, 2, 6]


def test_templates():
    S.check_template(S.TRANSLATE_USER)
    with pytest.raises(ValueError, match="lacks"):
        S.check_template("{text}")
    with pytest.raises(ValueError, match="unknown placeholder"):
        S.template("{nope}", text=None)
    assert S.ratio_label(0.05) == "5" and S.ratio_label(0.125) == "12p5"


def test_typed_scan(spark):
    lines = spark.createDataFrame([('{"a": "x", "b": 1}',), ("{bad",), ("[1]",), ("",), ('{"b": {"c": 2}}',)], "line string")
    got = [tuple(r) for r in S.typed_scan(lines, "line", ["a", "b"]).collect()]
    assert got == [("x", "1"), ("", '{"c":2}')]
    stats = S.scan_stats(lines, "line", ["a"]).first()
    assert (stats["total_lines"], stats["bad_json"], stats["rows"], stats["a_missing"]) == (4, 1, 2, 1)


def test_keyed_tables(spark):
    cache = spark.createDataFrame([("k", "old", 1), ("k", "new", 2), ("b", " ", 1)], "key string, v string, at int")
    now = KV.latest(cache, ["key"], "at")
    asked = spark.createDataFrame([("k",), ("b",), ("c",)], "key string")
    usable = F.trim("v") != ""
    assert [r["v"] for r in KV.hits(asked, now, ["key"], usable).collect()] == ["new"]
    assert sorted(r["key"] for r in KV.misses(asked, now, ["key"], usable).collect()) == ["b", "c"]
    again = KV.upsert(now, spark.createDataFrame([("b", "filled", 5)], "key string, v string, at int"), ["key"], "at")
    assert {r["key"]: r["v"] for r in again.collect()} == {"k": "new", "b": "filled"}
    done = spark.createDataFrame([("s", "k")], "stage_name string, item_id string")
    assert sorted(r["key"] for r in KV.pending(asked, done, "s", "key").collect()) == ["b", "c"] and KV.pending(asked, done, "s", "key", False).count() == 3


def test_scores_are_asked_once_a_pair(spark):
    class Count:
        def score(self, sources, candidates):
            return [float(len(sources)) for _ in sources]

    rows = spark.createDataFrame([("a", "b")] * 5 + [(None, "b")], "s string, h string").coalesce(1)
    got = C.score_once(rows, ["s", "h"], C.scorer_udf(Count)).collect()
    assert len(got) == 6 and all(r["score"] <= 2 for r in got)


def test_balanced_sample_cut_by_histogram_is_the_one_of_the_heaps(spark):
    rows = spark.range(600).selectExpr("concat('r', id) AS source_id", "CAST(CASE WHEN id < 20 THEN 5 WHEN id < 400 THEN 15 ELSE 25 END AS int) AS n")
    pick = lambda most: {r[0] for r in B.balanced_sample(rows, "source_id", B.bucket_of(F.col("n"), [0, 10, 20, 30]), B.BalancedConfig(150, boundaries=(0, 10, 20, 30), most_in_heap=most)).collect()}
    assert pick(0) == pick(10_000) and len(pick(0)) == 150
