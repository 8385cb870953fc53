import pytest
from pyspark.sql import functions as F

from lingloom.functions import tokens as K
from lingloom.operators import external as E
from lingloom.operators import sample as B
from lingloom.operators import stats

FAST = E.CallConfig(concurrency=2, attempts=3, wait=0.0, jitter=0.0)


class Refused(Exception):
    status_code = 401


class Flaky:
    def __init__(self):
        self.calls = {}

    def complete(self, request):
        n = self.calls[request] = self.calls.get(request, 0) + 1
        if request == "never":
            raise RuntimeError("down")
        if request == "refused":
            raise Refused("no")
        if request == "blank":
            return "  "
        if request == "later" and n < 3:
            raise RuntimeError("busy")
        return request.upper()


def test_retries():
    client = Flaky()
    assert E.call_with_retry(client, "later", FAST) == "LATER" and client.calls["later"] == 3
    with pytest.raises(RuntimeError):
        E.call_with_retry(client, "never", FAST)
    with pytest.raises(Refused):
        E.call_with_retry(client, "refused", FAST)
    with pytest.raises(ValueError, match="blank"):
        E.call_with_retry(client, "blank", FAST)
    assert client.calls["never"] == 3 and client.calls["refused"] == 1


def test_failures_do_not_stop_the_rest(spark):
    rows = spark.createDataFrame([("a",), ("never",), ("later",), (None,)], "request string").coalesce(1)
    got = {r["request"]: (r["completion"], r["error"] is None) for r in E.complete(rows, "request", Flaky, FAST).collect()}
    assert got == {"a": ("A", True), "never": (None, False), "later": ("LATER", True), None: (None, False)}


def test_cache_is_asked_first_and_blank_entries_are_stale(spark):
    asked = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k2", "b"), ("k3", "c")], "k string, request string")
    cache = spark.createDataFrame([("k1", "kept"), ("k3", " ")], "key string, value string")
    got = {r["k"]: (r["completion"], r["cached"]) for r in E.complete_with_cache(asked, "k", "request", cache, Flaky, FAST).collect()}
    assert got == {"k1": ("kept", True), "k2": ("B", False), "k3": ("C", False)}


def test_sampling_parameters():
    assert E.sampling_parameters(0.5, 0.9) == {"temperature": 0.5, "top_p": 0.9}
    got = E.sampling_parameters(0.5, 0.9, {"temperature": 1, "top_k": 5}, {"a": 1, "b": 1}, {"b": 2})
    assert got == {"temperature": 1.0, "top_p": 0.9, "extra_body": {"a": 1, "b": 2, "top_k": 5}}


def test_token_ids(spark):
    raw = ["[1, 2]", "[[1], [2, 3]]", " 4 -5 ", "", None, "[]"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").orderBy("i")
    assert [r[0] for r in rows.select(K.coerce_ids(F.col("r"))).collect()] == [[1, 2], [1, 2, 3], [4, -5], [], [], []]
    with pytest.raises(Exception, match="no token ids"):
        spark.createDataFrame([("abc",)], "r string").select(K.coerce_ids(F.col("r"))).collect()


@pytest.mark.parametrize(
    "meta,want",
    [
        (None, [[], []]), ("oops", [[], []]), ('[{"error_spans": [{"start": 1, "end": 2}]}]', [[1], []]), ('[[{"start": 1}, {"start": 2}], null, [{"start": 9}]]', [[1, 2], []]),
        ('{"error_spans": [{"start": 4}]}', [[4], []]), ('{"error_spans": [[], [{"start": 5}]]}', [[], [5]]), ('{"samples": [{"error_spans": [{"start": 6}]}]}', [[6], []]), ('{"x": 1}', [[], []]),
    ],
)
def test_error_spans(spark, meta, want):
    rows = spark.createDataFrame([(meta,)], "m string")
    got = rows.select(K.error_spans(F.col("m"), F.lit(2)).alias("s")).first()["s"]
    assert [[x["start"] for x in s] for s in got] == want


def test_run_stats(spark, tmp_path):
    run = stats.RunStats()
    run.inc("a", 2)
    with run.time("stage"):
        run.watch(spark.range(10), "seen", rows=F.count("*"), even=F.count_if(F.col("id") % 2 == 0)).write.format("noop").mode("overwrite").save()
    got = run.report()
    assert got["counters"] == {"a": 2, "seen.rows": 10, "seen.even": 5} and got["timings"]["stage"]["count"] == 1
    run.write(str(tmp_path / "s.json"))


def test_scan_stops_once_the_sample_can_be_filled(spark):
    chunk = lambda k: spark.createDataFrame([(f"{k}-{i}", n) for i in range(4) for n in (5, 15)], "source_id string, n int")
    config = B.BalancedConfig(size=10, boundaries=(0, 10, 20))
    read, n = stats.scan_until_filled((chunk(k) for k in range(9)), B.bucket_of(F.col("n"), [0, 10, 20]), config)
    assert n == 2 and read.count() == 16
