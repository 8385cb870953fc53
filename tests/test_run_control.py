"""Run control: stages, resume, shards, limits; setups; files on any file system."""

import pytest
from pyspark.sql import functions as F

from lingloom.operators import candidates as C
from lingloom.operators import sample as B
from lingloom.operators import tables as KV
from lingloom.plans import config as P
from lingloom.plans.pipeline import STAGES, Pipeline, RunMode, main
from lingloom.sources import io

CONFIG = {"data": {"sample_pool_size": 12}, "sample": {"boundaries": [0, 1000]}, "select": {"top_n": 3, "num_candidates": 4}, "filters": {"max_copy_overlap": 1.0}, "call_parts": 2}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, "\n".join(f"Document {i} has sentence number {k} about gardens and bridges." for k in range(6))) for i in range(20)], "doc_id long, text string")


def counting(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def one(text, ident, index):
        calls.add(1)
        return f"{text} {ident} {index}"

    return calls, lambda text, ident, index: one(text, ident, index.cast("string") if hasattr(index, "cast") else F.lit(str(index)))


def test_a_resumed_run_repeats_no_call(spark, docs, tmp_path):
    config = P.from_dict(P.PipelineConfig, CONFIG)
    folder = str(tmp_path / "run")
    calls, generate = counting(spark)
    first = Pipeline(spark, config, generator=generate, folder=folder)
    for stage in ("sample_sources", "prefilter_score"):
        first.run_stage(stage, docs)
    made = calls.value
    assert made == 2 * 12
    # lost before it was marked as finished, as if the run had stopped; the calls are in their cache
    io.remove(spark, f"{folder}/prefilter_candidates")
    io.remove(spark, f"{folder}/prefilter_completions")
    again = Pipeline(spark, config, generator=generate, folder=folder, mode=RunMode(resume=True))
    out = again.run(docs)
    assert calls.value == made + 3 * 4 and out.count() == 3
    assert {r["stage_name"]: r["n"] for r in KV.progress_counts(spark.read.parquet(f"{folder}/progress/*")).collect()} == {
        "sample_sources": 12, "prefilter_score": 12, "select_sources": 3, "generate_candidates": 3, "score_select_best": 3, "format_filter": 3,
    }
    manifest = io.load_json(f"{folder}/manifest.json", spark)
    assert manifest["rows"] == 3 and manifest["mode"]["resume"] and set(io.load_json(f"{folder}/stats.json", spark)["timings"]) == set(STAGES)
    over = Pipeline(spark, config, generator=generate, folder=folder, mode=RunMode(overwrite=True))
    over.run_stage("generate_128")
    assert calls.value == made + 2 * 3 * 4


def test_same_result_in_one_plan_and_by_stages(spark, docs, tmp_path):
    config = P.from_dict(P.PipelineConfig, CONFIG)
    key = lambda df: sorted(map(str, df.select("source_text", "target_text").collect()))
    assert key(Pipeline(spark, config).run(docs)) == key(Pipeline(spark, config, folder=str(tmp_path / "x")).run(docs))


def test_a_stage_without_its_input_says_so(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="run the stage"):
        Pipeline(spark, P.PipelineConfig(), folder=str(tmp_path)).run_stage("select_sources")
    with pytest.raises(ValueError, match="unknown stage"):
        Pipeline(spark, P.PipelineConfig(), folder=str(tmp_path)).run_stage("nothing")


def test_limits_and_shards(spark, docs):
    assert [RunMode().documents(5), RunMode(limit=7).documents(5), RunMode(dry_run=True).documents(), RunMode(dry_run=True, limit=3).documents()] == [5, 7, 1000, 3]
    config = P.from_dict(P.PipelineConfig, CONFIG)
    limited = Pipeline(spark, config, mode=RunMode(limit=4)).sample_sources(docs)
    assert limited.count() == 4 and limited.select("madlad.doc_id").distinct().count() <= 4
    parts = [set(r[0] for r in Pipeline(spark, config, mode=RunMode(shard=k, shards=3)).sample_sources(docs).select("madlad.doc_id").collect()) for k in range(3)]
    assert not (parts[0] & parts[1] or parts[1] & parts[2] or parts[0] & parts[2])


def test_command_line(spark, docs, tmp_path):
    import json

    docs.write.parquet(str(tmp_path / "in.parquet"))
    (tmp_path / "c.json").write_text(json.dumps(CONFIG | {"output": "made"}))
    args = ["run", "--config", str(tmp_path / "c.json"), "--input", str(tmp_path / "in.parquet")]
    assert main([*args, "--stage", "sample_sources", "--limit", "5"]) == 0
    # a relative output counts from the configuration file
    assert (tmp_path / "made" / "sampled_sources" / "_SUCCESS").exists()
    assert main([*args, "--stage", "export"]) == 1


def test_split_command(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text("".join(f'{{"id": {i}, "t": "é{i}"}}\n' for i in range(40)))
    assert main(["split", str(path), "--eval-ratio", "0.1"]) == 0
    parts = {p: spark.read.json(str(tmp_path / f"rows_{p}")) for p in ("train_90", "eval_10")}
    assert parts["eval_10"].count() == 4 and parts["train_90"].unionByName(parts["eval_10"]).select("id").distinct().count() == 40
    assert main(["split", str(path), "--eval-ratio", "0.1"]) == 1
    assert main(["split", str(path), "--eval-ratio", "0.1", "--force"]) == 0 and main(["split", str(path), "--eval-ratio", "2"]) == 1


def test_tables_are_forgotten(spark):
    import os

    from lingloom import session as SE

    kept, gone = SE.materialize(spark.range(3).toDF("a")), SE.materialize(spark.range(4).toDF("a"))
    path = gone.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    SE.forget(gone, spark.range(2))
    assert not os.path.exists(path) and kept.count() == 3


def test_capped_corpus_keeps_the_first_by_key(spark):
    df = spark.createDataFrame([(i % 7, f"t{i}") for i in range(30)] + [(None, "n")], "k int, text string")
    for most in (1, 5, 6, 20, 31, 50):
        got = sorted([(r["k"] is not None, r["k"] or 0) for r in io.corpus(spark, df, most=most, order="k").collect()])
        assert got == sorted([(r["k"] is not None, r["k"] or 0) for r in df.collect()])[:most]


def test_files_on_any_file_system(spark, tmp_path):
    path = f"file://{tmp_path}/deep/er/manifest.json"
    io.write_json_atomic(path, {"ü": [1]}, spark)
    io.write_json_atomic(path, {"ü": [2]}, spark)
    assert io.load_json(path, spark) == {"ü": [2]} and io.load_json(f"{path}.none", spark) == {}
    assert [p.name for p in (tmp_path / "deep" / "er").iterdir() if not p.name.startswith(".")] == ["manifest.json"]


def test_names_of_split_parts():
    assert io.split_paths("/d/rows.jsonl", 0.05) == {"train": "/d/rows_train_95", "eval": "/d/rows_eval_5"}
    assert io.split_paths("rows.jsonl.gz", 0.125, "out", evaluation="e")["train"] == "out/rows_train_87p5"


def test_logs_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5)], "rollout_idx int, adv_mean double")
    io.append_log(rows, str(tmp_path), "rollout", 1)
    io.append_log(rows, str(tmp_path), "rollout", 2)
    assert sorted(r["update"] for r in spark.read.parquet(str(tmp_path / "rollout")).collect()) == [1, 2]
    with pytest.raises(ValueError):
        io.append_log(rows, str(tmp_path), "other", 1)


@pytest.mark.parametrize("ratio", [0.01, 0.3])
def test_cuts_in_digit_groups_of_any_size(spark, ratio):
    rows = spark.range(3000).withColumnRenamed("id", "k").withColumn("h", B.order_key(1, "x", F.col("k")))
    k = int(3000 * ratio)
    cut = B.find_cut(rows, "h", k, edge=3)
    d = F.substring("h", 1, len(cut.digits))
    assert len(cut.digits) > 3 or rows.where(d == cut.digits).count() <= 3
    assert rows.where(d < cut.digits).count() + cut.rest == k
    assert B.find_cut(rows, "h", 3001) is None


def test_batches_with_replacement(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    got = B.sample_batch(df, "k", 6, 1, 1).collect()
    assert len(got) == 6 and len({r["draw"] for r in got}) == 6
    assert B.sample_batch(df, "k", 10, 1, 1).count() == 10 and B.sample_batch(df, "k", 99, 1, 1).count() == 10


GOOD = {"data": {"train_file": "t", "source_lang_code": "en", "target_lang_code": "ko"}}


@pytest.mark.parametrize("change,message", [
    ({}, None), ({"train": {"learning_rate": 1e-3}}, "learning_rate"), ({"train": {"global_batch_size": 0}}, "positive"), ({"data": {"train_file": "missing"}}, "not found"),
    ({"data": {"source_lang_code": " "}}, "source language"), ({"data": {"prompt_template": "{text}"}}, "lacks"), ({"train": {"expected_world_size": 3}}, "multiple"), ({"data": {"max_eval_samples": 0}}, "max_eval"),
])
def test_training_setups(change, message):
    values = {s: GOOD.get(s, {}) | change.get(s, {}) for s in ("data", "train")}
    setup = P.from_dict(P.TrainingSetup, values)
    if message is None:
        assert P.validate_training(setup, lambda p: p == "t") is setup
    else:
        with pytest.raises(ValueError, match=message):
            P.validate_training(setup, lambda p: p == "t")


@pytest.mark.parametrize("change,message", [
    ({}, None), ({"policy": {"updates": 0}}, "positive"), ({"policy": {"algorithm": "ppo"}}, "algorithm"), ({"reward": {"overlap_policy": "x"}}, "overlap"), ({"policy": {"policy_gpus": [0], "reference_gpus": [0]}}, "share"),
    ({"reward": {"first": {"enabled": False}, "second": {"enabled": False}}}, "no reward"), ({"policy": {"policy_gpus": [1]}, "reward": {"first": {"device": "cuda:1"}}}, "sits on"),
    ({"reward": {"first": {"device": "cuda"}, "second": {"device": "cuda:0"}}}, "one GPU"), ({"data": {"dataset": "d", "train_split": " "}}, "train_split"),
])
def test_policy_setups(change, message):
    setup = P.from_dict(P.PolicySetup, {"data": {"train_file": "t"}} | change)
    if message is None:
        assert P.validate_policy(setup, lambda p: p == "t") is setup
    else:
        with pytest.raises(ValueError, match=message):
            P.validate_policy(setup, lambda p: p == "t")


def test_stub_scorer_of_spans(spark):
    class One:
        def score(self, s, c, r):
            return [(1.0, [(0, 1, "MINOR", 0.5)])] * len(s)

    got = spark.createDataFrame([("a", "b", None)], "s string, c string, r string").select(C.span_scorer_udf(One)("s", "c", "r").alias("x")).first()["x"]
    assert got["score"] == 1.0 and got["spans"][0]["severity"] == "MINOR"
