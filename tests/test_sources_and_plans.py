import gzip
import json

import pytest
from pyspark.sql import functions as F

from lingloom.plans import config as P
from lingloom.plans.pipeline import Pipeline, main
from lingloom.sources import examples as EX
from lingloom.sources import io
from lingloom.streaming import ingest


def test_jsonl(spark, tmp_path):
    assert io.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a string").count() == 0
    f = tmp_path / "x.jsonl.gz"
    with gzip.open(f, "wt") as out:
        out.write('{"a": "ü"}\n\n{"a": "b"}\n')
    assert sorted(r["a"] for r in io.read_jsonl(spark, str(f), "a string").collect()) == ["b", "ü"]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": "b"}\n{oops\n')
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(bad), "a string").collect()
    assert sum(r["_corrupt"] is not None for r in io.read_jsonl(spark, str(bad), "a string", strict=False).collect()) == 1


def test_formats(spark, tmp_path):
    rows = [{"id": 1, "t": "x"}, {"id": 2, "t": "y"}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text(json.dumps({"data": rows}))
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for name in ("a.json", "b.json", "c.jsonl"):
        assert sorted(r["t"] for r in io.read_any(spark, str(tmp_path / name)).collect()) == ["x", "y"]
    assert io.read_any(spark, str(tmp_path / "c.jsonl"), 1).count() == 1
    with pytest.raises(ValueError):
        io.read_any(spark, "x.csv")


def test_split_files_are_not_overwritten(spark, tmp_path):
    df = spark.range(10).withColumn("part", F.when(F.col("id") < 2, "eval").otherwise("train"))
    paths = io.write_split(df, str(tmp_path))
    assert spark.read.json(paths["eval"]).count() == 2
    with pytest.raises(FileExistsError):
        io.write_split(df, str(tmp_path))
    io.write_split(df, str(tmp_path), force=True)


def test_json_file(tmp_path):
    p = str(tmp_path / "d" / "m.json")
    assert io.load_json(p) == {}
    io.write_json_atomic(p, {"ü": 1})
    assert io.load_json(p) == {"ü": 1}


def test_examples(spark):
    df = spark.createDataFrame([(1, "hello", "안녕", False, "dev"), (2, "bad", "x", True, "dev"), (3, " ", "x", False, "dev"), (4, "z", " ", None, "test")], "id int, source string, target string, is_bad_source boolean, sp string")
    assert [r["id"] for r in EX.load_examples(df).orderBy("id").collect()] == ["1", "4"]
    assert [r["id"] for r in EX.load_examples(df, EX.ExampleFields(split="sp"), "test").collect()] == ["4"]
    text = spark.createDataFrame([("1", "a", "false"), ("2", "b", "yes")], "id string, source string, is_bad_source string")
    assert [r["id"] for r in EX.load_examples(text).collect()] == ["1"]


def test_config():
    c = P.from_dict(P.PipelineConfig, {"select": {"top_n": 3}, "output": "x"})
    assert c.select.top_n == 3 and c.select.num_candidates == 4
    with pytest.raises(ValueError, match="unknown keys"):
        P.from_dict(P.PipelineConfig, {"selekt": {}})
    with pytest.raises(ValueError, match="split"):
        P.validate(P.from_dict(P.PipelineConfig, {"data": {"split": "dirty"}}))
    assert P.accumulation_steps(16, 1, 8) == 2
    with pytest.raises(ValueError):
        P.accumulation_steps(15, 1, 8)
    assert P.resolve_path("a/b", "/x/c.json") == "/x/a/b" and P.resolve_path("s3://b/k", "/x/c.json") == "s3://b/k"


DOCS = [(f"d{i}", "\n".join(f"This is line number {j} of document {i}, which is long enough to stay." for j in range(6))) for i in range(4)]


def test_pipeline_with_folder(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    config = P.from_dict(P.PipelineConfig, {"data": {"sample_pool_size": 12}, "select": {"top_n": 3, "num_candidates": 4}, "filters": {"max_copy_overlap": 1.0}})
    p = Pipeline(spark, config, folder=str(tmp_path / "run"))
    first = p.run(docs).orderBy("source_text").collect()
    assert len(first) == 3 and io.load_json(str(tmp_path / "run/manifest.json"))["rows"] == 3
    assert p.run(docs).orderBy("source_text").collect() == first  # a rerun replaces, it does not append
    assert spark.read.parquet(str(tmp_path / "run/final_candidates_topk")).count() == 6


def test_judge_only_sees_what_the_rules_pass(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    config = P.from_dict(P.PipelineConfig, {"data": {"sample_pool_size": 12}, "select": {"top_n": 3}, "filters": {"max_copy_overlap": 1.0, "judge": True}})
    judge = lambda s, h: F.lit('{"pass": false, "reason_code": "meaning", "notes": ""}')
    p = Pipeline(spark, config, judge=judge)
    best, _ = p.score_select_best(p.generate_candidates(p.select_sources(p.prefilter_score(p.sample_sources(docs)))))
    passed, rejected = p.format_filter(best)
    assert passed.count() == 0 and {r["filters"]["reason_code"] for r in rejected.collect()} == {"meaning"}


def test_command_line_fails_with_one(spark, tmp_path):
    assert main(["run", "--config", str(tmp_path / "none.json"), "--input", "x.parquet"]) == 1


def test_stream_segments_each_document_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame(DOCS[:2], "doc_id string, text string").write.parquet(src)
    run = lambda: ingest.ingest_segments(ingest.document_stream(spark, src, "doc_id string, text string"), out, ck).awaitTermination()
    run()
    n = spark.read.parquet(out).count()
    spark.createDataFrame(DOCS[2:], "doc_id string, text string").write.mode("append").parquet(src)
    run()
    assert n == 12 and spark.read.parquet(out).count() == 24


def test_full_pipeline_leaves_no_segment_out(spark, tmp_path):
    from lingloom import queries as Q

    rows = [(i, "\n".join(f"This is line number {j} of document {i}, which is long enough to stay." for j in range(6))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = Q.FLAGSHIP(spark, str(tmp_path)).collect()
    assert len({r["source_text"] for r in out if "\n" not in r["source_text"]}) == 360 and len(out) == 420
    assert sorted(r["selection_rank"] for r in out) == list(range(1, 421))
