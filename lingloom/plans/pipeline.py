"""The corpus pipeline: segments, balanced pool, prefilter, selection, candidates, choice, filters, export.

Each stage is DataFrame to DataFrame and lazy. With a folder, stages are written
and read again, so that calls of an external generator or scorer are never
repeated when lineage is recomputed, and a rerun replaces what it made before.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingloom.functions import text as X
from lingloom.functions.lang import ordered_distinct
from lingloom.operators import candidates as C
from lingloom.operators import filters as R
from lingloom.operators import sample as B
from lingloom.operators import segment as G
from lingloom.operators import tables as KV
from lingloom.operators.stats import RunStats
from lingloom.plans.config import PipelineConfig, load, validate
from lingloom.session import materialize
from lingloom.sources import io

Generator = Callable[[Column, Column, Column], Column]
STAGES = ["sample_sources", "prefilter_score", "select_sources", "generate_candidates", "score_select_best", "format_filter", "export"]
ALIASES = {"generate_128": "generate_candidates", "score_128_select_best": "score_select_best"}


TABLES = {
    "sample_sources": ["sampled_sources"], "prefilter_score": ["prefilter_completions", "prefilter_candidates"], "select_sources": ["selected_sources"], "generate_candidates": ["generated_candidates"],
    "score_select_best": ["scored_candidates", "scored_best", "final_candidates_topk"], "format_filter": ["judged", "filtered"], "export": ["final_dataset"],
}
DRY_LIMIT = 1000  # documents of a dry run without a limit of its own


@dataclass(frozen=True)
class RunMode:
    """resume: keep what is finished, ask for the rest only; overwrite: make everything again; limit: documents of this
    shard (and segments of the pool) at most; shard of shards: the part of the documents that this run takes."""

    resume: bool = False
    overwrite: bool = False
    dry_run: bool = False
    limit: int | None = None
    shard: int | None = None
    shards: int | None = None

    def documents(self, default: int | None = None) -> int | None:
        if self.limit is not None:
            return self.limit
        return (default or DRY_LIMIT) if self.dry_run else default


class Pipeline:
    """``generator`` maps (text, source id, candidate index) to a text, ``scorer`` (source, candidate) to a number, ``judge`` (source, candidate) to raw JSON.

    With a folder each stage is written. A table counts as finished once its
    marker of success is there; a resumed run reads finished ones, and of the
    external calls only those that its caches do not hold are made: completions,
    candidates and scores are kept by key as they come.
    """

    def __init__(self, spark: SparkSession, config: PipelineConfig, generator: Generator = C.stub_candidate, scorer=X.heuristic_score, judge=None, folder: str | None = None, mode: RunMode = RunMode(), stats: RunStats | None = None):
        self.spark, self.config, self.folder, self.mode = spark, validate(config), folder, mode
        self.generator, self.scorer, self.judge = generator, scorer, judge
        self.stats = stats or RunStats()

    def done(self, table: str) -> bool:
        return self.folder is not None and io._exists(self.spark, f"{self.folder}/{table}/_SUCCESS")

    def stored(self, table: str) -> DataFrame:
        if not self.done(table):
            raise FileNotFoundError(f"{self.folder}/{table}: run the stage that makes it first")
        return self.spark.read.parquet(f"{self.folder}/{table}")

    def keep(self, df: DataFrame, stage: str) -> DataFrame:
        if self.folder is None:
            return df
        path = f"{self.folder}/{stage}"
        if self.mode.resume and not self.mode.overwrite and self.done(stage):
            return self.spark.read.schema(df.schema).parquet(path)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def cached(self, asked: DataFrame, keys: list[str], name: str, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``call(asked)`` for the rows whose keys the cache of that name does not hold; answers are added to it in parts of ``shards_of_calls``.

        Without a folder there is no cache. A run that was stopped between parts
        resumes with the parts that are left.
        """
        if self.folder is None:
            return call(asked)
        path = f"{self.folder}/cache/{name}"
        if self.mode.overwrite or not self.mode.resume:
            io.remove(self.spark, path)
        part = F.pmod(F.xxhash64(*keys), F.lit(self.config.call_parts)).cast("int")
        shape = call(asked.limit(0)).schema
        for k in range(self.config.call_parts):
            mine = asked.where(part == k)
            known = self.spark.read.parquet(path).select(*keys) if io._exists(self.spark, path) else None
            todo = mine if known is None else KV.misses(mine, known, keys)
            call(todo).write.mode("append").parquet(path)
        answers = self.spark.read.schema(shape).parquet(path).dropDuplicates(keys)
        # what an earlier run asked and this one does not is left in the cache
        return answers.join(asked.select(*keys), keys, "left_semi").select(*shape.names)

    def sample_sources(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        c = self.config
        if self.mode.shards:
            docs = docs.where(X.shard_of(F.col(key).cast("string"), self.mode.shards) == (self.mode.shard or 0))
        most = self.mode.documents(None)
        docs = io.corpus(self.spark, docs, most=most if most is not None else c.data.max_scan_docs, order=key)
        size = min(c.data.sample_pool_size, most) if most else c.data.sample_pool_size
        sc = G.SegmentConfig(c.segment.min_chars, c.segment.max_chars, c.segment.merge_short_lines, c.segment.noise_filter, c.segment.blob_max_tokens)
        target = ordered_distinct(c.data.target_langs)[0]
        rows = lambda s: G.source_rows(s, c.data.source_lang, target, c.sample.boundaries, c.data.lang, c.data.split)
        # read four times (sentences and blobs, each for its histogram and its sample), mostly two columns of it
        whole = materialize(G.segmented(docs, key, text, sc))
        blobs = rows(G.blob_rows(whole, sc)) if c.segment.blobs else None
        pool = B.pool_mix(rows(G.segment_rows(whole)), blobs, size, c.data.sentence_ratio, B.BalancedConfig(size, c.sample.seed, c.sample.oversample, tuple(c.sample.boundaries)))
        return self.keep(pool, "sampled_sources")

    def prefilter_score(self, sources: DataFrame) -> DataFrame:
        """A greedy and a sampled completion of each source (indices -1 and 0) and their scores."""
        modes = F.explode(F.array(F.struct(F.lit("greedy").alias("mode"), F.lit(-1).alias("i")), F.struct(F.lit("sample").alias("mode"), F.lit(0).alias("i"))))
        asked = sources.select("source_id", "source_text", modes.alias("m")).select("source_id", "source_text", F.col("m.mode").alias("mode"), F.col("m.i").alias("i"))
        made = self.cached(asked, ["source_id", "mode"], "completions", lambda d: d.select("source_id", "mode", "source_text", self.generator(F.col("source_text"), F.col("source_id"), F.col("i")).alias("text")))
        scored = self.cached(made, ["source_id", "mode"], "completion_scores", lambda d: d.select("source_id", "mode", "text", self.scorer(F.col("source_text"), F.col("text")).alias("score")))
        done = self.keep(scored, "prefilter_completions")
        return self.keep(C.prefilter_rows(sources, done), "prefilter_candidates")

    def select_sources(self, prefiltered: DataFrame) -> DataFrame:
        return self.keep(C.top_sources(prefiltered, F.col("prefilter.improvement"), "source_id", self.config.select.top_n), "selected_sources")

    def generate_candidates(self, selected: DataFrame) -> DataFrame:
        # the ranked sources are one partition; spread, or all candidates were made and scored in one task
        spread = selected.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "source_id")
        rows = C.expand_candidates(spread, self.config.select.num_candidates)
        call = lambda d: d.withColumn("candidate_text", self.generator(F.col("source_text"), F.col("source_id"), F.col("candidate_index")))
        return self.keep(self.cached(rows, ["source_id", "candidate_index"], "candidates", call), "generated_candidates")

    def score_select_best(self, generated: DataFrame) -> tuple[DataFrame, DataFrame]:
        call = lambda d: d.withColumn("score", self.scorer(F.col("source_text"), F.col("candidate_text")))
        scored = self.keep(self.cached(generated, ["source_id", "candidate_index"], "candidate_scores", call), "scored_candidates")
        top = C.top_per_source(scored, F.col("score"), self.config.select.store_top_k)
        keep = ["source_id", "pair_id", "source_lang_code", "target_lang_code", "source_text", "selection", "madlad"]
        best = top.where("rank = 1").select(*keep, F.col("candidate_text").alias("target_text"), F.col("score").alias("metricx_qe_score_best"), "candidate_index")
        return self.keep(best, "scored_best"), self.keep(top.select("source_id", "candidate_index", "candidate_text", F.col("score").alias("metricx_qe_score")), "final_candidates_topk")

    def format_filter(self, best: DataFrame) -> tuple[DataFrame, DataFrame]:
        f = self.config.filters
        config = R.FilterConfig(f.min_chars, f.max_chars, f.length_ratio_min, f.length_ratio_max, f.max_copy_overlap, list(f.blocked))
        judged = best
        raw = None
        if f.judge and self.judge is not None:
            # the judge is an external call: asked after the rules, in a stage of its own
            judged = self.keep(best.withColumn("_raw", F.when(R.rule_verdict(F.col("source_text"), F.col("target_text"), config)["passed"], self.judge(F.col("source_text"), F.col("target_text")))), "judged")
            raw = F.col("_raw")
        if f.rule_based:
            out = R.apply_filters(judged, "source_text", "target_text", raw, config, f.fail_policy)
        else:
            verdict = R.judge_verdict(raw, f.fail_policy) if raw is not None else F.struct(F.lit(True).alias("passed"), F.lit("pass").alias("reason_code"), F.lit("").alias("notes"))
            out = judged.withColumn("filters", F.struct(verdict["passed"].alias("passed"), verdict["reason_code"].alias("reason_code"), verdict["notes"].alias("notes"), F.lit("llm_judge").alias("type")))
        return R.route(self.keep(out.drop("_raw"), "filtered"))

    def export(self, passed: DataFrame) -> DataFrame:
        columns = ["pair_id", "source_lang_code", "target_lang_code", "source_text", "target_text", "metricx_qe_score_best", "selection", "madlad", "filters"]
        final = self.keep(passed.select(*columns), "final_dataset")
        if self.folder is not None:
            io.write_json_atomic(f"{self.folder}/manifest.json", {"rows": final.count(), "config": asdict(self.config), "mode": asdict(self.mode), "stages": STAGES}, self.spark)
        return final

    def run_stage(self, stage: str, docs: DataFrame | None = None):
        """One stage by name, from the tables of the stages before it; timed, and counted as it passes."""
        name = ALIASES.get(stage, stage)
        if name not in STAGES:
            raise ValueError(f"unknown stage {stage}; known: {', '.join([*STAGES, *ALIASES])}")
        with self.stats.time(name):
            if name == "sample_sources":
                if docs is None:
                    raise ValueError("sample_sources needs an input")
                out = self.sample_sources(docs)
            elif name == "format_filter":
                out, _ = self.format_filter(self.stored("scored_best"))
            elif name == "export":
                out = self.export(self.stored("filtered").where("filters.passed"))
            else:
                source = {"prefilter_score": "sampled_sources", "select_sources": "prefilter_candidates", "generate_candidates": "selected_sources", "score_select_best": "generated_candidates"}[name]
                out = getattr(self, name)(self.stored(source))
        if self.folder is not None:
            for table in TABLES[name]:
                if self.done(table):
                    self.stats.counters[f"{name}.{table}"] = self.stored(table).count()
            self.stats.write(f"{self.folder}/stats.json", self.spark)
            self.progress(name)
        return out

    def progress(self, stage: str) -> None:
        """The items that a stage has finished, one row each, in the progress table."""
        table = {"sample_sources": "sampled_sources", "prefilter_score": "prefilter_candidates", "select_sources": "selected_sources", "generate_candidates": "generated_candidates", "score_select_best": "scored_best", "format_filter": "filtered"}.get(stage)
        if table is not None:
            rows = self.stored(table).select(F.lit(stage).alias("stage_name"), F.col("source_id").alias("item_id")).distinct()
            rows.write.mode("overwrite").parquet(f"{self.folder}/progress/{stage}")

    def run(self, docs: DataFrame, stage: str = "all") -> DataFrame:
        """All stages, or one. With a folder each reads what the one before it wrote; without one they are one lazy plan."""
        if self.folder is not None:
            out = None
            for name in STAGES if stage == "all" else [stage]:
                out = self.run_stage(name, docs)
            return out
        best, _ = self.score_select_best(self.generate_candidates(self.select_sources(self.prefilter_score(self.sample_sources(docs)))))
        passed, _ = self.format_filter(best)
        return self.export(passed)


def split_main(argv: list[str]) -> int:
    """split INPUT [--key K --eval-ratio R --seed S --output-dir D --train-output P --eval-output P --force]: exit code 1 on failure."""
    parser = argparse.ArgumentParser(prog="lingloom split")
    parser.add_argument("input")
    parser.add_argument("--key", default="id")
    parser.add_argument("--eval-ratio", type=float, default=0.05)
    parser.add_argument("--seed", type=int, default=42)
    for path in ("--output-dir", "--train-output", "--eval-output"):
        parser.add_argument(path)
    parser.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)
    try:
        if not 0 < args.eval_ratio < 1:
            raise ValueError("the share of the evaluation part must be between 0 and 1")
        spark = SparkSession.builder.appName("lingloom").getOrCreate()
        rows = B.split_train_eval(io.read_any(spark, args.input), args.key, args.eval_ratio, args.seed)
        made = io.write_split(rows, "", args.force, io.split_paths(args.input, args.eval_ratio, args.output_dir, args.train_output, args.eval_output))
        print(", ".join(f"{k}: {v}" for k, v in made.items()))
        return 0
    except Exception as e:  # noqa: BLE001
        print(f"failed: {e}")
        return 1


def main(argv: list[str] | None = None) -> int:
    """run --config FILE --input PATH [--stage S --resume --overwrite --dry-run --limit N --shard-id K --num-shards N]: exit code 1 on failure."""
    if (argv or sys.argv[1:])[:1] == ["split"]:
        return split_main((argv or sys.argv[1:])[1:])
    parser = argparse.ArgumentParser(prog="lingloom")
    parser.add_argument("command", choices=["run", "split"])
    parser.add_argument("--config", required=True)
    parser.add_argument("--input", required=True)
    parser.add_argument("--stage", default="all", choices=["all", *STAGES, *ALIASES])
    for flag in ("--resume", "--overwrite", "--dry-run"):
        parser.add_argument(flag, action="store_true")
    for number in ("--limit", "--shard-id", "--num-shards"):
        parser.add_argument(number, type=int)
    args = parser.parse_args(argv)
    try:
        spark = SparkSession.builder.appName("lingloom").getOrCreate()
        config = load(args.config)
        mode = RunMode(args.resume, args.overwrite, args.dry_run, args.limit, args.shard_id, args.num_shards)
        Pipeline(spark, config, folder=config.output, mode=mode).run(io.read_any(spark, args.input), args.stage)
        return 0
    except Exception as e:  # noqa: BLE001
        print(f"failed: {e}")
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
