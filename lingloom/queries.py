"""One query for each operator, over whole tables, with the SQL that an independent engine runs beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingloom import oracle as O
from lingloom.functions import lang as LG
from lingloom.functions import text as X
from lingloom.functions import tokens as K
from lingloom.operators import advantage as A
from lingloom.operators import candidates as C
from lingloom.operators import external as EXT
from lingloom.operators import filters as R
from lingloom.operators import sample as B
from lingloom.operators import segment as G
from lingloom.operators import sft as S
from lingloom.operators import tables as KV
from lingloom.operators import training as TR
from lingloom.plans import config as P
from lingloom.plans.pipeline import Pipeline, RunMode
from lingloom.session import materialize, shared_dir
from lingloom.sources import examples as EX
from lingloom.sources import io as IO
from lingloom.streaming import ingest as ST

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "text")


def pairs(spark, sf) -> DataFrame:
    """row_id, src, tgt, s, h of the exported pairs, once a row_id."""
    f = t(spark, sf, "final_dataset").groupBy("row_id").agg(F.max(F.struct("pair_id", "source_text", "target_text")).alias("x"))
    part = lambda k: F.get(F.split("x.pair_id", "->"), F.lit(k))
    return f.select("row_id", part(0).alias("src"), part(1).alias("tgt"), F.coalesce("x.source_text", F.lit("")).alias("s"), F.coalesce("x.target_text", F.lit("")).alias("h"))


PAIRS = """pairs AS (SELECT row_id, split_part(any_value(pair_id), '->', 1) AS src, split_part(any_value(pair_id), '->', 2) AS tgt, coalesce(any_value(source_text), '') AS s,
  coalesce(any_value(target_text), '') AS h FROM final_dataset GROUP BY row_id)"""


def candidates_of(spark, sf) -> DataFrame:
    """(source_id, candidate_index, source_text, candidate_text, score_sample), once a key."""
    p = t(spark, sf, "prefilter_candidates").select("source_id", "candidate_index", "source_text", "prefilter.sample_text", "prefilter.score_greedy", "prefilter.score_sample")
    return p.groupBy("source_id", "candidate_index").agg(
        F.max("source_text").alias("source_text"), F.max(F.coalesce("sample_text", F.lit(""))).alias("candidate_text"), F.max("score_greedy").alias("score_greedy"), F.max("score_sample").alias("score_sample")
    )


CANDIDATES = """cand AS (SELECT source_id, candidate_index, max(source_text) AS source_text, max(coalesce(prefilter.sample_text, '')) AS candidate_text,
  max(prefilter.score_greedy) AS score_greedy, max(prefilter.score_sample) AS score_sample FROM prefilter_candidates GROUP BY source_id, candidate_index)"""


# ---- text functions -------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({O.norm('text')}) AS norm_md5, length({O.norm('text')}) AS norm_len FROM documents")
def normalize_text(spark, sf):
    n = X.normalize_text(F.col("text"))
    return docs(spark, sf).select("doc_id", F.md5(F.encode(n, "UTF-8")).alias("norm_md5"), F.length(n).cast("long").alias("norm_len"))


@query(f"SELECT doc_id, {O.approx('text')}::BIGINT AS approx_len FROM documents")
def approx_len(spark, sf):
    return docs(spark, sf).select("doc_id", X.approx_token_length(F.col("text")).cast("long").alias("approx_len"))


NOISY = ["", "  ", "https://a.example/b", "www.x.example", "see https://a.example", "<b><i><u>x", "<p>a</p> <p>b</p>", "def f(x): return x", "a first class ticket", "plain words", "classy éclass", "};};"]


@query("SELECT i, v, " + O.noise("v") + " AS noise FROM (VALUES " + ", ".join(f"({i}, {O.q(v)})" for i, v in enumerate(NOISY)) + ") AS x(i, v)")
def noise_rules(spark, sf):
    rows = spark.createDataFrame(list(enumerate(NOISY)), "i int, v string")
    return rows.select("i", "v", X.is_noise(F.col("v")).alias("noise"))


@query("WITH " + O.lines() + f" SELECT doc, count(*) AS lines, count(*) FILTER (WHERE {O.noise('line')}) AS noisy FROM raw_lines GROUP BY doc")
def noise_flags(spark, sf):
    lines = G.lines_of(docs(spark, sf))
    return lines.groupBy("doc").agg(F.count("*").alias("lines"), F.count_if(X.is_noise(F.col("line"))).alias("noisy"))


@query(f"SELECT doc_id, sha256('{{\"key\": \"' || doc_id || '\"}}') AS h, (('0x' || substr(sha256('{{\"key\": \"' || doc_id || '\"}}'), 1, 12))::BIGINT % 8) AS shard FROM documents")
def shard_filter(spark, sf):
    key = F.col("doc_id").cast("string")
    return docs(spark, sf).select("doc_id", X.stable_hash(key).alias("h"), X.shard_of(key, 8).alias("shard"))


@query("SELECT event_id, regexp_replace(v, '\\\\r\\\\n|\\\\n|\\\\r', chr(10), 'g') AS restored, len(regexp_extract_all(v, '\\\\r\\\\n|\\\\n|\\\\r')) AS n FROM (SELECT event_id, event_type || '\\n' || user_id || '\\r\\n' || value::VARCHAR AS v FROM (SELECT event_id, event_type, user_id, event_id % 7 AS value FROM events))")
def escaped_newlines(spark, sf):
    e = t(spark, sf, "events")
    v = F.concat("event_type", F.lit("\\n"), F.col("user_id").cast("string"), F.lit("\\r\\n"), (F.col("event_id") % 7).cast("string"))
    return e.select("event_id", X.restore_newlines(v).alias("restored"), X.escaped_newlines(v).cast("long").alias("n"))


@query(f"WITH {PAIRS} SELECT row_id, CASE WHEN length(h) > 40 THEN substr(h, 1, 40) || ' ... [truncated ' || (length(h) - 40) || ' chars]' ELSE h END AS cut FROM pairs")
def log_preview(spark, sf):
    return pairs(spark, sf).select("row_id", X.truncate_for_log(F.col("h"), 40).alias("cut"))


@query(f"WITH {PAIRS} SELECT row_id, 'source: ' || s || ' candidate: ' || h AS input FROM pairs")
def scorer_inputs(spark, sf):
    return pairs(spark, sf).select("row_id", X.scorer_input(F.col("s"), F.col("h")).alias("input"))


@query(f"SELECT DISTINCT target_lang_code AS raw, {O.code('target_lang_code')} AS code FROM final_dataset WHERE target_lang_code IS NOT NULL")
def lang_codes(spark, sf):
    f = t(spark, sf, "final_dataset").where("target_lang_code is not null").select(F.col("target_lang_code").alias("raw")).distinct()
    return f.select("raw", LG.normalize_code(F.col("raw")).alias("code"))


@query(f"SELECT DISTINCT source_lang_code AS raw, {O.name('source_lang_code')} AS name FROM sampled_sources WHERE source_lang_code IS NOT NULL")
def lang_names(spark, sf):
    f = t(spark, sf, "sampled_sources").where("source_lang_code is not null").select(F.col("source_lang_code").alias("raw")).distinct()
    return f.select("raw", LG.language_name(F.col("raw")).alias("name"))


# ---- segmentation ---------------------------------------------------------------------------------------------------


@query("WITH " + O.lines() + " SELECT doc, pos, line FROM raw_lines")
def lines_split(spark, sf):
    return G.lines_of(docs(spark, sf)).select("doc", F.col("pos").cast("long").alias("pos"), "line")


@query("WITH " + O.lines(20, 200) + " SELECT doc, pos, line FROM raw_lines")
def long_line_split(spark, sf):
    return G.lines_of(docs(spark, sf), config=G.SegmentConfig(max_chars=200)).select("doc", F.col("pos").cast("long").alias("pos"), "line")


@query("WITH " + O.lines(40) + " SELECT doc, pos, line FROM merged")
def lines_merged(spark, sf):
    lines = docs(spark, sf).select(F.col("doc_id").alias("doc"), F.explode_outer(G.merged(G.raw_lines(F.col("text")), 40)).alias("m")).where("m is not null")
    return lines.select("doc", F.col("m.pos").cast("long").alias("pos"), "m.line")


@query("WITH " + O.segments() + " SELECT source_id, source_text, length_approx::BIGINT AS length_approx, k::BIGINT AS segment_index, char_len::BIGINT AS char_len FROM segs")
def segments(spark, sf):
    s = G.segments(docs(spark, sf))
    return s.select("source_id", "source_text", *[F.col(c).cast("long").alias(c) for c in ("length_approx", "segment_index", "char_len")])


@query("WITH " + O.segments() + " SELECT doc, count(*) AS n, sum(length_approx)::BIGINT AS tokens FROM segs GROUP BY doc")
def segment_counts(spark, sf):
    return G.segments(docs(spark, sf)).groupBy(F.col("doc").cast("long").alias("doc")).agg(F.count("*").alias("n"), F.sum("length_approx").alias("tokens"))


@query("WITH RECURSIVE " + O.segments() + O.blobs(128) + " SELECT source_id, md5(source_text) AS text_md5, length_approx::BIGINT AS length_approx, span_from::BIGINT AS span_from, span_to::BIGINT AS span_to, num_segments FROM blobs")
def blobs(spark, sf):
    config = G.SegmentConfig(blob_max_tokens=128)
    b = G.blob_rows(G.segmented(docs(spark, sf), config=config), config)
    longs = [F.col(c).cast("long").alias(c) for c in ("length_approx", "span_from", "span_to", "num_segments")]
    return b.select("source_id", F.md5(F.encode("source_text", "UTF-8")).alias("text_md5"), *longs)


# ---- buckets and samples --------------------------------------------------------------------------------------------


@query("WITH " + O.segments() + f" SELECT {O.bucket('length_approx')}::BIGINT AS bucket, count(*) AS n, sum(length_approx)::BIGINT AS tokens FROM segs GROUP BY 1")
def bucket_hist(spark, sf):
    s = G.segments(docs(spark, sf))
    return s.groupBy(B.bucket_of(F.col("length_approx")).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.sum("length_approx").alias("tokens"))


@query("WITH " + O.segments() + f", c AS (SELECT {O.bucket('length_approx')} AS bucket, count(*) AS seen FROM segs GROUP BY 1) SELECT bucket::BIGINT AS bucket, seen, least(seen, [34, 33, 33, 33, 33, 33, 33, 33, 33][bucket + 1])::BIGINT AS kept FROM c WHERE true")
def bucket_stats(spark, sf):
    s = G.segments(docs(spark, sf))
    out = B.bucket_stats(s, B.bucket_of(F.col("length_approx")), B.BalancedConfig(size=298))
    return out.select(F.col("bucket").cast("long").alias("bucket"), "seen", "kept")


@query("WITH " + O.segments() + "," + O.balanced("(SELECT source_id, length_approx FROM segs)", 300, 7, "pick") + " SELECT source_id FROM pick")
def bucket_sample(spark, sf):
    s = G.segments(docs(spark, sf)).select("source_id", "length_approx")
    return B.balanced_sample(s, "source_id", B.bucket_of(F.col("length_approx"))).select("source_id")


@query("WITH RECURSIVE " + O.segments() + O.blobs() + "," + O.balanced("(SELECT source_id, length_approx FROM segs)", 150, 7, "sa") + "," + O.balanced("(SELECT source_id, length_approx FROM blobs)", 150, 8, "bl")
       + " SELECT source_id, 'sentence' AS kind FROM sa UNION ALL SELECT source_id, 'blob' FROM bl")
def pool_mix(spark, sf):
    whole = materialize(G.segmented(docs(spark, sf)))
    return B.pool_mix(G.segment_rows(whole), G.blob_rows(whole), 300, 0.5, B.BalancedConfig()).select("source_id", "kind")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('3:split:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= greatest(1, least(n - 1, round_even(n * 0.05, 0))) THEN 'eval' ELSE 'train' END AS part FROM r""")
def split_train_eval(spark, sf):
    return B.split_train_eval(docs(spark, sf).select("doc_id"), "doc_id", 0.05, 3)


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('3:epoch1:' || doc_id), doc_id) - 1 AS p FROM documents)
SELECT doc_id, p // 64 AS batch_id, p % 64 AS slot FROM r""")
def epoch_batches(spark, sf):
    return B.epoch_batches(docs(spark, sf).select("doc_id"), "doc_id", 64, 3, 1)


# ---- scores, candidates, choices ------------------------------------------------------------------------------------


@query(f"WITH {PAIRS} SELECT row_id, round({O.jaccard('s', 'h')}, 9) AS overlap FROM pairs")
def pair_jaccard(spark, sf):
    return pairs(spark, sf).select("row_id", F.round(X.jaccard_overlap(F.col("s"), F.col("h")), 9).alias("overlap"))


@query(f"WITH {PAIRS} SELECT row_id, round({O.score('s', 'h')}, 9) AS score FROM pairs")
def pair_score(spark, sf):
    return pairs(spark, sf).select("row_id", F.round(X.heuristic_score(F.col("s"), F.col("h")), 9).alias("score"))


class _Stub:
    """A model stand-in: a tenth of the difference in length."""

    def score(self, sources, candidates):
        return [abs(len(a) - len(b)) / 10 for a, b in zip(sources, candidates)]


@query(f"WITH {PAIRS} SELECT row_id, round(least(25.0, abs(length(s) - length(h)) / 10.0), 9) AS score FROM pairs")
def model_score_udf(spark, sf):
    score = C.scorer_udf(_Stub)
    return C.score_once(pairs(spark, sf), ["s", "h"], score).select("row_id", F.round("score", 9).alias("score"))


@query(f"WITH {CANDIDATES} SELECT source_id, candidate_index, round(coalesce(score_greedy, 25.0) - coalesce(CASE WHEN isnan(score_sample) THEN NULL ELSE score_sample END, 25.0), 9) AS improvement FROM cand")
def prefilter_improvement(spark, sf):
    c = candidates_of(spark, sf)
    s = F.coalesce(F.nanvl("score_sample", F.lit(None).cast("double")), F.lit(25.0))
    return c.select("source_id", "candidate_index", F.round(F.coalesce("score_greedy", F.lit(25.0)) - s, 9).alias("improvement"))


@query(f"""WITH {CANDIDATES}, i AS (SELECT source_id, max(round(coalesce(score_greedy, 25.0) - coalesce(CASE WHEN isnan(score_sample) THEN NULL ELSE score_sample END, 25.0), 9)) AS improvement FROM cand GROUP BY source_id)
SELECT source_id, improvement, row_number() OVER (ORDER BY improvement DESC, source_id) AS selection_rank FROM i ORDER BY improvement DESC, source_id LIMIT 100""")
def top_sources(spark, sf):
    i = prefilter_improvement(spark, sf).groupBy("source_id").agg(F.max("improvement").alias("improvement"))
    return C.top_sources(i, F.col("improvement"), "source_id", 100).select("source_id", "improvement", F.col("selection.selection_rank").cast("long").alias("selection_rank"))


_SCORED = f"WITH {CANDIDATES}, sc AS (SELECT source_id, candidate_index, round({O.score('source_text', 'candidate_text')}, 9) AS score FROM cand), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score, candidate_index) AS rank FROM sc)"


def _scored(spark, sf):
    c = candidates_of(spark, sf)
    return c.select("source_id", "candidate_index", F.round(X.heuristic_score(F.col("source_text"), F.col("candidate_text")), 9).alias("score"))


@query(_SCORED + " SELECT source_id, candidate_index, score FROM r WHERE rank = 1")
def best_candidate(spark, sf):
    return C.top_per_source(_scored(spark, sf), F.col("score"), 1).select("source_id", "candidate_index", "score")


@query(_SCORED + " SELECT source_id, candidate_index, score, rank FROM r WHERE rank <= 3")
def topk_candidates(spark, sf):
    return C.top_per_source(_scored(spark, sf), F.col("score"), 3).select("source_id", "candidate_index", "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT DISTINCT source_id FROM sampled_sources), k AS (SELECT source_id, unnest(range(4)) AS candidate_index FROM s)
SELECT k.source_id, k.candidate_index::BIGINT AS candidate_index FROM k ANTI JOIN (SELECT DISTINCT source_id, candidate_index FROM prefilter_candidates) d ON k.source_id = d.source_id AND k.candidate_index = d.candidate_index""")
def candidates(spark, sf):
    s = t(spark, sf, "sampled_sources").select("source_id").distinct()
    done = t(spark, sf, "prefilter_candidates").select("source_id", "candidate_index")
    return C.expand_candidates(s, 4, done).select("source_id", F.col("candidate_index").cast("long").alias("candidate_index"))


@query(f"WITH {CANDIDATES} SELECT source_id, candidate_index, sha256('m' || chr(1) || source_text || chr(1) || 'p' || chr(1) || candidate_index) AS request FROM cand")
def request_keys(spark, sf):
    c = candidates_of(spark, sf)
    return c.select("source_id", "candidate_index", C.request_key("m", F.col("source_text"), "p", F.col("candidate_index")).alias("request"))


@query(f"WITH s AS (SELECT source_id, max(source_text) AS source_text FROM sampled_sources GROUP BY source_id) SELECT source_id, md5({O.stub('source_text', 'source_id', '3')}) AS text_md5 FROM s")
def stub_generation(spark, sf):
    s = t(spark, sf, "sampled_sources").groupBy("source_id").agg(F.max("source_text").alias("source_text"))
    return s.select("source_id", F.md5(F.encode(C.stub_candidate(F.col("source_text"), F.col("source_id"), F.lit(3)), "UTF-8")).alias("text_md5"))


# ---- filters --------------------------------------------------------------------------------------------------------


@query(f"WITH {PAIRS} SELECT row_id, {O.rule_reason('s', 'h')} AS reason_code FROM pairs")
def rule_filter(spark, sf):
    return pairs(spark, sf).select("row_id", R.rule_verdict(F.col("s"), F.col("h"))["reason_code"].alias("reason_code"))


@query(f"WITH {PAIRS} SELECT {O.rule_reason('s', 'h')} AS reason_code, count(*) AS n FROM pairs GROUP BY 1")
def reject_counts(spark, sf):
    return R.reject_counts(R.apply_filters(pairs(spark, sf), "s", "h"))


_RAW = """'noise before {"pass": ' || CASE row_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '"false"' ELSE 'tru' END || ', "reason_code": "r' || (row_id % 5) || '", "notes": "n"} after'"""


@query(f"WITH {PAIRS} SELECT row_id, row_id % 4 = 0 AS passed, CASE WHEN row_id % 4 < 2 THEN 'r' || (row_id % 5) ELSE 'judge_parse_failure' END AS reason_code FROM pairs")
def judge_verdict(spark, sf):
    m = F.col("row_id") % 4
    word = F.when(m == 0, "true").when(m == 1, "false").when(m == 2, '"false"').otherwise("tru")
    raw = F.concat(F.lit('noise before {"pass": '), word, F.lit(', "reason_code": "r'), (F.col("row_id") % 5).cast("string"), F.lit('", "notes": "n"} after'))
    v = R.judge_verdict(raw)
    return pairs(spark, sf).select("row_id", v["passed"].alias("passed"), v["reason_code"].alias("reason_code"))


# ---- keyed tables ---------------------------------------------------------------------------------------------------

_LATEST = "latest AS (SELECT source_id, candidate_index, prefilter.sample_text AS text, written_at FROM prefilter_candidates QUALIFY row_number() OVER (PARTITION BY source_id, candidate_index ORDER BY written_at DESC) = 1)"


def _cache(spark, sf):
    p = t(spark, sf, "prefilter_candidates").select("source_id", "candidate_index", F.col("prefilter.sample_text").alias("text"), "written_at")
    return KV.latest(p, ["source_id", "candidate_index"], "written_at")


@query(f"WITH {_LATEST} SELECT source_id, candidate_index, text FROM latest")
def cache_latest(spark, sf):
    return _cache(spark, sf).select("source_id", "candidate_index", "text")


_ASKED = "asked AS (SELECT DISTINCT source_id, 0 AS candidate_index FROM sampled_sources)"


def _asked(spark, sf):
    return t(spark, sf, "sampled_sources").select("source_id", F.lit(0).alias("candidate_index")).distinct()


@query(f"WITH {_LATEST}, {_ASKED} SELECT a.source_id, l.text FROM asked a JOIN latest l ON a.source_id = l.source_id AND a.candidate_index = l.candidate_index WHERE {O.strip('l.text')} <> ''")
def cache_hits(spark, sf):
    return KV.hits(_asked(spark, sf), _cache(spark, sf), ["source_id", "candidate_index"], X.strip(F.col("text")) != "").select("source_id", "text")


@query(f"WITH {_LATEST}, {_ASKED} SELECT a.source_id FROM asked a ANTI JOIN (SELECT * FROM latest WHERE {O.strip('text')} <> '') l ON a.source_id = l.source_id AND a.candidate_index = l.candidate_index")
def cache_misses(spark, sf):
    return KV.misses(_asked(spark, sf), _cache(spark, sf), ["source_id", "candidate_index"], X.strip(F.col("text")) != "").select("source_id")


@query("SELECT DISTINCT s.source_id FROM sampled_sources s ANTI JOIN prefilter_candidates p ON s.source_id = p.source_id")
def resume_pending(spark, sf):
    done = t(spark, sf, "prefilter_candidates").select(F.lit("prefilter").alias("stage_name"), F.col("source_id").alias("item_id"))
    return KV.pending(t(spark, sf, "sampled_sources").select("source_id").distinct(), done, "prefilter", "source_id")


@query("SELECT 'prefilter' AS stage_name, count(DISTINCT source_id) AS n FROM prefilter_candidates UNION ALL SELECT 'sample', count(DISTINCT source_id) FROM sampled_sources")
def progress_counts(spark, sf):
    rows = lambda n, stage: t(spark, sf, n).select(F.lit(stage).alias("stage_name"), F.col("source_id").alias("item_id"))
    return KV.progress_counts(rows("prefilter_candidates", "prefilter").union(rows("sampled_sources", "sample")))


class _Echo:
    """A generator stand-in: the request in capitals."""

    def complete(self, request):
        return request.upper()


@query(f"WITH {_LATEST}, asked AS (SELECT source_id, max(source_text) AS s FROM sampled_sources GROUP BY source_id) SELECT a.source_id, md5(CASE WHEN l.source_id IS NULL THEN upper(a.source_id) ELSE l.text END) AS text_md5, l.source_id IS NOT NULL AS cached FROM asked a LEFT JOIN (SELECT * FROM latest WHERE candidate_index = 0 AND {O.strip('text')} <> '') l ON a.source_id = l.source_id")
def cached_completions(spark, sf):
    asked = t(spark, sf, "sampled_sources").select("source_id", F.col("source_id").alias("request")).distinct()
    cache = _cache(spark, sf).where("candidate_index = 0").select(F.col("source_id").alias("key"), F.col("text").alias("value"))
    done = EXT.complete_with_cache(asked, "source_id", "request", cache, _Echo)
    return done.select("source_id", F.md5(F.encode("completion", "UTF-8")).alias("text_md5"), "cached")


# ---- prompts, examples, token budget --------------------------------------------------------------------------------


@query(f"WITH {PAIRS} SELECT row_id, {O.SYSTEM} AS system, {O.translate_user('s', 'src', 'tgt')} AS content FROM pairs")
def prompts(spark, sf):
    p = pairs(spark, sf)
    m = S.translate_messages(LG.language_name(F.col("src")), LG.language_name(F.col("tgt")), F.col("src"), F.col("tgt"), F.col("s"))
    return p.select("row_id", m[0]["content"].alias("system"), m[1]["content"].alias("content"))


@query(f"WITH {PAIRS} SELECT row_id, {O.JUDGE} AS system, {O.judge_user('s', 'h', 'src', 'tgt')} AS content FROM pairs")
def judge_prompts(spark, sf):
    p = pairs(spark, sf)
    m = S.judge_messages(LG.language_name(F.col("src")), LG.language_name(F.col("tgt")), F.col("s"), F.col("h"))
    return p.select("row_id", m[0]["content"].alias("system"), m[1]["content"].alias("content"))


@query(f"WITH {PAIRS} SELECT row_id, 'USER: ' || {O.translate_user('s', 'src', 'tgt')} || chr(10) || chr(10) || 'ASSISTANT: ' || h AS chat FROM pairs")
def chat_render(spark, sf):
    p = pairs(spark, sf)
    user = S.translate_messages(LG.language_name(F.col("src")), LG.language_name(F.col("tgt")), F.col("src"), F.col("tgt"), F.col("s"))[1]["content"]
    return p.select("row_id", S.render_chat(S.train_messages(user, F.col("h"))).alias("chat"))


@query(f"""SELECT row_id::VARCHAR AS id, {O.strip('source_text')} AS src_text, nullif({O.strip('target_text')}, '') AS ref_text, 'English' AS src_lang, 'Korean' AS tgt_lang FROM final_dataset
WHERE NOT coalesce(NOT filters.passed, false) AND {O.strip('source_text')} <> ''""")
def bad_source_skip(spark, sf):
    f = t(spark, sf, "final_dataset").withColumn("is_bad_source", ~F.col("filters.passed"))
    fields = EX.ExampleFields(id="row_id", src_text="source_text", ref_text="target_text")
    return EX.load_examples(f, fields).select("id", "src_text", "ref_text", "src_lang", "tgt_lang")


_BAD = "CASE WHEN event_id % 10 = 0 THEN '{bad' WHEN event_id % 10 = 1 THEN '[1]' WHEN event_id % 10 = 2 THEN '{\"a\": \"x\"}' ELSE props END"


def _lines(spark, sf):
    m = F.col("event_id") % 10
    return t(spark, sf, "events").select(F.when(m == 0, "{bad").when(m == 1, "[1]").when(m == 2, '{"a": "x"}').otherwise(F.col("props")).alias("line"))


@query(f"WITH l AS (SELECT {_BAD} AS line FROM events) SELECT count(*) AS total_lines, count(*) FILTER (WHERE line = '{{bad') AS bad_json, count(*) FILTER (WHERE line NOT IN ('{{bad', '[1]')) AS rows, count(*) FILTER (WHERE line = '{{\"a\": \"x\"}}') AS k_missing, count(*) FILTER (WHERE line LIKE '{{\"k\"%') AS k_non_string FROM l")
def typed_scan_stats(spark, sf):
    return S.scan_stats(_lines(spark, sf), "line", ["k"])


@query(f"WITH l AS (SELECT {_BAD} AS line FROM events), v AS (SELECT coalesce(json_extract_string(line, '$.k'), '') AS k FROM l WHERE line NOT IN ('{{bad', '[1]')) SELECT k, count(*) AS n FROM v GROUP BY k")
def typed_scan(spark, sf):
    return S.typed_scan(_lines(spark, sf), "line", ["k"]).groupBy("k").agg(F.count("*").alias("n"))


MOST = S.BudgetConfig().max_tokens
_BUDGET = f"""{PAIRS}, tok AS (SELECT row_id, {O.pieces("'USER: ' || s")} AS p0, CASE WHEN {O.strip('h')} = '' THEN [] ELSE {O.pieces('h')} END AS t0 FROM pairs),
cut AS (SELECT row_id, t0, CASE WHEN len(t0) = 0 THEN p0[1:{MOST}] WHEN len(p0) + len(t0) <= {MOST} THEN p0 ELSE p0[1:greatest(0, {MOST} - least(len(t0), {max(32, MOST // 8)}))] END AS p,
  len(p0) + len(t0) <= {MOST} AS fits FROM tok),
tg AS (SELECT row_id, p, t0, CASE WHEN len(t0) = 0 THEN [] WHEN fits THEN t0 ELSE t0[1:({MOST} - len(p))] END AS t FROM cut),
fin AS (SELECT row_id, p, CASE WHEN len(t0) = 0 OR t[-1] = {O.END} THEN t WHEN len(p) + len(t) < {MOST} THEN list_append(t, {O.END}) ELSE list_append(t[1:-2], {O.END}) END AS t FROM tg)"""


def _budgeted(spark, sf):
    p = pairs(spark, sf)
    return S.tokenize_pairs(p, F.concat(F.lit("USER: "), "s"), F.col("h"), S.BudgetConfig(MOST))


@query(f"WITH {_BUDGET} SELECT row_id, array_to_string(list_concat(p, t), ' ') AS input, len(p) AS prompt_tokens, len(t) AS target_tokens, len(p) + len(t) AS full_tokens FROM fin")
def token_budget(spark, sf):
    b = _budgeted(spark, sf)
    return b.select("row_id", F.array_join("input", " ").alias("input"), *[F.col(c).cast("long").alias(c) for c in ("prompt_tokens", "target_tokens", "full_tokens")])


@query(f"""WITH {_BUDGET} SELECT count(*) AS rows, count(*) FILTER (WHERE len(t) = 0) AS zero_target, count(*) FILTER (WHERE len(p) >= {MOST}) AS prompt_at_max, count(*) FILTER (WHERE len(p) + len(t) >= {MOST}) AS full_at_max,
max(len(p)) AS max_prompt, max(len(p) + len(t)) AS max_full, round(avg(len(t)), 9) AS mean_target FROM fin""")
def token_summary(spark, sf):
    s = S.summary(_budgeted(spark, sf), MOST)
    return s.select("rows", "zero_target", "prompt_at_max", "full_at_max", F.col("max_prompt").cast("long").alias("max_prompt"), F.col("max_full").cast("long").alias("max_full"), F.round("mean_target", 9).alias("mean_target"))


@query(f"""WITH {_BUDGET}, b AS (SELECT row_id, row_id // 32 AS batch_id, len(p) + len(t) AS n FROM fin WHERE len(t) > 0), w AS (SELECT batch_id, (ceil(max(n) / 8.0) * 8)::BIGINT AS width FROM b GROUP BY batch_id)
SELECT b.row_id, b.batch_id, w.width, w.width - b.n AS padding FROM b JOIN w USING (batch_id)""")
def pad_batches(spark, sf):
    b = S.trainable(_budgeted(spark, sf)).withColumn("batch_id", F.floor(F.col("row_id") / 32))
    p = S.padded_batches(b, "row_id", 32)
    return p.select("row_id", "batch_id", F.col("width").cast("long").alias("width"), F.size(F.filter("mask", lambda m: m == "0")).cast("long").alias("padding"))


# ---- tokens, rewards, advantages ------------------------------------------------------------------------------------

_TOKENS = f"""{PAIRS}, tk AS (SELECT row_id, regexp_extract_all(h, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS ts FROM pairs WHERE h <> ''),
ex AS (SELECT row_id, generate_subscripts(ts, 1) AS i, unnest(ts) AS tok FROM tk),
off AS (SELECT row_id, i, tok, sum(length(tok)) OVER (PARTITION BY row_id ORDER BY i) - length(tok) AS s, sum(length(tok)) OVER (PARTITION BY row_id ORDER BY i) AS e FROM ex)"""
# spans: the second third of the text is MAJOR, digits' tokens' first half CRITICAL, the first ten characters MINOR
_SPANS = """sp AS (SELECT row_id, length(h) // 3 AS s, 2 * length(h) // 3 AS e, -5.0 AS w FROM pairs WHERE h <> '' UNION ALL SELECT row_id, 0, least(10, length(h)), -1.0 FROM pairs WHERE h <> ''
  UNION ALL SELECT row_id, 5, 4, -10.0 FROM pairs WHERE h <> '' UNION ALL SELECT row_id, length(h) // 2, length(h), -10.0 FROM pairs WHERE h <> '')"""


def _tokens(spark, sf):
    p = pairs(spark, sf).where("h <> ''")
    pieces = F.regexp_extract_all("h", F.lit("([\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+)"), F.lit(1))
    n = F.length("h")
    span = lambda s, e, v: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit(v).alias("severity"), F.lit(0.5).alias("confidence"))
    spans = F.array(span(F.floor(n / 3), F.floor(n * 2 / 3), "MAJOR"), span(F.lit(0), F.least(F.lit(10), n), " minor"), span(F.lit(5), F.lit(4), "CRITICAL"), span(F.floor(n / 2), n, "critical"), span(F.lit(0), n, "other"))
    return p.select("row_id", "src", "s", "h", pieces.alias("tokens"), spans.alias("spans")).withColumn("offsets", K.piece_offsets(F.col("tokens")))


@query(f"WITH {_TOKENS} SELECT row_id, i - 1 AS pos, s::BIGINT AS start_at, e::BIGINT AS end_at FROM off")
def token_offsets(spark, sf):
    return _tokens(spark, sf).select("row_id", F.posexplode_outer("offsets").alias("pos", "o")).where("pos is not null").select("row_id", F.col("pos").cast("long").alias("pos"), F.col("o.start").cast("long").alias("start_at"), F.col("o.end").cast("long").alias("end_at"))


def _span_sql(policy: str, how: str) -> str:
    hit = "least(o.e, sp.e) - greatest(o.s, sp.s) > 0" + (" AND (least(o.e, sp.e) - greatest(o.s, sp.s))::DOUBLE / greatest(1, o.e - o.s) >= 0.5" if policy == "majority_overlap" else "")
    return f"""WITH {_TOKENS}, {_SPANS} SELECT o.row_id, o.i - 1 AS pos, coalesce({how}(sp.w), 0.0)::DOUBLE AS reward FROM off o LEFT JOIN sp ON o.row_id = sp.row_id AND sp.e > sp.s AND {hit} GROUP BY o.row_id, o.i"""


def _span_query(policy: str, how: str) -> Query:
    def run(spark, sf):
        r = K.span_token_rewards(F.col("offsets"), F.col("spans"), policy, how)
        return _tokens(spark, sf).select("row_id", F.posexplode_outer(r).alias("pos", "reward")).where("pos is not null").select("row_id", F.col("pos").cast("long").alias("pos"), "reward")

    run.__name__ = f"span_token_rewards_{policy.split('_')[0]}_{how}"
    return run


for _policy in ("any_overlap", "majority_overlap"):
    for _how in ("sum", "min", "max"):
        query(_span_sql(_policy, _how))(_span_query(_policy, _how))


@query(f"WITH {PAIRS} SELECT row_id, round((5.0 - {O.score('s', 'h')}) * 1.0 + {O.jaccard('s', 'h')} * 25.0 * 0.5, 9) AS reward FROM pairs")
def sequence_reward(spark, sf):
    r = K.sequence_reward(X.heuristic_score(F.col("s"), F.col("h")), X.jaccard_overlap(F.col("s"), F.col("h")), 5.0, 1.0, 0.5, 25.0)
    return pairs(spark, sf).select("row_id", F.round(r, 9).alias("reward"))


_ADV = f"""{_TOKENS}, {_SPANS}, rw AS (SELECT o.row_id, o.i, coalesce(sum(sp.w), 0.0)::DOUBLE AS r FROM off o LEFT JOIN sp ON o.row_id = sp.row_id AND sp.e > sp.s AND least(o.e, sp.e) - greatest(o.s, sp.s) > 0 GROUP BY o.row_id, o.i),
adv AS (SELECT rw.row_id, rw.i, p.src, rw.r + (5.0 - {O.score('p.s', 'p.h')}) AS a FROM rw JOIN pairs p ON p.row_id = rw.row_id)"""


def _advantages(spark, sf):
    j = _tokens(spark, sf)
    seq = K.broadcast_reward(F.lit(5.0) - X.heuristic_score(F.col("s"), F.col("h")), F.size("tokens"))
    return j.withColumn("advantages", K.combine(seq, K.span_token_rewards(F.col("offsets"), F.col("spans"))))


def _token_rows(df: DataFrame) -> DataFrame:
    return df.select("row_id", F.posexplode_outer("advantages").alias("pos", "a")).where("pos is not null").select("row_id", F.col("pos").cast("long").alias("pos"), F.round("a", 6).alias("advantage"))


@query(f"""WITH {_ADV}, m AS (SELECT row_id, src, avg(a) AS s FROM adv GROUP BY row_id, src), g AS (SELECT src, avg(s) AS mean, stddev_pop(s) AS sd FROM m GROUP BY src)
SELECT a.row_id, a.i - 1 AS pos, round(a.a + 1.0 * (m.s - g.mean) / (g.sd + 1e-8), 6) AS advantage FROM adv a JOIN m ON m.row_id = a.row_id JOIN g ON g.src = a.src""")
def group_advantage(spark, sf):
    return _token_rows(A.group_advantage(_advantages(spark, sf), ["src"]))


@query(f"WITH {_ADV}, g AS (SELECT src, avg(a) AS mean, stddev_pop(a) AS sd FROM adv GROUP BY src) SELECT a.row_id, a.i - 1 AS pos, round((a.a - g.mean) / (g.sd + 1e-8), 6) AS advantage FROM adv a JOIN g ON g.src = a.src")
def batch_advantage(spark, sf):
    return _token_rows(A.batch_advantage(_advantages(spark, sf), "src"))


def _logprob(salt: str, row: str, pos: str) -> str:
    return f"(-1.0 * (('0x' || substr(sha256('{salt}:' || {row} || ':' || {pos}), 1, 6))::BIGINT % 1000) / 1000.0)"


def _loss_sql(algorithm: str) -> str:
    ratio = "exp(n - o)"
    loss = f"-least({ratio} * a, greatest(0.8, least(1.2, {ratio})) * a)" if algorithm == "grpo" else "-(n * a)"
    clip = f"(({ratio} > 1.2) OR ({ratio} < 0.8))::INT" if algorithm == "grpo" else "0"
    return f"""WITH {_ADV}, lp AS (SELECT a, {_logprob('n', 'row_id', '(i - 1)')} AS n, {_logprob('o', 'row_id', '(i - 1)')} AS o, {_logprob('r', 'row_id', '(i - 1)')} AS r FROM adv)
SELECT round(sum({loss} + 0.1 * (n - r)) / count(*), 6) AS policy_loss, round(sum(0.5 * (n - o) * (n - o)) / count(*), 6) AS approx_kl, round(sum({clip})::DOUBLE / count(*), 6) AS clip_fraction,
round(sum(n - r) / count(*), 6) AS kl_to_reference, count(*) AS token_count FROM lp"""


def _loss(algorithm: str) -> Query:
    def run(spark, sf):
        adv = _advantages(spark, sf)

        def lp(salt: str):
            digits = lambda i: F.substring(F.sha2(F.concat_ws(":", F.lit(salt), F.col("row_id").cast("string"), i.cast("string")), 256), 1, 6)
            return F.transform("advantages", lambda a, i: -(F.conv(digits(i), 16, 10).cast("long") % 1000) / 1000.0)

        loss = K.policy_token_loss(lp("n"), lp("o"), F.col("advantages"), lp("r"), 0.2, 0.1, algorithm)
        s = A.policy_stats(adv.select(loss.alias("token_loss")))
        return s.select(*[F.round(c, 6).alias(c) for c in ("policy_loss", "approx_kl", "clip_fraction", "kl_to_reference")], "token_count")

    run.__name__ = f"policy_loss_{algorithm}"
    return run


for _algorithm in ("grpo", "reinforce"):
    query(_loss_sql(_algorithm))(_loss(_algorithm))


@query("SELECT row_id, CASE row_id % 5 WHEN 0 THEN row_id || ',7' WHEN 1 THEN '1,' || row_id WHEN 2 THEN row_id || ',5,6' WHEN 3 THEN '' ELSE row_id::VARCHAR END AS ids FROM (SELECT DISTINCT row_id FROM final_dataset)")
def token_ids(spark, sf):
    r = F.col("row_id").cast("string")
    m = F.col("row_id") % 5
    raw = F.when(m == 0, F.concat(F.lit("["), r, F.lit(", 7]"))).when(m == 1, F.concat(F.lit("[[1], ["), r, F.lit("]]"))).when(m == 2, F.concat(r, F.lit(" 5  6"))).when(m == 3, "").otherwise(r)
    rows = t(spark, sf, "final_dataset").select("row_id").distinct()
    return rows.select("row_id", F.array_join(K.coerce_ids(raw).cast("array<string>"), ",").alias("ids"))


@query("SELECT row_id, CASE WHEN row_id % 3 = 0 THEN '1,2,' || (3 + row_id) ELSE '2,' || (3 + row_id) || ',1' END AS ids FROM (SELECT DISTINCT row_id FROM final_dataset)")
def stop_ids(spark, sf):
    rows = t(spark, sf, "final_dataset").select("row_id").distinct()
    n = (F.lit(3) + F.col("row_id")).cast("int")
    own = F.when(F.col("row_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2), n))
    return rows.select("row_id", F.array_join(K.union_ids(own, F.array(F.lit(2), n, F.lit(1))).cast("array<string>"), ",").alias("ids"))


@query("SELECT row_id, pos, row_id % 7 AS start_at, CASE row_id % 4 WHEN 3 THEN 'MINOR' ELSE 'MAJOR' END AS severity FROM (SELECT DISTINCT row_id FROM final_dataset), (VALUES (0), (1)) AS p(pos) WHERE (row_id % 4 IN (0, 3) AND pos = 1) OR (row_id % 4 = 1 AND pos = 0) OR row_id % 4 = 2")
def span_extraction(spark, sf):
    rows = t(spark, sf, "final_dataset").select("row_id").distinct()
    s = lambda severity: F.concat(F.lit('{"start": '), (F.col("row_id") % 7).cast("string"), F.lit(f', "end": 9, "severity": "{severity}"}}'))
    m = F.col("row_id") % 4
    meta = (
        F.when(m == 0, F.concat(F.lit('[null, {"error_spans": ['), s("MAJOR"), F.lit("]}]")))
        .when(m == 1, F.concat(F.lit('{"error_spans": ['), s("MAJOR"), F.lit("]}")))
        .when(m == 2, F.concat(F.lit('{"error_spans": [['), s("MAJOR"), F.lit("], ["), s("MAJOR"), F.lit("], ["), s("MAJOR"), F.lit("]]}")))
        .otherwise(F.concat(F.lit('{"samples": [[], ['), s("MINOR"), F.lit("]]}")))
    )
    spans = rows.select("row_id", F.posexplode(K.error_spans(meta, F.lit(2))).alias("pos", "spans")).select("row_id", "pos", F.explode("spans").alias("s"))
    return spans.select("row_id", F.col("pos").cast("int").alias("pos"), F.col("s.start").cast("long").alias("start_at"), F.col("s.severity").alias("severity"))


# ---- reports --------------------------------------------------------------------------------------------------------


@query(f"""WITH {PAIRS}, x AS (SELECT {O.score('s', 'h')} AS score_a, {O.jaccard('s', 'h')} AS score_b, len(regexp_extract_all(h, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')) AS n FROM pairs WHERE h <> '')
SELECT round(avg(score_a), 9) AS score_a_mean, round(stddev_pop(score_a), 9) AS score_a_std, round(avg(score_b), 9) AS score_b_mean, round(stddev_pop(score_b), 9) AS score_b_std, round(avg(5.0 - score_a), 9) AS reward_mean,
round(stddev_pop(5.0 - score_a), 9) AS reward_std, 5.0::DOUBLE AS span_count_mean, round(avg(n), 9) AS completion_length_mean, count(*) AS num_rows FROM x""")
def eval_report(spark, sf):
    d = _tokens(spark, sf).withColumn("score_a", X.heuristic_score(F.col("s"), F.col("h"))).withColumn("score_b", X.jaccard_overlap(F.col("s"), F.col("h"))).withColumn("reward", F.lit(5.0) - F.col("score_a"))
    r = A.eval_report(d, "score_a", "score_b", "reward", "spans", "tokens")
    return r.select(*[c if c == "num_rows" else F.round(c, 9).alias(c) for c in r.columns])


@query(f"WITH {PAIRS}, n AS (SELECT count(*) AS n FROM pairs WHERE h <> '') SELECT severity, n * k AS n FROM n, (VALUES ('MAJOR', 1), ('MINOR', 1), ('CRITICAL', 2), ('OTHER', 1)) AS v(severity, k)")
def severity_counts(spark, sf):
    return A.severity_counts(_tokens(spark, sf))


@query(f"WITH {_ADV} SELECT count(*) AS tokens, round(count(*) FILTER (WHERE abs(r) > 0)::DOUBLE / count(*), 9) AS nonzero_ratio, round(avg(r), 9) AS mean, round(stddev_pop(r), 9) AS std, min(r) AS least, max(r) AS greatest FROM rw")
def reward_stats(spark, sf):
    d = _tokens(spark, sf).withColumn("token_rewards", K.span_token_rewards(F.col("offsets"), F.col("spans")))
    r = A.reward_stats(d)
    return r.select("tokens", *[F.round(c, 9).alias(c) for c in ("nonzero_ratio", "mean", "std")], "least", "greatest")


@query("""WITH b AS (SELECT event_type, event_id, max(value) OVER (PARTITION BY event_type ORDER BY event_id) AS best_score, value FROM events)
SELECT event_type, event_id, best_score, min(event_id) FILTER (WHERE value = best_score) OVER (PARTITION BY event_type, best_score) AS best_update FROM b""")
def running_best(spark, sf):
    return A.running_best(t(spark, sf, "events"), ["event_type"], "event_id", "value").select("event_type", "event_id", "best_score", "best_update")


@query("SELECT event_type, count(*) AS count, round(sum(value), 6) AS total, round(avg(value), 9) AS avg, max(value) AS max FROM events GROUP BY event_type")
def timing_stats(spark, sf):
    s = A.timing_stats(t(spark, sf, "events"), "event_type", "value")
    return s.select("event_type", "count", F.round("total", 6).alias("total"), F.round("avg", 9).alias("avg"), "max")


@query(f"WITH {PAIRS} SELECT min({O.approx('s')})::BIGINT AS length_min, max({O.approx('s')})::BIGINT AS length_max, floor(sum({O.approx('s')}) * 100.0 / count(*))::BIGINT AS length_avg_x100 FROM pairs")
def length_stats(spark, sf):
    s = A.length_stats(pairs(spark, sf), X.approx_token_length(F.col("s")))
    return s.select(F.col("length_min").cast("long").alias("length_min"), F.col("length_max").cast("long").alias("length_max"), "length_avg_x100")


# ---- rows, batches and statistics of training -----------------------------------------------------------------------


@query(f"""WITH {_ADV}, lp AS (SELECT a, {_logprob('n', 'row_id', '(i - 1)')} AS n, {_logprob('o', 'row_id', '(i - 1)')} AS o, -1.0 * {_logprob('e', 'row_id', '(i - 1)')} AS e FROM adv)
SELECT round(sum(-least(exp(n - o) * a, greatest(0.8, least(1.2, exp(n - o))) * a) - 0.01 * e) / count(*), 6) AS policy_loss, round(sum(e) / count(*), 6) AS entropy, count(*) AS token_count FROM lp""")
def policy_loss_entropy(spark, sf):
    adv = _advantages(spark, sf)
    loss = K.policy_token_loss(_lp("n"), _lp("o"), F.col("advantages"), None, 0.2, 0.0, "grpo", F.transform(_lp("e"), lambda x: -x), 0.01)
    s = A.policy_stats(adv.select(loss.alias("token_loss")))
    return s.select(F.round("policy_loss", 6).alias("policy_loss"), F.round("entropy", 6).alias("entropy"), "token_count")


def _lp(salt: str):
    digits = lambda i: F.substring(F.sha2(F.concat_ws(":", F.lit(salt), F.col("row_id").cast("string"), i.cast("string")), 256), 1, 6)
    return F.transform("advantages", lambda a, i: -(F.conv(digits(i), 16, 10).cast("long") % 1000) / 1000.0)


@query(f"""WITH {_ADV}, lp AS (SELECT row_id, a, {_logprob('o', 'row_id', '(i - 1)')} AS o, {_logprob('r', 'row_id', '(i - 1)')} AS r FROM adv)
SELECT row_id, round(avg(a), 6) AS adv_mean, round(sum(a), 5) AS adv_sum, round(avg(o), 9) AS old_logprob_mean, CASE WHEN row_id % 3 = 0 THEN NULL ELSE round(avg(r), 9) END AS ref_logprob_mean FROM lp GROUP BY row_id""")
def rollout_means(spark, sf):
    d = _advantages(spark, sf).withColumn("old_logprobs", _lp("o")).withColumn("ref_logprobs", F.when(F.col("row_id") % 3 != 0, _lp("r")))
    m = A.rollout_means(d)
    return m.select("row_id", F.round("adv_mean", 6).alias("adv_mean"), F.round("adv_sum", 5).alias("adv_sum"), F.round("old_logprob_mean", 9).alias("old_logprob_mean"), F.round("ref_logprob_mean", 9).alias("ref_logprob_mean"))


@query(f"""WITH {_ADV}, p AS (SELECT {O.score('s', 'h')} AS a, {O.jaccard('s', 'h')} AS b FROM pairs WHERE h <> ''), t AS (SELECT avg(r) AS m, stddev_pop(r) AS sd, count(*) FILTER (WHERE abs(r) > 0)::DOUBLE / count(*) AS nz FROM rw)
SELECT round(avg(a), 6) AS first_score_mean, round(stddev_pop(a), 6) AS first_score_std, round(avg(5.0 - a), 6) AS first_reward_mean, round(stddev_pop(5.0 - a), 6) AS first_reward_std, round(avg(b), 6) AS second_score_mean,
round(stddev_pop(b), 6) AS second_score_std, round((SELECT m FROM t), 6) AS token_rewards_mean, round((SELECT sd FROM t), 6) AS token_rewards_std, round((SELECT nz FROM t), 6) AS token_rewards_non_zero_ratio,
1.0::DOUBLE AS span_minor_mean, 1.0::DOUBLE AS span_major_mean, 2.0::DOUBLE AS span_critical_mean FROM p""")
def reward_report(spark, sf):
    d = _tokens(spark, sf).withColumn("score_first", X.heuristic_score(F.col("s"), F.col("h"))).withColumn("score_second", X.jaccard_overlap(F.col("s"), F.col("h"))).withColumn("reward_first", F.lit(5.0) - F.col("score_first"))
    r = A.reward_report(d.withColumn("token_rewards", K.span_token_rewards(F.col("offsets"), F.col("spans"))))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query(f"WITH {_ADV} SELECT src, round(avg(a), 6) AS mean_before, round(stddev_pop(a), 6) AS std_before, 0.0::DOUBLE AS mean_after, CASE WHEN stddev_pop(a) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS std_after, count(*) AS tokens FROM adv GROUP BY src")
def batch_statistics(spark, sf):
    rows = _advantages(spark, sf).select("src", "advantages")
    before = A.batch_moments(rows, "src").select("src", F.round("mean", 6).alias("mean_before"), F.round("std", 6).alias("std_before"), "tokens")
    after = A.batch_moments(A.batch_advantage(rows, "src"), "src").select("src", F.abs(F.round("mean", 4)).alias("mean_after"), F.round("std", 4).alias("std_after"))
    return before.join(after, "src")


@query(f"WITH {PAIRS} SELECT 1.0::DOUBLE AS mean_minor, 1.0::DOUBLE AS mean_major, 2.0::DOUBLE AS mean_critical FROM (SELECT count(*) AS n FROM pairs WHERE h <> '') WHERE n > 0")
def severity_means(spark, sf):
    return A.severity_means(_tokens(spark, sf))


@query("WITH s AS (SELECT DISTINCT source_id, candidate_index, prefilter.score_sample AS x FROM prefilter_candidates) SELECT count(*) AS n, count(*) FILTER (WHERE x IS NULL OR isnan(x)) AS replaced, round(avg(CASE WHEN x IS NULL OR isnan(x) THEN 25.0 ELSE x END), 6) AS mean, round(stddev_pop(CASE WHEN x IS NULL OR isnan(x) THEN 25.0 ELSE x END), 6) AS std FROM s")
def score_moments(spark, sf):
    c = t(spark, sf, "prefilter_candidates").select("source_id", "candidate_index", F.col("prefilter.score_sample").alias("x")).distinct()
    clean = c.withColumn("y", A.sanitize_score(F.col("x"), 25.0))
    n = clean.agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull() | F.isnan("x")).alias("replaced"))
    m = A.moments(clean, F.col("y"))
    return n.join(F.broadcast(m), F.lit(True)).select("n", "replaced", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {PAIRS} SELECT row_id, length(h) > 80 AS skipped FROM pairs")
def overflow_skipped(spark, sf):
    p = pairs(spark, sf)
    return p.select("row_id", F.isnan(A.skip_overflow(F.length("h"), 80, F.lit(1.0))).alias("skipped"))


@query("SELECT row_id, row_id % 4 AS kept, least(row_id % 4, 2) AS shared FROM (SELECT DISTINCT row_id FROM final_dataset)")
def completion_ids(spark, sf):
    rows = t(spark, sf, "final_dataset").select("row_id").distinct()
    k = (F.col("row_id") % 4).cast("int")
    ids = F.concat(F.slice(F.array(*[F.lit(x) for x in (11, 12, 13)]), F.lit(1), k), F.array(F.lit(2), F.lit(99)))
    trimmed = K.trim_completion(ids, [2, 0])
    other = F.array(*[F.lit(x) for x in (11, 12, 77, 78)])
    return rows.select("row_id", F.size(trimmed).cast("long").alias("kept"), K.common_prefix_length(trimmed, other).cast("long").alias("shared"))


_PLACE = "(('0x' || substr(sha256('5:step3:' || d.draw), 1, 12))::BIGINT % (SELECT count(*) FROM documents))"


@query(f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents), d AS (SELECT unnest(range(64)) AS draw) SELECT d.draw, r.doc_id FROM d JOIN r ON r.p = {_PLACE}")
def sample_batch(spark, sf):
    return B.sample_batch(docs(spark, sf).select("doc_id"), "doc_id", 64, 5, 3).select("draw", "doc_id")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) SELECT doc_id, p // 48 AS chunk FROM r")
def chunks(spark, sf):
    return B.chunked(docs(spark, sf).select("doc_id"), "doc_id", 48).select("doc_id", F.col("chunk").cast("long").alias("chunk"))


@query(f"WITH {PAIRS} SELECT row_id, CASE row_id % 6 WHEN 4 THEN '' WHEN 5 THEN '' ELSE {O.strip('h')} END AS answer FROM pairs")
def response_texts(spark, sf):
    h = X.json_string(F.col("h"))
    m = F.col("row_id") % 6
    raw = (
        F.when(m == 0, F.concat(F.lit('{"choices": [{"message": {"content": '), h, F.lit("}}]}")))
        .when(m == 1, F.concat(F.lit('{"choices": [{"message": {"content": [{"type": "text", "text": '), h, F.lit("}, null]}}]}")))
        .when(m == 2, F.concat(F.lit('{"choices": [{"message": {"content": "  "}, "text": '), h, F.lit("}]}")))
        .when(m == 3, F.concat(F.lit('{"choices": [{"message": {"content": {"content": {"value": '), h, F.lit("}}}}]}")))
        .when(m == 4, F.lit('{"choices": []}'))
        .otherwise(F.lit("no json"))
    )
    return pairs(spark, sf).select("row_id", X.response_text(raw).alias("answer"))


@query(f"WITH {PAIRS} SELECT row_id, 'You are a professional ' || {O.name('src')} || ' (' || src || ') to ' || {O.name('tgt')} || ' (' || CASE WHEN row_id % 2 = 0 THEN tgt ELSE {O.name('tgt')} END || ') translator.' AS head, '\\n\\n' || s AS tail FROM pairs")
def rollout_prompts(spark, sf):
    code = F.when(F.col("row_id") % 2 == 0, F.col("tgt")).otherwise(F.lit(" "))
    prompt = S.rollout_prompt(LG.language_name(F.col("src")), F.col("src"), LG.language_name(F.col("tgt")), code, F.col("s"))
    p = pairs(spark, sf).withColumn("prompt", prompt)
    return p.select("row_id", F.concat(F.substring_index("prompt", "translator.", 1), F.lit("translator.")).alias("head"), F.expr("substring(prompt, length(prompt) - length(s) - 3)").alias("tail"))


class _Letters:
    """A tokenizer stand-in: a token a letter, 1 closes a text; no template."""

    end, turn_end = 1, None

    def encode(self, text):
        return [ord(c) + 10 for c in text]

    def render(self, messages, generation):
        return None


def _asked_text(text: str) -> list[dict[str, str]]:
    return [{"role": "user", "content": text}]


_ROOM = 200


@query(f"""WITH {PAIRS}, n AS (SELECT row_id, length(s) + 18 AS p, CASE WHEN {O.strip('h')} = '' THEN 0 ELSE length(h) END AS t FROM pairs),
c AS (SELECT row_id, t, CASE WHEN t = 0 THEN least(p, {_ROOM}) WHEN p + t <= {_ROOM} THEN p ELSE least(p, {_ROOM} - least(t, 32)) END AS p FROM n)
SELECT row_id, p::BIGINT AS prompt_tokens, (CASE WHEN t = 0 THEN 0 ELSE least(t + 1, {_ROOM} - p) END)::BIGINT AS num_target_tokens FROM c""")
def training_rows(spark, sf):
    rows = TR.training_rows(pairs(spark, sf), "row_id", "s", "h", _Letters, _asked_text, TR.TrainingConfig(_ROOM))
    return rows.select("row_id", F.col("prompt_tokens").cast("long").alias("prompt_tokens"), F.col("num_target_tokens").cast("long").alias("num_target_tokens"))


class _Spans:
    """A span-scorer stand-in: a tenth of the difference in length, and one major span over the first half of the answer."""

    def score(self, sources, candidates, references):
        return [(abs(len(a) - len(b)) / 10, [(0, len(b) // 2, "MAJOR", 0.5)] if b else []) for a, b in zip(sources, candidates)]


@query(f"WITH {PAIRS} SELECT row_id, round(abs(length(s) - length(h)) / 10.0, 9) AS score, CASE WHEN h = '' THEN 0 ELSE 1 END::BIGINT AS spans, CASE WHEN h = '' THEN NULL ELSE (length(h) // 2) END::BIGINT AS first_end FROM pairs")
def span_scores(spark, sf):
    p = pairs(spark, sf).withColumn("x", C.span_scorer_udf(_Spans)("s", "h", F.lit("")))
    return p.select("row_id", F.round("x.score", 9).alias("score"), F.size("x.spans").cast("long").alias("spans"), F.get("x.spans", F.lit(0))["end"].cast("long").alias("first_end"))


# ---- sources and sinks ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def jsonl_round_trip(spark, sf):
    path = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    d = t(spark, sf, "documents").select("doc_id", "text", "lang")
    half = F.col("doc_id") % 2
    IO.write_jsonl(d.where(half == 0), path)
    IO.write_jsonl(d.where(half == 1), path, append=True)
    back = materialize(IO.read_jsonl(spark, path, "doc_id long, text string, lang string"))
    IO.remove(spark, path)
    return back.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "lang")


@query("WITH " + O.segments() + f" SELECT {O.bucket('length_approx')}::BIGINT AS bucket, count(*) AS n, sum(k)::BIGINT AS indices, count(DISTINCT source_id) AS ids FROM segs GROUP BY 1")
def streamed_segments(spark, sf):
    """Segments of files as they arrive, each document once: the stream reads the table in two batches and is then started again."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    d = docs(spark, sf)
    for k in range(2):
        d.where(F.col("doc_id") % 2 == k).write.mode("append").parquet(f"{folder}/in")
        arriving = ST.document_stream(spark, f"{folder}/in", "doc_id long, text string", files_per_batch=1)
        ST.ingest_segments(arriving, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    back = materialize(spark.read.parquet(f"{folder}/out").groupBy(B.bucket_of(F.col("length_approx")).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.sum("segment_index").alias("indices"), F.count_distinct("source_id").alias("ids")))
    IO.remove(spark, folder)
    return back


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 200")
def corpus_cap(spark, sf):
    return IO.corpus(spark, t(spark, sf, "documents").select("doc_id", "lang"), lang="en", most=200, order="doc_id")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('3:split:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT CASE WHEN r <= greatest(1, least(n - 1, round_even(n * 0.05, 0))) THEN 'eval' ELSE 'train' END AS part, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM r GROUP BY 1""")
def split_written(spark, sf):
    folder = f"{shared_dir(spark)}/split-{uuid.uuid4().hex}"
    paths = IO.write_split(B.split_train_eval(docs(spark, sf).select("doc_id"), "doc_id", 0.05, 3), folder)
    back = [materialize(IO.read_jsonl(spark, p, "doc_id long").select(F.lit(part).alias("part"), "doc_id")) for part, p in paths.items()]
    IO.remove(spark, folder)
    return back[0].unionByName(back[1]).groupBy("part").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT doc_id, 'row ' || doc_id AS example_id, doc_id % 3 AS tokens FROM documents WHERE doc_id % 3 > 0 AND doc_id % 5 > 0")
def rollout_table(spark, sf):
    path = f"{shared_dir(spark)}/rollouts-{uuid.uuid4().hex}"
    k = (F.col("doc_id") % 3).cast("int")
    made = docs(spark, sf).select(F.concat(F.lit("row "), F.col("doc_id").cast("string")).alias("example_id"), F.when(F.col("doc_id") % 5 > 0, F.lit("text")).otherwise(F.lit(" ")).alias("completion_text"), F.slice(F.array(F.lit(5), F.lit(6)), F.lit(1), k).alias("completion_token_ids"), F.col("doc_id").cast("string").alias("src_text"))
    IO.write_jsonl(made, path)
    back = materialize(IO.read_rollouts(spark, path))
    IO.remove(spark, path)
    return back.select(F.col("src_text").cast("long").alias("doc_id"), "example_id", F.size("completion_token_ids").cast("long").alias("tokens"))


# ---- the whole pipeline ---------------------------------------------------------------------------------------------

_FLAG = P.PipelineConfig()
_FULL = P.from_dict(P.PipelineConfig, P.FULL)


def _pipe_sql(c: P.PipelineConfig) -> str:
    n = int(c.data.sample_pool_size * c.data.sentence_ratio)
    balanced = lambda table, size, seed, name: O.balanced(f"(SELECT source_id, source_text, length_approx FROM {table})", size, seed, name)
    return (
        "WITH RECURSIVE " + O.segments() + O.blobs() + "," + balanced("segs", n, c.sample.seed, "sa") + "," + balanced("blobs", c.data.sample_pool_size - n, c.sample.seed + 1, "bl")
        + f""", pool AS (SELECT * FROM sa UNION ALL SELECT * FROM bl),
pre AS (SELECT *, {O.stub('source_text', 'source_id', "'-1'")} AS greedy, {O.stub('source_text', 'source_id', "'0'")} AS sampled FROM pool),
imp AS (SELECT source_id, source_text, {O.score('source_text', 'greedy')} - {O.score('source_text', 'sampled')} AS improvement FROM pre),
sel AS (SELECT *, row_number() OVER (ORDER BY improvement DESC, source_id) AS selection_rank FROM imp ORDER BY improvement DESC, source_id LIMIT {c.select.top_n}),
gen AS (SELECT sel.*, i AS candidate_index, {O.stub('source_text', 'source_id', 'i')} AS candidate_text FROM sel, range({c.select.num_candidates}) AS r(i)),
sc AS (SELECT *, {O.score('source_text', 'candidate_text')} AS score FROM gen),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score, candidate_index) = 1)
SELECT source_text, candidate_text AS target_text, round(score, 9) AS score, selection_rank, {O.rule_reason('source_text', 'candidate_text')} AS reason_code FROM best"""
    )


_PIPE = _pipe_sql(_FLAG)


def _verdicts(spark, sf, config: P.PipelineConfig, pooled=lambda df: df) -> DataFrame:
    p = Pipeline(spark, config)
    best, _ = p.score_select_best(p.generate_candidates(p.select_sources(p.prefilter_score(pooled(p.sample_sources(docs(spark, sf)))))))
    passed, rejected = p.format_filter(best)
    out = passed.unionByName(rejected)
    return out.select("source_text", "target_text", F.round("metricx_qe_score_best", 9).alias("score"), F.col("selection.selection_rank").cast("long").alias("selection_rank"), F.col("filters.reason_code").alias("reason_code"))


@query(_PIPE)
def pipeline_verdicts(spark, sf):
    return _verdicts(spark, sf, _FLAG)


@query(f"SELECT source_text, target_text, score FROM ({_PIPE}) WHERE reason_code IN ('pass', 'copy_overlap')")
def pipeline_final(spark, sf):
    loose = P.from_dict(P.PipelineConfig, {"filters": {"max_copy_overlap": 1.0}})  # the stand-in generator copies words
    out = Pipeline(spark, loose).run(docs(spark, sf))
    return out.select("source_text", "target_text", F.round("metricx_qe_score_best", 9).alias("score"))


@query(_PIPE)
def pipeline_resumed(spark, sf):
    """The verdicts of a run that was stopped after its first stages and resumed: caches, finished tables and progress are read back."""
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    first = Pipeline(spark, _FLAG, folder=folder)
    for stage in ("sample_sources", "prefilter_score", "select_sources"):
        first.run_stage(stage, docs(spark, sf))
    again = Pipeline(spark, _FLAG, folder=folder, mode=RunMode(resume=True))
    again.run(docs(spark, sf))
    out = materialize(again.stored("filtered").select("source_text", "target_text", F.round("metricx_qe_score_best", 9).alias("score"), F.col("selection.selection_rank").cast("long").alias("selection_rank"), F.col("filters.reason_code").alias("reason_code")))
    IO.remove(spark, folder)
    return out


@query(_pipe_sql(_FULL))
def pipeline_full(spark, sf):
    """The verdicts at the sizes of a full run. The pool is written once: completions and their join with the sources both read it."""
    return _verdicts(spark, sf, _FULL, materialize)


@query("WITH RECURSIVE " + O.segments() + O.blobs() + "," + O.balanced("(SELECT source_id, length_approx FROM segs)", 500_000, 7, "sa") + "," + O.balanced("(SELECT source_id, length_approx FROM blobs)", 500_000, 8, "bl")
       + " SELECT source_id, 'sentence' AS kind FROM sa UNION ALL SELECT source_id, 'blob' FROM bl")
def pool_full(spark, sf):
    return materialize(Pipeline(spark, _FULL).sample_sources(docs(spark, sf)).select("source_id", "kind"))


FLAGSHIP = pipeline_full


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
