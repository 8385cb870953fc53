"""Queries of the training-data operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingloom.llm import defects, fixed_sample, keyword_spam, language, mixing, near_duplicates, packing, sentences, stratified, topn
from lingloom.oracle import norm


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = language.mislabelled(language.identify(language.corpus_records(spark, sf)))
    return found.select("origin", "rec_key", "run_no", "lang")


def p1_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The languages of web pages, with site and address suffix as evidence: one row a run, for all pages."""
    runs = language.identify(language.page_records(_t(spark, sf, "documents"))).select(F.col("rec_key").cast("long").alias("doc_id"), F.posexplode("runs").alias("run_no", "run"))
    return runs.select("doc_id", "run_no", F.col("run.lang").alias("lang"), F.col("run.confidence").alias("confidence"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_spans(_t(spark, sf, "sampled_sources"), "source_id", "source_text")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return defects.label(defects.votes_of_pairs(_t(spark, sf, "final_dataset")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return defects.one_defect(_labels(spark, sf))


def p3_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf)


def _drawn(spark: SparkSession, sf: str) -> stratified.Drawn:
    return stratified.draw(stratified.distinct_items(_t(spark, sf, "sampled_sources")), _t(spark, sf, "sample_targets"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _drawn(spark, sf).report.where("exhausted").select("plan_id", "kind", "length_from")


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return _drawn(spark, sf).report.select("plan_id", "kind", "length_from", "wanted", "available", "quota", "exhausted")


def p4_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _drawn(spark, sf).sample.select("plan_id", "kind", "length_from", F.col("item").alias("source_id"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    scored = _t(spark, sf, "prefilter_candidates").select("source_id", "candidate_index", "prefilter.score_sample")
    best = topn.top_n(scored, "source_id", F.col("score_sample"), F.col("candidate_index"), 3)
    return best.select(F.col("group").alias("source_id"), F.col("tie").alias("candidate_index"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = near_duplicates.expand(near_duplicates.near_duplicates(_t(spark, sf, "sampled_sources")))
    return pairs.select(F.col("a").alias("source_id_a"), F.col("b").alias("source_id_b"))


def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.class_links(near_duplicates.near_duplicates(_t(spark, sf, "sampled_sources"))).withColumnRenamed("key", "source_id")


def p7_samples(spark: SparkSession, sf: str) -> DataFrame:
    segments = _t(spark, sf, "sampled_sources")
    drawn = fixed_sample.fixed_size_samples(segments, _t(spark, sf, "sample_draws"), "source_id", "shard_id")
    texts = segments.select("source_id", "source_text")
    joined = texts.join(drawn, texts["source_id"].eqNullSafe(drawn["key"]))
    return joined.groupBy("draw_id", "source_id").agg(F.min("source_text").alias("source_text"))


def p7_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """What holds of any draw of the right size: rows, different ids, and rows whose text is that of their id."""
    segments = _t(spark, sf, "sampled_sources").groupBy("source_id").agg(F.min("source_text").alias("text"))
    drawn = p7_samples(spark, sf).join(segments, "source_id", "left")
    return drawn.groupBy("draw_id").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("ids"), F.count_if(F.col("source_text") == F.col("text")).alias("texts"))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_containers(_t(spark, sf, "documents"), _t(spark, sf, "containers"))


def p8_check(spark: SparkSession, sf: str) -> DataFrame:
    """What holds of any packing: documents that are there, containers over their capacity, documents cut without need or with a gap."""
    kinds = _t(spark, sf, "containers").select("container_kind", F.col("capacity_tokens").cast("long").alias("cap"))
    pieces = p8_containers(spark, sf).join(F.broadcast(kinds), "container_kind")
    boxes = pieces.groupBy("container_kind", "cap", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("container_kind").agg(F.count_if(F.col("n") > F.col("cap")).alias("overfull"))
    per = pieces.groupBy("container_kind", "cap", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.max("piece_no").alias("last"))
    docs = per.groupBy("container_kind").agg(F.count("*").alias("docs"), F.count_if((F.col("k") > 1) & (F.col("n") <= F.col("cap"))).alias("cut_in_vain"), F.count_if((F.col("n") != F.col("end")) | (F.col("k") != F.col("last") + 1)).alias("gaps"))
    return docs.join(boxes, "container_kind").select("container_kind", "docs", "overfull", "cut_in_vain", "gaps")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of each kind are, and how even their cost."""
    kinds = _t(spark, sf, "containers").select("container_kind", F.col("capacity_tokens").cast("long").alias("cap"))
    return packing.fill_report(p8_containers(spark, sf), kinds)


def _mixed(spark: SparkSession, sf: str) -> mixing.Mixed:
    return mixing.mix(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf).report.where("exhausted").select("mix_id", "source")


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.drawn_report(_mixed(spark, sf))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.draw_copies(_mixed(spark, sf)).select("mix_id", F.col("key").alias("doc_id"), F.col("n").alias("n_tokens"), "copies")


def p9_check(spark: SparkSession, sf: str) -> DataFrame:
    """What holds of any mix: documents taken more often than the target of any source in the mix allows."""
    most = _t(spark, sf, "mix_targets").groupBy("mix_id").agg(F.max("max_repeats").alias("most"))
    used = p9_mix(spark, sf).groupBy("mix_id", "doc_id").agg(F.sum("copies").alias("copies"))
    over = used.join(F.broadcast(most), "mix_id").where(F.col("copies") > F.col("most")).groupBy("mix_id").agg(F.count("*").alias("over"))
    return most.select("mix_id").join(over, "mix_id", "left").select("mix_id", F.coalesce("over", F.lit(0)).alias("over"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_spam.keyword_pages(_t(spark, sf, "documents")).select(F.col("page").alias("doc_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_documents, p2_found, p3_found, p3_labels, p4_found, p4_report, p4_sample, p5_found, p6_found, p6_classes, p7_samples, p7_sizes, p8_containers, p8_check, p8_fill, p9_found, p9_report, p9_mix, p9_check, p10_found]
    return {f.__name__: f for f in found}


_ITEMS = "it AS (SELECT source_id, max(lower(trim(kind))) AS kind, max(length_approx) AS len FROM sampled_sources GROUP BY source_id), n AS (SELECT count(*) AS n FROM it)"
_REPORT = f"""{_ITEMS}, r AS (SELECT plan_id, kind, length_from, greatest(min_rows::DOUBLE, round(target_share * sample_fraction * n, 6)) AS wanted,
  (SELECT count(*) FROM it WHERE it.kind = lower(trim(t.kind)) AND it.len >= t.length_from AND it.len < t.length_to) AS available FROM sample_targets t, n)"""


# near-duplicates by plain joins: copies collapsed, candidates by a shared rare n-gram, similarity by a count of shared ones
_SIMILAR = f"""WITH s AS (SELECT source_id, max(source_text) AS x FROM sampled_sources GROUP BY source_id),
u AS (SELECT source_id, {norm('lower(x)')} AS t FROM s WHERE length(x) >= 150),
c AS (SELECT t, row_number() OVER () AS id, min(source_id) AS rep FROM u GROUP BY t),
g AS (SELECT DISTINCT id, substr(t, i, 5) AS e FROM (SELECT id, t, unnest(range(1, length(t) - 3)) AS i FROM c)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
f AS (SELECT e, count(*) AS f FROM g GROUP BY e),
p AS (SELECT g.id, g.e, row_number() OVER (PARTITION BY g.id ORDER BY f.f, g.e) AS k, n.n FROM g JOIN f ON f.e = g.e JOIN n ON n.id = g.id),
q AS (SELECT id, e, n FROM p WHERE k <= n - ceil(0.7 * n) + 1),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM q a JOIN q b ON a.e = b.e AND a.id < b.id AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n)),
sim AS (SELECT cand.a, cand.b, count(*) AS o FROM cand JOIN g x ON x.id = cand.a JOIN g y ON y.id = cand.b AND y.e = x.e GROUP BY ALL),
l AS (SELECT a, b FROM sim JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE o >= 0.7 * (na.n + nb.n - o)),
m AS (SELECT u.source_id, c.id, c.rep FROM u JOIN c ON c.t = u.t)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that a plain engine can express on whole tables; the others are tested against brute force."""
    return {
        "p4_found": f"WITH {_REPORT} SELECT plan_id, kind, length_from FROM r WHERE available < wanted",
        "p4_report": f"WITH {_REPORT} SELECT plan_id, kind, length_from, wanted, available, least(available, floor(wanted + 0.5)::BIGINT) AS quota, available < wanted AS exhausted FROM r",
        "p4_sample": f"""WITH {_REPORT}, q AS (SELECT *, least(available, floor(wanted + 0.5)::BIGINT) AS quota FROM r),
k AS (SELECT t.plan_id, t.kind, t.length_from, it.source_id, q.quota,
  row_number() OVER (PARTITION BY t.plan_id, t.kind, t.length_from ORDER BY xor(('0x' || substr(sha256('17:' || it.source_id), 1, 15))::BIGINT, ('0x' || substr(sha256('17:' || t.plan_id), 1, 15))::BIGINT), it.source_id) AS k
  FROM sample_targets t JOIN it ON it.kind = lower(trim(t.kind)) AND it.len >= t.length_from AND it.len < t.length_to JOIN q ON q.plan_id = t.plan_id AND q.kind = t.kind AND q.length_from = t.length_from)
SELECT plan_id, kind, length_from, source_id FROM k WHERE k <= quota""",
        "p6_found": f"""{_SIMILAR}, r AS (SELECT x.source_id AS p, y.source_id AS q FROM l JOIN m x ON x.id = l.a JOIN m y ON y.id = l.b UNION ALL SELECT x.source_id, y.source_id FROM m x JOIN m y ON x.id = y.id AND x.source_id < y.source_id)
SELECT least(p, q) AS source_id_a, greatest(p, q) AS source_id_b FROM r""",
        "p6_classes": f"{_SIMILAR}, k AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM l UNION ALL SELECT b FROM l) GROUP BY id) SELECT m.source_id, m.rep, coalesce(k.links, 0) AS links FROM m LEFT JOIN k ON k.id = m.id",
        "p7_sizes": "WITH n AS (SELECT count(DISTINCT source_id) AS n FROM sampled_sources) SELECT draw_id, least(sample_size, n)::BIGINT AS n, least(sample_size, n)::BIGINT AS ids, least(sample_size, n)::BIGINT AS texts FROM sample_draws, n WHERE sample_size > 0 AND n > 0",
        "p8_check": "SELECT container_kind, (SELECT count(DISTINCT doc_id) FROM documents) AS docs, 0::BIGINT AS overfull, 0::BIGINT AS cut_in_vain, 0::BIGINT AS gaps FROM containers WHERE capacity_tokens > 0",
        "p9_check": "SELECT DISTINCT mix_id, 0::BIGINT AS over FROM mix_targets",
        # no SQL engine counts tokens; sizes in characters give the same sources (the targets are set so)
        "p9_found": """WITH n AS (SELECT source, sum(n_chars) AS n FROM documents GROUP BY source), a AS (SELECT sum(n_chars) AS n FROM documents)
SELECT t.mix_id, t.source FROM mix_targets t LEFT JOIN n ON n.source = t.source, a WHERE coalesce(n.n, 0) * t.max_repeats < t.target_share * t.budget_share * a.n""",
        "p5_found": """WITH d AS (SELECT DISTINCT source_id, candidate_index, prefilter.score_sample AS s FROM prefilter_candidates WHERE prefilter.score_sample IS NOT NULL AND NOT isnan(prefilter.score_sample))
SELECT source_id, candidate_index FROM d QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY s, candidate_index) <= 3""",
    }
