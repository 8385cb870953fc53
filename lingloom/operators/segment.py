"""Documents to lines, segments and token-bounded blobs."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingloom.functions import text as X


@dataclass(frozen=True)
class SegmentConfig:
    min_chars: int = 20
    max_chars: int = 5000
    merge_short_lines: bool = True
    noise_filter: bool = True
    blob_max_tokens: int = 512
    split_mode: str = "auto"


def raw_lines(text: Column, config: SegmentConfig = SegmentConfig(), is_list: bool = False) -> Column:
    """Normalised non-empty lines; overlong ones are cut after sentence marks. A list is taken as lines already, uncut."""
    lines = text if is_list else (X.split_lines(text) if config.split_mode in ("auto", "newline") else F.array(text))
    clean = F.filter(F.transform(lines, X.normalize_text), lambda x: F.length(x) > 0)
    if is_list:
        return clean
    cut = F.transform(
        clean, lambda x: F.when(F.length(x) > config.max_chars, F.filter(F.transform(F.split(x, X.SENTENCE_GAP, -1), X.normalize_text), lambda y: F.length(y) > 0)).otherwise(F.array(x))
    )
    return F.flatten(cut)


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text", config: SegmentConfig = SegmentConfig()) -> DataFrame:
    """(doc, pos, line). A null text gives no line."""
    is_list = docs.schema[text].dataType.typeName() == "array"
    # outer: else a filter on the array's size is inferred, and the array computed twice
    return docs.select(F.col(key).alias("doc"), F.posexplode_outer(raw_lines(F.col(text), config, is_list)).alias("pos", "line")).where("line is not null")


def merged(lines: Column, threshold: int) -> Column:
    """Array of (pos, line): short lines go to the front of the next long line; trailing ones to the end of the last; all short make one.

    ``lines`` is an array of texts. Each part is a slice of it that ends with a
    long line, so no fold over lines is needed. pos is that of the long line,
    -1 if there is none.
    """

    def of(x: Column) -> Column:
        at = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
        return X.let(F.filter(at, lambda i: F.length(F.get(x, i)) >= threshold), lambda long: F.when(F.size(x) == 0, nothing).when(F.size(long) == 0, F.array(part(x, F.lit(-1), F.lit(0), F.size(x)))).otherwise(parts(x, long)))

    def parts(x: Column, long: Column) -> Column:
        start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(long, k - 1) + 1)
        stop = lambda i, k: F.when(k == F.size(long) - 1, F.size(x)).otherwise(i + 1)
        return F.transform(long, lambda i, k: part(x, i, start(k), stop(i, k)))

    def part(x: Column, pos: Column, start: Column, stop: Column) -> Column:
        return F.struct(pos.cast("int").alias("pos"), F.array_join(F.slice(x, start + 1, stop - start), " ").alias("line"))

    nothing = F.array().cast("array<struct<pos:int,line:string>>")
    return X.let(lines, of)


def merge_short(lines: DataFrame, threshold: int) -> DataFrame:
    """``merged`` for a table (doc, pos, line) of lines: rows of a document are gathered first."""
    whole = lines.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("x"))
    return whole.select("doc", F.explode_outer(merged(F.col("x"), threshold)).alias("m")).where("m is not null").select("doc", "m.pos", "m.line")


SEGMENT = "array<struct<segment_index:int,source_text:string,length_approx:int>>"


def segment_array(text: Column, config: SegmentConfig = SegmentConfig(), is_list: bool = False) -> Column:
    """Segments of a document in order: array of (segment_index, source_text, length_approx).

    Indices count merged lines before the filters, so that ids keep their gaps.
    """
    lines = raw_lines(text, config, is_list)
    if config.merge_short_lines:
        lines = F.transform(merged(lines, config.min_chars), lambda m: m["line"])
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("segment_index"), x.alias("source_text")))
    fits = lambda x: F.length(x["source_text"]).between(config.min_chars, config.max_chars)
    kept = F.filter(numbered, fits)
    if config.noise_filter:
        kept = F.filter(kept, lambda x: ~X.is_noise(x["source_text"]))
    return F.transform(kept, lambda x: F.struct(x["segment_index"].alias("segment_index"), x["source_text"].alias("source_text"), X.approx_token_length(x["source_text"]).alias("length_approx")))


def segmented(docs: DataFrame, key: str = "doc_id", text: str = "text", config: SegmentConfig = SegmentConfig()) -> DataFrame:
    """(doc, segs): each document with the array of its segments. A document is one row, so nothing is shuffled. A null text has none."""
    is_list = docs.schema[text].dataType.typeName() == "array"
    return docs.select(F.col(key).cast("string").alias("doc"), F.coalesce(segment_array(F.col(text), config, is_list), F.array().cast(SEGMENT)).alias("segs"))


def segment_rows(whole: DataFrame) -> DataFrame:
    """One row a segment from ``segmented``: source_id, source_text, kind, length_approx, doc, segment_index, char_len."""
    # outer: else a filter on the array's size is inferred, and the array computed twice
    rows = whole.select("doc", F.explode_outer("segs").alias("s")).where("s is not null").select("doc", "s.*")
    return rows.select(
        F.concat_ws(":", "doc", F.lit("s"), F.col("segment_index").cast("string")).alias("source_id"), "source_text", F.lit("sentence").alias("kind"), "length_approx",
        "doc", "segment_index", F.length("source_text").alias("char_len"),
    )


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text", config: SegmentConfig = SegmentConfig()) -> DataFrame:
    """Sentence segments: source_id, source_text, kind, length_approx, doc, segment_index, char_len."""
    return segment_rows(segmented(docs, key, text, config))


_RANGES = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())]))


@F.pandas_udf(_RANGES)
def _pack(lengths: pd.Series, most: pd.Series) -> pd.Series:
    """Where each blob begins and how many segments it takes."""

    def one(ns, limit):
        out, total = [], 0
        for k, n in enumerate(ns):
            if k == 0 or total + n > limit:
                out.append({"at": k, "n": 0})
                total = 0
            total += n
            out[-1]["n"] += 1
        return out

    return pd.Series([one(ns, m) for ns, m in zip(lengths, most)])


def blob_rows(whole: DataFrame, config: SegmentConfig = SegmentConfig()) -> DataFrame:
    """Greedy blobs of consecutive segments, from ``segmented``: closed before a segment that would exceed ``blob_max_tokens``.

    A running sum with resets: only the lengths of a document pass through an
    Arrow batch; its blobs are slices of its array, and nothing is shuffled. One
    oversize segment is a blob of its own.
    """
    packed = whole.select("doc", "segs", _pack(F.transform("segs", lambda x: x["length_approx"]), F.lit(config.blob_max_tokens)).alias("b"))

    def blob(r: Column) -> Column:
        inside = F.slice("segs", r["at"] + 1, r["n"])
        return F.struct(
            F.array_join(F.transform(inside, lambda x: x["source_text"]), "\n").alias("source_text"),
            F.get(F.col("segs"), r["at"])["segment_index"].alias("span_from"), F.get(F.col("segs"), r["at"] + r["n"] - 1)["segment_index"].alias("span_to"), r["n"].alias("num_segments"),
        )

    rows = packed.select("doc", F.posexplode_outer(F.transform("b", blob)).alias("blob", "x")).where("x is not null").select("doc", "blob", "x.*")
    return rows.select(
        F.concat_ws(":", "doc", F.lit("b"), F.col("blob").cast("string")).alias("source_id"), "source_text", F.lit("blob").alias("kind"),
        X.approx_token_length(F.col("source_text")).alias("length_approx"), "doc", "span_from", "span_to", "num_segments",
    )


def blobs(segs: DataFrame, config: SegmentConfig = SegmentConfig()) -> DataFrame:
    """``blob_rows`` for a table of segments: those of a document are gathered first."""
    whole = segs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("segment_index", "source_text", "length_approx"))).alias("segs"))
    return blob_rows(whole, config)


def source_rows(segs: DataFrame, source: str, target: str, boundaries: list[int], lang: str, split: str) -> DataFrame:
    """Segments with pair, languages, length bucket and provenance."""
    from lingloom.operators.sample import bucket_of

    has = lambda c, t: (F.col(c) if c in segs.columns else F.lit(None)).cast(t)
    span = F.when(has("span_from", "int").isNotNull(), F.array(has("span_from", "int"), has("span_to", "int")))
    return segs.select(
        F.lit(f"{source}->{target}").alias("pair_id"), F.lit(source).alias("source_lang_code"), F.lit(target).alias("target_lang_code"), "source_id", "source_text", "kind", "length_approx",
        bucket_of(F.col("length_approx"), boundaries).alias("length_bucket_id"),
        F.struct(
            F.lit(lang).alias("lang"), F.lit(split).alias("split"), F.col("doc").alias("doc_id"), has("segment_index", "int").alias("segment_index"),
            has("char_len", "int").alias("char_len"), span.alias("segment_span"), has("num_segments", "int").alias("num_segments"),
        ).alias("madlad"),
    )
