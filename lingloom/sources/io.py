"""Readers and writers."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(conf).globStatus(p)
    return found is not None and len(found) > 0


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; nothing happens if it is not there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines (plain or gzip, glob allowed). A missing path is an empty table, blank lines are skipped.

    Strict: a bad line is an error. Otherwise its fields are null and the line is in ``_corrupt``.
    """
    shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not _exists(spark, path):
        return spark.createDataFrame([], shape)
    if strict:
        return spark.read.schema(shape).option("mode", "FAILFAST").json(path)
    return spark.read.schema(T.StructType([*shape.fields, T.StructField("_corrupt", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """A folder of JSON-lines parts; characters beyond ASCII are kept."""
    df.write.mode("append" if append else "overwrite").json(path)


def read_any(spark: SparkSession, path: str, limit: int | None = None, schema: T.StructType | str | None = None, order: str | None = None) -> DataFrame:
    """By suffix: .jsonl/.jsonlines (also .gz), .json (list, {"data": [...]}, or one object), .parquet. With a schema JSON lines are read once, not twice.

    ``limit`` keeps the first rows by ``order``, without one any rows.
    """
    plain = path.removesuffix(".gz")
    if plain.endswith((".jsonl", ".jsonlines")):
        df = spark.read.schema(schema).json(path) if schema is not None else spark.read.json(path)
    elif plain.endswith(".json"):
        df = spark.read.option("multiLine", True).json(path)
        if df.columns == ["data"] and df.schema["data"].dataType.typeName() == "array":
            df = df.select(F.explode("data").alias("d")).select("d.*")
    elif plain.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported file type: {path}")
    return df if limit is None else corpus(spark, df, most=limit, order=order)


def corpus(spark: SparkSession, source: DataFrame | str, lang: str | None = None, split: str | None = None, most: int | None = None, order: str | None = None) -> DataFrame:
    """A corpus from a table or path, cut to language and split (partition columns prune files) and to ``most`` rows."""
    df = source if isinstance(source, DataFrame) else read_any(spark, source)
    for name, value in (("lang", lang), ("split", split)):
        if value is not None and name in df.columns:
            df = df.where(F.col(name) == value)
    if most is None:
        return df
    if order is None:
        return df.limit(most)
    # only keys are ordered: the greatest of the first ``most``, then all rows up to it; texts stay where they are
    keys = df.select(F.col(order).alias("_k"))
    last = keys.orderBy("_k").limit(most).agg(F.max("_k").alias("m"), F.count("*").alias("n")).first()
    if last["n"] < most or last["m"] is None:
        return df if last["n"] < most else df.where(F.col(order).isNull()).limit(most)
    early = F.col(order).isNull() | (F.col(order) < F.lit(last["m"]))
    before = keys.where(F.col("_k").isNull() | (F.col("_k") < F.lit(last["m"]))).count()
    return df.where(early).unionByName(df.where(F.col(order) == F.lit(last["m"])).limit(most - before))


def fallback_id(df: DataFrame, names: tuple[str, ...] = ("id", "doc_id", "document_id")) -> DataFrame:
    """``doc_key``: the first identifier that is there and not blank. Zero is an identifier."""
    found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    rest = F.concat(F.lit("doc_"), F.monotonically_increasing_id().cast("string"))
    return df.withColumn("doc_key", F.coalesce(*found, rest))


def write_split(df: DataFrame, folder: str, force: bool = False, paths: dict[str, str] | None = None) -> dict[str, str]:
    """Train and eval parts (column ``part``) into two folders (``paths``, as of ``split_paths``); existing ones are only replaced by force."""
    paths = paths or {p: f"{folder.rstrip('/')}/{p}" for p in ("train", "eval")}
    for p in paths.values():
        if not force and _exists(df.sparkSession, p):
            raise FileExistsError(p)
    for part, p in paths.items():
        df.where(F.col("part") == part).drop("part").write.mode("overwrite").json(p)
    return paths


def _file_system(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(conf), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-side file on any file system that the session knows, written beside and renamed, so that no reader sees half of it."""
    jvm, fs, p = _file_system(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(draft, p):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, None if there is none."""
    jvm, fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_json_atomic(path: str, value: Any, spark: SparkSession | None = None) -> None:
    """A small driver-side JSON file, replaced as a whole; with a session on any file system it knows."""
    text = json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True)
    if spark is not None:
        write_text(spark, path, text)
        return
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)


def load_json(path: str, spark: SparkSession | None = None) -> Any:
    if spark is not None:
        text = read_text(spark, path)
        return {} if text is None else json.loads(text)
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


LOGS = ("train", "rollout", "eval_output")


def append_log(df: DataFrame, folder: str, kind: str, update: int) -> None:
    """Append rows of one update to the table of its kind; each row carries type and update."""
    if kind not in LOGS:
        raise ValueError(f"unknown log {kind}; known: {', '.join(LOGS)}")
    df.withColumn("type", F.lit(kind)).withColumn("update", F.lit(update)).write.mode("append").partitionBy("update").parquet(f"{folder.rstrip('/')}/{kind}")


ROLLOUT = (
    "example_id string, prompt_text string, prompt_input_ids array<int>, completion_text string, completion_token_ids array<int>, old_logprobs array<double>, ref_logprobs array<double>, "
    "token_char_offsets array<struct<start:int,end:int>>, src_text string, ref_text string"
)


def read_rollouts(spark: SparkSession, path: str) -> DataFrame:
    """Rollouts that an external generator has logged as JSON lines or Parquet; those without a completion are left out."""
    rows = spark.read.schema(ROLLOUT).parquet(path) if path.endswith(".parquet") else read_jsonl(spark, path, ROLLOUT)
    return rows.where(F.length(F.trim(F.coalesce("completion_text", F.lit("")))) > 0).where(F.size(F.coalesce("completion_token_ids", F.array().cast("array<int>"))) > 0)


def split_paths(path: str, ratio: float, folder: str | None = None, train: str | None = None, evaluation: str | None = None) -> dict[str, str]:
    """Names of the parts of a split: beside the input, or in ``folder``, with the shares in percent, unless named outright."""
    from lingloom.operators.sft import ratio_label

    head, _, name = path.rpartition("/")
    stem = name.removesuffix(".gz").rsplit(".", 1)[0]
    place = (folder if folder is not None else head).rstrip("/")
    at = lambda label: f"{place}/{stem}_{label}" if place else f"{stem}_{label}"
    return {"train": train or at(f"train_{ratio_label(1 - ratio)}"), "eval": evaluation or at(f"eval_{ratio_label(ratio)}")}
