"""Examples with configurable field names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingloom.functions import text as X


@dataclass(frozen=True)
class ExampleFields:
    id: str = "id"
    src_text: str = "source"
    ref_text: str | None = "target"
    src_lang: str | None = None
    tgt_lang: str | None = None
    src_lang_code: str | None = None
    tgt_lang_code: str | None = None
    split: str | None = None
    bad_source: str | None = "is_bad_source"
    default_src_lang: str = "English"
    default_tgt_lang: str = "Korean"


def load_examples(df: DataFrame, fields: ExampleFields = ExampleFields(), split_name: str | None = None, limit: int | None = None) -> DataFrame:
    """id, src_text, ref_text, src_lang, tgt_lang, src_lang_code, tgt_lang_code of usable rows.

    Rows of another split, flagged as bad source, or with a blank source are left
    out. A flag given as text is true unless blank, "false", "no" or "0".
    """
    rows = df
    if fields.split and split_name is not None:
        rows = rows.where(X.strip(F.col(fields.split).cast("string")) == split_name)
    if fields.bad_source and fields.bad_source in df.columns:
        flag = F.col(fields.bad_source)
        if df.schema[fields.bad_source].dataType.typeName() == "string":
            flag = ~F.lower(F.trim(flag)).isin("", "false", "no", "0")
        rows = rows.where(~F.coalesce(flag.cast("boolean"), F.lit(False)))
    get = lambda name, default=None: X.pick_text(F.col(name), F.lit(default).cast("string")) if name and name in df.columns else F.lit(default).cast("string")
    out = rows.select(
        F.col(fields.id).cast("string").alias("id"), get(fields.src_text).alias("src_text"), get(fields.ref_text).alias("ref_text"),
        get(fields.src_lang, fields.default_src_lang).alias("src_lang"), get(fields.tgt_lang, fields.default_tgt_lang).alias("tgt_lang"),
        get(fields.src_lang_code).alias("src_lang_code"), get(fields.tgt_lang_code).alias("tgt_lang_code"),
    ).where("src_text is not null")
    return out if limit is None else out.limit(limit)
