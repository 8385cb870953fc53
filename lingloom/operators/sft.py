"""Training rows from pairs: prompts, chat rendering, token budget, summaries, padded batches."""

from __future__ import annotations

import re
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingloom.functions import text as X
from lingloom.functions import tokens as K

# Prompt texts.
TRANSLATE_SYSTEM = "You are a professional translator."
TRANSLATE_USER = (
    "Translate the following text from {source_lang} ({src_lang_code}) to {target_lang} ({tgt_lang_code}).\n"
    "Preserve meaning and nuance. Use natural grammar in the target language.\n"
    "Output only the translation with no commentary.\n\nText:\n{text}"
)
JUDGE_SYSTEM = "You are a strict translation quality gate. Return JSON only."
JUDGE_USER = (
    "Given a translation candidate, decide whether it should be accepted.\n"
    'Return exactly one JSON object: {{"pass": true|false, "reason_code": "...", "notes": "..."}}.\n'
    "Criteria: target-language correctness, no extra commentary, no severe meaning loss.\n\n"
    "Source language: {source_lang}\nTarget language: {target_lang}\nSource text:\n{source_text}\n\nCandidate translation:\n{candidate}"
)
ROLLOUT_USER = (
    "You are a professional {source_lang} ({src_lang_code}) to {target_lang} ({tgt_lang_code}) translator. "
    "Your goal is to accurately convey the meaning and nuances of the original {source_lang} text while adhering to {target_lang} grammar, vocabulary, and cultural sensitivities. "
    "Produce only the {target_lang} translation, without any additional explanations or commentary. "
    "Please translate the following {source_lang} text into {target_lang}:\\n\\n{text}"
)
PLACEHOLDERS = ("source_lang", "src_lang_code", "target_lang", "tgt_lang_code", "text")
# Fixed value: pieces that stand for tokens where no tokenizer is plugged in.
TOKEN = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]"
EOS = "<eos>"


def template(pattern: str, **columns: Column) -> Column:
    """A format string compiled once into a concatenation. Unknown placeholders are an error."""
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(pattern):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in columns:
                raise ValueError(f"unknown placeholder {name}; allowed: {', '.join(sorted(columns))}")
            parts.append(columns[name])
    return F.concat(*parts) if parts else F.lit("")


def check_template(pattern: str) -> None:
    missing = set(PLACEHOLDERS) - {name for _, name, _, _ in Formatter().parse(pattern) if name}
    if missing:
        raise ValueError(f"template lacks {', '.join(sorted(missing))}")


def chat_codes(lang: Column, code: Column) -> Column:
    """The language code of a prompt, or the name where there is no code."""
    return X.pick_text(code, X.pick_text(lang, F.lit("")))


def rollout_prompt(source_lang: Column, src_code: Column, target_lang: Column, tgt_code: Column, text: Column, pattern: str = ROLLOUT_USER) -> Column:
    """The prompt of a rollout. Its default holds backslash and n where it means a line end, as models were trained on it so."""
    return template(pattern, source_lang=source_lang, src_lang_code=chat_codes(source_lang, src_code), target_lang=target_lang, tgt_lang_code=chat_codes(target_lang, tgt_code), text=text)


def preview(df: DataFrame, rows: int, most_chars: int, **columns: Column) -> list[dict[str, str]]:
    """The first rows as they would be logged: each column a safe string, cut to ``most_chars`` (0: uncut). A value that cannot be rendered is left empty."""
    shown = {n: F.coalesce(c.try_cast("string"), F.lit("")) for n, c in columns.items()}
    cut = [(X.truncate_for_log(c, most_chars) if most_chars else c).alias(n) for n, c in shown.items()]
    return [r.asDict() for r in df.limit(max(0, rows)).select(*cut).collect()]


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def translate_messages(source_lang: Column, target_lang: Column, src_code: Column, tgt_code: Column, text: Column) -> Column:
    user = template(TRANSLATE_USER, source_lang=source_lang, target_lang=target_lang, src_lang_code=src_code, tgt_lang_code=tgt_code, text=text)
    return F.array(message("system", F.lit(TRANSLATE_SYSTEM)), message("user", user))


def judge_messages(source_lang: Column, target_lang: Column, source: Column, candidate: Column) -> Column:
    user = template(JUDGE_USER, source_lang=source_lang, target_lang=target_lang, source_text=source, candidate=candidate)
    return F.array(message("system", F.lit(JUDGE_SYSTEM)), message("user", user))


def train_messages(prompt: Column, answer: Column | None = None) -> Column:
    return F.array(message("user", prompt), *([message("assistant", answer)] if answer is not None else []))


def render_chat(messages: Column, generation: bool = False) -> Column:
    """``ROLE: content`` blocks joined by blank lines, with an open ASSISTANT: for generation."""
    blocks = F.transform(messages, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"]))
    return F.array_join(F.concat(blocks, F.array(F.lit("ASSISTANT:"))) if generation else blocks, "\n\n")


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


@dataclass(frozen=True)
class BudgetConfig:
    max_tokens: int = 1024


def tokenize_pairs(df: DataFrame, prompt: Column, target: Column, config: BudgetConfig = BudgetConfig()) -> DataFrame:
    """Columns input, labels, prompt_tokens, target_tokens, full_tokens of each pair under the token budget.

    A blank target gets no target tokens. The reserve for the target keeps at
    least one of its tokens at any budget of 2 or more, so the source never has
    to be halved until something of the target survives.
    """
    t = F.when(X.strip(target) == "", F.array().cast("array<string>")).otherwise(pieces(target))
    out = df.withColumn("_b", K.budget(pieces(prompt), t, config.max_tokens, EOS))
    full = F.col("_b.prompt_tokens") + F.col("_b.target_tokens")
    return out.select(*df.columns, "_b.input", "_b.labels", "_b.prompt_tokens", "_b.target_tokens", full.alias("full_tokens"))


def trainable(df: DataFrame) -> DataFrame:
    return df.where("target_tokens > 0")


def summary(df: DataFrame, most: int) -> DataFrame:
    """One row of counts and extremes; zeros without rows."""
    z = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return df.agg(
        F.count("*").alias("rows"), F.count_if(F.col("target_tokens") == 0).alias("zero_target"), F.count_if(F.col("prompt_tokens") >= most).alias("prompt_at_max"),
        F.count_if(F.col("full_tokens") >= most).alias("full_at_max"), z(F.max("prompt_tokens"), "max_prompt"), z(F.max("full_tokens"), "max_full"),
        F.coalesce(F.avg("target_tokens"), F.lit(0.0)).alias("mean_target"),
    )


def padded_batches(df: DataFrame, key: str, batch: int, multiple: int = 8, label_pad: str = "-100", pad: str = "<pad>") -> DataFrame:
    """Rows of a batch padded to the longest of it, rounded up to a multiple. ``df`` has batch_id, input and labels."""
    widest = df.groupBy("batch_id").agg((F.ceil(F.max(F.size("input")) / multiple) * multiple).cast("int").alias("width"))
    j = df.join(widest, "batch_id")
    return j.withColumn("mask", K.pad(F.transform("input", lambda x: F.lit("1")), F.col("width"), "0")).withColumn("input", K.pad(F.col("input"), F.col("width"), pad)).withColumn(
        "labels", K.pad(F.col("labels"), F.col("width"), label_pad)
    )


def typed_scan(lines: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """Required fields of JSON objects as strings; bad lines dropped. Missing is empty, other kinds become text."""
    parsed = F.try_parse_json(F.col(column))
    rows = lines.where(F.trim(column) != "").withColumn("_v", parsed).where(F.schema_of_variant("_v").startswith("OBJECT"))
    return rows.select(*[F.coalesce(F.get_json_object(column, f"$.{f}"), F.lit("")).alias(f) for f in fields])


def scan_stats(lines: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """Counts of a tolerant scan: lines, bad JSON, rows, and for each field missing and non-string values."""
    v = F.try_parse_json(F.col(column))
    live = lines.where(F.trim(column) != "").withColumn("_v", v).withColumn("_ok", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    kind = lambda f: F.schema_of_variant(F.try_variant_get("_v", f"$.{f}", "variant"))
    per = [x for f in fields for x in (
        F.count_if(F.col("_ok") & F.get_json_object(column, f"$.{f}").isNull()).alias(f"{f}_missing"),
        F.count_if(F.col("_ok") & F.get_json_object(column, f"$.{f}").isNotNull() & (kind(f) != "STRING")).alias(f"{f}_non_string"),
    )]
    return live.agg(F.count("*").alias("total_lines"), F.count_if(F.col("_v").isNull()).alias("bad_json"), F.count_if("_ok").alias("rows"), *per)


def ratio_label(ratio: float) -> str:
    """0.05 as 5, 0.125 as 12p5."""
    return re.sub(r"\.?0+$", "", f"{ratio * 100:.6f}").replace(".", "p")
