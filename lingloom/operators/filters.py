"""Rule filter, judge verdicts, and the routing of rows by verdict."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingloom.functions import text as X

# Phrases that no output may hold.
BLOCKED = ["Here is the translation", "I will translate", "번역:", "assistant:", "user:", "system:", "<think>", "</think>", "```"]


@dataclass(frozen=True)
class FilterConfig:
    min_chars: int = 1
    max_chars: int = 20000
    length_ratio_min: float = 0.2
    length_ratio_max: float = 4.0
    max_copy_overlap: float = 0.8
    blocked: list[str] = field(default_factory=lambda: list(BLOCKED))


def rule_verdict(source: Column, target: Column, config: FilterConfig = FilterConfig()) -> Column:
    """struct(passed, reason_code, notes) of the first rule that fails, in a fixed order. A null target is empty."""
    clean = X.strip(F.coalesce(target, F.lit("")))
    given = F.coalesce(source, F.lit(""))
    blocked = F.array(*[F.lit(b) for b in config.blocked]).cast("array<string>")

    def measured(x: Column) -> Column:
        low = F.lower(x["clean"])
        return F.struct(
            F.length(x["clean"]).alias("n"),
            F.get(F.filter(blocked, lambda b: F.contains(low, F.lower(b))), F.lit(0)).alias("hit"),
            (F.length(x["clean"]) / F.greatest(F.lit(1), F.length(x["given"]))).alias("ratio"),
            X.jaccard_overlap(x["source"], x["clean"]).alias("overlap"),
        )

    def verdict(m: Column) -> Column:
        reason = (
            F.when(m["n"] == 0, "empty")
            .when(m["n"] < config.min_chars, "too_short")
            .when(m["n"] > config.max_chars, "too_long")
            .when(m["hit"].isNotNull(), "blocked_substring")
            .when(m["ratio"] < config.length_ratio_min, "ratio_too_small")
            .when(m["ratio"] > config.length_ratio_max, "ratio_too_large")
            .when(m["overlap"] > config.max_copy_overlap, "copy_overlap")
            .otherwise("pass")
        )
        notes = (
            lambda r: F.when(r == "blocked_substring", m["hit"])
            .when(r.isin("ratio_too_small", "ratio_too_large"), F.format_string("ratio=%.3f", m["ratio"]))
            .when(r == "copy_overlap", F.format_string("overlap=%.3f", m["overlap"]))
            .otherwise("")
        )
        return X.let(reason, lambda r: F.struct((r == "pass").alias("passed"), r.alias("reason_code"), notes(r).alias("notes")))

    # each measure once, however many rules and notes look at it
    whole = F.struct(clean.alias("clean"), X.strip(given).alias("given"), given.alias("source"))
    return X.let(X.let(whole, measured), verdict)


def parse_judge(raw: Column) -> Column:
    """struct(pass, reason_code, notes) of a judge's JSON object, else of the widest braces in its text, else null.

    Only a JSON boolean counts as a verdict: "false" in quotes is no verdict.
    """
    shape = "pass boolean, reason_code string, notes string"
    lenient = {"mode": "PERMISSIVE"}
    whole = F.from_json(raw, shape, lenient)
    inner = F.from_json(F.regexp_extract(raw, "(?s)\\{.*\\}", 0), shape, lenient)
    return F.when(whole["pass"].isNotNull(), whole).when(inner["pass"].isNotNull(), inner)


def judge_verdict(raw: Column, fail_policy: str = "conservative") -> Column:
    """Verdict of the judge; what cannot be parsed is rejected (conservative) or passed (permissive)."""
    if fail_policy not in ("conservative", "permissive"):
        raise ValueError(f"unknown fail policy: {fail_policy}")
    parsed = parse_judge(raw)
    ok = F.lit(fail_policy == "permissive")
    return F.struct(
        F.coalesce(parsed["pass"], ok).alias("passed"),
        F.when(parsed.isNotNull(), F.coalesce(parsed["reason_code"], F.when(parsed["pass"], "pass").otherwise("judge_reject"))).otherwise("judge_parse_failure").alias("reason_code"),
        F.coalesce(parsed["notes"], F.lit("")).alias("notes"),
    )


def apply_filters(df: DataFrame, source: str, target: str, judge: Column | None = None, config: FilterConfig = FilterConfig(), fail_policy: str = "conservative") -> DataFrame:
    """``filters`` struct of each row; the judge is only looked at where the rules pass."""
    ruled = df.withColumn("_rule", rule_verdict(F.col(source), F.col(target), config))
    tagged = lambda v, t: F.struct(v["passed"].alias("passed"), v["reason_code"].alias("reason_code"), v["notes"].alias("notes"), F.lit(t).alias("type"))
    own = tagged(F.col("_rule"), "rule_based")
    verdict = own if judge is None else F.when(F.col("_rule.passed"), tagged(judge_verdict(judge, fail_policy), "llm_judge")).otherwise(own)
    return ruled.withColumn("filters", verdict).drop("_rule")


def route(filtered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed, rejected): a partition of the rows."""
    return filtered.where("filters.passed"), filtered.where("NOT filters.passed")


def reject_counts(filtered: DataFrame) -> DataFrame:
    return filtered.groupBy(F.col("filters.reason_code").alias("reason_code")).agg(F.count("*").alias("n"))
