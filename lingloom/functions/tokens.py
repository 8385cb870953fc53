"""Array computations over tokens: offsets, span rewards, alignment, policy loss."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Penalties by severity.
SEVERITY_WEIGHTS = {"MINOR": -1.0, "MAJOR": -5.0, "CRITICAL": -10.0}


_OFFSETS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_OFFSETS)
def _offsets(lengths: pd.Series) -> pd.Series:
    def one(ns):
        ends = list(accumulate(int(n) for n in ns))
        return [{"start": e - int(n), "end": e} for n, e in zip(ns, ends)]

    return lengths.map(lambda ns: None if ns is None else one(ns))


def piece_offsets(pieces: Column) -> Column:
    """[start, end) of each piece in the joined text. A running sum over an array is no Catalyst expression of
    linear cost, so the lengths, not the pieces, go through an Arrow batch."""
    return _offsets(F.transform(pieces, F.length))


def trim_completion(ids: Column, stops: list[int]) -> Column:
    """Token ids before the first end or padding id."""
    at = F.array_position(F.transform(ids, lambda t: t.isin(stops)), True)
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)


def common_prefix_length(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(n).cast("int")


def align(*arrays: Column) -> list[Column]:
    """All arrays cut to the shortest."""
    n = F.least(*[F.size(a) for a in arrays])
    return [F.slice(a, F.lit(1), n) for a in arrays]


def combine(sequence: Column, token: Column) -> Column:
    """Element-wise sum; lengths must agree."""
    summed = F.zip_with(sequence, token, lambda a, b: a + b)
    return F.when(F.size(sequence) == F.size(token), summed).otherwise(F.raise_error(F.lit("sequence/token reward length mismatch")).cast("array<double>"))


def broadcast_reward(reward: Column, n: Column) -> Column:
    return F.array_repeat(reward, n)


def sequence_reward(first: Column, second: Column, offset: float, w_first: float, w_second: float, scale: float) -> Column:
    """Weighted sum of (offset - first score) and the scaled second score."""
    return (F.lit(offset) - first) * w_first + second * scale * w_second


def severity_weight(severity: Column, weights: dict[str, float] = SEVERITY_WEIGHTS) -> Column:
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(severity))), F.lit(0.0))


def span_token_rewards(
    offsets: Column, spans: Column, policy: str = "any_overlap", combine_policy: str = "sum", threshold: float = 0.5, use_confidence: bool = False, weights: dict[str, float] = SEVERITY_WEIGHTS
) -> Column:
    """Penalty of each token from the error spans that overlap it.

    Empty spans, unknown severities and tokens of no width count nothing. With
    ``max`` the mildest penalty of a token is kept, with ``min`` the worst.
    """
    if policy not in ("any_overlap", "majority_overlap") or combine_policy not in ("sum", "min", "max"):
        raise ValueError("unknown overlap or combine policy")

    def weighed(s: Column) -> Column:
        w = severity_weight(s["severity"], weights)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), (w * F.coalesce(s["confidence"], F.lit(1.0)) if use_confidence else w).alias("w"))

    def of_token(o: Column, live: Column) -> Column:
        overlap = lambda s: F.least(o["end"], s["end"]) - F.greatest(o["start"], s["start"])
        width = o["end"] - o["start"]
        enough = lambda s: overlap(s) > 0 if policy == "any_overlap" else (overlap(s) > 0) & (overlap(s) / F.greatest(width, F.lit(1)) >= threshold)
        hits = F.filter(live, enough)
        if combine_policy == "sum":
            total = F.aggregate(hits, F.lit(0.0), lambda a, s: a + s["w"])
        else:
            ws = F.transform(hits, lambda s: s["w"])
            total = F.coalesce(F.array_min(ws) if combine_policy == "min" else F.array_max(ws), F.lit(0.0))
        return F.when(width > 0, total).otherwise(F.lit(0.0))

    # spans are weighed and sifted once a row, not once a token
    sifted = F.filter(F.transform(spans, weighed), lambda s: (s["end"] > s["start"]) & (s["w"] != 0.0))
    return F.transform(F.array(sifted), lambda live: F.transform(offsets, lambda o: of_token(o, live)))[0]


def policy_token_loss(new: Column, old: Column, advantage: Column, ref: Column | None, clip: float, kl: float, algorithm: str = "grpo", entropy: Column | None = None, entropy_coef: float = 0.0) -> Column:
    """Per token: loss, clipped, approx_kl, ref_kl, entropy, from logged log-probabilities cut to the shortest array.

    With a positive ``entropy_coef`` the logged entropy of each token lowers its loss.
    """
    use_entropy = entropy is not None and entropy_coef > 0
    arrays = align(new, old, advantage, *([ref] if ref is not None else []))
    named = [a.alias(n) for a, n in zip(arrays, ("n", "o", "a", "r"))]
    if use_entropy:
        named.append(F.slice(entropy, F.lit(1), F.size(arrays[0])).alias("e"))
    zipped = F.arrays_zip(*named)

    def token(x: Column) -> Column:
        ratio = F.exp(x["n"] - x["o"])
        clipped = F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), ratio))
        loss = -F.least(ratio * x["a"], clipped * x["a"]) if algorithm == "grpo" else -(x["n"] * x["a"])
        out = ((ratio > 1 + clip) | (ratio < 1 - clip)).cast("double") if algorithm == "grpo" else F.lit(0.0)
        ref_kl = x["n"] - x["r"] if ref is not None else F.lit(0.0)
        total = loss + ref_kl * kl if ref is not None and kl > 0 else loss
        e = F.coalesce(x["e"], F.lit(0.0)) if use_entropy else F.lit(0.0)
        return F.struct((total - e * entropy_coef if use_entropy else total).alias("loss"), out.alias("clipped"), (F.pow(x["n"] - x["o"], F.lit(2.0)) * 0.5).alias("approx_kl"), ref_kl.alias("ref_kl"), e.alias("entropy"))

    if algorithm not in ("grpo", "reinforce"):
        raise ValueError(f"unknown algorithm: {algorithm}")
    return F.transform(zipped, token)


def budget(prompt: Column, target: Column, most: int, end: str) -> Column:
    """Prompt and target tokens under a length budget, and labels that ignore the prompt.

    A part of the budget is reserved for the target; the prompt is cut first,
    then the target; the end token comes last, in place of the last token where
    there is no room. A blank target leaves only the prompt.
    """
    ignored = "-100"
    has = F.size(target) > 0
    reserve = F.least(F.size(target), F.lit(max(32, most // 8)))
    fits = F.size(prompt) + F.size(target) <= most
    p = F.when(~has, F.slice(prompt, 1, most)).when(fits, prompt).otherwise(F.slice(prompt, F.lit(1), F.greatest(F.lit(0), F.lit(most) - reserve)))

    def with_prompt(p: Column) -> Column:
        t = F.when(~has, F.slice(target, 1, 0)).when(fits, target).otherwise(F.slice(target, F.lit(1), F.greatest(F.lit(0), F.lit(most) - F.size(p))))
        return F.transform(F.array(t), lambda t: finished(p, t))[0]

    def finished(p: Column, t: Column) -> Column:
        closed = F.size(t) > 0
        last = F.when(closed, F.element_at(t, -1))
        room = F.size(p) + F.size(t) < most
        done = (
            F.when(~has | (closed & (last == end)), t)
            .when(room, F.concat(t, F.array(F.lit(end))))
            .when(closed, F.concat(F.slice(t, F.lit(1), F.size(t) - 1), F.array(F.lit(end))))
            .otherwise(F.array(F.lit(end)))
        )
        kept = F.when(has & ~room & ~closed, F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p)
        labels = F.concat(F.array_repeat(F.lit(ignored), F.size(kept)), done)
        return F.struct(F.concat(kept, done).alias("input"), labels.alias("labels"), F.size(kept).alias("prompt_tokens"), F.size(done).alias("target_tokens"))

    return F.transform(F.array(p), with_prompt)[0]


def pad(ids: Column, width: Column, filler: str) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(filler), F.greatest(F.lit(0), width - F.size(ids))))


def union_ids(*ids: Column) -> Column:
    """Ids of several lists in order, each once; null lists count as empty."""
    return F.array_distinct(F.concat(*[F.coalesce(i, F.array().cast("array<int>")) for i in ids]))


def coerce_ids(raw: Column) -> Column:
    """Token ids from text: a JSON list, a list of lists, one number, or numbers set apart by blanks.

    Null and blank give an empty list, anything else an error.
    """
    t = F.trim(raw)
    flat = F.from_json(t, "array<int>", {"mode": "PERMISSIVE"})
    nested = F.flatten(F.from_json(t, "array<array<int>>", {"mode": "PERMISSIVE"}))
    spaced = F.transform(F.split(t, "\\s+"), lambda x: x.try_cast("int"))
    return (
        F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<int>"))
        .when(t.rlike("^\\[\\s*\\["), nested)
        .when(t.startswith("["), flat)
        .when(t.rlike("^-?\\d+(\\s+-?\\d+)*$"), spaced)
        .otherwise(F.raise_error(F.concat(F.lit("no token ids: "), F.substring(t, 1, 120))).cast("array<int>"))
    )


SPAN = "struct<start:int,end:int,severity:string,confidence:double>"


def error_spans(metadata: Column, expected: Column) -> Column:
    """Error spans of each of ``expected`` samples from a scorer's JSON metadata.

    Known layouts: a list with an entry a sample (an object with error_spans, or a
    list of spans), an object with error_spans (a list a sample, or the spans of
    the first), an object with samples. Missing samples get no spans, surplus ones
    are dropped.
    """
    lenient = {"mode": "PERMISSIVE"}
    one = lambda j: F.when(j.startswith("["), F.from_json(j, f"array<{SPAN}>", lenient)).otherwise(F.from_json(j, f"struct<error_spans:array<{SPAN}>>", lenient)["error_spans"])
    items = lambda j: F.from_json(j, "array<string>", lenient)
    nothing = F.array().cast(f"array<{SPAN}>")
    kept = lambda spans: F.coalesce(F.filter(spans, lambda s: s.isNotNull()), nothing)
    t = F.coalesce(F.trim(metadata), F.lit(""))
    inner = F.coalesce(F.get_json_object(t, "$.error_spans"), F.lit(""))
    per_sample = (
        F.when(t.startswith("["), F.transform(items(t), lambda j: kept(one(j))))
        .when(inner.rlike("^\\[\\s*\\["), F.transform(items(inner), lambda j: kept(one(j))))
        .when(inner.startswith("["), F.array(kept(F.from_json(inner, f"array<{SPAN}>", lenient))))
        .otherwise(F.transform(items(F.coalesce(F.get_json_object(t, "$.samples"), F.lit("[]"))), lambda j: kept(one(j))))
    )
    filled = F.concat(F.coalesce(per_sample, F.array().cast(f"array<array<{SPAN}>>")), F.array_repeat(nothing, F.greatest(F.lit(0), expected)))
    return F.slice(filled, F.lit(1), expected)
