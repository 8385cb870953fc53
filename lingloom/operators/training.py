"""Training rows through a real tokenizer: chat template, target span, token budget, source shrinking.

The tokenizer is a boundary: an object made once in each Python worker. Rows go
through it in Arrow batches; what needs no tokenizer stays in ``sft``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IGNORED = -100


class Tokenizer(Protocol):
    """``encode`` gives ids. ``render`` gives the text of a chat by the model's template, or None without one.

    ``end`` closes a text, ``turn_end`` a turn of the template; either may be None.
    """

    end: int | None
    turn_end: int | None

    def encode(self, text: str) -> list[int]: ...

    def render(self, messages: list[dict[str, str]], generation: bool) -> str | None: ...


@dataclass(frozen=True)
class TrainingConfig:
    """max_tokens: of a row. reserve_least, reserve_part: tokens kept for the target, the larger of the number and of
    max_tokens divided by the part. shrink_steps: times that the source may be halved."""

    max_tokens: int = 1024
    reserve_least: int = 32
    reserve_part: int = 8
    shrink_steps: int = 6


def chat_ids(tokenizer: Tokenizer, messages: list[dict[str, str]], generation: bool) -> list[int]:
    """Ids of a chat by its template, else of plain ``ROLE: content`` blocks."""
    text = tokenizer.render(messages, generation)
    if text is None:
        blocks = [f"{m['role'].upper()}: {m['content']}" for m in messages] + (["ASSISTANT:"] if generation else [])
        text = "\n\n".join(blocks)
    return list(tokenizer.encode(text))


def shared(a: list[int], b: list[int]) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def target_span(tokenizer: Tokenizer, messages: list[dict[str, str]], target: str) -> tuple[list[int], list[int]] | None:
    """(prompt, target) ids as the template renders them; None without a template or if nothing of the target is left.

    The target begins where the open prompt ends; if the template closes it
    otherwise, where the chats with and without the answer part.
    """
    if tokenizer.render(messages, True) is None:
        return None
    answered = chat_ids(tokenizer, [*messages, {"role": "assistant", "content": target}], False)
    opened = chat_ids(tokenizer, messages, True)
    at = len(opened) if answered[: len(opened)] == opened else 0
    if not at or at == len(answered):
        at = shared(chat_ids(tokenizer, [*messages, {"role": "assistant", "content": ""}], False), answered)
    return (answered[:at], answered[at:]) if at < len(answered) else None


def within_budget(prompt: list[int], target: list[int], closing: int | None, config: TrainingConfig) -> tuple[list[int], list[int]]:
    """The prompt is cut before the target; the closing id comes last, in place of the last one where there is no room."""
    most = config.max_tokens
    if len(prompt) + len(target) > most:
        reserve = min(len(target), max(config.reserve_least, most // config.reserve_part))
        prompt = prompt[: max(0, most - reserve)]
        target = target[: max(0, most - len(prompt))]
    if closing is None or (target and target[-1] == closing):
        return prompt, target
    if len(prompt) + len(target) < most:
        return prompt, [*target, closing]
    if target:
        return prompt, [*target[:-1], closing]
    return (prompt[:-1], [closing]) if prompt else (prompt, target)


def training_row(tokenizer: Tokenizer, source: str, target: str, messages_of: Callable[[str], list[dict[str, str]]], config: TrainingConfig = TrainingConfig()) -> dict:
    """Ids, labels and counts of one pair. While no id of the target survives, the source is halved."""
    plain = list(tokenizer.encode(target)) if target.strip() else []
    text, steps = source, 0
    while True:
        messages = messages_of(text)
        if not plain:
            prompt, ids = chat_ids(tokenizer, messages, True)[: config.max_tokens], []
            break
        span = target_span(tokenizer, messages, target)
        prompt, ids = span if span else (chat_ids(tokenizer, messages, True), plain)
        turned = span is not None and tokenizer.turn_end is not None and ids[-1] == tokenizer.turn_end
        prompt, ids = within_budget(prompt, ids, tokenizer.turn_end if turned else tokenizer.end, config)
        if ids or len(text) <= 1 or steps >= config.shrink_steps:
            break
        text, steps = text[: max(1, len(text) // 2)], steps + 1
    return {
        "input_ids": prompt + ids, "labels": [IGNORED] * len(prompt) + ids, "num_target_tokens": len(ids), "prompt_tokens": len(prompt), "full_tokens": len(prompt) + len(ids),
        "source_chars": len(text), "source_chars_original": len(source), "source_shrink_steps": steps, "target_chars": len(target),
    }


COUNTS = ["num_target_tokens", "prompt_tokens", "full_tokens", "source_chars", "source_chars_original", "source_shrink_steps", "target_chars"]


def training_rows(df: DataFrame, key: str, source: str, target: str, make: Callable[[], Tokenizer], messages_of: Callable[[str], list[dict[str, str]]], config: TrainingConfig = TrainingConfig()) -> DataFrame:
    """(key, input_ids, labels, counts ...) of each pair; null texts are empty."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, input_ids array<int>, labels array<int>, " + ", ".join(f"{c} int" for c in COUNTS)

    def run(batches):
        tokenizer = make()
        for b in batches:
            rows = [training_row(tokenizer, s or "", t or "", messages_of, config) for s, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            lists = [pa.array([r[c] for r in rows], type=pa.list_(pa.int32())) for c in ("input_ids", "labels")]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, *[pa.array([r[c] for r in rows], type=pa.int32()) for c in COUNTS]], names=[key, "input_ids", "labels", *COUNTS])

    return df.select(key, source, target).mapInArrow(run, schema)


def with_targets(rows: DataFrame, counted: str = "num_target_tokens", required: bool = True) -> DataFrame | None:
    """Rows with a target token. If none is left: an error where they are required (training), else None (no evaluation)."""
    live = rows.where(F.col(counted) > 0)
    if not live.isEmpty():
        return live
    if required:
        raise ValueError("no row has a target token: check the target field and the token budget")
    return None
