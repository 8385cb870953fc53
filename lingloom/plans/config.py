"""Configuration as frozen dataclasses; unknown keys are errors, not ignored."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field
from typing import Any

from lingloom.functions.lang import ordered_distinct
from lingloom.operators.filters import BLOCKED
from lingloom.operators.sample import BOUNDARIES
from lingloom.operators.sft import TRANSLATE_USER, check_template


@dataclass(frozen=True)
class DataSection:
    lang: str = "en"
    split: str = "clean"
    source_lang: str = "en"
    target_langs: list[str] = field(default_factory=lambda: ["ko"])
    sample_pool_size: int = 300
    max_scan_docs: int | None = None
    sentence_ratio: float = 0.5


@dataclass(frozen=True)
class SegmentSection:
    min_chars: int = 20
    max_chars: int = 5000
    merge_short_lines: bool = True
    noise_filter: bool = True
    blobs: bool = True
    blob_max_tokens: int = 512


@dataclass(frozen=True)
class SampleSection:
    boundaries: list[int] = field(default_factory=lambda: list(BOUNDARIES))
    oversample: float = 2.0
    seed: int = 7


@dataclass(frozen=True)
class SelectSection:
    top_n: int = 50
    num_candidates: int = 4
    store_top_k: int = 2


@dataclass(frozen=True)
class FilterSection:
    rule_based: bool = True
    min_chars: int = 1
    max_chars: int = 20000
    length_ratio_min: float = 0.2
    length_ratio_max: float = 4.0
    max_copy_overlap: float = 0.8
    blocked: list[str] = field(default_factory=lambda: list(BLOCKED))
    judge: bool = False
    fail_policy: str = "conservative"


@dataclass(frozen=True)
class PipelineConfig:
    data: DataSection = DataSection()
    segment: SegmentSection = SegmentSection()
    sample: SampleSection = SampleSection()
    select: SelectSection = SelectSection()
    filters: FilterSection = FilterSection()
    output: str = "out"
    call_parts: int = 4  # parts in which external calls are made and kept


def from_dict(kind: type, values: dict[str, Any]) -> Any:
    """Fill a dataclass recursively. A key it does not have is an error."""
    known = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise ValueError(f"unknown keys in {kind.__name__}: {', '.join(unknown)}")
    out = {}
    for name, value in values.items():
        default = known[name].default if known[name].default is not dataclasses.MISSING else None
        out[name] = from_dict(type(default), value) if dataclasses.is_dataclass(default) and isinstance(value, dict) else value
    return kind(**out)


# The sizes of a full run: the pool, the sources selected from it, and the candidates of each.
FULL = {"data": {"sample_pool_size": 1_000_000}, "select": {"top_n": 10_000, "num_candidates": 128}}


def resolve_path(path: str, config_file: str) -> str:
    """Relative paths count from the configuration file; addresses stay as they are."""
    return path if "://" in path or os.path.isabs(path) else os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(config_file)), path))


def validate(c: PipelineConfig) -> PipelineConfig:
    problems = [
        ("data.split must be clean or noisy", c.data.split not in ("clean", "noisy")),
        ("data.sample_pool_size must be positive", c.data.sample_pool_size <= 0),
        ("data.sentence_ratio must be within 0 and 1", not 0 <= c.data.sentence_ratio <= 1),
        ("data.target_langs names no language", not ordered_distinct(c.data.target_langs)),
        ("segment.min_chars must not exceed max_chars", c.segment.min_chars > c.segment.max_chars),
        ("segment.blob_max_tokens must be positive", c.segment.blob_max_tokens <= 0),
        ("sample.boundaries must increase", any(a >= b for a, b in zip(c.sample.boundaries, c.sample.boundaries[1:]))),
        ("select counts must be positive", min(c.select.top_n, c.select.num_candidates) <= 0),
        ("filters.fail_policy must be conservative or permissive", c.filters.fail_policy not in ("conservative", "permissive")),
        ("filters length ratios are reversed", c.filters.length_ratio_min > c.filters.length_ratio_max),
    ]
    if found := [text for text, bad in problems if bad]:
        raise ValueError("; ".join(found))
    return c


def load(path: str) -> PipelineConfig:
    """From JSON, or YAML where a parser is installed."""
    import json

    with open(path, encoding="utf-8") as f:
        raw = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        values = yaml.safe_load(raw) or {}
    else:
        values = json.loads(raw)
    return validate(resolve_paths(from_dict(PipelineConfig, values), path))


def resolve_paths(c: Any, config_file: str, names: tuple[str, ...] = ("output", "train_file", "eval_file", "output_dir", "cache_dir")) -> Any:
    """``c`` with its path fields, in sections as well, counted from the configuration file."""
    out = {}
    for f in dataclasses.fields(c):
        value = getattr(c, f.name)
        if dataclasses.is_dataclass(value):
            out[f.name] = resolve_paths(value, config_file, names)
        elif f.name in names and isinstance(value, str) and value:
            out[f.name] = resolve_path(value, config_file)
    return dataclasses.replace(c, **out)


def dump(c: Any) -> str:
    """The resolved configuration as JSON text."""
    import json

    return json.dumps(dataclasses.asdict(c), ensure_ascii=False, indent=2, sort_keys=True)


@dataclass(frozen=True)
class TrainingData:
    train_file: str = ""
    eval_file: str | None = None
    source_field: str = "source_text"
    target_field: str = "target_text"
    source_lang_code: str | None = None
    source_lang_code_field: str | None = None
    target_lang_code: str | None = None
    target_lang_code_field: str | None = None
    prompt_template: str = TRANSLATE_USER
    max_train_samples: int | None = None
    max_eval_samples: int | None = None
    workers: int = 0
    log_text_samples: int = 0
    log_text_max_chars: int = 0


@dataclass(frozen=True)
class TrainingRun:
    output_dir: str = "out"
    learning_rate: float = 1e-4
    global_batch_size: int = 16
    per_device_batch_size: int = 1
    expected_world_size: int | None = None
    max_seq_length: int = 1024


@dataclass(frozen=True)
class TrainingSetup:
    data: TrainingData = TrainingData()
    train: TrainingRun = TrainingRun()


# Fixed value: the only learning rate that training accepts.
LEARNING_RATE = 1e-4


def _complain(problems: list[tuple[str, bool]]) -> None:
    if found := [text for text, bad in problems if bad]:
        raise ValueError("; ".join(found))


def validate_training(c: TrainingSetup, exists=os.path.exists) -> TrainingSetup:
    """``exists`` tells whether a file is there."""
    d, t = c.data, c.train
    blank = lambda x: not (x or "").strip()
    _complain([
        (f"data.train_file not found: {d.train_file}", blank(d.train_file) or not exists(d.train_file)),
        (f"data.eval_file not found: {d.eval_file}", not blank(d.eval_file) and not exists(d.eval_file or "")),
        (f"train.learning_rate must be {LEARNING_RATE}", t.learning_rate != LEARNING_RATE),
        ("train.global_batch_size, per_device_batch_size and max_seq_length must be positive", min(t.global_batch_size, t.per_device_batch_size, t.max_seq_length) <= 0),
        ("train.expected_world_size must be positive", t.expected_world_size is not None and t.expected_world_size <= 0),
        ("data.workers, log_text_samples and log_text_max_chars must not be negative", min(d.workers, d.log_text_samples, d.log_text_max_chars) < 0),
        ("data.max_train_samples and max_eval_samples must be positive", any(x is not None and x <= 0 for x in (d.max_train_samples, d.max_eval_samples))),
        ("data names no source language code", blank(d.source_lang_code_field) and blank(d.source_lang_code)),
        ("data names no target language code", blank(d.target_lang_code_field) and blank(d.target_lang_code)),
        ("data.prompt_template is empty", blank(d.prompt_template)),
    ])
    check_template(d.prompt_template)
    accumulation_steps(t.global_batch_size, t.per_device_batch_size, t.expected_world_size or 1)
    return c


@dataclass(frozen=True)
class RewardModel:
    enabled: bool = True
    device: str | None = None


@dataclass(frozen=True)
class RewardSection:
    first: RewardModel = RewardModel()
    second: RewardModel = RewardModel()
    overlap_policy: str = "any_overlap"
    span_combine_policy: str = "sum"


@dataclass(frozen=True)
class PolicyData:
    dataset: str | None = None
    train_split: str = "train"
    train_file: str | None = None
    eval_file: str | None = None


@dataclass(frozen=True)
class PolicySection:
    algorithm: str = "grpo"
    batch_size: int = 8
    grad_accum: int = 1
    updates: int = 1
    samples_per_prompt: int = 4
    policy_gpus: list[int] = field(default_factory=list)
    reference_gpus: list[int] = field(default_factory=list)


@dataclass(frozen=True)
class PolicySetup:
    data: PolicyData = PolicyData()
    policy: PolicySection = PolicySection()
    reward: RewardSection = RewardSection()


def gpu_of(device: str | None) -> int | None:
    """Number of a device named ``cuda:n``; ``cuda`` is 0, others are none."""
    name = (device or "").strip().lower()
    if name == "cuda":
        return 0
    head, _, number = name.partition(":")
    return int(number) if head == "cuda" and number.isdigit() else None


def validate_policy(c: PolicySetup, exists=os.path.exists) -> PolicySetup:
    d, p, r = c.data, c.policy, c.reward
    hosted = bool((d.dataset or "").strip())
    taken = set(p.policy_gpus) | set(p.reference_gpus)
    first, second = (gpu_of(m.device) if m.enabled else None for m in (r.first, r.second))
    _complain([
        ("data.train_split is empty", hosted and not d.train_split.strip()),
        (f"data.train_file not found: {d.train_file}", not hosted and (not d.train_file or not exists(d.train_file))),
        (f"data.eval_file not found: {d.eval_file}", not hosted and bool(d.eval_file) and not exists(d.eval_file or "")),
        ("policy.samples_per_prompt, batch_size, grad_accum and updates must be positive", min(p.samples_per_prompt, p.batch_size, p.grad_accum, p.updates) <= 0),
        ("policy.algorithm must be grpo or reinforce", p.algorithm not in ("grpo", "reinforce")),
        ("reward.overlap_policy must be any_overlap or majority_overlap", r.overlap_policy not in ("any_overlap", "majority_overlap")),
        ("reward.span_combine_policy must be sum, min or max", r.span_combine_policy not in ("sum", "min", "max")),
        ("no reward model is enabled", not (r.first.enabled or r.second.enabled)),
        ("GPUs are named twice or negative", any(len(set(g)) != len(g) or any(x < 0 for x in g) for g in (p.policy_gpus, p.reference_gpus))),
        (f"policy and reference share GPUs {sorted(set(p.policy_gpus) & set(p.reference_gpus))}", bool(set(p.policy_gpus) & set(p.reference_gpus))),
        ("a reward model sits on a GPU of policy or reference", first in taken or second in taken),
        ("both reward models sit on one GPU", first is not None and first == second),
    ])
    return c


def accumulation_steps(global_batch: int, per_device: int, devices: int) -> int:
    """Gradient-accumulation steps; the global batch must be divisible."""
    unit = per_device * devices
    if unit <= 0 or global_batch % unit:
        raise ValueError(f"global batch {global_batch} is no multiple of {per_device} x {devices}")
    return global_batch // unit
