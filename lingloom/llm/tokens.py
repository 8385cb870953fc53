"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class TokenizerConfig:
    """path: file of byte-pair ranks, the same on every executor. pattern: how a text is cut before merging
    (a fixed value that belongs to the vocabulary)."""

    path: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    pattern: str = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_LOADED: dict[TokenizerConfig, object] = {}


def tokenizer(config: TokenizerConfig = TokenizerConfig()):
    """The tokenizer, read once in each Python worker."""
    if config not in _LOADED:
        import tiktoken

        with open(config.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[config] = tiktoken.Encoding("public", pat_str=config.pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[config]


def with_tokens(df: DataFrame, text: str, out: str = "n_tokens", config: TokenizerConfig = TokenizerConfig()) -> DataFrame:
    """Replace the text column by its number of tokens; a null or empty text has none."""
    fields = [T.StructField(out, T.LongType()) if f.name == text else f for f in df.schema.fields]

    def run(batches):
        encode = tokenizer(config).encode_ordinary
        for b in batches:
            k = b.schema.get_field_index(text)
            sizes = [len(encode(t)) if t else 0 for t in b.column(k).to_pylist()]
            yield b.set_column(k, out, pa.array(sizes, type=pa.int64()))

    return df.mapInArrow(run, T.StructType(fields))
