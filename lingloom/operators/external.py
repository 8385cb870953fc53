"""Calls of external generators: cached, retried, bounded in concurrency, one stage of Arrow batches."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingloom.functions import text as X
from lingloom.operators import tables as KV

# Answers of a server after which the same request is not sent again.
FINAL_STATUS = (400, 401, 403, 404, 422)


class Client(Protocol):
    """An external generator. Raise an exception with ``status_code`` to say what went wrong."""

    def complete(self, request: str) -> str: ...


@dataclass(frozen=True)
class CallConfig:
    """concurrency: calls at a time in one task. attempts, wait, most_wait, jitter: of retries, in seconds."""

    concurrency: int = 8
    attempts: int = 4
    wait: float = 0.5
    most_wait: float = 20.0
    jitter: float = 0.25


def sampling_parameters(temperature: float, top_p: float, overrides: dict[str, Any] | None = None, body: dict[str, Any] | None = None, call_body: dict[str, Any] | None = None) -> dict[str, Any]:
    """Parameters of one request: overrides replace temperature and top_p, optional ones go to the extra body,
    and the body of the call wins over the configured one."""
    o = overrides or {}
    extra = dict(body or {}) | {k: o[k] for k in ("top_k", "min_p", "repetition_penalty") if o.get(k) is not None} | dict(call_body or {})
    out: dict[str, Any] = {"temperature": temperature if o.get("temperature") is None else float(o["temperature"]), "top_p": top_p if o.get("top_p") is None else float(o["top_p"])}
    if o.get("presence_penalty") is not None:
        out["presence_penalty"] = float(o["presence_penalty"])
    return out | ({"extra_body": extra} if extra else {})


def call_with_retry(client: Client, request: str, config: CallConfig) -> str:
    """The client's text. A blank one is an error; errors are tried again with growing waits unless they are final."""
    for attempt in range(config.attempts):
        try:
            text = client.complete(request)
            if not text or not text.strip():
                raise ValueError("blank completion")
            return text
        except Exception as e:  # noqa: BLE001
            if getattr(e, "status_code", None) in FINAL_STATUS or attempt + 1 == config.attempts:
                raise
            time.sleep(min(config.most_wait, config.wait * 2**attempt) + random.random() * config.jitter)
    raise AssertionError


def complete(requests: DataFrame, request: str, make_client: Callable[[], Client], config: CallConfig = CallConfig()) -> DataFrame:
    """``requests`` with ``completion`` and ``error``; a failed call has a null completion and does not stop the rest."""
    fields = T.StructType([*requests.schema.fields, T.StructField("completion", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches):
        client = make_client()

        def one(r: str | None) -> tuple[str | None, str | None]:
            try:
                return call_with_retry(client, r or "", config), None
            except Exception as e:  # noqa: BLE001
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(config.concurrency) as pool:
            for b in batches:
                done = list(pool.map(one, b.column(b.schema.get_field_index(request)).to_pylist()))
                out = b.append_column("completion", pa.array([d[0] for d in done], type=pa.string()))
                yield out.append_column("error", pa.array([d[1] for d in done], type=pa.string()))

    return requests.mapInArrow(run, fields)


def complete_with_cache(requests: DataFrame, key: str, request: str, cache: DataFrame, make_client: Callable[[], Client], config: CallConfig = CallConfig()) -> DataFrame:
    """Cached answers where they are not blank, calls for the rest, each distinct key once.

    ``cache`` is (key, value). Returns key, completion, error, cached. Write the
    result before using it twice: calls are not repeated only if it is kept.
    """
    known = cache.where(X.strip(F.coalesce("value", F.lit(""))) != "").select(F.col("key").alias(key), F.col("value").alias("completion"))
    asked = requests.select(key, request).dropDuplicates([key])
    hit = KV.hits(asked.select(key), known, [key]).select(key, "completion", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    called = complete(KV.misses(asked, known, [key]), request, make_client, config).select(key, "completion", "error", F.lit(False).alias("cached"))
    return hit.unionByName(called)
