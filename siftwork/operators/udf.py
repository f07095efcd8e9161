"""Caller-supplied model scoring over a prompt table (U-1, S-9).

The model is whatever the caller's ``loader`` returns: a callable taking a
list of prompts (plus sampling options) and returning one text per prompt.
It is loaded lazily, once per Python worker, and fed Arrow batches of
prompts.  A failing batch is retried row by row so one bad prompt becomes one
``error`` row instead of a failed task.
"""

from __future__ import annotations

import builtins
import hashlib
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

# Worker code travels with the task (by value): executors need not have this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Sampling options of the reference (fixed values).
GENERATION_OPTIONS = {"temperature": 0.8, "top_p": 0.9, "max_new_tokens": 512, "do_sample": True}
JUDGE_OPTIONS = {"temperature": 0.3, "top_p": 0.8, "max_new_tokens": 300, "do_sample": True}

def _model(loader: Callable[[], Callable], key: tuple[str, str]) -> Callable:
    """The loaded model, once per Python worker process (workers are reused
    across tasks, so the cache lives in the process, not in the task)."""
    cache = builtins.__dict__.setdefault("_siftwork_models", {})
    if key not in cache:
        cache[key] = loader()
    return cache[key]


def batch_generate(prompts: DataFrame, loader: Callable[[], Callable], prompt: str = "prompt",
                   keys: tuple[str, ...] = (), options: dict | None = None, batch_size: int = 8,
                   model_name: str = "model", partitions: int | None = None) -> DataFrame:
    """Adds ``generated_text`` / ``error`` per prompt row; other columns in
    ``keys`` are carried through."""
    opts = dict(options or {})
    # two loaders never share a model, whatever they are called
    model_key = (model_name, hashlib.sha256(cloudpickle.dumps(loader)).hexdigest())
    src = prompts.select(*keys, prompt)
    if partitions:
        src = src.repartition(partitions)
    fields = [f for f in src.schema.fields if f.name in keys]
    schema = StructType(fields + [StructField(prompt, StringType()), StructField("generated_text", StringType()),
                                  StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(loader, model_key)
        for pdf in batches:
            texts = pdf[prompt].fillna("").tolist()
            out: list = []
            err: list = []
            for i in range(0, len(texts), batch_size):
                chunk = texts[i:i + batch_size]
                try:
                    res = list(model(chunk, **opts))
                    out.extend(res)
                    err.extend([None] * len(chunk))
                except Exception:  # noqa: BLE001 - isolate the failing row(s)
                    for t in chunk:
                        try:
                            out.append(list(model([t], **opts))[0])
                            err.append(None)
                        except Exception as e:  # noqa: BLE001
                            out.append(None)
                            err.append(str(e))
            res = pdf[list(keys) + [prompt]].copy()
            res["generated_text"] = out
            res["error"] = err
            yield res

    return src.mapInPandas(run, schema)


def stub_judge_loader() -> Callable:
    """Deterministic stand-in for a judge model (tests and oracle checks):
    scores derived from the prompt length; fails for prompts whose md5 starts
    with '0'."""
    def model(prompts, **_opts):
        out = []
        for p in prompts:
            h = hashlib.md5(p.encode("utf-8")).hexdigest()
            if h[0] == "0":
                raise ValueError("stub failure")
            n = len(p)
            out.append(f"RELEVANCE: {n % 10}\nACCURACY: {n % 7 + 3}\nOVERALL: {n % 11}\nREASON: stub {h[:6]}")
        return out
    return model


def stub_generation_loader() -> Callable:
    """Deterministic stand-in for a generation model (tests and oracle checks):
    echoes the prompt, then one role-marked pair derived from the prompt's md5;
    fails for prompts whose md5 starts with '00'."""
    def model(prompts, **_opts):
        out = []
        for p in prompts:
            h = hashlib.md5(p.encode("utf-8")).hexdigest()
            if h.startswith("00"):
                raise ValueError("stub failure")
            out.append(f"{p}\nUser: How do I {h[:8]}?\nAssistant: Use {h[8:20]} carefully.")
        return out
    return model
