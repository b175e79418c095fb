"""Model-backed steps as replaceable functions, with deterministic stand-ins.

A hook takes and returns pandas frames (or lists of texts) and runs inside
``mapInPandas``; where no model is at hand the stand-ins keep pipelines running.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

DIMENSIONS = 64


def hashed_embedding(texts: Sequence[str]) -> list[list[float]]:
    """Bag of words hashed to a unit vector: a stand-in for an embedding model."""
    out = np.zeros((len(texts), DIMENSIONS))
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()):
            h = zlib.crc32(w.encode())
            out[i, h % DIMENSIONS] += 1.0 if h & 0x10000 else -1.0
        n = np.linalg.norm(out[i])
        if n:
            out[i] /= n
    return out.tolist()


def with_skips(texts: Sequence[str], embed: Callable[[Sequence[str]], list[list[float]]]) -> list[list[float] | None]:
    """Embeds a batch; a batch that fails is halved until only the single texts at fault get none."""
    try:
        return list(embed(texts))
    except Exception:
        if len(texts) <= 1:
            return [None] * len(texts)
        half = len(texts) // 2
        return with_skips(texts[:half], embed) + with_skips(texts[half:], embed)


def embedded(df: DataFrame, key: str, text: str, embed: Callable[[Sequence[str]], list[list[float]]] = hashed_embedding, batch: int = 32) -> DataFrame:
    """``key, vector`` for every row with a text; rows that the model refuses get a null vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f[text].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in with_skips(texts[i : i + batch], embed)]
            yield pd.DataFrame({key: f[key], "vector": vectors})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, vector array<double>")


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that an earlier run did not finish: the resume of a batch job."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def gazetteer_spans(df: DataFrame, key: str, text: str, gazetteer: dict[str, list[str]]) -> DataFrame:
    """Dictionary matches ``key, text, type, start, end, score``: a stand-in for an entity model."""
    words = {s: t for t, surfaces in gazetteer.items() for s in surfaces}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = re.compile("|".join(map(re.escape, sorted(words, key=len, reverse=True)))) if words else None
        for f in frames:
            rows = [(k, m.group(), words[m.group()], m.start(), m.end(), 1.0) for k, t in zip(f[key], f[text].fillna("")) for m in (pattern.finditer(t) if pattern else ())]
            yield pd.DataFrame(rows, columns=[key, "text", "type", "start", "end", "score"])

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, text string, type string, start int, end int, score double")


def with_retries(call: Callable[[], object], attempts: int = 3, wait: Callable[[Exception], float] = lambda e: 0.0) -> object:
    """Calls again after failures, waiting as the failure says; the last failure is raised."""
    for i in range(attempts):
        try:
            return call()
        except Exception as e:
            if i + 1 == attempts:
                raise
            time.sleep(wait(e))
    return None


def batched(df: DataFrame, key: str, value: str, work: Callable[[list[str]], list[str]], size: int = 5) -> DataFrame:
    """``key, result, error``: batches of a model call, a failing batch reports its error instead of stopping the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys, values = f[key].tolist(), f[value].fillna("").tolist()
            out = []
            for i in range(0, len(keys), size):
                try:
                    out += [(k, r, None) for k, r in zip(keys[i : i + size], work(values[i : i + size]))]
                except Exception as e:
                    out += [(k, None, str(e)) for k in keys[i : i + size]]
            yield pd.DataFrame(out, columns=[key, "result", "error"])

    return df.select(key, value).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, result string, error string")


def route(query: str) -> str:
    """Global for questions about the whole, local for the rest: a stand-in for a routing model."""
    return "global" if re.search(r"(?i)\b(overall|themes?|summar\w+|across|main|trends?)\b|ملخص|بشكل عام|أهم", query) else "local"
