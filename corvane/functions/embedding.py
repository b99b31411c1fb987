"""Embedders over an injected call: batches, retries, and a check of what comes back."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH, TRIES = 16, 3


class EmbeddingBackendError(RuntimeError):
    """The embedding backend can't be reached or gave something else than asked for."""


def call_with_retries(call: Callable[[list[str]], list[list[float]]], texts: list[str], dimensions: int, tries: int = TRIES, wait: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Vectors of texts; after the k-th failure 2**(k - 1) seconds pass. A wrong number of vectors or of their
    dimensions is an error at once, as asking again would not mend it."""
    for k in range(tries):
        try:
            found = call(texts)
            break
        except Exception as e:  # noqa: BLE001  any failure of the backend counts
            if k + 1 == tries:
                raise EmbeddingBackendError(f"no vectors after {tries} tries: {e}; is the backend running and the model there?") from e
            wait(2.0**k)
    if len(found) != len(texts):
        raise EmbeddingBackendError(f"{len(texts)} texts asked for, {len(found)} vectors given")
    if wrong := {len(v) for v in found} - {dimensions}:
        raise EmbeddingBackendError(f"vectors of {sorted(wrong)} dimensions given, {dimensions} expected")
    return found


def embedder(call: Callable[[list[str]], list[list[float]]], dimensions: int, size: int = BATCH) -> Callable[[Column], Column]:
    """A function of a text column that gives unit vectors, by an Arrow function that asks in batches of ``size``."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(texts):
        import numpy as np
        import pandas as pd

        own = [t or "" for t in texts]
        found = np.array([v for k in range(0, len(own), size) for v in call_with_retries(call, own[k : k + size], dimensions)], np.float32).reshape(len(own), dimensions)
        length = np.linalg.norm(found, axis=1, keepdims=True)
        return pd.Series(list(np.divide(found, length, out=np.zeros_like(found), where=length > 0)))

    return vectors


def http_call(url: str, model: str, timeout: float = 60.0) -> Callable[[list[str]], list[list[float]]]:
    """A call of an embedding server: POST {model, input}, answered by {embeddings}."""

    def call(texts: list[str]) -> list[list[float]]:
        import json
        import urllib.request

        asked = urllib.request.Request(url, json.dumps({"model": model, "input": texts}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(asked, timeout=timeout) as reply:
            return json.load(reply)["embeddings"]

    return call
