"""Vector functions as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.when(length == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / length))


def checked(v: Column, dimensions: int) -> Column:
    """``v``, or an error if its size isn't ``dimensions``."""
    return F.when(F.size(v) == dimensions, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimensions} dimensions, got "), F.size(v).cast("string"))).cast("array<float>"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _hashed(firsts: pd.Series, dimensions: pd.Series) -> pd.Series:
    out = []
    for own, n in zip(firsts, dimensions, strict=True):
        v = np.bincount(np.frombuffer(bytes.fromhex(own or ""), np.uint8) % int(n), minlength=int(n)).astype(float)
        length = np.sqrt(v @ v)
        out.append(v / length if length else v)
    return pd.Series(out)


def hashing_embedding(text: Column, dimensions: int = 64) -> Column:
    """Deterministic offline embedding: words counted in buckets of their SHA-256's first byte, at unit length."""
    # Python gets two characters a word, not the words, so a batch of long texts is small there.
    firsts = F.array_join(F.transform(tokens(text), lambda w: F.substring(F.sha2(w, 256), 1, 2)), "")
    return _hashed(firsts, F.lit(dimensions))
