"""Vector expressions. Similarity folds in double precision, inside the JVM."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where lengths differ or a vector is all zero."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (length == 0), F.lit(0.0)).otherwise(dot(a, b) / length)


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, _double(a)).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def local_embedding(text: Column, dim: int = 384) -> Column:
    """Placeholder without a model: code points over 255 of the first ``dim`` characters, zero-padded, unit length."""
    raw = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.coalesce(F.ascii(F.substring(text, i, F.lit(1))), F.lit(0)) / F.lit(255.0))
    return l2_normalize(raw)


def seeded_vector(text: str, dim: int = 1536) -> np.ndarray:
    """Mock vector: a linear congruential series in double arithmetic, seeded by the text's hash, unit length."""
    x = float(int(hashlib.sha256(text.encode()).hexdigest()[:8], 16))
    out = np.empty(dim)
    for i in range(dim):
        x = float(np.fmod(x * 1103515245.0 + 12345.0, 2147483648.0))
        out[i] = x / 2147483648.0 * 2 - 1
    n = np.sqrt((out * out).sum())
    return out / n if n else out


def mock_embedding(dim: int = 1536):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else seeded_vector(t, dim).tolist())

    return run


def embedding_cost(tokens: Column, per_million: float = 0.02) -> Column:
    return tokens / 1e6 * per_million
