"""What stands in for a model in tests."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fake_vectors(texts: Column, dims: int = 64) -> Column:
    """A boundary for tests: unit vectors from a seeded hash of each text, in place of an embedding model."""

    @F.pandas_udf("array<float>")
    def made(values: pd.Series) -> pd.Series:
        def one(text: str | None) -> np.ndarray:
            seed = int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:8], "big")
            v = np.random.default_rng(seed).standard_normal(dims)
            return (v / np.linalg.norm(v)).astype(np.float32)

        return values.map(one)

    return made(texts)
