"""Held-out rows and bounded training samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    return F.coalesce(remainder(doc_id) != 2, F.lit(False))


def share(doc_id: str = "doc_id", seed: int = 1) -> Column:
    """A number in [0, 1) that depends on the id only: rows below a rate are a reproducible sample."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id).cast("long")), F.lit(1 << 40)) / float(1 << 40)


def matrix(df: DataFrame, column: str, dim: int) -> np.ndarray:
    """A collected column of float16 vectors (as binary) as a float32 matrix."""
    raw = df.column(column).to_pylist()
    if not raw:
        return np.zeros((0, dim), np.float32)
    return np.frombuffer(b"".join(raw), np.float16).reshape(len(raw), dim).astype(np.float32)
