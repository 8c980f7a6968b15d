"""Hashed character n-gram vectors with integer weights, and the similarities over them.

Integer weights make dot products and squared norms exact, so any engine or partitioning gives the
same similarity. The encoder is one Arrow UDF: NumPy counts the grams of a text, and only grams not
seen before by the worker are hashed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 128


def _gram_text(code: int) -> str:
    return chr(code) if code < (1 << 21) else chr((code >> 21) - 1) + chr(code & 0x1FFFFF)


def _slot(code: int, dim: int, hash_name: str) -> tuple[int, int]:
    data = _gram_text(code).encode("utf-8", "surrogatepass")
    if hash_name == "md5":
        v = int(hashlib.md5(data).hexdigest()[:15], 16)
        return v % dim, 1 - 2 * ((v // dim) % 2)
    v = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big")
    return v % dim, 1 - 2 * (v >> 63)


def hash_vector(text: str, dim: int, hash_name: str, seen: dict) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    codes, counts = np.unique(np.concatenate([cp, ((cp[:-1] + 1) << 21) | cp[1:]]), return_counts=True)
    slots = np.empty((len(codes), 2), dtype=np.int64)
    for i, c in enumerate(codes.tolist()):
        s = seen.get(c)
        if s is None:
            s = seen[c] = _slot(c, dim, hash_name)
        slots[i] = s
    return np.bincount(slots[:, 0], weights=counts * slots[:, 1], minlength=dim).astype(np.int64)


def encoder(dim: int = DIM, hash_name: str = "md5"):
    """Text column -> array<int> column. ``hash_name='blake2b'`` is the alternative hash."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        seen: dict = {}
        return pd.Series([hash_vector(t or "", dim, hash_name, seen).astype(np.int32) for t in texts])

    return encode


def norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint") * x.cast("bigint"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("bigint") * y.cast("bigint")),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + x,
    )


def cosine_from(d: Column, n1: Column, n2: Column) -> Column:
    return F.when((n1 == 0) | (n2 == 0), F.lit(0.0)).otherwise(
        d.cast("double") / F.sqrt(n1.cast("double") * n2.cast("double"))
    )


def similarity_from(d: Column, n1: Column, n2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine_from(d, n1, n2)))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays; different lengths or a zero vector give 0."""

    def acc(x, y):
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t
        )

    na, nb = acc(a, a), acc(b, b)
    return F.when((F.size(a) != F.size(b)) | (na == 0) | (nb == 0), F.lit(0.0)).otherwise(acc(a, b) / F.sqrt(na * nb))
