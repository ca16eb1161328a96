"""Vectors as arrays: cosine in the JVM, a hashing embedder, and a registry for others."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

TOKEN = re.compile(r"[a-z0-9][a-z0-9_+-]{1,}")
_BACKENDS: dict[str, Callable] = {}


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, as doubles."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either is empty or null, lengths differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.when(usable, dot(a, b) / norms).otherwise(0.0)


def hash_vector(text: str | None, dim: int = 512) -> list[float]:
    """Signed feature hashing of a text's words, log-scaled and of length 1 (zeros for no words)."""
    out = [0.0] * dim
    for word, n in Counter(TOKEN.findall((text or "").lower())).items():
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "little")
        at = h % dim
        out[at] += (1.0 if at % 2 == 0 else -1.0) * (1.0 + math.log(n))
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


def hashing_embedder(dim: int = 512):
    """Arrow UDF string -> array<float> of the hashing embedder."""

    @pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_vector(t, dim))

    return encode


def register_embedder(name: str, factory: Callable) -> None:
    """Make an embedder known: ``factory(**options)`` returns a function of a text Column."""
    _BACKENDS[name] = factory


def embedder(name: str, **options):
    """An embedder by name; unknown names are an error that lists the known ones."""
    if name not in _BACKENDS:
        raise KeyError(f"no embedder {name!r}; known: {sorted(_BACKENDS)}")
    return _BACKENDS[name](**options)


register_embedder("hashing", hashing_embedder)
