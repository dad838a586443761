"""Vectors: cosine as a native expression, and the built-in hashed n-gram encoder."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Width of the built-in encoder.
DIMENSION = 384
# What a word is, and the weights of n-grams with Han characters by size.
_WORD = re.compile(r"[A-Za-z0-9_./:-]{2,}|[\u3400-\u9fff]+")
_HAN = re.compile(r"[\u3400-\u9fff]")
_WEIGHTS = {2: 1.2, 3: 1.0, 4: 0.7}
#: Hashed features that a worker keeps.
_KEPT = 200_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, held within [-1, 1]; 0 for empty vectors or unequal widths."""
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))).otherwise(0.0)


def unit(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def features(text: str) -> dict[str, float]:
    """Weights of a text's features: words, the character trigrams of words without Han characters, and, of the
    text without white space, the n-grams that hold a Han character."""
    parts = text.casefold().split()
    words = Counter(_WORD.findall(" ".join(parts)))
    out: dict[str, float] = {f"w:{w}": float(n) for w, n in words.items()}
    grams = Counter()
    for w, n in words.items():
        if not _HAN.match(w):
            grams.update({g: n * k for g, k in Counter(w[i : i + 3] for i in range(len(w) - 2)).items()})
    out |= {f"c:{g}": 0.75 * n for g, n in grams.items()}
    dense = "".join(parts)
    if _HAN.search(dense):
        near = np.zeros(len(dense) + 1, np.int64)
        np.cumsum([bool(_HAN.match(c)) for c in dense], out=near[1:])
        for size, weight in _WEIGHTS.items():
            at = np.flatnonzero(near[size:] > near[:-size]).tolist() if len(dense) >= size else ()
            out |= {f"g{size}:{g}": weight * n for g, n in Counter(dense[i : i + size] for i in at).items()}
    return out


_CELLS: dict[str, tuple[int, float, int, float]] = {}


def _cell(name: str) -> tuple[int, float, int, float]:
    """Two places and the share that each takes of a feature's weight."""
    found = _CELLS.get(name)
    if found is None:
        digest = hashlib.blake2b(name.encode("utf-8"), digest_size=16).digest()
        low, high = np.frombuffer(digest, "<u8").tolist()
        sign = 1.0 if digest[0] & 1 else -1.0
        found = low % DIMENSION, sign, high % DIMENSION, -0.35 * sign if digest[1] & 1 else 0.35 * sign
        if len(_CELLS) >= _KEPT:
            _CELLS.clear()
        _CELLS[name] = found
    return found


def encode(texts: list[str | None]) -> np.ndarray:
    """Signed hashing of the features of each text into DIMENSION places, L2-normalised; zeros for a text without features."""
    out = np.zeros((len(texts), DIMENSION))
    for row, text in zip(out, texts, strict=True):
        if own := features(text or ""):
            first, a, second, b = zip(*map(_cell, own), strict=True)
            weights = np.fromiter(own.values(), float, len(own))
            np.add.at(row, np.array(first), weights * a)
            np.add.at(row, np.array(second), weights * b)
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norms, out=out, where=norms > 0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def builtin_vector(text: pd.Series) -> pd.Series:
    return pd.Series(list(encode(text.tolist())), dtype=object)


@F.pandas_udf(T.BinaryType())
def packed(vector: pd.Series) -> pd.Series:
    """Vectors as little-endian 32-bit floats; null for null."""
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def unpacked(width: int | None = None):
    """A function of packed vectors: arrays again; empty where the bytes are not whole floats, or not `width` of them."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def unpack(data: pd.Series) -> pd.Series:
        good = lambda b: b is not None and len(b) % 4 == 0 and (width is None or len(b) == 4 * width)
        return data.map(lambda b: np.frombuffer(b, "<f4").tolist() if good(b) else [])

    return unpack
