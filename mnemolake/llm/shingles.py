"""Hashes of words and word shingles, computed on whole arrays of bytes."""

from __future__ import annotations

import numpy as np

from mnemolake.llm.common import LOWER

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A text is hashed in pieces of about so many bytes, cut between words.
PIECE = 1 << 22


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        m = max(4096, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(text: bytes | None, table: bytes = LOWER) -> np.ndarray:
    """A hash for each word (run of bytes that `table` does not turn into ASCII white space) of a UTF-8 text."""
    if not text:
        return np.zeros(0, np.uint64)
    data = text.translate(table)
    if len(data) <= 2 * PIECE:
        return _hashed(data)[0]
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not _GAP[data[end]]:
            end += 1
        out.append(_hashed(data[at:end])[0])
        at = end
    return np.concatenate(out)


def placed_words(text: bytes, table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and byte behind the last of each word."""
    data = text.translate(table)
    if len(data) <= 2 * PIECE:
        return _hashed(data)
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not _GAP[data[end]]:
            end += 1
        hashes, starts, ends = _hashed(data[at:end])
        found.append((hashes, starts + at, ends + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _hashed(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    up, down = _powers(len(data) + 1)
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_GAP[data], out=inside[1:-1].view(bool))
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts, ends


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, in order; none if there are fewer."""
    m = len(words) - n + 1
    if m <= 0 or n <= 0:
        return words[:0]
    out = words[:m].copy()
    for k in range(1, n):
        out *= _U(_BASE)
        out += words[k : k + m]
    return mixed(out + _U(n))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; of fewer words, but some, the whole sequence is one."""
    return np.unique(run_hashes(words, min(n, len(words))))
