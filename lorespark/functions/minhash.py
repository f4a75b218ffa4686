"""MinHash of rune 3-grams, 64 functions, and the guarded merge verdict. Hashing is 64-bit, so it runs vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import text as T

#: Window, functions, prime, seed, FNV-1a constants.
WINDOW, K, PRIME = 3, 64, 2147483647
SEED, FNV_BASE, FNV_PRIME = 0x9E3779B97F4A7C15, 0xCBF29CE484222325, 0x100000001B3
MIN_SHINGLES, LENGTH_RATIO = 8, 3.0


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    state, mask = SEED, (1 << 64) - 1
    draws = []
    while len(draws) < 2 * K:
        state ^= state << 13 & mask
        state ^= state >> 7
        state ^= state << 17 & mask
        draws.append(state)
    return np.array([d % (PRIME - 1) + 1 for d in draws[::2]], np.uint64), np.array([d % PRIME for d in draws[1::2]], np.uint64)


A, B = _parameters()


def _hashes(rune: np.ndarray) -> np.ndarray:
    """FNV-1a over the four little-endian bytes of each rune, of every row of a rune matrix."""
    h = np.full(len(rune), FNV_BASE, np.uint64)
    for j in range(rune.shape[1]):
        for shift in (0, 8, 16, 24):
            h = (h ^ ((rune[:, j] >> np.uint32(shift)) & np.uint32(255)).astype(np.uint64)) * np.uint64(FNV_PRIME)
    return h


def shingles(s: str) -> np.ndarray:
    rune = np.frombuffer(s.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(rune):
        return np.zeros(0, np.uint64)
    return _hashes(np.lib.stride_tricks.sliding_window_view(rune, min(WINDOW, len(rune))))


def _values(x: np.ndarray) -> np.ndarray:
    """The K functions of each hash, hashes x functions."""
    return ((x[:, None] * A[None, :] + B[None, :]) % np.uint64(PRIME)).astype(np.uint32)


def signature(s: str | None) -> np.ndarray | None:
    x = np.unique(shingles(s or ""))
    if not len(x):
        return None
    return np.min([_values(x[i : i + 4096]).min(axis=0) for i in range(0, len(x), 4096)], axis=0).astype(np.int64)


#: Code points hashed at a time; a longer text is cut, and its parts' least values are joined.
SLICE_RUNES = 1 << 16


def _least(parts: list[tuple[int, str]], out: np.ndarray) -> None:
    """Takes the parts (row, text) of one slice into their rows of ``out``: every different 3-gram is hashed once, and each text takes the least over its own."""
    rune = np.frombuffer("".join(t for _, t in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter((len(t) for _, t in parts), np.int64, len(parts))
    first = np.cumsum(lens) - lens
    # a gram that would reach into the next text is none
    inside = np.ones(len(rune) - WINDOW + 1, bool)
    for k in range(1, WINDOW):
        cut = first[1:] - k
        inside[cut[(cut >= 0) & (cut < len(inside))]] = False
    own = np.repeat(np.arange(len(parts)), lens)[: len(inside)][inside]
    gram, back = np.unique(_hashes(np.lib.stride_tricks.sliding_window_view(rune, WINDOW)[inside]), return_inverse=True)
    value = _values(gram)
    pair = np.unique(own * len(gram) + back)
    own, back = pair // len(gram), pair % len(gram)
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    least = np.minimum.reduceat(value[back], cuts, axis=0)
    for j, k in enumerate(own[cuts].tolist()):
        i = parts[k][0]
        out[i] = np.minimum(out[i], least[j])


@F.arrow_udf(ArrayType(LongType()))
def minhash(s: pa.Array) -> pa.Array:
    """Signatures of a batch. Texts are taken out of it one by one and cut into slices, so a task holds the batch as it came and one slice."""
    out, empty = np.full((len(s), K), np.iinfo(np.uint32).max, np.uint32), np.zeros(len(s), bool)
    parts, size = [], 0
    for i in range(len(s)):
        t = (s[i].as_py() or "").lower()
        empty[i] = not t
        if 0 < len(t) < WINDOW:
            out[i] = signature(t)
        for a in range(0, len(t) - WINDOW + 1, SLICE_RUNES):
            part = t[a : a + SLICE_RUNES + WINDOW - 1]
            if parts and size + len(part) > SLICE_RUNES:
                _least(parts, out)
                parts, size = [], 0
            parts.append((i, part))
            size += len(part)
    if parts:
        _least(parts, out)
    return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel().astype(np.int64)), K, mask=pa.array(empty)).cast(pa.list_(pa.int64()))


def estimate(a: Column, b: Column) -> Column:
    """The share of equal positions."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(K))


def similarity(a: Column, b: Column, sig_a: Column, sig_b: Column) -> Column:
    """The estimate; two blank texts are alike, a blank one is like no other."""
    blank = lambda c: T.strip(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(a) & blank(b), 1.0).when(blank(a) | blank(b), 0.0).otherwise(estimate(sig_a, sig_b))


def n_shingles(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(F.lit(1), F.length(c) - (WINDOW - 1)))


def judge(a: Column, b: Column, sim: Column, least: float) -> Column:
    """Why two texts may not merge, or an empty string: too-short, length-ratio, digits-differ, negation-differs, below-threshold."""
    la, lb = F.length(a), F.length(b)
    return (
        F.when((n_shingles(a) < MIN_SHINGLES) | (n_shingles(b) < MIN_SHINGLES), "too-short")
        .when(F.greatest(la, lb) / F.least(la, lb) > LENGTH_RATIO, "length-ratio")
        .when(T.digits(a) != T.digits(b), "digits-differ")
        .when(T.negation_count(a) != T.negation_count(b), "negation-differs")
        .when(sim < least, "below-threshold")
        .otherwise("")
    )
