"""Character noise, reproducible per row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quietroom.functions.hashing import digest, digest_number
from quietroom.settings import NOISE_LEVEL, SEED

# Characters whose code points a Python worker holds at once.
CHARACTERS_AT_ONCE = 4_000_000


def _scrambled(draw: np.ndarray) -> np.ndarray:
    """A keyed hash of 64-bit counters, by multiply and xor-shift steps."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        draw = (draw ^ (draw >> np.uint64(33))) * np.uint64(factor)
    return draw ^ (draw >> np.uint64(33))


def _swap_batch(
    texts: pd.Series, keys: pd.Series, level: float, characters: int = CHARACTERS_AT_ONCE
) -> pd.Series:
    """Noise for a batch, some texts at a time, long ones together.

    No more than ``characters`` are worked on at once, or one text; what texts take beside their
    strings is bounded by that, not by the rows of the batch.
    """
    out = np.full(len(texts), None, object)
    held = np.flatnonzero(texts.notna().to_numpy())
    sizes = np.array([len(t) for t in texts.iloc[held]], np.int64)
    falling = np.argsort(-sizes, kind="stable")
    held, ends = held[falling], np.cumsum(sizes[falling])
    low = 0
    while low < len(held):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + characters, "right")))
        rows = held[low:high]
        out[rows] = _swap_texts(texts.iloc[rows], keys.iloc[rows], level)
        low = high
    return pd.Series(out)


def _swap_texts(texts: pd.Series, keys: pd.Series, level: float) -> np.ndarray:
    """All texts as one buffer of code points; swap ``k`` runs over all rows at once.

    Rows are visited from the most swaps down, so those that still have a swap ``k`` are a prefix.
    """
    encoded = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.array([len(e) // 4 for e in encoded], np.int64)
    points = np.frombuffer(bytearray(b"".join(encoded)), np.uint32)
    del encoded
    starts = np.cumsum(sizes) - sizes
    swaps = (sizes * level).astype(np.int64)
    order = np.argsort(-swaps, kind="stable")
    key = keys.to_numpy().astype(np.int64).view(np.uint64)[order]
    at, width, left = starts[order], sizes[order].astype(np.uint64), -swaps[order]
    for k in range(int(swaps.max(initial=0))):
        rows = slice(int(np.searchsorted(left, -k, "left")))
        drawn = _scrambled(key[rows] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        one = at[rows] + ((drawn >> np.uint64(32)) % width[rows]).astype(np.int64)
        two = at[rows] + ((drawn & np.uint64(0xFFFFFFFF)) % width[rows]).astype(np.int64)
        points[one], points[two] = points[two], points[one]
    out = np.empty(len(texts), object)
    out[:] = [
        points[s : s + n].tobytes().decode("utf-32-le", "surrogatepass")
        for s, n in zip(starts, sizes, strict=True)
    ]
    return out


def random_swaps(
    text: Column, key: Column, level: float = NOISE_LEVEL, seed: int = SEED
) -> Column:
    """``int(len * level)`` swaps of two positions each, one after the other.

    Positions come from a hash of (seed, key, number of the swap), so a row's noise does not
    depend on its batch.
    """

    @F.pandas_udf("string")
    def swapped(texts: pd.Series, keys: pd.Series) -> pd.Series:
        return _swap_batch(texts, keys, level)

    return swapped(text, F.xxhash64(F.lit(seed), key.cast("string")))


def adjacent_swap(text: Column, key: Column, seed: int = SEED) -> Column:
    """One swap of two neighbours at a position drawn from the row key."""
    n = F.length(text)
    at = (digest_number(digest(key, seed=seed)) % F.greatest(n - 1, F.lit(1))).cast("int")
    swapped = F.concat(
        F.substr(text, F.lit(1), at),
        F.substr(text, at + 2, F.lit(1)),
        F.substr(text, at + 1, F.lit(1)),
        F.substr(text, at + 3),
    )
    return F.when(n < 2, text).otherwise(swapped)


def fixed_swap(text: Column) -> Column:
    """Swap of the third and fourth character; shorter texts stay as they are."""
    swapped = F.concat(
        F.substring(text, 1, 2),
        F.substring(text, 4, 1),
        F.substring(text, 3, 1),
        F.substr(text, F.lit(5)),
    )
    return F.when(F.length(text) >= 4, swapped).otherwise(text)
