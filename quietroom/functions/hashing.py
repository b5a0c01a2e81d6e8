"""Row-keyed pseudo-randomness.

Every random choice is a function of (seed, key), so that it does not depend on
partitioning, retries or row order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietroom.settings import SEED


def digest(*parts: Column | str, seed: int = SEED) -> Column:
    """md5 over ``seed|part|part...`` as 32 hex digits."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))


def digest_number(hexes: Column, digits: int = 8) -> Column:
    """The first hex digits of a digest as a whole number."""
    return F.conv(F.substring(hexes, 1, digits), 16, 10).cast("bigint")


def hash_score(*parts: Column | str, steps: int = 50, seed: int = SEED) -> Column:
    """A stand-in probability in ``[0, 1)`` with many ties."""
    return (digest_number(digest(*parts, seed=seed)) % steps) / F.lit(float(steps))
