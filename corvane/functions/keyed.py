"""Reproducible randomness: a uniform number in [0, 1) as a hash of a seed and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(salt: str, *keys: Column | str) -> Column:
    """The first 32 bits of an MD5 of the salt and keys, over 2**32; the same whatever the partitioning."""
    text = F.concat_ws("|", F.lit(salt), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
