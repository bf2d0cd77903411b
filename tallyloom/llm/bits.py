"""Bloom filters over hashed keys that Python batches test in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.orphans import WORD, KeyFilter

_FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def spots(keys: np.ndarray, bits: int, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys.astype(np.uint64) * np.uint64(_FACTORS[k])) >> np.uint64(20)) & np.uint64(bits - 1)


def held(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may have been built of; false is proof that it was not."""
    out = np.zeros(len(keys), dtype=bool)
    at = np.arange(len(keys))
    for k in range(len(_FACTORS)):  # each spot only of the keys that the last one left
        s = spots(keys[at], len(words) * WORD, k)
        at = at[((words[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1)).astype(bool)]
    out[at] = True
    return out


def build(keys: DataFrame, max_bits: int = 1 << 27) -> np.ndarray:
    """A filter of the distinct longs in the column ``key``: ten bits a key, at most ``max_bits`` (16 MB) whatever their
    number, filled by one distributed aggregation per word."""
    bits, _ = KeyFilter.plan(keys.count(), max_bits)

    @F.pandas_udf("array<bigint>")
    def own(key: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack([spots(key.to_numpy(dtype=np.int64), bits, k) for k in range(len(_FACTORS))], axis=1).astype(np.int64))) if len(key) else pd.Series([], dtype=object)

    got = (
        keys.where(F.col("key").isNotNull())
        .select(F.explode(own("key")).alias("_s"))
        .groupBy(F.floor(F.col("_s") / WORD).cast("int").alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_s", F.lit(WORD)).cast("int"))).alias("v"))
        .toPandas()
    )
    words = np.zeros(bits // WORD, dtype=np.int64)
    words[got["w"].to_numpy(dtype=np.int64)] = got["v"].to_numpy(dtype=np.int64)
    return words.view(np.uint64)
