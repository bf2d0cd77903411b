"""Building sets of examples: seeded draws, unique rows, held-out rows and splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def uniform(seed: int, *cols: str | Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of an md5 of the seed and the columns: the same on every
    engine and for any layout of the rows."""
    parts = [F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def seeded_places(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A seeded order of all rows as places 1, 2, ...: rows are dealt to 4,096 ranges of the hash, ordered within each, and
    the ranges' sizes added up, so no task sorts them all."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    rows = df.withColumn("_h", h).withColumn("_r", F.substring("_h", 1, 3))
    sizes = rows.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows at most
    starts = sizes.select("_r", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_r").orderBy("_h", key))
    return rows.withColumn("_in", inside).join(F.broadcast(starts), "_r").withColumn("place", F.col("_start") + F.col("_in")).drop("_h", "_r", "_in", "_start")


def weighted_choice(u: Column, weights: Sequence[tuple[str, float]]) -> Column:
    """The value whose stretch of the cumulated weights holds ``u``."""
    whole, upto = sum(w for _, w in weights), 0.0
    out = F.lit(weights[-1][0])
    for value, w in reversed(weights[:-1]):
        upto = sum(x for v, x in weights[: [v for v, _ in weights].index(value) + 1])
        out = F.when(u < upto / whole, F.lit(value)).otherwise(out)
    return out


def split(df: DataFrame, key: str, seed: int, parts: Sequence[tuple[str, float]]) -> DataFrame:
    """Deals rows to parts by a hash of their key, so that a row keeps its part when others come or go."""
    return df.withColumn("part", weighted_choice(uniform(seed, key), parts))


def exact_split(df: DataFrame, key: str, seed: int, parts: Sequence[tuple[str, float]]) -> DataFrame:
    """Parts of exactly proportional size, at least one row each while rows last."""
    n = df.count()
    sizes = allocate([w for _, w in parts], n)
    place, out, upto = F.col("place"), F.lit(parts[-1][0]), 0
    edges = []
    for (name, _), k in zip(parts, sizes):
        upto += k
        edges.append((name, upto))
    for name, edge in reversed(edges[:-1]):
        out = F.when(place <= edge, F.lit(name)).otherwise(out)
    return seeded_places(df, key, seed).withColumn("part", out).drop("place")


def allocate(weights: Sequence[float], total: int, least: int = 1) -> list[int]:
    """Whole numbers in proportion to the weights that add up to ``total``, each at least ``least`` where that is possible;
    what rounding leaves goes to the largest remainders."""
    if not weights or total <= 0:
        return [0] * len(weights)
    floor = least if total >= least * len(weights) else 0
    free, whole = total - floor * len(weights), sum(weights) or 1.0
    exact = [free * w / whole for w in weights]
    out = [math.floor(x) for x in exact]
    for i in sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))[: free - sum(out)]:
        out[i] += 1
    return [floor + x for x in out]


def in_order(col: Column, kind: T.DataType) -> Column:
    """The value with the fields of its structs, however deep, in alphabetical order."""
    if isinstance(kind, T.StructType):
        made = F.struct(*[in_order(col[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(col.isNotNull(), made)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(col, lambda x: in_order(x, kind.elementType))
    return col


def canonical_key(df: DataFrame, col: str) -> Column:
    """Identity of a nested value: a digest of its JSON with keys in alphabetical order and nulls kept; of plain values of their text."""
    kind = df.schema[col].dataType
    plain = not isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
    value = F.col(col).cast("string") if plain else F.to_json(in_order(F.col(col), kind), {"ignoreNullFields": "false"})
    return F.sha2(value, 256)


def unique_sample(df: DataFrame, key: str, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """``n`` rows with different keys in a seeded order; all of them if there are fewer."""
    rows = df.withColumn("_key", canonical_key(df, key))
    one = rows.groupBy("_key").agg(F.min(F.struct(id_col, *[c for c in df.columns if c != id_col])).alias("_r")).select("_key", "_r.*")
    return one.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "_key"))).limit(n).drop("_key")


def held_out(candidates: DataFrame, train: DataFrame, key: str, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """``n`` candidates whose content isn't in ``train``; only where these run out, marked ones that are."""
    known = train.select(canonical_key(train, key).alias("_key")).distinct().withColumn("_known", F.lit(True))
    rows = candidates.withColumn("_key", canonical_key(candidates, key)).join(known, "_key", "left").withColumn("overlaps", F.coalesce("_known", F.lit(False)))
    return rows.orderBy("overlaps", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))).limit(n).drop("_key", "_known")
