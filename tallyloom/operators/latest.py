"""Latest rows per key, and what changed between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(order: Sequence[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in order]


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The newest row of each key. An aggregation with map-side combining, so a hot key is no hot task."""
    best = F.max(F.struct(*order, *[v for v in values if v not in order])).alias("_best")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_best.{v}").alias(v) for v in values])


def last_k(df: DataFrame, key: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The newest ``k`` rows of each key, numbered. Spark keeps only ``k`` rows a group before the shuffle as well."""
    w = Window.partitionBy(*key).orderBy(*_order(order))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def beyond_newest(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The rows of each key but its ``k`` newest by ``order``, which is unique. The edge of each key comes from the ``k`` greatest of every
    group of 1,024, so no task sorts a whole key."""
    deal = Window.partitionBy(key, "_deal").orderBy(F.desc(order))
    some = df.select(key, order, F.pmod(F.xxhash64(order), F.lit(1024)).alias("_deal")).withColumn("_rn", F.row_number().over(deal)).where(F.col("_rn") <= k)
    top = last_k(some, [key], [order], k)
    edges = top.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_edge"))
    return df.join(edges, F.col(key).eqNullSafe(F.col("_key"))).where(F.col(order) < F.col("_edge")).drop("_key", "_edge")


def latest_with_ties(df: DataFrame, key: Sequence[str], day: str) -> DataFrame:
    newest = df.groupBy(*key).agg(F.max(day).alias("_newest"))
    return df.join(newest, list(key)).where(F.col(day).eqNullSafe(F.col("_newest"))).drop("_newest")


def change(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, k: int) -> DataFrame:
    """Newest less oldest value among the last ``k`` rows of each key; null if there is only one."""
    top = last_k(df, key, order, k)
    k0 = F.struct(*order)
    return top.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max_by(value, k0).alias("newest"),
        F.min_by(value, k0).alias("oldest"),
        F.when(F.count(F.lit(1)) > 1, F.round(F.max_by(value, k0) - F.min_by(value, k0), 6)).alias("delta"),
    )


def trend(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, k: int) -> DataFrame:
    """The last ``k`` values of each key, newest first, with the change over them."""
    top = last_k(df, key, order, k)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("rn", value))), lambda s: s[value])
    both = top.groupBy(*key).agg(rows.alias("vals"))
    return both.select(*key, F.array_join(F.transform("vals", lambda v: F.format_string("%.2f", v)), ",").alias("series"), F.round(F.element_at("vals", 1) - F.element_at("vals", -1), 6).alias("delta"))


def rows_of_latest_day(df: DataFrame, day: str) -> DataFrame:
    """All rows of the newest day that has any; one aggregated row meets the table again."""
    top = df.agg(F.max(day).alias("_top")).where("_top IS NOT NULL")
    return df.join(F.broadcast(top), F.col(day) == F.col("_top")).drop("_top")


def stale(df: DataFrame, key: str, day: str, as_of: str, older_than: int, top: int) -> DataFrame:
    """Keys not seen for more than ``older_than`` days, the longest first."""
    seen = df.groupBy(key).agg(F.max(day).alias("last_day"))
    days = F.date_diff(F.lit(as_of).cast("date"), F.try_to_date("last_day", "yyyy-MM-dd"))
    return seen.withColumn("days", days).where(F.col("days") > older_than).orderBy(F.col("days").desc(), key).limit(top)
