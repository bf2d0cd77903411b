"""Rolling totals over trailing periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.days import event_day
from tallyloom.runtime import cut, once

MONEY = "decimal(30,4)"


def daily_totals(df: DataFrame, entity: str, amount: str, day: str) -> DataFrame:
    return df.groupBy(entity, day).agg(F.sum(F.col(amount).cast(MONEY)).alias("day_total"))


def trailing_totals(daily: DataFrame, entity: str = "entity", day: str = "day", periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals and daily averages over the last ``n`` days for each entity and each calendar day.

    ``daily`` has ``entity``, ``day`` (DATE) and ``day_total``, one row per entity and day. The calendar
    runs from the first to the last day in the table, for every entity. Each entity-date looks for the
    daily totals in ``[date - n + 1, date]``; buckets as wide as the longest period keep the candidates
    of a date to two buckets, so the range join is an equi-join on (entity, bucket) with at most
    ``width`` daily rows a key. The average divides by the length of the period, so idle days count as 0.

    A null entity is an entity of its own; daily rows with a null day are left out; an empty input gives
    an empty result; a null total counts as 0.
    """
    width = max(periods)
    # Only the totals meet again further down, so both sides of the range join come from one small table.
    d = daily.where(F.col(day).isNotNull()).select(
        F.col(entity).alias("_e"), F.col(day).alias("_d"), F.coalesce(F.col("day_total"), F.lit(0).cast(MONEY)).alias("_t")
    )
    bucket = lambda c: F.floor(F.unix_date(c) / width)
    d = cut(d)
    lo, hi = d.agg(F.min("_d"), F.max("_d")).first()
    calendar = F.sequence(F.lit(lo).cast("date"), F.lit(hi).cast("date")) if lo else F.array().cast("array<date>")
    dates = d.select("_e").distinct().select("_e", F.explode(calendar).alias("_on"))
    probes = dates.select(
        "_e", "_on", F.explode(F.array_distinct(F.array(bucket(F.date_sub("_on", width - 1)), bucket(F.col("_on"))))).alias("_b")
    )
    facts = d.select(F.col("_e").alias("_fe"), F.col("_d").alias("_fd"), F.col("_t"), bucket(F.col("_d")).alias("_fb"))
    near = probes.join(
        facts,
        F.col("_e").eqNullSafe(F.col("_fe"))
        & (F.col("_b") == F.col("_fb"))
        & (F.col("_fd") <= F.col("_on"))
        & (F.col("_fd") > F.date_sub("_on", width)),
        "left",
    )
    sums = [F.coalesce(F.sum(F.when(F.col("_fd") > F.date_sub("_on", n), F.col("_t"))), F.lit(0)).alias(f"_s{n}") for n in periods]
    out = near.groupBy("_e", "_on").agg(*sums)
    cols = [F.col("_e").alias(entity), F.col("_on").alias(day)]
    for n in periods:
        cols += [F.col(f"_s{n}").cast("double").alias(f"total_{n}"), (F.col(f"_s{n}").cast("double") / n).alias(f"avg_{n}")]
    return out.select(*cols)


def expense_trailing(expenses: DataFrame, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Trailing totals of expenses per group; group names differ only in case and outer spaces."""
    rows = once(
        expenses.select(
            "id", F.lower(F.trim("group_name")).alias("group_name"), event_day().alias("day"), F.col("amount").alias("amount")
        )
    )
    return trailing_totals(daily_totals(rows, "group_name", "amount", "day"), "group_name", "day", periods)
