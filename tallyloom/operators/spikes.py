"""Implausible spikes in measurements, judged against each source's own readings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.days import day
from tallyloom.runtime import cut, once


@dataclass(frozen=True)
class SpikeRules:
    """Parameters of :func:`implausible`.

    ``risk``: chance a true reading may exceed its source's tail cutoff; ``tail``: share of the readings that
    make up the tail; ``side``: readings on either side that make the local level; ``prior`` and ``shape_prior``: weight of the
    pooled tail's size and shape, in exceedances; ``month_prior``: weight of the pooled season, in readings of the month; ``gross``: residuals beyond
    so many scatters are no part of a tail to fit; ``shapes``: bounds of the tail's shape; ``stuck_risk``: expected number of true runs as long as a stuck one;
    ``low`` and ``high``: what no living person weighs, in kilograms.
    """

    risk: float = 2e-5
    tail: float = 0.2
    side: int = 5
    prior: float = 20.0
    shape_prior: float = 200.0
    month_prior: float = 200.0
    gross: float = 5.0
    shapes: tuple[float, float] = (-0.05, 0.15)
    stuck_risk: float = 0.02
    stuck_least: int = 7
    low: float = 0.2
    high: float = 650.0
    block: int = 2048
    days: int = 64


def _numbered(rows: DataFrame, p: SpikeRules) -> DataFrame:
    """Adds each reading's place ``_n`` in its source's order without gathering a source in one task.

    Places come from counts per (source, span of days), which are few, and the order inside a span.
    """
    span = rows.withColumn("_span", F.floor(F.unix_date("_day") / p.days))
    sizes = span.groupBy("source", "_span").agg(F.count(F.lit(1)).alias("_size"))
    upto = Window.partitionBy("source").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source", "_span", F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("source", "_span").orderBy("_day", "reading_id"))
    placed = span.withColumn("_in", inside).join(starts, ["source", "_span"])
    return placed.select("source", "reading_id", "value", F.month("_day").alias("_month"), (F.col("_start") + F.col("_in") - 1).alias("_n"))


def _blocks(numbered: DataFrame, p: SpikeRules) -> DataFrame:
    """Readings in blocks of ``p.block`` places, with ``p.side`` neighbours on both ends marked as halo."""
    own = F.floor(F.col("_n") / p.block)
    into = F.array_distinct(F.array(F.floor((F.col("_n") - p.side) / p.block), own, F.floor((F.col("_n") + p.side) / p.block)))
    return numbered.select("*", own.alias("_own"), F.explode(into).alias("_block")).where("_block >= 0")


def _median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    at = lambda i: F.get(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def _tail_cut(u: Column, scale: Column, shape: Column, share: float, risk: float) -> Column:
    """Generalised Pareto cutoff that a true reading exceeds with probability ``risk``."""
    m = F.lit(share / risk)
    return u + scale * F.when(F.abs(shape) > 1e-6, (F.pow(m, shape) - 1) / shape).otherwise(F.log(m))


def implausible(readings: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """Flags readings that cannot be true, one row per flagged ``reading_id`` with source, value and reasons.

    ``readings``: source, reading_id, value, day (DATE). Peaks over threshold per source:

    * The residual of a reading is its distance from the local level on *both* sides, the smaller one, zero
      where the sides disagree in sign; so growth and lasting changes of level leave none, and a spike must
      return. The local level follows the seasons; the source's usual residual of the calendar month, shrunk to that of all sources,
      is taken off too.
    * Residuals are measured in the source's own scatter (median step, but at least its scale's step).
    * A generalised Pareto tail is fitted over the threshold that leaves ``tail`` of the residuals: the
      shape by probability-weighted moments over all sources, that of a source by its own moments shrunk to it, the
      size per source from its mean excess, shrunk to the pooled one. Gross outliers are kept out of the fit. The cutoff sits at ``risk``.
    * Stuck: a run of one value of at least ``stuck_least`` readings is flagged if the source's usual rate of repeats (its
      longest run left out) makes less than ``stuck_risk`` such runs likely and it is twice as long as any other
      of the source, or if they are twenty times less likely still.
    * Values outside (``low``, ``high``) are impossible.

    Null values, sources or days are never flagged; repeated rows count once; NaN and infinite values count as
    impossible; sources with under 4 readings only get the plausibility rule; an empty table gives no rows.
    """
    p = rules
    rows = once(readings.select("source", "reading_id", "value", F.col("day").alias("_day"))).where(
        F.col("source").isNotNull() & F.col("value").isNotNull() & F.col("_day").isNotNull()
    )
    odd = F.isnan("value") | (F.col("value") <= p.low) | (F.col("value") >= p.high)
    gross = rows.where(odd).select("source", "reading_id", "value", F.lit("impossible").alias("reason"))
    numbered = _numbered(rows.where(~F.isnan("value")), p)

    order = Window.partitionBy("source", "_block").orderBy("_n")
    before = F.collect_list("value").over(order.rowsBetween(-p.side, -1))
    after = F.collect_list("value").over(order.rowsBetween(1, p.side))
    local = (
        _blocks(numbered, p)
        .withColumn("_left", _median(before))
        .withColumn("_right", _median(after))
        .withColumn("_prev", F.lag("value").over(order))
        .where(F.col("_block") == F.col("_own"))
        .drop("_own")
    )
    dl, dr = F.col("value") - F.col("_left"), F.col("value") - F.col("_right")
    dev = F.when(dl * dr > 0, F.signum(dl) * F.least(F.abs(dl), F.abs(dr))).otherwise(F.lit(0.0))
    starts_run = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("value")), 1).otherwise(0)
    within = Window.partitionBy("source", "_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    local = cut(
        local.withColumn("_dev", F.coalesce(dev, F.lit(0.0)))
        .withColumn("_step", F.abs(F.col("value") - F.col("_prev")))
        .withColumn("_new", starts_run)
        .withColumn("_runs", F.sum("_new").over(within))
        .select("source", "reading_id", "value", "_month", "_block", "_dev", "_step", "_new", "_runs")
    )

    # Per source: scatter and the step of its scale.
    near = lambda k: F.avg(F.when(F.abs(F.col("value") * k - F.round(F.col("value") * k)) < 1e-6, 1.0).otherwise(0.0))
    stats = local.groupBy("source").agg(
        F.count(F.lit(1)).alias("_count"),
        F.percentile_approx("_step", 0.5, 1000).alias("_mid_step"),
        F.percentile_approx("value", 0.5, 1000).alias("_mid"),
        F.sum("_new").alias("_all_runs"),
        *[near(k).alias(f"_k{k}") for k in (1, 2, 10)],
    )
    grid = F.when(F.col("_k1") > 0.9, 1.0).when(F.col("_k2") > 0.9, 0.5).when(F.col("_k10") > 0.9, 0.1).otherwise(0.01)
    scatter = F.greatest(1.4826 / 2**0.5 * F.coalesce("_mid_step", F.lit(0.0)), 0.5 * grid, 0.002 * F.abs("_mid"))
    stats = stats.withColumn("_scatter", scatter)
    blocks = local.groupBy("source", "_block").agg(F.sum("_new").alias("_starts"))
    upto = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut(
        blocks.withColumn("_offset", F.coalesce(F.sum("_starts").over(upto), F.lit(0)))
        .join(stats, "source")
        .select("source", "_block", "_offset", "_scatter", "_count", "_all_runs")
    )
    placed = local.join(blocks, ["source", "_block"]).withColumn("_run", F.col("_offset") + F.col("_runs"))

    seasonal = placed.withColumn("_z", F.col("_dev") / F.col("_scatter"))
    pooled = seasonal.groupBy("_month").agg(F.percentile_approx("_z", 0.5, 1000).alias("_pooled"))  # at most 12 rows
    of_month = seasonal.groupBy("source", "_month").agg(F.percentile_approx("_z", 0.5, 1000).alias("_own"), F.count(F.lit(1)).alias("_of_month"))
    usual = (F.col("_of_month") * F.col("_own") + p.month_prior * F.col("_pooled")) / (F.col("_of_month") + p.month_prior)
    season = of_month.join(F.broadcast(pooled), "_month").groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("_month", usual))).alias("_season"))
    resid = cut(
        seasonal.join(season, "source")
        .withColumn("_r", F.abs(F.col("_z") - F.col("_season")[F.col("_month")]))
        .select("source", "_block", "reading_id", "value", "_r", "_scatter", "_count")
    )
    cutoffs = _cutoffs(resid, p)
    spiky = blocks.select("source", "_block").join(cutoffs, "source")
    spikes = (
        resid.join(spiky, ["source", "_block"])
        .where((F.col("_count") >= 4) & (F.col("_r") > F.col("_cutoff")))
        .select("source", "reading_id", "value", F.lit("spike").alias("reason"))
    )

    runs = placed.groupBy("source", "_run").agg(F.count(F.lit(1)).alias("_len"), F.first("_count").alias("_count"), F.first("_all_runs").alias("_all_runs"))
    top = runs.groupBy("source").agg(F.max(F.struct("_len", "_run")).alias("_top"))
    runs = runs.join(top, "source").withColumn("_max", F.col("_top._len"))
    second = runs.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("_run") != F.col("_top._run"), F.col("_len"))), F.lit(1)).alias("_second"))
    runs = runs.where(F.col("_len") >= p.stuck_least).join(second, "source")
    rest, others = F.col("_count") - F.col("_max"), F.col("_all_runs") - 1
    rate = (F.greatest(rest - others, F.lit(0)) + 0.5) / (F.greatest(rest, F.lit(0)) + 1.0)
    likely = F.col("_count") * F.pow(F.least(rate, F.lit(0.999)), F.col("_len") - 1)
    far = (likely < p.stuck_risk) & (F.col("_len") >= 2 * F.col("_second")) | (likely < p.stuck_risk / 20)
    stuck_runs = runs.where(far).select("source", "_run")
    stuck = placed.join(stuck_runs, ["source", "_run"]).select("source", "reading_id", "value", F.lit("stuck").alias("reason"))

    flagged = gross.unionByName(spikes).unionByName(stuck)
    return flagged.groupBy("reading_id").agg(
        F.min("source").alias("source"), F.min("value").alias("value"), F.array_sort(F.collect_set("reason")).alias("reasons")
    )


def _cutoffs(resid: DataFrame, p: SpikeRules) -> DataFrame:
    """Per source the tail cutoff of its scaled residuals, from a generalised Pareto fit."""
    sane = resid.where(F.col("_r") < p.gross)
    u = sane.agg(F.percentile_approx("_r", 1 - p.tail, 10000)).first()[0]
    u = 1.0 if u is None else u  # no residuals at all
    excess = sane.where(F.col("_r") > u).withColumn("_x", F.col("_r") - u)
    # Probability-weighted moments of the pooled excesses, from a histogram of fixed size.
    bins = excess.groupBy(F.floor(F.col("_x") * 100).alias("_bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("s")).collect()
    shape, mean = 0.0, 0.5
    n = sum(b["n"] for b in bins)
    if n > 50:
        mean = sum(b["s"] for b in bins) / n
        seen = w1 = 0.0
        for b in sorted(bins, key=lambda b: b["_bin"]):
            w1 += b["s"] * (1 - (seen + b["n"] / 2) / n)
            seen += b["n"]
        w1 /= n
        if mean - 2 * w1 > 1e-9:
            shape = min(p.shapes[1], max(p.shapes[0], 2 - mean / (mean - 2 * w1)))
    own = excess.groupBy("source").agg(F.count(F.lit(1)).alias("_k"), F.sum("_x").alias("_s"), F.var_pop("_x").alias("_v"))
    k, total = F.coalesce("_k", F.lit(0)), F.coalesce("_s", F.lit(0.0))
    # A tail's shape by its own moments, which cutting off gross outliers and few exceedances make unsure.
    by_moments = F.when((F.col("_k") > 2) & (F.col("_v") > 0), (1 - F.pow(total / k, F.lit(2)) / F.col("_v")) / 2)
    bounded = F.least(F.lit(p.shapes[1]), F.greatest(F.lit(p.shapes[0]), F.coalesce(by_moments, F.lit(shape))))
    of_source = (k * bounded + p.shape_prior * shape) / (k + p.shape_prior)
    scale = (1 - of_source) * (total + p.prior * mean) / (k + p.prior)
    every = resid.select("source").distinct().join(own, "source", "left")
    return every.select("source", _tail_cut(F.lit(float(u)), scale, of_source, p.tail, p.risk).alias("_cutoff"))


def weight_readings(weights: DataFrame) -> DataFrame:
    return weights.select(
        F.lower(F.trim("person")).alias("source"), F.col("id").alias("reading_id"), F.col("weight").alias("value"), day("date").alias("day")
    )
