"""Comparing results with what was expected, and describing how runs went."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latency_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Count, extremes, mean and interpolated percentiles of the non-null values."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95), F.lit(0.99))).alias("q")
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.round(F.avg(value), 6).alias("mean"), q, F.max(value).alias("most"))
    return out.select(*by, "n", "least", "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"), F.col("q")[2].alias("p95"), F.col("q")[3].alias("p99"), "most")


def frequencies(df: DataFrame, col: str, none: str = "<none>") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(col), F.lit(none)).alias("value")).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), "value")


def rate(name: str) -> list[Column]:
    """Applicable (not null), correct (true) and their ratio in percent, null where nothing is applicable."""
    n, k = F.count(name), F.count_if(F.col(name))
    return [n.alias("applicable"), k.alias("correct"), F.when(n > 0, F.round(100 * k / n, 2)).alias("rate")]


def summarise(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per metric: how many rows it applies to, how many pass, the rate. One pass over the rows."""
    pairs = ", ".join(f"'{m}', {m}" for m in metrics)
    return df.selectExpr(f"stack({len(metrics)}, {pairs}) AS (metric, ok)").groupBy("metric").agg(*rate("ok"))


def score(df: DataFrame, expected: str = "expected", got: str = "got") -> DataFrame:
    """Nullable pass marks of a payload against the expected one; a mark that doesn't apply to a row is null."""
    e, g = F.col(expected), F.col(got)
    valid = g.isNotNull()
    same = lambda f: F.when(e[f].isNotNull(), F.coalesce(e[f] == g[f], F.lit(False)))
    records = F.when(e["records"].isNotNull(), valid & (F.size(e["records"]) == F.coalesce(F.size(g["records"]), F.lit(-1))))
    amount = lambda c: F.transform(c["records"], lambda r: F.coalesce(r["amount"], F.lit(0.0)))
    close = F.when(
        F.exists(e["records"], lambda r: r["amount"].isNotNull()),
        F.coalesce((F.size(amount(e)) == F.size(amount(g))) & F.forall(F.zip_with(amount(e), amount(g), lambda a, b: F.abs(a - b) <= 1e-6), lambda x: F.coalesce(x, F.lit(False))), F.lit(False)),
    )
    return df.select(
        "*",
        valid.alias("valid"),
        same("task").alias("task_ok"),
        same("lane").alias("lane_ok"),
        same("disposition").alias("disposition_ok"),
        same("reason_code").alias("reason_ok"),
        records.alias("record_count_ok"),
        close.alias("amounts_ok"),
        F.when(valid, F.to_json(e) == F.to_json(g)).alias("exact"),
    )


def bucket(scored: DataFrame) -> DataFrame:
    """Names the first thing that is wrong with each row."""
    wrong = lambda m: F.col(m).isNotNull() & ~F.col(m)
    label = (
        F.when(~F.col("valid"), "no result")
        .when(wrong("lane_ok"), "lane")
        .when(wrong("disposition_ok"), "disposition")
        .when(wrong("record_count_ok"), "record count")
        .when(wrong("amounts_ok"), "amounts")
        .when(wrong("exact"), "other field")
        .otherwise("ok")
    )
    return scored.withColumn("bucket", label)


def bucket_report(scored: DataFrame, by: str, examples: int = 3, top: int = 8, id_col: str = "id") -> DataFrame:
    """Buckets of each kind with their share of its rows, the ``top`` most frequent, and some ids of each."""
    counts = scored.groupBy(by, "bucket").agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.withColumn("share", F.round(100 * F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(by)), 2))
    place = Window.partitionBy(by).orderBy(F.desc("n_rows"), "bucket")
    first = Window.partitionBy(by, "bucket").orderBy(id_col)
    some = scored.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= examples).groupBy(by, "bucket").agg(F.sort_array(F.collect_list(id_col)).alias("ids"))
    out = total.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top)
    return out.join(some, [by, "bucket"]).select(by, "bucket", "n_rows", "share", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("examples"))


def snapshot(df: DataFrame, name: str, id_col: str, text: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.max(id_col).alias("max_id"), F.max_by(text, id_col).alias("latest")).select(F.lit(name).alias("relation"), "n_rows", "max_id", "latest")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    b, a = before.select("relation", F.col("n_rows").alias("n0"), F.col("max_id").alias("m0")), after.select("relation", F.col("n_rows").alias("n1"), F.col("max_id").alias("m1"))
    z = lambda c: F.coalesce(c, F.lit(0))
    j = b.join(a, "relation", "full")
    return j.select("relation", (z("n1") - z("n0")).alias("rows_added"), (z("m1") - z("m0")).alias("id_moved"))


def outcome_matrix(df: DataFrame, by: str, outcome: str, outcomes: Sequence[str], value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(outcome) == o).alias(f"n_{o}") for o in outcomes], q.alias("q"))
    return out.select(by, "n_rows", *[f"n_{o}" for o in outcomes], F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"))


def changed_keys(a: Column, b: Column) -> Column:
    """Keys on which two maps disagree, in order."""
    return F.array_sort(F.map_keys(F.map_filter(F.map_zip_with(a, b, lambda k, x, y: ~x.eqNullSafe(y)), lambda k, v: v)))
