"""Queries of the general data-quality operators (problems 1 to 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.days import day
from tallyloom.operators import orphans, spikes, trailing
from tallyloom.runtime import once, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    flagged = spikes.implausible(spikes.weight_readings(table(spark, d, "weights")))
    return flagged.select(F.col("reading_id").alias("weight_id"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Flagged readings per reason and month of the reading."""
    readings = spikes.weight_readings(table(spark, d, "weights"))
    flagged = spikes.implausible(readings).select("reading_id", F.explode("reasons").alias("reason"))
    months = once(readings.select("reading_id", F.date_format("day", "yyyy-MM").alias("month")))
    return flagged.join(months, "reading_id").groupBy("month", "reason").agg(F.count(F.lit(1)).alias("n_readings"))


def p2_trailing(spark: SparkSession, d: str) -> DataFrame:
    out = trailing.expense_trailing(table(spark, d, "expenses"))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd")).select(
        "group_name", "day", *[F.round(c, 4).alias(c) for c in ("total_7", "avg_7", "total_30", "avg_30")]
    )


def _states(spark: SparkSession, d: str) -> DataFrame:
    refs = orphans.note_references(table(spark, d, "expenses"), table(spark, d, "note_vectors"))
    return orphans.reference_states(refs, table(spark, d, "notes"), table(spark, d, "note_tombstones"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.found(_states(spark, d))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(_states(spark, d))


_DAY = "coalesce(try_cast(substr(date, 1, 10) AS DATE), try_cast(substr(created_at, 1, 10) AS DATE))"

_REF_CTE = """
WITH refs AS (
  SELECT DISTINCT 'expenses' AS src_table, id AS row_id, source_note_id AS parent_id, replace(trim(created_at), 'T', ' ') AS seen
  FROM expenses WHERE source_note_id IS NOT NULL
  UNION SELECT DISTINCT 'note_vectors', id, source_note_id, replace(trim(created_at), 'T', ' ')
  FROM note_vectors WHERE source_note_id IS NOT NULL),
born AS (SELECT id, min(replace(trim(created_at), 'T', ' ')) AS born FROM notes GROUP BY id),
dead AS (SELECT DISTINCT note_id FROM note_tombstones),
states AS (
  SELECT src_table, row_id, seen,
    CASE WHEN note_id IS NOT NULL THEN 'deleted' WHEN id IS NULL THEN 'missing' WHEN born > seen THEN 'late' END AS state
  FROM refs LEFT JOIN born ON id = parent_id LEFT JOIN dead ON note_id = parent_id)
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p2_trailing": p2_trailing, "p3_found": p3_found, "p3_report": p3_report}

SQL = {
    "p2_trailing": f"""
WITH rows AS (SELECT DISTINCT id, lower(trim(group_name)) AS g, {_DAY} AS d, amount FROM expenses),
daily AS (SELECT g, d, sum(cast(amount AS DECIMAL(30,4))) AS t FROM rows WHERE d IS NOT NULL GROUP BY g, d),
span AS (SELECT min(d) AS lo, max(d) AS hi FROM daily),
cal AS (SELECT cast(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS on_day FROM span),
ends AS (SELECT g, on_day FROM (SELECT DISTINCT g FROM daily), cal),
sums AS (
  SELECT e.g, e.on_day,
    cast(coalesce(sum(t) FILTER (WHERE d > on_day - INTERVAL 7 DAY), 0) AS DOUBLE) AS t7,
    cast(coalesce(sum(t), 0) AS DOUBLE) AS t30
  FROM ends e LEFT JOIN daily y ON e.g IS NOT DISTINCT FROM y.g AND d <= on_day AND d > on_day - INTERVAL 30 DAY
  GROUP BY e.g, e.on_day)
SELECT g AS group_name, strftime(on_day, '%Y-%m-%d') AS day, round(t7, 4) AS total_7, round(t7 / 7, 4) AS avg_7,
  round(t30, 4) AS total_30, round(t30 / 30, 4) AS avg_30 FROM sums""",
    "p3_found": _REF_CTE + "SELECT DISTINCT src_table, row_id, state FROM states WHERE state IS NOT NULL",
    "p3_report": _REF_CTE
    + "SELECT src_table, substr(seen, 1, 7) AS month, state, count(*) AS n_refs FROM states WHERE state IS NOT NULL GROUP BY ALL",
}
