"""Readers and writers of line files, and texts that hold tables."""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.runtime import shared_folder


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = (), cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Good and bad rows of JSON-lines files below ``path``: blank lines are skipped; lines that don't parse or lack a
    required field are bad, kept as text with the reason."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).where(F.length(F.trim("value")) > 0)
    if cap is not None:
        lines = lines.limit(cap)
    kept = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = lines.select("value", F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    lacking = F.lit(None).cast("string")
    for f in reversed(required):
        lacking = F.when(F.col(f"r.{f}").isNull(), F.lit(f"no {f}")).otherwise(lacking)
    rows = rows.withColumn("reason", F.when(F.col("r._corrupt").isNotNull() | F.col("r").isNull(), "broken").otherwise(lacking))
    return rows.where("reason IS NULL").select("r.*").drop("_corrupt"), rows.where("reason IS NOT NULL").select("value", "reason")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)


def archive_by_day(df: DataFrame, day: str, path: str, mode: str = "append") -> None:
    """Rows as JSON lines in one folder per day; each day is written by few tasks."""
    df.withColumn("day", F.col(day)).repartition("day").write.mode(mode).partitionBy("day").json(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


LOG_LINE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\s+(\w+)\s+(\w+)\s+(?:lane=(\w+)\s+)?ms=(\d+)\s+(\w+)$"


def log_lines(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """Entries of log texts: id, line_no, at, severity, category, lane, ms, outcome; lines of another form are left out."""
    lines = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    part = lambda i: F.regexp_extract("line", LOG_LINE, i)
    return lines.where(F.regexp_like("line", F.lit(LOG_LINE))).select(
        "id", "line_no", F.replace(part(1), F.lit("T"), F.lit(" ")).alias("at"), part(2).alias("severity"), part(3).alias("category"), F.nullif(part(4), F.lit("")).alias("lane"), part(5).cast("long").alias("ms"), part(6).alias("outcome")
    )


def sections(texts: DataFrame, id_col: str, text: str, marker: str, kinds: tuple[str, ...]) -> DataFrame:
    """Entries of texts in which each one begins with a marker line: id, entry_no, input, kind, at, body, parsed, took.

    The line after the marker may hold a kind and a time; of the others ``[parsed: ...]`` and ``[time: ...]`` are kept apart, the
    rest is the body without blank edges. Lines before the first marker are left out.
    """
    entries = F.split(F.concat(F.lit("\n"), F.col(text)), f"\n{re.escape(marker)}")
    rows = texts.select(F.col(id_col).alias("id"), F.posexplode(entries).alias("entry_no", "e")).where("entry_no > 0").withColumn("lines", F.split("e", "\n"))
    second = F.split(F.trim(F.coalesce(F.get("lines", F.lit(1)), F.lit(""))), " ")
    has = second[0].isin(*kinds)
    rest = F.slice("lines", F.when(has, 3).otherwise(2), F.size("lines"))
    mark = lambda x, name: F.startswith(x, F.lit(f"[{name}:")) & F.endswith(x, F.lit("]"))
    body = F.filter(rest, lambda x: ~mark(x, "parsed") & ~mark(x, "time"))
    return rows.select(
        "id", "entry_no", F.col("lines")[0].alias("input"), F.when(has, second[0]).alias("kind"), F.when(has, F.nullif(F.array_join(F.slice(second, 2, F.size(second)), " "), F.lit(""))).alias("at"),
        F.regexp_replace(F.array_join(body, "\n"), r"^\n+|\n+$", "").alias("body"), F.try_element_at(F.filter(rest, lambda x: mark(x, "parsed")), F.lit(-1)).alias("parsed"), F.try_element_at(F.filter(rest, lambda x: mark(x, "time")), F.lit(-1)).alias("took"),
    )


def columns_of(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    """Relations and their columns, from the files' footers alone."""
    rows = []
    for name in names:
        rows += [(name, f.name, f.dataType.simpleString(), i) for i, f in enumerate(spark.read.parquet(f"{folder}/{name}.parquet").schema.fields)]
    return spark.createDataFrame(rows, "relation string, column_name string, data_type string, position int")


def padded(df: DataFrame, cols: tuple[str, ...], sep: str = " | ") -> DataFrame:
    """One text line per row with columns as wide as their longest value."""
    widths = df.agg(*[F.max(F.length(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in cols]).first()
    cell = lambda c: F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), max(1, widths[c] or 1), " ")
    return df.select(*df.columns, F.concat_ws(sep, *[cell(c) for c in cols]).alias("line"))


def json_field(col: str, path: str) -> Column:
    return F.get_json_object(col, path)
