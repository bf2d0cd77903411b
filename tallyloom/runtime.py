"""Session settings, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "tallyloom", cores: int = 8) -> SparkSession:
    """A local session with the settings the operators are written for."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share: the one the session names in ``spark.checkpoint.dir``. Only where
    neither the setting nor a folder is set, as in tests on one machine, a temporary one is made."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyloom-", dir=os.environ.get("TMPDIR")))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there; later stages survive a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def once(df: DataFrame, *key: str) -> DataFrame:
    """Remove redelivered rows: rows that agree in every selected column count once.

    With ``key`` one row per key stays, and it is the same row in every run (the least of its columns).
    """
    if not key:
        return df.distinct()
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.select(*key).distinct()
    one = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_one"))
    return one.select(*key, "_one.*").select(*df.columns)


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> list:
    """Keys that hold more than ``share`` of the rows; by that at most ``1 / share`` values come to the driver."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    if not total:
        return []
    return [r[0] for r in counts.where(F.col("_n") > F.lit(max(1000.0, share * total))).collect()]


def lookup_join(left: DataFrame, right: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """Left join to a table that is unique in ``key``, safe where a few keys hold most of ``left``.

    Rows of hot keys (at most ``1 / share`` keys, one row each on the right) take a broadcast join,
    the rest a shuffled one; rows are neither dropped nor repeated.
    """
    hot = hot_keys(left, key, share)
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = right.where(F.col(key).isin(hot))
    cold = left.where(~is_hot).join(right, key, "left")
    warm = left.where(is_hot).join(F.broadcast(few), key, "left")
    return cold.unionByName(warm)
