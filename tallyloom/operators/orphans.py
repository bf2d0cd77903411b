"""References to records that do not exist."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.days import day, stamp
from tallyloom.runtime import cut, lookup_join, once

WORD = 64


class KeyFilter:
    """A Bloom filter over the parents' keys as a numpy array of 64-bit words.

    It is filled by one distributed aggregation per word (``bit_or`` with map-side combining) and has
    ``bits`` bits whatever the number of keys, at most ``max_bits``: 2**27 bits are 16 MB, which bounds
    what is collected and broadcast. With more keys only more references need the exact join.
    """

    def __init__(self, words: np.ndarray, hashes: int):
        self.words, self.hashes = words, hashes

    @staticmethod
    def plan(keys: int, max_bits: int = 1 << 27, bits_per_key: int = 10) -> tuple[int, int]:
        bits = max(1 << 10, 1 << math.ceil(math.log2(max(1, keys) * bits_per_key)))
        bits = min(bits, max_bits)
        return bits, max(1, min(8, round(bits / max(1, keys) * math.log(2))))

    @classmethod
    def build(cls, parents: DataFrame, key: str, max_bits: int = 1 << 27) -> "KeyFilter":
        keys = parents.where(F.col(key).isNotNull())
        bits, hashes = cls.plan(keys.count(), max_bits)
        spots = [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)) for i in range(hashes)]
        words = (
            keys.select(F.explode(F.array(*spots)).alias("_s"))
            .groupBy(F.floor(F.col("_s") / WORD).cast("int").alias("_w"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_s", F.lit(WORD)).cast("int"))).alias("_v"))
            .toPandas()
        )
        own = np.zeros(bits // WORD, dtype=np.int64)
        own[words["_w"].to_numpy(dtype=np.int64)] = words["_v"].to_numpy(dtype=np.int64)
        return cls(own.view(np.uint64), hashes)

    @property
    def bits(self) -> int:
        return len(self.words) * WORD

    def test(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """Adds ``name``: false proves that no parent has the key."""
        held = df.sparkSession.sparkContext.broadcast(self.words)

        @F.pandas_udf("boolean")
        def maybe(spots: pd.Series) -> pd.Series:
            if not len(spots):
                return pd.Series([], dtype=bool)
            at = np.stack(spots.to_numpy()).astype(np.uint64)
            return pd.Series(((held.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1))

        spots = F.array(*[F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(self.bits)) for i in range(self.hashes)])
        return df.withColumn(name, maybe(spots))


def reference_states(refs: DataFrame, parents: DataFrame, tombstones: DataFrame, max_bits: int = 1 << 27) -> DataFrame:
    """The state of each reference whose parent is deleted, missing or created later.

    ``refs``: src_table, row_id, parent_id, created_at; ``parents``: id, created_at; ``tombstones``: note_id.
    A Bloom filter over all known parent keys, living or deleted, proves definite orphans without a join;
    only filter-positive references are checked by an exact join. Order of the states: ``deleted`` if a
    tombstone has the key, else ``missing`` if no parent has it, else ``late`` if the parent was created
    after the row. Null references are no references; null times are never late; repeated rows count once;
    a parent delivered with two times counts with its earliest. Other columns are ignored.
    """
    known = (
        parents.select(F.col("id").alias("parent_id"), stamp("created_at").alias("_born"), F.lit(False).alias("_dead"))
        .unionByName(tombstones.select(F.col("note_id").alias("parent_id"), F.lit(None).cast("string").alias("_born"), F.lit(True).alias("_dead")))
        .where(F.col("parent_id").isNotNull())
        .groupBy("parent_id")
        .agg(F.min("_born").alias("_born"), F.max("_dead").alias("_dead"), F.max(~F.col("_dead")).alias("_shown"))
    )
    known = cut(known)
    asked = once(
        refs.where(F.col("parent_id").isNotNull()).select("src_table", "row_id", "parent_id", stamp("created_at").alias("_at"))
    )
    tested = cut(KeyFilter.build(known, "parent_id", max_bits).test(asked, "parent_id", "_maybe"))
    orphans = tested.where(~F.col("_maybe")).select("src_table", "row_id", "parent_id", "_at", F.lit("missing").alias("state"))
    checked = lookup_join(tested.where("_maybe").drop("_maybe"), known, "parent_id")
    state = (
        F.when(F.coalesce("_dead", F.lit(False)), "deleted")
        .when(~F.coalesce("_shown", F.lit(False)), "missing")
        .when(F.col("_born") > F.col("_at"), "late")
    )
    exact = checked.select("src_table", "row_id", "parent_id", "_at", state.alias("state")).where(F.col("state").isNotNull())
    return orphans.unionByName(exact)


def note_references(expenses: DataFrame, note_vectors: DataFrame) -> DataFrame:
    one = lambda df, name: df.select(
        F.lit(name).alias("src_table"), F.col("id").alias("row_id"), F.col("source_note_id").alias("parent_id"), "created_at"
    )
    return one(expenses, "expenses").unionByName(one(note_vectors, "note_vectors"))


def found(states: DataFrame) -> DataFrame:
    return states.select("src_table", "row_id", "state").distinct()


def report(states: DataFrame) -> DataFrame:
    """Orphan references per table, month of the row and state."""
    rows = states.select("src_table", "row_id", "state", F.date_format(day("_at"), "yyyy-MM").alias("month")).distinct()
    return rows.groupBy("src_table", "month", "state").agg(F.count(F.lit(1)).alias("n_refs"))
