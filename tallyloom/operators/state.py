"""Current state out of changes: upserts, renames, deletions, queues and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def notes_by_day(entries: DataFrame, at: str = "at", text: str = "text") -> DataFrame:
    """One text per day: newest entry first, each with its time in front, a blank line between them. A day's entries are
    gathered, as its text has to hold them."""
    packed = F.reverse(F.sort_array(F.collect_list(F.struct(F.col(at).alias("t"), F.col("id").alias("i"), F.col(text).alias("x")))))
    line = lambda s: F.concat(F.lit("["), F.substring(s["t"], 12, 8), F.lit("] "), s["x"])
    return entries.groupBy(F.substring(at, 1, 10).alias("day")).agg(F.array_join(F.transform(packed, line), "\n\n").alias("content"), F.count(F.lit(1)).alias("n_entries"))


def merge_memo(uses: DataFrame, key: str, value: str, at: str, order: str = "id") -> DataFrame:
    """How often each pattern was used, what it last meant and when. Folding in batches gives the same: see ``fold_memo``."""
    last = F.struct(F.col(at).alias("t"), F.col(order).alias("o"))
    return uses.groupBy(F.col(key).alias("pattern")).agg(F.count(F.lit(1)).alias("hit_count"), F.max_by(value, last).alias("resolved"), F.max(at).alias("last_used"), F.max_by(order, last).alias("last_id"))


def fold_memo(memo: DataFrame, more: DataFrame) -> DataFrame:
    """Two memos in one."""
    last = F.struct("last_used", "last_id")
    return memo.unionByName(more).groupBy("pattern").agg(F.sum("hit_count").alias("hit_count"), F.max_by("resolved", last).alias("resolved"), F.max("last_used").alias("last_used"), F.max_by("last_id", last).alias("last_id"))


def prune(memo: DataFrame, as_of: str, days: int) -> DataFrame:
    return memo.where(F.col("last_used") >= F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyy-MM-dd"))


def latest_values(changes: DataFrame, key: str, value: str, at: str, order: str = "id") -> DataFrame:
    """Last write wins; a key whose last value is null is cleared."""
    return changes.groupBy(key).agg(F.max_by(value, F.struct(at, order)).alias(value)).where(F.col(value).isNotNull())


def pair_replies(prompts: DataFrame, replies: DataFrame, by: str, at: str) -> DataFrame:
    """Each reply with the latest prompt of the same ``by`` at or before it: reply_id, prompt_id; the first reply to a prompt
    settles it, marked ``settles``. One window over both, no join of all pairs."""
    p = prompts.select(by, at, F.lit(0).alias("turn"), F.col("id").alias("pid"), F.lit(None).cast("long").alias("rid"))
    r = replies.select(by, at, F.lit(1).alias("turn"), F.lit(None).cast("long").alias("pid"), F.col("id").alias("rid"))
    w = Window.partitionBy(by).orderBy(at, "turn", F.coalesce("pid", "rid")).rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(r).withColumn("prompt_id", F.last("pid", ignorenulls=True).over(w)).where("turn = 1")
    first = Window.partitionBy(by, "prompt_id").orderBy(at, "rid")
    return both.select(F.col("rid").alias("reply_id"), "prompt_id", (F.col("prompt_id").isNotNull() & (F.row_number().over(first) == 1)).alias("settles"))


def one_pending(actions: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """Of the pending actions of a session only the newest stays so; older ones are dismissed."""
    w = Window.partitionBy(by, F.col("status") == "pending").orderBy(*[F.col(c).desc() for c in order])
    newest = F.row_number().over(w) == 1
    return actions.withColumn("status", F.when((F.col("status") == "pending") & ~newest, "dismissed").otherwise(F.col("status")))


def rename(df: DataFrame, mapping: DataFrame, col: str) -> DataFrame:
    """Names replaced after a mapping (old, new), the same in every relation it is applied to; of two targets the first in the alphabet."""
    m = mapping.groupBy(F.col("old").alias(col)).agg(F.min("new").alias("_new"))
    return df.join(m, col, "left").withColumn(col, F.coalesce("_new", col)).drop("_new").select(*df.columns)


def new_people(rows: DataFrame, persons: DataFrame, col: str = "person") -> DataFrame:
    """Names in use that have no entry yet."""
    return rows.select(F.col(col).alias("name")).where("name IS NOT NULL").distinct().join(persons.select("name"), "name", "left_anti")


def without(df: DataFrame, tombstones: DataFrame, key: str, dead: str) -> DataFrame:
    """Rows that no tombstone names."""
    return df.join(tombstones.select(F.col(dead).alias(key)).where(F.col(key).isNotNull()), key, "left_anti")


def rotate(log: DataFrame, cap: int, least: int, order: str = "id") -> DataFrame:
    """Marks the oldest rows beyond ``cap``, at least ``least`` of them, as ``archived`` once a log is over its cap.

    The edge is the oldest of the rows that stay, at most ``cap`` of them, so the log is never sorted whole. ``order`` is
    unique.
    """
    total = log.count()
    if total <= cap:
        return log.withColumn("archived", F.lit(False))
    stay = max(0, min(cap, total - least))
    edge = log.select(F.col(order).alias("o")).orderBy(F.desc("o")).limit(stay).agg(F.min("o")).first()[0] if stay else None
    return log.withColumn("archived", F.lit(True) if edge is None else F.col(order) < F.lit(edge))


def queue_state(changes: DataFrame, key: str, order: Sequence[str], status: Column) -> DataFrame:
    """Last status per queued item, and whether it has to be taken up again after a crash."""
    last = changes.withColumn("_s", status).groupBy(key).agg(F.max_by("_s", F.struct(*order)).alias("status"), F.min(order[0]).alias("queued_at"))
    return last.withColumn("recover", F.col("status").isin("pending", "processing"))


def written_rows(writes: DataFrame) -> DataFrame:
    """Rows that accepted payloads add, per relation, with the input they came from as ``capture_id``."""
    ok = writes.where("output.disposition = 'accept'")
    rows = ok.select(F.col("id").alias("capture_id"), F.col("output.lane").alias("relation"), F.posexplode("output.records").alias("pos", "r"))
    return rows.select("capture_id", "relation", "pos", F.coalesce("r.description", "r.item_text", "r.text", "r.person_text").alias("what"), F.coalesce("r.amount", "r.value").alias("amount"), "r.date")


def captures_of(notes: DataFrame) -> DataFrame:
    """Captures out of notes that carry raw input; running it again adds nothing, as ids are kept."""
    return notes.where("coalesce(structured_type, 'raw') != 'note'").select("id", F.col("content").alias("raw_text"), F.coalesce("input_kind", F.lit("note")).alias("lane"), "metadata_json", "created_at").distinct()
