"""The project's relations with redelivered rows removed and one day per row."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.days import day_text, stamp
from tallyloom.runtime import table


def _day_of_event() -> Column:
    return F.coalesce(day_text("date"), day_text("created_at"))


#: Columns of a relation that are made of others: what they are made of, and how.
MADE = {
    "expenses": {"event_day": (("date", "created_at"), _day_of_event), "group_key": (("group_name",), lambda: F.lower(F.trim("group_name")))},
    "ledger": {"event_day": (("date", "created_at"), _day_of_event), "person": (("person",), lambda: F.lower(F.trim("person")))},
    "weights": {"event_day": (("date",), lambda: day_text("date")), "person": (("person",), lambda: F.lower(F.trim("person")))},
    "notes": {"event_day": (("created_at",), lambda: day_text("created_at"))},
    "activity": {"at": (("created_at",), lambda: stamp("created_at"))},
}
TABLES = {"activity": "activity_log"}


class Records:
    """Lazy relations over a folder of Parquet tables. Redelivered rows agree in every column, so ``distinct`` over the id and
    the columns in use removes them; where a relation needs no such step it has none."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def of(self, name: str, *columns: str) -> DataFrame:
        """The relation with these columns. Repeats are removed over the id and what the columns are made of, so nothing else is
        read or shuffled, and conditions on them still reach the scan."""
        made = MADE.get(name, {})
        base = dict.fromkeys(["id", *[b for c in columns for b in (made[c][0] if c in made else (c,))]])
        rows = self.raw(TABLES.get(name, name)).select(*base).distinct()
        return rows.select(*[made[c][1]().alias(c) if c in made else F.col(c) for c in columns])

    def repeated(self, name: str, *columns: str) -> DataFrame:
        """The columns with redelivered rows, for sets, semi-joins and extremes that repeats don't change: no step at all."""
        made = MADE.get(name, {})
        return self.raw(TABLES.get(name, name)).select(*[made[c][1]().alias(c) if c in made else F.col(c) for c in columns])

    @cached_property
    def persons(self) -> DataFrame:
        return self.of("persons", "id", "name", "created_at")

    @cached_property
    def expenses(self) -> DataFrame:
        return self.of("expenses", "id", "amount", "description", "date", "group_name", "source_note_id", "created_at", "event_day", "group_key")

    @cached_property
    def ledger(self) -> DataFrame:
        return self.of("ledger", "id", "person", "amount", "direction", "note", "date", "source_note_id", "created_at", "event_day")

    @cached_property
    def weights(self) -> DataFrame:
        return self.of("weights", "id", "person", "weight", "date", "note", "created_at", "event_day")

    @cached_property
    def notes(self) -> DataFrame:
        return self.of("notes", "id", "content", "input_kind", "structured_type", "note_domain", "metadata_json", "created_at", "processed_at", "event_day")

    @cached_property
    def note_vectors(self) -> DataFrame:
        return self.of("note_vectors", "id", "domain", "content", "embedding", "source", "date", "source_note_id", "created_at")

    @cached_property
    def activity(self) -> DataFrame:
        return self.of("activity", "id", "input_text", "response_text", "kind", "metadata_json", "created_at", "at")

    @cached_property
    def writes(self) -> DataFrame:
        """Parser records: one row per input with its gold payload."""
        return self.raw("parse_write").select("id", "anchor_date", "input", "output", "split", "source").dropDuplicates(["id"])

    def _lane(self, lane: str) -> DataFrame:
        rows = self.writes.where(F.col("output.lane") == lane).select("id", "split", F.posexplode("output.records").alias("pos", "r"))
        done = F.col("split") == "valid"
        return rows.select((F.col("id") * 100 + F.col("pos")).alias("id"), "r", done.alias("done"))

    @cached_property
    def todos(self) -> DataFrame:
        return self._lane("todo").select("id", F.col("r.text").alias("content"), F.col("r.date").alias("date"), F.when(F.col("done"), "done").otherwise("pending").alias("status"))

    @cached_property
    def buy_items(self) -> DataFrame:
        return self._lane("buy").select(
            "id", F.col("r.item_text").alias("item_text"), F.col("r.quantity_text").alias("quantity_text"), F.col("r.unit_text").alias("unit_text"),
            F.col("r.date").alias("date"), F.when(F.col("done"), "done").otherwise("open").alias("status"),
        )

    @cached_property
    def events(self) -> DataFrame:
        """The event feed: id, at, category, severity, user_id, value, props."""
        rows = self.raw("events")
        severity = F.when(F.col("value").isNull(), "error").when(F.col("value") > 100, "warning").otherwise("info")
        return rows.select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("category"), severity.alias("severity"), "user_id", "value", "props")
