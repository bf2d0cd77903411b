"""Day and time columns kept as text in two written forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stamp(col: str | Column) -> Column:
    """Local time text as ``yyyy-MM-dd HH:mm:ss`` so that both written forms compare alike."""
    c = F.col(col) if isinstance(col, str) else col
    return F.replace(F.trim(c), F.lit("T"), F.lit(" "))


def day_text(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.substring(F.trim(c), 1, 10)


def day(col: str | Column) -> Column:
    """DATE of a day text; null where the text is no day."""
    return F.try_to_date(day_text(col), "yyyy-MM-dd")


def event_day(date: str = "date", created: str = "created_at") -> Column:
    return F.coalesce(day(date), day(created))
