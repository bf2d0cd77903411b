"""Structured questions about the records and the conditions they stand for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows shown when a question names no limit, per kind of record. Fixed values.
DEFAULT_LIMITS = {"expense": 10, "buy": 25, "todo": 20, "weight": 10, "ledger": 20, "note": 20}


@dataclass(frozen=True)
class Question:
    """A question with every part optional; a part that is absent adds no condition."""

    domain: str = "expense"
    start: str | None = None
    end: str | None = None
    compare_start: str | None = None
    compare_end: str | None = None
    contains: str | None = None
    not_contains: str | None = None
    group: str | None = None
    not_group: str | None = None
    people: Sequence[str] = ()
    status: str | None = None
    perspective: str | None = None
    limit: int | None = None


def clamp_limit(limit: int | None, domain: str, least: int = 1, most: int = 100) -> int:
    return max(least, min(most, limit if limit is not None else DEFAULT_LIMITS.get(domain, 20)))


def in_window(day: Column, start: str | None, end: str | None) -> Column:
    """Inclusive on both sides; an open side adds nothing."""
    cond = F.lit(True)
    if start:
        cond = cond & (day >= start)
    if end:
        cond = cond & (day <= end)
    return cond


def text_condition(col: Column, contains: str | None = None, not_contains: str | None = None) -> Column:
    """Case-insensitive containment; signs in the wanted text stand for themselves. Null text contains nothing and is kept
    by neither condition."""
    cond = F.lit(True)
    if contains:
        cond = cond & F.contains(F.lower(col), F.lit(contains.lower()))
    if not_contains:
        cond = cond & ~F.contains(F.lower(col), F.lit(not_contains.lower()))
    return cond


def group_condition(col: Column, group: str | None = None, not_group: str | None = None) -> Column:
    """A group by name; leaving one out keeps rows without a group."""
    cond = F.lit(True)
    if group:
        cond = cond & (col == group.lower())
    if not_group:
        cond = cond & (col.isNull() | (col != not_group.lower()))
    return cond


def vocabulary_condition(col: Column, text: Column, group: str, words: Sequence[str], exclude: bool = False) -> Column:
    """A row belongs to a group by name, or by a word of its vocabulary in the text."""
    any_word = F.lit(False)
    for w in words:
        any_word = any_word | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w.lower()))
    hit = (F.coalesce(col, F.lit("")) == group.lower()) | any_word
    return ~hit if exclude else hit


def apply_filters(df: DataFrame, q: Question, day: str = "event_day", text: str = "description") -> DataFrame:
    cond = in_window(F.col(day), q.start, q.end) & text_condition(F.col(text), q.contains, q.not_contains)
    if "group_key" in df.columns:
        cond = cond & group_condition(F.col("group_key"), q.group, q.not_group)
    if q.people and "person" in df.columns:
        cond = cond & F.col("person").isin([p.lower() for p in q.people])
    if q.status and "status" in df.columns:
        cond = cond & (F.col("status") == q.status)
    return df.where(cond)


def status_of(asked: str | None, domain: str) -> str | None:
    """A status as the records write it: 'open' to-dos are 'pending'; a buy list without one means the open items."""
    if domain == "buy":
        return asked or "open"
    return "pending" if asked == "open" else asked
