"""Questions about expenses, two-way ledgers, weights and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.plans.spec import Question, apply_filters, clamp_limit, in_window

MONEY = "decimal(30,4)"


def money(col: str | Column) -> Column:
    """Exact amounts, so that sums don't depend on the order of rows and a settled balance is exactly 0."""
    return (F.col(col) if isinstance(col, str) else col).cast(MONEY)


def total(df: DataFrame, q: Question) -> DataFrame:
    """Total amount of the rows that match, 0 if none does."""
    return apply_filters(df, q).agg(F.coalesce(F.sum(money("amount")), F.lit(0)).cast("double").alias("total"))


def compare(df: DataFrame, q: Question) -> DataFrame:
    """Totals of two windows under the same other conditions, in one pass over the rows."""
    rest = Question(domain=q.domain, contains=q.contains, not_contains=q.not_contains, group=q.group, not_group=q.not_group, people=q.people)
    one, two = in_window(F.col("event_day"), q.start, q.end), in_window(F.col("event_day"), q.compare_start, q.compare_end)
    part = lambda c: F.coalesce(F.sum(F.when(c, money("amount"))), F.lit(0)).cast("double")
    rows = apply_filters(df, rest).where(one | two)
    return rows.agg(part(one).alias("primary_total"), part(two).alias("compare_total")).withColumn("change", F.round(F.col("primary_total") - F.col("compare_total"), 4))


def newest(df: DataFrame, q: Question, text: str = "description", first: Column | None = None) -> DataFrame:
    """The rows that match, newest day first, ties by id; at most the asked or usual number. ``first`` sorts before the day."""
    order = ([first.asc()] if first is not None else []) + [F.col("event_day" if "event_day" in df.columns else "date").desc_nulls_last(), F.col("id").desc()]
    day = "event_day" if "event_day" in df.columns else "date"
    return apply_filters(df, q, day=day, text=text).orderBy(*order).limit(clamp_limit(q.limit, q.domain))


def by_month(df: DataFrame, latest: int | None = None) -> DataFrame:
    out = df.groupBy(F.substring("event_day", 1, 7).alias("month")).agg(F.sum(money("amount")).cast("double").alias("total"))
    return out.orderBy(F.col("month").desc_nulls_last()).limit(latest) if latest else out


def month_change(df: DataFrame) -> DataFrame:
    """Each month's total, the month before it and the change in percent; no percentage where that total isn't positive."""
    w = Window.orderBy("month")  # one row per month
    out = by_month(df).where("month IS NOT NULL").withColumn("last_total", F.lag("total").over(w))
    pct = F.when(F.col("last_total") > 0, F.round((F.col("total") - F.col("last_total")) / F.col("last_total") * 100, 4))
    return out.withColumn("change_pct", pct)


def day_groups(df: DataFrame, key: Column) -> DataFrame:
    """Sub-total and number of rows per day."""
    return df.groupBy(key.alias("day")).agg(F.sum(money("amount")).cast("double").alias("total"), F.count(F.lit(1)).alias("n_rows"))


def joined_by_day(df: DataFrame, key: str, text: Column, order: str = "id", sep: str = " · ") -> DataFrame:
    """One line per day: its rows' texts in order. A day's rows are gathered, as the line itself has to hold them."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return df.groupBy(F.col(key).alias("day")).agg(F.array_join(F.transform(packed, lambda s: s["t"]), sep).alias("line"))


# Two-way ledger -----------------------------------------------------------------------------------------------------


def signed(direction: str = "direction", amount: str = "amount") -> Column:
    """Given counts for, anything else against."""
    return F.when(F.col(direction) == "gave", money(amount)).otherwise(-money(amount))


def balances(ledger: DataFrame, q: Question = Question(domain="ledger")) -> DataFrame:
    """Signed balance per person within the window; positive means they owe."""
    rows = ledger.where(in_window(F.col("event_day"), q.start, q.end))
    if q.people:
        rows = rows.where(F.col("person").isin([p.lower() for p in q.people]))
    return rows.groupBy("person").agg(F.sum(signed()).alias("balance"))


def standing(bal: DataFrame, perspective: str | None = None, status: str | None = None) -> DataFrame:
    """Balances on one side, or open, or settled."""
    cond = F.lit(True)
    if perspective == "they_owe_me":
        cond = cond & (F.col("balance") > 0)
    if perspective == "i_owe_them":
        cond = cond & (F.col("balance") < 0)
    if status == "open":
        cond = cond & (F.col("balance") != 0)
    if status == "settled":
        cond = cond & (F.col("balance") == 0)
    return bal.where(cond)


def owed_totals(bal: DataFrame) -> DataFrame:
    pos, neg = F.sum(F.when(F.col("balance") > 0, F.col("balance"))), F.sum(F.when(F.col("balance") < 0, -F.col("balance")))
    return bal.agg(F.coalesce(pos, F.lit(0)).cast("double").alias("owed_to_me"), F.coalesce(neg, F.lit(0)).cast("double").alias("i_owe"))


def entries_of(ledger: DataFrame, people: DataFrame) -> DataFrame:
    """Ledger rows of the given people; of nobody if there are none."""
    return ledger.join(people.select("person").distinct(), "person", "left_semi")


def settle(entries: DataFrame) -> DataFrame:
    """Running balance per person where some rows settle: such a row takes the amount that brings the balance to 0.

    ``entries``: id, person, day, kind ('gave', 'received' or 'settle'), amount. Rows after a settlement start again at 0,
    so the running sum only has to run within the stretch between two settlements.
    """
    order = Window.partitionBy("person").orderBy("day", "id")
    step = F.when(F.col("kind") == "gave", money("amount")).when(F.col("kind") == "received", -money("amount")).otherwise(F.lit(0).cast(MONEY))
    rows = entries.withColumn("step", step).withColumn("epoch", F.sum((F.col("kind") == "settle").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("epoch", F.coalesce("epoch", F.lit(0)))
    within = Window.partitionBy("person", "epoch").orderBy("day", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.sum("step").over(within))
    closing = F.col("kind") == "settle"
    return rows.select(
        "id", "person", "day", "kind",
        F.when(closing, F.abs("before")).otherwise(money("amount")).cast("double").alias("amount"),
        F.when(closing, F.when(F.col("before") > 0, "received").otherwise("gave")).otherwise(F.col("kind")).alias("direction"),
        F.when(closing, F.lit(0).cast(MONEY)).otherwise(F.col("before")).cast("double").alias("balance"),
    )
