"""Day phrases anchored on a given day, as expressions and as a dimension table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def week_start(d: Column) -> Column:
    return F.trunc(d, "week").cast("date")


def month_start(d: Column, shift: int = 0) -> Column:
    return F.trunc(F.add_months(d, shift), "MM").cast("date")


def next_weekday(d: Column, i: int) -> Column:
    """The first such day after ``d`` (0 is Monday)."""
    return F.date_add(d, (F.lit(i) - F.weekday(d) + 6) % 7 + 1)


def last_weekday(d: Column, i: int) -> Column:
    """The last such day before ``d``."""
    return F.date_sub(d, (F.weekday(d) - F.lit(i) + 6) % 7 + 1)


def this_weekday(d: Column, i: int) -> Column:
    """Such a day, today or next."""
    return F.date_add(d, (F.lit(i) - F.weekday(d) + 7) % 7)


def recent_month(d: Column, month: int) -> Column:
    """Start of the month's latest occurrence that doesn't begin after ``d``."""
    own = F.make_date(F.year(d), F.lit(month), F.lit(1))
    return F.when(own <= d, own).otherwise(F.make_date(F.year(d) - 1, F.lit(month), F.lit(1)))


def quarter_start(d: Column, shift: int = 0) -> Column:
    return F.trunc(F.add_months(d, 3 * shift), "quarter").cast("date")


def fiscal_year_start(d: Column, shift: int = 0) -> Column:
    """Years that run from April to March."""
    y = F.year(d) - F.when(F.month(d) < 4, 1).otherwise(0) + shift
    return F.make_date(y, F.lit(4), F.lit(1))


def phrases(d: Column, months: str = "recent") -> list[tuple[str, Column, Column]]:
    """(phrase, first day, last day) of each known phrase, both inclusive. A bare month is its latest one that doesn't begin after the
    day (``recent``) or that of the day's own year (``own``)."""
    one = lambda p, day: (p, day, day)
    out = [one("today", d), one("yesterday", F.date_sub(d, 1)), one("day before yesterday", F.date_sub(d, 2)), one("tomorrow", F.date_add(d, 1))]
    w = week_start(d)
    for p, s in (("last", -7), ("this", 0), ("next", 7)):
        out.append((f"{p} week", F.date_add(w, s), F.date_add(w, s + 6)))
        out.append((f"{p} weekend", F.date_add(w, s + 5), F.date_add(w, s + 6)))
        m = month_start(d, s // 7)
        out.append((f"{p} month", m, F.last_day(m)))
        y = F.make_date(F.year(d) + s // 7, F.lit(1), F.lit(1))
        out.append((f"{p} year", y, F.date_sub(F.add_months(y, 12), 1)))
    out.append(("business week", w, F.date_add(w, 4)))
    out.append(("last fortnight", F.date_sub(d, 13), d))
    out += [("month to date", month_start(d), d), ("quarter to date", quarter_start(d), d), ("year to date", F.trunc(d, "YEAR").cast("date"), d)]
    q, lq, fy = quarter_start(d), quarter_start(d, -1), fiscal_year_start(d)
    out += [("this quarter", q, F.date_sub(F.add_months(q, 3), 1)), ("last quarter", lq, F.date_sub(q, 1))]
    out += [("this fiscal year", fy, F.date_sub(F.add_months(fy, 12), 1)), ("last fiscal year", F.add_months(fy, -12), F.date_sub(fy, 1))]
    m = month_start(d)
    for k, name in enumerate(("first", "second", "third", "fourth")):
        last = F.last_day(m) if k == 3 else F.date_add(m, 7 * k + 6)
        out.append((f"{name} week of the month", F.date_add(m, 7 * k), last))
    out += [("first half of the month", m, F.date_add(m, 14)), ("second half of the month", F.date_add(m, 15), F.last_day(m))]
    for i, name in enumerate(WEEKDAYS):
        out += [one(f"next {name}", next_weekday(d, i)), one(f"last {name}", last_weekday(d, i)), one(f"this {name}", this_weekday(d, i))]
    for i, name in enumerate(MONTHS, 1):
        s = recent_month(d, i) if months == "recent" else F.make_date(F.year(d), F.lit(i), F.lit(1))
        out.append((name, s, F.last_day(s)))
    return out


#: Numbers in words before "days". Fixed values.
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven")
_SOME = r"(?:\d{1,4}|" + "|".join(NUMBERS) + ")"
#: Phrases with a number of days, which need no row of the dimension.
COUNTED = (rf"last {_SOME} days", rf"past {_SOME} days", rf"{_SOME} days? ago")


def counted_days(phrase: Column, d: Column) -> tuple[Column, Column]:
    """First and last day of a phrase with any number of days; null for other phrases."""
    word = F.regexp_extract(phrase, rf"({_SOME}) day", 1)
    n = F.coalesce(word.try_cast("int"), F.nullif(F.array_position(F.array(*map(F.lit, NUMBERS)), word), F.lit(0)).cast("int"))
    ago = F.endswith(phrase, F.lit("ago"))
    return F.when(ago, F.date_sub(d, n)).otherwise(F.date_sub(d, n - 1)), F.when(n.isNotNull(), F.when(ago, F.date_sub(d, n)).otherwise(d))


def phrase_dimension(anchors: DataFrame, anchor: str, months: str = "recent") -> DataFrame:
    """anchor, phrase, start_day, end_day for every distinct anchor: one row per phrase, ready to be joined."""
    d = F.col("anchor")
    rows = F.array(*[F.struct(F.lit(p).alias("phrase"), s.alias("start_day"), e.alias("end_day")) for p, s, e in phrases(d, months)])
    days = anchors.select(F.try_to_date(F.substring(anchor, 1, 10), "yyyy-MM-dd").alias("anchor")).where("anchor IS NOT NULL").distinct()
    return days.select("anchor", F.explode(rows).alias("r")).select("anchor", "r.*")


def phrase_names() -> list[str]:
    """All known phrases, longer ones first."""
    months = MONTHS
    fixed = ["today", "yesterday", "day before yesterday", "tomorrow", "business week", "last fortnight", "month to date", "quarter to date", "year to date"]
    fixed += ["this quarter", "last quarter", "this fiscal year", "last fiscal year", "first half of the month", "second half of the month"]
    fixed += [f"{p} {w}" for p in ("last", "this", "next") for w in ("week", "weekend", "month", "year", *WEEKDAYS)]
    fixed += [f"{n} week of the month" for n in ("first", "second", "third", "fourth")]
    return sorted([*fixed, *months], key=lambda p: (-len(p), p))


def find_phrases(df: DataFrame, text: str, anchor: str, months: str = "recent") -> DataFrame:
    """Rows whose text has a known phrase, with phrase, start_day, end_day and the text without it (residual).

    Of several phrases the first in the text counts, of those that start together the longest; what is cut out is that match.
    Phrases with a number of days are worked out, the days of others come from the phrase dimension, joined on anchor and phrase;
    rows without a phrase or a day to anchor it on are left out.
    """
    t = F.lower(F.col(text))
    pattern = r"(?s)^(.*?)(?<![a-z0-9])(" + "|".join([*COUNTED, *phrase_names()]) + r")(?![a-z0-9])(.*)$"
    part = lambda i: F.regexp_extract(t, pattern, i)
    rows = df.withColumn("phrase", part(2)).where("phrase != ''").withColumn("residual", F.trim(F.regexp_replace(F.concat(part(1), part(3)), r"\s+", " ")))
    rows = rows.withColumn("anchor", F.try_to_date(F.substring(anchor, 1, 10), "yyyy-MM-dd")).where("anchor IS NOT NULL")
    dim = phrase_dimension(rows.select("anchor"), "anchor", months).withColumnsRenamed({"start_day": "_s", "end_day": "_e"})
    start, end = counted_days(F.col("phrase"), F.col("anchor"))
    out = rows.join(dim, ["anchor", "phrase"], "left").withColumn("start_day", F.coalesce("_s", start)).withColumn("end_day", F.coalesce("_e", end))
    return out.drop("_s", "_e")


def absolute_day(text: str | Column, anchor: Column) -> Column:
    """Day named by 'dd-mm-yyyy', 'dd/mm', 'yyyy-mm-dd', '15 jan 2026' or 'jan 15'; without a year the anchor's; null for no
    such day."""
    t = F.lower(F.trim(F.col(text) if isinstance(text, str) else text))
    year = F.year(anchor).cast("string")
    num = r"^(\d{1,2})[-/.](\d{1,2})(?:[-/.](\d{4}))?$"
    month = "(" + "|".join(m[:3] for m in MONTHS) + ")[a-z]*"
    front, back = rf"^(\d{{1,2}})(?:st|nd|rd|th)?\s+{month}\.?(?:,?\s+(\d{{4}}))?$", rf"^{month}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?$"

    def make(pattern: str, y: int, m: int, d: int, named: bool) -> Column:
        yy = F.coalesce(F.nullif(F.regexp_extract(t, pattern, y), F.lit("")), year)
        mm = F.regexp_extract(t, pattern, m)
        if named:
            mm = F.array_position(F.array(*[F.lit(x[:3]) for x in MONTHS]), mm).cast("string")
        text_day = F.concat_ws("-", yy, F.lpad(mm, 2, "0"), F.lpad(F.regexp_extract(t, pattern, d), 2, "0"))
        return F.when(F.regexp_like(t, F.lit(pattern)), F.try_to_date(text_day, "yyyy-MM-dd"))

    iso = F.when(F.regexp_like(t, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
    return F.coalesce(iso, make(num, 3, 2, 1, False), make(front, 3, 2, 1, True), make(back, 3, 1, 2, True))
