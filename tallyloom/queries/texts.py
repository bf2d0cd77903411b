"""Queries of the scalar functions: texts, days, numbers, nested values, retrieval and extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import dates as T
from tallyloom.functions import text as X
from tallyloom.operators import extract as E
from tallyloom.operators import payloads as P
from tallyloom.operators import retrieval as S
from tallyloom.queries.registry import Registry
from tallyloom.sources.records import Records

R = Registry()
N = lambda: F.count(F.lit(1))
AS_OF = "2026-05-31"

# Texts


@R.add("x1_normalised", r"SELECT id, trim(regexp_replace(lower(input_text), '\s+', ' ', 'g')) AS norm FROM x_activity")
def _(r: Records) -> DataFrame:
    return r.activity.select("id", X.normalise("input_text").alias("norm"))


_FORM = "trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g'))"


@R.add("x2_search_form", f"SELECT id, {_FORM} AS form FROM x_expenses")
def _(r: Records) -> DataFrame:
    return r.expenses.select("id", X.search_form("description").alias("form"))


_STOP = "(" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")"
_WORDS = "list_filter(string_split(trim(regexp_replace(lower(input_text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN " + _STOP + " AND (length(w) >= 3 OR regexp_matches(w, '[0-9]')))"


@R.add("x3_search_words", f"SELECT id, array_to_string({_WORDS}, ' ') AS words FROM x_activity")
def _(r: Records) -> DataFrame:
    return r.activity.select("id", F.array_join(X.search_words("input_text"), " ").alias("words"))


@R.add("x4_word_sets", "SELECT id, len(list_filter(list_distinct(regexp_split_to_array(lower(description), '[\\s!-/:-@\\[-`{-~]+')), lambda w: w <> '')) AS n_words FROM x_expenses")
def _(r: Records) -> DataFrame:
    return r.expenses.select("id", F.size(X.word_set("description")).cast("long").alias("n_words"))


_TRI = f"CASE WHEN length({_FORM}) = 0 THEN [] WHEN length({_FORM}) <= 3 THEN [{_FORM}] ELSE list_distinct(list_transform(range(1, length({_FORM}) - 1), lambda i: substr({_FORM}, i, 3))) END"


@R.add("x5_trigrams", f"SELECT id, array_to_string(list_sort({_TRI}), '|') AS pieces FROM x_expenses")
def _(r: Records) -> DataFrame:
    return r.expenses.select("id", F.array_join(F.array_sort(X.trigrams("description")), "|").alias("pieces"))


@R.add("x6_first_upper", "SELECT id, upper(substr(name, 1, 1)) || lower(substr(name, 2)) AS shown FROM x_persons")
def _(r: Records) -> DataFrame:
    return r.persons.select("id", X.first_upper("name").alias("shown"))


@R.add("x7_month_and_head", "SELECT id, substr(event_day, 1, 7) AS month, substr(content, 1, 40) AS head FROM x_notes")
def _(r: Records) -> DataFrame:
    return r.notes.select("id", F.substring("event_day", 1, 7).alias("month"), F.substring("content", 1, 40).alias("head"))


_APART = r"regexp_replace(regexp_replace(input, '([0-9]),([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9]),([0-9])', '\1' || chr(1) || '\2', 'g')"


@R.add(
    "x8_items",
    rf"""WITH p AS (SELECT id, list_filter(list_transform(regexp_split_to_array({_APART}, '[,;|&\n]|\s+and\s+'), lambda x: trim(regexp_replace(replace(x, chr(1), ','), '^\s*(?:[-*•]|[0-9]+[.)])\s+', ''))), lambda x: x <> '') AS items FROM x_writes)
    SELECT id, cast(i - 1 AS INTEGER) AS pos, items[i] AS item FROM (SELECT id, items, unnest(generate_series(1, len(items))) AS i FROM p)""",
)
def _(r: Records) -> DataFrame:
    return r.writes.select("id", F.posexplode(X.split_items("input")).alias("pos", "item"))


_X9 = rf"regexp_replace(regexp_replace(said, '^\s*(?:(?:{E.FRAME_BEFORE})\s+)+', '', 'i'), '(?:\s+(?:{E.FRAME_AFTER}))+\s*$', '', 'i')"
_MONEY_WORD = rf"'(^|\W)(?:{E.CURRENCY_WORDS})(\W|$)', '\1 \2', 'gi'"


@R.add(
    "x9_framing_stripped",
    rf"""WITH t AS (SELECT id, CASE id % 3 WHEN 0 THEN 'spent on ' || description || ' ku vaanginen' WHEN 1 THEN 'bought ' || description || ' for rs. ' ELSE description END AS said FROM x_expenses)
    SELECT id, trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace({_X9}, {_MONEY_WORD}), {_MONEY_WORD}), '\s+', ' ', 'g')), '^[,:;.\-]+|[,:;.\-]+$', '', 'g')) AS body FROM t""",
)
def _(r: Records) -> DataFrame:
    d, k = F.col("description"), F.col("id") % 3
    said = F.when(k == 0, F.concat(F.lit("spent on "), d, F.lit(" ku vaanginen"))).when(k == 1, F.concat(F.lit("bought "), d, F.lit(" for rs. "))).otherwise(d)
    return r.of("expenses", "id", "description").select("id", said.alias("said")).select("id", E.unframed("said").alias("body"))


_TAGGED = r"CASE id % 3 WHEN 0 THEN 'ask: ' || input_text WHEN 1 THEN input_text ELSE 'Note: ' || input_text END"
_PREFIX = rf"'^\s*((?:(?:{E.TAGS})\s*[:-]\s*)+)'"


@R.add(
    "x10_tags",
    rf"""WITH t AS (SELECT id, {_TAGGED} AS x FROM x_activity), p AS (SELECT id, x, regexp_extract_all(regexp_extract(lower(x), {_PREFIX}, 1), '({E.TAGS})') AS every FROM t),
    u AS (SELECT id, x, list_filter(every, lambda t, i: list_position(every, t) = i) AS tags FROM p)
    SELECT id, array_to_string(tags, ',') AS tags, trim(regexp_replace(x, {_PREFIX}, '', 'i')) AS body, CASE WHEN len(tags) = 0 THEN 'none' WHEN list_contains(tags, 'ask') AND len(tags) <= 2 THEN 'ask' WHEN NOT list_contains(tags, 'ask') AND len(tags) = 1 THEN 'write' ELSE 'unclear' END AS kind FROM u""",
)
def _(r: Records) -> DataFrame:
    t, k = F.col("input_text"), F.col("id") % 3
    said = F.when(k == 0, F.concat(F.lit("ask: "), t)).when(k == 1, t).otherwise(F.concat(F.lit("Note: "), t))
    rows = r.of("activity", "id", "input_text").select("id", said.alias("said"))
    return rows.select("id", *[c.alias(n) for n, c in E.tagged("said").items()])


@R.add("x11_pieces")
def _(r: Records) -> DataFrame:
    words = r.expenses.select(F.explode(X.search_words("description")).alias("w")).groupBy("w").agg(N().alias("n"))
    return r.expenses.select("id", E.pieces(F.col("description"), words, length=24).alias("pieces"))


@R.add(
    "x12_json_objects",
    r"""WITH m AS (SELECT id, coalesce(metadata_json, '') AS m FROM x_notes) SELECT id, CASE WHEN id % 3 = 2 THEN '{"lane":"note","records":[{"id":' || id || '}]}' ELSE nullif(regexp_extract(m, '(\{.*\})', 1, 's'), '') END AS object FROM m""",
)
def _(r: Records) -> DataFrame:
    m, k = F.coalesce("metadata_json", F.lit("")), F.col("id") % 3
    broken = F.concat(F.lit('Sure: {"lane":"note","records":{"id":'), F.col("id").cast("string"), F.lit("}]} done"))
    answer = F.when(k == 0, F.concat(F.lit("<think>{maybe}\n</think>Sure: "), m, F.lit(" done"))).when(k == 1, F.concat(F.lit("```json\n"), m, F.lit("\n```\nAnything else?"))).otherwise(broken)
    return r.of("notes", "id", "metadata_json").select("id", answer.alias("answer")).select("id", P.json_object("answer").alias("object"))


_REC = "{" + ", ".join(f"'{k}': r.{k}" for k in ("action", "amount", "date", "description", "group", "item_text", "note", "person_text", "quantity_text", "text", "unit", "unit_text", "value")) + "}"


@R.add("x13_canonical_keys", f"SELECT id, sha256(cast(to_json({{'disposition': output.disposition, 'lane': output.lane, 'reason_code': output.reason_code, 'records': list_transform(output.records, lambda r: {_REC}), 'task': output.task}}) AS VARCHAR)) AS key FROM x_writes")
def _(r: Records) -> DataFrame:
    from tallyloom.operators.dataset import canonical_key

    return r.writes.select("id", canonical_key(r.writes, "output").alias("key"))


@R.add("x14_noisy_inputs")
def _(r: Records) -> DataFrame:
    return r.writes.select("id", E.noisy(F.col("input"), F.col("id"), 11).alias("noisy"))


# Numbers

_AMT = r"regexp_replace(regexp_replace(lower(trim(quantity)), '^(?:rs\.?|inr|₹|\$|€)\s*', ''), '\s*(?:rs\.?|rupees|/-|₹|€|\$)$', '')"


@R.add(
    "n1_amounts",
    r"""WITH q AS (SELECT id, CASE id % 4 WHEN 0 THEN 'Rs ' || cast(cast(floor(amount) AS BIGINT) AS VARCHAR) WHEN 1 THEN cast(cast(floor(amount) AS BIGINT) AS VARCHAR) || 'k' WHEN 2 THEN '₹1,2' || cast(cast(floor(abs(amount)) AS BIGINT) % 10 AS VARCHAR) || '0/-' ELSE '2.5 lakh' END AS quantity FROM x_expenses),
    t AS (SELECT id, quantity, """ + _AMT + r""" AS t FROM q)
    SELECT id, try_cast(replace(regexp_extract(t, '^(\d[\d,]*(?:\.\d+)?)\s*(k|l|lakh|lakhs|cr|crore|crores)?$', 1), ',', '') AS DOUBLE) * CASE regexp_extract(t, '^(\d[\d,]*(?:\.\d+)?)\s*(k|l|lakh|lakhs|cr|crore|crores)?$', 2) WHEN 'k' THEN 1e3 WHEN 'l' THEN 1e5 WHEN 'lakh' THEN 1e5 WHEN 'crore' THEN 1e7 ELSE 1.0 END AS amount FROM t""",
)
def _(r: Records) -> DataFrame:
    whole = F.floor("amount").cast("string")
    text = F.when(F.col("id") % 4 == 0, F.concat(F.lit("Rs "), whole)).when(F.col("id") % 4 == 1, F.concat(whole, F.lit("k")))
    text = text.when(F.col("id") % 4 == 2, F.concat(F.lit("₹1,2"), (F.floor(F.abs("amount")) % 10).cast("string"), F.lit("0/-"))).otherwise("2.5 lakh")
    return r.expenses.select("id", X.amount(text).alias("amount"))


@R.add("n2_whole_amounts", "SELECT id, amount = trunc(amount) AS is_whole, CASE WHEN amount = trunc(amount) THEN cast(cast(floor(amount) AS BIGINT) AS VARCHAR) END AS shown FROM x_expenses")
def _(r: Records) -> DataFrame:
    whole = F.col("amount") == F.col("amount").cast("long")
    return r.expenses.select("id", whole.alias("is_whole"), F.when(whole, F.col("amount").cast("long").cast("string")).alias("shown"))


_DOT = "list_sum(list_transform(list_zip(embedding, q), lambda p: cast(p[1] AS DOUBLE) * cast(p[2] AS DOUBLE)))"
_Q = "(SELECT embedding FROM x_vectors ORDER BY id LIMIT 1)"


@R.add(
    "n3_cosines",
    f"""WITH v AS (SELECT id, list_transform(embedding, lambda x: cast(x AS DOUBLE)) AS e FROM x_vectors), one AS (SELECT e AS q FROM v ORDER BY id LIMIT 1)
    SELECT id, round(CASE WHEN list_sum(list_transform(e, lambda x: x * x)) = 0 THEN 0 ELSE list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))) END, 6) AS score FROM v, one""",
)
def _(r: Records) -> DataFrame:
    q = r.note_vectors.orderBy("id").limit(1).select("embedding").first()
    lit = F.array(*[F.lit(float(x)) for x in (q[0] if q else [])])
    return r.note_vectors.select("id", F.round(X.cosine(F.col("embedding"), lit), 6).alias("score"))


@R.add("n4_jaccard", """WITH p AS (SELECT id, list_distinct(string_split(lower(input), ' ')) AS a, list_distinct(string_split(lower(coalesce(output.records[1].description, output.records[1].item_text, output.records[1].text, '')), ' ')) AS b FROM x_writes)
    SELECT id, round(len(list_intersect(a, b)) / cast(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS overlap FROM p""")
def _(r: Records) -> DataFrame:
    rec = F.col("output.records")[0]
    other = F.coalesce(rec["description"], rec["item_text"], rec["text"], F.lit(""))
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    return r.writes.select("id", F.round(X.jaccard(words(F.col("input")), words(other)), 6).alias("overlap"))


@R.add("n5_percentages", "SELECT kind, round(100.0 * count(*) FILTER (WHERE metadata_json IS NOT NULL) / count(*), 2) AS pct FROM x_activity GROUP BY kind")
def _(r: Records) -> DataFrame:
    return r.activity.groupBy("kind").agg(F.round(100.0 * F.count("metadata_json") / N(), 2).alias("pct"))


@R.add("n6_clamped", "SELECT id, least(1000.0, greatest(0.0, amount)) AS amount FROM x_expenses")
def _(r: Records) -> DataFrame:
    return r.expenses.select("id", X.clamp(F.col("amount"), 0.0, 1000.0).alias("amount"))


# Days

_A = "cast(anchor_date AS DATE)"
_OUT = lambda *names: [F.date_format(n, "yyyy-MM-dd").alias(n) for n in names]


@R.add(
    "d1_calendar_windows",
    f"""SELECT id, strftime(date_trunc('week', {_A}), '%Y-%m-%d') AS week_start, strftime(date_trunc('month', {_A} - INTERVAL 1 MONTH), '%Y-%m-%d') AS last_month, strftime(last_day({_A}), '%Y-%m-%d') AS month_end, strftime(date_trunc('week', {_A}) + INTERVAL 5 DAY, '%Y-%m-%d') AS weekend FROM x_writes WHERE anchor_date IS NOT NULL""",
)
def _(r: Records) -> DataFrame:
    d = F.col("anchor_date").cast("date")
    rows = r.writes.where("anchor_date IS NOT NULL").select("id", T.week_start(d).alias("week_start"), T.month_start(d, -1).alias("last_month"), F.last_day(d).alias("month_end"), F.date_add(T.week_start(d), 5).alias("weekend"))
    return rows.select("id", *_OUT("week_start", "last_month", "month_end", "weekend"))


@R.add(
    "d2_weekdays",
    f"""SELECT id, strftime({_A} + cast((4 - (isodow({_A}) - 1) + 6) % 7 + 1 AS INTEGER), '%Y-%m-%d') AS next_friday, strftime({_A} - cast(((isodow({_A}) - 1) - 4 + 6) % 7 + 1 AS INTEGER), '%Y-%m-%d') AS last_friday, strftime({_A} + cast((4 - (isodow({_A}) - 1) + 7) % 7 AS INTEGER), '%Y-%m-%d') AS this_friday FROM x_writes WHERE anchor_date IS NOT NULL""",
)
def _(r: Records) -> DataFrame:
    d = F.col("anchor_date").cast("date")
    rows = r.writes.where("anchor_date IS NOT NULL").select("id", T.next_weekday(d, 4).alias("next_friday"), T.last_weekday(d, 4).alias("last_friday"), T.this_weekday(d, 4).alias("this_friday"))
    return rows.select("id", *_OUT("next_friday", "last_friday", "this_friday"))


def _phrases(r: Records, names: tuple[str, ...]) -> DataFrame:
    dim = T.phrase_dimension(r.writes, "anchor_date").where(F.col("phrase").isin(*names))
    return dim.select(F.date_format("anchor", "yyyy-MM-dd").alias("anchor"), "phrase", *_OUT("start_day", "end_day"))


def _phrase_sql(parts: list[tuple[str, str, str]]) -> str:
    rows = " UNION ALL ".join(f"SELECT a, '{p}' AS phrase, {s} AS s, {e} AS e FROM d" for p, s, e in parts)
    return f"WITH d AS (SELECT DISTINCT {_A} AS a FROM x_writes WHERE anchor_date IS NOT NULL), p AS ({rows}) SELECT strftime(a, '%Y-%m-%d') AS anchor, phrase, strftime(s, '%Y-%m-%d') AS start_day, strftime(e, '%Y-%m-%d') AS end_day FROM p"


_M = "date_trunc('month', a)"
_D4 = [("first week of the month", _M, f"{_M} + INTERVAL 6 DAY"), ("third week of the month", f"{_M} + INTERVAL 14 DAY", f"{_M} + INTERVAL 20 DAY"), ("fourth week of the month", f"{_M} + INTERVAL 21 DAY", "last_day(a)"), ("second half of the month", f"{_M} + INTERVAL 15 DAY", "last_day(a)")]
_RECENT = lambda m: f"CASE WHEN make_date(year(a), {m}, 1) <= a THEN make_date(year(a), {m}, 1) ELSE make_date(year(a) - 1, {m}, 1) END"
_D5 = [("january", _RECENT(1), f"last_day({_RECENT(1)})"), ("november", _RECENT(11), f"last_day({_RECENT(11)})")]
_FY = "make_date(year(a) - CASE WHEN month(a) < 4 THEN 1 ELSE 0 END, 4, 1)"
_D6 = [("last fortnight", "a - INTERVAL 13 DAY", "a"), ("quarter to date", "date_trunc('quarter', a)", "a"), ("last quarter", "date_trunc('quarter', a) - INTERVAL 3 MONTH", "date_trunc('quarter', a) - INTERVAL 1 DAY"), ("this fiscal year", _FY, f"{_FY} + INTERVAL 12 MONTH - INTERVAL 1 DAY"), ("business week", "date_trunc('week', a)", "date_trunc('week', a) + INTERVAL 4 DAY")]

for _name, _parts in (("d4_month_weeks", _D4), ("d5_bare_months", _D5), ("d6_windows", _D6)):
    R.add(_name, _phrase_sql(_parts))(lambda r, names=tuple(p for p, _, _ in _parts): _phrases(r, names))


def _every_phrase() -> list[tuple[str, str, str]]:
    """Each phrase of the dimension in SQL over the day ``a``."""
    one = lambda p, e: (p, e, e)
    out = [one("today", "a"), one("yesterday", "a - INTERVAL 1 DAY"), one("day before yesterday", "a - INTERVAL 2 DAY"), one("tomorrow", "a + INTERVAL 1 DAY")]
    week, quarter = "date_trunc('week', a)", "date_trunc('quarter', a)"
    for p, k in (("last", -1), ("this", 0), ("next", 1)):
        month = f"date_trunc('month', a + INTERVAL ({k}) MONTH)"
        out += [(f"{p} week", f"{week} + INTERVAL ({7 * k}) DAY", f"{week} + INTERVAL ({7 * k + 6}) DAY"), (f"{p} weekend", f"{week} + INTERVAL ({7 * k + 5}) DAY", f"{week} + INTERVAL ({7 * k + 6}) DAY")]
        out += [(f"{p} month", month, f"last_day({month})"), (f"{p} year", f"make_date(year(a) + {k}, 1, 1)", f"make_date(year(a) + {k}, 12, 31)")]
    out += [("month to date", _M, "a"), ("year to date", "date_trunc('year', a)", "a"), ("this quarter", quarter, f"{quarter} + INTERVAL 3 MONTH - INTERVAL 1 DAY"), ("last fiscal year", f"{_FY} - INTERVAL 12 MONTH", f"{_FY} - INTERVAL 1 DAY")]
    out += [("second week of the month", f"{_M} + INTERVAL 7 DAY", f"{_M} + INTERVAL 13 DAY"), ("first half of the month", _M, f"{_M} + INTERVAL 14 DAY"), *_D4, *_D6]
    for i, name in enumerate(T.WEEKDAYS):
        own = "(isodow(a) - 1)"
        out += [one(f"next {name}", f"a + cast(({i} - {own} + 6) % 7 + 1 AS INTEGER)"), one(f"last {name}", f"a - cast(({own} - {i} + 6) % 7 + 1 AS INTEGER)"), one(f"this {name}", f"a + cast(({i} - {own} + 7) % 7 AS INTEGER)")]
    return out + [(name, _RECENT(i), f"last_day({_RECENT(i)})") for i, name in enumerate(T.MONTHS, 1)]


def _found_sql(rows: str) -> str:
    """Rows (id, x, a) with the first phrase of x and its days."""
    parts = _every_phrase()
    assert {p for p, _, _ in parts} == set(T.phrase_names()), {p for p, _, _ in parts} ^ set(T.phrase_names())
    number = "coalesce(try_cast(w AS INTEGER), list_position([" + ", ".join(f"'{n}'" for n in T.NUMBERS) + "], w))"
    pick = lambda i: "CASE phrase " + " ".join(f"WHEN '{p[0]}' THEN cast({p[i]} AS DATE)" for p in parts) + " END"
    pattern = "(?s)^(.*?)(^|[^a-z0-9])(" + "|".join([*T.COUNTED, *T.phrase_names()]) + ")($|[^a-z0-9].*$)"
    return f"""f0 AS (SELECT id, a, regexp_extract(lower(x), '{pattern}', ['p', 'q', 'phrase', 'r']) AS g FROM ({rows}) WHERE a IS NOT NULL),
    f1 AS (SELECT id, a, g.phrase AS phrase, trim(regexp_replace(g.p || g.q || g.r, '\\s+', ' ', 'g')) AS residual, regexp_extract(g.phrase, '(\\d+|{"|".join(T.NUMBERS)}) day', 1) AS w FROM f0 WHERE g.phrase <> ''),
    f2 AS (SELECT *, CASE WHEN w <> '' THEN {number} END AS n FROM f1),
    found AS (SELECT id, phrase, residual, strftime(CASE WHEN n IS NULL THEN {pick(1)} WHEN phrase LIKE '%ago' THEN a - cast(n AS INTEGER) ELSE a - cast(n - 1 AS INTEGER) END, '%Y-%m-%d') AS start_day,
        strftime(CASE WHEN n IS NULL THEN {pick(2)} WHEN phrase LIKE '%ago' THEN a - cast(n AS INTEGER) ELSE a END, '%Y-%m-%d') AS end_day FROM f2)"""


@R.add("d3_d7_phrases_found", "WITH " + _found_sql("SELECT id, input AS x, try_cast(substr(anchor_date, 1, 10) AS DATE) AS a FROM x_writes") + " SELECT id, phrase, start_day, end_day, residual FROM found")
def _(r: Records) -> DataFrame:
    found = T.find_phrases(r.writes.select("id", "input", "anchor_date"), "input", "anchor_date")
    return found.select("id", "phrase", *_OUT("start_day", "end_day"), "residual")


_COUNTS = "CASE id % 3 WHEN 0 THEN 'total of the last ' || (id % 400) || ' days please' WHEN 1 THEN 'paid ' || (id % 9 + 1) || ' days ago' ELSE 'seen seven days ago in may' END"


@R.add("d3_d6_counted_days", "WITH " + _found_sql(f"SELECT id, {_COUNTS} AS x, cast(event_day AS DATE) AS a FROM x_weights WHERE event_day IS NOT NULL") + " SELECT id, phrase, start_day, end_day, residual FROM found")
def _(r: Records) -> DataFrame:
    i = F.col("id")
    n = lambda c: c.cast("string")
    said = F.when(i % 3 == 0, F.concat(F.lit("total of the last "), n(i % 400), F.lit(" days please"))).when(i % 3 == 1, F.concat(F.lit("paid "), n(i % 9 + 1), F.lit(" days ago"))).otherwise("seen seven days ago in may")
    rows = r.of("weights", "id", "event_day").select("id", said.alias("said"), "event_day")
    return T.find_phrases(rows, "said", "event_day").select("id", "phrase", *_OUT("start_day", "end_day"), "residual")


@R.add(
    "d8_absolute_days",
    r"""WITH t AS (SELECT id, CASE id % 4 WHEN 0 THEN strftime(cast(event_day AS DATE), '%d-%m-%Y') WHEN 1 THEN strftime(cast(event_day AS DATE), '%-d %b %Y') WHEN 2 THEN strftime(cast(event_day AS DATE), '%b %-d') ELSE '31-02-2025' END AS said, event_day FROM x_weights)
    SELECT id, CASE WHEN id % 4 = 2 THEN strftime(try_cast('2025' || substr(event_day, 5) AS DATE), '%Y-%m-%d') WHEN id % 4 = 3 THEN NULL ELSE event_day END AS day FROM t""",
)
def _(r: Records) -> DataFrame:
    d = F.col("event_day").cast("date")
    said = F.when(F.col("id") % 4 == 0, F.date_format(d, "dd-MM-yyyy")).when(F.col("id") % 4 == 1, F.date_format(d, "d MMM yyyy")).when(F.col("id") % 4 == 2, F.date_format(d, "MMM d")).otherwise("31-02-2025")
    return r.weights.select("id", F.date_format(T.absolute_day(said, F.lit("2025-06-15").cast("date")), "yyyy-MM-dd").alias("day"))


@R.add("d9_default_windows", f"SELECT person, count(*) AS n_rows FROM x_weights WHERE event_day BETWEEN strftime(DATE '{AS_OF}' - INTERVAL 6 MONTH, '%Y-%m-%d') AND '{AS_OF}' GROUP BY person")
def _(r: Records) -> DataFrame:
    first = F.date_format(F.add_months(F.lit(AS_OF).cast("date"), -6), "yyyy-MM-dd")
    return r.weights.where((F.col("event_day") >= first) & (F.col("event_day") <= AS_OF)).groupBy("person").agg(N().alias("n_rows"))


@R.add("d10_relative_months", f"SELECT CASE substr(event_day, 1, 7) WHEN strftime(DATE '{AS_OF}', '%Y-%m') THEN 'this_month' ELSE 'last_month' END AS month_name, count(*) AS n_rows FROM x_expenses WHERE substr(event_day, 1, 7) IN (strftime(DATE '{AS_OF}', '%Y-%m'), strftime(DATE '{AS_OF}' - INTERVAL 1 MONTH, '%Y-%m')) GROUP BY 1")
def _(r: Records) -> DataFrame:
    d = F.lit(AS_OF).cast("date")
    this, last = F.date_format(d, "yyyy-MM"), F.date_format(F.add_months(d, -1), "yyyy-MM")
    m = F.substring("event_day", 1, 7)
    return r.expenses.withColumn("month_name", F.when(m == this, "this_month").when(m == last, "last_month")).where("month_name IS NOT NULL").groupBy("month_name").agg(N().alias("n_rows"))


@R.add("d9_default_months", "SELECT cast(coalesce(sum(cast(amount AS DECIMAL(30,4))), 0) AS DOUBLE) AS total FROM x_expenses WHERE event_day BETWEEN '2026-05-01' AND '2026-05-31'")
def _(r: Records) -> DataFrame:
    first = F.trunc(F.lit(AS_OF).cast("date"), "MM")
    rows = r.of("expenses", "amount", "event_day").where(F.col("event_day").between(F.date_format(first, "yyyy-MM-dd"), F.date_format(F.last_day(first), "yyyy-MM-dd")))
    return rows.agg(F.coalesce(F.sum(F.col("amount").cast("decimal(30,4)")), F.lit(0)).cast("double").alias("total"))


@R.add("d11_days_in_texts", "WITH " + _found_sql("SELECT id, input_text AS x, try_cast(substr(at_time, 1, 10) AS DATE) AS a FROM x_activity") + " SELECT id, phrase, start_day, residual FROM found")
def _(r: Records) -> DataFrame:
    found = T.find_phrases(r.of("activity", "id", "input_text", "at"), "input_text", "at")
    return found.select("id", "phrase", *_OUT("start_day"), "residual")


@R.add("d12_days_since", f"SELECT person, date_diff('day', cast(max(event_day) AS DATE), DATE '{AS_OF}') AS days FROM x_weights GROUP BY person")
def _(r: Records) -> DataFrame:
    return r.weights.groupBy("person").agg(F.date_diff(F.lit(AS_OF).cast("date"), F.max("event_day").cast("date")).cast("long").alias("days"))


# Nested values


@R.add("m1_lane_records", "SELECT id, lane, amount, description, item_text, quantity_text, unit_text, text, person_text, value, action, date FROM x_lanes")
def _(r: Records) -> DataFrame:
    fields = ("amount", "description", "item_text", "quantity_text", "unit_text", "text", "person_text", "value", "action", "date")
    rows = [P.lane_rows(r.writes, lane).select((F.col("id") * 100 + F.col("pos")).alias("id"), F.lit(lane).alias("lane"), *[F.col(f"r.{f}").alias(f) for f in fields]) for lane in P.LANES]
    return reduce(DataFrame.unionByName, rows)


@R.add("m2_metadata_entries", "WITH j AS (SELECT id, CASE WHEN json_valid(metadata_json) THEN metadata_json END AS m FROM x_notes) SELECT id, key, json_extract_string(m, '$.' || key) AS value FROM (SELECT id, m, unnest(json_keys(m)) AS key FROM j WHERE m IS NOT NULL) WHERE key <> 'confidence'")
def _(r: Records) -> DataFrame:
    return P.flat_rows(r.notes, "metadata_json", ("confidence",))


@R.add("m3_text_of_record", "SELECT id, coalesce(description, item_text, text, person_text) AS said FROM x_lanes")
def _(r: Records) -> DataFrame:
    rows = r.writes.select("id", F.posexplode("output.records").alias("pos", "r"))
    return rows.select((F.col("id") * 100 + F.col("pos")).alias("id"), F.coalesce("r.description", "r.item_text", "r.text", "r.person_text").alias("said"))


_KNOWN = "('expense', 'buy', 'todo', 'weight', 'ledger', 'note')"


@R.add(
    "m4_questions_coerced",
    f"""WITH c AS (SELECT id, CASE WHEN context.domain IN {_KNOWN} THEN context.domain WHEN context.intent IN {_KNOWN} THEN context.intent ELSE 'note' END AS domain, context.intent AS i, nullif(trim(context.query_text), '') AS query_text FROM x_writes2)
    SELECT id, domain, CASE WHEN i IS NULL OR i IN {_KNOWN} THEN CASE domain WHEN 'expense' THEN 'total' WHEN 'weight' THEN 'latest' WHEN 'ledger' THEN 'balance' WHEN 'note' THEN 'search' ELSE 'list' END ELSE i END AS intent, query_text FROM c""".replace("x_writes2", "(SELECT DISTINCT ON (id) id, context FROM parse_write) WHERE context IS NOT NULL"),
)
def _(r: Records) -> DataFrame:
    w = r.raw("parse_write").select("id", "context").dropDuplicates(["id"]).where("context IS NOT NULL")
    return w.select("id", P.coerce_query(F.col("context.domain"), F.col("context.intent"), F.col("context.query_text")).alias("q")).select("id", "q.*")


@R.add("m5_records_compared", """WITH l AS (SELECT id // 100 AS pid, lane, amount FROM x_lanes WHERE lane = 'expense') SELECT pid AS id, count(*) AS n_records, round(sum(coalesce(amount, 0)), 4) AS total FROM l GROUP BY pid""")
def _(r: Records) -> DataFrame:
    w = r.writes.where("output.lane = 'expense'")
    total = F.aggregate("output.records", F.lit(0.0), lambda s, x: s + F.coalesce(x["amount"], F.lit(0.0)))
    return w.select("id", F.size("output.records").cast("long").alias("n_records"), F.round(total, 4).alias("total")).where("n_records > 0")


@R.add("m6_changed_keys", "WITH j AS (SELECT id, CASE WHEN json_valid(metadata_json) THEN metadata_json END AS m FROM x_notes) SELECT id, CASE WHEN json_extract_string(m, '$.rule') IS NOT NULL THEN 'checked,rule' ELSE 'checked' END AS changed FROM j WHERE m IS NOT NULL")
def _(r: Records) -> DataFrame:
    from tallyloom.operators.evalkit import changed_keys

    m = F.from_json("metadata_json", "map<string,string>")
    pair = r.notes.select("id", m.alias("a"), F.map_concat(F.map_filter(m, lambda k, v: k != "rule"), F.create_map(F.lit("checked"), F.lit("yes"))).alias("b")).where("a IS NOT NULL")
    return pair.select("id", F.array_join(changed_keys(F.col("a"), F.col("b")), ",").alias("changed"))


@R.add("m7_sets_as_text", "SELECT person, string_agg(DISTINCT direction, ',' ORDER BY direction) AS directions FROM x_ledger GROUP BY person")
def _(r: Records) -> DataFrame:
    return r.ledger.groupBy("person").agg(F.concat_ws(",", F.array_sort(F.collect_set("direction"))).alias("directions"))


_FORALL = "coalesce(list_bool_and(list_transform(output.records, lambda r: {0})), true)"
_FIELDS = f"""CASE output.lane WHEN 'expense' THEN {_FORALL.format("r.description IS NOT NULL AND r.amount IS NOT NULL")} WHEN 'buy' THEN {_FORALL.format("r.item_text IS NOT NULL")}
    WHEN 'todo' THEN {_FORALL.format("r.text IS NOT NULL")} WHEN 'weight' THEN {_FORALL.format("r.person_text IS NOT NULL AND r.value IS NOT NULL")} WHEN 'ledger' THEN {_FORALL.format("r.person_text IS NOT NULL AND r.action IS NOT NULL")} ELSE true END"""


@R.add(
    "f14_payload_errors",
    f"""SELECT id, output.lane AS lane, CASE WHEN output.task IS DISTINCT FROM 'parse_write' THEN 'task' WHEN output.lane IS NULL OR output.lane NOT IN ('expense', 'buy', 'todo', 'weight', 'ledger') THEN 'lane'
    WHEN output.disposition IS NULL OR output.disposition NOT IN ('accept', 'confirm', 'reject') THEN 'disposition' WHEN output.disposition = 'accept' AND output.reason_code IS NOT NULL THEN 'reason without need'
    WHEN output.disposition <> 'accept' AND output.reason_code IS NULL THEN 'no reason' WHEN coalesce(len(output.records), 0) = 0 THEN 'no records' WHEN NOT {_FIELDS} THEN 'fields'
    WHEN NOT {_FORALL.format("r.date IS NULL OR regexp_full_match(r.date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(r.date AS DATE) IS NOT NULL")} THEN 'date' WHEN NOT {_FORALL.format("r.amount IS NULL OR r.amount > 0")} THEN 'amount'
    WHEN NOT {_FORALL.format("r.value IS NULL OR r.value > 0 AND r.value < 700")} THEN 'value' END AS error FROM x_writes""",
)
def _(r: Records) -> DataFrame:
    return r.writes.select("id", F.col("output.lane").alias("lane"), P.validate(F.col("output")).alias("error"))


@R.add("f14_payload_lenient", """SELECT id, CASE WHEN output.lane IS NULL OR output.lane NOT IN ('expense', 'buy', 'todo', 'weight', 'ledger') THEN 'lane' WHEN coalesce(len(output.records), 0) = 0 THEN 'no records' END AS error FROM x_writes""")
def _(r: Records) -> DataFrame:
    return r.writes.select("id", P.validate(F.col("output"), strict=False).alias("error"))


# Retrieval

QUERY = "renew the gas connection"
_VEC = lambda r: r.of("note_vectors", "id", "source_note_id", "embedding").select(F.col("source_note_id").alias("note_id"), F.col("embedding").alias("vec"))
#: The query set: every row whose id is divisible by 100, against all rows.
_ASKED = lambda rows: rows.where("id % 100 = 0")


@R.add("r1_lexical_parts")
def _(r: Records) -> DataFrame:
    parts = S.lexical_parts(r.of("notes", "id", "content"), QUERY)
    return parts.select("id", "phrase_hit", F.round("exact_recall", 6).alias("exact_recall"), F.round("fuzzy_recall", 6).alias("fuzzy_recall"), F.round("trigram", 6).alias("trigram"), F.round("lexical", 6).alias("lexical"))


@R.add("r2_edit_ratio", "SELECT id, round(1 - levenshtein(name, 'anbelu dorthoneksha') / cast(greatest(length(name), 19) AS DOUBLE), 6) AS ratio FROM x_persons")
def _(r: Records) -> DataFrame:
    return r.persons.select("id", F.round(S.edit_ratio(F.col("name"), F.lit("anbelu dorthoneksha")), 6).alias("ratio"))


@R.add("r3_blended")
def _(r: Records) -> DataFrame:
    parts = S.lexical_parts(r.of("notes", "id", "content"), QUERY)
    vec = S.constant(r.notes, X.letter_vector(F.lit(QUERY)))
    near = _VEC(r).select(F.col("note_id").alias("id"), X.cosine(F.col("vec"), vec).alias("c")).groupBy("id").agg(F.max("c").alias("semantic"))
    j = parts.join(near, "id", "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
    return j.select("id", F.round("lexical", 6).alias("lexical"), F.round("semantic", 6).alias("semantic"), F.round(S.blend(F.col("lexical"), F.col("semantic")), 6).alias("score"))


@R.add("r4_r5_search")
def _(r: Records) -> DataFrame:
    top = S.note_searches(r.notes, _VEC(r), _ASKED(r.notes), X.letter_vector, 5)
    return top.select("query_id", "id", F.round("score", 6).alias("score"), F.round("lexical", 6).alias("lexical"), F.round("semantic", 6).alias("semantic"), "confident")


_LETTERS = "[" + ", ".join(f"cast(length(t) - length(replace(t, '{c}', '')) AS DOUBLE)" for c in "abcdefghijklmnopqrstuvwxyz") + "]"


@R.add("r6_simple_search")
def _(r: Records) -> DataFrame:
    rows = S.simple_searches(r.notes, _VEC(r), _ASKED(r.notes), X.letter_vector, 10)
    return S.abstain(rows, 0.20, "query_id").select("query_id", "id", F.round("score", 6).alias("score"))


@R.add(
    "r7_vector_search",
    f"""WITH t AS (SELECT '{QUERY}' AS t), q AS (SELECT {_LETTERS} AS q FROM t), v AS (SELECT id, list_transform(embedding, lambda x: cast(x AS DOUBLE)) AS e FROM x_vectors WHERE domain = 'home'),
    s AS (SELECT id, round(coalesce(list_inner_product(e, q) / nullif(sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q)), 0), 0), 6) AS score FROM v, q)
    SELECT id, score FROM s WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 20""",
)
def _(r: Records) -> DataFrame:
    return S.vector_search(r.note_vectors, X.letter_vector(F.lit(QUERY)), 20, domain="home", least=0.3).select("id", "score")


@R.add(
    "r7_vector_searches",
    """WITH v AS (SELECT id, list_transform(embedding, lambda x: cast(x AS DOUBLE)) AS e FROM x_vectors), q AS (SELECT id AS query_id, e AS q FROM v WHERE id % 100 = 0),
    s AS (SELECT query_id, id, round(coalesce(list_inner_product(e, q) / nullif(sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q)), 0), 0), 6) AS score FROM v, q)
    SELECT query_id, id, score FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20""",
)
def _(r: Records) -> DataFrame:
    return S.vector_searches(r.note_vectors, _ASKED(r.note_vectors), 20, least=0.3)


@R.add("r8_recent_notes", "SELECT id, content FROM x_notes WHERE input_kind = 'note' AND structured_type = 'note' ORDER BY id DESC LIMIT 5")
def _(r: Records) -> DataFrame:
    return r.notes.where("input_kind = 'note' AND structured_type = 'note'").orderBy(F.desc("id")).limit(5).select("id", "content")


@R.add("r9_notes_with_several_vectors", "SELECT source_note_id AS id, count(*) AS n_vectors FROM x_vectors WHERE source_note_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(r: Records) -> DataFrame:
    return r.of("note_vectors", "id", "source_note_id").where("source_note_id IS NOT NULL").groupBy(F.col("source_note_id").alias("id")).agg(N().alias("n_vectors")).where("n_vectors > 1")


@R.add(
    "t16_letter_vectors",
    f"""WITH t AS (SELECT id, lower(content) AS t FROM x_notes), c AS (SELECT id, {_LETTERS} AS v FROM t), n AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM c)
    SELECT id, array_to_string(list_transform(v, lambda x: printf('%.5f', x / nullif(n, 0))), ' ') AS vec FROM n WHERE n > 0 AND id NOT IN (SELECT source_note_id FROM x_vectors WHERE source_note_id IS NOT NULL)""",
)
def _(r: Records) -> DataFrame:
    lacking = r.of("notes", "id", "content").join(r.repeated("note_vectors", "source_note_id").toDF("id"), "id", "left_anti")
    v = lacking.select("id", X.letter_vector("content").alias("v")).where("v IS NOT NULL")
    return v.select("id", F.array_join(F.transform("v", lambda x: F.format_string("%.5f", x)), " ").alias("vec"))


# Extraction


@R.add("e1_e5_records")
def _(r: Records) -> DataFrame:
    return E.extract(r.writes.select("id", "input", "anchor_date"))


def _extracted(r: Records, lane: str, what: str, *more) -> DataFrame:
    """What the extraction makes of the texts of a lane, to be held against the gold records."""
    texts = r.writes.where(F.col("output.lane") == lane)
    rows = E.extract(texts.select("id", "input", "anchor_date"))
    return rows.groupBy("id").agg(F.first("lane").alias("lane"), F.count("pos").alias("n_records"), F.round(F.coalesce(F.sum(what), F.lit(0.0)), 2).alias("total"), F.max("date").alias("last_day"), *more)


_GOLD = "SELECT id, output.lane AS lane, len(output.records) AS n_records, round(coalesce(list_sum(list_transform(output.records, lambda r: r.{what})), 0), 2) AS total, list_max(list_transform(output.records, lambda r: r.date)) AS last_day{more} FROM x_writes WHERE output.lane = '{lane}'"


@R.add("e1_expense_gold", _GOLD.format(lane="expense", what="amount", more=""))
def _(r: Records) -> DataFrame:
    return _extracted(r, "expense", "amount")


@R.add("e4_weight_gold", _GOLD.format(lane="weight", what="value", more=""))
def _(r: Records) -> DataFrame:
    return _extracted(r, "weight", "value")


@R.add("e5_ledger_gold", _GOLD.format(lane="ledger", what="amount", more=", array_to_string(list_sort(list_transform(output.records, lambda r: r.action)), ',') AS actions"))
def _(r: Records) -> DataFrame:
    return _extracted(r, "ledger", "amount", F.array_join(F.array_sort(F.collect_list("action")), ",").alias("actions"))


@R.add("e1_e5_accuracy")
def _(r: Records) -> DataFrame:
    return E.accuracy(E.extract(r.writes.select("id", "input", "anchor_date")), r.writes)


_HAS = lambda p: rf"regexp_matches(t, '\b(?:{p})\b')"
_CASE = lambda rules, other: "CASE " + " ".join(f"WHEN {_HAS(p)} THEN '{v}'" for v, p in rules) + f" ELSE '{other}' END"


@R.add(
    "e7_questions",
    "WITH q AS (SELECT id, lower(input_text) AS t, at_time FROM x_activity WHERE kind = 'ask'), "
    + _found_sql("SELECT id, t AS x, try_cast(substr(at_time, 1, 10) AS DATE) AS a FROM q")
    + f" SELECT q.id, {_CASE(E.DOMAINS, 'expense')} AS domain, {_CASE(E.INTENTS, 'list')} AS intent, CASE WHEN {_HAS(E.SIDES[0][1])} THEN '{E.SIDES[0][0]}' WHEN {_HAS(E.SIDES[1][1])} THEN '{E.SIDES[1][0]}' END AS perspective, start_day, end_day FROM q LEFT JOIN found ON q.id = found.id",
)
def _(r: Records) -> DataFrame:
    asks = r.activity.where("kind = 'ask'").select("id", F.col("input_text").alias("text"), F.col("at").alias("asked_at"))
    return E.questions(asks)


_E8 = f"""WITH e AS (SELECT id, description, group_key AS g, trim(regexp_replace(lower(description), '\\s+', ' ', 'g')) AS d, {_WORDS.replace("input_text", "description")} AS ws FROM x_expenses),
    b1 AS (SELECT d, g FROM (SELECT d, g, count(*) AS n FROM e WHERE g IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY d ORDER BY n DESC, g) = 1),
    v AS (SELECT w, g, count(*) AS n FROM (SELECT unnest(list_distinct(ws)) AS w, g FROM e WHERE g IS NOT NULL) GROUP BY 1, 2), b2 AS (SELECT w, g FROM v QUALIFY row_number() OVER (PARTITION BY w ORDER BY n DESC, g) = 1),
    l AS (SELECT e.id, e.description, e.d, e.ws, b1.g AS exact FROM e LEFT JOIN b1 ON e.d = b1.d WHERE e.g IS NULL),
    o AS (SELECT id, unnest(list_distinct(ws)) AS w FROM l WHERE exact IS NULL), c AS (SELECT o.id, b2.g, count(*) AS n FROM o JOIN b2 ON o.w = b2.w GROUP BY 1, 2), b3 AS (SELECT id, g AS voted FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, g) = 1)
    SELECT l.id, description, coalesce(exact, voted) AS group_key, CASE WHEN exact IS NOT NULL THEN 'description' WHEN voted IS NOT NULL THEN 'words' END AS by FROM l LEFT JOIN b3 ON l.id = b3.id"""


@R.add("e8_inferred_groups", _E8)
def _(r: Records) -> DataFrame:
    return E.infer_groups(r.expenses)


@R.add("e9_e11_routes")
def _(r: Records) -> DataFrame:
    return E.routes(r.activity.select("id", F.col("input_text").alias("text")))


@R.add("e10_deals")
def _(r: Records) -> DataFrame:
    return E.deals(r.writes.select("id", "input"))


@R.add("e_table_function")
def _(r: Records) -> DataFrame:
    E.register(r.spark)
    r.writes.select("id", "input").createOrReplaceTempView("typed_inputs")
    return r.spark.sql("SELECT t.id, e.lane, e.pos, e.what, e.amount FROM typed_inputs t, LATERAL extract_records(t.input) e")


_ASKED_TEXT = "CASE WHEN id % 4 = 0 THEN 'ask: what about ' || input_text ELSE input_text END"


@R.add(
    "e12_follow_ups",
    r"WITH b AS (SELECT id, trim(regexp_replace(lower(" + _ASKED_TEXT + r"), '^\s*ask\s*[:-]\s*', '')) AS b FROM x_activity WHERE kind = 'ask') SELECT id, b <> '' AND NOT regexp_matches(b, '^(expense|buy|todo|weight|ledger|note)\s*:') AND (len(regexp_split_to_array(b, '\s+')) <= 4 OR "
    + " OR ".join(f"starts_with(b, '{w}')" for w in E.FOLLOW_UPS)
    + ") AS follow_up FROM b",
)
def _(r: Records) -> DataFrame:
    said = F.when(F.col("id") % 4 == 0, F.concat(F.lit("ask: what about "), "input_text")).otherwise(F.col("input_text"))
    return r.of("activity", "id", "input_text", "kind").where("kind = 'ask'").select("id", said.alias("said")).select("id", E.follows_up("said").alias("follow_up"))


QUERIES, SQL = R.queries, R.sql
