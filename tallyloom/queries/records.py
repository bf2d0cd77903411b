"""Queries over the project's own records: filters, aggregates, latest rows, joins, sets and sorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.days import day_text
from tallyloom.operators import domains as D
from tallyloom.operators import latest as L
from tallyloom.plans.spec import Question, apply_filters, status_of, vocabulary_condition
from tallyloom.queries.registry import Registry
from tallyloom.sources.records import Records

R = Registry()
AS_OF = "2026-05-31"
N = lambda: F.count(F.lit(1))
CENTS = "cast(amount AS DECIMAL(30,4))"

# Scans


@R.add("s1_recent_notes", "SELECT id, content, event_day FROM x_notes ORDER BY id DESC LIMIT 200")
def _(r: Records) -> DataFrame:
    return r.of("notes", "id", "content", "event_day").select("id", "content", "event_day").orderBy(F.desc("id")).limit(200)


@R.add("s1_recent_expenses", "SELECT id, amount, description, event_day FROM x_expenses ORDER BY event_day DESC NULLS LAST, id DESC LIMIT 500")
def _(r: Records) -> DataFrame:
    return r.of("expenses", "id", "amount", "description", "event_day").orderBy(F.desc_nulls_last("event_day"), F.desc("id")).limit(500).select("id", "amount", "description", "event_day")


@R.add("s2_activity_page", "SELECT id, kind, input_text FROM x_activity ORDER BY id DESC LIMIT 50 OFFSET 100")
def _(r: Records) -> DataFrame:
    return r.of("activity", "id", "kind", "input_text").select("id", "kind", "input_text").orderBy(F.desc("id")).offset(100).limit(50)


@R.add("s3_ledger_balance", "SELECT person, cast(balance AS DOUBLE) AS balance FROM x_balance")
def _(r: Records) -> DataFrame:
    return D.balances(r.of("ledger", "person", "amount", "direction", "event_day")).select("person", F.col("balance").cast("double").alias("balance"))


# Filters


@R.add(
    "f1_f2_expense_filters",
    "SELECT id, amount, description, event_day FROM x_expenses WHERE event_day BETWEEN '2025-01-01' AND '2025-06-30' AND contains(lower(description), 'bus') AND group_key = 'transport'",
)
def _(r: Records) -> DataFrame:
    q = Question(start="2025-01-01", end="2025-06-30", contains="bus", group="transport")
    return apply_filters(r.of("expenses", "id", "amount", "description", "event_day", "group_key"), q).select("id", "amount", "description", "event_day")


@R.add(
    "f3_note_window",
    "SELECT id, coalesce(substr(trim(processed_at), 1, 10), event_day) AS day FROM x_notes WHERE coalesce(substr(trim(processed_at), 1, 10), event_day) >= '2025-12-01'",
)
def _(r: Records) -> DataFrame:
    day = F.coalesce(day_text("processed_at"), F.col("event_day"))
    return r.of("notes", "id", "processed_at", "event_day").select("id", day.alias("day")).where("day >= '2025-12-01'")


@R.add("f3_note_window_created", "SELECT id, event_day AS day FROM x_notes WHERE event_day >= '2025-12-01'")
def _(r: Records) -> DataFrame:
    return r.of("notes", "id", "event_day").select("id", F.col("event_day").alias("day")).where("day >= '2025-12-01'")


@R.add("f4_not_contains", "SELECT id, description FROM x_expenses WHERE contains(lower(description), 'rent') AND NOT contains(lower(description), 'locker')")
def _(r: Records) -> DataFrame:
    return apply_filters(r.of("expenses", "id", "description", "event_day"), Question(contains="rent", not_contains="Locker")).select("id", "description")


@R.add("f5_group_excluded", "SELECT group_key, count(*) AS n_rows FROM x_expenses WHERE group_key IS NULL OR group_key <> 'groceries' GROUP BY ALL")
def _(r: Records) -> DataFrame:
    return apply_filters(r.of("expenses", "group_key", "event_day", "description"), Question(not_group="groceries")).groupBy("group_key").agg(N().alias("n_rows"))


_WORDS = ("fuel", "tyre", "puncture", "road tax")
_HIT = "(coalesce(group_key, '') = 'vehicle' OR " + " OR ".join(f"contains(lower(coalesce(description, '')), '{w}')" for w in _WORDS) + ")"


@R.add("f6_group_vocabulary", f"SELECT coalesce(group_key, '<none>') AS group_key, count(*) AS n_rows FROM x_expenses WHERE {_HIT} GROUP BY ALL")
def _(r: Records) -> DataFrame:
    hit = vocabulary_condition(F.col("group_key"), F.col("description"), "vehicle", _WORDS)
    return r.of("expenses", "group_key", "description").where(hit).groupBy(F.coalesce("group_key", F.lit("<none>")).alias("group_key")).agg(N().alias("n_rows"))


@R.add("f6_group_vocabulary_out", f"SELECT count(*) AS n_rows FROM x_expenses WHERE NOT {_HIT}")
def _(r: Records) -> DataFrame:
    return r.of("expenses", "group_key", "description").where(vocabulary_condition(F.col("group_key"), F.col("description"), "vehicle", _WORDS, exclude=True)).agg(N().alias("n_rows"))


@R.add("f7_open_items", "SELECT 'buy' AS list, count(*) AS n_rows FROM x_buy WHERE status = 'open' UNION ALL SELECT 'todo', count(*) FROM x_todos WHERE status = 'pending'")
def _(r: Records) -> DataFrame:
    buy = r.buy_items.where(F.col("status") == status_of(None, "buy")).agg(N().alias("n_rows")).select(F.lit("buy").alias("list"), "n_rows")
    todo = r.todos.where(F.col("status") == status_of("open", "todo")).agg(N().alias("n_rows")).select(F.lit("todo").alias("list"), "n_rows")
    return buy.unionByName(todo)


@R.add("f8_real_notes", "SELECT note_domain, count(*) AS n_rows FROM x_notes WHERE input_kind = 'note' AND structured_type = 'note' GROUP BY ALL")
def _(r: Records) -> DataFrame:
    return r.of("notes", "note_domain", "input_kind", "structured_type").where("input_kind = 'note' AND structured_type = 'note'").groupBy("note_domain").agg(N().alias("n_rows"))


@R.add("f9_standing", "SELECT person, cast(balance AS DOUBLE) AS balance, CASE WHEN balance > 0 THEN 'they_owe_me' WHEN balance < 0 THEN 'i_owe_them' ELSE 'settled' END AS side FROM x_balance")
def _(r: Records) -> DataFrame:
    bal = D.balances(r.of("ledger", "person", "amount", "direction", "event_day"))
    parts = [
        D.standing(bal, perspective="they_owe_me").withColumn("side", F.lit("they_owe_me")),
        D.standing(bal, perspective="i_owe_them").withColumn("side", F.lit("i_owe_them")),
        D.standing(bal, status="settled").withColumn("side", F.lit("settled")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("person", F.col("balance").cast("double").alias("balance"), "side")


@R.add("f10_clamped_list", "SELECT id, description, event_day FROM x_expenses ORDER BY event_day DESC NULLS LAST, id DESC LIMIT 100")
def _(r: Records) -> DataFrame:
    return D.newest(r.of("expenses", "id", "description", "event_day"), Question(limit=5000)).select("id", "description", "event_day")


@R.add(
    "f11_people_in_text",
    """WITH words AS (SELECT id, unnest(regexp_split_to_array(lower(input_text), '[^a-z]+')) AS word FROM x_activity),
    known AS (SELECT DISTINCT split_part(name, ' ', 1) AS word FROM x_persons)
    SELECT id, min(word) AS person FROM words JOIN known USING (word) WHERE word <> '' GROUP BY id""",
)
def _(r: Records) -> DataFrame:
    words = r.of("activity", "id", "input_text").select("id", F.explode(F.array_distinct(F.split(F.lower("input_text"), "[^a-z]+"))).alias("word")).where("word <> ''")
    known = r.repeated("persons", "name").select(F.split("name", " ")[0].alias("word")).distinct()
    return words.join(known, "word").groupBy("id").agg(F.min("word").alias("person"))


@R.add("f12_entries_of_debtors", "SELECT person, count(*) AS n_rows FROM x_ledger WHERE person IN (SELECT person FROM x_balance WHERE balance > 0) GROUP BY person")
def _(r: Records) -> DataFrame:
    return D.entries_of(r.of("ledger", "person", "amount", "direction", "event_day"), D.standing(D.balances(r.of("ledger", "person", "amount", "direction", "event_day")), perspective="they_owe_me")).groupBy("person").agg(N().alias("n_rows"))


@R.add(
    "f13_quarantine",
    """SELECT 'ledger' AS relation, CASE WHEN direction IN ('gave', 'received') AND amount > 0 AND person IS NOT NULL THEN 'kept' ELSE 'quarantined' END AS verdict, count(*) AS n_rows FROM x_ledger GROUP BY ALL
    UNION ALL SELECT 'expenses', CASE WHEN amount > 0 AND description IS NOT NULL THEN 'kept' ELSE 'quarantined' END, count(*) FROM x_expenses GROUP BY ALL""",
)
def _(r: Records) -> DataFrame:
    def verdict(df: DataFrame, name: str, ok) -> DataFrame:
        v = F.when(F.coalesce(ok, F.lit(False)), "kept").otherwise("quarantined")
        return df.groupBy(F.lit(name).alias("relation"), v.alias("verdict")).agg(N().alias("n_rows"))

    led = verdict(r.of("ledger", "direction", "amount", "person"), "ledger", F.col("direction").isin("gave", "received") & (F.col("amount") > 0) & F.col("person").isNotNull())
    return led.unionByName(verdict(r.of("expenses", "amount", "description"), "expenses", (F.col("amount") > 0) & F.col("description").isNotNull()))


# Joins


@R.add("j1_notes_with_vectors", "SELECT n.id, n.note_domain, n.event_day, v.id AS vector_id, v.domain FROM x_notes n LEFT JOIN x_vectors v ON v.source_note_id = n.id")
def _(r: Records) -> DataFrame:
    v = r.of("note_vectors", "id", "source_note_id", "domain").toDF("vector_id", "id", "domain")
    return r.of("notes", "id", "note_domain", "event_day").join(v, "id", "left")


@R.add("j2_notes_without_vector", "SELECT id FROM x_notes n WHERE NOT EXISTS (SELECT 1 FROM x_vectors v WHERE v.source_note_id = n.id)")
def _(r: Records) -> DataFrame:
    return r.of("notes", "id").join(r.repeated("note_vectors", "source_note_id").toDF("id"), "id", "left_anti")


@R.add("j3_vector_lookup", "SELECT n.id, v.id AS vector_id, len(v.embedding) AS dims FROM x_notes n JOIN x_vectors v ON v.source_note_id = n.id")
def _(r: Records) -> DataFrame:
    v = r.of("note_vectors", "id", "source_note_id", "embedding").select(F.col("source_note_id").alias("id"), F.col("id").alias("vector_id"), F.size("embedding").cast("long").alias("dims"))
    return r.of("notes", "id").select("id").join(v, "id")


_LATEST = "SELECT person, id, weight, event_day FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY event_day DESC NULLS LAST, id DESC) AS rn FROM x_weights) WHERE rn = 1"


@R.add("j4_w1_latest_weight", _LATEST)
def _(r: Records) -> DataFrame:
    return L.latest_per_key(r.of("weights", "person", "id", "weight", "event_day"), ["person"], ["event_day", "id"], ["id", "weight", "event_day"])


@R.add("j5_latest_with_ties", "SELECT person, id, weight FROM x_weights w WHERE event_day = (SELECT max(event_day) FROM x_weights m WHERE m.person = w.person)")
def _(r: Records) -> DataFrame:
    return L.latest_with_ties(r.of("weights", "person", "id", "weight", "event_day"), ["person"], "event_day").select("person", "id", "weight")


@R.add(
    "j6_unreferenced_notes",
    "SELECT id FROM x_notes WHERE id NOT IN (SELECT source_note_id FROM x_expenses WHERE source_note_id IS NOT NULL UNION SELECT source_note_id FROM x_ledger WHERE source_note_id IS NOT NULL UNION SELECT source_note_id FROM x_vectors WHERE source_note_id IS NOT NULL UNION SELECT source_note_id FROM weights WHERE source_note_id IS NOT NULL)",
)
def _(r: Records) -> DataFrame:
    used = [r.repeated(name, "source_note_id") for name in ("expenses", "ledger", "weights", "note_vectors")]
    return r.of("notes", "id").join(reduce(DataFrame.unionByName, used).toDF("id"), "id", "left_anti")


@R.add("j7_w8_beyond_newest", "SELECT kind, count(*) AS n_rows FROM (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY id DESC) AS rn FROM x_activity) WHERE rn > 50 GROUP BY kind")
def _(r: Records) -> DataFrame:
    return L.beyond_newest(r.of("activity", "id", "kind"), "kind", "id", 50).groupBy("kind").agg(N().alias("n_rows"))


@R.add(
    "j8_entries_per_note",
    "SELECT n.id, string_agg(cast(e.id AS VARCHAR), ',' ORDER BY e.id) AS expense_ids FROM x_notes n JOIN x_expenses e ON e.source_note_id = n.id GROUP BY n.id",
)
def _(r: Records) -> DataFrame:
    e = r.of("expenses", "id", "source_note_id").select(F.col("source_note_id").alias("id"), F.col("id").alias("eid"))
    per = r.of("notes", "id").select("id").join(e, "id").groupBy("id").agg(F.sort_array(F.collect_list("eid")).alias("ids"))
    return per.select("id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("expense_ids"))


@R.add(
    "j9_j12_months_compared",
    f"""WITH a AS (SELECT group_key, sum({CENTS}) AS t, count(*) AS n FROM x_expenses WHERE substr(event_day, 1, 4) = '2024' GROUP BY 1),
    b AS (SELECT group_key, sum({CENTS}) AS t, count(*) AS n FROM x_expenses WHERE substr(event_day, 1, 4) = '2025' GROUP BY 1)
    SELECT coalesce(a.group_key, b.group_key) AS group_key, cast(a.t AS DOUBLE) AS before_total, cast(b.t AS DOUBLE) AS after_total, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'gone' WHEN b.t > a.t THEN 'more' WHEN b.t < a.t THEN 'less' ELSE 'same' END AS verdict
    FROM a FULL JOIN b ON a.group_key IS NOT DISTINCT FROM b.group_key""",
)
def _(r: Records) -> DataFrame:
    def year(y: str, t: str) -> DataFrame:
        return r.of("expenses", "amount", "event_day", "group_key").where(F.substring("event_day", 1, 4) == y).groupBy("group_key").agg(F.sum(D.money("amount")).alias(t))

    a, b = year("2024", "x"), year("2025", "y").withColumnRenamed("group_key", "other_key")
    j = a.join(b, F.col("group_key").eqNullSafe(F.col("other_key")), "full")
    verdict = F.when(F.col("x").isNull(), "new").when(F.col("y").isNull(), "gone").when(F.col("y") > F.col("x"), "more").when(F.col("y") < F.col("x"), "less").otherwise("same")
    return j.select(F.coalesce("group_key", "other_key").alias("group_key"), F.col("x").cast("double").alias("before_total"), F.col("y").cast("double").alias("after_total"), verdict.alias("verdict"))


@R.add("j11_known_people", "SELECT person, count(*) AS n_rows FROM x_ledger WHERE person IN (SELECT name FROM x_persons UNION SELECT person FROM x_weights) GROUP BY person")
def _(r: Records) -> DataFrame:
    known = r.repeated("persons", "name").select(F.col("name").alias("person")).union(r.repeated("weights", "person").select("person"))
    return r.of("ledger", "person").join(known, "person", "left_semi").groupBy("person").agg(N().alias("n_rows"))


# Aggregates


@R.add("a1_total", f"SELECT cast(coalesce(sum({CENTS}), 0) AS DOUBLE) AS total FROM x_expenses WHERE event_day BETWEEN '2025-03-01' AND '2025-03-31' AND group_key = 'dining'")
def _(r: Records) -> DataFrame:
    return D.total(r.of("expenses", "amount", "description", "event_day", "group_key"), Question(start="2025-03-01", end="2025-03-31", group="dining"))


@R.add(
    "a2_compare",
    f"""SELECT cast(p AS DOUBLE) AS primary_total, cast(c AS DOUBLE) AS compare_total, round(cast(p - c AS DOUBLE), 4) AS change FROM (SELECT
    coalesce(sum({CENTS}) FILTER (WHERE event_day BETWEEN '2025-04-01' AND '2025-04-30'), 0) AS p, coalesce(sum({CENTS}) FILTER (WHERE event_day BETWEEN '2025-03-01' AND '2025-03-31'), 0) AS c FROM x_expenses WHERE group_key IS NULL OR group_key <> 'rent')""",
)
def _(r: Records) -> DataFrame:
    return D.compare(r.of("expenses", "amount", "description", "event_day", "group_key"), Question(start="2025-04-01", end="2025-04-30", compare_start="2025-03-01", compare_end="2025-03-31", not_group="rent"))


@R.add("a3_balances", f"SELECT person, cast(sum(CASE WHEN direction = 'gave' THEN {CENTS} ELSE -{CENTS} END) AS DOUBLE) AS balance FROM x_ledger WHERE event_day >= '2025-01-01' GROUP BY person")
def _(r: Records) -> DataFrame:
    return D.balances(r.of("ledger", "person", "amount", "direction", "event_day"), Question(domain="ledger", start="2025-01-01")).select("person", F.col("balance").cast("double").alias("balance"))


@R.add("a4_who_owes", "SELECT person, cast(balance AS DOUBLE) AS balance FROM x_balance WHERE balance > 0 ORDER BY balance DESC, person")
def _(r: Records) -> DataFrame:
    return D.standing(D.balances(r.of("ledger", "person", "amount", "direction", "event_day")), perspective="they_owe_me").orderBy(F.desc("balance"), "person").select("person", F.col("balance").cast("double").alias("balance"))


@R.add("a5_owed_totals", "SELECT cast(coalesce(sum(balance) FILTER (WHERE balance > 0), 0) AS DOUBLE) AS owed_to_me, cast(coalesce(sum(-balance) FILTER (WHERE balance < 0), 0) AS DOUBLE) AS i_owe FROM x_balance")
def _(r: Records) -> DataFrame:
    return D.owed_totals(D.balances(r.of("ledger", "person", "amount", "direction", "event_day")))


@R.add("a6_latest_months", f"SELECT substr(event_day, 1, 7) AS month, cast(sum({CENTS}) AS DOUBLE) AS total FROM x_expenses GROUP BY 1 ORDER BY 1 DESC NULLS LAST LIMIT 3")
def _(r: Records) -> DataFrame:
    return D.by_month(r.of("expenses", "amount", "event_day"), latest=3)


@R.add(
    "a7_counts",
    f"SELECT count(*) AS n_all, count(*) FILTER (WHERE status = 'pending') AS n_pending, count(*) FILTER (WHERE status = 'pending' AND date = '{AS_OF}') AS n_due, count(*) FILTER (WHERE status = 'pending' AND date < '{AS_OF}') AS n_overdue FROM x_todos",
)
def _(r: Records) -> DataFrame:
    pending = F.col("status") == "pending"
    return r.todos.agg(N().alias("n_all"), F.count_if(pending).alias("n_pending"), F.count_if(pending & (F.col("date") == AS_OF)).alias("n_due"), F.count_if(pending & (F.col("date") < AS_OF)).alias("n_overdue"))


@R.add("a8_people_counted", "SELECT count(DISTINCT person) AS n_people FROM x_ledger")
def _(r: Records) -> DataFrame:
    return r.repeated("ledger", "person").agg(F.count_distinct("person").alias("n_people"))


@R.add("a9_names", "SELECT DISTINCT person FROM x_weights")
def _(r: Records) -> DataFrame:
    return r.repeated("weights", "person").select("person").distinct()


@R.add(
    "a10_stale_people",
    f"SELECT person, max(event_day) AS last_day, date_diff('day', cast(max(event_day) AS DATE), DATE '{AS_OF}') AS days FROM x_weights GROUP BY person HAVING days > 30 ORDER BY days DESC, person LIMIT 3",
)
def _(r: Records) -> DataFrame:
    return L.stale(r.of("weights", "person", "event_day"), "person", "event_day", AS_OF, 30, 3).withColumn("days", F.col("days").cast("long"))


@R.add(
    "a11_month_change",
    f"""WITH m AS (SELECT substr(event_day, 1, 7) AS month, cast(sum({CENTS}) AS DOUBLE) AS total FROM x_expenses WHERE event_day IS NOT NULL GROUP BY 1), l AS (SELECT *, lag(total) OVER (ORDER BY month) AS last_total FROM m)
    SELECT month, total, last_total, CASE WHEN last_total > 0 THEN round((total - last_total) / last_total * 100, 4) END AS change_pct FROM l""",
)
def _(r: Records) -> DataFrame:
    return D.month_change(r.of("expenses", "amount", "event_day"))


@R.add("a12_day_groups", f"SELECT event_day AS day, cast(sum({CENTS}) AS DOUBLE) AS total, count(*) AS n_rows FROM x_expenses GROUP BY 1")
def _(r: Records) -> DataFrame:
    return D.day_groups(r.of("expenses", "amount", "event_day"), F.col("event_day"))


@R.add("a13_joined_days", "SELECT date AS day, string_agg(content, ' · ' ORDER BY id) AS line FROM x_todos GROUP BY date")
def _(r: Records) -> DataFrame:
    return D.joined_by_day(r.todos, "date", F.col("content"))


@R.add(
    "a14_latency_stats",
    """SELECT kind, count(ms) AS n, min(ms) AS least, round(avg(ms), 6) AS mean, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.9) AS p90, quantile_cont(ms, 0.95) AS p95, quantile_cont(ms, 0.99) AS p99, max(ms) AS most
    FROM (SELECT kind, try_cast(json_extract_string(CASE WHEN json_valid(metadata_json) THEN metadata_json END, '$.ms') AS DOUBLE) AS ms FROM x_activity) GROUP BY kind""",
)
def _(r: Records) -> DataFrame:
    from tallyloom.operators.evalkit import latency_stats

    ms = F.get_json_object("metadata_json", "$.ms").try_cast("double")
    return latency_stats(r.of("activity", "kind", "metadata_json").select("kind", ms.alias("ms")), "ms", ["kind"])


@R.add("a15_frequencies", "SELECT coalesce(kind, '<none>') AS value, count(*) AS n_rows FROM x_activity GROUP BY 1 ORDER BY 2 DESC, 1")
def _(r: Records) -> DataFrame:
    from tallyloom.operators.evalkit import frequencies

    return frequencies(r.of("activity", "kind"), "kind")


@R.add("a23_snapshot", "SELECT 'expenses' AS relation, count(*) AS n_rows, max(id) AS max_id, arg_max(description, id) AS latest FROM x_expenses UNION ALL SELECT 'notes', count(*), max(id), arg_max(content, id) FROM x_notes")
def _(r: Records) -> DataFrame:
    from tallyloom.operators.evalkit import snapshot

    return snapshot(r.expenses, "expenses", "id", "description").unionByName(snapshot(r.notes, "notes", "id", "content"))


@R.add(
    "a26_dashboard",
    f"""SELECT (SELECT cast(coalesce(sum({CENTS}), 0) AS DOUBLE) FROM x_expenses WHERE substr(event_day, 1, 7) = '2026-05') AS month_spend, (SELECT count(*) FROM x_todos WHERE status = 'pending') AS n_pending,
    (SELECT count(*) FROM x_balance WHERE balance <> 0) AS n_open_balances, (SELECT count(DISTINCT person) FROM x_weights) AS n_weighed, (SELECT count(*) FROM x_notes WHERE input_kind = 'note' AND structured_type = 'note') AS n_notes""",
)
def _(r: Records) -> DataFrame:
    parts = [
        r.expenses.where("substring(event_day, 1, 7) = '2026-05'").agg(F.coalesce(F.sum(D.money("amount")), F.lit(0)).cast("double").alias("v")).select(F.lit("month_spend").alias("k"), "v"),
        r.todos.where("status = 'pending'").agg(N().cast("double").alias("v")).select(F.lit("n_pending").alias("k"), "v"),
        D.standing(D.balances(r.ledger), status="open").agg(N().cast("double").alias("v")).select(F.lit("n_open_balances").alias("k"), "v"),
        r.weights.agg(F.count_distinct("person").cast("double").alias("v")).select(F.lit("n_weighed").alias("k"), "v"),
        r.notes.where("input_kind = 'note' AND structured_type = 'note'").agg(N().cast("double").alias("v")).select(F.lit("n_notes").alias("k"), "v"),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    pick = lambda k, t: F.max(F.when(F.col("k") == k, F.col("v"))).cast(t).alias(k)
    return every.agg(pick("month_spend", "double"), *[pick(k, "long") for k in ("n_pending", "n_open_balances", "n_weighed", "n_notes")])


@R.add(
    "a22_write_distribution",
    "SELECT output.lane AS lane, output.disposition AS disposition, source, count(*) AS n_rows, grouping_id(output.lane, output.disposition, source) AS level FROM x_writes GROUP BY CUBE (output.lane, output.disposition, source)",
)
def _(r: Records) -> DataFrame:
    w = r.writes.select(F.col("output.lane").alias("lane"), F.col("output.disposition").alias("disposition"), "source")
    return w.cube("lane", "disposition", "source").agg(N().alias("n_rows"), F.grouping_id().alias("level"))


@R.add("a21_usual_group", """WITH c AS (SELECT description, group_key, count(*) AS n, min(id) AS first_id FROM x_expenses WHERE group_key IS NOT NULL GROUP BY 1, 2)
    SELECT description, arg_max(group_key, n * 1000000000000 - first_id) AS usual_group FROM c GROUP BY 1""")
def _(r: Records) -> DataFrame:
    votes = r.of("expenses", "id", "description", "group_key").where("group_key IS NOT NULL").groupBy("description", "group_key").agg(N().alias("n"), F.min("id").alias("first_id"))
    return votes.groupBy("description").agg(F.max_by("group_key", F.struct("n", -F.col("first_id"))).alias("usual_group"))


@R.add("a25_ordered_distinct", "WITH f AS (SELECT description, group_key, min(id) AS first_id FROM x_expenses WHERE group_key IS NOT NULL GROUP BY 1, 2) SELECT description, count(*) AS n_groups, string_agg(group_key, ',' ORDER BY first_id) AS groups FROM f GROUP BY description")
def _(r: Records) -> DataFrame:
    first = r.of("expenses", "id", "description", "group_key").where("group_key IS NOT NULL").groupBy("description", "group_key").agg(F.min("id").alias("first_id"))
    listed = F.array_sort(F.collect_list(F.struct("first_id", "group_key")))  # one entry per group
    return first.groupBy("description").agg(N().alias("n_groups"), F.array_join(F.transform(listed, lambda x: x["group_key"]), ",").alias("groups"))


# Latest rows


@R.add("w2_last_three", "SELECT person, id, weight, rn FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY event_day DESC NULLS LAST, id DESC) AS rn FROM x_weights) WHERE rn <= 3")
def _(r: Records) -> DataFrame:
    return L.last_k(r.of("weights", "person", "id", "weight", "event_day"), ["person"], ["event_day", "id"], 3).select("person", "id", "weight", F.col("rn").cast("long").alias("rn"))


_TOP5 = "(SELECT *, row_number() OVER (PARTITION BY person ORDER BY event_day DESC NULLS LAST, id DESC) AS rn FROM x_weights)"


@R.add("w3_change", f"SELECT person, count(*) AS n_rows, arg_min(weight, rn) AS newest, arg_max(weight, rn) AS oldest, CASE WHEN count(*) > 1 THEN round(arg_min(weight, rn) - arg_max(weight, rn), 6) END AS delta FROM {_TOP5} WHERE rn <= 5 GROUP BY person")
def _(r: Records) -> DataFrame:
    return L.change(r.of("weights", "person", "id", "weight", "event_day"), ["person"], ["event_day", "id"], "weight", 5)


@R.add("w4_trend", f"SELECT person, string_agg(printf('%.2f', weight), ',' ORDER BY rn) AS series, round(arg_min(weight, rn) - arg_max(weight, rn), 6) AS delta FROM {_TOP5} WHERE rn <= 5 GROUP BY person")
def _(r: Records) -> DataFrame:
    return L.trend(r.of("weights", "person", "id", "weight", "event_day"), ["person"], ["event_day", "id"], "weight", 5)


@R.add("w5_latest_day", "SELECT id, item_text, date FROM x_buy WHERE date = (SELECT max(date) FROM x_buy)")
def _(r: Records) -> DataFrame:
    return L.rows_of_latest_day(r.buy_items, "date").select("id", "item_text", "date")


@R.add("w6_last_person_balance", "SELECT person, cast(balance AS DOUBLE) AS balance FROM x_balance WHERE person = (SELECT person FROM x_ledger ORDER BY event_day DESC NULLS LAST, id DESC LIMIT 1)")
def _(r: Records) -> DataFrame:
    last = r.of("ledger", "id", "person", "amount", "direction", "event_day").orderBy(F.desc_nulls_last("event_day"), F.desc("id")).limit(1).select("person")
    return D.balances(D.entries_of(r.of("ledger", "id", "person", "amount", "direction", "event_day"), last)).select("person", F.col("balance").cast("double").alias("balance"))


@R.add("w7_slowest", "SELECT id, ms FROM (SELECT id, try_cast(json_extract_string(CASE WHEN json_valid(metadata_json) THEN metadata_json END, '$.ms') AS BIGINT) AS ms FROM x_activity) WHERE ms IS NOT NULL ORDER BY ms DESC, id LIMIT 10")
def _(r: Records) -> DataFrame:
    ms = F.get_json_object("metadata_json", "$.ms").try_cast("long")
    return r.of("activity", "id", "metadata_json").select("id", ms.alias("ms")).where("ms IS NOT NULL").orderBy(F.desc("ms"), "id").limit(10)


# Sorts


@R.add("o1_newest_expenses", "SELECT id, amount, event_day FROM x_expenses ORDER BY event_day DESC NULLS LAST, id DESC LIMIT 10")
def _(r: Records) -> DataFrame:
    return D.newest(r.of("expenses", "id", "amount", "description", "event_day"), Question()).select("id", "amount", "event_day")


@R.add("o2_pending_first", "SELECT id, content, status FROM x_todos ORDER BY CASE WHEN status = 'pending' THEN 0 ELSE 1 END, date DESC NULLS LAST, id DESC LIMIT 20")
def _(r: Records) -> DataFrame:
    return D.newest(r.todos, Question(domain="todo"), text="content", first=F.when(F.col("status") == "pending", 0).otherwise(1)).select("id", "content", "status")


@R.add("o3_by_magnitude", "SELECT person, cast(balance AS DOUBLE) AS balance FROM x_balance ORDER BY abs(balance) DESC, person LIMIT 20")
def _(r: Records) -> DataFrame:
    return D.balances(r.of("ledger", "person", "amount", "direction", "event_day")).orderBy(F.abs("balance").desc(), "person").limit(20).select("person", F.col("balance").cast("double").alias("balance"))


@R.add("o5_one_day_key", "SELECT event_day, count(*) AS n_rows, max(id) AS last_id FROM x_ledger GROUP BY event_day")
def _(r: Records) -> DataFrame:
    return r.of("ledger", "id", "event_day").groupBy("event_day").agg(N().alias("n_rows"), F.max("id").alias("last_id"))


@R.add("o8_seeded_order", "SELECT id, cast(row_number() OVER (ORDER BY md5('7:' || id), id) AS BIGINT) AS place FROM x_persons")
def _(r: Records) -> DataFrame:
    from tallyloom.operators.dataset import seeded_places

    return seeded_places(r.of("persons", "id"), "id", 7).select("id", "place")


# Sets


@R.add("u1_union", "SELECT person FROM x_ledger UNION SELECT name FROM x_persons")
def _(r: Records) -> DataFrame:
    return r.repeated("ledger", "person").select("person").union(r.repeated("persons", "name").select(F.col("name").alias("person"))).distinct()


@R.add("u2_intersect", "SELECT person FROM x_ledger INTERSECT SELECT name FROM x_persons")
def _(r: Records) -> DataFrame:
    return r.repeated("ledger", "person").select("person").intersect(r.repeated("persons", "name").select(F.col("name").alias("person")))


@R.add("u2_except", "SELECT person FROM x_ledger EXCEPT SELECT name FROM x_persons")
def _(r: Records) -> DataFrame:
    return r.repeated("ledger", "person").select("person").subtract(r.repeated("persons", "name").select(F.col("name").alias("person")))


@R.add("u4_concatenated", "SELECT lane, count(*) AS n_rows FROM (SELECT 'todo' AS lane FROM x_todos UNION ALL SELECT 'buy' FROM x_buy) GROUP BY lane")
def _(r: Records) -> DataFrame:
    both = r.todos.select(F.lit("todo").alias("lane"), "id").unionByName(r.buy_items.select(F.lit("buy").alias("lane"), "id"))
    return both.groupBy("lane").agg(N().alias("n_rows"))


@R.add("u6_unseen_inputs", """WITH n AS (SELECT id, regexp_replace(trim(lower(input)), '\\s+', ' ', 'g') AS norm, split FROM x_writes),
    v AS (SELECT norm, min(id) AS id FROM n WHERE split = 'valid' AND norm NOT IN (SELECT norm FROM n WHERE split = 'train') GROUP BY norm) SELECT id, norm, row_number() OVER (ORDER BY md5('0:' || id), id) AS place FROM v""")
def _(r: Records) -> DataFrame:
    from tallyloom.functions.text import normalise
    from tallyloom.operators.dataset import seeded_places

    n = r.writes.select("id", normalise("input").alias("norm"), "split")
    fresh = n.where("split = 'valid'").join(n.where("split = 'train'").select("norm"), "norm", "left_anti").groupBy("norm").agg(F.min("id").alias("id"))
    return seeded_places(fresh, "id", 0).select("id", "norm", "place")


QUERIES, SQL = R.queries, R.sql
