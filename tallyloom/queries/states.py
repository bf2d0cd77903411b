"""Queries of state, evaluation, dataset building, files, guarded SQL and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.days import stamp
from tallyloom.functions.text import normalise
from tallyloom.operators import dataset as B
from tallyloom.operators import domains as D
from tallyloom.operators import evalkit as K
from tallyloom.operators import state as S
from tallyloom.plans import sqlguard as G
from tallyloom.queries.registry import Registry
from tallyloom.sources import files as L
from tallyloom.sources.records import Records
from tallyloom.streaming import feeds as ST

R = Registry()
N = lambda: F.count(F.lit(1))
AS_OF = "2026-05-31"

# State


@R.add("t1_written_rows", "SELECT id // 100 AS capture_id, lane AS relation, id % 100 AS pos, coalesce(description, item_text, text, person_text) AS what, coalesce(amount, value) AS amount, date FROM x_lanes WHERE id // 100 IN (SELECT id FROM x_writes WHERE output.disposition = 'accept')")
def _(r: Records) -> DataFrame:
    return S.written_rows(r.writes)


@R.add("t2_notes_by_day", "SELECT substr(at_time, 1, 10) AS day, string_agg('[' || substr(at_time, 12, 8) || '] ' || input_text, chr(10) || chr(10) ORDER BY at_time DESC, id DESC) AS content, count(*) AS n_entries FROM x_activity WHERE kind = 'note' GROUP BY 1")
def _(r: Records) -> DataFrame:
    return S.notes_by_day(r.activity.where("kind = 'note'").select("id", "at", F.col("input_text").alias("text")))


_NORM = r"trim(regexp_replace(lower(input_text), '\s+', ' ', 'g'))"


@R.add("t3_memo", f"SELECT {_NORM} AS pattern, count(*) AS hit_count, arg_max(coalesce(kind, 'none'), at_time || lpad(cast(id AS VARCHAR), 12, '0')) AS resolved, max(at_time) AS last_used FROM x_activity GROUP BY 1")
def _(r: Records) -> DataFrame:
    uses = r.activity.select("id", normalise("input_text").alias("k"), F.coalesce("kind", F.lit("none")).alias("v"), "at")
    return S.merge_memo(uses, "k", "v", "at").drop("last_id")


@R.add("t4_memo_pruned", f"SELECT count(*) AS n_patterns FROM (SELECT {_NORM} AS p, max(at_time) AS m FROM x_activity GROUP BY 1) WHERE m >= strftime(DATE '{AS_OF}' - INTERVAL 90 DAY, '%Y-%m-%d')")
def _(r: Records) -> DataFrame:
    uses = r.activity.select("id", normalise("input_text").alias("k"), F.coalesce("kind", F.lit("none")).alias("v"), "at")
    return S.prune(S.merge_memo(uses, "k", "v", "at"), AS_OF, 90).agg(N().alias("n_patterns"))


@R.add("t5_latest_values", "SELECT kind AS key, arg_max(input_text, at_time || lpad(cast(id AS VARCHAR), 12, '0')) AS value FROM x_activity WHERE kind IS NOT NULL GROUP BY kind")
def _(r: Records) -> DataFrame:
    return S.latest_values(r.activity.where("kind IS NOT NULL").select(F.col("kind").alias("key"), F.col("input_text").alias("value"), "at", "id"), "key", "value", "at")


@R.add(
    "t6_one_pending",
    "SELECT id, CASE WHEN category <> 'view' THEN 'resolved' WHEN row_number() OVER (PARTITION BY user_id, category = 'view' ORDER BY at_time DESC, id DESC) = 1 THEN 'pending' ELSE 'dismissed' END AS status FROM x_events",
)
def _(r: Records) -> DataFrame:
    actions = r.events.select("id", "user_id", "at", F.when(F.col("category") == "view", "pending").otherwise("resolved").alias("status"))
    return S.one_pending(actions, "user_id", ["at", "id"]).select("id", "status")


@R.add(
    "t7_replies",
    """WITH p AS (SELECT user_id, at_time, max(id) AS id FROM x_events WHERE category = 'view' GROUP BY ALL), c AS (SELECT * FROM x_events WHERE category = 'click'),
    j AS (SELECT c.id AS reply_id, p.id AS prompt_id, c.user_id, c.at_time FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.at_time >= p.at_time)
    SELECT reply_id, prompt_id, prompt_id IS NOT NULL AND row_number() OVER (PARTITION BY user_id, prompt_id ORDER BY at_time, reply_id) = 1 AS settles FROM j""",
)
def _(r: Records) -> DataFrame:
    e = r.events
    return S.pair_replies(e.where("category = 'view'"), e.where("category = 'click'"), "user_id", "at")


_RENAMED = "CASE WHEN person = 'self' THEN 'owner' WHEN person LIKE 'mr %' THEN substr(person, 4) ELSE person END"


@R.add("t8_renamed", f"SELECT {_RENAMED} AS person, count(*) AS n_rows FROM x_ledger GROUP BY 1")
def _(r: Records) -> DataFrame:
    old = r.ledger.select(F.col("person").alias("old")).distinct()
    mapping = old.withColumn("new", F.when(F.col("old") == "self", "owner").when(F.col("old").startswith("mr "), F.substring("old", 4, 1000))).where("new IS NOT NULL")
    return S.rename(r.ledger, mapping, "person").groupBy("person").agg(N().alias("n_rows"))


@R.add("t9_new_people", "SELECT DISTINCT person AS name FROM x_ledger WHERE person IS NOT NULL AND person NOT IN (SELECT name FROM x_persons)")
def _(r: Records) -> DataFrame:
    return S.new_people(r.ledger, r.persons)


@R.add("t10_living_notes", "SELECT id FROM x_notes WHERE id NOT IN (SELECT note_id FROM note_tombstones WHERE note_id IS NOT NULL)")
def _(r: Records) -> DataFrame:
    return S.without(r.notes.select("id"), r.raw("note_tombstones"), "id", "note_id")


@R.add("t11_rows_of_dead_notes", "SELECT id, source_note_id FROM x_expenses WHERE source_note_id IN (SELECT note_id FROM note_tombstones)")
def _(r: Records) -> DataFrame:
    dead = r.raw("note_tombstones").select(F.col("note_id").alias("source_note_id")).distinct()
    return r.expenses.select("id", "source_note_id").join(dead, "source_note_id", "left_semi").select("id", "source_note_id")


@R.add("t12_rotated", "WITH n AS (SELECT count(*) AS n FROM x_events), a AS (SELECT CASE WHEN n > 2000 THEN greatest(500, n - 2000) ELSE 0 END AS k FROM n) SELECT archived, count(*) AS n_rows FROM (SELECT row_number() OVER (ORDER BY id) <= (SELECT k FROM a) AS archived FROM x_events) GROUP BY archived")
def _(r: Records) -> DataFrame:
    return S.rotate(r.events.select("id"), 2000, 500).groupBy("archived").agg(N().alias("n_rows"))


_STATUS = "CASE category WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'done' ELSE 'failed' END"


@R.add("t13_queue", f"SELECT user_id, arg_max({_STATUS}, (at_time, id)) AS status, arg_max({_STATUS}, (at_time, id)) IN ('pending', 'processing') AS recover FROM x_events GROUP BY user_id")
def _(r: Records) -> DataFrame:
    c = F.col("category")
    status = F.when(c == "view", "pending").when(c == "click", "processing").when(c == "purchase", "done").otherwise("failed")
    return S.queue_state(r.events, "user_id", ["at", "id"], status).select("user_id", "status", "recover")


@R.add("t14_captures", "SELECT id, content AS raw_text, coalesce(input_kind, 'note') AS lane FROM x_notes WHERE coalesce(structured_type, 'raw') <> 'note'")
def _(r: Records) -> DataFrame:
    return S.captures_of(r.notes).select("id", "raw_text", "lane")


@R.add(
    "t15_facts",
    f"""SELECT 1 AS place, 'pending to-dos' AS fact, cast(count(*) AS DOUBLE) AS value FROM x_todos WHERE status = 'pending' UNION ALL SELECT 2, 'open items', cast(count(*) AS DOUBLE) FROM x_buy WHERE status = 'open'
    UNION ALL SELECT 3, 'largest balance', cast(max(abs(balance)) AS DOUBLE) FROM x_balance UNION ALL SELECT 4, 'notes', cast(count(*) AS DOUBLE) FROM x_notes WHERE input_kind = 'note' AND structured_type = 'note'""",
)
def _(r: Records) -> DataFrame:
    fact = lambda df, place, name, v: df.agg(v.cast("double").alias("value")).select(F.lit(place).alias("place"), F.lit(name).alias("fact"), "value")
    parts = [
        fact(r.todos.where("status = 'pending'"), 1, "pending to-dos", N()),
        fact(r.buy_items.where("status = 'open'"), 2, "open items", N()),
        fact(D.balances(r.ledger), 3, "largest balance", F.max(F.abs("balance"))),
        fact(r.notes.where("input_kind = 'note' AND structured_type = 'note'"), 4, "notes", N()),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@R.add(
    "e6_settled",
    """WITH s AS (SELECT id, person, event_day AS day, CASE WHEN id % 7 = 0 THEN 'settle' ELSE direction END AS kind, cast(amount AS DECIMAL(30,4)) AS amount FROM x_ledger),
    t AS (SELECT *, CASE kind WHEN 'gave' THEN amount WHEN 'received' THEN -amount ELSE 0 END AS step, coalesce(sum(CASE WHEN kind = 'settle' THEN 1 ELSE 0 END) OVER (PARTITION BY person ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM s),
    u AS (SELECT *, sum(step) OVER (PARTITION BY person, epoch ORDER BY day, id ROWS UNBOUNDED PRECEDING) AS before FROM t)
    SELECT id, cast(CASE WHEN kind = 'settle' THEN abs(before) ELSE amount END AS DOUBLE) AS amount, CASE WHEN kind <> 'settle' THEN kind WHEN before > 0 THEN 'received' ELSE 'gave' END AS direction, cast(CASE WHEN kind = 'settle' THEN 0 ELSE before END AS DOUBLE) AS balance FROM u""",
)
def _(r: Records) -> DataFrame:
    kind = F.when(F.col("id") % 7 == 0, "settle").otherwise(F.col("direction"))
    entries = r.ledger.select("id", "person", F.col("event_day").alias("day"), kind.alias("kind"), "amount")
    return D.settle(entries).select("id", "amount", "direction", "balance")


# Evaluation


def _scored(r: Records) -> DataFrame:
    """Gold payloads against ones with slips made by rule: every 10th lost, every 7th confirmed, every 9th without its last record."""
    o = F.col("output")
    got = o.withField("disposition", F.when(F.col("id") % 7 == 0, "confirm").otherwise(o["disposition"])).withField(
        "records", F.when(F.col("id") % 9 == 0, F.slice(o["records"], 1, F.greatest(F.size(o["records"]) - 1, F.lit(0)))).otherwise(o["records"])
    )
    return K.score(r.writes.select("id", o.alias("expected"), F.when(F.col("id") % 10 != 0, got).alias("got")))


_AMOUNTS = "CASE WHEN list_bool_or(list_transform(output.records, lambda r: r.amount IS NOT NULL)) THEN id % 10 <> 0 AND NOT (id % 9 = 0 AND len(output.records) > 0) END"
_EXACT = "CASE WHEN id % 10 <> 0 THEN NOT (id % 7 = 0 AND output.disposition <> 'confirm') AND NOT (id % 9 = 0 AND len(output.records) > 0) END"
_METRICS = ("valid", "task_ok", "lane_ok", "disposition_ok", "reason_ok", "record_count_ok", "amounts_ok", "exact")
_MARKS = f"""WITH m AS (SELECT id, output.lane AS lane, id % 10 <> 0 AS valid, id % 10 <> 0 AS task_ok, id % 10 <> 0 AS lane_ok, id % 10 <> 0 AND (id % 7 <> 0 OR output.disposition = 'confirm') AS disposition_ok,
    CASE WHEN output.reason_code IS NOT NULL THEN id % 10 <> 0 END AS reason_ok, id % 10 <> 0 AND NOT (id % 9 = 0 AND len(output.records) > 0) AS record_count_ok, {_AMOUNTS} AS amounts_ok, {_EXACT} AS exact FROM x_writes)"""


@R.add("a16_metrics", _MARKS + " ".join(["SELECT metric, count(ok) AS applicable, count(*) FILTER (WHERE ok) AS correct, CASE WHEN count(ok) > 0 THEN round(100.0 * count(*) FILTER (WHERE ok) / count(ok), 2) END AS rate FROM (", " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS ok FROM m" for m in _METRICS), ") GROUP BY metric"]))
def _(r: Records) -> DataFrame:
    return K.summarise(_scored(r), _METRICS)


@R.add("a17_by_lane", _MARKS + "SELECT lane, count(*) AS n_rows, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE record_count_ok) AS n_count_ok, count(*) FILTER (WHERE exact) AS n_exact FROM m GROUP BY lane")
def _(r: Records) -> DataFrame:
    return _scored(r).groupBy(F.col("expected.lane").alias("lane")).agg(N().alias("n_rows"), F.count_if("valid").alias("n_valid"), F.count_if("record_count_ok").alias("n_count_ok"), F.count_if("exact").alias("n_exact"))


@R.add(
    "a18_m5_buckets",
    f"""WITH m AS (SELECT id, output.lane AS lane, CASE WHEN id % 10 = 0 THEN 'no result' WHEN id % 7 = 0 AND output.disposition <> 'confirm' THEN 'disposition' WHEN id % 9 = 0 AND len(output.records) > 0 THEN 'record count' ELSE 'ok' END AS bucket FROM x_writes),
    c AS (SELECT lane, bucket, count(*) AS n_rows, array_to_string(list_slice(list(id ORDER BY id), 1, 3), ',') AS examples FROM m GROUP BY 1, 2)
    SELECT lane, bucket, n_rows, round(100.0 * n_rows / sum(n_rows) OVER (PARTITION BY lane), 2) AS share, examples FROM c QUALIFY row_number() OVER (PARTITION BY lane ORDER BY n_rows DESC, bucket) <= 8""",
)
def _(r: Records) -> DataFrame:
    return K.bucket_report(K.bucket(_scored(r)).withColumn("lane", F.col("expected.lane")), "lane")


_MS = "try_cast(json_extract_string(CASE WHEN json_valid(metadata_json) THEN metadata_json END, '$.ms') AS DOUBLE)"


@R.add("a19_outcomes", f"WITH s AS (SELECT coalesce(kind, '<none>') AS kind, {_MS} AS ms FROM x_activity), o AS (SELECT *, CASE WHEN ms IS NULL THEN 'weak' WHEN ms > 2500 THEN 'broken' ELSE 'ok' END AS outcome FROM s) SELECT kind, count(*) AS n_rows, count(*) FILTER (WHERE outcome = 'ok') AS n_ok, count(*) FILTER (WHERE outcome = 'weak') AS n_weak, count(*) FILTER (WHERE outcome = 'broken') AS n_broken, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95 FROM o GROUP BY kind")
def _(r: Records) -> DataFrame:
    ms = F.get_json_object("metadata_json", "$.ms").try_cast("double")
    rows = r.activity.select(F.coalesce("kind", F.lit("<none>")).alias("kind"), ms.alias("ms"))
    rows = rows.withColumn("outcome", F.when(F.col("ms").isNull(), "weak").when(F.col("ms") > 2500, "broken").otherwise("ok"))
    return K.outcome_matrix(rows, "kind", "outcome", ("ok", "weak", "broken"), "ms")


@R.add("a20_grouping_sets", "SELECT note_domain, input_kind, count(*) AS n_rows, grouping_id(note_domain, input_kind) AS level FROM x_notes GROUP BY GROUPING SETS ((note_domain), (input_kind), ())")
def _(r: Records) -> DataFrame:
    c = [F.col("note_domain"), F.col("input_kind")]
    return r.notes.groupingSets([[c[0]], [c[1]], []], *c).agg(N().alias("n_rows"), F.grouping_id().alias("level")).select("note_domain", "input_kind", "n_rows", "level")


@R.add("a23_snapshots_compared", "SELECT 'events' AS relation, count(*) - count(*) FILTER (WHERE at_time < TIMESTAMP '2024-01-16') AS rows_added, max(id) - max(id) FILTER (WHERE at_time < TIMESTAMP '2024-01-16') AS id_moved FROM x_events")
def _(r: Records) -> DataFrame:
    before = r.events.where("at < TIMESTAMP_NTZ '2024-01-16'")
    return K.diff(K.snapshot(before, "events", "id", "category"), K.snapshot(r.events, "events", "id", "category"))


@R.add("a24_slowest_stages", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE source = 'event_archive'),
    p AS (SELECT doc_id, regexp_extract(line, '^(\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2})\\s+(\\w+)\\s+(\\w+)\\s+(?:lane=(\\w+)\\s+)?ms=(\\d+)\\s+(\\w+)$', ['at', 'sev', 'cat', 'lane', 'ms', 'out']) AS g FROM l),
    s AS (SELECT doc_id, g.cat AS cat, sum(cast(g.ms AS BIGINT)) AS ms FROM p WHERE g.ms <> '' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ms DESC, cat) AS rn FROM s)
    SELECT doc_id AS id, cast(sum(ms) AS BIGINT) AS total_ms, string_agg(cat || '=' || ms, ' ' ORDER BY rn) FILTER (WHERE rn <= 4) AS slowest FROM k GROUP BY doc_id""")
def _(r: Records) -> DataFrame:
    from pyspark.sql import Window

    lines = L.log_lines(r.raw("documents").where("source = 'event_archive'"), "doc_id", "text")
    per = lines.groupBy("id", "category").agg(F.sum("ms").alias("ms"))
    ranked = per.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ms"), "category")))
    top = F.sort_array(F.collect_list(F.when(F.col("rn") <= 4, F.struct("rn", F.concat("category", F.lit("="), F.col("ms").cast("string")).alias("t")))))
    return ranked.groupBy("id").agg(F.sum("ms").alias("total_ms"), F.array_join(F.transform(top, lambda s: s["t"]), " ").alias("slowest"))


# Dataset building

_U = "(cast('0x' || substr(md5('{seed}:' || {col}), 1, 13) AS BIGINT) / 4503599627370496.0)"


def _u(seed: int, col: str) -> str:
    return _U.format(seed=seed, col=col)


@R.add("b1_weighted_choice", f"SELECT id, CASE WHEN {_u(3, 'id')} < 0.5 THEN 'expense' WHEN {_u(3, 'id')} < 0.8 THEN 'todo' ELSE 'note' END AS lane FROM x_writes")
def _(r: Records) -> DataFrame:
    return r.writes.select("id", B.weighted_choice(B.uniform(3, "id"), [("expense", 5), ("todo", 3), ("note", 2)]).alias("lane"))


@R.add("b2_anchor_days", f"SELECT id, strftime(DATE '2026-01-01' + cast(floor({_u(5, 'id')} * 151) AS INTEGER), '%Y-%m-%d') AS anchor FROM x_writes")
def _(r: Records) -> DataFrame:
    days = F.floor(B.uniform(5, "id") * 151).cast("int")
    return r.writes.select("id", F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), days), "yyyy-MM-dd").alias("anchor"))


@R.add("b3_phrase_routes", f"SELECT id, CASE WHEN {_u(8, 'id')} < 0.6 THEN 'canonical' WHEN {_u(8, 'id')} < 0.9 THEN 'random' ELSE 'absolute' END AS route FROM x_writes")
def _(r: Records) -> DataFrame:
    return r.writes.select("id", B.weighted_choice(B.uniform(8, "id"), [("canonical", 60), ("random", 30), ("absolute", 10)]).alias("route"))


@R.add("b4_unique_sample", "WITH k AS (SELECT sha256(input) AS k, min(id) AS id, any_value(input) AS input FROM x_writes WHERE input IS NOT NULL GROUP BY 1) SELECT id, input FROM k ORDER BY md5('13:' || k) LIMIT 500")
def _(r: Records) -> DataFrame:
    return B.unique_sample(r.writes.select("id", "input", "output"), "input", 500, 13).select("id", "input")


@R.add("b5_pairs", "SELECT id, kind, CASE kind WHEN 'plain' THEN name ELSE 'not ' || name END AS text FROM x_persons, (SELECT unnest(['plain', 'turned']) AS kind)")
def _(r: Records) -> DataFrame:
    pair = F.array(F.struct(F.lit("plain").alias("kind"), F.col("name").alias("text")), F.struct(F.lit("turned").alias("kind"), F.concat(F.lit("not "), "name").alias("text")))
    return r.persons.select("id", F.explode(pair).alias("p")).select("id", "p.*")


@R.add("b6_follow_ups", "SELECT id, lag(input_text) OVER (PARTITION BY kind ORDER BY at_time, id) AS before FROM x_activity WHERE kind = 'ask'")
def _(r: Records) -> DataFrame:
    from tallyloom.operators.extract import follow_up_context

    asks = r.activity.where("kind = 'ask'").select("id", "kind", F.col("input_text").alias("text"), F.struct("at", "id").alias("o"))
    return follow_up_context(asks, "kind", "o").select("id", "before")


_SHARES = """, e AS (SELECT *, {0} * w / sum(w) OVER () AS x FROM c), f AS (SELECT *, floor(x) AS lo, row_number() OVER (ORDER BY floor(x) - x, k) AS rn, {0} - sum(floor(x)) OVER () AS spare FROM e), n AS (SELECT k, cast(lo + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS BIGINT) AS n_rows FROM f)"""


@R.add("b7_allocation", "WITH c AS (SELECT output.lane AS k, count(*) AS w FROM x_writes GROUP BY 1)" + _SHARES.format("(500 - (SELECT count(*) FROM c))") + " SELECT k AS lane, n_rows + 1 AS n_rows FROM n")
def _(r: Records) -> DataFrame:
    counts = {x[0]: x[1] for x in r.writes.groupBy("output.lane").count().collect()}
    lanes = sorted(counts)
    return r.spark.createDataFrame(list(zip(lanes, B.allocate([counts[k] for k in lanes], 500))), "lane string, n_rows long")


@R.add("b8_quality", "SELECT output.lane AS lane, count(*) AS n_rows, count(*) FILTER (WHERE len(output.records) = 0) AS n_empty, count(*) FILTER (WHERE output.disposition = 'confirm' AND output.reason_code IS NULL) AS n_unreasoned, count(DISTINCT input) AS n_inputs FROM x_writes GROUP BY 1")
def _(r: Records) -> DataFrame:
    o = F.col("output")
    return r.writes.groupBy(o["lane"].alias("lane")).agg(N().alias("n_rows"), F.count_if(F.size(o["records"]) == 0).alias("n_empty"), F.count_if((o["disposition"] == "confirm") & o["reason_code"].isNull()).alias("n_unreasoned"), F.count_distinct("input").alias("n_inputs"))


@R.add("j10_held_out", "WITH c AS (SELECT DISTINCT id, input FROM heldout_cases) SELECT id, input, input IN (SELECT input FROM x_writes WHERE split = 'train') AS \"overlaps\" FROM c ORDER BY \"overlaps\", md5('17:' || id) LIMIT 500")
def _(r: Records) -> DataFrame:
    cands = r.raw("heldout_cases").select("id", "input").distinct()
    return B.held_out(cands, r.writes.where("split = 'train'"), "input", 500, 17).select("id", "input", "overlaps")


@R.add("s12_split", f"SELECT id, CASE WHEN {_u(42, 'id')} < 0.8 THEN 'train' WHEN {_u(42, 'id')} < 0.9 THEN 'valid' ELSE 'test' END AS part FROM x_writes")
def _(r: Records) -> DataFrame:
    return B.split(r.writes.select("id"), "id", 42, [("train", 80), ("valid", 10), ("test", 10)])


@R.add("s12_exact_split", "WITH t AS (SELECT count(*) AS m FROM x_writes), c AS (SELECT * FROM (VALUES (1, 80), (2, 10), (3, 10)) v(k, w))" + _SHARES.format("((SELECT m FROM t) - 3)") + """, u AS (SELECT k, sum(n_rows + 1) OVER (ORDER BY k) AS upto FROM n),
    p AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) AS place FROM x_writes)
    SELECT id, CASE WHEN place <= (SELECT upto FROM u WHERE k = 1) THEN 'train' WHEN place <= (SELECT upto FROM u WHERE k = 2) THEN 'valid' ELSE 'test' END AS part FROM p""")
def _(r: Records) -> DataFrame:
    return B.exact_split(r.writes.select("id"), "id", 42, [("train", 80), ("valid", 10), ("test", 10)]).select("id", "part")


@R.add("u3_u5_catalogue", "SELECT DISTINCT g || ' for ' || d AS label FROM (SELECT DISTINCT group_key AS g FROM x_expenses WHERE group_key IS NOT NULL), (SELECT DISTINCT note_domain AS d FROM x_notes WHERE note_domain IS NOT NULL)")
def _(r: Records) -> DataFrame:
    domains = r.notes.where("note_domain IS NOT NULL").agg(F.array_sort(F.collect_set("note_domain")).alias("d")).first()["d"]  # a few fixed names
    groups = r.expenses.where("group_key IS NOT NULL").select("group_key").distinct()
    return groups.select(F.explode(F.transform(F.array(*[F.lit(x) for x in domains]), lambda x: F.concat("group_key", F.lit(" for "), x))).alias("label")).distinct()


# Files and texts


@R.add("s4_s5_jsonl", "SELECT id, input, split FROM x_writes")
def _(r: Records) -> DataFrame:
    rows = r.writes.select("id", "input", "split")
    path = L.scratch(r.spark, "writes")
    L.write_jsonl(rows, path)
    return L.read_jsonl(r.spark, path, rows.schema, required=("id", "input"))[0]


@R.add("s6_csv", "SELECT id, description, amount FROM x_expenses")
def _(r: Records) -> DataFrame:
    path = L.scratch(r.spark, "expenses")
    L.write_csv(r.expenses.select("id", "description", "amount"), path)
    return L.read_csv(r.spark, path, "id long, description string, amount double")


@R.add("s7_log_entries", """WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE source = 'event_archive'),
    p AS (SELECT id, line_no, regexp_extract(line, '^(\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2})\\s+(\\w+)\\s+(\\w+)\\s+(?:lane=(\\w+)\\s+)?ms=(\\d+)\\s+(\\w+)$', ['at', 'sev', 'cat', 'lane', 'ms', 'out']) AS g FROM l)
    SELECT id, line_no, replace(g.at, 'T', ' ') AS at, g.sev AS severity, g.cat AS category, nullif(g.lane, '') AS lane, cast(g.ms AS BIGINT) AS ms, g.out AS outcome FROM p WHERE g.ms <> ''""")
def _(r: Records) -> DataFrame:
    return L.log_lines(r.raw("documents").where("source = 'event_archive'"), "doc_id", "text").withColumn("line_no", F.col("line_no").cast("long"))


@R.add(
    "s7_sections",
    """WITH a AS (SELECT id, replace(input_text, chr(10), ' ') AS i, coalesce(kind, '') AS kind, at_time, replace(coalesce(response_text, ''), chr(10), ' ') AS r FROM x_activity)
    SELECT id, cast(1 AS INTEGER) AS entry_no, i AS input, CASE WHEN kind IN ('note', 'ask') THEN kind END AS kind, CASE WHEN kind IN ('note', 'ask') THEN at_time END AS at,
    CASE WHEN kind IN ('note', 'ask') THEN r ELSE trim(kind || ' ' || at_time) || CASE WHEN r = '' THEN '' ELSE chr(10) || chr(10) || r END END AS body, '[parsed: rule=' || kind || ']' AS parsed, '[time: ' || id || ' ms]' AS took FROM a""",
)
def _(r: Records) -> DataFrame:
    flat = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\n"), F.lit(" "))
    kind = F.coalesce("kind", F.lit(""))
    text = F.concat(F.lit("before\n> "), flat("input_text"), F.lit("\n"), F.trim(F.concat_ws(" ", kind, "at")), F.lit("\n\n"), flat("response_text"), F.lit("\n[parsed: rule="), kind, F.lit("]\n[time: "), F.col("id").cast("string"), F.lit(" ms]\n"))
    texts = r.of("activity", "id", "input_text", "response_text", "kind", "at").where("input_text IS NOT NULL").select("id", text.alias("text"))
    return L.sections(texts, "id", "text", "> ", ("note", "ask"))


@R.add("s8_archived_days", "SELECT strftime(at_time, '%Y-%m-%d') AS day, count(*) AS n_rows FROM x_events GROUP BY 1")
def _(r: Records) -> DataFrame:
    path = L.scratch(r.spark, "archive")
    L.archive_by_day(r.events.select("id", "category", F.date_format("at", "yyyy-MM-dd").alias("event_day")), "event_day", path)
    return r.spark.read.schema("id long, category string, event_day string, day string").json(path).groupBy("day").agg(N().alias("n_rows"))


_NAMES = ("persons", "notes", "expenses", "ledger", "weights", "activity_log", "parse_write", "heldout_cases", "documents", "note_vectors", "note_tombstones", "lang_labels", "nicknames", "mix_targets", "pack_capacities", "events", "embeddings", "region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@R.add("s9_columns", "SELECT table_name AS relation, column_name, cast(ordinal_position - 1 AS INTEGER) AS position FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{n}'" for n in _NAMES) + ")")
def _(r: Records) -> DataFrame:
    return L.columns_of(r.spark, r.folder, _NAMES).select("relation", "column_name", "position")


@R.add("s11_padded", "SELECT id, rpad(cast(id AS VARCHAR), (SELECT max(length(cast(id AS VARCHAR))) FROM x_persons)::INTEGER, ' ') || ' | ' || rpad(name, (SELECT max(length(name)) FROM x_persons)::INTEGER, ' ') AS line FROM x_persons")
def _(r: Records) -> DataFrame:
    return L.padded(r.persons.select("id", "name"), ("id", "name")).select("id", "line")


# Guarded SQL


@R.add("g_guarded_sql", "SELECT group_key, cast(sum(cast(amount AS DECIMAL(30,4))) AS DOUBLE) AS total FROM x_expenses WHERE event_day >= '2025-06-01' GROUP BY group_key ORDER BY total DESC LIMIT 100")
def _(r: Records) -> DataFrame:
    sql = "SELECT group_key, cast(sum(cast(amount AS DECIMAL(30,4))) AS DOUBLE) AS total FROM expenses WHERE event_day >= ? GROUP BY group_key ORDER BY total DESC"
    return G.guarded(r.spark, {"expenses": r.expenses, "ledger": r.ledger}, sql, ["2025-06-01"])


_TRIED = ("SELECT * FROM expenses", "DROP TABLE expenses", "SELECT * FROM notes", "WITH notes AS (SELECT 1 AS x FROM expenses) SELECT * FROM notes", "SELECT reflect('a', 'b') FROM expenses", "SELECT 1; SELECT 2", "SELECT 1", "INSERT INTO ledger VALUES (1)")
_ACCEPTED = {_TRIED[0], _TRIED[3]}


@R.add("g_verdicts", "SELECT * FROM (VALUES " + ", ".join(f"('{t.replace(chr(39), chr(39) * 2)}', {str(t in _ACCEPTED).lower()})" for t in _TRIED) + ") v(statement, ok)")
def _(r: Records) -> DataFrame:
    verdicts = [(t, G.validate(r.spark, t, ("expenses", "ledger")).ok) for t in _TRIED]
    return r.spark.createDataFrame(verdicts, "statement string, ok boolean")


# Streams

_DAY = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@R.add("st1_windowed_counts", "SELECT strftime(time_bucket(INTERVAL 15 MINUTE, at_time), '%Y-%m-%d %H:%M:%S') AS window_start, category AS event_type, count(*) AS n_events, cast(sum(cast(value AS DECIMAL(30,4))) AS DOUBLE) AS value FROM x_events GROUP BY 1, 2")
def _(r: Records) -> DataFrame:
    out = ST.drain(ST.windowed_counts(ST.event_stream(r.spark, r.folder), late="3650 days"), "windows")
    return out.withColumn("window_start", _DAY("window_start"))


@R.add("st2_sessions", """WITH g AS (SELECT user_id, at_time, CASE WHEN at_time - lag(at_time) OVER (PARTITION BY user_id ORDER BY at_time) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM x_events),
    s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY at_time ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, strftime(min(at_time), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n_events FROM s GROUP BY user_id, n""")
def _(r: Records) -> DataFrame:
    out = ST.drain(ST.sessions(ST.event_stream(r.spark, r.folder), late="3650 days"), "sessions")
    return out.select("user_id", _DAY("session_start").alias("session_start"), "n_events")


@R.add("st3_first_deliveries", "SELECT count(*) AS n_events, count(DISTINCT id) AS n_ids FROM x_events")
def _(r: Records) -> DataFrame:
    out = ST.drain(ST.first_deliveries(ST.event_stream(r.spark, r.folder), late=None).select("event_id", "at"), "deliveries", mode="append")
    return out.agg(N().alias("n_events"), F.count_distinct("event_id").alias("n_ids"))


@R.add("st4_memo", "SELECT cast(user_id AS VARCHAR) AS pattern, count(*) AS hit_count, arg_max(category, (at_time, id)) AS resolved FROM x_events GROUP BY user_id")
def _(r: Records) -> DataFrame:
    return ST.memo_stream(ST.event_stream(r.spark, r.folder), "user_id", "event_type").select("pattern", "hit_count", "resolved")


QUERIES, SQL = R.queries, R.sql
