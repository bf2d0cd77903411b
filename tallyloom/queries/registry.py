"""Registration of queries with the SQL they are held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.sources.records import Records

#: Relations of ``Records`` in SQL; a query's SQL gets those it names.
RELATIONS = {
    "x_persons": "SELECT DISTINCT id, name, created_at FROM persons",
    "x_expenses": "SELECT *, coalesce(substr(trim(date), 1, 10), substr(trim(created_at), 1, 10)) AS event_day, lower(trim(group_name)) AS group_key FROM (SELECT DISTINCT id, amount, description, date, group_name, source_note_id, created_at FROM expenses)",
    "x_ledger": "SELECT id, lower(trim(person)) AS person, amount, direction, note, date, source_note_id, created_at, coalesce(substr(trim(date), 1, 10), substr(trim(created_at), 1, 10)) AS event_day FROM (SELECT DISTINCT id, person, amount, direction, note, date, source_note_id, created_at FROM ledger)",
    "x_weights": "SELECT id, lower(trim(person)) AS person, weight, date, note, created_at, substr(trim(date), 1, 10) AS event_day FROM (SELECT DISTINCT id, person, weight, date, note, created_at FROM weights)",
    "x_notes": "SELECT *, substr(trim(created_at), 1, 10) AS event_day FROM (SELECT DISTINCT id, content, input_kind, structured_type, note_domain, metadata_json, created_at, processed_at FROM notes)",
    "x_vectors": "SELECT DISTINCT id, domain, content, embedding, source, date, source_note_id, created_at FROM note_vectors",
    "x_activity": "SELECT *, replace(trim(created_at), 'T', ' ') AS at_time FROM (SELECT DISTINCT id, input_text, response_text, kind, metadata_json, created_at FROM activity_log)",
    "x_writes": "SELECT DISTINCT ON (id) id, anchor_date, input, output, split, source FROM parse_write",
    "x_lanes": "SELECT id * 100 + i - 1 AS id, lane, split, r.* FROM (SELECT id, output.lane AS lane, split, unnest(output.records) AS r, generate_subscripts(output.records, 1) AS i FROM x_writes)",
    "x_todos": "SELECT id, text AS content, date, CASE WHEN split = 'valid' THEN 'done' ELSE 'pending' END AS status FROM x_lanes WHERE lane = 'todo'",
    "x_buy": "SELECT id, item_text, quantity_text, unit_text, date, CASE WHEN split = 'valid' THEN 'done' ELSE 'open' END AS status FROM x_lanes WHERE lane = 'buy'",
    "x_events": "SELECT event_id AS id, ts AS at_time, event_type AS category, CASE WHEN value IS NULL THEN 'error' WHEN value > 100 THEN 'warning' ELSE 'info' END AS severity, user_id, value, props FROM events",
    "x_balance": "SELECT person, sum(CASE WHEN direction = 'gave' THEN 1 ELSE -1 END * cast(amount AS DECIMAL(30,4))) AS balance FROM x_ledger GROUP BY person",
}
NEEDS = {"x_lanes": {"x_writes"}, "x_todos": {"x_lanes", "x_writes"}, "x_buy": {"x_lanes", "x_writes"}, "x_balance": {"x_ledger"}}


def with_relations(sql: str) -> str:
    named = set(re.findall(r"\bx_\w+", sql)) & set(RELATIONS)
    for n in list(named):
        named |= NEEDS.get(n, set())
    if not named:
        return sql
    parts = ", ".join(f"{n} AS ({RELATIONS[n]})" for n in RELATIONS if n in named)
    body = sql.strip()
    return f"WITH {parts}, {body[4:].strip()}" if body[:5].upper() == "WITH " else f"WITH {parts} {body}"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Registers a function of :class:`Records`; ``sql`` may name the ``x_`` relations."""

        def keep(f: Callable[[Records], DataFrame]):
            self.queries[name] = lambda spark, folder: f(Records(spark, folder))
            if sql is not None:
                self.sql[name] = with_relations(sql)
            return f

        return keep
