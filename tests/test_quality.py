"""Spikes, trailing totals and orphan references: values, brute force and edge cases."""

import datetime as dt
import random

import pytest

from tallyloom.operators import orphans, spikes, trailing

D0 = dt.date(2025, 1, 1)
WEIGHTS = "id long, person string, weight double, date string, extra string, source string, value double, _n long"
EXPENSES = "id long, amount double, description string, date string, group_name string, source_note_id long, created_at string, entity string, _e string, day string"
NOTES = "id long, content string, created_at string, state string"
STONES = "note_id long, deleted_at string, reason string, id long"
VECTORS = "id long, source_note_id long, created_at string, state string"


def _weights(spark, rows):
    return spark.createDataFrame([(i, p, w, d, "x", "y", 1.0, 7) for i, p, w, d in rows], WEIGHTS)


def _flagged(spark, rows):
    out = spikes.implausible(spikes.weight_readings(_weights(spark, rows))).collect()
    return {r["reading_id"]: tuple(r["reasons"]) for r in out}


def _series(person, base, n, start=0, step=3, rnd=None):
    rnd = rnd or random.Random(1)
    return [[start + i, person, round(base + rnd.gauss(0, 0.6), 1), (D0 + dt.timedelta(days=i * step)).isoformat()] for i in range(n)]


def test_spikes_levels_and_stuck(spark):
    a = _series(" Anna", 60, 80)
    a[30][2], a[50][2] = 6.0, 90.5  # spikes that return
    b = _series("bela", 80, 80, start=1000)
    for r in b[40:]:
        r[2] = round(r[2] + 12, 1)  # a lasting change of level
    c = _series("carl", 70, 80, start=2000)
    for r in c[20:38]:
        r[2] = 70.3  # frozen
    d = [[3000 + i, "dora", float(50 + (i // 12) % 2), (D0 + dt.timedelta(days=i)).isoformat()] for i in range(80)]  # a coarse scale
    e = [[4000 + i, "baby", round(3.5 + 0.06 * i, 2), (D0 + dt.timedelta(days=4 * i)).isoformat()] for i in range(80)]  # growth
    e[10][2], e[11][2] = 0.0, 2000.0
    got = _flagged(spark, a + b + c + d + e)
    assert set(got) == {30, 50, 4010, 4011} | set(range(2020, 2038))
    assert got[4010][0] == "impossible" and got[2025] == ("stuck",) and got[30] == ("spike",)


def test_spikes_same_for_any_case_of_the_name_and_repeats(spark):
    a = _series("anna", 60, 60)
    a[25][2] = 95.0
    mixed = [[i, p.upper() if i % 2 else f" {p} ", w, d + ("T07:00:00" if i % 3 else "")] for i, p, w, d in a]
    assert set(_flagged(spark, mixed + mixed[:20])) == {25}


def test_spikes_across_block_edges(spark):
    a = _series("anna", 60, 200)
    a[31][2] = a[32][2] = 95.0
    rules = spikes.SpikeRules(block=16, days=8)
    whole = spikes.implausible(spikes.weight_readings(_weights(spark, a))).collect()
    parts = spikes.implausible(spikes.weight_readings(_weights(spark, a)), rules).collect()
    assert {r["reading_id"] for r in whole} == {r["reading_id"] for r in parts} == {31, 32}


def test_spikes_edge_cases(spark):
    assert _flagged(spark, []) == {}
    rows = [(1, None, 5.0, "2025-01-01"), (2, "a", None, "2025-01-01"), (3, "a", 50.0, None), (4, "a", 50.0, "no day"), (5, "a", float("nan"), "2025-01-02"), (6, "a", -1.0, "2025-01-03"), (None, "a", 51.0, "2025-01-04")]
    got = _flagged(spark, rows)
    assert set(got) == {5, 6} and got[6] == ("impossible",)


def _expenses(spark, rows):
    return spark.createDataFrame([(i, a, "x", d, g, n, c, "e", "f", "g") for i, a, d, g, n, c in rows], EXPENSES)


def test_trailing_against_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(300):
        g = rnd.choice(["Food ", "food", "rent", None, ""])
        d = (D0 + dt.timedelta(days=rnd.randrange(90))).isoformat()
        rows.append((i, round(rnd.uniform(-5, 50), 2), d if i % 5 else None, g, None, d + " 10:00:00"))
    got = {(r["group_name"], r["day"]): r for r in trailing.expense_trailing(_expenses(spark, rows + rows[:30])).collect()}
    key = lambda g: g.strip().lower() if g is not None else None
    days = [dt.date.fromisoformat((r[2] or r[5])[:10]) for r in rows]
    lo, hi = min(days), max(days)
    assert len(got) == len({key(r[3]) for r in rows}) * ((hi - lo).days + 1)
    for (g, on), r in got.items():
        for n in (7, 30):
            want = sum(x[1] for x, d in zip(rows, days) if key(x[3]) == g and 0 <= (on - d).days < n)
            assert r[f"total_{n}"] == pytest.approx(want, abs=1e-6)
            assert r[f"avg_{n}"] == pytest.approx(want / n, abs=1e-6)


def test_trailing_edge_cases(spark):
    assert trailing.expense_trailing(_expenses(spark, [])).count() == 0
    assert trailing.expense_trailing(_expenses(spark, [(1, 2.0, None, "a", None, "never")])).count() == 0
    one = trailing.expense_trailing(_expenses(spark, [(1, None, "2025-01-01", "a", None, None)])).collect()
    assert [r["total_7"] for r in one] == [0.0]


def test_orphans(spark):
    notes = spark.createDataFrame([(1, "a", "2025-01-01T00:00:00", "s"), (2, "b", "2025-01-05 00:00:00", "s"), (2, "b", "2025-01-05 00:00:00", "s"), (3, "c", None, "s"), (None, "d", "2025-01-01", "s")], NOTES)
    stones = spark.createDataFrame([(1, "x", None, 9), (7, "x", None, 9), (7, "y", None, 9), (None, None, None, 9)], STONES)
    exp = _expenses(spark, [(10, 1.0, None, "g", 1, "2025-02-01"), (11, 1.0, None, "g", 2, "2025-01-04T23:59:59"), (12, 1.0, None, "g", 2, "2025-01-06"), (13, 1.0, None, "g", 5, None), (14, 1.0, None, "g", None, "x"), (15, 1.0, None, "g", 3, "2025-01-01"), (11, 1.0, None, "g", 2, "2025-01-04T23:59:59")])
    vec = spark.createDataFrame([(10, 7, "2025-01-01", "s"), (11, 2, None, "s")], VECTORS)
    states = orphans.reference_states(orphans.note_references(exp, vec), notes, stones)
    got = {(r["src_table"], r["row_id"], r["state"]) for r in orphans.found(states).collect()}
    assert got == {("expenses", 10, "deleted"), ("expenses", 11, "late"), ("expenses", 13, "missing"), ("note_vectors", 10, "deleted")}
    assert sum(r["n_refs"] for r in orphans.report(states).collect()) == 4


def test_orphans_edge_cases(spark):
    none = lambda s: spark.createDataFrame([], s)
    refs = orphans.note_references(none(EXPENSES), none(VECTORS))
    assert orphans.reference_states(refs, none(NOTES), none(STONES)).count() == 0
    some = orphans.note_references(_expenses(spark, [(1, 1.0, None, "g", 4, "x")]), none(VECTORS))
    assert [r["state"] for r in orphans.reference_states(some, none(NOTES), none(STONES)).collect()] == ["missing"]


def test_bloom_filter_has_no_false_negatives(spark):
    parents = spark.range(0, 4000, 2).withColumnRenamed("id", "parent_id")
    f = orphans.KeyFilter.build(parents, "parent_id", max_bits=1 << 16)
    rows = f.test(spark.range(8000).withColumnRenamed("id", "parent_id"), "parent_id", "maybe").collect()
    hit = {r["parent_id"] for r in rows if r["maybe"]}
    assert set(range(0, 4000, 2)) <= hit
    assert len(hit) < 2600 and f.bits <= 1 << 16


def test_a_hot_reference_is_joined_once(spark):
    notes = spark.createDataFrame([(1, "a", "2025-01-02", "s")], NOTES)
    exp = spark.range(4000).selectExpr("id", "1.0 amount", "if(id % 3 = 0, 2, 1) source_note_id", "'2025-01-01' created_at")
    vec = spark.createDataFrame([], VECTORS)
    got = orphans.reference_states(orphans.note_references(exp, vec), notes, spark.createDataFrame([], STONES)).groupBy("state").count().collect()
    assert {r["state"]: r["count"] for r in got} == {"missing": 1334, "late": 2666}
