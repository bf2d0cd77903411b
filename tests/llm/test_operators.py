"""Operators on texts, names, splits, containers and mixes: values, brute force and edge cases."""

import itertools
import random

import pytest

pytest.importorskip("tallyloom.llm")

from tallyloom.llm import language, mixing, names, overlap, packing, privacy, tokens, truncation  # noqa: E402

LONG = "word " * 60_000


# Personal details -----------------------------------------------------------------------------------------------------

TEXTS = "src_table string, row_id long, text string, kind string, start_pos long"
PERSONS = "id long, name string, term string"
NICKS = "given_name string, nickname string, term string"


def _items(spark, texts, people=("anbelu dorthoneksha", "joy raddilnadhi", "new corner bakery", None), nicks=(("anbelu", "belui"),)):
    t = spark.createDataFrame([("notes", i, x, "k", 1) for i, x in texts], TEXTS)
    p = spark.createDataFrame([(i, n, "t") for i, n in enumerate(people)], PERSONS)
    n = spark.createDataFrame([(a, b, "t") for a, b in nicks], NICKS)
    return t, privacy.find_items(t, p, n)


ITEMS = [
    ("mail a.b+c@mail.example about it", [("email", "a.b+c@mail.example")]),
    ("wrote to joe_x (at) post dot example, no answer", [("email", "joe_x (at) post dot example")]),
    ("Bought 2 @ 08 each, tagged it @home", []),
    ("call +44 7700 900 343 or (201) 555-0123 now", [("phone", "+44 7700 900 343"), ("phone", "(201) 555-0123")]),
    ("plumber 020 7946 0332, 55675-91740, 0491 570 156", [("phone", "020 7946 0332"), ("phone", "55675-91740"), ("phone", "0491 570 156")]),
    ("passport no Z0090173 and 000-34-3633", [("idnum", "Z0090173"), ("idnum", "000-34-3633")]),
    ("passport no Z0090174 or passport no 4770 0547 0379", [("idnum", "Z0090174"), ("idnum", "4770 0547 0379")]),
    ("invoice no 4770 0547 0379, order ref 2025185357, version 3.45.1, 2019-2024", []),
    ("Pickup from Flat 3B, 209 Brick Kiln Ave, Old Tarvin at ten", [("address", "Flat 3B, 209 Brick Kiln Ave, Old Tarvin")]),
    ("Walked along Temple Tank Road till 18:30.", []),
    ("au 34 ter rue des Tilleuls Bleus la semaine", [("address", "34 ter rue des Tilleuls Bleus")]),
    ("va a C/ Molino Seco 226, 3º B la semana", [("address", "C/ Molino Seco 226, 3º B")]),
    ("die Adresse Eschenkampstraße 90b gehen", [("address", "Eschenkampstraße 90b")]),
    ("Gave Mrs. Anbelu Sushtan 5 for tea", [("name", "Anbelu Sushtan")]),
    ("asked belui to wait", [("name", "belui")]),
    ("Met Dr. Xerxion Vantek near the gate", [("name", "Xerxion Vantek")]),
    ("paid new corner bakery 58", []),
]


def test_items(spark):
    _, items = _items(spark, [(i, text) for i, (text, _) in enumerate(ITEMS)])
    got = {i: [] for i in range(len(ITEMS))}
    for r in sorted(items.collect(), key=lambda r: (r["row_id"], r["start_pos"])):
        got[r["row_id"]].append((r["kind"], ITEMS[r["row_id"]][0][r["start_pos"] : r["end_pos"]]))
    assert list(got.values()) == [want for _, want in ITEMS]


def test_words_that_are_also_names(spark):
    texts = [(i, f"It was a joy to cook today, day {i}.") for i in range(40)]
    texts += [(100 + i, f"Asked {w} to help") for i, w in enumerate(["Joy", "Anbelu", "Belui", "anbelu", "belui"] * 4)]
    _, items = _items(spark, texts)
    got = {r["row_id"] for r in items.collect()}
    assert got == set(range(100, 120))


def test_names_outside_the_tables(spark):
    """Names that no table has are found by the places they share with known ones; words of phrases are not."""
    known = [f"name{c}o" for c in "abcdefghij"]
    texts = [(i, f"Asked {k.capitalize()} to wait") for i, k in enumerate(known * 3)] + [(100 + i, f"Met Dr. {k.capitalize()} outside") for i, k in enumerate(known)]
    texts += [(200 + i, "Asked Zubiria to wait") for i in range(2)] + [(300 + i, f"went on Friday for {k}") for i, k in enumerate(["tea", "milk", "rice"] * 4)]
    _, items = _items(spark, texts, people=[f"{k} long der surname" for k in known], nicks=())
    got = {r["row_id"] for r in items.collect() if r["kind"] == "name"}
    assert got >= set(range(30)) | {200, 201} and not got & set(range(300, 312))


def test_long_names_and_contexts(spark):
    _, items = _items(spark, [(1, "Asked maria to wait"), (2, "passport " + "x" * 90 + " no 4770 0547 0379"), (3, "passport " + "x" * 90 + " no Z0090173")], people=("maria del carmen zubiria",), nicks=())
    assert {(r["row_id"], r["kind"]) for r in items.collect()} == {(1, "name"), (2, "idnum"), (3, "idnum")}


def test_sanitised_text_and_edges(spark):
    texts = [(1, "Mail a@b.example or Anbelu 🙂 at once"), (2, None), (3, ""), (4, LONG + " a@b.example"), (1, "Mail a@b.example or Anbelu 🙂 at once")]
    t, items = _items(spark, texts)
    out = {r["row_id"]: r["text"] for r in privacy.sanitise(t, items).collect()}
    assert out[1] == "Mail [EMAIL] or [NAME] 🙂 at once" and out[2] is None and out[3] == "" and out[4].endswith("[EMAIL]")
    t, items = _items(spark, [], people=(), nicks=())
    assert items.count() == 0 and privacy.sanitise(t, items).count() == 0


# Languages ------------------------------------------------------------------------------------------------------------

SAMPLE = {
    "en": "the neighbour lent us a lamp and we have to give it back soon after the long walk to the market",
    "de": "der nachbar hat uns eine lampe geliehen und wir müssen sie bald nach dem langen weg zum markt zurückgeben",
    "es": "el vecino nos prestó una lámpara y hay que devolverla pronto después del largo camino al mercado",
}


def test_longest_matches_against_brute_force():
    rnd = random.Random(3)
    text = "".join(rnd.choice("abc") for _ in range(120))
    codes: dict = {}
    a = language.Automaton(text, codes)
    for _ in range(60):
        s = "".join(rnd.choice("abc") for _ in range(30))
        n, at = 1, 0
        for i in range(1, len(s) + 1):
            if s[at:i] not in text:
                n, at = n + 1, i - 1
        assert a.phrases([codes[c] for c in s]) == n


def test_segments():
    m = language.Model({k: f" {v} " * 2 for k, v in SAMPLE.items()})
    assert [s[0] for s in m.segments("Der Nachbar hat uns eine Lampe geliehen.", 5.5)[0]] == ["de"]
    mixed, _ = m.segments("The neighbour lent us a lamp. El vecino nos prestó una lámpara y hay que devolverla. The long walk to the market.", 5.5)
    assert [s[0] for s in mixed] == ["en", "es", "en"]
    assert m.segments("", 5.5) == ([], []) and m.segments("123 !!", 5.5) == ([], [])


def test_labels(spark):
    texts = spark.createDataFrame(
        [("notes", 1, SAMPLE["de"], 0), ("notes", 2, SAMPLE["en"], 0), ("notes", 3, SAMPLE["es"], 0), ("notes", 4, None, 0), ("notes", 5, "", 0), ("notes", 2, SAMPLE["en"], 0), ("notes", 6, SAMPLE["en"] + ". " + SAMPLE["es"], 0)],
        "src_table string, row_id long, text string, state int",
    )
    labels = spark.createDataFrame([("notes", 1, "German", 1), ("notes", 2, "de-DE", 1), ("notes", 3, "??", 1), ("notes", 6, "EN", 1), ("notes", None, "en", 1)], "src_table string, row_id long, lang_label string, segments int")
    model = {k: f" {v} " for k, v in SAMPLE.items()}
    got = language.found(language.judge(texts, labels, model)).collect()
    assert {(r["row_id"], r["seg_no"], r["lang"]) for r in got} == {(2, 0, "en"), (3, 0, "es"), (6, 1, "en"), (6, 2, "es")}
    none = language.judge(texts.limit(0), labels.limit(0), {})
    assert none.count() == 0
    assert language.fit(texts.selectExpr("text", "'de' lang").limit(0)) == {}


# Names ----------------------------------------------------------------------------------------------------------------


def _links(spark, typed, people, nicks=(("benoric", "benoko"),)):
    s = spark.createDataFrame([(x, 1) for x in typed], "spelling string, id long")
    p = spark.createDataFrame([(i, n, "c") for i, n in people], "id long, name string, cost string")
    n = spark.createDataFrame([(a, b, "f") for a, b in nicks], "given_name string, nickname string, form string")
    return {r["spelling"]: r["person_id"] for r in names.link_spellings(s, p, n).collect()}


PEOPLE = [(1, "benoric tohohorshi"), (2, "selvomi natadvugo"), (3, "selvomi sandekleksu"), (4, "sri masuren traders"), (5, "morviprelil"), (6, "amrisa natadvugo"), (1, "benoric tohohorshi"), (7, None)]


SPELLINGS = [
    ("Benoric Tohohorshi", 1), ("tohohorshi, benoric", 1), ("TOHOHORSHI BENORIC", 1), ("benoric_tohohorshi", 1), ("benorictohohorshi", 1), ("Mr. Benoric M. Tohohorshi (office)", 1),
    ("benoko tohohorshi", 1), ("b. tohohorshi", 1), ("benoric toho.", 1), ("benroic tohohorshi", 1), ("benoric tohohrshii", 1), ("bnoric tohohoshi - neighbour", 1),
    ("s. natadvugo", 2), ("selvomi natad", 2), ("selvomi", None), ("natadvugo", None), ("selvomi prejohempor", None), ("M/S MASUREN", 4), ("shri masuren trdrs pvt ltd", 4), ("masuren & co", 4),
    ("morviprelil anna", 5), ("morvipreli", 5), ("self", None), ("", None), ("  ", None), ("🙂", None), ("1234", None),
]


def test_spellings(spark):
    typed = [t for t, _ in SPELLINGS]
    assert _links(spark, [*typed, None, typed[0]], PEOPLE) == dict(SPELLINGS)


def test_spellings_that_fit_two(spark):
    people = [(1, "anna keller"), (2, "arno keller")]
    assert _links(spark, ["a. keller", "anna keler"], people) == {"a. keller": None, "anna keler": 1}
    assert _links(spark, [], []) == {}
    assert _links(spark, ["x" * 3000], PEOPLE) == {"x" * 3000: None}


# Overlaps -------------------------------------------------------------------------------------------------------------


RECORDS = [
    ("expense: rs 390 flower bunch, 530 locker rent", "pls add Flower  Bunch ₹390 / locker rent 530 rs !!", True),
    ("buy: 100 g tea, 2kg rice, For the trip", "shopping: 100g tea + 2 kg rice + for the trip (voice)", True),
    ("expense: tea 20, milk 30, rice 40", "expense: milk 30, tea 20, rice 40", True),
    ("expense: tea 20, milk 30, rice 40", "expense: tea 30, milk 20, rice 40", False),
    ("gave Anbelu Dorthoneksha 20, got 30 back from Velmurin", "gave Anbleu Dorthoneksha 20, got 30 back from Velmurn", True),
    ("gave Anbelu Dorthoneksha 20, got 30 back from Velmurin", "gave Sohrani Dorthoneksha 20, got 30 back from Velmurin", False),
    ("tea 20, milk 30, paid on Monday", "tea 20, milk 30, paid on Sunday", False),
    ("tea 20, milk 30", "tea 20, milk 31", False),
    ("todo: call the plumber tomorrow", "Todo - call the plumer tomorrow", True),
    ("todo: call the plumber tomorrow", "todo: call the plumber today", False),
]


def test_overlaps(spark):
    h = spark.createDataFrame([(f"h{i}", a, "k") for i, (a, _, _) in enumerate(RECORDS)] + [("n", None, "k"), ("e", "", "k"), ("h0", RECORDS[0][0], "k")], "id string, input string, key string")
    t = spark.createDataFrame([(i, b, 1) for i, (_, b, _) in enumerate(RECORDS)] + [(100, None, 1), (101, "something else 5, and 6", 1), (0, RECORDS[0][1], 1)], "id long, input string, held_id long")
    got = {(r["held_id"], r["train_id"]) for r in overlap.find_overlaps(h, t).collect()}
    for i, (a, b, same) in enumerate(RECORDS):
        assert ((f"h{i}", i) in got) is same, (a, b)
    assert {x for x, _ in got} <= {f"h{i}" for i in range(len(RECORDS))} and not {y for _, y in got} & {100, 101}


def test_overlaps_edges(spark):
    h = spark.createDataFrame([("h1", LONG + "5 6", "k")], "id string, input string, key string")
    t = spark.createDataFrame([(i, LONG + "5 6", 1) for i in range(3)], "id long, input string, held_id long")
    assert {r["train_id"] for r in overlap.find_overlaps(h, t).collect()} == {0, 1, 2}
    held = spark.createDataFrame([("h1", "e", "s"), ("h2", "e", None)], "id string, split string, source string")
    rep = {r["source"]: r for r in overlap.overlap_report(h, t, held).collect()}
    assert rep["s"]["share"] == 1.0 and rep["s"]["n_pairs"] == 3 and rep[None]["n_overlapping"] == 0
    assert overlap.find_overlaps(h.limit(0), t.limit(0)).count() == 0


SLIPS = [("call plumbr tomorow", "call plumber tomorrow"), ("grocries", "groceries"), ("grocries 500", "groceries 500"), ("tothpaste 40", "tooth paste 40"), ("call plumber mother brothers tomorrow evening", "call plmber mothr brothers tomorrow evening"), ("wintrcoatsx", "wintercoats")]


@pytest.mark.parametrize("a,b", SLIPS)
def test_same_records_share_a_key(a, b):
    x, y = overlap.canonical(a), overlap.canonical(b)
    assert overlap.same_record(x, y) and set(overlap.block_keys(x)) & set(overlap.block_keys(y))


def test_keys_are_bounded_and_complete():
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcdefghijklmno") for _ in range(n))
    for n in (1, 2, 3, 20, 300, 5000):
        assert len(overlap.block_keys(" ".join(word(8) for _ in range(n)))) <= 450
    assert len(overlap.block_keys("x" * 100_000)) < 300
    for _ in range(400):
        w = word(rnd.choice([3, 4, 5, 8, 12, 13, 14, 15, 20, 40]))
        v = w
        for _ in range(1 if len(w) < 5 else 2):
            i = rnd.randrange(len(v))
            v = rnd.choice([v[:i] + v[i + 1 :], v[:i] + rnd.choice("pqr") + v[i:], v[:i] + "z" + v[i + 1 :], v[:i] + v[i : i + 2][::-1] + v[i + 2 :]])
        if overlap.same_word(w, v):
            assert overlap.slip_keys(w) & overlap.slip_keys(v), (w, v)


def test_crowded_keys_lose_no_link(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijklmno") for _ in range(7))
    texts = [f"paid {word()} {word()} {word()} 40, {word()} 50" for _ in range(60)] + [f"{word()} 40 and 50" for _ in range(10)]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, input string")
    h = spark.createDataFrame([(f"h{i}", x.replace("paid ", "pad ") if i % 2 else x[:-4] + "x" + x[-4:]) for i, x in enumerate(texts)], "id string, input string")
    got = {(r["held_id"], r["train_id"]) for r in overlap.find_overlaps(h, t, crowded=10).collect()}
    assert got == {(r["held_id"], r["train_id"]) for r in overlap.find_overlaps(h, t).collect()} and len(got) >= 60


# Containers -----------------------------------------------------------------------------------------------------------


def _least_bins(sizes, capacity):
    """The fewest containers, by trying all assignments."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[k] >= sizes[i]:
                rooms[k] -= sizes[i]
                go(i + 1, rooms)
                rooms[k] += sizes[i]
        rooms.append(capacity - sizes[i])
        go(i + 1, rooms)
        rooms.pop()

    go(0, [])
    return best


def test_reduction_keeps_an_optimum():
    rnd = random.Random(4)
    for _ in range(60):
        capacity = rnd.choice([10, 17, 30])
        sizes = sorted((rnd.randint(1, capacity) for _ in range(9)), reverse=True)
        fixed, rest = packing.reduce_dominated(sizes, capacity)
        assert sorted(itertools.chain(*fixed, rest.order)) == list(range(9))
        assert all(sum(sizes[i] for i in b) <= capacity for b in fixed)
        assert len(fixed) + _least_bins(sorted(rest.sizes, reverse=True), capacity) == _least_bins(sizes, capacity)


def test_blocks_hold_every_item():
    rnd = random.Random(5)
    sizes = [rnd.randint(0, 50) for _ in range(500)]
    bins = packing.pack_block(sizes, 64)
    assert sorted(itertools.chain(*bins)) == list(range(500))
    assert all(sum(sizes[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= 1.03 * -(-sum(sizes) // 64) + 1
    assert packing.pack_block([], 5) == [] and packing.pack_block([0, 0], 5) == [[0, 1]]


DOCS = "doc_id long, text string, source string, tokens string, block long, bucket long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "t", 1, 2) for i, t, s in rows], DOCS)


def test_containers(spark):
    docs = _docs(spark, [(1, "a b c d e f g h i j k", "s"), (2, "a b", "s"), (3, "", "s"), (4, None, "s"), (None, "a", "s"), (5, "c d e", None), (2, "a b", "s"), (6, LONG, "s")])
    packs = spark.createDataFrame([("p", 5, 1), ("p", 5, 1), ("q", 1000000, 1), ("none", None, 1), ("zero", 0, 1)], "pack_name string, capacity_tokens long, doc_id long")
    got = packing.fill_containers(docs, packs).collect()
    for name, cap in (("p", 5), ("q", 1000000)):
        own = [r for r in got if r["pack_name"] == name]
        parts = [(p["doc_id"], p["part_no"], p["tokens"]) for r in own for p in r["parts"]]
        assert {d for d, _, _ in parts} == {1, 2, 3, 5, 6} and len(parts) == len({(d, k) for d, k, _ in parts})
        assert all(r["fill_tokens"] == sum(p["tokens"] for p in r["parts"]) <= cap for r in own)
        assert sum(n for d, _, n in parts if d == 1) == 11
        assert {k for d, k, _ in parts if d == 2} == {0}
    assert {k for r in got if r["pack_name"] == "p" for p in r["parts"] if p["doc_id"] == 1 for k in [p["part_no"]]} == {1, 2, 3}
    assert packing.fill_containers(docs.limit(0), packs).count() == 0 and packing.fill_containers(docs, packs.limit(0)).count() == 0


def test_token_counts_match_the_same_vocabulary_in_another_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    texts = ["", "hello  world", "வணக்கம் 123", "a<|endoftext|>b", "x" * 500, "\n\n  tab\t"]
    t.encode_special_tokens = True
    got = tokens.with_tokens(_docs(spark, [(i, x, "s") for i, x in enumerate(texts)]).drop("tokens")).orderBy("doc_id").collect()
    assert [r["tokens"] for r in got] == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


# Mixes ----------------------------------------------------------------------------------------------------------------


def test_water_fill():
    wanted, caps = {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.1}, {"a": 1000, "b": 60, "c": 1000}
    got = mixing.water_fill(wanted, caps, 400)
    assert got["b"] == 60 and got["d"] == 0 and sum(got.values()) == pytest.approx(400)
    assert got["a"] / got["c"] == pytest.approx(2.5)
    assert sum(mixing.water_fill(wanted, caps, 1e9).values()) == pytest.approx(2060)
    assert mixing.water_fill({}, {}, 5) == {} and mixing.exact_total({"a": 1.0}, {}) == 0
    assert mixing.exact_total({"a": 0.5, "b": 0.5}, {"a": 10, "b": 100}) == 20


def test_mixes(spark):
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.randint(1, 30), "big" if i % 3 else "small") for i in range(600)] + [(601, None, "big"), (602, "", "big"), (603, "a", None), (5, None, "big")]
    targets = spark.createDataFrame([("m", "big", 0.5, 1, 1), ("m", "small", 0.4, 3, 1), ("m", "gone", 0.1, 3, 1), ("m", "big", 0.5, 1, 1), ("n", "gone", 1.0, 2, 1), (None, "big", 1.0, 1, 1)], "mix_name string, source string, target_share double, max_repeats long, tokens long")
    chosen, shares = mixing.draw(_docs(spark, rows), targets)
    got = {(r["mix_name"], r["source"]): r for r in shares.collect()}
    assert got[("m", "big")]["actual_share"] == pytest.approx(5 / 9, abs=0.01)
    assert got[("m", "gone")]["drawn_tokens"] == 0 and got[("n", "gone")]["actual_share"] is None
    for r in chosen.collect():
        assert 1 <= r["repeats"] <= (1 if r["source"] == "big" else 3)
    again, _ = mixing.draw(_docs(spark, rows[::-1]), targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen.collect()))
    full = {r["source"]: r for r in mixing.draw(_docs(spark, rows), targets, times=1.0)[1].where("mix_name = 'm'").collect()}
    assert full["big"]["epochs"] <= 1 and full["small"]["epochs"] <= 3
    empty, none = mixing.draw(_docs(spark, []), targets.limit(0))
    assert empty.count() == 0 and none.count() == 0


# Truncation -----------------------------------------------------------------------------------------------------------

SENTENCES = ["The budget for this month is small.", "We need brown rice for the guests.", "They promised to call the plumber soon.", "Lunch at the old bakery was good!", "Nothing important happened on the way."]


def _cut(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s, "x", 1.0) for i, t, s in rows], "id long, text string, lang string, source string, cut string, odds double")
    return {r["id"] for r in truncation.truncated(df).where("cut").collect()}


def test_truncated_texts(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice(SENTENCES) for _ in range(8)), "a") for i in range(150)]
    whole = rows[0][1]
    rows += [(200, whole[:-1], "a"), (201, whole + "\n-- J.", "a"), (202, whole + " 🙂", "a"), (203, whole + " ...", "a"), (204, "", "a"), (205, None, "a"), (206, "ok", "b"), (207, "🙂", "b")]
    rows += [(300, whole + " The budget for th", "a"), (301, whole + " They promised to", "a"), (302, whole + " We need brown r…", "a"), (303, whole + " We nee�", None), (304, LONG + ". We need brown rice for", "a")]
    rows += [(300, whole + " The budget for th", "a")]
    assert _cut(spark, rows) == {300, 301, 302, 303, 304}
    assert _cut(spark, []) == set()
    rep = truncation.report(truncation.truncated(spark.createDataFrame([(1, "a.", None, None)], "id long, text string, lang string, source string"))).collect()
    assert rep[0]["n_documents"] == 1 and rep[0]["n_cut"] == 0


def test_context_hashes_don_t_depend_on_the_place():
    import numpy as np

    a = truncation.hashes(truncation._codes("\0" * 40 + "something long enough for all lengths here"))
    b = truncation.hashes(truncation._codes("prefix of another kind that is longer: something long enough for all lengths here"))
    assert all(a[n][-1] == b[n][-1] for n in (4, 8, 16, 32)) and np.unique(b[32]).size > 40


def test_filters_in_parts_and_hidden_windows(spark):
    """Contexts dealt to several filters give the same odds; a long run of capitalised words is hidden before it is cut."""
    rnd = random.Random(9)
    words = ["market", "Garden", "lamp", "walked", "Wednesday", "home", "again", "slowly"]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(12)) + rnd.choice([".", "", " lam"]), "en", "s") for i in range(300)]
    df = spark.createDataFrame(texts, "id long, text string, lang string, source string")
    one = {r["id"]: r["odds"] for r in truncation.end_odds(df).collect()}
    assert one == {r["id"]: r["odds"] for r in truncation.end_odds(df, max_bits=1 << 13).collect()}
    run = "we met " + "Donaudampfschifffahrtsgesellschaftskapitaen " * 12 + "at the gate"
    assert truncation.final_keys(run)[-1] == truncation.final_keys("so we met " + "Anna " * 12 + "at the gate")[-1]


def test_keys_of_many_texts():
    texts = ["", "a", "so we met Anna and Bela at the gate yesterday, all of us", "x" * 31, "y" * 33, "\U0001f642 ठीक है Zug um Zug", "Ab" * 40]
    assert truncation.final_keys_of(texts).tolist() == [truncation.final_keys(t) for t in texts]
