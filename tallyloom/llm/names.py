"""Variant spellings of names typed by people, linked to the entries they mean."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.runtime import cut, lookup_join

TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "smt", "mister", "madam", "master"}
SUFFIXES = {"sir", "akka", "anna", "bhai", "amma", "uncle", "aunty", "aunt", "ji", "didi", "jr", "sr", "madam"}
LEGAL = {"pvt", "private", "ltd", "limited", "llp", "inc", "co", "company", "corp", "shop", "store", "stores", "the", "and", "branch", "sri", "shri", "sree", "new", "old"}
KINDS = {
    "traders", "trdrs", "trader", "medicals", "medical", "meds", "med", "bakery", "bkry", "book", "bk", "books", "house", "hse", "cycle", "cycles",
    "works", "wks", "sons", "bros", "brothers", "tailors", "tailor", "hardware", "dairy", "electricals", "textiles", "agency", "agencies", "enterprises", "mart",
}
ORG = LEGAL | KINDS

# Costs of the rules in bits; a form shared by n entries costs log2(n) more.
ORDER, MIDDLE, LEGAL_FORM, NICK, CORE, TRUNCATED, INITIAL, EDIT = 0.3, 0.3, 0.5, 1.0, 3.0, 3.0, 4.0, 5.0


#: In place of left-out words: the form is only good for a spelling without slips.
EXACT = "="


def squeeze(text: str) -> str:
    """One writing for sounds that are written in several ways."""
    text = text.replace("oo", "u").replace("ee", "i").replace("shri", "sri")
    return re.sub(r"(.)\1+", r"\1", text)


def clean(text: str) -> list[str]:
    """Words of a typed name without remarks, titles, honorifics and numbers; 'last, first' turned round."""
    t = unicodedata.normalize("NFKC", text).casefold()
    t = re.sub(r"\([^)]*\)?|\[[^\]]*\]?", " ", t)
    t = re.sub(r"\s[-–—]\s.*$", " ", t)
    t = re.sub(r"\bm/s\b\.?", " ", t).replace("&", " and ").replace("'", "")
    if t.count(",") == 1 and all(x.strip() for x in t.split(",")):
        last, first = t.split(",")
        t = f"{first} {last}"
    words = re.findall(r"[^\W\d_]+", t)
    while len(words) > 1 and words[0] in TITLES:
        words = words[1:]
    while len(words) > 1 and words[-1] in SUFFIXES:
        words = words[:-1]
    return words


def near(a: str, b: str, most: int) -> int:
    """Edits between two words with swaps of neighbours as one edit; ``most + 1`` where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def _is_org(words: list[str]) -> bool:
    return len(words) != 1 and any(w in ORG for w in words)


def entry_forms(name: str, nicks: list[str]) -> Iterator[tuple[str, float, str]]:
    """(form, cost, rest) of every canonical rewriting of an entry's name; rest has the words a short form leaves out."""
    words = clean(name) or [name.strip().casefold()]
    if not "".join(words):
        return
    if _is_org(words):
        yield "".join(words), 0.0, ""
        plain = [w for w in words if w not in LEGAL]
        yield "".join(plain), LEGAL_FORM, ""
        core = [w for w in words if w not in ORG]
        if core:
            yield "#" + "".join(core), CORE, " ".join(w for w in words if w in ORG)
        return
    if len(words) == 1:
        yield words[0], 0.0, ""
        return
    first, last = words[0], words[-1]
    if len(words) > 2:
        yield "".join(words), 0.0, ""
    for given, cost in [(first, 0.0), *[(n, NICK) for n in nicks]]:
        yield given + last, cost, ""
        yield last + given, cost + ORDER, EXACT  # for a spelling without a space
        for k in range(3, len(last)):
            yield given + last[:k], cost + TRUNCATED, ""
    yield first[0] + last, INITIAL, ""


def spelling_forms(spelling: str) -> Iterator[tuple[str, float, str]]:
    """(form, cost, rest) under which a spelling may meet an entry."""
    words = clean(spelling)
    if not words:
        return
    yield "".join(words), 0.0, ""
    if len(words) == 2:
        yield words[1] + words[0], ORDER, ""
    plain = [w for w in words if w not in LEGAL]
    if plain and plain != words:
        yield "".join(plain), LEGAL_FORM, ""
    core = [w for w in words if w not in ORG]
    if core:
        yield "#" + core[0], 0.0, " ".join(words[: words.index(core[0])] + words[words.index(core[0]) + 1 :])
    if len(words) > 2:
        inner = [words[0], *[w for w in words[1:-1] if len(w) > 1], words[-1]]
        if inner != words:
            yield "".join(inner), MIDDLE, ""
            yield "".join(inner[1:] + inner[:1]), MIDDLE + ORDER, ""
        marks = TITLES | SUFFIXES | LEGAL
        rest = [w for w in words if min(near(w, m, 1) for m in marks if len(m) > 2) > 1 or len(w) < 3]
        if 1 < len(rest) < len(words):
            yield "".join(rest), MIDDLE + EDIT / 2, ""


def _rest_fits(mine: str, theirs: str) -> bool:
    known = theirs.split()
    return all(w in ORG or len(w) == 1 or any(w[:2] == k[:2] or near(w, k, 2) <= 2 for k in known) for w in mine.split())


def _most_edits(form: str) -> int:
    n = len(form.lstrip("#"))
    return 0 if n < 5 else 1 if n < 9 else 2


def _without(form: str, k: int) -> set[str]:
    """The form with up to ``k`` letters left out: forms within ``k`` edits share one of these."""
    out = {form}
    for i in range(1, k + 1):
        out |= {"".join(x) for x in itertools.combinations(form, len(form) - i)}
    return out


FORMS = "array<struct<form:string,cost:double,rest:string>>"


def link_spellings(spellings: DataFrame, entries: DataFrame, nicknames: DataFrame) -> DataFrame:
    """One row per distinct spelling that is not itself an entry's name: spelling, person_id (null: means none), cost.

    ``spellings``: spelling; ``entries``: id, name; ``nicknames``: given_name, nickname. Rewritings of both sides are exploded and equi-joined in
    three rounds, each for the spellings that the last left open: exact forms, then forms one and then two
    letters apart (through left-out letters, verified by edit distance). Forms of under five letters bear no edit, those of under nine
    one, all others two; an initial or a cut-off surname bears one, for too little of the name is left to bear two. The price of a link is what its rules
    cost plus log2 of the number of entries that share the form, so rare rewritings win. Where two entries
    cost the same the spelling means none.

    Forms are aggregated per form before the join, so a form that many entries share adds one row, not pairs.
    Null, blank and nameless spellings link to none; null names make no forms; an entry delivered twice counts once.
    """

    @F.pandas_udf("string")
    def given(name: pd.Series) -> pd.Series:
        return name.map(lambda n: words[0] if len(words := clean(n)) > 1 and not _is_org(words) else None)

    @F.pandas_udf(FORMS)
    def of_entry(name: pd.Series, nicks: pd.Series) -> pd.Series:
        return pd.Series([[(squeeze(f), c, r) for f, c, r in entry_forms(n, [] if k is None else list(k))] for n, k in zip(name, nicks)], dtype=object)

    @F.pandas_udf(FORMS)
    def of_spelling(text: pd.Series) -> pd.Series:
        return text.map(lambda s: [(squeeze(f), c, r) for f, c, r in spelling_forms(s)])

    people = entries.where(F.col("id").isNotNull() & F.col("name").isNotNull()).groupBy("id").agg(F.min("name").alias("name"))
    short = nicknames.where("given_name IS NOT NULL AND nickname IS NOT NULL").groupBy(F.lower(F.trim("given_name")).alias("given"))
    short = short.agg(F.array_sort(F.collect_set(F.lower(F.trim("nickname")))).alias("nicks"))  # the short forms of one name
    named = lookup_join(cut(people.withColumn("given", given("name"))), short, "given")
    forms = named.select("id", F.explode(of_entry("name", "nicks")).alias("f")).select("id", "f.*")
    forms = forms.groupBy("id", "form").agg(F.min(F.struct("cost", "rest")).alias("b")).select("id", "form", "b.*")
    least = forms.groupBy("form").agg(F.min("cost").alias("cost"), F.count(F.lit(1)).alias("shared"))
    best = forms.join(least.withColumnRenamed("cost", "least"), "form").where(F.col("cost") == F.col("least"))
    # One row per form: its entry where only one has it at that cost, else null.
    forms = cut(
        best.groupBy("form", "cost", "shared")
        .agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("rest").alias("rest"))
        .select("form", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("id"), (F.col("cost") + F.log2("shared")).alias("cost"), "rest")
    )
    typed = spellings.select("spelling").where(F.col("spelling").isNotNull()).distinct()
    typed = typed.join(people.select(F.col("name").alias("spelling")).distinct(), "spelling", "left_anti")
    asked = typed.select("spelling", F.explode(of_spelling("spelling")).alias("f")).select(
        "spelling", F.col("f.form").alias("asked"), F.col("f.cost").alias("own"), F.col("f.rest").alias("mine")
    )
    asked = cut(asked)

    @F.pandas_udf("double")
    def price(a: pd.Series, b: pd.Series, mine: pd.Series, theirs: pd.Series) -> pd.Series:
        def one(x: str, y: str, m: str, t: str) -> float | None:
            if x[:1] == "#" and not _rest_fits(m, t):
                return None
            if x == y:
                return 0.0
            k = near(x, y, min(_most_edits(x), _most_edits(y)))
            return EDIT * k if k <= min(_most_edits(x), _most_edits(y)) else None

        return pd.Series([one(*v) for v in zip(a, b, mine, theirs)], dtype="float64")

    def keyed(df: DataFrame, col: str, k: int) -> DataFrame:
        @F.pandas_udf("array<string>")
        def out(form: pd.Series) -> pd.Series:
            return form.map(lambda f: sorted(_without(f, min(k, _most_edits(f)))))

        return df.withColumn("key", F.explode(out(col))).withColumn("key", F.xxhash64("key"))

    done, open_ = None, asked
    for k in (0, 1, 2):
        # A truncated form or an initial keeps too few letters to bear two edits.
        right = forms if k < 2 else forms.where((F.col("cost") < TRUNCATED) | F.col("form").startswith("#"))
        right = right.where((F.col("rest") != EXACT) | F.lit(k == 0)).withColumnRenamed("rest", "theirs")
        if k == 0:
            pairs = open_.join(right, open_["asked"] == right["form"])
        else:
            # Exploded sides are far larger than the planner takes them for, so neither may be broadcast.
            pairs = keyed(open_, "asked", k).hint("merge").join(keyed(right, "form", k).hint("merge"), "key").drop("key").distinct()
        scored = pairs.withColumn("edits", price("asked", "form", "mine", "theirs")).where("edits IS NOT NULL")
        scored = scored.withColumn("total", F.col("own") + F.col("cost") + F.col("edits"))
        per = scored.groupBy("spelling", "id").agg(F.min("total").alias("total"))
        w = Window.partitionBy("spelling").orderBy("total", F.col("id").asc_nulls_first())
        ranked = per.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("total").over(w))
        sure = F.col("next").isNull() | (F.col("next") > F.col("total") + 0.25)
        got = cut(ranked.where("rn = 1").select("spelling", F.when(sure, F.col("id")).alias("person_id"), F.col("total").alias("cost")))
        done = got if done is None else done.unionByName(got)
        open_ = open_.join(got.select("spelling"), "spelling", "left_anti")
    return typed.join(done, "spelling", "left")


def variants(ledger: DataFrame, persons: DataFrame, nicknames: DataFrame) -> DataFrame:
    return link_spellings(ledger.select(F.col("person").alias("spelling")), persons, nicknames)
