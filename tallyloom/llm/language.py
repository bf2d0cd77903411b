"""Missing or wrong document language labels, by cross-parsing with suffix automata."""

from __future__ import annotations

import math
import re
import sys
import types
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the languages in labels, in any case and before any region mark. Fixed values.
NAMES = {
    "en": ("en", "eng", "english", "englisch", "inglés", "anglais"),
    "hi": ("hi", "hin", "hindi", "हिन्दी", "हिंदी"),
    "ta": ("ta", "tam", "tamil", "தமிழ்"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
}
LANGS = tuple(NAMES)
LANE = re.compile(r"^\s*(?:again\W+)?(?:[^\W\d_]{2,10})\s*(?::|\s-\s)\s*")
TITLE = re.compile(r"\b(Mrs?|Ms|Dr|Prof|Sra?|Srta|Herr|Frau|Mme|M|Rs|No|Nr|Núm|St|Ave)\.\s+")
CLAUSE = re.compile(r"(?<=[.!?।॥;])\s+|\s*\n+\s*|\s+/\s+|\s+[-–—]\s+|,\s+|(?<=[।॥])")
WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯऀ-෿']+[^\W\d_]*)*")
ADDRESSES = re.compile(r"\S+@\S+|https?://\S+|@\w+")


def named(label: Column) -> Column:
    """The language a label means, or null: case, region marks and the form of the name don't matter."""
    word = F.element_at(F.split(F.lower(F.trim(label)), r"[-_ (]"), 1)
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(word.isin(*names), F.lit(lang)).otherwise(out)
    return out


def clauses(text: str) -> list[str]:
    """Normalised words of each clause, in reading order: no digits, addresses or lane mark, single spaces."""
    t = text if text.isascii() else unicodedata.normalize("NFC", text)
    t = LANE.sub("", t)
    if "@" in t or "://" in t:
        t = ADDRESSES.sub(" ", t)
    if ". " in t:
        t = TITLE.sub(" ", t)
    parts = [WORD.findall(part) for part in CLAUSE.split(t.casefold()) if part]
    return [" " + " ".join(words) + " " for words in parts if words]


#: Weight of phrases in words that no training text has: mostly names.
RARE = 0.3
DECLARED = 1.0
UNUSUAL = 0.5


class Automaton:
    """Suffix automaton of a text, transitions in one dictionary keyed by state and letter."""

    def __init__(self, text: str, codes: dict[str, int]):
        width = self.width = 4096
        step: dict[int, int] = {}
        length, link, out = [0], [-1], [[]]
        last = 0
        for ch in text:
            c = codes.setdefault(ch, len(codes) + 1) % width
            cur = len(length)
            length.append(length[last] + 1), link.append(0), out.append([])
            p = last
            while p != -1 and p * width + c not in step:
                step[p * width + c] = cur
                out[p].append(c)
                p = link[p]
            if p != -1:
                q = step[p * width + c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1), link.append(link[q]), out.append(list(out[q]))
                    for x in out[q]:
                        step[clone * width + x] = step[q * width + x]
                    while p != -1 and step.get(p * width + c) == q:
                        step[p * width + c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.step = step

    def phrases(self, seq: list[int]) -> int:
        """Longest matches, one after the other, that are needed to write the sequence."""
        get, width, state, n = self.step.get, self.width, 0, 1
        for c in seq:
            to = get(state * width + c)
            if to is None:
                n += 1
                to = get(c, 0)
                if not to:
                    n += 1
            state = to
        return n


class Model:
    """One automaton per language, built from a bounded text each."""

    def __init__(self, texts: dict[str, str], usual: str = "en"):
        self.usual = usual
        self.memo: dict[str, list[float]] = {}
        self.codes: dict[str, int] = {}
        self.automata = {lang: Automaton(t, self.codes) for lang, t in sorted(texts.items()) if t}
        self.langs = list(self.automata)
        # Words of three or more languages are names and the like and say nothing; unknown words say little.
        words = {lang: set(t.split()) for lang, t in texts.items()}
        every = [w for own in words.values() for w in own]
        count: dict[str, int] = {}
        for w in every:
            count[w] = count.get(w, 0) + 1
        self.known = {w for w, n in count.items() if n < 3 or len(w) < 4}
        self.neutral = {w for w, n in count.items() if n >= 3 and len(w) >= 4}
        # A longer text is parsed in fewer phrases; the logarithm of its length is the price of a phrase.
        self.price = {lang: math.log2(max(2, len(texts[lang]))) for lang in self.langs}
        most = max(self.price.values(), default=1.0)
        self.price = {k: v / most for k, v in self.price.items()}

    def costs(self, clause: str) -> list[float]:
        known = self.known
        words = [w for w in clause.split() if w in known]
        # Unknown words are mostly names; they only count where there is nothing else.
        key = " ".join(words) if words else " ".join(w for w in clause.split() if w not in self.neutral)
        got = self.memo.get(key)
        if got is None:
            seq = [self.codes.get(ch, 0) % 4096 for ch in f" {key} "]
            weight = 1.0 if words else RARE
            got = [self.automata[x].phrases(seq) * self.price[x] * weight if key else 0.0 for x in self.langs]
            if len(self.memo) >= 50_000:
                self.memo.clear()
            self.memo[key] = got
        return got

    def segments(self, text: str, switch: float) -> tuple[list[tuple[str, float, int]], list[str]]:
        """(language, confidence, letters) of each unbroken stretch, and the languages that fit a text of one language as well.

        The stretches are the cheapest path over the clauses; a change costs ``switch``, starting in another language
        than the usual one ``UNUSUAL``. A language fits as well if it is at most ``DECLARED`` phrases dearer.
        """
        rows = clauses(text)
        if not rows or not self.langs:
            return [], []
        costs = [self.costs(r) for r in rows]
        costs[0] = [c + UNUSUAL * (x != self.usual) for c, x in zip(costs[0], self.langs)]
        k = range(len(self.langs))
        whole = [sum(c[x] for c in costs) for x in k]
        least = min(whole)
        close = [self.langs[x] for x in k if whole[x] <= least + DECLARED]
        total, back = list(costs[0]), []
        for row in costs[1:]:
            best = min(k, key=total.__getitem__)
            came = [x if total[x] <= total[best] + switch else best for x in k]
            back.append(came)
            total = [(total[x] if came[x] == x else total[best] + switch) + row[x] for x in k]
        at = min(k, key=total.__getitem__)
        path = [at]
        for came in reversed(back):
            at = came[at]
            path.append(at)
        path.reverse()
        out, i = [], 0
        while i < len(path):
            j = i
            while j < len(path) and path[j] == path[i]:
                j += 1
            sums = [sum(costs[r][x] for r in range(i, j)) for x in k]
            own = sums[path[i]]
            share = 1 / sum(2.0 ** max(-60.0, min(60.0, own - s)) for s in sums)
            out.append((self.langs[path[i]], round(share, 6), sum(len(r) - 2 for r in rows[i:j])))
            i = j
        return out, close


def _kept(texts: dict[str, str]) -> Model:
    """The model of these texts, built once per Python worker."""
    store = sys.modules.setdefault("_tallyloom_models", types.ModuleType("_tallyloom_models"))
    held = store.__dict__.setdefault("models", {})
    key = hash(tuple(sorted(texts.items())))
    if key not in held:
        held.clear()
        held[key] = Model(texts)
    return held[key]


def _joined(rows: list[str], chars: int, often: int = 3) -> str:
    """Clauses with a word seen less than ``often`` times so far, up to ``chars`` letters."""
    seen: dict[str, int] = {}
    out, n = [], 0
    for text in rows:
        for c in clauses(text):
            words = c.split()
            if n < chars and any(seen.get(w, 0) < often for w in words):
                out.append(c.strip())
                n += len(c)
                for w in words:
                    seen[w] = seen.get(w, 0) + 1
    return " " + " ".join(out) + " " if out else ""


def sample_rows(df: DataFrame, lang: str, key: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows per language, chosen by the hash of ``key``: a count per language sets the share to keep, so
    that no language is gathered or sorted whole."""
    own = df.where(F.col(lang).isin(*LANGS))
    counts = {r[0]: r[1] for r in own.groupBy(lang).agg(F.count(F.lit(1))).collect()}
    spot = F.pmod(F.xxhash64(*key), F.lit(1 << 30))
    keep = F.lit(False)
    for name, n in sorted(counts.items()):
        keep = keep | ((F.col(lang) == name) & (spot < F.lit(int(min(1.0, 2 * rows / n) * (1 << 30)))))
    w = Window.partitionBy(lang).orderBy(spot, *key)
    return own.where(keep).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= rows).drop("_rn")


def fit(trusted: DataFrame, labelled: DataFrame | None = None, chars: int = 60_000, longest: int = 3000) -> dict[str, str]:
    """Training text per language from bounded samples of labelled rows (``text``, ``lang``), as :func:`sample_rows` gives.

    Both samples come to the driver, texts longer than ``longest`` characters left out; each gives at most ``chars``
    letters per language. ``trusted`` labels are taken as they are. Rows and clauses of ``labelled``, whose labels may be
    wrong, only join if at least half of their words are more usual in rows of that label than of any other. Languages
    without rows are left out.
    """

    def first(df: DataFrame) -> dict[str, list[str]]:
        got: dict[str, list[str]] = {}
        for r in df.where(F.length("text").between(12, longest)).select("lang", "text").collect():
            got.setdefault(r["lang"], []).append(r["text"])
        return {lang: sorted(t) for lang, t in got.items()}

    sure = first(trusted)
    unsure = first(labelled) if labelled is not None else {}
    # Share of each language's sampled rows that have a word; a word belongs where its share is highest.
    share: dict[str, dict[str, float]] = {}
    for part in (sure, unsure):
        for lang, got in part.items():
            for t in got:
                for w in {w for c in clauses(t) for w in c.split()}:
                    own = share.setdefault(w, {})
                    own[lang] = own.get(lang, 0.0) + 1 / len(got)
    home = {w: max(sorted(own), key=own.__getitem__) for w, own in share.items()}

    def fits(clause: str, lang: str) -> bool:
        words = clause.split()
        return sum(home[w] != lang for w in words) <= 0.5 * len(words)

    texts = {}
    for lang in {*sure, *unsure}:
        clean = [c for t in unsure.get(lang, []) for c in clauses(t) if fits(t_words(t), lang) and fits(c, lang)]
        texts[lang] = _joined(sure.get(lang, []), chars) + _joined(clean, chars)
    return texts


def t_words(text: str) -> str:
    return " ".join(clauses(text))


VERDICT = "struct<segments:array<struct<lang:string,confidence:double,letters:int>>,close:array<string>>"


def identify(rows: DataFrame, model: dict[str, str], text: str = "text", switch: float = 5.5) -> DataFrame:
    """Adds ``found``: ``segments``, the languages of ``text`` in reading order, each with a confidence (none where it has no
    words), and ``close``, the languages that fit the whole text as well."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(VERDICT)
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = _kept(held.value)
        for s in batches:
            both = [own.segments(t, switch) if t else ([], []) for t in s]
            yield pd.DataFrame({"segments": [x for x, _ in both], "close": [y for _, y in both]})

    return rows.withColumn("found", verdict(F.coalesce(F.col(text), F.lit(""))))


def judge(texts: DataFrame, labels: DataFrame, model: dict[str, str], switch: float = 5.5) -> DataFrame:
    """Every text with its declared and found languages: src_table, row_id, declared, segments, state.

    ``texts``: src_table, row_id, text; ``labels``: src_table, row_id, lang_label. state: ``mixed`` (two or more
    languages in turn), ``unlabelled`` (no label that names a language), ``wrong``, ``right``, ``none`` (no words).
    A label is right as well where its language fits the words as well as the found one. Null and empty texts are
    ``none``; repeated rows count once; of several labels one right one suffices. Texts are read once and never shuffled.
    """
    marks = labels.select("src_table", "row_id", named(F.col("lang_label")).alias("lang")).where("row_id IS NOT NULL")
    marks = marks.groupBy("src_table", "row_id").agg(F.array_sort(F.collect_set("lang")).alias("declared"))
    seen = identify(texts.select("src_table", "row_id", "text"), model, switch=switch).select("src_table", "row_id", "found")
    both = seen.distinct().join(marks, ["src_table", "row_id"], "left")
    both = both.select("src_table", "row_id", F.coalesce("declared", F.array().cast("array<string>")).alias("declared"), "found.*")
    lang = F.col("segments")[0]["lang"]
    state = (
        F.when(F.size("segments") == 0, "none")
        .when(F.size("segments") > 1, "mixed")
        .when(F.size("declared") == 0, "unlabelled")
        .when(F.array_contains("declared", lang) | F.arrays_overlap("declared", "close"), "right")
        .otherwise("wrong")
    )
    return both.select("src_table", "row_id", "declared", "segments", state.alias("state"))


def found(judged: DataFrame) -> DataFrame:
    """The rows whose label is missing, wrong or not enough; seg_no 0 is the whole text, 1, 2, ... its stretches."""
    rows = judged.where(F.col("state").isin("mixed", "unlabelled", "wrong")).select(
        "src_table", "row_id", F.size("segments").alias("_n"), F.posexplode("segments").alias("_at", "_s")
    )
    return rows.select("src_table", "row_id", F.when(F.col("_n") > 1, F.col("_at") + 1).otherwise(0).alias("seg_no"), F.col("_s.lang").alias("lang"))


def project_texts(notes: DataFrame, parse_write: DataFrame) -> DataFrame:
    one = lambda df, name, col: df.select(F.lit(name).alias("src_table"), F.col("id").alias("row_id"), F.col(col).alias("text"))
    return one(notes, "notes", "content").unionByName(one(parse_write, "parse_write", "input"))
