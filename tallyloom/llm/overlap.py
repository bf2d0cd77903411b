"""Same or near-same records across splits."""

from __future__ import annotations

import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyloom.llm.names import near
from tallyloom.operators.orphans import KeyFilter
from tallyloom.runtime import cut, once

LANES = {"expense", "expenses", "buy", "shopping", "todo", "todos", "task", "ledger", "note", "weight", "ask", "spent"}
OPENERS = ("pls add", "please add", "ok so", "pls", "please", "again", "hey", "hi", "ok", "okay", "so", "add", "and", "fyi", "note to self")
CLOSERS = {"thanks", "thank", "you", "thx", "ty", "voice", "please", "pls", "ok", "bye", "typed", "scan", "forwarded"}
CHATTER = CLOSERS | {w for o in OPENERS for w in o.split()}
CURRENCY = {"rs", "inr", "rupees", "rupee", "rupaye", "rupay", "rubai", "usd", "eur", "euro", "euros", "€", "$", "₹", "रुपये", "ரூபாய்"}
TIMES = {
    "today", "yesterday", "tomorrow", "tonight", "morning", "evening", "night", "noon", "afternoon", "week", "weekend", "month", "year", "last", "next", "this",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "before", "after", "lunch", "dinner", "work", "one", "two", "three", "four", "five",
    "lunes", "martes", "jueves", "viernes", "domingo", "montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonntag", "heute", "gestern", "morgen",
    "lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche", "hier", "demain", "ayer", "hoy", "mañana",
}
NUMBER = re.compile(r"\d+(?:[.:,]\d+)*")
TOKEN = re.compile(r"\d+(?:[.:]\d+)*|[^\W\d_]+(?:[̀-ͯऀ-෿]+[^\W\d_]*)*|[€$₹]")
SPLIT = re.compile(r"\s*[,;+/|\n]+\s*|\s+[-–—&]\s+|[.!?。]\s+")


_KNOWN_WORDS: dict[str, bool] = {}


def _is_currency(w: str) -> bool:
    """A currency sign or word, slips included; remembered per word."""
    got = _KNOWN_WORDS.get(w)
    if got is None:
        if len(_KNOWN_WORDS) > 100_000:
            _KNOWN_WORDS.clear()
        got = _KNOWN_WORDS[w] = w in CURRENCY or len(w) > 3 and any(len(c) > 4 and near(w, c, 1) <= 1 for c in CURRENCY)
    return got


def _opened(t: str) -> str:
    """The text without lane marks and chatter before its first word."""
    while True:
        m = re.match(r"([^\W\d_]+(?: [^\W\d_]+)?)\s*[:,+;|/–—-]?\s+", t)
        head = m and m.group(1)
        if not m or not t[m.end() :].strip():
            break
        first = head.split()[0]
        if re.match(r"[^\W\d_]+\s*[:–—-]", t) and any(near(first, lane, 1) <= (len(lane) > 3) for lane in LANES):
            t = re.sub(r"^[^\W\d_]+\s*[:–—-]+\s*", "", t, count=1)
        elif head in OPENERS:
            t = t[m.end() :]
        elif first in OPENERS:
            t = re.sub(r"^[^\W\d_]+\s*[:,+;|/–—-]?\s+", "", t, count=1)
        else:
            break
    t = re.sub(r"^([^\W\d_]+)\s*:\s*", lambda m: "" if m.group(1) in LANES else m.group(), t)
    return t


def items_of(text: str) -> list[list[str]]:
    """The record as items, each a list of words and numbers, after normalising case, marks, spaces, units and chatter."""
    t = unicodedata.normalize("NFKC", text).casefold()
    t = re.sub(r"(?<=\d),(?=\d{2,3}(?:\D|$))", "", t)
    t = re.sub(r"\((?:voice|typed|scan)\w*\)|[!…\"“”'’]", lambda m: "" if m.group() in "'’" else " ", t).strip()
    t = _opened(t)
    items = []
    for part in SPLIT.split(t):
        words = [w for w in TOKEN.findall(_opened(part)) if not _is_currency(w)]
        if words and not all(w in CHATTER for w in words):
            items.append([w.lstrip("0") or "0" if w.isdigit() else w for w in words])
    while items and items[-1] and (items[-1][-1] in CLOSERS or near(items[-1][-1], "thanks", 1) <= 1):
        items[-1].pop()
        if not items[-1]:
            items.pop()
    return items


def canonical(text: str) -> str:
    """Items in sorted order, so that listing them otherwise changes nothing but an amount never leaves its item."""
    return "|".join(sorted(" ".join(i) for i in items_of(text)))


#: Small words that may be left out.
LOOSE = {"for", "of", "the", "a", "an", "to", "at", "in", "on", "and", "pack", "mr", "mrs", "dr", "ms"}
#: Most words of a record that make keys, whatever its length.
SKETCH = 16


def _parts(canon: str) -> tuple[list[str], list[str]]:
    """Sorted numbers and the distinct words of a canonical record; small words only where there are no others."""
    every = canon.replace("|", " ").split()
    plain = {w for w in every if not w[0].isdigit()}
    return sorted(w for w in every if w[0].isdigit()), sorted(plain - LOOSE or plain)


def sketch(words: list[str]) -> list[str]:
    """All words, or the ``SKETCH`` least by hash: two records that share two words of three nearly always share several."""
    return words if len(words) <= SKETCH else sorted(sorted(words, key=lambda w: xxh64_intdigest(w))[:SKETCH])


def slip_keys(word: str) -> set[str]:
    """Keys of which two words within the slips that :func:`same_word` allows share one: up to two letters left out of a
    short word, thirds of a long one. A word of any length gives at most 107."""
    n, out = len(word), {word}
    k = 0 if n < 2 else 1 if n < 4 else 2
    if n <= 13:
        for i in range(1, k + 1):
            out |= {"".join(x) for x in itertools.combinations(word, n - i)}
    if n >= 10:
        for t in range(n, n + 3):
            third = t // 3
            out |= {f"<{t} {word[: third - 1]}", f">{t} {word[n - third + 1 :]}"}
            out |= {f"={t} {word[third + 1 + d : 2 * third - 1 + d]}" for d in (-1, 0, 1)}
    return out


def block_keys(canon: str) -> list[str]:
    """Keys of which records that :func:`same_record` holds for the same share one, a bounded number for any length.

    Two or more numbers: all numbers, which must agree. Else the numbers with every two words of the :func:`sketch`, of which at
    least two stay as they are in records of four words and more; with each word in those of three; with the :func:`slip_keys` of the
    words and of all letters in shorter ones, where every word may have slips.
    """
    numbers, plain = _parts(canon)
    told = " ".join(numbers)
    if len(numbers) >= 2:
        return ["n " + told]
    out = set()
    if len(plain) >= 4:
        out |= {f"{a} {b}" for a, b in itertools.combinations(sketch(plain), 2)}
    if len(plain) in (3, 4):
        out |= set(plain)
    if len(plain) <= 2:
        for w in plain:
            out |= slip_keys(w)
    if len(plain) <= 3:
        out |= {"j " + x for x in slip_keys("".join(w for w in canon.replace("|", " ").split() if not w[0].isdigit()))}
    return [f"w {told} {o}" for o in sorted(out)]


def finer_keys(canon: str) -> list[str]:
    """What is added to a crowded key: each word of the sketch; records of five words or less also keep the key as it is."""
    plain = _parts(canon)[1]
    return sketch(plain) + ([""] if len(plain) <= 5 else [])


def same_word(a: str, b: str) -> bool:
    if a == b:
        return True
    if a[0].isdigit() or b[0].isdigit() or (a in TIMES and b in TIMES):
        return False
    n = max(len(a), len(b))
    return n >= 3 and near(a, b, 2) <= (1 if n < 5 else 2)


def _item_gap(a: list[str], b: list[str]) -> int | None:
    """Number of words written differently, or None where the items mean different things."""
    na, nb = [w for w in a if w[0].isdigit()], [w for w in b if w[0].isdigit()]
    if sorted(na) != sorted(nb):
        return None
    wa, wb = [w for w in a if not w[0].isdigit()], [w for w in b if not w[0].isdigit()]
    if len(wa) == len(wb) and all(same_word(x, y) for x, y in zip(wa, wb)):
        return sum(x != y for x, y in zip(wa, wb))
    fa, fb = "".join(wa), "".join(wb)
    if fa == fb:
        return 0
    la, lb = [w for w in wa if w not in LOOSE], [w for w in wb if w not in LOOSE]
    if len(la) == len(lb) and la and all(same_word(x, y) for x, y in zip(la, lb)):
        return 1 + sum(x != y for x, y in zip(la, lb))
    if abs(len(wa) - len(wb)) == 1 and min(len(fa), len(fb)) >= 6 and not (set(wa) ^ set(wb)) & TIMES and near(fa, fb, 2) <= 2:
        return 2
    return None


def same_record(a: str, b: str, most: float = 0.34) -> bool:
    """Whether two canonical records carry the same items, amounts, people and times, up to slips in single words."""
    if a == b:
        return True
    xs, ys = [i.split() for i in a.split("|")], [i.split() for i in b.split("|")]
    words, gap = len(a.replace("|", " ").split()), 0
    left = list(ys)
    for x in sorted(xs, key=len, reverse=True):
        options = [(g, k) for k, y in enumerate(left) if (g := _item_gap(x, y)) is not None]
        if not options:
            break
        g, k = min(options)
        gap += g
        left.pop(k)
    else:
        if not left:
            return gap <= max(2, most * words)
    # Other marks between the items: the same words in the same order, wherever the items end.
    return _item_gap([w for i in xs for w in i], [w for i in ys for w in i]) is not None and len(xs) != len(ys)


_GROUPED = r"(?<=[0-9]),(?=[0-9]{2,3}(?:[^0-9]|$))"
#: Signs that compatibility forms may turn into digits or their marks, and digits of other scripts.
_ODD = r"[\p{No}\p{Nl}\p{So}\uFF00-\uFFEF\u2024\u2025\uFE13\uFE52\uFE55]|(?![0-9])\p{Nd}"
#: A key with more pairs than this is split by further words.
CROWDED = 10_000
SALTS = 16


def normalised(col: str) -> Column:
    """Lower case with marks and white space as single spaces; of dots, commas and colons only those inside a word or number stay."""
    plain = F.regexp_replace(F.lower(col), r"[^\p{L}\p{M}\p{N}.,:]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[.,:]*( |$)[.,:]*", " "), " +[.,:]* *", " "))


def numbers_key(col: str) -> Column:
    """Hash of all numbers of a text, in order of their text, also of none; null where signs need a closer look."""
    found = F.regexp_extract_all(F.regexp_replace(col, _GROUPED, ""), F.lit(r"([0-9]+(?:[.:][0-9]+)*)"), F.lit(1))
    plain = F.array_sort(F.transform(found, lambda n: F.when(F.contains(n, F.lit(".")) | F.contains(n, F.lit(":")), n).otherwise(F.regexp_replace(n, "^0+(?=.)", ""))))
    return F.when(~F.regexp_like(col, F.lit(_ODD)), F.xxhash64(F.concat_ws(" ", plain)))


def _near_pairs(h: DataFrame, t: DataFrame, crowded: int) -> DataFrame:
    """Distinct canonical records of both sides that share a key and are the same: held_hash, train_hash."""

    @F.pandas_udf("array<string>")
    def keys(c: pd.Series) -> pd.Series:
        return c.map(block_keys)

    @F.pandas_udf("array<string>")
    def finer(c: pd.Series) -> pd.Series:
        return c.map(finer_keys)

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_record(x, y) for x, y in zip(a, b)], dtype=bool)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        one = df.select(f"{name}_hash", f"{name}_canon").distinct()
        return one.withColumn("key", F.explode(keys(f"{name}_canon"))).withColumn("key", F.xxhash64("key"))

    asked = cut(keyed(h, "held"))
    # Only keys that the evaluation side has are shuffled.
    known = KeyFilter.build(asked.select("key").distinct(), "key")
    offered = cut(known.test(keyed(t, "train"), "key", "_maybe").where("_maybe").drop("_maybe"))
    n = lambda df, c: df.groupBy("key").agg(F.count(F.lit(1)).alias(c))
    many = n(asked, "_h").join(n(offered, "_t"), "key").where(F.col("_h") * F.col("_t") > crowded).select("key", F.lit(True).alias("_many"))
    many = cut(many)
    asked, offered = asked.join(many, "key", "left"), offered.join(many, "key", "left")

    def split(df: DataFrame, name: str) -> DataFrame:
        return df.where("_many").drop("_many").withColumn("_add", F.explode(finer(f"{name}_canon")))

    plain = asked.where("_many IS NULL").drop("_many").hint("merge").join(offered.where("_many IS NULL").drop("_many").hint("merge"), "key")
    # What no further word tells apart is dealt to several tasks.
    salt = F.pmod(F.xxhash64("train_hash"), F.lit(SALTS)).cast("int")
    fine = split(asked, "held").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge").join(split(offered, "train").withColumn("_salt", salt).hint("merge"), ["key", "_add", "_salt"])
    pairs = plain.drop("key").unionByName(fine.drop("key", "_add", "_salt")).where("held_hash != train_hash").distinct()
    return pairs.where(same("held_canon", "train_canon")).select("held_hash", "train_hash")


def overlap_classes(held: DataFrame, train: DataFrame, crowded: int = CROWDED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between classes of alike records: (held_class, train_class, exact), and the members of both sides (id, class).

    A class is a normalised text (case, marks, white space); its hash stands for it, and equal hashes are ``exact`` links.
    All else runs between classes: their canonical records (units, currency signs, chatter and order of items too) are hashed
    and joined, and those that differ in slips share a key (:func:`block_keys`) and are verified word by word. Of the
    training texts only those go on whose class or numbers, which must agree, pass Bloom filters of fixed size of the evaluation
    side's; the others can have no link.
    """

    @F.pandas_udf("string")
    def canon(text: pd.Series) -> pd.Series:
        return text.map(canonical)

    def members(df: DataFrame) -> DataFrame:
        rows = df.select("id", "input").where("id IS NOT NULL AND input IS NOT NULL").withColumn("norm", normalised("input"))
        return rows.where("norm != ''").select("id", "input", F.md5("norm").alias("class"), numbers_key("input").alias("numbers"))

    h = cut(members(held))
    same_text = KeyFilter.build(h.select(F.xxhash64("class").alias("key")).distinct(), "key")
    same_numbers = KeyFilter.build(h.select("numbers").distinct(), "numbers")
    t = same_numbers.test(same_text.test(members(train).withColumn("key", F.xxhash64("class")), "key", "_text"), "numbers", "_numbers")
    t = cut(t.where("numbers IS NULL OR _numbers OR _text").select("id", "input", "class"))
    links = h.select("class").distinct().join(t.select("class").distinct(), "class", "left_semi")
    exact = links.select(F.col("class").alias("held_class"), F.col("class").alias("train_class"), F.lit(True).alias("exact"))
    tasks = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), held.sparkSession.sparkContext.defaultParallelism)

    def forms(df: DataFrame, name: str) -> DataFrame:
        # One text stands for its class. Dealt to all cores, for parsing costs far more than its bytes.
        one = df.repartition(tasks, "class").groupBy("class").agg(F.min("input").alias("input"))
        rows = one.select(F.col("class").alias(f"{name}_class"), canon("input").alias(f"{name}_canon")).where(F.length(f"{name}_canon") > 0)
        return cut(rows.withColumn(f"{name}_hash", F.md5(f"{name}_canon")))

    hc, tc = forms(h, "held"), forms(t, "train")
    equal = hc.select("held_hash").distinct().join(tc.select(F.col("train_hash").alias("held_hash")).distinct(), "held_hash", "left_semi")
    linked = equal.select("held_hash", F.col("held_hash").alias("train_hash")).unionByName(_near_pairs(hc, tc, crowded))
    near_links = linked.join(hc.select("held_hash", "held_class"), "held_hash").join(tc.select("train_hash", "train_class"), "train_hash")
    near_links = near_links.where("held_class != train_class").select("held_class", "train_class", F.lit(False).alias("exact"))
    return cut(exact.unionByName(near_links)), h.select("id", "class").distinct(), t.select("id", "class").distinct()


def find_overlaps(held: DataFrame, train: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Pairs of an evaluation record and a training record with the same content: held_id, train_id, exact.

    ``held`` and ``train``: id, input. See :func:`overlap_classes`; ``exact`` pairs are equal after normalising case, marks and white
    space. The pairs of rows are listed only at the end, as members of linked classes.

    Null and empty inputs overlap with nothing; repeated rows count once; empty tables give no rows.
    """
    links, h, t = overlap_classes(held, train, crowded)
    h, t = h.toDF("held_id", "held_class"), t.toDF("train_id", "train_class")
    return links.join(h, "held_class").join(t, "train_class").select("held_id", "train_id", "exact").distinct()


def overlap_report(held: DataFrame, train: DataFrame, cases: DataFrame) -> DataFrame:
    """Share of evaluation records met in training, per split and source, from the sizes of linked classes: no pair is listed."""
    links, h, t = overlap_classes(held, train)
    sizes = t.groupBy(F.col("class").alias("train_class")).agg(F.count(F.lit(1)).alias("_size"))
    met = links.join(sizes, "train_class").groupBy(F.col("held_class").alias("class")).agg(F.sum("_size").alias("_pairs"), F.max("exact").alias("_exact"))
    rows = once(cases.select("id", "split", "source")).join(h.join(met, "class"), "id", "left")
    n = F.count(F.lit(1))
    return rows.groupBy("split", "source").agg(
        n.alias("n_records"),
        F.count("_pairs").alias("n_overlapping"),
        F.count_if(F.coalesce("_exact", F.lit(False))).alias("n_exact"),
        F.coalesce(F.sum("_pairs"), F.lit(0)).alias("n_pairs"),
        F.round(F.count("_pairs") / n, 6).alias("share"),
    )
