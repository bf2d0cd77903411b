"""Personal information inside free text, found and replaced by typed placeholders."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyloom.llm import bits
from tallyloom.llm.names import ORG, TITLES
from tallyloom.runtime import cut, lookup_join, once

TLD = r"(?:com|org|net|edu|gov|info|io|in|de|fr|es|uk|example|test|invalid|local)"
AT = r"(?:@|\s?[(\[]\s?at\s?[)\]]\s?|\sat\s)"
DOT = r"(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?|\sdot\s)"
EMAIL = re.compile(rf"(?<![\w.+-])[a-z0-9](?:[\w.+-]*[\w+-])?(?:@|\s?[(\[]\s?at\s?[)\]]\s?)[a-z0-9-]+(?:{DOT}[a-z0-9-]+)*{DOT}[a-z]{{2,}}\b|(?<![\w.+-])[a-z0-9][\w.+-]*\sat\s[a-z0-9-]+(?:{DOT}[a-z0-9-]+)*?(?:\sdot\s{TLD})+(?:\sdot\s{TLD}|\.{TLD})*\b|(?<![\w.+-])[a-z0-9][\w.+-]{{4,}}\sat\s[a-z0-9-]+(?:\.[a-z0-9-]+)*\.{TLD}\b(?![\w-])", re.I)

KIND = r"(?:Cross\s+)?(?:Street|Str|St|Road|Rd|Lane|Ln|Avenue|Ave|Marg|Salai|Nagar|Drive|Dr|Close|Court|Way|Square|Boulevard|Blvd|Place|Path|Terrace)"
CAP = r"[A-ZÀ-Þ][\w'’-]*"
DOOR = r"(?:(?:Flat|Door|No|House|Plot|Apt|Unit|Suite|Apartment)\b\.?\s*|#\s*)"
AREA = rf"(?:,\s+{CAP}(?:\s+{CAP})?)?"
ADDRESS = re.compile(
    rf"(?<![\w/.#-])(?:{DOOR}[\w/-]+,\s+)?(?:{DOOR})?\d+[\w/-]*,?\s+(?:(?:{CAP})\s+){{1,4}}?{KIND}\b\.?{AREA}"
    rf"|(?<!\w)(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrera|Ronda)\s+(?:(?:de|del|la|las|los|el)\s+)*{CAP}(?:\s+(?:(?:de|del|la|las|los)\s+)*{CAP})*,?\s+(?:n[.º°]*\s*)?\d+\w?(?:,\s+(?:\d+\s?[º°ªo]\s?\w?\b|bajo|ático|entresuelo))?"
    rf"|(?<![\w/])\d+\s?(?:bis|ter|quater)?,?\s+(?:rue|avenue|av\.?|bd|boulevard|impasse|allée|place|chemin|quai|cours|passage|route)\s+(?:(?:de|du|des|la|le|les|l['’]|d['’])\s*)*{CAP}(?:[\s-]{CAP})*"
    rf"|(?<!\w)(?:{CAP}(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|ring|damm)|(?:Am|An|Im|In|Zum|Zur|Auf)\s+(?:der\s+|dem\s+|den\s+)?{CAP}(?:\s+{CAP})?)\s+\d+\s?(?:[a-z]\b)?"
)

PHONE = re.compile(
    r"(?<![\w./+-])(?!\d{4}[ .-]\d{4}[ .-]\d{4}(?!\d))(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}|00\d{1,3}[ .-]\d{2,5}(?:[ .-]\d{2,5}){1,4}"
    r"|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|0\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}|0\d{2,4}[ -]\d{6,8}|\d{3}([.-])\d{3}\1\d{4}|\d{3} \d{3} \d{4}|\d{5}[- ]\d{5})(?![\w-]|[./]\d)"
)
IDNUM = re.compile(
    r"(?<![\w./+-])(?:[A-Z]{5}\d{4}[A-Z]|[A-Z]{2}\d{2}[ -]?(?:\d{4}[ -]?){1,6}\d{1,4}|[A-Z]\d{7,8}[A-Z]?|[A-Z]{2}\d{6,9}[A-Z]?|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d{3}-\d{2}-\d{4})(?![\w-])"
)
#: Numbers that only their surroundings tell apart from invoice, meter, order and voucher numbers.
UNSURE = re.compile(r"(?<![\w./+-])(?:\d{4}([ -])\d{4}\1\d{4}|\d{7,15})(?![\w-]|[./]\d)")
WORD = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f\u0900-\u0963\u0970-\u0dff]+[^\W\d_]*)*")

SPAN = "kind:string,start_pos:int,end_pos:int,sure:boolean,context:string"
TITLE_WORDS = TITLES | {"herr", "frau", "señor", "señora", "sr", "sra", "srta", "mme", "mlle"}


#: What an e-mail address without a sign has somewhere.
_SPELT = re.compile(rf"[(\[]\s?at\s?[)\]]|\sat\s.*(?:\sdot\s|\.{TLD}\b)", re.I | re.S)
_DIGIT = re.compile(r"\d")
_BREAK = re.compile(r"[.!?\n।/]")

Word = tuple[int, int, str]


def _context(words: list[Word], starts: list[int], at: int) -> str:
    """The two words before a place of the text."""
    k = bisect_left(starts, at)
    return " ".join(w.casefold() for _, _, w in words[max(0, k - 2) : k])


def structured_items(text: str, words: list[Word]) -> list[tuple[str, int, int, bool, str]]:
    """Addresses, e-mails, phone and identity numbers: kind, start, end, whether the shape alone proves it, context."""
    taken: list[tuple[int, int]] = []
    out = []
    starts = [a for a, _, _ in words]

    def add(kind: str, a: int, b: int, sure: bool) -> None:
        if all(b <= x or a >= y for x, y in taken):
            b = a + len(text[a:b].rstrip())
            taken.append((a, b))
            out.append((kind, a, b, sure, _context(words, starts, a)))

    if "@" in text or _SPELT.search(text):
        for m in EMAIL.finditer(text):
            add("email", m.start(), m.end(), True)
    if _DIGIT.search(text):
        for m in ADDRESS.finditer(text):
            add("address", m.start(), m.end(), True)
        for m in IDNUM.finditer(text):
            add("idnum", m.start(), m.end(), True)
        for m in PHONE.finditer(text):
            add("phone", m.start(), m.end(), True)
        for m in UNSURE.finditer(text):
            add("number", m.start(), m.end(), False)
    return out


def name_terms(persons: DataFrame, nicknames: DataFrame) -> DataFrame:
    """What people are called by: first words of their names, however many follow, and nicknames; organisations left out."""
    word = F.split(F.lower(F.trim("name")), r"\s+")
    people = persons.where(F.col("name").isNotNull() & ~F.arrays_overlap(word, F.array(*map(F.lit, sorted(ORG)))))
    out = people.select(word[0].alias("term"))
    for c in ("given_name", "nickname"):
        out = out.unionByName(nicknames.select(F.lower(F.trim(c)).alias("term")))
    return out.where(F.length("term") > 1).distinct()


def _surnames(persons: DataFrame) -> DataFrame:
    word = F.split(F.lower(F.trim("name")), r"\s+")
    return persons.where(F.size(word) >= 2).select(F.explode(F.slice(word, 2, F.size(word))).alias("surname")).where(F.length("surname") > 1).distinct()


def _names(text: str, words: list[Word], may_be: Callable[[str], bool], blocked: list[tuple[int, int]]) -> list[tuple[int, int, bool, str, str, str, str]]:
    """Candidates: start, end, whether a title proves it, term, the words around it (left, right) and the next word if it may be a
    surname. Candidates are words that may be in the dictionary, and capitalised words inside a clause."""
    if blocked:
        words = [w for w in words if all(w[1] <= a or w[0] >= b for a, b in blocked)]
    out = []
    last_end = -1
    for i, (a, b, w) in enumerate(words):
        low = w.casefold()
        if a < last_end and not may_be(low):
            continue  # the surname of a candidate
        known = may_be(low)
        shaped = w[0].isupper() and w[1:].islower() and len(w) > 2
        if not known and not shaped:
            continue
        before = words[i - 1] if i else None
        gap = text[before[1] : a] if before is not None else "\n"
        titled = before is not None and before[2].casefold() in TITLE_WORDS and gap.strip(" \t.") == "" and w[0].isupper()
        if before is not None and last_end == before[1] and gap == " ":
            last_end = b  # a surname that is also somebody's first name
            continue
        k = i - 1
        while k >= 0 and words[k][2].casefold() in TITLE_WORDS:
            k -= 1
        lead = text[words[k][1] : words[k + 1][0]] if k >= 0 else "\n"
        left = words[k][2].casefold() if k >= 0 and not _BREAK.search(lead) else "^"
        if not known and not titled and (left == "^" or low in TITLE_WORDS):
            continue
        right, tail, end = "$", "", b
        if i + 1 < len(words):
            between, nxt = text[b : words[i + 1][0]], words[i + 1][2]
            right = nxt.casefold() if not _BREAK.search(between) else "$"
            if between == " ":
                tail = nxt.casefold()
                if nxt[0].isupper() and w[0].isupper() and (known or titled or not may_be(tail)):
                    end, right = words[i + 1][1], "+"
        if known or titled:
            last_end = end
        out.append((a, end, titled, low, "+" if titled else left, right, tail))
    return out


FOUND = "array<struct<" + SPAN + ",term:string,left:string,right:string,tail:string>>"


def _scanner(filter_words):
    """The candidates of a text; of the dictionary the executors have a Bloom filter of fixed size."""

    @F.pandas_udf(FOUND)
    def items(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, memo = filter_words.value, {}

        def may_be(word: str) -> bool:
            got = memo.get(word)
            if got is None:
                if len(memo) > 200_000:
                    memo.clear()
                got = memo[word] = bool(bits.held(own, np.array([xxh64_intdigest(word.encode(errors="replace"), 42)], dtype=np.uint64))[0])
            return got

        for s in batches:
            rows = []
            for t in s:
                words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(t)]
                fixed = structured_items(t, words)
                got = [(*f, "", "", "", "") for f in fixed]
                for a, b, sure, term, left, right, tail in _names(t, words, may_be, [(x, y) for _, x, y, _, _ in fixed]):
                    got.append(("name", a, b, sure, "", term, left, right, tail))
                rows.append(got)
            yield pd.Series(rows, dtype=object)

    return items


#: Log-odds that a word people are called by is a name where the corpus has nothing to say.
PRIOR = 9.0


def _kinds_of_numbers(found: DataFrame) -> DataFrame:
    """What numbers of a common shape are, by the numbers of proven kind that come after the same words: the two before it, and as one
    more observation the last one of them."""
    n_of = lambda k: F.count_if(F.col("kind") == k)
    seen = found.where("kind IN ('phone', 'idnum', 'number')").withColumn("last", F.element_at(F.split("context", " "), -1))
    counts = lambda by, p: seen.groupBy(by).agg(n_of("phone").alias(f"{p}_phones"), n_of("idnum").alias(f"{p}_ids"), F.count(F.lit(1)).alias(f"{p}_n"))
    unsure = lookup_join(lookup_join(seen.where("kind = 'number'"), counts("context", "c"), "context"), counts("last", "l"), "last")

    def share(what: str) -> Column:
        # The number itself is in the counts, as neither.
        return (F.col(f"c_{what}") + F.col(f"l_{what}") / (F.col("l_n") + 3)) / (F.col("c_n") + 1)

    ids, phones = share("ids"), share("phones")
    return unsure.withColumn("kind", F.when((ids >= NUMBER_SHARE) & (ids >= phones), "idnum").when(phones >= NUMBER_SHARE, "phone")).where("kind IS NOT NULL")


#: Share of proven numbers among those after the same words from which an unproven one counts as of their kind.
NUMBER_SHARE = 0.15


def find_items(texts: DataFrame, persons: DataFrame, nicknames: DataFrame, disclosure: float = 0.0, unlisted: float = 2.2) -> DataFrame:
    """Personal items of each text: src_table, row_id, kind, start_pos, end_pos (0-based characters, end exclusive).

    ``texts``: src_table, row_id, text; ``persons``: name; ``nicknames``: given_name, nickname. Shapes that only occur
    in personal details (e-mails, addresses with a house number, most phone and identity numbers) are items at once. For all
    else co-occurrence in the corpus decides how strongly a term in its surroundings discloses a protected entity:

    * A number of a common shape is an identity or phone number if numbers of a proven kind come after the same words.
    * A word that people are called by is a name if its disclosure exceeds ``disclosure``: the prior log-odds less the
      log-likelihood ratio of two accounts of its place (the words to its left and right). In a place for names all names
      turn up, each as often as elsewhere; in a phrase of an ordinary word ("a joy to", "before dawn and") nearly always
      the same word does.
    * A capitalised word inside a clause that neither table has is a name if its disclosure exceeds ``unlisted``: the
      log-odds of the mean share, over all its places in the corpus, that known names have among the capitalised words there, by both words
      around it and, as four observations, by the left one. The share is measured against that of known names among titled
      ones, which tells how many names the dictionary lacks. The test of phrases applies too.

    Titles are not part of a name; a capitalised word after a title is a name in any case. Nulls and empty texts have no
    items, repeated rows count once, and overlapping items resolve to the first found. The dictionary is never collected: a Bloom filter
    of fixed size goes to the executors, and what passes is joined with it.
    """
    rows = texts.where(F.col("text").isNotNull() & (F.length("text") > 0)).select("src_table", "row_id", "text")
    terms = cut(name_terms(persons, nicknames).withColumn("listed", F.lit(True)))
    held = texts.sparkSession.sparkContext.broadcast(bits.build(terms.select(F.xxhash64("term").alias("key"))))
    found = rows.select("src_table", "row_id", F.explode(_scanner(held)("text")).alias("i"))
    found = cut(once(found.select("src_table", "row_id", "i.*")))
    keys = ["src_table", "row_id", "kind", "start_pos", "end_pos"]
    fixed = found.where("kind NOT IN ('name', 'number')").select(*keys)
    numbers = _kinds_of_numbers(found).select(*keys)
    near = found.where("kind = 'name'")
    sure = near.where("sure").select(*keys)

    surnames = _surnames(persons).select(F.col("surname").alias("tail"), F.lit("+").alias("_sur"))
    maybe = lookup_join(lookup_join(near.where(~F.col("sure")), terms, "term"), surnames, "tail")
    maybe = maybe.withColumn("listed", F.coalesce("listed", F.lit(False))).withColumn("place", F.concat_ws(" ", "left", F.coalesce("_sur", "right")))
    # What passed the filter by chance in lower case is no candidate.
    maybe = cut(maybe.where("listed OR left != '^'"))
    uses = cut(maybe.groupBy("listed", "term", "left", "place").agg(F.count(F.lit(1)).alias("both")))
    proven = cut(lookup_join(near.where("sure").select("term"), terms, "term").agg(F.count("listed").alias("k"), F.count(F.lit(1)).alias("n"))).first()
    coverage = (proven["k"] + 4) / (proven["n"] + 4)
    disclosing = _told_by_names(uses, unlisted, coverage)
    maybe = lookup_join(maybe, disclosing, "term").where("listed OR discloses")
    uses = uses.join(disclosing, "term", "left").where("listed OR discloses")
    names = _told_by_place(maybe, uses, disclosure).select(*keys)
    return fixed.unionByName(numbers).unionByName(sure).unionByName(names).distinct()


def _told_by_place(maybe: DataFrame, uses: DataFrame, disclosure: float) -> DataFrame:
    """Words that people are called by, but for those whose place is a phrase of this one word."""
    places = uses.groupBy("place").agg(F.sum("both").alias("of_place"))
    terms = uses.groupBy("term").agg(F.sum("both").alias("of_term"))
    every = uses.agg(F.sum("both")).first()[0] or 0
    uses = uses.join(places, "place").join(terms, "term")
    elsewhere = F.col("of_term") - F.col("both") + 1
    usual = F.least(F.lit(0.3), elsewhere / F.greatest(F.lit(every) - F.col("of_place") + 10, F.lit(10)))
    own = F.col("both") * F.log(F.lit(0.9) / usual) + (F.col("of_place") - F.col("both")) * F.log(F.lit(0.1) / (1 - usual))
    told = cut(uses.select("term", "place", "listed", "both", (F.lit(PRIOR) - own <= disclosure).alias("phrase")))
    # A word outside the dictionary that is often met in phrases is an ordinary one.
    ordinary = told.where("NOT listed").groupBy("term").agg((F.sum(F.when(F.col("phrase"), F.col("both"))) / F.sum("both") >= 0.3).alias("ordinary"))
    phrases = told.where("phrase").select(F.concat_ws("\t", "term", "place").alias("use"), "phrase")
    judged = lookup_join(maybe.withColumn("use", F.concat_ws("\t", "term", "place")), phrases, "use")
    return lookup_join(judged.where("phrase IS NULL"), ordinary, "term").where("ordinary IS NULL OR NOT ordinary")


def _told_by_names(uses: DataFrame, unlisted: float, coverage: float) -> DataFrame:
    """Words outside the dictionary whose places are places of known names: term, discloses. ``coverage`` is the share of names that the
    dictionary knows, so the share of known names that a place for names has."""
    named = F.sum(F.when(F.col("listed"), F.col("both")).otherwise(0))
    counted = lambda by, p: uses.groupBy(by).agg(named.alias(f"{p}_named"), F.sum("both").alias(f"{p}_n"))
    own = uses.where(~F.col("listed")).groupBy("term", "left", "place").agg(F.sum("both").alias("both"))
    of_left = own.groupBy("term", "left").agg(F.sum("both").alias("both_left"))
    rows = lookup_join(lookup_join(own.join(of_left, ["term", "left"]), counted("place", "p"), "place"), counted("left", "l"), "left")
    by_left = F.col("l_named") / (F.col("l_n") - F.col("both_left") + 1)  # the word itself is no evidence
    share = (F.col("p_named") + 4 * by_left) / (F.col("p_n") - F.col("both") + 4)
    means = rows.groupBy("term").agg((F.sum(F.col("both") * F.least(F.lit(1.0), share / coverage)) / F.sum("both")).alias("p"))
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("p")))
    return cut(means.where(F.log(p / (1 - p)) > unlisted).select("term", F.lit(True).alias("discloses")))


def sanitise(texts: DataFrame, items: DataFrame) -> DataFrame:
    """The texts with a typed placeholder in place of each item: src_table, row_id, text; others stay as they are."""
    per = items.groupBy("src_table", "row_id").agg(F.sort_array(F.collect_set(F.struct("start_pos", "end_pos", "kind"))).alias("spans"))

    @F.pandas_udf("string")
    def put(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t: str | None, own) -> str | None:
            if t is None or own is None:
                return t
            out, at = [], 0
            for s in own:
                if s["start_pos"] >= at:
                    out += [t[at : s["start_pos"]], f"[{s['kind'].upper()}]"]
                    at = s["end_pos"]
            return "".join(out) + t[at:]

        return pd.Series([one(t, s) for t, s in zip(text, spans)], dtype=object)

    rows = once(texts.select("src_table", "row_id", "text")).join(per, ["src_table", "row_id"], "left")
    return rows.select("src_table", "row_id", put("text", "spans").alias("text"))


def project_texts(notes: DataFrame, activity_log: DataFrame) -> DataFrame:
    one = lambda df, name, col: df.select(F.lit(name).alias("src_table"), F.col("id").alias("row_id"), F.col(col).alias("text"))
    return one(notes, "notes", "content").unionByName(one(activity_log, "activity_log", "input_text"))
