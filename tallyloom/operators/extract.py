"""Records out of short texts: lanes, items, amounts, people and days."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import dates as T
from tallyloom.functions.text import normalise, search_words

TAGS = "expense|buy|todo|ledger|weight|note|ask"
UNITS = ("kg", "g", "litre", "l", "ml", "pcs", "pkt", "box", "dozen")
RECORD = "lane:string,disposition:string,records:array<struct<description:string,amount:double,item_text:string,quantity_text:string,unit_text:string,text:string,person_text:string,value:double,action:string,date:string>>"

_TAG = re.compile(rf"^\s*({TAGS}|shopping)\s*[:–-]\s+", re.I)
_SEP = re.compile(r"\s*(?:(?<!\d),|,(?!\d)|[;|/+\n])\s*")
#: Conjunctions between items of a list, where a part holds more than one number.
_AND = re.compile(r"\s+(?:aur|and|appuram|und(?:\s+noch)?|dann|y(?:\s+otros)?|luego|et(?:\s+encore)?|puis|और)\s+", re.I)
#: Words around a number and its item.
_AROUND = re.compile(r"\b(?:ke liye|rupaye|diye|ku|rubai|kuduthen|pe|pour|por|für|bezahlt|ausgegeben|gasté|pagué|j'ai payé|dépensé|habe ich|kharch hue|vaanga|selavu aachu)\b|के लिए|रुपये|दिए|पर|खर्च हुए|வாங்க|ரூபாய்|கொடுத்தேன்|செலவு", re.I)
_THEN = re.compile(r"\s+(?:aur\s+phir|aur\s+uske\s+baad|and\s+then|y\s+después|et\s+ensuite|und\s+danach|और\s+फिर)\s+", re.I)
_LIST = re.compile(r"\s+(?:aur|appuram|und(?:\s+auch)?|y(?:\s+también)?|et(?:\s+aussi)?|और|மற்றும்)\s+", re.I)
_END = re.compile(r"(?<!\bDr)(?<!\bMr)(?<!\bMrs)(?<!\bRs)[.।]\s")
#: How a remark that is no item of its own begins.
_REMARK = re.compile(r"^(?:the receipt|as told|to be shared|all paid|for the trip|still to be|bought at|before the|while we|thanks)\b", re.I)
_NUMBER = re.compile(r"(?<![\w.:])\d[\d,]*(?:\.\d+)?(?![\w:])")
_FACTORS = {"k": 1e3, "thousand": 1e3, "l": 1e5, "lakh": 1e5, "lakhs": 1e5, "cr": 1e7, "crore": 1e7, "crores": 1e7}
_AMOUNT = r"(?:rs\.?\s*|₹\s*|inr\s*)?(?P<n>\d[\d,]*(?:\.\d+)?)\s*(?P<f>k|thousand|l|lakhs?|cr|crores?)?\s*(?:rs|rupees|/-)?"
_MONEY = re.compile(rf"(?:^|(?<=\s))(?:for\s+)?{_AMOUNT}(?=\s|$)", re.I)
_QUANTITY = re.compile(rf"(?:^|(?<=\s))(\d+(?:\.\d+)?)\s*({'|'.join(UNITS)})(?=\s|$)", re.I)
_WEIGHT = re.compile(r"(\d{1,3}(?:\.\d+)?)\s*(?:kg|kgs)?\b", re.I)
_WHO = r"(?P<p>[^\W\d_][^\d,]*?)"
_TO_END = r"(?P<p>[^\W\d_][^\d,]*)"
#: What people say of money between two, in the order in which it is tried, and what it does.
_DEALS = tuple(
    (action, re.compile(words.replace("WHO_END", _TO_END).replace("WHO", _WHO).replace("SUM", rf"{_AMOUNT}(?=\s|$)"), re.I))
    for action, words in (
        ("settle", r"^(?:all\s+)?settled(?:\s+up)?\s+with\s+WHO_END"),
        ("received", r"\bgot\s+SUM\s+back\s+from\s+WHO_END"),
        ("gave", r"^WHO\s+took\s+SUM\s+from\s+me\b"),
        ("borrowed", r"\b(?:borrowed|took)\s+SUM\s+from\s+WHO_END"),
        ("gave", r"^WHO\s+(?:still\s+)?owes\s+me\s+SUM"),
        ("owe", r"\bi\s+(?:still\s+)?owe\s+WHO\s+SUM"),
        ("received", r"^(?!i\s)WHO\s+(?:gave|lent|sent|paid)\s+me\s+(?:back\s+)?SUM"),
        ("received", r"^(?!i\s)WHO\s+(?:returned|repaid|gave\s+back)\s+(?:me\s+)?SUM"),
        ("received", r"\b(?:received|got)\s+SUM\s+from\s+WHO_END"),
        ("gave", r"\b(?:gave|give|lent|sent)\s+SUM\s+to\s+WHO_END"),
        ("paid", r"\bpaid\s+SUM\s+to\s+WHO_END"),
        ("gave", r"(?:^|\bi\s+)(?:gave|give|lent|sent)\s+(?!me\b)WHO\s+SUM"),
        ("paid", r"(?:^|\bi\s+)paid\s+(?!me\b)WHO\s+SUM"),
    )
)
_GAVE = re.compile(rf"^(?P<p>\S+)\s+(?:gave|lent|sent)\s+{_AMOUNT}(?=\s|$)", re.I)
_DAY = re.compile(r"(?:^|\s+)(?:on\s+)?(today|yesterday|tomorrow|day before yesterday|(?:(?:last|this|next)\s+)?(?:" + "|".join(T.WEEKDAYS) + r")|\d{1,3} days? ago|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})$", re.I)


def day_of(phrase: str, anchor: date, ahead: bool = False) -> date | None:
    """The day a phrase at the end of a record names; a bare weekday is the last such day, or with ``ahead`` the next one from the anchor on;
    null for no such day."""
    p = re.sub(r"\s+", " ", phrase.lower())
    plain = {"today": 0, "yesterday": -1, "tomorrow": 1, "day before yesterday": -2}
    if p in plain:
        return anchor + timedelta(plain[p])
    if m := re.match(r"(\d+) days? ago", p):
        return anchor - timedelta(int(m.group(1)))
    if p.split()[-1] in T.WEEKDAYS:
        k = T.WEEKDAYS.index(p.split()[-1]) - anchor.weekday()
        steps = {"next": (k + 6) % 7 + 1, "this": (k + 7) % 7, "last": -((-k + 6) % 7 + 1)}
        return anchor + timedelta(steps.get(p.split()[0], steps["this" if ahead else "last"]))
    try:
        return date.fromisoformat(p) if "-" in p else date(*map(int, p.split("/")[::-1]))
    except ValueError:
        return None


def _number(text: str) -> float | None:
    try:
        return float(text.replace(",", "").rstrip("."))
    except ValueError:
        return None


def _sum(m: re.Match) -> float | None:
    n = _number(m.group("n"))
    return n if n is None else n * _FACTORS.get((m.group("f") or "").lower(), 1.0)


def _rec(**kw) -> dict:
    keys = ("description", "amount", "item_text", "quantity_text", "unit_text", "text", "person_text", "value", "action", "date")
    return {k: kw.get(k) for k in keys}


def _deal(part: str, people: frozenset[str]) -> dict | None:
    for action, rx in _DEALS:
        if m := rx.search(part):
            who = re.sub(r"\s+for\s+.*$", "", m.group("p")).strip()
            amount = None if action == "settle" else _sum(m)
            return _rec(person_text=who, amount=amount, action=action) if who else None
    if (m := _GAVE.search(part)) and m.group("p").lower() in people:
        return _rec(person_text=m.group("p"), amount=_sum(m), action="received")
    return None


def parse(text: str, anchor: date | None = None, people: frozenset[str] = frozenset()) -> dict:
    """Lane, disposition and records of one text; an untagged text takes the lane its first item fits.

    A day at the end of a record is its date, else the anchor is. ``people`` are names in lower case: one before a number alone is a
    reading, one before "gave" the giver. A remark is no record; what follows it is one only if it has the
    lane's own number and no more than four words.
    """
    tag = _TAG.match(text)
    body = text[tag.end() :] if tag else text
    lane = tag.group(1).lower().replace("shopping", "buy") if tag else None
    parts = [p.strip(" .!?") for p in _END.split(body) for p in _SEP.split(p) if p.strip(" .!?")]
    end = next((i for i, p in enumerate(parts) if i and _REMARK.match(p)), len(parts))
    later = [p for p in parts[end:] if not _REMARK.match(p)]
    parts = parts[:end]
    first = parts[0] if parts else ""
    if lane is None:
        words = first.lower().split()
        if _deal(first, people):
            lane = "ledger"
        elif re.search(r"\bweigh|\d\s*kg\b.*(?:today|morning|food|walk)", body, re.I) or len(words) > 1 and words[0] in people and _WEIGHT.match(words[1]):
            lane = "weight"
        elif _QUANTITY.search(first):
            lane = "buy"
        elif _MONEY.search(first):
            lane = "expense"
        else:
            lane = "todo"
    needs = {"expense": _MONEY, "buy": _QUANTITY}.get(lane)
    parts += [p for p in later if lane == "ledger" and _deal(p, people) or needs is not None and needs.search(p) and len(p.split()) <= 4]
    out = []
    if lane == "expense":
        parts = [x for p in parts for x in (_AND.split(p) if len(_NUMBER.findall(p)) > 1 else [p])]
    if lane in ("todo", "buy"):
        rx = _THEN if lane == "todo" else _LIST
        parts = [x for p in parts for x in rx.split(p) if x]
    for p in parts:
        on = None
        if anchor is not None and (d := _DAY.search(p)) and d.start() and (named := day_of(d.group(1), anchor, lane == "todo")):
            p, on = p[: d.start()].strip(), named
        got = None
        if lane == "expense" and (m := _MONEY.search(p)):
            what = _AROUND.sub(" ", p[: m.start()] + " " + p[m.end() :]).strip()
            if what:
                got = _rec(description=re.sub(r"\s+", " ", what), amount=_sum(m))
        elif lane == "buy":
            m = _QUANTITY.search(p)
            if m:
                got = _rec(item_text=re.sub(r"\s+", " ", p[: m.start()] + " " + p[m.end() :]).strip(), quantity_text=m.group(1), unit_text=m.group(2).lower())
            else:
                got = _rec(item_text=p)
        elif lane == "ledger":
            got = _deal(p, people)
        elif lane == "weight" and (m := _WEIGHT.search(p)):
            value = _number(m.group(1))
            who = re.sub(r"\b(?:weighs?|weight|weighed|is|was|at|myself|my|now)\b|:", " ", p[: m.start()], flags=re.I).strip()
            if value is not None and 0 < value < 200:
                got = _rec(value=value, person_text=who or None)
        elif lane == "todo":
            got = _rec(text=p)
        if got:
            got["date"] = str(on or anchor) if on or anchor else None
            out.append(got)
    return {"lane": lane, "disposition": "accept" if out else "reject", "records": out}


def extract(df: DataFrame, text: str = "input", anchor: str = "anchor_date") -> DataFrame:
    """One row per record: id, lane, disposition, pos and the record's fields; a text without any keeps one row.

    The text is parsed in Arrow batches by one vectorised function; null texts give no record. Records without a day of their own
    take that of the column ``anchor``, where there is one.
    """

    @F.pandas_udf(f"struct<{RECORD}>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, anchors in batches:
            yield pd.DataFrame([parse(t or "", None if pd.isna(a) else a) for t, a in zip(texts, anchors)], columns=["lane", "disposition", "records"])

    day = F.try_to_date(F.substring(anchor, 1, 10), "yyyy-MM-dd") if anchor in df.columns else F.lit(None).cast("date")
    rows = df.select("id", run(text, day).alias("p")).select("id", "p.lane", "p.disposition", F.posexplode_outer("p.records").alias("pos", "r"))
    return rows.select("id", "lane", "disposition", "pos", "r.*")


def accuracy(records: DataFrame, gold: DataFrame) -> DataFrame:
    """Per gold lane: how often lane, number of records and amounts agree."""
    got = records.groupBy("id").agg(F.first("lane").alias("lane_got"), F.count("pos").alias("n_got"), F.round(F.sum(F.coalesce("amount", F.lit(0.0))), 2).alias("sum_got"))
    total = F.round(F.aggregate("output.records", F.lit(0.0), lambda s, x: s + F.coalesce(x["amount"], F.lit(0.0))), 2)
    want = gold.select("id", F.col("output.lane").alias("lane"), F.size("output.records").alias("n"), total.alias("s"))
    j = want.join(got, "id")
    pct = lambda c: F.round(100 * F.count_if(c) / F.count(F.lit(1)), 2)
    return j.groupBy("lane").agg(
        F.count(F.lit(1)).alias("n_rows"), pct(F.col("lane") == F.col("lane_got")).alias("lane_pct"), pct(F.col("n") == F.col("n_got")).alias("count_pct"), pct(F.col("s") == F.col("sum_got")).alias("amount_pct")
    )


#: Words that decorate a description, before and after it, and words of currency. Fixed values.
FRAME_BEFORE = "on|for|spent|purchased|bought|paid|worth"
FRAME_AFTER = r"ku|kku|le|la|for|worth|vaanginen|vaangina|vaaganum|vaanga\s+vendiyathu|vanganum|kekanum|book\s+pannanum|coming|comming|this|after\s+house\s+warming"
CURRENCY_WORDS = r"rs\.?|rupees?|₹|inr|usd|kaasu|kasu"


def unframed(col: str) -> Column:
    """The text without the decorating words on both sides, however many, and without words of currency and marks at its ends."""
    c = F.regexp_replace(F.col(col), rf"(?i)^\s*(?:(?:{FRAME_BEFORE})\s+)+", "")
    c = F.regexp_replace(c, rf"(?i)(?:\s+(?:{FRAME_AFTER}))+\s*$", "")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, rf"(?i)(?<!\w)(?:{CURRENCY_WORDS})(?!\w)", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(c, r"^[,:;.\-]+|[,:;.\-]+$", ""))


def tagged(col: str) -> dict[str, Column]:
    """The leading tags, each once, the rest, and what the tags ask for: ``ask`` with at most one lane, ``write`` with one, ``none``, or
    ``unclear``."""
    c = F.col(col)
    pattern = rf"^\s*((?:(?:{TAGS})\s*[:-]\s*)+)"
    tags = F.array_distinct(F.regexp_extract_all(F.regexp_extract(F.lower(c), pattern, 1), F.lit(f"({TAGS})"), F.lit(1)))
    asks, n = F.array_contains(tags, "ask"), F.size(tags)
    kind = F.when(n == 0, "none").when(asks & (n <= 2), "ask").when(~asks & (n == 1), "write").otherwise("unclear")
    return {"tags": F.array_join(tags, ","), "body": F.trim(F.regexp_replace(c, rf"(?i){pattern}", "")), "kind": kind}


#: Words that tell what a question is about, what it wants and whose side it takes; the first rule that holds counts.
DOMAINS = (("weight", "weigh|weight|kg"), ("ledger", "owe|owes|balance|borrowed|lent|settle"), ("todo", "todo|todos|task|tasks|pending"), ("buy", "buy|shopping|list of items"), ("note", "write|wrote|note|notes"))
INTENTS = (("compare", "compare|versus|vs|than"), ("total", "total|spend|spent|how much"), ("latest", "latest|last weight|current"), ("trend", "trend|history"), ("change", "change|changed|difference"), ("balance", "owe|owes|balance"))
SIDES = (("they_owe_me", "owes me|owe me|who owes"), ("i_owe_them", "i owe|do i owe"))


def questions(asks: DataFrame) -> DataFrame:
    """Domain, intent and window of a question (id, text, asked_at); the window is null where it names none."""
    t = F.lower("text")
    has = lambda p: F.regexp_like(t, F.lit(rf"\b(?:{p})\b"))
    def first(rules: tuple[tuple[str, str], ...], other: str | None) -> Column:
        out = F.lit(other)
        for value, words in reversed(rules):
            out = F.when(has(words), value).otherwise(out)
        return out

    domain, intent, side = first(DOMAINS, "expense"), first(INTENTS, "list"), first(SIDES, None)
    windows = T.find_phrases(asks, "text", "asked_at").select("id", F.date_format("start_day", "yyyy-MM-dd").alias("start_day"), F.date_format("end_day", "yyyy-MM-dd").alias("end_day"))
    return asks.select("id", domain.alias("domain"), intent.alias("intent"), side.alias("perspective")).join(windows, "id", "left")


def infer_groups(expenses: DataFrame) -> DataFrame:
    """A group for each expense without one: that of the same description, else the one most of its words vote for.

    Votes come from all rows with a group; ties go to the group that comes first in the alphabet.
    """
    have = expenses.where("group_key IS NOT NULL")
    lack = expenses.where("group_key IS NULL").select("id", "description", normalise("description").alias("d"))
    order = F.struct("n", F.transform(F.split("g", ""), lambda c: -F.ascii(c)))
    best = lambda df, k: df.groupBy(k).agg(F.max_by("g", order).alias("g"))
    same = best(have.groupBy(normalise("description").alias("d"), F.col("group_key").alias("g")).agg(F.count(F.lit(1)).alias("n")), "d")
    exact = lack.join(same.withColumnRenamed("g", "exact"), "d", "left")
    votes = have.select(F.explode(F.array_distinct(search_words("description"))).alias("w"), F.col("group_key").alias("g")).groupBy("w", "g").agg(F.count(F.lit(1)).alias("n"))
    word = best(votes, "w")
    open_ = exact.where("exact IS NULL").select("id", F.explode(F.array_distinct(search_words("description"))).alias("w"))
    voted = best(open_.join(word, "w").groupBy("id", "g").agg(F.count(F.lit(1)).alias("n")), "id").withColumnRenamed("g", "voted")
    return exact.join(voted, "id", "left").select("id", "description", F.coalesce("exact", "voted").alias("group_key"), F.when(F.col("exact").isNotNull(), "description").when(F.col("voted").isNotNull(), "words").alias("by"))


def pieces(col: Column, vocabulary: DataFrame, most: int = 200_000, length: int | None = None) -> Column:
    """Longest-match pieces of each word, accents folded, between CLS and SEP; UNK for a word that the vocabulary has no pieces for.

    ``vocabulary``: w, n. Its ``most`` most frequent words (ties in alphabetical order) and all letters are the pieces. With ``length`` the
    result has that many pieces, cut off before SEP or filled up with PAD.
    """
    words = frozenset(r[0] for r in vocabulary.orderBy(F.desc("n"), "w").limit(most).select("w").collect())
    held = vocabulary.sparkSession.sparkContext.broadcast(words | {c for w in words for c in w})

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = held.value
        longest = max(map(len, known), default=1)

        def one(word: str) -> list[str]:
            out, at = [], 0
            while at < len(word):
                end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in known), None)
                if end is None:
                    return ["[UNK]"]
                out.append(word[at:end] if at == 0 else "##" + word[at:end])
                at = end
            return out

        def text(t: str) -> str:
            folded = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn" or not unicodedata.combining(c))
            got = [p for w in re.findall(r"[^\W_]+(?:[^\W_]|[ऀ-෿])*|[^\w\s]", folded) for p in one(w)]
            if length is not None:
                got = got[: max(0, length - 2)]
            fill = [] if length is None else ["[PAD]"] * (length - 2 - len(got))
            return " ".join(["[CLS]", *got, "[SEP]", *fill])

        return s.map(lambda t: None if t is None else text(t))

    return run(col)


def noisy(text: Column, key: Column, seed: int) -> Column:
    """A seeded slip in a text: a vowel, a pair or a letter of its longest word changed, or its spacing or case."""

    @F.pandas_udf("string")
    def run(s: pd.Series, h: pd.Series) -> pd.Series:
        def one(t: str | None, n: int) -> str | None:
            if not t:
                return t
            kind, n = n % 5, n // 5
            words = t.split(" ")
            i = max(range(len(words)), key=lambda k: (len(words[k]), -k))
            w = words[i]
            at = n % max(1, len(w) - 1)
            if kind == 0:
                w = w[:at] + w[at + 1 : at + 2] + w[at : at + 1] + w[at + 2 :]
            elif kind == 1:
                w = w[:at] + w[at + 1 :]
            elif kind == 2:
                w = w.translate(str.maketrans("aeiou", "eioua")) if n % 2 else w + w[-1:]
            elif kind == 3:
                return re.sub(" ", "  ", t, count=1)
            else:
                return t.upper() if n % 2 else t.capitalize()
            return " ".join([*words[:i], w, *words[i + 1 :]])

        return pd.Series([one(t, int(n)) for t, n in zip(s, h)], dtype=object)

    return run(text, F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)))


#: How a question begins that goes on from the one before. Fixed values.
FOLLOW_UPS = (
    "of that", "of those", "of them", "only ", "just ", "apart from", "except ", "what about", "show only", "show open", "show done", "only from", "only people",
    "done ones", "open ones", "andha ", "adhula ", "mattum", "thavira", "nethu",
)


def follows_up(col: str) -> Column:
    """Whether a tagged question goes on from the one before: at most four words, or one of the usual beginnings, and no tag of its own."""
    body = F.trim(F.regexp_replace(F.lower(F.col(col)), r"^\s*ask\s*[:-]\s*", ""))
    own = F.regexp_like(body, F.lit(r"^(?:expense|buy|todo|weight|ledger|note)\s*:"))
    begins = F.lit(False)
    for w in FOLLOW_UPS:
        begins = begins | F.startswith(body, F.lit(w))
    return (body != "") & ~own & ((F.size(F.split(body, r"\s+")) <= 4) | begins)


def follow_up_context(asks: DataFrame, key: str, order: str) -> DataFrame:
    """Each question with the one before it in the same session."""
    return asks.withColumn("before", F.lag("text").over(Window.partitionBy(key).orderBy(order)))


#: What a deal does to the balance: given away counts for, taken against. Fixed values.
DIRECTIONS = {"gave": "gave", "paid": "gave", "borrowed": "received", "received": "received", "owe": "received"}


def deals(df: DataFrame, text: str = "input") -> DataFrame:
    """Ledger entries in texts with the direction their words mean, whatever lane they are tagged with; settling has none of its own."""
    m = F.create_map(*[F.lit(x) for kv in DIRECTIONS.items() for x in kv])
    rows = extract(df, text).where("action IS NOT NULL")
    return rows.select("id", "pos", "person_text", "amount", "action", m[F.col("action")].alias("direction"))


def routes(texts: DataFrame) -> DataFrame:
    """Where an input goes (id, text): ``read`` with a domain for questions, ``write`` with a lane for records, ``note`` for the rest."""
    tag = F.split(tagged("text")["tags"], ",")[0]
    asks = (tag == "ask") | F.regexp_like(F.lower("text"), F.lit(r"^\s*(?:what|who|how|when|show|list|compare|total)\b|\?\s*$"))
    rows = extract(texts.where(tag.isin("", "expense", "buy", "todo", "ledger", "weight")).where(~asks), "text")
    lanes = rows.groupBy("id").agg(F.first("lane").alias("lane"), F.count("pos").alias("n_records"), F.first("disposition").alias("disposition"))
    out = texts.select("id", "text", asks.alias("asks"), tag.alias("tag")).join(lanes, "id", "left")
    plain = (F.col("tag") == "note") | ((F.col("tag") == "") & (F.col("lane") == "todo"))
    kind = F.when(F.col("asks"), "read").when(plain | (F.coalesce("n_records", F.lit(0)) == 0), "note").otherwise("write")
    return out.select("id", kind.alias("route"), F.when(kind == "write", F.col("lane")).alias("lane"), F.when(kind == "write", F.col("n_records")).alias("n_records"))


class RecordsOf:
    """Table function ``extract_records(text)``: one row per record of a text."""

    def eval(self, text: str):
        got = parse(text or "")
        for i, r in enumerate(got["records"]):
            what = r["description"] or r["item_text"] or r["text"] or r["person_text"]
            yield got["lane"], i, what, r["amount"] if r["amount"] is not None else r["value"]


def register(spark) -> None:
    """Makes ``extract_records`` known to SQL: ``SELECT * FROM t, LATERAL extract_records(t.text)``."""
    spark.udtf.register("extract_records", F.udtf(RecordsOf, returnType="lane: string, pos: int, what: string, amount: double"))
