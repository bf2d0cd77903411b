"""Text cut off by field limits or in transfer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import bits
from tallyloom.runtime import cut, lookup_join, once

MARKS = ".!?।॥。"
SIGN_OFF = re.compile(r"(?:\s*\n\s*(?:--+(?:\s*\S{1,12})?|bye|thanks|regards|cheers|xo+|\(?end\)?)\s*|\s*\(end\)\s*|\s+(?:…|\.\.\.)\s*|\s*[\U0001F300-\U0001FAFF☀-➿️]+\s*|\s+)$", re.I)
#: Signs put in place of the rest of a text.
GLUED = re.compile(r"(?:…|\.\.\.|\s?[\[(](?:…|\.\.\.|more|cut|truncated)[\])])+$", re.I)
SHORT = re.compile(r"\b(Rs|Mrs?|Ms|Dr|Prof|No|Sra?|St|Nr|Mme)\.(?=\s|$)")
DIGITS = re.compile(r"\d+")
NAMES = re.compile(r"\b[A-ZÀ-Þ][^\W\d_]+")
#: Context lengths in characters, of the text (plain) and of the text with capitalised words hidden.
PLAIN, HIDDEN = (4, 8, 16, 32), (16, 32)
ORDER = (("p", 4), ("p", 8), ("h", 16), ("p", 16), ("h", 32), ("p", 32))
BASE = np.uint64(0x9E3779B97F4A7C15)
PAD = "\0" * 32


def stripped(text: str) -> str:
    """The text without sign-offs, closing dots and space; a mark glued to the last word stays."""
    while True:
        text = text.rstrip()
        # All of these stand in the last line.
        m = SIGN_OFF.search(text, max(0, text.rfind("\n")))
        if not m or not text:
            return text
        text = text[: m.start()]


def plain(text: str) -> str:
    return DIGITS.sub("0", SHORT.sub(r"\1", text))


def hidden(text: str) -> str:
    return NAMES.sub("X", text)


def final_part(text: str) -> tuple[str, bool, bool, int]:
    """The text up to its last word; whether it ends with a mark of its own, or in broken bytes; 1 if the counts of the
    corpus hold its own end, else 0."""
    t = stripped(text)
    glued = GLUED.search(t)
    if glued:
        t = t[: glued.start()]
    broken = t.endswith("\ufffd")
    p = plain(t.rstrip("\ufffd"))
    bare = p.rstrip(MARKS + "\"'”’)")
    after = plain(text)[len(bare) : len(bare) + 1]
    return bare, bare != p and p[-1:] not in "\"'", broken, int(after != "" and after in MARKS + "\n")


def hashes(codes: np.ndarray, most: int = 32) -> dict[int, np.ndarray]:
    """Hash of the 4, 8, 16 and 32 characters that end at each place, by doubling."""
    h, n, out, power = codes.astype(np.uint64) + np.uint64(1), 1, {}, BASE
    with np.errstate(over="ignore"):
        while n < most:
            before = np.zeros_like(h)
            before[n:] = h[:-n]
            h = before * power + h
            power = power * power
            n *= 2
            if n >= 4:
                out[n] = (h ^ (h >> np.uint64(29))) * (BASE + np.uint64(2 * n))
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _keys(stream: str, n: int, h: np.ndarray) -> np.ndarray:
    """One 63-bit key per stream, length and context."""
    with np.errstate(over="ignore"):
        mixed = h * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n * 2 + (stream == "h"))
    return (mixed >> np.uint64(1)).astype(np.int64)


def final_keys(bare: str) -> list[int]:
    out = []
    for stream, lengths, text in (("p", PLAIN, PAD + bare[-40:]), ("h", HIDDEN, PAD + hidden(bare)[-40:])):
        got = hashes(_codes(text))
        out += [int(_keys(stream, n, got[n][-1:])[0]) for n in lengths]
    return out


def final_keys_of(texts: list[str]) -> np.ndarray:
    """A row of :func:`final_keys` for each text, all at once."""
    out = []
    for stream, lengths, ends in (("p", PLAIN, [(PAD + t[-32:])[-32:] for t in texts]), ("h", HIDDEN, [(PAD + hidden(t)[-32:])[-32:] for t in texts])):
        codes = _codes("".join(ends)).reshape(len(ends), 32).astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(31, BASE, np.uint64)]), dtype=np.uint64)[::-1]
            for n in lengths:
                h = (codes[:, -n:] * powers[-n:]).sum(axis=1, dtype=np.uint64)
                out.append(_keys(stream, n, (h ^ (h >> np.uint64(29))) * (BASE + np.uint64(2 * n))))
    return np.stack(out, axis=1) if texts else np.zeros((0, len(PLAIN) + len(HIDDEN)), np.int64)


def _tally(text: str, stream: str, lengths: tuple[int, ...], words: np.ndarray, piece: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """How often each wanted context is followed by an end (mark or new line) or goes on; ends of texts say neither."""
    for start in range(0, len(text), piece):
        part = text[max(0, start - 32) : start + piece + 2]
        codes = _codes(part)
        nxt, far = codes[1:], np.append(codes[2:], 0)
        ends = np.isin(nxt, [ord(c) for c in MARKS + "\n"])
        # A dot between digits or inside a word is no end.
        inside = (nxt == ord(".")) & ~np.isin(far, [ord(c) for c in " \n\0.\"')"])
        ends &= ~inside
        got = hashes(codes)
        keep = slice(32 if start else 0, min(len(nxt), (32 if start else 0) + piece))
        real = ((codes[:-1] != 0) & (nxt != 0))[keep]
        for n in lengths:
            keys = _keys(stream, n, got[n][:-1][keep])
            at = np.flatnonzero(real)
            at = at[bits.held(words, keys[at])]
            if len(at):
                own, where = np.unique(keys[at], return_inverse=True)
                e = ends[keep][at]
                yield pd.DataFrame({"key": own, "ends": np.bincount(where, e, len(own)).astype(np.int64), "seen": np.bincount(where, minlength=len(own)).astype(np.int64)})


FINAL = "struct<keys:array<bigint>,marked:boolean,broken:boolean,own:int,size:int>"


def end_odds(texts: DataFrame, max_bits: int = 1 << 27) -> DataFrame:
    """The log-odds that each text's last words end a sentence or entry: id, lang, source, length, marked, odds.

    ``texts``: id, text, lang, source. A backward character n-gram model: for the last 4, 8, 16 and 32 characters before
    the end, and the last 16 and 32 with capitalised words hidden, it counts over the whole corpus how often the same
    characters are followed by an end or go on, numbers written alike. The estimates are chained from short to long, the
    shorter one standing in for two observations. Only contexts that end some text are counted: a Bloom filter of their
    keys, of at most ``max_bits`` bits whatever the corpus, goes to the executors. Where the keys are more than such a filter tells
    apart, at ten bits a key, they are dealt to parts by hash and the texts are read once for each part, so what is
    shuffled stays in proportion to the contexts asked for.
    """

    @F.pandas_udf(FINAL)
    def final(text: pd.Series) -> pd.DataFrame:
        rows = [final_part(t) for t in text]
        keys = final_keys_of([r[0] for r in rows])
        return pd.DataFrame(
            {
                "keys": [k if r[0] else [] for r, k in zip(rows, keys)],
                "marked": [r[1] for r in rows],
                "broken": [r[2] for r in rows],
                "own": [r[3] for r in rows],
                "size": [len(r[0]) for r in rows],
            }
        )

    rows = texts.where(F.col("text").isNotNull()).select("id", "text", "lang", "source")
    finals = cut(rows.select("id", "lang", "source", F.length("text").alias("length"), final("text").alias("f")).select("id", "lang", "source", "length", "f.*"))
    wanted = finals.select(F.explode("keys").alias("key")).distinct()
    parts = max(1, -(-wanted.count() * 10 // max_bits))

    def counts_of(held) -> DataFrame:
        def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                pile, size = [], 0
                for i, t in enumerate(batch["text"]):
                    pile.append(plain(t))
                    size += len(t)
                    if size > 1 << 20 or i + 1 == len(batch):
                        own = PAD + PAD.join(pile) + PAD
                        yield from _tally(own, "p", PLAIN, held.value)
                        yield from _tally(PAD + PAD.join(map(hidden, pile)) + PAD, "h", HIDDEN, held.value)
                        pile, size = [], 0

        return rows.select("text").mapInPandas(tally, "key long, ends long, seen long")

    wanted = cut(wanted) if parts > 1 else wanted
    every = None
    for k in range(parts):
        own = bits.build(wanted.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k), max_bits)
        one = cut(counts_of(texts.sparkSession.sparkContext.broadcast(own)).groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("seen").alias("seen")))
        every = one if every is None else every.unionByName(one)
    # A key of one part that passes another part's filter by chance is whole in either.
    counts = every if parts == 1 else every.dropDuplicates(["key"])
    asked = finals.where(F.size("keys") > 0).select("id", "own", F.posexplode("keys").alias("at", "key"))
    met = lookup_join(asked, counts, "key")
    per = met.groupBy("id").agg(F.max("own").alias("own"), F.map_from_entries(F.collect_list(F.struct("at", F.struct("ends", "seen")))).alias("m"))
    index = {("p", n): i for i, n in enumerate(PLAIN)} | {("h", n): len(PLAIN) + i for i, n in enumerate(HIDDEN)}

    def chain(m: Column) -> Column:
        p = F.lit(0.3)
        for k in ORDER:
            own = m[F.lit(index[k])]
            # The text's own end is no evidence.
            e = F.greatest(F.coalesce(own["ends"], F.lit(0)) - F.col("own"), F.lit(0))
            n = F.greatest(F.coalesce(own["seen"], F.lit(0)) - F.col("own"), F.lit(0))
            p = (e + 2 * p) / (n + 2)
        return p

    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), chain(F.col("m"))))
    scored = per.select("id", F.log(p / (1 - p)).alias("odds"))
    return finals.select("id", "lang", "source", "length", "marked", "broken", "size").join(scored, "id", "left")


def truncated(texts: DataFrame, risk: float = 0.002, limit_odds: float = 2.0, max_bits: int = 1 << 27) -> DataFrame:
    """Every text with ``cut``: whether it was cut off inside a word, a sentence or an entry.

    A text is cut if it has no closing mark and the log-odds of its last words (:func:`end_odds`) lie under the threshold of
    its language and source: the quantile ``risk`` of the log-odds of that language's texts that do close with a mark, at
    most -1.5. ``limit_odds`` more are asked of texts as long as a field limit of their source, a length far more frequent there
    than its neighbours. A text that ends in broken bytes (U+FFFD) is cut. Texts that are null, empty or nothing but a sign-off are never cut; repeated rows count once.
    """
    rows = once(texts.select("id", "text", "lang", "source"))
    odds = cut(end_odds(rows, max_bits))
    known = odds.where("marked AND odds IS NOT NULL").groupBy("lang").agg(F.least(F.lit(-1.5), F.percentile_approx("odds", risk, 10000)).alias("threshold"))
    sizes = odds.groupBy("source", "length").agg(F.count(F.lit(1)).alias("n"))
    around = Window.partitionBy("source").orderBy("length").rangeBetween(-25, 25)
    usual = (F.sum("n").over(around) - F.col("n")) / 50
    limits = sizes.withColumn("usual", usual).where((F.col("n") >= 5) & (F.col("n") >= 6 * F.col("usual") + 3)).select("source", "length", F.lit(True).alias("at_limit"))
    marked = odds.join(limits, (odds["source"].eqNullSafe(limits["source"])) & (odds["length"] == limits["length"]), "left").select(odds["*"], "at_limit")
    # One threshold per language: a handful of rows; unknown languages have one of their own.
    out = marked.join(known.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l")
    bar = F.coalesce("threshold", F.lit(-1.5)) + F.when(F.coalesce("at_limit", F.lit(False)), limit_odds).otherwise(0.0)
    is_cut = F.col("broken") | (~F.col("marked")) & (F.col("size") > 0) & F.col("odds").isNotNull() & (F.col("odds") < bar)
    return out.select("id", "lang", "source", "length", "marked", "odds", F.coalesce("at_limit", F.lit(False)).alias("at_limit"), F.coalesce(is_cut, F.lit(False)).alias("cut"))


def report(judged: DataFrame) -> DataFrame:
    """How often each source cuts texts off."""
    n = F.count(F.lit(1))
    return judged.groupBy("source").agg(
        n.alias("n_documents"), F.count_if("cut").alias("n_cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("n_cut_at_limit"), F.round(F.count_if("cut") / n, 6).alias("share")
    )


def project_texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("id"), "text", "lang", "source")
