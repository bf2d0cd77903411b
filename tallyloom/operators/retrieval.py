"""Hybrid retrieval: words, spelling and vectors, with abstention."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyloom.functions.text import STOP_WORDS, clamp, cosine, jaccard, normalise, search_form, search_words, trigrams, word_set


@F.pandas_udf(DoubleType())
def matching_ratio(words: pd.Series, asked: pd.Series) -> pd.Series:
    """Mean over the asked words of the best matching-blocks ratio among words of a length at most four off; 1 if equal."""
    from difflib import SequenceMatcher

    memo: dict[tuple[str, str], float] = {}

    def best(q: str, ws) -> float:
        top = 0.0
        for w in ws:
            if w == q:
                return 1.0
            if abs(len(w) - len(q)) <= 4:
                key = (q, w)
                if key not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[key] = SequenceMatcher(None, q, w).ratio()
                top = max(top, memo[key])
        return top

    return pd.Series([sum(best(q, set(ws)) for q in qs) / len(qs) if ws is not None and qs is not None and len(qs) else 0.0 for ws, qs in zip(words, asked)])


def constant(df: DataFrame, value: Column) -> Column:
    """The value of an expression over no columns as a literal, so that it isn't computed for every row."""
    got = df.sparkSession.range(1).select(value.alias("v"))
    kind, v = got.schema["v"].dataType.simpleString(), got.first()["v"]
    return (F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).cast(kind)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 less the edits per letter of the longer word; a native stand-in, and another number than the matching ratio."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / n)


def lexical_parts(notes: DataFrame, query: str, text: str = "content") -> DataFrame:
    """phrase_hit, exact_recall, fuzzy_recall, trigram and their weighted sum ``lexical``."""
    q = constant(notes, normalise(F.lit(query)))
    asked, have = constant(notes, search_words(F.lit(query))), search_words(text)
    rows = notes.withColumn("_have", have).withColumn("_asked", asked)
    phrase = F.when(F.length(q) > 0, F.contains(normalise(text), q).cast("double")).otherwise(0.0)
    exact = F.when(F.size("_asked") > 0, F.size(F.filter("_asked", lambda w: F.array_contains(F.col("_have"), w))) / F.size("_asked")).otherwise(0.0)
    rows = rows.withColumn("phrase_hit", F.coalesce(phrase, F.lit(0.0))).withColumn("exact_recall", F.coalesce(exact, F.lit(0.0)))
    rows = rows.withColumn("fuzzy_recall", matching_ratio("_have", "_asked")).withColumn("trigram", F.coalesce(jaccard(trigrams(text), constant(notes, trigrams(F.lit(query)))), F.lit(0.0)))
    lexical = F.least(F.lit(1.0), 0.55 * F.col("phrase_hit") + 0.20 * F.col("exact_recall") + 0.20 * F.col("fuzzy_recall") + 0.05 * F.col("trigram"))
    return rows.drop("_have", "_asked").withColumn("lexical", lexical)


#: Weights by how sure the words are, and the least scores to answer by. Fixed values.
BLEND = ((0.45, 0.78, 0.22), (0.20, 0.65, 0.35), (None, 0.15, 0.85))
GATE = {"anchored": 0.24, "fuzzy": (0.90, 0.28), "lexical": (0.30, 0.34), "semantic": (0.12, 0.82, 0.50)}


def blend(lexical: Column, semantic: Column) -> Column:
    """The surer the words, the less the vectors count."""
    s = F.greatest(semantic, F.lit(0.0))
    (hi, a, b), (lo, c, d), (_, e, f) = BLEND
    return F.least(F.lit(1.0), F.when(lexical >= hi, a * lexical + b * s).when(lexical >= lo, c * lexical + d * s).otherwise(e * lexical + f * s))


def confident(score: Column, semantic: Column, words: Column) -> Column:
    """Any one kind of evidence that is strong enough to answer by. ``words``: the search words of the query; a whole phrase counts if a word
    of it is met or there are three at most, and single words, slips included, only beside one of four letters or more."""
    anchor, exact = F.exists(words, lambda w: F.length(w) >= 4), F.col("exact_recall") > 0
    return (
        ((F.col("phrase_hit") > 0) & (exact | (F.size(words) <= 3)))
        | (anchor & exact & (score >= GATE["anchored"]))
        | (anchor & (F.col("fuzzy_recall") >= GATE["fuzzy"][0]) & (score >= GATE["fuzzy"][1]))
        | ((F.col("lexical") >= GATE["lexical"][0]) & (score >= GATE["lexical"][1]))
        | ((F.col("lexical") >= GATE["semantic"][0]) & (semantic >= GATE["semantic"][1]) & (score >= GATE["semantic"][2]))
    )


def note_search(notes: DataFrame, vectors: DataFrame, query: str, encode: Callable[[Column], Column], k: int = 5) -> DataFrame:
    """The ``k`` best notes by the blended score, each with ``confident``; the gate is read after the cut.

    ``notes``: id, content; ``vectors``: note_id, vec. A note with several vectors counts with the nearest, one without with 0.
    The scan is one pass with a top-k; the query is a literal and nothing is broadcast.
    """
    vec = constant(vectors, encode(F.lit(query)))
    near = vectors.select(F.col("note_id").alias("id"), cosine(F.col("vec"), vec).alias("c")).groupBy("id").agg(F.max("c").alias("semantic"))
    rows = lexical_parts(notes.select("id", "content"), query).join(near, "id", "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
    rows = rows.withColumn("score", blend(F.col("lexical"), F.col("semantic")))
    top = rows.orderBy(F.desc("score"), F.desc("lexical"), F.desc("semantic"), F.desc("id")).limit(k)
    return top.withColumn("confident", confident(F.col("score"), F.col("semantic"), constant(notes, search_words(F.lit(query)))))


def simple_scores(notes: DataFrame, vectors: DataFrame, query: str, encode: Callable[[Column], Column]) -> DataFrame:
    """A plainer scorer: containment and shared words for the text, the clamped cosine for the vector."""
    q, vec = constant(notes, word_set(F.lit(query))), constant(vectors, encode(F.lit(query)))
    shared = F.when(F.size(q) > 0, F.size(F.array_intersect(word_set("content"), q)) / F.size(q)).otherwise(0.0)
    lex = 0.6 * F.contains(F.lower("content"), F.lit(query.lower())).cast("double") + 0.4 * shared
    near = vectors.select(F.col("note_id").alias("id"), clamp(cosine(F.col("vec"), vec), 0.0, 1.0).alias("c")).groupBy("id").agg(F.max("c").alias("semantic"))
    rows = notes.select("id", "content", lex.alias("lexical")).join(near, "id", "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
    return rows.withColumn("score", 0.55 * F.col("lexical") + 0.45 * F.col("semantic"))


def vector_search(vectors: DataFrame, query: Column, k: int, domain: str | None = None, least: float | None = None) -> DataFrame:
    """The ``k`` nearest vectors by cosine, of one domain and of at least a score where asked."""
    rows = vectors.where(F.col("domain") == domain) if domain else vectors
    rows = rows.withColumn("score", F.round(cosine(F.col("embedding"), constant(vectors, query)), 6))
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    return rows.orderBy(F.desc("score"), "id").limit(k)


def abstain(top: DataFrame, least: float, *query: str) -> DataFrame:
    """The hits if the best one reaches ``least``, else none; ``query``: the columns that tell queries apart."""
    best = F.max("score").over(Window.partitionBy(*(query or [F.lit(1)])))  # over the few hits only
    return top.withColumn("_best", best).where(F.col("_best") >= least).drop("_best")


# Many queries --------------------------------------------------------------------------------------------------------
#
# Rows and queries are dealt into blocks of about BLOCK. Each pair of blocks is a group that is scored in arrays and gives
# its best k of each query; of these the best k are kept. Texts are cut up by the expressions above and sums are taken in
# their order, so that scores and ties are those of the search for one query.

BLOCK = 1000
PARTITIONS = 2000
#: Rows and queries of a block where a matrix product estimates all pairs and only those that may be among the best are scored.
VECTOR_BLOCK = (16_384, 2_048)
#: Queries estimated at a time, and by how much an estimate or a score rounded to six decimals may be off.
CHUNK, SLACK = 128, 1.1e-6
#: Rows and queries of a block of :func:`note_searches`.
NOTE_BLOCK = (8_192, 4_096)
_MEMO: dict[tuple[str, ...], dict[str, np.ndarray]] = {}
_MEMO_BYTES = 64_000_000


def _codes(words: list[str]) -> np.ndarray:
    """A column per word of up to 16 letters, ended by zeros."""
    return np.frombuffer(b"".join(w.encode().ljust(16, b"\0") for w in words), np.uint8).reshape(len(words), 16).T.copy()


def _matching(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters in the matching blocks of each column of ``a`` and ``b``, as SequenceMatcher finds them: the longest block, of
    these the first in ``a``, then in ``b``, and so on to its left and right."""
    total, own = np.zeros(a.shape[1], np.uint16), np.arange(a.shape[1])
    b = np.where(b == 0, np.uint8(255), b)
    while len(own):
        top = np.zeros(len(own), np.uint16)
        before = [np.zeros(len(own), np.uint16)] * (len(b) + 1)
        for i in range(len(a)):
            runs = [before[0]]
            for j in range(len(b)):
                run = (before[j] + np.uint16(1)) * (a[i] == b[j])
                runs.append(run)
                np.maximum(top, run * np.uint16(256) + np.uint16((15 - i) * 16 + 15 - j), out=top)
            before = runs
        size, i, j = (x.astype(np.int16) for x in (top >> 8, 15 - (top >> 4 & 15), 15 - (top & 15)))
        np.add.at(total, own, size.astype(np.uint16))
        parts, at_a, at_b = [], np.arange(len(a))[:, None], np.arange(len(b))[:, None]
        for on in ((size > 0) & (i >= size) & (j >= size), (size > 0) & (i + 1 < len(a)) & (j + 1 < len(b))):
            x = np.flatnonzero(on)
            left = not parts
            in_a, in_b = (at_a <= (i - size)[x], at_b <= (j - size)[x]) if left else (at_a > i[x], at_b > j[x])
            parts.append((own[x], np.where(in_a, a[:, x], np.uint8(0)), np.where(in_b, b[:, x], np.uint8(255))))
        own, a, b = (np.concatenate(c, axis=-1) for c in zip(*parts))
        some = (a != 0).any(axis=0) & (b != 255).any(axis=0)
        own, a, b = own[some], a[:, some], b[:, some]
    return total


def _matches(words: list[str], asked: list[str]) -> np.ndarray:
    """Letters in matching blocks of each word (down) with each asked word (across), 0 where the lengths differ by more than four.

    Words without digits come again in every block and are remembered; those with digits are many and short.
    """
    from difflib import SequenceMatcher

    known = _MEMO.setdefault(tuple(asked), {})
    out, new = np.zeros((len(words), len(asked)), np.uint16), []
    for i, w in enumerate(words):
        if (row := known.get(w)) is not None:
            out[i] = row
        else:
            new.append(i)
    lengths, theirs = np.array([len(words[i]) for i in new], int), np.array([len(q) for q in asked], int)
    code, codes = _codes([w if len(w) <= 16 else "" for w in (words[i] for i in new)]), _codes([q if len(q) <= 16 else "" for q in asked])
    letters = lambda ws: np.array([sum(1 << ord(c) % 61 for c in set(w)) for w in ws], np.int64)
    ours, asks = letters([words[i] for i in new]), letters(asked)
    step = max(1, 2_000_000 // max(1, len(asked)))
    for first in range(0, len(new), step):
        some = slice(first, first + step)
        v, q = np.nonzero((np.abs(lengths[some, None] - theirs[None, :]) <= 4) & ((ours[some, None] & asks[None, :]) != 0))
        v = v + first
        long = (lengths[v] > 16) | (theirs[q] > 16)
        for x, y in zip(v[long].tolist(), q[long].tolist()):
            out[new[x], y] = sum(m.size for m in SequenceMatcher(None, asked[y], words[new[x]]).get_matching_blocks())
        v, q = v[~long], q[~long]
        order = np.argsort(lengths[v] * 32 + theirs[q], kind="stable")
        for at in range(0, len(order), 16_384):
            x, y = v[order[at : at + 16_384]], q[order[at : at + 16_384]]
            out[np.array(new)[x], y] = _matching(codes[: theirs[y].max(), y], code[: lengths[x].max(), x])
    room = _MEMO_BYTES - sum(r.nbytes for m in _MEMO.values() for r in m.values())
    for i in new:
        if not any(c.isdigit() for c in words[i]) and (room := room - out[i].nbytes) > 0:
            known[words[i]] = out[i].copy()
    return out


def _held(sets: list, index: dict[str, int], repeats: bool = False) -> np.ndarray:
    """A row per set that counts its members by ``index``."""
    out = np.zeros((len(sets), len(index)), np.float32)
    for i, members in enumerate(sets):
        for x in members or ():
            if (j := index.get(x)) is not None:
                out[i, j] = out[i, j] + 1 if repeats else 1
    return out


def _sizes(sets: list) -> np.ndarray:
    return np.array([len(x or ()) for x in sets], float)


def _index(sets: list) -> dict[str, int]:
    return {x: j for j, x in enumerate(sorted({x for members in sets for x in members or ()}))}


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(np.broadcast_shapes(part.shape, whole.shape)), where=whole > 0)


def _block_cosine(vectors: list, asks: list) -> np.ndarray:
    """:func:`cosine` of each query (down) and vector (across), added up in the same order."""
    width = max((len(v or ()) for v in [*vectors, *asks]), default=0)

    def padded(vs: list) -> np.ndarray:
        return np.array([[*(v or ()), *[0.0] * (width - len(v or ()))] for v in vs], float).reshape(len(vs), width)

    a, b = padded(vectors), padded(asks)
    dots, na, nb = np.zeros((len(b), len(a))), np.zeros(len(a)), np.zeros(len(b))
    for d in range(width):
        dots += a[:, d][None, :] * b[:, d][:, None]
        na += a[:, d] * a[:, d]
        nb += b[:, d] * b[:, d]
    n = np.sqrt(na)[None, :] * np.sqrt(nb)[:, None]
    return np.divide(dots, n, out=np.zeros(dots.shape), where=(n != 0) & (_sizes(vectors)[None, :] == _sizes(asks)[:, None]))


def _block_semantic(rows: dict[str, list], asks: dict[str, list], floor: bool = False) -> np.ndarray:
    """The nearest vector of each row, 0 without one."""
    out = np.zeros((len(asks["id"]), len(rows["id"])))
    if has := [i for i, vs in enumerate(rows["vecs"]) if vs]:
        near = _block_cosine([v for i in has for v in rows["vecs"][i]], asks["vec"])
        starts = np.cumsum([0, *(len(rows["vecs"][i]) for i in has)])[:-1]
        out[:, has] = np.maximum.reduceat(near, starts, axis=1)
    return np.clip(out, 0.0, 1.0) if floor else out


def _block_simple(rows: dict[str, list], asks: dict[str, list]) -> dict[str, np.ndarray]:
    index = _index(asks["words"])
    shared = _share((_held(asks["words"], index) @ _held(rows["words"], index).T).astype(float), _sizes(asks["words"])[:, None])
    contained = np.array([[float(q in t) for t in (x or "" for x in rows["norm"])] for q in (x or "" for x in asks["norm"])])
    lexical, semantic = 0.6 * contained + 0.4 * shared, _block_semantic(rows, asks, floor=True)
    return {"lexical": lexical, "semantic": semantic, "score": 0.55 * lexical + 0.45 * semantic}


def _dealt(rows: DataFrame, asks: DataFrame, pair: Callable[[pa.Table, pa.Table], pa.Table], columns: tuple[str, ...], block: tuple[int, int]) -> DataFrame:
    """query_id, id and ``columns`` of ``pair`` for each block of about ``block[0]`` rows with each of ``block[1]`` queries."""
    n, m = (max(1, -(-df.count() // size)) for df, size in zip((rows, asks), block))

    def deal(df: DataFrame, own: str, size: int, other: str, parts: int) -> DataFrame:
        df = df.toDF(*df.columns)  # columns of its own, for both sides may come from one relation
        if parts > size:  # few rows of which many copies are made: in many tasks
            df = df.repartition(min(parts, 24), "id")
        df = df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(size).cast("long"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        return df.repartition(min(4 * n * m, PARTITIONS), "_row", "_ask")  # a given number: small tables, but much work, that isn't to be drawn together

    schema = "query_id long, id long, " + ", ".join(f"{c} double" for c in columns)
    left, right = deal(rows, "_row", n, "_ask", m).groupBy("_row", "_ask"), deal(asks, "_ask", m, "_row", n).groupBy("_row", "_ask")
    return left.cogroup(right).applyInArrow(pair, schema)


def _best(met: DataFrame, by: list[str], k: int, newest: bool) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(*[F.desc(c) for c in by], F.desc("id") if newest else F.asc("id"))
    return met.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k).drop("_at")


def _scored(queries: np.ndarray, ids: np.ndarray, scores: dict[str, np.ndarray]) -> pa.Table:
    return pa.table({"query_id": pa.array(queries, pa.int64()), "id": pa.array(ids, pa.int64()), **{c: pa.array(v, pa.float64()) for c, v in scores.items()}})


def _met(rows: DataFrame, asks: DataFrame, score: Callable[[dict, dict], dict[str, np.ndarray]], columns: tuple[str, ...], k: int | None, newest: bool, least: float | None = None) -> DataFrame:
    """query_id, id and the scores of the best ``k`` rows of each query, of all rows without ``k``. Ties go by the lexical and
    the semantic score where there are parts, then by id, the newest or the oldest first."""
    by = [c for c in ("score", "lexical", "semantic") if c in columns] if "phrase_hit" in columns else ["score"]

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        own, asked = left.to_pydict(), right.to_pydict()
        ids, queries = np.array(own["id"], np.int64), np.array(asked["id"], np.int64)
        out: dict[str, list[np.ndarray]] = {c: [] for c in ("query_id", "id", *columns)}
        if len(ids) and len(queries):
            got = score(own, asked)
            for j, q in enumerate(queries):
                x = got["score"][j]
                take = np.arange(len(ids)) if least is None else np.flatnonzero(x >= least)
                if k is not None and len(take) > k:
                    take = take[x[take] >= np.partition(x[take], -k)[-k]]
                    take = take[np.lexsort([ids[take] * (-1 if newest else 1), *(-got[c][j][take] for c in reversed(by))])[:k]]
                out["query_id"].append(np.full(len(take), q))
                out["id"].append(ids[take])
                for c in columns:
                    out[c].append(got[c][j][take])
        return pa.table({c: pa.array(np.concatenate(v) if v else np.array([], float if c in columns else np.int64)) for c, v in out.items()})

    met = _dealt(rows, asks, pair, columns, (BLOCK, BLOCK))
    return met if k is None else _best(met, by, k, newest)


def _with_vectors(notes: DataFrame, vectors: DataFrame) -> DataFrame:
    known = vectors.where(F.col("note_id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))
    return notes.join(known.groupBy(F.col("note_id").alias("id")).agg(F.collect_list("vec").alias("vecs")), "id", "left")


PARTS = ("phrase_hit", "exact_recall", "fuzzy_recall", "trigram", "lexical", "semantic", "score")


def simple_searches(notes: DataFrame, vectors: DataFrame, queries: DataFrame, encode: Callable[[Column], Column], k: int | None = 10) -> DataFrame:
    """The best ``k`` by :func:`simple_scores` for every row of ``queries`` (id, content)."""
    cut = [F.lower("content").alias("norm"), word_set("content").alias("words")]
    rows, asks = _with_vectors(notes.select("id", *cut), vectors), queries.select("id", *cut, encode(F.col("content")).alias("vec"))
    return _met(rows, asks, _block_simple, ("lexical", "semantic", "score"), k, newest=True)


class _Vectors:
    """Vectors as rows of one matrix, padded with zeros; ``unsure`` marks those whose estimates can't be trusted."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        lists = column.combine_chunks()
        self.sizes = np.diff(lists.offsets.to_numpy())
        self.padded = np.zeros((len(lists), int(self.sizes.max(initial=0))))
        self.padded[np.arange(self.padded.shape[1]) < self.sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        self.norms = np.zeros(len(lists))
        with np.errstate(all="ignore"):
            for d in range(self.padded.shape[1]):
                self.norms += self.padded[:, d] * self.padded[:, d]
            self.norms = np.sqrt(self.norms)
            self.unsure = ~((self.norms == 0) | (self.norms > 1e-100) & (self.norms < 1e100))
            self.units = np.where((self.norms == 0) | self.unsure, 0.0, 1.0)[:, None] * np.nan_to_num(self.padded / np.where(self.norms == 0, 1.0, self.norms)[:, None])

    def estimates(self, others: _Vectors, some: slice) -> np.ndarray:
        """Cosines of ``some`` of these (down) to the others (across), but for the order of the sum."""
        width = min(self.padded.shape[1], others.padded.shape[1])
        out = self.units[some, :width] @ others.units[:, :width].T
        if len({*self.sizes[some].tolist(), *others.sizes.tolist()}) > 1:
            out[self.sizes[some][:, None] != others.sizes[None, :]] = 0.0
        return out

    def cosines(self, at: np.ndarray, others: _Vectors, to: np.ndarray) -> np.ndarray:
        """:func:`cosine` of each pair, added up in the same order."""
        dots = np.zeros(len(at))
        with np.errstate(all="ignore"):
            for d in range(min(self.padded.shape[1], others.padded.shape[1])):
                dots += self.padded[at, d] * others.padded[to, d]
            n = self.norms[at] * others.norms[to]
            return np.divide(dots, n, out=np.zeros(len(at)), where=(n != 0) & (self.sizes[at] == others.sizes[to]))


def _rounded(values: np.ndarray) -> np.ndarray:
    """To six decimals, halves up by the shortest decimal form, as Spark rounds."""
    from decimal import ROUND_HALF_UP, Decimal

    with np.errstate(all="ignore"):
        scaled = values * 1e6
        out = np.rint(scaled) / 1e6 + 0.0
        for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
            out[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    return out


def _nearest(k: int | None, least: float | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, queries, got = left["id"].to_numpy(), right["id"].to_numpy(), []
        rows, asks = (_Vectors(t["vec"]) for t in (left, right)) if len(ids) and len(queries) else (None, None)
        for first in range(0, len(queries) if len(ids) else 0, CHUNK):
            near = asks.estimates(rows, slice(first, first + CHUNK))
            unsure = asks.unsure[first : first + CHUNK, None] | rows.unsure[None, :] if asks.unsure.any() or rows.unsure.any() else None
            if unsure is not None:
                near[unsure] = -np.inf
            low = np.full(len(near), -np.inf if least is None else least - SLACK)
            if k is not None and len(ids) > k:
                low = np.maximum(low, np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k] - SLACK)
            j, i = np.nonzero(near >= low[:, None] if unsure is None else (near >= low[:, None]) | unsure)
            score = _rounded(asks.cosines(j + first, rows, i))
            keep = np.isnan(score) | (score >= (-np.inf if least is None else least))  # NaN sorts above all numbers and is kept, as in SQL
            j, i, score = j[keep], i[keep], score[keep]
            order = np.lexsort((ids[i], -np.where(np.isnan(score), np.inf, score), j))
            j, i, score = j[order], i[order], score[order]
            if k is not None:
                keep = np.arange(len(j)) - np.searchsorted(j, j) < k
                j, i, score = j[keep], i[keep], score[keep]
            got.append((queries[j + first], ids[i], score))
        q, x, s = (np.concatenate(c) for c in zip(*got)) if got else ([], [], [])
        return _scored(q, x, {"score": s})

    return pair


def vector_searches(vectors: DataFrame, queries: DataFrame, k: int | None, least: float | None = None) -> DataFrame:
    """:func:`vector_search` for every row of ``queries``; both have id and embedding."""
    whole = lambda df: df.select("id", F.col("embedding").alias("vec")).where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))
    met = _dealt(whole(vectors), whole(queries), _nearest(k, least), ("score",), VECTOR_BLOCK)
    return met if k is None else _best(met, ["score"], k, newest=False)


class _Texts:
    """Normalised texts, search words and trigrams, cut from the search form as the expressions of the texts do."""

    def __init__(self, table: pa.Table) -> None:
        self.ids = table["id"].to_numpy()
        self.norms = [x or "" for x in table["norm"].to_pylist()]
        forms = [x or "" for x in table["form"].to_pylist()]
        kept: dict[str, bool] = {}
        for w in {w for t in forms for w in t.split(" ")}:
            kept[w] = w not in STOP_WORDS and (len(w) >= 3 or any(c.isdigit() for c in w))
        self.words = [[w for w in t.split(" ") if kept[w]] for t in forms]
        self.pieces = [{t[i : i + 3] for i in range(max(len(t) - 2, 1))} if t else set() for t in forms]
        self.sizes = np.array([len(p) for p in self.pieces], np.float32)


class _Phrases:
    """Which texts hold a phrase: its inner words stand whole in them, so only the texts with the rarest of these are read."""

    def __init__(self, norms: list[str]) -> None:
        self.norms, self.at = norms, {}
        for i, t in enumerate(norms):
            for w in set(t.split(" ")):
                self.at.setdefault(w, []).append(i)

    def holding(self, phrase: str) -> list[int]:
        inner = phrase.split(" ")[1:-1]
        some = min((self.at.get(w, ()) for w in inner), key=len) if inner else range(len(self.norms))
        return [i for i in some if phrase in self.norms[i]] if phrase else []


class _Block:
    """A block of notes against a block of queries: estimates of all scores of a query, and the exact parts of chosen pairs."""

    def __init__(self, left: pa.Table, right: pa.Table) -> None:
        self.rows, self.asks = rows, asks = _Texts(left), _Texts(right)
        self.phrases = _Phrases(rows.norms)
        vocabulary, self.asked = (_index(t.words) for t in (rows, asks))
        self.matches = _matches(list(vocabulary), list(self.asked))
        self.lengths, self.asked_lengths = (np.array([len(w) for w in words], np.int64) for words in (vocabulary, self.asked))
        self.own = [np.array([vocabulary[w] for w in set(words)], np.int64) for words in rows.words]
        self.theirs = [np.array([self.asked[w] for w in words], np.int64) for words in asks.words]
        letters = np.add.outer(self.lengths.astype(np.float32), self.asked_lengths.astype(np.float32))
        ratios = np.float32(2) * self.matches
        ratios /= np.maximum(letters, 1, out=letters)
        del letters
        self.best = np.zeros((len(self.asked), len(rows.ids)), np.float32)
        for first in range(0, len(rows.ids), CHUNK):
            best = np.zeros((min(CHUNK, len(rows.ids) - first), len(self.asked)), np.float32)
            for i, own in enumerate(self.own[first : first + CHUNK]):
                if len(own):
                    np.maximum.reduce(ratios[own], axis=0, out=best[i])
            best += best == 1  # words met count for both the exact and the fuzzy recall, of like weight
            self.best[:, first : first + CHUNK] = best.T
        del ratios
        index = _index(asks.pieces)
        self.piece_of = [[index[p] for p in pieces] for pieces in asks.pieces]
        self.pieces = np.zeros((len(index) + 1, len(rows.ids)), np.uint8)  # the last for pieces that no query has
        for i, pieces in enumerate(rows.pieces):
            self.pieces[list(map(index.get, pieces, repeat(len(index)))), i] = 1
        lists = left["vecs"].combine_chunks()
        self.counts = np.diff(lists.offsets.to_numpy())
        self.starts = np.cumsum(self.counts) - self.counts
        self.has = np.flatnonzero(self.counts)
        self.vectors, self.vec = _Vectors(pa.chunked_array([lists.flatten()])), _Vectors(right["vec"])
        self.unsure = np.zeros(len(rows.ids), bool)
        if len(self.has):
            self.unsure[self.has] = np.logical_or.reduceat(self.vectors.unsure, self.starts[self.has])

    def semantic(self, some: slice) -> np.ndarray:
        near = self.vec.estimates(self.vectors, some)
        out = np.zeros((len(near), len(self.counts)), np.float32)
        if len(self.has):
            out[:, self.has] = np.maximum.reduceat(near, self.starts[self.has], axis=1)
        return out

    def semantic_of(self, j: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The nearest vector of each row, 0 without one."""
        out, has = np.zeros(len(j)), np.flatnonzero(self.counts[i])
        if len(has):
            n = self.counts[i[has]]
            firsts = np.cumsum(n) - n
            near = self.vec.cosines(np.repeat(j[has], n), self.vectors, np.repeat(self.starts[i[has]] - firsts, n) + np.arange(n.sum()))
            out[has] = np.maximum.reduceat(near, firsts)
        return out

    def shared(self, j: int) -> np.ndarray:
        """How many trigrams of the query each row has."""
        at, out, add = self.piece_of[j], np.zeros(len(self.counts), np.float32), np.add
        for first in range(0, len(at), 255):
            some = np.zeros(len(self.counts), np.uint8)
            for p in at[first : first + 255]:
                add(some, self.pieces[p], some)
            out += some
        return out

    def candidates(self, j: int, semantic: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that may be among the best ``k``, whether they hold the phrase, and their shared trigrams."""
        phrase, shared, words = np.zeros(len(self.counts), np.float32), self.shared(j), self.theirs[j]
        phrase[self.phrases.holding(self.asks.norms[j])] = 1
        if k is None or len(phrase) <= k:
            take = np.arange(len(phrase))
            return take, phrase, shared
        x = np.float32(0.05) * shared / np.maximum(self.asks.sizes[j] + self.rows.sizes - shared, 1) + np.float32(0.55) * phrase
        if len(words):
            total = np.zeros(len(phrase), np.float32)
            for w in words.tolist():
                total += self.best[w]
            total *= np.float32(0.20 / len(words))
            x += total
        np.minimum(x, 1, out=x)
        off = np.float32(2e-6 + 1e-7 * len(words))  # what sums of single precision may be off
        s = np.maximum(semantic, 0)
        (hi, a, b), (lo, c, d), (_, e, f) = BLEND
        score = np.where(x >= hi, np.float32(a) * x + np.float32(b) * s, np.where(x >= lo, np.float32(c) * x + np.float32(d) * s, np.float32(e) * x + np.float32(f) * s))
        always = (np.abs(x - np.float32(hi)) <= off) | (np.abs(x - np.float32(lo)) <= off) | self.unsure | self.vec.unsure[j]
        score[always] = -1
        least = np.partition(score, len(score) - k)[len(score) - k] - 3 * off
        always |= score >= least
        if least <= 0:  # rows without any evidence score 0 in every part: of these the newest go first
            none = np.flatnonzero(always & (x == 0) & (semantic == 0) & ~self.unsure & ~self.vec.unsure[j])
            if len(none) > k:
                always[none] = False
                always[none[np.argsort(-self.rows.ids[none], kind="stable")[:k]]] = True
        return np.flatnonzero(always), phrase, shared

    def lexical_of(self, j: int, rows: np.ndarray, phrase: np.ndarray, shared: np.ndarray) -> list[tuple[float, ...]]:
        """:func:`lexical_parts` of a query and its chosen rows."""
        words, n, size, out = self.theirs[j], len(self.theirs[j]), len(self.asks.pieces[j]), []
        for i in rows.tolist():
            exact = fuzzy = 0.0
            if n:
                if len(own := self.own[i]):
                    ratios = (2.0 * self.matches[own[:, None], words] / (self.lengths[own][:, None] + self.asked_lengths[words])).max(axis=0).tolist()
                    exact, fuzzy = ratios.count(1.0) / n, sum(ratios) / n
            both, p = int(shared[i]), float(phrase[i])
            union = size + len(self.rows.pieces[i]) - both
            trigram = both / union if union else 0.0
            out.append((p, exact, fuzzy, trigram, min(1.0, 0.55 * p + 0.20 * exact + 0.20 * fuzzy + 0.05 * trigram)))
        return out


def _noted(k: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, queries = left["id"].to_numpy(), right["id"].to_numpy()
        block, got = _Block(left, right) if len(ids) and len(queries) else None, []
        for first in range(0, len(queries) if block else 0, CHUNK):
            near, js, rows, parts = block.semantic(slice(first, first + CHUNK)), [], [], []
            for j in range(first, first + len(near)):
                take, phrase, shared = block.candidates(j, near[j - first], k)
                js.append(np.full(len(take), j))
                rows.append(take)
                parts += block.lexical_of(j, take, phrase, shared)
            j, i = np.concatenate(js), np.concatenate(rows)
            *single, x = np.array(parts, float).reshape(len(j), 5).T
            semantic = block.semantic_of(j, i)
            s = np.maximum(semantic, 0.0)
            (hi, a, b), (lo, c, d), (_, e, f) = BLEND
            score = np.minimum(1.0, np.where(x >= hi, a * x + b * s, np.where(x >= lo, c * x + d * s, e * x + f * s)))
            order = np.lexsort((-ids[i], -semantic, -x, -score, j))
            if k is not None:
                order = order[np.arange(len(j)) - np.searchsorted(j[order], j[order]) < k]
            got.append([v[order] for v in (queries[j], ids[i], *single, x, semantic, score)])
        q, at, *scores = (np.concatenate(c) for c in zip(*got)) if got else [[] for _ in range(2 + len(PARTS))]
        return _scored(q, at, dict(zip(PARTS, scores)))

    return pair


def note_searches(notes: DataFrame, vectors: DataFrame, queries: DataFrame, encode: Callable[[Column], Column], k: int | None = 5) -> DataFrame:
    """:func:`note_search` for every row of ``queries`` (id, content); without ``k`` the scores of all notes for each."""
    cut = [normalise("content").alias("norm"), search_form("content").alias("form")]
    rows = _with_vectors(notes.select("id", *cut), vectors)
    asks = queries.select("id", *cut, encode(F.col("content")).alias("vec"))
    met = _dealt(rows, asks, _noted(k), PARTS, NOTE_BLOCK)
    top = met if k is None else _best(met, ["score", "lexical", "semantic"], k, newest=True)
    words = queries.select(F.col("id").alias("query_id"), F.coalesce(search_words("content"), F.array().cast("array<string>")).alias("_asked"))
    return top.join(words, "query_id").withColumn("confident", confident(F.col("score"), F.col("semantic"), F.col("_asked"))).drop("_asked")
