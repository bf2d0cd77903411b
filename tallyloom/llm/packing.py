"""Filling fixed-capacity containers with whole documents."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tokens import VOCABULARY, with_tokens
from tallyloom.runtime import cut, once


class Stock:
    """Item sizes in ascending order with the items of each size; the largest that fits comes out by bisection."""

    def __init__(self, sizes: list[int]):
        self.order = sorted(range(len(sizes)), key=lambda i: (sizes[i], -i))
        self.sizes = [sizes[i] for i in self.order]

    def __len__(self) -> int:
        return len(self.sizes)

    def fitting(self, room: int) -> int:
        """Place of the largest item of at most ``room``, -1 if none."""
        return bisect.bisect_right(self.sizes, room) - 1

    def take(self, at: int) -> tuple[int, int]:
        return self.order.pop(at), self.sizes.pop(at)

    def put(self, at: int, item: int, size: int) -> None:
        self.order.insert(at, item)
        self.sizes.insert(at, size)

    def best_pair(self, room: int, floor: int) -> int:
        """The largest sum of two items of at most ``room``; stops as soon as it exceeds ``floor``."""
        lo, hi, best = 0, self.fitting(room), 0
        while lo < hi:
            s = self.sizes[lo] + self.sizes[hi]
            if s <= room:
                best = max(best, s)
                if best > floor:
                    return best
                lo += 1
            else:
                hi -= 1
        return best


def reduce_dominated(sizes: list[int], capacity: int) -> tuple[list[list[int]], Stock]:
    """Martello-Toth reduction: containers of at most two items that dominate every other container of their largest item.

    For each open item from the largest on, with room ``r`` left and ``k`` the largest item that fits beside it: the item alone is best
    if nothing fits; {item, k} is best if k fills the room, or if every other set of two or more items that fits (only
    pairs, when the three smallest don't fit) sums to at most k, for it could take k's place elsewhere.
    """
    stock, fixed = Stock(sizes), []
    # Items that stay open remain in the stock, for they may still go beside a smaller one; ``at`` is the next to look at.
    at = len(stock) - 1
    while at >= 0:
        i, w = stock.take(at)
        room = capacity - w
        k = stock.fitting(room)
        if k < 0:
            fixed.append([i])
            at -= 1
            continue
        fill = stock.sizes[k]
        pair_fits = len(stock) >= 2 and stock.sizes[0] + stock.sizes[1] <= room
        triple_fits = len(stock) >= 3 and sum(stock.sizes[:3]) <= room
        if fill == room or not pair_fits or (not triple_fits and stock.best_pair(room, fill) <= fill):
            fixed.append([i, stock.take(k)[0]])
            at -= 2 if k < at else 1
        else:
            stock.put(at, i, w)
            at -= 1
    return fixed, stock


def best_fit(rest: Stock, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes where it leaves the least room, into a new container if none has enough."""
    rooms: list[tuple[int, int]] = []  # (room left, container), ascending
    out: list[list[int]] = []
    while len(rest):
        i, w = rest.take(len(rest) - 1)
        at = bisect.bisect_left(rooms, (w, -1))
        if at < len(rooms):
            room, c = rooms.pop(at)
        else:
            room, c = capacity, len(out)
            out.append([])
        out[c].append(i)
        if room > w:
            bisect.insort(rooms, (room - w, c))
    return out


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers (lists of positions) for items of at most ``capacity``; items without size go along with the first one."""
    own = [i for i, w in enumerate(sizes) if w > 0]
    fixed, rest = reduce_dominated([sizes[i] for i in own], capacity)
    bins = [[own[i] for i in b] for b in fixed + best_fit(rest, capacity)]
    empty = [i for i, w in enumerate(sizes) if w <= 0]
    if empty:
        if bins:
            bins[0] += empty
        else:
            bins = [empty]
    return bins


def fill_containers(documents: DataFrame, packs: DataFrame, vocabulary: str = VOCABULARY, block: int = 8192) -> DataFrame:
    """One row per container: pack_name, container_id, capacity_tokens, fill_tokens, fill, parts.

    ``documents``: doc_id, text; ``packs``: pack_name, capacity_tokens (a small table of container sizes; the documents
    are counted once and laid out once for each size). ``parts`` lists doc_id, part_no (0 for a whole document, else 1, 2,
    ...) and tokens. A document longer than the capacity, and only such a one, is split: its full parts make full
    containers and its remainder is packed with the others. Documents are dealt by hash into blocks of about ``block``, each
    packed by itself: dominance reduction first, best-fit decreasing for what is left, so a block wastes at most the room
    of its last containers however many blocks there are.

    Documents with null text or id are left out; empty ones take no room; repeated rows count once; sizes that are null
    or below 1 and repeated sizes are left out; equal sizes are ordered by doc_id, so the result is the same every time.
    """
    rows = with_tokens(documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"), vocabulary=vocabulary)
    sized = cut(once(rows.select("doc_id", "tokens"), "doc_id"))
    sizes = once(packs.where("pack_name IS NOT NULL AND capacity_tokens >= 1").select("pack_name", "capacity_tokens"), "pack_name")
    blocks = max(1, round(sized.count() / block))
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    offers = [r.asDict() for r in sizes.orderBy("pack_name").collect()]
    if not offers:
        return _empty(documents)
    pack = F.array(*[F.struct(F.lit(o["pack_name"]).alias("pack_name"), F.lit(int(o["capacity_tokens"])).cast("long").alias("capacity_tokens")) for o in offers])
    laid = dealt.withColumn("p", F.explode(pack)).select("doc_id", "tokens", "block", "p.*")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        name, capacity, b = pdf["pack_name"].iloc[0], int(pdf["capacity_tokens"].iloc[0]), int(pdf["block"].iloc[0])
        out, items = [], []
        for doc, n in zip(pdf["doc_id"], pdf["tokens"]):
            doc, n = int(doc), int(n)
            full = n // capacity if n > capacity else 0
            for part in range(full):
                out.append([(doc, part + 1, capacity)])
            if n > capacity and n % capacity:
                items.append((doc, full + 1, n % capacity))
            elif n <= capacity:
                items.append((doc, 0, n))
        out += [[items[i] for i in c] for c in pack_block([w for _, _, w in items], capacity)]
        fills = [sum(w for _, _, w in c) for c in out]
        return pd.DataFrame(
            {
                "pack_name": name,
                "container_id": [f"{b}-{i}" for i in range(len(out))],
                "capacity_tokens": capacity,
                "fill_tokens": fills,
                "fill": [round(f / capacity, 6) for f in fills],
                "parts": [[{"doc_id": d, "part_no": k, "tokens": w} for d, k, w in c] for c in out],
            }
        )

    return laid.groupBy("pack_name", "block").applyInPandas(whole, SCHEMA)


SCHEMA = "pack_name string, container_id string, capacity_tokens long, fill_tokens long, fill double, parts array<struct<doc_id:long,part_no:int,tokens:long>>"


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], SCHEMA)


def report(containers: DataFrame) -> DataFrame:
    """Per container size: how many, how full, and the least that any packing needs."""
    total, capacity = F.sum("fill_tokens"), F.first("capacity_tokens")
    return containers.groupBy("pack_name").agg(
        capacity.alias("capacity_tokens"),
        F.count(F.lit(1)).alias("n_containers"),
        F.ceil(total / capacity).cast("long").alias("least_containers"),
        total.alias("tokens"),
        F.round(total / (F.count(F.lit(1)) * capacity), 6).alias("mean_fill"),
    )
