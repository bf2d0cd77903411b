"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.tokens import VOCABULARY, with_tokens
from tallyloom.runtime import cut, once


def exact_total(wanted: dict[str, float], caps: dict[str, float]) -> float:
    """The largest total at which every source that has anything still makes up its share of it."""
    weights = {s: w for s, w in wanted.items() if w > 0 and caps.get(s, 0) > 0}
    whole = sum(weights.values())
    return min((caps[s] * whole / w for s, w in weights.items()), default=0.0)


def water_fill(wanted: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Tokens of each source: shares of ``total``, sources over their cap clamped to it and the excess dealt to the others in
    proportion to their wanted shares, until nobody is over. Sources without documents have cap 0. If all are clamped the
    sum stays below ``total``."""
    budget = {s: 0.0 for s in wanted}
    open_ = {s for s, w in wanted.items() if w > 0}
    left = min(total, sum(max(0.0, caps.get(s, 0.0)) for s in open_))
    while open_ and left > 0:
        whole = sum(wanted[s] for s in open_)
        over = {s for s in open_ if left * wanted[s] / whole >= caps.get(s, 0.0)}
        if not over:
            for s in open_:
                budget[s] = left * wanted[s] / whole
            return budget
        for s in over:
            budget[s] = max(0.0, caps.get(s, 0.0))
        left -= sum(budget[s] for s in over)
        open_ -= over
    return budget


def plan_mixes(sized: DataFrame, targets: DataFrame, total_tokens: float | None, times: float | None = None) -> DataFrame:
    """Per mix and source: target_share, max_repeats, available, budget and the epochs it takes.

    Only sums per source come to the driver: one row for each row of ``targets``, a small table of wanted shares.
    """
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    wanted = once(targets.where("mix_name IS NOT NULL AND source IS NOT NULL").select("mix_name", "source", "target_share", "max_repeats"), "mix_name", "source")
    rows = wanted.join(have, "source", "left").orderBy("mix_name", "source").collect()
    out = []
    for mix in sorted({r["mix_name"] for r in rows}):
        own = [r for r in rows if r["mix_name"] == mix]
        shares = {r["source"]: max(0.0, r["target_share"] or 0.0) for r in own}
        caps = {r["source"]: float((r["available"] or 0) * max(0, r["max_repeats"] or 0)) for r in own}
        total = total_tokens if total_tokens is not None else times * sum(r["available"] or 0 for r in own) if times is not None else exact_total(shares, caps)
        budget = water_fill(shares, caps, total)
        whole = sum(shares.values()) or 1.0
        for r in own:
            available = int(r["available"] or 0)
            epochs = budget[r["source"]] / available if available else 0.0
            out.append((mix, r["source"], shares[r["source"]] / whole, int(r["max_repeats"] or 0), available, budget[r["source"]], min(epochs, float(r["max_repeats"] or 0))))
    return sized.sparkSession.createDataFrame(
        out, "mix_name string, source string, target_share double, max_repeats long, available long, budget double, epochs double"
    )


def draw(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, times: float | None = None, seed: int = 1, vocabulary: str = VOCABULARY, buckets: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Chosen documents with repeats, and the shares reached.

    ``documents``: doc_id, text, source; ``targets``: mix_name, source, target_share, max_repeats. Without a size a mix
    is as large as it can be with every source at its target share (:func:`exact_total`). With ``total_tokens``, or ``times``
    the tokens of its sources, sources that can't give
    their share even at ``max_repeats`` give all they may and the rest is dealt to the others (:func:`water_fill`); so is
    the share of a source without documents.

    A source that takes ``e`` epochs gives each document ``floor(e)`` times, and once more those first in a seeded order
    until the fraction is met, to within one document. The order is cut by sums per hash bucket, so only the documents of
    the one bucket on the border are ever sorted.

    First result: mix_name, source, doc_id, tokens, repeats (over 0). Second: mix_name, source, target_share, max_repeats,
    available_tokens, n_documents, drawn_tokens, epochs, actual_share. Documents of null source, null or empty text aren't
    drawn; repeated rows count once; mixes whose sources are all empty give shares of null.
    """
    rows = with_tokens(documents.where("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL").select("doc_id", "source", "text"), vocabulary=vocabulary)
    sized = cut(once(rows.select("doc_id", "source", "tokens"), "doc_id").where("tokens > 0"))
    plan = cut(plan_mixes(sized, targets, total_tokens, times))
    # One row per mix and source of a small table.
    offered = sized.join(F.broadcast(plan.where("budget > 0").select("mix_name", "source", "available", "epochs")), "source")
    spot = F.pmod(F.xxhash64(F.lit(seed), "mix_name", "doc_id"), F.lit(1 << 40))
    placed = offered.withColumn("spot", spot).withColumn("bucket", F.floor(F.col("spot") / ((1 << 40) // buckets)))
    want = (F.col("epochs") - F.floor("epochs")) * F.col("available")
    per = placed.groupBy("mix_name", "source", "bucket").agg(F.sum("tokens").alias("own"), F.first(want).alias("want"))
    upto = Window.partitionBy("mix_name", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("own").over(upto), F.lit(0)))
    border = per.where((F.col("before") < F.col("want")) & (F.col("before") + F.col("own") >= F.col("want"))).select(
        "mix_name", "source", F.col("bucket").alias("border"), "before", "want"
    )
    # At most one border per mix and source.
    marked = placed.join(F.broadcast(border), ["mix_name", "source"], "left")
    inside = Window.partitionBy("mix_name", "source").orderBy("spot", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    on = marked.where(F.col("bucket") == F.col("border")).withColumn("sum", F.col("before") + F.sum("tokens").over(inside))
    # The document that crosses the border comes along if that is nearer to the wanted sum.
    on = on.withColumn("extra", (F.col("sum") - F.col("tokens") / 2 <= F.col("want")).cast("int"))
    off = marked.where(~F.coalesce(F.col("bucket") == F.col("border"), F.lit(False))).withColumn("extra", F.coalesce(F.col("bucket") < F.col("border"), F.lit(False)).cast("int"))
    keep = ["mix_name", "source", "doc_id", "tokens", "epochs", "extra"]
    both = off.select(*keep).unionByName(on.select(*keep))
    chosen = both.withColumn("repeats", (F.floor("epochs") + F.col("extra")).cast("long")).where("repeats > 0").select("mix_name", "source", "doc_id", "tokens", "repeats")
    drawn = chosen.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"))
    every = plan.join(drawn, ["mix_name", "source"], "left").withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0)))
    whole = F.sum("drawn_tokens").over(Window.partitionBy("mix_name"))
    shares = every.select(
        "mix_name",
        "source",
        F.round("target_share", 6).alias("target_share"),
        "max_repeats",
        F.col("available").alias("available_tokens"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        "drawn_tokens",
        F.round("epochs", 6).alias("epochs"),
        F.round(F.col("drawn_tokens") / F.nullif(whole, F.lit(0)), 6).alias("actual_share"),
    )
    return chosen, shares
