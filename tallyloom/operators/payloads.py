"""Nested payloads: validation, coercion and rows out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = ("expense", "buy", "todo", "weight", "ledger")
DISPOSITIONS = ("accept", "confirm", "reject")
DAY = r"^\d{4}-\d{2}-\d{2}$"


def first_error(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that fails; null if all hold. A check that can't be told fails."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


#: Fields that the records of a lane must have.
NEEDED = {"expense": ("description", "amount"), "buy": ("item_text",), "todo": ("text",), "weight": ("person_text", "value"), "ledger": ("person_text", "action")}


def _all_have(records: Column, fields: tuple[str, ...]) -> Column:
    return F.forall(records, lambda r: F.forall(F.array(*[r[f].isNotNull() for f in fields]), lambda x: x))


def validate(p: Column, strict: bool = True) -> Column:
    """What is wrong with a write payload, null if nothing is. The lenient form only asks for a lane and records."""
    lane = p["lane"]
    fields = F.lit(True)
    for name, needed in NEEDED.items():
        fields = F.when(lane == name, _all_have(p["records"], needed)).otherwise(fields)
    known = ("lane", lane.isin(*LANES))
    some = ("no records", F.size(p["records"]) > 0)
    if not strict:
        return first_error([known, some])
    return first_error(
        [
            ("task", p["task"] == "parse_write"),
            known,
            ("disposition", p["disposition"].isin(*DISPOSITIONS)),
            ("reason without need", (p["disposition"] != "accept") | p["reason_code"].isNull()),
            ("no reason", (p["disposition"] == "accept") | p["reason_code"].isNotNull()),
            some,
            ("fields", fields),
            ("date", F.forall(p["records"], lambda r: r["date"].isNull() | F.regexp_like(r["date"], F.lit(DAY)) & F.try_to_date(r["date"], "yyyy-MM-dd").isNotNull())),
            ("amount", F.forall(p["records"], lambda r: r["amount"].isNull() | (r["amount"] > 0))),
            ("value", F.forall(p["records"], lambda r: r["value"].isNull() | (r["value"] > 0) & (r["value"] < 700))),
        ]
    )


def lane_rows(writes: DataFrame, lane: str) -> DataFrame:
    """One row per record of a lane."""
    return writes.where(F.col("output.lane") == lane).select("id", F.posexplode("output.records").alias("pos", "r"))


def coerce_query(domain: Column, intent: Column, text: Column) -> Column:
    """A question's parts as far as they can be told: intents given for a domain, usual intents, wanted text."""
    known = ("expense", "buy", "todo", "weight", "ledger", "note")
    d = F.when(domain.isin(*known), domain).when(intent.isin(*known), intent).otherwise(F.lit("note"))
    usual = F.when(d == "expense", "total").when(d == "weight", "latest").when(d == "ledger", "balance").when(d == "note", "search").otherwise("list")
    i = F.when(intent.isNull() | intent.isin(*known), usual).otherwise(intent)
    return F.struct(d.alias("domain"), i.alias("intent"), F.nullif(F.trim(text), F.lit("")).alias("query_text"))


def flat_rows(df: DataFrame, json: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Key and value of each entry of a JSON object in text; underscores in keys are spaces; broken JSON gives no rows."""
    m = F.from_json(F.col(json), "map<string,string>")
    kept = F.map_filter(m, lambda k, v: ~k.isin(*drop)) if drop else m
    return df.select("id", F.explode(kept).alias("key", "value")).withColumn("key", F.replace("key", F.lit("_"), F.lit(" ")))


def json_object(col: str) -> Column:
    """The object in a chatty answer, null without one: thoughts in tags and code fences apart, the text from the first '{' to the last
    '}'; a list of records that lacks its opening bracket gets it."""
    c = F.regexp_replace(F.regexp_replace(F.col(col), r"(?s)<think>.*?</think>", " "), r"```[a-z]*", " ")
    out = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    lacks = F.regexp_like(out, F.lit(r'"records"\s*:\s*\{')) & F.regexp_like(out, F.lit(r"\}\s*\]"))
    out = F.when(lacks, F.regexp_replace(out, r'"records"\s*:\s*\{', '"records":[{')).otherwise(out)
    return F.nullif(out, F.lit(""))
