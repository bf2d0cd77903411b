"""Queries of this package; SQL only where an operator can be said in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import language, mixing, names, overlap, packing, privacy, truncation
from tallyloom.runtime import table


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    return names.variants(table(spark, d, "ledger"), table(spark, d, "persons"), table(spark, d, "nicknames"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_links(spark, d).where("person_id IS NOT NULL").select("spelling", "person_id")


def _splits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    train = table(spark, d, "parse_write").where("split = 'train'")
    return table(spark, d, "heldout_cases").select("id", "input"), train.select("id", "input")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.find_overlaps(*_splits(spark, d)).select(F.col("held_id").alias("heldout_id"), "train_id")


def p7_exact(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that are equal after normalising case, marks and white space."""
    return overlap.find_overlaps(*_splits(spark, d)).where("exact").select(F.col("held_id").alias("heldout_id"), "train_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(*_splits(spark, d), table(spark, d, "heldout_cases"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    texts = language.project_texts(table(spark, d, "notes"), table(spark, d, "parse_write"))
    labels = table(spark, d, "lang_labels")
    keys = ["src_table", "row_id"]
    marked = labels.select(*keys, language.named(F.col("lang_label")).alias("lang"))
    few = language.sample_rows(marked, "lang", keys, 2000)  # at most 2,000 rows a language
    documents = table(spark, d, "documents").select("doc_id", "text", "lang")
    model = language.fit(language.sample_rows(documents, "lang", ["doc_id"], 2000), texts.join(F.broadcast(few), keys))
    return language.judge(texts, labels, model)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(_judged(spark, d))


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    """Each text, and each part of a mixed one, with its language and confidence."""
    rows = _judged(spark, d).select("src_table", "row_id", "state", F.posexplode_outer("segments").alias("at", "s"))
    return rows.select("src_table", "row_id", "state", (F.col("at") + 1).alias("seg_no"), F.col("s.lang").alias("lang"), F.col("s.confidence").alias("confidence"))


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    texts = privacy.project_texts(table(spark, d, "notes"), table(spark, d, "activity_log"))
    return texts, privacy.find_items(texts, table(spark, d, "persons"), table(spark, d, "nicknames"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d)[1].select("src_table", "row_id", "kind", F.col("start_pos").cast("long").alias("start_pos"))


def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    """All texts with placeholders."""
    return privacy.sanitise(*_items(spark, d))


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(truncation.project_texts(table(spark, d, "documents")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d).where("cut").select(F.col("id").alias("doc_id"))


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.report(_truncated(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p8_containers(spark, d))


def _mixed(spark: SparkSession, d: str, **size) -> tuple[DataFrame, DataFrame]:
    return mixing.draw(table(spark, d, "documents"), table(spark, d, "mix_targets"), **size)


def p9_mixes(spark: SparkSession, d: str) -> DataFrame:
    """Mixes as large as their sources together: small sources are clamped at their repeats and the rest is dealt to the others."""
    return _mixed(spark, d, times=1.0)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d, times=1.0)[1]


def p9_exact_mixes(spark: SparkSession, d: str) -> DataFrame:
    """The largest mixes in which every source with documents still makes up its whole share."""
    return _mixed(spark, d)[0]


def p9_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


QUERIES = {"p4_found": p4_found, "p4_texts": p4_texts, "p5_found": p5_found, "p5_labels": p5_labels, "p6_found": p6_found, "p6_links": p6_links, "p7_found": p7_found, "p7_exact": p7_exact, "p7_report": p7_report, "p8_containers": p8_containers, "p8_report": p8_report, "p9_mixes": p9_mixes, "p9_shares": p9_shares, "p9_exact_mixes": p9_exact_mixes, "p9_exact_shares": p9_exact_shares, "p10_found": p10_found, "p10_report": p10_report}

_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(input), '[^\p{L}\p{M}\p{N}.,:]+', ' ', 'g'), '[.,:]*( |$)[.,:]*', ' ', 'g'), ' +[.,:]* *', ' ', 'g'))"

SQL: dict[str, str] = {
    "p7_exact": f"""WITH h AS (SELECT DISTINCT id, {_NORM} AS norm FROM heldout_cases WHERE input IS NOT NULL), t AS (SELECT DISTINCT id, {_NORM} AS norm FROM parse_write WHERE split = 'train' AND input IS NOT NULL)
    SELECT h.id AS heldout_id, t.id AS train_id FROM h JOIN t ON h.norm = t.norm WHERE h.norm <> ''""",
}
