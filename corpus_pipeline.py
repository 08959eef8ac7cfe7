"""Corpus pipeline: quality rules, near-dedup, decontamination, secret redaction, source mixing.

Each stage is (spark, docs, sf_dir) -> DataFrame and calls one operator of ``ledgerline.llm``; all but the last
return the columns of ``docs``. ``run`` writes each stage's result to the shared folder and rereads it as the
next one's input, so every stage starts from files.

Nulls and odd rows behave as the operators state: documents without words fail the quality rule; null ids and
null sources are kept like any other; of a near-duplicate group the row with the smallest non-null doc_id
stays (of equal ones the first written); repeated rows are near-duplicates of each other, so one stays; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import cube_mix, decontaminate, quality, secret_scan, simhash
from ledgerline.llm.common import table, written


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each row packed into one column, next to the ones that operators read: no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows = whole_rows(docs).select("row", F.col("row.text").alias("text"), F.col("row.lang").alias("lang"))
    return unpacked(quality.quality_report(rows, ["row"]).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (3-word shingles, 2 bits)."""
    rows = written(whole_rows(docs).withColumn("rid", F.monotonically_increasing_id()), "dedup-input")
    groups = simhash.near_duplicates(rows.select("rid", F.col("row.text").alias("text")), "rid")
    named = written(rows.select("rid", F.col("row.doc_id").alias("id")).join(
        groups.select(F.col("doc_id").alias("rid"), "component_id"), "rid"), "dedup-groups")
    first = F.min(F.struct(F.col("id").isNull(), "id", "rid"))
    kept = written(named.groupBy("component_id").agg(first.alias("least")).select(F.col("least.rid").alias("rid")), "dedup-kept")
    # the rows that go are fewer than those that stay: texts move only if even they are too many to broadcast
    dropped = written(named.select("rid").join(kept, "rid", "left_anti"), "dedup-dropped")
    return unpacked(rows.join(dropped, "rid", "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    rows = whole_rows(docs).select("row", F.col("row.text").alias("text"))
    marked = decontaminate.mark_contamination(rows, table(spark, sf_dir, "benchmark"))
    return unpacked(marked.filter(F.size("leaks.spans") == 0))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, accepted secrets masked; ``n_chars`` follows the text."""
    forest = secret_scan.train_forest(secret_scan.labelled_findings(spark))
    clean = secret_scan.redact(docs, forest)
    if "n_chars" not in docs.columns:
        return clean
    size = F.when(F.contains("text", F.lit(secret_scan.MASK)), F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.withColumn("n_chars", F.coalesce(size, F.col("n_chars")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each remaining document is taken, by the registered weights."""
    return cube_mix.mix_sources(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("source_mix", source_mix),
]

#: SQL has no XXH64 and no Cube method: near_dedup and decontamination are tested against brute force, the run against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
