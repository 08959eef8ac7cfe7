"""Helpers shared by the corpus operators: word rules, written tables, Arrow schemas."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import scratch_path

#: ASCII white space as a Java regular expression class; words are what lies between.
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reopened: lineage ends there, so a lost
    executor costs a re-read, and the planner knows the table's size. Compressed well: some hold texts."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The ``[^\\x20\\x09-\\x0D]+`` words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(text, UPPER, LOWER)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema of a simple DDL column list."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def free_names(kept: list[str], taken: Iterable[str]) -> list[str]:
    """Names for a caller's columns beside an operator's own: those that clash (in any case) get underscores at their end until they don't."""
    used, out = {t.lower() for t in taken}, []
    for name in kept:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
