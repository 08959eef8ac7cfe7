"""Product category label: English translation, else the raw key, else a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN_CATEGORY = "Unknown"


def category_label(fallback: str | None = UNKNOWN_CATEGORY) -> Column:
    parts = [F.col("product_category_name_english"), F.col("product_category_name")]
    if fallback is not None:
        parts.append(F.lit(fallback))
    return F.coalesce(*parts)


def product_categories(products: DataFrame, translation: DataFrame,
                       fallback: str | None = UNKNOWN_CATEGORY) -> DataFrame:
    """(product_id, category) for every product. The translation table has one row per
    category key (bounded by the category vocabulary), so the left join is a map lookup."""
    labelled = products.select("product_id", "product_category_name").join(
        translation.select("product_category_name", "product_category_name_english"),
        on="product_category_name", how="left",
    )
    return labelled.select("product_id", category_label(fallback).alias("category"))
