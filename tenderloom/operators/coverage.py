"""Data-quality audit over releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom import fixed
from tenderloom.functions import nested


def field_presence(releases: DataFrame, keep: list[str]) -> DataFrame:
    return releases.select(*keep, *nested.presence())


def coverage(presence: DataFrame, by: str = "source_year") -> DataFrame:
    """Long table: year x field with count, total and percentage."""
    counts = presence.groupBy(by).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(f"`{f}`")).alias(f) for f in fixed.AUDITED_FIELDS],
    )
    long = counts.unpivot(
        [by, "total"], [f"`{f}`" for f in fixed.AUDITED_FIELDS], "field", "filled"
    )
    return long.withColumn("pct", F.round(F.try_divide(100.0 * F.col("filled"), F.col("total")), 2))


def coverage_grid(cover: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Field x year percentages."""
    return cover.groupBy("field").pivot(by, values).agg(F.first("pct"))


def ratio_by(df: DataFrame, key: str, flag: str) -> DataFrame:
    """With flag / total / percentage per key."""
    label = F.coalesce(F.when(F.trim(key) != "", F.col(key)), F.lit(fixed.NO_DATA))
    return (
        df.groupBy(label.alias(key))
        .agg(F.count_if(F.col(flag)).alias("with_flag"), F.count("*").alias("total"))
        .withColumn("pct", F.round(100.0 * F.col("with_flag") / F.col("total"), 2))
    )


def matrix_inventory(matrix: DataFrame, category: str, n_numeric: int) -> DataFrame:
    """Row count, category count, encoded width and what a pairwise matrix would take."""
    n, width = F.col("rows"), F.col("categories") + n_numeric
    gb = float(1024**3)
    return matrix.agg(
        F.count("*").alias("rows"), F.countDistinct(category).alias("categories")
    ).select(
        "rows",
        "categories",
        width.alias("encoded_columns"),
        (n * n).alias("cells"),
        F.round(n * n * 8 / gb, 3).alias("float64_gb"),
        F.round(n * n * 4 / gb, 3).alias("float32_gb"),
        F.round(n * (n - 1) / 2 * 8 / gb, 3).alias("condensed_gb"),
    )
