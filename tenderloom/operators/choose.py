"""Latest rows, modes, histograms and other per-key choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom import fixed


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str = "_rank") -> DataFrame:
    """First n rows of each key.

    Spark keeps n rows per key before the shuffle as well, so a hot key does
    not travel whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
    return ranked if rank != "_rank" else ranked.drop(rank)


def keep_latest_date(releases: DataFrame) -> DataFrame:
    """One release per process: latest date text wins, the earlier read wins a tie.

    A process is known by its ocid, else by its release id; lines with neither are skipped.
    """
    filled = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    names = [filled(c) for c in ("ocid", "id") if c in releases.columns]
    known = releases.withColumn("_process", F.coalesce(*names)).filter(F.col("_process").isNotNull())
    order = [F.coalesce("date", F.lit("")).desc(), F.col("source_year"), F.col("position")]
    return first_by(known, ["_process"], order).drop("_process")


def keep_last_read(releases: DataFrame) -> DataFrame:
    """One release per id: the last one read; null ids collapse to one."""
    return first_by(releases, ["ocid"], [F.col("source_year").desc(), F.col("position").desc()])


def mode(df: DataFrame, keys: list[str], value: str, name: str, weight: str | None = None) -> DataFrame:
    """Most frequent non-null value per key; ties go to the smallest value."""
    total = F.sum(weight) if weight else F.count("*")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(total.alias("_n"))
    best = F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.alias(name), F.max("_n").alias(f"{name}_n"))


def histogram(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Counts per key and value; null and blank values under one label."""
    label = F.coalesce(F.when(F.trim(value) != "", F.col(value)), F.lit(fixed.NO_DATA))
    total = F.sum(weight) if weight else F.count("*")
    return df.groupBy(*keys, label.alias(value)).agg(total.cast("long").alias("n"))


def top_values(df: DataFrame, value: str, n: int, keys: list[str] | None = None) -> DataFrame:
    counts = histogram(df, keys or [], value)
    order = [F.col("n").desc(), F.col(value)]
    if keys:
        return first_by(counts, keys, order, n, "rank")
    return counts.orderBy(*order).limit(n)


def first_distinct(df: DataFrame, value: str, order: Column, n: int = 10) -> DataFrame:
    """First n distinct values in encounter order."""
    return (
        df.filter(F.trim(value) != "")
        .groupBy(value)
        .agg(F.min(order).alias("first_seen"))
        .orderBy("first_seen")
        .limit(n)
    )


def smallest(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """The single smallest record."""
    return df.orderBy(*order).limit(1).select(*columns)
