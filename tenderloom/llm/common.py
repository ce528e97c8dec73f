"""What several of the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

#: Words are runs of everything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that no column of df has, whatever their case."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem = f"{stem}_{uuid.uuid4().hex[:6]}"
    return stem


#: Rows of a few numbers that may go to every task.
FEW = 500_000


def broadcast_if_few(df: DataFrame) -> DataFrame:
    """df, to be sent to every task if its counted rows are at most FEW; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= FEW else df


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
