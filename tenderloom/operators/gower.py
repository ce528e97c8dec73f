"""Mixed-type distances without a pairwise matrix.

The weighted distance is a sum of one-dimensional absolute differences plus a
category mismatch, so the sum of distances from a row to a whole group follows from
running counts and sums of each variable. Columns are first put on one scale
(``u_<variable>``): the distance is then the plain sum of |differences| of the u
columns plus ``PENALTY`` when categories differ.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom import fixed
from tenderloom.operators.running import running_sums, value_ranges
from tenderloom.session import cut_lineage

AXES = [f"u_{v}" for v in fixed.NUMERIC]
PENALTY = fixed.CATEGORY_WEIGHT / (len(fixed.NUMERIC) + fixed.CATEGORY_WEIGHT)
GROUPS_PER_PASS = 48


def distance(a: dict[str, Column], b: dict[str, Column], axes: list[str], category: str, mismatch: float) -> Column:
    total = F.when(a[category] == b[category], 0.0).otherwise(mismatch)
    for axis in axes:
        total = total + F.abs(a[axis] - b[axis])
    return total


def _spread_sums(value, run_n, run_s, all_n, all_s) -> Column:
    """Sum of |value - x| over a group, from its running count and sum."""
    return value * run_n - run_s + (all_s - run_s) - value * (all_n - run_n)


def group_sums(
    df: DataFrame,
    by: list[str],
    row_id: str,
    label: str,
    labels: list,
    axes: list[str] = AXES,
    category: str = fixed.CATEGORY,
    mismatch: float = PENALTY,
) -> DataFrame:
    """(by, row_id, label, sums): distance of every row to every listed group.

    ``sums[i]`` is the total distance to the rows labelled ``labels[i]``. Cost is one
    sort per variable whatever the group sizes; nothing pairwise is built.
    """
    k = len(labels)
    keys = [*by, "variable"]
    member = [F.col(label) == F.lit(c) for c in labels]
    long = df.select(*by, row_id, label, *axes).unpivot(
        [*by, row_id, label], axes, "variable", "value"
    )
    points = long.groupBy(*keys, "value").agg(
        *[F.count_if(m).alias(f"n{i}") for i, m in enumerate(member)],
    )
    points = points.select("*", *[(F.col(f"n{i}") * F.col("value")).alias(f"s{i}") for i in range(k)])
    measures = [*[f"n{i}" for i in range(k)], *[f"s{i}" for i in range(k)]]
    run = running_sums(points, keys, "value", measures)
    values = run.select(
        *keys,
        "value",
        *[
            _spread_sums(
                F.col("value"), F.col(f"run_n{i}"), F.col(f"run_s{i}"), F.col(f"all_n{i}"), F.col(f"all_s{i}")
            ).alias(f"d{i}")
            for i in range(k)
        ],
    )
    # Each value is one row on the right, so a value shared by a third of the rows is
    # broadcast when the table is small and otherwise split by the adaptive skew join.
    numeric = long.join(values, [*keys, "value"]).select(
        *by, row_id, label, *[f"d{i}" for i in range(k)]
    )
    # The category term: group size minus the group's rows of the same category.
    sizes = df.groupBy(*by).agg(*[F.count_if(m).alias(f"a{i}") for i, m in enumerate(member)])
    cells = df.groupBy(*by, category).agg(*[F.count_if(m).alias(f"c{i}") for i, m in enumerate(member)])
    if by:
        cells = cells.join(F.broadcast(sizes), by)
    else:
        cells = cells.withColumn("_a", sizes.agg(F.first(F.struct("*"))).scalar()).select("*", "_a.*")
    # Modality names are a short normalised catalogue, so this table is a few rows.
    mismatches = cells.select(
        *by,
        category,
        *[((F.col(f"a{i}") - F.col(f"c{i}")) * F.lit(mismatch)).alias(f"d{i}") for i in range(k)],
    )
    nominal = df.select(*by, row_id, label, category).join(F.broadcast(mismatches), [*by, category])
    nominal = nominal.select(*by, row_id, label, *[f"d{i}" for i in range(k)])
    return (
        numeric.unionByName(nominal)
        .groupBy(*by, row_id, label)
        .agg(*[F.sum(f"d{i}").alias(f"d{i}") for i in range(k)])
        .select(*by, row_id, label, F.array(*[f"d{i}" for i in range(k)]).alias("sums"))
    )


def between_groups(
    df: DataFrame,
    label: str,
    k: int,
    axes: list[str] = AXES,
    category: str = fixed.CATEGORY,
    mismatch: float = PENALTY,
) -> DataFrame:
    """(a, b, total): summed distance between every two groups 0..k-1.

    Needs no row-level result, so rows collapse to (variable, value, group) counts; each
    value range is one small matrix product, with the counts below it handed in.
    """
    long = df.select(label, *axes).unpivot([label], axes, "variable", "value")
    points = long.groupBy("variable", "value", label).agg(F.count("*").alias("n"))
    ranged = value_ranges(points.withColumnRenamed(label, "g"), "value")
    sums = ranged.groupBy("variable", "_range", "g").agg(
        F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("value")).alias("s")
    )
    # variables x ranges x groups rows: the running part is a window over this summary.
    ranges = sums.select("variable", "_range").distinct()
    grid = ranges.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    filled = grid.join(sums, ["variable", "_range", "g"], "left").fillna(0.0, ["n", "s"])
    below = Window.partitionBy("variable", "g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("variable", "g")
    offsets = filled.select(
        F.col("variable").alias("o_variable"), F.col("_range").alias("o_range"), "g",
        *[F.coalesce(F.sum(c).over(below), F.lit(0.0)).alias(f"below_{c}") for c in ("n", "s")],
        *[F.sum(c).over(whole).alias(f"all_{c}") for c in ("n", "s")],
    )

    def block(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        before = before.sort_values("g")
        run_n, run_s, all_n, all_s = (
            before[c].to_numpy() for c in ("below_n", "below_s", "all_n", "all_s")
        )
        out = np.zeros((k, k))
        rows = rows.sort_values("value")
        values, at = np.unique(rows["value"].to_numpy(), return_inverse=True)
        groups, counts = rows["g"].to_numpy(), rows["n"].to_numpy()
        for start in range(0, len(values), 20_000):
            v = values[start : start + 20_000]
            mine = (at >= start) & (at < start + len(v))
            m = np.zeros((len(v), k))
            m[at[mine] - start, groups[mine]] = counts[mine]
            n = run_n + np.cumsum(m, axis=0)
            s = run_s + np.cumsum(m * v[:, None], axis=0)
            out += m.T @ (v[:, None] * (2 * n - all_n) - 2 * s + all_s)
            run_n, run_s = n[-1], s[-1]
        a, b = np.indices((k, k))
        return pd.DataFrame({"a": a.ravel(), "b": b.ravel(), "total": out.ravel()})

    numeric = (
        ranged.groupBy("variable", "_range")
        .cogroup(offsets.groupBy("o_variable", "o_range"))
        .applyInPandas(block, "a long, b long, total double")
    )
    # One row per group and category.
    cells = df.groupBy(label, category).agg(F.count("*").alias("n"))
    same = cells.select(F.col(label).alias("a"), category, F.col("n").alias("na")).join(
        cells.select(F.col(label).alias("b"), category, F.col("n").alias("nb")), category
    ).groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("same"))
    sizes = cells.groupBy(label).agg(F.sum("n").alias("n"))
    totals = numeric.groupBy("a", "b").agg(F.sum("total").alias("total"))
    return (
        totals.join(sizes.select(F.col(label).alias("a"), F.col("n").alias("size_a")), "a")
        .join(sizes.select(F.col(label).alias("b"), F.col("n").alias("size_b")), "b")
        .join(same, ["a", "b"], "left")
        .select(
            "a", "b", "size_a", "size_b",
            (
                F.col("total")
                + F.lit(mismatch) * (F.col("size_a") * F.col("size_b") - F.coalesce("same", F.lit(0)))
            ).alias("total"),
        )
    )


def own_sums(
    df: DataFrame,
    by: list[str],
    row_id: str,
    label: str | None = None,
    axes: list[str] = AXES,
    category: str = fixed.CATEGORY,
    mismatch: float = PENALTY,
) -> DataFrame:
    """(by, row_id, [label], own): distance of every row to all rows of its own group."""
    group = [*by, label] if label else list(by)
    keys = [*group, "variable"]
    long = df.select(*group, row_id, *axes).unpivot([*group, row_id], axes, "variable", "value")
    points = long.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    points = points.withColumn("s", F.col("n") * F.col("value"))
    run = running_sums(points, keys, "value", ["n", "s"])
    values = run.select(
        *keys,
        "value",
        _spread_sums(F.col("value"), F.col("run_n"), F.col("run_s"), F.col("all_n"), F.col("all_s")).alias("own"),
    )
    # One row per value on the right: broadcast when small, else the adaptive skew join.
    numeric = long.join(values, [*keys, "value"]).select(*group, row_id, "own")
    cells = df.groupBy(*group, category).agg(F.count("*").alias("c"))
    sizes = cells.groupBy(*group).agg(F.sum("c").alias("a")) if group else None
    if group:
        cells = cells.join(sizes, group)
    else:
        cells = cells.withColumn("a", cells.agg(F.sum("c")).scalar())
    mismatches = cells.select(*group, category, ((F.col("a") - F.col("c")) * F.lit(mismatch)).alias("own"))
    nominal = df.select(*group, row_id, category).join(mismatches, [*group, category])
    return (
        numeric.unionByName(nominal.select(*group, row_id, "own"))
        .groupBy(*group, row_id)
        .agg(F.sum("own").alias("own"))
    )


def nearest_reference(
    df: DataFrame,
    references: list[dict],
    axes: list[str] = AXES,
    category: str = fixed.CATEGORY,
    mismatch: float = PENALTY,
    label: str = "cluster",
) -> DataFrame:
    """Label of the closest reference and its distance; the first reference wins ties.

    ``references`` are the k medoids of a model (label, axes, category): k short rows.
    Row-local, no shuffle.
    """
    here = {c: F.col(c) for c in [*axes, category]}
    options = []
    for position, r in enumerate(references):
        there = {c: F.lit(r[c]) for c in [*axes, category]}
        options.append(
            F.struct(
                distance(here, there, axes, category, mismatch).alias("d"),
                F.lit(position).alias("position"),
                F.lit(r[label]).cast("long").alias("label"),
            )
        )
    best = F.array_min(F.array(*options))
    return df.withColumn("_best", best).select(
        *df.columns, F.col("_best.label").alias(label), F.col("_best.d").alias("distance")
    )


def silhouette_rows(
    df: DataFrame,
    by: list[str],
    row_id: str,
    label: str,
    labels: list,
    axes: list[str] = AXES,
    category: str = fixed.CATEGORY,
    mismatch: float = PENALTY,
) -> DataFrame:
    """(by, row_id, label, a, b, silhouette) for rows in a real group (noise is -1)."""
    real = df.filter(F.col(label).isin(*labels))
    sizes = real.groupBy(*by, label).agg(F.count("*").alias("size"))
    # One row per group.
    others = F.broadcast(sizes.withColumnRenamed(label, "other").withColumnRenamed("size", "other_size"))
    own = F.col("other") == F.col(label)
    parts = []
    for start in range(0, len(labels), GROUPS_PER_PASS):
        chunk = labels[start : start + GROUPS_PER_PASS]
        sums = group_sums(real, by, row_id, label, chunk, axes, category, mismatch)
        pairs = sums.select(
            *by, row_id, label,
            F.explode(F.arrays_zip(F.array(*map(F.lit, chunk)).alias("g"), F.col("sums").alias("s"))).alias("e"),
        ).select(*by, row_id, label, F.col("e.g").alias("other"), F.col("e.s").alias("sum")).join(others, [*by, "other"])
        found = pairs.groupBy(*by, row_id, label).agg(
            F.max(F.when(own, F.col("sum"))).alias("own"),
            F.max(F.when(own, F.col("other_size"))).alias("size"),
            F.min(F.when(~own, F.col("sum") / F.col("other_size"))).alias("b"),
        )
        # Of several passes each is a written table, so that the driver plans and runs one at a time.
        parts.append(cut_lineage(found) if len(labels) > GROUPS_PER_PASS else found)
    per_row = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        per_row = per_row.groupBy(*by, row_id, label).agg(*[f(c).alias(c) for c, f in (("own", F.max), ("size", F.max), ("b", F.min))])
    a = F.col("own") / (F.col("size") - 1)
    score = F.when(F.col("size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - a, F.greatest(a, F.col("b"))), F.lit(0.0))
    )
    return per_row.select(
        *by, row_id, label,
        F.when(F.col("size") > 1, a).alias("a"), "b",
        F.when(F.col("b").isNotNull(), score).alias("silhouette"),
    )


def silhouette(
    df: DataFrame,
    by: list[str],
    row_id: str,
    label: str,
    labels: list,
    axes: list[str] = AXES,
    category: str = fixed.CATEGORY,
    mismatch: float = PENALTY,
) -> DataFrame:
    """(by, groups, noise_pct, silhouette): null below two groups or above 50 % noise."""
    noise = df.groupBy(*by).agg(
        (100.0 * F.avg((~F.col(label).isin(*labels)).cast("double"))).alias("noise_pct"),
        F.countDistinct(F.when(F.col(label).isin(*labels), F.col(label))).alias("groups"),
    )
    rows = silhouette_rows(df, by, row_id, label, labels, axes, category, mismatch)
    means = rows.groupBy(*by).agg(F.avg("silhouette").alias("silhouette"))
    joined = noise.join(means, by, "left") if by else noise.withColumn("silhouette", means.scalar())
    usable = (F.col("groups") >= 2) & (F.col("noise_pct") <= fixed.MAX_NOISE_PCT)
    return joined.select(
        *by, "groups", "noise_pct", F.when(usable, F.col("silhouette")).alias("silhouette")
    )


def dispersion_within(df: DataFrame, by: list[str], row_id: str, label: str, **kwargs) -> DataFrame:
    """(by, dispersion): sum over groups of their pairwise distances over twice their size."""
    real = df.filter(F.col(label) != -1)
    own = own_sums(real, by, row_id, label, **kwargs)
    groups = own.groupBy(*by, label).agg((F.sum("own") / (2 * F.count("*"))).alias("w"))
    return groups.groupBy(*by).agg(F.sum("w").alias("dispersion"))


def labels_of(df: DataFrame, label: str) -> list:
    """The real group labels of a partition, sorted (one entry per group)."""
    rows = df.select(label).filter(F.col(label) != -1).distinct().collect()
    return sorted(r[0] for r in rows)
