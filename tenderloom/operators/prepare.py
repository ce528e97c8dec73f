"""Clipping, scaling, encoding and diagnostics of the model variables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom import fixed
from tenderloom.functions.scoring import clip
from tenderloom.operators.running import percentiles


def long_form(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    return df.unpivot(keys, variables, "variable", "value")


def clip_limits(df: DataFrame, by: list[str], variables: list[str] = fixed.NUMERIC) -> DataFrame:
    """(by, variable, low, high): exact 1st and 99th percentiles."""
    low, high = fixed.WINSOR
    return percentiles(
        long_form(df, by, variables), [*by, "variable"], "value", {"low": low, "high": high}
    )


def clip_counts(df: DataFrame, limits: DataFrame, by: list[str], variables: list[str] = fixed.NUMERIC) -> DataFrame:
    """Rows strictly outside the limits."""
    # One row per supplier of the portfolio and variable.
    joined = long_form(df, by, variables).join(F.broadcast(limits), [*by, "variable"])
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    return joined.groupBy(*by, "variable").agg(F.count_if(outside).alias("clipped"))


def fit_scaling(df: DataFrame, by: list[str], variables: list[str] = fixed.NUMERIC) -> DataFrame:
    """(by, variable, low, high, mean, scale, range): all a new row needs.

    ``scale`` is the population deviation after clipping, ``range`` the spread of
    the scaled values; zero spreads become 1.
    """
    limits = clip_limits(df, by, variables)
    # One row per supplier of the portfolio and variable.
    clipped = long_form(df, by, variables).join(F.broadcast(limits), [*by, "variable"])
    x = clip(F.col("value"), F.col("low"), F.col("high"))
    stats = clipped.groupBy(*by, "variable").agg(
        F.first("low").alias("low"),
        F.first("high").alias("high"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("scale"),
        (F.max(x) - F.min(x)).alias("range"),
    )

    def not_zero(c: Column) -> Column:
        # Equal inputs can leave a rounding-sized deviation.
        return F.when(F.abs(c) > 1e-12, c).otherwise(1.0)

    scale = F.when(F.col("range") > 0, not_zero(F.col("scale"))).otherwise(1.0)
    return stats.withColumn("scale", scale).withColumn(
        "range", not_zero(F.col("range") / F.col("scale"))
    )


def scaling_wide(scaling: DataFrame, by: list[str], variables: list[str] = fixed.NUMERIC) -> DataFrame:
    parts = ["low", "high", "mean", "scale", "range"]
    entry = F.struct(*parts)
    return scaling.groupBy(*by).agg(
        *[F.first(F.when(F.col("variable") == v, entry), ignorenulls=True).alias(f"{v}__fit") for v in variables]
    )


def scale(df: DataFrame, scaling: DataFrame, by: list[str], variables: list[str] = fixed.NUMERIC) -> DataFrame:
    """Add ``z_<variable>`` and ``u_<variable>`` (share of the mixed distance)."""
    wide = scaling_wide(scaling, by, variables)
    if by:
        # One row per supplier of the portfolio.
        joined = df.join(F.broadcast(wide), by)
    else:
        joined = df.withColumn("_fit", wide.agg(F.first(F.struct("*"))).scalar()).select("*", "_fit.*").drop("_fit")
    total = len(variables) + fixed.CATEGORY_WEIGHT
    out = joined.select(
        *df.columns,
        *[
            ((clip(F.col(v), F.col(f"{v}__fit.low"), F.col(f"{v}__fit.high")) - F.col(f"{v}__fit.mean"))
             / F.col(f"{v}__fit.scale")).alias(f"z_{v}")
            for v in variables
        ],
        *[F.col(f"{v}__fit.range").alias(f"_r_{v}") for v in variables],
    )
    return out.select(
        *df.columns,
        *[f"z_{v}" for v in variables],
        *[(F.col(f"z_{v}") / F.col(f"_r_{v}") / F.lit(total)).alias(f"u_{v}") for v in variables],
    )


def one_hot(df: DataFrame, category: str, known: list[str], prefix: str = "is_") -> DataFrame:
    """0/1 columns in name order; an unknown category is all zeros."""
    return df.select(
        "*",
        *[
            (F.coalesce(F.col(category) == c, F.lit(False))).cast("double").alias(f"{prefix}{i}")
            for i, c in enumerate(sorted(known))
        ],
    )


def correlations(df: DataFrame, by: list[str], variables: list[str] = fixed.NUMERIC) -> DataFrame:
    """(by, a, b, r, varies): Pearson for every pair, constant columns give 0."""
    pairs = list(combinations(variables, 2))
    wide = df.groupBy(*by).agg(
        *[
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                F.try_divide(
                    F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)
                ).alias("r"),
                ((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)).alias("varies"),
            ).alias(f"p{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(
        *by, F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")
    ).select(
        *by,
        "p.a",
        "p.b",
        F.coalesce("p.r", F.lit(0.0)).alias("r"),
        "p.varies",
    )


def redundant_pairs(corr: DataFrame, threshold: float = fixed.REDUNDANT_R) -> DataFrame:
    return corr.filter(F.abs("r") >= threshold)


def collinear_pairs(corr: DataFrame, threshold: float = fixed.COLLINEAR_R) -> DataFrame:
    return corr.filter(F.col("varies") & (F.abs("r") >= threshold))


def eta_squared(
    df: DataFrame, by: list[str], category: str, variables: list[str] = fixed.NUMERIC
) -> DataFrame:
    """(by, variable, eta2): share of a variable's variance explained by the category."""
    cells = long_form(df, [*by, category], variables).groupBy(*by, "variable", category).agg(
        F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    whole = cells.groupBy(*by, "variable").agg(
        F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_m")
    )
    # One row per supplier of the portfolio and variable.
    joined = cells.join(F.broadcast(whole), [*by, "variable"])
    between = F.sum(F.col("n") * F.pow(F.col("m") - F.col("_m"), 2))
    within = F.sum(F.col("n") * F.col("v"))
    return joined.groupBy(*by, "variable").agg(
        F.when(between + within > 0, between / (between + within)).alias("eta2")
    )


def variable_diagnostics(
    df: DataFrame, by: list[str], category: str, variables: list[str] = fixed.NUMERIC
) -> DataFrame:
    """(by, variable, spread, dominant_share, eta2, finding): the first finding wins."""
    long = long_form(df, by, variables)
    counts = long.groupBy(*by, "variable", F.round("value", 6).alias("v")).agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    shares = counts.groupBy(*by, "variable").agg(
        (F.max("hi") - F.min("lo")).alias("spread"),
        (F.max("n") / F.sum("n")).alias("dominant_share"),
    )
    joined = shares.join(eta_squared(df, by, category, variables), [*by, "variable"])
    finding = (
        F.when(F.col("spread") == 0, "constant")
        .when(F.col("dominant_share") >= fixed.NEAR_CONSTANT, "nearly constant")
        .when(F.col("eta2") >= fixed.RECODED_ETA2, "recoded category")
    )
    return joined.withColumn("finding", finding)


def quartile_bins(df: DataFrame, by: list[str], value: str, name: str = "quartile") -> DataFrame:
    """Bin 0..3 by exact quartiles; equal values stay together, repeated edges merge."""
    edges = percentiles(
        df, by, value, {"e0": 0.0, "e1": 0.25, "e2": 0.5, "e3": 0.75, "e4": 1.0}
    )
    if by:
        # One row per supplier of the portfolio.
        joined = df.join(F.broadcast(edges), by)
    else:
        joined = df.withColumn("_e", edges.agg(F.first(F.struct("*"))).scalar()).select("*", "_e.*").drop("_e")
    inner = F.filter(
        F.array_distinct(F.array("e0", "e1", "e2", "e3", "e4")), lambda e: e < F.col(value)
    )
    # Intervals are closed on the right and the lowest edge belongs to the first.
    return joined.select(
        *df.columns, F.greatest(F.size(inner) - 1, F.lit(0)).cast("long").alias(name)
    )


def summary(df: DataFrame, by: list[str], variables: list[str]) -> DataFrame:
    """count, mean, sample deviation, min, 50 / 90 / 99 %, max per variable."""
    long = long_form(df, by, variables)
    moments = long.groupBy(*by, "variable").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    marks = percentiles(long, [*by, "variable"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return moments.join(marks, [*by, "variable"])
