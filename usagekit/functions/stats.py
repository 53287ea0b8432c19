"""Statistics as column expressions and small aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson_interval(successes: Column, total: Column, z: float = 1.96) -> Column:
    """Struct ``(low, high)``: Wilson score bounds limited to [0, 1]; (0, 0) for an empty group."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = successes.cast("double") / n
    scale = 1.0 + z * z / n
    centre = (p + z * z / (2.0 * n)) / scale
    margin = z * F.sqrt((p * (1.0 - p) + z * z / (4.0 * n)) / n) / scale
    low = F.greatest(F.lit(0.0), centre - margin)
    high = F.least(F.lit(1.0), centre + margin)
    return F.struct(
        F.when(total > 0, low).otherwise(F.lit(0.0)).alias("low"),
        F.when(total > 0, high).otherwise(F.lit(0.0)).alias("high"),
    )


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample standard deviation, extremes and exact quartiles of a column."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.percentile(v, 0.25).alias("p25"),
        F.percentile(v, 0.5).alias("p50"),
        F.percentile(v, 0.75).alias("p75"),
        F.max(v).alias("max"),
    )


def value_ranges(df: DataFrame, columns: Sequence[str]) -> Column:
    """Scalar subquery with the minimum and maximum of each column (NULL counts as 0): one row,
    whatever the size of the table."""
    zero = F.lit(0.0)
    parts = []
    for name in columns:
        value = F.coalesce(F.col(name).cast("double"), zero)
        parts.append(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias(name))
    return df.agg(F.struct(*parts).alias("ranges")).scalar()


def min_max(ranges: Column, name: str) -> Column:
    """Value scaled to 0..1 by the ranges of :func:`value_ranges`; 0 for a constant column."""
    value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    low, high = ranges[name]["low"], ranges[name]["high"]
    return F.coalesce((value - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))


def column_max_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each listed column divided by its maximum over the table (0 where the maximum is not positive).
    Meant for summary tables of a few rows."""
    tops = df.agg(F.struct(*[F.max(F.col(c).cast("double")).alias(c) for c in columns]).alias("tops")).scalar()
    scaled = {
        c: F.when(tops[c] > 0, F.col(c).cast("double") / F.nullif(tops[c], F.lit(0.0))).otherwise(F.lit(0.0)) for c in columns
    }
    return df.withColumns(scaled)


def group_share(value: str, by: Sequence[str]) -> Column:
    """Percentage of the group's total held by the row, for summary tables."""
    from pyspark.sql import Window

    total = F.sum(value).over(Window.partitionBy(*by))
    return F.col(value).cast("double") * 100.0 / F.nullif(total.cast("double"), F.lit(0.0))


QUANTILE_CELLS = 256


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles of a column with any number of distinct values.

    The built-in exact percentile keeps every distinct value of a group in one task. Here equal values
    are counted first, the distinct values are cut into cells of about equal size by an approximate
    sketch, and only the cells that hold a wanted rank are ordered, each in its own task.
    """
    from pyspark.sql import Window

    keys = list(by) or ["__all"]
    rows = df.select(*[F.col(k) for k in by], F.col(value).cast("double").alias("v"))
    rows = rows if by else rows.withColumn("__all", F.lit(0))
    counts = rows.where(F.col("v").isNotNull()).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))

    steps = F.array(*[F.lit(i / QUANTILE_CELLS) for i in range(1, QUANTILE_CELLS)])
    edges = counts.groupBy(*keys).agg(F.percentile_approx("v", steps, 10_000).alias("edges"))
    # without groups the edges are one value, read as a scalar subquery
    celled = counts.join(edges, keys) if by else counts.withColumn("edges", edges.select("edges").scalar())
    celled = celled.select(
        *keys, "v", "n", F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("cell")
    )
    totals = celled.groupBy(*keys, "cell").agg(F.sum("n").alias("cell_n"))
    by_cell = Window.partitionBy(*keys).orderBy("cell")
    totals = totals.select(
        *keys,
        "cell",
        (F.sum("cell_n").over(by_cell) - F.col("cell_n")).alias("before"),
        (F.sum("cell_n").over(by_cell)).alias("after"),
        F.sum("cell_n").over(Window.partitionBy(*keys)).alias("total"),
    )
    ranks = []
    for p in probs.values():
        at = F.lit(p) * (F.col("total") - 1)
        ranks += [F.floor(at), F.least(F.floor(at) + 1, F.col("total") - 1)]
    wanted = F.exists(F.array(*ranks), lambda r: (r >= F.col("before")) & (r < F.col("after")))
    inside = celled.join(totals.where(wanted), [*keys, "cell"])
    ordered = Window.partitionBy(*keys, "cell").orderBy("v")
    end = F.col("before") + F.sum("n").over(ordered)
    inside = inside.withColumn("end", end).withColumn("begin", F.col("end") - F.col("n"))
    out = []
    for alias, p in probs.items():
        at = F.lit(p) * (F.col("total") - 1)
        low = F.floor(at)
        high = F.least(low + 1, F.col("total") - 1)
        low_v = F.max(F.when((F.col("begin") <= low) & (F.col("end") > low), F.col("v")))
        high_v = F.max(F.when((F.col("begin") <= high) & (F.col("end") > high), F.col("v")))
        part = F.max(at - low)
        out.append((low_v + (high_v - low_v) * part).alias(alias))
    result = inside.groupBy(*keys).agg(*out)
    return result if by else result.drop("__all")


def describe_exact(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """:func:`describe` for a column with many distinct values."""
    v = F.col(value).cast("double")
    moments = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    quartiles = exact_quantiles(df, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, by)
    if by:
        return moments.join(quartiles, list(by))
    return beside(moments, quartiles)


def beside(row: DataFrame, other: DataFrame) -> DataFrame:
    """Two one-row tables as one row; the second is read as a scalar subquery and may be empty."""
    values = other.select(F.struct(*other.columns).alias("v")).scalar()
    return row.withColumns({c: values[c] for c in other.columns})
