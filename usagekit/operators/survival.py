"""Product-limit survival curves over discrete times (active days)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagekit.functions.derive import flag


def activity_survival(users: DataFrame) -> DataFrame:
    """Survival time and event flag of a user: active days (at least 1), came back on a second day."""
    return users.withColumns(
        {"survival_time": F.greatest(F.col("days_active"), F.lit(1)), "had_engagement": flag(F.col("days_active") >= 2)}
    )


def kaplan_meier(
    df: DataFrame, time: str = "survival_time", event: str = "had_engagement", group: str = "segment", min_users: int = 1, z: float = 1.96
) -> DataFrame:
    """S(t) = prod(1 - d/n) per group at t = 0 and at every event time, with the log-log Greenwood band.

    The users are reduced to one row per (group, time) before any window runs, so the windows see at
    most as many rows per group as there are distinct days. The band is NULL where S is 0 or 1.
    """
    at_times = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group"), F.col(time).alias("timeline")).agg(
        F.count(F.lit(1)).alias("leaving"), F.sum(event).alias("d")
    )
    whole = Window.partitionBy("group")
    forward = whole.orderBy("timeline").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backward = whole.orderBy(F.desc("timeline")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    risk = at_times.withColumn("n_users", F.sum("leaving").over(whole)).where(F.col("n_users") >= min_users)
    risk = risk.withColumn("at_risk", F.sum("leaving").over(backward))
    n, d = F.col("at_risk").cast("double"), F.col("d").cast("double")
    curve = risk.withColumn("survival", F.product(1.0 - d / n).over(forward))
    variance = F.sum(F.coalesce(d / F.nullif(n * (n - d), F.lit(0.0)), F.lit(0.0))).over(forward)
    curve = curve.withColumn("variance", variance).where(F.col("d") > 0)
    inner = (F.col("survival") > 0) & (F.col("survival") < 1)
    log_s = F.when(inner, F.log("survival"))
    width = F.lit(z) * F.sqrt("variance") / log_s
    curve = curve.select(
        "group", F.col("timeline").cast("long").alias("timeline"), "survival", "n_users", F.col("at_risk"),
        F.exp(log_s * F.exp(-width)).alias("ci_low"), F.exp(log_s * F.exp(width)).alias("ci_high"),
    )
    start = curve.groupBy("group").agg(F.max("n_users").alias("n_users")).select(
        "group", F.lit(0).cast("long").alias("timeline"), F.lit(1.0).alias("survival"), "n_users",
        F.col("n_users").alias("at_risk"), F.lit(None).cast("double").alias("ci_low"), F.lit(None).cast("double").alias("ci_high"),
    )
    return start.unionByName(curve)
