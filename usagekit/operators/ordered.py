"""Order-dependent work on users of any size.

A window over one user puts all rows of that user into one task, which fails when a single user (a
bot, a shared account) holds a large part of the log. These helpers partition by user *and* time
slice. What crosses a slice border is carried by a small table with one row per (user, slice) or per
(user, activity segment), whose size is bounded by the time span of the log, not by the event count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagekit.functions.derive import flag

SLICE_SECONDS = 3600
GRAM_SEPARATOR = " -> "


def time_slice(ts: str = "ts", seconds: int = SLICE_SECONDS) -> Column:
    """Number of the time slice an event falls in; one user's events of a slice are ordered in one task."""
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000)).cast("long")


def _slice_rows(events: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column) -> tuple[DataFrame, Window]:
    rows = events.withColumn("slice", slice_by)
    window = Window.partitionBy(*keys, "slice").orderBy(*order)
    return rows, window


def activity_segments(events: DataFrame, gap_min: float, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """Runs of events of one user without a gap above ``gap_min``, cut at slice borders.

    One row per (user, slice, run): start, end, events and the requested sums and maxima.
    """
    rows, window = _slice_rows(events, ["person_id"], ["ts", "event_id"], time_slice())
    sums, maxima = sums or {}, maxima or {}
    rows = rows.select(
        "person_id", "slice", "ts", "event_id",
        *[c.alias(n) for n, c in sums.items()], *[c.alias(n) for n, c in maxima.items()],
    )
    rows = _with_local_run(rows, window, gap_min)
    return rows.groupBy("person_id", "slice", "run").agg(
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.count(F.lit(1)).alias("events"),
        *[F.sum(n).alias(n) for n in sums],
        *[F.max(n).alias(n) for n in maxima],
    )


def _with_local_run(rows: DataFrame, window, gap_min: float) -> DataFrame:
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(window))
    starts = flag(gap.isNull() | (gap > F.lit(int(gap_min * 60_000_000))))
    return rows.withColumn("starts_run", starts).withColumn("run", F.sum("starts_run").over(window).cast("long")).drop("starts_run")


def _number_segments(segments: DataFrame, gap_min: float) -> DataFrame:
    """Joins neighbouring segments into sessions: running number per user."""
    window = Window.partitionBy("person_id").orderBy("start")
    gap = F.unix_micros("start") - F.unix_micros(F.lag("end").over(window))
    starts = flag(gap.isNull() | (gap > F.lit(int(gap_min * 60_000_000))))
    return segments.withColumn("starts_session", starts).withColumn(
        "session_num", F.sum("starts_session").over(window).cast("long")
    ).drop("starts_session")


def session_table(events: DataFrame, gap_min: float = 30, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """One row per derived session of a user, with event count, bounds and the requested totals."""
    sums, maxima = sums or {}, maxima or {}
    segments = _number_segments(activity_segments(events, gap_min, sums, maxima), gap_min)
    return segments.groupBy("person_id", "session_num").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("events").alias("events"),
        *[F.sum(n).alias(n) for n in sums],
        *[F.max(n).alias(n) for n in maxima],
    )


def token_runs(calls: DataFrame, gap_min: float) -> DataFrame:
    """Runs of activity with their tokens: one row per (user, hour, run, token) with ``n`` calls and the bounds
    of the run. Distinct tokens over any number of runs are groups of these rows; calls move once."""
    rows, window = _slice_rows(calls.select("person_id", "ts", "event_id", "token"), ["person_id"], ["ts", "event_id"], time_slice())
    counted = _with_local_run(rows, window, gap_min).groupBy("person_id", "slice", "run", "token").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    run = Window.partitionBy("person_id", "slice", "run")
    return counted.select("person_id", "slice", "run", "token", "n", F.min("first").over(run).alias("start"), F.max("last").over(run).alias("end"))


def sessionize(events: DataFrame, gap_min: float = 30, session_col: str = "session_num") -> DataFrame:
    """Adds a running session number per user: a new session at the first event and after every gap
    above ``gap_min`` minutes (a gap of exactly that length continues the session)."""
    numbered = _number_segments(activity_segments(events, gap_min), gap_min)
    offsets = numbered.groupBy("person_id", "slice").agg((F.min("session_num") - 1).alias("offset"))
    rows, window = _slice_rows(events, ["person_id"], ["ts", "event_id"], time_slice())
    rows = _with_local_run(rows, window, gap_min)
    joined = rows.join(offsets, ["person_id", "slice"])
    return joined.select(*[F.col(c) for c in events.columns], (F.col("offset") + F.col("run")).alias(session_col))


def ngrams(
    tokens: DataFrame,
    n: int,
    keys: Sequence[str],
    order: Sequence[str] = ("ts", "event_id"),
    token: str = "token",
    slice_by: Column | None = None,
) -> DataFrame:
    """All n-grams of every sequence, one row per occurrence: the keys, ``t1`` … ``tn`` and ``gram``.

    NULL and empty tokens are dropped first. Inside a slice the following tokens come from ``lead``;
    the grams that cross a slice border are built from the first and last n-1 tokens of each slice.
    """
    keys = list(keys)
    slice_by = time_slice() if slice_by is None else slice_by
    rows = tokens.where(F.length(token) > 0).select(*keys, *order, F.col(token).alias("t1"), slice_by.alias("slice"))
    window = Window.partitionBy(*keys, "slice").orderBy(*order)
    names = [f"t{i}" for i in range(1, n + 1)]
    follow = {f"t{i}": F.lead("t1", i - 1).over(window) for i in range(2, n + 1)}
    inside = rows.withColumns(follow).where(F.col(names[-1]).isNotNull()).select(*keys, *names)
    if n > 1:
        inside = inside.unionByName(_border_ngrams(rows, n, keys, window, names))
    return inside.withColumn("gram", F.concat_ws(GRAM_SEPARATOR, *names))


def _border_ngrams(rows: DataFrame, n: int, keys: list[str], window, names: list[str]) -> DataFrame:
    whole = Window.partitionBy(*keys, "slice")
    edge = n - 1
    ranked = rows.withColumn("pos", F.row_number().over(window)).withColumn("size", F.count(F.lit(1)).over(whole))
    from_end = F.col("size") - F.col("pos")
    ends = ranked.groupBy(*keys, "slice").agg(
        *[F.max(F.when(F.col("pos") == i, F.col("t1"))).alias(f"h{i}") for i in range(1, edge + 1)],
        *[F.max(F.when(from_end == edge - i, F.col("t1"))).alias(f"e{i}") for i in range(1, edge + 1)],
    )
    head = F.array_compact(F.array(*[F.col(f"h{i}") for i in range(1, edge + 1)]))
    tail = F.array_compact(F.array(*[F.col(f"e{i}") for i in range(1, edge + 1)]))
    ends = ends.select(*keys, "slice", head.alias("head"), tail.alias("tail"))
    by_slice = Window.partitionBy(*keys).orderBy("slice")
    empty = F.array().cast("array<string>")
    nxt = [F.coalesce(F.lead("head", i).over(by_slice), empty) for i in range(1, edge + 1)]
    joined = ends.select(*keys, F.col("tail"), F.slice(F.concat(*nxt), 1, edge).alias("next"))
    joined = joined.select(*keys, F.concat("tail", "next").alias("c"), F.size("tail").alias("size"))
    last_start = F.least(F.col("size"), F.size("c") - F.lit(n - 1))
    starts = joined.where(last_start >= 1).select(*keys, "c", F.explode(F.sequence(F.lit(1), last_start)).alias("at"))
    return starts.select(*keys, *[F.get(F.col("c"), F.col("at") + F.lit(i - 2)).alias(f"t{i}") for i in range(1, n + 1)])


def gram_levels(
    tokens: DataFrame,
    n: int,
    keys: Sequence[str],
    order: Sequence[str] = ("ts", "event_id"),
    token: str = "token",
    within: str | None = None,
    slice_by: Column | None = None,
) -> DataFrame:
    """Grams of every length from 1 to ``n`` from one pass, one row per occurrence: the keys, ``n``, ``gram`` and
    ``together`` (1 if all its tokens carry one value of ``within``, for instance one session).

    A gram of length n extends its first n-1 tokens, so the rows are the levels of a suffix trie of the
    sequences. NULL and empty tokens are dropped first; borders of slices are crossed as in ``ngrams``.
    """
    keys, edge = list(keys), n - 1
    slice_by = time_slice() if slice_by is None else slice_by
    group = F.lit(0) if within is None else F.col(within)
    one = F.struct(F.col(token).alias("t"), group.alias("g"))
    rows = tokens.where(F.length(token) > 0).select(*keys, *order, one.alias("x"), slice_by.alias("slice"))
    window = Window.partitionBy(*keys, "slice").orderBy(*order)
    following = F.array_compact(F.array(F.col("x"), *[F.lead("x", i).over(window) for i in range(1, n)]))
    parts = rows.select(*keys, following.alias("c"), F.lit(1).alias("low"), F.size(following).alias("high"))
    if n > 1:
        whole = Window.partitionBy(*keys, "slice")
        ranked = rows.withColumn("pos", F.row_number().over(window)).withColumn("size", F.count(F.lit(1)).over(whole))
        from_end = F.col("size") - F.col("pos")

        def picked(place: Column, places: Sequence[int]) -> Column:
            return F.array_compact(F.array(*[F.max(F.when(place == i, F.col("x"))) for i in places]))

        ends = ranked.groupBy(*keys, "slice").agg(
            picked(F.col("pos"), range(1, edge + 1)).alias("head"), picked(from_end, range(edge - 1, -1, -1)).alias("tail")
        )
        by_slice = Window.partitionBy(*keys).orderBy("slice")
        heads = [F.lead("head", i).over(by_slice) for i in range(1, edge + 1)]
        nothing = F.slice("head", 1, 0)
        nxt = F.slice(F.concat(*[F.coalesce(h, nothing) for h in heads]), 1, edge)
        ends = ends.select(*keys, "tail", nxt.alias("next")).where(F.size("next") > 0)
        at = ends.select(*keys, F.concat("tail", "next").alias("all"), F.size("tail").alias("size"), F.explode(F.sequence(F.lit(1), F.size("tail"))).alias("at"))
        # From place ``at`` of the tail, only lengths that reach the next slice are new.
        reach = F.slice("all", F.col("at"), n)
        at = at.select(*keys, reach.alias("c"), (F.col("size") - F.col("at") + 2).alias("low"), F.size(reach).alias("high"))
        parts = parts.unionByName(at.where("low <= high"))
    out = parts.select(*keys, "c", F.explode(F.sequence("low", "high")).alias("n"))
    gram = F.slice("c", 1, F.col("n"))
    return out.select(
        *keys, "n", F.array_join(F.transform(gram, lambda x: x["t"]), GRAM_SEPARATOR).alias("gram"),
        flag(F.size(F.array_distinct(F.transform(gram, lambda x: x["g"]))) == 1).alias("together"),
    )


def dedup_steps(events: DataFrame, step: Column, n: int, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """First ``n`` steps per user after merging equal neighbours: columns ``step_1`` … ``step_n``.

    Each slice keeps its first n+1 merged steps, which is all a path of length n can need from it.
    """
    rows = events.select("person_id", "ts", "event_id", step.alias("step"), time_slice(seconds=slice_seconds).alias("slice"))
    local = Window.partitionBy("person_id", "slice").orderBy("ts", "event_id")
    rows = rows.withColumn("before", F.lag("step").over(local)).where(F.col("before").isNull() | (F.col("before") != F.col("step")))
    rows = rows.withColumn("pos", F.row_number().over(local)).where(F.col("pos") <= n + 1)
    user = Window.partitionBy("person_id").orderBy("slice", "pos")
    rows = rows.withColumn("before", F.lag("step").over(user)).where(F.col("before").isNull() | (F.col("before") != F.col("step")))
    rows = rows.withColumn("at", F.row_number().over(user)).where(F.col("at") <= n)
    return rows.groupBy("person_id").agg(
        *[F.max(F.when(F.col("at") == i, F.col("step"))).alias(f"step_{i}") for i in range(1, n + 1)]
    )
