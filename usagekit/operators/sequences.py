"""Workflow sequences: n-grams with lift, tool transitions and mixes, early paths and their branches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagekit.functions.derive import one_of, depth_points, elapsed, event_category, flag, session_phase, tool_label, with_canonical_event, with_tool
from usagekit.operators.ordered import GRAM_SEPARATOR, _number_segments, dedup_steps, gram_levels, ngrams, sessionize, token_runs
from usagekit.operators.segments import BUILDER, CODER, GHOST, VIEWER
from usagekit.session import materialize
from usagekit.vocabulary import DEFAULT, TRANSITION_STATES, Vocabulary

KEY = "person_id"


def tool_calls(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Agent tool calls with their display name; worker rows and rows without a tool are left out."""
    calls = with_tool(log.where(one_of(vocab.tool_events) | F.col("tool_name").isNotNull()), vocab)
    calls = calls.where(F.col("tool").isNotNull() & (F.col("tool") != vocab.worker_tool))
    return calls.select(KEY, "ts", "event_id", "event", tool_label("tool", vocab).alias("token"))


def event_tokens(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    tokens = with_canonical_event(with_tool(log, vocab), vocab)
    return tokens.select(KEY, "ts", "event_id", F.col("unified_event").alias("token"))


def ngram_counts(tokens: DataFrame, n: int, keys: Sequence[str] = (KEY,), order: Sequence[str] = ("ts", "event_id"), slice_by: Column | None = None) -> DataFrame:
    """How often each n-gram occurs over all sequences."""
    return ngrams(tokens, n, keys, order, slice_by=slice_by).groupBy("gram").agg(F.count(F.lit(1)).alias("occurrences"))


def _user_grams(tokens: DataFrame, n: int, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """N-gram counts per user; combined before the join with user labels, so no user brings more rows
    than there are distinct grams."""
    return ngrams(tokens, n, keys).groupBy(KEY, "gram").agg(F.count(F.lit(1)).alias("n"))


def top_ngrams_by_segment(tokens: DataFrame, users: DataFrame, n: int, k: int, segments: Sequence[str]) -> DataFrame:
    labelled = _user_grams(tokens, n).join(users.where(F.col("segment").isin(*segments)).select(KEY, "segment"), KEY)
    counts = labelled.groupBy("segment", "gram").agg(F.sum("n").alias("occurrences"))
    rank = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("occurrences"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def _focal_counts(grams: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts per gram in the focal group (``focal`` = 1) and in the base group (0); users without a
    row in ``groups`` belong to neither."""
    joined = grams.join(groups, KEY)
    return joined.groupBy("gram").agg(
        F.coalesce(F.sum(F.when(F.col("focal") == 1, F.col("n"))), F.lit(0)).cast("long").alias("focal_count"),
        F.coalesce(F.sum(F.when(F.col("focal") == 0, F.col("n"))), F.lit(0)).cast("long").alias("baseline_count"),
    )


def lift_table(counts: DataFrame, n: int, min_count: int = 10, min_baseline: int = 0, alpha: float = 1.0) -> DataFrame:
    """Supports, Laplace-smoothed lift and publishable flag for grams of the focal group."""
    totals = counts.agg(
        F.struct(
            F.greatest(F.coalesce(F.sum("focal_count"), F.lit(0)), F.lit(1)).cast("double").alias("focal"),
            F.greatest(F.coalesce(F.sum("baseline_count"), F.lit(0)), F.lit(1)).cast("double").alias("base"),
            F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double").alias("vocabulary"),
        ).alias("totals")
    ).scalar()
    rows = counts.where((F.col("focal_count") >= min_count) & (F.col("focal_count") > 0)).withColumn("totals", totals)
    focal, base = F.col("focal_count"), F.col("baseline_count")
    smooth = F.lit(alpha) * F.col("totals.vocabulary")
    lift = ((focal + alpha) / (F.col("totals.focal") + smooth)) / ((base + alpha) / (F.col("totals.base") + smooth))
    return rows.select(
        F.col("gram").alias("ngram"), F.lit(n).alias("n"), "focal_count", "baseline_count",
        (focal / F.col("totals.focal")).alias("focal_support"),
        (base / F.col("totals.base")).alias("baseline_support"),
        lift.alias("lift"),
        flag(base >= min_baseline).alias("publishable"),
    )


def ngram_lift(
    tokens: DataFrame, groups: DataFrame, n: int, keys: Sequence[str] = (KEY,), min_count: int = 10,
    min_baseline: int = 0, top_k: int = 20, alpha: float = 1.0,
) -> DataFrame:
    """The n-grams most typical of the focal users against the base users."""
    table = lift_table(_focal_counts(_user_grams(tokens, n, keys), groups), n, min_count, min_baseline, alpha)
    return table.orderBy(F.desc("lift"), F.desc("focal_count"), "ngram").limit(top_k)


def _focal(users: DataFrame, condition: Column) -> DataFrame:
    return users.select(KEY, flag(condition).alias("focal"))


def _top_lift(counts: DataFrame, n: int, min_count: int, min_baseline: int, top_k: int) -> DataFrame:
    table = lift_table(counts, n, min_count, min_baseline)
    return table.orderBy(F.desc("lift"), F.desc("focal_count"), "ngram").limit(top_k)


def motif_counts(tokens: DataFrame, users: DataFrame, n: int, measures: dict[str, tuple[str, Column, Column]], gap_min: float = 30) -> DataFrame:
    """Trie of gram counts with the measures side by side: one row per (sequence, n, gram).

    ``tokens`` is cut into sessions once and passed once. Sequences are "all" tokens of a user and the
    user's "tools" alone; ``together`` grams lie in one session. ``measures`` maps a name to (sequence, which rows count,
    which users are focal) and gives the columns ``<name>_focal`` and ``<name>_base``. Users outside
    ``users`` belong to neither side.
    """
    tools = F.when(F.startswith("token", F.lit("tool_")), F.lit("tools"))
    sequences = F.explode(F.array_compact(F.array(F.lit("all"), tools)))
    rows = sessionize(tokens, gap_min).withColumn("sequence", sequences)
    grams = gram_levels(rows, n, [KEY, "sequence"], within="session_num")
    per_user = grams.groupBy(KEY, "sequence", "n", "gram").agg(F.count(F.lit(1)).alias("times"), F.sum("together").alias("together"))
    focal = users.select(KEY, *[flag(condition).alias(f"is_{name}") for name, (_, _, condition) in measures.items()])
    columns = []
    for name, (sequence, times, _) in measures.items():
        here = F.col("sequence") == sequence
        for side, value in (("focal", 1), ("base", 0)):
            counted = F.sum(F.when(here & (F.col(f"is_{name}") == value), times))
            columns.append(F.coalesce(counted, F.lit(0)).cast("long").alias(f"{name}_{side}"))
    return per_user.join(focal, KEY).groupBy("sequence", "n", "gram").agg(*columns)


def motif_tables(log: DataFrame, users: DataFrame, gap_min: float = 30, min_count: int = 5, min_baseline: int = 3, top_k: int = 20, complexity_cut: Column | None = None) -> DataFrame:
    """Four motif comparisons stacked: builders, ghosts, churned sessions, high-complexity tool use.

    ``users`` carries segment, is_churn and avg_canvas_complexity. The complexity cut is the exact
    median of all users, "high" includes the cut itself. All four read levels of one written count table.
    """
    from usagekit.functions.stats import exact_quantiles

    if complexity_cut is None:
        complexity_cut = exact_quantiles(users, "avg_canvas_complexity", {"cut": 0.5}).scalar()
    times, together = F.col("times"), F.col("together")
    measures = {
        "builder": ("all", times, F.col("segment") == BUILDER),
        "ghost": ("all", times, F.col("segment") == GHOST),
        "churn": ("all", together, F.col("is_churn") == 1),
        "complexity": ("tools", times, F.col("avg_canvas_complexity") >= complexity_cut),
    }
    counts = materialize(motif_counts(event_tokens(log), users, 3, measures, gap_min), "motif-counts")
    comparisons = {
        "Agent Builder motifs": ("builder", 3), "Ghost motifs": ("ghost", 2),
        "Churn motifs": ("churn", 2), "High complexity tool motifs": ("complexity", 3),
    }
    out: DataFrame | None = None
    for label, (name, n) in comparisons.items():
        level = counts.where((F.col("sequence") == measures[name][0]) & (F.col("n") == n))
        level = level.select("gram", F.col(f"{name}_focal").alias("focal_count"), F.col(f"{name}_base").alias("baseline_count"))
        level = level.where(F.col("focal_count") + F.col("baseline_count") > 0)
        part = _top_lift(level, n, min_count, min_baseline, top_k).withColumn("comparison", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


def segment_motifs(log: DataFrame, users: DataFrame, segments: Sequence[str] = (BUILDER, CODER, VIEWER, GHOST), n: int = 2, min_count: int = 5, min_baseline: int = 3, top_k: int = 5, keep: int = 3) -> DataFrame:
    """Publishable top bigrams of each segment against everyone else, from one gram count per segment.

    Ranks come first (the top k by lift), the publishable ones among them second.
    """
    grams = _user_grams(event_tokens(log), n).join(users.select(KEY, "segment"), KEY)
    wide = grams.groupBy("gram").agg(
        F.sum("n").alias("all_n"),
        *[F.coalesce(F.sum(F.when(F.col("segment") == s, F.col("n"))), F.lit(0)).cast("long").alias(s) for s in segments],
    )
    wide = materialize(wide, "segment-grams", small_tasks=True)
    order = [F.desc("lift"), F.desc("focal_count"), F.asc("ngram")]
    out: DataFrame | None = None
    for segment in segments:
        split = wide.select("gram", F.col(segment).alias("focal_count"), (F.col("all_n") - F.col(segment)).alias("baseline_count"))
        table = lift_table(split, n, min_count, min_baseline).orderBy(*order).limit(top_k)
        table = table.where(F.col("publishable") == 1).orderBy(*order).limit(keep).withColumn("segment", F.lit(segment))
        out = table if out is None else out.unionByName(table)
    return out


def transition_matrix(calls: DataFrame, users: DataFrame, segment: str = BUILDER, states: Sequence[str] = TRANSITION_STATES) -> DataFrame:
    """Row-normalised percentages of consecutive tools inside one segment."""
    grams = ngrams(calls, 2, [KEY]).groupBy(KEY, "t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    chosen = grams.join(users.where(F.col("segment") == segment).select(KEY), KEY, "left_semi")
    chosen = chosen.where(F.col("t1").isin(*states) & F.col("t2").isin(*states))
    wide = chosen.groupBy("t1").pivot("t2", list(states)).agg(F.sum("n")).fillna(0, subset=list(states))
    total = sum((F.col(s) for s in states[1:]), F.col(states[0]))
    return wide.select(F.col("t1").alias("from_tool"), *[(F.col(s) * 100.0 / F.nullif(total, F.lit(0))).alias(s) for s in states])


def tool_mix(calls: DataFrame, users: DataFrame, segments: Sequence[str] = (BUILDER, CODER, VIEWER), top: int = 8) -> DataFrame:
    """Share of the overall top tools inside each segment."""
    per_user = calls.groupBy(KEY, "token").agg(F.count(F.lit(1)).alias("n"))
    counts = per_user.join(users.select(KEY, "segment"), KEY, "left").groupBy("segment", "token").agg(F.sum("n").alias("calls"))
    leaders = counts.groupBy("token").agg(F.sum("calls").alias("total")).orderBy(F.desc("total"), "token").limit(top)
    kept = counts.where(F.col("segment").isin(*segments)).join(F.broadcast(leaders.select("token")), "token")
    pct = F.col("calls") * 100.0 / F.sum("calls").over(Window.partitionBy("segment"))
    return kept.select("segment", F.col("token").alias("tool"), "calls", pct.alias("pct"))


def mean_tool_calls(users: DataFrame, top: int = 6, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Mean calls per user and segment for the tools with the largest sum of segment means."""
    columns = ["tool_" + t for t in vocab.tools]
    means = users.groupBy("segment").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    long = means.unpivot(["segment"], columns, "tool", "avg_calls")
    total = F.sum("avg_calls").over(Window.partitionBy("tool"))
    ranked = long.withColumn("total", total).withColumn("place", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("total"), "tool")))
    return ranked.where(F.col("place") <= top).select("segment", "tool", "avg_calls")


def phase_tool_mix(calls: DataFrame, users: DataFrame, segment: str = BUILDER, top: int = 7, gap_min: float = 30) -> DataFrame:
    """Tool shares in the first, second-to-third and later sessions of one segment."""
    numbered = sessionize(calls, gap_min)
    per_user = numbered.groupBy(KEY, session_phase().alias("phase"), "token").agg(F.count(F.lit(1)).alias("n"))
    chosen = per_user.join(users.where(F.col("segment") == segment).select(KEY), KEY, "left_semi")
    counts = chosen.groupBy("phase", "token").agg(F.sum("n").alias("calls"))
    share = F.col("calls") * 100.0 / F.sum("calls").over(Window.partitionBy("phase"))
    counts = counts.withColumn("pct", share)
    leaders = counts.groupBy("token").agg(F.sum("calls").alias("total")).orderBy(F.desc("total"), "token").limit(top)
    return counts.join(F.broadcast(leaders.select("token")), "token").select("phase", F.col("token").alias("tool"), "calls", "pct")


def tool_sessions(calls: DataFrame, gap_min: float = 30) -> DataFrame:
    """Per (user, tool session): diversity, builds, runs, calls, finish flag, depth points, minutes."""
    token = F.col("token")
    runs = _number_segments(token_runs(calls, gap_min), gap_min)
    kinds = runs.groupBy(KEY, "session_num", "token").agg(F.sum("n").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))

    def calls_of(points: Column) -> Column:
        return F.sum(F.col("n") * points)

    return kinds.groupBy(KEY, "session_num").agg(
        calls_of(flag(token.isin("CREATE", "REFACTOR"))).alias("build_calls"), calls_of(flag(token == "RUN")).alias("run_calls"),
        F.sum("n").alias("total_calls"), F.max(flag(token == "FINISH")).alias("has_finish"), calls_of(depth_points("token")).alias("depth"),
        elapsed(F.max("end"), F.min("start"), 60).alias("duration_min"), F.count(F.lit(1)).alias("tool_diversity"),
    )


def session_progression(sessions: DataFrame, users: DataFrame, max_sessions: int = 10) -> DataFrame:
    """Mean session measures by running session number and segment."""
    labelled = sessions.where(F.col("session_num") <= max_sessions).join(users.select(KEY, "segment"), KEY)
    return labelled.groupBy("session_num", "segment").agg(
        F.avg(F.col("tool_diversity").cast("double")).alias("avg_diversity"),
        F.avg(F.col("build_calls").cast("double")).alias("avg_build"),
        F.avg(F.col("total_calls").cast("double")).alias("avg_total"),
        F.avg("duration_min").alias("avg_duration"),
        F.count(F.lit(1)).alias("n_sessions"),
    )


def depth_by_session(sessions: DataFrame, users: DataFrame, segment: str = BUILDER, max_sessions: int = 10) -> DataFrame:
    chosen = sessions.where(F.col("session_num") <= max_sessions).join(
        users.where(F.col("segment") == segment).select(KEY), KEY, "left_semi"
    )
    return chosen.groupBy("session_num").agg(F.avg(F.col("depth").cast("double")).alias("avg_depth"), F.count(F.lit(1)).alias("n"))


def user_paths(log: DataFrame, users: DataFrame | None = None, n: int = 5) -> DataFrame:
    """First n journey categories per user after merging equal neighbours."""
    steps = dedup_steps(log, event_category(), n)
    steps = steps.withColumn("path", F.concat_ws(GRAM_SEPARATOR, *[f"step_{i}" for i in range(1, n + 1)]))
    return steps if users is None else steps.join(users.select(KEY, "segment"), KEY, "left")


def _steps(paths: DataFrame, n: int) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"step_{i}").alias("event")) for i in range(1, n + 1)])
    return paths.select("segment", F.explode(entries).alias("s")).select("segment", "s.step", "s.event")


def path_step_mix(paths: DataFrame, n: int = 5, segments: Sequence[str] = (BUILDER, VIEWER, GHOST), top: int = 5, short_paths: str | None = None) -> DataFrame:
    """Most frequent categories at each step of a segment's paths, in percent of the paths that reach
    the step (or of all paths, when ``short_paths`` names the missing ones)."""
    rows = _steps(paths.where(F.col("segment").isin(*segments)), n)
    event = F.col("event") if short_paths is None else F.coalesce("event", F.lit(short_paths))
    rows = rows.withColumn("event", event).where(F.col("event").isNotNull())
    counts = rows.groupBy("segment", "step", "event").agg(F.count(F.lit(1)).alias("users"))
    group = Window.partitionBy("segment", "step")
    counts = counts.withColumn("pct", F.col("users") * 100.0 / F.sum("users").over(group))
    rank = F.row_number().over(group.orderBy(F.desc("users"), "event"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def _name(segment: str) -> str:
    return "pct_" + segment.lower().replace(" ", "_")


def branch_table(paths: DataFrame, segment_a: str = BUILDER, segment_b: str = GHOST, n: int = 5, min_users: int = 15) -> DataFrame:
    """For every common path prefix and next step: users, segment percentages and their gap."""
    prefixes = F.array(
        *[
            F.struct(
                F.lit(i).alias("prefix_len"),
                F.concat_ws(GRAM_SEPARATOR, *[F.col(f"step_{j}") for j in range(1, i + 1)]).alias("prefix"),
                F.col(f"step_{i + 1}").alias("next_event"),
            )
            for i in range(1, n)
        ]
    )
    rows = paths.select("segment", F.explode(prefixes).alias("p")).select("segment", "p.*").where(F.col("next_event").isNotNull())

    def pct(segment: str) -> Column:
        return F.avg(F.when(F.col("segment") == segment, 100.0).otherwise(0.0))

    out = rows.groupBy("prefix_len", "prefix", "next_event").agg(
        F.count(F.lit(1)).alias("users"), pct(segment_a).alias(_name(segment_a)), pct(segment_b).alias(_name(segment_b)),
        pct(BUILDER).alias("overall_pct_ab"),
    )
    size = F.sum("users").over(Window.partitionBy("prefix_len", "prefix"))
    out = out.withColumn("prefix_users", size).where(F.col("prefix_users") >= min_users).drop("prefix_users")
    return out.withColumn("branch_gap", F.col(_name(segment_a)) - F.col(_name(segment_b)))


def branch_comparison(paths: DataFrame, n: int = 5, min_users: int = 15, top: int | None = None) -> DataFrame:
    """Builder against ghost and against viewer branches, stacked; optionally the largest gaps only."""
    parts = []
    for other in (GHOST, VIEWER):
        table = branch_table(paths, BUILDER, other, n, min_users).withColumnRenamed(_name(other), "pct_other")
        parts.append(table.withColumn("comparison", F.lit(f"{BUILDER} vs {other}")))
    out = parts[0].unionByName(parts[1])
    if top is None:
        return out
    return out.orderBy(F.desc("branch_gap"), F.desc("users"), "comparison", "prefix", "next_event").limit(top)


def top_paths(paths: DataFrame, segments: Sequence[str] = (BUILDER, VIEWER, GHOST), k: int = 8) -> DataFrame:
    counts = paths.where(F.col("segment").isin(*segments)).groupBy("segment", "path").agg(F.count(F.lit(1)).alias("users"))
    rank = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("users"), "path"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)
