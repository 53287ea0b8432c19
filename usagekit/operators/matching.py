"""Nearest-neighbour matching on a propensity score, without replacement, inside a caliper.

The wanted result is the sequential one: treated users in a fixed order each take the nearest control
that is still free (the lower score on equal distance, the lower id on equal scores). Run as deferred
acceptance it needs no sequence: a treated user proposes to the nearest control that may accept it, a
control keeps the earliest proposer, the displaced one goes on. With one common order of the treated
users the stable result is unique and equals the sequential one, in whatever order proposals are made.

So the score line is cut into blocks of controls, and each block runs the proposals of the users that
look at it to completion, in one pass. A user carries the nearest place on either side that may still
accept it. Only when the nearer one lies in another block the user moves there, with the next round; a
round reads the blocks that somebody moved to and no others. A block takes the earliest users that
wait for it, a bounded number, and users pass a block whose holders are all earlier than they are
without entering it: many users on one score never meet in one task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagekit.operators.segments import BUILDER
from usagekit.session import drop_table, materialize

KEY = "person_id"
CELLS = 64


def with_cell(df: DataFrame, *order: str) -> DataFrame:
    """The table written with a cell number that follows ``order``, cells of about equal size.

    The range partitions are the cells. An order that ends in a unique column splits ties, so a score
    that most users share is spread over many cells.
    """
    return materialize(df.repartitionByRange(CELLS, *order).withColumn("cell", F.spark_partition_id()), "cells")


def _turns(rows: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Adds turn: 1, 2, … by ``ord`` inside a group. Users of a group are numbered inside their cell, after
    the users of the group in the cells before: at most CELLS counts per group, and no window holds a long queue."""
    counts = rows.groupBy(*group, "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy(*group, "cell").orderBy("ord"))
    return rows.withColumn("turn", inside).join(counts, [*group, "cell"]).withColumn("turn", F.col("turn") + F.col("earlier")).drop("earlier")


def _running(df: DataFrame, amount: str, order: list[Column | str], alias: str) -> DataFrame:
    """Running total of ``amount`` over the whole table in an order led by the cell: a window inside
    each cell plus the total of the cells before it."""
    before = Window.partitionBy(F.lit(1)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("cell").agg(F.sum(amount).alias("cell_total"))
    offsets = totals.select("cell", F.coalesce(F.sum("cell_total").over(before), F.lit(0)).alias("offset"))
    inside = F.sum(amount).over(Window.partitionBy("cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # one row per cell, at most CELLS of them
    return df.withColumn("inside", inside).join(F.broadcast(offsets), "cell").withColumn(alias, F.col("offset") + F.col("inside")).drop("inside", "offset")


def rank_users(users: DataFrame, score: str, treated: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Controls with their place (1, 2, …) by score and id; treated users with the places left and right of their score."""
    rows = users.where(F.col(score).isNotNull()).select(
        F.col(KEY).alias("id"), F.col(score).cast("double").alias("ps"), F.col(order).alias("ord"), (1 - F.col(treated)).cast("long").alias("is_control")
    )
    placed = _running(with_cell(rows, "ps", "is_control", "id"), "is_control", ["ps", "is_control", "id"], "place")
    placed = materialize(placed.select("id", "ps", "ord", "is_control", "place"), "places")
    controls = placed.where(F.col("is_control") == 1).select("place", F.col("id").alias("control_id"), F.col("ps").alias("control_ps"))
    free = placed.where(F.col("is_control") == 0).select("id", "ps", "ord", F.col("place").alias("left"))
    free = with_cell(free, "ord", "id").withColumn("one", F.lit(1).cast("long"))
    return controls, _running(free, "one", ["ord", "id"], "turn").drop("one", "ord")


BLOCK, WAITING = 1 << 16, 4  # controls of a block; users it takes in a round, as a multiple of that
TOKEN = "turn long, ps double, left long, right long, left_ps double, right_ps double, place long"
FREE = math.inf


class Places:
    """The controls of one block with their holders, and the nearest one on a side that a user can have."""

    def __init__(self, scores: np.ndarray):
        self.scores, self.n = scores.tolist(), len(scores)
        self.size = 1 << max(1, (self.n - 1).bit_length())
        # Latest holder below each node; places beyond the block are held by the first user of all.
        self.latest = [-1.0] * (2 * self.size)
        for i in range(self.n):
            self.latest[self.size + i] = FREE
        for i in range(self.size - 1, 0, -1):
            self.latest[i] = max(self.latest[2 * i], self.latest[2 * i + 1])

    def holder(self, at: int) -> float:
        return self.latest[self.size + at]

    def give(self, at: int, turn: float) -> None:
        i = self.size + at
        self.latest[i] = turn
        while i > 1:
            i //= 2
            best = max(self.latest[2 * i], self.latest[2 * i + 1])
            if self.latest[i] == best:
                return
            self.latest[i] = best

    def nearest(self, at: int, turn: float, left: bool) -> int | None:
        """The first place from ``at`` on that is free or held by a later user."""
        i, latest = self.size + at, self.latest
        while latest[i] <= turn:
            # up until a neighbour on the wanted side has one
            while i > 1 and (i % 2 == 0 if left else i % 2 == 1):
                i //= 2
            if i <= 1:
                return None
            i += -1 if left else 1
        while i < self.size:
            first = 2 * i + (1 if left else 0)
            i = first if latest[first] > turn else first ^ 1
        return i - self.size


def settle(block: pd.DataFrame, caliper: float) -> pd.DataFrame:
    """All proposals among the controls of one block (rows without turn) and the users that hold or look at them.

    Users that have to look into another block next come back with their frontier moved and no place, users without a
    control left in the caliper as well, with neither side in reach.
    """
    controls = block[block["turn"].isna()].sort_values("place")
    users = block[block["turn"].notna()]
    first, places = int(controls["place"].iloc[0]), Places(controls["ps"].to_numpy())
    before, after = float(controls["left_ps"].iloc[0]), float(controls["right_ps"].iloc[0])
    state = {
        int(r.turn): [float(r.ps), int(r.left), int(r.right), float(r.left_ps), float(r.right_ps), None if math.isnan(r.place) else int(r.place) - first]
        for r in users.itertuples()
    }
    for turn, user in state.items():
        if user[5] is not None:
            places.give(user[5], turn)
    waiting = [turn for turn, user in state.items() if user[5] is None]
    heapq.heapify(waiting)
    while waiting:
        turn = heapq.heappop(waiting)
        user = state[turn]
        ps = user[0]
        for side, edge, beyond in ((1, -1, before), (2, places.n, after)):
            at = user[side] - first
            if 0 <= at < places.n:
                found = places.nearest(at, turn, side == 1)
                user[side] = first + (edge if found is None else found)
                user[side + 2] = beyond if found is None else places.scores[found]
        to_left, to_right = ps - user[3], user[4] - ps  # NaN where the line ends
        left, right = to_left <= caliper, to_right <= caliper
        if not left and not right:
            user[3] = user[4] = math.nan
            continue
        side = 1 if left and not (right and to_right < to_left) else 2
        at = user[side] - first
        if 0 <= at < places.n:
            displaced = places.holder(at)
            places.give(at, turn)
            user[5] = at
            if displaced != FREE:
                state[int(displaced)][5] = None
                heapq.heappush(waiting, int(displaced))
    rows = [(turn, *user[:5], math.nan if user[5] is None else user[5] + first) for turn, user in state.items()]
    out = pd.DataFrame(rows, columns=["turn", "ps", "left", "right", "left_ps", "right_ps", "place"])
    return out.astype({"turn": "int64", "left": "int64", "right": "int64", "place": "Int64"})


def _settler(caliper: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda block: settle(block, caliper)


def _line(controls: DataFrame, size: int) -> DataFrame:
    """Controls as rows of their blocks: block, place, ps, and as left_ps and right_ps the scores just beyond the block."""
    rows = controls.select(F.floor((F.col("place") - 1) / size).alias("block"), "place", F.col("control_ps").alias("ps"))
    ends = rows.groupBy("block").agg(F.min("ps").alias("low"), F.max("ps").alias("high"))
    below = ends.select((F.col("block") + 1).alias("block"), F.col("high").alias("left_ps"))
    above = ends.select((F.col("block") - 1).alias("block"), F.col("low").alias("right_ps"))
    around = ends.select("block").join(below, "block", "left").join(above, "block", "left")
    return rows.join(around, "block")


def _look(users: DataFrame, size: int, caliper: float) -> DataFrame:
    """Adds goes_left and the block a waiting user looks at next; users with nothing in reach are left out."""
    gap = lambda x: F.when(~F.isnan(x) & (x <= caliper), x)
    rows = users.withColumns({"to_left": gap(F.col("ps") - F.col("left_ps")), "to_right": gap(F.col("right_ps") - F.col("ps"))})
    rows = rows.where("to_left IS NOT NULL OR to_right IS NOT NULL")
    rows = rows.withColumn("goes_left", F.col("to_left").isNotNull() & (F.col("to_right").isNull() | (F.col("to_left") <= F.col("to_right"))))
    at = F.when(F.col("goes_left"), F.col("left")).otherwise(F.col("right"))
    return rows.withColumn("block", F.floor((at - 1) / size)).drop("to_left", "to_right")


def _pass_full(users: DataFrame, full: DataFrame, size: int) -> DataFrame:
    """Users that look at a block of earlier holders only go on to the place beyond it."""
    rows = users.join(full, "block", "left")
    over = F.col("latest").isNotNull() & (F.col("latest") < F.col("turn"))
    left, right = over & F.col("goes_left"), over & ~F.col("goes_left")
    return rows.withColumns({
        "left": F.when(left, F.col("block") * size).otherwise(F.col("left")), "left_ps": F.when(left, F.col("before")).otherwise(F.col("left_ps")),
        "right": F.when(right, (F.col("block") + 1) * size + 1).otherwise(F.col("right")), "right_ps": F.when(right, F.col("after")).otherwise(F.col("right_ps")),
    }).drop("latest", "before", "after", "goes_left", "block")


def propensity_match(
    users: DataFrame, score: str = "propensity_score", treated: str = "ever_used_agent", order: str = KEY,
    caliper: float = 0.05, block: int | None = None,
) -> DataFrame:
    """Pairs (treated_id, control_id, score_gap) equal to the sequential greedy matching in ``order``.

    Every round's state is a written table, so a lost executor costs one round at most. The number of rounds is that of
    the moves of a user between blocks; what lies inside one block takes one.
    """
    size = block or BLOCK
    controls, ranked = rank_users(users, score, treated, order)
    line = materialize(_line(controls, size), "line")
    sizes = line.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("left_ps").alias("before"), F.max("right_ps").alias("after"))
    sizes = materialize(sizes, "line-blocks")
    last = controls.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]
    ranked = materialize(ranked, "ranked")
    # Where a frontier stands next to the user itself its own score is as good a bound as that of the place.
    bound = lambda there: F.when(there, F.col("ps"))
    state = ranked.select(
        "turn", "ps", "left", (F.col("left") + 1).alias("right"), bound(F.col("left") > 0).alias("left_ps"),
        bound(F.col("left") < last).alias("right_ps"), F.lit(None).cast("long").alias("place"),
    )
    state = materialize(state, "match")
    while True:
        held, looking = state.where("place IS NOT NULL"), state.where("place IS NULL")
        by_block = held.groupBy(F.floor((F.col("place") - 1) / size).alias("block")).agg(F.count(F.lit(1)).alias("taken"), F.max("turn").alias("latest"))
        full = by_block.join(sizes, "block").where("taken = n").select("block", "latest", "before", "after")
        looking = _look(_pass_full(_look(looking, size, caliper), full, size), size, caliper)
        # Spark keeps the earliest of each block before the shuffle
        nth = F.row_number().over(Window.partitionBy("block").orderBy("turn"))
        asking = materialize(looking.withColumn("nth", nth).where(F.col("nth") <= WAITING * size).drop("nth", "goes_left"), "asking")
        if asking.isEmpty():
            break
        blocks = asking.select("block").distinct()
        names = ["turn", "ps", "left", "right", "left_ps", "right_ps", "place"]
        there = held.withColumn("block", F.floor((F.col("place") - 1) / size))
        whole = line.select("block", F.lit(None).cast("long").alias("turn"), "ps", *[F.lit(0).cast("long").alias(c) for c in ("left", "right")], "left_ps", "right_ps", "place")
        rows = whole.unionByName(there).join(blocks, "block", "left_semi").unionByName(asking)
        settled = rows.groupBy("block").applyInPandas(_settler(caliper), TOKEN)
        waits = looking.join(asking.select("turn"), "turn", "left_anti").select(names)
        rest = there.join(blocks, "block", "left_anti").select(names)
        before, state = state, materialize(settled.unionByName(rest).unionByName(waits), "match")
        drop_table(before)
    taken = state.where("place IS NOT NULL").select("turn", "place").join(ranked, "turn").select("id", "ps", F.col("turn").alias("ord"), "cell", "place")
    return _pairs(taken, controls)


def _pairs(taken: DataFrame, controls: DataFrame) -> DataFrame:
    """Controls of equal score are interchangeable until the end: the earlier treated user gets the lower id."""
    taken = taken.join(controls, "place")
    takers = _turns(taken.drop("place", "control_id"), ("control_ps",)).withColumnRenamed("id", "treated_id")
    # controls of one score lie next to each other in the ranking: the n-th of them is n - 1 places after the first
    first = controls.groupBy("control_ps").agg(F.min("place").alias("first_place"))
    takers = takers.join(first, "control_ps").withColumn("place", F.col("first_place") + F.col("turn") - 1)
    return takers.select("treated_id", "ps", "place").join(controls, "place").select("treated_id", "control_id", F.abs(F.col("ps") - F.col("control_ps")).alias("score_gap"))


def _outcomes() -> dict[str, Column]:
    return {
        "Agent Builder %": F.when(F.col("segment") == BUILDER, 100.0).otherwise(0.0),
        "Active days": F.col("days_active").cast("double"),
        "Returned %": F.when(F.col("had_second_session") == 1, 100.0).otherwise(0.0),
        "Propensity score": F.col("propensity_score"),
    }


def att(pairs: DataFrame, users: DataFrame, min_pairs: int = 10) -> DataFrame:
    """Mean outcome of treated and matched control users and the difference, per outcome; empty
    unless there are more than ``min_pairs`` pairs."""
    ids = pairs.select(F.explode(F.array(
        F.struct(F.col("treated_id").alias(KEY), F.lit(1).alias("treated")), F.struct(F.col("control_id").alias(KEY), F.lit(0).alias("treated"))
    )).alias("u")).select("u.*")
    outcomes = _outcomes()
    rows = ids.join(users.select(KEY, *[c.alias(n) for n, c in outcomes.items()]), KEY)
    long = rows.unpivot(["treated"], list(outcomes), "outcome", "value")
    out = long.groupBy("outcome").agg(
        F.count_if(F.col("treated") == 1).alias("pairs"),
        F.avg(F.when(F.col("treated") == 1, F.col("value"))).alias("treated_mean"),
        F.avg(F.when(F.col("treated") == 0, F.col("value"))).alias("control_mean"),
    )
    return out.where(F.col("pairs") > min_pairs).withColumn("difference", F.col("treated_mean") - F.col("control_mean"))


def _poisson(unit: Column) -> Column:
    """A Poisson count of mean 1 from a number between 0 and 1; counts above 8 have a chance of 10^-6."""
    steps, chance, below = [], math.exp(-1), 0.0
    for k in range(9):
        below += chance
        chance /= k + 1
        steps.append((unit > below).cast("long"))
    return sum(steps[1:], steps[0])


def effect_with_intervals(pairs: DataFrame, users: DataFrame, min_pairs: int = 10, replicates: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """The effect (``att``) with a paired bootstrap interval, low to high, of each outcome's difference.

    A replicate weighs every pair by a Poisson count of its hash, so nothing is drawn or gathered: the replicates are
    sums per task, and what is ranked in the end is one row per outcome and replicate.
    """
    measures = _outcomes()
    side = lambda name: users.select(F.col(KEY).alias(f"{name}_id"), *[c.alias(f"{name} {n}") for n, c in measures.items()])
    both = pairs.select("treated_id", "control_id").join(side("treated"), "treated_id").join(side("control"), "control_id")
    hashed = F.xxhash64(F.lit(seed), "replicate", F.col("treated_id").cast("string"), F.col("control_id").cast("string"))
    drawn = both.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = drawn.withColumn("times", _poisson(F.pmod(hashed, F.lit(1 << 53)) / float(1 << 53)))
    gaps = [F.struct(F.lit(n).alias("outcome"), (F.col(f"treated {n}") - F.col(f"control {n}")).alias("gap")) for n in measures]
    sums = drawn.select("replicate", "times", F.explode(F.array(*gaps)).alias("g")).groupBy("replicate", "g.outcome").agg(
        (F.sum(F.col("times") * F.col("g.gap")) / F.nullif(F.sum("times"), F.lit(0))).alias("difference")
    )
    tail = (1 - level) / 2
    spread = sums.groupBy("outcome").agg(F.percentile("difference", F.lit(tail)).alias("low"), F.percentile("difference", F.lit(1 - tail)).alias("high"))
    return att(pairs, users, min_pairs).join(spread, "outcome", "left")
