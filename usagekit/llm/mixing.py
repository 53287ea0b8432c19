"""Mixing sources to target weights by Sainte-Laguë apportionment, in native expressions.

The mix is cut into blocks of equal size (in words). Sources get blocks by highest quotients of their
targets (target / 1, / 3, / 5, ...), and inside a source its shards get the source's blocks by highest
quotients of their sizes: an integer quota per shard. A shard then lays its documents in seeded order,
reads them in a circle from a seeded block and takes as many blocks as its quota says; what exceeds one
round repeats the circle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagekit.llm.common import materialize, whole_row, word_count

SHARDS = 256


def source_key() -> Column:
    """"=" and the name, a missing source "~": the order is by code point, null last."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~"))


def hex_number(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Adds target to sources (_source, source_size): the share of all words by weight, weights repeating
    in the order of the sources; a target stops at ``cap`` times the source's size and the excess is
    reshared by weight until none is above.

    That end state is min(cap * size, level * weight) for one level. Sources fill up in the order of
    cap * size / weight, so the level is read off running sums: one row per source, no iteration.
    """
    rank = Window.orderBy("_source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("_weight", weight).withColumn("_cap", (F.col("source_size") * cap).cast("double"))
    fills = Window.orderBy(F.col("_cap") / F.col("_weight"), "_source")
    before, every = fills.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns({
        "_level": (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / (F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))),
        "_nth": F.row_number().over(fills),
    })
    open_ = F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.struct("_nth", "_level"))
    rows = rows.withColumn("_level", F.min(open_).over(every)["_level"])
    share = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap")))
    return rows.select("_source", "source_size", share.alias("target"))


def sainte_lague(parties: DataFrame, group: Sequence[str], key: str, votes: str, seats: str) -> DataFrame:
    """Adds quota to parties: the ``seats`` of each group by highest quotients votes / (2 k + 1), ties by key.

    A party's seats differ from votes * seats / all votes by little (with n parties the final divisor lies
    between those for seats - n/2 and seats + n/2), so only the quotients between the two bounds are
    ranked: about five per party, whatever the number of seats.
    """
    whole = Window.partitionBy(*group)
    v = F.col(votes).cast("double")
    rows = parties.withColumn("_all", F.sum(v).over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    share = lambda shift: F.when(F.col("_all") > 0, v * (F.col(seats) + shift * F.col("_n") / 2) / F.col("_all")).otherwise(0.0)
    rows = rows.withColumn("_low", F.greatest(F.lit(0), F.floor(share(-1) - 0.5)).cast("long"))
    rows = rows.withColumn("_high", F.greatest(F.col("_low"), F.floor(share(1) + 1.5)).cast("long"))
    rows = rows.withColumn("_left", F.col(seats) - F.sum("_low").over(whole))
    tried = rows.where((v > 0) & (F.col("_high") > F.col("_low"))).select(
        *group, key, "_left", v.alias("_votes"), F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k")
    )
    best = Window.partitionBy(*group).orderBy((F.col("_votes") / (2 * F.col("_k") + 1)).desc(), key, "_k")
    won = tried.withColumn("_rank", F.row_number().over(best)).where("_rank <= _left").groupBy(*group, key).agg(F.count(F.lit(1)).alias("_won"))
    quota = (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long").alias("quota")
    return rows.join(won, [*group, key], "left").select(*parties.columns, quota)


def _placed(docs: DataFrame, shards: int, seed: str, *kept: str) -> DataFrame:
    """doc_id, _source, _shard, size, and the order in a shard: _hash, then doc_id, size, _tie; and the columns ``kept``."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select(
        *kept, "doc_id", source_key().alias("_source"), (hex_number(digest, 1, 2) % shards).cast("int").alias("_shard"), F.substring(digest, 3, 14).alias("_hash"),
        word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie"),
    )


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3, block_words: int = 16, shards: int = SHARDS, seed: str = "mix",
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    size: words of the whole text (null: 0). Null is a source of its own, after all others; an empty name is
    another. taken counts the words of the row that lie in taken blocks, repeats included: never more than
    ``cap`` times its size. A source's taken words differ from its target by less than a block, plus what
    shards shorter than a block cannot fill. Order and starts come from MD5 of seed and doc_id, so reruns
    agree; of rows with equal doc_id and size either may be first, with the same set of results. A source
    that holds most rows is spread over ``shards`` (at most 256) windows.
    """
    return _taken(docs, weights, cap, block_words, shards, seed).drop("_source", "_shard", "_hash", "_tie")


def _taken(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3, block_words: int = 16, shards: int = SHARDS, seed: str = "mix",
) -> DataFrame:
    """The columns of mix_sources and the place of each row."""
    rows = materialize(_placed(docs, shards, seed), "sized")
    cells = materialize(rows.groupBy("_source", "_shard").agg(F.sum("size").alias("_words")), "shard-sizes")
    goal = targets(cells.groupBy("_source").agg(F.sum("_words").alias("source_size")), weights, cap)
    goal = goal.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"))
    goal = sainte_lague(goal, [], "_source", "target", "_seats").withColumnRenamed("quota", "_blocks")
    quotas = sainte_lague(cells.join(goal, "_source"), ["_source"], "_shard", "_words", "_blocks")
    begin = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "_source", "_shard")), 1, 7), 16, 10).cast("long")
    quotas = materialize(quotas.select(
        "_source", "_shard", "source_size", "target", "_words",
        F.when(F.col("_words") > 0, begin % F.ceil(F.col("_words") / block_words) * block_words).otherwise(0).cast("long").alias("_from"),
        F.least(F.col("quota") * block_words, F.col("_words") * cap).cast("long").alias("_take"),
    ), "quotas")
    laid = Window.partitionBy("_source", "_shard").orderBy("_hash", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum("size").over(laid), F.lit(0)).cast("long")).join(quotas, ["_source", "_shard"])

    def read(upto: Column) -> Column:
        """Words of this document among the first ``upto`` words of its shard's circle."""
        rest = F.greatest(F.lit(0).cast("long"), F.least(upto % F.col("_words") - F.col("_at"), F.col("size")))
        return F.floor(upto / F.col("_words")).cast("long") * F.col("size") + rest

    taken = F.when(F.col("_words") > 0, read(F.col("_from") + F.col("_take")) - read(F.col("_from"))).otherwise(0).cast("long")
    return rows.select("_source", "_shard", "_hash", "_tie", "doc_id", "size", "source_size", "target", taken.alias("taken"))


CUTS = 1 << 17  # rows of cuts that are broadcast at most


def _place() -> Column:
    return F.struct(F.col("_hash"), F.col("doc_id").cast("string").alias("id"), F.col("size"), F.col("_tie"))


def _cuts(mix: DataFrame) -> DataFrame:
    """One row per (source, shard): how often its documents are taken, as two places in its order and two documents.

    ``least``: rounds of all documents; ``more_from`` to ``more_to``: those taken once more, ``turned`` if that runs
    over the end of the order (then ``less_from`` to ``less_to`` are not); ``cut``: the documents in which the circle is
    entered and left, and their times.
    """
    mix = mix.withColumns({"_whole": F.expr("taken div size"), "_rest": F.col("taken") % F.col("size"), "_at": _place()})
    laid = Window.partitionBy("_source").orderBy((F.col("_rest") / F.col("size")).desc(), F.xxhash64("doc_id"), "doc_id", "size", "_tie")
    rests = mix.where("_rest > 0").withColumns({
        "_middle": F.sum("size").over(laid.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2,
        "_goal": F.sum("_rest").over(Window.partitionBy("_source")),
    })
    times = (F.col("_whole") + (F.col("_middle") <= F.col("_goal")).cast("long")).cast("int")
    cut = rests.groupBy("_source", "_shard").agg(F.collect_list(F.struct(F.col("_at").alias("at"), times.alias("times"))).alias("cut"))  # two at most
    even = mix.where("_rest = 0").withColumn("least", F.min("_whole").over(Window.partitionBy("_source", "_shard")))
    more = F.when(F.col("_whole") > F.col("least"), F.col("_at"))
    less = F.when(F.col("_whole") == F.col("least"), F.col("_at"))
    runs = even.groupBy("_source", "_shard").agg(
        F.max("least").cast("int").alias("least"), F.min(more).alias("more_from"), F.max(more).alias("more_to"), F.min(less).alias("less_from"), F.max(less).alias("less_to")
    )
    runs = runs.withColumn("turned", F.coalesce((F.col("more_from") < F.col("less_from")) & (F.col("less_to") < F.col("more_to")), F.lit(False)))
    return runs.join(cut, ["_source", "_shard"], "full")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as its taken words make it up.

    Whole rounds of a document count as they are. The rests of a source are settled together: its documents
    with a rest, the largest share of the document first, are taken whole until the next one's middle lies
    past the sum of all rests. So a source's words differ from its taken words by half a document at most.
    A shard's circle is entered and left in one document each: a window holds two rows per shard at most.
    Documents without a word are left out. Rows that agree in doc_id, source and text are repeated alike.

    No text moves: a document finds its times while it is read, from the cuts of its shard. The cuts (one row per source and
    shard) are counted, and broadcast up to CUTS rows; more are joined by a shuffle.
    """
    shards, seed = options.get("shards", SHARDS), options.get("seed", "mix")
    mix = materialize(_taken(docs, **options).where("size > 0"), "mix")
    cuts = materialize(_cuts(mix), "cuts")
    if cuts.count() <= CUTS:
        cuts = F.broadcast(cuts)
    inside = F.col("_at").between(F.col("more_from"), F.col("more_to"))
    apart = F.col("_at").between(F.col("less_from"), F.col("less_to"))
    once_more = F.coalesce(F.when(F.col("turned"), ~apart).otherwise(inside), F.lit(False)).cast("int")
    own = F.filter("cut", lambda c: c["at"] == F.col("_at"))
    times = F.coalesce(F.get(F.col("_own"), F.lit(0))["times"], F.col("least") + once_more)
    placed = docs.select(whole_row(docs), F.struct(*[F.col(c) for c in ("doc_id", "source", "text")]).alias("_doc"))
    placed = placed.select("_row", "_doc.*")
    keyed = _placed(placed, shards, seed, "_row").where("size > 0").withColumn("_at", _place())
    out = keyed.join(cuts, ["_source", "_shard"]).withColumn("_own", own).withColumn("_times", times).where("_times > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce('=' || source, '~') AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), laid AS (
  SELECT *, ('0x' || h[1:2])::INT AS shard, h[3:16] AS ord FROM sized
), srcs AS (
  SELECT src, sum(size)::BIGINT AS n, [1, 2, 3][(row_number() OVER (ORDER BY src) - 1) % 3 + 1]::DOUBLE AS w FROM laid GROUP BY src
), shares(turn, src, n, w, t, full_) AS (
  SELECT 0, src, n, w, sum(n) OVER () * w / sum(w) OVER (), false FROM srcs
  UNION ALL
  SELECT turn + 1, src, n, w,
         CASE WHEN full_ OR t > 3 * n THEN 3.0 * n
              ELSE w * (sum(n) OVER () - sum(CASE WHEN full_ OR t > 3 * n THEN 3.0 * n ELSE 0 END) OVER ())
                   / sum(CASE WHEN full_ OR t > 3 * n THEN 0 ELSE w END) OVER () END,
         full_ OR t > 3 * n
  FROM shares WHERE turn < 30
), goal AS (
  SELECT src, n, t AS target, round(sum(t) OVER () / 16)::BIGINT AS seats FROM shares WHERE turn = 30
), src_quota AS (
  SELECT src, count(*) AS blocks FROM (
    SELECT src, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, src, k) AS r, seats
    FROM goal, unnest(generate_series(0, (target / 16)::BIGINT + 20)) AS u(k) WHERE target > 0)
  WHERE r <= seats GROUP BY src
), shard_n AS (
  SELECT src, shard, sum(size)::BIGINT AS words FROM laid GROUP BY ALL
), shard_quota AS (
  SELECT src, shard, count(*) AS quota FROM (
    SELECT src, shard, blocks, row_number() OVER (PARTITION BY src ORDER BY words::DOUBLE / (2 * k + 1) DESC, shard, k) AS r
    FROM shard_n JOIN goal USING (src) JOIN src_quota USING (src), unnest(generate_series(0, (words * target / n / 16)::BIGINT + 20)) AS u(k)
    WHERE words > 0)
  WHERE r <= blocks GROUP BY ALL
), plan AS (
  SELECT src, shard, words, n, target, least(coalesce(quota, 0) * 16, 3 * words) AS take,
         CASE WHEN words > 0 THEN ('0x' || md5('mix:' || src || ':' || shard)[1:7])::BIGINT % ((words + 15) // 16) * 16 ELSE 0 END AS start
  FROM shard_n JOIN goal USING (src) LEFT JOIN shard_quota USING (src, shard)
), placed AS (
  SELECT laid.*, words, n, target, start, start + take AS stop,
         coalesce(sum(size) OVER (PARTITION BY src, shard ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM laid JOIN plan USING (src, shard)
)
SELECT doc_id, size, n AS source_size, target,
       CASE WHEN words > 0 THEN (stop // words * size + greatest(0, least(stop % words - pos, size)))
         - (start // words * size + greatest(0, least(start % words - pos, size))) ELSE 0 END::BIGINT AS taken
FROM placed
"""
