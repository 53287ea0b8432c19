"""LM scoring by subword lattices: the probability of a document over all its segmentations.

A document is its words and an end. Pieces are drawn independently, each with the probability the model gives it,
until the end is drawn; a word's probability is the sum over all ways to put it together from pieces (forward
recursion in log space), a document's the product of its words' and the end's. Weights start from the scores of the
existing vocabulary and are trained by expectation maximisation: each round distributes the training words over
their segmentations and counts the pieces. Words are counted once for the whole corpus, and each round reads
distinct words, not texts.

Documents are scored where they are read. The most frequent words (at most HEAVY, a table of bounded size) are known
to every task; the counts of all others come by a join in which no word has more than a HEAVY-th of all tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagekit.llm.common import materialize
from usagekit.llm.packing import stretches
from usagekit.llm.subwords import Lattice, rank_weights, vocabulary

HEAVY, ROUNDS, SMOOTHING = 1 << 18, 3, 0.1
STEPS = 8  # classes of counts per power of two
SIZE = 32 << 20  # bytes of text a task cuts into words at once
ROWS = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lattice double, tail array<struct<word:string,n:long>>"


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether CRC-32 of the decimal doc_id (missing: of nothing) leaves ``fold`` modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts one after the other, A-Z lower-cased, and the text of each."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, owner = pc.list_flatten(cut), pc.list_parent_indices(cut)
    some = pc.not_equal(words, "")
    return words.filter(some).dictionary_encode(), owner.filter(some).to_numpy().astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """word, train, n: tokens in training documents and in all. The empty word is the end of each document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in stretches(batch.column(0), SIZE):
                part = batch.slice(begin, end - begin)
                train = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                words, owner = words_of(part.column(0))
                size = len(words.dictionary)
                all_, trained = (np.bincount(words.indices.to_numpy()[x], minlength=size) for x in (slice(None), train[owner]))
                names = pa.concat_arrays([words.dictionary, pa.array([""], words.dictionary.type)])
                columns = [names, pa.array(np.append(trained, train.sum())), pa.array(np.append(all_, len(train)))]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "train", "n"])

    rows = docs.select(F.col("text").cast("string"), (~held_out(F.col("doc_id"))).alias("train"))
    return rows.mapInArrow(count, "word string, train long, n long").groupBy("word").agg(F.sum("train").alias("train"), F.sum("n").alias("n"))


class Model:
    """Log probabilities of the pieces and of the end, and the totals of the training tokens."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray, end: float, tokens: int, distinct: int):
        self.pieces, self.logs, self.end, self.tokens, self.distinct = pieces, logs, end, tokens, distinct

    @property
    def floor(self) -> float:
        """What a word's count plus one is divided by in the base score."""
        return float(self.tokens + self.distinct + 1)


def train(counts: DataFrame, path: str | None = None, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> Model:
    """The model after ``rounds`` of expectation maximisation over the training words of ``counts``.

    A task sums its words into one row per piece; the driver receives one number per piece of the vocabulary. Sums are
    rounded to 2^-20 before they are added, so that their order does not matter.
    """
    pieces, scores = vocabulary(path)
    logs = rank_weights(scores)
    words = counts.where("word <> '' AND train > 0").select(F.col("word").cast("binary"), "train")
    total = counts.agg(
        F.coalesce(F.sum("train"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("train") > 0, 1)).alias("distinct"),
        F.coalesce(F.sum(F.when(F.col("word") == "", F.col("train"))), F.lit(0)).alias("ends"),
    ).first()
    end = 0.0
    for _ in range(rounds):
        known = logs

        def expect(batches: Iterator[pa.RecordBatch], known: np.ndarray = known) -> Iterator[pa.RecordBatch]:
            lattice, sums = Lattice(pieces), np.zeros(len(pieces))
            for batch in batches:
                sums += lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy(), known)
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.rint(sums[some] * (1 << 20)).astype(np.int64))], names=["piece", "n"])

        found = words.mapInArrow(expect, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        sums = np.full(len(pieces), smoothing)
        sums[found["piece"].to_numpy()] += found["n"].to_numpy() / (1 << 20)
        every = sums.sum() + total["ends"] + smoothing
        logs, end = np.log(sums / every), math.log((total["ends"] + smoothing) / every)
    return Model(pieces, logs, end, int(total["tokens"]), int(total["distinct"]))


def frequent(counts: DataFrame, most: int) -> tuple[DataFrame, Column]:
    """The most frequent words, ``most`` of them at most, and the condition that tells them.

    Counts fall into classes of equal logarithm, a few hundred whatever the corpus; whole classes are taken.
    """
    class_ = F.floor(F.log2("n") * STEPS).cast("int")
    taken, least = 0, None
    for r in counts.groupBy(class_.alias("class")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("class")).collect():
        if (taken := taken + r["words"]) > most:
            break
        least = r["class"]
    heavy = class_ >= least if least is not None else F.lit(False)
    return counts.where(heavy), heavy


def score_documents(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS, most: int = HEAVY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for every row of ``docs`` (doc_id, text).

    score: log10 of the probability the trained lattices give the whole text, its end included. base_score: add-one
    unigram of whole words. Null and empty texts are an end alone. Rows without doc_id count by the CRC-32 of nothing
    (0: training). Repeated rows are counted and scored each. An empty table gives none.
    """
    spark = docs.sparkSession
    counts = materialize(count_words(docs), "word-counts")
    model = train(counts, path, rounds)
    heavy, known = frequent(counts, most)
    pieces, logs, end, floor = model.pieces, model.logs, model.end, model.floor

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces)
        for batch in batches:
            weights = lattice.scores(batch.column(0).cast(pa.binary()).to_pylist(), logs)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights)], names=["word", "train", "lattice"])

    # at most ``most`` rows, whatever the corpus
    heavy = heavy.select("word", "train").mapInArrow(weigh, "word string, train long, lattice double").toArrow()
    table = spark.sparkContext.broadcast((heavy["word"].to_pylist(), heavy["train"].to_numpy(), heavy["lattice"].to_numpy()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, train_, lattice_ = table.value
        place = {w: i for i, w in enumerate(names)}
        base_, known_ = np.log10((np.append(train_, 0) + 1) / floor), np.append(train_ > 0, False)
        ends = place.get("", -1)
        lattice = Lattice(pieces)
        for batch in batches:
            for begin, stop in stretches(batch.column(2), SIZE):
                part = batch.slice(begin, stop - begin)
                n = part.num_rows
                words, owner = words_of(part.column(2))
                distinct, at = words.dictionary.to_pylist(), words.indices.to_numpy()
                number = np.fromiter((place.get(w, -1) for w in distinct), np.int64, len(distinct))
                rare = np.flatnonzero(number < 0)
                weight = np.append(lattice_, 0.0)[number]
                weight[rare] = lattice.scores([distinct[i].encode() for i in rare.tolist()], logs)
                # a rare word's count comes later: here it adds nothing
                base = np.where(number < 0, 0.0, base_[number])
                sums = lambda x: np.bincount(owner, x[at], minlength=n).astype(np.float64)
                tokens = np.bincount(owner, minlength=n) + 1
                out_known, out_base = sums(known_[number].astype(np.float64)).astype(np.int64), sums(base)
                if ends >= 0:
                    out_known, out_base = out_known + bool(known_[ends]), out_base + base_[ends]
                later = np.flatnonzero(number[at] < 0)
                pairs, times = np.unique(owner[later] * max(1, len(distinct)) + at[later], return_counts=True)
                counts_ = np.bincount(pairs // max(1, len(distinct)), minlength=n)
                offsets, which = np.concatenate([[0], np.cumsum(counts_)]), pairs % max(1, len(distinct))
                if ends < 0:  # the end is an ordinary word of the join
                    offsets = offsets + np.arange(n + 1)
                    spots = offsets[1:] - 1
                    entries = np.full(offsets[-1], len(distinct))
                    keep = np.ones(offsets[-1], bool)
                    keep[spots] = False
                    entries[keep], full = which, np.ones(offsets[-1], np.int64)
                    full[keep] = times
                    which, times = entries, full
                texts = pa.concat_arrays([words.dictionary, pa.array([""], words.dictionary.type)]).take(pa.array(which, pa.int64()))
                tail = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([texts, pa.array(times, pa.int64())], ["word", "n"]))
                columns = [*part.columns[:2], part.column(3), pa.array(tokens, pa.int64()), pa.array(out_known, pa.int64()), pa.array(out_base), pa.array(sums(weight)), tail]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "lattice", "tail"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out"))
    rows = materialize(rows.mapInArrow(score, ROWS), "scored")  # written once, so the uid of a row stays
    tail = rows.select("uid", F.explode("tail").alias("t")).select("uid", "t.word", "t.n")
    late = tail.join(counts.where(~known).select("word", "train"), "word").groupBy("uid").agg(
        F.sum(F.col("n") * F.log10((F.col("train") + 1) / floor)).alias("more_base"), F.sum(F.when(F.col("train") > 0, F.col("n")).otherwise(0)).alias("more_known")
    )
    rows = rows.drop("tail").join(late, "uid", "left")
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        ((F.col("lattice") + end) / math.log(10)).alias("score"),
    )
