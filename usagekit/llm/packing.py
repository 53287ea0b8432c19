"""Harmonic packing of token sequences.

Lengths fall into classes of reciprocal capacity: a piece of class k is floor(capacity / k) tokens long,
and k of them fill a sequence. Documents may be cut, so each is cut into pieces of such lengths, the
largest first (a long document gives whole sequences, then at most a few pieces), until a rest of at
most capacity / classes is left. A class fills its sequences with a fixed number of pieces: the place of
a piece follows from its number in the class, and workers number their pieces independently, needing of
each other only the counts per class. Rests are placed by their running length; the pieces that do not
fill the last sequence of their class (at most k - 1 per class, a constant number) are packed first-fit.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagekit.llm.common import materialize, running_start, small_batches

CAPACITY, CLASSES, CELLS = 2048, 32, 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int"
LEFT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin long, offset long"
MEMORY = 48 << 20  # bytes of words and ids a task remembers, entries of its dictionary included; it forgets all when full
NEW = 16_384  # words that are encoded at once: the tokenizer holds some hundred bytes for each of their tokens
ENTRY = 200  # bytes of an entry besides the characters of its word and its ids


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of texts, exactly those of the tokenizer; words are encoded once and remembered.

    No token of this vocabulary crosses ASCII white space, and none a letter that a stop or comma follows;
    its texts are lower-cased. So texts are lower-cased and cut there by Arrow, and only words that are new
    reach the tokenizer. A text that may hold the name of a special token is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        # Words of letters only are one piece for the tokenizer: white space is all that has to be split.
        self.plain = Tokenizer.from_str(self.whole.to_str())
        self.plain.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
        self.ends_word = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends_word[[i for token, i in self.whole.get_vocab().items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.sizes, self.starts, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.used = self.held = 0

    @staticmethod
    def _append(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        if used + len(more) > len(held):
            held = np.concatenate([held[:used], np.zeros(max(len(held), len(more)), held.dtype)])
        held[used : used + len(more)] = more
        return held

    def _add(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        known = len(self.index)
        self.starts = self._append(self.starts, known, self.used + np.cumsum(sizes) - sizes)
        self.sizes = self._append(self.sizes, known, sizes)
        self.ids = self._append(self.ids, self.used, flat)
        self.used += len(flat)
        self.held += sum(map(len, words)) + 4 * len(flat) + ENTRY * len(words)
        self.index.update(zip(words, range(known, known + len(words)), strict=True))

    def learn(self, words: list[str]) -> None:
        """Encodes new words, NEW at once: those of letters in one text, cut where a token ends a word; others one by one."""
        for at in range(0, len(words), NEW):
            part = words[at : at + NEW]
            letters = [w for w in part if w.isalpha() and (w.isascii() or unicodedata.normalize("NFC", w).lower().isalpha())]
            if letters:
                flat = np.array(self.plain.encode_batch_fast(["\n".join(letters)], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(self.ends_word[flat])
                self._add(letters, flat, np.diff(ends, prepend=-1))
            if others := list(set(part).difference(letters)):
                found = [x.ids for x in self.whole.encode_batch_fast(others, add_special_tokens=False)]
                self._add(others, np.array([i for x in found for i in x], np.uint32), np.array(list(map(len, found)), np.int64))

    def _places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, one after the other, and how many each text has."""
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), "([a-z])([.,;:!?])", r"\1 \2"))
        coded = pc.list_flatten(cut).dictionary_encode()
        words = coded.dictionary.to_pylist()
        fresh = [w for w in words if w not in self.index]
        if self.held > MEMORY:  # what one stretch of texts adds is bounded by its bytes
            self.clear()
            fresh = [w for w in words if w]
        if fresh:
            self.learn(fresh)
        table = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return table[coded.indices.to_numpy()], pc.list_value_length(cut).to_numpy().astype(np.int64)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null text has none."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|")
        at, words = self._places(pc.if_else(special, "", texts))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        out = np.split(ids, np.concatenate([[0], ends])[np.cumsum(words)][:-1])
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


def stretches(texts: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of texts of about ``size`` bytes, one text at least."""
    begin, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if held and held + n > size:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordIds:
    return WordIds(path)


def cut_lengths(tokens: int, capacity: int, classes: int) -> Iterator[tuple[int, int]]:
    """(length, class) of the pieces of a document, in order; the rest has class ``classes`` + 1."""
    while tokens > capacity // classes:
        k = -(-capacity // tokens) if tokens < capacity else 1
        while capacity // k > tokens:
            k += 1
        yield capacity // k, k
        tokens -= capacity // k
    if tokens:
        yield tokens, classes + 1


def pieces(docs: DataFrame, capacity: int, classes: int, end_id: int, path: str | None) -> DataFrame:
    """The pieces of every document: PIECES. A null text is empty and has the end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path or vocabulary_path())
        for batch in batches:
            out: list[tuple] = []
            doc_ids = batch.column(0).to_pylist()
            for a, b in stretches(batch.column(1)):
                for doc_id, ids in zip(doc_ids[a:b], words.encode(batch.column(1).slice(a, b - a)), strict=True):
                    ids, start = np.append(ids, np.uint32(end_id)).astype("<u4"), 0
                    for length, k in cut_lengths(len(ids), capacity, classes):
                        out.append((doc_id, start, length, zlib.crc32(ids[start : start + length].data), len(ids), k))
                        start += length
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.int32()], strict=True)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"],
            )
        words.clear()  # the worker goes on to other tasks, which need its memory
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def first_fit(capacity: int):
    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="_left").sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], na_position="last")
        room: list[int] = []
        bins, offsets = [], []
        for length in rows["length"]:
            at = next((i for i, r in enumerate(room) if r >= length), len(room))
            if at == len(room):
                room.append(capacity)
            bins.append(at)
            offsets.append(capacity - room[at])
            room[at] -= length
        return rows.assign(bin=np.array(bins, "int64"), offset=np.array(offsets, "int64"))

    return place


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, end_id: int = 1, cells: int = CELLS, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of ``docs`` (doc_id, text).

    Null and empty texts have the end id alone; any length is cut. Of repeated rows every copy is packed. Padding: at most k - 1
    tokens in a sequence of class k, under capacity / classes in one of rests, and one or two sequences of
    left-over pieces in all. Sequence ids: class by class, each from 0 up; gapless. An empty table gives none.
    """
    small_batches(docs.sparkSession)
    cut = pieces(docs, capacity, classes, end_id, path)
    cell = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(cells)).cast("int")
    cut = materialize(cut.withColumn("_cell", cell).withColumn("_amount", F.when(F.col("class") <= classes, 1).otherwise(F.col("length")).cast("long")), "pieces")
    order = ["doc_id", "start", "ids_crc32", "length"]
    # classes x cells counts at most are broadcast
    placed = materialize(running_start(cut, ["class"], "_cell", order, "_amount", "_at").drop("_amount", "_cell"), "numbered")

    room = capacity - capacity // classes + 1  # a rest that begins below it ends inside its sequence
    k, rest = F.col("class"), F.col("class") > classes
    per_class = placed.groupBy("class").agg(F.count(F.lit(1)).alias("_n"), F.max("_at").alias("_last"))
    per_class = per_class.withColumn("_bins", F.when(rest, F.floor(F.col("_last") / room) + 1).otherwise(F.floor(F.col("_n") / k)).cast("long"))
    earlier = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)  # classes + 1 rows
    per_class = per_class.withColumn("_base", F.coalesce(F.sum("_bins").over(earlier), F.lit(0)).cast("long")).drop("_n", "_last")
    rows = placed.join(F.broadcast(per_class), "class").withColumn("_bin", F.floor(F.col("_at") / F.when(rest, room).otherwise(k)).cast("long"))
    done = rows.where(rest | (F.col("_bin") < F.col("_bins")))
    first = F.min("_at").over(Window.partitionBy("_bin"))
    done = done.where(~rest).withColumn("_offset", F.col("_at") % k * F.col("length")).unionByName(
        done.where(rest).withColumn("_offset", F.col("_at") - first)
    ).withColumn("_sequence", F.col("_base") + F.col("_bin"))
    # at most k - 1 pieces of class k are left: classes * (classes - 1) / 2 rows in one group, whatever the input
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    left = rows.where(~rest & (F.col("_bin") >= F.col("_bins"))).select(*names, F.lit(0).alias("_left"))
    left = left.groupBy("_left").applyInPandas(first_fit(capacity), LEFT)
    every = per_class.agg(F.coalesce(F.sum("_bins"), F.lit(0)).alias("_all")).scalar()
    left = left.select(*names, (every + F.col("bin")).cast("long").alias("sequence_id"), "offset")
    done = done.select(*names, F.col("_sequence").alias("sequence_id"), F.col("_offset").cast("long").alias("offset"))
    return done.unionByName(left)
