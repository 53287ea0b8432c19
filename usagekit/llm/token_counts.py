"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums, so a change of the corpus is a set of signed
rows: an inserted document adds its count, a deleted one takes it back, a revised one does both. A batch
of changes is summed by key into one small table under a name of its own, and committed by a manifest that
names the table. The manifest is created exclusively, under the name of the batch: a batch that is retried,
delivered twice or written by two writers at once counts once, as totals are the sum over the tables that
manifests name. A compaction sums these into one table and names what it replaces, committed the same way.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from py4j.protocol import Py4JJavaError

from usagekit.llm.common import delete_folder, materialize, word_count
from usagekit.llm.packing import encoder, stretches, vocabulary_path
from usagekit.session import gone_at_exit, scratch_dir

KEYS = ["source", "lang", "version"]
ROLLUP = "source string, lang string, version string, documents long, tokens long"
WORDS, BPE = "words-1", "word-bpe-49k"


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, lang, version, tokens: two rows for every row of ``docs``, one per tokenizer version.

    words-1 counts words between ASCII white space, word-bpe-49k the ids of the public vocabulary. Null and empty texts: 0.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path or vocabulary_path())
        for batch in batches:
            texts = batch.column(4)
            ids = [len(x) for a, b in stretches(texts) for x in words.encode(texts.slice(a, b - a))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.int64())], names=["doc_id", "source", "lang", "words", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in ("source", "lang")], word_count(F.col("text")).alias("words"), F.col("text").cast("string"))
    rows = rows.mapInArrow(read, "doc_id long, source string, lang string, words long, ids long")
    return rows.unpivot(["doc_id", "source", "lang"], ["words", "ids"], "version", "tokens").withColumn(
        "version", F.when(F.col("version") == "words", WORDS).otherwise(BPE)
    )


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("documents"), "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).alias("tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Takes the old counts back and adds the new ones, under whatever keys either has."""
    return deletes(before).unionByName(inserts(after))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that turn the counts of one state of a corpus into those of another: rows that agree give none."""
    same = ["doc_id", *KEYS, "tokens"]
    return deletes(before.select(same).exceptAll(after.select(same))).unionByName(inserts(after.select(same).exceptAll(before.select(same))))


class TokenRollup:
    """Committed batches in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, kind: str, name: str):
        if not re.fullmatch(r"[A-Za-z0-9._-]+", name):
            raise ValueError(f"not a batch name: {name!r}")
        return self._path(f"{self.folder}/{kind}/{name}.json")

    def _create(self, kind: str, name: str, content: dict) -> bool:
        """Writes a manifest; False if there is one of this name."""
        try:
            out = self._fs.create(self._manifest(kind, name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception.getClass().getName()) and "already exists" not in str(e.java_exception):
                raise
            return False
        out.write(json.dumps(content).encode())
        out.close()
        return True

    def _read(self, kind: str) -> dict[str, dict]:
        """The manifests of a kind by name. One without content was claimed by a writer that did not end."""
        place = self._path(f"{self.folder}/{kind}")
        if not self._fs.exists(place):
            return {}
        out = {}
        for f in self._fs.listStatus(place):
            name = f.getPath().getName()
            if name.endswith(".json") and not name.startswith("."):
                stream = self._fs.open(f.getPath())
                text = bytes(stream.readAllBytes()).decode()
                stream.close()
                if text:
                    out[name.removesuffix(".json")] = json.loads(text)
        return out

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._manifest("commits", batch))

    def release(self, batch: str) -> bool:
        """Frees the name of a batch whose writer died between claiming and naming its table; False if it is committed."""
        if not self.committed(batch) or batch in self._read("commits"):
            return False
        return self._fs.delete(self._manifest("commits", batch), False)

    def _sums(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds signed rows (KEYS, documents, tokens); False, and nothing added, if the batch was committed before.

        The sums are formed before the shuffle, so a key with most rows is one row per task. Of several writers of one
        batch one creates the manifest; the tables of the others are deleted, and were never read.
        """
        if self.committed(batch):
            return False
        table = f"{self.folder}/tables/{batch}-{uuid.uuid4().hex}"
        self._sums(changes).coalesce(1).write.parquet(table)
        if self._create("commits", batch, {"table": table}):
            return True
        delete_folder(self.spark, table)
        return False

    def _tables(self) -> tuple[list[str], list[str], int]:
        """The tables to sum, the batches they hold, and the number of the last compaction."""
        done = self._read("compactions")
        last = max(map(int, done), default=0)
        start = done[str(last)] if last else {"table": None, "batches": []}
        held = set(start["batches"])
        new = {name: m["table"] for name, m in self._read("commits").items() if name not in held}
        return [*filter(None, [start["table"]]), *new.values()], sorted(held | set(new)), last

    def _rows(self, tables: list[str]) -> DataFrame:
        return self.spark.read.schema(ROLLUP).parquet(*tables) if tables else self.spark.createDataFrame([], ROLLUP)

    def compact(self) -> bool:
        """Sums all committed batches into one table; False if another writer has just done so.

        Names of batches stay taken. Tables that were replaced stay for readers that have listed them already.
        """
        tables, batches, last = self._tables()
        table = f"{self.folder}/tables/compaction-{uuid.uuid4().hex}"
        self._sums(self._rows(tables)).coalesce(1).write.parquet(table)
        if self._create("compactions", str(last + 1), {"table": table, "batches": batches}):
            return True
        delete_folder(self.spark, table)
        return False

    def totals(self) -> DataFrame:
        """KEYS, documents, tokens; a null source or language is a key of its own. Keys without documents left are gone."""
        return self._sums(self._rows(self._tables()[0])).where("documents <> 0 OR tokens <> 0")


def token_totals(docs: DataFrame, batches: int = 4, folder: str | None = None, path: str | None = None) -> DataFrame:
    """source, lang, version, documents, tokens over all rows of ``docs`` (doc_id, text, source, lang).

    The corpus arrives in ``batches`` inserts, by a hash of doc_id; the BPE counts come in provisionally as
    words and are revised by a later batch each. Repeated rows count as often as they are given; a null
    doc_id belongs to one of the batches; an empty table has no totals.
    """
    counts = materialize(count_tokens(docs, path), "token-counts")
    if folder is None:
        folder = f"{scratch_dir(docs.sparkSession)}/usagekit/rollup-{uuid.uuid4().hex}"
        gone_at_exit(docs.sparkSession, folder)
    rollup = TokenRollup(docs.sparkSession, folder)
    for i in range(batches):
        batch = counts.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i)
        words, ids = batch.where(F.col("version") == WORDS), batch.where(F.col("version") == BPE)
        provisional = words.withColumn("version", F.lit(BPE))
        rollup.commit(f"load-{i}", inserts(words.unionByName(provisional)))
        rollup.commit(f"revise-{i}", revisions(provisional, ids))
    rollup.compact()
    return rollup.totals()
