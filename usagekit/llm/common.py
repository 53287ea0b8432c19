"""What the operators share: the word and white-space classes, seeded order, written tables, ordered numbering.

Every operator reads the columns it names and no others, so further columns of a table, whatever
their names, never clash with its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagekit.session import delete_folder, drop_table, gone_at_exit, materialize, scratch_dir

__all__ = [
    "SPACE", "WORD", "column", "delete_folder", "drop_table", "materialize", "number_rows", "read_folder", "running_start", "small_batches", "text_or_empty",
    "whole_row", "word_count", "write_folder", "written",
]

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def column(name: str) -> Column:
    """A column by its name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one, out of the way of others' names; ``select("_row.*")`` gives them back."""
    return F.struct(*[column(c) for c in df.columns]).alias("_row")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_folder(df: DataFrame, name: str, parts: Sequence[str] = ()) -> str:
    """Writes a table into the shared folder and gives its path. The shuffle files of the write go when it has ended."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/usagekit/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.partitionBy(*parts).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    gone_at_exit(spark, path)
    return path


def read_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """From now on tasks hand rows to Python by BATCH_ROWS at most: rows of whole texts or sets are some kilobytes each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """As ``materialize``, and the shuffle files of the write are gone when it has ended."""
    return df.sparkSession.read.schema(df.schema).parquet(write_folder(df, name))


def _cell_offsets(rows: DataFrame, group: Sequence[str], cell: str, amount: Column) -> DataFrame:
    """Sum of ``amount`` in the lower cells of the same group: one row per (group, cell)."""
    sums = rows.groupBy(*group, cell).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*group, cell, F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("_before"))


def running_start(rows: DataFrame, group: Sequence[str], cell: str, order: Sequence[str], amount: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over all rows that precede a row in its group.

    Rows precede by cell, then by ``order``. A window only ever spans one (group, cell), so a group that
    holds most rows is spread over its cells; what the lower cells hold comes from one row per cell.
    ``rows`` is read twice: it should be a written table. The cells are joined by broadcast: they are
    groups x cells, which the caller bounds by its parameters.
    """
    offsets = F.broadcast(_cell_offsets(rows, group, cell, F.col(amount)))
    within = Window.partitionBy(*group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("_inner", F.coalesce(F.sum(amount).over(within), F.lit(0)).cast("long"))
    return inner.join(offsets, [*group, cell]).withColumn(name, F.col("_before") + F.col("_inner")).drop("_before", "_inner")


def number_rows(rows: DataFrame, group: Sequence[str], cell: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: gapless numbers from 0 within a group, by cell and then ``order`` (see ``running_start``)."""
    return running_start(rows.withColumn("_one", F.lit(1).cast("long")), group, cell, order, "_one", name).drop("_one")
