"""Session settings the operators rely on."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# AQE re-plans joins and coalesces shuffles at run time; the forced skew join lets it split a hot
# user even when the split costs the aggregation above it one more exchange.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app: str = "usagekit", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Days, hours and months of the log are UTC: pin the session zone on a session built elsewhere."""
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.forceOptimizeSkewedJoin"):
        if spark.conf.get(key, None) != SETTINGS[key]:
            spark.conf.set(key, SETTINGS[key])
    return spark


def _file_system(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's checkpoint folder, else one of this application in the warehouse.

    Both are folders that the driver and all executors see; a machine-local folder is never taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/usagekit-scratch/{spark.sparkContext.applicationId}"
        gone_at_exit(spark, base)
    return base.rstrip("/")


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """The folder is deleted when the driver ends; it is made if it does not exist."""
    path, files = _file_system(spark, path)
    files.mkdirs(path)
    files.deleteOnExit(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    path, files = _file_system(spark, path)
    files.delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and that nothing reads any more."""
    for folder in {str(name).rpartition("/")[0] for name in df.inputFiles()}:
        if "/usagekit/" in folder:
            delete_folder(df.sparkSession, folder)


def materialize(df: DataFrame, name: str = "table", small_tasks: bool = False) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    Cuts the lineage of a table that several later steps read; the files outlive any executor and
    keep column pruning and filter pushdown for the readers. Tasks with many sorts are best kept small.
    """
    write = _write_in_small_tasks if small_tasks else _write
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))


def _write(df: DataFrame, name: str) -> str:
    path = f"{scratch_dir(df.sparkSession)}/usagekit/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    gone_at_exit(df.sparkSession, path)
    return path


def _state_of(spark: SparkSession, folder: str) -> int:
    """Changes when a file of the folder is added, removed or rewritten."""
    path, files = _file_system(spark, folder)
    return hash(tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(path))))


ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
ONCE_BYTES = "16m"  # shuffled bytes of a task that writes a shared table: many sorts of such a task are in memory at a time


def _write_in_small_tasks(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    before = spark.conf.get(ADVISORY, None)
    spark.conf.set(ADVISORY, ONCE_BYTES)
    try:
        return _write(df, name)
    finally:
        spark.conf.unset(ADVISORY) if before is None else spark.conf.set(ADVISORY, before)


_WRITTEN: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def once(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``build`` declares, written at its first use in this application and read afterwards.

    ``source`` is the folder it derives from; when files there change, the table is written anew.
    """
    ensure_utc(spark)
    key = (spark.sparkContext.applicationId, name, f"{source} {_state_of(spark, source)}")
    if key in _WRITTEN:
        path, schema = _WRITTEN[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:
            del _WRITTEN[key]
    df = build()
    _WRITTEN[key] = (_write_in_small_tasks(df, name), df.schema)
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)
