"""Reading the event log and the user matrix, writing tables, profiling columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# Raw column names of the exported log and the words it uses for booleans.
# ---------------------------------------------------------------------------------------------
RAW_COLUMNS = {
    "person_id": "person_id",
    "distinct_id": "distinct_id",
    "event": "event",
    "timestamp": "ts",
    "created_at": "created_at",
    "prop_tool_name": "tool_name",
    "prop_message_id": "message_id",
    "prop_$session_id": "session_id",
    "prop_$pathname": "pathname",
    "prop_$lib": "lib",
    "prop_$geoip_country_code": "country_code",
    "prop_$device_type": "device_type",
    "prop_$set_once.$initial_referring_domain": "referrer",
}
BOOLEAN_WORDS = {"IGAZ": "true", "HAMIS": "false"}
# ---------------------------------------------------------------------------------------------

TIME_COLUMNS = ("ts", "created_at")

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("person_id", T.StringType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("distinct_id", T.StringType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("pathname", T.StringType()),
        T.StructField("lib", T.StringType()),
        T.StructField("country_code", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("referrer", T.StringType()),
    ]
)


def read_events_raw(
    spark: SparkSession,
    path: str,
    names: Mapping[str, str] = RAW_COLUMNS,
    columns: list[str] | None = None,
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Event log from CSV, one row per event.

    The header is read for the column names only, unless a ``schema`` gives them; every value starts as
    text, boolean words become ``true``/``false``, and a timestamp that does not parse becomes NULL. Known
    columns get their engine name. Files are split among tasks; ``multi_line`` reads quoted line breaks
    and makes each file one task.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    raw = (reader.schema(schema) if schema is not None else reader).csv(path)
    known = {old: new for old, new in names.items() if old in raw.columns}
    others = {c: c for c in raw.columns if c not in known}
    out = []
    for old, new in {**known, **others}.items():
        if columns is not None and new not in columns:
            continue
        value = F.col(f"`{old}`")
        if new in TIME_COLUMNS:
            value = F.try_to_timestamp(value)
        elif new in ("person_id", "distinct_id"):
            value = value.cast("string")
        else:
            value = F.when(value == "IGAZ", F.lit("true")).when(value == "HAMIS", F.lit("false")).otherwise(value)
        out.append(value.alias(new))
    return raw.select(*out)


def drop_unusable(events: DataFrame) -> DataFrame:
    """Only events of a known person at a known time."""
    return events.dropna(subset=["person_id", "ts"])


def conform(events: DataFrame) -> DataFrame:
    """Canonical columns and types; a missing column becomes a typed NULL.

    Raw logs have no event id: a hash of the row's columns takes its place, so that events of equal time
    keep one order in every run. Rows that agree in all columns are interchangeable.
    """
    out = []
    for field in EVENT_SCHEMA.fields:
        value = F.col(field.name) if field.name in events.columns else F.lit(None)
        if field.name == "event_id" and "event_id" not in events.columns:
            value = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(events.columns)])
        out.append(value.cast(field.dataType).alias(field.name))
    return events.select(*out)


def read_events(spark: SparkSession, path: str, names: Mapping[str, str] = RAW_COLUMNS, **options) -> DataFrame:
    return drop_unusable(read_events_raw(spark, path, names, **options))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """User matrix written earlier; the user key is text."""
    users = spark.read.parquet(path)
    return users.withColumn("person_id", F.col("person_id").cast("string"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet or CSV, decided by the suffix of the path."""
    if path.endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    elif path.endswith(".csv"):
        df.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"table format not supported: {path}")


def write_twin(df: DataFrame, base: str) -> None:
    """The same table as parquet and as CSV; the CSV is written from the parquet, so the plan runs once."""
    write_table(df, f"{base}.parquet")
    write_table(df.sparkSession.read.parquet(f"{base}.parquet"), f"{base}.csv")


def write_reports(reports: Mapping[str, DataFrame], folder: str) -> None:
    """Report tables as CSV, one folder each, named as in the mapping."""
    for name, df in reports.items():
        write_table(df, f"{folder.rstrip('/')}/{name}.csv")


def profile_columns(df: DataFrame, limit: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Per column: filled values, fill percentage and an example, over the first ``limit`` rows.

    One aggregation over the rows, then one row per column.
    """
    rows = df
    if limit is not None:
        rows = (df.orderBy(*order_by) if order_by else df).limit(limit)
    wide = rows.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(F.col(f"`{c}`")).alias("filled"),
                F.substring(F.min(F.col(f"`{c}`").cast("string")), 1, 40).alias("example"),
            ).alias(f"__{i}")
            for i, c in enumerate(df.columns)
        ],
    )
    long = wide.select("__rows", F.explode(F.array(*[F.col(f"__{i}") for i in range(len(df.columns))])).alias("c"))
    return long.select(
        F.col("c.column_name").alias("column_name"),
        F.col("c.filled").alias("filled"),
        (F.col("c.filled") * 100.0 / F.nullif(F.col("__rows"), F.lit(0))).alias("fill_pct"),
        F.coalesce(F.col("c.example"), F.lit("-")).alias("example"),
    )
