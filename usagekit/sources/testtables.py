"""Event logs derived from the test tables.

``usage_log`` spreads the five event types of the ``events`` table over the product vocabulary: a
user's persona, pace and start month follow from the user id, the event name from the type and the
property ``k``. Every row of the table gives exactly one event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagekit.session import ensure_utc, once
from usagekit.sources.events import conform

# ---------------------------------------------------------------------------------------------
# How a type and a range of k become an event name (upper bound of k, name).
# ---------------------------------------------------------------------------------------------
EPOCH_US = 1_704_067_200_000_000
DAY_US = 86_400_000_000
PACE_PERCENT = (100, 50, 20, 8, 2)
PACE_LATE_DAYS = (0, 0, 0, 12, 25)
ACCOUNT_EVENTS = (
    (12, "sign_up"),
    (34, "sign_in"),
    (44, "skip_onboarding_form"),
    (54, "submit_onboarding_form"),
    (64, "canvas_onboarding_tour_finished"),
    (84, "canvas_open"),
    (100, "canvas_create"),
)
RUN_EVENTS = (
    (35, "run_block"),
    (50, "run_all_blocks"),
    (55, "run_from_block"),
    (60, "run_upto_block"),
    (75, "block_create"),
    (82, "block_delete"),
    (88, "edge_create"),
    (93, "requirements_build"),
    (97, "files_upload"),
    (100, "block_resize"),
)
VIEWER_RUN_EVENTS = ((2, "run_block"), (50, "block_create"), (100, "block_resize"))
CHAT_EVENTS = (
    (20, "agent_new_chat"),
    (30, "agent_start_from_prompt"),
    (50, "agent_message"),
    (65, "fullscreen_open"),
    (75, "fullscreen_close"),
    (86, "fullscreen_preview_output"),
    (94, "agent_accept_suggestion"),
    (100, "block_output_copy"),
)
SCREEN_EVENTS = ((50, "fullscreen_open"), (75, "fullscreen_close"), (100, "fullscreen_preview_output"))
BUILDER_TOOLS = (
    (25, "create_block_tool"),
    (45, "run_block_tool"),
    (55, "get_block_tool"),
    (63, "get_canvas_summary_tool"),
    (77, "refactor_block_tool"),
    (85, "finish_ticket_tool"),
    (90, "get_variable_preview_tool"),
    (94, "delete_block_tool"),
    (97, "create_edges_tool"),
    (100, "get_block_image_tool"),
)
LIGHT_TOOLS = (
    (10, "create_block_tool"),
    (40, "run_block_tool"),
    (60, "get_block_tool"),
    (70, "get_canvas_summary_tool"),
    (76, "refactor_block_tool"),
    (86, "finish_ticket_tool"),
    (94, "get_variable_preview_tool"),
    (100, "get_block_image_tool"),
)
RUNNER_TOOLS = (
    (50, "run_block_tool"),
    (75, "get_block_tool"),
    (90, "get_canvas_summary_tool"),
    (100, "finish_ticket_tool"),
)
LAYER_EVENTS = ((50, "layer_create"), (100, "app_publish"))
BACKEND_EVENTS = (
    (15, "agent_open_error_assist"),
    (35, "credits_used"),
    (50, "addon_credits_used"),
    (58, "credits_exceeded"),
    (64, "credits_below_1"),
    (70, "credits_below_2"),
    (76, "credits_below_3"),
    (82, "credits_below_4"),
    (90, "agent_block_run"),
    (100, "agent_block_created"),
)
COUNTRIES = (
    "IN", "US", "GB", "IE", "FR", "NL", "DE", "ES", "IT", "PL", "SE", "BR", "CA",
    "AU", "JP", "KR", "MX", "ZA", "NG", "AE", "SG", "TR", "UA", "CH", "NO",
)
REFERRERS = ("www.google.com", "github.com", "linkedin.com", "x.com", "$direct", "news.example.org", None, "twitter.com")
# ---------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hundred(ranges: tuple, prefix: str = "") -> list[str]:
    """The name for each k of 0..99."""
    return [next(prefix + name for bound, name in ranges if k < bound) for k in range(100)]


def _pick(values: list[str], position: Column) -> Column:
    """Entry of a constant list; the list is one folded literal, an empty entry is NULL."""
    return F.nullif(F.element_at(F.split(F.lit("|".join(values)), r"\|"), position.cast("int") + 1), F.lit(""))


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a product event log; a projection, so filters and column pruning reach the scan."""
    ensure_utc(spark)
    prefix = "agent_tool_call_"
    names = [
        *_hundred(ACCOUNT_EVENTS), *_hundred(VIEWER_RUN_EVENTS), *_hundred(RUN_EVENTS), *_hundred(SCREEN_EVENTS),
        *_hundred(CHAT_EVENTS), *_hundred(BUILDER_TOOLS, prefix), *_hundred(LIGHT_TOOLS, prefix),
        *_hundred(RUNNER_TOOLS, prefix), *_hundred(LAYER_EVENTS), *_hundred(BACKEND_EVENTS),
    ]
    base = table(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("user_id") % 6).cast("int").alias("persona"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
    )
    kind, persona, k, user = F.col("event_type"), F.col("persona"), F.col("k"), F.col("user_id")
    variant = (
        F.when(kind == "signup", 0)
        .when(kind == "click", F.when(persona == 4, 1).otherwise(2))
        .when(kind == "view", F.when(persona.isin(3, 4), 3).otherwise(4))
        .when(kind == "purchase", F.element_at(F.array(*[F.lit(v) for v in (5, 6, 7, 8, 8, 6)]), persona + 1))
        .otherwise(9)
    )
    pace = "(user_id div 6) % 5"
    percent = f"element_at(array({','.join(map(str, PACE_PERCENT))}), int({pace}) + 1)"
    late = f"element_at(array({','.join(map(str, PACE_LATE_DAYS))}), int({pace}) + 1)"
    moved = F.expr(
        f"{EPOCH_US}L + (micros - {EPOCH_US}L) * {percent} div 100 + ((user_id div 30) % 4 * 30 + {late}) * {DAY_US}L"
    )
    base = base.select(
        "user_id", "event_id", "event_type", "k", "micros",
        _pick(names, variant * 100 + k).alias("event"),
        F.timestamp_micros(moved).alias("ts"),
    )
    event = F.col("event")
    by_tool = F.startswith(event, F.lit(prefix))
    tool_name = (
        F.when(by_tool & (k % 3 == 0), F.concat(F.lit(" "), F.right(event, F.char_length(event) - len(prefix)), F.lit(" ")))
        .when(by_tool & (k % 3 == 2), F.lit(" "))
        .when((event == "agent_message") & (k % 2 == 0), F.lit("Coder Agent"))
    )
    web = (kind != "error") & (k % 10 != 9)
    log = base.select(
        user.cast("string").alias("person_id"),
        "event_id",
        "event",
        "ts",
        F.timestamp_micros("micros").alias("created_at"),
        F.concat_ws("-", F.lit("d"), user, k % 2).alias("distinct_id"),
        tool_name.alias("tool_name"),
        F.when(kind == "view", F.concat_ws("-", F.lit("m"), user, k % 10)).alias("message_id"),
        F.when(web, F.concat_ws("-", F.lit("s"), user, F.date_format("ts", "yyyyMMdd"), F.floor(F.hour("ts") / 6))).alias("session_id"),
        F.when(kind == "signup", F.lit("/canvases/home"))
        .when(k % 5 == 4, F.lit(None))
        .otherwise(F.concat(F.lit("/canvas/"), F.lpad((k % 25).cast("string"), 12, "0")))
        .alias("pathname"),
        F.when(kind == "error", F.lit("python-sdk")).otherwise(F.lit("web")).alias("lib"),
        F.when(user % 11 != 0, _pick(list(COUNTRIES), (user + F.when(k % 20 == 0, 1).otherwise(0)) % 25)).alias("country_code"),
        F.when(k % 3 == 0, F.lit("Desktop")).when(k % 3 == 1, F.lit("Mobile")).alias("device_type"),
        F.when(k % 3 == 0, _pick([r or "" for r in REFERRERS], user % 8)).alias("referrer"),
    )
    return conform(log)


def ingested_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``usage_log`` as a parquet table in the shared folder, written once per application and table set.

    Operators then scan plain columns, so event filters and column pruning reach the files.
    """
    return once(spark, "log", sf_dir, lambda: usage_log(spark, sf_dir))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``orders`` table as a long-horizon event log: customer, priority, order date."""
    ensure_utc(spark)
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_custkey").cast("string").alias("person_id"),
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderpriority").alias("event"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_orderstatus").alias("canvas_id"),
    )


def conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as token sequences: key, position, speaker."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").cast("string").alias("seq_id"), F.col("turn").alias("pos"), F.col("role").alias("token"))
