"""Row-level derivations: every function builds one Column from native expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagekit.vocabulary import CANVAS_PATTERN, DEFAULT, EU_COUNTRIES, HYPOTHESIS_COUNTRIES, Vocabulary

MINUTE = 60
HOUR = 3600
DAY = 86400


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def one_of(names: Sequence[str], column: str = "event") -> Column:
    """Membership in a fixed list as one parsed expression (a plain IN list, so it is pushed to the scan)."""
    return F.expr(f"{column} IN ({', '.join(repr(str(n)) for n in names)})")


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is NULL."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL on a zero denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def share(condition: Column) -> Column:
    """Percentage of rows of the group that fulfil the condition."""
    return F.avg(F.when(condition, F.lit(100.0)).otherwise(F.lit(0.0)))


def elapsed(later: Column | str, earlier: Column | str, unit: int = 1) -> Column:
    """Fractional time from ``earlier`` to ``later`` in units of ``unit`` seconds."""
    micros = F.unix_micros(_col(later)) - F.unix_micros(_col(earlier))
    return micros / F.lit(float(unit) * 1_000_000.0)


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit a value to a range; NULL stays NULL."""
    out = value
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def bucketize(value: Column | str, edges: Sequence[float], labels: Sequence[str], right: bool = True) -> Column:
    """Label of the interval the value falls in, NULL outside all intervals.

    Intervals are ``(a, b]`` with ``right`` and ``[a, b)`` without.
    """
    value = _col(value)
    out: Column | None = None
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = (value > low) & (value <= high) if right else (value >= low) & (value < high)
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def label_rank(value: Column | str, labels: Sequence[str]) -> Column:
    """Position of a label in a fixed display order; labels outside the order come last."""
    value = _col(value)
    out = F.when(value == labels[0], F.lit(0))
    for position, label in enumerate(labels[1:], start=1):
        out = out.when(value == label, F.lit(position))
    return out.otherwise(F.lit(len(labels)))


def first_match(rules: Mapping[str, Column], default: str) -> Column:
    """Name of the first rule that holds."""
    out: Column | None = None
    for name, condition in rules.items():
        out = F.when(condition, F.lit(name)) if out is None else out.when(condition, F.lit(name))
    return out.otherwise(F.lit(default))


def column_or(df: DataFrame, name: str, default: float = 0) -> Column:
    """The column where the table has it, a constant where it does not."""
    return F.col(name) if name in df.columns else F.lit(default)


def fill_numeric(df: DataFrame) -> DataFrame:
    """NULL numbers become 0, booleans become 0/1; text, dates and timestamps are left alone."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    out = []
    for name, dtype in df.dtypes:
        if dtype == "boolean":
            out.append(f"int(coalesce(`{name}`, false)) AS `{name}`")
        elif dtype in numeric or dtype.startswith("decimal"):
            out.append(f"coalesce(`{name}`, cast(0 AS {dtype})) AS `{name}`")
        else:
            out.append(f"`{name}`")
    return df.selectExpr(*out)


def tool_of(event: Column | str = "event", tool_name: Column | str = "tool_name", vocab: Vocabulary = DEFAULT) -> Column:
    """Tool of an event: the trimmed tool property if it has text, else the event name after the
    tool-call prefix, else NULL."""
    event, tool_name = _col(event), _col(tool_name)
    named = F.nullif(F.trim(tool_name), F.lit(""))
    suffix = F.when(F.startswith(event, F.lit(vocab.tool_prefix)), F.right(event, F.char_length(event) - len(vocab.tool_prefix)))
    return F.coalesce(named, suffix)


def with_tool(df: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    tool_name = column_or(df, "tool_name", None).cast("string")
    return df.withColumn("tool", tool_of(F.col("event"), tool_name, vocab))


def canvas_id_of(pathname: Column | str = "pathname") -> Column:
    return F.nullif(F.regexp_extract(_col(pathname), CANVAS_PATTERN, 1), F.lit(""))


def with_canvas_id(df: DataFrame) -> DataFrame:
    pathname = column_or(df, "pathname", None).cast("string")
    return df.withColumn("canvas_id", canvas_id_of(pathname))


def short_tool(tool: Column) -> Column:
    """Lower-case tool name without the tool suffix, blanks as underscores."""
    return F.lower(F.replace(F.replace(tool, F.lit("_tool"), F.lit("")), F.lit(" "), F.lit("_")))


def canonical_event(vocab: Vocabulary = DEFAULT) -> Column:
    """Unified workflow token of an event (needs columns ``event`` and ``tool``)."""
    event, tool = F.col("event"), F.col("tool")
    short = short_tool(tool)
    worker = vocab.worker_tool.replace(" ", "_").lower()
    return (
        F.when((F.length(tool) > 0) & (short != worker), F.concat(F.lit("tool_"), short))
        .when(event.isin(*vocab.all_runs), F.lit("manual_run"))
        .when(event.isin(*vocab.chat_start), F.lit("agent_chat"))
        .when(event.isin(*vocab.credit_use), F.lit("credit_use"))
        .otherwise(event)
    )


def with_canonical_event(df: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    return df.withColumn("unified_event", canonical_event(vocab))


def region_of(code: Column | str) -> Column:
    code = F.upper(F.coalesce(_col(code), F.lit("")))
    return (
        F.when(code == "IN", F.lit("India"))
        .when(code == "US", F.lit("US"))
        .when(code.isin(*EU_COUNTRIES), F.lit("EU"))
        .when(code == "", F.lit("Unknown"))
        .otherwise(F.lit("Other"))
    )


def country_group(code: Column | str, kept: Sequence[str] = HYPOTHESIS_COUNTRIES) -> Column:
    code = _col(code)
    return F.when(code.isNull(), F.lit("Unknown")).when(code.isin(*kept), code).otherwise(F.lit("Other"))


def is_build(event: Column | str = "event", tool: Column | str = "tool_name", vocab: Vocabulary = DEFAULT) -> Column:
    """A build call, by event name or by tool property."""
    by_event = F.coalesce(_col(event).isin(*vocab.build_events), F.lit(False))
    by_tool = F.coalesce(_col(tool).isin(*vocab.build_tools), F.lit(False))
    return by_event | by_tool


def event_category(event: Column | str = "event", vocab: Vocabulary = DEFAULT) -> Column:
    """One of twelve coarse journey categories; the first rule that holds decides."""
    event = _col(event)
    return first_match(
        {
            "AUTH": event.isin(vocab.sign_up, vocab.sign_in),
            "ONBOARD": F.contains(event, F.lit("onboarding")),
            "RUN": event.isin(*vocab.runs),
            "AGENT_CHAT": event.isin(*vocab.agent_start),
            "AGENT_BUILD": event == vocab.tool_prefix + "create_block_tool",
            "AGENT_RUN": event == vocab.tool_prefix + "run_block_tool",
            "AGENT_REFACTOR": event == vocab.tool_prefix + "refactor_block_tool",
            "AGENT_OTHER": F.startswith(event, F.lit(vocab.tool_prefix.rstrip("_"))),
            "CANVAS_EDIT": event.isin(*vocab.canvas_edit),
            "VIEW_OUTPUT": F.contains(event, F.lit("fullscreen")),
            "CREDITS": F.contains(event, F.lit("credits")),
        },
        default="OTHER",
    )


def tool_label(tool: Column | str = "tool", vocab: Vocabulary = DEFAULT) -> Column:
    """Short display name of a tool; unknown tools give the first eight letters in upper case."""
    tool = _col(tool)
    out: Column | None = None
    for name, label in vocab.tool_labels.items():
        out = F.when(tool == name, F.lit(label)) if out is None else out.when(tool == name, F.lit(label))
    return out.otherwise(F.substring(F.upper(F.replace(tool, F.lit("_tool"), F.lit(""))), 1, 8))


def referrer_class(domain: Column | str) -> Column:
    domain = F.lower(_col(domain))
    return F.when(domain.isNotNull(), first_match(
        {
            "google": F.contains(domain, F.lit("google")),
            "github": F.contains(domain, F.lit("github")),
            "linkedin": F.contains(domain, F.lit("linkedin")),
            "twitter": F.contains(domain, F.lit("twitter")) | F.contains(domain, F.lit("x.com")),
            "direct": domain.isin("", "nan", "none", "$direct"),
        },
        default="other",
    ))


def hour_band(hour: Column | str) -> Column:
    hour = _col(hour)
    return first_match(
        {
            "Work hours (9-17h)": hour.between(9, 17),
            "Evening (18-22h)": hour.between(18, 22),
            "Night (0-6h)": hour.between(0, 6),
        },
        default="Early morning (7-8h, 23h)",
    )


def weekend_label(value: Column | str) -> Column:
    value = _col(value)
    return F.when(value == 0, F.lit("Weekday")).when(value == 1, F.lit("Weekend")).otherwise(F.lit("Unknown"))


def adoption_cohort(ever: Column | str = "ever_used_agent", early: Column | str = "adopted_agent_early") -> Column:
    return first_match(
        {"Early adopter (<1h)": _col(early) == 1, "Late adopter (1h+)": _col(ever) == 1}, default="Never adopted"
    )


def return_cohort(
    returned: Column | str = "had_second_session", hours: Column | str = "time_to_return_hours", fast: float = 24
) -> Column:
    returned = _col(returned) == 1
    return first_match(
        {"Returned <=24h": returned & (_col(hours) <= fast), "Returned >24h": returned}, default="Never returned"
    )


def session_phase(number: Column | str = "session_num") -> Column:
    number = _col(number)
    return first_match({"1. session": number == 1, "2-3. session": number <= 3}, default="4+ session")


def canvas_flags(df: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Adds the five 0/1 action flags of canvas work (needs ``event`` and ``tool``)."""
    event, tool = F.col("event"), F.coalesce(F.col("tool"), F.lit(""))
    by_agent = event.isin(*vocab.tool_events)
    return df.withColumns(
        {
            "is_structural": flag(event.isin(*vocab.structural)),
            "is_execution": flag(
                event.isin(*vocab.all_runs, *vocab.execution_extra) | (by_agent & F.contains(tool, F.lit("run_block")))
            ),
            "is_dependency": flag(event.isin(*vocab.dependency)),
            "is_output": flag(event.isin(*vocab.output)),
            "is_agent_build": flag(by_agent & tool.rlike("create_block|refactor_block|create_edges")),
        }
    )


def unified_session_id(native: Column | str = "session_id", derived: Column | str = "session_num") -> Column:
    native, derived = _col(native), _col(derived)
    return F.when(F.length(F.trim(native)) > 0, F.concat(F.lit("web::"), native)).otherwise(
        F.concat(F.lit("derived::"), F.coalesce(derived.cast("string"), F.lit("0")))
    )


def depth_points(label: Column | str = "tool_label") -> Column:
    label = _col(label)
    return (
        F.when(label == "CREATE", F.lit(1)).when(label == "REFACTOR", F.lit(2)).when(label == "FINISH", F.lit(3)).otherwise(F.lit(0))
    )
