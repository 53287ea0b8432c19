"""SQL of every registered query that SQL can express."""

from __future__ import annotations

from oracle.log_sql import ORDERS_LOG, TOKENS, USAGE_LOG
from oracle.users_sql import CHATS, FEATURES, LOG, RUNS, TOOL_EVENTS, TOOLS, USERS, VOLUME, hours

SEGMENTS = ("Agent Builder", "Agent Runner", "Manual Coder", "Viewer", "Ghost")
ADOPTION = ("Early adopter (<1h)", "Late adopter (1h+)", "Never adopted")
STATES = ("CREATE", "RUN", "GET", "REFACTOR", "FINISH", "SUMMARY", "PREVIEW", "DELETE")


def out(ctes: str, source: str, plain: str = "", doubles: str = "", where: str = "", group: str = "", tail: str = "") -> str:
    """``doubles`` is a list of ``alias: expression`` separated by ``;``, rounded to 6 places."""
    cols = [plain] if plain else []
    for item in filter(None, (d.strip() for d in doubles.split(";"))):
        alias, _, expr = item.partition(":")
        cols.append(f'round(CAST({(expr or alias).strip()} AS DOUBLE), 6) AS "{alias.strip()}"')
    sql = f"WITH {ctes} SELECT {', '.join(cols)} FROM {source}"
    sql += f" WHERE {where}" if where else ""
    sql += f" GROUP BY {group}" if group else ""
    return f"{sql} {tail}".strip()


def pct(cond: str) -> str:
    return f"avg(CASE WHEN {cond} THEN 100.0 ELSE 0.0 END)"


def seg(name: str) -> str:
    return pct(f"segment = '{name}'")


AB, GH = seg("Agent Builder"), seg("Ghost")
POWER = pct("segment IN ('Agent Builder', 'Agent Runner')")

CATEGORY = f"""CASE WHEN event IN ('sign_up','sign_in') THEN 'AUTH' WHEN contains(event, 'onboarding') THEN 'ONBOARD' WHEN event IN {RUNS} THEN 'RUN'
 WHEN event IN {CHATS} THEN 'AGENT_CHAT' WHEN event = 'agent_tool_call_create_block_tool' THEN 'AGENT_BUILD'
 WHEN event = 'agent_tool_call_run_block_tool' THEN 'AGENT_RUN' WHEN event = 'agent_tool_call_refactor_block_tool' THEN 'AGENT_REFACTOR'
 WHEN starts_with(event, 'agent_tool_call') THEN 'AGENT_OTHER' WHEN event IN ('block_create','block_delete','block_resize') THEN 'CANVAS_EDIT'
 WHEN contains(event, 'fullscreen') THEN 'VIEW_OUTPUT' WHEN contains(event, 'credits') THEN 'CREDITS' ELSE 'OTHER' END"""
UNIFIED = """CASE WHEN length(tool) > 0 AND lower(replace(replace(tool, '_tool', ''), ' ', '_')) <> 'coder_agent'
   THEN 'tool_' || lower(replace(replace(tool, '_tool', ''), ' ', '_'))
 WHEN event IN ('run_block','run_all_blocks','run_from_block','run_upto_block') THEN 'manual_run'
 WHEN event IN ('agent_new_chat','agent_start_from_prompt') THEN 'agent_chat'
 WHEN event IN ('credits_used','addon_credits_used') THEN 'credit_use' ELSE event END"""
LABEL = """CASE tool WHEN 'create_block_tool' THEN 'CREATE' WHEN 'run_block_tool' THEN 'RUN' WHEN 'get_block_tool' THEN 'GET'
 WHEN 'get_canvas_summary_tool' THEN 'SUMMARY' WHEN 'refactor_block_tool' THEN 'REFACTOR' WHEN 'finish_ticket_tool' THEN 'FINISH'
 WHEN 'get_variable_preview_tool' THEN 'PREVIEW' WHEN 'delete_block_tool' THEN 'DELETE' WHEN 'create_edges_tool' THEN 'EDGES'
 ELSE substr(upper(replace(tool, '_tool', '')), 1, 8) END"""
BUILD = "(event IN ('agent_tool_call_create_block_tool','agent_tool_call_refactor_block_tool') OR COALESCE(tool_name IN ('create_block_tool','refactor_block_tool'), false))"
STRUCTURAL = """event IN ('block_create','block_delete','block_copy','block_paste','block_rename','block_resize','edge_create','edge_delete','layer_create',
 'layer_delete','layer_rename','layer_duplicate','canvas_create','canvas_clone','canvas_rename','canvas_delete')"""
EXECUTION = f"""(event IN ('run_block','run_all_blocks','run_from_block','run_upto_block','agent_block_run') OR (event IN {TOOL_EVENTS} AND contains(COALESCE(tool, ''), 'run_block')))"""
DEPENDENCY = """event IN ('requirements_build','files_upload','files_download','files_update_lazy_load','files_delete','files_create_folder','asset_add_to_canvas','asset_create_connection')"""
OUTPUT = """event IN ('fullscreen_preview_output','fullscreen_open','block_output_download','block_output_copy','app_publish','api_deploy','hosted_apps_deploy')"""
AGENT_BUILD = f"""(event IN {TOOL_EVENTS} AND (contains(COALESCE(tool,''), 'create_block') OR contains(COALESCE(tool,''), 'refactor_block') OR contains(COALESCE(tool,''), 'create_edges')))"""
EU = "('AT','BE','BG','HR','CY','CZ','DK','EE','FI','FR','DE','GR','HU','IE','IT','LV','LT','LU','MT','NL','PL','PT','RO','SK','SI','ES','SE')"
REGION = f"""CASE WHEN upper(COALESCE(country_code,'')) = 'IN' THEN 'India' WHEN upper(COALESCE(country_code,'')) = 'US' THEN 'US'
 WHEN upper(COALESCE(country_code,'')) IN {EU} THEN 'EU' WHEN COALESCE(country_code,'') = '' THEN 'Unknown' ELSE 'Other' END"""
CGROUP = "CASE WHEN country_code IS NULL THEN 'Unknown' WHEN country_code IN ('IN','US','GB','IE','FR','NL') THEN country_code ELSE 'Other' END"
REFCLASS = """CASE WHEN referrer IS NULL THEN NULL WHEN contains(lower(referrer),'google') THEN 'google' WHEN contains(lower(referrer),'github') THEN 'github'
 WHEN contains(lower(referrer),'linkedin') THEN 'linkedin' WHEN contains(lower(referrer),'twitter') OR contains(lower(referrer),'x.com') THEN 'twitter'
 WHEN lower(referrer) IN ('','nan','none','$direct') THEN 'direct' ELSE 'other' END"""


def band(h: str) -> str:
    return (
        f"CASE WHEN {h} BETWEEN 9 AND 17 THEN 'Work hours (9-17h)' WHEN {h} BETWEEN 18 AND 22 THEN 'Evening (18-22h)' "
        f"WHEN {h} BETWEEN 0 AND 6 THEN 'Night (0-6h)' ELSE 'Early morning (7-8h, 23h)' END"
    )


WEEKEND = "CASE signup_is_weekend WHEN 0 THEN 'Weekday' WHEN 1 THEN 'Weekend' ELSE 'Unknown' END"
RETURN = """CASE WHEN had_second_session = 1 AND time_to_return_hours <= 24 THEN 'Returned <=24h' WHEN had_second_session = 1 THEN 'Returned >24h' ELSE 'Never returned' END"""

SCORE = "structural_actions * 1.0 + agent_build_actions * 1.8 + execution_actions * 1.2 + dependency_actions * 1.3 + output_actions * 0.8 + {days} * 0.6"
CANVAS = f""",
cev AS (SELECT person_id, canvas_id, day, ts, event, CASE WHEN {STRUCTURAL} THEN 1 ELSE 0 END AS is_structural, CASE WHEN {EXECUTION} THEN 1 ELSE 0 END AS is_execution,
  CASE WHEN {DEPENDENCY} THEN 1 ELSE 0 END AS is_dependency, CASE WHEN {OUTPUT} THEN 1 ELSE 0 END AS is_output, CASE WHEN {AGENT_BUILD} THEN 1 ELSE 0 END AS is_agent_build
  FROM tlog WHERE canvas_id IS NOT NULL),
cfirst AS (SELECT person_id, canvas_id, min(day) AS first_day FROM cev GROUP BY 1, 2),
cday AS (SELECT person_id, canvas_id, day, sum(is_structural) AS structural_actions, sum(is_execution) AS execution_actions, sum(is_dependency) AS dependency_actions,
  sum(is_output) AS output_actions, sum(is_agent_build) AS agent_build_actions FROM cev GROUP BY 1, 2, 3),
cscore AS (SELECT d.*, day = first_day AS is_first, CAST({SCORE.format(days='1')} AS DOUBLE) AS s FROM cday d JOIN cfirst USING (person_id, canvas_id)),
ctot AS (SELECT person_id, canvas_id, count(*) AS total_events, count(DISTINCT day) AS active_days, CAST(sum(is_structural) AS BIGINT) AS structural_actions,
  CAST(sum(is_execution) AS BIGINT) AS execution_actions, CAST(sum(is_dependency) AS BIGINT) AS dependency_actions, CAST(sum(is_output) AS BIGINT) AS output_actions,
  CAST(sum(is_agent_build) AS BIGINT) AS agent_build_actions FROM cev GROUP BY 1, 2),
cgrow AS (SELECT person_id, canvas_id, max(s) FILTER (is_first) AS first_day_score, COALESCE(avg(s) FILTER (NOT is_first), 0) AS later_avg_day_score,
  COALESCE(max(s) FILTER (NOT is_first), 0) AS later_max_day_score, count(*) FILTER (NOT is_first) AS later_active_days FROM cscore GROUP BY 1, 2),
cm AS (SELECT *, CAST({SCORE.format(days='active_days')} AS DOUBLE) AS complexity, CASE WHEN later_active_days > 0 THEN later_max_day_score - first_day_score ELSE 0 END AS growth_delta
  FROM ctot JOIN cgrow USING (person_id, canvas_id)),
ucanvas AS (SELECT person_id, count(*) AS canvases_touched, avg(complexity) AS avg_canvas_complexity, max(complexity) AS max_canvas_complexity,
  max(CASE WHEN active_days >= 2 THEN 1 ELSE 0 END) AS repeat_canvas_users, CAST(sum(CASE WHEN active_days >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS repeat_canvas_count,
  avg(CASE WHEN active_days >= 2 THEN growth_delta ELSE 0 END) AS avg_canvas_growth, avg(CASE WHEN growth_delta > 0 THEN 1.0 ELSE 0.0 END) AS share_of_canvases_with_growth,
  avg(active_days) AS avg_canvas_active_days, avg(CASE WHEN active_days >= 2 THEN later_max_day_score ELSE 0 END) AS avg_revisit_depth,
  avg(later_max_day_score) AS avg_later_max_complexity FROM cm GROUP BY 1)"""
UC = "canvases_touched avg_canvas_complexity max_canvas_complexity repeat_canvas_users repeat_canvas_count avg_canvas_growth share_of_canvases_with_growth avg_canvas_active_days avg_revisit_depth avg_later_max_complexity".split()
UC_INT = ("canvases_touched", "repeat_canvas_users", "repeat_canvas_count")

CHURN = f""",
span AS (SELECT person_id, min(ts) AS f, max(ts) AS l, (SELECT max(ts) FROM log) AS e FROM tlog GROUP BY 1),
proxy AS (SELECT person_id, {hours('e', 'f', 86400)} AS days_observed_after_signup, CASE WHEN {hours('e', 'f', 86400)} < 14 THEN 1 ELSE 0 END AS is_censored,
  CASE WHEN {hours('l', 'f', 86400)} < 14 AND {hours('e', 'f', 86400)} >= 14 THEN 1 ELSE 0 END AS is_churn FROM span),
sc AS (SELECT person_id, max(CASE WHEN event = 'agent_open_error_assist' THEN 1 ELSE 0 END) AS had_error_assist,
  count(*) FILTER (event IN ('credits_exceeded','credits_below_1','credits_below_2','credits_below_3','credits_below_4')) AS credit_warning_events FROM tlog GROUP BY 1)"""
TABLE = USERS + CANVAS + CHURN + f""",
ut0 AS (SELECT u.*, {', '.join(f'COALESCE({c}, 0) AS {c}' for c in UC)}, is_censored, is_churn, had_error_assist, credit_warning_events,
  least(greatest(recency_days / 120.0, 0), 1) AS recency_risk,
  COALESCE(is_censored = 0 AND (had_second_session = 1 OR days_active >= 2 OR manual_runs >= 1), false) AS covered
  FROM users u LEFT JOIN ucanvas USING (person_id) JOIN proxy USING (person_id) JOIN sc USING (person_id)),
ut AS (SELECT * EXCLUDE (is_churn, recency_risk, covered), CAST(covered AS INTEGER) AS in_churn_population,
  CASE WHEN covered THEN is_churn ELSE 0 END AS is_churn, CASE WHEN covered THEN recency_risk ELSE 0.0 END AS churn_probability FROM ut0)"""

RISK = "CASE WHEN {p} <= 0.2 THEN 'Low' WHEN {p} <= 0.5 THEN 'Medium' WHEN {p} <= 0.8 THEN 'High' ELSE 'Critical' END"


def mm(col: str, src: str = "ut") -> str:
    return f"COALESCE(({col} - (SELECT min({col}) FROM {src})) / NULLIF(CAST((SELECT max({col}) FROM {src}) - (SELECT min({col}) FROM {src}) AS DOUBLE), 0), 0)"


INTERVENTION = TABLE + f""",
sig AS (SELECT *, 0.30 * had_second_session + 0.20 * {mm('first_session_event_types')} + 0.20 * {mm('first_session_duration_min')} + 0.15 * first_session_had_agent + 0.15 * first_session_had_run AS a,
  0.35 * had_error_assist + 0.30 * {mm('credit_warning_events')} + 0.20 * had_credit_exceeded + 0.15 * {mm('credit_events')} AS s,
  0.35 * {mm('avg_canvas_complexity')} + 0.20 * repeat_canvas_users + 0.20 * {mm('avg_canvas_growth')} + 0.15 * {mm('avg_revisit_depth')} + 0.10 * share_of_canvases_with_growth AS m,
  churn_probability AS c FROM ut),
sig2 AS (SELECT *, least(greatest(a, 0), 1) AS activation_signal, least(greatest(s, 0), 1) AS struggle_signal, least(greatest(m, 0), 1) AS builder_momentum_signal, c AS churn_risk_signal FROM sig),
iv AS (SELECT *, least(greatest(0.35 * churn_risk_signal + 0.25 * struggle_signal + 0.20 * activation_signal + 0.20 * builder_momentum_signal, 0), 1) AS intervention_priority_score,
  CASE WHEN activation_signal < 0.35 AND had_second_session = 0 THEN 'Activation nudge' WHEN struggle_signal >= 0.45 AND builder_momentum_signal >= 0.25 THEN 'Productive struggle support'
   WHEN builder_momentum_signal >= 0.45 AND churn_risk_signal >= 0.45 THEN 'Builder acceleration' WHEN churn_risk_signal >= 0.60 THEN 'Retention rescue' ELSE 'Monitor' END AS recommended_intervention FROM sig2)"""

STRUGGLE_SET = "('agent_open_error_assist','credits_exceeded','credits_below_1','credits_below_2','credits_below_3','credits_below_4')"
RECOVERY_SET = "('run_block','run_all_blocks','agent_tool_call_run_block_tool','agent_tool_call_create_block_tool','agent_tool_call_refactor_block_tool','fullscreen_preview_output')"
RECOVERY = f""",
fs AS (SELECT person_id, min(ts) AS first_struggle_at, count(*) AS struggle_events, count(*) FILTER (event = 'agent_open_error_assist') AS error_assist_events,
  count(*) FILTER (event <> 'agent_open_error_assist') AS credit_struggle_events FROM tlog WHERE event IN {STRUGGLE_SET} GROUP BY 1),
post AS (SELECT t.person_id, t.event, t.day, {hours('t.ts', 'first_struggle_at', 3600)} AS h FROM tlog t JOIN fs USING (person_id) WHERE t.ts > first_struggle_at),
rec AS (SELECT person_id, count(*) AS any_post_struggle_event, count(*) FILTER (event IN {RECOVERY_SET}) AS recovery_events_post_struggle,
  max(CASE WHEN h <= 24 THEN 1 ELSE 0 END) AS recovered_within_24h, count(*) FILTER (h <= 24) AS events_within_24h, count(DISTINCT day) AS active_days_after_struggle,
  min(h) FILTER (event IN {RECOVERY_SET}) AS hours_to_first_recovery FROM post GROUP BY 1),
sr AS (SELECT fs.*, COALESCE(any_post_struggle_event, 0) AS any_post_struggle_event, COALESCE(recovery_events_post_struggle, 0) AS recovery_events_post_struggle,
  COALESCE(recovered_within_24h, 0) AS recovered_within_24h, COALESCE(events_within_24h, 0) AS events_within_24h, COALESCE(active_days_after_struggle, 0) AS active_days_after_struggle,
  hours_to_first_recovery FROM fs LEFT JOIN rec USING (person_id))"""
STRUGGLE = INTERVENTION + RECOVERY + f""",
sj AS (SELECT iv.*, COALESCE(struggle_events, 0) AS struggle_events, COALESCE(recovery_events_post_struggle, 0) AS recovery_events_post_struggle, COALESCE(recovered_within_24h, 0) AS recovered_within_24h,
  COALESCE(events_within_24h, 0) AS events_within_24h, COALESCE(active_days_after_struggle, 0) AS active_days_after_struggle FROM iv LEFT JOIN sr USING (person_id)),
sq0 AS (SELECT *, least(1, 0.35 * recovered_within_24h + 0.25 * {mm('recovery_events_post_struggle', 'sj')} + 0.20 * {mm('active_days_after_struggle', 'sj')} + 0.20 * {mm('avg_revisit_depth', 'sj')}) AS recovery_intensity,
  least(1, 0.45 * churn_probability + 0.25 * (1 - recovered_within_24h) + 0.15 * (1 - {mm('events_within_24h', 'sj')}) + 0.15 * (1 - {mm('active_days_after_struggle', 'sj')})) AS abandonment_risk_after_struggle FROM sj),
sq1 AS (SELECT *, least(1, 0.55 * recovery_intensity + 0.25 * builder_momentum_signal + 0.20 * activation_signal) AS quality_of_struggle_score, CASE WHEN struggle_events > 0 THEN 1 ELSE 0 END AS had_struggle_signal FROM sq0),
sq AS (SELECT *, CASE WHEN had_struggle_signal = 0 THEN 'No visible struggle' WHEN quality_of_struggle_score >= 0.45 AND abandonment_risk_after_struggle < 0.45 THEN 'Productive struggle'
  WHEN abandonment_risk_after_struggle >= 0.6 THEN 'Abandonment-prone struggle' ELSE 'Mixed/uncertain struggle' END AS struggle_class FROM sq1)"""

CES = USERS + """,
sesn AS (SELECT person_id, session_id, count(*) AS n FROM tlog WHERE session_id IS NOT NULL GROUP BY 1, 2),
depth AS (SELECT person_id, avg(n) AS avg_session_depth FROM sesn GROUP BY 1),
eng AS (SELECT person_id, count(*) FILTER (event IN ('run_block','run_all_blocks','run_from_block','run_upto_block')) AS total_code_runs, count(*) FILTER (event = 'agent_block_created') AS agent_blocks_created,
  count(*) FILTER (event = 'agent_accept_suggestion') AS agent_suggestions_accepted, count(*) FILTER (starts_with(event, 'agent_')) AS agent_total_events,
  max(CASE WHEN event = 'requirements_build' THEN 1 ELSE 0 END) AS requirements_built FROM tlog GROUP BY 1),
ces0 AS (SELECT *, CASE WHEN total_code_runs >= 1 AND agent_blocks_created >= 1 THEN 1 ELSE 0 END AS c1_depth, CASE WHEN days_active >= 3 THEN 1 ELSE 0 END AS c2_retention,
  CASE WHEN requirements_built >= 1 OR previewed_output >= 1 THEN 1 ELSE 0 END AS c3_complexity, CASE WHEN agent_suggestions_accepted >= 1 THEN 1 ELSE 0 END AS c4_ai_adoption,
  CASE WHEN total_code_runs >= 3 THEN 1 ELSE 0 END AS c5_reproducibility FROM users JOIN eng USING (person_id) LEFT JOIN depth USING (person_id)),
ces AS (SELECT * EXCLUDE (avg_session_depth), COALESCE(avg_session_depth, 0) AS avg_session_depth, CAST(c1_depth + c2_retention + c3_complexity + c4_ai_adoption + c5_reproducibility AS INTEGER) AS ces_score,
  CASE WHEN c1_depth + c2_retention + c3_complexity + c4_ai_adoption + c5_reproducibility >= 2 THEN 1 ELSE 0 END AS is_success,
  least(1, days_active / 30.0) AS success_probability FROM ces0)"""
CRITERIA = ("c1_depth", "c2_retention", "c3_complexity", "c4_ai_adoption", "c5_reproducibility")


def grams(ctes: str, source: str, n: int, part: str, order: str = "ts, event_id", token: str = "token") -> str:
    """CTE ``gr``: all n-grams of ``source`` with its person."""
    leads = ", ".join(f"lead({token}, {i}) OVER w AS t{i + 1}" for i in range(1, n))
    names = ", ".join(["t1"] + [f"t{i}" for i in range(2, n + 1)])
    return ctes + f""",
gr AS (SELECT *, concat_ws(' -> ', {names}) AS gram FROM (SELECT *, {token} AS t1, {leads} FROM {source} WINDOW w AS (PARTITION BY {part} ORDER BY {order})) WHERE t{n} IS NOT NULL)"""


def lift(name: str, ctes: str, source: str, n: int, part: str, focal: str, users: str, minc: int, minb: int, k: int) -> tuple[str, str]:
    """CTEs that end in table ``name`` with the top-k lift rows."""
    leads = ", ".join(f"lead(token, {i}) OVER w AS t{i + 1}" for i in range(1, n))
    names = ", ".join(["t1"] + [f"t{i}" for i in range(2, n + 1)])
    sql = ctes + f""",
{name}_g AS (SELECT person_id, concat_ws(' -> ', {names}) AS gram FROM (SELECT *, token AS t1, {leads} FROM {source} WINDOW w AS (PARTITION BY {part} ORDER BY ts, event_id)) WHERE t{n} IS NOT NULL),
{name}_c AS (SELECT gram, count(*) FILTER ({focal}) AS fc, count(*) FILTER (NOT ({focal})) AS bc FROM {name}_g JOIN {users} USING (person_id) GROUP BY 1),
{name}_t AS (SELECT CAST(greatest(sum(fc), 1) AS DOUBLE) AS ft, CAST(greatest(sum(bc), 1) AS DOUBLE) AS bt, CAST(count(*) AS DOUBLE) AS v FROM {name}_c),
{name} AS (SELECT gram AS ngram, {n} AS n, fc AS focal_count, bc AS baseline_count, fc / ft AS focal_support, bc / bt AS baseline_support,
  ((fc + 1.0) / (ft + v)) / ((bc + 1.0) / (bt + v)) AS lift, CASE WHEN bc >= {minb} THEN 1 ELSE 0 END AS publishable
  FROM {name}_c, {name}_t WHERE fc >= {minc} ORDER BY round(lift, 9) DESC, fc DESC, gram LIMIT {k})"""
    return sql, name


LIFT_COLS = ("ngram, n, focal_count, baseline_count, publishable", "focal_support; baseline_support; lift")
TOK = USERS + f""", tok AS (SELECT person_id, ts, event_id, {UNIFIED} AS token FROM tlog)"""
CALLS = USERS + f""", tc AS (SELECT person_id, ts, event_id, event, {LABEL} AS token FROM tlog WHERE (event IN {TOOL_EVENTS} OR tool_name IS NOT NULL) AND tool IS NOT NULL AND tool <> 'Coder Agent')"""


def numbered(source: str, gap: int, name: str = "num") -> str:
    return f""",
{name}0 AS (SELECT *, {hours('ts', 'lag(ts) OVER (PARTITION BY person_id ORDER BY ts, event_id)', 60)} AS gap_min FROM {source}),
{name} AS (SELECT *, CAST(sum(CASE WHEN gap_min IS NULL OR gap_min > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS num_session FROM {name}0)"""


TSESS = CALLS + numbered("tc", 30) + f""",
ts1 AS (SELECT person_id, num_session AS session_num, count(DISTINCT token) AS tool_diversity, count(*) FILTER (token IN ('CREATE','REFACTOR')) AS build_calls, count(*) FILTER (token = 'RUN') AS run_calls,
  count(*) AS total_calls, max(CASE WHEN token = 'FINISH' THEN 1 ELSE 0 END) AS has_finish, CAST(sum(CASE token WHEN 'CREATE' THEN 1 WHEN 'REFACTOR' THEN 2 WHEN 'FINISH' THEN 3 ELSE 0 END) AS BIGINT) AS depth,
  {hours('max(ts)', 'min(ts)', 60)} AS duration_min FROM num GROUP BY 1, 2)"""


def paths(n: int) -> str:
    steps = ", ".join(f"max(c) FILTER (o = {i}) AS step_{i}" for i in range(1, n + 1))
    return USERS + f""",
cat AS (SELECT person_id, ts, event_id, {CATEGORY} AS c FROM tlog),
ded AS (SELECT *, lag(c) OVER (PARTITION BY person_id ORDER BY ts, event_id) AS b FROM cat),
ded2 AS (SELECT person_id, c, row_number() OVER (PARTITION BY person_id ORDER BY ts, event_id) AS o FROM ded WHERE b IS NULL OR b <> c),
pth0 AS (SELECT person_id, {steps} FROM ded2 WHERE o <= {n} GROUP BY 1),
pth AS (SELECT *, concat_ws(' -> ', {', '.join(f'step_{i}' for i in range(1, n + 1))}) AS path FROM pth0 LEFT JOIN (SELECT person_id, segment FROM users) USING (person_id))"""


def step_mix(n: int, segments: tuple, top: int, none: bool = False) -> str:
    parts = " UNION ALL ".join(f"SELECT segment, {i} AS step, step_{i} AS event FROM pth" for i in range(1, n + 1))
    event = "COALESCE(event, 'NONE')" if none else "event"
    inside = ", ".join(f"'{s}'" for s in segments)
    return paths(n) + f""",
stp AS (SELECT segment, step, {event} AS event FROM ({parts}) WHERE segment IN ({inside})),
mix AS (SELECT segment, step, event, count(*) AS users FROM stp WHERE event IS NOT NULL GROUP BY 1, 2, 3),
mix2 AS (SELECT *, users * 100.0 / sum(users) OVER (PARTITION BY segment, step) AS pct, CAST(row_number() OVER (PARTITION BY segment, step ORDER BY users DESC, event) AS INTEGER) AS rank FROM mix)"""


def branches(a: str, b: str, min_users: int, name: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT segment, {i} AS prefix_len, concat_ws(' -> ', {', '.join(f'step_{j}' for j in range(1, i + 1))}) AS prefix, step_{i + 1} AS next_event FROM pth" for i in range(1, 5)
    )
    return f""",
{name}0 AS (SELECT prefix_len, prefix, next_event, count(*) AS users, {seg(a)} AS pa, {seg(b)} AS pb, {AB} AS overall FROM ({parts}) WHERE next_event IS NOT NULL GROUP BY 1, 2, 3),
{name} AS (SELECT * FROM (SELECT *, sum(users) OVER (PARTITION BY prefix_len, prefix) AS pu FROM {name}0) WHERE pu >= {min_users})"""


def km(users_cte: str, source: str, group: str, min_users: int = 1) -> str:
    ctes = users_cte + f""",
att AS (SELECT {group} AS g, greatest(days_active, 1) AS t, count(*) AS leaving, CAST(sum(CASE WHEN days_active >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS d FROM {source} GROUP BY 1, 2),
risk AS (SELECT *, sum(leaving) OVER (PARTITION BY g) AS n_users, sum(leaving) OVER (PARTITION BY g ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS at_risk FROM att),
crv AS (SELECT *, product(1.0 - CAST(d AS DOUBLE) / at_risk) OVER (PARTITION BY g ORDER BY t ROWS UNBOUNDED PRECEDING) AS s,
  sum(CASE WHEN at_risk > d THEN CAST(d AS DOUBLE) / (CAST(at_risk AS DOUBLE) * (at_risk - d)) ELSE 0 END) OVER (PARTITION BY g ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM risk WHERE n_users >= {min_users}),
ev AS (SELECT g, t, s, n_users, at_risk, CASE WHEN s > 0 AND s < 1 THEN exp(ln(s) * exp(-1.96 * sqrt(v) / ln(s))) END AS lo, CASE WHEN s > 0 AND s < 1 THEN exp(ln(s) * exp(1.96 * sqrt(v) / ln(s))) END AS hi FROM crv WHERE d > 0),
kmc AS (SELECT g, 0 AS t, 1.0 AS s, max(n_users) AS n_users, max(n_users) AS at_risk, NULL AS lo, NULL AS hi FROM ev GROUP BY g UNION ALL SELECT g, t, s, n_users, at_risk, lo, hi FROM ev)"""
    return out(ctes, "kmc", 'g AS "group", CAST(t AS BIGINT) AS timeline, CAST(n_users AS BIGINT) AS n_users, CAST(at_risk AS BIGINT) AS at_risk', "survival: s; ci_low: lo; ci_high: hi")


KTH = USERS + f""",
su AS (SELECT person_id, COALESCE(min(ts) FILTER (event = 'sign_up'), min(ts)) AS signup_at FROM tlog GROUP BY 1),
bd AS (SELECT person_id, ts, row_number() OVER (PARTITION BY person_id ORDER BY ts, event_id) AS o FROM tlog WHERE {BUILD}),
kth AS (SELECT person_id, least(greatest({hours('bd.ts', 'signup_at', 86400)}, 0), 120) AS days FROM su JOIN bd USING (person_id) WHERE o = 3)"""
KTH_COLS = (
    "mean_days: avg(days); min_days: min(days); max_days: max(days); "
    + "; ".join(f"pct_within_{d}d: {pct(f'days <= {d}')}" for d in (1, 3, 7, 14, 30, 60))
    + "; p25_days: quantile_cont(days, 0.25); median_days: quantile_cont(days, 0.5); p75_days: quantile_cont(days, 0.75); p90_days: quantile_cont(days, 0.9)"
)
DESCRIBE = "mean: avg({v}); std: stddev_samp({v}); min: min({v}); p25: quantile_cont({v}, 0.25); p50: quantile_cont({v}, 0.5); p75: quantile_cont({v}, 0.75); max: max({v})"


def describe(v: str) -> str:
    return DESCRIBE.format(v=f"CAST({v} AS DOUBLE)")


MILE = LOG + f""",
f0 AS (SELECT person_id, min(ts) AS f FROM tlog GROUP BY 1),
w48 AS (SELECT t.person_id, event, {hours('ts', 'f', 3600)} AS h FROM tlog t JOIN f0 USING (person_id) WHERE {hours('ts', 'f', 3600)} <= 48),
ms AS (SELECT person_id, max(CASE WHEN event IN {RUNS} THEN 1 ELSE 0 END) AS ran_code_48h, max(CASE WHEN event IN ('agent_new_chat','agent_start_from_prompt') THEN 1 ELSE 0 END) AS opened_agent_48h,
  max(CASE WHEN event IN {TOOL_EVENTS} THEN 1 ELSE 0 END) AS used_agent_tool_48h, max(CASE WHEN event = 'agent_tool_call_create_block_tool' THEN 1 ELSE 0 END) AS created_block_48h,
  max(CASE WHEN event = 'agent_tool_call_refactor_block_tool' THEN 1 ELSE 0 END) AS refactored_48h,
  CASE WHEN count(*) FILTER (event IN ('agent_tool_call_create_block_tool','agent_tool_call_refactor_block_tool')) >= 3 THEN 1 ELSE 0 END AS reached_3_build_48h,
  max(CASE WHEN event IN ('fullscreen_open','fullscreen_preview_output') THEN 1 ELSE 0 END) AS fullscreen_48h, CASE WHEN max(h) >= 12 THEN 1 ELSE 0 END AS returned_within_48h,
  CASE WHEN count(*) >= 10 THEN 1 ELSE 0 END AS had_10plus_events_48h, CASE WHEN count(DISTINCT event) >= 5 THEN 1 ELSE 0 END AS had_5plus_event_types FROM w48 GROUP BY 1)"""
MILES = "ran_code_48h opened_agent_48h used_agent_tool_48h created_block_48h refactored_48h reached_3_build_48h fullscreen_48h returned_within_48h had_10plus_events_48h had_5plus_event_types".split()


def contrast(ctes: str, source: str, flags, target: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{f}' AS milestone, {f} AS did, CASE WHEN {target} THEN 1 ELSE 0 END AS y FROM {source}" for f in flags)
    ctes += f""",
lng AS ({parts}),
con AS (SELECT milestone, COALESCE(avg(y * 100.0) FILTER (did = 1), 0) AS a, COALESCE(avg(y * 100.0) FILTER (did = 0), 0) AS b, {pct('did = 1')} AS reach, count(*) FILTER (did = 1) AS n_did FROM lng GROUP BY 1)"""
    return out(ctes, "con", "milestone, n_did", "pct_if_did: a; pct_if_not: b; pct_users: reach; lift: CASE WHEN b = 0 THEN 999 ELSE a / b END")


def cases(ctes: str, source: str, rows: list[tuple[str, str]], tail: str = "") -> str:
    return "WITH " + ctes + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT {cols} FROM {source}" for cols, _ in rows) + f") {tail}"


def rd(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def funnel_sql(ctes: str, source: str, steps: list[tuple[str, str]]) -> str:
    parts = " UNION ALL ".join(f"SELECT {i} AS position, '{n}' AS step, count(*) FILTER ({c}) AS users FROM {source}" for i, (n, c) in enumerate(steps))
    ctes += f", st AS ({parts}), st2 AS (SELECT *, first_value(users) OVER (ORDER BY position) AS f, lag(users) OVER (ORDER BY position) - users AS l FROM st)"
    return out(ctes, "st2", "position, step, users, COALESCE(l, 0) AS lost", "pct_of_first: users * 100.0 / NULLIF(f, 0); lost_pct_of_first: COALESCE(l * 100.0 / NULLIF(f, 0), 0)")


def crosstab(row: str, column: str, values) -> str:
    cols = "; ".join(f"{v}: count(*) FILTER ({column} = '{v}') * 100.0 / NULLIF(count(*) FILTER ({column} IN ({', '.join(repr(x) for x in values)})), 0)" for v in values)
    return out(USERS, "users", row, cols, group="1")


def heat(ctes: str, key: str, metrics, source: str) -> str:
    return out(ctes, source, key, "; ".join(f"{m}: CASE WHEN (SELECT max({m}) FROM {source}) > 0 THEN {m} / (SELECT max({m}) FROM {source}) ELSE 0 END" for m in metrics))


SEGSUM = """avg_days_active: avg(days_active); avg_manual_runs: avg(manual_runs); avg_agent_tools: avg(agent_tool_calls_total); avg_build_calls: avg(agent_build_calls);
 avg_run_calls: avg(agent_run_calls); avg_conversations: avg(agent_conversations); avg_canvases: avg(unique_canvases)"""
KPI = f"""avg_days_active: avg(days_active); median_days_active: quantile_cont(days_active, 0.5); avg_manual_runs: avg(manual_runs); avg_agent_tools: avg(agent_tool_calls_total);
 avg_agent_build: avg(agent_build_calls); avg_conversations: avg(agent_conversations); avg_canvases: avg(unique_canvases); avg_tool_types: avg(agent_tool_types_used);
 avg_unique_event_types: avg(unique_event_types); pct_multi_day: {pct('days_active >= 3')}; pct_week_plus: {pct('days_active >= 7')}; pct_credit_exceeded: {pct('had_credit_exceeded = 1')};
 pct_addon_credits: {pct('had_addon_credits = 1')}; pct_ever_agent: {pct('ever_used_agent = 1')}; pct_early_adopter: {pct('adopted_agent_early = 1')}"""


def inline(items: str) -> str:
    return ", ".join(f"{e.strip()} AS {a.strip()}" for a, _, e in (i.partition(":") for i in items.split(";")))


BURN = USERS + """,
cu AS (SELECT person_id, count(*) AS n FROM tlog WHERE event IN ('credits_used','addon_credits_used') GROUP BY 1),
burn AS (SELECT person_id, segment, signup_cohort, days_active, COALESCE(n, 0) AS credit_uses, COALESCE(n, 0) / CAST(greatest(days_active, 1) AS DOUBLE) AS burn_rate FROM users LEFT JOIN cu USING (person_id))"""
GEO = TABLE + f""",
cc AS (SELECT person_id, country_code, count(*) AS n FROM tlog WHERE country_code IS NOT NULL GROUP BY 1, 2),
cmode AS (SELECT person_id, country_code FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY n DESC, country_code) AS o FROM cc) WHERE o = 1),
geo0 AS (SELECT ut.*, COALESCE(country_code, 'Unknown') AS country_code FROM ut LEFT JOIN cmode USING (person_id)),
geo AS (SELECT *, {REGION} AS region_group FROM geo0)"""
GEOM = GEO + f""",
gm0 AS (SELECT country_code, {REGION} AS region_group, count(*) AS users, {AB} AS pct_agent_builder, {pct('ever_used_agent = 1')} AS pct_ever_agent, {pct('had_second_session = 1')} AS pct_repeat_session,
  avg(avg_canvas_complexity) AS avg_canvas_complexity, avg(avg_canvas_growth) AS avg_canvas_growth, avg(credit_events) AS avg_credit_events, avg(signup_hour) AS avg_signup_hour,
  avg(churn_probability) AS avg_churn_probability, {pct('is_churn = 1')} AS actual_churn_pct, count(*) FILTER (segment = 'Agent Builder') AS k, CAST(count(*) AS DOUBLE) AS n FROM geo GROUP BY 1, 2),
gm AS (SELECT *, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS ctr, 1.96 * sqrt((k / n * (1 - k / n) + 1.96 * 1.96 / (4 * n)) / n) / (1 + 1.96 * 1.96 / n) AS mar FROM gm0)"""
SIGNUPS = LOG + """, sg AS (SELECT *, hour(ts) AS h FROM tlog WHERE event = 'sign_up' AND country_code IS NOT NULL)"""


def value_counts(column: str, top: int | None = None) -> str:
    ctes = LOG + f", vc AS (SELECT {column} AS value, count(*) AS n FROM tlog WHERE {column} IS NOT NULL GROUP BY 1)"
    return out(ctes, "vc", "value, n", "pct: n * 100.0 / (SELECT sum(n) FROM vc)", tail=f"ORDER BY n DESC, value LIMIT {top}" if top else "")


FEATURE_COLS = {
    "volume_features": ("volume", "person_id, total_events, unique_event_types, days_active, unique_sessions, first_seen, last_seen, signup_cohort", "tenure_days"),
    "canvas_features": ("canvas", "person_id, unique_canvases, repeat_canvas_count_raw", "primary_canvas_event_share; one_day_canvas_share"),
    "manual_features": ("counted", "person_id, manual_runs, manual_run_days", ""),
    "agent_start_features": ("counted", "person_id, agent_conversations, agent_messages, agent_start_days", ""),
    "agent_tool_features": ("counted", "person_id, agent_tool_calls_total, agent_tool_types_used, agent_tool_call_days, " + ", ".join("tool_" + t for t in TOOLS)
                            + ", agent_build_calls, agent_run_calls, agent_inspect_calls, agent_finish_calls, agent_delete_calls", ""),
    "tool_transition_features": ("trans", "person_id, create_run_transitions, run_refactor_transitions, finish_summary_transitions, agent_tool_transitions_total",
                                 "create_run_alternation_rate: CAST(create_run_transitions AS DOUBLE) / agent_tool_transitions_total; refactor_after_run_rate: CAST(run_refactor_transitions AS DOUBLE) / agent_tool_transitions_total; finish_summary_rate: CAST(finish_summary_transitions AS DOUBLE) / agent_tool_transitions_total"),
    "output_features": ("counted", "person_id, fullscreen_opens, previewed_output", ""),
    "onboarding_features": ("counted", "person_id, signed_up, completed_onboarding, skipped_onboarding_form, submitted_onboarding, sign_in_count", ""),
    "time_to_first_features": ("ttf2", "person_id, adopted_agent_early, ever_used_agent, ever_ran_manually", "ttf_manual_run_min; ttf_agent_tool_min; ttf_agent_chat_min"),
    "credit_recency_features": ("counted JOIN volume USING (person_id)", "person_id, credit_events, had_credit_exceeded, had_addon_credits", "recency_days: " + hours("(SELECT max(ts) FROM log)", "last_seen", 86400)),
    "first_session_features": ("natu", "person_id, first_session_events, first_session_event_types, first_session_had_agent, first_session_had_run", "first_session_duration_min"),
    "return_features": ("natu", "person_id, had_second_session", "time_to_return_hours"),
    "session_structure_features": ("struc", "person_id, productive_sessions, total_sessions_derived, max_events_per_session", "productive_session_share"),
    "signup_time_features": ("ttf2", "person_id, signup_hour, signup_dow, signup_is_weekend", ""),
}
MODEL_COLUMNS = """ttf_manual_run_min ttf_agent_tool_min ttf_agent_chat_min adopted_agent_early ever_used_agent ever_ran_manually signed_up skipped_onboarding_form
 submitted_onboarding completed_onboarding first_session_events first_session_event_types first_session_duration_min first_session_had_agent first_session_had_run
 had_second_session time_to_return_hours signup_hour signup_is_weekend ref_google ref_github ref_linkedin ref_twitter ref_direct ref_other""".split()
DOUBLE_FEATURES = """tenure_days ttf_manual_run_min ttf_agent_tool_min ttf_agent_chat_min recency_days primary_canvas_event_share one_day_canvas_share create_run_alternation_rate
 refactor_after_run_rate finish_summary_rate first_session_duration_min time_to_return_hours productive_session_share""".split()


def matched_sql(match: str) -> dict[str, str]:
    """The effect on matched pairs. ``match``: the sequential pairs on the recency score."""
    outcomes = {
        "Agent Builder %": "CASE WHEN {u}.segment = 'Agent Builder' THEN 100.0 ELSE 0.0 END", "Active days": "{u}.days_active",
        "Returned %": "CASE WHEN {u}.had_second_session = 1 THEN 100.0 ELSE 0.0 END", "Propensity score": "round({u}.churn_probability, 4)",
    }
    effect = " UNION ALL ".join(
        f"SELECT '{n}' AS outcome, count(*) AS pairs, {rd(f'avg({e.format(u="a")})')} AS treated_mean, {rd(f'avg({e.format(u="b")})')} AS control_mean, "
        f"{rd(f'avg({e.format(u="a")}) - avg({e.format(u="b")})')} AS difference FROM mt JOIN ut a ON a.person_id = tid JOIN ut b ON b.person_id = cid HAVING count(*) > 10"
        for n, e in outcomes.items()
    )
    return {
        "model_persistence": out(USERS, "users", "person_id, true AS same_score"),
        "recency_matched_effect": f"WITH {match} {effect}",
    }


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    # ------------------------------------------------------------------ sources
    sql["usage_log_adapter"] = f"WITH {USAGE_LOG} SELECT * FROM log"
    sql["orders_log_adapter"] = f"WITH {ORDERS_LOG} SELECT * FROM olog"
    sql["conversation_tokens"] = f"WITH {TOKENS} SELECT * FROM tokens"
    sql["csv_event_source"] = out(
        LOG, "tlog", "event, count(*) AS events, count(*) FILTER (event_id % 2 = 0) AS flagged, max(ts) AS last_ts, count(session_id) AS with_session", where="event_id % 97 <> 0", group="1")
    sql["feature_table_sinks"] = out(VOLUME, "volume", "person_id, total_events, total_events AS csv_events, days_active", "tenure_days")
    names = "person_id event_id event ts created_at distinct_id tool_name message_id session_id pathname lib country_code device_type referrer".split()
    examples = {"event_id": "CAST(event_id AS VARCHAR)", "ts": "regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0+$', '')", "created_at": "regexp_replace(strftime(created_at, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0+$', '')"}
    sql["profile_columns"] = f"WITH {LOG} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS filled, {rd(f'count({c}) * 100.0 / count(*)')} AS fill_pct, COALESCE(substr(min({examples.get(c, c)}), 1, 40), '-') AS example FROM tlog" for c in names)
    # ------------------------------------------------------------------ derivations
    sql["event_derivations"] = out(LOG, "tlog", f"tool, canvas_id, {UNIFIED} AS unified_event, {CATEGORY} AS category, {BUILD} AS is_build, count(*) AS n", group="1, 2, 3, 4, 5")
    sql["place_derivations"] = out(LOG, "tlog", f"country_code, {REGION} AS region, {CGROUP} AS country_group, {REFCLASS} AS referrer_class, {band('hour(ts)')} AS band, count(*) AS n", group="1, 2, 3, 4, 5")
    points = f"CASE {LABEL} WHEN 'CREATE' THEN 1 WHEN 'REFACTOR' THEN 2 WHEN 'FINISH' THEN 3 ELSE 0 END"
    sql["tool_labels"] = out(LOG, "tlog", f"tool, {LABEL} AS label, count(*) AS n, CAST(sum({points}) AS BIGINT) AS points", where="tool IS NOT NULL AND tool <> 'Coder Agent'", group="1, 2")
    sql["canvas_action_flags"] = out(LOG, "tlog", "event, " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in (
        ("is_structural", STRUCTURAL), ("is_execution", EXECUTION), ("is_dependency", DEPENDENCY), ("is_output", OUTPUT), ("is_agent_build", AGENT_BUILD))), group="1")
    sql["unified_session_ids"] = out(VOLUME, "sess", "person_id, CASE WHEN length(trim(session_id)) > 0 THEN 'web::' || session_id ELSE 'derived::' || CAST(CAST(session_num AS BIGINT) AS VARCHAR) END AS unified_session_id, count(*) AS events", group="1, 2")
    sql["user_cohort_labels"] = out(USERS, "users", f"adoption_cohort, {RETURN} AS return_cohort, {WEEKEND} AS weekend, {band('signup_hour')} AS band, count(*) AS users", group="1, 2, 3, 4")
    six = LOG + numbered("tlog", 360)
    sql["session_phases"] = out(six, "num", "person_id, CASE WHEN num_session = 1 THEN '1. session' WHEN num_session <= 3 THEN '2-3. session' ELSE '4+ session' END AS phase, count(*) AS events", group="1, 2")
    # ------------------------------------------------------------------ sessions, features
    sql["sessionize"] = out(VOLUME, "sess", "person_id, event_id, CAST(session_num AS BIGINT) AS session_num")
    sql["sessionize_six_hours"] = out(six, "num", "person_id, event_id, num_session AS session_num")
    sql["session_table"] = out(VOLUME, "sess", "person_id, CAST(session_num AS BIGINT) AS session_num, min(ts) AS start, max(ts) AS finish, count(*) AS events", group="1, 2")
    for name, (source, plain, doubles) in FEATURE_COLS.items():
        sql[name] = out(VOLUME, source, plain, doubles)
    sql["referrer_features"] = out(FEATURES, "refs", "*")
    sql["feature_matrix"] = out(USERS, "users", f"* EXCLUDE ({', '.join(DOUBLE_FEATURES)})", "; ".join(DOUBLE_FEATURES))
    # ------------------------------------------------------------------ segments
    sql["segment_summary"] = out(USERS, "users", "segment, count(*) AS users", SEGSUM + "; pct_credit_exceeded: avg(had_credit_exceeded); pct_of_users: count(*) * 100.0 / (SELECT count(*) FROM users)", group="segment")
    seg_cte = USERS + f", ss AS (SELECT segment, {inline(SEGSUM)} FROM users GROUP BY 1)"
    sql["segment_profile"] = heat(seg_cte, "segment", ("avg_days_active", "avg_manual_runs", "avg_agent_tools", "avg_build_calls", "avg_run_calls", "avg_canvases"), "ss")
    sql["kpi_matrix"] = out(USERS, "users", "segment, count(*) AS users", KPI + "; pct_of_users: count(*) * 100.0 / (SELECT count(*) FROM users)", group="segment")
    sql["kpi_heat"] = heat(USERS + f", kp AS (SELECT segment, {inline(KPI)} FROM users GROUP BY 1)", "segment", (
        "avg_days_active", "avg_manual_runs", "avg_agent_tools", "avg_agent_build", "avg_canvases", "pct_multi_day", "pct_week_plus", "pct_credit_exceeded", "pct_ever_agent", "pct_early_adopter"), "kp")
    sql["kpi_by_cohort"] = out(USERS, "users", "signup_cohort, count(*) AS users", f"avg_days_active: avg(days_active); avg_agent_tools: avg(agent_tool_calls_total); pct_agent_builder: {AB}; pct_agent_runner: {seg('Agent Runner')}; pct_power_user: {POWER}; pct_ghost: {GH}; pct_ever_agent: {pct('ever_used_agent = 1')}", group="1")
    sql["success_by_segment"] = out(USERS, "users", "segment, count(*) AS users", f"avg_days: avg(days_active); median_days: quantile_cont(days_active, 0.5); avg_agent_tools: avg(agent_tool_calls_total); avg_build_calls: avg(agent_build_calls); avg_tool_types: avg(agent_tool_types_used); pct_multi_day: {pct('days_active >= 3')}; pct_credit_exceeded: {pct('had_credit_exceeded = 1')}; pct_returned: {pct('had_second_session = 1')}; avg_first_sess_events: avg(first_session_events)", group="segment")
    # ------------------------------------------------------------------ canvas
    canv = LOG + CANVAS
    sql["canvas_complexity"] = out(canv, "cm", "person_id, canvas_id, total_events, active_days, structural_actions, execution_actions, dependency_actions, output_actions, agent_build_actions", "canvas_complexity_score: complexity")
    sql["first_vs_later_days"] = out(canv, "cm", "person_id, canvas_id, later_active_days", "first_day_score; later_avg_day_score; later_max_day_score; growth_delta")
    sql["user_canvas_features"] = out(canv + ", pp AS (SELECT DISTINCT person_id FROM tlog)", "pp LEFT JOIN ucanvas USING (person_id)", "person_id, " + ", ".join(f"COALESCE({c}, 0) AS {c}" for c in UC_INT), "; ".join(f"{c}: COALESCE({c}, 0)" for c in UC if c not in UC_INT))
    sql["canvas_growth_by_segment"] = out(TABLE, "ut", "segment, count(*) AS users", "avg_growth: avg(avg_canvas_growth); pct_growth: avg(share_of_canvases_with_growth) * 100.0", group="segment")
    sql["repeat_canvas_retention"] = out(TABLE, "ut", "CASE WHEN repeat_canvas_users = 1 THEN 'Repeat canvas' ELSE 'One-off canvas' END AS repeat_canvas_label, count(*) AS users", f"avg_days_active: avg(days_active); repeat_session_pct: {pct('had_second_session = 1')}; agent_builder_pct: {AB}", group="1")
    # ------------------------------------------------------------------ survival, timing
    sql["survival_by_segment"] = km(USERS, "(SELECT * FROM users WHERE segment IN ('Agent Builder', 'Manual Coder', 'Viewer'))", "segment", 10)
    sql["survival_by_return"] = km(USERS, "users", RETURN)
    sql["survival_by_adoption"] = km(USERS, "users", "adoption_cohort")
    sql["survival_of_order_days"] = km(ORDERS_LOG + ", od AS (SELECT person_id, count(DISTINCT CAST(ts AS DATE)) AS days_active FROM olog GROUP BY 1)", "od", "'all'")
    sql["time_to_third_build"] = out(KTH, "kth", "person_id", "days_to_kth: days")
    sql["time_to_third_build_summary"] = out(KTH, "kth", "count(*) AS users", KTH_COLS)
    sql["time_to_third_build_by_cohort"] = out(KTH, "kth JOIN users USING (person_id)", "signup_cohort, count(*) AS users", KTH_COLS, group="1")
    urgent = ORDERS_LOG + ", o1 AS (SELECT person_id, min(ts) AS f FROM olog GROUP BY 1), o3 AS (SELECT person_id, ts, row_number() OVER (PARTITION BY person_id ORDER BY ts, event_id) AS o FROM olog WHERE event = '1-URGENT')"
    sql["time_to_third_urgent_order"] = out(urgent, "o1 JOIN o3 USING (person_id)", "person_id", f"days_to_kth: least(greatest({hours('ts', 'f', 86400)}, 0), 2000)", where="o = 3")
    sql["milestone_flags"] = out(MILE, "ms", "*")
    sql["milestone_lift"] = contrast(USERS + MILE[len(LOG):], "(SELECT * FROM ms LEFT JOIN (SELECT person_id, segment FROM users) USING (person_id))", MILES, "segment = 'Agent Builder'")
    sql["onboarding_contrast"] = contrast(CES, "ces", ("completed_onboarding", "skipped_onboarding_form", "submitted_onboarding"), "is_success = 1")
    # ------------------------------------------------------------------ sequences
    sql["role_trigrams"] = out(grams(TOKENS, "tokens", 3, "seq_id", "pos"), "gr", "gram, count(*) AS occurrences", group="1")
    for name, n, k, segs in (("tool_bigrams_by_segment", 2, 8, SEGMENTS[:4]), ("builder_tool_trigrams", 3, 10, SEGMENTS[:1])):
        ctes = grams(CALLS, "tc", n, "person_id") + f""", sgc AS (SELECT segment, gram, count(*) AS occurrences FROM gr JOIN users USING (person_id) WHERE segment IN ({', '.join(repr(s) for s in segs)}) GROUP BY 1, 2),
 sgr AS (SELECT *, CAST(row_number() OVER (PARTITION BY segment ORDER BY occurrences DESC, gram) AS INTEGER) AS rank FROM sgc)"""
        sql[name] = out(ctes, "sgr", "*", where=f"rank <= {k}")
    ctes, name = lift("lf", TOK, "tok", 3, "person_id", "segment = 'Agent Builder'", "users", 3, 2, 40)
    sql["ngram_lift"] = out(ctes, name, *LIFT_COLS)
    motif = TABLE + f""", tok AS (SELECT person_id, ts, event_id, {UNIFIED} AS token FROM tlog), ttok AS (SELECT * FROM tok WHERE starts_with(token, 'tool_')){numbered('tok', 30)},
 cut AS (SELECT *, avg_canvas_complexity >= (SELECT quantile_cont(avg_canvas_complexity, 0.5) FROM ut) AS high FROM ut)"""
    specs = (("m1", "tok", 3, "person_id", "segment = 'Agent Builder'", "ut", "Agent Builder motifs"), ("m2", "tok", 2, "person_id", "segment = 'Ghost'", "ut", "Ghost motifs"),
             ("m3", "num", 2, "person_id, num_session", "is_churn = 1", "ut", "Churn motifs"), ("m4", "ttok", 3, "person_id", "high", "cut", "High complexity tool motifs"))
    for cte, source, n, part, focal, users, _ in specs:
        motif, _ = lift(cte, motif, source, n, part, focal, users, 5, 3, 20)
    motif += ", mt AS (" + " UNION ALL ".join(f"SELECT *, '{label}' AS comparison FROM {cte}" for cte, *_, label in specs) + ")"
    sql["motif_tables"] = out(motif, "mt", LIFT_COLS[0] + ", comparison", LIFT_COLS[1])
    motif = TOK
    pairs = tuple(zip(("s1", "s2", "s3", "s4"), ("Agent Builder", "Manual Coder", "Viewer", "Ghost")))
    for cte, segment in pairs:
        motif, _ = lift(cte, motif, "tok", 2, "person_id", f"segment = '{segment}'", "users", 5, 3, 5)
    motif += ", mt AS (" + " UNION ALL ".join(f"SELECT * FROM (SELECT *, '{segment}' AS segment FROM {cte} WHERE publishable = 1 ORDER BY round(lift, 9) DESC, focal_count DESC, ngram LIMIT 3)" for cte, segment in pairs) + ")"
    sql["segment_motifs"] = out(motif, "mt", LIFT_COLS[0] + ", segment", LIFT_COLS[1])
    inside = ", ".join(repr(s) for s in STATES)
    ctes = grams(CALLS, "tc", 2, "person_id") + f", tm AS (SELECT t1, t2, count(*) AS n FROM gr JOIN users USING (person_id) WHERE segment = 'Agent Builder' AND t1 IN ({inside}) AND t2 IN ({inside}) GROUP BY 1, 2)"
    sql["transition_matrix"] = out(ctes, "tm", "t1 AS from_tool", "; ".join(f"{s}: COALESCE(sum(n) FILTER (t2 = '{s}'), 0) * 100.0 / sum(n)" for s in STATES), group="1")
    ctes = CALLS + """, sgc AS (SELECT segment, token AS tool, count(*) AS calls FROM tc LEFT JOIN users USING (person_id) GROUP BY 1, 2),
 ld AS (SELECT tool FROM sgc GROUP BY 1 ORDER BY sum(calls) DESC, tool LIMIT 8), kp AS (SELECT sgc.* FROM sgc JOIN ld USING (tool) WHERE segment IN ('Agent Builder','Agent Runner','Ghost'))"""
    sql["tool_mix"] = out(ctes, "kp", "segment, tool, calls", "pct: calls * 100.0 / sum(calls) OVER (PARTITION BY segment)")
    ctes = USERS + ", mn AS (" + " UNION ALL ".join(f"SELECT segment, 'tool_{t}' AS tool, avg(tool_{t}) AS v FROM users GROUP BY 1" for t in TOOLS) + "), ld AS (SELECT tool FROM mn GROUP BY 1 ORDER BY sum(v) DESC, tool LIMIT 6)"
    sql["mean_tool_calls"] = out(ctes, "mn JOIN ld USING (tool)", "segment, tool", "avg_calls: v")
    ctes = CALLS + numbered("tc", 30) + """, ph AS (SELECT CASE WHEN num_session = 1 THEN '1. session' WHEN num_session <= 3 THEN '2-3. session' ELSE '4+ session' END AS phase, token AS tool, count(*) AS calls
 FROM num JOIN users USING (person_id) WHERE segment = 'Agent Builder' GROUP BY 1, 2), ph2 AS (SELECT *, calls * 100.0 / sum(calls) OVER (PARTITION BY phase) AS pct FROM ph),
 ld AS (SELECT tool FROM ph GROUP BY 1 ORDER BY sum(calls) DESC, tool LIMIT 7)"""
    sql["phase_tool_mix"] = out(ctes, "ph2 JOIN ld USING (tool)", "phase, tool, calls", "pct")
    sql["tool_sessions"] = out(TSESS.replace("gap_min > 30", "gap_min > 360"), "ts1", "person_id, session_num, tool_diversity, build_calls, run_calls, total_calls, has_finish, depth", "duration_min")
    sql["session_progression"] = out(TSESS, "ts1 JOIN users USING (person_id)", "session_num, segment, count(*) AS n_sessions", "avg_diversity: avg(tool_diversity); avg_build: avg(build_calls); avg_total: avg(total_calls); avg_duration: avg(duration_min)", where="session_num <= 10", group="1, 2")
    sql["depth_by_session"] = out(TSESS, "ts1 JOIN users USING (person_id)", "session_num, count(*) AS n", "avg_depth: avg(depth)", where="session_num <= 10 AND segment = 'Agent Builder'", group="1")
    sql["user_paths"] = out(paths(5), "pth", "*")
    sql["path_step_mix"] = out(step_mix(5, ("Agent Builder", "Viewer", "Ghost"), 5), "mix2", "segment, step, event, users, rank", "pct", where="rank <= 5")
    sql["path_top_step"] = out(step_mix(8, ("Agent Builder", "Ghost", "Manual Coder"), 1), "mix2", "segment, step, event, users, rank", "pct", where="rank <= 1")
    sql["path_divergence"] = out(step_mix(3, ("Agent Builder", "Ghost"), 5, True), "mix2", "segment, step, event, users, rank", "pct", where="rank <= 5")
    sql["branch_table"] = out(paths(5) + branches("Agent Builder", "Ghost", 5, "br"), "br", "prefix_len, prefix, next_event, users", "pct_agent_builder: pa; pct_ghost: pb; overall_pct_ab: overall; branch_gap: pa - pb")
    both = paths(5) + branches("Agent Builder", "Ghost", 3, "b1") + branches("Agent Builder", "Viewer", 3, "b2") + ", bb AS (SELECT *, 'Agent Builder vs Ghost' AS comparison FROM b1 UNION ALL SELECT *, 'Agent Builder vs Viewer' AS comparison FROM b2)"
    bcols = ("prefix_len, prefix, next_event, users, comparison", "pct_agent_builder: pa; pct_other: pb; overall_pct_ab: overall; branch_gap: pa - pb")
    sql["branch_comparison"] = out(both, "bb", *bcols)
    sql["top_branches"] = out(both, "bb", *bcols, tail="ORDER BY pa - pb DESC, users DESC, comparison, prefix, next_event LIMIT 20")
    tp = paths(5) + ", tp AS (SELECT segment, path, count(*) AS users FROM pth WHERE segment IN ('Agent Builder','Viewer','Ghost') GROUP BY 1, 2), tpr AS (SELECT *, CAST(row_number() OVER (PARTITION BY segment ORDER BY users DESC, path) AS INTEGER) AS rank FROM tp)"
    sql["top_paths"] = out(tp, "tpr", "*", where="rank <= 8")
    # ------------------------------------------------------------------ reports
    sql["funnel"] = funnel_sql(USERS, "users", [("Registered", "signed_up >= 1"), ("Ran code manually", "manual_runs >= 1"), ("Started agent chat", "agent_conversations >= 1"), ("Used agent tool", "agent_tool_calls_total >= 1"), ("Agent built", "agent_build_calls >= 1"), ("5+ active days", "days_active >= 5")])
    sql["activation_funnel"] = funnel_sql(USERS, "users", [("Registered", "true"), ("Ran >=1 tool", "agent_tool_calls_total > 0"), ("Used AI agent", "ever_used_agent = 1"), ("Agent Builder", "segment = 'Agent Builder'")])
    steps = (("ran_code", "manual_runs >= 1"), ("used_tool", "agent_tool_calls_total >= 1"), ("built", "agent_build_calls >= 1"), ("five_days", "days_active >= 5"))
    sql["funnel_by_cohort"] = out(USERS, "users", "signup_cohort, count(*) AS registered, " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in steps), "; ".join(f"{n}_pct: {pct(c)}" for n, c in steps), group="1")
    stages = "sign_up skip_onboarding_form canvas_onboarding_tour_finished block_create run_block agent_new_chat agent_accept_suggestion agent_block_created requirements_build fullscreen_preview_output".split()
    sql["event_funnel"] = f"WITH {LOG} " + " UNION ALL ".join(f"SELECT {i} AS position, '{e}' AS stage, count(DISTINCT person_id) FILTER (event = '{e}') AS users FROM tlog" for i, e in enumerate(stages))
    sql["cohort_summary"] = out(USERS, "users", "signup_cohort, count(*) AS users", f"avg_days_active: avg(days_active); avg_manual_runs: avg(manual_runs); avg_agent_tools: avg(agent_tool_calls_total); avg_canvases: avg(unique_canvases); avg_conversations: avg(agent_conversations); pct_ever_agent: {pct('ever_used_agent = 1')}; pct_early_adopter: {pct('adopted_agent_early = 1')}; pct_credit_exceeded: {pct('had_credit_exceeded = 1')}; median_tenure_days: quantile_cont(tenure_days, 0.5)", group="1")
    sql["segment_by_cohort"] = crosstab("signup_cohort", "segment", SEGMENTS)
    sql["adoption_by_cohort"] = crosstab("signup_cohort", "adoption_cohort", ADOPTION)
    adopt = f"avg_days_active: avg(days_active); avg_manual_runs: avg(manual_runs); avg_agent_tools: avg(agent_tool_calls_total); avg_build_calls: avg(agent_build_calls); avg_canvases: avg(unique_canvases); pct_credit_exceeded: {pct('had_credit_exceeded = 1')}"
    sql["adoption_summary"] = out(USERS, "users", "adoption_cohort, count(*) AS users", adopt + "; median_tenure: quantile_cont(tenure_days, 0.5); pct_of_users: count(*) * 100.0 / (SELECT count(*) FROM users)", group="1")
    sql["adoption_profile"] = heat(USERS + f", ad AS (SELECT adoption_cohort, {inline(adopt)} FROM users GROUP BY 1)", "adoption_cohort", ("avg_days_active", "avg_manual_runs", "avg_agent_tools", "avg_build_calls", "avg_canvases", "pct_credit_exceeded"), "ad")
    sql["adoption_by_segment"] = f"WITH {USERS} " + " UNION ALL ".join(f"SELECT segment, '{a}' AS adoption_cohort, count(*) FILTER (adoption_cohort = '{a}') AS users FROM users WHERE segment <> 'Ghost' GROUP BY segment" for a in ADOPTION)
    bucket = "CASE WHEN ttf_agent_tool_min < 15 THEN '<15 min' WHEN ttf_agent_tool_min < 60 THEN '15-60 min' WHEN ttf_agent_tool_min < 240 THEN '1-4 hours' WHEN ttf_agent_tool_min < 1440 THEN '4-24 hours' WHEN ttf_agent_tool_min < 10080 THEN '1-7 days' END"
    border = "CASE WHEN ttf_agent_tool_min < 15 THEN 0 WHEN ttf_agent_tool_min < 60 THEN 1 WHEN ttf_agent_tool_min < 240 THEN 2 WHEN ttf_agent_tool_min < 1440 THEN 3 ELSE 4 END"
    sql["adoption_timing"] = out(USERS, "users", f"{bucket} AS bucket, {border} AS bucket_order, " + ", ".join(f"count(*) FILTER (segment = '{s}') AS \"{s}\"" for s in SEGMENTS), where="ever_used_agent = 1 AND ttf_agent_tool_min < 10080", group="1, 2")
    sql["first_run_distribution"] = out(USERS, "users", "segment, count(*) AS n", describe("least(ttf_manual_run_min, 1440)"), where="ttf_manual_run_min <> 0", group="segment", tail="HAVING count(*) >= 6")
    sql["active_day_distribution"] = out(USERS, "users", "segment, count(*) AS n", describe("least(days_active, 30)"), group="segment", tail="HAVING count(*) >= 3")
    sql["canvas_complexity_distribution"] = out(TABLE, "ut", "segment, count(*) AS n", describe("avg_canvas_complexity"), group="segment")
    sql["signup_hour_stats"] = out(USERS, "users", "signup_hour, count(*) AS users, count(*) FILTER (segment = 'Agent Builder') AS agent_builders", f"pct_ab: {AB}; pct_ghost: {GH}; pct_agent_user: {pct('ever_used_agent = 1')}; avg_first_sess: avg(first_session_events)", where="signup_hour >= 0", group="1")
    sql["hour_band_stats"] = out(USERS, "users", f"{band('signup_hour')} AS time_category, count(*) AS users", f"pct_ab: {AB}; pct_ghost: {GH}; avg_first_sess: avg(first_session_events); pct_returned: {pct('had_second_session = 1')}", where="signup_hour >= 0", group="1")
    sql["weekend_stats"] = out(USERS + f", wk AS (SELECT *, {WEEKEND} AS w FROM users)", "wk", "w AS signup_is_weekend, count(*) AS users", f"pct_ab: {AB}; pct_ghost: {GH}; avg_first: avg(first_session_events); pct_ret: {pct('had_second_session = 1')}", group="w")
    sql["return_cohort_stats"] = out(USERS, "users", f"{RETURN} AS return_cohort, count(*) AS users", f"pct_ab: {AB}; avg_days: avg(days_active)", group="1")

    def sweep(t: int) -> str:
        early, late = f"had_second_session = 1 AND time_to_return_hours <= {t}", f"had_second_session = 1 AND time_to_return_hours > {t}"
        rate = "COALESCE(avg(CASE WHEN segment = 'Agent Builder' THEN 100.0 ELSE 0.0 END) FILTER ({}), 0)"
        return f"{t} AS threshold_h, count(*) FILTER ({early}) AS n_early, {rd(rate.format(early))} AS pct_ab_early, count(*) FILTER ({late}) AS n_late, {rd(rate.format(late))} AS pct_ab_late"

    sql["return_threshold_sweep"] = cases(USERS, "users", [(sweep(t), "") for t in (6, 12, 24, 48, 72, 168)])
    sql["build_threshold_sweep"] = "WITH " + USERS + " SELECT threshold, users, avg_days, avg_tool_calls FROM (" + " UNION ALL ".join(
        f"SELECT {t} AS threshold, count(*) FILTER (agent_build_calls >= {t}) AS users, {rd(f'avg(days_active) FILTER (agent_build_calls >= {t})')} AS avg_days, {rd(f'avg(agent_tool_calls_total) FILTER (agent_build_calls >= {t})')} AS avg_tool_calls, count(*) FILTER (agent_build_calls < {t} AND agent_build_calls > 0) AS below FROM users" for t in range(1, 10)) + ") WHERE users > 0 AND below > 0"
    defs = (("Agent Builder (>=3 build calls)", "agent_build_calls >= 3"), ("Any agent use", "ever_used_agent = 1"), ("5+ active days", "days_active >= 5"), ("Manual runs (>=3)", "manual_runs >= 3"), ("Returned (second session)", "had_second_session = 1"))
    sql["definition_compare"] = cases(USERS, "users", [(f"'{n}' AS definition, {rd(pct(c))} AS pct_of_users, {rd(f'avg(days_active) FILTER ({c})')} AS avg_days, {rd(f'avg(agent_tool_calls_total) FILTER ({c})')} AS avg_tools, {rd(f'avg(had_credit_exceeded * 100.0) FILTER ({c})')} AS pct_credit", "") for n, c in defs])
    sql["segment_separability"] = out(USERS, "users", "person_id, segment, least(greatest(first_session_events, 0), 50) AS first_sess_clip", "time_to_return_clip: least(greatest(time_to_return_hours, 0), 200)", where="segment IN ('Agent Builder','Manual Coder','Viewer')")
    cp = USERS + ", cp AS (SELECT COALESCE(avg(had_credit_exceeded) FILTER (segment = 'Agent Builder'), 0) AS b, COALESCE(avg(had_credit_exceeded) FILTER (segment = 'Ghost'), 0) AS g FROM users)"
    sql["credit_pressure_ratio"] = out(cp, "cp", "", "builder_rate: b; ghost_rate: g; pressure_ratio: b / greatest(g, 0.001)")
    ch = SIGNUPS + ", ld AS (SELECT country_code FROM sg GROUP BY 1 ORDER BY count(*) DESC, country_code LIMIT 6), chm AS (SELECT country_code, CAST(h AS INTEGER) AS hour, count(*) AS signups FROM sg JOIN ld USING (country_code) GROUP BY 1, 2)"
    sql["country_hour_matrix"] = out(ch, "chm", "country_code, hour, signups", "pct: signups * 100.0 / sum(signups) OVER (PARTITION BY hour)")
    nd = SIGNUPS + """, nd AS (SELECT CASE WHEN h BETWEEN 0 AND 5 THEN 'night' ELSE 'day' END AS period, country_code, count(*) AS signups FROM sg WHERE h BETWEEN 0 AND 5 OR h BETWEEN 9 AND 17 GROUP BY 1, 2),
 nd2 AS (SELECT *, signups * 100.0 / sum(signups) OVER (PARTITION BY period) AS p, CAST(row_number() OVER (PARTITION BY period ORDER BY signups DESC, country_code) AS INTEGER) AS rank FROM nd)"""
    sql["night_day_countries"] = out(nd, "nd2", "period, country_code, signups, rank", "pct: p", where="rank <= 8")
    fc = USERS + """, fc AS (SELECT person_id, country_code FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY ts, country_code) AS o FROM tlog WHERE event = 'sign_up' AND country_code IS NOT NULL) WHERE o = 1),
 fu AS (SELECT segment, ever_used_agent, country_code FROM users LEFT JOIN fc USING (person_id))"""
    sql["country_stats"] = out(fc, "fu", f"{CGROUP} AS country_group, count(*) AS users", f"pct_ab: {AB}; pct_ghost: {GH}; pct_agent: {pct('ever_used_agent = 1')}", group="1")
    sql["geo_metrics"] = out(GEOM, "gm", "country_code, region_group, users", "pct_agent_builder; pct_ever_agent; pct_repeat_session; avg_canvas_complexity; avg_canvas_growth; avg_credit_events; avg_signup_hour; avg_churn_probability; actual_churn_pct; agent_builder_ci_low: greatest(0, ctr - mar) * 100; agent_builder_ci_high: least(1, ctr + mar) * 100")
    rates = (("pct_ever_agent", "ever_used_agent = 1"), ("pct_repeat_session", "had_second_session = 1"), ("pct_onboarding_complete", "completed_onboarding = 1"), ("pct_agent_builder", "segment = 'Agent Builder'"))
    sql["region_metrics"] = f"WITH {GEO} " + " UNION ALL ".join(f"SELECT region_group, count(*) AS users, '{n}' AS metric, {rd(pct(c))} AS value FROM geo WHERE country_code <> 'Unknown' GROUP BY 1" for n, c in rates)
    gh = GEOM + ", el AS (SELECT * FROM gm WHERE users >= 4)"
    sql["geo_heat"] = out(gh, "el", "country_code", "; ".join(f"{c}: {mm(c, 'el')}" for c in ("avg_canvas_complexity", "avg_churn_probability", "avg_credit_events", "pct_repeat_session")))
    sql["geo_segment_mix"] = out(GEOM + ", ld AS (SELECT country_code FROM gm WHERE users >= 4 ORDER BY users DESC, country_code LIMIT 10)", "geo JOIN ld USING (country_code)", "country_code, " + ", ".join(f"count(*) FILTER (segment = '{s}') AS \"{s}\"" for s in ("Agent Builder", "Manual Coder", "Viewer", "Ghost")), group="1")
    sql["user_country_mode"] = out(GEO, "cmode", "*")
    sql["credit_burn"] = out(BURN, "burn", "person_id, segment, signup_cohort, days_active, credit_uses", "burn_rate")
    sql["burn_by_segment"] = out(BURN, "burn", "segment, count(*) AS users", f"avg_burn: avg(burn_rate); pct_any_burn: {pct('credit_uses > 0')}; median_burn: quantile_cont(burn_rate, 0.5)", group="segment")
    bb = "CASE WHEN burn_rate <= 0 THEN '0 (none)' WHEN burn_rate <= 5 THEN '1-5' WHEN burn_rate <= 20 THEN '6-20' WHEN burn_rate <= 50 THEN '21-50' WHEN burn_rate <= 100 THEN '51-100' ELSE '100+' END"
    sql["burn_by_bucket"] = out(BURN, "burn", f"{bb} AS burn_bucket, count(*) AS users", f"pct_ab: {AB}", group="1")
    sql["burn_distribution"] = out(BURN, "burn", "segment, count(*) AS n", describe("least(burn_rate, 200)"), where="burn_rate <> 0", group="segment", tail="HAVING count(*) >= 3")
    ea = USERS + ", ea AS (SELECT u.*, CASE WHEN person_id IN (SELECT person_id FROM tlog WHERE event = 'agent_open_error_assist') THEN 1 ELSE 0 END AS had_error_assist FROM users u)"
    sql["error_assist_contrast"] = out(ea, "ea", "had_error_assist, count(*) AS users", "; ".join(f"pct_{s.lower().replace(' ', '_')}: {seg(s)}" for s in SEGMENTS) + "; avg_days: avg(days_active); avg_tools: avg(agent_tool_calls_total)", group="1")
    et = LOG + f", et0 AS (SELECT person_id, min(ts) AS f, min(ts) FILTER (event = 'agent_open_error_assist') AS e FROM tlog GROUP BY 1), et AS (SELECT least(greatest({hours('e', 'f', 3600)}, 0), 720) AS h FROM et0 WHERE e IS NOT NULL)"
    sql["error_timing"] = out(et, "et", "count(*) AS n", describe("h"))
    sql["log_overview"] = out(LOG, "tlog", "count(*) AS events, min(ts) AS first_event, max(ts) AS last_event, count(*) FILTER (ts IS NULL) AS missing_times, count(DISTINCT person_id) AS users, count(DISTINCT distinct_id) AS browser_ids, count(DISTINCT event) AS event_types")
    sql["event_counts"], sql["lib_split"], sql["device_split"] = value_counts("event", 40), value_counts("lib"), value_counts("device_type")
    sql["hourly_volume"] = out(LOG, "tlog", "date_trunc('hour', ts) AS hour, count(*) AS events", group="1")
    sql["country_volume"] = out(LOG, "tlog", "country_code, count(DISTINCT distinct_id) AS users, count(*) AS events", where="country_code IS NOT NULL", group="1")
    sd = LOG + ", sd AS (SELECT count(*) AS n FROM tlog WHERE session_id IS NOT NULL GROUP BY session_id)"
    calls = LOG + f", tc AS (SELECT person_id, tool, count(*) AS calls FROM tlog WHERE event IN {TOOL_EVENTS} AND tool IS NOT NULL AND length(tool) > 0 GROUP BY 1, 2)"
    sql["tool_call_counts"] = out(calls, "tc", "*")
    one = lambda t: f"CAST(COALESCE(sum(calls) FILTER (tool = '{t}'), 0) AS BIGINT) AS tool_{t}"
    sql["tool_call_columns"] = out(calls, "tc", f"person_id, {one('create_block_tool')}, {one('run_block_tool')}, CAST(COALESCE(sum(calls) FILTER (tool NOT IN ('create_block_tool', 'run_block_tool')), 0) AS BIGINT) AS tool_other", group="1")
    sql["report_sinks"] = f"WITH {LOG} SELECT 'events' AS report, event AS value, count(*) AS n FROM tlog WHERE event IS NOT NULL GROUP BY 2 UNION ALL SELECT 'libs', lib, count(*) FROM tlog WHERE lib IS NOT NULL GROUP BY 2"
    sql["session_depth"] = out(sd, "sd", "count(*) AS n", describe("sd.n"))
    # ------------------------------------------------------------------ labels, scores
    inact = "{c}, la AS (SELECT person_id, max(ts) AS last_active_at, (SELECT max(ts) FROM {s}) AS observation_end FROM {s} GROUP BY 1)"
    for name, ctes, horizon in (("churn_label_inactivity", inact.format(c=LOG, s="tlog"), 14), ("churn_label_order_silence", inact.format(c=ORDERS_LOG, s="olog"), 365)):
        d = hours("observation_end", "last_active_at", 86400)
        sql[name] = out(ctes, "la", f"person_id, last_active_at, observation_end, CASE WHEN {d} < {horizon} THEN 1 ELSE 0 END AS is_censored, CASE WHEN {d} >= {horizon} THEN 1 ELSE 0 END AS is_churn", f"days_until_end: {d}")
    sql["churn_label_survival_proxy"] = out(LOG + CHURN, "proxy", "person_id, is_censored, is_churn", "days_observed_after_signup")
    sql["churn_population"] = out(TABLE, "ut", "segment, count(*) AS users", f"churn_pct: {pct('is_churn = 1')}", where="is_censored = 0 AND (had_second_session = 1 OR days_active >= 2 OR manual_runs >= 1)", group="segment")
    sql["risk_summary"] = out(TABLE, "ut", f"{RISK.format(p='churn_probability')} AS churn_risk_bucket, count(*) AS users", f"avg_probability: avg(churn_probability); actual_churn_pct: {pct('is_churn = 1')}; avg_days_active: avg(days_active); avg_canvas_complexity: avg(avg_canvas_complexity)", where="in_churn_population = 1", group="1")
    pri = "CASE WHEN intervention_priority_score <= 0.25 THEN 'Low' WHEN intervention_priority_score <= 0.5 THEN 'Medium' WHEN intervention_priority_score <= 0.75 THEN 'High' ELSE 'Critical' END"
    sql["intervention_scores"] = out(INTERVENTION, "iv", f"person_id, recommended_intervention, {pri} AS intervention_priority_bucket, {RISK.format(p='intervention_priority_score')} AS intervention_risk_bucket, {RISK.format(p='churn_risk_signal')} AS churn_risk_bucket", "activation_signal; struggle_signal; builder_momentum_signal; churn_risk_signal; intervention_priority_score")
    sql["intervention_summary"] = out(INTERVENTION, "iv", "recommended_intervention, count(*) AS users", f"avg_priority: avg(intervention_priority_score); avg_churn_risk: avg(churn_risk_signal); avg_activation: avg(activation_signal); avg_struggle: avg(struggle_signal); avg_builder_momentum: avg(builder_momentum_signal); pct_agent_builder: {AB}", group="1")
    sql["top_interventions"] = out(INTERVENTION, "iv", "person_id, segment, recommended_intervention", "intervention_priority_score: iv.intervention_priority_score; activation_signal; churn_risk_signal; struggle_signal; builder_momentum_signal", tail="ORDER BY iv.intervention_priority_score DESC, person_id LIMIT 25")
    sql["struggle_recovery"] = out(LOG + RECOVERY, "sr", "* EXCLUDE (hours_to_first_recovery)", "hours_to_first_recovery")
    sql["struggle_quality"] = out(STRUGGLE, "sq", "person_id, had_struggle_signal, struggle_class", "recovery_intensity; abandonment_risk_after_struggle; quality_of_struggle_score")
    sql["struggle_summary"] = out(STRUGGLE, "sq", "struggle_class, count(*) AS users", f"avg_quality_score: avg(quality_of_struggle_score); avg_abandonment_risk: avg(abandonment_risk_after_struggle); avg_recovery_intensity: avg(recovery_intensity); avg_churn_probability: avg(churn_probability); avg_builder_momentum: avg(builder_momentum_signal); pct_agent_builder: {AB}", group="1")
    sql["ces_label"] = out(CES, "ces", f"person_id, {', '.join(CRITERIA)}, ces_score, is_success")
    sql["ces_hit_rates"] = f"WITH {CES} " + " UNION ALL ".join(f"SELECT '{c}' AS criterion, CAST(sum({c}) AS BIGINT) AS users, {rd(pct(f'{c} = 1'))} AS pct FROM ces" for c in (*CRITERIA, "is_success"))
    sql["ces_distribution"] = out(CES, "ces", "ces_score, count(*) AS users, max(is_success) AS is_success", group="1")
    sql["ces_correlation"] = f"WITH {CES} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {rd(f'covar_pop({a}, {b}) / NULLIF(stddev_pop({a}) * stddev_pop({b}), 0)')} AS r FROM ces" for i, a in enumerate(CRITERIA) for b in CRITERIA[i:])
    prof = "days_active total_code_runs agent_total_events unique_canvases agent_suggestions_accepted avg_session_depth".split()
    sql["ces_profile"] = f"WITH {CES} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {rd(f'avg({c}) FILTER (is_success = 1) / quantile_cont({c}, 0.95)')} AS success, {rd(f'avg({c}) FILTER (is_success = 0) / quantile_cont({c}, 0.95)')} AS other FROM ces HAVING quantile_cont({c}, 0.95) <> 0" for c in prof)
    tv = "CASE WHEN ttf_manual_run_min < 5 THEN '<5m' WHEN ttf_manual_run_min < 15 THEN '5-15m' WHEN ttf_manual_run_min < 30 THEN '15-30m' WHEN ttf_manual_run_min < 60 THEN '30-60m' WHEN ttf_manual_run_min < 120 THEN '1-2h' WHEN ttf_manual_run_min < 240 THEN '2-4h' WHEN ttf_manual_run_min < 480 THEN '4-8h' WHEN ttf_manual_run_min < 10080 THEN '>8h' ELSE 'clipped (1w+)' END"
    sql["time_to_value_curve"] = out(CES, "ces", f"{tv} AS bucket, count(*) AS users", f"success_pct: {pct('is_success = 1')}", where="ttf_manual_run_min > 0", group="1")
    fw = "CASE WHEN agent_total_events <= 0 THEN '0 (none)' WHEN agent_total_events <= 1 THEN '1' WHEN agent_total_events <= 5 THEN '2-5' WHEN agent_total_events <= 20 THEN '6-20' WHEN agent_total_events <= 100 THEN '21-100' ELSE '100+' END"
    sql["volume_flywheel"] = out(CES, "ces", f"{fw} AS bucket, count(*) AS users", f"success_pct: {pct('is_success = 1')}; avg_code_runs: avg(total_code_runs)", group="1")
    advice = """list_filter([CASE WHEN c1_depth = 0 AND total_code_runs = 0 THEN 'Run your first code block.' WHEN c1_depth = 0 THEN 'Try creating an agent block.' END,
 CASE WHEN c2_retention = 0 THEN 'Come back over multiple days.' END, CASE WHEN c3_complexity = 0 THEN 'Add requirements to the canvas or open the fullscreen preview.' END,
 CASE WHEN c4_ai_adoption = 0 THEN 'Accept an agent suggestion.' END, CASE WHEN c5_reproducibility = 0 THEN 'Run the canvas several times.' END], lambda x: x IS NOT NULL)"""
    bs = CES + f""", bs AS (SELECT *, success_probability >= 0.5 AS is_success_predicted, CASE WHEN success_probability >= 0.75 THEN 'High' WHEN success_probability >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence,
 CASE WHEN success_probability >= 0.65 THEN 'Power User' WHEN success_probability >= 0.35 THEN 'Explorer' WHEN total_events <= 3 THEN 'Ghost User' ELSE 'Early Adopter' END AS archetype, {advice} AS adv FROM ces)"""
    sql["batch_score"] = out(bs, "bs", f"person_id, is_success_predicted, confidence, archetype, {', '.join(CRITERIA)}, ces_score, CASE WHEN len(adv) = 0 THEN ['On track: explore the advanced features.'] ELSE adv[1:3] END AS recommendations", "success_probability")
    sql["batch_summary"] = out(bs, "bs", "count(*) AS total_users, count(*) FILTER (is_success_predicted) AS predicted_success, count(*) FILTER (archetype = 'Power User') AS power_users, count(*) FILTER (archetype = 'Explorer') AS explorers, count(*) FILTER (archetype = 'Ghost User') AS ghost_users", "avg_probability: avg(success_probability)")
    sql["headline_rates"] = out(TABLE, "ut", "count(*) AS users, count(*) FILTER (segment = 'Agent Builder') AS agent_builders, count(*) FILTER (segment = 'Ghost') AS ghosts", f"pct_agent: {pct('ever_used_agent = 1')}; pct_return: {pct('had_second_session = 1')}; pct_early: {pct('adopted_agent_early = 1')}; churn_rate: avg(CASE WHEN is_churn = 1 THEN 100.0 ELSE 0.0 END) FILTER (in_churn_population = 1)")
    sql["dashboard_segments"] = out(USERS, "users", "segment, count(*) AS users", f"avg_days: avg(days_active); avg_tools: avg(agent_tool_calls_total); avg_builds: avg(agent_build_calls); pct_return: {pct('had_second_session = 1')}; pct_credit: {pct('had_credit_exceeded = 1')}; pct_of_users: count(*) * 100.0 / (SELECT count(*) FROM users)", group="segment")
    sql["dashboard_cohorts"] = out(USERS, "users", "signup_cohort, count(*) AS users", f"pct_ab: {AB}; pct_agent: {pct('ever_used_agent = 1')}; avg_tools: avg(agent_tool_calls_total)", group="1")
    # ------------------------------------------------------------------ model inputs and curves
    lab = USERS + ", lb AS (SELECT *, CASE WHEN segment = 'Agent Builder' THEN 1.0 ELSE 0.0 END AS label FROM users)"
    sql["balanced_weights"] = out(lab, "lb", "count(*) AS users", "label; weight: (SELECT count(*) FROM lb) / (2.0 * count(*))", group="label")
    sql["label_correlation"] = f"WITH {lab} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {rd(f'covar_pop({c}, label) / NULLIF(stddev_pop({c}) * stddev_pop(label), 0)')} AS r FROM lb" for c in MODEL_COLUMNS)
    curve = TABLE + """, sc2 AS (SELECT round(churn_probability, 2) AS t, CAST(sum(is_churn) AS BIGINT) AS pos, CAST(sum(1 - is_churn) AS BIGINT) AS neg FROM ut GROUP BY 1),
 cv AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, CAST(sum(pos) OVER () AS BIGINT) AS positives, CAST(sum(neg) OVER () AS BIGINT) AS negatives FROM sc2
 WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING))"""
    sql["score_curve"] = out(curve, "cv", "pos, neg, tp, fp, positives, negatives", "threshold: t; tpr: tp / CAST(NULLIF(positives, 0) AS DOUBLE); fpr: fp / CAST(NULLIF(negatives, 0) AS DOUBLE); precision: tp / CAST(NULLIF(tp + fp, 0) AS DOUBLE)")
    pairs = TABLE + """, s0 AS (SELECT round(churn_probability, 2) AS t, is_churn AS y FROM ut),
 a1 AS (SELECT avg(CASE WHEN p.t > q.t THEN 1.0 WHEN p.t = q.t THEN 0.5 ELSE 0.0 END) AS auc FROM s0 p JOIN s0 q ON p.y = 1 AND q.y = 0)""" + curve[len(TABLE):]
    sql["score_quality"] = out(pairs, "cv", "", "auc: (SELECT auc FROM a1); average_precision: sum(pos / CAST(NULLIF(positives, 0) AS DOUBLE) * tp / (tp + fp))")
    match = TABLE.replace("shaped AS (", "RECURSIVE shaped AS (", 1) + """, pm AS MATERIALIZED (SELECT person_id AS id, round(churn_probability, 4) AS ps, ever_used_agent AS t FROM ut),
 tr AS MATERIALIZED (SELECT id, ps, row_number() OVER (ORDER BY id) AS o FROM pm WHERE t = 1), co AS MATERIALIZED (SELECT id, ps FROM pm WHERE t = 0),
 gr AS (SELECT CAST(0 AS BIGINT) AS o, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS tid, CAST(NULL AS VARCHAR) AS cid
  UNION ALL SELECT o, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, tid, best FROM (
   SELECT tr.o AS o, gr.used AS used, tr.id AS tid, (SELECT arg_min(co.id, (abs(co.ps - tr.ps), co.ps, co.id)) FROM co WHERE abs(co.ps - tr.ps) <= 0.05 AND NOT list_contains(gr.used, co.id)) AS best
   FROM gr JOIN tr ON tr.o = gr.o + 1)),
 mt AS (SELECT gr.tid, gr.cid, abs(a.ps - b.ps) AS gap FROM gr JOIN pm a ON a.id = gr.tid JOIN pm b ON b.id = gr.cid)"""
    sql["caliper_match"] = out(match, "mt", "tid AS treated_id, cid AS control_id", "score_gap: gap")
    conf = TABLE + ", cf AS (SELECT is_churn AS a, CASE WHEN churn_probability >= 0.5 THEN 1 ELSE 0 END AS p FROM ut)"
    sql["confusion_matrix"] = out(conf, "cf", "a AS actual, p AS predicted, count(*) AS users", group="1, 2")
    conf += ", cr AS (" + " UNION ALL ".join(f"SELECT {c} AS class, CAST(count(*) FILTER (a = {c} AND p = {c}) AS DOUBLE) AS h, count(*) FILTER (p = {c}) AS m, count(*) FILTER (a = {c}) AS support FROM cf" for c in (0, 1)) + ")"
    conf += ", cq AS (SELECT class, support, COALESCE(h / NULLIF(m, 0), 0) AS pr, COALESCE(h / NULLIF(support, 0), 0) AS re FROM cr)"
    sql |= matched_sql(match)
    sql["confusion_report"] = out(conf, "cq", "class, support", "precision: pr; recall: re; f1: COALESCE(2 * pr * re / NULLIF(pr + re, 0), 0)")
    return sql
