"""The user feature matrix in SQL, written from the definitions and not from the Spark plans."""

from oracle.log_sql import USAGE_LOG

TOOL_EVENTS = """('agent_tool_call_create_block_tool','agent_tool_call_run_block_tool','agent_tool_call_get_block_tool',
'agent_tool_call_get_canvas_summary_tool','agent_tool_call_refactor_block_tool','agent_tool_call_finish_ticket_tool',
'agent_tool_call_get_variable_preview_tool','agent_tool_call_delete_block_tool','agent_tool_call_create_edges_tool',
'agent_tool_call_get_block_image_tool')"""
TOOLS = (
    "create_block_tool run_block_tool get_block_tool get_canvas_summary_tool refactor_block_tool finish_ticket_tool "
    "get_variable_preview_tool delete_block_tool create_edges_tool get_block_image_tool"
).split()
RUNS = "('run_block','run_all_blocks')"
CHATS = "('agent_new_chat','agent_start_from_prompt','agent_message')"
CREDITS = """('credits_used','addon_credits_used','credits_exceeded','credits_below_1','credits_below_2','credits_below_3','credits_below_4')"""
TOOL_SQL = "COALESCE(NULLIF(trim(tool_name), ''), CASE WHEN starts_with(event, 'agent_tool_call_') THEN substr(event, 17) END)"


def hours(a: str, b: str, unit: int) -> str:
    return f"((epoch_us({a}) - epoch_us({b})) / {unit * 1_000_000}.0)"


def r(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {alias}"


LOG = USAGE_LOG + f""",
tlog AS (SELECT *, {TOOL_SQL} AS tool, CAST(ts AS DATE) AS day,
         NULLIF(regexp_extract(pathname, '/canvas/([a-f0-9\\-]{{10,}})', 1), '') AS canvas_id FROM log)"""

_PIVOT = ",\n ".join(f"count(*) FILTER (event IN {TOOL_EVENTS} AND tool = '{t}') AS tool_{t}" for t in TOOLS)


def _group(*parts: str) -> str:
    return " OR ".join(f"contains(lower(replace(tool, ' ', '_')), '{p}')" for p in parts)


VOLUME = LOG + f""",
volume AS (SELECT person_id, count(event) AS total_events, count(DISTINCT event) AS unique_event_types, count(DISTINCT day) AS days_active,
  count(DISTINCT session_id) AS unique_sessions, min(ts) AS first_seen, max(ts) AS last_seen,
  {hours('max(ts)', 'min(ts)', 86400)} AS tenure_days, strftime(min(ts), '%Y-%m') AS signup_cohort
  FROM tlog GROUP BY person_id),
counted AS (SELECT person_id,
  count(*) FILTER (event IN {RUNS}) AS manual_runs, count(DISTINCT day) FILTER (event IN {RUNS}) AS manual_run_days,
  count(DISTINCT message_id) FILTER (event IN {CHATS}) AS agent_conversations, count(*) FILTER (event IN {CHATS}) AS agent_messages,
  count(DISTINCT day) FILTER (event IN {CHATS}) AS agent_start_days,
  count(*) FILTER (event IN {TOOL_EVENTS}) AS agent_tool_calls_total, count(DISTINCT tool) FILTER (event IN {TOOL_EVENTS}) AS agent_tool_types_used,
  count(DISTINCT day) FILTER (event IN {TOOL_EVENTS}) AS agent_tool_call_days,
  {_PIVOT},
  count(*) FILTER (event IN {TOOL_EVENTS} AND ({_group('create_block', 'refactor_block', 'create_edges')})) AS agent_build_calls,
  count(*) FILTER (event IN {TOOL_EVENTS} AND ({_group('run_block')})) AS agent_run_calls,
  count(*) FILTER (event IN {TOOL_EVENTS} AND ({_group('get_block', 'get_canvas', 'get_variable')})) AS agent_inspect_calls,
  count(*) FILTER (event IN {TOOL_EVENTS} AND ({_group('finish_ticket')})) AS agent_finish_calls,
  count(*) FILTER (event IN {TOOL_EVENTS} AND ({_group('delete_block')})) AS agent_delete_calls,
  count(*) FILTER (event = 'fullscreen_open') AS fullscreen_opens,
  max(CASE WHEN event = 'fullscreen_preview_output' THEN 1 ELSE 0 END) AS previewed_output,
  max(CASE WHEN event = 'sign_up' THEN 1 ELSE 0 END) AS signed_up,
  max(CASE WHEN event = 'canvas_onboarding_tour_finished' THEN 1 ELSE 0 END) AS completed_onboarding,
  max(CASE WHEN event = 'skip_onboarding_form' THEN 1 ELSE 0 END) AS skipped_onboarding_form,
  max(CASE WHEN event = 'submit_onboarding_form' THEN 1 ELSE 0 END) AS submitted_onboarding,
  count(*) FILTER (event = 'sign_in') AS sign_in_count,
  min(ts) FILTER (event = 'sign_up') AS signup_at, min(ts) FILTER (event IN {RUNS}) AS run_at,
  min(ts) FILTER (event IN {TOOL_EVENTS}) AS tool_at, min(ts) FILTER (event IN {CHATS}) AS chat_at,
  count(*) FILTER (event IN {CREDITS}) AS credit_events,
  max(CASE WHEN event = 'credits_exceeded' THEN 1 ELSE 0 END) AS had_credit_exceeded,
  max(CASE WHEN event = 'addon_credits_used' THEN 1 ELSE 0 END) AS had_addon_credits
  FROM tlog GROUP BY person_id),
ttf AS (SELECT person_id,
  least(greatest({hours('run_at', 'signup_at', 60)}, 0), 10080) AS m_run, least(greatest({hours('tool_at', 'signup_at', 60)}, 0), 10080) AS m_tool,
  least(greatest({hours('chat_at', 'signup_at', 60)}, 0), 10080) AS m_chat, signup_at, run_at, tool_at, chat_at FROM counted),
ttf2 AS (SELECT person_id,
  CASE WHEN run_at IS NULL OR signup_at IS NULL THEN NULL ELSE m_run END AS ttf_manual_run_min,
  CASE WHEN tool_at IS NULL OR signup_at IS NULL THEN NULL ELSE m_tool END AS ttf_agent_tool_min,
  CASE WHEN chat_at IS NULL OR signup_at IS NULL THEN NULL ELSE m_chat END AS ttf_agent_chat_min,
  CASE WHEN tool_at IS NOT NULL AND signup_at IS NOT NULL AND m_tool <= 60 THEN 1 ELSE 0 END AS adopted_agent_early,
  CASE WHEN tool_at IS NOT NULL THEN 1 ELSE 0 END AS ever_used_agent,
  CASE WHEN run_at IS NOT NULL THEN 1 ELSE 0 END AS ever_ran_manually,
  COALESCE(CAST(hour(signup_at) AS INTEGER), -1) AS signup_hour, COALESCE(CAST(isodow(signup_at) - 1 AS INTEGER), -1) AS signup_dow,
  CASE WHEN signup_at IS NULL THEN -1 WHEN isodow(signup_at) >= 6 THEN 1 ELSE 0 END AS signup_is_weekend FROM ttf),
canv AS (SELECT person_id, canvas_id, count(*) AS n, count(DISTINCT day) AS days FROM tlog WHERE canvas_id IS NOT NULL GROUP BY 1, 2),
canvas AS (SELECT person_id, count(*) AS unique_canvases, CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS primary_canvas_event_share,
  count(*) FILTER (days >= 2) AS repeat_canvas_count_raw, CAST(count(*) FILTER (days = 1) AS DOUBLE) / count(*) AS one_day_canvas_share FROM canv GROUP BY 1),
calls AS (SELECT person_id, replace(tool, '_tool', '') AS s, lead(replace(tool, '_tool', '')) OVER (PARTITION BY person_id ORDER BY ts, event_id) AS nx
  FROM tlog WHERE event IN {TOOL_EVENTS}),
trans AS (SELECT person_id, count(*) FILTER (s = 'create_block' AND nx = 'run_block') AS create_run_transitions,
  count(*) FILTER (s = 'run_block' AND nx = 'refactor_block') AS run_refactor_transitions,
  count(*) FILTER (s = 'finish_ticket' AND nx = 'get_canvas_summary') AS finish_summary_transitions, count(*) AS agent_tool_transitions_total
  FROM calls WHERE nx IS NOT NULL GROUP BY 1),
nat AS (SELECT person_id, session_id, min(ts) AS s0, max(ts) AS s1, count(*) AS n, count(DISTINCT event) AS types,
  max(CASE WHEN event IN {TOOL_EVENTS} OR event IN {CHATS} THEN 1 ELSE 0 END) AS ag, max(CASE WHEN event IN {RUNS} THEN 1 ELSE 0 END) AS rn
  FROM tlog WHERE session_id IS NOT NULL GROUP BY 1, 2),
natr AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY s0, session_id) AS o FROM nat),
natu AS (SELECT a.person_id, a.n AS first_session_events, a.types AS first_session_event_types, {hours('a.s1', 'a.s0', 60)} AS first_session_duration_min,
  a.ag AS first_session_had_agent, a.rn AS first_session_had_run, CASE WHEN b.s0 IS NULL THEN 0 ELSE 1 END AS had_second_session,
  CASE WHEN b.s0 IS NULL THEN 0.0 ELSE least(greatest({hours('b.s0', 'a.s0', 3600)}, 0), 720) END AS time_to_return_hours
  FROM natr a LEFT JOIN natr b ON b.person_id = a.person_id AND b.o = 2 WHERE a.o = 1),
gaps AS (SELECT *, {hours('ts', 'lag(ts) OVER (PARTITION BY person_id ORDER BY ts, event_id)', 60)} AS gap FROM tlog),
sess AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_num FROM gaps),
der AS (SELECT person_id, session_num, count(*) AS n,
  max(CASE WHEN event IN ('block_create','agent_tool_call_create_block_tool','agent_tool_call_refactor_block_tool') THEN 1 ELSE 0 END) AS b,
  max(CASE WHEN event IN ('run_block','run_all_blocks','agent_tool_call_run_block_tool') THEN 1 ELSE 0 END) AS q FROM sess GROUP BY 1, 2),
struc AS (SELECT person_id, count(*) FILTER (b = 1 AND q = 1) AS productive_sessions, count(*) AS total_sessions_derived, max(n) AS max_events_per_session,
  CAST(count(*) FILTER (b = 1 AND q = 1) AS DOUBLE) / count(*) AS productive_session_share FROM der GROUP BY 1),
ref1 AS (SELECT person_id, lower(referrer) AS d, row_number() OVER (PARTITION BY person_id ORDER BY ts, referrer) AS o FROM tlog WHERE referrer IS NOT NULL),
ref AS (SELECT person_id, CASE WHEN contains(d, 'google') THEN 'google' WHEN contains(d, 'github') THEN 'github' WHEN contains(d, 'linkedin') THEN 'linkedin'
  WHEN contains(d, 'twitter') OR contains(d, 'x.com') THEN 'twitter' WHEN d IN ('', 'nan', 'none', '$direct') THEN 'direct' ELSE 'other' END AS c FROM ref1 WHERE o = 1)"""

REF = ", ".join(f"CASE WHEN c = '{c}' THEN 1 ELSE 0 END AS ref_{c}" for c in "google github linkedin twitter direct other".split())
_REF0 = ", ".join(f"COALESCE(ref_{c}, 0) AS ref_{c}" for c in "google github linkedin twitter direct other".split())

FEATURES = VOLUME + f""",
refs AS (SELECT person_id, {REF} FROM ref),
feats AS (SELECT v.*, c.* EXCLUDE (person_id, signup_at, run_at, tool_at, chat_at),
  COALESCE(ttf_manual_run_min, 0) AS ttf_manual_run_min, COALESCE(ttf_agent_tool_min, 0) AS ttf_agent_tool_min, COALESCE(ttf_agent_chat_min, 0) AS ttf_agent_chat_min,
  adopted_agent_early, ever_used_agent, ever_ran_manually, signup_hour, signup_dow, signup_is_weekend,
  {hours('(SELECT max(ts) FROM log)', 'last_seen', 86400)} AS recency_days,
  COALESCE(unique_canvases, 0) AS unique_canvases, COALESCE(primary_canvas_event_share, 0) AS primary_canvas_event_share,
  COALESCE(repeat_canvas_count_raw, 0) AS repeat_canvas_count_raw, COALESCE(one_day_canvas_share, 0) AS one_day_canvas_share,
  COALESCE(create_run_transitions, 0) AS create_run_transitions, COALESCE(run_refactor_transitions, 0) AS run_refactor_transitions,
  COALESCE(finish_summary_transitions, 0) AS finish_summary_transitions, COALESCE(agent_tool_transitions_total, 0) AS agent_tool_transitions_total,
  COALESCE(CAST(create_run_transitions AS DOUBLE) / agent_tool_transitions_total, 0) AS create_run_alternation_rate,
  COALESCE(CAST(run_refactor_transitions AS DOUBLE) / agent_tool_transitions_total, 0) AS refactor_after_run_rate,
  COALESCE(CAST(finish_summary_transitions AS DOUBLE) / agent_tool_transitions_total, 0) AS finish_summary_rate,
  COALESCE(first_session_events, 0) AS first_session_events, COALESCE(first_session_event_types, 0) AS first_session_event_types,
  COALESCE(first_session_duration_min, 0) AS first_session_duration_min, COALESCE(first_session_had_agent, 0) AS first_session_had_agent,
  COALESCE(first_session_had_run, 0) AS first_session_had_run, COALESCE(had_second_session, 0) AS had_second_session, COALESCE(time_to_return_hours, 0) AS time_to_return_hours,
  productive_sessions, total_sessions_derived, max_events_per_session, productive_session_share, {_REF0}
  FROM volume v JOIN counted c USING (person_id) JOIN ttf2 USING (person_id) LEFT JOIN canvas USING (person_id) LEFT JOIN trans USING (person_id)
  LEFT JOIN natu USING (person_id) JOIN struc USING (person_id) LEFT JOIN refs USING (person_id))"""

USERS = FEATURES + """,
users AS (SELECT *, CASE WHEN total_events <= 55 OR days_active = 0 THEN 'Ghost'
   WHEN ever_used_agent >= 1 AND agent_build_calls >= 3 THEN 'Agent Builder'
   WHEN ever_used_agent >= 1 AND (agent_run_calls >= 3 OR agent_conversations >= 2) THEN 'Agent Runner'
   WHEN manual_runs >= 3 THEN 'Manual Coder' ELSE 'Viewer' END AS segment,
   CASE WHEN adopted_agent_early = 1 THEN 'Early adopter (<1h)' WHEN ever_used_agent = 1 THEN 'Late adopter (1h+)' ELSE 'Never adopted' END AS adoption_cohort
   FROM feats)"""
