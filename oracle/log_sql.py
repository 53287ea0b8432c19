"""The derived logs in SQL, for the side-by-side check."""

USAGE_LOG = """
shaped AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, user_id % 6 AS persona,
         (user_id // 6) % 5 AS pace, (user_id // 30) % 4 AS cohort, epoch_us(ts) AS micros
  FROM events
),
timed AS (
  SELECT *, make_timestamp(CAST(1704067200000000
           + (micros - 1704067200000000) * (CASE pace WHEN 0 THEN 100 WHEN 1 THEN 50 WHEN 2 THEN 20 WHEN 3 THEN 8 ELSE 2 END) // 100
           + (cohort * 30 + CASE pace WHEN 3 THEN 12 WHEN 4 THEN 25 ELSE 0 END) * 86400000000 AS BIGINT)) AS moved,
  CASE event_type
   WHEN 'signup' THEN CASE WHEN k < 12 THEN 'sign_up' WHEN k < 34 THEN 'sign_in' WHEN k < 44 THEN 'skip_onboarding_form'
       WHEN k < 54 THEN 'submit_onboarding_form' WHEN k < 64 THEN 'canvas_onboarding_tour_finished'
       WHEN k < 84 THEN 'canvas_open' ELSE 'canvas_create' END
   WHEN 'click' THEN CASE WHEN persona = 4 THEN CASE WHEN k < 2 THEN 'run_block' WHEN k < 50 THEN 'block_create' ELSE 'block_resize' END
       WHEN k < 35 THEN 'run_block' WHEN k < 50 THEN 'run_all_blocks' WHEN k < 55 THEN 'run_from_block' WHEN k < 60 THEN 'run_upto_block'
       WHEN k < 75 THEN 'block_create' WHEN k < 82 THEN 'block_delete' WHEN k < 88 THEN 'edge_create' WHEN k < 93 THEN 'requirements_build'
       WHEN k < 97 THEN 'files_upload' ELSE 'block_resize' END
   WHEN 'view' THEN CASE WHEN persona IN (3, 4) THEN CASE WHEN k < 50 THEN 'fullscreen_open' WHEN k < 75 THEN 'fullscreen_close' ELSE 'fullscreen_preview_output' END
       WHEN k < 20 THEN 'agent_new_chat' WHEN k < 30 THEN 'agent_start_from_prompt' WHEN k < 50 THEN 'agent_message'
       WHEN k < 65 THEN 'fullscreen_open' WHEN k < 75 THEN 'fullscreen_close' WHEN k < 86 THEN 'fullscreen_preview_output'
       WHEN k < 94 THEN 'agent_accept_suggestion' ELSE 'block_output_copy' END
   WHEN 'purchase' THEN CASE
       WHEN persona = 0 THEN 'agent_tool_call_' || CASE WHEN k < 25 THEN 'create_block_tool' WHEN k < 45 THEN 'run_block_tool' WHEN k < 55 THEN 'get_block_tool'
           WHEN k < 63 THEN 'get_canvas_summary_tool' WHEN k < 77 THEN 'refactor_block_tool' WHEN k < 85 THEN 'finish_ticket_tool'
           WHEN k < 90 THEN 'get_variable_preview_tool' WHEN k < 94 THEN 'delete_block_tool' WHEN k < 97 THEN 'create_edges_tool' ELSE 'get_block_image_tool' END
       WHEN persona IN (1, 5) THEN 'agent_tool_call_' || CASE WHEN k < 10 THEN 'create_block_tool' WHEN k < 40 THEN 'run_block_tool' WHEN k < 60 THEN 'get_block_tool'
           WHEN k < 70 THEN 'get_canvas_summary_tool' WHEN k < 76 THEN 'refactor_block_tool' WHEN k < 86 THEN 'finish_ticket_tool'
           WHEN k < 94 THEN 'get_variable_preview_tool' ELSE 'get_block_image_tool' END
       WHEN persona = 2 THEN 'agent_tool_call_' || CASE WHEN k < 50 THEN 'run_block_tool' WHEN k < 75 THEN 'get_block_tool' WHEN k < 90 THEN 'get_canvas_summary_tool' ELSE 'finish_ticket_tool' END
       WHEN k < 50 THEN 'layer_create' ELSE 'app_publish' END
   ELSE CASE WHEN k < 15 THEN 'agent_open_error_assist' WHEN k < 35 THEN 'credits_used' WHEN k < 50 THEN 'addon_credits_used'
       WHEN k < 58 THEN 'credits_exceeded' WHEN k < 64 THEN 'credits_below_1' WHEN k < 70 THEN 'credits_below_2' WHEN k < 76 THEN 'credits_below_3'
       WHEN k < 82 THEN 'credits_below_4' WHEN k < 90 THEN 'agent_block_run' ELSE 'agent_block_created' END
  END AS name
  FROM shaped
),
log AS (
  SELECT CAST(user_id AS VARCHAR) AS person_id, event_id, name AS event, moved AS ts, ts AS created_at,
    concat_ws('-', 'd', user_id, k % 2) AS distinct_id,
    CASE WHEN starts_with(name, 'agent_tool_call_') AND k % 3 = 0 THEN ' ' || substr(name, 17) || ' '
         WHEN starts_with(name, 'agent_tool_call_') AND k % 3 = 2 THEN ' '
         WHEN name = 'agent_message' AND k % 2 = 0 THEN 'Coder Agent' END AS tool_name,
    CASE WHEN event_type = 'view' THEN concat_ws('-', 'm', user_id, k % 10) END AS message_id,
    CASE WHEN event_type <> 'error' AND k % 10 <> 9 THEN concat_ws('-', 's', user_id, strftime(moved, '%Y%m%d'), hour(moved) // 6) END AS session_id,
    CASE WHEN event_type = 'signup' THEN '/canvases/home' WHEN k % 5 = 4 THEN NULL
         ELSE '/canvas/' || lpad(CAST(k % 25 AS VARCHAR), 12, '0') END AS pathname,
    CASE WHEN event_type = 'error' THEN 'python-sdk' ELSE 'web' END AS lib,
    CASE WHEN user_id % 11 <> 0 THEN
      ['IN','US','GB','IE','FR','NL','DE','ES','IT','PL','SE','BR','CA','AU','JP','KR','MX','ZA','NG','AE','SG','TR','UA','CH','NO']
      [CAST((user_id + CASE WHEN k % 20 = 0 THEN 1 ELSE 0 END) % 25 + 1 AS INTEGER)] END AS country_code,
    CASE WHEN k % 3 = 0 THEN 'Desktop' WHEN k % 3 = 1 THEN 'Mobile' END AS device_type,
    CASE WHEN k % 3 = 0 THEN ['www.google.com','github.com','linkedin.com','x.com','$direct','news.example.org',NULL,'twitter.com'][CAST(user_id % 8 + 1 AS INTEGER)] END AS referrer
  FROM timed
)"""

ORDERS_LOG = """
olog AS (
  SELECT CAST(o_custkey AS VARCHAR) AS person_id, o_orderkey AS event_id, o_orderpriority AS event,
         o_orderdate AS ts, o_orderstatus AS canvas_id
  FROM orders
)"""

TOKENS = """
tokens AS (SELECT CAST(conv_id AS VARCHAR) AS seq_id, turn AS pos, role AS token FROM conversations)"""
