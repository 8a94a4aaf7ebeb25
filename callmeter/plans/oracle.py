"""The registered queries in DuckDB SQL. The first part repeats the rules of `plans/bridge.py`."""

from __future__ import annotations

import math

BASE = """
ev AS (
  SELECT event_id AS turn_id, user_id AS session_key, event_type, CAST(floor(value * 10) AS BIGINT) AS v10,
         1704067200000000 + date_diff('microsecond', TIMESTAMP '2024-01-01', ts) // 60 AS t_us
  FROM events),
numbered AS (
  SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS task_no,
         CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS main_no
  FROM ev WINDOW w AS (PARTITION BY session_key ORDER BY t_us, turn_id ROWS UNBOUNDED PRECEDING)),
shaped AS (
  SELECT *, CASE event_type WHEN 'signup' THEN 'user_turn' WHEN 'error' THEN 'subagent' ELSE 'tool_call' END AS trigger,
         CASE WHEN task_no > 0 THEN session_key * 100000 + task_no ELSE -1 END AS task_id,
         CASE WHEN event_type = 'error' THEN 'beta-4-5-20251001'
              WHEN (session_key + task_no) % 7 = 0 THEN 'alpha-5' ELSE 'alpha-5-5' END AS model,
         CASE WHEN event_type = 'error' THEN 5000 + 10 * (turn_id % 97) ELSE 20000 + 600 * ((main_no - 1) % 40) END AS input_total,
         CASE WHEN session_key % 3 = 0 THEN 3600 ELSE 300 END AS ttl
  FROM numbered),
mains AS (
  SELECT turn_id, lag(t_us) OVER w AS p_us, lag(input_total) OVER w AS p_input, lag(model) OVER w AS p_model
  FROM shaped WHERE trigger <> 'subagent' WINDOW w AS (PARTITION BY session_key ORDER BY t_us, turn_id)),
read_from AS (
  SELECT s.*, CAST(CASE WHEN s.trigger = 'subagent' OR m.p_us IS NULL THEN 0
       WHEN s.t_us - m.p_us > s.ttl * CAST(1000000 AS BIGINT) OR s.turn_id % 29 = 0 OR s.model <> m.p_model
       THEN 4000 * (s.session_key % 2) ELSE least(m.p_input, s.input_total - 2) END AS BIGINT) AS cache_read
  FROM shaped s LEFT JOIN mains m USING (turn_id)),
calls AS (
  SELECT turn_id, session_key, t_us, trigger, task_id, model, CAST(input_total AS BIGINT) AS input_total, cache_read,
         CAST(2 AS BIGINT) AS input_new, CAST(input_total - 2 - cache_read AS BIGINT) AS cache_write,
         CAST(CASE WHEN session_key % 3 = 0 THEN input_total - 2 - cache_read ELSE 0 END AS BIGINT) AS cache_write_1h,
         100 + v10 AS output,
         CASE WHEN trigger = 'subagent' AND turn_id % 2 = 0 THEN 3 ELSE 100 + v10 END AS output_logged,
         (trigger <> 'subagent' OR turn_id % 2 = 0) AS output_exact, FALSE AS after_compaction,
         1000 + turn_id % 900 AS added_chars, task_id <> -1 AS tracked, 'p' || (session_key % 12) AS project,
         'v' || (session_key % 3) AS version, 'log' AS source, event_type, task_no
  FROM read_from),
px AS (
  SELECT * FROM (VALUES
    ('alpha-5', 5000000, 500000, 6250000, 10000000, 25000000, 128000),
    ('alpha-5-5', 4000000, 200000, 5000000, 8000000, 20000000, 128000),
    ('beta-4-5', 1000000, 100000, 1250000, 2000000, 5000000, 64000))
  t(price_key, p_new, p_read, p_write_5m, p_write_1h, p_out, max_output)),
matched AS (
  SELECT n.model, px.* FROM (SELECT DISTINCT model FROM calls) n JOIN px
    ON n.model = px.price_key OR starts_with(n.model, px.price_key || '-') OR starts_with(n.model, px.price_key || '@')
  QUALIFY row_number() OVER (PARTITION BY n.model ORDER BY length(px.price_key) DESC) = 1),
tools AS (
  SELECT source, session_key, turn_id, task_id, t_us,
         CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Bash'
           WHEN 'purchase' THEN CASE WHEN turn_id % 2 = 0 THEN 'Edit' ELSE 'Agent' END END AS name,
         CASE WHEN event_type = 'click' AND turn_id % 3 = 0 THEN 'pytest -q --durations=5'
              WHEN event_type = 'click' THEN 'ls' END AS command
  FROM calls WHERE event_type IN ('view', 'click', 'purchase')),
first_tools AS (
  SELECT * FROM tools QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY t_us, turn_id) <= 5),
families AS (
  SELECT d.task_id, CASE WHEN coalesce(bool_or(f.name = 'Edit'), FALSE) THEN 'refactor'
      WHEN coalesce(bool_or(f.command LIKE 'pytest%'), FALSE) THEN 'measure'
      WHEN count(f.name) >= 3 AND bool_and(f.name = 'Read') THEN 'review' ELSE 'question' END AS family
  FROM (SELECT DISTINCT task_id FROM calls) d LEFT JOIN first_tools f USING (task_id) GROUP BY d.task_id),
files AS (
  SELECT session_key, task_id, t_us, turn_id,
         CASE WHEN turn_id % 37 = 0 THEN '.mcp.json' ELSE 'f' || (turn_id % 11) END AS path,
         CASE turn_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'search' END AS action
  FROM calls WHERE trigger = 'tool_call'),
first_reads AS (SELECT session_key, path, min((t_us, turn_id)) AS f FROM files WHERE action = 'read' GROUP BY ALL),
reread_calls AS (
  SELECT turn_id FROM files JOIN first_reads USING (session_key, path) WHERE action = 'read' AND (t_us, turn_id) > f),
priced AS (
  SELECT c.*, m.price_key, m.p_new, m.p_read, m.p_write_5m, m.p_write_1h, m.p_out, m.max_output, fam.family,
         c.turn_id IN (SELECT turn_id FROM reread_calls) AS reread,
         c.input_new * m.p_new + c.cache_read * m.p_read + (c.cache_write - c.cache_write_1h) * m.p_write_5m
           + c.cache_write_1h * m.p_write_1h + c.output * m.p_out AS cost_p
  FROM calls c LEFT JOIN matched m USING (model) LEFT JOIN families fam USING (task_id)),
enriched AS (
  SELECT *, input_total + output AS tokens, output - output_logged AS recovered,
         CASE WHEN trigger = 'subagent' THEN 'subagents' WHEN family = 'review' OR reread THEN 'reviews'
              WHEN trigger = 'tool_call' THEN 'tool_turns' ELSE 'user_turns' END AS category
  FROM priced),
stats AS (
  SELECT source, task_id, arg_min(session_key, (t_us, turn_id)) AS session_key, arg_min(project, (t_us, turn_id)) AS project,
         bool_and(tracked) AS tracked, min(t_us) AS started_us, max(t_us) AS last_us,
         count(*) FILTER (trigger <> 'subagent') AS turns_main, count(*) FILTER (trigger = 'subagent') AS turns_sub,
         count(*) AS turns, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(output) AS BIGINT) AS output,
         arg_min(input_total, (t_us, turn_id)) FILTER (trigger <> 'subagent') AS first_input,
         arg_min(cache_read, (t_us, turn_id)) FILTER (trigger <> 'subagent') AS first_cache_read,
         arg_min(model, (t_us, turn_id)) FILTER (trigger <> 'subagent') AS first_model,
         arg_min(cost_p - output * p_out, (t_us, turn_id)) FILTER (trigger <> 'subagent') AS floor_p,
         arg_min(input_total * p_read, (t_us, turn_id)) FILTER (trigger <> 'subagent') AS reread_p,
         CAST(coalesce(sum(tokens) FILTER (trigger = 'subagent'), 0) AS BIGINT) AS sub_tokens,
         CAST(sum(recovered) AS BIGINT) AS recovered, coalesce(sum(cost_p), 0) AS cost_p,
         count(*) FILTER (cost_p IS NULL) AS unpriced, min(family) AS family
  FROM enriched GROUP BY source, task_id),
real_tasks AS (SELECT * FROM stats WHERE tracked AND turns_main > 0 AND first_input > 0)
"""

USD = "round(CAST({0} AS DOUBLE) / 1e12, {1})"


def usd(expr: str, digits: int = 4) -> str:
    return USD.format(expr, digits)


def query(tail: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE.strip(), *[x.strip() for x in ctes]]) + "\n" + tail.strip()


SHARE = "CASE WHEN {1} = 0 THEN 0.0 ELSE round(100 * CAST({0} AS DOUBLE) / CAST({1} AS DOUBLE), 1) END"

SQL: dict[str, str] = {}

SQL["where_it_went"] = query(f"""
SELECT category, coalesce(turns, 0) AS turns, coalesce(tokens, 0) AS tokens, {usd('coalesce(cost_p, 0)')} AS cost,
       coalesce(recovered, 0) AS recovered,
       {SHARE.format('coalesce(tokens, 0)', '(sum(tokens) OVER ())')} AS token_share,
       {SHARE.format('coalesce(cost_p, 0)', '(sum(cost_p) OVER ())')} AS cost_share
FROM (VALUES ('subagents'), ('reviews'), ('tool_turns'), ('user_turns')) n(category)
LEFT JOIN (SELECT category, count(*) AS turns, CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost_p) AS cost_p,
                  CAST(sum(recovered) AS BIGINT) AS recovered FROM enriched GROUP BY category) USING (category)""")

SQL["totals"] = query(f"""
SELECT count(*) AS turns, count(DISTINCT (source, task_id)) AS tasks, count(DISTINCT session_key) AS sessions,
  CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(input_new) AS BIGINT) AS input_new, CAST(sum(cache_read) AS BIGINT) AS cache_read,
  CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(output) AS BIGINT) AS output, CAST(0 AS BIGINT) AS reasoning,
  CAST(sum(output_logged) AS BIGINT) AS output_logged, CAST(sum(recovered) AS BIGINT) AS recovered,
  count(*) FILTER (recovered <> 0) AS recovered_calls,
  {usd('coalesce(sum(recovered * p_out) FILTER (recovered <> 0), 0)')} AS recovered_cost,
  {usd('coalesce(sum(cost_p), 0)')} AS cost, count(*) FILTER (cost_p IS NULL) AS unpriced_turns,
  count(*) FILTER (NOT output_exact) AS inexact_turns,
  CAST(coalesce(sum(output) FILTER (NOT output_exact), 0) AS BIGINT) AS inexact_output
FROM enriched""")

SQL["by_session"] = query(f"""
SELECT session_key, min(t_us) AS started_us, arg_min(project, (t_us, turn_id)) AS project, count(*) AS turns,
  count(DISTINCT (source, task_id)) AS tasks, CAST(sum(tokens) AS BIGINT) AS tokens, {usd('coalesce(sum(cost_p), 0)')} AS cost,
  {SHARE.format("coalesce(sum(cost_p) FILTER (trigger = 'subagent'), 0)", 'coalesce(sum(cost_p), 0)')} AS subagent_cost_share
FROM enriched GROUP BY session_key""")

SQL["by_month"] = query(f"""
SELECT strftime(make_timestamp(t_us), '%Y-%m') AS month, count(*) AS calls, CAST(sum(input_total) AS BIGINT) AS input,
  CAST(sum(output) AS BIGINT) AS output, CAST(sum(tokens) AS BIGINT) AS tokens, {usd('coalesce(sum(cost_p), 0)')} AS cost,
  CAST(sum(recovered) AS BIGINT) AS recovered FROM enriched GROUP BY 1""")

SQL["top_tasks"] = query(f"""
SELECT task_id, session_key, project, family, turns_main, turns_sub, tokens, recovered, {usd('cost_p')} AS cost
FROM stats ORDER BY cost_p DESC, task_id LIMIT 10""")

SQL["price_prefix_join"] = query(f"""
SELECT model, price_key, count(*) AS calls, {usd('sum(cost_p)')} AS cost FROM priced GROUP BY model, price_key""")

SQL["task_ranks"] = query("""
SELECT task_id, session_key, row_number() OVER (PARTITION BY session_key ORDER BY started_us, task_id) AS rank FROM real_tasks""")

SQL["anonymized_sessions"] = query(f"""
SELECT substr(sha256(CAST(s.session_key AS VARCHAR)), 1, 8) AS session_name,
       'project-' || chr(CAST(65 + f.n % 26 AS INTEGER)) || CASE WHEN f.n >= 26 THEN CAST(f.n // 26 AS VARCHAR) ELSE '' END AS project_name,
       s.turns, s.tokens
FROM by_s s JOIN (SELECT project, row_number() OVER (ORDER BY min((started_us, session_key)), project) - 1 AS n
                  FROM by_s GROUP BY project) f USING (project)""", """
by_s AS (SELECT session_key, min(t_us) AS started_us, arg_min(project, (t_us, turn_id)) AS project, count(*) AS turns,
         CAST(sum(tokens) AS BIGINT) AS tokens FROM enriched GROUP BY session_key)""")

SQL["top_per_group"] = query(f"""
SELECT project, task_id, {usd('cost_p')} AS cost, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY cost_p DESC, task_id) AS rank FROM stats WHERE tracked)
WHERE rank <= 3""")

PAIRS = """
main_rows AS (SELECT * FROM priced WHERE trigger <> 'subagent'),
pairs AS (
  SELECT m.*, lag(m.t_us) OVER w AS q_us, lag(m.input_total) OVER w AS q_input, lag(m.output) OVER w AS q_output,
         lag(m.model) OVER w AS q_model, lag(m.task_id) OVER w AS q_task, lag(m.turn_id) OVER w AS q_turn,
         coalesce(last_value(CASE WHEN cache_write > 0 THEN CASE WHEN cache_write_1h > 0 THEN 3600 ELSE 300 END END IGNORE NULLS)
                  OVER (PARTITION BY session_key ORDER BY t_us, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 300) AS ttl,
         row_number() OVER w - 1 AS call_index, count(*) OVER (PARTITION BY session_key) AS calls_in_session
  FROM main_rows m WINDOW w AS (PARTITION BY session_key ORDER BY t_us, turn_id)
  QUALIFY q_turn IS NOT NULL),
events_lost AS (
  SELECT *, CASE WHEN t_us - q_us > ttl * CAST(1000000 AS BIGINT) THEN 'expired' ELSE 'break' END AS kind,
         q_input - cache_read AS lost_tokens,
         (q_input - cache_read) * (CASE WHEN ttl = 3600 THEN p_write_1h ELSE p_write_5m END - p_read) AS extra_p
  FROM pairs WHERE q_input >= 4096 AND input_total >= 0.5 * q_input AND cache_read < 0.5 * q_input)
"""
EXPIRED = """
expired AS (SELECT * FROM pairs WHERE q_input >= 4096 AND model = q_model AND input_total >= 0.5 * q_input
            AND t_us - q_us > ttl * CAST(1000000 AS BIGINT))
"""
WRITES = """
prefix_w AS (SELECT session_key, t_us FROM files WHERE action = 'write' AND path = '.mcp.json'),
caused AS (
  SELECT p.*, coalesce(x.n, 0) AS written_n, l.kind, l.extra_p
  FROM pairs p LEFT JOIN events_lost l USING (turn_id)
  LEFT JOIN (SELECT p.turn_id, count(*) AS n FROM pairs p JOIN prefix_w w ON w.session_key = p.session_key
             AND w.t_us >= p.q_us AND w.t_us < p.t_us GROUP BY p.turn_id) x USING (turn_id)),
unexplained AS (SELECT * FROM caused WHERE kind = 'break' AND model = q_model AND written_n = 0)
"""

SQL["cache_events"] = query(f"""
SELECT turn_id, session_key, kind, lost_tokens, {usd('extra_p', 8)} AS extra_cost, t_us - q_us AS gap_us FROM events_lost""", PAIRS)

SQL["cache_summary"] = query(f"""
SELECT kind, count(*) AS events, CAST(sum(lost_tokens) AS BIGINT) AS lost_tokens, {usd('sum(extra_p)')} AS extra_cost
FROM events_lost GROUP BY kind""", PAIRS)

SQL["expiries"] = query("""
SELECT turn_id, session_key, model, t_us - q_us AS gap_us, ttl, q_input AS context, cache_read AS read FROM expired""", PAIRS, EXPIRED)

SQL["ttl_in_force"] = query("""
SELECT session_key, coalesce(arg_max(CASE WHEN cache_write_1h > 0 THEN 3600 ELSE 300 END, (t_us, turn_id)) FILTER (cache_write > 0), 300) AS ttl
FROM calls WHERE trigger <> 'subagent' GROUP BY session_key""")

SQL["cache_clock"] = query("""
SELECT session_key, ttl, left_us > 0 AS warm, round(greatest(left_us / 1000000.0, 0.0), 3) AS left_s, tokens, model FROM (
  SELECT session_key, coalesce(arg_max(CASE WHEN cache_write_1h > 0 THEN 3600 ELSE 300 END, (t_us, turn_id)) FILTER (cache_write > 0), 300) AS ttl,
    ttl * CAST(1000000 AS BIGINT) - (1704067200000000 + 43200000000 - max(t_us)) AS left_us,
    arg_max(input_total + output, (t_us, turn_id)) AS tokens, arg_max(model, (t_us, turn_id)) AS model
  FROM calls WHERE trigger <> 'subagent' GROUP BY session_key)""")

SQL["break_causes"] = query(f"""
SELECT CASE WHEN model <> q_model THEN 'model_switch' WHEN written_n > 0 THEN 'prefix_file_written' ELSE 'no_visible_cause' END AS cause,
  count(*) AS breaks, {usd('sum(extra_p)')} AS cost FROM caused WHERE kind = 'break' GROUP BY 1""", PAIRS, WRITES)

SQL["prefix_writes"] = query("""
SELECT count(*) FILTER (written_n > 0 AND q_input >= 4096) AS prefix_writes,
  count(*) FILTER (written_n > 0 AND q_input >= 4096 AND kind = 'break') AS prefix_writes_then_break FROM caused""", PAIRS, WRITES)

SURVIVORS = """
survivors AS (
  SELECT p.turn_id, p.session_key, 'm' || (p.session_key % 40) AS model, p.q_input AS context, p.cache_read AS read,
    EXISTS (SELECT 1 FROM calls o WHERE o.session_key % 40 = p.session_key % 40 AND o.session_key <> p.session_key
            AND o.t_us < p.t_us AND o.t_us >= p.t_us - p.ttl * CAST(1000000 AS BIGINT)) AS other_active
  FROM pairs p WHERE q_input >= 4096 AND input_total >= 0.5 * q_input AND t_us - q_us > ttl * CAST(1000000 AS BIGINT))
"""
SQL["other_session_active"] = query("SELECT turn_id, session_key, model, read, other_active FROM survivors", PAIRS, SURVIVORS)
SQL["expiry_survivors"] = query("""
SELECT count(*) AS n, quantile_cont(read, 0.1) AS read_p10, quantile_cont(read, 0.5) AS read_p50, quantile_cont(read, 0.9) AS read_p90,
  count(*) FILTER (other_active) AS other_active, count(*) FILTER (other_active AND read >= 0.1 * context) AS other_active_read10,
  quantile_cont(read, 0.5) FILTER (other_active) AS other_active_read_p50,
  count(*) FILTER (NOT other_active) AS alone, count(*) FILTER (NOT other_active AND read >= 0.1 * context) AS alone_read10,
  quantile_cont(read, 0.5) FILTER (NOT other_active) AS alone_read_p50 FROM survivors""", PAIRS, SURVIVORS)

SQL["break_shape"] = query(f"""
SELECT measure, bucket, count(*) AS breaks, {usd('sum(extra_p)')} AS cost FROM (
  SELECT extra_p, unnest(['version', 'first 3 calls', 'position decile', 'task', 'sub-agents between', 'gap share of ttl',
                          'tokens still read', 'context']) AS measure,
    unnest([version, CASE WHEN call_index <= 3 THEN 'yes' ELSE 'no' END,
      CAST(least(9, (10 * call_index) // calls_in_session) AS VARCHAR),
      CASE WHEN task_id <> q_task THEN 'new' ELSE 'same' END,
      CASE WHEN EXISTS (SELECT 1 FROM calls s WHERE s.trigger = 'subagent' AND s.session_key = u.session_key
                        AND s.t_us >= u.q_us AND s.t_us < u.t_us) THEN 'yes' ELSE 'no' END,
      ttl || 's ' || CASE WHEN (t_us - q_us) / (ttl * 1e6) < 0.1 THEN '<10%' WHEN (t_us - q_us) / (ttl * 1e6) < 0.5 THEN '10-50%'
        WHEN (t_us - q_us) / (ttl * 1e6) < 0.9 THEN '50-90%' ELSE '90-100%' END,
      CASE WHEN cache_read = 0 THEN '0' WHEN cache_read BETWEEN 15000 AND 35000 THEN '15k-35k' WHEN cache_read > 35000 THEN '>35k' ELSE 'other' END,
      CASE WHEN input_total - q_input - q_output >= 0 THEN 'grew' ELSE 'shrank' END]) AS bucket
  FROM unexplained u) GROUP BY measure, bucket""", PAIRS, WRITES)

SQL["break_concentration"] = query(f"""
SELECT top, CAST(sum(breaks) FILTER (rn <= top) AS BIGINT) AS breaks, {usd('sum(cost_p) FILTER (rc <= top)')} AS cost
FROM (SELECT *, row_number() OVER (ORDER BY breaks DESC, session_key) AS rn, row_number() OVER (ORDER BY cost_p DESC, session_key) AS rc
      FROM (SELECT session_key, count(*) AS breaks, sum(extra_p) AS cost_p FROM unexplained GROUP BY session_key)),
  (VALUES (1), (3), (5), (10)) k(top) GROUP BY top""", PAIRS, WRITES)

SQL["tool_lift"] = query("""
SELECT name, before_break, before_any, round((before_break / greatest((SELECT count(*) FROM unexplained), 1)) /
    (before_any / (SELECT count(*) FROM pairs)), 6) AS lift
FROM (SELECT t.name, count(*) AS before_any, count(*) FILTER (p.turn_id IN (SELECT turn_id FROM unexplained)) AS before_break
      FROM pairs p JOIN tools t ON t.turn_id = p.q_turn GROUP BY t.name) WHERE before_break > 0""", PAIRS, WRITES)

SNAPS = """
lined AS (
  SELECT *, 2 * row_number() OVER w AS line,
         CAST(sum(CASE WHEN trigger <> 'subagent' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS mno
  FROM calls WINDOW w AS (PARTITION BY session_key ORDER BY t_us, turn_id)),
marks AS (SELECT session_key, mno // 10 AS snap, line + 1 AS line FROM lined
          WHERE session_key % 13 <> 0 AND trigger <> 'subagent' AND mno % 10 = 0),
counted AS (
  SELECT k.session_key, k.snap, k.line, l.model, CAST(sum(input_new) AS BIGINT) AS i, CAST(sum(cache_read) AS BIGINT) AS r,
         CAST(sum(cache_write) AS BIGINT) AS w, CAST(sum(output) AS BIGINT) AS o
  FROM marks k JOIN lined l ON l.session_key = k.session_key AND l.line < k.line
    AND (k.session_key % 6 <> 0 OR k.snap <= 2 OR
         l.line > (SELECT min(m.line) FROM marks m WHERE m.session_key = k.session_key AND m.snap = 2))
  GROUP BY ALL),
snaps AS (
  SELECT session_key, line, model, i AS c_input, w AS c_write, o AS c_output,
    r + CASE WHEN model = min(model) OVER (PARTITION BY session_key, snap) THEN
      CASE session_key % 6 WHEN 1 THEN CASE WHEN snap >= 3 THEN 50000 ELSE 0 END WHEN 2 THEN 3000 * snap
        WHEN 3 THEN -700 * snap WHEN 4 THEN 1000000 ELSE 0 END ELSE 0 END AS c_read
  FROM counted),
last_snap AS (SELECT session_key, max(line) AS last_line FROM snaps GROUP BY session_key),
counter_side AS (SELECT session_key, model, CAST(sum(c_input) AS BIGINT) AS c_input, CAST(sum(c_read) AS BIGINT) AS c_read,
    CAST(sum(c_write) AS BIGINT) AS c_write, CAST(sum(c_output) AS BIGINT) AS c_output
  FROM snaps JOIN last_snap USING (session_key) WHERE line = last_line GROUP BY session_key, model),
line_side AS (SELECT session_key, model, CAST(sum(input_new) AS BIGINT) AS o_input, CAST(sum(cache_read) AS BIGINT) AS o_read,
    CAST(sum(cache_write) AS BIGINT) AS o_write, CAST(sum(output) AS BIGINT) AS o_output, CAST(sum(output_logged) AS BIGINT) AS o_output_logged
  FROM lined JOIN last_snap USING (session_key) WHERE line < last_line GROUP BY session_key, model),
checks AS (
  SELECT session_key, model, coalesce(c_input, 0) AS c_input, coalesce(c_read, 0) AS c_read, coalesce(c_write, 0) AS c_write,
    coalesce(c_output, 0) AS c_output, coalesce(o_input, 0) AS o_input, coalesce(o_read, 0) AS o_read, coalesce(o_write, 0) AS o_write,
    coalesce(o_output, 0) AS o_output, coalesce(o_output_logged, 0) AS o_output_logged
  FROM counter_side FULL OUTER JOIN line_side USING (session_key, model)),
points AS (
  SELECT s.session_key, s.line, s.i + s.r + s.w AS counter, s.i, s.r, s.w, s.o,
    (SELECT count(*) FROM lined l WHERE l.session_key = s.session_key AND l.line < s.line) AS calls,
    (SELECT CAST(sum(input_new) AS BIGINT) FROM lined l WHERE l.session_key = s.session_key AND l.line < s.line) AS oi,
    (SELECT CAST(sum(cache_read) AS BIGINT) FROM lined l WHERE l.session_key = s.session_key AND l.line < s.line) AS orr,
    (SELECT CAST(sum(cache_write) AS BIGINT) FROM lined l WHERE l.session_key = s.session_key AND l.line < s.line) AS ow,
    (SELECT CAST(sum(output) AS BIGINT) FROM lined l WHERE l.session_key = s.session_key AND l.line < s.line) AS oo
  FROM (SELECT session_key, line, CAST(sum(c_input) AS BIGINT) AS i, CAST(sum(c_read) AS BIGINT) AS r,
          CAST(sum(c_write) AS BIGINT) AS w, CAST(sum(c_output) AS BIGINT) AS o FROM snaps GROUP BY session_key, line) s),
steps AS (
  SELECT *, oi + orr + ow AS ours, lag(counter) OVER q AS p_counter, counter >= p_counter AS pair,
    CASE WHEN pair THEN calls - lag(calls) OVER q END AS d_calls, CASE WHEN pair THEN ours - lag(oi + orr + ow) OVER q END AS d_ours,
    CASE WHEN pair THEN counter - p_counter END AS d_counter, d_ours - d_counter AS delta,
    CASE WHEN pair THEN oi - lag(oi) OVER q END AS doi, CASE WHEN pair THEN orr - lag(orr) OVER q END AS dor,
    CASE WHEN pair THEN ow - lag(ow) OVER q END AS dow, CASE WHEN pair THEN oo - lag(oo) OVER q END AS doo,
    CASE WHEN pair THEN i - lag(i) OVER q END AS di, CASE WHEN pair THEN r - lag(r) OVER q END AS dr,
    CASE WHEN pair THEN w - lag(w) OVER q END AS dw, CASE WHEN pair THEN o - lag(o) OVER q END AS dout
  FROM points WINDOW q AS (PARTITION BY session_key ORDER BY line)),
inc AS (
  SELECT session_key, count(*) AS snapshots, count(*) FILTER (pair) AS pairs, CAST(coalesce(sum(d_calls), 0) AS BIGINT) AS calls,
    CAST(coalesce(sum(d_ours), 0) AS BIGINT) AS ours, CAST(coalesce(sum(d_counter), 0) AS BIGINT) AS counter,
    arg_min(counter - ours, line) AS "offset", count(*) FILTER (NOT pair) AS restarts,
    sum(doi) AS doi, sum(dor) AS dor, sum(dow) AS dow, sum(doo) AS doo, sum(di) AS di, sum(dr) AS dr, sum(dw) AS dw, sum(dout) AS dout
  FROM (SELECT session_key, line, pair, d_calls, d_ours, d_counter, counter, ours, doi, dor, dow, doo, di, dr, dw, dout FROM steps)
  GROUP BY session_key),
shape AS (
  SELECT session_key, count(*) FILTER (pair) AS intervals, count(*) FILTER (pair AND delta <> 0) AS steps,
    CAST(coalesce(sum(d_calls) FILTER (delta <> 0), 0) AS BIGINT) AS calls_in_steps,
    CASE WHEN count(*) FILTER (pair) = 0 THEN 'unknown'
      WHEN count(*) FILTER (pair) < 3 AND count(*) FILTER (pair AND delta <> 0) > 0 THEN 'too few intervals'
      WHEN count(*) FILTER (pair AND delta <> 0) = 0 THEN 'none'
      WHEN count(*) FILTER (pair AND delta <> 0) <= 2
        OR list_sum(list_slice(list_reverse_sort(list(abs(delta)) FILTER (pair)), 1, 2)) >= 0.9 * sum(abs(delta)) THEN 'concentrated'
      ELSE 'spread' END AS kind
  FROM steps GROUP BY session_key),
tails AS (
  SELECT l.session_key, l.line, l.t_us, row_number() OVER z AS n, count(*) OVER (PARTITION BY l.session_key) AS of,
    sum(l.input_new) OVER z AS ti, sum(l.cache_read) OVER z AS tr, sum(l.cache_write) OVER z AS tw, CAST(sum(l.output) OVER z AS BIGINT) AS tout
  FROM lined l JOIN last_snap k ON l.session_key = k.session_key AND l.line < k.last_line
  WINDOW z AS (PARTITION BY l.session_key ORDER BY l.line DESC ROWS UNBOUNDED PRECEDING)),
suffix AS (
  SELECT t.session_key, t.n AS last_calls, t.of, t.t_us AS since_us, CAST(t.ti AS BIGINT) AS ti, CAST(t.tr AS BIGINT) AS tr,
    CAST(t.tw AS BIGINT) AS tw, t.tout AS tail_o_output, g.ai, g.ar, g.aw, g.ao AS tail_c_output
  FROM tails t JOIN (SELECT session_key, CAST(sum(c_input) AS BIGINT) AS ai, CAST(sum(c_read) AS BIGINT) AS ar, CAST(sum(c_write) AS BIGINT) AS aw,
      CAST(sum(c_output) AS BIGINT) AS ao FROM counter_side GROUP BY session_key) g USING (session_key)
  WHERE t.ti = g.ai AND t.tr = g.ar AND t.tw = g.aw
  QUALIFY row_number() OVER (PARTITION BY t.session_key ORDER BY t.n) = 1),
sums AS (
  SELECT session_key, sum(o_input) = sum(c_input) AND sum(o_read) = sum(c_read) AND sum(o_write) = sum(c_write) AS exact,
    sum(o_input + o_read + o_write) AS li, sum(c_input + c_read + c_write) AS ci, sum(o_output) AS lo, sum(c_output) AS co,
    sum(o_input) AS soi, sum(o_read) AS sor, sum(o_write) AS sow, sum(c_input) AS sci, sum(c_read) AS scr, sum(c_write) AS scw,
    count(*) FILTER (o_input + o_read + o_write = 0 AND c_input + c_read + c_write <> 0) AS models_counter_only,
    count(*) FILTER (c_input + c_read + c_write = 0 AND o_input + o_read + o_write <> 0) AS models_lines_only
  FROM checks GROUP BY session_key),
status AS (
  SELECT s.*, i.* EXCLUDE (session_key), h.kind, x.* EXCLUDE (session_key),
    CASE WHEN exact THEN 'exact' WHEN last_calls = of THEN 'lines_exact' WHEN last_calls IS NOT NULL THEN 'run_exact'
      WHEN pairs > 0 AND ours > counter THEN 'over' WHEN pairs > 0 AND h.kind = 'spread' THEN 'spread'
      WHEN pairs > 0 THEN 'increments_ok' WHEN restarts > 0 THEN 'restart' ELSE 'single' END AS status
  FROM sums s LEFT JOIN inc i USING (session_key) LEFT JOIN shape h USING (session_key) LEFT JOIN suffix x USING (session_key))
"""

SQL["counter_checks"] = query("SELECT * FROM checks", SNAPS)
SQL["counter_coverage"] = query("""
SELECT session_key, count(*) FILTER (line < last_line) AS calls_covered,
  count(*) FILTER (trigger <> 'subagent' AND line >= last_line) AS main_after,
  count(*) FILTER (trigger = 'subagent' AND line >= last_line) AS sub_after, CAST(0 AS BIGINT) AS sub_unlinked
FROM lined JOIN last_snap USING (session_key) GROUP BY session_key""", SNAPS)
SQL["snapshot_increments"] = query("""
SELECT session_key, snapshots, pairs, calls, ours, counter, "offset", restarts FROM inc""", SNAPS)
SQL["gap_shape"] = query("SELECT session_key, kind, steps, intervals, calls_in_steps FROM shape", SNAPS)
SQL["suffix_match"] = query("SELECT session_key, last_calls, of, since_us, tail_o_output, tail_c_output FROM suffix", SNAPS)
SQL["session_status"] = query("""
SELECT session_key, status, pairs, ours, counter, kind, last_calls, of, restarts FROM status""", SNAPS)

_FIELDS = [("input", "soi", "sci", "ti", "ai", "doi", "di"), ("read", "sor", "scr", "tr", "ar", "dor", "dr"),
           ("write", "sow", "scw", "tw", "aw", "dow", "dw"), ("output", "lo", "co", "tail_o_output", "tail_c_output", "doo", "dout")]
_PICK = "CASE WHEN status IN ('exact', 'lines_exact') THEN {0} WHEN status = 'run_exact' THEN {1} WHEN status = 'increments_ok' AND pairs > 0 THEN {2} END"
SQL["floor_gap"] = query(
    "SELECT count(*) AS sessions, " + ", ".join(
        f"CAST(sum(l_{f}) AS BIGINT) AS lines_{f}, CAST(sum(k_{f} - l_{f}) AS BIGINT) AS gap_{f}" for f, *_ in _FIELDS)
    + " FROM (SELECT " + ", ".join(
        f"{_PICK.format(a, t, d)} AS l_{f}, {_PICK.format(b, u, e)} AS k_{f}" for f, a, b, t, u, d, e in _FIELDS)
    + " FROM status) WHERE l_input IS NOT NULL", SNAPS)
SQL["unresolved_sessions"] = query("""
SELECT session_key, status, CAST(li - ci AS BIGINT) AS input_gap,
  CASE WHEN ci <> 0 THEN round(100 * CAST(li - ci AS DOUBLE) / CAST(ci AS DOUBLE), 4) END AS input_gap_pct,
  CAST(lo - co AS BIGINT) AS output_gap, kind, restarts
FROM status WHERE NOT exact ORDER BY abs(coalesce(input_gap_pct, 0)) DESC, session_key LIMIT 15""", SNAPS)
SQL["checks_summary"] = query("""
SELECT *, CASE WHEN checkable = 0 THEN 'not verified' WHEN "over" > 0 THEN 'could not verify: over'
    WHEN spread > 0 THEN 'could not verify: spread'
    WHEN increments_ok + single + restart + run_exact + lines_exact + models_counter_only + models_lines_only > 0 OR checkable < sessions
    THEN 'partly verified' ELSE 'verified' END AS verdict
FROM (SELECT count(*) AS checkable, count(*) FILTER (status = 'exact') AS exact, count(*) FILTER (status = 'lines_exact') AS lines_exact,
    count(*) FILTER (status = 'run_exact') AS run_exact, count(*) FILTER (status = 'over') AS "over", count(*) FILTER (status = 'spread') AS spread,
    count(*) FILTER (status = 'increments_ok') AS increments_ok, count(*) FILTER (status = 'restart') AS restart,
    count(*) FILTER (status = 'single') AS single, CAST(coalesce(sum(models_counter_only), 0) AS BIGINT) AS models_counter_only,
    CAST(coalesce(sum(models_lines_only), 0) AS BIGINT) AS models_lines_only,
    (SELECT count(DISTINCT session_key) FROM calls) AS sessions FROM status)""", SNAPS)
SQL["one_sided_models"] = query("""
SELECT side, model, count(*) AS sessions FROM (
  SELECT session_key, CASE WHEN session_key % 5 = 0 THEN model || '-x' ELSE model END AS model, 'counter' AS side FROM counter_side
  WHERE session_key % 5 = 0 OR model NOT IN (SELECT model FROM line_side l WHERE l.session_key = counter_side.session_key)
  UNION ALL
  SELECT session_key, model, 'lines' FROM line_side
  WHERE session_key % 5 = 0 OR model NOT IN (SELECT model FROM counter_side k WHERE k.session_key = line_side.session_key))
GROUP BY side, model""", SNAPS)
SQL["session_diagnosis"] = query(" UNION ALL ".join(
    f"SELECT session_key, model, '{f}' AS field, c_{f} AS counter, o_{f} AS ours, o_{f} - c_{f} AS difference FROM checks"
    for f in ("input", "read", "write", "output")), SNAPS)
SQL["version_status"] = query("""
SELECT version, count(*) AS sessions, count(exact) AS checkable, count(*) FILTER (exact) AS exact,
  CAST(coalesce(sum(co - lo), 0) AS BIGINT) AS output_gap
FROM (SELECT session_key, min(version) AS version FROM calls GROUP BY session_key) LEFT JOIN status USING (session_key) GROUP BY version""", SNAPS)
SQL["single_version_status"] = query("""
SELECT version, """ + ", ".join(f"count(*) FILTER (status = '{s}') AS \"{s}\"" for s in (
    "exact", "lines_exact", "run_exact", "over", "spread", "increments_ok", "restart", "single")) + """
FROM status JOIN (SELECT session_key, min(v) AS version FROM (SELECT session_key,
    CASE WHEN session_key % 11 = 0 AND turn_id % 2 = 0 THEN 'v9' ELSE version END AS v FROM calls)
  GROUP BY session_key HAVING count(DISTINCT v) = 1) USING (session_key) GROUP BY version""", SNAPS)

_HIST = "OVER (ORDER BY started_us, task_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _expand(y: str, qs: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"quantile_cont({y}, {qs}) OVER ({part}ORDER BY started_us, task_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _seen(y: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"count({y}) OVER ({part}ORDER BY started_us, task_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


_SCORE = "(hi - lo) + 10.0 * CASE WHEN y < lo THEN lo - y WHEN y > hi THEN y - hi ELSE 0 END"
_METRICS = f"""count(*) AS n, count(DISTINCT session_key) AS sessions,
  round(avg(CASE WHEN lo <= y AND y <= hi THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg({_SCORE}), 6) AS interval_score,
  round(quantile_cont(abs(mid - y), 0.5), 6) AS abs_error,
  round(quantile_cont(CASE WHEN mid > 0 AND y > 0 THEN ln(mid / y) END, 0.5), 6) AS log_error,
  round(quantile_cont(hi - lo, 0.5), 6) AS width"""
_DIST = """n, round(q[1], 6) AS lo, round(q[2], 6) AS p50, round(q[3], 6) AS hi,
  CASE WHEN q[1] <> 0 THEN round(round(q[3], 6) / round(q[1], 6), 6) END AS ratio,
  coalesce(round(round(q[3], 6) / round(q[1], 6), 6) >= 100, TRUE) AS spread"""
_FIVE = "round(q[1], 6) AS p10, round(q[2], 6) AS p25, round(q[3], 6) AS p50, round(q[4], 6) AS p75, round(q[5], 6) AS p90"
_FIVE_Q = "quantile_cont({0}, [0.1, 0.25, 0.5, 0.75, 0.9])"

SQL["turn_distribution"] = query(f"""
SELECT {_DIST} FROM (SELECT count(*) AS n, quantile_cont(turns_main, [0.125, 0.5, 0.875]) AS q FROM real_tasks)""")
SQL["turns_by_family"] = query(f"""
SELECT *, CASE WHEN n < 8 THEN 'too few' WHEN spread THEN 'too spread' WHEN ratio < 4 THEN 'tight' ELSE 'wide' END AS verdict FROM (
SELECT family, {_DIST}, round(a[1], 6) AS all_p50, round(a[2], 6) AS all_hi FROM (
  SELECT coalesce(family, 'all') AS family, count(*) AS n, quantile_cont(turns_main, [0.125, 0.5, 0.875]) AS q,
    quantile_cont(turns, [0.5, 0.875]) AS a FROM real_tasks GROUP BY GROUPING SETS ((family), ())))""")

TURN_ITEMS = f"""
titems AS (SELECT session_key, task_id, started_us, y, q[1] AS lo, q[2] AS mid, q[3] AS hi, q[3] / q[1] >= 100 AS spread FROM (
  SELECT session_key, task_id, started_us, turns_main AS y, {_expand('turns_main', '[0.125, 0.5, 0.875]')} AS q,
    {_seen('turns_main')} AS n_before FROM real_tasks) WHERE n_before >= 8),
fitems AS (SELECT session_key, y, q[1] AS lo, q[2] AS mid, q[3] AS hi, q[3] / q[1] >= 100 AS spread FROM (
  SELECT session_key, turns_main AS y, {_expand('turns_main', '[0.125, 0.5, 0.875]', 'family')} AS q,
    {_seen('turns_main', 'family')} AS n_before FROM real_tasks) WHERE n_before >= 8)
"""
SQL["backtest_turns"] = query(f"""
SELECT basis, count(*) FILTER (spread) AS spread, count(*) FILTER (NOT spread) AS n, count(DISTINCT session_key) FILTER (NOT spread) AS sessions,
  round(avg(CASE WHEN lo <= y AND y <= hi THEN 1.0 ELSE 0.0 END) FILTER (NOT spread), 6) AS coverage,
  round(avg({_SCORE}) FILTER (NOT spread), 6) AS interval_score, round(quantile_cont(abs(mid - y), 0.5) FILTER (NOT spread), 6) AS abs_error,
  round(quantile_cont(CASE WHEN mid > 0 AND y > 0 THEN ln(mid / y) END, 0.5) FILTER (NOT spread), 6) AS log_error,
  round(quantile_cont(hi - lo, 0.5) FILTER (NOT spread), 6) AS width
FROM (SELECT 'all' AS basis, session_key, y, lo, mid, hi, spread FROM titems UNION ALL
      SELECT 'family', session_key, y, lo, mid, hi, spread FROM fitems) GROUP BY basis""", TURN_ITEMS)

_RANKED = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY started_us, task_id) AS rank,
   lag(turns_main) OVER (PARTITION BY session_key ORDER BY started_us, task_id) AS before FROM real_tasks)
"""
_RANK_SLICE = "CASE WHEN rank <= 1 THEN '1st' WHEN rank <= 3 THEN '2-3' WHEN rank <= 10 THEN '4-10' WHEN rank <= 30 THEN '11-30' ELSE '31+' END"
SQL["leak_free_by_slice"] = query(f"""
SELECT task_id, label, n_slice, n_before, n_slice < 30 AS fell_back,
  round(CASE WHEN n_slice >= 30 THEN s[1] ELSE b[1] END, 6) AS lo, round(CASE WHEN n_slice >= 30 THEN s[2] ELSE b[2] END, 6) AS mid,
  round(CASE WHEN n_slice >= 30 THEN s[3] ELSE b[3] END, 6) AS hi, round(b[1], 6) AS b_lo, round(b[2], 6) AS b_mid, round(b[3], 6) AS b_hi
FROM (SELECT *, {_expand('turns_main', '[0.1, 0.5, 0.9]', 'label')} AS s, {_seen('turns_main', 'label')} AS n_slice,
   {_expand('turns_main', '[0.1, 0.5, 0.9]')} AS b, {_seen('turns_main')} AS n_before
  FROM (SELECT *, {_RANK_SLICE} AS label FROM ranked)) WHERE n_before >= 8""", _RANKED)
SQL["interval_metrics"] = query(f"SELECT session_key, {_METRICS} FROM titems WHERE NOT spread GROUP BY session_key", TURN_ITEMS)

_ENDS = [format(min(int(2**32 * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))), 2**32 - 1), "08x") for n in range(12)]
RESAMPLE = f"""
weights AS (SELECT g, session_key, i, CASE {' '.join(f"WHEN h < '{e}' THEN {n}" for n, e in enumerate(_ENDS))} ELSE 12 END AS w
  FROM (SELECT {{g}} AS g, session_key, i, substr(md5((i // 4) || ':' || session_key), 1 + 8 * (i % 4), 8) AS h
        FROM (SELECT *, count(*) OVER (PARTITION BY {{g}}) AS s FROM (SELECT DISTINCT {{g}}, session_key FROM {{items}})), range(400) r(i) WHERE s > 1))
"""
_BOOT_ITEMS = f"""
bitems AS (SELECT 0 AS g, session_key, CASE WHEN lo <= y AND y <= hi THEN 1.0 ELSE 0.0 END AS coverage, {_SCORE} AS interval_score,
  abs(mid - y) AS abs_error, CASE WHEN mid > 0 AND y > 0 THEN ln(mid / y) END AS log_error, hi - lo AS width FROM titems WHERE NOT spread)
"""
_AT = "round(list_sort(list({0}) FILTER ({0} IS NOT NULL))[1 + CAST(floor({1} * (count({0}) - 1) + 1e-9) AS INT)], 6)"
_CI = f"{_AT.format('{0}', 0.025)} AS {{0}}_lo, {_AT.format('{0}', 0.975)} AS {{0}}_hi"
SQL["bootstrap_ci"] = query(
    "SELECT " + ", ".join(_CI.format(x) for x in ("coverage", "interval_score", "abs_error", "log_error", "width")) + """
FROM (SELECT i, sum(w * sc) / sum(w * n) AS coverage, sum(w * si) / sum(w * n) AS interval_score
      FROM weights JOIN (SELECT session_key, sum(coverage) AS sc, sum(interval_score) AS si, count(*) AS n FROM bitems GROUP BY session_key) USING (session_key)
      GROUP BY i)
JOIN (SELECT i, quantile_cont(abs_error, 0.5) AS abs_error, quantile_cont(log_error, 0.5) AS log_error, quantile_cont(width, 0.5) AS width
      FROM (SELECT i, b.*, unnest(range(w)) FROM weights JOIN bitems b USING (session_key)) GROUP BY i) USING (i)""",
    TURN_ITEMS, _BOOT_ITEMS, RESAMPLE.format(g="g", items="bitems"))

SQL["survival_by_k"] = query(f"""
SELECT k, n, {_FIVE}, ends_at_k FROM (
  SELECT k, count(*) AS n, {_FIVE_Q.format('turns_main - k')} AS q, count(*) FILTER (turns_main = k) AS ends_at_k
  FROM real_tasks, (VALUES (1), (2), (3), (5), (10)) t(k) WHERE turns_main >= k GROUP BY k)""")
SQL["turns_ahead_backtest"] = query(f"""
SELECT k, {_METRICS} FROM (
  SELECT k, session_key, y, q[1] AS lo, q[2] AS mid, q[3] AS hi FROM (
    SELECT *, {_expand('y', '[0.1, 0.5, 0.9]', 'k')} AS q, {_seen('y', 'k')} AS n_before
    FROM (SELECT *, turns_main - k AS y FROM real_tasks, (VALUES (0), (1), (2), (3), (5), (10)) t(k) WHERE turns_main >= greatest(k, 1)))
  WHERE n_before >= 8) GROUP BY k""")

EARLY = """
nth AS (SELECT turn_id, source, task_id, row_number() OVER (PARTITION BY source, task_id ORDER BY t_us, turn_id) AS nth
        FROM calls WHERE trigger <> 'subagent'),
early AS (SELECT n.source, n.task_id, k, coalesce(bool_or(t.name = 'Edit'), FALSE) AS edited, FALSE AS planned,
   coalesce(bool_or(t.name = 'Agent'), FALSE) AS launched, count(*) FILTER (t.name = 'Bash') AS shell
  FROM nth n JOIN (VALUES (2), (3)) x(k) ON n.nth <= k LEFT JOIN tools t USING (turn_id) GROUP BY ALL)
"""
_SHELL4 = "CASE WHEN shell = 0 THEN '0' WHEN shell <= 2 THEN '1-2' WHEN shell <= 5 THEN '3-5' ELSE '6+' END"
SQL["turns_ahead"] = query(f"""
SELECT session_key, task_id, k, CASE WHEN n3 >= 30 THEN ss || ' shell' ELSE 'all' END AS basis, CASE WHEN n3 >= 30 THEN n3 ELSE na END AS n,
  round(CASE WHEN n3 >= 30 THEN q3[1] ELSE qa[1] END, 6) AS p50, round(CASE WHEN n3 >= 30 THEN q3[2] ELSE qa[2] END, 6) AS hi
FROM (SELECT r.session_key, r.task_id, r.k, min(r.ss) AS ss, count(*) AS na, quantile_cont(h.turns_main - r.k, [0.5, 0.875]) AS qa,
    count(*) FILTER (r.k = 3 AND h.ss = r.ss) AS n3, quantile_cont(h.turns_main - r.k, [0.5, 0.875]) FILTER (r.k = 3 AND h.ss = r.ss) AS q3
  FROM running r JOIN hist h ON h.turns_main >= r.k AND h.task_id <> r.task_id GROUP BY r.session_key, r.task_id, r.k)
WHERE na >= 30 OR n3 >= 30""", EARLY, f"""
hist AS (SELECT s.task_id, s.turns_main, {_SHELL4} AS ss FROM stats s LEFT JOIN early e ON e.task_id = s.task_id AND e.k = 3 WHERE tracked AND turns_main > 0),
running AS (SELECT x.session_key, x.task_id, x.turns_main AS k, h.ss FROM (
  SELECT * FROM stats WHERE turns_main > 0 QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY last_us DESC, task_id DESC) = 1) x
  LEFT JOIN hist h USING (task_id) WHERE x.tracked AND x.turns_main >= 3)""")
SQL["early_signs"] = query(f"""
SELECT sign, label, n, {_FIVE} FROM (SELECT sign, label, count(*) AS n, {_FIVE_Q.format('y')} AS q FROM (
  SELECT r.turns_main - e.k AS y, unnest(['first ' || e.k || ' turns: edited a file', 'first ' || e.k || ' turns: planned',
      'first ' || e.k || ' turns: launched a sub-agent', 'first ' || e.k || ' turns: shell commands']) AS sign,
    unnest([CASE WHEN edited THEN 'yes' ELSE 'no' END, CASE WHEN planned THEN 'yes' ELSE 'no' END, CASE WHEN launched THEN 'yes' ELSE 'no' END,
      CASE WHEN shell = 0 THEN '0' WHEN shell <= 2 THEN '1-2' ELSE '3+' END]) AS label
  FROM early e JOIN real_tasks r USING (source, task_id) WHERE r.turns_main >= e.k) GROUP BY sign, label)""", EARLY)

GROWTH = """
grown AS (SELECT session_key, task_id, turn_id, t_us, input_total - p_in - p_out AS grew FROM (
  SELECT *, lag(input_total) OVER g AS p_in, lag(output) OVER g AS p_out FROM calls WHERE trigger <> 'subagent'
  WINDOW g AS (PARTITION BY session_key, task_id ORDER BY t_us, turn_id)) WHERE p_in IS NOT NULL AND input_total >= 0.5 * p_in)
"""
SQL["context_growth"] = query("""
SELECT task_id, count(*) AS turns, CAST(sum(grew) AS BIGINT) AS grew, count(*) FILTER (grew < 0) AS shrank
FROM grown WHERE task_id <> -1 GROUP BY task_id""", GROWTH)


def _text(s: str) -> str:
    return "E'" + s.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n") + "'"


def _phrases() -> str:
    from callmeter.plans.bridge import PHRASES

    return "phrases AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_text(p)})" for i, p in enumerate(PHRASES)) + ") t(i, phrase))"


# RE2 has no Unicode word class: W and NW spell it out
_W = r"[\p{L}\p{N}_]"
_NORM = r"regexp_replace(trim(regexp_replace(lower({0}), '\s+', ' ', 'g')), '[\s.!?,;:…]+$', '')"


def _features(t: str) -> str:
    from callmeter.functions.text import FOLLOWUPS

    fu = ", ".join("'" + p.replace("'", "''") + "'" for p in FOLLOWUPS)
    err = (r"(?m)Traceback \(most recent call last\)|(Error|Exception):|(^|[^\p{L}\p{N}_])FAILED([^\p{L}\p{N}_]|$)|panicked at"
           r"|^\s+at .+:\d+|error\[E\d+\]|npm ERR!|fatal:")
    return rf"""length({t}) AS chars, {_NORM.format(t)} IN ({fu}) AS followup, regexp_matches({t}, '{err}') AS error,
  len(list_distinct(regexp_extract_all({t}, '(?:^|\s)@?[\p{{L}}\p{{N}}_./-]+\.[A-Za-z0-9]{{1,6}}\b'))) AS n_files,
  len(regexp_extract_all({t}, '(?m)^\s*(?:[-*•]|\d+[.)])\s+\S')) AS n_items, regexp_replace({t}, '\s+$', '') LIKE '%?' AS question,
  nullif(regexp_extract({t}, '<command-name>/?([\p{{L}}\p{{N}}_:.-]+)</command-name>', 1), '') AS command"""


PROMPTED = _phrases() + f""",
prompted AS (SELECT r.*, {_features('p.phrase')} FROM real_tasks r JOIN phrases p ON p.i = (r.task_id * 7) % 30)
"""
SQL["merge_followups"] = query(f"""
SELECT session_key, arg_min(task_id, (started_us, task_id)) AS task_id, CAST(sum(turns_main) AS BIGINT) AS turns_main,
  CAST(sum(turns) AS BIGINT) AS turns, count(*) AS tasks, {usd('sum(cost_p)')} AS cost
FROM (SELECT *, sum(CASE WHEN followup THEN 0 ELSE 1 END) OVER (PARTITION BY session_key ORDER BY started_us, task_id) AS island FROM prompted)
GROUP BY session_key, island""", PROMPTED)
SQL["followup_study"] = query("""
SELECT count(*) AS tasks, count(chars) AS with_prompt, count(*) FILTER (followup) AS followups, count(*) FILTER (chars <= 20) AS short_prompts,
  count(*) FILTER (followup AND rank = 1) AS followup_first, quantile_cont(turns_main, 0.5) FILTER (followup) AS followup_turns_p50,
  quantile_cont(turns_main, 0.5) AS turns_p50
FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY started_us, task_id) AS rank FROM prompted)""", PROMPTED)


def _top(sign_sql: str, n: int) -> str:
    return f"""SELECT sign, label, n, {_FIVE}, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY sign ORDER BY n DESC, label) AS rank FROM (
    SELECT sign, label, count(*) AS n, {_FIVE_Q.format('y')} AS q FROM ({sign_sql}) WHERE label IS NOT NULL GROUP BY sign, label)) WHERE rank <= {n}"""


_PRE = f"""SELECT turns_main AS y, unnest(['previous task''s turns', 'first of session', 'rank in session', 'project', 'model',
    'short follow-up', 'error pasted', 'prompt length', 'files mentioned', 'slash command']) AS sign,
  unnest([CASE WHEN rank = 1 THEN 'first of session' WHEN before <= 1 THEN '1' WHEN before <= 3 THEN '2-3' WHEN before <= 8 THEN '4-8'
      WHEN before <= 20 THEN '9-20' ELSE '21+' END, CASE WHEN rank = 1 THEN 'first' ELSE 'later' END, {_RANK_SLICE},
    CASE WHEN project IN (SELECT project FROM prompted GROUP BY project ORDER BY count(*) DESC, project LIMIT 10)
      THEN 'project ' || substr(sha256(project), 1, 6) ELSE 'other' END, first_model,
    CASE WHEN followup THEN 'yes' ELSE 'no' END, CASE WHEN error THEN 'yes' ELSE 'no' END,
    CASE WHEN chars <= 49 THEN '<50' WHEN chars <= 199 THEN '50-199' WHEN chars <= 999 THEN '200-999' ELSE '1000+' END,
    CASE WHEN n_files = 0 THEN '0' WHEN n_files = 1 THEN '1' WHEN n_files <= 3 THEN '2-3' ELSE '4+' END,
    CASE WHEN command IS NULL THEN 'none' ELSE '/' || command END]) AS label
  FROM (SELECT *, row_number() OVER z AS rank, lag(turns_main) OVER z AS before FROM prompted
        WINDOW z AS (PARTITION BY session_key ORDER BY started_us, task_id))"""
SQL["pre_send_signs"] = query(_top(_PRE, 12), PROMPTED)
_CTX = """SELECT session_key, task_id, started_us, turns_main AS y, unnest(['idle since previous task', 'previous task edited files',
    'previous task launched sub-agents', 'context at start', 'list items in prompt', 'prompt is a question']) AS sign,
  unnest([CASE WHEN pl IS NULL THEN 'first of session' WHEN (started_us - pl) / 1e6 <= 60 THEN '<1 min' WHEN (started_us - pl) / 1e6 <= 300 THEN '1-5 min'
      WHEN (started_us - pl) / 1e6 <= 1800 THEN '5-30 min' WHEN (started_us - pl) / 1e6 <= 7200 THEN '30 min-2 h' ELSE '2 h+' END,
    CASE WHEN pl IS NULL THEN 'first of session' WHEN pe THEN 'yes' ELSE 'no' END,
    CASE WHEN pl IS NULL THEN 'first of session' WHEN pa THEN 'yes' ELSE 'no' END,
    CASE WHEN first_input <= 30000 THEN '<30k' WHEN first_input <= 60000 THEN '30-60k' WHEN first_input <= 120000 THEN '60-120k'
      WHEN first_input <= 250000 THEN '120-250k' ELSE '250k+' END,
    CASE WHEN n_items = 0 THEN '0' WHEN n_items <= 2 THEN '1-2' WHEN n_items <= 5 THEN '3-5' ELSE '6+' END,
    CASE WHEN question THEN 'yes' ELSE 'no' END]) AS label
  FROM (SELECT p.*, lag(last_us) OVER z AS pl, lag(coalesce(edited, FALSE)) OVER z AS pe, lag(coalesce(launched, FALSE)) OVER z AS pa
        FROM prompted p LEFT JOIN (SELECT task_id, bool_or(name = 'Edit') AS edited, bool_or(name = 'Agent') AS launched FROM tools GROUP BY task_id) t USING (task_id)
        WINDOW z AS (PARTITION BY session_key ORDER BY started_us, task_id))"""
SQL["context_signs"] = query(_top(_CTX, 8), PROMPTED)
SQL["sign_pass_rule"] = query("""
SELECT sign, n, fell_back, coverage, gain, gain_lo, gain_hi, coalesce(gain_hi < 0 AND coverage BETWEEN 0.75 AND 0.85, FALSE) AS passes
FROM (SELECT sign, count(*) AS n, count(*) FILTER (n_slice < 30) AS fell_back, round(avg(covered), 6) AS coverage, round(avg(gain), 6) AS gain
      FROM gained GROUP BY sign)
LEFT JOIN (SELECT g AS sign, """ + _AT.format("x", 0.025) + " AS gain_lo, " + _AT.format("x", 0.975) + """ AS gain_hi FROM (
   SELECT g, i, sum(w * sg) / sum(w * n) AS x FROM weights JOIN (SELECT sign AS g, session_key, sum(gain) AS sg, count(*) AS n FROM gained GROUP BY ALL)
     USING (g, session_key) GROUP BY g, i) GROUP BY g) USING (sign)""", PROMPTED, f"""
ctx AS ({_CTX}),
sliced AS (SELECT *, CASE WHEN n_slice >= 30 THEN s ELSE b END AS m FROM (
  SELECT *, {_expand('y', '[0.1, 0.5, 0.9]', 'sign, label')} AS s, {_seen('y', 'sign, label')} AS n_slice,
    {_expand('y', '[0.1, 0.5, 0.9]', 'sign')} AS b, {_seen('y', 'sign')} AS n_before FROM ctx) WHERE n_before >= 8),
gained AS (SELECT *, CASE WHEN m[1] <= y AND y <= m[3] THEN 1.0 ELSE 0.0 END AS covered,
  ((m[3] - m[1]) + 10.0 * CASE WHEN y < m[1] THEN m[1] - y WHEN y > m[3] THEN y - m[3] ELSE 0 END)
  - ((b[3] - b[1]) + 10.0 * CASE WHEN y < b[1] THEN b[1] - y WHEN y > b[3] THEN y - b[3] ELSE 0 END) AS gain FROM sliced)""",
    RESAMPLE.format(g="sign", items="gained"))

def _tree_level(i: int) -> str:
    """One level of the tree: every cut of every sign of every node, the best of them, and the tasks one level down."""
    return f"""
cell{i} AS (SELECT node, y, unnest(range(5)) AS s, unnest(labels) AS label FROM grown{i} WHERE old),
place{i} AS (SELECT node, s, label, row_number() OVER (PARTITION BY node, s ORDER BY quantile_cont(y, 0.5), label) AS place,
  count(*) OVER (PARTITION BY node, s) AS k FROM cell{i} GROUP BY node, s, label),
side{i} AS (SELECT node, s, y, k, cut, place <= cut AS lft FROM (SELECT *, unnest(range(1, k + 1)) AS cut FROM cell{i} JOIN place{i} USING (node, s, label))),
level{i} AS (SELECT node, s, cut, lft, count(*) AS n, quantile_cont(y, [0.1, 0.5, 0.9]) AS q FROM side{i} GROUP BY ALL),
tried{i} AS (SELECT node, s, cut, k, min(n) AS least, round(sum(greatest(0.1 * (y - q[1]), -0.9 * (y - q[1])) + 0.5 * abs(y - q[2])
    + greatest(0.9 * (y - q[3]), -0.1 * (y - q[3]))), 4) AS loss FROM side{i} JOIN level{i} USING (node, s, cut, lft) GROUP BY node, s, cut, k),
split{i} AS (SELECT node, s, cut FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY loss, cut < k, s, cut) AS r FROM tried{i}
  WHERE cut = k OR least >= 30) WHERE r = 1 AND cut < k),
left{i} AS (SELECT node, any_value(s) AS s, list(label) AS names FROM split{i} JOIN place{i} USING (node, s) WHERE place <= cut GROUP BY node),
grown{i + 1} AS (SELECT g.* EXCLUDE (node), CASE WHEN s IS NULL THEN g.node WHEN list_contains(names, labels[s + 1]) THEN 2 * g.node ELSE 2 * g.node + 1 END AS node
  FROM grown{i} g LEFT JOIN left{i} l ON l.node = g.node)"""


_TREE_SIGNS = ("rank in session", "previous task''s turns", "idle since previous task", "previous task edited files", "prompt is a question")
_LEAVES = """SELECT 'tree depth {0}', session_key, y, q FROM grown{0} JOIN (SELECT node, quantile_cont(y, [0.1, 0.5, 0.9]) AS q FROM grown{0} WHERE old GROUP BY node)
  USING (node) WHERE NOT old"""
SQL["quantile_tree"] = query(f"""
SELECT method, {_METRICS} FROM (SELECT method, session_key, y, q[1] AS lo, q[2] AS mid, q[3] AS hi FROM judged) GROUP BY method""", PROMPTED, f"""
tsigns AS (SELECT session_key, task_id, sign, label FROM ({_PRE.replace("SELECT turns_main AS y", "SELECT session_key, task_id, turns_main AS y", 1)})
  UNION ALL SELECT session_key, task_id, sign, label FROM ({_CTX})),
grown0 AS (SELECT session_key, task_id, turns_main AS y, row_number() OVER (ORDER BY started_us, task_id) <= floor(count(*) OVER () * 0.7) AS old, labels, 1 AS node
  FROM real_tasks LEFT JOIN (SELECT session_key, task_id, [{", ".join(f"coalesce(max(label) FILTER (sign = '{s}'), '?')" for s in _TREE_SIGNS)}] AS labels
    FROM tsigns GROUP BY session_key, task_id) USING (session_key, task_id))""", ",".join(_tree_level(i) for i in range(3)), f"""
base AS (SELECT quantile_cont(y, [0.1, 0.5, 0.9]) AS b FROM grown0 WHERE old),
alone AS (SELECT s, label, quantile_cont(y, [0.1, 0.5, 0.9]) AS q FROM cell0 GROUP BY s, label HAVING count(*) >= 30),
judged AS (SELECT 'all training tasks' AS method, session_key, y, b AS q FROM grown0, base WHERE NOT old
  UNION ALL SELECT 'alone: ' || ['{"', '".join(_TREE_SIGNS)}'][s + 1], session_key, y, coalesce(q, b)
    FROM (SELECT session_key, y, unnest(range(5)) AS s, unnest(labels) AS label FROM grown0 WHERE NOT old) LEFT JOIN alone USING (s, label), base
  UNION ALL {_LEAVES.format(2)} UNION ALL {_LEAVES.format(3)})""")


_NINE = "[0.05, 0.075, 0.1, 0.125, 0.15, 0.175, 0.2, 0.225, 0.25, 0.5, 0.95, 0.925, 0.9, 0.875, 0.85, 0.825, 0.8, 0.775, 0.75]"
SQL["interval_recalibration"] = query(f"""
SELECT q, coverage, round(oc, 6) AS older_coverage, newer_n, newer_coverage, newer_score, newer_width,
  row_number() OVER (ORDER BY round(abs(oc - 0.8), 9), q) = 1 AS chosen
FROM (SELECT q, round(avg(hit), 6) AS coverage, avg(hit) FILTER (older) AS oc, count(*) FILTER (NOT older) AS newer_n,
    round(avg(hit) FILTER (NOT older), 6) AS newer_coverage, round(avg({_SCORE}) FILTER (NOT older), 6) AS newer_score,
    round(quantile_cont(hi - lo, 0.5) FILTER (NOT older), 6) AS newer_width
  FROM (SELECT *, CASE WHEN lo <= y AND y <= hi THEN 1.0 ELSE 0.0 END AS hit FROM (
    SELECT unnest([5.0, 7.5, 10.0, 12.5, 15.0, 17.5, 20.0, 22.5, 25.0])::DOUBLE AS q, y, n_before - 8 < floor(count(*) OVER () / 2) AS older,
      unnest([v[1], v[2], v[3], v[4], v[5], v[6], v[7], v[8], v[9]]) AS lo, unnest([v[11], v[12], v[13], v[14], v[15], v[16], v[17], v[18], v[19]]) AS hi
    FROM (SELECT turns_main AS y, {_expand('turns_main', _NINE)} AS v, {_seen('turns_main')} AS n_before FROM real_tasks QUALIFY n_before >= 8)))
  GROUP BY q)""")

COST = f"""
costed AS (SELECT session_key, task_id, started_us, turns_main AS turns, first_input, CAST(cost_p AS DOUBLE) / 1e12 AS cost,
    CAST(floor_p AS DOUBLE) / 1e12 AS flr, CAST(reread_p AS DOUBLE) / 1e12 AS reread FROM real_tasks WHERE floor_p > 0 AND cost_p > 0),
costed_q AS (SELECT *, {_expand('turns', '[0.1, 0.5, 0.9]')} AS t, {_expand('cost / flr', '[0.1, 0.5, 0.9]')} AS r,
    {_expand('cost', '[0.1, 0.5, 0.9]')} AS d, {_seen('cost')} AS n_before FROM costed)
"""
SQL["cost_methods"] = query(f"""
SELECT method, {_METRICS} FROM (
  SELECT session_key, cost AS y, unnest(['turns x context', 'turns x growing context', 'ratio x first input', 'direct']) AS method,
    unnest([flr + (greatest(t[1], 1) - 1) * reread, flr + (greatest(t[1], 1) - 1) * reread + more * (greatest(t[1], 1) - 1) * greatest(t[1], 1) / 2, r[1] * flr, d[1]]) AS lo,
    unnest([flr + (greatest(t[2], 1) - 1) * reread, flr + (greatest(t[2], 1) - 1) * reread + more * (greatest(t[2], 1) - 1) * greatest(t[2], 1) / 2, r[2] * flr, d[2]]) AS mid,
    unnest([flr + (greatest(t[3], 1) - 1) * reread, flr + (greatest(t[3], 1) - 1) * reread + more * (greatest(t[3], 1) - 1) * greatest(t[3], 1) / 2, r[3] * flr, d[3]]) AS hi
  FROM (SELECT *, reread / first_input * coalesce(g, 0.0) AS more FROM costed_q JOIN before_g USING (task_id) WHERE n_before >= 8))
GROUP BY method""", GROWTH, COST, """
before_g AS (SELECT task_id, g FROM (
  SELECT task_id, turn_id, quantile_cont(grew, 0.5) OVER (ORDER BY started_us, task_id, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g
  FROM (SELECT task_id, started_us, -1 AS turn_id, NULL AS grew FROM costed UNION ALL
        SELECT c.task_id, c.started_us, g.turn_id, g.grew FROM grown g JOIN costed c USING (task_id))) WHERE turn_id = -1)""")
SQL["cost_correction"] = query(f"""
SELECT method, {_METRICS} FROM (
  SELECT session_key, cost AS y, unnest(['turns x context', 'x median earlier ratio', 'median x ratio spread']) AS method,
    unnest([e1, e1 * x[2], e2 * x[1]]) AS lo, unnest([e2, e2 * x[2], e2 * x[2]]) AS mid, unnest([e3, e3 * x[2], e2 * x[3]]) AS hi
  FROM (SELECT *, {_expand('cost / e2', '[0.1, 0.5, 0.9]')} AS x, {_seen('cost')} AS m FROM (
    SELECT *, flr + (greatest(t[1], 1) - 1) * reread AS e1, flr + (greatest(t[2], 1) - 1) * reread AS e2, flr + (greatest(t[3], 1) - 1) * reread AS e3
    FROM costed_q WHERE n_before >= 8)) WHERE m >= 8)
GROUP BY method""", COST)

SQL["dedup_calls"] = query("""
SELECT turn_id, model, input_new, cache_read, cache_write, output, 1 + turn_id % 4 AS lines FROM calls""")
_F4 = ("input_new", "cache_read", "cache_write", "output")
_NAIVE = {n: (f"sum({n} * (1 + turn_id % 4))" if n != "output" else "sum(output + (turn_id % 4) * (output // 2))") for n in _F4}
SQL["duplication_ratio"] = query(
    "SELECT count(*) AS calls, CAST(sum(1 + turn_id % 4) AS BIGINT) AS lines, round(CAST(sum(1 + turn_id % 4) AS DOUBLE) / count(*), 4) AS lines_per_call, "
    + ", ".join(f"CAST(sum({n}) AS BIGINT) AS once_{n}, CAST({x} AS BIGINT) AS naive_{n}, round(CAST({x} AS DOUBLE) / CAST(sum({n}) AS DOUBLE), 4) AS ratio_{n}"
                for n, x in _NAIVE.items()) + " FROM calls")
SQL["lines_per_call"] = query("SELECT 1 + turn_id % 4 AS lines, count(*) AS calls FROM calls GROUP BY 1")
SQL["task_chain"] = query("SELECT turn_id, task_id FROM calls")
SQL["trigger_walk"] = query("""
SELECT turn_id, trigger, CASE trigger WHEN 'user_turn' THEN length('go ' || turn_id) WHEN 'tool_call' THEN turn_id % 50 END AS added_chars FROM calls""")
SQL["json_tolerant_scan"] = """
SELECT bucket, reason, count(*) AS n FROM (
  SELECT unnest([CASE WHEN i % 17 = 0 OR i % 19 = 0 THEN 'unreadable' WHEN i % 13 = 0 THEN 'ignored' WHEN i % 11 = 0 THEN 'unknown_type'
      WHEN i % 7 = 0 THEN 'unreadable' WHEN i % 5 = 0 THEN 'used' ELSE 'unreadable' END,
    CASE WHEN i % 17 <> 0 AND i % 19 <> 0 AND i % 13 <> 0 AND i % 11 = 0 THEN 'unknown_with_tokens' END]) AS bucket,
    CASE WHEN i % 17 = 0 THEN 'bad_json' WHEN i % 19 = 0 THEN 'not_an_object' WHEN i % 13 = 0 THEN 'summary' WHEN i % 11 = 0 THEN 'hologram'
      WHEN i % 7 = 0 THEN 'assistant_bad_usage' WHEN i % 5 = 0 THEN 'user' ELSE 'no_type' END AS reason
  FROM (SELECT event_id AS i FROM events)) WHERE bucket IS NOT NULL GROUP BY bucket, reason"""
SQL["cross_session_dedup"] = query("SELECT session_key, count(*) AS calls, CAST(sum(output) AS BIGINT) AS output FROM calls GROUP BY session_key")
SQL["rereads"] = query("SELECT turn_id, session_key, path FROM files WHERE turn_id IN (SELECT turn_id FROM reread_calls)")
UNUSED = """
cut_at AS (SELECT session_key, max(t_us) AS since FROM pairs WHERE input_total < 0.5 * q_input GROUP BY session_key),
paths AS (SELECT f.session_key, path, count(*) FILTER (action = 'read') AS reads, min((f.t_us, turn_id)) FILTER (action = 'read') AS fr,
    max((f.t_us, turn_id)) FILTER (action = 'write') AS lw
  FROM files f LEFT JOIN cut_at USING (session_key) WHERE since IS NULL OR f.t_us >= since GROUP BY f.session_key, path),
unused AS (SELECT session_key, count(*) AS loaded, count(*) FILTER (NOT (reads > 1 OR coalesce(lw > fr, FALSE))) AS unused,
    loaded >= 10 AND unused >= 0.7 * loaded AS flagged FROM paths WHERE reads > 0 GROUP BY session_key)
"""
SQL["unused_files"] = query("SELECT session_key, loaded, unused, flagged FROM unused", PAIRS, UNUSED)
SQL["edit_rate"] = query("""
SELECT family, count(*) AS files_read, count(*) FILTER (w) AS files_edited, round(100 * avg(CASE WHEN w THEN 1.0 ELSE 0.0 END), 4) AS edit_rate
FROM (SELECT task_id, path, bool_or(action = 'read') AS r, bool_or(action = 'write') AS w FROM files GROUP BY task_id, path)
JOIN families USING (task_id) WHERE r GROUP BY family""")
RATIO = """
ratio AS (SELECT CASE WHEN count(*) >= 10 THEN least(8.0, greatest(1.5, CAST(sum(added_chars) AS DOUBLE) / CAST(sum(input_total - q_input - q_output) AS DOUBLE)))
    ELSE 2.5 END AS ratio, count(*) AS samples
  FROM pairs WHERE trigger = 'tool_call' AND added_chars >= 1000 AND input_total - q_input - q_output > 0)
"""
SQL["chars_per_token"] = query("SELECT round(ratio, 6) AS ratio, samples FROM ratio", PAIRS, RATIO)
ASKED = _phrases() + """,
asks AS (SELECT task_id AS prompt_id, session_key, started_us - 1000000 AS made_us, length(phrase) AS chars, task_id % 3 * 1000 AS add_chars,
    CASE WHEN task_id % 7 = 0 THEN 'alpha-5' END AS a_model,
    CASE WHEN task_id % 5 = 0 THEN list_extract(['question', 'refactor', 'review', 'measure'], CAST(task_id % 4 + 1 AS INTEGER)) END AS a_family
  FROM real_tasks JOIN phrases ON i = (task_id * 7) % 30),
lasts AS (SELECT session_key, t_us, turn_id, model, input_total, output, task_id,
    coalesce(last_value(CASE WHEN cache_write > 0 THEN CASE WHEN cache_write_1h > 0 THEN 3600 ELSE 300 END END IGNORE NULLS)
      OVER (PARTITION BY session_key ORDER BY t_us, turn_id ROWS UNBOUNDED PRECEDING), 300) AS ttl FROM main_rows),
joined AS (SELECT a.*, l.* EXCLUDE (session_key), coalesce(a_model, model) AS m, made_us - t_us AS gap_us, (SELECT ratio FROM ratio) AS ratio
  FROM asks a JOIN lasts l ON l.session_key = a.session_key AND l.t_us <= a.made_us
  QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY l.t_us DESC, l.turn_id DESC) = 1),
asked AS (
  SELECT *, CASE WHEN warm THEN input_total ELSE 0 END AS cached, input_next - cached AS to_write,
    cached * p_read + to_write * pw AS floor_p, input_total * p_read + (input_next - input_total) * pw AS warm_p
  FROM (SELECT j.*, j.input_total + j.output + CAST(round_even(chars / ratio, 0) AS BIGINT) + CAST(round_even(add_chars / ratio, 0) AS BIGINT) AS input_next,
      m = j.model AND gap_us <= ttl * CAST(1000000 AS BIGINT) AS warm, x.p_read, x.p_out, x.max_output,
      CASE WHEN ttl = 3600 THEN x.p_write_1h ELSE x.p_write_5m END AS pw
    FROM joined j JOIN px x ON x.price_key = m))
"""
SQL["next_call_input"] = query(f"""
SELECT prompt_id, session_key, m AS model, input_next, cached, to_write, ttl, warm, gap_us, {usd('floor_p', 8)} AS floor_cost,
  {usd('warm_p', 8)} AS warm_cost FROM asked""", PAIRS, RATIO, ASKED)
BASIS = f"""
ranks AS (SELECT *, {_RANK_SLICE} AS slice FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY started_us, task_id) AS rank FROM real_tasks)),
placed AS (SELECT *, {_RANK_SLICE.replace('rank', 'rank_next')} AS slice_next FROM (
  SELECT a.*, 1 + (SELECT count(*) FROM real_tasks r WHERE r.session_key = a.session_key) AS rank_next FROM asked a)),
sized AS (SELECT p.*, (SELECT count(*) FROM ranks r WHERE r.family = p.a_family AND r.task_id <> p.task_id) AS nf,
    (SELECT count(*) FROM ranks r WHERE r.slice = p.slice_next AND r.task_id <> p.task_id) AS nr FROM placed p),
near_words AS (SELECT DISTINCT task_id, started_us, unnest(regexp_extract_all(lower(phrase), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]{{3,}}')) AS word FROM real_tasks JOIN phrases ON i = (task_id * 7) % 30),
near_n AS (SELECT CAST(count(DISTINCT task_id) AS DOUBLE) AS n FROM near_words),
near_idf AS (SELECT word, ln((SELECT n FROM near_n) / count(*)) AS idf FROM near_words GROUP BY word HAVING count(*) <= 0.05 * (SELECT n FROM near_n)),
near_w AS (SELECT task_id, started_us, word, idf / sqrt(sum(idf * idf) OVER (PARTITION BY task_id)) AS w FROM near_words JOIN near_idf USING (word)),
near_sims AS (SELECT a.task_id AS prompt_id, b.task_id AS near_id, any_value(b.started_us) AS near_at, round(sum(a.w * b.w), 9) AS sim FROM near_w a JOIN near_w b USING (word)
  WHERE b.started_us < a.started_us GROUP BY ALL HAVING round(sum(a.w * b.w), 9) >= 0.1),
near_30 AS (SELECT s.prompt_id, near_id FROM near_sims s JOIN asked a ON a.prompt_id = s.prompt_id AND s.near_id IS DISTINCT FROM a.task_id
  QUALIFY row_number() OVER (PARTITION BY s.prompt_id ORDER BY sim DESC, near_at DESC) <= 30 AND count(*) OVER (PARTITION BY s.prompt_id) >= 30),
based AS (SELECT *, CASE WHEN a_family IS NOT NULL AND nf >= 8 THEN 'family' WHEN a_family IS NOT NULL THEN 'all' WHEN prompt_id IN (SELECT prompt_id FROM near_30) THEN 'neighbours'
  WHEN nr >= 30 THEN 'rank' ELSE 'all' END AS basis FROM sized),
chosen AS (SELECT b.prompt_id, min(b.basis) AS basis, min(CASE b.basis WHEN 'family' THEN a_family WHEN 'rank' THEN slice_next ELSE 'all' END) AS label,
    min(b.rank_next) AS rank_next, count(*) AS samples, quantile_cont(r.turns_main, [0.125, 0.5, 0.875]) AS q, quantile_cont(r.turns, 0.5) AS a50,
    max(r.turns_main) AS mx
  FROM based b JOIN ranks r ON r.task_id <> b.task_id AND (b.basis = 'all' OR b.basis = 'family' AND r.family = b.a_family OR b.basis = 'rank' AND r.slice = b.slice_next)
  GROUP BY b.prompt_id
  UNION ALL SELECT b.prompt_id, min(b.basis), 'all', min(b.rank_next), count(*), quantile_cont(r.turns_main, [0.125, 0.5, 0.875]), quantile_cont(r.turns, 0.5), max(r.turns_main)
  FROM based b JOIN near_30 m USING (prompt_id) JOIN ranks r ON r.task_id = m.near_id WHERE b.basis = 'neighbours' GROUP BY b.prompt_id)
"""
SQL["basis_choice"] = query("""
SELECT prompt_id, basis, label, samples, rank_next, round(q[1], 6) AS lo, round(q[2], 6) AS p50, round(q[3], 6) AS hi, round(a50, 6) AS all_p50
FROM chosen""", PAIRS, RATIO, ASKED, BASIS)
SQL["estimate_floor_ceiling"] = query(f"""
SELECT prompt_id, {usd('floor_p', 8)} AS floor_cost, mx AS ceiling_turns, ci AS ceiling_input, co AS ceiling_output,
  {usd('CAST(ci AS HUGEINT) * pw + CAST(co AS HUGEINT) * p_out', 8)} AS ceiling_cost,
  round((floor_p + greatest(q[1] - 1, 0.0) * (input_next * p_read)) / 1e12, 8) AS cost_lo,
  round((floor_p + greatest(q[2] - 1, 0.0) * (input_next * p_read)) / 1e12, 8) AS cost_p50,
  round((floor_p + greatest(q[3] - 1, 0.0) * (input_next * p_read)) / 1e12, 8) AS cost_hi
FROM (SELECT *, mx * input_next + max_output * mx * (mx - 1) // 2 AS ci, mx * max_output AS co FROM asked JOIN chosen USING (prompt_id))""",
    PAIRS, RATIO, ASKED, BASIS)
SQL["cost_state"] = query(f"""
SELECT prompt_id, session_key, state, CASE WHEN state = 'warm' THEN round((ttl * CAST(1000000 AS BIGINT) - gap_us) / 1e6, 3) END AS left_s,
  input_next, {usd('floor_p', 8)} AS cost, {usd('warm_p', 8)} AS warm_cost, kept AS kept_tokens,
  {usd('kept * p_read + (input_next - kept) * pw', 8)} AS kept_cost
FROM (SELECT a.*, CASE WHEN m <> a.model THEN 'model switch' WHEN NOT warm THEN 'expired' ELSE 'warm' END AS state,
    CASE WHEN m = a.model AND NOT warm THEN least(CAST(floor(e.med) AS BIGINT), input_next) END AS kept
  FROM asked a LEFT JOIN (SELECT model, quantile_cont(cache_read, 0.5) AS med FROM expired GROUP BY model HAVING count(*) >= 10) e ON e.model = m)""",
    PAIRS, EXPIRED, RATIO, ASKED)
SQL["warning_flags"] = query(f"""
SELECT prompt_id, a.session_key, coalesce(breaks, 0) AS breaks, coalesce(break_cost, 0.0) AS break_cost, input_next > 100000 AS large_context,
  coalesce(flagged, FALSE) AS unused_files, coalesce(sh >= 30, FALSE) AS leans_on_subagents
FROM asked a LEFT JOIN (SELECT session_key, count(*) AS breaks, {usd('sum(extra_p)')} AS break_cost FROM events_lost WHERE kind = 'break' GROUP BY session_key) b USING (session_key)
LEFT JOIN unused u USING (session_key)
LEFT JOIN (SELECT family, 100.0 * sum(sub_tokens) / sum(tokens) AS sh FROM real_tasks GROUP BY family) f ON f.family = a.a_family""",
    PAIRS, RATIO, ASKED, UNUSED)
SQL["session_alerts"] = query(f"""
SELECT session_key, cost, unpriced, coalesce(missed, FALSE) AS cache_missed, context, coalesce(NOT exact, FALSE) AS counter_disagrees, coalesce(risky, 0) AS risky_lines
FROM (SELECT session_key, {usd('coalesce(sum(cost_p), 0)')} AS cost, count(*) FILTER (cost_p IS NULL) AS unpriced FROM priced GROUP BY session_key)
LEFT JOIN (SELECT session_key, q_input >= 4096 AND cache_read < 0.5 * q_input AND input_total >= 0.5 * q_input AS missed, input_total + output AS context
  FROM (SELECT *, lag(input_total) OVER (PARTITION BY session_key ORDER BY t_us, turn_id) AS q_input FROM priced WHERE trigger <> 'subagent')
  QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY t_us DESC, turn_id DESC) = 1) USING (session_key)
LEFT JOIN sums USING (session_key)
LEFT JOIN (SELECT user_id AS session_key, count(*) AS risky FROM events
  WHERE event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 13 <> 0 AND (event_id % 11 = 0 OR event_id % 7 = 0 OR event_id % 5 <> 0) GROUP BY user_id) USING (session_key)""", SNAPS)
SQL["calls_span"] = query("SELECT min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS calls FROM calls")
SQL["filtered_projects"] = query("""
SELECT project, count(*) AS calls, CAST(sum(input_total + output) AS BIGINT) AS tokens, min(t_us) AS first_us FROM priced
WHERE t_us >= 1704067200000000 + 2 * 3600000000 AND t_us < 1704067200000000 + 9 * 3600000000 AND project LIKE '%p1%' GROUP BY project""")
SQL["finished_tasks"] = query("""
SELECT task_id, session_key, last_us FROM (SELECT *, max(last_us) OVER () AS newest, row_number() OVER (PARTITION BY session_key ORDER BY started_us DESC, task_id DESC) AS back FROM real_tasks)
WHERE NOT (back = 1 AND newest - last_us < CAST(3600000000 AS BIGINT))""")

ESTIMATES = """
est AS (SELECT e.*, 1 + est_id % 3 AS lo, CASE WHEN est_id % 23 <> 0 THEN 3 + est_id % 3 END AS p50, 7 + est_id % 3 AS hi, est_id % 29 = 0 AS spread,
    CAST(0.01 AS DOUBLE) * (est_id % 3) AS cost_lo, CAST(0.05 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (est_id % 3) AS cost_p50,
    CAST(0.2 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (est_id % 3) AS cost_hi, 20000 + 600 * (est_id % 50) AS input_next,
    CASE WHEN est_id % 2 = 0 THEN 20000 ELSE 0 END AS cached, CASE WHEN est_id % 2 = 0 THEN 'question' ELSE 'refactor' END AS e_family,
    CASE WHEN est_id % 9 = 0 THEN 'declared' ELSE 'guessed' END AS family_source
  FROM (SELECT task_id * 2 + second AS est_id, session_key,
      started_us - (CASE WHEN task_id % 7 = 0 THEN 2000 ELSE task_id % 40 END + 2 * second) * CAST(1000000 AS BIGINT) AS made_us
    FROM real_tasks, (VALUES (0), (1)) s(second) WHERE task_id % 4 <> 0 AND (second = 0 OR task_id % 5 = 0)) e),
nexts AS (SELECT est_id, e.session_key, made_us, task_id AS next_id, started_us FROM est e
  JOIN (SELECT * FROM stats WHERE tracked AND turns_main > 0) t ON t.session_key = e.session_key AND t.started_us >= e.made_us - 5000000
  QUALIFY row_number() OVER (PARTITION BY est_id ORDER BY started_us, task_id) = 1),
linked AS (SELECT e.est_id, e.session_key, e.made_us, CASE WHEN started_us - e.made_us <= 1800000000 THEN next_id END AS cand FROM est e LEFT JOIN nexts USING (est_id)),
settled AS (SELECT l.est_id, l.session_key, l.made_us,
    CASE WHEN cand IS NOT NULL AND row_number() OVER (PARTITION BY l.session_key, cand ORDER BY l.made_us DESC, est_id) > 1 THEN 'superseded'
      WHEN cand IS NOT NULL THEN 'linked' WHEN 1704067200000000 + 43200000000 - l.made_us > 1800000000 THEN 'unmatched' ELSE 'open' END AS status, cand
  FROM linked l),
finals AS (SELECT s.est_id, s.made_us, s.status, CASE WHEN status = 'linked' THEN cand END AS task_id,
    coalesce(status = 'linked' AND ((SELECT max(o.started_us) FROM stats o WHERE o.session_key = s.session_key AND o.tracked AND o.turns_main > 0) > t.started_us
      OR 1704067200000000 + 43200000000 - t.last_us > 3600000000), FALSE) AS finished
  FROM settled s LEFT JOIN stats t ON t.task_id = s.cand AND t.session_key = s.session_key)
"""
SQL["settle_estimates"] = query("SELECT est_id, status, task_id, finished FROM finals", ESTIMATES)
_USD_DONE = "CAST(cost_p AS DOUBLE) / 1e12"
SQL["scorecard"] = query(f"""
SELECT count(*) AS n, count(*) FILTER (good) AS with_interval, count(*) FILTER (p50 IS NOT NULL AND spread) AS no_interval_spread,
  count(*) FILTER (p50 IS NULL) AS no_history, count(*) FILTER (good AND turns_main BETWEEN lo AND hi) AS turns_inside,
  round(quantile_cont(abs(turns_main - p50), 0.5), 6) AS turns_median_abs_error, round(quantile_cont(turns_main / p50, 0.5), 6) AS turns_median_ratio,
  count(*) FILTER (good AND unpriced = 0) AS cost_scored, count(*) FILTER (good AND unpriced = 0 AND {_USD_DONE} BETWEEN cost_lo AND cost_hi) AS cost_inside,
  round(quantile_cont({_USD_DONE} / cost_p50, 0.5) FILTER (good AND unpriced = 0), 6) AS cost_median_ratio,
  round(quantile_cont((first_input - input_next) / first_input, 0.5), 6) AS input_median_error,
  count(*) FILTER (abs((first_input - input_next) / first_input) <= 0.05) AS input_within_5pct,
  count(*) FILTER (CASE WHEN cached = 0 THEN first_cache_read < 0.1 * first_input ELSE first_cache_read >= 0.9 * cached END) AS cache_as_said,
  count(*) FILTER (family_source <> 'declared') AS family_guessed, count(*) FILTER (family_source <> 'declared' AND e_family = family) AS family_same_after
FROM (SELECT e.*, s.*, p50 IS NOT NULL AND NOT spread AS good FROM finals f JOIN est e USING (est_id) JOIN stats s ON s.task_id = f.task_id
      WHERE f.finished ORDER BY f.made_us DESC, f.est_id DESC LIMIT 50)""", ESTIMATES)

_Q = "round(quantile_cont({0}, {1}) FILTER ({2}), 6)"
SQL["computed_backtest"] = query(f"""
SELECT count(*) AS prompts, count(*) FILTER (abs(error) <= 0.05) AS input_within_5pct, count(*) FILTER (cold IS NOT NULL) AS cold_said,
  count(*) FILTER (cold IS NOT NULL AND share < 0.1) AS cold_was_cold, count(*) FILTER (warm) AS warm_said, count(*) FILTER (warm AND share >= 0.9) AS warm_was_warm,
  count(*) FILTER (missed) AS missed, count(*) FILTER (missed AND cold = 'model') AS missed_switch,
  count(*) FILTER (missed AND cold = 'idle' AND ttl = 300) AS missed_idle_5m, count(*) FILTER (missed AND cold = 'idle' AND ttl = 3600) AS missed_idle_1h,
  count(*) FILTER (missed AND share >= 0.9) AS missed_fully_warm, count(*) FILTER (missed AND cold = 'idle' AND ttl = 300 AND gap_s <= 3600) AS missed_idle_5m_under_1h,
  {_Q.format('error', 0.1, 'TRUE')} AS input_error_p10, {_Q.format('error', 0.5, 'TRUE')} AS input_error_p50, {_Q.format('error', 0.9, 'TRUE')} AS input_error_p90,
  {_Q.format('share', 0.5, 'cold IS NOT NULL')} AS cold_share_p50, {_Q.format('share', 0.9, 'cold IS NOT NULL')} AS cold_share_p90,
  {_Q.format('share', 0.5, 'warm')} AS warm_share_p50, {_Q.format('share', 0.5, 'missed')} AS missed_share_p50,
  {_Q.format('gap_s', 0.1, "missed AND cold = 'idle'")} AS missed_gap_s_p10, {_Q.format('gap_s', 0.5, "missed AND cold = 'idle'")} AS missed_gap_s_p50,
  {_Q.format('gap_s', 0.9, "missed AND cold = 'idle'")} AS missed_gap_s_p90
FROM (SELECT *, coalesce(cold IS NOT NULL AND share >= 0.1, FALSE) AS missed FROM (
  SELECT (input_total - (q_input + q_output + CAST(round_even(length(phrase) / (SELECT ratio FROM ratio), 0) AS BIGINT))) / input_total AS error,
    CASE WHEN q_input >= 4096 THEN cache_read / q_input END AS share, ttl, (t_us - q_us) / 1e6 AS gap_s,
    CASE WHEN q_input >= 4096 AND (model <> q_model OR t_us - q_us > ttl * CAST(1000000 AS BIGINT))
      THEN CASE WHEN model <> q_model THEN 'model' ELSE 'idle' END END AS cold,
    q_input >= 4096 AND NOT (model <> q_model OR t_us - q_us > ttl * CAST(1000000 AS BIGINT)) AS warm
  FROM pairs JOIN phrases ON i = (task_id * 7) % 30
  WHERE trigger = 'user_turn' AND task_id <> -1 AND q_task <> task_id AND input_total >= 0.5 * q_input))""", PAIRS, RATIO, _phrases())


def _family(t: str) -> str:
    from callmeter.functions.text import FAMILY_PATTERNS

    out = "CASE "
    for fam, pattern in FAMILY_PATTERNS.items():  # word characters and boundaries are Unicode
        pattern = "(^|[^\\p{L}\\p{N}_])" + pattern.removeprefix(r"\b").replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\b", r"([^\p{L}\p{N}_]|$)")
        out += f"WHEN regexp_matches(lower({t}), '{pattern}') THEN '{fam}' "
    return out + f"WHEN trim({t}) <> '' THEN 'question' END"


SQL["family_crosstab"] = query(f"""
SELECT text_family, family, count(*) AS tasks, count(*) FILTER (text_family = family) AS agree, quantile_cont(turns_main, 0.5) AS turns_p50
FROM (SELECT r.*, {_family('phrase')} AS text_family FROM real_tasks r JOIN phrases ON i = (task_id * 7) % 30) GROUP BY text_family, family""", _phrases())
_CONV = "WITH " + _phrases() + """,
convs AS (SELECT conv_id * 1000 + turn AS prompt_id, text || ' ' || phrase AS text FROM conversations JOIN phrases ON i = (conv_id * 7 + turn) % 30 WHERE role = 'user'),
word_rows AS (SELECT DISTINCT prompt_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}]{3,}')) AS word FROM convs)
"""
SQL["prompt_words"] = _CONV + "SELECT word, count(*) AS prompts FROM word_rows GROUP BY word"
SQL["prompt_features"] = _CONV + f"SELECT prompt_id, {_features('text')} FROM convs"
SQL["family_from_text"] = _CONV + f"SELECT {_family('text')} AS family, count(*) AS prompts FROM convs GROUP BY 1"
SQL["nearest_prompts"] = _CONV.rstrip() + """,
total AS (SELECT CAST(count(DISTINCT prompt_id) AS DOUBLE) AS n FROM word_rows),
dfs AS (SELECT word, ln((SELECT n FROM total) / count(*)) AS idf FROM word_rows GROUP BY word HAVING count(*) <= 0.05 * (SELECT n FROM total)),
weighted AS (SELECT prompt_id, word, idf / sqrt(sum(idf * idf) OVER (PARTITION BY prompt_id)) AS w FROM word_rows JOIN dfs USING (word)),
sims AS (SELECT a.prompt_id, b.prompt_id AS near_id, round(sum(a.w * b.w), 9) AS sim FROM weighted a JOIN weighted b USING (word)
  WHERE b.prompt_id < a.prompt_id GROUP BY ALL HAVING round(sum(a.w * b.w), 9) >= 0.1),
topk AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY sim DESC, near_id DESC) AS rank, count(*) OVER (PARTITION BY prompt_id) AS m FROM sims)
SELECT prompt_id, near_id, round(sim, 6) AS sim, rank FROM topk WHERE rank <= 5 AND m >= 5"""
SQL["sensitive_text_scan"] = r"""
WITH texts AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, coalesce(url, '') || chr(10) || coalesce(html, '') FROM pages),
lns AS (SELECT id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')) AS s FROM texts),
found AS (
  SELECT id, 'home path' AS kind, unnest(regexp_extract_all(s, '(?:/home/|/Users/|/root/|[A-Za-z]:\\+Users\\+)[\p{L}\p{N}_.-]+')) AS value FROM lns
  UNION ALL SELECT id, 'email', m FROM (SELECT id, unnest(regexp_extract_all(s, '(?i)[\p{L}\p{N}][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)*\.[a-z]{2,}')) AS m FROM lns)
    WHERE NOT regexp_matches(m, '(?i)^(?:noreply@github\.com|[\p{L}\p{N}_.+-]+@users\.noreply\.github\.com|[\p{L}\p{N}_.+-]+@example\.(?:com|org|net))$')
  UNION ALL SELECT id, 'domain', h FROM (SELECT id, unnest(regexp_extract_all(s, '(?i)https?://([\p{L}\p{N}_.-]+)', 1)) AS h FROM lns)
    WHERE NOT regexp_matches(regexp_replace(lower(h), '\.+$', ''), '(^|\.)example\.(com|net)$')
  UNION ALL SELECT id, 'denied term', t FROM lns, (VALUES ('password'), ('internal use'), ('secret')) d(t) WHERE contains(lower(s), t))
SELECT kind, value, count(*) AS findings, count(DISTINCT id) AS texts FROM found GROUP BY kind, value"""

SQL["event_contrast"] = query("""
SELECT * FROM (SELECT kind, count(*) FILTER (difference = 0) AS stayed, count(*) FILTER (difference <> 0) AS changed,
  max(so) AS stayed_of, max(co) AS changed_of
FROM kinds JOIN epairs USING (turn_id), (SELECT count(*) FILTER (difference = 0) AS so, count(*) FILTER (difference <> 0) AS co FROM epairs) GROUP BY kind)
ORDER BY round(abs(changed / greatest(changed_of, 1) - stayed / greatest(stayed_of, 1)), 9) DESC, kind LIMIT 25""", PAIRS, EXPIRED, """
epairs AS (SELECT turn_id, session_key, t0, t_us AS t1, abs(cache_read - r0) AS difference FROM (
  SELECT *, lag(t_us) OVER e AS t0, lag(cache_read) OVER e AS r0 FROM expired WINDOW e AS (PARTITION BY session_key, model ORDER BY t_us, turn_id))
  WHERE r0 <= 60000 AND cache_read <= 60000),
between_rows AS (SELECT e.turn_id, c.event_type, c.model, c.task_no % 2 AS branch FROM epairs e JOIN calls c ON c.session_key = e.session_key AND c.t_us > e.t0 AND c.t_us <= e.t1),
kinds AS (SELECT DISTINCT turn_id, 'type:' || event_type AS kind FROM between_rows
  UNION ALL SELECT turn_id, 'model changed' FROM between_rows GROUP BY turn_id HAVING count(DISTINCT model) > 1
  UNION ALL SELECT turn_id, 'git branch changed' FROM between_rows GROUP BY turn_id HAVING count(DISTINCT branch) > 1)""")
SQL["stream_dedup_calls"] = "SELECT event_id AS turn_id, user_id AS session_key, event_type AS model, 100 + CAST(floor(value * 10) AS BIGINT) AS output, 1 + event_id % 4 AS lines FROM events"
SQL["stream_corrections"] = query("""
SELECT turn_id, session_key, model, output + CASE WHEN turn_id % 7 = 3 THEN 7 ELSE 0 END AS output, 1 + turn_id % 4 AS lines, turn_id % 7 = 3 AS exact,
  CASE WHEN turn_id % 5 = 2 AND turn_id % 4 > 0 THEN 2 ELSE 1 END + CASE WHEN turn_id % 7 = 3 THEN 1 ELSE 0 END AS versions FROM calls""")
SQL["stream_session_state"] = query(f"""
SELECT m.session_key, turn_id, task_id, k, calls, unpriced, cost, context, coalesce(p_total >= 4096 AND cache_read < 0.5 * p_total AND input_total >= 0.5 * p_total, false) AS cache_missed,
  ttl, t_us + CAST(ttl AS BIGINT) * 1000000 AS expired_us
FROM (SELECT *, lag(input_total) OVER o AS p_total, count(*) OVER (PARTITION BY session_key, task_id) AS k, input_total + output AS context, row_number() OVER (PARTITION BY session_key ORDER BY t_us DESC, turn_id DESC) AS back
  FROM calls WHERE trigger <> 'subagent' WINDOW o AS (PARTITION BY session_key ORDER BY t_us, turn_id)) m
JOIN (SELECT session_key, count(*) AS calls, count(*) FILTER (cost_p IS NULL) AS unpriced, {usd('coalesce(sum(cost_p), 0)')} AS cost FROM priced GROUP BY session_key) USING (session_key)
JOIN (SELECT session_key, coalesce(arg_max(CASE WHEN cache_write_1h > 0 THEN 3600 ELSE 300 END, (t_us, turn_id)) FILTER (cache_write > 0), 300) AS ttl
  FROM calls WHERE trigger <> 'subagent' GROUP BY session_key) USING (session_key)
WHERE back = 1""")
SQL["stream_live_sessions"] = query(f"""
SELECT session_key, calls, cost, ttl, tokens, model FROM (SELECT session_key, count(*) AS calls, {usd('sum(cost_p)')} AS cost FROM priced GROUP BY session_key)
JOIN (SELECT session_key, coalesce(arg_max(CASE WHEN cache_write_1h > 0 THEN 3600 ELSE 300 END, (t_us, turn_id)) FILTER (cache_write > 0), 300) AS ttl,
    arg_max(input_total + output, (t_us, turn_id)) AS tokens, arg_max(model, (t_us, turn_id)) AS model
  FROM calls WHERE trigger <> 'subagent' GROUP BY session_key) USING (session_key)""")
SQL["declared_families"] = query("""
SELECT source, task_id, arg_max(family, (declared_at, family)) AS declared FROM (
  SELECT g.source, any_value(g.tag) AS family, any_value(g.declared_at) AS declared_at, min(t.id) AS task_id
  FROM (SELECT *, CAST(task_id AS VARCHAR)[:length(CAST(task_id AS VARCHAR)) - task_id % 2] AS prefix, CASE WHEN task_id % 5 < 2 THEN 'review' ELSE 'question' END AS tag,
      started_us AS declared_at FROM real_tasks WHERE task_id % 3 = 0) g
  JOIN (SELECT source, CAST(task_id AS VARCHAR) AS id FROM real_tasks) t ON t.source = g.source AND starts_with(t.id, g.prefix)
  GROUP BY g.source, g.task_id HAVING count(*) = 1) GROUP BY source, task_id""")
SQL["families_with_declared"] = query("""
SELECT t.source, CAST(t.task_id AS VARCHAR) AS task_id, coalesce(d.declared, t.family) AS family, CASE WHEN d.declared IS NULL THEN 'guessed' ELSE 'declared' END AS family_source
FROM real_tasks t LEFT JOIN (
  SELECT source, task_id, arg_max(family, (declared_at, family)) AS declared FROM (
    SELECT g.source, any_value(g.tag) AS family, any_value(g.declared_at) AS declared_at, min(x.id) AS task_id
    FROM (SELECT *, CAST(task_id AS VARCHAR)[:length(CAST(task_id AS VARCHAR)) - task_id % 2] AS prefix, CASE WHEN task_id % 5 < 2 THEN 'review' ELSE 'question' END AS tag,
        started_us AS declared_at FROM real_tasks WHERE task_id % 3 = 0) g
    JOIN (SELECT source, CAST(task_id AS VARCHAR) AS id FROM real_tasks) x ON x.source = g.source AND starts_with(x.id, g.prefix)
    GROUP BY g.source, g.task_id HAVING count(*) = 1) GROUP BY source, task_id) d ON d.source = t.source AND d.task_id = CAST(t.task_id AS VARCHAR)""")
SQL["picked_sessions"] = query("""
SELECT p.task_id AS prompt_id, CASE WHEN p.task_id % 3 = 0 THEN (SELECT arg_max(session_key, (last_us, session_key)) FROM s WHERE starts_with(CAST(session_key AS VARCHAR), CAST(p.session_key AS VARCHAR)[:1]))
  WHEN p.task_id % 2 = 0 THEN h.k ELSE (SELECT arg_max(session_key, (last_us, session_key)) FROM s) END AS session_key
FROM real_tasks p LEFT JOIN (SELECT cwd, arg_max(session_key, (last_us, session_key)) AS k FROM s GROUP BY cwd) h ON h.cwd = p.project""", """
s AS (SELECT session_key, min(project) AS cwd, max(t_us) AS last_us FROM calls GROUP BY session_key)""")
SQL["stream_cache_events"] = query("SELECT session_key, turn_id, kind, lost_tokens, t_us - q_us AS gap_us FROM events_lost", PAIRS)
SQL["stream_finished_tasks"] = query("""
SELECT session_key, any_value(task_id) AS task_id, min(t_us) AS started_us, max(t_us) AS last_us, count(*) AS turns_main,
  CASE WHEN arg_max(next_us, (t_us, turn_id)) - max(t_us) <= 3600000000 THEN 'next task' ELSE 'silence' END AS closed_by
FROM (SELECT *, sum(CASE WHEN task_id = p_task AND t_us - p_us <= 3600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY session_key ORDER BY t_us, turn_id) AS run
  FROM (SELECT session_key, task_id, turn_id, t_us, lag(task_id) OVER z AS p_task, lag(t_us) OVER z AS p_us, coalesce(lead(t_us) OVER z, 9000000000000000) AS next_us
    FROM calls WHERE trigger <> 'subagent' AND tracked WINDOW z AS (PARTITION BY session_key ORDER BY t_us, turn_id)))
GROUP BY session_key, run""")
SQL["stream_links"] = query("""
SELECT session_key, est_id, CASE WHEN status = 'open' THEN 'unmatched' ELSE status END AS status, CASE WHEN status = 'linked' THEN cand END AS task_id
FROM settled""", ESTIMATES)
