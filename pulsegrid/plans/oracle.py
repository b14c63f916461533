"""The registered queries as SQL over the given tables, written independently of the operators."""

from __future__ import annotations

EVENTS = """
e AS (
  SELECT event_id, ts, user_id AS user_number, 'user_' || user_id AS uid, event_type, value,
         CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) AS k,
         'users/user_' || user_id || '/devices/' || event_type || '/telemetry' AS topic,
         CASE WHEN event_id % 101 = 0 THEN 'no_topic' WHEN event_id % 97 = 0 THEN 'truncated'
              WHEN event_id % 79 = 0 THEN 'text_temperature'
              WHEN event_id % 83 = 0 THEN 'no_sequence'
              WHEN event_id % 89 = 0 THEN 'no_device' ELSE 'good' END AS fault,
         ts + to_milliseconds(event_id % 500) AS arrival,
         event_id % 4 AS part, event_id // 4 AS off
  FROM events),
good AS (SELECT * FROM e WHERE fault = 'good'),
bad AS (
  SELECT *, CASE fault WHEN 'no_device' THEN 'Empty device_id' ELSE 'Invalid JSON' END AS reason
  FROM e WHERE fault NOT IN ('good', 'no_topic'))"""

TEXT = """
texts AS (
  SELECT *, '{"battery":' || k || ',"device_id":"'
    || CASE WHEN fault = 'no_device' THEN '' ELSE event_type END
    || '","ingest_timestamp":' || (epoch_us(ts) // 1000) || ',"k":' || k
    || CASE WHEN fault = 'no_sequence' THEN '' ELSE ',"sequence_id":' || event_id END
    || ',"temperature":'
    || CASE WHEN fault = 'text_temperature' THEN '"' || value || '"' ELSE '' || value END
    || ',"time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '"}' AS whole
  FROM e),
payloads AS (
  SELECT *, CASE WHEN fault = 'truncated' THEN left(whole, length(whole) - 10) ELSE whole END
    AS payload
  FROM texts)"""

RULES = """
r(cls, pos, rule_key, operator, threshold, message) AS (VALUES
  (0, 0, 'temperature', '>', 80.0::DOUBLE, 'High Temperature Alert (Default Rule)'),
  (2, 0, 'temperature', '>', 100.0, 'Very hot'),
  (2, 1, 'battery', '<', 20.0, 'Battery low'),
  (3, 0, 'temperature', '>', 40.0, 'Warm'),
  (3, 1, 'temperature', '<', 5.0, 'Cold'),
  (4, 0, 'temperature', '!=', 0.0, 'Never'),
  (4, 1, 'k', '>=', 90.0, 'High k'),
  (5, 0, 'temperature', '>', 50.0, 'Hot'))"""


def _evaluations(cls: str = "user_number % 5") -> str:
    return f"""
found AS (
  SELECT g.uid AS user_id, g.event_type AS device_id, r.rule_key AS rule_id,
         CAST(r.pos AS BIGINT) AS pos, g.ts AS time, g.arrival, g.event_id AS sequence_id,
         CASE r.rule_key WHEN 'temperature' THEN g.value ELSE CAST(g.k AS DOUBLE) END AS value,
         r.message, r.operator, r.threshold
  FROM good g JOIN r ON r.cls = ({cls})),
ev AS (
  SELECT user_id, device_id, rule_id, pos, time, arrival, sequence_id, value, message,
         CASE operator WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold
              WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold
              ELSE false END AS triggered
  FROM found)"""


EVALUATIONS = _evaluations()
DYNAMIC = _evaluations(
    "CASE WHEN g.user_number % 5 = 2 AND g.ts >= TIMESTAMP '2024-01-15' THEN 5 "
    "ELSE g.user_number % 5 END"
)

CHANGES = """
marked AS (
  SELECT *, coalesce(lag(triggered) OVER (PARTITION BY user_id, device_id, rule_id
                     ORDER BY time, sequence_id, pos), false) AS was
  FROM ev),
history AS (
  SELECT time AS event_time, user_id, device_id, rule_id, 'Rule:' || rule_id AS alert_type,
         CASE WHEN triggered THEN message ELSE 'Alert Resolved' END AS message,
         CASE WHEN triggered THEN value END AS value,
         CASE WHEN triggered THEN 'Triggered' ELSE 'Resolved' END AS status
  FROM marked WHERE triggered <> was)"""

COMMANDS = """
cmd AS (
  SELECT uid AS user_id, event_type AS device_id, 'temperature' AS rule_id, ts AS time, arrival,
         event_id AS sequence_id, CASE event_id % 50 WHEN 7 THEN 'SNOOZE' ELSE 'DISABLE' END
           AS action,
         CASE WHEN k % 2 = 1 THEN k ELSE 30 END AS minutes
  FROM e WHERE event_type = 'error' AND event_id % 50 IN (7, 9))"""


def _machine(
    clock: str = "time",
    command_clock: str = "time",
    order: str = "clock, kind, sequence_id, pos",
    until: str = "",
) -> str:
    """The alert states stepped row by row."""
    until = until or f"{command_clock} + to_minutes(minutes)"
    return f"""
inputs AS (
  SELECT user_id, device_id, rule_id, {clock} AS clock, 0 AS kind, sequence_id, pos, time, value,
         message, triggered, NULL::VARCHAR AS action, NULL::TIMESTAMP AS until
  FROM ev
  UNION ALL
  SELECT user_id, device_id, rule_id, {command_clock}, 1, sequence_id, 0, NULL, NULL, NULL, NULL,
         action, CASE WHEN action = 'SNOOZE' THEN {until} END
  FROM cmd),
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY user_id, device_id, rule_id
                               ORDER BY {order}) AS n
  FROM inputs),
steps AS (
  SELECT DISTINCT user_id, device_id, rule_id, 0::BIGINT AS n, 'none' AS state,
         NULL::TIMESTAMP AS until, NULL::TIMESTAMP AS started, NULL::TIMESTAMP AS seen,
         NULL::DOUBLE AS current_value, NULL::VARCHAR AS emitted, NULL::TIMESTAMP AS time,
         NULL::DOUBLE AS value, NULL::VARCHAR AS message
  FROM numbered
  UNION ALL
  SELECT i.user_id, i.device_id, i.rule_id, i.n,
         CASE WHEN i.triggered THEN CASE s.state WHEN 'none' THEN 'Active'
                  WHEN 'Snoozed' THEN CASE WHEN s.until < i.clock THEN 'Active' ELSE 'Snoozed' END
                  ELSE s.state END
              WHEN NOT i.triggered THEN CASE s.state WHEN 'Disabled' THEN 'Disabled'
                  ELSE 'none' END
              WHEN s.state = 'none' THEN 'none'
              WHEN i.action = 'SNOOZE' THEN 'Snoozed' ELSE 'Disabled' END,
         CASE WHEN i.action = 'SNOOZE' THEN i.until WHEN i.action = 'DISABLE' THEN NULL
              ELSE s.until END,
         CASE WHEN i.triggered AND s.state = 'none' THEN i.time ELSE s.started END,
         CASE WHEN i.triggered THEN i.time ELSE s.seen END,
         CASE WHEN i.triggered THEN i.value ELSE s.current_value END,
         CASE WHEN i.triggered AND (s.state = 'none' OR (s.state = 'Snoozed'
                  AND s.until < i.clock)) THEN 'Triggered'
              WHEN NOT i.triggered AND s.state IN ('Active', 'Snoozed') THEN 'Resolved' END,
         i.time, i.value, i.message
  FROM steps s JOIN numbered i ON i.user_id = s.user_id AND i.device_id = s.device_id
       AND i.rule_id = s.rule_id AND i.n = s.n + 1)"""


MACHINE = _machine()
MACHINE_ARRIVAL = _machine("arrival", "time")

# By arrival at full minutes: the control stream first, then partitions in order.
MACHINE_TIES = _machine(
    "date_trunc('minute', arrival)",
    "date_trunc('minute', time)",
    "clock, -kind, CASE kind WHEN 0 THEN sequence_id % 4 END, sequence_id, pos",
)

# Only the nested rule finds numbers; endless snoozes end with the calendar.
HOSTILE = """
ev AS (
  SELECT uid AS user_id, event_type AS device_id, '$.o.p' AS rule_id, 10::BIGINT AS pos, ts AS time,
         event_id AS sequence_id, CAST(k AS DOUBLE) AS value, 'm' AS message, k >= 90 AS triggered
  FROM e WHERE event_id % 5 > 1),
cmd AS (
  SELECT uid AS user_id, event_type AS device_id, '$.o.p' AS rule_id, ts AS time,
         event_id AS sequence_id, 'SNOOZE' AS action, k
  FROM e WHERE event_type = 'error' AND event_id % 50 = 7)"""
ENDLESS = """CASE WHEN k % 2 = 1 THEN TIMESTAMP '9999-12-31 23:59:59.999999'
             ELSE TIMESTAMP '0001-01-01' END"""
MACHINE_HOSTILE = _machine(until=ENDLESS)
MACHINE_HOSTILE_LIVE = _machine(order="clock, -kind, sequence_id, pos", until=ENDLESS)

HISTORY_OF_STEPS = """
SELECT time AS event_time, user_id, device_id, rule_id, 'Rule:' || rule_id AS alert_type,
       CASE WHEN emitted = 'Resolved' THEN 'Alert Resolved' ELSE message END AS message,
       CASE WHEN emitted = 'Triggered' THEN value END AS value, emitted AS status
FROM steps WHERE emitted IS NOT NULL"""

# Live: rules as they stood at arrival, commands at their own time, everything by arrival.
LIVE = _evaluations(
    "CASE WHEN g.user_number % 5 = 2 AND g.arrival >= TIMESTAMP '2024-01-15' THEN 5 "
    "ELSE g.user_number % 5 END"
)

STATE_OF_STEPS = """
SELECT user_id, device_id, rule_id, started AS start_time, seen AS last_seen, state AS status,
       CASE WHEN state = 'Snoozed' THEN until END AS snooze_until, current_value
FROM (SELECT *, max(n) OVER (PARTITION BY user_id, device_id, rule_id) AS last_n FROM steps)
WHERE n = last_n AND state <> 'none'"""

ACTIVE = """
SELECT user_id, device_id, rule_id, min(time) AS start_time,
       max(time) AS last_seen, 'Active' AS status, NULL::TIMESTAMP AS snooze_until,
       arg_max(value, back_to_front) AS current_value
FROM (
  SELECT *, sum(CASE WHEN triggered THEN 0 ELSE 1 END) OVER (
             PARTITION BY user_id, device_id, rule_id
             ORDER BY time DESC, sequence_id DESC, pos DESC) AS false_since,
         -row_number() OVER (PARTITION BY user_id, device_id, rule_id
             ORDER BY time DESC, sequence_id DESC, pos DESC) AS back_to_front
  FROM ev_used)
WHERE false_since = 0
GROUP BY user_id, device_id, rule_id"""

COPIES = """
offered AS (
  SELECT ts, uid, event_type, event_id, value, k, 0 AS rank FROM good
  UNION ALL
  SELECT ts, uid, event_type, event_id, value + 1, k, 1 FROM good WHERE event_id % 10 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ts, uid, event_type, event_id ORDER BY rank) AS rn
  FROM offered),
firsts AS (SELECT * FROM ranked WHERE rn = 1)"""

ARRIVED = "arrived AS (SELECT topic, arrival AS ts FROM e WHERE fault <> 'no_topic')"

CONFIGS = """
people AS (SELECT DISTINCT user_number, uid FROM e),
sent AS (
  SELECT uid, user_number, 0 AS seq, '/config' AS tail FROM people WHERE user_number % 5 <> 0
  UNION ALL SELECT uid, user_number, 1, '/config' FROM people WHERE user_number % 5 = 2
  UNION ALL SELECT uid, user_number, 2, '/config' FROM people WHERE user_number % 11 = 3
  UNION ALL SELECT uid, user_number, 3, '/settings/config' FROM people
            WHERE user_number % 7 = 1)"""

DELIVERED = """
arrived AS (
  SELECT topic, arrival AS ts FROM e WHERE fault <> 'no_topic'
  UNION ALL SELECT 'users/' || uid || '/alerts/manage', ts FROM e
            WHERE event_type = 'error' AND event_id % 50 IN (7, 9, 11)
  UNION ALL SELECT 'users/' || uid || tail, CASE seq WHEN 0 THEN TIMESTAMP '2023-12-31'
            ELSE TIMESTAMP '2024-01-15' END FROM sent)"""

ACCESS = """
log AS (
  SELECT event_id, user_number,
         CASE WHEN event_id % 17 = 0 THEN 'backend_service' ELSE uid END AS username,
         CASE WHEN event_id % 19 <> 0 THEN event_type END AS clientid,
         CASE WHEN event_id % 5 = 0 THEN 'subscribe' ELSE 'publish' END AS action,
         'users/user_' || CASE WHEN event_id % 13 = 0 THEN user_number + 1 ELSE user_number END
         || CASE WHEN event_id % 5 = 0 THEN '/config' WHEN event_id % 17 = 0 THEN '/alerts'
                 ELSE '/devices/' || event_type || '/telemetry' END AS topic
  FROM e)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(p.strip() for p in parts)


def _stats(value: str) -> str:
    return f"""count(*) AS n, round(avg({value}), 6) AS mean,
  round(quantile_cont({value}, 0.5), 6) AS p50, round(quantile_cont({value}, 0.95), 6) AS p95,
  CAST(min({value}) AS BIGINT) AS lowest, CAST(max({value}) AS BIGINT) AS highest"""


def oracles() -> dict[str, str]:
    base, text = _with(EVENTS), _with(EVENTS, TEXT)
    ev = _with(EVENTS, RULES, EVALUATIONS)
    history = _with(EVENTS, RULES, EVALUATIONS, CHANGES)
    dynamic = _with(EVENTS, RULES, DYNAMIC, CHANGES)
    machine = _with(EVENTS, RULES, EVALUATIONS, COMMANDS, MACHINE, recursive=True)
    live = _with(EVENTS, RULES, LIVE, COMMANDS, MACHINE_ARRIVAL, recursive=True)
    ties = LIVE.replace("g.arrival >=", "date_trunc('minute', g.arrival) >=")
    ties = _with(EVENTS, RULES, ties, COMMANDS, MACHINE_TIES, recursive=True)
    copies, arrived = _with(EVENTS, COPIES), _with(EVENTS, ARRIVED)
    configs, access = _with(EVENTS, CONFIGS), _with(EVENTS, ACCESS)
    delivered = _with(EVENTS, CONFIGS, DELIVERED)
    minute = "date_trunc('minute', ts)"
    all_rows = "event_time, user_id, device_id, rule_id, alert_type, message, value, status"
    n_rules = "CASE user_number % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END"
    first_threshold = (
        "CASE user_number % 5 WHEN 0 THEN 80.0::DOUBLE WHEN 2 THEN 100.0 WHEN 3 THEN 40.0 "
        "WHEN 4 THEN 0.0 END"
    )
    changed = "user_number % 5 = 2 AND ts >= TIMESTAMP '2024-01-15'"
    return {
        "match_topic_filter": f"""{access} SELECT event_id,
            regexp_full_match(topic, 'users/[^/]*/devices/[^/]*/telemetry') AS telemetry,
            regexp_full_match(topic, 'users/[^/]*/config') AS config,
            regexp_full_match(topic, 'users/user_1(/.*)?') AS user_1 FROM log""",
        "bridge_wrap": f"""{base} SELECT event_id,
            CASE WHEN fault = 'truncated' THEN 'not_json' END AS error,
            CASE WHEN fault <> 'truncated' THEN topic END AS topic,
            CASE WHEN fault <> 'truncated' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS time,
            CASE WHEN fault <> 'truncated' THEN value END AS temperature FROM e""",
        "bridge_wrap_enriched_fields": f"""{base} SELECT event_id,
            CASE WHEN fault = 'truncated' THEN 'not_json' END AS error,
            CASE WHEN fault <> 'truncated' THEN topic END AS topic,
            CAST(CASE WHEN fault <> 'truncated' THEN k END AS DOUBLE) AS k,
            epoch_us(ts) // 1000 AS sent_ms, 32 AS trace_digits, 55 AS context_length FROM e""",
        "to_otlp_spans_fields": f"""{base} SELECT
            lpad(printf('%x', event_id), 32, '0') AS trace_id,
            lpad(printf('%x', event_id), 16, '0') AS span_id, 'mqtt_ingress' AS name,
            3::BIGINT AS kind, epoch_us(arrival) * 1000 AS start_ns,
            epoch_us(arrival) * 1000 + 1000000 AS end_ns, topic
            FROM e WHERE fault <> 'no_topic' AND event_id % 7 <> 0""",
        "decode_envelope": f"""{text} SELECT CAST(part AS INTEGER) AS partition, off AS "offset",
            'iot-stream' AS source_topic,
            CASE WHEN fault <> 'no_topic' THEN topic END AS topic,
            CASE WHEN fault <> 'no_topic' THEN payload END AS payload,
            CASE WHEN fault = 'no_topic' THEN 'not_an_envelope' END AS skip_reason
            FROM payloads""",
        "skipped_messages": f"""{base} SELECT 'not_an_envelope' AS reason, count(*) AS n
            FROM e WHERE fault = 'no_topic'""",
        "extract_traceparent": f"""{base} SELECT CAST(part AS INTEGER) AS partition,
            off AS "offset",
            CASE WHEN event_id % 7 <> 0 AND event_id > 0
                 THEN lpad(printf('%x', event_id), 32, '0') END AS trace_id,
            CASE WHEN event_id % 7 <> 0 AND event_id > 0
                 THEN lpad(printf('%x', event_id), 16, '0') END AS span_id,
            CASE WHEN event_id % 7 <> 0 AND event_id > 0 THEN '01' END AS flags FROM e""",
        "batch_links": f"""{base} SELECT event_id // 1000 AS batch_id,
            lpad(printf('%x', event_id), 32, '0') AS trace_id,
            lpad(printf('%x', event_id), 16, '0') AS span_id, '01' AS flags
            FROM good WHERE event_id % 7 <> 0 AND event_id > 0""",
        "batch_summary": f"""{base} SELECT event_id // 1000 AS batch_id, count(*) AS rows,
            count(*) FILTER (WHERE event_id % 7 <> 0 AND event_id > 0) AS links
            FROM good GROUP BY 1""",
        "find_message": f"""{base} SELECT uid AS user_id, event_type AS device_id,
            event_id AS sequence_id, value AS temperature
            FROM good WHERE event_type = 'click' AND event_id = 1""",
        "parse_telemetry": f"""{base} SELECT CAST(part AS INTEGER) AS partition, off AS "offset",
            uid AS user_id, CASE WHEN fault <> 'truncated' THEN ts END AS time,
            CASE fault WHEN 'truncated' THEN NULL WHEN 'no_device' THEN '' ELSE event_type END
              AS device_id,
            CAST(CASE WHEN fault NOT IN ('truncated', 'no_sequence') THEN event_id END AS DOUBLE)
              AS sequence_id,
            CASE WHEN fault NOT IN ('truncated', 'text_temperature') THEN value END AS temperature,
            CAST(CASE WHEN fault <> 'truncated' THEN k END AS DOUBLE) AS battery,
            CASE fault WHEN 'good' THEN NULL WHEN 'no_device' THEN 'Empty device_id'
                 ELSE 'Invalid JSON' END AS error
            FROM e WHERE fault <> 'no_topic'""",
        "collect_extras": f"""{base} SELECT event_id AS sequence_id,
            '{{"ingest_timestamp":' || (epoch_us(ts) // 1000) || ',"k":' || k || '}}' AS extra_data
            FROM good""",
        "valid_device": f"""{base} SELECT uid AS user_id, event_id AS sequence_id,
            'Empty device_id' AS error FROM e WHERE fault = 'no_device'""",
        "user_id_from_topic": f"""{access} SELECT event_id,
            CASE event_id % 4 WHEN 2 THEN 'unknown' ELSE split_part(topic, '/', 2) END AS user_id,
            CASE event_id % 4 WHEN 2 THEN NULL ELSE split_part(topic, '/', 2) END AS rule_user
            FROM log""",
        "rule_value": f"""{base} SELECT event_id AS sequence_id, value AS value_temperature,
            CAST(k AS DOUBLE) AS value_battery, CAST(k AS DOUBLE) AS value_k,
            NULL::DOUBLE AS value_device_id FROM good""",
        "split_accept_reject": f"""{base} SELECT
            CASE WHEN fault = 'good' THEN 'accepted' ELSE 'rejected' END AS side,
            CAST(part AS INTEGER) AS partition, off AS "offset" FROM e WHERE fault <> 'no_topic'""",
        "range_validate": f"""{base} SELECT CASE
              WHEN fault = 'no_device' THEN 'Empty device_id'
              WHEN fault <> 'good' THEN 'Invalid JSON'
              WHEN value < -50 OR value > 150 THEN 'Out of range'
              WHEN k < 10 OR k > 90 THEN 'Out of range' ELSE 'ok' END AS reason, count(*) AS n
            FROM e WHERE fault <> 'no_topic' GROUP BY 1""",
        "custom_predicates": """WITH o AS (
              SELECT 'p' || o_orderkey AS package_id, CAST(o_orderdate AS TIMESTAMP) AS time,
                     o_orderstatus, o_totalprice, c_acctbal
              FROM orders JOIN customer ON c_custkey = o_custkey)
            SELECT package_id, time, 'DeliveryDelay' AS alert_type,
                   'Package ' || package_id || ' is delayed' AS message, NULL::DOUBLE AS value
            FROM o WHERE o_orderstatus = 'F'
            UNION ALL
            SELECT package_id, time, 'PriceCrash', package_id || ' dropped', o_totalprice
            FROM o WHERE o_totalprice < c_acctbal * 10""",
        "to_dlq": f"""{text} SELECT topic AS key, topic AS original_topic,
            base64(encode(payload)) AS payload_base64,
            CASE fault WHEN 'no_device' THEN 'Empty device_id' ELSE 'Invalid JSON' END AS error
            FROM payloads WHERE fault NOT IN ('good', 'no_topic')""",
        "replay_dlq": f"""{text} SELECT topic, payload,
            CASE fault WHEN 'no_device' THEN 'Empty device_id' ELSE 'Invalid JSON' END AS error
            FROM payloads WHERE fault NOT IN ('good', 'no_topic')""",
        "errors_by_type": f"{base} SELECT reason, count(*) AS n FROM bad GROUP BY 1",
        "message_counts": f"""{base} SELECT 'received' AS measure, count(*) AS n FROM e
            UNION ALL SELECT 'skipped', count(*) FROM e WHERE fault = 'no_topic'
            UNION ALL SELECT 'decoded', count(*) FROM e WHERE fault <> 'no_topic'
            UNION ALL SELECT 'accepted', count(*) FROM good
            UNION ALL SELECT 'rejected', count(*) FROM bad""",
        "route_control": f"""{configs} SELECT 'config' AS route, count(*) AS n FROM sent
            UNION ALL SELECT 'manage', count(*) FROM e
            WHERE event_type = 'error' AND event_id % 50 IN (7, 9, 11)""",
        "parse_config_update": f"""{configs} SELECT 'users/' || uid || tail AS topic,
            CAST(seq AS BIGINT) AS sequence_id, CASE WHEN seq < 3 THEN uid END AS user_id,
            CAST(CASE WHEN seq = 2 THEN NULL WHEN seq = 3 THEN 0 WHEN seq = 1 THEN 1
                 WHEN user_number % 5 = 1 THEN 0 ELSE 2 END AS DOUBLE) AS n_rules,
            CASE WHEN seq IN (2, 3) OR (seq = 0 AND user_number % 5 = 1) THEN NULL
                 ELSE 'temperature' END AS first_key,
            CASE WHEN seq = 1 THEN 50.0::DOUBLE WHEN seq > 1 THEN NULL
                 ELSE {first_threshold} END AS first_threshold,
            CASE seq WHEN 2 THEN 'bad_config' WHEN 3 THEN 'not_a_config_topic' END AS error
            FROM sent""",
        "parse_command": f"""{base} SELECT event_id AS sequence_id, uid AS user_id,
            event_type AS device_id, 'temperature' AS rule_id,
            CASE event_id % 50 WHEN 7 THEN 'SNOOZE' WHEN 9 THEN 'DISABLE' ELSE 'snooze' END
              AS action,
            CASE WHEN k % 2 = 1 THEN k ELSE 30 END AS duration_minutes,
            CASE WHEN event_id % 50 = 11 THEN 'unknown_action' END AS error
            FROM e WHERE event_type = 'error' AND event_id % 50 IN (7, 9, 11)""",
        "load_rules": f"""{configs} SELECT uid AS user_id,
            CAST(seq AS BIGINT) AS sequence_id,
            CAST(CASE WHEN seq = 1 THEN 1 WHEN seq > 1 THEN 0
                 WHEN user_number % 5 = 1 THEN 0 ELSE 2 END AS BIGINT) AS n_rules FROM sent""",
        "upsert_config": f"""{configs} SELECT uid AS user_id,
            CAST(CASE user_number % 5 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS BIGINT) AS n_rules,
            CASE user_number % 5 WHEN 2 THEN 50.0::DOUBLE WHEN 3 THEN 40.0 WHEN 4 THEN 0.0 END
              AS first_threshold
            FROM people WHERE user_number % 5 <> 0""",
        "rules_for_user": f"""{base} SELECT event_id AS sequence_id, uid AS user_id,
            CAST({n_rules} AS BIGINT) AS n_rules, {first_threshold} AS first_threshold
            FROM good""",
        "rules_as_of": f"""{base} SELECT event_id AS sequence_id, uid AS user_id,
            CAST(CASE WHEN {changed} THEN 1 ELSE {n_rules} END AS BIGINT) AS n_rules,
            CASE WHEN {changed} THEN 50.0 ELSE {first_threshold} END AS first_threshold
            FROM good""",
        "explode_rules": f"""{_with(EVENTS, RULES)} SELECT event_id AS sequence_id,
            CAST(pos AS BIGINT) AS pos, rule_key, operator, threshold
            FROM good JOIN r ON r.cls = user_number % 5""",
        "eval_rule": f"""{ev} SELECT user_id, device_id, rule_id, pos, time, sequence_id, value,
            message, triggered FROM ev""",
        "alert_transitions": f"{history} SELECT {all_rows} FROM history",
        "alert_transitions_dynamic_rules": f"{dynamic} SELECT {all_rows} FROM history",
        "active_alerts_asof": f"{ev}, ev_used AS (SELECT * FROM ev) {ACTIVE}",
        "active_alerts_midway": f"""{ev}, ev_used AS (
            SELECT * FROM ev WHERE time <= TIMESTAMP '2024-01-15') {ACTIVE}""",
        "make_alert": f"""{ev} SELECT time AS event_time, user_id, device_id, rule_id,
            'Rule:' || rule_id AS alert_type,
            CASE WHEN triggered THEN message ELSE 'Alert Resolved' END AS message,
            CASE WHEN triggered THEN value END AS value,
            CASE WHEN triggered THEN 'Triggered' ELSE 'Resolved' END AS status FROM ev""",
        "publish_alerts": f"""{history} SELECT 'users/' || user_id || '/alerts' AS topic,
            device_id, alert_type, status, value FROM history""",
        "alert_history_with_commands": f"{machine} {HISTORY_OF_STEPS}",
        "active_alerts_with_commands": f"{machine} {STATE_OF_STEPS}",
        "alert_stream": f"{live} {HISTORY_OF_STEPS}",
        "alert_stream_ties": f"{ties} {HISTORY_OF_STEPS}",
        "alert_transitions_hot_key": """
            WITH e AS (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE 'user_' || (l_suppkey % 7) END AS user_id,
                CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE CAST(l_partkey % 50 AS VARCHAR) END AS device_id,
                l_quantity > 25 AS high FROM lineitem),
            p AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY user_id, device_id
                ORDER BY l_shipdate, l_orderkey * 8 + l_linenumber, l_quantity), false) AS was FROM e)
            SELECT CAST(l_shipdate AS TIMESTAMP) AS event_time, user_id, device_id, 'temperature' AS rule_id,
                'Rule:temperature' AS alert_type,
                CASE WHEN high THEN 'Large quantity' ELSE 'Alert Resolved' END AS message,
                CASE WHEN high THEN CAST(l_quantity AS DOUBLE) END AS value,
                CASE WHEN high THEN 'Triggered' ELSE 'Resolved' END AS status
            FROM p WHERE high <> was""",
        "rules_as_of_hot_user": """
            WITH r AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE 'user_' || (l_suppkey % 7) END AS u,
                    CAST(l_shipdate AS TIMESTAMP) AS t, 1 AS kind, l_orderkey * 8 + l_linenumber AS seq,
                    CAST(NULL AS DOUBLE) AS threshold FROM lineitem
                UNION ALL SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'hot' ELSE 'user_' || (o_custkey % 7) END,
                    CAST(o_orderdate AS TIMESTAMP), 0, o_orderkey, CAST(o_totalprice AS DOUBLE)
                    FROM orders WHERE o_custkey % 7 <> 5),
            f AS (SELECT *, last_value(threshold IGNORE NULLS) OVER (PARTITION BY u ORDER BY t, kind, seq
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM r)
            SELECT seq AS sequence_id, u AS user_id, coalesce(held, 80.0) AS threshold FROM f WHERE kind = 1""",
        "alert_stream_keyed": f"{ties} {HISTORY_OF_STEPS}",
        "alert_stream_keyed_new_checkpoint": f"{live} {HISTORY_OF_STEPS}",
        "alert_stream_keyed_state": f"{live} {STATE_OF_STEPS}",
        "alert_stream_new_checkpoint": f"{live} {HISTORY_OF_STEPS}",
        "alert_stream_new_checkpoint_state": f"{live} {STATE_OF_STEPS}",
        "hostile_messages": f"{_with(EVENTS, HOSTILE, MACHINE_HOSTILE, recursive=True)} {HISTORY_OF_STEPS}",
        "hostile_stream": f"{_with(EVENTS, HOSTILE, MACHINE_HOSTILE_LIVE, recursive=True)} {HISTORY_OF_STEPS}",
        "hostile_errors": f"""{base} SELECT 'users/' || uid || '/telemetry' AS key, count(*) AS n
            FROM e WHERE event_id % 5 = 0 GROUP BY 1""",
        "decode_envelope_doubled": f"""{base} SELECT CAST(part AS INTEGER) AS partition, off AS "offset",
            CASE WHEN fault <> 'no_topic' AND off % 3 <> 0 THEN topic END AS topic,
            CASE WHEN fault = 'no_topic' OR off % 3 = 0 THEN 'not_an_envelope' END AS skip_reason
            FROM e""",
        "alerts_per_minute_stream": f"""{live}, h AS ({HISTORY_OF_STEPS})
            SELECT date_trunc('minute', event_time) AS window_start, count(*) AS alerts
            FROM h WHERE status = 'Triggered' GROUP BY 1""",
        "errors_per_minute_stream": f"""{base} SELECT date_trunc('minute', arrival) AS window_start,
            reason, count(*) AS errors FROM bad GROUP BY ALL""",
        "write_stats_stream": f"""{base} SELECT
            count(*) + count(*) FILTER (WHERE off % 10 = 0) AS offered, count(*) AS written,
            count(*) FILTER (WHERE off % 10 = 0) AS duplicates FROM good""",
        "alert_stream_state": f"{live} {STATE_OF_STEPS}",
        "stream_ingest": f"""{base} SELECT ts AS time, uid AS user_id, event_type AS device_id,
            event_id AS sequence_id, value AS temperature,
            '{{"ingest_timestamp":' || (epoch_us(ts) // 1000) || ',"k":' || k || '}}' AS extra_data
            FROM good""",
        "stream_ingest_compacted": f"""{base} SELECT ts AS time, uid AS user_id, event_type AS device_id,
            event_id AS sequence_id, value AS temperature,
            '{{"ingest_timestamp":' || (epoch_us(ts) // 1000) || ',"k":' || k || '}}' AS extra_data
            FROM good""",
        "stream_ingest_deliveries": """SELECT CAST(o_orderdate AS TIMESTAMP) AS time, 'p' || o_orderkey AS package_id,
            o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS price,
            strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
            WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0""",
        "stream_replay": f"""{base} SELECT ts AS time, uid AS user_id, event_type AS device_id,
            event_id AS sequence_id, value AS temperature FROM e WHERE fault IN ('good', 'text_temperature')""",
        "stream_dead_letters": f"{base} SELECT topic AS key, reason AS error FROM bad",
        "message_rate_stream": f"""{delivered}
            SELECT {minute} AS window_start, count(*) AS messages, count(*) / 60 AS per_second
            FROM arrived GROUP BY 1""",
        "active_topics_stream": f"""{delivered}
            SELECT date_trunc('hour', ts) AS window_start, count(DISTINCT topic) AS active
            FROM arrived GROUP BY 1
            HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR
              <= (SELECT max(ts) FROM arrived) - INTERVAL 10 MINUTE""",
        "idle_topics_stream": f"""{delivered}, closed AS (SELECT DISTINCT {minute} AS m, topic FROM arrived
              WHERE {minute} + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM arrived) - INTERVAL 10 MINUTE),
            firsts AS (SELECT topic, min(m) AS m FROM closed GROUP BY 1),
            spine AS (SELECT unnest(generate_series((SELECT min(m) FROM closed),
                        (SELECT max(m) FROM closed), INTERVAL 1 MINUTE)) AS m),
            act AS (SELECT m, count(*) AS n FROM closed GROUP BY 1),
            news AS (SELECT m, count(*) AS n FROM firsts GROUP BY 1),
            filled AS (SELECT s.m, CAST(sum(coalesce(n.n, 0)) OVER (ORDER BY s.m) AS BIGINT)
                         AS known, coalesce(a.n, 0) AS active
              FROM spine s LEFT JOIN act a ON a.m = s.m LEFT JOIN news n ON n.m = s.m)
            SELECT m AS window_start, known, active, known - active AS idle FROM filled""",
        "consumer_lag_stream": f"""{base}, parts AS (SELECT part, max(off) AS newest,
              max(off) FILTER (WHERE arrival < TIMESTAMP '2024-01-15') AS committed FROM e GROUP BY 1)
            SELECT 'iot-stream' AS topic, CAST(part AS INTEGER) AS partition, newest, committed,
              newest - coalesce(committed, -1) AS lag FROM parts""",
        "late_messages_stream": f"""{delivered} SELECT date_trunc('minute', arrival) AS window_start, count(*) AS late
            FROM e WHERE fault <> 'no_topic' AND off % 10 = 0 AND arrival < TIMESTAMP '2024-01-15' GROUP BY 1""",
        "stream_ingest_bounded": f"""{base} SELECT ts AS time, uid AS user_id, event_type AS device_id,
            event_id AS sequence_id, value AS temperature
            FROM good, range(2) copy(n) WHERE n = 0 OR (off % 15 = 0
              AND arrival < TIMESTAMP '2024-01-15' - INTERVAL 1 HOUR)""",
        "top_topics_stream": f"""{delivered}, counted AS (
              SELECT date_trunc('day', ts) AS window_start, topic, count(*) AS messages
              FROM arrived GROUP BY ALL),
            ranked AS (SELECT window_start, row_number() OVER (PARTITION BY window_start
                ORDER BY messages DESC, topic) AS rank, topic, messages FROM counted)
            SELECT * FROM ranked WHERE rank <= 5 AND window_start + INTERVAL 1 DAY
              <= (SELECT max(ts) FROM arrived) - INTERVAL 10 MINUTE""",
        "alerts_by_rule_user": f"""{history} SELECT rule_id, user_id, count(*) AS alerts
            FROM history WHERE status = 'Triggered' GROUP BY ALL""",
        "alerts_per_minute": f"""{history} SELECT date_trunc('minute', event_time) AS window_start,
            count(*) AS alerts FROM history WHERE status = 'Triggered' GROUP BY ALL""",
        "dedupe_first_wins": f"""{copies} SELECT ts AS time, uid AS user_id,
            event_type AS device_id, event_id AS sequence_id, value AS temperature,
            CAST(k AS INTEGER) AS battery FROM firsts""",
        "anti_join_existing": f"""{copies} SELECT ts AS time, uid AS user_id,
            event_type AS device_id, event_id AS sequence_id, value AS temperature,
            CAST(k AS INTEGER) AS battery FROM firsts f
            WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.ts < TIMESTAMP '2024-01-15'
              AND g.ts = f.ts AND g.uid = f.uid AND g.event_type = f.event_type
              AND g.event_id = f.event_id)""",
        "write_stats": f"""{copies} SELECT event_id % 7 AS batch_id, count(*) AS offered,
            count(*) FILTER (WHERE rn = 1 AND ts >= TIMESTAMP '2024-01-15') AS written,
            count(*) - count(*) FILTER (WHERE rn = 1 AND ts >= TIMESTAMP '2024-01-15')
              AS duplicates
            FROM ranked GROUP BY 1""",
        "quarantine_split": f"""{base} SELECT reason, count(*) AS n FROM bad GROUP BY 1
            UNION ALL SELECT 'stored', count(*) FROM good""",
        "messages_by_topic": f"""{base} SELECT topic, count(*) AS messages FROM e
            WHERE fault <> 'no_topic' GROUP BY 1""",
        "payload_size_stats": f"""{text} SELECT topic, {_stats("octet_length(encode(payload))")}
            FROM payloads WHERE fault <> 'no_topic' GROUP BY 1""",
        "ingress_latency": f"""{base} SELECT CASE WHEN event_id % 3 <> 0 THEN event_type END AS device_id,
            {_stats("epoch_us(arrival) // 1000 - epoch_us(ts) // 1000")} FROM good GROUP BY 1""",
        "message_rate": f"""{arrived} SELECT {minute} AS window_start, count(*) AS messages,
            count(*) / 60 AS per_second FROM arrived GROUP BY 1""",
        "message_rate_sliding": f"""{arrived}, slid AS (
              SELECT time_bucket(INTERVAL 5 SECOND, ts) - to_seconds(5 * s.i) AS window_start
              FROM arrived, range(12) s(i))
            SELECT window_start, count(*) AS messages, count(*) / 60 AS per_second
            FROM slid GROUP BY 1""",
        "active_topics": f"""{arrived} SELECT date_trunc('hour', ts) AS window_start,
            count(DISTINCT topic) AS active FROM arrived GROUP BY 1""",
        "idle_topics": f"""{arrived}, seen AS (SELECT DISTINCT {minute} AS m, topic FROM arrived),
            firsts AS (SELECT topic, min(m) AS m FROM seen GROUP BY 1),
            spine AS (SELECT unnest(generate_series((SELECT min(m) FROM seen),
                        (SELECT max(m) FROM seen), INTERVAL 1 MINUTE)) AS m),
            act AS (SELECT m, count(*) AS n FROM seen GROUP BY 1),
            news AS (SELECT m, count(*) AS n FROM firsts GROUP BY 1),
            filled AS (SELECT s.m, CAST(sum(coalesce(n.n, 0)) OVER (ORDER BY s.m) AS BIGINT)
                         AS known, coalesce(a.n, 0) AS active
              FROM spine s LEFT JOIN act a ON a.m = s.m LEFT JOIN news n ON n.m = s.m)
            SELECT m AS window_start, known, active, known - active AS idle FROM filled""",
        "avg_topic_rate": f"""{arrived} SELECT date_trunc('hour', ts) AS window_start,
            count(*) / 3600 / count(DISTINCT topic) AS per_second_and_topic
            FROM arrived GROUP BY 1""",
        "top_topics": f"""{arrived}, counted AS (
              SELECT date_trunc('day', ts) AS window_start, topic, count(*) AS messages
              FROM arrived GROUP BY ALL),
            ranked AS (SELECT window_start, row_number() OVER (PARTITION BY window_start
                ORDER BY messages DESC, topic) AS rank, topic, messages FROM counted)
            SELECT * FROM ranked WHERE rank <= 5""",
        "top_topics_overall": f"""{arrived} SELECT topic, count(*) AS messages FROM arrived
            GROUP BY 1 ORDER BY messages DESC, topic LIMIT 5""",
        "errors_per_minute": f"""{base} SELECT date_trunc('minute', arrival) AS window_start,
            reason, count(*) AS errors FROM bad GROUP BY ALL""",
        "write_rate": f"""{copies} SELECT date_trunc('hour', ts) AS window_start,
            count(*) AS messages, count(*) / 3600 AS per_second FROM firsts GROUP BY 1""",
        "consumer_lag": f"""{base}, parts AS (SELECT part, max(off) AS newest FROM e GROUP BY 1)
            SELECT 'iot-stream' AS topic, part AS partition, newest,
              CAST(CASE WHEN part <> 3 THEN newest - part * 10 END AS DOUBLE) AS committed,
              CASE WHEN part <> 3 THEN part * 10 ELSE newest + 1 END AS lag FROM parts""",
        "threshold_band": f"""{base}, parts AS (SELECT part, max(off) AS newest FROM e GROUP BY 1),
            total AS (SELECT CAST(sum(CASE WHEN part <> 3 THEN part * 10 ELSE newest + 1 END)
              AS BIGINT) AS lag FROM parts)
            SELECT 'iot-stream' AS topic, lag, CASE WHEN lag >= 1000 THEN 'red'
              WHEN lag >= 100 THEN 'orange' ELSE 'green' END AS band FROM total""",
        "counter_rate": f"""{base}, s AS (SELECT event_type AS series, ts,
              CAST((event_id % 1000) * 3 + k AS DOUBLE) AS value FROM e),
            p AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts, value) AS prev
              FROM s),
            g AS (SELECT series, date_trunc('hour', ts) AS window_start,
              sum(CASE WHEN value < prev THEN value ELSE value - prev END) AS increase
              FROM p WHERE prev IS NOT NULL GROUP BY ALL)
            SELECT *, increase / 3600 AS per_second FROM g""",
        "gauge_last": f"""{base} SELECT event_type AS series, max(ts) AS ts,
            arg_max(CAST((event_id % 1000) * 3 + k AS DOUBLE), ts) AS value FROM e GROUP BY 1""",
        "status_map": f"""{access}, g AS (SELECT username AS service, max(event_id) AS n
              FROM log GROUP BY 1)
            SELECT service, make_timestamp(n * 1000000) AS ts, CAST(n % 3 AS DOUBLE) AS value,
              CASE n % 3 WHEN 1 THEN 'UP' WHEN 0 THEN 'DOWN' END AS status FROM g""",
        "acl_audit": f"""{access} SELECT event_id, username, action, topic,
              CASE WHEN action = 'publish' AND starts_with(topic, 'users/user_3/') THEN false
                   WHEN action = 'publish' AND coalesce(topic = 'users/' || username || '/devices/'
                        || clientid || '/telemetry', false) THEN true
                   WHEN action = 'subscribe' AND topic = 'users/' || username || '/config' THEN true
                   WHEN regexp_full_match(topic, 'users/[^/]*/alerts')
                     THEN username = 'backend_service' AND action = 'publish'
                   ELSE username <> 'backend_service' AND user_number % 3 = 0
                        AND starts_with(topic, 'users/user_' || (user_number + 1) || '/')
              END AS allowed
            FROM log""",
    }
