"""DuckDB SQL for the catalog's queries.

The ordered parts (windows, parent states) are stepped row by row with
recursive CTEs, so they check the set-based Spark plans from another side.
"""

from __future__ import annotations

from tocsin.sources.events import ALERT_EVENTS_SQL
from tocsin.sources.sample_config import MANAGERS_SQL, RULES_SQL

AT = "2024-01-15 00:00:00"

_REASON = """CASE WHEN event_manager_id = '' THEN 'empty_event_manager_id'
  WHEN summary = '' THEN 'empty_summary'
  WHEN severity NOT IN ('high', 'medium', 'low') THEN 'invalid_severity'
  WHEN action NOT IN ('trigger', 'resolve') THEN 'invalid_action'
  WHEN dedup_key = '' THEN 'empty_dedup_key'
  WHEN manager_id IS NULL THEN 'event_manager_not_found'
  WHEN rule_id IS NULL THEN 'grouping_rule_not_found' END"""

_VALUE = """CASE grouping_key WHEN 'class' THEN class WHEN 'severity' THEN severity
  WHEN 'event_manager_id' THEN event_manager_id ELSE '' END"""

_CODE = """CASE WHEN {r} = 'malformed' THEN 'BAD_REQUEST'
  WHEN {r} IN ('event_manager_not_found', 'grouping_rule_not_found') THEN 'INTERNAL_ERROR'
  ELSE 'VALIDATION_FAILED' END"""

_MESSAGE = """CASE {r} WHEN 'empty_event_manager_id' THEN 'event_manager_id is required'
  WHEN 'empty_summary' THEN 'summary is required'
  WHEN 'invalid_severity' THEN 'severity must be ''high'', ''medium'', or ''low'''
  WHEN 'invalid_action' THEN 'action must be ''trigger'' or ''resolve'''
  WHEN 'empty_dedup_key' THEN 'dedupKey is required'
  WHEN 'event_manager_not_found' THEN 'event manager not found'
  WHEN 'grouping_rule_not_found' THEN 'grouping rule not found'
  WHEN 'empty_name' THEN 'name is required'
  WHEN 'empty_grouping_key' THEN 'grouping_key is required'
  WHEN 'invalid_time_window' THEN 'time_window_minutes must be positive'
  WHEN 'empty_grouping_rule_id' THEN 'grouping_rule_id is required'
  WHEN 'already_exists' THEN 'already exists' WHEN 'not_found' THEN 'not found' END"""

_EVENTS = f"""ev AS ({ALERT_EVENTS_SQL.format(events="events")}),
rules AS ({RULES_SQL.format(ntz="")}),
managers AS ({MANAGERS_SQL.format(ntz="")}),
joined AS (
  SELECT e.*, m.id AS manager_id, r.id AS rule_id, r.grouping_key, r.time_window_minutes
  FROM ev e LEFT JOIN managers m ON e.event_manager_id = m.id
            LEFT JOIN rules r ON m.grouping_rule_id = r.id)"""

# the sample's JSON bodies by the number k in `props`: those the decoder refuses, and those without a class
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_BROKEN = "(7, 11, 14, 15, 17, 20)"
_RAW_EVENTS = _EVENTS.replace(
    "ev AS (",
    f"""ev AS (SELECT e.* REPLACE (CASE WHEN x.k IN (13, 19) THEN '' ELSE e.class END AS class)
FROM (SELECT event_id, {_K} AS k FROM events) x JOIN (""",
    1,
).replace("),\nrules AS", f") e ON e.seq = x.event_id WHERE x.k NOT IN {_BROKEN}),\nrules AS", 1)

_ROUTED = f""",
checked AS (SELECT *, {_REASON} AS reject_reason FROM joined),
routed AS (
  SELECT seq, received_at, event_manager_id, summary, severity, action, class, dedup_key,
    grouping_key, {_VALUE} AS grouping_value, time_window_minutes,
    substring(sha256(event_manager_id || ':' || {_VALUE}), 1, 16) AS partition_key
  FROM checked WHERE reject_reason IS NULL {{until}})"""

# every seventh event comes with the slice after its own; the watermark is two days behind what came before
_ARRIVED = """,
span AS (SELECT min(epoch_us(received_at)) AS first, max(epoch_us(received_at)) AS last FROM routed),
arrived AS (
  SELECT seq, dedup_key, received_at, epoch_us(received_at) AS us, least(4,
      (epoch_us(received_at) - first) * 5 // (last - first + 1) + (CASE WHEN seq % 7 = 3 THEN 1 ELSE 0 END)) AS arrival
  FROM routed, span),
seen AS (SELECT arrival, max(us) AS newest FROM arrived GROUP BY arrival),
passed AS (
  SELECT a.arrival, max(b.newest) // 1000 - 2 * 86400000 AS watermark
  FROM seen a JOIN seen b ON b.arrival < a.arrival GROUP BY a.arrival)"""

_BIRTHS = """,
births AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY received_at, seq) AS rn
    FROM routed WHERE action = 'trigger') b WHERE rn = 1)"""

_LINKS = """,
numbered AS (
  SELECT *, received_at + time_window_minutes * INTERVAL 1 MINUTE AS expires_at,
    row_number() OVER (PARTITION BY event_manager_id, grouping_key, grouping_value
                       ORDER BY received_at, seq) AS n
  FROM births),
walk AS (
  SELECT event_manager_id, grouping_key, grouping_value, n, dedup_key,
    dedup_key AS family, expires_at AS until FROM numbered WHERE n = 1
  UNION ALL
  SELECT b.event_manager_id, b.grouping_key, b.grouping_value, b.n, b.dedup_key,
    CASE WHEN b.received_at > w.until THEN b.dedup_key ELSE w.family END,
    CASE WHEN b.received_at > w.until THEN b.expires_at ELSE w.until END
  FROM walk w JOIN numbered b ON b.event_manager_id = w.event_manager_id
    AND b.grouping_key = w.grouping_key AND b.grouping_value = w.grouping_value AND b.n = w.n + 1),
links AS (
  SELECT b.*, w.family, b.received_at AS born_at, b.seq AS born_seq
  FROM numbered b JOIN walk w ON b.dedup_key = w.dedup_key)"""

_HISTORY = """,
known AS (
  SELECT r.dedup_key, r.received_at, r.seq, r.action, l.family,
    r.seq = l.born_seq AND r.received_at = l.born_at AS is_birth, r.dedup_key = l.family AS is_parent
  FROM routed r JOIN links l ON r.dedup_key = l.dedup_key
  WHERE r.received_at > l.born_at OR (r.received_at = l.born_at AND r.seq >= l.born_seq)),
history AS (
  SELECT *, lag(action) OVER (PARTITION BY dedup_key ORDER BY received_at, seq) AS prev_action
  FROM known),
stepped AS (
  SELECT *, CASE WHEN is_parent OR (NOT is_birth AND prev_action = action) THEN 0
    WHEN action = 'trigger' THEN 1 ELSE -1 END AS step
  FROM history),
counted AS (
  SELECT *,
    sum(step) OVER f AS active_children,
    sum(CASE WHEN is_birth AND NOT is_parent THEN 1 ELSE 0 END) OVER f AS children,
    row_number() OVER f AS i
  FROM stepped WINDOW f AS (PARTITION BY family ORDER BY received_at, seq
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

_MACHINE = """,
machine AS (
  SELECT family, i, 'active' AS state, 'born' AS effect, received_at AS updated_at,
    CAST(NULL AS TIMESTAMP) AS resolved_at, CAST(NULL AS TIMESTAMP) AS requested_at,
    CAST(NULL AS BIGINT) AS remaining
  FROM counted WHERE i = 1
  UNION ALL
  SELECT family, i, next_state, effect,
    CASE WHEN effect IN ('child', 'deferred', 'resolved', 'cascaded', 'reactivated')
      THEN received_at ELSE updated_at END,
    CASE WHEN effect IN ('resolved', 'cascaded') THEN received_at
         WHEN effect = 'reactivated' THEN NULL ELSE resolved_at END,
    CASE WHEN effect = 'deferred' THEN received_at
         WHEN next_state = 'pending' THEN requested_at END,
    CASE WHEN effect = 'deferred' OR (next_state = 'pending' AND step = -1) THEN active_children
         WHEN next_state = 'pending' THEN remaining END
  FROM (
    SELECT *, CASE effect WHEN 'deferred' THEN 'pending' WHEN 'resolved' THEN 'resolved'
      WHEN 'cascaded' THEN 'resolved' WHEN 'reactivated' THEN 'active' ELSE state END AS next_state
    FROM (
      SELECT c.family, c.i, c.received_at, c.step, CAST(c.active_children AS BIGINT) AS active_children,
        m.state, m.updated_at, m.resolved_at, m.requested_at, m.remaining,
        CASE WHEN c.is_parent AND c.action = 'trigger' AND m.state = 'resolved' THEN 'reactivated'
          WHEN c.is_parent AND c.action = 'trigger' THEN 'none'
          WHEN c.is_parent AND m.state = 'resolved' THEN 'resolve_noop'
          WHEN c.is_parent AND c.active_children > 0 THEN 'deferred'
          WHEN c.is_parent THEN 'resolved'
          WHEN c.step = -1 AND c.active_children = 0 AND m.state = 'pending' THEN 'cascaded'
          WHEN c.is_birth THEN 'child' ELSE 'none' END AS effect
      FROM machine m JOIN counted c ON c.family = m.family AND c.i = m.i + 1) t) t2),
effects AS (
  SELECT c.*, m.effect, m.state FROM counted c JOIN machine m ON c.family = m.family AND c.i = m.i),
parent_end AS (
  SELECT m.* FROM machine m JOIN (SELECT family, max(i) AS i FROM machine GROUP BY family) l
    ON m.family = l.family AND m.i = l.i),
child_end AS (
  SELECT * FROM (SELECT family, dedup_key, action, received_at,
      row_number() OVER (PARTITION BY dedup_key ORDER BY received_at DESC, seq DESC) AS rn
    FROM counted WHERE step <> 0) t WHERE rn = 1),
alerts AS (
  SELECT md5(l.dedup_key) AS id, l.dedup_key, l.event_manager_id, l.summary, l.severity, l.class,
    CASE WHEN l.dedup_key = l.family THEN 'parent' ELSE 'child' END AS type,
    CASE WHEN p.family IS NOT NULL THEN (CASE p.state WHEN 'resolved' THEN 'resolved' ELSE 'active' END)
         WHEN c.action = 'trigger' THEN 'active' ELSE 'resolved' END AS status,
    CASE WHEN l.dedup_key <> l.family THEN l.family END AS parent_dedup_key,
    CAST(coalesce(k.n, 0) AS INTEGER) AS child_count,
    coalesce(p.state = 'pending', FALSE) AS resolve_requested,
    l.born_at AS created_at,
    coalesce(p.updated_at, c.received_at) AS updated_at,
    CASE WHEN p.family IS NOT NULL THEN p.resolved_at
         WHEN c.action = 'resolve' THEN c.received_at END AS resolved_at
  FROM links l LEFT JOIN parent_end p ON p.family = l.dedup_key
    LEFT JOIN child_end c ON c.dedup_key = l.dedup_key
    LEFT JOIN (SELECT family, count(*) AS n FROM links WHERE dedup_key <> family GROUP BY family) k
      ON k.family = l.dedup_key)"""

_VERSIONS = """,
changes AS (
  SELECT dedup_key, received_at, seq, 'child' AS type, family AS parent_dedup_key, FALSE AS resolve_requested,
    CASE action WHEN 'trigger' THEN 'active' ELSE 'resolved' END AS status
  FROM effects WHERE step <> 0
  UNION ALL
  SELECT family, received_at, seq, 'parent', NULL, state = 'pending',
    CASE state WHEN 'resolved' THEN 'resolved' ELSE 'active' END
  FROM effects WHERE effect IN ('born', 'deferred', 'resolved', 'cascaded', 'reactivated')),
versions AS (
  SELECT c.dedup_key, l.event_manager_id, c.type, c.status, c.parent_dedup_key, c.resolve_requested, c.seq,
    c.received_at AS valid_from,
    lead(c.received_at) OVER (PARTITION BY c.dedup_key ORDER BY c.received_at, c.seq) AS valid_to
  FROM changes c JOIN links l ON l.dedup_key = c.dedup_key)"""

_ASKED = """,
asked AS (
  SELECT DISTINCT dedup_key AS requested FROM ev
  UNION SELECT 'u' || CAST(c_custkey AS VARCHAR) || ':0' FROM customer)"""

_ALERT_COLUMNS = """id, dedup_key, event_manager_id, summary, severity, class, type, status,
  parent_dedup_key, child_count, resolve_requested, created_at, updated_at, resolved_at"""

# change feeds made from the whole events table; run unchanged in Spark and DuckDB
RULE_CHANGES_SQL = """
SELECT event_id AS seq, ts AS changed_at,
  CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'error' THEN 'delete'
       ELSE 'update' END AS op,
  'rule-' || CAST(user_id % 5 AS VARCHAR(10)) AS id,
  CASE WHEN k = 96 THEN '' ELSE 'rule ' || CAST(event_id AS VARCHAR(20)) END AS name,
  CASE WHEN k = 97 THEN '' WHEN k % 4 = 0 THEN 'class' WHEN k % 4 = 1 THEN 'severity'
       WHEN k % 4 = 2 THEN 'event_manager_id' ELSE 'region' END AS grouping_key,
  k * 15 - 15 AS time_window_minutes
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e
"""
MANAGER_CHANGES_SQL = """
SELECT event_id AS seq, ts AS changed_at,
  CASE WHEN event_type = 'purchase' THEN 'create' WHEN event_type = 'error' THEN 'delete'
       ELSE 'update' END AS op,
  'em-' || CAST(user_id % 8 AS VARCHAR(10)) AS id,
  CASE WHEN k = 95 THEN '' ELSE 'team ' || CAST(event_id AS VARCHAR(20)) END AS name,
  event_type AS description,
  CASE WHEN k = 94 THEN '' ELSE 'rule-' || CAST(k % 6 AS VARCHAR(10)) END AS grouping_rule_id,
  'https://hooks.example/' || CAST(k AS VARCHAR(10)) AS webhook_url
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e
"""


def _feed(name: str, sql: str, invalid: str, fields: str) -> str:
    """CTEs {name}_rejects, {name}_history, {name}_current of a change feed."""
    return f"""
{name}_feed AS (SELECT *, CASE WHEN op <> 'delete' THEN {invalid} END AS invalid
  FROM ({sql.format(events="events")}) f),
{name}_settled AS (
  SELECT *, coalesce((last_value(CASE WHEN op <> 'update' AND invalid IS NULL THEN op END IGNORE NULLS)
    OVER (PARTITION BY id ORDER BY changed_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    = 'create', FALSE) AS existed FROM {name}_feed),
{name}_judged AS (
  SELECT *, coalesce(invalid, CASE WHEN op = 'create' AND existed THEN 'already_exists'
    WHEN op <> 'create' AND NOT existed THEN 'not_found' END) AS reject_reason FROM {name}_settled),
{name}_accepted AS (
  SELECT *, lead(changed_at) OVER (PARTITION BY id ORDER BY changed_at, seq) AS valid_to,
    last_value(CASE WHEN op = 'create' THEN changed_at END IGNORE NULLS)
      OVER (PARTITION BY id ORDER BY changed_at, seq) AS created_at
  FROM {name}_judged WHERE reject_reason IS NULL),
{name}_history AS (
  SELECT seq, id, {fields}, created_at, changed_at AS updated_at, changed_at AS valid_from, valid_to
  FROM {name}_accepted WHERE op <> 'delete'),
{name}_current AS (
  SELECT id, {fields}, created_at, updated_at FROM {name}_history WHERE valid_to IS NULL),
{name}_rejects AS (
  SELECT seq, changed_at, op, id, reject_reason, {_MESSAGE.format(r="reject_reason")} AS reject_message
  FROM {name}_judged WHERE reject_reason IS NOT NULL)"""


_RULE_FIELDS = "name, grouping_key, time_window_minutes"
_MANAGER_FIELDS = "name, description, grouping_rule_id, webhook_url"
_RULE_FEED = _feed(
    "rule",
    RULE_CHANGES_SQL,
    "CASE WHEN name = '' THEN 'empty_name' WHEN grouping_key = '' THEN 'empty_grouping_key' "
    "WHEN time_window_minutes <= 0 THEN 'invalid_time_window' END",
    _RULE_FIELDS,
)
_MANAGER_FEED = _feed(
    "manager",
    MANAGER_CHANGES_SQL,
    "CASE WHEN name = '' THEN 'empty_name' WHEN grouping_rule_id = '' THEN 'empty_grouping_rule_id' END",
    _MANAGER_FIELDS,
)
_ASOF = f"""ev AS ({ALERT_EVENTS_SQL.format(events="events")}),{_RULE_FEED},{_MANAGER_FEED},
joined AS (
  SELECT e.*, m.id AS manager_id, r.id AS rule_id, r.grouping_key, r.time_window_minutes
  FROM ev e LEFT JOIN manager_history m ON e.event_manager_id = m.id
      AND m.valid_from <= e.received_at AND (m.valid_to IS NULL OR e.received_at < m.valid_to)
    LEFT JOIN rule_history r ON m.grouping_rule_id = r.id
      AND r.valid_from <= e.received_at AND (r.valid_to IS NULL OR e.received_at < r.valid_to))"""


def _sql(body: str, *parts: str, until: str = "", base: str = _EVENTS) -> str:
    clause = f"AND received_at <= TIMESTAMP '{until}'" if until else ""
    return f"WITH RECURSIVE {base}{''.join(parts).replace('{until}', clause)}\n{body}"


def oracles() -> dict[str, str]:
    birth = (_ROUTED, _BIRTHS)
    link = (*birth, _LINKS)
    hist = (*link, _HISTORY)
    full = (*hist, _MACHINE)
    routed_columns = (
        "seq, received_at, event_manager_id, summary, severity, action, class, dedup_key, "
        "grouping_key, grouping_value, time_window_minutes, partition_key"
    )
    outcome = """SELECT seq, received_at, dedup_key, action,
  CASE WHEN is_parent THEN (CASE effect WHEN 'born' THEN 'new_parent' WHEN 'none' THEN 'duplicate'
      WHEN 'deferred' THEN 'resolve_deferred' WHEN 'resolved' THEN 'parent_resolved' ELSE effect END)
    WHEN is_birth THEN 'new_child'
    WHEN step = 0 THEN (CASE action WHEN 'trigger' THEN 'duplicate' ELSE 'resolve_noop' END)
    WHEN step = 1 THEN 'reactivated' ELSE 'child_resolved' END AS outcome,
  effect = 'cascaded' AS cascaded FROM effects
UNION ALL SELECT r.seq, r.received_at, r.dedup_key, r.action, 'resolve_unknown', FALSE
FROM routed r WHERE NOT EXISTS (SELECT 1 FROM known k
  WHERE k.dedup_key = r.dedup_key AND k.received_at = r.received_at AND k.seq = r.seq)"""
    alerts = f"SELECT {_ALERT_COLUMNS} FROM alerts"
    k_of = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
    lookup = "a.dedup_key, a.type, a.status, a.child_count, a.created_at, a.dedup_key IS NOT NULL AS found"
    sql = {
        "event_rejects": _sql(
            f"""SELECT seq, received_at, event_manager_id, summary, severity, action, class, dedup_key,
  reject_reason, {_CODE.format(r="reject_reason")} AS reject_code,
  {_MESSAGE.format(r="reject_reason")} AS reject_message
FROM checked WHERE reject_reason IS NOT NULL""",
            _ROUTED,
        ),
        "event_reject_counts": _sql(
            f"""SELECT reject_reason, {_CODE.format(r="reject_reason")} AS reject_code, count(*) AS events
FROM checked WHERE reject_reason IS NOT NULL GROUP BY reject_reason""",
            _ROUTED,
        ),
        "routed_events": _sql(f"SELECT {routed_columns} FROM routed", _ROUTED),
        "partition_keys": _sql(
            "SELECT event_manager_id, grouping_value, partition_key, count(*) AS events FROM routed "
            "GROUP BY event_manager_id, grouping_value, partition_key",
            _ROUTED,
        ),
        "malformed_json": _sql(
            f"""SELECT e.seq, CASE WHEN k NOT IN {_BROKEN} THEN event_manager_id END AS event_manager_id,
  CASE WHEN k NOT IN {_BROKEN} THEN dedup_key END AS dedup_key,
  CASE WHEN k IN (13, 19) THEN '' WHEN k NOT IN {_BROKEN} THEN class END AS class,
  CASE WHEN k IN {_BROKEN} THEN 'malformed' END AS reject_reason
FROM ev e JOIN (SELECT event_id, {k_of} AS k FROM events) x ON x.event_id = e.seq""",
        ),
        "log_messages": _sql(
            """SELECT seq, partition_key AS message_key, event_manager_id AS header_manager,
  action AS header_action, dedup_key AS header_dedup_key, grouping_value FROM routed""",
            _ROUTED,
        ),
        "decoded_log": _sql(
            f"""SELECT {routed_columns} FROM routed
WHERE seq NOT IN (SELECT event_id FROM events WHERE {k_of} = 21)""",
            _ROUTED,
        ),
        "births": _sql(
            """SELECT dedup_key, received_at AS born_at, seq AS born_seq, event_manager_id, summary,
  severity, class, grouping_key, grouping_value FROM births""",
            *birth,
        ),
        "duplicate_triggers": _sql(
            f"SELECT seq, received_at, dedup_key FROM ({outcome}) o WHERE outcome = 'duplicate'", *full
        ),
        "unknown_resolves": _sql(
            f"""SELECT o.seq, o.received_at, r.event_manager_id, o.dedup_key FROM ({outcome}) o
JOIN routed r ON r.seq = o.seq WHERE outcome = 'resolve_unknown'""",
            *full,
        ),
        "grouped_alerts": _sql(
            """SELECT md5(dedup_key) AS id, dedup_key, event_manager_id, summary, severity, class,
  CASE WHEN dedup_key = family THEN 'parent' ELSE 'child' END AS type,
  CASE WHEN dedup_key <> family THEN family END AS parent_dedup_key, born_at AS created_at,
  CASE WHEN dedup_key = family THEN expires_at END AS expires_at FROM links""",
            *link,
        ),
        "child_transitions": _sql(
            "SELECT family, dedup_key, received_at, seq, action, is_birth FROM counted WHERE step <> 0",
            *hist,
        ),
        "child_final_status": _sql(
            """SELECT family, dedup_key, CASE action WHEN 'trigger' THEN 'active' ELSE 'resolved' END AS status,
  received_at AS updated_at, CASE action WHEN 'resolve' THEN received_at END AS resolved_at
FROM child_end""",
            *full,
        ),
        "active_children_timeline": _sql(
            """SELECT family AS parent_dedup_key, dedup_key, received_at, seq,
  CAST(active_children AS BIGINT) AS active_children FROM counted WHERE step <> 0""",
            *hist,
        ),
        "event_outcomes": _sql(outcome, *full),
        "event_outcome_counts": _sql(
            f"SELECT outcome, cascaded, count(*) AS events FROM ({outcome}) o GROUP BY outcome, cascaded",
            *full,
        ),
        "alerts_final": _sql(alerts, *full),
        "active_child_count": _sql(
            """SELECT coalesce(parent_dedup_key, dedup_key) AS parent_dedup_key,
  count(CASE WHEN type = 'child' AND status = 'active' THEN 1 END) AS active_children
FROM alerts GROUP BY coalesce(parent_dedup_key, dedup_key)""",
            *full,
        ),
        "child_count": _sql(
            """SELECT family AS parent_dedup_key,
  count(CASE WHEN dedup_key <> family THEN 1 END) AS child_count FROM links GROUP BY family""",
            *link,
        ),
        "children_sets": _sql(
            """SELECT family AS parent_dedup_key,
  string_agg(dedup_key, ',' ORDER BY dedup_key) AS children
FROM links WHERE dedup_key <> family GROUP BY family""",
            *link,
        ),
        "children": _sql(
            "SELECT family AS parent_dedup_key, dedup_key FROM links WHERE dedup_key <> family", *link
        ),
        "children_set_sizes": _sql(
            """SELECT family AS parent_dedup_key, count(DISTINCT dedup_key) AS children
FROM links WHERE dedup_key <> family GROUP BY family""",
            *link,
        ),
        "pending_resolves": _sql(
            """SELECT family AS parent_dedup_key, requested_at, CAST(remaining AS INTEGER) AS remaining_children
FROM parent_end WHERE state = 'pending'""",
            *full,
        ),
        "pending_resolves_asof": _sql(
            """SELECT family AS parent_dedup_key, requested_at, CAST(remaining AS INTEGER) AS remaining_children
FROM parent_end WHERE state = 'pending'""",
            *full,
            until=AT,
        ),
        "open_parents": _sql(
            f"""SELECT event_manager_id, grouping_key, grouping_value, dedup_key, born_at AS created_at,
  expires_at FROM links WHERE dedup_key = family
  AND born_at <= TIMESTAMP '{AT}' AND expires_at >= TIMESTAMP '{AT}'""",
            *link,
        ),
        "live_parent_probe": _sql(
            """SELECT r.seq, r.received_at, r.event_manager_id, r.grouping_key, r.grouping_value,
  l.dedup_key AS parent_dedup_key, l.born_at AS parent_created_at
FROM routed r LEFT JOIN links l ON l.dedup_key = l.family AND l.event_manager_id = r.event_manager_id
  AND l.grouping_key = r.grouping_key AND l.grouping_value = r.grouping_value
  AND r.received_at >= l.born_at AND r.received_at <= l.expires_at""",
            *link,
        ),
        "alert_state_asof": _sql(
            """SELECT dedup_key, event_manager_id, type, status, parent_dedup_key, resolve_requested
FROM alerts""",
            *full,
            until=AT,
        ),
        "alert_versions": _sql("SELECT * FROM versions", *full, _VERSIONS),
        "alert_state_probes": _sql(
            """SELECT e.seq, e.dedup_key, e.received_at + INTERVAL 6 HOUR AS received_at,
  v.event_manager_id, v.type, v.status, v.parent_dedup_key, v.resolve_requested
FROM ev e LEFT JOIN versions v ON v.dedup_key = e.dedup_key AND v.valid_from <= e.received_at + INTERVAL 6 HOUR
  AND (v.valid_to IS NULL OR v.valid_to > e.received_at + INTERVAL 6 HOUR)""",
            *full,
            _VERSIONS,
        ),
        "notifications": _sql(
            """SELECT md5(e.family) AS alert_id, e.family AS dedup_key, l.event_manager_id, l.summary,
  l.severity, CASE e.effect WHEN 'born' THEN 'active' ELSE 'resolved' END AS status, 'parent' AS type,
  CAST(e.children AS INTEGER) AS child_count, e.received_at AS timestamp,
  coalesce(m.webhook_url, '') AS webhook_url
FROM effects e JOIN links l ON l.dedup_key = e.family LEFT JOIN managers m ON m.id = l.event_manager_id
WHERE e.effect = 'born' OR (e.effect IN ('resolved', 'cascaded') AND m.id IS NOT NULL)""",
            *full,
        ),
        "list_alerts_active": _sql(
            f"{alerts} WHERE status = 'active' ORDER BY created_at DESC, dedup_key LIMIT 100", *full
        ),
        "list_alerts_manager_parents": _sql(
            f"""{alerts} WHERE event_manager_id = 'em-1' AND type = 'parent' AND status = 'resolved'
ORDER BY created_at DESC, dedup_key LIMIT 100""",
            *full,
        ),
        "list_alerts_unknown_status": _sql(f"{alerts} WHERE status = 'open'", *full),
        "alerts_page": _sql(
            f"{alerts} ORDER BY created_at DESC, dedup_key LIMIT 25 OFFSET 50", *full
        ),
        "alerts_deep_page": _sql(
            f"{alerts} ORDER BY created_at DESC, dedup_key LIMIT 70 OFFSET 333", *full
        ),
        "alerts_deep_page_filtered": _sql(
            f"""{alerts} WHERE status = 'resolved' AND type = 'child'
ORDER BY created_at DESC, dedup_key LIMIT 70 OFFSET 90""",
            *full,
        ),
        "alerts_by_key": _sql(
            f"SELECT k.requested, {lookup} FROM asked k LEFT JOIN alerts a ON a.dedup_key = k.requested",
            *full,
            _ASKED,
        ),
        "alerts_by_id": _sql(
            f"""SELECT md5(k.requested) AS requested, {lookup}
FROM asked k LEFT JOIN alerts a ON a.id = md5(k.requested)""",
            *full,
            _ASKED,
        ),
        "children_of": _sql(
            f"""{alerts} WHERE parent_dedup_key IN (SELECT requested FROM asked)""",
            *full,
            _ASKED,
        ),
        "children_of_errors": _sql(
            """SELECT k.requested AS dedup_key,
  CASE WHEN a.dedup_key IS NULL THEN 'not_found' ELSE 'not_a_parent' END AS error,
  CASE WHEN a.dedup_key IS NULL THEN 'alert not found' ELSE 'alert is not a parent alert' END AS message
FROM asked k LEFT JOIN alerts a ON a.dedup_key = k.requested
WHERE a.dedup_key IS NULL OR a.type <> 'parent'""",
            *full,
            _ASKED,
        ),
        "config_rules": _sql("SELECT * FROM rule_current", base=_RULE_FEED),
        "config_rule_history": _sql("SELECT * FROM rule_history", base=_RULE_FEED),
        "config_rule_rejects": _sql("SELECT * FROM rule_rejects", base=_RULE_FEED),
        "config_managers": _sql("SELECT * FROM manager_current", base=_MANAGER_FEED),
        "config_manager_history": _sql("SELECT * FROM manager_history", base=_MANAGER_FEED),
        "config_manager_rejects": _sql("SELECT * FROM manager_rejects", base=_MANAGER_FEED),
        "config_by_id": _sql(
            f"""SELECT k.id AS requested, m.id IS NOT NULL AS found, m.name, m.grouping_rule_id
FROM (SELECT DISTINCT event_manager_id AS id FROM ({ALERT_EVENTS_SQL.format(events="events")}) e) k
LEFT JOIN manager_current m ON m.id = k.id""",
            base=_MANAGER_FEED,
        ),
        "routed_asof": _sql(f"SELECT {routed_columns} FROM routed", _ROUTED, base=_ASOF),
        "rejects_asof": _sql(
            "SELECT seq, reject_reason FROM checked WHERE reject_reason IS NOT NULL",
            _ROUTED,
            base=_ASOF,
        ),
        "alerts_asof_config": _sql(alerts, *full, base=_ASOF),
        "rules_by_id": _sql(
            f"""SELECT k.id AS requested, r.id IS NOT NULL AS found, r.name, r.grouping_key
FROM (SELECT id FROM rule_history
      UNION SELECT 'rule-' || class FROM ({ALERT_EVENTS_SQL.format(events="events")}) e) k
LEFT JOIN rule_current r ON r.id = k.id""",
            base=_RULE_FEED,
        ),
        "stream_ingest": _sql(f"SELECT {routed_columns} FROM routed", _ROUTED),
        "stream_raw_ingest": _sql(
            "SELECT seq, received_at, dedup_key, class, partition_key FROM routed", _ROUTED, base=_RAW_EVENTS
        ),
        "stream_malformed": _sql(
            "SELECT seq, reject_reason FROM checked WHERE reject_reason IS NOT NULL "
            f"UNION ALL SELECT event_id, 'malformed' FROM events WHERE {_K} IN {_BROKEN}",
            _ROUTED,
            base=_RAW_EVENTS,
        ),
        "stream_alerts": _sql(alerts, *full),
        "stream_alerts_compacted": _sql(alerts, *full),
    }
    sql["stream_notifications"] = sql["notifications"]
    sql["stream_pending"] = sql["pending_resolves"]
    sql["stream_open_parents"] = _sql(
        """SELECT event_manager_id, grouping_key, grouping_value, dedup_key, expires_at FROM links
WHERE dedup_key = family AND expires_at >= (SELECT max(received_at) FROM routed)""",
        *link,
    )
    sql["stream_parent_states"] = _sql(
        """SELECT a.dedup_key AS parent_dedup_key, a.status, a.resolve_requested, a.child_count,
  CAST(coalesce(n.active, 0) AS BIGINT) AS active_children
FROM alerts a LEFT JOIN (SELECT parent_dedup_key, count(*) AS active FROM alerts
  WHERE type = 'child' AND status = 'active' GROUP BY parent_dedup_key) n ON n.parent_dedup_key = a.dedup_key
WHERE a.type = 'parent'""",
        *full,
    )
    sql["stream_late"] = _sql(
        """SELECT seq, dedup_key, received_at, CAST(watermark * 1000 - us AS BIGINT) AS late_by
FROM arrived JOIN passed USING (arrival) WHERE (us // 1000000 + 1) * 1000 <= watermark""",
        _ROUTED,
        _ARRIVED,
    )
    sql["alert_state_at"] = sql["alert_state_asof"]
    split = "grouped_alerts", "event_outcomes", "alerts_final", "live_parent_probe", "alert_versions", "alert_state_probes"
    for name in split:
        sql[f"{name}_split"] = sql[name]
    for name in ("alerts_incremental", "alerts_compacted", "stream_event_time"):
        sql[name] = sql["alerts_final"]
    return sql
