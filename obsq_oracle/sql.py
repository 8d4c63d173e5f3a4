"""One SQL text per registered query.

Each repeats the mapping of FIXTURES.md that it needs, from the sample tables
alone, and states the result on its own terms rather than as Spark computes it.
"""

from __future__ import annotations

LEVEL = """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'CRITICAL'
     WHEN o_orderpriority = '3-MEDIUM' THEN 'WARNING' ELSE 'INFO' END"""

SEVERITY = "CASE WHEN {0} < 0 THEN 'CRITICAL' WHEN {0} < 1000 THEN 'WARNING' END"

PERIOD = """CASE {0} WHEN 0 THEN 'EVERY_MINUTE' WHEN 1 THEN 'EVERY_5_MINUTES'
     WHEN 2 THEN 'EVERY_10_MINUTES' WHEN 3 THEN 'EVERY_15_MINUTES'
     WHEN 4 THEN 'EVERY_30_MINUTES' WHEN 5 THEN 'EVERY_HOUR' WHEN 6 THEN 'EVERY_6_HOURS'
     WHEN 7 THEN 'EVERY_12_HOURS' WHEN 8 THEN 'EVERY_DAY' ELSE 'EVERY_WEEK' END"""

CTES = {
    "entity_base": f"""entity_base AS (
  SELECT 'APM|' || c_custkey AS guid, c_name AS name, c_nationkey::INTEGER AS account_id,
         'APM' AS domain, 'APPLICATION' AS type, c_acctbal >= 0 AS reporting,
         {SEVERITY.format('c_acctbal')} AS alert_severity,
         'segment=' || c_mktsegment || ';region=' || r_name AS tags_text
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 'INFRA|' || s_suppkey, s_name, s_nationkey::INTEGER, 'INFRA', 'HOST', s_acctbal >= 0,
         {SEVERITY.format('s_acctbal')}, ''
  FROM supplier
  UNION ALL
  SELECT 'SYNTH|' || p_partkey, p_name, (p_partkey % 25)::INTEGER, 'SYNTH', 'MONITOR',
         p_size % 3 = 0, NULL,
         'brand=' || p_brand || ';word=' || split_part(p_name, ' ', 1)
           || ';word=' || split_part(p_name, ' ', 2)
  FROM part
  UNION ALL
  SELECT 'BROWSER|' || page_id, url, (page_id % 25)::INTEGER, 'BROWSER', 'APPLICATION', true,
         NULL, ''
  FROM pages
  UNION ALL
  SELECT 'DASH|' || n_nationkey, n_name, n_nationkey::INTEGER, 'VIZ', 'DASHBOARD', NULL, NULL, ''
  FROM nation
)""",
    "entity": """entity AS (
  SELECT *, domain || '_' || type AS entity_type, 'https://example.test/' || guid AS permalink
  FROM entity_base
)""",
    "policy": """numbered AS (
  SELECT DISTINCT c_nationkey, c_mktsegment, c_nationkey * 10
         + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1
                WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4
           END AS number
  FROM customer
), policy AS (
  SELECT number::BIGINT AS policy_id, c_mktsegment || ' ' || n_name AS name,
         n_nationkey AS account_id,
         CASE number % 3 WHEN 0 THEN 'PER_POLICY' WHEN 1 THEN 'PER_CONDITION'
              ELSE 'PER_CONDITION_AND_TARGET' END AS incident_preference
  FROM numbered JOIN nation ON n_nationkey = c_nationkey
)""",
    "violation": f"""violation AS (
  SELECT o_orderkey AS violation_id, 'APM|' || o_custkey AS guid,
         'Violation ' || o_orderkey AS label, {LEVEL} AS level, o_orderdate AS opened_at,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS closed_at
  FROM orders
)""",
    "recent": """recent AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY guid
             ORDER BY opened_at DESC, violation_id DESC) AS rank
    FROM violation) WHERE rank <= 5
)""",
    "condition": """condition AS (
  SELECT 'INFRA|' || (p_partkey % 10) AS guid, p_partkey AS condition_id,
         p_name AS condition_name, p_size > 25 AS enabled,
         ((p_partkey % 25) * 10 + p_partkey % 5)::BIGINT AS policy_id
  FROM part
)""",
    "entity_condition": """entity_condition AS (
  SELECT c.guid, e.name AS entity_name, c.condition_id, c.condition_name, c.enabled,
         c.policy_id, p.name AS policy_name
  FROM condition c LEFT JOIN policy p ON p.policy_id = c.policy_id
  JOIN entity e ON e.guid = c.guid
)""",
    "edge": """edge AS (
  SELECT DISTINCT 'INFRA|' || l_suppkey AS source_guid, 'SYNTH|' || l_partkey AS target_guid,
         'SERVES' AS type
  FROM lineitem
)""",
    "entity_edge": """entity_edge AS (
  SELECT x.guid, d.type, d.source_guid, s.name AS source_name, s.entity_type AS source_type,
         d.target_guid, t.name AS target_name, t.entity_type AS target_type
  FROM edge d JOIN entity s ON s.guid = d.source_guid JOIN entity t ON t.guid = d.target_guid
  JOIN (SELECT source_guid AS guid, source_guid, target_guid FROM edge
        UNION ALL SELECT target_guid, source_guid, target_guid FROM edge) x
    ON x.source_guid = d.source_guid AND x.target_guid = d.target_guid
)""",
    "incident": f"""incident AS (
  SELECT o_orderkey AS incident_id, {LEVEL} || ' on ' || c_name AS title, {LEVEL} AS priority,
         CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'ACKNOWLEDGED'
              ELSE 'CLOSED' END AS state,
         c_mktsegment || ' ' || n_name AS policy_name,
         'Condition ' || (o_orderkey % 100) AS condition_name,
         'APM|' || o_custkey AS entity_guid, c_name AS entity_name,
         'APPLICATION' AS entity_type, o_orderdate AS started_at,
         o_orderdate + INTERVAL 1 DAY AS updated_at, 'Incident ' || o_orderkey AS description,
         'https://example.test/violation/' || o_orderkey AS violation_url,
         c_nationkey::INTEGER AS account_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)""",
    "ack": """ack AS (
  SELECT event_id AS req_id,
         CASE WHEN event_id % 10 = 9 THEN 1000000000 + event_id WHEN event_id % 10 = 8 THEN -event_id
              ELSE event_id // 4 * 6 + event_id % 2 END AS incident_id,
         CASE WHEN event_id % 3 = 0 THEN 'seen by ' || user_id END AS message,
         user_id::VARCHAR AS acknowledged_by, ts AS acknowledged_at
  FROM events
)""",
    "scoped": """scoped AS (
  SELECT * FROM events
  WHERE user_id % 25 = 7 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'
)""",
    "account_ack": """account_ack AS (
  SELECT event_id AS req_id,
         CASE WHEN event_id % 10 = 8 THEN -event_id ELSE event_id // 2 END AS incident_id,
         nullif(coalesce(CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN i.account_id + 1
                              ELSE i.account_id END, 7), 0)::INTEGER AS account_id,
         CASE WHEN event_id % 3 = 0 THEN 'seen by ' || user_id END AS message,
         user_id::VARCHAR AS acknowledged_by, ts AS acknowledged_at
  FROM events LEFT JOIN incident i ON i.incident_id = event_id // 2
)""",
    "monitor_checked": f"""monitor_request AS (
  SELECT page_id AS req_id, CASE WHEN page_id % 11 = 0 THEN '' ELSE 'mon-' || page_id END AS name,
         url AS uri, 'LOC_' || (page_id % 3) AS first_location,
         CASE WHEN page_id % 13 <> 0 THEN 'LOC_' || (page_id % 5) END AS second_location,
         {PERIOD.format('page_id % 10')} AS period,
         CASE page_id % 7 WHEN 0 THEN 'PAUSED' WHEN 1 THEN 'MUTED' WHEN 2 THEN 'DISABLED'
              ELSE 'ENABLED' END AS status,
         (1 + page_id % 24)::INTEGER AS account_id,
         CASE WHEN page_id % 4 <> 0 THEN 'team=team-' || (page_id % 6) END AS tags_text
  FROM pages
), monitor_checked AS (
  SELECT *, CASE WHEN name = '' OR uri = '' THEN 'REQUIRED'
                 WHEN second_location IS NULL THEN 'LOCATIONS'
                 WHEN period = 'EVERY_WEEK' THEN 'PERIOD'
                 WHEN status = 'PAUSED' THEN 'STATUS' ELSE 'OK' END AS outcome
  FROM monitor_request
)""",
}

ENTITY = ["entity_base", "entity"]


def _sql(body: str, *ctes: str) -> str:
    if not ctes:
        return body.strip()
    return "WITH " + ",\n".join(CTES[c] for c in ctes) + body.rstrip()


BASIC = "guid, name, entity_type, domain, account_id, tags_text"
INCIDENT_FIELDS = """incident_id, title, priority, state, policy_name, condition_name,
       entity_guid, entity_name, entity_type, started_at, updated_at, description, violation_url"""

ACCOUNT_LOOKUP = """SELECT req_id, r.account_id, n_name AS name,
       CASE WHEN r.account_id IS NULL THEN 'ACCOUNT' WHEN n_name IS NULL THEN 'NOT_FOUND'
            ELSE 'OK' END AS outcome
FROM (SELECT c_custkey AS req_id,
             nullif(CASE WHEN c_custkey % 10 = 9 THEN c_nationkey + 100
                         WHEN c_custkey % 10 = 4 THEN NULL
                         ELSE c_nationkey END, 0)::INTEGER AS account_id
      FROM customer) r
LEFT JOIN nation ON n_nationkey = r.account_id"""

KIND_JSON = f"""CASE domain
         WHEN 'APM' THEN (
           SELECT ',"apm":{{"language":"' || lower(c_mktsegment) || '","application_name":"' || c_name
                  || '","min_version":"1.' || (c_custkey % 5)
                  || '","max_version":"2.' || (c_custkey % 7) || '"}}'
           FROM customer WHERE 'APM|' || c_custkey = guid)
         WHEN 'BROWSER' THEN (
           SELECT ',"browser":{{"serving_agent_version":"1.' || (page_id % 30)
                  || '","application_name":"' || url || '","application_id":' || page_id || '}}'
           FROM pages WHERE 'BROWSER|' || page_id = guid)
         WHEN 'SYNTH' THEN (
           SELECT ',"monitor":{{"monitor_type":"' || p_type || '","period":"'
                  || {PERIOD.format('p_partkey % 9')} || '","status":"'
                  || CASE p_size % 3 WHEN 0 THEN 'ENABLED' WHEN 1 THEN 'DISABLED' ELSE 'MUTED' END
                  || '","locations_public":["LOC_' || (p_partkey % 3) || '","LOC_' || (p_partkey % 5)
                  || '"],"locations_private":[{{"guid":"LOCP|' || (p_partkey % 4)
                  || '","name":"private-' || (p_partkey % 4) || '"}}]'
                  || CASE WHEN p_partkey % 4 = 0 THEN ',"script_text":"// ' || p_name || '"'
                          ELSE '' END || '}}'
           FROM part WHERE 'SYNTH|' || p_partkey = guid)
         ELSE '' END"""

ORACLE_SQL = {
    # --- catalog and accounts ---
    "entity_catalog": _sql(
        """
SELECT guid, name, account_id, domain, type, entity_type, reporting, permalink,
       alert_severity, tags_text
FROM entity""",
        *ENTITY,
    ),
    "account_lookup": _sql(f"\n{ACCOUNT_LOOKUP}"),
    "account_lookup_json": _sql(
        f"""
SELECT req_id,
       CASE WHEN outcome = 'OK'
            THEN '{{"data":{{"id":' || account_id || ',"name":"' || name || '"}}}}'
            ELSE '{{"errors":[{{"message":"' || outcome || '"}}]}}' END AS reply
FROM ({ACCOUNT_LOOKUP})"""
    ),
    "account_resolve": _sql(
        """
SELECT c_custkey AS req_id,
       CASE WHEN c_custkey % 5 = 4 THEN 7 WHEN c_nationkey = 0 THEN NULL
            ELSE c_nationkey END::INTEGER AS account_id,
       CASE WHEN c_custkey % 5 <> 4 AND c_nationkey = 0 THEN 'ACCOUNT' ELSE 'OK' END AS outcome
FROM customer"""
    ),
    # --- search ---
    "entity_search_name": _sql(
        f"""
SELECT {BASIC} FROM entity WHERE name LIKE '%red%' AND domain = 'SYNTH'
ORDER BY guid LIMIT 50""",
        *ENTITY,
    ),
    "entity_search_account": _sql(
        f"""
SELECT {BASIC} FROM entity WHERE account_id = 6 AND name LIKE '%red%'""",
        *ENTITY,
    ),
    "entity_search_type": _sql(
        f"""
SELECT {BASIC} FROM entity WHERE type = 'HOST'""",
        *ENTITY,
    ),
    "entity_search_tags": _sql(
        f"""
SELECT {BASIC} FROM entity
WHERE list_contains(string_split(tags_text, ';'), 'word=red')
  AND list_contains(string_split(tags_text, ';'), 'word=widget')""",
        *ENTITY,
    ),
    "entity_search_combined": _sql(
        f"""
SELECT {BASIC} FROM entity
WHERE name LIKE '%#0_0%1%' AND type = 'APPLICATION' AND domain = 'APM'
  AND list_contains(string_split(tags_text, ';'), 'region=ASIA')""",
        *ENTITY,
    ),
    "entity_search_total": _sql(
        """
SELECT guid, name, (SELECT count(*) FROM entity WHERE domain = 'APM') AS total_count
FROM entity WHERE domain = 'APM' ORDER BY guid LIMIT 50""",
        *ENTITY,
    ),
    "entity_search_bulk": _sql(
        """
SELECT n_nationkey::BIGINT AS req_id, e.guid, e.name, e.entity_type, e.domain, e.account_id
FROM nation JOIN entity e ON e.account_id = n_nationkey AND (
     (n_nationkey % 10 BETWEEN 0 AND 2 AND e.domain = 'APM')
  OR (n_nationkey % 10 BETWEEN 3 AND 5 AND e.domain = 'INFRA' AND e.name LIKE '%0001%')
  OR (n_nationkey % 10 BETWEEN 6 AND 8 AND e.name LIKE '%red%'))""",
        *ENTITY,
    ),
    "entity_search_bulk_many": _sql(
        """
SELECT r.c_custkey AS req_id, e.guid, e.name, e.entity_type, e.domain, e.account_id
FROM customer r JOIN entity e ON contains(e.name, right(r.c_name, 6))
WHERE r.c_custkey % 7 <> 6 AND (r.c_custkey % 3 = 0 OR e.account_id = r.c_nationkey)
  AND (r.c_custkey % 7 >= 3
       OR list_contains(string_split(e.tags_text, ';'), 'segment=' || r.c_mktsegment))""",
        *ENTITY,
    ),
    "entity_search_bulk_totals": _sql(
        """
SELECT r.c_custkey AS req_id, count(*) AS total_count
FROM customer r JOIN entity e ON contains(e.name, right(r.c_name, 6))
WHERE r.c_custkey % 7 <> 6 AND (r.c_custkey % 3 = 0 OR e.account_id = r.c_nationkey)
  AND (r.c_custkey % 7 >= 3
       OR list_contains(string_split(e.tags_text, ';'), 'segment=' || r.c_mktsegment))
GROUP BY r.c_custkey""",
        *ENTITY,
    ),
    "entity_search_bulk_errors": _sql(
        """
SELECT c_custkey AS req_id, 'at least one of name, type, domain and tags is needed' AS message
FROM customer WHERE c_custkey % 7 = 6"""
    ),
    "entity_search_bulk_first": _sql(
        """
SELECT * EXCLUDE rank FROM (
  SELECT n_nationkey::BIGINT AS req_id, e.guid, e.name, e.entity_type, e.domain, e.account_id,
         row_number() OVER (PARTITION BY n_nationkey ORDER BY e.guid) AS rank
  FROM nation JOIN entity e ON e.account_id = n_nationkey AND (
       (n_nationkey % 10 BETWEEN 0 AND 2 AND e.domain = 'APM')
    OR (n_nationkey % 10 BETWEEN 3 AND 5 AND e.domain = 'INFRA' AND e.name LIKE '%0001%')
    OR (n_nationkey % 10 BETWEEN 6 AND 8 AND e.name LIKE '%red%')))
WHERE rank <= 5""",
        *ENTITY,
    ),
    "entity_exact_match": _sql(
        f"""
SELECT {BASIC} FROM entity
WHERE name = 'red widget' AND domain = 'SYNTH' AND type = 'MONITOR'""",
        *ENTITY,
    ),
    "entity_page_next": _sql(
        """, behind AS (
  SELECT guid, name, row_number() OVER (ORDER BY guid) AS rn
  FROM entity WHERE domain = 'SYNTH' AND guid > 'SYNTH|11')
SELECT guid, name,
       (SELECT CASE WHEN count(*) > 50 THEN max(guid) FILTER (WHERE rn = 50) END
        FROM behind) AS next_cursor
FROM behind WHERE rn <= 50""",
        *ENTITY,
    ),
    "apm_application_list": _sql(
        """
SELECT guid, name, lower(split_part(split_part(tags_text, ';', 1), '=', 2)) AS language,
       reporting, alert_severity, tags_text
FROM entity WHERE account_id = 7 AND domain = 'APM' AND type = 'APPLICATION'
ORDER BY guid LIMIT 250""",
        *ENTITY,
    ),
    "monitor_list": _sql(
        f"""
SELECT 'SYNTH|' || p_partkey AS guid, p_name AS name, p_type AS monitor_type,
       {PERIOD.format('p_partkey % 9')} AS period,
       CASE p_size % 3 WHEN 0 THEN 'ENABLED' WHEN 1 THEN 'DISABLED' ELSE 'MUTED' END AS status,
       'LOC_' || (p_partkey % 3) || ';LOC_' || (p_partkey % 5) AS locations_public,
       'LOCP|' || (p_partkey % 4) || '=private-' || (p_partkey % 4) AS locations_private,
       'brand=' || p_brand || ';word=' || split_part(p_name, ' ', 1)
         || ';word=' || split_part(p_name, ' ', 2) AS tags_text
FROM part WHERE p_partkey % 25 = 7 ORDER BY guid LIMIT 250"""
    ),
    # --- details ---
    "entity_detail": _sql(
        """
SELECT r.req_id, r.guid, e.name, e.account_id, e.domain, e.entity_type, e.tags_text,
       e.reporting, e.permalink, e.alert_severity,
       CASE WHEN e.guid IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS outcome
FROM (SELECT event_id AS req_id,
             CASE WHEN event_type = 'error' THEN 'MOBILE|' ELSE 'APM|' END || user_id AS guid
      FROM events) r
LEFT JOIN entity e ON e.guid = r.guid""",
        *ENTITY,
    ),
    "entity_detail_by_type": _sql(
        f"""
SELECT e.guid, e.name, e.domain, e.entity_type, lower(c_mktsegment) AS language,
       c_name AS apm_application_name, '1.' || (c_custkey % 5) AS min_version,
       '2.' || (c_custkey % 7) AS max_version,
       '1.' || (page_id % 30) AS serving_agent_version, url AS browser_application_name,
       page_id AS application_id,
       s_acctbal / 100.0 AS cpu_utilization_percent, (s_suppkey % 100)::DOUBLE AS disk_used_percent,
       (s_suppkey % 90)::DOUBLE AS memory_used_percent, s_acctbal * 2.0 AS network_receive_rate,
       s_acctbal * 0.5 AS network_transmit_rate,
       CASE s_suppkey % 2 WHEN 0 THEN 'linux' WHEN 1 THEN 'windows' END AS operating_system,
       (s_suppkey % 8 + 1) * 1073741824 AS system_memory_bytes,
       (s_suppkey % 16 + 1)::INTEGER AS processor_count,
       '5.' || (s_suppkey % 20) AS kernel_version, '1.' || (s_suppkey % 50) AS agent_version,
       p_type AS monitor_type,
       CASE WHEN p_partkey IS NOT NULL THEN {PERIOD.format('p_partkey % 9')} END AS period,
       CASE p_size % 3 WHEN 0 THEN 'ENABLED' WHEN 1 THEN 'DISABLED' WHEN 2 THEN 'MUTED'
            END AS status,
       'LOC_' || (p_partkey % 3) || ';LOC_' || (p_partkey % 5) AS locations_public,
       'LOCP|' || (p_partkey % 4) || '=private-' || (p_partkey % 4) AS locations_private,
       CASE WHEN p_partkey % 4 = 0 THEN '// ' || p_name END AS script_text
FROM entity e
LEFT JOIN customer ON 'APM|' || c_custkey = e.guid
LEFT JOIN pages ON 'BROWSER|' || page_id = e.guid
LEFT JOIN supplier ON 'INFRA|' || s_suppkey = e.guid
LEFT JOIN part ON 'SYNTH|' || p_partkey = e.guid""",
        *ENTITY,
    ),
    "entity_detail_nested": _sql(
        """, child AS (
  SELECT guid, 'v' AS list, violation_id::VARCHAR AS id, rank::VARCHAR || ':' || violation_id AS item,
         lpad(rank::VARCHAR, 20, '0') AS place FROM recent
  UNION ALL
  SELECT guid, 'c', condition_id::VARCHAR, concat_ws(':', condition_id, policy_name),
         lpad(condition_id::VARCHAR, 20, '0') FROM entity_condition
  UNION ALL
  SELECT guid, 'r', source_guid || chr(1) || target_guid || chr(1) || type,
         source_guid || '>' || target_guid, source_guid || chr(1) || target_guid FROM entity_edge
), sized AS (
  SELECT *, ceil(count(*) OVER (PARTITION BY guid, list) / 100.0)::BIGINT AS parts FROM child
), placed AS (
  SELECT *, CASE WHEN parts > 1 THEN ('0x' || substr(md5(id), 1, 8))::BIGINT % parts
                 ELSE 0 END AS part
  FROM sized
), slot AS (
  SELECT DISTINCT guid, part FROM placed UNION SELECT guid, 0 FROM entity
)
SELECT s.guid, s.part::BIGINT AS part, CASE WHEN s.part = 0 THEN e.name END AS name,
       coalesce(string_agg(p.item, ',' ORDER BY p.place) FILTER (WHERE p.list = 'v'), '')
         AS violations,
       coalesce(string_agg(p.item, ',' ORDER BY p.place) FILTER (WHERE p.list = 'c'), '')
         AS conditions,
       coalesce(string_agg(p.item, ',' ORDER BY p.place) FILTER (WHERE p.list = 'r'), '')
         AS relationships
FROM slot s LEFT JOIN placed p ON p.guid = s.guid AND p.part = s.part
LEFT JOIN entity e ON e.guid = s.guid
GROUP BY s.guid, s.part, e.name""",
        *ENTITY, "policy", "violation", "recent", "condition", "entity_condition", "edge",
        "entity_edge",
    ),
    "entity_detail_requested": _sql(
        """, asked AS (
  SELECT 'APM|' || o_custkey AS guid FROM orders UNION SELECT 'INFRA|' || s_suppkey FROM supplier
  UNION SELECT 'DASH|' || n_nationkey FROM nation UNION SELECT 'MOBILE|' || c_custkey FROM customer
), delivery AS (
  SELECT 'INFRA|' || l_suppkey AS source_guid, 'SYNTH|' || l_partkey AS target_guid FROM lineitem
), numbered_edge AS (
  SELECT *, row_number() OVER (PARTITION BY guid, source_guid, target_guid) - 1 AS copy
  FROM (SELECT source_guid AS guid, * FROM delivery
        UNION ALL SELECT target_guid, * FROM delivery) JOIN asked USING (guid)
), child AS (
  SELECT guid, 'v' AS list, violation_id::VARCHAR AS id, rank::VARCHAR || ':' || violation_id AS item,
         lpad(rank::VARCHAR, 20, '0') AS place FROM recent
  UNION ALL
  SELECT guid, 'c', condition_id::VARCHAR, concat_ws(':', condition_id, policy_name),
         lpad(condition_id::VARCHAR, 20, '0') FROM entity_condition
  UNION ALL
  SELECT guid, 'r', source_guid || chr(1) || target_guid || chr(1) || 'SERVES'
         || CASE WHEN copy > 0 THEN chr(1) || copy ELSE '' END,
         source_guid || ':' || target_guid, source_guid || chr(1) || target_guid
  FROM numbered_edge
  UNION ALL
  SELECT 'APM|' || user_id, 'i', event_id::VARCHAR, rank || ':' || event_id,
         lpad(rank::VARCHAR, 20, '0')
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank
        FROM events WHERE event_type <> 'error') WHERE rank <= 5
  UNION ALL
  SELECT 'DASH|' || c_nationkey, 'p', c_custkey::VARCHAR,
         'PAGE|' || c_custkey || ':' || coalesce((
           SELECT string_agg(o_orderkey::VARCHAR, '+' ORDER BY o_orderkey)
           FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank
                 FROM orders) o WHERE o.o_custkey = c.c_custkey AND o.rank <= 10), ''),
         lpad(page_rank::VARCHAR, 20, '0')
  FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS page_rank
        FROM customer) c WHERE page_rank <= 10
), sized AS (
  SELECT *, ceil(count(*) OVER (PARTITION BY guid, list) / 100.0)::BIGINT AS parts
  FROM child JOIN asked USING (guid)
), placed AS (
  SELECT *, CASE WHEN parts > 1 THEN ('0x' || substr(md5(id), 1, 8))::BIGINT % parts
                 ELSE 0 END AS part
  FROM sized
), slot AS (
  SELECT DISTINCT p.guid, part FROM placed p JOIN entity USING (guid)
  UNION SELECT guid, 0 FROM asked
), told AS (
  SELECT s.guid, s.part, p.list, string_agg(p.item, ',' ORDER BY p.place) AS items
  FROM slot s JOIN placed p ON p.guid = s.guid AND p.part = s.part JOIN entity e ON e.guid = s.guid
  GROUP BY ALL
)
SELECT s.guid, s.part::BIGINT AS part,
       CASE WHEN e.guid IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS outcome,
       CASE WHEN s.part = 0 THEN e.name END AS name,
       CASE WHEN s.part = 0 THEN lower(c_mktsegment) END AS language,
       CASE WHEN s.part = 0 THEN CASE s_suppkey % 2 WHEN 0 THEN 'linux' WHEN 1 THEN 'windows' END
         END AS operating_system,
       coalesce(v.items, '') AS recent_violations, coalesce(c.items, '') AS conditions,
       coalesce(r.items, '') AS relationships, coalesce(i.items, '') AS running_instances,
       coalesce(p.items, '') AS pages
FROM slot s LEFT JOIN entity e ON e.guid = s.guid
LEFT JOIN customer ON 'APM|' || c_custkey = e.guid
LEFT JOIN supplier ON 'INFRA|' || s_suppkey = e.guid
LEFT JOIN told v ON v.guid = s.guid AND v.part = s.part AND v.list = 'v'
LEFT JOIN told c ON c.guid = s.guid AND c.part = s.part AND c.list = 'c'
LEFT JOIN told r ON r.guid = s.guid AND r.part = s.part AND r.list = 'r'
LEFT JOIN told i ON i.guid = s.guid AND i.part = s.part AND i.list = 'i'
LEFT JOIN told p ON p.guid = s.guid AND p.part = s.part AND p.list = 'p'""",
        *ENTITY, "policy", "violation", "recent", "condition", "entity_condition",
    ),
    "entity_recent_violations": _sql(
        """
SELECT guid, rank, violation_id, label, level, opened_at, closed_at FROM recent""",
        "violation", "recent",
    ),
    "entity_alert_conditions": _sql(
        """
SELECT * FROM entity_condition""",
        *ENTITY, "policy", "condition", "entity_condition",
    ),
    "entity_relationships": _sql(
        """
SELECT * FROM entity_edge""",
        *ENTITY, "edge", "entity_edge",
    ),
    "apm_running_instances": _sql(
        """
SELECT 'APM|' || user_id AS guid, rank, event_id AS instance_id, 'host-' || (event_id % 50) AS host,
       (8000 + event_id % 1000)::INTEGER AS port, '1.' || (event_id % 5) AS agent_version
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank
      FROM events WHERE event_type <> 'error')
WHERE rank <= 5"""
    ),
    "dashboard_pages_widgets": _sql(
        """
SELECT 'DASH|' || c_nationkey AS dashboard_guid, page_rank, 'PAGE|' || c_custkey AS page_guid,
       c_name AS page_name, widget_rank, o_orderkey AS widget_id,
       'Widget ' || o_orderkey AS title, o_orderpriority AS visualization
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS page_rank
      FROM customer) c
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS widget_rank
           FROM orders) o
  ON o.o_custkey = c.c_custkey AND o.widget_rank <= 10
WHERE page_rank <= 10"""
    ),
    "entity_json": _sql(
        f"""
SELECT guid,
       '{{"guid":"' || guid || '","name":"' || name || '","account_id":' || account_id
       || ',"domain":"' || domain || '","entity_type":"' || entity_type || '"'
       || coalesce(',"reporting":' || reporting::VARCHAR, '')
       || coalesce(',"alert_severity":"' || alert_severity || '"', '')
       || ',"tags":[' || CASE WHEN tags_text = '' THEN '' ELSE
            '{{"key":"' || replace(replace(tags_text, '=', '","value":"'), ';', '"}},{{"key":"')
            || '"}}' END || ']'
       || {KIND_JSON} || '}}' AS json
FROM entity""",
        *ENTITY,
    ),
    # --- events ---
    "event_count": _sql(
        """
SELECT count(*) AS n FROM events WHERE event_type IN ('click', 'view')"""
    ),
    "event_time_range": _sql(
        """
SELECT event_id, ts, user_id, event_type, value, props FROM events
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'"""
    ),
    "event_facet": _sql(
        """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users,
       round(sum(value), 2) AS total_value, min(value) AS min_value, max(value) AS max_value
FROM events GROUP BY event_type"""
    ),
    "event_facet_attr": _sql(
        """
SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, max(value) AS max_value
FROM events GROUP BY 1"""
    ),
    "event_timeseries": _sql(
        """
SELECT date_trunc('hour', ts) AS bucket_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS bucket_end,
       count(*) AS n, round(sum(value), 2) AS total_value
FROM events GROUP BY 1, 2"""
    ),
    "event_timeseries_facet": _sql(
        """
SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS bucket_start,
       time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 7 DAY AS bucket_end,
       event_type, count(*) AS n
FROM events GROUP BY 1, 2, 3"""
    ),
    "event_timeseries_filled": _sql(
        """
SELECT bucket_start, bucket_start + INTERVAL 1 HOUR AS bucket_end, f.event_type,
       count(e.event_id) AS n
FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)
     AS b(bucket_start)
CROSS JOIN (SELECT DISTINCT event_type FROM events
            WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31') f
LEFT JOIN events e ON e.event_type = f.event_type AND e.ts >= bucket_start
     AND e.ts < bucket_start + INTERVAL 1 HOUR
GROUP BY 1, 2, 3"""
    ),
    "event_account": _sql(
        """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users
FROM events WHERE user_id % 25 = 5 GROUP BY event_type"""
    ),
    "event_default_account": _sql(
        """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users
FROM events WHERE user_id % 25 = 7 GROUP BY event_type"""
    ),
    "event_filled_measures": _sql(
        """, b AS (
  SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-11 23:00:00',
                                INTERVAL 1 HOUR)) AS bucket_start)
SELECT bucket_start, bucket_start + INTERVAL 1 HOUR AS bucket_end, f.event_type,
       count(e.event_id) AS n, max(e.value) AS max_value, min(e.props) AS first_props
FROM b CROSS JOIN (SELECT DISTINCT event_type FROM scoped) f
LEFT JOIN scoped e ON e.event_type = f.event_type AND e.ts >= bucket_start
     AND e.ts < bucket_start + INTERVAL 1 HOUR
GROUP BY 1, 2, 3""",
        "scoped",
    ),
    "event_bucket_total": _sql(
        """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start,
       time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS bucket_end, event_type,
       0 AS is_total, count(*) AS n, count(DISTINCT user_id) AS users
FROM events GROUP BY 1, 2, 3
UNION ALL
SELECT NULL, NULL, NULL, 1, count(*), count(DISTINCT user_id) FROM events"""
    ),
    "event_compare_total": _sql(
        """
WITH sides AS (
  SELECT *, ts >= TIMESTAMP '2024-01-15' AS now FROM events
  WHERE ts >= TIMESTAMP '2024-01-14' AND ts < TIMESTAMP '2024-01-16'), counted AS (
  SELECT event_type, grouping(event_type)::INTEGER AS is_total,
         nullif(count(*) FILTER (now), 0) AS current_n,
         nullif(count(*) FILTER (NOT now), 0) AS previous_n
  FROM sides GROUP BY GROUPING SETS ((event_type), ()))
SELECT * FROM counted"""
    ),
    "event_total_result": _sql(
        """
SELECT event_type, 0 AS is_total, count(*) AS n, count(DISTINCT user_id) AS users
FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'
GROUP BY event_type
UNION ALL
SELECT NULL, 1, count(*), count(DISTINCT user_id)
FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'"""
    ),
    "event_metadata": _sql(
        """
SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types,
       'event_type' AS facets, TIMESTAMP '2024-01-15' AS window_begin,
       TIMESTAMP '2024-01-16' AS window_end, TIMESTAMP '2024-01-14' AS compare_with
FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16'"""
    ),
    "event_compare": _sql(
        """
SELECT coalesce(c.event_type, p.event_type) AS event_type, c.n AS current_n, p.n AS previous_n,
       c.users AS current_users, p.users AS previous_users
FROM (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events
      WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' GROUP BY 1) c
FULL JOIN (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events
      WHERE ts >= TIMESTAMP '2024-01-14' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1) p
  ON p.event_type = c.event_type"""
    ),
    "event_timeseries_compare": _sql(
        """
SELECT coalesce(c.b, p.b) AS bucket_start, coalesce(c.b, p.b) + INTERVAL 1 HOUR AS bucket_end,
       coalesce(c.event_type, p.event_type) AS event_type, c.n AS current_n, p.n AS previous_n
FROM (SELECT date_trunc('hour', ts) AS b, event_type, count(*) AS n FROM events
      WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' GROUP BY 1, 2) c
FULL JOIN (SELECT date_trunc('hour', ts + INTERVAL 7 DAY) AS b, event_type, count(*) AS n FROM events
      WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2) p
  ON p.b = c.b AND p.event_type = c.event_type"""
    ),
    # --- alerts ---
    "policy_list": _sql(
        """
SELECT policy_id, name, incident_preference FROM policy WHERE lower(name) LIKE '%auto%'""",
        "policy",
    ),
    "open_incident_list": _sql(
        f"""
SELECT {INCIDENT_FIELDS} FROM incident WHERE state = 'OPEN'""",
        "incident",
    ),
    "open_incident_priority": _sql(
        f"""
SELECT {INCIDENT_FIELDS} FROM incident
WHERE state = 'OPEN' AND priority = 'CRITICAL' AND account_id = 7""",
        "incident",
    ),
    "open_incident_page_next": _sql(
        """, behind AS (
  SELECT incident_id, started_at, priority,
         row_number() OVER (ORDER BY started_at DESC, incident_id DESC) AS rn
  FROM incident
  WHERE state = 'OPEN' AND (started_at < TIMESTAMP '1998-01-01'
        OR (started_at = TIMESTAMP '1998-01-01' AND incident_id < 5000)))
SELECT incident_id, started_at, priority,
       (SELECT strftime(started_at, '%Y-%m-%d') || ' ' || incident_id FROM behind
        WHERE rn = 100 AND (SELECT count(*) FROM behind) > 100) AS next_cursor
FROM behind WHERE rn <= 100""",
        "incident",
    ),
    "incident_current_state": _sql(
        """, first AS (
  SELECT incident_id, acknowledged_by, acknowledged_at FROM (
    SELECT *, row_number() OVER (PARTITION BY incident_id
                                 ORDER BY acknowledged_at, req_id) AS rn
    FROM ack WHERE incident_id > 0) WHERE rn = 1)
SELECT i.incident_id, i.account_id,
       CASE WHEN i.state = 'OPEN' AND f.incident_id IS NOT NULL THEN 'ACKNOWLEDGED'
            ELSE i.state END AS state,
       CASE WHEN i.state = 'OPEN' THEN f.acknowledged_by END AS acknowledged_by,
       CASE WHEN i.state = 'OPEN' THEN f.acknowledged_at END AS acknowledged_at
FROM incident i LEFT JOIN first f USING (incident_id)""",
        "incident", "ack",
    ),
    "open_incident_after_ack": _sql(
        f"""
SELECT {INCIDENT_FIELDS} FROM incident
WHERE state = 'OPEN' AND incident_id NOT IN (SELECT incident_id FROM ack WHERE incident_id > 0)""",
        "incident", "ack",
    ),
    "incident_ack_outcome": _sql(
        """, judged AS (
  SELECT a.*, i.state AS base_state, i.title AS base_title,
         CASE WHEN a.incident_id <= 0 THEN 'INVALID_ID' WHEN i.incident_id IS NULL THEN 'NOT_FOUND'
              WHEN i.state <> 'OPEN' THEN 'NOT_OPEN'
              WHEN row_number() OVER (PARTITION BY a.incident_id
                                      ORDER BY acknowledged_at, req_id) > 1 THEN 'ALREADY_ACKED'
              ELSE 'OK' END AS outcome
  FROM ack a LEFT JOIN incident i ON i.incident_id = a.incident_id AND a.incident_id > 0)
SELECT req_id, incident_id, 7 AS account_id, message, acknowledged_by, acknowledged_at, outcome,
       CASE WHEN outcome = 'OK' THEN 'ACKNOWLEDGED' ELSE base_state END AS state,
       CASE WHEN outcome = 'OK' THEN base_title END AS title
FROM judged""",
        "incident", "ack",
    ),
    "account_ack_outcome": _sql(
        """, judged AS (
  SELECT a.*, i.state AS base_state, i.title AS base_title,
         CASE WHEN a.account_id IS NULL THEN 'ACCOUNT' WHEN a.incident_id <= 0 THEN 'INVALID_ID'
              WHEN i.incident_id IS NULL THEN 'NOT_FOUND' WHEN i.state <> 'OPEN' THEN 'NOT_OPEN'
              WHEN row_number() OVER (PARTITION BY a.account_id, a.incident_id
                                      ORDER BY acknowledged_at, req_id) > 1 THEN 'ALREADY_ACKED'
              ELSE 'OK' END AS outcome
  FROM account_ack a LEFT JOIN incident i
    ON i.incident_id = a.incident_id AND i.account_id = a.account_id AND a.incident_id > 0)
SELECT req_id, incident_id, account_id, message, acknowledged_by, acknowledged_at, outcome,
       CASE WHEN outcome = 'OK' THEN 'ACKNOWLEDGED' ELSE base_state END AS state,
       CASE WHEN outcome = 'OK' THEN base_title END AS title
FROM judged""",
        "incident", "account_ack",
    ),
    "account_ack_state": _sql(
        """, first AS (
  SELECT account_id, incident_id, acknowledged_by, acknowledged_at FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id, incident_id
                                 ORDER BY acknowledged_at, req_id) AS rn
    FROM account_ack WHERE incident_id > 0 AND account_id IS NOT NULL) WHERE rn = 1)
SELECT incident_id, account_id,
       CASE WHEN i.state = 'OPEN' AND f.incident_id IS NOT NULL THEN 'ACKNOWLEDGED'
            ELSE i.state END AS state,
       CASE WHEN i.state = 'OPEN' THEN f.acknowledged_by END AS acknowledged_by,
       CASE WHEN i.state = 'OPEN' THEN f.acknowledged_at END AS acknowledged_at
FROM incident i LEFT JOIN first f USING (account_id, incident_id)""",
        "incident", "account_ack",
    ),
    "account_ack_still_open": _sql(
        f"""
SELECT {INCIDENT_FIELDS} FROM incident i
WHERE state = 'OPEN' AND NOT EXISTS (
  SELECT 1 FROM account_ack a WHERE a.incident_id = i.incident_id AND a.account_id = i.account_id
    AND a.incident_id > 0)""",
        "incident", "account_ack",
    ),
    # --- monitors ---
    "monitor_create": _sql(
        """
SELECT req_id, 'SYNTH|' || md5(length(req_id::VARCHAR) || ':' || req_id || '|' || length(account_id::VARCHAR) || ':'
       || account_id || '|' || length(name) || ':' || name || '|' || length(uri) || ':' || uri) AS guid, account_id, name,
       uri, first_location || ';' || second_location AS locations_public, period, status,
       'SIMPLE_BROWSER' AS type, tags_text
FROM monitor_checked WHERE outcome = 'OK'""",
        "monitor_checked",
    ),
    "monitor_create_errors": _sql(
        """
SELECT req_id, account_id, name, outcome,
       CASE outcome WHEN 'REQUIRED' THEN 'name, uri and locations are required'
                    WHEN 'LOCATIONS' THEN 'every location must be a text'
                    WHEN 'PERIOD' THEN 'the period is not one of the valid ones'
                    ELSE 'the status is not one of the valid ones' END AS message
FROM monitor_checked WHERE outcome <> 'OK'""",
        "monitor_checked",
    ),
    # --- replies and free queries ---
    "response_parse": _sql(
        """
SELECT 'event-' || event_id AS reply_id,
       CASE WHEN event_type = 'error' THEN 'error' ELSE 'data' END AS kind, 0 AS position,
       CASE WHEN event_type = 'error' THEN 'event ' || event_id || ' failed'
            ELSE '{"id":' || event_id || ',"type":"' || event_type || '"}' END AS content
FROM events
UNION ALL
SELECT 'page-' || page_id, 'undecodable', 0, substr(html, 1, 500) FROM pages"""
    ),
    "sql_param_query": _sql(
        """
SELECT e.domain, i.priority, count(*) AS n
FROM incident i JOIN entity e ON e.guid = i.entity_guid
WHERE i.state = 'OPEN' AND i.account_id = 7 AND i.started_at >= TIMESTAMP '1996-01-01'
GROUP BY e.domain, i.priority""",
        *ENTITY, "incident",
    ),
}
# A batch judged again after it was logged has the outcomes it had.
ORACLE_SQL["account_ack_rerun"] = ORACLE_SQL["account_ack_outcome"]

# A kept index answers as the catalog does.
ORACLE_SQL["entity_index_name"] = _sql(
    f"""
SELECT {BASIC} FROM entity WHERE name LIKE '%red%' AND domain = 'SYNTH'""",
    *ENTITY,
)
ORACLE_SQL["entity_index_bulk"] = ORACLE_SQL["entity_search_bulk_many"]
ORACLE_SQL["entity_index_totals"] = ORACLE_SQL["entity_search_bulk_totals"]

# The odd requests find incidents as the even ones left them.
ACK_BATCHES = """, asked AS (
  SELECT *, req_id % 2 AS odd, row_number() OVER (
           PARTITION BY req_id % 2, account_id, incident_id ORDER BY acknowledged_at, req_id) AS turn
  FROM account_ack
), even AS (
  SELECT i.incident_id, i.account_id, a.acknowledged_by, a.acknowledged_at
  FROM incident i JOIN asked a USING (incident_id, account_id)
  WHERE i.state = 'OPEN' AND a.odd = 0 AND a.turn = 1 AND a.incident_id > 0
), seen AS (
  SELECT i.incident_id, i.account_id, i.title, i.state AS at_first,
         CASE WHEN e.incident_id IS NOT NULL THEN 'ACKNOWLEDGED' ELSE i.state END AS then_,
         e.acknowledged_by AS even_by, e.acknowledged_at AS even_at
  FROM incident i LEFT JOIN even e USING (incident_id, account_id)
)"""
ORACLE_SQL["ack_log_outcome"] = _sql(
    ACK_BATCHES + """, judged AS (
  SELECT a.*, s.title AS base_title, CASE WHEN odd = 1 THEN then_ ELSE at_first END AS base_state
  FROM asked a LEFT JOIN seen s
    ON s.incident_id = a.incident_id AND s.account_id = a.account_id AND a.incident_id > 0
), told AS (
  SELECT *, CASE WHEN account_id IS NULL THEN 'ACCOUNT' WHEN incident_id <= 0 THEN 'INVALID_ID'
                 WHEN base_state IS NULL THEN 'NOT_FOUND' WHEN base_state <> 'OPEN' THEN 'NOT_OPEN'
                 WHEN turn > 1 THEN 'ALREADY_ACKED' ELSE 'OK' END AS outcome
  FROM judged)
SELECT req_id // 2 AS req_id, incident_id, account_id, message, acknowledged_by, acknowledged_at, outcome,
       CASE WHEN outcome = 'OK' THEN 'ACKNOWLEDGED' ELSE base_state END AS state,
       CASE WHEN outcome = 'OK' THEN base_title END AS title,
       CASE WHEN odd = 1 THEN 'odd' ELSE 'even' END AS batch
FROM told""",
    "incident", "account_ack",
)
ORACLE_SQL["ack_log_state"] = _sql(
    ACK_BATCHES + """
SELECT s.incident_id, s.account_id,
       CASE WHEN then_ = 'OPEN' AND o.incident_id IS NOT NULL THEN 'ACKNOWLEDGED' ELSE then_ END AS state,
       CASE WHEN even_at IS NOT NULL THEN even_by WHEN then_ = 'OPEN' THEN o.acknowledged_by END AS acknowledged_by,
       CASE WHEN even_at IS NOT NULL THEN even_at WHEN then_ = 'OPEN' THEN o.acknowledged_at END AS acknowledged_at
FROM seen s LEFT JOIN asked o
  ON o.incident_id = s.incident_id AND o.account_id = s.account_id AND o.odd = 1 AND o.turn = 1 AND o.incident_id > 0""",
    "incident", "account_ack",
)
ORACLE_SQL["monitor_stored"] = f"""
SELECT *, CASE WHEN req_id % 3 <> 0 THEN 'part' ELSE 'all' END AS batch FROM ({ORACLE_SQL["monitor_create"]})"""

# Bucketed tables answer as the plain ones do.
ORACLE_SQL["entity_stored_requested"] = ORACLE_SQL["entity_detail_requested"]
ORACLE_SQL["entity_stored_violations"] = ORACLE_SQL["entity_recent_violations"]

# A customer's entity has the tags of its segment and region.
ORACLE_SQL["entity_tag_table"] = _sql(
    """, pair AS (
  SELECT min(c_custkey) AS req_id, 'segment=' || c_mktsegment || ';region=' || r_name AS pair
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 2
)
SELECT req_id, guid, name, entity_type, domain, account_id FROM pair JOIN entity ON tags_text = pair""",
    *ENTITY,
)

# Rollups answer as the events do.
ORACLE_SQL["event_rollup_compare"] = ORACLE_SQL["event_compare_total"]
ORACLE_SQL["event_rollup_daily"] = """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS bucket_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS bucket_end,
       event_type, 0 AS is_total, count(*) AS n, round(sum(value), 2) AS total_value, max(value) AS most
FROM events GROUP BY 1, 2, 3
UNION ALL
SELECT NULL, NULL, NULL, 1, count(*), round(sum(value), 2), max(value) FROM events"""

ORACLE_SQL["event_facet_variant"] = ORACLE_SQL["event_facet_attr"]
ORACLE_SQL["response_typed"] = """
SELECT 'event-' || event_id AS reply_id, 0 AS position, event_id AS id, event_type AS type
FROM events WHERE event_type <> 'error'"""
