"""SQL counterparts of the query catalogue, for an engine that reads the same Parquet files."""

from __future__ import annotations

import re

from eventlake import fixed_values as fx
from eventlake.plans import seed
from eventlake.operators.metrics import RUN_BOUNDS
from eventlake.schemas import APP_TABLES, ENVIRONMENT_TEXTS, REQUIRED_COLUMNS
from eventlake.sources.adapters import EVENTS_AS_OF, LABELS_AS_OF, SUBSCRIBERS_AS_OF

EVENTS_AT = f"TIMESTAMP '{EVENTS_AS_OF}'"
LABELS_AT = f"TIMESTAMP '{LABELS_AS_OF}'"
SUBSCRIBERS_AT = f"TIMESTAMP '{SUBSCRIBERS_AS_OF}'"
RANGE = 21600


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def half_up(numerator: str, denominator: str) -> str:
    """Quotient of whole numbers rounded half up, in whole-number arithmetic."""
    return f"((2*({numerator}) + ({denominator})) // (2*({denominator})))"


def tenths(t: str) -> str:
    return f"(({t})//10 || '.' || ({t})%10)"


def grouped(n: str) -> str:
    return f"format('{{:,}}', coalesce({n}, 0))"


def compact(n: str) -> str:
    return (
        f"CASE WHEN {n} IS NULL THEN '0' WHEN {n} >= 1000000 THEN {tenths(half_up(f'{n}*10', '1000000'))} || 'm' "
        f"WHEN {n} >= 1000 THEN {tenths(half_up(f'{n}*10', '1000'))} || 'k' ELSE {grouped(n)} END"
    )


def relative(ts: str, as_of: str) -> str:
    age = f"(epoch_us({as_of}) - epoch_us({ts}))"
    second = 1_000_000
    return (
        f"CASE WHEN {ts} IS NULL THEN 'No recent activity' WHEN {age} < {60 * second} THEN 'Just now' "
        f"WHEN {age} < {3600 * second} THEN {age} // {60 * second} || ' minutes ago' "
        f"WHEN {age} < {86400 * second} THEN {age} // {3600 * second} || ' hours ago' "
        f"WHEN {age} < {7 * 86400 * second} THEN {age} // {86400 * second} || ' days ago' "
        f"ELSE strftime({ts}, '%b %d, %Y') END"
    )


def slug(x: str) -> str:
    return f"trim(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '-', 'g'), '-')"


def quoted(x: str) -> str:
    return f"coalesce('''' || replace(CAST({x} AS VARCHAR), '''', '''''') || '''', 'NULL')"


def js(key: str, missing: str = "''") -> str:
    return (
        f"CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload, '$.{key}') = 'VARCHAR' "
        f"THEN json_extract_string(payload, '$.{key}') ELSE {missing} END ELSE {missing} END"
    )


def window_of(ts: str, seconds: int = RANGE) -> str:
    return f"((epoch_us({ts}) // 1000000) // {seconds} * {seconds})"


CTE: dict[str, str] = {}

CTE["ev"] = """
  SELECT event_id AS n, 'evt-' || event_id AS event_id, 'env' || (user_id % 3) AS environment, 'cmp-' || user_id AS campaign_id,
         'user-' || user_id AS user_id, 'rcp-' || k AS recipient_id, '/p' || (k % 10) AS page_url, event_type AS event_name,
         ts AS occurred_at, user_id AS u, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def campaign_counts(source: str, refreshed: str) -> str:
    return f"""
  SELECT environment, campaign_id,
         count(DISTINCT recipient_id) FILTER (event_name <> 'error') AS delivered_recipients,
         count(DISTINCT recipient_id) FILTER (event_name IN ('view', 'click', 'purchase')) AS open_recipients,
         count(DISTINCT recipient_id) FILTER (event_name IN ('click', 'purchase')) AS click_recipients,
         count(DISTINCT recipient_id) FILTER (event_name = 'error') AS bounce_recipients,
         min(occurred_at) AS first_seen_at, max(occurred_at) AS last_seen_at, {refreshed} AS refreshed_at
  FROM {source} GROUP BY environment, campaign_id"""


CTE["ca"] = campaign_counts("ev", EVENTS_AT)
CTE["ea"] = f"""
  SELECT environment, page_url, event_name, count(*) AS event_count, count(DISTINCT user_id) AS unique_users,
         min(occurred_at) AS first_seen_at, max(occurred_at) AS last_seen_at, {EVENTS_AT} AS refreshed_at
  FROM ev GROUP BY environment, page_url, event_name"""
CTE["dp"] = f"""
  SELECT environment, CAST(occurred_at AS DATE) AS bucket_date, count(*) AS event_count, {EVENTS_AT} AS refreshed_at
  FROM ev GROUP BY environment, CAST(occurred_at AS DATE)"""
CTE["env"] = (
    "SELECT 'env' || r_regionkey AS environment, "
    + ", ".join(f"r_name || ' {name}' AS {name}" for name in ENVIRONMENT_TEXTS)
    + ", TIMESTAMP '2024-01-01' AS updated_at FROM region"
)
CTE["camp"] = """
  SELECT 'env' || (p_partkey % 3) AS environment, 'cmp-' || p_partkey AS campaign_id, p_name AS title,
         p_brand || ' ' || p_type AS summary,
         CASE (p_partkey // 3) % 3 WHEN 0 THEN 'Sent' WHEN 1 THEN 'Scheduled' ELSE 'Draft' END AS status,
         p_size * 1000 AS audience_count, p_brand AS audience_label, p_type AS action_label, 'primary' AS tone,
         p_partkey + 1 AS display_order
  FROM part"""
CTE["sub"] = """
  SELECT 'env' || (c_custkey % 3) AS environment, 'sub-' || c_custkey AS subscriber_id, c_name AS name,
         lower(c_name) || '@example.com' AS email, c_mktsegment AS security_status,
         coalesce(first_order, TIMESTAMP '1995-01-01') AS created_at, last_order AS last_interaction_at, 'primary' AS tone,
         c_custkey % 10 = 0 AS is_featured, c_custkey + 1 AS display_order
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order
                           FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"""
CTE["seg"] = """
  SELECT DISTINCT 'env' || (o_custkey % 3) AS environment, 'sub-' || o_custkey AS subscriber_id, o_orderpriority AS segment_label,
         CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS display_order
  FROM orders"""
CTE["fa"] = """
  SELECT DISTINCT 'env' || (o_custkey % 3) AS environment, 'sub-' || o_custkey AS subscriber_id, o_orderstatus AS filter_label
  FROM orders"""
CTE["fil"] = """
  SELECT DISTINCT 'env' || (o_custkey % 3) AS environment, o_orderstatus AS filter_label, instr('POF', o_orderstatus) AS display_order
  FROM orders"""
CTE["act"] = f"""
  SELECT 'env' || n_regionkey AS environment, 'act-' || n_nationkey AS activity_id, n_name AS title,
         'Activity in ' || n_name AS description, {LABELS_AT} - to_hours(n_nationkey * 7) AS occurred_at, 'muted' AS tone,
         n_nationkey + 1 AS display_order
  FROM nation"""
CTE["grow"] = """
  SELECT 'env' || (s_suppkey % 3) AS environment, 'seg-' || s_suppkey AS segment_id, s_name AS label,
         CAST(abs(round(s_acctbal * 100)) AS BIGINT) % 10000 AS hundredths, s_suppkey + 1 AS display_order
  FROM supplier"""
CTE["pipe"] = """
  SELECT 'env' || n_regionkey AS environment, 'pipe-' || n_nationkey AS pipeline_id, n_name AS title,
         'Pipeline of ' || n_name AS description, 'Live' AS status, n_nationkey + 1 AS display_order
  FROM nation"""
CTE["sig"] = """
  SELECT 'env' || n_regionkey AS environment, 'sig-' || n_nationkey AS signal_id, n_name AS title,
         'Signal of ' || n_name AS description, 'open-analytics-view' AS action, 'analytics' AS event_kind,
         'navigation' AS subject_type, n_name AS subject_id, n_nationkey + 1 AS display_order
  FROM nation"""

# views

CTE["livet"] = f"""
  SELECT environment, campaign_id, delivered_recipients, open_recipients, click_recipients, bounce_recipients,
         CASE WHEN delivered_recipients > 0 THEN {half_up('open_recipients*1000', 'delivered_recipients')} END AS open_t,
         CASE WHEN delivered_recipients > 0 THEN {half_up('click_recipients*1000', 'delivered_recipients')} END AS click_t,
         CASE WHEN delivered_recipients + bounce_recipients > 0
              THEN {half_up('delivered_recipients*10000', 'delivered_recipients + bounce_recipients')} END AS deliver_h,
         first_seen_at, last_seen_at, refreshed_at
  FROM ca"""
CTE["metric_card"] = f"""
  SELECT environment, 'total-subscribers' AS id, 'Total Subscribers' AS label, {grouped('members')} AS value,
         '+' || {tenths(half_up('new_members*1000', 'greatest(members, 1)'))} || '% this month' AS delta, 'success' AS accent,
         'group' AS icon, 'CRUD-synced subscriber registry' AS detail, CAST(1 AS BIGINT) AS display_order FROM figures
  UNION ALL
  SELECT environment, 'avg-open-rate', 'Avg. Open Rate',
         {tenths("CASE WHEN d > 0 THEN " + half_up('o*1000', 'd') + " ELSE 0 END")} || '%',
         {grouped('o')} || ' opens from consolidated campaign analytics', 'primary', 'mail', 'Refreshed from campaign aggregates', 2
  FROM figures
  UNION ALL
  SELECT environment, 'click-through-rate', 'Click Through Rate',
         {tenths("CASE WHEN d > 0 THEN " + half_up('c*1000', 'd') + " ELSE 0 END")} || '%',
         {grouped('c')} || ' clicks from consolidated campaign analytics', 'muted', 'ads_click', 'Refreshed from campaign aggregates', 3
  FROM figures"""


def figures(as_of: str) -> str:
    return f"""
  SELECT environment, coalesce(members, 0) AS members, coalesce(new_members, 0) AS new_members, coalesce(d, 0) AS d,
         coalesce(o, 0) AS o, coalesce(c, 0) AS c
  FROM env
  LEFT JOIN (SELECT environment, count(*) AS members, count(*) FILTER (created_at >= date_trunc('month', {as_of})) AS new_members
             FROM sub GROUP BY environment) USING (environment)
  LEFT JOIN (SELECT environment, CAST(sum(delivered_recipients) AS BIGINT) AS d, CAST(sum(open_recipients) AS BIGINT) AS o,
                    CAST(sum(click_recipients) AS BIGINT) AS c FROM ca GROUP BY environment) USING (environment)"""


CTE["summary_card"] = f"""
  SELECT environment, 'total-reach' AS id, 'Total Reach' AS label, {compact('reach')} AS value, sent || ' sent campaigns' AS detail,
         'muted' AS tone, 0 AS progress, CAST(1 AS BIGINT) AS display_order FROM totals
  UNION ALL
  SELECT environment, 'avg-engagement', 'Avg Engagement',
         CASE WHEN rated > 0 THEN {tenths(half_up('rate_sum', 'rated'))} || '%' ELSE '0.0%' END,
         {grouped('d')} || ' deliveries consolidated', 'primary', 0, 2 FROM totals
  UNION ALL
  SELECT environment, 'deliverability', 'Deliverability', {tenths('(h + 5) // 10')} || '%', {grouped('b')} || ' bounced addresses',
         'progress', greatest(0, least(100, (h + 50) // 100)), 3
  FROM (SELECT *, CASE WHEN d + b > 0 THEN {half_up('d*10000', 'd + b')} ELSE 0 END AS h FROM totals)"""
CTE["totals"] = """
  SELECT environment, CAST(sum(audience_count) AS BIGINT) AS reach, count(*) FILTER (status = 'Sent') AS sent,
         CAST(sum(open_t) FILTER (status = 'Sent') AS BIGINT) AS rate_sum,
         count(*) FILTER (status = 'Sent' AND open_t IS NOT NULL) AS rated,
         CAST(sum(coalesce(delivered_recipients, 0)) AS BIGINT) AS d, CAST(sum(coalesce(bounce_recipients, 0)) AS BIGINT) AS b
  FROM camp LEFT JOIN livet USING (environment, campaign_id) GROUP BY environment"""


def bars(as_of: str) -> str:
    day = f"CAST({as_of} AS DATE)"
    return f"""
  SELECT environment, strftime(bucket_date, '%a') AS label, {compact('event_count')} AS value,
         greatest(18, least(94, {half_up('event_count*94', 'busiest')})) AS height,
         row_number() OVER (PARTITION BY environment ORDER BY event_count DESC, bucket_date DESC) = 1 AS emphasis,
         row_number() OVER (PARTITION BY environment ORDER BY bucket_date) AS display_order,
         CAST(bucket_date AS VARCHAR) AS bucket_date, event_count
  FROM (SELECT environment, days.bucket_date, coalesce(event_count, 0) AS event_count,
               greatest(max(coalesce(event_count, 0)) OVER (PARTITION BY environment), 1) AS busiest
        FROM (SELECT environment, CAST(unnest(generate_series({day} - INTERVAL 6 DAY, CAST({day} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS bucket_date FROM env) days
        LEFT JOIN dp USING (environment, bucket_date))"""


CTE["synced"] = """
  SELECT environment, greatest(updated_at, a, b, c, d, e) AS synced_at
  FROM env
  LEFT JOIN (SELECT environment, max(refreshed_at) AS a, max(last_seen_at) AS b FROM ca GROUP BY environment) USING (environment)
  LEFT JOIN (SELECT environment, max(refreshed_at) AS c, max(last_seen_at) AS d FROM ea GROUP BY environment) USING (environment)
  LEFT JOIN (SELECT environment, max(refreshed_at) AS e FROM dp GROUP BY environment) USING (environment)"""


def assigned(separator: str) -> str:
    return f"""
  SELECT environment, subscriber_id, coalesce(assigned_segments, '') AS assigned_segments, coalesce(filter_tags, '') AS filter_tags
  FROM sub
  LEFT JOIN (SELECT environment, subscriber_id, string_agg(segment_label, '{separator}' ORDER BY display_order, segment_label) AS assigned_segments
             FROM seg GROUP BY environment, subscriber_id) USING (environment, subscriber_id)
  LEFT JOIN (SELECT environment, subscriber_id, string_agg(filter_label, '{separator}' ORDER BY display_order, filter_label) AS filter_tags
             FROM fa JOIN fil USING (environment, filter_label) GROUP BY environment, subscriber_id) USING (environment, subscriber_id)"""


CTE["camp_item"] = f"""
  SELECT environment, display_order, concat_ws('|', campaign_id, title, summary, status, {grouped('audience_count')}, audience_label,
         CASE WHEN status = 'Sent' THEN coalesce({tenths('open_t')} || '%', '--') ELSE '--' END,
         CASE WHEN status = 'Sent' THEN coalesce({tenths('click_t')} || '%', '--') ELSE '--' END, action_label, tone) AS item
  FROM camp LEFT JOIN livet USING (environment, campaign_id)"""
CTE["sections"] = f"""
  SELECT environment, 'metrics' AS section, display_order, concat_ws('|', id, label, value, delta, accent, icon, detail) AS item FROM metric_card
  UNION ALL SELECT environment, 'bars', display_order, concat_ws('|', label, value, height, emphasis) FROM bar
  UNION ALL SELECT environment, 'activities', display_order,
         concat_ws('|', activity_id, title, description, {relative('occurred_at', LABELS_AT)}, tone) FROM act
  UNION ALL SELECT environment, 'segments', display_order, concat_ws('|', segment_id, label, {tenths('(hundredths + 5) // 10')} || '%') FROM grow
  UNION ALL SELECT environment, 'stats', display_order, concat_ws('|', id, label, value, detail, tone, progress) FROM summary_card
  UNION ALL SELECT environment, 'campaigns', display_order, item FROM camp_item
  UNION ALL SELECT environment, 'filters', display_order, filter_label FROM fil
  UNION ALL SELECT environment, 'subscribers', display_order,
         concat_ws('|', subscriber_id, name, email, security_status, assigned_segments, filter_tags,
                   {relative('last_interaction_at', LABELS_AT)}, tone)
         FROM sub JOIN assigned USING (environment, subscriber_id) WHERE is_featured
  UNION ALL SELECT environment, 'pipelines', display_order, concat_ws('|', pipeline_id, title, description, status) FROM pipe
  UNION ALL SELECT environment, 'signals', display_order,
         concat_ws('|', signal_id, title, description, action, event_kind, subject_type, subject_id) FROM sig"""
CTE["serving_text"] = """
  SELECT 'Open ' || coalesce(CAST(sum(open_recipients) AS BIGINT), 0) || ' • Click ' || coalesce(CAST(sum(click_recipients) AS BIGINT), 0)
         || ' • Delivered ' || coalesce(CAST(sum(delivered_recipients) AS BIGINT), 0) AS description FROM ca"""


def paged(rows: str) -> str:
    return f"""
  SELECT environment, page, count(*) AS items, string_agg(id, ',' ORDER BY display_order) AS ids
  FROM (SELECT r.environment, r.id, r.display_order, CAST(before // 100 AS BIGINT) AS page
        FROM {rows} r JOIN (
          SELECT environment, block, coalesce(sum(size) OVER (PARTITION BY environment ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM (SELECT environment, display_order // 100 AS block, count(*) AS size FROM {rows} GROUP BY ALL)) b
        ON b.environment = r.environment AND b.block = r.display_order // 100)
  GROUP BY environment, page"""


CTE["camp_id"] = "SELECT environment, campaign_id AS id, display_order FROM camp"
CTE["sub_id"] = "SELECT environment, subscriber_id AS id, display_order FROM sub WHERE is_featured"
CTE["grow_id"] = "SELECT environment, segment_id AS id, display_order FROM grow"
CTE["camp_page"] = paged("camp_id")
CTE["sub_page"] = paged("sub_id")
CTE["grow_page"] = paged("grow_id")

# raw messages

NAME_FIELD = """CASE n % 4 WHEN 0 THEN '"event":"' || event_name || '",' WHEN 1 THEN '"event_name":"' || event_name || '",'
         WHEN 2 THEN '"event_type":"' || event_name || '",' ELSE '"event":5,"event_name":"' || event_name || '","campaign_id":null,' END"""
TIME_TEXT = """CASE n % 50 WHEN 9 THEN 'not a time' WHEN 11 THEN '2024-13-45 bad' ELSE strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%fZ') END"""
CTE["raw"] = f"""
  SELECT *, CASE WHEN n % 4 = 2 THEN 'email_events_raw' ELSE 'analytics_events_raw' END AS topic,
         '{{"event_id":"' || CASE WHEN n % 50 = 13 THEN '' ELSE event_id END || '",' || {NAME_FIELD}
         || CASE WHEN n % 4 <> 3 THEN '"campaign_id":"' || campaign_id || '",' ELSE '' END
         || '"user_id":"' || user_id || '","page_url":"' || page_url || '","occurred_at":"' || {TIME_TEXT} || '","payload":{{"k":' || k || '}}'
         || CASE WHEN n % 50 = 7 THEN '' ELSE '}}' END AS payload
  FROM ev"""
PARSED_TIME = "try_strptime(t, '%Y-%m-%dT%H:%M:%S.%fZ')"


def parse(extra: str) -> str:
    return f"""
  SELECT CASE WHEN e <> '' THEN e WHEN en <> '' THEN en ELSE {extra} END AS event_name, campaign_id, user_id,
         coalesce(date_trunc('second', {PARSED_TIME}), TIMESTAMP '1970-01-01') AS occurred_at, payload
  FROM (SELECT payload, {js('event')} AS e, {js('event_name')} AS en, {js('event_type')} AS et, {js('campaign_id')} AS campaign_id,
               {js('user_id')} AS user_id, {js('occurred_at')} AS t FROM (SELECT payload FROM raw))"""


CTE["parsed"] = parse("''")
CTE["sorted_text"] = f"""
  SELECT *, '{{"campaign_id":' || CASE WHEN n % 4 = 3 THEN 'null' ELSE '"' || campaign_id || '"' END
         || CASE n % 4 WHEN 0 THEN ',"event":"' || event_name || '"' WHEN 3 THEN ',"event":5' ELSE '' END
         || ',"event_id":"' || CASE WHEN n % 50 = 13 THEN '' ELSE event_id END || '"'
         || CASE WHEN n % 4 IN (1, 3) THEN ',"event_name":"' || event_name || '"' ELSE '' END
         || CASE WHEN n % 4 = 2 THEN ',"event_type":"' || event_name || '"' ELSE '' END
         || ',"occurred_at":"' || {TIME_TEXT} || '","page_url":"' || page_url || '","payload":{{"k":' || k || '}},"user_id":"' || user_id || '"}}' AS doc,
         coalesce(date_trunc('millisecond', try_strptime({TIME_TEXT}, '%Y-%m-%dT%H:%M:%S.%fZ')), {EVENTS_AT}) AS seen
  FROM ev WHERE n % 50 <> 7"""

# partner records and objects

CTE["part_rec"] = """
  SELECT s_suppkey, 'rec-' || (s_suppkey // 2) AS record_id,
         CASE WHEN s_nationkey % 2 = 0 THEN 'ads_partner' ELSE 'crm_partner' END AS provider,
         CASE WHEN s_nationkey % 5 <> 0 THEN 'acct-' || s_nationkey ELSE '' END AS account_id,
         TIMESTAMP '2024-01-01' + to_minutes(s_suppkey) AS collected_at,
         '{"nation":' || s_nationkey || ',"spend_cents":' || CAST(round(s_acctbal * 100) AS BIGINT) || '}' AS payload
  FROM supplier"""
CTE["known_rec"] = """
  SELECT DISTINCT 'rec-' || (s_suppkey // 2) AS record_id, 'ads_partner' AS provider, 'stored' AS account_id,
         TIMESTAMP '2023-12-31' AS collected_at, '{}' AS payload
  FROM supplier WHERE (s_suppkey // 2) % 3 = 0"""

# commands

CTE["cmd"] = f"""
  SELECT event_id AS command_id, environment, CASE WHEN n % 5 <> 0 THEN 's-' || u END AS session_id,
         CASE WHEN n % 7 = 0 THEN '' ELSE user_id END AS user_id,
         CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN 'campaigns' ELSE '/subscribers' END AS route,
         CASE WHEN n % 41 = 0 THEN ' ' ELSE 'Campaign Row' END AS surface,
         CASE event_name WHEN 'signup' THEN 'add-subscriber' WHEN 'purchase' THEN 'create-brief' WHEN 'click' THEN 'launch-test-send'
              WHEN 'view' THEN 'open-analytics-view' ELSE 'Navigate To!' END AS action,
         CASE WHEN event_name IN ('purchase', 'click') THEN 'campaign' WHEN event_name = 'signup' THEN 'subscriber' ELSE 'navigation' END AS subject_type,
         CASE WHEN event_name = 'purchase' AND n % 3 = 0 THEN 'new-brief' WHEN event_name = 'click' AND n % 6 = 0 THEN 'gone-' || u
              WHEN event_name = 'signup' AND n % 2 = 0 THEN 'new-subscriber' WHEN event_name = 'signup' AND n % 4 = 1 THEN 'Member ' || u
              WHEN event_name = 'signup' THEN 'sub-' || u WHEN event_name IN ('purchase', 'click') THEN 'cmp-' || u ELSE 'analytics' END AS subject_id,
         CASE WHEN n % 10 = 0 AND event_name IN ('view', 'error') THEN campaign_id ELSE '' END AS campaign_id, recipient_id,
         CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN 'auto' WHEN 2 THEN 'analytics' WHEN 3 THEN 'email' ELSE 'both' END AS event_kind,
         CASE WHEN event_name = 'purchase' THEN '{{"title":" Brief ' || k || '","audienceCount":' || k * 10 || ',"tone":5}}'
              WHEN event_name = 'signup' THEN '{{"email":"Member.' || u || '@mail.org","assignedSegments":["S' || k % 5 || '"," Core ","S' || k % 5
                   || '"],"filterTags":["Tag ' || k % 7 || '","",4]}}' ELSE '{{}}' END AS metadata,
         occurred_at, u, k, strftime(occurred_at, '%Y%m%d%H%M%S%f') || event_id AS moment
  FROM ev"""
CTE["valid"] = "SELECT * FROM cmd WHERE trim(surface) <> '' AND trim(action) <> ''"
PLACEHOLDER = "trim(subject_id) IN ('', 'new-brief', 'new-campaign')"
CTE["identified"] = f"""
  SELECT * REPLACE (
    CASE WHEN coalesce(session_id, '') = '' THEN 'session-' || substr(md5(command_id), 1, 12) ELSE session_id END AS session_id,
    CASE WHEN user_id = '' THEN 'platform-operator' ELSE user_id END AS user_id,
    CASE WHEN route = '' THEN 'dashboard' ELSE route END AS route, coalesce(event_kind, 'auto') AS event_kind,
    CASE WHEN campaign_id = '' AND (event_kind IN ('email', 'both') OR subject_type = 'campaign' OR action = 'create-brief')
         THEN CASE WHEN {PLACEHOLDER} THEN {slug('action')} || '-' || strftime(occurred_at, '%Y%m%d%H%M%S') ELSE trim(subject_id) END
         ELSE campaign_id END AS campaign_id)
  FROM valid"""
CTE["norm"] = f"""
  SELECT * REPLACE (CASE WHEN action = 'create-brief' AND {PLACEHOLDER} THEN campaign_id ELSE subject_id END AS subject_id) FROM identified"""
TO_ANALYTICS = "event_kind <> 'email'"
TO_EMAIL = "(event_kind IN ('email', 'both') OR (event_kind <> 'analytics' AND (subject_type = 'campaign' OR campaign_id <> '')))"
PAGE = "CASE WHEN route IN ('', '/') THEN '/dashboard' WHEN starts_with(route, '/') THEN route ELSE '/' || route END"
CTE["targeted"] = "SELECT *, CASE WHEN campaign_id <> '' THEN campaign_id ELSE subject_id END AS cid FROM norm"
CTE["briefs"] = """
  SELECT environment, cid, min(moment) AS first_brief, max(moment) AS last_brief, min(occurred_at) AS first_at, arg_max(k, moment) AS k
  FROM targeted WHERE action = 'create-brief' GROUP BY environment, cid"""
CTE["judged"] = """
  SELECT t.*, c.campaign_id IS NOT NULL OR coalesce(t.moment > b.first_brief, false) AS known
  FROM (SELECT * FROM targeted WHERE action = 'launch-test-send') t
  LEFT JOIN briefs b ON b.environment = t.environment AND b.cid = t.cid
  LEFT JOIN camp c ON c.environment = t.environment AND c.campaign_id = t.cid"""
CTE["launched"] = "SELECT environment, cid, max(moment) AS last_launch FROM judged WHERE known GROUP BY environment, cid"
CTE["touched"] = """
  SELECT environment, cid, first_brief, last_brief, k, last_launch,
         last_launch IS NOT NULL AND (last_brief IS NULL OR last_launch > last_brief) AS scheduled
  FROM briefs FULL JOIN launched USING (environment, cid)"""
CTE["adds"] = """
  SELECT *, CASE WHEN starts_with(subject_id, 'sub-') THEN 'sub-' || u ELSE 'member-' || u END AS sid
  FROM norm WHERE action = 'add-subscriber'"""
CTE["latest_add"] = """
  SELECT environment, sid, max(moment) AS last_moment, min(moment) AS first_moment, min(occurred_at) AS first_at, max(occurred_at) AS last_at,
         arg_max(k, moment) AS k, any_value(u) AS u
  FROM adds GROUP BY environment, sid"""

# logs and samples

STATUS = "CAST(CASE event_name WHEN 'error' THEN 500 WHEN 'click' THEN 404 ELSE 200 END AS BIGINT)"
CTE["log"] = f"""
  SELECT 'svc' || (u % 3) AS service, 'GET' AS method, page_url AS route, {STATUS} AS status, occurred_at AS ts, n AS request_id FROM ev"""
CTE["steps"] = f"""
  SELECT service, route, status, window_start,
         CASE WHEN previous IS NULL THEN 0.0 WHEN value < previous THEN value ELSE value - previous END AS step
  FROM (SELECT *, lag(value) OVER (PARTITION BY service, route, status ORDER BY ts, value) AS previous
        FROM (SELECT service, route, CAST(status AS VARCHAR) AS status, ts, CAST(request_id % 1000 AS DOUBLE) AS value,
                     {window_of('ts')} AS window_start FROM log))"""
CTE["le_bound"] = "SELECT * FROM (VALUES ('0.05', 0.05::DOUBLE, 10), ('0.1', 0.1::DOUBLE, 30), ('0.25', 0.25::DOUBLE, 60), ('0.5', 0.5::DOUBLE, 85), ('1', 1.0::DOUBLE, 95), ('+Inf', 'Infinity'::DOUBLE, 100)) AS b(le, bound, share)"
CTE["bucket_rate"] = f"""
  SELECT service, bound, window_start, sum(CASE WHEN previous IS NULL THEN 0.0::DOUBLE WHEN value < previous THEN value ELSE value - previous END) / {RANGE} AS observed
  FROM (SELECT *, lag(value) OVER (PARTITION BY service, le ORDER BY ts, value) AS previous
        FROM (SELECT service, le, bound, ts, CAST((request_id % 1000) * share // 100 AS DOUBLE) AS value, {window_of('ts')} AS window_start
              FROM log, le_bound))
  GROUP BY service, bound, window_start"""


def quantile(source: str, keys: str) -> str:
    return f"""
  SELECT {keys}, arg_min(CASE WHEN top = 'Infinity'::DOUBLE AND total > 0 THEN
           CASE WHEN bound = 'Infinity'::DOUBLE THEN finite_top WHEN cum = below THEN bound
                ELSE low + (bound - low) * (total * 0.95::DOUBLE - below) / (cum - below) END END, bound)
           FILTER (cum >= total * 0.95::DOUBLE) AS quantile
  FROM (SELECT *, coalesce(lag(cum) OVER w, 0.0::DOUBLE) AS below, coalesce(lag(bound) OVER w, least(0.0::DOUBLE, bound)) AS low,
               max(cum) OVER p AS total, max(bound) OVER p AS top, max(bound) FILTER (bound < 'Infinity'::DOUBLE) OVER p AS finite_top
        FROM (SELECT *, max(observed) OVER (PARTITION BY {keys} ORDER BY bound ROWS UNBOUNDED PRECEDING) AS cum FROM {source})
        WINDOW w AS (PARTITION BY {keys} ORDER BY bound), p AS (PARTITION BY {keys}))
  GROUP BY {keys}"""


def runs(source: str, key: str, condition: str, hold: int) -> str:
    return f"""
  SELECT {key}, min(ts) AS run_start, max(ts) AS run_end, CAST(sum(n) AS BIGINT) AS samples
  FROM (SELECT *, sum(CASE WHEN holds THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT {key}, ts, bool_and({condition}) AS holds, count(*) AS n FROM {source} GROUP BY {key}, ts))
  WHERE holds GROUP BY {key}, island
  HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= {hold * 1_000_000}"""


CTE["run"] = """
  SELECT o_orderpriority AS op_name, CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'success' END AS status,
         CAST(CAST(floor(o_totalprice) AS BIGINT) % 120000 AS DOUBLE) AS duration_ms
  FROM orders"""
CTE["run_bucket"] = (
    "SELECT op_name, bound, CAST(count(*) FILTER (duration_ms / 1000 <= bound) AS DOUBLE) AS observed FROM run, (VALUES "
    + ", ".join(f"({bound}::DOUBLE)" for bound in RUN_BOUNDS)
    + ", ('Infinity'::DOUBLE)) AS b(bound) GROUP BY op_name, bound"
)
CTE["run_p95"] = quantile("run_bucket", "op_name")

EXPORT_SOURCES = {
    "platform_environment": "env", "platform_filter": "fil", "platform_dashboard_activity": "act",
    "platform_growth_segment": "(SELECT *, CAST(hundredths AS DECIMAL(6,0)) * 0.01 AS percentage FROM grow)",
    "platform_campaign": "camp", "platform_subscriber": "sub", "platform_subscriber_segment": "seg", "platform_filter_assignment": "fa",
    "platform_analytics_pipeline": "pipe", "platform_analytics_signal": "sig", "platform_campaign_analytics": "ca",
    "platform_engagement_analytics": "(SELECT *, CAST(substr(page_url, 3) AS BIGINT) + 1 AS display_order FROM ea)",
    "platform_daily_performance": "dp",
}


def export_section(order: int, spec) -> str:
    fields = [field for field in spec.schema.fields if field.name not in seed.UNEXPORTED.get(spec.name, ())]
    values = []
    for field in fields:
        kind = field.dataType.typeName()
        if kind in ("integer", "long", "decimal"):
            values.append(f"coalesce(CAST({field.name} AS VARCHAR), '')")
        elif kind == "timestamp":
            values.append(quoted(f"CAST({field.name} AS VARCHAR) || '+00'"))
        elif kind == "boolean":
            values.append(f"CASE WHEN {field.name} THEN '''t''' ELSE '''f''' END")
        else:
            values.append(quoted(field.name))
    names = ", ".join(field.name for field in fields)
    ending = ");"
    if spec.name in seed.UPSERTED:
        changes = ", ".join(f"{f.name} = excluded.{f.name}" for f in fields if f.name not in spec.keys)
        ending = f") on conflict ({', '.join(spec.keys)}) do update set {changes};"
    body = " || ', ' || ".join(values)
    return (
        f"SELECT CAST({order} AS BIGINT) AS section_order, {text(f'insert into analytics.{spec.name} ({names}) values (')} || {body} || {text(ending)} "
        f"AS sql_text FROM {EXPORT_SOURCES[spec.name]}"
    )


ORACLE: dict[str, str] = {}


def define(name: str, select: str, **local: str) -> None:
    """Register a query with the shared parts it uses, in order of their use."""
    ordered: list[str] = []
    opened: set[str] = set()
    parts = {**CTE, **local}

    def visit(body: str) -> None:
        for word in sorted(set(re.findall(r"\b[a-z_0-9]+\b", re.sub(r"'[^']*'", "", body)))):
            if word in parts and word not in opened and re.search(rf"(FROM|JOIN|,)\s+{word}\b", body):
                opened.add(word)
                visit(parts[word])
                ordered.append(word)

    visit(select)
    heads = ",\n".join(f"{part} AS ({parts[part]})" for part in ordered)
    ORACLE[name] = (f"WITH {heads}\n" if heads else "") + select


define("campaign_live_metrics", """
SELECT environment, campaign_id, delivered_recipients, open_recipients, click_recipients, bounce_recipients, open_t / 10.0 AS open_rate,
       click_t / 10.0 AS click_rate, deliver_h / 100.0 AS deliverability_rate, first_seen_at, last_seen_at, refreshed_at FROM livet""")
define("dashboard_metrics", "SELECT * FROM metric_card", figures=figures(SUBSCRIBERS_AT))
define("campaign_summary", "SELECT * FROM summary_card")
define("dashboard_bars", "SELECT * FROM bar", bar=bars(EVENTS_AT))
define("last_sync", "SELECT * FROM synced")
define("subscriber_assignments", "SELECT * FROM assigned", assigned=assigned("|"))
define("bootstrap_sections", "SELECT * FROM sections", figures=figures(LABELS_AT), bar=bars(LABELS_AT), assigned=assigned(","))
def packed(**fields: str) -> str:
    return "struct_pack(" + ", ".join(f'"{name}" := {value}' for name, value in fields.items()) + ")"


def listed(rows: str, **fields: str) -> str:
    """Entries of one tenant's list in order; a tenant without entries has an empty list."""
    return f"coalesce((SELECT list({packed(**fields)} ORDER BY r.display_order) FROM {rows} r WHERE r.environment = env.environment), [])"


def split(text_list: str) -> str:
    return f"CASE WHEN {text_list} = '' THEN [] ELSE string_split({text_list}, '|') END"


def same(*names: str) -> dict[str, str]:
    return {name: f"r.{name}" for name in names}


DOCUMENT = {
    "brand": packed(
        name="brand_name", tagline="brand_tagline", heroTitle="hero_title", heroAccent="hero_accent", heroNote="hero_note",
        lastSync=f"(SELECT 'Last analytics sync: ' || lower({relative('synced_at', LABELS_AT)}) FROM synced s WHERE s.environment = env.environment)", searchPlaceholder="search_placeholder",
    ),
    "session": packed(label="session_label", node="session_node", status="session_status"),
    "dashboard": packed(
        metrics=listed("metric_card", **same("id", "label", "value", "delta", "accent", "icon", "detail")),
        performance=packed(title="'Campaign Performance'", modes="['Daily', 'Weekly']", activeMode="'Daily'", bars=listed("bar", **same("label", "value", "height", "emphasis"))),
        activities=listed("act", id="r.activity_id", title="r.title", description="r.description", at=relative("r.occurred_at", LABELS_AT), tone="r.tone"),
        segments=listed("grow", id="r.segment_id", label="r.label", value=tenths("(r.hundredths + 5) // 10") + " || '%'"),
        securityCard=packed(title="security_title", status="security_status", description="security_description"),
        billingCard=packed(eyebrow="billing_eyebrow", title="billing_title", date="billing_date", action="billing_action"),
    ),
    "campaigns": packed(
        headline="campaigns_headline", description="campaigns_description", stats=listed("summary_card", **same("id", "label", "value", "detail", "tone", "progress")),
        items=listed(
            "card", id="r.campaign_id", title="r.title", summary="r.summary", status="r.status", audience=grouped("r.audience_count"), audienceLabel="r.audience_label",
            openRate="r.open_rate", clickRate="r.click_rate", actionLabel="r.action_label", tone="r.tone",
        ),
    ),
    "subscribers": packed(
        headline="subscribers_headline", description="subscribers_description",
        filters="coalesce((SELECT list(r.filter_label ORDER BY r.display_order) FROM fil r WHERE r.environment = env.environment), [])",
        networkSize=grouped("(SELECT nullif(count(*), 0) FROM sub s WHERE s.environment = env.environment)"),
        items=listed(
            "featured", id="r.subscriber_id", name="r.name", email="r.email", securityStatus="r.security_status", assignedSegments=split("r.assigned_segments"),
            filterTags=split("r.filter_tags"), lastInteraction=relative("r.last_interaction_at", LABELS_AT), tone="r.tone",
        ),
    ),
    "analytics": packed(
        headline="analytics_headline", description="analytics_description", pipelines=listed("pipe", id="r.pipeline_id", title="r.title", description="r.description", status="r.status"),
        signals=listed(
            "sig", id="r.signal_id", title="r.title", description="r.description", action="r.action", eventKind="r.event_kind", subjectType="r.subject_type", subjectId="r.subject_id",
        ),
    ),
}
define(
    "platform_document",
    "SELECT environment, " + ", ".join(f"CAST(to_json({value}) AS VARCHAR) AS {name}" for name, value in DOCUMENT.items()) + " FROM env WHERE environment IN ('env1', 'env2')",
    figures=figures(LABELS_AT), bar=bars(LABELS_AT), assigned=assigned("|"),
    featured="SELECT * FROM sub JOIN assigned USING (environment, subscriber_id) WHERE is_featured",
    card=f"""SELECT environment, display_order, campaign_id, title, summary, status, audience_count, audience_label, action_label, tone,
         CASE WHEN status = 'Sent' THEN coalesce({tenths('open_t')} || '%', '--') ELSE '--' END AS open_rate,
         CASE WHEN status = 'Sent' THEN coalesce({tenths('click_t')} || '%', '--') ELSE '--' END AS click_rate
  FROM camp LEFT JOIN livet USING (environment, campaign_id)""",
)
define("serving_totals", "SELECT 'Real-time Analytics' AS headline, description FROM serving_text")
define("bootstrap_overlay", f"""
SELECT environment, page, brand_name, 'Last analytics sync: ' || lower({relative('synced_at', LABELS_AT)}) AS sync_label,
       'Real-time Analytics' AS analytics_headline, (SELECT description FROM serving_text) AS analytics_description,
       {grouped('network')} AS network_size, coalesce(c.items, 0) AS campaign_items, coalesce(s.items, 0) AS subscriber_items,
       coalesce(c.ids, '') AS campaign_ids, CASE WHEN page = 0 THEN labels ELSE '' END AS bar_labels
FROM (SELECT environment, CAST(0 AS BIGINT) AS page FROM env UNION SELECT environment, page FROM camp_page UNION SELECT environment, page FROM sub_page
      UNION SELECT environment, page FROM grow_page)
JOIN env USING (environment) JOIN synced USING (environment)
JOIN (SELECT environment, string_agg(label, ',' ORDER BY display_order) AS labels FROM bar GROUP BY environment) USING (environment)
LEFT JOIN (SELECT environment, count(*) AS network FROM sub GROUP BY environment) USING (environment)
LEFT JOIN camp_page c USING (environment, page) LEFT JOIN sub_page s USING (environment, page)""", bar=bars(LABELS_AT))

define("stg_email_events", """
SELECT md5(environment || ':' || campaign_id) AS event_id, campaign_id, CAST(NULL AS VARCHAR) AS recipient_id, 'consolidated' AS event_type,
       last_seen_at AS occurred_at, '{"environment":"' || environment || '","delivered_events":' || delivered_recipients || ',"open_events":'
       || open_recipients || ',"click_events":' || click_recipients || ',"bounce_events":' || bounce_recipients
       || ',"source":"platform_campaign_analytics"}' AS payload FROM ca""")
define("stg_analytics_events", """
SELECT md5(environment || ':' || page_url || ':' || event_name) AS event_id, CAST(NULL AS VARCHAR) AS session_id, CAST(NULL AS VARCHAR) AS user_id,
       event_name, page_url, last_seen_at AS occurred_at, '{"environment":"' || environment || '","event_count":' || event_count
       || ',"unique_users":' || unique_users || ',"source":"platform_engagement_analytics"}' AS payload FROM ea""")
define("stg_third_party_records", "SELECT record_id, provider, account_id, collected_at, payload FROM part_rec")
MART_CAMPAIGN = "SELECT campaign_id, delivered_recipients AS delivered_events, open_recipients AS open_events, click_recipients AS click_events, "
define("mart_campaign_performance", MART_CAMPAIGN + "first_seen_at, last_seen_at FROM ca")
define("mart_product_engagement", "SELECT page_url, event_name, event_count, unique_users, first_seen_at, last_seen_at FROM ea")
SECONDS = "date_trunc('second', first_seen_at) AS first_seen_at, date_trunc('second', last_seen_at) AS last_seen_at"
define("publish_campaign_performance", MART_CAMPAIGN + f"{SECONDS} FROM ca")
define("publish_product_engagement", f"SELECT page_url, event_name, event_count, unique_users, {SECONDS} FROM ea")
define("consolidate_campaign", "SELECT * FROM ca")
define("consolidate_engagement", "SELECT * FROM ea")
define("consolidate_daily", "SELECT environment, CAST(bucket_date AS VARCHAR) AS bucket_date, event_count, refreshed_at FROM dp")
define("model_views", """
SELECT 'stg_email_events' AS dataset, count(*) AS rows FROM ca UNION ALL SELECT 'stg_analytics_events', count(*) FROM ea
UNION ALL SELECT 'stg_third_party_records', count(*) FROM part_rec""")

define("parse_payload", "SELECT * FROM parsed")
define("parse_payload_event_type", parse("et"))
define("normalize_events", """
SELECT CASE WHEN n % 50 = 13 THEN md5(doc) ELSE event_id END AS event_id, CASE WHEN n % 4 <> 0 THEN event_name END AS event_name, CASE WHEN n % 4 <> 3 THEN campaign_id END AS campaign_id,
       user_id, page_url, seen AS occurred_at, doc AS payload, CAST(CAST(seen AS DATE) AS VARCHAR) AS event_date FROM sorted_text""")
define("raw_payload_landing", "SELECT payload FROM raw")
define("trace_lookup_payload", "SELECT payload FROM raw WHERE contains(payload, '\"k\":42}')")
define("trace_lookup_events", "SELECT * FROM parsed WHERE campaign_id = 'cmp-7' OR contains(payload, 'cmp-7')")
define("trace_gap", "SELECT event_id, environment FROM ev WHERE n % 50 IN (7, 13)")
define("event_publish_frame", """
SELECT 'email_events_raw' AS topic, campaign_id AS key, '{"event_id":"' || event_id || '","campaign_id":"' || campaign_id || '","recipient_id":"'
       || recipient_id || '","event_type":"' || event_name || '","occurred_at":"' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%SZ') || '","payload":{"k":'
       || k || '},"correlation_id":"' || header_value || '"}' AS value, 'x-correlation-id' AS header_key, header_value FROM sent
UNION ALL
SELECT 'analytics_events_raw', user_id, '{"event_id":"' || event_id || '","session_id":null,"user_id":"' || user_id || '","event_name":"' || event_name
       || '","page_url":"' || page_url || '","occurred_at":"' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%SZ') || '","payload":{"k":' || k
       || '},"correlation_id":"' || header_value || '"}', 'x-correlation-id', header_value FROM sent""",
       sent="SELECT *, 'corr-' || substr(md5(event_id), 1, 12) AS header_value FROM ev")

define("object_index_new", f"""
SELECT 'bronze/' || topic || '/captured_at=' || captured || '/' || page_id || '.json' AS object_key, md5(html) AS etag, topic AS source_topic,
       make_timestamp(captured * 1000000) AS last_modified, {EVENTS_AT} AS processed_at, '{EVENTS_AS_OF[:10]}' AS processed_date, strlen(html) AS size
FROM (SELECT *, page_id + 1704067200 AS captured, CASE WHEN page_id % 2 = 0 THEN 'email_events_raw' ELSE 'analytics_events_raw' END AS topic FROM pages)
WHERE page_id % 7 <> 0 AND captured % 3 <> 0""")
define("bronze_index_join", "SELECT topic AS source_topic, count(*) AS rows, CAST(sum(length(payload)) AS BIGINT) AS characters FROM raw GROUP BY topic")
define("file_discovery", "SELECT topic AS source_topic, count(*) AS rows FROM raw GROUP BY topic")
define("snapshot_append", """
SELECT record_id, provider, nullif(account_id, '') AS account_id, collected_at, TIMESTAMP '2024-02-01 02:00:00' AS captured_at,
       '2024-02-01' AS captured_date, 'lakehouse/ingress/third_party/captured_at=20240201T020000Z/snapshot.json' AS object_key, payload FROM part_rec""")
define("insert_absent", """
SELECT * FROM known_rec UNION ALL
SELECT record_id, provider, account_id, collected_at, payload
FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY collected_at) AS position FROM part_rec)
WHERE position = 1 AND record_id NOT IN (SELECT record_id FROM known_rec)""")

define("upsert_keyed", """
SELECT l.environment, l.campaign_id, l.delivered_recipients, l.open_recipients, l.click_recipients, l.bounce_recipients, e.first_seen_at,
       l.last_seen_at, l.refreshed_at FROM ca l LEFT JOIN early e ON e.environment = l.environment AND e.campaign_id = l.campaign_id""",
       early=campaign_counts("(SELECT * FROM ev WHERE occurred_at < TIMESTAMP '2024-01-20')", "TIMESTAMP '2024-01-20'"))
define("update_must_match", """
SELECT environment, campaign_id, CASE WHEN cid IS NULL THEN status ELSE 'Scheduled' END AS status,
       CASE WHEN cid IS NULL THEN summary ELSE 'Test send queued just now' END AS summary,
       CASE WHEN cid IS NULL THEN action_label ELSE 'Inspect performance' END AS action_label, CASE WHEN cid IS NULL THEN tone ELSE 'primary' END AS tone,
       true AS matched
FROM camp LEFT JOIN asked ON asked.env2 = camp.environment AND asked.cid = camp.campaign_id
UNION ALL SELECT env2, cid, NULL, NULL, NULL, NULL, false FROM asked
WHERE NOT EXISTS (SELECT 1 FROM camp WHERE camp.environment = asked.env2 AND camp.campaign_id = asked.cid)""",
       asked="SELECT DISTINCT environment AS env2, subject_id AS cid FROM cmd WHERE action = 'launch-test-send'")
define("replace_children", """
SELECT seg.* FROM seg JOIN sub USING (environment, subscriber_id) WHERE NOT is_featured
UNION ALL SELECT environment, subscriber_id, filter_label, 1 FROM fa JOIN sub USING (environment, subscriber_id) WHERE is_featured""")
ORACLE["replace_children"] = ORACLE["replace_children"].replace("SELECT seg.*", "SELECT seg.environment, seg.subscriber_id, seg.segment_label, seg.display_order")
define("env_reload", f"""
SELECT environment, CAST(bucket_date AS VARCHAR) AS bucket_date, event_count, refreshed_at FROM dp WHERE environment <> 'env1'
UNION ALL SELECT environment, CAST(CAST(occurred_at AS DATE) AS VARCHAR), count(*), {EVENTS_AT} FROM ev
WHERE environment = 'env1' AND event_name = 'purchase' GROUP BY environment, CAST(occurred_at AS DATE)""")
define("row_audit", f"""
SELECT dataset, rows, 'run-1' AS run_id, {EVENTS_AT} AS recorded_at FROM (
  SELECT 'raw_third_party_records' AS dataset, count(*) AS rows FROM part_rec UNION ALL SELECT 'campaign_performance', count(*) FROM ca
  UNION ALL SELECT 'product_engagement', count(*) FROM ea UNION ALL SELECT 'raw_events', count(*) FROM ev)""")
STALE = {"platform_campaign_analytics": ("bounce_recipients", "open_recipients")}
define("schema_drift", "SELECT table_name, column_name, rows FROM (VALUES "
       + ", ".join(f"('{t}', '{c}')" for t, columns in REQUIRED_COLUMNS.items() for c in columns if c in STALE.get(t, ()))
       + ") AS v(table_name, column_name), (SELECT count(*) AS rows FROM ca) AS counted")
define("display_order_next", """
SELECT environment, filter_label, row_number() OVER (PARTITION BY environment ORDER BY seen, filter_label) + coalesce(last_order, 0) AS display_order
FROM (SELECT environment, user_id AS filter_label, min(occurred_at) AS seen FROM ev GROUP BY environment, user_id)
LEFT JOIN (SELECT environment, max(display_order) AS last_order FROM fil GROUP BY environment) USING (environment)""")
define("campaign_search", "SELECT environment, campaign_id, title, summary FROM camp WHERE contains(lower(title || ' ' || summary || ' ' || audience_label), 'ring brand#1')")
define("subscriber_search", """
SELECT environment, subscriber_id, name, filter_tags FROM sub JOIN assigned USING (environment, subscriber_id)
WHERE contains(lower(name || ' ' || email), '#0000000') AND list_contains(string_split(lower(filter_tags), '|'), 'p')""", assigned=assigned("|"))

define("command_validate", """
SELECT command_id, CASE WHEN trim(surface) = '' THEN 'surface is required' WHEN trim(action) = '' THEN 'action is required' ELSE 'ok' END AS reason FROM cmd""")
define("command_normalize", "SELECT command_id, session_id, user_id, route, event_kind, campaign_id, subject_id, metadata FROM norm")
define("command_fanout", f"""
SELECT command_id, 'analytics' AS channel, md5(command_id || ':analytics') AS event_id, session_id, user_id, 'campaign-row.' || {slug('action')} AS event_name,
       {PAGE} AS page_url, CAST(NULL AS VARCHAR) AS campaign_id, CAST(NULL AS VARCHAR) AS recipient_id, CAST(NULL AS VARCHAR) AS event_type
FROM norm WHERE {TO_ANALYTICS}
UNION ALL
SELECT command_id, 'email', md5(command_id || ':email'), NULL, NULL, NULL, NULL,
       CASE WHEN trim(campaign_id) <> '' THEN campaign_id WHEN trim(subject_id) <> '' THEN subject_id ELSE 'platform-ui' END, recipient_id,
       'ui_' || {slug('action')}
FROM norm WHERE {TO_EMAIL}""")
define("command_apply_campaign", """
SELECT t.environment, t.cid AS campaign_id, CASE WHEN first_brief IS NULL THEN title ELSE 'Brief ' || k END AS title,
       CASE WHEN scheduled THEN 'Test send queued just now' WHEN first_brief IS NULL THEN summary ELSE 'Created from the operator console just now' END AS summary,
       CASE WHEN scheduled THEN 'Scheduled' WHEN first_brief IS NULL THEN status ELSE 'Draft' END AS status,
       CASE WHEN first_brief IS NULL THEN audience_count ELSE k * 10 END AS audience_count,
       CASE WHEN first_brief IS NULL THEN audience_label ELSE 'Curated audience pending review' END AS audience_label,
       CASE WHEN scheduled THEN 'Inspect performance' WHEN first_brief IS NULL THEN action_label ELSE 'Launch test send' END AS action_label,
       CASE WHEN scheduled THEN 'primary' WHEN first_brief IS NULL THEN tone ELSE 'tertiary' END AS tone,
       coalesce(c.display_order, top + row_number() OVER (PARTITION BY t.environment, c.display_order IS NULL ORDER BY first_brief)) AS display_order
FROM touched t LEFT JOIN camp c ON c.environment = t.environment AND c.campaign_id = t.cid
LEFT JOIN (SELECT environment, max(display_order) AS top FROM camp GROUP BY environment) m ON m.environment = t.environment""")
define("command_apply_schedule", "SELECT command_id, cid AS campaign_id, 'campaign was not found' AS reason FROM judged WHERE NOT known")
define("command_new_analytics", """
SELECT environment, cid AS campaign_id, 0::BIGINT AS delivered_recipients, 0::BIGINT AS open_recipients, 0::BIGINT AS click_recipients, 0::BIGINT AS bounce_recipients,
       CAST(NULL AS TIMESTAMP) AS first_seen_at, CAST(NULL AS TIMESTAMP) AS last_seen_at, first_at AS refreshed_at
FROM briefs WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ca.environment = briefs.environment AND ca.campaign_id = briefs.cid)""")
define("command_apply_subscriber", """
SELECT a.environment, a.sid AS subscriber_id, 'Curated Contact' AS name, 'Member.' || u || '@mail.org' AS email, 'Encrypted' AS security_status,
       coalesce(s.created_at, first_at) AS created_at, last_at AS last_interaction_at, 'primary' AS tone, true AS is_featured,
       coalesce(s.display_order, top + row_number() OVER (PARTITION BY a.environment, s.display_order IS NULL ORDER BY first_moment)) AS display_order
FROM latest_add a LEFT JOIN sub s ON s.environment = a.environment AND s.subscriber_id = a.sid
LEFT JOIN (SELECT environment, max(display_order) AS top FROM sub GROUP BY environment) m ON m.environment = a.environment""")
define("command_apply_labels", """
SELECT 'segment' AS kind, environment, sid AS owner, 'S' || k % 5 AS label, 1 AS position FROM latest_add
UNION ALL SELECT 'segment', environment, sid, 'Core', 2 FROM latest_add
UNION ALL SELECT 'tag', environment, sid, 'Tag ' || k % 7, NULL FROM latest_add
UNION ALL SELECT 'filter', environment, NULL, label, top + row_number() OVER (PARTITION BY environment ORDER BY m)
FROM (SELECT environment, 'Tag ' || k % 7 AS label, min(moment) AS m FROM adds GROUP BY ALL)
LEFT JOIN (SELECT environment, max(display_order) AS top FROM fil GROUP BY environment) USING (environment)""")
define("command_result", f"""
SELECT command_id, true AS accepted, action IN ('create-brief', 'launch-test-send', 'add-subscriber') AS stored, session_id,
       'trace-' || substr(md5(command_id), 1, 12) AS correlation_id, campaign_id,
       concat_ws('|', CASE WHEN {TO_ANALYTICS} THEN 'analytics' END, CASE WHEN {TO_EMAIL} THEN 'email' END) AS published,
       strftime(occurred_at, '%Y-%m-%dT%H:%M:%SZ') AS occurred_at
FROM norm WHERE command_id NOT IN (SELECT command_id FROM judged WHERE NOT known)""")

PADDED = "CASE WHEN length(CAST(n AS VARCHAR)) >= 5 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 5, ' ') END"
define("seed_subscribers", f"""
SELECT 'local' AS environment, 'seed-member-' || {PADDED} AS subscriber_id, 'Portfolio Member ' || n AS name,
       'member' || {PADDED} || '{fx.SEED_EMAIL_DOMAIN}' AS email, CASE WHEN n % 31 = 0 THEN 'Review' ELSE 'Encrypted' END AS security_status,
       {LABELS_AT} - to_days(CAST(CASE WHEN n <= 1424 THEN n % 10 ELSE 35 + n % 560 END AS INTEGER)) AS created_at,
       {LABELS_AT} - to_hours(6 + n % 480) AS last_interaction_at, CASE WHEN n % 31 = 0 THEN 'tertiary' ELSE 'primary' END AS tone,
       false AS is_featured, 1000 + n AS display_order
FROM (SELECT c_custkey + 1 AS n FROM customer)""")
FEATURED = ", ".join(
    f"('local', {text(p[0])}, {text(p[1])}, {text(p[2])}, {text(p[3])}, {text(p[6])}, true, {n})" for n, p in enumerate(seed.sv.FEATURED_SUBSCRIBERS, start=1)
)
define("seed_load", f"""
SELECT environment, subscriber_id, name, email, security_status, tone, is_featured, display_order FROM sub
UNION ALL SELECT 'local', 'seed-member-' || {PADDED}, 'Portfolio Member ' || n, 'member' || {PADDED} || '{fx.SEED_EMAIL_DOMAIN}',
  CASE WHEN n % 31 = 0 THEN 'Review' ELSE 'Encrypted' END, CASE WHEN n % 31 = 0 THEN 'tertiary' ELSE 'primary' END, false, 1000 + n
FROM (SELECT unnest(range(1, (SELECT count(*) FROM customer) + 1)) AS n)
UNION ALL SELECT * FROM (VALUES {FEATURED})""")
define("seed_export", "\nUNION ALL ".join(export_section(n, spec) for n, spec in enumerate(APP_TABLES, start=1)))
define("format_functions", f"""
SELECT o_orderkey, {grouped('scaled')} AS grouped, {compact('scaled')} AS compact, {tenths(half_up('amount*1000', '500000'))} || '%' AS percent,
       {relative('seen', LABELS_AT)} AS relative, 'Last analytics sync: ' || lower({relative('seen', LABELS_AT)}) AS sync_label,
       strftime(o_orderdate, '%a') AS day, date_trunc('month', o_orderdate) AS month, {quoted("'it''s ' || o_orderpriority")} AS quoted
FROM (SELECT *, amount * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100 END AS scaled, o_orderdate + to_minutes(o_orderkey % 1440) AS seen
      FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS amount FROM orders))""")

TRANSITIONS = """
SELECT service, method, route, status, ts, request_id, CAST(NULL AS BIGINT) AS previous_status FROM log WHERE status >= 500
UNION ALL SELECT * FROM (SELECT *, lag(status) OVER (PARTITION BY service, route ORDER BY ts, request_id) AS previous_status FROM log WHERE status < 500)
WHERE previous_status <> status"""
define("status_transitions", TRANSITIONS)
define("stream_transitions", TRANSITIONS)
define("counter_increase", "SELECT service, status, window_start, sum(step) AS increase FROM steps GROUP BY service, status, window_start")
define("counter_rate", f"SELECT service, window_start, sum(step) / {RANGE} AS rate FROM steps GROUP BY service, window_start")
define("error_ratio", f"""
SELECT service, window_start, (coalesce(sum(step) FILTER (regexp_matches(status, '^5..$')), 0) / {RANGE}) / greatest(sum(step) / {RANGE}, 0.001::DOUBLE) AS error_ratio
FROM steps GROUP BY service, window_start""")
define("histogram_p95", quantile("bucket_rate", "service, window_start"))
define("held_condition", runs("log", "service", "status >= 400", 600))
define("service_down", runs("(SELECT 'svc' || (u % 3) AS job, occurred_at AS ts, event_name IN ('error', 'click') AS down FROM ev WHERE u % 3 <> 1)", "job", "down", 120))
define("service_health", """
SELECT job, arg_max(value, ts) AS value, max(ts) AS ts
FROM (SELECT 'svc' || (u % 3) AS job, occurred_at AS ts, CASE WHEN event_name IN ('error', 'click') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS value FROM ev)
WHERE job IN ('svc0', 'svc2') GROUP BY job""")
define("gauge_latest", "SELECT service, route, arg_max(CAST(request_id % 1000 AS DOUBLE), ts) AS value, max(ts) AS ts FROM log GROUP BY service, route")
define("run_rollup", """
SELECT op_name, count(*) AS runs, count(*) FILTER (status = 'error') AS errors, sum(duration_ms) AS total_ms, max(duration_ms) AS longest_ms,
       any_value(p.quantile) AS p95_seconds FROM run JOIN run_p95 p USING (op_name) GROUP BY op_name""")

define("subscribed_messages", """
SELECT 'email_events_raw' AS topic, campaign_id AS key, event_id, 'corr-' || substr(md5(event_id), 1, 12) AS correlation_id FROM ev
UNION ALL SELECT 'analytics_events_raw', user_id, event_id, 'corr-' || substr(md5(event_id), 1, 12) FROM ev""")
define("hourly_index", "SELECT topic AS source_topic, count(*) AS rows, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS unhashed FROM raw GROUP BY topic")
define("daily_job", """
SELECT dataset, rows, run_id, TIMESTAMP '2024-02-01 02:00:00' AS recorded_at FROM (
  SELECT * FROM (SELECT 'raw_third_party_records' AS dataset, count(DISTINCT record_id) AS rows FROM part_rec UNION ALL SELECT 'campaign_performance', count(*) FROM ca
    UNION ALL SELECT 'product_engagement', count(*) FROM ea), (SELECT unnest(['run-1', 'run-2']) AS run_id)
  UNION ALL SELECT 'third_party_snapshots', count(*), 'log' FROM part_rec)""")
define("snapshot_arrays", "SELECT record_id, provider, account_id, collected_at, payload FROM part_rec")
ORACLE["upsert_stored"] = ORACLE["upsert_keyed"]
define("stored_children", """
SELECT CASE WHEN environment = 'env1' THEN 'x=y%z' ELSE environment END AS environment, subscriber_id, segment_label, display_order
FROM replaced WHERE environment <> 'env0'""", replaced="""
SELECT seg.environment, seg.subscriber_id, seg.segment_label, seg.display_order FROM seg JOIN sub USING (environment, subscriber_id) WHERE NOT is_featured
UNION ALL SELECT environment, subscriber_id, filter_label, 1 FROM fa JOIN sub USING (environment, subscriber_id) WHERE is_featured""")
define("stream_parse", "SELECT * FROM parsed")
define("stream_and_backfill", "SELECT * FROM parsed")
define("stream_dual_sink", "SELECT 'landing' AS sink, payload FROM raw UNION ALL SELECT 'bronze', payload FROM raw")
define("stream_dedup", "SELECT event_id, event_name, occurred_at FROM ev")
define("stream_daily", "SELECT environment, CAST(bucket_date AS VARCHAR) AS bucket_date, event_count, refreshed_at FROM dp")
