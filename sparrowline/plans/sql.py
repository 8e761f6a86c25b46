"""Shared parts of the SQL that the queries are checked against."""

IMP = """e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
buy AS (SELECT *, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS conversion_id, first_value(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS) OVER w AS conversion_ts
  FROM e WINDOW w AS (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
imp AS (SELECT sha256(CAST(event_id AS VARCHAR)) AS impression_id, ts AS event_ts, CAST(k AS VARCHAR) AS user_id, user_id AS campaign_id, event_type = 'click' AS is_click, conversion_id, conversion_ts, k % 3 = 0 AS is_attributed,
  CAST(value AS DECIMAL(18,8)) AS cost, CASE WHEN k % 10 = 0 THEN 'unknown' ELSE CAST(k % 6 AS VARCHAR) END AS seg FROM buy WHERE event_type NOT IN ('purchase', 'signup'))"""

CHG = """chg AS (SELECT user_id AS campaign_id, user_id % 97 + 1000 AS advertiser_id, (['retail','travel','finance'])[k % 3 + 1] AS campaign_vertical, (['low','medium','high','enterprise'])[k % 4 + 1] AS budget_tier,
  (['manual_cpc','target_cpa'])[k % 2 + 1] AS bid_strategy, CAST(value AS DECIMAL(12,2)) AS daily_budget_usd, ts AS changed_at FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type = 'signup'),
dimc AS (SELECT md5(CAST(campaign_id AS VARCHAR) || '-' || strftime(changed_at, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(changed_at) % 1000000 = 0 THEN '' ELSE rtrim(strftime(changed_at, '.%f'), '0') END) AS campaign_sk, *,
  CASE WHEN row_number() OVER w = 1 THEN TIMESTAMP '1900-01-01' ELSE changed_at END AS valid_from, coalesce(lead(changed_at) OVER w, TIMESTAMP '9999-12-31') AS valid_to, lead(changed_at) OVER w IS NULL AS is_current, row_number() OVER w AS version_number
  FROM chg WINDOW w AS (PARTITION BY campaign_id ORDER BY changed_at))"""

FCT = f"""{IMP}, {CHG},
fct AS (SELECT i.*, CAST(strftime(event_ts, '%Y%m%d') AS INTEGER) AS date_key, coalesce(c.campaign_sk, '-1') AS campaign_sk, CASE WHEN seg = 'unknown' THEN md5_u ELSE md5(seg) END AS device_key
  FROM (SELECT *, '-1' AS md5_u FROM imp) i LEFT JOIN dimc c ON i.campaign_id = c.campaign_id AND i.event_ts >= c.valid_from AND i.event_ts < c.valid_to)"""

CONV = f"""{FCT},
path AS (SELECT *, row_number() OVER (PARTITION BY conversion_id ORDER BY event_ts DESC, impression_id) AS tr, row_number() OVER (PARTITION BY conversion_id ORDER BY CASE WHEN is_click THEN 0 ELSE 1 END, event_ts DESC, impression_id) AS cr FROM fct WHERE conversion_id IS NOT NULL AND event_ts <= conversion_ts),
agg AS (SELECT conversion_id, max(conversion_ts) AS conversion_ts, min(user_id) AS user_id, count(*) AS path_impressions, count_if(is_click) AS path_clicks, bool_or(is_attributed) AS is_attributed_to_source, min(event_ts) AS ft, sum(cost) AS path_cost FROM path GROUP BY 1),
conv AS (SELECT a.conversion_id, a.conversion_ts, CAST(strftime(a.conversion_ts, '%Y%m%d') AS INTEGER) AS conversion_date_key, a.user_id, c.impression_id AS credited_impression_id, c.campaign_sk AS credited_campaign_sk, c.campaign_id AS credited_campaign_id, c.device_key AS credited_device_key,
  c.is_click AS credited_by_click, l.impression_id AS last_touch_impression_id, a.is_attributed_to_source, a.path_impressions, CAST(a.path_clicks AS BIGINT) AS path_clicks, CAST(a.path_cost AS DOUBLE) AS path_cost, CAST(epoch(a.conversion_ts) AS BIGINT) - CAST(epoch(a.ft) AS BIGINT) AS raw_seconds,
  date_diff('second', a.ft, a.conversion_ts) AS seconds_first_touch_to_conversion
  FROM agg a JOIN path c ON c.conversion_id = a.conversion_id AND c.cr = 1 JOIN path l ON l.conversion_id = a.conversion_id AND l.tr = 1)"""

MART = f"""{CONV},
dlv AS (SELECT campaign_id, date_key, count(*) AS impressions, count_if(is_click) AS clicks, sum(cost) AS spend, count(DISTINCT user_id) AS reached_users FROM fct GROUP BY 1, 2),
cv AS (SELECT credited_campaign_id AS campaign_id, conversion_date_key AS date_key, count(*) AS conversions, count_if(is_attributed_to_source) AS attributed_conversions FROM conv GROUP BY 1, 2),
x AS (SELECT coalesce(d.campaign_id, c.campaign_id) AS campaign_id, coalesce(d.date_key, c.date_key) AS date_key, coalesce(impressions, 0) AS impressions, coalesce(clicks, 0) AS clicks, coalesce(spend, 0) AS spend, coalesce(reached_users, 0) AS reached_users, coalesce(conversions, 0) AS conversions, coalesce(attributed_conversions, 0) AS attributed_conversions
  FROM dlv d FULL OUTER JOIN cv c ON d.campaign_id = c.campaign_id AND d.date_key = c.date_key),
mart AS (SELECT md5(CAST(x.campaign_id AS VARCHAR) || '-' || CAST(x.date_key AS VARCHAR)) AS campaign_day_id, x.date_key, d.day AS date_day, x.campaign_id, campaign_sk, advertiser_id, campaign_vertical, budget_tier, bid_strategy, impressions, clicks, conversions, attributed_conversions, reached_users, spend
  FROM x JOIN (SELECT CAST(range AS DATE) AS day FROM range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) d ON CAST(strftime(d.day, '%Y%m%d') AS INTEGER) = x.date_key
  LEFT JOIN dimc v ON v.campaign_id = x.campaign_id AND v.valid_from < d.day + INTERVAL 1 DAY AND v.valid_to >= d.day + INTERVAL 1 DAY)"""

CLEAN = """k0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS sec, event_type = 'purchase' AS buys FROM events),
raw AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN '3.5' ELSE CAST(sec AS VARCHAR) END AS r_ts, CASE WHEN event_id % 89 = 0 THEN 'abc' ELSE CAST(k AS VARCHAR) END AS r_uid, CASE WHEN event_id % 83 = 0 THEN '' ELSE ' ' || CAST(user_id AS VARCHAR) END AS r_campaign,
  CASE WHEN event_id % 79 = 0 THEN 'x' ELSE CAST(CAST(event_type = 'click' AS INTEGER) AS VARCHAR) END AS r_click, CASE WHEN event_id % 73 = 0 THEN '-0.5' ELSE CAST(CAST(value AS DECIMAL(18,8)) AS VARCHAR) END AS r_cost FROM k0),
cln AS (SELECT *, sha256(concat_ws(chr(1), r_ts, r_uid, r_campaign, CAST(CAST(buys AS INTEGER) AS VARCHAR), CASE WHEN buys THEN CAST(sec + 60 AS VARCHAR) ELSE '-1' END, CASE WHEN buys THEN CAST(event_id AS VARCHAR) ELSE '-1' END, CASE WHEN k % 3 = 0 THEN '1' ELSE '0' END, r_click, '-1', CAST(k % 4 - 1 AS VARCHAR), r_cost, '-1',
    CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE '-1' END, k % 6 || ' ', k % 7 || ' ', k % 8 || ' ', k % 9 || ' ', k % 10 || ' ', k % 11 || ' ', k % 12 || ' ', k % 13 || ' ', k % 14 || ' ')) AS impression_id,
  CASE WHEN event_id % 97 = 0 THEN 'bad_timestamp' WHEN event_id % 89 = 0 THEN 'bad_uid' WHEN event_id % 83 = 0 THEN 'bad_campaign' WHEN event_id % 79 = 0 THEN 'bad_flag' WHEN event_id % 73 = 0 THEN 'bad_cost' END AS reject_reason FROM raw)"""
