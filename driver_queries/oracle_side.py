"""SQL on the test tables for every registered query that SQL can express, written for DuckDB."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31'"


def dec(x: str, n: int) -> str:
    """Half away from zero, on the decimal reading of a double."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), {n}) AS DOUBLE)"


def exact(x: str, n: int) -> str:
    """Half to even, on the binary value."""
    return f"CAST(printf('%.{n}f', {x}) AS DOUBLE)"


def unit(p: str = "parameter", other: str = "'unknown'") -> str:
    return (f"CASE WHEN {p} IN ('pm25','pm10','no2','o3','co','so2') THEN 'µg/m³' WHEN {p} = 'temperature' THEN '°C' "
            f"WHEN {p} = 'humidity' THEN '%' WHEN {p} = 'wind_speed' THEN 'm/s' "
            f"WHEN {p} = 'precipitation' THEN 'mm' ELSE {other} END")


def flag(p: str = "parameter", v: str = "value") -> str:
    return f"""CASE WHEN {v} IS NULL THEN 'missing'
        WHEN {p} = 'pm25' AND {v} NOT BETWEEN 0 AND 500 OR {p} = 'pm10' AND {v} NOT BETWEEN 0 AND 600
          OR {p} = 'no2' AND {v} NOT BETWEEN 0 AND 400 OR {p} = 'temperature' AND {v} NOT BETWEEN -30 AND 50
          OR {p} = 'humidity' AND {v} NOT BETWEEN 0 AND 100 OR {p} = 'wind_speed' AND {v} NOT BETWEEN 0 AND 100
          OR {p} = 'precipitation' AND {v} NOT BETWEEN 0 AND 500 THEN 'suspect' ELSE 'valid' END"""


MEASURED = f"""measured AS (
  SELECT event_id, CAST(user_id % 25 AS VARCHAR) AS city_id,
         CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'pm10' WHEN 'purchase' THEN 'no2'
              WHEN 'error' THEN 'temperature' WHEN 'signup' THEN 'humidity' ELSE event_type END AS parameter,
         CASE WHEN value >= 0.5 THEN value END AS value, ts AS "timestamp"
  FROM events),
readings AS (SELECT *, {flag()} AS quality_flag FROM measured),
valid AS (SELECT * FROM readings WHERE quality_flag = 'valid'),
cities AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, r_name AS country,
         upper(substr(r_name, 1, 2)) AS country_code, r_name <> 'MIDDLE EAST' AS is_active
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

HOURLY = MEASURED + """,
hourly_raw AS (
  SELECT city_id, parameter, date_trunc('hour', "timestamp") AS "timestamp", avg(value) AS value
  FROM valid GROUP BY 1, 2, 3),
hourly AS (SELECT *, """ + flag() + """ AS quality_flag FROM hourly_raw),
hvalid AS (SELECT * FROM hourly WHERE quality_flag = 'valid')"""


def q(body: str, base: str = MEASURED) -> str:
    return f"WITH {base}{body}"


def buckets(interval: str, source: str = "valid", where: str = "\"timestamp\" >= TIMESTAMP '2024-01-01'") -> str:
    return f""", b AS (
      SELECT city_id, parameter, CAST(date_trunc('{interval}', "timestamp") AS TIMESTAMP) AS period,
             {dec('avg(value)', 4)} AS avg, {dec('min(value)', 4)} AS min, {dec('max(value)', 4)} AS max,
             count(*) AS reading_count
      FROM {source} WHERE {where} GROUP BY 1, 2, 3)"""


# Interval labels in reports.
LABELS = {"hour": "hourly", "day": "daily", "week": "weekly"}


def trend(interval: str) -> str:
    return q(buckets(interval) + f"""
    SELECT b.city_id, c.name AS city_name, parameter, {unit()} AS unit, '{LABELS[interval]}' AS "interval", 30 AS days, period,
           avg, min, max, reading_count,
           CAST(sum(reading_count) OVER (PARTITION BY b.city_id, parameter) AS BIGINT) AS total_readings
    FROM b JOIN cities c ON c.id = b.city_id WHERE c.is_active""")


def comparison(days: int, where: str) -> str:
    current, previous = f"TIMESTAMP '2024-01-31' - INTERVAL {days} DAY", f"TIMESTAMP '2024-01-31' - INTERVAL {2 * days} DAY"
    return f""", cur AS (
      SELECT v.city_id, v.parameter, c.name AS city_name, {dec('avg(value)', 4)} AS avg, {dec('min(value)', 4)} AS min,
             {dec('max(value)', 4)} AS max, count(*) AS reading_count
      FROM valid v JOIN cities c ON c.id = v.city_id WHERE "timestamp" >= {current} AND {where} GROUP BY 1, 2, 3),
    prev AS (
      SELECT city_id, parameter, {dec('avg(value)', 4)} AS avg FROM valid
      WHERE "timestamp" >= {previous} AND "timestamp" < {current} GROUP BY 1, 2),
    compared AS (
      SELECT cur.parameter, {unit('cur.parameter')} AS unit, {days} AS days, cur.city_id, city_name, cur.avg, min, max,
             reading_count, rank() OVER (PARTITION BY cur.parameter ORDER BY cur.avg) AS rank,
             CASE WHEN prev.avg > 0 THEN {dec('(cur.avg - prev.avg) / prev.avg * 100', 2)} END
               AS pct_change_vs_prev_period
      FROM cur LEFT JOIN prev ON prev.city_id = cur.city_id AND prev.parameter = cur.parameter)"""


def ranked(days: int, country: str | None, limit: int | None, least: int) -> str:
    shown = f"'{country}'" if country else "CAST(NULL AS VARCHAR)"
    narrowed = f"AND c.country_code = '{country}'" if country else ""
    cut = f"WHERE listed <= {limit}" if limit else ""
    return q(f""", a AS (
      SELECT v.parameter, c.id AS city_id, c.name AS city_name, avg(value) AS mean, max("timestamp") AS data_freshness,
             count(*) AS reading_count
      FROM valid v JOIN cities c ON c.id = v.city_id
      WHERE "timestamp" >= TIMESTAMP '2024-01-31' - INTERVAL {days} DAY AND c.is_active {narrowed}
      GROUP BY 1, 2, 3 HAVING count(*) >= {least}),
    r AS (SELECT *, rank() OVER (PARTITION BY parameter ORDER BY mean) AS rank,
                 row_number() OVER (PARTITION BY parameter ORDER BY mean, city_id) AS listed FROM a)
    SELECT parameter, {unit()} AS unit, {shown} AS country, {days} AS days, city_id, city_name,
           {dec('mean', 4)} AS avg_value, rank, data_freshness, reading_count FROM r {cut}""")


def rolled(source: str, since: str, frame: int = 168) -> str:
    return f""", rolled AS (
      SELECT city_id, parameter, "timestamp", value, avg(value) OVER w AS ra, stddev_samp(value) OVER w AS sd,
             count(*) OVER w AS n
      FROM {source} WHERE "timestamp" >= TIMESTAMP '{since}'
      WINDOW w AS (PARTITION BY city_id, parameter ORDER BY "timestamp" ROWS BETWEEN {frame} PRECEDING AND 1 PRECEDING))"""


def found(since: str, sensitivity: float, places: int = 4) -> str:
    return f""", found AS (
      SELECT city_id, parameter, "timestamp", value, {dec('ra', places)} AS rolling_avg,
             {dec('sd', places)} AS rolling_stddev, {dec('(value - ra) / sd', places)} AS z_score,
             abs((value - ra) / sd) AS size
      FROM rolled WHERE "timestamp" >= TIMESTAMP '{since}' AND n >= 24 AND sd > 0
        AND abs((value - ra) / sd) >= {sensitivity}),
    rated AS (
      SELECT *, CASE WHEN abs(z_score) >= 3.5 THEN 'high' WHEN abs(z_score) >= 2.5 THEN 'medium' ELSE 'low' END AS severity
      FROM found)"""


TOTALS = """, totals AS (
      SELECT city_id, parameter, count(*) FILTER (WHERE "timestamp" >= TIMESTAMP '2024-01-01') AS total_readings_analysed
      FROM valid WHERE "timestamp" >= TIMESTAMP '2023-12-25' GROUP BY 1, 2)"""

ANOMALIES = q(rolled("valid", "2023-12-25") + found("2024-01-01", 2.0) + TOTALS + f"""
    SELECT r.city_id, c.name AS city_name, r.parameter, {unit('r.parameter')} AS unit, CAST(2.0 AS DOUBLE) AS sensitivity,
           "timestamp", value, rolling_avg, rolling_stddev, z_score, severity, total_readings_analysed
    FROM rated r JOIN totals t ON t.city_id = r.city_id AND t.parameter = r.parameter
    JOIN cities c ON c.id = r.city_id WHERE c.is_active""")

SUMMARISED = rolled("valid WHERE parameter IN ('pm25','pm10','no2','o3')", "2023-12-25").replace(
    "'o3') WHERE", "'o3') AND") + found("2024-01-01", 2.0) + """, placed AS (
      SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY abs(z_score) DESC,
        list_position(['pm25','pm10','no2','o3'], parameter), size DESC, "timestamp") AS position FROM rated)"""


def matrix(source: str, pairs: str, days: int) -> str:
    """Guarded correlation of parameter pairs on equal timestamps."""
    return f""", pairs(param1, param2) AS (VALUES {pairs}),
    joined AS (
      SELECT a.city_id, p.param1, p.param2, a.value AS x, b.value AS y
      FROM pairs p JOIN {source} a ON a.parameter = p.param1
      JOIN {source} b ON b.parameter = p.param2 AND b.city_id = a.city_id AND b."timestamp" = a."timestamp"
      WHERE a."timestamp" >= TIMESTAMP '2024-01-31' - INTERVAL {days} DAY),
    measured_r AS (
      SELECT city_id, param1, param2, count(*) AS sample_size,
             CASE WHEN count(*) >= 2 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS r
      FROM joined GROUP BY 1, 2, 3)"""


def correlated(pairs: str) -> str:
    return q(matrix("hvalid", pairs, 30) + f""", rounded AS (
      SELECT c.id AS city_id, c.name AS city_name, p.param1, p.param2, 30 AS days, {dec('m.r', 6)} AS pearson_r,
             coalesce(sample_size, 0) AS sample_size
      FROM cities c JOIN pairs p ON TRUE
      LEFT JOIN measured_r m ON m.city_id = c.id AND m.param1 = p.param1 AND m.param2 = p.param2 WHERE c.is_active)
    SELECT *, CASE WHEN pearson_r IS NULL OR abs(pearson_r) < 0.1 THEN 'negligible' WHEN abs(pearson_r) < 0.3 THEN 'weak'
                   WHEN abs(pearson_r) < 0.7 THEN 'moderate' WHEN abs(pearson_r) < 0.9 THEN 'strong'
                   ELSE 'very_strong' END AS interpretation,
           CASE WHEN abs(pearson_r) >= 0.1 THEN CASE WHEN pearson_r > 0 THEN 'positive' ELSE 'negative' END END AS direction
    FROM rounded""", HOURLY)


_NAMES = sorted(["pm25", "pm10", "no2", "temperature", "humidity", "o3"])
_ALL_PAIRS = ", ".join(f"('{a}', '{b}')" for i, a in enumerate(_NAMES) for b in _NAMES[i + 1:])

STATISTICS = f""", stats AS (
      SELECT city_id, parameter,
             {dec("avg(value) FILTER (WHERE \"timestamp\" >= TIMESTAMP '2024-01-24')", 2)} AS avg,
             {dec("min(value) FILTER (WHERE \"timestamp\" >= TIMESTAMP '2024-01-24')", 2)} AS min,
             {dec("max(value) FILTER (WHERE \"timestamp\" >= TIMESTAMP '2024-01-24')", 2)} AS max,
             count(*) FILTER (WHERE "timestamp" >= TIMESTAMP '2024-01-24') AS reading_count,
             {dec("avg(value) FILTER (WHERE \"timestamp\" < TIMESTAMP '2024-01-24')", 2)} AS prev
      FROM hvalid WHERE "timestamp" >= TIMESTAMP '2024-01-17' GROUP BY 1, 2),
    moved AS (
      SELECT *, CASE WHEN prev > 0 THEN {exact('(avg - prev) / prev * 100', 1)} END AS pct FROM stats WHERE reading_count > 0)"""

TOP5 = rolled("hvalid", "2024-01-17") + found("2024-01-24", 2.0, 2) + """, top5 AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY size DESC, "timestamp", parameter)
                              AS position FROM rated) WHERE position <= 5)"""

QUALITY = """, quality AS (
      SELECT city_id, count(*) AS total_readings, count(*) FILTER (WHERE quality_flag = 'valid') AS valid_rows,
             count(*) FILTER (WHERE quality_flag = 'suspect') AS suspect,
             count(*) FILTER (WHERE quality_flag = 'missing') AS missing
      FROM {source} WHERE "timestamp" >= TIMESTAMP '2024-01-24' GROUP BY 1)"""


def corrections() -> str:
    return """, late AS (SELECT * FROM readings WHERE "timestamp" >= TIMESTAMP '2024-01-15'),
    arrived_raw AS (
      SELECT city_id, parameter, "timestamp", event_id AS ingest_seq, 'changed' AS unit,
             CASE WHEN parameter = 'pm10' THEN value + 1 WHEN parameter <> 'temperature' THEN value END AS value FROM late
      UNION ALL
      SELECT city_id, parameter, "timestamp", event_id + 1000000000000, """ + unit() + """, value * 2
      FROM late WHERE parameter = 'pm25'),
    arrived AS (SELECT *, """ + flag() + """ AS quality_flag FROM arrived_raw),
    last_arrived AS (
      SELECT * FROM arrived QUALIFY row_number() OVER (PARTITION BY city_id, parameter, "timestamp"
                                                       ORDER BY ingest_seq DESC) = 1),
    stored AS (SELECT *, """ + unit() + """ AS unit, "timestamp" + INTERVAL 5 MINUTE AS written FROM readings
               WHERE "timestamp" < TIMESTAMP '2024-01-20'),
    merged AS (
      SELECT coalesce(s.city_id, n.city_id) AS city_id, coalesce(s.parameter, n.parameter) AS parameter,
             coalesce(s."timestamp", n."timestamp") AS "timestamp", s.value AS old_value, n.value AS new_value,
             s.unit AS old_unit, n.unit AS new_unit, s.quality_flag AS old_flag, n.quality_flag AS new_flag, s.written,
             CASE WHEN s.city_id IS NULL THEN 'inserted' WHEN n.city_id IS NULL THEN 'kept'
                  WHEN s.value IS DISTINCT FROM n.value OR s.quality_flag <> n.quality_flag THEN 'updated'
                  ELSE 'unchanged' END AS action
      FROM stored s FULL JOIN last_arrived n
        ON s.city_id = n.city_id AND s.parameter = n.parameter AND s."timestamp" = n."timestamp"),
    applied AS (
      SELECT city_id, parameter, "timestamp", action, written,
             CASE WHEN action IN ('inserted', 'updated') THEN new_value ELSE old_value END AS value,
             CASE WHEN action IN ('inserted', 'updated') THEN new_unit ELSE old_unit END AS unit,
             CASE WHEN action IN ('inserted', 'updated') THEN new_flag ELSE old_flag END AS quality_flag
      FROM merged)"""


SLUG = ("trim(regexp_replace(regexp_replace(trim(regexp_replace(lower({0}), '[^a-z0-9\\s-]', '', 'g')), '\\s+', '-', 'g'), "
        "'-+', '-', 'g'), '-')")
LOOKUP = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"

SITES = f"""sites AS (
  SELECT {SLUG.format('c_name')} AS id, c_name AS name, r_name AS country, upper(substr(r_name, 1, 2)) AS country_code,
         c_acctbal / 200.0 AS latitude, c_nationkey * CAST(0.04 AS DOUBLE) AS longitude, 'UTC' AS timezone,
         c_mktsegment <> 'MACHINERY' AS is_active, TIMESTAMP '2024-01-01' AS created_at,
         TIMESTAMP '2024-01-01' AS updated_at, c_custkey, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CANDIDATES = SITES + """,
candidates AS (
  SELECT s_suppkey AS request_seq, s_name AS name, s_acctbal / 100.0 AS latitude, s_nationkey AS k FROM supplier
  UNION ALL SELECT s_suppkey + 1000000000000, lower(s_name), s_acctbal / 200.0, s_nationkey FROM supplier
  UNION ALL SELECT c_custkey + 2000000000000, upper(c_name), c_acctbal / 200.0, c_nationkey FROM customer),
placed AS (
  SELECT c.*, """ + SLUG.format("c.name") + """ AS slug, r_name AS country, upper(substr(r_name, 1, 2)) AS country_code,
         k * CAST(0.04 AS DOUBLE) AS longitude
  FROM candidates c JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey),
judged AS (
  SELECT *, CASE WHEN latitude NOT BETWEEN -90 AND 90 THEN 'latitude_range'
                 WHEN EXISTS (SELECT 1 FROM sites s WHERE s.is_active AND lower(s.name) = lower(p.name)) THEN 'duplicate_name'
                 WHEN EXISTS (SELECT 1 FROM sites s WHERE s.id = p.slug) THEN 'duplicate_slug' END AS first_reason
  FROM placed p),
reviewed AS (
  SELECT *, CASE WHEN first_reason IS NULL AND request_seq > min(request_seq) FILTER (WHERE first_reason IS NULL)
                        OVER (PARTITION BY slug) THEN 'duplicate_in_batch' ELSE first_reason END AS reason FROM judged)"""

PATCHES = SITES + """,
patches AS (
  SELECT o_orderkey AS request_seq, s.id,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'Renamed ' || o_custkey
              WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN n.name END AS name,
         CASE WHEN o_orderstatus = 'P' THEN o_totalprice / 5000.0 END AS latitude,
         CASE WHEN o_orderstatus = 'F' THEN 'Europe/London' END AS timezone
  FROM orders JOIN sites s ON s.c_custkey = o_custkey LEFT JOIN sites n ON n.c_custkey = o_custkey + 1),
folded AS (
  SELECT id, min(request_seq) AS request_seq, arg_max(name, request_seq) FILTER (WHERE name IS NOT NULL) AS name,
         arg_max(latitude, request_seq) FILTER (WHERE latitude IS NOT NULL) AS latitude,
         arg_max(timezone, request_seq) FILTER (WHERE timezone IS NOT NULL) AS timezone
  FROM patches GROUP BY 1),
judged AS (
  SELECT f.*, s.name AS old_name, f.name IS NOT NULL AND f.name <> s.name AS renaming,
         CASE WHEN s.id IS NULL THEN 'not_found' WHEN f.latitude NOT BETWEEN -90 AND 90 THEN 'latitude_range'
              WHEN f.name IS NOT NULL AND f.name <> s.name AND EXISTS (
                SELECT 1 FROM sites o WHERE o.is_active AND lower(o.name) = lower(f.name) AND o.id <> f.id)
              THEN 'duplicate_name' END AS first_reason
  FROM folded f LEFT JOIN (SELECT * FROM sites WHERE is_active) s ON s.id = f.id),
reviewed AS (
  SELECT *, CASE WHEN first_reason IS NULL AND renaming AND request_seq >
                      min(request_seq) FILTER (WHERE first_reason IS NULL AND renaming) OVER (PARTITION BY lower(name))
                 THEN 'duplicate_in_batch' ELSE first_reason END AS reason FROM judged)"""

REQUESTS = SITES + f""",
requests AS (
  SELECT o_orderkey AS request_seq,
         CASE WHEN o_orderstatus = 'F' THEN upper(name) WHEN o_orderstatus = 'O' THEN '  ' || upper(id)
              WHEN o_orderpriority = '1-URGENT' THEN id || ' !' ELSE replace(name, '#', ' ') END AS requested_name
  FROM orders JOIN sites ON c_custkey = o_custkey),
live AS (SELECT * FROM sites WHERE is_active),
resolved AS (
  SELECT r.request_seq, r.requested_name, coalesce(a.id, b.id, c.id) AS city_id
  FROM requests r LEFT JOIN live a ON lower(a.name) = lower(r.requested_name)
  LEFT JOIN live b ON b.id = lower(trim(r.requested_name))
  LEFT JOIN live c ON c.id = {LOOKUP.format('r.requested_name')})"""

CACHE = """cache AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS city_id, o_orderdate AS generated_at,
         o_orderdate + INTERVAL 30 DAY AS expires_at, o_orderpriority AS insight_text,
         sha256(concat_ws('|', CAST(c_nationkey AS VARCHAR), o_orderstatus)) AS context_hash,
         'writer-' || lower(substr(o_orderpriority, 1, 1)) AS model_used,
         CAST(floor(o_totalprice / 100) AS INTEGER) AS input_tokens,
         CAST(floor(o_totalprice / 1000) AS INTEGER) AS output_tokens
  FROM orders JOIN customer ON o_custkey = c_custkey),
cities AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, r_name <> 'MIDDLE EAST' AS is_active
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def decisions(now: str) -> str:
    return q(f""", contexts AS (
      SELECT c.id AS city_id, coalesce(min(context_hash), 'none') AS context_hash
      FROM cities c LEFT JOIN cache k ON k.city_id = c.id AND k.generated_at >= TIMESTAMP '2001-07-01' GROUP BY 1),
    newest AS (SELECT * FROM cache QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY generated_at DESC, id DESC) = 1),
    fresh AS (SELECT * FROM cache WHERE expires_at > TIMESTAMP '{now}'
              QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY generated_at DESC, id DESC) = 1),
    decided AS (
      SELECT x.city_id, x.context_hash, n.id AS fallback_insight_id, f.expires_at AS fresh_until,
             CASE WHEN f.id IS NOT NULL THEN 'serve_cached' WHEN n.context_hash = x.context_hash THEN 'extend'
                  ELSE 'regenerate' END AS action
      FROM contexts x LEFT JOIN newest n ON n.city_id = x.city_id LEFT JOIN fresh f ON f.city_id = x.city_id)
    SELECT city_id, context_hash, action,
           CASE action WHEN 'serve_cached' THEN fresh_until
                       WHEN 'extend' THEN TIMESTAMP '{now}' + INTERVAL 1 HOUR END AS expires_at,
           fallback_insight_id FROM decided""", CACHE)


WEATHER = f"""docs AS (
  SELECT CAST(user_id % 25 AS VARCHAR) AS city_id, ts, date_trunc('hour', ts) AS h, value AS v,
         CASE WHEN event_type <> 'error' THEN 'km/h' ELSE 'm/s' END AS wind_unit FROM events),
entries AS (
  SELECT city_id, ts, h, 'temperature' AS parameter, v AS raw_value, '°C' AS raw_unit FROM docs
  UNION ALL SELECT city_id, ts, h + INTERVAL 1 HOUR, 'temperature', v / 2, '°C' FROM docs
  UNION ALL SELECT city_id, ts, h, 'humidity', NULL, '%' FROM docs
  UNION ALL SELECT city_id, ts, h + INTERVAL 1 HOUR, 'humidity', v, '%' FROM docs
  UNION ALL SELECT city_id, ts, h + INTERVAL 2 HOUR, 'humidity', v, '%' FROM docs
  UNION ALL SELECT city_id, ts, h, 'wind_speed', v, wind_unit FROM docs
  UNION ALL SELECT city_id, ts, h + INTERVAL 1 HOUR, 'wind_speed', v * 2, wind_unit FROM docs
  UNION ALL SELECT city_id, ts, h + INTERVAL 2 HOUR, 'wind_speed', v * 3, wind_unit FROM docs),
weather AS (
  SELECT city_id, parameter,
         CASE WHEN parameter = 'wind_speed' AND raw_unit = 'km/h' THEN {exact('raw_value / 3.6', 2)} ELSE raw_value END AS value,
         {unit()} AS unit, raw_value, raw_unit, CAST(h AS TIMESTAMP) AS "timestamp", 'open-meteo' AS source,
         epoch_us(ts) AS ingest_seq
  FROM entries)"""

SENSORS = """listed AS (
  SELECT CAST(c_custkey AS VARCHAR) AS city_id, c_custkey * 10 + place AS sensor_id, place,
         CASE place WHEN 1 THEN 'pm25' WHEN 2 THEN 'cosmic_rays'
              WHEN 3 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'no2' ELSE 'pm10' END
              WHEN 4 THEN 'pm25' WHEN 5 THEN 'no2' ELSE 'o3' END AS parameter,
         CASE WHEN place = 6 THEN 'ppm' ELSE 'µg/m³' END AS sensor_unit,
         CASE WHEN place <= 3 THEN c_name ELSE 'second' END AS station_name
  FROM customer, range(1, 7) AS places(place)),
sensors AS (
  SELECT * FROM listed WHERE parameter <> 'cosmic_rays'
  QUALIFY row_number() OVER (PARTITION BY city_id, parameter ORDER BY place) = 1)"""


def closed_trend(interval: str) -> str:
    return q(buckets(interval, where="TRUE") + f"""
    SELECT * FROM b WHERE period + INTERVAL 1 {interval} <=
      (SELECT date_trunc('millisecond', max("timestamp")) - INTERVAL 25 HOUR FROM valid)""")


SCORES = q(rolled("valid", "1970-01-01") + f"""
    SELECT city_id, parameter, "timestamp", value, {dec('ra', 4)} AS rolling_avg, {dec('sd', 4)} AS rolling_stddev,
           {dec('(value - ra) / nullif(sd, 0)', 4)} AS z_score, n AS window_size FROM rolled""")

HAVERSINE = ("2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * "
             "cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2))))")

CONTEXT_PAIRS = "('pm25', 'temperature'), ('pm25', 'humidity')"

ORACLE: dict[str, str] = {
    "trend_hour": trend("hour"),
    "trend_day": trend("day"),
    "trend_week": trend("week"),
    "trend_keep_empty": q(""", recent AS (SELECT * FROM valid WHERE parameter <> 'humidity' OR value > 80)"""
                          + buckets("day", "recent", "\"timestamp\" >= TIMESTAMP '2024-01-29'") + f""",
        wanted AS (SELECT id AS city_id, name AS city_name, parameter FROM cities, (VALUES ('humidity'), ('o3')) t(parameter)
                   WHERE is_active)
        SELECT w.city_id, city_name, w.parameter, {unit('w.parameter')} AS unit, 'daily' AS "interval", 2 AS days, period, avg,
               min, max, coalesce(reading_count, 0) AS reading_count,
               CAST(coalesce(sum(reading_count) OVER (PARTITION BY w.city_id, w.parameter), 0) AS BIGINT) AS total_readings
        FROM wanted w LEFT JOIN b ON b.city_id = w.city_id AND b.parameter = w.parameter"""),
    "trend_with_suspect": q(buckets(
        "day", "readings", "\"timestamp\" >= TIMESTAMP '2024-01-01' AND \"timestamp\" < TIMESTAMP '2024-01-20' "
        "AND parameter = 'temperature' AND quality_flag <> 'missing'") + f"""
        SELECT b.city_id, c.name AS city_name, parameter, {unit()} AS unit, 'daily' AS "interval", 30 AS days, period, avg, min,
               max, reading_count,
               CAST(sum(reading_count) OVER (PARTITION BY b.city_id, parameter) AS BIGINT) AS total_readings
        FROM b JOIN cities c ON c.id = b.city_id WHERE c.is_active"""),
    "trend_documents": f"SELECT * EXCLUDE (city_name) FROM ({trend('day')})",
    "compare": q(comparison(7, "TRUE") + " SELECT * FROM compared"),
    "compare_selected": q(comparison(3, "v.city_id IN ('1', '2', '3', '4')") + " SELECT * FROM compared"),
    "compare_summary": q(comparison(7, "c.is_active AND v.parameter = 'pm25'") + """
        SELECT *, CASE WHEN pct_change_vs_prev_period IS NULL THEN 'n/a' WHEN pct_change_vs_prev_period > 5 THEN 'up'
                       WHEN pct_change_vs_prev_period < -5 THEN 'down' ELSE 'flat' END AS trend FROM compared"""),
    "ranking": ranked(7, None, 10, 10),
    "ranking_country": ranked(30, "EU", 10, 10),
    "ranking_all": ranked(30, None, None, 1),
    "anomalies": ANOMALIES,
    "anomalies_sliced": ANOMALIES,
    "anomaly_totals": q(rolled("valid", "2023-12-25") + found("2024-01-01", 3.0) + TOTALS + f""", hits AS (
        SELECT city_id, parameter, count(*) AS anomalies FROM rated GROUP BY 1, 2)
        SELECT t.city_id, c.name AS city_name, t.parameter, {unit('t.parameter')} AS unit, total_readings_analysed,
               coalesce(anomalies, 0) AS anomalies
        FROM totals t JOIN cities c ON c.id = t.city_id LEFT JOIN hits h ON h.city_id = t.city_id AND h.parameter = t.parameter
        WHERE c.is_active"""),
    "rolling_windows": q(rolled("valid", "1970-01-01", 20) + f"""
        SELECT city_id, parameter, "timestamp", {dec('ra', 6)} AS rolling_avg, {dec('sd', 6)} AS rolling_stddev,
               n AS window_size FROM rolled"""),
    "anomaly_summary": q(SUMMARISED + """
        SELECT c.id AS city_id, c.name AS city_name, count(p.city_id) AS total,
               count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium,
               count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE position <= 10) AS shown,
               max(z_score) FILTER (WHERE position = 1) AS first_z, max(p.parameter) FILTER (WHERE position = 1) AS first_parameter
        FROM cities c LEFT JOIN placed p ON p.city_id = c.id WHERE c.is_active GROUP BY 1, 2"""),
    "anomaly_summary_entries": q(SUMMARISED + f"""
        SELECT p.city_id, position, parameter, {unit()} AS unit, "timestamp", value, rolling_avg, z_score, severity
        FROM placed p JOIN cities c ON c.id = p.city_id WHERE c.is_active AND position <= 10"""),
    "correlation": correlated("('pm25', 'temperature')"),
    "correlation_matrix": correlated(_ALL_PAIRS),
    "air_quality_summary": q(buckets(
        "day", where="\"timestamp\" >= TIMESTAMP '2024-01-24' AND parameter IN ('pm25','pm10','no2','o3','temperature',"
        "'humidity','wind_speed')") + f""", s AS (
        SELECT city_id, parameter, avg(avg) AS mean, min(min) AS min, max(max) AS max, arg_min(avg, period) AS first_avg,
               arg_max(avg, period) AS last_avg, CAST(sum(reading_count) AS BIGINT) AS reading_count FROM b GROUP BY 1, 2),
        moved AS (SELECT *, CASE WHEN first_avg > 0 THEN (last_avg - first_avg) / first_avg * 100 END AS change FROM s)
        SELECT m.city_id, c.name AS city_name, parameter, {unit()} AS unit, {dec('mean', 4)} AS overall_avg, min, max,
               {exact('change', 1)} AS pct_change,
               CASE WHEN change IS NULL THEN 'insufficient_baseline' WHEN change > 5 THEN 'rising'
                    WHEN change < -5 THEN 'falling' ELSE 'stable' END AS trend,
               CASE WHEN parameter <> 'pm25' THEN NULL WHEN mean <= 12 THEN 'good' WHEN mean <= 35.4 THEN 'moderate'
                    WHEN mean <= 55.4 THEN 'unhealthy_sensitive' WHEN mean <= 150.4 THEN 'unhealthy'
                    ELSE 'very_unhealthy' END AS aqi_category, reading_count
        FROM moved m JOIN cities c ON c.id = m.city_id WHERE c.is_active"""),
    "health": q(f""", l AS (SELECT max("timestamp") + INTERVAL 5 MINUTE AS last_ingestion_at FROM readings)
        SELECT last_ingestion_at, {exact(f"(epoch_us({AS_OF}) - epoch_us(last_ingestion_at)) / 1e6 / 60", 1)} AS staleness_minutes,
               CASE WHEN {AS_OF} - last_ingestion_at > INTERVAL 2 HOUR THEN 'degraded' ELSE 'healthy' END AS status FROM l"""),
    "freshness": q(f""", l AS (
        SELECT c.id AS city_id, c.name AS city_name, max("timestamp") + INTERVAL 5 MINUTE AS last_ingestion_at,
               max("timestamp") AS data_freshness
        FROM cities c LEFT JOIN readings r ON r.city_id = c.id WHERE c.is_active GROUP BY 1, 2)
        SELECT *, {exact("(epoch_us(TIMESTAMP '2024-01-31 02:00:00') - epoch_us(last_ingestion_at)) / 1e6 / 60", 1)}
                 AS staleness_minutes,
               CASE WHEN last_ingestion_at IS NULL OR TIMESTAMP '2024-01-31 02:00:00' - last_ingestion_at > INTERVAL 2 HOUR
                    THEN 'degraded' ELSE 'healthy' END AS status FROM l"""),
    "readings_range": q(f"""
        SELECT city_id, parameter, value, {unit()} AS unit, value AS raw_value, {unit()} AS raw_unit, quality_flag,
               'events' AS source, "timestamp" FROM readings
        WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' AND quality_flag <> 'missing'"""),
    "readings_page": q(f"""
        SELECT city_id, parameter, value, {unit()} AS unit, value AS raw_value, {unit()} AS raw_unit, quality_flag,
               'events' AS source, "timestamp" FROM valid
        WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'
        ORDER BY "timestamp", city_id, parameter LIMIT 100 OFFSET 50"""),
    "readings_deep_page": q(f"""
        SELECT city_id, parameter, value, {unit()} AS unit, value AS raw_value, {unit()} AS raw_unit, quality_flag,
               'events' AS source, "timestamp" FROM valid
        ORDER BY "timestamp", city_id, parameter LIMIT 200 OFFSET 600"""),
    "readings_next_page": q(f"""
        SELECT city_id, parameter, value, {unit()} AS unit, value AS raw_value, {unit()} AS raw_unit, quality_flag,
               'events' AS source, "timestamp" FROM valid
        WHERE ("timestamp", city_id, parameter) > (TIMESTAMP '2024-01-22 12:00:00', '12', 'no2')
        ORDER BY "timestamp", city_id, parameter LIMIT 100"""),
    "readings_changed_since": q("""
        SELECT CAST(event_id AS VARCHAR) AS id, city_id, parameter, value, "timestamp" + INTERVAL 5 MINUTE AS updated_at
        FROM readings WHERE "timestamp" + INTERVAL 5 MINUTE > TIMESTAMP '2024-01-15 12:00:00'"""),
    "bound_sql": q("""
        SELECT country, parameter, count(*) AS readings, round(max(value), 2) AS highest
        FROM valid JOIN cities ON id = city_id WHERE "timestamp" >= TIMESTAMP '2024-01-10' GROUP BY 1, 2"""),
    "quality_flags": q(f"""
        SELECT CAST(event_id AS VARCHAR) AS id, parameter, value, quality_flag, {unit()} AS unit FROM readings"""),
    "unit_normalise": f"""
        SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN value ELSE {exact('value / 3.6', 2)} END AS value,
               CASE WHEN event_type = 'click' THEN '°C' ELSE 'm/s' END AS unit FROM events""",
    "parse_timestamps": """
        WITH t AS (SELECT *, date_trunc('second', ts) AS s, date_trunc('minute', ts) AS m FROM events),
        p AS (SELECT *, CASE event_type WHEN 'view' THEN s WHEN 'click' THEN s - INTERVAL 2 HOUR WHEN 'purchase' THEN m
                             WHEN 'error' THEN s END AS parsed FROM t)
        SELECT event_id, CAST(parsed AS TIMESTAMP) AS parsed, CAST(parsed AS TIMESTAMP) AS with_fallback,
               CAST(CASE WHEN event_type <> 'error' THEN m END AS TIMESTAMP) AS hourly FROM p""",
    "slugify": f"""
        WITH n AS (SELECT p_name || ' _ ' || p_brand AS name FROM part UNION ALL SELECT ' São ' || c_name FROM customer
                   UNION ALL SELECT source || '--' || lang FROM documents)
        SELECT name, {SLUG.format('name')} AS slug, {LOOKUP.format('name')} AS lookup_slug FROM n""",
    "labels": """
        WITH n AS (SELECT event_id, value, value / 20 AS z, (value - 100) / 150 AS r FROM events)
        SELECT event_id, CASE WHEN z >= 3.5 THEN 'high' WHEN z >= 2.5 THEN 'medium' ELSE 'low' END AS severity,
               CASE WHEN abs(r) < 0.1 THEN 'negligible' WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.7 THEN 'moderate'
                    WHEN abs(r) < 0.9 THEN 'strong' ELSE 'very_strong' END AS strength,
               CASE WHEN abs(r) < 0.1 THEN NULL WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction,
               CASE WHEN value <= 12 THEN 'good' WHEN value <= 35.4 THEN 'moderate' WHEN value <= 55.4
                    THEN 'unhealthy_sensitive' WHEN value <= 150.4 THEN 'unhealthy' ELSE 'very_unhealthy' END AS aqi_category
        FROM n""",
    "site_checks": f"""WITH {CANDIDATES}
        SELECT request_seq, CASE WHEN latitude NOT BETWEEN -90 AND 90 THEN 'latitude_range' ELSE '' END AS errors FROM placed""",
    "weather_readings": f"WITH {WEATHER} SELECT * FROM weather",
    "weather_readings_recent": f"""WITH {WEATHER} SELECT * FROM weather
        WHERE "timestamp" >= TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 25 HOUR""",
    "first_sensor": f"WITH {SENSORS} SELECT city_id, parameter, sensor_id, sensor_unit, station_name FROM sensors",
    "air_quality_readings": f"""WITH {SENSORS}, m AS (
        SELECT CAST(user_id AS VARCHAR) AS city_id, ts, CASE WHEN value >= 0.5 THEN value END AS value, event_type,
               user_id * 10 + CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 5 WHEN 'error' THEN 6
                                              ELSE 4 END AS sensor_id FROM events)
        SELECT m.city_id, s.parameter, value, 'µg/m³' AS unit, value AS raw_value, sensor_unit AS raw_unit, ts AS "timestamp",
               'openaq' AS source, epoch_us(ts) AS ingest_seq
        FROM m JOIN sensors s ON s.sensor_id = m.sensor_id WHERE event_type <> 'signup'""",
    "nearest": f"""WITH c AS (SELECT s_suppkey AS city_id, s_acctbal / 200.0 AS lat, s_nationkey * CAST(0.04 AS DOUBLE) AS lon
                              FROM supplier),
        s AS (SELECT c_custkey AS station_id, c_acctbal / 200.0 AS lat, c_nationkey * CAST(0.04 AS DOUBLE) AS lon FROM customer),
        n AS (SELECT city_id, station_id, {HAVERSINE} AS d FROM c JOIN s ON s.lat BETWEEN c.lat - 0.5 AND c.lat + 0.5),
        r AS (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY d, station_id) AS position FROM n WHERE d <= 25)
        SELECT city_id, station_id, {dec('d', 6)} AS distance_km, position FROM r WHERE position <= 5""",
    "upsert_merge": q(corrections() + f"""
        SELECT city_id, parameter, "timestamp", value, unit, quality_flag, coalesce(written, {AS_OF}) AS created_at,
               CASE WHEN action IN ('inserted', 'updated') THEN {AS_OF} ELSE written END AS updated_at, action FROM applied"""),
    "upsert_table": q(corrections() + f"""
        SELECT city_id, parameter, "timestamp", value, unit, quality_flag,
               CASE WHEN action IN ('inserted', 'updated') THEN {AS_OF} ELSE TIMESTAMP '2024-01-20' END AS updated_at
        FROM applied"""),
    "batch_deduplicated": q(corrections() + """
        SELECT city_id, parameter, "timestamp", value, unit, quality_flag, ingest_seq FROM last_arrived"""),
    "reprocessed": q(f""", again AS (
        SELECT event_id, CASE WHEN parameter = 'pm10' THEN 'wind_speed' ELSE parameter END AS parameter,
               CASE WHEN parameter = 'pm10' THEN {exact('value * 2 / 3.6', 2)} ELSE value * 2 END AS value FROM readings)
        SELECT CAST(event_id AS VARCHAR) AS id, parameter, value, {unit()} AS unit, {flag()} AS quality_flag FROM again"""),
    "constraint_violations_found": q(corrections() + """, rows AS (
        SELECT city_id, parameter, "timestamp", value AS v, quality_flag AS f FROM readings
        UNION ALL SELECT city_id, parameter, "timestamp", value, quality_flag FROM arrived),
        bad AS (SELECT city_id, parameter, "timestamp", CASE WHEN v < 1 THEN NULL ELSE v END AS value,
                       CASE WHEN v > 400 THEN 'odd' ELSE f END AS quality_flag FROM rows)
        SELECT 'unique_key' AS rule, city_id, parameter, "timestamp", count(*) AS violating_rows FROM bad GROUP BY ALL
        HAVING count(*) > 1
        UNION ALL SELECT 'quality_flag_domain', city_id, parameter, "timestamp", 1 FROM bad WHERE quality_flag = 'odd'
        UNION ALL SELECT 'city_reference', city_id, parameter, "timestamp", 1 FROM bad
                  WHERE city_id NOT IN (SELECT id FROM cities WHERE is_active)
        UNION ALL SELECT 'missing_means_null', city_id, parameter, "timestamp", 1 FROM bad
                  WHERE (value IS NULL) <> (quality_flag = 'missing')"""),
    "ingest_stats": f"WITH {MEASURED}, {WEATHER}" + f""", staged AS (
        SELECT city_id, parameter, value FROM measured UNION ALL SELECT city_id, parameter, value FROM weather),
        flagged AS (SELECT *, {flag()} AS f FROM staged)
        SELECT c.id AS city_id, c.name AS city_name, count(f.city_id) AS readings_fetched,
               count(*) FILTER (WHERE f = 'valid') AS quality_valid, count(*) FILTER (WHERE f = 'suspect') AS quality_suspect,
               count(*) FILTER (WHERE f = 'missing') AS quality_missing, CAST(0 AS BIGINT) AS readings_skipped
        FROM cities c LEFT JOIN flagged f ON f.city_id = c.id WHERE c.is_active GROUP BY 1, 2""",
    "merge_counts": q(corrections() + """
        SELECT city_id, count(*) FILTER (WHERE action = 'inserted') AS readings_inserted,
               count(*) FILTER (WHERE action = 'updated') AS readings_updated FROM applied GROUP BY 1"""),
    "cycle_report": q(corrections() + """, live AS (SELECT * FROM cities WHERE is_active)
        SELECT (SELECT count(*) FROM live) AS cities_attempted,
               (SELECT count(*) FROM live WHERE country <> 'ASIA') AS cities_succeeded,
               (SELECT count(*) FROM live WHERE country = 'ASIA') AS cities_failed,
               count(*) AS total_readings
        FROM applied WHERE action IN ('inserted', 'updated') AND city_id IN (SELECT id FROM live)"""),
    "sites_review": f"WITH {CANDIDATES} SELECT request_seq, name, slug, reason FROM reviewed",
    "sites_create": f"""WITH {CANDIDATES}
        SELECT id, name, country, country_code, latitude, longitude, timezone, is_active, created_at, updated_at FROM sites
        UNION ALL SELECT slug, name, country, country_code, latitude, longitude, 'UTC', TRUE, {AS_OF}, {AS_OF}
        FROM reviewed WHERE reason IS NULL""",
    "sites_patch_review": f"WITH {PATCHES} SELECT id, name, latitude, timezone, reason FROM reviewed",
    "sites_update": f"""WITH {PATCHES}
        SELECT s.id, coalesce(r.name, s.name) AS name, country, country_code, coalesce(r.latitude, s.latitude) AS latitude,
               longitude, coalesce(r.timezone, s.timezone) AS timezone, is_active, created_at,
               CASE WHEN r.name <> s.name OR r.latitude <> s.latitude OR r.timezone <> s.timezone THEN {AS_OF}
                    ELSE updated_at END AS updated_at
        FROM sites s LEFT JOIN (SELECT * FROM reviewed WHERE reason IS NULL) r ON r.id = s.id""",
    "sites_delete": f"""WITH {SITES}
        SELECT id, name, country, country_code, latitude, longitude, timezone, is_active AND c_acctbal >= 0 AS is_active,
               created_at, CASE WHEN is_active AND c_acctbal < 0 THEN {AS_OF} ELSE updated_at END AS updated_at FROM sites""",
    "sites_found": f"WITH {SITES} SELECT id, name FROM sites WHERE is_active AND c_acctbal < 0",
    "sites_missing": f"WITH {SITES} SELECT id FROM sites WHERE NOT is_active AND c_acctbal < 0",
    "sites_page": f"WITH {SITES} SELECT id, name, country FROM sites WHERE is_active ORDER BY name, id LIMIT 50 OFFSET 20",
    "sites_page_info": f"""WITH {SITES} SELECT count(*) AS total, 20 AS skip, 50 AS "limit", 70 < count(*) AS has_more
        FROM sites WHERE is_active""",
    "active_sites": f"WITH {SITES} SELECT id, name FROM sites WHERE is_active",
    "resolve_names": f"""WITH {REQUESTS} SELECT request_seq, requested_name, city_id, s.name AS city_name
        FROM resolved LEFT JOIN sites s ON s.id = city_id""",
    "unresolved_names": f"WITH {REQUESTS} SELECT request_seq, requested_name FROM resolved WHERE city_id IS NULL",
    "context_statistics": q(STATISTICS + """
        SELECT city_id, parameter, avg, min, max, reading_count,
               CASE WHEN pct IS NULL THEN 'insufficient_data' WHEN pct > 5 THEN 'rising' WHEN pct < -5 THEN 'falling'
                    ELSE 'stable' END AS trend_direction, pct AS trend_pct_change FROM moved""", HOURLY),
    "context_anomalies": q(TOP5 + """
        SELECT city_id, position, "timestamp", parameter, value, rolling_avg, z_score FROM top5""", HOURLY),
    "context_windows": q(TOP5 + f""", near AS (
        SELECT t.city_id, t.position, h."timestamp", h.parameter, h.value,
               dense_rank() OVER (PARTITION BY t.city_id, t.position ORDER BY h."timestamp" DESC) AS recency
        FROM top5 t JOIN hvalid h ON h.city_id = t.city_id
         AND h."timestamp" BETWEEN t."timestamp" - INTERVAL 3 HOUR AND t."timestamp" + INTERVAL 3 HOUR)
        SELECT city_id, position, "timestamp", parameter, {dec('value', 6)} AS value FROM near WHERE recency <= 7""", HOURLY),
    "surroundings_of_peaks": q(""", near AS (
        SELECT p.city_id, CAST(p.event_id AS VARCHAR) AS peak_id, v."timestamp", v.parameter, v.value,
               dense_rank() OVER (PARTITION BY p.event_id ORDER BY v."timestamp" DESC) AS recency
        FROM valid p JOIN valid v ON v.city_id = p.city_id
         AND v."timestamp" BETWEEN p."timestamp" - INTERVAL 3 HOUR AND p."timestamp" + INTERVAL 3 HOUR
        WHERE p.value > 350)
        SELECT city_id, peak_id, "timestamp", parameter, value FROM near WHERE recency <= 7"""),
    "context_correlations": q(matrix("hvalid", CONTEXT_PAIRS, 7) + f"""
        SELECT city_id, param1, param2, {dec('r', 4)} AS pearson_r, sample_size FROM measured_r WHERE r IS NOT NULL""", HOURLY),
    "data_quality": q(QUALITY.format(source="readings") + f"""
        SELECT city_id, total_readings, {exact('valid_rows / total_readings * 100', 1)} AS valid_pct, suspect, missing
        FROM quality"""),
    "insight_context": q(STATISTICS + TOP5 + matrix("hvalid", CONTEXT_PAIRS, 7) + QUALITY.format(source="hourly") + f"""
        SELECT c.id AS city_id, c.name AS city, country, '2024-01-24 to 2024-01-31' AS period,
               (SELECT count(*) FROM moved m WHERE m.city_id = c.id) AS parameters,
               (SELECT max(avg) FROM moved m WHERE m.city_id = c.id AND parameter = 'pm25') AS pm25_avg,
               (SELECT count(*) FROM top5 t WHERE t.city_id = c.id) AS anomalies,
               (SELECT count(*) FROM measured_r r WHERE r.city_id = c.id AND r.r IS NOT NULL) AS correlations,
               coalesce(total_readings, 0) AS total_readings,
               coalesce({exact('valid_rows / total_readings * 100', 1)}, 0.0) AS valid_pct
        FROM cities c LEFT JOIN quality q ON q.city_id = c.id WHERE c.is_active""", HOURLY),
    "insight_flags": q(STATISTICS + TOP5 + matrix("hvalid", CONTEXT_PAIRS, 7) + f"""
        SELECT c.id AS city_id, EXISTS (SELECT 1 FROM top5 t WHERE t.city_id = c.id AND z_score >= 3.0) AS concern_flag,
               EXISTS (SELECT 1 FROM measured_r r WHERE r.city_id = c.id AND param2 = 'temperature'
                       AND {dec('r.r', 4)} < -0.4) AS inversion_flag,
               EXISTS (SELECT 1 FROM moved m WHERE m.city_id = c.id AND parameter = 'pm25' AND pct > 10) AS action_flag
        FROM cities c WHERE c.is_active""", HOURLY),
    "cache_decisions": decisions("2001-08-20"),
    "cache_decisions_expired": decisions("2002-01-01"),
    "refresh_plan": q(""", newest AS (
          SELECT city_id, max_by(id, (generated_at, id)) AS id FROM cache GROUP BY 1),
        fresh AS (SELECT *, expires_at + INTERVAL 8217 DAY AS until FROM cache
                  WHERE expires_at + INTERVAL 8217 DAY > TIMESTAMP '2024-01-31'
                  QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY generated_at DESC, id DESC) = 1)
        SELECT c.id AS city_id, CASE WHEN f.id IS NULL THEN 'regenerate' ELSE 'serve_cached' END AS action,
               f.until AS expires_at, coalesce(f.id, n.id) AS fallback_insight_id
        FROM cities c LEFT JOIN fresh f ON f.city_id = c.id LEFT JOIN newest n ON n.city_id = c.id WHERE c.is_active""", CACHE),
    "latest_insights": q("""
        SELECT city_id, id, generated_at, expires_at FROM cache WHERE expires_at > TIMESTAMP '2001-08-20'
        QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY generated_at DESC, id DESC) = 1""", CACHE),
    "insight_feed": q(""", newest AS (
        SELECT * FROM cache QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY generated_at DESC, id DESC) = 1)
        SELECT c.id AS city_id, c.name AS city_name, insight_text AS insight, generated_at, expires_at, model_used,
               expires_at <= TIMESTAMP '2001-08-20' AS expired
        FROM cities c JOIN newest n ON n.city_id = c.id WHERE c.is_active""", CACHE),
    "extended_insights": q(""", newest AS (
        SELECT id FROM cache QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY generated_at DESC, id DESC) = 1)
        SELECT k.id, city_id, CASE WHEN n.id IS NOT NULL THEN TIMESTAMP '2001-12-01 01:00:00' ELSE expires_at END AS expires_at,
               CASE WHEN n.id IS NOT NULL THEN TIMESTAMP '2001-12-01' ELSE generated_at END AS updated_at
        FROM cache k LEFT JOIN newest n ON n.id = k.id""", CACHE),
    "token_audit": q("""
        SELECT city_id, model_used, CAST(CAST(generated_at AS DATE) AS VARCHAR) AS day, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
               CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) AS insights
        FROM cache GROUP BY 1, 2, 3""", CACHE),
    "stream_upsert": q(""" SELECT city_id, parameter, "timestamp", value, quality_flag FROM readings"""),
    "stream_documents": f"""WITH {WEATHER}, kept AS (
          SELECT * FROM weather WHERE (city_id, ingest_seq) IN (SELECT (city_id, epoch_us(ts)) FROM docs WHERE wind_unit = 'km/h')),
        newest AS (SELECT *, {flag()} AS f FROM kept
                   QUALIFY row_number() OVER (PARTITION BY city_id, parameter, "timestamp" ORDER BY ingest_seq DESC) = 1)
        SELECT parameter AS kind, f AS quality_flag, count(*) AS rows FROM newest GROUP BY 1, 2
        UNION ALL SELECT 'quarantine', 'unreadable', count(*) FROM docs WHERE wind_unit = 'm/s'""",
    "stream_cycles": f"""WITH {WEATHER}, kept AS (
          SELECT * FROM weather WHERE (city_id, ingest_seq) IN (SELECT (city_id, epoch_us(ts)) FROM docs WHERE wind_unit = 'km/h')),
        failed AS (SELECT city_id, count(*) AS n FROM docs WHERE wind_unit = 'm/s' GROUP BY 1),
        counted AS (SELECT city_id, count(*) AS fetched, count(DISTINCT (parameter, "timestamp")) AS inserted,
                           count(*) FILTER (value IS NULL) AS missing FROM kept GROUP BY 1)
        SELECT CAST(n_nationkey AS VARCHAR) AS city_id, CAST(coalesce(fetched, 0) AS BIGINT) AS readings_fetched,
               CAST(coalesce(inserted, 0) AS BIGINT) AS readings_inserted, CAST(coalesce(missing, 0) AS BIGINT) AS quality_missing,
               CAST(coalesce(n, 0) AS BIGINT) AS fetch_errors
        FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN counted c ON c.city_id = CAST(n_nationkey AS VARCHAR)
        LEFT JOIN failed f ON f.city_id = CAST(n_nationkey AS VARCHAR) WHERE r_name <> 'MIDDLE EAST'""",
    "stream_trend_hour": q(buckets("hour", where="TRUE") + " SELECT * FROM b"),
    "stream_trend_day": q(buckets("day", where="TRUE") + " SELECT * FROM b"),
    "stream_trend_week": q(buckets("week", where="TRUE") + " SELECT * FROM b"),
    "closed_trend_hour": closed_trend("hour"),
    "closed_trend_day": closed_trend("day"),
    "closed_trend_week": closed_trend("week"),
    "stream_baseline": SCORES,
}
ORACLE |= {"health_from_log": ORACLE["health"], "freshness_from_log": ORACLE["freshness"],
           "changed_from_log": ORACLE["readings_changed_since"]}
