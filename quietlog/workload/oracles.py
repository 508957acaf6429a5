"""The queries of ``registry`` as ANSI SQL over the driver tables."""

_COMMON = """
WITH rec AS (
  SELECT (CASE WHEN user_id % 29 = 0 THEN '_' ELSE '' END) || event_type || '.user-' || CAST(user_id AS VARCHAR) AS topic,
         CAST(event_id % 2 AS INTEGER) AS part, event_id // 2 AS off, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
         user_id, event_type
  FROM events),
firsts AS (SELECT topic, min(ts) AS first_ts FROM rec GROUP BY topic),
pu AS (SELECT DISTINCT r.topic, r.user_id, r.part, f.first_ts FROM rec r JOIN firsts f ON r.topic = f.topic),
scan AS (SELECT CAST(n AS INTEGER) AS n, CAST(1704067200 + n * 86400 AS BIGINT) AS scan_time FROM range(1, 31) t(n)),
raw_listing AS (
  SELECT topic, part, user_id, n, scan_time FROM pu JOIN scan ON first_ts <= scan_time
  WHERE NOT (user_id % 41 = 0 AND n BETWEEN 20 AND 22)),
listing AS (SELECT * FROM raw_listing WHERE NOT starts_with(topic, '_')),
daily AS (
  SELECT topic, part, greatest(1, (ts - 1704067200 + 86399) // 86400) AS d, count(*) AS c
  FROM rec GROUP BY ALL),
cum AS (
  SELECT l.topic, l.part, l.user_id, l.n, l.scan_time,
         CAST(coalesce(sum(d.c) FILTER (WHERE d.d <= l.n), 0) AS BIGINT) AS latest0,
         CAST(coalesce(sum(d.c) FILTER (WHERE d.d <= l.n - 7), 0) AS BIGINT) AS earliest0
  FROM listing l LEFT JOIN daily d ON l.topic = d.topic AND l.part = d.part GROUP BY ALL),
obs AS (
  SELECT topic, part, n, scan_time,
         CASE WHEN (user_id + n) % 37 = 0 THEN greatest(latest0 - 1, 0) ELSE latest0 END AS latest,
         CASE WHEN (user_id + n) % 31 = 0 THEN NULL ELSE earliest0 END AS earliest
  FROM cum WHERE (user_id + 2 * n + part) % 53 <> 0),
seen AS (SELECT DISTINCT topic, n, scan_time FROM listing),
gaps AS (
  SELECT topic, n, scan_time,
         coalesce(n - lag(n) OVER (PARTITION BY topic ORDER BY n) <> 1, false) AS is_return FROM seen),
ep AS (
  SELECT topic, n, scan_time, is_return,
         CAST(sum(CASE WHEN is_return THEN 1 ELSE 0 END) OVER (PARTITION BY topic ORDER BY n) AS INTEGER) AS epoch
  FROM gaps),
h0 AS (
  SELECT o.topic, o.part, e.epoch, o.n, o.scan_time, o.latest, coalesce(o.earliest, 0) AS low,
         lag(o.latest) OVER (PARTITION BY o.topic, o.part, e.epoch ORDER BY o.n) AS prev
  FROM obs o JOIN ep e ON o.topic = e.topic AND o.n = e.n),
hist AS (
  SELECT topic, part, epoch, n, scan_time, latest AS off,
         max(CASE WHEN prev IS NULL OR latest > prev THEN scan_time END)
           OVER (PARTITION BY topic, part, epoch ORDER BY n) AS ts,
         latest = low AS is_empty, greatest(latest - low, 0) AS cnt
  FROM h0),
processed AS (SELECT DISTINCT topic, epoch, n FROM hist),
spans AS (
  SELECT *, coalesce(lead(n) OVER (PARTITION BY topic, part, epoch ORDER BY n) - 1, 30) AS until FROM hist),
written AS (
  SELECT s.topic, p.n, s.part, s.off, s.ts, s.is_empty, s.scan_time AS scanned_at, s.cnt
  FROM spans s JOIN processed p ON s.topic = p.topic AND s.epoch = p.epoch AND p.n BETWEEN s.n AND s.until),
tombs AS (
  SELECT e.topic, e.n FROM (SELECT topic, epoch, max(n) + 1 AS n FROM ep GROUP BY topic, epoch) e
  WHERE e.n <= 30 AND EXISTS (SELECT 1 FROM processed p WHERE p.topic = e.topic AND p.epoch = e.epoch)),
recs0 AS (
  SELECT topic, n, false AS tomb FROM processed UNION ALL SELECT topic, n, true FROM tombs),
recs1 AS (
  SELECT topic, n, tomb,
         CAST(n AS BIGINT) * 1000000000000 + CAST(split_part(topic, '.user-', 2) AS BIGINT) * 8
         + list_position(['click', 'error', 'purchase', 'signup', 'view'], split_part(topic, '.', 1)) AS off
  FROM recs0),
recs AS (SELECT *, NOT tomb AND off % 97 = 0 AS bad FROM recs1),
ostate AS (
  SELECT 'orders.cust-' || CAST(o_custkey AS VARCHAR) AS topic, CAST(o_orderkey % 2 AS INTEGER) AS part,
         count(*) AS off, max(CAST(floor(epoch(o_orderdate)) AS BIGINT)) AS ts
  FROM orders GROUP BY ALL),
o_now AS (SELECT max(CAST(floor(epoch(o_orderdate)) AS BIGINT)) AS t FROM orders),
otopic AS (
  SELECT topic AS name, CAST(count(*) AS INTEGER) AS partition_count, min(ts) AS oldest, max(ts) AS newest,
         CAST(sum(off) AS BIGINT) AS total, (SELECT t FROM o_now) AS t
  FROM ostate GROUP BY topic),
ostatus AS (
  SELECT *, CAST((t - newest) // 86400 AS INTEGER) AS newest_days, CAST((t - oldest) // 86400 AS INTEGER) AS oldest_days,
         CASE WHEN (t - newest) // 86400 >= 365 THEN 'unused' WHEN (t - oldest) // 86400 >= 180 THEN 'stale'
              ELSE 'active' END AS status
  FROM otopic),
hb AS (
  SELECT 'user-' || CAST(user_id AS VARCHAR) AS instance_id, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last_heartbeat_at,
         CAST(1800 * (user_id % 4) AS INTEGER) AS heartbeat_interval_sec,
         arg_max(event_type, (ts, event_id)) AS group_id, CAST(user_id % 7 AS INTEGER) AS assigned_shards
  FROM events GROUP BY user_id),
hb_live AS (
  SELECT *, last_heartbeat_at > 0 AND 1706659200 <= last_heartbeat_at
            + 3 * CASE WHEN heartbeat_interval_sec > 0 THEN heartbeat_interval_sec ELSE 30 END AS is_active
  FROM hb),
cfg AS (
  SELECT 'cfg-' || CAST(c_custkey AS VARCHAR) AS topic, 'cleanup.policy' AS name,
         CASE c_custkey % 5 WHEN 0 THEN 'compact' WHEN 1 THEN 'compact,delete' WHEN 2 THEN ' delete, COMPACT '
              WHEN 3 THEN 'delete' END AS value FROM customer
  UNION ALL SELECT 'cfg-' || CAST(c_custkey AS VARCHAR), 'segment.ms',
         CASE c_custkey % 3 WHEN 0 THEN '86400000' WHEN 1 THEN '2048' END FROM customer
  UNION ALL SELECT 'cfg-' || CAST(c_custkey AS VARCHAR), 'min.cleanable.dirty.ratio',
         CASE c_custkey % 2 WHEN 0 THEN '0.1' ELSE '0.5' END FROM customer)
"""


def _fnv(text: str) -> str:
    return (f"list_reduce(list_prepend(CAST(2166136261 AS BIGINT), "
            f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), "
            f"lambda h, b: (xor(h, b) * 16777619) & 4294967295)")


def _shard(topic: str, part: str, count: int = 6) -> str:
    return f"CAST({_fnv(f'{topic} || chr(35) || CAST({part} AS VARCHAR)')} % {count} AS INTEGER)"


def _age_text(elapsed: str) -> str:
    units = []
    for value, name in [(f"({elapsed}) // 86400", "day"), (f"(({elapsed}) // 3600) % 24", "hour"),
                        (f"(({elapsed}) // 60) % 60", "minute"), (f"({elapsed}) % 60", "second")]:
        units.append(f"CASE WHEN {value} = 1 THEN '1 {name}' WHEN {value} > 1 "
                     f"THEN CAST({value} AS VARCHAR) || ' {name}s' END")
    listed = f"list_filter([{', '.join(units)}], lambda u: u IS NOT NULL)"
    return f"coalesce(nullif(array_to_string(({listed})[1:2], ' '), ''), '0 seconds')"


def _state(n: int, name: str = "state") -> str:
    """State after scan ``n`` as a further common table expression."""
    return f""",
{name} AS (
  SELECT h.topic, h.part, arg_max(h.off, h.n) AS off, arg_max(h.ts, h.n) AS ts,
         arg_max(h.is_empty, h.n) AS is_empty, max(h.scan_time) AS scanned_at, arg_max(h.cnt, h.n) AS cnt
  FROM hist h JOIN ep e ON h.topic = e.topic AND h.epoch = e.epoch AND e.n = {n}
  WHERE h.n <= {n} GROUP BY h.topic, h.part)"""


_STATE_COLUMNS = ("topic, part AS partition, off AS offset, ts AS timestamp, is_empty, scanned_at, "
                  "cnt AS message_count")
_AS_OF = 1706659200

# Topics of the state after scan 30.
_WIDE = """CAST(o_orderkey AS INTEGER) AS partition, CAST(o_custkey AS BIGINT) AS "offset",
  CAST(floor(epoch(o_orderdate)) AS BIGINT) AS "timestamp", false AS is_empty,
  CAST(floor(epoch(o_orderdate)) AS BIGINT) AS scanned_at, CAST(o_custkey AS BIGINT) AS message_count"""

_TOPICS = _state(30) + f""",
topics AS (
  SELECT topic AS name, CAST(count(*) AS INTEGER) AS partition_count, min(ts) AS oldest, max(ts) AS newest,
         bool_and(is_empty) AS is_empty, CAST(sum(cnt) AS BIGINT) AS total, max(scanned_at) AS last_update,
         CAST(count(*) FILTER (WHERE ({_AS_OF} - ts) // 86400 >= 3) AS BIGINT) AS stale
  FROM state GROUP BY topic),
status AS (
  SELECT *, CAST(({_AS_OF} - newest) // 86400 AS INTEGER) AS newest_days,
         CAST(({_AS_OF} - oldest) // 86400 AS INTEGER) AS oldest_days,
         CASE WHEN ({_AS_OF} - newest) // 86400 >= 4 THEN 'unused' WHEN ({_AS_OF} - oldest) // 86400 >= 3 THEN 'stale'
              ELSE 'active' END AS status
  FROM topics)"""

_ROW = ("name, partition_count, oldest AS oldest_partition_timestamp, newest AS newest_partition_timestamp, "
        "is_empty, total AS total_message_count")


def _page(source: str, order: str, limit: int, offset: int, where: str = "true") -> str:
    row = _ROW if source != "ostatus" else _ROW.replace("is_empty", "false AS is_empty")
    return (f"SELECT {row}, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS position FROM {source} "
            f"WHERE {where} QUALIFY row_number() OVER (ORDER BY {order}) BETWEEN {offset + 1} AND {offset + limit}")


_O_BUCKET = ("CASE WHEN t - newest >= 365 * 86400 THEN 2 WHEN t - oldest >= 180 * 86400 THEN 1 ELSE 0 END")

# Per-topic list report over the state after scan 30, stale 3 and unused 4 days.
_REPORT = f"""SELECT name, status, is_empty, CASE WHEN is_empty THEN 'yes' ELSE 'no' END AS empty, partition_count,
  stale AS stale_partitions, total AS total_message_count, {_age_text(f'{_AS_OF} - oldest')} AS oldest_partition_age,
  {_age_text(f'{_AS_OF} - newest')} AS newest_partition_age, newest_days, last_update AS last_update_unix FROM status"""

# Last valid record of every topic, unless it is a tombstone.
_REPLAY = """,
last_rec AS (
  SELECT topic, max(n) AS n, arg_max(tomb, n) AS gone FROM recs WHERE NOT bad GROUP BY topic),
replayed AS (
  SELECT w.* FROM written w JOIN last_rec l ON w.topic = l.topic AND w.n = l.n WHERE NOT l.gone)"""

# Records since the last tombstone, with the partitions of each partial writer.
_MERGE = """,
dead AS (SELECT topic, max(n) AS n FROM recs WHERE tomb GROUP BY topic),
alive AS (
  SELECT r.topic, r.n FROM recs r LEFT JOIN dead d ON r.topic = d.topic
  WHERE NOT r.tomb AND NOT r.bad AND (d.n IS NULL OR r.n > d.n)),
merged AS (
  SELECT w.* FROM written w JOIN alive a ON w.topic = a.topic AND w.n = a.n WHERE w.part % 2 = w.n % 2
  QUALIFY row_number() OVER (PARTITION BY w.topic, w.part ORDER BY w.scanned_at DESC, w.n DESC) = 1)"""

_AUDIT = """,
p AS (SELECT topic, max(value) FILTER (WHERE name = 'cleanup.policy') AS policy FROM cfg GROUP BY topic),
q AS (SELECT topic, policy, coalesce(list_contains(list_transform(string_split(policy, ','),
             lambda x: lower(trim(x))), 'compact'), false) AS ok FROM p),
want AS (SELECT * FROM (VALUES ('segment.ms', '104857600'), ('min.cleanable.dirty.ratio', '0.1'),
                               ('retention.ms', '-1'), ('retention.bytes', '-1')) t(name, recommended)),
findings AS (
SELECT topic, 'cleanup.policy' AS name, 'error' AS severity,
       CASE WHEN policy IS NULL THEN 'not set' ELSE 'not compacted' END AS problem, policy AS actual,
       'compact' AS recommended FROM q WHERE NOT ok
UNION ALL
SELECT q.topic, w.name, 'warning', CASE WHEN c.value IS NULL THEN 'not set' ELSE 'mismatch' END, c.value, w.recommended
FROM q JOIN want w ON q.ok LEFT JOIN cfg c ON c.topic = q.topic AND c.name = w.name
WHERE c.value IS NULL OR c.value <> w.recommended)"""

_HISTORY = ("SELECT topic, part AS partition, epoch, scan_time, off AS offset, ts AS timestamp, is_empty, "
            "cnt AS message_count FROM hist")


def _without_scan(lost: int) -> str:
    """The common tables as if scan ``lost`` had not been made; later scans move up by one."""
    number = f"n - CAST(n > {lost} AS INTEGER) AS n"
    text = _COMMON.strip()
    for old, new in (
        ("SELECT DISTINCT topic, n, scan_time FROM listing", f"SELECT DISTINCT topic, {number}, scan_time FROM listing WHERE n <> {lost}"),
        ("SELECT topic, part, n, scan_time,\n", f"SELECT topic, part, {number}, scan_time,\n"),
        ("FROM cum WHERE", f"FROM cum WHERE n <> {lost} AND"),
    ):
        assert text.count(old) == 1, old
        text = text.replace(old, new)
    return text


def sql() -> dict[str, str]:
    names = {
        "unused_topics_from_log": f""",
lt AS (SELECT topic, part, max(ts) AS ts, count(*) AS c FROM rec WHERE NOT starts_with(topic, '_') GROUP BY ALL),
tt AS (SELECT topic AS name, CAST(count(*) AS INTEGER) AS partition_count, min(ts) AS oldest, max(ts) AS newest,
              CAST(sum(c) AS BIGINT) AS total,
              CAST(count(*) FILTER (WHERE ({_AS_OF} - ts) // 86400 >= 3) AS BIGINT) AS stale FROM lt GROUP BY topic)
SELECT name, 'unused' AS status, false AS is_empty, 'no' AS empty, partition_count, stale AS stale_partitions,
       total AS total_message_count, {_age_text(f'{_AS_OF} - oldest')} AS oldest_partition_age,
       {_age_text(f'{_AS_OF} - newest')} AS newest_partition_age,
       CAST(({_AS_OF} - newest) // 86400 AS INTEGER) AS newest_days, newest AS last_update_unix
FROM tt WHERE ({_AS_OF} - newest) // 86400 >= 4""",
        "topic_listing": "SELECT topic, part AS partition, scan_time FROM listing",
        "listed_partition_counts":
            "SELECT topic, CAST(count(*) AS INTEGER) AS partition_count FROM listing WHERE n = 30 GROUP BY topic",
        "scan_latest_offsets": "SELECT topic, part AS partition, max(off) + 1 AS latest FROM rec GROUP BY ALL",
        "scan_earliest_offsets": "SELECT topic, part AS partition, min(off) AS earliest FROM rec GROUP BY ALL",
        "scan_watermarks": """SELECT topic, part AS partition, max(off) + 1 AS latest,
  coalesce(min(off) FILTER (WHERE ts > 1706054400), max(off) + 1) AS earliest FROM rec GROUP BY topic, part""",
        "offset_answers": """SELECT topic, part AS partition, max(off) + 1 AS latest FROM rec
  WHERE user_id % 11 <> 0 GROUP BY ALL""",
        "observation_join": """,
la AS (SELECT topic, part, max(off) + 1 AS latest FROM rec GROUP BY topic, part),
ea AS (SELECT topic, part, min(off) AS earliest FROM rec WHERE ts > 1706054400 GROUP BY topic, part)
SELECT la.topic, la.part AS partition, latest AS "offset", latest = coalesce(earliest, 0) AS is_empty,
       greatest(latest - coalesce(earliest, 0), 0) AS message_count
FROM la LEFT JOIN ea ON la.topic = ea.topic AND la.part = ea.part""",
        "last_change_backfill": _HISTORY,
        "topic_epochs": """SELECT topic, epoch, min(scan_time) AS first_scan, max(scan_time) AS last_scan,
  count(*) AS scans FROM ep GROUP BY topic, epoch""",
        "state_as_of_scan": _state(30) + f"\nSELECT {_STATE_COLUMNS} FROM state",
        "state_as_of_scan_with_deletions": _state(21) + f"\nSELECT {_STATE_COLUMNS} FROM state",
        "last_change_incremental": _state(23) + f"\nSELECT {_STATE_COLUMNS} FROM state",
        "deleted_topics": _state(19) + """
SELECT DISTINCT topic FROM state s WHERE NOT EXISTS (SELECT 1 FROM listing l WHERE l.n = 20 AND l.topic = s.topic)""",
        "scan_counters": """SELECT count(DISTINCT l.topic) AS listed_topics,
  count(DISTINCT l.topic) AS assigned_topics, count(DISTINCT o.topic) AS processed_topics,
  count(o.topic) AS processed_partitions
FROM listing l LEFT JOIN obs o ON l.topic = o.topic AND l.part = o.part AND l.n = o.n WHERE l.n = 30""",
        "scan_cycle_records": _state(19, "prev") + _state(20) + """
SELECT topic AS key, false AS tombstone, CAST(count(*) AS BIGINT) AS partitions, CAST(sum(off) AS BIGINT) AS offsets,
       CAST(sum(ts) AS BIGINT) AS timestamps
FROM state s WHERE EXISTS (SELECT 1 FROM obs o WHERE o.n = 20 AND o.topic = s.topic) GROUP BY topic
UNION ALL SELECT DISTINCT topic, true, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM prev p
WHERE NOT EXISTS (SELECT 1 FROM listing l WHERE l.n = 20 AND l.topic = p.topic)""",
        "topic_rollup": _TOPICS + """
SELECT name, partition_count, oldest AS oldest_timestamp, newest AS newest_timestamp, is_empty,
       total AS total_message_count, last_update FROM topics""",
        "topic_status": """SELECT name, status, newest_days, oldest_days FROM ostatus""",
        "stale_partitions": f"""SELECT topic, part AS partition, off AS "offset",
  {_age_text('(SELECT t FROM o_now) - ts')} AS age, CAST(((SELECT t FROM o_now) - ts) // 86400 AS INTEGER) AS age_days,
  off AS message_count FROM ostate WHERE ((SELECT t FROM o_now) - ts) // 86400 >= 180""",
        "stale_by_topic": """SELECT topic AS name,
  CAST(count(*) FILTER (WHERE ((SELECT t FROM o_now) - ts) // 86400 >= 180) AS BIGINT) AS stale_partitions
FROM ostate GROUP BY topic""",
        "age_parts": """,
a AS (SELECT o_orderkey, (SELECT t FROM o_now) - CAST(floor(epoch(o_orderdate)) AS BIGINT) + o_orderkey % 100000 AS e
      FROM orders)
SELECT o_orderkey, CAST(e // 86400 AS INTEGER) AS days, CAST((e // 3600) % 24 AS INTEGER) AS hours,
       CAST((e // 60) % 60 AS INTEGER) AS minutes, CAST(e % 60 AS INTEGER) AS seconds FROM a""",
        "age_text": f""",
a AS (SELECT o_orderkey, (SELECT t FROM o_now) - CAST(floor(epoch(o_orderdate)) AS BIGINT) + o_orderkey % 100000 AS e
      FROM orders)
SELECT o_orderkey, {_age_text('e')} AS age FROM a""",
        "list_topics_by_name": _page("ostatus", "lower(name) DESC, name", 500, 500),
        "list_topics_by_partitions": _page("ostatus", "partition_count, lower(name), name", 500, 0),
        "list_topics_by_age": _page("ostatus", "oldest DESC, lower(name), name", 500, 0),
        "list_topics_by_status": _page("ostatus", f"{_O_BUCKET} DESC, lower(name), name", 500, 500),
        "list_topics_by_messages": _page("ostatus", "total DESC, lower(name), name", 50, 0,
                                         "regexp_matches(name, 'CUST-1[0-9]+$', 'i')"),
        "list_topics_deep_page": """SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS name,
  CAST(row_number() OVER (ORDER BY o_custkey, 'order-' || CAST(o_orderkey AS VARCHAR)) AS INTEGER) AS position,
  CAST(o_custkey AS BIGINT) AS total_message_count FROM orders QUALIFY position > 10000 AND position <= 10500""",
        "list_topics_indexed_pages": """SELECT CAST((position - 1) // 500 + 1 AS INTEGER) AS page, * FROM (
  SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS name,
    CAST(row_number() OVER (ORDER BY o_custkey, 'order-' || CAST(o_orderkey AS VARCHAR)) AS INTEGER) AS position,
    CAST(o_custkey AS BIGINT) AS total_message_count FROM orders) WHERE (position - 1) // 500 + 1 IN (1, 21, 30)""",
        "list_topics_by_empty": _TOPICS + "\n" + _page("status", "is_empty DESC, lower(name), name", 500, 0),
        "unused_topics": _TOPICS + "\n" + _page("status", "newest DESC, lower(name), name".replace("newest", "oldest"),
                                                50, 50, "newest_days >= 4"),
        "empty_topics": _TOPICS + "\n" + _page("status", "lower(name), name", 50, 0, "is_empty"),
        "page_meta": """,
c AS (SELECT count(*) AS total FROM ostatus WHERE newest_days >= 365)
SELECT least(greatest(total - 50, 0), 50) AS count, total, 2 AS page, 50 AS "limit", total > 100 AS has_more FROM c""",
        "topic_detail": """SELECT topic, part AS partition, off AS "offset", ts AS "timestamp", false AS is_empty,
  off AS message_count FROM ostate WHERE topic = 'orders.cust-7'""",
        "topic_header": """SELECT name, partition_count, oldest AS oldest_timestamp, newest AS newest_timestamp,
  newest AS last_update, false AS is_empty FROM otopic WHERE name = 'orders.cust-7'""",
        "cluster_stats": _TOPICS + """
SELECT count(*) AS total_topics, CAST(sum(partition_count) AS BIGINT) AS total_partitions,
  count(*) FILTER (WHERE newest_days >= 4) AS unused_topics, CAST(sum(stale) AS BIGINT) AS stale_partitions,
  3 AS stale_days, 4 AS unused_days, (SELECT count(*) FROM hb_live WHERE is_active) AS active_instances,
  max(last_update) AS last_scan, true AS is_global, 'driver' AS local_instance_id FROM status""",
        "list_report": _TOPICS + "\n" + _REPORT + " WHERE newest_days >= 4",
        "list_report_empty": _TOPICS + "\n" + _REPORT + " WHERE is_empty AND starts_with(name, 'view')",
        "list_documents": _TOPICS + f""",
details AS (
  SELECT topic, '[' || string_agg('{{"partition":' || CAST(part AS VARCHAR) || ',"offset":' || CAST(off AS VARCHAR)
    || ',"age":"' || {_age_text(f'{_AS_OF} - ts')} || '","message_count":' || CAST(cnt AS VARCHAR) || '}}', ','
    ORDER BY part) || ']' AS d
  FROM state WHERE ({_AS_OF} - ts) // 86400 >= 3 GROUP BY topic)
SELECT name, '{{"name":"' || name || '","status":"' || status || '","is_empty":' || CAST(is_empty AS VARCHAR)
  || ',"partition_count":' || CAST(partition_count AS VARCHAR)
  || ',"oldest_partition_age":"' || {_age_text(f'{_AS_OF} - oldest')}
  || '","newest_partition_age":"' || {_age_text(f'{_AS_OF} - newest')}
  || '","stale_partitions":' || CAST(stale AS VARCHAR) || ',"total_message_count":' || CAST(total AS VARCHAR)
  || ',"last_update_unix":' || CAST(last_update AS VARCHAR)
  || coalesce(',"stale_partition_details":' || d, '') || ',"slice":0,"slices":1}}' AS document
FROM status LEFT JOIN details ON name = topic WHERE newest_days >= 4""",
        "list_documents_wide": """SELECT 'orders.all' AS name, o_orderkey // 5000 AS range, count(*) AS partitions,
  (SELECT count(DISTINCT o_orderkey // 5000) FROM orders) AS slices FROM orders GROUP BY 1, 2""",
        "list_header": """SELECT '2024-01-31T00:00:00Z' AS generated_at, count(*) AS count
FROM ostatus WHERE newest_days >= 365""",
        "list_sub_rows": f"""SELECT s.topic, s.part AS partition, s.off AS "offset",
  {_age_text('(SELECT t FROM o_now) - s.ts')} AS age, s.off AS message_count
FROM ostate s JOIN ostatus t ON s.topic = t.name
WHERE t.newest_days >= 365 AND ((SELECT t FROM o_now) - s.ts) // 86400 >= 180""",
        "topic_documents": f""",
parts AS (
  SELECT topic, '{{' || string_agg('"' || CAST(part AS VARCHAR) || '":{{"partition":' || CAST(part AS VARCHAR)
    || ',"offset":' || CAST(off AS VARCHAR) || ',"timestamp":' || CAST(ts AS VARCHAR)
    || ',"age":{{"days":' || CAST((t - ts) // 86400 AS VARCHAR) || ',"hours":' || CAST(((t - ts) // 3600) % 24 AS VARCHAR)
    || ',"minutes":' || CAST(((t - ts) // 60) % 60 AS VARCHAR) || ',"seconds":' || CAST((t - ts) % 60 AS VARCHAR)
    || '}},"is_empty":false,"scanned_at":' || CAST(ts AS VARCHAR) || ',"message_count":' || CAST(off AS VARCHAR) || '}}',
    ',' ORDER BY part) || '}}' AS p
  FROM ostate, o_now GROUP BY topic)
SELECT name, '{{"name":"' || name || '","partition_count":' || CAST(partition_count AS VARCHAR) || ',"partitions":' || p
  || ',"oldest_partition_age":{{"days":' || CAST((t - oldest) // 86400 AS VARCHAR)
  || ',"hours":' || CAST(((t - oldest) // 3600) % 24 AS VARCHAR)
  || ',"minutes":' || CAST(((t - oldest) // 60) % 60 AS VARCHAR) || ',"seconds":' || CAST((t - oldest) % 60 AS VARCHAR)
  || '}},"newest_partition_age":{{"days":' || CAST((t - newest) // 86400 AS VARCHAR)
  || ',"hours":' || CAST(((t - newest) // 3600) % 24 AS VARCHAR)
  || ',"minutes":' || CAST(((t - newest) // 60) % 60 AS VARCHAR) || ',"seconds":' || CAST((t - newest) % 60 AS VARCHAR)
  || '}},"last_update":' || CAST(newest AS VARCHAR) || ',"is_empty":false,"total_message_count":' || CAST(total AS VARCHAR)
  || ',"slice":0,"slices":1}}' AS document
FROM otopic JOIN parts ON name = topic WHERE contains(name, '-1')""",
        "scan_summary": """SELECT count(*) AS total_topics,
  count(*) FILTER (WHERE contains(lower(name), 'cust-1')) AS match_count,
  count(*) FILTER (WHERE contains(lower(name), 'cust-1') AND status = 'unused') AS unused_count FROM ostatus""",
        "name_match_class": "SELECT name FROM otopic WHERE regexp_matches(name, 'cust-[[&&1]+[^*+&&1]*$')",
        "topic_search_unicode": "SELECT name FROM otopic WHERE regexp_matches(translate(name, '24679', 'ÄäÖéЖ'), '(?i)CUST-[0-9]*[äж]+[0-9Ö]*É$')",
        "name_match_prefix": "SELECT name FROM otopic WHERE starts_with(name, 'orders.cust-2')",
        "name_match_substring": "SELECT name FROM otopic WHERE contains(lower(name), 'cust-3')",
        "name_match_regex": "SELECT name FROM otopic WHERE regexp_matches(name, 'cust-(?:1|2)[0-9]*5$')",
        "topic_search": "SELECT name FROM otopic WHERE regexp_matches(name, 'ORDERS[.]cust-[0-9]*7$', 'i')",
        "changelog_records": """SELECT topic AS key, '{"version":1,"topic":"' || topic || '","timestamp":1706659200,"partitions":{'
  || string_agg('"' || CAST(part AS VARCHAR) || '":{"partition":' || CAST(part AS VARCHAR) || ',"offset":'
     || CAST(off AS VARCHAR) || ',"timestamp":' || CAST(ts AS VARCHAR) || ',"is_empty":false,"scanned_at":'
     || CAST(ts AS VARCHAR) || ',"message_count":' || CAST(off AS VARCHAR) || '}', ',' ORDER BY part) || '}}' AS value
FROM ostate GROUP BY topic""",
        "changelog_one_topic": """SELECT topic AS key, '{"version":1,"topic":"' || topic || '","timestamp":1706659200,"partitions":{'
  || string_agg('"' || CAST(part AS VARCHAR) || '":{"partition":' || CAST(part AS VARCHAR) || ',"offset":'
     || CAST(off AS VARCHAR) || ',"timestamp":' || CAST(ts AS VARCHAR) || ',"is_empty":false,"scanned_at":'
     || CAST(ts AS VARCHAR) || ',"message_count":' || CAST(off AS VARCHAR) || '}', ',' ORDER BY part) || '}}' AS value
FROM ostate WHERE topic = 'orders.cust-7' GROUP BY topic""",
        "changelog_wide_compacted": f"""SELECT 'orders.all' AS topic, {_WIDE} FROM orders""",
        "changelog_wide_regrown": f"""SELECT 'orders.all' AS topic, {_WIDE}, log
FROM orders, (VALUES ('compacted'), ('whole')) AS logs (log) WHERE o_orderkey < 100 OR o_orderkey % 15000 < 7""",
        "changelog_wide_replaced": """SELECT 'orders.a' AS topic, CAST(n_nationkey AS INTEGER) AS partition,
  CAST(n_regionkey AS BIGINT) AS "offset", CAST(1706659200 AS BIGINT) AS "timestamp", false AS is_empty,
  CAST(1706659200 AS BIGINT) AS scanned_at, CAST(n_regionkey AS BIGINT) AS message_count FROM nation""",
        "changelog_encode_replay": _REPLAY + f"""
SELECT {_STATE_COLUMNS}, CAST({_AS_OF} AS BIGINT) AS last_update FROM replayed""",
        "changelog_merge": _MERGE + f"\nSELECT {_STATE_COLUMNS} FROM merged",
        "changelog_merge_topics": _MERGE + """,
last_alive AS (SELECT topic, max(n) AS n FROM alive GROUP BY topic)
SELECT a.topic AS name, CAST(count(m.topic) AS INTEGER) AS partition_count,
  CAST(coalesce(sum(m.cnt), 0) AS BIGINT) AS total_message_count,
  CAST(1704067200 + max(a.n) * 86400 AS BIGINT) AS last_update
FROM last_alive a LEFT JOIN merged m ON a.topic = m.topic GROUP BY a.topic""",
        "state_merge": _state(30, "cur") + _state(26, "inc") + """,
both_sides AS (
  SELECT *, 0 AS side FROM cur UNION ALL SELECT *, 1 AS side FROM inc)
SELECT topic, part AS partition, off AS "offset", ts AS "timestamp", is_empty, scanned_at, cnt AS message_count
FROM both_sides QUALIFY row_number() OVER (PARTITION BY topic, part ORDER BY scanned_at DESC, side DESC) = 1""",
        "changelog_profile": """,
last_rec AS (SELECT topic, arg_max(tomb, n) AS gone FROM recs WHERE NOT bad GROUP BY topic),
fin AS (SELECT count(*) AS topics FROM last_rec WHERE NOT gone),
tot AS (SELECT count(*) AS total, count(*) FILTER (WHERE tomb) AS tombs, count(*) FILTER (WHERE bad) AS bad,
               count(DISTINCT topic) AS keys FROM recs),
hbs AS (SELECT count(*) AS c FROM hb)
SELECT total + c AS total_records, tombs AS tombstone_records, c AS heartbeat_records, total AS topic_state_records,
       bad AS malformed_records, keys + c AS unique_keys, topics AS final_topics, c AS final_instances,
       total - keys AS duplicate_key_records, total - topics AS discarded_records
FROM tot, fin, hbs""",
        "partitions_with_data": f"""SELECT count(DISTINCT {_shard('topic', '0')}) AS partitions_with_data FROM recs""",
        "resume_offsets": f""",
ends AS (SELECT {_shard('topic', '0')} AS partition, off FROM recs UNION ALL SELECT CAST(p AS INTEGER), -1 FROM range(8) t(p))
SELECT partition, max(off) + 1 AS next_offset FROM ends GROUP BY partition""",
        "heartbeat_liveness": """SELECT instance_id, last_heartbeat_at, heartbeat_interval_sec, 0 AS scan_interval_sec,
  group_id, assigned_shards, is_active FROM hb_live""",
        "instance_prune": """SELECT 'tracker-instance:' || instance_id AS key, true AS is_tombstone
FROM hb_live WHERE NOT is_active""",
        "live_instances": "SELECT instance_id, group_id, assigned_shards FROM hb_live WHERE is_active",
        "active_instances": "SELECT count(*) AS active_instances FROM hb_live WHERE is_active",
        "shard_assign": f"SELECT topic, part AS partition, {_shard('topic', 'part')} AS shard FROM ostate",
        "shard_balance": f"""SELECT {_shard('topic', 'part')} AS shard, count(*) AS partitions
FROM ostate GROUP BY 1""",
        "shard_skew": f""",
b AS (SELECT {_shard('topic', 'part')} AS shard, count(*) AS c FROM ostate GROUP BY 1)
SELECT count(*) AS shards, min(c) AS min_partitions, max(c) AS max_partitions,
       round(stddev_pop(c), 6) AS stddev_partitions FROM b""",
        "owned_partitions": f""",
s AS (SELECT topic, part AS partition, {_shard('topic', 'part')} AS shard FROM ostate)
SELECT * FROM s WHERE shard IN (2, 5)""",
        "topic_configs": "SELECT topic, name, value FROM cfg WHERE value IS NOT NULL AND name IN ('cleanup.policy', 'segment.ms')",
        "config_audit": _AUDIT + """
SELECT topic, name, severity, problem, coalesce(actual, '') AS actual, recommended FROM findings""",
        "config_audit_summary": _AUDIT + """
SELECT name, severity, problem, count(*) AS topics FROM findings GROUP BY ALL""",
        "stream_merge": _MERGE + f"\nSELECT {_STATE_COLUMNS} FROM merged",
        "stream_merge_tables": _MERGE + f"\nSELECT {_STATE_COLUMNS} FROM merged",
        "stream_heartbeats": """SELECT instance_id, last_heartbeat_at, heartbeat_interval_sec, 0 AS scan_interval_sec,
  group_id, assigned_shards, is_active FROM hb_live WHERE CAST(substr(instance_id, 6) AS BIGINT) % 9 <> 0""",
        "stream_scan": _state(30) + f"\nSELECT {_STATE_COLUMNS} FROM state",
        "stream_merge_by_offset": _MERGE + f"\nSELECT {_STATE_COLUMNS} FROM merged",
        "stream_merge_resumed": _MERGE + f"\nSELECT {_STATE_COLUMNS} FROM merged",
        "stream_heartbeats_resumed": """SELECT instance_id, last_heartbeat_at, heartbeat_interval_sec, 0 AS scan_interval_sec,
  group_id, assigned_shards, is_active FROM hb_live WHERE CAST(substr(instance_id, 6) AS BIGINT) % 9 <> 0""",
        "stream_scan_lost_rows": _state(29) + f"\nSELECT {_STATE_COLUMNS} FROM state",
        "stream_scan_ledger": """SELECT scan_time, CASE WHEN n = 13 THEN 'given up' ELSE 'folded' END AS status, count(*) AS expected
FROM listing WHERE n <= 30 GROUP BY ALL""",
        "stream_scan_split": _state(30) + f"\nSELECT {_STATE_COLUMNS} FROM state",
        "stream_scan_resumed": _state(30) + f"\nSELECT {_STATE_COLUMNS} FROM state",
        "state_from_intervals": _state(10, "s10") + _state(20, "s20") + _state(30, "s30") + "".join(
            f"{' UNION ALL' if n > 10 else ''}\nSELECT {_STATE_COLUMNS}, {n} AS n FROM s{n}" for n in (10, 20, 30)),
        "changelog_profile_merged": """SELECT count(*) AS total_records, count(*) FILTER (WHERE tomb) AS tombstone_records,
  CAST(0 AS BIGINT) AS heartbeat_records, count(*) AS topic_state_records, count(*) FILTER (WHERE bad) AS malformed_records,
  true AS keys_are_close FROM recs""",
        "stream_scan_log": _state(10, "s10") + _state(20, "s20") + _state(30, "s30") + "".join(
            f"{' UNION ALL' if n > 10 else ''}\nSELECT {_STATE_COLUMNS}, {n} AS n FROM s{n}" for n in (10, 20, 30)),
        "stream_scan_replay": _state(30) + f"\nSELECT {_STATE_COLUMNS} FROM state",
    }
    common = {name: _COMMON.strip() for name in names} | {"stream_scan_lost_rows": _without_scan(13)}
    return {name: common[name] + body if body.startswith(",") else common[name] + "\n" + body for name, body in names.items()}
