"""The registered queries in DuckDB SQL, written from the semantics alone."""

import re

# Derived tables, by name; each may use the ones before it.
_TABLES = {
    "fs": """
SELECT node_name, mount_point, b * 4096 AS total_bytes, b * 4096 - f * 4096 AS used_bytes,
  f * 95 // 100 * 4096 AS avail_bytes,
  CASE WHEN b > 0 THEN (b * 4096 - f * 4096)::DOUBLE / (b * 4096)::DOUBLE * 100.0 ELSE 0.0 END AS used_percent,
  ts AS collected_at, event_id AS seq
FROM (SELECT *, 'node-' || (user_id % 4) AS node_name, '/mnt/' || (user_id // 4) AS mount_point,
        event_id % 50 * 262144 AS b, (event_id % 50 * 262144 * (event_id % 11)) // 10 AS f
      FROM events WHERE event_id % 97 <> 0)""",
    "fs_last": """
SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY node_name, mount_point ORDER BY seq DESC) = 1""",
    "ps": """
SELECT 'node-' || (user_id % 4) AS node_name, date_diff('day', DATE '1970-01-01', ts::DATE) AS snapshot_id,
  event_id + 1 AS pos, user_id AS pid,
  CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type || (event_id % 5)
    WHEN 2 THEN (event_id % 8) || ':1]' ELSE event_type END AS name,
  'u' || (user_id % 7) AS "user",
  CASE WHEN event_id % 13 = 0 THEN 0.0::DOUBLE ELSE ((event_id % 100) || '.' || (event_id % 10))::DOUBLE END AS cpu_percent,
  CASE WHEN event_id % 23 = 0 THEN 0 ELSE event_id * 4096 END AS mem_rss,
  CASE event_id % 9 WHEN 0 THEN 'running' WHEN 1 THEN 'sleeping' WHEN 2 THEN 'disk-wait' WHEN 3 THEN 'zombie'
    WHEN 4 THEN 'stopped' WHEN 5 THEN 'sleeping' WHEN 7 THEN 'sleeping' ELSE 'other' END AS status,
  CASE WHEN event_id % 3 = 2 THEN (event_id % 9) || '-' ELSE '' END
    || CASE WHEN event_id % 3 >= 1 THEN lpad((event_id % 24)::VARCHAR, 2, '0') || ':' ELSE '' END
    || lpad((event_id % 60)::VARCHAR, 2, '0') || ':' || lpad((event_id % 59)::VARCHAR, 2, '0') AS elapsed,
  ts AS collected_at, event_id
FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0""",
    "ps_last": """
SELECT * EXCLUDE (event_id, newest) FROM (
  SELECT *, max(snapshot_id) OVER (PARTITION BY node_name) AS newest FROM ps) WHERE snapshot_id = newest
QUALIFY row_number() OVER (PARTITION BY node_name, pid ORDER BY pos DESC) = 1""",
    "proc_spec": """
SELECT 'node-' || n AS node_name, n, CASE WHEN n = 0 THEN 50 ELSE n * 3 END::INTEGER AS top_n
FROM (SELECT DISTINCT user_id % 4 AS n FROM events)""",
    "proc_match": """
SELECT ps.*, top_n FROM ps JOIN proc_spec USING (node_name)
WHERE CASE n WHEN 0 THEN contains(lower(name), 'click') OR name LIKE 'view_'
  WHEN 1 THEN name LIKE '%:1]' OR name LIKE 'sign%' WHEN 2 THEN true ELSE contains(lower(name), 'err') END""",
    "mounts": """
SELECT 'node-' || (p_partkey % 3) AS node_name, p_brand AS capture_id, p_partkey AS pos,
  '/dev/sd' || p_size AS device, '/mnt/' || p_partkey AS mount_point, p_type,
  p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_brand <> 'Brand#3' AS real
FROM part""",
    "loglines": r"""
SELECT node_name, doc_id * 100000 + i - 1 AS id, source AS log_name, '/var/log/' || source || '.log' AS log_path,
  lines[i] AS line, TIMESTAMP '2024-01-01' + to_hours((doc_id % 1000)::INTEGER) AS created_at
FROM (SELECT *, 'node-' || (doc_id % 4) AS node_name, unnest(range(1, len(lines) + 1)) AS i
      FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents))
WHERE lines[i] <> ''""",
    "files": r"""
SELECT page_id, 'node-' || (page_id % 2) AS node_name,
  rtrim(string_split(string_split('/' || string_split(url, '://')[2], '?')[1], '#')[1], '/') AS path,
  length(html) AS size, TIMESTAMP '2024-01-01' + to_seconds(page_id % 1000000) AS mtime
FROM pages""",
    "inventory": """
SELECT node_name, path, bool_or(above) AS is_dir,
  CASE WHEN bool_or(above) THEN 0 ELSE max(CASE WHEN above THEN 0 ELSE size END) END AS size, max(mtime) AS mtime
FROM (SELECT node_name, size, mtime, array_to_string(parts[1:i], '/') AS path, i < len(parts) AS above
      FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS i
            FROM (SELECT *, string_split(path, '/') AS parts FROM files)))
GROUP BY ALL""",
    "roots": """
SELECT DISTINCT node_name, unnest(['/', array_to_string(parts[1:2], '/'),
  array_to_string(parts[1:3], '/') || '/', '/missing']) AS path
FROM (SELECT *, string_split(path, '/') AS parts FROM files)""",
    "below": """
SELECT r.node_name, r.path, i.path AS entry, i.is_dir, i.size,
  substr(i.path, length(rtrim(r.path, '/')) + 2) AS rel,
  (length(i.path) - length(replace(i.path, '/', ''))) - (length(r.path) - length(replace(r.path, '/', ''))) AS depth,
  length(r.path) % 3 AS k
FROM roots r JOIN inventory i
  ON i.node_name = r.node_name AND starts_with(i.path, rtrim(r.path, '/') || '/')""",
    "found": """
SELECT r.node_name, r.path, count(i.path) > 0 AS root_found FROM roots r LEFT JOIN inventory i
  ON i.node_name = r.node_name AND (i.path = rtrim(r.path, '/') OR starts_with(i.path, rtrim(r.path, '/') || '/'))
GROUP BY ALL""",
    "folders": """
SELECT d.node_name, d.path, sum(f.size)::BIGINT AS size
FROM (SELECT node_name, path FROM inventory WHERE is_dir UNION ALL SELECT DISTINCT node_name, '' FROM inventory) d
JOIN inventory f ON f.node_name = d.node_name AND NOT f.is_dir AND starts_with(f.path, d.path || '/')
GROUP BY ALL""",
    "stats": """
SELECT 'node-' || (o_custkey % 4) AS node_name, '/data/' || lpad(o_orderkey::VARCHAR, 12, '0') AS path,
  o_custkey * 10 AS file_count, o_custkey AS dir_count, o_custkey * 37 % 60000 AS scan_duration_ms,
  CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'SCANNING' ELSE 'ERROR' END AS status,
  CASE o_orderstatus WHEN 'P' THEN 'permission denied' ELSE '' END AS error_message,
  o_orderdate AS collected_at, o_orderkey AS seq
FROM orders""",
    "requested": """
SELECT l_orderkey AS pos, '/data/' || lpad((min(l_partkey) * 11)::VARCHAR, 12, '0') AS path
FROM lineitem GROUP BY l_orderkey""",
    "feeds": "SELECT 'node-' || (user_id % 4) AS node_name, event_type AS feed, ts AS collected_at FROM events",
    "feed_spec": """
SELECT DISTINCT node_name, feed, CASE WHEN feed = 'error' THEN 0 ELSE (right(node_name, 1)::BIGINT + 1) * 600000 END AS interval_ms FROM feeds
UNION ALL SELECT DISTINCT node_name, 'nothing', 60000 FROM feeds""",
    "outages": """
SELECT node_name, feed, outage_from, outage_to, silent // 1000000 AS silent_sec,
  silent // (interval_ms * 1000) - CASE WHEN outage_to IS NOT NULL AND silent % (interval_ms * 1000) = 0 THEN 1 ELSE 0 END AS missed
FROM (SELECT *, epoch_us(coalesce(outage_to, TIMESTAMP '2024-01-31')) - epoch_us(outage_from) AS silent
      FROM (SELECT node_name, feed, collected_at AS outage_from, lead(collected_at) OVER (PARTITION BY node_name, feed ORDER BY collected_at) AS outage_to FROM feeds))
JOIN feed_spec USING (node_name, feed) WHERE interval_ms > 0 AND silent > interval_ms * 3000""",
    "transfers": """
SELECT 'node-' || (o_custkey % 4) AS node_name, o_orderkey AS id,
  o_orderdate + to_seconds(o_orderkey % 86400) AS log_time,
  '10.0.' || (o_custkey % 256) || '.7' AS remote_host, 'user' || (o_custkey % 50) AS username,
  '/srv/' || substr(o_orderpriority, 1, 1) || '_' || o_orderkey || '.csv' AS filename,
  o_orderkey * 1000 AS bytes, o_orderkey % 100 AS transfer_time_sec,
  ['download', 'upload', 'delete'][o_orderkey % 3 + 1] AS direction,
  ['complete', 'incomplete'][o_orderkey % 2 + 1] AS status
FROM orders WHERE o_orderkey % 29 <> 0""",
}

_LEVELS = """CASE WHEN {v} > {hi} THEN 'critical' WHEN {v} > {lo} THEN 'warning' ELSE '{calm}' END"""
_SEVERITY = _LEVELS.format(v="used_percent", hi=90, lo=75, calm="ok")

_SUMMARY = """count(*) AS mounts, sum(total_bytes)::BIGINT AS total_bytes, sum(used_bytes)::BIGINT AS used_bytes,
  sum(avail_bytes)::BIGINT AS avail_bytes, CASE WHEN sum(total_bytes) > 0
    THEN sum(used_bytes)::BIGINT::DOUBLE / sum(total_bytes)::BIGINT::DOUBLE * 100.0 ELSE 0.0 END AS used_percent"""

# Mounts of each capture given which lines count; '/' where none does.
_MOUNTS = """
WITH good AS (SELECT * FROM mounts WHERE {good}),
first AS (SELECT node_name, capture_id, device, {mount} AS mount_point, pos FROM good
  QUALIFY row_number() OVER (PARTITION BY node_name, capture_id, device ORDER BY pos) = 1)
SELECT * FROM first UNION ALL
SELECT DISTINCT node_name, capture_id, NULL::VARCHAR, '/', NULL::BIGINT FROM mounts m
WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.node_name = m.node_name AND g.capture_id = m.capture_id)"""

_COUNTS = """
SELECT r.node_name, r.path, coalesce(file_count, 0) AS file_count, coalesce(dir_count, 0) AS dir_count,
  root_found, 'OK' AS status
FROM found r LEFT JOIN (SELECT node_name, path, count(*) FILTER (NOT is_dir) AS file_count,
  count(*) FILTER (is_dir) AS dir_count FROM below WHERE {kept} GROUP BY ALL) c USING (node_name, path)"""
_DEPTH = "(k = 0 OR depth <= k)"
_EXCLUDE = r"""NOT CASE k WHEN 0 THEN regexp_matches('/' || rel || '/', '/[^/]*\.html/') OR contains('/' || rel || '/', '/en/')
  WHEN 1 THEN regexp_matches('/' || rel || '/', '/[0-4]|/d[^/]/') ELSE regexp_matches('/' || rel || '/', '/[^0-6/][^/][^/]/') END"""

_KEEP_20 = """SELECT node_name, log_name, id FROM loglines
QUALIFY row_number() OVER (PARTITION BY node_name, log_name ORDER BY id DESC) <= 20"""

_ORDER = "SELECT o_orderkey, {text} AS text FROM (SELECT o_orderkey, {n} AS n FROM orders)"


def _ladder(units: list[str], places: int) -> str:
    arms = "".join(
        f" WHEN n < {1024 ** (p + 1)} THEN printf('%.{places}f', n::DOUBLE / {1024 ** p}.0::DOUBLE) || ' {u}'"
        for p, u in enumerate(units[:-1], start=1)
    )
    last = f" ELSE printf('%.{places}f', n::DOUBLE / {1024 ** len(units)}.0::DOUBLE) || ' {units[-1]}'"
    return f"CASE WHEN n < 1024 THEN n || ' B'{arms}{last} END"


_BYTES = _ladder(["KB", "MB", "GB", "TB", "PB", "EB"], 2)
_FILE_SIZE = f"CASE WHEN n = 0 THEN '-' ELSE {_ladder(['KB', 'MB', 'GB'], 1)} END"

_QUERIES = {
    "fs_usage_derive": "SELECT * FROM fs",
    "fs_latest": "SELECT * FROM fs_last",
    "fs_list": "SELECT node_name, mount_point, total_bytes, used_bytes FROM fs_last",
    "fs_summary": f"SELECT {_SUMMARY} FROM fs_last",
    "fs_summary_by_node": f"""SELECT *, {_SEVERITY} AS severity
FROM (SELECT node_name, {_SUMMARY} FROM fs_last GROUP BY node_name)""",
    "fs_severity": f"SELECT seq, {_SEVERITY} AS severity FROM fs",
    "fs_read_landed": "SELECT * FROM fs",
    "mount_real_disks": """SELECT pos, device, CASE p_type WHEN 'SMALL' THEN 'overlay' ELSE 'ext4' END AS fstype
FROM mounts WHERE real AND p_type <> 'PROMO'""",
    "mount_parse": _MOUNTS.format(good="real AND p_type NOT IN ('PROMO')", mount="mount_point"),
    "mount_parse_bsd": _MOUNTS.format(good="real", mount="mount_point || ' on (x)'"),
    "mount_first_device": _MOUNTS.format(
        good="real AND pos % 3 <> 0", mount="mount_point || ' on (x)'"
    ),
    "ps_parse": "SELECT * EXCLUDE (event_id) FROM ps",
    "proc_glob_filter": """SELECT node_name, pos, name FROM ps
WHERE name LIKE 'view_' OR contains(lower(name), 'purchase') OR name LIKE '%:1]'""",
    "proc_spec_globs": "SELECT node_name, pos, name, top_n FROM proc_match",
    "proc_first_n": """SELECT node_name, snapshot_id, pos, pid FROM ps
QUALIFY row_number() OVER (PARTITION BY node_name, snapshot_id ORDER BY pos) <= 20""",
    "proc_spec_first_n": """SELECT node_name, snapshot_id, pos, name FROM proc_match
QUALIFY row_number() OVER (PARTITION BY node_name, snapshot_id ORDER BY pos) <= top_n""",
    "proc_snapshot_latest": "SELECT * FROM ps_last",
    "proc_list": "SELECT node_name, pid, cpu_percent FROM ps_last",
    "top_cpu": "SELECT pid, name, cpu_percent FROM ps_last ORDER BY cpu_percent DESC, pid LIMIT 10",
    "top_mem": "SELECT pid, name, mem_rss FROM ps_last ORDER BY mem_rss DESC, pid LIMIT 10",
    "top_cpu_per_node": """SELECT node_name, row_number() OVER (PARTITION BY node_name ORDER BY cpu_percent DESC, pid)::INTEGER AS rank,
  pid, cpu_percent FROM ps_last QUALIFY rank <= 10""",
    "proc_state_map": """SELECT o_orderkey, CASE WHEN c = '' THEN 'unknown' WHEN c = 'R' THEN 'running'
  WHEN c IN ('S', 'I') THEN 'sleeping' WHEN c = 'D' THEN 'disk-wait' WHEN c = 'Z' THEN 'zombie'
  WHEN c = 'T' THEN 'stopped' ELSE 'other' END AS state
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN ''
  ELSE substr('RSDZTIt' || substr(o_orderpriority, 3), (o_orderkey % 9 + 1)::INTEGER, 1) END AS c FROM orders)""",
    "cpu_delta": """SELECT node_name, pid, collected_at, p AS prev_cpu_time_ms,
  CASE WHEN c - p >= 0 AND w > 0 THEN (c - p)::DOUBLE * 1000.0::DOUBLE / w::DOUBLE * 100.0::DOUBLE END AS cpu_delta_percent
FROM (SELECT node_name, pid, collected_at, c, lag(c) OVER s AS p, epoch_us(collected_at) - epoch_us(lag(collected_at) OVER s) AS w
  FROM (SELECT 'node-' || (user_id % 4) AS node_name, user_id AS pid, ts AS collected_at,
    event_id * 50 + event_id % 5 * 1000 AS c FROM events)
  WINDOW s AS (PARTITION BY node_name, pid ORDER BY collected_at))""",
    "runtime_sec": """SELECT node_name, pos, CASE WHEN event_id % 3 = 2 THEN event_id % 9 * 86400 ELSE 0 END
  + CASE WHEN event_id % 3 >= 1 THEN event_id % 24 * 3600 ELSE 0 END + event_id % 60 * 60 + event_id % 59 AS runtime_sec FROM ps""",
    "log_lines": "SELECT * FROM loglines",
    "log_read_files": """SELECT node_name, log_name, line, reader FROM loglines
CROSS JOIN (VALUES ('text'), ('tail')) r(reader)""",
    "log_by_name": "SELECT id, line FROM loglines WHERE log_name = 'src5'",
    "log_tail_one": "SELECT id, line FROM loglines WHERE log_name = 'src3' ORDER BY id DESC LIMIT 50",
    "log_tail_all": "SELECT id, log_name, line FROM loglines ORDER BY id DESC LIMIT 200",
    "log_keep_last_n": _KEEP_20,
    "log_keep_last_per_spec": """SELECT node_name, log_name, id FROM loglines
QUALIFY row_number() OVER (PARTITION BY node_name, log_name ORDER BY id DESC) <=
  CASE WHEN substr(log_name, 4)::INTEGER % 5 * 3 - 3 > 0 THEN substr(log_name, 4)::INTEGER % 5 * 3 - 3 ELSE 1000 END OR log_name = 'src7'""",
    "log_search": r"SELECT id, line FROM loglines WHERE regexp_matches(line, '[0-9]{3}.*\.$')",
    "log_line_counts": "SELECT node_name, log_name, count(*) AS line_count FROM loglines GROUP BY ALL",
    "log_files": f"""SELECT * EXCLUDE (n), n AS size, {_FILE_SIZE} AS size_text,
  coalesce(strftime(mod_time, '%Y-%m-%d %H:%M:%S'), '-') AS time_text
FROM (SELECT f.node_name, 'log' || page_id AS name, w AS path,
    CASE WHEN page_id % 3 = 0 THEN 1000 ELSE page_id % 3 * 100 END::INTEGER AS max_lines,
    coalesce(i.size, 0) AS n, i.mtime AS mod_time
  FROM (SELECT *, CASE WHEN page_id % 3 = 0 THEN path || '.gone' ELSE path END AS w FROM files) f
  LEFT JOIN inventory i ON NOT i.is_dir AND i.node_name = f.node_name AND i.path = f.w)""",
    "retention": """SELECT id, created_at FROM loglines WHERE created_at >= TIMESTAMP '2024-01-23 10:07:30'
ORDER BY id DESC LIMIT 1500""",
    "stored_retention": """SELECT log_name, id, created_at FROM loglines WHERE created_at::DATE >= DATE '2024-01-10'
QUALIFY row_number() OVER (ORDER BY created_at::DATE DESC, log_path DESC, id DESC) <= 1500""",
    "inventory_read": "SELECT node_name, path, is_dir, size, 1::BIGINT AS snapshot_id FROM inventory",
    "inventory_files": """
SELECT '/' || source || '/' || lang || '/' || ['.', '_', ''][doc_id % 3 + 1] || doc_id || '.txt' AS path, false AS is_dir, strlen(text)::BIGINT AS size FROM documents
UNION ALL SELECT DISTINCT '/' || source || '/' || lang, true, NULL FROM documents
UNION ALL SELECT DISTINCT '/' || source, true, NULL FROM documents""",
    "json_full_list": """SELECT '{"path":"' || path || '","file_count":' || file_count || ',"dir_count":' || dir_count
  || ',"status":"' || status || '"}' AS json FROM stats""",
    "retention_per_log": """SELECT log_name, id FROM loglines WHERE created_at >= TIMESTAMP '2024-01-10 10:07:30'
QUALIFY row_number() OVER (PARTITION BY log_name ORDER BY id DESC) <= 100""",
    "path_counts": _COUNTS.format(kept="true"),
    "path_counts_depth": _COUNTS.format(kept=_DEPTH),
    "path_counts_exclude": _COUNTS.format(kept=f"{_DEPTH} AND {_EXCLUDE}"),
    "path_under_roots": "SELECT node_name, path AS root, entry AS path, rel FROM below",
    "path_limit_depth": f"SELECT node_name, path AS root, entry AS path FROM below WHERE {_DEPTH}",
    "path_exclude": f"SELECT node_name, path AS root, entry AS path FROM below WHERE {_EXCLUDE}",
    "path_scan_status": """SELECT path, file_count,
  CASE WHEN scan_duration_ms > 30000 OR error_message <> '' THEN 'ERROR' ELSE 'OK' END AS status,
  CASE WHEN scan_duration_ms > 30000 THEN 'scan timeout exceeded' ELSE error_message END AS error_message FROM stats""",
    "path_latest": """SELECT 'node-' || (l_partkey % 4) AS node_name, '/parts/' || l_partkey AS path, q AS file_count,
  n AS dir_count, ['OK', 'SCANNING', 'ERROR'][l_orderkey % 3 + 1] AS status, l_orderkey AS seq
FROM (SELECT l_partkey, l_orderkey, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS q FROM lineitem GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC) = 1""",
    "path_lookup": "SELECT path, file_count, status FROM stats WHERE path = '/data/000000000042'",
    "path_list": "SELECT node_name, path, status FROM stats",
    "path_page": "SELECT path, file_count FROM stats ORDER BY path LIMIT 25 OFFSET 100",
    "path_page_after": "SELECT path, file_count FROM stats WHERE path > '/data/000000000099' ORDER BY path LIMIT 25",
    "path_count_total": "SELECT count(*) AS total FROM stats",
    "path_page_meta": 'SELECT count(*) AS total, 25 AS "limit", 100 AS "offset" FROM stats',
    "path_semi": "SELECT pos, path, file_count FROM requested JOIN stats USING (path)",
    "path_unknown": "SELECT pos, path FROM requested WHERE path NOT IN (SELECT path FROM stats)",
    "largest_files": """SELECT * FROM (
  SELECT node_name, path AS root, entry AS path, is_dir, size FROM below WHERE NOT is_dir UNION ALL
  SELECT b.node_name, b.path, entry, true, f.size FROM below b JOIN folders f
    ON f.node_name = b.node_name AND f.path = b.entry)
QUALIFY row_number() OVER (PARTITION BY node_name, root ORDER BY size DESC, path) <= 3""",
    "directory_sizes": "SELECT * FROM folders",
    "tree_sizes": "SELECT * FROM folders",
    "proc_pattern_pairs": """
SELECT name, c_custkey AS pattern_id FROM (SELECT DISTINCT name FROM ps), customer WHERE CASE c_custkey % 6
  WHEN 0 THEN contains(lower(name), 'click' || (c_custkey % 5)) WHEN 1 THEN name LIKE '%' || (c_custkey % 8) || ':1]' WHEN 2 THEN name LIKE 'vi_w'
  WHEN 3 THEN contains(lower(name), 'ign') WHEN 4 THEN name LIKE '_rr%' ELSE true END""",
    "inventory_scan": """SELECT source AS log_name, 1 + count(DISTINCT lang) AS dirs, true AS has_files
FROM documents GROUP BY source""",
    "spec_defaults": """SELECT 'node-' || o_custkey AS node_name, o_orderkey AS idx,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 * 10000 WHEN c_custkey % 4 > 0 THEN c_custkey % 4 * 30000 ELSE 60000 END AS scan_interval_ms,
  CASE WHEN o_orderkey % 4 = 0 THEN 10 ELSE o_orderkey % 4 END::INTEGER AS max_depth,
  CASE WHEN o_orderkey % 2 = 0 THEN 30000 ELSE 5000 END::BIGINT AS timeout_ms
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 10 <> 0""",
    "node_spec_defaults": """SELECT c_custkey AS config_id, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'node-' || c_custkey END AS node_name,
  CASE WHEN c_custkey % 2 = 0 THEN '0.0.0.0:8080' ELSE '10.0.0.1:' || (c_custkey % 1000) END AS listen,
  CASE WHEN c_custkey % 3 = 0 THEN 15000 ELSE c_custkey % 3 * 5000 END AS disk_interval_ms,
  CASE WHEN c_custkey % 4 = 0 THEN 60000 ELSE c_custkey % 4 * 30000 END AS path_interval_ms,
  CASE WHEN c_custkey % 5 = 0 THEN 10000 ELSE c_custkey % 5 * 1000 END AS process_interval_ms,
  CASE WHEN c_custkey % 6 = 0 THEN 2000 ELSE c_custkey % 6 * 500 END AS log_interval_ms
FROM customer""",
    "spec_violations": """SELECT config_id, arg_min(message, rank) AS message, count(*) AS violations FROM (
  SELECT c_custkey AS config_id, 0 AS rank, 'node_name is required' AS message FROM customer WHERE c_custkey % 10 = 0 UNION ALL
  SELECT c_custkey, 1, 'at least one path must be configured' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
  SELECT o_custkey, 2 + o_orderkey, 'path[' || o_orderkey || ']: path is required' FROM orders WHERE o_orderkey % 7 = 0)
GROUP BY config_id""",
    "client_spec_violations": """SELECT config_id, arg_min(message, rank) AS message, count(*) AS violations FROM (
  SELECT c_custkey AS config_id, 0 AS rank, 'at least one node must be configured' AS message FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
  SELECT o_custkey, 1 + 2 * o_orderkey, 'nodes[' || o_orderkey || ']: name is required' FROM orders WHERE o_orderkey % 9 = 0 UNION ALL
  SELECT o_custkey, 2 + 2 * o_orderkey, 'nodes[' || o_orderkey || ']: address is required' FROM orders WHERE o_orderkey % 5 = 0)
GROUP BY config_id""",
    "fmt_bytes": _ORDER.format(
        text=_BYTES,
        n="(o_custkey % 1500 + 1) * pow(1024, o_orderkey % 6)::BIGINT + o_orderkey % 1000",
    ),
    "fmt_file_size": _ORDER.format(
        text=_FILE_SIZE,
        n="o_custkey % 1500 * pow(1024, o_orderkey % 4)::BIGINT + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 1000 END",
    ),
    "fmt_duration": _ORDER.format(
        text="""CASE WHEN n < 1000 THEN n || 'ms' WHEN n < 60000 AND n % 1000 > 0 THEN printf('%.1fs', n::DOUBLE / 1000.0::DOUBLE)
  WHEN n < 60000 THEN (n // 1000) || 's' ELSE (n // 60000) || 'm' || (n // 1000 % 60) || 's' END""",
        n="o_custkey * 97 % 200000 - 50",
    ),
    "fmt_interval": _ORDER.format(
        text="""CASE WHEN n >= 3600000 THEN printf('%.0fh', n::DOUBLE / 3600000.0::DOUBLE)
  WHEN n >= 60000 THEN printf('%.0fm', n::DOUBLE / 60000.0::DOUBLE) ELSE printf('%.0fs', n::DOUBLE / 1000.0::DOUBLE) END""",
        n="o_custkey * o_orderkey % 20000000",
    ),
    "fmt_gauge": """SELECT event_id, '[' || repeat('█', f) || repeat('░', 20 - f) || '] ' || printf('%5.1f', p) || '%' AS text
FROM (SELECT event_id, p, trunc(p / 100.0::DOUBLE * 20.0::DOUBLE)::INTEGER AS f FROM (
  SELECT event_id, least(greatest(value / 4.0::DOUBLE - 5.0::DOUBLE, 0.0::DOUBLE), 100.0::DOUBLE) AS p FROM events))""",
    "fmt_number": _ORDER.format(text="format('{:,}', n)", n="o_custkey * o_orderkey - 1000000"),
    "fmt_time": """SELECT event_id, strftime(ts, '%H:%M:%S') AS clock,
  CASE WHEN event_id % 7 = 0 THEN '-' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp,
  (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) // 1000000 AS uptime_sec FROM events""",
    "sev_cpu": "SELECT event_id, "
    + _LEVELS.format(v="value / 5.0::DOUBLE", hi=80, lo=50, calm="normal")
    + " AS severity FROM events",
    "sev_state": """SELECT node_name, pos, CASE status WHEN 'running' THEN 'ok' WHEN 'zombie' THEN 'critical'
  WHEN 'stopped' THEN 'warning' ELSE 'neutral' END AS severity FROM ps""",
    "sev_status": """SELECT seq, CASE WHEN w IN ('OK', 'ok', 'connected') THEN 'ok' WHEN w IN ('SCANNING', 'WARNING', 'warning') THEN 'warning'
  WHEN w IN ('ERROR', 'error', 'CRITICAL', 'critical') THEN 'critical' ELSE 'neutral' END AS severity
FROM (SELECT seq, CASE WHEN seq % 2 = 0 THEN lower(status) ELSE status END AS w FROM stats)""",
    "json_rows": """SELECT '{"path":"' || path || '","file_count":' || file_count || ',"dir_count":' || dir_count
  || ',"status":"' || status || '"' || CASE WHEN error_message = '' THEN '' ELSE ',"error_message":"' || error_message || '"' END
  || '}' AS json FROM stats""",
    "json_page": """SELECT '{"data":[' || string_agg('{"path":"' || path || '","file_count":' || file_count
  || ',"status":"' || status || '"}', ',' ORDER BY path) || '],"meta":{"total":' || (SELECT count(*) FROM stats)
  || ',"limit":10,"offset":5}}' AS json FROM (SELECT * FROM stats ORDER BY path LIMIT 10 OFFSET 5)""",
    "transfer_parse": "SELECT * FROM transfers WHERE log_time >= TIMESTAMP '1996-01-01'",
    "transfer_page": """SELECT id, username, filename, bytes FROM transfers
WHERE username = 'user7' AND direction = 'upload' ORDER BY id LIMIT 20 OFFSET 3""",
    "transfer_from": "SELECT * EXCLUDE (id) FROM transfers WHERE log_time >= TIMESTAMP '1996-01-01'",
    "cron_parse": r"""
WITH cronlines AS (SELECT c_custkey AS k, 'node-' || (c_custkey % 4) AS node_name, '/cron/' || (c_custkey // 40) AS path,
  c_custkey % 3 AS v, CASE WHEN c_custkey % 3 = 0 THEN 'ops' || (c_custkey % 5) END AS m, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 7)::VARCHAR END AS l FROM customer)
SELECT node_name, path, pos, source, "user", schedule, command, input, MAILTO, LEVEL FROM (
  SELECT node_name, path, k * 3 + 1 AS pos, CASE WHEN k % 2 = 0 THEN 'system' ELSE 'user' END AS source,
    CASE WHEN k % 2 = 0 THEN 'u' || (k % 9) ELSE 'owner' || (k % 3) END AS "user",
    CASE WHEN k % 4 = 0 THEN '@daily' ELSE (k % 60) || ' ' || (k % 24) || ' * * *' END AS schedule,
    '/opt/job' || (k % 13) || ' --at %H' AS command, CASE WHEN k % 6 = 0 THEN 'first' || chr(10) || 'second' END AS input,
    last_value(m IGNORE NULLS) OVER w AS MAILTO, last_value(l IGNORE NULLS) OVER w AS LEVEL, k
  FROM cronlines WINDOW w AS (PARTITION BY node_name, path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE k % 11 <> 0""",
    "cron_missed_runs": """WITH jobs AS (SELECT c_custkey AS job_id, c_custkey % 8 AS k, c_custkey AS c FROM customer),
spec AS (SELECT job_id,
  CASE k WHEN 0 THEN '*/15 * * * *' WHEN 1 THEN (c % 60) || ' ' || (c % 24) || ' * * *' WHEN 2 THEN '0 0 ' || (c % 28 + 1) || ' * *'
    WHEN 3 THEN (c % 60) || ' 6 * * ' || (c % 7) WHEN 4 THEN '5,35 8-18/2 * ' || (c % 12 + 1) || ' *' WHEN 5 THEN '0 12 13 * FRI'
    WHEN 6 THEN '0 0 29 2 *' ELSE CASE WHEN c % 16 = 7 THEN '@daily' ELSE '61 x * * *' END END AS schedule,
  CASE k WHEN 0 THEN [0, 15, 30, 45] WHEN 1 THEN [c % 60] WHEN 3 THEN [c % 60] WHEN 4 THEN [5, 35] ELSE [0] END AS minutes,
  CASE k WHEN 0 THEN range(0, 24) WHEN 1 THEN [c % 24] WHEN 3 THEN [6] WHEN 4 THEN [8, 10, 12, 14, 16, 18] WHEN 5 THEN [12] ELSE [0] END AS hours,
  k, c FROM jobs),
kinds AS (SELECT DISTINCT schedule, minutes, hours, k,
  CASE k WHEN 2 THEN c % 28 + 1 WHEN 3 THEN c % 7 WHEN 4 THEN c % 12 + 1 WHEN 7 THEN c % 16 ELSE 0 END AS v FROM spec),
days AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-29', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS d),
fits AS (SELECT schedule, minutes, hours, d FROM kinds JOIN days ON CASE k WHEN 2 THEN day(d) = v WHEN 3 THEN dayofweek(d) = v
  WHEN 4 THEN month(d) = v WHEN 5 THEN day(d) = 13 OR dayofweek(d) = 5 WHEN 6 THEN day(d) = 29 AND month(d) = 2
  WHEN 7 THEN v = 7 ELSE true END),
runs AS (SELECT schedule, d + to_minutes(h * 60 + m) AS run_at FROM (
  SELECT schedule, d, minutes, unnest(hours) AS h FROM fits), (SELECT unnest(range(0, 60)) AS m) WHERE list_contains(minutes, m)),
due AS (SELECT DISTINCT job_id, run_at FROM spec JOIN runs USING (schedule)),
starts AS (SELECT o_custkey AS job_id, TIMESTAMP '2024-01-29' + to_hours((o_orderkey % 48)::INTEGER) + to_minutes((o_orderkey % 4 * 15)::INTEGER)
  + to_seconds(o_orderkey % 200) AS started_at FROM orders),
taken AS (SELECT s.job_id, max(d.run_at) AS run_at, s.started_at FROM starts s ASOF JOIN due d ON s.job_id = d.job_id AND s.started_at >= d.run_at GROUP BY s.job_id, s.started_at),
firsts AS (SELECT job_id, run_at, min(started_at) AS started_at FROM taken GROUP BY job_id, run_at)
SELECT job_id, run_at, started_at, CASE WHEN started_at IS NULL THEN 'missed' WHEN epoch_us(started_at) - epoch_us(run_at) >= 61000000 THEN 'late' ELSE 'ran' END AS outcome
FROM due LEFT JOIN firsts USING (job_id, run_at)""",
    "proc_lifetimes": """
WITH one AS (SELECT *, CASE WHEN event_id % 3 = 2 THEN event_id % 9 * 86400 ELSE 0 END
    + CASE WHEN event_id % 3 >= 1 THEN event_id % 24 * 3600 ELSE 0 END + event_id % 60 * 60 + event_id % 59 AS elapsed_sec
  FROM ps QUALIFY row_number() OVER (PARTITION BY node_name, snapshot_id, pid ORDER BY pos DESC) = 1),
placed AS (SELECT *, dense_rank() OVER (PARTITION BY node_name ORDER BY snapshot_id) AS nth FROM one),
paired AS (SELECT *, lag(nth) OVER w AS before, lag(elapsed_sec) OVER w AS elapsed_before, max(nth) OVER (PARTITION BY node_name) AS newest
  FROM placed WINDOW w AS (PARTITION BY node_name, pid ORDER BY snapshot_id)),
lives AS (SELECT *, sum(CASE WHEN before IS NULL OR nth > before + 1 OR elapsed_sec < elapsed_before THEN 1 ELSE 0 END)
  OVER (PARTITION BY node_name, pid ORDER BY snapshot_id)::BIGINT AS life FROM paired)
SELECT node_name, pid, life, max_by(name, snapshot_id) AS name, min(collected_at) AS first_seen, max(collected_at) AS last_seen,
  count(*) AS snapshots, max_by(elapsed_sec, snapshot_id) AS elapsed_sec, CASE WHEN max(nth) = any_value(newest) THEN 'RUNNING' ELSE 'STOPPED' END AS status
FROM lives GROUP BY node_name, pid, life""",
    "feed_outages": "SELECT node_name, feed, outage_from, outage_to, silent_sec, missed FROM outages",
    "collector_status": """
SELECT f.node_name, f.feed, f.interval_ms, max(s.collected_at) AS last_seen, count(s.collected_at) AS samples, any_value(coalesce(o.n, 0)) AS outages,
  any_value(coalesce(o.silent, 0))::BIGINT AS silent_sec,
  CASE WHEN max(s.collected_at) IS NULL THEN 'unseen' WHEN f.interval_ms > 0 AND any_value(age) > f.interval_ms * 3000 THEN 'down'
    WHEN f.interval_ms > 0 AND any_value(age) > f.interval_ms * 1000 THEN 'late' ELSE 'ok' END AS status
FROM feed_spec f LEFT JOIN (SELECT *, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(collected_at) OVER (PARTITION BY node_name, feed)) AS age FROM feeds) s USING (node_name, feed)
LEFT JOIN (SELECT node_name, feed, count(*) AS n, sum(silent_sec) AS silent FROM outages GROUP BY node_name, feed) o USING (node_name, feed)
GROUP BY f.node_name, f.feed, f.interval_ms""",
    "cron_next_runs": """WITH jobs AS (SELECT c_custkey AS job_id, c_custkey % 8 AS k, c_custkey AS c FROM customer),
spec AS (SELECT job_id,
  CASE k WHEN 0 THEN '*/15 * * * *' WHEN 1 THEN (c % 60) || ' ' || (c % 24) || ' * * *' WHEN 2 THEN '0 0 ' || (c % 28 + 1) || ' * *'
    WHEN 3 THEN (c % 60) || ' 6 * * ' || (c % 7) WHEN 4 THEN '5,35 8-18/2 * ' || (c % 12 + 1) || ' *' WHEN 5 THEN '0 12 13 * FRI'
    WHEN 6 THEN '0 0 29 2 *' ELSE CASE WHEN c % 16 = 7 THEN '@daily' ELSE '61 x * * *' END END AS schedule,
  CASE k WHEN 0 THEN [0, 15, 30, 45] WHEN 1 THEN [c % 60] WHEN 3 THEN [c % 60] WHEN 4 THEN [5, 35] ELSE [0] END AS minutes,
  CASE k WHEN 0 THEN range(0, 24) WHEN 1 THEN [c % 24] WHEN 3 THEN [6] WHEN 4 THEN [8, 10, 12, 14, 16, 18] WHEN 5 THEN [12] ELSE [0] END AS hours,
  k, c FROM jobs),
kinds AS (SELECT DISTINCT schedule, minutes, hours, k,
  CASE k WHEN 2 THEN c % 28 + 1 WHEN 3 THEN c % 7 WHEN 4 THEN c % 12 + 1 WHEN 7 THEN c % 16 ELSE 0 END AS v FROM spec),
days AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-30', TIMESTAMP '2032-03-01', INTERVAL 1 DAY)) AS d),
fits AS (SELECT schedule, minutes, hours, d FROM kinds JOIN days ON CASE k WHEN 2 THEN day(d) = v WHEN 3 THEN dayofweek(d) = v
  WHEN 4 THEN month(d) = v WHEN 5 THEN day(d) = 13 OR dayofweek(d) = 5 WHEN 6 THEN day(d) = 29 AND month(d) = 2
  WHEN 7 THEN v = 7 ELSE true END
  QUALIFY row_number() OVER (PARTITION BY schedule ORDER BY d) <= 2),
runs AS (SELECT schedule, d + to_minutes(h * 60 + m) AS run_at FROM (
  SELECT schedule, d, minutes, unnest(hours) AS h FROM fits), (SELECT unnest(range(0, 60)) AS m) WHERE list_contains(minutes, m)),
next AS (SELECT schedule, min(run_at) AS next_run FROM runs WHERE run_at > TIMESTAMP '2024-01-30 10:07:30' GROUP BY schedule)
SELECT job_id, schedule, next_run FROM spec LEFT JOIN next USING (schedule)""",
    "node_health": """SELECT node_name, last_seen, samples, age AS age_sec, CASE WHEN age > 3600 THEN 'stale' ELSE 'ok' END AS status
FROM (SELECT node_name, max(collected_at) AS last_seen, count(*) AS samples,
  (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(collected_at))) // 1000000 AS age FROM fs GROUP BY node_name)""",
    "fleet_union": "SELECT 'node-' || (user_id % 4) AS node_name, event_id, ts FROM events",
    "stream_latest": "SELECT * FROM fs_last",
    "stream_last_seen": "SELECT node_name, max(collected_at) AS last_seen FROM fs GROUP BY node_name",
    "stream_snapshot": "SELECT * FROM ps_last",
    "stream_trim": _KEEP_20,
    "stream_trim_state": _KEEP_20,
    "stream_heartbeat": "SELECT node_name, max(collected_at) AS last_seen, 'stale' AS status FROM fs GROUP BY node_name",
    "stream_latest_bounded": """
WITH parts AS (SELECT *, least((day(collected_at) - 1) // 8 + (seq % 50 = 0)::INTEGER, 4) AS part FROM fs),
marks AS (SELECT p.part, max(e.collected_at) - INTERVAL 1 HOUR AS mark FROM (SELECT DISTINCT part FROM parts) p
          JOIN (SELECT part, max(collected_at) AS collected_at FROM parts GROUP BY part) e
            ON e.part < p.part AND (e.part >= 3) = (p.part >= 3) GROUP BY p.part)
SELECT * EXCLUDE (part, mark) FROM parts LEFT JOIN marks USING (part)
WHERE mark IS NULL OR date_trunc('day', collected_at) + INTERVAL 1 DAY > mark
QUALIFY row_number() OVER (PARTITION BY node_name, mount_point ORDER BY seq DESC) = 1""",
    "stream_tail_replay": "SELECT node_name, log_name, line FROM loglines",
    "stream_tail_rotate": "SELECT node_name, log_name, line FROM loglines",
    "stream_tail_backlog": "SELECT node_name, log_name, line FROM loglines",
    "compacted_table": "SELECT * FROM fs",
}


def _with_tables(sql: str) -> str:
    """The query with the derived tables it needs in front, in order."""
    needed: list[str] = []
    for name in reversed(_TABLES):
        users = [sql, *(_TABLES[n] for n in needed)]
        if any(re.search(rf"\b(FROM|JOIN) {name}\b", text) for text in users):
            needed.insert(0, name)
    if not needed:
        return sql
    head = ",\n".join(f"{name} AS ({_TABLES[name].strip()})" for name in needed)
    own = re.match(r"\s*WITH ", sql)
    return f"WITH {head},\n{sql[own.end():]}" if own else f"WITH {head}\n{sql.strip()}"


def oracle_sql() -> dict[str, str]:
    return {name: _with_tables(sql) for name, sql in _QUERIES.items()}
