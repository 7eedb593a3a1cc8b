"""The same queries as SQL over the test tables, written independently of the Spark code."""

from __future__ import annotations

from .fleet import PARTITIONS

_AS_OF = "TIMESTAMP '2024-02-01'"


def _fleet(level: str) -> str:
    pu, join = ("p_brand", "JOIN part ON l_partkey = p_partkey") if level == "brand" else ("'PU_' || l_partkey", "")
    pus = (
        "SELECT p_brand AS pu, p_brand, count(*) AS planned FROM part GROUP BY p_brand"
        if level == "brand" else "SELECT 'PU_' || p_partkey AS pu, p_brand, CAST(p_size AS BIGINT) AS planned FROM part"
    )
    return f"""
f_nation AS (SELECT n_nationkey, n_regionkey, n_name AS host, '10.' || n_regionkey || '.0.' || n_nationkey AS addr
  FROM nation),
f_container AS (SELECT s_name AS container_id, s_suppkey + 1000 AS pid, host, addr,
  [r_name, 'RACK_' || (s_suppkey % 4), CASE WHEN s_acctbal >= 5000 THEN 'LARGE_HEAP' ELSE 'SMALL_HEAP' END] AS zones,
  TIMESTAMP '2024-01-01' + s_suppkey * INTERVAL 1 HOUR AS start_ts, r_name AS region, s_acctbal AS heap_mb, s_suppkey
  FROM supplier JOIN f_nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f_zone AS (SELECT container_id, unnest(zones) AS zone FROM f_container),
f_row AS (SELECT *, l_suppkey + CASE WHEN l_suppkey % 10 = 3 THEN 1 ELSE 0 END AS ckey FROM lineitem),
f_instance AS (SELECT
  l_orderkey || '~' || l_linenumber || '~' || l_partkey || '~' || l_suppkey || '~' || CAST(l_quantity AS INT) || '~'
    || CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS instance_id,
  {pu} AS pu, l_orderkey % {PARTITIONS[level]} AS partition_id, printf('Supplier#%09d', ckey) AS container_id,
  CASE WHEN ckey % 10 = 1 THEN 'BACKUP' WHEN ckey % 10 = 2 THEN 'PRIMARY' WHEN ckey % 10 = 4 THEN NULL
    WHEN l_returnflag = 'A' THEN 'PRIMARY' WHEN l_returnflag = 'R' THEN 'BACKUP' END AS mode,
  CASE WHEN l_linenumber = 7 THEN 'Mirror-space' ELSE 'space' END AS space_id FROM f_row {join}),
f_facts AS (SELECT instance_id, pu, partition_id, container_id, mode IS NOT NULL AND space_id = 'space' AS is_stateful,
  coalesce(mode = 'PRIMARY', false) AS is_primary, coalesce(mode = 'BACKUP', false) AS is_backup FROM f_instance),
f_pu0 AS (SELECT *, CAST(substr(p_brand, 7) AS INT) AS num FROM ({pus})),
f_pu AS (SELECT pu, planned, CASE WHEN num % 2 = 0 THEN ['LARGE_HEAP'] WHEN num % 4 = 3 THEN ['RACK_0', 'SMALL_HEAP']
  ELSE CAST([] AS VARCHAR[]) END AS required_zones, num % 5 = 0 AS requires_isolation FROM f_pu0),
f_manager AS (SELECT min(host) AS host, CAST(arg_min(n_nationkey, host) + 100 AS BIGINT) AS pid FROM f_nation
  GROUP BY n_regionkey),
f_agent AS (SELECT host, CAST(n_nationkey + 10 AS BIGINT) AS pid, n_regionkey + 1 AS required_managers FROM f_nation),
f_customer AS (SELECT * FROM customer JOIN f_nation ON c_nationkey = n_nationkey),
f_agent_process AS (
  SELECT host, pid, pid - 999 AS agent_id, 'GSC' AS service_type, 'ON_DEMAND' AS instantiation_mode
    FROM f_container
  UNION ALL SELECT host, pid, 0, 'GSM', 'STATIC' FROM f_manager
  UNION ALL SELECT host, c_custkey + 200000, c_custkey + 5001, 'GSC', 'ON_DEMAND' FROM f_customer),
f_jvm AS (
  SELECT host, pid, heap_mb AS heap, start_ts, region, 'GSC' AS component_type, 3 AS component_rank FROM f_container
  UNION ALL SELECT host, pid, 0, TIMESTAMP '2024-01-10', 'unknown', 'GSM', 2 FROM f_manager
  UNION ALL SELECT host, pid, 0, TIMESTAMP '2024-01-10', 'unknown', 'GSA', 1 FROM f_agent
  UNION ALL SELECT host, c_custkey + 200000, c_acctbal, TIMESTAMP '2024-01-10', 'unknown', 'UNKNOWN', 4 FROM f_customer),
f_layer AS (SELECT user_id AS entity, event_id % 5 AS layer, event_type AS key,
  CAST(max(CAST(json_extract_string(props, '$.k') AS INT) % 3) AS VARCHAR) AS value FROM events GROUP BY ALL),
f_ready AS (SELECT 'app_' || (user_id % 5) AS app, 'pu_' || (user_id % 25) AS pu, ts, event_id,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS delta FROM events),
f_elig AS (SELECT pu, c.* FROM f_pu, f_container c WHERE len(required_zones) = 0 OR list_has_any(required_zones, zones)),
f_load AS (SELECT c.*, n_container, CAST(sum(n_container) OVER (PARTITION BY host) AS BIGINT) AS n_machine FROM f_container c
  JOIN (SELECT c.container_id, count(i.instance_id) AS n_container FROM f_container c
    LEFT JOIN f_instance i ON i.container_id = c.container_id GROUP BY c.container_id) USING (container_id)),
f_key AS (SELECT container_id, 'ZONE' AS axis, zone AS key FROM f_zone
  UNION ALL SELECT container_id, 'MACHINE', host FROM f_container
  UNION ALL SELECT container_id, 'CONTAINER', container_id FROM f_container)
"""


_COUNTS = """
c_scoped AS (SELECT *, CAST(partition_id AS VARCHAR) AS scope FROM f_facts UNION ALL SELECT *, 'whole' FROM f_facts),
c_held AS (SELECT pu, scope, axis, key, count(*) AS total, count(*) FILTER (is_primary) AS "primary",
  count(*) FILTER (is_backup AND NOT is_primary) AS backup FROM c_scoped JOIN f_key USING (container_id) GROUP BY ALL),
c_potential AS (SELECT pu, axis, key, count(*) AS potential FROM f_elig JOIN f_key USING (container_id) GROUP BY ALL),
c_scope AS (SELECT DISTINCT pu, scope FROM c_scoped UNION SELECT pu, 'whole' FROM f_pu),
c_all AS (SELECT pu, scope, axis, key, coalesce(potential, 0) AS potential, coalesce(total, 0) AS total,
  coalesce("primary", 0) AS "primary", coalesce(backup, 0) AS backup
  FROM (SELECT * FROM c_potential JOIN c_scope USING (pu)) FULL JOIN c_held USING (pu, scope, axis, key)),
c_role AS (SELECT pu, scope, axis, key, role, n FROM (
  SELECT pu, scope, axis, key, potential, 'total' AS role, total AS n FROM c_all
  UNION ALL SELECT pu, scope, axis, key, potential, 'primary', "primary" FROM c_all
  UNION ALL SELECT pu, scope, axis, key, potential, 'backup', backup FROM c_all) WHERE potential > 0 OR n > 0)
"""

_RANGES = """
r_role AS (
  SELECT pu, scope, axis, key, potential > 0 AS usable, 'total' AS role, total AS n FROM c_all
  UNION ALL SELECT pu, scope, axis, key, potential > 0, 'primary', "primary" FROM c_all
  UNION ALL SELECT pu, scope, axis, key, potential > 0, 'backup', backup FROM c_all),
r_part AS (SELECT *, count(*) FILTER (n > 0) OVER (PARTITION BY pu, scope, axis, role ORDER BY key) AS part FROM r_role WHERE usable),
r_range AS (SELECT pu, scope, axis, role, key AS first_key, key AS last_key, 1 AS n_keys, n FROM r_role WHERE n > 0
  UNION ALL SELECT pu, scope, axis, role, min(key), max(key), count(*), 0 FROM r_part WHERE n = 0 GROUP BY pu, scope, axis, role, part)
"""

_BOUNDS = """min(n) AS "min", max(n) AS "max", arg_min(key, (n, key)) AS min_key, arg_min(key, (-n, key)) AS max_key,
  max(n) > min(n) + 1 AS needs_rebalancing"""

_COMMON = """
z_total AS (SELECT host, count(*) AS n_containers FROM f_container GROUP BY host),
z_shared AS (SELECT host, zone FROM f_container JOIN f_zone USING (container_id) JOIN z_total USING (host)
  GROUP BY host, zone, n_containers HAVING count(*) = n_containers),
z_common AS (SELECT host, n_containers, coalesce(string_agg(zone, ',' ORDER BY zone), '') AS common_zones
  FROM z_total LEFT JOIN z_shared USING (host) GROUP BY host, n_containers),
z_specific AS (SELECT c.container_id, z.zone FROM f_container c JOIN f_zone z ON z.container_id = c.container_id
  WHERE NOT EXISTS (SELECT 1 FROM z_shared s WHERE s.host = c.host AND s.zone = z.zone))
"""

_LABELS = """
l_primary AS (SELECT DISTINCT pu, partition_id, true AS has_primary FROM f_facts WHERE is_primary),
l_label AS (SELECT f.*, pu || CASE WHEN is_stateful AND has_primary THEN ' (#' || (partition_id + 1)
  || CASE WHEN is_primary THEN 'P' ELSE 'B' END || ')' ELSE '' END AS label
  FROM f_facts f LEFT JOIN l_primary USING (pu, partition_id))
"""


def _checks(groups: list[list[str]]) -> str:
    lanes = [f"SELECT container_id, {g} AS lane, zone AS key FROM f_zone WHERE zone IN ({', '.join(repr(z) for z in zs)})"
             for g, zs in enumerate(groups)]
    n = len(groups)
    lanes.append(f"SELECT container_id, {n}, host FROM f_container")
    lanes.append(f"SELECT container_id, {n + 1}, container_id FROM f_container")
    return f"""
k_key AS ({' UNION ALL '.join(lanes)}),
k_scoped AS (SELECT *, partition_id AS sc FROM f_facts UNION ALL SELECT *, 1000000 FROM f_facts),
k_role AS (SELECT *, 0 AS role FROM k_scoped UNION ALL SELECT *, 1 FROM k_scoped WHERE is_primary
  UNION ALL SELECT *, 2 FROM k_scoped WHERE is_backup AND NOT is_primary),
k_held AS (SELECT pu, sc, role, lane, key, count(*) AS n FROM k_role JOIN k_key USING (container_id) GROUP BY ALL),
k_free AS (SELECT DISTINCT pu, sc, role, lane, key, 0 AS n FROM (SELECT DISTINCT pu, sc FROM k_scoped)
  JOIN (SELECT DISTINCT pu, lane, key FROM f_elig JOIN k_key USING (container_id)) USING (pu)
  CROSS JOIN (SELECT unnest([0, 1, 2]) AS role)),
k_count AS (SELECT pu, sc, role, lane, key, max(n) AS n FROM (SELECT * FROM k_held UNION ALL SELECT * FROM k_free) GROUP BY ALL),
k_check AS (SELECT pu, sc, role, lane, {_BOUNDS} FROM k_count GROUP BY ALL)
"""


_CHECK_NAMES = """CASE WHEN sc = 1000000 THEN 'whole' ELSE CAST(sc AS VARCHAR) END AS scope,
  ['total', 'primary', 'backup'][role + 1] AS role, CASE WHEN lane < 1 THEN 'ZONE' WHEN lane = 1 THEN 'MACHINE'
  ELSE 'CONTAINER' END AS axis, CASE WHEN lane < 1 THEN lane ELSE -1 END AS zone_group"""

_STEP = """
s_first AS (SELECT * FROM k_check WHERE needs_rebalancing
  QUALIFY row_number() OVER (PARTITION BY pu ORDER BY sc, role, lane) = 1),
s_at AS (SELECT f.*, host, k.lane, k.key FROM f_facts f JOIN k_key k USING (container_id) JOIN f_container USING (container_id)),
s_barred AS (SELECT DISTINCT a.pu, a.partition_id FROM s_at a JOIN s_first s
  ON a.pu = s.pu AND a.lane = s.lane AND a.key = s.min_key
  WHERE s.lane = 1 OR (s.lane = 2 AND (s.sc = 1000000 OR a.partition_id = s.sc))),
s_candidate AS (SELECT a.* FROM s_at a JOIN s_first s ON a.pu = s.pu AND a.lane = s.lane AND a.key = s.max_key
  WHERE (s.lane = 2 OR s.sc = 1000000 OR a.partition_id = s.sc)
    AND NOT EXISTS (SELECT 1 FROM s_barred b WHERE b.pu = a.pu AND b.partition_id = a.partition_id)
  QUALIFY row_number() OVER (PARTITION BY a.pu ORDER BY a.is_backup, a.instance_id) = 1),
s_target AS (SELECT s.pu, e.container_id AS target_id FROM s_first s JOIN s_candidate c ON c.pu = s.pu
  JOIN f_elig e ON e.pu = s.pu AND e.container_id <> c.container_id AND (s.lane <> 1 OR e.host = s.min_key)
  JOIN f_load l ON l.container_id = e.container_id WHERE s.role <> 1
  QUALIFY row_number() OVER (PARTITION BY s.pu ORDER BY l.n_container, l.n_machine, e.container_id) = 1)
"""

_DRAINED = "host IN ('NATION_9', '10.2.0.7') OR addr IN ('NATION_9', '10.2.0.7')"

_SQL: dict[str, tuple[str, str, str]] = {}


def _add(name: str, body: str, *ctes: str, level: str = "brand") -> None:
    _SQL[name] = "WITH " + ",\n".join([_fleet(level), *ctes]) + "\n" + body


_ZONES = "array_to_string(zones, ',') AS zones"
_SCOPE = {
    "containers_all": "true",
    "containers_non_empty": "container_id IN (SELECT container_id FROM f_facts)",
    "containers_empty": "container_id NOT IN (SELECT container_id FROM f_facts)",
    "containers_backups_only": """container_id IN (SELECT container_id FROM f_facts WHERE is_stateful AND is_backup)
      AND container_id NOT IN (SELECT container_id FROM f_facts WHERE is_stateful AND is_primary)""",
    "containers_primaries_only": """container_id IN (SELECT container_id FROM f_facts WHERE is_stateful AND is_primary)
      AND container_id NOT IN (SELECT container_id FROM f_facts WHERE is_stateful AND is_backup)""",
    "containers_stateless_only": """container_id IN (SELECT container_id FROM f_facts)
      AND container_id NOT IN (SELECT container_id FROM f_facts WHERE is_stateful)""",
}
for _name, _condition in _SCOPE.items():
    _add(_name, f"SELECT container_id, host FROM f_container WHERE {_condition}")

_add("scan_containers", f"SELECT container_id, host, addr, pid, {_ZONES}, start_ts FROM f_container")
_add("scan_machines", "SELECT host, addr, CAST(n_nationkey + 10 AS BIGINT) AS pid FROM f_nation")
_add("scan_managers", "SELECT host, pid FROM f_manager")
_add("scan_pus", """SELECT pu, planned, array_to_string(required_zones, ',') AS required_zones, requires_isolation
  FROM f_pu""")
_add("pu_instances", "SELECT * FROM f_facts WHERE pu = 'Brand#7'")
_add("pu_lookup", "SELECT pu, planned FROM f_pu WHERE pu = 'Brand#7'")
_add("machine_instances", """SELECT instance_id, pu, container_id, host, addr FROM f_instance JOIN f_container
  USING (container_id) WHERE host = 'NATION_9'""")
_add("instance_locations", """SELECT pu, host, count(*) AS n, min(addr) AS addr, max(array_to_string(zones, ',')) AS last_zones
  FROM f_instance JOIN f_container USING (container_id) GROUP BY pu, host""")
_add("filter_zones", f"""SELECT container_id, {_ZONES} FROM f_container
  WHERE list_has_any(zones, ['RACK_1', 'LARGE_HEAP']) AND NOT list_contains(zones, 'ASIA')""")
_add("filter_zones_empty_list", "SELECT container_id FROM f_container WHERE false")
_add("filter_machines", """SELECT container_id, host, addr FROM f_container
  WHERE (host IN ('NATION_1', 'NATION_2') OR addr IN ('10.3.0.3', '10.1.0.6')) AND addr <> '10.2.0.2'""")
_add("filter_pu_semi", """SELECT container_id, host FROM f_container WHERE container_id IN
  (SELECT container_id FROM f_instance WHERE pu IN ('PU_1', 'PU_2'))""", level="part")
_add("filter_pu_anti", """SELECT container_id, host FROM f_container WHERE container_id NOT IN
  (SELECT container_id FROM f_instance WHERE pu IN ('PU_1', 'PU_2'))""", level="part")
_add("filter_uptime", f"""SELECT container_id, start_ts FROM f_container
  WHERE {_AS_OF} - start_ts > INTERVAL 28 DAY AND {_AS_OF} - start_ts < INTERVAL '30 days 12 hours'""")
_add("filter_common", f"""SELECT container_id, host, {_ZONES} FROM f_container
  WHERE list_has_any(zones, ['LARGE_HEAP', 'RACK_0']) AND NOT list_contains(zones, 'AFRICA') AND host <> 'NATION_4'
  AND {_AS_OF} - start_ts > INTERVAL 27 DAY
  AND container_id IN (SELECT container_id FROM f_instance WHERE pu BETWEEN 'PU_10' AND 'PU_19' AND length(pu) = 5)
  AND container_id NOT IN (SELECT container_id FROM f_instance WHERE pu = 'PU_3')""", level="part")
_add("restart_scope_with_options", f"""SELECT container_id, host FROM f_container WHERE list_contains(zones, 'LARGE_HEAP')
  AND {_AS_OF} - start_ts > INTERVAL 28 DAY AND container_id IN (SELECT container_id FROM f_facts)""")
_add("instances_stateful", "SELECT instance_id, pu, container_id FROM f_facts WHERE is_stateful")
_add("instance_roles", """SELECT pu, count(*) FILTER (NOT is_stateful) AS stateless,
  count(*) FILTER (is_stateful AND is_primary) AS stateful_primary,
  count(*) FILTER (is_stateful AND is_backup) AS stateful_backup, count(*) FILTER (is_primary) AS has_primary,
  count(*) FILTER (partition_id = 2) AS in_partition_2 FROM f_facts GROUP BY pu""")
_add("instance_spaces", """SELECT space_id, coalesce(mode, 'none') AS mode, count(*) AS n FROM f_instance
  GROUP BY 1, 2""")

_add("flagship_machine_balance", f"""SELECT pu, {_BOUNDS} FROM c_role WHERE scope = 'whole' AND axis = 'MACHINE'
  AND role = 'total' GROUP BY pu""", _COUNTS)
_add("count_potential", "SELECT * FROM c_potential", _COUNTS)
_add("count_by_axis", "SELECT * FROM c_all WHERE scope = 'whole'", _COUNTS)
_add("count_by_partition", "SELECT * FROM c_all", _COUNTS)
_add("count_hide_zeros", "SELECT * FROM c_role WHERE n <> 0", _COUNTS)
_add("count_remove_zeros", "SELECT * FROM c_role WHERE axis = 'ZONE' OR n <> 0", _COUNTS)
_add("count_retain_zones", """SELECT * FROM c_all WHERE scope = 'whole' AND (axis <> 'ZONE' OR key IN ('RACK_0', 'ASIA'))""",
     _COUNTS)
_add("min_max_keys", f"SELECT pu, scope, axis, role, {_BOUNDS} FROM c_role GROUP BY pu, scope, axis, role", _COUNTS)
_add("min_max_ties", """, b AS (SELECT pu, axis, role, min(n) AS lo, max(n) AS hi FROM c_role WHERE scope = 'whole'
    GROUP BY ALL), r AS (SELECT * FROM c_role JOIN b USING (pu, axis, role) WHERE scope = 'whole')
  SELECT pu, axis, role, 'min' AS bound, n, key FROM r WHERE n = lo
  UNION ALL SELECT pu, axis, role, 'max', n, key FROM r WHERE n = hi""", _COUNTS)
_add("zone_group_balance", f"""SELECT pu, scope, role, {_BOUNDS} FROM c_role
  WHERE axis = 'ZONE' AND key IN ('RACK_0', 'RACK_1', 'RACK_2', 'RACK_3') GROUP BY pu, scope, role""", _COUNTS)
_add("snapshot_json", """SELECT '{"pu":"' || pu || '",' || CASE WHEN scope = 'whole' THEN '' ELSE '"partition_id":' || scope
  || ',' END || '"axis":"' || axis || '","key":"' || key || '","total":' || total || ',"primary":' || "primary"
  || ',"backup":' || backup || '}' AS json FROM c_all WHERE total <> 0""", _COUNTS)

_add("common_zones", "SELECT host, n_containers, common_zones FROM z_common", _COMMON)
_add("specific_zones", """SELECT container_id, coalesce(string_agg(zone, ',' ORDER BY zone), '') AS specific_zones
  FROM f_container LEFT JOIN z_specific USING (container_id) GROUP BY container_id""", _COMMON)
_add("pu_names_per_container", "SELECT container_id, pu, count(*) AS copies FROM f_instance GROUP BY 1, 2")
_add("instance_label", "SELECT instance_id, label FROM l_label", _LABELS, level="part")
_add("container_report", """SELECT host, common_zones, n_containers, c.container_id,
    '[' || coalesce((SELECT string_agg(zone, ', ' ORDER BY zone) FROM z_specific s WHERE s.container_id = c.container_id), '')
    || ']' AS specific_zones, pid,
    (SELECT count(*) FROM f_facts f WHERE f.container_id = c.container_id) AS n_instances,
    coalesce(label, '') AS label, coalesce(copies, 0) AS copies
  FROM f_container c JOIN z_common USING (host) LEFT JOIN
    (SELECT container_id, label, count(*) AS copies FROM l_label GROUP BY 1, 2) USING (container_id)""", _COMMON, _LABELS)
_add("restart_selection", f"""SELECT container_id, count(DISTINCT label) AS labels, count(*) AS copies
  FROM l_label JOIN f_container USING (container_id) WHERE list_contains(zones, 'LARGE_HEAP')
  AND {_AS_OF} - start_ts > INTERVAL 28 DAY GROUP BY container_id""", _LABELS)
_add("container_machines", "SELECT container_id, pid, host, addr FROM f_container")
_add("machine_split", """SELECT CASE WHEN host = 'NATION_9' THEN 'same' ELSE 'different' END AS machine, count(*) AS n, min(container_id) AS "first"
  FROM f_container GROUP BY 1""")
_add("scan_agent_processes", "SELECT host, pid, agent_id, service_type FROM f_agent_process")
_add("container_order", """SELECT *, row_number() OVER (PARTITION BY host ORDER BY specific_zones, pid) - 1 AS position FROM (
    SELECT container_id, host, '[' || coalesce(string_agg(zone, ', ' ORDER BY zone), '') || ']' AS specific_zones, pid
    FROM f_container LEFT JOIN z_specific USING (container_id) GROUP BY container_id, host, pid)""", _COMMON)
_add("backup_first", """SELECT container_id, instance_id, is_backup,
  row_number() OVER (PARTITION BY container_id ORDER BY is_backup DESC, instance_id) - 1 AS position FROM f_facts""", level="part")
_add("zone_group_check", "SELECT container_id, array_to_string(list_sort(zones), ',') AS zones FROM f_container")
_SQL["options_without_passwords"] = """SELECT p_partkey, '-Xmx' || p_size || 'm'
  || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' -D' || p_type || '.name=' || p_partkey END AS options FROM part"""
_add("containers_per_host", "SELECT host, count(*) AS n_containers FROM f_container GROUP BY host")
_add("agent_report", """SELECT a.host, required_managers, coalesce(processes, 0) AS processes, coalesce(p.pid, -1) AS pid,
    coalesce(agent_id, -1) AS agent_id, coalesce(service_type, '') AS service_type,
    coalesce(instantiation_mode, '') AS instantiation_mode
  FROM f_agent a LEFT JOIN f_agent_process p USING (host)
  LEFT JOIN (SELECT host, count(*) AS processes FROM f_agent_process GROUP BY host) USING (host)""")
_add("manager_report", "SELECT host FROM f_manager")
_add("component_type", "SELECT host, pid, component_type FROM f_jvm")
_add("component_totals", "SELECT component_type, count(*) AS n FROM f_jvm GROUP BY 1")
_JVM = f"""
j AS (SELECT *, CAST(floor(heap / 4 + 0.5) AS BIGINT) AS heap_init_mb, CAST(floor(heap + 0.5) AS BIGINT) AS heap_max_mb,
  date_diff('hour', start_ts, {_AS_OF}) AS hours, 'OpenVM : 64-Bit Server : 17.0.' || (pid % 10) AS description FROM f_jvm),
j_line AS (SELECT *, component_type || ' : ' || lpad(CAST(pid AS VARCHAR), CAST(greatest(5, length(CAST(pid AS VARCHAR))) AS INT), ' ')
  || ' : running on ' || host || ' for ' || rpad('PT' || hours || 'H', 17, ' ') || ' : Heap ['
  || lpad(CAST(heap_init_mb AS VARCHAR), 5, ' ') || ' MB, ' || lpad(CAST(heap_max_mb AS VARCHAR), 5, ' ') || ' MB] : '
  || description AS line FROM j)
"""
_add("jvm_report", """SELECT component_type, component_rank, host, pid, heap_init_mb, heap_max_mb,
  hours * 3600 AS uptime_seconds, description, line FROM j_line""", _JVM)
_add("full_report", """SELECT 'managers' AS section, host, -1 AS pid, '' AS text FROM f_manager
  UNION ALL SELECT 'agents', a.host, coalesce(p.pid, -1), coalesce(service_type, '') FROM f_agent a LEFT JOIN f_agent_process p USING (host)
  UNION ALL SELECT 'jvms', host, pid, line FROM j_line
  UNION ALL SELECT 'containers', host, pid, coalesce(label || ' x ' || copies, '') FROM f_container LEFT JOIN
    (SELECT container_id, label, count(*) AS copies FROM l_label GROUP BY 1, 2) USING (container_id)""", _JVM, _LABELS)
_add("jvm_details", """SELECT host, component_type, pid, line || chr(10) || 'JVM Environment Variables : ' || chr(10)
  || 'REGION : ' || region || chr(10) || 'JVM System Properties : ' || chr(10) || 'host : ' || host || chr(10)
  || 'pid : ' || pid || chr(10) AS value FROM j_line""", _JVM)
_add("dump_reports", f"""SELECT 'heap,thread' AS dumps_types, container_id, host AS host_name, addr AS host_address, pid,
  {_AS_OF} AS start_time, coalesce(pu, '') AS pu_name, coalesce(copies, 0) AS copies FROM f_container LEFT JOIN
  (SELECT container_id, pu, count(*) AS copies FROM f_instance GROUP BY 1, 2) USING (container_id)""")

_add("count_ranges", "SELECT * FROM r_range", _COUNTS, _RANGES)
_add("tie_ranges", """SELECT pu, axis, role, bound, n, first_key, last_key, n_keys FROM (SELECT *, unnest(['min', 'max']) AS bound,
    min(n) OVER w AS low, max(n) OVER w AS high FROM r_range WHERE scope = 'whole' WINDOW w AS (PARTITION BY pu, scope, axis, role))
  WHERE n = CASE WHEN bound = 'min' THEN low ELSE high END""", _COUNTS, _RANGES, level="part")
_add("container_load", "SELECT container_id, host, n_container, n_machine FROM f_load")
_add("best_containers", """SELECT pu, CAST("rank" AS INTEGER) AS "rank", container_id, host, n_container, n_machine FROM (
  SELECT e.pu, l.*, row_number() OVER (PARTITION BY e.pu ORDER BY n_container, n_machine, container_id) AS "rank"
  FROM f_elig e JOIN f_load l USING (container_id))""")
_add("relocation_target", """, t AS (SELECT e.pu, l.region, l.container_id, row_number() OVER (PARTITION BY e.pu, l.region
    ORDER BY n_container, n_machine, container_id) AS rk FROM f_elig e JOIN f_load l USING (container_id))
  SELECT instance_id, f.pu, f.container_id, coalesce(t.container_id, '') AS target_id, n_container = 1 AS origin_empty,
    CASE WHEN t.container_id IS NULL THEN 'no container meets the requirements' ELSE '' END AS problem
  FROM f_facts f JOIN f_load l USING (container_id) LEFT JOIN t
  ON t.pu = f.pu AND t.region = l.region AND t.container_id <> f.container_id AND t.rk <= 2
  QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY t.rk) = 1""", level="part")
_add("candidate_counts", """SELECT pu, planned, (SELECT count(*) FROM f_elig e JOIN f_load l USING (container_id)
  WHERE e.pu = p.pu AND (NOT p.requires_isolation OR n_container = 0)) AS candidates FROM f_pu p""")
_add("rebalance_checks", f"""SELECT pu, {_CHECK_NAMES}, "min", "max", min_key, max_key, needs_rebalancing FROM k_check""",
     _checks([["RACK_0", "RACK_1", "RACK_2", "RACK_3"]]))
_STEP_ROWS = f"""SELECT s.pu, {_CHECK_NAMES.replace('role + 1', 's.role + 1').replace('lane', 's.lane')},
    CASE WHEN s.role = 1 THEN 'demote' ELSE 'relocate' END AS "action", s.max_key AS from_key, "min", "max",
    coalesce(instance_id, '') AS instance_id, coalesce(c.container_id, '') AS from_container,
    coalesce(s.min_key, '') AS to_key, coalesce(target_id, '') AS target_id,
    CASE WHEN instance_id IS NULL THEN 'no candidate instance' WHEN s.role <> 1 AND target_id IS NULL
      THEN 'no container meets the requirements' ELSE '' END AS problem,
    coalesce(c.is_stateful AND s.role <> 1, false) AS demote_first
  FROM s_first s LEFT JOIN s_candidate c ON c.pu = s.pu LEFT JOIN s_target t ON t.pu = s.pu"""
_add("rebalance_step", _STEP_ROWS, _checks([["RACK_0", "RACK_1"]]), _STEP, level="part")
_add("rebalance_large", _STEP_ROWS, _checks([["RACK_0", "RACK_1"]]), _STEP)
# the same cascade where all containers run on one machine and no zone counts, so that container checks decide
_SQL["rebalance_one_machine"] = _SQL["rebalance_step"].replace("n_name AS host", "'HOST' AS host").replace("'RACK_0', 'RACK_1')", "'NO_ZONE')")
_add("host_drain", f""", m AS (SELECT f.*, host, required_zones AS rz, row_number() OVER (PARTITION BY required_zones
    ORDER BY instance_id, f.container_id) AS i FROM f_facts f JOIN f_container c USING (container_id) JOIN f_pu USING (pu) WHERE {_DRAINED}),
  size AS (SELECT rz, count(*) AS movers FROM m GROUP BY rz),
  t AS (SELECT rz, movers, l.container_id, n_container, n_machine FROM size JOIN f_load l
    ON (len(rz) = 0 OR list_has_any(rz, zones)) WHERE NOT (l.{_DRAINED.replace(' addr', ' l.addr')})),
  up AS (SELECT rz, max(n_container) + any_value(movers) // count(*) + 2 AS highest FROM t GROUP BY rz),
  p AS (SELECT * FROM (SELECT *, unnest(range(n_container, highest)) AS level FROM t JOIN up USING (rz))
    QUALIFY row_number() OVER (PARTITION BY rz ORDER BY level, n_machine, container_id) <= movers),
  r AS (SELECT rz, container_id AS target_id, row_number() OVER (PARTITION BY rz ORDER BY n_machine, container_id, level) AS i FROM p)
  SELECT instance_id, pu, host, container_id, coalesce(target_id, '') AS target_id, is_stateful AS demote_first,
    CASE WHEN target_id IS NULL THEN 'no container meets the requirements' ELSE '' END AS problem
  FROM m LEFT JOIN r USING (rz, i)""", level="part")


def _drain_round(n: int) -> str:
    """The fullest class of what rounds before left, by trying all sets of the few requirement sets.

    In the k emptiest containers of a set, with loads adding up to held, level * k - held movers find room below a level.
    """
    return f"""
  s{n} AS (SELECT mask, sum(movers) AS movers FROM (SELECT unnest(range(1, 1 << (SELECT count(*) FROM o))) AS mask) JOIN o ON mask & bit > 0
    WHERE mask & (SELECT done FROM d{n}) = 0 GROUP BY mask),
  k{n} AS (SELECT mask, s.movers, row_number() OVER w AS k, sum(n_container) OVER w AS held
    FROM s{n} s JOIN t ON mask & t.bits > 0 AND t.bits & (SELECT done FROM d{n}) = 0 WINDOW w AS (PARTITION BY mask ORDER BY n_container, container_id)),
  b{n} AS (SELECT max(level) - 1 AS level FROM (SELECT mask, min((movers + held + k - 1) // k) AS level FROM k{n} GROUP BY mask)),
  x{n} AS (SELECT mask, any_value(movers) AS movers, any_value(movers) - max(greatest(level * k - held, 0)) AS extras FROM k{n}, b{n} GROUP BY mask),
  c{n} AS (SELECT * FROM x{n}, b{n} QUALIFY row_number() OVER (ORDER BY extras DESC, bit_count(mask)) = 1),
  d{n + 1} AS (SELECT (SELECT done FROM d{n}) | coalesce((SELECT mask FROM c{n}), 0) AS done)"""


_ROUNDS = range(1, 4)  # as many as there are requirement sets
_add("host_drain_shared", f""", m AS (SELECT required_zones AS rz, count(*) AS movers FROM f_facts JOIN f_container USING (container_id)
    JOIN f_pu USING (pu) WHERE {_DRAINED} GROUP BY rz),
  o AS (SELECT *, 1 << (row_number() OVER (ORDER BY rz) - 1) AS bit FROM m),
  t AS (SELECT container_id, n_container, bit_or(bit) AS bits FROM f_load l JOIN o ON len(rz) = 0 OR list_has_any(rz, zones)
    WHERE NOT (l.{_DRAINED.replace(' addr', ' l.addr')}) GROUP BY ALL),
  d1 AS (SELECT 0 AS done),{",".join(map(_drain_round, _ROUNDS))},
  v AS ({" UNION ALL ".join(
    f"SELECT container_id, n_container, level, extras, c{n}.movers FROM t JOIN c{n} ON bits & mask > 0 AND bits & (SELECT done FROM d{n}) = 0"
    for n in _ROUNDS)})
  SELECT container_id, n_container AS n_before, greatest(n_container, level) AS low,
    greatest(n_container, level) + CASE WHEN extras > 0 AND n_container <= level THEN 1 ELSE 0 END AS high,
    extras AS class_extras, movers AS class_movers, true AS fits FROM v""", level="part")
_add("drain_status_after", f"""SELECT host, remaining, remaining = 0 AS agent_may_stop, remaining > 0 AS next_round FROM (
  SELECT n.host, count(instance_id) AS remaining FROM f_nation n LEFT JOIN f_container c ON c.host = n.host
  LEFT JOIN (SELECT * FROM f_facts WHERE pu NOT IN (SELECT pu FROM f_elig WHERE NOT ({_DRAINED}))) f ON f.container_id = c.container_id
  WHERE n.{_DRAINED.replace(' addr', ' n.addr')} GROUP BY n.host)""", level="part")
_add("drain_status", f"""SELECT host, remaining, remaining = 0 AS agent_may_stop, remaining > 0 AS next_round FROM (
  SELECT n.host, count(instance_id) AS remaining FROM f_nation n LEFT JOIN f_container c ON c.host = n.host
  LEFT JOIN f_facts f ON f.container_id = c.container_id WHERE n.{_DRAINED.replace(' addr', ' n.addr')} GROUP BY n.host)""")
_add("demote_plan", f"""SELECT host, container_id, pu, instance_id, space_id FROM f_instance JOIN f_container
  USING (container_id) WHERE mode = 'PRIMARY' AND space_id = 'space' AND {_SCOPE['containers_primaries_only']}""")
_add("demote_counts", """SELECT container_id, count(*) AS demoted FROM f_facts WHERE is_stateful AND is_primary
  GROUP BY 1""")

_BAD = """
bad AS (SELECT DISTINCT host, pid FROM (SELECT host, pid FROM f_agent_process UNION ALL SELECT host, pid FROM f_jvm)
  WHERE (host, pid) NOT IN (SELECT (host, pid) FROM f_container)
    AND (host, pid) NOT IN (SELECT (host, pid) FROM f_jvm WHERE component_type IN ('GSA', 'GSM')))
"""
_KNOWN = """
h_time AS (SELECT n_regionkey AS cluster, TIMESTAMP '2024-01-01' + (7 * week + n_regionkey) * INTERVAL 1 DAY AS snapshot
  FROM (SELECT DISTINCT n_regionkey FROM f_nation), range(6) r(week)),
h_last AS (SELECT moment, cluster, max(snapshot) AS snapshot FROM h_time, (VALUES (TIMESTAMP '2024-01-03 12:00:00'), (TIMESTAMP '2024-02-01')) m(moment)
  WHERE snapshot <= moment GROUP BY moment, cluster),
h_container AS (SELECT moment, cluster, snapshot, c.* FROM h_last JOIN f_nation ON cluster = n_regionkey JOIN f_container c USING (host)
  WHERE start_ts <= snapshot),
h_start AS (SELECT host, pid, start_ts AS started FROM f_container
  UNION ALL SELECT host, c_custkey + 200000, TIMESTAMP '2024-01-01' + (c_custkey % 40) * INTERVAL 1 DAY FROM f_customer),
h_process AS (SELECT p.* FROM f_agent_process p LEFT JOIN h_start USING (host, pid) JOIN f_nation USING (host) JOIN h_last ON cluster = n_regionkey
  WHERE moment = TIMESTAMP '2024-02-01' AND coalesce(started, TIMESTAMP '2024-01-01') <= snapshot),
h_bad AS (SELECT DISTINCT host, pid FROM (SELECT host, pid FROM h_process UNION ALL SELECT host, pid FROM f_jvm)
  WHERE (host, pid) NOT IN (SELECT (host, pid) FROM h_container WHERE moment < TIMESTAMP '2024-01-10')
    AND (host, pid) NOT IN (SELECT (host, pid) FROM f_manager)
    AND (host, pid) NOT IN (SELECT (host, pid) FROM f_agent))
"""
_add("containers_known", """SELECT cluster, snapshot, container_id, host, pid FROM h_container WHERE moment < TIMESTAMP '2024-01-10'""", _KNOWN)
_add("bad_services_over_time", """SELECT b.host, b.pid, coalesce(container_id, '') AS container_id, coalesce(agent_id, -1) AS agent_id,
  CASE WHEN container_id IS NOT NULL THEN 'restart' WHEN agent_id IS NOT NULL THEN 'kill' ELSE 'manual' END AS "action"
  FROM h_bad b LEFT JOIN (SELECT * FROM h_container WHERE moment > TIMESTAMP '2024-01-10') c ON c.host = b.host AND c.pid = b.pid
  LEFT JOIN h_process p ON p.host = b.host AND p.pid = b.pid""", _KNOWN)
_add("bad_services", "SELECT host, pid FROM bad", _BAD)
_add("bad_service_actions", """SELECT b.host, b.pid, '' AS container_id, coalesce(agent_id, -1) AS agent_id,
  CASE WHEN agent_id IS NULL THEN 'manual' ELSE 'kill' END AS "action"
  FROM bad b LEFT JOIN f_agent_process p ON p.host = b.host AND p.pid = b.pid""", _BAD)
_add("process_containers", """SELECT p.host, p.pid, agent_id, coalesce(container_id, '') AS container_id
  FROM f_agent_process p LEFT JOIN f_container c ON c.host = p.host AND c.pid = p.pid""")
_add("scan_agents", "SELECT host, pid, required_managers FROM f_agent")
_add("kill_requests", """SELECT host, agent_id, host AS agent_host, '' AS problem FROM f_agent_process
  UNION ALL SELECT addr, agent_id, host, '' FROM f_agent_process JOIN f_nation USING (host)
  UNION ALL SELECT r_name, 1, '', 'no agent on this host' FROM region""")
_add("agent_shutdown_order", """SELECT 1 AS pass, host FROM f_agent WHERE host <> 'NATION_3'
    AND host NOT IN (SELECT host FROM f_manager)
  UNION ALL SELECT 2, host FROM f_agent WHERE host <> 'NATION_3'""")
_add("deploy_scope", "SELECT pu, pu IN ('Brand#3', 'Brand#4') AS skipped FROM f_pu")
_add("manager_selection", """SELECT host, pid FROM f_manager JOIN f_nation USING (host) WHERE addr <> '10.1.0.1'""")
_add("rolling_schedule", f""", s AS (SELECT container_id, row_number() OVER (ORDER BY container_id) - 1 AS position
    FROM f_container WHERE {_SCOPE['containers_non_empty']})
  SELECT container_id, position, position * 60 AS starts_after_seconds FROM s""")
_add("parallel_waves", """, s AS (SELECT host, pid, row_number() OVER (ORDER BY host, pid) - 1 AS position FROM f_jvm)
  SELECT host, pid, position, position // 32 AS wave FROM s""")

_FIRST = "SELECT entity, key, value, min(layer) AS layer FROM f_layer GROUP BY ALL"
_add("effective_config", f"SELECT entity, key, arg_max(value, layer) AS value FROM ({_FIRST}) GROUP BY entity, key")
_add("shown_config", """, d AS (SELECT entity, key, value, bool_or(layer IN (2, 4)) AS secret, min(layer) AS layer FROM f_layer GROUP BY entity, key, value)
  SELECT entity, key, CASE WHEN arg_max(secret, layer) THEN '****' ELSE arg_max(value, layer) END AS value,
    arg_max(secret, layer) AS is_secret FROM d GROUP BY entity, key""")
_BRAND = "brand AS (SELECT *, CAST(substr(p_brand, 7) AS INT) AS num, 'brand_' || substr(p_brand, 7) AS pu FROM part)"
_SQL["deployment_files"] = f"""WITH {_BRAND}, b AS (SELECT pu, num, count(*) AS n FROM brand GROUP BY pu, num)
  SELECT pu, CASE num % 4 WHEN 0 THEN 'no descriptor file' WHEN 1 THEN 'not valid JSON' WHEN 2 THEN 'unknown fields: $.surprise' ELSE '' END AS problem,
    CASE num % 4 WHEN 3 THEN pu ELSE '' END AS name, '-Xmx' || n || 'm ${{CONTAINER_OPTIONS}} -Dbrand=' || num AS environment,
    '-Xmx' || n || 'm -Dbrand=' || num AS jvm_args FROM b"""
_SQL["deployment_config"] = f"""WITH {_BRAND}, b AS (SELECT pu, num, count(*) AS n FROM brand GROUP BY pu, num),
  e AS (SELECT pu, 'origin' AS key, n::VARCHAR AS value, 'STRING' AS kind, 1 AS layer, false AS secret FROM b
    UNION ALL SELECT pu, 'size.1', '0', 'STRING', 1, false FROM b
    UNION ALL SELECT pu, 'size.' || p_size, max(p_partkey)::VARCHAR, 'STRING', 2, false FROM brand GROUP BY pu, p_size
    UNION ALL SELECT pu, 'pw.' || p_type, count(*)::VARCHAR, 'STRING', 3, true FROM brand WHERE num % 5 > 1 GROUP BY pu, p_type
    UNION ALL SELECT pu, 'size.1', n::VARCHAR, 'BIGINT', 4, false FROM b WHERE num % 4 = 3
    UNION ALL SELECT pu, 'extra', 'x ' || num, 'STRING', 4, false FROM b WHERE num % 4 = 3),
  d AS (SELECT pu, key, value, kind, min(layer) AS layer, bool_or(secret) AS secret FROM e GROUP BY pu, key, value, kind)
  SELECT pu AS entity, key, CASE WHEN arg_max(secret, layer) THEN '****' ELSE arg_max(value, layer) END AS value, arg_max(secret, layer) AS is_secret
  FROM d GROUP BY pu, key"""
_add("merged_size", "SELECT entity, count(*) AS size, false AS is_empty FROM f_layer GROUP BY entity")
_add("merged_entries", "SELECT DISTINCT entity, key, value FROM f_layer")
_SQL["zone_limits_parse"] = """SELECT p_partkey, p_brand AS zone, p_size + 2 AS max_instances FROM part
  UNION ALL SELECT p_partkey, p_type, p_size + 1 FROM part"""
_SQL["zone_limits_format"] = """SELECT p_partkey,
  CASE WHEN p_type < p_brand THEN p_type || '/' || p_size || ',' || p_brand || '/' || (p_size + 1)
    ELSE p_brand || '/' || (p_size + 1) || ',' || p_type || '/' || p_size END AS zone_first,
  CASE WHEN p_type < p_brand THEN p_size || '/' || p_type || ',' || (p_size + 1) || '/' || p_brand
    ELSE (p_size + 1) || '/' || p_brand || ',' || p_size || '/' || p_type END AS count_first FROM part"""
_SQL["duration_parse"] = """SELECT l_linenumber, CAST(sum(l_linenumber * 86400000000 + CAST(l_quantity AS INT) * 3600000000
  + (l_suppkey % 60) * 60000000 + (l_partkey % 60) * 1000000 + 250000) AS BIGINT) AS micros FROM lineitem GROUP BY 1"""
_add("jvm_args_filter", """SELECT container_id, '-Xmx' || pid || 'm -Dzones=' || array_to_string(zones, ',') || ' -Dhost='
  || host AS jvm_args FROM f_container""")
_add("xml_environment", """SELECT container_id, CASE WHEN heap_mb >= 0 THEN '-Xmx' || pid || 'm & -Dhost=' || host ELSE '' END
  AS environment FROM f_container""")
_SQL["properties_read"] = """SELECT c_custkey, 'name' AS key, c_name AS value FROM customer
  UNION ALL SELECT c_custkey, 'segment', c_mktsegment || 'A' FROM customer
  UNION ALL SELECT c_custkey, 'nation key', CAST(c_nationkey AS VARCHAR) FROM customer"""
_SQL["descriptor_read"] = """SELECT 'PU_' || p_partkey AS pu,
  CASE WHEN p_size % 4 = 0 THEN 'unknown fields: $.surprise' ELSE '' END AS problem,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END AS name,
  CASE WHEN p_size % 4 <> 0 AND p_size % 3 <> 0 AND p_size % 2 = 0 THEN p_size + 100 ELSE -1 END AS partitions,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type || '/' || p_size END AS max_per_zone FROM part"""
_SQL["descriptor_of_pu"] = """SELECT 'PU_' || p_partkey AS pu, CASE WHEN p_size % 3 = 1 OR p_size % 4 = 0 THEN '' ELSE p_name END AS name,
  CASE WHEN p_size % 3 = 1 THEN 'no descriptor file' WHEN p_size % 4 = 0 THEN 'unknown fields: $.surprise' ELSE '' END AS problem FROM part"""
_SQL["descriptor_types"] = """SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'wrong types: $.topology.instances is STRING'
    WHEN 1 THEN 'wrong types: $.topology is BIGINT' WHEN 2 THEN 'wrong types: $ is ARRAY<BIGINT>'
    WHEN 3 THEN 'wrong types: $.sla.zones is STRING' ELSE '' END AS problem,
  CASE WHEN p_size % 7 = 6 THEN CAST(p_size AS VARCHAR) ELSE '' END AS name,
  CASE WHEN p_size % 7 = 4 THEN p_size ELSE -1 END AS instances,
  CASE WHEN p_size % 7 = 5 THEN p_size ELSE -1 END AS max_per_vm FROM part"""
_SQL["descriptor_round_trip"] = """SELECT 'PU_' || p_partkey AS pu, p_name AS name,
  CASE WHEN p_size % 3 <> 0 AND p_size % 2 = 0 THEN p_size + 100 ELSE -1 END AS partitions, p_type AS zones, p_size AS max_per_vm,
  'brand=' || p_brand AS context FROM part WHERE p_size % 4 <> 0"""
_SQL["descriptor_context"] = """SELECT 'PU_' || p_partkey AS entity, 'brand' AS key, p_brand AS value, 'STRING' AS value_type
  FROM part WHERE p_size % 4 <> 0"""
_add("deployed_settings", """, d AS (SELECT *, 'PU_' || p_partkey AS pu, p_size % 4 <> 0 AS found,
    p_size % 4 <> 0 AND p_size % 3 <> 0 AS topo FROM part)
  SELECT pu, CASE WHEN topo THEN 'partitioned' ELSE 'default' END AS cluster_schema,
    CASE WHEN topo AND p_size % 2 = 0 THEN p_size + 100 ELSE p_size END AS instances,
    CASE WHEN topo THEN -1 ELSE 1 END AS backups, CASE WHEN found THEN p_size ELSE 9 END AS max_per_vm,
    CASE WHEN found THEN p_type ELSE array_to_string(required_zones, ',') END AS zones,
    CASE WHEN found THEN p_type || '/' || p_size ELSE '' END AS zone_limits,
    CASE WHEN found THEN p_brand || '.jar' ELSE pu || '.jar' END AS resource
  FROM d JOIN f_pu USING (pu)""", level="part")
_SQL["descriptor_of_settings"] = """SELECT json, count(*) AS n FROM (SELECT '{"name":"' || p_name || '","resource":"' || p_brand
  || '","topology":{' || CASE WHEN p_size % 2 = 0 THEN '"schema":"partitioned","partitions":' ELSE '"instances":' END || p_size
  || '},"sla":{' || CASE WHEN p_size > 25 THEN '"maxInstancesPerMachine":' || p_size || ',' ELSE '' END
  || '"maxInstancesPerZone":"' || p_type || '/' || p_size || '"}}' AS json FROM part) GROUP BY json"""

_READY = """
, run AS (SELECT *, sum(delta) OVER (PARTITION BY app, pu ORDER BY ts, event_id) AS n FROM f_ready),
  dl AS (SELECT app, min(ts) + INTERVAL 2 DAY AS deadline FROM f_ready GROUP BY app),
  st AS (SELECT app, pu, CAST(sum(delta) AS BIGINT) AS running, min(ts) FILTER (n >= 5) AS done FROM run GROUP BY app, pu)
SELECT app, pu, 5 AS planned, running, CASE WHEN coalesce(done <= deadline, false) THEN 'DONE' ELSE 'TIMED_OUT' END AS status,
  CASE WHEN coalesce(done <= deadline, false) THEN strftime(done, '%Y-%m-%d %H:%M:%S.%f') ELSE '' END AS done_ts
FROM st JOIN dl USING (app)"""
_add("readiness_batch", _READY)
_add("application_outcome", """, run AS (SELECT *, sum(delta) OVER (PARTITION BY app, pu ORDER BY ts, event_id) AS n FROM f_ready),
  dl AS (SELECT app, min(ts) + INTERVAL 2 DAY AS deadline FROM f_ready GROUP BY app),
  st AS (SELECT app, pu, min(ts) FILTER (n >= 5) AS done, row_number() OVER (PARTITION BY app ORDER BY pu DESC) - 1 AS place
    FROM run GROUP BY app, pu),
  x AS (SELECT *, coalesce(done <= deadline, false) AS fine FROM st JOIN dl USING (app))
SELECT app, CASE WHEN bool_and(fine) THEN 'DEPLOYED' ELSE 'TIMED_OUT' END AS status, count(*) AS declared,
  coalesce(min(place) FILTER (NOT fine), count(*)) AS deployed, coalesce(arg_min(pu, place) FILTER (NOT fine), '') AS failed_pu,
  CASE WHEN bool_and(fine) THEN strftime(max(done), '%Y-%m-%d %H:%M:%S.%f') ELSE '' END AS done_ts FROM x GROUP BY app""")
_add("readiness_stream", _READY)
_add("readiness_progress", """, run AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY app, pu ORDER BY ts, event_id) AS BIGINT) AS n
    FROM f_ready)
  SELECT app, pu, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
    arg_max(n, (ts, event_id)) AS running FROM run GROUP BY ALL""")


def _imbalance(condition: str) -> str:
    return f"""SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, pu, {_BOUNDS} FROM (
  SELECT date_trunc('day', ts) AS window_start, 'pu_' || (user_id % 25) AS pu, event_type AS key, count(*) AS n
  FROM events GROUP BY ALL) WHERE {condition} GROUP BY window_start, pu"""


def _presence(condition: str) -> str:
    return f"""SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end, count(*) AS probes,
  count(*) FILTER (event_type = 'signup') AS managers, count(*) FILTER (event_type = 'signup') = 0 AS alert
  FROM (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, event_type FROM events)
  WHERE {condition} GROUP BY window_start"""


_SQL["imbalance_windowed"] = _imbalance("true")
_SQL["imbalance_stream"] = _imbalance("true")
_PLACED = """
, seen AS (SELECT time_bucket(INTERVAL 90 DAY, l_shipdate, TIMESTAMP '1970-01-01') AS ws, p_brand AS pu,
    printf('Supplier#%09d', ckey) AS container_id FROM f_row JOIN part ON l_partkey = p_partkey),
  held AS (SELECT ws, pu, axis, key, count(*) AS n FROM seen JOIN f_key USING (container_id) GROUP BY ALL),
  free AS (SELECT DISTINCT pu, axis, key FROM f_elig JOIN f_key USING (container_id)),
  mixed AS (SELECT * FROM held UNION ALL SELECT ws, pu, axis, key, 0 FROM (SELECT DISTINCT ws, pu, axis FROM held) JOIN free USING (pu, axis)),
  counted AS (SELECT ws, pu, axis, key, max(n) AS n FROM mixed GROUP BY ALL)
SELECT ws AS window_start, ws + INTERVAL 90 DAY AS window_end, pu, axis, min(n) AS "min", max(n) AS "max",
  max(n) > min(n) + 1 AS needs_rebalancing FROM counted GROUP BY ws, pu, axis"""
_add("placement_windowed", _PLACED)
_add("placement_stream", _PLACED)
_SQL["manager_presence"] = _presence("true")
_SQL["manager_presence_stream"] = _presence("true")
_SQL["discovery_outcome"] = f"""SELECT attempt, CASE WHEN attempt <= 10 THEN 'FOUND' ELSE 'NOT_FOUND' END AS status FROM (
  SELECT date_diff('minute', min(window_start), min(window_start) FILTER (managers > 0)) // 10 + 1 AS attempt
  FROM ({_presence('true')}))"""


def oracle_sql() -> dict[str, str]:
    # a body may start with a comma to add one more CTE
    return {name: sql.replace("\n,", ",\n") for name, sql in _SQL.items()}
