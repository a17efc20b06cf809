"""The same results in plain SQL, for checking the Spark queries.

Common table expressions are named fragments; `sql()` puts the ones a query
needs in front of it.
"""

from __future__ import annotations

import re

from palisade.sources.bridge import DAY0_US, DNS_SCALE, EMPTY_SHA256, EVENTS_START_US, FLOW_SCALE
from palisade.sources.catalogs import INDICATORS, RULE_TECHNIQUES, TECHNIQUES

CTE: dict[str, str] = {}
NEED = DNS_SCALE["dns_threshold"]
FS = FLOW_SCALE


def sql(body: str) -> str:
    """`body` preceded by every fragment it uses, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[a-z_0-9]+\b", text):
            if name in CTE and name not in order:
                visit_cte(name)

    def visit_cte(name: str) -> None:
        busy.add(name)
        for dep in re.findall(r"\b[a-z_0-9]+\b", CTE[name]):
            if dep in CTE and dep not in order and dep not in busy:
                visit_cte(dep)
        order.append(name)

    busy: set[str] = set()
    visit(body)
    if not order:
        return body
    parts = ",\n".join(
        f"{n}({CTE_COLUMNS[n]}) AS ({CTE[n]})" if n in CTE_COLUMNS
        else f"{n} AS MATERIALIZED ({CTE[n]})" for n in order
    )
    return f"WITH RECURSIVE {parts}\n{body}"


CTE_COLUMNS: dict[str, str] = {}


def uuid5(ns: str, expr: str) -> str:
    h = f"sha1(unhex('{ns}') || encode({expr}))"
    return (
        f"(SELECT substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||"
        f"translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr(h,18,3)||'-'||"
        f"substr(h,21,12) FROM (SELECT {h} AS h))"
    )


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CTE["tel_k"] = f"""
SELECT 'evt-' || lpad(event_id::VARCHAR, 8, '0') AS event_id,
  {DAY0_US} + (epoch_us(ts) - {EVENTS_START_US}) // 60 AS ts_us,
  event_type AS kind, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  CAST(user_id // 8 AS INT) AS u, value FROM events"""

CTE["tel"] = f"""
SELECT event_id, ts_us,
  CASE WHEN kind IN ('error','signup') THEN 'authentication' WHEN kind='click' THEN 'dns_query'
       WHEN kind='view' THEN 'process_creation' ELSE 'data_transfer' END AS event_type,
  CASE WHEN kind IN ('error','signup') THEN 'windows' WHEN kind='click' THEN 'dns'
       WHEN kind='view' THEN 'endpoint' ELSE 'firewall' END AS source,
  'WIN-' || (u % 5) AS host, 'user_' || u AS usr,
  CASE WHEN k % 20 = 0 THEN '192.168.50.' || k ELSE '10.10.' || (u // 250) || '.' || (u % 250) END AS sip,
  CASE WHEN kind <> 'purchase' THEN NULL WHEN k=11 THEN '203.0.113.200' WHEN k=12 THEN '192.0.2.99'
       WHEN k=13 THEN '198.51.100.23' ELSE '198.18.' || k || '.' || (u % 250) END AS dip,
  CASE WHEN kind='purchase' THEN 443 END AS port,
  CASE WHEN kind='purchase' THEN 'TCP' END AS protocol,
  CASE WHEN kind <> 'view' THEN NULL
       WHEN k < 4 THEN 'C:\\Windows\\System32\\WindowsPowerShell\\powershell.exe'
       WHEN k < 6 THEN 'C:\\Windows\\POWERSHELL.EXE' WHEN k=6 THEN 'C:\\Windows\\cmd.exe'
       WHEN k=7 THEN '/usr/bin/python' ELSE 'C:\\Program Files\\App\\app.exe' END AS process_name,
  CASE WHEN kind <> 'view' THEN NULL WHEN k < 4 THEN 'C:\\Windows\\System32\\services.exe'
       WHEN k < 6 THEN 'C:\\Office\\winword.exe' ELSE 'C:\\Windows\\explorer.exe' END AS parent_process,
  CASE WHEN kind <> 'view' THEN NULL WHEN k < 4 THEN 'powershell.exe -NoProfile'
       WHEN k < 6 THEN 'powershell -EncodedCommand QQBB' WHEN k=7 THEN 'python -c FromBase64String'
       WHEN k=8 THEN 'app.exe --password=hunter2' ELSE 'app.exe --run' END AS cmd,
  CASE WHEN kind='view' AND k=20 THEN '{EMPTY_SHA256}'
       WHEN kind='view' AND k % 10 = 5 THEN md5('bin' || k) END AS file_hash,
  CASE WHEN kind <> 'click' THEN NULL WHEN k=7 THEN 'Update-Check.INVALID'
       WHEN k=9 THEN 'malware-test.invalid' WHEN k % 10 = 3 THEN 'example.com'
       ELSE 'svc' || (k % 7) || '.corp.example' END AS domain,
  CASE WHEN kind='purchase' AND k % 25 = 4 THEN 'http://malware-test.invalid/payload'
       WHEN kind='purchase' AND k % 25 = 8 THEN 'https://Files.Example.com:8443/a?b=1' END AS url,
  CASE WHEN kind='purchase' THEN CAST(floor(value * 1e7) AS BIGINT) END AS sent,
  CASE WHEN kind='error' THEN 'failed' WHEN kind='signup' THEN 'success'
       WHEN kind='view' THEN 'started' ELSE 'allowed' END AS status,
  's-' || k AS scenario_id,
  CASE WHEN k < 8 THEN 'intrusion' WHEN k % 20 = 0 THEN 'roaming' ELSE 'normal' END AS scenario_type,
  CASE WHEN k < 8 THEN 'Intrusion' WHEN k % 20 = 0 THEN 'Roaming' ELSE 'Benign' END AS label
FROM tel_k"""

CTE["flw"] = f"""
SELECT DISTINCT 'flow-' || md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, qc,
    price, disc, tax, l_returnflag, l_linestatus, dd)) AS event_id,
  {DAY0_US} + dd * 1000000 + (l_partkey * 7919 + l_linenumber * 104729 + l_orderkey * 31) % 1000000 AS ts_us,
  CASE WHEN l_linenumber % 2 = 0 THEN '172.16.' || (l_suppkey // 250) || '.' || (l_suppkey % 250)
       WHEN l_orderkey % 16 = 0 THEN NULL
       ELSE '172.20.' || (l_orderkey // 64 // 250) || '.' || (l_orderkey // 64 % 250) END AS sip,
  CASE WHEN l_orderkey % 50 = 7 THEN NULL
       ELSE '10.0.' || (l_suppkey // 250) || '.' || (l_suppkey % 250) END AS dip,
  CASE WHEN dd > 2200 AND l_partkey % 20 = 0 THEN CAST(50000 + dd // 100 AS INT)
       WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey % 97 + 1 AS INT)
       ELSE [22, 80, 443, 3389, 8080][(qc // 100) % 5 + 1] END AS port,
  CASE WHEN l_returnflag = 'R' THEN 'UDP' ELSE 'TCP' END AS protocol,
  CASE WHEN l_linenumber = 7 THEN qc // 100 * 1000 ELSE qc // 100 * 100 END AS sent,
  tax * 100 AS received,
  CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS syn,
  CASE WHEN disc > 5 THEN 2.0 ELSE 0.0 END AS ack,
  CAST(qc // 100 * 3 AS DOUBLE) AS packets, CAST(price AS DOUBLE) AS byte_rate,
  CAST(qc // 100 * 10 AS DOUBLE) AS packet_rate,
  CASE WHEN l_partkey % 13 = 0 THEN 'DoS' WHEN l_partkey % 17 = 0 THEN 'Benign'
       WHEN l_partkey % 29 = 0 THEN 'PortScan' WHEN l_partkey % 31 = 0 THEN '' ELSE 'Benign' END AS label
FROM (SELECT *, CAST(round(l_quantity * 100) AS BIGINT) AS qc,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
        CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax,
        datediff('day', DATE '1992-01-01', l_shipdate::DATE) AS dd FROM lineitem)"""

# --- rules: rule_id, rule_name, severity, conf, reason, ev[], first_us, last_us and the
# --- metadata later steps read (m_user, m_host, pattern_id, ioc, sent, nk_kind, nk_a, nk_b)
from palisade.functions.detection import DETECTION_NAMESPACE, INCIDENT_NAMESPACE, RULES  # noqa: E402


def _det(rule, conf, reason, ev, first, last, source, *, user="NULL", host="NULL",
         pattern="NULL", ioc="false", sent="NULL", nk=("NULL", "NULL", "NULL"), name=None):
    n, sev = RULES[rule]
    return f"""
SELECT '{rule}' AS rule_id, {q(name or n)} AS rule_name, '{sev}' AS severity,
  round({conf}, 3) AS conf, {reason} AS reason, {ev} AS ev, {first} AS first_us, {last} AS last_us,
  CAST({user} AS VARCHAR) AS m_user, CAST({host} AS VARCHAR) AS m_host,
  CAST({pattern} AS VARCHAR) AS pattern_id, {ioc} AS ioc, CAST({sent} AS BIGINT) AS m_sent,
  CAST({nk[0]} AS VARCHAR) AS nk_kind, CAST({nk[1]} AS VARCHAR) AS nk_a, CAST({nk[2]} AS VARCHAR) AS nk_b
  {source}"""


CTE["auth"] = "SELECT *, sip AS anchor FROM tel WHERE event_type='authentication'"
CTE["d_auth_001"] = _det(
    "AUTH-001", "least(0.60 + 0.08 * n, 0.95)",
    "n || ' failed authentication attempts for user ''' || usr || ''' from ' || anchor || "
    "' were followed by a successful authentication within 10 minutes.'",
    "list_sort(list_append(fails, event_id))", "first_us", "ts_us",
    """FROM (SELECT s.usr, s.anchor, s.event_id, s.ts_us, count(*) AS n, list(f.event_id) AS fails,
      min(f.ts_us) AS first_us FROM auth s JOIN auth f ON s.usr=f.usr AND s.anchor=f.anchor
      WHERE s.status='success' AND f.status='failed' AND f.ts_us >= s.ts_us - 600000000
        AND (f.ts_us, f.event_id) < (s.ts_us, s.event_id)
      GROUP BY ALL HAVING count(*) >= 3)""", user="usr")
_H = "((ts_us // 3600000000) % 24)"
CTE["d_auth_002"] = _det(
    "AUTH-002", f"CASE WHEN {_H} <= 5 THEN 0.65 ELSE 0.55 END",
    "'Authentication occurred outside the configured normal login window (08:00-20:00 UTC); "
    f"observed at ' || lpad({_H}::VARCHAR, 2, '0') || ':' || "
    "lpad(((ts_us // 60000000) % 60)::VARCHAR, 2, '0') || "
    "' UTC. This is not by itself evidence of compromise.'",
    "[event_id]", "ts_us", "ts_us",
    f"FROM auth WHERE status='success' AND NOT ({_H} >= 8 AND {_H} < 20)", user="usr")
CTE["d_auth_003"] = _det(
    "AUTH-003", "0.6",
    "'New source IP observed for user ''' || usr || ''' within supplied telemetry (first ' || (n-1) "
    "|| ' events used as history). This is not by itself evidence of compromise.'",
    "[event_id]", "ts_us", "ts_us",
    """FROM (SELECT *, count(*) OVER w AS n, count(sip) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known,
        row_number() OVER (PARTITION BY usr, sip ORDER BY ts_us, event_id) AS nth
      FROM auth WINDOW w AS (PARTITION BY usr ORDER BY ts_us, event_id))
      WHERE nth = 1 AND n > 3 AND known > 0""", user="usr")
CTE["procs"] = r"""SELECT *, lower(regexp_extract(process_name, '([^\\/]*)$', 1)) AS proc,
  lower(regexp_extract(parent_process, '([^\\/]*)$', 1)) AS parent
  FROM tel WHERE event_type='process_creation'"""
CTE["proc_hits"] = """
SELECT *, CASE
  WHEN proc IN ('powershell.exe','pwsh.exe','cmd.exe') AND parent IN ('services.exe','svchost.exe','wmiprvse.exe')
    THEN 'P1-shell-from-service'
  WHEN regexp_matches(lower(cmd), '-encodedcommand|-enc |frombase64string') THEN 'P2-encoded-indicator' END AS pattern
FROM procs"""
CTE["d_proc_001"] = _det(
    "PROC-001", "CASE WHEN pattern LIKE 'P1%' THEN 0.75 ELSE 0.85 END",
    "'Process telemetry matched pattern ''' || pattern || ''': ' || CASE WHEN pattern LIKE 'P1%' "
    "THEN 'interactive shell spawned by a service host process' "
    "ELSE 'encoded-command indicator in command-line telemetry' END || ' (process=''' || proc || "
    "''', parent=''' || parent || ''').'",
    "[event_id]", "ts_us", "ts_us", "FROM proc_hits WHERE pattern IS NOT NULL", pattern="pattern")
CTE["d_proc_002"] = _det(
    "PROC-002", "0.8",
    "'Observed configured suspicious parent-child relationship: ''' || parent || ''' spawned ''' || proc || '''.'",
    "[event_id]", "ts_us", "ts_us",
    "FROM procs WHERE (parent, proc) IN (('services.exe','powershell.exe'),('services.exe','cmd.exe'),"
    "('svchost.exe','powershell.exe'),('svchost.exe','cmd.exe'),('winword.exe','powershell.exe'),"
    "('excel.exe','powershell.exe'))")
CTE["ioc"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {q(t)}, {q(v)}, {c}, {q(d)})" for i, (t, v, c, d) in enumerate(INDICATORS)
) + ") t(ord, kind, indicator, confidence, description)"
CTE["d_net_001"] = _det(
    "NET-001", "confidence",
    "'Connection to controlled indicator ' || indicator || ' (' || ikind || '): ' || description || '.'",
    "[event_id]", "ts_us", "ts_us",
    """FROM (SELECT t.event_id, t.ts_us, i.indicator, i.kind AS ikind, i.confidence, i.description
      FROM tel t JOIN ioc i ON (i.kind='ip' AND t.dip=i.indicator) OR (i.kind='domain' AND lower(t.domain)=i.indicator)
      WHERE t.event_type IN ('dns_query','data_transfer','network_connection')
      QUALIFY row_number() OVER (PARTITION BY t.event_id ORDER BY i.ord) = 1)""", ioc="true")
CTE["dns_rows"] = f"""SELECT *, row_number() OVER w AS rn, lag(ts_us, {NEED - 1}) OVER w AS prev
  FROM tel WHERE event_type='dns_query' WINDOW w AS (PARTITION BY host, usr ORDER BY ts_us, event_id)"""
CTE["dns_cand"] = "SELECT host, usr, rn FROM dns_rows WHERE ts_us - prev <= 300000000"
CTE["dns_next"] = f"""SELECT a.host, a.usr, a.rn, min(b.rn) AS nxt FROM dns_cand a
  JOIN dns_cand b ON a.host=b.host AND a.usr=b.usr AND b.rn >= a.rn + {NEED} GROUP BY ALL"""
CTE_COLUMNS["dns_fire"] = "host, usr, rn"
CTE["dns_fire"] = """SELECT host, usr, min(rn) FROM dns_cand GROUP BY host, usr UNION ALL
  SELECT n.host, n.usr, n.nxt FROM dns_fire f JOIN dns_next n ON f.host=n.host AND f.usr=n.usr AND f.rn=n.rn"""
CTE["d_net_002"] = _det(
    "NET-002", f"{min(0.6 + NEED / 1000, 0.9)}",
    f"'High-volume DNS activity detected: {NEED} queries for host ''' || host || ''' / user ''' || usr || ''' within 5 minutes.'",
    "ids", "first_us", "last_us",
    f"""FROM (SELECT f.host, f.usr, f.rn, list_sort(list(r.event_id)) AS ids, min(ts_us) AS first_us, max(ts_us) AS last_us
      FROM dns_fire f JOIN dns_rows r ON f.host=r.host AND f.usr=r.usr AND r.rn BETWEEN f.rn - {NEED - 1} AND f.rn
      GROUP BY ALL)""", user="usr", host="host")
CTE["d_data_001"] = _det(
    "DATA-001", "least(0.75 + 0.05 * (length(bin(sent // 1000000000)) - 1), 0.95)",
    "'Outbound transfer of ' || format('{:,}', sent) || ' bytes by user ''' || usr || ''' on host ''' || host || "
    "''' meets the 1,000,000,000-byte threshold. Volume alone does not prove malicious intent.'",
    "[event_id]", "ts_us", "ts_us", "FROM tel WHERE event_type='data_transfer' AND sent >= 1000000000",
    user="usr", host="host", sent="sent")

# --- flow rules; fm_* = (rule-local group, member events)
CTE["fl"] = "SELECT *, coalesce(dip, 'GLOBAL') AS key, min(ts_us) OVER (PARTITION BY coalesce(dip, 'GLOBAL')) AS t0 FROM flw"
CTE["b60"] = "SELECT *, (ts_us - t0) // 60000000 AS idx FROM fl"
CTE["b30"] = "SELECT *, (ts_us - t0) // 30000000 AS idx FROM fl"
CTE["f1"] = f"""
SELECT *, greatest({float(FS['rate_min_count'])}, {FS['rate_baseline_factor']} * base) AS thr FROM (
  SELECT key, idx, n, coalesce(list_aggregate(list_concat(coalesce(prior, []),
      list_resize(CAST([] AS BIGINT[]), CAST(least(10, idx) - len(coalesce(prior, [])) AS BIGINT), 0)), 'median'), 0.0) AS base
  FROM (SELECT key, idx, n, list(n) OVER (PARTITION BY key ORDER BY idx RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING) AS prior
        FROM (SELECT key, idx, count(*) AS n FROM b60 GROUP BY ALL))
) WHERE n >= greatest({FS['rate_min_count']}, {FS['rate_baseline_factor']} * base)"""
CTE["f1m"] = """SELECT f.key, f.idx, f.n, b.event_id, b.ts_us,
  row_number() OVER (PARTITION BY f.key, f.idx ORDER BY b.ts_us, b.event_id) AS r FROM f1 f JOIN b60 b USING (key, idx)"""
_HOSTKEY = ("CASE WHEN key <> 'GLOBAL' THEN 'host' END", "CASE WHEN key <> 'GLOBAL' THEN key END", "NULL")
CTE["d_flow_001"] = _det(
    "FLOW-001", "least(0.55 + 0.05 * log2(n / thr), 0.9)",
    "'High-rate connection behavior detected: ' || n || ' flows to ' || key || ' within 60 seconds (baseline median ' || "
    "CASE WHEN idx > 0 AND least(10, idx) % 2 = 0 THEN format('{:.1f}', base) ELSE CAST(CAST(base AS BIGINT) AS VARCHAR) END || ').'",
    "ids", "first_us", "last_us",
    """FROM (SELECT f.key, f.idx, f.n, f.base, f.thr, list_sort(list(m.event_id)) AS ids, min(m.ts_us) AS first_us,
        max(m.ts_us) AS last_us FROM f1 f JOIN f1m m USING (key, idx)
      WHERE f.n <= 20 OR m.r <= 10 OR m.r > f.n - 10 GROUP BY ALL)""", nk=_HOSTKEY)
CTE["svc"] = """SELECT *, coalesce(dip, 'GLOBAL') || '|' || coalesce(port::VARCHAR, '?') AS skey,
  row_number() OVER (PARTITION BY dip, port ORDER BY ts_us, event_id) AS arn,
  syn > ack AND sent + received < 10240 AS short FROM flw"""
_N2 = FS["brute_min_flows"]
CTE["f2r"] = f"""SELECT *, row_number() OVER w AS rn, lag(ts_us, {_N2 - 1}) OVER w AS prev FROM svc WHERE short
  WINDOW w AS (PARTITION BY skey ORDER BY ts_us, event_id)"""
CTE["f2c"] = "SELECT skey, rn FROM f2r WHERE ts_us - prev < 300000000"
CTE["f2n"] = f"SELECT a.skey, a.rn, min(b.rn) AS nxt FROM f2c a JOIN f2c b ON a.skey=b.skey AND b.rn >= a.rn + {_N2} GROUP BY ALL"
CTE_COLUMNS["f2f"] = "skey, rn"
CTE["f2f"] = """SELECT skey, min(rn) FROM f2c GROUP BY skey UNION ALL
  SELECT n.skey, n.nxt FROM f2f f JOIN f2n n ON f.skey=n.skey AND f.rn=n.rn"""
CTE["f2w"] = """SELECT f.skey, f.rn, count(*) AS window_count FROM
   (SELECT r.skey, r.rn, r.arn, r.ts_us, coalesce(lag(r.arn) OVER (PARTITION BY r.skey ORDER BY r.rn), 0) AS reset
    FROM f2f JOIN f2r r USING (skey, rn)) f
  JOIN svc s ON s.skey=f.skey AND s.arn <= f.arn AND s.arn > f.reset AND s.ts_us > f.ts_us - 300000000 GROUP BY ALL"""
CTE["f2m"] = f"""SELECT f.skey, f.rn, r.event_id, r.ts_us FROM f2f f JOIN f2r r
  ON f.skey=r.skey AND r.rn BETWEEN f.rn - {_N2 - 1} AND f.rn"""
CTE["d_flow_002"] = _det(
    "FLOW-002", f"{min(0.60 + 0.02 * _N2, 0.9)}",
    f"'Repeated connection attempts detected: {_N2} short SYN-heavy flows to ' || skey || ' within 5 minutes.'",
    "ids", "first_us", "last_us",
    """FROM (SELECT skey, rn, list_sort(list(event_id)) AS ids, min(ts_us) AS first_us, max(ts_us) AS last_us
      FROM f2m GROUP BY ALL)""",
    nk=("CASE WHEN skey NOT LIKE 'GLOBAL%' THEN 'service' END",
        "CASE WHEN skey NOT LIKE 'GLOBAL%' THEN split_part(skey, '|', 1) END",
        "CASE WHEN skey NOT LIKE 'GLOBAL%' THEN split_part(skey, '|', 2) END"))
CTE["f3m"] = """SELECT ts_us // 60000000 AS minute, event_id, ts_us, port,
  row_number() OVER (PARTITION BY ts_us // 60000000 ORDER BY ts_us, event_id) AS r FROM flw"""
CTE["f3"] = f"""SELECT minute, sum(c) AS n, round(-sum((c / t) * log2(c / t)), 9) AS bits FROM
  (SELECT minute, port, count(*) AS c, sum(count(*)) OVER (PARTITION BY minute) AS t FROM f3m GROUP BY minute, port)
  GROUP BY minute HAVING sum(c) >= {FS['scan_min_ports']} AND bits >= {FS['scan_entropy_bits']}"""
CTE["d_flow_003b"] = _det(
    "FLOW-003", "least(0.5 + 0.05 * bits, 0.8)",
    "'Port-entropy anomaly detected: destination-port entropy ' || format('{:.2f}', bits) || ' bits across ' || n || "
    "' flows in one minute. This is not attributed to any source.'",
    "ids", "first_us", "last_us",
    """FROM (SELECT f.minute, f.n::BIGINT AS n, f.bits, list_sort(list(m.event_id)) AS ids, min(ts_us) AS first_us, max(ts_us) AS last_us
      FROM f3 f JOIN f3m m USING (minute) WHERE m.r <= 20 GROUP BY ALL)""", name="Port Entropy Anomaly")
# Port scans: candidates see enough ports when nothing fired before; `after` is the last firing inside a window.
_SPAN3 = 60_000_000
CTE["s3r"] = """SELECT sip, event_id, ts_us, port, coalesce(protocol = 'TCP', false) AND coalesce(syn, 0) > coalesce(ack, 0) AS probe,
  row_number() OVER (PARTITION BY sip ORDER BY ts_us, event_id) AS rn FROM flw WHERE sip <> ''"""
CTE["s3c"] = f"""SELECT a.sip, a.rn, a.ts_us FROM s3r a JOIN s3r b ON b.sip = a.sip AND b.rn <= a.rn
  AND b.ts_us > a.ts_us - {_SPAN3} GROUP BY ALL HAVING count(DISTINCT b.port) >= {FS['scan_min_ports']}"""
CTE["s3e"] = f"""SELECT sip, rn, ts_us, 0::BIGINT AS after FROM s3c UNION ALL
  SELECT i.sip, i.rn, i.ts_us, r.rn FROM s3c i JOIN s3c r ON r.sip = i.sip AND r.rn < i.rn AND r.ts_us > i.ts_us - {_SPAN3}"""
CTE["s3h"] = f"""SELECT sip, rn, ts_us, after FROM (
    SELECT e.sip, e.rn, e.ts_us, e.after, b.port, arg_min(b.probe, b.rn) AS probe FROM s3e e JOIN s3r b
      ON b.sip = e.sip AND b.rn <= e.rn AND b.rn > e.after AND b.ts_us > e.ts_us - {_SPAN3} AND b.port IS NOT NULL GROUP BY ALL)
  GROUP BY ALL HAVING count(*) >= {FS['scan_min_ports']} AND count_if(probe) / count(*) > 0.5"""
CTE["s3n"] = f"""SELECT r.sip, r.rn, min(h.rn) AS nxt FROM s3c r JOIN s3h h ON h.sip = r.sip AND h.rn > r.rn
  AND (h.after = r.rn OR (h.after = 0 AND h.ts_us - {_SPAN3} >= r.ts_us)) GROUP BY ALL"""
CTE_COLUMNS["s3f"] = "sip, rn, after"
CTE["s3f"] = """SELECT sip, min(rn), 0::BIGINT FROM s3h WHERE after = 0 GROUP BY sip UNION ALL
  SELECT n.sip, n.nxt, n.rn FROM s3f f JOIN s3n n ON n.sip = f.sip AND n.rn = f.rn"""
CTE["s3m"] = f"""SELECT f.sip, f.rn, b.port, arg_min(b.event_id, b.rn) AS event_id, min(b.ts_us) AS ts_us,
    row_number() OVER (PARTITION BY f.sip, f.rn ORDER BY b.port) AS r
  FROM s3f f JOIN s3r i ON i.sip = f.sip AND i.rn = f.rn JOIN s3r b ON b.sip = f.sip AND b.rn <= f.rn AND b.rn > f.after
    AND b.ts_us > i.ts_us - {_SPAN3} AND b.port IS NOT NULL GROUP BY f.sip, f.rn, b.port"""
CTE["d_flow_003"] = _det(
    "FLOW-003", "least(0.55 + 0.02 * n, 0.85)",
    "'Port-scan-like behavior detected: ' || n || ' distinct destination ports contacted from ' || sip || ' within 5 minutes.'",
    "ids", "first_us", "last_us",
    """FROM (SELECT sip, rn, count(*) AS n, list_sort(list(event_id) FILTER (r <= 20)) AS ids,
        min(ts_us) FILTER (r <= 20) AS first_us, max(ts_us) FILTER (r <= 20) AS last_us FROM s3m GROUP BY ALL)""",
    nk=("'scanner'", "sip", "NULL"))
CTE["f4"] = f"""
SELECT *, signal / (CASE WHEN base <= 0 THEN 1000000.0 ELSE base END) AS ratio FROM (
  SELECT key, idx, n, signal, len(prior) AS hist, list_aggregate(prior, 'median') AS base FROM (
    SELECT *, list(peak) OVER (PARTITION BY key ORDER BY idx RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS prior FROM (
      SELECT key, idx, count(*) AS n, median(byte_rate) AS signal, max(byte_rate) AS peak FROM b60 GROUP BY ALL)))
WHERE n >= {FS['byte_min_flows']} AND hist >= 5 AND signal >= 1000000
  AND signal >= {FS['byte_ratio']} * (CASE WHEN base <= 0 THEN 1000000.0 ELSE base END)"""
CTE["f4m"] = """SELECT f.key, f.idx, b.event_id, b.ts_us,
  row_number() OVER (PARTITION BY f.key, f.idx ORDER BY b.byte_rate DESC, b.event_id) AS r FROM f4 f JOIN b60 b USING (key, idx)"""
CTE["d_flow_004"] = _det(
    "FLOW-004", "least(0.55 + 0.1 * log2(greatest(ratio, 1.0)), 0.85)",
    "'Anomalous flow byte rate detected: median ' || format('{:,}', CAST(round_even(signal, 0) AS BIGINT)) || ' B/s vs ' || "
    "format('{:,}', CAST(round_even(base, 0) AS BIGINT)) || ' B/s recent median.'",
    "ids", "first_us", "last_us",
    """FROM (SELECT f.key, f.idx, f.signal, f.base, f.ratio, list_sort(list(m.event_id)) AS ids, min(m.ts_us) AS first_us,
        max(m.ts_us) AS last_us FROM f4 f JOIN f4m m USING (key, idx) WHERE m.r <= 3 GROUP BY ALL)""", nk=_HOSTKEY)
CTE["f5s"] = "SELECT min(ts_us) + CAST(round((max(ts_us) - min(ts_us)) / 3) AS BIGINT) AS split FROM flw"
CTE["f5r"] = """SELECT f.*, row_number() OVER (PARTITION BY protocol, port ORDER BY ts_us, event_id) AS r FROM flw f, f5s s
  WHERE f.ts_us >= s.split AND NOT EXISTS (SELECT 1 FROM flw k WHERE k.ts_us < s.split
    AND k.protocol = f.protocol AND k.port = f.port)"""
CTE["f5"] = f"""SELECT protocol, port, sum(c)::BIGINT AS n, max(c) AS peak FROM
  (SELECT protocol, port, ts_us // 60000000 AS minute, count(*) AS c FROM f5r GROUP BY ALL)
  GROUP BY ALL HAVING sum(c) >= 5 AND max(c) >= {FS['novelty_min_peak']}"""
CTE["d_flow_005"] = _det(
    "FLOW-005", "0.5",
    "'Unusual protocol/port combination observed: ' || protocol || '/' || port || ' (' || n || ' flows), unseen in baseline period.'",
    "ids", "first_us", "last_us",
    """FROM (SELECT f.protocol, f.port, f.n, list_sort(list(r.event_id)) AS ids, min(r.ts_us) AS first_us, max(r.ts_us) AS last_us
      FROM f5 f JOIN f5r r USING (protocol, port) WHERE r.r <= 5 GROUP BY ALL)""",
    nk=("'ppsvc'", "protocol", "port"))
CTE["f6"] = f"""SELECT key, idx, count(*) AS n, sum(packets) / 30 AS pps FROM b30 GROUP BY ALL
  HAVING count(*) >= {FS['burst_min_flows']} AND sum(packets) / 30 >= {FS['burst_min_pps']}"""
CTE["f6m"] = """SELECT f.key, f.idx, b.event_id, b.ts_us,
  row_number() OVER (PARTITION BY f.key, f.idx ORDER BY b.packet_rate DESC, b.packets DESC, b.event_id) AS r
  FROM f6 f JOIN b30 b USING (key, idx)"""
CTE["d_flow_006"] = _det(
    "FLOW-006", f"least(0.65 + 0.05 * log10(pps / {FS['burst_min_pps']}), 0.9)",
    "'Denial-of-service-like traffic pattern detected: ' || n || ' flows, ' || "
    "format('{:,}', CAST(round_even(pps, 0) AS BIGINT)) || ' packets/s within 30 seconds.'",
    "ids", "first_us", "last_us",
    """FROM (SELECT f.key, f.idx, f.n, f.pps, list_sort(list(m.event_id)) AS ids, min(m.ts_us) AS first_us,
        max(m.ts_us) AS last_us FROM f6 f JOIN f6m m USING (key, idx) WHERE m.r <= 20 GROUP BY ALL)""", nk=_HOSTKEY)

ENDPOINT_RULES = ("auth_001", "auth_002", "auth_003", "proc_001", "proc_002", "net_001", "net_002", "data_001")
FLOW_RULES = ("flow_001", "flow_002", "flow_003", "flow_004", "flow_005", "flow_006")


def _identified(source: str) -> str:
    return (f"SELECT *, {uuid5(DETECTION_NAMESPACE, 'fp')} AS did FROM "
            f"(SELECT *, rule_id || ':' || array_to_string(ev, ',') AS fp FROM ({source}))")


CTE["dets"] = _identified(" UNION ALL ".join(f"SELECT * FROM d_{r}" for r in ENDPOINT_RULES))
CTE["fdets"] = _identified(" UNION ALL ".join(f"SELECT * FROM d_{r}" for r in FLOW_RULES))

DET_OUT = ("did AS detection_id, rule_id, rule_name, severity, CAST(conf AS DOUBLE) AS confidence, reason, "
           "array_to_string(ev, ',') AS evidence, first_us, last_us")


def rule_sql(name: str) -> str:
    return sql(f"SELECT {DET_OUT} FROM ({_identified(f'SELECT * FROM d_{name}')})")

# --- correlation (endpoint: c_ / i_ / r_; flow: fc_ / fi_ / fr_)
SEQ = ("AUTH-001+PROC-001", "AUTH-001+PROC-002", "AUTH-001+NET-001", "NET-001+PROC-001", "NET-001+PROC-002",
       "DATA-001+PROC-001", "DATA-001+PROC-002", "DATA-001+NET-001", "AUTH-001+DATA-001")
FSEQ = ("FLOW-002+FLOW-003", "FLOW-001+FLOW-006")
_in = lambda xs: "(" + ",".join(q(x) for x in xs) + ")"
_PAIR = "least(a.rule_id, b.rule_id) || '+' || greatest(a.rule_id, b.rule_id)"
_GAP = "greatest(a.first_us, b.first_us) - least(a.last_us, b.last_us) <= 1800000000"

CTE["ent"] = """SELECT d.*, CASE WHEN ulo = uhi THEN ulo WHEN ulo IS NULL THEN m_user END AS usr,
    CASE WHEN hlo = hhi THEN hlo WHEN hlo IS NULL THEN m_host END AS host
  FROM dets d LEFT JOIN (SELECT did, min(t.usr) AS ulo, max(t.usr) AS uhi, min(t.host) AS hlo, max(t.host) AS hhi
    FROM (SELECT did, unnest(ev) AS event_id FROM dets) e JOIN tel t USING (event_id) GROUP BY did) s USING (did)"""
CTE["ent_links"] = f"""SELECT a.did AS a_did, b.did AS b_did, {_PAIR} AS pair, len(list_intersect(a.ev, b.ev)) > 0 AS sh_ev,
    false AS sh_bk, {_PAIR} IN {_in(SEQ)} AS seqd
  FROM ent a JOIN ent b ON a.usr = b.usr AND a.host = b.host AND a.did < b.did
  WHERE {_GAP} AND (len(list_intersect(a.ev, b.ev)) > 0 OR {_PAIR} IN {_in(SEQ)})"""
CTE["fmem"] = f"""
SELECT {uuid5(DETECTION_NAMESPACE, 'fp')} AS did, event_id FROM (
  SELECT 'FLOW-001:' || array_to_string(d.ids, ',') AS fp, m.event_id FROM f1m m JOIN
    (SELECT key, idx, list_sort(list(event_id)) AS ids FROM f1m WHERE n <= 20 OR r <= 10 OR r > n - 10 GROUP BY ALL) d USING (key, idx)
  UNION ALL SELECT 'FLOW-002:' || array_to_string(d.ids, ','), m.event_id FROM f2m m JOIN
    (SELECT skey, rn, list_sort(list(event_id)) AS ids FROM f2m GROUP BY ALL) d USING (skey, rn)
  UNION ALL SELECT 'FLOW-003:' || array_to_string(d.ids, ','), m.event_id FROM s3m m JOIN
    (SELECT sip, rn, list_sort(list(event_id) FILTER (r <= 20)) AS ids FROM s3m GROUP BY ALL) d USING (sip, rn)
  UNION ALL SELECT 'FLOW-004:' || array_to_string(d.ids, ','), m.event_id FROM f4m m JOIN
    (SELECT key, idx, list_sort(list(event_id)) AS ids FROM f4m WHERE r <= 3 GROUP BY ALL) d USING (key, idx)
  UNION ALL SELECT 'FLOW-005:' || array_to_string(d.ids, ','), m.event_id FROM f5r m JOIN
    (SELECT protocol, port, list_sort(list(event_id)) AS ids FROM f5 JOIN f5r USING (protocol, port) WHERE r <= 5 GROUP BY ALL) d USING (protocol, port)
  UNION ALL SELECT 'FLOW-006:' || array_to_string(d.ids, ','), m.event_id FROM f6m m JOIN
    (SELECT key, idx, list_sort(list(event_id)) AS ids FROM f6m WHERE r <= 20 GROUP BY ALL) d USING (key, idx))"""
CTE["fent"] = "SELECT *, CAST(NULL AS VARCHAR) AS usr, CAST(NULL AS VARCHAR) AS host FROM fdets"
_COMPAT = ("(a.nk_a = b.nk_a AND ((a.nk_kind = b.nk_kind AND a.nk_b IS NOT DISTINCT FROM b.nk_b) OR "
           "(a.nk_kind || b.nk_kind IN ('hostservice', 'servicehost'))))")
CTE["fshared"] = """SELECT x.did AS a_did, y.did AS b_did, count(*) AS n FROM fmem x JOIN fmem y
  ON x.event_id = y.event_id AND x.did < y.did GROUP BY ALL"""
CTE["fent_links"] = f"""
SELECT a.did AS a_did, b.did AS b_did, {_PAIR} AS pair, false AS sh_ev, true AS sh_bk, {_PAIR} IN {_in(FSEQ)} AS seqd
  FROM fshared s JOIN fent a ON a.did = s.a_did JOIN fent b ON b.did = s.b_did
  WHERE {_GAP} AND (coalesce({_COMPAT}, false) OR {_PAIR} IN {_in(FSEQ)})
UNION ALL
SELECT a.did, b.did, {_PAIR}, false, false, true FROM fent a JOIN fent b ON a.nk_a = b.nk_a AND a.did < b.did
  WHERE {_GAP} AND {_COMPAT} AND {_PAIR} IN {_in(FSEQ)}"""


def _incident_ctes(p: str, ent: str, links: str) -> None:
    CTE[f"{p}edge"] = f"SELECT a_did AS x, b_did AS y FROM {links} UNION SELECT b_did, a_did FROM {links}"
    CTE_COLUMNS[f"{p}reach"] = "did, lab"
    # Least label spreads along edges until nothing new is reached.
    CTE[f"{p}reach"] = f"SELECT did, did FROM {ent} UNION SELECT e.y, r.lab FROM {p}reach r JOIN {p}edge e ON e.x = r.did AND r.lab < e.y"
    CTE[f"{p}comp"] = f"SELECT did, min(lab) AS comp FROM {p}reach GROUP BY did"
    CTE[f"{p}told"] = f"""SELECT comp, bool_or(sh_ev) AS sh_ev, bool_or(sh_bk) AS sh_bk, bool_or(seqd) AS seqd,
        list_sort(list(DISTINCT pair)) AS hits FROM {links} l JOIN {p}comp c ON c.did = l.a_did GROUP BY comp"""
    has = lambda *r: " AND ".join(f"list_contains(rule_ids, '{x}')" for x in r)
    CTE[f"{p}inc0"] = f"""
SELECT g.*, coalesce(t.sh_ev, false) AS sh_ev, coalesce(t.sh_bk, false) AS sh_bk, coalesce(t.seqd, false) AS seqd,
    coalesce(t.hits, []) AS hits FROM (
  SELECT comp, list_sort(list(did)) AS dids, list_sort(list_distinct(flatten(list(ev)))) AS ev,
    min(first_us) AS first_us, max(last_us) AS last_us,
    CASE WHEN min(usr) = max(usr) THEN min(usr) END AS usr, CASE WHEN min(host) = max(host) THEN min(host) END AS host,
    list_sort(list(DISTINCT rule_id)) AS rule_ids, list_sort(list(DISTINCT rule_name)) AS names,
    avg(conf) AS mean, max(CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) AS top,
    count(*) AS n, bool_or(ioc) AS ioc, max(m_sent) AS sent,
    list_sort(list(DISTINCT nk_kind || ':' || nk_a || coalesce(':' || nk_b, '')) FILTER (nk_kind IS NOT NULL)) AS nets
  FROM {ent} JOIN {p}comp USING (did) GROUP BY comp) g LEFT JOIN {p}told t USING (comp)"""
    CTE[f"{p}inc"] = f"""
SELECT *, {uuid5(INCIDENT_NAMESPACE, "'incident:' || array_to_string(dids, ',')")} AS iid,
  'Correlated ' || n || ' detections (' || array_to_string(rule_ids, ', ') || ')' ||
   CASE WHEN usr IS NOT NULL AND host IS NOT NULL THEN ' for user ''' || usr || ''' on host ''' || host || ''''
        WHEN usr IS NOT NULL THEN ' for user ''' || usr || '''' ELSE '' END ||
   ' within the correlation window: ' || array_to_string(names, '; ') || '. Correlation score ' || format('{{:.2f}}', conf) ||
   '. This is a potential multi-stage security story assembled from individual signals — not a confirmed compromise or breach.' AS reason,
  CASE WHEN {has('AUTH-001','PROC-001','NET-001','DATA-001')} THEN 'CRITICAL'
    WHEN list_contains(rule_ids,'AUTH-001') AND (list_contains(rule_ids,'PROC-001') OR list_contains(rule_ids,'PROC-002')) THEN 'HIGH'
    WHEN top >= 2 THEN 'HIGH' WHEN top = 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN {has('AUTH-001','PROC-001','NET-001','DATA-001')} THEN 'Potential Credential Compromise with Suspicious Data Transfer'
    WHEN {has('AUTH-001','PROC-001')} THEN 'Potential Credential Compromise Sequence'
    WHEN {has('AUTH-001','PROC-002')} THEN 'Potential Credential Compromise Sequence'
    WHEN {has('PROC-001','NET-001')} THEN 'Correlated Suspicious Process and Network Activity'
    WHEN {has('NET-001','DATA-001')} THEN 'Suspicious External Activity with Data Transfer'
    WHEN n = 1 THEN names[1] || ' — Single-Signal Observation'
    ELSE 'Correlated Suspicious Activity (' || array_to_string(list_sort(list_distinct(list_transform(rule_ids, lambda r: split_part(r, '-', 1)))), ', ') || ')' END AS title
FROM (SELECT *, round(CASE WHEN n = 1 THEN least(0.30 + 0.10 * top / 3.0 + 0.10 * mean, 1.0)
    ELSE least(0.55::DOUBLE + CASE WHEN sh_ev THEN 0.25 ELSE 0 END + CASE WHEN sh_bk THEN 0.25 ELSE 0 END
      + CASE WHEN seqd THEN 0.15 ELSE 0 END + CASE WHEN len(rule_ids) > 1 THEN 0.05 ELSE 0 END + 0.10 * mean, 1.0) END, 3)::DOUBLE AS conf
  FROM {p}inc0)"""
    CTE[f"{p}map"] = f"""SELECT DISTINCT i.iid, t.technique_id, t.technique_name, t.tactic, t.rule_id AS source_rule_id, t.confidence
      FROM {p}inc i JOIN (SELECT c.comp, d.rule_id, d.pattern_id FROM {ent} d JOIN {p}comp c USING (did)) m ON m.comp = i.comp
      JOIN tech t ON t.rule_id = m.rule_id AND (t.pattern IS NULL OR t.pattern = m.pattern_id)"""
    flat = lambda r: f"list_contains(flat, '{r}')"
    chain = f"({flat('AUTH-001')} AND {flat('NET-001')} AND ({flat('PROC-001')} OR {flat('PROC-002')}))"
    CTE[f"{p}risk"] = f"""
SELECT *, CASE WHEN total <= 24 THEN 'LOW' WHEN total <= 49 THEN 'MEDIUM' WHEN total <= 79 THEN 'HIGH' ELSE 'CRITICAL' END AS band FROM (
 SELECT *, least(100, p_sev + p_div + p_conf + p_ev + p_seq + p_mitre + p_ctx) AS total FROM (
  SELECT i.*, m.tids, CASE i.severity WHEN 'LOW' THEN 10 WHEN 'MEDIUM' THEN 25 WHEN 'HIGH' THEN 45 ELSE 60 END AS p_sev,
    least(8 * len(rule_ids), 24) AS p_div, CAST(round_even(10 * mean, 0) AS INT) AS p_conf, least(len(ev), 10) AS p_ev,
    CASE WHEN {chain} AND {flat('DATA-001')} THEN 15 WHEN {chain} THEN 10 ELSE 0 END AS p_seq,
    least(coalesce(m.tactics, 0) * 3, 12) AS p_mitre,
    CASE WHEN ioc THEN 12 ELSE 0 END
      + CASE WHEN list_contains(rule_ids,'PROC-001') OR list_contains(rule_ids,'PROC-002') THEN 8 ELSE 0 END
      + CASE WHEN sent IS NULL THEN 0 ELSE least(5 + 2 * (length(bin(sent // 1000000000)) - 1), 12) END AS p_ctx
  FROM (SELECT *, list_distinct(flatten(list_transform(hits, lambda h: string_split(h, '+')))) AS flat FROM {p}inc) i
  LEFT JOIN (SELECT iid, count(DISTINCT tactic) AS tactics, list_sort(list(DISTINCT technique_id)) AS tids FROM {p}map GROUP BY iid) m
    ON m.iid = i.iid))"""


CTE["tech"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({q(r)}, {q(t)}, {q(dict((a, b) for a, b, _ in TECHNIQUES)[t])}, {q(dict((a, c) for a, _, c in TECHNIQUES)[t])}, "
    f"{c}, {q(p) if p else 'NULL'}, {q(why)})" for r, t, c, p, why in RULE_TECHNIQUES
) + ") t(rule_id, technique_id, technique_name, tactic, confidence, pattern, rationale)"
_incident_ctes("c_", "ent", "ent_links")
_incident_ctes("fc_", "fent", "fent_links")


def incident_sql(p: str) -> str:
    return sql(f"""SELECT iid AS incident_id, title, severity, 'NEW' AS status, conf AS confidence, reason,
      array_to_string(dids, ',') AS detection_ids, array_to_string(ev, ',') AS evidence, first_us, last_us, usr AS user_name, host,
      array_to_string(rule_ids, ',') AS rule_ids, array_to_string(nets, ',') AS network_entities,
      array_to_string(hits, ',') AS sequence_hits, n AS detection_count, len(ev) AS event_count FROM {p}inc""")


def risk_sql(p: str) -> str:
    return sql(risk_body(p))


def risk_body(p: str) -> str:
    return (f"""SELECT iid AS incident_id, CAST(total AS INT) AS risk_score, band AS risk_band, p_sev AS severity_points,
      p_div AS diversity_points, p_conf AS confidence_points, p_ev AS evidence_points, p_seq AS sequence_points,
      p_mitre AS mitre_points, p_ctx AS contextual_points,
      'Risk ' || total || ' (' || band || ') is elevated because the incident contains base severity ' || severity || ' (' || p_sev || '), '
      || len(rule_ids) || ' distinct detection rules (' || p_div || ')' || CASE WHEN ioc THEN ', IOC evidence present' ELSE '' END
      || CASE WHEN list_contains(rule_ids,'PROC-001') OR list_contains(rule_ids,'PROC-002') THEN ', suspicious process activity present' ELSE '' END
      || CASE WHEN sent IS NOT NULL THEN ', large outbound transfer (' || format('{{:,}}', sent) || ' bytes)' ELSE '' END
      || CASE WHEN p_seq > 0 THEN ', recognized multi-stage sequence' ELSE '' END
      || coalesce(', ATT&CK hypotheses ' || array_to_string(tids, ', '), '')
      || '. Score prioritizes investigation; it is not a probability of compromise.' AS risk_explanation FROM {p}risk""")


# --- behaviour: the forest and its scores

def forest(features: str, cfg, training: str) -> None:
    """Fragments that grow the isolation forest on `training` rows and score all observations."""
    names = [f.rsplit(" AS ", 1)[1] for f in features.split(", round(")]
    levels = (cfg.tree_rows - 1).bit_length()
    CTE["tobs"] = CTE["uobs"].replace("FROM tel)", f"FROM tel WHERE {training})")
    hash_of = lambda text, start, digits: f"('0x' || substr(md5({text}), {start}, {digits}))::BIGINT"
    key = f"entity_key || '|' || window_us || '|{cfg.seed}'"
    x = ", ".join(names)
    CTE["usample"] = f"""SELECT tree, x FROM (SELECT t.tree::INT AS tree, [{x}] AS x, row_number() OVER (PARTITION BY t.tree
      ORDER BY ({hash_of(key, 1, 8)} % 2147483647 * (t.tree + 1) + {hash_of(key, 9, 8)} % 2147483647) % 2147483647, entity_key, window_us) AS r
      FROM tobs, range({cfg.trees}) t(tree)) WHERE r <= {cfg.tree_rows}"""
    search = "CASE WHEN {0} > 2 THEN 2 * (ln({0} - 1) + 0.5772156649015329) - 2 * ({0} - 1) / {0} WHEN {0} = 2 THEN 1.0 ELSE 0.0 END"
    CTE["ulevels"] = f"""SELECT ceil(log2(r))::INT AS levels, {search.format('r')} AS search
      FROM (SELECT least({cfg.tree_rows}, greatest(2, count(*))) AS r FROM tobs)"""
    CTE["ugrow0"] = "SELECT tree, 1::BIGINT AS node, x FROM usample"
    over = "OVER (PARTITION BY tree, node)"
    low, high = (", ".join(f"{f}(x[{j}]) {over}" for j in range(1, len(names) + 1)) for f in ("min", "max"))
    seed = f"'{cfg.seed}|' || tree || '|' || node"
    for d in range(levels + 1):
        CTE[f"ucut{d}"] = f"""SELECT tree, node, x, n, f, CASE WHEN f >= 0 THEN lo[f + 1] + {hash_of(seed, 9, 13)} / 4503599627370496.0::DOUBLE * (hi[f + 1] - lo[f + 1]) ELSE 0.0 END AS cut
          FROM (SELECT *, CASE WHEN len(vary) = 0 OR {d} >= levels THEN -1 ELSE vary[{hash_of(seed, 1, 8)} % greatest(len(vary), 1) + 1] END::INT AS f
            FROM (SELECT *, list_filter(range({len(names)}), lambda j: hi[j + 1] > lo[j + 1]) AS vary
              FROM (SELECT *, count(*) {over} AS n, [{low}] AS lo, [{high}] AS hi FROM ugrow{d})), ulevels)"""
        CTE[f"ugrow{d + 1}"] = f"SELECT tree, node * 2 + (x[f + 1] > cut)::BIGINT AS node, x FROM ucut{d} WHERE f >= 0"
    CTE["unodes"] = " UNION ALL ".join(
        f"SELECT DISTINCT tree, node, f AS feature, cut, n, CASE WHEN f < 0 THEN round(({search.format('n')} + {d}) * 1048576)::BIGINT ELSE 0 END AS path FROM ucut{d}"
        for d in range(levels + 1))
    for name, obs in (("t", "tobs"), ("u", "uobs")):
        CTE[f"{name}walk0"] = f"""SELECT entity_key, window_us, [{x}] AS x, t.tree::INT AS tree, 1::BIGINT AS node, NULL::BIGINT AS path
          FROM {obs}, range({cfg.trees}) t(tree)"""
        for d in range(levels + 1):
            CTE[f"{name}walk{d + 1}"] = f"""SELECT w.entity_key, w.window_us, w.x, w.tree,
              CASE WHEN k.feature < 0 THEN k.node ELSE k.node * 2 + (w.x[k.feature + 1] > k.cut)::BIGINT END AS node,
              CASE WHEN k.feature < 0 THEN k.path END AS path FROM {name}walk{d} w JOIN unodes k ON k.tree = w.tree AND k.node = w.node"""
        CTE[f"{name}deep"] = f"SELECT entity_key, window_us, sum(path)::BIGINT AS depth FROM {name}walk{levels + 1} GROUP BY ALL"
    raw = lambda depth: f"power(2.0::DOUBLE, -({depth} / {float(cfg.trees * 1048576)}::DOUBLE) / search)"
    CTE["uflag"] = f"SELECT list_sort(list(-depth)) AS h, ceil((count(*) - 1) * {1.0 - cfg.contamination}::DOUBLE)::BIGINT + 1 AS place FROM tdeep"
    CTE["ubounds"] = f"SELECT -h[place] AS least_depth, {raw('(-h[1])')} AS lo, {raw('(-h[len(h)])')} AS hi FROM uflag, ulevels"
    CTE["ubase"] = """SELECT entity_key, window_us, hw AS history_windows,
       CASE WHEN hw = 0 AND he = 0 THEN 'COLD_START' WHEN hw < 5 OR he < 10 THEN 'INSUFFICIENT_HISTORY' ELSE 'READY' END AS baseline_status, event_count FROM
       (SELECT entity_key, window_us, event_count, count(*) OVER v AS hw, coalesce(sum(event_count) OVER v, 0)::BIGINT AS he FROM uobs
        WINDOW v AS (PARTITION BY entity_key ORDER BY window_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
    CTE["uscored"] = f"""SELECT entity_key, window_us, round(greatest(least(({raw('depth')} - lo) / greatest(hi - lo, 1e-9), 1.0), 0.0), 4) AS anomaly_score,
      depth <= least_depth AS anomaly_flag, '{cfg.model_version}' AS model_version, '{cfg.feature_version}' AS feature_version,
      baseline_status, history_windows, event_count::BIGINT AS event_count FROM udeep JOIN ubase USING (entity_key, window_us), ubounds, ulevels"""
