"""Edges, resets and skew splits against small brute-force models."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palisade.config import MINUTE, SECOND, CorrelateConfig, DetectConfig, FlowConfig
from palisade.functions.core import from_micros
from palisade.operators import correlate as corr
from palisade.operators import cases, endpoint, flow, portscan
from palisade.operators.components import connected_components
from palisade.schema import EVENT_COLUMNS, FLOW_FIELDS, FLOW_NUMERICS, EVENT_DDL

T0 = 1_788_393_600 * SECOND


def make_events(spark, rows):
    names = [n for n, _ in EVENT_COLUMNS]
    data = [tuple({"source": "t", "raw_event": "{}", **r}.get(n) for n in names if n != "timestamp") + (r["us"],)
            for r in rows]
    ddl = ", ".join(p for p in EVENT_DDL.split(", ") if not p.startswith("`timestamp`")) + ", ts_us bigint"
    return spark.createDataFrame(data, ddl).withColumn("timestamp", from_micros("ts_us"))


def make_flows(spark, rows):
    kinds = dict(event_id="string", ts_us="bigint", destination_port="int", bytes_sent="bigint",
                 bytes_received="bigint")
    cols = [(c, kinds.get(c, "string")) for c in FLOW_FIELDS] + [(c, "double") for _, c in FLOW_NUMERICS]
    base = dict(destination_ip="10.0.0.9", destination_port=443, protocol="TCP", bytes_sent=1000,
                bytes_received=800, syn=1.0, ack=1.0, byte_rate=5000.0, packet_rate=10.0)
    data = [tuple({**base, **r}.get(c) for c, _ in cols) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{c} {t}" for c, t in cols))


def auth(i, us, status, user="ann", ip="10.1.1.1"):
    return dict(event_id=f"e{i:03d}", us=us, event_type="authentication", status=status, user=user,
                host="h", source_ip=ip)


@pytest.mark.parametrize("fails,gap_s,fires", [(3, 600, True), (3, 601, False), (2, 60, False), (4, 0, True)])
def test_auth_001_edges(spark, fails, gap_s, fires):
    rows = [auth(i, T0, "failed") for i in range(fails)] + [auth(90, T0 + gap_s * SECOND, "success")]
    out = endpoint.auth_001(make_events(spark, rows)).collect()
    assert len(out) == int(fires)
    if fires:
        assert out[0].metadata.fail_count == fails and out[0].confidence == round(min(0.6 + 0.08 * fails, 0.95), 3)


def test_auth_001_needs_earlier_position(spark):
    rows = [auth(i, T0, "failed") for i in (1, 2, 9)] + [auth(5, T0, "success")]
    assert endpoint.auth_001(make_events(spark, rows)).count() == 0


@pytest.mark.parametrize("n,span_s,fires", [(100, 300, 1), (99, 10, 0), (100, 301, 0), (200, 100, 2)])
def test_net_002_edges(spark, n, span_s, fires):
    step = span_s * SECOND // (n - 1)
    times = [T0 + i * step for i in range(n - 1)] + [T0 + span_s * SECOND]
    rows = [dict(event_id=f"d{i:04d}", us=t, event_type="dns_query", host="h", user="u") for i, t in enumerate(times)]
    assert endpoint.net_002(make_events(spark, rows)).count() == fires


def greedy_model(times, need, window, closed):
    out, start = [], 0
    for end in range(len(times)):
        while (times[end] - times[start] > window) if closed else (times[end] - times[start] >= window):
            start += 1
        if end - start + 1 >= need:
            out.append((start, end))
            start = end + 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_reset_after_firing_in_chunks(spark, seed):
    rng = random.Random(seed)
    rows, t = [], T0
    for i in range(600):
        t += rng.choice([0, 1, 5, 20, 90]) * SECOND
        rows.append(dict(event_id=f"d{i:04d}", us=t, event_type="dns_query", host="h", user="u"))
    cfg = DetectConfig(dns_threshold=7, dns_window_minutes=2, slice_minutes=9, chunk_rows=16)
    got = {tuple(r.evidence_event_ids) for r in endpoint.net_002(make_events(spark, rows), cfg).collect()}
    times = [r["us"] for r in rows]
    want = {tuple(rows[i]["event_id"] for i in range(a, b + 1)) for a, b in greedy_model(times, 7, 2 * MINUTE, True)}
    assert got == want and len(want) > 5


def flow_002_model(rows, need, window):
    groups, out = defaultdict(list), {}
    for r in sorted(rows, key=lambda r: (r["ts_us"], r["event_id"])):
        groups[r["destination_port"]].append(r)
    for members in groups.values():
        held = []
        for r in members:
            held = [h for h in held if r["ts_us"] - h["ts_us"] < window] + [r]
            short = [h for h in held if h["syn"] > h["ack"]]
            if len(short) >= need:
                out[tuple(h["event_id"] for h in short)] = len(held)
                held = []
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_flow_002_against_model(spark, seed):
    rng = random.Random(seed)
    rows, t = [], T0
    for i in range(500):
        t += rng.choice([0, 1, 4, 30, 100]) * SECOND
        rows.append(dict(event_id=f"f{i:04d}", ts_us=t, destination_port=rng.choice([22, 80]),
                         syn=float(rng.random() < 0.6), ack=0.0))
    cfg = FlowConfig(brute_min_flows=6, brute_window_minutes=2, slice_minutes=3, chunk_rows=8)
    out = flow.flow_002(make_flows(spark, rows), cfg)
    got = {tuple(sorted(r.evidence_event_ids)): r.metadata.window_count for r in out.detections.collect()}
    want = flow_002_model(rows, 6, 2 * MINUTE)
    assert got == {tuple(sorted(k)): v for k, v in want.items()} and len(want) >= 5


def scan_model(rows, need, fraction, outer, dense):
    out = []
    by_source = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["ts_us"], r["event_id"])):
        by_source[r["source_ip"]].append(r)
    for members in by_source.values():
        start = 0
        for end, r in enumerate(members):
            wide = [m for m in members[start:end + 1] if r["ts_us"] - m["ts_us"] < outer]
            near = [m for m in wide if r["ts_us"] - m["ts_us"] < dense]
            first = {}
            for m in near:
                first.setdefault(m["destination_port"], m)
            probes = sum(m["protocol"] == "TCP" and m["syn"] > m["ack"] for m in first.values())
            if len({m["destination_port"] for m in wide}) >= need and len(first) >= need \
                    and probes / len(first) > fraction:
                out.append(tuple(sorted(first[p]["event_id"] for p in sorted(first)[:20])))
                start = end + 1
    return sorted(out)


@pytest.mark.parametrize("seed,whole", [(5, 10), (6, 10), (5, 10_000)])
def test_flow_003_against_model(spark, seed, whole):
    rng = random.Random(seed)
    rows, t = [], T0
    for i in range(900):
        t += rng.choice([0, 1, 2, 3, 8] if i % 300 < 250 else [20, 70])
        rows.append(dict(event_id=f"f{i:04d}", ts_us=T0 + (t - T0) * SECOND, source_ip=rng.choice("ab"),
                         destination_port=rng.randint(1, 40), protocol=rng.choice(["TCP", "TCP", "UDP"]),
                         syn=float(rng.random() < 0.8), ack=0.0))
    cfg = FlowConfig(scan_min_ports=6)
    out = portscan.flow_003(make_flows(spark, rows), cfg, part_slots=2, whole_rows=whole)
    got = sorted(tuple(r.evidence_event_ids) for r in out.detections.collect())
    want = scan_model(rows, 6, 0.5, 5 * MINUTE, MINUTE)
    assert got == want and len(want) > 10


@pytest.mark.parametrize("n,fires", [(55, 1), (30, 0)])
def test_flow_001_counts(spark, n, fires):
    out = flow.flow_001(make_flows(spark, [dict(event_id=f"f{i:03d}", ts_us=T0 + i * SECOND) for i in range(n)]))
    got = out.detections.collect()
    assert len(got) == fires
    if fires:
        assert len(got[0].evidence_event_ids) == 20 and got[0].metadata["count"] == 55
        assert out.members.count() == 55


def test_entropy_is_off_when_a_source_is_known(spark):
    rows = [dict(event_id=f"f{i:03d}", ts_us=T0 + i, destination_port=i + 1) for i in range(32)]
    assert flow.flow_003b(make_flows(spark, rows)).detections.count() == 1
    rows[3]["source_ip"] = "10.9.9.9"
    assert flow.flow_003b(make_flows(spark, rows)).detections.count() == 0


def components_model(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_components_long_chain_and_random(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100)] + [(rng.randrange(101, 200), rng.randrange(101, 200)) for _ in range(60)]
    v = spark.createDataFrame([(f"{i:03d}",) for i in range(200)], "id string")
    e = spark.createDataFrame([(f"{a:03d}", f"{b:03d}") for a, b in edges], "src string, dst string")
    got = {r.id: r.component for r in connected_components(v, e).collect()}
    want = components_model(200, edges)
    assert got == {f"{i:03d}": f"{want[i]:03d}" for i in range(200)}


@pytest.mark.parametrize("seed", [8, 9, 10])
def test_close_pairs_connect_like_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        a = rng.randrange(0, 1000)
        rows.append((f"{i:02d}", rng.choice(["AUTH-001", "PROC-001", "NET-001"]), rng.choice("uv"),
                     a * MINUTE, (a + rng.choice([0, 5, 70])) * MINUTE))
    cfg = CorrelateConfig()
    spans = spark.createDataFrame(rows, "detection_id string, rule_id string, ent string, first_us bigint, last_us bigint")
    edges, facts = corr.close_pairs(spans, ["ent"], 30 * MINUTE, cfg.sequence_pairs)
    known = {frozenset(p) for p in cfg.sequence_pairs}
    near = [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows[:i])
            if a[2] == b[2] and frozenset((a[1], b[1])) in known
            and max(a[3], b[3]) - min(a[4], b[4]) <= 30 * MINUTE]
    mine = [(int(r.src), int(r.dst)) for r in edges.collect()]
    assert components_model(60, mine) == components_model(60, near)
    pairs = {f"{min(rows[i][1], rows[j][1])}+{max(rows[i][1], rows[j][1])}" for i, j in near}
    assert {r.pair for r in facts.select("pair").distinct().collect()} == pairs


def test_order_of_input_does_not_matter(spark):
    rng = random.Random(11)
    rows = [auth(i, T0 + rng.randrange(0, 3600) * SECOND, rng.choice(["failed", "failed", "success"]))
            for i in range(200)]
    one = endpoint.auth_001(make_events(spark, rows)).select("detection_id", "reason")
    rng.shuffle(rows)
    two = endpoint.auth_001(make_events(spark, rows).repartition(7)).select("detection_id", "reason")
    assert one.count() > 3 and one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_numbering_splits_one_key_and_one_instant(spark):
    from palisade.operators.ordering import number_rows
    n = 20_000
    rows = spark.range(n).select(F.lit("k").alias("key"), F.lit(5).cast("long").alias("ts_us"),
                                 F.lpad(F.col("id").cast("string"), 8, "0").alias("event_id"))
    out = number_rows(rows, ["key"])
    assert out.where(F.col("event_id").cast("long") + 1 != F.col("rn")).count() == 0 and out.count() == n
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = rows.repartitionByRange("key", "ts_us", "event_id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) > 2 and max(r["count"] for r in ranges) < 0.6 * n


def test_components_with_hubs(spark, monkeypatch):
    """A large star, a chain and pairs, with every round by shuffle and in one task."""
    from palisade.operators import components

    hub = [(0, i) for i in range(2, 3000, 2)]
    chain = [(i, i + 2) for i in range(10_001, 10_201, 2)]
    pairs = [(50_000 + 2 * i, 50_001 + 2 * i) for i in range(50)] + [(7, 7)]
    edges = spark.createDataFrame(hub + chain + pairs, "src long, dst long").repartition(5)
    vertices = spark.createDataFrame(sorted({(x,) for e in hub + chain + pairs for x in e}) + [(99_999,)], "id long")
    want = {x: 0 for e in hub for x in e} | {x: 10_001 for e in chain for x in e} | {x: 50_000 + (x - 50_000) // 2 * 2 for e in pairs[:-1] for x in e}
    want |= {7: 7, 99_999: 99_999}
    for limit in (50_000, 10):
        monkeypatch.setattr(components, "ONE_TASK", limit)
        assert {r.id: r.component for r in components.connected_components(vertices, edges).collect()} == want


@pytest.mark.parametrize("seed", [0, 1])
def test_prefix_scan_over_one_key(spark, seed):
    """Sums, greatest and last values both ways, with one key over many ranges and null keys."""
    from palisade.operators.ordering import Fold, prefix_scan

    rng = random.Random(seed)
    rows = [(rng.choice(["k"] * 9 + ["other", None]), t, rng.choice([None, 1, 5, 9, t])) for t in range(600)]
    df = spark.createDataFrame(rows, "key string, t long, v long").repartition(7)
    got = prefix_scan(df, ["key"], ["t"], {
        "n": Fold("sum", F.lit(1)), "before": Fold("sum", F.col("v"), own=False), "most": Fold("max", F.col("v"), own=False),
        "most_down": Fold("max", F.col("v"), down=True), "last": Fold("last", F.col("v"), own=False),
        "next": Fold("last", F.col("v"), down=True, own=False)}).collect()
    assert len(got) == len(rows)
    for key in ("k", "other", None):
        own = sorted((t, v) for k, t, v in rows if k == key)
        values = [v for _, v in own]
        for r in (r for r in got if r.key == key):
            i = next(i for i, (t, _) in enumerate(own) if t == r.t)
            known = lambda x: [v for v in x if v is not None]
            assert r.n == i + 1 and r.before == sum(known(values[:i]))
            assert r.most == max(known(values[:i]), default=None) and r.most_down == max(known(values[i:]), default=None)
            assert r.last == (known(values[:i]) or [None])[-1] and r.next == (known(values[i + 1:]) or [None])[0]


def test_auth_001_one_key(spark):
    """Many failures and successes of one user and origin: a window is a range of failure numbers."""
    rows = [dict(auth(k, T0 + 400 * k * SECOND, "failed"), event_id=f"f{k:05d}") for k in range(3000)]
    rows += [dict(auth(k, T0 + (400 * k + 200) * SECOND, "success"), event_id=f"s{k:05d}") for k in range(0, 3000, 3)]
    out = endpoint.auth_001(make_events(spark, rows), DetectConfig(brute_min_fails=2)).collect()
    # the failure 200 s before and, at the window's very edge, the one before that
    assert len(out) == 999 and all(len(r.evidence_event_ids) == 3 and r.metadata.fail_count == 2 for r in out)


def test_case_transitions_in_runs(spark):
    """Runs of any size give the same states as one fold."""
    rng = random.Random(5)
    asked = [("i1", k, rng.choice(["INVESTIGATING", "CONTAINED", "RESOLVED" if k > 280 else "CONTAINED", "odd", None])) for k in range(300)]
    asked += [("i2", 1, "RESOLVED"), ("i2", 2, "INVESTIGATING"), ("i2", 3, "RESOLVED"), ("i2", 4, "CONTAINED")]
    df = spark.createDataFrame(asked, "incident_id string, seq long, status string").repartition(5)
    one, many = (sorted(map(tuple, cases.case_transitions(df, chunk=c).collect())) for c in (1000, 7))
    assert one == many and len(one) == len(asked)
    now = {"i1": "NEW", "i2": "NEW"}
    for i, seq, status in sorted(asked, key=lambda r: r[:2]):
        good = status in cases.TRANSITIONS.get(now[i], ())
        row = next(r for r in one if r[:2] == (i, seq))
        assert row[3] == now[i] and row[4] == good
        now[i] = status if good else now[i]


def test_failed_rules_are_told(spark):
    """A broken rule is named and the others run; what is not the rule's fault rises."""
    from palisade.operators.detect import run_rules

    rows = make_events(spark, [auth(i, T0, "failed") for i in range(3)] + [auth(90, T0 + SECOND, "success")])

    def raising(e):
        return e.withColumn("x", F.raise_error(F.lit("gone"))).checkpoint()

    rules = {"AUTH-001": lambda e: endpoint.auth_001(e), "X-1": lambda e: e.select("no_such_column"), "X-2": lambda e: 1 / 0, "X-3": raising}
    out = run_rules(rows, rules)
    assert out.detections.count() == 1
    assert {r.rule_id: r.error.split(":")[0] for r in out.failed.collect()} == {
        "X-1": "AnalysisException", "X-2": "ZeroDivisionError", "X-3": "SparkRuntimeException"}

    def lost(_):
        raise OSError("no space left")

    with pytest.raises(OSError):
        run_rules(rows, {"X-4": lost})
