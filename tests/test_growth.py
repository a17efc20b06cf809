"""Results that may not depend on how many rows there are, and work that may not outgrow its use."""

import duckdb
from pyspark.sql import functions as F

from palisade.config import FlowConfig
from palisade.functions.core import two_decimals
from palisade.operators import flow, investigate, risk
from palisade.plans import pipeline
from palisade.sources import bridge, catalogs


def test_repeated_lines_are_dropped_before_they_are_flows(spark, sf, tmp_path):
    duckdb.sql(f"COPY (SELECT * FROM '{sf}/lineitem.parquet' UNION ALL SELECT * FROM '{sf}/lineitem.parquet' WHERE l_orderkey % 3 = 0) "
               f"TO '{tmp_path}/lineitem.parquet'")
    once, again = bridge.flows(spark, sf), bridge.flows(spark, str(tmp_path))
    shuffled = [x for x in again._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]
    assert shuffled and all("l_orderkey" in x and "event_id" not in x for x in shuffled)  # numbers travel, not text
    assert once.count() == again.count() and once.exceptAll(again).isEmpty()


def test_confidence_points_of_ties_do_not_depend_on_sums_of_fractions(spark):
    incidents = spark.sql("SELECT 'i' AS incident_id, 'LOW' AS severity, array('e') AS evidence_event_ids, "
                          "named_struct('sequence_hits', CAST(array() AS array<string>)) AS metadata")
    for values, points in (((0.95,) * 3, 10), ((0.55,) * 6, 6)):  # 9.5 and 5.5 go to the even number
        members = spark.createDataFrame([("i", "AUTH-002", v) for v in values], "incident_id string, rule_id string, confidence double").withColumn(
            "metadata", F.expr("named_struct('bytes_sent', CAST(NULL AS bigint), 'threshold', CAST(NULL AS double), 'matched_ioc', CAST(NULL AS string))"))
        mappings = spark.createDataFrame([], "incident_id string, tactic string, technique_id string")
        got = risk.score_risk(incidents, members.coalesce(1), mappings).first()
        assert got.risk_breakdown.confidence_points == points


def test_two_decimals_of_scores_with_four(spark):
    values = [k / 10000 for k in range(10001)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", two_decimals(F.col("v"), 4).alias("t")).collect()
    assert all(r.t == f"{r.v:.2f}" for r in rows)


def test_detections_are_found_without_members_or_incidents(spark, sf, monkeypatch):
    def linked(*_):
        raise AssertionError("linked")
    monkeypatch.setattr(pipeline, "correlate", linked)
    monkeypatch.setattr(pipeline, "enrich", linked)
    out = pipeline.flow_incidents(bridge.flows(spark, sf), catalogs.techniques(spark), rules=("FLOW-005",))
    assert out.detections.count() >= 0 and "members" not in vars(out) and "incidents" not in vars(out)


def test_flows_stay_where_they_are_when_targets_are_few(spark, sf):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "20000")  # far below the table, far above its targets
    try:
        plan = flow.anchored_buckets(bridge.flows(spark, sf), 60)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_members_of_buckets_are_not_dealt_once_more(spark, sf):
    from palisade.operators.detect import flow_rules, run_rules
    rules = {k: r for k, r in flow_rules().items() if k == "FLOW-005"}
    plan = run_rules(bridge.flows(spark, sf), rules).members._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(detection_id" not in plan


def test_flow_detections_are_described_without_a_join_or_a_copy(spark, monkeypatch):
    from palisade.operators import correlate

    def copied(_):
        raise AssertionError("copied")
    monkeypatch.setattr(correlate, "checkpointed", copied)
    dets = spark.createDataFrame([("d", "FLOW-001")], "detection_id string, rule_id string").selectExpr(
        "*", "array('e') AS evidence_event_ids", "TIMESTAMP_NTZ'2026-09-03 00:00:00' AS first_seen",
        "TIMESTAMP_NTZ'2026-09-03 00:00:00' AS last_seen",
        "named_struct('user', CAST(NULL AS string), 'host', CAST(NULL AS string), 'anchor', CAST(NULL AS string), 'key', '10.0.0.1', 'source_ip', "
        "CAST(NULL AS string), 'mode', CAST(NULL AS string), 'protocol', CAST(NULL AS string), 'destination_port', CAST(NULL AS int)) AS metadata")
    described = correlate.describe(dets)
    assert "Join" not in described._jdf.queryExecution().executedPlan().toString()
    got = described.first()
    assert (got.user, got.host, got.net.a) == (None, None, "10.0.0.1")


def test_window_counts_with_slots_that_hold_no_short_flow(spark):
    """Long flows just before a slot full of short ones belong to the window, those of a quiet service to none."""
    from palisade.config import FlowConfig
    minute = 60_000_000
    at = lambda n, us, port, short: (f"e{n:03d}", us, "10.0.0.1", port, 10, 0, 1.0 if short else 0.0, 0.0)
    rows = [at(n, 4 * minute + n, 22, False) for n in range(3)] + [at(10 + n, 6 * minute + n, 22, True) for n in range(6)]
    rows += [at(100 + n, n * 20 * minute, 80, True) for n in range(9)]
    flows = spark.createDataFrame(rows, "event_id string, ts_us bigint, destination_ip string, destination_port int, "
                                        "bytes_sent bigint, bytes_received bigint, syn double, ack double")
    got = flow.flow_002(flows, FlowConfig(brute_min_flows=6)).detections.collect()
    assert [(len(d.evidence_event_ids), d.metadata.window_count) for d in got] == [(6, 9)]
    keyed = flows.selectExpr("event_id", "ts_us", "CAST(destination_port AS string) AS key", "syn > ack AS short")
    assert {r.key for r in flow._live_slots(keyed, 5 * minute, 6).collect()} == {"22"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _incident(spark):
    incidents = spark.sql("SELECT 'i' AS incident_id, array('d') AS detection_ids, array('e1', 'e2', 'e3') AS evidence_event_ids, "
                          "named_struct('rule_ids', array('AUTH-002', 'NET-002')) AS metadata, CAST(array() AS "
                          "array<struct<technique_id: string, source_rule_id: string>>) AS mitre_techniques")
    dets = spark.sql("SELECT 'd' AS detection_id, 'AUTH-002' AS rule_id, 'x' AS rule_name, 'LOW' AS severity, 0.5D AS confidence, "
                     "TIMESTAMP_NTZ'2026-09-03 00:00:00' AS first_seen, TIMESTAMP_NTZ'2026-09-03 00:00:00' AS last_seen, "
                     "array('e1', 'e2') AS evidence_event_ids")
    return incidents, dets


def test_timeline_writes_the_size_of_evidence_in_its_place(spark):
    lines = investigate.timeline(*_incident(spark), spark.createDataFrame([], "detection_id string, event_id string"))
    assert lines.first().evidence_count == 2 and "evidence_event_ids" not in _plan(lines)


def test_shared_notes_are_listed_once_for_all_their_incidents(spark):
    lines = spark.createDataFrame([("a1", 1, "d1"), ("a2", 2, "d3"), ("a2", 1, "d2"), ("b1", 1, "d4")], "incident_id string, position int, detection_id string")
    notes = spark.createDataFrame([("a", "n2", "2", "long text"), ("a", "n1", "1", "text")], "key string, note_id string, created_at string, body string")
    out = investigate.context_bound(lines, notes, note_key=F.substring("incident_id", 1, 1))
    got = {r.incident_id: (r.timeline_total, r.timeline, [n.note_id for n in r.notes or ()], r.note_count) for r in out.collect()}
    assert got == {"a1": (1, ["d1"], ["n1", "n2"], 2), "a2": (2, ["d2", "d3"], ["n1", "n2"], 2), "b1": (1, ["d4"], [], 0)}


def test_stages_of_a_story_are_told_after_the_events_are_met(spark):
    events = spark.sql("SELECT * FROM VALUES ('e1', TIMESTAMP_NTZ'2026-09-03 00:00:02', 'authentication'), ('e2', "
                       "TIMESTAMP_NTZ'2026-09-03 00:00:01', 'dns_query'), ('e3', TIMESTAMP_NTZ'2026-09-03 00:00:03', 'process_creation') "
                       "AS t(event_id, timestamp, event_type)")
    story = investigate.attack_story(_incident(spark)[0], events)
    assert {(r.ord, r.stage, r.events) for r in story.collect()} == {
        (0, "Authentication anomalies", 1), (2, "Suspicious network activity", 1)}
    joins = _plan(story).split("Join", 1)[1]
    assert "Authentication anomalies" not in joins


def test_chunks_carry_where_recent_rows_landed_and_no_copy_of_them(spark, tmp_path):
    from palisade.schema import DETECTION_DDL, ddl
    from palisade.streaming import jobs
    seen = []

    def rule(rows):
        seen.append(sorted(r.event_id for r in rows.collect()))
        return spark.createDataFrame([], ddl(DETECTION_DDL))
    step = jobs.chunk_step({"X-1": rule}, str(tmp_path), 50)
    for n, batch in enumerate(([("e1", 0), ("e2", 100)], [("e2", 100), ("e3", 120), ("e3", 120)], [("e4", 160)], [("e5", 400)])):
        step(spark.createDataFrame(batch, "event_id string, ts_us bigint").withColumn("event_time", F.lit(None)), n)
    assert seen == [["e1", "e2"], ["e2", "e3"], ["e3", "e4"], ["e5"]]
    carried = [tuple(r) for r in spark.read.schema("batch bigint, newest bigint, cut bigint").json(f"{tmp_path}/carry/2").orderBy("batch").collect()]
    assert carried == [(1, 120, 110), (2, 160, 110)]


def test_submissions_are_checked_once(spark):
    from palisade.sources import ingest
    told = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def marked(text):
        told.add(1)
        return text
    rows = [(n, None if n % 5 == 0 else f" e{n // 2} ") for n in range(40)]
    submitted = spark.createDataFrame(rows, "arrival int, event_id string").selectExpr(
        "*", "'2026-09-03T00:00:00Z' AS timestamp", "'authentication' AS event_type", "'windows' AS source", "CAST(NULL AS string) AS host",
        "CAST(NULL AS string) AS user", "'10.0.0.1' AS source_ip", "CAST(NULL AS string) AS destination_ip", "CAST(NULL AS string) AS destination_port",
        "CAST(NULL AS string) AS protocol", "CAST(NULL AS string) AS process_name", "CAST(NULL AS string) AS parent_process",
        "CAST(NULL AS string) AS command_line", "CAST(NULL AS string) AS file_hash", "CAST(NULL AS string) AS domain", "CAST(NULL AS string) AS url",
        "CAST(NULL AS bigint) AS bytes_sent", "CAST(NULL AS bigint) AS bytes_received", "'{}' AS raw_event").withColumn("status", marked(F.lit("started")))
    got = {(r.status, r.event_id): r.n for r in ingest.batch_report(submitted).groupBy("status", "event_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert told.value == 40
    assert got[("rejected", None)] == 8 and got[("created", "e1")] == got[("duplicate", "e1")] == 1 and sum(got.values()) == 40


def test_events_are_kept_as_numbers_and_dealt_before_rules_work_on_them(spark, sf):
    from palisade.plans import queries
    stored, plain = queries.telemetry(spark, sf), bridge.telemetry(spark, sf)
    plan = _plan(stored)
    assert "InMemoryTableScan" in plan and "hashpartitioning(number" in plan
    assert stored.schema.names == plain.schema.names and stored.count() == plain.count() and stored.exceptAll(plain).isEmpty()


def test_observables_of_a_trace_are_normalised_once(spark, sf):
    from palisade.operators import intel
    events = bridge.telemetry(spark, sf)
    ids = [r.event_id for r in events.where("destination_ip IS NOT NULL").orderBy("event_id").limit(3).collect()]
    incidents = spark.createDataFrame([("i", ["d1", "d2"], ids)], "incident_id string, detection_ids array<string>, evidence_event_ids array<string>")
    dets = spark.createDataFrame([("d1", ids[:2]), ("d2", ids[:1])], "detection_id string, evidence_event_ids array<string>")
    trace = intel.intel_trace(incidents, dets, events, catalogs.intel(spark))
    assert _plan(trace).count("ArrowEvalPython") == _plan(intel.observed(events)).count("ArrowEvalPython") > 0
    seen = {(r.normalized_value, r.source): set() for r in trace.collect()}
    for r in intel.observed(events.where(F.col("event_id").isin(ids))).collect():
        seen[r.normalized_value, r.source].add(r.event_id)
    by = {ids[0]: {"d1", "d2"}, ids[1]: {"d1"}, ids[2]: set()}
    for r in trace.collect():
        own = seen[r.normalized_value, r.source]
        assert r.event_count == len(own) and (r.detection_ids or []) == sorted(set().union(*[by[e] for e in own]))


def _kept(spark):
    """Pinned tables and files in the checkpoint folder that the session holds now."""
    import os

    from palisade.functions.state import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    return len(spark.sparkContext._jsc.getPersistentRDDs()), {x for x in os.listdir(folder) if x.startswith(("rdd-", "table-"))}


def test_finished_steps_keep_their_results_only(spark):
    from palisade.functions.state import checkpointed, finished, pin
    pins, files = _kept(spark)

    def inner():
        rows = pin(spark.range(10))
        rows.count()
        return (checkpointed(rows.where("id > 2")),)

    def outer():
        return (finished(inner)[0].where("id > 3"), pin(spark.range(3)))
    more, few = finished(outer)
    assert sorted(r.id for r in more.collect()) == list(range(4, 10)) and few.count() == 3
    after, held = _kept(spark)
    assert after <= pins and len(held - files) == 2


def test_flow_rules_let_go_of_their_work_before_the_next(spark, sf):
    pins, files = _kept(spark)
    rules = ("FLOW-001", "FLOW-002", "FLOW-006")
    out = pipeline.flow_incidents(bridge.flows(spark, sf), catalogs.techniques(spark), rules=rules)
    told = out.detections.count()
    after, held = _kept(spark)
    assert after <= pins and len(held - files) == len(rules)  # one table of detections each
    cited = out.members.select("detection_id").distinct()
    assert cited.join(out.detections, "detection_id").count() == cited.count() <= told
    out.incidents.count()
    after, held = _kept(spark)
    assert after <= pins and len(held - files) <= 3 * len(rules) + 1  # detections, those with members, incidents


def test_rules_that_speak_under_one_name_do_not_repeat_each_other(spark):
    from palisade.operators import detect
    flows = spark.createDataFrame([(f"e{n}", n, "TCP", p) for n, p in enumerate([22] * 5 + [80] * 5)],
                                  "event_id string, ts_us bigint, protocol string, destination_port int")
    rule = detect.flow_rules(FlowConfig(novelty_min_peak=3, novelty_min_flows=3))["FLOW-005"]

    def broken(_):
        raise KeyError("column")
    out = detect.store_rules(flows, {"A": rule, "B": rule, "C": broken})
    assert out.detections.count() == 1 and out.members.distinct().count() == 5
    assert [r.rule_id for r in out.failed.collect()] == ["C"]


def test_incidents_are_judged_by_attack_labels_and_composed_without_any(spark):
    from palisade.operators import evaluate
    incidents = spark.sql("SELECT * FROM VALUES ('i', array('d1', 'd2')), ('j', array('d3')), ('k', array('gone')) AS t(incident_id, detection_ids)").selectExpr(
        "*", "array('e1') AS evidence_event_ids", "named_struct('network_entities', array('n')) AS metadata")
    dets = spark.sql("SELECT * FROM VALUES ('d1', 'FLOW-006', array('e3')), ('d2', 'FLOW-001', array('e3')), ('d3', 'FLOW-005', array('e3', 'e4')) "
                     "AS t(detection_id, rule_id, evidence_event_ids)")
    members = spark.createDataFrame([("d1", "e1"), ("d1", "e2"), ("d2", "e2")], "detection_id string, event_id string")
    labels = spark.createDataFrame([("e1", "DoS"), ("e2", "Benign"), ("e3", "PortScan"), ("e4", "")], "event_id string, label string")
    hits = {r.incident_id: (r.hit_labels, r.has_bucket) for r in evaluate.incident_hits(incidents, dets, members, labels).collect()}
    assert hits == {"i": (["DoS"], 1), "j": (["PortScan"], None), "k": ([], None)}
    composed = evaluate.rule_composition(incidents, dets)
    assert {r.composition: r.incidents for r in composed.collect()} == {"FLOW-001+FLOW-006": 1, "FLOW-005": 1, "<unknown>": 1}


def test_port_scans_are_replayed_from_groups_that_end_in_any_batch():
    import pandas as pd

    from palisade.operators import portscan
    keys = [("a", 0, 0)] * 3 + [("a", 1, 0)] + [("b", 1, 0)] * 4 + [("b", 1, 1)] * 2
    rows = pd.DataFrame(keys, columns=portscan.KEYS).assign(ts_us=range(len(keys)))
    want = [list(g["ts_us"]) for _, g in rows.groupby(portscan.KEYS)]
    for size in (1, 2, 3, 4, 10):
        batches = [rows[at:at + size].reset_index(drop=True) for at in range(0, len(rows), size)]
        batches.insert(1, rows[:0])
        assert [g["ts_us"].tolist() for ended in portscan._groups(batches, [*portscan.KEYS, "ts_us"]) for g in ended] == want
    assert list(portscan._groups([], portscan.KEYS)) == [[]]
