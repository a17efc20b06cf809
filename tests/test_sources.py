"""Files in and out, adapters on text, IPv6 / IDNA, upserts, digests, behaviour model."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from palisade.config import HOUR, UebaConfig
from palisade.operators import intel, ueba
from palisade.sources import catalogs, flowcsv, ingest

HEAD = " Timestamp,Dst Port ,Protocol,Src IP,Dst IP,TotLen Fwd Pkts,SYN Flag Cnt,Flow Byts/s,Label"


def test_csv_rows_are_numbered_per_file_across_blocks(spark, tmp_path):
    for name, n in (("a.csv", 3000), ("b.csv", 700)):
        lines = [HEAD] + [f"01/03/2018 10:00:00,{i % 70000},6,10.0.0.1,10.0.0.2,{i},1,5.5,Benign" for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = flowcsv.read_flow_csv(spark, str(tmp_path / "*.csv"))
        got = rows.select("source_file", "source_row", F.col("TotLen Fwd Pkts").cast("long").alias("v")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3700 and all(r.source_row == r.v + 1 for r in got)


def test_adapter_2018(spark, tmp_path):
    (tmp_path / "d.csv").write_text("\n".join([
        HEAD, '01/03/2018 10:00:05,443,6,10.0.0.1,2001:DB8::1,"1,024",1,Infinity, BENIGN ',
        "bad,443,6,,,1,1,1,DoS", "01/03/2018 10:00:05,70000,17,,,1,1,1,DoS", "01/03/2018 10:00:05,,50,x,,-4,1,1,"]) + "\n")
    out = flowcsv.adapt_flow_2018(flowcsv.read_flow_csv(spark, str(tmp_path / "d.csv"))).orderBy("source_row").collect()
    assert [r.reject_code for r in out] == [None, "bad_timestamp", "bad_port", None]
    want = uuid.uuid5(uuid.UUID(flowcsv.NAMESPACE_2018), "cse_cic_ids2018|cse-cic-ids2018-v1|d.csv|1")
    assert out[0].event_id == str(want) and out[0].destination_ip == "2001:db8::1"
    assert out[0].label == "Benign" and out[0].byte_rate is None and out[0].protocol == "TCP"
    assert out[3].destination_port is None and out[3].source_ip is None and out[3].bytes_sent is None
    assert json.loads(out[0].raw_event)["flow"]["TotLen Fwd Pkts"] == "1024"


@pytest.mark.parametrize("file,stamp,hour", [
    ("x-PortScan.csv", "7/7/2017 2:53", 14), ("x-PortScan.csv", "7/7/2017 12:01", 12),
    ("Tuesday-x.csv", "4/7/2017 8:53", 8), ("Tuesday-x.csv", "4/7/2017 5:00", 17),
    ("Tuesday-x.csv", "4/7/2017 7:00", None), ("Tuesday-x.csv", "4/7/2017 13:00", None), ("other.csv", "4/7/2017 9:00", None)])
def test_session_clock(spark, file, stamp, hour):
    df = spark.createDataFrame([(file, stamp)], "f string, t string")
    got = df.select(flowcsv.time_2017(F.col("t"), flowcsv.session_of(F.col("f"))).alias("ts")).first().ts
    assert (got.hour if got else None) == hour


def test_event_files_round_trip(spark, tmp_path):
    rec = dict(event_id="e1", timestamp="2026-09-01T00:00:00Z", event_type="dns_query", source="dns",
               destination_port=53, raw_event={"a": 1})
    (tmp_path / "e.jsonl").write_text(json.dumps(rec) + "\n")
    got = flowcsv.read_jsonl(spark, str(tmp_path / "e.jsonl")).first()
    assert got.destination_port == 53 and json.loads(got.raw_event) == {"a": 1}
    (tmp_path / "e.csv").write_text('event_id,destination_port,host,raw_event\ne1,53,,"{""a"": 1}"\n')
    got = flowcsv.read_event_csv(spark, str(tmp_path / "e.csv")).first()
    assert (got.destination_port, got.host, json.loads(got.raw_event)) == (53, None, {"a": 1})


def test_catalog_files(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"indicators": [
        {"type": "ip", "indicator": "192.0.2.1", "confidence": 0.5, "description": "d", "source": "s"},
        {"type": "domain", "indicator": "x.invalid", "confidence": 0.6, "description": "d", "source": "s"}]}, indent=1))
    got = catalogs.read_iocs(spark, str(tmp_path / "i.json")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.indicator) for r in got] == [(0, "192.0.2.1"), (1, "x.invalid")]


@pytest.mark.parametrize("kind,value,want", [
    ("ip", " 10.0.0.1 ", ("ipv4", "10.0.0.1")), ("ip", "2001:DB8:0::DEAD", ("ipv6", "2001:db8::dead")),
    ("ipv6", "10.0.0.1", (None, None)), ("ip", "10.0.0.256", (None, None)), ("ip", "01.2.3.4", (None, None)),
    ("domain", "Bücher.Example.", ("domain", "xn--bcher-kva.example")), ("domain", "nodot", (None, None)),
    ("domain", "-a.example", (None, None)), ("url", "HTTPS://Ex.Example:443/A?b", ("url", "https://ex.example:443/A?b")),
    ("url", "ftp://x.example/", (None, None)), ("hash", "A" * 40, ("file_hash", "a" * 40)), ("hash", "abc", (None, None))])
def test_observables(spark, kind, value, want):
    df = spark.createDataFrame([(kind, value)], "kind string, value string")
    got = intel.normalize_observable(df).first()
    assert (got.type, got.normalized_value) == want


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "event_id string, arrival int")
    path = str(tmp_path / "store")
    ingest.append_events(rows, path)
    ingest.append_events(rows.unionByName(spark.createDataFrame([("c", 9)], rows.schema)), path)
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_jsonl_digest_ignores_row_order(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("fingerprint"), "id")
    one = ingest.write_jsonl(rows, str(tmp_path / "a")).first().sha256
    assert one == ingest.digest(ingest.jsonl(rows.repartition(7).orderBy(F.desc("id")))).first().sha256
    assert one != ingest.digest(ingest.jsonl(rows.where("id <> 4"))).first().sha256
    assert spark.read.text(str(tmp_path / "a")).count() == 500


def test_forest_ranks_outliers_first(spark):
    names = ueba.UEBA_FEATURES
    rows = [(f"u{i}", 0, *[float((i * 7 + j) % 5) for j in range(len(names))]) for i in range(300)]
    rows += [("odd", HOUR, *[50.0] * len(names))]
    obs = spark.createDataFrame(rows, "entity_key string, window_us bigint, " + ", ".join(f"{n} double" for n in names))
    obs = obs.withColumns({"window_start": F.lit("x"), "event_ids": F.array(F.lit("e"))})
    cfg = UebaConfig(trees=30)
    out = ueba.score(obs, ueba.fit(obs, cfg), cfg)
    top = out.orderBy(F.desc("anomaly_score")).first()
    assert top.entity_key == "odd" and top.anomaly_score == 1.0 and top.anomaly_flag
    low = out.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert low[0] == 0.0 and low[1] == 1.0


def test_csv_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Src IP, Dst Port ,Label\n10.0.0.1,80,Benign\n10.0.0.2,81,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Dst Port,Len,Label,Len\n90,stale,Bot,7\n")
    rows = flowcsv.read_flow_csv(spark, str(tmp_path / "*.csv")).orderBy("source_file", "source_row").collect()
    got = [(r["source_file"], r["source_row"], r["Src IP"], r["Dst Port"], r["Label"], r["Len"]) for r in rows]
    assert got == [("a.csv", 1, "10.0.0.1", "80", "Benign", ""), ("a.csv", 2, "10.0.0.2", "81", "", ""),
                   ("b.csv", 1, "", "90", "Bot", "7")]


def test_append_events_lets_storage_errors_rise(spark, tmp_path):
    rows = spark.createDataFrame([("e1", 1), ("e1", 1), ("e2", 2)], "event_id string, arrival int")
    ingest.append_events(rows, str(tmp_path / "t"))
    ingest.append_events(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    (tmp_path / "broken").write_text("no table")
    with pytest.raises(Exception):  # noqa: B017
        ingest.append_events(rows, str(tmp_path / "broken"))


def test_values_are_counted_as_read(spark):
    rows = [("network_connection", '{"evaluation_only": {"label": "BENIGN"}}', None), ("network_connection", '{"evaluation_only": {"label": ""}}', None),
            ("network_connection", '{"evaluation_only": {"label": "Bot"}}', "bad_port"), ("network_connection", "{}", None)]
    got = flowcsv.value_counts(spark.createDataFrame(rows, "event_type string, raw_event string, reject_code string")).collect()
    assert {tuple(r) for r in got} == {("event_type", "network_connection", 3), ("label", "BENIGN", 1), ("label", "<empty>", 2), ("reject_code", "bad_port", 1)}
