"""Projection of the supplied benchmark tables into security telemetry.

`telemetry` reads `events` (30 days squeezed into 12 hours so that windows of
minutes hold several rows); `flows` reads `lineitem`. Both are pure row-wise
projections, so their work grows with the tables. The same rules are written in
SQL in palisade.plans.oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.core import from_micros, micros

DAY0_US = 1_788_393_600_000_000  # 2026-09-03 00:00:00 UTC
EVENTS_START_US = 1_704_067_200_000_000  # 2024-01-01
SHIP_START = "1992-01-01"
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

# A representative flow configuration for the density of the projected flows.
FLOW_SCALE = dict(
    rate_min_count=12, rate_baseline_factor=1.5, brute_min_flows=6, scan_min_ports=8,
    scan_entropy_bits=4.0, byte_ratio=0.8, byte_min_flows=5, novelty_min_peak=8,
    burst_min_flows=8, burst_min_pps=20.0,
)
DNS_SCALE = dict(dns_threshold=4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(*branches, default=None):
    out = F.lit(default) if not isinstance(default, F.Column) else default
    for cond, value in reversed(branches):
        out = F.when(cond, value).otherwise(out)
    return out


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_of(table(spark, sf_dir, "events"))


def telemetry_of(source: DataFrame) -> DataFrame:
    return of_signals(signals(source))


def signals(source: DataFrame) -> DataFrame:
    """The numbers and the kind that an event is made of: narrow beside the event itself, which is mostly text."""
    return source.select(
        F.col("event_id").alias("number"),
        (F.lit(DAY0_US) + F.floor((micros("ts") - EVENTS_START_US) / 60)).alias("us"),
        F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.floor(F.col("user_id") / 8).cast("int").alias("u"),
        "value",
    )


def of_signals(rows: DataFrame) -> DataFrame:
    k = F.col("k")
    kind = F.col("kind")
    auth, proc = kind.isin("error", "signup"), kind == "view"
    dns, move = kind == "click", kind == "purchase"
    u = F.col("u")
    text = lambda c: c.cast("string")
    return rows.select(
        F.concat(F.lit("evt-"), F.lpad(F.col("number").cast("string"), 8, "0")).alias("event_id"),
        from_micros("us").alias("timestamp"),
        _case((auth, "authentication"), (dns, "dns_query"), (proc, "process_creation"),
              default="data_transfer").alias("event_type"),
        _case((auth, "windows"), (dns, "dns"), (proc, "endpoint"),
              default="firewall").alias("source"),
        F.concat(F.lit("WIN-"), text(u % 5)).alias("host"),
        F.concat(F.lit("user_"), text(u)).alias("user"),
        F.when(k % 20 == 0, F.concat(F.lit("192.168.50."), text(k)))
        .otherwise(F.concat(F.lit("10.10."), text(F.floor(u / 250)), F.lit("."), text(u % 250)))
        .alias("source_ip"),
        F.when(move, _case(
            (k == 11, "203.0.113.200"), (k == 12, "192.0.2.99"), (k == 13, "198.51.100.23"),
            default=F.concat(F.lit("198.18."), text(k), F.lit("."), text(u % 250))))
        .alias("destination_ip"),
        F.when(move, F.lit(443)).cast("int").alias("destination_port"),
        F.when(move, F.lit("TCP")).alias("protocol"),
        F.when(proc, _case(
            (k < 4, "C:\\Windows\\System32\\WindowsPowerShell\\powershell.exe"),
            (k < 6, "C:\\Windows\\POWERSHELL.EXE"), (k == 6, "C:\\Windows\\cmd.exe"),
            (k == 7, "/usr/bin/python"), default="C:\\Program Files\\App\\app.exe"))
        .alias("process_name"),
        F.when(proc, _case(
            (k < 4, "C:\\Windows\\System32\\services.exe"),
            (k < 6, "C:\\Office\\winword.exe"), default="C:\\Windows\\explorer.exe"))
        .alias("parent_process"),
        F.when(proc, _case(
            (k < 4, "powershell.exe -NoProfile"), (k < 6, "powershell -EncodedCommand QQBB"),
            (k == 7, "python -c FromBase64String"), (k == 8, "app.exe --password=hunter2"),
            default="app.exe --run")).alias("command_line"),
        F.when(proc & (k == 20), F.lit(EMPTY_SHA256))
        .when(proc & (k % 10 == 5), F.md5(F.concat(F.lit("bin"), text(k)))).alias("file_hash"),
        F.when(dns, _case(
            (k == 7, "Update-Check.INVALID"), (k == 9, "malware-test.invalid"),
            (k % 10 == 3, "example.com"),
            default=F.concat(F.lit("svc"), text(k % 7), F.lit(".corp.example"))))
        .alias("domain"),
        F.when(move & (k % 25 == 4), F.lit("http://malware-test.invalid/payload"))
        .when(move & (k % 25 == 8), F.lit("https://Files.Example.com:8443/a?b=1")).alias("url"),
        F.when(move, F.floor(F.col("value") * 1e7)).cast("bigint").alias("bytes_sent"),
        F.lit(None).cast("bigint").alias("bytes_received"),
        _case((kind == "error", "failed"), (kind == "signup", "success"),
              (proc, "started"), default="allowed").alias("status"),
        F.concat(
            F.lit('{"generator":"bridge","scenario_id":"s-'), text(k),
            F.lit('","scenario_type":"'),
            _case((k < 8, "intrusion"), (k % 20 == 0, "roaming"), default="normal"),
            F.lit('","evaluation_only":{"label":"'),
            _case((k < 8, "Intrusion"), (k % 20 == 0, "Roaming"), default="BENIGN "),
            F.lit('","evaluation":true}}'),
        ).alias("raw_event"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow events with their numerics as columns and the label kept aside.

    Repeated source rows are equal in every column and are kept once.
    """
    return of_lines(lines(table(spark, sf_dir, "lineitem")).distinct())


def flows_of(source: DataFrame) -> DataFrame:
    return of_lines(lines(source))


def lines(source: DataFrame) -> DataFrame:
    """The whole numbers and flags that a flow is made of; they name it, so equal ones make equal flows.

    Narrow beside the flow itself, whose ids and addresses are text: repeated rows are dropped and
    flows are kept in this form.
    """
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    return source.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus",
        cents("l_quantity").alias("qty"), cents("l_extendedprice").alias("price"),
        cents("l_discount").alias("disc"), cents("l_tax").alias("tax"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit(SHIP_START).cast("date"))
        .cast("bigint").alias("day"),
    )


def of_lines(i: DataFrame) -> DataFrame:
    sup, part, order, line = (F.col(c) for c in
                              ("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"))
    text = lambda c: c.cast("string")
    late = (F.col("day") > 2200) & (part % 20 == 0)
    qty = (F.col("qty") / 100).cast("bigint")
    keyed = [text(F.col(c)) for c in
             ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "qty", "price", "disc",
              "tax", "l_returnflag", "l_linestatus", "day")]
    return i.select(
        F.concat(F.lit("flow-"), F.md5(F.concat_ws("|", *keyed))).alias("event_id"),
        (F.lit(DAY0_US) + F.col("day") * 1_000_000
         + (part * 7919 + line * 104_729 + order * 31) % 1_000_000).alias("ts_us"),
        F.when(line % 2 == 0, F.concat(F.lit("172.16."), text(F.floor(sup / 250)), F.lit("."),
                                       text(sup % 250)))
        .when(order % 16 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("172.20."), text(F.floor(order / 64 / 250)), F.lit("."),
                            text(F.floor(order / 64) % 250))).alias("source_ip"),
        F.when(order % 50 == 7, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("10.0."), text(F.floor(sup / 250)), F.lit("."),
                            text(sup % 250))).alias("destination_ip"),
        F.when(late, 50_000 + F.floor(F.col("day") / 100))
        .when(line % 2 == 0, part % 97 + 1)
        .otherwise(F.get(F.array(*[F.lit(p) for p in (22, 80, 443, 3389, 8080)]),
                         (qty % 5).cast("int"))).cast("int").alias("destination_port"),
        F.when(F.col("l_returnflag") == "R", "UDP").otherwise("TCP").alias("protocol"),
        F.when(line == 7, qty * 1000).otherwise(qty * 100).alias("bytes_sent"),
        (F.col("tax") * 100).alias("bytes_received"),
        F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("syn"),
        F.when(F.col("disc") > 5, 2.0).otherwise(0.0).alias("ack"),
        qty.cast("double").alias("fwd_pkts"), (qty * 2).cast("double").alias("bwd_pkts"),
        F.col("price").cast("double").alias("byte_rate"),
        (qty * 10).cast("double").alias("packet_rate"),
        F.when(part % 13 == 0, "DoS").when(part % 17 == 0, " BENIGN ")
        .when(part % 29 == 0, "PortScan").when(part % 31 == 0, "").otherwise("Benign")
        .alias("label"),
    )
