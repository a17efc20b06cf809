"""Column layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per telemetry record. Times are naive UTC.
EVENT_COLUMNS = (
    ("event_id", "string"), ("timestamp", "timestamp_ntz"), ("event_type", "string"),
    ("source", "string"), ("host", "string"), ("user", "string"),
    ("source_ip", "string"), ("destination_ip", "string"), ("destination_port", "int"),
    ("protocol", "string"), ("process_name", "string"), ("parent_process", "string"),
    ("command_line", "string"), ("file_hash", "string"), ("domain", "string"),
    ("url", "string"), ("bytes_sent", "bigint"), ("bytes_received", "bigint"),
    ("status", "string"), ("raw_event", "string"),
)
EVENT_DDL = ", ".join(f"`{n}` {t}" for n, t in EVENT_COLUMNS)

# Raw submission before validation: everything textual except the counters.
SUBMISSION_DDL = ", ".join(
    f"`{n}` {'string' if t in ('timestamp_ntz', 'int') else t}" for n, t in EVENT_COLUMNS
)

# Flow meter columns a flow rule may read, and the column each one becomes.
FLOW_NUMERICS = (
    ("Flow Duration", "flow_duration"), ("Tot Fwd Pkts", "fwd_pkts"),
    ("Tot Bwd Pkts", "bwd_pkts"), ("TotLen Fwd Pkts", "fwd_bytes"),
    ("TotLen Bwd Pkts", "bwd_bytes"), ("Flow Byts/s", "byte_rate"),
    ("Flow Pkts/s", "packet_rate"), ("Fwd Pkt Len Mean", "fwd_len_mean"),
    ("Bwd Pkt Len Mean", "bwd_len_mean"), ("Fwd Seg Size Avg", "fwd_seg_avg"),
    ("Bwd Seg Size Avg", "bwd_seg_avg"), ("SYN Flag Cnt", "syn"),
    ("ACK Flag Cnt", "ack"), ("RST Flag Cnt", "rst"),
    ("Fwd Header Len", "fwd_header"), ("Bwd Header Len", "bwd_header"),
    ("Init Fwd Win Byts", "init_fwd_win"), ("Init Bwd Win Byts", "init_bwd_win"),
)
FLOW_FIELDS = (
    "event_id", "ts_us", "source_ip", "destination_ip", "destination_port",
    "protocol", "bytes_sent", "bytes_received",
)

# Rule-specific facts, one nullable field each.
METADATA = (
    ("user", "string"), ("host", "string"), ("anchor", "string"), ("fail_count", "bigint"),
    ("same_ip", "boolean"), ("observed_hour", "int"), ("new_ip", "string"),
    ("history_events", "bigint"), ("pattern_id", "string"), ("process", "string"),
    ("parent", "string"), ("child", "string"),
    ("matched_ioc", "struct<indicator:string,type:string,confidence:double,description:string,source:string>"),
    ("bytes_sent", "bigint"), ("threshold", "double"), ("count", "bigint"), ("key", "string"),
    ("baseline_median", "double"), ("qualifying_count", "bigint"), ("window_count", "bigint"),
    ("source_ip", "string"), ("distinct_ports", "bigint"), ("entropy_bits", "double"),
    ("flow_count", "bigint"), ("mode", "string"), ("median_byts", "double"), ("ratio", "double"),
    ("protocol", "string"), ("destination_port", "int"), ("peak_minute_count", "bigint"),
    ("ephemeral_port", "boolean"), ("packets_per_s", "double"),
)
METADATA_DDL = "struct<" + ",".join(f"{n}:{t}" for n, t in METADATA) + ">"

DETECTION_COLUMNS = (
    "detection_id", "fingerprint", "rule_id", "rule_name", "severity", "confidence",
    "reason", "evidence_event_ids", "first_seen", "last_seen", "metadata",
)
DETECTION_DDL = (
    "detection_id string, fingerprint string, rule_id string, rule_name string, "
    "severity string, confidence double, reason string, evidence_event_ids array<string>, "
    f"first_seen timestamp_ntz, last_seen timestamp_ntz, metadata {METADATA_DDL}"
)


def ddl(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)
