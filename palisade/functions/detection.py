"""Assembly of the detection record every rule emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.core import clip01, from_micros, uuid5
from palisade.schema import DETECTION_COLUMNS, METADATA

# Identity namespaces.
DETECTION_NAMESPACE = "7d3f9a1b4c2e5f8ab6d41e9c3a5f7b22"
INCIDENT_NAMESPACE = "3f6b2c8d9a1e5d4b8c7f2e5a9d3c6b11"

# Rule id -> (name, severity).
RULES = {
    "AUTH-001": ("Brute Force Followed By Successful Login", "HIGH"),
    "AUTH-002": ("Unusual Login Time", "MEDIUM"),
    "AUTH-003": ("New Source IP For User", "MEDIUM"),
    "PROC-001": ("Suspicious Process Execution", "HIGH"),
    "PROC-002": ("Suspicious Parent-Child Process Relationship", "HIGH"),
    "NET-001": ("Suspicious External Destination", "HIGH"),
    "NET-002": ("Mass DNS Activity", "MEDIUM"),
    "DATA-001": ("Abnormal Outbound Data Transfer", "HIGH"),
    "FLOW-001": ("High Connection Rate", "MEDIUM"),
    "FLOW-002": ("Repeated Connection Attempts", "HIGH"),
    "FLOW-003": ("Port-Scan-like Behavior", "MEDIUM"),
    "FLOW-004": ("Flow Byte-Rate Anomaly", "MEDIUM"),
    "FLOW-005": ("Protocol/Port Anomaly", "LOW"),
    "FLOW-006": ("DoS-like High-Volume Burst", "HIGH"),
}


def metadata_struct(values: dict[str, Column]) -> Column:
    unknown = set(values) - {n for n, _ in METADATA}
    if unknown:
        raise KeyError(f"not a metadata field: {sorted(unknown)}")
    return F.struct(
        *[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in METADATA]
    )


def fingerprint(rule_id, evidence: Column) -> Column:
    rule = F.lit(rule_id) if isinstance(rule_id, str) else rule_id
    return F.concat(rule, F.lit(":"), F.array_join(evidence, ","))


def detections(
    fired: DataFrame,
    rule_id: str,
    confidence: Column,
    reason: Column,
    meta: dict[str, Column],
    *,
    evidence: Column,
    first_us: Column,
    last_us: Column,
    rule_name: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One detection per row of `fired`. `keep` carries extra columns along."""
    name, severity = RULES[rule_id]
    rows = fired.select(
        *keep,
        F.lit(rule_id).alias("rule_id"),
        F.lit(rule_name or name).alias("rule_name"),
        F.lit(severity).alias("severity"),
        F.round(clip01(confidence.cast("double")), 3).alias("confidence"),
        reason.alias("reason"),
        F.array_sort(evidence).alias("evidence_event_ids"),
        from_micros(first_us).alias("first_seen"),
        from_micros(last_us).alias("last_seen"),
        metadata_struct(meta).alias("metadata"),
    )
    rows = rows.withColumn("fingerprint", fingerprint(rule_id, F.col("evidence_event_ids")))
    rows = rows.withColumn("detection_id", uuid5(DETECTION_NAMESPACE, F.col("fingerprint")))
    return rows.select(*keep, *DETECTION_COLUMNS)
