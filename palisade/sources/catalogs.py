"""Reference catalogs as small DataFrames.

The built-in entries use reserved documentation ranges only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Indicator list, in match order.
INDICATORS = (
    ("ip", "203.0.113.200", 0.9,
     "Synthetic external host in TEST-NET-3 (RFC 5737). Used by the generator for staged "
     "external connections. Never real infrastructure."),
    ("domain", "update-check.invalid", 0.85,
     "Synthetic domain in .invalid (RFC 2606). Used by the generator for staged lookups."),
    ("ip", "192.0.2.99", 0.8,
     "Reserved TEST-NET-1 address. Has no legitimate presence in lab telemetry."),
)
INDICATOR_SOURCE = "local-fixture-v1"

# Intelligence entries (type, value, verdict, confidence, category, reference).
INTEL_VERSION = "local-test-v1"
INTEL_FIRST_SEEN = "2026-01-01T00:00:00+00:00"
INTEL = (
    ("ipv4", "198.51.100.23", "malicious", 1.0, "reserved-range", "RFC 5737 TEST-NET-2"),
    ("ipv4", "198.51.100.45", "suspicious", 0.6, "reserved-range", "RFC 5737 TEST-NET-2"),
    ("ipv4", "203.0.113.7", "benign", 1.0, "reserved-range", "RFC 5737 TEST-NET-3"),
    ("ipv6", "2001:db8::dead", "suspicious", 0.5, "reserved-range", "RFC 3849"),
    ("domain", "malware-test.invalid", "malicious", 1.0, "reserved-domain", "RFC 2606 .invalid"),
    ("domain", "suspicious-test.invalid", "suspicious", 0.6, "reserved-domain",
     "RFC 2606 .invalid"),
    ("domain", "example.com", "benign", 1.0, "reserved-domain", "RFC 2606 .example"),
    ("url", "http://malware-test.invalid/payload", "malicious", 1.0, "reserved-domain",
     "RFC 2606 .invalid"),
    ("file_hash", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "benign",
     1.0, "known-test-vector", "FIPS 180-4 empty-string digest"),
)

# Techniques (id, name, tactic).
ATTACK_VERSION = "project-static-v1"
TECHNIQUES = (
    ("T1110", "Brute Force", "Credential Access"),
    ("T1078", "Valid Accounts", "Persistence"),
    ("T1059", "Command and Scripting Interpreter", "Execution"),
    ("T1140", "Deobfuscate/Decode Files or Information", "Defense Evasion"),
    ("T1048", "Exfiltration Over Alternative Protocol", "Exfiltration"),
    ("T1071", "Application Layer Protocol", "Command and Control"),
)
# Rule -> technique (rule, technique, confidence, pattern gate, rationale).
RULE_TECHNIQUES = (
    ("AUTH-001", "T1110", 0.85, None,
     "Multiple failed authentications followed by success for the same identity matches "
     "brute-force behavior; potential association, not proof the technique was used."),
    ("AUTH-003", "T1078", 0.55, None,
     "Authentication from a previously unseen source is consistent with valid-account use "
     "from a new location; window-relative signal only, moderate confidence."),
    ("PROC-001", "T1059", 0.8, "P1-shell-from-service",
     "Shell process spawned by a service host matches command interpreter abuse patterns; "
     "potential association only."),
    ("PROC-001", "T1140", 0.75, "P2-encoded-indicator",
     "Encoded-command indicator in telemetry matches deobfuscation behavior; potential "
     "association only."),
    ("PROC-002", "T1059", 0.8, None,
     "Configured suspicious parent-child pair (e.g. service host spawning a shell) matches "
     "interpreter abuse; potential association only."),
    ("NET-001", "T1071", 0.7, None,
     "Connection to a controlled indicator over an application protocol is consistent with "
     "C2 channel behavior; the indicator is lab-controlled, so this is a hypothesis."),
    ("DATA-001", "T1048", 0.6, None,
     "Unusually large outbound transfer is consistent with exfiltration staging; volume "
     "alone does not prove exfiltration."),
)


def iocs(spark: SparkSession) -> DataFrame:
    rows = [(i, t, v, c, d, INDICATOR_SOURCE) for i, (t, v, c, d) in enumerate(INDICATORS)]
    return spark.createDataFrame(
        rows, "ordinal int, type string, indicator string, confidence double, "
              "description string, source string")


def read_iocs(spark: SparkSession, path: str) -> DataFrame:
    """Indicator list from a JSON document {"indicators": [...]}; list order kept."""
    entry = ("struct<type:string,indicator:string,confidence:double,"
             "description:string,source:string>")
    doc = spark.read.schema(f"indicators array<{entry}>").option("multiLine", True).json(path)
    return doc.select(F.posexplode("indicators").alias("ordinal", "e")).select(
        "ordinal", "e.type", "e.indicator", "e.confidence", "e.description", "e.source")


def intel(spark: SparkSession) -> DataFrame:
    rows = [
        (t, v, verdict, c, ["test-fixture", cat], INTEL_FIRST_SEEN, ref)
        for t, v, verdict, c, cat, ref in INTEL
    ]
    return spark.createDataFrame(
        rows, "type string, value string, classification string, confidence double, "
              "categories array<string>, first_seen string, reference string")


def read_intel(spark: SparkSession, path: str) -> DataFrame:
    entry = ("struct<type:string,value:string,classification:string,confidence:double,"
             "categories:array<string>,first_seen:string,reference:string>")
    doc = spark.read.schema(f"entries array<{entry}>").option("multiLine", True).json(path)
    return doc.select(F.explode("entries").alias("e")).select("e.*")


def techniques(spark: SparkSession) -> DataFrame:
    """One row per rule-to-technique mapping, with the technique's name and tactic."""
    names = {t: (n, tac) for t, n, tac in TECHNIQUES}
    rows = [(r, t, *names[t], c, p, why, ATTACK_VERSION) for r, t, c, p, why in RULE_TECHNIQUES]
    return spark.createDataFrame(
        rows, "rule_id string, technique_id string, technique_name string, tactic string, "
              "confidence double, pattern string, rationale string, catalog_version string")
