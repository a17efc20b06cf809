"""Pattern scans over untrusted text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, first match wins for secrets.
SECRETS = ("password", "passwd", r"api[_-]?key\s*[:=]", "secret", "BEGIN [A-Z ]*PRIVATE KEY",
           "aws_secret", "client_secret")
INJECTIONS = (
    r"ignore\s+(all\s+)?prev(ious)?\s+instructions",
    r"disregard\s+(all\s+)?(prior|previous|system)\s+\w+",
    r"\breport\b.{0,40}\bas\s+safe\b",
    r"you\s+are\s+now\s+",
    r"override\s+(your|the)\s+policy",
)
STATE_CHANGES = (
    r"\bresolv\w*\b|\bclos\w*\b.*incident",
    r"\bassign\b|\breassign\b",
    r"\bquarantine\b|\bblock\b|\bkill\b|\bisolat\w*\b|\bcontain\b",
    r"\badd\b.{0,20}\bnote\b",
)
CITATION = r"\[(DET|EVID|MITRE|UEBA|TI):([A-Za-z0-9][A-Za-z0-9._: /-]{0,200})\]"
CITATION_KINDS = {"DET": "detection", "EVID": "event", "MITRE": "mitre", "UEBA": "ueba",
                  "TI": "threat_intelligence"}


def _matches(text: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(f"(?i){p}") for p in patterns])


def secret_scan(rows: DataFrame, text: str) -> DataFrame:
    """Rows naming the first secret pattern their text matches."""
    found = F.lit(None).cast("string")
    for p in reversed(SECRETS):
        found = F.when(F.col(text).rlike(f"(?i){p}"), p).otherwise(found)
    return rows.withColumn("secret_pattern", found).where(F.col("secret_pattern").isNotNull())


def injection_scan(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("injection", F.coalesce(_matches(F.col(text), INJECTIONS), F.lit(False)))


def intent_scan(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("state_change", F.coalesce(_matches(F.col(text), STATE_CHANGES), F.lit(False)))


def citation_check(answers: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations in answers that name something their incident holds.

    `answers`: answer_id, incident_id, text. `known`: incident_id, kind, id.
    Returns (first occurrence of each valid citation in order, dropped count per
    answer).
    """
    tags = F.regexp_extract_all("text", F.lit(CITATION), F.lit(0))
    rows = answers.select("answer_id", "incident_id", F.posexplode(tags).alias("pos", "tag")).select(
        "answer_id", "incident_id", "pos", F.regexp_extract("tag", CITATION, 1).alias("kind"),
        F.trim(F.regexp_extract("tag", CITATION, 2)).alias("id"))
    hit = rows.join(known.select("incident_id", "kind", "id").distinct(), ["incident_id", "kind", "id"])
    valid = hit.groupBy("answer_id", "kind", "id").agg(F.min("pos").alias("pos"))
    names = F.element_at(F.create_map(*[F.lit(x) for kv in CITATION_KINDS.items() for x in kv]), F.col("kind"))
    n = lambda df, name: df.groupBy("answer_id").agg(F.count(F.lit(1)).alias(name))
    dropped = answers.select("answer_id").join(n(rows, "tags"), "answer_id", "left").join(
        n(valid, "valid"), "answer_id", "left").fillna(0).withColumn(
        "dropped", F.col("tags") - F.col("valid"))
    return valid.withColumn("type", names), dropped
