"""Technique mapping and risk score of incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import RiskConfig
from palisade.functions.core import doublings, exact_mean, nz

PARTS = ("severity_points", "diversity_points", "confidence_points", "evidence_points",
         "sequence_points", "mitre_points", "contextual_points")


def incident_members(incidents: DataFrame, dets: DataFrame) -> DataFrame:
    """(incident_id, detection columns) for every stored member detection."""
    ids = incidents.select("incident_id", F.explode("detection_ids").alias("detection_id"))
    return ids.join(dets, "detection_id")


def map_techniques(members: DataFrame, techniques: DataFrame) -> DataFrame:
    """One row per (incident, technique, source rule)."""
    found = members.select(
        "incident_id", "rule_id", F.col("metadata")["pattern_id"].alias("pattern_id")).distinct()
    return (
        found.join(techniques, "rule_id")
        .where(F.col("pattern").isNull() | (F.col("pattern") == F.col("pattern_id")))
        .select("incident_id", "technique_id", "technique_name", "tactic",
                F.col("rule_id").alias("source_rule_id"), "rationale", "confidence",
                "catalog_version")
        .dropDuplicates(["incident_id", "technique_id", "source_rule_id"])
    )


def risk_band(points: Column, cfg: RiskConfig = RiskConfig()) -> Column:
    out = F.lit(cfg.bands[-1][1])
    for upper, name in reversed(cfg.bands[:-1]):
        out = F.when(points <= upper, name).otherwise(out)
    return out


def _all_in(array: str, *rules: str) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(r) for r in rules]), F.col(array))) == 0


def score_risk(
    incidents: DataFrame, members: DataFrame, mappings: DataFrame, cfg: RiskConfig = RiskConfig()
) -> DataFrame:
    """Risk columns per incident: capped additive parts, total 0-100, band, sentence."""
    m = F.col("metadata")
    data = F.col("rule_id") == "DATA-001"
    sent, limit = nz(m["bytes_sent"]), F.greatest(nz(m["threshold"], 1.0), F.lit(1.0)).cast("bigint")
    transfer = F.least(
        cfg.transfer_min + cfg.transfer_step * doublings(sent, limit), F.lit(cfg.transfer_max))
    facts = members.groupBy("incident_id").agg(
        F.count_distinct("rule_id").alias("rules"), exact_mean("confidence").alias("mean"),
        F.max(m["matched_ioc"].isNotNull()).alias("ioc"),
        F.max(F.col("rule_id").isin("PROC-001", "PROC-002")).alias("proc"),
        F.max(F.when(data, transfer)).alias("transfer"), F.max(F.when(data, sent)).alias("biggest"),
    )
    tactics = mappings.groupBy("incident_id").agg(
        F.count_distinct("tactic").alias("tactics"),
        F.array_sort(F.collect_set("technique_id")).alias("tids"))
    base = F.element_at(F.create_map(*[F.lit(x) for kv in cfg.severity_points for x in kv]),
                        F.col("severity"))
    flat = F.array_distinct(F.flatten(F.transform(
        F.col("metadata.sequence_hits"), lambda p: F.split(p, r"\+"))))
    chain3 = _all_in("flat", "AUTH-001", "PROC-001", "NET-001") | _all_in(
        "flat", "AUTH-001", "PROC-002", "NET-001")
    flag = lambda c, points: F.when(c, points).otherwise(0)
    rows = (
        incidents.select("incident_id", "severity", F.size("evidence_event_ids").alias("events"),
                         flat.alias("flat"))
        .join(facts, "incident_id", "left").join(tactics, "incident_id", "left")
        .select(
            "*", nz(base).alias("severity_points"),
            F.least(nz("rules") * cfg.per_rule, F.lit(cfg.rule_cap)).alias("diversity_points"),
            F.bround(10 * nz("mean", 0.0), 0).alias("confidence_points"),
            F.least("events", F.lit(cfg.evidence_cap)).alias("evidence_points"),
            F.when(chain3 & _all_in("flat", "DATA-001"), cfg.chain4)
            .when(chain3, cfg.chain3).otherwise(0).alias("sequence_points"),
            F.least(nz("tactics") * cfg.per_tactic, F.lit(cfg.tactic_cap)).alias("mitre_points"),
            (flag(F.col("ioc"), cfg.ioc) + flag(F.col("proc"), cfg.process)
             + nz("transfer")).alias("contextual_points"),
        )
    )
    rows = rows.withColumns({p: F.col(p).cast("int") for p in PARTS})
    total = F.least(F.greatest(sum((F.col(p) for p in PARTS), F.lit(0)), F.lit(0)), F.lit(100))
    rows = rows.withColumn("risk_score", total).withColumn(
        "risk_band", risk_band(F.col("risk_score"), cfg))
    bits = F.concat_ws(
        ", ",
        F.concat(F.lit("base severity "), F.col("severity"), F.lit(" ("),
                 F.col("severity_points").cast("string"), F.lit(")")),
        F.concat(nz("rules").cast("string"), F.lit(" distinct detection rules ("),
                 F.col("diversity_points").cast("string"), F.lit(")")),
        F.when(F.col("ioc"), F.lit("IOC evidence present")),
        F.when(F.col("proc"), F.lit("suspicious process activity present")),
        F.when(F.col("biggest").isNotNull(),
               F.format_string("large outbound transfer (%,d bytes)", "biggest")),
        F.when(F.col("sequence_points") > 0, F.lit("recognized multi-stage sequence")),
        F.when(F.col("tids").isNotNull(),
               F.concat(F.lit("ATT&CK hypotheses "), F.array_join("tids", ", "))),
    )
    text = F.concat(
        F.lit("Risk "), F.col("risk_score").cast("string"), F.lit(" ("), F.col("risk_band"),
        F.lit(") is elevated because the incident contains "), bits,
        F.lit(". Score prioritizes investigation; it is not a probability of compromise."))
    return rows.select(
        "incident_id", "risk_score", "risk_band",
        F.struct(*PARTS, F.col("risk_score").alias("total")).alias("risk_breakdown"),
        text.alias("risk_explanation"))


def enrich(
    incidents: DataFrame, dets: DataFrame, techniques: DataFrame, cfg: RiskConfig = RiskConfig()
) -> DataFrame:
    """Incidents with techniques, risk score, band, breakdown and explanation."""
    members = incident_members(incidents, dets)
    mappings = map_techniques(members, techniques)
    listed = mappings.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct(
        "technique_id", "source_rule_id", "technique_name", "tactic", "rationale", "confidence",
        "catalog_version"))).alias("mitre_techniques"))
    risk = score_risk(incidents, members, mappings, cfg)
    return incidents.join(risk, "incident_id").join(listed, "incident_id", "left").withColumn(
        "mitre_techniques", F.coalesce("mitre_techniques", F.array().cast(
            listed.schema["mitre_techniques"].dataType)))
