"""Detection rules over endpoint and identity telemetry.

Every rule takes prepared events (canonical columns plus `ts_us`) and returns
one row per detection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.config import HOUR, MINUTE, DetectConfig
from palisade.functions.core import basename, blank, doublings, micros, nz
from palisade.functions.detection import detections
from palisade.functions.state import pin
from palisade.operators.ordering import Fold, fire_with_reset, number_rows, prefix_scan, rows_before

# Outcome vocabulary of authentication telemetry.
FAILED = ("failed", "failure")
SUCCEEDED = ("success", "successful", "succeeded")


def prepare_events(events: DataFrame) -> DataFrame:
    """Attach the ordering time; (ts_us, event_id) orders every rule."""
    return events.withColumn("ts_us", micros("timestamp"))


def _single(row: DataFrame, rule: str, confidence, reason, meta) -> DataFrame:
    return detections(
        row, rule, confidence, reason, meta, evidence=F.array("event_id"),
        first_us=F.col("ts_us"), last_us=F.col("ts_us"),
    )


def _q(column) -> F.Column:
    """A value as it reads inside single quotes in a reason; absent reads None."""
    return F.coalesce(column, F.lit("None"))


def auth_001(events: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Failures followed by a success for one user and origin."""
    window = cfg.brute_window_minutes * MINUTE
    host = F.when(blank("host"), F.lit("unknown")).otherwise(F.col("host"))
    anchor = F.when(blank("source_ip"), F.concat(F.lit("host:"), host)).otherwise(
        F.col("source_ip")
    )
    auth = events.where((F.col("event_type") == "authentication") & ~blank("user")).select(
        "user", anchor.alias("anchor"), "event_id", "ts_us", "status",
        (~blank("source_ip")).alias("same_ip"),
    )
    key = ["user", "anchor"]
    fail = auth.where(F.col("status").isin(*FAILED)).withColumn("kind", F.lit("fail"))
    success = auth.where(F.col("status").isin(*SUCCEEDED)).withColumn("kind", F.lit("success"))
    # a success asks before the instant its window begins; a null id comes before all others
    asks = success.withColumns({
        "kind": F.lit("ask"), "of": F.col("event_id"), "of_us": F.col("ts_us"), "ts_us": F.col("ts_us") - window,
        "event_id": F.lit(None).cast("string")})
    own = {"of": F.col("event_id"), "of_us": F.col("ts_us")}
    marked = fail.withColumns(own).unionByName(success.withColumns(own)).unionByName(asks)
    # the number of failures up to each row: those of a window are a range of numbers
    counted = pin(prefix_scan(marked, key, ["ts_us", "event_id", "of"], {
        "fails": Fold("sum", F.when(F.col("kind") == "fail", 1).cast("bigint"))}))
    fired = counted.where("kind <> 'fail'").groupBy(*key, "of", "of_us", "same_ip").agg(
        F.max(F.when(F.col("kind") == "success", F.col("fails"))).alias("upto"),
        F.max(F.when(F.col("kind") == "ask", F.col("fails"))).alias("before"),
    ).withColumn("n", F.col("upto") - F.col("before")).where(F.col("n") >= cfg.brute_min_fails)
    # failures are listed for what fires only
    wanted = fired.withColumn("fails", F.explode(F.sequence(F.col("before") + 1, F.col("upto"))))
    failures = counted.where("kind = 'fail'").select(*key, "fails", F.col("event_id").alias("f_id"), F.col("ts_us").alias("f_us"))
    fired = wanted.join(failures, [*key, "fails"]).groupBy(
        *key, F.col("of").alias("event_id"), F.col("of_us").alias("ts_us"), "same_ip", "n").agg(
        F.collect_list("f_id").alias("fails"), F.min("f_us").alias("first_us"))
    reason = F.concat(
        F.col("n").cast("string"), F.lit(" failed authentication attempts for user '"),
        F.col("user"), F.lit("' from "), F.col("anchor"),
        F.lit(" were followed by a successful authentication within "
              f"{cfg.brute_window_minutes} minutes."),
    )
    return detections(
        fired, "AUTH-001", F.least(0.60 + 0.08 * F.col("n"), F.lit(0.95)), reason,
        {"user": F.col("user"), "anchor": F.col("anchor"), "fail_count": F.col("n"),
         "same_ip": F.col("same_ip")},
        evidence=F.concat(F.col("fails"), F.array("event_id")),
        first_us=F.col("first_us"), last_us=F.col("ts_us"),
    )


def auth_002(events: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Successful login outside the configured day window (UTC)."""
    hour = F.hour("timestamp")
    fired = events.where(
        (F.col("event_type") == "authentication") & F.col("status").isin(*SUCCEEDED)
        & ((hour < cfg.day_start_hour) | (hour >= cfg.day_end_hour))
    )
    reason = F.format_string(
        "Authentication occurred outside the configured normal login window "
        f"({cfg.day_start_hour:02d}:00-{cfg.day_end_hour:02d}:00 UTC); observed at "
        "%02d:%02d UTC. This is not by itself evidence of compromise.",
        hour, F.minute("timestamp"),
    )
    confidence = F.when(hour <= 5, 0.65).otherwise(0.55)
    return _single(fired, "AUTH-002", confidence, reason,
                   {"user": F.col("user"), "observed_hour": hour})


def auth_003(events: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """A source address the user has not logged in from before."""
    auth = events.where((F.col("event_type") == "authentication") & ~blank("user")).select(
        "user", "source_ip", "event_id", "ts_us"
    )
    numbered = number_rows(auth, ["user"])
    first_use = (
        numbered.where(~blank("source_ip")).groupBy("user", "source_ip")
        .agg(F.min(F.struct("rn", "event_id", "ts_us")).alias("f"))
        .select("user", "source_ip", "f.*")
    )
    first_known = first_use.groupBy("user").agg(F.min("rn").alias("known_from"))
    fired = first_use.join(first_known, "user").where(
        (F.col("rn") > F.col("known_from")) & (F.col("rn") > cfg.new_ip_min_history)
    )
    history = F.col("rn") - 1
    reason = F.concat(
        F.lit("New source IP observed for user '"), F.col("user"),
        F.lit("' within supplied telemetry (first "), history.cast("string"),
        F.lit(" events used as history). This is not by itself evidence of compromise."),
    )
    return _single(fired, "AUTH-003", F.lit(0.6), reason,
                   {"user": F.col("user"), "new_ip": F.col("source_ip"),
                    "history_events": history})


def _processes(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "process_creation").select(
        "event_id", "ts_us", basename("process_name").alias("process"),
        basename("parent_process").alias("parent"),
        F.lower(nz("command_line", "")).alias("command"),
    )


def proc_001(events: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Process matching a configured pattern; the first pattern in order wins."""
    no = F.lit(False)
    pattern = F.lit(None).cast("string")
    confidence, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    for p in reversed(cfg.process_patterns):
        by_name = F.col("process").isin(*p.processes) if p.processes else no
        by_command = no
        for token in p.command_tokens:
            by_command = by_command | F.col("command").contains(token)
        parent_ok = F.col("parent").isin(*p.parents) if p.parents else F.lit(True)
        hit = (by_name | by_command) & ~(by_name & ~parent_ok)
        pattern = F.when(hit, p.pattern_id).otherwise(pattern)
        confidence = F.when(hit, p.confidence).otherwise(confidence)
        text = F.when(hit, p.description).otherwise(text)
    fired = (
        _processes(events)
        .withColumn("pattern", pattern).where(F.col("pattern").isNotNull())
        .withColumn("conf", confidence).withColumn("text", text)
    )
    reason = F.concat(
        F.lit("Process telemetry matched pattern '"), F.col("pattern"), F.lit("': "),
        F.col("text"), F.lit(" (process='"), F.col("process"), F.lit("', parent='"),
        F.col("parent"), F.lit("')."),
    )
    return _single(fired, "PROC-001", F.col("conf"), reason,
                   {"pattern_id": F.col("pattern"), "process": F.col("process"),
                    "parent": F.col("parent")})


def proc_002(events: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Configured parent and child process observed together."""
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in cfg.parent_child_pairs])
    seen = F.concat(F.col("parent"), F.lit(">"), F.col("process"))
    fired = _processes(events).where(F.array_contains(pairs, seen))
    reason = F.concat(
        F.lit("Observed configured suspicious parent-child relationship: '"),
        F.col("parent"), F.lit("' spawned '"), F.col("process"), F.lit("'."),
    )
    return _single(fired, "PROC-002", F.lit(0.8), reason,
                   {"parent": F.col("parent"), "child": F.col("process")})


def net_001(events: DataFrame, iocs: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Destination on the indicator list; the earliest listed indicator wins.

    `iocs`: ordinal, type (ip / domain), indicator, confidence, description, source.
    """
    wanted = events.where(
        F.col("event_type").isin("network_connection", "dns_query", "data_transfer")
    ).select(
        "event_id", "ts_us", F.trim(nz("destination_ip", "")).alias("ip_key"),
        F.lower(F.trim(nz("domain", ""))).alias("domain_key"),
    )
    fields = F.struct("ordinal", "indicator", "type", "confidence", "description", "source")

    def lookup(kind: str, key, name: str, hit: str) -> DataFrame:
        return (
            iocs.where(F.col("type") == kind).groupBy(key.alias(name))
            .agg(F.min(fields).alias(hit))
        )

    by_ip = lookup("ip", F.col("indicator"), "ip_key", "ip_hit")
    by_domain = lookup("domain", F.lower("indicator"), "domain_key", "domain_hit")
    # only rows that have a value are dealt by it; the few hits meet again by event
    hits = [
        wanted.where(F.col(key) != "").join(known, key).select("event_id", "ts_us", F.col(hit).alias("ioc"))
        for key, known, hit in (("ip_key", by_ip, "ip_hit"), ("domain_key", by_domain, "domain_hit"))
    ]
    fired = hits[0].unionByName(hits[1]).groupBy("event_id", "ts_us").agg(F.min("ioc").alias("ioc"))
    ioc = F.col("ioc")
    reason = F.concat(
        F.lit("Connection to controlled indicator "), ioc["indicator"], F.lit(" ("),
        ioc["type"], F.lit("): "), ioc["description"], F.lit("."),
    )
    matched = F.struct(*[ioc[f].alias(f) for f in
                         ("indicator", "type", "confidence", "description", "source")])
    return _single(fired, "NET-001", nz(ioc["confidence"], 0.8), reason,
                   {"matched_ioc": matched})


def net_002(events: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Many DNS queries from one host and user in a short window."""
    keys, need = ["host", "user"], cfg.dns_threshold
    dns = events.where(F.col("event_type") == "dns_query").select(
        F.when(blank("host"), "unknown").otherwise(F.col("host")).alias("host"),
        F.when(blank("user"), "unknown").otherwise(F.col("user")).alias("user"),
        "event_id", "ts_us",
    )
    numbered = number_rows(dns, keys)
    fired = fire_with_reset(
        numbered, keys, need, cfg.dns_window_minutes * MINUTE, closed=True,
        chunk_rows=cfg.chunk_rows,
    )
    bursts = rows_before(numbered, fired, keys, need).groupBy(*keys, "fired_rn").agg(
        F.collect_list("event_id").alias("ids"), F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )
    reason = F.concat(
        F.lit(f"High-volume DNS activity detected: {need} queries for host '"),
        F.col("host"), F.lit("' / user '"), F.col("user"),
        F.lit(f"' within {cfg.dns_window_minutes} minutes."),
    )
    return detections(
        bursts, "NET-002", F.lit(min(0.6 + need / 1000, 0.9)), reason,
        {"host": F.col("host"), "user": F.col("user"), "count": F.lit(need)},
        evidence=F.col("ids"), first_us=F.col("first_us"), last_us=F.col("last_us"),
    )


def data_001(events: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """One transfer at or above the byte threshold."""
    limit = cfg.bytes_threshold
    fired = events.where(
        F.col("event_type").isin("data_transfer", "network_connection")
        & (F.col("bytes_sent") >= limit)
    )
    confidence = F.least(0.75 + 0.05 * doublings(F.col("bytes_sent"), limit), F.lit(0.95))
    reason = F.concat(
        F.format_string("Outbound transfer of %,d bytes by user '", F.col("bytes_sent")),
        _q(F.col("user")), F.lit("' on host '"), _q(F.col("host")),
        F.lit(f"' meets the {limit:,}-byte threshold. "
              "Volume alone does not prove malicious intent."),
    )
    return _single(fired, "DATA-001", confidence, reason,
                   {"user": F.col("user"), "host": F.col("host"),
                    "bytes_sent": F.col("bytes_sent"), "threshold": F.lit(limit)})
