"""Detection rules over network flows.

Input: the flow view (identity, ordering time, endpoints, byte counts and the
numeric columns; no labels). Each rule returns its detections and, apart from
them, one row per (detection, member flow): a bucket can hold millions of flows,
so membership stays a table instead of an array.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from palisade.config import MINUTE, SECOND, FlowConfig
from palisade.functions.core import array_median, blank, nz
from palisade.functions.detection import detections
from palisade.functions.quantiles import quantile
from palisade.functions.skew import join_groups
from palisade.functions.state import counted, pin
from palisade.operators.ordering import Fold, fire_with_reset, prefix_scan, rows_before

GLOBAL = "GLOBAL"


class RuleOutput(NamedTuple):
    detections: DataFrame
    members: DataFrame  # detection_id, event_id


def _target() -> Column:
    return F.when(blank("destination_ip"), F.lit(GLOBAL)).otherwise(F.col("destination_ip"))


def anchored_buckets(flows: DataFrame, width_s: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Flows with their target key and the index of their fixed-width bucket,
    counted from the key's first flow."""
    keyed = flows.select("event_id", "ts_us", _target().alias("key"), *extra)
    start = counted(keyed.groupBy("key").agg(F.min("ts_us").alias("t0")))
    return keyed.join(start, "key").withColumn(
        "idx", F.floor((F.col("ts_us") - F.col("t0")) / F.lit(width_s * SECOND))
    ).drop("t0")


def ends(rows: DataFrame, group: list[str], size: str, limit: int = 20) -> DataFrame:
    """First and last rows of each ordered group: all of it up to `limit` rows,
    else the first and last half. `size` names the group's row count."""
    half = limit // 2
    up = W.partitionBy(*group).orderBy("ts_us", "event_id")
    down = W.partitionBy(*group).orderBy(F.desc("ts_us"), F.desc("event_id"))
    head = rows.withColumn("_r", F.row_number().over(up)).where(F.col("_r") <= limit)
    head = head.where((F.col(size) <= limit) | (F.col("_r") <= half))
    tail = rows.withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= limit - half)
    return head.unionByName(tail.where(F.col(size) > limit)).drop("_r")


def top(rows: DataFrame, group: list[str], order: list[Column], limit: int) -> DataFrame:
    w = W.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def evidence_of(rows: DataFrame, group: list[str]) -> DataFrame:
    return rows.groupBy(*group).agg(
        F.collect_list("event_id").alias("ids"), F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )


def _emit(fired, rule, confidence, reason, meta, group, member_rows, rule_name=None, nulls=False) -> RuleOutput:
    """Detections and the members of their groups. Without `nulls` in a group, members stay dealt as they are."""
    dets = pin(detections(
        fired, rule, confidence, reason, meta, evidence=F.col("ids"),
        first_us=F.col("first_us"), last_us=F.col("last_us"), rule_name=rule_name,
        keep=tuple(f"_{g}" for g in group),
    ))
    link = dets.select("detection_id", *[F.col(f"_{g}").alias(g) for g in group])
    same = [member_rows[g].eqNullSafe(link[g]) for g in group] if nulls else group
    members = member_rows.join(link, same).select("detection_id", "event_id")
    return RuleOutput(dets.drop(*[f"_{g}" for g in group]), members)


def _tagged(fired: DataFrame, group: list[str]) -> DataFrame:
    return fired.withColumns({f"_{g}": F.col(g) for g in group})


def flow_001(flows: DataFrame, cfg: FlowConfig = FlowConfig()) -> RuleOutput:
    """Flow count of a target far above the median of its recent buckets."""
    group, back = ["key", "idx"], cfg.rate_baseline_windows
    rows = anchored_buckets(flows, cfg.rate_window_seconds)
    recent = W.partitionBy("key").orderBy("idx").rangeBetween(-back, -1)
    depth = F.least(F.lit(back), F.col("idx")).cast("int")
    fired = counted(
        rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("prior", F.collect_list("n").over(recent))
        .withColumn("prior", F.concat(
            "prior", F.array_repeat(F.lit(0).cast("bigint"), depth - F.size("prior"))))
        .withColumn("baseline", F.coalesce(array_median(F.col("prior")), F.lit(0.0)))
        .withColumn("threshold", F.greatest(
            F.lit(float(cfg.rate_min_count)), cfg.rate_baseline_factor * F.col("baseline")))
        .where((F.col("n") >= F.col("threshold")) & (F.col("n") >= cfg.rate_min_count))
        .withColumn("halves", F.size("prior") % 2 == 0).drop("prior")
    )
    members = pin(rows.join(fired.select(*group, "n"), group))
    proof = evidence_of(ends(members, group, "n"), group)
    median_text = F.when((F.col("idx") > 0) & F.col("halves"),
                         F.format_string("%.1f", F.col("baseline"))).otherwise(
        F.col("baseline").cast("bigint").cast("string"))
    reason = F.concat(
        F.lit("High-rate connection behavior detected: "), F.col("n").cast("string"),
        F.lit(" flows to "), F.col("key"), F.lit(" within 60 seconds (baseline median "),
        median_text, F.lit(")."),
    )
    return _emit(
        _tagged(fired.join(proof, group), group), "FLOW-001",
        F.least(0.55 + 0.05 * F.log2(F.col("n") / F.col("threshold")), F.lit(0.9)), reason,
        {"key": F.col("key"), "count": F.col("n"), "baseline_median": F.col("baseline"),
         "threshold": F.col("threshold")},
        group, members,
    )


def short_syn(max_bytes: int) -> Column:
    total = nz("bytes_sent") + nz("bytes_received")
    return (nz("syn", 0.0) > nz("ack", 0.0)) & (total < max_bytes)


def probe() -> Column:
    """Unanswered TCP probe: more SYNs than ACKs."""
    return nz(F.col("protocol") == "TCP", False) & (nz("syn", 0.0) > nz("ack", 0.0))


def _rows_in_window(numbered: DataFrame, fired: DataFrame, window_us: int) -> DataFrame:
    """Per fired row, how many rows of its key lie in the window since the last firing.

    `fired`: key, rn, ts_us, all_rn. Each asks at the instant its window begins for the last row
    that is too old; scans carry that row's number and the last firing's along the key.
    """
    asks = fired.select(
        "key", (F.col("ts_us") - window_us).alias("ts_us"), F.lit(None).cast("bigint").alias("all_rn"), "rn")
    both = numbered.select("key", "ts_us", "all_rn", F.lit(None).cast("bigint").alias("rn")).unionByName(asks)
    both = both.withColumn("asks", F.col("rn").isNotNull())
    expired = prefix_scan(both, ["key"], ["ts_us", "asks", "all_rn", "rn"], {"expired": Fold("max", F.col("all_rn"))})
    last = prefix_scan(fired, ["key"], ["rn"], {"reset": Fold("last", F.col("all_rn"), own=False)})
    return last.join(expired.where("asks").select("key", "rn", "expired"), ["key", "rn"]).select(
        "key", "rn", (F.col("all_rn") - F.greatest(nz("reset"), nz("expired"))).alias("window_count"))


def _live_slots(keyed: DataFrame, width_us: int, need: int) -> DataFrame:
    """Rows of the slots that, with a neighbour, hold `need` short flows of their key, and of the slots before them.

    A window of one slot's width meets a slot and the one before it, so every row of a window that can
    fire is kept, and numbers within it stay as far apart as they are among all rows.
    """
    slotted = keyed.withColumn("slot", F.floor(F.col("ts_us") / F.lit(width_us)))
    w = W.partitionBy("key").orderBy("slot")
    beside = lambda f, at: F.when(f("slot").over(w) == F.col("slot") + at, f("n").over(w)).otherwise(0)
    live = counted(
        slotted.where("short").groupBy("key", "slot").agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"before": beside(F.lag, -1), "after": beside(F.lead, 1)})
        .where(F.col("n") + F.greatest("before", "after") >= need)
        .select("key", F.explode(F.array(F.col("slot") - 1, F.col("slot"))).alias("slot")).distinct())
    return slotted.join(live, ["key", "slot"]).drop("slot")


def flow_002(flows: DataFrame, cfg: FlowConfig = FlowConfig()) -> RuleOutput:
    """Many short SYN-heavy flows to one service, restarting after each firing."""
    need, window = cfg.brute_min_flows, cfg.brute_window_minutes * MINUTE
    port = F.coalesce(F.col("destination_port").cast("string"), F.lit("?"))
    keyed = flows.select(
        "event_id", "ts_us", F.concat_ws("|", _target(), port).alias("key"),
        short_syn(cfg.brute_max_bytes).alias("short"),
    )
    one = F.lit(1).cast("bigint")
    every = pin(prefix_scan(_live_slots(keyed, window, need), ["key"], ["ts_us", "event_id"], {
        "all_rn": Fold("sum", one), "rn": Fold("sum", F.when(F.col("short"), one))}))
    short = every.where("short")
    at = fire_with_reset(short, ["key"], need, window, closed=False, chunk_rows=cfg.chunk_rows)
    fired = pin(short.join(at, ["key", "rn"]).select("key", "rn", "ts_us", "all_rn"))
    counts = _rows_in_window(every, fired, window)
    members = rows_before(short, at, ["key"], need).select(
        "key", F.col("fired_rn").alias("rn"), "event_id", "ts_us", F.lit(need).alias("n"))
    group = ["key", "rn"]
    proof = evidence_of(ends(members, group, "n"), group).join(counts, group)
    reason = F.concat(
        F.lit(f"Repeated connection attempts detected: {need} short SYN-heavy flows to "),
        F.col("key"), F.lit(" within 5 minutes."),
    )
    return _emit(
        _tagged(proof, group), "FLOW-002", F.lit(min(0.60 + 0.02 * need, 0.9)), reason,
        {"key": F.col("key"), "qualifying_count": F.lit(need),
         "window_count": F.col("window_count")},
        group, members,
    )


def flow_003b(flows: DataFrame, cfg: FlowConfig = FlowConfig()) -> RuleOutput:
    """Port entropy per UTC minute, only where no flow names a source."""
    sourced = flows.where(~blank("source_ip"))
    rows = flows.where(F.col("destination_port").isNotNull()).select(
        "event_id", "ts_us", "destination_port",
        F.floor(F.col("ts_us") / F.lit(MINUTE)).alias("minute"),
    ).where(~sourced.select("event_id").exists())
    c = F.col("c")
    fired = pin(
        rows.groupBy("minute", "destination_port").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("minute")
        .agg(F.sum("c").alias("n"), F.sum(c * F.log2(c)).alias("weighted"))
        .withColumn("bits", F.round(F.log2("n") - F.col("weighted") / F.col("n"), 9))
        .where((F.col("n") >= cfg.scan_min_ports) & (F.col("bits") >= cfg.scan_entropy_bits))
    )
    group = ["minute"]
    members = rows.join(fired.select("minute"), group)
    first20 = top(members, group, [F.col("ts_us"), F.col("event_id")], 20)
    reason = F.format_string(
        "Port-entropy anomaly detected: destination-port entropy %.2f bits across %d flows in "
        "one minute. This is not attributed to any source.", F.col("bits"), F.col("n"))
    return _emit(
        _tagged(fired.join(evidence_of(first20, group), group), group), "FLOW-003",
        F.least(0.5 + 0.05 * F.col("bits"), F.lit(0.8)), reason,
        {"entropy_bits": F.round("bits", 3), "flow_count": F.col("n"),
         "mode": F.lit("global-fallback")},
        group, members, rule_name="Port Entropy Anomaly",
    )


def flow_004(flows: DataFrame, cfg: FlowConfig = FlowConfig()) -> RuleOutput:
    """Median byte rate of a bucket far above the median of earlier peaks."""
    group = ["key", "idx"]
    back = cfg.byte_baseline_minutes * 60 // cfg.byte_window_seconds
    rows = anchored_buckets(flows, cfg.byte_window_seconds, (nz("byte_rate", 0.0).alias("rate"),))
    recent = W.partitionBy("key").orderBy("idx").rangeBetween(-back, -1)
    floor = F.lit(cfg.byte_floor)
    signal, base = F.col("signal"), F.col("baseline")
    quiet = base <= 0
    needed = F.when(quiet, floor * max(cfg.byte_ratio, 1.0)).otherwise(
        F.greatest(cfg.byte_ratio * base, floor))
    # a median is at most the peak, so few buckets are left to take one of
    likely = pin(
        rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max("rate").alias("peak"))
        .withColumn("prior", F.collect_list("peak").over(recent))
        .where((F.col("n") >= cfg.byte_min_flows) & (F.size("prior") >= cfg.byte_min_history))
        .withColumn("baseline", array_median(F.col("prior"))).drop("prior")
        .where(F.col("peak") >= needed)
    )
    total = likely.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    middle = quantile(join_groups(rows, likely.select(*group, "n"), group, "n", total).select(*group, "rate"), group, "rate", 0.5)
    fired = counted(
        likely.join(middle.select(*group, F.col("quantile").alias("signal")), group)
        .where(signal >= needed)
        .withColumn("ratio", signal / F.when(quiet, floor).otherwise(base))
    )
    members = pin(rows.join(fired.select(*group), group))
    best = top(members, group, [F.desc("rate"), F.col("event_id")], 3)
    reason = F.format_string(
        "Anomalous flow byte rate detected: median %,.0f B/s vs %,.0f B/s recent median.",
        F.bround("signal", 0), F.bround("baseline", 0))
    return _emit(
        _tagged(fired.join(evidence_of(best, group), group), group), "FLOW-004",
        F.least(0.55 + 0.1 * F.log2(F.greatest(F.col("ratio"), F.lit(1.0))), F.lit(0.85)), reason,
        {"key": F.col("key"), "median_byts": signal, "baseline_median": base,
         "ratio": F.round("ratio", 2)},
        group, members,
    )


def _split(rows: DataFrame) -> Column:
    """End of the first third of the time span, as one value."""
    return rows.agg((
        F.min("ts_us") + F.round((F.max("ts_us") - F.min("ts_us")) / 3).cast("bigint")
    ).alias("split")).scalar()


def novelty_profile(flows: DataFrame) -> DataFrame:
    """How many pairs the baseline knows and how many first appear after it."""
    rows = flows.select("ts_us", "protocol", "destination_port")
    first = rows.groupBy("protocol", "destination_port").agg(F.min("ts_us").alias("first_us"))
    split = _split(rows)
    return first.agg(F.count_if(F.col("first_us") < split).alias("catalog_pairs"),
                     F.count_if(F.col("first_us") >= split).alias("novel_pairs"))


def flow_005(flows: DataFrame, cfg: FlowConfig = FlowConfig()) -> RuleOutput:
    """Protocol and port pair absent from the first third of the time span,
    with enough flows in its busiest minute."""
    pair = ["protocol", "destination_port"]
    rows = flows.select("event_id", "ts_us", *pair)
    split = _split(rows)
    known = rows.where(F.col("ts_us") < split).select(
        *[F.col(c).alias(f"k_{c}") for c in pair]).distinct()
    minutes = (
        rows.where(F.col("ts_us") >= split)
        .groupBy(*pair, F.floor(F.col("ts_us") / F.lit(MINUTE)).alias("minute"))
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy(*pair).agg(F.sum("c").alias("n"), F.max("c").alias("peak"))
        .where((F.col("n") >= cfg.novelty_min_flows) & (F.col("peak") >= cfg.novelty_min_peak))
    )
    same = [minutes[c].eqNullSafe(known[f"k_{c}"]) for c in pair]
    fired = counted(minutes.join(known, same, "left_anti"))
    f = fired.select(*[F.col(c).alias(f"f_{c}") for c in pair])
    members = pin(rows.join(f, [rows[c].eqNullSafe(f[f"f_{c}"]) for c in pair]).select(
        "event_id", "ts_us", *pair))
    proof = evidence_of(top(members, pair, [F.col("ts_us"), F.col("event_id")], 5), pair)
    p = proof.withColumnsRenamed({c: f"p_{c}" for c in pair})
    full = fired.join(p, [fired[c].eqNullSafe(p[f"p_{c}"]) for c in pair])
    low, high = cfg.ephemeral_ports
    reason = F.concat(
        F.lit("Unusual protocol/port combination observed: "), nz("protocol", "None"), F.lit("/"),
        nz(F.col("destination_port").cast("string"), "None"), F.lit(" ("),
        F.col("n").cast("string"), F.lit(" flows), unseen in baseline period."),
    )
    return _emit(
        _tagged(full, pair), "FLOW-005", F.lit(0.5), reason,
        {"protocol": F.col("protocol"), "destination_port": F.col("destination_port"),
         "count": F.col("n"), "peak_minute_count": F.col("peak"),
         "ephemeral_port": nz(F.col("destination_port").between(low, high), False)},
        pair, members, nulls=True,
    )


def flow_006(flows: DataFrame, cfg: FlowConfig = FlowConfig()) -> RuleOutput:
    """Flow and packet surge to one target inside a short bucket."""
    group, width = ["key", "idx"], cfg.burst_window_seconds
    rows = anchored_buckets(flows, width, (
        (nz("fwd_pkts", 0.0) + nz("bwd_pkts", 0.0)).alias("packets"),
        nz("packet_rate", 0.0).alias("rate"),
    ))
    fired = counted(
        rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("packets").alias("total"))
        .withColumn("pps", F.col("total") / width)
        .where((F.col("n") >= cfg.burst_min_flows) & (F.col("pps") >= cfg.burst_min_pps))
    )
    members = pin(rows.join(fired.select(*group), group))
    best = top(members, group, [F.desc("rate"), F.desc("packets"), F.col("event_id")], 20)
    reason = F.format_string(
        "Denial-of-service-like traffic pattern detected: %d flows, %,.0f packets/s within "
        "30 seconds.", F.col("n"), F.bround("pps", 0))
    return _emit(
        _tagged(fired.join(evidence_of(best, group), group), group), "FLOW-006",
        F.least(0.65 + 0.05 * F.log10(F.col("pps") / cfg.burst_min_pps), F.lit(0.9)), reason,
        {"key": F.col("key"), "flow_count": F.col("n"), "packets_per_s": F.round("pps", 1)},
        group, members,
    )
