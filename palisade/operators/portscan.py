"""Port-scan rule: one source touching many ports, mostly with unanswered probes.

A firing clears the window, so the rule is sequential per source. Only the
one-minute slots that can take part in a firing survive a counting prefilter;
runs of such slots are independent, and a long run is cut into parts. Each part
first reports what it would hand on for every firing its predecessor could end
with, these small tables are chained per run, and then every part is replayed
once with its true start. No task sees more than one part and one extra slot.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from palisade.config import MINUTE, SECOND, FlowConfig
from palisade.functions.core import blank
from palisade.functions.detection import detections
from palisade.functions.state import counted, pin
from palisade.operators.flow import RuleOutput, probe

KEYS = ["source_ip", "run", "part"]
ROWS = ["event_id", "ts_us", "destination_port", "probe", "own"]


def scan_slots(flows: DataFrame, width_us: int, need: int) -> DataFrame:
    """Flows in slots that, with a neighbour, reach `need` distinct ports, tagged
    with the run of adjacent slots they belong to."""
    rows = flows.where(~blank("source_ip")).select(
        "source_ip", "event_id", "ts_us", "destination_port", probe().alias("probe"),
        F.floor(F.col("ts_us") / F.lit(width_us)).alias("slot"),
    )
    ports = rows.where(F.col("destination_port").isNotNull()).groupBy(
        "source_ip", "slot", "destination_port").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy("source_ip").orderBy("slot")
    beside = lambda f, at: F.when(
        f("slot").over(w) == F.col("slot") + at, f("d").over(w)).otherwise(0)
    live = (
        ports.groupBy("source_ip", "slot").agg(F.count(F.lit(1)).alias("d"), F.sum("c").alias("size"))
        .withColumn("pair", F.col("d") + F.greatest(beside(F.lag, -1), beside(F.lead, 1)))
        .where(F.col("pair") >= need)
        .withColumn("fresh", F.coalesce(F.lag("slot").over(w) != F.col("slot") - 1, F.lit(True)))
        .withColumn("run", F.sum(F.col("fresh").cast("int")).over(w))
        .withColumn("place", F.row_number().over(
            W.partitionBy("source_ip", "run").orderBy("slot")) - 1)
        .withColumn("run_rows", F.sum("size").over(W.partitionBy("source_ip", "run")))
        .select("source_ip", "slot", "run", "place", "run_rows")
    )
    live = counted(live)
    return rows.join(live, ["source_ip", "slot"])


class _Part:
    """One part of a run in arrays: rows before `own` belong to the part before."""

    def __init__(self, rows: dict[str, np.ndarray], span_us: int, need: int, fraction: float):
        """`rows`: columns in the order of time and id."""
        self.ids, self.us, self.probe = rows["event_id"], rows["ts_us"], rows["probe"]
        self.ports = [None if p is None or p != p else int(p) for p in rows["destination_port"].tolist()]
        self.own = int((~rows["own"].astype(bool)).sum())
        self.need, self.fraction = need, fraction
        self.low = np.searchsorted(self.us, self.us - span_us, side="right")
        self.pure = self._unreset()
        self.place = {e: i for i, e in enumerate(self.ids[: self.own])}

    def _hit(self, distinct: int, probes: int) -> bool:
        return distinct >= self.need and probes / distinct > self.fraction

    def _unreset(self) -> np.ndarray:
        """Rows that fire when nothing fired inside their window."""
        waiting: dict[int, deque] = {}
        probes, left, out = 0, 0, []
        for i, port in enumerate(self.ports):
            if port is not None:
                line = waiting.setdefault(port, deque())
                if not line:
                    probes += int(self.probe[i])
                line.append(i)
            while left < self.low[i]:
                gone = self.ports[left]
                if gone is not None:
                    line = waiting[gone]
                    line.popleft()
                    probes -= int(self.probe[left])
                    if line:
                        probes += int(self.probe[line[0]])
                    else:
                        del waiting[gone]
                left += 1
            if i >= self.own and self._hit(len(waiting), probes):
                out.append(i)
        return np.array(out, dtype=np.int64)

    def after(self, start: int) -> int | None:
        """First row to fire when the window may not reach back before `start`."""
        seen: set[int] = set()
        probes = 0
        for i in range(start, len(self.us)):
            if self.low[i] > start:
                at = int(np.searchsorted(self.pure, i))
                return int(self.pure[at]) if at < len(self.pure) else None
            port = self.ports[i]
            if port is not None and port not in seen:
                seen.add(port)
                probes += int(self.probe[i])
            if i >= self.own and self._hit(len(seen), probes):
                return i
        return None

    def firings(self, entry: str | None, known: dict[int, int | None]):
        """(row, window start) of each firing, given the last one before the part."""
        start = 0
        if entry is None:
            at = int(self.pure[0]) if len(self.pure) else None
        else:
            start = self.place[entry] + 1
            if start not in known:
                known[start] = self.after(start)
            at = known[start]
        while at is not None:
            yield at, max(start, int(self.low[at]))
            start = at + 1
            if start not in known:
                known[start] = self.after(start)
            at = known[start]


def _tables(span_us: int, need: int, fraction: float):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["ts_us", "event_id"], kind="stable")
        part, known, out = _Part({c: g[c].to_numpy() for c in ROWS}, span_us, need, fraction), {}, []
        for entry in [None, *part.ids[: part.own]]:
            last = None
            for last, _ in part.firings(entry, known):
                pass
            out.append((entry, None if last is None else part.ids[last]))
        frame = pd.DataFrame(out, columns=["entry", "exit"])
        for k in KEYS:
            frame[k] = g[k].iloc[0]
        return frame[[*KEYS, "entry", "exit"]]

    return run


def _walk(g: pd.DataFrame) -> pd.DataFrame:
    """Entry of every part of one run from the reachable (entry, exit) rows."""
    table = {(p, e): x for p, e, x in zip(g["part"], g["entry"], g["exit"])}
    entry, out = None, []
    for part in sorted(set(g["part"])):
        if (part, entry) not in table:  # too old to matter for this part
            entry = None
        out.append((part, entry))
        entry = table[(part, entry)]
    frame = pd.DataFrame(out, columns=["part", "entry"])
    return frame.assign(source_ip=g["source_ip"].iloc[0], run=g["run"].iloc[0])[[*KEYS, "entry"]]


def _groups(batches, columns: list[str]):
    """Per batch, the groups of equal KEYS that end in it, as columns; rows of a group follow each other.

    A task meets tens of thousands of small groups, so columns are cut, not frames.
    """
    open_: list[dict[str, np.ndarray]] = []
    whole = lambda: {c: np.concatenate([p[c] for p in open_]) for c in columns}
    for batch in batches:
        if not len(batch):
            continue
        told, ended = {c: batch[c].to_numpy() for c in columns}, []
        fresh = np.zeros(len(batch), dtype=bool)
        for k in KEYS:
            fresh[1:] |= told[k][1:] != told[k][:-1]
            fresh[0] |= bool(open_) and told[k][0] != open_[-1][k][-1]
        at = 0
        for end in np.flatnonzero(fresh):
            if end > at:
                open_.append({c: v[at:end] for c, v in told.items()})
            ended.append(open_[0] if len(open_) == 1 else whole())
            open_, at = [], end
        open_.append({c: v[at:] for c, v in told.items()})
        yield ended
    yield [whole()] if open_ else []


def _replay(span_us: int, need: int, fraction: float):
    def firings(g: dict[str, np.ndarray]):
        part, entry = _Part(g, span_us, need, fraction), g["entry"][0]
        for at, start in part.firings(entry if isinstance(entry, str) else None, {}):
            first: dict[int, int] = {}
            for i in range(start, at + 1):
                if part.ports[i] is not None:
                    first.setdefault(part.ports[i], i)
            rows = [first[p] for p in sorted(first)]
            yield g["source_ip"][0], [part.ids[i] for i in rows], [int(part.us[i]) for i in rows]

    def run(batches):
        for groups in _groups(batches, [*KEYS, *ROWS, "entry"]):
            out = [f for g in groups for f in firings(g)]
            yield pd.DataFrame(out, columns=["source_ip", "ids", "us"])

    return run


def flow_003(
    flows: DataFrame, cfg: FlowConfig = FlowConfig(), part_slots: int = 10, whole_rows: int = 100_000
) -> RuleOutput:
    """Runs of more than `whole_rows` flows are cut into parts of `part_slots` slots."""
    span = min(cfg.scan_window_minutes * MINUTE, cfg.scan_density_seconds * SECOND)
    args = (span, cfg.scan_min_ports, cfg.scan_probe_fraction)
    slots = scan_slots(flows, span, cfg.scan_min_ports)
    cut = F.col("run_rows") > whole_rows
    part = F.when(cut, F.floor(F.col("place") / part_slots)).otherwise(F.lit(0)).cast("bigint")
    edge = cut & (F.col("place") % part_slots == part_slots - 1)
    rows = pin(
        slots.withColumn("home", part)
        .withColumn("part", F.explode(F.when(edge, F.array(part, part + 1)).otherwise(F.array(part))))
        .withColumn("own", F.col("part") == F.col("home"))
        .select(*KEYS, *ROWS)
    )
    # counted: where no run is long, as is usual, no row is dealt by run for nothing
    long_runs = counted(rows.where("own AND part > 0").select("source_ip", "run").distinct())
    key_ddl = "source_ip string, run bigint, part bigint"
    cuts = rows.join(long_runs, ["source_ip", "run"], "left_semi")
    # A trailing group that only borrowed rows has nothing of its own to fire.
    owned = cuts.where("own").select(*KEYS).distinct()
    tables = pin(
        cuts.join(owned, KEYS, "left_semi")
        .groupBy(*KEYS).applyInPandas(_tables(*args), f"{key_ddl}, entry string, exit string")
    )
    reachable = tables.where("exit is not null").select(
        "source_ip", "run", (F.col("part") + 1).alias("part"), F.col("exit").alias("entry")
    ).distinct()
    small = tables.where("entry is null").unionByName(
        tables.join(reachable, [*KEYS, "entry"], "left_semi"))
    entries = small.groupBy("source_ip", "run").applyInPandas(_walk, f"{key_ddl}, entry string")
    led = (rows.withColumn("entry", F.lit(None).cast("string")) if long_runs.isEmpty()
           else rows.join(counted(entries), KEYS, "left"))
    fired = led.repartition(*KEYS).sortWithinPartitions(*KEYS, "ts_us", "event_id").mapInPandas(
        _replay(*args), "source_ip string, ids array<string>, us array<bigint>")
    n = F.size("ids").cast("bigint")
    used = F.slice("us", 1, 20)
    reason = F.concat(
        F.lit("Port-scan-like behavior detected: "), n.cast("string"),
        F.lit(" distinct destination ports contacted from "), F.col("source_ip"),
        F.lit(" within 5 minutes."),
    )
    dets = pin(detections(
        fired, "FLOW-003", F.least(0.55 + 0.02 * n, F.lit(0.85)), reason,
        {"source_ip": F.col("source_ip"), "distinct_ports": n},
        evidence=F.slice("ids", 1, 20), first_us=F.array_min(used), last_us=F.array_max(used),
        keep=("ids",),
    ))
    members = dets.select("detection_id", F.explode("ids").alias("event_id"))
    return RuleOutput(dets.drop("ids"), members)
