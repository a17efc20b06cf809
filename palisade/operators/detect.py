"""Running a rule set and uniting its results."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame

from palisade.config import DetectConfig, FlowConfig
from palisade.functions.state import finished
from palisade.operators import endpoint, flow, portscan
from palisade.operators.flow import RuleOutput
from palisade.schema import DETECTION_COLUMNS, DETECTION_DDL, ddl

log = logging.getLogger("palisade.detect")

Rule = Callable[[DataFrame], DataFrame | RuleOutput]


def endpoint_rules(iocs: DataFrame, cfg: DetectConfig = DetectConfig()) -> dict[str, Rule]:
    """Rule id -> function of prepared events. Callers may add their own."""
    named = {
        "AUTH-001": endpoint.auth_001, "AUTH-002": endpoint.auth_002,
        "AUTH-003": endpoint.auth_003, "PROC-001": endpoint.proc_001,
        "PROC-002": endpoint.proc_002, "NET-002": endpoint.net_002, "DATA-001": endpoint.data_001,
    }
    rules: dict[str, Rule] = {k: (lambda e, f=f: f(e, cfg)) for k, f in named.items()}
    rules["NET-001"] = lambda e: endpoint.net_001(e, iocs, cfg)
    return rules


def flow_rules(cfg: FlowConfig = FlowConfig()) -> dict[str, Rule]:
    named = {
        "FLOW-001": flow.flow_001, "FLOW-002": flow.flow_002, "FLOW-003": portscan.flow_003,
        "FLOW-003b": flow.flow_003b, "FLOW-004": flow.flow_004, "FLOW-005": flow.flow_005,
        "FLOW-006": flow.flow_006,
    }
    return {k: (lambda v, f=f: f(v, cfg)) for k, f in named.items()}


class RuleSetOutput(NamedTuple):
    detections: DataFrame
    members: DataFrame  # detection_id, event_id; a row repeats where a rule is given an event twice
    failed: DataFrame  # rule_id, error


FAILED_DDL = "rule_id string, error string"
#: Failures of the cluster rather than of a rule; a run that meets one has no complete result.
_NOT_THE_RULES = ("SparkException", "Py4JNetworkError", "Py4JJavaError", "OSError", "MemoryError")


def _is_rules_own(error: Exception) -> bool:
    """Was it the rule that failed, in Python or in the analysis of its plan?"""
    if isinstance(error, (OSError, MemoryError, ConnectionError)):
        return False
    kind = type(error).__name__
    return kind not in _NOT_THE_RULES and "Job aborted" not in str(error) and "ExecutorLost" not in str(error)


def run_rules(rows: DataFrame, rules: dict[str, Rule]) -> RuleSetOutput:
    """All detections of the rule set, one per fingerprint, with bucket members and the rules that failed.

    A rule that cannot be planned is logged and told in `failed`; the others still run. What Spark
    itself fails at (lost executors, storage, memory) rises, since skipping a rule for it would lose
    detections.
    """
    found, members, failed = [], [], []
    for rule_id, rule in rules.items():
        out = _tried(rule_id, rule, rows, failed)
        if isinstance(out, RuleOutput):
            members.append(out.members)
            out = out.detections
        if out is not None:
            found.append(out.select(*DETECTION_COLUMNS))
    return _united(rows, found, members, failed, alone=False)


def store_rules(rows: DataFrame, rules: dict[str, Rule], members: bool = True) -> RuleSetOutput:
    """What `run_rules` gives, stored rule by rule: all that one rule keeps is let go of before the next begins.

    Without `members` those are neither joined nor stored, and the result has none.
    """
    found, belong, failed = [], [], []
    for rule_id, rule in rules.items():
        def outcome(rule_id=rule_id, rule=rule):
            out = _tried(rule_id, rule, rows, failed)
            if isinstance(out, RuleOutput) and members:
                return _once(out.detections), out.members.select("detection_id", "event_id")
            if out is None:
                return (_nothing(rows, DETECTION_DDL),)
            return (_once(out.detections if isinstance(out, RuleOutput) else out),)
        told, *those = finished(outcome)
        found.append(told)
        belong += those
    # a fingerprint names its rule, so only rules that speak under one name can repeat each other's
    names = [r.rule_id for told in found for r in told.select("rule_id").distinct().collect()]
    return _united(rows, found, belong, failed, alone=len(set(names)) == len(names))


def _once(dets: DataFrame) -> DataFrame:
    return dets.select(*DETECTION_COLUMNS).dropDuplicates(["fingerprint"])


def _tried(rule_id: str, rule: Rule, rows: DataFrame, failed: list) -> DataFrame | RuleOutput | None:
    try:
        return rule(rows)
    except Exception as error:  # noqa: BLE001
        if not _is_rules_own(error):
            raise
        log.exception("rule failed: %s", rule_id)
        failed.append((rule_id, f"{type(error).__name__}: {error}"))
        return None


def _nothing(rows: DataFrame, columns: str) -> DataFrame:
    return rows.sparkSession.createDataFrame([], ddl(columns))


def _united(rows: DataFrame, found: list, members: list, failed: list, alone: bool) -> RuleSetOutput:
    """One table of each kind. `alone`: no two rules found the same."""
    unite = lambda frames: reduce(DataFrame.unionByName, frames)
    dets = unite(found or [_nothing(rows, DETECTION_DDL)])
    return RuleSetOutput(dets if alone else dets.dropDuplicates(["fingerprint"]),
                         unite(members or [_nothing(rows, "detection_id string, event_id string")]),
                         rows.sparkSession.createDataFrame(failed, FAILED_DDL))
