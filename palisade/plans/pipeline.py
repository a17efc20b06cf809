"""End-to-end jobs: telemetry to detections to enriched incidents."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame

from palisade.config import CorrelateConfig, DetectConfig, FlowConfig, RiskConfig
from palisade.functions.state import checkpointed, finished
from palisade.operators.correlate import correlate
from palisade.operators.detect import RuleSetOutput, endpoint_rules, flow_rules, run_rules, store_rules
from palisade.operators.endpoint import prepare_events
from palisade.operators.risk import enrich


class Outcome:
    """What a job finds. Each part is made once, when it is first asked for: who only wants detections
    neither stores bucket members nor links. `run` gives the rules' stored results, with members if told so."""

    def __init__(self, run: Callable[[bool], RuleSetOutput], events: DataFrame | None, techniques: DataFrame,
                 link: CorrelateConfig, risk: RiskConfig):
        self._run, self._events, self._techniques, self._link, self._risk = run, events, techniques, link, risk

    @cached_property
    def _found(self) -> RuleSetOutput:
        return self._whole if "_whole" in vars(self) else self._run(False)

    @cached_property
    def _whole(self) -> RuleSetOutput:
        return self._run(True)

    @property
    def failed(self) -> DataFrame:
        """rule_id, error"""
        return self._found.failed

    @property
    def detections(self) -> DataFrame:
        return self._found.detections

    @cached_property
    def members(self) -> DataFrame:
        """(detection_id, event_id). A rule puts an event in one bucket, so rows are distinct where events are, without
        a shuffle. The rules run once for these and detections, if these are asked for first."""
        return self._whole.members

    @cached_property
    def incidents(self) -> DataFrame:
        members, dets = self.members, self.detections
        linked = lambda: (correlate(dets, members, self._events, self._link, unique=True),)
        return finished(lambda: (enrich(*finished(linked), dets, self._techniques, self._risk),))[0]


def endpoint_incidents(
    events: DataFrame, iocs: DataFrame, techniques: DataFrame,
    detect: DetectConfig = DetectConfig(), link: CorrelateConfig = CorrelateConfig(),
    risk: RiskConfig = RiskConfig(),
) -> Outcome:
    """Endpoint telemetry -> detections -> enriched incidents."""
    out = run_rules(prepare_events(events), endpoint_rules(iocs, detect))
    kept = out._replace(detections=checkpointed(out.detections))
    return Outcome(lambda _: kept, events, techniques, link, risk)


def flow_incidents(
    flows: DataFrame, techniques: DataFrame, detect: FlowConfig = FlowConfig(),
    link: CorrelateConfig = CorrelateConfig(), risk: RiskConfig = RiskConfig(),
    rules: tuple[str, ...] | None = None,
) -> Outcome:
    """Network flows -> detections -> enriched incidents."""
    chosen = {k: r for k, r in flow_rules(detect).items() if rules is None or k in rules}
    return Outcome(lambda members: store_rules(flows, chosen, members), None, techniques, link, risk)
