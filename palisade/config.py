"""Thresholds, windows and weights. Every operator takes one of these."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE


@dataclass(frozen=True)
class ProcessPattern:
    pattern_id: str
    processes: tuple = ()
    parents: tuple = ()
    command_tokens: tuple = ()
    confidence: float = 0.8
    description: str = ""


# Default suspicious-process patterns and parent/child pairs.
PROCESS_PATTERNS = (
    ProcessPattern(
        "P1-shell-from-service",
        processes=("powershell.exe", "pwsh.exe", "cmd.exe"),
        parents=("services.exe", "svchost.exe", "wmiprvse.exe"),
        confidence=0.75,
        description="interactive shell spawned by a service host process",
    ),
    ProcessPattern(
        "P2-encoded-indicator",
        command_tokens=("-encodedcommand", "-enc ", "frombase64string"),
        confidence=0.85,
        description="encoded-command indicator in command-line telemetry",
    ),
)
PARENT_CHILD_PAIRS = (
    ("services.exe", "powershell.exe"),
    ("services.exe", "cmd.exe"),
    ("svchost.exe", "powershell.exe"),
    ("svchost.exe", "cmd.exe"),
    ("winword.exe", "powershell.exe"),
    ("excel.exe", "powershell.exe"),
)


@dataclass(frozen=True)
class DetectConfig:
    brute_min_fails: int = 3
    brute_window_minutes: int = 10
    day_start_hour: int = 8
    day_end_hour: int = 20
    new_ip_min_history: int = 3
    dns_threshold: int = 100
    dns_window_minutes: int = 5
    bytes_threshold: int = 1_000_000_000
    process_patterns: tuple = PROCESS_PATTERNS
    parent_child_pairs: tuple = PARENT_CHILD_PAIRS
    # Width of the time slices that split a hot key when rows are numbered.
    slice_minutes: int = 30
    # Rows of one key handled together by the reset-after-firing step.
    chunk_rows: int = 65_536


@dataclass(frozen=True)
class FlowConfig:
    rate_window_seconds: int = 60
    rate_min_count: int = 50
    rate_baseline_factor: float = 5.0
    rate_baseline_windows: int = 10
    brute_window_minutes: int = 5
    brute_min_flows: int = 20
    brute_max_bytes: int = 10_240
    scan_window_minutes: int = 5
    scan_min_ports: int = 15
    scan_density_seconds: int = 60
    scan_probe_fraction: float = 0.5
    scan_entropy_bits: float = 4.0
    byte_window_seconds: int = 60
    byte_baseline_minutes: int = 30
    byte_min_history: int = 5
    byte_ratio: float = 8.0
    byte_floor: float = 1_000_000.0
    byte_min_flows: int = 5
    novelty_min_flows: int = 5
    novelty_min_peak: int = 50
    ephemeral_ports: tuple = (49_152, 65_535)
    burst_window_seconds: int = 30
    burst_min_flows: int = 500
    burst_min_pps: float = 50_000.0
    slice_minutes: int = 30
    chunk_rows: int = 65_536


@dataclass(frozen=True)
class CorrelateConfig:
    window_minutes: int = 30
    network_window_minutes: int = 30
    # Rule pairs that mark an attack sequence (unordered).
    sequence_pairs: tuple = (
        ("AUTH-001", "PROC-001"), ("AUTH-001", "PROC-002"), ("AUTH-001", "NET-001"),
        ("PROC-001", "NET-001"), ("PROC-002", "NET-001"), ("PROC-001", "DATA-001"),
        ("PROC-002", "DATA-001"), ("NET-001", "DATA-001"), ("AUTH-001", "DATA-001"),
    )
    flow_sequence_pairs: tuple = (("FLOW-003", "FLOW-002"), ("FLOW-001", "FLOW-006"))
    w_user: float = 0.20
    w_host: float = 0.15
    w_time: float = 0.20
    w_shared: float = 0.25
    w_sequence: float = 0.15
    w_multi_rule: float = 0.05


@dataclass(frozen=True)
class RiskConfig:
    # Points per risk factor and their caps.
    severity_points: tuple = (("LOW", 10), ("MEDIUM", 25), ("HIGH", 45), ("CRITICAL", 60))
    per_rule: int = 8
    rule_cap: int = 24
    evidence_cap: int = 10
    ioc: int = 12
    process: int = 8
    transfer_min: int = 5
    transfer_step: int = 2
    transfer_max: int = 12
    chain3: int = 10
    chain4: int = 15
    per_tactic: int = 3
    tactic_cap: int = 12
    bands: tuple = ((24, "LOW"), (49, "MEDIUM"), (79, "HIGH"), (100, "CRITICAL"))


@dataclass(frozen=True)
class UebaConfig:
    window_hours: int = 1
    day_start_hour: int = 8
    day_end_hour: int = 20
    min_history_windows: int = 5
    min_history_events: int = 10
    seed: int = 42
    trees: int = 200
    tree_rows: int = 256
    contamination: float = 0.05
    model_version: str = "ueba-iforest-v1"
    feature_version: str = "ueba-features-v1"


UEBA_FEATURES = (
    "event_count", "auth_event_count", "failed_auth_count", "successful_auth_count",
    "failed_auth_ratio", "unique_source_ip_count", "new_source_ip_count",
    "unique_destination_count", "dns_event_count", "outbound_bytes_log1p",
    "process_event_count", "unusual_hour_event_count",
)
