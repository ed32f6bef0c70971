"""Settings of the engine. Each can be set by an environment variable of the same name in capitals."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Times in milliseconds unless the name says otherwise. Names and defaults are fixed values: the environment surface."""

    future_limit_ms: int = 3_600_000
    past_limit_ms: int = 3_600_000
    heartbeat_window_seconds: int = 300
    max_occupancy_window_ms: int = 3_600_000
    retention_grace_ms: int = 300_000
    dedup_window_ms: int = 1000
    dedup_seq_slack: int = 2
    #: Interval of triggers (pipeline.start), most bytes of a micro-batch (pipeline.read_raw), between snapshots
    #: (snapshots.advance_if_due), and after which a stream that reports nothing is not ready (progress.readiness).
    fsync_ms: int = 200
    wal_segment_bytes: int = 64 << 20
    snapshot_ms: int = 10_000
    report_ms: int = 30_000
    page_limit: int = 200_000
    page_limit_max: int = 1_000_000
    #: Where pipeline.start keeps its tables.
    data_dir: str = "data"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        """Values that are empty or of the wrong kind leave the default."""
        env, found = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = env.get(f.name.upper(), "")
            if not raw:
                continue
            if isinstance(f.default, int):
                try:
                    found[f.name] = int(raw)
                except ValueError:
                    continue
            else:
                found[f.name] = raw
        return cls(**found)


DEFAULT = Config()
