"""Which jobs are due, and running them so that one failure does not stop the others."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

ROTATION_SECONDS, GATE_MINUTES = 900, 20


def due_source(moment: datetime, names: list[str]) -> str | None:
    """The one of names whose turn it is in this quarter of an hour."""
    return names[math.floor(moment.timestamp() / ROTATION_SECONDS) % len(names)] if names else None


def gate_open(moment: datetime, hour: int) -> bool:
    """In the first minutes of an hour of the day, UTC."""
    at = moment.astimezone(UTC)
    return at.hour == hour and at.minute < GATE_MINUTES


@dataclass
class Report:
    done: dict[str, object] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)


def run_all(required: dict[str, Callable[[], object]], optional: dict[str, Callable[[], object]]) -> Report:
    """Run required jobs, whose failures end the run, then optional ones, whose failures are reported."""
    report = Report()
    for name, job in required.items():
        report.done[name] = job()
    for name, job in optional.items():
        try:
            report.done[name] = job()
        except Exception as e:  # noqa: BLE001  any failure of an optional source is only reported
            report.failed[name] = str(e)
    return report


def until_short(batch: Callable[[], int], size: int, most: int = 1000) -> int:
    """Repeat a batch job until it does less than a whole batch; the sum of what it did. Beyond `most` batches it raises."""
    total = 0
    for _ in range(most):
        n = batch()
        total += n
        if n < size:
            return total
    raise RuntimeError(f"not done after {most} batches, which did {total}")
