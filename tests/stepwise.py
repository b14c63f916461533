"""Alert states stepped one input after the other in plain Python, to check the library against."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta


@dataclass(frozen=True)
class State:
    status: str
    start: datetime
    seen: datetime
    value: float
    until: datetime | None = None


def evaluate(state, holds, now, value):
    """State and emitted status after an evaluation."""
    if holds:
        if state is None:
            return State("Active", now, now, value), "Triggered"
        state = replace(state, seen=now, value=value)
        if state.status == "Snoozed" and state.until is not None and state.until < now:
            return replace(state, status="Active", until=None), "Triggered"
        return state, None
    if state is not None and state.status in ("Active", "Snoozed"):
        return None, "Resolved"
    return state, None


def command(state, action, now, minutes):
    if state is None:
        return None
    if action == "SNOOZE":
        return replace(state, status="Snoozed", until=now + timedelta(minutes=minutes))
    return replace(state, status="Disabled", until=None)


def fold(inputs, state=None):
    """``inputs`` in order: (time, 'eval', holds, value) or (time, action, minutes)."""
    emitted = []
    for item in inputs:
        if item[1] == "eval":
            state, status = evaluate(state, item[2], item[0], item[3])
            if status:
                emitted.append((item[0], status, item[3] if status == "Triggered" else None))
        else:
            state = command(state, item[1], item[0], item[2])
    return emitted, state
