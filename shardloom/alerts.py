"""Alerts: a query, a condition on its result, and what is known of it so far."""

from __future__ import annotations

import json
import logging
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from .engine import Engine
from .errors import AlertError, AlertNotFound, CheckError, ShardloomError

log = logging.getLogger(__name__)

_COMPARE = {
    "greater_than": lambda a, b: a > b,
    "less_than": lambda a, b: a < b,
    "greater_or_equal": lambda a, b: a >= b,
    "less_or_equal": lambda a, b: a <= b,
}


@dataclass(frozen=True)
class Condition:
    """``kind``: one of the above, equals, not_equals, row_count_greater_than, no_results or has_results."""

    kind: str
    column: str | None = None
    value: object = None


@dataclass(frozen=True)
class Alert:
    id: str
    query: str
    condition: Condition
    name: str = ""
    interval_ms: int = 60_000
    enabled: bool = True


@dataclass
class AlertState:
    firing: bool = False
    last_checked: int | None = None
    last_triggered: int | None = None
    consecutive_fires: int = 0
    last_error: str | None = None


Notifier = Callable[[Alert, str], None]


def log_notifier(alert: Alert, message: str) -> None:
    log.warning("alert %s: %s", alert.id, message)


def webhook_notifier(url: str, timeout_s: float = 10.0) -> Notifier:
    """Posts the alert as JSON."""

    def notify(alert: Alert, message: str) -> None:
        body = json.dumps({"alert_id": alert.id, "name": alert.name, "message": message}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout_s) as answer:
            answer.read()

    return notify


def _same(a: object, b: object) -> bool:
    """Numbers by value, whatever their type; a boolean is not a number."""
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    return a == b


def evaluate(condition: Condition, df: DataFrame) -> tuple[bool, str]:
    """Whether the condition holds for a result, and why. Reads no more rows than it needs."""
    kind = condition.kind
    if kind in ("no_results", "has_results"):
        empty = df.isEmpty()
        return empty == (kind == "no_results"), "Query returned no results" if empty else "Query returned rows"
    if kind == "row_count_greater_than":
        n = df.count()
        return n > condition.value, f"Row count {n}, threshold {condition.value}"
    if condition.column not in df.columns:
        raise CheckError(f"no column {condition.column!r}")
    row = df.first()
    if row is None:
        raise CheckError("Query returned no rows")
    value = row[condition.column]
    if kind in ("equals", "not_equals"):
        return _same(value, condition.value) == (kind == "equals"), f"{condition.column} = {value!r}, compared with {condition.value!r}"
    if kind not in _COMPARE:
        raise CheckError(f"unknown condition {kind!r}")
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise CheckError(f"{condition.column} is not a number: {value!r}")
    return _COMPARE[kind](value, condition.value), f"{condition.column} = {value}, threshold {condition.value}"


@dataclass
class AlertChecker:
    """Holds alerts and checks those that are due; ``run_once`` is for a scheduler to call."""

    engine: Engine
    notifiers: list[Notifier] = field(default_factory=lambda: [log_notifier])
    alerts: dict[str, Alert] = field(default_factory=dict)
    states: dict[str, AlertState] = field(default_factory=dict)

    def add(self, alert: Alert) -> None:
        if not alert.id or not alert.query.strip():
            raise AlertError("an alert needs an id and a query")
        if alert.id in self.alerts:
            raise AlertError(f"alert {alert.id} exists")
        self.alerts[alert.id], self.states[alert.id] = alert, AlertState()

    def get(self, alert_id: str) -> tuple[Alert, AlertState]:
        if alert_id not in self.alerts:
            raise AlertNotFound(alert_id)
        return self.alerts[alert_id], self.states[alert_id]

    def list(self) -> list[tuple[Alert, AlertState]]:
        return [(a, self.states[i]) for i, a in sorted(self.alerts.items())]

    def update(self, alert: Alert) -> None:
        self.get(alert.id)
        self.alerts[alert.id] = alert

    def remove(self, alert_id: str) -> None:
        self.get(alert_id)
        del self.alerts[alert_id], self.states[alert_id]

    def enable(self, alert_id: str, enabled: bool = True) -> None:
        self.alerts[alert_id] = replace(self.get(alert_id)[0], enabled=enabled)

    def is_due(self, alert_id: str, now_ms: int) -> bool:
        alert, state = self.get(alert_id)
        return alert.enabled and (state.last_checked is None or now_ms - state.last_checked >= alert.interval_ms)

    def check(self, alert_id: str, now_ms: int | None = None) -> AlertState:
        """Run the query and update the state; an error leaves ``firing`` as it was."""
        alert, state = self.get(alert_id)
        now = self.engine.now_ms() if now_ms is None else now_ms
        state.last_checked = now
        try:
            holds, why = evaluate(alert.condition, self.engine.sql(alert.query))
        except ShardloomError as e:
            state.last_error = str(e)
            return state
        state.last_error, state.firing = None, holds
        state.consecutive_fires = state.consecutive_fires + 1 if holds else 0
        if holds:
            state.last_triggered = now
            for notify in self.notifiers:
                try:
                    notify(alert, why)
                except Exception as e:  # a notifier's failure is not the alert's
                    log.error("notifier of alert %s failed: %s", alert.id, e)
        return state

    def run_once(self, now_ms: int | None = None) -> list[str]:
        """Check what is due; the ids of those that fire."""
        now = self.engine.now_ms() if now_ms is None else now_ms
        due = [i for i in sorted(self.alerts) if self.is_due(i, now)]
        return [i for i in due if self.check(i, now).firing]
