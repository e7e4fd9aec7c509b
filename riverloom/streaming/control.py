"""Retries, circuit breaker, schedules, and alerts from a query's progress."""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql.streaming import StreamingQueryListener

from riverloom.functions.predicates import ConfigError
from riverloom.operators.outcome import retryable


def with_retry(call: Callable, *, attempts: int = 3, first: float = 1.0, most: float = 30.0, jitter: float = 0.25, pause: Callable[[float], None] = time.sleep, seed: int | None = None):
    """Calls again after pauses that double, plus up to a quarter at random, while the error may pass by itself."""
    rng = random.Random(seed)
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n + 1 == attempts or not retryable(e):
                raise
            wait = min(most, first * 2**n)
            pause(min(most, wait + wait * jitter * rng.random()))
    return None


@dataclass
class Breaker:
    """Opens after ``failures`` within ``window`` seconds, tries one call after ``rest`` seconds, closes when it succeeds."""

    failures: int = 5
    window: float = 60.0
    rest: float = 30.0
    clock: Callable[[], float] = time.monotonic
    _seen: deque = field(default_factory=deque)
    _opened: float | None = None
    _trying: bool = False

    @property
    def state(self) -> str:
        if self._opened is None:
            return "closed"
        return "half-open" if self._trying or self.clock() - self._opened >= self.rest else "open"

    def allow(self) -> bool:
        if self.state == "open" or self._trying:
            return False
        self._trying = self.state == "half-open"
        return True

    def success(self) -> None:
        self._seen.clear()
        self._opened, self._trying = None, False

    def failure(self) -> None:
        now = self.clock()
        self._seen.append(now)
        while self._seen and now - self._seen[0] > self.window:
            self._seen.popleft()
        if self._trying or len(self._seen) >= self.failures:
            self._opened, self._trying = now, False


@dataclass
class AlertRule:
    """A measure of a batch (rows, lag_seconds, error_rate, idle_seconds) beyond a threshold."""

    name: str
    measure: str
    threshold: float
    below: bool = False

    def holds(self, measures: dict[str, float]) -> bool:
        v = measures.get(self.measure)
        return v is not None and (v < self.threshold if self.below else v > self.threshold)


class Alerts(StreamingQueryListener):
    """Tests rules on every progress of a query and hands what holds to a function."""

    def __init__(self, rules: list[AlertRule], tell: Callable[[str, dict], None], clock: Callable[[], float] = time.time):
        self.rules, self.tell, self.clock = rules, tell, clock
        self.last_rows = clock()

    def measures(self, progress) -> dict[str, float]:
        now = self.clock()
        rows = progress.numInputRows
        if rows:
            self.last_rows = now
        out = {"rows": float(rows), "idle_seconds": now - self.last_rows}
        if newest := (progress.eventTime or {}).get("max"):
            out["lag_seconds"] = now - datetime.fromisoformat(newest.replace("Z", "+00:00")).timestamp()
        observed = {k: v.asDict() for k, v in (progress.observedMetrics or {}).items()}
        bad = sum(m.get("errors", 0) for m in observed.values())
        if rows:
            out["error_rate"] = bad / rows
        return out

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        found = self.measures(event.progress)
        for r in self.rules:
            if r.holds(found):
                self.tell(r.name, found)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def next_run(schedule: dict, after: datetime) -> datetime | None:
    """When a pipeline runs next: once and dependency have no time of their own, periodic adds, cron matches minutes."""
    kind = schedule.get("type", "once")
    if kind in ("once", "dependency", "streaming"):
        return None
    if kind == "periodic":
        return after + timedelta(seconds=float(schedule.get("interval_sec", 60)))
    if kind != "cron":
        raise ConfigError(f"no schedule {kind!r}")
    fields = schedule["cron"].split()
    if len(fields) != 5:
        raise ConfigError("cron has five fields")
    minute, hour, day, month, weekday = fields
    minutes = [m for m in range(60) if _fits(minute, m)]
    hours = [h for h in range(24) if _fits(hour, h)]
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for n in range(29 * 366):  # 29 February on a weekday comes again within 28 years, but for turns of centuries
        date = at.date() + timedelta(days=n)
        if not (_fits(day, date.day) and _fits(month, date.month) and _fits(weekday, date.isoweekday() % 7)):
            continue
        for h in hours:
            for m in minutes:
                found = at.replace(year=date.year, month=date.month, day=date.day, hour=h, minute=m)
                if found >= at:
                    return found
    return None


def _fits(text: str, value: int) -> bool:
    for part in text.split(","):
        span, _, step = part.partition("/")
        low, _, high = span.partition("-")
        first = 0 if low == "*" else int(low)
        last = 10**6 if low == "*" or step and not high else int(high or low)
        if first <= value <= last and (value - first) % int(step or 1) == 0:
            return True
    return False


def trigger(options: dict) -> dict:
    """A trigger for the schedule and flush interval of a pipeline."""
    kind = options.get("schedule", "once")
    kind = kind.get("type", "once") if isinstance(kind, dict) else kind
    if kind == "streaming":
        return {"processingTime": f"{int(options.get('flush_interval_ms', 1000))} milliseconds"}
    return {"availableNow": True}


def rate_options(config: dict, source: str) -> dict[str, str]:
    """A rate limit as the option of a streaming source, for a trigger a second."""
    rps = int(config.get("rps", 1000))
    kinds = {"file": {"maxFilesPerTrigger": str(max(1, rps // 1000))}, "kafka": {"maxOffsetsPerTrigger": str(rps)}, "demo": {"rowsPerSecond": str(rps)}}
    return kinds.get(source, {})
