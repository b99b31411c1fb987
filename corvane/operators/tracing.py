"""Traces: observations of a run, collected in context and appended to the audit table, redacted and sampled."""

from __future__ import annotations

import contextvars
import hashlib
import json
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import wraps

from ..schemas import AUDIT
from . import audit

_CURRENT: contextvars.ContextVar[tuple[str, str | None, bool]] = contextvars.ContextVar("corvane_trace", default=("", None, False))


@dataclass(frozen=True)
class TracingStatus:
    enabled: bool
    reason: str


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False, default=str)


@dataclass
class Tracer:
    """Rows of ``schemas.AUDIT``. Disabled without a flag or a table, which ``status`` explains. A trace is sampled by a hash of its id, as a
    whole; personal data is replaced when rows are written. ``flush`` appends what was collected; a long run flushes by itself
    every ``most`` rows."""

    tables: object | None = None
    enabled: bool = False
    rate: float = 1.0
    url: str = ""
    most: int = 10_000
    rows: list[tuple] = field(default_factory=list)
    lock: threading.Lock = field(default_factory=threading.Lock)

    @property
    def status(self) -> TracingStatus:
        if not self.enabled:
            return TracingStatus(False, "tracing is switched off")
        return TracingStatus(True, "on") if self.tables is not None else TracingStatus(False, "no tables to write to")

    def _sampled(self, trace_id: str) -> bool:
        return int(hashlib.sha256(trace_id.encode()).hexdigest()[:8], 16) < self.rate * 2**32

    @contextmanager
    def trace(self, name: str, session: str | None = None, **metadata: object) -> Iterator[str]:
        """A new trace, current within the block; its session and metadata go with its first row."""
        trace_id = uuid.uuid4().hex
        on = self.status.enabled and self._sampled(trace_id)
        token = _CURRENT.set((trace_id, None, on))
        try:
            self._add(name, "trace", None, None, {"session": session, **metadata}, None)
            yield trace_id
        finally:
            _CURRENT.reset(token)

    @contextmanager
    def span(self, name: str, kind: str = "span", given: object = None, **metadata: object) -> Iterator[dict]:
        """An observation; what the block puts into the dictionary it gets (output, cost_usd, further metadata) is recorded with
        it, and observations made within name it as their parent. An error is recorded and raised again."""
        trace_id, parent, on = _CURRENT.get()
        token = _CURRENT.set((trace_id, name, on))
        found: dict = {}
        try:
            yield found
        except Exception as e:
            found["error"] = f"{type(e).__name__}: {e}"
            raise
        finally:
            _CURRENT.reset(token)
            output, cost = found.pop("output", None), found.pop("cost_usd", None)
            self._add(name, kind, given, output, {**metadata, **found}, cost, parent)

    def record_span(self, name: str, given: object = None, output: object = None, **metadata: object) -> None:
        self._add(name, "span", given, output, metadata, None)

    def record_generation(self, name: str, model: str, given: object, output: object, cost_usd: float = 0.0, **usage: object) -> None:
        self._add(name, "generation", given, output, {"model": model, **usage}, cost_usd)

    def record_score(self, name: str, value: float, trace_id: str | None = None) -> None:
        own, _, on = _CURRENT.get()
        if trace_id is None and not on:
            return
        self._row(trace_id or own, None, name, "score", None, _text(float(value)), {}, None)

    def _add(self, name: str, kind: str, given: object, output: object, metadata: dict, cost: float | None, parent: str | None = None) -> None:
        trace_id, current, on = _CURRENT.get()
        if on and trace_id:
            self._row(trace_id, parent if parent is not None else current, name, kind, _text(given), _text(output), {k: str(_text(v)) for k, v in metadata.items() if v is not None}, cost)

    def _row(self, *row: object) -> None:
        if not self.status.enabled:
            return
        with self.lock:
            self.rows.append(row)
            full = len(self.rows) >= self.most
        if full:
            self.flush()

    def flush(self) -> int:
        """Appends the collected rows; their number."""
        with self.lock:
            rows, self.rows = self.rows, []
        if rows and self.tables is not None:
            self.tables.append("audit", audit.observations(self.tables.spark.createDataFrame(rows, AUDIT)))
        return len(rows)

    def current_trace_id(self) -> str | None:
        trace_id, _, on = _CURRENT.get()
        return trace_id if on and trace_id else None

    def trace_url(self) -> str | None:
        own = self.current_trace_id()
        return f"{self.url.rstrip('/')}/{own}" if own and self.url else None

    def observed(self, name: str, kind: str = "span") -> Callable:
        """A function whose calls are observations."""

        def around(f: Callable) -> Callable:
            @wraps(f)
            def run(*a: object, **b: object) -> object:
                with self.span(name, kind, {"arguments": [*a, b] if b else list(a)}) as found:
                    found["output"] = out = f(*a, **b)
                    return out

            return run

        return around


def in_current_trace(f: Callable) -> Callable:
    """``f`` for another thread, in the trace of the one that calls this."""
    context = contextvars.copy_context()
    return lambda *a, **b: context.copy().run(f, *a, **b)
