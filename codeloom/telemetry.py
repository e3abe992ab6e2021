"""Tracing of functions; does nothing where OpenTelemetry is missing."""

from __future__ import annotations

import functools
from collections.abc import Callable

try:
    from opentelemetry import trace
except ImportError:
    trace = None


def instrument(name: str) -> Callable:
    """Run a function inside a span of that name; an exception is recorded and raised on."""

    def wrap(f: Callable) -> Callable:
        if trace is None:
            return f

        @functools.wraps(f)
        def run(*args, **kwargs):
            with trace.get_tracer("codeloom").start_as_current_span(name) as span:
                try:
                    return f(*args, **kwargs)
                except Exception as e:
                    span.record_exception(e)
                    raise

        return run

    return wrap
