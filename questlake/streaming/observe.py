"""Measurements of running streams; what wasn't measured is reported as missing with the reason."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from typing import Any


def nearest_rank(values: Sequence[float], p: float) -> float | None:
    """The ceil(p·n)-th smallest value."""
    s = sorted(values)
    return s[max(0, math.ceil(p * len(s)) - 1)] if s else None


def missing(reason: str) -> dict[str, Any]:
    return {"value": None, "missing": reason}


def _progress(query) -> list[dict]:
    return [json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else dict(p) for p in query.recentProgress]


def batch_durations(progress: list[dict]) -> dict[str, Any]:
    """Count, average, upper median, p95 and extremes of completed micro-batches in ms."""
    ms = sorted(p["durationMs"]["triggerExecution"] for p in progress if p.get("durationMs", {}).get("triggerExecution") is not None)
    if not ms:
        return missing("no completed batch")
    return {"n": len(ms), "avg": sum(ms) / len(ms), "p50": ms[len(ms) // 2], "p95": nearest_rank(ms, 0.95), "min": ms[0], "max": ms[-1]}


def throughput(progress: list[dict]) -> dict[str, Any]:
    """Rows per second at the source, not summed over operators."""
    rates = [p["processedRowsPerSecond"] for p in progress if p.get("numInputRows") and p.get("processedRowsPerSecond") is not None]
    return {"avg": sum(rates) / len(rates), "max": max(rates)} if rates else missing("no batch with input")


def pressure(progress: list[dict], trigger_ms: float) -> dict[str, Any]:
    """Share of the trigger interval that batches take: ok up to 0.5, low up to 1, high beyond."""
    ms = [p["durationMs"]["triggerExecution"] for p in progress if p.get("durationMs", {}).get("triggerExecution") is not None]
    if not ms:
        return missing("no completed batch")
    share = sum(ms) / len(ms) / trigger_ms
    return {"ratio": share, "level": "ok" if share <= 0.5 else "low" if share <= 1 else "high"}


def source_lag(progress: list[dict]) -> dict[str, Any]:
    """Log end less the offset read, per topic partition, where the source tells both."""
    for p in reversed(progress):
        for s in p.get("sources", []):
            end, latest = s.get("endOffset"), s.get("latestOffset")
            if isinstance(end, dict) and isinstance(latest, dict):
                return {f"{t}-{k}": latest[t][k] - end.get(t, {}).get(k, 0) for t in latest for k in latest[t]}
    return missing("the source reports no offsets")


def report(query, trigger_ms: float = 1000.0) -> dict[str, Any]:
    progress = _progress(query)
    return {"batches": batch_durations(progress), "throughput": throughput(progress), "pressure": pressure(progress, trigger_ms), "lag": source_lag(progress)}
