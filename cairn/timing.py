"""Timing: warm-up, repeated calls, nearest-rank percentiles, and a sink of results."""

from __future__ import annotations

import csv
import json
import math
import os
import platform
import time
from collections.abc import Callable

import pyspark


def percentile(values: list[float], p: float) -> float:
    """The nearest-rank percentile of a non-empty list."""
    s = sorted(values)
    return s[min(len(s) - 1, max(0, math.ceil(p / 100 * len(s)) - 1))]


def summary(seconds: list[float]) -> dict:
    """Count, mean and percentiles in milliseconds, and calls a second."""
    if not seconds:
        return {"n": 0}
    ms = [1000 * x for x in seconds]
    return {"n": len(ms), "mean": round(sum(ms) / len(ms), 3)} | {f"p{p:g}": round(percentile(ms, p), 3) for p in (50, 95, 99)} | {"per_second": round(len(ms) / max(sum(seconds), 1e-12), 3)}


def measure(call: Callable[[], object], times: int, warm: int = 1) -> dict:
    """Summary of ``times`` calls after ``warm`` ones that don't count."""
    for _ in range(warm):
        call()
    took = []
    for _ in range(times):
        began = time.perf_counter()
        call()
        took.append(time.perf_counter() - began)
    return summary(took)


def write(path: str, rows: list[dict]) -> None:
    """Rows as CSV under the union of their names, and the environment in a JSON file beside it."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    with open(path, "w", newline="") as f:
        out = csv.DictWriter(f, names, restval="")
        out.writeheader()
        out.writerows(rows)
    with open(os.path.splitext(path)[0] + ".env.json", "w") as f:
        json.dump({"python": platform.python_version(), "system": platform.platform(), "cpus": os.cpu_count(), "pyspark": pyspark.__version__}, f, indent=1)
