"""Latency statistics of values that are tiny, not finite, or close together."""

from __future__ import annotations

import math
import random
from datetime import datetime

import pytest

from daytrail.plans import reports

NOW = datetime(2026, 4, 26, 10)


def stats(spark, groups):
    rows = [(g, v, NOW) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE, t TIMESTAMP_NTZ")
    return {r.group_key: r for r in reports.latency_stats(df, "v", "t", "g").collect()}


def test_tiny_and_not_finite(spark):
    got = stats(spark, {"tiny": [3e-7, 4e-7], "inf": [1.0, math.inf, -math.inf, 2.0, 3.0], "up": [1.0, math.inf], "nan": [1.0, math.nan]})
    assert got["tiny"].avg_value == pytest.approx(3.5e-7, rel=1e-12) and got["tiny"].p50 == 4e-7
    assert (got["inf"].p50, got["inf"].p99, got["inf"].max_value) == (2.0, math.inf, math.inf) and math.isnan(got["inf"].avg_value)
    assert got["up"].avg_value == math.inf and math.isnan(got["nan"].p99) and got["nan"].operations == 2


def test_close_values_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(reports, "_CELL_VALUES", 20)
    cells, narrowed = [], reports._narrowed

    def seen(*args):
        values, wanted = narrowed(*args)
        cells.append(max(r["count"] for r in values.groupBy("group_key", "_band", "_cell").count().collect()))
        return values, wanted

    monkeypatch.setattr(reports, "_narrowed", seen)
    r = random.Random(1)
    groups = {"a": [5 + r.random() * 1e-4 for _ in range(3000)], "b": [-5 - r.random() ** 9 * 1e-9 for _ in range(3000)], "c": [7.0] * 500}
    got = stats(spark, groups)
    for g, values in groups.items():
        ordered = sorted(values)
        assert (got[g].p50, got[g].p95, got[g].p99) == tuple(ordered[int(len(values) * p)] for p in (0.5, 0.95, 0.99))
    assert cells[0] <= 20
