"""Exponential means over several blocks, against the recursion."""

import random

import pytest

from barspark.functions.rolling import block_rows, ewm


@pytest.mark.parametrize("alpha", [0.2, 2 / 13, 1 / 14])
def test_ewm(spark, alpha):
    rng = random.Random(3)
    assert block_rows(0.8) == 1443
    n = 3 * block_rows(1 - alpha) + 17
    rows = [(k, i, i, None if i < 5 * k else rng.gauss(100, 30)) for k in range(2) for i in range(n)]
    bars = spark.createDataFrame(rows, "instrument long, ts long, i long, x double")
    got = {(r.instrument, r.i): r.y for r in ewm(bars, "x", alpha, "y", 3).collect()}
    y, seen = None, 0
    for k, i, _, x in rows:
        if i == 0:
            y, seen = None, 0
        if x is not None:
            y, seen = x if y is None else (1 - alpha) * y + alpha * x, seen + 1
        if seen < 3:
            assert got[k, i] is None
        else:
            assert got[k, i] == pytest.approx(y, rel=1e-11)
