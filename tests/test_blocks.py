"""Block work, searches ahead, ranks, quantiles, chains, the W search and its ladders against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.functions import blocks
from barspark.functions.quantiles import exact_quantiles
from barspark.operators import events as ev
from barspark.operators import indicators as ind
from barspark.operators import measure, points, structure
from barspark.operators import w_patterns as wp


def walk(n, seed, name="a"):
    rng = random.Random(seed)
    price, rows = 100.0, []
    for i in range(n):
        start = price
        path = [start] + [(start := round(start + rng.choice([-1, -0.5, 0, 0.5, 1]) * rng.choice([1, 1, 3]), 2)) for _ in range(4)]
        price = path[-1]
        rows.append((name, i, path[0], max(path), min(path), path[-1], float(rng.randint(1, 50))))
    return rows


def frame(spark, *series):
    rows = [r for s in series for r in s]
    bars = spark.createDataFrame(rows, "instrument string, i long, open double, high double, low double, close double, volume double")
    return bars.withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("i") * 300)).repartition(3)


@pytest.fixture(scope="module")
def series():
    return walk(700, 1), walk(450, 2, "b")


@pytest.fixture(scope="module")
def bars(spark, series):
    return frame(spark, *series).cache()


def test_ahead_and_first_reach():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 100):
        x = rng.integers(0, 20, n).astype(float)
        start, price = rng.integers(0, n + 1, 200), rng.integers(-2, 23, 200).astype(float)
        for low in (False, True):
            ahead = blocks.Ahead(x, low)
            for strict in (False, True):
                beyond = lambda v, p: (v < p if strict else v <= p) if low else (v > p if strict else v >= p)  # noqa: B023, E731
                want = [next((k for k in range(s, n) if beyond(x[k], p)), n) for s, p in zip(start, price)]
                assert ahead.first(start, price, strict).tolist() == want
            end = np.minimum(start + rng.integers(0, 30, 200), n + 3)
            want = [(min if low else max)(x[s:e]) if len(x[s:e]) else np.nan for s, e in zip(start, end)]
            assert np.array_equal(ahead.extreme(start, end), np.array(want), equal_nan=True)
        inside = np.minimum(start, n - 1)
        tops = blocks.running(x, inside, 9, False)
        want = [next((k - s + 1 for k in range(s, min(n, s + 9)) if x[k] >= p), 0) for s, p in zip(inside, price)]
        assert blocks.first_reach(tops, price, False).tolist() == want


def test_ranks_in_windows():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, 300).astype(float)
    at = np.arange(300)
    start = np.maximum(0, at - 40)
    less, equal = blocks.ranks_in_windows(x, start, at + 1, at)
    assert less.tolist() == [int((x[s : k + 1] < x[k]).sum()) for s, k in zip(start, at)]
    assert equal.tolist() == [int((x[s : k + 1] == x[k]).sum()) for s, k in zip(start, at)]


def test_rolling_ranks_over_blocks(spark, bars, series, monkeypatch):
    monkeypatch.setattr(ind, "SIZE", 50)
    rows = bars.withColumn("x", F.when(F.col("i") % 7 > 0, F.col("volume")))
    got = {(r.instrument, r.i): r.rank for r in ind.rolling_ranks(rows, {"x": "rank"}, 90).select("instrument", "i", "rank").collect()}
    for s in series:
        x = [r[6] if r[1] % 7 else None for r in s]
        for i, v in enumerate(x):
            seen = [y for y in x[max(0, i - 89) : i + 1] if y is not None]
            want = None if v is None or len(seen) < 30 else (sum(y < v for y in seen) + 0.5 * sum(y == v for y in seen) + 0.5) / len(seen)
            assert got[s[0][0], i] == want


def test_first_beyond_over_blocks(spark, bars, series):
    asked = [(s[0][0], i, 100.0 + k, k > 0) for s in series for i in range(0, len(s), 13) for k in (-40, -9, -2, 2, 9, 60)]
    events = spark.createDataFrame(asked, "instrument string, i long, level double, up boolean")
    for strict in (False, True):
        got = {(r.instrument, r.i, r.level): (r.found_i, r.extreme) for r in blocks.first_beyond(events, bars, strict, 64).collect()}
        for name, i, level, up in asked:
            s = next(s for s in series if s[0][0] == name)
            ahead = [(r[1], r[3] if up else r[4]) for r in s[i + 1 :]]
            hit = lambda p: (p > level if strict else p >= level) if up else (p < level if strict else p <= level)  # noqa: B023, E731
            want = next((j for j, p in ahead if hit(p)), None), (max if up else min)([p for _, p in ahead], default=None)
            assert got[name, i, level] == want


def test_swings_and_gaps_over_blocks(bars, series, monkeypatch):
    whole = sorted(map(tuple, structure.swings(bars).drop("ts").collect()))
    gaps = sorted(map(tuple, structure.fair_value_gaps(bars, horizon=30).collect()), key=repr)
    assert whole and gaps
    monkeypatch.setattr(blocks.in_blocks, "__defaults__", (37,))
    assert sorted(map(tuple, structure.swings(bars).drop("ts").collect())) == whole
    assert sorted(map(tuple, structure.fair_value_gaps(bars, horizon=30).collect()), key=repr) == gaps
    for name, kind, i, price, available in whole:
        s = next(s for s in series if s[0][0] == name)
        x = [r[3] if kind == "high" else -r[4] for r in s]
        assert x[i] > max(x[i - 3 : i]) and x[i] >= max(x[i + 1 : i + 4]) and available == i + 3 and price == abs(x[i])


def plain_w(rows, unit, rule):
    """Candidates one low at a time."""
    h, lo, c, n, out = [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows], len(rows), []
    for f in range(rule.most_bars, n):
        if not (f + rule.strength < n - 2 and lo[f] < min(lo[f - rule.strength : f]) and lo[f] <= min(lo[f + 1 : f + rule.strength + 1])):
            continue
        top = top_at = neck = second = None
        low2, told, count = float("inf"), None, 0
        for j in range(f + 1, min(f + rule.most_bars, n - 2) + 1):
            if top is None or h[j] > top:
                top, top_at = h[j], j
            span = top - lo[f]
            if j < f + rule.strength or span <= 0:
                continue
            if lo[j] < lo[f] - rule.below * span:
                break
            if j - f < rule.least_bars:
                continue
            if neck is not None and c[j] > neck:
                break
            if j > top_at and lo[j] <= lo[f] + rule.above * span:
                neck = top if neck is None else neck
                if lo[j] < low2:
                    low2, second = lo[j], j
            if neck is None or second is None or j <= second or second == told or c[j] - low2 < rule.confirmed * span:
                continue
            told = second
            height = top - min(lo[f], low2)
            if not (unit[j] and height >= rule.height_atr * unit[j] and (max(h[max(0, f - rule.most_bars) : f + 1]) - lo[f]) / height >= rule.left_arm):
                continue
            error, _ = wp.form_errors([np.array(c[f : second + 1])])
            if np.isfinite(error[0]):
                out.append((f, top_at, second, j))
                count += 1
                if count >= rule.most:
                    break
    return out


def test_w_search(spark, bars, series):
    rule = wp.WRule(strength=3, most_bars=60, height_atr=1.0, left_arm=0.2, above=0.3, below=0.3, most=3)
    unit = {(r.instrument, r.i): r.atr for r in ind.atr(bars).select("instrument", "i", "atr").collect()}
    want = sorted((s[0][0], *x) for s in series for x in plain_w(s, [unit[s[0][0], i] for i in range(len(s))], rule))
    assert len(want) > 20
    for size in (None, 97):
        got = wp.w_candidates(bars, rule, size)
        assert sorted((r.instrument, r.first_i, r.high_i, r.second_i, r.i) for r in got.collect()) == want
    least = {}
    for r in sorted(got.collect(), key=lambda r: (r.form_error, r.i)):
        least.setdefault((r.instrument, r.first_i), r.i)
    assert {(r.instrument, r.first_i): r.i for r in wp.best_w(got).collect()} == least
    assert wp.w_candidates(bars, wp.WRule(strength=3, most_bars=60, most_error=0.0)).count() == 0
    assert wp.w_candidates(bars.limit(0)).count() == 0


def test_a_rally_is_one_leg(spark):
    """A path up without a fall completes one leg; each fall by the least move lets another begin."""
    path = [10, 12, 14, 16, 18, 16, 20, 22, 19, 25, 9, 30]
    rows = [("a", i, float(p), float(p), float(p), float(p), 1.0) for i, p in enumerate(path)]
    found = spark.createDataFrame([("a", 0, 0, 0, 10.0, 20.0)], "instrument string, first_i long, second_i long, i long, low2 double, high double")
    got = wp.structure_steps(found, frame(spark, rows), legs=(0.2,)).orderBy("step").collect()
    assert [r.reached_i for r in got] == [1, 6, 9, None, None, None]
    assert [r.entry_i for r in got] == [2, 7, 10, None, None, None] and {r.broken_i for r in got} == {10}
    way = {round(r.step, 2): r.reached_i for r in wp.way_steps(found, frame(spark, rows)).collect()}
    assert way == {0.15: 1, 0.25: 2, 0.35: 2, 0.45: 3, 0.55: 3, 0.7: 4, 0.85: 6, 1.0: 6}


def test_exact_quantiles(spark):
    rng = random.Random(4)
    rows = [(d, g, rng.choice([0.0, rng.gauss(0, 1), rng.gauss(0, 1e6), None])) for d in (1, -1) for g, n in (("a", 200), ("b", 51), ("c", 1)) for _ in range(n)]
    rows.append((5, "alone", 2.0))
    asks = [("q25", "x", 0.25, False), ("q50", "x", 0.5, False), ("rest", "x", 0.5, True), ("rest90", "x", 0.9, True)]
    got = exact_quantiles(spark.createDataFrame(rows, "d long, g string, x double"), "g", "d", asks).collect()
    for r in got:
        own, rest = ([x for d, g, x in rows if d == r.d and (g == r.g) == same and x is not None] for same in (True, False))
        want = [np.quantile(own, 0.25), np.quantile(own, 0.5)] if own else [None, None]
        want += [np.quantile(rest, 0.5), np.quantile(rest, 0.9)] if rest else [None, None]
        assert [None if x is None else pytest.approx(x, abs=1e-9) for x in (r.q25, r.q50, r.rest, r.rest90)] == want
    assert len(got) == len({(d, g) for d, g, x in rows if x is not None})


def test_chains_of_all_other_groups():
    rng = random.Random(5)
    events = sorted((rng.randrange(400), rng.choice("abcd"), rng.random() < 0.5) for _ in range(300))
    won = {}
    events = [(i, g, won.setdefault(i, w)) for i, g, w in events]  # events of one bar have one outcome
    chains = ev._Chains(10)
    for i, g, w in events:
        chains.add(i, g, w, 1.0 if w else -0.5)

    def greedy(rows):
        last, n, wins = -(10**12), 0, 0
        for i, _, w in rows:
            if i - last >= 10:
                last, n, wins = i, n + 1, wins + w
        return n, wins

    for g, k in chains.number.items():
        assert tuple(chains.own[k, :2]) == greedy([e for e in events if e[1] == g])
        assert tuple(chains.rest[k]) == greedy([e for e in events if e[1] != g])
    assert tuple(chains.all) == greedy(events)


def test_equal_levels_first_fit(spark, bars, series):
    got = points.equal_levels(bars, lookback=None, near_atr=0.0).collect()
    assert got
    want = []
    for s in series:
        for kind, col, sign in (("high", 3, 1), ("low", 4, -1)):
            x = [sign * r[col] for r in s]
            found = [i for i in range(3, len(s) - 3) if x[i] > max(x[i - 3 : i]) and x[i] >= max(x[i + 1 : i + 4])]
            clusters = []
            for i in found:
                p = s[i][col]
                home = next((c for c in clusters if abs(p - sum(c[1]) / len(c[1])) <= 1.0), None)
                if home is None:
                    clusters.append(home := ([], []))
                home[0].append(i)
                home[1].append(p)
            for at, prices in clusters:
                if len(at) > 1:
                    level, known = sum(prices) / len(prices), min(at[-1] + 3, len(s) - 1)
                    want.append((s[0][0], kind, at[0], at[-1], len(at), round(level, 9), next((j for j in range(known, len(s)) if sign * s[j][col] > sign * level), None)))
    assert sorted(((r.instrument, r.kind, r.first, r.latest, r.members, round(r.level, 9), r.swept_i) for r in got), key=repr) == sorted(want, key=repr)


def test_spread_sample(spark):
    rows = [(k, "2024-01") for k in range(500)] + [(k, "2024-02") for k in range(500, 520)] + [(k, "2024-03") for k in range(520, 523)]
    found = spark.createDataFrame(rows, "id long, month string")
    for n, want in ((30, {"2024-01": 17, "2024-02": 10, "2024-03": 3}), (2, None), (600, {"2024-01": 500, "2024-02": 20, "2024-03": 3})):
        got = [r.month for r in measure.spread_sample(found, n).collect()]
        counts = {m: got.count(m) for m in set(got)}
        if n == 30:
            assert counts["2024-03"] == 3 and counts["2024-02"] >= 10 and counts["2024-01"] >= 10 and sum(counts.values()) == 30
        elif want:
            assert counts == want
        else:
            assert len(got) == n
    assert sorted(r.id for r in measure.spread_sample(found, 30).collect()) == sorted(r.id for r in measure.spread_sample(found.repartition(7), 30).collect())


def test_clear_windows(spark, series):
    bars = frame(spark, *(walk(9000, k, n) for k, n in enumerate("xy")))
    patterns = [(k, n, at, at + 20) for n in "xy" for k, at in enumerate(range(0, 8900, 90))]
    lengths = spark.createDataFrame([(20 + k % 40,) for k in range(25)], "bars long")
    taken = spark.createDataFrame(patterns, "id long, instrument string, first_i long, last_i long")
    got = measure.clear_windows(lengths, taken, bars, 40, most_minutes=15.0).collect()
    assert len(got) == 40 and {r.id for r in got} == set(range(40))
    assert {r.bars for r in got} <= {r.bars for r in lengths.collect()} and all(r.last_i - r.first_i == r.bars for r in got)
    for name in "xy":
        own = sorted((r.first_i - 20, r.last_i) for r in got if r.instrument == name)
        assert all(a[1] < b[0] for a, b in zip(own, own[1:])) and own[0][0] >= 0 and own[-1][1] < 9000
    for r in got:
        assert all(min(r.last_i, b) - max(r.first_i, a) + 1 <= 0.5 * (r.bars + 1) for _, n, a, b in patterns if n == r.instrument)
    everywhere = spark.createDataFrame([(0, n, 0, 9000) for n in "xy"], "id long, instrument string, first_i long, last_i long")
    assert measure.clear_windows(lengths, everywhere, bars, 40).count() == 0
