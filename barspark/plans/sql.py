"""Pieces of the comparison SQL (DuckDB)."""

from __future__ import annotations

BARS = """
raw AS (SELECT event_type AS instrument, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ts,
               arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
               arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM events e GROUP BY event_type, time_bucket(INTERVAL 1 HOUR, e.ts)),
bars AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1 AS i FROM raw)
"""

LOCAL = "timezone('America/New_York', timezone('UTC', {ts}))"
SESSION = "CAST(timezone('America/New_York', timezone('UTC', ts)) + INTERVAL 6 HOURS AS DATE)"

TICKS = f"t AS (SELECT event_type AS instrument, ts, event_id, value AS price, {SESSION} AS session, {LOCAL.format(ts='ts')} AS lts, hour({LOCAL.format(ts='ts')}) * 60 + minute({LOCAL.format(ts='ts')}) AS m FROM events)"


def ewm(name: str, source: str, column: str, alpha: str, min_periods: int) -> str:
    """CTEs for the exponential mean of a column whose nulls all come first."""
    return f"""
{name}_s AS (SELECT instrument, i, {column} AS x, count({column}) OVER (PARTITION BY instrument ORDER BY i) AS k FROM {source}),
{name}_r AS (SELECT instrument, i, x AS y, k FROM {name}_s WHERE k = 1 AND x IS NOT NULL
    UNION ALL SELECT s.instrument, s.i, (1 - {alpha}) * r.y + {alpha} * s.x, s.k
    FROM {name}_r r JOIN {name}_s s ON s.instrument = r.instrument AND s.i = r.i + 1),
{name} AS (SELECT instrument, i, CASE WHEN k >= {min_periods} THEN y END AS y FROM {name}_r)
"""


def tr(name: str = "trs") -> str:
    return f"""{name} AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
    FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY i))"""


ATR = tr() + "," + ewm("atr", "trs", "tr", "(1.0/14)", 14)
