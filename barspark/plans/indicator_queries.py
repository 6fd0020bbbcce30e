"""Indicator queries over hourly bars, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.operators import indicators as ind
from barspark.plans import sql
from barspark.sources.bars import hourly

KEY = ("instrument", "i")


def _query(build, *columns, keep=()):
    def run(spark, sf_dir):
        rows = build(hourly(spark, sf_dir))
        return rows.select(*KEY, *(F.round(c, 6).alias(c) for c in columns), *keep)

    return run


def indicator_bundle(spark, sf_dir):
    rows = ind.previous_session(ind.session_vwap(ind.rsi(ind.atr(ind.ema(hourly(spark, sf_dir), 20)))))
    rows = rows.withColumn("sma20", ind.over_last(F.avg, "close", 20)).withColumn("sma50", ind.over_last(F.avg, "close", 50))
    return rows.select(*KEY, "ts", "session", *(F.round(c, 6).alias(c) for c in ("sma20", "sma50", "ema20", "rsi", "atr", "vwap", "prev_high", "prev_low", "prev_close")))


RSI = """chg AS (SELECT *, close - lag(close) OVER (PARTITION BY instrument ORDER BY i) AS d FROM bars),
updown AS (SELECT instrument, i, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS u, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS dn FROM chg),""" + sql.ewm("gain", "updown", "u", "(1.0/14)", 14) + "," + sql.ewm("loss", "updown", "dn", "(1.0/14)", 14)

RSI_VALUE = "CASE WHEN loss.y IS NULL THEN NULL WHEN gain.y = 0 THEN 0.0 WHEN loss.y = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain.y / loss.y) END"

BUNDLE = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR}, {sql.ewm("e20", "bars", "close", "(2.0/21)", 20)}, {RSI},
s AS (SELECT *, {sql.SESSION} AS session, (high + low + close) / 3 AS tp FROM bars),
days AS (SELECT instrument, session, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM s GROUP BY ALL),
prev AS (SELECT instrument, session, lag(h) OVER w AS ph, lag(l) OVER w AS pl, lag(c) OVER w AS pc FROM days WINDOW w AS (PARTITION BY instrument ORDER BY session)),
x AS (SELECT s.*, CASE WHEN i >= 19 THEN avg(close) OVER (PARTITION BY instrument ORDER BY i ROWS 19 PRECEDING) END AS s20,
    CASE WHEN i >= 49 THEN avg(close) OVER (PARTITION BY instrument ORDER BY i ROWS 49 PRECEDING) END AS s50,
    coalesce(sum(tp * volume) OVER v / nullif(sum(volume) OVER v, 0), tp) AS vw FROM s
    WINDOW v AS (PARTITION BY instrument, session ORDER BY i))
SELECT x.instrument, x.i, x.ts, x.session, round(s20, 6) AS sma20, round(s50, 6) AS sma50, round(e20.y, 6) AS ema20, round({RSI_VALUE}, 6) AS rsi,
    round(atr.y, 6) AS atr, round(vw, 6) AS vwap, round(ph, 6) AS prev_high, round(pl, 6) AS prev_low, round(pc, 6) AS prev_close
FROM x LEFT JOIN prev USING (instrument, session) LEFT JOIN atr USING (instrument, i) LEFT JOIN e20 USING (instrument, i)
    LEFT JOIN gain USING (instrument, i) LEFT JOIN loss USING (instrument, i)"""

MACD = f"""WITH RECURSIVE {sql.BARS}, {sql.ewm("f", "bars", "close", "(2.0/13)", 12)}, {sql.ewm("sl", "bars", "close", "(2.0/27)", 26)},
m AS (SELECT instrument, i, f.y - sl.y AS macd FROM f JOIN sl USING (instrument, i)), {sql.ewm("sg", "m", "macd", "(2.0/10)", 9)}
SELECT instrument, i, round(macd, 6) AS macd, round(sg.y, 6) AS macd_signal, round(macd - sg.y, 6) AS macd_hist FROM m LEFT JOIN sg USING (instrument, i)"""

STOCH = f"""WITH {sql.BARS},
a AS (SELECT *, max(high) OVER w AS t, min(low) OVER w AS b FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY i ROWS 13 PRECEDING)),
r AS (SELECT *, CASE WHEN i >= 13 THEN 100 * (close - b) / nullif(t - b, 0) END AS raw FROM a),
k AS (SELECT *, CASE WHEN count(raw) OVER w = 3 THEN avg(raw) OVER w END AS k FROM r WINDOW w AS (PARTITION BY instrument ORDER BY i ROWS 2 PRECEDING)),
d AS (SELECT *, CASE WHEN count(k) OVER w = 3 THEN avg(k) OVER w END AS d FROM k WINDOW w AS (PARTITION BY instrument ORDER BY i ROWS 2 PRECEDING))
SELECT instrument, i, round(k, 6) AS stoch_k, round(d, 6) AS stoch_d FROM d"""

ADX_CTES = f"""{sql.ATR},
dm AS (SELECT *, coalesce(high - lag(high) OVER w, 0) AS u, coalesce(lag(low) OVER w - low, 0) AS d FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY i)),
pm AS (SELECT *, CASE WHEN u > d AND u > 0 THEN u ELSE 0.0 END AS p, CASE WHEN d > u AND d > 0 THEN d ELSE 0.0 END AS m FROM dm),
{sql.ewm("sp", "pm", "p", "(1.0/14)", 14)}, {sql.ewm("sm", "pm", "m", "(1.0/14)", 14)},
di AS (SELECT instrument, i, 100 * sp.y / nullif(atr.y, 0) AS pd, 100 * sm.y / nullif(atr.y, 0) AS md FROM sp JOIN sm USING (instrument, i) JOIN atr USING (instrument, i)),
dxs AS (SELECT *, 100 * abs(pd - md) / nullif(pd + md, 0) AS dx FROM di), {sql.ewm("adx", "dxs", "dx", "(1.0/14)", 14)}"""

ADX = f"""WITH RECURSIVE {sql.BARS}, {ADX_CTES}
SELECT instrument, i, round(pd, 6) AS plus_di, round(md, 6) AS minus_di, round(adx.y, 6) AS adx FROM dxs LEFT JOIN adx USING (instrument, i)"""

BOLL = f"""WITH RECURSIVE {sql.BARS}, {sql.tr()}, {sql.ewm("a20", "trs", "tr", "(1.0/20)", 20)}, {sql.ewm("m20", "bars", "close", "(2.0/21)", 20)},
b AS (SELECT instrument, i, CASE WHEN i >= 19 THEN avg(close) OVER w END AS mid, CASE WHEN i >= 19 THEN stddev_pop(close) OVER w END AS sd FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY i ROWS 19 PRECEDING))
SELECT instrument, i, round(mid, 6) AS bb_mid, round(mid + 2 * sd, 6) AS bb_upper, round(mid - 2 * sd, 6) AS bb_lower,
    coalesce(mid + 2 * sd < m20.y + 1.5 * a20.y AND mid - 2 * sd > m20.y - 1.5 * a20.y, false) AS squeeze
FROM b LEFT JOIN a20 USING (instrument, i) LEFT JOIN m20 USING (instrument, i)"""

STACK = f"""WITH RECURSIVE {sql.BARS}, {", ".join(sql.ewm(f"e{n}", "bars", "close", f"(2.0/{n + 1})", n) for n in (9, 21, 50, 200))}
SELECT instrument, i, round(e9.y, 6) AS ema9, round(e200.y, 6) AS ema200,
    CASE WHEN e9.y > e21.y AND e21.y > e50.y AND e50.y > e200.y THEN 'bullish' WHEN e9.y < e21.y AND e21.y < e50.y AND e50.y < e200.y THEN 'bearish' WHEN e200.y IS NOT NULL THEN 'mixed' END AS ema_stack
FROM e9 JOIN e21 USING (instrument, i) JOIN e50 USING (instrument, i) JOIN e200 USING (instrument, i)"""

FLAGS_CTE = """flx AS (SELECT b.*, CASE WHEN i >= 10 THEN max(high) OVER w END AS t, CASE WHEN i >= 10 THEN min(low) OVER w END AS bt, lag(atr.y) OVER o AS ref, lag(close, 10) OVER o - lag(close, 30) OVER o AS mv
    FROM bars b JOIN atr USING (instrument, i) WINDOW o AS (PARTITION BY instrument ORDER BY i), w AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
fly AS (SELECT *, coalesce(mv >= 2.5 * ref AND t - bt <= 2.4 * ref, false) AS u, coalesce(mv <= -2.5 * ref AND t - bt <= 2.4 * ref, false) AS d FROM flx),
flz0 AS (SELECT *, u AND close > t + 0.1 * ref AS flag_up, d AND close < bt - 0.1 * ref AS flag_down, CAST(CASE WHEN d THEN -1 WHEN u THEN 1 ELSE 0 END AS BIGINT) AS flag_direction FROM fly),
flz AS (SELECT *, t - bt AS flag_range, mv AS flag_impulse, (u OR d) AND NOT flag_up AND NOT flag_down AS flag_forming FROM flz0)"""
FLAGS = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR}, {FLAGS_CTE}
SELECT instrument, i, round(t, 6) AS flag_top, round(bt, 6) AS flag_bottom, round(flag_range, 6) AS flag_range, round(flag_impulse, 6) AS flag_impulse, flag_up, flag_down, flag_direction, flag_forming FROM flz"""

RELVOL_CTE = """rv AS (SELECT *, volume / nullif(CASE WHEN count(volume) OVER w >= {least} THEN quantile_cont(volume, 0.5) OVER w END, 0) AS rel_volume
    FROM bars WINDOW w AS (PARTITION BY instrument, hour(ts) * 60 + minute(ts) ORDER BY ts ROWS {back} PRECEDING))"""

RELVOL = f"WITH {sql.BARS}, {RELVOL_CTE.format(least=15, back=59)} SELECT instrument, i, round(rel_volume, 6) AS rel_volume FROM rv"


def _rank(name: str, column: str) -> str:
    return f"""{name}_l AS (SELECT instrument, i, {column} AS v, list({column}) FILTER ({column} IS NOT NULL) OVER (PARTITION BY instrument ORDER BY i ROWS 1379 PRECEDING) AS vs FROM base),
{name} AS (SELECT instrument, i, CASE WHEN v IS NOT NULL AND len(vs) >= 460 THEN (len(list_filter(vs, lambda q: q < v)) + 0.5 * len(list_filter(vs, lambda q: q = v)) + 0.5) / len(vs) END AS r FROM {name}_l)"""


_LABEL = "CASE WHEN {r} <= 1.0/3 THEN 'low' WHEN {r} <= 2.0/3 THEN 'mid' WHEN {r} IS NOT NULL THEN 'high' END"

REGIME = f"""WITH RECURSIVE {sql.BARS}, {ADX_CTES}, {RELVOL_CTE.format(least=15, back=59)},
base AS (SELECT instrument, i, atr.y AS a, adx.y AS x, rel_volume AS v FROM rv LEFT JOIN atr USING (instrument, i) LEFT JOIN adx USING (instrument, i)),
{_rank("ra", "a")}, {_rank("rx", "x")}, {_rank("rl", "v")},
lab AS (SELECT instrument, i, round(ra.r, 6) AS vola_rank, {_LABEL.format(r="ra.r")} AS vola, {_LABEL.format(r="rx.r")} AS structure, {_LABEL.format(r="rl.r")} AS liquidity
    FROM ra JOIN rx USING (instrument, i) JOIN rl USING (instrument, i))
SELECT instrument, i, vola_rank, vola, structure, liquidity, CASE WHEN vola IS NOT NULL AND structure IS NOT NULL AND liquidity IS NOT NULL THEN vola || '|' || structure || '|' || liquidity END AS regime FROM lab"""

COMPRESSION_CTE = """rc0 AS (SELECT *, CASE WHEN i >= 19 THEN max(high) OVER w - min(low) OVER w END AS rn FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY i ROWS 19 PRECEDING)),
rc AS (SELECT *, CASE WHEN count(rn) OVER w = 60 THEN quantile_cont(rn, 0.5) OVER w END AS ru FROM rc0 WINDOW w AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 79 PRECEDING AND 20 PRECEDING))"""
COMPRESSION = f"WITH {sql.BARS}, {COMPRESSION_CTE} SELECT instrument, i, round(rn, 6) AS range_now, round(ru, 6) AS range_usual, coalesce(rn / nullif(ru, 0) <= 0.6, false) AS compressed FROM rc"

_EXTENDED = ("macd", "macd_signal", "macd_hist", "stoch_k", "stoch_d", "plus_di", "minus_di", "adx", "bb_mid", "bb_upper", "bb_lower", "squeeze", "ema9", "ema200", "ema_stack")

QUERIES = {
    "extended_bundle": _query(ind.extended, *(c for c in _EXTENDED if c not in ("squeeze", "ema_stack")), keep=("squeeze", "ema_stack")),
    "relative_volume_trailing": _query(ind.relative_volume_trailing, "trailing_volume"),
    "indicator_bundle": indicator_bundle,
    "macd": _query(ind.macd, "macd", "macd_signal", "macd_hist"),
    "stochastic": _query(ind.stochastic, "stoch_k", "stoch_d"),
    "adx": _query(ind.adx, "plus_di", "minus_di", "adx"),
    "bollinger_squeeze": _query(ind.bollinger, "bb_mid", "bb_upper", "bb_lower", keep=("squeeze",)),
    "ema_stack": _query(ind.ema_stack, "ema9", "ema200", keep=("ema_stack",)),
    "flag_signals": _query(ind.flag_signals, "flag_top", "flag_bottom", "flag_range", "flag_impulse", keep=("flag_up", "flag_down", "flag_direction", "flag_forming")),
    "relative_volume": _query(ind.relative_volume, "rel_volume"),
    "regime": _query(ind.regime, "vola_rank", keep=("vola", "structure", "liquidity", "regime")),
    "range_compression": _query(ind.range_compression, "range_now", "range_usual", keep=("compressed",)),
}
ORACLES = {
    "extended_bundle": f"SELECT instrument, i, {', '.join(_EXTENDED)} FROM ({MACD}) JOIN ({STOCH}) USING (instrument, i) JOIN ({ADX}) USING (instrument, i) JOIN ({BOLL}) USING (instrument, i) JOIN ({STACK}) USING (instrument, i)",
    "relative_volume_trailing": f"WITH {sql.BARS} SELECT instrument, i, round(volume / nullif(CASE WHEN count(volume) OVER w >= 15 THEN quantile_cont(volume, 0.5) OVER w END, 0), 6) AS trailing_volume FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY ts ROWS 59 PRECEDING)",
    "indicator_bundle": BUNDLE,
    "macd": MACD,
    "stochastic": STOCH,
    "adx": ADX,
    "bollinger_squeeze": BOLL,
    "ema_stack": STACK,
    "flag_signals": FLAGS,
    "relative_volume": RELVOL,
    "regime": REGIME,
    "range_compression": COMPRESSION,
}
