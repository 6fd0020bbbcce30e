"""Named queries of the bar engine and the SQL that they are compared with."""

from __future__ import annotations

from barspark.plans import conditional_queries, event_queries, indicator_queries, level_queries, monitor_queries, research_queries, state_queries, strategy_queries, structure_queries, validation_queries, w_queries

_PARTS = (conditional_queries, indicator_queries, level_queries, structure_queries, event_queries, research_queries, monitor_queries, state_queries, strategy_queries, validation_queries, w_queries)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in _PARTS:
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
