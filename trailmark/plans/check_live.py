"""Check SQL of the streaming queries: the batch results over all events."""

from __future__ import annotations

from trailmark.plans.check_kpi import RAW_COLS
from trailmark.plans.sqltext import COUNTS, RAW, on_events

GAP = 1800


def checks() -> dict[str, str]:
    q = {"stream_clean_events": on_events(f"SELECT {RAW_COLS} FROM ub")}
    q["stream_window_kpi"] = f"""WITH {RAW}
        SELECT timestamp // 3600 * 3600 AS window_start, COUNT(*) AS events, {COUNTS},
               COUNT(DISTINCT user_id) AS users
        FROM raw GROUP BY 1"""
    q["stream_sessions"] = f"""WITH {RAW}, stepped AS (
          SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp) <= {GAP}
                         THEN 0 ELSE 1 END AS opens
          FROM raw),
        numbered AS (
          SELECT *, SUM(opens) OVER (PARTITION BY user_id ORDER BY timestamp
                                     RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no
          FROM stepped)
        SELECT user_id, MIN(timestamp) AS session_start, MAX(timestamp) AS session_end,
               MAX(timestamp) - MIN(timestamp) AS duration_sec, COUNT(*) AS events, {COUNTS}
        FROM numbered GROUP BY user_id, no"""
    return q
