"""Text helpers for the check SQL: the shared CTEs and the rounding all engines agree on."""

from __future__ import annotations

RAW = """raw AS (
  SELECT user_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS item_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 + 1 AS category_id,
         CASE event_type WHEN 'view' THEN 'pv' WHEN 'click' THEN 'cart' WHEN 'signup' THEN 'fav'
              WHEN 'purchase' THEN 'buy' ELSE event_type END AS behavior_type,
         CAST(floor(epoch(ts)) AS BIGINT) AS timestamp
  FROM events)"""

UB = """ub0 AS (
  SELECT DISTINCT * FROM raw
  WHERE user_id IS NOT NULL AND item_id IS NOT NULL
    AND timestamp BETWEEN 1704067200 AND 1706659199
    AND behavior_type IN ('pv', 'fav', 'cart', 'buy')),
ub1 AS (
  SELECT *, DATE '1970-01-01' + CAST(timestamp // 86400 AS INTEGER) AS date,
         CAST((timestamp % 86400) // 3600 AS INTEGER) AS hour
  FROM ub0),
ub AS (
  SELECT *, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
         CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN hour < 6 THEN 'dawn' WHEN hour < 12 THEN 'morning' WHEN hour < 14 THEN 'noon'
              WHEN hour < 18 THEN 'afternoon' WHEN hour < 22 THEN 'evening' ELSE 'night' END AS time_period
  FROM ub1)"""


def n_of(b: str) -> str:
    return f"COUNT(*) FILTER (WHERE behavior_type = '{b}')"


COUNTS = ", ".join(f"{n_of(b)} AS {b}_count" for b in ("pv", "fav", "cart", "buy"))

UD = f"""ud AS (
  SELECT user_id, date, COUNT(*) AS total_actions, {COUNTS},
         COUNT(DISTINCT item_id) AS unique_items, COUNT(DISTINCT category_id) AS unique_categories,
         MIN(timestamp) AS first_ts, MAX(timestamp) AS last_ts
  FROM ub GROUP BY user_id, date)"""

ORDERS = """pu AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id,
         CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS category_id,
         'buy' AS behavior_type, CAST(o_orderdate AS DATE) AS date
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)"""


def rnd(e: str, digits: int) -> str:
    s = f"1e{digits}"
    return (
        f"(CASE WHEN ({e}) < 0 THEN -CAST(floor(-({e})*{s}+0.5) AS BIGINT) "
        f"ELSE CAST(floor(({e})*{s}+0.5) AS BIGINT) END / {s})"
    )


def ratio(num: str, den: str, digits: int | None = 4) -> str:
    e = f"(CAST({num} AS DOUBLE)/NULLIF(CAST({den} AS DOUBLE),0))"
    return e if digits is None else rnd(e, digits)


def pct(num: str, den: str, digits: int | None = 2) -> str:
    e = f"(CAST({num} AS DOUBLE)*100e0/NULLIF(CAST({den} AS DOUBLE),0))"
    return e if digits is None else rnd(e, digits)


def erfc(x: str) -> str:
    """Complementary error function of a column x >= 0: a series below 2.5, a continued fraction above."""
    series, fraction = "1e0", f"GREATEST({x}, 2.5e0)"
    for k in range(50, 0, -1):
        series = f"(1e0 + {series} * (2e0 * {x} * {x}) / {2 * k + 1}e0)"
    for k in range(40, 0, -1):
        fraction = f"(GREATEST({x}, 2.5e0) + {k / 2}e0 / {fraction})"
    return (
        f"(CASE WHEN {x} < 2.5e0 THEN 1e0 - 2e0 / sqrt(pi()) * {x} * exp(-({x} * {x})) * {series} "
        f"ELSE exp(-({x} * {x})) / (sqrt(pi()) * {fraction}) END)"
    )


def big(e: str) -> str:
    return f"CAST({e} AS BIGINT)"


def total(*columns: str) -> str:
    return ", ".join(f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in columns)


def on_events(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([RAW, UB, *ctes]) + "\n" + body


def on_days(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([RAW, UB, UD, *ctes]) + "\n" + body


def on_orders(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([ORDERS, *ctes]) + "\n" + body
