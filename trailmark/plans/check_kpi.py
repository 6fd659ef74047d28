"""Check SQL for ingestion, KPI, retention, funnel and anomaly queries."""

from __future__ import annotations

from trailmark.plans.sqltext import COUNTS, RAW, big, n_of, on_days, on_events, pct, ratio, rnd, total

RAW_COLS = "user_id, item_id, category_id, behavior_type, timestamp"
ALL4 = ("pv_count", "fav_count", "cart_count", "buy_count")

COHORT = """co AS (
  SELECT cohort_date, CAST(date - cohort_date AS BIGINT) AS day_diff, COUNT(*) AS users
  FROM (SELECT user_id, date, MIN(date) OVER (PARTITION BY user_id) AS cohort_date
        FROM (SELECT DISTINCT user_id, date FROM ub))
  GROUP BY ALL),
cs AS (SELECT cohort_date, users AS cohort_size FROM co WHERE day_diff = 0)"""


def day_users(n: int, zero: bool = True) -> str:
    e = f"MAX(CASE WHEN day_diff = {n} THEN users END)"
    return f"COALESCE({e}, 0)" if zero else e


FLAGS = ", ".join(
    f"MAX(CASE WHEN behavior_type = '{b}' THEN 1 ELSE 0 END) AS has_{b}" for b in ("pv", "fav", "cart", "buy")
)


def flags(keys: str) -> str:
    return f"fl AS (SELECT {keys}, {FLAGS} FROM ub GROUP BY {keys})"


FUNNEL = (
    flags("date, user_id, item_id")
    + f""",
fun AS (
  SELECT date, {", ".join(f"CAST(SUM(has_{b}) AS BIGINT) AS {b}_users" for b in ("pv", "fav", "cart", "buy"))},
         COUNT(*) FILTER (WHERE has_buy = 1 AND has_cart = 0 AND has_fav = 0) AS direct_buy_count
  FROM fl GROUP BY date)"""
)

RETENTION = f"""ret0 AS (
  SELECT cohort_date AS date, {day_users(0, False)} AS new_users,
         {", ".join(f"{day_users(n, False)} AS retained_d{n}" for n in (1, 3, 7))}
  FROM co GROUP BY cohort_date),
ret AS (
  SELECT *, {", ".join(f"{pct(f'retained_d{n}', 'new_users')} AS retention_d{n}_rate" for n in (1, 3, 7))}
  FROM ret0)"""

DAILY = f"""daily AS (
  SELECT date, COUNT(DISTINCT user_id) AS dau, COUNT(*) AS total_actions, {COUNTS},
         COUNT(DISTINCT CASE WHEN behavior_type = 'buy' THEN user_id END) AS buyer_count
  FROM ub GROUP BY date)"""


def _user_funnel(keys: str) -> str:
    one = "one AS (SELECT " + ", ".join(
        f"CAST(SUM(has_{b}) AS BIGINT) AS {b}" for b in ("pv", "fav", "cart", "buy")
    ) + " FROM fl)"
    rows = [("fav", "view to favourite"), ("cart", "view to cart"), ("buy", "view to purchase")]
    body = "SELECT 'pv' AS stage, pv AS user_count, 100e0 AS conversion_rate, 'all traffic' AS description FROM one"
    for b, text in rows:
        body += f"\nUNION ALL SELECT '{b}', {b}, {pct(b, 'pv')}, '{text}' FROM one"
    return on_events(body, flags(keys), one)


def _pairs(keys: str) -> str:
    steps = [
        ("pv->fav", "has_pv = 1 AND has_fav = 1", "pv"),
        ("pv->cart", "has_pv = 1 AND has_cart = 1", "pv"),
        ("fav->buy", "has_fav = 1 AND has_buy = 1", "fav"),
        ("cart->buy", "has_cart = 1 AND has_buy = 1", "cart"),
        ("pv->buy direct", "has_pv = 1 AND has_buy = 1 AND has_fav = 0 AND has_cart = 0", "pv"),
    ]
    parts = []
    for name, cond, base in steps:
        c = f"COUNT(*) FILTER (WHERE {cond})"
        parts.append(
            f"SELECT '{name}' AS funnel_step, {c} AS converted_users, CAST(SUM(has_{base}) AS BIGINT) AS from_users, "
            f"{pct(c, f'SUM(has_{base})')} AS step_conversion_rate FROM fl"
        )
    return on_events("\nUNION ALL ".join(parts), flags(keys))


def _paths(keys: str) -> str:
    return on_events(
        f"""SELECT conversion_path, n AS user_count, {pct("n", "SUM(n) OVER ()")} AS pct_of_total,
        {big("ROW_NUMBER() OVER (ORDER BY n DESC, conversion_path)")} AS path_rank
        FROM (SELECT CASE WHEN has_buy = 0 THEN 'no purchase'
              WHEN has_fav = 1 AND has_cart = 1 THEN 'pv->fav+cart->buy'
              WHEN has_fav = 1 THEN 'pv->fav->buy' WHEN has_cart = 1 THEN 'pv->cart->buy'
              ELSE 'pv->buy direct' END AS conversion_path, COUNT(*) AS n
              FROM fl WHERE has_pv = 1 GROUP BY 1)""",
        flags(keys),
    )


def _z(metric: str, over: str = "()") -> str:
    return f"(({metric} - AVG({metric}) OVER {over}) / NULLIF(STDDEV_POP({metric}) OVER {over}, 0))"


def _key_metrics_rank() -> str:
    return "ROW_NUMBER() OVER (ORDER BY d1_retention DESC NULLS LAST, cohort_date) = 1"


def checks() -> dict[str, str]:
    q: dict[str, str] = {}
    raw_rows = f"WITH {RAW} SELECT {RAW_COLS} FROM raw"
    q["read_behavior_csv"] = raw_rows
    q["schema_check"] = raw_rows
    q["null_profile"] = f"WITH {RAW} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count FROM raw"
        for c in RAW_COLS.split(", ")
    )
    q["clean_events"] = on_events(f"SELECT {RAW_COLS} FROM ub")
    q["incremental_load"] = on_events(
        f"""SELECT date, COUNT(*) AS events, COUNT(DISTINCT user_id) AS users, COUNT(*) AS total_actions,
        {n_of("buy")} AS buy_count FROM ub GROUP BY date"""
    )
    q["clean_positive"] = f"""WITH {RAW} SELECT DISTINCT {RAW_COLS} FROM raw
        WHERE user_id > 0 AND item_id > 0 AND category_id > 0 AND timestamp > 0
          AND behavior_type IN ('pv', 'fav', 'cart', 'buy')"""
    reason = """CASE WHEN user_id IS NULL OR item_id IS NULL OR timestamp IS NULL THEN 'null_id'
        WHEN timestamp NOT BETWEEN 1704067200 AND 1706659199 THEN 'ts_range'
        WHEN behavior_type IS NULL OR behavior_type NOT IN ('pv', 'fav', 'cart', 'buy') THEN 'behavior'
        ELSE 'valid' END"""
    steps = [
        ("input", "(SELECT COUNT(*) FROM raw)"),
        *[(r, f"(SELECT COUNT(*) FROM r WHERE reason = '{r}')") for r in ("null_id", "ts_range", "behavior")],
        ("duplicate", "(SELECT COUNT(*) FROM r WHERE reason = 'valid') - (SELECT COUNT(*) FROM ub)"),
        ("kept", "(SELECT COUNT(*) FROM ub)"),
    ]
    q["cleaning_report"] = on_events(
        "\nUNION ALL ".join(
            f"SELECT {big(str(i))} AS step_no, '{s}' AS step, {big(e)} AS row_count, "
            f"COALESCE({pct(e, '(SELECT COUNT(*) FROM raw)')}, 0e0) AS pct_of_input"
            for i, (s, e) in enumerate(steps)
        ),
        f"r AS (SELECT {reason} AS reason FROM raw)",
    )
    features = f"{RAW_COLS}, date, hour, day_of_week, is_weekend, time_period"
    q["time_features"] = on_events(f"SELECT {features} FROM ub")
    q["behavior_score"] = on_events(
        f"""SELECT {big("year(date)")} AS year, {big("month(date)")} AS month, {big("day(date)")} AS day,
        COUNT(*) AS events, {big("SUM(w)")} AS score, {rnd("(CAST(SUM(w) AS DOUBLE)/COUNT(*))", 4)} AS avg_score
        FROM (SELECT date, CASE behavior_type WHEN 'pv' THEN 1 WHEN 'fav' THEN 2 WHEN 'cart' THEN 3
              WHEN 'buy' THEN 4 ELSE 0 END AS w FROM ub) GROUP BY ALL"""
    )
    q["write_clean"] = on_events("SELECT date, COUNT(*) AS rows_written FROM ub GROUP BY date")
    q["stg_user_behavior"] = on_events(
        """SELECT user_id, item_id, category_id, behavior_type, timestamp AS event_timestamp, date AS event_date,
        hour AS event_hour, day_of_week, is_weekend, time_period FROM ub"""
    )
    q["behavior_type_stats"] = on_events(
        """SELECT behavior_type, COUNT(*) AS total_count, COUNT(DISTINCT user_id) AS unique_users,
        COUNT(DISTINCT item_id) AS unique_items FROM ub GROUP BY 1"""
    )
    q["weekend_purchases"] = on_events(
        "SELECT COUNT(*) AS weekend_purchases FROM ub WHERE behavior_type = 'buy' AND is_weekend = 1"
    )
    q["dataset_overview"] = on_events(
        """SELECT COUNT(*) AS row_count, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT item_id) AS items,
        COUNT(DISTINCT category_id) AS categories, MIN(date) AS min_date, MAX(date) AS max_date FROM ub"""
    )

    # KPI
    q["daily_metrics"] = on_events(
        f"""SELECT date, dau, {", ".join(ALL4)}, {ratio("buy_count", "pv_count")} AS buy_rate FROM daily""",
        DAILY,
    )
    q["user_daily_summary"] = on_events(
        f"SELECT user_id, date, COUNT(*) AS total_actions, {COUNTS}, MAX(timestamp) AS last_timestamp FROM ub GROUP BY ALL"
    )
    q["item_metrics"] = on_events(
        f"SELECT *, {ratio('buy_count', 'pv_count')} AS conversion_rate FROM (SELECT item_id, category_id, {COUNTS} FROM ub GROUP BY ALL)"
    )
    q["hourly_distribution"] = on_events(
        f"""SELECT {big("hour")} AS hour, time_period, COUNT(*) AS total_actions, {n_of("pv")} AS pv_count,
        {n_of("buy")} AS buy_count, {ratio(n_of("buy"), n_of("pv"))} AS buy_rate FROM ub GROUP BY ALL"""
    )
    q["user_first_active"] = on_events(
        "SELECT user_id, MIN(date) AS first_date, MIN(timestamp) AS first_timestamp FROM ub GROUP BY 1"
    )
    hourly = f"""hr AS (SELECT date, {big("hour")} AS hour, COUNT(*) AS total_events, COUNT(DISTINCT user_id) AS hourly_uv,
        {n_of("pv")} AS pv_count, {n_of("buy")} AS buy_count FROM ub GROUP BY ALL)"""
    q["hourly_traffic"] = on_events("SELECT * FROM hr", hourly)
    daily_pct = f"dp AS (SELECT date, dau, COALESCE({pct('buy_count', 'pv_count', 4)}, 0e0) AS conversion_rate FROM daily)"
    week = "OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    q["daily_metrics_ma7"] = on_events(
        f"""SELECT date, dau, {rnd(f"(AVG(dau) {week})", 2)} AS dau_ma, conversion_rate,
        {rnd(f"(AVG(conversion_rate) {week})", 4)} AS conversion_rate_ma FROM dp""",
        DAILY,
        daily_pct,
    )
    trend = "bt AS (SELECT date, behavior_type, COUNT(*) AS behavior_count FROM ub GROUP BY ALL)"
    q["behavior_trend"] = on_events("SELECT * FROM bt", trend)
    q["behavior_ratio"] = on_events(
        f"""SELECT *, {pct("behavior_count", "total_daily")} AS ratio FROM
        (SELECT *, {big("SUM(behavior_count) OVER (PARTITION BY date)")} AS total_daily FROM bt)""",
        trend,
    )
    q["daily_kpi_report"] = on_events(
        f"""SELECT date, dau, {", ".join(ALL4)}, {ratio("buy_count", "pv_count")} AS conversion_rate,
        {ratio("pv_count", "dau", 2)} AS pv_per_user, {pct("buyer_count", "dau")} AS buyer_pct FROM daily""",
        DAILY,
    )
    udm = f"""udm AS (SELECT *, COALESCE({ratio("buy_count", "pv_count")}, 0e0) AS conversion_rate,
        {big("CASE WHEN buy_count > 0 THEN 1 ELSE 0 END")} AS is_purchase_day,
        {big("CASE WHEN cart_count > 0 THEN 1 ELSE 0 END")} AS is_cart_day FROM ud)"""
    q["int_user_daily_metrics"] = on_days("SELECT * FROM udm", udm)
    q["int_user_behavior_summary"] = on_days(
        f"""SELECT user_id, COUNT(DISTINCT date) AS active_days, {total("total_actions")},
        {", ".join(f"{big(f'SUM({b}_count)')} AS total_{b}" for b in ("pv", "fav", "cart", "buy"))},
        {big("SUM(is_purchase_day)")} AS purchase_days, {big("SUM(is_cart_day)")} AS cart_days,
        {big("SUM(unique_items)")} AS unique_items_touched, MIN(date) AS first_active_date,
        MAX(date) AS last_active_date, {ratio("SUM(buy_count)", "SUM(pv_count)")} AS overall_conversion_rate
        FROM udm GROUP BY user_id""",
        udm,
    )
    q["mart_daily_kpi"] = on_events(
        f"""SELECT date, dau, pv_count, buy_count, cart_count, fav_count, purchase_conversion_rate, cart_conversion_rate,
        fav_conversion_rate, overall_conversion_rate, avg_pv_per_user, avg_buy_per_user, retention_d1_rate,
        retention_d3_rate, retention_d7_rate, new_users, funnel_pv, funnel_buy, funnel_buy_rate,
        dau - LAG(dau) OVER w AS dau_change,
        COALESCE({pct("(dau - LAG(dau) OVER w)", "LAG(dau) OVER w")}, 0e0) AS dau_change_pct,
        {rnd("(purchase_conversion_rate - LAG(purchase_conversion_rate) OVER w)", 4)} AS conversion_change,
        CASE WHEN ABS(dau - AVG(dau) OVER ()) > 3 * STDDEV_SAMP(dau) OVER () THEN 'abnormal' ELSE 'normal' END AS dau_anomaly_flag,
        CASE WHEN ABS(purchase_conversion_rate - AVG(purchase_conversion_rate) OVER ()) > 3 * STDDEV_SAMP(purchase_conversion_rate) OVER () THEN 'abnormal' ELSE 'normal' END AS conversion_anomaly_flag,
        CASE WHEN ABS(retention_d1_rate - AVG(retention_d1_rate) OVER ()) > 3 * STDDEV_SAMP(retention_d1_rate) OVER () THEN 'abnormal' ELSE 'normal' END AS retention_anomaly_flag,
        {rnd('''LEAST(100e0, GREATEST(0e0, 30 * (dau / NULLIF(CAST(MAX(dau) OVER () AS DOUBLE), 0))
          + 30 * (purchase_conversion_rate / NULLIF(MAX(purchase_conversion_rate) OVER (), 0))
          + 20 * (retention_d1_rate / NULLIF(MAX(retention_d1_rate) OVER (), 0))
          + 20 * (new_users / NULLIF(CAST(MAX(new_users) OVER () AS DOUBLE), 0))))''', 0)} AS health_score
        FROM base WINDOW w AS (ORDER BY date)""",
        DAILY,
        COHORT,
        RETENTION,
        FUNNEL,
        f"""base AS (
        SELECT d.date, dau, pv_count, buy_count, cart_count, fav_count,
          COALESCE({pct("buy_count", "pv_count")}, 0e0) AS purchase_conversion_rate,
          COALESCE({pct("cart_count", "pv_count")}, 0e0) AS cart_conversion_rate,
          COALESCE({pct("fav_count", "pv_count")}, 0e0) AS fav_conversion_rate,
          COALESCE({pct("buy_count", "total_actions")}, 0e0) AS overall_conversion_rate,
          COALESCE({ratio("pv_count", "dau", 2)}, 0e0) AS avg_pv_per_user,
          COALESCE({ratio("buy_count", "dau", 2)}, 0e0) AS avg_buy_per_user,
          COALESCE(retention_d1_rate, 0e0) AS retention_d1_rate, COALESCE(retention_d3_rate, 0e0) AS retention_d3_rate,
          COALESCE(retention_d7_rate, 0e0) AS retention_d7_rate, COALESCE(new_users, 0) AS new_users,
          COALESCE(f.pv_users, pv_count) AS funnel_pv, COALESCE(f.buy_users, buy_count) AS funnel_buy,
          COALESCE({pct("f.buy_users", "f.pv_users")}, 0e0) AS funnel_buy_rate
        FROM daily d LEFT JOIN ret r ON d.date = r.date LEFT JOIN fun f ON d.date = f.date)""",
    )
    q["headline_metrics"] = on_events(
        f"""SELECT (SELECT {rnd("AVG(dau)", 1)} FROM daily) AS dau_mean,
        {pct(n_of("buy"), n_of("pv"))} AS pv_to_buy_pct, {pct(n_of("cart"), n_of("pv"))} AS pv_to_cart_pct,
        {pct(n_of("buy"), n_of("cart"))} AS cart_to_buy_pct,
        (SELECT {pct("COUNT(*) FILTER (WHERE back)", "COUNT(*)")} FROM back) AS retention_d1_pct,
        (SELECT COUNT(*) FROM unsold) AS zero_conversion_items,
        {pct("(SELECT COUNT(*) FROM unsold)", "COUNT(DISTINCT CASE WHEN behavior_type = 'pv' THEN item_id END)")} AS zero_conversion_item_share_pct
        FROM ub""",
        DAILY,
        """first AS (SELECT user_id, MIN(date) AS f FROM ub GROUP BY 1),
        back AS (SELECT f.user_id, EXISTS (SELECT 1 FROM ub b WHERE b.user_id = f.user_id AND b.date = f.f + 1) AS back FROM first f),
        unsold AS (SELECT DISTINCT item_id FROM ub WHERE behavior_type = 'pv'
                   AND item_id NOT IN (SELECT item_id FROM ub WHERE behavior_type = 'buy'))""",
    )
    q["behavior_distribution"] = on_events(
        f"""SELECT behavior_type, COUNT(*) AS behavior_count, {pct("COUNT(*)", "SUM(COUNT(*)) OVER ()")} AS pct FROM ub GROUP BY 1"""
    )
    q["dau_trend"] = on_events("SELECT date, COUNT(DISTINCT user_id) AS dau FROM ub GROUP BY 1")
    q["hourly_activity"] = on_events(
        f"""SELECT {big("hour")} AS hour, COUNT(*) AS events,
        {big("ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, hour) = 1")} AS is_peak FROM ub GROUP BY hour"""
    )
    q["activity_heatmap"] = on_events(
        f"SELECT {big('day_of_week')} AS day_of_week, "
        + ", ".join(f"COUNT(*) FILTER (WHERE hour = {h}) AS h{h}" for h in range(24))
        + " FROM ub GROUP BY day_of_week"
    )
    q["weekend_vs_weekday"] = on_events(
        f"SELECT {big('is_weekend')} AS is_weekend, behavior_type, COUNT(*) AS events FROM ub GROUP BY ALL"
    )
    q["apply_filters"] = on_events(
        f"""SELECT {features} FROM ub WHERE behavior_type IN ('buy', 'cart') AND hour BETWEEN 8 AND 20 AND is_weekend = 1"""
    )
    q["apply_filters_dates"] = on_events(
        f"SELECT {features} FROM ub WHERE date IN (DATE '2024-01-05', DATE '2024-01-06')"
    )
    q["data_explorer"] = on_events(
        f"""SELECT {features} FROM ub ORDER BY timestamp, user_id, item_id, category_id, behavior_type LIMIT 1000"""
    )
    per_user = f"pu AS (SELECT user_id, {total(*ALL4)} FROM ud GROUP BY 1)"
    q["kpi_cards"] = on_days(
        f"""SELECT COUNT(*) AS users, {big("SUM(pv_count)")} AS pv, {pct("SUM(buy_count)", "SUM(pv_count)")} AS buy_rate_pct,
        {pct("COUNT(*) FILTER (WHERE buy_count >= 2)", "COUNT(*) FILTER (WHERE buy_count > 0)")} AS repurchase_pct FROM pu""",
        per_user,
    )
    bounce = "COUNT(*) FILTER (WHERE pv_count > 0 AND fav_count = 0 AND cart_count = 0 AND buy_count = 0)"
    q["bounce_rate"] = on_days(
        f"SELECT COUNT(*) AS users, {bounce} AS bounced_users, {pct(bounce, 'COUNT(*)')} AS bounce_pct FROM pu", per_user
    )
    q["hourly_by_behavior"] = on_events(
        f"SELECT {big('hour')} AS hour, behavior_type, COUNT(*) AS behavior_count FROM ub GROUP BY ALL"
    )
    q["repurchase_trend"] = on_days(
        f"""SELECT date, COUNT(*) AS total_buyers, COUNT(*) FILTER (WHERE buy_count >= 2) AS repeat_buyers,
        {pct("COUNT(*) FILTER (WHERE buy_count >= 2)", "COUNT(*)")} AS repurchase_rate FROM ud WHERE buy_count > 0 GROUP BY 1"""
    )
    metrics = ("dau", "pv_count", "buy_count", "buy_rate")
    changes = ", ".join(
        f"{pct(f'({m} - LAG({m}) OVER w)', f'LAG({m}) OVER w')} AS {m}_change_pct" for m in metrics
    )
    hit = " OR ".join(f"COALESCE(ABS({m}_change_pct) > 20, FALSE)" for m in metrics)
    q["kpi_change_alert"] = on_events(
        f"SELECT *, {big(hit)} AS alert FROM (SELECT date, dau, pv_count, buy_count, buy_rate, {changes} FROM dr WINDOW w AS (ORDER BY date))",
        DAILY,
        f"dr AS (SELECT *, {ratio('buy_count', 'pv_count')} AS buy_rate FROM daily)",
    )

    # retention
    q["daily_new_users"] = on_events(
        "SELECT date, COUNT(*) AS new_users FROM (SELECT user_id, MIN(date) AS date FROM ub GROUP BY 1) GROUP BY 1"
    )
    q["retention_d137"] = on_events(
        "SELECT date, new_users, "
        + ", ".join(f"retained_d{n}, {pct(f'retained_d{n}', 'new_users')} AS retention_d{n}_pct" for n in (1, 3, 7))
        + f" FROM (SELECT cohort_date AS date, {day_users(0)} AS new_users, "
        + ", ".join(f"{day_users(n)} AS retained_d{n}" for n in (1, 3, 7))
        + " FROM co GROUP BY 1)",
        COHORT,
    )
    q["retention_matrix"] = on_events(
        "SELECT *, "
        + ", ".join(f"{pct(f'd{n}_users', 'cohort_size')} AS d{n}_rate" for n in (1, 3, 7))
        + f" FROM (SELECT cohort_date, {day_users(0)} AS cohort_size, "
        + ", ".join(f"{day_users(n)} AS d{n}_users" for n in range(1, 8))
        + " FROM co GROUP BY 1)",
        COHORT,
    )
    q["user_cohorts"] = on_events(
        f"""SELECT user_id, date, MIN(date) OVER (PARTITION BY user_id) AS cohort_date,
        CAST(date - MIN(date) OVER (PARTITION BY user_id) AS BIGINT) AS day_diff,
        {big("ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY date)")} AS active_seq
        FROM (SELECT DISTINCT user_id, date FROM ub)"""
    )
    prev = "LAG(retention_rate) OVER (PARTITION BY day_diff ORDER BY cohort_date)"
    q["retention_trend"] = on_events(
        f"""SELECT cohort_date AS first_date, cohort_size, day_diff AS retention_day, retention_rate,
        {prev} AS prev_rate, {rnd(f"(raw_rate - {prev})", 2)} AS rate_change FROM
        (SELECT cohort_date, cohort_size, day_diff, {pct("users", "cohort_size", None)} AS raw_rate,
         {pct("users", "cohort_size")} AS retention_rate FROM co JOIN cs USING (cohort_date) WHERE day_diff IN (1, 3, 7))""",
        COHORT,
    )
    q["int_user_retention"] = on_events(
        f"""SELECT *, {rnd(f"(AVG({pct('retained_d1', 'new_users', None)}) {week})", 2)} AS retention_d1_ma7 FROM ret""",
        COHORT,
        RETENTION,
    )
    q["mart_user_retention"] = on_events(
        f"""SELECT cohort_date, day_diff, users AS retained_users, cohort_size AS cohort_users,
        {ratio("users", "cohort_size")} AS retention_rate,
        'D' || CAST(day_diff AS VARCHAR) AS retention_label
        FROM co JOIN cs USING (cohort_date) WHERE day_diff IN (1, 3, 7)""",
        COHORT,
    )
    q["cohort_pivot"] = on_events(
        "SELECT cohort_date, " + ", ".join(f"{pct(day_users(n), day_users(0), 1)} AS d{n}" for n in range(8))
        + " FROM co GROUP BY cohort_date",
        COHORT,
    )
    q["cohort_table"] = on_events(
        f"""SELECT cohort_date, day_diff AS period, users AS active_users, cohort_size,
        {ratio("users", "cohort_size")} AS retention_rate FROM co JOIN cs USING (cohort_date)""",
        COHORT,
    )
    q["cohort_key_metrics"] = on_events(
        f"""SELECT *, {big(_key_metrics_rank())} AS is_best_d1 FROM (
        SELECT cohort_date, {day_users(0)} AS cohort_size, {day_users(0)} AS d0_active,
        {", ".join(f"{ratio(day_users(n), day_users(0))} AS d{n}_retention" for n in (1, 3, 7))},
        {ratio("COALESCE(MAX(CASE WHEN day_diff = (SELECT MAX(day_diff) FROM co) THEN users END), 0)", day_users(0))} AS final_retention
        FROM co GROUP BY cohort_date)""",
        COHORT,
    )

    # funnels
    grains = {"": "user_id", "_by_day": "user_id, date", "_by_item": "user_id, item_id"}
    for suffix, keys in grains.items():
        q[f"user_funnel{suffix}"] = _user_funnel(keys)
        q[f"event_pair_conversion{suffix}"] = _pairs(keys)
        q[f"conversion_paths{suffix}"] = _paths(keys)
    users = ", ".join(f"CAST(SUM(has_{b}) AS BIGINT) AS {b}_users" for b in ("pv", "fav", "cart", "buy"))
    q["daily_funnel"] = on_events(
        f"""SELECT *, {rnd("(pv_to_buy_rate - LAG(pv_to_buy_rate) OVER (ORDER BY date))", 2)} AS buy_rate_change FROM
        (SELECT *, {", ".join(f"{pct(f'{b}_users', 'pv_users')} AS pv_to_{b}_rate" for b in ("fav", "cart", "buy"))}
         FROM (SELECT date, {users} FROM fl GROUP BY date))""",
        flags("date, user_id"),
    )
    q["period_funnel"] = on_events(
        f"""SELECT *, {big("RANK() OVER (ORDER BY conversion_rate DESC NULLS LAST)")} AS conversion_rank FROM
        (SELECT time_period, CAST(SUM(has_pv) AS BIGINT) AS pv_users, CAST(SUM(has_buy) AS BIGINT) AS buy_users,
         {pct("SUM(has_buy)", "SUM(has_pv)")} AS conversion_rate FROM fl GROUP BY 1)""",
        flags("time_period, user_id"),
    )
    q["int_conversion_funnel"] = on_events(
        f"""SELECT date, pv_users, fav_users, cart_users, buy_users,
        COALESCE({pct("fav_users", "pv_users")}, 0e0) AS pv_to_fav_rate,
        COALESCE({pct("cart_users", "fav_users")}, 0e0) AS fav_to_cart_rate,
        COALESCE({pct("buy_users", "cart_users")}, 0e0) AS cart_to_buy_rate,
        COALESCE({pct("buy_users", "pv_users")}, 0e0) AS overall_buy_rate, direct_buy_count FROM fun""",
        FUNNEL,
    )
    q["item_path_stats"] = on_events(
        """SELECT date, CASE WHEN has_buy = 1 AND has_cart = 1 AND has_fav = 1 THEN 'pv->fav->cart->buy'
        WHEN has_buy = 1 AND has_cart = 1 THEN 'pv->cart->buy' WHEN has_buy = 1 AND has_fav = 1 THEN 'pv->fav->buy'
        WHEN has_cart = 1 AND has_fav = 1 THEN 'pv->fav->cart' WHEN has_buy = 1 THEN 'pv->buy'
        WHEN has_cart = 1 THEN 'pv->cart' WHEN has_fav = 1 THEN 'pv->fav' ELSE 'pv_only' END AS conversion_path,
        COUNT(*) AS path_count FROM fl GROUP BY ALL""",
        flags("date, user_id, item_id"),
    )
    stages = [("pv", None), ("fav", "pv"), ("cart", "fav"), ("buy", "cart")]
    q["action_funnel"] = on_events(
        " UNION ALL ".join(
            f"SELECT {big(str(i + 1))} AS stage_no, '{b}' AS stage, {n_of(b)} AS events, "
            + ("100e0" if prev_b is None else pct(n_of(b), n_of(prev_b)))
            + " AS step_rate FROM ub"
            for i, (b, prev_b) in enumerate(stages)
        )
    )
    pairs = [("pv", "fav"), ("pv", "cart"), ("fav", "buy"), ("cart", "buy"), ("pv", "buy")]
    q["action_pair_rates"] = on_events(
        " UNION ALL ".join(
            f"SELECT '{a}->{b}' AS pair, {n_of(a)} AS from_events, {n_of(b)} AS to_events, "
            f"{pct(n_of(b), n_of(a))} AS rate_pct FROM ub"
            for a, b in pairs
        )
    )

    # anomalies
    rated = f"dr AS (SELECT *, {ratio('buy_count', 'pv_count')} AS conversion_rate FROM daily)"
    z = {m: _z(m) for m in ("dau", "pv_count", "buy_count", "conversion_rate")}
    q["zscore_anomalies"] = on_events(
        f"""SELECT date, dau, pv_count, buy_count, conversion_rate, {rnd(z["dau"], 2)} AS dau_zscore,
        {rnd(z["pv_count"], 2)} AS pv_zscore, {rnd(z["buy_count"], 2)} AS buy_zscore, {rnd(z["conversion_rate"], 2)} AS rate_zscore,
        CASE WHEN ABS({z["dau"]}) > 2 THEN 'dau' WHEN ABS({z["pv_count"]}) > 2 THEN 'pv'
             WHEN ABS({z["buy_count"]}) > 2 THEN 'buy' WHEN ABS({z["conversion_rate"]}) > 2 THEN 'conversion'
             ELSE 'normal' END AS anomaly_flag FROM dr""",
        DAILY,
        rated,
    )
    three = "OVER (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"

    def off(m: str) -> str:
        return f"ABS({m} - AVG({m}) {three}) > 2 * NULLIF(STDDEV_POP({m}) {three}, 0)"

    q["moving_avg_anomalies"] = on_events(
        f"""SELECT date, dau, conversion_rate, {rnd(f"(AVG(dau) {three})", 2)} AS dau_ma, pv_count,
        {rnd(f"(AVG(pv_count) {three})", 2)} AS pv_ma, {rnd(f"(AVG(conversion_rate) {three})", 4)} AS rate_ma,
        CASE WHEN ROW_NUMBER() OVER (ORDER BY date) <= 3 THEN 'insufficient' WHEN {off("dau")} THEN 'dau'
             WHEN {off("pv_count")} THEN 'pv' WHEN {off("conversion_rate")} THEN 'conversion' ELSE 'normal' END AS anomaly_flag,
        CASE WHEN ROW_NUMBER() OVER (ORDER BY date) > 3 THEN {pct(f"(dau - AVG(dau) {three})", f"(AVG(dau) {three})")} END AS dau_deviation_pct
        FROM dr""",
        DAILY,
        rated,
    )
    change = pct("(dau - prev_dau)", "prev_dau", None)
    q["dod_attribution"] = on_events(
        f"""SELECT date, dau, pv_count, buy_count, conversion_rate, buyer_count, is_weekend,
        {rnd(change, 2)} AS dau_change_pct,
        CASE WHEN is_weekend = 1 AND dau > prev_dau THEN 'weekend_up' WHEN is_weekend = 1 AND dau < prev_dau THEN 'weekend_down'
             WHEN is_weekend = 0 AND ABS({change}) > 10 THEN 'weekday_swing' ELSE 'normal' END AS possible_reason
        FROM (SELECT *, {big("isodow(date) >= 6")} AS is_weekend, LAG(dau) OVER (ORDER BY date) AS prev_dau FROM dr)""",
        DAILY,
        rated,
    )
    hz, hrz = _z("hourly_uv", "(PARTITION BY hour)"), _z("conversion_rate", "(PARTITION BY hour)")
    q["hourly_anomalies"] = on_events(
        f"""SELECT date, hour, hourly_uv, conversion_rate, {rnd("(AVG(hourly_uv) OVER (PARTITION BY hour))", 2)} AS expected_uv,
        {rnd(hz, 2)} AS uv_zscore, {rnd("(AVG(conversion_rate) OVER (PARTITION BY hour))", 4)} AS expected_rate,
        CASE WHEN ABS({hz}) > 2 THEN 'uv' WHEN ABS({hrz}) > 2 THEN 'conversion' ELSE 'normal' END AS hourly_anomaly
        FROM (SELECT *, {ratio("buy_count", "pv_count")} AS conversion_rate FROM hr)
        ORDER BY {rnd(f"ABS({hz})", 6)} DESC NULLS LAST, date, hour LIMIT 20""",
        hourly,
    )
    return q


