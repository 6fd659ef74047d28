"""Check SQL for segments, experiments and quality queries."""

from __future__ import annotations

from trailmark.plans.check_kpi import COHORT, DAILY, FUNNEL, RETENTION, checks as kpi_checks
from trailmark.plans.sqltext import big, erfc, n_of, on_days, on_events, pct, ratio, rnd, total

ALL4 = ("pv_count", "fav_count", "cart_count", "buy_count")
AS_OF = "DATE '2024-01-30'"

USERS = f"""us AS (
  SELECT user_id, CAST({AS_OF} - MAX(date) AS BIGINT) AS recency_days, {total("total_actions", *ALL4)},
         COUNT(*) AS active_days, MIN(date) AS first_date, MAX(date) AS last_date
  FROM ud GROUP BY user_id)"""

RF = """rf0 AS (
  SELECT user_id, recency_days, total_actions, buy_count, active_days,
         6 - NTILE(5) OVER (ORDER BY recency_days, user_id) AS r_score,
         NTILE(5) OVER (ORDER BY total_actions, user_id) AS f_score_actions,
         NTILE(5) OVER (ORDER BY buy_count, user_id) AS f_score_buy
  FROM us),
rf AS (
  SELECT *, r_score + f_score_actions AS rf_score,
         CASE WHEN r_score >= 4 AND f_score_actions >= 4 THEN 'high_value'
              WHEN r_score >= 3 AND f_score_actions >= 3 THEN 'active'
              WHEN r_score >= 3 AND f_score_actions <= 2 THEN 'new_or_returning'
              WHEN r_score <= 2 AND f_score_actions >= 3 THEN 'dormant' ELSE 'churn_risk' END AS user_segment,
         CASE WHEN buy_count > 0 THEN 'purchased' ELSE 'not_purchased' END AS purchase_status
  FROM rf0)"""

RFM_SCORES = """6 - NTILE(5) OVER (ORDER BY recency, user_id) AS r_score,
  6 - NTILE(5) OVER (ORDER BY frequency DESC, user_id) AS f_score,
  6 - NTILE(5) OVER (ORDER BY monetary DESC, user_id) AS m_score"""

RFM = f"""rfm AS (
  SELECT *, {RFM_SCORES} FROM (
    SELECT user_id, recency_days AS recency, active_days AS frequency, buy_count AS monetary FROM us))"""

STATS = f"""st AS (
  SELECT user_id, COUNT(*) AS total_actions, {", ".join(f"{n_of(b)} AS {b}_count" for b in ("pv", "fav", "cart", "buy"))},
         MIN(date) AS first_active_date, MAX(date) AS last_active_date, COUNT(DISTINCT item_id) AS unique_items,
         COUNT(DISTINCT category_id) AS unique_categories, COUNT(DISTINCT date) AS active_days
  FROM ub GROUP BY user_id)"""

SEGMENTS = f"""seg0 AS (
  SELECT *, {RFM_SCORES} FROM (
    SELECT user_id, CAST({AS_OF} - last_active_date AS BIGINT) AS recency, active_days AS frequency, buy_count AS monetary,
           first_active_date, last_active_date, pv_count, cart_count, fav_count, unique_items, unique_categories FROM st)),
seg AS (
  SELECT *,
    CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'champion'
         WHEN r_score >= 4 AND f_score >= 4 THEN 'develop' WHEN r_score >= 4 AND m_score >= 4 THEN 'keep'
         WHEN r_score >= 4 THEN 'retain' WHEN f_score >= 4 AND m_score >= 4 THEN 'general_value'
         WHEN f_score >= 4 THEN 'general_develop' WHEN m_score >= 4 THEN 'general_keep' ELSE 'churn_risk' END AS rfm_segment,
    CASE WHEN r_score + f_score + m_score >= 13 THEN 'high' WHEN r_score + f_score + m_score >= 9 THEN 'mid' ELSE 'low' END AS value_tier,
    CASE WHEN recency = 0 THEN 'today' WHEN recency <= 2 THEN 'recent' WHEN recency <= 5 THEN 'normal' ELSE 'dormant' END AS activity_label,
    CASE WHEN monetary > 0 AND cart_count > 0 AND fav_count > 0 THEN 'full_path' WHEN monetary > 0 AND cart_count > 0 THEN 'cart_buyer'
         WHEN monetary > 0 AND fav_count > 0 THEN 'fav_buyer' WHEN monetary > 0 THEN 'direct_buyer'
         WHEN cart_count > 0 OR fav_count > 0 THEN 'intent' ELSE 'browser' END AS behavior_tag,
    CASE WHEN first_active_date >= DATE '2024-01-04' THEN 'new' WHEN monetary > 0 AND frequency >= 5 THEN 'mature'
         WHEN monetary > 0 THEN 'growing' WHEN frequency >= 3 THEN 'active' ELSE 'potential' END AS lifecycle_stage,
    COALESCE({pct("monetary", "pv_count")}, 0e0) AS personal_conversion_rate
  FROM seg0)"""

PREFERRED = """pc AS (
  SELECT user_id, category_id AS preferred_category, n AS preferred_category_pv FROM (
    SELECT user_id, category_id, COUNT(*) AS n,
           ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, category_id) AS rn
    FROM ub WHERE behavior_type = 'pv' GROUP BY user_id, category_id) WHERE rn = 1)"""

PROFILE = f"""prof0 AS (
  SELECT s.user_id, total_actions, pv_count, fav_count, cart_count, buy_count, last_active_date, unique_items, unique_categories,
         CAST((SELECT MAX(date) FROM ub) - last_active_date AS BIGINT) AS recency_days, preferred_category, preferred_category_pv
  FROM st s LEFT JOIN pc ON s.user_id = pc.user_id),
prof1 AS (
  SELECT *, NTILE(10) OVER (ORDER BY total_actions, user_id) AS action_decile,
         NTILE(10) OVER (ORDER BY recency_days, user_id) AS recency_decile FROM prof0),
prof AS (
  SELECT *, CASE WHEN action_decile >= 8 AND buy_count > 0 AND recency_days <= 3 THEN 'high'
                 WHEN action_decile >= 5 AND recency_days <= 7 THEN 'normal'
                 WHEN recency_days > 7 AND recency_days <= 30 THEN 'dormant' WHEN recency_days > 30 THEN 'churned'
                 ELSE 'normal' END AS user_label,
         COALESCE({ratio("buy_count", "pv_count")}, 0e0) AS buy_conversion_rate FROM prof1)"""

LTV = f"""ltv AS (
  SELECT user_id, first_date, active_days, {", ".join(ALL4)}, value_score, value_score * (30e0 / (SELECT COUNT(DISTINCT date) FROM ub)) AS ltv_estimate,
         CAST((SELECT MAX(date) FROM ub) - last_date AS BIGINT) AS recency_days,
         CAST(last_date - first_date AS BIGINT) + 1 AS lifespan_days, {ratio("buy_count", "total_actions")} AS buy_conversion
  FROM (SELECT *, pv_count + 3 * fav_count + 5 * cart_count + 10 * buy_count AS value_score FROM us))"""

EDGES = """ed AS (SELECT quantile_cont(ltv_estimate, 0.2) AS q0, quantile_cont(ltv_estimate, 0.4) AS q1,
  quantile_cont(ltv_estimate, 0.6) AS q2, quantile_cont(ltv_estimate, 0.8) AS q3 FROM ltv)"""


def _tier(op: str) -> str:
    names = ("bottom_20", "20_40", "40_60", "60_80")
    return "CASE " + " ".join(f"WHEN ltv_estimate {op} q{i} THEN '{n}'" for i, n in enumerate(names)) + " ELSE 'top_20' END"


GROUP = "CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END"
HASH = "CASE WHEN strpos('02468ace', right(md5(CAST(user_id AS VARCHAR) || '_ab_test_v1'), 1)) > 0 THEN 'control' ELSE 'treatment' END"
PRE = "date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'"
POST = "date BETWEEN DATE '2024-01-22' AND DATE '2024-01-30'"


def _period(where: str) -> str:
    return f"""per AS (SELECT *, {GROUP} AS group_label, {ratio("buy_count", "pv_count")} AS conversion_rate FROM
      (SELECT user_id, {total("total_actions", *ALL4)} FROM ud WHERE {where} GROUP BY user_id))"""


def _period_summary(where: str) -> str:
    return on_days(
        f"""SELECT group_label, COUNT(*) AS sample_size, {rnd("AVG(total_actions)", 2)} AS avg_actions,
        {rnd("AVG(pv_count)", 2)} AS avg_pv, {rnd("AVG(buy_count)", 2)} AS avg_buy,
        {rnd("AVG(conversion_rate)", 4)} AS avg_conversion_rate, {rnd("STDDEV_POP(conversion_rate)", 4)} AS std_conversion_rate,
        MIN(conversion_rate) AS min_conversion_rate, MAX(conversion_rate) AS max_conversion_rate,
        {big("SUM(buy_count)")} AS total_buy, {big("SUM(pv_count)")} AS total_pv,
        {ratio("SUM(buy_count)", "SUM(pv_count)")} AS overall_conversion_rate FROM per GROUP BY 1""",
        _period(where),
    )


DIFF = f"""df0 AS (
  SELECT user_id, {GROUP} AS group_label,
    {", ".join(f"{big(f'SUM(CASE WHEN {w} THEN {b}_count ELSE 0 END)')} AS {p}_{b}_count" for p, w in (("pre", PRE), ("post", POST)) for b in ("buy", "pv"))}
  FROM ud GROUP BY user_id),
df1 AS (
  SELECT *, {", ".join(f"COALESCE({ratio(f'{p}_buy_count', f'{p}_pv_count')}, 0e0) AS {p}_conversion_rate" for p in ("pre", "post"))} FROM df0),
df AS (SELECT *, {rnd("(post_conversion_rate - pre_conversion_rate)", 4)} AS conversion_diff FROM df1)"""

ARMS = """arms AS (
  SELECT date, """ + ", ".join(
    f"COUNT(*) FILTER (WHERE {GROUP} = '{g}') AS n_{g}, COUNT(*) FILTER (WHERE {GROUP} = '{g}' AND buy_count > 0) AS x_{g}"
    for g in ("control", "treatment")
) + " FROM ud GROUP BY date)"


def z_test(frame: str, by: str) -> str:
    """SELECT over a frame with n_/x_ columns; shared with the recommender check."""
    return f"""SELECT {by}, {rnd("pc", 6)} AS control_rate, {rnd("pt", 6)} AS treatment_rate, {rnd("(pt - pc)", 6)} AS diff,
      {rnd("se", 6)} AS std_error, {rnd("zz", 6)} AS z,
      {rnd("(pt - pc - 1.96e0 * se)", 6)} AS ci_low, {rnd("(pt - pc + 1.96e0 * se)", 6)} AS ci_high,
      {rnd("((pt - pc) * 100 / NULLIF(pc, 0))", 4)} AS lift_pct, {rnd("pval", 9)} AS p_value,
      {big("pval < 0.05")} AS significant FROM (
      SELECT *, {erfc("zx")} AS pval FROM (
      SELECT *, ABS(zz) / sqrt(2e0) AS zx FROM (
      SELECT *, CASE WHEN se > 0 THEN (pt - pc) / se ELSE 0 END AS zz FROM (
      SELECT *, sqrt(p * (1 - p) * (1e0 / NULLIF(n_control, 0) + 1e0 / NULLIF(n_treatment, 0))) AS se FROM (
        SELECT *, {ratio("x_control", "n_control", None)} AS pc, {ratio("x_treatment", "n_treatment", None)} AS pt,
          (x_control + x_treatment) / NULLIF(CAST(n_control + n_treatment AS DOUBLE), 0) AS p FROM {frame})))))"""


def _by_segment() -> str:
    """Slices written out one by one; the least of all larger steps by a join of the slices."""
    slices = {"'all'": "'all'", "'rf_segment'": "user_segment", "'time_period'": "time_period", "'category'": "CAST(category_id AS VARCHAR)"}
    sliced = " UNION ALL ".join(
        f"""SELECT {name} AS dimension, {value} AS slice, user_id, MAX(CASE WHEN behavior_type = 'buy' THEN 1 ELSE 0 END) AS bought
        FROM ub JOIN (SELECT user_id, user_segment FROM rf) USING (user_id) GROUP BY ALL"""
        for name, value in slices.items()
    )
    counts = ", ".join(
        f"COUNT(*) FILTER (WHERE {GROUP} = '{g}') AS n_{g}, COUNT(*) FILTER (WHERE {GROUP} = '{g}' AND bought = 1) AS x_{g}"
        for g in ("control", "treatment")
    )
    arms = f"sarms AS (SELECT dimension, slice, {counts} FROM ({sliced}) GROUP BY 1, 2)"
    tested = f"tested AS ({z_test('sarms', 'dimension, slice')})"
    steps = """steps AS (SELECT *, p_value * COUNT(p_value) OVER ()
        / ROW_NUMBER() OVER (ORDER BY p_value NULLS LAST, dimension, slice) AS step,
        ROW_NUMBER() OVER (ORDER BY p_value NULLS LAST, dimension, slice) AS no FROM tested)"""
    least = "(CASE WHEN p_value IS NOT NULL THEN (SELECT LEAST(MIN(b.step), 1e0) FROM steps b WHERE b.no >= a.no) END)"
    return on_days(
        f"""SELECT * EXCLUDE (adj), {rnd("adj", 9)} AS p_adjusted, {big(f"{rnd('adj', 9)} <= 0.05")} AS discovery
        FROM (SELECT * EXCLUDE (step, no), {least} AS adj FROM steps a)""",
        USERS, RF, arms, tested, steps,
    )


def _expectations() -> str:
    """One row per check; predicates written out independently of the library."""
    row = []

    def add(table: str, source: str, name: str, where: str, severity: str = "error"):
        row.append(
            f"SELECT '{table}' AS table_name, '{name}' AS check_name, '{severity}' AS severity, COUNT(*) AS violations "
            f"FROM {source} WHERE {where}"
        )

    for c in ("user_id", "item_id", "behavior_type", "date"):
        add("stg_user_behavior", "ub", f"not_null_{c}", f"{c} IS NULL")
    add("stg_user_behavior", "ub", "accepted_values_behavior_type", "behavior_type NOT IN ('pv','fav','cart','buy')")
    add("stg_user_behavior", "ub", "accepted_values_is_weekend", "is_weekend NOT IN (0, 1)")
    add("stg_user_behavior", "ub", "valid_timestamp",
        "timestamp NOT BETWEEN 1704067200 AND 1706659199 OR date NOT BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'")
    add("stg_user_behavior", "(SELECT COUNT(*) AS n FROM ub GROUP BY user_id, item_id, date)", "no_abnormal_repeat", "n > 100")
    for c in ("user_id", "date"):
        add("int_user_daily_metrics", "ud", f"not_null_{c}", f"{c} IS NULL")
    add("int_user_daily_metrics", "ud", "non_negative", " OR ".join(f"{c} < 0" for c in ALL4))
    add("int_user_daily_metrics", "ud", "bounded_conversion_rate", f"{ratio('buy_count', 'pv_count')} > 100")
    add("int_user_retention", "ret", "not_null_date", "date IS NULL")
    add("int_user_retention", "(SELECT COUNT(*) AS n FROM ret GROUP BY date)", "unique_date", "n > 1")
    add("int_user_retention", "ret", "non_negative", "new_users < 0 OR retained_d1 < 0 OR retained_d3 < 0 OR retained_d7 < 0")
    rates = [f"retention_d{n}_rate" for n in (1, 3, 7)]
    add("int_user_retention", "ret", "bounded_" + "_".join(rates), " OR ".join(f"{c} > 100" for c in rates))
    add("int_conversion_funnel", "fun", "not_null_date", "date IS NULL")
    add("int_conversion_funnel", "(SELECT COUNT(*) AS n FROM fun GROUP BY date)", "unique_date", "n > 1")
    add("int_conversion_funnel", "fun", "non_negative", " OR ".join(f"{b}_users < 0" for b in ("pv", "fav", "cart", "buy")))
    add("int_conversion_funnel", "fun", "funnel_monotonic",
        "pv_users < fav_users OR pv_users < cart_users OR pv_users < buy_users OR cart_users < buy_users", "warn")
    add("int_user_behavior_summary", "us", "not_null_user_id", "user_id IS NULL")
    add("int_user_behavior_summary", "(SELECT COUNT(*) AS n FROM us GROUP BY user_id)", "unique_user_id", "n > 1")
    add("mart_daily_kpi", "daily", "not_null_date", "date IS NULL")
    add("mart_daily_kpi", "(SELECT COUNT(*) AS n FROM daily GROUP BY date)", "unique_date", "n > 1")
    add("mart_user_segments", "seg", "not_null_user_id", "user_id IS NULL")
    add("mart_user_segments", "(SELECT COUNT(*) AS n FROM seg GROUP BY user_id)", "unique_user_id", "n > 1")
    for s, m in (("f_score", "frequency"), ("m_score", "monetary")):
        add("mart_user_segments",
            f"(SELECT a.m AS lo, b.m AS hi FROM (SELECT {s} AS s, AVG({m}) AS m FROM seg GROUP BY 1) a "
            f"JOIN (SELECT {s} AS s, AVG({m}) AS m FROM seg GROUP BY 1) b ON b.s = a.s + 1)", f"{s}_direction", "hi <= lo")
    add("mart_rfm_segments", "rfm", "not_null_user_id", "user_id IS NULL")
    for c in ("cohort_date", "day_diff"):
        add("mart_user_retention", "co", f"not_null_{c}", f"day_diff IN (1, 3, 7) AND {c} IS NULL")
    return on_days("\nUNION ALL ".join(row), COHORT, RETENTION, FUNNEL, DAILY, USERS, STATS, SEGMENTS, RFM)


def checks() -> dict[str, str]:
    q: dict[str, str] = {}
    rf_cols = """user_id, recency_days, total_actions, buy_count, active_days, r_score, f_score_actions, f_score_buy,
      rf_score, user_segment, purchase_status"""
    q["rf_scores"] = on_days(
        f"SELECT {rf_cols} FROM rf ORDER BY rf_score DESC, buy_count DESC, user_id LIMIT 50", USERS, RF
    )
    q["rf_scores_all"] = on_days(f"SELECT {rf_cols} FROM rf", USERS, RF)
    q["rf_segment_summary"] = on_days(
        f"""SELECT user_segment, COUNT(*) AS user_count, {rnd("AVG(recency_days)", 2)} AS avg_recency_days,
        {rnd("AVG(total_actions)", 2)} AS avg_actions, {rnd("AVG(buy_count)", 2)} AS avg_buy_count,
        {rnd("AVG(active_days)", 2)} AS avg_active_days, {big("SUM(buy_count)")} AS total_buy_count,
        {pct("COUNT(*)", "SUM(COUNT(*)) OVER ()")} AS pct_of_total,
        {pct("SUM(buy_count)", "SUM(SUM(buy_count)) OVER ()")} AS buy_contribution_pct FROM rf GROUP BY 1""",
        USERS,
        RF,
    )

    def quart(c: str) -> str:
        def at(k: int) -> str:
            return f"(SELECT CAST({c} AS DOUBLE) FROM (SELECT {c}, ROW_NUMBER() OVER (ORDER BY {c}) AS rn, COUNT(*) OVER () AS n FROM us) WHERE rn = n * {k} // 4 + 1)"

        return f"""SELECT '{c}' AS metric, CAST(MIN({c}) AS DOUBLE) AS min_val, {rnd(f"AVG({c})", 2)} AS avg_val,
          CAST(MAX({c}) AS DOUBLE) AS max_val, {at(1)} AS q1, {at(2)} AS median, {at(3)} AS q3 FROM us"""

    q["rf_quartiles"] = on_days(
        " UNION ALL ".join(quart(c) for c in ("recency_days", "total_actions", "buy_count")), USERS
    )

    def lifecycle(returning: str) -> str:
        return on_days(
            f"""SELECT CASE WHEN before IS NULL THEN 'first_active' {returning} WHEN after IS NULL THEN 'last_active'
            ELSE 'continuing' END AS lifecycle_status, COUNT(*) AS occurrence_count,
            {rnd("AVG(total_actions)", 2)} AS avg_daily_actions, {big("SUM(buy_count)")} AS total_daily_buy FROM
            (SELECT *, LAG(date) OVER w AS before, LEAD(date) OVER w AS after FROM ud WINDOW w AS (PARTITION BY user_id ORDER BY date))
            GROUP BY 1"""
        )

    q["lifecycle_states"] = lifecycle("")
    q["lifecycle_states_gap"] = lifecycle("WHEN date - before > 1 THEN 'returning'")
    q["mart_rfm_segments"] = on_days(
        """SELECT user_id, recency AS recency_days, frequency, monetary, r_score, f_score, m_score,
        r_score * 100 + f_score * 10 + m_score AS rfm_score,
        CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'high_value' WHEN r_score >= 3 AND f_score >= 3 THEN 'potential'
             WHEN r_score >= 4 AND f_score <= 2 THEN 'new' WHEN r_score <= 2 AND f_score >= 3 THEN 'churn_warning'
             WHEN r_score <= 2 AND f_score <= 2 THEN 'dormant' ELSE 'general' END AS segment_label FROM rfm""",
        USERS,
        RFM,
    )
    q["mart_user_segments"] = on_events("SELECT * FROM seg", STATS, SEGMENTS)
    q["user_stats"] = on_events("SELECT * FROM st", STATS)
    q["preferred_category"] = on_events("SELECT * FROM pc", PREFERRED)
    q["user_profile"] = on_events("SELECT * FROM prof", STATS, PREFERRED, PROFILE)
    q["profile_label_distribution"] = on_events(
        "SELECT user_label, COUNT(*) AS user_count FROM prof GROUP BY 1", STATS, PREFERRED, PROFILE
    )

    def bins(column: str, edges: list[tuple[str, str]]) -> str:
        return on_days(
            " UNION ALL ".join(
                f"SELECT {big(str(i + 1))} AS bin_no, '{label}' AS bin, COUNT(*) FILTER (WHERE {column} {cond}) AS user_count, "
                f"{pct(f'COUNT(*) FILTER (WHERE {column} {cond})', 'COUNT(*)')} AS user_pct FROM us"
                for i, (label, cond) in enumerate(edges)
            ),
            USERS,
        )

    q["purchase_segments"] = bins(
        "buy_count", [("none", "= 0"), ("1", "= 1"), ("2-3", "BETWEEN 2 AND 3"), ("4-10", "BETWEEN 4 AND 10"), (">10", "> 10")]
    )
    q["activity_bins"] = bins(
        "total_actions",
        [("0-10", "<= 10"), ("11-50", "BETWEEN 11 AND 50"), ("51-100", "BETWEEN 51 AND 100"), ("101-500", "BETWEEN 101 AND 500"), (">500", "> 500")],
    )
    q["rfm_monetary"] = f"""WITH b AS (
      SELECT o_custkey AS user_id, CAST((SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders) - MAX(CAST(o_orderdate AS DATE)) AS BIGINT) AS recency_days,
        COUNT(*) AS order_count, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS monetary FROM orders GROUP BY 1),
    t AS (SELECT *, 6 - {big("NTILE(5) OVER (ORDER BY recency_days, user_id)")} AS r_score,
      {big("NTILE(5) OVER (ORDER BY order_count, user_id)")} AS f_score, {big("NTILE(5) OVER (ORDER BY monetary, user_id)")} AS m_score FROM b)
    SELECT *, r_score + f_score + m_score AS rfm_score FROM t"""
    q["ltv_estimate"] = on_days("SELECT * FROM ltv", USERS, LTV)
    q["ltv_tiers"] = on_days(
        f"""SELECT tier, COUNT(*) AS user_count, SUM(ltv_estimate) AS total_ltv,
        {pct("SUM(ltv_estimate)", "SUM(SUM(ltv_estimate)) OVER ()")} AS contribution_pct
        FROM (SELECT *, {_tier("<=")} AS tier FROM ltv, ed) GROUP BY 1""",
        USERS,
        LTV,
        EDGES,
    )
    q["ltv_segment_summary"] = on_days(
        f"""SELECT ltv_segment, COUNT(*) AS user_count, {rnd("AVG(buy_count)", 4)} AS avg_buy_count,
        {rnd("AVG(active_days)", 4)} AS avg_active_days, {rnd("AVG(value_score)", 4)} AS avg_behavior_value,
        {rnd("AVG(ltv_estimate)", 4)} AS avg_ltv, SUM(ltv_estimate) AS total_ltv,
        {pct("COUNT(*)", "SUM(COUNT(*)) OVER ()")} AS user_pct, {pct("SUM(ltv_estimate)", "SUM(SUM(ltv_estimate)) OVER ()")} AS ltv_pct
        FROM (SELECT *, {_tier("<")} AS ltv_segment FROM ltv, ed) GROUP BY 1""",
        USERS,
        LTV,
        EDGES,
    )
    q["top_ltv_users"] = on_days(
        "SELECT user_id, buy_count, active_days, value_score, recency_days FROM ltv ORDER BY value_score DESC, user_id LIMIT 10",
        USERS,
        LTV,
    )
    x = ratio("m", "cac", None)
    q["cohort_ltv_cac"] = on_days(
        f"""SELECT c.cohort_date, user_count, {rnd("m", 4)} AS avg_ltv, total_ltv, avg_buys, cac, {rnd(x, 4)} AS ltv_cac_ratio,
        CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= 3 THEN 'healthy' WHEN {x} >= 1 THEN 'fair' ELSE 'poor' END AS health
        FROM (SELECT first_date AS cohort_date, COUNT(*) AS user_count, AVG(ltv_estimate) AS m, SUM(ltv_estimate) AS total_ltv,
              {rnd("AVG(buy_count)", 4)} AS avg_buys FROM ltv GROUP BY 1) c LEFT JOIN cac k ON c.cohort_date = k.d""",
        USERS,
        LTV,
        f"cac AS (SELECT CAST(ts AS DATE) AS d, {rnd('AVG(value)', 4)} AS cac FROM events WHERE event_type = 'signup' GROUP BY 1)",
    )

    # experiments
    q["assign_parity"] = on_events(f"SELECT DISTINCT user_id, {GROUP} AS group_label, user_id % 2 AS group_id FROM ub")
    q["assign_hash"] = on_events(f"SELECT DISTINCT user_id, {HASH} AS group_label FROM ub")
    q["ab_period_summary_pre"] = _period_summary(PRE)
    q["ab_period_summary_post"] = _period_summary(POST)
    diff_cols = """user_id, group_label, pre_conversion_rate, pre_buy_count, pre_pv_count, post_conversion_rate,
      post_buy_count, post_pv_count, conversion_diff"""
    q["ab_user_diff"] = on_days(f"SELECT {diff_cols} FROM df ORDER BY group_label, user_id LIMIT 20", DIFF)
    q["ab_user_diff_all"] = on_days(f"SELECT {diff_cols} FROM df", DIFF)
    q["ab_group_stats"] = on_days(
        f"""SELECT group_label, COUNT(*) AS n, {rnd("AVG(conversion_rate)", 4)} AS mean,
        {rnd("VAR_SAMP(conversion_rate)", 6)} AS variance, {rnd("STDDEV_SAMP(conversion_rate)", 6)} AS std_dev,
        {rnd("MIN(conversion_rate)", 4)} AS min_rate, {rnd("MAX(conversion_rate)", 4)} AS max_rate
        FROM per WHERE pv_count > 0 GROUP BY 1""",
        _period(POST),
    )
    q["ab_conversion"] = on_days(
        f"""SELECT {GROUP} AS group_label, COUNT(*) AS users, COUNT(*) FILTER (WHERE buy_count > 0) AS buyers,
        {ratio("COUNT(*) FILTER (WHERE buy_count > 0)", "COUNT(*)", 6)} AS conversion_rate FROM us GROUP BY 1""",
        USERS,
    )
    chi = "((n_control - t / 2) * (n_control - t / 2) / (t / 2) + (n_treatment - t / 2) * (n_treatment - t / 2) / (t / 2))"
    q["srm_check"] = on_days(
        f"""SELECT date, n_control, n_treatment, {rnd(chi, 6)} AS chi2, {big(f"{chi} <= 3.841458820694124")} AS balanced,
        {rnd(erfc("cx"), 9)} AS p_value
        FROM (SELECT *, sqrt({chi} / 2) AS cx FROM (SELECT *, CAST(n_control + n_treatment AS DOUBLE) AS t FROM arms))""",
        ARMS,
    )
    q["two_proportion_z"] = on_days(z_test("arms", "date"), ARMS)
    q["experiment_p_values"] = q["two_proportion_z"]
    q["experiment_by_segment"] = _by_segment()
    ec, et = "(n_control * b / t)", "(n_treatment * b / t)"
    gap = f"(ABS(x_control - {ec}) - LEAST(0.5e0, ABS(x_control - {ec})))"
    chi2 = (
        f"({gap} * {gap} * (1e0 / NULLIF({ec}, 0) + 1e0 / NULLIF({et}, 0) + 1e0 / NULLIF(n_control - {ec}, 0) "
        f"+ 1e0 / NULLIF(n_treatment - {et}, 0)))"
    )
    q["chi2_contingency"] = on_days(
        f"""SELECT date, {rnd(ec, 6)} AS expected_control, {rnd(et, 6)} AS expected_treatment, {rnd(chi2, 6)} AS chi2,
        {big(f"{chi2} > 3.841458820694124")} AS dependent, {rnd(erfc("cx"), 9)} AS p_value
        FROM (SELECT *, sqrt({chi2} / 2) AS cx FROM (
        SELECT *, CAST(n_control + n_treatment AS DOUBLE) AS t, CAST(x_control + x_treatment AS DOUBLE) AS b FROM arms))""",
        ARMS,
    )
    need = "((1.959963984540054e0 + 0.8416212335729143e0) * sqrt(pc * (1 - pc) + pt * (1 - pt)) / NULLIF(ABS(pc - pt), 0))"
    rates = f"""rates AS (SELECT *, {ratio("x_control", "n_control", None)} AS pc, {ratio("x_treatment", "n_treatment", None)} AS pt FROM arms)"""
    q["required_sample_size"] = on_days(
        f"""SELECT date, {rnd(f"({need} * {need})", 4)} AS required_per_arm,
        COALESCE({big(f"LEAST(n_control, n_treatment) >= {need} * {need}")}, 0) AS sufficient FROM rates""",
        ARMS,
        rates,
    )
    half = "(1.959963984540054e0 * sqrt(p * (1 - p) / NULLIF(users, 0)))"
    q["proportion_ci"] = on_days(
        f"""SELECT date, group_label, users, buyers, {rnd("p", 6)} AS rate, {rnd(f"(p - {half})", 6)} AS ci_low,
        {rnd(f"(p + {half})", 6)} AS ci_high FROM (SELECT *, buyers / CAST(users AS DOUBLE) AS p FROM
        (SELECT date, {GROUP} AS group_label, COUNT(*) AS users, COUNT(*) FILTER (WHERE buy_count > 0) AS buyers FROM ud GROUP BY ALL))"""
    )
    q["cohens_h"] = on_days(
        f"SELECT date, {rnd('(2 * (asin(sqrt(pt)) - asin(sqrt(pc))))', 6)} AS cohens_h FROM rates", ARMS, rates
    )
    parts = []
    for g in ("control", "treatment"):
        for name, c in (("post", "post_conversion_rate"), ("diff", "conversion_diff")):
            f = f"FILTER (WHERE group_label = '{g}')"
            parts.append(f"AVG({c}) {f} AS m_{name}_{g}, VAR_SAMP({c}) {f} AS v_{name}_{g}")
        parts.append(f"COUNT(*) FILTER (WHERE group_label = '{g}') AS n_{g}")

    def welch(name: str) -> tuple[str, str, str]:
        a, b = f"(v_{name}_treatment / n_treatment)", f"(v_{name}_control / n_control)"
        gap_ = f"(m_{name}_treatment - m_{name}_control)"
        t = f"({gap_} / sqrt({a} + {b}))"
        dof = f"(({a} + {b}) * ({a} + {b}) / ({a} * {a} / (n_treatment - 1) + {b} * {b} / (n_control - 1)))"
        return rnd(gap_, 6), rnd(t, 4), rnd(dof, 2)

    post, did = welch("post"), welch("diff")
    q["welch_t_did"] = on_days(
        f"""SELECT n_control, n_treatment, {post[0]} AS post_diff, {post[1]} AS t_post, {post[2]} AS df_post,
        {did[0]} AS did, {did[1]} AS t_did, {did[2]} AS df_did FROM w""",
        DIFF,
        f"w AS (SELECT {', '.join(parts)} FROM df)",
    )

    q["raw_to_table"] = on_events("SELECT COUNT(*) AS row_count FROM ub")
    q["expectations"] = _expectations()
    head = kpi_checks()["headline_metrics"]
    q["reconcile_metrics"] = f"""WITH h AS ({head})
      SELECT 'pv_to_buy_pct' AS metric, pv_to_buy_pct AS actual, e.pv_to_buy AS expected, 'equal' AS comparison,
        {big("ABS(pv_to_buy_pct - e.pv_to_buy) <= 0.01")} AS passed FROM h, e
      UNION ALL SELECT 'dau_mean', dau_mean, e.dau, 'equal', {big("ABS(dau_mean - e.dau) <= 0.1")} FROM h, e
      UNION ALL SELECT 'retention_d1_pct', retention_d1_pct, e.d1, 'equal', {big("ABS(retention_d1_pct - e.d1) <= 0.01")} FROM h, e
      UNION ALL SELECT 'row_count', e.per_day, e.n, 'equal', {big("e.per_day = e.n")} FROM e"""
    q["reconcile_metrics"] = q["reconcile_metrics"].replace(
        "WITH h AS (",
        "WITH e AS ("
        + on_events(
            f"""SELECT {n_of("buy")} * 100 / CAST({n_of("pv")} AS DOUBLE) AS pv_to_buy,
            (SELECT AVG(d) FROM (SELECT COUNT(DISTINCT user_id) AS d FROM ub GROUP BY date)) AS dau,
            (SELECT COUNT(DISTINCT CASE WHEN b.date = f.f + 1 THEN b.user_id END) * 100 / CAST(COUNT(DISTINCT b.user_id) AS DOUBLE)
             FROM ub b JOIN (SELECT user_id, MIN(date) AS f FROM ub GROUP BY 1) f ON b.user_id = f.user_id) AS d1,
            CAST((SELECT SUM(n) FROM (SELECT COUNT(*) AS n FROM ub GROUP BY user_id, date)) AS DOUBLE) AS per_day,
            CAST(COUNT(*) AS DOUBLE) AS n FROM ub"""
        )
        + "),\nh AS (",
        1,
    )
    figures = [
        ("headline", head, [(c, c) for c in (
            "dau_mean", "pv_to_buy_pct", "pv_to_cart_pct", "cart_to_buy_pct", "retention_d1_pct",
            "zero_conversion_items", "zero_conversion_item_share_pct",
        )]),
        ("reconciliation", q["reconcile_metrics"], [("metrics", "COUNT(*)"), ("passed", "SUM(passed)")]),
        ("experiment", q["two_proportion_z"], [
            ("days", "COUNT(*)"), ("significant_days", "COUNT(*) FILTER (WHERE p_value < 0.05)"),
        ]),
        ("experiment", q["srm_check"], [("unbalanced_days", "COUNT(*) FILTER (WHERE balanced = 0)")]),
    ]
    q["run_summary"] = "\nUNION ALL ".join(
        f"SELECT '{section}' AS section, '{metric}' AS metric, CAST({value} AS DOUBLE) AS value FROM ({sql})"
        for section, sql, values in figures for metric, value in values
    )
    q["validate_dataset"] = on_events(
        """SELECT 'missing columns' AS "check", c AS detail, CAST(1 AS BIGINT) AS violations
        FROM (VALUES ('date'), ('hour'), ('day_of_week'), ('is_weekend'), ('time_period')) t(c)
        UNION ALL SELECT 'unknown behaviour', 'behavior_type', COUNT(*) FROM raw
        WHERE behavior_type NOT IN ('pv', 'fav', 'cart', 'buy')"""
    )
    return q
