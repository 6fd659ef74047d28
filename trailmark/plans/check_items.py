"""Check SQL for product, recommender and churn queries."""

from __future__ import annotations

from trailmark.plans.check_users import HASH, z_test
from trailmark.plans.sqltext import big, n_of, on_events, on_orders, pct, ratio, rnd

ITEMS = f"""it AS (
  SELECT item_id, category_id, {", ".join(f"{n_of(b)} AS {b}_count" for b in ("pv", "fav", "cart", "buy"))},
         COUNT(DISTINCT CASE WHEN behavior_type = 'buy' THEN user_id END) AS buyer_count
  FROM ub GROUP BY ALL)"""

ITEM_ONLY = f"""io AS (SELECT item_id, {n_of("pv")} AS pv_count, {n_of("buy")} AS buy_count FROM ub GROUP BY 1)"""

CATS = f"""ca AS (
  SELECT category_id, {", ".join(f"{n_of(b)} AS {b}_count" for b in ("pv", "fav", "cart", "buy"))},
         COUNT(DISTINCT item_id) AS item_count,
         COUNT(DISTINCT CASE WHEN behavior_type = 'buy' THEN user_id END) AS buyer_count
  FROM ub GROUP BY 1)"""


def positional_median(table: str, column: str) -> str:
    return f"(SELECT {column} FROM (SELECT {column}, ROW_NUMBER() OVER (ORDER BY {column}) AS rn, COUNT(*) OVER () AS n FROM {table}) WHERE rn = n // 2 + 1)"


def _pairs(source: str) -> str:
    return f"""SELECT item_a, item_b, cat_a, cat_b, co_buy_count, {big("RANK() OVER (ORDER BY co_buy_count DESC)")} AS pair_rank FROM (
      SELECT a.item_id AS item_a, b.item_id AS item_b, a.category_id AS cat_a, b.category_id AS cat_b, COUNT(*) AS co_buy_count
      FROM bought a JOIN bought b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY ALL)
      ORDER BY co_buy_count DESC, item_a, cat_a, item_b, cat_b LIMIT 20"""


def _bought(source: str) -> str:
    return f"bought AS (SELECT DISTINCT user_id, item_id, category_id FROM {source} WHERE behavior_type = 'buy')"


def _cosine(rows: str, item: str, basket: str, prefix: str = "") -> str:
    """CTEs <p>pairs (i, j, together, near, sim) over distinct (item, basket) rows; ``near`` ranks."""
    return f"""{prefix}cnt AS (SELECT {item} AS i, COUNT(*) AS n FROM {rows} GROUP BY 1),
{prefix}pairs AS (
  SELECT p.i, p.j, together, together * together / CAST(b.n AS DOUBLE) AS near, {rnd("(together / sqrt(a.n * CAST(b.n AS DOUBLE)))", 9)} AS sim
  FROM (SELECT x.{item} AS i, y.{item} AS j, COUNT(*) AS together
        FROM {rows} x JOIN {rows} y ON x.{basket} = y.{basket} AND x.{item} <> y.{item} GROUP BY ALL) p
  JOIN {prefix}cnt a ON p.i = a.i JOIN {prefix}cnt b ON p.j = b.i)"""


def _item_recs(history: str, pairs: str) -> str:
    return f"""SELECT user_id, j AS item_id, score, rank_no FROM (
      SELECT *, {big("ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, j)")} AS rank_no FROM (
        SELECT h.user_id, p.j, MAX(p.sim) AS score FROM {history} h JOIN {pairs} p ON h.item_id = p.i
        WHERE NOT EXISTS (SELECT 1 FROM {history} o WHERE o.user_id = h.user_id AND o.item_id = p.j)
        GROUP BY ALL)) WHERE rank_no <= 10"""


MATRIX = """b0 AS (SELECT DISTINCT user_id, item_id FROM pu),
m AS (
  SELECT * FROM b0
  WHERE user_id IN (SELECT user_id FROM b0 GROUP BY 1 HAVING COUNT(*) >= 2)
    AND item_id IN (SELECT item_id FROM b0 GROUP BY 1 HAVING COUNT(*) >= 2)),
""" + _cosine("m", "user_id", "item_id", "u")

NEAREST = """nn AS (
  SELECT i AS user_id, j AS other, sim FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY i ORDER BY near DESC, j) AS rn FROM upairs) WHERE rn <= 10)"""

CAND = f"""cand AS (
  SELECT nn.user_id, m.item_id, {rnd("(SUM(CAST(floor(sim * 1e9 + 0.5) AS BIGINT)) / 1e9)", 6)} AS score FROM nn JOIN m ON nn.other = m.user_id GROUP BY ALL)"""


def _top(scores: str, n: int) -> str:
    return f"""SELECT user_id, item_id, score, rank_no FROM (
      SELECT *, {big("ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, item_id)")} AS rank_no FROM {scores})
      WHERE rank_no <= {n}"""


WEIGHT = "CASE behavior_type WHEN 'pv' THEN 1 WHEN 'fav' THEN 2 WHEN 'cart' THEN 3 WHEN 'buy' THEN 5 ELSE 0 END"


def _ratings(source: str) -> str:
    return f"rt AS (SELECT user_id, item_id, {big(f'SUM({WEIGHT})')} AS rating FROM {source} GROUP BY ALL)"


POPULAR = f"""pop AS (SELECT item_id, {big("SUM(rating)")} AS popularity FROM rt GROUP BY 1),
pr AS (
  SELECT u.user_id, p.item_id, popularity, {big("ROW_NUMBER() OVER (PARTITION BY u.user_id ORDER BY popularity DESC, p.item_id)")} AS rank_no
  FROM (SELECT DISTINCT user_id FROM rt) u, pop p
  WHERE NOT EXISTS (SELECT 1 FROM rt WHERE rt.user_id = u.user_id AND rt.item_id = p.item_id))"""


def _churn(inside: str, end: str, label: str) -> str:
    def n(b: str) -> str:
        return f"COUNT(*) FILTER (WHERE {inside} AND behavior_type = '{b}')"

    conv = ", ".join(
        f"{rnd(f'(CAST(total_{b} AS DOUBLE) / (total_pv + 0.001e0))', 6)} AS {b}_conversion" for b in ("buy", "cart", "fav")
    )
    return f"""ch0 AS (
      SELECT user_id, {", ".join(f"{n(b)} AS total_{b}" for b in ("pv", "fav", "cart", "buy"))},
        COUNT(DISTINCT CASE WHEN {inside} THEN date END) AS active_days, COUNT(DISTINCT CASE WHEN {inside} THEN hour END) AS active_hours,
        MAX(CASE WHEN {inside} THEN date END) AS last_date, COUNT(*) FILTER (WHERE {inside}) AS events,
        COUNT(*) FILTER (WHERE {inside} AND is_weekend = 1) AS we, COUNT(*) FILTER (WHERE NOT ({inside})) AS later
      FROM ub GROUP BY user_id),
    ch AS (
      SELECT user_id, total_pv, total_fav, total_cart, total_buy, active_days, active_hours, last_date,
        CAST({end} - last_date AS BIGINT) AS recency_days, {ratio("we", "events", 6)} AS weekend_ratio, {conv},
        {big(label)} AS churn FROM ch0 WHERE events > 0)"""


CHURN = _churn("date <= DATE '2024-01-29'", "DATE '2024-01-29'", "later = 0")

PRED = """pred AS (
  SELECT churn AS label, CAST(recency_days AS DOUBLE) / (recency_days + active_days) AS score,
         CASE WHEN recency_days > 1 THEN 1 ELSE 0 END AS predicted FROM ch)"""

CURVE = """g AS (SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM pred GROUP BY 1),
cu AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER () AS p, SUM(neg) OVER () AS n
       FROM g WINDOW w AS (ORDER BY score DESC))"""


def checks() -> dict[str, str]:
    q: dict[str, str] = {}
    conv = ratio("buy_count", "pv_count")
    q["top_items"] = on_events(
        f"""SELECT item_id, category_id, buy_count, pv_count, buyer_count, {conv} AS conversion_rate,
        {big("RANK() OVER (ORDER BY buy_count DESC)")} AS buy_rank, {big("DENSE_RANK() OVER (ORDER BY buy_count DESC)")} AS buy_dense_rank
        FROM it ORDER BY buy_count DESC, item_id, category_id LIMIT 20""",
        ITEMS,
    )
    q["top_categories"] = on_events(
        f"""SELECT *, pv_rank - buy_rank AS rank_diff FROM (
        SELECT *, {conv} AS category_conversion_rate, {ratio("buy_count", "buyer_count", 2)} AS avg_buy_per_buyer,
        {big("RANK() OVER (ORDER BY buy_count DESC)")} AS buy_rank, {big("RANK() OVER (ORDER BY pv_count DESC)")} AS pv_rank FROM ca)
        ORDER BY buy_count DESC, category_id LIMIT 10""",
        CATS,
    )
    q["top_conversion_items"] = on_events(
        f"""SELECT item_id, category_id, pv_count, buy_count, buyer_count, conversion_rate,
        {big("RANK() OVER (ORDER BY conversion_rate DESC)")} AS conversion_rank, {big("RANK() OVER (ORDER BY buy_count DESC)")} AS buy_rank
        FROM (SELECT *, {conv} AS conversion_rate FROM it WHERE pv_count >= 15)
        ORDER BY conversion_rate DESC, pv_count DESC, item_id, category_id LIMIT 20""",
        ITEMS,
    )
    q["long_tail_items"] = on_events(
        f"""SELECT item_id, category_id, pv_count, buy_count, cart_count, fav_count, c AS conversion_rate,
        CASE WHEN c < 0.001 THEN 'high_views_no_conversion' WHEN c < 0.005 THEN 'high_views_low_conversion'
             WHEN pv_count > (SELECT AVG(pv_count) FROM it) * 2 AND buy_count < (SELECT AVG(buy_count) FROM it) THEN 'wasted_traffic'
             ELSE 'normal' END AS long_tail_flag,
        CASE WHEN cart_count + fav_count > 0 AND buy_count = 0 THEN 'intent_without_purchase' ELSE 'converted_or_no_intent' END AS intent_no_convert
        FROM (SELECT *, {conv} AS c FROM it) WHERE pv_count > {positional_median("it", "pv_count")}
        ORDER BY pv_count DESC, c, item_id, category_id LIMIT 30""",
        ITEMS,
    )
    q["category_efficiency"] = on_events(
        f"""SELECT category_id, sku_count, pv_count, buy_count, {rnd("b", 6)} AS benchmark_rate, {rnd("r", 4)} AS conversion_rate,
        {rnd("(r - b)", 4)} AS rate_diff, {rnd("((r - b) * 100 / b)", 2)} AS rate_diff_pct,
        CASE WHEN r > b * 1.5e0 THEN 'excellent' WHEN r > b THEN 'good' WHEN r > b * 0.5e0 THEN 'fair' ELSE 'poor' END AS category_grade,
        {ratio("pv_count", "sku_count", 2)} AS avg_pv_per_sku, {big("RANK() OVER (ORDER BY r DESC)")} AS conversion_rank FROM (
        SELECT category_id, item_count AS sku_count, pv_count, buy_count, buy_count / CAST(pv_count AS DOUBLE) AS r,
          CAST(SUM(buy_count) OVER () AS DOUBLE) / CAST(SUM(pv_count) OVER () AS DOUBLE) AS b FROM ca WHERE pv_count >= 100)""",
        CATS,
    )
    q["co_purchase_pairs"] = on_events(_pairs("ub"), _bought("ub"))
    q["co_purchase_pairs_orders"] = on_orders(_pairs("pu"), _bought("pu"))
    q["item_scatter"] = on_events("SELECT * FROM io WHERE pv_count > 0", ITEM_ONLY)
    zero = "COUNT(*) FILTER (WHERE buy_count = 0)"
    q["zero_conversion_items"] = on_events(
        f"SELECT COUNT(*) AS viewed_items, {zero} AS zero_conversion_items, {pct(zero, 'COUNT(*)')} AS share_pct FROM io WHERE pv_count > 0",
        ITEM_ONLY,
    )
    over = f"COUNT(*) FILTER (WHERE buy_count = 0 AND pv_count > {positional_median('io', 'pv_count')})"
    q["zero_conversion_over_median"] = on_events(
        f"SELECT all_items, z AS zero_conversion_items, {pct('z', 'all_items')} AS share_pct FROM (SELECT COUNT(*) AS all_items, {over} AS z FROM io)",
        ITEM_ONLY,
    )
    q["top_n_contribution"] = on_events(
        f"""SELECT top_buys, all_buys, {pct("top_buys", "all_buys")} AS share_pct FROM (
        SELECT (SELECT {big("SUM(buy_count)")} FROM (SELECT buy_count FROM io ORDER BY buy_count DESC, item_id LIMIT 20)) AS top_buys,
               (SELECT {big("SUM(buy_count)")} FROM io) AS all_buys)""",
        ITEM_ONLY,
    )

    # recommenders
    q["implicit_ratings"] = on_events("SELECT * FROM rt WHERE rating > 0", _ratings("ub"))
    q["active_buyer_ratings"] = on_events(
        """SELECT * FROM rt WHERE user_id IN (SELECT user_id FROM ub WHERE behavior_type = 'buy' GROUP BY 1
        HAVING COUNT(*) >= 2)""",
        _ratings("ub"),
    )
    q["index_ids"] = on_events(
        """SELECT user_id, item_id, rating, CAST(DENSE_RANK() OVER (ORDER BY user_id) - 1 AS INTEGER) AS user_idx,
        CAST(DENSE_RANK() OVER (ORDER BY item_id) - 1 AS INTEGER) AS item_idx FROM rt""",
        _ratings("ub"),
    )
    q["split_ratings"] = on_events(
        """SELECT *, CAST('0x' || left(md5(CAST(user_id AS VARCHAR) || '_' || CAST(item_id AS VARCHAR) || '_42'), 8) AS BIGINT) % 10000 < 8000
        AS is_train FROM rt""",
        _ratings("ub"),
    )
    q["item_cf_similarity"] = on_orders(
        f"""SELECT i AS item_id, j AS similar_item, together AS common_buyers, sim AS similarity, rank_no FROM (
        SELECT *, {big("ROW_NUMBER() OVER (PARTITION BY i ORDER BY near DESC, j)")} AS rank_no FROM pairs) WHERE rank_no <= 10""",
        "b0 AS (SELECT DISTINCT user_id, item_id FROM pu)",
        _cosine("b0", "item_id", "user_id"),
    )
    event_buys = "b0 AS (SELECT DISTINCT user_id, item_id FROM ub WHERE behavior_type = 'buy')"
    q["item_cf_recommend"] = on_events(
        _item_recs("b0", "pairs"), event_buys, _cosine("b0", "item_id", "user_id")
    )
    q["user_similarity"] = on_orders(
        f"""SELECT i AS user_id, j AS similar_user, together AS common_items, sim AS similarity, rank_no FROM (
        SELECT *, {big("ROW_NUMBER() OVER (PARTITION BY i ORDER BY near DESC, j)")} AS rank_no FROM upairs) WHERE rank_no <= 10""",
        MATRIX,
    )
    q["user_cf_recommend"] = on_orders(
        _top("(SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = c.user_id AND m.item_id = c.item_id))", 5),
        MATRIX,
        NEAREST,
        CAND,
    )
    q["popularity_recommend"] = on_events("SELECT * FROM pr WHERE rank_no <= 10", _ratings("ub"), POPULAR)
    q["popularity_recommend_orders"] = on_orders("SELECT * FROM pr WHERE rank_no <= 10", _ratings("pu"), POPULAR)
    q["leave_one_out_eval"] = on_orders(
        f"""SELECT evaluated_users, usercf_hits, popularity_hits, usercf_precision,
        {ratio("usercf_hits", "evaluated_users", 6)} AS usercf_recall, {ratio("popularity_hits", "evaluated_users", 6)} AS popularity_recall,
        CASE WHEN usercf_hits > 0 THEN 'usercf' ELSE 'popularity_fallback' END AS method,
        {ratio("CASE WHEN usercf_hits > 0 THEN usercf_hits ELSE popularity_hits END", "evaluated_users", 6)} AS hit_rate FROM (
        SELECT COUNT(*) AS evaluated_users, COUNT(*) FILTER (WHERE cf IS NOT NULL) AS usercf_hits,
          COUNT(*) FILTER (WHERE pop) AS popularity_hits, {rnd("AVG(CASE WHEN cf IS NOT NULL THEN 1e0 / recs ELSE 0e0 END)", 6)} AS usercf_precision
        FROM (SELECT h.user_id,
            (SELECT rank_no FROM cf WHERE cf.user_id = h.user_id AND cf.item_id = h.item_id) AS cf,
            (SELECT COUNT(*) FROM cf WHERE cf.user_id = h.user_id) AS recs,
            EXISTS (SELECT 1 FROM pp WHERE pp.user_id = h.user_id AND pp.item_id = h.item_id) AS pop FROM hid h))""",
        MATRIX,
        f"""hid AS (
          SELECT user_id, item_id FROM (
            SELECT pu.user_id, pu.item_id, ROW_NUMBER() OVER (PARTITION BY pu.user_id ORDER BY date DESC, pu.item_id DESC) AS rn
            FROM pu JOIN m ON pu.user_id = m.user_id AND pu.item_id = m.item_id)
          WHERE rn = 1 AND user_id IN (SELECT user_id FROM m GROUP BY 1 HAVING COUNT(*) >= 2)),
        tr AS (SELECT * FROM m WHERE user_id IN (SELECT user_id FROM hid)
          AND NOT EXISTS (SELECT 1 FROM hid WHERE hid.user_id = m.user_id AND hid.item_id = m.item_id)),
        hp AS (SELECT x.user_id, y.user_id AS other, COUNT(*) AS together FROM tr x JOIN m y ON x.item_id = y.item_id AND x.user_id <> y.user_id GROUP BY ALL),
        nn AS (SELECT user_id, other, {rnd("(together / sqrt(n * CAST(o AS DOUBLE)))", 9)} AS sim FROM (
          SELECT hp.*, a.n, b.n AS o, ROW_NUMBER() OVER (PARTITION BY hp.user_id ORDER BY together * together / CAST(b.n AS DOUBLE) DESC, other) AS rn
          FROM hp JOIN (SELECT user_id, COUNT(*) AS n FROM tr GROUP BY 1) a ON hp.user_id = a.user_id
          JOIN (SELECT user_id, COUNT(*) AS n FROM m GROUP BY 1) b ON other = b.user_id) WHERE rn <= 10)""",
        CAND,
        f"""
        cf AS ({_top("(SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.user_id = c.user_id AND tr.item_id = c.item_id))", 10)}),
        pc AS (SELECT item_id, COUNT(*) AS c FROM m GROUP BY 1),
        pp AS (SELECT user_id, item_id FROM (
          SELECT h.user_id, pc.item_id, ROW_NUMBER() OVER (PARTITION BY h.user_id
            ORDER BY CASE WHEN pc.item_id = h.item_id THEN c - 1 ELSE c END DESC, pc.item_id) AS rn
          FROM hid h, pc WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.user_id = h.user_id AND tr.item_id = pc.item_id)) WHERE rn <= 10)""",
    )
    q["matrix_sparsity"] = on_orders(
        f"""SELECT users, items, cells, {rnd("(1 - cells / (CAST(users AS DOUBLE) * items))", 6)} AS sparsity FROM (
        SELECT COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT item_id) AS items, COUNT(*) AS cells FROM rt)""",
        _ratings("pu"),
    )
    day = "DATE '2024-01-22'"
    side = ", ".join(
        f"COUNT(*) FILTER (WHERE g = '{g}') AS {g}_n, COUNT(*) FILTER (WHERE g = '{g}' AND pre > 0) AS n_{g}, "
        f"COUNT(*) FILTER (WHERE g = '{g}' AND pre > 0 AND post > 0) AS x_{g}"
        for g in ("control", "treatment")
    )
    q["recommender_lift"] = on_events(
        z_test(
            "ar",
            f"""control_n, treatment_n, n_control, n_treatment, x_control, x_treatment,
            {rnd("(2 * (control_n - (control_n + treatment_n) / 2e0) * (control_n - (control_n + treatment_n) / 2e0) / ((control_n + treatment_n) / 2e0))", 6)} AS srm_chi2,
            (SELECT COUNT(DISTINCT user_id) FROM recs) AS treatment_rec_total,
            (SELECT COUNT(DISTINCT r.user_id) FROM recs r JOIN later l ON r.user_id = l.user_id AND r.item_id = l.item_id) AS treatment_rec_hits""",
        ),
        f"""pre AS (SELECT *, {HASH} AS g FROM ub WHERE behavior_type = 'buy' AND date < {day}),
        later AS (SELECT DISTINCT user_id, item_id FROM ub WHERE behavior_type = 'buy' AND date >= {day}),
        les AS (SELECT DISTINCT user_id, item_id FROM pre WHERE user_id IN (
          SELECT user_id FROM pre WHERE g = 'control' GROUP BY 1 HAVING COUNT(*) >= 2)),
        his AS (SELECT DISTINCT user_id, item_id FROM pre WHERE g = 'treatment')""",
        _cosine("les", "item_id", "user_id"),
        f"recs AS ({_item_recs('his', 'pairs')})",
        f"""ar AS (SELECT {side} FROM (SELECT user_id, {HASH} AS g,
          COUNT(*) FILTER (WHERE behavior_type = 'buy' AND date < {day}) AS pre,
          COUNT(*) FILTER (WHERE behavior_type = 'buy' AND date >= {day}) AS post FROM ub GROUP BY user_id))""",
    )

    # churn
    q["churn_features"] = on_events("SELECT * FROM ch", CHURN)
    q["churn_label_lastk"] = on_events(
        "SELECT * FROM ch",
        _churn("TRUE", "(SELECT MAX(date) FROM ub)", "(SELECT MAX(date) FROM ub) - last_date > 2"),
    )
    q["churn_sample"] = q["churn_features"]
    parts = """d AS (SELECT *, date_diff('day', DATE '1970-01-01', last_date) AS dn FROM ch),
        s AS (SELECT *, CASE WHEN dn >= (SELECT quantile_cont(dn, 0.8) FROM d) THEN 1 ELSE 0 END AS t,
              ROW_NUMBER() OVER (ORDER BY dn, user_id) AS rn, COUNT(*) OVER () AS n FROM d)"""
    is_test = big(
        "CASE WHEN (SELECT AVG(t) FROM s) BETWEEN 0.1 AND 0.4 THEN t = 1 ELSE rn > n - CAST(floor(n * 0.2e0) AS BIGINT) END"
    )
    q["time_split"] = on_events(
        f"""SELECT is_test, COUNT(*) AS users, {big("SUM(churn)")} AS churned, MIN(last_date) AS min_last_date, MAX(last_date) AS max_last_date
        FROM (SELECT churn, last_date, {is_test} AS is_test FROM s) GROUP BY 1""",
        CHURN,
        parts,
    )
    q["time_split_users"] = on_events(f"SELECT user_id, churn, {is_test} AS is_test FROM s", CHURN, parts)
    q["roc_points"] = on_events(
        f"SELECT score AS threshold, {ratio('fp', 'n', 6)} AS fpr, {ratio('tp', 'p', 6)} AS tpr FROM cu", CHURN, PRED, CURVE
    )

    def n(label: int, predicted: int) -> str:
        return f"COUNT(*) FILTER (WHERE label = {label} AND predicted = {predicted})"

    tp, fp, fn, tn = n(1, 1), n(0, 1), n(1, 0), n(0, 0)
    q["churn_metrics"] = on_events(
        f"""SELECT (SELECT {rnd("(SUM(neg * (tp - pos / 2e0)) / NULLIF(CAST(MAX(p) AS DOUBLE) * MAX(n), 0))", 6)} FROM cu) AS auc,
        {ratio(f"({tp} + {tn})", "COUNT(*)", 6)} AS accuracy, COALESCE({ratio(tp, f"({tp} + {fp})", 6)}, 0e0) AS precision,
        COALESCE({ratio(tp, f"({tp} + {fn})", 6)}, 0e0) AS recall,
        COALESCE({ratio(f"(2 * {tp})", f"(2 * {tp} + {fp} + {fn})", 6)}, 0e0) AS f1 FROM pred""",
        CHURN,
        PRED,
        CURVE,
    )
    return q
