"""Order, traffic and inventory analyses."""

from pyspark.sql import functions as F

from shelfwise.functions.ordered import quantiles
from shelfwise.operators import inventory as I
from shelfwise.operators import orders as O
from shelfwise.operators import quality as Q
from shelfwise.operators import timeseries as T
from shelfwise.operators import traffic as W
from shelfwise.operators.promotions import promo_calendar
from shelfwise.plans import common as C
from shelfwise.plans.q_series import roll_sql
from shelfwise.plans.registry import query, view


@query("D60_order_level", "order_id:i revenue:d quantity:d lines:i products:i has_promo:b payment_value:d installments:i returned_quantity:d refund:d is_returned:b",
       "SELECT * FROM x_order_rows")
def _(shop):
    return C.order_rows(shop)


view("x_order_daily", """
SELECT x.date, coalesce(orders, 0) AS orders, coalesce(revenue, 0) AS revenue, revenue / nullif(orders, 0) AS aov
FROM x_days x LEFT JOIN (SELECT order_date AS date, count(*) AS orders, sum(revenue) AS revenue FROM x_order_rows GROUP BY 1) d USING (date)
""")


@query("D61_order_daily", "date:t orders:i revenue:d aov:e", "SELECT * FROM x_order_daily")
def _(shop):
    return O.order_daily(C.order_rows(shop))


@query("D62_monthly_alignment", "month:t orders_change:d revenue_change:d aov_change:d pattern:s alignment:s", """
WITH m AS (SELECT month, orders, revenue, revenue / orders AS aov FROM x_monthly),
     c AS (SELECT month, 1.0 * orders / lag(orders) OVER w - 1 AS o, revenue / lag(revenue) OVER w - 1 AS r, aov / lag(aov) OVER w - 1 AS a
           FROM m WINDOW w AS (ORDER BY month))
SELECT month, o AS orders_change, r AS revenue_change, a AS aov_change,
  CASE WHEN o > 0.05 AND r <= 0.05 THEN 'orders increased but revenue did not increase much'
       WHEN r > 0.05 AND abs(o) <= 0.05 THEN 'revenue increased despite stable order count'
       WHEN o > 0.05 AND r > 0.05 THEN 'both orders and revenue increased'
       WHEN o < -0.05 AND r < -0.05 THEN 'both orders and revenue decreased' ELSE 'mixed or stable' END AS pattern,
  CASE WHEN r > 0.03 AND o > a THEN 'revenue increase aligned more with order count'
       WHEN r > 0.03 AND a > o THEN 'revenue increase aligned more with AOV'
       WHEN r < -0.03 AND o < a THEN 'revenue decrease aligned more with order count drop'
       WHEN r < -0.03 AND a < o THEN 'revenue decrease aligned more with AOV drop' ELSE 'mixed or stable' END AS alignment FROM c""")
def _(shop):
    return O.monthly_alignment(C.monthly(shop))


@query("D63_high_day_drivers", "date:t orders_rank:d aov_rank:d driver:s", """
WITH r AS (SELECT date, revenue, (rank() OVER (ORDER BY orders) + (count(*) OVER (PARTITION BY orders) - 1) / 2.0) / count(*) OVER () AS o,
                  CASE WHEN aov IS NOT NULL THEN (rank() OVER (ORDER BY aov NULLS LAST) + (count(*) OVER (PARTITION BY aov) - 1) / 2.0) / count(aov) OVER () END AS a
           FROM x_order_daily)
SELECT date, o AS orders_rank, a AS aov_rank,
  CASE WHEN o >= 0.9 AND a >= 0.9 THEN 'both high order count and high AOV' WHEN o >= 0.9 AND a < 0.75 THEN 'unusually high order count'
       WHEN a >= 0.9 AND o < 0.75 THEN 'unusually high AOV' WHEN o >= 0.9 THEN 'order count leaning' WHEN a >= 0.9 THEN 'AOV leaning'
       ELSE 'unclear/mixed' END AS driver
FROM r ORDER BY revenue DESC, date LIMIT 25""")
def _(shop):
    return O.high_day_drivers(O.order_daily(C.order_rows(shop)))


AOV = """
SELECT '{d}' AS dim, CAST({d} AS VARCHAR) AS grp, count(*) AS orders, sum(revenue) AS revenue, avg(revenue) AS aov, quantile_cont(revenue, 0.5) AS median_aov
FROM x_order_rows WHERE revenue IS NOT NULL GROUP BY 2"""


@query("D64_aov_by", "dim:s grp:s orders:i revenue:d aov:d median_aov:d", " UNION ALL ".join(
    AOV.format(d=d) for d in ("payment_method", "order_status", "has_promo")))
def _(shop):
    rows = C.order_rows(shop)
    return Q.union_all(
        [
            O.aov_by(rows, [d]).withColumn("dim", F.lit(d)).withColumn("grp", F.col(d).cast("string")).drop(d)
            for d in ("payment_method", "order_status", "has_promo")
        ]
    )


@query("D65_aov_anomalies", "date:t z:d direction:s", """
WITH s AS (SELECT avg(aov) AS m, stddev_samp(aov) AS sd, quantile_cont(aov, 0.25) AS q1, quantile_cont(aov, 0.75) AS q3,
                  quantile_cont(aov, 0.01) AS p01, quantile_cont(aov, 0.99) AS p99 FROM x_order_daily),
     f AS (SELECT date, (aov - m) / sd AS z, aov >= greatest(p99, q3 + 1.5 * (q3 - q1)) OR (aov - m) / sd >= 3 AS hi,
                  aov <= least(p01, q1 - 1.5 * (q3 - q1)) OR (aov - m) / sd <= -3 AS lo FROM x_order_daily, s)
SELECT date, z, CASE WHEN hi THEN 'high' ELSE 'low' END AS direction FROM f WHERE hi OR lo""")
def _(shop):
    return O.aov_anomalies(O.order_daily(C.order_rows(shop)))


@query("D66_basket_summary", "orders:i mean:d std:d high:d mean_products:d mean_lines:d p25:d p50:d p75:d p90:d p95:d p99:d large_threshold:d", """
WITH s AS (SELECT count(*) AS orders, avg(quantity) AS mean, stddev_samp(quantity) AS std, max(quantity) AS high, avg(products) AS mean_products,
                  avg(lines) AS mean_lines, quantile_cont(quantity, 0.25) AS p25, quantile_cont(quantity, 0.5) AS p50, quantile_cont(quantity, 0.75) AS p75,
                  quantile_cont(quantity, 0.9) AS p90, quantile_cont(quantity, 0.95) AS p95, quantile_cont(quantity, 0.99) AS p99
           FROM x_order_rows WHERE quantity IS NOT NULL)
SELECT *, greatest(p99, p75 + 1.5 * (p75 - p25)) AS large_threshold FROM s""")
def _(shop):
    return O.basket_summary(C.order_rows(shop))


@query("D66b_basket_by_promo", "has_promo:b orders:i mean_size:d mean_capped:d mean_lines:d large_share:d", """
WITH s AS (SELECT quantile_cont(quantity, 0.99) AS p99, greatest(quantile_cont(quantity, 0.99), quantile_cont(quantity, 0.75) + 1.5 *
                  (quantile_cont(quantity, 0.75) - quantile_cont(quantity, 0.25))) AS t FROM x_order_rows WHERE quantity IS NOT NULL)
SELECT has_promo, count(*) AS orders, avg(quantity) AS mean_size, avg(least(quantity, p99)) AS mean_capped, avg(lines) AS mean_lines,
       1.0 * count(*) FILTER (quantity >= t) / count(*) AS large_share FROM x_order_rows, s WHERE quantity IS NOT NULL GROUP BY 1""")
def _(shop):
    return O.basket_by(C.order_rows(shop), ["has_promo"])


@query("D66c_basket_daily", "order_date:t orders:i mean_size:d large_share:d", """
WITH s AS (SELECT greatest(quantile_cont(quantity, 0.99), quantile_cont(quantity, 0.75) + 1.5 *
                  (quantile_cont(quantity, 0.75) - quantile_cont(quantity, 0.25))) AS t FROM x_order_rows WHERE quantity IS NOT NULL)
SELECT order_date, count(*) AS orders, avg(quantity) AS mean_size, 1.0 * count(*) FILTER (quantity >= t) / count(*) AS large_share
FROM x_order_rows, s WHERE quantity IS NOT NULL GROUP BY 1""")
def _(shop):
    return O.basket_by(C.order_rows(shop), ["order_date"])


@query("D67_category_baskets", "order_id:i category:s lines:i quantity:d revenue:d", """
SELECT order_id, category, count(*) AS lines, sum(quantity) AS quantity, sum(revenue) AS revenue FROM x_lines GROUP BY 1, 2""")
def _(shop):
    return O.category_baskets(shop.lines)


@query("D68_revenue_decomposition", "month:t d_revenue:d order_effect:d aov_effect:d interaction:d dominant:s", """
WITH m AS (SELECT month, orders, revenue, revenue / orders AS aov FROM x_monthly),
     l AS (SELECT *, lag(orders) OVER w AS po, lag(aov) OVER w AS pa, lag(revenue) OVER w AS pr FROM m WINDOW w AS (ORDER BY month)),
     e AS (SELECT month, revenue - pr AS d_revenue, (orders - po) * pa AS order_effect, (aov - pa) * po AS aov_effect,
                  (orders - po) * (aov - pa) AS interaction FROM l WHERE pr IS NOT NULL)
SELECT *, CASE WHEN abs(order_effect) >= abs(aov_effect) AND abs(order_effect) >= abs(interaction) THEN 'order_effect'
               WHEN abs(aov_effect) >= abs(interaction) THEN 'aov_effect' ELSE 'interaction' END AS dominant FROM e""")
def _(shop):
    return O.revenue_decomposition(C.monthly(shop))


CORR = "SELECT {s} AS scope, corr(revenue, orders) AS orders_corr, corr(revenue, aov) AS aov_corr FROM x_order_daily {w}"


@query("D69_driver_correlations", "scope:s orders_corr:d aov_corr:d dominant:s", f"""
WITH c AS ({CORR.format(s="'overall'", w="")}
  UNION ALL {CORR.format(s="CAST(year(date) AS VARCHAR)", w="GROUP BY 1")}
  UNION ALL {CORR.format(s="'month_' || CAST(month(date) AS VARCHAR)", w="GROUP BY 1")}
  UNION ALL {CORR.format(s="'high_revenue_days'", w="WHERE revenue >= (SELECT quantile_cont(revenue, 0.9) FROM x_order_daily)")})
SELECT *, CASE WHEN abs(orders_corr) >= abs(aov_corr) THEN 'orders' ELSE 'aov' END AS dominant FROM c""")
def _(shop):
    return O.driver_correlations(O.order_daily(C.order_rows(shop)))


@query("D70_peak_drivers", "month:i revenue_rank:i orders_rank:i aov_rank:i peak_class:s", """
WITH m AS (SELECT month(date) AS month, avg(revenue) AS r, avg(orders) AS o, avg(aov) AS a FROM x_order_daily GROUP BY 1),
     k AS (SELECT month, dense_rank() OVER (ORDER BY r DESC) AS revenue_rank, dense_rank() OVER (ORDER BY o DESC) AS orders_rank,
                  dense_rank() OVER (ORDER BY a DESC) AS aov_rank FROM m)
SELECT *, CASE WHEN orders_rank <= 3 AND aov_rank <= 3 THEN 'both' WHEN orders_rank <= 3 THEN 'high_order_volume'
               WHEN aov_rank <= 3 THEN 'high_AOV' ELSE 'mixed' END AS peak_class FROM k""")
def _(shop):
    return O.peak_drivers(O.order_daily(C.order_rows(shop)))


# --- traffic --------------------------------------------------------------------

@query("D71_traffic_daily", "date:t sessions:i unique_visitors:i page_views:i bounce_rate:d session_duration:d", """
SELECT date, sum(sessions) AS sessions, sum(unique_visitors) AS unique_visitors, sum(page_views) AS page_views,
       sum(bounce_rate * sessions) / sum(sessions) AS bounce_rate, sum(avg_session_duration_sec * sessions) / sum(sessions) AS session_duration
FROM x_traffic GROUP BY 1""")
def _(shop):
    return W.traffic_daily(shop.traffic)


@query("D71b_traffic_source_daily", "date:t traffic_source:s sessions:i bounce_rate:d", """
SELECT date, traffic_source, sessions, bounce_rate FROM x_traffic""")
def _(shop):
    return W.traffic_daily(shop.traffic, ["date", "traffic_source"])


TREND = """
SELECT '{m}' AS metric, count(*) AS days, avg(v) FILTER (i <= 10) AS first_mean, avg(v) FILTER (j <= 10) AS last_mean, regr_slope(v, i) AS slope
FROM (SELECT {m} AS v, row_number() OVER (ORDER BY date) AS i, row_number() OVER (ORDER BY date DESC) AS j FROM x_web_daily)"""


@query("D72_traffic_trends", "metric:s days:i first_mean:d last_mean:d slope:d direction:s", f"""
WITH t AS ({TREND.format(m="sessions")} UNION ALL {TREND.format(m="page_views")})
SELECT *, CASE WHEN abs(last_mean / first_mean - 1) < 0.05 THEN 'stable' WHEN last_mean > first_mean THEN 'increasing' ELSE 'decreasing' END AS direction FROM t""")
def _(shop):
    return W.traffic_trends(C.web_daily(shop), ["sessions", "page_views"], 10, 20)


@query("D73_source_quality", "traffic_source:s sessions:i active_days:i bounce_rate:d median_bounce:d duration:d pages_per_session:d sessions_per_visitor:d share:d sparse:b weak_quality:b strong_low_volume:b", """
WITH s AS (SELECT traffic_source, sum(sessions) AS sessions, count(DISTINCT date) AS active_days, sum(bounce_rate * sessions) / sum(sessions) AS bounce_rate,
                  quantile_cont(bounce_rate, 0.5) AS median_bounce, sum(avg_session_duration_sec * sessions) / sum(sessions) AS duration,
                  sum(page_views) / sum(sessions) AS pages_per_session, sum(sessions) / sum(unique_visitors) AS sessions_per_visitor FROM x_traffic GROUP BY 1),
     h AS (SELECT *, sessions / sum(sessions) OVER () AS share FROM s),
     q AS (SELECT quantile_cont(share, 0.75) AS sh, quantile_cont(share, 0.25) AS sl, quantile_cont(bounce_rate, 0.75) AS bh, quantile_cont(bounce_rate, 0.25) AS bl FROM h)
SELECT h.*, share < 0.01 AS sparse, share >= sh AND bounce_rate >= bh AS weak_quality, share <= sl AND bounce_rate <= bl AS strong_low_volume FROM h, q""")
def _(shop):
    return W.source_quality(shop.traffic)


@query("D74_traffic_efficiency", "date:t revenue_per_session:d revenue_per_visitor:d pages_per_session:d busy_low_yield:b calm_high_yield:b", """
WITH e AS (SELECT *, revenue / sessions AS rps FROM x_web_daily),
     q AS (SELECT quantile_cont(sessions, 0.9) AS sh, quantile_cont(sessions, 0.1) AS sl, quantile_cont(rps, 0.9) AS rh, quantile_cont(rps, 0.1) AS rl FROM e)
SELECT date, rps AS revenue_per_session, revenue / unique_visitors AS revenue_per_visitor, page_views / sessions AS pages_per_session,
       sessions >= sh AND rps <= rl AS busy_low_yield, sessions <= sl AND rps >= rh AS calm_high_yield FROM e, q""")
def _(shop):
    return W.traffic_efficiency(C.web_daily(shop))


@query("D75_traffic_revenue_correlation", "y:s correlation:d", """
WITH l AS (SELECT revenue, sessions, lag(sessions, 1) OVER (ORDER BY date) AS s1, lag(sessions, 7) OVER (ORDER BY date) AS s7 FROM x_web_daily)
SELECT 'sessions' AS y, corr(revenue, sessions) AS correlation FROM l UNION ALL SELECT 'sessions_lag_1', corr(revenue, s1) FROM l
UNION ALL SELECT 'sessions_lag_7', corr(revenue, s7) FROM l""")
def _(shop):
    return W.traffic_revenue_correlation(C.web_daily(shop), ["sessions"])


view("x_conversion", """
SELECT t.period, sessions, coalesce(orders, 0) AS orders, coalesce(completed_orders, 0) AS completed_orders, coalesce(revenue, 0) AS revenue,
       100.0::DOUBLE * coalesce(orders, 0) / sessions AS conversion_pct, 100.0::DOUBLE * coalesce(completed_orders, 0) / sessions AS completed_pct,
       coalesce(revenue, 0) / sessions AS revenue_per_session, revenue / orders AS aov
FROM (SELECT date AS period, sum(sessions) AS sessions FROM x_traffic GROUP BY 1) t
LEFT JOIN (SELECT order_date AS period, count(*) AS orders, count(*) FILTER (order_status IN ('delivered', 'shipped', 'paid')) AS completed_orders,
                  sum(order_value) AS revenue FROM x_web_orders GROUP BY 1) o ON o.period = t.period
""")
CONVERSION = "period:t sessions:i orders:i completed_orders:i revenue:d conversion_pct:d completed_pct:d revenue_per_session:d aov:d"


@query("D76_conversion_daily", CONVERSION, "SELECT * FROM x_conversion")
def _(shop):
    return W.conversion_proxy(shop.traffic, shop.web_orders)


@query("D76b_conversion_weekly", CONVERSION, """
WITH w AS (SELECT CAST(date_trunc('week', period) AS DATE) AS period, sum(sessions) AS sessions, sum(orders) AS orders,
                  sum(completed_orders) AS completed_orders, sum(revenue) AS revenue FROM x_conversion GROUP BY 1)
SELECT *, 100.0 * orders / sessions AS conversion_pct, 100.0 * completed_orders / sessions AS completed_pct,
       revenue / sessions AS revenue_per_session, revenue / orders AS aov FROM w""")
def _(shop):
    return W.conversion_proxy(shop.traffic, shop.web_orders, "week")


@query("D77_conversion_by_source", "source:s period:i sessions:i orders:i conversion_pct:d", """
WITH o AS (SELECT CASE order_id % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'signup' ELSE 'error' END AS source,
                  week(order_date) AS period, count(*) AS orders FROM x_web_orders GROUP BY 1, 2)
SELECT t.source, t.period, sessions, coalesce(orders, 0) AS orders, 100.0 * coalesce(orders, 0) / sessions AS conversion_pct
FROM (SELECT traffic_source AS source, week(date) AS period, sum(sessions) AS sessions FROM x_traffic GROUP BY 1, 2) t
LEFT JOIN o ON o.source = t.source AND o.period = t.period""")
def _(shop):
    turn = F.col("order_id") % 4
    source = F.when(turn == 0, "view").when(turn == 1, "click").when(turn == 2, "signup").otherwise("error")
    orders = shop.web_orders.withColumn("order_source", source)
    return W.conversion_by_source(
        shop.traffic, orders, "order_source", F.weekofyear("date"), F.weekofyear("order_date")
    )


@query("D78_conversion_sensitivity", "pearson:d spearman:d mean_before:d mean_after:d mean_gap_bps:d", """
WITH r AS (SELECT *, rank() OVER (ORDER BY sessions) + (count(*) OVER (PARTITION BY sessions) - 1) / 2.0 AS a,
                  rank() OVER (ORDER BY conversion_pct) + (count(*) OVER (PARTITION BY conversion_pct) - 1) / 2.0 AS b FROM x_conversion)
SELECT corr(sessions, conversion_pct) AS pearson, corr(a, b) AS spearman, avg(conversion_pct) FILTER (period < DATE '2024-01-15') AS mean_before,
       avg(conversion_pct) FILTER (period >= DATE '2024-01-15') AS mean_after, avg((conversion_pct - completed_pct) * 100) AS mean_gap_bps FROM r""")
def _(shop):
    return W.conversion_sensitivity(W.conversion_proxy(shop.traffic, shop.web_orders), "2024-01-15")


view("x_promo_web", """
SELECT *, day(date) % 10 < 4 AS has_promo FROM x_web_daily
""")


def promo_web(shop):
    return C.web_daily(shop).withColumn("has_promo", F.dayofmonth("date") % 10 < 4)


@query("D79_promo_traffic", "has_promo:b days:i correlation:d revenue_per_session:d slope:d", """
SELECT has_promo, count(*) AS days, corr(revenue, sessions) AS correlation, sum(revenue) / sum(sessions) AS revenue_per_session,
       regr_slope(revenue, sessions) AS slope FROM x_promo_web GROUP BY 1""")
def _(shop):
    return W.promo_traffic_interaction(promo_web(shop))


@query("D79b_interaction_correlations", "y:s correlation:d", """
WITH l AS (SELECT revenue, has_promo::INT AS p, sessions, lag(sessions, 1) OVER (ORDER BY date) AS s1, lag(sessions, 7) OVER (ORDER BY date) AS s7 FROM x_promo_web)
SELECT 'sessions_x_promo' AS y, corr(revenue, sessions * p) AS correlation FROM l
UNION ALL SELECT 'sessions_lag_1_x_promo', corr(revenue, s1 * p) FROM l UNION ALL SELECT 'sessions_lag_7_x_promo', corr(revenue, s7 * p) FROM l""")
def _(shop):
    return W.interaction_correlations(promo_web(shop))


@query("D79c_spike_context", "date:t context:s", """
WITH q AS (SELECT quantile_cont(revenue, 0.95) AS r, quantile_cont(sessions, 0.9) AS s FROM x_promo_web)
SELECT date, CASE WHEN sessions >= s AND has_promo THEN 'high_traffic_plus_promo' WHEN sessions >= s THEN 'high_traffic_only'
                  WHEN has_promo THEN 'promo_only' ELSE 'unclear' END AS context FROM x_promo_web, q WHERE revenue >= r""")
def _(shop):
    return W.spike_context(promo_web(shop))


@query("D80_source_effectiveness", "traffic_source:s has_promo:b sessions:i mean_sessions:d mean_revenue:d revenue_per_session:d correlation:d", """
SELECT traffic_source, has_promo, sum(t.sessions) AS sessions, avg(t.sessions) AS mean_sessions, avg(revenue) AS mean_revenue,
       sum(revenue) / sum(t.sessions) AS revenue_per_session, corr(revenue, t.sessions) AS correlation
FROM x_traffic t JOIN x_promo_web w ON w.date = t.date GROUP BY 1, 2""")
def _(shop):
    return W.source_effectiveness(shop.traffic, promo_web(shop))


# --- inventory ------------------------------------------------------------------

STOCK = """
SELECT {keys}, count(*) AS records, count(*) FILTER (stockout_flag) AS stockouts, 1.0::DOUBLE * count(*) FILTER (stockout_flag) / count(*) AS stockout_rate,
       count(DISTINCT product_id) FILTER (stockout_flag) AS stockout_products, avg(stock_on_hand) AS mean_stock, avg(fill_rate) AS mean_fill_rate,
       sum(stockout_days) AS stockout_days, 1.0::DOUBLE * sum(stockout_days) / count(DISTINCT product_id) AS days_per_product FROM x_inventory GROUP BY {keys}"""
view("x_stock_months", STOCK.format(keys="month"))
STOCK_COLUMNS = "records:i stockouts:i stockout_rate:d stockout_products:i mean_stock:d mean_fill_rate:d stockout_days:i days_per_product:d"


@query("D81_stockout_monthly", f"month:t {STOCK_COLUMNS}", "SELECT * FROM x_stock_months")
def _(shop):
    return I.stockout_monthly(shop.inventory)


@query("D81b_stockout_by_category", "category:s products:i records:i stockouts:i stockout_rate:d mean_fill_rate:d worst_month:t worst_rate:d small_sample:b", """
WITH s AS (SELECT category, count(DISTINCT product_id) AS products, count(*) AS records, count(*) FILTER (stockout_flag) AS stockouts,
                  1.0 * count(*) FILTER (stockout_flag) / count(*) AS stockout_rate, avg(fill_rate) AS mean_fill_rate FROM x_inventory GROUP BY 1),
     m AS (SELECT category, month, 1.0::DOUBLE * count(*) FILTER (stockout_flag) / count(*) AS rate FROM x_inventory GROUP BY 1, 2),
     w AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rate DESC, month DESC) AS p FROM m)
SELECT s.*, w.month AS worst_month, w.rate AS worst_rate, records < greatest(10, (SELECT quantile_cont(records, 0.1) FROM s)) AS small_sample
FROM s JOIN w ON w.category = s.category AND p = 1""")
def _(shop):
    return I.stockout_by(shop.inventory, "category")


@query("D81c_stockout_category_month", f"month:t category:s {STOCK_COLUMNS}", STOCK.format(keys="month, category"))
def _(shop):
    return I.stockout_monthly(shop.inventory, ["month", "category"])


@query("D82_stockout_vs_revenue", "y:s correlation:d", " UNION ALL ".join(
    f"SELECT '{m}' AS y, corr(revenue, {m}) AS correlation FROM x_stock_months JOIN x_monthly USING (month)"
    for m in ("stockout_days", "stockouts", "stockout_rate", "mean_fill_rate")))
def _(shop):
    return I.stockout_vs_revenue(I.stockout_monthly(shop.inventory), C.monthly(shop))


@query("D82b_stockout_overlap", "low_revenue:b high_stockout:b months:i mean_revenue:d", """
WITH s AS (SELECT quantile_cont(revenue, 0.1) AS p10, avg(revenue) AS m, stddev_samp(revenue) AS sd FROM x_monthly),
     r AS (SELECT month, revenue, CASE WHEN count(revenue) OVER w >= 2 THEN avg(revenue) OVER w END AS p3 FROM x_monthly
           WINDOW w AS (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
     l AS (SELECT month, revenue, revenue <= p10 OR (revenue - m) / sd <= -1.5 OR coalesce(revenue < 0.85 * p3, false) AS low_revenue FROM r, s),
     j AS (SELECT l.*, stockout_rate FROM l JOIN x_stock_months USING (month))
SELECT low_revenue, stockout_rate >= (SELECT quantile_cont(stockout_rate, 0.75) FROM j) AS high_stockout, count(*) AS months,
       avg(revenue) AS mean_revenue FROM j GROUP BY 1, 2""")
def _(shop):
    return I.stockout_overlap(I.stockout_monthly(shop.inventory), C.monthly(shop))


@query("D83_best_seller_stockouts", "product_id:i category:s units_sold:d stockouts:i stockout_days:i", """
SELECT product_id, any_value(category) AS category, sum(units_sold) AS units_sold, count(*) FILTER (stockout_flag) AS stockouts,
       sum(stockout_days) AS stockout_days FROM x_inventory GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20""")
def _(shop):
    return I.best_seller_stockouts(shop.inventory)


@query("D122_units_sold_monthly", "product_id:i month:t units_sold:d revenue:d", """
SELECT product_id, CAST(date_trunc('month', order_date) AS DATE) AS month, sum(quantity) AS units_sold, sum(revenue) AS revenue FROM x_sold GROUP BY 1, 2""")
def _(shop):
    return I.units_sold_monthly(shop.sold)


view("x_overstock", """
WITH b AS (SELECT product_id, month, category, segment, stock_on_hand, units_sold,
                  CASE WHEN stock_on_hand > 0 THEN units_sold / stock_on_hand END AS sell_through,
                  CASE WHEN units_sold > 0 THEN stock_on_hand / (units_sold / day(last_day(month))) END AS supply_days FROM x_inventory),
     q AS (SELECT category, quantile_cont(stock_on_hand, 0.75) AS s, quantile_cont(units_sold, 0.5) AS u, quantile_cont(sell_through, 0.25) AS t FROM b GROUP BY 1)
SELECT b.*, stock_on_hand >= s AND (units_sold <= u OR coalesce(sell_through <= t, false)) AS is_overstock FROM b JOIN q USING (category)
""")


@query("D84_overstock", "product_id:i month:t sell_through:d supply_days:d is_overstock:b", "SELECT * FROM x_overstock")
def _(shop):
    return I.overstock(shop.inventory)


OVER = """
SELECT {key} AS grp, count(DISTINCT product_id) AS products, sum(stock_on_hand) AS stock, sum(units_sold) AS units_sold, avg(sell_through) AS mean_sell_through,
       count(*) FILTER (is_overstock) AS overstocked, 1.0 * count(*) FILTER (is_overstock) / count(*) AS overstock_rate,
       avg(supply_days) AS mean_supply_days FROM x_overstock GROUP BY 1"""
OVER_COLUMNS = "grp:s products:i stock:d units_sold:d mean_sell_through:d overstocked:i overstock_rate:d mean_supply_days:d"


@query("D85_overstock_by", OVER_COLUMNS, " UNION ALL ".join(
    OVER.format(key=k) for k in ("category", "segment", "CAST(month AS VARCHAR)")))
def _(shop):
    marked = I.overstock(shop.inventory)
    return Q.union_all(
        [
            I.overstock_by(marked, [k]).withColumn("grp", F.col(k).cast("string")).drop(k)
            for k in ("category", "segment", "month")
        ]
    )


@query("D85b_slow_movers", "product_id:i mean_stock:d units_sold:d overstock_months:i", """
WITH p AS (SELECT product_id, avg(stock_on_hand) AS mean_stock, sum(units_sold) AS units_sold, count(*) FILTER (is_overstock) AS overstock_months
           FROM x_overstock GROUP BY 1)
SELECT * FROM p WHERE mean_stock >= (SELECT quantile_cont(mean_stock, 0.75) FROM p) ORDER BY units_sold, mean_stock DESC, product_id LIMIT 20""")
def _(shop):
    return I.slow_movers(I.overstock(shop.inventory))


SUPPLY = """
SELECT {key}, count(*) AS periods, count(DISTINCT product_id) AS products, count(*) FILTER (reorder_flag) AS reorders,
       1.0::DOUBLE * count(*) FILTER (reorder_flag) / count(*) AS reorder_rate, avg(reorder_quantity) AS mean_reorder_quantity,
       avg(fill_rate) AS mean_fill_rate, avg(days_of_supply) AS mean_days_of_supply, avg(stock_on_hand) AS mean_stock FROM x_inventory GROUP BY ALL"""
view("x_supply_months", SUPPLY.format(key="month"))
SUPPLY_COLUMNS = "periods:i products:i reorders:i reorder_rate:d mean_reorder_quantity:d mean_fill_rate:d mean_days_of_supply:d mean_stock:d"


@query("D86_reorder_supply", f"grp:s {SUPPLY_COLUMNS}", " UNION ALL ".join(
    SUPPLY.format(key=k) for k in ("category AS grp", "segment AS grp", "CAST(month AS VARCHAR) AS grp")))
def _(shop):
    return Q.union_all(
        [
            I.reorder_supply(shop.inventory, [k]).withColumn("grp", F.col(k).cast("string")).drop(k)
            for k in ("category", "segment", "month")
        ]
    )


@query("D86b_reorder_products", f"product_id:i few_periods:b {SUPPLY_COLUMNS}", f"""
WITH s AS ({SUPPLY.format(key="product_id")})
SELECT *, periods < greatest(3, (SELECT quantile_cont(periods, 0.1) FROM s)) AS few_periods FROM s""")
def _(shop):
    products = I.reorder_supply(shop.inventory, ["product_id"])
    cut = quantiles(products, "periods", {"c": 0.1}).scalar()
    return products.withColumn("c", cut).withColumn(
        "few_periods", F.col("periods") < F.greatest(F.lit(3.0), F.col("c"))
    )


@query("D87_supply_vs_next_month", "x:s correlation:d", "WITH j AS (SELECT s.*, m.revenue AS n FROM x_supply_months s JOIN x_monthly m ON m.month = s.month + INTERVAL 1 MONTH) " + " UNION ALL ".join(
    f"SELECT '{m}' AS x, corr({m}, n) AS correlation FROM j" for m in ("reorders", "reorder_rate", "mean_days_of_supply", "mean_fill_rate")))
def _(shop):
    return I.supply_vs_next_month(I.reorder_supply(shop.inventory, ["month"]), C.monthly(shop))


@query("D87b_supply_extremes", "supply_group:s months:i mean_revenue:d mean_reorder_rate:d", """
WITH j AS (SELECT s.*, m.revenue FROM x_supply_months s JOIN x_monthly m USING (month)),
     q AS (SELECT quantile_cont(mean_days_of_supply, 0.25) AS lo, quantile_cont(mean_days_of_supply, 0.75) AS hi FROM j)
SELECT CASE WHEN mean_days_of_supply <= lo THEN 'low_supply' WHEN mean_days_of_supply >= hi THEN 'high_supply' ELSE 'normal_supply' END AS supply_group,
       count(*) AS months, avg(revenue) AS mean_revenue, avg(reorder_rate) AS mean_reorder_rate FROM j, q GROUP BY 1""")
def _(shop):
    return I.supply_extremes(I.reorder_supply(shop.inventory, ["month"]), C.monthly(shop))


view("x_leading", """
WITH i AS (SELECT month, avg(days_of_supply) AS days_of_supply, sum(stock_on_hand) AS stock, avg(overstock_flag::INT) AS overstock_rate FROM x_inventory GROUP BY 1),
     j AS (SELECT i.*, revenue, lead(revenue) OVER (ORDER BY month) AS next_revenue FROM i JOIN x_monthly USING (month))
SELECT * FROM j WHERE days_of_supply IS NOT NULL AND next_revenue IS NOT NULL
""")


@query("D88_leading_indicator", "month:t days_of_supply:d stock:d overstock_rate:d next_revenue:d", "SELECT * FROM x_leading")
def _(shop):
    return I.leading_indicator(shop.inventory, C.monthly(shop))


@query("D88b_leading_summary", "periods:i first_month:t last_month:t correlation:d risk_months:i mean_next_revenue:d mean_next_revenue_risk:d", """
SELECT count(*) AS periods, min(month) AS first_month, max(month) AS last_month, corr(days_of_supply, next_revenue) AS correlation,
       count(*) FILTER (days_of_supply >= 60) AS risk_months, avg(next_revenue) AS mean_next_revenue,
       avg(next_revenue) FILTER (days_of_supply >= 60) AS mean_next_revenue_risk FROM x_leading""")
def _(shop):
    return I.leading_summary(I.leading_indicator(shop.inventory, C.monthly(shop)), 60.0)


@query("D89_inventory_features", "date:t stockout_rate_lag_1:d stockout_rate_roll_mean_3:d", """
WITH f AS (SELECT month, lag(stockout_rate) OVER (ORDER BY month) AS a, avg(stockout_rate) OVER (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b
           FROM x_stock_months)
SELECT date, a AS stockout_rate_lag_1, b AS stockout_rate_roll_mean_3 FROM x_sales LEFT JOIN f ON f.month = date_trunc('month', date)""")
def _(shop):
    return I.inventory_features(I.stockout_monthly(shop.inventory), shop.sales, ["stockout_rate"])


view("x_master", """
SELECT d.date, d.revenue, d.orders, s.stockout_rate, s.mean_fill_rate, p.stockout_rate AS stockout_rate_lag, p.mean_fill_rate AS fill_rate_lag, has_promo, active_promos
FROM x_daily d LEFT JOIN x_stock_months s ON s.month = date_trunc('month', d.date)
     LEFT JOIN x_stock_months p ON p.month + INTERVAL 1 MONTH = date_trunc('month', d.date) LEFT JOIN x_calendar c ON c.date = d.date
""")


def master(shop):
    daily = C.daily(shop).select("date", "revenue", "orders")
    calendar = promo_calendar(shop.promotions, daily)
    return I.constraint_master(daily, calendar, I.stockout_monthly(shop.inventory))


@query("D90_constraint_master", "date:t revenue:d orders:i stockout_rate:d mean_fill_rate:d stockout_rate_lag:d fill_rate_lag:d has_promo:b active_promos:i", "SELECT * FROM x_master")
def _(shop):
    return master(shop)


MATRIX = """
SELECT {label} AS grp, CASE WHEN stockout_rate >= (SELECT quantile_cont(stockout_rate, 0.75) FROM x_master) THEN 'high_stockout' ELSE 'low_stockout' END AS stockout_group,
       count(*) AS days, avg(revenue) AS mean_revenue, quantile_cont(revenue, 0.5) AS median_revenue, avg(orders) AS mean_orders,
       avg(revenue / nullif(orders, 0)) AS revenue_per_orders FROM x_master, (SELECT quantile_cont(orders, 0.75) AS cut FROM x_master) GROUP BY 1, 2"""


@query("D90b_constraint_matrices", "grp:s stockout_group:s days:i mean_revenue:d median_revenue:d mean_orders:d revenue_per_orders:d", " UNION ALL ".join([
    MATRIX.format(label="CASE WHEN orders >= cut THEN 'busy' ELSE 'normal' END"),
    MATRIX.format(label="CASE WHEN has_promo THEN 'promo' ELSE 'non_promo' END"),
]))
def _(shop):
    rows = master(shop)
    cut = rows.agg(F.percentile("orders", F.lit(0.75)).alias("cut")).scalar()
    busy = F.when(F.col("orders") >= F.col("cut"), "busy").otherwise("normal")
    promo = F.when(F.col("has_promo"), "promo").otherwise("non_promo")
    return Q.union_all(
        [I.constraint_matrix(rows.withColumn("cut", cut), {"grp": label}) for label in (busy, promo)]
    )


@query("D91_feature_preview", "date:t orders_lag_1:i orders_lag_7:i orders_roll_mean_7:d revenue_roll_mean_30:d aov_lag_1:e aov_roll_mean_30:d", f"""
SELECT date, lag(orders, 1) OVER (ORDER BY date) AS orders_lag_1, lag(orders, 7) OVER (ORDER BY date) AS orders_lag_7,
       {roll_sql("orders", "mean", 7, 3, 1)} AS orders_roll_mean_7, {roll_sql("revenue", "mean", 30, 7, 1)} AS revenue_roll_mean_30,
       lag(aov, 1) OVER (ORDER BY date) AS aov_lag_1, {roll_sql("aov", "mean", 30, 7, 1)} AS aov_roll_mean_30 FROM x_order_daily""")
def _(shop):
    spec = [
        ("orders", "lag", 1),
        ("orders", "lag", 7),
        ("orders", "mean", 7, 3, 1),
        ("revenue", "mean", 30, 7, 1),
        ("aov", "lag", 1),
        ("aov", "mean", 30, 7, 1),
    ]
    return T.feature_columns(O.order_daily(C.order_rows(shop)), spec)
