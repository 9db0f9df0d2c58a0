"""Product, concentration, customer and promotion analyses."""

from pyspark.sql import functions as F

from shelfwise.functions.scalars import month_start
from shelfwise.operators import aggregate as A
from shelfwise.operators import concentration as K
from shelfwise.operators import customers as U
from shelfwise.operators import promotions as R
from shelfwise.operators import quality as Q
from shelfwise.operators.aggregate import safe_corr
from shelfwise.plans import common as C
from shelfwise.plans.q_series import roll_sql
from shelfwise.plans.registry import query, view


GROUP = """
SELECT '{g}' AS dim, {g} AS grp, sum(revenue) AS revenue, count(DISTINCT order_id) AS orders, count(*) AS lines,
       count(DISTINCT product_id) AS products, avg(revenue) AS mean_line, sum(revenue) / sum(sum(revenue)) OVER () AS share,
       sum(revenue) / count(DISTINCT order_id) AS revenue_per_order, rank() OVER (ORDER BY sum(revenue) DESC) AS rank
FROM x_lines GROUP BY 2"""


@query("D22_group_revenue", "dim:s grp:s revenue:d orders:i lines:i products:i mean_line:d share:d revenue_per_order:d rank:i",
       GROUP.format(g="category") + " UNION ALL " + GROUP.format(g="segment"))
def _(shop):
    lines = A.by_each(shop.lines, {g: F.col(g) for g in ("category", "segment")})
    return K.group_revenue(lines, "grp", ["dim"])


@query("D23_product_sales", "product_id:i category:s quantity:d revenue:d cost:d profit:d", """
SELECT product_id, any_value(category) AS category, sum(quantity) AS quantity, sum(revenue) AS revenue, sum(cost) AS cost,
       sum(profit) AS profit FROM x_lines GROUP BY 1""")
def _(shop):
    return K.product_sales(shop.items, shop.products)


@query("D24_catalog", "category:s segment:s products:i mean_profit:d min_profit:d max_profit:d", """
SELECT category, segment, count(*) AS products, avg(price - cogs) AS mean_profit, min(price - cogs) AS min_profit,
       max(price - cogs) AS max_profit FROM x_products GROUP BY 1, 2""")
def _(shop):
    return K.catalog_by_category_segment(shop.products)


@query("D25_never_sold", "product_id:i product_name:s", """
SELECT product_id, product_name FROM x_products
WHERE product_id NOT IN (SELECT product_id FROM x_items WHERE product_id IS NOT NULL)""")
def _(shop):
    return K.never_sold(shop.products, shop.items)


CONC = """
WITH g AS (SELECT {key} AS k, round(sum(revenue), 4) AS r FROM x_lines GROUP BY 1),
     s AS (SELECT r / sum(r) OVER () AS share, row_number() OVER (ORDER BY r DESC, k) AS p,
                  sum(r) OVER (ORDER BY r DESC, k ROWS UNBOUNDED PRECEDING) / sum(r) OVER () AS c FROM g)
SELECT '{key}' AS dim, count(*) AS groups, sum(share) FILTER (p <= 1) AS top_1_share, sum(share) FILTER (p <= 3) AS top_3_share,
       sum(share) FILTER (p <= 5) AS top_5_share, sum(share) FILTER (p <= 20) AS top_20_share,
       min(p) FILTER (c >= 0.5 - 1e-12) AS groups_for_50, min(p) FILTER (c >= 0.8 - 1e-12) AS groups_for_80,
       min(p) FILTER (c >= 0.9 - 1e-12) AS groups_for_90, sum(share * share) AS hhi, 1 / sum(share * share) AS effective_groups FROM s"""


@query("D26_concentration", "dim:s groups:i top_1_share:d top_3_share:d top_5_share:d top_20_share:d groups_for_50:i groups_for_80:i groups_for_90:i hhi:d effective_groups:d",
       " UNION ALL ".join(f"({CONC.format(key=k)})" for k in ("category", "product_id")))
def _(shop):
    parts = []
    for key in ("category", "product_id"):
        groups = shop.lines.groupBy(key).agg(F.sum("revenue").alias("revenue"))
        parts.append(K.concentration(groups, key).withColumn("dim", F.lit(key)))
    return Q.union_all(parts)


view("x_product_rank", """
SELECT *, sum(r) OVER (ORDER BY r DESC, product_id ROWS UNBOUNDED PRECEDING) / sum(r) OVER () AS c,
       row_number() OVER (ORDER BY r DESC, product_id) AS p, count(*) OVER () AS n, r / sum(r) OVER () AS share
FROM (SELECT product_id, round(sum(revenue), 4) AS r, count(*) AS lines FROM x_items GROUP BY 1)
""")


@query("D27_pareto", "fraction:d products:i revenue_share:d", """
SELECT f AS fraction, count(*) AS products, sum(share) AS revenue_share
FROM x_product_rank, (VALUES (0.01), (0.05), (0.10), (0.20)) v(f) WHERE p <= greatest(1, ceil(n * f)) GROUP BY 1""")
def _(shop):
    return K.pareto(shop.items.groupBy("product_id").agg(F.sum("revenue").alias("revenue")))


@query("D28_long_tail", "contribution_group:s products:i revenue:d lines:i orders:i product_share:d revenue_share:d line_share:d order_share:d", """
WITH g AS (SELECT *, CASE WHEN c <= 0.5 THEN 'head_products_to_50pct' WHEN c <= 0.8 THEN 'mid_tail_50_to_80pct'
                          ELSE 'long_tail_after_80pct' END AS contribution_group FROM x_product_rank),
     o AS (SELECT contribution_group, count(DISTINCT order_id) AS orders FROM x_items JOIN g USING (product_id) GROUP BY 1)
SELECT contribution_group, count(*) AS products, sum(r) AS revenue, sum(lines) AS lines, any_value(orders) AS orders,
       count(*) / sum(count(*)) OVER () AS product_share, sum(r) / sum(sum(r)) OVER () AS revenue_share,
       sum(lines) / sum(sum(lines)) OVER () AS line_share,
       any_value(orders) / (SELECT count(DISTINCT order_id) FROM x_items)::DOUBLE AS order_share
FROM g JOIN o USING (contribution_group) GROUP BY 1""")
def _(shop):
    return K.long_tail(shop.items)


@query("D29_top_product_frequency", "product_id:i months:i top_10:i top_20:i mean_revenue:d max_revenue:d top_10_share:d", """
WITH m AS (SELECT date_trunc('month', order_date) AS month, product_id, sum(revenue) AS revenue FROM x_sold GROUP BY 1, 2),
     r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY revenue DESC, product_id) AS p FROM m)
SELECT product_id, count(*) AS months, count(*) FILTER (p <= 10) AS top_10, count(*) FILTER (p <= 20) AS top_20,
       avg(revenue) AS mean_revenue, max(revenue) AS max_revenue, 1.0 * count(*) FILTER (p <= 10) / count(*) AS top_10_share
FROM r GROUP BY 1""")
def _(shop):
    months = shop.sold.groupBy("product_id", month_start(F.col("order_date")).alias("month")).agg(
        F.sum("revenue").alias("revenue")
    )
    return K.top_product_frequency(months)


@query("D30_monthly_mix", "month:t top_share:d hhi:d mean_abs_change:d", """
WITH s AS (SELECT category, month, revenue / sum(revenue) OVER (PARTITION BY month) AS share FROM x_category_months),
     c AS (SELECT *, abs(share - lag(share) OVER (PARTITION BY category ORDER BY month)) AS ch FROM s)
SELECT month, max(share) AS top_share, sum(share * share) AS hhi, avg(ch) AS mean_abs_change FROM c GROUP BY 1""")
def _(shop):
    return K.mix_summary(K.monthly_mix(C.category_months(shop), "category"))


def product_days(shop):
    """Revenue per product and day."""
    return shop.sold.groupBy("product_id", F.col("order_date").alias("date")).agg(F.sum("revenue").alias("revenue"))


@query("D31_rolling_concentration", "date:t active:i top_1_share:d top_5_share:d top_10_share:d hhi:d entropy:d", """
WITH p AS (SELECT order_date AS d, product_id, sum(revenue) AS v FROM x_sold GROUP BY 1, 2),
     s AS (SELECT x.date, p.product_id, sum(p.v) AS v FROM x_days x JOIN p ON p.d BETWEEN x.date - 30 AND x.date - 1
           WHERE x.date >= (SELECT min(d) FROM p) + 7 GROUP BY 1, 2),
     h AS (SELECT date, product_id, v / sum(v) OVER (PARTITION BY date) AS s,
                  row_number() OVER (PARTITION BY date ORDER BY v DESC, product_id) AS r FROM s WHERE v > 0)
SELECT date, count(*) AS active, sum(s) FILTER (r <= 1) AS top_1_share, sum(s) FILTER (r <= 5) AS top_5_share,
       sum(s) FILTER (r <= 10) AS top_10_share, sum(s * s) AS hhi, -sum(s * ln(s)) AS entropy FROM h GROUP BY 1""")
def _(shop):
    return K.rolling_concentration(product_days(shop), "product_id")


@query("D31c_top_product_before", "date:t top_value_before:d", """
WITH p AS (SELECT order_date AS d, product_id, sum(revenue) AS v FROM x_sold GROUP BY 1, 2), t AS (SELECT d, max(v) AS v FROM p GROUP BY 1)
SELECT x.date, coalesce(t.v, 0) AS top_value_before FROM x_days x LEFT JOIN t ON t.d = x.date - 1
WHERE x.date >= (SELECT min(d) FROM p) + 7 AND EXISTS (SELECT 1 FROM p WHERE p.d BETWEEN x.date - 30 AND x.date - 1)""")
def _(shop):
    """Revenue of the best product on the day before."""
    return K.rolling_concentration(product_days(shop), "product_id")


@query("D31b_rolling_shares", "category:s date:t share:d", f"""
WITH d AS (SELECT category, order_date AS date, sum(revenue) AS revenue FROM x_lines GROUP BY 1, 2),
     e AS (SELECT category, min(date) AS a, max(date) AS b FROM d GROUP BY 1),
     g AS (SELECT category, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM e),
     f AS (SELECT g.category, g.date, coalesce(revenue, 0) AS revenue FROM g LEFT JOIN d ON d.category = g.category AND d.date = g.date),
     r AS (SELECT category, date, {roll_sql("revenue", "sum", 30, 7, 1, "PARTITION BY category")} AS v FROM f)
SELECT category, date, v / nullif(sum(v) OVER (PARTITION BY date), 0) AS share FROM r""")
def _(shop):
    daily = shop.lines.groupBy("category", F.col("order_date").alias("date")).agg(
        F.sum("revenue").alias("revenue")
    )
    return K.rolling_shares(daily, "category")


@query("D32_financial_summary", "category:s revenue:d cost:d profit:d quantity:d mean_price:d lines:i margin:d cost_per_unit:d revenue_rank:i profit_rank:i margin_rank:i", """
WITH s AS (SELECT category, sum(revenue) AS revenue, sum(cost) AS cost, sum(profit) AS profit, sum(quantity) AS quantity,
                  avg(unit_price) AS mean_price, count(*) AS lines, sum(profit) / sum(revenue) AS margin, sum(cost) / sum(quantity) AS cost_per_unit
           FROM x_lines GROUP BY 1)
SELECT *, rank() OVER (ORDER BY revenue DESC) AS revenue_rank, rank() OVER (ORDER BY profit DESC) AS profit_rank,
       rank() OVER (ORDER BY margin DESC) AS margin_rank FROM s""")
def _(shop):
    return K.financial_summary(shop.lines, "category")


@query("D33_quadrants", "quadrant:s segments:i revenue:d profit:d mean_margin:d", """
WITH s AS (SELECT segment, sum(revenue) AS revenue, sum(profit) AS profit, sum(profit) / sum(revenue) AS margin FROM x_lines GROUP BY 1),
     m AS (SELECT quantile_cont(revenue, 0.5) AS a, quantile_cont(margin, 0.5) AS b FROM s)
SELECT CASE WHEN revenue >= a THEN 'high' ELSE 'low' END || '_revenue_' || CASE WHEN margin >= b THEN 'high' ELSE 'low' END || '_margin' AS quadrant,
       count(*) AS segments, sum(revenue) AS revenue, sum(profit) AS profit, avg(margin) AS mean_margin FROM s, m GROUP BY 1""")
def _(shop):
    marked = K.quadrants(K.financial_summary(shop.lines, "segment"), "revenue", "margin", "revenue", "margin")
    return marked.groupBy("quadrant").agg(
        F.count("*").alias("segments"),
        F.sum("revenue").alias("revenue"),
        F.sum("profit").alias("profit"),
        F.avg("margin").alias("mean_margin"),
    )


@query("D34_volume_and_profit", "kind:s product_id:i quantity:d profit:d", """
WITH p AS (SELECT product_id, sum(quantity) AS quantity, sum(revenue) - sum(quantity) * any_value(cogs) AS profit FROM x_lines GROUP BY 1),
     q AS (SELECT quantile_cont(quantity, 0.25) AS lo, quantile_cont(quantity, 0.75) AS hi FROM p)
(SELECT 'volume_without_profit' AS kind, product_id, quantity, profit FROM p, q WHERE quantity > hi ORDER BY profit, product_id LIMIT 10)
UNION ALL
(SELECT 'profit_without_volume', product_id, quantity, profit FROM p, q WHERE quantity < lo ORDER BY profit DESC, product_id LIMIT 10)""")
def _(shop):
    return K.volume_and_profit(K.product_sales(shop.items, shop.products))


@query("D35_daily_financials", "date:t profit:d margin:d margin_lag_1:d margin_roll_mean_30:d profit_roll_mean_7:d", f"""
WITH d AS (SELECT date, revenue - cogs AS profit, (revenue - cogs) / nullif(revenue, 0) AS margin FROM x_daily)
SELECT date, profit, margin, lag(margin) OVER (ORDER BY date) AS margin_lag_1, {roll_sql("margin", "mean", 30, 7, 1)} AS margin_roll_mean_30,
       {roll_sql("profit", "mean", 7, 3, 1)} AS profit_roll_mean_7 FROM d""")
def _(shop):
    return K.daily_financials(shop.lines)


# --- customers ------------------------------------------------------------------

view("x_rollup", """
SELECT customer_id, count(*) AS orders, sum(order_value) AS total_value, avg(order_value) AS mean_value,
       min(order_date) AS first_order, max(order_date) AS last_order FROM x_orders GROUP BY 1
""")
view("x_gaps", """
SELECT order_id, customer_id, order_date, order_date - lag(order_date) OVER w AS gap, row_number() OVER w AS seq,
       min(order_date) OVER (PARTITION BY customer_id) AS first_date
FROM x_orders WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id)
""")


@query("D36_customer_rollup", "customer_id:i orders:i total_value:d mean_value:e first_order:t last_order:t", "SELECT * FROM x_rollup")
def _(shop):
    return C.rollup(shop)


@query("D37_repeat_summary", "customers:i ordering_customers:i never_ordered:i one_time_customers:i repeat_customers:i repeat_rate:d mean_orders:d median_orders:d max_orders:i", """
SELECT (SELECT count(*) FROM x_customers) AS customers, count(*) AS ordering_customers,
       (SELECT count(*) FROM x_customers WHERE customer_id NOT IN (SELECT customer_id FROM x_orders)) AS never_ordered,
       count(*) FILTER (orders = 1) AS one_time_customers, count(*) FILTER (orders > 1) AS repeat_customers,
       1.0 * count(*) FILTER (orders > 1) / count(*) AS repeat_rate, avg(orders) AS mean_orders,
       quantile_cont(orders, 0.5) AS median_orders, max(orders) AS max_orders FROM x_rollup""")
def _(shop):
    return U.repeat_summary(C.rollup(shop), shop.customers)


@query("D38_repeat_by", "channel:s customers:i orders:i orders_per_customer:d median_orders:d repeat_rate:d mean_lifetime_days:d mean_gap_days:d revenue:d revenue_per_customer:d", """
WITH g AS (SELECT channel, avg(gap) AS mean_gap_days FROM x_gaps JOIN x_customers USING (customer_id) GROUP BY 1)
SELECT channel, count(*) AS customers, sum(orders) AS orders, avg(orders) AS orders_per_customer, quantile_cont(orders, 0.5) AS median_orders,
       1.0 * count(*) FILTER (orders > 1) / count(*) AS repeat_rate, avg(last_order - first_order) AS mean_lifetime_days,
       any_value(mean_gap_days) AS mean_gap_days, sum(total_value) AS revenue, sum(total_value) / count(*) AS revenue_per_customer
FROM x_rollup JOIN x_customers USING (customer_id) JOIN g USING (channel) GROUP BY 1""")
def _(shop):
    return U.repeat_by(C.rollup(shop), shop.customers, "channel")


@query("D39_frequency_tiers", "tier:s customers:i revenue:d revenue_share:d", """
SELECT CASE WHEN orders <= 1 THEN 'one_time' WHEN orders <= 3 THEN '2_3_orders' WHEN orders <= 5 THEN '4_5_orders' ELSE '6_plus_orders' END AS tier,
       count(*) AS customers, sum(total_value) AS revenue, sum(total_value) / sum(sum(total_value)) OVER () AS revenue_share
FROM x_rollup GROUP BY 1""")
def _(shop):
    return U.frequency_tiers(C.rollup(shop))


@query("D40_new_vs_returning", "month:t orders:i repeat_orders:i active_customers:i new_customers:i returning_customers:i repeat_order_ratio:d repeat_customer_ratio:d", """
WITH o AS (SELECT *, CAST(date_trunc('month', order_date) AS DATE) AS month FROM x_gaps)
SELECT month, count(*) AS orders, count(*) FILTER (seq > 1) AS repeat_orders, count(DISTINCT customer_id) AS active_customers,
       count(*) FILTER (seq = 1) AS new_customers, count(DISTINCT customer_id) - count(*) FILTER (seq = 1) AS returning_customers,
       1.0 * count(*) FILTER (seq > 1) / count(*) AS repeat_order_ratio,
       1.0 * (count(DISTINCT customer_id) - count(*) FILTER (seq = 1)) / count(DISTINCT customer_id) AS repeat_customer_ratio FROM o GROUP BY 1""")
def _(shop):
    return U.new_vs_returning(shop.orders)


view("x_cohorts", """
WITH a AS (SELECT DISTINCT customer_id, CAST(date_trunc('month', order_date) AS DATE) AS month,
                  CAST(date_trunc('month', first_date) AS DATE) AS cohort FROM x_gaps),
     s AS (SELECT cohort, count(DISTINCT customer_id) AS cohort_size FROM a GROUP BY 1)
SELECT cohort, date_diff('month', cohort, month) AS months_since, count(*) AS customers, any_value(cohort_size) AS cohort_size,
       1.0::DOUBLE * count(*) / any_value(cohort_size) AS retention FROM a JOIN s USING (cohort) GROUP BY 1, 2
""")


@query("D41_cohort_retention", "cohort:t months_since:i customers:i cohort_size:i retention:d", "SELECT * FROM x_cohorts")
def _(shop):
    return U.cohort_retention(shop.orders)


@query("D41b_cohort_strength", "cohort:t cohort_size:i mean_retention_1_6:d m0:d m1:d m6:d", """
WITH s AS (SELECT cohort, any_value(cohort_size) AS cohort_size, coalesce(sum(retention) FILTER (months_since BETWEEN 1 AND 6), 0) AS t,
                  coalesce(sum(retention) FILTER (months_since = 0), 0) AS m0, coalesce(sum(retention) FILTER (months_since = 1), 0) AS m1,
                  coalesce(sum(retention) FILTER (months_since = 6), 0) AS m6 FROM x_cohorts GROUP BY 1)
SELECT *, t / least(6, (SELECT max(months_since) FROM x_cohorts)) AS mean_retention_1_6 FROM s""")
def _(shop):
    retention = U.cohort_retention(shop.orders)
    return U.cohort_strength(retention).join(U.retention_matrix(retention, [0, 1, 6]), "cohort")


@query("D42_retention_features", "date:t orders:i active_lag_1:i new_orders_lag_1:i mean_gap_lag_1:d repeat_order_ratio_30:d returning_ratio_30:d mean_gap_roll_mean_30:d", f"""
WITH d AS (SELECT order_date AS date, count(*) AS orders, count(DISTINCT customer_id) AS active, count(*) FILTER (seq > 1) AS rep,
                  count(*) FILTER (order_date = first_date) AS new_orders, count(*) FILTER (order_date > first_date) AS ret,
                  avg(gap) AS mean_gap FROM x_gaps GROUP BY 1),
     f AS (SELECT x.date, coalesce(orders, 0) AS orders, coalesce(active, 0) AS active, coalesce(rep, 0) AS rep,
                  coalesce(new_orders, 0) AS new_orders, coalesce(ret, 0) AS ret, mean_gap FROM x_days x LEFT JOIN d ON d.date = x.date)
SELECT date, orders, lag(active) OVER (ORDER BY date) AS active_lag_1, lag(new_orders) OVER (ORDER BY date) AS new_orders_lag_1,
       lag(mean_gap) OVER (ORDER BY date) AS mean_gap_lag_1,
       {roll_sql("rep", "sum", 30, 7, 1)} * 1.0 / nullif({roll_sql("orders", "sum", 30, 7, 1)}, 0) AS repeat_order_ratio_30,
       {roll_sql("ret", "sum", 30, 7, 1)} * 1.0 / nullif({roll_sql("active", "sum", 30, 7, 1)}, 0) AS returning_ratio_30,
       {roll_sql("mean_gap", "mean", 30, 7, 1)} AS mean_gap_roll_mean_30 FROM f""")
def _(shop):
    return U.retention_features(U.retention_daily(shop.orders))


@query("D43_channel_quality", "channel:s customers:i orders:i orders_per_customer:d one_time_ratio:d repeat_ratio:d revenue:d revenue_per_customer:d revenue_per_order:d median_revenue_per_customer:d quality_score:i", """
WITH s AS (SELECT channel, count(*) AS customers, sum(orders) AS orders, avg(orders) AS orders_per_customer,
                  1.0 * count(*) FILTER (orders = 1) / count(*) AS one_time_ratio, 1.0 * count(*) FILTER (orders > 1) / count(*) AS repeat_ratio,
                  sum(total_value) AS revenue, avg(total_value) AS revenue_per_customer, sum(total_value) / sum(orders) AS revenue_per_order,
                  quantile_cont(total_value, 0.5) AS median_revenue_per_customer FROM x_rollup JOIN x_customers USING (customer_id) GROUP BY 1)
SELECT *, rank() OVER (ORDER BY customers DESC) + rank() OVER (ORDER BY repeat_ratio DESC) + rank() OVER (ORDER BY revenue_per_customer DESC)
       + rank() OVER (ORDER BY revenue DESC) AS quality_score FROM s""")
def _(shop):
    return U.acquisition_channel_quality(C.rollup(shop), shop.customers)


@query("D44_acquisition_over_time", "month:t channel:s new_customers:i repeat_ratio:d share:d", """
SELECT CAST(date_trunc('month', first_order) AS DATE) AS month, channel, count(*) AS new_customers,
       1.0 * count(*) FILTER (orders > 1) / count(*) AS repeat_ratio,
       1.0 * count(*) / sum(count(*)) OVER (PARTITION BY CAST(date_trunc('month', first_order) AS DATE)) AS share
FROM x_rollup JOIN x_customers USING (customer_id) GROUP BY 1, 2""")
def _(shop):
    return U.acquisition_over_time(C.rollup(shop), shop.customers)


@query("D45_acquisition_features", "channel:s date:t new_customers:i channel_share_30:d", f"""
WITH d AS (SELECT channel, first_order AS date, count(*) AS n FROM x_rollup JOIN x_customers USING (customer_id) GROUP BY 1, 2),
     e AS (SELECT channel, min(date) AS a, max(date) AS b FROM d GROUP BY 1),
     g AS (SELECT channel, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM e),
     f AS (SELECT g.channel, g.date, coalesce(n, 0) AS n FROM g LEFT JOIN d ON d.channel = g.channel AND d.date = g.date),
     r AS (SELECT channel, date, n, {roll_sql("n", "sum", 30, 7, 1, "PARTITION BY channel")} AS v FROM f)
SELECT channel, date, n AS new_customers, v * 1.0 / nullif(sum(v) OVER (PARTITION BY date), 0) AS channel_share_30 FROM r""")
def _(shop):
    return U.acquisition_daily_features(C.rollup(shop), shop.customers)


view("x_order_rows", """
SELECT o.*, revenue, quantity, lines, products, has_promo, order_value AS payment_value, order_id % 12 + 1 AS installments,
       returned_quantity, refund, returned_quantity IS NOT NULL AS is_returned
FROM x_orders o
LEFT JOIN (SELECT order_id, sum(revenue) AS revenue, sum(quantity) AS quantity, count(*) AS lines, count(DISTINCT product_id) AS products,
                  bool_or(promo_used) AS has_promo FROM x_items GROUP BY 1) i USING (order_id)
LEFT JOIN (SELECT order_id, sum(return_quantity) AS returned_quantity, sum(refund_amount) AS refund FROM x_returns GROUP BY 1) r USING (order_id)
""")


@query("D46_demographics", "age_group:s channel:s customers:i orders:i revenue:d returned_orders:i refund:d median_order_value:d revenue_share:d aov:e return_rate:d refund_to_revenue:d", """
WITH o AS (SELECT r.*, channel, CASE WHEN customer_id % 2 = 0 THEN '25_34' ELSE '35_44' END AS age_group FROM x_order_rows r JOIN x_customers USING (customer_id))
SELECT age_group, channel, count(DISTINCT customer_id) AS customers, count(*) AS orders, sum(revenue) AS revenue,
       count(*) FILTER (is_returned) AS returned_orders, coalesce(sum(refund), 0) AS refund, quantile_cont(revenue, 0.5) AS median_order_value,
       sum(revenue) / sum(sum(revenue)) OVER () AS revenue_share, sum(revenue) / count(*) AS aov,
       1.0 * count(*) FILTER (is_returned) / count(*) AS return_rate, coalesce(sum(refund), 0) / sum(revenue) AS refund_to_revenue
FROM o GROUP BY 1, 2""")
def _(shop):
    age = F.when(F.col("customer_id") % 2 == 0, "25_34").otherwise("35_44")
    people = shop.customers.select("customer_id", "channel", age.alias("age_group"))
    return U.demographic_summary(C.order_rows(shop).join(people, "customer_id"), ["age_group", "channel"])


# --- promotions -----------------------------------------------------------------

USAGE = """
SELECT {key} AS grp, count(*) AS lines, count(*) FILTER (promo_used) AS promo_lines, count(DISTINCT promo_id) AS promos,
       sum(quantity) AS quantity, sum(revenue) AS revenue, 1.0 * count(*) FILTER (promo_used) / count(*) AS line_ratio,
       coalesce(sum(quantity) FILTER (promo_used), 0) / sum(quantity) AS quantity_share,
       coalesce(sum(revenue) FILTER (promo_used), 0) / sum(revenue) AS revenue_share FROM x_lines GROUP BY 1"""
USAGE_COLUMNS = "lines:i promo_lines:i promos:i quantity:d revenue:d line_ratio:d quantity_share:d revenue_share:d"
view("x_promo_daily", USAGE.format(key="order_date"))


@query("D47_promo_usage", f"grp:s {USAGE_COLUMNS}", " UNION ALL ".join(
    USAGE.format(key=k) for k in ("category", "segment", "'all'")))
def _(shop):
    dimensions = {"category": F.col("category"), "segment": F.col("segment"), "all": F.lit("all")}
    return R.promo_usage(A.by_each(shop.lines, dimensions), ["dim", "grp"])


@query("D47b_promo_usage_daily", f"grp:t {USAGE_COLUMNS}", "SELECT * FROM x_promo_daily")
def _(shop):
    return R.promo_usage(shop.lines, ["order_date"]).withColumnRenamed("order_date", "grp")


@query("D48_promo_seasonality", "kind:s part:i mean_line_ratio:d mean_revenue_share:d days:i", """
SELECT 'month' AS kind, month(grp) AS part, avg(line_ratio) AS mean_line_ratio, avg(revenue_share) AS mean_revenue_share, count(*) AS days
FROM x_promo_daily GROUP BY 2
UNION ALL SELECT 'quarter', quarter(grp), avg(line_ratio), avg(revenue_share), count(*) FROM x_promo_daily GROUP BY 2""")
def _(shop):
    daily = R.promo_usage(shop.lines, ["order_date"])
    return Q.union_all(
        [
            R.promo_seasonality(daily, f("order_date")).withColumn("kind", F.lit(n))
            for n, f in (("month", F.month), ("quarter", F.quarter))
        ]
    )


view("x_calendar", """
WITH e AS (SELECT d.date, p.promo_id, p.promo_type, p.discount_value,
                  row_number() OVER (PARTITION BY d.date ORDER BY p.promo_id) AS k
           FROM x_daily d LEFT JOIN x_promotions p ON d.date BETWEEN p.start_date AND p.end_date)
SELECT date, count(promo_id) AS active_promos, count(*) FILTER (promo_type = 'percentage') AS percentage_promos,
       count(*) FILTER (promo_type = 'fixed') AS fixed_promos, 0 AS other_promos, avg(discount_value) AS mean_discount,
       max(discount_value) AS max_discount, min(discount_value) AS min_discount,
       coalesce(string_agg(promo_id, ', ' ORDER BY promo_id) FILTER (k <= 20), '') AS promo_ids, count(promo_id) > 0 AS has_promo
FROM e GROUP BY 1
""")


def calendar(shop):
    return R.promo_calendar(shop.promotions, C.daily(shop))


@query("D49_promo_calendar", "date:t active_promos:i percentage_promos:i fixed_promos:i other_promos:i mean_discount:e max_discount:d min_discount:d promo_ids:s has_promo:b",
       "SELECT * FROM x_calendar")
def _(shop):
    return calendar(shop)


@query("D50_promo_type_summary", "promo_type:s promos:i mean_days:d median_days:d mean_discount:e median_discount:d active_days:i", """
SELECT promo_type, count(*) AS promos, avg(end_date - start_date + 1) AS mean_days, quantile_cont(end_date - start_date + 1, 0.5) AS median_days,
       avg(discount_value) AS mean_discount, quantile_cont(discount_value, 0.5) AS median_discount, sum(end_date - start_date + 1) AS active_days
FROM x_promotions GROUP BY 1""")
def _(shop):
    return R.promo_type_summary(shop.promotions)


@query("D51_promo_matrix", "year:i month:i mean_active:d active_days:i days:i active_rate:d", """
SELECT year(date) AS year, month(date) AS month, avg(active_promos) AS mean_active, count(*) FILTER (has_promo) AS active_days,
       count(*) AS days, 1.0 * count(*) FILTER (has_promo) / count(*) AS active_rate FROM x_calendar GROUP BY 1, 2""")
def _(shop):
    return R.promo_calendar_matrix(calendar(shop))


COMPARE = """
SELECT '{kind}' AS kind, {label} AS label, count(*) AS days, sum(revenue) AS revenue, avg(revenue) AS mean_revenue,
       quantile_cont(revenue, 0.5) AS median_revenue, avg(orders) AS mean_orders, avg(revenue / nullif(orders, 0)) AS mean_aov
FROM x_daily JOIN x_calendar USING (date) GROUP BY 2"""


@query("D52_promo_days", "kind:s label:s days:i revenue:d mean_revenue:d median_revenue:d mean_orders:d mean_aov:d", " UNION ALL ".join([
    COMPARE.format(kind="active", label="CASE WHEN has_promo THEN 'promo days' ELSE 'non-promo days' END"),
    COMPARE.format(kind="type", label="CASE WHEN percentage_promos > 0 AND fixed_promos > 0 THEN 'mixed percentage and fixed' WHEN percentage_promos > 0 THEN 'percentage promo active' WHEN fixed_promos > 0 THEN 'fixed promo active' ELSE 'no active promo' END"),
    COMPARE.format(kind="overlap", label="CASE WHEN active_promos = 0 THEN '0 active promos' WHEN active_promos = 1 THEN '1 active promo' WHEN active_promos <= 3 THEN '2-3 active promos' ELSE '4+ active promos' END"),
]))
def _(shop):
    daily = C.daily(shop).select("date", "revenue", "orders")
    active = F.when(F.col("has_promo"), "promo days").otherwise("non-promo days")
    labels = {"active": active, "type": R.type_label(), "overlap": R.overlap_label(F.col("active_promos"))}
    return Q.union_all(
        [
            R.promo_days_comparison(daily, calendar(shop), label).withColumn("kind", F.lit(n))
            for n, label in labels.items()
        ]
    )


@query("D53_promo_lines", "promo_used:b lines:i quantity:d revenue:d mean_revenue:d mean_quantity:d mean_discount:d mean_rate:d profit:d margin:d median_revenue:d", """
SELECT promo_used, count(*) AS lines, sum(quantity) AS quantity, sum(revenue) AS revenue, avg(revenue) AS mean_revenue, avg(quantity) AS mean_quantity,
       avg(discount_amount) AS mean_discount, avg(discount_rate) AS mean_rate, sum(profit) AS profit, sum(profit) / sum(revenue) AS margin,
       quantile_cont(revenue, 0.5) AS median_revenue FROM x_lines GROUP BY 1""")
def _(shop):
    return R.promo_line_comparison(shop.lines)


@query("D54_promo_decomposition", "date:t promo_revenue:d plain_revenue:d revenue_share:d quantity_share:d line_ratio:d margin:d promo_margin:d plain_margin:d promo_day:b", """
WITH s AS (SELECT order_date AS date, coalesce(sum(revenue) FILTER (promo_used), 0) AS promo_revenue, coalesce(sum(revenue) FILTER (NOT promo_used), 0) AS plain_revenue,
                  coalesce(sum(quantity) FILTER (promo_used), 0) AS pq, sum(quantity) AS q, coalesce(sum(profit) FILTER (promo_used), 0) AS pp,
                  coalesce(sum(profit) FILTER (NOT promo_used), 0) AS np, count(*) FILTER (promo_used) AS pl, count(*) AS l FROM x_lines GROUP BY 1)
SELECT date, promo_revenue, plain_revenue, promo_revenue / (promo_revenue + plain_revenue) AS revenue_share, pq / q AS quantity_share,
       1.0 * pl / l AS line_ratio, (pp + np) / (promo_revenue + plain_revenue) AS margin, pp / nullif(promo_revenue, 0) AS promo_margin,
       np / nullif(plain_revenue, 0) AS plain_margin, pl > 0 AS promo_day FROM s""")
def _(shop):
    return R.promo_daily_decomposition(shop.lines)


@query("D55_promo_profit_by_year", "year:i has_promo:b revenue:d cost:d profit:d", """
SELECT year(order_date) AS year, promo_id IS NOT NULL AS has_promo, sum(quantity * unit_price) AS revenue, sum(cost) AS cost,
       sum(quantity * unit_price - cost) AS profit FROM x_lines GROUP BY 1, 2""")
def _(shop):
    return R.promo_profit_by_year(shop.lines)


@query("D56_promo_lift", "segment:s lines:i usage_rate:d revenue_share:d quantity_lift:d revenue_lift:d promo_margin:d plain_margin:d margin_gap:d small_sample:b", """
WITH s AS (SELECT segment, count(*) AS lines, 1.0 * count(*) FILTER (promo_used) / count(*) AS usage_rate,
       sum(revenue) FILTER (promo_used) / sum(revenue) AS revenue_share, avg(quantity) FILTER (promo_used) / avg(quantity) FILTER (NOT promo_used) AS quantity_lift,
       avg(revenue) FILTER (promo_used) / avg(revenue) FILTER (NOT promo_used) AS revenue_lift,
       sum(profit) FILTER (promo_used) / sum(revenue) FILTER (promo_used) AS promo_margin,
       sum(profit) FILTER (NOT promo_used) / sum(revenue) FILTER (NOT promo_used) AS plain_margin FROM x_lines GROUP BY 1)
SELECT *, promo_margin - plain_margin AS margin_gap, lines < 100 AS small_sample FROM s""")
def _(shop):
    return R.promo_lift(shop.lines, "segment")


@query("D57_discount_response", "bin:i lines:i min_rate:d max_rate:d mean_quantity:d revenue:d mean_margin:d", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY discount_rate, order_id, product_id, quantity, revenue) AS rn, count(*) OVER () AS n
           FROM x_lines WHERE discount_rate > 0)
SELECT greatest(1, ceil((rn - 1) * 5.0::DOUBLE / (n - 1))) AS bin, count(*) AS lines, min(discount_rate) AS min_rate, max(discount_rate) AS max_rate,
       avg(quantity) AS mean_quantity, sum(revenue) AS revenue, avg(profit / nullif(revenue, 0)) AS mean_margin FROM r GROUP BY 1""")
def _(shop):
    lines = shop.lines
    return R.discount_response(lines, ["order_id", "product_id"])


@query("D57b_discount_quantity_corr", "correlation:d", """
SELECT corr(discount_rate, quantity) AS correlation FROM x_lines WHERE discount_rate > 0""")
def _(shop):
    return shop.items.where("discount_rate > 0").agg(safe_corr(F.col("discount_rate"), F.col("quantity")).alias("correlation"))


TRADEOFF = """
WITH t AS (SELECT coalesce(promo_type, 'no_promo') AS promo_type, sum(revenue) AS revenue, sum(profit) AS profit
           FROM x_lines l LEFT JOIN x_promotions p ON p.promo_id = l.promo_id GROUP BY 1),
     a AS (SELECT promo_type, count(DISTINCT date) AS d FROM x_daily JOIN x_promotions ON date BETWEEN start_date AND end_date GROUP BY 1),
     j AS (SELECT t.*, coalesce(d, (SELECT count(*) FROM x_daily)) AS active_days FROM t LEFT JOIN a USING (promo_type)),
     k AS (SELECT *, revenue / active_days AS daily_revenue, profit * 100 / revenue AS margin_pct FROM j)
SELECT *, daily_revenue / (SELECT quantile_cont(daily_revenue, 0.5) FROM k) * 100 AS performance_index FROM k"""


@query("D58_promo_tradeoff", "promo_type:s revenue:d profit:d active_days:i daily_revenue:d margin_pct:d performance_index:d", TRADEOFF)
def tradeoff(shop):
    return R.promo_tradeoff(shop.lines, shop.promotions, C.daily(shop))


@query("D59_promo_features", "date:t line_ratio_lag_1:d line_ratio_lag_7:d line_ratio_lag_30:d line_ratio_roll_mean_7:d line_ratio_roll_mean_30:d line_ratio_history:d", f"""
WITH p AS (SELECT grp AS date, line_ratio FROM x_promo_daily)
SELECT date, lag(line_ratio, 1) OVER (ORDER BY date) AS line_ratio_lag_1, lag(line_ratio, 7) OVER (ORDER BY date) AS line_ratio_lag_7,
       lag(line_ratio, 30) OVER (ORDER BY date) AS line_ratio_lag_30, {roll_sql("line_ratio", "mean", 7, 3, 1)} AS line_ratio_roll_mean_7,
       {roll_sql("line_ratio", "mean", 30, 7, 1)} AS line_ratio_roll_mean_30,
       CASE WHEN count(line_ratio) OVER h >= 7 THEN avg(line_ratio) OVER h END AS line_ratio_history
FROM p WINDOW h AS (PARTITION BY month(date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(shop):
    daily = R.promo_usage(shop.lines, ["order_date"]).withColumnRenamed("order_date", "date")
    return R.promo_features(daily)
