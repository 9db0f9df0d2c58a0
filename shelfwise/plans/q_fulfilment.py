"""Return, review, payment, delivery and regional analyses."""

from pyspark.sql import functions as F

from shelfwise.functions import scalars as S
from shelfwise.functions.ordered import quantiles
from shelfwise.operators import concentration as K
from shelfwise.operators import derive as P
from shelfwise.operators import fulfilment as X
from shelfwise.operators import quality as Q
from shelfwise.operators import regions as G
from shelfwise.operators import timeseries as T
from shelfwise.operators.aggregate import by_each, correlations, safe_corr
from shelfwise.plans import common as C
from shelfwise.plans.q_series import roll_sql
from shelfwise.plans.registry import query, view

view("x_reasons", """
SELECT *, CASE return_reason WHEN 'Too Small' THEN 'wrong_size' WHEN 'changed-mind' THEN 'changed_mind' WHEN 'Damaged' THEN 'defective'
               ELSE replace(return_reason, ' ', '_') END AS reason FROM x_returns
""")
view("x_returned", """
SELECT s.*, coalesce(returned_quantity, 0) AS returned_quantity, coalesce(refund, 0) AS refund, coalesce(wrong_size, 0) AS wrong_size, coalesce(defective, 0) AS defective
FROM (SELECT order_id, product_id, sum(quantity) AS quantity, sum(revenue) AS revenue, count(*) AS lines, max(discount_rate) AS discount_rate,
             bool_or(promo_used) AS promo_used, min(order_date) AS order_date, min(category) AS category, min(segment) AS segment, min(size) AS size
      FROM x_lines GROUP BY 1, 2) s
LEFT JOIN (SELECT order_id, product_id, sum(return_quantity) AS returned_quantity, sum(refund_amount) AS refund,
                  count(*) FILTER (reason = 'wrong_size') AS wrong_size, count(*) FILTER (reason = 'defective') AS defective
           FROM x_reasons GROUP BY 1, 2) r USING (order_id, product_id)
""")


def returned(shop):
    return X.returned_lines(shop.lines, shop.returns)


RATE = """
SELECT '{d}' AS dim, CAST({d} AS VARCHAR) AS grp, sum(quantity) AS quantity, sum(returned_quantity) AS returned_quantity, sum(lines) AS lines,
       count(*) FILTER (returned_quantity > 0) AS returned_lines, sum(refund) AS refund, sum(revenue) AS revenue,
       sum(returned_quantity) / sum(quantity) AS return_rate, sum(refund) / sum(revenue) AS refund_ratio, sum(revenue) - sum(refund) AS net_revenue,
       sum(lines) < greatest(20, quantile_cont(sum(lines), 0.1) OVER ()) AS small_sample FROM x_returned GROUP BY 2"""
RATE_COLUMNS = "dim:s grp:s quantity:d returned_quantity:d lines:i returned_lines:i refund:d revenue:d return_rate:d refund_ratio:d net_revenue:d small_sample:b"


@query("D92_return_rate", RATE_COLUMNS, " UNION ALL ".join(RATE.format(d=d) for d in ("category", "size", "promo_used")))
def _(shop):
    lines = by_each(returned(shop), {d: F.col(d) for d in ("category", "size", "promo_used")})
    return X.return_rate(lines, ["dim", "grp"], within=["dim"])


@query("D92b_category_size_rate", "category:s size:i return_rate:d", """
SELECT category, size, sum(returned_quantity) / sum(quantity) AS return_rate FROM x_returned GROUP BY 1, 2""")
def _(shop):
    return X.return_rate(returned(shop), ["category", "size"])


@query("D93_net_revenue_daily", "date:t gross:d refund:d returns:i net:d refund_ratio:d material:b", """
WITH d AS (SELECT s.date, revenue AS gross, coalesce(refund, 0) AS refund, coalesce(n, 0) AS returns FROM x_sales s
           LEFT JOIN (SELECT return_date AS date, sum(refund_amount) AS refund, count(*) AS n FROM x_returns GROUP BY 1) r ON r.date = s.date),
     k AS (SELECT *, gross - refund AS net, refund / gross AS refund_ratio FROM d)
SELECT *, refund_ratio >= (SELECT quantile_cont(refund_ratio, 0.95) FROM k) AS material FROM k""")
def _(shop):
    return X.net_revenue_daily(shop.sales, shop.returns)


@query("D94_return_reasons", "category:s reason:s returns:i quantity:d refund:d share:d", """
SELECT category, reason, count(*) AS returns, sum(return_quantity) AS quantity, sum(refund_amount) AS refund,
       count(*) / sum(count(*)) OVER (PARTITION BY category) AS share FROM x_reasons JOIN x_products USING (product_id) GROUP BY 1, 2""")
def _(shop):
    return X.return_reasons(shop.returns.join(shop.products, "product_id"), ["category"])


@query("D94b_return_reasons_monthly", "month:t reason:s returns:i share:d", """
SELECT CAST(date_trunc('month', return_date) AS DATE) AS month, reason, count(*) AS returns,
       count(*) / sum(count(*)) OVER (PARTITION BY CAST(date_trunc('month', return_date) AS DATE)) AS share FROM x_reasons GROUP BY 1, 2""")
def _(shop):
    return X.return_reasons(shop.returns, [S.month_start(F.col("return_date")).alias("month")])


REASON = """
SELECT '{d}' AS dim, CAST({d} AS VARCHAR) AS grp, count(*) AS lines, count(*) FILTER (returned_quantity > 0) AS returned_lines,
       count(*) FILTER (wrong_size > 0) AS wrong_size, count(*) FILTER (defective > 0) AS defective,
       1.0 * count(*) FILTER (wrong_size > 0) / count(*) AS wrong_size_rate, 1.0 * count(*) FILTER (defective > 0) / count(*) AS defect_rate,
       1.0 * count(*) FILTER (wrong_size > 0) / nullif(count(*) FILTER (returned_quantity > 0), 0) AS wrong_size_share FROM x_returned GROUP BY 2"""


@query("D95_reason_rates", "dim:s grp:s lines:i returned_lines:i wrong_size:i defective:i wrong_size_rate:d defect_rate:d wrong_size_share:d",
       " UNION ALL ".join(REASON.format(d=d) for d in ("category", "segment", "size")))
def _(shop):
    lines = by_each(returned(shop), {d: F.col(d) for d in ("category", "segment", "size")})
    return X.reason_rates(lines, ["dim", "grp"])


@query("D96_discount_returns", "discount_group:s quantity:d returned_quantity:d return_rate:d refund_ratio:d net_revenue:d", """
WITH q AS (SELECT quantile_cont(discount_rate, 0.33) AS lo, quantile_cont(discount_rate, 0.67) AS hi FROM x_returned WHERE discount_rate > 0)
SELECT CASE WHEN discount_rate <= 0 THEN 'no_discount' WHEN discount_rate <= lo THEN 'low_discount' WHEN discount_rate <= hi THEN 'medium_discount'
            ELSE 'high_discount' END AS discount_group, sum(quantity) AS quantity, sum(returned_quantity) AS returned_quantity,
       sum(returned_quantity) / sum(quantity) AS return_rate, sum(refund) / sum(revenue) AS refund_ratio, sum(revenue) - sum(refund) AS net_revenue
FROM x_returned, q GROUP BY 1""")
def _(shop):
    return X.return_rate(X.discount_group(returned(shop)), ["discount_group"])


@query("D97_return_pressure", "product_id:i quantity:d returned_quantity:d promo_rate:d return_rate:d", """
WITH p AS (SELECT product_id, sum(quantity) AS quantity, sum(returned_quantity) AS returned_quantity, avg(promo_used::INT) AS promo_rate,
                  sum(returned_quantity) / sum(quantity) AS return_rate FROM x_returned GROUP BY 1)
SELECT * FROM p WHERE quantity >= (SELECT quantile_cont(quantity, 0.75) FROM p) ORDER BY round(return_rate, 9) DESC, product_id LIMIT 20""")
def _(shop):
    return X.return_pressure(returned(shop))


@query("D98_return_features", "date:t returned_lag_30:d refund_lag_30:d returned_roll_sum_30:d refund_roll_mean_30:d", f"""
WITH e AS (SELECT min(return_date) AS a, max(return_date) AS b FROM x_returns),
     x AS (SELECT CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM e),
     d AS (SELECT x.date, coalesce(returned, 0) AS returned, coalesce(refund, 0) AS refund FROM x LEFT JOIN
           (SELECT return_date AS date, sum(return_quantity) AS returned, sum(refund_amount) AS refund FROM x_returns GROUP BY 1) r ON r.date = x.date)
SELECT date, lag(returned, 30) OVER (ORDER BY date) AS returned_lag_30, lag(refund, 30) OVER (ORDER BY date) AS refund_lag_30,
       {roll_sql("returned", "sum", 30, 7, 1)} AS returned_roll_sum_30, {roll_sql("refund", "mean", 30, 7, 1)} AS refund_roll_mean_30 FROM d""")
def _(shop):
    return X.return_features(shop.returns)


RATING = """
SELECT '{d}' AS dim, CAST({d} AS VARCHAR) AS grp, count(*) AS reviews, avg(rating) AS mean_rating, quantile_cont(rating, 0.5) AS median_rating,
       stddev_samp(rating) AS rating_std, 1.0 * count(*) FILTER (rating <= 2) / count(*) AS low_ratio, 1.0 * count(*) FILTER (rating >= 4) / count(*) AS high_ratio,
       count(*) < greatest(20, quantile_cont(count(*), 0.1) OVER ()) AS small_sample FROM x_reviews JOIN x_products USING (product_id) GROUP BY 2"""


@query("D99_rating_by", "dim:s grp:s reviews:i mean_rating:d median_rating:d rating_std:d low_ratio:d high_ratio:d small_sample:b",
       " UNION ALL ".join(RATING.format(d=d) for d in ("category", "segment", "product_id")))
def _(shop):
    rated = shop.reviews.join(shop.products, "product_id")
    rows = by_each(rated, {d: F.col(d) for d in ("category", "segment", "product_id")})
    return X.rating_by(rows, ["dim", "grp"], within=["dim"])


view("x_risk", """
SELECT v.product_id, reviews, mean_rating, low_ratio, quantity, revenue, coalesce(returns, 0) AS returns, coalesce(returned_quantity, 0) AS returned_quantity,
       coalesce(refund, 0) AS refund, coalesce(returned_quantity, 0) / quantity AS return_rate, coalesce(refund, 0) / revenue AS refund_ratio
FROM (SELECT product_id, count(*) AS reviews, avg(rating) AS mean_rating, 1.0::DOUBLE * count(*) FILTER (rating <= 2) / count(*) AS low_ratio FROM x_reviews GROUP BY 1) v
LEFT JOIN (SELECT product_id, sum(quantity) AS quantity, sum(revenue) AS revenue FROM x_items GROUP BY 1) s USING (product_id)
LEFT JOIN (SELECT product_id, count(*) AS returns, sum(return_quantity) AS returned_quantity, sum(refund_amount) AS refund FROM x_returns GROUP BY 1) b USING (product_id)
""")


def risk(shop):
    return X.product_risk(shop.items, shop.reviews, shop.returns)


@query("D100_product_risk", "product_id:i reviews:i mean_rating:d low_ratio:d revenue:d returns:i return_rate:d refund_ratio:d", "SELECT * FROM x_risk")
def _(shop):
    return risk(shop)


view("x_category_risk", """
SELECT category, sum(reviews) AS reviews, sum(mean_rating * reviews) / sum(reviews) AS mean_rating, sum(low_ratio * reviews) / sum(reviews) AS low_ratio,
       sum(quantity) AS quantity, sum(revenue) AS revenue, sum(returned_quantity) AS returned_quantity, sum(refund) AS refund,
       sum(returned_quantity) / sum(quantity) AS return_rate FROM x_risk JOIN x_products USING (product_id) GROUP BY 1
""")


@query("D100b_rating_vs_returns", "level:s x:s correlation:d", """
SELECT 'product' AS level, 'mean_rating' AS x, corr(mean_rating, return_rate) AS correlation FROM x_risk
UNION ALL SELECT 'product', 'low_ratio', corr(low_ratio, return_rate) FROM x_risk
UNION ALL SELECT 'category', 'mean_rating', corr(mean_rating, return_rate) FROM x_category_risk
UNION ALL SELECT 'category', 'low_ratio', corr(low_ratio, return_rate) FROM x_category_risk""")
def _(shop):
    products = risk(shop)
    a = X.rating_vs_returns(products).withColumn("level", F.lit("product"))
    b = X.rating_vs_returns(X.category_risk(products, shop.products)).withColumn("level", F.lit("category"))
    return a.unionByName(b)


@query("D101_rating_monthly", "month:t reviews:i mean_rating:d low_ratio:d worst_category:s worst_rating:d rating_lag_1:d rating_roll_mean_3:d", """
WITH m AS (SELECT CAST(date_trunc('month', review_date) AS DATE) AS month, count(*) AS reviews, avg(rating) AS mean_rating,
                  1.0 * count(*) FILTER (rating <= 2) / count(*) AS low_ratio FROM x_reviews GROUP BY 1),
     c AS (SELECT CAST(date_trunc('month', review_date) AS DATE) AS month, category, round(avg(rating), 9) AS r FROM x_reviews JOIN x_products USING (product_id) GROUP BY 1, 2),
     w AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY r, category) AS p FROM c)
SELECT m.*, category AS worst_category, r AS worst_rating, lag(mean_rating) OVER (ORDER BY m.month) AS rating_lag_1,
       avg(mean_rating) OVER (ORDER BY m.month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rating_roll_mean_3
FROM m JOIN w ON w.month = m.month AND p = 1""")
def _(shop):
    return X.rating_monthly(shop.reviews, shop.products)


@query("D102_review_volume", "date:t reviews:i reviews_lag_7:i reviews_lag_30:i reviews_roll_sum_30:i revenue_next_7:d revenue_next_30:d", f"""
WITH r AS (SELECT review_date AS date, count(*) AS reviews FROM x_reviews GROUP BY 1),
     j AS (SELECT coalesce(s.date, r.date) AS date, revenue, reviews FROM x_sales s FULL JOIN r ON r.date = s.date),
     x AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM j)::TIMESTAMP, (SELECT max(date) FROM j)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date),
     d AS (SELECT x.date, coalesce(revenue, 0) AS revenue, coalesce(reviews, 0) AS reviews FROM x LEFT JOIN j ON j.date = x.date)
SELECT date, reviews, lag(reviews, 7) OVER (ORDER BY date) AS reviews_lag_7, lag(reviews, 30) OVER (ORDER BY date) AS reviews_lag_30,
       {roll_sql("reviews", "sum", 30, 1, 1)} AS reviews_roll_sum_30, CASE WHEN count(*) OVER a = 7 THEN sum(revenue) OVER a END AS revenue_next_7,
       CASE WHEN count(*) OVER b = 30 THEN sum(revenue) OVER b END AS revenue_next_30 FROM d
WINDOW a AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING), b AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)""")
def _(shop):
    return X.review_volume_vs_revenue(shop.sales, shop.reviews)


@query("D103_review_revenue_groups", "product_id:i many_reviews_high_revenue:b many_reviews_low_revenue:b review_and_return_risk:b", """
WITH q AS (SELECT quantile_cont(reviews, 0.5) AS n50, quantile_cont(reviews, 0.75) AS n75, quantile_cont(revenue, 0.5) AS v50, quantile_cont(revenue, 0.75) AS v75,
                  quantile_cont(mean_rating, 0.25) AS r25, quantile_cont(returns, 0.75) AS b75 FROM x_risk),
     m AS (SELECT *, reviews >= greatest(5, floor(n50)) AND reviews >= n75 AS many FROM x_risk, q)
SELECT product_id, many AND revenue >= v75 AS many_reviews_high_revenue, many AND revenue <= v50 AS many_reviews_low_revenue,
       reviews >= n75 AND mean_rating <= r25 AND returns >= b75 AS review_and_return_risk FROM m""")
def _(shop):
    return X.review_revenue_groups(risk(shop))


view("x_rating_panel", """
WITH r AS (SELECT category, CAST(date_trunc('month', review_date) AS DATE) AS month, avg(rating) AS mean_rating, count(*) AS reviews,
                  1.0::DOUBLE * count(*) FILTER (rating <= 2) / count(*) AS low_ratio FROM x_reviews JOIN x_products USING (product_id) GROUP BY 1, 2)
SELECT r.*, revenue, lag(mean_rating, 1) OVER w AS rating_lag_1, lag(mean_rating, 3) OVER w AS rating_lag_3, lag(low_ratio, 1) OVER w AS low_ratio_lag_1,
       lead(revenue, 1) OVER w AS revenue_lead_1, lead(revenue, 3) OVER w AS revenue_lead_3, mean_rating - lag(mean_rating, 1) OVER w AS rating_change
FROM r LEFT JOIN x_category_months m ON m.category = r.category AND m.month = r.month
WINDOW w AS (PARTITION BY r.category ORDER BY r.month)
""")


@query("D104_category_rating_leads", "category:s month:t mean_rating:d rating_lag_1:d rating_lag_3:d revenue_lead_1:d revenue_lead_3:d rating_change:d", "SELECT * FROM x_rating_panel")
def _(shop):
    return X.category_rating_leads(shop.reviews, shop.lines, shop.products)


@query("D104b_rating_lead_correlations", "x:s y:s correlation:d", """
SELECT 'rating_lag_1' AS x, 'revenue_lead_1' AS y, corr(rating_lag_1, revenue_lead_1) AS correlation FROM x_rating_panel
UNION ALL SELECT 'low_ratio_lag_1', 'revenue_lead_1', corr(low_ratio_lag_1, revenue_lead_1) FROM x_rating_panel
UNION ALL SELECT 'rating_lag_3', 'revenue_lead_3', corr(rating_lag_3, revenue_lead_3) FROM x_rating_panel""")
def _(shop):
    return X.rating_lead_correlations(X.category_rating_leads(shop.reviews, shop.lines, shop.products))


RISK = """
SELECT {key} AS grp, CASE WHEN revenue >= v AND mean_rating < r AND return_rate >= b THEN 'high_revenue_low_rating_high_return'
  WHEN revenue >= v AND mean_rating >= r AND return_rate < b THEN 'high_revenue_high_rating_low_return'
  WHEN revenue < v AND mean_rating < r AND return_rate >= b THEN 'low_revenue_low_rating_high_return'
  WHEN reviews >= n AND revenue < v THEN 'high_review_low_revenue' ELSE 'mixed' END AS risk_group
FROM {table}, (SELECT quantile_cont(revenue, 0.5) AS v, quantile_cont(mean_rating, 0.5) AS r, quantile_cont(return_rate, 0.5) AS b,
                      quantile_cont(reviews, 0.5) AS n FROM {table})"""


@query("D105_risk_matrix", "grp:s risk_group:s", RISK.format(key="category", table="x_category_risk") + " UNION ALL " + RISK.format(key="CAST(product_id AS VARCHAR)", table="x_risk"))
def _(shop):
    products = risk(shop)
    a = X.risk_matrix(X.category_risk(products, shop.products)).select(F.col("category").alias("grp"), "risk_group")
    b = X.risk_matrix(products).select(F.col("product_id").cast("string").alias("grp"), "risk_group")
    return a.unionByName(b)


@query("D106_monthly_panel", "month:t revenue:d orders:i reviews:i mean_rating:d returns:i refund:d", """
SELECT coalesce(m.month, v.month, r.month) AS month, revenue, orders, reviews, mean_rating, returns, refund FROM x_monthly m
FULL JOIN (SELECT CAST(date_trunc('month', review_date) AS DATE) AS month, count(*) AS reviews, avg(rating) AS mean_rating FROM x_reviews GROUP BY 1) v ON v.month = m.month
FULL JOIN (SELECT CAST(date_trunc('month', return_date) AS DATE) AS month, count(*) AS returns, sum(refund_amount) AS refund FROM x_returns GROUP BY 1) r
  ON r.month = coalesce(m.month, v.month)""")
def _(shop):
    return X.monthly_trend_panel(C.monthly(shop), shop.reviews, shop.returns)


# --- payments -------------------------------------------------------------------

STATUS = "CASE order_id % 10 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'returned' ELSE 'delivered' END"
view("x_paid", f"SELECT p.*, order_date, {STATUS} AS status FROM x_payments p JOIN x_orders USING (order_id)")


def paid(shop):
    turn = F.col("order_id") % 10
    status = F.when(turn == 0, "cancelled").when(turn == 1, "returned").otherwise("delivered")
    dated = shop.payments.join(shop.orders.select("order_id", "order_date"), "order_id")
    return P.status_flags(dated.withColumn("order_status", status))


@query("D107_payment_methods", "payment_method:s payments:i orders:i value:d mean_value:d value_std:d cancelled_rate:d returned_rate:d completed_rate:d p25:d p50:d p75:d p90:d p95:d share:d value_share:d", """
SELECT payment_method, count(*) AS payments, count(DISTINCT order_id) AS orders, sum(payment_value) AS value, avg(payment_value) AS mean_value,
       stddev_samp(payment_value) AS value_std, 1.0 * count(*) FILTER (status = 'cancelled') / count(*) AS cancelled_rate,
       1.0 * count(*) FILTER (status = 'returned') / count(*) AS returned_rate, 1.0 * count(*) FILTER (status = 'delivered') / count(*) AS completed_rate,
       quantile_cont(payment_value, 0.25) AS p25, quantile_cont(payment_value, 0.5) AS p50, quantile_cont(payment_value, 0.75) AS p75,
       quantile_cont(payment_value, 0.9) AS p90, quantile_cont(payment_value, 0.95) AS p95, count(*) / sum(count(*)) OVER () AS share,
       sum(payment_value) / sum(sum(payment_value)) OVER () AS value_share FROM x_paid GROUP BY 1""")
def _(shop):
    return X.payment_methods(paid(shop))


view("x_mix", """
SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, payment_method, count(*) AS payments, sum(payment_value) AS value,
       count(*) / sum(count(*)) OVER (PARTITION BY CAST(date_trunc('month', order_date) AS DATE)) AS share FROM x_paid GROUP BY 1, 2
""")


@query("D108_payment_mix", "month:t payment_method:s payments:i value:d share:d", "SELECT * FROM x_mix")
def _(shop):
    return X.payment_mix_monthly(paid(shop))


@query("D108b_payment_features", "month:t payments_lag_1:i mean_value_lag_1:d dominant_share_lag_1:d share_0_lag_1:d", """
WITH m AS (SELECT month, sum(payments) AS n, sum(value) / sum(payments) AS v, max(share) AS d, max(share) FILTER (payment_method = '1-URGENT') AS u FROM x_mix GROUP BY 1)
SELECT month, lag(n) OVER w AS payments_lag_1, lag(v) OVER w AS mean_value_lag_1, lag(d) OVER w AS dominant_share_lag_1, lag(u) OVER w AS share_0_lag_1
FROM m WINDOW w AS (ORDER BY month)""")
def _(shop):
    return X.payment_features(X.payment_mix_monthly(paid(shop)), ["1-URGENT", "2-HIGH"])


@query("D109_installments", "installments:i payments:i value:d mean_value:d p50:d p75:d p90:d share:d value_share:d", """
SELECT installments, count(*) AS payments, sum(payment_value) AS value, avg(payment_value) AS mean_value, quantile_cont(payment_value, 0.5) AS p50,
       quantile_cont(payment_value, 0.75) AS p75, quantile_cont(payment_value, 0.9) AS p90, count(*) / sum(count(*)) OVER () AS share,
       sum(payment_value) / sum(sum(payment_value)) OVER () AS value_share FROM x_payments GROUP BY 1""")
def _(shop):
    return X.installments_by(shop.payments, ["installments"])


@query("D109b_installment_orders", "several:b payments:i mean_value:d p50:d mean_term:d", """
SELECT installments > 1 AS several, count(*) AS payments, avg(payment_value) AS mean_value, quantile_cont(payment_value, 0.5) AS p50,
       avg(installments) AS mean_term FROM x_payments GROUP BY 1""")
def _(shop):
    return X.installments_by(shop.payments.withColumn("several", F.col("installments") > 1), ["several"])


view("x_term_months", """
WITH p AS (SELECT *, CAST(date_trunc('month', order_date) AS DATE) AS month FROM x_paid),
     c AS (SELECT month, installments, row_number() OVER (PARTITION BY month ORDER BY count(*) DESC, installments) AS r FROM p GROUP BY 1, 2)
SELECT p.month, count(*) AS payments, count(*) FILTER (p.installments > 1) AS installment_payments, sum(payment_value) FILTER (p.installments > 1) AS installment_value,
       avg(p.installments) AS mean_term, 1.0::DOUBLE * count(*) FILTER (p.installments > 1) / count(*) AS usage_rate, any_value(c.installments) AS common_term
FROM p JOIN c ON c.month = p.month AND r = 1 GROUP BY 1
""")


@query("D109c_installments_monthly", "month:t payments:i installment_payments:i installment_value:d mean_term:d usage_rate:d common_term:i", "SELECT * FROM x_term_months")
def _(shop):
    return X.installments_monthly(paid(shop))


@query("D109d_installments_by_product", "category:s premium:b lines:i usage_rate:d mean_term:d mean_value:d", """
SELECT category, price >= (SELECT quantile_cont(price, 0.8) FROM x_products) AS premium, count(*) AS lines,
       1.0 * count(*) FILTER (installments > 1) / count(*) AS usage_rate, avg(installments) AS mean_term, avg(revenue) AS mean_value
FROM x_items JOIN x_products USING (product_id) JOIN x_payments USING (order_id) GROUP BY 1, 2""")
def _(shop):
    cut = quantiles(shop.products, "price", {"c": 0.8}).scalar()
    goods = shop.products.withColumn("c", cut).withColumn("premium", F.col("price") >= F.col("c"))
    return X.installments_by_product(
        shop.items.join(goods, "product_id"), shop.payments, ["category", "premium"]
    )


@query("D110_installment_features", "month:t usage_rate_lag_1:d mean_term_lag_1:d usage_rate_roll_mean_3:d mean_term_roll_mean_3:d", """
SELECT month, lag(usage_rate) OVER w AS usage_rate_lag_1, lag(mean_term) OVER w AS mean_term_lag_1, avg(usage_rate) OVER r AS usage_rate_roll_mean_3,
       avg(mean_term) OVER r AS mean_term_roll_mean_3 FROM x_term_months
WINDOW w AS (ORDER BY month), r AS (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def _(shop):
    return X.installment_features(X.installments_monthly(paid(shop)))


# --- delivery -------------------------------------------------------------------

view("x_delivery", """
WITH b AS (SELECT *, delivery_date - ship_date AS from_ship, delivery_date - order_date AS from_order, delivery_date - estimated_delivery_date AS delay
           FROM x_shipments JOIN x_orders USING (order_id))
SELECT *, CASE WHEN delay IS NOT NULL THEN delay > 0 ELSE from_ship > (SELECT quantile_cont(from_ship, 0.75) FROM b) END AS is_late FROM b
""")


def delivered(shop):
    return X.delivery_days(shop.shipments, shop.orders)


def placed(shop, df):
    return G.located(df, shop.customers, shop.geography)


view("x_place", "SELECT customer_id, region, city FROM x_customers JOIN x_geography USING (zip)")


@query("D111_delivery_by_region", "region:s shipments:i mean_days:d late_ratio:d invalid:i median_days:d p90_days:d", """
SELECT region, count(*) AS shipments, avg(from_ship) AS mean_days, 1.0 * count(*) FILTER (is_late) / count(*) AS late_ratio, count(*) FILTER (from_order < 0) AS invalid,
       quantile_cont(from_ship, 0.5) AS median_days, quantile_cont(from_ship, 0.9) AS p90_days FROM x_delivery JOIN x_place USING (customer_id) GROUP BY 1""")
def _(shop):
    return X.delivery_by(placed(shop, delivered(shop)), ["region"])


view("x_delivery_months", """
SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, count(*) AS shipments, avg(from_ship) AS mean_days, 1.0::DOUBLE * count(*) FILTER (is_late) / count(*) AS late_ratio,
       quantile_cont(from_ship, 0.5) AS median_days, quantile_cont(from_ship, 0.9) AS p90_days FROM x_delivery GROUP BY 1
""")


def delivery_months(shop):
    return X.delivery_by(delivered(shop).withColumn("month", S.month_start(F.col("order_date"))), ["month"])


@query("D111b_delivery_monthly", "month:t shipments:i mean_days:d late_ratio:d median_days:d p90_days:d", "SELECT * FROM x_delivery_months")
def _(shop):
    return delivery_months(shop)


@query("D111c_delivery_overall", "shipments:i mean_days:d late_ratio:d invalid:i median_days:d p90_days:d", """
SELECT count(*) AS shipments, avg(from_ship) AS mean_days, 1.0 * count(*) FILTER (is_late) / count(*) AS late_ratio, count(*) FILTER (from_order < 0) AS invalid,
       quantile_cont(from_ship, 0.5) AS median_days, quantile_cont(from_ship, 0.9) AS p90_days FROM x_delivery""")
def _(shop):
    return X.delivery_by(delivered(shop), [])


FEEDBACK = """
SELECT {label} AS grp, count(*) AS orders, avg(from_ship) AS mean_days, avg(rating) AS mean_rating,
       1.0 * count(*) FILTER (returns > 0) / count(*) AS return_rate, avg(refund) AS mean_refund FROM x_feedback GROUP BY 1"""
view("x_feedback", """
SELECT d.*, rating, coalesce(returns, 0) AS returns, coalesce(refund, 0) AS refund, q.* FROM x_delivery d
LEFT JOIN (SELECT order_id, avg(rating) AS rating FROM x_reviews GROUP BY 1) v ON v.order_id = d.order_id
LEFT JOIN (SELECT order_id, count(*) AS returns, sum(refund_amount) AS refund FROM x_returns GROUP BY 1) r ON r.order_id = d.order_id,
(SELECT quantile_cont(from_ship, 0.25) AS q25, quantile_cont(from_ship, 0.75) AS q75, quantile_cont(from_ship, 0.9) AS q90 FROM x_delivery) q
""")


@query("D112_delivery_feedback", "kind:s grp:s orders:i mean_days:d mean_rating:d return_rate:d mean_refund:d", f"""
SELECT 'late' AS kind, * FROM ({FEEDBACK.format(label="CAST(is_late AS VARCHAR)")})
UNION ALL SELECT 'duration', * FROM ({FEEDBACK.format(label="CASE WHEN from_ship <= 3 THEN 'fast' WHEN from_ship <= 4 THEN 'normal' WHEN from_ship <= 6 THEN 'slow' ELSE 'very_slow' END")})
UNION ALL SELECT 'speed', * FROM ({FEEDBACK.format(label="CASE WHEN from_ship <= q25 THEN 'fast' WHEN from_ship <= q75 THEN 'normal' WHEN from_ship <= q90 THEN 'slow' ELSE 'very_slow' END")})""")
def _(shop):
    base = X.with_feedback(X.speed_group(delivered(shop)), shop.reviews, shop.returns)
    labels = {
        "late": F.col("is_late").cast("string"),
        "duration": X.duration_bin(F.col("from_ship")),
        "speed": F.col("speed_group"),
    }
    return X.feedback_by(by_each(base, labels), ["dim", "grp"]).withColumnRenamed("dim", "kind")


view("x_shipping", f"""
WITH b AS (SELECT order_id, shipping_fee, order_value, order_date, customer_id, {STATUS} AS status FROM x_shipments JOIN x_orders USING (order_id)),
     q AS (SELECT quantile_cont(shipping_fee, 0.5) AS p50, quantile_cont(shipping_fee, 0.9) AS p90 FROM b WHERE shipping_fee > 0)
SELECT b.*, CASE WHEN shipping_fee = 0 THEN 'free_shipping' WHEN shipping_fee <= p50 THEN 'low_shipping_fee' WHEN shipping_fee <= p90 THEN 'medium_shipping_fee'
                 ELSE 'high_shipping_fee' END AS fee_group, shipping_fee / order_value AS fee_ratio FROM b, q
""")


def shipping(shop):
    orders = paid(shop).join(shop.orders.select("order_id", "customer_id", "order_value"), "order_id")
    return X.shipping_orders(shop.shipments, orders)


FEES = """
SELECT {key} AS grp, count(*) AS orders, sum(order_value) AS value, avg(order_value) AS aov, avg(shipping_fee) AS mean_fee,
       1.0 * count(*) FILTER (shipping_fee = 0) / count(*) AS free_ratio, 1.0 * count(*) FILTER (fee_group = 'high_shipping_fee') / count(*) AS high_ratio,
       avg(fee_ratio) AS mean_fee_ratio, 1.0 * count(*) FILTER (status = 'cancelled') / count(*) AS cancel_rate,
       quantile_cont(shipping_fee, 0.5) AS median_fee, quantile_cont(shipping_fee, 0.9) AS p90_fee FROM x_shipping JOIN x_place USING (customer_id) GROUP BY 1"""


@query("D113_shipping_fees", "grp:s orders:i value:d aov:d mean_fee:d free_ratio:d high_ratio:d mean_fee_ratio:d cancel_rate:d median_fee:d p90_fee:d",
       " UNION ALL ".join(FEES.format(key=k) for k in ("fee_group", "region", "CAST(CAST(date_trunc('month', order_date) AS DATE) AS VARCHAR)")))
def _(shop):
    base = placed(shop, shipping(shop)).withColumn("month", S.month_start(F.col("order_date")))
    return X.shipping_by(by_each(base, {k: F.col(k) for k in ("fee_group", "region", "month")}), ["dim", "grp"])


@query("D113b_shipping_correlation", "fee_value:d ratio_value:d", """
SELECT corr(shipping_fee, order_value) AS fee_value, corr(fee_ratio, order_value) AS ratio_value FROM x_shipping""")
def _(shop):
    return shipping(shop).agg(
        safe_corr(F.col("shipping_fee"), F.col("order_value")).alias("fee_value"),
        safe_corr(F.col("fee_ratio"), F.col("order_value")).alias("ratio_value"),
    )


@query("D114_delivery_features", "month:t mean_days_lag_1:d late_ratio_lag_1:d p90_days_lag_1:d mean_days_roll_mean_3:d", """
SELECT month, lag(mean_days) OVER w AS mean_days_lag_1, lag(late_ratio) OVER w AS late_ratio_lag_1, lag(p90_days) OVER w AS p90_days_lag_1,
       avg(mean_days) OVER (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean_days_roll_mean_3 FROM x_delivery_months WINDOW w AS (ORDER BY month)""")
def _(shop):
    return X.monthly_features(delivery_months(shop), ["mean_days", "late_ratio", "p90_days"])


# --- regions --------------------------------------------------------------------

view("x_placed", "SELECT r.*, region, city FROM x_order_rows r JOIN x_place USING (customer_id)")

PLACE = """
SELECT '{d}' AS dim, {d} AS grp, sum(revenue) AS revenue, count(*) AS orders, avg(revenue) AS aov, count(DISTINCT customer_id) AS customers,
       sum(revenue) / sum(sum(revenue)) OVER () AS revenue_share, count(*) / sum(count(*)) OVER () AS order_share,
       sum(revenue) / count(DISTINCT customer_id) AS revenue_per_customer FROM x_placed GROUP BY 2"""


def rows_placed(shop):
    return placed(shop, C.order_rows(shop))


@query("D115_revenue_by_place", "dim:s grp:s revenue:d orders:i aov:d customers:i revenue_share:d order_share:d revenue_per_customer:d",
       " UNION ALL ".join(PLACE.format(d=d) for d in ("region", "city")))
def _(shop):
    orders = rows_placed(shop)
    return Q.union_all(
        [
            G.revenue_by_place(orders, d).withColumnRenamed(d, "grp").withColumn("dim", F.lit(d))
            for d in ("region", "city")
        ]
    )


@query("D115b_city_concentration", "groups:i top_1_share:d top_3_share:d groups_for_50:i groups_for_80:i hhi:d", """
WITH g AS (SELECT city, round(sum(revenue), 4) AS r FROM x_placed GROUP BY 1),
     s AS (SELECT r / sum(r) OVER () AS share, row_number() OVER (ORDER BY r DESC, city) AS p,
                  sum(r) OVER (ORDER BY r DESC, city ROWS UNBOUNDED PRECEDING) / sum(r) OVER () AS c FROM g)
SELECT count(*) AS groups, sum(share) FILTER (p <= 1) AS top_1_share, sum(share) FILTER (p <= 3) AS top_3_share,
       min(p) FILTER (c >= 0.5 - 1e-12) AS groups_for_50, min(p) FILTER (c >= 0.8 - 1e-12) AS groups_for_80, sum(share * share) AS hhi FROM s""")
def _(shop):
    return K.concentration(G.revenue_by_place(rows_placed(shop), "city"), "city")


@query("D115c_region_growth", "region:s months:i growth_mean:d growth_std:d", """
WITH m AS (SELECT region, date_trunc('month', order_date) AS month, sum(revenue) AS r FROM x_placed GROUP BY 1, 2),
     g AS (SELECT region, r / lag(r) OVER (PARTITION BY region ORDER BY month) - 1 AS g FROM m)
SELECT region, count(*) AS months, avg(g) AS growth_mean, stddev_samp(g) AS growth_std FROM g GROUP BY 1""")
def _(shop):
    months = rows_placed(shop).groupBy("region", S.month_start(F.col("order_date")).alias("month")).agg(
        F.sum("revenue").alias("revenue")
    )
    return T.growth_volatility(months, "revenue", ["region"])


view("x_matrix", """
WITH a AS (SELECT city, sum(revenue) AS revenue, count(*) AS orders, avg(revenue) AS aov, 1.0::DOUBLE * count(*) FILTER (is_returned) / count(*) AS return_rate,
                  coalesce(sum(refund), 0) / sum(revenue) AS refund_ratio, quantile_cont(revenue, 0.5) AS median_order FROM x_placed GROUP BY 1),
     d AS (SELECT city, avg(from_ship) AS mean_days, 1.0::DOUBLE * count(*) FILTER (is_late) / count(*) AS late_ratio FROM x_delivery JOIN x_place USING (customer_id) GROUP BY 1),
     j AS (SELECT * FROM a LEFT JOIN d USING (city)),
     q AS (SELECT quantile_cont(orders, 0.75) AS qo, quantile_cont(revenue, 0.75) AS qr, quantile_cont(mean_days, 0.75) AS qd,
                  quantile_cont(late_ratio, 0.75) AS ql, quantile_cont(return_rate, 0.75) AS qt FROM j)
SELECT j.*, (orders >= qo AND (mean_days >= qd OR late_ratio >= ql OR return_rate >= qt)) OR (revenue >= qr AND mean_days >= qd) AS priority,
       (rank() OVER (ORDER BY orders) + (count(*) OVER (PARTITION BY orders) - 1) / 2.0 + rank() OVER (ORDER BY revenue) + rank() OVER (ORDER BY mean_days)
        + (count(*) OVER (PARTITION BY mean_days) - 1) / 2.0 + rank() OVER (ORDER BY late_ratio) + (count(*) OVER (PARTITION BY late_ratio) - 1) / 2.0
        + rank() OVER (ORDER BY return_rate) + (count(*) OVER (PARTITION BY return_rate) - 1) / 2.0) / count(*) OVER () AS priority_score
FROM j, q
""")


def matrix(shop):
    return G.regional_matrix(rows_placed(shop), placed(shop, delivered(shop)), "city")


@query("D116_regional_matrix", "city:s revenue:d orders:i aov:d median_order:d return_rate:d refund_ratio:d mean_days:d late_ratio:d priority:b priority_score:d", "SELECT * FROM x_matrix")
def _(shop):
    return matrix(shop)


@query("D116b_regional_correlations", "x:s y:s correlation:d", """
SELECT 'mean_days' AS x, 'return_rate' AS y, corr(mean_days, return_rate) AS correlation FROM x_matrix
UNION ALL SELECT 'aov', 'return_rate', corr(aov, return_rate) FROM x_matrix UNION ALL SELECT 'aov', 'mean_days', corr(aov, mean_days) FROM x_matrix
UNION ALL SELECT 'late_ratio', 'return_rate', corr(late_ratio, return_rate) FROM x_matrix""")
def _(shop):
    pairs = [("mean_days", "return_rate"), ("aov", "return_rate"), ("aov", "mean_days"), ("late_ratio", "return_rate")]
    return correlations(matrix(shop), pairs)


@query("D117_regional_monthly", "region:s month:t revenue:d orders:i return_rate:d mean_days:d mean_rating:d", """
WITH s AS (SELECT region, CAST(date_trunc('month', order_date) AS DATE) AS month, sum(revenue) AS revenue, count(*) AS orders,
                  1.0 * count(*) FILTER (is_returned) / count(*) AS return_rate FROM x_placed GROUP BY 1, 2),
     d AS (SELECT region, CAST(date_trunc('month', order_date) AS DATE) AS month, avg(from_ship) AS mean_days FROM x_delivery JOIN x_place USING (customer_id) GROUP BY 1, 2),
     v AS (SELECT region, CAST(date_trunc('month', order_date) AS DATE) AS month, avg(rating) AS mean_rating FROM x_reviews JOIN x_placed USING (order_id) GROUP BY 1, 2)
SELECT s.*, mean_days, mean_rating FROM s LEFT JOIN d USING (region, month) LEFT JOIN v USING (region, month)""")
def _(shop):
    return G.regional_monthly(rows_placed(shop), placed(shop, delivered(shop)), shop.reviews)


@query("D118_region_mix", "date:t top_region_share:d region_hhi:d top_region_orders:i top_city_share:d city_hhi:d high_aov_region_share:d high_risk_city_share:d top_region_share_lag_1:d city_hhi_lag_1:d", """
WITH r AS (SELECT order_date AS date, region, sum(revenue) AS r, count(*) AS n, avg(revenue) AS a FROM x_placed GROUP BY 1, 2),
     rs AS (SELECT *, r / nullif(sum(r) OVER (PARTITION BY date), 0) AS s, a >= quantile_cont(a, 0.75) OVER (PARTITION BY date) AS rich FROM r),
     ra AS (SELECT date, max(s) AS top_region_share, sum(s * s) AS region_hhi, max(n) AS top_region_orders, coalesce(sum(s) FILTER (rich), 0) AS high_aov_region_share FROM rs GROUP BY 1),
     c AS (SELECT order_date AS date, city, sum(revenue) AS r, count(*) AS n FROM x_placed GROUP BY 1, 2),
     cs AS (SELECT c.*, r / nullif(sum(r) OVER (PARTITION BY date), 0) AS s, priority FROM c JOIN (SELECT city, priority FROM x_matrix) m USING (city)),
     ca AS (SELECT date, max(s) AS top_city_share, sum(s * s) AS city_hhi, 1.0::DOUBLE * coalesce(sum(n) FILTER (priority), 0) / sum(n) AS high_risk_city_share FROM cs GROUP BY 1)
SELECT *, lag(top_region_share) OVER (ORDER BY date) AS top_region_share_lag_1, lag(city_hhi) OVER (ORDER BY date) AS city_hhi_lag_1 FROM ra JOIN ca USING (date)""")
def _(shop):
    risky = matrix(shop).where("priority").select("city")
    return G.region_mix(rows_placed(shop), ["region", "city"], risky)
