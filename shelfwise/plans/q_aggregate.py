"""Grouped statistics."""

from pyspark.sql import functions as F

from shelfwise.functions import scalars as S
from shelfwise.operators import aggregate as A
from shelfwise.plans import common as C
from shelfwise.plans.registry import query


@query("A01_group_stats", "category:s total:d mean:d std:d low:d high:d rows:i median:d", """
SELECT category, sum(revenue) AS total, avg(revenue) AS mean, stddev_samp(revenue) AS std, min(revenue) AS low,
       max(revenue) AS high, count(*) AS rows, quantile_cont(revenue, 0.5) AS median FROM x_lines GROUP BY 1""")
def _(shop):
    return A.group_stats(shop.lines, ["category"], "revenue")


@query("A02_distinct_counts", "segment:s orders:i customers:i products:i", """
SELECT segment, count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers,
       count(DISTINCT product_id) AS products FROM x_lines GROUP BY 1""")
def _(shop):
    return shop.lines.groupBy("segment").agg(
        F.count_distinct("order_id").alias("orders"),
        F.count_distinct("customer_id").alias("customers"),
        F.count_distinct("product_id").alias("products"),
    )


@query("A03_conditional_sums", "category:s lines:i promo_lines:i promo_quantity:d promo_revenue:d", """
SELECT category, count(*) AS lines, count(*) FILTER (promo_used) AS promo_lines,
       sum(quantity) FILTER (promo_used) AS promo_quantity, sum(revenue) FILTER (promo_used) AS promo_revenue
FROM x_lines GROUP BY 1""")
def _(shop):
    promo = F.col("promo_used")
    return shop.lines.groupBy("category").agg(
        F.count("*").alias("lines"),
        F.count_if(promo).alias("promo_lines"),
        F.sum(F.when(promo, F.col("quantity"))).alias("promo_quantity"),
        F.sum(F.when(promo, F.col("revenue"))).alias("promo_revenue"),
    )


@query("A04_ratio_of_aggregates", "channel:s promo_share:d orders_per_customer:d", """
SELECT channel, count(promo_id) * 1.0 / count(*) AS promo_share,
       count(DISTINCT order_id) * 1.0 / count(DISTINCT customer_id) AS orders_per_customer
FROM x_sold JOIN x_customers USING (customer_id) GROUP BY 1""")
def _(shop):
    return shop.sold.join(shop.customers, "customer_id").groupBy("channel").agg(
        S.ratio(F.count("promo_id"), F.count("*")).alias("promo_share"),
        S.ratio(F.count_distinct("order_id"), F.count_distinct("customer_id")).alias(
            "orders_per_customer"
        ),
    )


@query("A05_mean_margin_top", "segment:s margin:e", """
SELECT segment, avg(1 - cogs / price * (1 + product_id % 10 / 100.0::DOUBLE)) AS margin FROM x_products
WHERE price > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def _(shop):
    cost = F.col("cogs") / F.col("price") * (1 + F.col("product_id") % 10 / 100.0)
    margins = shop.products.where("price > 0").groupBy("segment").agg(F.avg(1 - cost).alias("margin"))
    return margins.orderBy(F.desc("margin"), "segment").limit(1)


@query("A06_filtered_counts", "return_reason:s returns:i", """
SELECT return_reason, count(*) AS returns FROM x_returns JOIN x_products USING (product_id)
WHERE category = 'ECONOMY' GROUP BY 1""")
def _(shop):
    economy = shop.products.where("category = 'ECONOMY'").select("product_id")
    return shop.returns.join(economy, "product_id").groupBy("return_reason").agg(
        F.count("*").alias("returns")
    )


@query("A07_group_means", "installments:i mean_value:d", """
SELECT installments, avg(payment_value) AS mean_value FROM x_payments GROUP BY 1""")
def _(shop):
    return shop.payments.groupBy("installments").agg(F.avg("payment_value").alias("mean_value"))


@query("A08_group_quantiles", "payment_method:s p25:d p50:d p75:d p95:d p99:d", """
SELECT payment_method, quantile_cont(payment_value, 0.25) AS p25, quantile_cont(payment_value, 0.5) AS p50,
       quantile_cont(payment_value, 0.75) AS p75, quantile_cont(payment_value, 0.95) AS p95,
       quantile_cont(payment_value, 0.99) AS p99 FROM x_payments GROUP BY 1""")
def _(shop):
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    return A.group_quantiles(shop.payments, ["payment_method"], "payment_value", probs)


@query("A09_weighted_means", "traffic_source:s bounce_rate:d avg_session_duration_sec:d", """
SELECT traffic_source, sum(bounce_rate * sessions) / sum(sessions) AS bounce_rate,
       sum(avg_session_duration_sec * sessions) / sum(sessions) AS avg_session_duration_sec
FROM x_traffic GROUP BY 1""")
def _(shop):
    return A.weighted_means(
        shop.traffic, ["traffic_source"], ["bounce_rate", "avg_session_duration_sec"], "sessions"
    )


@query("A10_share_within", "category:s return_reason:s total:d share:d", """
WITH s AS (SELECT category, return_reason, count(*) AS total FROM x_returns JOIN x_products USING (product_id) GROUP BY 1, 2)
SELECT *, total / sum(total) OVER (PARTITION BY category) AS share FROM s""")
def _(shop):
    joined = shop.returns.join(shop.products, "product_id")
    return A.share_by(joined, ["category", "return_reason"], F.count("*"), ["category"])


@query("A11_group_mode", "customer_id:i mode:s occurrences:i", """
WITH c AS (SELECT customer_id, payment_method, count(*) AS n FROM x_orders GROUP BY 1, 2),
     r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, payment_method) AS p FROM c)
SELECT customer_id, payment_method AS mode, n AS occurrences FROM r WHERE p = 1""")
def _(shop):
    return A.group_mode(shop.orders, ["customer_id"], "payment_method")


@query("A12_last_row", "product_id:i year:i month:t stock_on_hand:d", """
WITH r AS (SELECT product_id, year(month) AS year, month, stock_on_hand,
                  row_number() OVER (PARTITION BY product_id, year(month) ORDER BY month DESC) AS p FROM x_inventory)
SELECT * FROM r WHERE p = 1""")
def _(shop):
    stock = shop.inventory.withColumn("year", F.year("month"))
    return A.last_row(stock, ["product_id", "year"], ["month"], ["stock_on_hand"])


@query("A13_extreme_rows", "category:s min_price:d min_product_id:i max_price:d max_product_id:i", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY price, product_id) AS lo,
                  row_number() OVER (PARTITION BY category ORDER BY price DESC, product_id) AS hi FROM x_products)
SELECT category, max(price) FILTER (lo = 1) AS min_price, max(product_id) FILTER (lo = 1) AS min_product_id,
       max(price) FILTER (hi = 1) AS max_price, max(product_id) FILTER (hi = 1) AS max_product_id FROM r GROUP BY 1""")
def _(shop):
    return A.extreme_rows(shop.products, ["category"], "price", "product_id")


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("A14_pivot_fill", "size:i " + " ".join(f"n_{t}:i" for t in TYPES), f"""
SELECT size, {", ".join(f"count(*) FILTER (category = '{t}') AS n_{t}" for t in TYPES)} FROM x_products GROUP BY 1""")
def _(shop):
    return A.pivot_fill(shop.products, ["size"], "category", TYPES, F.count(F.lit(1)), "n_")


@query("A15_pivot_metrics", "category:s promo_revenue:d promo_quantity:d plain_revenue:d plain_quantity:d", """
SELECT category, sum(revenue) FILTER (promo_used) AS promo_revenue, sum(quantity) FILTER (promo_used) AS promo_quantity,
       sum(revenue) FILTER (NOT promo_used) AS plain_revenue, sum(quantity) FILTER (NOT promo_used) AS plain_quantity
FROM x_lines GROUP BY 1""")
def _(shop):
    return A.pivot_metrics(
        shop.lines,
        ["category"],
        "promo_used",
        {True: "promo", False: "plain"},
        {"revenue": F.sum("revenue"), "quantity": F.sum("quantity")},
    )


@query("A16_worst_group", "month:t worst_rate:d worst_group:s spread:d", """
WITH r AS (SELECT month, category, count(*) FILTER (stockout_flag) * 1.0::DOUBLE / count(*) AS rate FROM x_inventory GROUP BY 1, 2),
     p AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY rate DESC, category DESC) AS n,
                  max(rate) OVER (PARTITION BY month) - min(rate) OVER (PARTITION BY month) AS spread FROM r)
SELECT month, rate AS worst_rate, category AS worst_group, spread FROM p WHERE n = 1""")
def _(shop):
    rate = S.ratio(F.count_if("stockout_flag"), F.count("*"))
    return A.worst_group(shop.inventory, "month", "category", rate)


@query("A17_correlations", "x:s y:s correlation:d", """
SELECT 'revenue' AS x, 'orders' AS y, corr(revenue, orders) AS correlation FROM x_daily
UNION ALL SELECT 'revenue', 'quantity', corr(revenue, quantity) FROM x_daily""")
def _(shop):
    return A.correlations(C.daily(shop), [("revenue", "orders"), ("revenue", "quantity")])


@query("A18_correlations_per_group", "year:i x:s y:s correlation:d", """
SELECT year(date) AS year, 'revenue' AS x, 'orders' AS y, corr(revenue, orders) AS correlation FROM x_daily GROUP BY 1""")
def _(shop):
    df = C.daily(shop).withColumn("year", F.year("date"))
    return A.correlations(df, [("revenue", "orders")], ["year"])


PAIRS = [("revenue", "revenue"), ("revenue", "cogs"), ("revenue", "orders"),
         ("cogs", "cogs"), ("cogs", "orders"), ("orders", "orders")]


@query("A19_correlation_matrix", "x:s y:s correlation:d", " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS correlation FROM x_daily" for a, b in PAIRS))
def _(shop):
    return A.correlation_matrix(C.daily(shop), ["revenue", "cogs", "orders"])


@query("A20_spearman", "year:i spearman:d pairs:i", """
WITH r AS (SELECT year(date) AS year,
    rank() OVER (PARTITION BY year(date) ORDER BY revenue) + (count(*) OVER (PARTITION BY year(date), revenue) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY year(date) ORDER BY orders) + (count(*) OVER (PARTITION BY year(date), orders) - 1) / 2.0 AS b
  FROM x_daily)
SELECT year, corr(a, b) AS spearman, count(*) AS pairs FROM r GROUP BY 1""")
def _(shop):
    return A.spearman(C.daily(shop).withColumn("year", F.year("date")), "revenue", "orders", ["year"])


@query("A21_linear_fit", "category:s slope:d intercept:d pairs:i", """
SELECT category, regr_slope(revenue, quantity) AS slope, regr_intercept(revenue, quantity) AS intercept,
       count(*) AS pairs FROM x_lines GROUP BY 1""")
def _(shop):
    return A.linear_fit(shop.lines, "quantity", "revenue", ["category"])


@query("A22_fit_band", "step:i x:d fitted:d low_band:d high_band:d", """
WITH s AS (SELECT regr_slope(revenue, orders) AS m, regr_intercept(revenue, orders) AS b,
                  regr_sxx(revenue, orders) AS sxx, regr_syy(revenue, orders) AS syy, regr_sxy(revenue, orders) AS sxy,
                  avg(orders) AS c, count(*) AS n, min(orders) AS lo, max(orders) AS hi FROM x_daily),
     g AS (SELECT i AS step, lo + (hi - lo) * i / 99.0 AS x, s.* FROM s, range(100) t(i)),
     f AS (SELECT *, b + m * x AS fitted, sqrt((syy - sxy * sxy / sxx) / (n - 2)) * sqrt(1.0 / n + pow(x - c, 2) / sxx) AS w FROM g)
SELECT step, x, fitted, fitted - 1.98 * w AS low_band, fitted + 1.98 * w AS high_band FROM f""")
def _(shop):
    return A.fit_band(C.daily(shop), "orders", "revenue")


@query("A23_skewness", "year:i skew:d log_skew:d n:i", """
SELECT year(date) AS year, skewness(revenue) AS skew, skewness(ln(1 + revenue)) AS log_skew, count(*) AS n
FROM x_daily GROUP BY 1""")
def _(shop):
    return A.skew_raw_and_log(C.daily(shop).withColumn("year", F.year("date")), "revenue", ["year"])


@query("A24_variation", "segment:s cv:d spread:d", """
SELECT segment, stddev_samp(revenue) / avg(revenue) AS cv, max(revenue) - min(revenue) AS spread FROM x_lines GROUP BY 1""")
def _(shop):
    return A.variation(shop.lines, ["segment"], "revenue")


@query("A25_histogram", "bin:i left_edge:d right_edge:d rows:i", """
WITH e AS (SELECT min(order_value) AS lo, (max(order_value) - min(order_value)) / 40 AS w FROM x_orders)
SELECT bin, lo + bin * w AS left_edge, lo + (bin + 1) * w AS right_edge, count(*) AS rows
FROM (SELECT least(floor((order_value - lo) / w), 39) AS bin, lo, w FROM x_orders, e) GROUP BY 1, 2, 3""")
def _(shop):
    return A.histogram(shop.orders, "order_value")


@query("A26_side_by_side", "part:s value:s mean:d rows:i", """
SELECT 'overall' AS part, NULL AS value, avg(revenue) AS mean, count(*) AS rows FROM x_daily
UNION ALL SELECT 'month', CAST(month(date) AS VARCHAR), avg(revenue), count(*) FROM x_daily GROUP BY 2
UNION ALL SELECT 'weekday', CAST(isodow(date) - 1 AS VARCHAR), avg(revenue), count(*) FROM x_daily GROUP BY 2
UNION ALL SELECT 'quarter', CAST(quarter(date) AS VARCHAR), avg(revenue), count(*) FROM x_daily GROUP BY 2""")
def _(shop):
    parts = {"month": F.month("date"), "weekday": F.weekday("date"), "quarter": F.quarter("date")}
    return A.side_by_side(C.daily(shop), parts, "revenue")


@query("A27_distinct_list", "category:s values:s distinct_values:i", """
WITH d AS (SELECT DISTINCT category, promo_id FROM x_lines WHERE promo_id IS NOT NULL),
     r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY promo_id) AS p FROM d)
SELECT category, string_agg(promo_id, ', ' ORDER BY promo_id) FILTER (p <= 20) AS "values", count(*) AS distinct_values
FROM r GROUP BY 1""")
def _(shop):
    return A.distinct_list(shop.lines, ["category"], "promo_id")


@query("A28_value_counts", "rating:i total:d share:d", """
SELECT rating, count(*) AS total, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM x_reviews GROUP BY 1""")
def _(shop):
    return A.value_counts(shop.reviews, "rating")


@query("A29_mix_spread", "payment_method:s low:d high:d spread:d", """
WITH m AS (SELECT date_trunc('month', order_date) AS month, payment_method,
                  count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY date_trunc('month', order_date)) AS share
           FROM x_orders GROUP BY 1, 2)
SELECT payment_method, min(share) AS low, max(share) AS high, max(share) - min(share) AS spread FROM m GROUP BY 1""")
def _(shop):
    keyed = shop.orders.withColumn("month", S.month_start(F.col("order_date")))
    mix = A.share_by(keyed, ["month", "payment_method"], F.count("*"), ["month"])
    return mix.groupBy("payment_method").agg(
        F.min("share").alias("low"),
        F.max("share").alias("high"),
        (F.max("share") - F.min("share")).alias("spread"),
    )
