"""Projections, scalar functions and joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.functions import scalars as S
from shelfwise.functions.ordered import bounded_quantiles, quantiles
from shelfwise.operators import aggregate as A
from shelfwise.operators import derive as P
from shelfwise.operators import joins as J
from shelfwise.operators import timeseries as T
from shelfwise.plans import common as C
from shelfwise.plans.registry import query


@query("P01_line_financials", "has_promo:b lines:i revenue:d cost:d profit:d loss_lines:i", """
SELECT promo_id IS NOT NULL AS has_promo, count(*) AS lines, sum(quantity * unit_price) AS revenue,
       sum(quantity * cogs) AS cost, sum(quantity * unit_price - quantity * cogs) AS profit,
       sum(CASE WHEN unit_price < cogs THEN 1 ELSE 0 END) AS loss_lines
FROM x_items JOIN x_products USING (product_id) GROUP BY 1""")
def _(shop):
    return P.line_financials(shop.items, shop.products).groupBy("has_promo").agg(
        F.count("*").alias("lines"),
        F.sum("line_revenue").alias("revenue"),
        F.sum("line_cost").alias("cost"),
        F.sum("line_profit").alias("profit"),
        F.count_if("sold_at_loss").alias("loss_lines"),
    )


@query("P02_gross_margin", "date:t gross_margin:d", """
SELECT date, (revenue - cogs) / nullif(revenue, 0) AS gross_margin FROM x_daily""")
def _(shop):
    df = C.daily(shop).withColumn("profit", F.col("revenue") - F.col("cogs"))
    return P.gross_margin(df)


@query("P03_weighted_margin", "category:s promo_used:b margin:d", """
SELECT category, promo_used, sum(profit) / nullif(sum(revenue), 0) AS margin FROM x_lines GROUP BY 1, 2""")
def _(shop):
    return P.weighted_margin(shop.lines, ["category", "promo_used"])


@query("P04_promo_used", "promo_line:b primary_promo_id:s lines:i", """
SELECT coalesce(promo_id, promo_id_2) IS NOT NULL OR discount_amount > 0 AS promo_line,
       coalesce(promo_id, promo_id_2) AS primary_promo_id, count(*) AS lines FROM x_items GROUP BY 1, 2""")
def _(shop):
    return P.promo_used(shop.items).groupBy("promo_line", "primary_promo_id").agg(
        F.count("*").alias("lines")
    )


@query("P05_promo_id_long", "promo_source_column:s promo_id:s lines:i revenue:d", """
SELECT promo_source_column, promo_id, count(*) AS lines, sum(revenue) AS revenue FROM (
  SELECT 'promo_id' AS promo_source_column, promo_id, revenue FROM x_items WHERE promo_id IS NOT NULL
  UNION ALL SELECT 'promo_id_2', promo_id_2, revenue FROM x_items WHERE promo_id_2 IS NOT NULL) GROUP BY 1, 2""")
def _(shop):
    long = P.promo_id_long(shop.items.select("promo_id", "promo_id_2", "revenue"))
    return long.groupBy("promo_source_column", "promo_id").agg(
        F.count("*").alias("lines"), F.sum("revenue").alias("revenue")
    )


@query("P06_safe_divide", "order_id:i fee_share:d", """
SELECT order_id, CASE WHEN abs(r) > 1e-9 THEN f / r END AS fee_share
FROM (SELECT order_id, sum(revenue) AS r, sum(shipping_fee) AS f FROM x_items GROUP BY 1)""")
def _(shop):
    sums = shop.items.groupBy("order_id").agg(
        F.sum("revenue").alias("r"), F.sum("shipping_fee").alias("f")
    )
    return sums.select("order_id", S.safe_divide(F.col("f"), F.col("r")).alias("fee_share"))


@query("P07_aov_and_cost_ratio", "date:t aov:e cogs_ratio:e", """
WITH r AS (SELECT date, revenue / nullif(orders, 0) AS a, cogs / nullif(revenue, 0) AS c FROM x_daily)
SELECT date, coalesce(last_value(a IGNORE NULLS) OVER b, first_value(a IGNORE NULLS) OVER f) AS aov,
       coalesce(last_value(c IGNORE NULLS) OVER b, first_value(c IGNORE NULLS) OVER f) AS cogs_ratio FROM r
WINDOW b AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       f AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def _(shop):
    return P.aov_and_cost_ratio(C.daily(shop))


@query("P08_status_flags", "order_status:s is_completed:b is_cancelled:b is_returned:b orders:i", """
SELECT order_status, order_status IN ('delivered', 'shipped', 'paid') AS is_completed,
       order_status LIKE '%cancel%' AS is_cancelled, false AS is_returned, count(*) AS orders
FROM x_web_orders GROUP BY 1, 2, 3, 4""")
def _(shop):
    flags = ["order_status", "is_completed", "is_cancelled", "is_returned"]
    return P.status_flags(shop.web_orders).groupBy(*flags).agg(F.count("*").alias("orders"))


@query("P09_clip_p95", "category:s clipped_total:d", """
WITH p AS (SELECT quantile_cont(revenue, 0.95) AS cap FROM x_items)
SELECT category, sum(least(greatest(revenue, 1000), cap)) AS clipped_total FROM x_lines, p GROUP BY 1""")
def _(shop):
    cap = quantiles(shop.items, "revenue", {"cap": 0.95}).scalar()
    capped = shop.lines.withColumn("cap", cap)
    return capped.groupBy("category").agg(
        F.sum(S.clip(F.col("revenue"), 1000, F.col("cap"))).alias("clipped_total")
    )


@query("P10_log1p", "date:t log_profit:d back:d", """
SELECT date, CASE WHEN v > -1 THEN ln(1 + v) END AS log_profit,
       exp(CASE WHEN v > -1 THEN ln(1 + v) END) - 1 AS back
FROM (SELECT date, (revenue - cogs) / 1000 AS v FROM x_daily)""")
def _(shop):
    v = (F.col("revenue") - F.col("cogs")) / 1000
    return C.daily(shop).select("date", S.log1p_safe(v).alias("log_profit")).withColumn(
        "back", F.expm1("log_profit")
    )


@query("P11_melt", "month:t metric:s value:d", """
SELECT month, 'revenue' AS metric, revenue AS value FROM x_monthly
UNION ALL SELECT month, 'cogs', cogs FROM x_monthly""")
def _(shop):
    return P.melt(C.monthly(shop), ["month"], ["revenue", "cogs"])


@query("P12_without_excluded", "day:t orders:i value:d", """
SELECT order_date AS day, count(*) AS orders, sum(order_value) AS value
FROM x_web_orders WHERE order_status <> 'cancelled' GROUP BY 1""")
def _(shop):
    return P.without_excluded(shop.web_orders).groupBy(F.col("order_date").alias("day")).agg(
        F.count("*").alias("orders"), F.sum("order_value").alias("value")
    )


@query("P13_point_lookup", "order_id:i quantity:d revenue:d", """
SELECT order_id, quantity, revenue FROM x_sold WHERE product_id = 42 AND year(order_date) = 1997""")
def _(shop):
    return P.point_lookup(shop.sold.withColumn("year", F.year("order_date")), product_id=42, year=1997)


@query("P14_zscores", "date:t z:d z_pop:d", """
SELECT date, (revenue - avg(revenue) OVER ()) / nullif(stddev_samp(revenue) OVER (), 0) AS z,
       (revenue - avg(revenue) OVER ()) / nullif(stddev_pop(revenue) OVER (), 0) AS z_pop FROM x_daily""")
def _(shop):
    df = P.zscores(C.daily(shop), "revenue")
    return P.zscores(df, "revenue", population=True, name="z_pop")


# --- scalar functions -----------------------------------------------------------

PARTS = ("year quarter month week day_of_year day weekday month_index".split())


@query("S01_calendar_parts", "date:t " + " ".join(f"{p}:i" for p in PARTS) + " is_weekend:b is_month_start:b is_month_end:b", """
SELECT date, year(date) AS year, quarter(date) AS quarter, month(date) AS month, week(date) AS week,
       dayofyear(date) AS day_of_year, day(date) AS day, isodow(date) - 1 AS weekday,
       year(date) * 12 + month(date) AS month_index, isodow(date) >= 6 AS is_weekend,
       day(date) = 1 AS is_month_start, date = last_day(date) AS is_month_end FROM x_sales""")
def _(shop):
    return shop.sales.select("date", *[e.alias(n) for n, e in S.calendar_parts(F.col("date")).items()])


@query("S02_cyclic_parts", "date:t month_sin:d quarter_cos:d weekday_sin:d day_cos:d year_1_sin:d year_4_cos:d", """
SELECT date, sin(2 * pi() * month(date) / 12) AS month_sin, cos(2 * pi() * quarter(date) / 4) AS quarter_cos,
       sin(2 * pi() * (isodow(date) - 1) / 7) AS weekday_sin,
       cos(2 * pi() * (day(date) - 1) / day(last_day(date))) AS day_cos,
       sin(2 * pi() * dayofyear(date) / 365.25) AS year_1_sin,
       cos(2 * pi() * 4 * dayofyear(date) / 365.25) AS year_4_cos FROM x_sales""")
def _(shop):
    return shop.sales.select("date", *[e.alias(n) for n, e in S.cyclic_parts(F.col("date")).items()])


@query("S03_month_position", "month_position:s days:i revenue:d days_left:i", """
SELECT CASE WHEN day(date) <= 7 THEN 'month_start' WHEN last_day(date) - date <= 6 THEN 'month_end'
            ELSE 'month_middle' END AS month_position, count(*) AS days, sum(revenue) AS revenue,
       sum(last_day(date) - date) AS days_left FROM x_sales GROUP BY 1""")
def _(shop):
    day = F.col("date")
    return shop.sales.groupBy(S.month_position(day).alias("month_position")).agg(
        F.count("*").alias("days"),
        F.sum("revenue").alias("revenue"),
        F.sum(S.days_to_month_end(day)).alias("days_left"),
    )


@query("S04_payday_window", "payday:s days:i revenue:d", """
SELECT CASE WHEN day(date) >= 25 OR day(date) <= 5 THEN 'payday_proxy_window'
            ELSE 'non_payday_proxy_window' END AS payday, count(*) AS days, sum(revenue) AS revenue
FROM x_sales GROUP BY 1""")
def _(shop):
    return shop.sales.groupBy(S.payday_window(F.col("date")).alias("payday")).agg(
        F.count("*").alias("days"), F.sum("revenue").alias("revenue")
    )


@query("S05_season_flags", "is_peak_month:b is_low_month:b is_peak_quarter:b is_low_quarter:b days:i", """
SELECT month(date) IN (4, 5, 6) AS is_peak_month, month(date) IN (11, 12, 1) AS is_low_month,
       quarter(date) = 2 AS is_peak_quarter, quarter(date) = 4 AS is_low_quarter, count(*) AS days
FROM x_sales GROUP BY 1, 2, 3, 4""")
def _(shop):
    flags = S.season_flags(F.col("date"))
    return shop.sales.groupBy(*[e.alias(n) for n, e in flags.items()]).agg(F.count("*").alias("days"))


@query("S06_date_arithmetic", "quarter_start:t year:i mean_ship_gap:d", """
SELECT CAST(date_trunc('quarter', order_date) AS DATE) AS quarter_start, year(order_date) AS year,
       avg(ship_date - order_date) AS mean_ship_gap FROM x_sold GROUP BY 1, 2""")
def _(shop):
    return shop.sold.groupBy(
        F.date_trunc("quarter", "order_date").alias("quarter_start"),
        F.year("order_date").alias("year"),
    ).agg(F.avg(F.datediff("ship_date", "order_date")).alias("mean_ship_gap"))


@query("S07_delivery_durations", "order_id:i ship_to_delivery:i order_to_delivery:i delay:i", """
SELECT order_id, delivery_date - ship_date AS ship_to_delivery, delivery_date - order_date AS order_to_delivery,
       delivery_date - estimated_delivery_date AS delay FROM x_shipments JOIN x_orders USING (order_id)""")
def _(shop):
    return shop.shipments.join(shop.orders, "order_id").select(
        "order_id",
        F.datediff("delivery_date", "ship_date").alias("ship_to_delivery"),
        F.datediff("delivery_date", "order_date").alias("order_to_delivery"),
        F.datediff("delivery_date", "estimated_delivery_date").alias("delay"),
    )


@query("S08_age_band", "age_band:s customers:i mean_age:d", """
WITH a AS (SELECT customer_id % 130 AS age FROM x_customers)
SELECT CASE WHEN age > 110 THEN 'Unknown' WHEN age <= 17 THEN 'under_18' WHEN age <= 24 THEN '18_24'
            WHEN age <= 34 THEN '25_34' WHEN age <= 44 THEN '35_44' WHEN age <= 54 THEN '45_54'
            WHEN age <= 64 THEN '55_64' ELSE '65_plus' END AS age_band,
       count(*) AS customers, avg((DATE '2001-08-01' - CAST(DATE '2001-08-01' - CAST(age * 365 AS INTEGER) AS DATE)) / 365.25) AS mean_age
FROM a GROUP BY 1""")
def _(shop):
    end = F.lit("2001-08-01").cast("date")
    people = shop.customers.select((F.col("customer_id") % 130).cast("int").alias("age"))
    born = F.date_sub(end, F.col("age") * 365)
    return people.groupBy(S.age_band(F.col("age")).alias("age_band")).agg(
        F.count("*").alias("customers"), F.avg(S.age_on(born, end)).alias("mean_age")
    )


@query("S09_order_tier", "tier:s customers:i", """
SELECT CASE WHEN n <= 1 THEN 'one_time' WHEN n <= 3 THEN '2_3_orders' WHEN n <= 5 THEN '4_5_orders'
            ELSE '6_plus_orders' END AS tier, count(*) AS customers
FROM (SELECT count(*) AS n FROM x_orders GROUP BY customer_id) GROUP BY 1""")
def _(shop):
    counts = shop.orders.groupBy("customer_id").agg(F.count("*").alias("n"))
    return counts.groupBy(S.order_tier(F.col("n")).alias("tier")).agg(F.count("*").alias("customers"))


@query("S10_fixed_bins", "duration:s orders:i", """
SELECT CASE WHEN d <= 0 THEN 'same_day' WHEN d <= 30 THEN '1_30' WHEN d <= 365 THEN '31_365' ELSE 'over_365' END
       AS duration, count(*) AS orders
FROM (SELECT delivery_date - ship_date AS d FROM x_shipments) GROUP BY 1""")
def _(shop):
    days = F.datediff("delivery_date", "ship_date")
    label = S.bands(days, [(0, "same_day"), (30, "1_30"), (365, "31_365")], "over_365")
    return shop.shipments.groupBy(label.alias("duration")).agg(F.count("*").alias("orders"))


@query("S11_quantile_bins", "fee_group:s orders:i fees:d", """
WITH q AS (SELECT quantile_cont(shipping_fee, 0.5) AS p50, quantile_cont(shipping_fee, 0.9) AS p90 FROM x_shipments)
SELECT CASE WHEN shipping_fee <= p50 THEN 'low' WHEN shipping_fee <= p90 THEN 'medium' ELSE 'high' END AS fee_group,
       count(*) AS orders, sum(shipping_fee) AS fees FROM x_shipments, q GROUP BY 1""")
def _(shop):
    from shelfwise.operators.commerce import quantile_groups

    grouped = quantile_groups(shop.shipments, "shipping_fee", [(0.5, "low"), (0.9, "medium")], "high", "fee_group")
    return grouped.groupBy("fee_group").agg(
        F.count("*").alias("orders"), F.sum("shipping_fee").alias("fees")
    )


@query("S12_equal_count_bins", "bin:i days:i low:d high:d", """
WITH r AS (SELECT revenue, row_number() OVER (ORDER BY revenue, date) AS rn, count(*) OVER () AS n FROM x_sales)
SELECT greatest(1, ceil((rn - 1) * 5.0 / (n - 1))) AS bin, count(*) AS days, min(revenue) AS low,
       max(revenue) AS high FROM r GROUP BY 1""")
def _(shop):
    one = Window.orderBy("revenue", "date")  # a row per day: bounded by the calendar
    placed = shop.sales.withColumn("position", F.row_number().over(one))
    size = shop.sales.agg(F.count("*").alias("n")).scalar()
    binned = placed.withColumn("n", size).withColumn(
        "bin", S.equal_count_bin(F.col("position"), F.col("n"), 5)
    )
    return binned.groupBy("bin").agg(
        F.count("*").alias("days"), F.min("revenue").alias("low"), F.max("revenue").alias("high")
    )


@query("S13_standard_source", "raw:s source:s rows:i", """
SELECT raw, CASE raw WHEN 'Paid-View' THEN 'paid' WHEN ' Facebook ' THEN 'social' WHEN 'News letter' THEN 'news_letter'
                     ELSE 'direct' END AS source, count(*) AS rows
FROM (SELECT CASE event_type WHEN 'view' THEN 'Paid-View' WHEN 'click' THEN ' Facebook '
                             WHEN 'signup' THEN 'News letter' ELSE 'Direct' END AS raw FROM events)
GROUP BY 1, 2""")
def _(shop):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "view", "Paid-View")
        .when(kind == "click", " Facebook ")
        .when(kind == "signup", "News letter")
        .otherwise("Direct")
    )
    return shop.table("events").select(raw.alias("raw")).groupBy(
        "raw", S.standard_source(F.col("raw")).alias("source")
    ).agg(F.count("*").alias("rows"))


@query("S14_standard_payment", "method:s orders:i", """
SELECT CASE order_id % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'cod' WHEN 2 THEN 'apple_pay'
       ELSE lower(regexp_replace(payment_method, '[^A-Za-z0-9]+', '_', 'g')) END AS method, count(*) AS orders
FROM x_orders GROUP BY 1""")
def _(shop):
    kind = F.col("order_id") % 4
    raw = (
        F.when(kind == 0, "Credit Card")
        .when(kind == 1, "Cash on Delivery")
        .when(kind == 2, "ApplePay")
        .otherwise(F.col("payment_method"))
    )
    return shop.orders.groupBy(S.standard_payment(raw).alias("method")).agg(F.count("*").alias("orders"))


@query("S15_standard_reason", "reason:s wrong_size:b defective:b returns:i", """
SELECT CASE return_reason WHEN 'Too Small' THEN 'wrong_size' WHEN 'changed-mind' THEN 'changed_mind'
            WHEN 'Damaged' THEN 'defective' ELSE replace(return_reason, ' ', '_') END AS reason,
       return_reason = 'Too Small' AS wrong_size, return_reason = 'Damaged' AS defective, count(*) AS returns
FROM x_returns GROUP BY 1, 2, 3""")
def _(shop):
    cleaned = shop.returns.select(S.standard_reason(F.col("return_reason")).alias("reason"))
    return cleaned.groupBy(
        "reason",
        S.is_wrong_size(F.col("reason")).alias("wrong_size"),
        S.is_defective(F.col("reason")).alias("defective"),
    ).agg(F.count("*").alias("returns"))


@query("S16_promo_type", "kind:s promos:i", """
SELECT CASE WHEN CAST(substr(promo_id, 7) AS INTEGER) % 3 = 0 THEN promo_type
            WHEN discount_value > 100 THEN 'fixed_inferred' ELSE 'percentage_inferred' END AS kind, count(*) AS promos
FROM x_promotions GROUP BY 1""")
def _(shop):
    known = F.substring("promo_id", 7, 9).cast("int") % 3 == 0
    kind = F.when(known, F.col("promo_type"))
    label = S.promo_type(kind, F.col("promo_id"), F.col("discount_value"))
    return shop.promotions.groupBy(label.alias("kind")).agg(F.count("*").alias("promos"))


@query("S17_premium_label", "category:s premium:b products:i", """
SELECT category, category = 'PROMO' AS premium, count(*) AS products FROM x_products GROUP BY 1, 2""")
def _(shop):
    return shop.products.groupBy("category", S.is_premium(F.col("category")).alias("premium")).agg(
        F.count("*").alias("products")
    )


@query("S18_snake_case", "label:s products:i", """
SELECT trim(regexp_replace(lower(segment || ' ' || product_name), '[^a-z0-9]+', '_', 'g'), '_') AS label,
       count(*) AS products FROM x_products GROUP BY 1""")
def _(shop):
    label = S.snake_case(F.concat_ws(" ", "segment", "product_name"))
    return shop.products.groupBy(label.alias("label")).agg(F.count("*").alias("products"))


@query("S19_correlation_label", "payment_method:s label:s", """
WITH c AS (SELECT payment_method, corr(order_value, order_id % 1000 + order_value / 400) AS r FROM x_orders GROUP BY 1)
SELECT payment_method, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate'
       WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'very weak' END || CASE WHEN r > 0 THEN ' positive'
       WHEN r < 0 THEN ' negative' ELSE ' zero' END AS label FROM c""")
def _(shop):
    mixed = F.col("order_id") % 1000 + F.col("order_value") / 400
    r = shop.orders.groupBy("payment_method").agg(A.safe_corr(F.col("order_value"), mixed).alias("r"))
    return r.select("payment_method", S.correlation_label(F.col("r")).alias("label"))


@query("S20_horizon_band", "band:s days:i revenue:d", """
WITH h AS (SELECT revenue, date - DATE '2000-01-01' + 1 AS step FROM x_sales WHERE date >= DATE '2000-01-01')
SELECT CASE WHEN step <= 30 THEN 'days_1_30' WHEN step <= 90 THEN 'days_31_90' WHEN step <= 180 THEN 'days_91_180'
            WHEN step <= 365 THEN 'days_181_365' ELSE 'days_366_plus' END AS band, count(*) AS days,
       sum(revenue) AS revenue FROM h GROUP BY 1""")
def _(shop):
    start = F.lit("2000-01-01").cast("date")
    step = F.datediff("date", start) + 1
    later = shop.sales.where(F.col("date") >= start)
    return later.groupBy(S.horizon_band(step).alias("band")).agg(
        F.count("*").alias("days"), F.sum("revenue").alias("revenue")
    )


@query("S21_entropy_hhi", "month:t entropy:d hhi:d", """
WITH s AS (SELECT month, revenue / sum(revenue) OVER (PARTITION BY month) AS p FROM x_category_months)
SELECT month, -sum(p * ln(p)) AS entropy, sum(p * p) AS hhi FROM s GROUP BY 1""")
def _(shop):
    shares = A.share_by(C.category_months(shop), ["month", "category"], F.sum("revenue"), ["month"])
    return shares.groupBy("month").agg(
        S.entropy(F.col("share")).alias("entropy"), S.herfindahl(F.col("share")).alias("hhi")
    )


@query("S22_premium_price", "premium:b products:i", """
WITH q AS (SELECT quantile_cont(price, 0.8) AS p80 FROM x_products)
SELECT price >= p80 AS premium, count(*) AS products FROM x_products, q GROUP BY 1""")
def _(shop):
    cut = quantiles(shop.products, "price", {"p80": 0.8}).scalar()
    flagged = shop.products.withColumn("cut", cut).withColumn("premium", F.col("price") >= F.col("cut"))
    return flagged.groupBy("premium").agg(F.count("*").alias("products"))


@query("S23_stockout_rule", "is_stockout:b category:s rows:i", """
SELECT CASE WHEN product_id % 3 = 0 THEN stockout_flag WHEN product_id % 3 = 1 THEN stockout_days > 0
            ELSE stock_on_hand <= 0 END AS is_stockout,
       CASE WHEN product_id % 7 = 0 THEN 'Unknown' ELSE category END AS category, count(*) AS rows
FROM x_inventory GROUP BY 1, 2""")
def _(shop):
    turn = F.col("product_id") % 3
    flag = F.when(turn == 0, F.col("stockout_flag"))
    days = F.when(turn == 1, F.col("stockout_days"))
    known = F.when(F.col("product_id") % 7 != 0, F.col("category"))
    return shop.inventory.groupBy(
        S.stockout(flag, days, F.col("stock_on_hand")).alias("is_stockout"),
        F.coalesce(known, F.lit("Unknown")).alias("category"),
    ).agg(F.count("*").alias("rows"))


# --- joins ----------------------------------------------------------------------

@query("J01_inner_star", "region:s category:s revenue:d orders:i", """
SELECT region, category, sum(revenue) AS revenue, count(DISTINCT order_id) AS orders
FROM x_lines JOIN x_customers USING (customer_id) JOIN x_geography USING (zip) GROUP BY 1, 2""")
def _(shop):
    joined = shop.lines.join(shop.customers, "customer_id").join(shop.geography, "zip")
    return joined.groupBy("region", "category").agg(
        F.sum("revenue").alias("revenue"), F.count_distinct("order_id").alias("orders")
    )


@query("J02_lookup_join", "product_name:s lines:i segments:i", """
WITH d AS (SELECT product_name, arg_min(segment, product_id) AS segment FROM x_products GROUP BY 1)
SELECT l.product_name, count(*) AS lines, count(DISTINCT d.segment) AS segments
FROM (SELECT product_name FROM x_lines) l LEFT JOIN d ON d.product_name = l.product_name GROUP BY 1""")
def _(shop):
    names = shop.lines.select("product_name")
    dim = shop.products.select("product_name", "product_id", "segment")
    joined = J.lookup_join(names, dim, ["product_name"], ["product_id"])
    return joined.groupBy("product_name").agg(
        F.count("*").alias("lines"), F.count_distinct("segment").alias("segments")
    )


@query("J03_row_origin", "origin:s days:i", """
SELECT CASE WHEN a.d IS NOT NULL AND b.d IS NOT NULL THEN 'both' WHEN a.d IS NOT NULL THEN 'left_only'
            ELSE 'right_only' END AS origin, count(*) AS days
FROM (SELECT DISTINCT order_date AS d FROM x_orders) a
FULL JOIN (SELECT DISTINCT return_date AS d FROM x_returns) b ON a.d = b.d GROUP BY 1""")
def _(shop):
    left = shop.orders.select(F.col("order_date").alias("date")).distinct()
    right = shop.returns.select(F.col("return_date").alias("date")).distinct()
    return J.with_origin(left, right, ["date"]).groupBy("origin").agg(F.count("*").alias("days"))


@query("J04_align_series", "date:t sales_revenue:d refunds_refund:d", """
SELECT coalesce(s.date, r.date) AS date, revenue AS sales_revenue, refund AS refunds_refund
FROM x_sales s FULL JOIN (SELECT return_date AS date, sum(refund_amount) AS refund FROM x_returns GROUP BY 1) r
  ON s.date = r.date""")
def _(shop):
    refunds = shop.returns.groupBy(F.col("return_date").alias("date")).agg(
        F.sum("refund_amount").alias("refund")
    )
    return J.align_series({"sales": shop.sales, "refunds": refunds})


@query("J05_star_flatten", "channel:s category:s lines:i revenue:d", """
SELECT channel, category, count(*) AS lines, sum(revenue) AS revenue
FROM x_items LEFT JOIN x_orders USING (order_id) LEFT JOIN x_products USING (product_id)
     LEFT JOIN x_customers USING (customer_id) GROUP BY 1, 2""")
def _(shop):
    flat = J.star_flatten(shop.items, shop.orders, shop.products, shop.customers)
    return flat.groupBy("channel", "category").agg(
        F.count("*").alias("lines"), F.sum("revenue").alias("revenue")
    )


@query("J06_aggregate_then_join", "order_id:i order_value:d item_revenue:d lines:i", """
SELECT o.order_id, order_value, item_revenue, lines FROM x_orders o
LEFT JOIN (SELECT order_id, sum(revenue) AS item_revenue, count(*) AS lines FROM x_items GROUP BY 1) i
  ON i.order_id = o.order_id""")
def _(shop):
    return J.aggregate_then_join(
        shop.orders,
        shop.items,
        ["order_id"],
        {"item_revenue": F.sum("revenue"), "lines": F.count("*")},
    )


@query("J07_match_returns", "match:s is_returned:b groups:i quantity:d returned_quantity:d", """
SELECT 'line' AS match, rq IS NOT NULL AS is_returned, count(*) AS groups, sum(quantity) AS quantity, sum(rq) AS returned_quantity
FROM (SELECT order_id, product_id, sum(quantity) AS quantity FROM x_items GROUP BY 1, 2)
LEFT JOIN (SELECT order_id, product_id, sum(return_quantity) AS rq FROM x_returns GROUP BY 1, 2) USING (order_id, product_id) GROUP BY 1, 2
UNION ALL
SELECT 'order', rq IS NOT NULL, count(*), sum(quantity), sum(rq)
FROM (SELECT order_id, sum(quantity) AS quantity FROM x_items GROUP BY 1)
LEFT JOIN (SELECT order_id, sum(return_quantity) AS rq FROM x_returns GROUP BY 1) USING (order_id) GROUP BY 1, 2""")
def _(shop):
    def summary(match):
        return J.match_returns(shop.items, shop.returns, match).groupBy("is_returned").agg(
            F.count("*").alias("groups"),
            F.sum("quantity").alias("quantity"),
            F.sum("returned_quantity").alias("returned_quantity"),
        ).withColumn("match", F.lit(match))

    return summary("line").unionByName(summary("order"))


@query("J08_ranked_self_join", "year:i best_month:i worst_month:i best_to_worst:d", """
WITH m AS (SELECT year(month) AS year, month(month) AS m, revenue,
                  rank() OVER (PARTITION BY year(month) ORDER BY revenue DESC) AS hi,
                  rank() OVER (PARTITION BY year(month) ORDER BY revenue) AS lo FROM x_monthly)
SELECT a.year, a.m AS best_month, b.m AS worst_month, a.revenue / b.revenue AS best_to_worst
FROM m a JOIN m b ON a.year = b.year WHERE a.hi = 1 AND b.lo = 1""")
def _(shop):
    months = C.monthly(shop).select(F.year("month").alias("year"), F.month("month").alias("m"), "revenue")
    ranked = T.rank_in_period(months, "revenue", ["year"])
    best = ranked.where("rank_high = 1").select("year", F.col("m").alias("best_month"), F.col("revenue").alias("a"))
    worst = ranked.where("rank_low = 1").select("year", F.col("m").alias("worst_month"), F.col("revenue").alias("b"))
    return best.join(worst, "year").withColumn("best_to_worst", F.col("a") / F.col("b"))


@query("J09_two_aggregates", "size:i sold_lines:i returned_lines:i return_rate:d", """
SELECT s.size, sold_lines, coalesce(returned_lines, 0) AS returned_lines, 1.0 * coalesce(returned_lines, 0) / sold_lines AS return_rate
FROM (SELECT size, count(*) AS sold_lines FROM x_items JOIN x_products USING (product_id) GROUP BY 1) s
LEFT JOIN (SELECT size, count(*) AS returned_lines FROM x_returns JOIN x_products USING (product_id) GROUP BY 1) r ON r.size = s.size""")
def _(shop):
    def by_size(df, name):
        counts = df.groupBy("product_id").agg(F.count("*").alias(name))
        sized = counts.join(shop.products.select("product_id", "size"), "product_id")
        return sized.groupBy("size").agg(F.sum(name).alias(name))

    joined = by_size(shop.items, "sold_lines").join(by_size(shop.returns, "returned_lines"), "size", "left")
    return joined.fillna(0, ["returned_lines"]).withColumn(
        "return_rate", S.ratio(F.col("returned_lines"), F.col("sold_lines"))
    )


@query("J10_interval_join", "date:t active_promos:i revenue:d", """
SELECT s.date, count(p.promo_id) AS active_promos, any_value(s.revenue) AS revenue
FROM x_sales s LEFT JOIN x_promotions p ON s.date BETWEEN p.start_date AND p.end_date GROUP BY 1""")
def _(shop):
    active = J.expand_intervals(shop.promotions, "start_date", "end_date").groupBy("date").agg(
        F.count("*").alias("active_promos")
    )
    return shop.sales.select("date", "revenue").join(active, "date", "left").fillna(0, ["active_promos"])


@query("J11_month_to_day", "date:t revenue:d mean_stock:d", """
SELECT s.date, revenue, mean_stock FROM x_sales s
LEFT JOIN (SELECT month, avg(stock_on_hand) AS mean_stock FROM x_inventory GROUP BY 1) m ON m.month = date_trunc('month', s.date)""")
def _(shop):
    months = shop.inventory.groupBy("month").agg(F.avg("stock_on_hand").alias("mean_stock"))
    return J.month_to_day(shop.sales, months)


@query("J12_lagged_month", "date:t revenue:d mean_stock:d", """
SELECT s.date, revenue, mean_stock FROM x_sales s
LEFT JOIN (SELECT month + INTERVAL 1 MONTH AS month, avg(stock_on_hand) AS mean_stock FROM x_inventory GROUP BY 1) m
  ON m.month = date_trunc('month', s.date)""")
def _(shop):
    months = shop.inventory.groupBy("month").agg(F.avg("stock_on_hand").alias("mean_stock"))
    return J.month_to_day(shop.sales, months, lag_months=1)


@query("J13_near_days", "date:t revenue:d", """
WITH h AS (SELECT date, revenue FROM x_sales WHERE revenue >= (SELECT quantile_cont(revenue, 0.97) FROM x_sales)),
     r AS (SELECT return_date AS date FROM x_returns GROUP BY 1)
SELECT date, revenue FROM h WHERE EXISTS (SELECT 1 FROM r WHERE abs(r.date - h.date) <= 7)""")
def _(shop):
    cut = bounded_quantiles(shop.sales, "revenue", {"p": 0.97}).scalar()
    high = shop.sales.withColumn("cut", cut).where(S.at_least(F.col("revenue"), F.col("cut")))
    busy = shop.returns.select(F.col("return_date").alias("date")).distinct()
    return J.near_days(high, busy, 7)


@query("J14_offset_lookup", "date:t revenue:d t1:d t3:d t7:d", """
SELECT a.date, a.revenue, b.revenue AS t1, c.revenue AS t3, d.revenue AS t7 FROM x_sales a
LEFT JOIN x_sales b ON b.date = a.date + 1 LEFT JOIN x_sales c ON c.date = a.date + 3
LEFT JOIN x_sales d ON d.date = a.date + 7""")
def _(shop):
    found = J.at_offsets(shop.sales.select("date", "revenue"), "revenue", [1, 3, 7])
    return found.withColumnsRenamed({f"revenue_t+{k}": f"t{k}" for k in (1, 3, 7)})


@query("J15_semi_anti", "kind:s orders:i", """
SELECT 'with_items' AS kind, count(*) AS orders FROM x_orders WHERE order_id IN (SELECT order_id FROM x_items)
UNION ALL SELECT 'without_items', count(*) FROM x_orders WHERE order_id NOT IN (SELECT order_id FROM x_items)""")
def _(shop):
    keys = shop.items.select("order_id")
    have = shop.orders.join(keys, "order_id", "left_semi").agg(F.count("*").alias("orders"))
    lack = shop.orders.join(keys, "order_id", "left_anti").agg(F.count("*").alias("orders"))
    return have.withColumn("kind", F.lit("with_items")).unionByName(
        lack.withColumn("kind", F.lit("without_items"))
    )


@query("J16_attribute_map", "order_id:i last_category:s", """
WITH r AS (SELECT order_id, category, row_number() OVER (PARTITION BY order_id ORDER BY ship_date DESC, product_id DESC) AS p FROM x_lines)
SELECT order_id, category AS last_category FROM r WHERE p = 1""")
def _(shop):
    latest = A.last_row(shop.items, ["order_id"], ["ship_date", "product_id"], [])
    return latest.join(shop.products.select("product_id", "category"), "product_id").select(
        "order_id", F.col("category").alias("last_category")
    )


@query("J17_fill_geography", "region:s orders:i", """
SELECT coalesce(region, 'Unknown') AS region, count(*) AS orders
FROM (SELECT CASE WHEN order_id % 3 = 0 THEN NULL WHEN order_id % 3 = 1 THEN 999 ELSE order_id % 25 END AS oz, zip AS cz
      FROM x_orders JOIN x_customers USING (customer_id)) o
LEFT JOIN x_geography g ON g.zip = coalesce(oz, cz) GROUP BY 1""")
def _(shop):
    turn = F.col("order_id") % 3
    homes = shop.customers.select("customer_id", F.col("zip").alias("customer_zip"))
    order_zip = F.when(turn == 1, F.lit(999)).when(turn == 2, (F.col("order_id") % 25).cast("int"))
    zips = shop.orders.join(homes, "customer_id").withColumn("order_zip", order_zip)
    filled = J.fill_from(zips, shop.geography, ["order_zip", "customer_zip"], ["region", "city"], "zip")
    return filled.groupBy("region").agg(F.count("*").alias("orders"))


@query("J18_daily_fan_in", "date:t sales_revenue:d returns_n:i reviews_n:i ships_n:i", """
SELECT s.date, s.revenue AS sales_revenue, r.n AS returns_n, v.n AS reviews_n, p.n AS ships_n FROM x_sales s
LEFT JOIN (SELECT return_date AS date, count(*) AS n FROM x_returns GROUP BY 1) r ON r.date = s.date
LEFT JOIN (SELECT review_date AS date, count(*) AS n FROM x_reviews GROUP BY 1) v ON v.date = s.date
LEFT JOIN (SELECT ship_date AS date, count(*) AS n FROM x_shipments GROUP BY 1) p ON p.date = s.date""")
def _(shop):
    count = lambda df, d: df.groupBy(F.col(d).alias("date")).agg(F.count("*").alias("n"))
    wide = J.align_series(
        {
            "sales": shop.sales.select("date", "revenue"),
            "returns": count(shop.returns, "return_date"),
            "reviews": count(shop.reviews, "review_date"),
            "ships": count(shop.shipments, "ship_date"),
        }
    )
    return wide.where("sales_revenue IS NOT NULL")


@query("J19_parameter_grid", "scale:d days:i total:d", """
SELECT scale, count(*) AS days, sum(revenue * scale) AS total
FROM x_sales, (VALUES (0.9::DOUBLE), (1.0::DOUBLE), (1.1::DOUBLE)) g(scale) GROUP BY 1""")
def _(shop):
    grid = J.with_grid(shop.sales, [{"scale": s} for s in (0.9, 1.0, 1.1)])
    return grid.groupBy("scale").agg(
        F.count("*").alias("days"), F.sum(F.col("revenue") * F.col("scale")).alias("total")
    )
