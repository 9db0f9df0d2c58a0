"""Time-series primitives, ordering and sets."""

from pyspark.sql import functions as F

from shelfwise.functions.ordered import percent_ranks, positions, running
from shelfwise.functions.scalars import month_start, ratio
from shelfwise.operators import quality as Q
from shelfwise.operators import timeseries as T
from shelfwise.plans import common as C
from shelfwise.plans.registry import query, view

STEPS = [1, 3, 7, 14, 30, 60, 90, 364, 365, 366, 730]
LEAST = {7: 3, 30: 15, 90: 45}  # values a trailing mean needs


@query("T01_daily_series", "date:t lines:i orders:i revenue:d", """
SELECT ship_date AS date, count(*) AS lines, count(DISTINCT order_id) AS orders, sum(revenue) AS revenue
FROM x_items GROUP BY 1""")
def _(shop):
    return T.daily_series(
        shop.items,
        "ship_date",
        {"lines": F.count("*"), "orders": F.count_distinct("order_id"), "revenue": F.sum("revenue")},
    )


@query("T02_densify", "date:t revenue:d orders:i was_observed:b", "SELECT * FROM x_daily")
def _(shop):
    return C.daily(shop)


@query("T02b_densify_series", "category:s month:t revenue:d was_observed:b", """
WITH e AS (SELECT category, min(month) AS a, max(month) AS b FROM x_category_months GROUP BY 1),
     d AS (SELECT category, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month FROM e)
SELECT d.category, d.month, coalesce(revenue, 0) AS revenue, c.month IS NOT NULL AS was_observed
FROM d LEFT JOIN x_category_months c ON c.category = d.category AND c.month = d.month""")
def _(shop):
    return T.densify(C.category_months(shop), {"revenue": 0.0}, ["category"], "month", "month")


@query("T03_resample", "grain:s period:t revenue:d", """
SELECT 'month' AS grain, CAST(date_trunc('month', date) AS DATE) AS period, sum(revenue) AS revenue FROM x_sales GROUP BY 2
UNION ALL SELECT 'quarter', CAST(date_trunc('quarter', date) AS DATE), sum(revenue) FROM x_sales GROUP BY 2
UNION ALL SELECT 'year', CAST(date_trunc('year', date) AS DATE), sum(revenue) FROM x_sales GROUP BY 2""")
def _(shop):
    return Q.union_all(
        [
            T.resample(shop.sales, g, {"revenue": F.sum("revenue")}).withColumn("grain", F.lit(g))
            for g in ("month", "quarter", "year")
        ]
    )


@query("T04_lags", "date:t " + " ".join(f"revenue_lag_{k}:d" for k in STEPS), f"""
SELECT date, {", ".join(f"lag(revenue, {k}) OVER (ORDER BY date) AS revenue_lag_{k}" for k in STEPS)} FROM x_daily""")
def _(shop):
    return T.lags(C.daily(shop), ["revenue"], STEPS)


@query("T05_yoy_lag_mean", "date:t revenue_yoy_lag_mean:d", """
WITH l AS (SELECT date, lag(revenue, 364) OVER w AS a, lag(revenue, 365) OVER w AS b, lag(revenue, 366) OVER w AS c
           FROM x_daily WINDOW w AS (ORDER BY date))
SELECT date, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) /
       nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0) AS revenue_yoy_lag_mean FROM l""")
def _(shop):
    return T.yoy_lag_mean(C.daily(shop), "revenue")


def roll_sql(column: str, agg: str, size: int, least: int, shift: int, by: str = "") -> str:
    frame = f"({by} ORDER BY date ROWS BETWEEN {size + shift - 1} PRECEDING AND " + (
        f"{shift} PRECEDING)" if shift else "CURRENT ROW)"
    )
    name = {"mean": "avg", "std": "stddev_samp"}.get(agg, agg)
    return f"CASE WHEN count({column}) OVER {frame} >= {least} THEN {name}({column}) OVER {frame} END"


@query("T06_rolling", "date:t mean_30:d std_90:d sum_7:d min_30:d max_30:d prior_mean_7:d prior_std_365:d", f"""
SELECT date, {roll_sql("revenue", "mean", 30, 7, 0)} AS mean_30, {roll_sql("revenue", "std", 90, 30, 0)} AS std_90,
       {roll_sql("revenue", "sum", 7, 1, 0)} AS sum_7, {roll_sql("revenue", "min", 30, 15, 1)} AS min_30,
       {roll_sql("revenue", "max", 30, 15, 1)} AS max_30, {roll_sql("revenue", "mean", 7, 2, 1)} AS prior_mean_7,
       {roll_sql("revenue", "std", 365, 30, 1)} AS prior_std_365 FROM x_daily""")
def _(shop):
    specs = [
        ("mean_30", 30, "mean", 7, 0),
        ("std_90", 90, "std", 30, 0),
        ("sum_7", 7, "sum", 1, 0),
        ("min_30", 30, "min", 15, 1),
        ("max_30", 30, "max", 15, 1),
        ("prior_mean_7", 7, "mean", 2, 1),
        ("prior_std_365", 365, "std", 30, 1),
    ]
    return C.daily(shop).withColumns(
        {n: T.rolled("revenue", w, agg, least, shift) for n, w, agg, least, shift in specs}
    )


@query("T07_centered_mean", "month:t revenue_centered:d revenue_deviation:d", """
WITH c AS (SELECT month, revenue, CASE WHEN count(*) OVER w = 3 THEN avg(revenue) OVER w END AS m
           FROM x_monthly WINDOW w AS (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT month, m AS revenue_centered, revenue - m AS revenue_deviation FROM c""")
def _(shop):
    return T.centered_mean(C.monthly(shop), "revenue", date="month")


@query("T08_top_deviations", "date:t rolling_mean:d deviation:d", f"""
WITH m AS (SELECT date, revenue, {roll_sql("revenue", "mean", 90, 30, 0)} AS rolling_mean FROM x_daily)
SELECT date, rolling_mean, revenue - rolling_mean AS deviation FROM m WHERE rolling_mean IS NOT NULL
ORDER BY abs(revenue - rolling_mean) DESC, date LIMIT 15""")
def _(shop):
    return T.top_deviations(C.daily(shop), "revenue", 90, 30)


@query("T09_rolling_correlation", "date:t rolling_corr:d", """
WITH l AS (SELECT date, revenue, lag(orders, 1) OVER (ORDER BY date) AS y FROM x_daily),
     p AS (SELECT date, CASE WHEN y IS NOT NULL THEN revenue END AS x, y FROM l)
SELECT date, CASE WHEN count(x) OVER w >= 30 THEN corr(x, y) OVER w END AS rolling_corr FROM p
WINDOW w AS (ORDER BY date ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)""")
def _(shop):
    return T.rolling_correlation(C.daily(shop), "revenue", "orders", 90, 30, lag=1)


view("x_regimes", f"""
WITH r AS (SELECT date, revenue, {roll_sql("revenue", "std", 30, 15, 1)} AS roll_std,
                  {roll_sql("revenue", "mean", 30, 15, 1)} AS roll_mean FROM x_daily),
     v AS (SELECT *, roll_std / nullif(abs(roll_mean), 0) AS roll_cv FROM r),
     q AS (SELECT quantile_cont(roll_std, 0.9) AS sh, quantile_cont(roll_std, 0.1) AS sl,
                  quantile_cont(roll_cv, 0.9) AS ch, quantile_cont(roll_cv, 0.1) AS cl FROM v)
SELECT date, revenue, roll_std, roll_cv, coalesce(roll_std >= sh, false) AS high_volatility,
       coalesce(roll_std <= sl, false) AS low_volatility, coalesce(roll_cv >= ch, false) AS high_cv,
       coalesce(roll_cv <= cl, false) AS low_cv FROM v, q
""")


@query("T10_volatility_regimes", "date:t roll_std:d roll_cv:d high_volatility:b low_volatility:b high_cv:b low_cv:b",
       "SELECT * FROM x_regimes")
def _(shop):
    return T.volatility_regimes(C.daily(shop), "revenue")


@query("T11_trend_signals", "date:t short_vs_medium:d medium_vs_long:d short_term_direction:s medium_term_direction:s pct_vs_medium:d strong_up:b strong_down:b", f"""
WITH m AS (SELECT date, revenue, {roll_sql("revenue", "mean", 7, 3, 1)} AS a, {roll_sql("revenue", "mean", 30, 15, 1)} AS b,
                  {roll_sql("revenue", "mean", 90, 45, 1)} AS c FROM x_daily),
     d AS (SELECT *, a - b AS s, b - c AS l FROM m WHERE a - b IS NOT NULL AND b - c IS NOT NULL),
     q AS (SELECT quantile_cont(s, 0.75) AS up, quantile_cont(s, 0.25) AS down FROM d)
SELECT date, s AS short_vs_medium, l AS medium_vs_long,
       CASE WHEN s > 0 THEN 'short_term_above_medium_term' WHEN s < 0 THEN 'short_term_below_medium_term' ELSE 'flat' END AS short_term_direction,
       CASE WHEN l > 0 THEN 'medium_term_above_long_term' WHEN l < 0 THEN 'medium_term_below_long_term' ELSE 'flat' END AS medium_term_direction,
       (revenue - b) / abs(b) * 100 AS pct_vs_medium, s >= up AS strong_up, s <= down AS strong_down FROM d, q""")
def _(shop):
    return T.trend_signals(C.daily(shop), "revenue", LEAST)


WINDOWS = {7: 3, 14: 7, 30: 15, 90: 45}


@query("T12_compare_windows", "window_days:i valid_days:i mae:d rmse:d correlation:d mean_step:d smoothness:d combined_rank:d", f"""
WITH m AS ({" UNION ALL ".join(f'''SELECT {w} AS w, date, revenue,
  {roll_sql("revenue", "mean", w, n, 1)} AS m FROM x_daily''' for w, n in WINDOWS.items())}),
     s AS (SELECT *, abs(m - lag(m) OVER (PARTITION BY w ORDER BY date)) AS st,
                  abs(revenue - lag(revenue) OVER (PARTITION BY w ORDER BY date)) AS rt FROM m),
     g AS (SELECT w AS window_days, count(m) AS valid_days, avg(abs(revenue - m)) AS mae,
                  sqrt(avg((revenue - m) * (revenue - m))) AS rmse, corr(revenue, m) AS correlation,
                  avg(st) AS mean_step, avg(st) / avg(rt) AS smoothness FROM s GROUP BY 1)
SELECT *, rank() OVER (ORDER BY mae) + rank() OVER (ORDER BY correlation DESC) + 0.5 * rank() OVER (ORDER BY smoothness)
       AS combined_rank FROM g""")
def _(shop):
    return T.compare_windows(C.daily(shop), "revenue", WINDOWS)


@query("T13_flag_periods", "start_date:t end_date:t days:i max_value:d min_value:d mean_value:d", """
WITH f AS (SELECT date, roll_std, date - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS island
           FROM x_regimes WHERE high_volatility)
SELECT min(date) AS start_date, max(date) AS end_date, count(*) AS days, max(roll_std) AS max_value,
       min(roll_std) AS min_value, avg(roll_std) AS mean_value FROM f GROUP BY island""")
def _(shop):
    return T.flag_periods(T.volatility_regimes(C.daily(shop), "revenue"), "high_volatility", "roll_std")


@query("T14_period_change", "month:t abs_change:d pct_change:d guarded:d", """
WITH l AS (SELECT month, revenue, lag(revenue) OVER (ORDER BY month) AS p FROM x_monthly),
     f AS (SELECT greatest(1.0, quantile_cont(revenue, 0.05) * 0.1) AS floor FROM x_monthly)
SELECT month, revenue - p AS abs_change, (revenue / nullif(p, 0) - 1) * 100 AS pct_change,
       CASE WHEN abs(p) > floor THEN (revenue - p) / p * 100 END AS guarded FROM l, f""")
def _(shop):
    plain = T.period_change(C.monthly(shop), "revenue", "month")
    guarded = T.period_change(C.monthly(shop), "revenue", "month", guard=True)
    return plain.join(guarded.select("month", F.col("pct_change").alias("guarded")), "month")


@query("T15_top_changes", "side:s date:t abs_change:d", """
WITH c AS (SELECT date, revenue - lag(revenue) OVER (ORDER BY date) AS abs_change FROM x_daily)
(SELECT 'increase' AS side, * FROM c WHERE abs_change IS NOT NULL ORDER BY abs_change DESC, date LIMIT 20)
UNION ALL
(SELECT 'decrease', * FROM c WHERE abs_change IS NOT NULL ORDER BY abs_change, date LIMIT 20)""")
def _(shop):
    return T.top_changes(T.period_change(C.daily(shop), "revenue", "date"), 20, "date")


@query("T16_rank_in_period", "month:t rank_high:i rank_low:i", """
SELECT month, rank() OVER (PARTITION BY year(month) ORDER BY revenue DESC) AS rank_high,
       rank() OVER (PARTITION BY year(month) ORDER BY revenue) AS rank_low FROM x_monthly""")
def _(shop):
    return T.rank_in_period(C.monthly(shop).withColumn("year", F.year("month")), "revenue", ["year"])


@query("T17_inter_event_gap", "gaps:i mean_gap:d median_gap:d longest_gap:i", """
WITH g AS (SELECT order_date - lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS gap FROM x_orders)
SELECT count(gap) AS gaps, avg(gap) AS mean_gap, quantile_cont(gap, 0.5) AS median_gap, max(gap) AS longest_gap FROM g""")
def _(shop):
    return T.gap_summary(shop.orders, "customer_id", "order_date")


@query("T18_event_number", "order_id:i customer_id:i number:i", """
SELECT order_id, customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS number
FROM x_orders""")
def _(shop):
    order = [F.col("order_date"), F.col("order_id")]
    return positions(shop.orders, order, ["customer_id"], "number")


@query("T19_expanding_mean", "month:t revenue_history:d", """
SELECT month, avg(revenue) OVER (PARTITION BY month(month) ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
       AS revenue_history FROM x_monthly""")
def _(shop):
    keyed = C.monthly(shop).withColumn("moy", F.month("month"))
    return T.expanding_mean(keyed, "revenue", ["moy"], date="month")


@query("T20_cumulative_share", "product_id:i revenue:d share:d", """
WITH p AS (SELECT product_id, round(sum(revenue), 4) AS revenue FROM x_items GROUP BY 1)
SELECT product_id, revenue, sum(revenue) OVER (ORDER BY revenue DESC, product_id ROWS UNBOUNDED PRECEDING)
       / sum(revenue) OVER () AS share FROM p""")
def _(shop):
    products = shop.items.groupBy("product_id").agg(F.round(F.sum("revenue"), 4).alias("revenue"))
    whole = products.agg(F.sum("revenue")).scalar()
    done = running(products, {"so_far": F.col("revenue")}, [F.desc("revenue"), F.col("product_id")])
    return done.withColumn("whole", whole).withColumn("share", ratio(F.col("so_far"), F.col("whole")))


@query("T21_percentile_rank", "order_id:i pct_rank:d", """
SELECT order_id, (rank() OVER (ORDER BY order_value) + (count(*) OVER (PARTITION BY order_value) - 1) / 2.0)
       / count(*) OVER () AS pct_rank FROM x_orders""")
def _(shop):
    return percent_ranks(shop.orders, "order_value", "pct_rank")


@query("T22_group_lag_lead", "category:s month:t revenue_lag_1:d revenue_lag_3:d revenue_lead_1:d revenue_lead_3:d", """
SELECT category, month, lag(revenue, 1) OVER w AS revenue_lag_1, lag(revenue, 3) OVER w AS revenue_lag_3,
       lead(revenue, 1) OVER w AS revenue_lead_1, lead(revenue, 3) OVER w AS revenue_lead_3
FROM x_category_months WINDOW w AS (PARTITION BY category ORDER BY month)""")
def _(shop):
    df = T.lags(C.category_months(shop), ["revenue"], [1, 3], ["category"], "month")
    return T.leads(df, ["revenue"], [1, 3], ["category"], "month")


@query("T23_lead_target", "date:t next_7:d next_30:d", """
SELECT date, CASE WHEN count(*) OVER a = 7 THEN sum(revenue) OVER a END AS next_7,
       CASE WHEN count(*) OVER b = 30 THEN sum(revenue) OVER b END AS next_30 FROM x_daily
WINDOW a AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING),
       b AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)""")
def _(shop):
    return C.daily(shop).withColumns(
        {f"next_{n}": T.rolled("revenue", n, "sum", n, -n) for n in (7, 30)}
    )


@query("T24_group_quantiles_on_rows", "category:s month:t median:d p75:d p25:d", """
SELECT category, month, quantile_cont(revenue, 0.5) OVER (PARTITION BY category) AS median,
       quantile_cont(revenue, 0.75) OVER (PARTITION BY category) AS p75,
       quantile_cont(revenue, 0.25) OVER (PARTITION BY category) AS p25 FROM x_category_months""")
def _(shop):
    probs = {"median": 0.5, "p75": 0.75, "p25": 0.25}
    return T.with_group_quantiles(C.category_months(shop), "revenue", probs, ["category"])


@query("T25_trend_direction", "category:s days:i first_mean:d last_mean:d slope:d pct_change:d direction:s", """
WITH d AS (SELECT category, order_date AS date, sum(revenue) AS revenue FROM x_lines GROUP BY 1, 2),
     n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY date) AS i,
                  row_number() OVER (PARTITION BY category ORDER BY date DESC) AS j FROM d),
     s AS (SELECT category, count(*) AS days, avg(revenue) FILTER (i <= 30) AS first_mean,
                  avg(revenue) FILTER (j <= 30) AS last_mean, regr_slope(revenue, i) AS slope FROM n GROUP BY 1)
SELECT *, last_mean / first_mean - 1 AS pct_change, CASE WHEN abs(last_mean / first_mean - 1) < 0.05 THEN 'stable'
       WHEN last_mean > first_mean THEN 'increasing' ELSE 'decreasing' END AS direction FROM s""")
def _(shop):
    df = T.daily_series(shop.lines, "order_date", {"revenue": F.sum("revenue")}, ["category"])
    return T.trend_direction(df, "revenue", ["category"])


@query("T26_index_to_base", "year:i revenue_index:d orders_index:d", """
WITH y AS (SELECT year(month) AS year, sum(revenue) AS r, sum(orders) AS o FROM x_monthly GROUP BY 1)
SELECT year, 100 * r / (SELECT r FROM y WHERE year = 1995) AS revenue_index,
       100.0 * o / (SELECT o FROM y WHERE year = 1995) AS orders_index FROM y""")
def _(shop):
    years = C.monthly(shop).groupBy(F.year("month").alias("year")).agg(
        F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders")
    )
    return T.index_to_base(years, ["revenue", "orders"], "year", 1995)


@query("T27_change_between", "metric:s change:d", """
WITH y AS (SELECT year(month) AS year, sum(revenue) AS r, sum(orders) AS o FROM x_monthly GROUP BY 1)
SELECT 'revenue' AS metric, (SELECT r FROM y WHERE year = 2000) / (SELECT r FROM y WHERE year = 1996) - 1 AS change
UNION ALL SELECT 'orders', 1.0::DOUBLE * (SELECT o FROM y WHERE year = 2000) / (SELECT o FROM y WHERE year = 1996) - 1""")
def _(shop):
    years = C.monthly(shop).groupBy(F.year("month").alias("year")).agg(
        F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders")
    )
    return T.change_between(years, ["revenue", "orders"], "year", 1996, 2000)


@query("T28_growth_volatility", "category:s months:i growth_mean:d growth_std:d", """
WITH g AS (SELECT category, revenue / nullif(lag(revenue) OVER (PARTITION BY category ORDER BY month), 0) - 1 AS g
           FROM x_category_months)
SELECT category, count(*) AS months, avg(g) AS growth_mean, stddev_samp(g) AS growth_std FROM g GROUP BY 1""")
def _(shop):
    return T.growth_volatility(C.category_months(shop), "revenue", ["category"])


@query("T29_growth_profile", "segment:s total:d observed_months:i first_month:t first_value:d last_value:d abs_change:d pct_change:d recent_mean:d earlier_mean:d recent_vs_earlier_pct:d cmgr:d volatility:d cv:d meaningful:b", """
WITH m AS (SELECT segment, CAST(date_trunc('month', order_date) AS DATE) AS month, sum(revenue) AS revenue FROM x_lines GROUP BY 1, 2),
     e AS (SELECT min(month) AS a, max(month) AS b FROM m),
     g AS (SELECT segment, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month
           FROM (SELECT DISTINCT segment FROM m), e),
     d AS (SELECT g.segment, g.month, coalesce(revenue, 0) AS v, g.month > e.b - INTERVAL 6 MONTH AS recent
           FROM g CROSS JOIN e LEFT JOIN m ON m.segment = g.segment AND m.month = g.month),
     s AS (SELECT segment, sum(v) AS total, count(*) FILTER (v > 0) AS observed_months, min(month) FILTER (v > 0) AS first_month,
                  arg_min(v, month) FILTER (v > 0) AS first_value, arg_max(v, month) AS last_value, max(month) AS last_month,
                  quantile_cont(v, 0.5) FILTER (v > 0) AS typical, avg(v) FILTER (recent) AS recent_mean,
                  avg(v) FILTER (NOT recent) AS earlier_mean, stddev_samp(v) AS volatility, stddev_samp(v) / abs(avg(v)) AS cv
           FROM d GROUP BY 1)
SELECT *, last_value - first_value AS abs_change,
       CASE WHEN first_value >= greatest(typical * 0.1, 1) THEN (last_value - first_value) / first_value * 100 END AS pct_change,
       (recent_mean - earlier_mean) / earlier_mean * 100 AS recent_vs_earlier_pct,
       CASE WHEN first_value > 0 AND last_value > 0
            THEN pow(last_value / first_value, 1.0 / greatest(1, date_diff('month', first_month, last_month))) - 1 END AS cmgr,
       total >= greatest(0.005 * sum(total) OVER (), 1) AND observed_months >= 6 AS meaningful FROM s""")
def _(shop):
    months = shop.lines.groupBy("segment", month_start(F.col("order_date")).alias("month")).agg(
        F.sum("revenue").alias("revenue")
    )
    return T.growth_profile(months, "segment")


@query("T30_early_late", "category:s early_mean:d late_mean:d late_minus_early:d late_vs_early_pct:d", """
WITH o AS (SELECT month, row_number() OVER (ORDER BY month) <= greatest(1, floor(count(*) OVER () / 2)) AS early
           FROM (SELECT DISTINCT month FROM x_category_months)),
     n AS (SELECT count(*) FILTER (early) AS e, count(*) FILTER (NOT early) AS l FROM o),
     s AS (SELECT category, sum(revenue) FILTER (early) / any_value(e) AS a, sum(revenue) FILTER (NOT early) / any_value(l) AS b
           FROM x_category_months JOIN o USING (month), n GROUP BY 1)
SELECT category, a AS early_mean, b AS late_mean, b - a AS late_minus_early, (b - a) / a * 100 AS late_vs_early_pct FROM s""")
def _(shop):
    return T.early_late(C.category_months(shop), "category")


view("x_acf", """
SELECT k AS lag, corr(a.revenue, b.revenue) AS correlation, count(*) AS pairs
FROM x_daily a, range(1, 367) t(k), x_daily b WHERE b.date = a.date - CAST(k AS INTEGER) GROUP BY 1
""")


@query("T31_autocorrelation", "lag:i correlation:d pairs:i", "SELECT * FROM x_acf WHERE lag <= 365")
def _(shop):
    return T.autocorrelation(C.daily(shop), "revenue", 365)


@query("T32_acf_peaks", "lag:i is_peak:b label:s", """
SELECT lag, coalesce(correlation > lag(correlation) OVER w AND correlation > lead(correlation) OVER w, false) AS is_peak,
       CASE WHEN abs(correlation) >= 0.7 THEN 'strong' WHEN abs(correlation) >= 0.4 THEN 'moderate'
            WHEN abs(correlation) >= 0.2 THEN 'weak' ELSE 'very weak' END
       || CASE WHEN correlation > 0 THEN ' positive' WHEN correlation < 0 THEN ' negative' ELSE ' zero' END AS label
FROM x_acf WHERE lag <= 120 WINDOW w AS (ORDER BY lag)""")
def _(shop):
    return T.acf_peaks(T.autocorrelation(C.daily(shop), "revenue", 120))


@query("T33_cycle_check", "cycle:s max_corr:d mean_corr:d verdict:s", """
WITH c AS (SELECT CASE WHEN lag IN (7, 14, 21, 28) THEN 'weekly' WHEN lag IN (30, 60, 90) THEN 'monthly_like'
                       WHEN lag IN (364, 365, 366) THEN 'yearly' END AS cycle, correlation FROM x_acf)
SELECT cycle, max(correlation) AS max_corr, avg(correlation) AS mean_corr,
       CASE WHEN max(correlation) >= 0.4 AND avg(correlation) >= 0.2 THEN 'visible'
            WHEN max(correlation) >= 0.2 THEN 'weak or mixed' ELSE 'not clearly visible' END AS verdict
FROM c WHERE cycle IS NOT NULL GROUP BY 1""")
def _(shop):
    return T.cycle_check(T.autocorrelation(C.daily(shop), "revenue", 366))


view("x_series", """
WITH d AS (SELECT category, order_date AS date, sum(revenue) AS v FROM x_lines GROUP BY 1, 2),
     e AS (SELECT category, min(date) AS a, max(date) AS b FROM d GROUP BY 1),
     g AS (SELECT category, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM e),
     f AS (SELECT g.category AS series, g.date, coalesce(v, 0) AS v FROM g LEFT JOIN d ON d.category = g.category AND d.date = g.date
           UNION ALL SELECT 'all', date, revenue FROM x_daily)
SELECT series, row_number() OVER (PARTITION BY series ORDER BY date) AS t, (v - avg(v) OVER (PARTITION BY series)) / stddev_samp(v) OVER (PARTITION BY series) AS z FROM f
""")


def revenue_series(shop):
    """Daily revenue per category and of all of them."""
    day = F.col("order_date").alias("date")
    parts = shop.lines.groupBy("category", day).agg(F.sum("revenue").alias("revenue"))
    parts = T.densify(parts, {"revenue": 0.0}, ["category"]).select("category", "date", "revenue")
    whole = C.daily(shop).select(F.lit("all").alias("category"), "date", "revenue")
    return parts.unionByName(whole).withColumnRenamed("category", "series")


@query("T34_partial_autocorrelation", "series:s lag:i partial_correlation:d pairs:i")
def _(shop):
    """Per category and for all of them."""
    return T.partial_autocorrelation(revenue_series(shop), "revenue", 60, "series")


@query("T34b_lag_products", "series:s place:i total:d", """
WITH p AS (SELECT a, b, b * (b + 1) // 2 + a AS place FROM range(0, 62) x(a), range(0, 62) y(b) WHERE a <= b),
     v AS (SELECT series, t, 0 AS i, 1.0::DOUBLE AS z FROM x_series WHERE t > 60
           UNION ALL SELECT s.series, s.t + k, k + 1, s.z FROM x_series s, range(0, 61) r(k)
           WHERE s.t + k > 60 AND s.t + k <= (SELECT max(t) FROM x_series m WHERE m.series = s.series))
SELECT u.series, place, sum(u.z * w.z) AS total FROM p JOIN v u ON u.i = p.a JOIN v w ON w.i = p.b AND w.series = u.series AND w.t = u.t GROUP BY 1, 2""")
def _(shop):
    """The sums behind the correlogram, over the days that know all sixty lags."""
    return T.lag_products(revenue_series(shop), "revenue", 60, ["series"]).where("depth = 61")


@query("T34c_first_partials", "series:s lag:i partial_correlation:d pairs:i", """
WITH l AS (SELECT series, t, z AS a, lag(z, 1) OVER w AS b, lag(z, 2) OVER w AS c, lag(z, 3) OVER w AS d FROM x_series WINDOW w AS (PARTITION BY series ORDER BY t)),
     two AS (SELECT series, count(*) AS n, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM l WHERE c IS NOT NULL GROUP BY 1),
     three AS (SELECT series, count(*) AS n, corr(a, b) AS ab, corr(a, c) AS ac, corr(a, d) AS ad, corr(b, c) AS bc, corr(b, d) AS bd, corr(c, d) AS cd
               FROM l WHERE d IS NOT NULL GROUP BY 1),
     given AS (SELECT series, n, (ac - ab * bc) / sqrt((1 - ab * ab) * (1 - bc * bc)) AS ac, (ad - ab * bd) / sqrt((1 - ab * ab) * (1 - bd * bd)) AS ad,
                      (cd - bc * bd) / sqrt((1 - bc * bc) * (1 - bd * bd)) AS cd FROM three)
SELECT series, 1 AS lag, corr(a, b) AS partial_correlation, count(*) AS pairs FROM l WHERE b IS NOT NULL GROUP BY 1
UNION ALL SELECT series, 2, (ac - ab * bc) / sqrt((1 - ab * ab) * (1 - bc * bc)), n FROM two
UNION ALL SELECT series, 3, (ad - ac * cd) / sqrt((1 - ac * ac) * (1 - cd * cd)), n FROM given""")
def _(shop):
    return T.partial_autocorrelation(revenue_series(shop), "revenue", 60, "series").where("lag <= 3")


@query("T35_cross_correlation", "lag:i feature:s correlation:d pairs:i", """
SELECT k AS lag, 'sessions' AS feature, corr(a.revenue, b.sessions) AS correlation, count(*) AS pairs
FROM x_web_daily a, range(0, 15) t(k), x_web_daily b WHERE b.date = a.date - CAST(k AS INTEGER) GROUP BY 1
UNION ALL
SELECT k, 'page_views', corr(a.revenue, b.page_views), count(*)
FROM x_web_daily a, range(0, 15) t(k), x_web_daily b WHERE b.date = a.date - CAST(k AS INTEGER) GROUP BY 1""")
def _(shop):
    steps = F.sequence(F.lit(0), F.lit(14))
    return T.cross_correlation(C.web_daily(shop), "revenue", ["sessions", "page_views"], steps)


@query("T36_sign_changes", "values:i sign_changes:i", """
WITH s AS (SELECT date, sign(d) AS s FROM (SELECT date, revenue - avg(revenue) OVER () AS d FROM x_daily)),
     c AS (SELECT s <> lag(s) OVER (ORDER BY date) AS f FROM s)
SELECT count(*) AS "values", count(*) FILTER (f) AS sign_changes FROM c""")
def _(shop):
    mean = C.daily(shop).agg(F.avg("revenue")).scalar()
    centered = C.daily(shop).withColumn("mean", mean).withColumn("d", F.col("revenue") - F.col("mean"))
    return T.sign_changes(centered, "d")


@query("T37_direction_runs", "direction:s start_month:t end_month:t length_months:i total_change:d", """
WITH d AS (SELECT month, revenue - lag(revenue) OVER (ORDER BY month) AS step FROM x_monthly),
     s AS (SELECT *, CASE WHEN step > 0 THEN 'growth' ELSE 'decline' END AS direction FROM d WHERE step IS NOT NULL),
     i AS (SELECT *, row_number() OVER (ORDER BY month) - row_number() OVER (PARTITION BY direction ORDER BY month) AS k FROM s)
SELECT direction, min(month) AS start_month, max(month) AS end_month, count(*) AS length_months, sum(step) AS total_change
FROM i GROUP BY direction, k ORDER BY 4 DESC, 5 DESC, 2 LIMIT 15""")
def _(shop):
    return T.direction_runs(C.monthly(shop), "revenue")


# --- order, limit and sets ------------------------------------------------------

@query("L01_order_limit", "product_id:i revenue:d", """
SELECT product_id, sum(revenue) AS revenue FROM x_items GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(shop):
    sums = shop.items.groupBy("product_id").agg(F.sum("revenue").alias("revenue"))
    return sums.orderBy(F.desc("revenue"), "product_id").limit(10)


@query("L02_nlargest_nsmallest", "side:s order_id:i order_value:d", """
(SELECT 'largest' AS side, order_id, order_value FROM x_orders ORDER BY order_value DESC, order_id LIMIT 5)
UNION ALL (SELECT 'smallest', order_id, order_value FROM x_orders ORDER BY order_value, order_id LIMIT 5)""")
def _(shop):
    df = shop.orders.select("order_id", "order_value")
    top = df.orderBy(F.desc("order_value"), "order_id").limit(5).withColumn("side", F.lit("largest"))
    low = df.orderBy("order_value", "order_id").limit(5).withColumn("side", F.lit("smallest"))
    return top.unionByName(low)


@query("L03_top_per_group", "category:s product_id:i revenue:d place:i", """
WITH p AS (SELECT category, product_id, sum(revenue) AS revenue FROM x_lines GROUP BY 1, 2),
     r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY revenue DESC, product_id) AS place FROM p)
SELECT * FROM r WHERE place <= 3""")
def _(shop):
    sums = shop.items.groupBy("product_id").agg(F.sum("revenue").alias("revenue"))
    named = sums.join(shop.products.select("product_id", "category"), "product_id")
    return T.top_per_group(named, ["category"], [F.desc("revenue"), F.col("product_id")], 3)


@query("L05_union", "source:s date:t rows:i note:s", """
SELECT 'orders' AS source, order_date AS date, count(*) AS rows, NULL AS note FROM x_orders GROUP BY 2
UNION ALL SELECT 'returns', return_date, count(*), 'refund' FROM x_returns GROUP BY 2""")
def _(shop):
    a = shop.orders.groupBy(F.col("order_date").alias("date")).agg(F.count("*").alias("rows"))
    b = shop.returns.groupBy(F.col("return_date").alias("date")).agg(F.count("*").alias("rows"))
    return Q.union_all(
        [
            a.withColumn("source", F.lit("orders")),
            b.withColumns({"source": F.lit("returns"), "note": F.lit("refund")}),
        ]
    )


@query("L06_set_operations", "kind:s product_id:i", """
(SELECT 'both' AS kind, product_id FROM x_returns INTERSECT SELECT 'both', product_id FROM x_reviews)
UNION ALL (SELECT 'never_sold', product_id FROM x_products EXCEPT SELECT 'never_sold', product_id FROM x_items)""")
def _(shop):
    both = shop.returns.select("product_id").intersect(shop.reviews.select("product_id"))
    never = shop.products.select("product_id").subtract(shop.items.select("product_id"))
    return both.withColumn("kind", F.lit("both")).unionByName(never.withColumn("kind", F.lit("never_sold")))


@query("L07_distinct", "month:t category:s", """
SELECT DISTINCT month, category FROM x_inventory WHERE stockout_flag""")
def _(shop):
    return shop.inventory.where("stockout_flag").select("month", "category").dropDuplicates()


@query("L08_spaced_top", "date:t", """
WITH RECURSIVE pick(step, chosen) AS (
  SELECT 1, [(SELECT date FROM x_sales ORDER BY round(revenue, 4) DESC, date LIMIT 1)]
  UNION ALL
  SELECT step + 1, list_append(chosen, (SELECT s.date FROM x_sales s
     WHERE len(list_filter(chosen, lambda d: abs(date_diff('day', d, s.date)) < 90)) = 0
     ORDER BY round(s.revenue, 4) DESC, s.date LIMIT 1))
  FROM pick WHERE step < 12)
SELECT date FROM (SELECT unnest(chosen) AS date FROM pick WHERE step = 12) WHERE date IS NOT NULL""")
def _(shop):
    return T.spaced_top(shop.sales.withColumn("score", F.round("revenue", 4)), "score", 90, 12)
