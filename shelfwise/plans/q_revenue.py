"""Revenue, calendar and anomaly analyses."""

from pyspark.sql import functions as F

from shelfwise.functions import scalars as S
from shelfwise.operators import anomaly as N
from shelfwise.operators import quality as Q
from shelfwise.operators import seasonality as E
from shelfwise.operators import timeseries as T
from shelfwise.plans import common as C
from shelfwise.plans.q_series import roll_sql
from shelfwise.plans.registry import query, view


@query("D01_monthly_revenue_profit", "month:t revenue:d profit:d", """
SELECT month, revenue, revenue - cogs AS profit FROM x_monthly""")
def _(shop):
    return E.monthly_revenue_profit(shop.sales)


@query("D02_best_month_per_year", "year:i best_revenue_month:i best_revenue:d best_profit_month:i best_profit:d margin:d", """
WITH m AS (SELECT year(month) AS year, month(month) AS moy, revenue, revenue - cogs AS profit,
                  row_number() OVER (PARTITION BY year(month) ORDER BY revenue DESC, month) AS r,
                  row_number() OVER (PARTITION BY year(month) ORDER BY revenue - cogs DESC, month) AS p FROM x_monthly)
SELECT a.year, a.moy AS best_revenue_month, a.revenue AS best_revenue, b.moy AS best_profit_month,
       b.profit AS best_profit, b.profit / b.revenue AS margin
FROM m a JOIN m b ON a.year = b.year AND b.p = 1 WHERE a.r = 1""")
def best_month(shop):
    return E.best_month_per_year(shop.sales)


@query("D03_breakpoints", "date:t before_mean:d after_mean:d pct_difference:d reason:s", """
WITH RECURSIVE b AS (SELECT date, CASE WHEN count(revenue) OVER p >= 90 THEN avg(revenue) OVER p END AS before_mean,
                  CASE WHEN count(revenue) OVER n >= 90 THEN avg(revenue) OVER n END AS after_mean FROM x_daily
           WINDOW p AS (ORDER BY date ROWS BETWEEN 180 PRECEDING AND 1 PRECEDING),
                  n AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 180 FOLLOWING)),
     c AS (SELECT *, (after_mean - before_mean) * 100 / before_mean AS pct_difference,
                  round(abs((after_mean - before_mean) * 100 / before_mean), 6) AS score
           FROM b WHERE after_mean IS NOT NULL AND before_mean IS NOT NULL),
     pick(step, chosen) AS (
       SELECT 1, [(SELECT date FROM c ORDER BY score DESC, date LIMIT 1)]
       UNION ALL
       SELECT step + 1, list_append(chosen, (SELECT c.date FROM c
          WHERE len(list_filter(chosen, lambda d: abs(date_diff('day', d, c.date)) < 90)) = 0
          ORDER BY score DESC, c.date LIMIT 1)) FROM pick WHERE step < 12)
SELECT date, before_mean, after_mean, pct_difference,
       CASE WHEN after_mean > before_mean THEN 'candidate sustained level increase'
            ELSE 'candidate sustained level decrease' END AS reason
FROM c WHERE date IN (SELECT unnest(chosen) FROM pick WHERE step = 12)""")
def _(shop):
    return N.breakpoints(C.daily(shop))


SEASON = """
SELECT '{label}' AS kind, {part} AS part, sum(revenue) AS total, avg(revenue) AS mean, quantile_cont(revenue, 0.5) AS median,
       stddev_samp(revenue) AS std, count(*) AS days, rank() OVER (ORDER BY avg(revenue) DESC) AS rank FROM x_daily GROUP BY 2"""


@query("D04_seasonality", "kind:s part:i total:d mean:d median:d std:d days:i rank:i", " UNION ALL ".join([
    SEASON.format(label="month", part="month(date)"),
    SEASON.format(label="quarter", part="quarter(date)"),
    SEASON.format(label="weekday", part="isodow(date) - 1"),
    SEASON.format(label="day", part="day(date)"),
]))
def _(shop):
    daily = C.daily(shop)
    parts = {"month": F.month, "quarter": F.quarter, "weekday": F.weekday, "day": F.dayofmonth}
    return Q.union_all(
        [E.seasonality(daily, f("date")).withColumn("kind", F.lit(n)) for n, f in parts.items()]
    )


@query("D04b_yearly_summary", "year:i total:d daily_mean:d days:i monthly_mean:d growth_pct:d", """
WITH m AS (SELECT year(date) AS year, month(date) AS m, sum(revenue) AS v, count(*) AS n FROM x_daily GROUP BY 1, 2),
     y AS (SELECT year, sum(v) AS total, sum(v) / sum(n) AS daily_mean, sum(n) AS days, avg(v) AS monthly_mean FROM m GROUP BY 1)
SELECT *, (total / lag(total) OVER (ORDER BY year) - 1) * 100 AS growth_pct FROM y""")
def _(shop):
    return E.yearly_summary(C.daily(shop))


@query("D05_month_rank_consistency", "month:i years:i mean:d median:d std:d top_3:i bottom_3:i mean_rank:d cv:d top_3_pct:d bottom_3_pct:d season:s stability:s", """
WITH m AS (SELECT year(date) AS year, month(date) AS month, sum(revenue) AS v FROM x_daily GROUP BY 1, 2),
     r AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY v DESC) AS hi, rank() OVER (PARTITION BY year ORDER BY v) AS lo FROM m),
     s AS (SELECT month, count(*) AS years, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_samp(v) AS std,
                  count(*) FILTER (hi <= 3) AS top_3, count(*) FILTER (lo <= 3) AS bottom_3, avg(hi) AS mean_rank,
                  stddev_samp(v) / avg(v) AS cv FROM r GROUP BY 1)
SELECT *, 100.0 * top_3 / years AS top_3_pct, 100.0 * bottom_3 / years AS bottom_3_pct,
       CASE WHEN 100.0 * top_3 / years >= 50 THEN 'repeated high-revenue month'
            WHEN 100.0 * bottom_3 / years >= 50 THEN 'repeated low-revenue month' ELSE 'mixed/neutral' END AS season,
       CASE WHEN cv >= (SELECT quantile_cont(cv, 0.75) FROM s) THEN 'more volatile' ELSE 'more stable' END AS stability FROM s""")
def _(shop):
    return E.month_rank_consistency(C.daily(shop))


@query("D06_year_month_matrix", "year:i " + " ".join(f"m{m}:d" for m in range(1, 13)), f"""
SELECT year(date) AS year, {", ".join(f"sum(revenue) FILTER (month(date) = {m}) AS m{m}" for m in range(1, 13))}
FROM x_daily GROUP BY 1""")
def _(shop):
    return E.year_month_matrix(C.daily(shop))


@query("D07_weekend_effect", "weekend_mean:d weekday_mean:d difference_pct:d", """
WITH w AS (SELECT avg(revenue) FILTER (isodow(date) >= 6) AS weekend_mean, avg(revenue) FILTER (isodow(date) < 6) AS weekday_mean FROM x_daily)
SELECT *, (weekend_mean / weekday_mean - 1) * 100 AS difference_pct FROM w""")
def _(shop):
    return E.weekend_effect(C.daily(shop))


@query("D08_profile_stability", "year:i best:i worst:i spread_pct:d profile_corr:d reasons:s", """
WITH o AS (SELECT isodow(date) - 1 AS part, avg(revenue) AS overall FROM x_daily GROUP BY 1),
     w AS (SELECT arg_max(part, overall) AS best, arg_min(part, overall) AS worst,
                  (max(overall) - min(overall)) * 100 / avg(overall) AS spread FROM o),
     y AS (SELECT year(date) AS year, isodow(date) - 1 AS part, avg(revenue) AS m FROM x_daily GROUP BY 1, 2),
     s AS (SELECT year, arg_max(part, m) AS best, arg_min(part, m) AS worst, (max(m) - min(m)) * 100 / avg(m) AS spread_pct,
                  corr(m, overall) AS profile_corr FROM y JOIN o USING (part) GROUP BY 1)
SELECT s.*, concat_ws('; ', CASE WHEN profile_corr < 0.5 THEN 'low correlation with overall profile' END,
       CASE WHEN s.best <> w.best AND s.worst <> w.worst THEN 'best and weakest differ from overall' END,
       CASE WHEN spread_pct > greatest(10, 1.5 * spread) THEN 'unusually wide spread' END) AS reasons FROM s, w""")
def _(shop):
    return E.profile_stability(C.daily(shop), F.weekday("date"))


@query("D09_within_group_outliers", "date:t part:i direction:s", """
WITH q AS (SELECT isodow(date) - 1 AS part, quantile_cont(revenue, 0.25) AS q1, quantile_cont(revenue, 0.75) AS q3 FROM x_daily GROUP BY 1)
SELECT date, part, CASE WHEN revenue > q3 + 1.5 * (q3 - q1) THEN 'high' ELSE 'low' END AS direction
FROM x_daily JOIN q ON part = isodow(date) - 1
WHERE revenue > q3 + 1.5 * (q3 - q1) OR revenue < q1 - 1.5 * (q3 - q1)""")
def _(shop):
    return N.within_group_outliers(C.daily(shop), F.weekday("date"))


@query("D10_month_position_payday", "kind:s grp:s total:d mean:d median:d std:d days:i rank:i", """
WITH p AS (SELECT revenue, CASE WHEN day(date) <= 7 THEN 'month_start' WHEN last_day(date) - date <= 6 THEN 'month_end' ELSE 'month_middle' END AS a,
                  CASE WHEN day(date) >= 25 OR day(date) <= 5 THEN 'payday_proxy_window' ELSE 'non_payday_proxy_window' END AS b FROM x_daily)
SELECT 'position' AS kind, a AS grp, sum(revenue) AS total, avg(revenue) AS mean, quantile_cont(revenue, 0.5) AS median,
       stddev_samp(revenue) AS std, count(*) AS days, rank() OVER (ORDER BY avg(revenue) DESC) AS rank FROM p GROUP BY 2
UNION ALL SELECT 'payday', b, sum(revenue), avg(revenue), quantile_cont(revenue, 0.5), stddev_samp(revenue), count(*),
       rank() OVER (ORDER BY avg(revenue) DESC) FROM p GROUP BY 2""")
def _(shop):
    daily, day = C.daily(shop), F.col("date")
    parts = {"position": S.month_position(day), "payday": S.payday_window(day)}
    return Q.union_all(
        [E.seasonality(daily, p).withColumn("kind", F.lit(n)) for n, p in parts.items()]
    ).withColumnRenamed("part", "grp")


@query("D11_dom_consistency", "day:i mean:d observed_months:i cv:d possible_months:i years:i share_above:d share_below:d observation_rate:d rank:i", """
WITH d AS (SELECT * FROM x_daily WHERE was_observed),
     s AS (SELECT day(date) AS day, avg(revenue) AS mean, count(DISTINCT date_trunc('month', date)) AS observed_months,
                  stddev_samp(revenue) / abs(avg(revenue)) AS cv FROM d GROUP BY 1),
     m AS (SELECT unnest(generate_series(date_trunc('month', (SELECT min(date) FROM d))::TIMESTAMP,
                                         date_trunc('month', (SELECT max(date) FROM d))::TIMESTAMP, INTERVAL 1 MONTH)) AS m),
     p AS (SELECT k AS day, count(*) AS possible_months FROM m, range(1, 32) t(k) WHERE k <= day(last_day(m)) GROUP BY 1),
     y AS (SELECT year(date) AS year, day(date) AS day, avg(revenue) AS v FROM d GROUP BY 1, 2),
     q AS (SELECT year, quantile_cont(v, 0.5) AS mid FROM y GROUP BY 1),
     h AS (SELECT day, count(*) AS years, 1.0 * count(*) FILTER (v > mid) / count(*) AS share_above,
                  1.0 * count(*) FILTER (v < mid) / count(*) AS share_below FROM y JOIN q USING (year) GROUP BY 1)
SELECT *, 1.0 * observed_months / possible_months AS observation_rate, rank() OVER (ORDER BY mean DESC) AS rank
FROM s JOIN p USING (day) JOIN h USING (day)""")
def _(shop):
    return E.day_of_month_consistency(shop.sales)


view("x_anomalies", f"""
WITH s AS (SELECT avg(revenue) AS m, stddev_samp(revenue) AS sd, quantile_cont(revenue, 0.25) AS q1, quantile_cont(revenue, 0.75) AS q3,
                  quantile_cont(revenue, 0.01) AS p01, quantile_cont(revenue, 0.99) AS p99 FROM x_daily),
     w AS (SELECT date, {roll_sql("revenue", "mean", 30, 15, 1)} AS m30, {roll_sql("revenue", "std", 30, 15, 1)} AS s30,
                  {roll_sql("revenue", "mean", 90, 45, 1)} AS m90, {roll_sql("revenue", "std", 90, 45, 1)} AS s90 FROM x_daily),
     z AS (SELECT d.date, d.revenue, (revenue - m) / sd AS z, (revenue - m30) / nullif(s30, 0) AS z_30, (revenue - m90) / nullif(s90, 0) AS z_90,
                  (rank() OVER (ORDER BY revenue) + (count(*) OVER (PARTITION BY revenue) - 1) / 2.0) / count(*) OVER () AS pct_rank,
                  revenue > q3 + 1.5 * (q3 - q1) AS ih, revenue < q1 - 1.5 * (q3 - q1) AS il, revenue >= p99 AS ph, revenue <= p01 AS pl
           FROM x_daily d JOIN w USING (date), s),
     f AS (SELECT *, coalesce(z >= 3, false) OR ih OR ph AS gh, coalesce(z <= -3, false) OR il OR pl AS gl,
                  coalesce(z_30 >= 2.5, false) OR coalesce(z_90 >= 2.5, false) AS rh,
                  coalesce(z_30 <= -2.5, false) OR coalesce(z_90 <= -2.5, false) AS rl FROM z)
SELECT *, concat_ws(', ', CASE WHEN abs(z) >= 3 THEN 'global_zscore' END, CASE WHEN ih OR il THEN 'iqr_rule' END,
                    CASE WHEN ph OR pl THEN 'percentile_threshold' END) AS methods,
       CASE WHEN gh AND gl THEN 'mixed' WHEN gh THEN 'high' WHEN gl THEN 'low' ELSE 'none' END AS direction,
       CASE WHEN (gh OR gl) AND (rh OR rl) THEN 'global_and_rolling' WHEN gh OR gl THEN 'global_only' ELSE 'rolling_only' END AS source
FROM f
""")


@query("D12_global_anomalies", "date:t z:d pct_rank:d methods:s direction:s", """
SELECT date, z, pct_rank, methods, direction FROM x_anomalies WHERE gh OR gl""")
def _(shop):
    return N.global_anomalies(C.daily(shop)).where("global_anomaly")


@query("D13_rolling_anomalies", "date:t z_30:d z_90:d rolling_high:b rolling_low:b max_abs_z:d", """
SELECT date, z_30, z_90, rh AS rolling_high, rl AS rolling_low, greatest(abs(z_30), abs(z_90)) AS max_abs_z
FROM x_anomalies WHERE rh OR rl""")
def _(shop):
    return N.rolling_anomalies(C.daily(shop)).where("rolling_anomaly")


@query("D14_all_anomaly_days", "date:t direction:s source:s max_abs_score:d gap_days:i", """
SELECT date, CASE WHEN gh OR rh THEN 'high' ELSE 'low' END AS direction, source,
       greatest(abs(z), abs(z_30), abs(z_90)) AS max_abs_score, date - lag(date) OVER (ORDER BY date) AS gap_days
FROM x_anomalies WHERE gh OR gl OR rh OR rl""")
def _(shop):
    return N.all_anomaly_days(C.daily(shop))


@query("D14b_clustering_share", "anomalies:i clustered:i cluster_share:d", """
WITH a AS (SELECT date - lag(date) OVER (ORDER BY date) AS g FROM x_anomalies WHERE gh OR gl OR rh OR rl)
SELECT count(*) AS anomalies, count(*) FILTER (g <= 3) AS clustered, 1.0 * count(*) FILTER (g <= 3) / count(*) AS cluster_share FROM a""")
def _(shop):
    return N.clustering_share(N.all_anomaly_days(C.daily(shop)))


@query("D15_anomaly_calendar", "year:i month:i high:i low:i", """
SELECT year(date) AS year, month(date) AS month, count(*) FILTER (gh OR rh) AS high, count(*) FILTER (NOT (gh OR rh)) AS low
FROM x_anomalies WHERE gh OR gl OR rh OR rl GROUP BY 1, 2""")
def _(shop):
    return N.anomaly_calendar(N.all_anomaly_days(C.daily(shop)))


@query("D16_context_overlap", "context:s signal_days:i same_day:i nearby:i high_nearby:i low_nearby:i", """
WITH a AS (SELECT date, CASE WHEN gh OR rh THEN 'high' ELSE 'low' END AS direction FROM x_anomalies WHERE gh OR gl OR rh OR rl),
     r AS (SELECT return_date AS date, sum(refund_amount) AS v FROM x_returns GROUP BY 1),
     rs AS (SELECT 'returns' AS context, date FROM r WHERE (v - (SELECT avg(v) FROM r)) / (SELECT stddev_samp(v) FROM r) >= 2),
     p AS (SELECT order_date AS date, sum(order_value) AS v FROM x_orders GROUP BY 1),
     ps AS (SELECT 'payments' AS context, date FROM p WHERE (v - (SELECT avg(v) FROM p)) / (SELECT stddev_samp(v) FROM p) >= 2),
     s AS (SELECT * FROM rs UNION ALL SELECT * FROM ps)
SELECT c.context, (SELECT count(*) FROM s WHERE s.context = c.context) AS signal_days,
       (SELECT count(*) FROM a WHERE date IN (SELECT date FROM s WHERE s.context = c.context)) AS same_day,
       count(*) AS nearby, count(*) FILTER (direction = 'high') AS high_nearby, count(*) FILTER (direction = 'low') AS low_nearby
FROM (SELECT DISTINCT context FROM s) c JOIN a ON EXISTS (SELECT 1 FROM s WHERE s.context = c.context AND abs(s.date - a.date) <= 7) GROUP BY 1""")
def _(shop):
    refunds = T.daily_series(shop.returns, "return_date", {"v": F.sum("refund_amount")})
    paid = T.daily_series(shop.orders, "order_date", {"v": F.sum("order_value")})
    signals = {"returns": N.signal_days(refunds, "v"), "payments": N.signal_days(paid, "v")}
    return N.context_overlap(N.all_anomaly_days(C.daily(shop)), signals)


@query("D17_group_spikes", "traffic_source:s date:t z:d pct_rank:d p99:d revenue_spike:b", """
WITH g AS (SELECT traffic_source, avg(sessions) AS m, stddev_pop(sessions) AS sd, quantile_cont(sessions, 0.95) AS p95,
                  quantile_cont(sessions, 0.99) AS p99 FROM x_traffic GROUP BY 1 HAVING count(*) >= 10 AND stddev_pop(sessions) > 0),
     t AS (SELECT *, (rank() OVER (PARTITION BY traffic_source ORDER BY sessions) +
                      (count(*) OVER (PARTITION BY traffic_source, sessions) - 1) / 2.0) / count(*) OVER (PARTITION BY traffic_source) AS pct_rank FROM x_traffic),
     c AS (SELECT greatest(quantile_cont(revenue, 0.95), avg(revenue) + 3 * stddev_pop(revenue)) AS cut FROM x_web_daily)
SELECT traffic_source, t.date, (t.sessions - m) / sd AS z, pct_rank, p99, w.revenue >= cut AS revenue_spike
FROM t JOIN g USING (traffic_source) LEFT JOIN x_web_daily w ON w.date = t.date, c
WHERE (t.sessions - m) / sd >= 3 OR t.sessions >= p95""")
def _(shop):
    web = C.web_daily(shop).select("date", "revenue")
    marked = web.withColumn("cut", N.high_threshold(web, "revenue")).select(
        "date", (F.col("revenue") >= F.col("cut")).alias("revenue_spike")
    )
    return N.group_spikes(shop.traffic, "traffic_source", "sessions").join(marked, "date", "left")


view("x_web_spikes", """
WITH s AS (SELECT avg(sessions) AS m, stddev_pop(sessions) AS sd, quantile_cont(sessions, 0.25) AS q1, quantile_cont(sessions, 0.75) AS q3,
                  quantile_cont(sessions, 0.95) AS p95 FROM x_web_daily)
SELECT date, sessions, (sessions - m) / sd AS spike_z FROM x_web_daily, s
WHERE (sessions - m) / sd >= 3 OR sessions >= q3 + 1.5 * (q3 - q1) OR sessions >= p95
""")
view("x_revenue_spikes", """
WITH s AS (SELECT avg(revenue) AS m, stddev_pop(revenue) AS sd, quantile_cont(revenue, 0.25) AS q1, quantile_cont(revenue, 0.75) AS q3,
                  quantile_cont(revenue, 0.95) AS p95 FROM x_web_daily)
SELECT date FROM x_web_daily, s WHERE (revenue - m) / sd >= 3 OR revenue >= q3 + 1.5 * (q3 - q1) OR revenue >= p95
""")


@query("D18_spike_followup", "date:t sessions:i spike_z:d revenue:d revenue_plus_1:d revenue_plus_7:d spike_same_day:b spike_plus_1:b", """
WITH c AS (SELECT greatest(quantile_cont(revenue, 0.95), avg(revenue) + 3 * stddev_pop(revenue)) AS cut FROM x_web_daily)
SELECT s.date, s.sessions, spike_z, w.revenue, a.revenue AS revenue_plus_1, b.revenue AS revenue_plus_7,
       w.revenue >= cut AS spike_same_day, a.revenue >= cut AS spike_plus_1
FROM x_web_spikes s JOIN x_web_daily w ON w.date = s.date LEFT JOIN x_web_daily a ON a.date = s.date + 1
     LEFT JOIN x_web_daily b ON b.date = s.date + 7, c""")
def _(shop):
    return N.spike_followup(C.web_daily(shop), "sessions", "revenue")


@query("D19_volatility_by_year", "year:i mean_roll_std_90:d std:d mean:d cv:d", f"""
WITH r AS (SELECT date, revenue, {roll_sql("revenue", "std", 90, 30, 0)} AS roll FROM x_daily)
SELECT year(date) AS year, avg(roll) AS mean_roll_std_90, stddev_samp(revenue) AS std, avg(revenue) AS mean,
       stddev_samp(revenue) / avg(revenue) AS cv FROM r GROUP BY 1""")
def _(shop):
    return E.volatility_by_year(C.daily(shop))


@query("D20_target_distribution", "year:i days:i mean:d std:d low:d high:d p1:d p5:d p50:d p95:d p99:d skew:d log_skew:d log_mean:d cv:d zero_days:i negative_days:i", """
SELECT year(date) AS year, count(*) AS days, avg(revenue) AS mean, stddev_samp(revenue) AS std, min(revenue) AS low, max(revenue) AS high,
       quantile_cont(revenue, 0.01) AS p1, quantile_cont(revenue, 0.05) AS p5, quantile_cont(revenue, 0.5) AS p50,
       quantile_cont(revenue, 0.95) AS p95, quantile_cont(revenue, 0.99) AS p99, skewness(revenue) AS skew,
       skewness(ln(1 + revenue)) AS log_skew, avg(ln(1 + revenue)) AS log_mean, stddev_samp(revenue) / avg(revenue) AS cv,
       count(*) FILTER (revenue = 0) AS zero_days, count(*) FILTER (revenue < 0) AS negative_days
FROM x_daily GROUP BY 1""")
def _(shop):
    return E.target_distribution(C.daily(shop).withColumn("year", F.year("date")), keys=["year"])


@query("D21_growth_illusion", "period:i sessions_index:d revenue_index:d orders_index:d aov_index:d", """
WITH w AS (SELECT week(date) AS period, sum(sessions) AS s, sum(revenue) AS r, sum(orders) AS o FROM x_web_daily GROUP BY 1),
     b AS (SELECT * FROM w WHERE period = 1)
SELECT w.period, 100.0 * w.s / b.s AS sessions_index, 100.0 * w.r / b.r AS revenue_index, 100.0 * w.o / b.o AS orders_index,
       100.0 * (w.r / w.o) / (b.r / b.o) AS aov_index FROM w, b""")
def _(shop):
    web = C.web_daily(shop)
    return E.growth_illusion(shop.traffic, web.select("date", "revenue", "orders"), 1, "week")


@query("D119_breakouts", "date:t pct_above_max:d pct_below_min:d large_high:b large_low:b", f"""
WITH r AS (SELECT date, revenue, {roll_sql("revenue", "max", 30, 15, 1)} AS hi, {roll_sql("revenue", "min", 30, 15, 1)} AS lo FROM x_daily),
     p AS (SELECT *, CASE WHEN abs(hi) >= 1e-9 THEN (revenue - hi) / abs(hi) * 100 END AS pct_above_max,
                  CASE WHEN abs(lo) >= 1e-9 THEN (revenue - lo) / abs(lo) * 100 END AS pct_below_min FROM r WHERE hi IS NOT NULL)
SELECT *, coalesce(pct_above_max >= 10, false) AS large_high, coalesce(pct_below_min <= -10, false) AS large_low FROM p
WHERE revenue > hi OR revenue < lo""")
def _(shop):
    return N.breakouts(C.daily(shop)).where("new_high OR new_low")


@query("D119b_breakout_summary", "valid_days:i new_high:i new_low:i large_high:i large_low:i", f"""
WITH r AS (SELECT revenue, {roll_sql("revenue", "max", 30, 15, 1)} AS hi, {roll_sql("revenue", "min", 30, 15, 1)} AS lo FROM x_daily)
SELECT count(*) AS valid_days, count(*) FILTER (revenue > hi) AS new_high, count(*) FILTER (revenue < lo) AS new_low,
       count(*) FILTER (abs(hi) >= 1e-9 AND (revenue - hi) / abs(hi) * 100 >= 10) AS large_high,
       count(*) FILTER (abs(lo) >= 1e-9 AND (revenue - lo) / abs(lo) * 100 <= -10) AS large_low FROM r WHERE hi IS NOT NULL""")
def _(shop):
    return N.breakout_summary(N.breakouts(C.daily(shop)))


@query("D120_spike_overlap", "category:s count:i", """
SELECT 'same_day' AS category, count(*) AS count FROM x_web_spikes WHERE date IN (SELECT date FROM x_revenue_spikes)
UNION ALL SELECT 'b_after_a', count(*) FROM x_web_spikes a, x_revenue_spikes b WHERE b.date - a.date BETWEEN 1 AND 7
UNION ALL SELECT 'b_without_a', count(*) FROM x_revenue_spikes WHERE date NOT IN (SELECT date FROM x_web_spikes)
UNION ALL SELECT 'a_without_b', count(*) FROM x_web_spikes WHERE date NOT IN (SELECT date FROM x_revenue_spikes)""")
def _(shop):
    web = C.web_daily(shop)
    return N.spike_overlap(N.spikes(web, "sessions"), N.spikes(web, "revenue"))


@query("D121_anomaly_features", "date:t is_spike_lag:b is_drop_lag:b is_anomaly_lag:b rolling_z_lag:d rolling_high_lag:b rolling_low_lag:b", """
SELECT date, coalesce(lag(gh) OVER w, false) AS is_spike_lag, coalesce(lag(gl) OVER w, false) AS is_drop_lag,
       coalesce(lag(gh OR gl) OVER w, false) AS is_anomaly_lag, lag(z_30) OVER w AS rolling_z_lag,
       coalesce(lag(z_30 >= 2.5) OVER w, false) AS rolling_high_lag, coalesce(lag(z_30 <= -2.5) OVER w, false) AS rolling_low_lag
FROM x_anomalies WINDOW w AS (ORDER BY date)""")
def _(shop):
    return N.anomaly_features(C.daily(shop))
