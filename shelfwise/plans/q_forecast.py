"""Forecast, backtest, report and file queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.operators import backtest as B
from shelfwise.operators import forecast as M
from shelfwise.operators import quality as Q
from shelfwise.operators import recursion as R
from shelfwise.operators import report as V
from shelfwise.operators import seasonality as E
from shelfwise.operators import traffic as W
from shelfwise.operators.concentration import quadrants
from shelfwise.plans import common as C
from shelfwise.plans.q_assortment import TRADEOFF, tradeoff
from shelfwise.plans.q_series import roll_sql
from shelfwise.plans.registry import query, view
from shelfwise.sources import catalog, sinks
from shelfwise.sources.session import checkpointed, scratch_folder

FOLDS = [
    ("A", "1997-12-31", "1998-01-01", "1999-06-30"),
    ("B", "1998-12-31", "1999-01-01", "2000-06-30"),
    ("C", "1999-12-31", "2000-01-01", "2001-06-30"),
    ("D", "2000-12-31", "2001-01-01", "2001-07-30"),
]
CUT = "2000-12-31"  # last day of training for the single-split queries


def history(shop):
    """Daily history, stored once per shop: one row per calendar day that many steps read."""
    if "history" not in vars(shop):
        shop.history = checkpointed(M.load_history(shop.sales))
    return shop.history


def train(shop):
    return M.until(history(shop), CUT)


def future(shop):
    return history(shop).where(F.col("date") > F.lit(CUT).cast("date"))


view("x_history", """
WITH r AS (SELECT date, revenue, cogs, orders, revenue / nullif(orders, 0) AS a, cogs / nullif(revenue, 0) AS c FROM x_daily)
SELECT date, revenue, cogs, orders, coalesce(last_value(a IGNORE NULLS) OVER b, first_value(a IGNORE NULLS) OVER f) AS aov,
       coalesce(last_value(c IGNORE NULLS) OVER b, first_value(c IGNORE NULLS) OVER f) AS cogs_ratio FROM r
WINDOW b AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       f AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
""")
view("x_train", f"SELECT * FROM x_history WHERE date <= DATE '{CUT}'")
view("x_future", f"SELECT * FROM x_history WHERE date > DATE '{CUT}'")


@query("F01_load_history", "date:t revenue:d cogs:d orders:i aov:e cogs_ratio:e", "SELECT * FROM x_history")
def _(shop):
    return M.load_history(shop.sales)


view("x_growth", """
WITH y AS (SELECT year(date) AS year, avg(revenue) AS r, avg(cogs) AS c, avg(orders) AS o FROM x_train GROUP BY 1),
     g AS (SELECT year, r / lag(r) OVER (ORDER BY year) - 1 AS r, c / lag(c) OVER (ORDER BY year) - 1 AS c, o / lag(o) OVER (ORDER BY year) - 1 AS o FROM y)
SELECT least(greatest(exp(avg(ln(1 + r)) FILTER (year >= 1996)), 0.95), 1.25) AS revenue,
       least(greatest(exp(avg(ln(1 + c)) FILTER (year >= 1996)), 0.95), 1.25) AS cogs,
       least(greatest(exp(avg(ln(1 + o)) FILTER (year >= 1996)), 0.95), 1.25) AS orders FROM g
""")
THREE = ["revenue", "cogs", "orders"]


@query("F02_annual_growth", "revenue:d cogs:d orders:d", "SELECT * FROM x_growth")
def _(shop):
    return M.annual_growth(train(shop), THREE, since=1996, carry=0.0)


@query("F02b_growth_carried", "revenue:d cogs:d orders:d", """
WITH y AS (SELECT year(date) AS year, avg(revenue) AS r, avg(cogs) AS c, avg(orders) AS o FROM x_train GROUP BY 1),
     g AS (SELECT year, r / lag(r) OVER (ORDER BY year) - 1 AS r, c / lag(c) OVER (ORDER BY year) - 1 AS c, o / lag(o) OVER (ORDER BY year) - 1 AS o FROM y),
     l AS (SELECT * FROM g WHERE year = 2000), k AS (SELECT * FROM x_growth)
SELECT least(greatest(CASE WHEN l.r > 0 THEN 1 + 0.5 * 1.2 * l.r ELSE k.revenue END, 0.95), 1.25) AS revenue,
       least(greatest(CASE WHEN l.c > 0 THEN 1 + 0.5 * l.c ELSE k.cogs END, 0.95), 1.25) AS cogs,
       least(greatest(CASE WHEN l.o > 0 THEN 1 + 0.5 * l.o ELSE k.orders END, 0.95), 1.25) AS orders FROM l, k""")
def _(shop):
    return M.annual_growth(train(shop), THREE, since=1996, carry=0.5, boost={"revenue": 1.2})


@query("F02c_growth_default", "revenue:d cogs:d orders:d aov:d cogs_ratio:d", """
WITH y AS (SELECT year(date) AS year, avg(revenue) AS r, avg(cogs) AS c, avg(orders) AS o, avg(aov) AS a, avg(cogs_ratio) AS q FROM x_train GROUP BY 1),
     g AS (SELECT year, r / lag(r) OVER w - 1 AS r, c / lag(c) OVER w - 1 AS c, o / lag(o) OVER w - 1 AS o, a / lag(a) OVER w - 1 AS a, q / lag(q) OVER w - 1 AS q
           FROM y WINDOW w AS (ORDER BY year)),
     l AS (SELECT * FROM g WHERE year = 2000),
     k AS (SELECT *, (SELECT exp(avg(ln(1 + a))) FROM g WHERE year >= 1996) AS aov, (SELECT exp(avg(ln(1 + q))) FROM g WHERE year >= 1996) AS cogs_ratio FROM x_growth)
SELECT least(greatest(CASE WHEN l.r > 0 THEN 1 + l.r ELSE k.revenue END, 0.95), 1.25) AS revenue,
       least(greatest(CASE WHEN l.c > 0 THEN 1 + l.c ELSE k.cogs END, 0.95), 1.25) AS cogs,
       least(greatest(CASE WHEN l.o > 0 THEN 1 + l.o * 1.25 ELSE k.orders END, 0.95), 1.25) AS orders,
       least(greatest(CASE WHEN l.a > 0 THEN 1 + l.a * 1.35 ELSE k.aov END, 0.95), 1.25) AS aov,
       least(greatest(k.cogs_ratio, 0.95), 1.25) AS cogs_ratio FROM l, k""")
def _(shop):
    return M.annual_growth(train(shop), since=1996)


view("x_profile", """
WITH n AS (SELECT date, revenue / avg(revenue) OVER (PARTITION BY year(date)) AS r, cogs / avg(cogs) OVER (PARTITION BY year(date)) AS c,
                  orders / avg(orders) OVER (PARTITION BY year(date)) AS o FROM x_train)
SELECT month(date) AS month, day(date) AS day, avg(r) AS revenue_profile, avg(c) AS cogs_profile, avg(o) AS orders_profile FROM n GROUP BY 1, 2
""")


@query("F03_seasonal_profile", "month:i day:i revenue_profile:d cogs_profile:d orders_profile:d", "SELECT * FROM x_profile")
def _(shop):
    return M.seasonal_profile(train(shop), THREE)


view("x_baseline", """
WITH l AS (SELECT avg(revenue) AS r, avg(cogs) AS c, avg(orders) AS o FROM x_train WHERE year(date) = 2000)
SELECT f.date, l.r * pow(g.revenue, year(f.date) - 2000) * coalesce(revenue_profile, 1) AS revenue_seasonal_base,
       l.c * pow(g.cogs, year(f.date) - 2000) * coalesce(cogs_profile, 1) AS cogs_seasonal_base,
       l.o * pow(g.orders, year(f.date) - 2000) * coalesce(orders_profile, 1) AS orders_seasonal_base
FROM x_future f LEFT JOIN x_profile p ON p.month = month(f.date) AND p.day = day(f.date), l, x_growth g
""")


@query("F04_seasonal_baseline", "date:t revenue_seasonal_base:d cogs_seasonal_base:d orders_seasonal_base:d", "SELECT * FROM x_baseline")
def _(shop):
    growth = M.annual_growth(train(shop), THREE, since=1996, carry=0.0)
    return M.seasonal_baseline(train(shop), future(shop).select("date"), growth, THREE)


@query("F05_reference_features", "date:t revenue_seasonal_base:d revenue_seasonal_base_log:d revenue_month_avg:d revenue_quarter_avg:d orders_weekday_avg:d", """
SELECT b.date, revenue_seasonal_base, ln(1 + revenue_seasonal_base) AS revenue_seasonal_base_log, m.v AS revenue_month_avg, q.v AS revenue_quarter_avg, w.v AS orders_weekday_avg
FROM x_baseline b LEFT JOIN (SELECT month(date) AS k, avg(revenue) AS v FROM x_train GROUP BY 1) m ON m.k = month(b.date)
LEFT JOIN (SELECT quarter(date) AS k, avg(revenue) AS v FROM x_train GROUP BY 1) q ON q.k = quarter(b.date)
LEFT JOIN (SELECT isodow(date) AS k, avg(orders) AS v FROM x_train GROUP BY 1) w ON w.k = isodow(b.date)""")
def _(shop):
    growth = M.annual_growth(train(shop), THREE, since=1996, carry=0.0)
    return M.reference_features(train(shop), future(shop).select("date"), growth, THREE)


GROWN = ["revenue", "cogs", "orders", "aov", "cogs_ratio"]
view("x_growth_default", """
WITH y AS (SELECT year(date) AS year, avg(revenue) AS r, avg(cogs) AS c, avg(orders) AS o, avg(aov) AS a, avg(cogs_ratio) AS q FROM x_train GROUP BY 1),
     g AS (SELECT year, r / lag(r) OVER w - 1 AS r, c / lag(c) OVER w - 1 AS c, o / lag(o) OVER w - 1 AS o, a / lag(a) OVER w - 1 AS a, q / lag(q) OVER w - 1 AS q
           FROM y WINDOW w AS (ORDER BY year)),
     l AS (SELECT * FROM g WHERE year = 2000),
     k AS (SELECT exp(avg(ln(1 + r))) AS r, exp(avg(ln(1 + c))) AS c, exp(avg(ln(1 + o))) AS o, exp(avg(ln(1 + a))) AS a, exp(avg(ln(1 + q))) AS q FROM g WHERE year >= 1996)
SELECT least(greatest(CASE WHEN l.r > 0 THEN 1 + l.r ELSE k.r END, 0.95), 1.25) AS revenue,
       least(greatest(CASE WHEN l.c > 0 THEN 1 + l.c ELSE k.c END, 0.95), 1.25) AS cogs,
       least(greatest(CASE WHEN l.o > 0 THEN 1 + l.o * 1.25 ELSE k.o END, 0.95), 1.25) AS orders,
       least(greatest(CASE WHEN l.a > 0 THEN 1 + l.a * 1.35 ELSE k.a END, 0.95), 1.25) AS aov,
       least(greatest(k.q, 0.95), 1.25) AS cogs_ratio FROM l, k
""")
view("x_normed", "SELECT month(date) AS month, day(date) AS day, " + ", ".join(
    f"{c} / avg({c}) OVER (PARTITION BY year(date)) AS {c}" for c in GROWN) + " FROM x_train")
view("x_profile_default", "SELECT month, day, " + ", ".join(f"avg({c}) AS {c}" for c in GROWN) + " FROM x_normed GROUP BY 1, 2")
view("x_level_default", "SELECT " + ", ".join(f"avg({c}) AS {c}" for c in GROWN) + " FROM x_train WHERE year(date) = 2000")
view("x_baseline_default", "SELECT f.date, " + ", ".join(
    f"l.{c} * pow(g.{c}, year(f.date) - 2000) * coalesce(p.{c}, 1) AS {c}_seasonal_base" for c in GROWN)
    + " FROM x_history f LEFT JOIN x_profile_default p ON p.month = month(f.date) AND p.day = day(f.date), x_level_default l, x_growth_default g")


@query("F04b_baseline_default", "date:t " + " ".join(f"{c}_seasonal_base:d" for c in GROWN),
       "SELECT * FROM x_baseline_default WHERE date > DATE '2000-12-31'")
def _(shop):
    """All five columns under the growth rule that forecasts use."""
    growth = M.annual_growth(train(shop), since=1996)
    return M.seasonal_baseline(train(shop), future(shop).select("date"), growth)


@query("F05b_references_default", "date:t " + " ".join(f"{c}_seasonal_base:d {c}_seasonal_base_log:e {c}_month_avg:d {c}_quarter_avg:d {c}_weekday_avg:d" for c in GROWN),
       "SELECT b.date, " + ", ".join(
           f"{c}_seasonal_base, ln(1 + {c}_seasonal_base) AS {c}_seasonal_base_log, m.{c} AS {c}_month_avg, q.{c} AS {c}_quarter_avg, w.{c} AS {c}_weekday_avg" for c in GROWN)
       + " FROM x_baseline_default b" + "".join(
           f" LEFT JOIN (SELECT {f}(date) AS k, {', '.join(f'avg({c}) AS {c}' for c in GROWN)} FROM x_train GROUP BY 1) {a} ON {a}.k = {f}(b.date)"
           for a, f in (("m", "month"), ("q", "quarter"), ("w", "isodow")))
       + " WHERE b.date > DATE '2000-12-31'")
def _(shop):
    growth = M.annual_growth(train(shop), since=1996)
    return M.reference_features(train(shop), future(shop).select("date"), growth)


def history_sql(c: str) -> str:
    """All history features of one column."""
    out = [f"lag({c}, {k}) OVER (ORDER BY date) AS {c}_lag_{k}" for k in M.LAGS]
    known = [f"lag({c}, {k}) OVER (ORDER BY date)" for k in (364, 365, 366)]
    out.append(f"({' + '.join(f'coalesce({x}, 0)' for x in known)}) / nullif({' + '.join(f'({x} IS NOT NULL)::INT' for x in known)}, 0) AS {c}_yoy_lag_mean")
    for w in M.WINDOWS:
        out += [f"{roll_sql(c, kind, w, M.least_values(w), 1)} AS {c}_roll_{kind}_{w}" for kind in ("mean", "std")]
    return ", ".join(out)


HISTORY = [n for c in GROWN for n in [*[f"{c}_lag_{k}" for k in M.LAGS], f"{c}_yoy_lag_mean", *[f"{c}_roll_{k}_{w}" for w in M.WINDOWS for k in ("mean", "std")]]]


@query("F06b_all_history_features", "date:t " + " ".join(f"{n}:d" for n in HISTORY), f"SELECT date, {', '.join(map(history_sql, GROWN))} FROM x_history")
def _(shop):
    """Every lag and rolling feature of the five columns."""
    return M.history_features(history(shop))


view("x_revenue_matrix", f"SELECT t.date, t.revenue AS target, {', '.join(M.FEATURES['revenue'])} FROM x_train t JOIN x_baseline_default USING (date) JOIN (SELECT date, "
     + ", ".join(map(history_sql, GROWN)) + " FROM x_train) h USING (date)")


@query("F07b_default_matrix", "date:t target:d " + " ".join(f"{n}:d" for n in M.FEATURES["revenue"]), "SELECT * FROM x_revenue_matrix")
def _(shop):
    """All features on the revenue model's list, under the growth rule that forecasts use."""
    rows = train(shop)
    return M.feature_matrix(rows, M.annual_growth(rows, since=1996), "revenue")


@query("F06_history_features", "date:t revenue_lag_1:d orders_lag_366:i revenue_yoy_lag_mean:d revenue_roll_mean_30:d orders_roll_std_7:d cogs_roll_mean_365:d", f"""
WITH l AS (SELECT *, lag(revenue, 364) OVER w AS a, lag(revenue, 365) OVER w AS b, lag(revenue, 366) OVER w AS c FROM x_history WINDOW w AS (ORDER BY date))
SELECT date, lag(revenue, 1) OVER (ORDER BY date) AS revenue_lag_1, lag(orders, 366) OVER (ORDER BY date) AS orders_lag_366,
       (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0) AS revenue_yoy_lag_mean,
       {roll_sql("revenue", "mean", 30, 10, 1)} AS revenue_roll_mean_30, {roll_sql("orders", "std", 7, 2, 1)} AS orders_roll_std_7,
       {roll_sql("cogs", "mean", 365, 30, 1)} AS cogs_roll_mean_365 FROM l""")
def _(shop):
    return M.history_features(history(shop), THREE)


@query("F07_feature_matrix", "date:t target:d revenue_lag_1:d aov_lag_1:e orders_lag_7:i orders_roll_std_7:d", f"""
SELECT date, revenue AS target, lag(revenue, 1) OVER (ORDER BY date) AS revenue_lag_1, lag(aov, 1) OVER (ORDER BY date) AS aov_lag_1,
       lag(orders, 7) OVER (ORDER BY date) AS orders_lag_7, {roll_sql("orders", "std", 7, 2, 1)} AS orders_roll_std_7 FROM x_train""")
def _(shop):
    rows = train(shop)
    return M.feature_matrix(rows, M.annual_growth(rows, since=1996, carry=0.0), "revenue")


def forecast_parts(shop):
    """Features of the training days, and the days after them with their seasonal bases."""
    features, growth = R.known_features(train(shop), since=1996)
    return checkpointed(features), R.coming_days(train(shop), future(shop), growth)


def chosen_weights(shop):
    """The shares of the direct models that did best over the folds."""
    table = model_preds(shop)
    revenue = B.blend_weights(table)
    cogs = B.blend_weights_of(table, "actual_cogs", "pred_cogs_direct", "pred_cogs_component")
    return B.best_weight(revenue), B.best_weight(cogs)


@query("F08_recursive_forecast", "date:t revenue:d cogs:d orders:d aov:d")
def _(shop):
    """By boosted trees, blended with the weights that did best in the backtests."""
    features, bases = forecast_parts(shop)
    models = {"all": R.fit_trees(features)}
    return R.recursive_forecast(train(shop), bases, models, {"blend": chosen_weights(shop)})


def category_history(shop):
    """Daily history of every category."""
    baskets = shop.lines.groupBy("category", F.col("order_date").alias("date"), "order_id").agg(
        F.sum("revenue").alias("revenue"), F.sum("cost").alias("cogs")
    )
    days = baskets.groupBy("category", "date").agg(
        F.sum("revenue").alias("revenue"), F.sum("cogs").alias("cogs"), F.count("*").alias("orders")
    )
    return checkpointed(M.load_history(days, ["category"]))


def category_forecast(shop):
    """Recursive forecasts of all categories by linear models fitted at once, with what they rest on."""
    rows = category_history(shop)
    known, ahead = M.until(rows, CUT), rows.where(F.col("date") > F.lit(CUT).cast("date"))
    features, growth = R.known_features(known, ["category"], since=1996)
    fitted = checkpointed(R.fit_linear(R.training_rows(features, ["category"]), ["category"]))
    bases = R.coming_days(known, ahead, growth, ["category"])
    found = R.recursive_forecast(known, bases, R.linear_models(fitted, ["category"]), {"blend": (0.5, 0.5)}, ["category"])
    return rows, fitted, found


@query("F08b_category_forecast", "category:s date:t revenue:d cogs:d orders:d")
def _(shop):
    return category_forecast(shop)[2].withColumnRenamed("series", "category")


@query("F08c_category_checks", "category:s days:i first_date:t last_date:t known:b first_day:b", """
WITH b AS (SELECT category, order_date, order_id FROM x_lines GROUP BY 1, 2, 3),
     s AS (SELECT category, min(order_date) AS a, max(order_date) AS z FROM b GROUP BY 1)
SELECT category, z - DATE '2000-12-31' AS days, DATE '2001-01-01' AS first_date, z AS last_date, true AS known, true AS first_day FROM s""")
def _(shop):
    """Every day once, nothing unknown or negative, and the first day as the models give it from the known values."""
    rows, fitted, found = category_forecast(shop)
    start = F.date_add(F.lit(CUT).cast("date"), 1)
    known = M.until(rows, CUT)
    growth = M.annual_growth(known, since=1996, keys=["category"])
    day = M.history_features(rows, series=["category"]).where(F.col("date") == start).drop(*M.SERIES)
    day = day.join(R.coming_days(known, day, growth, ["category"]), ["category", "date"])
    blank = day.withColumns({c: F.lit(0.0) for c in M.SERIES})  # only the features count
    fit = F.aggregate(F.zip_with("x", "weights", lambda a, b: a * b), F.col("intercept"), lambda a, b: a + b)
    value = F.greatest(F.expm1(fit), F.lit(0.0))
    direct = R.training_rows(blank, ["category"]).join(fitted, ["category", "model"]).groupBy("category").pivot("model", M.SERIES).agg(F.first(value))
    want = direct.select("category", (0.5 * F.col("revenue") + 0.5 * F.col("orders") * F.col("aov")).alias("want"))
    rest = found.withColumnRenamed("series", "category").join(want, "category")
    off = F.abs(F.col("revenue") - F.col("want")) > 1e-6 * (1 + F.abs("want"))
    good = F.greatest(*M.SERIES).isNotNull() & (F.least(*M.SERIES) >= 0) & ~F.isnan(F.least(*M.SERIES))
    return rest.groupBy("category").agg(
        F.count("*").alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.bool_and(good).alias("known"), (F.count_if((F.col("date") == start) & off) == 0).alias("first_day"),
    )


def tree_predictions(shop):
    """Days after the cut only, each from the values known the day before and references of the training days."""
    rows = train(shop)
    growth = M.annual_growth(rows, since=1996)
    table = checkpointed(M.feature_matrix(history(shop), growth, "revenue", known=rows))
    seen = F.col("date") <= F.lit(CUT).cast("date")
    model = M.fit_gbt(table.where(seen), M.FEATURES["revenue"])
    return M.predict(model, table.where(~seen), M.FEATURES["revenue"])


def tree_importance(shop):
    """The importance of every feature of the revenue model, and its training rows."""
    rows = train(shop)
    table = checkpointed(M.feature_matrix(rows, M.annual_growth(rows, since=1996, carry=0.0), "revenue"))
    model = M.fit_gbt(table, M.FEATURES["revenue"])
    return M.feature_importance(model, M.FEATURES["revenue"], shop.spark), table


@query("F09_gbt_predictions", "date:t target:d predicted:d")
def _(shop):
    return tree_predictions(shop)


@query("F09b_gbt_checks", "days:i first_date:t last_date:t target_mean:d valid:b", """
SELECT count(*) AS days, min(date) AS first_date, max(date) AS last_date, avg(revenue) AS target_mean, true AS valid FROM x_future""")
def _(shop):
    """Every later day once, with a known prediction that isn't negative."""
    found = tree_predictions(shop)
    valid = F.col("predicted").isNotNull() & ~F.isnan("predicted") & (F.col("predicted") >= 0)
    return found.agg(
        F.count_distinct("date").alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.avg("target").alias("target_mean"), F.bool_and(valid).alias("valid"),
    )


@query("F10_feature_importance", "feature:s importance:d")
def _(shop):
    return tree_importance(shop)[0]


@query("F10b_importance_checks", "feature:s known:i total:d allowed:b", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS known, 1.0 AS total, true AS allowed FROM x_revenue_matrix" for c in M.FEATURES["revenue"]))
def _(shop):
    """Per feature the days that know it; importances add up to one, and what never varies has none."""
    found, table = tree_importance(shop)
    names = M.FEATURES["revenue"]
    spread = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.count(c).alias("known"), (F.count_distinct(F.coalesce(c, F.lit(M.MISSING))) > 1).alias("varies")) for c in names
    ])
    seen = table.agg(spread.alias("_f")).select(F.inline("_f"))
    allowed = (F.col("importance") >= 0) & ((F.col("importance") == 0) | F.col("varies"))
    total = found.agg(F.sum("importance")).scalar()
    return found.join(seen, "feature").select("feature", "known", total.alias("total"), allowed.alias("allowed"))


# --- backtests ------------------------------------------------------------------

view("x_folds", "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', DATE '{e}', DATE '{a}', DATE '{b}')" for n, e, a, b in FOLDS) + ") f(fold, train_end, val_start, val_end)")
NAIVE = """
SELECT t.fold, t.date, coalesce((coalesce(a.v, 0) + coalesce(b.v, 0) + coalesce(c.v, 0)) /
         nullif((a.v IS NOT NULL)::INT + (b.v IS NOT NULL)::INT + (c.v IS NOT NULL)::INT, 0), m.v) AS v
FROM {todo} t LEFT JOIN {state} a ON a.fold = t.fold AND a.date = t.date - 364 LEFT JOIN {state} b ON b.fold = t.fold AND b.date = t.date - 365
LEFT JOIN {state} c ON c.fold = t.fold AND c.date = t.date - 366 LEFT JOIN x_fold_months m ON m.fold = t.fold AND m.k = month(t.date)"""
view("x_fold_train", "SELECT fold, date, revenue AS v FROM x_history, x_folds WHERE date <= train_end")
view("x_fold_months", "SELECT fold, month(date) AS k, avg(v) AS v FROM x_fold_train GROUP BY 1, 2")
view("x_naive1", NAIVE.format(
    todo="(SELECT fold, date FROM x_history, x_folds WHERE date BETWEEN val_start AND val_end AND date - train_end <= 364)", state="x_fold_train"))
view("x_state", "SELECT * FROM x_fold_train UNION ALL SELECT * FROM x_naive1")
view("x_naive", "SELECT * FROM x_naive1 UNION ALL " + NAIVE.format(
    todo="(SELECT fold, date FROM x_history, x_folds WHERE date BETWEEN val_start AND val_end AND date - train_end > 364)", state="x_state"))
view("x_preds", """
WITH m AS (SELECT fold, month(date) AS k, avg(orders) AS pred_orders, avg(aov) AS pred_aov FROM x_history, x_folds WHERE date <= train_end GROUP BY 1, 2),
     c AS (SELECT fold, sum(cogs) / sum(revenue) AS pred_cogs_ratio FROM x_history, x_folds WHERE date <= train_end GROUP BY 1),
     p AS (SELECT f.fold, h.date, h.date - f.val_start + 1 AS horizon_day, revenue AS actual_revenue, cogs AS actual_cogs, n.v AS pred_direct,
                  pred_orders * pred_aov AS pred_component, pred_orders, pred_aov, pred_cogs_ratio
           FROM x_history h JOIN x_folds f ON h.date BETWEEN f.val_start AND f.val_end JOIN x_naive n ON n.fold = f.fold AND n.date = h.date
           JOIN m ON m.fold = f.fold AND m.k = month(h.date) JOIN c ON c.fold = f.fold)
SELECT *, (pred_direct + pred_component) / 2 AS pred_current, (pred_direct + pred_component) / 2 * pred_cogs_ratio AS pred_cogs FROM p
""")


def preds(shop):
    """Fold predictions of the baselines, stored once per shop: every grid point reads them."""
    if "fold_table" not in vars(shop):
        shop.fold_table = checkpointed(B.fold_predictions(history(shop), FOLDS))
    return shop.fold_table


def model_preds(shop):
    """Fold predictions of fitted models, stored once per shop."""
    if "model_table" not in vars(shop):
        shop.model_table = checkpointed(B.model_predictions(history(shop), FOLDS, since=1996))
    return shop.model_table


@query("F11_seasonal_naive", "fold:s date:t revenue_naive:d", "SELECT fold, date, v AS revenue_naive FROM x_naive")
def _(shop):
    rows = B.rolling_origin(history(shop), FOLDS)
    return M.seasonal_naive(
        rows.where("role = 'train'"), rows.where("role = 'validate'"), "revenue", 732, ["fold"]
    )


def metric_sql(actual: str, pred: str) -> str:
    return f"""count(*) AS n, avg(abs({pred} - {actual})) AS mae, sqrt(avg(pow({pred} - {actual}, 2))) AS rmse,
       1 - sum(pow({pred} - {actual}, 2)) / nullif(var_pop({actual}) * count(*), 0) AS r2,
       avg(abs({pred} - {actual}) / nullif(abs({actual}), 0)) * 100 AS mape,
       avg(2 * abs({pred} - {actual}) / nullif(abs({actual}) + abs({pred}), 0)) * 100 AS smape,
       avg({pred} - {actual}) AS bias, avg({pred}) / avg({actual}) AS mean_ratio"""


METRICS = "n:i mae:d rmse:d r2:d mape:d smape:d bias:d mean_ratio:d"


@query("F12_forecast_metrics", f"target:s {METRICS}", f"""
SELECT 'revenue' AS target, {metric_sql("revenue", "revenue_seasonal_base")} FROM x_baseline JOIN x_future USING (date)
UNION ALL SELECT 'cogs', {metric_sql("cogs", "cogs_seasonal_base")} FROM x_baseline JOIN x_future USING (date)""")
def _(shop):
    growth = M.annual_growth(train(shop), THREE, since=1996, carry=0.0)
    base = M.seasonal_baseline(train(shop), future(shop), growth, THREE)
    return Q.union_all(
        [
            B.forecast_metrics(base, t, f"{t}_seasonal_base").withColumn("target", F.lit(t))
            for t in ("revenue", "cogs")
        ]
    )


@query("F13_rolling_origin", "fold:s role:s days:i first_date:t last_date:t last_step:i", """
SELECT fold, CASE WHEN date <= train_end THEN 'train' ELSE 'validate' END AS role, count(*) AS days, min(date) AS first_date, max(date) AS last_date,
       max(CASE WHEN date > train_end THEN date - val_start + 1 END) AS last_step
FROM x_history, x_folds WHERE date <= train_end OR date BETWEEN val_start AND val_end GROUP BY 1, 2""")
def _(shop):
    return B.rolling_origin(history(shop), FOLDS).groupBy("fold", "role").agg(
        F.count("*").alias("days"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.max("horizon_day").alias("last_step"),
    )


@query("F13b_fold_predictions", "fold:s date:t horizon_day:i actual_revenue:d pred_direct:d pred_component:d pred_current:d pred_cogs:d", "SELECT * FROM x_preds")
def _(shop):
    return preds(shop)


@query("F14_bias_table", "fold:s target:s actual_mean:d prediction_mean:d actual_median:d prediction_median:d bias:d mean_ratio:d volatility_ratio:d", """
SELECT fold, 'revenue' AS target, avg(actual_revenue) AS actual_mean, avg(pred_current) AS prediction_mean, quantile_cont(actual_revenue, 0.5) AS actual_median,
       quantile_cont(pred_current, 0.5) AS prediction_median, avg(pred_current - actual_revenue) AS bias, avg(pred_current) / avg(actual_revenue) AS mean_ratio,
       stddev_samp(pred_current) / stddev_samp(actual_revenue) AS volatility_ratio FROM x_preds GROUP BY 1
UNION ALL SELECT fold, 'cogs', avg(actual_cogs), avg(pred_cogs), quantile_cont(actual_cogs, 0.5), quantile_cont(pred_cogs, 0.5), avg(pred_cogs - actual_cogs),
       avg(pred_cogs) / avg(actual_cogs), stddev_samp(pred_cogs) / stddev_samp(actual_cogs) FROM x_preds GROUP BY 1""")
def _(shop):
    targets = {"revenue": ("actual_revenue", "pred_current"), "cogs": ("actual_cogs", "pred_cogs")}
    return B.bias_table(preds(shop), targets)


@query("F15_metrics_by_horizon", f"fold:s band:s {METRICS}", f"""
SELECT fold, CASE WHEN horizon_day <= 30 THEN 'days_1_30' WHEN horizon_day <= 90 THEN 'days_31_90' WHEN horizon_day <= 180 THEN 'days_91_180'
                  WHEN horizon_day <= 365 THEN 'days_181_365' ELSE 'days_366_plus' END AS band, {metric_sql("actual_revenue", "pred_current")} FROM x_preds GROUP BY 1, 2""")
def _(shop):
    return B.metrics_by_horizon(preds(shop), "actual_revenue", "pred_current")


@query("F15b_metrics_by_month", f"fold:s month:i {METRICS}", f"""
SELECT fold, month(date) AS month, {metric_sql("actual_revenue", "pred_current")} FROM x_preds GROUP BY 1, 2""")
def _(shop):
    return B.metrics_by_month(preds(shop), "actual_revenue", "pred_current")


# The calibration grids.
SCALES = [0.70, 0.725, 0.75, 0.775, 0.80, 0.825, 0.85, 0.875, 0.90, 0.925, 0.95, 0.975, 1.00, 1.025, 1.05]
YEAR1 = [0.75, 0.80, 0.85, 0.90, 0.95, 1.00, 1.05]
YEAR2 = [0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 1.00]
WEIGHTS = [k / 10 for k in range(11)]
WINDOWS = [14, 30, 60, 90]
RATES = [-0.25, -0.20, -0.15, -0.10, -0.05, 0.00, 0.05, 0.10, 0.15]
COGS_SCALES = [0.80, 0.85, 0.90, 0.95, 1.00, 1.05, 1.10]
COGS_CAPS = [None, 1.05, 1.10, 1.15, 1.20]


def values(name: str, numbers: list, kind: str = "DOUBLE") -> str:
    """The numbers as a one-column SQL table named like the column."""
    rows = ", ".join(f"({'NULL' if n is None else n}::{kind})" for n in numbers)
    return f'(VALUES {rows}) g_{name}("{name}")'


view("x_scale_grid", f"SELECT fold, scale, {metric_sql('actual_revenue', '(pred_current * scale)')} FROM x_preds, {values('scale', SCALES)} GROUP BY 1, 2")


@query("F16_global_scale", f"fold:s scale:d {METRICS}", "SELECT * FROM x_scale_grid")
def _(shop):
    return B.global_scale(preds(shop), SCALES)


@query("F16b_horizon_scale", f"fold:s year1:d year2:d {METRICS}", f"""
SELECT fold, year1, year2, {metric_sql("actual_revenue", "(pred_current * CASE WHEN horizon_day <= 365 THEN year1 ELSE year2 END)")}
FROM x_preds, {values("year1", YEAR1)}, {values("year2", YEAR2)} GROUP BY 1, 2, 3""")
def _(shop):
    return B.horizon_scale(preds(shop), YEAR1, YEAR2)


@query("F16c_ensemble", f"fold:s w:d scale:d {METRICS}", f"""
SELECT fold, w, scale, {metric_sql("actual_revenue", "((w * pred_direct + (1 - w) * pred_component) * scale)")}
FROM x_preds, {values("w", WEIGHTS)}, {values("scale", SCALES)} GROUP BY 1, 2, 3""")
def _(shop):
    return B.ensemble(preds(shop), WEIGHTS, SCALES)


view("x_levels", f"""
WITH k AS (SELECT * FROM {values("window", WINDOWS, "INT")}),
     r AS (SELECT fold, "window", avg(revenue) AS recent FROM x_history, x_folds, k WHERE date <= train_end AND train_end - date < "window" GROUP BY 1, 2),
     f AS (SELECT fold, avg(pred_current) AS first_mean FROM x_preds WHERE horizon_day <= 30 GROUP BY 1)
SELECT fold, "window", recent / first_mean AS multiplier FROM r JOIN f USING (fold)
""")


@query("F17_recent_level", f"fold:s window:i multiplier:d {METRICS}", f"""
SELECT fold, "window", multiplier, {metric_sql("actual_revenue", "(pred_current * multiplier)")} FROM x_preds JOIN x_levels USING (fold) GROUP BY 1, 2, 3""")
def _(shop):
    return B.recent_level(preds(shop), history(shop), FOLDS, WINDOWS)


@query("F18_growth_multiplier", f"fold:s growth:d {METRICS}", f"""
SELECT fold, growth, {metric_sql("actual_revenue", "(pred_current * pow(1 + growth, (horizon_day - 1) / 365.0::DOUBLE))")}
FROM x_preds, {values("growth", RATES)} GROUP BY 1, 2""")
def _(shop):
    return B.growth_multiplier(preds(shop), RATES)


@query("F19_seasonal_blend", f"fold:s alpha:d {METRICS}", f"""
SELECT p.fold, alpha, {metric_sql("actual_revenue", "(alpha * pred_current + (1 - alpha) * v)")}
FROM x_preds p JOIN x_naive n ON n.fold = p.fold AND n.date = p.date, {values("alpha", WEIGHTS)} GROUP BY 1, 2""")
def _(shop):
    table = preds(shop)
    naive = table.select("fold", "date", F.col("pred_direct").alias("revenue_naive"))
    return B.seasonal_blend(table, naive, WEIGHTS)


@query("F20_cogs_scale_cap", f"fold:s scale:d cap_name:s {METRICS} days_above_revenue:i max_share:d mean_share:d", f"""
WITH g AS (SELECT *, CASE WHEN cap IS NULL THEN pred_cogs * scale ELSE least(pred_cogs * scale, pred_current * cap) END AS c,
                  CASE WHEN cap IS NULL THEN 'no_cap' ELSE 'cap_' || printf('%.2f', cap) END AS cap_name
           FROM x_preds, {values("scale", COGS_SCALES)}, {values("cap", COGS_CAPS)})
SELECT fold, scale, cap_name, {metric_sql("actual_cogs", "c")}, count(*) FILTER (c > pred_current) AS days_above_revenue,
       max(c / pred_current) AS max_share, avg(c / pred_current) AS mean_share FROM g GROUP BY 1, 2, 3""")
def _(shop):
    return B.cogs_scale_cap(preds(shop), COGS_SCALES, COGS_CAPS)


SUMMARY = """avg(mae) AS all_mae, avg(rmse) AS all_rmse, avg(r2) AS all_r2, avg(bias) AS all_bias, avg(mean_ratio) AS all_mean_ratio,
       stddev_samp(mae) AS all_std_mae, avg(mae) FILTER (fold IN ('C', 'D')) AS recent_mae, avg(rmse) FILTER (fold IN ('C', 'D')) AS recent_rmse,
       stddev_samp(mae) FILTER (fold IN ('C', 'D')) AS recent_std_mae"""
view("x_scale_summary", f"SELECT scale, {SUMMARY} FROM x_scale_grid GROUP BY 1")
SUMMARY_COLUMNS = "all_mae:d all_rmse:d all_r2:d all_bias:d all_mean_ratio:d all_std_mae:d recent_mae:d recent_rmse:d recent_std_mae:d"


@query("F21_refined_grid", f"scale:d {SUMMARY_COLUMNS}", f"""
WITH b AS (SELECT scale AS best FROM x_scale_summary ORDER BY all_mae, all_std_mae, scale LIMIT 1),
     g AS (SELECT round(best + i / 100.0::DOUBLE, 2) AS scale FROM b, range(-5, 6) t(i)),
     d AS (SELECT fold, scale, {metric_sql("actual_revenue", "(pred_current * scale)")} FROM x_preds, g GROUP BY 1, 2)
SELECT scale, {SUMMARY} FROM d GROUP BY 1""")
def _(shop):
    return B.refined_scales(preds(shop), SCALES)


@query("F22_summarize_grid", f"scale:d {SUMMARY_COLUMNS}", "SELECT * FROM x_scale_summary")
def _(shop):
    return B.summarize_grid(B.global_scale(preds(shop), SCALES), ["scale"])


@query("F23_select_best", f"scale:d {SUMMARY_COLUMNS}", """
SELECT * FROM x_scale_summary WHERE all_mae <= 1.01 * (SELECT min(all_mae) FROM x_scale_summary) ORDER BY all_std_mae, all_mae, scale LIMIT 1""")
def _(shop):
    return B.select_best(B.summarize_grid(B.global_scale(preds(shop), SCALES), ["scale"]))


@query("F24_blend_weights", "w:d rmse:d is_best:b", """
WITH g AS (SELECT i / 10.0::DOUBLE AS w, sqrt(avg(pow(i / 10.0::DOUBLE * pred_direct + (1 - i / 10.0::DOUBLE) * pred_component - actual_revenue, 2))) AS rmse
           FROM x_preds, range(11) t(i) GROUP BY 1)
SELECT w, rmse, row_number() OVER (ORDER BY round(rmse, 6), w) = 1 AS is_best FROM g""")
def _(shop):
    return B.blend_weights(preds(shop))


STRATEGIES = [
    {"name": "current", "kind": "current"},
    {"name": "scaled", "kind": "scale", "scale": 0.9},
    {"name": "two_years", "kind": "horizon", "year1": 0.95, "year2": 0.9},
    {"name": "mixed", "kind": "ensemble_scale", "w": 0.3, "scale": 1.05},
    {"name": "growing", "kind": "growth", "growth": 0.05},
    {"name": "seasonal", "kind": "seasonal_blend", "alpha": 0.6},
]
view("x_strategies", " UNION ALL ".join(
    f"SELECT '{n}' AS revenue_strategy, fold, date, actual_revenue, actual_cogs, pred_cogs, {e} AS predicted FROM x_preds"
    for n, e in [
        ("current", "pred_current"),
        ("scaled", "pred_current * 0.9::DOUBLE"),
        ("two_years", "pred_current * CASE WHEN horizon_day <= 365 THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END"),
        ("mixed", "(0.3::DOUBLE * pred_direct + 0.7::DOUBLE * pred_component) * 1.05::DOUBLE"),
        ("growing", "pred_current * pow(1.05::DOUBLE, (horizon_day - 1) / 365.0::DOUBLE)"),
        ("seasonal", "0.6::DOUBLE * pred_current + 0.4::DOUBLE * pred_direct"),
    ]))


@query("F25_candidate_comparison", "revenue_strategy:s cogs_strategy:s revenue_mae_all:d revenue_r2_all:d revenue_mae_recent:d cogs_mae_all:d cogs_rmse_recent:d", """
WITH c AS (SELECT *, CASE k WHEN 'plain' THEN pred_cogs ELSE least(pred_cogs * 0.95::DOUBLE, predicted * 0.35::DOUBLE) END AS c, k AS cogs_strategy
           FROM x_strategies, (VALUES ('plain'), ('capped')) v(k)),
     f AS (SELECT revenue_strategy, cogs_strategy, fold, avg(abs(predicted - actual_revenue)) AS rm,
                  1 - sum(pow(predicted - actual_revenue, 2)) / (var_pop(actual_revenue) * count(*)) AS r2, avg(abs(c - actual_cogs)) AS cm,
                  sqrt(avg(pow(c - actual_cogs, 2))) AS cr FROM c GROUP BY 1, 2, 3)
SELECT revenue_strategy, cogs_strategy, avg(rm) AS revenue_mae_all, avg(r2) AS revenue_r2_all, avg(rm) FILTER (fold IN ('C', 'D')) AS revenue_mae_recent,
       avg(cm) AS cogs_mae_all, avg(cr) FILTER (fold IN ('C', 'D')) AS cogs_rmse_recent FROM f GROUP BY 1, 2""")
def _(shop):
    costs = [{"name": "plain"}, {"name": "capped", "scale": 0.95, "cap": 0.35}]
    return B.candidate_comparison(preds(shop), STRATEGIES, costs)


@query("F26_strategy_apply", "name:s fold:s date:t predicted:d", "SELECT revenue_strategy AS name, fold, date, predicted FROM x_strategies")
def _(shop):
    return B.strategy_apply(preds(shop), STRATEGIES)


# --- the same on predictions of fitted models: SQL has no part in the fits, so what must hold is checked --------------

@query("F13c_model_predictions", "fold:s date:t horizon_day:i actual_revenue:d actual_cogs:d pred_direct:d pred_component:d pred_current:d pred_cogs:d pred_orders:d pred_aov:d")
def _(shop):
    return model_preds(shop)


@query("F13d_model_checks", "fold:s days:i first_date:t last_date:t steps:i actual_revenue:d known:b first_day:b", """
SELECT fold, count(*) AS days, min(date) AS first_date, max(date) AS last_date, max(date - val_start + 1) AS steps, sum(revenue) AS actual_revenue,
       true AS known, true AS first_day FROM x_history JOIN x_folds ON date BETWEEN val_start AND val_end GROUP BY 1""")
def _(shop):
    """Every validation day once, nothing unknown or negative, and on the first day, when the three recursions still
    know the same, the blend is the mean of the others."""
    named = ["pred_direct", "pred_component", "pred_current", "pred_cogs", "pred_orders", "pred_aov", "pred_cogs_ratio"]
    mean = (F.col("pred_direct") + F.col("pred_component")) / 2
    off = F.abs(F.col("pred_current") - mean) > 1e-6 * (1 + mean)
    low = F.least(*[F.coalesce(c, F.lit(-1.0)) for c in named])
    return model_preds(shop).groupBy("fold").agg(
        F.count("*").alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max("horizon_day").alias("steps"),
        F.sum("actual_revenue").alias("actual_revenue"), F.bool_and((low >= 0) & ~F.isnan(low)).alias("known"),
        (F.count_if((F.col("horizon_day") == 1) & off) == 0).alias("first_day"),
    )


@query("F13e_model_optimum", "fold:s model:s rows:i optimal:b", f"""
SELECT fold, model, count(*) AS rows, true AS optimal FROM x_history JOIN x_folds ON date <= train_end,
       (VALUES {", ".join(f"('{m}')" for m in M.SERIES)}) m(model) GROUP BY 1, 2""")
def _(shop):
    """All models of all folds from one pass: at the optimum mean residual and penalised gradient are zero."""
    known = B.rolling_origin(history(shop), FOLDS).where("role = 'train'").drop("role", "horizon_day")
    features, _ = R.known_features(known, ["fold"], since=1996)
    rows = checkpointed(R.training_rows(features, ["fold"]))
    found = R.gradients(rows, R.fit_linear(rows, ["fold"]), ["fold"])
    best = (F.col("residual") < 1e-6) & (F.coalesce("gradient", F.lit(0.0)) < 1e-6)
    return found.withColumn("optimal", best)


def on_models(name, columns, build):
    """Register a calibration step over the models' predictions."""
    query(name, columns)(lambda shop: build(model_preds(shop), shop))


BOTH = {"revenue": ("actual_revenue", "pred_current"), "cogs": ("actual_cogs", "pred_cogs")}
on_models("F14m_bias", "fold:s target:s actual_mean:d prediction_mean:d bias:d mean_ratio:d volatility_ratio:d", lambda t, shop: B.bias_table(t, BOTH))
on_models("F15m_horizons", f"fold:s band:s {METRICS}", lambda t, shop: B.metrics_by_horizon(t, "actual_revenue", "pred_current"))
on_models("F15n_months", f"fold:s month:i {METRICS}", lambda t, shop: B.metrics_by_month(t, "actual_revenue", "pred_current"))
on_models("F16m_global_scale", f"fold:s scale:d {METRICS}", lambda t, shop: B.global_scale(t, SCALES))
on_models("F16n_horizon_scale", f"fold:s year1:d year2:d {METRICS}", lambda t, shop: B.horizon_scale(t, YEAR1, YEAR2))
on_models("F16o_ensemble", f"fold:s w:d scale:d {METRICS}", lambda t, shop: B.ensemble(t, WEIGHTS, SCALES))
on_models("F17m_recent_level", f"fold:s window:i multiplier:d {METRICS}", lambda t, shop: B.recent_level(t, history(shop), FOLDS, WINDOWS))
on_models("F18m_growth", f"fold:s growth:d {METRICS}", lambda t, shop: B.growth_multiplier(t, RATES))
on_models("F19m_seasonal_blend", f"fold:s alpha:d {METRICS}", lambda t, shop: B.seasonal_blend(
    t, preds(shop).select("fold", "date", F.col("pred_direct").alias("revenue_naive")), WEIGHTS))
on_models("F20m_cogs_cap", f"fold:s scale:d cap_name:s {METRICS} days_above_revenue:i", lambda t, shop: B.cogs_scale_cap(t, COGS_SCALES, COGS_CAPS))
on_models("F21m_refined", f"scale:d {SUMMARY_COLUMNS}", lambda t, shop: B.refined_scales(t, SCALES))
on_models("F22m_summary", f"scale:d {SUMMARY_COLUMNS}", lambda t, shop: B.summarize_grid(B.global_scale(t, SCALES), ["scale"]))
on_models("F23m_best", f"scale:d {SUMMARY_COLUMNS}", lambda t, shop: B.select_best(B.summarize_grid(B.global_scale(t, SCALES), ["scale"])))
on_models("F24m_weights", "w:d rmse:d is_best:b", lambda t, shop: B.blend_weights(t))
on_models("F24n_cogs_weights", "w:d rmse:d is_best:b", lambda t, shop: B.blend_weights_of(t, "actual_cogs", "pred_cogs_direct", "pred_cogs_component"))
on_models("F25m_candidates", "revenue_strategy:s cogs_strategy:s revenue_mae_all:d revenue_r2_all:d revenue_mae_recent:d cogs_mae_all:d cogs_rmse_recent:d",
          lambda t, shop: B.candidate_comparison(t, STRATEGIES, [{"name": "plain"}, {"name": "capped", "scale": 0.95, "cap": 0.35}]))
on_models("F26m_strategies", "name:s fold:s date:t predicted:d", lambda t, shop: B.strategy_apply(t, STRATEGIES))


@query("F27_horizon_awareness", "lag:i known_days:i recursive_days:i first_recursive:t recursive_share:d", """
WITH s AS (SELECT min(date) AS s FROM x_future)
SELECT k AS lag, count(*) FILTER (date - k < s) AS known_days, count(*) FILTER (date - k >= s) AS recursive_days,
       min(date) FILTER (date - k >= s) AS first_recursive, 1.0 * count(*) FILTER (date - k >= s) / count(*) AS recursive_share
FROM x_future, s, (VALUES (1), (7), (14), (30), (60), (90), (180), (365)) v(k) GROUP BY 1""")
def _(shop):
    return M.horizon_awareness(future(shop).select("date"))


@query("F27b_window_awareness", "window:i known_days:i partly_recursive:i mostly_recursive:i first_recursive:t deepest:i", """
WITH s AS (SELECT min(date) AS s FROM x_future), n AS (SELECT date, k, least(date - s, k) AS need FROM x_future, s, (VALUES (7), (14), (30), (90), (180), (365)) v(k))
SELECT k AS "window", count(*) FILTER (need = 0) AS known_days, count(*) FILTER (need > 0 AND need < k / 2.0) AS partly_recursive,
       count(*) FILTER (need > 0 AND need >= k / 2.0) AS mostly_recursive, min(date) FILTER (need > 0) AS first_recursive, max(need) AS deepest FROM n GROUP BY 1""")
def _(shop):
    return M.window_awareness(future(shop).select("date"))


@query("F27c_last_known_dates", "source:s last_date:t", """
SELECT 'orders' AS source, max(order_date) AS last_date FROM x_orders UNION ALL SELECT 'returns', max(return_date) FROM x_returns
UNION ALL SELECT 'traffic', max(date) FROM x_traffic UNION ALL SELECT 'promotions', max(end_date) FROM x_promotions""")
def _(shop):
    sources = {
        "orders": (shop.orders, "order_date"),
        "returns": (shop.returns, "return_date"),
        "traffic": (shop.traffic, "date"),
        "promotions": (shop.promotions, "end_date"),
    }
    return Q.data_availability(sources, CUT).select(F.col("table").alias("source"), "last_date")


@query("F28_boundary_check", "last_known:t gap_days:i trailing_missing:i continuous:b", """
WITH l AS (SELECT max(date) AS l FROM x_sales)
SELECT any_value(l) AS last_known, DATE '2001-08-10' - any_value(l) - 1 AS gap_days, 30 - count(DISTINCT date) FILTER (l - date < 30) AS trailing_missing,
       DATE '2001-08-10' - any_value(l) - 1 = 0 AND 30 - count(DISTINCT date) FILTER (l - date < 30) = 0 AS continuous FROM x_sales, l""")
def _(shop):
    return M.boundary_check(shop.sales, "2001-08-10")


@query("F30_template_check", "rows:i days:i first_date:t last_date:t expected_days:i valid:b", """
SELECT count(*) AS rows, count(DISTINCT date) AS days, min(date) AS first_date, max(date) AS last_date, DATE '2001-07-31' - DATE '2001-01-01' + 1 AS expected_days,
       count(*) = 212 AND count(DISTINCT date) = 212 AND count(*) FILTER (date BETWEEN DATE '2001-01-01' AND DATE '2001-07-31') = 212 AS valid FROM x_future""")
def _(shop):
    return M.template_check(future(shop).select("date"), "2001-01-01", "2001-07-31")


# --- report tables ----------------------------------------------------------------

@query("V01_quadrant_metrics", "promo_type:s daily_revenue:d margin_pct:d performance_index:d zone:s", f"""
WITH t AS ({TRADEOFF}), m AS (SELECT quantile_cont(daily_revenue, 0.5) AS a, quantile_cont(margin_pct, 0.5) AS b FROM t)
SELECT promo_type, daily_revenue, margin_pct, performance_index, CASE WHEN round(daily_revenue - a, 4) >= 0 THEN 'high' ELSE 'low' END || '_revenue_' ||
       CASE WHEN round(margin_pct - b, 6) >= 0 THEN 'high' ELSE 'low' END || '_margin' AS zone FROM t, m""")
def _(shop):
    table = quadrants(tradeoff(shop), "daily_revenue", "margin_pct", "revenue", "margin")
    return table.withColumnRenamed("quadrant", "zone")


@query("V02_indexed_metrics", "year:i revenue_index:d orders_index:d aov_index:d", """
WITH y AS (SELECT year(month) AS year, sum(revenue) AS r, sum(orders) AS o FROM x_monthly GROUP BY 1), b AS (SELECT * FROM y WHERE year = 1995)
SELECT y.year, 100 * y.r / b.r AS revenue_index, 100.0 * y.o / b.o AS orders_index, 100 * (y.r / y.o) / (b.r / b.o) AS aov_index FROM y, b""")
def _(shop):
    sales = shop.sales.select("date", "revenue", "orders")
    seen = sales.select("date", F.col("orders").alias("sessions"))
    return E.growth_illusion(seen, sales, 1995).withColumnRenamed("period", "year")


@query("V03_conversion_smoothed", "period:t conversion_pct:d conversion_3:d conversion_6:d", """
SELECT period, conversion_pct, CASE WHEN count(*) OVER a >= 2 THEN avg(conversion_pct) OVER a END AS conversion_3,
       CASE WHEN count(*) OVER b >= 2 THEN avg(conversion_pct) OVER b END AS conversion_6 FROM x_conversion
WINDOW a AS (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS (ORDER BY period ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def _(shop):
    return W.conversion_smoothed(W.conversion_proxy(shop.traffic, shop.web_orders))


@query("V04_waterfall", "position:i label:s bottom:d height:d end_level:d", """
WITH y AS (SELECT year(month) AS year, sum(revenue - cogs) AS p FROM x_monthly GROUP BY 1),
     d AS (SELECT year - 1994 AS position, CAST(year AS VARCHAR) AS label, p - coalesce(lag(p) OVER (ORDER BY year), 0) AS height FROM y),
     e AS (SELECT *, sum(height) OVER (ORDER BY position) AS end_level FROM d)
SELECT position, label, end_level - height AS bottom, height, end_level FROM e
UNION ALL SELECT max(position) + 1, 'total', 0, sum(height), sum(height) FROM d""")
def _(shop):
    years = C.monthly(shop).groupBy(F.year("month").alias("year")).agg(
        F.sum(F.col("revenue") - F.col("cogs")).alias("p")
    )
    before = F.coalesce(F.lag("p").over(Window.orderBy("year")), F.lit(0.0))
    steps = years.select(
        (F.col("year") - 1994).alias("i"), F.col("year").cast("string").alias("label"), (F.col("p") - before).alias("v")
    )
    return V.waterfall(steps, "i", "label", "v")


# --- files ------------------------------------------------------------------------

@query("IO01_csv_round_trip", "order_id:i order_date:t order_status:s order_value:d", "SELECT order_id, order_date, order_status, order_value FROM x_orders")
def _(shop):
    folder = scratch_folder(shop.spark)
    rows = shop.orders.select("order_id", "order_date", "order_status", "order_value")
    sinks.write_metrics(rows, folder, one_file=False)
    ddl = "order_id BIGINT, order_date DATE, order_status STRING, order_value DOUBLE"
    return catalog.read_table(shop.spark, folder, ddl)


@query("IO02_encoding_fallback", "city:s region:s", """
SELECT n_name || ' é' AS city, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(shop):
    folder = scratch_folder(shop.spark)
    rows = shop.geography.select(F.concat("city", F.lit(" é")).alias("city"), "region")
    rows.write.mode("overwrite").options(header=True, encoding="ISO-8859-1").csv(folder)
    return catalog.read_with_fallback(shop.spark, folder, "city STRING, region STRING")


@query("IO03_sql_over_files", "o_orderstatus:s orders:i value:d", "SELECT o_orderstatus, count(*) AS orders, sum(o_totalprice) AS value FROM orders GROUP BY 1")
def _(shop):
    text = "SELECT o_orderstatus, count(*) AS orders, sum(o_totalprice) AS value FROM {orders} GROUP BY 1"
    return catalog.sql_over_files(shop.spark, text, orders=f"{shop.folder}/orders.parquet")


@query("IO07_write_metrics", "month:t revenue:d", "SELECT month, revenue FROM x_monthly")
def _(shop):
    folder = scratch_folder(shop.spark)
    sinks.write_metrics(C.monthly(shop).select("month", "revenue"), folder)
    return catalog.read_table(shop.spark, folder, "month DATE, revenue DOUBLE")


@query("IO08_write_forecast", "rows:i first_date:t last_date:t missing:i negative:i extra_dates:i absent_dates:i", """
SELECT count(*) AS rows, min(date) AS first_date, max(date) AS last_date, 0 AS missing, 0 AS negative, 0 AS extra_dates, 0 AS absent_dates FROM x_future""")
def _(shop):
    growth = M.annual_growth(train(shop), ["revenue", "cogs"], since=1996, carry=0.0)
    base = M.seasonal_baseline(train(shop), future(shop).select("date"), growth, ["revenue", "cogs"])
    forecast = base.select(
        "date", F.col("revenue_seasonal_base").alias("revenue"), F.col("cogs_seasonal_base").alias("cogs")
    )
    return sinks.write_forecast(forecast, future(shop).select("date"), scratch_folder(shop.spark))


@query("IO09_cached_stage", "fold:s days:i pred_current:d", """
SELECT fold, count(*) AS days, sum(pred_current) AS pred_current FROM x_preds GROUP BY 1""")
def _(shop):
    folder = scratch_folder(shop.spark) + "/folds"
    wanted = B.rolling_origin(history(shop), FOLDS).where("role = 'validate'").select("fold", "date")
    columns = ["actual_revenue", "pred_direct", "pred_component", "pred_current"]
    for _ in range(2):  # built once, then loaded
        stage, _state = sinks.cached_stage(
            shop.spark, folder, lambda: preds(shop), columns, ["fold", "date"], wanted, partition_by=["fold"]
        )
    return stage.groupBy("fold").agg(
        F.count("*").alias("days"), F.sum("pred_current").alias("pred_current")
    )
