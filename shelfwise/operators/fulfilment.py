"""Returns, reviews, payments, delivery and shipping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.ordered import null_safe_join, quantiles, quantiles_of
from shelfwise.functions.scalars import (
    at_least,
    at_most,
    is_defective,
    is_wrong_size,
    month_start,
    ratio,
    standard_reason,
)
from shelfwise.operators.aggregate import correlations, group_mode
from shelfwise.operators.commerce import quantile_groups
from shelfwise.operators.joins import aggregate_then_join
from shelfwise.operators.timeseries import by_date, densify, feature_columns, rolled
from shelfwise.sources.session import checkpointed

LOW_STARS, HIGH_STARS = 2, 4


# --- returns --------------------------------------------------------------------

def returned_lines(lines: DataFrame, returns: DataFrame) -> DataFrame:
    """Lines per order and product with returned quantity, refund and reason flags."""
    keys = ["order_id", "product_id"]
    reason = standard_reason(F.col("return_reason"))
    sold = lines.groupBy(*keys).agg(
        F.sum("quantity").alias("quantity"),
        F.sum("revenue").alias("revenue"),
        F.count("*").alias("lines"),
        F.max("discount_rate").alias("discount_rate"),
        F.max("promo_used").alias("promo_used"),
        F.min("order_date").alias("order_date"),
        *[F.min(c).alias(c) for c in ("category", "segment", "size")],
    )
    out = aggregate_then_join(
        sold,
        returns,
        keys,
        {
            "returned_quantity": F.sum("return_quantity"),
            "refund": F.sum("refund_amount"),
            "wrong_size": F.count_if(is_wrong_size(reason)),
            "defective": F.count_if(is_defective(reason)),
        },
    )
    return out.fillna(0, ["returned_quantity", "refund", "wrong_size", "defective"])


def with_few(groups: DataFrame, count: str, within: Sequence[str]) -> DataFrame:
    """Add ``_few``, the tenth percentile of ``count`` over the groups of an outer one."""
    few = quantiles(groups, count, {"_few": 0.1}, within)
    return null_safe_join(groups, few, within, "left") if within else groups.withColumn("_few", few.scalar())


def return_rate(returned: DataFrame, keys: Sequence[str], least: int = 20, within: Sequence[str] = ()) -> DataFrame:
    """Quantity-based return rate, refund ratio, net revenue and small-sample flag.

    A group is small below ``least`` lines and below the tenth percentile of the groups ``within`` its outer one. The groups
    are stored, so that the percentile doesn't total the lines again.
    """
    sums = checkpointed(returned.groupBy(*keys).agg(
        F.sum("quantity").alias("quantity"),
        F.sum("returned_quantity").alias("returned_quantity"),
        F.sum("lines").alias("lines"),
        F.count_if(F.col("returned_quantity") > 0).alias("returned_lines"),
        F.sum("refund").alias("refund"),
        F.sum("revenue").alias("revenue"),
    ))
    return with_few(sums, "lines", within).withColumns(
        {
            "return_rate": ratio(F.col("returned_quantity"), F.col("quantity")),
            "refund_ratio": ratio(F.col("refund"), F.col("revenue")),
            "net_revenue": F.col("revenue") - F.col("refund"),
            "small_sample": F.col("lines") < F.greatest(F.lit(float(least)), F.col("_few")),
        }
    ).drop("_few")


def net_revenue_daily(sales: DataFrame, returns: DataFrame) -> DataFrame:
    """Gross revenue, refunds and net revenue per day; days at P95 of the ratio are material."""
    back = returns.groupBy(F.col("return_date").alias("date")).agg(
        F.sum("refund_amount").alias("refund"),
        F.sum("return_quantity").alias("returned_quantity"),
        F.count("*").alias("returns"),
    )
    joined = sales.select("date", F.col("revenue").alias("gross")).join(back, "date", "left")
    daily = joined.fillna(0, ["refund", "returned_quantity", "returns"]).withColumns(
        {
            "net": F.col("gross") - F.col("refund"),
            "refund_ratio": ratio(F.col("refund"), F.col("gross")),
        }
    )
    cut = daily.agg(F.percentile("refund_ratio", F.lit(0.95)).alias("c")).scalar()
    return daily.withColumn("_c", cut).withColumn(
        "material", F.coalesce(at_least(F.col("refund_ratio"), F.col("_c")), F.lit(False))
    ).drop("_c")


def return_reasons(returns: DataFrame, keys: Sequence[str | Column] = ()) -> DataFrame:
    """Returns, quantity and refunds per reason and their share within ``keys``."""
    reason = standard_reason(F.col("return_reason")).alias("reason")
    sums = returns.groupBy(*keys, reason).agg(
        F.count("*").alias("returns"),
        F.sum("return_quantity").alias("quantity"),
        F.sum("refund_amount").alias("refund"),
    )
    names = [c for c in sums.columns if c not in ("reason", "returns", "quantity", "refund")]
    whole = F.sum("returns").over(Window.partitionBy(*names))
    return sums.withColumn("share", ratio(F.col("returns"), whole))


def reason_rates(returned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wrong-size and defect returns per line sold and per return."""
    hit = lambda c: F.count_if(F.col(c) > 0)
    back = F.count_if(F.col("returned_quantity") > 0)
    return returned.groupBy(*keys).agg(
        F.count("*").alias("lines"),
        back.alias("returned_lines"),
        hit("wrong_size").alias("wrong_size"),
        hit("defective").alias("defective"),
        ratio(hit("wrong_size"), F.count("*")).alias("wrong_size_rate"),
        ratio(hit("defective"), F.count("*")).alias("defect_rate"),
        ratio(hit("wrong_size"), back).alias("wrong_size_share"),
    )


def discount_group(returned: DataFrame) -> DataFrame:
    """Label lines by their discount: none, and thirds of the positive ones."""
    positive = returned.where("discount_rate > 0")
    cuts = quantiles(positive, "discount_rate", {"low": 0.33, "high": 0.67})
    rate = F.col("discount_rate")
    label = (
        F.when(rate.isNull() | (rate <= 0), "no_discount")
        .when(rate <= F.col("_c.low"), "low_discount")
        .when(rate <= F.col("_c.high"), "medium_discount")
        .otherwise("high_discount")
    )
    marked = returned.withColumn("_c", cuts.select(F.struct("low", "high")).scalar())
    return marked.withColumn("discount_group", label).drop("_c")


def return_pressure(returned: DataFrame, n: int = 20) -> DataFrame:
    """Products with many units ordered and the highest return rates."""
    products = returned.groupBy("product_id").agg(
        F.sum("quantity").alias("quantity"),
        F.sum("returned_quantity").alias("returned_quantity"),
        F.sum("refund").alias("refund"),
        F.avg(F.col("promo_used").cast("int")).alias("promo_rate"),
        ratio(F.sum("returned_quantity"), F.sum("quantity")).alias("return_rate"),
    )
    cut = quantiles(products, "quantity", {"c": 0.75}).scalar()
    return (
        products.withColumn("_c", cut)
        .where(at_least(F.col("quantity"), F.col("_c")))
        .orderBy(F.round("return_rate", 9).desc(), "product_id")
        .limit(n)
        .drop("_c")
    )


def return_features(returns: DataFrame) -> DataFrame:
    """Daily returned quantity and refunds with 30-day lags and leak-safe sums."""
    daily = returns.groupBy(F.col("return_date").alias("date")).agg(
        F.sum("return_quantity").alias("returned"), F.sum("refund_amount").alias("refund")
    )
    dense = densify(daily, {"returned": 0.0, "refund": 0.0})
    spec = [
        ("returned", "lag", 30),
        ("refund", "lag", 30),
        ("returned", "sum", 30, 7, 1),
        ("refund", "mean", 30, 7, 1),
    ]
    return feature_columns(dense, spec)


# --- reviews --------------------------------------------------------------------

def rating_columns() -> list[Column]:
    """Review count, mean, median, deviation and shares of low and high ratings."""
    rating = F.col("rating")
    return [
        F.count("*").alias("reviews"),
        F.avg(rating).alias("mean_rating"),
        F.percentile(rating, F.lit(0.5)).alias("median_rating"),
        F.stddev_samp(rating).alias("rating_std"),
        ratio(F.count_if(rating <= LOW_STARS), F.count("*")).alias("low_ratio"),
        ratio(F.count_if(rating >= HIGH_STARS), F.count("*")).alias("high_ratio"),
    ]


def rating_by(reviews: DataFrame, keys: Sequence[str], least: int = 20, within: Sequence[str] = ()) -> DataFrame:
    """Rating statistics per group with a small-sample flag, as in :func:`return_rate`.

    The median reads a map of at most five star values per group.
    """
    stats = checkpointed(reviews.where(F.col("rating").between(1, 5)).groupBy(*keys).agg(*rating_columns()))
    small = F.col("reviews") < F.greatest(F.lit(float(least)), F.col("_few"))
    return with_few(stats, "reviews", within).withColumn("small_sample", small).drop("_few")


def product_ratings(reviews: DataFrame) -> DataFrame:
    """Reviews, mean and low share per product."""
    rating = F.col("rating")
    return reviews.where(rating.between(1, 5)).groupBy("product_id").agg(
        F.count("*").alias("reviews"),
        F.avg(rating).alias("mean_rating"),
        ratio(F.count_if(rating <= LOW_STARS), F.count("*")).alias("low_ratio"),
    )


def product_risk(lines: DataFrame, reviews: DataFrame, returns: DataFrame) -> DataFrame:
    """Products with sales, ratings, returns and return rate."""
    sold = lines.groupBy("product_id").agg(
        F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue")
    )
    back = returns.groupBy("product_id").agg(
        F.count("*").alias("returns"),
        F.sum("return_quantity").alias("returned_quantity"),
        F.sum("refund_amount").alias("refund"),
    )
    joined = product_ratings(reviews).join(sold, "product_id", "left").join(back, "product_id", "left")
    return joined.fillna(0, ["returns", "returned_quantity", "refund"]).withColumns(
        {
            "return_rate": ratio(F.col("returned_quantity"), F.col("quantity")),
            "refund_ratio": ratio(F.col("refund"), F.col("revenue")),
        }
    )


def category_risk(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """Product risk table rolled up to categories from its sums."""
    joined = products.join(attributes.select("product_id", "category"), "product_id")
    sums = joined.groupBy("category").agg(
        F.sum("reviews").alias("reviews"),
        ratio(F.sum(F.col("mean_rating") * F.col("reviews")), F.sum("reviews")).alias("mean_rating"),
        ratio(F.sum(F.col("low_ratio") * F.col("reviews")), F.sum("reviews")).alias("low_ratio"),
        F.sum("quantity").alias("quantity"),
        F.sum("revenue").alias("revenue"),
        F.sum("returned_quantity").alias("returned_quantity"),
        F.sum("refund").alias("refund"),
    )
    return sums.withColumn("return_rate", ratio(F.col("returned_quantity"), F.col("quantity")))


def rating_vs_returns(risk: DataFrame) -> DataFrame:
    """Correlation of ratings with the return rate."""
    return correlations(risk, [("mean_rating", "return_rate"), ("low_ratio", "return_rate")])


def rating_monthly(reviews: DataFrame, attributes: DataFrame) -> DataFrame:
    """Monthly ratings with leak-safe three-month mean and the worst category."""
    month = month_start(F.col("review_date")).alias("month")
    months = reviews.groupBy(month).agg(*rating_columns())
    by_category = (
        reviews.join(attributes.select("product_id", "category"), "product_id")
        .groupBy(month, "category")
        .agg(F.round(F.avg("rating"), 9).alias("r"))
        .groupBy("month")
        .agg(F.min(F.struct("r", "category")).alias("w"))
    )
    worst = by_category.select(
        "month", F.col("w.category").alias("worst_category"), F.col("w.r").alias("worst_rating")
    )
    return months.join(worst, "month").withColumns(
        {
            "rating_lag_1": F.lag("mean_rating").over(by_date((), "month")),
            "rating_roll_mean_3": rolled("mean_rating", 3, "mean", 1, 1, (), "month"),
        }
    )


def review_volume_vs_revenue(sales: DataFrame, reviews: DataFrame) -> DataFrame:
    """Daily reviews next to revenue with lags, rolling sums and future revenue."""
    counts = reviews.groupBy(F.col("review_date").alias("date")).agg(
        F.count("*").alias("reviews"), F.avg("rating").alias("mean_rating")
    )
    joined = sales.select("date", "revenue").join(counts, "date", "full_outer")
    dense = densify(joined.select("date", "revenue", "reviews"), {"revenue": 0.0, "reviews": 0})
    spec = [("reviews", "lag", 7), ("reviews", "lag", 30), ("reviews", "sum", 30, 1, 1)]
    return feature_columns(dense, spec).withColumns(
        {
            "revenue_next_7": rolled("revenue", 7, "sum", 7, -7),
            "revenue_next_30": rolled("revenue", 30, "sum", 30, -30),
        }
    )


def review_revenue_groups(risk: DataFrame) -> DataFrame:
    """Products with many reviews by revenue, and those with bad ratings and many returns."""
    marks = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    columns = {"_n": "reviews", "_v": "revenue", "_r": "mean_rating", "_b": "returns"}
    named = {column: {f"{short}_{q}": p for q, p in marks.items()} for short, column in columns.items()}
    cuts = quantiles_of(risk, named).select(F.struct("*")).scalar()
    stats = lambda short: F.struct(*[F.col(f"_cuts.{short}_{q}").alias(q) for q in marks])
    placed = risk.withColumn("_cuts", cuts).withColumns({short: stats(short) for short in columns}).drop("_cuts")
    enough = F.col("reviews") >= F.greatest(F.lit(5), F.floor("_n.q50"))
    many = enough & (at_least(F.col("reviews"), F.col("_n.q75")))
    return placed.withColumns(
        {
            "many_reviews_high_revenue": many & (at_least(F.col("revenue"), F.col("_v.q75"))),
            "many_reviews_low_revenue": many & (at_most(F.col("revenue"), F.col("_v.q50"))),
            "review_and_return_risk": (at_least(F.col("reviews"), F.col("_n.q75")))
            & (at_most(F.col("mean_rating"), F.col("_r.q25")))
            & (at_least(F.col("returns"), F.col("_b.q75"))),
        }
    ).drop("_n", "_v", "_r", "_b")


def category_rating_leads(reviews: DataFrame, lines: DataFrame, attributes: DataFrame) -> DataFrame:
    """Category months with lagged ratings, later revenue and rating change."""
    rated = (
        reviews.join(attributes.select("product_id", "category"), "product_id")
        .groupBy("category", month_start(F.col("review_date")).alias("month"))
        .agg(
            F.avg("rating").alias("mean_rating"),
            F.count("*").alias("reviews"),
            ratio(F.count_if(F.col("rating") <= LOW_STARS), F.count("*")).alias("low_ratio"),
        )
    )
    sold = lines.groupBy("category", month_start(F.col("order_date")).alias("month")).agg(
        F.sum("revenue").alias("revenue")
    )
    order = by_date(["category"], "month")
    joined = rated.join(sold, ["category", "month"], "left")
    return joined.withColumns(
        {
            "rating_lag_1": F.lag("mean_rating", 1).over(order),
            "rating_lag_3": F.lag("mean_rating", 3).over(order),
            "low_ratio_lag_1": F.lag("low_ratio", 1).over(order),
            "revenue_lead_1": F.lead("revenue", 1).over(order),
            "revenue_lead_3": F.lead("revenue", 3).over(order),
            "rating_change": F.col("mean_rating") - F.lag("mean_rating", 1).over(order),
        }
    )


def rating_lead_correlations(panel: DataFrame) -> DataFrame:
    """Correlation of earlier ratings with later revenue."""
    pairs = [
        ("rating_lag_1", "revenue_lead_1"),
        ("low_ratio_lag_1", "revenue_lead_1"),
        ("rating_lag_3", "revenue_lead_3"),
    ]
    return correlations(panel, pairs)


def risk_matrix(risk: DataFrame) -> DataFrame:
    """Five risk groups from the medians of revenue, rating, return rate and reviews."""
    columns = {"_v": "revenue", "_r": "mean_rating", "_b": "return_rate", "_n": "reviews"}
    cuts = quantiles_of(risk, {column: {short: 0.5} for short, column in columns.items()}).select(F.struct("*")).scalar()
    placed = risk.withColumn("_cuts", cuts).withColumns({short: F.col(f"_cuts.{short}") for short in columns}).drop("_cuts")
    rich = at_least(F.col("revenue"), F.col("_v"))
    good = at_least(F.col("mean_rating"), F.col("_r"))
    back = at_least(F.col("return_rate"), F.col("_b"))
    label = (
        F.when(rich & ~good & back, "high_revenue_low_rating_high_return")
        .when(rich & good & ~back, "high_revenue_high_rating_low_return")
        .when(~rich & ~good & back, "low_revenue_low_rating_high_return")
        .when((at_least(F.col("reviews"), F.col("_n"))) & ~rich, "high_review_low_revenue")
        .otherwise("mixed")
    )
    return placed.withColumn("risk_group", label).drop("_v", "_r", "_b", "_n")


def monthly_trend_panel(monthly: DataFrame, reviews: DataFrame, returns: DataFrame) -> DataFrame:
    """Revenue, reviews and returns per month, side by side."""
    a = reviews.groupBy(month_start(F.col("review_date")).alias("month")).agg(
        F.count("*").alias("reviews"), F.avg("rating").alias("mean_rating")
    )
    b = returns.groupBy(month_start(F.col("return_date")).alias("month")).agg(
        F.count("*").alias("returns"), F.sum("refund_amount").alias("refund")
    )
    base = monthly.select("month", "revenue", "orders")
    return base.join(a, "month", "full_outer").join(b, "month", "full_outer")


# --- payments -------------------------------------------------------------------

def payment_methods(payments: DataFrame, flags: Sequence[str] = ("is_cancelled", "is_returned", "is_completed")) -> DataFrame:
    """Count, shares, value percentiles and status rates per method."""
    sums = payments.groupBy("payment_method").agg(
        F.count("*").alias("payments"),
        F.count_distinct("order_id").alias("orders"),
        F.sum("payment_value").alias("value"),
        F.avg("payment_value").alias("mean_value"),
        F.stddev_samp("payment_value").alias("value_std"),
        *[ratio(F.count_if(f), F.count("*")).alias(f"{f[3:]}_rate") for f in flags],
    )
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    marks = quantiles(payments, "payment_value", probs, ["payment_method"])
    whole = lambda c: F.sum(c).over(Window.partitionBy())
    return null_safe_join(sums, marks, ["payment_method"], "left").withColumns(
        {
            "share": F.col("payments") / whole("payments"),
            "value_share": ratio(F.col("value"), whole("value")),
        }
    )


def payment_mix_monthly(payments: DataFrame) -> DataFrame:
    """Count, value and share of each method per month."""
    months = payments.groupBy(month_start(F.col("order_date")).alias("month"), "payment_method").agg(
        F.count("*").alias("payments"), F.sum("payment_value").alias("value")
    )
    whole = F.sum("payments").over(Window.partitionBy("month"))
    return months.withColumn("share", ratio(F.col("payments"), whole))


def payment_features(mix: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Last month's dominant share, shares of named methods, count and mean value."""
    share = lambda m: F.coalesce(
        F.max(F.when(F.col("payment_method") == m, F.col("share"))), F.lit(0.0)
    )
    months = mix.groupBy("month").agg(
        F.sum("payments").alias("payments"),
        ratio(F.sum("value"), F.sum("payments")).alias("mean_value"),
        F.max("share").alias("dominant_share"),
        *[share(m).alias(f"share_{i}") for i, m in enumerate(methods)],
    )
    order = by_date((), "month")
    names = [c for c in months.columns if c != "month"]
    return months.withColumns({f"{c}_lag_1": F.lag(c).over(order) for c in names})


def installments_by(payments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Payments, value, percentiles and shares per installment term (or any key)."""
    sums = payments.groupBy(*keys).agg(
        F.count("*").alias("payments"),
        F.sum("payment_value").alias("value"),
        F.avg("payment_value").alias("mean_value"),
        F.avg("installments").alias("mean_term"),
    )
    marks = quantiles(payments, "payment_value", {"p50": 0.5, "p75": 0.75, "p90": 0.9}, keys)
    whole = lambda c: F.sum(c).over(Window.partitionBy())
    return null_safe_join(sums, marks, list(keys), "left").withColumns(
        {
            "share": F.col("payments") / whole("payments"),
            "value_share": ratio(F.col("value"), whole("value")),
        }
    )


def installments_monthly(payments: DataFrame) -> DataFrame:
    """Installment usage, value, mean term and commonest term per month."""
    keyed = payments.withColumn("month", month_start(F.col("order_date")))
    several = F.col("installments") > 1
    months = keyed.groupBy("month").agg(
        F.count("*").alias("payments"),
        F.count_if(several).alias("installment_payments"),
        F.sum(F.when(several, F.col("payment_value"))).alias("installment_value"),
        F.avg("installments").alias("mean_term"),
        ratio(F.count_if(several), F.count("*")).alias("usage_rate"),
    )
    common = group_mode(keyed, ["month"], "installments").select(
        "month", F.col("mode").alias("common_term")
    )
    return months.join(common, "month")


def installments_by_product(lines: DataFrame, payments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Installment usage of item lines per product group."""
    terms = payments.select("order_id", "installments")
    return lines.join(terms, "order_id").groupBy(*keys).agg(
        F.count("*").alias("lines"),
        ratio(F.count_if(F.col("installments") > 1), F.count("*")).alias("usage_rate"),
        F.avg("installments").alias("mean_term"),
        F.avg("revenue").alias("mean_value"),
    )


def installment_features(months: DataFrame) -> DataFrame:
    """Last month's usage and term and three-month means."""
    order = by_date((), "month")
    names = ["usage_rate", "mean_term", "installment_value"]
    return months.select(
        "month",
        *[F.lag(n).over(order).alias(f"{n}_lag_1") for n in names],
        *[rolled(n, 3, "mean", 1, 1, (), "month").alias(f"{n}_roll_mean_3") for n in names],
    )


# --- delivery and shipping --------------------------------------------------------

def delivery_days(shipments: DataFrame, orders: DataFrame) -> DataFrame:
    """Durations per order; late by estimate, else above P75 where none is known."""
    base = shipments.join(orders, "order_id").withColumns(
        {
            "from_ship": F.datediff("delivery_date", "ship_date"),
            "from_order": F.datediff("delivery_date", "order_date"),
            "delay": F.datediff("delivery_date", "estimated_delivery_date"),
        }
    )
    cut = quantiles(base, "from_ship", {"c": 0.75}).scalar()
    late = F.when(F.col("delay").isNotNull(), F.col("delay") > 0).otherwise(
        F.col("from_ship") > F.col("_c")
    )
    return base.withColumn("_c", cut).withColumn("is_late", late).drop("_c")


def delivery_by(delivered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shipments, mean, median and P90 duration and late share per group."""
    sums = delivered.groupBy(*keys).agg(
        F.count("*").alias("shipments"),
        F.avg("from_ship").alias("mean_days"),
        ratio(F.count_if("is_late"), F.count("*")).alias("late_ratio"),
        F.count_if(F.col("from_order") < 0).alias("invalid"),
    )
    marks = quantiles(delivered, "from_ship", {"median_days": 0.5, "p90_days": 0.9}, keys)
    return null_safe_join(sums, marks, list(keys), "left") if keys else sums.withColumn(
        "_m", marks.select(F.struct("*")).scalar()
    ).select("*", "_m.*").drop("_m")


def with_feedback(delivered: DataFrame, reviews: DataFrame, returns: DataFrame) -> DataFrame:
    """Deliveries with the mean rating and returns of their order."""
    rated = aggregate_then_join(delivered, reviews, ["order_id"], {"rating": F.avg("rating")})
    back = aggregate_then_join(
        rated,
        returns,
        ["order_id"],
        {"returns": F.count("*"), "refund": F.sum("refund_amount")},
    )
    return back.fillna(0, ["returns", "refund"])


def feedback_by(feedback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean duration, rating, return rate and refund per delivery group."""
    return feedback.groupBy(*keys).agg(
        F.count("*").alias("orders"),
        F.avg("from_ship").alias("mean_days"),
        F.avg("rating").alias("mean_rating"),
        ratio(F.count_if(F.col("returns") > 0), F.count("*")).alias("return_rate"),
        F.avg("refund").alias("mean_refund"),
    )


def duration_bin(days: Column, edges: Sequence[int] = (3, 4, 6)) -> Column:
    """Fast, normal, slow or very slow by fixed edges."""
    fast, normal, slow = edges
    return (
        F.when(days.isNull(), F.lit(None).cast("string"))
        .when(days <= fast, "fast")
        .when(days <= normal, "normal")
        .when(days <= slow, "slow")
        .otherwise("very_slow")
    )


def speed_group(delivered: DataFrame) -> DataFrame:
    """Label deliveries by the P25, P75 and P90 of their duration."""
    cuts = [(0.25, "fast"), (0.75, "normal"), (0.9, "slow")]
    return quantile_groups(delivered, "from_ship", cuts, "very_slow", "speed_group")


def shipping_orders(shipments: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders with fee ratio, free-shipping flag and fee group of the positive fees."""
    base = shipments.select("order_id", "shipping_fee").join(orders, "order_id")
    fee = F.col("shipping_fee")
    cuts = quantiles(base.where(fee > 0), "shipping_fee", {"p50": 0.5, "p90": 0.9})
    label = (
        F.when(fee.isNull(), "missing_fee")
        .when(fee == 0, "free_shipping")
        .when(fee <= F.col("_c.p50"), "low_shipping_fee")
        .when(fee <= F.col("_c.p90"), "medium_shipping_fee")
        .otherwise("high_shipping_fee")
    )
    return base.withColumn("_c", cuts.select(F.struct("p50", "p90")).scalar()).withColumns(
        {
            "fee_group": label,
            "free_shipping": F.coalesce(fee, F.lit(0.0)) == 0,
            "fee_ratio": F.when(F.col("order_value") > 0, fee / F.col("order_value")),
        }
    ).drop("_c")


def shipping_by(shipping: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Orders, value, fees, free share, fee ratio and cancel rate per group."""
    sums = shipping.groupBy(*keys).agg(
        F.count("*").alias("orders"),
        F.sum("order_value").alias("value"),
        F.avg("order_value").alias("aov"),
        F.avg("shipping_fee").alias("mean_fee"),
        ratio(F.count_if("free_shipping"), F.count("*")).alias("free_ratio"),
        ratio(F.count_if(F.col("fee_group") == "high_shipping_fee"), F.count("*")).alias("high_ratio"),
        F.avg("fee_ratio").alias("mean_fee_ratio"),
        ratio(F.count_if("is_cancelled"), F.count("*")).alias("cancel_rate"),
    )
    marks = quantiles(shipping, "shipping_fee", {"median_fee": 0.5, "p90_fee": 0.9}, keys)
    return null_safe_join(sums, marks, list(keys), "left")


def monthly_features(months: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Last month's value and three-month mean of monthly metrics."""
    order = by_date((), "month")
    return months.select(
        "month",
        *[F.lag(m).over(order).alias(f"{m}_lag_1") for m in metrics],
        *[rolled(m, 3, "mean", 1, 1, (), "month").alias(f"{m}_roll_mean_3") for m in metrics],
    )
