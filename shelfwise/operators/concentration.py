"""Revenue by group, concentration, mix and margins of the assortment."""

from __future__ import annotations


from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.ordered import histogram_bin, quantiles, running, quantiles_of
from shelfwise.functions.scalars import at_least, herfindahl, ratio
from shelfwise.operators.timeseries import by_date, densify, lags, rolled
from shelfwise.sources.session import kept


def group_revenue(lines: DataFrame, group: str, within: Sequence[str] = ()) -> DataFrame:
    """Revenue, orders, lines and products per group with share and rank (inside ``within``)."""
    sums = lines.groupBy(*within, group).agg(
        F.sum("revenue").alias("revenue"),
        F.count_distinct("order_id").alias("orders"),
        F.count("*").alias("lines"),
        F.count_distinct("product_id").alias("products"),
        F.avg("revenue").alias("mean_line"),
    )
    whole = F.sum("revenue").over(Window.partitionBy(*within))
    return sums.withColumns(
        {
            "share": ratio(F.col("revenue"), whole),
            "revenue_per_order": ratio(F.col("revenue"), F.col("orders")),
            "rank": F.rank().over(Window.partitionBy(*within).orderBy(F.desc("revenue"))),
        }
    )


def product_sales(items: DataFrame, products: DataFrame) -> DataFrame:
    """Quantity, revenue, cost and profit per sold product."""
    sold = items.groupBy("product_id").agg(
        F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue")
    )
    cost = F.col("quantity") * F.col("cogs")
    return sold.join(products, "product_id").withColumns(
        {"cost": cost, "profit": F.col("revenue") - cost}
    )


def catalog_by_category_segment(products: DataFrame) -> DataFrame:
    """Products and unit profit per category and segment."""
    unit = F.col("price") - F.col("cogs")
    return products.groupBy("category", "segment").agg(
        F.count("*").alias("products"),
        F.avg(unit).alias("mean_profit"),
        F.min(unit).alias("min_profit"),
        F.max(unit).alias("max_profit"),
    )


def never_sold(products: DataFrame, items: DataFrame) -> DataFrame:
    """Products without a single line."""
    return products.join(items.select("product_id"), "product_id", "left_anti")


def ranked_shares(groups: DataFrame, key: str, value: str = "revenue") -> DataFrame:
    """Groups by falling value with rank, share and cumulative share."""
    known = groups.where(F.col(value).isNotNull()).withColumn(value, F.round(value, 4))
    whole = known.agg(F.sum(value).alias("t"), F.count("*").alias("n"))
    placed = running(
        known,
        {"so_far": F.col(value), "place": F.lit(1).cast("long")},
        [F.desc(value), F.col(key)],
    )
    return (
        placed.withColumn("_w", whole.select(F.struct("t", "n")).scalar())
        .withColumns(
            {
                "share": ratio(F.col(value), F.col("_w.t")),
                "cumulative_share": ratio(F.col("so_far"), F.col("_w.t")),
                "groups": F.col("_w.n"),
            }
        )
        .drop("_w", "so_far")
    )


def concentration(groups: DataFrame, key: str, value: str = "revenue") -> DataFrame:
    """Top shares, groups needed for 50, 80 and 90 percent, HHI and its inverse."""
    ranked = ranked_shares(groups, key, value)
    top = lambda k: F.sum(F.when(F.col("place") <= k, F.col("share")))
    need = lambda p: F.min(F.when(F.col("cumulative_share") >= p - 1e-12, F.col("place")))
    return ranked.agg(
        F.count("*").alias("groups"),
        *[top(k).alias(f"top_{k}_share") for k in (1, 3, 5, 20)],
        *[need(p / 100).alias(f"groups_for_{p}") for p in (50, 80, 90)],
        herfindahl(F.col("share")).alias("hhi"),
    ).withColumn("effective_groups", ratio(F.lit(1.0), F.col("hhi")))


def pareto(products: DataFrame, key: str = "product_id", value: str = "revenue") -> DataFrame:
    """Revenue share of the best 1, 5, 10 and 20 percent of products."""
    ranked = ranked_shares(products, key, value)
    steps = F.explode(F.array(*[F.lit(f) for f in (0.01, 0.05, 0.10, 0.20)]))
    return (
        ranked.withColumn("fraction", steps)
        .where(F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("groups") * F.col("fraction"))))
        .groupBy("fraction")
        .agg(F.count("*").alias("products"), F.sum("share").alias("revenue_share"))
    )


def long_tail(items: DataFrame, key: str = "product_id") -> DataFrame:
    """Head, middle and tail of the assortment with their shares of everything."""
    sums = items.groupBy(key).agg(F.sum("revenue").alias("revenue"), F.count("*").alias("lines"))
    label = (
        F.when(F.col("cumulative_share") <= 0.5, "head_products_to_50pct")
        .when(F.col("cumulative_share") <= 0.8, "mid_tail_50_to_80pct")
        .otherwise("long_tail_after_80pct")
    )
    ranked = ranked_shares(sums, key).withColumn("contribution_group", label)
    orders = (
        items.select("order_id", key)
        .join(ranked.select(key, "contribution_group"), key)
        .groupBy("contribution_group")
        .agg(F.count_distinct("order_id").alias("orders"))
    )
    all_orders = items.agg(F.count_distinct("order_id")).scalar()
    whole = lambda c: F.sum(c).over(Window.partitionBy())
    groups = ranked.groupBy("contribution_group").agg(
        F.count("*").alias("products"), F.sum("revenue").alias("revenue"), F.sum("lines").alias("lines")
    )
    return groups.join(orders, "contribution_group").withColumn("_orders", all_orders).withColumns(
        {
            "product_share": F.col("products") / whole("products"),
            "revenue_share": F.col("revenue") / whole("revenue"),
            "line_share": F.col("lines") / whole("lines"),
            "order_share": F.col("orders") / F.col("_orders"),
        }
    ).drop("_orders")


def top_product_frequency(monthly: DataFrame, key: str = "product_id") -> DataFrame:
    """Months a product sold and months it was among the 10 and 20 best."""
    place = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("revenue"), key))
    top = monthly.withColumn("place", place).where("place <= 20")
    hits = top.groupBy(key).agg(
        F.count_if(F.col("place") <= 10).alias("top_10"), F.count("*").alias("top_20")
    )
    seen = monthly.groupBy(key).agg(
        F.count("*").alias("months"),
        F.avg("revenue").alias("mean_revenue"),
        F.max("revenue").alias("max_revenue"),
    )
    out = seen.join(hits, key, "left").fillna(0, ["top_10", "top_20"])
    return out.withColumns(
        {
            "top_10_share": F.col("top_10") / F.col("months"),
            "top_20_share": F.col("top_20") / F.col("months"),
        }
    )


def monthly_mix(panel: DataFrame, key: str, value: str = "revenue") -> DataFrame:
    """Share of each group per month and its change from the month before."""
    whole = F.sum(value).over(Window.partitionBy("month"))
    shares = panel.withColumn("share", ratio(F.col(value), whole))
    dense = densify(shares.select(key, "month", "share"), {"share": 0.0}, [key], "month", "month")
    moved = F.abs(F.col("share") - F.lag("share").over(by_date([key], "month")))
    return dense.withColumn("abs_change", moved)


def mix_summary(mix: DataFrame) -> DataFrame:
    """Top share, HHI and mean share change per month."""
    return mix.groupBy("month").agg(
        F.max("share").alias("top_share"),
        herfindahl(F.col("share")).alias("hhi"),
        F.avg("abs_change").alias("mean_abs_change"),
    )


def rolling_steps(daily: DataFrame, key: str, value: str, days: int) -> DataFrame:
    """Sums of the ``days`` days before each date, per key, as steps: key, start, end (exclusive), v, before, sale, sold.

    A key's sum changes only the day after a sale and ``days`` days later, so a sale makes two steps whatever ``days`` is; of
    steps that start on one day all but the last are empty. ``sale`` marks the step of the day after a sale, ``sold`` is
    what was sold then. Sums are taken over the sales in reach and not carried along: one without sales is exactly zero.
    Sales are exchanged by key once, each becoming its three events behind the exchange.
    """
    number = F.unix_date("date")
    nothing = F.lit(None).cast("double")
    own = F.col(value).cast("double")
    event = lambda day, s, mark, sold: F.struct(
        day.alias("day"), s.alias("s"), F.lit(mark).alias("mark"), sold.alias("sold")
    )
    kinds = (event(number, own, 0, nothing), event(number + 1, nothing, 1, own), event(number + days + 1, nothing, 2, nothing))
    events = daily.select(key, "date", value).repartition(key).select(key, F.explode(F.array(*kinds)).alias("e")).select(key, "e.*")
    reach = Window.partitionBy(key).orderBy("day").rangeBetween(-days, -1)
    order = Window.partitionBy(key).orderBy("day")
    steps = events.withColumn("v", F.coalesce(F.sum("s").over(reach), F.lit(0.0))).where("mark > 0")
    return steps.select(
        key,
        F.col("day").alias("start"),
        F.lead("day").over(order).alias("end"),
        F.greatest("v", F.lit(0.0)).alias("v"),
        F.coalesce(F.lag(F.greatest("v", F.lit(0.0))).over(order), F.lit(0.0)).alias("before"),
        (F.col("mark") == 1).alias("sale"),
        "sold",
    )


def top_of_steps(steps: DataFrame, key: str, n: int, block: int = 32) -> DataFrame:
    """The ``n`` largest positive values of every day: day, place, v.

    Steps are counted per day in bins of their values. A day's bar is the bin with its n-th largest value, a block's bar the
    lowest of its days: steps below the bars of their blocks are left out before the others are laid out by day. Rows
    without a key make no place.
    """
    alive = steps.where("end > start AND v > 0").where(F.col(key).isNotNull()).withColumn("bin", histogram_bin(F.col("v"), 8))
    turn = lambda day, by: F.struct(F.col(day).alias("day"), F.lit(by).alias("by"))
    turns = alive.select("bin", F.explode(F.array(turn("start", 1), turn("end", -1))).alias("t"))
    moved = turns.groupBy("bin", F.col("t.day").alias("day")).agg(F.sum("t.by").alias("by"))
    days = moved.groupBy("bin").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    held = F.sum(F.coalesce("by", F.lit(0))).over(Window.partitionBy("bin").orderBy("day"))
    counts = days.join(moved, ["bin", "day"], "left").select("bin", "day", held.alias("held")).where("held > 0")
    upto = F.sum("held").over(Window.partitionBy("day").orderBy(F.desc("bin")))
    bars = (
        counts.withColumn("upto", upto)
        .groupBy("day")
        .agg(F.coalesce(F.max(F.when(F.col("upto") >= n, F.col("bin"))), F.min("bin")).alias("bar"))
        .groupBy(F.floor(F.col("day") / block).alias("block"))
        .agg(F.min("bar").alias("bar"))
    )
    place = lambda c: F.floor(c / block)
    parts = alive.withColumn("block", F.explode(F.sequence(place(F.col("start")), place(F.col("end") - 1))))
    likely = parts.join(F.broadcast(bars), "block").where("bin >= bar")  # a row per block of the calendar
    first, last = F.greatest("start", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    laid = likely.select(key, "v", F.explode(F.sequence(first, last - 1)).alias("day"))
    found = laid.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("v"), key)))
    return found.where(F.col("place") <= n).select("day", "place", "v")


def rolling_concentration(daily: DataFrame, key: str, value: str = "revenue", days: int = 30, least: int = 7) -> DataFrame:
    """Concentration of the ``days`` days before each date, and the best key's value of the day before.

    ``daily`` has one row per key and date. Entropy and the sum of squared shares follow from sums that change with a step
    only: what each step adds is totalled per day and added up over the calendar. Steps are stored, so that their sums and
    the best keys don't work them out again.
    """
    steps = kept(rolling_steps(daily, key, value, days))
    log = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln(c)).otherwise(0.0)
    names = {
        "t": F.col("v") - F.col("before"),
        "v2": F.col("v") * F.col("v") - F.col("before") * F.col("before"),
        "vl": log("v") - log("before"),
        "active": (F.col("v") > 0).cast("long") - (F.col("before") > 0).cast("long"),
    }
    moved = steps.groupBy(F.col("start").alias("day")).agg(
        *[F.sum(e).alias(n) for n, e in names.items()], F.max("sold").alias("top"), F.max("sale").alias("sale")
    )
    span = moved.where("sale").agg(F.min(F.col("day") - 1).alias("a"), F.max(F.col("day") - 1).alias("b"))
    calendar = span.select(F.explode(F.sequence("a", "b")).alias("day"), "a")
    order = Window.orderBy("day")  # one row per calendar day
    sums = calendar.join(moved, "day", "left").select(
        "day", "a", "top", *[F.sum(F.coalesce(n, F.lit(0))).over(order).alias(n) for n in names]
    )
    best = top_of_steps(steps, key, 10).groupBy("day").agg(
        *[F.sum(F.when(F.col("place") <= k, F.col("v"))).alias(f"top_{k}") for k in (1, 5, 10)]
    )
    return (
        sums.where((F.col("day") >= F.col("a") + least) & (F.col("active") > 0))
        .join(best, "day")
        .select(
            F.date_from_unix_date(F.col("day").cast("int")).alias("date"),
            "active",
            *[ratio(F.col(f"top_{k}"), F.col("t")).alias(f"top_{k}_share") for k in (1, 5, 10)],
            ratio(F.col("v2"), F.col("t") * F.col("t")).alias("hhi"),
            (F.ln("t") - F.col("vl") / F.col("t")).alias("entropy"),
            F.coalesce("top", F.lit(0.0)).alias("top_value_before"),
        )
    )


def rolling_shares(daily: DataFrame, key: str, value: str = "revenue", days: int = 30, least: int = 7) -> DataFrame:
    """Share of each group in the ``days`` days before, for low-cardinality groups."""
    whole = Window.partitionBy("date")
    dense = densify(daily.select(key, "date", value), {value: 0.0}, [key])
    rolled_sum = dense.withColumn("rolled", rolled(value, days, "sum", least, 1, [key]))
    return rolled_sum.withColumn("share", ratio(F.col("rolled"), F.sum("rolled").over(whole)))


def financial_summary(lines: DataFrame, group: str) -> DataFrame:
    """Revenue, cost, profit, margin, prices and their ranks per group."""
    sums = lines.groupBy(group).agg(
        F.sum("revenue").alias("revenue"),
        F.sum("cost").alias("cost"),
        F.sum("profit").alias("profit"),
        F.sum("quantity").alias("quantity"),
        F.avg("unit_price").alias("mean_price"),
        F.count("*").alias("lines"),
    )
    rank = lambda c: F.rank().over(Window.orderBy(F.desc_nulls_last(c)))
    return sums.withColumns(
        {
            "margin": F.when(F.abs("revenue") >= 1e-9, F.col("profit") / F.col("revenue")),
            "cost_per_unit": ratio(F.col("cost"), F.col("quantity")),
        }
    ).withColumns(
        {"revenue_rank": rank("revenue"), "profit_rank": rank("profit"), "margin_rank": rank("margin")}
    )


def quadrants(df: DataFrame, x: str, y: str, x_name: str, y_name: str) -> DataFrame:
    """Label rows by the medians of two values."""
    cuts = quantiles_of(df, {x: {"a": 0.5}, y: {"b": 0.5}}).select(F.struct("a", "b")).scalar()
    level = lambda v, cut, name: F.concat(
        F.when(at_least(F.col(v), F.col(cut)), "high_").otherwise("low_"), F.lit(name)
    )
    return (
        df.withColumn("_c", cuts)
        .withColumns({"_x": F.col("_c.a"), "_y": F.col("_c.b")})
        .withColumn("quadrant", F.concat_ws("_", level(x, "_x", x_name), level(y, "_y", y_name)))
        .drop("_x", "_y", "_c")
    )


def volume_and_profit(products: DataFrame, n: int = 10) -> DataFrame:
    """Big sellers with the lowest profit and small sellers with the highest."""
    cuts = quantiles(products, "quantity", {"low": 0.25, "high": 0.75})
    marked = products.withColumn("_q", cuts.select(F.struct("low", "high")).scalar())
    busy = marked.where(F.col("quantity") > F.col("_q.high")).orderBy("profit", "product_id").limit(n)
    calm = marked.where(F.col("quantity") < F.col("_q.low")).orderBy(F.desc("profit"), "product_id").limit(n)
    return (
        busy.withColumn("kind", F.lit("volume_without_profit"))
        .unionByName(calm.withColumn("kind", F.lit("profit_without_volume")))
        .drop("_q")
    )


def daily_financials(lines: DataFrame) -> DataFrame:
    """Daily revenue, cost, profit and margin with leak-safe margin features."""
    daily = lines.groupBy(F.col("order_date").alias("date")).agg(
        F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost"), F.sum("profit").alias("profit")
    )
    dense = densify(daily, {"revenue": 0.0, "cost": 0.0, "profit": 0.0})
    dense = dense.withColumn("margin", ratio(F.col("profit"), F.col("revenue")))
    return lags(dense, ["margin", "profit"], [1]).withColumns(
        {
            "margin_roll_mean_30": rolled("margin", 30, "mean", 7, 1),
            "profit_roll_mean_7": rolled("profit", 7, "mean", 3, 1),
        }
    )
