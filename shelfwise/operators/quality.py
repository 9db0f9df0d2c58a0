"""Data-quality audits: shapes, missing values, duplicates, dates, keys and rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.ordered import quantiles
from shelfwise.functions.scalars import month_start, normalize_key, parse_number, ratio
from shelfwise.operators.aggregate import safe_corr
from shelfwise.operators.joins import with_origin


def stacked(row: DataFrame, names: Sequence[str], label: str, fields: Mapping[str, str]) -> DataFrame:
    """Turn one row of ``<field>__<name>`` columns into one row per name."""
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias(label),
                *[F.col(f"`{f}__{n}`").cast(t).alias(f) for f, t in fields.items()],
            )
            for n in names
        ]
    )
    return row.select(F.explode(entries).alias("e")).select("e.*")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def shape_summary(tables: Mapping[str, DataFrame], expected: Sequence[str] = ()) -> DataFrame:
    """Row and column counts per table, plus expected tables that are absent."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table"),
            "rows",
            F.lit(len(df.columns)).alias("columns"),
            F.lit(", ".join(df.columns)).alias("column_names"),
            F.lit(True).alias("present"),
        )
        for name, df in tables.items()
    ]
    absent = [n for n in expected if n not in tables]
    if absent:
        spark = next(iter(tables.values())).sparkSession
        parts.append(
            spark.createDataFrame([(n, False) for n in absent], "table string, present boolean")
        )
    return union_all(parts)


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Type, non-null, null and distinct count and five smallest values per column.

    One scan: cells are grouped by column and value, so a frequent value is one row before anything is ranked."""
    names = list(columns or df.columns)
    kinds = dict(df.dtypes)
    # numbers order as such, all else by its text
    number = lambda c: kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(c).cast("string").alias("v"),
                (F.col(c).cast("double") if number(c) else F.lit(0.0)).alias("place"),
            )
            for c in names
        ]
    )
    values = df.select(F.inline(cells)).groupBy("column", "v", "place").agg(F.count("*").alias("n"))
    known = F.col("v").isNotNull()
    distinct = F.approx_count_distinct("v") if approximate else F.count("v")
    profile = values.groupBy("column").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("non_null"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nulls"),
        distinct.alias("distinct"),
    )
    first = F.row_number().over(Window.partitionBy("column").orderBy("place", "v"))
    samples = (
        values.where(known).withColumn("_r", first).where("_r <= 5").groupBy("column")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "v"))), lambda x: x["v"]), ", ").alias("samples"))
    )
    kind = F.create_map(*[F.lit(x) for c in names for x in (c, kinds[c])])
    return profile.join(samples, "column", "left").withColumn("dtype", kind[F.col("column")])


def missing_summary(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Null count and percentage per column, flagged above ``threshold`` percent."""
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count(c).alias(f"_{c}") for c in df.columns]
    ).withColumns(
        {
            **{f"missing__{c}": F.col("_rows") - F.col(f"_{c}") for c in df.columns},
            **{
                f"missing_pct__{c}": ratio((F.col("_rows") - F.col(f"_{c}")) * 100.0, F.col("_rows"))
                for c in df.columns
            },
        }
    )
    table = stacked(counts, df.columns, "column", {"missing": "bigint", "missing_pct": "double"})
    return table.withColumn("mostly_missing", F.col("missing_pct") > threshold)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column."""
    repeats = df.groupBy(*df.columns).agg(F.count("*").alias("copies"))
    return repeats.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
    ).withColumn("duplicate_pct", ratio(F.col("duplicates") * 100.0, F.col("rows")))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def key_format_diagnostics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whitespace, blanks, decimal-like integers, leading zeros and nulls per key."""
    raw = {k: F.col(k).cast("string") for k in keys}
    tests = {
        "outer_whitespace": lambda c: c != F.trim(c),
        "empty_text": lambda c: F.trim(c) == "",
        "decimal_like": lambda c: F.trim(c).rlike(r"^-?\d+\.0+$"),
        "leading_zero": lambda c: F.trim(c).rlike(r"^0\d+$"),
        "missing": lambda c: c.isNull(),
    }
    row = df.agg(*[F.count_if(t(c)).alias(f"{n}__{k}") for n, t in tests.items() for k, c in raw.items()])
    return stacked(row, keys, "key", {n: "bigint" for n in tests})


def date_candidates(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Columns that hold dates by name, by type or by parse rate."""
    parsed = {}
    for field in df.schema:
        if isinstance(field.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            parsed[field.name] = F.to_date(field.name)
        elif isinstance(field.dataType, T.StringType):
            parsed[field.name] = F.col(field.name).try_cast("date")
    typed = {f.name for f in df.schema if not isinstance(f.dataType, T.StringType)}
    named = {n for n in df.columns if "date" in n.lower() or n.lower() == "ts"}
    row = df.agg(
        *[F.count(n).alias(f"non_null__{n}") for n in parsed],
        *[ratio(F.count(d), F.count(n)).alias(f"parse_rate__{n}") for n, d in parsed.items()],
        *[F.min(d).alias(f"first_date__{n}") for n, d in parsed.items()],
        *[F.max(d).alias(f"last_date__{n}") for n, d in parsed.items()],
    )
    table = stacked(
        row,
        list(parsed),
        "column",
        {"non_null": "bigint", "parse_rate": "double", "first_date": "date", "last_date": "date"},
    )
    by_name = F.col("column").isin(*named) if named else F.lit(False)
    by_type = F.col("column").isin(*(typed & set(parsed))) if typed & set(parsed) else F.lit(False)
    by_rate = F.coalesce(F.col("parse_rate") >= threshold, F.lit(False))
    reason = F.concat_ws(
        ";",
        F.when(by_name, "name_match"),
        F.when(by_type, "datetime_dtype"),
        F.when(by_rate, "high_parse_success"),
    )
    return table.withColumn("reason", reason).where(by_name | by_type | by_rate)


def numeric_string_candidates(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Text columns whose values are numbers once commas and percent signs go."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    row = df.agg(
        *[F.count(c).alias(f"non_null__{c}") for c in texts],
        *[ratio(F.count(parse_number(F.col(c))), F.count(c)).alias(f"parse_rate__{c}") for c in texts],
        *[F.min(parse_number(F.col(c))).alias(f"smallest__{c}") for c in texts],
        *[F.max(parse_number(F.col(c))).alias(f"largest__{c}") for c in texts],
    )
    table = stacked(
        row,
        texts,
        "column",
        {"non_null": "bigint", "parse_rate": "double", "smallest": "double", "largest": "double"},
    )
    return table.where(F.col("parse_rate") >= threshold)


# --- dates ----------------------------------------------------------------------

def distinct_days(df: DataFrame, date: str) -> DataFrame:
    """Observed calendar days."""
    return df.select(F.to_date(date).alias("date")).where("date IS NOT NULL").distinct()


def infer_frequency(df: DataFrame, date: str) -> DataFrame:
    """Daily, monthly, yearly or irregular by median gap and coverage."""
    days = distinct_days(df, date)
    gap = F.datediff("date", F.lag("date").over(Window.orderBy("date")))
    months = F.count_distinct(month_start(F.col("date")))
    years = F.count_distinct(F.year("date"))
    stats = days.withColumn("gap", gap).agg(
        F.count("*").alias("days"),
        F.percentile("gap", F.lit(0.5)).alias("median_gap"),
        (F.count("*") / (F.datediff(F.max("date"), F.min("date")) + 1)).alias("daily_coverage"),
        (
            months
            / (
                F.months_between(month_start(F.max("date")), month_start(F.min("date"))) + 1
            )
        ).alias("monthly_coverage"),
        (years / (F.year(F.max("date")) - F.year(F.min("date")) + 1)).alias("yearly_coverage"),
    )
    g = F.col("median_gap")
    kind = (
        F.when(F.col("days") < 2, "unknown")
        .when((g <= 1.5) | (F.col("daily_coverage") >= 0.7), "daily")
        .when(g.between(25, 35) & (F.col("monthly_coverage") >= 0.7), "monthly")
        .when(g.between(330, 400) & (F.col("yearly_coverage") >= 0.7), "yearly")
        .otherwise("irregular")
    )
    return stats.withColumn("frequency", kind)


def expected_days(df: DataFrame, date: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Every calendar day from the first to the last observed (or given) day."""
    first = F.lit(start).cast("date") if start else F.min(F.to_date(date))
    last = F.lit(end).cast("date") if end else F.max(F.to_date(date))
    return df.agg(first.alias("a"), last.alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date")
    )


def missing_periods(df: DataFrame, date: str, freq: str = "day", start: str | None = None, end: str | None = None) -> DataFrame:
    """Calendar days, months or years without a row."""
    unit = {"day": "DD", "month": "MM", "year": "YYYY"}[freq]
    floor = F.to_date(date) if freq == "day" else F.trunc(F.to_date(date), unit)
    wanted = expected_days(df, date, start, end)
    if freq != "day":
        wanted = wanted.select(F.trunc("date", unit).alias("date")).distinct()
    seen = df.select(floor.alias("date")).distinct()
    return wanted.join(seen, "date", "left_anti").select(F.col("date").alias("missing"))


def missing_examples(missing: DataFrame, limit: int = 20) -> DataFrame:
    """Number of missing periods and the first examples."""
    ranked = missing.withColumn("place", F.row_number().over(Window.orderBy("missing")))
    shown = F.when(F.col("place") <= limit, F.col("missing").cast("string"))
    return ranked.agg(
        F.count("*").alias("missing_count"),
        F.array_join(F.sort_array(F.collect_list(shown)), ", ").alias("examples"),
    )


def large_gaps(df: DataFrame, date: str, days: int) -> DataFrame:
    """Pairs of neighbouring dates more than ``days`` apart."""
    window = Window.orderBy("date")
    return (
        distinct_days(df, date)
        .withColumn("previous", F.lag("date").over(window))
        .withColumn("gap_days", F.datediff("date", "previous"))
        .where(F.col("gap_days") > days)
        .select("previous", F.col("date").alias("next"), "gap_days")
    )


def missing_matrix(df: DataFrame, date: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Missing days per year (rows) and month (columns ``m1``..``m12``)."""
    wanted = expected_days(df, date, start, end)
    seen = distinct_days(df, date).withColumn("seen", F.lit(1))
    months = list(range(1, 13))
    table = (
        wanted.join(seen, "date", "left")
        .withColumns({"year": F.year("date"), "month": F.month("date")})
        .groupBy("year")
        .pivot("month", months)
        .agg(F.count_if(F.col("seen").isNull()))
    )
    return table.select("year", *[F.coalesce(F.col(str(m)), F.lit(0)).alias(f"m{m}") for m in months])


def coverage_against(left: DataFrame, right: DataFrame, left_date: str, right_date: str) -> DataFrame:
    """Days in both tables, in one only, and the calendar days of the union span."""
    a = distinct_days(left, left_date)
    b = distinct_days(right, right_date)
    both = with_origin(a, b, ["date"])
    return both.agg(
        F.count_if(F.col("origin") == "both").alias("shared_days"),
        F.count_if(F.col("origin") == "left_only").alias("left_only_days"),
        F.count_if(F.col("origin") == "right_only").alias("right_only_days"),
        (F.datediff(F.max("date"), F.min("date")) + 1).alias("calendar_days"),
    )


def calendar_coverage(df: DataFrame, date: str, start: str, end: str) -> DataFrame:
    """Observed against expected days of a fixed range."""
    wanted = expected_days(df, date, start, end)
    seen = distinct_days(df, date).withColumn("seen", F.lit(True))
    row = wanted.join(seen, "date", "left").agg(
        F.count("*").alias("expected_days"), F.count("seen").alias("observed_days")
    )
    return row.withColumn("coverage", ratio(F.col("observed_days"), F.col("expected_days")))


def records_per_month(df: DataFrame, date: str) -> DataFrame:
    """Rows per month."""
    return (
        df.groupBy(month_start(F.to_date(date)).alias("month"))
        .agg(F.count("*").alias("rows"))
        .withColumn("year", F.year("month"))
    )


# --- keys -----------------------------------------------------------------------

def foreign_key_check(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None, normalise: bool = False) -> DataFrame:
    """Totals, matches and orphans of a child key against its parent."""
    clean = normalize_key if normalise else (lambda c: c)
    rows = child.select(clean(F.col(key)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    known = (
        parent.select(clean(F.col(parent_key or key)).alias("k"))
        .where("k IS NOT NULL")
        .distinct()
        .withColumn("known", F.lit(True))
    )
    joined = rows.join(known, "k", "left")
    orphan = F.col("k").isNotNull() & F.col("known").isNull()
    return joined.agg(
        F.sum("n").alias("child_rows"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("null_key_rows"),
        F.count("k").alias("child_keys"),
        F.count("known").alias("matched_keys"),
        F.count_if(orphan).alias("orphan_keys"),
        F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("orphan_rows"),
    ).withColumn("orphan_row_pct", ratio(F.col("orphan_rows") * 100.0, F.col("child_rows")))


def orphan_samples(child: DataFrame, parent: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The first ``n`` child keys without a parent."""
    return (
        child.select(key).where(F.col(key).isNotNull()).distinct()
        .join(parent.select(key), key, "left_anti")
        .orderBy(key)
        .limit(n)
    )


def join_quality(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Matches of a parent (left) and child (right) table on a key, with duplicates."""
    a = left.groupBy(key).agg(F.count("*").alias("left_rows"))
    b = right.groupBy(key).agg(F.count("*").alias("right_rows"))
    both = with_origin(a, b, [key])
    total = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))
    origin = F.col("origin")
    return both.agg(
        total(origin == "both", "left_rows").alias("left_matched_rows"),
        total(origin == "left_only", "left_rows").alias("left_unmatched_rows"),
        total(origin == "both", "right_rows").alias("right_matched_rows"),
        total(origin == "right_only", "right_rows").alias("right_unmatched_rows"),
        F.count_if(F.col("left_rows") > 1).alias("left_duplicate_keys"),
        F.count_if(F.col("right_rows") > 1).alias("right_duplicate_keys"),
    ).withColumn(
        "left_match_rate",
        ratio(
            F.col("left_matched_rows"), F.col("left_matched_rows") + F.col("left_unmatched_rows")
        ),
    )


# --- rule tables ----------------------------------------------------------------

def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break each rule, as a long table (``check``, ``count``)."""
    row = df.agg(*[F.count_if(F.coalesce(r, F.lit(False))).alias(f"count__{n}") for n, r in rules.items()])
    return stacked(row, list(rules), "check", {"count": "bigint"})


def promo_quality(items: DataFrame, promotions: DataFrame) -> DataFrame:
    """Promotion ids, discounts, quantities and margins that do not add up."""
    used = items.where("promo_id IS NOT NULL").select("promo_id").distinct()
    known = promotions.select("promo_id").distinct()
    ids = with_origin(used, known, ["promo_id"])
    id_checks = rule_counts(
        ids,
        {
            "promo_ids_in_items_not_promotions": F.col("origin") == "left_only",
            "promotions_with_no_matching_items": F.col("origin") == "right_only",
        },
    )
    discount = F.coalesce("discount_amount", F.lit(0.0))
    rate = F.when(F.abs("discount_rate") > 1.5, F.col("discount_rate") / 100).otherwise(
        F.col("discount_rate")
    )
    margin = ratio(F.col("profit"), F.col("revenue"))
    return id_checks.unionByName(
        rule_counts(
            items,
            {
                "discount_gt_zero_missing_promo_id": (discount > 0) & F.col("promo_id").isNull(),
                "promo_id_zero_blank_discount": F.col("promo_id").isNotNull() & (discount <= 0),
                "negative_discounts": discount < 0,
                "discount_rate_above_100pct": rate > 1,
                "negative_revenue": F.col("revenue") < 0,
                "zero_or_negative_quantity": F.coalesce("quantity", F.lit(0)) <= 0,
                "impossible_margin_values": (margin < -1) | (margin > 1),
            },
        )
    )


def financial_quality(items: DataFrame) -> DataFrame:
    """Suspicious prices, revenues, costs and margins of item lines."""
    lines = items.withColumn("margin", ratio(F.col("profit"), F.col("revenue")))
    fence = quantiles(lines, "margin", {"q1": 0.25, "q3": 0.75}).select(F.struct("q1", "q3")).scalar()
    lines = lines.withColumn("fence", fence)
    low = F.col("fence.q1") - 1.5 * (F.col("fence.q3") - F.col("fence.q1"))
    high = F.col("fence.q3") + 1.5 * (F.col("fence.q3") - F.col("fence.q1"))
    return rule_counts(
        lines,
        {
            "zero_or_negative_item_price": F.col("unit_price") <= 0,
            "negative_revenue": F.col("revenue") < 0,
            "zero_revenue": F.col("revenue") == 0,
            "negative_cogs": F.col("cost") < 0,
            "negative_margin_ratio": F.col("margin") < 0,
            "margin_ratio_above_1": F.col("margin") > 1,
            "extreme_margin_iqr_outliers": (F.col("margin") < low) | (F.col("margin") > high),
        },
    )


def traffic_quality(traffic: DataFrame) -> DataFrame:
    """Range, missing days, repeated day-source pairs and bad sessions of web traffic."""
    pairs = traffic.groupBy("date", "traffic_source").agg(
        F.count("*").alias("copies"),
        F.count_if(F.col("sessions").isNull()).alias("missing"),
        F.count_if(F.col("sessions") <= 0).alias("non_positive"),
    )
    span = F.datediff(F.max("date"), F.min("date")) + 1
    return pairs.agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        (span - F.count_distinct("date")).alias("missing_dates"),
        F.count_distinct("traffic_source").alias("sources"),
        F.sum(F.col("copies") - 1).alias("duplicate_date_sources"),
        F.sum("missing").alias("missing_sessions"),
        F.sum("non_positive").alias("non_positive_sessions"),
    )


def data_availability(tables: Mapping[str, tuple[DataFrame, str]], cutoff: str) -> DataFrame:
    """Rows, date range and rows after a cutoff day per table."""
    parts = []
    for name, (df, date) in tables.items():
        day = F.to_date(date)
        parts.append(
            df.agg(
                F.count("*").alias("rows"),
                F.min(day).alias("first_date"),
                F.max(day).alias("last_date"),
                F.count_if(day > F.lit(cutoff).cast("date")).alias("rows_after_cutoff"),
            ).select(F.lit(name).alias("table"), F.lit(date).alias("date_column"), "*")
        )
    return union_all(parts)


def reconcile_series(left: DataFrame, right: DataFrame, value: str, key: str = "date") -> DataFrame:
    """Agreement of two series on their shared keys."""
    joined = left.select(key, F.col(value).alias("a")).join(
        right.select(key, F.col(value).alias("b")), key
    )
    difference = F.col("a") - F.col("b")
    return joined.agg(
        F.count("*").alias("overlapping"),
        safe_corr(F.col("a"), F.col("b")).alias("correlation"),
        F.sum(difference).alias("total_difference"),
        F.avg(F.abs(difference)).alias("mean_absolute_difference"),
    )


def distribution_summary(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.01, 0.05, 0.5, 0.95, 0.99)) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.inline(pairs))
    stats = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    marks = quantiles(long, "value", {f"p{round(p * 100)}": p for p in probs}, ["column"])
    return stats.join(marks, "column", "left")


def duplicate_names(products: DataFrame) -> DataFrame:
    """Names shared by several products with their cheapest and dearest product."""
    tied = lambda pick, sign: pick(
        F.struct(F.col("price"), F.col("product_id") * sign)
    )
    return (
        products.groupBy("product_name")
        .agg(
            F.count("*").alias("products"),
            tied(F.min, 1).alias("low"),
            tied(F.max, -1).alias("high"),
        )
        .where("products > 1")
        .select(
            "product_name",
            "products",
            F.col("low.price").alias("min_price"),
            F.col("low.col2").alias("min_price_product"),
            F.col("high.price").alias("max_price"),
            (-F.col("high.col2")).alias("max_price_product"),
        )
    )


def returns_quality(items: DataFrame, returns: DataFrame) -> DataFrame:
    """Returns that do not fit the lines they belong to."""
    keys = ["order_id", "product_id"]
    ordered = items.groupBy(*keys).agg(
        F.sum("quantity").alias("ordered_quantity"),
        F.sum("revenue").alias("item_revenue"),
        F.min("order_date").alias("order_date"),
        F.max("category").alias("category"),
        F.max("size").alias("size"),
    )
    returned = returns.groupBy(*keys).agg(
        F.sum("return_quantity").alias("returned_quantity"),
        F.sum("refund_amount").alias("refund"),
        F.min("return_date").alias("first_return_date"),
    )
    joined = with_origin(ordered, returned, keys)
    line = F.col("origin") != "right_only"
    pair_checks = rule_counts(
        joined,
        {
            "returns_with_no_matching_order_item": F.col("origin") == "right_only",
            "returned_qty_gt_ordered_qty": F.col("returned_quantity") > F.col("ordered_quantity"),
            "refund_gt_item_revenue": F.round(F.col("refund") - F.col("item_revenue"), 4) > 0,
            "missing_category_or_size": line & (F.col("category").isNull() | F.col("size").isNull()),
            "return_before_order_date": F.col("first_return_date") < F.col("order_date"),
        },
    )
    row_checks = rule_counts(
        returns,
        {
            "negative_return_quantity": F.col("return_quantity") < 0,
            "negative_refund_amount": F.col("refund_amount") < 0,
        },
    )
    return pair_checks.unionByName(row_checks)


def table_quality(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str] = (), date: str | None = None) -> DataFrame:
    """Rule counts of any table plus repeated keys and its date span."""
    parts = [rule_counts(df, rules)]
    if keys:
        repeats = duplicate_keys(df, keys).agg(
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("count")
        )
        parts.append(repeats.select(F.lit("duplicate_keys").alias("check"), F.col("count").cast("bigint")))
    if date:
        span = df.agg((F.datediff(F.max(date), F.min(date)) + 1).cast("bigint").alias("count"))
        parts.append(span.select(F.lit("date_span_days").alias("check"), "count"))
    return union_all(parts)


def order_quality(orders: DataFrame) -> DataFrame:
    """Missing dates or revenue, non-positive revenue, status and payment differences."""
    gap = F.abs(F.col("revenue") - F.col("payment_value"))
    return table_quality(
        orders,
        {
            "missing_order_date": F.col("order_date").isNull(),
            "missing_revenue": F.col("revenue").isNull(),
            "non_positive_revenue": F.col("revenue") <= 0,
            "cancelled_like": F.lower("order_status").rlike("cancel|failed|void"),
            "returned_like": F.lower("order_status").rlike("return|refund"),
            "payment_differs": gap > 0.01,
        },
        keys=["order_id"],
    )
