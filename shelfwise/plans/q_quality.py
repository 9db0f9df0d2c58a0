"""Data-quality queries."""

from pyspark.sql import functions as F

from shelfwise.functions import scalars as S
from shelfwise.operators import joins
from shelfwise.operators import quality as Q
from shelfwise.plans.registry import query


TABLES = {
    "region": "r_regionkey:int r_name:string",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
    "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz o_orderpriority:string",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double l_extendedprice:double "
    "l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:timestamp_ntz",
    "events": "event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double props:string",
}

SHAPE = "SELECT '{t}' AS \"table\", count(*) AS rows, {n} AS columns, true AS present FROM {t}"


@query(
    "Q01_shape_summary",
    "table:s rows:i columns:i present:b",
    " UNION ALL ".join(SHAPE.format(t=t, n=len(c.split())) for t, c in TABLES.items()) + " UNION ALL SELECT 'shipments', NULL, NULL, false",
)
def _(shop):
    return Q.shape_summary({t: shop.table(t) for t in TABLES}, [*TABLES, "shipments"])


PROFILE = """
SELECT '{t}' AS "table", '{c}' AS "column", '{kind}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls,
       count(DISTINCT {c}) AS "distinct"
FROM {t}"""


@query(
    "Q02_column_profile",
    "table:s column:s dtype:s non_null:i nulls:i distinct:i",
    " UNION ALL ".join(
        PROFILE.format(t=t, c=c.split(":")[0], kind=c.split(":")[1]) for t, columns in TABLES.items() for c in columns.split()
    ),
)
def _(shop):
    return Q.union_all([Q.column_profile(shop.table(t)).withColumn("table", F.lit(t)) for t in TABLES])


@query("Q02b_column_samples", "column:s samples:s", """
SELECT 'p_type' AS "column", string_agg(v, ', ' ORDER BY v) AS samples FROM (SELECT DISTINCT p_type AS v FROM part ORDER BY v LIMIT 5)
UNION ALL
SELECT 'p_size', string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) FROM (SELECT DISTINCT p_size AS v FROM part ORDER BY v LIMIT 5)
UNION ALL
SELECT 'p_partkey', string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) FROM (SELECT DISTINCT p_partkey AS v FROM part ORDER BY v LIMIT 5)
UNION ALL
SELECT 'p_name', string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT p_name AS v FROM part ORDER BY v LIMIT 5)
UNION ALL
SELECT 'p_brand', string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT p_brand AS v FROM part ORDER BY v LIMIT 5)""")
def _(shop):
    return Q.column_profile(shop.table("part").drop("p_retailprice"))


@query("Q03_missing_summary", "column:s missing:i missing_pct:d mostly_missing:b", """
SELECT "column", missing, 100.0 * missing / n AS missing_pct, 100.0 * missing / n > 50 AS mostly_missing
FROM (SELECT count(*) AS n, count(*) - count(promo_id) AS a, count(*) - count(promo_id_2) AS b,
             count(*) - count(quantity) AS c FROM x_items) s,
LATERAL (VALUES ('promo_id', a), ('promo_id_2', b), ('quantity', c)) v("column", missing)""")
def _(shop):
    return Q.missing_summary(shop.items.select("promo_id", "promo_id_2", "quantity"))


@query("Q04_duplicate_rows", "rows:i duplicates:i duplicate_pct:d", """
SELECT sum(n) AS rows, sum(n - 1) AS duplicates, 100.0 * sum(n - 1) / sum(n) AS duplicate_pct
FROM (SELECT count(*) AS n FROM lineitem
      GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
               l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)""")
def _(shop):
    return Q.duplicate_rows(shop.table("lineitem"))


@query("Q05_duplicate_keys", "l_orderkey:i l_linenumber:i copies:i", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1""")
def _(shop):
    return Q.duplicate_keys(shop.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("Q06_normalize_key", "raw:s key:s rows:i", """
SELECT raw, CASE WHEN trim(raw) IN ('', 'nan') THEN NULL
                 ELSE regexp_replace(trim(raw), '^(-?[0-9]+)\\.0+$', '\\1') END AS key, count(*) AS rows
FROM (SELECT CASE p_size % 4 WHEN 0 THEN ' ' || CAST(p_size AS VARCHAR) || '.0'
                             WHEN 1 THEN CAST(p_size AS VARCHAR) || ' '
                             WHEN 2 THEN 'nan' ELSE p_brand END AS raw FROM part)
GROUP BY 1, 2""")
def _(shop):
    size, text = F.col("size"), F.col("size").cast("string")
    raw = (
        F.when(size % 4 == 0, F.concat(F.lit(" "), text, F.lit(".0")))
        .when(size % 4 == 1, F.concat(text, F.lit(" ")))
        .when(size % 4 == 2, "nan")
        .otherwise(F.col("segment"))
    )
    keyed = shop.products.select(raw.alias("raw"))
    return keyed.groupBy("raw", S.normalize_key(F.col("raw")).alias("key")).agg(
        F.count("*").alias("rows")
    )


@query("Q07_key_format", "key:s outer_whitespace:i empty_text:i decimal_like:i leading_zero:i missing:i", """
SELECT 'retail_text' AS key, 0 AS outer_whitespace, 0 AS empty_text,
       sum(CASE WHEN regexp_matches(v, '^-?[0-9]+\\.0+$') THEN 1 ELSE 0 END) AS decimal_like,
       0 AS leading_zero, 0 AS missing
FROM (SELECT CAST(p_retailprice AS VARCHAR) AS v FROM part)
UNION ALL
SELECT 'promo_id', 0, 0, 0, 0, sum(CASE WHEN promo_id IS NULL THEN 1 ELSE 0 END) FROM x_items
UNION ALL
SELECT 'padded', count(*), 0, 0, sum(CASE WHEN p_size >= 0 THEN 1 ELSE 0 END), 0 FROM part""")
def _(shop):
    prices = shop.table("part").select(F.col("p_retailprice").cast("string").alias("retail_text"))
    padded = shop.table("part").select(
        F.concat(F.lit(" 0"), F.col("p_size").cast("string")).alias("padded")
    )
    return Q.union_all(
        [
            Q.key_format_diagnostics(prices, ["retail_text"]),
            Q.key_format_diagnostics(shop.items, ["promo_id"]),
            Q.key_format_diagnostics(padded, ["padded"]),
        ]
    )


@query("Q08_repair_ratio", "traffic_source:s bounce_day:t repaired:d", """
SELECT traffic_source, date AS bounce_day, CASE WHEN abs(v) > 1.5 THEN v / 100 ELSE v END AS repaired
FROM (SELECT traffic_source, date, CASE WHEN day(date) % 2 = 0 THEN 100 * bounce_rate ELSE bounce_rate END AS v
      FROM x_traffic)""")
def _(shop):
    mixed = F.when(F.dayofmonth("date") % 2 == 0, F.col("bounce_rate") * 100).otherwise(
        F.col("bounce_rate")
    )
    return shop.traffic.select(
        "traffic_source", F.col("date").alias("bounce_day"), S.repair_ratio(mixed).alias("repaired")
    )


@query("Q09_date_candidates", "column:s non_null:i parse_rate:d first_date:t last_date:t reason:s", """
SELECT 'o_orderdate' AS "column", count(*) AS non_null, 1.0 AS parse_rate,
       min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date,
       'name_match;datetime_dtype;high_parse_success' AS reason FROM orders
UNION ALL
SELECT 'order_text', count(*), 1.0, min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)),
       'high_parse_success' FROM orders""")
def _(shop):
    text = F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_text")
    return Q.date_candidates(shop.table("orders").select("*", text))


@query("Q10_numeric_strings", "column:s non_null:i parse_rate:d smallest:d largest:d", """
SELECT 'price_text' AS "column", count(*) AS non_null, 1.0 AS parse_rate,
       min(p_retailprice) AS smallest, max(p_retailprice) AS largest FROM part
UNION ALL
SELECT 'size_text', count(*), 1.0, min(p_size), max(p_size) FROM part""")
def _(shop):
    df = shop.table("part").select(
        "p_name",
        F.format_number("p_retailprice", 2).alias("price_text"),
        F.concat(F.col("p_size").cast("string"), F.lit("%")).alias("size_text"),
    )
    return Q.numeric_string_candidates(df)


@query("Q11_infer_frequency", "source:s days:i median_gap:d daily_coverage:d monthly_coverage:d yearly_coverage:d frequency:s", """
WITH d AS (SELECT 'orders' AS source, order_date AS date FROM x_orders GROUP BY 2
           UNION ALL SELECT 'inventory', last_day(order_date) FROM x_orders GROUP BY 2),
     g AS (SELECT source, date, date - lag(date) OVER (PARTITION BY source ORDER BY date) AS gap FROM d),
     s AS (SELECT source, count(*) AS days, quantile_cont(gap, 0.5) AS median_gap,
                  count(*) / (max(date) - min(date) + 1.0) AS daily_coverage,
                  count(DISTINCT date_trunc('month', date)) /
                    (date_diff('month', min(date), max(date)) + 1.0) AS monthly_coverage,
                  count(DISTINCT year(date)) / (max(year(date)) - min(year(date)) + 1.0) AS yearly_coverage
           FROM g GROUP BY source)
SELECT *, CASE WHEN median_gap <= 1.5 OR daily_coverage >= 0.7 THEN 'daily'
               WHEN median_gap BETWEEN 25 AND 35 AND monthly_coverage >= 0.7 THEN 'monthly'
               ELSE 'irregular' END AS frequency FROM s""")
def _(shop):
    ends = shop.orders.select(F.last_day("order_date").alias("order_date"))
    return Q.infer_frequency(shop.orders, "order_date").withColumn("source", F.lit("orders")).unionByName(
        Q.infer_frequency(ends, "order_date").withColumn("source", F.lit("inventory"))
    )


@query("Q12_missing_periods", "kind:s missing_count:i examples:s", """
WITH m AS (SELECT date FROM x_days WHERE date NOT IN (SELECT order_date FROM x_orders)),
     r AS (SELECT date, row_number() OVER (ORDER BY date) AS place FROM m)
SELECT 'day' AS kind, count(*) AS missing_count,
       coalesce(string_agg(CASE WHEN place <= 20 THEN CAST(date AS VARCHAR) END, ', ' ORDER BY date), '') AS examples
FROM r
UNION ALL SELECT 'month', 0, ''""")
def _(shop):
    days = Q.missing_examples(Q.missing_periods(shop.orders, "order_date"))
    months = Q.missing_examples(Q.missing_periods(shop.orders, "order_date", "month"))
    return days.withColumn("kind", F.lit("day")).unionByName(months.withColumn("kind", F.lit("month")))


@query("Q13_large_gaps", "previous:t next:t gap_days:i", """
SELECT previous, date AS next, date - previous AS gap_days
FROM (SELECT date, lag(date) OVER (ORDER BY date) AS previous
      FROM (SELECT DISTINCT order_date AS date FROM x_orders)) WHERE date - previous > 1""")
def _(shop):
    return Q.large_gaps(shop.orders, "order_date", 1)


@query("Q14_missing_matrix", "year:i " + " ".join(f"m{m}:i" for m in range(1, 13)), f"""
SELECT year(date) AS year,
{", ".join(f"sum(CASE WHEN month(date) = {m} AND o.order_date IS NULL THEN 1 ELSE 0 END) AS m{m}" for m in range(1, 13))}
FROM x_days LEFT JOIN (SELECT DISTINCT order_date FROM x_orders) o ON date = o.order_date GROUP BY 1""")
def _(shop):
    return Q.missing_matrix(shop.orders, "order_date")


@query("Q15_coverage_against", "shared_days:i left_only_days:i right_only_days:i calendar_days:i", """
WITH a AS (SELECT DISTINCT order_date AS d FROM x_orders), b AS (SELECT DISTINCT ship_date AS d FROM x_items),
     j AS (SELECT coalesce(a.d, b.d) AS d, a.d AS l, b.d AS r FROM a FULL JOIN b ON a.d = b.d)
SELECT sum(CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN 1 ELSE 0 END) AS shared_days,
       sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END) AS left_only_days,
       sum(CASE WHEN l IS NULL THEN 1 ELSE 0 END) AS right_only_days,
       max(d) - min(d) + 1 AS calendar_days FROM j""")
def _(shop):
    return Q.coverage_against(shop.orders, shop.items, "order_date", "ship_date")


@query("Q15b_calendar_coverage", "expected_days:i observed_days:i coverage:d", """
SELECT 1096 AS expected_days, count(DISTINCT order_date) AS observed_days,
       count(DISTINCT order_date) / 1096.0 AS coverage
FROM x_orders WHERE order_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")
def _(shop):
    return Q.calendar_coverage(shop.orders, "order_date", "1996-01-01", "1998-12-31")


@query("Q16_records_per_month", "month:t year:i rows:i", """
SELECT CAST(date_trunc('month', ship_date) AS DATE) AS month,
       year(date_trunc('month', ship_date)) AS year, count(*) AS rows FROM x_items GROUP BY 1, 2""")
def _(shop):
    return Q.records_per_month(shop.items, "ship_date")


FK = """
SELECT {name} AS relation, count(*) AS child_rows, sum(CASE WHEN c.k IS NULL THEN 1 ELSE 0 END) AS null_key_rows,
       count(DISTINCT c.k) AS child_keys, count(DISTINCT p.k) AS matched_keys,
       count(DISTINCT c.k) - count(DISTINCT p.k) AS orphan_keys,
       sum(CASE WHEN c.k IS NOT NULL AND p.k IS NULL THEN 1 ELSE 0 END) AS orphan_rows,
       100.0 * sum(CASE WHEN c.k IS NOT NULL AND p.k IS NULL THEN 1 ELSE 0 END) / count(*) AS orphan_row_pct
FROM (SELECT {child}) c LEFT JOIN (SELECT DISTINCT {parent}) p ON c.k = p.k"""


@query(
    "Q17_foreign_keys",
    "relation:s child_rows:i null_key_rows:i child_keys:i matched_keys:i orphan_keys:i orphan_rows:i orphan_row_pct:d",
    " UNION ALL ".join([
        FK.format(name="'items_orders'", child="order_id AS k FROM x_items", parent="order_id AS k FROM x_orders"),
        FK.format(name="'items_promotions'", child="promo_id_2 AS k FROM x_items",
                  parent="promo_id AS k FROM x_promotions"),
        FK.format(name="'returns_products'", child="product_id AS k FROM x_returns", parent="product_id AS k FROM x_products"),
        FK.format(name="'customers_geography'", child="zip AS k FROM x_customers", parent="zip AS k FROM x_geography"),
        FK.format(name="'orders_geography'", child="zip AS k FROM x_orders LEFT JOIN x_customers USING (customer_id)",
                  parent="zip AS k FROM x_geography"),
    ]),
)
def _(shop):
    first = Q.foreign_key_check(shop.items, shop.orders, "order_id")
    second = Q.foreign_key_check(shop.items, shop.promotions, "promo_id_2", "promo_id", normalise=True)
    placed = shop.orders.join(shop.customers.select("customer_id", "zip"), "customer_id", "left")
    found = {
        "items_orders": first,
        "items_promotions": second,
        "returns_products": Q.foreign_key_check(shop.returns, shop.products, "product_id"),
        "customers_geography": Q.foreign_key_check(shop.customers, shop.geography, "zip"),
        "orders_geography": Q.foreign_key_check(placed, shop.geography, "zip"),
    }
    return Q.union_all([df.withColumn("relation", F.lit(name)) for name, df in found.items()])


@query("Q18_orphan_samples", "promo_id:s", """
SELECT DISTINCT promo_id_2 AS promo_id FROM x_items
WHERE promo_id_2 IS NOT NULL AND promo_id_2 NOT IN (SELECT promo_id FROM x_promotions)
ORDER BY 1 LIMIT 20""")
def _(shop):
    child = shop.items.select(F.col("promo_id_2").alias("promo_id"))
    return Q.orphan_samples(child, shop.promotions, "promo_id")


@query("Q19_join_quality", "left_matched_rows:i left_unmatched_rows:i right_matched_rows:i right_unmatched_rows:i left_duplicate_keys:i right_duplicate_keys:i left_match_rate:d", """
WITH a AS (SELECT order_id, count(*) AS l FROM x_orders GROUP BY 1),
     b AS (SELECT order_id, count(*) AS r FROM x_items GROUP BY 1)
SELECT coalesce(sum(CASE WHEN r IS NOT NULL THEN l END), 0) AS left_matched_rows,
       coalesce(sum(CASE WHEN r IS NULL THEN l END), 0) AS left_unmatched_rows,
       coalesce(sum(CASE WHEN l IS NOT NULL THEN r END), 0) AS right_matched_rows,
       coalesce(sum(CASE WHEN l IS NULL THEN r END), 0) AS right_unmatched_rows,
       sum(CASE WHEN l > 1 THEN 1 ELSE 0 END) AS left_duplicate_keys,
       sum(CASE WHEN r > 1 THEN 1 ELSE 0 END) AS right_duplicate_keys,
       1.0 * sum(CASE WHEN r IS NOT NULL THEN l END) / sum(l) AS left_match_rate
FROM a FULL JOIN b ON a.order_id = b.order_id""")
def _(shop):
    return Q.join_quality(shop.orders, shop.items, "order_id")


@query("Q20_promo_quality", "check:s count:i", """
WITH u AS (SELECT DISTINCT promo_id FROM x_items WHERE promo_id IS NOT NULL),
     p AS (SELECT promo_id FROM x_promotions),
     m AS (SELECT *, profit / nullif(revenue, 0) AS margin FROM x_lines)
SELECT 'promo_ids_in_items_not_promotions' AS "check", (SELECT count(*) FROM u WHERE promo_id NOT IN (SELECT promo_id FROM p)) AS count
UNION ALL SELECT 'promotions_with_no_matching_items', (SELECT count(*) FROM p WHERE promo_id NOT IN (SELECT promo_id FROM u))
UNION ALL SELECT 'discount_gt_zero_missing_promo_id', count(*) FROM m WHERE discount_amount > 0 AND promo_id IS NULL
UNION ALL SELECT 'promo_id_zero_blank_discount', count(*) FROM m WHERE discount_amount <= 0 AND promo_id IS NOT NULL
UNION ALL SELECT 'negative_discounts', count(*) FROM m WHERE discount_amount < 0
UNION ALL SELECT 'discount_rate_above_100pct', count(*) FROM m WHERE discount_rate > 1
UNION ALL SELECT 'negative_revenue', count(*) FROM m WHERE revenue < 0
UNION ALL SELECT 'zero_or_negative_quantity', count(*) FROM m WHERE quantity <= 0
UNION ALL SELECT 'impossible_margin_values', count(*) FROM m WHERE margin < -1 OR margin > 1""")
def _(shop):
    return Q.promo_quality(shop.lines, shop.promotions)


@query("Q21_financial_quality", "check:s count:i", """
WITH m AS (SELECT *, profit / nullif(revenue, 0) AS margin FROM x_lines),
     f AS (SELECT quantile_cont(margin, 0.25) AS q1, quantile_cont(margin, 0.75) AS q3 FROM m)
SELECT 'zero_or_negative_item_price' AS "check", count(*) AS count FROM m WHERE unit_price <= 0
UNION ALL SELECT 'negative_revenue', count(*) FROM m WHERE revenue < 0
UNION ALL SELECT 'zero_revenue', count(*) FROM m WHERE revenue = 0
UNION ALL SELECT 'negative_cogs', count(*) FROM m WHERE cost < 0
UNION ALL SELECT 'negative_margin_ratio', count(*) FROM m WHERE margin < 0
UNION ALL SELECT 'margin_ratio_above_1', count(*) FROM m WHERE margin > 1
UNION ALL SELECT 'extreme_margin_iqr_outliers', count(*) FROM m, f
  WHERE margin < q1 - 1.5 * (q3 - q1) OR margin > q3 + 1.5 * (q3 - q1)""")
def _(shop):
    return Q.financial_quality(shop.lines)


@query("Q22_traffic_quality", "first_date:t last_date:t missing_dates:i sources:i duplicate_date_sources:i missing_sessions:i non_positive_sessions:i", """
SELECT min(date) AS first_date, max(date) AS last_date,
       max(date) - min(date) + 1 - count(DISTINCT date) AS missing_dates,
       count(DISTINCT traffic_source) AS sources, 0 AS duplicate_date_sources,
       sum(CASE WHEN sessions IS NULL THEN 1 ELSE 0 END) AS missing_sessions,
       sum(CASE WHEN sessions <= 0 THEN 1 ELSE 0 END) AS non_positive_sessions FROM x_traffic""")
def _(shop):
    return Q.traffic_quality(shop.traffic)


@query("Q23_data_availability", "table:s date_column:s rows:i first_date:t last_date:t rows_after_cutoff:i", """
SELECT 'orders' AS "table", 'order_date' AS date_column, count(*) AS rows, min(order_date) AS first_date,
       max(order_date) AS last_date, sum(CASE WHEN order_date > DATE '2000-12-31' THEN 1 ELSE 0 END) AS rows_after_cutoff
FROM x_orders
UNION ALL SELECT 'items', 'ship_date', count(*), min(ship_date), max(ship_date),
       sum(CASE WHEN ship_date > DATE '2000-12-31' THEN 1 ELSE 0 END) FROM x_items""")
def _(shop):
    return Q.data_availability(
        {"orders": (shop.orders, "order_date"), "items": (shop.items, "ship_date")}, "2000-12-31"
    )


@query("Q24_reconcile_series", "overlapping:i correlation:d total_difference:d mean_absolute_difference:d", """
WITH a AS (SELECT order_date AS date, sum(order_value) AS v FROM x_orders GROUP BY 1)
SELECT count(*) AS overlapping, corr(a.v, s.revenue) AS correlation, sum(a.v - s.revenue) AS total_difference,
       avg(abs(a.v - s.revenue)) AS mean_absolute_difference FROM a JOIN x_sales s ON a.date = s.date""")
def _(shop):
    rebuilt = shop.orders.groupBy(F.col("order_date").alias("date")).agg(
        F.sum("order_value").alias("revenue")
    )
    return Q.reconcile_series(rebuilt, shop.sales, "revenue")


DIST = """
SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
       max({c}) AS max, quantile_cont({c}, 0.01) AS p1, quantile_cont({c}, 0.05) AS p5,
       quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.95) AS p95, quantile_cont({c}, 0.99) AS p99 FROM x_items"""


@query(
    "Q25_distribution_summary",
    "column:s count:i mean:d std:d min:d max:d p1:d p5:d p50:d p95:d p99:d",
    DIST.format(c="unit_price") + " UNION ALL " + DIST.format(c="quantity"),
)
def _(shop):
    return Q.distribution_summary(shop.items, ["unit_price", "quantity"])


@query("Q26_duplicate_names", "product_name:s products:i min_price:d min_price_product:i max_price:d max_price_product:i", """
WITH r AS (SELECT *, count(*) OVER (PARTITION BY product_name) AS n,
                  row_number() OVER (PARTITION BY product_name ORDER BY price, product_id) AS lo,
                  row_number() OVER (PARTITION BY product_name ORDER BY price DESC, product_id) AS hi
           FROM x_products)
SELECT product_name, max(n) AS products, max(CASE WHEN lo = 1 THEN price END) AS min_price,
       max(CASE WHEN lo = 1 THEN product_id END) AS min_price_product,
       max(CASE WHEN hi = 1 THEN price END) AS max_price,
       max(CASE WHEN hi = 1 THEN product_id END) AS max_price_product
FROM r WHERE n > 1 GROUP BY 1""")
def _(shop):
    return Q.duplicate_names(shop.products)


@query("Q27_returns_quality", "check:s count:i", """
WITH o AS (SELECT order_id, product_id, sum(quantity) AS q, sum(revenue) AS r, min(order_date) AS d
           FROM x_lines GROUP BY 1, 2),
     t AS (SELECT order_id, product_id, sum(return_quantity) AS rq, sum(refund_amount) AS rr,
                  min(return_date) AS rd FROM x_returns GROUP BY 1, 2),
     j AS (SELECT * FROM o JOIN t USING (order_id, product_id))
SELECT 'returns_with_no_matching_order_item' AS "check", 0 AS count
UNION ALL SELECT 'returned_qty_gt_ordered_qty', count(*) FROM j WHERE rq > q
UNION ALL SELECT 'refund_gt_item_revenue', count(*) FROM j WHERE round(rr - r, 4) > 0
UNION ALL SELECT 'missing_category_or_size', 0
UNION ALL SELECT 'return_before_order_date', count(*) FROM j WHERE rd < d
UNION ALL SELECT 'negative_return_quantity', count(*) FROM x_returns WHERE return_quantity < 0
UNION ALL SELECT 'negative_refund_amount', count(*) FROM x_returns WHERE refund_amount < 0""")
def _(shop):
    return Q.returns_quality(shop.lines, shop.returns)


@query("Q28_table_quality", "check:s count:i", """
SELECT 'missing_delivery' AS "check", count(*) FILTER (delivery_date IS NULL) AS count FROM x_shipments
UNION ALL SELECT 'delivered_before_order', count(*) FILTER (delivery_date < order_date)
  FROM x_shipments JOIN x_orders USING (order_id)
UNION ALL SELECT 'missing_estimate', count(*) FILTER (estimated_delivery_date IS NULL) FROM x_shipments
UNION ALL SELECT 'duplicate_keys', 0
UNION ALL SELECT 'date_span_days', max(ship_date) - min(ship_date) + 1 FROM x_shipments
UNION ALL SELECT 'rating_outside_1_5', count(*) FILTER (rating < 1 OR rating > 5) FROM x_reviews
UNION ALL SELECT 'negative_stock', count(*) FILTER (stock_on_hand < 0) FROM x_inventory
UNION ALL SELECT 'non_positive_payment', count(*) FILTER (payment_value <= 0) FROM x_payments""")
def _(shop):
    shipments = shop.shipments.join(shop.orders.select("order_id", "order_date"), "order_id")
    return Q.union_all(
        [
            Q.table_quality(
                shipments,
                {
                    "missing_delivery": F.col("delivery_date").isNull(),
                    "delivered_before_order": F.col("delivery_date") < F.col("order_date"),
                    "missing_estimate": F.col("estimated_delivery_date").isNull(),
                },
                keys=["order_id"],
                date="ship_date",
            ),
            Q.table_quality(shop.reviews, {"rating_outside_1_5": ~F.col("rating").between(1, 5)}),
            Q.table_quality(shop.inventory, {"negative_stock": F.col("stock_on_hand") < 0}),
            Q.table_quality(shop.payments, {"non_positive_payment": F.col("payment_value") <= 0}),
        ]
    )


@query("Q29_order_quality", "check:s count:i", """
WITH o AS (SELECT o.order_id, order_date, order_status, order_value, sum(revenue) AS revenue
           FROM x_orders o LEFT JOIN x_items i ON i.order_id = o.order_id GROUP BY ALL)
SELECT 'missing_order_date' AS "check", count(*) FILTER (order_date IS NULL) AS count FROM o
UNION ALL SELECT 'missing_revenue', count(*) FILTER (revenue IS NULL) FROM o
UNION ALL SELECT 'non_positive_revenue', count(*) FILTER (revenue <= 0) FROM o
UNION ALL SELECT 'cancelled_like', 0 UNION ALL SELECT 'returned_like', 0
UNION ALL SELECT 'payment_differs', count(*) FILTER (abs(revenue - order_value) > 0.01) FROM o
UNION ALL SELECT 'duplicate_keys', 0""")
def _(shop):
    orders = joins.aggregate_then_join(
        shop.orders, shop.items, ["order_id"], {"revenue": F.sum("revenue")}
    )
    return Q.order_quality(orders.withColumnRenamed("order_value", "payment_value"))
