"""SQL building blocks of the checks, written apart from the Spark frames."""

from shelfwise.plans.registry import view

view("x_orders", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
       o_orderstatus AS order_status, o_orderpriority AS payment_method, o_totalprice AS order_value
FROM orders
""")
view("x_items", """
SELECT l_orderkey AS order_id, l_partkey AS product_id, l_quantity AS quantity,
       l_extendedprice / nullif(l_quantity, 0) AS unit_price, l_extendedprice AS gross,
       l_discount AS discount_rate, l_extendedprice * l_discount AS discount_amount,
       l_extendedprice * (1 - l_discount) AS revenue, l_extendedprice * l_tax AS shipping_fee,
       CASE WHEN l_discount >= 0.05 THEN 'PROMO-' || CAST(l_partkey % 50 + 1 AS VARCHAR) END AS promo_id,
       CASE WHEN l_discount > 0 AND l_tax >= 0.08
            THEN 'PROMO-' || CAST(l_suppkey % 60 + 1 AS VARCHAR) END AS promo_id_2,
       l_discount > 0 AS promo_used, l_returnflag AS return_flag, l_linestatus AS line_status,
       l_tax AS tax, CAST(l_shipdate AS DATE) AS ship_date
FROM lineitem
""")
view("x_products", """
SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS segment,
       p_size AS size, p_retailprice AS price, p_retailprice * CAST(0.6 AS DOUBLE) AS cogs
FROM part
""")
view("x_customers", """
SELECT c_custkey AS customer_id, c_nationkey AS zip, c_mktsegment AS channel, c_acctbal AS balance
FROM customer
""")
view("x_geography", """
SELECT n_nationkey AS zip, r_name AS region, n_name AS city
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
view("x_sold", "SELECT * FROM x_items JOIN x_orders USING (order_id)")
view("x_lines", """
SELECT *, quantity * cogs AS cost, revenue - quantity * cogs AS profit
FROM x_sold JOIN x_products USING (product_id)
""")
view("x_sales", """
SELECT order_date AS date, sum(revenue) AS revenue, sum(cost) AS cogs,
       count(DISTINCT order_id) AS orders, sum(quantity) AS quantity
FROM x_lines GROUP BY 1
""")
view("x_days", """
SELECT CAST(unnest(generate_series((SELECT min(order_date) FROM x_orders)::TIMESTAMP,
                                   (SELECT max(order_date) FROM x_orders)::TIMESTAMP,
                                   INTERVAL 1 DAY)) AS DATE) AS date
""")
view("x_daily", """
SELECT d.date, coalesce(s.revenue, 0) AS revenue, coalesce(s.cogs, 0) AS cogs,
       coalesce(s.orders, 0) AS orders, coalesce(s.quantity, 0) AS quantity,
       s.date IS NOT NULL AS was_observed
FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM x_sales)::TIMESTAMP,
                                         (SELECT max(date) FROM x_sales)::TIMESTAMP,
                                         INTERVAL 1 DAY)) AS DATE) AS date) d
LEFT JOIN x_sales s ON s.date = d.date
""")
view("x_monthly", """
SELECT CAST(date_trunc('month', date) AS DATE) AS month, sum(revenue) AS revenue, sum(cogs) AS cogs,
       sum(orders) AS orders, sum(quantity) AS quantity
FROM x_sales GROUP BY 1
""")
view("x_payments", """
SELECT order_id, payment_method, order_value AS payment_value, order_id % 12 + 1 AS installments
FROM x_orders
""")
view("x_shipments", """
SELECT order_id, min(ship_date) AS ship_date, max(ship_date) AS delivery_date,
       sum(shipping_fee) AS shipping_fee,
       CASE WHEN order_id % 3 <> 0 THEN min(ship_date) + 900 END AS estimated_delivery_date
FROM x_items GROUP BY order_id
""")
view("x_returns", """
SELECT order_id, product_id, ship_date AS return_date,
       CASE WHEN line_status = 'O' AND tax < 0.03 THEN 'Too Small'
            WHEN line_status = 'O' AND tax < 0.06 THEN 'changed-mind'
            WHEN line_status = 'O' THEN 'late delivery'
            WHEN tax < 0.04 THEN 'Damaged' ELSE 'not as described' END AS return_reason,
       quantity AS return_quantity, revenue AS refund_amount
FROM x_items WHERE return_flag = 'R'
""")
view("x_reviews", """
SELECT order_id, product_id, ship_date AS review_date, (product_id + order_id) % 5 + 1 AS rating
FROM x_items WHERE line_status = 'F'
""")
view("x_traffic", """
SELECT CAST(ts AS DATE) AS date, event_type AS traffic_source, count(*) AS sessions,
       count(DISTINCT user_id) AS unique_visitors, sum(event_id % 4 + 1) AS page_views,
       avg(CASE WHEN value < 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS bounce_rate,
       avg(value) AS avg_session_duration_sec
FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2
""")
view("x_web_orders", """
SELECT event_id AS order_id, CAST(ts AS DATE) AS order_date, user_id AS customer_id,
       value AS order_value,
       CASE event_id % 5 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'paid' ELSE 'delivered' END AS order_status
FROM events WHERE event_type = 'purchase'
""")
view("x_promotions", """
SELECT promo_id, CASE WHEN number % 10 = 0 THEN 'fixed' ELSE 'percentage' END AS promo_type,
       CASE WHEN number % 10 = 0 THEN 50.0::DOUBLE ELSE round(rate * 100, 1) END AS discount_value,
       order_date AS start_date, order_date + CAST(number * 3 + 5 AS INTEGER) AS end_date,
       CASE WHEN number % 5 = 0 THEN category END AS applicable_category
FROM (SELECT promo_id, product_id % 50 + 1 AS number, order_date, category,
             avg(discount_rate) OVER (PARTITION BY promo_id) AS rate,
             row_number() OVER (PARTITION BY promo_id ORDER BY gross DESC, order_date DESC,
                                category DESC) AS place
      FROM x_lines WHERE promo_id IS NOT NULL)
WHERE place = 1
""")
view("x_inventory", """
SELECT s.*, p.category, p.segment,
       last_day(month) AS snapshot_date, stock_on_hand <= 0 AS stockout_flag,
       CASE WHEN stock_on_hand <= 0 THEN s.product_id % 20 + 1 ELSE 0 END AS stockout_days,
       CASE WHEN units_sold <> 0
            THEN least(1.0::DOUBLE, (stock_on_hand + received) / units_sold) ELSE 1.0 END AS fill_rate,
       stock_on_hand * 30 / nullif(units_sold, 0) AS days_of_supply,
       stock_on_hand > units_sold * 3 AS overstock_flag, stock_on_hand < units_sold AS reorder_flag,
       greatest(units_sold - stock_on_hand, 0) AS reorder_quantity,
       units_sold / nullif(units_sold + stock_on_hand, 0) AS sell_through_rate
FROM (SELECT product_id, month, received, units_sold,
             greatest(sum(received - units_sold) OVER (PARTITION BY product_id ORDER BY month), 0)
                 AS stock_on_hand
      FROM (SELECT product_id, month, sum(received) AS received, sum(units_sold) AS units_sold
            FROM (SELECT product_id, CAST(date_trunc('month', ship_date) AS DATE) AS month,
                         quantity AS received, 0 AS units_sold FROM x_items
                  UNION ALL
                  SELECT product_id, CAST(date_trunc('month', order_date) AS DATE), 0, quantity
                  FROM x_sold)
            GROUP BY 1, 2)) s
JOIN x_products p ON p.product_id = s.product_id
""")
view("x_category_months", """
SELECT category, CAST(date_trunc('month', order_date) AS DATE) AS month, sum(revenue) AS revenue
FROM x_lines GROUP BY 1, 2
""")
view("x_web_daily", """
SELECT t.date, sessions, unique_visitors, page_views, bounce_rate, coalesce(orders, 0) AS orders,
       coalesce(revenue, 0) AS revenue
FROM (SELECT date, sum(sessions) AS sessions, sum(unique_visitors) AS unique_visitors,
             sum(page_views) AS page_views, avg(bounce_rate) AS bounce_rate
      FROM x_traffic GROUP BY 1) t
LEFT JOIN (SELECT order_date AS date, count(*) AS orders, sum(order_value) AS revenue
           FROM x_web_orders GROUP BY 1) o ON o.date = t.date
""")
