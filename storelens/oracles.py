"""The registered queries in DuckDB SQL, over common table expressions that restate the input rules."""

from __future__ import annotations

_PROVINCES = "['Gauteng','Western Cape','KwaZulu-Natal','Eastern Cape','Free State','Limpopo','Mpumalanga','North West','Northern Cape']"

PRELUDE = f"""
WITH clicks AS (
  SELECT event_id, ts AS event_time, user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, user_id AS customer_id,
    CASE event_type WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'page_view' ELSE 'product_view' END WHEN 'click' THEN 'add_to_cart'
      WHEN 'signup' THEN 'begin_checkout' WHEN 'purchase' THEN 'purchase' WHEN 'error' THEN 'remove_from_cart' END AS event_type,
    ['mobile','desktop','tablet'][user_id % 3 + 1] AS device, ['direct','search','social','email','ads','referral'][k % 6 + 1] AS traffic_source,
    '/p/' || k AS page, k AS product_id, 1 + k % 3 AS quantity, CAST(value AS DECIMAL(12,2)) AS price,
    ts + to_seconds(CAST(event_id * 37 % 150 AS BIGINT)) AS ingested_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
orders_n AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice AS t, o_orderdate AS d FROM orders),
order_steps AS (
  SELECT k, c, t, d, 0 AS seq, 'c' AS op, 'PLACED' AS status, 0 AS day FROM orders_n
  UNION ALL SELECT k, c, t, d, 1, 'u', 'CANCELLED', 1 FROM orders_n WHERE k % 17 = 0
  UNION ALL SELECT k, c, t, d, 1, 'u', 'PAID', 1 FROM orders_n WHERE k % 17 <> 0 AND (s <> 'P' OR k % 2 = 1)
  UNION ALL SELECT k, c, t, d, 2, 'u', 'SHIPPED', 3 FROM orders_n WHERE k % 17 <> 0 AND s <> 'P'
  UNION ALL SELECT k, c, t, d, 3, 'u', 'DELIVERED', 7 FROM orders_n WHERE k % 17 <> 0 AND s = 'F'
  UNION ALL SELECT k, c, t, d, 9, 'd', CASE WHEN k % 17 = 0 THEN 'CANCELLED' WHEN s = 'F' THEN 'DELIVERED' WHEN s = 'O' THEN 'SHIPPED' WHEN k % 2 = 1 THEN 'PAID' ELSE 'PLACED' END, 30 FROM orders_n WHERE k % 97 = 0),
order_log AS (
  SELECT op, epoch_ms(d + to_days(day)) AS ts_ms, k * 16 + seq AS kafka_offset, k AS order_id, c AS customer_id,
    CASE WHEN k % 7 = 0 THEN (k // 7) % 150 || '-202401' || lpad(CAST(k % 30 + 1 AS VARCHAR), 2, '0') END AS session_id,
    status, ['CARD','EFT','COD'][k % 3 + 1] AS payment_method, CAST(['0','50','99'][k % 3 + 1] AS DECIMAL(10,2)) AS shipping_fee,
    CAST(t AS DECIMAL(12,2)) AS order_total, {_PROVINCES}[c % 9 + 1] AS ship_province, d AS placed_at, d + to_days(day) AS changed_at, op = 'd' AS is_deleted
  FROM order_steps),
order_last AS (SELECT * FROM order_log QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts_ms DESC, kafka_offset DESC) = 1),
order_core AS (SELECT *, status NOT IN ('CANCELLED', 'RETURNED') AS is_revenue, CAST(placed_at + INTERVAL 2 HOUR AS DATE) AS order_date FROM order_last WHERE NOT is_deleted),
milestones AS (
  SELECT order_id, min(changed_at) FILTER (status = 'PAID') AS paid_at, min(changed_at) FILTER (status = 'SHIPPED') AS shipped_at,
    min(changed_at) FILTER (status = 'DELIVERED') AS delivered_at_shop, min(changed_at) FILTER (status = 'CANCELLED') AS cancelled_at, count(*) FILTER (op = 'u') AS status_changes
  FROM order_log GROUP BY order_id),
line_keys AS (SELECT l_orderkey AS o, l_partkey AS p, CAST(sum(l_quantity) AS BIGINT) AS q, CAST(max(l_extendedprice) AS DECIMAL(12,2)) AS unit_price, min(l_shipdate) AS ts0 FROM lineitem GROUP BY ALL),
item_log AS (
  SELECT 'c' AS op, ts0 AS changed_at, o * 4 AS kafka_offset, o AS order_id, p AS product_id, q AS quantity, unit_price FROM line_keys
  UNION ALL SELECT 'u', ts0 + INTERVAL 1 HOUR, o * 4 + 1, o, p, q + 1, unit_price FROM line_keys WHERE (o + p) % 13 = 0
  UNION ALL SELECT 'd', ts0 + INTERVAL 2 HOUR, o * 4 + 2, o, p, q + CASE WHEN (o + p) % 13 = 0 THEN 1 ELSE 0 END, unit_price FROM line_keys WHERE (o + p) % 29 = 0),
items AS (SELECT * FROM (SELECT * FROM item_log QUALIFY row_number() OVER (PARTITION BY order_id, product_id ORDER BY changed_at DESC, kafka_offset DESC) = 1) WHERE op <> 'd'),
item_rollup AS (SELECT order_id, count(*) AS lines, sum(quantity) AS units, sum(quantity * unit_price) AS items_value FROM items GROUP BY order_id),
product_log AS (
  SELECT l_partkey AS product_id, l_shipdate AS changed_at, l_orderkey * 8 + l_linenumber AS kafka_offset, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_quantity AS BIGINT) AS q, l_suppkey AS supplier,
    p_name AS product_name, p_type AS category, 'SKU-' || l_partkey AS sku, CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(0.6 AS DECIMAL(2,1)), 2) AS DECIMAL(12,2)) AS cost
  FROM lineitem JOIN part ON l_partkey = p_partkey),
inventory_log AS (
  SELECT p_partkey AS product_id, 0 AS seq, p_partkey * 7919 % 160 AS stock_on_hand, p_size % 20 AS reorder_level FROM part
  UNION ALL SELECT p_partkey, 1, p_partkey * 31 % 40, p_size % 20 FROM part WHERE p_partkey % 5 = 0),
stock AS (SELECT product_id, stock_on_hand, reorder_level FROM inventory_log QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seq DESC) = 1),
product_versions AS (
  SELECT *, row_number() OVER w AS version, lead(changed_at) OVER w AS next_changed FROM product_log
  WINDOW w AS (PARTITION BY product_id ORDER BY changed_at, kafka_offset, price, q, supplier)),
dim_products AS (
  SELECT md5(product_id || '-' || version) AS product_sk, product_id, version, sku, product_name, category, price, cost,
    floor(CAST(price - cost AS DOUBLE) / CAST(price AS DOUBLE) * 10000.0 + 0.5) / 10000.0 AS margin_pct,
    CASE WHEN version = 1 THEN TIMESTAMP '1900-01-01' ELSE changed_at END AS valid_from, coalesce(next_changed, TIMESTAMP '9999-12-31') AS valid_to, next_changed IS NULL AS is_current,
    CASE WHEN next_changed IS NULL THEN stock_on_hand END AS stock_on_hand, CASE WHEN next_changed IS NULL THEN stock_on_hand <= reorder_level END AS needs_reorder
  FROM product_versions LEFT JOIN stock USING (product_id)),
customer_steps AS (
  SELECT c_custkey AS c, c_name, 0 AS seq, 'c' AS op, 0 AS moved, c_custkey % 1000 AS day FROM customer
  UNION ALL SELECT c_custkey, c_name, 1, 'u', 1, 2922 + c_custkey % 365 FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, c_name, 2, 'd', CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END, 4018 FROM customer WHERE c_custkey % 101 = 0),
customer_log AS (
  SELECT c AS customer_id, op, seq, TIMESTAMP '1990-01-01' + to_days(CAST(day AS INTEGER)) AS changed_at, c_name AS first_name, 'Family' || c % 10 AS last_name, 'user' || c || '@example.com' AS email,
    CASE WHEN c % 50 <> 0 THEN '+27' || lpad(CAST(c AS VARCHAR), 9, '0') END AS phone, {_PROVINCES}[(c + moved) % 9 + 1] AS province, 'City ' || c % 20 AS city, c % 2 = 0 AS marketing_opt_in,
    TIMESTAMP '1990-01-01' + to_days(CAST(c % 1000 AS INTEGER)) AS created_at
  FROM customer_steps),
customer_versions AS (SELECT *, row_number() OVER w AS version, lead(changed_at) OVER w AS next_changed FROM customer_log WINDOW w AS (PARTITION BY customer_id ORDER BY changed_at, seq)),
dim_customers AS (
  SELECT md5(customer_id || '-' || version) AS customer_sk, customer_id, version, first_name, left(last_name, 1) || '.' AS last_initial, regexp_replace(email, '^(.)[^@]*(@.*)$', '\\1***\\2') AS email_masked,
    left(phone, 5) || '*****' || right(phone, 2) AS phone_masked, province, city, marketing_opt_in, created_at,
    CASE WHEN version = 1 THEN TIMESTAMP '1900-01-01' ELSE changed_at END AS valid_from, coalesce(next_changed, TIMESTAMP '9999-12-31') AS valid_to, next_changed IS NULL AND op <> 'd' AS is_current
  FROM customer_versions),
raw_base AS (
  SELECT k, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_linestatus = 'F' AS done, c, d + INTERVAL 2 HOUR AS col, CAST((CAST(l_quantity AS BIGINT) * 7919 + l_partkey) % 144 + 1 AS INTEGER) AS h
  FROM lineitem JOIN orders_n ON l_orderkey = k WHERE l_linenumber = 1),
raw_rows AS (
  SELECT 'W' || k AS waybill, CASE WHEN k % 100 = 0 THEN NULL ELSE k END AS order_id, ['CourierA','CourierB','CourierC'][l_suppkey % 3 + 1] AS courier, {_PROVINCES}[c % 9 + 1] AS province,
    CASE WHEN k % 101 = 0 THEN date_trunc('minute', col) WHEN k % 211 = 5 THEN NULL ELSE col END - INTERVAL 2 HOUR AS collected_at,
    CASE WHEN NOT done THEN NULL WHEN k % 200 = 3 THEN col - INTERVAL 5 HOUR ELSE col + to_hours(h) END - INTERVAL 2 HOUR AS delivered_at,
    CASE WHEN done THEN 'DELIVERED' ELSE 'IN_TRANSIT' END AS status, CASE WHEN k % 150 = 0 THEN 9 ELSE 1 + k % 3 END AS attempts,
    k, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate
  FROM raw_base),
deliveries_raw AS (SELECT *, 0 AS copy FROM raw_rows UNION ALL SELECT *, 1 FROM raw_rows WHERE k % 100 = 7),
ruled AS (
  SELECT *, concat_ws(',', CASE WHEN order_id IS NULL THEN 'order_id_present' END, CASE WHEN collected_at IS NULL THEN 'collected_at_valid' END,
    CASE WHEN delivered_at IS NOT NULL AND coalesce(delivered_at < collected_at, true) THEN 'delivered_after_collected' END, CASE WHEN attempts NOT BETWEEN 0 AND 5 THEN 'attempts_in_range' END) AS failed_rules
  FROM deliveries_raw),
good AS (SELECT * FROM ruled WHERE failed_rules = '' QUALIFY row_number() OVER (PARTITION BY waybill, status ORDER BY k, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, copy) = 1),
delivery_latest AS (
  SELECT order_id, waybill, courier, province, collected_at, delivered_at, status AS delivery_status, attempts FROM good
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY coalesce(delivered_at, collected_at) DESC, attempts DESC, waybill DESC, courier DESC) = 1),
rule_results AS (
  SELECT courier, unnest([
    {{'rule': 'order_id_present', 'dimension': 'completeness', 'checked': n, 'failed': f1}}, {{'rule': 'waybill_present', 'dimension': 'completeness', 'checked': n, 'failed': 0}},
    {{'rule': 'status_known', 'dimension': 'validity', 'checked': n, 'failed': 0}}, {{'rule': 'collected_at_valid', 'dimension': 'validity', 'checked': n, 'failed': f2}},
    {{'rule': 'delivered_at_valid', 'dimension': 'validity', 'checked': n, 'failed': 0}}, {{'rule': 'delivered_has_timestamp', 'dimension': 'completeness', 'checked': n, 'failed': 0}},
    {{'rule': 'delivered_after_collected', 'dimension': 'consistency', 'checked': n, 'failed': f3}}, {{'rule': 'attempts_in_range', 'dimension': 'validity', 'checked': n, 'failed': f4}},
    {{'rule': 'unique_waybill_status', 'dimension': 'uniqueness', 'checked': g, 'failed': g - u}}]) AS r
  FROM (SELECT courier, count(*) AS n, count(*) FILTER (order_id IS NULL) AS f1, count(*) FILTER (collected_at IS NULL) AS f2,
    count(*) FILTER (delivered_at IS NOT NULL AND coalesce(delivered_at < collected_at, true)) AS f3, count(*) FILTER (attempts NOT BETWEEN 0 AND 5) AS f4,
    count(*) FILTER (failed_rules = '') AS g, count(DISTINCT waybill || status) FILTER (failed_rules = '') AS u FROM ruled GROUP BY courier)),
easter_parts AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM range(1995, 2003) t(y)),
easter_moon AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM easter_parts),
easter_week AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM easter_moon),
easter_last AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS x FROM easter_week),
easter AS (SELECT y, make_date(y, x // 31, x % 31 + 1) AS sunday FROM easter_last),
named_days AS (
  SELECT make_date(y, m, d) AS holiday_date, name, 1 AS place FROM range(1995, 2003) t(y),
    (VALUES (1, 1, 'New Year''s Day'), (3, 21, 'Human Rights Day'), (4, 27, 'Freedom Day'), (5, 1, 'Workers'' Day'), (6, 16, 'Youth Day'), (8, 9, 'National Women''s Day'),
      (9, 24, 'Heritage Day'), (12, 16, 'Day of Reconciliation'), (12, 25, 'Christmas Day'), (12, 26, 'Day of Goodwill')) v(m, d, name)
  UNION ALL SELECT sunday - 2, 'Good Friday', 2 FROM easter UNION ALL SELECT sunday + 1, 'Family Day', 2 FROM easter),
holidays AS (
  SELECT * FROM (SELECT * FROM named_days UNION ALL SELECT holiday_date + 1, name || ' (observed)', 3 FROM named_days WHERE isodow(holiday_date) = 7)
  QUALIFY row_number() OVER (PARTITION BY holiday_date ORDER BY place) = 1),
dim_date AS (
  SELECT date_day, CAST(isodow(date_day) AS INTEGER) AS day_of_week, strftime(date_day, '%a') AS day_name, CAST(date_trunc('week', date_day) AS DATE) AS week_start, CAST(date_trunc('month', date_day) AS DATE) AS month_start,
    isodow(date_day) IN (6, 7) AS is_weekend, name IS NOT NULL AS is_public_holiday, name AS holiday_name, day(date_day) >= 25 OR day(date_day) = 1 AS is_payday_period
  FROM (SELECT CAST(unnest(generate_series(least(min(CAST(o_orderdate AS DATE)), DATE '2001-12-31' - 90), DATE '2001-12-31' + 30, INTERVAL 1 DAY)) AS DATE) AS date_day FROM orders)
  LEFT JOIN holidays ON holiday_date = date_day),
sales_daily AS (
  SELECT date_day AS order_date, day_name, is_weekend, is_public_holiday, holiday_name, is_payday_period, count(o.order_id) FILTER (is_revenue) AS orders, count(o.order_id) FILTER (status = 'CANCELLED') AS cancelled_orders,
    CAST(coalesce(sum(order_total) FILTER (is_revenue), 0) AS DOUBLE) AS revenue, CAST(coalesce(sum(units) FILTER (is_revenue), 0) AS BIGINT) AS units,
    floor(CAST(sum(order_total) FILTER (is_revenue) AS DOUBLE) / CAST(nullif(count(o.order_id) FILTER (is_revenue), 0) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS avg_order_value, count(DISTINCT customer_id) FILTER (is_revenue) AS customers
  FROM dim_date LEFT JOIN (SELECT c.*, i.units FROM order_core c LEFT JOIN item_rollup i USING (order_id)) o ON o.order_date = date_day WHERE date_day <= DATE '2001-12-31' GROUP BY ALL),
sessions AS (
  SELECT session_id, max(customer_id) AS customer_id, min(event_time) AS started_at, max(event_time) AS ended_at, count(*) AS events, count(*) FILTER (event_type = 'page_view') AS page_views, count(*) FILTER (event_type = 'product_view') AS product_views,
    count(*) FILTER (event_type = 'add_to_cart') AS add_to_carts, count(*) FILTER (event_type = 'begin_checkout') AS checkouts, count(*) FILTER (event_type = 'purchase') AS purchases,
    count(*) FILTER (epoch(date_trunc('second', ingested_at)) - epoch(date_trunc('second', event_time)) > 60) AS late_events, arg_min(device, event_id) AS device, arg_min(traffic_source, event_id) AS traffic_source, arg_min(page, event_id) AS landing_page,
    CAST(epoch(date_trunc('second', max(event_time))) - epoch(date_trunc('second', min(event_time))) AS BIGINT) AS duration_s, CAST(min(event_time) + INTERVAL 2 HOUR AS DATE) AS session_date
  FROM clicks GROUP BY session_id),
cart_lines AS (
  SELECT * FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id) AS bought, max(event_time) OVER (PARTITION BY session_id) AS last_seen,
    max(CASE WHEN event_type = 'remove_from_cart' THEN event_id END) OVER (PARTITION BY session_id, product_id) AS removed FROM clicks)
  WHERE event_type = 'add_to_cart' AND bought = 0 AND (removed IS NULL OR event_id > removed)),
carts AS (
  SELECT session_id, max(customer_id) AS customer_id, CAST(sum(quantity * price) AS DOUBLE) AS cart_value, CAST(sum(quantity) AS BIGINT) AS items, max(last_seen) AS last_activity_at
  FROM (SELECT session_id, product_id, max(customer_id) AS customer_id, max(last_seen) AS last_seen, sum(quantity) AS quantity, arg_max(price, event_id) AS price FROM cart_lines GROUP BY ALL) GROUP BY session_id),
carts_recovered AS (
  SELECT *, EXISTS (SELECT 1 FROM clicks p WHERE p.event_type = 'purchase' AND p.customer_id = c.customer_id AND p.event_time BETWEEN c.last_activity_at AND c.last_activity_at + INTERVAL 24 HOUR) AS recovered FROM carts c),
abandoned_daily AS (
  SELECT CAST(last_activity_at + INTERVAL 2 HOUR AS DATE) AS cart_date, count(*) AS abandoned_carts, CAST(sum(CAST(cart_value AS DECIMAL(18,2))) AS DOUBLE) AS abandoned_value, count(*) FILTER (customer_id IS NULL) AS guest_carts,
    count(*) FILTER (recovered) AS recovered_carts, CAST(coalesce(sum(CAST(cart_value AS DECIMAL(18,2))) FILTER (recovered), 0) AS DOUBLE) AS recovered_value FROM carts_recovered GROUP BY 1),
fct_sessions AS (
  SELECT s.*, c.cart_value AS abandoned_value, o.order_id, CAST(o.order_total AS DOUBLE) AS order_total, s.purchases > 0 AS converted, s.add_to_carts > 0 AS added_to_cart, c.session_id IS NOT NULL AS cart_abandoned
  FROM sessions s LEFT JOIN carts c ON c.session_id = s.session_id LEFT JOIN order_core o ON o.session_id = s.session_id),
funnel_daily AS (
  SELECT session_date, traffic_source, count(*) AS sessions, count(*) FILTER (product_views > 0) AS viewed_product, count(*) FILTER (add_to_carts > 0) AS added_to_cart, count(*) FILTER (checkouts > 0) AS reached_checkout,
    count(*) FILTER (purchases > 0) AS purchased, count(*) FILTER (cart_abandoned) AS abandoned_carts, floor(CAST(count(*) FILTER (purchases > 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 10000.0 + 0.5) / 10000.0 AS conversion_rate,
    floor(CAST(sum(duration_s) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 1.0 + 0.5) / 1.0 AS avg_duration_s FROM fct_sessions GROUP BY ALL),
fct_orders AS (
  SELECT o.order_id, o.customer_id, c.customer_sk, o.session_id, o.status, o.is_revenue, o.payment_method, o.ship_province, o.placed_at, o.order_date, m.paid_at, m.shipped_at, m.cancelled_at, m.status_changes,
    coalesce(i.lines, 0) AS lines, CAST(coalesce(i.units, 0) AS BIGINT) AS units, CAST(coalesce(i.items_value, 0) AS DOUBLE) AS items_value, CAST(o.shipping_fee AS DOUBLE) AS shipping_fee, CAST(o.order_total AS DOUBLE) AS order_total,
    d.courier, d.waybill, d.delivery_status, d.attempts AS delivery_attempts, d.collected_at, coalesce(d.delivered_at, m.delivered_at_shop) AS delivered_at,
    floor((epoch(d.delivered_at) - epoch(d.collected_at)) / 3600 * 10.0 + 0.5) / 10.0 AS delivery_hours
  FROM order_core o LEFT JOIN milestones m USING (order_id) LEFT JOIN item_rollup i USING (order_id) LEFT JOIN delivery_latest d USING (order_id)
  LEFT JOIN dim_customers c ON c.customer_id = o.customer_id AND o.placed_at >= c.valid_from AND o.placed_at < c.valid_to),
fct_order_items AS (
  SELECT i.order_id, i.product_id, p.product_sk, p.product_name, p.category, o.order_date, o.is_revenue, i.quantity, CAST(i.unit_price AS DOUBLE) AS unit_price, CAST(i.quantity * i.unit_price AS DOUBLE) AS line_revenue,
    CAST(p.cost AS DOUBLE) AS unit_cost_at_sale, CAST(i.quantity * (i.unit_price - p.cost) AS DOUBLE) AS line_margin
  FROM items i JOIN order_core o USING (order_id) LEFT JOIN dim_products p ON p.product_id = i.product_id AND o.placed_at >= p.valid_from AND o.placed_at < p.valid_to),
delivery_sla AS (
  SELECT courier, ship_province, count(*) AS deliveries, floor(sum(hours) / CAST(count(*) AS DOUBLE) * 10.0 + 0.5) / 10.0 AS avg_hours, floor(quantile_cont(hours, 0.9) * 10.0 + 0.5) / 10.0 AS p90_hours,
    floor(CAST(count(*) FILTER (hours <= CASE WHEN ship_province IN ('Northern Cape','Limpopo','North West','Eastern Cape') THEN 96 ELSE 72 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 10000.0 + 0.5) / 10000.0 AS sla_rate,
    floor(CAST(count(*) FILTER (attempts > 1) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 10000.0 + 0.5) / 10000.0 AS repeat_attempt_rate
  FROM (SELECT d.*, o.ship_province, floor((epoch(d.delivered_at) - epoch(d.collected_at)) / 3600 * 10.0 + 0.5) / 10.0 AS hours FROM delivery_latest d JOIN order_core o USING (order_id) WHERE d.delivery_status = 'DELIVERED' AND d.delivered_at IS NOT NULL) GROUP BY ALL),
rfm_base AS (SELECT customer_id, CAST(DATE '2001-12-31' - max(order_date) AS BIGINT) AS recency_days, count(*) AS frequency, sum(order_total) AS monetary FROM order_core WHERE is_revenue GROUP BY 1),
rfm_tiles AS (SELECT *, 6 - ntile(5) OVER (ORDER BY recency_days, customer_id) AS r_score, ntile(5) OVER (ORDER BY frequency, customer_id) AS f_score, ntile(5) OVER (ORDER BY monetary, customer_id) AS m_score FROM rfm_base),
rfm AS (
  SELECT s.customer_id, c.first_name, c.province, s.recency_days, s.frequency, CAST(s.monetary AS DOUBLE) AS monetary, s.r_score, s.f_score, s.m_score,
    CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'Champions' WHEN r_score >= 3 AND f_score >= 3 THEN 'Loyal' WHEN r_score >= 4 AND f_score <= 2 THEN 'New / Promising' WHEN r_score <= 2 AND f_score >= 3 THEN 'At Risk' WHEN r_score <= 2 THEN 'Hibernating' ELSE 'Needs Attention' END AS segment
  FROM rfm_tiles s LEFT JOIN dim_customers c ON c.customer_id = s.customer_id AND c.is_current),
staged AS (SELECT event_time, session_id, unnest([event_type, 'any']) AS stage FROM clicks),
funnel_windows AS (SELECT date_trunc('minute', event_time) AS window_start, stage, count(DISTINCT session_id) AS sessions, count(*) AS events FROM staged GROUP BY ALL),
product_days AS (SELECT CAST(changed_at + INTERVAL 2 HOUR AS DATE) AS day, product_id, CAST(sum(quantity) AS BIGINT) AS units, CAST(sum(quantity * unit_price) AS DOUBLE) AS revenue FROM item_log WHERE op = 'c' GROUP BY ALL),
dq_results AS (
  SELECT courier AS run_id, 'deliveries' AS dataset, r.rule AS rule_name, r.dimension AS dimension, r.checked AS checked_rows, r.failed AS failed_rows,
    TIMESTAMP '2001-12-31' - to_days(CASE courier WHEN 'CourierA' THEN 1 WHEN 'CourierB' THEN 3 ELSE 9 END) AS run_at FROM rule_results)
"""

_CORE = "order_id, customer_id, session_id, status, payment_method, CAST(shipping_fee AS DOUBLE) AS shipping_fee, CAST(order_total AS DOUBLE) AS order_total, ship_province, placed_at"
_VERSIONS = "product_sk, product_id, version, sku, product_name, category, CAST(price AS DOUBLE) AS price, CAST(cost AS DOUBLE) AS cost, margin_pct, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to, is_current, stock_on_hand, needs_reorder"
_OPEN = "nullif(valid_from, TIMESTAMP '1900-01-01') AS valid_from, nullif(valid_to, TIMESTAMP '9999-12-31') AS valid_to"


def _overview(day: str, until: str) -> str:
    return f"""SELECT k.*, (SELECT coalesce(sum(units), 0)::BIGINT FROM product_days WHERE day = DATE '{day}') AS items_sold,
      (SELECT count(*) FROM carts WHERE CAST(last_activity_at + INTERVAL 2 HOUR AS DATE) = DATE '{day}') AS abandoned_carts,
      (SELECT CAST(coalesce(sum(CAST(cart_value AS DECIMAL(18,2))), 0) AS DOUBLE) FROM carts WHERE CAST(last_activity_at + INTERVAL 2 HOUR AS DATE) = DATE '{day}') AS abandoned_value,
      (SELECT coalesce(sum(sessions), 0)::BIGINT FROM funnel_windows WHERE stage = 'any' AND window_start = TIMESTAMP '{until}') AS active_sessions_last_min,
      (SELECT CASE WHEN sum(events) FILTER (stage = 'page_view') > 0 THEN floor(CAST(coalesce(sum(events) FILTER (stage = 'purchase'), 0) AS DOUBLE) / CAST(greatest(sum(sessions) FILTER (stage = 'any'), 1) AS DOUBLE) * 10000.0 + 0.5) / 10000.0 END
        FROM funnel_windows WHERE window_start BETWEEN TIMESTAMP '{until}' - INTERVAL 14 MINUTE AND TIMESTAMP '{until}') AS purchases_per_session,
      (SELECT count(*) FROM order_core WHERE status IN ('PLACED','PAID','SHIPPED')) AS open_orders,
      (SELECT string_agg(status || '=' || n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM order_core GROUP BY 1)) AS order_status,
      coalesce(floor(revenue / CAST(nullif(orders, 0) AS DOUBLE) * 100.0 + 0.5) / 100.0, 0.0) AS avg_order_value
    FROM (SELECT count(*) FILTER (op = 'c') AS orders, CAST(coalesce(sum(order_total) FILTER (op = 'c'), 0) AS DOUBLE) AS revenue, count(*) FILTER (op = 'u' AND status = 'CANCELLED') AS cancelled
      FROM order_log WHERE CAST(changed_at + INTERVAL 2 HOUR AS DATE) = DATE '{day}') k"""


_SELECT: dict[str, str] = {
    "clicks_parsed": "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, session_id, customer_id, device, traffic_source, event_time, page, product_id, quantity, CAST(price AS DOUBLE) AS price, CAST(event_time AS DATE) AS event_date FROM clicks",
    "clicks_dedup": "SELECT event_id, event_time, session_id, event_type FROM clicks",
    "sessions": "SELECT * FROM sessions",
    "late_events": "SELECT session_date, CAST(sum(late_events) AS BIGINT) AS late_events, CAST(sum(events) AS BIGINT) AS events FROM sessions GROUP BY 1",
    "funnel_windows": "SELECT * FROM funnel_windows",
    "active_sessions_per_minute": "SELECT window_start, sessions FROM funnel_windows WHERE stage = 'any'",
    "funnel_dense_series": "SELECT m AS window_start, s AS stage, coalesce(sessions, 0) AS sessions, coalesce(events, 0) AS events FROM (SELECT TIMESTAMP '2024-01-15 12:00:00' - to_minutes(i) AS m FROM range(360) t(i)) CROSS JOIN (SELECT unnest(['page_view','product_view','add_to_cart','begin_checkout','purchase','any']) AS s) LEFT JOIN funnel_windows ON window_start = m AND stage = s",
    "carts_abandoned": "SELECT * FROM carts",
    "carts_value_by_day": "SELECT CAST(last_activity_at + INTERVAL 2 HOUR AS DATE) AS day, count(*) AS alerts, CAST(sum(CAST(cart_value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM carts GROUP BY 1",
    "carts_recovered_24h": "SELECT * FROM carts_recovered",
    "abandoned_carts_daily": "SELECT * FROM abandoned_daily",
    "cdc_envelope": "SELECT 'orders' AS table_name, op, ts_ms, kafka_offset, lag(order_id) OVER (PARTITION BY order_id ORDER BY ts_ms, kafka_offset) IS NOT NULL AS has_before, op <> 'd' AS has_after FROM order_log",
    "cdc_orders_typed": f"SELECT op, is_deleted, ts_ms, changed_at, kafka_offset, lag(status) OVER (PARTITION BY order_id ORDER BY ts_ms, kafka_offset) AS previous_status, CASE WHEN op = 'd' THEN lag(status) OVER (PARTITION BY order_id ORDER BY ts_ms, kafka_offset) ELSE status END AS status, {_CORE.replace('status, ', '')} FROM order_log",
    "orders_latest": f"SELECT {_CORE}, changed_at FROM order_last WHERE NOT is_deleted",
    "orders_milestones": "SELECT * FROM milestones",
    "orders_previous_status": "SELECT order_id, ts_ms, kafka_offset, status, lag(status) OVER (PARTITION BY order_id ORDER BY ts_ms, kafka_offset) AS previous_status FROM order_log",
    "order_items_latest": "SELECT order_id, product_id, quantity, CAST(unit_price AS DOUBLE) AS unit_price FROM items",
    "order_item_rollup": "SELECT order_id, lines, CAST(units AS BIGINT) AS units, CAST(items_value AS DOUBLE) AS items_value FROM item_rollup",
    "dim_customers_scd2": "SELECT * REPLACE (CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to) FROM dim_customers",
    "dim_products_scd2": f"SELECT {_VERSIONS} FROM dim_products",
    "dim_current_versions": "SELECT 'customer' AS dim, customer_id AS id, version FROM dim_customers WHERE is_current UNION ALL SELECT 'product', product_id, version FROM dim_products WHERE is_current",
    "dim_date": "SELECT * FROM dim_date",
    "pit_customer": "SELECT o.order_id, o.customer_id, c.version, c.province FROM order_core o LEFT JOIN dim_customers c ON c.customer_id = o.customer_id AND o.placed_at >= c.valid_from AND o.placed_at < c.valid_to",
    "pit_product_margin": "SELECT order_id, product_id, unit_cost_at_sale, line_margin FROM fct_order_items",
    "fct_orders": "SELECT * FROM fct_orders",
    "fct_order_items": "SELECT * FROM fct_order_items",
    "fct_sessions": "SELECT * FROM fct_sessions",
    "sales_daily": "SELECT * FROM sales_daily",
    "funnel_daily": "SELECT * FROM funnel_daily",
    "funnel_by_source": "SELECT traffic_source, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(purchased) AS BIGINT) AS purchased, floor(CAST(sum(purchased) AS DOUBLE) / CAST(nullif(sum(sessions), 0) AS DOUBLE) * 10000.0 + 0.5) / 10000.0 AS conversion_rate FROM funnel_daily WHERE session_date > DATE '2024-01-31' - 90 GROUP BY 1",
    "funnel_by_day": "SELECT session_date, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(viewed_product) AS BIGINT) AS viewed_product, CAST(sum(added_to_cart) AS BIGINT) AS added_to_cart, CAST(sum(reached_checkout) AS BIGINT) AS reached_checkout, CAST(sum(purchased) AS BIGINT) AS purchased, CAST(sum(abandoned_carts) AS BIGINT) AS abandoned_carts FROM funnel_daily WHERE session_date > DATE '2024-01-31' - 30 GROUP BY 1",
    "sales_recent_days": "SELECT * FROM sales_daily WHERE order_date > DATE '2001-12-31' - 365",
    "delivery_latest": "SELECT * FROM delivery_latest",
    "delivery_sla": "SELECT * FROM delivery_sla",
    "delivery_sla_weighted": "SELECT courier, CAST(sum(deliveries) AS BIGINT) AS deliveries, floor(CAST(sum(CAST(avg_hours * deliveries AS DECIMAL(24,4))) AS DOUBLE) / CAST(sum(deliveries) AS DOUBLE) * 10.0 + 0.5) / 10.0 AS avg_hours, floor(CAST(sum(CAST(sla_rate * deliveries AS DECIMAL(24,4))) AS DOUBLE) / CAST(sum(deliveries) AS DOUBLE) * 10000.0 + 0.5) / 10000.0 AS sla_rate FROM delivery_sla GROUP BY 1",
    "rfm_scores": "SELECT customer_id, recency_days, frequency, monetary, r_score, f_score, m_score FROM rfm",
    "rfm_segments": "SELECT * FROM rfm",
    "segment_summary": "SELECT segment, count(*) AS customers, CAST(sum(CAST(monetary AS DECIMAL(18,2))) AS DOUBLE) AS revenue, floor(CAST(sum(recency_days) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 10.0 + 0.5) / 10.0 AS avg_recency_days FROM rfm GROUP BY 1",
    "dq_rule_results": "SELECT rule, dimension, checked, failed FROM (SELECT count(*) AS n, count(*) FILTER (order_id IS NULL) AS f1, count(*) FILTER (collected_at IS NULL) AS f2, count(*) FILTER (delivered_at IS NOT NULL AND coalesce(delivered_at < collected_at, true)) AS f3, count(*) FILTER (attempts NOT BETWEEN 0 AND 5) AS f4, count(*) FILTER (failed_rules = '') AS g, count(DISTINCT waybill || status) FILTER (failed_rules = '') AS u FROM ruled), LATERAL (VALUES ('order_id_present', 'completeness', n, f1), ('waybill_present', 'completeness', n, 0), ('status_known', 'validity', n, 0), ('collected_at_valid', 'validity', n, f2), ('delivered_at_valid', 'validity', n, 0), ('delivered_has_timestamp', 'completeness', n, 0), ('delivered_after_collected', 'consistency', n, f3), ('attempts_in_range', 'validity', n, f4), ('unique_waybill_status', 'uniqueness', g, g - u)) v(rule, dimension, checked, failed)",
    "dq_rejected": "SELECT waybill, courier, status, attempts, failed_rules FROM ruled WHERE failed_rules <> ''",
    "dq_duplicates": "SELECT waybill, status, count(*) AS n FROM ruled WHERE failed_rules = '' GROUP BY ALL HAVING count(*) > 1",
    "dq_scorecard": "SELECT dataset, rule_name, dimension, count(DISTINCT run_id) AS runs, CAST(sum(checked_rows) AS BIGINT) AS checked_rows, CAST(sum(failed_rows) AS BIGINT) AS failed_rows, max(run_at) AS last_run_at, floor(CAST(sum(checked_rows) - sum(failed_rows) AS DOUBLE) / CAST(nullif(sum(checked_rows), 0) AS DOUBLE) * 10000.0 + 0.5) / 10000.0 AS pass_rate FROM dq_results WHERE run_at >= TIMESTAMP '2001-12-31' - INTERVAL 7 DAY GROUP BY ALL",
    "data_quality": "SELECT dataset, rule_name, dimension, count(DISTINCT run_id) AS runs, CAST(sum(checked_rows) AS BIGINT) AS checked_rows, CAST(sum(failed_rows) AS BIGINT) AS failed_rows, max(run_at) AS last_run_at, floor(CAST(sum(checked_rows) - sum(failed_rows) AS DOUBLE) / CAST(nullif(sum(checked_rows), 0) AS DOUBLE) * 10000.0 + 0.5) / 10000.0 AS pass_rate FROM dq_results WHERE run_at >= TIMESTAMP '2001-12-31' - INTERVAL 7 DAY GROUP BY ALL",
    "live_status_board": "SELECT status, count(*) AS orders FROM order_last WHERE NOT is_deleted GROUP BY 1",
    "live_day_kpis": "SELECT CAST(changed_at + INTERVAL 2 HOUR AS DATE) AS day, count(*) FILTER (op = 'c') AS orders, CAST(coalesce(sum(order_total) FILTER (op = 'c'), 0) AS DOUBLE) AS revenue, count(*) FILTER (op = 'u') AS cancelled FROM order_log WHERE op = 'c' OR (op = 'u' AND status = 'CANCELLED') GROUP BY 1",
    "live_recent_orders": "SELECT order_id, customer_id, CAST(order_total AS DOUBLE) AS order_total, ship_province, payment_method, placed_at, ts_ms FROM order_log WHERE op = 'c' ORDER BY ts_ms DESC, kafka_offset DESC LIMIT 20",
    "live_top_products": "SELECT *, row_number() OVER (PARTITION BY day ORDER BY revenue DESC, CAST(product_id AS VARCHAR) DESC) AS place FROM product_days QUALIFY place <= 3",
    "live_low_stock": "SELECT product_id, stock_on_hand FROM stock WHERE stock_on_hand <= 10",
    "live_display_names": "SELECT DISTINCT 'product' AS kind, product_id AS id, product_name AS name FROM product_log UNION ALL SELECT 'customer', customer_id, first_name FROM customer_log WHERE op <> 'd' QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY seq DESC) = 1",
    "live_recent_alerts": "SELECT session_id, coalesce(first_name, 'Guest') AS name, cart_value, items, last_activity_at FROM (SELECT * FROM carts ORDER BY last_activity_at DESC, session_id LIMIT 20) c LEFT JOIN (SELECT customer_id, first_name FROM customer_log WHERE op = 'c') n USING (customer_id)",
    "live_best_sellers": "SELECT product_id, p_name AS name, units, revenue FROM (SELECT * FROM product_days WHERE day = DATE '1998-10-03' ORDER BY units DESC, CAST(product_id AS VARCHAR) DESC LIMIT 10) JOIN part ON p_partkey = product_id",
    "live_lowest_stock": "SELECT product_id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = product_id) THEN p_name END AS name, stock_on_hand FROM (SELECT * FROM stock WHERE stock_on_hand <= 10 ORDER BY stock_on_hand, CAST(product_id AS VARCHAR) LIMIT 20) JOIN part ON p_partkey = product_id",
    "live_overview": _overview("1998-10-03", "1998-10-03 23:59:00"),
    "live_overview_clicks": _overview("2024-01-15", "2024-01-15 12:00:00"),
    "live_retained_cells": "SELECT * FROM funnel_windows WHERE window_start >= TIMESTAMP '2024-01-15 06:00:00' AND window_start < TIMESTAMP '2024-01-15 12:00:00'",
    "cdc_order_items_typed": "SELECT op, op = 'd' AS is_deleted, epoch_ms(changed_at) AS ts_ms, changed_at, kafka_offset, order_id, product_id, quantity, CAST(unit_price AS DOUBLE) AS unit_price FROM item_log",
    "cdc_customers_typed": "SELECT op, op = 'd' AS is_deleted, epoch_ms(changed_at) AS ts_ms, changed_at, customer_id * 4 + seq AS kafka_offset, customer_id, first_name, last_name, email, phone, province, city, marketing_opt_in, created_at FROM customer_log",
    "cdc_products_typed": "SELECT 'u' AS op, false AS is_deleted, epoch_ms(changed_at) AS ts_ms, changed_at, kafka_offset, product_id, sku, product_name, category, CAST(price AS DOUBLE) AS price, CAST(cost AS DOUBLE) AS cost FROM product_log",
    "cdc_inventory_typed": "SELECT CASE seq WHEN 0 THEN 'r' ELSE 'u' END AS op, false AS is_deleted, 1000000000000 + seq * 1000 AS ts_ms, make_timestamp_ms(1000000000000 + seq * 1000) AS changed_at, product_id * 2 + seq AS kafka_offset, product_id, stock_on_hand, reorder_level FROM inventory_log",
    "abandoned_recent_days": "SELECT * FROM abandoned_daily WHERE cart_date > DATE '2024-01-31' - 30",
    "assert_approx_close": "SELECT window_start, stage, sessions, sessions AS approx FROM funnel_windows WHERE false",
    "source_freshness": "SELECT moment, CASE WHEN age > INTERVAL 24 HOUR THEN 'error' WHEN age > INTERVAL 2 HOUR THEN 'warn' ELSE 'pass' END AS state FROM (SELECT moment, date_trunc('day', last) + to_hours(h) - last AS age FROM (SELECT max(ingested_at) AS last FROM clicks), (VALUES ('soon', 25), ('later', 30), ('days', 72)) v(moment, h))",
    "source_csv_strings": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE '' END AS o_orderpriority, 'say \"' || o_orderstatus || '\", ok' AS note, true AS from_csv FROM orders",
    "source_partitions_since": "SELECT CAST(ts AS DATE) AS day, count(*) AS events FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1",
    "source_missing_folder": "SELECT * FROM region WHERE false",
    "sink_overwrite_days": "SELECT session_date, count(*) AS sessions FROM sessions WHERE session_date NOT BETWEEN DATE '2024-01-10' AND DATE '2024-01-19' OR (purchases > 0 AND isodow(session_date) < 6) GROUP BY 1",
    "sink_upsert_table": "SELECT origin, orders, CASE origin WHEN 'second' THEN (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') ELSE orders END AS reported FROM (SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'first' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'second' ELSE 'third' END AS origin, count(*) AS orders FROM orders GROUP BY 1)",
    "sink_published_mart": "SELECT status, count(*) AS orders, 2 AS version FROM order_core GROUP BY 1",
    "sink_rebuilt_warehouse": "SELECT 'dim_customers' AS name, count(*) AS n_rows, 1 AS version FROM dim_customers UNION ALL SELECT 'dim_products' AS name, count(*) AS n_rows, 1 AS version FROM dim_products UNION ALL SELECT 'dim_date' AS name, count(*) AS n_rows, 1 AS version FROM dim_date UNION ALL SELECT 'fct_orders' AS name, count(*) AS n_rows, 1 AS version FROM fct_orders UNION ALL SELECT 'fct_order_items' AS name, count(*) AS n_rows, 1 AS version FROM fct_order_items UNION ALL SELECT 'fct_sessions' AS name, count(*) AS n_rows, 1 AS version FROM fct_sessions UNION ALL SELECT 'sales_daily' AS name, count(*) AS n_rows, 1 AS version FROM sales_daily UNION ALL SELECT 'funnel_daily' AS name, count(*) AS n_rows, 1 AS version FROM funnel_daily UNION ALL SELECT 'delivery_sla' AS name, count(*) AS n_rows, 1 AS version FROM delivery_sla UNION ALL SELECT 'abandoned_carts_daily' AS name, count(*) AS n_rows, 1 AS version FROM abandoned_daily UNION ALL SELECT 'customer_rfm', count(*), 1 FROM rfm UNION ALL SELECT 'dq_scorecard', count(*), 1 FROM (SELECT DISTINCT dataset, rule_name, dimension FROM dq_results WHERE run_at >= TIMESTAMP '2001-12-31' - INTERVAL 7 DAY)",
    "sink_ingest_inbox": "SELECT g AS loaded, CAST(0 AS BIGINT) AS loaded_again, CAST(0 AS BIGINT) AS files_left, CAST(0 AS BIGINT) AS files_lost, g AS deliveries, b AS rejected, f AS failures FROM (SELECT (SELECT count(*) FROM good) AS g, (SELECT count(*) FROM ruled WHERE failed_rules <> '') AS b, (SELECT CAST(sum(failed) AS BIGINT) FROM (RULES)) AS f)",
    "sink_rejected_rows": "SELECT waybill, courier, status, failed_rules FROM ruled WHERE failed_rules <> ''",
    "stream_change_counts": "SELECT 'orders' AS table_name, op, CAST(count(*) + count(*) FILTER (kafka_offset % 10 = 0) AS BIGINT) AS changes FROM order_log GROUP BY op",
    "stream_funnel_late": """SELECT date_trunc('minute', event_time) AS window_start, stage, count(*) AS events FROM (
      SELECT *, unnest([event_type, 'any']) AS stage FROM (
        SELECT *, CASE WHEN event_id % 25 = 0 THEN least(due + 1, 2) ELSE due END AS delivery FROM (SELECT *, CAST(event_time >= TIMESTAMP '2024-01-11' AS INTEGER) + CAST(event_time >= TIMESTAMP '2024-01-21' AS INTEGER) AS due FROM clicks)) c
      WHERE delivery = due OR date_trunc('minute', event_time) + INTERVAL 1 MINUTE > (SELECT max(event_time) - INTERVAL 2 MINUTE FROM clicks w WHERE w.event_id % 25 <> 0 AND w.event_time < CASE c.due WHEN 0 THEN TIMESTAMP '2024-01-11' ELSE TIMESTAMP '2024-01-21' END))
      GROUP BY ALL""",
    "price_history": f"SELECT version, product_name, CAST(price AS DOUBLE) AS price, CAST(cost AS DOUBLE) AS cost, margin_pct, is_current, {_OPEN} FROM dim_products WHERE product_id = 42",
    "customer_profile": "SELECT c.customer_id, c.first_name, last_initial, email_masked, c.province, city, marketing_opt_in, version, segment, recency_days, frequency, monetary FROM dim_customers c LEFT JOIN rfm USING (customer_id) WHERE customer_id = 42 AND is_current",
    "customer_history": f"SELECT version, province, city, marketing_opt_in, {_OPEN} FROM dim_customers WHERE customer_id = 42",
    "customer_recent_orders": "SELECT order_id, placed_at, status, order_total, courier, delivery_hours FROM fct_orders WHERE customer_id = 42 ORDER BY placed_at DESC, order_id DESC LIMIT 10",
    "pii_masked": "SELECT customer_sk, email_masked, phone_masked FROM dim_customers",
    "upsert_ignore": "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'old' ELSE 'new' END AS origin FROM events",
    "upsert_update": "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'old' ELSE 'new' END AS origin FROM events",
    "ledger_pending_files": "SELECT DISTINCT 'orders_' || strftime(o_orderdate, '%Y%m') || '.csv' AS file_name FROM orders WHERE year(o_orderdate) >= 1999",
    "assert_unique": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "assert_not_null": "SELECT customer_sk FROM dim_customers WHERE phone_masked IS NULL",
    "assert_accepted": "SELECT order_id, status FROM order_core WHERE status NOT IN ('PLACED', 'PAID', 'SHIPPED')",
    "assert_between": "SELECT product_sk, margin_pct FROM dim_products WHERE margin_pct < 0.4 OR margin_pct > 1.0",
    "assert_one_current": "SELECT 'customer' AS dim, customer_id AS id FROM dim_customers WHERE is_current GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'product', product_id FROM dim_products WHERE is_current GROUP BY 2 HAVING count(*) > 1",
    "assert_totals_match": "SELECT order_id, order_total, items_value, shipping_fee FROM fct_orders WHERE lines > 0 AND abs(order_total - (items_value + shipping_fee)) > 0.01",
    "assert_no_pii": "SELECT customer_sk FROM dim_customers WHERE email_masked NOT LIKE '%***@%' OR NOT regexp_matches(phone_masked, '\\*{5}')",
    "assert_funnel_monotonic": "SELECT * FROM funnel_daily WHERE NOT (added_to_cart >= reached_checkout AND reached_checkout >= purchased)",
    "stream_bronze": "SELECT CAST(event_time AS DATE) AS event_date, count(*) AS events, count(DISTINCT event_id) AS ids FROM clicks GROUP BY 1",
    "stream_funnel": "SELECT window_start, stage, events FROM funnel_windows",
    "stream_carts": "SELECT session_id, customer_id, cart_value, items, date_trunc('second', last_activity_at) AS last_activity_second FROM carts",
    "stream_cdc": "SELECT op, count(*) AS changes FROM order_log GROUP BY 1",
}

_SELECT["live_product_cards"] = "SELECT product_id, product_name, category, CAST(price AS DOUBLE) AS price, epoch_ms(changed_at) AS ts_ms FROM product_log QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY changed_at DESC, kafka_offset DESC, price DESC) = 1"
_SELECT["live_customer_cards"] = "SELECT customer_id, first_name, province, city FROM customer_log WHERE op <> 'd' QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY seq DESC) = 1"

_SELECT["sink_snapshots"] = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, 2 AS snapshot FROM {t}" for t in ("dim_customers", "fct_orders", "sales_daily"))

#: The checks over inputs in which some rows fail.
_SELECT["assert_price_between"] = "SELECT product_sk, CAST(price AS DOUBLE) AS price FROM dim_products WHERE price < 1000 OR price > 90000"
_SELECT["assert_several_current"] = "SELECT 'customer' AS dim, customer_id AS id FROM customer_log WHERE op <> 'd' GROUP BY 2 HAVING count(*) > 1"
_SELECT["assert_unmasked_pii"] = "SELECT md5(customer_id || '-' || version) AS customer_sk FROM customer_versions WHERE marketing_opt_in"
_SELECT["approx_error_classes"] = "SELECT CASE WHEN minute(window_start) = 0 THEN 'off' ELSE 'within' END AS error, count(*) AS cells FROM funnel_windows GROUP BY 1"
_SELECT["source_folder_or_missing"] = "SELECT CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY 1"

_SELECT["stream_fct_orders"] = _SELECT["fct_orders"]

#: Views that the stream keeps hold what the same views over the whole log hold.
for _kept in ("status_board", "day_kpis", "recent_orders", "top_products", "low_stock", "product_cards", "customer_cards"):
    _SELECT[f"stream_{_kept}"] = _SELECT[f"live_{_kept}"]

#: Tables that are kept up to date hold what a rebuild over all changes holds.
for _kept, _rebuilt in (("fct_orders", "fct_orders"), ("fct_order_items", "fct_order_items"), ("dim_products", "dim_products_scd2"), ("sales_daily", "sales_daily"), ("customer_rfm", "rfm_segments")):
    _SELECT[f"refreshed_{_kept}"] = _SELECT[_rebuilt]

#: Reads of published tables give what the same reads of the plans give.
for _kept, _read in (("profile", "customer_profile"), ("history", "customer_history"), ("recent_orders", "customer_recent_orders"), ("price_history", "price_history")):
    _SELECT[f"published_{_kept}"] = _SELECT[_read]

#: Two runs of equal results.
_SELECT["sink_dq_results"] = (
    "SELECT 'deliveries' AS dataset, rule AS rule_name, dimension, CAST(2 AS BIGINT) AS runs, CAST(2 * checked AS BIGINT) AS checked_rows, CAST(2 * failed AS BIGINT) AS failed_rows, "
    f"floor(CAST(checked - failed AS DOUBLE) / CAST(nullif(checked, 0) AS DOUBLE) * 10000.0 + 0.5) / 10000.0 AS pass_rate FROM ({_SELECT['dq_rule_results']})"
)

_SELECT["sink_ingest_inbox"] = _SELECT["sink_ingest_inbox"].replace("RULES", _SELECT["dq_rule_results"])

ORACLE_SQL: dict[str, str] = {name: PRELUDE + sql for name, sql in _SELECT.items()}
