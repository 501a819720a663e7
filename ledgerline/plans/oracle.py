"""The same results in DuckDB SQL over the star tables, written independently of the jobs."""

import re

_GAPS = "list_transform(centers, lambda c: " + " + ".join(f"(z[{i}] - c[{i}]) * (z[{i}] - c[{i}])" for i in range(1, 6)) + ")"
_FIELDS = "abcde"


def _share(text: str) -> str:
    """A number from 0 up to 1: the first 48 bits of a text's MD5."""
    return f"(('0x' || substr(md5({text}), 1, 12))::BIGINT / 281474976710656::DOUBLE)"


def _ranges(over: str) -> str:
    """Rows of a node, and the least and greatest value of each column in it."""
    return f"count(*){over} AS n, [" + ", ".join(f"min({x}){over}" for x in _FIELDS) + "] AS low, [" + ", ".join(f"max({x}){over}" for x in _FIELDS) + "] AS high"


_OPEN = "list_filter([1, 2, 3, 4, 5], lambda i: low[i] < high[i])"
_COLUMN = f"""CASE WHEN depth >= deepest OR n <= 1 OR len({_OPEN}) = 0 THEN 0
    ELSE ({_OPEN})[1 + floor({_share("'42|' || tree || '|' || node || '|column'")} * len({_OPEN}))::INT] END"""
_CUT = f"""(low[col] + {_share("'42|' || tree || '|' || node || '|value'")} * (high[col] - low[col]))"""


def _walk() -> str:
    """Each distinct item at its leaf of each tree; no tree is deeper than eight."""
    at = "SELECT a, b, c, d, e, tree, 1::BIGINT AS node FROM (SELECT DISTINCT a, b, c, d, e FROM odd_items), (SELECT DISTINCT tree FROM samples)"
    value = "CASE col " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_FIELDS, 1)) + " END"
    for _ in range(8):
        at = f"""SELECT a, b, c, d, e, tree, CASE WHEN col = 0 THEN node WHEN {value} <= cut THEN 2 * node ELSE 2 * node + 1 END AS node
            FROM ({at}) JOIN nodes USING (tree, node)"""
    return at


# Building blocks. A query's WITH clause is made of the blocks it names, in this order.
BLOCKS = {
    "heads": """
        SELECT o_orderkey, o_orderkey::VARCHAR AS order_id, o_custkey::VARCHAR AS customer_id,
               li.suppkey::VARCHAR AS sales_rep_id, 'REG' || lpad((n_regionkey + 1)::VARCHAR, 2, '0') AS region_id,
               o_orderdate::DATE AS order_date,
               CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Returned' WHEN 'P' THEN 'Cancelled' END AS order_status,
               CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'Direct' WHEN o_orderpriority[1] = '3' THEN 'Partner'
                    WHEN o_orderpriority[1] IN ('4', '5') THEN 'Online' END AS sales_channel,
               (1 + ((date_diff('day', o_orderdate::DATE, li.first_ship) % 14) + 14) % 14)::INT AS delay_days,
               (5 * round(li.least_discount * 100))::INT AS percent_off,
               floor(o_totalprice * 100 + 0.5)::BIGINT AS price_cents, li.tax_cents
        FROM "orders"
        JOIN (SELECT l_orderkey, min(l_suppkey) AS suppkey, min(l_shipdate::DATE) AS first_ship, min(l_discount) AS least_discount,
                     sum(floor(l_extendedprice * l_tax * 100 + 0.5)::BIGINT) AS tax_cents
              FROM lineitem GROUP BY l_orderkey) li ON l_orderkey = o_orderkey
        LEFT JOIN supplier ON s_suppkey = li.suppkey
        LEFT JOIN nation ON n_nationkey = s_nationkey""",
    "t_regions": """
        SELECT 'REG' || lpad((r_regionkey + 1)::VARCHAR, 2, '0') AS region_id, r_name AS region_name, min(n_name) AS country
        FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
    "t_reps": """
        SELECT s_suppkey::VARCHAR AS sales_rep_id, s_name AS sales_rep_name,
               'REG' || lpad((n_regionkey + 1)::VARCHAR, 2, '0') AS region_id
        FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "t_customers": """
        SELECT c_custkey::VARCHAR AS customer_id, c_name AS customer_name, c_mktsegment AS customer_segment,
               DATE '1994-01-01' + (c_custkey % 500)::INT AS created_date
        FROM customer""",
    "t_products": """
        SELECT p_partkey::VARCHAR AS product_id, p_name AS product_name, p_type AS category,
               (round(p_retailprice * 100)::BIGINT::DECIMAL(18, 0) * 0.01)::DECIMAL(18, 4) AS base_price,
               (round(p_retailprice * 100)::BIGINT::DECIMAL(18, 0) * 0.006)::DECIMAL(18, 4) AS cost_price
        FROM part""",
    "t_items": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS order_item_id,
               l_orderkey::VARCHAR AS order_id, l_partkey::VARCHAR AS product_id, l_quantity::INT AS quantity,
               ((round(l_extendedprice * 100)::BIGINT // l_quantity::BIGINT)::DECIMAL(18, 0) * 0.01)::DECIMAL(18, 4) AS unit_price
        FROM lineitem""",
    "t_orders": """
        SELECT order_id, customer_id, sales_rep_id, region_id, order_date, order_date + delay_days AS shipping_date,
               order_status, sales_channel, delay_days FROM heads""",
    "t_discounts": """
        SELECT 'DSC' || order_id AS discount_id, order_id,
               (percent_off::DECIMAL(5, 0) * 0.01)::DECIMAL(9, 4) AS discount_percentage,
               'PROMO' || percent_off AS discount_code
        FROM heads WHERE percent_off > 0""",
    "t_returns": """
        SELECT 'RET' || order_id AS return_id, order_id, order_date + (delay_days + 2 + o_orderkey % 9)::INT AS return_date,
               CASE WHEN delay_days > 5 THEN 'Late Delivery' WHEN o_orderkey % 3 = 0 THEN 'Defective'
                    WHEN o_orderkey % 3 = 1 THEN 'Wrong Item' ELSE 'Unsatisfied' END AS return_reason
        FROM heads WHERE order_status = 'Returned'""",
    "t_spend": """
        SELECT concat_ws('-', 'MKT', region_id, strftime(order_date, '%Y-%m'), sales_channel) AS spend_id, region_id,
               strftime(order_date, '%Y-%m') AS campaign_month, sales_channel AS marketing_channel,
               (sum(tax_cents)::DECIMAL(18, 0) * 0.01)::DECIMAL(18, 4) AS spend_amount
        FROM heads WHERE region_id IS NOT NULL GROUP BY region_id, strftime(order_date, '%Y-%m'), sales_channel""",
    "t_targets": """
        SELECT concat_ws('-', 'TGT', region_id, target_month) AS target_id, region_id, target_month,
               (sum(price_cents)::DECIMAL(18, 0) * 0.01)::DECIMAL(18, 4) AS target_revenue
        FROM (SELECT region_id, price_cents, strftime(order_date + INTERVAL 1 YEAR, '%Y-%m') AS target_month FROM heads WHERE region_id IS NOT NULL)
        WHERE target_month <= (SELECT strftime(max(order_date), '%Y-%m') FROM heads) GROUP BY region_id, target_month""",
    "joined": """
        SELECT i.*, p.product_name, p.category, p.base_price, p.cost_price,
               o.customer_id, o.sales_rep_id, o.region_id, o.order_date, o.shipping_date, o.order_status, o.sales_channel, o.delay_days,
               c.customer_name, c.customer_segment, c.created_date, g.region_name, g.country,
               s.sales_rep_name, s.region_id AS region_id_rep,
               d.discount_id, coalesce(d.discount_percentage, 0)::DECIMAL(9, 4) AS discount_percentage,
               coalesce(d.discount_code, 'NONE') AS discount_code,
               r.return_id, r.return_date, coalesce(r.return_reason, 'N/A') AS return_reason,
               (i.quantity * i.unit_price)::DECIMAL(18, 4) AS gross_revenue,
               (i.quantity * p.cost_price)::DECIMAL(18, 4) AS cost_amount
        FROM t_items i LEFT JOIN t_products p USING (product_id) LEFT JOIN t_orders o USING (order_id)
        LEFT JOIN t_customers c USING (customer_id) LEFT JOIN t_regions g ON g.region_id = o.region_id
        LEFT JOIN t_reps s ON s.sales_rep_id = o.sales_rep_id
        LEFT JOIN t_discounts d ON d.order_id = i.order_id LEFT JOIN t_returns r ON r.order_id = i.order_id""",
    "priced": """
        SELECT *, gross_revenue - discount_amount AS net_revenue, gross_revenue - discount_amount - cost_amount AS gross_profit
        FROM (SELECT *, (gross_revenue * discount_percentage)::DECIMAL(18, 4) AS discount_amount FROM joined)""",
    "leaky": """
        SELECT *,
               CASE WHEN net_revenue > 0 THEN gross_profit::DOUBLE / net_revenue::DOUBLE ELSE 0 END AS profit_margin,
               (CASE WHEN discount_percentage > 0.20 THEN gross_revenue * (discount_percentage - 0.20) ELSE 0 END)::DECIMAL(18, 4) AS discount_leakage,
               (CASE WHEN order_status = 'Returned' THEN net_revenue ELSE 0 END)::DECIMAL(18, 4) AS return_leakage,
               (CASE WHEN order_status = 'Cancelled' AND delay_days > 5 THEN net_revenue ELSE 0 END)::DECIMAL(18, 4) AS delay_leakage,
               (CASE WHEN unit_price < base_price THEN (base_price - unit_price) * quantity ELSE 0 END)::DECIMAL(18, 4) AS pricing_leakage
        FROM priced""",
    "scored": """
        SELECT *, (leakage_amount > 0)::INT AS is_leakage,
               CASE WHEN net_revenue > 0 THEN leakage_amount::DOUBLE / (net_revenue + pricing_leakage)::DOUBLE ELSE 0 END AS leakage_score,
               delay_days AS order_delay, (order_status = 'Returned')::INT AS is_returned,
               year(order_date)::INT AS "year", year(order_date) || 'Q' || quarter(order_date) AS quarter,
               month(order_date)::INT AS month_num, strftime(order_date, '%Y-%m') AS "month",
               CASE WHEN month(order_date) IN (12, 1, 2) THEN 'Winter' WHEN month(order_date) < 6 THEN 'Spring'
                    WHEN month(order_date) < 9 THEN 'Summer' ELSE 'Autumn' END AS season
        FROM (SELECT *, discount_leakage + return_leakage + delay_leakage + pricing_leakage AS leakage_amount FROM leaky)""",
    "m": """
        SELECT *, (customer_order_rank > 1)::INT AS repeat_customer_indicator
        FROM (SELECT *,
                     dense_rank() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS customer_order_rank,
                     sum(net_revenue) OVER (PARTITION BY customer_id) AS customer_ltv,
                     (avg(is_returned) OVER (PARTITION BY customer_id) > 0.20
                      OR avg(leakage_score) OVER (PARTITION BY customer_id) > 0.25)::INT AS high_risk_customer
              FROM scored)""",
    "f": "SELECT * FROM m WHERE \"year\" = 1997 AND region_name = 'ASIA' AND sales_channel = 'Online'",
    "goal_f": """
        SELECT coalesce(sum(target_revenue), 0)::DOUBLE AS goal FROM t_targets
        WHERE region_id IN (SELECT region_id FROM f) AND target_month LIKE '1997%'""",
    "rfm": """
        SELECT customer_id, customer_name, customer_segment,
               date_diff('day', max(order_date), (SELECT max(order_date) FROM m))::INT AS recency,
               count(DISTINCT order_id) AS frequency, sum(net_revenue)::DOUBLE AS monetary,
               sum(discount_percentage)::DOUBLE / count(*) AS discount_percentage,
               sum(is_returned)::DOUBLE / count(*) AS is_returned
        FROM m GROUP BY ALL""",
    "segmented": """
        SELECT * EXCLUDE (gaps), (list_position(gaps, list_min(gaps)) - 1)::INT AS cluster,
               CASE list_position(gaps, list_min(gaps)) WHEN 1 THEN 'High Return Risk' WHEN 2 THEN 'VIP High-Value'
                    WHEN 3 THEN 'Discount Seekers' ELSE 'Standard Customers' END AS segment_name
        FROM (SELECT rfm.*, [pow(a - 1, 2) + pow(b + 1, 2) + pow(c + 1, 2) + pow(d, 2) + pow(e - 1, 2),
                             pow(a + 0.5, 2) + pow(b - 1, 2) + pow(c - 1, 2) + pow(d, 2) + pow(e, 2),
                             pow(a, 2) + pow(b, 2) + pow(c + 0.5, 2) + pow(d - 1, 2) + pow(e + 0.5, 2),
                             pow(a, 2) + pow(b, 2) + pow(c, 2) + pow(d + 0.5, 2) + pow(e, 2)] AS gaps
              FROM rfm JOIN (SELECT customer_id, (recency::DOUBLE - 200) / 150 AS a, (frequency::DOUBLE - 8) / 4 AS b,
                                    (monetary - 400000) / 250000 AS c, (discount_percentage - 0.2) / 0.1::DOUBLE AS d,
                                    (is_returned - 0.3) / 0.2::DOUBLE AS e FROM rfm) USING (customer_id))""",
    "strange": """
        SELECT *, (anomaly_gap < 0)::INT AS is_anomaly
        FROM (SELECT *, 0.68::DOUBLE - pow(2::DOUBLE, -depths / 3 / (2 * (ln(15::DOUBLE) + 0.5772156649015329) - 2 * 15::DOUBLE / 16)) AS anomaly_gap
              FROM (SELECT *, CASE WHEN gross_revenue <= 50000 THEN 3.5 WHEN discount_percentage <= 0.2 THEN 2.5 ELSE 2.0 END::DOUBLE
                              + CASE WHEN delay_days > 7 THEN 1.5 WHEN is_returned = 0 THEN 4.0 ELSE 2.2 END::DOUBLE
                              + CASE WHEN profit_margin <= 0.1::DOUBLE THEN 1.2 WHEN gross_revenue <= 20000 THEN 3.0 ELSE 3.8 END::DOUBLE AS depths
                    FROM m))""",
    # k-means: ten starts by hash, twenty rounds, all centers of a start in one row.
    "scales": """
        SELECT [avg(recency), avg(frequency), avg(monetary), avg(discount_percentage), avg(is_returned)] AS mean,
               [stddev_samp(recency), stddev_samp(frequency), stddev_samp(monetary), stddev_samp(discount_percentage), stddev_samp(is_returned)] AS std
        FROM rfm""",
    "points": """
        SELECT customer_id, customer_name, customer_segment,
               list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN std[i] > 0 THEN (x[i] - mean[i]) / std[i] ELSE 0.0::DOUBLE END) AS z
        FROM (SELECT *, [recency::DOUBLE, frequency::DOUBLE, monetary, discount_percentage, is_returned] AS x FROM rfm), scales""",
    "rounds": f"""
        SELECT 0 AS step, start, list(z ORDER BY ticket, customer_id, customer_name, customer_segment) AS centers
        FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY ticket, customer_id, customer_name, customer_segment) AS place
              FROM (SELECT *, md5(concat_ws('|', '42', start, customer_id, customer_name, customer_segment)) AS ticket
                    FROM points, (SELECT unnest(range(10)) AS start)))
        WHERE place <= 4 GROUP BY start
        UNION ALL
        SELECT step + 1, start, [{", ".join("[" + ", ".join(f"coalesce(avg(z[{i}]) FILTER (WHERE near = {j}), any_value(centers)[{j}][{i}])" for i in range(1, 6)) + "]" for j in range(1, 5))}]
        FROM (SELECT *, list_position(gaps, list_min(gaps)) AS near FROM (SELECT step, start, centers, z, {_GAPS} AS gaps FROM rounds, points))
        GROUP BY step, start HAVING step < 20""",
    "best": f"""
        SELECT centers FROM (SELECT start, any_value(centers) AS centers, round(sum(list_min({_GAPS})), 6) AS cost
                             FROM rounds, points WHERE step = 20 GROUP BY start) ORDER BY cost, start LIMIT 1""",
    "plain_centers": """
        SELECT j, list_transform([1, 2, 3, 4, 5], lambda i: centers[j][i] * std[i] + mean[i]) AS c FROM best, scales, (SELECT unnest([1, 2, 3, 4]) AS j)""",
    "risk": "SELECT j FROM plain_centers ORDER BY c[5] DESC, j LIMIT 1",
    "vip": "SELECT j FROM plain_centers WHERE j NOT IN (SELECT j FROM risk) ORDER BY c[3] DESC, j LIMIT 1",
    "seekers": "SELECT j FROM plain_centers WHERE j NOT IN (SELECT j FROM risk UNION ALL SELECT j FROM vip) ORDER BY c[4] DESC, j LIMIT 1",
    "segmented_trained": f"""
        SELECT rfm.*, (near - 1)::INT AS cluster,
               CASE WHEN near IN (SELECT j FROM risk) THEN 'High Return Risk' WHEN near IN (SELECT j FROM vip) THEN 'VIP High-Value'
                    WHEN near IN (SELECT j FROM seekers) THEN 'Discount Seekers' ELSE 'Standard Customers' END AS segment_name
        FROM rfm JOIN (SELECT customer_id, customer_name, customer_segment, list_position(gaps, list_min(gaps)) AS near
                       FROM (SELECT points.*, {_GAPS} AS gaps FROM points, best)) USING (customer_id, customer_name, customer_segment)""",
    # Isolation forest: samples, columns and cuts by hash; the children of node i are 2i and 2i + 1.
    "odd_items": """
        SELECT order_item_id, gross_revenue::DOUBLE AS a, discount_percentage::DOUBLE AS b, delay_days::DOUBLE AS c,
               profit_margin::DOUBLE AS d, is_returned::DOUBLE AS e,
               concat_ws('|', order_item_id, floor(a * 1000000::DOUBLE + 0.5)::BIGINT, floor(b * 1000000::DOUBLE + 0.5)::BIGINT,
                         floor(c * 1000000::DOUBLE + 0.5)::BIGINT, floor(d * 1000000::DOUBLE + 0.5)::BIGINT, floor(e * 1000000::DOUBLE + 0.5)::BIGINT) AS item
        FROM m""",
    "shares": """
        SELECT count(*) AS n, CASE WHEN count(*) <= 512 THEN 1.0::DOUBLE ELSE 512::DOUBLE / count(*) END AS keep FROM odd_items""",
    "samples": f"""
        SELECT tree, a, b, c, d, e
        FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY ticket, a, b, c, d, e) AS place
              FROM (SELECT odd_items.*, tree, keep, {_share("'42|' || tree || '|' || item")} AS ticket
                    FROM odd_items, shares, (SELECT unnest(range(100)) AS tree)
                    WHERE {_share("'42|' || item")} < least(1.0::DOUBLE, 100 * keep))
              WHERE ticket < keep / least(1.0::DOUBLE, 100 * keep))
        WHERE place <= 256""",
    "grown": f"""
        SELECT 0 AS depth, tree, 1::BIGINT AS node, ceil(log2(greatest(count(*) OVER (PARTITION BY tree), 2)))::INT AS deepest, a, b, c, d, e FROM samples
        UNION ALL
        SELECT depth + 1, tree, 2 * node + CASE WHEN [a, b, c, d, e][col] <= {_CUT} THEN 0 ELSE 1 END, deepest, a, b, c, d, e
        FROM (SELECT *, {_COLUMN} AS col FROM (SELECT *, {_ranges(" OVER w")} FROM grown WINDOW w AS (PARTITION BY tree, node)))
        WHERE col > 0""",
    "nodes": f"""
        SELECT tree, node, col, CASE WHEN col > 0 THEN {_CUT} END AS cut,
               depth * 1000000 + round(1000000 * CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1
                   ELSE 2 * (ln(n - 1.0::DOUBLE) + 0.5772156649015329) - 2 * (n - 1.0::DOUBLE) / n END)::BIGINT AS deep
        FROM (SELECT *, {_COLUMN} AS col
              FROM (SELECT tree, node, any_value(depth) AS depth, any_value(deepest) AS deepest, {_ranges("")} FROM grown GROUP BY tree, node))""",
    "depths": f"""
        SELECT a, b, c, d, e, sum(deep)::BIGINT AS total, count(*) AS trees FROM ({_walk()}) JOIN nodes USING (tree, node) GROUP BY ALL""",
    "raw_scores": """
        SELECT odd_items.*, -pow(2::DOUBLE, -(total / 1000000::DOUBLE / trees) / (2 * (ln(psi - 1.0::DOUBLE) + 0.5772156649015329) - 2 * (psi - 1.0::DOUBLE) / psi)) AS raw
        FROM odd_items JOIN depths USING (a, b, c, d, e), (SELECT least(256, n) AS psi FROM shares)""",
    "strange_trained": """
        SELECT m.*, raw - edge AS anomaly_gap, (raw - edge < 0)::INT AS is_anomaly
        FROM m JOIN (SELECT DISTINCT a, b, c, d, e, raw FROM raw_scores) s
             ON gross_revenue::DOUBLE = a AND discount_percentage::DOUBLE = b AND delay_days::DOUBLE = c AND profit_margin = d AND is_returned::DOUBLE = e,
             (SELECT quantile_cont(raw, 0.06) AS edge FROM raw_scores)""",
    "q1": """
        SELECT customer_id, customer_name, customer_segment, count(DISTINCT order_id) AS total_orders,
               round(sum(net_revenue), 2)::DOUBLE AS total_net_revenue, round(sum(gross_profit), 2)::DOUBLE AS total_profit,
               round(avg(profit_margin) * 100, 2) AS avg_profit_margin_pct,
               rank() OVER (ORDER BY sum(net_revenue) DESC)::INT AS revenue_rank
        FROM m WHERE order_status <> 'Cancelled' GROUP BY customer_id, customer_name, customer_segment""",
    "q3": """
        SELECT p.product_id, p.product_name, p.category, count(DISTINCT s.order_id) AS total_orders,
               coalesce(sum(s.quantity), 0)::BIGINT AS total_qty,
               round(coalesce(sum(s.net_revenue), 0), 2)::DOUBLE AS net_revenue,
               round(coalesce(sum(s.gross_profit), 0), 2)::DOUBLE AS profit,
               round(coalesce(sum(s.gross_profit)::DOUBLE / nullif(sum(s.net_revenue)::DOUBLE, 0), 0) * 100, 2) AS profit_margin_pct,
               coalesce(sum(CASE WHEN s.order_status = 'Returned' THEN s.quantity END), 0)::BIGINT AS returned_qty,
               round(coalesce(sum(CASE WHEN s.order_status = 'Returned' THEN s.quantity END), 0)::DOUBLE
                     / nullif(sum(s.quantity)::DOUBLE, 0) * 100, 2) AS return_rate_pct
        FROM t_products p LEFT JOIN priced s ON s.product_id = p.product_id GROUP BY p.product_id, p.product_name, p.category""",
    "months": """SELECT "month", sum(net_revenue) AS net FROM m GROUP BY "month" """,
    "two": """
        SELECT max(CASE WHEN n = 1 THEN "month" END) AS latest_month, max(CASE WHEN n = 2 THEN "month" END) AS prev_month,
               max(CASE WHEN n = 1 THEN net END) AS latest_net, max(CASE WHEN n = 2 THEN net END) AS prev_net
        FROM (SELECT *, row_number() OVER (ORDER BY "month" DESC) AS n FROM months)""",
    "change": """
        SELECT CASE WHEN prev_month IS NULL THEN 'insufficient_data' WHEN latest_net >= prev_net THEN 'growth' ELSE 'decline' END AS status,
               latest_month, prev_month, (latest_net - prev_net)::DOUBLE AS change_amount,
               (latest_net - prev_net)::DOUBLE / prev_net::DOUBLE * 100 AS change_pct FROM two""",
    "cat_drop": """
        SELECT category, drop_amount::DOUBLE AS drop_amount FROM (
            SELECT category, coalesce(sum(CASE WHEN "month" = latest_month THEN net_revenue END), 0)
                             - sum(CASE WHEN "month" = prev_month THEN net_revenue END) AS drop_amount
            FROM m, two GROUP BY category)
        WHERE drop_amount IS NOT NULL AND (SELECT status FROM change) = 'decline' ORDER BY drop_amount, category LIMIT 1""",
    "reg_drop": """
        SELECT region_name, drop_amount::DOUBLE AS drop_amount FROM (
            SELECT region_name, coalesce(sum(CASE WHEN "month" = latest_month THEN net_revenue END), 0)
                                - sum(CASE WHEN "month" = prev_month THEN net_revenue END) AS drop_amount
            FROM m, two GROUP BY region_name)
        WHERE drop_amount IS NOT NULL AND (SELECT status FROM change) = 'decline' ORDER BY drop_amount, region_name LIMIT 1""",
    "spike": """
        SELECT sum(discount_percentage) FILTER ("month" = latest_month)::DOUBLE / count(*) FILTER ("month" = latest_month)
               - sum(discount_percentage) FILTER ("month" = prev_month)::DOUBLE / count(*) FILTER ("month" = prev_month) AS discount_spike,
               sum(is_returned) FILTER ("month" = latest_month)::DOUBLE / count(*) FILTER ("month" = latest_month)
               - sum(is_returned) FILTER ("month" = prev_month)::DOUBLE / count(*) FILTER ("month" = prev_month) AS return_spike
        FROM m, two""",
    "wasted": """
        SELECT region_id, "month", (spent - prev_spent)::DOUBLE AS spend_increase, (prev_net - net)::DOUBLE AS revenue_decrease,
               net::DOUBLE / spent::DOUBLE AS roi
        FROM (SELECT *, lag(net) OVER w AS prev_net, lag(spent) OVER w AS prev_spent
              FROM (SELECT region_id, "month", sum(net_revenue) AS net FROM m GROUP BY ALL)
              JOIN (SELECT region_id, campaign_month AS "month", sum(spend_amount) AS spent FROM t_spend GROUP BY ALL)
              USING (region_id, "month") WINDOW w AS (PARTITION BY region_id ORDER BY "month"))
        WHERE spent > prev_spent AND net < prev_net""",
    "rule1": """
        SELECT 'discount_approval' AS rule, sales_rep_name AS subject, v::DOUBLE AS "value", NULL::DOUBLE AS detail, 'High' AS impact
        FROM (SELECT sales_rep_name, sum(discount_leakage) AS v FROM m GROUP BY 1 ORDER BY v DESC, 1 LIMIT 1) WHERE v > 5000""",
    "rule2": """
        SELECT 'delivery_audit' AS rule, region_name AS subject, v::DOUBLE AS "value", d AS detail, 'High' AS impact
        FROM (SELECT region_name, sum(delay_leakage) AS v, sum(delay_days)::DOUBLE / count(*) AS d FROM m GROUP BY 1
              ORDER BY v DESC, 1 LIMIT 1) WHERE v > 2000""",
    "rule3": """
        SELECT 'quality_review' AS rule, category AS subject, v AS "value", NULL::DOUBLE AS detail, 'Medium' AS impact
        FROM (SELECT category, sum(is_returned)::DOUBLE / count(*) AS v FROM m GROUP BY 1 HAVING sum(is_returned) > 0
              ORDER BY v DESC, 1 LIMIT 1) WHERE v > 0.08""",
    "rule4": """
        SELECT 'marketing_budget' AS rule, region_name AS subject, revenue_decrease AS "value", roi AS detail, 'Medium' AS impact, "month"
        FROM wasted JOIN t_regions USING (region_id) ORDER BY revenue_decrease DESC, region_id, "month" LIMIT 1""",
    "recs": """
        SELECT 1 AS rank, *, NULL AS "month" FROM rule1 UNION ALL SELECT 2, *, NULL FROM rule2
        UNION ALL SELECT 3, *, NULL FROM rule3 UNION ALL SELECT 4, * FROM rule4""",
    "all_recs": """
        SELECT * FROM recs UNION ALL SELECT 5, 'price_audit', 'all', 0.0, NULL, 'Low', NULL WHERE NOT EXISTS (SELECT 1 FROM recs)""",
    "i_1": """SELECT 'top_performing_product' AS insight, product_name AS subject, sum(net_revenue)::DOUBLE AS "value"
              FROM m GROUP BY product_name ORDER BY sum(net_revenue) DESC, product_name LIMIT 1""",
    "i_2": """SELECT 'worst_performing_region' AS insight, g.region_name AS subject, a.net::DOUBLE / t.goal::DOUBLE AS "value"
              FROM (SELECT region_id, sum(net_revenue) AS net FROM m GROUP BY 1) a
              JOIN (SELECT region_id, sum(target_revenue) AS goal FROM t_targets GROUP BY 1) t USING (region_id)
              JOIN t_regions g USING (region_id) ORDER BY "value", region_id LIMIT 1""",
    "i_3": """SELECT 'highest_value_customer' AS insight, customer_name AS subject, sum(net_revenue)::DOUBLE AS "value"
              FROM m GROUP BY customer_name ORDER BY sum(net_revenue) DESC, customer_name LIMIT 1""",
    "i_4": """SELECT 'most_returned_category' AS insight, category AS subject, sum(quantity)::DOUBLE AS "value"
              FROM m WHERE is_returned = 1 GROUP BY category ORDER BY sum(quantity) DESC, category LIMIT 1""",
    "i_5": """SELECT 'highest_leakage_category' AS insight, category AS subject, sum(leakage_amount)::DOUBLE AS "value"
              FROM m GROUP BY category ORDER BY sum(leakage_amount) DESC, category LIMIT 1""",
    "i_6": """SELECT 'fastest_growing_region' AS insight, region_name AS subject, (b - a)::DOUBLE / a::DOUBLE AS "value"
              FROM (SELECT region_name, sum(net_revenue) FILTER (2 * date_diff('day', lo, order_date) < date_diff('day', lo, hi)) AS a,
                           sum(net_revenue) FILTER (2 * date_diff('day', lo, order_date) >= date_diff('day', lo, hi)) AS b
                    FROM m, (SELECT min(order_date) AS lo, max(order_date) AS hi FROM m) GROUP BY region_name)
              WHERE a IS NOT NULL AND b IS NOT NULL ORDER BY "value" DESC, region_name LIMIT 1""",
    "i_7": """SELECT unnest(['total_net_revenue', 'total_leakage', 'overall_leakage_rate']) AS insight, 'all' AS subject,
                     unnest([sum(net_revenue)::DOUBLE, sum(leakage_amount)::DOUBLE,
                             CASE WHEN sum(net_revenue) > 0 THEN sum(leakage_amount)::DOUBLE / sum(net_revenue + pricing_leakage)::DOUBLE ELSE 0 END]) AS "value"
              FROM m""",
}

TABLE_BLOCKS = {
    "customers": "t_customers", "products": "t_products", "regions": "t_regions", "reps": "t_reps", "orders": "t_orders",
    "order_items": "t_items", "discounts": "t_discounts", "returns": "t_returns", "marketing_spend": "t_spend",
    "monthly_targets": "t_targets",
}
CAUSES = ["discount_leakage", "return_leakage", "delay_leakage", "pricing_leakage"]
NUMERIC = [
    "gross_revenue", "net_revenue", "cost_amount", "gross_profit",
    "profit_margin", "discount_percentage", "delay_days", "leakage_amount",
]
MONEY_COLUMNS = {
    "unit_price", "base_price", "cost_price", "gross_revenue", "cost_amount", "discount_amount", "net_revenue", "gross_profit",
    "discount_percentage", "leakage_amount", "customer_ltv", "spend_amount", "target_revenue", *CAUSES,
}


def _least_squares(name: str, group: str) -> dict[str, str]:
    """Forecasts of each group with six months or more: normal equations of standardised features, solved by elimination,
    then one month after the other."""
    six = "[1, 2, 3, 4, 5, 6]"
    each = lambda text: "[" + ", ".join(text.format(i=i) for i in range(1, 7)) + "]"
    season = "2 * pi() * {0} / 12"
    return {
        f"{name}_months": f"""
            SELECT g, "month", y, row_number() OVER w AS t, lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2, lag(y, 3) OVER w AS l3, count(*) OVER (PARTITION BY g) AS n
            FROM (SELECT {group} AS g, "month", sum(net_revenue)::DOUBLE AS y FROM m GROUP BY ALL) WINDOW w AS (PARTITION BY g ORDER BY "month")""",
        f"{name}_rows": f"""
            SELECT g, y, n, [t::DOUBLE, sin({season.format('"month"[6:7]::INT')}), cos({season.format('"month"[6:7]::INT')}), l1, l2, l3] AS x
            FROM {name}_months WHERE l3 IS NOT NULL AND n >= 6""",
        f"{name}_scale": f"""
            SELECT g, any_value(n) AS n, count(*) AS known, avg(y) AS middle, {each("avg(x[{i}])")} AS mean, {each("stddev_pop(x[{i}])")} AS std
            FROM {name}_rows GROUP BY g""",
        f"{name}_z": f"""
            SELECT g, y - middle AS v, list_transform({six}, lambda i: (x[i] - mean[i]) / std[i]) AS z FROM {name}_rows JOIN {name}_scale USING (g)""",
        f"{name}_steps": f"""
            SELECT g, 1 AS k, [{", ".join("[" + ", ".join(f"sum(z[{i}] * z[{j}])" for j in range(1, 7)) + f", sum(z[{i}] * v)]" for i in range(1, 7))}] AS aug
            FROM {name}_z GROUP BY g
            UNION ALL
            SELECT g, k + 1, list_transform({six}, lambda i: CASE WHEN i = k THEN aug[i]
                       ELSE list_transform([1, 2, 3, 4, 5, 6, 7], lambda j: aug[i][j] - aug[i][k] / aug[k][k] * aug[k][j]) END)
            FROM {name}_steps WHERE k <= 6""",
        f"{name}_fit": f"""
            SELECT g, any_value(coef) AS coef, sqrt(sum(pow(v - list_sum(list_transform({six}, lambda i: coef[i] * z[i])), 2)) / (any_value(known) - 6)) AS error
            FROM (SELECT g, list_transform({six}, lambda i: aug[i][7] / aug[i][i]) AS coef FROM {name}_steps WHERE k = 7)
                 JOIN {name}_z USING (g) JOIN {name}_scale USING (g) GROUP BY g""",
        f"{name}_rolled": f"""
            SELECT g, 0 AS step, "month"[1:4]::INT * 12 + "month"[6:7]::INT - 1 AS nth, [y, l1, l2] AS past, y AS value FROM {name}_months WHERE t = n AND n >= 6
            UNION ALL
            SELECT g, step, nth, [value, past[1], past[2]], value
            FROM (SELECT g, step + 1 AS step, nth + 1 AS nth, past,
                         middle + list_sum(list_transform({six}, lambda i: coef[i] * ([(n + step + 1)::DOUBLE, sin({season.format("((nth + 1) % 12 + 1)")}), cos({season.format("((nth + 1) % 12 + 1)")}),
                                                                                   past[1], past[2], past[3]][i] - mean[i]) / std[i])) AS value
                  FROM {name}_rolled JOIN {name}_fit USING (g) JOIN {name}_scale USING (g) WHERE step < 6)""",
        f"{name}_ahead": f"""
            SELECT g, (nth // 12) || '-' || lpad((nth % 12 + 1)::VARCHAR, 2, '0') AS "month", step::INT AS step, round(value, 0) + 0.0 AS forecasted_revenue,
                   round(greatest(0.0::DOUBLE, value - 1.96::DOUBLE * error * sqrt(1 + 0.1::DOUBLE * (step - 1))), 0) + 0.0 AS lower_ci,
                   round(value + 1.96::DOUBLE * error * sqrt(1 + 0.1::DOUBLE * (step - 1)), 0) + 0.0 AS upper_ci
            FROM {name}_rolled JOIN {name}_fit USING (g) WHERE step > 0""",
    }


BLOCKS |= _least_squares("whole", "''") | _least_squares("parts", "region_name || '|' || category")


def _with(body: str) -> str:
    """Put the blocks a text needs, and the blocks those need, in front of it."""
    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in BLOCKS:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                todo.append(BLOCKS[name])
    parts = [f"{name} AS MATERIALIZED ({text})" for name, text in BLOCKS.items() if name in needed]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


def _columns(*names: str) -> str:
    return ", ".join(f'"{n}"::DOUBLE AS "{n}"' if n in MONEY_COLUMNS else f'"{n}"' for n in names)


def _d(*names: str) -> str:
    """Exact sums as doubles."""
    return ", ".join(f"coalesce(sum({n}), 0)::DOUBLE AS {n}" for n in names)


def _digests(rows: dict[str, tuple[str, list[tuple[str, str]]]]) -> str:
    """Every cell of every row of tables, as a digest a row: {name: (block, [(column, type)])}."""
    text = lambda c, t: f"""coalesce("{c}"::{'DECIMAL(18, 6)' if t == 'double' else 'VARCHAR'}::VARCHAR, '~')"""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", md5(concat_ws('|', {', '.join(text(*c) for c in columns)})) AS row_md5 FROM {block}"
        for name, (block, columns) in rows.items()
    )


ITEM = ("order_item_id", "order_id", "product_id")
BODIES: dict[str, str] = {}


def _add(**bodies: str) -> None:
    BODIES.update(bodies)


from ledgerline.schemas import MASTER, MASTER_COLUMNS, TABLES  # noqa: E402

_typed = lambda schema: [(f.name, f.dataType.simpleString()) for f in schema]
_TABLE_ROWS = _digests({t: (b, _typed(TABLES[t])) for t, b in TABLE_BLOCKS.items()})
_MASTER_ROWS = _digests({kind: ("m", _typed(MASTER)) for kind in ("parquet", "csv")})

for _table, _block in TABLE_BLOCKS.items():
    BODIES[f"s2_star_{_table}"] = f"SELECT {_columns(*TABLES[_table].fieldNames())} FROM {_block}"

_add(
    s1_read_tables=_TABLE_ROWS,
    s3_validate="""
        SELECT 'regions' AS "table", 'country' AS "column", 'missing column' AS error
        UNION ALL SELECT 'products', 'base_price', 'expected float, got string'
        UNION ALL SELECT 'discounts', 'discount_percentage', 'expected float, got string'
        UNION ALL SELECT 'products', 'base_price', count(*) || ' values are not float' FROM t_products""",
    s4_dedup_report="""
        SELECT 'discounts' AS "table", 2 * count(*) AS before, count(*) AS after, count(*) AS removed FROM t_discounts
        UNION ALL SELECT 'order_items', (SELECT count(*) FROM t_items), count(*), (SELECT count(*) FROM t_items) - count(*)
        FROM (SELECT DISTINCT * FROM t_items)""",
    s5_standardise_dates="""
        SELECT order_id, order_date, CASE WHEN delay_days <> 1 THEN shipping_date END AS shipping_date FROM t_orders""",
    s6_write_tables=_TABLE_ROWS,
    s7_write_master=_MASTER_ROWS,
    s8_view_monthly_summary=f"""
        SELECT "month", count(order_id) AS total_orders,
               {_d("gross_revenue", "discount_amount", "net_revenue", "cost_amount", "gross_profit")},
               round(avg(profit_margin), 6) + 0.0 AS avg_profit_margin, {_d("leakage_amount")} FROM m GROUP BY "month" """,
    s11_ad_hoc_sql="""
        SELECT sales_channel, count(*) AS late_orders FROM t_orders JOIN t_regions USING (region_id)
        WHERE delay_days > 5 AND region_name = 'ASIA' GROUP BY sales_channel""",
    s12_filter_values=" UNION ".join(
        f"SELECT '{f}' AS field, {c}::VARCHAR AS \"value\" FROM m WHERE {c} IS NOT NULL"
        for f, c in {"region": "region_name", "segment": "customer_segment", "category": "category",
                     "channel": "sales_channel", "year": '"year"'}.items()
    ),
    s13_order_ids="SELECT order_id FROM t_orders ORDER BY order_id LIMIT 100",
    m1_items_products=f"""SELECT {_columns("product_id", "order_item_id", "order_id", "quantity", "unit_price", "product_name",
        "category", "base_price", "cost_price")} FROM t_items LEFT JOIN t_products USING (product_id)""",
    m2_items_orders=f"""SELECT {_columns("order_id", "order_item_id", "product_id", "quantity", "unit_price", "customer_id",
        "sales_rep_id", "region_id", "order_date", "shipping_date", "order_status", "sales_channel", "delay_days")}
        FROM t_items LEFT JOIN t_orders USING (order_id)""",
    m3_orders_customers_regions="""
        SELECT o.*, customer_name, customer_segment, created_date, region_name, country
        FROM t_orders o LEFT JOIN t_customers USING (customer_id) LEFT JOIN t_regions g ON g.region_id = o.region_id""",
    m4_orders_reps="""
        SELECT order_id, o.sales_rep_id, o.region_id, sales_rep_name, r.region_id AS region_id_rep
        FROM t_orders o LEFT JOIN t_reps r ON r.sales_rep_id = o.sales_rep_id""",
    m5_orders_discounts="""
        SELECT o.order_id, discount_id, coalesce(discount_percentage, 0)::DOUBLE AS discount_percentage,
               coalesce(discount_code, 'NONE') AS discount_code
        FROM t_orders o LEFT JOIN t_discounts d ON d.order_id = o.order_id""",
    m6_orders_returns="""
        SELECT o.order_id, return_id, return_date, coalesce(return_reason, 'N/A') AS return_reason
        FROM t_orders o LEFT JOIN t_returns r ON r.order_id = o.order_id""",
    m7_amounts=f"""SELECT {_columns(*ITEM, "gross_revenue", "cost_amount", "discount_amount", "net_revenue", "gross_profit")} FROM priced""",
    m8_profit_margin=f"""SELECT {_columns(*ITEM, "profit_margin")} FROM leaky""",
    m9_discount_leakage=f"""SELECT {_columns(*ITEM, "discount_leakage")} FROM leaky""",
    m10_return_leakage=f"""SELECT {_columns(*ITEM, "return_leakage")} FROM leaky""",
    m11_delay_leakage=f"""SELECT {_columns(*ITEM, "delay_leakage")} FROM leaky""",
    m12_pricing_leakage=f"""SELECT {_columns(*ITEM, "pricing_leakage")} FROM leaky""",
    m13_leakage_total=f"""SELECT {_columns(*ITEM, *CAUSES, "leakage_amount", "is_leakage", "leakage_score")} FROM scored""",
    m14_order_flags="SELECT order_id, delay_days AS order_delay, (order_status = 'Returned')::INT AS is_returned FROM t_orders",
    m15_date_parts="""
        SELECT order_id, year(order_date)::INT AS "year", year(order_date) || 'Q' || quarter(order_date) AS quarter,
               month(order_date)::INT AS month_num, strftime(order_date, '%Y-%m') AS "month" FROM t_orders""",
    m16_season="""
        SELECT order_id, CASE (month(order_date) % 12) // 3 WHEN 0 THEN 'Winter' WHEN 1 THEN 'Spring' WHEN 2 THEN 'Summer'
                              ELSE 'Autumn' END AS season FROM t_orders""",
    m17_customer_order_rank="SELECT DISTINCT order_id, customer_order_rank, repeat_customer_indicator FROM m",
    m18_customer_ltv="SELECT customer_id, sum(net_revenue)::DOUBLE AS customer_ltv FROM m GROUP BY 1",
    m19_high_risk_customer="SELECT DISTINCT customer_id, high_risk_customer FROM m",
    m20_build_master=f"SELECT {_columns(*MASTER_COLUMNS)} FROM m",
    f1_filter_master=f"""SELECT {_columns(*ITEM, "year", "region_name", "sales_channel", "net_revenue")} FROM f""",
    f1_filter_all_fields="""
        SELECT order_status, count(*) AS items, sum(net_revenue)::DOUBLE AS net_revenue FROM m
        WHERE "year" = 1998 AND region_name = 'EUROPE' AND customer_segment = 'BUILDING' AND category = 'SMALL'
              AND sales_channel = 'Direct' GROUP BY order_status""",
    f2_filter_targets=f"""SELECT {_columns("target_id", "region_id", "target_month", "target_revenue")} FROM t_targets
        WHERE region_id IN (SELECT region_id FROM f) AND target_month LIKE '1997%'""",
    f3_restrict_customers="""
        SELECT customer_id, recency, frequency, monetary FROM rfm
        WHERE customer_id IN (SELECT customer_id FROM f) OR NOT EXISTS (SELECT 1 FROM f)""",
    f3_restrict_customers_fallback="SELECT customer_id, recency, frequency, monetary FROM rfm",
    q1_top_customers="SELECT * FROM q1",
    q2_top_products="""
        SELECT product_id, product_name, category, sum(quantity)::BIGINT AS total_quantity_sold,
               round(sum(gross_revenue), 2)::DOUBLE AS gross_product_revenue, round(sum(net_revenue), 2)::DOUBLE AS net_product_revenue,
               round(sum(gross_profit), 2)::DOUBLE AS product_profit,
               round(sum(gross_profit)::DOUBLE / nullif(sum(net_revenue)::DOUBLE, 0) * 100, 2) AS profit_margin_pct,
               rank() OVER (PARTITION BY category ORDER BY sum(net_revenue) DESC)::INT AS category_rank
        FROM priced WHERE order_status <> 'Cancelled' GROUP BY product_id, product_name, category""",
    q3_worst_products="SELECT * FROM q3",
    q4_revenue_by_region="""
        SELECT a.region_id, region_name, country, total_orders, round(net, 2)::DOUBLE AS total_net_revenue,
               round(profit, 2)::DOUBLE AS total_profit, round(profit::DOUBLE / nullif(net::DOUBLE, 0) * 100, 2) AS profit_margin_pct,
               round(leakage, 2)::DOUBLE AS total_leakage, round(coalesce(spent, 0), 2)::DOUBLE AS total_marketing_spend,
               round(coalesce(net::DOUBLE / nullif(spent::DOUBLE, 0), 0), 2) AS marketing_roi,
               round(coalesce(goal, 0), 2)::DOUBLE AS total_target_revenue,
               round(net::DOUBLE / nullif(goal::DOUBLE, 0) * 100, 2) AS target_achievement_pct
        FROM (SELECT region_id, region_name, country, count(DISTINCT order_id) AS total_orders, sum(net_revenue) AS net,
                     sum(gross_profit) AS profit, sum(leakage_amount) AS leakage
              FROM m WHERE order_status <> 'Cancelled' GROUP BY ALL) a
        LEFT JOIN (SELECT region_id, sum(spend_amount) AS spent FROM t_spend GROUP BY 1) s ON s.region_id = a.region_id
        LEFT JOIN (SELECT region_id, sum(target_revenue) AS goal FROM t_targets GROUP BY 1) t ON t.region_id = a.region_id""",
    q5_revenue_by_month="""
        SELECT "month", round(net, 2)::DOUBLE AS net_revenue, round(profit, 2)::DOUBLE AS profit, round(leakage, 2)::DOUBLE AS leakage,
               round(sum(net) OVER w, 2)::DOUBLE AS running_total_revenue, round(sum(profit) OVER w, 2)::DOUBLE AS running_total_profit,
               round(coalesce((net - lag(net) OVER (ORDER BY "month"))::DOUBLE / nullif(lag(net) OVER (ORDER BY "month"), 0)::DOUBLE, 0) * 100, 2) AS mom_growth_pct
        FROM (SELECT "month", sum(net_revenue) AS net, sum(gross_profit) AS profit, sum(leakage_amount) AS leakage
              FROM m WHERE order_status <> 'Cancelled' GROUP BY 1)
        WINDOW w AS (ORDER BY "month" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    q6_revenue_leakage_by_category="""
        SELECT category, sales_channel, count(order_id) AS total_orders, round(sum(net_revenue), 2)::DOUBLE AS total_net_revenue,
               round(sum(discount_leakage), 2)::DOUBLE AS discount_leakage, round(sum(return_leakage), 2)::DOUBLE AS return_leakage,
               round(sum(delay_leakage), 2)::DOUBLE AS delay_leakage, round(sum(pricing_leakage), 2)::DOUBLE AS pricing_leakage,
               round(sum(leakage_amount), 2)::DOUBLE AS total_leakage,
               round(sum(leakage_amount)::DOUBLE / nullif(sum(net_revenue + pricing_leakage)::DOUBLE, 0) * 100, 2) AS leakage_rate_pct
        FROM scored GROUP BY category, sales_channel""",
    k2_monthly_trend=f"""SELECT "month", {_d("net_revenue", "gross_profit")} FROM m GROUP BY "month" """,
    k3_monthly_growth="""
        SELECT "month", net::DOUBLE AS net_revenue, (lag(net) OVER w)::DOUBLE AS prev_revenue,
               coalesce((net::DOUBLE - (lag(net) OVER w)::DOUBLE) / nullif((lag(net) OVER w)::DOUBLE, 0), 0) AS growth_rate
        FROM (SELECT "month", sum(net_revenue) AS net FROM f GROUP BY 1) WINDOW w AS (ORDER BY "month")""",
    k4_revenue_by_category="""
        SELECT category, sum(net_revenue)::DOUBLE AS net_revenue,
               sum(net_revenue)::DOUBLE / (SELECT sum(net_revenue) FROM m)::DOUBLE AS share FROM m GROUP BY category""",
    k5_region_against_target="""
        SELECT coalesce(a.region_name, t.region_name) AS region_name, coalesce(net, 0)::DOUBLE AS net_revenue, coalesce(goal, 0)::DOUBLE AS target_revenue
        FROM (SELECT region_name, sum(net_revenue) AS net FROM f GROUP BY 1) a
        FULL JOIN (SELECT region_name, sum(target_revenue) AS goal FROM t_targets JOIN t_regions USING (region_id) GROUP BY 1) t
             ON t.region_name = a.region_name""",
    k6_sales_bridge="""
        SELECT unnest([1, 2, 3, 4, 5])::INT AS step_index,
               unnest(['Gross Revenue', 'Discounts', 'Net Revenue', 'Cost of Goods', 'Net Profit']) AS step,
               unnest(['relative', 'relative', 'total', 'relative', 'total']) AS measure,
               unnest([sum(gross_revenue)::DOUBLE, -sum(discount_amount)::DOUBLE, sum(net_revenue)::DOUBLE,
                       -sum(cost_amount)::DOUBLE, sum(gross_profit)::DOUBLE]) AS amount FROM m""",
    k7_channel_mix="""
        SELECT sales_channel, sum(net_revenue)::DOUBLE AS net_revenue,
               sum(net_revenue)::DOUBLE / (SELECT sum(net_revenue) FROM m)::DOUBLE AS share FROM m GROUP BY sales_channel""",
    k8_month_by_category="""SELECT "month", category, sum(net_revenue)::DOUBLE AS net_revenue FROM m GROUP BY "month", category""",
    k9_revenue_hierarchy="""
        SELECT CASE grouping(region_name, category, product_name) WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS level,
               region_name, category, product_name, sum(net_revenue)::DOUBLE AS net_revenue
        FROM m GROUP BY ROLLUP (region_name, category, product_name)""",
    k10_customer_kpis="""
        SELECT count(*) AS customers, coalesce(sum(net)::DOUBLE / count(*), 0) AS avg_ltv, coalesce(sum(again), 0)::BIGINT AS repeat_customers,
               coalesce(sum(again)::DOUBLE / nullif(count(*), 0)::DOUBLE * 100, 0) AS repeat_rate_pct
        FROM (SELECT customer_id, sum(net_revenue) AS net, max(repeat_customer_indicator) AS again FROM f GROUP BY 1)""",
    k11_value_histogram="""
        SELECT least(floor(20 * (monetary - lo) / (hi - lo)) + 1, 20)::INT AS bin,
               round(lo + (hi - lo) * (least(floor(20 * (monetary - lo) / (hi - lo)) + 1, 20) - 1) / 20, 4) + 0.0 AS bin_start, count(*) AS customers
        FROM rfm, (SELECT min(monetary) AS lo, max(monetary) AS hi FROM rfm) GROUP BY 1, 2""",
    k12_top_customers_filtered="""
        SELECT * REPLACE (row_number() OVER (ORDER BY total_net_revenue DESC, customer_id)::INT AS revenue_rank) FROM q1
        WHERE customer_id IN (SELECT customer_id FROM f) ORDER BY total_net_revenue DESC, customer_id LIMIT 10""",
    k13_product_price_margin="""
        SELECT product_name, category, sum(unit_price)::DOUBLE / count(*) AS avg_unit_price,
               round(avg(profit_margin), 6) + 0.0 AS avg_profit_margin, sum(quantity)::BIGINT AS total_quantity
        FROM m GROUP BY product_name, category""",
    k14_worst_ten_products="""
        SELECT product_name, category, profit, coalesce(profit_margin_pct, 0) AS profit_margin_pct, return_rate_pct
        FROM q3 ORDER BY profit, return_rate_pct DESC, product_id LIMIT 10""",
    k16_leakage_by_cause=" UNION ALL ".join(
        f"SELECT category, '{c.split('_')[0].title()} Leakage' AS leakage_type, sum({c})::DOUBLE AS amount FROM m GROUP BY category"
        for c in CAUSES
    ),
    k17_return_reasons="SELECT return_reason, count(*) AS items FROM m WHERE order_status = 'Returned' GROUP BY 1",
    k18_return_rate_by_delay="""
        SELECT delay_days, sum(is_returned)::DOUBLE / count(*) AS return_rate, count(*) AS items FROM m GROUP BY 1 HAVING count(*) >= 3""",
    k20_financial_statement="""
        SELECT unnest([1, 2, 3, 4, 5])::INT AS line,
               unnest(['Gross Invoiced Sales', 'Campaign Discounts Issued', 'Net Realized Revenue', 'Gross Cost Basis', 'Net Realized Profit']) AS metric,
               unnest([g, -d, n, -c, p]) AS amount,
               unnest([100.0::DOUBLE, d / nullif(g, 0) * 100, n / nullif(g, 0) * 100, c / nullif(n, 0) * 100,
                       CASE WHEN n > 0 THEN p / n ELSE 0 END * 100]) AS pct,
               unnest([NULL, NULL, goal, NULL, NULL]) AS target_revenue,
               unnest([NULL, NULL, CASE WHEN goal > 0 THEN n / goal * 100 ELSE 100 END, NULL, NULL]) AS target_achievement_pct
        FROM (SELECT coalesce(sum(gross_revenue), 0)::DOUBLE AS g, coalesce(sum(discount_amount), 0)::DOUBLE AS d,
                     coalesce(sum(net_revenue), 0)::DOUBLE AS n, coalesce(sum(cost_amount), 0)::DOUBLE AS c,
                     coalesce(sum(gross_profit), 0)::DOUBLE AS p FROM f) JOIN goal_f ON true""",
    k21_leakage_summary=f"""
        SELECT {_d(*CAUSES)}, sum(leakage_amount)::DOUBLE AS total_leakage,
               sum(leakage_amount)::DOUBLE / sum(net_revenue + pricing_leakage)::DOUBLE AS leakage_rate FROM m""",
    r1_revenue_change="SELECT * FROM change",
    r2_category_drop="SELECT * FROM cat_drop",
    r3_region_drop="SELECT * FROM reg_drop",
    r4_spikes="SELECT *, (discount_spike > 0.02)::INT AS discount_alert, (return_spike > 0.03)::INT AS return_alert FROM spike",
    r5_revenue_drop_message="""
        SELECT c.*, a.category AS top_dropping_category, a.drop_amount AS category_drop_amount, b.region_name AS top_dropping_region,
               b.drop_amount AS region_drop_amount, CASE WHEN c.status = 'decline' THEN s.discount_spike END AS discount_spike,
               CASE WHEN c.status = 'decline' THEN s.return_spike END AS return_spike,
               CASE c.status WHEN 'growth' THEN
                   format('Net revenue, {} to {}: growth of ${:,.2f}, {:.2f}%.', prev_month, latest_month, abs(change_amount), abs(change_pct))
               WHEN 'decline' THEN
                   format('Net revenue, {} to {}: decline of ${:,.2f}, {:.2f}%.', prev_month, latest_month, abs(change_amount), abs(change_pct))
                   || format(' Category {}: ${:,.2f} less.', a.category, abs(a.drop_amount))
                   || format(' Region {}: ${:,.2f} less.', b.region_name, abs(b.drop_amount))
                   || CASE WHEN discount_spike > 0.02 THEN format(' Mean discount: {:.1f} points more.', discount_spike * 100) ELSE '' END
                   || CASE WHEN return_spike > 0.03 THEN format(' Share of returns: {:.1f} points more.', return_spike * 100) ELSE '' END
               ELSE 'Not enough history to compare.' END AS message
        FROM change c LEFT JOIN cat_drop a ON true LEFT JOIN reg_drop b ON true LEFT JOIN spike s ON true""",
    r6_ineffective_marketing="SELECT * FROM wasted",
    r7_leakage_drivers="""
        SELECT sales_rep_name AS top_leakage_sales_rep, region_name AS top_leakage_rep_region, v::DOUBLE AS top_leakage_rep_amount,
               (SELECT return_reason FROM m WHERE is_returned = 1 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_return_reason,
               (SELECT category FROM m WHERE is_returned = 1 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_return_category,
               (SELECT sum(net_revenue) FROM m WHERE order_status = 'Cancelled' AND delay_days > 5)::DOUBLE AS delay_cancellation_leakage
        FROM (SELECT sales_rep_name, region_name, sum(discount_leakage) AS v FROM m GROUP BY 1, 2 ORDER BY v DESC, 1, 2 LIMIT 1)""",
    i1_top_product="SELECT * FROM i_1",
    i2_worst_region="SELECT * FROM i_2",
    i3_best_customer="SELECT * FROM i_3",
    i4_most_returned_category="SELECT * FROM i_4",
    i5_leakiest_category="SELECT * FROM i_5",
    i6_fastest_growing_region="SELECT * FROM i_6",
    i7_totals="SELECT * FROM i_7",
    i_all_insights=" UNION ALL ".join(f"SELECT * FROM i_{i}" for i in range(1, 8)),
    i8_discounting_rep="SELECT * FROM rule1",
    i9_late_region="SELECT * FROM rule2",
    i10_returned_category="SELECT * FROM rule3",
    i11_wasted_marketing="SELECT * FROM rule4",
    i12_recommendations='SELECT rank, rule, subject, "value", impact FROM all_recs',
    i12_recommendation_texts="""
        SELECT rank, rule, subject, "value",
               CASE rule WHEN 'discount_approval' THEN format('Require approval for the discounts of {}.', subject)
                         WHEN 'delivery_audit' THEN format('Audit delivery and shipping partners in {}.', subject)
                         WHEN 'quality_review' THEN format('Review the quality of the ''{}'' category.', subject)
                         WHEN 'marketing_budget' THEN format('Move marketing budget away from PPC in {}.', subject)
                         ELSE 'Run price audits across all sales channels.' END AS action,
               CASE rule WHEN 'discount_approval' THEN format('Highest discount leakage of all representatives: ${:,.2f}.', "value")
                         WHEN 'delivery_audit' THEN format('Average delay of {:.1f} days; cancellations cost ${:,.2f}.', detail, "value")
                         WHEN 'quality_review' THEN format('Return rate of {:.1f}%.', "value" * 100)
                         WHEN 'marketing_budget' THEN format('Spend rose while revenue fell in {}; return on spend {:.2f}.', "month", detail)
                         ELSE 'Keep base prices and invoices consistent.' END AS rationale,
               impact FROM all_recs""",
    d1_describe=" UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min,
            round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.75), 4) AS p75,
            round(max(x), 4) AS max, round(quantile_cont(x, 0.5), 4) AS median, round(var_samp(x), 4) AS var,
            round(skewness(x), 4) AS skewness, round(kurtosis(x), 4) AS kurtosis FROM (SELECT {c}::DOUBLE AS x FROM m)"""
        for c in NUMERIC
    ),
    d2_correlation=" UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}::DOUBLE, {b}::DOUBLE), 4) + 0.0 AS corr FROM m"
        for a in NUMERIC for b in NUMERIC
    ),
    d3_outliers_iqr=f"""
        SELECT {_columns(*ITEM)}, profit_margin, round(q1 - 1.5 * (q3 - q1), 4) + 0.0 AS lower_bound, round(q3 + 1.5 * (q3 - q1), 4) + 0.0 AS upper_bound
        FROM m, (SELECT quantile_cont(profit_margin, 0.25) AS q1, quantile_cont(profit_margin, 0.75) AS q3 FROM m)
        WHERE profit_margin < q1 - 1.5 * (q3 - q1) OR profit_margin > q3 + 1.5 * (q3 - q1)""",
    d4_outliers_zscore=f"""
        SELECT {_columns(*ITEM)}, profit_margin
        FROM m, (SELECT avg(profit_margin) AS mu, stddev_pop(profit_margin) AS sd FROM m) WHERE abs(profit_margin - mu) / nullif(sd, 0) > 3""",
    a1_rfm="SELECT * FROM rfm",
    a5_demand_features="""
        SELECT order_item_id, quantity, c.code AS category, unit_price::DOUBLE AS unit_price, discount_percentage::DOUBLE AS discount_percentage,
               g.code AS region_id, s.code AS sales_channel, month_num::DOUBLE AS month_num
        FROM m
        JOIN (SELECT category AS label, (row_number() OVER (ORDER BY category) - 1)::DOUBLE AS code FROM (SELECT DISTINCT category FROM m)) c ON c.label = category
        JOIN (SELECT region_name AS label, (row_number() OVER (ORDER BY region_name) - 1)::DOUBLE AS code FROM (SELECT DISTINCT region_name FROM m)) g ON g.label = region_name
        JOIN (SELECT sales_channel AS label, (row_number() OVER (ORDER BY sales_channel) - 1)::DOUBLE AS code FROM (SELECT DISTINCT sales_channel FROM m)) s ON s.label = m.sales_channel""",
    a7_scenario_economics=f"""
        SELECT {_columns(*ITEM)}, round(q * p * (1 - d), 4) + 0.0 AS gross_sales, round(q * p * share, 4) + 0.0 AS cost,
               round(q * p * (1 - d) - q * p * share, 4) + 0.0 AS net_profit
        FROM (SELECT *, quantity::DOUBLE AS q, unit_price::DOUBLE AS p, discount_percentage::DOUBLE AS d,
                     CASE category WHEN 'Software' THEN 0.2 WHEN 'Hardware' THEN 0.63 WHEN 'Consulting' THEN 0.58
                                   WHEN 'Support' THEN 0.45 ELSE 0.5 END::DOUBLE AS share FROM m)""",
    a8_monthly_features="""
        SELECT * FROM (
            SELECT "month", net::DOUBLE AS net_revenue, (row_number() OVER w)::INT AS trend,
                   round(sin("month"[6:7]::INT * 2 * pi() / 12), 6) + 0.0 AS month_sin, round(cos("month"[6:7]::INT * 2 * pi() / 12), 6) + 0.0 AS month_cos,
                   (lag(net, 1) OVER w)::DOUBLE AS lag_1, (lag(net, 2) OVER w)::DOUBLE AS lag_2, (lag(net, 3) OVER w)::DOUBLE AS lag_3
            FROM months WINDOW w AS (ORDER BY "month"))
        WHERE lag_3 IS NOT NULL""",
    a10_short_history="""
        SELECT customer_id, 'Future Month ' || step AS "month", step::INT AS step, mean AS forecasted_revenue,
               mean * 0.9::DOUBLE AS lower_ci, mean * 1.1::DOUBLE AS upper_ci
        FROM (SELECT customer_id, sum(net_revenue)::DOUBLE / count(DISTINCT "month") AS mean
              FROM m GROUP BY 1 HAVING count(DISTINCT "month") < 6),
             (SELECT unnest(generate_series(1, 6)) AS step)""",
)
BODIES["s10_named_query_bind"] = """
    SELECT region_name, count(*) AS items, sum(net_revenue)::DOUBLE AS net_revenue FROM m
    WHERE discount_percentage > 0.20 AND sales_channel = 'Online' GROUP BY region_name"""


def _overview(rows: str, goal: str) -> str:
    return f"""
        SELECT coalesce(sum(net_revenue), 0)::DOUBLE AS total_revenue, coalesce(sum(gross_profit), 0)::DOUBLE AS total_profit,
               count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_id) AS total_customers,
               coalesce(sum(leakage_amount), 0)::DOUBLE AS total_leakage,
               CASE WHEN sum(net_revenue) > 0 THEN sum(gross_profit)::DOUBLE / sum(net_revenue)::DOUBLE ELSE 0 END AS profit_margin,
               any_value(goal) AS total_target,
               CASE WHEN any_value(goal) > 0 THEN coalesce(sum(net_revenue), 0)::DOUBLE / any_value(goal) * 100 ELSE 100 END AS target_achievement_pct,
               (SELECT sum(net_revenue)::DOUBLE / count(*) * 6 FROM m) AS forecast_6m
        FROM {goal} LEFT JOIN {rows} ON true"""


BODIES["k1_overview"] = _overview("m", "(SELECT sum(target_revenue)::DOUBLE AS goal FROM t_targets)")
BODIES["k1_overview_filtered"] = _overview("f", "goal_f")
BODIES["k15_leakage_kpis"] = """
    SELECT coalesce(sum(leakage_amount), 0)::DOUBLE AS total_leakage,
           coalesce(sum(leakage_amount)::DOUBLE / nullif(sum(net_revenue + pricing_leakage)::DOUBLE, 0), 0) AS leakage_rate FROM f"""

# Models given as constants ("given") and models that the SQL trains itself, by the same hashed draws.
for _kind, _segmented, _strange in (("_given_model", "segmented", "strange"), ("", "segmented_trained", "strange_trained")):
    BODIES["a2_customer_segments" + _kind] = f"""
    SELECT customer_id, customer_name, customer_segment, recency, frequency, monetary, discount_percentage, is_returned, cluster, segment_name
    FROM {_segmented}"""
    BODIES["a3_personas" + _kind] = f"""
    SELECT segment_name, count(*) AS customers, round(avg(recency), 4) + 0.0 AS recency, round(avg(frequency), 4) + 0.0 AS frequency,
           round(avg(monetary), 4) + 0.0 AS monetary, round(avg(discount_percentage), 4) + 0.0 AS discount_percentage,
           round(avg(is_returned), 4) + 0.0 AS is_returned FROM {_segmented} GROUP BY segment_name"""
    BODIES["a4_leakage_anomalies" + _kind] = f"""
    SELECT order_item_id, order_id, product_id, round(anomaly_gap, 6) + 0.0 AS anomaly_score, is_anomaly FROM {_strange}"""
    BODIES["k15_leakage_kpis_with_anomalies" + _kind] = f"""
    SELECT coalesce(sum(leakage_amount), 0)::DOUBLE AS total_leakage,
           coalesce(sum(leakage_amount)::DOUBLE / nullif(sum(net_revenue + pricing_leakage)::DOUBLE, 0), 0) AS leakage_rate,
           coalesce(sum(is_anomaly), 0)::BIGINT AS anomalies FROM {_strange}"""
    BODIES["k19_anomaly_audit" + _kind] = f"""
    SELECT order_id, customer_name, sales_rep_name, order_status, delay_days, discount_percentage::DOUBLE AS discount_percentage,
           leakage_amount::DOUBLE AS leakage_amount, profit_margin
    FROM {_strange} WHERE is_anomaly = 1 ORDER BY leakage_amount::DOUBLE DESC, order_id, order_item_id LIMIT 30"""
BODIES["a14_saved_models"] = """
    SELECT * FROM (VALUES ('segments', 0::BIGINT), ('anomalies', 0::BIGINT), ('demand', 0::BIGINT)) AS v(model, differing_rows)"""

BODIES["a9_forecast"] = "SELECT \"month\", step, forecasted_revenue, lower_ci, upper_ci FROM whole_ahead"
BODIES["a9_forecast_by_region_category"] = """
    SELECT split_part(g, '|', 1) AS region_name, split_part(g, '|', 2) AS category, "month", step, forecasted_revenue, lower_ci, upper_ci FROM parts_ahead"""
BODIES["s9_forecast_table"] = """
    SELECT round((SELECT sum(value) FROM whole_rolled WHERE step > 0), 0) + 0.0 AS forecast_6m, (SELECT sum(net_revenue)::DOUBLE / count(*) * 6 FROM m) AS fallback_6m"""

# The same over the filtered fact; what is written over it above becomes the whole.
for _name in ("k3_monthly_growth", "k5_region_against_target", "k10_customer_kpis", "k15_leakage_kpis", "k20_financial_statement"):
    BODIES[f"{_name}_filtered"] = BODIES[_name]
    BODIES[_name] = re.sub(
        r"JOIN goal_f\b", "JOIN (SELECT coalesce(sum(target_revenue), 0)::DOUBLE AS goal FROM t_targets)",
        re.sub(r"FROM f\b", "FROM m", BODIES[_name]),
    )

ORACLE = {name: _with(body) for name, body in BODIES.items()}
