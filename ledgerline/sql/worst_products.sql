-- Every product, sold or not, cancelled orders included; weakest profit first.
-- Items are summed per product before they meet the product table.
WITH order_terms AS (
  FROM orders |> LEFT JOIN discounts USING (order_id)
  |> SELECT order_id, order_status, coalesce(discount_percentage, 0) AS pct
), sold AS (
  FROM order_items
  |> LEFT JOIN order_terms USING (order_id)
  |> AGGREGATE
       count(DISTINCT order_id) AS order_count,
       sum(quantity) AS qty,
       sum(cast(quantity * unit_price * (1 - coalesce(pct, 0)) AS decimal(18, 4))) AS net,
       sum(quantity) FILTER (WHERE order_status = 'Returned') AS returned
     GROUP BY product_id
)
FROM products
|> LEFT JOIN sold USING (product_id)
|> EXTEND net - qty * cost_price AS gain
|> SELECT
     product_id, product_name, category,
     coalesce(order_count, 0) AS total_orders,
     coalesce(qty, 0) AS total_qty,
     cast(round(coalesce(net, 0), 2) AS double) AS net_revenue,
     cast(round(coalesce(gain, 0), 2) AS double) AS profit,
     round(coalesce(try_divide(cast(gain AS double), cast(net AS double)), 0) * 100, 2) AS profit_margin_pct,
     coalesce(returned, 0) AS returned_qty,
     round(try_divide(cast(coalesce(returned, 0) AS double), cast(qty AS double)) * 100, 2) AS return_rate_pct
|> ORDER BY profit, return_rate_pct DESC
