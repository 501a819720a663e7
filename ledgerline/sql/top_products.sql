-- Product totals over orders that were not cancelled; ranked within category by the runner.
-- Items are summed per product before they meet the product table.
WITH kept_orders AS (
  FROM orders |> WHERE order_status != 'Cancelled' |> LEFT JOIN discounts USING (order_id)
  |> SELECT order_id, coalesce(discount_percentage, 0) AS pct
), sold AS (
  FROM order_items
  |> JOIN kept_orders USING (order_id)
  |> AGGREGATE
       sum(quantity) AS total_quantity_sold,
       sum(quantity * unit_price) AS gross_total,
       sum(cast(quantity * unit_price * (1 - pct) AS decimal(18, 4))) AS net_total
     GROUP BY product_id
)
FROM sold
|> JOIN products USING (product_id)
|> SELECT
     product_id, product_name, category, total_quantity_sold, gross_total, net_total,
     net_total - total_quantity_sold * cost_price AS profit_total
