-- Leakage by category and channel; total_orders counts order items.
FROM master_analytical_dataset
|> AGGREGATE
     count(order_id) AS total_orders,
     sum(net_revenue) AS net,
     sum(discount_leakage) AS by_discount,
     sum(return_leakage) AS by_return,
     sum(delay_leakage) AS by_delay,
     sum(pricing_leakage) AS by_price,
     sum(leakage_amount) AS lost
   GROUP BY category, sales_channel
|> SELECT
     category, sales_channel, total_orders,
     cast(round(net, 2) AS double) AS total_net_revenue,
     cast(round(by_discount, 2) AS double) AS discount_leakage,
     cast(round(by_return, 2) AS double) AS return_leakage,
     cast(round(by_delay, 2) AS double) AS delay_leakage,
     cast(round(by_price, 2) AS double) AS pricing_leakage,
     cast(round(lost, 2) AS double) AS total_leakage,
     round(try_divide(cast(lost AS double), cast(net + by_price AS double)) * 100, 2) AS leakage_rate_pct
|> ORDER BY total_leakage DESC
