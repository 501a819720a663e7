-- Customer totals over orders that were not cancelled; ranked by the runner.
FROM master_analytical_dataset
|> WHERE order_status != 'Cancelled'
|> AGGREGATE
     count(DISTINCT order_id) AS total_orders,
     sum(net_revenue) AS net,
     sum(gross_profit) AS profit,
     avg(profit_margin) AS margin
   GROUP BY customer_id, customer_name, customer_segment
