-- Monthly revenue with running totals and growth; one row per month reaches the window.
FROM master_analytical_dataset
|> WHERE order_status != 'Cancelled'
|> AGGREGATE sum(net_revenue) AS net, sum(gross_profit) AS gain, sum(leakage_amount) AS lost GROUP BY month
|> SELECT
     month,
     cast(round(net, 2) AS double) AS net_revenue,
     cast(round(gain, 2) AS double) AS profit,
     cast(round(lost, 2) AS double) AS leakage,
     cast(round(sum(net) OVER so_far, 2) AS double) AS running_total_revenue,
     cast(round(sum(gain) OVER so_far, 2) AS double) AS running_total_profit,
     round(coalesce(try_divide(cast(net - lag(net) OVER by_month AS double), cast(lag(net) OVER by_month AS double)), 0) * 100, 2)
       AS mom_growth_pct
   WINDOW by_month AS (ORDER BY month), so_far AS (ORDER BY month ROWS UNBOUNDED PRECEDING)
|> ORDER BY month
