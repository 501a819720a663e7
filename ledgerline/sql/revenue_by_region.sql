-- Sales per region beside its marketing spend and its targets. Spend and targets
-- are added up per region first, so they meet each region once.
WITH spend AS (
  FROM marketing_spend |> AGGREGATE sum(spend_amount) AS spend_total GROUP BY region_id
), goal AS (
  FROM monthly_targets |> AGGREGATE sum(target_revenue) AS goal_total GROUP BY region_id
)
FROM master_analytical_dataset
|> WHERE order_status != 'Cancelled'
|> AGGREGATE
     count(DISTINCT order_id) AS total_orders,
     sum(net_revenue) AS net,
     sum(gross_profit) AS profit,
     sum(leakage_amount) AS leakage
   GROUP BY region_id, region_name, country
|> LEFT JOIN spend USING (region_id)
|> LEFT JOIN goal USING (region_id)
|> SELECT
     region_id, region_name, country, total_orders,
     cast(round(net, 2) AS double) AS total_net_revenue,
     cast(round(profit, 2) AS double) AS total_profit,
     round(try_divide(cast(profit AS double), cast(net AS double)) * 100, 2) AS profit_margin_pct,
     cast(round(leakage, 2) AS double) AS total_leakage,
     cast(round(coalesce(spend_total, 0), 2) AS double) AS total_marketing_spend,
     round(coalesce(try_divide(cast(net AS double), cast(spend_total AS double)), 0), 2) AS marketing_roi,
     cast(round(coalesce(goal_total, 0), 2) AS double) AS total_target_revenue,
     round(try_divide(cast(net AS double), cast(goal_total AS double)) * 100, 2) AS target_achievement_pct
|> ORDER BY total_net_revenue DESC
