"""Edge cases of filters, figures, root cause, insights and statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from small import facts, tables

from ledgerline import filter_master, filter_targets, restrict_customers
from ledgerline.operators import insights, kpi, rootcause, stats


def sale(month, net, **more):
    return {"order_date": f"{month}-10", "net_revenue": net, "order_id": "O", "order_item_id": "I"} | more


def test_filter_identity_and_all(spark, star):
    m = star.master
    assert filter_master(m, {}) is m and filter_master(m, None) is m
    assert filter_master(m, {"region": "All", "year": "All"}) is m
    assert filter_master(m, {"year": "1997"}).select("year").distinct().collect()[0][0] == 1997


def test_targets_of_an_empty_filter(spark):
    targets = tables(spark)["monthly_targets"]
    nothing = facts(spark, [])
    assert filter_targets(targets, nothing, {"region": "North"}).count() == 0
    assert filter_targets(targets, nothing, {"year": "2024"}).count() == 1
    assert filter_targets(targets, nothing, {"channel": "Direct"}).count() == 2


def test_customers_fall_back_to_all(spark):
    customers = tables(spark)["customers"]
    assert restrict_customers(customers, facts(spark, [{"customer_id": "C2"}])).count() == 1
    assert restrict_customers(customers, facts(spark, [])).count() == 3


def test_overview_of_nothing(spark):
    row = kpi.overview(facts(spark, []), tables(spark)["monthly_targets"].limit(0)).first()
    assert (row.total_revenue, row.profit_margin, row.target_achievement_pct, row.total_orders) == (0.0, 0.0, 100.0, 0)


def test_growth_skips_missing_months_and_zero(spark):
    m = facts(spark, [sale("2025-01", 100), sale("2025-03", 150), sale("2025-04", 0), sale("2025-05", 10)])
    assert [r.growth_rate for r in kpi.monthly_growth(m).collect()] == [0.0, 0.5, -1.0, 0.0]


def test_null_keys_are_left_out(spark):
    m = facts(spark, [sale("2025-01", 1, category="A"), sale("2025-01", 5)])
    assert [tuple(r) for r in kpi.revenue_by_category(m).collect()] == [("A", 1.0, 1.0)]


def test_region_without_sales_or_target(spark):
    t = tables(spark)
    m = facts(spark, [sale("2025-01", 7, region_name="Elsewhere")])
    got = {r.region_name: (r.net_revenue, r.target_revenue) for r in
           kpi.region_against_target(m, t["monthly_targets"], t["regions"]).collect()}
    assert got == {"Elsewhere": (7.0, 0.0), "North": (0.0, 100.0), "South": (0.0, 0.0)}


def test_hierarchy_levels_add_up(star):
    rows = kpi.revenue_hierarchy(star.master).collect()
    sums = [round(sum(r.net_revenue for r in rows if r.level == level), 2) for level in range(4)]
    assert len(set(sums)) == 1 and sum(r.level == 0 for r in rows) == 1


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 19, 20]], "monetary double")
    assert [(r.bin, r.customers) for r in kpi.value_histogram(df).collect()] == [(1, 1), (2, 1), (20, 2)]
    same = spark.createDataFrame([(5.0,), (5.0,)], "monetary double")
    assert [(r.bin, r.customers) for r in kpi.value_histogram(same).collect()] == [(1, 2)]


def test_delay_needs_three_items(spark):
    rows = [{"delay_days": 2, "is_returned": 1, "order_id": "O"}] * 2 + [{"delay_days": 4, "is_returned": 0, "order_id": "O"}] * 3
    assert [(r.delay_days, r.items) for r in kpi.return_rate_by_delay(facts(spark, rows)).collect()] == [(4, 3)]


def test_cause_labels(spark):
    row = {"category": "A", "discount_leakage": 1, "return_leakage": 2, "delay_leakage": 3, "pricing_leakage": 4}
    got = {r.leakage_type: r.amount for r in kpi.leakage_by_cause(facts(spark, [row])).collect()}
    assert got == {"Discount Leakage": 1.0, "Return Leakage": 2.0, "Delay Leakage": 3.0, "Pricing Leakage": 4.0}


def test_one_month_is_insufficient(spark):
    row = rootcause.revenue_drop(facts(spark, [sale("2025-01", 1)])).first()
    assert row.status == "insufficient_data" and row.prev_month is None


def test_growth_has_no_culprits(spark):
    row = rootcause.revenue_drop(facts(spark, [sale("2025-01", 1, category="A"), sale("2025-02", 2, category="A")])).first()
    assert row.status == "growth" and row.top_dropping_category is None and row.change_pct == 100.0
    assert "growth of $1.00, 100.00%" in row.message


def test_vanished_and_new_categories(spark):
    m = facts(spark, [
        sale("2025-01", 100, category="gone", region_name="N"), sale("2025-01", 50, category="kept", region_name="N"),
        sale("2025-02", 20, category="kept", region_name="N"), sale("2025-02", 1, category="new", region_name="N"),
    ])
    got = rootcause.biggest_drop(m, "category").first()
    assert (got.category, got.drop_amount) == ("gone", -100.0)


def test_spikes_are_item_weighted(spark):
    m = facts(spark, [
        sale("2025-01", 1, discount_percentage=0.1, is_returned=0), sale("2025-02", 1, discount_percentage=0.1, is_returned=1),
        sale("2025-02", 1, discount_percentage=0.2, is_returned=0),
    ])
    row = rootcause.spikes(m).first()
    assert row.discount_spike == pytest.approx(0.05) and row.return_spike == 0.5
    assert (row.discount_alert, row.return_alert) == (1, 1)


def test_marketing_uses_common_months(spark):
    m = facts(spark, [sale(x, n, region_id="R") for x, n in [("2025-01", 100), ("2025-02", 5), ("2025-03", 90)]])
    spend = spark.createDataFrame(
        [("R", "2025-01", 10), ("R", "2025-03", 30), ("R", "2025-04", 40)], "region_id string, campaign_month string, s int"
    ).select("region_id", "campaign_month", F.col("s").cast("decimal(18,4)").alias("spend_amount"))
    got = [tuple(r) for r in rootcause.marketing_effectiveness(m, spend).collect()]
    assert got == [("R", "2025-03", 20.0, 10.0, 3.0)]


def test_same_named_customers_count_together(spark):
    m = facts(spark, [sale("2025-01", 6, customer_name="Twin", customer_id="1"), sale("2025-01", 6, customer_name="Twin", customer_id="2"),
                      sale("2025-01", 10, customer_name="Solo", customer_id="3")])
    assert tuple(insights.best_customer(m).first()) == ("highest_value_customer", "Twin", 12.0)


def test_midpoint_may_fall_at_noon(spark):
    rows = [("2025-01-01", 10), ("2025-01-02", 30), ("2025-01-03", 5), ("2025-01-04", 90)]
    m = facts(spark, [{"order_date": d, "net_revenue": n, "region_name": "N"} for d, n in rows])
    assert insights.fastest_growing_region(m).first()["value"] == pytest.approx((95 - 40) / 40)


def test_insights_of_nothing(spark):
    t = tables(spark)
    got = {r.insight: (r.subject, r.value) for r in
           insights.insights(facts(spark, []), t["monthly_targets"], t["regions"]).collect()}
    assert got["top_performing_product"] == ("N/A", 0.0) and got["overall_leakage_rate"] == ("all", 0.0)


def test_default_recommendation(spark):
    t = tables(spark)
    got = insights.recommendations(facts(spark, [sale("2025-01", 1, category="A", order_status="Completed")]),
                                   t["marketing_spend"], t["regions"]).collect()
    assert [(r.rule, r.impact) for r in got] == [("price_audit", "Low")]


def test_small_samples_have_no_high_moments(spark):
    m = facts(spark, [sale("2025-01", n) for n in (1, 2, 4)])
    row = stats.describe(m, ["net_revenue"]).first()
    assert (row["count"], row.median, row.kurtosis) == (3, 2.0, None)
    assert row["var"] == pytest.approx(2.3333) and row.skewness == pytest.approx(0.9352)


def test_correlation_with_missing_values(spark):
    m = facts(spark, [sale("2025-01", n, gross_revenue=g, delay_days=d) for n, g, d in
                      [(1, 2, 5), (2, 4, None), (3, 7, 1), (4, 7, 0)]])
    got = {(r.col_a, r.col_b): r["corr"] for r in stats.correlation(m, ["net_revenue", "gross_revenue", "delay_days"]).collect()}
    assert got["net_revenue", "net_revenue"] == 1.0
    pearson = lambda x, y: round(float(np.corrcoef(x, y)[0, 1]), 4)
    assert got["net_revenue", "gross_revenue"] == got["gross_revenue", "net_revenue"] == pearson([1, 2, 3, 4], [2, 4, 7, 7])
    assert got["net_revenue", "delay_days"] == pearson([1, 3, 4], [5, 1, 0])  # the row without a delay is left out
    assert len(got) == 9


def test_outliers(spark):
    m = facts(spark, [sale("2025-01", n) for n in [10, 11, 12, 13, 14, 200]])
    rows = stats.outliers_iqr(m, "net_revenue").collect()
    assert [float(r.net_revenue) for r in rows] == [200.0] and rows[0].upper_bound == pytest.approx(17.5)
    assert stats.outliers_zscore(m, "net_revenue", 2.0).count() == 1
    constant = facts(spark, [sale("2025-01", 5)] * 4)
    assert stats.outliers_zscore(constant, "net_revenue", 0.0).count() == 0
