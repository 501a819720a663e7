"""Declared schemas of the ten base tables and the column order of the fact.

Money is exact: DECIMAL(18,4) holds cents times a whole percentage without
rounding, so sums do not depend on the order in which partitions arrive.
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)
PERCENT = T.DecimalType(9, 4)
_s, _i, _d = T.StringType(), T.IntegerType(), T.DateType()


def _struct(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


TABLES: dict[str, T.StructType] = {
    "customers": _struct(customer_id=_s, customer_name=_s, customer_segment=_s, created_date=_d),
    "products": _struct(product_id=_s, product_name=_s, category=_s, base_price=MONEY, cost_price=MONEY),
    "regions": _struct(region_id=_s, region_name=_s, country=_s),
    "reps": _struct(sales_rep_id=_s, sales_rep_name=_s, region_id=_s),
    "orders": _struct(
        order_id=_s, customer_id=_s, sales_rep_id=_s, region_id=_s, order_date=_d,
        shipping_date=_d, order_status=_s, sales_channel=_s, delay_days=_i,
    ),
    "order_items": _struct(order_item_id=_s, order_id=_s, product_id=_s, quantity=_i, unit_price=MONEY),
    "discounts": _struct(discount_id=_s, order_id=_s, discount_percentage=PERCENT, discount_code=_s),
    "returns": _struct(return_id=_s, order_id=_s, return_date=_d, return_reason=_s),
    "marketing_spend": _struct(
        spend_id=_s, region_id=_s, campaign_month=_s, marketing_channel=_s, spend_amount=MONEY,
    ),
    "monthly_targets": _struct(target_id=_s, region_id=_s, target_month=_s, target_revenue=MONEY),
}

# The file stem of a table where it is not the table's own name.
FILE_STEMS = {"reps": "sales_representatives"}

# Columns that must identify a row: joining on a repeated key would multiply the fact.
UNIQUE_KEYS = {
    "customers": "customer_id",
    "products": "product_id",
    "regions": "region_id",
    "reps": "sales_rep_id",
    "orders": "order_id",
    "discounts": "order_id",
    "returns": "order_id",
}

# The type class each of these columns must have.
CHECKED_TYPES = {
    "customers": {"customer_id": "string", "customer_segment": "string"},
    "products": {"base_price": "float", "cost_price": "float"},
    "regions": {"region_id": "string"},
    "reps": {"sales_rep_id": "string"},
    "orders": {"order_id": "string", "delay_days": "int"},
    "order_items": {"quantity": "int", "unit_price": "float"},
    "discounts": {"discount_percentage": "float"},
    "returns": {"return_id": "string"},
    "marketing_spend": {"spend_amount": "float"},
    "monthly_targets": {"target_revenue": "float"},
}

DATE_COLUMNS = {
    "customers": ["created_date"],
    "orders": ["order_date", "shipping_date"],
    "returns": ["return_date"],
}

LEAKAGE_CAUSES = ["discount_leakage", "return_leakage", "delay_leakage", "pricing_leakage"]

MASTER = _struct(
    order_item_id=_s, order_id=_s, product_id=_s, quantity=_i, unit_price=MONEY,
    product_name=_s, category=_s, base_price=MONEY, cost_price=MONEY,
    gross_revenue=MONEY, cost_amount=MONEY,
    customer_id=_s, sales_rep_id=_s, region_id=_s, order_date=_d, shipping_date=_d,
    order_status=_s, sales_channel=_s, delay_days=_i,
    customer_name=_s, customer_segment=_s, created_date=_d,
    region_name=_s, country=_s, sales_rep_name=_s, region_id_rep=_s,
    discount_id=_s, discount_percentage=PERCENT, discount_code=_s,
    return_id=_s, return_date=_d, return_reason=_s,
    discount_amount=MONEY, net_revenue=MONEY, gross_profit=MONEY, profit_margin=T.DoubleType(),
    discount_leakage=MONEY, return_leakage=MONEY, delay_leakage=MONEY, pricing_leakage=MONEY,
    leakage_amount=MONEY, is_leakage=_i, leakage_score=T.DoubleType(),
    order_delay=_i, is_returned=_i,
    year=_i, quarter=_s, month_num=_i, month=_s, season=_s,
    customer_order_rank=T.LongType(), repeat_customer_indicator=_i,
    customer_ltv=MONEY, high_risk_customer=_i,
)
MASTER_COLUMNS = MASTER.fieldNames()

# Columns of the statistics and features of the models, and how features are named in results.
STATISTICS = [
    "gross_revenue", "net_revenue", "cost_amount", "gross_profit", "profit_margin", "discount_percentage", "delay_days", "leakage_amount",
]
SEGMENT_FEATURES = ["recency", "frequency", "monetary", "discount_percentage", "is_returned"]
ANOMALY_FEATURES = ["gross_revenue", "discount_percentage", "delay_days", "profit_margin", "is_returned"]
DEMAND_FEATURES = ["category", "unit_price", "discount_percentage", "region_id", "sales_channel", "month_num"]
DEMAND_LABELS = ["Category", "Unit Price", "Discount %", "Region", "Sales Channel", "Month"]
FORECAST_FEATURES = ["trend", "month_sin", "month_cos", "lag_1", "lag_2", "lag_3"]
