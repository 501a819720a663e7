"""Small hand-made base tables with the awkward cases in them."""

import datetime as dt
from decimal import Decimal

from ledgerline.schemas import MASTER, TABLES


def day(text):
    return dt.date.fromisoformat(text) if text else None


def money(value):
    return None if value is None else Decimal(str(value))


ROWS = {
    "customers": [
        ("C1", "Acme", "SMB", day("2024-01-01")),
        ("C2", "Acme", "Strategic", day("2024-02-01")),  # same name as C1
        ("C3", "Quiet", "SMB", day("2024-03-01")),  # never orders
    ],
    "products": [
        ("P1", "Core", "Software", money("100"), money("20")),
        ("P2", "Box", "Hardware", money("50"), money("60")),
        ("P3", "Unsold", "Support", money("10"), money("1")),
    ],
    "regions": [("REG01", "North", "US"), ("REG02", "South", "BR")],
    "reps": [("S1", "Ann", "REG01"), ("S2", "Bob", "REG02")],
    "orders": [
        # order, customer, rep, region, ordered, shipped, status, channel, delay
        ("O1", "C1", "S1", "REG01", day("2024-12-05"), day("2024-12-08"), "Completed", "Direct", 3),
        ("O2", "C1", "S1", "REG01", day("2025-01-05"), day("2025-01-10"), "Cancelled", "Online", 5),
        ("O3", "C2", "S2", "REG02", day("2025-01-06"), day("2025-01-12"), "Cancelled", "Online", 6),
        ("O4", "C1", "S2", "REG09", day("2025-02-01"), day("2025-02-02"), "Returned", "Partner", 1),  # unknown region
        ("O5", "C2", "S2", "REG02", day("2025-02-03"), day("2025-02-04"), "Completed", "Direct", 1),  # no items
    ],
    "order_items": [
        ("I1", "O1", "P1", 2, money("100")),  # sold at base price
        ("I2", "O1", "P2", 1, money("40")),  # below base price and below cost
        ("I3", "O2", "P1", 1, money("90")),
        ("I4", "O3", "P1", 1, money("100")),
        ("I5", "O4", "P2", 3, money("50")),
        ("I6", "O404", "P1", 1, money("100")),  # unknown order
        ("I7", "O4", "P404", 1, money("10")),  # unknown product
        ("I8", "O1", "P1", 0, money("100")),  # nothing sold
    ],
    "discounts": [
        ("D1", "O1", Decimal("0.2000"), "TWENTY"),  # exactly at the allowance
        ("D2", "O2", Decimal("0.2500"), "DEEP"),
    ],
    "returns": [("R1", "O4", day("2025-02-10"), "Defective")],
    "marketing_spend": [
        ("M1", "REG01", "2024-12", "SEO", money("10")),
        ("M2", "REG01", "2025-01", "SEO", money("20")),
        ("M3", "REG02", "2025-01", "PPC", money("0")),
    ],
    "monthly_targets": [("T1", "REG01", "2024-12", money("100")), ("T2", "REG02", "2025-01", money("0"))],
}


def tables(spark):
    return {name: spark.createDataFrame(rows, TABLES[name]) for name, rows in ROWS.items()}


def facts(spark, rows):
    """Rows of the fact given as dictionaries; columns left out are NULL."""
    full = []
    for row in rows:
        row = dict(row)
        if row.get("order_date"):
            row["order_date"] = day(row["order_date"])
            row.setdefault("month", row["order_date"].strftime("%Y-%m"))
            row.setdefault("year", row["order_date"].year)
            row.setdefault("month_num", row["order_date"].month)
        values = []
        for field in MASTER:
            value = row.get(field.name)
            values.append(money(value) if field.dataType.typeName() == "decimal" else value)
        full.append(tuple(values))
    return spark.createDataFrame(full, MASTER)
