"""Revenue analytics on Spark: build one order-item fact, then ask it questions."""

from ledgerline.operators.filters import filter_master, filter_targets, restrict_customers
from ledgerline.operators.master import build_master
from ledgerline.operators.named import run_named, run_sql
from ledgerline.session import build_session
from ledgerline.sources.tables import read_tables, standardise_dates
from ledgerline.sources.validation import dedup, dedup_report, validate
from ledgerline.sources.warehouse import run_etl, write_master, write_tables

__all__ = [
    "build_master",
    "build_session",
    "dedup",
    "dedup_report",
    "filter_master",
    "filter_targets",
    "read_tables",
    "restrict_customers",
    "run_etl",
    "run_named",
    "run_sql",
    "standardise_dates",
    "validate",
    "write_master",
    "write_tables",
]
