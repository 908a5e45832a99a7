"""All registered queries, grouped by the modules that define them."""

from __future__ import annotations

from . import (  # noqa: F401
    augment_queries,
    contract_queries,
    explain_queries,
    fold_queries,
    metric_queries,
    model_queries,
    preprocess_queries,
    report_queries,
)
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
