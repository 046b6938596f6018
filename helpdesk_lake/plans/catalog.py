"""Registered queries: one Spark builder and (where SQL can say it) one
DuckDB oracle text per key. ``__spark_entry__`` exposes both.

Every query reads the driver's whole tables through the fixture model; the
parameters (periods, lists, limits) are the operator's own arguments.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..filters import AnalyticsFilters
from ..sources.fixtures import fixture_model


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    ids: str  # SURVEY §2 operator ids covered


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, ids: str, oracle: str | None):
    def deco(fn: Callable):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(fixture_model(spark, sf_dir))
        build.__name__ = f"q_{name}"
        REGISTRY[name] = QuerySpec(name, build, oracle, ids)
        return fn
    return deco


# --- shared query parameters -------------------------------------------------
PERIOD_FROM = datetime(1996, 1, 1, 0, 0, 0)
PERIOD_TO = datetime(1997, 12, 31, 23, 59, 59)
PERIOD = AnalyticsFilters.create(from_at=PERIOD_FROM, to_at=PERIOD_TO)
CURRENT_FROM = datetime(1998, 1, 1, 0, 0, 0)
CURRENT_TO = datetime(1998, 6, 30, 23, 59, 59)
COMPARE = AnalyticsFilters.create(from_at=CURRENT_FROM, to_at=CURRENT_TO)
NO_FILTER = AnalyticsFilters()


def ts_sql(value: datetime) -> str:
    return f"TIMESTAMP '{value.isoformat(sep=' ')}'"


def period_sql(f: AnalyticsFilters, col: str = "source_created_at") -> str:
    conds = []
    if f.from_at is not None:
        conds.append(f"{col} >= {ts_sql(f.from_at)}")
    if f.to_at is not None:
        conds.append(f"{col} <= {ts_sql(f.to_at)}")
    return " AND ".join(conds) if conds else "TRUE"


QUERY_MODULES = (
    "queries_dashboard",
    "queries_filters",
    "queries_customers",
    "queries_listings",
    "queries_exports",
    "queries_ingestion",
    "queries_maintenance",
)


def load_all() -> dict[str, QuerySpec]:
    """Import the query modules (they register themselves)."""
    import importlib

    for mod in QUERY_MODULES:
        try:
            importlib.import_module(f"{__package__}.{mod}")
        except ModuleNotFoundError as exc:  # module not written yet
            if mod not in str(exc):
                raise
    return REGISTRY
