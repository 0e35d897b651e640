"""Names, query functions and oracle SQL of the library's own operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furrow.plans.catalog import Tables, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Inventory ids that a query covers.
COVERS: dict[str, tuple[str, ...]] = {}


def query(ids: str, name: str, sql: str | None = None):
    """Register a query over ``Tables``; ``ids`` are the inventory entries it covers, ``sql`` its oracle."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = f"{ids.split()[0].lower()}_{name}"
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        COVERS[key] = tuple(ids.split())
        if sql is not None:
            ORACLES[key] = with_ctes(sql)
        return f

    return register


for _module in ("series", "filters", "regional", "spatial", "metrics", "joins", "sampling", "scans", "labels", "composites", "models", "streams"):
    importlib.import_module(f"furrow.plans.q_{_module}")
