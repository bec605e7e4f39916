"""Collects the queries and their SQL; the SQL is written directly, not like the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logvane.session import prepare
from logvane.sources import derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return add


EXPANDED = (
    "(SELECT e0.*, b.k FROM events e0 CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS b(k)"
    f" WHERE b.k = 0 OR ({derived.BURST}))"
)
LINES = derived.LINES.format(expanded=EXPANDED)
MIXED = derived.MIXED.format(events="events")
RFC5424_LINES = derived.RFC5424_LINES.format(events="events")
NGINX_ERROR_LINES = derived.NGINX_ERROR_LINES.format(events="events")
ANOMALIES = derived.ANOMALIES.format(events="events")
FEEDBACK = derived.FEEDBACK.format(events="events")
ALERTS = derived.ALERTS.format(events="events")
LABELLED_SCORES = derived.LABELLED_SCORES.format(events="events")
GEO_RANGES = derived.GEO_RANGES
AS_OF = f"TIMESTAMP '{derived.AS_OF}'"
