"""All registered queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixlake.operators import queries as operator_queries
from helixlake.plans import format_trips, relational, round_trips

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**operator_queries.QUERIES, **relational.QUERIES, **round_trips.QUERIES, **format_trips.QUERIES}
SQL: dict[str, str] = {**operator_queries.SQL, **relational.SQL, **round_trips.SQL, **format_trips.SQL}
