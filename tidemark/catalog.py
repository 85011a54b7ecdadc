"""All queries of the time-series operators and their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import analytics, calendar, exact, measures, relations, research, rules, services

BOOKS = (calendar.BOOK, analytics.BOOK, relations.BOOK, research.BOOK, services.BOOK, measures.BOOK, rules.BOOK, exact.BOOK)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for b in BOOKS for k, q in b.queries.items()}
ORACLES: dict[str, str] = {k: q for b in BOOKS for k, q in b.oracles.items()}
