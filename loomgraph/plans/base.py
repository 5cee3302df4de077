"""Registry of queries with their DuckDB twins, and the views they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import table


class Book:
    """Queries of one topic: name -> (Spark callable, SQL text or None)."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


#: One row per fact: the question row with the smallest qid gives its values.
FACTS_SQL = """facts AS (SELECT fact_id, h, h_label, relation AS r, t, t_label, tau_start, l_h_lat, l_h_lon, l_t_lat, l_t_lon, source
    FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY qid) AS rn FROM questions) WHERE rn = 1)"""

#: Raw events as facts.
EVENTS_SQL = """ev AS (SELECT row_id AS fact_id, h, h_label, r, t, t_label, tau_start, l_h_lat, l_h_lon, l_t_lat, l_t_lon FROM historical_events)"""

_FACT_COLS = ("h", "h_label", "relation", "t", "t_label", "tau_start", "l_h_lat", "l_h_lon", "l_t_lat", "l_t_lon", "source")


def facts(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = _FACT_COLS) -> DataFrame:
    """Facts behind the questions, all columns or those named; a two-phase aggregate, so a fact with many questions is no hot task."""
    q = table(spark, sf_dir, "questions")
    first = q.groupBy("fact_id").agg(F.min(F.struct("qid", *columns)).alias("f"))
    return first.select("fact_id", *[F.col(f"f.{c}").alias("r" if c == "relation" else c) for c in columns])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events as facts; fact_id is the row id."""
    e = table(spark, sf_dir, "historical_events")
    return e.select(F.col("row_id").alias("fact_id"), "h", "h_label", "r", "t", "t_label", "tau_start", "l_h_lat", "l_h_lon", "l_t_lat", "l_t_lon")
