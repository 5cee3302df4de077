"""Registered queries of the core operators, by topic module."""

from __future__ import annotations

import importlib

#: Topic modules, each with a `book` of queries.
TOPICS = ("spatial", "questions", "splits", "audit", "reliability", "merge", "triples", "parsers", "visual", "retrieval", "metrics", "calendar", "io", "model")


def _books():
    import os

    here = os.path.dirname(__file__)
    return [importlib.import_module(f"loomgraph.plans.{t}").book for t in TOPICS if os.path.exists(os.path.join(here, f"{t}.py"))]


def queries() -> dict:
    return {k: v for b in _books() for k, v in b.queries.items()}


def oracle_sql() -> dict:
    return {k: v for b in _books() for k, v in b.sql.items()}


def flagship(spark, sf_dir: str):
    """Facts, coordinates, template questions, de-duplication and a fact-safe split, counted by relation and split."""
    from loomgraph.plans.splits import flagship_counts

    return flagship_counts(spark, sf_dir)
