"""Sinks: CSV with a fixed header, nested JSON records, lookup caches and split folders."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fact_csv(df: DataFrame, path: str, columns: list[str], bom: bool = False) -> str:
    """CSV of the given columns; an empty input writes nothing and returns ''. With bom every part file starts with a byte order mark in its header."""
    out = df.select(*columns)
    if out.isEmpty():
        return ""
    if bom:
        out = out.withColumnRenamed(columns[0], "\ufeff" + columns[0])
    out.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="")
    return path


def records(df: DataFrame, path: str) -> str:
    """Nested JSON records with explicit nulls."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)
    return path


def cache(df: DataFrame, path: str) -> str:
    """Whole lookup cache, recorded misses included."""
    df.write.mode("overwrite").parquet(path)
    return path


def by_split(df: DataFrame, path: str, split: str = "split") -> str:
    """One folder per split, so that a reader of one split prunes the others. Every task writes its own part of each split; nothing is gathered by split, which one value may dominate."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)
    return path
