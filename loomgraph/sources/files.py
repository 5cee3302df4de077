"""File sources with fixed schemas: raw facts, coded events, entity JSON, sheets and configuration."""

from __future__ import annotations

import copy
import os
import zipfile
from typing import Any, BinaryIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators.merge import CODED_HEADERS
from loomgraph.schemas import EVENT_CODES, RAW_FACTS


def plain_names(df: DataFrame) -> DataFrame:
    """Header names without a byte order mark and outer spaces."""
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])


def raw_facts(spark: SparkSession, path: str, src_file: str | None = None) -> DataFrame:
    """Raw fact CSV: every column is read as text and cast with try_cast, so '' and broken numbers are null."""
    text = plain_names(spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8"))
    have = set(text.columns)
    cols = [(F.col(f.name).try_cast(f.dataType) if f.name in have and not isinstance(f.dataType, T.StringType) else F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in RAW_FACTS]
    extra = [c for c in text.columns if c not in RAW_FACTS.names]
    return text.select(*cols, *extra, F.lit(src_file or os.path.basename(path)).alias("src_file"))


def union_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Bag union of raw fact files in order, each row with its file name and place."""
    out = None
    for i, p in enumerate(paths):
        df = raw_facts(spark, p).withColumn("src_rank", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def coded_events(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Tab-separated coded events; headers are matched by text, first match wins; malformed lines are dropped; codes stay text."""
    out = None
    for p in sorted(paths):
        df = plain_names(spark.read.csv(p, sep="\t", header=True, mode="DROPMALFORMED"))
        taken: dict[str, str] = {}
        for text, name in CODED_HEADERS.items():
            hit = next((c for c in df.columns if text.lower() in c.lower()), None)
            if hit and hit not in taken.values():
                taken[name] = hit
        cols = []
        for f in EVENT_CODES:
            c = F.col(f"`{taken[f.name]}`") if f.name in taken else F.lit(None)
            cols.append((c.try_cast(f.dataType) if f.name in taken and not isinstance(f.dataType, T.StringType) else c.cast(f.dataType)).alias(f.name))
        part = df.select(*cols)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], EVENT_CODES) if out is None else out


def tolerant_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON with a fixed schema; a missing path gives an empty table, broken records are dropped."""
    try:
        df = spark.read.schema(ddl).json(path, mode="DROPMALFORMED")
        df.schema
        return df
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], ddl)
        raise


def cache_table(spark: SparkSession, path: str) -> DataFrame:
    """Lookup cache (name, lat, lon): a null latitude is a recorded miss; a missing file is an empty cache."""
    ddl = "name string, lat double, lon double"
    try:
        return spark.read.schema(ddl).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], ddl)
        raise


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet(spark: SparkSession, path: str | BinaryIO, name: str) -> DataFrame:
    """One named sheet of a workbook (a path or an open file) as text columns, row 1 is the header; a missing sheet raises. Sheets are small by nature and read on the driver."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet")]
        if name not in names:
            raise ValueError(f"no sheet {name!r}, there are {names}")
        root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{names.index(name) + 1}.xml"))
    rows = []
    for r in root.iter(f"{{{_NS['m']}}}row"):
        cells: dict[int, str | None] = {}
        for c in r.findall("m:c", _NS):
            letters = "".join(x for x in c.get("r", "A") if x.isalpha())
            at = 0
            for x in letters:
                at = at * 26 + ord(x) - 64
            v = c.find("m:v", _NS)
            inline = c.find("m:is", _NS)
            cells[at] = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
        rows.append(cells)
    if not rows:
        raise ValueError(f"sheet {name!r} is empty")
    head = [rows[0].get(i) or f"c{i}" for i in range(1, max(rows[0], default=0) + 1)]
    data = [tuple(r.get(i) for i in range(1, len(head) + 1)) for r in rows[1:]]
    return spark.createDataFrame(data, T.StructType([T.StructField(h, T.StringType()) for h in head]))


def override(config: dict[str, Any], assignments: list[str]) -> dict[str, Any]:
    """Copy of a nested configuration with key.sub=value assignments, typed by the old value; new keys stay text."""
    out = copy.deepcopy(config)
    for a in assignments:
        key, eq, text = a.partition("=")
        if not eq:
            raise ValueError(f"no '=' in {a!r}")
        *path, leaf = key.split(".")
        node = out
        for p in path:
            node = node.setdefault(p, {})
        old = node.get(leaf)
        if isinstance(old, bool):
            node[leaf] = text.strip().lower() in ("1", "true", "yes", "on")
        elif isinstance(old, (int, float)):
            node[leaf] = type(old)(text)
        else:
            node[leaf] = text
    return out
