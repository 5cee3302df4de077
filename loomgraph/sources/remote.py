"""Remote services as a Python data source: triple stores, wiki pages, entity records and geocoders.

spark.read.format("keyed_service").options(keys=..., service=...).load() gives (key, ok, body). Keys are cut into partitions of one request batch
each. The transport is a registered function from (service, keys) to bodies; `fixture` reads them from a JSON file or from the option `bodies`, so pipelines and
tests run without a network. Failures are retried with growing delays and then raised: an outage never looks like an empty result.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "key string, ok boolean, body string"


def _fixture(options: dict, keys: list[str]) -> dict[str, str | None]:
    if "bodies" in options:
        data = json.loads(options["bodies"])
    else:
        with open(options["fixture"], encoding="utf-8") as f:
            data = json.load(f)
    return {k: None if data.get(k) is None else data[k] if isinstance(data[k], str) else json.dumps(data[k], ensure_ascii=False) for k in keys}


def _http(options: dict, keys: list[str]) -> dict[str, str | None]:
    """One GET per batch: {keys} in the URL template takes the keys joined by '|', or one GET per key with {key}."""
    template, agent = options["url"], options.get("agent", "loomgraph")
    out: dict[str, str | None] = {}
    groups = [keys] if "{keys}" in template else [[k] for k in keys]
    for g in groups:
        url = template.replace("{keys}", urllib.parse.quote("|".join(g))).replace("{key}", urllib.parse.quote(g[0]))
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=float(options.get("timeout", 30))) as r:
            body = r.read().decode()
        out |= dict.fromkeys(g, body)
        time.sleep(float(options.get("delay", 0)))
    return out


TRANSPORTS: dict[str, Callable[[dict, list[str]], dict[str, str | None]]] = {"fixture": _fixture, "http": _http}


class _Batch(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[_Batch]:
        keys = list(dict.fromkeys(k for k in json.loads(self.options.get("keys", "[]")) if k and k.strip()))
        size = int(self.options.get("batch", 50))
        if self.options.get("serial", "false") == "true":  # a global rate limit allows one reader
            return [_Batch(keys)]
        return [_Batch(keys[i : i + size]) for i in range(0, len(keys), size)] or [_Batch([])]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        if not partition.keys:
            return
        tries, wait = int(self.options.get("tries", 3)), float(self.options.get("backoff", 1.0))
        for n in range(1, tries + 1):
            try:
                got = TRANSPORTS[self.options.get("transport", "http")](self.options, partition.keys)
                break
            except Exception:  # noqa: BLE001
                if n == tries:
                    raise
                time.sleep(wait * n)
        for k in partition.keys:
            yield k, got.get(k) is not None, got.get(k)


class KeyedService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fetch(spark: SparkSession, keys: list[str], **options: str) -> DataFrame:
    """(key, ok, body) of a list of keys known to the driver; ok = false is a recorded miss, to be kept in the cache."""
    spark.dataSource.register(KeyedService)
    r = spark.read.format("keyed_service").option("keys", json.dumps(keys))
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load()


def fetch_column(keys: DataFrame, column: str, **options) -> DataFrame:
    """The same for a column of any size: distinct keys stay distributed and are requested in batches by their executors."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ks = [k for k in b.column(0).to_pylist() if k and k.strip()]
            reader = _Reader({k: str(v) for k, v in options.items()})
            size = int(options.get("batch", 50))
            rows = [r for i in range(0, len(ks), size) for r in reader.read(_Batch(ks[i : i + size]))]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string())], names=["key", "ok", "body"])

    distinct = keys.select(column).distinct()
    return (distinct.coalesce(1) if options.get("serial") else distinct).mapInArrow(run, SCHEMA)
