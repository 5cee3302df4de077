"""Queries on sources, sinks, streams and model operators."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from loomgraph.functions import models as md
from loomgraph.plans.base import EVENTS_SQL, Book, events
from loomgraph.session import ensure_checkpoint_dir, table
from loomgraph.sources import files, remote, sinks
from loomgraph.streaming import events as se

book = Book()


def _shared(spark) -> str:
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"io-{uuid.uuid4().hex}")


_RAW = ("h", "h_label", "r", "t", "t_label", "tau_start", "l_h_lat", "l_h_lon", "l_t_lat", "l_t_lon")


@book.add("io_fact_csv_round_trip", f"WITH {EVENTS_SQL} SELECT fact_id, h, r, t, tau_start, l_h_lat, l_t_lon FROM ev")
def _(spark, d):
    path = sinks.fact_csv(events(spark, d), _shared(spark), ["fact_id", *_RAW])
    return files.raw_facts(spark, path).select(F.col("fact_id").cast("long").alias("fact_id"), "h", "r", "t", "tau_start", "l_h_lat", "l_t_lon")


@book.add("io_split_folders", "SELECT split, count(*) AS n FROM (SELECT DISTINCT qid, split FROM split_members) WHERE split = 'test' GROUP BY split")
def _(spark, d):
    path = sinks.by_split(table(spark, d, "split_members").select("qid", "split").distinct(), _shared(spark))
    return spark.read.parquet(path).where("split = 'test'").groupBy("split").agg(F.count("*").alias("n"))


@book.add("io_json_records", "SELECT qid, fact_6tuple.h AS h, fact_6tuple.tau_start AS tau_start FROM showcase_samples")
def _(spark, d):
    s = table(spark, d, "showcase_samples").select("qid", "fact_6tuple")
    path = sinks.records(s, _shared(spark))
    return files.tolerant_json(spark, path, s.schema.simpleString()[7:-1].replace("fact_6tuple:", "fact_6tuple ").replace("qid:", "qid ", 1)).select("qid", "fact_6tuple.h", "fact_6tuple.tau_start")


@book.add("io_cache_round_trip", "SELECT name, lat, lon FROM (SELECT t_label AS name, min(l_t_lat) AS lat, min(l_t_lon) AS lon FROM historical_events WHERE t_label IS NOT NULL GROUP BY t_label)")
def _(spark, d):
    c = table(spark, d, "historical_events").where("t_label is not null").groupBy(F.col("t_label").alias("name")).agg(F.min("l_t_lat").alias("lat"), F.min("l_t_lon").alias("lon"))
    return files.cache_table(spark, sinks.cache(c, _shared(spark)))


@book.add("io_keyed_service", "SELECT n_name AS key, n_nationkey % 3 <> 0 AS ok, CASE WHEN n_nationkey % 3 <> 0 THEN 'N' || n_nationkey END AS body FROM nation")
def _(spark, d):
    rows = table(spark, d, "nation").select("n_name", "n_nationkey").collect()  # 25 rows, fixed
    bodies = json.dumps({r["n_name"]: f"N{r['n_nationkey']}" for r in rows if r["n_nationkey"] % 3})
    return remote.fetch(spark, [r["n_name"] for r in rows], transport="fixture", bodies=bodies, batch="10")


@book.add("stream_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return se.run_once(se.windows(se.read(spark, d))).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@book.add("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def _(spark, d):
    return se.run_once(se.sessions(se.read(spark, d))).select("user_id", F.col("w.start").alias("start"), "n")


_W = lambda i, j, salt: f"(((({i}) + 1) * (({j}) + 3) * 7919 + {salt} * 31) % 2001 - 1000) / 1000.0::DOUBLE"


@book.add("model_mlp", f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), h AS (SELECT vec_id, list_transform(range(16), lambda j: greatest(list_sum(list_transform(range(64), lambda i: v[i + 1] * {_W('i', 'j', 3)})), 0)) AS h FROM e)
    SELECT vec_id, round(1 / (1 + exp(-list_sum(list_transform(range(16), lambda j: h[j + 1] * {_W('j', '0', 5)})))), 6) AS score FROM h""")
def _(spark, d):
    w1, w2 = md.start_matrix(64, 16, 3), md.start_matrix(16, 1, 5)[:, 0]
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select("vec_id", F.round(md.mlp_col(F.col("v"), w1, np.zeros(16), w2, 0.0), 6).alias("score"))


_TOK = "v[16 * t + 8 * (h // 4) + k]"


@book.add("model_attention", f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT vec_id, v, list_transform(range(64), lambda j: list_sum(list_transform(range(64), lambda i: v[i + 1] * {_W('i', 'j', 7)}))) AS q FROM e),
    s AS (SELECT vec_id, v, h, list_transform(range(4), lambda t: list_sum(list_transform(range(1, 9), lambda k: q[8 * h + k] * {_TOK})) / sqrt(8)) AS s FROM q, (SELECT unnest(range(8)) AS h)), w AS (SELECT *, list_transform(s, lambda x: exp(x - list_max(s))) AS x FROM s),
    o AS (SELECT vec_id, h, list_transform(range(1, 9), lambda k: list_sum(list_transform(range(4), lambda t: x[t + 1] / list_sum(x) * {_TOK}))) AS o FROM w)
    SELECT vec_id, round(sum(list_sum(list_transform(range(8), lambda k: o[k + 1] * {_W('(8 * h + k)', '0', 11)}))), 6) AS z1, round(sum(list_sum(list_transform(range(8), lambda k: o[k + 1] * {_W('(8 * h + k)', '7', 11)}))), 6) AS z8 FROM o GROUP BY vec_id""")
def _(spark, d):
    wq, wo = md.start_matrix(64, 64, 7), md.start_matrix(64, 8, 11)
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    tokens = F.array(*[F.slice("v", 1 + 16 * i, 16) for i in range(4)])
    out = md.attention_col(F.col("v"), tokens, wq, wo, 8, 2)
    return v.select("vec_id", F.transform(out, lambda x: F.round(x, 6)).alias("z")).select("vec_id", F.element_at("z", 1).alias("z1"), F.element_at("z", 8).alias("z8"))


@book.add("model_image_placeholder", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS first FROM embeddings")
def _(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("embedding").cast("array<double>")).alias("img"))
    return v.select("vec_id", F.round(F.coalesce("img", F.array_repeat(F.lit(0.0), 64))[0], 6).alias("first"))


@book.add("json_leaf_counts", "SELECT event_id, CAST(0 AS BIGINT) AS nulls, CAST(1 AS BIGINT) AS filled FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", md.leaf_counts_col(F.col("props")).alias("c")).select("event_id", "c.nulls", "c.filled")


@book.add("runs_pending", "SELECT n_name AS tag, 42 AS seed FROM nation WHERE n_nationkey % 3 = 0")
def _(spark, d):
    n = table(spark, d, "nation")
    done = n.where("n_nationkey % 3 <> 0").selectExpr("n_name as tag", "42 as seed")
    return n.selectExpr("n_name as tag", "42 as seed").join(done, ["tag", "seed"], "left_anti")
