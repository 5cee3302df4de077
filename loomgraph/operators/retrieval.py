"""Grid-quantised space-time embeddings, relevance, top-k retrieval and entity ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import vectors as V
from loomgraph.schemas import BINS_T, BINS_X, BINS_Y, DEFAULT_LAT, DEFAULT_LON, DEFAULT_TAU, LAT_MAX, LAT_MIN, LON_MAX, LON_MIN, RELATIONS, TAU_MAX, TAU_MIN
from loomgraph.session import cut


def quantise(v: Column, lo: float, hi: float, bins: int) -> Column:
    c = F.greatest(F.least(v.cast("double"), F.lit(float(hi))), F.lit(float(lo)))
    return F.least(F.floor((c - lo) / (hi - lo + 1e-12) * bins), F.lit(bins - 1)).cast("int")


def cells(lat: Column, lon: Column, tau: Column) -> tuple[Column, Column, Column]:
    """Grid cells; x is the latitude."""
    return quantise(lat, LAT_MIN, LAT_MAX, BINS_X), quantise(lon, LON_MIN, LON_MAX, BINS_Y), quantise(tau, TAU_MIN, TAU_MAX, BINS_T)


def impute(df: DataFrame, lat: str, lon: str, tau: str | None = None, drop_space: bool = False, drop_time: bool = False) -> DataFrame:
    """Missing coordinates and years become the defaults; ablations use the defaults for all rows."""
    put = {lat: F.lit(DEFAULT_LAT) if drop_space else F.coalesce(lat, F.lit(DEFAULT_LAT)), lon: F.lit(DEFAULT_LON) if drop_space else F.coalesce(lon, F.lit(DEFAULT_LON))}
    if tau:
        put[tau] = F.lit(DEFAULT_TAU) if drop_time else F.coalesce(F.col(tau).cast("double"), F.lit(DEFAULT_TAU))
    return df.withColumns(put)


def parameter_table(spark: SparkSession, name: str, rows: int, dim: int) -> DataFrame:
    """(id, vec): a deterministic start table from integer arithmetic, the same in every engine; at most 100 rows, always broadcast."""
    salt = sum(map(ord, name))
    return spark.range(rows).select(F.col("id").cast("int").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: ((F.pmod((F.col("id") + 1) * (j + 3) * 7919 + salt * 31, F.lit(2001)) - 1000) / 1000.0).cast("double")).alias("vec"))


def check_dims(dim: int, **tables: int) -> None:
    """Construction guard: every table has the configured width."""
    for name, got in tables.items():
        if got != dim:
            raise ValueError(f"{name} has width {got}, configured is {dim}")


def check_heads(hidden: int, heads: int, kv_heads: int, head_dim: int) -> None:
    if heads * head_dim != hidden:
        raise ValueError(f"{heads} heads of {head_dim} do not give {hidden}")
    if heads % kv_heads:
        raise ValueError(f"{heads} heads are not divisible by {kv_heads}")


def embed(df: DataFrame, tables: dict[str, DataFrame], lat: str, lon: str, tau: str, out: str) -> DataFrame:
    """STE = E_x[cell of lat] + E_y[cell of lon] + E_t[cell of year], by three broadcast lookups of bounded tables."""
    ix, iy, it = cells(F.col(lat), F.col(lon), F.col(tau))
    j = df.withColumns({"__x": ix, "__y": iy, "__t": it})
    for k, t in (("x", tables["x"]), ("y", tables["y"]), ("t", tables["t"])):
        j = j.join(F.broadcast(t.select(F.col("id").alias(f"__i{k}"), F.col("vec").alias(f"__v{k}"))), F.col(f"__{k}") == F.col(f"__i{k}"), "left")
    return j.withColumn(out, V.add(F.col("__vx"), F.col("__vy"), F.col("__vt"))).drop(*[f"__{p}{k}" for p in ("i", "v") for k in "xyt"], "__x", "__y", "__t")


def relation_id(r: Column) -> Column:
    """Index of a relation; an unknown one raises."""
    expr = F.when(r == RELATIONS[0], 0)
    for i, name in enumerate(RELATIONS[1:], 1):
        expr = expr.when(r == name, i)
    return F.coalesce(expr, F.raise_error(F.concat(F.lit("unknown relation "), F.coalesce(r, F.lit("null")))).cast("int"))


def plausibility(h: Column, r: Column, t: Column) -> Column:
    """s = |STE(h) + RE(r) - STE(t)|."""
    return V.distance(V.add(h, r), t)


def fact_vector(h: Column, r: Column, t: Column) -> Column:
    """g = (STE(h) + RE(r) + STE(t)) / 3."""
    return V.scale(V.add(h, r, t), 1.0 / 3.0)


def with_stats(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Adds per-group aggregates by a two-phase aggregation and a join, so that a candidate set of any size is no single task."""
    g = df.groupBy(*[F.col(c).alias(f"__k_{c}") for c in by]).agg(*[v.alias(k) for k, v in aggs.items()])
    on = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by]
    return df.join(g, on).drop(*[f"__k_{c}" for c in by])


def relevance(scored: DataFrame, alpha: float, by: list[str], cos: str = "cos", s: str = "s") -> DataFrame:
    """rel = alpha cos - (1 - alpha) (s - min) / max(max - min, 1e-12), per candidate set."""
    scored = cut(scored)  # the candidate set is used twice
    j = with_stats(scored, by, __lo=F.min(s), __hi=F.max(s))
    scaled = (F.col(s) - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-12))
    return j.withColumn("rel", alpha * F.col(cos) - (1 - alpha) * scaled).drop("__lo", "__hi")


def top_k(df: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """Best min(k, n) rows per query; ties fall to the smaller id."""
    w = W.partitionBy(*by).orderBy(F.desc(score), tie)
    return df.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def softmax(df: DataFrame, x: str, by: list[str], out: str) -> DataFrame:
    """Adds the softmax of x within each group."""
    df = cut(df)  # the candidate set is used twice
    top = df.groupBy(*[F.col(c).alias(f"__k_{c}") for c in by]).agg(F.max(x).alias("__m"))
    on = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by]
    z = df.join(top, on).groupBy(*[f"__k_{c}" for c in by]).agg(F.first("__m").alias("__m"), F.sum(F.exp(F.col(x) - F.col("__m"))).alias("__z"))
    return df.join(z, on).withColumn(out, F.exp(F.col(x) - F.col("__m")) / F.col("__z")).drop("__m", "__z", *[f"__k_{c}" for c in by])


def target_rank(scores: DataFrame, by: list[str], score: str, entity: str, target: str) -> DataFrame:
    """1-based rank of the target by falling score, ties by entity id; a target outside the set has no row.

    Counts the better rows by aggregation, so no query's candidates are sorted in one task.
    """
    goal = scores.where(F.col(entity) == F.col(target)).select(*[F.col(c).alias(f"__{c}") for c in by], F.col(score).alias("__p"), F.col(entity).alias("__e"))
    on = [scores[c] == F.col(f"__{c}") for c in by]
    better = (F.col(score) > F.col("__p")) | ((F.col(score) == F.col("__p")) & (F.col(entity) < F.col("__e")))
    return scores.join(goal, on).groupBy(*by).agg((F.sum(better.cast("int")) + 1).alias("rank"))


def entity_universe(df: DataFrame, last: bool = False) -> DataFrame:
    """(entity, lat, lon, tau): heads then tails per row; the first occurrence counts, or the last; defaults fill gaps. df: ord, h, t, coordinates, tau_start."""
    side = lambda i, s: F.struct(F.lit(i).alias("side"), F.col(s).alias("entity"), F.col(f"l_{s}_lat").alias("lat"), F.col(f"l_{s}_lon").alias("lon"), F.col("tau_start").cast("double").alias("tau"))
    e = df.select("ord", F.explode(F.array(side(0, "h"), side(1, "t"))).alias("e")).where("e.entity is not null")
    row = F.struct(F.col("ord").alias("o"), F.col("e.side").alias("side"), F.col("e.lat").alias("lat"), F.col("e.lon").alias("lon"), F.col("e.tau").alias("tau"))
    m = e.groupBy(F.col("e.entity").alias("entity")).agg((F.max(row) if last else F.min(row)).alias("m"))
    return m.select("entity", F.coalesce("m.lat", F.lit(DEFAULT_LAT)).alias("lat"), F.coalesce("m.lon", F.lit(DEFAULT_LON)).alias("lon"), F.coalesce("m.tau", F.lit(DEFAULT_TAU)).alias("tau"))


def against_all(rows: DataFrame, queries: DataFrame, key: str, block: int = 512) -> DataFrame:
    """A stated query set (column qid) against all rows, in blocks: every row meets each block of queries in the salt bucket of its key, so the work is spread over all tasks."""
    blocks = max(1, -(-queries.count() // block))
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("__b", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("__s", number(salts))
    r = rows.withColumn("__s", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).withColumn("__b", number(blocks))
    return r.join(q, ["__b", "__s"]).drop("__b", "__s")


def score_all(queries: DataFrame, entities: DataFrame, k: int, query_block: int = 2048, entity_block: int = 16384) -> DataFrame:
    """Top-k entities per query vector by dot product, (qid, entity, score, rk).

    A stated query set against all entities as a block matrix product: queries(qid, vec) and entities(entity, vec) are cut into blocks of bounded size, every cell of the grid of
    blocks is one task that keeps k per query, and the partial lists are merged. Nothing is collected or broadcast.
    """
    import numpy as np
    import pandas as pd

    nq, ne = (max(1, -(-df.count() // size)) for df, size in ((queries, query_block), (entities, entity_block)))
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.select("qid", "vec", F.pmod(F.xxhash64("qid"), F.lit(nq)).alias("qb"), number(ne).alias("eb"))
    e = entities.select("entity", "vec", number(nq).alias("qb"), F.pmod(F.xxhash64("entity"), F.lit(ne)).alias("eb"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": left["qid"][:0], "entity": right["entity"][:0], "score": np.empty(0)})
        right = right.sort_values("entity", kind="stable")
        s = np.round(np.stack(left["vec"].to_list()) @ np.stack(right["vec"].to_list()).T, 9)
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"qid": np.repeat(left["qid"].to_numpy(), order.shape[1]), "entity": right["entity"].to_numpy()[order.ravel()], "score": np.take_along_axis(s, order, 1).ravel()})

    kind = dict(queries.dtypes)["qid"], dict(entities.dtypes)["entity"]
    parts = q.groupBy("qb", "eb").cogroup(e.groupBy("qb", "eb")).applyInPandas(lambda a, b: cell(a, b), f"qid {kind[0]}, entity {kind[1]}, score double")
    return top_k(parts, ["qid"], "score", "entity", k)
