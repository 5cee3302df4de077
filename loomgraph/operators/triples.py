"""Graph patterns over a triple table (s, p, o): optional parts, language labels, statement paths and transitive classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut


def objects(triples: DataFrame, p: str, name: str) -> DataFrame:
    """(s, name) of one property; several objects give several rows."""
    return triples.where(F.col("p") == p).select("s", F.col("o").alias(name))


def labels(triples: DataFrame, required: bool = True) -> DataFrame:
    """(s, label): Vietnamese, else English; the language belongs to the join, not to a later filter."""
    vi = objects(triples, "label_vi", "vi").groupBy("s").agg(F.min("vi").alias("vi"))
    en = objects(triples, "label_en", "en").groupBy("s").agg(F.min("en").alias("en"))
    out = vi.join(en, "s", "full_outer").select("s", F.coalesce("vi", "en").alias("label"))
    return out.where("label is not null") if required else out


def coordinates(triples: DataFrame) -> DataFrame:
    """(s, lat, lon) over the statement node; both bind together or not at all, several statements give several rows."""
    st = objects(triples, "P625", "node")
    lat, lon = objects(triples, "lat", "lat").withColumnRenamed("s", "node"), objects(triples, "lon", "lon").withColumnRenamed("s", "node")
    return st.join(lat, "node").join(lon, "node").select("s", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))


def year(c: Column) -> Column:
    """Year of a signed ISO date text, negative before our era."""
    return F.expr(f"try_cast(nullif(regexp_extract({c}, '^([+-]?[0-9]+)-', 1), '') as int)") if isinstance(c, str) else F.nullif(F.regexp_extract(c, r"^([+-]?[0-9]+)-", 1), F.lit("")).try_cast("int")


def str_after(c: Column, mark: str) -> Column:
    """Text after the first mark, '' where it is missing."""
    at = F.locate(mark, c)
    return F.when(at > 0, F.substring(c, at + F.lit(len(mark)), F.length(c))).otherwise("")


def closure(triples: DataFrame, prop: str, root: str, max_depth: int = 50) -> DataFrame:
    """(s): root and everything that reaches it over prop. Frontier joins to a fixed point; cycles end, as seen nodes leave the frontier."""
    spark = triples.sparkSession
    edges = objects(triples, prop, "o")
    seen = spark.createDataFrame([(root,)], "s string")
    frontier = seen
    for _ in range(max_depth):
        step = edges.join(frontier.withColumnRenamed("s", "o"), "o").select("s").distinct().join(seen, "s", "left_anti")
        frontier = cut(step)
        if frontier.isEmpty():
            return seen
        seen = cut(seen.union(frontier))
    raise RuntimeError(f"class tree deeper than {max_depth}")


def relation_rows(triples: DataFrame, prop: str, relation: str, *dates: str) -> DataFrame:
    """Facts of one property: labels required on the head, optional on the tail, optional coordinates of both ends, first available date."""
    lab, xy = labels(triples), coordinates(triples)
    base = objects(triples, prop, "t").withColumnRenamed("s", "h")
    out = base.join(lab.select(F.col("s").alias("h"), F.col("label").alias("h_label")), "h").join(lab.select(F.col("s").alias("t"), F.col("label").alias("t_label")), "t", "left")
    out = out.join(xy.select(F.col("s").alias("h"), F.col("lat").alias("l_h_lat"), F.col("lon").alias("l_h_lon")), "h", "left").join(xy.select(F.col("s").alias("t"), F.col("lat").alias("l_t_lat"), F.col("lon").alias("l_t_lon")), "t", "left")
    found = []
    for i, p in enumerate(dates):
        d = objects(triples, p, f"d{i}").groupBy("s").agg(F.min(f"d{i}").alias(f"d{i}")).withColumnRenamed("s", "h")
        out = out.join(d, "h", "left")
        found.append(year(F.col(f"d{i}")))
    tau = F.coalesce(*found) if found else F.lit(None).cast("int")
    return out.select("h", "h_label", F.lit(relation).alias("r"), "t", "t_label", tau.alias("tau_start"), "l_h_lat", "l_h_lon", "l_t_lat", "l_t_lon").distinct()
