"""Reliability scores of facts and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.schemas import LAT_MAX, LAT_MIN, LON_MAX, LON_MIN, RELIABILITY_WEIGHTS, TAU_MAX_SCORER, TAU_MIN


def spatial_score(lat: Column, lon: Column) -> Column:
    """Missing 0, inside the box 1, outside 0.5."""
    return F.when(lat.isNull() | lon.isNull(), 0.0).when(lat.between(LAT_MIN, LAT_MAX) & lon.between(LON_MIN, LON_MAX), 1.0).otherwise(0.5)


def temporal_score(tau: Column, last: int = TAU_MAX_SCORER) -> Column:
    """Missing 0.5, in range 1, else 0.3."""
    return F.when(tau.isNull(), 0.5).when(tau.between(TAU_MIN, last), 1.0).otherwise(0.3)


def score(facts: DataFrame, images: DataFrame, clip: DataFrame) -> DataFrame:
    """Adds the component scores, reliability_score (half-even, 4 places), has_image and image_path.

    images(h, image_path): one row per head, an empty path still counts; clip(h, clip_score): missing = 0.
    """
    im = images.select(F.col("h").alias("__ih"), "image_path")
    cl = clip.select(F.col("h").alias("__ch"), F.col("clip_score").alias("__clip"))
    j = facts.join(im, F.col("h") == F.col("__ih"), "left").join(cl, F.col("h") == F.col("__ch"), "left")
    a, b, c, d = RELIABILITY_WEIGHTS
    j = j.withColumns({"vis_score": F.when(F.col("__ih").isNotNull(), 1.0).otherwise(0.0), "clip_score": F.coalesce("__clip", F.lit(0.0)), "spatial_score": spatial_score(F.col("l_h_lat"), F.col("l_h_lon")), "temporal_score": temporal_score(F.col("tau_start")), "has_image": F.col("__ih").isNotNull()})
    total = a * F.col("vis_score") + b * F.col("clip_score") + c * F.col("spatial_score") + d * F.col("temporal_score")
    return j.withColumn("reliability_score", F.bround(total, 4)).drop("__ih", "__ch", "__clip")


def by_relation(scored: DataFrame) -> DataFrame:
    s = F.col("reliability_score")
    return scored.groupBy("r").agg(F.round(F.avg(s), 3).alias("mean"), F.round(F.min(s), 3).alias("min"), F.round(F.max(s), 3).alias("max"), F.count(s).alias("n"))


def overall(scored: DataFrame) -> DataFrame:
    """Totals, distinct heads, image rows per distinct head, exact median and share of scores of 0.5 and more."""
    s = F.col("reliability_score")
    return scored.agg(
        F.count("*").alias("n"), F.countDistinct("h").alias("n_entities"), F.round(F.sum(F.col("has_image").cast("int")) / F.countDistinct("h"), 6).alias("image_rows_per_entity"), F.round(F.min(s), 6).alias("min"), F.round(F.max(s), 6).alias("max"), F.round(F.avg(s), 6).alias("mean"),
        F.round(F.median(s), 6).alias("median"), F.round(F.avg((s >= 0.5).cast("int")), 6).alias("share_half"), F.round(F.avg("vis_score"), 6).alias("vis"), F.round(F.avg("clip_score"), 6).alias("clip"), F.round(F.avg("spatial_score"), 6).alias("spatial"), F.round(F.avg("temporal_score"), 6).alias("temporal"),
    )
