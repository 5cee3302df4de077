"""Queries on reliability scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import reliability as rel
from loomgraph.plans.base import FACTS_SQL, Book, facts
from loomgraph.session import table

book = Book()
#: Heads of showcase samples with an image have a path; similarity of a head is derived from its fact ids.
DIM_SQL = """imgs AS (SELECT fact_6tuple.h AS h, max(coalesce(image_url, '')) AS image_path FROM showcase_samples WHERE fact_6tuple.h IS NOT NULL GROUP BY 1),
    clips AS (SELECT h, CAST(min(fact_id) % 97 AS DOUBLE) / 97 AS clip_score FROM facts WHERE h IS NOT NULL AND fact_id % 3 = 0 GROUP BY h)"""
_SP = "CASE WHEN l_h_lat IS NULL OR l_h_lon IS NULL THEN 0.0 WHEN l_h_lat BETWEEN 8.0 AND 23.5 AND l_h_lon BETWEEN 102.0 AND 110.0 THEN 1.0 ELSE 0.5 END"
_TE = "CASE WHEN tau_start IS NULL THEN 0.5 WHEN tau_start BETWEEN 800 AND 2024 THEN 1.0 ELSE 0.3 END"
SCORED_SQL = f"""{FACTS_SQL}, {DIM_SQL}, parts AS (SELECT f.*, CAST(CASE WHEN i.h IS NOT NULL THEN 1.0 ELSE 0.0 END AS DOUBLE) AS vis_score, coalesce(c.clip_score, 0.0) AS clip_score, CAST({_SP} AS DOUBLE) AS spatial_score, CAST({_TE} AS DOUBLE) AS temporal_score, i.h IS NOT NULL AS has_image
      FROM facts f LEFT JOIN imgs i ON f.h = i.h LEFT JOIN clips c ON f.h = c.h),
    scored AS (SELECT *, round_even(CAST(0.35 AS DOUBLE) * vis_score + CAST(0.30 AS DOUBLE) * clip_score + CAST(0.20 AS DOUBLE) * spatial_score + CAST(0.15 AS DOUBLE) * temporal_score, 4) AS reliability_score FROM parts)"""


def scored(spark, d):
    f = facts(spark, d)
    s = table(spark, d, "showcase_samples")
    im = s.where("fact_6tuple.h is not null").groupBy(F.col("fact_6tuple.h").alias("h")).agg(F.max(F.coalesce("image_url", F.lit(""))).alias("image_path"))
    cl = f.where("h is not null and fact_id % 3 = 0").groupBy("h").agg((F.pmod(F.min("fact_id"), F.lit(97)).cast("double") / 97).alias("clip_score"))
    return rel.score(f, im, cl)


@book.add("reliability_scores", f"WITH {SCORED_SQL} SELECT fact_id, vis_score, round(clip_score, 6) AS clip_score, spatial_score, temporal_score, round(reliability_score, 4) AS reliability_score, has_image FROM scored")
def _(spark, d):
    return scored(spark, d).select("fact_id", "vis_score", F.round("clip_score", 6).alias("clip_score"), "spatial_score", "temporal_score", F.round("reliability_score", 4).alias("reliability_score"), "has_image")


@book.add("reliability_by_relation", f"WITH {SCORED_SQL} SELECT r, round(avg(reliability_score), 3) AS mean, round(min(reliability_score), 3) AS min, round(max(reliability_score), 3) AS max, count(reliability_score) AS n FROM scored GROUP BY r")
def _(spark, d):
    return rel.by_relation(scored(spark, d))


@book.add("reliability_overall", f"""WITH {SCORED_SQL} SELECT count(*) AS n, count(DISTINCT h) AS n_entities, round(sum(CASE WHEN has_image THEN 1 ELSE 0 END) / count(DISTINCT h), 6) AS image_rows_per_entity, round(min(reliability_score), 6) AS min, round(max(reliability_score), 6) AS max, round(avg(reliability_score), 6) AS mean,
    round(median(reliability_score), 6) AS median, round(avg(CASE WHEN reliability_score >= 0.5 THEN 1 ELSE 0 END), 6) AS share_half, round(avg(vis_score), 6) AS vis, round(avg(clip_score), 6) AS clip, round(avg(spatial_score), 6) AS spatial, round(avg(temporal_score), 6) AS temporal FROM scored""")
def _(spark, d):
    return rel.overall(scored(spark, d))


@book.add("reliability_top", f"WITH {SCORED_SQL} SELECT fact_id, round(reliability_score, 4) AS reliability_score FROM scored ORDER BY reliability_score DESC, fact_id LIMIT 5")
def _(spark, d):
    return scored(spark, d).orderBy(F.desc("reliability_score"), "fact_id").limit(5).select("fact_id", F.round("reliability_score", 4).alias("reliability_score"))


@book.add("reliability_image_by_relation", f"WITH {SCORED_SQL} SELECT r, round(100.0 * avg(CASE WHEN has_image THEN 1 ELSE 0 END), 2) AS pct_image FROM scored GROUP BY r")
def _(spark, d):
    return scored(spark, d).groupBy("r").agg(F.round(100.0 * F.avg(F.col("has_image").cast("int")), 2).alias("pct_image"))
