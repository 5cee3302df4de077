"""Queries on coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import spatial as sp
from loomgraph.plans.base import EVENTS_SQL, FACTS_SQL, Book, events, facts
from loomgraph.session import table

book = Book()
_COLS = ("fact_id", "r", "l_h_lat", "l_h_lon", "l_t_lat", "l_t_lon")
#: A place dimension made of the tails: first coordinates by fact_id of every label that has some.
PLACES_SQL = """places AS (SELECT name, lat, lon FROM (SELECT trim(t_label) AS name, l_t_lat AS lat, l_t_lon AS lon, row_number() OVER (PARTITION BY trim(t_label) ORDER BY fact_id) AS rn
    FROM facts WHERE trim(t_label) <> '' AND l_t_lat IS NOT NULL AND l_t_lon IS NOT NULL) WHERE rn = 1)"""
IN_BOX = "CASE WHEN {a} IS NULL OR {b} IS NULL THEN true ELSE {a} BETWEEN 8.0 AND 23.5 AND {b} BETWEEN 102.0 AND 110.0 END"


def places(f):
    known = f.where("trim(t_label) <> '' and l_t_lat is not null and l_t_lon is not null")
    return known.groupBy(F.trim("t_label").alias("name")).agg(F.min(F.struct("fact_id", "l_t_lat", "l_t_lon")).alias("p")).select("name", F.col("p.l_t_lat").alias("lat"), F.col("p.l_t_lon").alias("lon"))


@book.add("spatial_copy_tail", f"""WITH {FACTS_SQL} SELECT fact_id, r, CASE WHEN r IN ('bornIn','diedIn') AND l_h_lat IS NULL THEN l_t_lat ELSE l_h_lat END AS l_h_lat,
    CASE WHEN r IN ('bornIn','diedIn') AND l_h_lat IS NULL THEN l_t_lon ELSE l_h_lon END AS l_h_lon, l_t_lat, l_t_lon FROM facts""")
def _(spark, d):
    return sp.copy_tail_to_head(facts(spark, d)).select(*_COLS)


@book.add("spatial_events_take_tail", f"""WITH {EVENTS_SQL} SELECT fact_id, r, CASE WHEN r = 'occurredAt' AND l_h_lat IS NULL AND l_t_lat IS NOT NULL THEN l_t_lat ELSE l_h_lat END AS l_h_lat,
    CASE WHEN r = 'occurredAt' AND l_h_lat IS NULL AND l_t_lat IS NOT NULL THEN l_t_lon ELSE l_h_lon END AS l_h_lon, l_t_lat, l_t_lon FROM ev""")
def _(spark, d):
    return sp.events_take_tail(events(spark, d)).select(*_COLS)


ENRICH_SQL = f"""{FACTS_SQL}, {PLACES_SQL},
    s1 AS (SELECT * REPLACE (CASE WHEN r IN ('bornIn','diedIn') AND l_h_lat IS NULL THEN l_t_lat ELSE l_h_lat END AS l_h_lat, CASE WHEN r IN ('bornIn','diedIn') AND l_h_lat IS NULL THEN l_t_lon ELSE l_h_lon END AS l_h_lon) FROM facts),
    s2 AS (SELECT s1.* REPLACE (CASE WHEN p.name IS NOT NULL THEN p.lat ELSE l_h_lat END AS l_h_lat, CASE WHEN p.name IS NOT NULL THEN p.lon ELSE l_h_lon END AS l_h_lon) FROM s1 LEFT JOIN places p ON trim(h_label) = p.name AND l_h_lat IS NULL),
    s3 AS (SELECT s2.* REPLACE (CASE WHEN p.name IS NOT NULL THEN p.lat ELSE l_t_lat END AS l_t_lat, CASE WHEN p.name IS NOT NULL THEN p.lon ELSE l_t_lon END AS l_t_lon) FROM s2 LEFT JOIN places p ON trim(t_label) = p.name AND l_t_lat IS NULL),
    enriched AS (SELECT * REPLACE (CASE WHEN r = 'occurredAt' AND l_h_lat IS NULL AND l_t_lat IS NOT NULL THEN l_t_lat ELSE l_h_lat END AS l_h_lat, CASE WHEN r = 'occurredAt' AND l_h_lat IS NULL AND l_t_lat IS NOT NULL THEN l_t_lon ELSE l_h_lon END AS l_h_lon) FROM s3)"""


def enriched(spark, d):
    f = facts(spark, d)
    return sp.enrich(f, places(f))


@book.add("spatial_geocode_heads", f"""WITH {FACTS_SQL}, {PLACES_SQL} SELECT fact_id, r, CASE WHEN p.name IS NOT NULL THEN p.lat ELSE l_h_lat END AS l_h_lat, CASE WHEN p.name IS NOT NULL THEN p.lon ELSE l_h_lon END AS l_h_lon, l_t_lat, l_t_lon
    FROM facts LEFT JOIN places p ON trim(h_label) = p.name AND l_h_lat IS NULL""")
def _(spark, d):
    f = facts(spark, d)
    return sp.geocode(f, "h_label", "h", places(f)).select(*_COLS)


@book.add("spatial_geocode_tails", f"""WITH {FACTS_SQL}, {PLACES_SQL} SELECT fact_id, r, l_h_lat, l_h_lon, CASE WHEN p.name IS NOT NULL THEN p.lat ELSE l_t_lat END AS l_t_lat, CASE WHEN p.name IS NOT NULL THEN p.lon ELSE l_t_lon END AS l_t_lon
    FROM facts LEFT JOIN places p ON trim(t_label) = p.name AND l_t_lat IS NULL""")
def _(spark, d):
    f = facts(spark, d)
    return sp.geocode(f, "t_label", "t", places(f)).select(*_COLS)


@book.add("spatial_enrich", f"WITH {ENRICH_SQL} SELECT fact_id, r, l_h_lat, l_h_lon, l_t_lat, l_t_lon FROM enriched")
def _(spark, d):
    return enriched(spark, d).select(*_COLS)


@book.add("spatial_validate", f"""WITH {EVENTS_SQL} SELECT fact_id, {IN_BOX.format(a='l_h_lat', b='l_h_lon')} AS h_in_vn, {IN_BOX.format(a='l_t_lat', b='l_t_lon')} AS t_in_vn FROM ev""")
def _(spark, d):
    return events(spark, d).select("fact_id", sp.in_box(F.col("l_h_lat"), F.col("l_h_lon")).alias("h_in_vn"), sp.in_box(F.col("l_t_lat"), F.col("l_t_lon")).alias("t_in_vn"))


@book.add("spatial_coverage_by_relation", f"WITH {ENRICH_SQL} SELECT r, count(*) AS n, round(avg(CASE WHEN l_h_lat IS NOT NULL THEN 1 ELSE 0 END), 6) AS cov_h, round(avg(CASE WHEN l_t_lat IS NOT NULL THEN 1 ELSE 0 END), 6) AS cov_t FROM enriched GROUP BY r")
def _(spark, d):
    return sp.coverage(enriched(spark, d), "r")


@book.add("spatial_coverage_delta", f"""WITH {ENRICH_SQL}, b AS (SELECT avg(CASE WHEN l_h_lat IS NOT NULL THEN 1 ELSE 0 END) AS h, avg(CASE WHEN l_t_lat IS NOT NULL THEN 1 ELSE 0 END) AS t FROM facts),
    a AS (SELECT avg(CASE WHEN l_h_lat IS NOT NULL THEN 1 ELSE 0 END) AS h, avg(CASE WHEN l_t_lat IS NOT NULL THEN 1 ELSE 0 END) AS t, sum(CASE WHEN NOT ({IN_BOX.format(a='l_h_lat', b='l_h_lon')}) THEN 1 ELSE 0 END) AS oh, sum(CASE WHEN NOT ({IN_BOX.format(a='l_t_lat', b='l_t_lon')}) THEN 1 ELSE 0 END) AS ot FROM enriched)
    SELECT round(b.h, 6) AS before_h, round(a.h, 6) AS after_h, round(a.h - b.h, 6) AS delta_h, round(b.t, 6) AS before_t, round(a.t, 6) AS after_t, round(a.t - b.t, 6) AS delta_t, CAST(oh AS BIGINT) AS outside_h, CAST(ot AS BIGINT) AS outside_t FROM a, b""")
def _(spark, d):
    has = lambda c: F.avg(F.col(c).isNotNull().cast("int"))
    out = lambda s: F.sum((~sp.in_box(F.col(f"l_{s}_lat"), F.col(f"l_{s}_lon"))).cast("int"))
    b = facts(spark, d).agg(has("l_h_lat").alias("bh"), has("l_t_lat").alias("bt"))
    a = enriched(spark, d).agg(has("l_h_lat").alias("ah"), has("l_t_lat").alias("at"), out("h").alias("outside_h"), out("t").alias("outside_t"))
    r = lambda c: F.round(c, 6)
    return a.join(F.broadcast(b), how="inner").select(r("bh").alias("before_h"), r("ah").alias("after_h"), r(F.col("ah") - F.col("bh")).alias("delta_h"), r("bt").alias("before_t"), r("at").alias("after_t"), r(F.col("at") - F.col("bt")).alias("delta_t"), "outside_h", "outside_t")


@book.add("spatial_gate", f"""WITH {ENRICH_SQL}, g AS (SELECT avg(CASE WHEN l_h_lat IS NOT NULL THEN 1 ELSE 0 END) > 0.8 AS a, avg(CASE WHEN l_t_lat IS NOT NULL THEN 1 ELSE 0 END) > 0.9 AS b,
      avg(CASE WHEN l_h_lat IS NOT NULL THEN CASE WHEN {IN_BOX.format(a='l_h_lat', b='l_h_lon')} THEN 1 ELSE 0 END END) > 0.85 AS c, avg(CASE WHEN l_t_lat IS NOT NULL THEN CASE WHEN {IN_BOX.format(a='l_t_lat', b='l_t_lon')} THEN 1 ELSE 0 END END) > 0.85 AS d FROM enriched)
    SELECT a AND b AND c AND d AS passed, concat_ws('; ', CASE WHEN NOT a THEN 'coverage_h' END, CASE WHEN NOT b THEN 'coverage_t' END, CASE WHEN NOT c THEN 'box_h' END, CASE WHEN NOT d THEN 'box_t' END) AS failed FROM g""")
def _(spark, d):
    has = lambda c: F.avg(F.col(c).isNotNull().cast("int"))
    box = lambda s: F.avg(F.when(F.col(f"l_{s}_lat").isNotNull(), sp.in_box(F.col(f"l_{s}_lat"), F.col(f"l_{s}_lon")).cast("int")))
    return sp.gate(enriched(spark, d), {"coverage_h": has("l_h_lat") > 0.8, "coverage_t": has("l_t_lat") > 0.9, "box_h": box("h") > 0.85, "box_t": box("t") > 0.85})


@book.add("spatial_lookup_chain", f"""WITH {FACTS_SQL}, names AS (SELECT DISTINCT trim(t_label) AS name FROM facts WHERE trim(t_label) <> ''),
    cache AS (SELECT name, CASE WHEN length(name) % 3 = 0 THEN NULL ELSE CAST(length(name) AS DOUBLE) END AS lat, 105.0 AS lon FROM names WHERE length(name) % 2 = 0),
    r1 AS (SELECT name, 10.0 AS lat, 106.0 AS lon FROM names WHERE length(name) % 5 = 0), r2 AS (SELECT name, 11.0 AS lat, 107.0 AS lon FROM names WHERE length(name) % 7 = 0)
    SELECT n.name, CASE WHEN c.name IS NOT NULL THEN c.lat ELSE coalesce(r1.lat, r2.lat) END AS lat, CASE WHEN c.name IS NOT NULL THEN c.lon WHEN r1.lat IS NOT NULL THEN r1.lon ELSE r2.lon END AS lon,
      CASE WHEN c.name IS NOT NULL AND c.lat IS NOT NULL THEN 'cache' WHEN c.name IS NOT NULL THEN 'miss' WHEN r1.lat IS NOT NULL THEN 'resolver1' WHEN r2.lat IS NOT NULL THEN 'resolver2' ELSE 'miss' END AS origin
    FROM names n LEFT JOIN cache c USING (name) LEFT JOIN r1 USING (name) LEFT JOIN r2 USING (name)""")
def _(spark, d):
    names = facts(spark, d).where("trim(t_label) <> ''").select(F.trim("t_label").alias("name")).distinct()
    cache = names.where("length(name) % 2 = 0").selectExpr("name", "case when length(name) % 3 = 0 then null else cast(length(name) as double) end as lat", "cast(105.0 as double) as lon")
    r1 = names.where("length(name) % 5 = 0").selectExpr("name", "cast(10.0 as double) as lat", "cast(106.0 as double) as lon")
    r2 = names.where("length(name) % 7 = 0").selectExpr("name", "cast(11.0 as double) as lat", "cast(107.0 as double) as lon")
    return sp.lookup_chain(names, cache, r1, r2)


@book.add("spatial_province_join", "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a!r}, {b!r})" for k, (a, b) in sp.PROVINCES.items()) + ") v(name, lat, lon)) SELECT CAST(row_id AS BIGINT) AS row_id, CAST(p.lat AS DOUBLE) AS lat, CAST(p.lon AS DOUBLE) AS lon FROM historical_events LEFT JOIN p ON trim(t_label) = p.name")
def _(spark, d):
    e = table(spark, d, "historical_events")
    p = sp.province_table(spark)
    return e.join(F.broadcast(p), F.trim("t_label") == F.col("name"), "left").select("row_id", "lat", "lon")


@book.add("spatial_complete_rows", f"WITH {EVENTS_SQL} SELECT fact_id, h_label, t_label FROM ev WHERE l_h_lat IS NOT NULL AND l_h_lon IS NOT NULL AND l_t_lat IS NOT NULL AND l_t_lon IS NOT NULL ORDER BY fact_id LIMIT 5")
def _(spark, d):
    return events(spark, d).dropna(subset=["l_h_lat", "l_h_lon", "l_t_lat", "l_t_lon"]).orderBy("fact_id").limit(5).select("fact_id", "h_label", "t_label")
