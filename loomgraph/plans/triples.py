"""Queries on graph patterns; the triple table is made of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import triples as tr
from loomgraph.plans.base import Book
from loomgraph.session import table

book = Book()
#: The same text runs in both engines over historical_events.
TRIPLES = """SELECT DISTINCT s, p, o FROM (
    SELECT h AS s, 'P31' AS p, 'T' || CAST(CAST(substring(h, 2) AS BIGINT) % 6 AS {s}) AS o FROM {e} WHERE {m}(h, '^Q[0-9]+$')
    UNION ALL SELECT h, 'label_vi', h_label FROM {e} WHERE {m}(h, '^Q[0-9]+$') AND CAST(substring(h, 2) AS BIGINT) % 3 <> 0
    UNION ALL SELECT h, 'label_en', 'E' || h FROM {e} WHERE {m}(h, '^Q[0-9]+$') AND CAST(substring(h, 2) AS BIGINT) % 2 = 0
    UNION ALL SELECT h, 'P585', CAST(tau_start AS {s}) || '-01-01T00:00:00Z' FROM {e} WHERE {m}(h, '^Q[0-9]+$') AND tau_start IS NOT NULL AND CAST(substring(h, 2) AS BIGINT) % 4 <> 0
    UNION ALL SELECT h, 'P580', CAST(tau_start + 1 AS {s}) || '-01-01T00:00:00Z' FROM {e} WHERE {m}(h, '^Q[0-9]+$') AND tau_start IS NOT NULL
    UNION ALL SELECT h, 'P276', t FROM {e} WHERE {m}(h, '^Q[0-9]+$')
    UNION ALL SELECT t, 'label_vi', t_label FROM {e} WHERE t_label IS NOT NULL
    UNION ALL SELECT t, 'P625', 'st_' || t FROM {e} WHERE l_t_lat IS NOT NULL AND l_t_lon IS NOT NULL
    UNION ALL SELECT 'st_' || t, 'lat', CAST(floor(l_t_lat) AS {s}) FROM {e} WHERE l_t_lat IS NOT NULL AND l_t_lon IS NOT NULL
    UNION ALL SELECT 'st_' || t, 'lon', CAST(floor(l_t_lon) AS {s}) FROM {e} WHERE l_t_lat IS NOT NULL AND l_t_lon IS NOT NULL
    UNION ALL SELECT 'T1', 'P279', 'T0' FROM {e} UNION ALL SELECT 'T2', 'P279', 'T1' FROM {e} UNION ALL SELECT 'T0', 'P279', 'T2' FROM {e} UNION ALL SELECT 'T4', 'P279', 'T3' FROM {e} UNION ALL SELECT 'T5', 'P279', 'T1' FROM {e})"""
T_SQL = "tri AS (" + TRIPLES.replace("{e}", "historical_events").replace("{s}", "VARCHAR").replace("{m}", "regexp_matches") + ")"
LAB_SQL = "vi AS (SELECT s, min(o) AS vi FROM tri WHERE p = 'label_vi' GROUP BY s), en AS (SELECT s, min(o) AS en FROM tri WHERE p = 'label_en' GROUP BY s), lab AS (SELECT coalesce(vi.s, en.s) AS s, coalesce(vi, en) AS label FROM vi FULL JOIN en ON vi.s = en.s)"
XY_SQL = "xy AS (SELECT a.s, CAST(b.o AS DOUBLE) AS lat, CAST(c.o AS DOUBLE) AS lon FROM tri a JOIN tri b ON a.o = b.s AND b.p = 'lat' JOIN tri c ON a.o = c.s AND c.p = 'lon' WHERE a.p = 'P625')"


def triples(spark, d):
    e = table(spark, d, "historical_events")
    return spark.sql(TRIPLES.replace("{s}", "STRING").replace("{m}", "regexp_like"), e=e)


@book.add("triples_labels", f"WITH {T_SQL}, {LAB_SQL} SELECT s, label FROM lab WHERE label IS NOT NULL")
def _(spark, d):
    return tr.labels(triples(spark, d))


@book.add("triples_coordinates", f"WITH {T_SQL}, {XY_SQL} SELECT * FROM xy")
def _(spark, d):
    return tr.coordinates(triples(spark, d))


@book.add("triples_events", f"""WITH {T_SQL}, {LAB_SQL}, {XY_SQL}, d0 AS (SELECT s, min(o) AS o FROM tri WHERE p = 'P585' GROUP BY s), d1 AS (SELECT s, min(o) AS o FROM tri WHERE p = 'P580' GROUP BY s)
    SELECT DISTINCT b.s AS h, l.label AS h_label, 'occurredAt' AS r, b.o AS t, m.label AS t_label, coalesce(TRY_CAST(regexp_extract(d0.o, '^([+-]?[0-9]+)-', 1) AS INTEGER), TRY_CAST(regexp_extract(d1.o, '^([+-]?[0-9]+)-', 1) AS INTEGER)) AS tau_start, x.lat AS l_h_lat, x.lon AS l_h_lon, y.lat AS l_t_lat, y.lon AS l_t_lon
    FROM tri b JOIN lab l ON b.s = l.s AND l.label IS NOT NULL LEFT JOIN lab m ON b.o = m.s LEFT JOIN xy x ON b.s = x.s LEFT JOIN xy y ON b.o = y.s LEFT JOIN d0 ON b.s = d0.s LEFT JOIN d1 ON b.s = d1.s WHERE b.p = 'P276'""")
def _(spark, d):
    return tr.relation_rows(triples(spark, d), "P276", "occurredAt", "P585", "P580")


@book.add("triples_class_closure", f"WITH RECURSIVE {T_SQL}, c(s) AS (SELECT 'T0' UNION SELECT tri.s FROM tri JOIN c ON tri.o = c.s WHERE tri.p = 'P279') SELECT s FROM c")
def _(spark, d):
    return tr.closure(triples(spark, d), "P279", "T0")


@book.add("triples_instances", f"WITH RECURSIVE {T_SQL}, {LAB_SQL}, c(s) AS (SELECT 'T0' UNION SELECT tri.s FROM tri JOIN c ON tri.o = c.s WHERE tri.p = 'P279') SELECT DISTINCT i.s AS h, label AS h_label FROM tri i JOIN c ON i.o = c.s JOIN lab ON lab.s = i.s WHERE i.p = 'P31' AND label IS NOT NULL")
def _(spark, d):
    t = triples(spark, d)
    inst = tr.objects(t, "P31", "cls").join(tr.closure(t, "P279", "T0").withColumnRenamed("s", "cls"), "cls", "left_semi")
    return inst.join(tr.labels(t), "s").select(F.col("s").alias("h"), F.col("label").alias("h_label")).distinct()


@book.add("triples_of_type", f"WITH {T_SQL} SELECT i.s, min(l.o) AS label FROM tri i JOIN tri l ON i.s = l.s AND l.p = 'label_vi' WHERE i.p = 'P31' AND i.o = 'T4' GROUP BY i.s ORDER BY i.s LIMIT 100")
def _(spark, d):
    t = triples(spark, d)
    return tr.objects(t, "P31", "cls").where("cls = 'T4'").join(tr.objects(t, "label_vi", "l"), "s").groupBy("s").agg(F.min("l").alias("label")).orderBy("s").limit(100)


@book.add("triples_types_union", f"WITH {T_SQL} SELECT DISTINCT s FROM (SELECT s FROM tri WHERE p = 'P31' AND o = 'T1' UNION ALL SELECT s FROM tri WHERE p = 'P31' AND o IN ('T2', 'T3'))")
def _(spark, d):
    return tr.objects(triples(spark, d), "P31", "o").where(F.col("o").isin("T1", "T2", "T3")).select("s").distinct()


@book.add("triples_str_after", "SELECT row_id, CASE WHEN row_id % 3 = 0 THEN '' ELSE h END AS id FROM historical_events")
def _(spark, d):
    e = table(spark, d, "historical_events").withColumn("uri", F.when(F.col("row_id") % 3 == 0, F.col("h")).otherwise(F.concat(F.lit("http://example.org/entity/"), "h")))
    return e.select("row_id", tr.str_after(F.col("uri"), "entity/").alias("id"))


@book.add("triples_years", f"WITH {T_SQL} SELECT s, TRY_CAST(regexp_extract(o, '^([+-]?[0-9]+)-', 1) AS INTEGER) AS year FROM tri WHERE p = 'P585'")
def _(spark, d):
    return tr.objects(triples(spark, d), "P585", "o").select("s", tr.year(F.col("o")).alias("year"))


@book.add("triples_star", f"WITH {T_SQL} SELECT a.s, a.o AS cls, b.o AS place, c.o AS date FROM tri a JOIN tri b ON a.s = b.s AND b.p = 'P276' JOIN tri c ON a.s = c.s AND c.p = 'P580' WHERE a.p = 'P31'")
def _(spark, d):
    t = triples(spark, d)
    return tr.objects(t, "P31", "cls").join(tr.objects(t, "P276", "place"), "s").join(tr.objects(t, "P580", "date"), "s")


@book.add("triples_point", f"WITH {T_SQL} SELECT p, count(*) AS n FROM tri WHERE s = 'Q900000000' GROUP BY p")
def _(spark, d):
    return triples(spark, d).where("s = 'Q900000000'").groupBy("p").agg(F.count("*").alias("n"))
