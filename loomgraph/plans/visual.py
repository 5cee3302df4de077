"""Queries on visual facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import visual as vi
from loomgraph.plans.base import EVENTS_SQL, FACTS_SQL, Book, events, facts
from loomgraph.session import table

book = Book()
#: Captions made of parts: the pattern follows the part key.
_CAP = "CASE p_partkey % 4 WHEN 0 THEN 'A man riding a ' || p_type || ' in town' WHEN 1 THEN 'the woman in front of a ' || p_brand WHEN 2 THEN 'dog on the ' || p_name || '.' ELSE p_type || ' plain words here too' END"
_FILE = "printf('COCO_val2014_%012d.jpg', p_partkey)"
CAP_SQL = f"cap AS (SELECT {_FILE} AS image_file, lower({_CAP}) AS c FROM part)"


def captions(spark, d):
    return table(spark, d, "part").select(vi.image_file(F.col("p_partkey")).alias("image_file"), F.expr(_CAP).alias("caption"))


def _fam(i):
    p = vi.FAMILIES[i]
    return [f"regexp_extract_all(c, '{p}', {g})" for g in (1, 2, 3)]


_F0, _F1, _F2 = _fam(0), _fam(1), _fam(2)


@book.add("visual_caption_triplets", f"""WITH {CAP_SQL}, m AS (SELECT image_file, c, CASE WHEN len({_F0[0]}) > 0 THEN {_F0[0]} WHEN len({_F1[0]}) > 0 THEN {_F1[0]} WHEN len({_F2[0]}) > 0 THEN {_F2[0]} END AS s, CASE WHEN len({_F0[0]}) > 0 THEN {_F0[1]} WHEN len({_F1[0]}) > 0 THEN {_F1[1]} WHEN len({_F2[0]}) > 0 THEN {_F2[1]} END AS p, CASE WHEN len({_F0[0]}) > 0 THEN {_F0[2]} WHEN len({_F1[0]}) > 0 THEN {_F1[2]} WHEN len({_F2[0]}) > 0 THEN {_F2[2]} END AS o, list_filter(string_split_regex(trim(c), '\\s+'), lambda x: x <> '') AS w FROM cap),
    u AS (SELECT image_file, s, p, o, unnest(range(least(len(s), 5))) AS pos FROM m WHERE s IS NOT NULL)
    SELECT image_file, CAST(pos AS INTEGER) AS pos, trim(s[pos + 1]) AS subject, trim(p[pos + 1]) AS predicate, trim(o[pos + 1]) AS object FROM u UNION ALL SELECT image_file, 0, w[1], w[2], array_to_string(w[3:5], ' ') FROM m WHERE s IS NULL AND len(w) >= 3""")
def _(spark, d):
    return vi.caption_triplets(captions(spark, d))


@book.add("visual_qa_triplets", "SELECT 'image_' || p_partkey AS subject, CASE p_size % 8 WHEN 1 THEN 'hasObject' WHEN 2 THEN 'hasColor' WHEN 3 THEN 'hasCount' WHEN 4 THEN 'isPresent' WHEN 5 THEN 'hasActivity' WHEN 6 THEN 'hasLocation' ELSE 'hasAttribute' END AS predicate, p_name AS object, " + _FILE + " AS image_file, 'ViVQA-train' AS source FROM part")
def _(spark, d):
    qa = table(spark, d, "part").selectExpr("p_partkey as img_id", "'q' as question", "p_name as answer", "cast(p_size % 8 as int) as type", "'train' as split")
    return vi.qa_triplets(qa)


@book.add("visual_image_ids", f"SELECT p_partkey, {_FILE} AS image_file, ltrim(replace(replace({_FILE}, 'COCO_val2014_', ''), '.jpg', ''), '0') AS img_id FROM part")
def _(spark, d):
    f = vi.image_file(F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", f.alias("image_file"), vi.image_id(f).alias("img_id"))


@book.add("visual_missing_images", "SELECT DISTINCT l_partkey AS img_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(spark, d):
    have = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("img_id"))
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("img_id")).distinct().join(have, "img_id", "left_anti")


INDEX_SQL = f"""{EVENTS_SQL}, e AS (SELECT fact_id, 0 AS side, h_label AS label, l_h_lat AS lat, l_h_lon AS lon FROM ev UNION ALL SELECT fact_id, 1, t_label, l_t_lat, l_t_lon FROM ev), k AS (SELECT *, lower(trim(label)) AS key FROM e WHERE label IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL),
    idx AS (SELECT a.key, a.lat, a.lon, b.fact_id AS pf, b.side AS ps FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY fact_id DESC, side DESC) AS rn FROM k) a JOIN (SELECT key, fact_id, side, row_number() OVER (PARTITION BY key ORDER BY fact_id, side) AS rn FROM k) b ON a.key = b.key AND a.rn = 1 AND b.rn = 1)"""


@book.add("visual_label_index", f"WITH {INDEX_SQL} SELECT key, lat, lon, pf AS first_fact, ps AS first_side FROM idx")
def _(spark, d):
    return vi.label_index(events(spark, d)).select("key", "lat", "lon", F.col("pos.fact_id").alias("first_fact"), F.col("pos.side").alias("first_side"))


#: Entities: labels of facts cut or extended, so that exact, contained, containing and missing ones occur.
_ENT = "CASE length(h_label) % 4 WHEN 0 THEN h_label WHEN 1 THEN substring(h_label, 5, 9) WHEN 2 THEN h_label || ' xyz' ELSE 'zz' || substring(h_label, 1, 3) END"


@book.add("visual_resolve_place", f"""WITH {INDEX_SQL}, en AS (SELECT DISTINCT {_ENT} AS entity FROM ev WHERE h_label IS NOT NULL), x AS (SELECT entity, lower(trim(entity)) AS key FROM en), ex AS (SELECT x.*, i.lat, i.lon, i.key IS NOT NULL AS hit FROM x LEFT JOIN idx i ON x.key = i.key),
    nr AS (SELECT entity, lat, lon FROM (SELECT ex.entity, i.lat, i.lon, row_number() OVER (PARTITION BY ex.entity ORDER BY i.pf, i.ps) AS rn FROM ex JOIN idx i ON NOT hit AND (contains(i.key, ex.key) OR contains(ex.key, i.key))) WHERE rn = 1)
    SELECT ex.entity, coalesce(ex.lat, nr.lat, 14.0583) AS lat, coalesce(ex.lon, nr.lon, 108.2772) AS lon, CASE WHEN hit THEN 'exact' WHEN nr.entity IS NOT NULL THEN 'contains' ELSE 'default' END AS how FROM ex LEFT JOIN nr ON ex.entity = nr.entity""")
def _(spark, d):
    e = events(spark, d)
    return vi.resolve(e.where("h_label is not null").select(F.expr(_ENT).alias("entity")), vi.label_index(e))


SIM_SQL = "sims AS (SELECT p_partkey AS img, CASE p_partkey % 5 WHEN 0 THEN 'bornIn' WHEN 1 THEN 'locatedIn' WHEN 2 THEN 'occurredAt' ELSE 'other' END AS relation, 'c' || (k % 5) AS concept, k % 5 AS ord, CAST((p_partkey * 31 + k * 17) % 101 - 20 AS DOUBLE) / 100 AS score FROM part, (SELECT unnest(range(10)) AS k))"


@book.add("visual_concepts", f"""WITH {SIM_SQL}, b AS (SELECT img, relation, concept, ord, greatest(max(score), 0.0) AS score FROM sims GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, ord) AS rk FROM b WHERE score >= 0.2)
    SELECT img, CAST(rk AS INTEGER) AS rk, CASE relation WHEN 'bornIn' THEN 'depicts_birthplace_of' WHEN 'locatedIn' THEN 'depicts_location_of' WHEN 'occurredAt' THEN 'depicts_event_at' ELSE 'depicts' END AS predicate, concept AS object, round(score, 4) AS confidence FROM r WHERE rk <= 3""")
def _(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey as img", "case p_partkey % 5 when 0 then 'bornIn' when 1 then 'locatedIn' when 2 then 'occurredAt' else 'other' end as relation", "explode(sequence(0, 9)) as k")
    s = p.selectExpr("img", "relation", "concat('c', k % 5) as concept", "cast(k % 5 as int) as concept_ord", "cast(pmod(img * 31 + k * 17, 101) - 20 as double) / 100 as score")
    return vi.concept_triplets(s)


@book.add("visual_triplet_json", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '[]' ELSE '[{\"subject\":\"' || p_brand || '\",\"object\":\"' || p_type || '\"}]' END AS j FROM part")
def _(spark, d):
    from loomgraph.operators.merge import triple_json

    arr = F.when(F.col("p_partkey") % 3 != 0, F.array(F.struct(F.col("p_brand").alias("subject"), F.col("p_type").alias("object"))))
    return table(spark, d, "part").select("p_partkey", triple_json(arr).alias("j"))


@book.add("visual_image_url", "SELECT p_partkey, 'https://commons.wikimedia.org/wiki/Special:FilePath/' || replace(url_encode(replace(p_name || ' (x)/a', ' ', '_')), '%2F', '/') || '?width=400' AS url FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", vi.image_url(F.concat("p_name", F.lit(" (x)/a"))).alias("url"))


@book.add("visual_union", f"""WITH {FACTS_SQL}, v AS (SELECT p_partkey AS fact_id, 'img_' || p_partkey AS h, 'hasObject' AS r, p_type AS t, 2014 AS tau_start FROM part UNION ALL SELECT p_partkey, 'img_' || p_partkey, 'hasObject', p_type, 2014 FROM part WHERE p_partkey % 2 = 0), u AS (SELECT 0 AS rk, fact_id, h, r, t, tau_start FROM facts UNION ALL SELECT 1, * FROM v)
    SELECT rk AS source_rank, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY h, r, t, tau_start ORDER BY rk, fact_id) AS rn FROM u) WHERE rn = 1 GROUP BY rk""")
def _(spark, d):
    from loomgraph.operators.merge import merge_sources

    p = table(spark, d, "part")
    v = p.selectExpr("p_partkey as fact_id", "concat('img_', p_partkey) as h", "'hasObject' as r", "p_type as t", "2014 as tau_start")
    v = v.union(v.where("fact_id % 2 = 0"))
    return merge_sources(facts(spark, d).select("fact_id", "h", "r", "t", "tau_start"), v).groupBy("source_rank").agg(F.count("*").alias("n"))


@book.add("visual_to_collect", f"""WITH {EVENTS_SQL}, c AS (SELECT h, min(h_label) AS label FROM ev WHERE regexp_matches(h, '^Q[0-9]+$') GROUP BY h), cached AS (SELECT h FROM c WHERE length(label) % 3 = 0), local AS (SELECT h FROM c WHERE length(label) % 5 = 0)
    SELECT h, label FROM c WHERE h NOT IN (SELECT h FROM cached) AND h NOT IN (SELECT h FROM local)""")
def _(spark, d):
    c = events(spark, d).where(F.col("h").rlike("^Q[0-9]+$")).groupBy("h").agg(F.min("h_label").alias("label"))
    cached, local = c.where("length(label) % 3 = 0").select("h"), c.where("length(label) % 5 = 0").select("h")
    return c.join(cached, "h", "left_anti").join(local, "h", "left_anti")


@book.add("visual_collect_coverage", f"""WITH {EVENTS_SQL}, c AS (SELECT h, min(h_label) AS label FROM ev GROUP BY h) SELECT count(*) AS n, CAST(sum(CASE WHEN length(label) % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_url, round(100.0 * sum(CASE WHEN length(label) % 3 = 0 THEN 1 ELSE 0 END) / count(*), 2) AS pct FROM c""")
def _(spark, d):
    c = events(spark, d).groupBy("h").agg(F.min("h_label").alias("label"))
    k = F.sum(F.coalesce(F.length("label") % 3 == 0, F.lit(False)).cast("int"))
    return c.agg(F.count("*").alias("n"), k.alias("with_url"), F.round(100.0 * k / F.count("*"), 2).alias("pct"))
