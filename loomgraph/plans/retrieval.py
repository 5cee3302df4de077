"""Queries on retrieval and ranking. Queries are every fiftieth vector, against all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import vectors as V
from loomgraph.operators import retrieval as rt
from loomgraph.plans.base import FACTS_SQL, Book, facts
from loomgraph.session import table

book = Book()
DIM = 8
_SALT = {n: sum(map(ord, n)) for n in ("E_x", "E_y", "E_t", "RE")}


def _tab(alias, name, rows):
    return f"{alias} AS (SELECT CAST(i AS INTEGER) AS id, list_transform(range({DIM}), lambda j: CAST(((i + 1) * (j + 3) * 7919 + {_SALT[name] * 31}) % 2001 - 1000 AS DOUBLE) / 1000) AS vec FROM (SELECT unnest(range({rows})) AS i))"


def _bin(v, lo, hi, n):
    return f"CAST(least(floor((greatest(least(CAST({v} AS DOUBLE), {hi}::DOUBLE), {lo}::DOUBLE) - {lo}::DOUBLE) / ({hi}::DOUBLE - {lo}::DOUBLE + 1e-12::DOUBLE) * {n}), {n - 1}) AS INTEGER)"


IMP_SQL = f"""{FACTS_SQL}, imp AS (SELECT fact_id, h, r, t, coalesce(l_h_lat, 14.0583::DOUBLE) AS hlat, coalesce(l_h_lon, 108.2772::DOUBLE) AS hlon, coalesce(l_t_lat, 14.0583::DOUBLE) AS tlat, coalesce(l_t_lon, 108.2772::DOUBLE) AS tlon, coalesce(CAST(tau_start AS DOUBLE), 2000.0::DOUBLE) AS tau FROM facts),
    cel AS (SELECT *, {_bin('hlat', 8.0, 23.5, 64)} AS hx, {_bin('hlon', 102.0, 110.0, 64)} AS hy, {_bin('tlat', 8.0, 23.5, 64)} AS tx, {_bin('tlon', 102.0, 110.0, 64)} AS ty, {_bin('tau', 800, 2025, 100)} AS it, CASE r WHEN 'bornIn' THEN 0 WHEN 'diedIn' THEN 1 WHEN 'occurredAt' THEN 2 WHEN 'locatedIn' THEN 3 END AS rid FROM imp)"""
_ADD = "list_transform(range(1, {n} + 1), lambda k: {e})".replace("{n}", str(DIM))
VEC_SQL = f"""{IMP_SQL}, {_tab('ex', 'E_x', 64)}, {_tab('ey', 'E_y', 64)}, {_tab('et', 'E_t', 100)}, {_tab('re', 'RE', 4)},
    ste AS (SELECT fact_id, {_ADD.replace('{e}', 'a.vec[k] + b.vec[k] + c.vec[k]')} AS sh, {_ADD.replace('{e}', 'd.vec[k] + e.vec[k] + c.vec[k]')} AS st, re.vec AS rv FROM cel JOIN ex a ON hx = a.id JOIN ey b ON hy = b.id JOIN et c ON it = c.id JOIN ex d ON tx = d.id JOIN ey e ON ty = e.id JOIN re ON rid = re.id),
    sc AS (SELECT fact_id, sqrt(list_sum({_ADD.replace('{e}', '(sh[k] + rv[k] - st[k]) * (sh[k] + rv[k] - st[k])')})) AS s, {_ADD.replace('{e}', '(sh[k] + rv[k] + st[k]) / 3')} AS g FROM ste)"""


def imputed(spark, d):
    f = facts(spark, d)
    return rt.impute(rt.impute(f, "l_h_lat", "l_h_lon", "tau_start"), "l_t_lat", "l_t_lon")


def embedded(spark, d):
    t = {"x": rt.parameter_table(spark, "E_x", 64, DIM), "y": rt.parameter_table(spark, "E_y", 64, DIM), "t": rt.parameter_table(spark, "E_t", 100, DIM)}
    f = rt.embed(rt.embed(imputed(spark, d), t, "l_h_lat", "l_h_lon", "tau_start", "sh"), t, "l_t_lat", "l_t_lon", "tau_start", "st")
    re = rt.parameter_table(spark, "RE", 4, DIM).select(F.col("id").alias("rid"), F.col("vec").alias("rv"))
    return f.withColumn("rid", rt.relation_id(F.col("r"))).join(F.broadcast(re), "rid").select("fact_id", rt.plausibility(F.col("sh"), F.col("rv"), F.col("st")).alias("s"), rt.fact_vector(F.col("sh"), F.col("rv"), F.col("st")).alias("g"))


@book.add("embed_impute", f"WITH {IMP_SQL} SELECT fact_id, hlat, hlon, tlat, tlon, tau FROM imp")
def _(spark, d):
    return imputed(spark, d).select("fact_id", F.col("l_h_lat").alias("hlat"), F.col("l_h_lon").alias("hlon"), F.col("l_t_lat").alias("tlat"), F.col("l_t_lon").alias("tlon"), F.col("tau_start").alias("tau"))


@book.add("embed_cells", f"WITH {IMP_SQL} SELECT fact_id, hx, hy, tx, ty, it FROM cel")
def _(spark, d):
    f = imputed(spark, d)
    hx, hy, it = rt.cells(F.col("l_h_lat"), F.col("l_h_lon"), F.col("tau_start"))
    tx, ty, _it = rt.cells(F.col("l_t_lat"), F.col("l_t_lon"), F.col("tau_start"))
    return f.select("fact_id", hx.alias("hx"), hy.alias("hy"), tx.alias("tx"), ty.alias("ty"), it.alias("it"))


@book.add("embed_plausibility", f"WITH {VEC_SQL} SELECT fact_id, round(s, 6) AS s FROM sc")
def _(spark, d):
    return embedded(spark, d).select("fact_id", F.round("s", 6).alias("s"))


@book.add("embed_fact_vectors", f"WITH {VEC_SQL} SELECT fact_id, round(g[1], 6) AS g1, round(g[{DIM}], 6) AS g8, round(list_sum(g), 6) AS total FROM sc")
def _(spark, d):
    e = embedded(spark, d)
    return e.select("fact_id", F.round(F.element_at("g", 1), 6).alias("g1"), F.round(F.element_at("g", DIM), 6).alias("g8"), F.round(F.aggregate("g", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@book.add("embed_universe_first", f"""WITH {FACTS_SQL}, e AS (SELECT fact_id, 0 AS side, h AS entity, l_h_lat AS lat, l_h_lon AS lon, tau_start FROM facts UNION ALL SELECT fact_id, 1, t, l_t_lat, l_t_lon, tau_start FROM facts)
    SELECT entity, coalesce(lat, 14.0583::DOUBLE) AS lat, coalesce(lon, 108.2772::DOUBLE) AS lon, coalesce(CAST(tau_start AS DOUBLE), 2000.0::DOUBLE) AS tau FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY fact_id, side) AS rn FROM e WHERE entity IS NOT NULL) WHERE rn = 1""")
def _(spark, d):
    return rt.entity_universe(facts(spark, d).withColumn("ord", F.col("fact_id")))


@book.add("embed_universe_last", f"""WITH {FACTS_SQL}, e AS (SELECT fact_id, 0 AS side, h AS entity, l_h_lat AS lat, l_h_lon AS lon, tau_start FROM facts UNION ALL SELECT fact_id, 1, t, l_t_lat, l_t_lon, tau_start FROM facts)
    SELECT entity, coalesce(lat, 14.0583::DOUBLE) AS lat, coalesce(lon, 108.2772::DOUBLE) AS lon, coalesce(CAST(tau_start AS DOUBLE), 2000.0::DOUBLE) AS tau FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY fact_id DESC, side DESC) AS rn FROM e WHERE entity IS NOT NULL) WHERE rn = 1""")
def _(spark, d):
    return rt.entity_universe(facts(spark, d).withColumn("ord", F.col("fact_id")), last=True)


@book.add("rank_answer_in_universe", f"WITH {FACTS_SQL} SELECT qid FROM questions WHERE answer_entity IN (SELECT h FROM facts WHERE h IS NOT NULL UNION SELECT t FROM facts WHERE t IS NOT NULL)")
def _(spark, d):
    u = rt.entity_universe(facts(spark, d).withColumn("ord", F.col("fact_id"))).select(F.col("entity").alias("answer_entity"))
    return table(spark, d, "questions").join(u, "answer_entity", "left_semi").select("qid")


# retrieval over the stored vectors: queries are the vectors whose id is divisible by 50
_V = "CAST(embedding AS DOUBLE[])"
PAIR_SQL = f"""v AS (SELECT vec_id, label, {_V} AS vec FROM embeddings), q AS (SELECT vec_id AS qid, label AS ql, vec AS qv FROM v WHERE vec_id % 50 = 0),
    pr AS (SELECT qid, ql, vec_id, label, list_dot_product(qv, vec) AS dp, list_dot_product(qv, vec) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(vec, vec))) AS cos, sqrt(greatest(list_dot_product(qv, qv) + list_dot_product(vec, vec) - 2 * list_dot_product(qv, vec), 0)) AS s FROM q, v WHERE qid <> vec_id)"""


def pairs(spark, d):
    """The stated query set (every fiftieth vector) against all vectors."""
    v = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec")).withColumn("vv", V.dot(F.col("vec"), F.col("vec")))
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("ql"), F.col("vec").alias("qv"), F.col("vv").alias("qq"))
    j = rt.against_all(v, q, "vec_id").where("qid <> vec_id").withColumn("dp", V.dot(F.col("qv"), F.col("vec")))
    return j.select("qid", "ql", "vec_id", "label", "dp", (F.col("dp") / (F.sqrt("qq") * F.sqrt("vv"))).alias("cos"), F.sqrt(F.greatest(F.col("qq") + F.col("vv") - 2 * F.col("dp"), F.lit(0.0))).alias("s"))


@book.add("retrieve_cosine", f"WITH {PAIR_SQL} SELECT qid, vec_id, round(cos, 6) AS cos FROM pr")
def _(spark, d):
    return pairs(spark, d).select("qid", "vec_id", F.round("cos", 6).alias("cos"))


REL_SQL = f"{PAIR_SQL}, rl AS (SELECT *, 0.5 * cos - 0.5 * (s - min(s) OVER (PARTITION BY qid)) / greatest(max(s) OVER (PARTITION BY qid) - min(s) OVER (PARTITION BY qid), 1e-12) AS rel FROM pr), tk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rel, 9) DESC, vec_id) AS rk FROM rl)"


def top(spark, d, k=32):
    r = rt.relevance(pairs(spark, d), 0.5, ["qid"]).withColumn("relr", F.round("rel", 9))
    return rt.top_k(r, ["qid"], "relr", "vec_id", k)


@book.add("retrieve_relevance", f"WITH {REL_SQL} SELECT qid, vec_id, round(rel, 6) AS rel FROM rl")
def _(spark, d):
    return rt.relevance(pairs(spark, d), 0.5, ["qid"]).select("qid", "vec_id", F.round("rel", 6).alias("rel"))


@book.add("retrieve_top_k", f"WITH {REL_SQL} SELECT qid, vec_id, CAST(rk AS INTEGER) AS rk FROM tk WHERE rk <= 32")
def _(spark, d):
    return top(spark, d).select("qid", "vec_id", "rk")


@book.add("retrieve_weights", f"WITH {REL_SQL}, t AS (SELECT * FROM tk WHERE rk <= 32) SELECT qid, vec_id, round(exp(rel - max(rel) OVER (PARTITION BY qid)) / sum(exp(rel)) OVER (PARTITION BY qid) * exp(max(rel) OVER (PARTITION BY qid)), 6) AS w FROM t")
def _(spark, d):
    return rt.softmax(top(spark, d), "rel", ["qid"], "w").select("qid", "vec_id", F.round("w", 6).alias("w"))


@book.add("retrieve_weighted_sum", f"""WITH {REL_SQL}, t AS (SELECT * FROM tk WHERE rk <= 32), w AS (SELECT qid, vec_id, exp(rel) / sum(exp(rel)) OVER (PARTITION BY qid) AS w FROM t), x AS (SELECT qid, unnest(range(1, 65)) AS k, w, vec FROM w JOIN v USING (vec_id))
    SELECT qid, CAST(k - 1 AS INTEGER) AS pos, round(sum(w * vec[k]), 6) AS x FROM x GROUP BY qid, k""")
def _(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    w = rt.softmax(top(spark, d), "rel", ["qid"], "w").select("qid", "vec_id", "w")
    x = w.join(v, "vec_id").select("qid", "w", F.posexplode("vec").alias("pos", "e"))
    return x.groupBy("qid", "pos").agg(F.round(F.sum(F.col("w") * F.col("e")), 6).alias("x"))


@book.add("rank_softmax", f"WITH {PAIR_SQL} SELECT qid, vec_id, round(exp(dp - max(dp) OVER (PARTITION BY qid)) / sum(exp(dp)) OVER (PARTITION BY qid) * exp(max(dp) OVER (PARTITION BY qid)), 6) AS p FROM pr")
def _(spark, d):
    return rt.softmax(pairs(spark, d), "dp", ["qid"], "p").select("qid", "vec_id", F.round("p", 6).alias("p"))


#: The target of a query is the smallest other vector of its label.
RANK_SQL = f"""{PAIR_SQL}, tg AS (SELECT qid, min(vec_id) AS target FROM pr WHERE label = ql GROUP BY qid), rk AS (SELECT qid, target, 1 + count(*) FILTER (round(pr.cos, 9) > g.c OR (round(pr.cos, 9) = g.c AND pr.vec_id < target)) AS rank FROM pr JOIN (SELECT pr.qid AS gq, target, round(cos, 9) AS c FROM pr JOIN tg ON pr.qid = tg.qid AND vec_id = target) g ON qid = gq GROUP BY qid, target)"""


def ranks(spark, d):
    p = pairs(spark, d).withColumn("c", F.round("cos", 9))
    target = p.where("label = ql").groupBy("qid").agg(F.min("vec_id").alias("target"))
    return rt.target_rank(p.join(target, "qid"), ["qid", "target"], "c", "vec_id", "target")


@book.add("rank_targets", f"WITH {RANK_SQL} SELECT qid, target, rank FROM rk")
def _(spark, d):
    return ranks(spark, d)


@book.add("rank_errors", f"""WITH {RANK_SQL}, t5 AS (SELECT qid, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY r) AS top5 FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 9) DESC, vec_id) AS r FROM pr) WHERE r <= 5 GROUP BY qid)
    SELECT qid, rank, top5 FROM rk JOIN t5 USING (qid) WHERE rank > 1 ORDER BY qid LIMIT 100""")
def _(spark, d):
    p = pairs(spark, d).withColumn("c", F.round("cos", 9))
    t5 = rt.top_k(p, ["qid"], "c", "vec_id", 5).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "vec_id"))), lambda x: x["vec_id"].cast("string")), ",").alias("top5"))
    return ranks(spark, d).where("rank > 1").join(t5, "qid").orderBy("qid").limit(100).select("qid", "rank", "top5")


@book.add("rank_metrics", f"WITH {RANK_SQL} SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 4) AS hit1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 4) AS hit3, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 4) AS hit10, round(avg(1.0 / rank), 4) AS mrr FROM rk")
def _(spark, d):
    from loomgraph.operators.metrics import hits

    return hits(ranks(spark, d), "rank")


@book.add("rank_block_top", f"WITH {PAIR_SQL}, a AS (SELECT q.qid, v.vec_id AS entity, round(list_dot_product(qv, vec), 9) AS score FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, entity) AS rk FROM a) SELECT qid, entity, round(score, 6) AS score, CAST(rk AS INTEGER) AS rk FROM r WHERE rk <= 10")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("entity"), F.col("embedding").cast("array<double>").alias("vec"))
    q = v.where("entity % 50 = 0").withColumnRenamed("entity", "qid")
    return rt.score_all(q, v, 10).select("qid", "entity", F.round("score", 6).alias("score"), "rk")


@book.add("rank_projected", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings) SELECT vec_id, round(list_dot_product(list_transform(range(64), lambda k: CAST((k * 7) % 11 - 5 AS DOUBLE) / 10), vec), 6) AS u0, round(list_dot_product(list_transform(range(64), lambda k: CAST((k * 5) % 13 - 6 AS DOUBLE) / 10), vec), 6) AS u1 FROM v")
def _(spark, d):
    row = lambda a, m, o: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (F.pmod(k * a, F.lit(m)) - o).cast("double") / 10)
    m = F.array(row(7, 11, 5), row(5, 13, 6))
    v = table(spark, d, "embeddings").select("vec_id", V.matmul(m, F.col("embedding").cast("array<double>")).alias("u"))
    return v.select("vec_id", F.round(F.col("u")[0], 6).alias("u0"), F.round(F.col("u")[1], 6).alias("u1"))


@book.add("similarity_scaled", f"WITH {PAIR_SQL} SELECT qid, vec_id, round(least(greatest((cos + 1) / 2, 0), 1), 6) AS sim FROM pr")
def _(spark, d):
    return pairs(spark, d).select("qid", "vec_id", F.round(F.least(F.greatest((F.col("cos") + 1) / 2, F.lit(0.0)), F.lit(1.0)), 6).alias("sim"))
