"""Queries on encoders, the question pass, stored parameters, training and images."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.operators import audit as au
from loomgraph.operators import retrieval as rt
from loomgraph.operators import splits as sp
from loomgraph.operators import training as tn
from loomgraph.operators.metrics import hits
from loomgraph.plans.audit import FLAG_SQL
from loomgraph.plans.base import Book, facts
from loomgraph.plans.retrieval import DIM, VEC_SQL, _bin, _tab
from loomgraph.session import cut, ensure_checkpoint_dir, table
from loomgraph.sources import files, images

book = Book()


def _shared(spark) -> str:
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"model-{uuid.uuid4().hex}")


def _stub(key: str, salt: int = 0) -> str:
    return f"list_transform(range({DIM}), lambda j: CAST(((('0x' || substring(md5({key}), 1, 12))::BIGINT % 99991 + 1) * (j + 3) * 7919 + {salt * 31}) % 2001 - 1000 AS DOUBLE) / 1000)"


@book.add("model_encode", f"""WITH i AS (SELECT qid, max(image_url) AS url FROM split_members WHERE has_image AND coalesce(image_url, '') <> '' GROUP BY qid), e AS (SELECT qid, {_stub("coalesce(question, '')")} AS q, CASE WHEN url IS NOT NULL THEN {_stub('url', 1)} END AS v FROM questions LEFT JOIN i USING (qid))
    SELECT qid, {2 * DIM} AS width, round(q[1], 6) AS first, round(coalesce(v[{DIM}], 0.1), 6) AS last FROM e""")
def _(spark, d):
    img = table(spark, d, "split_members").where("has_image and coalesce(image_url, '') <> ''").groupBy("qid").agg(F.max("image_url").alias("url"))
    q = tn.encode(table(spark, d, "questions").select("qid", "question").join(img, "qid", "left"), "question", "url", DIM, widths={"text": DIM, "image": DIM})
    return q.select("qid", F.size("tokens").alias("width"), F.round(F.element_at("tokens", 1), 6).alias("first"), F.round(F.element_at("tokens", 2 * DIM), 6).alias("last"))


def _sum(n: str, e: str) -> str:
    return f"list_sum(list_transform(range(1, {n} + 1), lambda k: {e}))"


_N = str(DIM)
#: Queries are the questions whose number is divisible by 50, against all entities.
PASS_SQL = f"""{VEC_SQL}, qs AS (SELECT qid, fact_id, answer_entity, {_stub('question')} AS qv FROM questions WHERE CAST(substring(qid, 2) AS BIGINT) % 50 = 0 AND question IS NOT NULL),
    pool AS (SELECT fact_id FROM facts ORDER BY md5('42-1|' || CAST(fact_id AS VARCHAR)), fact_id LIMIT 10),
    cand AS (SELECT qid, qv, sc.fact_id, s, g FROM qs JOIN sc USING (fact_id) UNION ALL SELECT qid, qv, sc.fact_id, s, g FROM qs, sc JOIN pool USING (fact_id) WHERE qs.fact_id IS NULL OR sc.fact_id <> qs.fact_id),
    cc AS (SELECT *, {_sum(_N, 'qv[k] * g[k]')} / (sqrt({_sum(_N, 'qv[k] * qv[k]')}) * sqrt({_sum(_N, 'g[k] * g[k]')})) AS cos FROM cand),
    rl AS (SELECT *, 0.5 * cos - 0.5 * (s - min(s) OVER (PARTITION BY qid)) / greatest(max(s) OVER (PARTITION BY qid) - min(s) OVER (PARTITION BY qid), 1e-12) AS rel FROM cc),
    tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rel, 9) DESC, fact_id) AS rk FROM rl) WHERE rk <= 4), wt AS (SELECT *, exp(rel) / sum(exp(rel)) OVER (PARTITION BY qid) AS w FROM tk),
    m AS (SELECT qid, list(x ORDER BY k) AS m FROM (SELECT qid, k, sum(w * g[k]) AS x FROM wt, (SELECT unnest(range(1, {DIM} + 1)) AS k) GROUP BY qid, k) GROUP BY qid),
    fx AS (SELECT qs.qid, answer_entity, list_transform(range(1, {DIM} + 1), lambda k: qv[k] + m[k]) AS x FROM qs JOIN m USING (qid)),
    un AS (SELECT entity, coalesce(lat, 14.0583::DOUBLE) AS lat, coalesce(lon, 108.2772::DOUBLE) AS lon, coalesce(CAST(tau_start AS DOUBLE), 2000.0::DOUBLE) AS tau FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY fact_id, side) AS rn FROM (SELECT fact_id, 0 AS side, h AS entity, l_h_lat AS lat, l_h_lon AS lon, tau_start FROM facts UNION ALL SELECT fact_id, 1, t, l_t_lat, l_t_lon, tau_start FROM facts) WHERE entity IS NOT NULL) WHERE rn = 1),
    en AS (SELECT entity, list_transform(range(1, {DIM} + 1), lambda k: a.vec[k] + b.vec[k] + c.vec[k]) AS ev FROM un JOIN ex a ON {_bin('lat', 8.0, 23.5, 64)} = a.id JOIN ey b ON {_bin('lon', 102.0, 110.0, 64)} = b.id JOIN et c ON {_bin('tau', 800, 2025, 100)} = c.id),
    al AS (SELECT qid, answer_entity, entity, {_sum(_N, 'x[k] * ev[k]')} AS sc FROM fx, en), gl AS (SELECT qid, sc AS st FROM al WHERE entity = answer_entity),
    ps AS (SELECT qid, 1 + count(*) FILTER (round(sc, 9) > round(st, 9) OR (round(sc, 9) = round(st, 9) AND entity < answer_entity)) AS rank, least(ln(sum(exp(sc - st))), 27.631021115928547) AS loss FROM al JOIN gl USING (qid) GROUP BY qid)"""


def passed(spark, d):
    q = table(spark, d, "questions").where("cast(substring(qid, 2) as bigint) % 50 = 0 and question is not null")
    f = cut(facts(spark, d, ("h", "relation", "t", "tau_start", "l_h_lat", "l_h_lon", "l_t_lat", "l_t_lon")))  # for pool, vectors and entities
    pool = sp.uniform_sample(f.select("fact_id"), 10, "42-1", "fact_id")
    return tn.question_pass(q.select("qid", "fact_id", "answer_entity", tn.stub_vector(F.col("question"), DIM).alias("qv")), f, pool, tn.start_tables(spark, DIM))


@book.add("model_question_pass", f"WITH {PASS_SQL} SELECT qid, rank, round(loss, 5) AS loss FROM ps")
def _(spark, d):
    return passed(spark, d).select("qid", "rank", F.round("loss", 5).alias("loss"))


@book.add("model_evaluate", f"WITH {PASS_SQL} SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 4) AS hit1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 4) AS hit3, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 4) AS hit10, round(avg(1.0 / rank), 4) AS mrr FROM ps")
def _(spark, d):
    return hits(passed(spark, d), "rank")


_TABS = (("ex", "E_x", 64), ("ey", "E_y", 64), ("et", "E_t", 100), ("re", "RE", 4))


@book.add("model_checkpoint_round_trip", f"WITH {', '.join(_tab(*t) for t in _TABS)} {' UNION ALL '.join(f"SELECT '{n}' AS name, id, round(vec[1], 6) AS first, round(vec[{DIM}], 6) AS last FROM {a}" for a, n, _ in _TABS)}")
def _(spark, d):
    path = tn.save_parameters(tn.start_tables(spark, DIM) | {"backbone": rt.parameter_table(spark, "backbone", 3, DIM)}, _shared(spark), frozen=("backbone",))
    out = None
    for name, t in tn.load_parameters(spark, path, DIM).items():
        part = t.select(F.lit(name).alias("name"), "id", F.round(F.element_at("vec", 1), 6).alias("first"), F.round(F.element_at("vec", DIM), 6).alias("last"))
        out = part if out is None else out.unionByName(part)
    return out


@book.add("model_train")
def _(spark, d):
    """Losses by epoch: gradient steps have no SQL twin; the tests check that the loss falls, that a finished run is not run again and that a broken one goes on."""
    return tn.train(spark, facts(spark, d), _shared(spark), 4, epochs=2, rate=1.0)


@book.add("model_guards", "SELECT * FROM (VALUES ('E_x', 'E_x has width 7, configured is 8'), ('heads', '14 heads of 64 do not give 895'), ('kv', '14 heads are not divisible by 3'), ('good', '')) v(guard, message)")
def _(spark, d):
    def message(fn, *args, **kw):
        try:
            fn(*args, **kw)
            return ""
        except ValueError as e:
            return str(e)

    rows = [("E_x", message(rt.check_dims, 8, E_x=7)), ("heads", message(rt.check_heads, 895, 14, 2, 64)), ("kv", message(rt.check_heads, 896, 14, 3, 64)), ("good", message(rt.check_heads, 896, 14, 2, 64))]
    return spark.createDataFrame(rows, "guard string, message string")


@book.add("audit_rerun", f"WITH {FLAG_SQL} SELECT qid, auto_reasons, auto_reasons <> '' AS auto_flag FROM flagged")
def _(spark, d):
    return au.run_checks(au.run_checks(table(spark, d, "questions"))).select("qid", "auto_reasons", "auto_flag")


@book.add("io_config_overrides", "SELECT * FROM (VALUES ('run.fast', 'false', 'bool'), ('run.seed', '7', 'int'), ('run.rate', '0.5', 'float'), ('run.tag', 'x=y', 'str'), ('extra.name', 'n', 'str'), ('kept', '1', 'int')) v(key, value, kind)")
def _(spark, d):
    got = files.override({"run": {"fast": True, "seed": 42, "rate": 0.1, "tag": "a"}, "kept": 1}, ["run.fast=no", "run.seed=7", "run.rate=0.5", "run.tag=x=y", "extra.name=n"])
    flat = [(f"{k}.{s}" if isinstance(v, dict) else k, w) for k, v in got.items() for s, w in (v.items() if isinstance(v, dict) else ((None, v),))]
    return spark.createDataFrame([(k, str(w).lower() if isinstance(w, bool) else str(w), type(w).__name__) for k, w in flat], "key string, value string, kind string")


@book.add("io_sheet", "SELECT CAST(r_regionkey AS VARCHAR) AS key, r_name AS name FROM region")
def _(spark, d):
    rows = table(spark, d, "region").select("r_regionkey", "r_name").collect()  # 5 rows, fixed
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    lines = [("key", "name"), *[(r["r_regionkey"], r["r_name"].replace("&", "&amp;")) for r in rows]]
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    body = "".join(f'<row r="{i}">{cell(f"A{i}", a)}{cell(f"B{i}", b)}</row>' for i, (a, b) in enumerate(lines, 1))
    book_ = io.BytesIO()
    with zipfile.ZipFile(book_, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}"><sheets><sheet name="Other" sheetId="1"/><sheet name="Regions" sheetId="2"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return files.sheet(spark, book_, "Regions")


def pictures(spark, d):
    """A pixel map for every part: p_size + 30 wide, 20 high, one colour; every 97th is broken."""

    def run(batches):
        for b in batches:
            data = []
            for key, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                colour = [(key * 7 + 40 * c) % 256 for c in range(3)]
                data.append(images.encode_pixmap(np.full((20, size + 30, 3), colour)) if key % 97 else b"P6 broken")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["p_partkey", "content"])

    return table(spark, d, "part").select(F.col("p_partkey").cast("long"), F.col("p_size").cast("int")).mapInArrow(run, "p_partkey long, content binary")


@book.add("image_thumbnails", "SELECT p_partkey, p_partkey % 97 <> 0 AS ok, CASE WHEN p_partkey % 97 <> 0 THEN 40 END AS width, CASE WHEN p_partkey % 97 <> 0 THEN CAST(greatest(1, floor(20 * 40 / (p_size + 30))) AS INTEGER) END AS height FROM part")
def _(spark, d):
    return images.thumbnails(pictures(spark, d), "p_partkey", 40).select("p_partkey", "ok", "width", "height")


@book.add("image_features", "SELECT p_partkey, 768 AS n, round((p_partkey * 7 % 256) / 255.0, 6) AS red, round(((p_partkey * 7 + 80) % 256) / 255.0, 6) AS blue FROM part WHERE p_partkey % 97 <> 0")
def _(spark, d):
    return images.features(pictures(spark, d), "p_partkey").select("p_partkey", F.size("vec").alias("n"), F.round(F.element_at("vec", 1), 6).alias("red"), F.round(F.element_at("vec", 768), 6).alias("blue"))


@book.add("image_captions", "SELECT CAST(p_partkey AS VARCHAR) AS image_file, 0 AS pos, 'house' AS subject, 'near' AS predicate, 'river ' || (p_partkey * 7 % 256) AS object FROM part WHERE p_partkey % 97 <> 0")
def _(spark, d):
    from loomgraph.operators.visual import caption_triplets

    return caption_triplets(images.captions(pictures(spark, d), "p_partkey", lambda px: f"a house near the river {px[0, 0, 0]}"))


@book.add("image_concepts", "WITH f AS (SELECT p_partkey, p_partkey * 7 % 256 AS r, (p_partkey * 7 + 40) % 256 AS g, (p_partkey * 7 + 80) % 256 AS b FROM part WHERE p_partkey % 97 <> 0) SELECT p_partkey, c AS concept, round(CASE WHEN r + g + b = 0 THEN 0 ELSE [r, g, b][c + 1] / sqrt(r * r + g * g + b * b) END, 6) AS score FROM f, (SELECT unnest(range(3)) AS c)")
def _(spark, d):
    """Cosine of unit features with unit concept vectors (one per colour channel; a fixed small table)."""
    vec = images.features(pictures(spark, d), "p_partkey", unit=True)
    concepts = spark.range(3).select(F.col("id").alias("concept"), F.transform(F.sequence(F.lit(0), F.lit(767)), lambda i: F.when(i % 3 == F.col("id"), 0.0625).otherwise(0.0)).alias("cv"))
    from loomgraph.functions import vectors as V

    return vec.join(F.broadcast(concepts), how="inner").select("p_partkey", "concept", F.round(V.dot(F.col("vec"), F.col("cv")), 6).alias("score"))
