"""Question pass, stored parameters and training of the space-time embeddings.

Parameter tables are bounded (grid cells, years, relations) and always broadcast; facts, questions and entities are never collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import vectors as V
from loomgraph.operators import retrieval as rt
from loomgraph.operators.ranking import running_position
from loomgraph.session import cut

#: Rows of each parameter table.
TABLES = {"E_x": rt.BINS_X, "E_y": rt.BINS_Y, "E_t": rt.BINS_T, "RE": len(rt.RELATIONS)}


def start_tables(spark: SparkSession, dim: int) -> dict[str, DataFrame]:
    return {name: rt.parameter_table(spark, name, rows, dim) for name, rows in TABLES.items()}


def save_parameters(tables: dict[str, DataFrame], path: str, frozen: tuple[str, ...] = ()) -> str:
    """Writes every table that is not frozen, one folder per table; an older checkpoint is replaced."""
    out = None
    for name, t in tables.items():
        if name not in frozen:
            part = t.select(F.lit(name).alias("name"), "id", "vec")
            out = part if out is None else out.unionByName(part)
    out.write.mode("overwrite").partitionBy("name").parquet(path)
    return path


def load_parameters(spark: SparkSession, path: str, dim: int) -> dict[str, DataFrame]:
    """Tables of a checkpoint; a table of another width raises."""
    all_ = spark.read.parquet(path)
    if "step" in all_.columns:  # a run saves every step in a folder of its own; the last one counts
        all_ = all_.where(F.col("step") == all_.agg(F.max("step")).first()[0])
    widths = {r["name"]: r["w"] for r in all_.groupBy("name").agg(F.max(F.size("vec")).alias("w")).collect()}  # one row per table
    rt.check_dims(dim, **widths)
    return {name: all_.where(F.col("name") == name).select("id", "vec") for name in sorted(widths)}


def stub_vector(key: Column, dim: int, salt: int = 0) -> Column:
    """Stands in for a pretrained encoder: a vector in [-1, 1] that depends on the text only; null stays null."""
    k = F.pmod(F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long"), F.lit(99991)) + 1
    return F.when(key.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: (F.pmod(k * (j + 3) * 7919 + salt * 31, F.lit(2001)) - 1000) / 1000.0))


def encode(df: DataFrame, text: str, image: str, dim: int, encoder=stub_vector, null_image: float = 0.1, widths: dict[str, int] | None = None) -> DataFrame:
    """Adds `tokens`, the text vector and the image vector (a learned placeholder where there is no image), one behind the other. widths: declared widths of the frozen backbones."""
    rt.check_dims(dim, **(widths or {}))
    img = F.coalesce(encoder(F.nullif(F.col(image), F.lit("")), dim, 1), F.array_repeat(F.lit(null_image), dim))
    return df.withColumn("tokens", F.concat(encoder(F.coalesce(text, F.lit("")), dim, 0), img))


def fact_vectors(facts: DataFrame, tables: dict[str, DataFrame], drop_space: bool = False, drop_time: bool = False) -> DataFrame:
    """(fact_id, s, g): plausibility and vector of each fact."""
    t = {"x": tables["E_x"], "y": tables["E_y"], "t": tables["E_t"]}
    f = rt.impute(facts, "l_h_lat", "l_h_lon", "tau_start", drop_space, drop_time)
    f = rt.impute(f, "l_t_lat", "l_t_lon", None, drop_space)
    f = rt.embed(rt.embed(f, t, "l_h_lat", "l_h_lon", "tau_start", "sh"), t, "l_t_lat", "l_t_lon", "tau_start", "st")
    re = tables["RE"].select(F.col("id").alias("rid"), F.col("vec").alias("rv"))
    f = f.withColumn("rid", rt.relation_id(F.col("r"))).join(F.broadcast(re), "rid")
    return f.select("fact_id", rt.plausibility(F.col("sh"), F.col("rv"), F.col("st")).alias("s"), rt.fact_vector(F.col("sh"), F.col("rv"), F.col("st")).alias("g"))


def question_pass(questions: DataFrame, facts: DataFrame, pool: DataFrame, tables: dict[str, DataFrame], k: int = 4, alpha: float = 0.5, drop_space: bool = False, drop_time: bool = False, drop_relevance: bool = False, drop_facts: bool = False) -> DataFrame:
    """(qid, rank, loss) of questions(qid, fact_id, answer_entity, qv): retrieval, fusion and ranking of every question against all entities.

    Candidates of a question are the facts of `pool` (fact_id; a small sample) and its own fact. The k most relevant ones are weighted by softmax, their vectors are added to the question's, and
    every entity is scored by its dot product with that. Questions whose answer is no entity are left out. Ablations: drop_space, drop_time, drop_relevance (equal weights), drop_facts.
    """
    q = cut(questions.select("qid", "fact_id", "answer_entity", "qv"))
    used = q.select("fact_id").unionByName(pool.select("fact_id")).distinct()
    vec = fact_vectors(cut(facts.join(used, "fact_id", "left_semi")), tables, drop_space, drop_time)  # no other fact needs a vector
    pooled = cut(vec.join(F.broadcast(pool.select("fact_id")), "fact_id"))  # pool: a fixed small number of facts
    own = q.select("qid", "qv", "fact_id").join(vec, "fact_id").select("qid", "qv", "fact_id", "s", "g")
    shared = q.select("qid", "qv", F.col("fact_id").alias("mine")).join(F.broadcast(pooled), F.col("mine").isNull() | (F.col("mine") != F.col("fact_id"))).select("qid", "qv", "fact_id", "s", "g")
    scored = own.unionByName(shared).withColumn("cos", V.cosine(F.col("qv"), F.col("g")))
    rel = rt.relevance(scored, alpha, ["qid"]).withColumn("rel", F.lit(0.0) if drop_relevance else F.col("rel")).withColumn("relr", F.round("rel", 9))
    top = rt.top_k(rel, ["qid"], "relr", "fact_id", k)
    w = rt.softmax(top, "rel", ["qid"], "w").select("qid", F.posexplode(V.scale(F.col("g"), F.col("w"))).alias("pos", "e"))
    summed = w.groupBy("qid", "pos").agg(F.sum("e").alias("e")).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda x: x["e"]).alias("m"))
    fused = q.join(summed, "qid", "left").withColumn("x", F.col("qv") if drop_facts else F.when(F.col("m").isNull(), F.col("qv")).otherwise(V.add(F.col("qv"), F.col("m"))))
    universe = rt.entity_universe(facts.withColumn("ord", F.col("fact_id")))
    placed = rt.impute(universe, "lat", "lon", "tau", drop_space, drop_time)
    x, y, t = rt.cells(F.col("lat"), F.col("lon"), F.col("tau"))
    ents = cut(placed.select("entity", ((x * rt.BINS_Y + y) * rt.BINS_T + t).alias("cell")))
    goal = cut(fused.join(ents.withColumnRenamed("entity", "answer_entity"), "answer_entity").select("qid", "x", F.col("answer_entity").alias("goal"), "cell"))
    seen = cut(cell_scores(goal, ents.groupBy("cell").agg(F.count("*").alias("n")), tables))
    # entities of the same score count where their name is smaller: those before the goal in each cell of that score
    ties = seen.select("qid", F.explode("ties").alias("cell")).join(goal.select("qid", F.col("goal").alias("entity")), "qid")
    both = ents.select("cell", "entity", F.lit("").alias("qid"), F.lit(1).alias("one")).unionByName(ties.select("cell", "entity", "qid", F.lit(0).alias("one")))
    at = running_position(both, ["cell"], ["entity", "one", "qid"], "one").where("one = 0").groupBy("qid").agg(F.sum("before").alias("before"))
    return seen.join(at, "qid", "left").select("qid", (F.col("better") + F.coalesce("before", F.lit(0)) + 1).alias("rank"), "loss")


def cell_scores(goal: DataFrame, cells: DataFrame, tables: dict[str, DataFrame], block: int = 1 << 17, tile: int = 1024) -> DataFrame:
    """(qid, better, ties, loss) of goal(qid, x, cell): entities with a higher score than the goal's, the cells of its own score, and the loss.

    The vector of an entity is that of its cell in space and time, so scores are taken once per cell(cell, n), of which the grid has a fixed number, and count n times. Scores are compared
    at nine digits. They are taken in single precision first; where its error bound leaves the side open they are taken again term by term, as the expressions of `functions.vectors` take
    them. block: scores held at once, of `tile` cells.
    """
    occupied = cells.toPandas()  # at most one row per cell of the grid
    rows = {k: np.stack([np.asarray(r["vec"], np.float64) for r in sorted(tables[k].collect(), key=lambda r: r["id"])]) for k in ("E_x", "E_y", "E_t")}
    order = np.argsort(occupied["cell"].to_numpy(np.int64))
    shared = goal.sparkSession.sparkContext.broadcast((rows, occupied["cell"].to_numpy(np.int64)[order], occupied["n"].to_numpy(np.int64)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, cell, n = shared.value
        shape = tuple(len(rows[k]) for k in ("E_x", "E_y", "E_t"))
        i, j, k = np.unravel_index(cell, shape)
        ev = (rows["E_x"][i] + rows["E_y"][j]) + rows["E_t"][k]
        full = np.zeros(shape)
        full[i, j, k] = n
        full = full.reshape(-1, shape[2])
        step = max(1, block // tile)
        # digits of base 4096, so that the sums of a tile are exact in single precision
        digits = np.arange(max(1, -(-int(n.max(initial=1)).bit_length() // 12)))
        weight = (n[:, None] >> 12 * digits & 4095).astype(np.float32)
        wide, size = np.column_stack([ev, np.ones(len(ev))]).astype(np.float32), np.abs(ev).max(0, initial=0.0)
        for b in batches:
            qid, own = b.column(0).to_pylist(), np.searchsorted(cell, b.column(2).to_numpy())
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(len(qid), -1)
            st, (better, ties, loss) = _dots(x, ev[own]), ([], [], [])
            for at in range(0, len(qid), step):
                v, s = x[at : at + step], st[at : at + step]
                slack = ((np.abs(v) @ size + np.abs(s)) * ((v.shape[1] + 8) * 2.0**-24) + 4e-9).astype(np.float32)[:, None]
                left, more, near = np.column_stack([v, -s]).astype(np.float32), np.zeros(len(s), np.int64), []
                for first in range(0, len(cell), tile):
                    z = left @ wide[first : first + tile].T
                    over = z > slack
                    more += (over.astype(np.float32) @ weight[first : first + tile]).astype(np.int64) @ (4096**digits)
                    u, w = np.divmod(np.flatnonzero(over != (z >= -slack)), z.shape[1])
                    near.append((u, w + first))
                q, c = (np.concatenate(x) for x in zip(*near))
                exact = _dots(v[q], ev[c])
                apart = exact - s[q]
                np.add.at(more, q[apart > 2e-9], n[c[apart > 2e-9]])
                q, c, exact = (x[np.abs(apart) <= 2e-9] for x in (q, c, exact))
                equal: list[list[int]] = [[] for _ in s]
                for u, w, z in zip(q.tolist(), c.tolist(), exact.tolist()):
                    d = 0 if z == s[u] else _nine(z) - _nine(float(s[u]))
                    if d > 0:
                        more[u] += n[w]
                    elif d == 0:
                        equal[u].append(int(cell[w]))
                better += more.tolist()
                ties += equal
                a, e, t = (v @ rows[k].T for k in ("E_x", "E_y", "E_t"))
                tops = [z.max(1) for z in (a, e, t)]
                a, e, t = (np.exp(z - m[:, None]) for z, m in zip((a, e, t), tops))
                total = (((a[:, :, None] * e[:, None, :]).reshape(len(s), -1) @ full) * t).sum(1)
                with np.errstate(divide="ignore"):
                    loss += np.minimum(np.log(total) + sum(tops) - s, 27.631021115928547).tolist()  # p of the target is at least 1e-12
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(better, pa.int64()), pa.array(ties, pa.list_(pa.int32())), pa.array(loss, pa.float64())], names=["qid", "better", "ties", "loss"])

    return goal.select("qid", "x", F.col("cell").cast("long").alias("cell")).repartition(int(goal.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "qid string, better long, ties array<int>, loss double")


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed in index order."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _nine(v: float) -> Decimal:
    return Decimal(repr(v)).quantize(Decimal("1e-9"), ROUND_HALF_UP)


def train(spark: SparkSession, facts: DataFrame, path: str, dim: int, epochs: int = 5, rate: float = 0.05, margin: float = 1.0, patience: int = 2, resume: bool = True) -> DataFrame:
    """Trains the tables by full gradient steps on the margin loss of every fact against the fact with its tail's place and year taken from another one, and returns (epoch, loss, saved).

    After each epoch that improves the loss the tables are saved, each time in a new folder, so that a broken save leaves the last one whole; training stops after `patience` epochs without. A finished run (its history is there) is not run again when `resume`
    is set, one that was broken off goes on from its last tables. One aggregate per epoch: gradients are summed by table, row and dimension.
    """
    done = f"{path}/history"
    if resume:
        try:
            return spark.read.schema("epoch int, loss double, saved boolean").parquet(done)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    tables, step = start_tables(spark, dim), 0
    if resume:
        try:
            tables = {k: cut(t) for k, t in load_parameters(spark, f"{path}/tables", dim).items()}
            step = spark.read.parquet(f"{path}/tables").agg(F.max("step")).first()[0] + 1
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    f = rt.impute(rt.impute(facts, "l_h_lat", "l_h_lon", "tau_start"), "l_t_lat", "l_t_lon")
    (hx, hy, it), (tx, ty, _) = rt.cells(F.col("l_h_lat"), F.col("l_h_lon"), F.col("tau_start")), rt.cells(F.col("l_t_lat"), F.col("l_t_lon"), F.col("tau_start"))
    # another place for the tail: the mirror cell, so that no second fact is looked up
    rows = cut(f.select("fact_id", rt.relation_id(F.col("r")).alias("r"), hx.alias("hx"), hy.alias("hy"), it.alias("it"), tx.alias("tx"), ty.alias("ty"), (rt.BINS_X - 1 - tx).alias("nx"), (rt.BINS_Y - 1 - ty).alias("ny")))
    n = max(rows.count(), 1)
    history: list[tuple[int, float, bool]] = []
    best, waited = float("inf"), 0
    for epoch in range(epochs):
        look = rows
        for col, name in (("hx", "E_x"), ("hy", "E_y"), ("tx", "E_x"), ("ty", "E_y"), ("nx", "E_x"), ("ny", "E_y"), ("r", "RE")):
            look = look.join(F.broadcast(tables[name].select(F.col("id").alias(col), F.col("vec").alias(f"v{col}"))), col)
        # both ends share the year, whose vector cancels
        diff = lambda x, y: V.add(F.col("vhx"), F.col("vhy"), F.col("vr"), V.scale(V.add(F.col(x), F.col(y)), -1.0))
        d = look.withColumn("dp", diff("vtx", "vty")).withColumn("dn", diff("vnx", "vny")).withColumn("sp", F.sqrt(V.dot(F.col("dp"), F.col("dp")))).withColumn("sn", F.sqrt(V.dot(F.col("dn"), F.col("dn"))))
        d = cut(d.withColumn("l", F.greatest(F.lit(0.0), margin + F.col("sp") - F.col("sn"))).select("hx", "hy", "tx", "ty", "nx", "ny", "r", "l", V.scale(F.col("dp"), F.when(F.col("l") > 0, 1 / F.greatest("sp", F.lit(1e-9))).otherwise(0.0)).alias("gp"), V.scale(F.col("dn"), F.when(F.col("l") > 0, 1 / F.greatest("sn", F.lit(1e-9))).otherwise(0.0)).alias("gn")))
        loss = d.agg(F.avg("l")).first()[0] or 0.0
        better = loss < best - 1e-12
        if better:
            best, waited = loss, 0
            save_parameters(tables, f"{path}/tables/step={step + epoch}")
        else:
            waited += 1
        history.append((epoch, float(loss), better))
        if waited >= patience:
            break
        both = V.add(F.col("gp"), V.scale(F.col("gn"), -1.0))
        part = lambda name, col, g: F.struct(F.lit(name).alias("name"), F.col(col).alias("id"), g.alias("g"))
        each = F.array(part("E_x", "hx", both), part("E_y", "hy", both), part("RE", "r", both), part("E_x", "tx", V.scale(F.col("gp"), -1.0)), part("E_y", "ty", V.scale(F.col("gp"), -1.0)), part("E_x", "nx", F.col("gn")), part("E_y", "ny", F.col("gn")))
        grads = d.where("l > 0").select(F.explode(each).alias("e")).select("e.name", "e.id", F.posexplode("e.g").alias("pos", "g")).groupBy("name", "id", "pos").agg(F.sum("g").alias("g"))
        change = cut(grads.groupBy("name", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "g"))), lambda x: x["g"]).alias("g")))
        moved = {}
        for name, t in tables.items():
            s = change.where(F.col("name") == name).select("id", "g")
            moved[name] = cut(t.join(F.broadcast(s), "id", "left").select("id", F.when(F.col("g").isNull(), F.col("vec")).otherwise(V.add(F.col("vec"), V.scale(F.col("g"), -rate / n))).alias("vec")))
        tables = moved
    out = spark.createDataFrame(history, "epoch int, loss double, saved boolean")
    out.coalesce(1).write.mode("overwrite").parquet(done)  # one row per epoch
    return out
