"""Fact-safe splits, quotas, seeded samples and selections. Random order is md5(seed|key), so it is the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.ranking import running_position
from loomgraph.session import cut


def draw(seed: int | str, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def split_by_fact(questions: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """(fact_id, relation, split): facts of each relation in hash order; round-half-even shares, the rest is test.

    The rank inside a relation is distributed (a relation may hold most facts); the first relation of a fact counts.
    """
    f = questions.where("fact_id is not null").groupBy("fact_id").agg(F.min(F.struct("qid", "relation"))["relation"].alias("relation"))
    ranked = running_position(f.withColumn("draw", draw(seed, "fact_id")), ["relation"], ["draw", "fact_id"])
    n = f.groupBy("relation").agg(F.count("*").alias("n"))
    sized = ranked.join(n.withColumnRenamed("relation", "__r"), F.col("relation").eqNullSafe(F.col("__r")))
    a, b = F.bround(F.lit(train) * F.col("n")), F.bround(F.lit(val) * F.col("n"))
    return sized.select("fact_id", "relation", F.when(F.col("rn") <= a, "train").when(F.col("rn") <= a + b, "val").otherwise("test").alias("split"))


def quotas(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, size, quota): round-half-even share of n capped at the group size; the residual goes to the largest group."""
    sizes = df.groupBy(key).agg(F.count("*").alias("size"))
    total = W.partitionBy()
    q = sizes.withColumn("quota", F.least(F.bround(F.lit(float(n)) * F.col("size") / F.sum("size").over(total)).cast("long"), F.col("size")))
    first = F.row_number().over(W.partitionBy().orderBy(F.desc("size"), key)) == 1
    gap = F.least(F.lit(n), F.sum("size").over(total)) - F.sum("quota").over(total)
    return q.select(key, "size", F.when(first, F.least(F.col("quota") + gap, F.col("size"))).otherwise(F.col("quota")).alias("quota"))


def quota_sample(df: DataFrame, key: str, n: int, seed: int, ids: str = "qid") -> DataFrame:
    """Exactly quota rows of each group, the first in hash order (no replacement)."""
    ranked = running_position(df.withColumn("draw", draw(seed, ids)), [key], ["draw", ids])
    return ranked.join(quotas(df, key, n).select(F.col(key).alias("__k"), "quota"), F.col(key).eqNullSafe(F.col("__k"))).where("rn <= quota").drop("rn", "quota", "draw", "__k")


def uniform_sample(df: DataFrame, n: int, seed: int, ids: str = "qid") -> DataFrame:
    return df.withColumn("draw", draw(seed, ids)).orderBy("draw", ids).limit(n).drop("draw")


def leakage(assignment: DataFrame) -> DataFrame:
    """Facts standing in more than one split, counted per pair of splits (0 rows when there are none)."""
    a = assignment.select("fact_id", "split").distinct()
    sets = a.groupBy("fact_id").agg(F.sort_array(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    pairs = sets.select("fact_id", F.explode("s").alias("split_a"), "s").select("fact_id", "split_a", F.explode("s").alias("split_b")).where("split_a < split_b")
    return pairs.groupBy("split_a", "split_b").agg(F.count("*").alias("n_facts"))


def showcase(df: DataFrame, relations: tuple[str, ...], n_total: int = 8, seed: int = 42) -> DataFrame:
    """Constraint-driven pick of n_total rows from different facts. df: qid, fact_id, relation, has_image, is_interval, is_reverse.

    One row per relation (with an image where there is one), then one interval and one reverse row where none is chosen yet, then rows with images if enough are left,
    else any. Each step takes the head of one ordering, so only n_total rows are ever gathered.
    """
    pool = cut(df.withColumn("draw", draw(seed, "qid")))
    chosen: list = []

    def pick(cond: Column, n: int = 1, prefer: bool = True) -> None:
        left = pool.where(cond)
        if chosen:
            left = left.where(~F.col("qid").isin([r["qid"] for r in chosen]) & ~F.col("fact_id").isin([r["fact_id"] for r in chosen]))
        order = [F.desc("has_image")] if prefer else []
        one = left.groupBy("fact_id").agg(F.min(F.struct((~F.col("has_image")).alias("no"), "draw", "qid", "relation", "has_image", "is_interval", "is_reverse"))["qid"].alias("qid"))
        rows = left.join(one, ["fact_id", "qid"]).orderBy(*order, "draw", "qid").limit(n).collect()
        chosen.extend(rows)

    for rel in relations:
        pick(F.col("relation") == rel)
    if not any(r["is_interval"] for r in chosen):
        pick(F.col("is_interval"), prefer=False)
    if not any(r["is_reverse"] for r in chosen):
        pick(F.col("is_reverse"), prefer=False)
    if len(chosen) < n_total:
        pick(F.lit(True), n_total - len(chosen))
    return df.where(F.col("qid").isin([r["qid"] for r in chosen]))
