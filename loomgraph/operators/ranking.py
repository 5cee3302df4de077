"""Exact ranks and running totals over unbounded groups without a single-task window.

A window partitioned by a hot key sorts that whole key in one task. Here rows are range-partitioned
on (group, order), numbered inside their partition, and shifted by the totals of earlier partitions;
only partition x group totals (bounded by partitions + groups) are gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.session import cut


def running_position(df: DataFrame, group: list[str], order: list[str], weight: str | None = None, rank_col: str = "rn", before_col: str = "before") -> DataFrame:
    """Adds rank_col (1-based rank in the group by order) and, with weight, before_col (sum of weight of earlier rows).

    order must be a total order inside each group; groups may be of any size. Nulls form a group of their own.
    An empty input gives an empty result.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    w = F.lit(0).cast("long") if weight is None else F.col(weight)
    placed = cut(df.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()))
    totals = placed.groupBy("__part", *group).agg(F.count("*").alias("__n"), F.sum(w).alias("__w"))
    earlier = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("__part", *[F.col(g).alias(f"__g_{g}") for g in group], F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off_n"), F.coalesce(F.sum("__w").over(earlier), F.lit(0)).alias("__off_w"))
    local = W.partitionBy("__part", *group).orderBy(*order)
    inside = placed.withColumn("__rn", F.row_number().over(local)).withColumn("__before", F.coalesce(F.sum(w).over(local.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = inside.join(offsets.withColumnRenamed("__part", "__part2"), _on(group), "left")
    cols = [F.col(c) for c in df.columns] + [(F.col("__rn") + F.col("__off_n")).alias(rank_col)]
    if weight is not None:
        cols.append((F.col("__before") + F.col("__off_w")).alias(before_col))
    return out.select(*cols)


def _on(group: list[str]):
    on = F.col("__part") == F.col("__part2")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return on
