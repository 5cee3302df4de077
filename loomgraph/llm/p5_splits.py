"""Problem 5: train/validation/test splits that keep questions sharing a fact_id or a head together.

Method: parallel hooking and shortcutting over parent arrays in joined tables. Rows are first reduced to distinct
(fact node, head) edges. Every round, each tree root hooks onto the smallest root seen by any head its tree touches, and
pointer jumping flattens the trees; it ends when no root can hook. Component sizes then form a small histogram
(distinct sizes <= sqrt(2 x rows)); subset-sum bitsets over the size multiplicities choose how many components of each
size go to test and to validation so that the totals come closest to the wanted shares.

Defined results: null fact_id connects nothing (the row is a node of its own, still joined by h); null or blank h connects
nothing; repeated qids count once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.ranking import running_position
from loomgraph.session import cut


def components(questions: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(qid, group_qid): group_qid is the smallest qid of the connected set. max_rounds only guards against endless loops; it raises when reached."""
    node = F.coalesce(F.concat(F.lit("f"), F.col("fact_id").cast("string")), F.concat(F.lit("q"), F.col("qid")))
    rows = questions.where(F.col("qid").isNotNull()).select("qid", node.alias("v"), F.when(F.regexp_replace("h", r"[\s\u00a0\u200b\ufeff]", "") != "", F.col("h")).alias("h"))
    nodes = cut(rows.groupBy("v", "h").agg(F.min("qid").alias("q")))
    edges = nodes.where("h is not null").select("v", "h")
    # a head seen with one node only joins nothing
    shared = edges.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    edges = cut(edges.join(shared, "h", "left_semi"))
    parent = cut(edges.select("v").distinct().select("v", F.col("v").alias("p")))
    for _ in range(max_rounds):
        seen = edges.join(parent, "v").select("h", "p").distinct()
        least = seen.groupBy("h").agg(F.min("p").alias("m"))
        hooks = cut(seen.join(least, "h").where("m < p").groupBy("p").agg(F.min("m").alias("m")))
        if hooks.isEmpty():
            break
        # shortcut the hook chains among the hooked roots, then apply them to every node
        for _ in range(max_rounds):
            up = hooks.alias("a").join(hooks.alias("b"), F.col("a.m") == F.col("b.p"), "left").select(F.col("a.p").alias("p"), F.coalesce("b.m", "a.m").alias("m"), F.col("b.m").isNotNull().alias("moved"))
            up = cut(up)
            hooks = up.select("p", "m")
            if up.where("moved").isEmpty():
                break
        else:
            raise RuntimeError(f"hooks did not settle in {max_rounds} rounds")
        parent = cut(parent.join(hooks, "p", "left").select("v", F.coalesce("m", "p").alias("p")))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    rooted = rows.select("qid", "v").join(parent, "v", "left").select("qid", F.coalesce("p", "v").alias("root"))
    group = rooted.groupBy("root").agg(F.min("qid").alias("group_qid"))
    return rooted.join(group, "root").select("qid", "group_qid").distinct()


def found(questions: DataFrame) -> DataFrame:
    return components(questions).where("qid <> group_qid").select("group_qid", "qid")


#: Gaps up to this many records are filled exactly; the bitsets of a gap take 2 x gap bits each.
EXACT_GAP = 1 << 20


def plan_counts(histogram: dict[int, int], total: int, shares: tuple[float, ...], exact_gap: int = EXACT_GAP) -> list[dict[int, int]]:
    """For each share, how many components of each size to take so that its total comes closest to share x total.

    A proportional floor of every size class comes first. A gap over `exact_gap` records, which only components of nearly that size leave, is brought under it by taking the largest
    components that fit; what is left is filled by a subset-sum bitset over the remaining size multiplicities (binary splitting), exactly where the whole gap is at most `exact_gap`.
    """
    left = dict(histogram)
    plans = []
    for share in shares:
        want = round(share * total)
        take = {s: min(left[s], int(share * histogram[s])) for s in histogram}
        gap = want - sum(s * c for s, c in take.items())
        for s in sorted(left, reverse=True):
            if gap <= exact_gap:
                break
            k = min(left[s] - take[s], max(0, gap // s))
            take[s] += k
            gap -= k * s
        if gap > exact_gap:  # all that fit are taken: one that does not fit comes closer, or none does
            over = [s for s in left if left[s] > take[s] and gap < s < 2 * gap]
            if over:
                take[min(over)] += 1
        elif gap > 0:
            pieces = []  # (size x multiple, size, multiple)
            for s in sorted(left):
                free, k = min(left[s] - take[s], gap // s + 1), 1
                while free > 0:
                    m = min(k, free)
                    pieces.append((s * m, s, m))
                    free, k = free - m, k * 2
            for s, m in _fill([p for p in pieces if p[0] <= 2 * gap], gap):
                take[s] += m
        for s in take:
            left[s] -= take[s]
        plans.append(take)
    return plans


def _fill(pieces: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int]]:
    """Pieces (value, size, multiple) whose values sum up closest to gap. Bitsets of the sums of the first i pieces are kept for every square-rootth i only; the others are made again on the way back."""
    limit = (1 << (2 * gap + 1)) - 1
    step = max(1, int(len(pieces) ** 0.5))
    kept, reach = [1], 1
    for i, (v, _, _) in enumerate(pieces, 1):
        reach = (reach | (reach << v)) & limit
        if i % step == 0:
            kept.append(reach)
    best = next((d for e in range(gap + 1) for d in (gap - e, gap + e) if reach >> d & 1), 0)
    out = []
    for block in range((len(pieces) + step - 1) // step - 1, -1, -1):
        first, part = block * step, [kept[block]]
        for v, _, _ in pieces[first : first + step]:
            part.append((part[-1] | (part[-1] << v)) & limit)
        for i in range(min(first + step, len(pieces)) - 1, first - 1, -1):
            if not part[i - first] >> best & 1:
                v, s, m = pieces[i]
                out.append((s, m))
                best -= v
    return out


def assign(questions: DataFrame, shares: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """(qid, group_qid, group_size, split): every qid, train = what the named shares leave. Order inside a size class is md5(seed, group)."""
    shares = shares or {"test": 0.1, "val": 0.1}
    comp = cut(components(questions))
    sizes = comp.groupBy("group_qid").agg(F.count("*").alias("group_size"))
    sizes = cut(sizes.withColumn("draw", F.md5(F.concat_ws("|", F.lit(str(seed)), "group_qid"))))
    histogram = {r["group_size"]: r["n"] for r in sizes.groupBy("group_size").agg(F.count("*").alias("n")).collect()}
    plans = plan_counts(histogram, sum(s * n for s, n in histogram.items()), tuple(shares.values()))
    bounds, start = [], dict.fromkeys(histogram, 0)
    for name, plan in zip(shares, plans):
        bounds += [(s, name, start[s] + 1, start[s] + c) for s, c in plan.items() if c]
        for s, c in plan.items():
            start[s] += c
    bounds_df = comp.sparkSession.createDataFrame(bounds, "size long, split string, lo long, hi long")
    ranked = running_position(sizes, ["group_size"], ["draw", "group_qid"])
    chosen = ranked.join(bounds_df, (F.col("group_size") == F.col("size")) & F.col("rn").between(F.col("lo"), F.col("hi")), "left")
    chosen = chosen.select("group_qid", "group_size", F.coalesce("split", F.lit("train")).alias("split"))
    return comp.join(chosen, "group_qid").select("qid", "group_qid", "group_size", "split")
