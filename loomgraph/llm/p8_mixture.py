"""Problem 8: mixing sources to target weights.

Method: time-varying curriculum. Every source has a weight schedule over training time t in [0, 1],
w(t) = share x (1 + tilt x (2t - 1)), whose integral over the whole time is its target share. Its cumulative token demand up to t is
budget x share x (t + tilt x (t^2 - t)). The copies of its documents, in hash order and epoch by epoch, form a stream of
tokens; inverting the demand at the middle of each copy gives the copy its training position, and a range sort by position
is the training order. Tilts sum to zero over the shares, so the batch size is the same at all times.

The budget is the largest at which every source that has documents can give its share without repeating any document more
than max_repeats times; sources without documents, and those not listed, give nothing, and the shares of the rest are scaled to 1. A document longer than all its source may
give cannot be part of any such mixture: it does not count as what the source has. The last document of a source is used when its middle lies within the demand, so a share is off by at most half a document.

Token counts come from a public tokenizer (a rank file, whose path is a parameter) over whole texts. Source names are compared in
lower case without outer spaces, with - and spaces as _.

Defined results: null or empty texts have no tokens and are not used; null or unlisted sources are not used; repeated
doc_ids are used as separate documents; ties of the hash order fall to doc_id and text; empty tables give an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.ranking import running_position
from loomgraph.session import cut

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splits text before the merges of the rank file (fixed value of that vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


_ENCODINGS: dict[str, object] = {}


def _encoding(name: str, data: bytes):
    """Tokenizer of a rank file, made once per worker process."""
    if name not in _ENCODINGS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _ENCODINGS[name] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[name]


def token_counts(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, source, draw, n_tokens): tokens of the whole text; draw is a hash of the document for its place in the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks, shared.value)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "source", "draw", "n_tokens"])

    with open(ranks, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file, about a megabyte
    base = docs.select("doc_id", source_name(F.col("source")).alias("source"), F.md5(F.concat_ws("|", F.lit("mix"), F.col("doc_id").cast("string"), "text")).alias("draw"), "text")
    return base.mapInArrow(run, "doc_id long, source string, draw string, n_tokens long")


def tilts(shares: dict[str, float], repeats: dict[str, int], strength: float) -> dict[str, float]:
    """Slope of each schedule in [-strength, strength]: sources that may be repeated more come later; share-weighted sum zero."""
    if not shares:
        return {}
    mean = sum(shares[s] * repeats[s] for s in shares) / sum(shares.values())
    raw = {s: repeats[s] - mean for s in shares}
    top = max(map(abs, raw.values())) or 1.0
    return {s: strength * v / top for s, v in raw.items()}


def plan(docs: DataFrame, targets: DataFrame, tilt: float = 0.6, ranks: str = RANKS) -> tuple[DataFrame, list[dict]]:
    """Counted documents of the listed sources, and per source: target share, tokens, demand and tilt (one entry per row of the targets table)."""
    want = {r["source"]: r for r in targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).where("source is not null").collect()}
    counted = token_counts(docs, ranks).where("n_tokens > 0")
    counted = cut(counted.where(F.col("source").isin(list(want))) if want else counted.limit(0))
    # a document longer than its source's whole demand cannot be part of the mixture; leaving it out lowers what the source has, hence the loop (over the counts only, the texts are read once)
    limit: dict[str, float] = {}
    while True:
        fits = F.lit(True)
        for s, most in limit.items():
            fits = fits & ((F.col("source") != s) | (F.col("n_tokens") <= most))
        have = {r["source"]: r for r in counted.where(fits).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"), F.max("n_tokens").alias("longest")).collect()}
        usable = {s: float(want[s]["share"]) for s in want if s in have and (want[s]["share"] or 0) > 0 and (want[s]["cap"] or 0) > 0}
        scale = sum(usable.values())
        budget = min((have[s]["tokens"] * want[s]["cap"] * scale / usable[s] for s in usable), default=0.0)
        over = {s: budget * usable[s] / scale for s in usable if have[s]["longest"] > budget * usable[s] / scale * (1 + 1e-9)}
        if not over:
            break
        limit |= over
    counted = counted.where(fits)
    slope = tilts({s: v / scale for s, v in usable.items()}, {s: want[s]["cap"] for s in usable}, tilt)
    out = []
    for s in sorted(want):
        tokens, n = (have[s]["tokens"], have[s]["docs"]) if s in have else (0, 0)
        demand = budget * usable[s] / scale if s in usable else 0.0
        out.append({"source": s, "target_share": float(want[s]["share"] or 0), "cap": int(want[s]["cap"] or 0), "tokens": int(tokens), "docs": int(n), "demand": float(demand), "tilt": float(slope.get(s, 0.0))})
    return counted, out


_PLAN = "source string, target_share double, cap int, tokens long, docs long, demand double, tilt double"


def mixture(docs: DataFrame, targets: DataFrame, tilt: float = 0.6, ranks: str = RANKS) -> DataFrame:
    """(position, doc_id, source, copy, n_tokens): every use of a document; position in [0, 1] is its place in training."""
    counted, rows = plan(docs, targets, tilt, ranks)
    per_source = docs.sparkSession.createDataFrame([tuple(r.values()) for r in rows], _PLAN).where("demand > 0")
    placed = running_position(counted, ["source"], ["draw", "doc_id"], weight="n_tokens").join(per_source.select("source", "cap", "tokens", "demand", "tilt"), "source")
    uses = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.least(F.col("cap") - 1, F.floor(F.col("demand") / F.col("tokens"))).cast("int"))))
    middle = F.col("copy") * F.col("tokens") + F.col("before") + F.col("n_tokens") / 2
    uses = uses.withColumn("u", middle / F.col("demand")).where("u <= 1.0000001")
    # share x (t + tilt (t^2 - t)) = share x u, solved for t
    a, b = F.col("tilt"), 1 - F.col("tilt")
    t = F.when(F.abs(a) < 1e-9, F.col("u")).otherwise((-b + F.sqrt(F.greatest(b * b + 4 * a * F.col("u"), F.lit(0.0)))) / (2 * a))
    order = uses.select(F.round(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), 9).alias("position"), "doc_id", "source", (F.col("copy") + 1).alias("copy"), "n_tokens")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return order.repartitionByRange(parts, "position").sortWithinPartitions("position", "doc_id", "copy")


def shares(docs: DataFrame, targets: DataFrame, tilt: float = 0.6, ranks: str = RANKS) -> DataFrame:
    """Per listed source: target and actual share of all tokens used, documents, uses and most repeats."""
    used = mixture(docs, targets, tilt, ranks)
    got = used.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("tokens")).groupBy("source").agg(F.count("*").alias("docs_used"), F.sum("uses").alias("uses"), F.max("uses").alias("most_repeats"), F.sum("tokens").alias("tokens"))
    total = got.agg(F.sum("tokens").alias("total"))
    want = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return want.join(got, "source", "left").join(F.broadcast(total), how="left").select(  # one row
        "source", F.round("target_share", 6).alias("target_share"), F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"), "max_repeats",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("docs_used", "uses", "most_repeats", "tokens")],
    )
