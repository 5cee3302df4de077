"""Visual facts: caption triplets, label index with last-value coordinates, concept scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.schemas import DEFAULT_LAT, DEFAULT_LON
from loomgraph.session import cut

#: Caption families in order (fixed values): actions, positions, plain prepositions.
FAMILIES = (
    r"(?:a |an |the )?(\w+)\s+(riding|holding|carrying|wearing|eating|standing near|sitting on|looking at|walking through|running in)\s+(?:a |an |the )?(.+?)(?:\s+in|\s+at|\s+on|$)",
    r"(?:a |an |the )?(\w+)\s+(in front of|next to|beside|inside|outside|on top of)\s+(?:a |an |the )?(.+?)(?:\.|$)",
    r"(?:a |an |the )?(\w+)\s+(on|in|at|near|by)\s+(?:a |an |the )?(.+?)(?:\.|$)",
)
#: Relations of the six question kinds (fixed values).
QA_RELATIONS = {1: "hasObject", 2: "hasColor", 3: "hasCount", 4: "isPresent", 5: "hasActivity", 6: "hasLocation"}
PREDICATES = {"bornIn": "depicts_birthplace_of", "diedIn": "depicts_deathplace_of", "occurredAt": "depicts_event_at", "locatedIn": "depicts_location_of"}


def caption_triplets(captions: DataFrame, most: int = 5) -> DataFrame:
    """(image_file, pos, subject, predicate, object) of captions(image_file, caption): all matches of the first family that has one, at most five;
    without any, the first words of captions of three words and more."""
    low = F.lower("caption")
    found = []
    for p in FAMILIES:
        parts = [F.regexp_extract_all(low, F.lit("(?U)" + p), F.lit(g)) for g in (1, 2, 3)]
        found.append(F.arrays_zip(*[x.alias(n) for x, n in zip(parts, ("subject", "predicate", "object"))]))
    words = F.filter(F.split(F.trim(low), r"\s+"), lambda x: x != "")
    df = captions.select("image_file", *[f.alias(f"f{i}") for i, f in enumerate(found)], words.alias("w"))
    shaped = []
    for i in range(3):
        shaped.append(F.when(F.size(f"f{i}") > 0, F.transform(f"f{i}", lambda s: F.struct(*[F.trim(s[n]).alias(n) for n in ("subject", "predicate", "object")]))))
    plain = F.when(F.size("w") >= 3, F.array(F.struct(F.element_at("w", 1).alias("subject"), F.element_at("w", 2).alias("predicate"), F.array_join(F.slice("w", 3, 3), " ").alias("object"))))
    return df.select("image_file", F.posexplode(F.slice(F.coalesce(*shaped, plain), 1, most)).alias("pos", "t")).select("image_file", "pos", "t.subject", "t.predicate", "t.object")


def image_id(file: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(file, F.lit("COCO_val2014_"), F.lit("")), F.lit(".jpg"), F.lit("")), "^0+", "")


def image_file(img: Column) -> Column:
    return F.format_string("COCO_val2014_%012d.jpg", img)


def qa_triplets(qa: DataFrame) -> DataFrame:
    """(subject, predicate, object, image_file, source) of qa(img_id, question, answer, type, split)."""
    rel = F.create_map(*[F.lit(x) for kv in QA_RELATIONS.items() for x in kv])
    return qa.select(F.concat(F.lit("image_"), F.col("img_id").cast("string")).alias("subject"), F.coalesce(rel[F.col("type")], F.lit("hasAttribute")).alias("predicate"), F.col("answer").alias("object"), image_file(F.col("img_id")).alias("image_file"), F.concat(F.lit("ViVQA-"), "split").alias("source"))


def label_index(facts: DataFrame) -> DataFrame:
    """(key, lat, lon, pos): labels in lower case with both coordinates, h before t; the last value wins, the first position stays."""
    side = lambda i, s: F.struct(F.lit(i).alias("side"), F.col(f"{s}_label").alias("label"), F.col(f"l_{s}_lat").alias("lat"), F.col(f"l_{s}_lon").alias("lon"))
    e = facts.select("fact_id", F.explode(F.array(side(0, "h"), side(1, "t"))).alias("e")).where("e.label is not null and e.lat is not null and e.lon is not null")
    o = F.struct("fact_id", "e.side")
    last = F.max(F.struct(o.alias("o"), F.col("e.lat").alias("lat"), F.col("e.lon").alias("lon")))
    return e.groupBy(F.lower(F.trim("e.label")).alias("key")).agg(last.alias("m"), F.min(o).alias("pos")).select("key", F.col("m.lat").alias("lat"), F.col("m.lon").alias("lon"), "pos")


#: Bytes of a long pattern's head that are looked up first, and bits of the largest filter.
HEAD, FILTER_BITS = 8, 1 << 26
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, where each begins, sums for hashes of any window, and the powers that make them independent of the place."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    power = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), base, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power(_BASE)[:-1])])
    return data, ends - ends[0], sums, power(pow(_BASE, -1, 1 << 64))


def _spots(sums: np.ndarray, back: np.ndarray, at: np.ndarray, size: np.ndarray | int, kind: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter for each window of `size` bytes; kind keeps heads and whole patterns apart."""
    h = (sums[at + size] - sums[at]) * back[at] + np.asarray(size * 2 + kind, np.uint64)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return (h & np.uint64(bits - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def with_pieces(texts: DataFrame, text: str, patterns: DataFrame, most: int = FILTER_BITS) -> DataFrame:
    """Adds `piece` to texts: a row for every part of the text that is one of patterns (one column without empty texts), and for few others.

    Every window of every length that patterns have is tried against a filter of their hashes, so only parts that are patterns, and a share of the rest that the filter cannot tell from them, leave the
    task; who joins on `piece` keeps the former. The filter has 32 bits per pattern and at most `most` (8 MB, whatever the size of the tables); beyond that more rows leave, none is lost.
    """
    spark = texts.sparkSession
    name = patterns.columns[0]
    n, sizes = patterns.agg(F.count(name), F.array_sort(F.collect_set(F.octet_length(name)))).first()  # lengths, not patterns
    bits = 1 << max(15, min(most.bit_length() - 1, (32 * n - 1).bit_length() if n else 0))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, ends, sums, back = _bytes(b.column(0))
            size = np.diff(ends)
            at, long = ends[:-1], size >= HEAD
            found = np.concatenate([*_spots(sums, back, at, size, 0, bits), *_spots(sums, back, at[long], HEAD, 1, bits)])
            yield pa.RecordBatch.from_arrays([pa.array(found + 1, pa.int64())], names=["at"])

    parts = patterns.mapInArrow(mark, "at long").select(F.bitmap_bucket_number("at").alias("b"), F.bitmap_bit_position("at").alias("at"))
    kept = np.zeros(bits // 8, np.uint8)
    for r in parts.repartition("b").groupBy("b").agg(F.bitmap_construct_agg("at").alias("v")).toLocalIterator():  # bits / 8 bytes in all
        kept[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["v"], np.uint8)
    shared = spark.sparkContext.broadcast(kept)
    columns = texts.columns
    where = columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value

        def there(sums, back, at, size, kind):
            one, two = _spots(sums, back, at, size, kind, bits)
            hit = np.flatnonzero(kept[one >> 3] >> (one & 7) & 1)
            two = two[hit]
            return hit[(kept[two >> 3] >> (two & 7) & 1).astype(bool)]

        for whole in batches:
            long = np.cumsum(pc.fill_null(pc.binary_length(whole.column(where)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(long >> 19)) + 1).tolist(), whole.num_rows]  # about half a MB of text at once
            for i, j in zip(cuts, cuts[1:]):
                b = whole.slice(i, j - i)
                data, ends, sums, back = _bytes(b.column(where))
                first = np.append((data & 0xC0) != 0x80, True)  # a character begins here
                at = np.flatnonzero(first[:-1])
                row = np.searchsorted(ends, at, "right") - 1
                left = ends[row + 1] - at
                head = np.flatnonzero(left >= HEAD)
                head = head[there(sums, back, at[head], HEAD, 1)]
                for size in sizes:
                    ok = head if size >= HEAD else np.arange(len(at))
                    ok = ok[left[ok] >= size]
                    ok = ok[first[at[ok] + size]]
                    ok = ok[there(sums, back, at[ok], size, 0)]
                    raw = data.tobytes() if len(ok) else b""
                    for k in range(0, len(ok), 8192):
                        some = ok[k : k + 8192]
                        piece = pa.array([raw[p : p + size] for p in at[some].tolist()], pa.binary()).view(pa.string())
                        out = b.take(pa.array(row[some]))
                        yield pa.RecordBatch.from_arrays([*out.columns, piece], names=[*columns, "piece"])

    return texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(scan, T.StructType([*texts.schema.fields, T.StructField("piece", T.StringType())]))


def resolve(entities: DataFrame, index: DataFrame) -> DataFrame:
    """(entity, lat, lon, how): exact label, else the first index label that contains the entity or is contained in it, else the default point.

    The substring step joins on whole texts: parts of an entity that are labels, and parts of a label that are entities (`with_pieces`), so nothing is compared with everything and no pair is
    built that does not hold. Of a text that many labels contain each task keeps the first label only.
    """
    index = cut(index)
    keyed = entities.select("entity").distinct().withColumn("key", F.lower(F.trim("entity")))
    exact = cut(keyed.join(index.select("key", "lat", "lon", F.lit("exact").alias("how")), "key", "left"))
    miss = exact.where("how is null").select("entity", "key")
    keys = cut(miss.where("key <> ''").select("key").distinct())
    labels = index.where("key <> ''").select(F.col("key").alias("label"), F.struct("pos", "lat", "lon").alias("m"))
    inside = with_pieces(keys, "key", labels.select("label")).join(labels.withColumnRenamed("label", "piece"), "piece").select("key", "m")
    around = with_pieces(labels, "label", keys).select(F.col("piece").alias("key"), "m")
    blank = keys.join(F.broadcast(index.where("key = ''").select(F.struct("pos", "lat", "lon").alias("m"))))  # an empty label, one row at most, is within every key
    hits = inside.unionByName(around).unionByName(blank).groupBy("key").agg(F.min("m").alias("m"))
    empty = index.agg(F.min(F.struct("pos", "lat", "lon")).alias("m")).where("m is not null").select(F.lit("").alias("key"), "m")  # an empty key is within the first label
    first = miss.join(hits.unionByName(empty), "key").select("entity", F.col("m.lat").alias("lat2"), F.col("m.lon").alias("lon2"))
    out = exact.join(first, "entity", "left")
    return out.select("entity", F.coalesce("lat", "lat2", F.lit(DEFAULT_LAT)).alias("lat"), F.coalesce("lon", "lon2", F.lit(DEFAULT_LON)).alias("lon"), F.when(F.col("how").isNotNull(), "exact").when(F.col("lat2").isNotNull(), "contains").otherwise("default").alias("how"))


def concept_triplets(scores: DataFrame, top: int = 3, threshold: float = 0.2) -> DataFrame:
    """Best concepts per image of scores(img, relation, concept, concept_ord, score): several descriptions of a concept count by their best, floor 0."""
    best = scores.groupBy("img", "relation", "concept", "concept_ord").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score")).where(F.col("score") >= threshold)
    pred = F.create_map(*[F.lit(x) for kv in PREDICATES.items() for x in kv])
    ranked = best.withColumn("rk", F.row_number().over(W.partitionBy("img").orderBy(F.desc("score"), "concept_ord"))).where(F.col("rk") <= top)
    return ranked.select("img", "rk", F.coalesce(pred[F.col("relation")], F.lit("depicts")).alias("predicate"), F.col("concept").alias("object"), F.bround("score", 4).alias("confidence"))


def image_url(name: Column) -> Column:
    """File path of an image by name, spaces as _ and the rest percent-encoded but for slashes."""
    return F.concat(F.lit("https://commons.wikimedia.org/wiki/Special:FilePath/"), F.replace(F.url_encode(F.replace(name, F.lit(" "), F.lit("_"))), F.lit("%2F"), F.lit("/")), F.lit("?width=400"))


def concept_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "concept string, concept_ord int, description string")
