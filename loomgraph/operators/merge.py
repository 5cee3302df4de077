"""Merging fact sources: column contracts, keep-first rules, labels, event codes and entity JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.schemas import REQUIRED_COLUMNS

#: Root codes of coded events and their relations (fixed values).
ROOT_CODES = {
    "01": "makeStatement", "02": "appeal", "03": "express_intent", "04": "consult", "05": "engage_diplomacy", "06": "cooperate_materially", "07": "provide_aid", "08": "yield", "09": "investigate", "10": "demand",
    "11": "disapprove", "12": "reject", "13": "threaten", "14": "protest", "15": "exhibit_force", "16": "reduce_relations", "17": "coerce", "18": "assault", "19": "fight", "20": "mass_violence",
}
#: Header texts of coded-event files and the columns they stand for (fixed values).
CODED_HEADERS = {
    "Event Date": "event_date", "Source Name": "h_label", "Source Country": "h_country", "Event Text": "event_text", "CAMEO Code": "cameo", "Intensity": "intensity", "Target Name": "t_label", "Target Country": "t_country", "Country": "country", "Latitude": "l_t_lat", "Longitude": "l_t_lon", "Story ID": "story_id",
}


def required_first(df: DataFrame, columns: tuple[str, ...] = REQUIRED_COLUMNS, kinds: dict[str, str] | None = None) -> DataFrame:
    """Missing required columns as nulls, required ones first, extras in their order."""
    kinds = kinds or {}
    kind = lambda c: kinds.get(c, "int" if c.startswith("tau") else "double" if c.startswith("l_") else "string")
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast(kind(c)).alias(c) for c in columns], *[c for c in df.columns if c not in columns])


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key by a total order; nulls in keys are equal. A two-phase minimum over structs, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min(F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], *[c for c in rest])).alias("b"))
    return best.select(*[F.col(c) if c in key else F.col(f"b.{c}").alias(c) for c in df.columns])


def merge_sources(*sources: DataFrame, key: tuple[str, ...] = ("h", "r", "t", "tau_start"), order: str = "fact_id") -> DataFrame:
    """Bag union in the given order, then keep-first on the key with nulls equal."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    return keep_first(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked), list(key), ["source_rank", order])


def is_qid(c: Column) -> Column:
    return F.coalesce(c.rlike("^Q[0-9]+$"), F.lit(False))


def fill_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Empty head and tail labels from labels(id, label), else ''."""
    out = df
    for side in ("h", "t"):
        d = labels.select(F.col("id").alias(f"__{side}"), F.col("label").alias(f"__l{side}"))
        out = out.join(d, out[side] == F.col(f"__{side}"), "left").withColumn(f"{side}_label", F.coalesce(F.nullif(F.col(f"{side}_label"), F.lit("")), F.col(f"__l{side}"), F.lit(""))).drop(f"__{side}", f"__l{side}")
    return out


def both_labels(df: DataFrame) -> DataFrame:
    return df.where("h_label is not null and h_label <> '' and t_label is not null and t_label <> ''")


def any_label(df: DataFrame) -> DataFrame:
    return df.where("coalesce(h_label, '') <> '' or coalesce(t_label, '') <> ''")


def relation_of_code(code: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in ROOT_CODES.items() for x in kv])
    return F.coalesce(m[F.substring(code, 1, 2)], F.lit("interact"))


def coded_events(raw: DataFrame) -> DataFrame:
    """Coded events about the country as facts: rows without labels or with equal ends are left out; ids collide on labels of over 30 characters, as specified."""
    vn = reduce(lambda a, b: a | b, [F.coalesce(F.upper(F.col(c)).rlike("VIE|VIET|VIETNAM|VIET NAM"), F.lit(False)) for c in ("h_country", "t_country", "country") if c in raw.columns])
    h, t = F.trim(F.coalesce("h_label", F.lit(""))), F.trim(F.coalesce("t_label", F.lit("")))
    ident = lambda c: F.concat(F.lit("ICEWS_"), F.substring(F.replace(c, F.lit(" "), F.lit("_")), 1, 30))
    year = F.expr("try_cast(substring(event_date, 1, 4) as int)")
    out = raw.where(vn).where((h != "") & (t != "") & (h != t))
    return out.select(
        ident(h).alias("h"), h.alias("h_label"), relation_of_code(F.col("cameo")).alias("r"), ident(t).alias("t"), t.alias("t_label"), year.alias("tau_start"), year.alias("tau_end"),
        F.lit(None).cast("double").alias("l_h_lat"), F.lit(None).cast("double").alias("l_h_lon"), "l_t_lat", "l_t_lon", F.lit("ICEWS").alias("source"), *[c for c in ("ord",) if c in raw.columns],
    )


ENTITY_JSON = "labels map<string,struct<value:string>>, claims map<string,array<struct<mainsnak:struct<datavalue:struct<value:struct<id:string>>>,qualifiers:map<string,array<struct<datavalue:struct<value:struct<time:string>>>>>>>>"
CLAIM_RELATIONS = {"P19": "bornIn", "P20": "diedIn", "P276": "occurredAt", "P131": "locatedIn"}


def entity_claims(entities: DataFrame) -> DataFrame:
    """Rows (h, h_label, r, t, tau_start) of entities(qid, json): vi label, else en, else ''; year digits of the first readable P580 time.

    The sign of the year is dropped, as specified. Broken JSON gives no rows.
    """
    e = entities.select("qid", F.from_json("json", ENTITY_JSON).alias("e")).where("e is not null")
    label = F.coalesce(F.col("e.labels")["vi"]["value"], F.col("e.labels")["en"]["value"], F.lit(""))
    claims = e.select("qid", label.alias("h_label"), F.explode("e.claims").alias("prop", "cs")).select("qid", "h_label", "prop", F.posexplode("cs").alias("pos", "c"))
    times = F.transform(F.col("c.qualifiers")["P580"], lambda q: F.try_to_number(F.regexp_extract(q["datavalue"]["value"]["time"], r"^[+-]([0-9]{4})", 1), F.lit("9999")).cast("int"))
    known = F.create_map(*[F.lit(x) for kv in CLAIM_RELATIONS.items() for x in kv])
    out = claims.select(F.col("qid").alias("h"), "h_label", known[F.col("prop")].alias("r"), F.col("c.mainsnak.datavalue.value.id").alias("t"), F.try_element_at(F.filter(times, lambda x: x.isNotNull()), F.lit(1)).alias("tau_start"), "pos")
    return out.where("r is not null and t is not null")


def triple_json(triplets: Column) -> Column:
    """JSON text of an array of triplets, [] for none."""
    return F.coalesce(F.to_json(triplets), F.lit("[]"))


def flatten_binding(json: Column, *keys: str) -> list[Column]:
    """SPARQL JSON binding {k: {value}} as flat columns; a missing key gives ''."""
    return [F.coalesce(F.get_json_object(json, f"$.{k}.value"), F.lit("")).alias(k) for k in keys]


def empty_like(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)
