"""Queries on merging fact sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import merge as mg
from loomgraph.plans.base import EVENTS_SQL, FACTS_SQL, Book, events, facts
from loomgraph.session import table

book = Book()
_K = "h, r, t, tau_start"


@book.add("merge_keep_first_fact", f"WITH {EVENTS_SQL} SELECT fact_id, h, r, t, tau_start FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY fact_id) AS rn FROM ev) WHERE rn = 1")
def _(spark, d):
    return mg.keep_first(events(spark, d), ["h", "r", "t", "tau_start"], ["fact_id"]).select("fact_id", "h", "r", "t", "tau_start")


@book.add("merge_keep_first_triple", f"WITH {EVENTS_SQL} SELECT fact_id, h, r, t FROM (SELECT *, row_number() OVER (PARTITION BY h, r, t ORDER BY fact_id) AS rn FROM ev) WHERE rn = 1")
def _(spark, d):
    return mg.keep_first(events(spark, d), ["h", "r", "t"], ["fact_id"]).select("fact_id", "h", "r", "t")


@book.add("merge_keep_first_labels", f"WITH {EVENTS_SQL} SELECT fact_id, h_label, r, t_label, tau_start FROM (SELECT *, row_number() OVER (PARTITION BY h_label, r, t_label, tau_start ORDER BY fact_id) AS rn FROM ev) WHERE rn = 1")
def _(spark, d):
    return mg.keep_first(events(spark, d), ["h_label", "r", "t_label", "tau_start"], ["fact_id"]).select("fact_id", "h_label", "r", "t_label", "tau_start")


@book.add("merge_three_sources", f"""WITH {FACTS_SQL}, {EVENTS_SQL}, u AS (SELECT 0 AS source_rank, fact_id, h, r, t, tau_start FROM facts UNION ALL SELECT 1, fact_id, h, r, t, tau_start FROM ev UNION ALL SELECT 2, fact_id, h, r, t, NULL FROM ev)
    SELECT source_rank, fact_id, h, r, t, tau_start FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY source_rank, fact_id) AS rn FROM u) WHERE rn = 1""")
def _(spark, d):
    c = ["fact_id", "h", "r", "t", "tau_start"]
    e = events(spark, d)
    third = e.select("fact_id", "h", "r", "t")
    return mg.merge_sources(facts(spark, d).select(c), e.select(c), third).select("source_rank", *c)


@book.add("merge_union_files", f"WITH {FACTS_SQL}, {EVENTS_SQL} SELECT src_file, count(*) AS n, count(DISTINCT h) AS n_heads FROM (SELECT h, 'facts' AS src_file FROM facts UNION ALL SELECT h, 'events' FROM ev) GROUP BY src_file")
def _(spark, d):
    u = facts(spark, d).select("h").withColumn("src_file", F.lit("facts")).unionByName(events(spark, d).select("h").withColumn("src_file", F.lit("events")))
    return u.groupBy("src_file").agg(F.count("*").alias("n"), F.countDistinct("h").alias("n_heads"))


@book.add("merge_required_columns", f"WITH {EVENTS_SQL} SELECT h, h_label, r, t, t_label, tau_start, CAST(NULL AS INTEGER) AS tau_end, l_h_lat, l_h_lon, l_t_lat, l_t_lon, fact_id FROM ev")
def _(spark, d):
    return mg.required_first(events(spark, d))


@book.add("merge_base_prep", f"WITH {EVENTS_SQL} SELECT fact_id, h, tau_start AS tau_end, 'Wikidata' AS source FROM ev WHERE h LIKE 'Q%'")
def _(spark, d):
    return events(spark, d).where(F.col("h").startswith("Q")).select("fact_id", "h", F.col("tau_start").alias("tau_end"), F.lit("Wikidata").alias("source"))


@book.add("merge_is_qid", f"WITH {EVENTS_SQL} SELECT fact_id, coalesce(regexp_matches(h, '^Q[0-9]+$'), false) AS is_qid FROM ev")
def _(spark, d):
    return events(spark, d).select("fact_id", mg.is_qid(F.col("h")).alias("is_qid"))


LABEL_SQL = "lab AS (SELECT t AS id, min(t_label) AS label FROM historical_events WHERE t_label IS NOT NULL AND t_label <> '' GROUP BY t)"
FILL_SQL = f"{EVENTS_SQL}, {LABEL_SQL}, filled AS (SELECT fact_id, h, t, coalesce(nullif(h_label, ''), a.label, '') AS h_label, coalesce(nullif(t_label, ''), b.label, '') AS t_label FROM ev LEFT JOIN lab a ON ev.h = a.id LEFT JOIN lab b ON ev.t = b.id)"


def filled(spark, d):
    lab = table(spark, d, "historical_events").where("t_label is not null and t_label <> ''").groupBy(F.col("t").alias("id")).agg(F.min("t_label").alias("label"))
    return mg.fill_labels(events(spark, d), lab).select("fact_id", "h", "t", "h_label", "t_label")


@book.add("merge_fill_labels", f"WITH {FILL_SQL} SELECT * FROM filled")
def _(spark, d):
    return filled(spark, d)


@book.add("merge_both_labels", f"WITH {FILL_SQL} SELECT fact_id FROM filled WHERE h_label <> '' AND t_label <> ''")
def _(spark, d):
    return mg.both_labels(filled(spark, d)).select("fact_id")


@book.add("merge_any_label", f"WITH {EVENTS_SQL} SELECT fact_id FROM ev WHERE coalesce(h_label, '') <> '' OR coalesce(t_label, '') <> ''")
def _(spark, d):
    return mg.any_label(events(spark, d)).select("fact_id")


@book.add("merge_tail_label", f"WITH {EVENTS_SQL}, {LABEL_SQL} SELECT fact_id, coalesce(label, '') AS label FROM ev LEFT JOIN lab ON ev.t = lab.id")
def _(spark, d):
    lab = table(spark, d, "historical_events").where("t_label is not null and t_label <> ''").groupBy(F.col("t").alias("id")).agg(F.min("t_label").alias("label"))
    return events(spark, d).join(lab, F.col("t") == F.col("id"), "left").select("fact_id", F.coalesce("label", F.lit("")).alias("label"))


@book.add("merge_summary", f"WITH {EVENTS_SQL} SELECT count(*) AS n, count(DISTINCT h) AS n_h, count(DISTINCT r) AS n_r, count(DISTINCT t) AS n_t, round(100.0 * count(tau_start) / count(*), 4) AS pct_tau, round(100.0 * count(l_h_lat) / count(*), 4) AS pct_h, CAST(sum(CASE WHEN h LIKE 'Q%' THEN 1 ELSE 0 END) AS BIGINT) AS n_qid FROM ev")
def _(spark, d):
    p = lambda c: F.round(100.0 * F.count(c) / F.count("*"), 4)
    return events(spark, d).agg(F.count("*").alias("n"), F.countDistinct("h").alias("n_h"), F.countDistinct("r").alias("n_r"), F.countDistinct("t").alias("n_t"), p("tau_start").alias("pct_tau"), p("l_h_lat").alias("pct_h"), F.sum(F.col("h").startswith("Q").cast("int")).alias("n_qid"))


def _gate(name, src_sql, src, sql_checks, checks):
    cond = " AND ".join(f"({c})" for _, c in sql_checks)
    failed = ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in sql_checks)

    @book.add(name, f"WITH {src_sql} SELECT coalesce({cond}, false) AS passed, concat_ws('; ', {failed}) AS failed FROM {src}")
    def _(spark, d):
        from loomgraph.operators.spatial import gate

        return gate(events(spark, d) if src == "ev" else facts(spark, d), {n: F.expr(e) for n, e in checks})


_gate("gate_collected", EVENTS_SQL, "ev", [("rows", "count(*) > 100"), ("tau", "100.0 * count(tau_start) / count(*) > 50"), ("h", "100.0 * count(h) / count(*) > 99")], [("rows", "count(1) > 100"), ("tau", "100.0 * count(tau_start) / count(1) > 50"), ("h", "100.0 * count(h) / count(1) > 99")])
_gate("gate_merged", FACTS_SQL, "facts", [("entities", "count(DISTINCT h) > 750"), ("labels", "100.0 * count(h_label) / count(*) > 80"), ("coords", "100.0 * count(l_t_lat) / count(*) > 60"), ("tau", "100.0 * count(tau_start) / count(*) > 70")], [("entities", "count(distinct h) > 750"), ("labels", "100.0 * count(h_label) / count(1) > 80"), ("coords", "100.0 * count(l_t_lat) / count(1) > 60"), ("tau", "100.0 * count(tau_start) / count(1) > 70")])
_gate("gate_final", FACTS_SQL, "facts", [("facts", "count(*) > 800"), ("images", "count(source) > 100000")], [("facts", "count(1) > 800"), ("images", "count(source) > 100000")])


@book.add("merge_top_relations", f"WITH {FACTS_SQL} SELECT r, count(*) AS n FROM facts GROUP BY r ORDER BY n DESC, r LIMIT 10")
def _(spark, d):
    return facts(spark, d).groupBy("r").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "r").limit(10)


# coded events made of orders, customers and nations
CODED_SQL = """raw AS (SELECT o_orderkey AS ord, strftime(o_orderdate, '%Y-%m-%d') AS event_date, c_name AS h_label, n_name AS t_label, CASE WHEN o_orderkey % 4 = 0 THEN 'Viet Nam' ELSE n_name END AS h_country, n_name AS t_country, CASE WHEN o_orderkey % 11 = 0 THEN 'VIETNAM' ELSE 'X' END AS country,
    lpad(CAST(o_orderkey % 230 AS VARCHAR), 3, '0') AS cameo, CAST(n_nationkey AS DOUBLE) AS l_t_lat, CAST(n_regionkey AS DOUBLE) AS l_t_lon FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def coded_raw(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    return j.selectExpr("o_orderkey as ord", "date_format(o_orderdate, 'yyyy-MM-dd') as event_date", "c_name as h_label", "n_name as t_label", "case when o_orderkey % 4 = 0 then 'Viet Nam' else n_name end as h_country", "n_name as t_country",
        "case when o_orderkey % 11 = 0 then 'VIETNAM' else 'X' end as country", "lpad(cast(o_orderkey % 230 as string), 3, '0') as cameo", "cast(n_nationkey as double) as l_t_lat", "cast(n_regionkey as double) as l_t_lon")


_CODES_SQL = "CASE substring(cameo, 1, 2) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mg.ROOT_CODES.items()) + " ELSE 'interact' END"
CODED_FACTS_SQL = f"""{CODED_SQL}, coded AS (SELECT ord, 'ICEWS_' || substring(replace(trim(h_label), ' ', '_'), 1, 30) AS h, trim(h_label) AS h_label, {_CODES_SQL} AS r, 'ICEWS_' || substring(replace(trim(t_label), ' ', '_'), 1, 30) AS t, trim(t_label) AS t_label, TRY_CAST(substring(event_date, 1, 4) AS INTEGER) AS tau_start, l_t_lat, l_t_lon
    FROM raw WHERE (contains(upper(h_country), 'VIE') OR contains(upper(t_country), 'VIE') OR contains(upper(country), 'VIE')) AND trim(h_label) <> '' AND trim(t_label) <> '' AND trim(h_label) <> trim(t_label))"""


@book.add("coded_events", f"WITH {CODED_FACTS_SQL} SELECT * FROM coded")
def _(spark, d):
    return mg.coded_events(coded_raw(spark, d)).select("ord", "h", "h_label", "r", "t", "t_label", "tau_start", "l_t_lat", "l_t_lon")


@book.add("coded_events_dedup", f"WITH {CODED_FACTS_SQL} SELECT ord, h_label, r, t_label, tau_start FROM (SELECT *, row_number() OVER (PARTITION BY h_label, r, t_label, tau_start ORDER BY ord) AS rn FROM coded) WHERE rn = 1")
def _(spark, d):
    return mg.keep_first(mg.coded_events(coded_raw(spark, d)), ["h_label", "r", "t_label", "tau_start"], ["ord"]).select("ord", "h_label", "r", "t_label", "tau_start")


# entity JSON made of events
JSON_SQL = """ent AS (SELECT row_id, h AS qid, '{"labels":{' || CASE WHEN row_id % 3 = 0 THEN '' ELSE '"vi":{"value":"L' || CAST(row_id AS VARCHAR) || '"}' || CASE WHEN row_id % 2 = 0 THEN ',' ELSE '' END END || CASE WHEN row_id % 2 = 0 THEN '"en":{"value":"E' || CAST(row_id AS VARCHAR) || '"}' ELSE '' END || '},"claims":{"P276":[{"mainsnak":{"datavalue":{"value":{"id":"' || t || '"}}},"qualifiers":{"P580":[{"datavalue":{"value":{"time":"+' || lpad(CAST(1000 + row_id % 900 AS VARCHAR), 4, '0') || '-01-01T00:00:00Z"}}}]}}]}}' AS json FROM historical_events)"""


@book.add("entity_json_claims", f"""WITH {JSON_SQL} SELECT row_id, qid AS h, CASE WHEN row_id % 3 <> 0 THEN 'L' || row_id WHEN row_id % 2 = 0 THEN 'E' || row_id ELSE '' END AS h_label, 'occurredAt' AS r, json_extract_string(json, '$.claims.P276[0].mainsnak.datavalue.value.id') AS t, CAST(substring(json_extract_string(json, '$.claims.P276[0].qualifiers.P580[0].datavalue.value.time'), 2, 4) AS INTEGER) AS tau_start FROM ent""")
def _(spark, d):
    e = table(spark, d, "historical_events").selectExpr("row_id", "h as qid", """concat('{"labels":{', case when row_id % 3 = 0 then '' else concat('"vi":{"value":"L', row_id, '"}', case when row_id % 2 = 0 then ',' else '' end) end, case when row_id % 2 = 0 then concat('"en":{"value":"E', row_id, '"}') else '' end,
        '},"claims":{"P276":[{"mainsnak":{"datavalue":{"value":{"id":"', t, '"}}},"qualifiers":{"P580":[{"datavalue":{"value":{"time":"+', lpad(cast(1000 + row_id % 900 as string), 4, '0'), '-01-01T00:00:00Z"}}}]}}]}}') as json""")
    claims = mg.entity_claims(e.select(F.col("row_id").cast("string").alias("qid"), "json")).withColumnRenamed("h", "row_id")
    return claims.select(F.col("row_id").cast("long").alias("row_id"), "h_label", "r", "t", "tau_start").join(e.select("row_id", F.col("qid").alias("h")), "row_id")


@book.add("binding_flatten", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@book.add("merge_distinct_heads", f"WITH {EVENTS_SQL} SELECT h, h_label FROM (SELECT h, h_label, row_number() OVER (PARTITION BY h ORDER BY fact_id) AS rn FROM ev) WHERE rn = 1")
def _(spark, d):
    return mg.keep_first(events(spark, d).select("fact_id", "h", "h_label"), ["h"], ["fact_id"]).select("h", "h_label")


@book.add("merge_entity_list", f"""WITH {EVENTS_SQL}, u AS (SELECT fact_id, 0 AS side, h AS qid, h_label AS label FROM ev UNION ALL SELECT fact_id, 1, t, t_label FROM ev) SELECT qid, label FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fact_id, side) AS rn FROM u WHERE regexp_matches(qid, '^Q[0-9]+$')) WHERE rn = 1""")
def _(spark, d):
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("h").alias("qid"), F.col("h_label").alias("label")), F.struct(F.lit(1).alias("side"), F.col("t").alias("qid"), F.col("t_label").alias("label")))).alias("e")
    u = events(spark, d).select("fact_id", ends).select("fact_id", "e.side", "e.qid", "e.label").where(mg.is_qid(F.col("qid")))
    return mg.keep_first(u, ["qid"], ["fact_id", "side"]).select("qid", "label")
