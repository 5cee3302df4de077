"""Queries on splits, samples and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import questions as qs
from loomgraph.operators import splits as sp
from loomgraph.plans.base import FACTS_SQL, Book, facts
from loomgraph.plans.questions import CAND_SQL, DEDUP_SQL, IMG_SQL, TEXT_SQL, images
from loomgraph.plans.spatial import enriched
from loomgraph.session import table

book = Book()


def split_sql(src: str, key: str = "fact_id") -> str:
    return f"""f0 AS (SELECT fact_id, relation FROM (SELECT fact_id, relation, row_number() OVER (PARTITION BY fact_id ORDER BY qid) AS rn FROM {src} WHERE fact_id IS NOT NULL) WHERE rn = 1),
    f1 AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY md5('42|' || CAST(fact_id AS VARCHAR)), fact_id) AS rn, count(*) OVER (PARTITION BY relation) AS n FROM f0),
    asg AS (SELECT fact_id, relation, CASE WHEN rn <= round_even(0.8 * n, 0) THEN 'train' WHEN rn <= round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 'val' ELSE 'test' END AS split FROM f1)"""


@book.add("split_by_fact", f"WITH {split_sql('questions')} SELECT fact_id, relation, split FROM asg")
def _(spark, d):
    return sp.split_by_fact(table(spark, d, "questions"))


@book.add("split_questions", f"WITH {split_sql('questions')} SELECT qid, split FROM questions LEFT JOIN asg USING (fact_id)")
def _(spark, d):
    q = table(spark, d, "questions")
    return q.join(sp.split_by_fact(q).select("fact_id", "split"), "fact_id", "left").select("qid", "split")


def flagship_counts(spark, d):
    q = qs.generate(enriched(spark, d)).withColumn("qid", F.format_string("f%09d-%02d", "fact_id", "template_ord"))
    kept = qs.dedupe(q)
    return kept.join(sp.split_by_fact(kept).select("fact_id", "split"), "fact_id").groupBy("relation", "split").agg(F.count("*").alias("n_questions"), F.countDistinct("fact_id").alias("n_facts"))


FLAG_SQL = f"""WITH {CAND_SQL}, gen AS (SELECT *, printf('f%09d-%02d', fact_id, template_ord) AS qid, {TEXT_SQL} AS question, CASE WHEN s IN ('historical_figures','landmarks','historical_events') THEN 1 WHEN s = 'historical_events_timeline' THEN 2 WHEN s = 'heritage_sites' THEN 3 ELSE 99 END AS p
      FROM (SELECT *, regexp_replace(lower(trim(regexp_replace(trim(source), '^.*/', ''))), '\\.csv$', '') AS s FROM cand WHERE reason = '')),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY p, fact_id, qid) AS rk FROM gen) WHERE rk = 1), {split_sql('kept')}
    SELECT k.relation, split, count(*) AS n_questions, count(DISTINCT fact_id) AS n_facts FROM kept k JOIN asg USING (fact_id) GROUP BY 1, 2"""
book.add("flagship_relation_split", FLAG_SQL)(flagship_counts)


@book.add("split_leakage", "SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_facts FROM (SELECT DISTINCT fact_id, split FROM questions JOIN split_members USING (qid)) a JOIN (SELECT DISTINCT fact_id, split FROM questions JOIN split_members USING (qid)) b ON a.fact_id = b.fact_id AND a.split < b.split GROUP BY 1, 2")
def _(spark, d):
    return sp.leakage(table(spark, d, "questions").select("qid", "fact_id").join(table(spark, d, "split_members").select("qid", "split"), "qid"))


ENT_SQL = "SELECT split, count(DISTINCT e) AS n_entities FROM (SELECT split, coalesce(h, 'nan') AS e FROM sq UNION ALL SELECT split, coalesce(t, 'nan') FROM sq) GROUP BY split"


@book.add("split_overview", f"""WITH {split_sql('questions')}, sq AS (SELECT q.*, split FROM questions q JOIN asg USING (fact_id)), ent AS ({ENT_SQL})
    SELECT split, count(DISTINCT fact_id) AS n_facts, any_value(n_entities) AS n_entities, count(*) AS n_questions, round(avg(len(list_filter(string_split_regex(trim(question), '[ \\t\\n\\r]+'), lambda x: x <> ''))), 2) AS avg_question_len_words FROM sq JOIN ent USING (split) GROUP BY split""")
def _(spark, d):
    q = table(spark, d, "questions")
    s = q.join(sp.split_by_fact(q).select("fact_id", "split"), "fact_id")
    words = F.size(F.filter(F.split(F.trim("question"), r"[ \t\n\r]+"), lambda x: x != ""))
    ent = s.select("split", F.explode(F.array(F.coalesce("h", F.lit("nan")), F.coalesce("t", F.lit("nan")))).alias("e")).groupBy("split").agg(F.countDistinct("e").alias("n_entities"))
    base = s.groupBy("split").agg(F.countDistinct("fact_id").alias("n_facts"), F.count("*").alias("n_questions"), F.round(F.avg(words), 2).alias("avg_question_len_words"))
    return base.join(F.broadcast(ent), "split").select("split", "n_facts", "n_entities", "n_questions", "avg_question_len_words")


@book.add("split_by_relation", f"""WITH {split_sql('questions')}, sq AS (SELECT split, q.relation FROM questions q JOIN asg USING (fact_id)), grid AS (SELECT * FROM (VALUES ('train'),('val'),('test')) s(split), (VALUES ('bornIn'),('diedIn'),('occurredAt'),('locatedIn')) r(relation)),
    c AS (SELECT split, relation, count(*) AS n FROM sq GROUP BY 1, 2) SELECT g.split, g.relation, coalesce(n, 0) AS n_questions, round(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.split), 2) AS pct_of_split FROM grid g LEFT JOIN c USING (split, relation)""")
def _(spark, d):
    from pyspark.sql import Window as W

    q = table(spark, d, "questions")
    c = q.join(sp.split_by_fact(q).select("fact_id", "split"), "fact_id").groupBy("split", "relation").agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(s, r) for s in ("train", "val", "test") for r in ("bornIn", "diedIn", "occurredAt", "locatedIn")], "split string, relation string")
    g = grid.join(c, ["split", "relation"], "left").select("split", "relation", F.coalesce("n", F.lit(0)).alias("n_questions"))
    return g.withColumn("pct_of_split", F.round(100.0 * F.col("n_questions") / F.sum("n_questions").over(W.partitionBy("split")), 2))


@book.add("split_relation_crosstab", f"""WITH {split_sql('questions')}, sq AS (SELECT split, q.relation FROM questions q JOIN asg USING (fact_id))
    SELECT relation, round(avg(CASE WHEN split = 'test' THEN 1 ELSE 0 END), 3) AS test, round(avg(CASE WHEN split = 'train' THEN 1 ELSE 0 END), 3) AS train, round(avg(CASE WHEN split = 'val' THEN 1 ELSE 0 END), 3) AS val FROM sq GROUP BY relation""")
def _(spark, d):
    q = table(spark, d, "questions")
    s = q.join(sp.split_by_fact(q).select("fact_id", "split"), "fact_id")
    p = s.groupBy("relation").pivot("split", ["test", "train", "val"]).count().na.fill(0)
    total = F.col("test") + F.col("train") + F.col("val")
    return p.select("relation", *[F.round(F.col(x) / total, 3).alias(x) for x in ("test", "train", "val")])


@book.add("split_distinct_entities", f"WITH {FACTS_SQL} SELECT count(DISTINCT e) AS n_entities FROM (SELECT coalesce(h, 'nan') AS e FROM facts UNION ALL SELECT coalesce(t, 'nan') FROM facts)")
def _(spark, d):
    return facts(spark, d).select(F.explode(F.array(F.coalesce("h", F.lit("nan")), F.coalesce("t", F.lit("nan")))).alias("e")).agg(F.countDistinct("e").alias("n_entities"))


QUOTA_SQL = """sz AS (SELECT relation, count(*) AS size FROM questions GROUP BY relation), q0 AS (SELECT relation, size, least(CAST(round_even(500.0 * size / sum(size) OVER (), 0) AS BIGINT), size) AS quota FROM sz),
    quo AS (SELECT relation, size, CASE WHEN row_number() OVER (ORDER BY size DESC, relation) = 1 THEN least(quota + least(500, CAST(sum(size) OVER () AS BIGINT)) - CAST(sum(quota) OVER () AS BIGINT), size) ELSE quota END AS quota FROM q0)"""
SAMPLE_SQL = f"{QUOTA_SQL}, smp AS (SELECT q.* FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY md5('7|' || qid), qid) AS rn FROM questions) q JOIN quo USING (relation) WHERE rn <= quota)"


@book.add("sample_quotas", f"WITH {QUOTA_SQL} SELECT relation, size, quota FROM quo")
def _(spark, d):
    return sp.quotas(table(spark, d, "questions"), "relation", 500)


@book.add("sample_stratified", f"WITH {SAMPLE_SQL} SELECT qid, relation FROM smp")
def _(spark, d):
    return sp.quota_sample(table(spark, d, "questions"), "relation", 500, 7).select("qid", "relation")


@book.add("sample_sheet", f"WITH {SAMPLE_SQL} SELECT qid, relation, template_id, question, answer_label, '' AS grade_meaning, '' AS grade_fluency, '' AS grade_answer, '' AS note FROM smp")
def _(spark, d):
    s = sp.quota_sample(table(spark, d, "questions"), "relation", 500, 7)
    return s.select("qid", "relation", "template_id", "question", "answer_label", *[F.lit("").alias(c) for c in ("grade_meaning", "grade_fluency", "grade_answer", "note")])


@book.add("sample_sheet_order", f"WITH {SAMPLE_SQL} SELECT qid, row_number() OVER (ORDER BY md5('123|' || qid), qid) AS line FROM smp")
def _(spark, d):
    from loomgraph.operators.ranking import running_position

    s = sp.quota_sample(table(spark, d, "questions"), "relation", 500, 7)
    return running_position(s.withColumn("draw", sp.draw(123, "qid")), [], ["draw", "qid"], rank_col="line").select("qid", "line")


@book.add("sample_uniform", "SELECT qid FROM questions ORDER BY md5('0|' || qid), qid LIMIT 200")
def _(spark, d):
    return sp.uniform_sample(table(spark, d, "questions"), 200, 0).select("qid")


@book.add("sample_candidates", f"WITH {FACTS_SQL} SELECT fact_id FROM facts ORDER BY md5('42-1|' || CAST(fact_id AS VARCHAR)), fact_id LIMIT 10")
def _(spark, d):
    return sp.uniform_sample(facts(spark, d), 10, "42-1", "fact_id").select("fact_id")


@book.add("sample_epoch_shuffle", "SELECT qid, row_number() OVER (ORDER BY md5('42003|' || qid), qid) AS pos FROM questions")
def _(spark, d):
    from loomgraph.operators.ranking import running_position

    return running_position(table(spark, d, "questions").select("qid", sp.draw(42 * 1000 + 3, "qid").alias("draw")), [], ["draw", "qid"], rank_col="pos").select("qid", "pos")


@book.add("sample_audit_join", f"WITH {SAMPLE_SQL}, dup AS (SELECT question FROM questions GROUP BY question HAVING count(*) > 1) SELECT s.qid, q.fact_id, q.tau_start, s.question IN (SELECT question FROM dup) AS duplicated FROM (SELECT qid, question FROM smp) s LEFT JOIN questions q USING (qid)")
def _(spark, d):
    q = table(spark, d, "questions")
    s = sp.quota_sample(q, "relation", 500, 7).select("qid", "question")
    dup = q.groupBy("question").agg(F.count("*").alias("n")).where("n > 1").select("question", F.lit(True).alias("hit"))
    return s.join(q.select("qid", "fact_id", "tau_start"), "qid", "left").join(dup, "question", "left").select("qid", "fact_id", "tau_start", F.coalesce("hit", F.lit(False)).alias("duplicated"))


@book.add("manifest", f"WITH {IMG_SQL}, {split_sql('questions')} SELECT qid, split, coalesce(image_url, '') AS image_url, coalesce(image_url, '') <> '' AS has_image FROM questions JOIN asg USING (fact_id) LEFT JOIN img USING (qid)")
def _(spark, d):
    q = table(spark, d, "questions")
    url = F.coalesce("image_url", F.lit(""))
    return q.join(sp.split_by_fact(q).select("fact_id", "split"), "fact_id").join(images(spark, d), "qid", "left").select("qid", "split", url.alias("image_url"), (url != "").alias("has_image"))


@book.add("manifest_coverage", f"WITH {IMG_SQL}, {split_sql('questions')}, m AS (SELECT split, coalesce(image_url, '') <> '' AS has FROM questions JOIN asg USING (fact_id) LEFT JOIN img USING (qid)) SELECT split, count(*) AS n_questions, CAST(sum(CASE WHEN has THEN 1 ELSE 0 END) AS BIGINT) AS n_with_image, round(100.0 * sum(CASE WHEN has THEN 1 ELSE 0 END) / count(*), 2) AS pct_with_image FROM m GROUP BY split")
def _(spark, d):
    m = book.queries["manifest"](spark, d)
    k = F.sum(F.col("has_image").cast("int"))
    return m.groupBy("split").agg(F.count("*").alias("n_questions"), k.alias("n_with_image"), F.round(100.0 * k / F.count("*"), 2).alias("pct_with_image"))


def _showcase_sql() -> str:
    """The picks one after another: every step takes the head of one ordering among the facts not chosen yet."""
    steps = [f"""f AS (SELECT q.qid, q.fact_id, q.relation, coalesce(img.image_url, '') <> '' AS has_image, coalesce(s.fact_6tuple.tau_start <> s.fact_6tuple.tau_end, false) AS is_interval, q.template_id = '{qs.REVERSE}' AS is_reverse FROM questions q JOIN showcase_samples s ON q.qid = s.qid LEFT JOIN img ON q.qid = img.qid),
    p AS (SELECT *, md5('42|' || qid) AS draw FROM f), c0 AS (SELECT * FROM p WHERE false)"""]
    picks = [(f"relation = '{r}'", "NOT has_image, ", "1", "") for r in ("bornIn", "diedIn", "locatedIn", "occurredAt")]
    picks += [("is_interval", "", "1", "AND NOT EXISTS (SELECT 1 FROM {c} WHERE is_interval)"), ("is_reverse", "", "1", "AND NOT EXISTS (SELECT 1 FROM {c} WHERE is_reverse)"), ("true", "NOT has_image, ", "(SELECT greatest(8 - count(*), 0) FROM {c})", "")]
    for i, (cond, order, limit, unless) in enumerate(picks):
        c = f"c{i}"
        steps.append(f"""n{i} AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY NOT has_image, draw, qid) AS k FROM p WHERE {cond} AND fact_id IS NOT NULL AND qid NOT IN (SELECT qid FROM {c}) AND fact_id NOT IN (SELECT fact_id FROM {c}) {unless.format(c=c)}) WHERE k = 1 ORDER BY {order}draw, qid LIMIT {limit.format(c=c)}),
    c{i + 1} AS (SELECT * FROM {c} UNION ALL SELECT * FROM n{i})""")
    return f"WITH {IMG_SQL}, " + ", ".join(steps) + f" SELECT qid, fact_id, relation, has_image, is_interval, is_reverse FROM c{len(picks)}"


@book.add("showcase_pick", _showcase_sql())
def _(spark, d):
    q = table(spark, d, "questions").select("qid", "fact_id", "relation", "template_id")
    s = table(spark, d, "showcase_samples").select("qid", F.coalesce(F.col("fact_6tuple.tau_start") != F.col("fact_6tuple.tau_end"), F.lit(False)).alias("is_interval"))
    flagged = q.join(s, "qid").join(images(spark, d), "qid", "left")
    df = flagged.select("qid", "fact_id", "relation", (F.coalesce("image_url", F.lit("")) != "").alias("has_image"), "is_interval", (F.col("template_id") == qs.REVERSE).alias("is_reverse"))
    return sp.showcase(df, ("bornIn", "diedIn", "locatedIn", "occurredAt"))


@book.add("showcase_candidates", f"WITH {FACTS_SQL} SELECT q.qid, q.tau_start AS tau_start, f.tau_start AS tau_start_enriched, f.h_label AS h_label_enriched FROM questions q JOIN facts f ON q.fact_id = f.fact_id")
def _(spark, d):
    f = facts(spark, d).select("fact_id", F.col("tau_start").alias("tau_start_enriched"), F.col("h_label").alias("h_label_enriched"))
    return table(spark, d, "questions").join(f, "fact_id").select("qid", "tau_start", "tau_start_enriched", "h_label_enriched")


@book.add("showcase_records", """SELECT qid, '{"qid":"' || qid || '","template_id":"' || template_id || '","image_url":' || CASE WHEN coalesce(image_url, '') = '' THEN 'null' ELSE '"' || image_url || '"' END || ',"tau":[' || coalesce(CAST(fact_6tuple.tau_start AS VARCHAR), 'null') || ',' || coalesce(CAST(fact_6tuple.tau_end AS VARCHAR), 'null') || ']}' AS record FROM showcase_samples""")
def _(spark, d):
    s = table(spark, d, "showcase_samples")
    rec = F.struct("qid", "template_id", F.nullif(F.col("image_url"), F.lit("")).alias("image_url"), F.array("fact_6tuple.tau_start", "fact_6tuple.tau_end").alias("tau"))
    return s.select("qid", F.to_json(rec, {"ignoreNullFields": "false"}).alias("record"))


@book.add("image_lookup", "SELECT qid, max(image_url) AS image_url FROM split_members WHERE has_image AND coalesce(image_url, '') <> '' GROUP BY qid")
def _(spark, d):
    return table(spark, d, "split_members").where("has_image and coalesce(image_url, '') <> ''").groupBy("qid").agg(F.max("image_url").alias("image_url"))


@book.add("dedupe_sorted", f"WITH {DEDUP_SQL} SELECT qid, row_number() OVER (ORDER BY qid) AS pos FROM kept")
def _(spark, d):
    from loomgraph.operators.ranking import running_position

    return running_position(qs.dedupe(table(spark, d, "questions")).select("qid"), [], ["qid"], rank_col="pos")
