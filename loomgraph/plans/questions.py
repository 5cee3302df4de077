"""Queries on template questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import questions as qs
from loomgraph.plans.base import FACTS_SQL, Book, facts
from loomgraph.session import table

book = Book()
TPL_SQL = "tpl AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{c}', '{t}', {str(n).lower()}, '{p}')" for i, (a, b, c, t, n, p) in enumerate(qs.TEMPLATES)) + ") v(template_ord, template_id, relation, mask, question_type, needs_tau, pattern))"
CAND_SQL = f"""{FACTS_SQL}, {TPL_SQL},
    single AS (SELECT t_label AS st, tau_start AS stau, count(*) AS n FROM facts WHERE r = 'occurredAt' AND t_label IS NOT NULL AND tau_start IS NOT NULL GROUP BY 1, 2),
    cand AS (SELECT f.*, tpl.*, CASE WHEN trim(coalesce(h_label, '')) = '' OR trim(coalesce(t_label, '')) = '' THEN 'thieu_nhan_h_hoac_t' WHEN needs_tau AND tau_start IS NULL THEN 'thieu_truong_tau_start'
        WHEN template_id = 'occurredAt_t4_reverse' AND coalesce(n, 0) <> 1 THEN 'dap_an_nhap_nhang' ELSE '' END AS reason
      FROM facts f JOIN tpl ON f.r = tpl.relation LEFT JOIN single ON template_id = 'occurredAt_t4_reverse' AND t_label = st AND tau_start = stau)"""
TEXT_SQL = "replace(replace(CASE WHEN contains(pattern, '{year}') THEN replace(pattern, '{year}', CAST(tau_start AS VARCHAR)) ELSE pattern END, '{h}', h_label), '{t}', t_label)"
PRIO_SQL = """CASE WHEN s IN ('historical_figures','landmarks','historical_events') THEN 1 WHEN s = 'historical_events_timeline' THEN 2 WHEN s = 'heritage_sites' THEN 3 ELSE 99 END"""
NAME_SQL = "regexp_replace(lower(trim(regexp_replace(trim(source), '^.*/', ''))), '\\.csv$', '')"
DEDUP_SQL = f"""kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY p, fact_id, qid) AS rn FROM (SELECT *, {PRIO_SQL} AS p FROM (SELECT *, {NAME_SQL} AS s FROM questions))) WHERE rn = 1)"""
CAT_SQL = "CASE WHEN template_id IN ('occurredAt_t4_reverse','locatedIn_t4') THEN 'ket_hop' ELSE 'thuan_khong_gian' END"


@book.add("questions_generate", f"""WITH {CAND_SQL} SELECT fact_id, relation, template_id, question_type, {TEXT_SQL} AS question, '{qs.PROMPT}' || {TEXT_SQL} AS prompt,
    CASE WHEN mask = 't' THEN t ELSE h END AS answer_entity, CASE WHEN mask = 't' THEN t_label ELSE h_label END AS answer_label, tau_start FROM cand WHERE reason = ''""")
def _(spark, d):
    return qs.generate(facts(spark, d)).select("fact_id", "relation", "template_id", "question_type", "question", "prompt", "answer_entity", "answer_label", "tau_start")


@book.add("questions_skip_reasons", f"WITH {CAND_SQL} SELECT template_id || ':' || reason AS reason, count(*) AS n FROM cand WHERE reason <> '' GROUP BY 1")
def _(spark, d):
    return qs.candidates(facts(spark, d)).where("reason <> ''").groupBy(F.concat_ws(":", "template_id", "reason").alias("reason")).agg(F.count("*").alias("n"))


@book.add("questions_unique_reverse_keys", f"WITH {FACTS_SQL} SELECT t_label, tau_start FROM facts WHERE r = 'occurredAt' AND t_label IS NOT NULL AND tau_start IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1")
def _(spark, d):
    f = facts(spark, d).where("r = 'occurredAt' and t_label is not null and tau_start is not null")
    return f.groupBy("t_label", "tau_start").agg(F.count("*").alias("n")).where("n = 1").drop("n")


@book.add("questions_numbered", f"WITH {CAND_SQL} SELECT 'q' || lpad(CAST(row_number() OVER (ORDER BY fact_id, template_ord) AS VARCHAR), 6, '0') AS qid, fact_id, template_id FROM cand WHERE reason = ''")
def _(spark, d):
    return qs.number(qs.generate(facts(spark, d))).select("qid", "fact_id", "template_id")


@book.add("questions_canonical", f"WITH {CAND_SQL} SELECT fact_id, template_id, replace(replace(CASE WHEN contains(pattern, '{{year}}') THEN replace(pattern, '{{year}}', CAST(tau_start AS VARCHAR)) ELSE pattern END, '{{h}}', 'X'), '{{t}}', 'X') AS canonical FROM cand WHERE reason = ''")
def _(spark, d):
    return qs.canonical_form(facts(spark, d))


@book.add("questions_dedupe", f"WITH {DEDUP_SQL} SELECT qid, fact_id, question, source FROM kept")
def _(spark, d):
    return qs.dedupe(table(spark, d, "questions")).select("qid", "fact_id", "question", "source")


@book.add("questions_removed_by_relation", f"WITH {DEDUP_SQL} SELECT relation, count(*) AS n FROM questions WHERE qid NOT IN (SELECT qid FROM kept) GROUP BY relation")
def _(spark, d):
    q = table(spark, d, "questions")
    return q.join(qs.dedupe(q).select("qid"), "qid", "left_anti").groupBy("relation").agg(F.count("*").alias("n"))


@book.add("questions_source_priority", f"SELECT qid, {PRIO_SQL} AS priority FROM (SELECT qid, {NAME_SQL} AS s FROM questions)")
def _(spark, d):
    return table(spark, d, "questions").select("qid", qs.source_priority(F.col("source")).alias("priority"))


@book.add("questions_duplicate_examples", 'SELECT question, qid FROM questions WHERE question IN (SELECT question FROM questions GROUP BY question HAVING count(*) > 1 ORDER BY question COLLATE "C" LIMIT 5)')
def _(spark, d):
    q = table(spark, d, "questions").select("question", "qid")
    g = q.groupBy("question").agg(F.count("*").alias("n")).where("n > 1").orderBy("question").limit(5)  # the report shows five groups
    return q.join(F.broadcast(g.select("question")), "question")


@book.add("questions_counts", "SELECT relation, question_type, count(*) AS n FROM questions GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "questions").groupBy("relation", "question_type").agg(F.count("*").alias("n"))


@book.add("questions_template_table", f"WITH {TPL_SQL} SELECT template_id, relation, mask, question_type AS question_type_ct, {CAT_SQL} AS spatiotemporal_category FROM tpl UNION ALL SELECT '(không có)', '-', '-', '-', 'thuan_thoi_gian'")
def _(spark, d):
    t = qs.template_table(spark).select("template_id", "relation", "mask", F.col("question_type").alias("question_type_ct"), qs.category(F.col("template_id")).alias("spatiotemporal_category"))
    return t.union(spark.createDataFrame([("(không có)", "-", "-", "-", "thuan_thoi_gian")], t.schema))


IMG_SQL = "img AS (SELECT qid, max(image_url) AS image_url FROM split_members GROUP BY qid)"


def images(spark, d):
    return table(spark, d, "split_members").groupBy("qid").agg(F.max("image_url").alias("image_url"))


@book.add("questions_category_by_image", f"WITH {IMG_SQL} SELECT {CAT_SQL} AS spatiotemporal_category, coalesce(image_url, '') <> '' AS has_image, count(*) AS n_questions FROM questions LEFT JOIN img USING (qid) GROUP BY 1, 2")
def _(spark, d):
    j = table(spark, d, "questions").join(images(spark, d), "qid", "left")
    return j.groupBy(qs.category(F.col("template_id")).alias("spatiotemporal_category"), (F.coalesce("image_url", F.lit("")) != "").alias("has_image")).agg(F.count("*").alias("n_questions"))


@book.add("questions_flags", f"WITH {IMG_SQL} SELECT s.qid, coalesce(image_url, '') <> '' AS has_image, coalesce(fact_6tuple.tau_start <> fact_6tuple.tau_end, false) AS is_interval, coalesce(template_id = 'occurredAt_t4_reverse', false) AS is_reverse_template FROM (SELECT qid, template_id, fact_6tuple FROM showcase_samples) s LEFT JOIN img USING (qid)")
def _(spark, d):
    s = table(spark, d, "showcase_samples").select("qid", "template_id", "fact_6tuple").join(images(spark, d), "qid", "left")
    f = F.lit(False)
    return s.select("qid", (F.coalesce("image_url", F.lit("")) != "").alias("has_image"), F.coalesce(F.col("fact_6tuple.tau_start") != F.col("fact_6tuple.tau_end"), f).alias("is_interval"), F.coalesce(F.col("template_id") == qs.REVERSE, f).alias("is_reverse_template"))
