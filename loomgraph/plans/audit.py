"""Queries on the automatic checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.text import strip_sql
from loomgraph.operators import audit as au
from loomgraph.plans.base import Book
from loomgraph.session import table

book = Book()
_M = r"[\x{FFFD}]|Ã[\x{80}-\x{BF}]|â\x{80}|Â[\x{80}-\x{BF}]"
_W = r"\[\[|\]\]|\{\{|\}\}|''''''|<ref|</ref>|<br[ \t\n\r]*/?>"
_WORD = r"(?i)(^|[^\p{L}\p{N}_])năm([^\p{L}\p{N}_]|$)"
_A = strip_sql("answer_label")
_S = {
    "gia_tri_khong_phai_chuoi": "question IS NULL", "mojibake": f"regexp_matches(question, '{_M}')", "html_entity_sot": f"regexp_matches(question, '{au.HTML_ENTITY}')", "the_wiki_sot": f"regexp_matches(question, '{_W}')",
    "dapan_gia_tri_khong_phai_chuoi": "answer_label IS NULL", "dapan_mojibake": f"regexp_matches(answer_label, '{_M}')", "dapan_html_entity_sot": f"regexp_matches(answer_label, '{au.HTML_ENTITY}')", "dapan_the_wiki_sot": f"regexp_matches(answer_label, '{_W}')",
    "chuoi_rong": f"question IS NULL OR {strip_sql('question')} = ''", "placeholder_chua_thay": f"regexp_matches(question, '{au.PLACEHOLDER}')",
    "answer_leakage": f"length({_A}) >= 2 AND contains(lower(question), lower({_A}))", "tau_ngoai_800_2025": "tau_start NOT BETWEEN 800 AND 2025", "hoi_nam_nhung_thieu_tau": f"regexp_matches(question, '{_WORD}') AND tau_start IS NULL",
    "dapan_qid_tho_chua_giai_quyet": f"regexp_matches({_A}, '^Q[0-9]+$')", "dapan_ten_thuc_the_1_ky_tu": f"length({_A}) = 1", "dapan_ten_thuc_the_chi_so": f"regexp_matches({_A}, '^[0-9]+([.,][0-9]+)?$')",
    "cau_hoi_trung_lap": "n > 1",
}
FLAG_SQL = f"""flagged AS (SELECT qid, relation, concat_ws('; ', {', '.join(f"CASE WHEN {_S[r]} THEN '{r}' END" for r in au.REASONS)}) AS auto_reasons FROM (SELECT *, count(*) OVER (PARTITION BY question) AS n FROM questions))"""


def flagged(spark, d):
    return au.run_checks(table(spark, d, "questions"))


@book.add("audit_flags", f"WITH {FLAG_SQL} SELECT qid, auto_reasons, auto_reasons <> '' AS auto_flag FROM flagged")
def _(spark, d):
    return flagged(spark, d).select("qid", "auto_reasons", "auto_flag")


@book.add("audit_summary", f"WITH {FLAG_SQL} SELECT count(*) AS n_total, CAST(sum(CASE WHEN auto_reasons <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_flagged, round(100.0 * avg(CASE WHEN auto_reasons <> '' THEN 1 ELSE 0 END), 2) AS pct_flagged FROM flagged")
def _(spark, d):
    return au.summary(flagged(spark, d))


@book.add("audit_reason_histogram", f"WITH {FLAG_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(auto_reasons, '; ')) AS reason FROM flagged WHERE auto_reasons <> '') GROUP BY reason")
def _(spark, d):
    return au.histogram(flagged(spark, d))


@book.add("audit_by_relation", f"WITH {FLAG_SQL} SELECT relation, count(*) AS n, CAST(sum(CASE WHEN auto_reasons <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_flagged FROM flagged GROUP BY relation")
def _(spark, d):
    return flagged(spark, d).groupBy("relation").agg(F.count("*").alias("n"), F.sum(F.col("auto_flag").cast("long")).alias("n_flagged"))


@book.add("audit_duplicate_mask", "SELECT qid, count(*) OVER (PARTITION BY question) > 1 AS duplicated FROM questions")
def _(spark, d):
    q = table(spark, d, "questions").select("qid", "question")
    dup = q.groupBy("question").agg(F.count("*").alias("n")).where("n > 1")
    return q.join(dup, "question", "left").select("qid", F.col("n").isNotNull().alias("duplicated"))


def _single(name, keys):
    """One query per family of checks, on its own condition."""
    sql = f"SELECT qid, concat_ws('; ', {', '.join(f'''CASE WHEN {_S[k]} THEN '{k}' END''' for k in keys)}) AS reasons FROM questions"

    @book.add(name, sql)
    def _(spark, d):
        c = au.checks(F.col("question"), F.col("answer_label"), F.col("tau_start"), F.lit(False))
        return table(spark, d, "questions").select("qid", F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c[k], F.lit(False)), F.lit(k)) for k in keys])), "; ").alias("reasons"))


_single("audit_encoding", au.REASONS[:4])
_single("audit_placeholder", au.REASONS[8:10])
_single("audit_answer_leakage", au.REASONS[10:11])
_single("audit_temporal", au.REASONS[11:13])
_single("audit_weird_entity", au.REASONS[13:16])
