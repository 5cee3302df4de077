"""Automatic checks of questions and answers; every check is a Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import strip
from loomgraph.schemas import TAU_MAX, TAU_MIN

#: Patterns of damaged text (fixed values).
MOJIBAKE = r"[\x{fffd}]|Ã[\x{80}-\x{bf}]|â\x{80}|Â[\x{80}-\x{bf}]"
HTML_ENTITY = r"&[a-zA-Z]+;|&#[0-9]+;"
WIKI_MARKUP = r"\[\[|\]\]|\{\{|\}\}|'''|<ref|</ref>|<br[ \t\n\r]*/?>"
PLACEHOLDER = r"\{[a-zA-Z_]+\}"
#: Reasons in their fixed order (fixed values).
REASONS = (
    "gia_tri_khong_phai_chuoi", "mojibake", "html_entity_sot", "the_wiki_sot", "dapan_gia_tri_khong_phai_chuoi", "dapan_mojibake", "dapan_html_entity_sot", "dapan_the_wiki_sot",
    "chuoi_rong", "placeholder_chua_thay", "answer_leakage", "tau_ngoai_800_2025", "hoi_nam_nhung_thieu_tau", "dapan_qid_tho_chua_giai_quyet", "dapan_ten_thuc_the_1_ky_tu", "dapan_ten_thuc_the_chi_so", "cau_hoi_trung_lap",
)


def checks(q: Column, a: Column, tau: Column, duplicated: Column) -> dict[str, Column]:
    """Condition of each reason."""
    at = strip(a)
    return {
        "gia_tri_khong_phai_chuoi": q.isNull(), "mojibake": q.rlike(MOJIBAKE), "html_entity_sot": q.rlike(HTML_ENTITY), "the_wiki_sot": q.rlike(WIKI_MARKUP),
        "dapan_gia_tri_khong_phai_chuoi": a.isNull(), "dapan_mojibake": a.rlike(MOJIBAKE), "dapan_html_entity_sot": a.rlike(HTML_ENTITY), "dapan_the_wiki_sot": a.rlike(WIKI_MARKUP),
        "chuoi_rong": q.isNull() | (strip(q) == ""), "placeholder_chua_thay": q.rlike(PLACEHOLDER),
        "answer_leakage": (F.length(at) >= 2) & F.contains(F.lower(q), F.lower(at)),
        "tau_ngoai_800_2025": ~tau.between(TAU_MIN, TAU_MAX), "hoi_nam_nhung_thieu_tau": q.rlike(r"(?iU)\bnăm\b") & tau.isNull(),
        "dapan_qid_tho_chua_giai_quyet": at.rlike(r"^Q[0-9]+$"), "dapan_ten_thuc_the_1_ky_tu": F.length(at) == 1, "dapan_ten_thuc_the_chi_so": at.rlike(r"^[0-9]+([.,][0-9]+)?$"),
        "cau_hoi_trung_lap": duplicated,
    }


def run_checks(df: DataFrame, answer: str = "answer_label") -> DataFrame:
    """Adds auto_reasons ('; '-joined, fixed order) and auto_flag; earlier flag columns are replaced. Null texts are reported, never an error.

    Copies of a text are counted by a two-phase aggregate and joined back; a text that holds a large share of the rows is split by skew handling.
    """
    base = df.drop("auto_reasons", "auto_flag")
    dup = base.groupBy(F.col("question").alias("__q")).agg(F.count("*").alias("__n")).where("__n > 1")
    j = base.join(dup, base["question"].eqNullSafe(F.col("__q")), "left")
    cond = checks(F.col("question"), F.col(answer), F.col("tau_start"), F.col("__n").isNotNull())
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(cond[r], F.lit(False)), F.lit(r)) for r in REASONS]))
    return j.withColumn("__r", reasons).withColumn("auto_reasons", F.array_join("__r", "; ")).withColumn("auto_flag", F.size("__r") > 0).drop("__q", "__n", "__r")


def summary(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.count("*").alias("n_total"), F.sum(F.col("auto_flag").cast("long")).alias("n_flagged"), F.round(100.0 * F.avg(F.col("auto_flag").cast("int")), 2).alias("pct_flagged"))


def histogram(flagged: DataFrame) -> DataFrame:
    return flagged.where("auto_flag").select(F.explode(F.split("auto_reasons", "; ")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
