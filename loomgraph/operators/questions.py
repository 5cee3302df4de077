"""Template questions: generation, canonical form, de-duplication by source trust, categories and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Question templates: id, relation, masked side, question type, needs a year, pattern (fixed values).
TEMPLATES = (
    ("bornIn_t1", "bornIn", "t", "location_query", False, "{h} sinh ra ở đâu?"),
    ("bornIn_t2", "bornIn", "t", "location_query", False, "Nơi sinh của {h} là gì?"),
    ("diedIn_t1", "diedIn", "t", "location_query", False, "{h} mất ở đâu?"),
    ("diedIn_t2", "diedIn", "t", "location_query", False, "{h} qua đời tại đâu?"),
    ("occurredAt_t1", "occurredAt", "t", "location_query", False, "Sự kiện {h} xảy ra ở đâu?"),
    ("occurredAt_t2", "occurredAt", "t", "location_query", False, "{h} diễn ra tại địa điểm nào?"),
    ("occurredAt_t3", "occurredAt", "t", "location_query", False, "Địa điểm gắn liền với sự kiện {h} là gì?"),
    ("occurredAt_t4_reverse", "occurredAt", "h", "entity_query", True, "Vào năm {year}, sự kiện nào đã xảy ra tại {t}?"),
    ("locatedIn_t1", "locatedIn", "t", "location_query", False, "{h} thuộc tỉnh/thành nào?"),
    ("locatedIn_t2", "locatedIn", "t", "location_query", False, "Di tích {h} nằm ở đâu?"),
    ("locatedIn_t3", "locatedIn", "t", "location_query", False, "Địa bàn hành chính của {h} là gì?"),
    ("locatedIn_t4", "locatedIn", "t", "location_query", True, "{h} được công nhận di tích quốc gia vào năm {year}, tại tỉnh/thành nào?"),
)
#: Prompt around a question (fixed value).
PROMPT = "Dựa trên hình ảnh và tri thức không gian thời gian liên quan, hãy trả lời câu hỏi sau bằng MỘT thực thể duy nhất: "
REVERSE = "occurredAt_t4_reverse"
WITH_YEAR = ("occurredAt_t4_reverse", "locatedIn_t4")


def template_table(spark: SparkSession) -> DataFrame:
    """The template dimension (12 rows, so it may always be broadcast) with its order."""
    rows = [(i, *t) for i, t in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template_ord int, template_id string, relation string, mask string, question_type string, needs_tau boolean, pattern string")


def fill(pattern: Column, h: Column, t: Column, tau: Column) -> Column:
    """Text of a template; null when it needs a year and there is none."""
    year = F.when(pattern.contains("{year}"), F.replace(pattern, F.lit("{year}"), tau.cast("string"))).otherwise(pattern)
    return F.replace(F.replace(year, F.lit("{h}"), h), F.lit("{t}"), t)


def category(template_id: Column) -> Column:
    """Templates that name a year combine space and time, the others ask for space only."""
    return F.when(template_id.isin(*WITH_YEAR), "ket_hop").otherwise("thuan_khong_gian")


def candidates(facts: DataFrame) -> DataFrame:
    """Every fact with every template of its relation and the reason it is left out ('' = it is asked).

    Null or blank labels are missing labels. The reverse template needs a (t_label, tau_start) that only one event has.
    """
    spark = facts.sparkSession
    occ = facts.where((F.col("r") == "occurredAt") & F.col("t_label").isNotNull() & F.col("tau_start").isNotNull())
    single = occ.groupBy(F.col("t_label").alias("__t"), F.col("tau_start").alias("__tau")).agg(F.count("*").alias("__n"))
    pairs = facts.join(F.broadcast(template_table(spark)), facts["r"] == F.col("relation"))
    joined = pairs.join(single, (F.col("template_id") == REVERSE) & (F.col("t_label") == F.col("__t")) & (F.col("tau_start") == F.col("__tau")), "left")
    no_label = (F.trim(F.coalesce("h_label", F.lit(""))) == "") | (F.trim(F.coalesce("t_label", F.lit(""))) == "")
    reason = (
        F.when(no_label, "thieu_nhan_h_hoac_t")
        .when(F.col("needs_tau") & F.col("tau_start").isNull(), "thieu_truong_tau_start")
        .when((F.col("template_id") == REVERSE) & (F.coalesce("__n", F.lit(0)) != 1), "dap_an_nhap_nhang")
        .otherwise("")
    )
    return joined.withColumn("reason", reason).drop("__t", "__tau", "__n")


def generate(facts: DataFrame) -> DataFrame:
    """Questions of all facts, in (fact, template) order, without the running id."""
    asked = candidates(facts).where("reason = ''")
    q = fill(F.col("pattern"), F.col("h_label"), F.col("t_label"), F.col("tau_start"))
    by_mask = lambda t, h: F.when(F.col("mask") == "t", F.col(t)).otherwise(F.col(h))
    return asked.withColumn("question", q).select(
        "fact_id", "template_ord", "relation", "template_id", "question_type", "question", F.concat(F.lit(PROMPT), "question").alias("prompt"),
        by_mask("t", "h").alias("answer_entity"), by_mask("t_label", "h_label").alias("answer_label"), "h", "h_label", "t", "t_label", "tau_start", "source",
    )


def number(questions: DataFrame) -> DataFrame:
    """qid = q%06d over (fact_id, template order): a global rank without a single-task window."""
    from loomgraph.operators.ranking import running_position

    return running_position(questions, [], ["fact_id", "template_ord"]).withColumn("qid", F.format_string("q%06d", "rn")).drop("rn")


def canonical_form(facts: DataFrame) -> DataFrame:
    """Template text with X for the labels, the year kept."""
    return candidates(facts).where("reason = ''").select("fact_id", "template_id", fill(F.col("pattern"), F.lit("X"), F.lit("X"), F.col("tau_start")).alias("canonical"))


def source_priority(col: Column) -> Column:
    """Trust of a source file: 1 for the graph files, 2 timeline, 3 heritage, 99 unknown."""
    name = F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.trim(col), r"^.*/", ""))), r"\.csv$", "")
    return F.when(name.isin("historical_figures", "landmarks", "historical_events"), 1).when(name == "historical_events_timeline", 2).when(name == "heritage_sites", 3).otherwise(99)


def dedupe(questions: DataFrame) -> DataFrame:
    """Per identical text the row with the smallest (priority, fact_id, qid); a two-phase minimum, so copies of one text are no hot task."""
    cols = [c for c in questions.columns if c != "question"]
    best = F.min(F.struct(source_priority(F.col("source")).alias("__p"), F.col("fact_id").alias("__f"), F.col("qid").alias("__q"), *cols)).alias("b")
    return questions.groupBy("question").agg(best).select("question", *[F.col(f"b.{c}").alias(c) for c in cols])
