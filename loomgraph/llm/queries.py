"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import p1_survivor as p1
from loomgraph.llm import p2_mojibake as p2
from loomgraph.llm import p3_overlap as p3
from loomgraph.llm import p4_pairs as p4
from loomgraph.llm import p5_splits as p5
from loomgraph.llm import p6_lookalikes as p6
from loomgraph.llm import p7_leaks as p7
from loomgraph.llm import p8_mixture as p8
from loomgraph.llm import p9_language as p9
from loomgraph.session import table


def _over(fn: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(*[table(spark, sf_dir, n) for n in names])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _over(p1.found, "questions", "source_files"),
        "p1_survivors": _over(lambda q, s: p1.survivors(q, s).records, "questions", "source_files"),
        "p1_values": _over(lambda q, s: p1.survivors(q, s).values, "questions", "source_files"),
        "p1_sources": _over(lambda q, s: p1.survivors(q, s).sources, "questions", "source_files"),
        "p2_found": _over(p2.found, "questions", "historical_events"),
        "p2_restored": _over(p2.restored, "questions", "historical_events"),
        "p3_found": _over(p3.found, "questions", "split_members"),
        "p3_report": _over(p3.report, "questions", "split_members"),
        "p4_found": _over(p4.found, "questions", "documents"),
        "p5_found": _over(p5.found, "questions"),
        "p5_splits": _over(p5.assign, "questions"),
        "p6_found": _over(p6.found, "historical_events", "showcase_samples"),
        "p6_labels": _over(lambda e, s: p6.normalised(p6.labels_long(e, s)), "historical_events", "showcase_samples"),
        "p7_found": _over(p7.found, "documents", "eval_items"),
        "p7_leaks": _over(lambda d, i: p7.leaks(d, i, paraphrase=0.85), "documents", "eval_items"),
        "p8_mixture": _over(p8.mixture, "documents", "source_targets"),
        "p8_shares": _over(p8.shares, "documents", "source_targets"),
        "p9_found": _over(p9.found, "documents"),
        "p9_documents": _over(p9.documents, "documents"),
        "p9_segments": _over(p9.segments, "documents"),
    }


def _runs_sql(key: str, source: str) -> str:
    """(key, g): every run of 12 folded words."""
    words = rf"list_filter(string_split_regex(replace(lower(strip_accents(nfc_normalize(regexp_replace(text, '\p{{Cf}}', '', 'g')))), 'đ', 'd'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"SELECT {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM (SELECT {key}, {words} AS w FROM {source} WHERE text IS NOT NULL)"


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": f"SELECT DISTINCT doc_id, item_id FROM ({_runs_sql('doc_id', 'documents')}) JOIN ({_runs_sql('item_id', 'eval_items')}) USING (g)",
        "p1_found": r"""
            WITH trust AS (SELECT regexp_replace(lower(regexp_replace(trim(file_name), '^.*[/\\]', '')), '\.csv$', '') AS src, min(priority) AS priority FROM source_files GROUP BY 1),
            rec AS (SELECT qid, fact_id,
                           trim(regexp_replace(lower(regexp_replace(trim(source), '^.*[/\\]', '')), '\.csv$', '')) AS src,
                           nfc_normalize(regexp_replace(lower(nfc_normalize(question)), '[^\p{L}\p{N}\p{M}]', '', 'g')) AS k
                    FROM questions WHERE question IS NOT NULL),
            ranked AS (SELECT qid, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY coalesce(priority, 99), fact_id NULLS LAST, qid) AS rn
                       FROM rec LEFT JOIN trust USING (src) WHERE k <> '')
            SELECT qid FROM ranked WHERE n > 1 AND rn = 1""",
        "p5_found": r"""
            WITH RECURSIVE e AS (SELECT DISTINCT fact_id AS f, CASE WHEN trim(h) <> '' THEN h END AS h FROM questions),
            linked AS (SELECT DISTINCT a.f AS f, b.f AS g FROM e a JOIN e b ON a.h = b.h),
            reach(f, g) AS (SELECT f, f FROM (SELECT DISTINCT f FROM e) UNION SELECT r.f, l.g FROM reach r JOIN linked l ON r.g = l.f),
            root AS (SELECT f, min(g) AS root FROM reach GROUP BY f),
            grp AS (SELECT root, min(qid) AS group_qid FROM questions JOIN root ON fact_id = f GROUP BY root)
            SELECT DISTINCT group_qid, qid FROM questions JOIN root ON fact_id = f JOIN grp USING (root) WHERE qid <> group_qid""",
    }
