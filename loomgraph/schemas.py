"""Fixed schemas of the stages (never inferred) and the constants that define the semantics."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType()}


def _struct(spec: str) -> T.StructType:
    """Schema of 'name type, ...'; needs no session, so workers may import this module."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (f.split() for f in spec.split(","))])


FACTS = _struct("fact_id bigint, h string, h_label string, r string, t string, t_label string, tau_start int, tau_end int, l_h_lat double, l_h_lon double, l_t_lat double, l_t_lon double, vi_context string, source string, src_file string")
RAW_FACTS = _struct("h string, h_label string, r string, t string, t_label string, tau_start int, l_h_lat double, l_h_lon double, l_t_lat double, l_t_lon double")
QUESTIONS = _struct("qid string, fact_id bigint, relation string, template_id string, question_type string, question string, prompt string, answer_entity string, answer_label string, h string, h_label string, t string, t_label string, tau_start int, l_h_lat double, l_h_lon double, l_t_lat double, l_t_lon double, source string")
ENTITIES = _struct("entity string, lat double, lon double, tau double")
RANKS = _struct("run string, qid string, target string, rank int")
EVENT_CODES = _struct("event_date string, h_label string, h_country string, event_text string, cameo string, intensity string, t_label string, t_country string, country string, l_t_lat double, l_t_lon double, story_id string")

#: Fixed values.
LAT_MIN, LAT_MAX, LON_MIN, LON_MAX = 8.0, 23.5, 102.0, 110.0
DEFAULT_LAT, DEFAULT_LON, DEFAULT_TAU = 14.0583, 108.2772, 2000.0
TAU_MIN, TAU_MAX, TAU_MAX_SCORER = 800, 2025, 2024
BINS_X, BINS_Y, BINS_T = 64, 64, 100
RELATIONS = ("bornIn", "diedIn", "occurredAt", "locatedIn")
SPLIT_SHARES = (0.8, 0.1)
SEED = 42
TOP_K = 32
RELIABILITY_WEIGHTS = (0.35, 0.30, 0.20, 0.15)
REQUIRED_COLUMNS = ("h", "h_label", "r", "t", "t_label", "tau_start", "tau_end", "l_h_lat", "l_h_lon", "l_t_lat", "l_t_lon")
