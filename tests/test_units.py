"""Small cases with known results."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import calendar as cal
from loomgraph.functions import models as md
from loomgraph.functions import textmetrics as tm
from loomgraph.functions.text import compare_key, fold, strip
from loomgraph.operators import audit, merge, metrics, parsers, questions, reliability, retrieval, spatial, splits, triples, visual
from loomgraph.operators.ranking import running_position
from loomgraph.sources import files, remote, sinks


def one(df):
    return df.collect()[0]


# ranks and metrics
def test_target_rank_and_ties(spark):
    df = spark.createDataFrame([(1, "a", 0.1, "b"), (1, "b", 0.7, "b"), (1, "c", 0.2, "b"), (2, "a", 0.7, "c"), (2, "b", 0.2, "c"), (2, "c", 0.1, "c"), (3, "a", 0.5, "b"), (3, "b", 0.5, "b")], "q int, e string, p double, t string")
    assert {r["q"]: r["rank"] for r in retrieval.target_rank(df, ["q"], "p", "e", "t").collect()} == {1: 1, 2: 3, 3: 2}


def test_hits(spark):
    r = one(metrics.hits(spark.createDataFrame([(x,) for x in (1, 2, 5, 1, 3)], "rank int")))
    assert (r["hit1"], r["hit3"], r["hit10"], r["n"]) == (0.4, 0.8, 1.0, 5)
    assert one(metrics.hits(spark.createDataFrame([(1,), (2,), (4,)], "rank int")))["mrr"] == round((1 + 0.5 + 0.25) / 3, 4)
    e = one(metrics.hits(spark.createDataFrame([], "rank int")))
    assert e["mrr"] == 0.0 and e["n"] == 0


def test_quantise_clips(spark):
    df = spark.createDataFrame([(-1000.0, -1000.0, -1000.0), (1000.0, 1000.0, 100000.0)], "a double, b double, t double")
    got = [tuple(r) for r in df.select(*retrieval.cells(F.col("a"), F.col("b"), F.col("t"))).collect()]
    assert got == [(0, 0, 0), (63, 63, 99)]


def test_plausibility_zero_for_equal_ends(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.0, 0.0])], "v array<double>, z array<double>")
    assert one(df.select(retrieval.plausibility(F.col("v"), F.col("z"), F.col("v")).alias("s")))["s"] == 0.0


@pytest.mark.parametrize("alpha", [0.0, 1.0])
def test_relevance_extremes(spark, alpha):
    df = spark.createDataFrame([(1, i, c, s) for i, (c, s) in enumerate([(0.1, 3.0), (0.9, 1.0), (0.5, 2.0)])], "q int, id int, cos double, s double")
    order = [r["id"] for r in retrieval.relevance(df, alpha, ["q"]).orderBy(F.desc("rel")).collect()]
    assert order == ([1, 2, 0] if alpha else [1, 2, 0])


def test_top_k_is_capped_by_the_candidates(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(5)], "q int, id int, s double")
    assert retrieval.top_k(df, ["q"], "s", "id", 32).count() == 5


def test_unknown_relation_raises(spark):
    with pytest.raises(Exception, match="unknown relation"):
        spark.createDataFrame([("x",)], "r string").select(retrieval.relation_id(F.col("r"))).collect()


def test_guards():
    with pytest.raises(ValueError):
        retrieval.check_dims(512, E_x=511)
    with pytest.raises(ValueError):
        retrieval.check_heads(896, 14, 4, 64)


def test_losses(spark):
    df = spark.createDataFrame([(0.9, 1.0, True), (0.1, 1.0, False), (0.9, 1.0, True), (0.1, 1.0, False)], "p double, t double, m boolean")
    assert one(df.agg(metrics.masked_bce(F.col("p"), F.col("t"), F.col("m")).alias("x")))["x"] == pytest.approx(-math.log(0.9))
    assert one(df.agg(metrics.masked_bce(F.col("p"), F.col("t"), F.lit(False)).alias("x")))["x"] == 0.0
    assert one(df.agg(metrics.total_loss(F.max("t"), F.max("t"), F.max("t")).alias("x")))["x"] == pytest.approx(1.8)


def test_kappa_guard(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert one(metrics.kappa(df, F.col("a"), F.col("b")))["kappa"] is None


def test_best_by_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([("x", 1, 0.5), ("x", 2, 0.7), ("x", 3, 0.7), ("y", 1, None)], "run string, epoch int, mrr double")
    assert [(r["run"], r["epoch"]) for r in metrics.best_by(df, ["run"], "mrr", "epoch").collect()] == [("x", 2)]


def test_early_stop(spark):
    df = spark.createDataFrame([("r", i, m) for i, m in enumerate([0.1, 0.2, 0.2, 0.1, 0.3])], "run string, epoch int, mrr double")
    got = metrics.early_stop(df, 2).orderBy("epoch").collect()
    assert [r["stop"] for r in got] == [False, False, False, True, False]


def test_bootstrap_centered_is_smaller(spark):
    df = spark.createDataFrame([(i, 1, 2) for i in range(40)], "i long, rank_a int, rank_b int")
    assert one(metrics.bootstrap(df, 50))["p"] == 1.0
    assert one(metrics.bootstrap(df, 50, centered=True))["p"] == 0.0


# reliability
def test_reliability_demo(spark):
    f = spark.createDataFrame([("Q1", 21.0, 105.0, 1945), ("Q2", None, None, 1000), ("Q3", 10.0, 106.0, 1900)], "h string, l_h_lat double, l_h_lon double, tau_start int").withColumn("r", F.lit("bornIn"))
    im, cl = spark.createDataFrame([("Q1", "")], "h string, image_path string"), spark.createDataFrame([("Q1", 0.75)], "h string, clip_score double")
    assert {r["h"]: r["reliability_score"] for r in reliability.score(f, im, cl).collect()} == {"Q1": 0.925, "Q2": 0.15, "Q3": 0.35}


# coordinates
def test_copy_tail_may_copy_null_and_box_keeps_missing(spark):
    df = spark.createDataFrame([("bornIn", None, None, 10.0, 106.0), ("bornIn", None, None, None, None), ("occurredAt", None, None, 1.0, 2.0)], "r string, l_h_lat double, l_h_lon double, l_t_lat double, l_t_lon double")
    assert [r["l_h_lat"] for r in spatial.copy_tail_to_head(df).collect()] == [10.0, None, None]
    assert [r["l_h_lat"] for r in spatial.events_take_tail(df).collect()] == [None, None, 1.0]
    b = spark.createDataFrame([(99.0, None), (8.0, 102.0), (7.9, 105.0)], "a double, b double")
    assert [r[0] for r in b.select(spatial.in_box(F.col("a"), F.col("b"))).collect()] == [True, True, False]


def test_lookup_chain_keeps_recorded_misses(spark):
    names = spark.createDataFrame([("a",), ("b",), ("b",), (" ",), ("c",)], "name string")
    cache = spark.createDataFrame([("a", None, None)], "name string, lat double, lon double")
    r1 = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "name string, lat double, lon double")
    assert {r["name"]: (r["lat"], r["origin"]) for r in spatial.lookup_chain(names, cache, r1).collect()} == {"a": (None, "miss"), "b": (3.0, "resolver1"), "c": (None, "miss")}


# questions
def test_templates(spark):
    f = spark.createDataFrame([(1, "Q1", "A", "occurredAt", "Q2", "B", 1945, "x"), (2, "Q3", " ", "bornIn", "Q2", "B", None, "x"), (3, "Q4", "C", "occurredAt", "Q2", "B", 1945, "x"), (4, "Q5", "D", "locatedIn", "Q6", "E", None, "x")], "fact_id long, h string, h_label string, r string, t string, t_label string, tau_start int, source string")
    reasons = {(r["fact_id"], r["template_id"]): r["reason"] for r in questions.candidates(f).collect()}
    assert reasons[1, "occurredAt_t4_reverse"] == "dap_an_nhap_nhang"
    assert reasons[2, "bornIn_t1"] == "thieu_nhan_h_hoac_t"
    assert reasons[4, "locatedIn_t4"] == "thieu_truong_tau_start"
    assert "A sinh ra" not in {r["question"] for r in questions.generate(f).collect()}
    assert {r["qid"] for r in questions.number(questions.generate(f)).collect()} == {f"q{i:06d}" for i in range(1, 10)}


def test_question_dedupe_prefers_trust(spark):
    q = spark.createDataFrame([("q1", 5, "x?", "unknown"), ("q2", 9, "x?", "data/raw/LANDMARKS.csv"), ("q3", 1, "x?", None), ("q4", 1, "y?", None)], "qid string, fact_id long, question string, source string")
    assert {r["question"]: r["qid"] for r in questions.dedupe(q).collect()} == {"x?": "q2", "y?": "q4"}


# splits
def test_split_is_fact_safe_and_exact(spark):
    q = spark.createDataFrame([(f"q{i:03d}", i // 2, "r" if i < 60 else "s") for i in range(100)], "qid string, fact_id long, relation string")
    a = splits.split_by_fact(q)
    assert {(r["relation"], r["split"]): r["count"] for r in a.groupBy("relation", "split").count().collect()} == {("r", "train"): 24, ("r", "val"): 3, ("r", "test"): 3, ("s", "train"): 16, ("s", "val"): 2, ("s", "test"): 2}
    assert splits.leakage(a).count() == 0


def test_quotas_sum(spark):
    q = spark.createDataFrame([("a", i) for i in range(70)] + [("b", i) for i in range(20)] + [("c", i) for i in range(3)], "k string, i int")
    assert sum(r["quota"] for r in splits.quotas(q, "k", 50).collect()) == 50
    assert sum(r["quota"] for r in splits.quotas(q, "k", 500).collect()) == 93


def test_showcase_rules(spark):
    rows = [(f"q{i}", i // 2, ["bornIn", "diedIn", "locatedIn", "occurredAt"][i % 4], i % 5 == 0, i == 7, i == 9) for i in range(60)]
    df = spark.createDataFrame(rows, "qid string, fact_id long, relation string, has_image boolean, is_interval boolean, is_reverse boolean")
    got = splits.showcase(df, ("bornIn", "diedIn", "locatedIn", "occurredAt")).collect()
    assert len(got) == 8 == len({r["fact_id"] for r in got})
    assert {r["relation"] for r in got} == {"bornIn", "diedIn", "locatedIn", "occurredAt"} and any(r["is_interval"] for r in got) and any(r["is_reverse"] for r in got)


def test_running_position_over_a_hot_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 10 < 9, "hot").alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("w"))
    got = running_position(df, ["g"], ["o"], weight="w").collect()
    for g in ("hot", None):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["o"])
        assert [r["rn"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["before"] for r in mine] == [0, *np.cumsum([r["w"] for r in mine])[:-1].tolist()]
    assert running_position(df.limit(0), ["g"], ["o"]).count() == 0


# audit
def test_audit_reasons(spark):
    q = spark.createDataFrame([("a", "Ã¡ &amp; [[x]] {h} năm?", "Q12", None), ("b", None, None, 3000), ("c", "Huế ở đâu", "huế", 900), ("d", "Huế ở đâu", "1,5", 900), ("e", "đnăm thường", " x ", None)], "qid string, question string, answer_label string, tau_start int")
    got = {r["qid"]: r["auto_reasons"] for r in audit.run_checks(q).collect()}
    assert got["a"] == "mojibake; html_entity_sot; the_wiki_sot; placeholder_chua_thay; hoi_nam_nhung_thieu_tau; dapan_qid_tho_chua_giai_quyet"
    assert got["b"] == "gia_tri_khong_phai_chuoi; dapan_gia_tri_khong_phai_chuoi; chuoi_rong; tau_ngoai_800_2025"
    assert got["c"] == "answer_leakage; cau_hoi_trung_lap"
    assert got["d"] == "dapan_ten_thuc_the_chi_so; cau_hoi_trung_lap"
    assert got["e"] == "dapan_ten_thuc_the_1_ky_tu"
    assert audit.run_checks(audit.run_checks(q)).columns == audit.run_checks(q).columns


# merging
def test_keep_first_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, "h", "r", "t", None), (2, "h", "r", "t", None), (3, "h", "r", "t", 5)], "fact_id long, h string, r string, t string, tau_start int")
    assert {r["fact_id"] for r in merge.keep_first(a, ["h", "r", "t", "tau_start"], ["fact_id"]).collect()} == {1, 3}


def test_coded_events(spark):
    raw = spark.createDataFrame([("2001-05-01", "Soviet Union", "X", "010", "Soviet", "US", "US", 1.0, 2.0), ("bad", "A" * 40, "B", "999", "US", "Viet Nam", "US", None, None), ("2001", "Same", "Same", "01", "VIE", "", "", 1.0, 1.0), ("2001", "P", "Q", "01", "US", "US", "US", 1.0, 1.0)], "event_date string, h_label string, t_label string, cameo string, h_country string, t_country string, country string, l_t_lat double, l_t_lon double")
    got = sorted(merge.coded_events(raw).collect(), key=lambda r: r["h"])
    assert [(r["r"], r["tau_start"]) for r in got] == [("interact", None), ("makeStatement", 2001)]
    assert got[0]["h"] == "ICEWS_" + "A" * 30


def test_entity_claims(spark):
    e = spark.createDataFrame([("Q1", '{"labels":{"en":{"value":"E"}},"claims":{"P19":[{"mainsnak":{"datavalue":{"value":{"id":"Q9"}}},"qualifiers":{"P580":[{"datavalue":{"value":{"time":"x"}}},{"datavalue":{"value":{"time":"-0207-01-01T00:00:00Z"}}}]}},{"mainsnak":{}}],"P999":[]}}'), ("Q2", "{broken"), ("Q3", None)], "qid string, json string")
    assert [(r["h"], r["h_label"], r["r"], r["t"], r["tau_start"]) for r in merge.entity_claims(e).collect()] == [("Q1", "E", "bornIn", "Q9", 207)]


def test_closure_ends_on_cycles(spark):
    t = spark.createDataFrame([("a", "P279", "root"), ("b", "P279", "a"), ("root", "P279", "b"), ("x", "P279", "y")], "s string, p string, o string")
    assert {r["s"] for r in triples.closure(t, "P279", "root").collect()} == {"root", "a", "b"}


# parsers
@pytest.mark.parametrize(("text", "want"), [("42 - 43", (42, 43)), ("207 TCN", (-207, -207)), ("25.000 TCN–7.000 TCN", (-25000, -7000)), ("42 TCN - 43", (-42, 43)), ("207 - 111 TCN", (-111, 207)), ("22 tháng 12", (None, None)), ("x - 5", (None, None))])
def test_year_spans(spark, text, want):
    a, b = parsers.year_span(F.col("s"))
    assert tuple(one(spark.createDataFrame([(text,)], "s string").select(a, b))) == want


def test_timeline_rules(spark):
    text = "\n".join(["== A ==", "'''938:''' [[Trận X|Trận]] trên sông [[Bạch Đằng]]", ":'''5 tháng 3:''' [[Hội]] họp", "'''1000'''", "::'''mùa thu:''' lễ [[K]] tại [[L]]", "=== B ===", ":'''7 tháng 1:''' [[Mất]]", "'''1010 - 1012''' dời đô [[M]]", "'''1020:''' không có liên kết", ":'''2 tháng 2:''' [[N]]<ref>x</ref>"])
    got = [(r["h_label"], r["tau_start"], r["tau_end"], r["t_label"]) for r in parsers.timeline(spark.createDataFrame([(1, text)], "page int, text string")).orderBy("pos").collect()]
    assert got == [("Trận", 938, 938, "Bạch Đằng"), ("Hội", 938, 938, "Việt Nam"), ("K", 1000, 1000, "L"), ("M", 1010, 1012, "Việt Nam"), ("N", 1010, 1010, "Việt Nam")]


def test_heritage_rules(spark):
    text = "\n".join(["==Bắc==", "|a || b || c || 1990", "===Hà Nội===", "|[[Văn Miếu#x]] || [http://a Đống Đa] || Kiến trúc || 1962", "|ô || ít", "==Nam==", "|x || y || z || 1999"])
    got = [tuple(r) for r in parsers.heritage(spark.createDataFrame([(1, text)], "page int, text string")).select("h_label", "t_label", "tau_start", "vi_context").collect()]
    assert got == [("Văn Miếu", "Hà Nội", 1962, "Đống Đa; Kiến trúc; vùng Bắc")]


# visual
def test_caption_families(spark):
    c = spark.createDataFrame([("a.jpg", "A man riding a horse in town"), ("b.jpg", "one two"), ("c.jpg", "red big old house here now"), ("d.jpg", None)], "image_file string, caption string")
    got = {(r["image_file"]): (r["subject"], r["predicate"], r["object"]) for r in visual.caption_triplets(c).collect()}
    assert got == {"a.jpg": ("man", "riding", "horse"), "c.jpg": ("red", "big", "old house here")}


def test_resolve_equals_nested_loop(spark):
    idx = visual.label_index(spark.createDataFrame([(1, "Hà Nội", 1.0, 1.0, "Huế", 2.0, 2.0), (2, "An", 3.0, 3.0, "hà nội", 9.0, 9.0)], "fact_id long, h_label string, l_h_lat double, l_h_lon double, t_label string, l_t_lat double, l_t_lon double"))
    ents = spark.createDataFrame([("Hà Nội",), ("thành phố Hà Nội",), ("Hu",), ("xyz",), ("",), ("Lan Anh",)], "entity string")
    got = {r["entity"]: (r["lat"], r["how"]) for r in visual.resolve(ents, idx).collect()}
    assert got == {"Hà Nội": (9.0, "exact"), "thành phố Hà Nội": (9.0, "contains"), "Hu": (2.0, "contains"), "xyz": (14.0583, "default"), "": (9.0, "contains"), "Lan Anh": (3.0, "contains")}


def test_resolve_equals_nested_loop_on_many_texts(spark):
    """Texts of few syllables, so that nearly all share their parts; one label is blank and thus within every key."""
    import random

    rng, parts = random.Random(3), ["an", "hà", "nội", "trận ", "ế", "ß", "l", "đ🙂", " "]
    word = lambda n: "".join(rng.choice(parts) for _ in range(n))
    facts = [(i, word(rng.randint(2, 7)), float(i), 1.0, word(rng.randint(2, 7)), i + 0.5, 2.0) for i in range(300)]
    names = sorted({word(rng.randint(1, 9)) for _ in range(400)})

    def run(facts):
        rows, index = sorted((2 * f[0] + s, f[1 + 3 * s].strip(" ").lower(), f[2 + 3 * s]) for f in facts for s in (0, 1)), {}
        for pos, key, lat in rows:
            index[key] = (index.get(key, (pos,))[0], lat)
        want = {}
        for e in names:
            key = e.strip(" ").lower()
            near = [v for k, v in index.items() if k in key or key in k]
            want[e] = (index[key][1], "exact") if key in index else (min(near)[1], "contains") if near else (14.0583, "default")
        idx = visual.label_index(spark.createDataFrame(facts, "fact_id long, h_label string, l_h_lat double, l_h_lon double, t_label string, l_t_lat double, l_t_lon double"))
        got = {r["entity"]: (r["lat"], r["how"]) for r in visual.resolve(spark.createDataFrame([(e,) for e in names], "entity string"), idx).collect()}
        assert got == want

    run([f for f in facts if f[1].strip(" ") and f[4].strip(" ")])
    run([*facts, (-1, " ", 7.0, 7.0, "  ", 8.0, 8.0)])


def test_pieces_are_whole_patterns(spark):
    """Only parts of a text that are patterns leave the task, and all of them where the filter is far too small."""
    texts = spark.createDataFrame([(i, "trận đánh ở xã số %d" % i) for i in range(500)] + [(500, None), (501, "")], "n long, text string")
    patterns = spark.createDataFrame([("xã số %d" % i,) for i in range(0, 5000, 7)] + [("ở",), ("đánh ở huyện",)], "p string")
    has = {r["p"] for r in patterns.collect()}
    want = {(r["n"], t) for r in texts.collect() if r["text"] for t in has if t in r["text"]}
    sent = [(r["n"], r["piece"]) for r in visual.with_pieces(texts, "text", patterns).collect()]
    assert {x for x in sent if x[1] in has} == want and len(sent) < len(want) * 1.1
    full = visual.with_pieces(texts, "text", spark.createDataFrame([(f"{i:x}",) for i in range(40_000)], "p string").union(patterns), most=1 << 15).collect()
    assert {(r["n"], r["piece"]) for r in full if r["piece"] in has} >= want


def test_resolve_shuffles_no_parts_of_texts(spark):
    """Labels and entities are made of the same words: what is shuffled stays in proportion to the texts, however many share their parts."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    old = written()
    facts = spark.range(1000).selectExpr("id as fact_id", "concat('chiến dịch sông ', id, ' lần thứ nhất') as h_label", "1D as l_h_lat", "1D as l_h_lon", "cast(null as string) as t_label", "1D as l_t_lat", "1D as l_t_lon")
    ents = spark.range(1000).selectExpr("concat('dịch sông ', id, ' lần thứ hai') as entity")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r["how"] for r in visual.resolve(ents, visual.label_index(facts)).collect()} == {"default"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(n for i, n in written().items() if i not in old) < 30 * 2000


# calendar
@pytest.mark.parametrize(("day", "want"), [("2024-02-10", (1, 1, 2024, 0, "Giáp Thìn")), ("2023-03-22", (1, 2, 2023, 1, "Quý Mão")), ("2020-05-23", (1, 4, 2020, 1, "Canh Tý")), ("2025-07-25", (1, 6, 2025, 1, "Ất Tỵ")), ("2023-01-22", (1, 1, 2023, 0, "Quý Mão")), ("2000-02-05", (1, 1, 2000, 0, "Canh Thìn")), ("2023-12-31", (19, 11, 2023, 0, "Quý Mão"))])
def test_lunar_dates(spark, day, want):
    r = one(cal.calendar(spark, int(day[:4]), int(day[:4])).where(F.col("solar_date") == F.lit(datetime.date.fromisoformat(day))))
    assert (r["lunar_day"], r["lunar_month"], r["lunar_year"], r["is_leap_month"], r["can_chi_year"]) == want


def test_calendar_is_whole(spark):
    assert cal.calendar(spark, 2000, 2030).count() == 11323
    m = cal.months(spark, 1990, 2040).orderBy("start").collect()
    assert all(a["next_start"] == b["start"] and 29 <= a["next_start"] - a["start"] <= 30 for a, b in zip(m, m[1:]))
    none = cal.lunar_to_solar(spark.createDataFrame([(1, 5, 2024, 1)], "lunar_day int, lunar_month int, lunar_year int, is_leap_month int"), 2024, 2025)
    assert one(none)["solar_date"] is None


# text
def test_text_forms(spark):
    assert fold("  ĐÌNH Cổ-Loa (1​622)! ") == "dinh co loa 1622"
    assert fold(None) is None and fold("") == ""
    assert compare_key("Huế ?") == compare_key("HUẾ​") == "huế"
    assert one(spark.createDataFrame([("  a b \t",)], "s string").select(strip(F.col("s")).alias("x")))["x"] == "a b"


def test_fidelity():
    assert tm.sentence_bleu("a b c d e", "a b c d e") == pytest.approx(100.0)
    assert tm.sentence_bleu("", "a") == 0.0 and tm.rouge_l("x", "y") == 0.0
    assert tm.rouge_l("sinh ra", "sinh ra") == 1.0


# models
def test_attention_groups():
    rng = np.random.default_rng(0)
    z, k = rng.normal(size=8), rng.normal(size=(3, 4))
    wq, wo = rng.normal(size=(8, 8)), np.eye(8)
    out = md.attention(z, k, k, wq, wo, 4, 2)
    q = (z @ wq).reshape(4, 2)
    for h in range(4):
        kk = k.reshape(3, 2, 2)[:, h // 2]
        s = kk @ q[h] / np.sqrt(2)
        w = np.exp(s - s.max())
        assert np.allclose(out.reshape(4, 2)[h], (w / w.sum()) @ kk)


def test_leaf_counts():
    assert md.leaf_counts('{"a":[1,null,{"b":null}],"c":"x"}') == (2, 2)
    assert md.leaf_counts(None) == (1, 0) == md.leaf_counts("{")


# sources and sinks
def test_override():
    base = {"a": {"b": True, "n": 3, "f": 0.5}}
    assert files.override(base, ["a.b=false", "a.n=4", "a.f=1", "x.y=z"]) == {"a": {"b": False, "n": 4, "f": 1.0}, "x": {"y": "z"}}
    assert base["a"]["b"] is True
    with pytest.raises(ValueError):
        files.override(base, ["a.b"])


def test_fact_csv_with_bom_and_empty(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("﻿h,h_label,r,t,t_label,tau_start,l_h_lat\nQ1,A,bornIn,Q2,B,,\nQ3,C,diedIn,Q4,D,x,7.5\n", encoding="utf-8")
    got = files.union_files(spark, [str(p)]).collect()
    assert [(r["h"], r["tau_start"], r["l_h_lat"], r["src_file"]) for r in got] == [("Q1", None, None, "x.csv"), ("Q3", None, 7.5, "x.csv")]
    assert sinks.fact_csv(spark.createDataFrame([], "h string"), str(tmp_path / "no"), ["h"]) == ""


def test_coded_event_headers(spark, tmp_path):
    (tmp_path / "b.tab").write_text("ID\tEvent Date\tSource Name\tTarget Name\tCAMEO Code\tCountry\tLatitude\n1\t2001-01-01\tA\tB\t010\tVietnam\t1.5\n", encoding="utf-8")
    r = one(files.coded_events(spark, [str(tmp_path / "b.tab")]))
    assert (r["h_label"], r["cameo"], r["country"], r["l_t_lat"], r["h_country"]) == ("A", "010", "Vietnam", 1.5, None)
    assert files.coded_events(spark, []).count() == 0


def test_missing_caches_are_empty(spark, tmp_path):
    assert files.cache_table(spark, str(tmp_path / "none")).count() == 0
    assert files.tolerant_json(spark, str(tmp_path / "none"), "a int").count() == 0


def test_service_retries_then_raises(spark, tmp_path):
    with pytest.raises(Exception):
        remote.fetch(spark, ["a"], transport="fixture", fixture=str(tmp_path / "none.json"), backoff="0").collect()


def test_service_column(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"a": "1", "b": {"x": 2}}')
    keys = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "k string")
    got = {r["key"]: (r["ok"], r["body"]) for r in remote.fetch_column(keys, "k", transport="fixture", fixture=str(tmp_path / "f.json")).collect()}
    assert got == {"a": (True, "1"), "b": (True, '{"x": 2}'), "c": (False, None)}


def test_sheet(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="A" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>qid</t></is></c><c r="B1" t="inlineStr"><is><t>grade</t></is></c></row><row r="2"><c r="B2"><v>1</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in files.sheet(spark, str(tmp_path / "w.xlsx"), "A").collect()] == [(None, "1")]
    with pytest.raises(ValueError):
        files.sheet(spark, str(tmp_path / "w.xlsx"), "B")


def test_place_of_a_description(spark):
    from loomgraph.operators.parsers import place_link

    cases = {
        "[[Trận A]] ở [[Huế]], kinh đô tại [[Hà Nội]]": "Hà Nội", "[[Trận A]] ở [[Trận A]] rồi trên [[Sông B|sông Bê]]": "sông Bê", "[[Trận A]] tạit [[Huế]]": "", "tại [[Trận A]] và [[Huế]]": "", "[[Trận A]] Ở [[Huế#x|]]": "", "[[A]] TẠI [[Huế]]": "Huế",
        "[[A]] tại " + "x" * 90 + "[[Huế]]": "", "[[A]] tại tại [[Huế]]": "Huế", "không liên kết": "", "[[A]] ở [[B]] ở [[C]]": "B",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "d string").select("d", place_link(F.col("d")).alias("p"))
    assert {r["d"]: r["p"] for r in df.collect()} == cases | {None: None}


def test_bootstrap_equals_a_plain_one(spark):
    import hashlib

    rows = [(i, 1 + i % 7, 1 + i % 5) for i in range(40)]
    got = one(metrics.bootstrap(spark.createDataFrame(rows, "i long, rank_a int, rank_b int"), 60))
    d = [1 / a - 1 / b for _, a, b in rows]
    obs, hit = sum(d) / len(d), 0
    for rep in range(60):
        w = [sum(int(hashlib.md5(f"0|{rep}|{i}".encode()).hexdigest()[:12], 16) >= t for t in metrics.POISSON) for i, _, _ in rows]
        hit += round(abs(sum(x * y for x, y in zip(w, d)) / sum(w)), 9) >= round(abs(obs), 9)
    assert got["observed"] == round(obs, 6) and got["p"] == round(hit / 60, 6)


def test_latency_of_few_values(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (None,), (2.0,), (10.0,)], "v double")
    r = one(metrics.latency(df, "v"))
    assert (r["mean"], r["p50"], r["p95"]) == (4.0, 2.5, 8.95)
    assert tuple(one(metrics.latency(df.where("v > 99"), "v"))) == (None, None, None)


def test_checkpoint_folder_is_asked_for_on_a_cluster(monkeypatch):
    from loomgraph import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class D:
                    @staticmethod
                    def getCheckpointDir():
                        class E:
                            isDefined = staticmethod(lambda: False)

                        return E

                return D

        getConf = staticmethod(Conf)

    class Session:
        sparkContext, conf = Context, Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.ensure_checkpoint_dir(Session)


def test_images(spark, tmp_path):
    import numpy as np

    from loomgraph.sources import images

    px = np.arange(4 * 6 * 3).reshape(4, 6, 3) % 256
    data = images.encode_pixmap(px)
    assert (images.decode_pixmap(data) == px).all() and (images.decode_pixmap(b"P5 # grey\n2 1\n255\n\x01\x02") == [[[1] * 3, [2] * 3]]).all()
    assert np.allclose(images.area_means(px, 2, 3), px.reshape(2, 2, 3, 2, 3).mean((1, 3))) and images.area_means(px, 8, 12).shape == (8, 12, 3)
    (tmp_path / "a.ppm").write_bytes(data)
    (tmp_path / "b.ppm").write_bytes(b"nothing")
    df = images.read_images(spark, str(tmp_path))
    got = {r["path"][-5:]: (r["ok"], r["width"], r["height"]) for r in images.thumbnails(df, "path", 3).collect()}
    assert got == {"a.ppm": (True, 3, 2), "b.ppm": (False, None, None)}
    vec = images.features(df, "path", unit=True).collect()
    assert len(vec) == 1 and len(vec[0]["vec"]) == 768 and abs(sum(x * x for x in vec[0]["vec"]) - 1) < 1e-9
    waits, answers = [], iter([(429, b""), (429, b""), (200, b"x")])
    assert images.download("u", lambda _: next(answers), sleep=waits.append) == b"x" and waits == [30, 60]
    assert images.download("u", lambda _: (429, b""), sleep=waits.append) is None and waits[2:] == [30, 60, 120] and images.download("u", lambda _: (404, b"")) is None


def test_training_learns_saves_and_resumes(spark, tmp_path, sf_dir):
    from loomgraph.operators import training
    from loomgraph.plans.base import facts

    f = facts(spark, sf_dir).limit(60)
    path = str(tmp_path / "run")
    h = training.train(spark, f, path, 4, epochs=3, rate=5.0).collect()
    assert [r["epoch"] for r in h] == [0, 1, 2] and h[2]["loss"] < h[0]["loss"]
    assert sorted(map(tuple, training.train(spark, f, path, 4, epochs=9).collect())) == sorted(map(tuple, h))  # finished: not run again
    import shutil

    shutil.rmtree(f"{path}/history")
    again = training.train(spark, f, path, 4, epochs=1).collect()
    assert abs(again[0]["loss"] - h[2]["loss"]) < 1e-9  # goes on from the saved tables
    with pytest.raises(ValueError, match="width"):
        training.load_parameters(spark, f"{path}/tables", 5)


def test_question_pass_ablations(spark, sf_dir):
    from loomgraph.operators import training as tn
    from loomgraph.plans.base import facts

    f = facts(spark, sf_dir).limit(40)
    q = f.limit(5).selectExpr("concat('q', fact_id) as qid", "fact_id", "t as answer_entity").withColumn("qv", tn.stub_vector(F.col("qid"), 4))
    pool, tables = f.limit(3).select("fact_id"), tn.start_tables(spark, 4)
    base = {r["qid"]: (r["rank"], round(r["loss"], 6)) for r in tn.question_pass(q, f, pool, tables).collect()}
    plain = {r["qid"]: (r["rank"], round(r["loss"], 6)) for r in tn.question_pass(q, f, pool, tables, drop_facts=True).collect()}
    assert base and base.keys() == plain.keys() and base != plain and all(r >= 1 and x >= 0 for r, x in base.values())


def test_scores_that_single_precision_cannot_tell_apart(spark):
    """Cells on both sides of the goal's score by 1e-8, with more entities than single precision counts."""
    from loomgraph.operators import training as tn

    row = lambda rows: spark.createDataFrame(rows, "id int, vec array<double>")
    tables = {"E_x": row([(0, [100.0]), (1, [100.00000001]), (2, [99.99999999]), (3, [100.0000000001])]), "E_y": row([(0, [0.0])]), "E_t": row([(0, [0.0])])}
    cells = spark.createDataFrame([(0, 5), (1, 33_554_433), (2, 7), (3, 11)], "cell int, n long")
    goal = spark.createDataFrame([("q", [1.0], 0)], "qid string, x array<double>, cell int")
    r = tn.cell_scores(goal, cells, tables).first()
    assert (r["better"], sorted(r["ties"])) == (33_554_433, [0, 3])


def test_evaluation_reads_questions_twice(spark, sf_dir):
    """Once for the facts and once for the questions asked; both are kept."""
    from loomgraph.plans import model

    sc, jvm = spark.sparkContext, spark.sparkContext._jvm

    def read():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).inputRecords() for i in range(stages.size()) if stages.apply(i).inputRecords() >= rows}

    rows = spark.read.parquet(f"{sf_dir}/questions.parquet").count()
    old = read()
    model.book.queries["model_evaluate"](spark, sf_dir).collect()
    assert sum(n for i, n in read().items() if i not in old) == 2 * rows


def test_scores_by_cell_equal_scores_by_entity(spark):
    """Every entity counts, but scores are taken once per cell: 9 cells hold 9 million entities here."""
    import numpy as np

    from loomgraph.operators import training as tn

    tables = tn.start_tables(spark, 4)
    ids = [0, 1, 6401, 12802, 100_000, 200_001, 300_002, 409_598, 409_599]
    cells = spark.createDataFrame([(c, 1_000_000 + i) for i, c in enumerate(ids)], "cell int, n long")
    x = [[0.5, -0.25, 0.125, 1.0], [0.0, 0.0, 0.0, 0.0], [-1.0, 0.3, 0.7, 0.2]]
    goal = spark.createDataFrame([(f"q{i}", v, ids[3 * i]) for i, v in enumerate(x)], "qid string, x array<double>, cell int")
    got = {r["qid"]: r for r in tn.cell_scores(goal, cells, tables, block=1).collect()}
    rows = {k: np.array([r["vec"] for r in sorted(t.collect(), key=lambda r: r["id"])]) for k, t in tables.items()}
    ev = [rows["E_x"][c // 6400] + rows["E_y"][c // 100 % 64] + rows["E_t"][c % 100] for c in ids]
    for i, v in enumerate(x):
        s = [round(float(np.dot(v, e)), 9) for e in ev]
        mine = s[3 * i]
        assert got[f"q{i}"]["better"] == sum(1_000_000 + k for k, z in enumerate(s) if z > mine)
        assert sorted(got[f"q{i}"]["ties"]) == [c for c, z in zip(ids, s) if z == mine]
        assert abs(got[f"q{i}"]["loss"] - min(np.log(sum((1_000_000 + k) * np.exp(z - mine) for k, z in enumerate(s))), 27.631021115928547)) < 1e-6
