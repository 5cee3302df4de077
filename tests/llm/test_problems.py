"""Problems 1 to 9 against brute force, planted cases and edge cases."""

import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.text import compare_key, fold
from loomgraph.llm import p1_survivor as p1
from loomgraph.llm import p2_mojibake as p2
from loomgraph.llm import p3_overlap as p3
from loomgraph.llm import p4_pairs as p4
from loomgraph.llm import p5_splits as p5
from loomgraph.llm import p6_lookalikes as p6
from loomgraph.llm import p7_leaks as p7
from loomgraph.llm import p8_mixture as p8
from loomgraph.llm import p9_language as p9

Q = "qid string, fact_id long, relation string, template_id string, question string, answer_entity string, answer_label string, h string, h_label string, t string, t_label string, tau_start int, source string"
#: Columns of the operators' own names, to clash with.
CLASH = ("src", "key", "gid", "n", "p", "v", "root", "cid", "core", "entity", "is_eval", "draw", "rn", "__part", "words", "text2", "host", "fmt", "ll", "tokens", "demand", "k", "mine", "other", "cell")


def clashing(df):
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def q_row(qid, fact, question, entity="E", label="L", h="H", t="T", t_label="L", tau=None, source="landmarks.csv", template="bornIn_t1", h_label="HL"):
    return (qid, fact, "bornIn", template, question, entity, label, h, h_label, t, t_label, tau, source)


SYL = "Nguật Trước Siếc Ngợp Phĩa Tránh Miềm Phừng Xuyển Nhừ Còa Quẽm Diễn Chiệt Riệt Tãi Gủi Khoãn Doải Nhậy Truyển Lũy Muồn Bồm".split()


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        name = " ".join(rng.choice(SYL) for _ in range(4))
        rows.append(q_row(f"q{i:04d}", i // 2, f"{name} sinh ra ở đâu?", entity=f"E{i % 5}", h=f"H{i % 37}" if i % 9 else None, t=f"T{i % 5}", t_label=SYL[i % 5], label=SYL[i % 5], source=["landmarks.csv", "x", None][i % 3]))
    extra = [q_row("z1", None, None, None, None, None, None, None, None, None, None), q_row("z2", 1, ""), q_row("z3", 1, "?!", h=" "), q_row("z4", 3, rows[0][4].upper() + " ​"), q_row("z5", 4, rows[0][4]), q_row("z5", 4, rows[0][4]), q_row("z6", None, "a" * 30000, h="H1")]
    return clashing(spark.createDataFrame(rows + extra, Q))


@pytest.fixture(scope="module")
def files(spark):
    return clashing(spark.createDataFrame([("landmarks.csv", 1), ("b.csv", 2)], "file_name string, priority int"))


DOCS = "doc_id long, text string, lang string, source string, n_chars long, about_qid string, origin_format string"
SENT = {
    "vi": ["Người ta còn nhắc tên vị tướng khi kể chuyện trận đánh bên sông", "Mỗi mùa gặt đoàn rước đi từ ngôi đình cổ về làng bên", "Con đường nối hai làng được mở dưới thời vua trẻ"],
    "en": ["The people of the village still tell the story of the battle by the river", "Every harvest a procession walks from the old temple to the town", "The road between the two villages was opened by the young king"],
    "fr": ["Les habitants du village racontent encore la bataille près du fleuve", "Pendant la moisson un cortège va du vieux temple à la ville", "La route entre les deux villages fut ouverte par le jeune roi"],
    "de": ["Die Leute im Dorf erzählen noch von der Schlacht am Fluss", "Zu der Ernte zieht man vom alten Tempel in die Stadt", "Die Straße zwischen den beiden Dörfern wurde vom jungen König eröffnet"],
    "es": ["Los vecinos del pueblo todavía cuentan la batalla cerca del río", "Durante la cosecha la procesión va del viejo templo a la ciudad", "El camino entre los dos pueblos fue abierto por el joven rey"],
    "pt": ["Os moradores da aldeia ainda contam a batalha perto do rio", "No tempo da colheita o cortejo vai do velho templo até a cidade", "A estrada entre as duas aldeias foi aberta pelo jovem rei"],
}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = []
    for i in range(180):
        lang = list(SENT)[i % 6]
        text = ". ".join(rng.choice(SENT[lang]) for _ in range(4)) + "."
        label = {0: None, 1: "fr" if lang != "fr" else "de"}.get(i % 10, {"vi": "vi-VN", "en": "English"}.get(lang, lang))
        rows.append((i, text, label, ["crawl", "portal", None][i % 3], len(text), "Q1", ["html", None][i % 2]))
    rows.append((900, ". ".join([SENT["vi"][0], SENT["vi"][1], SENT["en"][0], SENT["en"][1]]) + ".", "vi", "crawl", 1, "Q", "txt"))
    rows += [(901, None, None, None, None, None, None), (902, "", "vi", "", 0, "", ""), (903, "12 34 !!", "??", "x", 8, "q", "t"), (904, fold(". ".join(SENT["vi"])), "vn", "x", 8, "q", "t"), (905, (SENT["vi"][0] + ". ") * 3000, "vi", "crawl", 8, "q", "t"), (905, SENT["vi"][0], "vi", "crawl", 8, "q", "t")]
    return clashing(spark.createDataFrame(rows, DOCS))


def empty(df):
    return df.limit(0)


# 1
def test_p1_keeps_the_trusted_record(spark, questions, files):
    run = p1.survivors(questions, files, ranked=True, iterations=2)
    got = {r["qid"] for r in run.chosen.collect()}
    assert got == {r["qid"] for r in run.records.collect()}
    groups = {}
    rank = {"landmarks.csv": 1}
    for r in questions.collect():
        k = compare_key(r["question"])
        if k:
            groups.setdefault(k, []).append((rank.get(r["source"], 99), r["fact_id"] is None, r["fact_id"] or 0, r["qid"]))
    assert got == {min(g)[3] for g in groups.values() if len(g) > 1}
    assert p1.survivors(empty(questions), empty(files), iterations=1).records.count() == 0


def test_p1_found_runs_no_stage_without_effect(spark, questions, files, monkeypatch):
    """The ranks decide which record p1_found keeps; a model that cannot change a row is not fitted."""
    from loomgraph.llm import queries

    want = {r["qid"] for r in p1.survivors(questions, files, ranked=True, iterations=1).chosen.collect()}
    monkeypatch.setattr(p1, "fit", lambda *a: pytest.fail("fitted"))
    monkeypatch.setattr(queries, "table", lambda spark, d, name: {"questions": questions, "source_files": files}[name])
    assert {r["qid"] for r in queries.queries()["p1_found"](spark, "").collect()} == want and want


def test_p1_multi_valued_fields_keep_every_true_value(spark, files):
    rows = [q_row(f"a{i}", i, f"câu {i}?", entity=f"E{i}", source="good") for i in range(60)] + [q_row(f"b{i}", i, f"câu {i}?", entity=f"E{i}", source="also") for i in range(60)]
    rows += [q_row(f"c{i}", i, f"câu {i}?", entity=f"X{i}", source="bad") for i in range(40)] + [q_row("d", 0, "câu 0?", entity="F0", source="good"), q_row("e", 0, "câu 0?", entity="F0", source="also")]
    s = p1.survivors(spark.createDataFrame(rows, Q), files)
    values = {(r["qid"], r["value"]): r["is_true"] for r in s.values.where("field = 'answer_entity'").collect()}
    assert values["a0", "E0"] and values["a0", "F0"] and not values["a5", "X5"]
    quality = {r["src"]: r for r in s.sources.where("field = 'answer_entity'").collect()}
    assert quality["good"]["sensitivity"] > quality["bad"]["sensitivity"] and quality["bad"]["specificity"] < 0.7 < quality["good"]["specificity"]


def test_p1_the_record_follows_the_sources_quality(spark, files):
    """Three sources agree or not in 50 groups; the record of the 51st, where only two of them speak, is that of the better one, whichever it is."""
    for good, bad in (("alpha", "omega"), ("omega", "alpha")):
        rows = []
        for i in range(50):
            rows += [q_row(f"g{i}", 10 * i + 5, f"câu {i}?", entity=f"E{i}", source=good), q_row(f"h{i}", 10 * i + 6, f"câu {i}?", entity=f"E{i}", source="third"), q_row(f"b{i}", 10 * i, f"câu {i}?", entity=f"X{i}", source=bad)]
        rows += [q_row("last-" + bad, 1000, "câu cuối?", entity="wrong", source=bad), q_row("last-" + good, 1001, "câu cuối?", entity="right", source=good)]
        q = spark.createDataFrame(rows, Q)
        free = p1.survivors(q, files)
        assert "last-" + good in {r["qid"] for r in free.chosen.collect()}
        assert {r["answer_entity"] for r in free.records.where("question = 'câu cuối?'").collect()} == {"right"}
        assert "last-" + bad in {r["qid"] for r in p1.survivors(q, files, ranked=True).chosen.collect()}  # both rank 99: fact_id decides


def test_p1_equals_brute_force_em(spark, files):
    rng = random.Random(9)
    rows = []
    for g in range(40):
        for k in range(rng.randint(2, 5)):
            rows.append(q_row(f"q{g:02d}{k}", g * 10 + k, f"câu hỏi {g}?", entity=f"E{g}{rng.randint(0, 1)}", label=rng.choice(["L", "M", None]), source=rng.choice(["a", "b", "c", None]), tau=rng.choice([None, 5, 6])))
    got = p1.survivors(spark.createDataFrame(rows, Q), files, iterations=4)
    claims = {}
    for r in rows:
        for field, value in (("question", r[4]), ("tau_start", None if r[11] is None else str(r[11])), ("h", r[7]), ("answer_entity", r[5]), ("answer_label", r[6])):
            if value:
                claims.setdefault((r[4], field), {}).setdefault(value, set()).add(r[12] or "(none)")
    sens, spec = {}, {}
    for (_, field), values in claims.items():
        for s in set().union(*values.values()):
            sens[field, s], spec[field, s] = 0.8, 0.9

    def posterior(field, pos, neg):
        z = sum(np.log(sens[field, s] / (1 - spec[field, s])) for s in pos) + sum(np.log((1 - sens[field, s]) / spec[field, s]) for s in neg)
        return 1 / (1 + np.exp(-z))

    def facts():
        for (g, field), values in claims.items():
            there = set().union(*values.values())
            for v, pos in values.items():
                yield g, field, v, pos, there - pos, posterior(field, pos, there - pos)

    for _ in range(4):
        tp, t, tn, f = ({k: 0.0 for k in sens} for _ in range(4))
        for _, field, _, pos, neg, p in facts():
            for s in pos | neg:
                tp[field, s] += p * (s in pos)
                t[field, s] += p
                tn[field, s] += (1 - p) * (s in neg)
                f[field, s] += 1 - p
        for k in sens:
            spec[k] = (tn[k] + 9.5) / (f[k] + 10)
            sens[k] = max((tp[k] + 8) / (t[k] + 10), 1.02 - spec[k])
    for r in got.sources.collect():
        assert abs(r["sensitivity"] - sens[r["field"], r["src"]]) < 2e-6 and abs(r["specificity"] - spec[r["field"], r["src"]]) < 2e-6
    want = sorted((field, v, round(p, 5)) for _, field, v, _, _, p in facts())
    have = sorted((r["field"], r["value"], r["posterior"]) for r in got.values.collect())
    assert [x[:2] for x in want] == [x[:2] for x in have] and np.allclose([x[2] for x in want], [x[2] for x in have], atol=2e-5)


# 2
LABELS = ["Cuộc vây hãm Nguật Trước", "Trận Siếc Ngợp Phĩa Tránh", "Nơi sinh của Đoàn Khỗng Quĩa Nhậy là gì?", "Chiến dịch Miềm Phừng – Xuyển Nhừ", "Khởi nghĩa Còa Quẽm Đừng Thiềm", "Vụ tập kích Chiệt Riệt Tãi Gủi"] * 30


@pytest.fixture(scope="module")
def model(spark):
    return p2.Model(p2.bigram_counts(spark.createDataFrame([(x,) for x in LABELS], "text string")))


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "cp1258", "cp1252*2", "tcvn3"])
def test_p2_round_trip(model, codec):
    for text in LABELS[:6]:
        bad = "".join(p2.images(c, codec)[0][0] for c in text)
        fixed, states = model.repair(bad)
        assert states and fixed == text, (codec, bad, fixed)


def test_p2_partial_lost_and_clean(model):
    bad = "Trận " + "".join(p2.images(c, "cp1252")[0][0] for c in "Siếc Ngợp") + " Phĩa Tránh"
    assert model.repair(bad)[0] == "Trận Siếc Ngợp Phĩa Tránh"
    for lost in ("Si���c Ng���p", "Si?c Ng?p Ph?a Tránh"):
        assert model.repair(lost)[1] == ["lost"]
    for clean in ("Gefecht bei der Brücke über Gon", "Осада речной крепости", "古渡口之戰", "Нộі thề Рhẽm", "Sinh ra ở đâu? ", "Ｔｒậｎ Ｔｒước", "​Trận", "Nguật T­rước"):
        assert model.repair(clean)[1] == [], clean


def test_p2_lost_letters_come_back(spark):
    rows = [(i, x, None) for i, x in enumerate(["Siếc Ngợp", "Siếc Ngợp", "Lũy Tạ", "Lũy Tả", "Miềm Phừng?"])]
    rows += [(90, "Si?c Ng?p", "Si���c Ng���p"), (91, "Mi?m Ph?ng?", "L?y T?"), (92, "Qu?x ?z", "Si?c ? Ng?p")]
    ev = spark.createDataFrame(rows, "row_id long, h_label string, t_label string")
    q = spark.createDataFrame([], Q)
    got = {(r["rec_key"], r["field"]): (r["restored"], r["lossy"]) for r in p2.restored(q, ev).collect()}
    assert got["90", "h_label"] == ("Siếc Ngợp", False) == got["90", "t_label"]
    assert got["91", "h_label"] == ("Miềm Phừng?", False)
    assert got["91", "t_label"] == ("Lũy T?", True)  # two words explain the last one
    assert got["92", "h_label"] == ("Qu?x ?z", True) and got["92", "t_label"] == ("Siếc – Ngợp", False)
    assert p2.restored(q, ev.limit(0)).count() == 0


def test_p2_edges(spark, questions):
    ev = clashing(spark.createDataFrame([(1, "Siáº¿c Ngá»£p", None), (2, "", "x" * 20000), (1, "Siáº¿c Ngá»£p", None)], "row_id long, h_label string, t_label string"))
    got = [(r["rec_key"], r["field"], r["restored"]) for r in p2.damaged(questions, ev).collect()]
    assert got == [("1", "h_label", "Siếc Ngợp")] * 2
    assert p2.found(empty(questions), empty(ev)).count() == 0


def test_p2_images_that_are_clean_letters(spark):
    bad = {"Xuyá»n Nhá»«": "Xuyển Nhừ", "Phiá»…n Khá»“m": "Phiễn Khồm", "Gước Khá»—ng": "Gước Khỗng", "Tẹo Tá»‘t nÃ\xa0o?": "Tẹo Tốt nào?", "Nơi sinh lÃ  gì?": "Nơi sinh là gì?", "Khæng Nhõ Tèt": "Khổng Nhừ Tốt", "Tèt Nhõ": "Tốt Nhừ"}
    assert sum(set(x) <= set(p2.CLEAN) for x in bad) == 6
    good = ["Xuyển Nhừ", "Phiễn Khồm", "Gước Khỗng", "Tẹo Tốt nào?", "Nơi sinh là gì?", "Khổng Nhừ Tốt", "SỰ KIỆN NÀO ĐÃ XẢY RA?", "CUỘC VÂY HÃM", *LABELS] * 20
    rows = [(i, x, None) for i, x in enumerate([*good, "lĂNG Khồm", "“nơi sinh”", *bad])]
    ev = spark.createDataFrame(rows, "row_id long, h_label string, t_label string")
    got = {r["text"]: r["restored"] for r in p2.damaged(spark.createDataFrame([], Q), ev).collect()}
    assert got == bad
    assert p2.found(spark.createDataFrame([], Q), ev).count() == len(bad)


def test_p2_shortcut_loses_no_path(model):
    rng = random.Random(8)
    texts = ["", "\0", LOST_TEXT := "Si\ufffdc", *LABELS, *("".join(rng.choice(p2.images(c, rng.choice(p2.CODECS)) if rng.random() < p else [(c,)])[0] for c in x) for x in LABELS for p in (0.05, 0.2, 0.6, 1) for _ in range(5))]
    may = dict(zip(texts, model.open_texts(texts)))
    assert may[LOST_TEXT] and not may[""] and not all(may[x] for x in LABELS)
    assert all(may[x] or not model.label(x).any() for x in texts if x)
    assert len(model.open_texts([])) == 0


# 3
@pytest.fixture(scope="module")
def overlap_case(spark):
    rng = random.Random(11)
    rows, members = [], []

    def add(text, entity, split):
        qid = f"q{len(rows):05d}"
        rows.append(q_row(qid, 1, text, entity=entity))
        members.append((qid, split))

    for i in range(300):
        name = " ".join(rng.choice(SYL) for _ in range(4))
        text = f"{name} sinh ra ở đâu?"
        entity = "hot" if i % 3 else f"E{i % 7}"
        add(text, entity, rng.choice(["train", "TR", " Train "]))
        if i % 4 == 0:
            w = list(text)
            kind = rng.randrange(6)
            if kind == 0:
                del w[rng.randrange(3, 12)]
            other = {0: "".join(w), 1: fold(text), 2: "Xin hỏi, " + text, 3: text.replace("?", " vậy?"), 4: text.upper(), 5: text.replace("sinh ra", "mất")}[kind]
            add(other, entity, rng.choice(["dev", "held_out", "Test "]))
    rows += [q_row("n1", 1, None), q_row("n2", 1, "x", entity=None), q_row("n3", 1, "b" * 20000)]
    members += [("n1", "test"), ("n2", "test"), ("n3", "train"), ("n3", "test"), ("q00000", "train"), ("ghost", "val"), (None, "val"), ("q00001", None)]
    return clashing(spark.createDataFrame(rows, Q)), clashing(spark.createDataFrame(members, "qid string, split string"))


def brute_overlaps(questions, members):
    side = {}
    for r in members.collect():
        s = (r["split"] or "").strip().lower()
        if r["qid"] and s:
            side.setdefault(r["qid"], set()).add(s[:2] != "tr")
    by = {}
    counts = {}
    for r in questions.collect():
        if r["question"] is None or r["answer_entity"] is None:
            continue
        w = p3.core_words(r["question"])
        for e in side.get(r["qid"], ()):
            by.setdefault(r["answer_entity"], []).append((r["qid"], e, w))
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    out = set()
    for rows in by.values():
        for (a, ea, wa), (b, eb, wb) in itertools.product(rows, rows):
            if ea and not eb and a != b:
                s = p3.compare(wa, wb)
                if s is not None and all(min(counts.get(x, 1), counts.get(y, 1)) * 20 <= max(counts.get(x, 1), counts.get(y, 1)) for x, y in s):
                    out.add((min(a, b), max(a, b)))
    return out


def test_p3_equals_brute_force(spark, overlap_case):
    q, m = overlap_case
    assert {tuple(r) for r in p3.found(q, m).collect()} == brute_overlaps(q, m)


def test_p3_blocks_give_the_same(spark, overlap_case):
    q, m = overlap_case
    rows = p3.membership(q, m)
    whole = {tuple(r) for r in p3.class_pairs(rows).select("eval_cid", "train_cid").collect()}
    assert whole == {tuple(r) for r in p3.class_pairs(rows, eval_block=5, train_block=11).select("eval_cid", "train_cid").collect()}
    assert len(whole) > 30


@pytest.mark.parametrize(("a", "b", "same"), [("Trận A (1622) ở đâu", "Trận A (1807) ở đâu", False), ("lần thứ hai ở đâu", "lần thứ ba ở đâu", None), ("trận II ở đâu", "trận III ở đâu", False), ("Mac Truoc sinh ra o dau", "Mạc Trước sinh ra ở đâu", True), ("mất đâu nhé X Y", "mất ở đâu nhé X Y", True)])
def test_p3_pairs_of_words(a, b, same):
    got = p3.compare(p3.words_of(a), p3.words_of(b))
    assert (got is not None) == (same is not False) if same is not None else got is None or got


@pytest.mark.parametrize("many", [False, True])
def test_p3_two_slips_anywhere_reach_the_exact_check(many):
    import pandas as pd

    rng = random.Random(9)
    swap = lambda x, i: x[:i] + x[i + 1] + x[i] + x[i + 2 :]
    names = ["ab", "abcd", "doải", "gủi ở đâu", "nguật trước sinh ra", "ngợp gủi tránh diễn tránh ở đâu", "trận siếc ngợp phĩa tránh diễn ra tại đâu"]
    for name in names:
        edits = [lambda x, i: swap(x, i) if " " not in x[i : i + 2] else x, lambda x, i: x[:i] + "k" + x[i + 1 :] if x[i] != " " else x, lambda x, i: x[:i] + x[i + 1 :] if x[i] != " " else x, lambda x, i: x[:i] + "k" + x[i:]]
        texts = {name}
        for _ in range(1500):
            x = name
            for _ in range(2):
                x = rng.choice(edits)(x, rng.randrange(len(x) - 1)) if len(x) > 1 else x
            texts.add(" ".join(x.split()))
        texts = sorted(x for x in texts if x)
        rows = [("E", n, f"e{n}", True) for n in ([name, *names] if many else [name])] + [("E", x, x, False) for x in texts]
        got = p3._scan_cell(pd.DataFrame(rows, columns=["entity", "core", "cid", "is_eval"]))
        want = {x for x in texts if p3.compare(name.split(), x.split()) is not None}
        assert set(got[got.eval_cid == f"e{name}"].train_cid) == want, name


@pytest.mark.parametrize("many", [1, 300])
def test_p3_no_pair_of_two_slips_is_lost_before_the_exact_check(many):
    """5,000 passages with two slips each (letters changed, dropped, added, swapped, also next to each other): the scan proposes every one, whatever the exact check then says."""
    rng = random.Random(many)
    letters = "abcdeghiklmnopqrstuvxy"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 60))) for _ in range(many)]
    scan = p3.Passages(passages)
    for n in range(5000):
        k = rng.randrange(many)
        x = list(passages[k])
        at = rng.randrange(len(x))
        for _ in range(2):
            i = min(max(at + rng.choice([0, 0, 1, 2, 8, -5, rng.randrange(60)]), 0), len(x) - 1)
            kind = rng.randrange(4)
            if kind == 0:
                x[i] = rng.choice(letters)
            elif kind == 1 and len(x) > 3:
                del x[i]
            elif kind == 2:
                x.insert(i, rng.choice(letters))
            elif i + 1 < len(x):
                x[i], x[i + 1] = x[i + 1], x[i]
        assert k in dict(scan.scan("".join(x), p3._LEAST)), (passages[k], "".join(x))


def test_p3_coverage_is_of_merged_intervals_in_place():
    p = p3.Passages(["abcdefghijklmnop"])
    assert p.coverage(0, "abcdefghijklmnop", 2) == 1.0 and p.coverage(0, "opmnklijghefcdab", 2) == 0.25 and p.coverage(0, "abcdefgh--------", 2) == 0.5 and p.coverage(0, "", 2) == 0.0


def test_p3_keys_lose_no_pair_of_two_slips():
    """Any two mistyped, lost, added or swapped letters leave a key of the passage to the training text, at every length."""
    rng, abc = random.Random(5), "abcdeghiklmnopqrstuvxy"
    row, zero = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32).reshape(1, -1), np.zeros(1, np.uint64)

    def slip(t):
        i, kind = rng.randrange(len(t)), rng.randrange(4)
        return t[:i] + (rng.choice(abc) + t[i + 1 :], t[i + 1 :], rng.choice(abc) + t[i:], t[i : i + 2][::-1] + t[i + 2 :])[kind]

    for n in [*range(2, 16), *range(16, 60, 5)]:
        for _ in range(12):
            t = "".join(rng.choice(abc) for _ in range(n))
            u = slip(slip(t) or "a")
            if u and p3.osa(t, u, 2) <= 2:
                assert {int(k[0]) for k in p3._keys(row(t), zero, True)} & {int(k[0]) for k in p3._keys(row(u), zero, False)}, (t, u)
                assert (int(p3._letters_of(row(t))[0]) ^ int(p3._letters_of(row(u))[0])).bit_count() <= 4


def test_p3_a_large_entity_does_not_multiply(spark):
    """Texts of one entity meet by keys: few of all pairs of its texts go to the check."""
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdghklmnt") + rng.choice("aeiouy") for _ in range(2)) for _ in range(200)]
    rows = [("e", "noi sinh cua " + " ".join(rng.choice(words) for _ in range(5)) + " la gi", f"c{i}", i % 5 == 0) for i in range(2000)]
    rows += [("e", rows[0][1].replace("sinh", "sing"), "near", False)]
    df = spark.createDataFrame(rows, "entity string, core string, cid string, is_eval boolean")
    assert ("c0", "near") in {(r["eval_cid"], r["train_cid"]) for r in p3.large_pairs(df).collect()}
    keyed = df.withColumn("id", F.xxhash64("cid")).withColumn("salt", F.lit(7).cast("long"))
    assert p3.near_pairs(keyed).count() < 2000  # of 640,000


def test_p3_empty_and_report(spark, overlap_case):
    q, m = overlap_case
    assert p3.found(empty(q), m).count() == 0 == p3.found(q, empty(m)).count()
    r = p3.report(q, m).collect()
    pairs = p3.overlaps(q, m).collect()
    assert sum(x["n_pairs"] for x in r) == len(pairs)
    assert {(x["split"], x["source"]): (x["n_pairs"], x["n_eval_hit"]) for x in r if x["n_pairs"]} == {k: (sum(1 for p in pairs if (p["split"], p["eval_source"]) == k), len({p["eval_qid"] for p in pairs if (p["split"], p["eval_source"]) == k})) for k in {(p["split"], p["eval_source"]) for p in pairs}}


def test_p3_report_of_a_record_on_both_sides(spark):
    """A question in train and in test makes no pair with itself, but with its copies on the other side."""
    q = spark.createDataFrame([q_row(f"q{i}", i, "Siếc Ngợp Phĩa Tránh nằm ở tỉnh nào?") for i in range(3)], Q)
    m = spark.createDataFrame([("q0", "train"), ("q0", "test"), ("q1", "train"), ("q2", "test")], "qid string, split string")
    r = p3.report(q, m).collect()
    assert [(x["n_pairs"], x["n_eval_hit"], x["n_eval"], x["mean_coverage"]) for x in r] == [(3, 2, 2, 1.0)] and p3.overlaps(q, m).count() == 3


# 4
@pytest.fixture(scope="module")
def checker(docs):
    return p4.Checker(p9.train(docs), p4.end_counts(docs.select(F.lit("Siếc Ngợp").alias("x")), "x"))


@pytest.mark.parametrize(
    ("question", "answer", "tau", "kind"),
    [
        ("A sinh ra ở đâu?", None, None, "empty"), ("A sinh ra ở đâu?", " ​", None, "empty"), ("A sinh ra ở đâu?", "(trống)", None, "empty"), ("A sinh ra ở đâu?", "N/A", None, "empty"), ("A sinh ra ở đâu?", "—", None, "empty"),
        ("A sinh ra ở đâu?", "Siếc", None, "truncated"), ("A sinh ra ở đâu?", "Siếc Ng…", None, "truncated"), ("A sinh ra ở đâu?", "tỉnh Siếc", None, "truncated"),
        ("A sinh ra ở đâu?", "Xin lỗi, tôi không biết câu trả lời", None, "refusal"), ("A sinh ra ở đâu?", "I cannot answer this question.", None, "refusal"), ("A sinh ra ở đâu?", "Je ne sais pas", None, "refusal"),
        ("Mạc Trước sinh ra ở đâu?", "Đáp án là Mạc Trước sinh ra ở đâu?", None, "copy"), ("Mạc Trước sinh ra ở đâu?", "Mac Truoc sinh ra o dau", None, "copy"), ("Mạc Trước Siếc Ngợp sinh ra ở đâu?", "Mạc Trước Siếc Ngợp sinh ra", None, "copy"),
        ("A sinh ra ở đâu?", "河边的古城", None, "language"), ("A sinh ra ở đâu?", "the people of the village of Siếc Ngợp by the river", None, "language"),
        ("B vào năm 1965, ở đâu?", "Siếc Ngợp", 1966, "year"), ("B vào năm 895 TCN, ở đâu?", "Siếc Ngợp", 895, "year"), ("B vào NĂM 1965, ở đâu?", "Siếc Ngợp", None, "year"), ("B vao nam 1965, o dau?", "Siếc Ngợp", None, "year"),
        ("B vào năm 895 TCN, ở đâu?", "Siếc Ngợp", -895, None), ("A sinh ra ở đâu?", " tỉnh Siếc Ngợp.", None, None), ("A sinh ra ở đâu?", "Siếc Ngợp", None, None), (None, "Siếc Ngợp", None, None), ("A sinh ra ở đâu?", "Thành phố Siếc Ngợp", None, None),
    ],
)
def test_p4_kinds(checker, question, answer, tau, kind):
    assert checker.defect(question, answer, "Siếc Ngợp", "Siếc Ngợp", tau)[0] == kind


def test_p4_rests_on_its_models(docs):
    """Without the end-of-text model nothing is truncated; the prompt's language is estimated: the same answer is a defect behind a Vietnamese prompt and none behind one of its own language."""
    counts = p9.train(docs)
    full = p4.Checker(counts, p4.end_counts(docs.select(F.lit("Siếc Ngợp").alias("x")), "x"))
    none = p4.Checker(counts, {})
    none.end.own = 0.0
    assert full.defect("A sinh ra ở đâu?", "Siếc", "Siếc Ngợp", "Siếc Ngợp", None)[0] == "truncated" and none.defect("A sinh ra ở đâu?", "Siếc", "Siếc Ngợp", "Siếc Ngợp", None)[0] is None
    answer = "the people of the village by the river and the temple of the king"
    assert full.defect("người dân của làng kể câu chuyện ở đâu?", answer, "Siếc Ngợp", "Siếc Ngợp", None)[0] == "language"
    assert full.defect("which people of the old city and the river built the temple for the king", answer, "Siếc Ngợp", "Siếc Ngợp", None)[0] is None


def test_p4_stand_in_labels_need_no_digit(spark, docs):
    rows = [q_row("a", 1, "x ở đâu?", t="T", t_label="N/A", label="N/A"), q_row("b", 2, "x năm 12 ở đâu?", t="T", t_label="N/A", label="N/A", tau=12)]
    assert {tuple(r) for r in p4.found(spark.createDataFrame(rows, Q), docs).collect()} == {("a", "empty"), ("b", "empty")}


def test_p4_full_label_is_the_majoritys(spark, docs):
    rows = [q_row(f"a{i}", i, f"câu {i} ở đâu?", t="T", t_label="Siếc Ngợp", label="Siếc Ngợp") for i in range(3)] + [q_row("b", 9, "x ở đâu?", t="T", t_label="Siếc", label="Siếc"), q_row("c", 9, "x ở đâu?", t=None, t_label=None, label="Lũy"), q_row("d", 9, "x" * 9000, t=" ", t_label="Lũy", label="Lũy")]
    q = clashing(spark.createDataFrame(rows, Q))
    assert {tuple(r) for r in p4.found(q, docs).collect()} == {("b", "truncated")}
    assert p4.found(empty(q), empty(docs)).count() == 0


# 5
def test_p5_equals_union_find(spark, questions):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    rows = questions.collect()
    for r in rows:
        me = find(("q", r["qid"]))
        for k in ("fact_id", "h"):
            if r[k] is not None and str(r[k]).strip():
                a, b = find(("q", r["qid"])), find((k, r[k]))
                parent[a] = b
        del me
    groups = {}
    for r in rows:
        groups.setdefault(find(("q", r["qid"])), set()).add(r["qid"])
    want = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    assert {tuple(r) for r in p5.found(questions).collect()} == want
    assert p5.found(empty(questions)).count() == 0 == p5.assign(empty(questions)).count()


def test_p5_long_chain(spark):
    n = 400
    rows = [q_row(f"q{i:04d}", i, "x", h=f"h{i // 2}") for i in range(n)] + [q_row(f"r{i:04d}", i, "x", h=f"h{(i + 1) // 2}") for i in range(n)]
    random.Random(1).shuffle(rows)
    c = p5.components(spark.createDataFrame(rows, Q))
    assert c.select("group_qid").distinct().count() == 1 and c.count() == 2 * n


def test_p5_assignment_keeps_groups_and_hits_the_totals(spark, questions):
    a = p5.assign(questions).collect()
    assert len({r["qid"] for r in a}) == questions.where("qid is not null").select("qid").distinct().count()
    by = {}
    for r in a:
        by.setdefault(r["group_qid"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by.values())


def test_p5_subset_sum_is_closest():
    rng = random.Random(3)
    for _ in range(60):
        hist = {rng.randint(1, 9): rng.randint(1, 4) for _ in range(4)}
        total = sum(s * n for s, n in hist.items())
        take = p5.plan_counts(hist, total, (0.1,))[0]
        sizes = [s for s, n in hist.items() for _ in range(n)]
        reach = {0}
        for s in sizes:
            reach |= {x + s for x in reach}
        want = round(0.1 * total)
        assert abs(sum(s * c for s, c in take.items()) - want) == min(abs(x - want) for x in reach) and all(take[s] <= hist[s] for s in hist)


def test_p5_hot_component_needs_little_memory():
    """Components of ten million rows and more: the totals are met and the bitsets stay small."""
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for big in (10**6, 10**7, 10**9):
        hist = {1: 3 * big, 2: big // 4, 3: 1000, 7: 13, big: 1} | {s: 5 for s in range(10, 200)}
        total = sum(s * c for s, c in hist.items())
        plans = p5.plan_counts(hist, total, (0.1, 0.1))
        assert all(sum(s * c for s, c in p.items()) == round(0.1 * total) for p in plans)
        assert all(sum(p[s] for p in plans) <= hist[s] for s in hist)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
    assert p5.plan_counts({10**7: 3, 5 * 10**6: 2}, 4 * 10**7, (0.1,)) == [{10**7: 0, 5 * 10**6: 1}]  # nothing fits: one too large comes closer than none


# 6
def test_p6_other_scripts_are_changed_but_no_cases(spark):
    assert p6.canonical("Осада\u200b речной") == ("Осада речной", True) and p6.canonical("古渡口１２") == ("古渡口12", True)
    ev = spark.createDataFrame([(1, "Осада\u200b речной", "古渡口１２"), (2, "Осада речной", "Siếc\u200b")], "row_id long, h_label string, t_label string")
    sa = spark.createDataFrame([], "qid string, answer string")
    assert {tuple(r) for r in p6.found(ev, sa).collect()} == {("historical_events", "2", "t_label")}
    assert {(r["rec_key"], r["field"]): (r["changed"], r["other_script"]) for r in p6.normalised(p6.labels_long(ev, sa)).collect()} == {("1", "h_label"): (True, True), ("1", "t_label"): (True, True), ("2", "h_label"): (False, False), ("2", "t_label"): (True, False)}


@pytest.mark.parametrize(
    ("text", "form", "changed"),
    [("Ｓｉếｃ Ｎｇợｐ（１６）", "Siếc Ngợp(16)", True), ("Сhіến Тrước", "Chiến Trước", True), ("Nguật Τrước", "Nguật Trước", True), ("Siếc​ Ngợp", "Siếc Ngợp", True), (unicodedata.normalize("NFD", "Siếc Ngợp"), "Siếc Ngợp", True), ("Ðừng Ɖạt", "Đừng Đạt", True), ("Си́", "Си́", False),
     ("Siế­c　N‍gợp", "Siếc Ngợp", True), ("Chiến – Trước", "Chiến – Trước", False), ("Осада речной крепости", "Осада речной крепости", False), ("古渡口之戰", "古渡口之戰", False), ("Brücke über", "Brücke über", False), ("  a   b ", "a b", False), (None, None, False), ("", "", False)],
)
def test_p6_forms(text, form, changed):
    assert p6.canonical(text) == (form, changed)


def test_p6_is_idempotent_and_conflict_free():
    table = p6.build_table()
    assert not set(table.values()) & set(table)
    rng = random.Random(2)
    pool = list("ABcơưếộđ -–Ｓｉ​­ ếТсоΝρЖд")
    for _ in range(500):
        x = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        once = p6.canonical(x)[0]
        assert p6.canonical(once)[0] == once and not p6.canonical(once)[1]


def test_p6_tables(spark):
    ev = clashing(spark.createDataFrame([(1, "Siế​c", "Сhiến"), (2, None, ""), (3, "Siáº¿c Ngá»£p", "x" * 20000), (1, "Siế​c", None)], "row_id long, h_label string, t_label string"))
    sa = clashing(spark.createDataFrame([("q1", "Ｎgợp"), ("q2", None)], "qid string, answer string"))
    got = sorted(tuple(r) for r in p6.found(ev, sa).collect())
    assert got == [("historical_events", "1", "h_label")] * 2 + [("historical_events", "1", "t_label"), ("showcase_samples", "q1", "answer")]
    assert p6.normalised(p6.labels_long(ev, sa)).count() == 10
    assert p6.found(empty(ev), empty(sa)).count() == 0


# 7
def test_p7_equals_brute_force_and_recall(spark, docs):
    rng = random.Random(4)
    words = [w for s in SENT.values() for x in s for w in x.split()] + SYL
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))) for i in range(30)] + [(100, None), (101, ""), (102, "một hai ba")]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is None or len(r["text"]) < 5000]
    planted = 0
    for i in range(400):
        base = [rng.choice(words) for _ in range(rng.randint(15, 80))]
        it = fold(items[rng.randrange(30)][1]).upper().split()
        n = rng.choice([9, 11, 12, 12, 14, 30])
        if len(it) >= n:
            at, o = rng.randrange(len(base)), rng.randrange(len(it) - n + 1)
            base[at:at] = it[o : o + n]
            planted += n >= 12
        rows.append((1000 + i, ", ".join(base)))
    rows.append((5000, " ".join(rng.choice(words) for _ in range(20000)) + " " + (items[0][1] if len(items[0][1].split()) >= 12 else "")))
    d = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    it = clashing(spark.createDataFrame(items, "item_id long, text string"))
    index = {}
    for i, x in items:
        w = fold(x or "").split()
        for k in range(len(w) - 11):
            index.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for i, x in rows:
        w = fold(x or "").split()
        for k in range(len(w) - 11):
            want |= {(i, j) for j in index.get(tuple(w[k : k + 12]), ())}
    got = {tuple(r) for r in p7.found(d, it).collect()}
    assert got == want and planted > 100
    assert p7.found(empty(d), it).count() == 0 == p7.found(d, empty(it)).count()


def test_p7_folds_like_the_text_form():
    rng = random.Random(8)
    pool = list("aZ9 đĐßéÉ.,-\u0301\u200b\ufeffﬁ½①Ｓ　\nᾳΣ") + ["Tốt", "năm 12", "\ud800"]
    texts = [None, ""] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    names: dict[str, int] = {}
    words, off = p7.hash_words(texts)
    for i, t in enumerate(texts):
        want = (fold(t) or "").split()
        got = words[off[i] : off[i + 1]].tolist()
        assert len(got) == len(want)
        for w, h in zip(want, got):
            assert names.setdefault(w, h) == h and (h & 1) == w.isdigit()
    assert len(set(names.values())) == len(names)


def test_p7_finds_paraphrases_with_few_candidates(spark, sf_dir):
    """Planted passages of evaluation texts with every seventh to tenth word changed, dropped or added and all numbers kept."""
    rng = random.Random(3)
    it = spark.read.parquet(f"{sf_dir}/eval_items.parquet")
    items = [(r["item_id"], r["text"]) for r in it.collect()]
    base = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("text").collect()]
    vocab = [w for _, t in items for w in t.split() if not any(c.isdigit() for c in w)]
    rows, truth = [(k, t) for k, t in enumerate(base)], set()
    for k, (i, t) in enumerate(items):
        words = t.split()[:60]
        out, since = [], 0
        for w in words:
            since += 1
            if since >= rng.randint(7, 10) and not any(c.isdigit() for c in w):
                since, y = 0, rng.random()
                out += [rng.choice(vocab)] if y < 0.5 else [] if y < 0.75 else [w, rng.choice(vocab)]
            else:
                out.append(w)
        rows.append((10**6 + k, rng.choice(base)[:800] + " " + " ".join(out)))
        truth.add((10**6 + k, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in p7.leaks(docs, it, paraphrase=0.85).select("doc_id", "item_id").collect()}
    assert len(got & truth) >= 0.9 * len(truth)
    tok, item_tok = p7.cut(p7.tokens(docs, "doc_id")), p7.cut(p7.tokens(it, "item_id"))
    space = spark.sparkContext.broadcast(p7.latent_space(tok))
    pairs = p7.candidates(tok, item_tok, space, p7.RUNS, p7.RUN).select("doc_id", "item_id").distinct().count()
    assert pairs < 0.05 * len(rows) * len(items)


def test_p7_no_paraphrase_of_the_cosine_is_left_out(spark):
    """Every pair of windows with the cosine and the common words asked for is found, not a share of them."""
    rng = random.Random(4)
    words = ["".join(rng.choice("bcdghklmnprstv") + rng.choice("aeiouy") for _ in range(3)) for _ in range(1500)]
    texts = [[rng.choice(words) for _ in range(80)] for _ in range(150)]
    items = []
    for t in texts[:100]:
        w = t[24:48]
        for i in (3, 11, 19):
            w[i] = rng.choice(words)
        items.append(" ".join(w))
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    it = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in p7.leaks(d, it, paraphrase=0.85).collect()}
    space = p7.latent_space(p7.tokens(d, "doc_id"))
    cut_up = [p7.hash_words(x) for x in ([" ".join(t) for t in texts], items)]
    (dv, dr, ds), (iv, ir, _) = (p7.window_vectors(space, w, off, 24, step, p7.RUN) for (w, off), step in zip(cut_up, (8, 4)))
    unit = [v / np.linalg.norm(v.astype(float), axis=1, keepdims=True) for v in (dv, iv)]
    want, (dw, doff), (iw, ioff) = set(), *cut_up
    for a, b in zip(*np.nonzero(unit[0] @ unit[1].T >= 0.85)):
        doc = dw[max(doff[dr[a]], ds[a] - 8) : min(doff[dr[a] + 1], ds[a] + 32)].tolist()
        item = iw[ioff[ir[b]] : ioff[ir[b] + 1]].tolist()
        if p7.lcs(item, doc) >= 0.8 * len(item):
            want.add((int(dr[a]), int(ir[b])))
    assert len(want) > 30 and want <= got
    one = spark.createDataFrame([(1, "a " * 20)], "doc_id long, text string")
    assert p7.found(one, one.withColumnRenamed("doc_id", "item_id")).count() == 1  # words without a direction


def test_p7_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [[rng.randrange(5) for _ in range(rng.randrange(9))] for _ in range(2)]
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert p7.lcs(a, b) == t[-1, -1]


# 8
def test_p8_shares_and_repeats(spark, docs):
    targets = clashing(spark.createDataFrame([("crawl", 0.5, 1), ("portal", 0.4, 4), ("nowhere", 0.1, 2)], "source string, target_share double, max_repeats int"))
    m = p8.mixture(docs, targets).collect()
    s = {r["source"]: r for r in p8.shares(docs, targets).collect()}
    assert s["crawl"]["actual_share"] == pytest.approx(5 / 9, abs=0.02) and s["portal"]["actual_share"] == pytest.approx(4 / 9, abs=0.02) and s["nowhere"]["tokens"] == 0
    assert s["crawl"]["most_repeats"] == 1 and s["portal"]["most_repeats"] <= 4
    assert all(0 <= r["position"] <= 1 for r in m) and [r["position"] for r in m] == sorted(r["position"] for r in m)
    late = lambda src: np.mean([r["position"] for r in m if r["source"] == src])
    assert late("portal") > late("crawl")
    assert p8.mixture(empty(docs), targets).count() == 0 == p8.mixture(docs, empty(targets)).count()


def test_p8_a_document_longer_than_the_demand(spark):
    """One text is longer than all its source may give: the others are repeated in its place and the shares hold."""
    rows = [(i, "năm ba bảy " * 5, "a") for i in range(20)] + [(100, "một hai " * 5000, "b")] + [(200 + i, "năm ba bảy " * 5, "b") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    used = [r["doc_id"] for r in p8.mixture(docs, targets).collect()]
    assert 100 not in used and sorted(set(used)) == [*range(20), *range(200, 210)] and all(used.count(i) == 2 for i in range(200, 210))
    assert {r["source"]: r["actual_share"] for r in p8.shares(docs, targets).collect()} == {"a": 0.5, "b": 0.5}


def test_p8_positions_follow_the_schedule(spark, docs):
    targets = spark.createDataFrame([("crawl", 0.5, 1), ("portal", 0.5, 2)], "source string, target_share double, max_repeats int")
    counted, rows = p8.plan(docs, targets)
    tilt = {r["source"]: r["tilt"] for r in rows}
    assert sum(tilt[s] for s in tilt) == pytest.approx(0)
    got = p8.mixture(docs, targets).where("source = 'portal'").orderBy("position").collect()
    total = sum(r["n_tokens"] for r in got)
    seen = 0
    for r in got[:-1]:
        t, g = r["position"], tilt["portal"]
        demand = t + g * (t * t - t)
        assert abs((seen + r["n_tokens"] / 2) / total - demand) < 0.05
        seen += r["n_tokens"]


# 9
def test_p9_languages(spark, docs):
    got = {}
    for r in p9.found(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["lang"])
    for i in range(180):
        want = {list(SENT)[i % 6]} if i % 10 in (0, 1) else None
        assert got.get(i) == want, i
    assert got[900] == {"vi", "en"} and 904 not in got and 901 not in got and 902 not in got and 903 not in got
    seg = [(r["lang"], r["seg_no"]) for r in p9.segments(docs).where("doc_id = 900").orderBy("seg_no").collect()]
    assert seg == [("vi", 0), ("en", 1)]
    d = {r["doc_id"]: r for r in p9.documents(docs).collect()}
    assert d[901]["lang"] is None and d[901]["confidence"] == 0 and d[904]["lang"] == "vi" and d[0]["confidence"] > 0.9
    assert p9.documents(docs).count() == docs.count()  # repeated doc_ids stay as they are
    assert p9.found(empty(docs)).count() == 0


def test_p9_held_out_sentences(docs):
    model = p9.TextModel(p9.train(docs))
    for lang, text in {"vi": "ngôi đình của làng được kể trong câu chuyện về vua", "en": "the old road and the temple of the king", "fr": "le roi et les habitants du vieux temple", "de": "der alte König und die Leute der Stadt", "es": "el viejo rey y los vecinos de la ciudad", "pt": "o velho rei e os moradores da cidade"}.items():
        assert p9.LANGS[int(model.loglik(text)[0].argmax())] == lang


def test_p9_label_and_host_decide_where_the_text_says_little(spark, docs):
    """The same two words follow the label, while a long text does not; quotations count where nothing else stands."""
    rows = docs.where("doc_id < 180").select("doc_id", "text", "lang", "source", "origin_format").collect()
    name = "Siec Ngop"
    more = [(9001, name, "fr"), (9002, name, "de"), (9003, "“the old road and the temple of the king of the city”", None), (9005, " ".join(SENT["en"]), "fr")]
    schema = "doc_id long, text string, lang string, source string, origin_format string"
    d = spark.createDataFrame([tuple(r) for r in rows] + [(i, t, lang, None, None) for i, t, lang in more], schema)
    got = {r["doc_id"]: (r["lang"], r["confidence"]) for r in p9.documents(d).collect()}
    assert got[9001][0] == "fr" and got[9002][0] == "de"  # the label
    assert got[9003][0] == "en" and got[9005][0] == "en"
    assert got[9005][1] > got[9001][1]
    assert {r["doc_id"] for r in p9.found(d).where("doc_id >= 9000").collect()} >= {9003, 9005} and not p9.found(d).where("doc_id in (9001, 9002)").count()


def test_p9_knows_other_languages(spark, sf_dir):
    model = p9.TextModel(p9.train(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    for text in ("Осада речной крепости длилась долго и закончилась весной того же года", "古渡口之戰發生在河邊的古城", "jokilaivojen pitkä taistelu päättyi keväällä vuonna tuhat"):
        assert p9.ALL[int(model.loglik(text)[0].argmax())] == p9.OTHER


def test_p9_confidence_is_calibrated(docs):
    """Of held-out pieces of one to three words, about as many are right as the tempered posterior says."""
    rng = random.Random(6)
    model = p9.TextModel(p9.train(docs))
    texts, truth = [], []
    for lang, parts in SENT.items():
        words = " ".join(parts).split()
        for _ in range(200):
            k = rng.randint(1, 3)
            at = rng.randrange(len(words) - k)
            texts.append(" ".join(words[at : at + k]))
            truth.append(p9.LANGS.index(lang))
    p = p9._softmax(model.scores(texts)[0] * 0.2)
    right = p.argmax(1) == np.array(truth)
    assert abs(p.max(1).mean() - right.mean()) < 0.2


def test_p9_labels(spark):
    df = spark.createDataFrame([("VI ",), ("vi-VN",), ("Tiếng Việt",), ("es-419",), ("deu",), ("und",), ("??",), (None,), ("",), ("English",)], "l string")
    assert [r[0] for r in df.select(p9.declared(F.col("l"))).collect()] == ["vi", "vi", "vi", "es", "de", None, None, None, None, "en"]


# all
def test_sql_twins(spark, sf_dir):
    import oracle

    from loomgraph.llm.queries import oracle_sql, queries

    con = oracle.connect(sf_dir)
    q = queries()
    for name, sql in oracle_sql().items():
        oracle.compare(q[name](spark, sf_dir), con, sql)


def test_nothing_else_imports_this_package():
    import pathlib
    import re

    root = pathlib.Path(p1.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"loomgraph\.llm|from \.llm", f.read_text())
