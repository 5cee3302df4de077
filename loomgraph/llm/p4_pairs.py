"""Problem 4: broken question and answer pairs.

Method: the language posteriors of prompt and response come from the character n-gram naive Bayes model of problem 9
(trained on the labelled documents, with a class for any other language). A response is worded in another language when its posterior odds of its own best language against the
prompt's estimated language are high, and higher by the letter than the prompt's own.

Truncation is flagged by the likelihood that a text ends where the answer ends, under an n-gram model with contexts of one to four characters, counted over all full labels of the
corpus, and of unbounded length, counted over the full labels of the row's own entity. An answer that goes on in its entity's label ends there with a small probability, the
smaller the less the corpus ends texts after such characters; an exact comparison with the beginning of the label then confirms it. Without any label the corpus contexts decide.
Empty, copied and refused answers and wrong years are exact checks.

Kinds, first match wins: empty, refusal, copy, truncated, language, year.

Defined results: a null answer is `empty`; a null question has no copy and no year; the full label of an entity is the
one most rows give (ties: the longest, then the smallest text), rows without an entity key use their own label; the row's own label is never a defect
unless it is shorter than the full one; texts are read whole; repeated rows give repeated cases; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import compare_key, fold
from loomgraph.llm.p6_lookalikes import canonical
from loomgraph.llm.p9_language import ALL, TextModel, train

#: Stand-ins for nothing (fixed values), compared in lower case without outer brackets and signs.
STAND_INS = {"n/a", "na", "nan", "none", "null", "nil", "nul", "trống", "không có", "chưa có", "không rõ", "chưa rõ", "unknown", "undefined", "empty", "tbd", "rỗng", "n.a", "missing", "no answer", "#n/a", "<na>", "không"}
#: Phrases of refusals: Vietnamese in accented form, then folded forms of Vietnamese and other languages (fixed values).
REFUSE = re.compile(r"\b(không thể|chưa thể|không biết|không tìm thấy|không có đủ|không đủ thông tin|không được phép|xin phép không|không trả lời|chưa có thông tin|không có thông tin|không có dữ liệu|không xác định được|từ chối trả lời|xin lỗi|rất tiếc|tiếc là)\b")
REFUSE_FOLDED = re.compile(
    r"\b(khong the (tra loi|xac dinh|dua ra|cung cap|biet)|chua the (tra loi|dua ra|xac dinh)|khong biet cau tra loi|khong tim thay du lieu|khong co du thong tin|khong duoc phep cung cap|xin phep khong tra loi|xin loi (toi|minh|he thong)|rat tiec (toi|minh|he thong)"
    r"|sorry|(i )?(do not|don t|dont) know|(cannot|can t|could not|couldn t|unable to) (answer|determine|provide|help|say|tell|find)|not enough information|as an (ai|assistant)|no (idea|information)"
    r"|desolee?|je ne (sais|peux|suis)|ne sais pas|pas assez d information|leider|ich weiss|weiss (es )?nicht|weiß (es )?nicht|kann (ich )?(das |die |diese )?.{0,20}nicht|entschuldigung|lo siento|no (lo )?se|no puedo|no hay suficiente|nao sei|nao posso|desculpe|lamento|nao ha informac)\b"
)
REFUSE_OTHER = re.compile("不知道|无法|抱歉|對不起|对不起|不能回答|わかりません|分かりません|申し訳|できません|모르|죄송|알 수 없|не знаю|не могу|извините|к сожалению")
#: Words before a place name that do not make an answer defective (fixed values).
PLACES = ("thành phố", "thị xã", "thị trấn", "tỉnh", "vùng", "xã", "phường", "huyện", "quận", "làng", "thôn", "bản", "ấp", "tp.", "tp", "khu vực", "địa phận", "miền", "đất")
COPY_LEAD = re.compile(r"^(trả lời|câu hỏi|đáp án( là)?|đáp|hỏi|q|a|câu trả lời( là)?|answer|question)\s*[:：.\-–]?\s*", re.I)
YEAR = re.compile(r"(?<!\w)n[ăa]m\s+(\d{1,5})(?!\d)\s*(tcn\b|trước công nguyên)?")


def years(question: str) -> list[int]:
    """Years after the word năm; TCN years are negative."""
    text = unicodedata.normalize("NFC", "".join(c for c in question if unicodedata.category(c) != "Cf")).lower()
    return [-int(m[1]) if m[2] else int(m[1]) for m in YEAR.finditer(text)]


#: Log probabilities of an end below which an answer counts as cut off, with and without a label of its entity, and least log-likelihood lead of another language.
ENDS, NO_LABEL_ENDS, LEAD = float(np.log(0.02)), float(np.log(0.002)), 6.0
#: Weight of the text's log-likelihood in a posterior (4-grams overlap).
TEMPER = 0.2
#: Contexts of the end model are hashed to this many cells, so its size is fixed.
CELLS = 1 << 17


def _cell(context: str) -> int:
    return zlib.crc32(context.encode()) & (CELLS - 1)


class EndModel:
    """log P(text ends | all characters before): the text's whole length as a context over its entity's labels, interpolated with the longest context of up to four characters that has
    enough counts over all labels. `own`: weight of one label of the entity, in observations."""

    def __init__(self, counts: dict[int, tuple[int, int]], own: float = 60.0):
        self.counts, self.own = counts, own  # cell of the context -> (ends, continues)

    def corpus(self, text: str) -> float:
        """P(end) by the last characters alone."""
        t = "^" + text.lower()
        for k in range(4, 0, -1):
            ends, goes = self.counts.get(_cell(t[-k:]), (0, 0))
            if ends + goes >= 5:
                return (ends + 0.1) / (ends + goes + 0.2)
        return 0.5

    def score(self, text: str, keys: list[str] = (), labels: list[str] = ()) -> float:
        """keys: forms of the text; labels: the same forms of its entity's labels. A label is evidence where the text is its beginning."""
        seen = {(x == y) for x in keys for y in labels if x and y.startswith(x)}
        ends, goes = (1, 0) if True in seen else (0, 1) if seen else (0, 0)
        return float(np.log((ends * self.own + self.corpus(text)) / ((ends + goes) * self.own + 1)))


def end_counts(labels: DataFrame, col: str) -> dict[int, tuple[int, int]]:
    """Ends and continuations after contexts of one to four characters, over all labels; at most CELLS rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        cells = np.zeros((CELLS, 2), np.int64)

        def flush():
            for ctx, v in seen.items():
                cells[_cell(ctx)] += v
            seen.clear()

        for b in batches:
            for x in b.column(0).to_pylist():
                t = "^" + unicodedata.normalize("NFC", x).lower()
                for i in range(1, len(t)):
                    for k in range(1, min(4, i + 1) + 1):
                        seen.setdefault(t[i + 1 - k : i + 1], [0, 0])[0 if i == len(t) - 1 else 1] += 1
                if len(seen) > 200_000:
                    flush()
        flush()
        at = np.flatnonzero(cells.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at, 0]), pa.array(cells[at, 1])], names=["cell", "e", "g"])

    rows = labels.where(F.length(col) > 0).select(col).mapInArrow(count, "cell long, e long, g long").groupBy("cell").agg(F.sum("e").alias("e"), F.sum("g").alias("g")).where("e + g >= 5")
    return {r.cell: (r.e, r.g) for r in rows.toPandas().itertuples(index=False)}


def _strip_place(text: str) -> str:
    low = text.lower()
    for p in PLACES:
        if low.startswith(p + " "):
            return text[len(p) + 1 :].strip()
    return text


def _signs(text: str) -> bool:
    """Characters that ordinary wording does not hold, or words that mix scripts: damaged text, not another language."""
    if any(unicodedata.category(c) in ("Sm", "So", "Sk", "Sc", "Cc", "No", "Lm") or c in "¡¿»§¶�" for c in text):
        return True
    return any(len({unicodedata.name(c, " ").split()[0] for c in w if c.isalpha()} & {"LATIN", "CYRILLIC", "GREEK"}) > 1 for w in text.split())


_DIGIT = re.compile(r"\d")
#: A question mark inside a word or before one: a lost letter.
_ASKED = re.compile(r"\?\w")


def _empty(answer: str) -> bool:
    core = answer.strip().strip("\"'“”«»()[]{}<>").strip()
    return not compare_key(core) or answer.strip().lower() in STAND_INS or core.lower().rstrip(".") in STAND_INS


class Checker:
    def __init__(self, counts: np.ndarray, ends: dict, main: str = "vi", share: float = 0.99):
        """main, share: the language of the prompts and the share of prompts in it, as prior of a prompt's language."""
        self.nb, self.end = TextModel(counts), EndModel(ends)
        self.prior = np.log([share if x == main else (1 - share) / (len(ALL) - 1) for x in ALL])
        self.known: dict[str, bool] = {}

    def fine(self, label: str) -> bool:
        """Whether a label is no stand-in for nothing."""
        if label not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[label] = not _empty(canonical(label)[0])
        return self.known[label]

    def odds(self, text: str, against: int | None = None) -> tuple[int, float, float]:
        """Number of the best language of a text and its log-likelihood lead over another one (Vietnamese if not given, the corpus' language), in all and per 4-gram."""
        ll, n = self.nb.loglik(text)
        best = int(ll.argmax())
        lead = float(ll[best] - ll[against or 0]) if n else 0.0
        return best, lead, lead / max(n, 1)

    def prompt_language(self, question: str | None, names: set[str]) -> int:
        """Most probable language of a prompt, its answer's names left out. Damaged text says nothing about it, so the prior stays."""
        words = [w for w in fold(question).split() if w not in names] if question and not _signs(question) and not _ASKED.search(question) else []
        return int((TEMPER * self.nb.loglik(" ".join(words))[0] + self.prior).argmax())

    def defect(self, question, answer, full, own, tau) -> tuple[str | None, float]:
        """Kind of defect and the end-of-text score of the answer."""
        ans = canonical(answer)[0] if answer is not None else ""
        core = ans.strip().strip("\"'“”«»()[]{}<>").strip()
        key = compare_key(core)
        if _empty(ans):
            return "empty", 0.0
        labels = [canonical(x)[0] for x in (full, own) if x]
        full = labels[0] if labels else None
        keys = [compare_key(x) for x in labels]
        stripped = compare_key(_strip_place(core))
        bare, tail = fold(core).replace(" ", ""), fold(_strip_place(core)).replace(" ", "")
        forms = [[key, stripped], [bare, tail]]
        goal = [keys[:1], [fold(full).replace(" ", "")] if full else []]
        text = re.sub(r"[\s.…。,;:!?]+$", "", core)
        end = max((self.end.score(text, f, g) for f, g in zip(forms, goal)), key=abs)
        good = bool(keys) and (key == keys[0] or stripped == keys[0])
        if not good:
            low, folded = core.lower(), fold(core)
            if REFUSE.search(low) or REFUSE_FOLDED.search(folded) or REFUSE_OTHER.search(low):
                return "refusal", end
            if question and self._copies(core, question, full):
                return "copy", end
            if end < ENDS and self._begins(forms, goal):
                return "truncated", end
            if not (len(keys) > 1 and key == keys[1]):
                lang = self._foreign(core, full, question)
                if lang:
                    return "language", end
                if not keys and end < NO_LABEL_ENDS:
                    return "truncated", end
        if question:
            ys = years(question)
            if ys and (tau is None or tau not in ys):
                return "year", end
        return None, end

    @staticmethod
    def _begins(forms: list[list[str]], goal: list[list[str]]) -> bool:
        """Whether one form of the answer is a proper beginning of the same form of the label."""
        return any(x and len(x) < len(y) and y.startswith(x) for f, g in zip(forms, goal) for x in f for y in g)

    def _copies(self, core: str, question: str, full: str | None) -> bool:
        q, a = fold(question).replace(" ", ""), fold(COPY_LEAD.sub("", core)).replace(" ", "")
        if not q or not a:
            return False
        if a == q or q in a and len(q) > 8:
            return True
        if full and fold(full).replace(" ", "") == a:
            return False
        if len(a) < 0.5 * len(q) or len(a) < 8:
            return False
        if q.startswith(a) or (a in q and len(a) >= 0.6 * len(q)):
            return True
        qw, aw = fold(question).split(), fold(COPY_LEAD.sub("", core)).split()
        common = sum(min(qw.count(w), aw.count(w)) for w in set(qw))
        return common >= 0.8 * len(qw) and common >= 0.8 * len(aw) and len(qw) >= 4

    def _foreign(self, core: str, full: str | None, question: str | None) -> str | None:
        letters = [c for c in core if c.isalpha()]
        latin = sum("LATIN" in unicodedata.name(c, "") for c in letters)
        if letters and latin == 0:
            return "other"
        if _signs(core):
            return None
        rest = " " + fold(core) + " "
        if full:
            rest = rest.replace(" " + fold(full) + " ", " ")
        rest = rest.strip()
        if not rest:
            return None
        # proper names say nothing about the language: words that start with a capital inside the text are left out
        words = core.split()
        named = {fold(w) for i, w in enumerate(words) if w[:1].isupper() and (i or len(words) > 1) and any(not c.isascii() for c in w)}
        rest = " ".join(w for w in rest.split() if w not in named)
        prompt = self.prompt_language(question, set(rest.split()) | (set(fold(full).split()) if full else set()))
        lang, lead, rate = self.odds(rest, prompt)
        if lang == prompt or lead < LEAD:
            return None
        # a prompt that names a foreign event leans to that language a little, a response worded in it throughout
        return ALL[lang] if question is None or self.odds(question, prompt)[2] < rate else None


def defects(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, defect, end_score) of every defective row."""
    rev = F.col("template_id") == "occurredAt_t4_reverse"
    ent, lab = F.when(F.coalesce(rev, F.lit(False)), F.concat(F.lit("h:"), F.col("h"))).otherwise(F.concat(F.lit("t:"), F.col("t"))), F.when(F.coalesce(rev, F.lit(False)), F.col("h_label")).otherwise(F.col("t_label"))
    rows = questions.select("qid", "question", "answer_label", "tau_start", F.when(F.trim(F.substring(ent, 3, 1_000_000)) != "", ent).alias("ent"), lab.alias("own"))
    votes = rows.where("ent is not null and trim(own) <> ''").groupBy("ent", "own").agg(F.count("*").alias("n"))
    full = votes.groupBy("ent").agg(F.min(F.struct((-F.col("n")).alias("k"), (-F.length("own")).alias("len"), "own"))["own"].alias("full"))
    checked = rows.join(full, "ent", "left").withColumn("full", F.coalesce("full", "own"))
    counts, ends = train(documents), end_counts(full, "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = Checker(counts, ends)
        for b in batches:
            out = ([], [], [])
            cols = [b.column(i).to_pylist() for i in range(6)]
            for qid, q, a, f, o, tau in zip(*cols):
                if a == f and a is not None and check.fine(a) and not (q and _DIGIT.search(q)):
                    continue  # the full label is the answer and no year is asked: nothing is left to check
                kind, end = check.defect(q, a, f, o, tau)
                if kind:
                    for c, v in zip(out, (qid, kind, round(end, 6))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["qid", "defect", "end_score"])

    return checked.select("qid", "question", "answer_label", "full", "own", F.col("tau_start").cast("int").alias("tau_start")).mapInArrow(run, "qid string, defect string, end_score double")


def found(questions: DataFrame, documents: DataFrame) -> DataFrame:
    return defects(questions, documents).select("qid", "defect")
