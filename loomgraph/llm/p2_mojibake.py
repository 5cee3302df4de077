"""Problem 2: Vietnamese text that was decoded with the wrong character encoding.

Method: a hidden Markov model labels characters. One state is clean text, one state stands for each encoding pair
(UTF-8 bytes read as Windows-1252, Latin-1, Mac Roman, code page 437/850, Windows-1251/1258, the same twice, and TCVN3 bytes
read as Latin-1), one for replacement signs. Emissions are character bigrams: those of the clean state are
counted over all undamaged texts, those of a pair's state follow from the same counts, each clean character replaced by
its image under the pair. The Viterbi path gives the damaged spans, and each span gets the inverse transform of its
state; where the damage lost bytes (dropped control characters) the bigram counts choose among the possible originals.

Images of damaged letters may be characters of the clean alphabet (à as "Ã ", ừ as "á»«", ế in TCVN3 as "Õ"), so every text with a character outside ASCII or a question
mark goes to the model. Shortcut without loss: where no stretch of a text gains as much under the best other state of each character as it costs to enter one, the
Viterbi path is all clean (`Model.open_texts`). Texts that hold a whole image of a letter are left out of the clean counts. A span of clean characters only is
damage if its restored text is the more probable one as clean text, which a slip of letter case is not.

Defined results: null and empty texts are clean; replacement signs (U+FFFD, or a question mark inside a word or before further words where a letter was) are damage; `restored` puts letters back where
one clean word of the corpus explains them, else the signs stay and the value is marked lossy; texts of any length are labelled whole; repeated rows give repeated cases; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut

_VOWELS = "aăâeêioôơuưy"
_TONES = "\u0300\u0301\u0303\u0309\u0323"
_VIET = "".join(unicodedata.normalize("NFC", v + t) for v in _VOWELS for t in ("", *_TONES)) + "đ"
#: Characters of undamaged Vietnamese text and of ordinary typesetting.
LETTERS = "".join(sorted(set(_VIET + _VIET.upper() + "".join(map(chr, range(97, 123))) + "".join(map(chr, range(65, 91))))))
MARKS = _TONES + "\u0302\u0306\u031b"
SIGNS = "–—‘’“”…«»\u00a0"
CLEAN = "".join(map(chr, range(32, 127))) + "\t\n" + "".join(c for c in LETTERS if ord(c) > 126) + MARKS + SIGNS
#: Characters that undamaged text may hold besides: they are rare, not signs of damage.
_PLAIN = set("".join(map(chr, range(32, 127))) + "\t\n\r")

#: TCVN3 code of each letter, read as Latin-1 (fixed values of that standard).
TCVN3 = {
    "Ă": 0xA1, "Â": 0xA2, "Ê": 0xA3, "Ô": 0xA4, "Ơ": 0xA5, "Ư": 0xA6, "Đ": 0xA7, "ă": 0xA8, "â": 0xA9, "ê": 0xAA, "ô": 0xAB, "ơ": 0xAC, "ư": 0xAD, "đ": 0xAE,
    "à": 0xB5, "ả": 0xB6, "ã": 0xB7, "á": 0xB8, "ạ": 0xB9, "ằ": 0xBB, "ẳ": 0xBC, "ẵ": 0xBD, "ắ": 0xBE, "ặ": 0xC6, "ầ": 0xC7, "ẩ": 0xC8, "ẫ": 0xC9, "ấ": 0xCA, "ậ": 0xCB,
    "è": 0xCC, "ẻ": 0xCE, "ẽ": 0xCF, "é": 0xD0, "ẹ": 0xD1, "ề": 0xD2, "ể": 0xD3, "ễ": 0xD4, "ế": 0xD5, "ệ": 0xD6, "ì": 0xD7, "ỉ": 0xD8, "ĩ": 0xDC, "í": 0xDD, "ị": 0xDE,
    "ò": 0xDF, "ỏ": 0xE1, "õ": 0xE2, "ó": 0xE3, "ọ": 0xE4, "ồ": 0xE5, "ổ": 0xE6, "ỗ": 0xE7, "ố": 0xE8, "ộ": 0xE9, "ờ": 0xEA, "ở": 0xEB, "ỡ": 0xEC, "ớ": 0xED, "ợ": 0xEE,
    "ù": 0xEF, "ủ": 0xF1, "ũ": 0xF2, "ú": 0xF3, "ụ": 0xF4, "ừ": 0xF5, "ử": 0xF6, "ữ": 0xF7, "ứ": 0xF8, "ự": 0xF9, "ỳ": 0xFA, "ỷ": 0xFB, "ỹ": 0xFC, "ý": 0xFD, "ỵ": 0xFE,
}
CODECS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1258", "cp1252*2", "latin-1*2", "tcvn3")
STATES = ("clean", *CODECS, "lost")
LOST = "�"


def _read_as(data: bytes, codec: str) -> str:
    """Bytes read with a codec; bytes it leaves undefined pass as control characters."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@functools.cache
def images(ch: str, state: str) -> tuple[tuple[str, float], ...]:
    """The ways a clean character looks under an encoding pair, with weights: as it is, without control
    characters, and with no-break spaces turned to spaces."""
    if ord(ch) < 128:
        return ((ch, 1.0),)
    if state == "lost":
        return ((ch if ord(ch) < 256 else "?", 1.0),)
    if state == "tcvn3":
        return ((chr(TCVN3[ch]), 1.0),) if ch in TCVN3 else ((ch, 0.02),)
    codec, _, twice = state.partition("*")
    img = _read_as(ch.encode(), codec)
    if twice:
        img = _read_as(img.encode(), codec)
    forms = {img: 0.6}
    dropped = "".join(c for c in img if not 0x80 <= ord(c) < 0xA0)
    for form, w in ((dropped, 0.2), (img.replace("\u00a0", " "), 0.15), (dropped.replace("\u00a0", " "), 0.05)):
        if form:
            forms[form] = forms.get(form, 0) + w
    return tuple(forms.items())


class Model:
    """Start, transition and emission tables from clean bigram counts."""

    def __init__(self, counts: dict[tuple[str, str], float]):
        letters = [c for c in CLEAN]
        uni = defaultdict(float)
        for (a, b), n in counts.items():
            uni[b] += n
        floor = max(1.0, sum(uni.values()) * 1e-6)
        for c in letters:
            uni[c] += floor
        self.uni, self.bi = dict(uni), {k: float(n) for k, n in counts.items()}
        self.alphabet = sorted({f for s in CODECS for c in letters for f, _ in images(c, s) for f in f} | set(letters))
        self.index = {c: i for i, c in enumerate(self.alphabet)}
        n = len(self.alphabet)
        self.logp = [self._table([(a, b, c) for (a, b), c in counts.items()], uni, n)]
        for s in STATES[1:]:
            pairs, single = [], defaultdict(float)
            for c, k in uni.items():
                for form, w in images(c, s):
                    single[form[0]] += k * w
                    for x, y in zip(form, form[1:]):
                        pairs.append((x, y, k * w))
                        single[y] += k * w
            for (a, b), k in counts.items():
                for fa, wa in images(a, s):
                    for fb, wb in images(b, s):
                        pairs.append((fa[-1], fb[0], k * wa * wb))
            self.logp.append(self._table(pairs, single, n))
        self.decoders = {s: self._decoder(s) for s in CODECS}
        self.look = np.full(0x110000, n, np.int32)
        self.look[[ord(c) for c in self.alphabet]] = np.arange(n)
        self.gain = np.full((n + 1, n + 1), -1.0)
        self.gain[:, :n] = np.max(self.logp[1:], axis=0) - np.where([c in _CLEAN_SET for c in self.alphabet], self.logp[0], [self._clean_extra(c) for c in self.alphabet])

    def _table(self, pairs, single, n):
        m = np.zeros((n, n), np.float64)
        for a, b, k in pairs:
            if a in self.index and b in self.index:
                m[self.index[a], self.index[b]] += k
        u = np.zeros(n)
        for c, k in single.items():
            if c in self.index:
                u[self.index[c]] += k
        u /= u.sum()
        row = m.sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            cond = np.where(row > 0, m / row, 0)
        lam = row / (row + 20.0)
        table = np.empty((n + 1, n), np.float32)
        table[:n] = np.log(lam * cond + (1 - lam) * u * 0.999 + 1e-9)
        table[n] = np.log(u + 1e-9)  # previous character outside the alphabet, or none
        return table

    def _decoder(self, state: str):
        by = defaultdict(list)
        for c in self.uni:
            if ord(c) > 127:
                for form, w in images(c, state):
                    by[form].append((c, w))
        return dict(by), max(map(len, by))

    def _clean_extra(self, ch: str) -> float:
        """Log probability in clean text of a character from outside the clean alphabet."""
        cat = unicodedata.category(ch)
        if ch == LOST:
            return -30.0
        if cat in ("Lu", "Ll", "Lo", "Lt"):
            return -9.0
        if cat in ("Mn", "Cf", "Zs", "Nd"):
            return -7.0
        return -20.0 if 0x80 <= ord(ch) < 0xA0 else -12.0 if cat[0] == "P" else -16.0

    def open_texts(self, texts: list[str]) -> np.ndarray:
        """Which texts may have another path than the all-clean one: an upper bound of the gain of any stretch exceeds the least cost of entering a state."""
        cps = np.frombuffer("\0".join(["", *texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids, between = self.look[cps], np.cumsum([0, *(len(t) + 1 for t in texts)])[: len(texts)]
        ids[between] = len(self.alphabet)
        x = np.append(0.0, self.gain[ids[:-1], ids[1:]])
        x[cps[: len(x)] == ord(LOST)] = 30.0
        x[between] = -1e6  # no stretch crosses it
        total = np.cumsum(x)
        best = total - np.minimum.accumulate(np.append(0.0, total[:-1]))
        return np.maximum.reduceat(best, between) > _ENTER_FIRST if texts else np.zeros(0, bool)

    def clean_score(self, text: str, before: str, after: str) -> float:
        """Log probability of a text as clean text between two neighbours."""
        ids = self.look[[ord(c) for c in before + text + after]]
        return float(sum(self.logp[0][a, b] if c in _CLEAN_SET else self._clean_extra(c) for a, b, c in zip(ids, ids[1:], text + after)))

    def label(self, text: str) -> np.ndarray:
        """Viterbi path: the state of each character."""
        n, k = len(text), len(STATES)
        em = np.full((n, k), -21.0, np.float32)
        idx = np.array([self.index.get(c, -1) for c in text])
        prev = np.empty(n, np.int64)
        prev[0], prev[1:] = len(self.alphabet), np.where(idx[:-1] < 0, len(self.alphabet), idx[:-1])
        known = idx >= 0
        for s in range(k):
            em[known, s] = self.logp[s][prev[known], idx[known]]
        for i, c in enumerate(text):
            if c not in _CLEAN_SET:
                em[i, 0] = self._clean_extra(c)
            if c == LOST:
                em[i, k - 1] = -0.1
        stay, enter, leave, switch = np.log(0.999), np.log(1e-3 / (k - 1)), np.log(0.03), np.log(1e-6)
        trans = np.full((k, k), switch, np.float32)
        trans[0, :], trans[:, 0] = enter, leave
        np.fill_diagonal(trans, np.log(0.97))
        trans[0, 0] = stay
        score = em[0] + np.where(np.arange(k) == 0, np.log(0.95), np.log(0.05 / (k - 1)))
        back = np.zeros((n, k), np.int8)
        for i in range(1, n):
            step = score[:, None] + trans
            back[i] = step.argmax(0)
            score = step.max(0) + em[i]
        path = np.empty(n, np.int8)
        path[-1] = score.argmax()
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Damaged (start, end, state) spans that hold at least one character their state explains as damage."""
        path = self.label(text)
        out, i = [], 0
        while i < len(text):
            j = i
            while j < len(text) and path[j] == path[i]:
                j += 1
            if path[i] and any(ord(c) > 127 or c == "?" for c in text[i:j]) and (STATES[path[i]] != "lost" or _LOST_SIGN.search(text, max(0, i - 1), min(len(text), j + 1))):
                out.append((i, j, STATES[path[i]]))
            i = j
        return out

    def restore(self, span: str, state: str, before: str = " ") -> str:
        """Inverse transform of a span: longest images first, ambiguous ones by clean bigrams."""
        if state == "lost":
            return span
        by, longest = self.decoders[state]
        out, i = "", 0
        while i < len(span):
            if ord(span[i]) < 128:
                out, i = out + span[i], i + 1
                continue
            options = []
            for k in range(min(longest, len(span) - i), 0, -1):
                after = span[i + k] if i + k < len(span) else " "
                for c, w in by.get(span[i : i + k], ()):
                    left = self.bi.get(((out or before)[-1], c), 0.0) + 0.01
                    right = (self.bi.get((c, after), 0.0) + 0.01) if ord(after) < 128 else 1.0
                    options.append((k, w >= 0.5, w * left * right, c))
                if any(o[0] == k and o[1] for o in options):
                    break
            if options:
                whole = [o for o in options if o[1]]
                best = max(whole or options, key=lambda o: (o[0], o[2]) if whole else (o[2], o[0]))
                out, i = out + best[3], i + best[0]
            else:
                out, i = out + span[i], i + 1
        return out

    def restore_bytes(self, span: str, state: str) -> str | None:
        """Exact inverse by bytes, for letters of other languages; None where bytes are missing."""
        codec, _, twice = state.partition("*")
        if state in ("tcvn3", "lost"):
            return None
        for _ in range(2 if twice else 1):
            data = bytearray()
            for ch in span:
                try:
                    data += ch.encode(codec)
                except UnicodeEncodeError:
                    if ord(ch) > 255:
                        return None
                    data.append(ord(ch))
            try:
                span = data.decode()
            except UnicodeDecodeError:
                return None
        return span

    def repair(self, text: str) -> tuple[str, list[str]]:
        """Restored text and the states found; no states means the text is clean."""
        spans = self.spans(text)
        if not spans:
            return text, []
        out, at = [], 0
        states = []
        for a, b, s in spans:
            exact = self.restore_bytes(text[a:b], s)
            fixed = self.restore(text[a:b], s, text[a - 1] if a else " ") if exact is None else exact
            if fixed == text[a:b] and s != "lost":  # short spans fit several pairs: take one whose bytes are whole
                fixed = next((x for c in CODECS if (x := self.restore_bytes(fixed, c)) and x != fixed), fixed)
            if s != "lost" and _CLEAN_SET.issuperset(text[a:b]):
                near = text[a - 1 : a] or " ", text[b : b + 1] or " "
                if self.clean_score(fixed, *near) <= self.clean_score(text[a:b], *near):
                    continue
            out += [text[at:a], fixed]
            states.append(s)
            at = b
        out.append(text[at:])
        return "".join(out), states


_CLEAN_SET = frozenset(CLEAN)
_LOST_SIGN = re.compile(r"�|\?.*\w", re.S)
#: Least cost of a path that leaves the clean state: it starts in another one.
_ENTER_FIRST = np.log(0.95) - np.log(0.05 / (len(STATES) - 1)) - 1e-3
#: Images of letters in two or more characters, all of them clean ones.
_WHOLE_IMAGES = sorted({f for c in LETTERS if ord(c) > 127 for s in CODECS for f, _ in images(c, s) if len(f) > 1 and _CLEAN_SET.issuperset(f)})


def _ranges(chars: str) -> str:
    """Regular-expression class of some characters as merged ranges (a class of single characters is tested one by one)."""
    out, at = "", sorted({ord(c) for c in chars})
    first = last = at[0]
    for cp in [*at[1:], -1]:
        if cp == last + 1:
            last = cp
            continue
        out += f"\\x{{{first:x}}}-\\x{{{last:x}}}"
        first = last = cp
    return out


_SUSPECT = f"[^{_ranges(CLEAN + chr(13))}]"


_IMAGE = "|".join("".join(f"\\x{{{ord(c):x}}}" for c in f) for f in _WHOLE_IMAGES)


def suspect(col):
    """JVM-side test for texts that are not counted as clean: with characters from outside the clean alphabet, a whole image of a letter, or a question mark before the last word."""
    return F.coalesce(F.col(col).rlike(_SUSPECT) | F.col(col).rlike(_IMAGE) | F.col(col).rlike(r"(?s)\?.*[\p{L}\p{N}]"), F.lit(False))


def may_be_damaged(col):
    """JVM-side test that every damaged text passes: a damaged span holds a character outside ASCII or a question mark."""
    return F.coalesce(F.col(col).rlike(r"[^\x00-\x7f]|\?"), F.lit(False))


def bigram_counts(texts: DataFrame, col: str = "text") -> dict[tuple[str, str], float]:
    """Bigrams of the clean alphabet over every undamaged text (at most len(CLEAN) squared rows reach the driver)."""
    index = {ord(c): i for i, c in enumerate(CLEAN)}
    n = len(CLEAN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = np.full(0x2100, -1, np.int32)
        for cp, i in index.items():
            look[cp] = i
        total = np.zeros(n * n, np.int64)
        for b in batches:
            joined = " ".join(x for x in b.column(0).to_pylist() if x)
            cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            ids = look[np.minimum(cps, 0x20FF)]
            ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
            total += np.bincount(ids[:-1][ok] * n + ids[1:][ok], minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    clean = texts.where(~suspect(col)).select(col)
    rows = clean.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return {(CLEAN[r["pair"] // n], CLEAN[r["pair"] % n]): float(r["n"]) for r in rows}


def fields_long(questions: DataFrame | None, events: DataFrame | None) -> DataFrame:
    """(tbl, rec_key, field, text) of the fields that may be damaged."""
    parts = []
    if questions is not None:
        parts.append(questions.select(F.lit("questions").alias("tbl"), F.col("qid").alias("rec_key"), F.lit("question").alias("field"), F.col("question").alias("text")))
    if events is not None:
        both = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("h_label", "t_label")])).alias("f")
        parts.append(events.select(F.lit("historical_events").alias("tbl"), F.col("row_id").cast("string").alias("rec_key"), both).select("tbl", "rec_key", "f.field", "f.text"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repairs(long: DataFrame, counts: dict[tuple[str, str], float]) -> DataFrame:
    """Damaged values of (tbl, rec_key, field, text) with the restored text, the encoding pairs and whether anything stays lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or Model(counts)
            keep, fixed, how, lost = [], [], [], []
            texts = b.column(3).to_pylist()
            for i in np.flatnonzero(model.open_texts(texts)):
                new, states = model.repair(texts[i])
                if states:
                    keep.append(i)
                    fixed.append(new)
                    how.append(",".join(dict.fromkeys(states)))
                    lost.append(LOST in new or "lost" in states)
            rows = b.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(fixed, pa.string()), pa.array(how, pa.string()), pa.array(lost, pa.bool_())], names=["tbl", "rec_key", "field", "text", "restored", "encoding", "lossy"])

    return long.where(may_be_damaged("text")).mapInArrow(run, "tbl string, rec_key string, field string, text string, restored string, encoding string, lossy boolean")


def damaged(questions: DataFrame, events: DataFrame) -> DataFrame:
    long = fields_long(questions, events)
    return repairs(long, bigram_counts(long))


def loss_forms(word: str) -> list[str]:
    """How a word looks after its letters were lost: a question mark per letter outside Latin-1, or a replacement sign per byte outside ASCII."""
    asked = "".join("?" if ord(c) > 255 else c for c in word)
    signs = "".join(LOST * len(c.encode()) if ord(c) > 127 else c for c in word)
    return [f for f in (asked, signs) if f != word]


_TOKEN = re.compile(r"^([\"'(“«]*)(.*?)([\"'),.!”»:;]*)$", re.S)


def lost_tokens(text: str) -> list[tuple[str, str, str]]:
    """(before, word, after) of each space-separated token; a final question mark behind another sign belongs to the sentence."""
    parts = [_TOKEN.match(t).groups() for t in text.split(" ")]
    a, w, b = parts[-1]
    if w.endswith("?") and ("?" in w[:-1] or LOST in w):
        parts[-1] = (a, w[:-1], "?" + b)
    for i in range(1, len(parts) - 1):  # a lone sign between two names was the dash
        if parts[i][1] in ("?", LOST * 3) and parts[i - 1][1][:1].isupper() and parts[i + 1][1][:1].isupper():
            parts[i] = ("–", "", "")
    return parts


def restore_lost(damaged_rows: DataFrame, long: DataFrame, sure: float = 0.8) -> DataFrame:
    """Puts back lost letters where a clean word of the corpus explains them: among all words with the same loss form one must have at least `sure` of the uses.

    Words of all clean texts are counted, turned into their loss forms and joined with the lost words; `lossy` stays true where a sign remains.
    """
    clean = long.where(~suspect("text")).select(F.explode(F.split("text", r"[ \t\n\"'(),.!?“”«»:;–—]+")).alias("word")).where(F.col("word").rlike(r"[^\x00-\x7f]")).groupBy("word").agg(F.count("*").alias("n"))

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, w, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for f in loss_forms(w)]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["form", "word", "n"])

    by_form = clean.mapInArrow(forms, "form string, word string, n long").groupBy("form").agg(F.sum("n").alias("all"), F.max(F.struct("n", "word")).alias("m")).where(F.col("m.n") >= sure * F.col("all")).select("form", F.col("m.word").alias("word"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(t, i, *p) for t in b.column(0).to_pylist() for i, p in enumerate(lost_tokens(t))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.string()) for c in cols[2:]]], names=["restored", "pos", "a", "form", "b"])

    texts = damaged_rows.where("lossy").select("restored").distinct()
    tokens = texts.mapInArrow(cut_up, "restored string, pos int, a string, form string, b string").join(by_form, "form", "left")
    piece = F.struct("pos", F.concat("a", F.coalesce("word", "form"), "b").alias("x"), (F.col("word").isNull() & F.col("form").rlike(f"[?{LOST}]")).alias("left"))
    whole = tokens.groupBy("restored").agg(F.array_sort(F.collect_list(piece)).alias("p")).select("restored", F.array_join(F.transform("p", lambda q: q["x"]), " ").alias("again"), F.exists("p", lambda q: q["left"]).alias("left"))
    out = damaged_rows.join(whole, "restored", "left")
    return out.select("tbl", "rec_key", "field", "text", F.coalesce("again", "restored").alias("restored"), "encoding", F.when(F.col("lossy"), F.coalesce("left", F.lit(True))).otherwise(F.lit(False)).alias("lossy"))


def restored(questions: DataFrame, events: DataFrame) -> DataFrame:
    """Damaged values with their text restored as far as possible, lost letters included."""
    long = fields_long(questions, events)
    return restore_lost(cut(repairs(long, bigram_counts(long))), long)


def found(questions: DataFrame, events: DataFrame) -> DataFrame:
    return damaged(questions, events).select("tbl", "rec_key", "field")
