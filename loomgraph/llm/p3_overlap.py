"""Problem 3: evaluation questions that also stand in the training split.

Method: Aho-Corasick automata over sharded, normalised evaluation passages scan all training texts. A passage is the folded question
without courteous openings and closings. Three disjoint fragments of it, the rarest of its shard, are the automaton's
words: with a letter between one and the next, two mistyped or swapped letters cannot break all of them. Every training text of the passage's entity runs through the automaton
once; for each passage hit, a second automaton finds its eight chunks in the training text, and the intervals of those at about their own place are merged into a coverage of the
evaluation record, and pairs with enough coverage go to the exact check of words (lost accents, at most two mistyped letters, same
numbers and ordinals). Whether a differing word is a slip or another name is settled by its corpus count against the word it stands for.

Sharding: only entities with both sides count. Small entities share hash shards of bounded expected size. The texts of an entity with more passages or texts
than a block meet by keys instead (`near_pairs`): each key holds all pieces of a passage but two, so that no task holds an unbounded group and no block of texts
meets every other block. Copies of a text are one class until the final join.

Defined results: null question or answer_entity matches nothing; a qid in no split is in no pair; a qid in train and in an evaluation split counts on both sides, never with itself;
repeated member rows count once; texts are read whole; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import _Keep, nfc
from loomgraph.llm.p1_survivor import source_key
from loomgraph.session import cut

#: Courteous openings and closings, as words (fixed values).
OPENINGS = [s.split() for s in ("hãy cho biết", "xin hỏi", "bạn ơi", "cho hỏi", "cho biết", "xin cho biết", "xin hãy cho biết", "làm ơn cho biết", "vui lòng cho biết", "cho tôi hỏi", "cho mình hỏi", "cho tôi biết", "cho mình biết", "ai biết", "xin chào", "chào bạn", "dạ", "thưa", "ơi")]
CLOSINGS = [s.split() for s in ("xin cho biết", "vậy", "thế", "nhỉ", "ạ", "với", "hả", "nhé", "vậy ạ", "thế ạ", "vậy nhỉ", "cảm ơn", "xin cảm ơn", "cảm ơn bạn", "được không", "hả bạn", "bạn nhỉ", "giúp tôi", "giúp mình")]
ASKING = {"dau", "gi", "nao"}
_SPLIT = _Keep(lambda ch: ch if ch.isalnum() or "\u0300" <= ch <= "\u036f" else None if ch in "\u00ad\u200b\u200c\u200d\u2060\ufeff" else " ")
#: Fragment widths tried.
_WIDTHS = (6, 5)
#: Letters of a passage of which two mistyped ones can leave no fragment.
_SHORT = 5
#: Coverage that two mistyped or swapped letters always leave: each breaks at most two of eight chunks or more.
_LEAST = 0.5
_ROMAN = re.compile(r"[ivxlc]+$")
#: Pieces of a passage of a large entity, of which any two may be damaged; letters by which pieces may leave the text.
_PIECES, _PAD = 10, 3
#: Probes of the filter of evaluation keys, and its most bits (as a power of two).
_PROBES, _MOST_BITS = 4, 30
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def split_name(c: Column) -> Column:
    """train, val or test from a freely written split name; null where it is none of them."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")
    return (
        F.when(s.rlike(r"^(tr|train\w*|fit)$"), "train")
        .when(s.rlike(r"^(val\w*|dev\w*|valid\w*)$"), "val")
        .when(s.rlike(r"^(te|test\w*|held_?out|eval\w*|holdout)$"), "test")
    )


_PLAIN = _Keep(lambda ch: "d" if ch == "đ" else "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) not in ("Mn", "Me")))


def plain(text: str) -> str:
    """Accents off, for text that is already in composed lower case."""
    return text if text.isascii() else text.translate(_PLAIN)


def words_of(text: str) -> list[str]:
    return nfc(text).lower().translate(_SPLIT).split()


_OPEN = [(o, [plain(x) for x in o]) for o in sorted(OPENINGS, key=len, reverse=True)]
_CLOSE = [(c, [plain(x) for x in c]) for c in sorted(CLOSINGS, key=len, reverse=True)]
_FIRST, _LAST = {f[0] for _, f in _OPEN}, {f[-1] for _, f in _CLOSE}


def core_words(text: str | None) -> list[str]:
    """Words of a question in composed lower case, without courteous openings and closings."""
    if text is None:
        return []
    w = words_of(text)
    while len(w) > 3 and plain(w[0]) in _FIRST:
        f = [plain(x) for x in w[:6]]
        o = next((o for o, fo in _OPEN if len(w) > len(o) + 2 and (w[: len(o)] == o or len(o) > 1 and f[: len(o)] == fo)), None)
        if o is None:
            break
        w = w[len(o) :]
    while len(w) > 3 and plain(w[-1]) in _LAST:
        f = [plain(x) for x in w[-6:]]
        for c, fc in _CLOSE:
            n = len(c)
            asked = len(f) > n and f[-n - 1] in ASKING
            if len(w) > n + 2 and ((w[-n:] == c and (asked or n > 1 or c[0] not in ("thế", "với"))) or (f[-n:] == fc and asked)):
                w = w[:-n]
                break
        else:
            break
    return w


def _core(v: pa.Array) -> pa.Array:
    return pa.array([" ".join(core_words(x)) for x in v.to_pylist()], pa.string())


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or most + 1 when it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def compare(a: list[str], b: list[str], most: int = 2) -> list[tuple[str, str]] | None:
    """None: another question. Else the word pairs that must be slips (none: same words up to lost accents)."""
    fa, fb = [plain(x) for x in a], [plain(x) for x in b]
    if [x for x in fa if any(c.isdigit() for c in x)] != [x for x in fb if any(c.isdigit() for c in x)]:
        return None
    cost, slips = 0, []
    if len(a) == len(b):
        blocks = [(i, i + 1, i, i + 1) for i in range(len(a)) if a[i] != b[i]]
    else:
        if "".join(fa) == "".join(fb):
            return []
        blocks = [(i1, i2, j1, j2) for tag, i1, i2, j1, j2 in SequenceMatcher(None, fa, fb, autojunk=False).get_opcodes() if tag != "equal"]
        blocks += [(i, i + 1, j, j + 1) for m in SequenceMatcher(None, fa, fb, autojunk=False).get_matching_blocks() for i, j in zip(range(m.a, m.a + m.size), range(m.b, m.b + m.size)) if a[i] != b[j]]
    for i1, i2, j1, j2 in blocks:
        x, y = "".join(a[i1:i2]), "".join(b[j1:j2])
        p, q = plain(x), plain(y)
        if any(c.isdigit() for c in x + y):
            if p != q:
                return None
            continue
        if p == q and (x == p or y == q):
            continue  # accents lost
        if (_ROMAN.match(p) or not p) and (_ROMAN.match(q) or not q):
            return None
        d = osa(p, q, most) if (x == p or y == q) else osa(x, y, most)
        cost += d
        if cost > most:
            return None
        if i2 - i1 == 1 == j2 - j1:
            slips.append((x, y))
        elif max(len(p), len(q)) > 2 and (i1 == i2 or j1 == j2):
            return None
    return slips


class Passages:
    """Automaton over the evaluation passages of one entity (or one block of them)."""

    def __init__(self, passages: list[str]):
        self.words = [p.split() for p in passages]
        self.text = [plain(p).replace(" ", "") for p in passages]
        grams = Counter(g for t in set(self.text) for w in _WIDTHS for g in {t[i : i + w] for i in range(len(t) - w + 1)}) if len(passages) > 1 else None
        auto: dict[str, list[int]] = {}
        for k, t in enumerate(self.text):
            for s in self._fragments(t, grams) if len(t) >= _SHORT else ():
                auto.setdefault(s, []).append(k)
        self.auto = ahocorasick.Automaton()
        for s, ks in auto.items():
            self.auto.add_word(s, ks)
        if auto:
            self.auto.make_automaton()
        #: Two mistyped letters can leave nothing of these: they go to the exact check against every text of about their length.
        self.short = {k for k, t in enumerate(self.text) if len(t) < _SHORT}
        self.any = bool(auto)
        self.chunks: dict[int, ahocorasick.Automaton] = {}

    @staticmethod
    def _fragments(t: str, grams: Counter | None) -> list[str]:
        """Three fragments with a letter between them, of which two mistyped or swapped letters leave one: the rarest of the shard, of the width that makes them rarest."""
        n = len(t)
        step = (n - 2) // 3
        even = [t[i : i + step] for i in range(0, 3 * (step + 1), step + 1)]
        if grams is None or n < 3 * max(_WIDTHS) + 2:
            return even
        best: tuple[int, list[str]] | None = None
        for w in _WIDTHS:
            df = [grams[t[i : i + w]] for i in range(n - w + 1)]
            taken: list[int] = []
            for i in sorted(range(len(df)), key=df.__getitem__):
                if all(abs(i - j) > w for j in taken):
                    taken.append(i)
                    if len(taken) == 3:
                        break
            if len(taken) == 3 and (best is None or sum(df[i] for i in taken) < best[0]):
                best = sum(df[i] for i in taken), [t[i : i + w] for i in taken]
        return even if best is None else best[1]

    def scan(self, text: str, least: float, slack: int = 2) -> list[tuple[int, float]]:
        """(passage, coverage) of the passages that may stand in the text.

        slack: letters by which a chunk may be shifted; passages whose length differs by more letters than may be mistyped are another question.
        """
        n = len(text)
        out = []
        for k in self.short.union(k for _, ks in self.auto.iter(text) for k in ks) if self.any else self.short:
            t = self.text[k]
            if abs(len(t) - n) > slack:
                continue
            if t == text:
                out.append((k, 1.0))
                continue
            cover = self.coverage(k, text, slack)
            if cover >= least or k in self.short:
                out.append((k, cover))
        return out

    def coverage(self, k: int, text: str, slack: int) -> float:
        """Share of a passage whose chunks stand in the text at about their own place: merged intervals of their automaton's matches."""
        t = self.text[k]
        if k not in self.chunks:
            starts: dict[str, list[int]] = {}
            step = max(1, len(t) // 8)
            for i in range(0, len(t), step):
                starts.setdefault(t[i : i + step], []).append(i)
            auto = ahocorasick.Automaton()
            for piece, at in starts.items():
                auto.add_word(piece, (len(piece), at))
            if starts:
                auto.make_automaton()
            self.chunks[k] = auto
        found = {(i, i + n) for end, (n, at) in self.chunks[k].iter(text) for i in at if -slack <= end + 1 - n - i <= slack} if t and text else ()
        covered, last = 0, 0
        for a, b in sorted(found):
            covered += max(0, b - max(a, last))
            last = max(last, b)
        return covered / max(1, len(t))


def _scan_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    by: dict[str, tuple[list, list]] = {}
    for entity, core, cid, is_eval in zip(pdf.entity, pdf.core, pdf.cid, pdf.is_eval):
        by.setdefault(entity, ([], []))[0 if is_eval else 1].append((cid, core))
    rows = []
    for ev, tr in by.values():
        if not ev or not tr:
            continue
        passages = Passages([core for _, core in ev])
        for cid, core in tr:
            found = passages.scan(plain(core).replace(" ", ""), _LEAST)
            if found:
                words = core.split()
                for k, cover in found:
                    slips = compare(passages.words[k], words)
                    if slips is not None:
                        rows.append((ev[k][0], cid, round(cover, 4), [{"a": a, "b": b} for a, b in slips]))
    return pd.DataFrame(rows, columns=["eval_cid", "train_cid", "coverage", "slips"])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _cuts(n: int) -> list[tuple[int, int]]:
    """Pieces of a passage of n letters, a letter between one and the next, so that a mistyped letter or a swap damages one at most."""
    k = max(3, min(_PIECES, n // 3))
    at = [i * n // k for i in range(k + 1)]
    return [(a, b if b == n else max(a, b - 1)) for a, b in zip(at, at[1:])]


def _keys(letters: np.ndarray, salt: np.ndarray, evaluation: bool) -> Iterator[np.ndarray]:
    """Keys of texts of one length (a row of letters each): all pieces but two of a passage, with the salt of the text.

    A training text has the keys under which it may be a passage of at most two letters less or more: pieces before the first slip stand in place, those between the two
    are moved by one letter at most, those behind the second by the difference in length.
    """
    m = letters.shape[1]
    c = np.pad(letters.T.astype(np.uint64) + np.uint64(1), ((_PAD, _PAD), (0, 0)))
    before, power = np.zeros((len(c) + 1, c.shape[1]), np.uint64), np.cumprod(np.append(np.uint64(1), np.full(len(c), _BASE)))
    for i, row in enumerate(c):
        before[i + 1] = before[i] * _BASE + row
    for n in [m] if evaluation else range(max(1, m - 2), m + 3):
        pieces, end = _cuts(n), m - n
        k, sums = len(pieces), {}
        for s in {0, end} if evaluation else {-1, 0, 1, end}:
            sums[s] = np.zeros((k + 1, len(letters)), np.uint64)
            for j, (a, b) in enumerate(pieces):
                part = before[b + s + _PAD] - before[a + s + _PAD] * power[b - a]
                sums[s][j + 1] = sums[s][j] + _mixed((part + np.uint64(j + 1)) * _MIX)
        for x in range(k):
            for y in range(x + 1, k):
                rest = sums[0][x] + sums[end][k] - sums[end][y + 1] + salt + np.uint64((n * 64 + x) * 64 + y)
                for s in [0] if evaluation or y == x + 1 else [s for s in (-1, 0, 1) if abs(end - s) <= 1]:
                    yield _mixed((rest + sums[s][y] - sums[s][x + 1]) * _MIX)


def _spot(keys: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """Place of each key in the filter, for one of its probes."""
    return (_mixed(keys + np.uint64(probe) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def _letters_of(c: np.ndarray) -> np.ndarray:
    """52 bits of each text: whether it has each letter, and whether twice. A mistyped letter changes two bits at most, a swap none."""
    out = np.zeros(len(c), np.int64)
    for i in range(26):
        n = (c == 97 + i).sum(1)
        out |= ((n > 0).astype(np.int64) << 2 * i) | ((n > 1).astype(np.int64) << 2 * i + 1)
    return out


def _key_rows(evaluation: bool, occupied=None):
    """Rows (key, id, letters) of texts(id, salt, core); with `occupied` (a broadcast bitmap) only those under a key of an evaluation text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = None if occupied is None else np.frombuffer(occupied.value, np.uint8)
        bits = 0 if taken is None else len(taken).bit_length() + 2
        rows: list[tuple[int, int, str]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            by: dict[int, list] = {}
            for id_, salt, core in rows:
                text = plain(core)
                numbers = " ".join(w for w in text.split() if any(ch.isdigit() for ch in w)) if any(ch.isdigit() for ch in text) else ""
                text = text.replace(" ", "")
                by.setdefault(len(text), []).append((id_, (salt + zlib.crc32(numbers.encode()) * 0x632BE5AB) % (1 << 64), text))
            rows.clear()
            for n, part in by.items():
                c = np.frombuffer("".join(t for _, _, t in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
                ids, salt, letters = np.array([i for i, _, _ in part], np.int64), np.array([x for _, x, _ in part], np.uint64), _letters_of(c)
                keys, owner = [], []
                for key in _keys(c, salt, evaluation):
                    at = np.arange(len(key))
                    if taken is not None:
                        for i in range(_PROBES):
                            spot = _spot(key[at], i, bits)
                            at = at[(taken[spot >> 3] >> (spot & 7)) & 1 == 1]
                    keys.append(key[at].view(np.int64))
                    owner.append(at)
                at = np.concatenate(owner)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids[at]), pa.array(letters[at])], names=["key", "id", "letters"])

        for b in batches:
            rows.extend(zip(*(b.column(i).to_pylist() for i in range(3))))
            if len(rows) >= 50_000:
                yield from flush()
        yield from flush()

    return run


def _filter(keys: DataFrame, bits: int) -> bytes:
    """Bitmap of the probes of all keys: at most 2^_MOST_BITS bits reach the driver, whatever the number of keys."""
    width = min(bits, 19)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).to_numpy().view(np.uint64)
            spot = np.concatenate([_spot(k, i, bits) for i in range(_PROBES)])
            order = np.argsort(spot, kind="stable")
            spot = spot[order]
            start = np.flatnonzero(np.append(True, np.diff(spot >> width) != 0)) if len(spot) else np.empty(0, np.int64)
            low = (spot & ((1 << width) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array((spot[start] >> width).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(start, len(spot)).astype(np.int32)), pa.array(low))], names=["block", "low"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: dict[int, np.ndarray] = {}
        for b in batches:
            off, low = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
            for i, k in enumerate(b.column(0).to_pylist()):
                taken.setdefault(k, np.zeros(1 << width, bool))[low[off[i] : off[i + 1]]] = True
        for k, t in taken.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(t, bitorder="little").tobytes()])], names=["block", "bits"])

    out = bytearray(1 << bits - 3)
    rows = keys.select("key").mapInArrow(probes, "block int, low array<int>").repartition("block").mapInArrow(block, "block int, bits binary")
    for r in rows.toLocalIterator():
        at = r["block"] << width - 3
        out[at : at + len(r["bits"])] = r["bits"]
    return bytes(out)


_FOUND = "eval_cid string, train_cid string, coverage double, slips array<struct<a:string,b:string>>"


def near_pairs(texts: DataFrame) -> DataFrame:
    """(eid, tid) of the evaluation and training texts(id, salt, core, is_eval) that agree in all pieces but two and in most letters.

    Every key leaves out two pieces, and two slips damage no more than two, so no pair is lost; no text is compared with all others of its entity.
    """
    side = lambda is_eval: texts.where(F.col("is_eval") == F.lit(is_eval)).select("id", "salt", "core")
    ev = cut(side(True).mapInArrow(_key_rows(True), "key long, id long, letters long"))
    bits = min(_MOST_BITS, max(16, (12 * ev.count()).bit_length()))
    occupied = texts.sparkSession.sparkContext.broadcast(_filter(ev, bits))
    tr = side(False).mapInArrow(_key_rows(False, occupied), "key long, id long, letters long")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 4
    return ev.select("key", F.col("id").alias("eid"), F.col("letters").alias("a")).join(tr.select("key", F.col("id").alias("tid"), F.col("letters").alias("b")), "key").where(near).select("eid", "tid").distinct()


def large_pairs(texts: DataFrame) -> DataFrame:
    """The pairs of `_scan_cell` for entities of any size: texts(entity, core, cid, is_eval) that are near by their keys, after the exact check."""
    texts = cut(texts.withColumn("id", F.xxhash64("cid")).withColumn("salt", F.shiftrightunsigned(F.xxhash64("entity"), 1)))
    whole = lambda is_eval, k: texts.where(F.col("is_eval") == F.lit(is_eval)).select(F.col("id").alias(f"{k}id"), F.col("entity").alias(f"{k}entity"), F.col("cid").alias(f"{k}cid"), F.col("core").alias(f"{k}core"))
    both = near_pairs(texts).join(whole(False, "t"), "tid").join(whole(True, "e"), "eid").where("eentity = tentity").select("ecid", "tcid", "ecore", "tcore")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for e, t, x, y in zip(*(c.to_pylist() for c in b.columns)):
                slips = compare(x.split(), y.split())
                if slips is not None:
                    p, text = Passages([x]), plain(y).replace(" ", "")
                    rows.append((e, t, round(1.0 if p.text[0] == text else p.coverage(0, text, 2), 4), [{"a": u, "b": v} for u, v in slips]))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["eval_cid", "train_cid", "coverage", "slips"]), schema=_ARROW, preserve_index=False)

    return both.mapInArrow(check, _FOUND)


_ARROW = pa.schema([("eval_cid", pa.string()), ("train_cid", pa.string()), ("coverage", pa.float64()), ("slips", pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())])))])


def class_pairs(members: DataFrame, eval_block: int = 20_000, train_block: int = 10_000, slip_ratio: float = 20.0) -> DataFrame:
    """(eval_cid, train_cid, coverage) of matching text classes. members: (qid, entity, core, cid, is_eval), see `membership`.

    eval_block, train_block: rows of an entity up to which an automaton scans it; slip_ratio: how many times rarer a mistyped word must be than the word it stands for.
    """
    classes = cut(members.where("core <> ''").groupBy("cid", "is_eval").agg(F.first("entity").alias("entity"), F.first("core").alias("core"), F.count("*").alias("n")))
    sizes = classes.groupBy("entity").agg(F.sum(F.col("is_eval").cast("int")).alias("ne"), F.sum((~F.col("is_eval")).cast("int")).alias("nt")).where("ne > 0 and nt > 0")
    sizes = cut(sizes)
    total = sizes.agg(F.sum(F.col("ne") + F.col("nt")).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // train_block), int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large = (F.col("ne") > eval_block) | (F.col("nt") > train_block)
    placed = classes.join(sizes.select("entity", large.alias("large")), "entity").select("entity", "core", "cid", "is_eval", "large")
    cells = placed.where("not large").select(F.pmod(F.xxhash64("entity"), F.lit(shards)).alias("cell"), "entity", "core", "cid", "is_eval")
    hits = cells.groupBy("cell").applyInPandas(lambda pdf: _scan_cell(pdf), _FOUND)
    if sizes.where(large).limit(1).count():
        hits = hits.unionByName(large_pairs(placed.where("large").drop("large")))
    hits = cut(hits.withColumn("pair", F.concat_ws("|", "eval_cid", "train_cid")))
    # a slip is far rarer than the word it stands for
    counts = classes.select(F.explode(F.split("core", " ")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    slips = hits.where(F.size("slips") > 0).select("pair", F.explode("slips").alias("s")).select("pair", "s.a", "s.b")
    needed = slips.select(F.col("a").alias("word")).union(slips.select("b")).distinct()
    counts = counts.join(needed, "word", "left_semi")
    ca, cb = counts.select(F.col("word").alias("a"), F.col("n").alias("na")), counts.select(F.col("word").alias("b"), F.col("n").alias("nb"))
    other_name = slips.join(ca, "a", "left").join(cb, "b", "left").where(F.least(F.coalesce("na", F.lit(1)), F.coalesce("nb", F.lit(1))) * slip_ratio > F.greatest(F.coalesce("na", F.lit(1)), F.coalesce("nb", F.lit(1)))).select("pair").distinct()
    return hits.join(other_name, "pair", "left_anti").select("eval_cid", "train_cid", "coverage")


def membership(questions: DataFrame, members: DataFrame) -> DataFrame:
    """(qid, entity, core, cid, is_eval, split, source): questions of train and of the evaluation splits, once per side."""
    core = F.arrow_udf(_typed_core(), "string")
    q = questions.where("question is not null and answer_entity is not null").select("qid", F.col("answer_entity").alias("entity"), "question", F.coalesce(source_key(F.col("source")), F.lit("(none)")).alias("source"))
    side = members.select("qid", split_name(F.col("split")).alias("split")).where("split is not null").distinct()
    rows = q.join(side, "qid").withColumn("core", core(F.col("question"))).drop("question")
    return rows.withColumn("cid", F.md5(F.concat_ws("\x01", "entity", "core"))).withColumn("is_eval", F.col("split") != "train")


def _typed_core():
    def run(v: pa.Array) -> pa.Array:
        return _core(v)

    run.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return run


def overlaps(questions: DataFrame, members: DataFrame) -> DataFrame:
    """(eval_qid, train_qid, split, eval_source, train_source, coverage): every overlapping pair."""
    rows = cut(membership(questions, members))
    pairs = class_pairs(rows.select("qid", "entity", "core", "cid", "is_eval"))
    ev = rows.where("is_eval").select(F.col("cid").alias("eval_cid"), F.col("qid").alias("eval_qid"), "split", F.col("source").alias("eval_source"))
    tr = rows.where("not is_eval").select(F.col("cid").alias("train_cid"), F.col("qid").alias("train_qid"), F.col("source").alias("train_source"))
    return pairs.join(ev, "eval_cid").join(tr, "train_cid").where("eval_qid <> train_qid").select("eval_qid", "train_qid", "split", "eval_source", "train_source", "coverage")


def found(questions: DataFrame, members: DataFrame) -> DataFrame:
    o = overlaps(questions, members)
    return o.select(F.least("eval_qid", "train_qid").alias("qid_a"), F.greatest("eval_qid", "train_qid").alias("qid_b")).distinct()


def report(questions: DataFrame, members: DataFrame) -> DataFrame:
    """Overlap per evaluation split and source: pairs, evaluation records hit, share of the records of that split and source.

    Counted over classes of equal texts: a class of k evaluation and m training records counts k x m pairs, which are never built.
    """
    rows = cut(membership(questions, members))
    pairs = class_pairs(rows.select("qid", "entity", "core", "cid", "is_eval"))
    train = rows.where("not is_eval").select(F.col("cid").alias("train_cid"), "qid").distinct()
    size = train.groupBy("train_cid").agg(F.count("*").alias("m"))
    per_class = pairs.join(size, "train_cid").groupBy(F.col("eval_cid").alias("cid")).agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("coverage")).alias("c"))
    ev = rows.where("is_eval").select("qid", "cid", "split", "source").distinct()
    both = ev.join(train.withColumnRenamed("train_cid", "cid"), ["cid", "qid"], "left_semi").select("qid", "cid", F.lit(1).alias("self")).distinct()  # in train and here: no pair with itself
    each = ev.join(per_class, "cid").join(both, ["qid", "cid"], "left").select("split", "source", "qid", (F.col("m") - F.coalesce("self", F.lit(0))).alias("m"), (F.col("c") - F.coalesce("self", F.lit(0))).alias("c"))
    hit = each.where("m > 0").groupBy("split", "source").agg(F.sum("m").alias("n_pairs"), F.count_distinct("qid").alias("n_eval_hit"), F.round(F.sum("c") / F.sum("m"), 6).alias("mean_coverage"))
    side = members.select("qid", split_name(F.col("split")).alias("split")).where("split in ('val', 'test')").distinct()
    n = questions.select("qid", F.coalesce(source_key(F.col("source")), F.lit("(none)")).alias("source")).join(side, "qid").groupBy("split", "source").agg(F.count("*").alias("n_eval"))
    return n.join(hit, ["split", "source"], "left").na.fill(0, ["n_pairs", "n_eval_hit"]).withColumn("share_hit", F.round(F.col("n_eval_hit") / F.col("n_eval"), 6))
