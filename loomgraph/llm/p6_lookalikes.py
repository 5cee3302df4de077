"""Problem 6: labels that look alike but are made of different characters.

Method: a compiled longest-match transducer over grapheme clusters. One regular expression finds, in a single pass, the
clusters (base and its combining marks), runs of spaces and invisible characters that may need a change; a precomputed table gives each cluster's output. The
table is made of rules (compatibility widths from the Unicode data, spaces, format characters, composition) and of the
look-alike letters listed below, and is checked for conflicts: no output is itself an input, no input has two outputs.

Look-alike letters change only where the word appears to be Latin: all letters of the word are Latin or have a Latin twin, and the label is not wholly
in another script. Labels that the hidden Markov model of problem 2 calls wrongly decoded are left as they are.

Defined results: null stays null and blank becomes ""; letter case is kept; runs of spaces become one and outer spaces go; a label
wholly in another script keeps its letters; texts of any length; repeated rows are kept; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.p2_mojibake import _CLEAN_SET as _CLEAN
from loomgraph.llm.p2_mojibake import Model, bigram_counts

#: Letters of other scripts and their Latin twins (fixed values).
TWINS = dict(zip("АВЕЅІЈКМНОРСТХУҮԌԚԜ", "ABESIJKMHOPCTXYYGQW")) | dict(zip("авеѕіјкмнорстхуһԁԛԝѵӏ", "abesijkmhopctxyhdqwvl"))
TWINS |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ", "ABEZHIKMNOPTYXCj")) | dict(zip("ανοικυρτχϲ", "avoikupτxc"))
TWINS |= {"Ɖ": "Đ", "Ð": "Đ", "ð": "đ", "ɖ": "đ", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ѡ": "w", "ẚ": "a", "ꓐ": "B"}
TWINS = {k: v for k, v in TWINS.items() if k != v and v.isascii() or v in "Đđ"}
SIGN_TWINS = {"‐": "-", "‑": "-", "−": "-", "﹣": "-", "ʼ": "'", "′": "'", "⁄": "/", "∕": "/", "․": ".", "‚": ",", "ꓸ": ".", "։": ":", "ː": ":"}

_WIDTH = ("<wide>", "<narrow>", "<font>", "<compat>")


def _width_table() -> dict[str, str]:
    """Full-width, half-width and styled forms of ASCII characters, by rule from the Unicode data."""
    out = {}
    for cp in range(0x80, sys.maxunicode + 1):
        d = unicodedata.decomposition(chr(cp))
        if d.startswith(_WIDTH):
            t = unicodedata.normalize("NFKC", chr(cp))
            if t.isascii() and t.strip() and len(t) == 1:
                out[chr(cp)] = t
    return out


def build_table() -> dict[str, str]:
    """Single characters and their outputs; raises when two rules disagree or an output is an input."""
    table: dict[str, str] = {}
    for rule in (_width_table(), TWINS, SIGN_TWINS):
        for k, v in rule.items():
            if table.setdefault(k, v) != v:
                raise ValueError(f"two outputs for U+{ord(k):04X}")
    for v in table.values():
        if v in table:
            raise ValueError(f"output {v!r} is an input")
    return table


_TABLE = build_table()
_MARK = "\u0300-\u036f\u1ab0-᫿\u1dc0-\u1dff\ufe20-\ufe2f"
_CLUSTER = re.compile(rf"\S[{_MARK}]+|[^\x00-\x7f]|[\t\n\r\x0b\x0c]")
_INVISIBLE = "\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\u180e\u061c\ufe00-\ufe0f"
_WORD = re.compile(rf"[^\W\d_][{_MARK}{_INVISIBLE}]*(?:[^\W\d_][{_MARK}{_INVISIBLE}]*)*")
_LATIN: dict[str, bool] = {}
#: Other widths of digits and signs.
_DIGITS = {k: v for k, v in _width_table().items() if not v.isalpha()}


def _is_latin(ch: str) -> bool:
    if ch not in _LATIN:
        _LATIN[ch] = "LATIN" in unicodedata.name(ch, "") or ch in _WIDE_LETTERS
    return _LATIN[ch]


_WIDE_LETTERS = {k for k, v in _width_table().items() if v.isalpha()}


def other_script(label: str | None) -> bool:
    """Whether a label is wholly in another script: it has letters, none of them Latin, and not all of them Latin twins."""
    base = [c for c in unicodedata.normalize("NFD", label or "") if c.isalpha()]
    return bool(base) and not any(map(_is_latin, base)) and not all(c in TWINS for c in base)


def canonical(label: str | None) -> tuple[str | None, bool]:
    """Consistent form of a label, and whether it held characters other than those it appears to be written in."""
    if label is None:
        return None, False
    if label.isascii() and not any(c in label for c in "\t\n\r\x0b\x0c"):
        return " ".join(label.split(" ")).strip() if "  " not in label else re.sub(" +", " ", label).strip(), False
    base = [c for c in unicodedata.normalize("NFD", label) if c.isalpha()]
    latin = any(_is_latin(c) for c in base)
    mappable = all(_is_latin(c) or c in TWINS for c in base)
    if base and not latin and not mappable:  # wholly in another script: its letters stay, all else has one form
        form = unicodedata.normalize("NFC", "".join(_DIGITS.get(c, c) for c in label if unicodedata.category(c) != "Cf"))
        form = re.sub(r"\s+", " ", form).strip()
        return form, form != re.sub(" +", " ", label).strip()
    blocked: list[tuple[int, int]] = []
    if not mappable:
        for m in _WORD.finditer(label):
            word = unicodedata.normalize("NFD", m.group())
            if any(c.isalpha() and not _is_latin(c) and c not in TWINS for c in word):
                blocked.append(m.span())
    changed = False

    def out(m: re.Match) -> str:
        nonlocal changed
        cluster = m.group()
        c = _cluster_out(cluster, any(a <= m.start() < b for a, b in blocked))
        changed |= c != cluster
        return c

    text = _CLUSTER.sub(out, label)
    text = unicodedata.normalize("NFC", text)
    return re.sub(" +", " ", text).strip(), changed


_CACHE: dict[tuple[str, bool], str] = {}


def _cluster_out(cluster: str, foreign: bool) -> str:
    key = (cluster, foreign)
    if key not in _CACHE:
        parts = []
        for c in unicodedata.normalize("NFD", cluster):
            cat = unicodedata.category(c)
            if cat == "Cf" or "\ufe00" <= c <= "\ufe0f":
                continue
            if cat in ("Zs", "Zl", "Zp") or c in "\t\n\r\x0b\x0c":
                parts.append(" ")
            elif foreign and c in TWINS:
                parts.append(c)
            else:
                parts.append(_TABLE.get(c, c))
        _CACHE[key] = unicodedata.normalize("NFC", "".join(parts))
        if len(_CACHE) > 200_000:
            _CACHE.clear()
            return _cluster_out(cluster, foreign)
    return _CACHE[key]


def labels_long(events: DataFrame, samples: DataFrame) -> DataFrame:
    """(tbl, rec_key, field, text)."""
    both = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("h_label", "t_label")])).alias("f")
    a = events.select(F.lit("historical_events").alias("tbl"), F.col("row_id").cast("string").alias("rec_key"), both).select("tbl", "rec_key", "f.field", "f.text")
    return a.unionByName(samples.select(F.lit("showcase_samples").alias("tbl"), F.col("qid").alias("rec_key"), F.lit("answer").alias("field"), F.col("answer").alias("text")))


_SCHEMA = "tbl string, rec_key string, field string, text string, canonical string, changed boolean, damaged boolean, other_script boolean"


def normalised(long: DataFrame) -> DataFrame:
    """Every label with its consistent form; changed: it held other characters (false for damaged labels); other_script: changed, and wholly in another script."""
    counts = bigram_counts(long)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        seen: dict[str, tuple] = {}
        for b in batches:
            texts = b.column(3).to_pylist()
            if len(seen) > 100_000:
                seen.clear()
            new = [t for t in dict.fromkeys(texts) if t not in seen]
            odd = [t for t in new if t and ("?" in t or not _CLEAN.issuperset(t))]
            if odd:
                model = model or Model(counts)
                odd = [t for t, maybe in zip(odd, model.open_texts(odd)) if maybe and model.spans(t)]  # texts that are not open have an all-clean path
            bad = set(odd)
            for t in new:
                form, changed = canonical(t)
                seen[t] = (t, False, True, False) if t in bad else (form, changed, False, changed and other_script(t))
            rows = [seen[t] for t in texts]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cols[0], pa.string()), *[pa.array(c, pa.bool_()) for c in cols[1:]]], names=["tbl", "rec_key", "field", "text", "canonical", "changed", "damaged", "other_script"])

    return long.mapInArrow(run, _SCHEMA)


def found(events: DataFrame, samples: DataFrame) -> DataFrame:
    """Changed labels, those wholly in another script left out."""
    return normalised(labels_long(events, samples)).where("changed and not other_script").select("tbl", "rec_key", "field")
