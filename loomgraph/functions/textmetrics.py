"""Sentence BLEU (effective order) and ROUGE-L against a reference text, as Arrow UDFs."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_ROUGE = re.compile(r"[a-z0-9]+")
_PUNCT = re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])")


def tokens_13a(text: str) -> list[str]:
    """Tokens of the standard evaluation tokenizer: punctuation apart, dots and commas apart unless between digits."""
    t = _PUNCT.sub(r" \1 ", text)
    t = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", t)
    t = re.sub(r"([\.,])([^0-9])", r" \1 \2", t)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", t).split()


def sentence_bleu(hyp: str, ref: str, order: int = 4) -> float:
    """BLEU in percent with exponential smoothing over the orders the hypothesis has."""
    h, r = tokens_13a(hyp), tokens_13a(ref)
    if not h or not r:
        return 0.0
    logs, used, smooth = 0.0, 0, 1.0
    for n in range(1, order + 1):
        hc, rc = Counter(tuple(h[i : i + n]) for i in range(len(h) - n + 1)), Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
        total = sum(hc.values())
        if not total:
            break
        match = sum(min(c, rc[g]) for g, c in hc.items())
        if n == 1 and not match:
            return 0.0
        if not match:
            smooth *= 2
            logs += math.log(100.0 / (smooth * total))
        else:
            logs += math.log(100.0 * match / total)
        used += 1
    brevity = 1.0 if len(h) >= len(r) else math.exp(1 - len(r) / len(h))
    return brevity * math.exp(logs / used)


def rouge_l(hyp: str, ref: str) -> float:
    """F1 of the longest common subsequence over [a-z0-9] tokens (letters with accents split words)."""
    a, b = _ROUGE.findall(ref.lower()), _ROUGE.findall(hyp.lower())
    if not a or not b:
        return 0.0
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = v & where.get(x, 0)
        v = ((v + m) | (v - m)) & full
    common = len(a) - v.bit_count()
    if not common:
        return 0.0
    p, r = common / len(b), common / len(a)
    return 2 * p * r / (p + r)


def _pairwise(fn, h: Column, r: Column) -> Column:
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else fn(a, b) for a, b in zip(x.to_pylist(), y.to_pylist())], pa.float64())

    run.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(h, r)


def bleu_col(h: Column, r: Column) -> Column:
    return _pairwise(sentence_bleu, h, r)


def rouge_col(h: Column, r: Column) -> Column:
    return _pairwise(rouge_l, h, r)
