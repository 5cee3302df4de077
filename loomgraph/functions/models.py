"""Model operators on stored vectors as Arrow UDFs: grouped-query cross-attention and a small multilayer perceptron."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.operators.retrieval import check_heads


def attention(z: np.ndarray, keys: np.ndarray, values: np.ndarray, wq: np.ndarray, wo: np.ndarray, heads: int, kv_heads: int) -> np.ndarray:
    """Cross-attention of one query vector over tokens. keys, values: tokens x (kv_heads x d); each key/value head serves heads/kv_heads query heads in a row."""
    d = wq.shape[1] // heads
    check_heads(wq.shape[1], heads, kv_heads, d)
    q = (z @ wq).reshape(heads, d)
    k, v = keys.reshape(-1, kv_heads, d), values.reshape(-1, kv_heads, d)
    group = np.repeat(np.arange(kv_heads), heads // kv_heads)
    s = np.einsum("hd,thd->ht", q, k[:, group]) / np.sqrt(d)
    e = np.exp(s - s.max(1, keepdims=True))
    w = e / e.sum(1, keepdims=True)
    return np.einsum("ht,thd->hd", w, v[:, group]).reshape(-1) @ wo


def attention_rows(z: np.ndarray, tokens: np.ndarray, wq: np.ndarray, wo: np.ndarray, heads: int, kv_heads: int) -> np.ndarray:
    """The same for many rows with the same number of tokens: z rows x h, tokens rows x tokens x (kv_heads x d)."""
    d = wq.shape[1] // heads
    check_heads(wq.shape[1], heads, kv_heads, d)
    q = (z @ wq).reshape(len(z), kv_heads, heads // kv_heads, d)
    k = tokens.reshape(len(z), -1, kv_heads, d)
    s = np.einsum("ngad,ntgd->ngat", q, k, optimize=True) / np.sqrt(d)
    e = np.exp(s - s.max(-1, keepdims=True))
    return np.einsum("ngat,ntgd->ngad", e / e.sum(-1, keepdims=True), k, optimize=True).reshape(len(z), -1) @ wo


def start_matrix(rows: int, cols: int, salt: int) -> np.ndarray:
    """Deterministic parameters in [-1, 1] by integer arithmetic."""
    i, j = np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij")
    return (((i + 1) * (j + 3) * 7919 + salt * 31) % 2001 - 1000) / 1000.0


def mlp(x: np.ndarray, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float) -> np.ndarray:
    """sigmoid(relu(x W1 + b1) W2 + b2) per row."""
    return 1 / (1 + np.exp(-(np.maximum(x @ w1 + b1, 0) @ w2 + b2)))


def _rows(v: pa.Array) -> np.ndarray:
    return np.array([x for x in v.to_pylist()], np.float64)


def mlp_col(vec: Column, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float) -> Column:
    def run(v: pa.Array) -> pa.Array:
        return pa.array(mlp(_rows(v), w1, b1, w2, b2) if len(v) else [], pa.float64())

    run.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(vec)


def attention_col(query: Column, tokens: Column, wq: np.ndarray, wo: np.ndarray, heads: int, kv_heads: int) -> Column:
    """tokens: array of vectors that serve as keys and values; no tokens give zeros."""

    def run(z: pa.Array, t: pa.Array) -> pa.Array:
        if not len(z):
            return pa.array([], pa.list_(pa.float64()))
        q = np.asarray(z.flatten(), np.float64).reshape(len(z), -1)
        counts = np.diff(np.asarray(t.offsets))
        flat = np.asarray(t.flatten().flatten(), np.float64).reshape(int(counts.sum()), -1)
        first = np.cumsum(counts) - counts
        out = np.zeros((len(z), wo.shape[1]))
        for n in np.unique(counts):  # rows with the same number of tokens go together
            at = np.flatnonzero(counts == n)
            if n:
                out[at] = attention_rows(q[at], flat[first[at, None] + np.arange(n)], wq, wo, heads, kv_heads)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * wo.shape[1], pa.int32()), pa.array(out.ravel()))

    run.__annotations__ = {"z": pa.Array, "t": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<double>")(query, tokens)


def leaf_counts(text: str | None) -> tuple[int, int]:
    """Null and other leaves of a JSON tree; unreadable text counts as one null."""

    def walk(x):
        if isinstance(x, dict):
            x = list(x.values())
        if isinstance(x, list):
            parts = [walk(y) for y in x]
            return sum(p[0] for p in parts), sum(p[1] for p in parts)
        return (1, 0) if x is None else (0, 1)

    try:
        return walk(json.loads(text)) if text is not None else (1, 0)
    except ValueError:
        return 1, 0


def leaf_counts_col(c: Column) -> Column:
    def run(v: pa.Array) -> pa.Array:
        got = [leaf_counts(x) for x in v.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], ["nulls", "filled"])

    run.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "nulls long, filled long")(c)
