"""Array operators of the sequence model, on columns of numbers; and the model itself in numpy for Arrow batches."""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harfgah.session import spread


def doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being worked out once: as the one element of an array, it isn't read anew for each of use's elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rms_norm(c: Column, eps: float = 1e-5) -> Column:
    """x / sqrt(mean of squares + eps); the empty array stays."""
    scale = F.sqrt(total(F.transform(c, lambda x: x * x)) / F.greatest(F.size(c), F.lit(1)) + eps)
    return bound(scale, lambda s: F.transform(c, lambda x: x / s))


def softmax(c: Column) -> Column:
    """The empty array stays."""
    shifted = bound(F.array_max(c), lambda top: F.transform(c, lambda x: F.exp(x - top)))
    return bound(shifted, lambda e: bound(total(e), lambda t: F.transform(e, lambda x: x / t)))


def row_scale(c: Column, qmax: int) -> Column:
    """The step of a row's codes; 1 for a row of zeros."""
    top = F.array_max(F.transform(c, lambda x: F.abs(x)))
    return F.when(top > 0, top / qmax).otherwise(1.0)


def row_codes(c: Column, qmax: int) -> Column:
    return bound(row_scale(c, qmax), lambda s: F.transform(c, lambda x: F.greatest(F.lit(-qmax), F.least(F.lit(qmax), F.bround(x / s).cast("int")))))


def coded_error(c: Column, qmax: int) -> Column:
    """The greatest difference that a row's codes leave."""
    return bound(row_scale(c, qmax), lambda s: F.array_max(F.transform(c, lambda x: F.abs(x - s * F.greatest(F.lit(-qmax), F.least(F.lit(qmax), F.bround(x / s)))))))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _scanned(gate: pd.Series, value: pd.Series, back: pd.Series) -> pd.Series:
    """Rows of one length go through the places together, so the Python work grows with the length, not with the rows."""
    out: list = [None] * len(gate)
    ways: dict[tuple[int, bool], list[int]] = {}
    for i, (g, v, b) in enumerate(zip(gate, value, back, strict=True)):
        if g is not None and v is not None:
            ways.setdefault((min(len(g), len(v)), bool(b)), []).append(i)
    for (n, b), rows in ways.items():
        a, x = (np.array([np.asarray(s.iloc[i][:n], np.float64) for i in rows]).reshape(len(rows), n) for s in (gate, value))
        h, made = np.zeros(len(rows)), np.empty((len(rows), n))
        for k in range(n - 1, -1, -1) if b else range(n):
            h = a[:, k] * h + (1 - a[:, k]) * x[:, k]
            made[:, k] = h
        for i, row in zip(rows, made, strict=True):
            out[i] = row
    return pd.Series(out, index=gate.index)


def convex_scan(gate: Column, value: Column, back: bool = False) -> Column:
    """h = gate * h + (1 - gate) * value along two arrays, from 0; back: from the end. A null side gives null, the shorter one's length counts."""
    return _scanned(gate, value, F.lit(back))


# The letters of six-bit codes, the code in the middle being 0.
SIX_BIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+"


def letters_of(codes: Column) -> Column:
    """Codes of -31 to 31 as one letter each."""
    return F.array_join(F.transform(codes, lambda c: F.lit(SIX_BIT).substr(c + 32, F.lit(1))), "")


def codes_of(letters: Column) -> Column:
    """The codes of letters; a letter that is none of a code's stops the query."""
    place = lambda c: F.instr(F.lit(SIX_BIT), c)
    found = F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: place(c) - 32)
    return F.when(letters.isNull() | letters.rlike(r"\A[A-Za-z0-9+]*\z"), found).otherwise(F.raise_error(F.lit("a letter of no code")).cast("array<int>"))


# The model: a few thousand weights, the same in every task.


@dataclass
class Weights:
    """embed: letters x d; blocks: of (gate and value weights for a window of letters, bias, out weights, out bias, norm); head: d x labels."""

    letters: str
    labels: list[str]
    context: int
    embed: np.ndarray
    blocks: list[dict[str, np.ndarray]]
    head: np.ndarray
    head_bias: np.ndarray

    @classmethod
    def random(cls, letters: str, labels: list[str], d: int = 16, hidden: int = 12, blocks: int = 2, context: int = 2, seed: int = 5) -> Weights:
        """Untrained weights for tests of the operators."""
        r = np.random.default_rng(seed)
        make = lambda *shape: (r.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
        wide = d * (2 * context + 1)
        parts = [{"gate": make(wide, 4 * hidden), "bias": make(4 * hidden), "out": make(2 * hidden, d), "out_bias": make(d), "norm": np.ones(d, np.float32)} for _ in range(blocks)]
        return cls(letters, labels, context, make(len(letters) + 1, d), parts, make(d, len(labels)), make(len(labels)))

    def quantised(self, qmax: int = 127, bits: int = 8) -> dict[str, tuple[str, list[float], list[int]]]:
        """Each matrix as base64 codes, or of six bits (qmax 31) as one letter each, with a scale for each row, and its shape."""
        out = {}
        for name, m in self.matrices().items():
            rows = m.reshape(len(m), -1).astype(np.float64)
            top = np.abs(rows).max(axis=1)
            scale = np.where(top > 0, top / qmax, 1.0)
            codes = np.clip(np.rint(rows / scale[:, None]), -qmax, qmax).astype(np.int8)
            text = "".join(SIX_BIT[c + 31] for c in codes.ravel().tolist()) if bits == 6 else base64.b64encode(codes.tobytes()).decode()
            out[name] = (text, scale.tolist(), list(m.shape))
        return out

    def matrices(self) -> dict[str, np.ndarray]:
        return {"embed": self.embed, "head": self.head, "head_bias": self.head_bias, **{f"{i}.{k}": v for i, b in enumerate(self.blocks) for k, v in b.items()}}


def dequantised(text: str, scales: list[float], shape: list[int], bits: int = 8) -> np.ndarray:
    """Raises if the codes or scales don't fit the shape, or, of six bits, if a letter is no code."""
    if bits == 6:
        codes = np.array([SIX_BIT.index(c) - 31 for c in text], np.int8)
    else:
        codes = np.frombuffer(base64.b64decode(text), np.int8)
    if len(codes) != math.prod(shape) or len(scales) != shape[0]:
        raise ValueError(f"{len(codes)} codes and {len(scales)} scales for shape {shape}")
    return (codes.reshape(shape[0], -1) * np.array(scales)[:, None]).reshape(shape).astype(np.float32)


def forward(w: Weights, ids: list[int]) -> np.ndarray:
    """Logits, letters x labels: windows of neighbours, two gated scans (forward and backward), residual, RMS norm, head."""
    if not ids:
        return np.zeros((0, len(w.labels)), np.float32)
    x = w.embed[ids]
    for b in w.blocks:
        padded = np.pad(x, ((w.context, w.context), (0, 0)))
        near = np.concatenate([padded[k : k + len(x)] for k in range(2 * w.context + 1)], axis=1)
        z = near @ b["gate"] + b["bias"]
        gate_f, value_f, gate_b, value_b = np.split(z, 4, axis=1)
        a, c = 1 / (1 + np.exp(-gate_f)), 1 / (1 + np.exp(-gate_b))
        both = np.concatenate([_scan(a, np.maximum(value_f, 0)), _scan(c[::-1], np.maximum(value_b, 0)[::-1])[::-1]], axis=1)
        x = x + both @ b["out"] + b["out_bias"]
        x = x / np.sqrt((x**2).mean(axis=1, keepdims=True) + 1e-5) * b["norm"]
    return x @ w.head + w.head_bias


def _scan(keep: np.ndarray, value: np.ndarray) -> np.ndarray:
    h, out = np.zeros(value.shape[1], np.float32), np.empty_like(value)
    for i in range(len(value)):
        h = keep[i] * h + (1 - keep[i]) * value[i]
        out[i] = h
    return out


def top_choices(row: np.ndarray, k: int, floor: float) -> list[tuple[int, float]]:
    """Labels by probability: k at most, none under the floor, the best one at least."""
    e = np.exp(row - row.max())
    p = e / e.sum()
    order = np.argsort(-p, kind="stable")
    kept = [(int(i), float(p[i])) for i in order[:k] if p[i] >= floor]
    return kept or [(int(order[0]), max(float(p[order[0]]), 5e-324))]


def beam(logits: np.ndarray, labels: list[str], width: int = 8, k: int = 4, results: int = 3, floor: float = 1e-4) -> list[tuple[str, float]]:
    """Outputs with log probability: at each letter the best labels, one entry for each output, the widest kept."""
    found = {"": 0.0}
    for row in logits:
        grown: dict[str, float] = {}
        for output, score in found.items():
            for i, p in top_choices(row, k, floor):
                o, s = output + labels[i], score + math.log(p)
                if s > grown.get(o, -math.inf):
                    grown[o] = s
        found = dict(sorted(grown.items(), key=lambda x: -x[1])[:width])
    return list(found.items())[:results]


def decoded(words: DataFrame, word: str, weights: Weights, **options: float) -> DataFrame:
    """word, ord, output, log_prob by the model; letters it doesn't know have id 0."""
    share = words.sparkSession.sparkContext.broadcast(weights)
    kind = "word string, ord int, output string, log_prob double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = share.value
        place = {c: i + 1 for i, c in enumerate(w.letters)}
        for batch in batches:
            rows = [(x, i, o, s) for x in batch.column(0).to_pylist() if x is not None for i, (o, s) in enumerate(beam(forward(w, [place.get(c, 0) for c in x]), w.labels, **options))]
            yield pa.RecordBatch.from_pydict({"word": pa.array([r[0] for r in rows], pa.string()), "ord": pa.array([r[1] for r in rows], pa.int32()), "output": pa.array([r[2] for r in rows], pa.string()), "log_prob": pa.array([r[3] for r in rows], pa.float64())})

    return spread(words.select(F.col(word).alias("word"))).mapInArrow(work, kind)
