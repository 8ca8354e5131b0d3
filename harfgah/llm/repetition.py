"""Problem 9: repetition inside a single document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harfgah.llm.arrow import map_batches, pieces
from harfgah.llm.text import Words, spans_hash

LENGTHS = (2, 4, 6, 8, 10)
#: What TESTDATA.md calls a repetitive document.
MIN_WORDS, RUN, SHARE_TENTHS = 5, 4, 3


def repeats(w: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of spans of words, in order: whether the same words already stood at an earlier span of the same text."""
    again = np.zeros(len(start), bool)
    if not len(start):
        return again
    text = w.text[start]
    key = spans_hash(w.hash, start, end) * np.uint64(0xBF58476D1CE4E5B9) + text.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    group = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    now, before = order[same], order[group[same]]
    # equal hashes are held against the words themselves
    size = end[now] - start[now]
    true = (text[now] == text[before]) & (size == end[before] - start[before])
    for k in range(int(size.max(initial=0))):
        i = np.flatnonzero(true & (k < size))
        if not len(i):
            break
        true[i] &= w.hash[start[now[i]] + k] == w.hash[start[before[i]] + k]
    again[now[true]] = True
    return again


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    edges = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(edges)[:n] > 0


def lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Spans of words that stand in one line of a text; lines without words are left out."""
    n = len(w.start)
    breaks = np.flatnonzero(np.isin(w.codes.a, [ord(c) for c in "\n\r\v\f\x85  \x1e"]))
    line = np.searchsorted(breaks, w.start)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    return first, np.append(first[1:], n)


def measured(w: Words, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    n, chars = len(w.start), (w.end - w.start).astype(np.float64)
    total = np.bincount(w.text, chars, w.n)
    out = {"n_words": w.size, "n_word_chars": total}
    last = (w.first + w.size)[w.text] if n else np.zeros(0, np.int64)
    for k in lengths:
        start = np.flatnonzero(np.arange(n) + k <= last)
        start = start[repeats(w, start, start + k)]
        inside = covered(n, start, start + k)
        out[f"repeated_words_{k}"] = np.bincount(w.text[inside], minlength=w.n)
        out[f"repeated_chars_{k}"] = np.bincount(w.text[inside], chars[inside], w.n)
    start, end = lines(w) if n else (np.zeros(0, np.int64),) * 2
    again = repeats(w, start, end)
    inside = covered(n, start[again], end[again])
    out["repeated_line_chars"] = np.bincount(w.text[inside], chars[inside], w.n)
    return out


def repetition(df: DataFrame, key: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """One row for each row of df: its words, and how many of them (and of their characters) lie in a run of k words
    that already started earlier in the same text, for each k of lengths; likewise for whole lines.

    Runs may overlap. A null, empty or wordless text has 0 everywhere. Other columns of df are left out, so their names
    can't clash. No shuffle: a text is whole in its row, however long, and is worked on with numpy in Arrow batches.
    """
    names = ["n_words", "n_word_chars", *(f"repeated_{what}_{k}" for k in lengths for what in ("words", "chars")), "repeated_line_chars"]
    kind = df.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        for a, b in pieces(texts):
            got = measured(Words(texts[a:b]), lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(got[k].astype(np.int64)) for k in names)], names=["key", *names])

    out = map_batches(df.select(F.col(key).alias("key"), F.col(text).alias("text")), work, f"key {kind}, " + ", ".join(f"{k} long" for k in names))
    return out.withColumnRenamed("key", key)


def repetitive(measures: DataFrame) -> DataFrame:
    """The rows of repetition() with at least five words of which three tenths or more lie in repeated runs of four."""
    return measures.where((F.col("n_words") >= MIN_WORDS) & (F.col(f"repeated_words_{RUN}") * 10 >= F.col("n_words") * SHARE_TENTHS))


def with_shares(measures: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """The measures as shares, rounded to 6 digits; 0 for a text without words."""
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return measures.select(
        measures.columns[0],
        "n_words",
        *(share(f"repeated_words_{k}", "n_words").alias(f"word_share_{k}") for k in lengths),
        *(share(f"repeated_chars_{k}", "n_word_chars").alias(f"char_share_{k}") for k in lengths),
        share("repeated_line_chars", "n_word_chars").alias("line_share"),
    )
