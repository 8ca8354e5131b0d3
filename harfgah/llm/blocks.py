"""Evaluation rows in blocks of a checked size, and what the corpus scans over them share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block's index is broadcast; beyond either bound the evaluation rows are split into more blocks, one scan each.
BLOCK_ROWS, BLOCK_CHARS = 100_000, 20_000_000


def blocks(evals: DataFrame, key: str, texts: list[str], rows: int = BLOCK_ROWS, chars: int = BLOCK_CHARS) -> Iterator[list]:
    """The evaluation rows, collected a block at a time; no block has (much) more than the bounds, no row is left out."""
    size = sum((F.coalesce(F.length(t), F.lit(0)) for t in texts), F.lit(0))
    n, total = evals.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = max(1, -(-n // rows), -(-total // chars))
    if parts == 1:
        yield evals.collect()
        return
    # half as much on average, as hashing spreads unevenly
    parts *= 2
    for i in range(parts):
        yield evals.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i).collect()


def expand(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of n places from start: the number of the range, and each place."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[of]


def found_in(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted ones, and at what place."""
    if not len(sorted_keys) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    hit = np.flatnonzero(sorted_keys[at] == keys)
    return hit, at[hit]


def runs_of(first: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of k words inside texts that have size words from first: the text of each, and where it starts."""
    return expand(first, np.maximum(size - k + 1, 0))


def result_names(eval_key: str, key: str, carry: tuple[str, ...], own: list[str]) -> dict[str, str]:
    """Names of the result: the evaluation's key gets the prefix eval_ if it is the corpus's too, carried columns corpus_ where they would clash."""
    first = f"eval_{eval_key}" if eval_key == key else eval_key
    taken = {first, key, *own}
    return {"eval_key": first, "key": key, **{f"carry_{i}": f"corpus_{c}" if c in taken else c for i, c in enumerate(carry)}}
