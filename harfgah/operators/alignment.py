"""Edit distances and alignments of word sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One symbol for each different word of a pair. A pair of more different words stops the query; aligned() takes any.
SYMBOLS = "".join(map(chr, (*range(0x4E00, 0xA000), *range(0x3400, 0x4DC0))))


def word_errors(ref: Column, hyp: Column) -> Column:
    """Edit distance in words, at most the reference's length: words are recoded as symbols of their pair, so that the
    built-in distance of strings serves. An empty reference has no errors; a null side gives null."""
    words = F.array_distinct(F.concat(ref, hyp))
    known = F.when(F.size(words) <= len(SYMBOLS), words).otherwise(F.raise_error(F.lit(f"more than {len(SYMBOLS)} different words: use aligned()")).cast("array<string>"))
    coded = lambda w: F.array_join(F.transform(w, lambda x: F.lit(SYMBOLS).substr(F.array_position(known, x).cast("int"), F.lit(1))), "")
    return F.least(F.levenshtein(coded(ref), coded(hyp)), F.size(ref))


def char_error_rate(ref: Column, hyp: Column) -> Column:
    """Edit distance in characters over the reference's length; an empty reference gives 0 or 1."""
    return F.when(F.length(ref) == 0, (F.length(hyp) > 0).cast("double")).otherwise(F.levenshtein(ref, hyp) / F.length(ref))


def distances(a: list[str], b: list[str]) -> list[list[int]]:
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        above, row = rows[-1], [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        rows.append(row)
    return rows


def mismatches(ref: list[str], hyp: list[str]) -> list[tuple[int, int, int, int, int]]:
    """Runs of words that don't match in a least alignment: (ref start, ref end, hyp start, hyp end, cost).

    Going back from the end, a match is taken before a substitution, that before a deletion, that before an insertion.
    """
    d = distances(ref, hyp)
    i, j, steps = len(ref), len(hyp), []
    while i or j:
        here = d[i][j]
        if i and j and ref[i - 1] == hyp[j - 1] and here == d[i - 1][j - 1]:
            i, j = i - 1, j - 1
            steps.append(None)
        elif i and j and here == d[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            steps.append((i, i + 1, j, j + 1))
        elif i and here == d[i - 1][j] + 1:
            i -= 1
            steps.append((i, i + 1, j, j))
        else:
            j -= 1
            steps.append((i, i, j, j + 1))
    runs: list[tuple[int, int, int, int, int]] = []
    fresh = True
    for step in reversed(steps):
        if step is None:
            fresh = True
        elif fresh:
            runs.append((*step, 1))
            fresh = False
        else:
            a, _, c, _, cost = runs[-1]
            runs[-1] = (a, step[1], c, step[3], cost + 1)
    return runs


def as_one(solid: str, words: list[str]) -> bool:
    """Could these words be written as the one solid word; به and چه lose their he when joined."""
    joined = "".join(words)
    return solid == joined or (len(words) > 1 and words[0] in ("به", "چه") and solid == words[0][0] + joined[2:])


def joining_errors(ref: list[str], hyp: list[str], most: int = 3) -> int:
    """Edit distance in words where one word and the two or three that it is made of are no error; at most the reference's length."""
    d = [[0] * (len(hyp) + 1) for _ in range(len(ref) + 1)]
    for i in range(len(ref) + 1):
        for j in range(len(hyp) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            ways = [d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1])]
            for k in range(2, most + 1):
                if j >= k and as_one(ref[i - 1], hyp[j - k : j]):
                    ways.append(d[i - 1][j - k])
                if i >= k and as_one(hyp[j - 1], ref[i - k : i]):
                    ways.append(d[i - k][j - 1])
            d[i][j] = min(ways)
    return min(d[-1][-1], len(ref))


def aligned(df: DataFrame, key: str, ref: str, hyp: str) -> DataFrame:
    """key, n_ref, joined_errors, runs: both word arrays aligned in Arrow batches. A null side counts as no words."""
    kind = df.schema[key].dataType.simpleString()
    run = "array<struct<ref_start:int,ref_end:int,hyp_start:int,hyp_end:int,cost:int>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ref_start", "ref_end", "hyp_start", "hyp_end", "cost"]
        shape = pa.list_(pa.struct([(n, pa.int32()) for n in names]))
        for batch in batches:
            pairs = [(a or [], b or []) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            runs = [[dict(zip(names, r, strict=True)) for r in mismatches(a, b)] for a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(a) for a, _ in pairs], pa.int32()), pa.array([joining_errors(a, b) for a, b in pairs], pa.int32()), pa.array(runs, shape)], names=["key", "n_ref", "joined_errors", "runs"])

    return df.select(F.col(key).alias("key"), F.col(ref).alias("ref"), F.col(hyp).alias("hyp")).mapInArrow(work, f"key {kind}, n_ref int, joined_errors int, runs {run}").withColumnRenamed("key", key)
