"""Problem 1: the same or nearly the same record in an evaluation set and in a training split.

Both kinds of overlap come from selected minima of rolling hashes. Texts that are the same letter by letter may be cut
into words differently, so their seeds are runs of letters: one window over the whole text, its least hash, extended to
both ends. Texts that are nearly the same share a run of two words and need not share more, so their window keeps every
run of two words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harfgah.llm.arrow import map_batches, pieces
from harfgah.llm.blocks import BLOCK_ROWS, blocks, expand, found_in, result_names, runs_of
from harfgah.llm.text import Words, spans_hash

#: Near: the evaluation text has so many words, and the common sequence is at least 3/4 of the longer text.
LEAST_WORDS, PART, OF = 5, 3, 4
#: Two such texts always share a run of this many words: with n words in the longer and m in the shorter one, L of them
#: common, there are at most n + m - 2L + 1 runs of L words together, and L >= 3n/4 with n >= 5 leaves no room for all
#: of them to be single words.
SHARED_RUN = 2
#: Words of a fingerprint, and the window that keeps one minimum for every shared run: run = window + words - 1.
SEED = 2
#: Letters of a seed for texts that are the same.
LETTERS = 8
WINDOW = SHARED_RUN - SEED + 1


def winnowed(hashes: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Places of the selected hashes: the least of each window of neighbours of one text, the last of equal ones.

    Any run that two texts share and that is window + seed - 1 words long has a selected hash in both.
    """
    if window == 1:
        return np.arange(len(hashes))
    keep = set()
    edge = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        for i in range(a, max(a + 1, b - window + 1)):
            part = hashes[i : min(b, i + window)]
            keep.add(i + len(part) - 1 - int(np.argmin(part[::-1])))
    return np.array(sorted(keep), np.int64)


def chained(text_at: list[int], eval_at: list[int]) -> int:
    """Words covered by the longest chain of seeds whose places rise in both texts; seeds come by text place, then eval place falling."""
    ends: list[int] = []
    back, tops = [], []
    for i, e in enumerate(eval_at):
        k = bisect_left(ends, e)
        if k == len(ends):
            ends.append(e)
            tops.append(i)
        else:
            ends[k], tops[k] = e, i
        back.append(tops[k - 1] if k else -1)
    covered, i, next_text, next_eval = 0, tops[-1], 1 << 60, 1 << 60
    while i >= 0:
        covered += min(SEED, next_text - text_at[i], next_eval - eval_at[i])
        next_text, next_eval, i = text_at[i], eval_at[i], back[i]
    return covered


class Side:
    """The evaluation texts of one field: a seed of letters of each different text, seeds of words of the longer ones."""

    def __init__(self, texts: list[str | None]) -> None:
        w = Words(texts)
        a, edge = w.letters
        by_key: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(np.diff(edge)).tolist():
            by_key.setdefault(a[edge[i] : edge[i + 1]].tobytes(), []).append(i)
        least = w.least_gram(LETTERS)
        order = sorted(by_key, key=lambda k: least[by_key[k][0]])
        self.key, self.key_rows = order, [np.array(by_key[k]) for k in order]
        self.key_size = np.array([len(k) // 4 for k in order], np.int64)
        self.letter_seed, self.letter_begin, self.letter_count = np.unique(np.array([least[by_key[k][0]] for k in order], np.uint64), return_index=True, return_counts=True)
        by_words: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(w.size >= LEAST_WORDS).tolist():
            by_words.setdefault(w.hash[w.first[i] : w.first[i] + w.size[i]].tobytes(), []).append(i)
        self.rows = [np.array(x) for x in by_words.values()]
        one = np.array([x[0] for x in self.rows], np.int64)
        self.words = [np.frombuffer(x, np.uint64).tolist() for x in by_words]
        self.size = w.size[one]
        passage, start = runs_of(w.first[one], self.size, SEED)
        seeds = spans_hash(w.hash, start, start + SEED)
        keep = winnowed(seeds, passage, WINDOW)
        keep = keep[np.argsort(seeds[keep], kind="stable")]
        self.seed, self.begin, self.count = np.unique(seeds[keep], return_index=True, return_counts=True)
        self.passage, self.at = passage[keep], (start - w.first[one][passage])[keep]
        self.masks: dict[int, dict[int, int]] = {}

    def common(self, passage: int, words: list[int]) -> int:
        """The longest sequence of words in the same order, gaps allowed: one bit of a number for each evaluation word."""
        if not (masks := self.masks.get(passage)):
            masks = self.masks[passage] = {}
            for i, x in enumerate(self.words[passage]):
                masks[x] = masks.get(x, 0) | 1 << i
        full = (1 << len(self.words[passage])) - 1
        v = full
        for x in words:
            if m := masks.get(x):
                u = v & m
                v = ((v + u) | (v - u)) & full
        return len(self.words[passage]) - v.bit_count()

    def same(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Texts with the same letters and digits as an evaluation text: number of the text, number of the row.

        The selected seeds are joined; where both texts are of one length, the seed is extended to all of both.
        """
        a, edge = w.letters
        hit, at = found_in(self.letter_seed, w.least_gram(LETTERS))
        of, place = expand(self.letter_begin[at], self.letter_count[at])
        text = hit[of]
        fits = np.diff(edge)[text] == self.key_size[place]
        got = [(t, k) for t, k in zip(text[fits].tolist(), place[fits].tolist(), strict=True) if a[edge[t] : edge[t + 1]].tobytes() == self.key[k]]
        n = np.array([len(self.key_rows[k]) for _, k in got], np.int64)
        return np.repeat(np.array([t for t, _ in got], np.int64), n), np.concatenate([self.key_rows[k] for _, k in got]) if got else np.zeros(0, np.int64)

    def near(self, w: Words, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts with a common sequence of 3/4 of the longer one: number of the text, of the row, and common words.

        Without exact, the words are those of the seed chain where that is already enough.
        """
        able = np.flatnonzero(w.size >= max(SEED, LEAST_WORDS * PART // OF))
        text, start = runs_of(w.first[able], w.size[able], SEED)
        seeds = spans_hash(w.hash, start, start + SEED)
        keep = winnowed(seeds, text, WINDOW)
        text, start = able[text[keep]], start[keep]
        hit, at = found_in(self.seed, seeds[keep])
        of, place = expand(self.begin[at], self.count[at])
        text, text_at, passage, eval_at = text[hit[of]], start[hit[of]], self.passage[place], self.at[place]
        n, m = w.size[text], self.size[passage]
        fits = PART * np.maximum(n, m) <= OF * np.minimum(n, m)
        text, text_at, passage, eval_at = text[fits], text_at[fits], passage[fits], eval_at[fits]
        order = np.lexsort((-eval_at, text_at, passage, text))
        text, text_at, passage, eval_at = text[order], text_at[order], passage[order], eval_at[order]
        edge = np.flatnonzero(np.diff(text, prepend=-1).astype(bool) | np.diff(passage, prepend=-1).astype(bool))
        seeds_shared = np.diff(np.append(edge, len(text)))
        n, m = w.size[text[edge]], self.size[passage[edge]]
        need = -(-PART * np.maximum(n, m) // OF)
        # need common words in at most n + m - 2 need + 1 runs: the others follow one another
        enough = seeds_shared >= np.maximum(1, 3 * need - n - m - 1)
        got: list[tuple[int, int, int]] = []
        for a, k, want in zip(edge[enough].tolist(), seeds_shared[enough].tolist(), need[enough].tolist(), strict=True):
            t, p = int(text[a]), int(passage[a])
            score = chained(text_at[a : a + k].tolist(), eval_at[a : a + k].tolist())
            if exact or score < want:
                score = self.common(p, w.hash[w.first[t] : w.first[t] + w.size[t]].tolist())
            if score >= want:
                got += ((t, r, score) for r in self.rows[p].tolist())
        return tuple(np.array(x, np.int64) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3


def overlaps(evals: DataFrame, corpus: DataFrame, sides: dict[str, str], eval_key: str, key: str, carry: tuple[str, ...] = (), exact: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of an evaluation row and a corpus row that are the same or nearly the same on at least one side.

    sides: evaluation field to corpus field. One row a pair: eval_key, key, the carried corpus columns, side (of the
    best overlap), same, common_words, longer_words, coverage. Winnowing fingerprints of the evaluation rows are
    indexed in blocks of a checked size; each block is one scan of the corpus without any shuffle, so a text that a
    third of all rows repeat costs no more than any other. Seeds are chained, and extended by an alignment where the
    chain isn't enough (exact: always). Null, empty and wordless texts match nothing; repeated rows come out each.
    """
    names = list(sides)
    ids = evals.schema[eval_key].dataType.simpleString()
    fields = {f.name: f.dataType.simpleString() for f in corpus.schema.fields}
    schema = ", ".join([f"eval_key {ids}", f"key {fields[key]}", *(f"carry_{i} {fields[c]}" for i, c in enumerate(carry)), "side string, same boolean, common_words int, longer_words int, coverage double"])
    rows = corpus.select(F.col(key).alias("key"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)), *(F.col(sides[s]).alias(f"side_{i}") for i, s in enumerate(names)))
    picked = evals.select(F.col(eval_key).alias("eval_key"), *(F.col(s).alias(f"side_{i}") for i, s in enumerate(names)))
    out = []
    for block in blocks(picked, "eval_key", picked.columns[1:], block_rows):
        index = [Side([r[f"side_{i}"] for r in block]) for i in range(len(names))]
        share = corpus.sparkSession.sparkContext.broadcast((index, [r["eval_key"] for r in block], [Words([r[f"side_{i}"] for r in block]).size for i in range(len(names))]))

        def work(batch: pa.RecordBatch, share=share) -> Iterator[pa.RecordBatch]:
            index, eval_ids, eval_size = share.value
            columns = [batch.column(1 + len(carry) + i).to_pylist() for i in range(len(names))]
            longest = [max((c[i] or "" for c in columns), key=len) for i in range(batch.num_rows)]
            for a, b in pieces(longest):
                found = []
                for i, side in enumerate(index):
                    w = Words(columns[i][a:b])
                    t, r = side.same(w)
                    size = np.maximum(w.size[t], eval_size[i][r])
                    found.append((t, r, np.full(len(t), i), np.ones(len(t), bool), size, size))
                    t, r, n = side.near(w, exact)
                    found.append((t, r, np.full(len(t), i), np.zeros(len(t), bool), n, np.maximum(w.size[t], eval_size[i][r])))
                t, r, i, same, n, longer = map(np.concatenate, zip(*found, strict=True))
                share_of = n / np.maximum(longer, 1)
                order = np.lexsort((i, ~same, -share_of, r, t))
                order = order[np.diff(t[order], prepend=-1).astype(bool) | np.diff(r[order], prepend=-1).astype(bool)]
                t, r, i, same, n, longer, share_of = (x[order] for x in (t, r, i, same, n, longer, share_of))
                left = pa.RecordBatch.from_arrays(batch.columns[: 1 + len(carry)], names=batch.schema.names[: 1 + len(carry)]).take(pa.array(t + a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([eval_ids[x] for x in r.tolist()], pa.string() if ids == "string" else None), *left.columns, pa.array([names[x] for x in i.tolist()], pa.string()), pa.array(same), pa.array(n.astype(np.int32)), pa.array(longer.astype(np.int32)), pa.array(share_of)],
                    names=["eval_key", *left.schema.names, "side", "same", "common_words", "longer_words", "coverage"],
                )

        out.append(map_batches(rows, work, schema))
    return reduce(DataFrame.unionByName, out).withColumnsRenamed(result_names(eval_key, key, carry, ["side", "same", "common_words", "longer_words", "coverage"]))
