"""Problem 6: evaluation passages inside training text, by a BM25 index with block-max pruning."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harfgah.llm.arrow import map_batches, pieces
from harfgah.llm.blocks import BLOCK_ROWS, blocks, expand, found_in, result_names, runs_of
from harfgah.llm.text import Words, spans_hash

#: Consecutive words that make a leak.
RUN = 5
#: Words of an index term, and passages of a block.
TERM, BLOCK = 2, 64
K1, B = 1.2, 0.75


class Index:
    """Inverted index of evaluation passages: terms are pairs of neighbouring words, weighted by BM25.

    A passage's threshold is the least score that a text with any five of its consecutive words must have: the least
    sum, over its runs of five words, of the weights of the run's different terms. So all passages above their
    threshold include every true one.
    """

    def __init__(self, rows: list[tuple[int, int, str | None]]) -> None:
        """rows: number of the evaluation row, of its field, text."""
        w = Words([t for _, _, t in rows])
        by_words: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(w.size >= RUN).tolist():
            by_words.setdefault(w.hash[w.first[i] : w.first[i] + w.size[i]].tobytes(), []).append(i)
        one = np.array([x[0] for x in by_words.values()], np.int64)
        self.rows = [np.array([rows[i][:2] for i in x], np.int64) for x in by_words.values()]
        size = w.size[one]
        passage, start = runs_of(w.first[one], size, TERM)
        hashes = spans_hash(w.hash, start, start + TERM)
        self.term, term = np.unique(hashes, return_inverse=True)
        n = max(len(one), 1)
        key, tf = np.unique(term * n + passage, return_counts=True)
        term_of, passage_of = key // n, key % n
        df = np.bincount(term_of, minlength=len(self.term))
        idf = np.log1p((len(one) - df + 0.5) / (df + 0.5))
        length = size - TERM + 1
        norm = K1 * (1 - B + B * length / max(length.mean(), 1) if len(one) else length)
        weight = idf[term_of] * tf * (K1 + 1) / (tf + norm[passage_of])
        # the least score of a true hit
        at = {int(k): float(x) for k, x in zip(key, weight, strict=True)}
        self.least = np.full(len(one), np.inf)
        begin = np.concatenate([[0], np.cumsum(length)])
        for p in range(len(one)):
            own = term[begin[p] : begin[p + 1]].tolist()
            for i in range(len(own) - (RUN - TERM)):
                self.least[p] = min(self.least[p], sum(at[t * n + p] for t in sorted(set(own[i : i + RUN - TERM + 1]))))
        self.least -= 1e-6
        # passages of similar thresholds share a block
        rank = np.empty(len(one), np.int64)
        rank[np.argsort(self.least, kind="stable")] = np.arange(len(one))
        self.of_rank = np.argsort(rank)
        order = np.lexsort((rank[passage_of], term_of))
        term_of, self.posting, self.weight = term_of[order], rank[passage_of][order], weight[order]
        self.least, self.rows = self.least[self.of_rank], [self.rows[i] for i in self.of_rank]
        self.begin = np.searchsorted(term_of, np.arange(len(self.term)))
        self.count = np.diff(np.append(self.begin, len(term_of)))
        self.top = np.maximum.reduceat(self.weight, self.begin) if len(term_of) else np.zeros(0)
        # of each term and block the greatest weight
        pair = term_of * (n // BLOCK + 1) + self.posting // BLOCK
        edge = np.flatnonzero(np.diff(pair, prepend=-1))
        self.block, self.block_top = (self.posting // BLOCK)[edge], np.maximum.reduceat(self.weight, edge) if len(edge) else np.zeros(0)
        self.block_begin = np.searchsorted(term_of[edge], np.arange(len(self.term)))
        self.block_count = np.diff(np.append(self.block_begin, len(edge)))
        self.block_least = np.minimum.reduceat(self.least, np.arange(0, len(one), BLOCK)) if len(one) else np.zeros(0)
        # the runs themselves, for the check
        passage, start = runs_of(w.first[one], size, RUN)
        runs = spans_hash(w.hash, start, start + RUN) * np.uint64(0x9E3779B97F4A7C15) + rank[passage].astype(np.uint64)
        self.run, first = np.unique(runs, return_index=True)
        self.run_words = w.hash[start[first][:, None] + np.arange(RUN)] if len(first) else np.zeros((0, RUN), np.uint64)

    def query(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Texts, and the passages of which they have five consecutive words."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        able = np.flatnonzero(w.size >= RUN)
        text, start = runs_of(w.first[able], w.size[able], TERM)
        hit, term = found_in(self.term, spans_hash(w.hash, start, start + TERM))
        if not len(hit):
            return none
        n = len(self.term)
        key = np.unique(able[text[hit]] * n + term)
        text, term = key // n, key % n
        # could all its terms together reach any threshold?
        bound = np.bincount(text, self.top[term], w.n)
        go = bound[text] >= self.block_least.min()
        text, term = text[go], term[go]
        # block by block
        of, place = expand(self.block_begin[term], self.block_count[term])
        n_blocks = len(self.block_least)
        pair, inverse = np.unique(text[of] * n_blocks + self.block[place], return_inverse=True)
        bound = np.bincount(inverse, self.block_top[place], len(pair))
        pair = pair[bound >= self.block_least[pair % n_blocks]]
        if not len(pair):
            return none
        # exact scores in the blocks that are left
        of, place = expand(self.begin[term], self.count[term])
        left, _ = found_in(pair, text[of] * n_blocks + self.posting[place] // BLOCK)
        of, place = of[left], place[left]
        n_passages = len(self.least)
        pair, inverse = np.unique(text[of] * n_passages + self.posting[place], return_inverse=True)
        score = np.bincount(inverse, self.weight[place], len(pair))
        pair = pair[score >= self.least[pair % n_passages]]
        # five consecutive words in both
        text, passage = pair // n_passages, pair % n_passages
        of, start = runs_of(w.first[text], w.size[text], RUN)
        runs = spans_hash(w.hash, start, start + RUN) * np.uint64(0x9E3779B97F4A7C15) + passage[of].astype(np.uint64)
        hit, at = found_in(self.run, runs)
        true = (w.hash[start[hit][:, None] + np.arange(RUN)] == self.run_words[at]).all(axis=1) if len(hit) else np.zeros(0, bool)
        pair = np.unique(of[hit[true]])
        return text[pair], passage[pair]


def leaks(evals: DataFrame, corpus: DataFrame, fields: list[str], texts: list[str], eval_key: str, key: str, carry: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of an evaluation row and a corpus row, any of whose texts has five consecutive words of one of its fields.

    One row a pair: eval_key, key, carried columns, and for each evaluation field whether it leaked. Every corpus text
    queries the index of the evaluation passages; an index is made for each block of evaluation rows of a checked size,
    and a block is one scan without a shuffle. Texts of fewer than five words, null and empty ones leak nothing.
    """
    ids = evals.schema[eval_key].dataType.simpleString()
    kinds = {f.name: f.dataType.simpleString() for f in corpus.schema.fields}
    schema = ", ".join([f"eval_key {ids}", f"key {kinds[key]}", *(f"carry_{i} {kinds[c]}" for i, c in enumerate(carry)), *(f"leaked_{i} boolean" for i in range(len(fields)))])
    rows = corpus.select(F.col(key).alias("key"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)), *(F.col(t).alias(f"text_{i}") for i, t in enumerate(texts)))
    picked = evals.select(F.col(eval_key).alias("eval_key"), *(F.col(f).alias(f"field_{i}") for i, f in enumerate(fields)))
    out = []
    for block in blocks(picked, "eval_key", picked.columns[1:], block_rows):
        index = Index([(n, i, r[f"field_{i}"]) for n, r in enumerate(block) for i in range(len(fields))])
        share = corpus.sparkSession.sparkContext.broadcast((index, [r["eval_key"] for r in block]))

        def work(batch: pa.RecordBatch, share=share) -> Iterator[pa.RecordBatch]:
            index, eval_ids = share.value
            columns = [batch.column(1 + len(carry) + i).to_pylist() for i in range(len(texts))]
            longest = [max((c[i] or "" for c in columns), key=len) for i in range(batch.num_rows)]
            for a, b in pieces(longest):
                found: list[np.ndarray] = []
                for c in columns:
                    t, p = index.query(Words(c[a:b]))
                    n = np.array([len(index.rows[x]) for x in p.tolist()], np.int64)
                    if len(t):
                        found.append(np.column_stack([np.repeat(t, n), np.concatenate([index.rows[x] for x in p.tolist()])]))
                if not found:
                    continue
                pair = np.unique(np.concatenate(found), axis=0)  # text, row, field
                both, inverse = np.unique(pair[:, :2], axis=0, return_inverse=True)
                leaked = np.zeros((len(both), len(fields)), bool)
                leaked[inverse.ravel(), pair[:, 2]] = True
                left = pa.RecordBatch.from_arrays(batch.columns[: 1 + len(carry)], names=batch.schema.names[: 1 + len(carry)]).take(pa.array(both[:, 0] + a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([eval_ids[x] for x in both[:, 1].tolist()], pa.string() if ids == "string" else None), *left.columns, *(pa.array(leaked[:, i]) for i in range(len(fields)))],
                    names=["eval_key", *left.schema.names, *(f"leaked_{i}" for i in range(len(fields)))],
                )

        out.append(map_batches(rows, work, schema))
    return reduce(DataFrame.unionByName, out).withColumnsRenamed({f"leaked_{i}": f"leaked_{f}" for i, f in enumerate(fields)} | result_names(eval_key, key, carry, [f"leaked_{f}" for f in fields]))
