"""Problem 7: encoding of the whole corpus with a public byte-level BPE tokenizer.

The tokenizer's rules split a text into pieces (words with the blank before them, digits, signs, blanks); each different
piece of a batch is encoded once, by a recursive DuckDB query inside the Spark task, and remembered; an ordered
aggregation in the task decodes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harfgah.llm.arrow import map_batches, pieces

#: Folder of the public tokenizers' files.
FOLDER = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k"
#: Fixed value: how this family of tokenizers splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rounds of one query; pieces that aren't done by then go on in the next one, from the tokens that they have.
ROUNDS_A_QUERY = 48
PIECES_A_QUERY = 20_000
#: Remembered pieces of a worker; beyond it, it starts anew.
REMEMBERED = 200_000
#: Ids of a null and of an empty text.
NOTHING: tuple[int, ...] = ()

#: A round contracts in each piece the pair of least rank. live: the piece may have more pairs. CHOSEN: all its places from
#: the left that don't overlap, where every merge of a token has a higher rank than those that make it (then no pair with
#: the new token can come before the other places); the leftmost place only, where that doesn't hold.
ENCODE = """
with recursive round(n, w, pos, tok, live) as (
    select 0, w, pos, tok, true from start
  union all
    (with pairs as (
        select n, w, pos, tok, lead(tok) over in_piece as after from round where n < ROUNDS and live window in_piece as (partition by w order by pos)
     ), ranked as (
        select p.*, m.made, m.rank, min(m.rank) over (partition by p.w) as least from pairs p left join merges m on m.left_tok = p.tok and m.right_tok = p.after
     ), runs as (
        select *, rank = least as hit, pos - row_number() over (partition by w, rank = least order by pos) as run from (
          select n, w, row_number() over (partition by w order by pos) as pos, tok, made, rank, least from ranked)
     ), placed as (
        select *, coalesce(hit, false) and CHOSEN as starts from runs
     ), gone as (
        select *, coalesce(lag(starts) over (partition by w order by pos), false) as taken from placed
     )
     select n + 1, w, pos, case when starts then made else tok end, least is not null from gone where not taken)
), final as (
    select w, max(n) as n from round group by w
)
select r.w, list(r.tok order by r.pos) as ids, bool_and(r.live) as live from round r join final f on f.w = r.w and f.n = r.n group by r.w order by r.w
"""
TOGETHER = "(row_number() over (partition by w, hit, run order by pos) % 2 = 1)"
LEFTMOST = "(row_number() over (partition by w, hit order by pos) = 1)"
#: Bytes of all ids in the order of their places, put together.
DECODE = "select t.doc, string_agg(v.letters, '' order by t.pos) as letters from tokens t join vocabulary v on v.id = t.id group by t.doc order by t.doc"


def byte_letters() -> list[str]:
    """The letter by which the vocabulary file writes each byte: itself if it is printable, else the next letter from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class Bpe:
    """One tokenizer in one Python worker."""

    def __init__(self, name: str = TOKENIZER, folder: str = FOLDER) -> None:
        import duckdb

        with open(f"{folder}/{name}.json", encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte = np.array([vocab[c] for c in byte_letters()], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = ([vocab[x] for x in column] for column in zip(*((a, b, a + b) for a, b in pairs), strict=True))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        merges = pa.table({"left_tok": pa.array(left, pa.int32()), "right_tok": pa.array(right, pa.int32()), "made": pa.array(made, pa.int32()), "rank": pa.array(range(len(left)), pa.int64())})
        self.db.register("given", merges)
        self.db.execute("create table merges as select * from given")
        self.db.unregister("given")
        made_last = dict(zip(made, range(len(made)), strict=True))
        together = all(made_last.get(a, -1) < r and made_last.get(b, -1) < r for r, (a, b) in enumerate(zip(left, right, strict=True)))
        self.encode_sql = ENCODE.replace("ROUNDS", str(ROUNDS_A_QUERY)).replace("CHOSEN", TOGETHER if together else LEFTMOST)
        letters = pa.table({"id": pa.array(list(vocab.values()), pa.int32()), "letters": pa.array(list(vocab), pa.string())})
        self.db.register("given", letters)
        self.db.execute("create table vocabulary as select * from given")
        self.db.unregister("given")
        self.letter = {ord(c): b for b, c in enumerate(byte_letters())}
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge_all(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Pieces together, by rounds that contract each one's pair of least rank until none is left."""
        out: list[tuple[int, ...]] = [()] * len(words)
        todo = [(i, self.byte[np.frombuffer(x, np.uint8)]) for i, x in enumerate(words)]
        while todo:
            size = np.fromiter((len(t) for _, t in todo), np.int64, len(todo))
            w = np.repeat(np.arange(len(todo)), size)
            pos = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
            start = pa.table({"w": pa.array(w, pa.int32()), "pos": pa.array(pos, pa.int64()), "tok": pa.array(np.concatenate([t for _, t in todo]), pa.int32())})
            self.db.register("start", start)
            got = self.db.sql(self.encode_sql).to_arrow_table()
            self.db.unregister("start")
            left = []
            for k, ids, live in zip(*(got.column(c).to_pylist() for c in ("w", "ids", "live")), strict=True):
                if live:
                    left.append((todo[k][0], np.array(ids, np.int32)))
                else:
                    out[todo[k][0]] = tuple(ids)
            todo = left
        return out

    def learn(self, words: set[str]) -> None:
        """Encode the pieces that aren't known yet."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        data = {x: x.encode("utf-8", "replace") for x in words if x not in self.known}
        new = list(data)
        for i in range(0, len(new), PIECES_A_QUERY):
            part = new[i : i + PIECES_A_QUERY]
            self.known.update(zip(part, self.merge_all([data[x] for x in part]), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each has."""
        words = [self.split(t) if t else () for t in texts]
        self.learn(set(chain.from_iterable(words)))
        get = self.known.__getitem__
        size = {x: len(self.known[x]) for x in set(chain.from_iterable(words))}.__getitem__
        n = np.fromiter((sum(map(size, ws)) for ws in words), np.int64, len(words))
        return np.fromiter(chain.from_iterable(map(get, chain.from_iterable(words))), np.int32, int(n.sum())), n


    def decode(self, ids: list[list[int] | None]) -> list[str | None]:
        """The texts of lists of ids; bytes that are no text become the replacement character, None stays None."""
        size = np.fromiter((len(x or ()) for x in ids), np.int64, len(ids))
        doc = np.repeat(np.arange(len(ids)), size)
        flat = np.fromiter(chain.from_iterable(x or () for x in ids), np.int32, len(doc))
        self.db.register("tokens", pa.table({"doc": pa.array(doc, pa.int32()), "pos": pa.array(np.arange(len(doc)), pa.int64()), "id": pa.array(flat)}))
        out = [None if x is None else "" for x in ids]
        for k, letters in self.db.sql(DECODE).fetchall():
            out[k] = bytes(self.letter[ord(c)] for c in letters).decode("utf-8", "replace")
        self.db.unregister("tokens")
        return out


@cache
def loaded(name: str, folder: str) -> Bpe:
    """Once for each Python worker."""
    return Bpe(name, folder)


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = TOKENIZER, folder: str = FOLDER, ids: bool = True) -> DataFrame:
    """key and ids (a list of integers) of each text, without special tokens: their spellings in a text are ordinary text.

    A null or empty text has the empty list. With ids=False the number of ids, n_tokens, instead. No shuffle; extra
    columns are left out. Memory depends on the pieces of a batch, not on its length; a text is never cut.
    """
    kind = df.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe, texts = loaded(name, folder), batch.column(1).to_pylist()
        for a, b in pieces(texts, 1_000_000):
            values, n = bpe.encode(texts[a:b])
            made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values)) if ids else pa.array(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), made], names=["key", "made"])

    out = map_batches(df.select(F.col(key).alias("key"), F.col(text).alias("text")), work, f"key {kind}, made {'array<int>' if ids else 'long'}")
    return out.withColumnsRenamed({"key": key, "made": "ids" if ids else "n_tokens"})


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = TOKENIZER, folder: str = FOLDER) -> DataFrame:
    """key and text of each list of ids, by an ordered aggregation of the ids' letters in the task; a null list has a null text."""
    kind = df.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = loaded(name, folder)
        column = batch.column(1)
        start = 0
        while start < batch.num_rows:
            size, end = 0, start
            while end < batch.num_rows and size < 500_000:
                size, end = size + len(column[end]) if column[end].is_valid else size, end + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(bpe.decode(column.slice(start, end - start).to_pylist()), pa.string())], names=["key", "text"])
            start = end

    return map_batches(df.select(F.col(key).alias("key"), F.col(ids).alias("ids")), work, f"key {kind}, text string").withColumnRenamed("key", key)
