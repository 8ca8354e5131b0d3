"""Problem 2: records that differ only in formatting or field order, collapsed into one."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harfgah.llm.arrow import map_batches, pieces
from harfgah.llm.text import Words
from harfgah.operators.skew import hot_keys, salted_join
from harfgah.session import cut, scratch

FIELDS = ("latin", "persian")


def stirred(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, so that sums of them keep apart."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def multiset_hash(values: dict[str, np.ndarray], lane: int) -> np.ndarray:
    """The sum of a hash of each pair of a field's name and its value; a value of 0 (no letters or digits) adds nothing.

    A sum doesn't depend on the order of the fields, so they are never sorted.
    """
    out = 0
    for name, h in values.items():
        of_name = np.uint64(int.from_bytes(f"{lane}{name}".encode()[:8].ljust(8, b"\0"), "little"))
        out = out + np.where(h == 0, np.uint64(0), stirred(h * np.uint64(2 * lane + 1) + stirred(np.array([of_name]))))
    return out


def loaded(payload: str | None, names: tuple[str, ...]) -> dict | None:
    """The fields of a JSON line; None unless it is one whole JSON object. A field that isn't text counts as missing."""
    try:
        got = json.loads(payload) if payload else None
    except ValueError:
        return None
    return {k: got[k] if isinstance(got.get(k), str) else None for k in names} if isinstance(got, dict) else None


def fingerprints(records: DataFrame, key: str, fields: tuple[str, ...] = FIELDS, payload: str | None = None) -> DataFrame:
    """key, two 64-bit lanes of the record's multiset hash, and of each field its letters and digits in folded form.

    Where payload isn't null the fields are those of that JSON line. Records without any letter or digit, and cut-off
    lines, are left out.
    """
    kind = records.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = [batch.column(1 + i).to_pylist() for i in range(len(fields))]
        keep = np.ones(batch.num_rows, bool)
        if payload:
            for i, line in enumerate(batch.column(1 + len(fields)).to_pylist()):
                if line is not None:
                    got = loaded(line, fields)
                    keep[i] = got is not None
                    for column, name in zip(columns, fields, strict=True):
                        column[i] = got and got[name]
        longest = [max((c[i] or "" for c in columns), key=len) for i in range(batch.num_rows)]
        for a, b in pieces(longest):
            words = {name: Words(c[a:b]) for name, c in zip(fields, columns, strict=True)}
            texts = {name: w.keys() for name, w in words.items()}
            lanes = [multiset_hash({name: w.key_hash(lane) for name, w in words.items()}, lane) for lane in (1, 2)]
            some = keep[a:b] & np.any([w.size > 0 for w in words.values()], axis=0)
            out = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x.view(np.int64)) for x in lanes), *(pa.array(texts[name]) for name in fields)], names=["key", "h1", "h2", *fields])
            yield out.filter(pa.array(some))

    columns = [F.col(key).alias("key"), *fields, *([payload] if payload else [])]
    out = map_batches(records.select(*columns), work, f"key {kind}, h1 long, h2 long, " + ", ".join(f"{x} string" for x in fields))
    return out.withColumnRenamed("key", key)


class Collapsed:
    """Groups and copies of records that are the same but for formatting and field order; each is planned when it is asked for.

    Grouping hashes on the fingerprint and compares the fields, so records with equal fingerprints but different fields
    stay apart. Null and empty fields are the same. A key that comes twice is one record twice.
    """

    def __init__(self, records: DataFrame, key: str, fields: tuple[str, ...] = FIELDS, payload: str | None = None) -> None:
        self.prints, self.key, self.fields = fingerprints(records, key, fields, payload), key, fields

    def groups(self) -> DataFrame:
        """first_id (the smallest key of each group), n_copies and the folded fields: one shuffle, counts combined before it."""
        return self.prints.groupBy("h1", "h2", *self.fields).agg(F.min(self.key).alias("first_id"), F.count("*").alias("n_copies")).select("first_id", "n_copies", *self.fields)

    def copies(self) -> DataFrame:
        """first_id with each other key of its group.

        Fingerprints alone are grouped, counts combined before the shuffle. Records of a fingerprint that came twice are
        then hashed to their group's first record, hot groups being split, and their fields held against its fields.
        Nothing is sorted. Fields that differ under one fingerprint are grouped anew by the fields.
        """
        key, fields, on = self.key, list(self.fields), ["h1", "h2"]
        path = scratch(self.prints.sparkSession, "fingerprints")
        self.prints.write.parquet(path)
        rows = self.prints.sparkSession.read.schema(self.prints.schema).parquet(path)
        several = cut(rows.groupBy(*on).agg(F.min(key).alias("first_id"), F.count("*").alias("n_copies")).where("n_copies > 1"))
        hot = hot_keys(several, on, "n_copies")
        members = salted_join(rows, several.drop("n_copies").hint("shuffle_hash"), on, hot)
        # always true, but a row number keeps the condition above the join: made a key of the join, it would shuffle the records once more
        first = members.where(F.when(F.monotonically_increasing_id() >= 0, F.col(key).eqNullSafe(F.col("first_id")))).select(*on, F.struct(*fields).alias("first")).distinct()
        same = F.struct(*fields) == F.col("first")
        held = salted_join(members, first.hint("shuffle_hash"), on, hot).where(~same | (F.col(key) != F.col("first_id")))
        held = cut(held.select(key, F.when(same, F.col("first_id")).alias("first_id"), *(F.when(~same, F.col(x)).alias(x) for x in [*on, *fields])))
        found = held.where("first_id is not null").select("first_id", key)
        other = held.where("first_id is null").drop("first_id")
        if other.isEmpty():
            return found
        anew = other.groupBy(*on, *fields).agg(F.min(key).alias("first_id"))
        return found.unionByName(other.join(anew, [*on, *fields]).where(F.col(key) != F.col("first_id")).select("first_id", key))


def collapse(records: DataFrame, key: str, fields: tuple[str, ...] = FIELDS, payload: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups and copies; see Collapsed."""
    c = Collapsed(records, key, fields, payload)
    return c.groups(), c.copies()
