"""Pairs meet the records of both their sides in groups of S1 entities, and what follows from both is made there.

A record goes once to each group that has a pair with it, and no pair is shuffled with its records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocking import _ranges, chunk_of, partitions


def gathered(pairs: DataFrame, s1: DataFrame, others: DataFrame, own: list[str]) -> DataFrame:
    """Of each group its entities (kind 0), the others' records (1) and its pairs (2), together and in this order.

    ``s1`` has ``s1_id, country, rec``, ``others`` have ``src, cand_id, rec``.  Pairs may have their group as ``chunk``; their ``own``
    columns go with them.
    """
    if "chunk" in pairs.columns:
        mine = pairs
        left = s1.join(pairs.select("s1_id", "chunk").distinct(), "s1_id").select("chunk", "s1_id", "rec")
    else:
        counts = s1.groupBy("country").agg(F.count("*").alias("n"))
        chunk = chunk_of(F.col("s1_id"), F.col("country"), F.col("n")).alias("chunk")
        left = s1.join(counts, "country").select(chunk, "s1_id", "rec")
        mine = pairs.join(s1.join(counts, "country").select("s1_id", chunk).distinct(), "s1_id")
    mine = mine.select("chunk", "s1_id", "src", "cand_id", F.struct(F.lit(0).alias("_"), *own).alias("own"))
    right = mine.select("chunk", "src", "cand_id").distinct().join(others, ["src", "cand_id"])
    rows = None
    for kind, df in ((0, left), (1, right), (2, mine)):
        df = df.withColumn("kind", F.lit(kind))
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    rows = rows.select("chunk", "kind", "s1_id", "src", "cand_id", "own", "rec").repartition(4 * partitions(pairs), "chunk")  # few groups would else often share a task
    return rows.sortWithinPartitions("chunk", "kind", "s1_id")  # an entity's pairs together: many of them are alike


Table = tuple[pd.DataFrame, pa.Array]


def groups(batches: Iterator[pa.RecordBatch], ready: Callable, work: Callable, least: int = 0) -> Iterator[pa.RecordBatch]:
    """``work(pairs, known)`` for each batch of a group's pairs, with what ``ready(entities, others)`` made of its records.

    A group's pairs wait until there are ``least`` of them, or no more.
    """
    here, sides, known, waiting = None, {0: [], 1: []}, None, []

    def worked() -> Iterator[pa.RecordBatch]:
        for batch in pa.Table.from_batches(waiting).combine_chunks().to_batches() if waiting else []:
            yield from work(batch, known)
        waiting.clear()

    for batch in batches:
        chunks, kinds = batch.column("chunk").to_pylist(), batch.column("kind").to_pylist()
        at = 0
        while at < len(chunks):
            end = at + 1
            while end < len(chunks) and chunks[end] == chunks[at] and kinds[end] == kinds[at]:
                end += 1
            if chunks[at] != here:
                yield from worked()
                here, sides, known = chunks[at], {0: [], 1: []}, None
            if kinds[at] < 2:
                sides[kinds[at]].append(batch.slice(at, end - at))
            elif sides[0] and sides[1]:
                known = known or ready(_side(sides[0], ["s1_id"]), _side(sides[1], ["src", "cand_id"]))
                waiting.append(batch.slice(at, end - at))
                if sum(b.num_rows for b in waiting) >= least:
                    yield from worked()
            at = end
    yield from worked()


def _side(batches: list[pa.RecordBatch], ids: list[str]) -> Table:
    places = pa.Table.from_batches(batches).select(ids).to_pandas()
    places["at"] = range(len(places))
    return places, pa.concat_arrays([b.column("rec") for b in batches])


def met(batch: pa.RecordBatch, left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pair, the entity's record and the other's record of each meeting, the pairs in order."""
    pairs = batch.select(["s1_id", "src", "cand_id"]).to_pandas()
    pairs["pair"] = range(len(pairs))
    both = pairs.merge(left.rename(columns={"at": "one"}), on="s1_id").merge(right.rename(columns={"at": "two"}), on=["src", "cand_id"])
    return both["pair"].to_numpy(), both["one"].to_numpy(), both["two"].to_numpy()


class Lists:
    """Lists of strings of some records as numbers: equal strings have the same number, in all lists that were made together."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, size: int) -> None:
        self.codes, self.lengths, self.size = codes, lengths, size
        self.starts = np.cumsum(lengths) - lengths

    @staticmethod
    def of(*columns: pa.Array) -> tuple[list[Lists], list[str]]:
        """One for each column, and the strings by number."""
        flat = pa.chunked_array([c.flatten() for c in columns]).combine_chunks().dictionary_encode()
        flat = flat if isinstance(flat, pa.DictionaryArray) else flat.combine_chunks()
        codes, out, at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), [], 0
        for c in columns:
            lengths = np.nan_to_num(c.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            out.append(Lists(codes[at : at + lengths.sum()], lengths, len(flat.dictionary)))
            at += lengths.sum()
        return out, flat.dictionary.to_pylist()

    def at(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the elements of the given lists, one list after the other, and for each the list's number in ``rows``."""
        n = self.lengths[rows]
        return _ranges(self.starts[rows], n), np.repeat(np.arange(len(rows)), n)


def shared(left: Lists, right: Lists, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``left``'s lists ``one`` and ``right``'s lists ``two`` have in common: the pair's number, and the places on the left and right.

    Lists have no string twice; what pairs share comes in the order of the lists on the right.
    """
    mine, row = np.unique(one, return_inverse=True)
    places, owner = left.at(mine)
    few, codes = np.unique(left.codes[places], return_inverse=True)
    narrow = np.zeros(left.size, np.int64)  # what no list on the left has is 0
    narrow[few] = np.arange(1, len(few) + 1)
    table = np.zeros(len(mine) * (len(few) + 1), np.int32)
    table[owner * (len(few) + 1) + codes + 1] = places - places.min(initial=0) + 1
    at, pair = right.at(two)
    found = table[row[pair] * (len(few) + 1) + narrow[right.codes[at]]]
    hit = np.flatnonzero(found)
    return pair[hit], found[hit].astype(np.int64) - 1 + places.min(initial=0), at[hit]
