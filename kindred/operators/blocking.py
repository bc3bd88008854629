"""Candidate pairs: records of a country that share keys which are not too common.

Sources are one frame with a ``src`` column (S1 is the deduplicated side).  The
frequency cap is applied to the other side alone, so that a sample of S1 blocks as all
of S1 does, and bounds the fan-out of every S1 key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Blocking


def pairs_of(xs: Column) -> Column:
    """All two-element combinations of an array, in its order."""
    tail = lambda i: F.slice(xs, i + 2, F.greatest(F.size(xs), F.lit(1)))
    return F.flatten(F.transform(xs, lambda a, i: F.transform(tail(i), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def _longest(numbers: Column, n: int) -> Column:
    by_length = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.slice(F.array_sort(numbers, by_length), 1, n)


def token_keys(tokens: Column) -> Column:
    return F.transform(F.filter(tokens, lambda t: F.length(t) >= 3), lambda t: F.concat(F.lit("n:"), t))


def pair_keys(tokens: Column) -> Column:
    return F.transform(pairs_of(F.array_sort(F.array_distinct(F.slice(tokens, 1, 6)))), lambda p: F.concat(F.lit("p:"), p["a"], F.lit(":"), p["b"]))


def compact_keys(compact: Column) -> Column:
    return F.when(F.length(compact) >= 2, F.array(F.concat(F.lit("f:"), compact))).otherwise(F.array().cast("array<string>"))


def skeleton_keys(skeletons: Column) -> Column:
    return F.transform(F.filter(skeletons, lambda t: F.length(t) >= 3), lambda t: F.concat(F.lit("k:"), t))


def prefix_keys(compact: Column) -> Column:
    return F.when(F.length(compact) >= 4, F.array(F.concat(F.lit("c:"), F.left(compact, F.lit(6))))).otherwise(F.array().cast("array<string>"))


def number_word_keys(numbers: Column, words: Column) -> Column:
    long_words = F.slice(F.filter(words, lambda w: F.length(w) >= 3), 1, 8)
    return F.flatten(F.transform(_longest(numbers, 3), lambda x: F.transform(long_words, lambda w: F.concat(F.lit("a:"), x, F.lit(":"), w))))


def number_pair_keys(numbers: Column) -> Column:
    return F.transform(pairs_of(F.array_sort(_longest(numbers, 3))), lambda p: F.concat(F.lit("aa:"), p["a"], F.lit(":"), p["b"]))


def word_pair_keys(words: Column) -> Column:
    return F.transform(pairs_of(F.slice(F.filter(words, lambda w: F.length(w) >= 3), 1, 6)), lambda p: F.concat(F.lit("w:"), p["a"], F.lit(":"), p["b"]))


def _families() -> dict[str, Column]:
    skeletons = F.filter(F.split("n_skel", " "), lambda t: t != "")
    return {
        "name": F.concat(token_keys(F.col("n_tokens")), pair_keys(F.col("n_tokens")), compact_keys(F.col("n_compact")), skeleton_keys(skeletons), prefix_keys(F.col("n_compact"))),
        "addr": F.concat(number_word_keys(F.col("a_numbers"), F.col("a_words")), number_pair_keys(F.col("a_numbers")), word_pair_keys(F.col("a_words"))),
    }


def record_keys(df: DataFrame) -> DataFrame:
    """``entity_id, src, key, family``: a row for each different key of each normalised record."""
    tagged = F.array(*(F.struct(F.lit(family).alias("family"), F.array_distinct(ks).alias("ks")) for family, ks in _families().items()))
    rows = df.select("entity_id", "src", "country", F.explode(tagged).alias("f")).select("entity_id", "src", "country", "f.family", F.explode("f.ks").alias("k"))
    return rows.select("entity_id", "src", F.concat("country", F.lit("|"), "k").alias("key"), "family")


def key_list() -> Column:
    """All different keys of a normalised record."""
    return F.transform(F.array_distinct(F.concat(*_families().values())), lambda k: F.concat("country", F.lit("|"), k))


def key_sizes(keys: DataFrame) -> DataFrame:
    """``src, key, size`` on the other side."""
    return keys.where("src <> 'S1'").groupBy("src", "key").agg(F.count("*").alias("size"))


def usable_keys(keys: DataFrame, cfg: Blocking = Blocking()) -> DataFrame:
    """Key rows of the other side whose key is not too common, with their weight ``w``."""
    good = key_sizes(keys).where(F.col("size") <= cfg.max_block)
    return keys.where("src <> 'S1'").join(good, ["src", "key"]).withColumn("w", F.lit(1.0) / F.pow("size", F.lit(cfg.weight_power)))


def probe_keys(keys: DataFrame, cfg: Blocking = Blocking()) -> DataFrame:
    """S1's key rows that meet a usable key."""
    return keys.where("src = 'S1'").join(usable_keys(keys, cfg).select("key").distinct(), "key", "left_semi")


def scored_pairs(keys: DataFrame, cfg: Blocking = Blocking(), index: DataFrame | None = None) -> DataFrame:
    """``s1_id, src, cand_id, block_name, block_addr, block_score``: the weights of the shared keys, summed.

    ``index`` has the usable keys of the other side where they are known already.
    """
    left = keys.where("src = 'S1'").select("key", F.col("entity_id").alias("s1_id"))
    usable = usable_keys(keys, cfg) if index is None else index
    right = usable.select("key", "src", F.col("entity_id").alias("cand_id"), "family", "w")
    part = lambda family: F.sum(F.when(F.col("family") == family, F.col("w")).otherwise(0.0))
    sums = left.join(right, "key").groupBy("s1_id", "src", "cand_id").agg(part("name").alias("block_name"), part("addr").alias("block_addr"))
    return sums.withColumn("block_score", F.col("block_name") + F.col("block_addr"))


def top_union(pairs: DataFrame, cfg: Blocking = Blocking()) -> DataFrame:
    """Of each S1 entity and source, the best by name, by address and by total; ties go to the smaller id."""
    kept = F.lit(False)
    for score, k in (("block_name", cfg.top_name), ("block_addr", cfg.top_addr), ("block_score", cfg.top_total)):
        # rounded, so that the order does not hang on the order of summing
        rank = F.row_number().over(W.partitionBy("s1_id", "src").orderBy(F.desc(F.round(score, 9)), "cand_id"))
        pairs = pairs.withColumn(f"__{score}", rank)
        kept = kept | ((F.col(f"__{score}") <= k) & (F.col(score) > 0))
    return pairs.where(kept).drop("__block_name", "__block_addr", "__block_score")


#: S1 entities of a country that are blocked together in one task.
CHUNK = 4096
#: Shared keys that are summed at once.
SUMMED = 1 << 20
#: What is dealt out of a key: its family and weight, and S1's and the others' ids.
LISTS = ["name", "w", "s_nums", "s_ids", "c_nums", "c_ids"]
PAIR_SCHEMA = "s1_id string, src string, cand_id string, block_name double, block_addr double, block_score double"


def chunk_of(entity: Column, country: Column, entities: Column, size: int = CHUNK) -> Column:
    """The group of ``size`` or fewer, on average, that an S1 entity is in, of its country's ``entities``; a large country has 16 at least."""
    groups = F.greatest(F.ceil(entities / F.lit(float(size))), F.least(F.lit(16), F.ceil(entities / F.lit(256.0))), F.lit(1)).cast("long")
    return F.concat_ws("|", F.pmod(F.xxhash64(entity), groups).cast("string"), country)


def partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def common_keys(keys: DataFrame, cfg: Blocking = Blocking()) -> DataFrame:
    """``src, key`` of the other side's keys that are too common."""
    return key_sizes(keys).where(F.col("size") > cfg.max_block).select("src", "key")


def _number(entity: Column, src: Column) -> Column:
    """The number n of an id that is ``src-n``, which says all of it; null for any other id."""
    n = F.substr(entity, F.length(src) + 2).try_cast("int")
    return F.when(F.concat(src, F.lit("-"), n.cast("string")) == entity, n)


def _ids(prefix: str, entity: str, where: Column | None = None) -> list[Column]:
    """Lists of the ids of a group: the numbers of those that have one, and the other ids."""
    keep = (lambda c: c) if where is None else (lambda c: F.when(where, c))
    return [F.collect_list(keep(F.col("num"))).alias(f"{prefix}_nums"), F.collect_list(keep(F.when(F.col("num").isNull(), F.col(entity)))).alias(f"{prefix}_ids")]


def _key_lists(keys: DataFrame, cfg: Blocking, index: DataFrame | None, common: DataFrame | None) -> DataFrame:
    """``key, src, name, w, c_nums, c_ids``: the records that share a usable key, with the key's weight; rows of a key are in one partition."""
    named = F.col("family") == "name"
    if index is not None:
        rows = index.select("key", "src", "entity_id", "family", "w", _number(F.col("entity_id"), F.col("src")).alias("num")).repartition("key")
        return rows.groupBy("key", "src", named.alias("name")).agg(F.max("w").alias("w"), *_ids("c", "entity_id"))
    # common keys go before anything moves, so no list is longer than the cap; their number is at most the rows' by the cap
    rows = keys.where("src <> 'S1'").join(common_keys(keys, cfg) if common is None else common, ["src", "key"], "left_anti")
    rows = rows.select("key", "src", named.alias("name"), "entity_id", _number(F.col("entity_id"), F.col("src")).alias("num"))
    rows = rows.select("key", "src", "name", "num", F.when(F.col("num").isNull(), F.col("entity_id")).alias("entity_id")).repartition("key")
    sides = rows.groupBy("key", "src").agg(F.count("*").alias("size"), *_ids("n", "entity_id", F.col("name")), *_ids("a", "entity_id", ~F.col("name")))
    each = [F.struct(F.lit(side == "n").alias("name"), F.col(f"{side}_nums").alias("c_nums"), F.col(f"{side}_ids").alias("c_ids")) for side in "na"]
    lists = sides.withColumn("w", F.lit(1.0) / F.pow("size", F.lit(cfg.weight_power))).select("key", "src", "w", F.explode(F.array(*each)).alias("f"))
    return lists.select("key", "src", "f.name", "w", "f.c_nums", "f.c_ids").where((F.size("c_nums") > 0) | (F.size("c_ids") > 0))


def best_pairs(keys: DataFrame, cfg: Blocking = Blocking(), index: DataFrame | None = None, common: DataFrame | None = None, placed: bool = False) -> DataFrame:
    """What ``top_union`` keeps of ``scored_pairs``, without a shuffle of the pairs.

    S1 goes by in groups of a country's entities.  A task gets, of each key of its group,
    the list of the records that share it, sums the weights and ranks; only what it keeps
    leaves it.  A list is no longer than the cap, and goes to a group once.  Ids of the
    form ``src-n`` travel as n.  ``common`` has the keys over the cap where they are known.
    With ``placed`` the group that a pair was in comes with it, as ``chunk``.
    """
    lists = _key_lists(keys, cfg, index, common)
    # a country may hold the bar that ends it, but then all its keys do
    mine = keys.where("src = 'S1'").select(
        "key", F.col("entity_id").alias("s1_id"), F.split_part("key", F.lit("|"), F.lit(1)).alias("country"), _number(F.col("entity_id"), F.col("src")).alias("num"))
    counts = mine.groupBy("country").agg(F.approx_count_distinct("s1_id").alias("n"))
    grouped = mine.join(counts, "country").withColumn("chunk", chunk_of(F.col("s1_id"), F.col("country"), F.col("n")))
    grouped = grouped.select("key", "chunk", "num", F.when(F.col("num").isNull(), F.col("s1_id")).alias("s1_id")).repartition("key")
    met = grouped.groupBy("key", "chunk").agg(*_ids("s", "s1_id")).join(lists, "key")
    dealt = met.select("chunk", "src", *LISTS).repartition(partitions(keys), "chunk")
    return dealt.sortWithinPartitions("chunk", "src").mapInArrow(lambda batches: _best(batches, cfg, placed), PAIR_SCHEMA + (", chunk string" if placed else ""))


def _best(batches: Iterator[pa.RecordBatch], cfg: Blocking, placed: bool = False) -> Iterator[pa.RecordBatch]:
    """The kept pairs of each group and source; rows of a group and source come together."""
    known, parts = None, []
    for batch in batches:
        chunks, srcs = batch.column("chunk").to_pylist(), batch.column("src").to_pylist()
        at = 0
        while at < len(chunks):
            end, here = at + 1, (chunks[at], srcs[at])
            while end < len(chunks) and chunks[end] == here[0] and srcs[end] == here[1]:
                end += 1
            if here != known and parts:
                yield from _kept(parts, known[1], cfg, known[0] if placed else None)
                parts = []
            known = here
            parts.append(batch.slice(at, end - at).select(LISTS))
            at = end
    if parts:
        yield from _kept(parts, known[1], cfg, known[0] if placed else None)


def _flat(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    lists = lists.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten(), np.diff(lists.offsets.to_numpy())


def _coded(nums: pa.ChunkedArray, ids: pa.ChunkedArray, src: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of columns of lists of numbers and of other ids: the different ids in order, the ids' places there, and the lists' lengths."""
    (flat, n), (rest, m) = _flat(nums), _flat(ids)
    some, codes = np.unique(flat.to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
    names = [f"{src}-{x}" for x in some.tolist()]
    if len(rest):
        coded = rest.dictionary_encode()
        codes = np.concatenate([codes, coded.indices.to_numpy(zero_copy_only=False) + len(names)])
        codes = codes[np.argsort(np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)]), kind="stable")]
        names += coded.dictionary.to_pylist()
    names = np.array(names, dtype=object)
    order = np.argsort(names, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return names[order], place[codes], n + m


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _kept(parts: list[pa.RecordBatch], src: str, cfg: Blocking, chunk: str | None = None) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(parts)
    is_name, w = (table.column(c).to_numpy(zero_copy_only=False) for c in ("name", "w"))
    s1_names, s1, n_s1 = _coded(table.column("s_nums"), table.column("s_ids"), "S1")
    cand_names, cand, n_cand = _coded(table.column("c_nums"), table.column("c_ids"), src)
    starts = np.cumsum(n_cand) - n_cand
    row = np.repeat(np.arange(len(n_s1)), n_s1)  # the key of each entity's occurrence
    order = np.argsort(s1, kind="stable")
    s1, row = s1[order], row[order]
    done = np.cumsum(n_cand[row])
    first = np.concatenate([[0], np.flatnonzero(np.diff(s1)) + 1, [len(s1)]])  # of each entity
    total = np.concatenate([[0], done])[first]
    at = 0
    while at < len(first) - 1:
        end = max(at + 1, int(np.searchsorted(total, total[at] + SUMMED, side="right")) - 1)
        mine, keys = s1[first[at] : first[end]], row[first[at] : first[end]]
        lengths = n_cand[keys]
        pair = np.repeat(mine, lengths) * len(cand_names) + cand[_ranges(starts[keys], lengths)]
        weight, named = np.repeat(w[keys], lengths), np.repeat(is_name[keys], lengths)
        pairs, which = np.unique(pair, return_inverse=True)
        name = np.bincount(which, np.where(named, weight, 0.0), len(pairs))
        addr = np.bincount(which, np.where(named, 0.0, weight), len(pairs))
        one, two = np.divmod(pairs, len(cand_names))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(one)) + 1, [len(one)]])
        kept = np.zeros(len(pairs), bool)
        for score, k in ((name, cfg.top_name), (addr, cfg.top_addr), (name + addr, cfg.top_total)):
            rounded = np.round(score, 9)  # so that the order does not hang on the order of summing
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                kept[lo:hi] |= _top(rounded[lo:hi], k) & (score[lo:hi] > 0)
        one, two, name, addr = one[kept], two[kept], name[kept], addr[kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array(s1_names[one], pa.string()), pa.array([src] * len(one), pa.string()), pa.array(cand_names[two], pa.string()), pa.array(name), pa.array(addr), pa.array(name + addr),
             *([] if chunk is None else [pa.array([chunk] * len(one), pa.string())])],
            names=["s1_id", "src", "cand_id", "block_name", "block_addr", "block_score", *([] if chunk is None else ["chunk"])],
        )
        at = end


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Which are the ``k`` largest; of equal ones the first."""
    if len(scores) <= k:
        return np.ones(len(scores), bool)
    if k < 1:
        return np.zeros(len(scores), bool)
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    out = scores > least
    out[np.flatnonzero(scores == least)[: k - int(out.sum())]] = True
    return out


def candidates(records: DataFrame, cfg: Blocking = Blocking()) -> DataFrame:
    return best_pairs(record_keys(records), cfg)
