"""Near-duplicate detection: BagMinHash signatures, banding, verified multiset overlap.

Each shingle of a text, with the number of times it stands there, is a Poisson process
over time and weight.  Weight is cut into dyadic intervals ([0,1), [1,2), [2,4), ...),
each with an independent process seeded by the shingle; its points come in order of
time, carry a level inside the interval, and count where the level is under the
shingle's weight.  Each point falls on one component of the signature, which keeps its
earliest point.  Two bags agree in a component with a probability of exactly their
weighted Jaccard similarity.  A text stops making points when all components are filled.

Texts with equal word sequences are collapsed first.  Signatures are cut into bands;
texts that share a band are candidates.  In each band's bucket all members are first
compared with one leader, so that a bucket of n near copies costs n - 1 comparisons.
Buckets of one leader are a group; what is then still in different classes of one group
is compared block by block, except where the signatures agree so rarely that the
similarity can't be reached (by more than four standard deviations) or the bags' sizes
rule it out.  Candidates are verified on whole bags; the links' connected components are
the classes.

A node is one sequence of words, whatever rows have it; its text comes from one of them.
The signatures of a group are compared before any text moves, and only the texts of pairs
whose signatures agree are fetched.

Cases: a null text is empty; all texts without a word are one class.  A class is known
by the smallest doc_id in it, null if all its rows have none; rows without a doc_id are
compared as all others.  Where one doc_id has several texts, each is in its own text's
class, and two classes may then have one id.  Of a class the row with the smallest doc_id
stays; of its rows with that id, the one whose text has the smaller hash, and of rows
alike in both any one.  Rows repeated with one doc_id and text give one row each.  Very
long texts are hashed whole, one batch of texts at a time.  Other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import components, materialize, mix64, small_batches, spread, whole_row

SIMILARITY = 0.8
BANDS, ROWS = 32, 6
#: Four standard deviations under SIMILARITY, for BANDS * ROWS components.
AGREEMENT = 0.685
#: Shingles in a block of a group that is compared block by block, about.
BLOCK_WEIGHT = 400_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def signatures(text: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """``n`` by ``m`` points' times: the signatures of ``n`` bags given as (text, hash, count)."""
    sig = np.full((n, m), np.inf)
    weight = np.bincount(text, weights=count, minlength=n)
    # intervals: the first of all shingles, and the next dyadic ones of repeated shingles
    parts = [(text, h, count, 0)]
    k = 1
    while True:
        more = np.flatnonzero(count > (1 << (k - 1)))
        if not len(more):
            break
        parts.append((text[more], h[more], count[more], k))
        k += 1
    owner = np.concatenate([p[0] for p in parts])
    top = np.concatenate([p[2] for p in parts])
    seed = np.concatenate([mix64(p[1] + np.uint64((p[3] + 1) * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF)) for p in parts])
    low = np.concatenate([np.full(len(p[0]), 0 if p[3] == 0 else 1 << (p[3] - 1), dtype=np.float64) for p in parts])
    width = np.concatenate([np.full(len(p[0]), 1 if p[3] == 0 else 1 << (p[3] - 1), dtype=np.float64) for p in parts])
    until = np.where(weight > 0, (np.log(m) + 3) / np.maximum(weight, 1), 0)
    todo = np.arange(len(owner))
    while len(todo):
        _points(sig, m, owner[todo], top[todo], seed[todo], low[todo], width[todo], until)
        short = np.isinf(sig).any(axis=1) & (weight > 0)
        until[short] *= 2  # and once more from the start: the points are the same
        todo = np.flatnonzero(short[owner])
    return sig


def _points(sig, m, owner, top, seed, low, width, until) -> None:
    flat = sig.reshape(-1)
    last = np.zeros(len(owner))
    made, block = 0, 1
    while len(owner):
        u = mix64(seed[:, None] + (np.arange(made + 1, made + block + 1, dtype=np.uint64) * _GOLDEN)[None, :])
        x = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / (width[:, None] * m)
        x = last[:, None] + np.cumsum(x, axis=1)
        r = mix64(u ^ np.uint64(0x5851F42D4C957F2D))
        level = low[:, None] + (r & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32 * width[:, None]
        good = (x <= until[owner][:, None]) & (level < top[:, None])
        i, j = np.nonzero(good)
        place = ((r[i, j] >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        np.minimum.at(flat, owner[i] * m + place.astype(np.int64), x[i, j])
        goes = np.flatnonzero(x[:, -1] <= until[owner])
        owner, top, seed, low, width, last = owner[goes], top[goes], seed[goes], low[goes], width[goes], x[goes, -1]
        made += block
        block = min(64, block * 4)


PRINT = "doc_id long, t1 long, t2 long, k1 long, k2 long, fresh boolean, weight long, bands array<long>, sig binary"
#: Digests that a task remembers, to make a signature once for the copies it meets.
REMEMBERED = 1 << 18


def _prints(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    m = bands * rows
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        h, first = shingles.word_hashes(batch.column("text").to_pylist())
        k1, k2 = shingles.sequence_keys(h, first)
        n = batch.num_rows
        fresh = np.zeros(n, dtype=bool)
        for i, key in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
            if key not in seen:
                fresh[i] = True
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
        new = np.flatnonzero(fresh)
        if len(new) < n:
            h = np.concatenate([h[:0], *(h[first[i] : first[i + 1]] for i in new)])
            first = np.concatenate([[0], np.cumsum(np.diff(first)[new])]).astype(np.int64)
        text, s, count = shingles.bags(h, first)
        sig = signatures(text, s, count, len(new), m)
        word = mix64(sig.view(np.uint64))
        weight = np.bincount(text, weights=count, minlength=len(new)).astype(np.int64)
        mixed = np.zeros((len(new), bands), dtype=np.uint64)
        for r in range(rows):
            mixed = mix64(mixed * _GOLDEN + word[:, r::rows])
        mixed = mix64(mixed + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _GOLDEN)
        lengths, whole = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        lengths[new], whole[new] = np.where(weight > 0, bands, 0), weight
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()),
            pa.array(mixed.view(np.int64).reshape(-1)[np.repeat(weight > 0, bands)], pa.int64()),
        )
        small = (word >> np.uint64(56)).astype(np.uint8)
        raws: list[bytes | None] = [None] * n
        for i, x in zip(new.tolist(), small, strict=True):
            raws[i] = x.tobytes()
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "t1", "t2")), pa.array(k1), pa.array(k2), pa.array(fresh), pa.array(whole), lists, pa.array(raws, pa.binary())],
            names=[f.split()[0] for f in PRINT.split(", ")],
        )


def _texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id, t1, t2, text``: each row's id, two hashes of its text, and the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), text.alias("text"))


def prints(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row per document: hashes of its text, digests of its words, and where the task meets these words
    first (``fresh``) the bag's weight, bands and signature (8 bits a component)."""
    small_batches(docs.sparkSession)
    return _texts_of(docs).mapInArrow(lambda it: _prints(it, bands, rows), PRINT)


def _verify(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sides = []
        for side in ("text_a", "text_b"):
            texts, which = np.unique(batch[side].fillna("").to_numpy(dtype=object), return_inverse=True) if len(batch) else ([], [])
            h, first = shingles.word_hashes(list(texts))
            text, s, count = shingles.bags(h, first)
            cut = np.searchsorted(text, np.arange(len(texts) + 1))
            sides.append(([(s[cut[i] : cut[i + 1]], count[cut[i] : cut[i + 1]]) for i in range(len(texts))], which))
        (ba, ia), (bb, ib) = sides
        j = np.array([shingles.overlap(ba[x], bb[y]) for x, y in zip(ia, ib, strict=True)])
        good = j >= similarity if len(batch) else np.zeros(0, dtype=bool)
        yield batch.loc[good, ["a", "b"]]


def _links(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose texts are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInPandas(lambda it: _verify(it, similarity), "a long, b long")


def _id() -> Column:
    """The doc_id as a key that is never null."""
    return F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))


def _texts(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """``node, text`` of the wanted (node, doc_id, t1, t2)."""
    keys = wanted.select(_id().alias("key"), "t1", "t2", "node")
    # the small side is hashed, so that the texts are dealt once and never sorted
    found = _texts_of(docs).withColumn("key", _id()).join(keys.hint("shuffle_hash"), ["key", "t1", "t2"]).select("node", "text")
    return found.dropDuplicates(["node"]) if repeated else found


def _buckets(nodes: DataFrame) -> DataFrame:
    """``band, node, leader``: the members of each bucket of two or more.

    The leader is the member with the most company over all its buckets, which in a
    family of copies is what they were made from.
    """
    spread_out = nodes.select("node", F.explode("bands").alias("band"))
    shared = spread_out.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    member = materialize(spread_out.join(spread(shared), "band"))
    company = member.groupBy("node").agg(F.sum("n").alias("company"))
    ranked = member.select("band", "node").join(company, "node")
    lead = ranked.groupBy("band").agg(F.max(F.struct("company", (-F.col("node")).alias("minus"))).alias("x"))
    return member.select("band", "node").join(spread(lead.select("band", (-F.col("x.minus")).alias("leader"))), "band")


def _blocks(groups: DataFrame, block: int) -> DataFrame:
    """``groups`` (leader, node, part, weight) of which some are in different parts, as blocks to compare.

    A group is compared block by block: rows ``leader, i, j, k``, of which a task gets
    all with one (leader, i, j), and k is the block that the row is in.  Blocks are of
    bounded weight.  The largest part's members are not compared with each other.
    """
    by_part = groups.groupBy("leader", "part").agg(F.sum("weight").alias("w"))
    about = by_part.groupBy("leader").agg(F.max(F.struct("w", "part")).alias("x"), F.sum("w").alias("w"), F.count("*").alias("parts")).where("parts > 1")
    about = about.select(
        "leader", F.col("x.part").alias("major"), (F.col("w") <= block).alias("small"),
        F.ceil(F.col("x.w") / block).alias("majors"), F.ceil((F.col("w") - F.col("x.w")) / block).alias("others"),
    )
    placed = groups.join(spread(about), "leader").withColumn("ismajor", F.col("part") == F.col("major"))
    placed = placed.withColumn("k", F.expr("""
        CASE WHEN small THEN 0L WHEN ismajor THEN others + pmod(xxhash64(node), majors) ELSE pmod(xxhash64(node), others) END"""))
    meets = F.expr("""
        CASE WHEN small THEN array(named_struct('i', 0L, 'j', 0L))
             WHEN ismajor THEN transform(sequence(0L, others - 1), c -> named_struct('i', c, 'j', k))
             ELSE concat(transform(sequence(0L, others - 1), c -> named_struct('i', least(c, k), 'j', greatest(c, k))),
                         transform(sequence(others, others + majors - 1), c -> named_struct('i', k, 'j', c))) END""")
    return placed.select("leader", "node", "part", "weight", "k", meets.alias("meets"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each (leader, i, j) from rows sorted by these; one such set is held at a time."""
    held: list[dict] = []
    now = None
    for batch in batches:
        for row in batch.to_pylist():
            key = row["leader"], row["i"], row["j"]
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(row)
    if held:
        yield now, held


def _agreeing(rows: list[dict], key: tuple, similarity: float, agreement: float) -> tuple[list[dict], list[dict], list[tuple[int, int]]]:
    """The two blocks of a set, and the pairs of different parts whose sizes and signatures allow the similarity."""
    left = [r for r in rows if r["k"] == key[1]]
    right = left if key[1] == key[2] else [r for r in rows if r["k"] == key[2]]
    found: list[tuple[int, int]] = []
    if left and right:
        sig = np.frombuffer(b"".join(r["sig"] for r in right), dtype=np.uint8).reshape(len(right), -1)
        part = np.array([r["part"] for r in right])
        weight = np.array([r["weight"] for r in right], dtype=float)
        for x, r in enumerate(left):
            near = np.flatnonzero((part != r["part"]) & (np.minimum(weight, r["weight"]) >= similarity * np.maximum(weight, r["weight"])))
            if left is right:
                near = near[near > x]
            if len(near):
                mine = np.frombuffer(r["sig"], dtype=np.uint8)
                found += [(x, y) for y in near[(sig[near] == mine).mean(axis=1) >= agreement].tolist()]
    return left, right, found


NEAR = "leader long, i long, j long, k long, node long, part long, weight long, sig binary"


def _nearing(batches: Iterator[pa.RecordBatch], similarity: float, agreement: float) -> Iterator[pa.RecordBatch]:
    """The rows that are in a pair whose signatures agree: only their texts are worth fetching."""
    names = [f.split()[0] for f in NEAR.split(", ")]
    for key, rows in _sets(batches):
        left, right, found = _agreeing(rows, key, similarity, agreement)
        some = {id(left[x]): left[x] for x, _ in found} | {id(right[y]): right[y] for _, y in found}
        if some:
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in some.values()], schema=pa.schema([
                (c, pa.binary() if c == "sig" else pa.int64()) for c in names]))


def _compared(batches: Iterator[pa.RecordBatch], similarity: float, agreement: float) -> Iterator[pa.RecordBatch]:
    """Links between different parts: the pairs whose bags are similar enough."""
    for key, rows in _sets(batches):
        left, right, found = _agreeing(rows, key, similarity, agreement)
        bag_of = {}
        for side, n in ((left, 0), (right, 1)):
            some = sorted({f[n] for f in found})
            for at in range(0, len(some), 256):
                part_of = some[at : at + 256]
                h, first = shingles.word_hashes([side[x]["text"] for x in part_of])
                text, s, count = shingles.bags(h, first)
                cut = np.searchsorted(text, np.arange(len(part_of) + 1))
                bag_of |= {(n, x): (s[cut[i] : cut[i + 1]], count[cut[i] : cut[i + 1]]) for i, x in enumerate(part_of)}
        good = [(left[x]["node"], right[y]["node"]) for x, y in found if shingles.overlap(bag_of[0, x], bag_of[1, y]) >= similarity]
        yield pa.RecordBatch.from_arrays([pa.array([g[n] for g in good], pa.int64()) for n in (0, 1)], names=["a", "b"])


#: The order in which rows of a class are preferred: with an id, by the id, by the text's hashes.
def _preference() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t1", "t2")


def _classed(docs: DataFrame, similarity: float, bands: int, rows: int, agreement: float, block: int) -> DataFrame:
    """``doc_id, t1, t2, copies, class_id, class_size, head``: a row for each different (doc_id, text)."""
    found = materialize(prints(docs, bands, rows))
    fresh = lambda c: F.first(F.when(F.col("fresh"), F.col(c)), ignorenulls=True).alias(c)  # noqa: E731  # the same in all rows of these words
    same = found.groupBy("k1", "k2").agg(F.min(_preference()).alias("head"), F.count("*").alias("n"), F.max("weight").alias("weight"), fresh("bands"), fresh("sig"))
    nodes = materialize(same.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "head", "n", "weight", "bands", "sig"))
    ids = materialize(found.groupBy("k1", "k2", "doc_id", "t1", "t2").agg(F.count("*").alias("copies")))
    repeated = not ids.where("copies > 1").isEmpty()
    carried = nodes.where("weight > 0").select("node", "weight", "sig")
    groups = materialize(_buckets(nodes.where("weight > 0").select("node", "bands")).select("leader", "node").distinct())
    heads = nodes.select("node", "head.doc_id", "head.t1", "head.t2")
    texts = materialize(_texts(docs, heads.join(groups.select("node").distinct(), "node", "left_semi"), repeated))
    star = groups.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    first = materialize(_links(_fitting(star, carried.select("node", "weight"), similarity), texts, similarity))
    parts = materialize(components(first))

    # what the stars have left in different classes of one group: signatures first, then the texts of what agrees
    placed = groups.join(parts, "node", "left").join(carried.select("node", "weight"), "node").select("leader", "node", F.coalesce("root", "node").alias("part"), "weight")
    rest = _blocks(placed, block).join(carried.select("node", "sig"), "node").withColumn("m", F.explode("meets"))
    dealt = lambda df: df.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    near = dealt(rest.select("leader", "m.i", "m.j", "k", "node", "part", "weight", "sig")).mapInArrow(lambda it: _nearing(it, similarity, agreement), NEAR)
    near = materialize(near)
    if not near.isEmpty():
        second = dealt(near.join(texts, "node")).mapInArrow(lambda it: _compared(it, similarity, agreement), "a long, b long")
        parts = materialize(components(first.unionByName(materialize(second))))
    rooted = nodes.join(parts, "node", "left").select("k1", "k2", "head", "n", F.coalesce("root", "node").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("head").alias("best"), F.sum("n").alias("class_size"))
    whole = rooted.select("k1", "k2", "root").join(spread(classes), "root").select("k1", "k2", "best", "class_size")
    return ids.join(spread(whole), ["k1", "k2"]).select(
        "doc_id", "t1", "t2", "copies", F.col("best.doc_id").alias("class_id"), "class_size", (_preference() == F.col("best")).alias("head")
    )


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, agreement: float = AGREEMENT, block: int = BLOCK_WEIGHT) -> DataFrame:
    """``doc_id, class_id, class_size, kept, copy``: one row per row of ``docs``; the class id is its smallest doc_id."""
    found = _classed(docs, similarity, bands, rows, agreement, block)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("doc_id", "class_id", "class_size", (F.col("head") & (F.col("copy") == 1)).alias("kept"), "copy")


def _fitting(pairs: DataFrame, size: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose bags' sizes allow the similarity: the smaller has that part of the larger at least."""
    left, right = size.toDF("a", "wa"), size.toDF("b", "wb")
    both = pairs.join(left, "a").join(right, "b")
    return both.where(F.least("wa", "wb") >= similarity * F.greatest("wa", "wb")).select("a", "b")


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, agreement: float = AGREEMENT, block: int = BLOCK_WEIGHT) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class."""
    found = _classed(docs, similarity, bands, rows, agreement, block)
    names = ["key", "t1", "t2"]
    stays = materialize(found.where("head").select(_id().alias("key"), "t1", "t2", "copies"))
    text = F.col("text").cast("string")
    keyed = docs.select(whole_row(), _id().alias("key"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"))
    rowed = keyed.join(stays.hint("shuffle_hash"), names)
    if not stays.where("copies > 1").isEmpty():  # of rows repeated with their id and text one stays; all others need no second look
        rowed = rowed.where("copies = 1").unionByName(rowed.where("copies > 1").dropDuplicates(names))
    return rowed.select("row.*")
