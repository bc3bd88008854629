"""Best-fit packing of documents into sequences, under conflicts.

Documents longer than a sequence are cut into full sequences and a rest.  The pieces
are dealt into shards of bounded size by a hash, and each shard is packed by itself,
longest piece first.  A shard keeps its open bins ordered by what is left in them, with
a bitmap of the sources and one of the duplicate clusters that each bin holds.  For a
piece, the search starts at the tightest bin it fits into and goes on to the next
roomier one until it meets a bin without a conflict; if there is none, a bin is opened.

A piece conflicts with a bin that holds another piece of its duplicate cluster (pieces
of one document are of one cluster), or ``per_source`` pieces of its source.  For the
latter a bin has so many bitmaps of sources, one for each further piece.  The rule is the
same for all sources and sizes.

Cases: a null text counts as empty; a piece without tokens takes no room but obeys the
conflicts.  A null cluster conflicts with nothing; null sources are one source.
Repeated rows are copies of each other, and so of one cluster where the cluster is
derived from the text; they are counted and dealt over the shards.  A very long text is
cut into pieces, which are dealt over the shards.  Ties in length go by doc_id (null
last), piece, source and cluster; bins with equally much left are taken in the order in
which they were opened.  An empty table gives no rows.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, word_count
from .exact import normalized

#: Tokens in a sequence.
CAPACITY = 2048
#: Pieces in a shard, about.
SHARD_ROWS = 4096
#: Pieces of one source in a bin, at most.
PER_SOURCE = 4
#: Copies of a row that are dealt to one shard together.
TOGETHER = 64

SCHEMA = "bin string, slot int, doc_id long, piece int, first_token long, n_tokens long, source string, bin_tokens long"


class Bins:
    """The bins of one shard.  ``place`` gives a piece its bin."""

    def __init__(self, capacity: int, per_source: int = 1) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.open: list[tuple[int, int]] = []  # (what is left, bin), ordered: the successor search walks it
        self.sources: list[list[int]] = []  # bitmaps: those held once at least, twice at least, ...
        self.clusters: list[int] = []
        self._bits: dict[str, dict[object, int]] = {"source": {}, "cluster": {}}

    def _bit(self, kind: str, value: object) -> int:
        if value is None:
            return 0
        bits = self._bits[kind]
        return bits.setdefault(value, 1 << len(bits))

    def place(self, size: int, source: object, cluster: object) -> int:
        s, c = self._bit("source", source), self._bit("cluster", cluster)
        at = bisect_left(self.open, (size, -1))
        while at < len(self.open):
            left, b = self.open[at]
            if not (self.sources[b][-1] & s or self.clusters[b] & c):
                del self.open[at]
                break
            at += 1
        else:
            left, b = self.capacity, len(self.sources)
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
        held = self.sources[b]
        for level, bits in enumerate(held):
            if not bits & s:
                held[level] = bits | s
                break
        self.clusters[b] |= c
        insort(self.open, (left - size, b))
        return b


def pack_shard(pieces: pd.DataFrame, capacity: int, per_source: int = PER_SOURCE) -> pd.DataFrame:
    """``pieces`` (doc_id, piece, first_token, n_tokens, source, cluster) with ``b, slot, bin_tokens``."""
    pieces = pieces.sort_values(["n_tokens", "doc_id", "piece", "source", "cluster"], ascending=[False, True, True, True, True], kind="stable")
    bins = Bins(capacity, per_source)
    # a cluster that has one piece in the shard meets no conflict, and needs no bit
    again = pieces["cluster"].duplicated(keep=False)
    cluster = pieces["cluster"].where(again & pieces["cluster"].notna(), None)
    source = pieces["source"].where(pieces["source"].notna(), None)
    b = [bins.place(*x) for x in zip(pieces["n_tokens"].astype(int), source, cluster, strict=True)]
    out = pieces.assign(b=b)
    out["slot"] = out.groupby("b").cumcount()
    out["bin_tokens"] = out.groupby("b")["n_tokens"].transform("sum")
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, per_source: int = PER_SOURCE) -> DataFrame:
    """One row per piece: its bin, its place there, and the tokens of the document that it holds.

    ``docs`` has ``doc_id, text, source``, and ``cluster`` if duplicate clusters are
    known; else documents with equal texts are a cluster.
    """
    if capacity < 1 or shard_rows < 1 or per_source < 1:
        raise ValueError("capacity, shard_rows and per_source must be positive")
    cluster = F.col("cluster").cast("string") if "cluster" in docs.columns else F.md5(normalized(F.col("text")))
    # the texts are read once, for their lengths and digests; alike rows are one row with their number
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        word_count(F.col("text")).alias("n"), cluster.alias("cluster"),
    )
    rows = materialize(rows.groupBy("doc_id", "source", "n", "cluster").agg(F.count("*").alias("copies")))
    many = rows.agg(F.sum(F.col("copies") * F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)))).first()[0]
    if not many:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    shards = max(1, -(-int(many) // shard_rows))
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), n)))
    pieces = rows.withColumn("lot", up_to(F.expr(f"(copies - 1) div {TOGETHER}"))).withColumn("piece", up_to(F.ceil(F.col("n") / capacity) - 1))
    pieces = pieces.select(
        "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("first_token"),
        F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("n_tokens"), "source", "cluster",
        F.least(F.lit(TOGETHER).cast("long"), F.col("copies") - F.col("lot") * TOGETHER).alias("copies"),
        F.pmod(F.xxhash64("doc_id", "piece", "cluster", "source", "lot"), F.lit(shards)).alias("shard"),
    )

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by shard; a shard, of bounded size, is packed when its last row has come
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            shard = pd.concat(held, ignore_index=True)
            out = pack_shard(shard, capacity, per_source)
            name = int(shard["shard"].iloc[0])
            out["bin"] = [f"{name}-{b}" for b in out["b"]]
            return out[["bin", "slot", "doc_id", "piece", "first_token", "n_tokens", "source", "bin_tokens"]]

        for batch in batches:
            for name, part in batch.groupby("shard", sort=True):
                if held and held[0]["shard"].iloc[0] != name:
                    yield done()
                    held = []
                held.append(part)
        if held:
            yield done()

    each = pieces.repartition(F.col("shard")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")
    dealt = each.sortWithinPartitions("shard")
    return dealt.mapInPandas(packed, SCHEMA)
