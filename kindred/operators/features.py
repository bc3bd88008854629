"""Corpus statistics, and the features of candidate pairs.

Statistics and token weights are attached to records before pairing, so that pairs carry
them along and no lookup runs on the (much larger) pair side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import pair_similarity
from . import groups, paired

# The names of the features and their order, which models are trained on.
LOOP_COLUMNS = [
    "name_idf_jacc", "name_idf_cont", "addr_idf_jacc", "addr_idf_cont", "addr_shared_idf", "num_shared_idf", "num_conflict", "addr_missing", "num_c1", "num_c2",
    "num_reldiff", "num_digitsim", "tok_un1", "tok_un2", "tok_un1_idf", "tok_un2_idf", "tok_align", "unseen2", "dom_contain", "dom_init",
]
FEATURES = [
    "block_score", "block_name", "block_addr", "name_tsr", "name_sort", "name_ratio", "name_partial", "name_skel", "addr_tsr", "addr_sort", *LOOP_COLUMNS,
    "name_freq1", "name_freq2", "addr_freq1", "addr_freq2", "s1_name_cnt1", "s1_name_cnt2", "s1_addr_cnt1", "translit", "domain",
]


def _address_tokens(words: Column | str = "a_words", numbers: Column | str = "a_numbers") -> Column:
    return F.concat(words, F.transform(numbers, lambda x: F.concat(F.lit("#"), x)))


def _name_set(tokens: Column | str = "n_tokens") -> Column:
    return F.array_sort(F.array_distinct(tokens))


def token_frequency(records: DataFrame, kind: str = "name") -> DataFrame:
    """``token, df``: in how many records a name token, or an address word or #number, occurs."""
    tokens = F.array_distinct("n_tokens") if kind == "name" else _address_tokens()
    return records.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def idf(frequency: DataFrame, n: int) -> DataFrame:
    """``token, idf``: ln(n + 1) - ln(1 + df)."""
    return frequency.withColumn("idf", F.log(F.lit(float(n + 1))) - F.log(1.0 + F.col("df")))


def name_counts(records: DataFrame) -> DataFrame:
    """``n_compact, n_all, n_s1``: records, and S1 records, of exactly this name (empty names too)."""
    return records.groupBy("n_compact").agg(F.count("*").alias("n_all"), F.count_if(F.col("src") == "S1").alias("n_s1"))


def address_counts(records: DataFrame) -> DataFrame:
    """``a_text, a_nums, a_all, a_s1``: records at exactly this address; not for empty ones."""
    there = records.where(~((F.col("a_text") == "") & (F.col("a_nums") == "")))
    return there.groupBy("a_text", "a_nums").agg(F.count("*").alias("a_all"), F.count_if(F.col("src") == "S1").alias("a_s1"))


def s1_vocabulary(records: DataFrame) -> DataFrame:
    """``token``: every name token of S1."""
    return records.where("src = 'S1'").select(F.explode("n_tokens").alias("token")).distinct()


def _weights(records: DataFrame, table: DataFrame, kind: str, name: str) -> DataFrame:
    """``entity_id, src`` and a map from each of the record's tokens to its idf; with ``known`` in ``table``, the number of tokens that S1 lacks."""
    tokens = F.array_distinct("n_tokens") if kind == "name" else _address_tokens()
    joined = records.select("entity_id", "src", F.explode(tokens).alias("token")).join(table, "token")
    return joined.groupBy("entity_id", "src").agg(F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias(name), *(
        [F.count_if(F.col("known").isNull()).alias("n_unseen")] if "known" in table.columns else []
    ))  # a record's own tokens: bounded by its text


@dataclass
class Statistics:
    """Tables over all records of a corpus, from which any of its records is enriched."""

    name_idf: DataFrame
    addr_idf: DataFrame
    names: DataFrame
    addresses: DataFrame

    @staticmethod
    def of(records: DataFrame) -> Statistics:
        n = records.count()
        weights = [idf(token_frequency(records, kind), n).drop("df") for kind in ("name", "addr")]
        known = s1_vocabulary(records).withColumn("known", F.lit(True))
        return Statistics(weights[0].join(known, "token", "left"), weights[1], name_counts(records), address_counts(records))

    def persist(self) -> Statistics:
        return Statistics(*(t.persist() for t in (self.name_idf, self.addr_idf, self.names, self.addresses)))

    def unpersist(self) -> None:
        for t in (self.name_idf, self.addr_idf, self.names, self.addresses):
            t.unpersist()


def enrich(records: DataFrame, statistics: Statistics | None = None) -> DataFrame:
    """Records with token weights, exact-name and exact-address counts and the number of name tokens that S1 lacks.

    The statistics are those of the records themselves, unless those of a larger corpus are given.
    """
    st = statistics or Statistics.of(records)
    out = records.join(_weights(records, st.name_idf, "name", "n_idf"), ["entity_id", "src"], "left")
    out = out.join(_weights(records, st.addr_idf, "addr", "a_idf"), ["entity_id", "src"], "left")
    # counts come by id, so that only ids and what is counted go to them, and whole records move once
    for what, table, counts in ((["n_compact"], st.names, ["n_all", "n_s1"]), (["a_text", "a_nums"], st.addresses, ["a_all", "a_s1"])):
        found = records.select("entity_id", "src", *what).join(table, what).groupBy("entity_id", "src").agg(F.map_from_entries(F.collect_set(F.struct(F.xxhash64(*what), F.struct(*counts)))).alias("__c"))
        out = out.join(found, ["entity_id", "src"], "left").withColumn("__c", F.col("__c")[F.xxhash64(*what)])
        out = out.select("*", *(F.col("__c")[c].alias(c) for c in counts)).drop("__c")
    empty = F.from_json(F.lit("{}"), "map<string,double>")
    return out.withColumns({
        "n_idf": F.coalesce("n_idf", empty), "a_idf": F.coalesce("a_idf", empty), "n_unseen": F.coalesce("n_unseen", F.lit(0)),
        "n_set": _name_set(), "a_set": _address_tokens(),
        **{c: F.log1p(F.coalesce(c, F.lit(0)).cast("double")) for c in ("n_all", "n_s1", "a_all", "a_s1")},
    })


CARRIED = "n_tokens n_set n_core n_compact n_skel n_domain n_translit n_idf n_unseen a_words a_numbers a_set a_text a_idf a_empty n_all n_s1 a_all a_s1".split()


#: Pairs that leave Python at once.
PAIRS = 1024


def with_records(pairs: DataFrame, enriched: DataFrame, carried: Sequence[str] = CARRIED) -> DataFrame:
    """Pairs with both sides' columns, suffixed 1 and 2.

    Pairs meet their records in groups of a country's S1 entities: a record goes once to
    each group that has a pair with it, and no pair is shuffled with its records.  Pairs
    may have their group as ``chunk``.  Columns that are not ``carried`` are null.
    """
    rec, whole = _packed(carried)
    s1 = enriched.where("src = 'S1'").select(F.col("entity_id").alias("s1_id"), F.coalesce("country", F.lit("")).alias("country"), rec)
    right = enriched.where("src <> 'S1'").select(F.col("entity_id").alias("cand_id"), "src", rec)
    own = [c for c in pairs.columns if c not in ("s1_id", "src", "cand_id", "chunk")]
    rows = groups.gathered(pairs, s1, right, own)
    schema = T.StructType([*(rows.schema[c] for c in ("s1_id", "src", "cand_id", "own")), T.StructField("rec1", rows.schema["rec"].dataType), T.StructField("rec2", rows.schema["rec"].dataType)])
    met = rows.mapInArrow(_meet, schema)
    return met.select("s1_id", "src", "cand_id", *(F.col("own")[c].alias(c) for c in own), *(whole(F.col(f"rec{i}"), c).alias(f"{c}{i}") for i in (1, 2) for c in carried), *(
        F.lit(None).cast(enriched.schema[c].dataType).alias(f"{c}{i}") for i in (1, 2) for c in CARRIED if c not in carried))


def _each(tokens: str, weights: str) -> Column:
    return F.transform(tokens, lambda t: F.col(weights)[t])


def _packed(carried: Sequence[str]) -> tuple[Column, Callable[[Column, str], Column]]:
    """The struct ``rec`` of what travels of the ``carried`` columns, and how each of them is had back from it.

    What follows from other columns stays behind, and weights go without the tokens that they are of.
    """
    made = {}
    if "n_tokens" in carried:
        made["n_set"] = lambda r: _name_set(r["n_tokens"])
    if "a_words" in carried and "a_numbers" in carried:
        made["a_set"] = lambda r: _address_tokens(r["a_words"], r["a_numbers"])
    back = lambda r, c: made[c](r) if c in made else r[c]
    sent = {c: F.col(c) for c in carried if c not in made}
    weights = {w: tokens for tokens, w in (("n_set", "n_idf"), ("a_set", "a_idf")) if tokens in carried and w in carried}
    for w, tokens in weights.items():
        sent[w] = _each(tokens, w)
    return F.struct(*(c.alias(k) for k, c in sent.items())).alias("rec"), lambda r, c: F.map_from_arrays(back(r, weights[c]), r[c]) if c in weights else back(r, c)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group, in order: its entities, the others' records, and its pairs, which leave with both."""
    return groups.groups(batches, lambda *sides: sides, _together)


def _together(batch: pa.RecordBatch, sides: tuple[groups.Table, groups.Table]) -> Iterator[pa.RecordBatch]:
    left, right = sides
    pair, one, two = groups.met(batch, left[0], right[0])
    for lo in range(0, len(pair), PAIRS):
        cut = slice(lo, lo + PAIRS)
        mine = batch.select(["s1_id", "src", "cand_id", "own"]).take(pa.array(pair[cut]))
        yield pa.RecordBatch.from_arrays(
            [*mine.columns, left[1].take(pa.array(one[cut])), right[1].take(pa.array(two[cut]))], names=["s1_id", "src", "cand_id", "own", "rec1", "rec2"]
        )


def _sum(tokens: Column, weights: Column) -> Column:
    return F.aggregate(tokens, F.lit(0.0), lambda a, t: a + weights[t])


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def expression_features(df: DataFrame) -> DataFrame:
    """The features that need no string similarity, on pairs with records."""
    df = df.withColumns({
        "__n": F.array_intersect("n_set1", "n_set2"), "__a": F.array_intersect("a_set1", "a_set2"),
        "__x": F.array_intersect("a_numbers1", "a_numbers2"),
        "addr_missing": (F.col("a_empty1") | F.col("a_empty2")).cast("int"),
    })
    df = df.withColumns({
        "__n1": _sum(F.col("n_set1"), F.col("n_idf1")), "__n2": _sum(F.col("n_set2"), F.col("n_idf2")), "__ns": _sum(F.col("__n"), F.col("n_idf1")),
        "__a1": _sum(F.col("a_set1"), F.col("a_idf1")), "__a2": _sum(F.col("a_set2"), F.col("a_idf2")), "__as": _sum(F.col("__a"), F.col("a_idf1")),
    })
    here, both = F.col("addr_missing") == 0, (F.size("a_numbers1") > 0) & (F.size("a_numbers2") > 0)
    number = lambda x: F.left(x, F.lit(9)).cast("double")
    first = lambda c: F.slice(c, 1, 6)
    apart = F.array_min(F.transform(first(F.col("a_numbers1")), lambda x: F.array_min(F.transform(
        first(F.col("a_numbers2")), lambda y: F.abs(number(x) - number(y)) / F.greatest(number(x), number(y), F.lit(1.0))))))
    domain = F.when(F.col("n_domain1"), F.col("n_compact1")).when(F.col("n_domain2"), F.col("n_compact2"))
    others = F.filter(F.when(F.col("n_domain1"), F.col("n_tokens2")).otherwise(F.col("n_tokens1")), lambda t: F.length(t) >= 2)
    initials = F.array_join(F.transform(others, lambda t: F.left(t, F.lit(1))), "")
    told = domain.isNotNull() & (domain != "") & (F.size(others) > 0)
    out = df.withColumns({
        "name_idf_jacc": _share(F.col("__ns"), F.col("__n1") + F.col("__n2") - F.col("__ns")),
        "name_idf_cont": _share(F.col("__ns"), F.least("__n1", "__n2")),
        "addr_idf_jacc": F.when(here, _share(F.col("__as"), F.col("__a1") + F.col("__a2") - F.col("__as"))).otherwise(0.0),
        "addr_idf_cont": F.when(here, _share(F.col("__as"), F.least("__a1", "__a2"))).otherwise(0.0),
        "addr_shared_idf": F.when(here, F.col("__as")).otherwise(0.0),
        "num_shared_idf": F.when(here & (F.size("__x") > 0), F.array_max(F.transform("__x", lambda x: F.col("a_idf1")[F.concat(F.lit("#"), x)]))).otherwise(0.0),
        "num_conflict": (here & both & (F.size("__x") == 0)).cast("int"),
        "num_c1": F.when(here & both, F.size("__x") / F.size("a_numbers1")).otherwise(-1.0),
        "num_c2": F.when(here & both, F.size("__x") / F.size("a_numbers2")).otherwise(-1.0),
        "num_reldiff": F.when(here & both, F.least(apart, F.lit(1.0))).otherwise(1.0),
        "unseen2": _share(F.col("n_unseen2").cast("double"), F.size("n_set2").cast("double")),
        "dom_contain": F.when(told, F.size(F.filter(others, lambda t: F.contains(domain, t))) / F.size(others)).otherwise(0.0),
        "dom_init": F.when(told & (F.length(initials) >= 2) & F.startswith(domain, initials), 1.0).otherwise(0.0),
        "name_freq1": F.col("n_all1"), "name_freq2": F.col("n_all2"), "addr_freq1": F.col("a_all1"), "addr_freq2": F.col("a_all2"),
        "s1_name_cnt1": F.col("n_s11"), "s1_name_cnt2": F.col("n_s12"), "s1_addr_cnt1": F.col("a_s11"),
        "translit": (F.col("n_translit1") | F.col("n_translit2")).cast("int"), "domain": (F.col("n_domain1") | F.col("n_domain2")).cast("int"),
    })
    return out.drop("__n", "__a", "__x", "__n1", "__n2", "__ns", "__a1", "__a2", "__as")


def similarity_features(df: DataFrame) -> DataFrame:
    """The string similarities, and the fuzzy alignment of name tokens."""
    df = df.withColumn("__f", pair_similarity(
        "n_core1", "n_core2", "n_compact1", "n_compact2", "n_skel1", "n_skel2", "a_text1", "a_text2", "n_set1", "n_set2", "a_numbers1", "a_numbers2"
    ))
    both = (F.size("n_set1") > 0) & (F.size("n_set2") > 0)
    lone = lambda s, b: F.filter(F.arrays_zip(F.col(s).alias("t"), F.col(b).alias("r")), lambda x: x["r"] < 0.75)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    df = df.select("*", "__f.*").drop("__f").withColumns({"__u1": lone("n_set1", "best1"), "__u2": lone("n_set2", "best2")})
    rarest = lambda u, m: F.coalesce(F.array_max(F.transform(u, lambda x: F.col(m)[x["t"]])), F.lit(0.0))
    df = df.withColumns({
        "tok_un1": F.when(both, F.size("__u1")).otherwise(0), "tok_un2": F.when(both, F.size("__u2")).otherwise(0),
        "tok_un1_idf": F.when(both, rarest("__u1", "n_idf1")).otherwise(0.0), "tok_un2_idf": F.when(both, rarest("__u2", "n_idf2")).otherwise(0.0),
        "tok_align": F.when(both, (total(F.col("best1")) + total(F.col("best2"))) / (F.size("best1") + F.size("best2"))).otherwise(0.0),
        "num_digitsim": F.when(F.col("addr_missing") == 0, F.col("num_digitsim")).otherwise(0.0),
    })
    return df.drop("__u1", "__u2", "best1", "best2")


def pair_features(pairs: DataFrame, enriched: DataFrame) -> DataFrame:
    """``s1_id, src, cand_id``, ``label`` where the pairs have one, and the 39 features of ``FEATURES``.

    They are made in the groups where pairs meet their records, so that no pair leaves Python with both records.
    """
    rec, _ = _packed(CARRIED)
    s1 = enriched.where("src = 'S1'").select(F.col("entity_id").alias("s1_id"), F.coalesce("country", F.lit("")).alias("country"), rec)
    others = enriched.where("src <> 'S1'").select(F.col("entity_id").alias("cand_id"), "src", rec)
    label = ["label"] if "label" in pairs.columns else []
    sums = [c for c in FEATURES if c in pairs.columns]
    own = [*label, *(F.col(c).cast("double").alias(c) for c in sums)]
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in ("s1_id", "src", "cand_id")), *(pairs.schema[c] for c in label), *(T.StructField(c, T.DoubleType()) for c in FEATURES)])
    made = paired.work([*label, *FEATURES], [*label, *sums])
    return groups.gathered(pairs, s1, others, own).mapInArrow(lambda batches: groups.groups(batches, paired.Records, made, paired.BLOCK), schema)
