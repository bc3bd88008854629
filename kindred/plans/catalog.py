"""A query for each operator, over the driver's tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Blocking, Learning, Params
from ..functions import similarity as sim
from ..functions import text as t
from ..functions.text import normalize_records
from ..operators import blocking as b
from ..operators import diagnostics, evaluation, sampling, scoring, training, translit
from ..operators import features as x
from ..sources import tsv
from . import linkage

#: The frequency cap of these queries and of their SQL: the operators' own.
CAP = Blocking()
DIGITS = 6
_kept: dict[tuple[str, str, str], DataFrame] = {}
_runs: dict[tuple[str, str, bool, bool], str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable[..., DataFrame], parts: Callable[[], int] | None = None) -> DataFrame:
    """A step that many queries share: computed once in a session, and kept as files beside the cluster's checkpoints.

    The shuffle files of what it was made from can go then; with ``parts``, after each of so many parts ``make(k, n)`` of it.
    """
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _kept:
        path = f"{_folder(spark)}/{what.replace(' ', '_')}"
        for k in range(n := parts() if parts else 1):
            (make(k, n) if parts else make()).write.mode("append").option("compression", "zstd").parquet(path)
            gc.collect()
            spark._jvm.System.gc()
        _kept[key] = spark.read.parquet(path)
    return _kept[key]


def forget() -> None:
    """Drops the steps that queries share, so that the next query starts from the tables."""
    _kept.clear()
    _runs.clear()


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "records", lambda: linkage.document_records(_table(spark, sf_dir, "documents")))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "keys", lambda: b.record_keys(records(spark, sf_dir)))


def _blocked(spark: SparkSession, sf_dir: str, kind: str, keys: Callable[[], DataFrame]) -> DataFrame:
    """The candidates and the group that each was found in."""
    common = _common(spark, sf_dir, kind, keys)
    return _once(spark, sf_dir, f"{kind}candidates", lambda: b.best_pairs(keys(), CAP, common=common, placed=True))


def _common(spark: SparkSession, sf_dir: str, kind: str = "", of: Callable[[], DataFrame] | None = None) -> DataFrame:
    return _once(spark, sf_dir, f"{kind}common keys", lambda: b.common_keys(of() if of else keys(spark, sf_dir), CAP))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocked(spark, sf_dir, "", lambda: keys(spark, sf_dir))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).drop("chunk")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "enriched", lambda: x.enrich(records(spark, sf_dir)))


#: Parts, at most, in which whole records meet their pairs: a record goes to most groups of its country, and only one part's
#: are there at once.  A part has two groups for each core, or else there is one part.
PARTS = 8


def _features(spark: SparkSession, sf_dir: str, what: str, placed: DataFrame, enriched: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """With ``truth`` pairs get their label before their features, when they are small."""

    def parts() -> int:
        groups = placed.agg(F.approx_count_distinct("chunk")).first()[0]
        return max(1, min(PARTS, groups // (2 * spark.sparkContext.defaultParallelism)))

    def make(k: int, n: int) -> DataFrame:
        mine = placed.where(F.pmod(F.xxhash64("chunk"), F.lit(n)) == k)
        return x.pair_features(mine if truth is None else evaluation.labelled(mine, truth), enriched)

    return _once(spark, sf_dir, what, make, parts)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    true = _once(spark, sf_dir, "truth", lambda: truth(spark, sf_dir).distinct())
    return _features(spark, sf_dir, "features", _placed(spark, sf_dir), enriched(spark, sf_dir), true)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).drop("label")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.document_truth(_table(spark, sf_dir, "documents"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored claims made of ``lineitem``: orders as S1, parts as records, with stand-ins for the rule features."""
    li = _table(spark, sf_dir, "lineitem")
    unit = lambda e, m=101: F.round(F.pmod(F.expr(e).cast("long"), F.lit(m)) / float(m - 1), 4)
    rows = li.select(
        F.concat(F.lit("S1-"), F.col("l_orderkey").cast("string")).alias("s1_id"), F.when(F.col("l_linestatus") == "O", "S2").otherwise("S3").alias("src"),
        F.concat(F.when(F.col("l_linestatus") == "O", "S2-").otherwise("S3-"), F.col("l_partkey").cast("string")).alias("cand_id"), (F.col("l_returnflag") == "R").alias("label"),
        unit("l_partkey * 31 + l_orderkey * 7 + l_linenumber").alias("p1"), unit("l_partkey * 17 + l_linenumber * 5").alias("name_sort"), unit("l_orderkey * 13 + l_partkey").alias("name_ratio"),
        unit("l_suppkey * 29 + l_orderkey").alias("name_skel"), unit("l_suppkey * 3 + l_partkey").alias("name_partial"), unit("l_orderkey * 11 + l_suppkey").alias("name_idf_jacc"),
        unit("l_orderkey * 19 + l_linenumber").alias("name_tsr"), unit("l_partkey * 23 + l_orderkey").alias("addr_idf_jacc"), unit("l_suppkey * 37 + l_linenumber").alias("addr_sort"),
        unit("l_partkey * 41 + l_suppkey").alias("addr_idf_cont"), (unit("l_orderkey + l_partkey") * 40).alias("addr_shared_idf"), (F.col("l_partkey") % 3 == 0).cast("int").alias("num_shared_idf"),
        (F.col("l_partkey") % 3 == 1).cast("int").alias("num_conflict"), (F.col("l_suppkey") % 11 == 0).cast("int").alias("addr_missing"),
        (F.col("l_orderkey") % 7 == 0).cast("int").alias("translit"), (F.col("l_partkey") % 13 == 0).cast("int").alias("domain"),
    )
    one = rows.groupBy("s1_id", "src", "cand_id").agg(*(F.max(c).alias(c) for c in rows.columns if c not in ("s1_id", "src", "cand_id")))
    return one


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as records of three sources: their names, and size, type and brand as addresses."""

    def make() -> DataFrame:
        key = F.col("p_partkey")
        src = F.concat(F.lit("S"), (key % 3 + 1).cast("string"))
        return normalize_records(_table(spark, sf_dir, "part").select(
            F.concat(src, F.lit("-"), key.cast("string")).alias("entity_id"), src.alias("src"), F.col("p_name").alias("business_name"),
            F.concat_ws(" ", F.col("p_size").cast("string"), "p_type", "p_brand").alias("business_address"), F.lit("us").alias("country"),
        ))

    return _once(spark, sf_dir, "part records", make)


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = part_records(spark, sf_dir)
    keys = lambda: _once(spark, sf_dir, "part keys", lambda: b.record_keys(rec))
    return _features(spark, sf_dir, "part features", _blocked(spark, sf_dir, "part ", keys), _once(spark, sf_dir, "part enriched", lambda: x.enrich(rec)))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


# ---------------------------------------------------------------- text


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


#: Names with the noise that the scalar functions are for.
NAMES = [
    "Shri Lotus Ínfra Private Límited", "blueriver.com", "http://www.Green-Valley.co.in", "Northern Star - 9876543210", "Sunr1se Exports Private Limited",
    "Nagpur Nagpur SOLAR Private Limited", "M/s Ruby Traders Private", "Rivet +-[Co]", "L L C Harbour & Sons", "Inc  Ltd", "The Ltd And Corp", "4mber 9est 2021 Mart", "",
]
#: Names of true pairs in Indic script and in English.
INDIC_PAIRS = [
    ("श्री जैन प्राइवेट", "Sree Jain Private"), ("श्री गणेश लिमिटेड", "Shree Ganesh Limited"), ("श्री टेक लिमिटेड", "Sree Tech Limited"), ("जैन टेक", "Jain Tech"),
    ("టెక్ లిమిటెడ్", "Tech Limited"), ("जैन", "Jain Traders"), ("plain name", "Plain Name"),
]


def ascii_fold(spark, sf_dir):
    folded = t.to_ascii(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(folded).alias("chars"), F.md5(folded).alias("digest"))


#: Words of many scripts, as they are usually spelt; worked out by hand.
SCRIPTS = [
    ("O’Neil–Smith", "o'neil-smith"), ("Acme—Beta", "acme-beta"), ("Москва Трейд", "moskva treid"), ("Щука Жизнь", "shchuka zhizn'"), ("Київ Ґанок", "kiiv ganok"),
    ("Καλημέρα Ψυχή", "kalemera psukhe"), ("Ægir Øst ß Łódź", "aegir ost ss lodz"), ("한국 서울", "hangug seoul"), ("とうきょう カメラ", "toukiyou kamera"), ("しちつふじ", "shichitsufuji"),
    ("ﬁne ＡＢＣ １２", "fine abc 12"), ("½ №5 «x»", "1 2 no5 <<x>>"), ("a…b © ® ™", "a...b (c) (r) (tm)"), ("“q” ‘s’", "'q' 's'"), ("naïve café Ñandú", "naive cafe nandu"), ("plain ASCII", "plain ascii"), ("漢字 x", " x"),
]


def script_fold(spark, sf_dir):
    return _values(spark, [(s,) for s, _ in SCRIPTS], "s string").select("s", t.to_ascii(F.col("s")).alias("folded"))


def latin_flag(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("text").alias("s"))
    pairs = _values(spark, [(p,) for p, _ in INDIC_PAIRS], "s string")
    return docs.unionByName(pairs).groupBy(t.is_latin(F.col("s")).alias("latin"), t.has_indic(F.col("s")).alias("indic")).agg(F.count("*").alias("n"))


def _words(spark, sf_dir):
    folded = _table(spark, sf_dir, "documents").select(F.explode(t.tokens(t.to_ascii(F.col("text")))).alias("token"))
    return folded.distinct()


def skeleton(spark, sf_dir):
    return _words(spark, sf_dir).select("token", t.skeleton(F.col("token")).alias("skeleton"))


def leet(spark, sf_dir):
    extra = _values(spark, [(w,) for w in ("h0rizon", "5mart", "8est", "123", "c0m")], "token string")
    return _words(spark, sf_dir).unionByName(extra).distinct().select("token", t.fix_leet(F.col("token")).alias("fixed"))


def indic_translate(spark, sf_dir):
    known = F.create_map(*(F.lit(w) for w in ("जैन", "jain", "श्री", "sree", "टेक", "tech")))
    return _values(spark, [(p,) for p, _ in INDIC_PAIRS], "s string").select("s", t.translate_indic(F.col("s"), known).alias("translated"))


def domain_stem(spark, sf_dir):
    urls = _table(spark, sf_dir, "pages").select(F.lower("url").alias("s")).unionByName(_values(spark, [(n.lower(),) for n in NAMES], "s string"))
    return urls.distinct().select("s", t.domain_stem(F.col("s")).alias("stem"))


def strip_long_digits(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", t.strip_long_digits(t.spell_signs(t.to_ascii(F.col("text")))).alias("s"))
    return docs.select("doc_id", F.length("s").alias("chars"), F.md5("s").alias("digest"))


def _token_query(spark, sf_dir, f: Callable[[Column], Column]):
    """A step on token arrays, over all documents' whole texts and the noisy names."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), t.tokens(t.to_ascii(F.col("text"))).alias("ts"))
    noisy = _values(spark, [(-1 - i, n) for i, n in enumerate(NAMES)], "id long, s string").select("id", t.tokens(t.to_ascii(F.col("s"))).alias("ts"))
    out = rows.unionByName(noisy).withColumn("out", f(F.col("ts")))
    return out.select("id", F.size("out").cast("long").alias("tokens"), F.md5(F.array_join("out", " ")).alias("digest"))


def _translit_legal(spark, sf_dir):
    rows = _values(spark, [(w,) for w in ("praaivett", "limittedd", "praa", "li", "jain", "kmpnii", "gloobl")], "token string")
    return rows.withColumn("kept", F.size(t.drop_legal_skeletons(F.array("token"))).cast("long"))


def name_fallback(spark, sf_dir):
    rows = _values(spark, [(n,) for n in ("Inc  Ltd", "The Ltd And Corp", "Shri Plc Inc Co", "and", "", "Apex Ltd")], "business_name string")
    return t.normalize_names(rows, "business_name").select("business_name", "n_core")


def name_normalize(spark, sf_dir):
    return records(spark, sf_dir).select("entity_id", "n_core", "n_compact", "n_skel", "n_domain", "n_translit")


def party_names(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("business_name")).union(_table(spark, sf_dir, "supplier").select("s_name")).union(
        _table(spark, sf_dir, "part").select("p_name")).union(_values(spark, [(n,) for n in NAMES], "business_name string")).distinct()
    return t.normalize_names(rows, "business_name").select("business_name", "n_core", "n_compact", "n_skel", "n_domain")


#: Addresses with the noise that the scalar functions are for.
ADDRESSES = [
    "Plot ##17/3/2/B6 Lakeside Road, Lakeside Ranpur, Ranpur, MH", "OH, Dayton, 4410 Maple Avenue", "2203 Oak Avenue, CITY OF ELMWOOD, WI",
    "77, BR, Gaya, Behind Of Temple Place Canal Road", "9-DD, IIIRD ADDITIONAL MARKET, HISAR, हरियाणा", "Court Ct Second 2nd", "00231 000", "", "New York, Texas, 14c South Street",
]


def addr_nonlatin(spark, sf_dir):
    rows = _values(spark, [(a,) for a in [*ADDRESSES, "Delhi, दिल्ली road", "a, b"]], "s string")
    return rows.select("s", t.drop_non_latin(F.col("s")).alias("kept"))


def _folded_addresses(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), t.to_ascii(F.col("text")).alias("s"))
    return docs.unionByName(_values(spark, [(-1 - i, a) for i, a in enumerate(ADDRESSES)], "id long, a string").select("id", t.to_ascii(t.drop_non_latin(F.col("a"))).alias("s")))


def addr_states(spark, sf_dir):
    out = _folded_addresses(spark, sf_dir).withColumn("s", t.drop_states(F.col("s")))
    return out.select("id", F.length("s").alias("chars"), F.md5("s").alias("digest"))


def addr_numbers(spark, sf_dir):
    rows = _folded_addresses(spark, sf_dir).select(F.explode(t.tokens(F.col("s"))).alias("token")).distinct()
    return rows.select("token", t.address_number(F.col("token")).alias("number")).where("number is not null")


def addr_words(spark, sf_dir):
    rows = _folded_addresses(spark, sf_dir).select(F.explode(t.tokens(F.col("s"))).alias("token")).distinct()
    return rows.select("token", t.address_word(F.col("token")).alias("word"))


def addr_normalize(spark, sf_dir):
    return records(spark, sf_dir).select("entity_id", "a_text", "a_nums", "a_empty")


def country(spark, sf_dir):
    nations = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("raw")).union(_table(spark, sf_dir, "documents").select("lang"))
    return nations.select("raw", t.country_code(F.col("raw")).alias("country")).groupBy("raw", "country").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- sampling


def hash_sample(spark, sf_dir):
    return records(spark, sf_dir).select("entity_id", sampling.hash_sample(F.col("entity_id"), 20).alias("sampled"))


def folds(spark, sf_dir):
    return records(spark, sf_dir).select("entity_id", sampling.fold(F.col("entity_id")).alias("fold"))


def weighted_subsample(spark, sf_dir):
    rows = claims(spark, sf_dir).select("s1_id", "src", "cand_id", "label", "p1")
    return sampling.weighted_subsample(rows, F.col("label") | (F.col("p1") >= 0.9), F.concat_ws("|", "s1_id", "src", "cand_id"), 10)


def examples(spark, sf_dir):
    wrong = diagnostics.errors(_decided(spark, sf_dir)).withColumn("g", F.concat_ws(": ", "kind", "cause")).withColumn("key", F.concat_ws("|", "s1_id", "cand_id"))
    return sampling.examples_per_group(wrong, "g", F.col("key"), 12).select("g", "s1_id", "cand_id")


# ---------------------------------------------------------------- blocking


def _key_query(spark, sf_dir, make: Callable[[], Column]):
    return records(spark, sf_dir).select("entity_id", F.explode(F.array_distinct(make())).alias("key"))


def key_count(spark, sf_dir):
    return b.key_sizes(keys(spark, sf_dir))


def key_cap(spark, sf_dir):
    return _rounded(b.usable_keys(keys(spark, sf_dir), CAP).select("src", "key", "entity_id", "size", "w"), "w")


def probe_semi(spark, sf_dir):
    return b.probe_keys(keys(spark, sf_dir), CAP).select("entity_id", "key", "family")


def block_score(spark, sf_dir):
    return _rounded(b.scored_pairs(keys(spark, sf_dir), CAP), "block_name", "block_addr", "block_score")


def block_topk(spark, sf_dir):
    return _rounded(candidates(spark, sf_dir), "block_name", "block_addr", "block_score")


def candidate_list(spark, sf_dir):
    return scoring.candidate_lists(_s1(spark, sf_dir), candidates(spark, sf_dir))


def _s1(spark, sf_dir):
    return records(spark, sf_dir).where("src = 'S1'").select(F.col("entity_id").alias("s1_id"))


# ---------------------------------------------------------------- statistics and features


def token_df(spark, sf_dir):
    names = x.token_frequency(records(spark, sf_dir), "name").withColumn("kind", F.lit("name"))
    return names.unionByName(x.token_frequency(records(spark, sf_dir), "addr").withColumn("kind", F.lit("addr")))


def idf(spark, sf_dir):
    rec = records(spark, sf_dir)
    return _rounded(x.idf(x.token_frequency(rec, "name"), rec.count()), "idf")


def name_count(spark, sf_dir):
    return x.name_counts(records(spark, sf_dir))


def addr_count(spark, sf_dir):
    return x.address_counts(records(spark, sf_dir))


def s1_vocab(spark, sf_dir):
    return x.s1_vocabulary(records(spark, sf_dir))


EXPRESSIONS = [
    "name_idf_jacc", "name_idf_cont", "addr_idf_jacc", "addr_idf_cont", "addr_shared_idf", "num_shared_idf", "num_conflict", "addr_missing", "num_c1", "num_c2", "num_reldiff", "unseen2",
    "name_freq1", "name_freq2", "addr_freq1", "addr_freq2", "s1_name_cnt1", "s1_name_cnt2", "s1_addr_cnt1", "translit", "domain",
]


#: What the features of each query need of a record.
NEEDED = {
    "name_idf": ["n_set", "n_idf"], "addr": ["a_set", "a_idf", "a_empty"], "num": ["a_numbers", "a_idf", "a_empty"], "unseen": ["n_unseen", "n_set"],
    "freq": ["n_all", "n_s1", "a_all", "a_s1"], "flags": ["n_translit", "n_domain", "n_compact", "n_tokens"],
}


def _expressions(spark, sf_dir, needed: str, *columns: str):
    pairs = _placed(spark, sf_dir).select("s1_id", "src", "cand_id", "chunk")  # the pairs' own sums need not move
    rec = enriched(spark, sf_dir)
    if needed == "num":  # of the weights, only those of numbers
        rec = rec.withColumn("a_idf", F.map_filter("a_idf", lambda t, _: F.startswith(t, F.lit("#"))))
    out = x.expression_features(x.with_records(pairs, rec, NEEDED[needed])).select("s1_id", "src", "cand_id", *(F.col(c).cast("double").alias(c) for c in columns))
    return _rounded(out, *columns)


def website_features(spark, sf_dir):
    """Hosts of pages as website names against the words of the parts' names."""
    host = F.regexp_extract("url", r"^https?://(?:www\.|m\.)?([^/]*)", 1)
    hosts = _table(spark, sf_dir, "pages").select(F.replace(host, F.lit(".example."), F.lit(".")).alias("business_name")).distinct()
    sites = t.normalize_names(hosts, "business_name").where("n_domain").select("business_name", "n_compact")
    words = _words(spark, sf_dir).where("length(token) between 2 and 6").withColumn("first", F.left("token", F.lit(3)))
    pairs = sites.withColumn("first", F.left("n_compact", F.lit(3))).join(words, "first")
    return pairs.select("business_name", "token", F.contains("n_compact", F.col("token")).alias("contained"), F.startswith("n_compact", "token").alias("starts"))


def _part_pairs(spark, sf_dir):
    """The different part names that share a word, in pairs, and some known strings."""
    names = _table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    words = names.select("a", F.explode(F.array_distinct(F.split("a", " "))).alias("w"))
    pairs = words.join(words.select(F.col("a").alias("b"), "w"), "w").where("a <= b").select("a", "b").distinct()
    return pairs.unionByName(_values(spark, [("limited", "limitteed"), ("2204", "204"), ("131", "31"), ("405", "406"), ("", ""), ("", "abc")], "a string, b string"))


def indel(spark, sf_dir):
    return _rounded(_part_pairs(spark, sf_dir).withColumn("ratio", sim.indel_ratio("a", "b")), "ratio")


def indel_expression(spark, sf_dir):
    return _rounded(_part_pairs(spark, sf_dir).withColumn("ratio", sim.indel_ratio_expr(F.col("a"), F.col("b"))), "ratio")


def token_sort(spark, sf_dir):
    return _rounded(_part_pairs(spark, sf_dir).withColumn("ratio", sim.token_sort_ratio("a", "b")), "ratio")


def token_set(spark, sf_dir):
    return _rounded(_part_pairs(spark, sf_dir).withColumn("ratio", sim.token_set_ratio("a", "b")), "ratio")


def partial_ratio(spark, sf_dir):
    return _rounded(_part_pairs(spark, sf_dir).withColumn("ratio", sim.partial_ratio("a", "b")), "ratio")


def token_align(spark, sf_dir):
    pairs = _part_pairs(spark, sf_dir).where("a <> '' and b <> ''").select("a", "b", t.tokens(F.col("a")).alias("x"), t.tokens(F.col("b")).alias("y"))
    pairs = pairs.withColumns({"b1": sim.best_matches("x", "y"), "b2": sim.best_matches("y", "x")})
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    pairs = pairs.withColumns({
        "unmatched": F.size(F.filter("b1", lambda r: r < 0.75)).cast("long"), "align": (total(F.col("b1")) + total(F.col("b2"))) / (F.size("b1") + F.size("b2")),
    })
    return _rounded(pairs.select("a", "b", "unmatched", "align"), "align")


SIMILARITIES = [
    "name_tsr", "name_sort", "name_ratio", "name_partial", "name_skel", "addr_tsr", "addr_sort", "num_digitsim", "tok_un1", "tok_un2", "tok_un1_idf", "tok_un2_idf", "tok_align",
]


def part_similarity(spark, sf_dir):
    """The string similarities of candidate pairs, as the features that they are."""
    return _rounded(part_features(spark, sf_dir).select("s1_id", "src", "cand_id", *SIMILARITIES), *SIMILARITIES)


def part_matrix(spark, sf_dir):
    return _rounded(part_features(spark, sf_dir), *x.FEATURES)


def part_scores(spark, sf_dir):
    """The rule score on the engine's own features."""
    scored = part_features(spark, sf_dir).withColumns({"name_score": scoring.name_score(), "addr_score": scoring.address_score(Params()), "score": scoring.rule_score()})
    return _rounded(scored.select("s1_id", "src", "cand_id", "name_score", "addr_score", "score"), "name_score", "addr_score", "score")


def part_links(spark, sf_dir):
    """The whole pipeline with the rule scorer over the parts: records to match lists."""
    scored = part_features(spark, sf_dir).withColumn("score", F.round(scoring.rule_score(), DIGITS))
    ids = part_records(spark, sf_dir).where("src = 'S1'").select(F.col("entity_id").alias("s1_id"))
    return scoring.match_lists(ids, scoring.decide(scored))


def feature_matrix(spark, sf_dir):
    return _rounded(features(spark, sf_dir), *x.FEATURES)


# ---------------------------------------------------------------- scoring


def _scores(spark, sf_dir, f: Callable[[], Column]):
    return _rounded(claims(spark, sf_dir).select("s1_id", "src", "cand_id", f().alias("score")), "score")


def _claim_scores(spark, sf_dir):
    return claims(spark, sf_dir).withColumn("score", F.round(scoring.rule_score(), DIGITS))


def comp_s1(spark, sf_dir):
    return _rounded(scoring.s1_competition(claims(spark, sf_dir).select("s1_id", "src", "cand_id", "p1")), "s1_gap")


def comp_record(spark, sf_dir):
    return _rounded(scoring.record_competition(claims(spark, sf_dir).select("s1_id", "src", "cand_id", "p1")), "c_gap")


def competition(spark, sf_dir):
    """The whole competition of claims: by entity and by record."""
    return _rounded(scoring.competition(claims(spark, sf_dir).select("s1_id", "src", "cand_id", "p1")), "s1_gap", "c_gap")


def stage2_matrix(spark, sf_dir):
    """What a second model sees: features and competition of the pairs that a first score does not prune."""
    first = part_features(spark, sf_dir).withColumn("p1", F.round(scoring.rule_score(), DIGITS))
    columns = [*x.FEATURES, *(c for c in scoring.COMPETITION if c not in x.FEATURES)]
    out = scoring.competition(training.prune(first)).select("s1_id", "src", "cand_id", *(F.col(c).cast("double").alias(c) for c in columns))
    return _rounded(out, *columns)


def labelled(spark, sf_dir):
    c = claims(spark, sf_dir)
    return evaluation.labelled(c.select("s1_id", "src", "cand_id"), c.where("label").select("s1_id", "cand_id"))


def training_totals(spark, sf_dir):
    rows = training.training_set(claims(spark, sf_dir).select("s1_id", "src", "cand_id", "label", "p1"))
    return rows.agg(F.count("*").alias("kept"), F.sum("weight").alias("effective"), F.count_if("label").alias("true"))


def _decision(spark, sf_dir, f: Callable[[DataFrame], DataFrame]):
    return f(_claim_scores(spark, sf_dir)).select("s1_id", "src", "cand_id", "score")


def _decided(spark, sf_dir):
    scored = _claim_scores(spark, sf_dir)
    return linkage.mark_kept(scored, scoring.decide(scored))


def match_list(spark, sf_dir):
    ids = claims(spark, sf_dir).select("s1_id").distinct()
    return scoring.match_lists(ids, scoring.decide(_claim_scores(spark, sf_dir)))


# ---------------------------------------------------------------- evaluation and diagnosis


def _claim_entities(spark, sf_dir):
    c = claims(spark, sf_dir)
    kept = scoring.decide(_claim_scores(spark, sf_dir))
    return evaluation.per_entity(c.select("s1_id").distinct(), kept.select("s1_id", "cand_id"), c.where("label").select("s1_id", "cand_id"))


def f05_entity(spark, sf_dir):
    return _rounded(_claim_entities(spark, sf_dir), "f05")


def macro_f05(spark, sf_dir):
    return _rounded(evaluation.macro(_claim_entities(spark, sf_dir)), "macro_f05", "mean_precision", "mean_recall", "singleton_accuracy")


def blocking_recall(spark, sf_dir):
    return _rounded(evaluation.blocking_recall(truth(spark, sf_dir), candidates(spark, sf_dir)), "recall")


def missed_pairs(spark, sf_dir):
    few = candidates(spark, sf_dir).where("round(block_score, 9) >= 2")  # rounded, so that a sum of 2 does not hang on the order of summing
    return evaluation.missed_pairs(truth(spark, sf_dir), few)


#: Pairs, about, whose causes are found at once.
CAUSES = 1 << 22


def miss_cause(spark, sf_dir):
    """Causes for all true pairs, and for S1's records against the others with the same first number.

    They are found in parts by that number, which records with the same text have in common, so that a record is in one part.
    """
    rec = records(spark, sf_dir).withColumn("k", F.get("a_numbers", F.lit(0)))

    def parts() -> int:
        if not rec.groupBy("entity_id").count().where("count > 1").isEmpty():
            return 1  # an id may have records with different numbers
        counts = rec.where("k is not null").groupBy("k").agg(F.count_if(F.col("src") == "S1").alias("a"), F.count_if(F.col("src") != "S1").alias("b"))
        return 1 + int((counts.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0) // CAUSES)

    def make(part: int, n: int) -> DataFrame:
        some = rec.where(F.pmod(F.xxhash64("k"), F.lit(n)) == part)
        first = lambda where, name: some.where(where).where("k is not null").select(F.col("entity_id").alias(name), "k")
        true = truth(spark, sf_dir).join(some.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
        pairs = first("src = 'S1'", "s1_id").join(first("src <> 'S1'", "cand_id"), "k").select("s1_id", "cand_id").unionByName(true).distinct()
        missed = evaluation.missed_pairs(pairs, candidates(spark, sf_dir))
        # pairs of a number are in one group, and so are the records that they need
        mine = first("src = 'S1'", "s1_id").groupBy("s1_id").agg(F.min("k").alias("k"))
        size = F.broadcast(mine.agg(F.greatest(F.ceil(F.count("*") / F.lit(1024.0)), F.lit(64)).alias("n")))
        missed = missed.join(mine.join(size).select("s1_id", F.pmod(F.xxhash64("k"), "n").cast("string").alias("chunk")), "s1_id", "left")
        return diagnostics.miss_causes(missed.withColumn("chunk", F.coalesce("chunk", F.lit(""))), some.drop("k"), CAP, over)

    over = _once(spark, sf_dir, "oversized keys", lambda: diagnostics.oversized(keys(spark, sf_dir), CAP, _common(spark, sf_dir)))
    return _once(spark, sf_dir, "miss causes", make, parts)


def error_cause(spark, sf_dir):
    return _rounded(diagnostics.histogram(diagnostics.errors(_decided(spark, sf_dir)), "kind", "cause", within="kind"), "percent")


def fp_fn(spark, sf_dir):
    c = claims(spark, sf_dir)
    singles = c.groupBy("s1_id").agg(F.count_if("label").alias("n")).where("n = 0").select("s1_id")
    return diagnostics.decision_counts(_decided(spark, sf_dir), singles)


def _result_rows(spark, sf_dir):
    """Result lists made of ``orders``, with every kind of fault in some rows."""
    o = _table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    other = F.concat(F.when(cust % 2 == 0, "S2-").otherwise("S3-"), cust.cast("string"))
    ids = (
        F.when(key % 5 == 0, "").when(key % 17 == 0, F.concat(other, F.lit(","), other)).when(key % 19 == 0, F.concat(other, F.lit(",")))
        .when(key % 23 == 0, F.concat(F.lit("S9-"), key.cast("string"))).otherwise(other)
    )
    s1 = F.concat(F.when(key % 101 == 0, "X-").otherwise("S1-"), (F.when(key % 97 == 0, key - 1).otherwise(key)).cast("string"))
    return o.select(s1.alias("s1_id"), ids.alias("ids"))


def _known(spark, sf_dir):
    s1 = _table(spark, sf_dir, "orders").select(F.concat(F.lit("S1-"), F.col("o_orderkey").cast("string")).alias("entity_id"), F.lit("S1").alias("src"))
    c = F.col("c_custkey")
    src = F.when(c % 2 == 0, "S2").otherwise("S3")
    return s1.unionByName(_table(spark, sf_dir, "customer").select(F.concat(src, F.lit("-"), c.cast("string")).alias("entity_id"), src.alias("src")))


def validate_results(spark, sf_dir):
    return evaluation.validate(_result_rows(spark, sf_dir), _known(spark, sf_dir))


def validate_candidates(spark, sf_dir):
    lists = _result_rows(spark, sf_dir).where("s1_id <> 'S1-11'").withColumn("ids", F.regexp_replace("ids", r"7$", "8"))
    return evaluation.validate(_result_rows(spark, sf_dir), _known(spark, sf_dir), lists)


def result_summary(spark, sf_dir):
    return evaluation.summary(_result_rows(spark, sf_dir))


def truth_edges(spark, sf_dir):
    return evaluation.edges(_result_rows(spark, sf_dir), "s1_id", "ids")


def raw_lookup(spark, sf_dir):
    raw = linkage.from_documents(_table(spark, sf_dir, "documents"))
    found = truth(spark, sf_dir)
    ids = found.select(F.col("s1_id").alias("entity_id")).unionByName(found.select(F.col("cand_id").alias("entity_id"))).distinct()
    return diagnostics.raw_lookup(raw, ids).select("entity_id", F.md5("shown").alias("digest"))


# ---------------------------------------------------------------- dictionary, files, learning


def _indic_pairs(spark):
    return _values(spark, INDIC_PAIRS, "other_name string, s1_name string")


def align_counts(spark, sf_dir):
    return translit.alignment_counts(_indic_pairs(spark))


def align_argmax(spark, sf_dir):
    return translit.learn(translit.alignment_counts(_indic_pairs(spark)))


def _folder(spark: SparkSession) -> str:
    """A new folder beside the cluster's checkpoints; one of our own only where all runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared.rstrip('/') if shared else tempfile.gettempdir()}/kindred-{uuid.uuid4().hex}"


def tsv_round_trip(spark, sf_dir):
    """Records of all documents, quotes and empty fields included, written as a file and read again."""
    rows = linkage.from_documents(_table(spark, sf_dir, "documents")).select("entity_id", "business_name", "business_address", "country")
    odd = _values(spark, [("S9-1", 'a "quoted" name', "NA", ""), ("S9-2", "back\\slash", "null", "in")], "entity_id string, business_name string, business_address string, country string")
    path = _folder(spark)
    tsv.write_tsv(rows.unionByName(odd), path)
    return tsv.read_tsv(spark, path).withColumn("business_address", F.md5("business_address"))


def dictionary_pairs(spark, sf_dir):
    """The true pairs of names that a dictionary is learned from."""
    found = linkage.true_names(linkage.from_documents(_table(spark, sf_dir, "documents")), truth(spark, sf_dir))
    return found.select("s1_id", "cand_id", F.md5("s1_name").alias("s1_digest"), F.md5("other_name").alias("other_digest"))


def _part_files(spark, sf_dir, stream: bool, lists_only: bool = False) -> str:
    """The parts written as the three source files, linked from the files by rules, once in a session; the folder of both.

    With ``lists_only``, linked as far as the candidate lists, unless a whole run is there.
    """
    whole = (spark.sparkContext.applicationId, sf_dir, stream, False)
    known = whole if whole in _runs else (*whole[:3], lists_only)
    if known in _runs:
        return _runs[known]
    base = _folder(spark)
    key = F.col("p_partkey")
    rows = _table(spark, sf_dir, "part").select(
        F.concat(F.lit("S"), (key % 3 + 1).cast("string"), F.lit("-"), key.cast("string")).alias("entity_id"), F.col("p_name").alias("business_name"),
        F.concat_ws(" ", F.col("p_size").cast("string"), "p_type", "p_brand").alias("business_address"), F.lit("US").alias("country"),
    )
    for n in (1, 2, 3):
        tsv.write_tsv(rows.where(F.startswith("entity_id", F.lit(f"S{n}-"))), f"{base}/data_test/test_source{n}.tsv")
    linkage.run(spark, base, f"{base}/out", "test", stream=stream, lists_only=lists_only)
    _runs[known] = base
    return base


def run_files(spark, sf_dir, stream: bool = False):
    """The command's run over files: source files in, result file out."""
    base = _part_files(spark, sf_dir, stream)
    rows, _ = tsv.read_results(spark, f"{base}/out/matching_results.tsv", ("source1_entity_id", "matched_entity_ids"))
    return rows.select("s1_id", F.col("ids").alias("matched_ids"))


def run_candidates(spark, sf_dir):
    base = _part_files(spark, sf_dir, False, lists_only=True)
    rows, _ = tsv.read_results(spark, f"{base}/out/candidate_pairs.tsv", ("source1_entity_id", "candidate_entity_ids"))
    return rows.select("s1_id", F.col("ids").alias("candidate_ids"))


def run_check(spark, sf_dir):
    """The command's check of what a run has written."""
    base = _part_files(spark, sf_dir, False)
    return linkage.check(spark, base, f"{base}/out", "test")


SMALL = Learning(trees=5, rate=0.3, depth=3)


def _model(spark, sf_dir):
    return training.fit(_labelled(spark, sf_dir), SMALL)


def stage1(spark, sf_dir):
    model = training.fit(_labelled(spark, sf_dir), SMALL, stages=1)
    return training.stage1_scores(features(spark, sf_dir), model).select("s1_id", "src", "cand_id", "p1")


def stage2(spark, sf_dir):
    return training.ml_scores(features(spark, sf_dir), _model(spark, sf_dir), SMALL).select("s1_id", "src", "cand_id", "p1", "score")


def prune(spark, sf_dir):
    return training.prune(claims(spark, sf_dir)).select("s1_id", "src", "cand_id", "p1")


def oof_folds(spark, sf_dir):
    def keep(df: DataFrame) -> DataFrame:
        path = f"{_folder(spark)}/folds"
        df.write.option("compression", "zstd").parquet(path)
        del df
        gc.collect()
        spark._jvm.System.gc()
        return spark.read.parquet(path)

    return training.out_of_fold(_labelled(spark, sf_dir), SMALL, stages=2, keep=keep).select("s1_id", "src", "cand_id", "label", "p1", "score")


def training_rows(spark, sf_dir):
    scored = claims(spark, sf_dir).select("s1_id", "src", "cand_id", "label", "p1")
    return training.training_set(scored)


def coord_ascent(spark, sf_dir):
    c = _claim_scores(spark, sf_dir).select("s1_id", "src", "cand_id", "label", "score").persist()
    ids, true = c.select("s1_id").distinct(), c.where("label").select("s1_id", "cand_id")
    grid = {"MATCH_THRESHOLD": [0.3, 0.5, 0.7], "RELATIVE_MARGIN": [0.1, 0.3]}
    best, value = training.coordinate_ascent(grid, Params(), lambda p: training.macro_f05(c, ids, true, p), rounds=1)
    return _values(spark, [(best.MATCH_THRESHOLD, best.RELATIVE_MARGIN, round(value, DIGITS))], "threshold double, margin double, macro_f05 double")


def link_rules(spark, sf_dir):
    """The whole pipeline with the rule scorer: documents to match lists."""
    scored = features(spark, sf_dir).withColumn("score", F.round(scoring.rule_score(), DIGITS))
    return scoring.match_lists(_s1(spark, sf_dir), scoring.decide(scored))


def link_blocking(spark, sf_dir):
    """The smallest slice of the pipeline: name-token keys, cap, join, best candidates, one owner, match lists."""
    pairs = b.scored_pairs(keys(spark, sf_dir).where("key like '%|n:%'"), CAP)
    kept = scoring.decide(b.top_union(pairs, CAP).withColumn("score", F.round("block_score", DIGITS)), Params(MATCH_THRESHOLD=0.05, RELATIVE_MARGIN=0.2))
    return scoring.match_lists(_s1(spark, sf_dir), kept)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q_link_blocking": link_blocking,
    "q_ascii_fold": ascii_fold,
    "q_latin_flag": latin_flag,
    "q_skeleton": skeleton,
    "q_leet": leet,
    "q_indic_translate": indic_translate,
    "q_domain_stem": domain_stem,
    "q_strip_long_digits": strip_long_digits,
    "q_abbrev_merge": partial(_token_query, f=t.merge_abbreviations),
    "q_stopword_drop": partial(_token_query, f=t.drop_stopwords),
    "q_translit_legal_drop": _translit_legal,
    "q_drop_long_number": partial(_token_query, f=t.drop_long_numbers),
    "q_adjacent_dedup": partial(_token_query, f=t.drop_repeats),
    "q_name_fallback": name_fallback,
    "q_name_normalize": name_normalize,
    "q_party_names": party_names,
    "q_addr_nonlatin_drop": addr_nonlatin,
    "q_addr_state_drop": addr_states,
    "q_addr_number_split": addr_numbers,
    "q_addr_word": addr_words,
    "q_addr_normalize": addr_normalize,
    "q_country": country,
    "q_hash_sample": hash_sample,
    "q_fold": folds,
    "q_weighted_subsample": weighted_subsample,
    "q_stratified_examples": examples,
    "q_key_token": lambda s, d: _key_query(s, d, lambda: b.token_keys(F.col("n_tokens"))),
    "q_key_pair": lambda s, d: _key_query(s, d, lambda: b.pair_keys(F.col("n_tokens"))),
    "q_key_compact": lambda s, d: _key_query(s, d, lambda: b.compact_keys(F.col("n_compact"))),
    "q_key_skeleton": lambda s, d: _key_query(s, d, lambda: b.skeleton_keys(F.split("n_skel", " "))),
    "q_key_prefix": lambda s, d: _key_query(s, d, lambda: b.prefix_keys(F.col("n_compact"))),
    "q_key_num_word": lambda s, d: _key_query(s, d, lambda: b.number_word_keys(F.col("a_numbers"), F.col("a_words"))),
    "q_key_num_pair": lambda s, d: _key_query(s, d, lambda: b.number_pair_keys(F.col("a_numbers"))),
    "q_key_word_pair": lambda s, d: _key_query(s, d, lambda: b.word_pair_keys(F.col("a_words"))),
    "q_key_all": lambda s, d: keys(s, d),
    "q_key_count": key_count,
    "q_key_cap": key_cap,
    "q_probe_semi": probe_semi,
    "q_block_score": block_score,
    "q_block_topk_union": block_topk,
    "q_candidate_list": candidate_list,
    "q_token_df": token_df,
    "q_idf": idf,
    "q_name_count": name_count,
    "q_addr_count": addr_count,
    "q_s1_vocab": s1_vocab,
    "q_unseen_share": lambda s, d: _expressions(s, d, "unseen", "unseen2"),
    "q_idf_jaccard": lambda s, d: _expressions(s, d, "name_idf", "name_idf_jacc", "name_idf_cont"),
    "q_addr_shared": lambda s, d: _expressions(s, d, "addr", "addr_idf_jacc", "addr_idf_cont", "addr_shared_idf", "addr_missing"),
    "q_num_features": lambda s, d: _expressions(s, d, "num", "num_shared_idf", "num_conflict", "num_c1", "num_c2", "num_reldiff"),
    "q_freq_lookup": lambda s, d: _expressions(s, d, "freq", "name_freq1", "name_freq2", "addr_freq1", "addr_freq2", "s1_name_cnt1", "s1_name_cnt2", "s1_addr_cnt1"),
    "q_flags": lambda s, d: _expressions(s, d, "flags", "translit", "domain", "dom_contain", "dom_init"),
    "q_website_features": website_features,
    "q_indel_ratio": indel,
    "q_indel_ratio_expr": indel_expression,
    "q_token_sort_ratio": token_sort,
    "q_token_set_ratio": token_set,
    "q_partial_ratio": partial_ratio,
    "q_token_align": token_align,
    "q_feature_matrix": feature_matrix,
    "q_part_similarity": part_similarity,
    "q_part_matrix": part_matrix,
    "q_part_scores": part_scores,
    "q_part_links": part_links,
    "q_script_fold": script_fold,
    "q_competition": competition,
    "q_stage2_matrix": stage2_matrix,
    "q_labelled": labelled,
    "q_training_totals": training_totals,
    "q_dictionary_pairs": dictionary_pairs,
    "q_run_files": run_files,
    "q_run_stream": partial(run_files, stream=True),
    "q_run_candidates": run_candidates,
    "q_run_check": run_check,
    "q_rule_name": lambda s, d: _scores(s, d, scoring.name_score),
    "q_rule_addr": lambda s, d: _scores(s, d, lambda: scoring.address_score(Params())),
    "q_rule_score": lambda s, d: _scores(s, d, scoring.rule_score),
    "q_comp_s1": comp_s1,
    "q_comp_record": comp_record,
    "q_threshold": lambda s, d: _decision(s, d, lambda c: c.where(F.col("score") >= Params().MATCH_THRESHOLD)),
    "q_one_owner": lambda s, d: _decision(s, d, scoring.one_owner),
    "q_margin": lambda s, d: _decision(s, d, lambda c: scoring.within_margin(c, 0.2)),
    "q_decide": lambda s, d: _decision(s, d, scoring.decide),
    "q_match_list": match_list,
    "q_prune": prune,
    "q_blocking_recall": blocking_recall,
    "q_f05_entity": f05_entity,
    "q_macro_f05": macro_f05,
    "q_missed_pairs": missed_pairs,
    "q_miss_cause": miss_cause,
    "q_error_cause": error_cause,
    "q_fp_fn": fp_fn,
    "q_validate_results": validate_results,
    "q_validate_candidates": validate_candidates,
    "q_result_summary": result_summary,
    "q_truth_edges": truth_edges,
    "q_raw_lookup": raw_lookup,
    "q_align_counts": align_counts,
    "q_align_argmax": align_argmax,
    "q_tsv_round_trip": tsv_round_trip,
    "q_training_set": training_rows,
    "q_stage1": stage1,
    "q_stage2": stage2,
    "q_oof_folds": oof_folds,
    "q_coord_ascent": coord_ascent,
    "q_link_rules": link_rules,
}
