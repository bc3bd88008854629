"""DuckDB SQL that says what the queries of the catalogue must return.

Written against the definitions, with the relational and list functions of DuckDB; the
parts that several queries share are common table expressions.
"""

from __future__ import annotations

from .. import config
from ..functions.text import SPECIAL_LETTERS, legal_skeletons
from ..operators.features import FEATURES
from . import catalog as c

D = c.DIGITS
CAP = c.CAP
P = config.Params()


def strings(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows) + ")"


def folded(s: str) -> str:
    out = f"lower(strip_accents({s}))"
    for letter, plain in SPECIAL_LETTERS.items():
        out = f"replace({out}, '{letter}', '{plain}')"
    return rf"regexp_replace({out}, '[^\x00-\x7F]', '', 'g')"


def tokens(s: str) -> str:
    return f"list_filter(regexp_split_to_array({s}, '[^a-z0-9]+'), lambda t: t <> '')"


def signs(s: str) -> str:
    return rf"regexp_replace(replace(replace({s}, '&', ' and '), '+', ' '), '\b\d{{6,}}\b', ' ', 'g')"


def leet(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '[a-z]') AND regexp_matches({t}, '[0-9]') THEN translate({t}, '013457', 'oieast') ELSE {t} END"


def merged(ts: str) -> str:
    out = f"array_to_string({ts}, ' ')"
    for spaced in config.ABBREVIATIONS:
        out = rf"regexp_replace({out}, '\b{spaced}\b', '{spaced.replace(' ', '')}', 'g')"
    return f"list_filter(string_split({out}, ' '), lambda t: t <> '')"


STOP = strings([*config.HONORIFICS, *config.LEGAL, "and"])


def unrepeated(ts: str) -> str:
    return f"list_filter({ts}, lambda u, i: i = 1 OR u <> {ts}[i - 1])"


def skeleton(t: str) -> str:
    plain = f"replace(replace(replace(replace({t}, 'ph', 'f'), 'w', 'v'), 'sh', 's'), 'z', 'j')"
    kept = f"string_split(left({plain}, 1) || regexp_replace(substr({plain}, 2), '[aeiouyh]', '', 'g'), '')"
    return f"array_to_string({unrepeated(kept)}, '')"


def stem(s: str) -> str:
    tlds = "|".join(config.TOP_LEVEL_DOMAINS)
    return rf"CASE WHEN contains({s}, '.') THEN regexp_extract(replace({s}, ' ', ''), '^(?:https?://)?(?:www\.)?([a-z0-9\-]+)\.(?:{tlds})(?:\.[a-z]{{2}})?\b', 1) ELSE '' END"


def names(source: str, raw: str, keep: str) -> str:
    """CTEs from ``source`` to ``named``: ``keep`` and n_tokens, n_core, n_compact, n_skel, n_domain, n_translit (for Latin names)."""
    return rf"""
n1 AS (SELECT {keep}, {raw} AS raw, trim({folded(raw)}) AS s FROM {source}),
n2 AS (SELECT *, {stem('s')} AS stem FROM n1),
n3 AS (SELECT *, list_transform({tokens(signs("CASE WHEN stem <> '' THEN stem ELSE s END"))}, lambda t: {leet('t')}) AS ts FROM n2),
n4 AS (SELECT *, {merged('ts')} AS ms FROM n3),
n5 AS (SELECT *, list_filter(ms, lambda t: NOT list_contains({STOP}, t) AND NOT regexp_matches(t, '^[0-9]{{4,}}$')) AS kept FROM n4),
n6 AS (SELECT *, CASE WHEN len(kept) = 0 THEN list_filter(ms, lambda t: t <> 'and')[1:3] ELSE {unrepeated('kept')} END AS n_tokens FROM n5),
named AS (SELECT {keep}, n_tokens, array_to_string(n_tokens, ' ') AS n_core, array_to_string(n_tokens, '') AS n_compact,
  array_to_string(list_transform(n_tokens, lambda t: {skeleton('t')}), ' ') AS n_skel, stem <> '' AS n_domain, false AS n_translit FROM n6)"""


STATES = rf"\b(?:{'|'.join(config.STATE_NAMES)})\b"
STREET = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in config.STREET.items()) + "}"
NOISE = strings([*config.STATE_CODES, *config.ADDRESS_NOISE])


def number(t: str) -> str:
    digits = f"regexp_replace({t}, '[^0-9]', '', 'g')"
    return f"CASE WHEN {digits} <> '' THEN CASE WHEN ltrim({digits}, '0') = '' THEN '0' ELSE ltrim({digits}, '0') END END"


def word(t: str) -> str:
    letters = f"regexp_replace({t}, '[0-9]', '', 'g')"
    mixed = (
        f"CASE WHEN regexp_matches({t}, '^[0-9]+(st|nd|rd|th)?$') THEN NULL WHEN regexp_matches({t}, '[0-9]') THEN CASE WHEN length({letters}) >= 2 THEN {letters} END ELSE {t} END"
    )
    told = f"CASE WHEN NOT list_contains({NOISE}, {mixed}) THEN {mixed} END"
    short = f"coalesce({STREET}[{told}], {told})"
    return f"CASE WHEN length({short}) >= 2 OR {short} IN ('n', 's', 'e', 'w') THEN {short} END"


RAW = r"""
raw AS (SELECT doc_id, 'S' || (doc_id % 3 + 1) AS src, 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id,
  regexp_extract(coalesce(text, ''), '^[^.\n]*') AS business_name,
  length(coalesce(text, '')) || ' ' || regexp_extract(coalesce(text, ''), '[^\n]*\z') AS business_address, substr(lower(coalesce(lang, '')), 1, 2) AS country FROM documents)"""
KEEP = "entity_id, src, country, business_address"
RECORDS = (
    RAW + "," + names("raw", "business_name", KEEP)
    + rf""",
a1 AS (SELECT *, {tokens(f"regexp_replace({folded('business_address')}, '{STATES}', ' ', 'g')")} AS ts FROM named),
a2 AS (SELECT * EXCLUDE (ts), list_sort(list_distinct(list_filter(list_transform(ts, lambda t: {word('t')}), lambda w: w IS NOT NULL))) AS a_words,
  list_sort(list_distinct(list_filter(list_transform(ts, lambda t: {number('t')}), lambda w: w IS NOT NULL))) AS a_numbers FROM a1),
records AS MATERIALIZED (SELECT * EXCLUDE (business_address), array_to_string(a_words, ' ') AS a_text, array_to_string(a_numbers, ' ') AS a_nums,
  len(a_words) = 0 AND len(a_numbers) = 0 AS a_empty FROM a2)"""
)


def combinations(xs: str, head: str) -> str:
    return f"flatten(list_transform({xs}, lambda a, i: list_transform({xs}[i + 1:], lambda b: '{head}:' || a || ':' || b)))"


LONGEST = "list_transform(list_sort(list_transform(a_numbers, lambda x: {'l': -length(x), 'x': x})), lambda s: s.x)[1:3]"
LONG_WORDS = "list_filter(a_words, lambda w: length(w) >= 3)"
KEYS = {
    "q_key_token": "list_transform(list_filter(n_tokens, lambda t: length(t) >= 3), lambda t: 'n:' || t)",
    "q_key_pair": combinations("list_sort(list_distinct(n_tokens[1:6]))", "p"),
    "q_key_compact": "CASE WHEN length(n_compact) >= 2 THEN ['f:' || n_compact] ELSE [] END",
    "q_key_skeleton": "list_transform(list_filter(string_split(n_skel, ' '), lambda t: length(t) >= 3), lambda t: 'k:' || t)",
    "q_key_prefix": "CASE WHEN length(n_compact) >= 4 THEN ['c:' || left(n_compact, 6)] ELSE [] END",
    "q_key_num_word": f"flatten(list_transform({LONGEST}, lambda x: list_transform({LONG_WORDS}[1:8], lambda w: 'a:' || x || ':' || w)))",
    "q_key_num_pair": combinations(f"list_sort({LONGEST})", "aa"),
    "q_key_word_pair": combinations(f"{LONG_WORDS}[1:6]", "w"),
}
_families = {k: "name" if k in ("q_key_token", "q_key_pair", "q_key_compact", "q_key_skeleton", "q_key_prefix") else "addr" for k in KEYS}
KEYED = RECORDS + ",\nkeys AS MATERIALIZED (" + "\n UNION ".join(
    f"SELECT entity_id, src, country || '|' || unnest({sql}) AS key, '{_families[k]}' AS family FROM records" for k, sql in KEYS.items()
) + ")"
USABLE = KEYED + f""",
sizes AS (SELECT src, key, count(*) AS size FROM keys WHERE src <> 'S1' GROUP BY ALL),
usable AS (SELECT keys.*, size, 1.0 / size AS w FROM keys JOIN sizes USING (src, key) WHERE size <= {CAP.max_block})"""
PAIRS = USABLE + """,
pairs AS MATERIALIZED (SELECT k.entity_id AS s1_id, u.src, u.entity_id AS cand_id, sum(CASE WHEN u.family = 'name' THEN w ELSE 0.0 END) AS block_name,
  sum(CASE WHEN u.family = 'addr' THEN w ELSE 0.0 END) AS block_addr FROM keys k JOIN usable u ON k.key = u.key WHERE k.src = 'S1' GROUP BY ALL)"""


def ranked(col: str) -> str:
    return f"row_number() OVER (PARTITION BY s1_id, src ORDER BY round({col}, 9) DESC, cand_id)"


CANDIDATES = PAIRS + f""",
candidates AS MATERIALIZED (SELECT *, block_name + block_addr AS block_score FROM pairs
  QUALIFY ({ranked('block_name')} <= {CAP.top_name} AND block_name > 0) OR ({ranked('block_addr')} <= {CAP.top_addr} AND block_addr > 0)
    OR ({ranked('block_name + block_addr')} <= {CAP.top_total} AND block_name + block_addr > 0))"""
STATS = """,
total AS (SELECT ln(count(*) + 1) AS log_n FROM records),
name_tokens AS (SELECT entity_id, unnest(list_distinct(n_tokens)) AS token FROM records),
addr_tokens AS (SELECT entity_id, unnest(a_words || list_transform(a_numbers, lambda x: '#' || x)) AS token FROM records),
name_df AS (SELECT token, count(*) AS df FROM name_tokens GROUP BY ALL), addr_df AS (SELECT token, count(*) AS df FROM addr_tokens GROUP BY ALL),
vocabulary AS (SELECT DISTINCT token FROM name_tokens WHERE entity_id LIKE 'S1-%'),
name_n AS (SELECT n_compact, count(*) AS n_all, count(*) FILTER (src = 'S1') AS n_s1 FROM records GROUP BY ALL),
addr_n AS (SELECT a_text, a_nums, count(*) AS a_all, count(*) FILTER (src = 'S1') AS a_s1 FROM records WHERE NOT (a_text = '' AND a_nums = '') GROUP BY ALL)"""
WEIGHTED = CANDIDATES + STATS + """,
name_w AS (SELECT entity_id, token, log_n - ln(1 + df) AS w FROM name_tokens JOIN name_df USING (token), total),
addr_w AS (SELECT entity_id, token, log_n - ln(1 + df) AS w FROM addr_tokens JOIN addr_df USING (token), total),
name_sum AS (SELECT entity_id, sum(w) AS w FROM name_w GROUP BY ALL), addr_sum AS (SELECT entity_id, sum(w) AS w FROM addr_w GROUP BY ALL)"""


def overlap(kind: str) -> str:
    return f"""(SELECT s1_id, cand_id, any_value(x.w) AS one, any_value(y.w) AS two, coalesce(any_value(s.w), 0) AS shared FROM candidates c
  LEFT JOIN {kind}_sum x ON x.entity_id = s1_id LEFT JOIN {kind}_sum y ON y.entity_id = cand_id
  LEFT JOIN (SELECT s1_id, cand_id, sum(a.w) AS w FROM candidates JOIN {kind}_w a ON a.entity_id = s1_id JOIN {kind}_w b ON b.entity_id = cand_id AND a.token = b.token GROUP BY ALL) s USING (s1_id, cand_id) GROUP BY ALL)"""


def share(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"


SIDES = "FROM candidates JOIN records l ON l.entity_id = s1_id JOIN records r ON r.entity_id = cand_id"
HERE = "NOT (l.a_empty OR r.a_empty)"
BOTH = f"{HERE} AND len(l.a_numbers) > 0 AND len(r.a_numbers) > 0"
SHARED = "list_intersect(l.a_numbers, r.a_numbers)"
APART = (
    "list_min(list_transform(l.a_numbers[1:6], lambda x: list_min(list_transform(r.a_numbers[1:6], lambda y:"
    " abs(left(x, 9)::DOUBLE - left(y, 9)::DOUBLE) / greatest(left(x, 9)::DOUBLE, left(y, 9)::DOUBLE, 1)))))"
)


def claims_unit(e: str, m: int = 101) -> str:
    return f"round((({e}) % {m}) / {m - 1}.0::DOUBLE, 4)"


CLAIMS = f"""
claims AS MATERIALIZED (SELECT 'S1-' || l_orderkey AS s1_id, CASE WHEN l_linestatus = 'O' THEN 'S2' ELSE 'S3' END AS src,
  (CASE WHEN l_linestatus = 'O' THEN 'S2-' ELSE 'S3-' END) || l_partkey AS cand_id, bool_or(l_returnflag = 'R') AS label,
  max({claims_unit('l_partkey * 31 + l_orderkey * 7 + l_linenumber')}) AS p1, max({claims_unit('l_partkey * 17 + l_linenumber * 5')}) AS name_sort,
  max({claims_unit('l_orderkey * 13 + l_partkey')}) AS name_ratio, max({claims_unit('l_suppkey * 29 + l_orderkey')}) AS name_skel,
  max({claims_unit('l_suppkey * 3 + l_partkey')}) AS name_partial, max({claims_unit('l_orderkey * 11 + l_suppkey')}) AS name_idf_jacc,
  max({claims_unit('l_orderkey * 19 + l_linenumber')}) AS name_tsr, max({claims_unit('l_partkey * 23 + l_orderkey')}) AS addr_idf_jacc,
  max({claims_unit('l_suppkey * 37 + l_linenumber')}) AS addr_sort, max({claims_unit('l_partkey * 41 + l_suppkey')}) AS addr_idf_cont,
  max({claims_unit('l_orderkey + l_partkey')} * 40) AS addr_shared_idf, max((l_partkey % 3 = 0)::INT) AS num_shared_idf, max((l_partkey % 3 = 1)::INT) AS num_conflict,
  max((l_suppkey % 11 = 0)::INT) AS addr_missing, max((l_orderkey % 7 = 0)::INT) AS translit, max((l_partkey % 13 = 0)::INT) AS domain
  FROM lineitem GROUP BY ALL),
named_scores AS (SELECT *, 0.5::DOUBLE * greatest(name_sort, name_ratio, CASE WHEN translit = 1 THEN name_skel ELSE 0 END, CASE WHEN domain = 1 THEN name_partial ELSE 0 END)
    + 0.5::DOUBLE * CASE WHEN translit = 1 THEN greatest(name_idf_jacc, name_skel) ELSE name_idf_jacc END AS name_score,
  least(greatest(0.5::DOUBLE * addr_idf_jacc + 0.5::DOUBLE * addr_sort + {P.NUM_BONUS}::DOUBLE * (num_shared_idf > 0)::INT - {P.NUM_PENALTY}::DOUBLE * num_conflict, 0), 1) AS addr_score FROM claims),
blended AS (SELECT *, CASE WHEN translit = 1 THEN {P.W_NAME_TRANSLIT}::DOUBLE * name_score + (1 - {P.W_NAME_TRANSLIT}::DOUBLE) * addr_score
    ELSE {P.W_NAME}::DOUBLE * name_score + (1 - {P.W_NAME}::DOUBLE) * addr_score END AS blend FROM named_scores),
scored AS MATERIALIZED (SELECT *, round(CASE WHEN addr_missing = 1 THEN CASE WHEN name_score >= {P.NAME_ONLY_THRESHOLD} THEN name_score ELSE 0 END
    WHEN addr_idf_cont >= {P.ADDR_ONLY_CONT} AND addr_shared_idf >= {P.ADDR_ONLY_IDF} THEN greatest(blend, {P.MATCH_THRESHOLD}::DOUBLE + 0.01::DOUBLE * addr_score) ELSE blend END, {D}) AS score FROM blended)"""
OWNER = "row_number() OVER (PARTITION BY src, cand_id ORDER BY score DESC, s1_id) = 1"
KEPT = CLAIMS + f""",
owned AS (SELECT * FROM scored WHERE score >= {P.MATCH_THRESHOLD} QUALIFY {OWNER}),
kept AS (SELECT * FROM owned QUALIFY score >= max(score) OVER (PARTITION BY s1_id) - {P.RELATIVE_MARGIN}::DOUBLE)"""
ENTITIES = KEPT + """,
entities AS (SELECT s1_id, tp, n_pred, n_true, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0::DOUBLE WHEN tp = 0 THEN 0
    ELSE 1.25::DOUBLE * (tp / n_pred) * (tp / n_true) / (0.25::DOUBLE * (tp / n_pred) + tp / n_true) END AS f05
  FROM (SELECT c.s1_id, count(*) FILTER (c.label AND k.cand_id IS NOT NULL) AS tp, count(k.cand_id) AS n_pred, count(*) FILTER (c.label) AS n_true
        FROM claims c LEFT JOIN kept k USING (s1_id, src, cand_id) GROUP BY ALL))"""
DECIDED = KEPT + """,
decided AS (SELECT s.*, k.s1_id IS NOT NULL AS kept FROM scored s LEFT JOIN kept k USING (s1_id, src, cand_id)),
wrong AS (SELECT *, CASE WHEN kept THEN 'FP' ELSE 'FN' END AS kind, CASE WHEN addr_missing = 1 THEN 'address missing' WHEN translit = 1 THEN 'transliterated name'
    WHEN domain = 1 THEN 'website-style name' WHEN name_tsr < 0.5 THEN 'random/unrelated name (tsr<.5)' WHEN num_conflict = 1 THEN 'house-number conflict'
    WHEN name_tsr < 0.9 AND addr_idf_jacc >= 0.5 THEN 'look-alike name, same address' WHEN name_tsr >= 0.9 AND addr_idf_jacc < 0.5 THEN 'same name, different address'
    WHEN name_tsr >= 0.9 THEN 'near-identical (name & address)' ELSE 'other' END AS cause FROM decided WHERE kept <> label)"""
TRUTH = """
truth AS (SELECT 'S1-' || a.doc_id AS s1_id, 'S' || (b.doc_id % 3 + 1) || '-' || b.doc_id AS cand_id
  FROM (SELECT text, min(doc_id) AS doc_id FROM (SELECT coalesce(text, '') AS text, doc_id FROM documents) WHERE doc_id % 3 = 0 GROUP BY ALL) a
  JOIN documents b ON a.text = coalesce(b.text, '') AND b.doc_id % 3 <> 0)"""
RESULTS = """
results AS (SELECT (CASE WHEN o_orderkey % 101 = 0 THEN 'X-' ELSE 'S1-' END) || (CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey - 1 ELSE o_orderkey END) AS s1_id,
  CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN other || ',' || other WHEN o_orderkey % 19 = 0 THEN other || ',' WHEN o_orderkey % 23 = 0 THEN 'S9-' || o_orderkey ELSE other END AS ids
  FROM (SELECT *, (CASE WHEN o_custkey % 2 = 0 THEN 'S2-' ELSE 'S3-' END) || o_custkey AS other FROM orders)),
elements AS (SELECT s1_id, ids, unnest(string_split(ids, ',')) AS x FROM results WHERE ids <> ''),
edges AS (SELECT DISTINCT s1_id, x AS cand_id FROM elements WHERE x <> ''),
known_others AS (SELECT (CASE WHEN c_custkey % 2 = 0 THEN 'S2-' ELSE 'S3-' END) || c_custkey AS cand_id FROM customer),
known_s1 AS (SELECT 'S1-' || o_orderkey AS s1_id FROM orders)"""
CHECKS = {
    "duplicate_s1_rows": "SELECT s1_id FROM results GROUP BY s1_id HAVING count(*) > 1",
    "empty_elements": "SELECT 1 FROM results WHERE ids <> '' AND list_contains(string_split(ids, ','), '')",
    "missing_s1": "SELECT * FROM known_s1 ANTI JOIN results USING (s1_id)",
    "unknown_s1": "SELECT DISTINCT s1_id FROM results ANTI JOIN known_s1 USING (s1_id)",
    "malformed_s1": r"SELECT 1 FROM results WHERE NOT regexp_matches(s1_id, '^S1-\d+$')",
    "repeated_in_row": "SELECT DISTINCT s1_id FROM (SELECT s1_id, x FROM elements WHERE x <> '' GROUP BY ALL HAVING count(*) > 1)",
    "unknown_match": "SELECT * FROM edges ANTI JOIN known_others USING (cand_id)",
    "two_owners": "SELECT cand_id FROM edges GROUP BY cand_id HAVING count(*) > 1",
}


def checks(more: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) AS violations FROM ({sql})" for k, sql in (CHECKS | more).items())


def common(a: str, b: str) -> str:
    """Length of the longest common subsequence, by rows of the dynamic programme."""
    start = f"list_transform(range(length({b}) + 1), lambda z: 0::BIGINT)"
    cell = f"CASE WHEN substr({b}, j, 1) = substr({a}, e[1], 1) THEN d[j] + 1 ELSE greatest(d[j + 1], acc[-1]) END"
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda k: [k]), lambda acc, ks: list_append(acc, {cell.replace('j', 'ks[1]')}), [0::BIGINT])"
    return f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [i]), lambda d, e: {row}, {start})[-1]"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * {common(a, b)} / (length({a}) + length({b})) END"


def crc(s: str) -> str:
    """CRC-32 of an ASCII string: eight shifts a byte."""
    byte = "list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END, xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({s}, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"


def subsample(hard: str) -> str:
    key = "s1_id || '|' || src || '|' || cand_id"
    return f"WITH {CLAIMS} SELECT s1_id, src, cand_id, label, p1, CASE WHEN {hard} THEN 1.0 ELSE 10.0 END::DOUBLE AS weight FROM claims WHERE {hard} OR {crc(key)} % 10 = 0"


PART_PAIRS = """
names AS (SELECT DISTINCT p_name FROM part),
part_pairs AS MATERIALIZED (SELECT x.p_name AS a, y.p_name AS b FROM names x JOIN names y ON x.p_name <= y.p_name AND list_has_any(string_split(x.p_name, ' '), string_split(y.p_name, ' '))
  UNION ALL SELECT * FROM (VALUES ('limited', 'limitteed'), ('2204', '204'), ('131', '31'), ('405', '406'), ('', ''), ('', 'abc')))"""
NAMES = values([(i, n) for i, n in enumerate(c.NAMES)])
ADDRESSES = values([(i, a) for i, a in enumerate(c.ADDRESSES)])
NON_LATIN_PIECE = r"[^\s\x{A0},]*[\p{Devanagari}\p{Telugu}][^\s\x{A0},]*"
ALL_TOKENS = f"SELECT DISTINCT unnest({tokens(folded('text'))}) AS token FROM documents"
FOLDED_ADDRESSES = f"""
folded AS (SELECT doc_id AS id, {folded("coalesce(text, '')")} AS s FROM documents
  UNION ALL SELECT -1 - i, {folded(f"regexp_replace(a, '{NON_LATIN_PIECE}', '', 'g')")} FROM {ADDRESSES} v(i, a))"""


def token_step(f) -> str:
    return f"""SELECT id, len(o) AS tokens, md5(array_to_string(o, ' ')) AS digest FROM (SELECT id, {f('ts')} AS o FROM (
  SELECT doc_id AS id, {tokens(folded("coalesce(text, '')"))} AS ts FROM documents UNION ALL SELECT -1 - i, {tokens(folded('n'))} FROM {NAMES} v(i, n)))"""


PART_RAW = """
raw AS (SELECT 'S' || (p_partkey % 3 + 1) AS src, 'S' || (p_partkey % 3 + 1) || '-' || p_partkey AS entity_id, p_name AS business_name,
  p_size || ' ' || p_type || ' ' || p_brand AS business_address, 'us' AS country FROM part)"""


def set_ratio(a: str, b: str, source: str) -> str:
    """``a, b, r``: token-set ratios of different strings."""
    return f"""(SELECT {a} AS a, {b} AS b, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 WHEN i <> '' AND (l = '' OR r = '') THEN 1 WHEN i = '' THEN {ratio('l', 'r')}
  ELSE greatest({ratio('il', 'ir')}, {ratio('i', 'il')}, {ratio('i', 'ir')}) END AS r FROM (SELECT *, trim(i || ' ' || l) AS il, trim(i || ' ' || r) AS ir FROM (
    SELECT *, array_to_string(list_sort(list_intersect(x, y)), ' ') AS i, array_to_string(list_sort(list_filter(x, lambda t: NOT list_contains(y, t))), ' ') AS l, array_to_string(list_sort(list_filter(y, lambda t: NOT list_contains(x, t))), ' ') AS r FROM (
      SELECT *, list_filter(list_distinct(string_split({a}, ' ')), lambda t: t <> '') AS x, list_filter(list_distinct(string_split({b}, ' ')), lambda t: t <> '') AS y FROM {source}))))"""


def sort_words(s: str) -> str:
    return f"array_to_string(list_sort(string_split({s}, ' ')), ' ')"


#: All features of the parts' candidate pairs; strings that differ are compared once.
PART_FEATURES = WEIGHTED.replace(RAW, PART_RAW) + f""",
pair AS MATERIALIZED (SELECT c.*, l.n_core AS core1, r.n_core AS core2, l.n_compact AS comp1, r.n_compact AS comp2, l.n_skel AS skel1, r.n_skel AS skel2, l.a_text AS text1, r.a_text AS text2,
  l.a_nums AS nums1, r.a_nums AS nums2, list_distinct(l.n_tokens) AS set1, list_distinct(r.n_tokens) AS set2, l.a_numbers AS num1, r.a_numbers AS num2, {HERE} AS here
  FROM candidates c JOIN records l ON l.entity_id = s1_id JOIN records r ON r.entity_id = cand_id),
sets AS MATERIALIZED {set_ratio('sa', 'sb', '(SELECT core1 AS sa, core2 AS sb FROM pair UNION SELECT skel1, skel2 FROM pair UNION SELECT text1, text2 FROM pair)')},
sorts AS MATERIALIZED (SELECT a, b, {ratio('sa', 'sb')} AS r FROM (SELECT a, b, {sort_words('a')} AS sa, {sort_words('b')} AS sb FROM (SELECT core1 AS a, core2 AS b FROM pair UNION SELECT text1, text2 FROM pair))),
compacts AS MATERIALIZED (SELECT DISTINCT comp1 AS a, comp2 AS b FROM pair),
plains AS MATERIALIZED (SELECT a, b, {ratio('a', 'b')} AS r FROM compacts),
sides AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM compacts UNION SELECT a, b, b, a FROM compacts WHERE length(a) = length(b)),
cut AS (SELECT a, b, s, substr(l, greatest(i, 0)::INT + 1, (least(i + length(s), length(l)) - greatest(i, 0))::INT) AS w FROM (SELECT a, b, s, unnest(range(1 - length(s), length(l))) AS i, l FROM sides WHERE s <> '')),
partials AS MATERIALIZED (SELECT a, b, max({ratio('s', 'w')}) AS r FROM cut GROUP BY a, b),
numbers AS MATERIALIZED (SELECT a, b, {ratio('a', 'b')} AS r FROM (SELECT DISTINCT a, unnest(num2[1:6]) AS b FROM (SELECT unnest(num1[1:6]) AS a, num2 FROM (SELECT DISTINCT num1, num2 FROM pair)))),
digits AS (SELECT num1 AS d1, num2 AS d2, max(r) AS r FROM (SELECT num1, num2, a, unnest(num2[1:6]) AS b FROM (SELECT num1, num2, unnest(num1[1:6]) AS a FROM (SELECT DISTINCT num1, num2 FROM pair))) JOIN numbers USING (a, b) GROUP BY num1, num2),
met AS MATERIALIZED (SELECT set1, set2, a, unnest(set2) AS b FROM (SELECT set1, set2, unnest(set1) AS a FROM (SELECT DISTINCT set1, set2 FROM pair))),
words AS MATERIALIZED (SELECT a, b, {ratio('a', 'b')} AS r FROM (SELECT DISTINCT a, b FROM met)),
best1 AS (SELECT set1, set2, a AS token, max(r) AS r FROM met JOIN words USING (a, b) GROUP BY ALL), best2 AS (SELECT set1, set2, b AS token, max(r) AS r FROM met JOIN words USING (a, b) GROUP BY ALL),
idfs AS (SELECT token, log_n - ln(1 + df) AS w FROM name_df, total),
lone1 AS (SELECT set1, set2, sum(r) AS s, count(*) AS n, count(*) FILTER (r < 0.75) AS u, coalesce(max(w) FILTER (r < 0.75), 0) AS w FROM best1 JOIN idfs USING (token) GROUP BY ALL),
lone2 AS (SELECT set1, set2, sum(r) AS s, count(*) AS n, count(*) FILTER (r < 0.75) AS u, coalesce(max(w) FILTER (r < 0.75), 0) AS w FROM best2 JOIN idfs USING (token) GROUP BY ALL),
rarest AS (SELECT s1_id, cand_id, max(a.w) AS w FROM candidates JOIN addr_w a ON a.entity_id = s1_id JOIN addr_w b ON b.entity_id = cand_id AND a.token = b.token WHERE a.token LIKE '#%' GROUP BY ALL),
strangers AS (SELECT entity_id, count(*) FILTER (v.token IS NULL) / count(*) AS u FROM name_tokens n LEFT JOIN vocabulary v ON v.token = n.token GROUP BY ALL),
feats AS MATERIALIZED (SELECT p.s1_id, p.src, p.cand_id, block_score, block_name, block_addr, t1.r AS name_tsr, o1.r AS name_sort, f.r AS name_ratio, coalesce(q.r, (comp1 = comp2)::INT) AS name_partial, t2.r AS name_skel, t3.r AS addr_tsr, o2.r AS addr_sort,
  {share('n.shared', '(coalesce(n.one, 0) + coalesce(n.two, 0) - n.shared)')} AS name_idf_jacc, {share('n.shared', 'least(coalesce(n.one, 0), coalesce(n.two, 0))')} AS name_idf_cont,
  CASE WHEN here THEN {share('m.shared', '(coalesce(m.one, 0) + coalesce(m.two, 0) - m.shared)')} ELSE 0 END AS addr_idf_jacc, CASE WHEN here THEN {share('m.shared', 'least(coalesce(m.one, 0), coalesce(m.two, 0))')} ELSE 0 END AS addr_idf_cont,
  CASE WHEN here THEN m.shared ELSE 0 END AS addr_shared_idf, CASE WHEN here THEN coalesce(x.w, 0) ELSE 0 END AS num_shared_idf,
  (here AND len(num1) > 0 AND len(num2) > 0 AND len(list_intersect(num1, num2)) = 0)::INT AS num_conflict, (NOT here)::INT AS addr_missing,
  CASE WHEN here AND len(num1) > 0 AND len(num2) > 0 THEN len(list_intersect(num1, num2)) / len(num1) ELSE -1 END AS num_c1, CASE WHEN here AND len(num1) > 0 AND len(num2) > 0 THEN len(list_intersect(num1, num2)) / len(num2) ELSE -1 END AS num_c2,
  CASE WHEN here AND len(num1) > 0 AND len(num2) > 0 THEN least({APART.replace('l.a_numbers', 'num1').replace('r.a_numbers', 'num2')}, 1) ELSE 1 END AS num_reldiff,
  CASE WHEN here THEN coalesce(g.r, 0) ELSE 0 END AS num_digitsim, coalesce(u1.u, 0) AS tok_un1, coalesce(u2.u, 0) AS tok_un2, coalesce(u1.w, 0) AS tok_un1_idf, coalesce(u2.w, 0) AS tok_un2_idf,
  coalesce((u1.s + u2.s) / (u1.n + u2.n), 0) AS tok_align, coalesce(k.u, 0) AS unseen2, 0 AS dom_contain, 0 AS dom_init, ln(1 + n1.n_all) AS name_freq1, ln(1 + n2.n_all) AS name_freq2,
  ln(1 + coalesce(a1.a_all, 0)) AS addr_freq1, ln(1 + coalesce(a2.a_all, 0)) AS addr_freq2, ln(1 + n1.n_s1) AS s1_name_cnt1, ln(1 + n2.n_s1) AS s1_name_cnt2, ln(1 + coalesce(a1.a_s1, 0)) AS s1_addr_cnt1, 0 AS translit, 0 AS domain
  FROM pair p JOIN sets t1 ON t1.a = core1 AND t1.b = core2 JOIN sets t2 ON t2.a = skel1 AND t2.b = skel2 JOIN sets t3 ON t3.a = text1 AND t3.b = text2
  JOIN sorts o1 ON o1.a = core1 AND o1.b = core2 JOIN sorts o2 ON o2.a = text1 AND o2.b = text2 JOIN plains f ON f.a = comp1 AND f.b = comp2 LEFT JOIN partials q ON q.a = comp1 AND q.b = comp2
  LEFT JOIN digits g ON d1 = num1 AND d2 = num2 LEFT JOIN lone1 u1 ON u1.set1 = p.set1 AND u1.set2 = p.set2 LEFT JOIN lone2 u2 ON u2.set1 = p.set1 AND u2.set2 = p.set2
  JOIN {overlap('name')} n ON n.s1_id = p.s1_id AND n.cand_id = p.cand_id JOIN {overlap('addr')} m ON m.s1_id = p.s1_id AND m.cand_id = p.cand_id LEFT JOIN rarest x ON x.s1_id = p.s1_id AND x.cand_id = p.cand_id
  LEFT JOIN strangers k ON k.entity_id = p.cand_id JOIN name_n n1 ON n1.n_compact = comp1 JOIN name_n n2 ON n2.n_compact = comp2
  LEFT JOIN addr_n a1 ON a1.a_text = text1 AND a1.a_nums = nums1 LEFT JOIN addr_n a2 ON a2.a_text = text2 AND a2.a_nums = nums2)"""
#: The rules over these; no part has a transliterated or website-style name, and both sides of names are known.
PART_SCORED = PART_FEATURES + f""",
halves AS (SELECT *, 0.5::DOUBLE * greatest(name_sort, name_ratio) + 0.5::DOUBLE * name_idf_jacc AS name_score,
  least(greatest(0.5::DOUBLE * addr_idf_jacc + 0.5::DOUBLE * addr_sort + {P.NUM_BONUS}::DOUBLE * (num_shared_idf > 0)::INT - {P.NUM_PENALTY}::DOUBLE * num_conflict, 0), 1) AS addr_score FROM feats),
scored AS MATERIALIZED (SELECT s1_id, src, cand_id, name_score, addr_score, round(CASE WHEN addr_missing = 1 THEN CASE WHEN name_score >= {P.NAME_ONLY_THRESHOLD} THEN name_score ELSE 0 END
    WHEN addr_idf_cont >= {P.ADDR_ONLY_CONT} AND addr_shared_idf >= {P.ADDR_ONLY_IDF} THEN greatest(blend, {P.MATCH_THRESHOLD}::DOUBLE + 0.01::DOUBLE * addr_score) ELSE blend END, {D}) AS score
  FROM (SELECT *, {P.W_NAME}::DOUBLE * name_score + (1 - {P.W_NAME}::DOUBLE) * addr_score AS blend FROM halves))"""


def rounded(*columns: str) -> str:
    return ", ".join(f"round({x}, {D}) AS {x}" for x in columns)


def step(name: str, before: str, column: str, value: float) -> str:
    """One trial of the coordinate ascent: takes ``value`` if it gains more than the least."""
    where = f"g.t = {value} AND g.m = b.m" if column == "t" else f"g.t = b.t AND g.m = {value}"
    return f"{name} AS (SELECT unnest(CASE WHEN g.f > b.f + 1e-5 THEN {{'t': g.t, 'm': g.m, 'f': g.f}} ELSE {{'t': b.t, 'm': b.m, 'f': b.f}} END) FROM {before} b, f g WHERE {where})"


ASCENT = CLAIMS + """,
grid AS (SELECT t, m FROM (VALUES (0.3::DOUBLE), (0.5), (0.7)) x(t), (VALUES (0.1::DOUBLE), (0.2), (0.3)) y(m)),
owned AS (SELECT t, s.* FROM scored s, (SELECT DISTINCT t FROM grid) WHERE score >= t QUALIFY row_number() OVER (PARTITION BY t, src, cand_id ORDER BY score DESC, s1_id) = 1),
kept AS (SELECT t, m, s1_id, label FROM owned JOIN grid USING (t) QUALIFY score >= max(score) OVER (PARTITION BY t, m, s1_id) - m),
found AS (SELECT t, m, s1_id, count(*) AS n_pred, count(*) FILTER (label) AS tp FROM kept GROUP BY ALL),
truths AS (SELECT s1_id, count(*) FILTER (label) AS n_true FROM claims GROUP BY ALL),
f AS (SELECT t, m, avg(CASE WHEN coalesce(n_pred, 0) = 0 AND n_true = 0 THEN 1.0::DOUBLE WHEN coalesce(tp, 0) = 0 THEN 0
    ELSE 1.25::DOUBLE * (tp / n_pred) * (tp / n_true) / (0.25::DOUBLE * (tp / n_pred) + tp / n_true) END) AS f
  FROM grid CROSS JOIN truths LEFT JOIN found USING (t, m, s1_id) GROUP BY t, m),
b0 AS (SELECT * FROM f WHERE t = 0.7 AND m = 0.2), """ + ", ".join(
    step(f"b{i + 1}", f"b{i}", column, value) for i, (column, value) in enumerate([("t", 0.3), ("t", 0.5), ("t", 0.7), ("m", 0.1), ("m", 0.3)])
)
INDIC = values(c.INDIC_PAIRS)
PIECE = r"[^\s\x{A0},()\[\]/.&+\-]+"
ALIGNED = f"""
pairs AS (SELECT regexp_extract_all(o, '{PIECE}') AS xs, regexp_extract_all(n, '{PIECE}') AS ys FROM {INDIC} v(o, n)),
each AS (SELECT unnest(xs) AS x, unnest(ys) AS y FROM pairs WHERE len(xs) = len(ys)),
aligned AS (SELECT x, lower(y) AS y, count(*) AS c FROM each WHERE regexp_matches(x, '[\\x{{900}}-\\x{{D7F}}]') AND NOT regexp_matches(y, '[\\x{{900}}-\\x{{D7F}}]') GROUP BY ALL)""".replace("\\\\", "\\")

PART_LINKS = f"""WITH {PART_SCORED}, owned AS (SELECT * FROM scored WHERE score >= {P.MATCH_THRESHOLD} QUALIFY {OWNER}), kept AS (SELECT * FROM owned QUALIFY score >= max(score) OVER (PARTITION BY s1_id) - {P.RELATIVE_MARGIN}::DOUBLE)
SELECT entity_id AS s1_id, coalesce(m, '') AS matched_ids FROM records LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY score DESC, src, cand_id) AS m FROM kept GROUP BY ALL) ON s1_id = entity_id WHERE src = 'S1'"""

SQL: dict[str, str] = {
    "q_link_blocking": "WITH " + PAIRS.replace("WHERE k.src = 'S1'", "WHERE k.src = 'S1' AND k.key LIKE '%|n:%'") + f""",
top AS (SELECT *, round(block_name, {D}) AS score FROM pairs QUALIFY ({ranked('block_name')} <= {CAP.top_name} AND block_name > 0) OR ({ranked('block_name')} <= {CAP.top_total} AND block_name > 0)),
owned AS (SELECT * FROM top WHERE score >= 0.05 QUALIFY {OWNER}),
kept AS (SELECT * FROM owned QUALIFY score >= max(score) OVER (PARTITION BY s1_id) - 0.2::DOUBLE)
SELECT entity_id AS s1_id, coalesce(m, '') AS matched_ids FROM records LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY score DESC, src, cand_id) AS m FROM kept GROUP BY ALL) ON s1_id = entity_id WHERE src = 'S1'""",
    "q_ascii_fold": f"SELECT doc_id, length(f) AS chars, md5(f) AS digest FROM (SELECT doc_id, {folded('coalesce(text, chr(0)[1:0])')} AS f FROM documents)".replace("chr(0)[1:0]", "''"),
    "q_latin_flag": rf"""SELECT NOT regexp_matches(regexp_replace(s, '\p{{Latin}}', '', 'g'), '\p{{L}}') AS latin, regexp_matches(s, '[\x{{900}}-\x{{D7F}}]') AS indic, count(*) AS n
FROM (SELECT coalesce(text, '') AS s FROM documents UNION ALL SELECT o FROM {INDIC} v(o, n)) GROUP BY ALL""",
    "q_skeleton": f"SELECT token, {skeleton('token')} AS skeleton FROM ({ALL_TOKENS})",
    "q_leet": f"SELECT token, {leet('token')} AS fixed FROM ({ALL_TOKENS} UNION SELECT unnest(['h0rizon', '5mart', '8est', '123', 'c0m']))",
    "q_indic_translate": rf"""SELECT o AS s, CASE WHEN regexp_matches(o, '[\x{{900}}-\x{{D7F}}]') THEN array_to_string(list_transform(string_split(o, ' '), lambda w: coalesce(MAP {{'जैन': 'jain', 'श्री': 'sree', 'टेक': 'tech'}}[w], w)), ' ') ELSE o END AS translated FROM {INDIC} v(o, n)""",
    "q_domain_stem": f"SELECT s, {stem('s')} AS stem FROM (SELECT lower(url) AS s FROM pages UNION SELECT lower(n) FROM {NAMES} v(i, n))",
    "q_strip_long_digits": f"SELECT doc_id, length(f) AS chars, md5(f) AS digest FROM (SELECT doc_id, {signs(folded('text'))} AS f FROM documents)",
    "q_abbrev_merge": token_step(merged),
    "q_stopword_drop": token_step(lambda ts: f"list_filter({ts}, lambda t: NOT list_contains({STOP}, t))"),
    "q_translit_legal_drop": f"SELECT token, CASE WHEN list_contains({strings(legal_skeletons())}, {skeleton('token')}) THEN 0 ELSE 1 END::BIGINT AS kept FROM (SELECT unnest(['praaivett', 'limittedd', 'praa', 'li', 'jain', 'kmpnii', 'gloobl']) AS token)",
    "q_drop_long_number": token_step(lambda ts: f"list_filter({ts}, lambda t: NOT regexp_matches(t, '^[0-9]{{4,}}$'))"),
    "q_adjacent_dedup": token_step(unrepeated),
    "q_name_fallback": "WITH src AS (SELECT unnest(['Inc  Ltd', 'The Ltd And Corp', 'Shri Plc Inc Co', 'and', '', 'Apex Ltd']) AS business_name)," + names("src", "business_name", "business_name") + " SELECT business_name, n_core FROM named",
    "q_name_normalize": "WITH " + RAW + "," + names("raw", "business_name", KEEP) + " SELECT entity_id, n_core, n_compact, n_skel, n_domain, n_translit FROM named",
    "q_party_names": f"WITH src AS (SELECT c_name AS business_name FROM customer UNION SELECT s_name FROM supplier UNION SELECT p_name FROM part UNION SELECT n FROM {NAMES} v(i, n))," + names("src", "business_name", "business_name") + " SELECT business_name, n_core, n_compact, n_skel, n_domain FROM named",
    "q_addr_nonlatin_drop": f"SELECT s, regexp_replace(s, '{NON_LATIN_PIECE}', '', 'g') AS kept FROM {values([(a,) for a in [*c.ADDRESSES, 'Delhi, दिल्ली road', 'a, b']])} v(s)",
    "q_addr_state_drop": f"WITH {FOLDED_ADDRESSES} SELECT id, length(t) AS chars, md5(t) AS digest FROM (SELECT id, regexp_replace(s, '{STATES}', ' ', 'g') AS t FROM folded)",
    "q_addr_number_split": f"WITH {FOLDED_ADDRESSES} SELECT token, {number('token')} AS number FROM (SELECT DISTINCT unnest({tokens('s')}) AS token FROM folded) WHERE regexp_matches(token, '[0-9]')",
    "q_addr_word": f"WITH {FOLDED_ADDRESSES} SELECT token, {word('token')} AS word FROM (SELECT DISTINCT unnest({tokens('s')}) AS token FROM folded)",
    "q_addr_normalize": f"WITH {RECORDS} SELECT entity_id, a_text, a_nums, a_empty FROM records",
    "q_country": "SELECT raw, substr(lower(raw), 1, 2) AS country, count(*) AS n FROM (SELECT n_name AS raw FROM nation UNION ALL SELECT lang FROM documents) GROUP BY ALL",
    "q_hash_sample": f"WITH {RAW} SELECT entity_id, {crc("entity_id || '#sample'")} % 20 = 0 AS sampled FROM raw",
    "q_fold": f"WITH {RAW} SELECT entity_id, (({crc('entity_id')} >> 11) & 1)::INT AS fold FROM raw",
    "q_weighted_subsample": subsample("(label OR p1 >= 0.9)"),
    "q_training_set": subsample("(label OR p1 >= 0.005)"),
    "q_stratified_examples": f"WITH {DECIDED} SELECT kind || ': ' || cause AS g, s1_id, cand_id FROM wrong QUALIFY row_number() OVER (PARTITION BY kind, cause ORDER BY md5(s1_id || '|' || cand_id), s1_id || '|' || cand_id) <= 12",
    **{k: f"WITH {RECORDS} SELECT entity_id, unnest(list_distinct({sql})) AS key FROM records" for k, sql in KEYS.items()},
    "q_key_all": f"WITH {KEYED} SELECT entity_id, src, key, family FROM keys",
    "q_key_count": f"WITH {USABLE} SELECT src, key, size FROM sizes",
    "q_key_cap": f"WITH {USABLE} SELECT src, key, entity_id, size, round(w, {D}) AS w FROM usable",
    "q_probe_semi": f"WITH {USABLE} SELECT entity_id, key, family FROM keys SEMI JOIN usable USING (key) WHERE src = 'S1'",
    "q_block_score": f"WITH {PAIRS} SELECT s1_id, src, cand_id, {rounded('block_name', 'block_addr')}, round(block_name + block_addr, {D}) AS block_score FROM pairs",
    "q_block_topk_union": f"WITH {CANDIDATES} SELECT s1_id, src, cand_id, {rounded('block_name', 'block_addr', 'block_score')} FROM candidates",
    "q_candidate_list": f"WITH {CANDIDATES} SELECT entity_id AS s1_id, coalesce(m, '') AS candidate_ids FROM records LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY src, cand_id) AS m FROM candidates GROUP BY ALL) ON s1_id = entity_id WHERE src = 'S1'",
    "q_token_df": f"WITH {RECORDS} {STATS} SELECT token, df, 'name' AS kind FROM name_df UNION ALL SELECT token, df, 'addr' FROM addr_df",
    "q_idf": f"WITH {RECORDS} {STATS} SELECT token, df, round(log_n - ln(1 + df), {D}) AS idf FROM name_df, total",
    "q_name_count": f"WITH {RECORDS} {STATS} SELECT * FROM name_n",
    "q_addr_count": f"WITH {RECORDS} {STATS} SELECT * FROM addr_n",
    "q_s1_vocab": f"WITH {RECORDS} {STATS} SELECT token FROM vocabulary",
    "q_unseen_share": f"WITH {CANDIDATES} {STATS}, unseen AS (SELECT entity_id, count(*) FILTER (v.token IS NULL) / count(*) AS u FROM name_tokens n LEFT JOIN vocabulary v ON v.token = n.token GROUP BY ALL) SELECT s1_id, src, cand_id, round(coalesce(u, 0), {D}) AS unseen2 FROM candidates LEFT JOIN unseen ON entity_id = cand_id",
    "q_idf_jaccard": f"WITH {WEIGHTED} SELECT s1_id, c.src, cand_id, round({share('shared', '(coalesce(one, 0) + coalesce(two, 0) - shared)')}, {D}) AS name_idf_jacc, round({share('shared', 'least(coalesce(one, 0), coalesce(two, 0))')}, {D}) AS name_idf_cont FROM candidates c JOIN {overlap('name')} o USING (s1_id, cand_id)",
    "q_addr_shared": f"WITH {WEIGHTED} SELECT s1_id, c.src, cand_id, round(CASE WHEN here THEN {share('shared', '(coalesce(one, 0) + coalesce(two, 0) - shared)')} ELSE 0 END, {D}) AS addr_idf_jacc, round(CASE WHEN here THEN {share('shared', 'least(coalesce(one, 0), coalesce(two, 0))')} ELSE 0 END, {D}) AS addr_idf_cont, round(CASE WHEN here THEN shared ELSE 0 END, {D}) AS addr_shared_idf, (NOT here)::INT::DOUBLE AS addr_missing FROM candidates c JOIN {overlap('addr')} o USING (s1_id, cand_id) JOIN (SELECT s1_id, cand_id, {HERE} AS here {SIDES}) h USING (s1_id, cand_id)",
    "q_num_features": f"""WITH {WEIGHTED}, rarest AS (SELECT s1_id, cand_id, max(a.w) AS w FROM candidates JOIN addr_w a ON a.entity_id = s1_id JOIN addr_w b ON b.entity_id = cand_id AND a.token = b.token WHERE a.token LIKE '#%' GROUP BY ALL)
SELECT x.*, round(CASE WHEN here THEN coalesce(w, 0) ELSE 0 END, {D}) AS num_shared_idf FROM (SELECT s1_id, candidates.src, cand_id, ({BOTH} AND len({SHARED}) = 0)::INT::DOUBLE AS num_conflict,
  round(CASE WHEN {BOTH} THEN len({SHARED}) / len(l.a_numbers) ELSE -1 END, {D}) AS num_c1, round(CASE WHEN {BOTH} THEN len({SHARED}) / len(r.a_numbers) ELSE -1 END, {D}) AS num_c2,
  round(CASE WHEN {BOTH} THEN least({APART}, 1) ELSE 1 END, {D}) AS num_reldiff {SIDES}) x LEFT JOIN rarest USING (s1_id, cand_id) JOIN (SELECT s1_id, cand_id, {HERE} AS here {SIDES}) h USING (s1_id, cand_id)""",
    "q_freq_lookup": f"""WITH {CANDIDATES} {STATS} SELECT s1_id, candidates.src, cand_id, round(ln(1 + n1.n_all), {D}) AS name_freq1, round(ln(1 + n2.n_all), {D}) AS name_freq2, round(ln(1 + coalesce(a1.a_all, 0)), {D}) AS addr_freq1, round(ln(1 + coalesce(a2.a_all, 0)), {D}) AS addr_freq2,
  round(ln(1 + n1.n_s1), {D}) AS s1_name_cnt1, round(ln(1 + n2.n_s1), {D}) AS s1_name_cnt2, round(ln(1 + coalesce(a1.a_s1, 0)), {D}) AS s1_addr_cnt1 {SIDES}
  JOIN name_n n1 ON n1.n_compact = l.n_compact JOIN name_n n2 ON n2.n_compact = r.n_compact LEFT JOIN addr_n a1 ON a1.a_text = l.a_text AND a1.a_nums = l.a_nums LEFT JOIN addr_n a2 ON a2.a_text = r.a_text AND a2.a_nums = r.a_nums""",
    "q_flags": f"WITH {CANDIDATES} SELECT s1_id, src, cand_id, 0.0::DOUBLE AS translit, 0.0::DOUBLE AS domain, 0.0::DOUBLE AS dom_contain, 0.0::DOUBLE AS dom_init FROM candidates",
    "q_website_features": rf"WITH src AS (SELECT DISTINCT replace(regexp_extract(url, '^https?://(?:www\.|m\.)?([^/]*)', 1), '.example.', '.') AS business_name FROM pages)," + names("src", "business_name", "business_name") + f" SELECT business_name, token, contains(n_compact, token) AS contained, starts_with(n_compact, token) AS starts FROM named JOIN ({ALL_TOKENS}) ON left(n_compact, 3) = left(token, 3) WHERE n_domain AND length(token) BETWEEN 2 AND 6",
    "q_indel_ratio": f"WITH {PART_PAIRS} SELECT a, b, round({ratio('a', 'b')}, {D}) AS ratio FROM part_pairs",
    "q_indel_ratio_expr": f"WITH {PART_PAIRS} SELECT a, b, round({ratio('a', 'b')}, {D}) AS ratio FROM part_pairs",
    "q_token_sort_ratio": f"WITH {PART_PAIRS}, s AS (SELECT *, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb FROM part_pairs) SELECT a, b, round({ratio('sa', 'sb')}, {D}) AS ratio FROM s",
    "q_token_set_ratio": f"""WITH {PART_PAIRS}, s AS (SELECT *, list_filter(list_distinct(string_split(a, ' ')), lambda t: t <> '') AS x, list_filter(list_distinct(string_split(b, ' ')), lambda t: t <> '') AS y FROM part_pairs),
u AS (SELECT *, array_to_string(list_sort(list_intersect(x, y)), ' ') AS i, array_to_string(list_sort(list_filter(x, lambda t: NOT list_contains(y, t))), ' ') AS l, array_to_string(list_sort(list_filter(y, lambda t: NOT list_contains(x, t))), ' ') AS r FROM s),
v AS (SELECT *, trim(i || ' ' || l) AS il, trim(i || ' ' || r) AS ir FROM u)
SELECT a, b, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 WHEN i <> '' AND (l = '' OR r = '') THEN 1 WHEN i = '' THEN {ratio('l', 'r')} ELSE greatest({ratio('il', 'ir')}, {ratio('i', 'il')}, {ratio('i', 'ir')}) END, {D}) AS ratio FROM v""",
    "q_partial_ratio": f"""WITH {PART_PAIRS},
sides AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM part_pairs UNION SELECT a, b, b, a FROM part_pairs WHERE length(a) = length(b)),
windows AS (SELECT a, b, s, unnest(range(1 - length(s), length(l))) AS i, l FROM sides WHERE s <> ''),
cut AS (SELECT a, b, s, substr(l, greatest(i, 0)::INT + 1, (least(i + length(s), length(l)) - greatest(i, 0))::INT) AS w FROM windows)
SELECT a, b, round(max({ratio('s', 'w')}), {D}) AS ratio FROM cut GROUP BY a, b UNION ALL SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE 0.0 END FROM part_pairs WHERE a = '' OR b = ''""",
    "q_token_align": f"""WITH {PART_PAIRS}, x AS (SELECT a, b, unnest({tokens('a')}) AS s, generate_subscripts({tokens('a')}, 1) AS i FROM part_pairs), y AS (SELECT a, b, unnest({tokens('b')}) AS t, generate_subscripts({tokens('b')}, 1) AS j FROM part_pairs),
r AS (SELECT a, b, i, j, {ratio('s', 't')} AS r FROM x JOIN y USING (a, b)), m1 AS (SELECT a, b, i, max(r) AS r FROM r GROUP BY ALL), m2 AS (SELECT a, b, j, max(r) AS r FROM r GROUP BY ALL)
SELECT a, b, any_value(u) AS unmatched, round((any_value(s1) + sum(m2.r)) / (any_value(n1) + count(*)), {D}) AS align FROM m2 JOIN (SELECT a, b, sum(r) AS s1, count(*) AS n1, count(*) FILTER (r < 0.75) AS u FROM m1 GROUP BY ALL) USING (a, b) GROUP BY a, b""",
    "q_part_similarity": f"WITH {PART_FEATURES} SELECT s1_id, src, cand_id, {', '.join(f'round({x}::DOUBLE, {D}) AS {x}' for x in c.SIMILARITIES)} FROM feats",
    "q_part_matrix": f"WITH {PART_FEATURES} SELECT s1_id, src, cand_id, {', '.join(f'round({x}::DOUBLE, {D}) AS {x}' for x in FEATURES)} FROM feats",
    "q_part_scores": f"WITH {PART_SCORED} SELECT s1_id, src, cand_id, {rounded('name_score', 'addr_score')}, score FROM scored",
    "q_part_links": PART_LINKS,
    "q_run_files": PART_LINKS,
    "q_run_stream": PART_LINKS,
    "q_run_candidates": f"WITH {CANDIDATES.replace(RAW, PART_RAW)} SELECT entity_id AS s1_id, coalesce(m, '') AS candidate_ids FROM records LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY src, cand_id) AS m FROM candidates GROUP BY ALL) ON s1_id = entity_id WHERE src = 'S1'",
    "q_run_check": f"""SELECT unnest({strings([*CHECKS, 'missing_candidate_rows', 'unknown_candidate_rows', 'not_candidates', 'malformed_lines'])}) AS "check", 0::BIGINT AS violations""",
    "q_competition": f"""WITH {CLAIMS}, r AS (SELECT s1_id, src, cand_id, p1, row_number() OVER w AS n, max(p1) OVER (PARTITION BY src, cand_id) AS best, lead(p1) OVER w AS second, count(*) OVER (PARTITION BY src, cand_id) AS c_n,
  max(p1) OVER s AS s1_max, sum((p1 > 0.5)::INT) OVER s::BIGINT AS s1_n50, row_number() OVER (PARTITION BY s1_id ORDER BY p1 DESC, src, cand_id) AS s1_rank
  FROM claims WINDOW w AS (PARTITION BY src, cand_id ORDER BY p1 DESC, s1_id), s AS (PARTITION BY s1_id))
SELECT s1_id, src, cand_id, p1, c_n, CASE WHEN n = 1 THEN coalesce(second, 0) ELSE best END AS c_other, round(p1 - CASE WHEN n = 1 THEN coalesce(second, 0) ELSE best END, {D}) AS c_gap, s1_max, s1_n50, s1_rank, round(p1 - s1_max, {D}) AS s1_gap FROM r""",
    "q_stage2_matrix": f"""WITH {PART_SCORED}, live AS (SELECT f.*, score AS p1 FROM feats f JOIN scored USING (s1_id, src, cand_id) WHERE score >= 0.02),
r AS (SELECT *, row_number() OVER w AS n, max(p1) OVER (PARTITION BY src, cand_id) AS best, lead(p1) OVER w AS second, count(*) OVER (PARTITION BY src, cand_id) AS c_n,
  max(p1) OVER s AS s1_max, sum((p1 > 0.5)::INT) OVER s AS s1_n50, row_number() OVER (PARTITION BY s1_id ORDER BY p1 DESC, src, cand_id) AS s1_rank
  FROM live WINDOW w AS (PARTITION BY src, cand_id ORDER BY p1 DESC, s1_id), s AS (PARTITION BY s1_id)),
o AS (SELECT *, CASE WHEN n = 1 THEN coalesce(second, 0) ELSE best END AS c_other, p1 - CASE WHEN n = 1 THEN coalesce(second, 0) ELSE best END AS c_gap, p1 - s1_max AS s1_gap FROM r)
SELECT s1_id, src, cand_id, {', '.join(f'round({x}::DOUBLE, {D}) AS {x}' for x in [*FEATURES, 'p1', 's1_max', 's1_gap', 's1_rank', 's1_n50', 'c_other', 'c_gap', 'c_n'])} FROM o""",
    "q_labelled": f"WITH {CLAIMS} SELECT s1_id, src, cand_id, label FROM claims",
    "q_training_totals": f"SELECT count(*) AS kept, sum(weight) AS effective, count(*) FILTER (label) AS \"true\" FROM ({subsample('(label OR p1 >= 0.005)')})",
    "q_dictionary_pairs": f"WITH {RAW}, {TRUTH} SELECT s1_id, cand_id, md5(l.business_name) AS s1_digest, md5(r.business_name) AS other_digest FROM truth JOIN raw l ON l.entity_id = s1_id JOIN raw r ON r.entity_id = cand_id WHERE {crc("s1_id || '#sample'")} % 20 <> 0",
    "q_script_fold": f"SELECT s, folded FROM {values(c.SCRIPTS)} v(s, folded)",
    "q_rule_name": f"WITH {CLAIMS} SELECT s1_id, src, cand_id, round(name_score, {D}) AS score FROM named_scores",
    "q_rule_addr": f"WITH {CLAIMS} SELECT s1_id, src, cand_id, round(addr_score, {D}) AS score FROM named_scores",
    "q_rule_score": f"WITH {CLAIMS} SELECT s1_id, src, cand_id, score FROM scored",
    "q_comp_s1": f"WITH {CLAIMS} SELECT s1_id, src, cand_id, p1, max(p1) OVER w AS s1_max, sum((p1 > 0.5)::INT) OVER w::BIGINT AS s1_n50, row_number() OVER (PARTITION BY s1_id ORDER BY p1 DESC, src, cand_id) AS s1_rank, round(p1 - max(p1) OVER w, {D}) AS s1_gap FROM claims WINDOW w AS (PARTITION BY s1_id)",
    "q_comp_record": f"WITH {CLAIMS}, r AS (SELECT s1_id, src, cand_id, p1, row_number() OVER w AS n, max(p1) OVER (PARTITION BY src, cand_id) AS best, lead(p1) OVER w AS second, count(*) OVER (PARTITION BY src, cand_id) AS c_n FROM claims WINDOW w AS (PARTITION BY src, cand_id ORDER BY p1 DESC, s1_id)) SELECT s1_id, src, cand_id, p1, c_n, CASE WHEN n = 1 THEN coalesce(second, 0) ELSE best END AS c_other, round(p1 - CASE WHEN n = 1 THEN coalesce(second, 0) ELSE best END, {D}) AS c_gap FROM r",
    "q_threshold": f"WITH {CLAIMS} SELECT s1_id, src, cand_id, score FROM scored WHERE score >= {P.MATCH_THRESHOLD}",
    "q_one_owner": f"WITH {CLAIMS} SELECT s1_id, src, cand_id, score FROM scored QUALIFY {OWNER}",
    "q_margin": f"WITH {CLAIMS} SELECT s1_id, src, cand_id, score FROM scored QUALIFY score >= max(score) OVER (PARTITION BY s1_id) - 0.2::DOUBLE",
    "q_decide": f"WITH {KEPT} SELECT s1_id, src, cand_id, score FROM kept",
    "q_match_list": f"WITH {KEPT} SELECT s1_id, coalesce(m, '') AS matched_ids FROM (SELECT DISTINCT s1_id FROM claims) LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY score DESC, src, cand_id) AS m FROM kept GROUP BY ALL) USING (s1_id)",
    "q_prune": f"WITH {CLAIMS} SELECT s1_id, src, cand_id, p1 FROM claims WHERE p1 >= 0.02",
    "q_blocking_recall": f"WITH {CANDIDATES}, {TRUTH} SELECT count(*) AS true_pairs, count(c.s1_id) AS found, round(count(c.s1_id) / greatest(count(*), 1), {D}) AS recall FROM truth LEFT JOIN candidates c USING (s1_id, cand_id)",
    "q_f05_entity": f"WITH {ENTITIES} SELECT s1_id, tp, n_pred, n_true, round(f05, {D}) AS f05 FROM entities",
    "q_macro_f05": f"WITH {ENTITIES} SELECT round(avg(f05), {D}) AS macro_f05, round(avg(tp / n_pred) FILTER (n_pred > 0), {D}) AS mean_precision, round(avg(tp / n_true) FILTER (n_true > 0), {D}) AS mean_recall, round(avg((n_pred = 0)::INT) FILTER (n_true = 0), {D}) AS singleton_accuracy, count(*) FILTER (n_true = 0) AS singletons FROM entities",
    "q_missed_pairs": f"WITH {CANDIDATES}, {TRUTH} SELECT s1_id, cand_id FROM truth ANTI JOIN (SELECT * FROM candidates WHERE block_score >= 2) USING (s1_id, cand_id)",
    "q_miss_cause": f"""WITH {CANDIDATES}, {TRUTH}, firsts AS (SELECT entity_id, src, a_numbers[1] AS k FROM records WHERE len(a_numbers) > 0),
wanted AS (SELECT x.entity_id AS s1_id, y.entity_id AS cand_id FROM firsts x JOIN firsts y USING (k) WHERE x.src = 'S1' AND y.src <> 'S1' UNION SELECT * FROM truth),
missed AS (SELECT * FROM wanted ANTI JOIN candidates USING (s1_id, cand_id)),
shared AS (SELECT s1_id, cand_id, min(size) AS smallest FROM missed JOIN keys k1 ON k1.entity_id = s1_id JOIN keys k2 ON k2.entity_id = cand_id AND k1.key = k2.key JOIN sizes ON sizes.src = k2.src AND sizes.key = k2.key GROUP BY ALL)
SELECT s1_id, cand_id, CASE WHEN smallest > {CAP.max_block} THEN 'keys only in oversized blocks' WHEN smallest IS NOT NULL THEN 'cut by top-K cap' WHEN l.country <> r.country THEN 'no key: country differs'
  WHEN l.a_empty OR r.a_empty THEN 'no key: address missing' || CASE WHEN len(list_intersect(l.n_tokens, r.n_tokens)) = 0 THEN ' + name differs' ELSE '' END
  WHEN len(list_intersect(l.n_tokens, r.n_tokens)) = 0 THEN 'no key: no shared name token' ELSE 'no key: other' END AS cause
FROM missed LEFT JOIN shared USING (s1_id, cand_id) JOIN records l ON l.entity_id = s1_id JOIN records r ON r.entity_id = cand_id""",
    "q_error_cause": f"WITH {DECIDED} SELECT kind, cause, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY kind), {D}) AS percent FROM wrong GROUP BY kind, cause",
    "q_fp_fn": f"WITH {DECIDED}, singles AS (SELECT s1_id FROM claims GROUP BY s1_id HAVING NOT bool_or(label)) SELECT count(*) FILTER (kept) AS kept, count(*) FILTER (kept AND NOT label) AS fp, count(*) FILTER (NOT kept AND label) AS fn, count(*) FILTER (kept AND NOT label AND s.s1_id IS NOT NULL) AS fp_on_singletons FROM decided LEFT JOIN singles s USING (s1_id)",
    "q_validate_results": f"WITH {RESULTS} {checks({})}",
    "q_validate_candidates": f"WITH {RESULTS}, listed AS (SELECT DISTINCT s1_id FROM results WHERE s1_id <> 'S1-11'), lists AS (SELECT DISTINCT s1_id, unnest(string_split(regexp_replace(ids, '7$', '8'), ',')) AS cand_id FROM results WHERE s1_id <> 'S1-11') " + checks({"missing_candidate_rows": "SELECT * FROM known_s1 ANTI JOIN listed USING (s1_id)", "unknown_candidate_rows": "SELECT s1_id FROM listed ANTI JOIN known_s1 USING (s1_id)", "not_candidates": "SELECT * FROM edges ANTI JOIN (SELECT * FROM lists WHERE cand_id <> '') USING (s1_id, cand_id)"}),
    "q_result_summary": f"WITH {RESULTS} SELECT (SELECT count(*) FROM results) AS rows, (SELECT count(*) FROM elements WHERE x <> '') AS matched, (SELECT count(*) FROM results WHERE ids = '') AS empty_rows",
    "q_truth_edges": f"WITH {RESULTS} SELECT s1_id, cand_id FROM edges",
    "q_raw_lookup": f"WITH {RAW}, {TRUTH} SELECT entity_id, md5(business_name || ' | ' || business_address) AS digest FROM raw SEMI JOIN (SELECT s1_id AS entity_id FROM truth UNION SELECT cand_id FROM truth) USING (entity_id)",
    "q_align_counts": f"WITH {ALIGNED} SELECT x, y, c FROM aligned",
    "q_align_argmax": f"WITH {ALIGNED} SELECT x AS token, y AS english FROM (SELECT x, y, c, sum(c) OVER (PARTITION BY x) AS total, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS r FROM aligned) WHERE r = 1 AND c >= 2 AND c / total >= 0.6",
    "q_coord_ascent": f"WITH {ASCENT} SELECT t AS threshold, m AS margin, round(f, {D}) AS macro_f05 FROM b5",
    "q_tsv_round_trip": f"WITH {RAW} SELECT entity_id, business_name, md5(business_address) AS business_address, lang AS country FROM raw JOIN documents USING (doc_id) UNION ALL SELECT e, n, md5(a), k FROM (VALUES ('S9-1', 'a \"quoted\" name', 'NA', ''), ('S9-2', 'back\\slash', 'null', 'in')) v(e, n, a, k)",
}
