"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, exact, html, langid, license, minhash, mixing, packing, quality
from .common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(langid.bucket(F.col("doc_id"), 5) != 0).select("text", "lang"))
    found = langid.classify(docs.select("doc_id", "text"), model)
    held = (langid.bucket(F.col("doc_id"), 5) == 0).alias("held_out")
    return found.select("doc_id", held, "langid.lang_pred", "langid.score", "langid.rejected")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(read(spark, sf_dir, "documents")).drop("copy")


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source / thousand / ten, where the first of ten is the LICENSE file."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    name = F.when(F.col("doc_id") % 10 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    ten = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("doc_id div 1000").cast("string"), F.expr("doc_id div 10").cast("string"))
    return license.scan(docs.withColumn("path", F.concat_ws("/", ten, name)), key="doc_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(langid.bucket(F.col("doc_id"), 3) != 1)
    scored = quality.score(docs, *quality.fit(docs, labels))
    held = (langid.bucket(F.col("doc_id"), 3) == 1).alias("held_out")
    scored = scored.select("doc_id", held, F.col("quality_score").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


#: A conversation whose texts hold control strings of a common template.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def _digest(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, marks in zip(formatted, spans, strict=True):
        turns = chat.parse(text)
        loss = "".join(chat.unescape(text[x["start"] : x["end"]]) for x in marks)
        whole = "".join(f"{role}\n{said}\n" for role, said in turns)
        rows.append((
            len(turns), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), len(loss),
            hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text),
        ))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    chats = chat.format_chats(chat.conversation_events(rows))
    digest = F.pandas_udf(_digest, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return chats.select("conv_id", digest("formatted", "loss_spans").alias("d")).select("conv_id", "d.*")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_html": op2_html,
    "op3_ann": op3_ann,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_packing": op5_packing,
    "op6_langid": op6_langid,
    "op7_near_dedup": op7_near_dedup,
    "op8_license": op8_license,
    "op9_quality": op9_quality,
    "op10_chat": op10_chat,
}

SPACE = r"[\x20\x09-\x0D]+"

ORACLE_SQL = {
    "op1_mixing": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '')) AS n_tokens,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS h
  FROM documents),
t AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source HAVING sum(n_tokens) > 0),
tot AS (SELECT sum(tokens)::BIGINT AS total, ln(count(*)) AS top FROM t),
b AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, mid,
          (SELECT -sum(p / z * ln(p / z)) FROM (
             SELECT p, sum(p) OVER () AS z FROM (SELECT pow(tokens::DOUBLE / total, mid) AS p FROM t, tot)))
          >= {mixing.TARGET_ENTROPY} * (SELECT top FROM tot) AS ok
        FROM (SELECT i, lo, hi, CASE WHEN i = 0 THEN 1.0 ELSE (lo + hi) / 2 END AS mid FROM b WHERE i <= {mixing.STEPS}))),
e1 AS (SELECT CASE WHEN lo = 1.0 THEN 1.0 ELSE lo END AS a FROM b ORDER BY i DESC LIMIT 1),
r AS (
  SELECT 0 AS i, (SELECT a FROM e1) AS lo, 1.0::DOUBLE AS hi, true AS rep
  UNION ALL
  SELECT i + 1, CASE WHEN i = 0 OR bad THEN mid ELSE lo END, CASE WHEN i = 0 THEN (CASE WHEN bad THEN hi ELSE mid END) WHEN bad THEN hi ELSE mid END, bad
  FROM (SELECT i, lo, hi, mid,
          (SELECT bool_or(total * (p / z) > {mixing.MAX_EPOCHS} * tokens) FROM (
             SELECT p, tokens, total, sum(p) OVER () AS z FROM (SELECT pow(tokens::DOUBLE / total, mid) AS p, tokens, total FROM t, tot))) AS bad
        FROM (SELECT i, lo, hi, CASE WHEN i = 0 THEN lo ELSE (lo + hi) / 2 END AS mid FROM r WHERE i <= {mixing.STEPS}))),
a AS (SELECT hi AS a FROM r ORDER BY i DESC LIMIT 1),
w AS (
  SELECT source, tokens, floor(total * (p / sum(p) OVER ()))::BIGINT AS budget,
         (tokens + {mixing.BLOCK_TOKENS} - 1) // {mixing.BLOCK_TOKENS} AS blocks
  FROM (SELECT source, tokens, total, pow(tokens::DOUBLE / total, a) AS p FROM t, tot, a)),
p AS (
  SELECT d.*, w.tokens, w.budget, ('0x' || substr(h, 1, 8))::BIGINT % w.blocks AS block FROM d JOIN w USING (source)),
s AS (SELECT source, block, sum(n_tokens)::BIGINT AS size, any_value(tokens) AS tokens, any_value(budget) AS budget FROM p GROUP BY ALL),
o AS (
  SELECT source, block, epoch, epoch * tokens + sum(size) OVER (
           PARTITION BY source, epoch ORDER BY substr(md5('mix:' || epoch || ':' || block), 1, 16), block) - size AS base, budget
  FROM (SELECT *, unnest(range(greatest(budget - 1, 0) // tokens + 1)) AS epoch FROM s)),
q AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source, block ORDER BY h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS before,
         row_number() OVER (PARTITION BY source, block, doc_id ORDER BY h, doc_id, n_tokens) AS copy
  FROM p)
SELECT q.doc_id, q.source, q.n_tokens::BIGINT AS n_tokens, q.copy::BIGINT AS copy, o.epoch::BIGINT AS epoch, q.block::BIGINT AS block,
       (o.base + q.before)::BIGINT AS start
FROM q JOIN o USING (source, block) WHERE o.base < o.budget AND o.base + q.before < o.budget""",
    "op4_exact_dedup": rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g') AS t FROM documents),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size,
       doc_id IS NOT DISTINCT FROM keep_id
         AND row_number() OVER (PARTITION BY n.t, doc_id) = 1 AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t""",
    "op8_license": rf"""
WITH d AS (
  SELECT doc_id, concat_ws('/', coalesce(source, 'none'), doc_id // 1000, doc_id // 10) AS dir,
         CASE WHEN doc_id % 10 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS name, text FROM documents),
templates AS (SELECT * FROM (VALUES {', '.join(f"({i}, {kind}, '{lic}', {license.words(t)}, {len(license.words(t))})" for i, (kind, lic, t) in enumerate(
    [(0, *x) for x in license.TEMPLATES] + [(1, *x) for x in license.HEADERS] + [(2, *x) for x in license.TITLES]))}) t(template, kind, licence, ws, len)),
stop AS (SELECT unnest({license.STOP}) AS w),
vocabulary AS (SELECT w, min(kind) AS kind FROM (SELECT unnest(ws) AS w, kind FROM templates) GROUP BY w),
words AS (SELECT doc_id, name, n, i, unnest(xs) AS w, unnest(range(len(xs))) AS j
  FROM (SELECT doc_id, name, n, n AS i, regexp_extract_all(lower(l), '{license.WORD}') AS xs
    FROM (SELECT doc_id, name, unnest(ls) AS l, unnest(range(len(ls))) AS n FROM (SELECT doc_id, name, string_split(text, chr(10)) AS ls FROM d)))),
every AS (SELECT doc_id, name, n, w, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS p FROM words ANTI JOIN stop USING (w)),
sizes AS (SELECT doc_id, count(*) AS total FROM every GROUP BY doc_id),
hits AS (SELECT doc_id, name, n, w, p, kind FROM every JOIN vocabulary USING (w)),
docs AS (SELECT count(*) AS total, ln(count(*) + 1) + 1 AS rare FROM d),
idf AS (SELECT w, ln(((SELECT total FROM docs) + 1) / (count(DISTINCT doc_id) + 1)) + 1 AS idf FROM vocabulary LEFT JOIN hits USING (w) GROUP BY w),
tw AS (SELECT template, w, count(*) * any_value(idf) AS x FROM (SELECT template, unnest(ws) AS w FROM templates) JOIN idf USING (w) GROUP BY ALL),
tn AS (SELECT template, sqrt(sum(x * x)) AS norm FROM tw GROUP BY ALL),
own AS (SELECT template, w, x / norm AS x FROM tw JOIN tn USING (template)),
units AS (SELECT doc_id, n, w, count(*) AS tf FROM hits WHERE kind = 0 GROUP BY ALL
  UNION ALL SELECT doc_id, -1, w, count(*) FROM hits WHERE name = 'LICENSE' AND kind = 0 GROUP BY ALL),
lengths AS (SELECT doc_id, n, count(*) AS m FROM every GROUP BY ALL UNION ALL SELECT doc_id, -1, total FROM sizes),
un AS (SELECT doc_id, n, sqrt(sum(tf * idf * tf * idf) + (any_value(m) - sum(tf)) * any_value((SELECT rare * rare FROM docs))) AS norm
  FROM units JOIN idf USING (w) JOIN lengths USING (doc_id, n) GROUP BY doc_id, n),
cosines AS (SELECT doc_id, licence, round(sum(tf * idf * own.x) / any_value(un.norm), 6) AS score
  FROM units JOIN idf USING (w) JOIN own USING (w) JOIN templates USING (template) JOIN un USING (doc_id, n) WHERE templates.kind = 0 GROUP BY doc_id, n, template, licence),
line AS (SELECT doc_id, licence, score FROM cosines WHERE score >= {license.SIMILARITY} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) = 1),
starts AS (SELECT DISTINCT doc_id, p, template, t.len, licence, t.kind, total, opening
  FROM hits JOIN own USING (w) JOIN templates t USING (template) JOIN sizes USING (doc_id)
  JOIN (SELECT doc_id, name = 'LICENSE' AS opening FROM d WHERE name = 'LICENSE' UNION ALL SELECT doc_id, false FROM d) USING (doc_id)
  WHERE (opening AND p < {license.OPENING}) OR (NOT opening AND t.kind < 2)),
inrun AS (SELECT s.doc_id, s.p, s.template, s.opening, h.w, count(*) AS tf,
    least(any_value(s.len), CASE WHEN s.opening THEN least(any_value(total), {license.OPENING}) ELSE any_value(total) END - s.p) AS m, any_value(licence) AS licence
  FROM starts s JOIN hits h ON h.doc_id = s.doc_id AND h.p >= s.p AND h.p < s.p + s.len AND (NOT s.opening OR h.p < {license.OPENING}) GROUP BY s.doc_id, s.p, s.template, s.opening, h.w),
runs AS (SELECT doc_id, opening, p, template, any_value(licence) AS licence,
    round(sum(tf * idf * coalesce(own.x, 0)) / sqrt(sum(tf * idf * tf * idf) + (any_value(m) - sum(tf)) * any_value((SELECT rare * rare FROM docs))), 6) AS score
  FROM inrun JOIN idf USING (w) LEFT JOIN own USING (template, w) GROUP BY doc_id, opening, p, template),
run AS (SELECT doc_id, opening, licence, score FROM runs WHERE score >= {license.SIMILARITY}
  QUALIFY row_number() OVER (PARTITION BY doc_id, opening ORDER BY score DESC, p, licence) = 1),
best AS (SELECT d.doc_id, dir, name, dir || '/' || name AS path,
    coalesce(o.licence, line.licence, r.licence) AS own_license, coalesce(o.score, line.score, r.score) AS own_score
  FROM d LEFT JOIN line USING (doc_id) LEFT JOIN (FROM run WHERE opening) o USING (doc_id) LEFT JOIN (FROM run WHERE NOT opening) r USING (doc_id)),
given AS (SELECT dir AS above, own_license AS given FROM best WHERE name = 'LICENSE' AND own_license IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license) = 1),
near AS (SELECT dir, above, given FROM (SELECT DISTINCT dir FROM best) JOIN given ON dir = above OR starts_with(dir, above || '/')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, given) AS license,
       CASE WHEN own_license IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS via,
       CASE WHEN own_license IS NULL THEN above END AS from_dir
FROM best LEFT JOIN near USING (dir)""",
    "op10_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) AS n_text,
         length(role) + length(regexp_replace(role, '[^<\[\\\n]', '', 'g')) AS n_role FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + n_role + 1 + n_text + 10 + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
}
