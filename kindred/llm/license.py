"""License scans over a tree of files, in DataFrame operations only.

Every line of a file, and the whole of a licence file (LICENSE, COPYING, NOTICE, ...),
is compared with licence templates: sparse TF-IDF vectors and their cosine.  Document
frequencies of the templates' words come from the whole corpus; every other word of a line
is a dimension of its own, and weighs as much as a word that no document has, so that
words strewn over prose make no licence.  The best template above a threshold is the
file's own licence.  Where no line reaches the threshold, the runs of as many words as a
template has are compared, wherever lines break and whatever stands around them; and the
opening of a licence file is compared so first, for its text may name other licences.
A file without a licence inherits that of the nearest directory above it that has a
licence file with a licence.

Cases: a null or empty text has no licence; a null path has no directory and inherits
nothing.  Ties go to the run that comes first, then the licence that sorts first.  Repeated
rows are files of their own; of several licence files in a directory the best score
counts, ties going to the licence that sorts first.  Very long texts are compared whole.
Other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread

# Statements by which licences are named, and openings of their texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 terms and conditions for use, reproduction, and distribution"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Released under the ISC License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "Released under CC0 1.0 Universal public domain dedication"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0 Creative Commons Attribution"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"), ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"), ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    *((x, f"SPDX-License-Identifier: {x}") for x in ("Apache-2.0", "MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC", "MPL-2.0", "CC0-1.0", "Unlicense")),
]
_GNU = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
# Headers of files and titles of licence texts, which are wrapped; compared with runs of words only, titles only in the opening of a licence file.
HEADERS = [
    ("GPL-2.0", _GNU.format("program", "", "2")), ("GPL-3.0", _GNU.format("program", "", "3")), ("LGPL-2.0", _GNU.format("library", "Library ", "2")),
    ("LGPL-2.1", _GNU.format("library", "Lesser ", "2.1")), ("LGPL-3.0", _GNU.format("library", "Lesser ", "3")), ("AGPL-3.0", _GNU.format("program", "Affero ", "3")),
]
TITLES = [
    ("GPL-1.0", "GNU General Public License Version 1"), ("GPL-2.0", "GNU General Public License Version 2"), ("GPL-3.0", "GNU General Public License Version 3"),
    ("LGPL-2.0", "GNU Library General Public License Version 2"), ("LGPL-2.1", "GNU Lesser General Public License Version 2.1"), ("LGPL-3.0", "GNU Lesser General Public License Version 3"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3"), ("GFDL-1.2", "GNU Free Documentation License Version 1.2"), ("GFDL-1.3", "GNU Free Documentation License Version 1.3"),
    ("Apache-2.0", "Apache License Version 2.0"), ("MPL-1.1", "Mozilla Public License Version 1.1"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
]
#: Words (but for those of STOP) that a licence file's opening has.
OPENING = 100
STOP = "a and any are by for in into is of or that the this to under with without v".split()

#: A word: letters and digits, parts joined by a dot, plus or hyphen.
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)^(?:un)?licen[cs]e(?:[.-].*)?$|^copying(?:[.-].*)?$|^notice(?:[.-].*)?$"
#: A unit's cosine with a template that counts.
SIMILARITY = 0.75


def words(text: str) -> list[str]:
    return [w for w in re.findall(WORD, text.lower()) if w not in STOP]


VOCABULARY = sorted({w for _, t in TEMPLATES for w in words(t)})
RUN_VOCABULARY = sorted({w for _, t in TEMPLATES + HEADERS + TITLES for w in words(t)})


def _every(text: Column) -> Column:
    """The words of a text but for those of STOP, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(STOP))


def _unit(ws: Column) -> Column:
    """The words that templates have, and the number of others."""
    known = F.filter(ws, lambda w: w.isin(VOCABULARY))
    return F.struct(known.alias("known"), (F.size(ws) - F.size(known)).alias("others"))


def _placed(ws: Column) -> Column:
    """The words that any template has, each with its place among all."""
    return F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("p"), w.alias("w"))), lambda x: x["w"].isin(RUN_VOCABULARY))


def unseen(total: int) -> float:
    """The weight of a word that none of ``total`` documents has."""
    return math.log(total + 1) + 1


def _weights(idf: dict[str, float], template: str) -> dict[str, float]:
    ws = words(template)
    raw = {w: ws.count(w) * idf[w] for w in sorted(set(ws))}
    norm = math.sqrt(math.fsum(x * x for x in raw.values()))
    return {w: x / norm for w, x in raw.items()}


# Constants as JSON: one literal to the optimizer, however many templates there are.
def _table(vocabulary: list[str], idf: dict[str, float]) -> Column:
    return F.from_json(F.lit(json.dumps({w: idf[w] for w in vocabulary})), "map<string,double>")


def _known(templates: list[tuple[str, str]], idf: dict[str, float]) -> Column:
    """The templates with their numbers of words and their unit vectors."""
    rows = [{"licence": lic, "n": len(words(t)), "own": _weights(idf, t)} for lic, t in templates]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<licence:string,n:int,own:map<string,double>>>")


def _nothing() -> Column:
    return F.lit(None).cast("struct<score:double,licence:string>")


def _better(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | (b["score"] > a["score"]) | ((b["score"] == a["score"]) & (b["licence"] < a["licence"])), b).otherwise(a)


def _scored(known: Column, others: Column, table: Column, rare: float) -> Column:
    """The different words of a unit with their weights, and the norm of all its words."""
    different = F.array_distinct(known)
    weight = F.transform(different, lambda w: F.struct(w.alias("w"), (F.size(F.filter(known, lambda x: x == w)) * table[w]).alias("x")))
    return F.struct(weight.alias("ws"), F.sqrt(F.aggregate(weight, others * F.lit(rare * rare), lambda a, e: a + e["x"] * e["x"])).alias("norm"))


def _best(units: Column, idf: dict[str, float], rare: float) -> Column:
    """The best (score, licence) of a list of units; null without units."""
    table = _table(VOCABULARY, idf)

    def against(unit: Column, t: Column) -> Column:
        dot = F.aggregate(unit["ws"], F.lit(0.0), lambda a, e: a + e["x"] * F.coalesce(t["own"][e["w"]], F.lit(0.0)))
        return F.struct(F.round(dot / unit["norm"], 6).alias("score"), t["licence"].alias("licence"))

    each = F.transform(units, lambda u: _scored(u["known"], u["others"], table, rare))
    pairs = F.flatten(F.transform(each, lambda u: F.transform(_known(TEMPLATES, idf), lambda t: against(u, t))))
    return F.aggregate(pairs, _nothing(), _better)


def _best_run(placed: Column, total: Column, idf: dict[str, float], rare: float, templates: list[tuple[str, str]], similarity: float) -> Column:
    """The best (score, licence) of the runs that reach the similarity; null without one.

    ``placed`` are the templates' words among ``total`` words.  A run begins at a word of
    the template and has as many words.  A template whose words in the text would not
    reach the similarity even by themselves is passed over.
    """
    table = _table(RUN_VOCABULARY, idf)
    weight = lambda t, w: F.coalesce(t["own"][w], F.lit(0.0))
    within = lambda t, ws: F.aggregate(F.array_distinct(ws), F.lit(0.0), lambda a, w: a + weight(t, w) * weight(t, w)) >= similarity * similarity - 1e-6

    def cosine(t: Column, u: Column) -> Column:
        unit = _scored(u["ws"], F.least(t["n"], total - u["p"]) - F.size(u["ws"]), table, rare)
        return F.round(F.aggregate(unit["ws"], F.lit(0.0), lambda a, e: a + e["x"] * weight(t, e["w"])) / unit["norm"], 6)

    def runs(t: Column) -> Column:
        at = lambda x, i: F.transform(F.filter(F.slice(placed, i + 1, t["n"]), lambda y: y["p"] < x["p"] + t["n"]), lambda y: y["w"])
        units = F.transform(placed, lambda x, i: F.when(t["own"][x["w"]].isNotNull(), F.struct(x["p"].alias("p"), at(x, i).alias("ws"))))
        units = F.filter(units, lambda u: u.isNotNull() & within(t, u["ws"]))
        return F.transform(units, lambda u: F.struct((-cosine(t, u)).alias("s"), u["p"].alias("p"), t["licence"].alias("licence")))

    possible = F.filter(_known(templates, idf), lambda t: within(t, F.transform(placed, lambda x: x["w"])))
    best = F.array_min(F.filter(F.flatten(F.transform(possible, runs)), lambda x: x["s"] <= -similarity))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("score"), best["licence"].alias("licence")))


def scan(files: DataFrame, key: str, path: str = "path", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``key, path, own_license, own_score, license, via, from_dir``: one row per file.

    ``via`` is own, inherited or none; ``own_score`` is the cosine, rounded to six
    places, of the file's own licence.
    """
    base = files.select(F.col(key).alias("key"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    base = base.withColumn("licence_file", F.coalesce(F.regexp_extract("path", r"[^/]*$", 0).rlike(LICENCE_FILE), F.lit(False)))
    # only files with a word of a template go on, and of these only the lines that have one
    read = base.withColumn("lines", F.transform(F.split("text", "\n"), _every)).withColumn("every", F.flatten("lines")).drop("text")
    hits = read.withColumn("placed", _placed(F.col("every"))).withColumn("hits", F.array_distinct("placed.w"))
    units = F.filter(F.transform("lines", _unit), lambda u: F.size(u["known"]) > 0)
    units = F.when(F.col("licence_file"), F.concat(units, F.filter(F.array(_unit(F.col("every"))), lambda u: F.size(u["known"]) > 0))).otherwise(units)
    found = materialize(hits.select("key", "path", "licence_file", "hits", "placed", F.size("every").alias("total"), F.when(F.size("hits") > 0, units).alias("units")))
    total = found.count()
    counted = {r["w"]: r["count"] for r in found.select(F.explode("hits").alias("w")).groupBy("w").count().collect()}  # words of templates only
    rare = unseen(total)
    idf = {w: math.log((total + 1) / (counted.get(w, 0) + 1)) + 1 for w in RUN_VOCABULARY}
    first = _best_run(F.filter("placed", lambda x: x["p"] < OPENING), F.least(F.col("total"), F.lit(OPENING)), idf, rare, TEMPLATES + HEADERS + TITLES, similarity)
    line = found.withColumn("line", _best(F.col("units"), idf, rare)).withColumn("opening", F.when(F.col("licence_file"), first))
    line = line.withColumn("line", F.when(F.col("line.score") >= similarity, F.col("line")))
    run = F.when(F.col("line").isNull(), _best_run(F.col("placed"), F.col("total"), idf, rare, TEMPLATES + HEADERS, similarity))
    best = line.withColumn("best", F.coalesce("opening", "line", run))
    scored = best.select("key", "path", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), "licence_file", F.col("best.score").alias("own_score"), F.col("best.licence").alias("own_license"))
    scored = materialize(scored)
    given = scored.where("licence_file and own_license is not null").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("l"))).alias("x"))
    given = given.select(F.col("dir").alias("above"), F.col("x.l").alias("given"))
    # every directory that holds files, with itself and all above it ('' is the root)
    dirs = scored.where("dir is not null").select("dir").distinct()
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    chain = dirs.withColumn("parts", parts).select("dir", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"), "parts")
    chain = chain.select("dir", "depth", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.array_join(F.slice("parts", F.lit(1), F.greatest(F.col("depth"), F.lit(1))), "/")).alias("above"))
    near = chain.join(spread(given), "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("x")).select("dir", F.col("x.above").alias("from_dir"), "x.given")
    out = scored.join(spread(near), "dir", "left")
    return out.select(
        F.col("key").alias(key), "path", "own_license", "own_score", F.coalesce("own_license", "given").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("via"),
        F.when(F.col("own_license").isNull(), F.col("from_dir")).alias("from_dir"),
    )
