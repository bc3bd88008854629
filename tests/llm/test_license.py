import math
import re
from collections import Counter

from pyspark.sql import functions as F

from kindred.llm import license

FILES = "id long, path string, text string"


def brute(rows):
    """Own licence of each row by plain TF-IDF cosines over all its words: lines, whole licence files, runs."""
    every = [[license.words(line) for line in (t or "").split("\n")] for _, _, t in rows]
    seen = [{w for line in lines for w in line} for lines in every]
    idf = {w: math.log((len(rows) + 1) / (sum(w in s for s in seen) + 1)) + 1 for w in license.RUN_VOCABULARY}
    rare = math.log(len(rows) + 1) + 1

    def cosine(ws, template, vocabulary):
        known = Counter(w for w in ws if w in vocabulary)
        own = Counter(license.words(template))
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in known.items()) + (len(ws) - sum(known.values())) * rare**2)
        length = math.sqrt(sum((n * idf[w]) ** 2 for w, n in own.items()))
        return round(sum(known[w] * n * idf[w] ** 2 for w, n in own.items()) / norm / length, 6) if known else 0.0

    def best_run(ws, templates):
        found = []
        for lic, template in templates:
            n, own = len(license.words(template)), set(license.words(template))
            found += [(-cosine(ws[i : i + n], template, license.RUN_VOCABULARY), i, lic) for i, w in enumerate(ws) if w in own]
        best = min(found, default=(0,))
        return best[2] if best[0] <= -license.SIMILARITY else None

    out = {}
    for (i, p, _), lines in zip(rows, every, strict=True):
        flat = [w for line in lines for w in line]
        file = bool(re.match(license.LICENCE_FILE, (p or "").rsplit("/", 1)[-1]))
        units = lines + ([flat] if file else [])
        line = min(((-cosine(u, t, license.VOCABULARY), lic) for u in units for lic, t in license.TEMPLATES), default=(0, None))
        opening = best_run(flat[: license.OPENING], license.TEMPLATES + license.HEADERS + license.TITLES) if file else None
        out[i] = opening or (line[1] if line[0] <= -license.SIMILARITY else best_run(flat, license.TEMPLATES + license.HEADERS))
    return out


ROWS = [
    (1, "a/LICENSE", "Some words\nReleased under the MIT License."), (2, "a/b/c/x.txt", "no licence here"), (3, "a/b/LICENSE", "Licensed under CC BY-NC 4.0."),
    (4, "a/b/d/e/y.txt", "text"), (5, "a/z.txt", "This work is licensed under the GNU General Public License, version 3."), (6, "q/r.txt", "plain public version"),
    (7, None, "Licensed under the Apache License, Version 2.0"), (8, "a/b/c/n.txt", None), (9, "top.txt", "x"), (None, "ab/u.txt", ""), (4, "a/b/d/e/y.txt", "text"), (10, "a/b/k.txt", "word " * 50_000),
]


def test_scan(spark, clashing):
    df = spark.createDataFrame(ROWS, FILES).select("*", *(F.lit(1).alias(c) for c in [*clashing, "dir", "units", "total"] if c != "id"))
    out = license.scan(df, "id").collect()
    assert len(out) == len(ROWS)
    got = {r["id"]: (r["license"], r["via"], r["from_dir"]) for r in out}
    assert got[1] == ("MIT", "own", None) and got[3] == ("CC-BY-NC-4.0", "own", None) and got[5] == ("GPL-3.0", "own", None) and got[7] == ("Apache-2.0", "own", None)
    assert got[2] == got[4] == got[8] == got[10] == ("CC-BY-NC-4.0", "inherited", "a/b")
    assert got[6] == got[9] == got[None] == (None, "none", None)
    own = brute([(i, p, t) for i, p, t in ROWS])
    assert {r["id"]: r["own_license"] for r in out} == own


def test_root_licence_and_empty_table(spark):
    df = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License"), (2, "x/y/z.txt", "t"), (3, "w.txt", "t")], FILES)
    assert {r["id"]: (r["license"], r["from_dir"]) for r in license.scan(df, "id").collect()} == {1: ("MIT", None), 2: ("MIT", ""), 3: ("MIT", "")}
    assert license.scan(df.limit(0), "id").count() == 0


GPL3_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
BSD_HEADER = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following\n * conditions are met:"
GPL3_TEXT = "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n" + "Everyone may copy it.\n" * 60 + "13. Use with the GNU Affero General Public License.\nunder version 3 of the GNU Affero General Public License into a\nsingle work.\n"


def test_wrapped_headers_and_whole_licence_files(spark):
    rows = [
        (1, "p/LICENSE", "Released under the MIT License."), (2, "p/a.py", "This work is licensed under the GNU General\nPublic License, version 3."), (3, "p/b.c", "x\n" + BSD_HEADER + "\nint x;"),
        (4, "p/c.py", GPL3_HEADER + "\nimport os"), (5, "p/d.py", GPL3_HEADER.replace("version 3", "version 2")), (6, "p/e.py", "work\nplain version\n\npublic use"), (7, "g/COPYING", GPL3_TEXT),
        (8, "g/x.c", "t"), (9, "p/f.py", "one word a line: licensed\nunder\nthe\nApache\nLicense,\nVersion\n2.0\n"), (10, "l/LICENSE", "GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\nThis version incorporates version 3 of the GNU General Public License."),
    ]
    found = license.scan(spark.createDataFrame(rows, FILES), "id").collect()
    assert {r["id"]: r["own_license"] for r in found} == brute(rows)
    got = {r["id"]: (r["license"], r["via"]) for r in found}
    assert got == {
        1: ("MIT", "own"), 2: ("GPL-3.0", "own"), 3: ("BSD-3-Clause", "own"), 4: ("GPL-3.0", "own"), 5: ("GPL-2.0", "own"), 6: ("MIT", "inherited"), 7: ("GPL-3.0", "own"),
        8: ("GPL-3.0", "inherited"), 9: ("Apache-2.0", "own"), 10: ("LGPL-3.0", "own"),
    }


def test_words_of_licences_in_prose_make_none(spark):
    rows = [
        (1, "a.txt", "The court released a witness because an MIT professor said the fishing license had run out years ago."),
        (2, "b.txt", "He was licensed by the general in public under a new GNU herd; version 3 of the story is longer."),
        (3, "c.txt", "BSD 3-Clause License"), (4, "d.c", "/* Copyright 2020 Some One. Permission is hereby granted, free of charge, to any\n * person obtaining a copy of this software\n * and associated documentation\n * files (the Software) */"),
        (5, "e.py", "# SPDX-License-Identifier: GPL-3.0-or-later\nimport os"), (6, "f.md", "Copyright 2019 A. Uthor and others. Licensed under the Apache License, Version 2.0 (the License)."),
        (7, "g.txt", "Use of the public version is free, and the source code of this work is subject to terms and conditions."),
    ]
    found = {r["id"]: r["own_license"] for r in license.scan(spark.createDataFrame(rows, FILES), "id").collect()}
    assert found == brute(rows) == {1: None, 2: None, 3: "BSD-3-Clause", 4: "MIT", 5: "GPL-3.0", 6: "Apache-2.0", 7: None}
