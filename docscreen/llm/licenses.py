"""Licence scans with DataFrame functions alone.

Each document that mentions licensing gives units: the whole text, each sentence or line
that holds a licence word, and each run of up to RUN segments that begins and ends with one
that holds a licence word. Segments are the sentences of the text with comment marks and list
numbers removed and the lines of a paragraph joined, so a notice wrapped in a comment is
compared as one piece. SPDX identifiers count by name, with a cosine of 1. A unit's TF-IDF vector is compared by cosine with those of the
licence templates: terms are joined with the templates' weights and summed, so only terms
that both hold are multiplied. The best template of at least ``least`` (0.8) is the
document's own licence. A document that is a licence as a whole, or has a licence and a
licence file's name, speaks for its directory. Documents without an own licence inherit
from the nearest directory above them that has one: directories are joined with each of
their ancestors, and files with their directory.

The SQL twin has the whole text and single sentences and lines only: it agrees where no
notice is wrapped and no line holds an SPDX identifier that the templates don't spell out.

The templates are a fixed list, so their weights are small whatever the corpus holds; sums
are aggregated before they are shuffled.

Defined results: null and empty texts have no own licence but inherit; a null path has no
ancestors; rows that repeat an id and path count as one document whose units are pooled;
equal cosines go to the template whose name sorts first; of several licence files in one
directory the one with the greatest cosine, then the first path, speaks; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

LEAST = 0.8

_CC = {"BY": "Attribution", "BY-SA": "Attribution ShareAlike", "BY-NC": "Attribution NonCommercial", "BY-ND": "Attribution NoDerivatives", "BY-NC-SA": "Attribution NonCommercial ShareAlike", "BY-NC-ND": "Attribution NonCommercial NoDerivatives"}
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."


def _gnu(name: str, version: int) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


def templates() -> list[tuple[str, str]]:
    """(licence, text): full notices, and the short statements that headers use."""
    out = [("MIT", _MIT), ("ISC", _ISC), ("BSD-2-Clause", _BSD), ("BSD-3-Clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."), ("Apache-2.0", _APACHE)]
    short = {
        "Apache-2.0": ["Apache License, Version 2.0"],
        "MIT": ["MIT License"],
        "ISC": ["ISC License"],
        "BSD-2-Clause": ["BSD 2-Clause License"],
        "BSD-3-Clause": ["BSD 3-Clause License"],
        "MPL-2.0": ["Mozilla Public License, version 2.0"],
        "EPL-2.0": ["Eclipse Public License, version 2.0"],
        "BSL-1.0": ["Boost Software License, version 1.0"],
        "Unlicense": ["Unlicense"],
        "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0 Universal"],
    }
    for name, spdx in (("General Public License", "GPL"), ("Lesser General Public License", "LGPL"), ("Affero General Public License", "AGPL")):
        for version in {"GPL": (2, 3), "LGPL": (2, 3), "AGPL": (3,)}[spdx]:
            short.setdefault(f"{spdx}-{version}.0", []).append(f"GNU {name}, version {version}")
            out.append((f"{spdx}-{version}.0", _gnu(name, version)))
    for terms, words in _CC.items():
        for version in ("3.0", "4.0"):
            short[f"CC-{terms}-{version}"] = [f"CC {terms} {version}", f"Creative Commons {words} {version} International License"]
    for spdx, names in short.items():
        for name in names:
            out += [(spdx, f"{start} {name}") for start in ("Licensed under the", "Released under the", "This work is licensed under the", "SPDX-License-Identifier")]
            out += [(spdx, f"Licensed under {name}")] if name.startswith("CC") else []
    out.append(("Public-Domain", "This work is in the public domain"))
    out.append(("Proprietary", "Copyright. All rights reserved."))
    return out


#: SPDX families whose identifiers may end in -only, -or-later or +.
_FAMILIES = {"GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0"), "AGPL": ("1.0", "3.0")}


def spdx_ids() -> dict[str, str]:
    """Licence of each SPDX identifier, letters and digits in lower case."""
    ids = {name: name for name, _ in templates() if name not in ("Public-Domain", "Proprietary")}
    for family, versions in _FAMILIES.items():
        ids |= {f"{family}-{v}{end}": f"{family}-{v}" for v in versions for end in ("", "-only", "-or-later")}
    return {re.sub("[^a-z0-9]", "", k.lower()): v for k, v in ids.items()}


#: A text that holds none of these has no licence of its own.
MENTION = r"(?i)(licen[cs]|copyright|public domain|creative commons|permission is hereby|redistribution)"
#: Ends of sentences and lines.
BREAK = r"\n|[.;!?][ \t\r\f\n]+"
TERM = "[A-Za-z0-9]+"
#: Sentences between two mentions that a run may take in; the longest template has four, and addresses or stray stops add some.
RUN = 6
_MARK = r"(?://+|#+|--+|;+|%+|\*+|!+|dnl\b|REM\b)"
#: Replaced in this order, so that an empty line ends each comment and each copyright line, and lines of a paragraph hold text alone.
_BARE = (
    (r"\r\n?", "\n"),
    (r"/\*+|\*+/|<!--|-->|\"{3}|'{3}", "\n\n"),
    (rf"(?dm)^([ \t]*{_MARK}[^\n]*)\n(?![ \t]*{_MARK})", "$1\n\n"),
    (rf"(?dm)^[ \t]*(?:{_MARK}[ \t]*){{0,3}}(?:\(?(?:[0-9]{{1,2}}|[a-z])[.)][ \t]+)?", ""),
    (r"(?dim)^(copyright[ \t]+(?:\(c\)|\u00a9|[0-9]{4})[^\n]*)$", "\n$1\n"),
    (r"(?dm)^[^A-Za-z0-9\n]+$", ""),
)
SEGMENT = r"\n{2,}|[.;!?][ \t\f\n]+"
SPDX_LINE = r"(?i)SPDX-License-Identifier:[ \t]*([^\r\n]*)"
#: Before the letters and digits of an identifier, in a term that stands for it alone.
SPDX_TERM = "spdxidentifier"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"


def weights() -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, term, normed weight), the inverse document frequency of each term, and that of terms that no template holds."""
    texts = [(name, Counter(t.lower() for t in re.findall(TERM, text))) for name, text in templates()]
    n, df = len(texts), Counter(t for _, c in texts for t in c)
    idf = {t: math.log((n + 1) / (k + 1)) + 1 for t, k in df.items()}
    rows = []
    for i, (name, c) in enumerate(texts):
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        rows += [(i, name, t, k * idf[t] / norm) for t, k in sorted(c.items())]
    return rows, idf, math.log(n + 1) + 1


def parent(path: Column) -> Column:
    """The directory of a path; '' is the root's."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """A directory and all above it, from the root ('') down."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def segments(text: Column) -> Column:
    """The sentences of a text without comment marks, lines of a paragraph joined."""
    for pattern, by in _BARE:
        text = F.regexp_replace(text, pattern, by)
    return F.split(text, SEGMENT)


def runs(parts: Column, at: Column) -> Column:
    """Up to RUN adjacent parts joined, from and to those at the given places."""
    ends = lambda i, k: F.filter(F.slice(at, k + 1, RUN), lambda j: j < i + RUN)
    return F.flatten(F.transform(at, lambda i, k: F.transform(ends(i, k), lambda j: F.array_join(F.slice(parts, i + 1, j - i + 1), " "))))


def identifiers(text: Column) -> Column:
    """A term for each word of the SPDX lines of a text."""
    tokens = lambda line: F.regexp_extract_all(line, F.lit("([A-Za-z0-9.+-]+)"))
    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SPDX_LINE)), tokens))
    return F.transform(found, lambda x: F.concat(F.lit(SPDX_TERM), F.regexp_replace(F.lower(x), "[^a-z0-9]", "")))


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which any may be null."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how)


def scan(files: DataFrame, least: float = LEAST, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """doc_id, path, license, how ('own', 'inherited' or null), cosine, from_dir for each (doc_id, path)."""
    spark = files.sparkSession
    rows, idf, unknown = weights()
    n, ids, later = len(templates()), spdx_ids(), Counter(re.findall(TERM, _gnu("Lesser General Public License", 2).lower()) + ["1"])
    norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in later.items()))
    rows += [(n, "LGPL-2.1", t, k * idf[t] / norm) for t, k in sorted(later.items())]
    rows += [(n + 1 + i, name, SPDX_TERM + x, 1.0) for i, (x, name) in enumerate(sorted(ids.items()))]
    idf = idf | {SPDX_TERM + x: unknown for x in ids}
    vectors = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, '{name}', '{t}', {w!r}D)" for i, name, t, w in rows) + " AS t(template, license, term, weight)")
    known = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{t}', {w!r}D)" for t, w in idf.items()) + " AS t(term, idf)")
    files = files.select(files[id_col].cast("long").alias("doc_id"), files[path_col].cast("string").alias("path"), files[text_col].cast("string").alias("text"))
    names = files.select("doc_id", "path").distinct()
    sentences = F.filter(F.split("text", BREAK), lambda s: s.rlike(MENTION))
    # The one shuffle of text, of documents that mention licensing: all sums up to a document's best template stay in its partition.
    mentions = files.where(F.col("text").rlike(MENTION)).repartition("doc_id", "path").withColumn("parts", segments(F.col("text")))
    places = F.filter(F.transform("parts", lambda s, i: F.when(s.rlike(MENTION), i)), lambda i: i.isNotNull())
    mentions = mentions.withColumn("at", places)
    said = F.concat(F.array("text"), sentences, runs(F.col("parts"), F.col("at")), identifiers(F.col("text")))
    units = mentions.select("doc_id", "path", F.posexplode(said).alias("unit", "said"))
    units = units.withColumn("unit", F.when(F.col("unit") > 0, F.xxhash64("said")).otherwise(F.lit(0)))  # a sentence said twice is one unit
    terms = units.select("doc_id", "path", "unit", F.explode(F.regexp_extract_all("said", F.lit(f"({TERM})"))).alias("term"))
    tf = terms.groupBy("doc_id", "path", "unit", F.lower("term").alias("term")).agg(F.count("*").alias("tf"))
    # Both tables are of fixed size: the templates are part of this module.
    weighed = tf.join(F.broadcast(known), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    # What is listed for a unit is at most the templates' terms.
    listed = F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "x"))).alias("listed")
    held = F.sqrt(F.sum(F.when(F.col("idf").isNotNull(), F.col("x") * F.col("x")))).alias("held")
    vectored = weighed.groupBy("doc_id", "path", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), held, listed)
    # No cosine is greater than the share of the norm that terms of templates have.
    vectored = vectored.where(F.col("held") >= (least - 1e-5) * F.col("norm"))
    dots = vectored.select("doc_id", "path", "unit", "norm", F.inline("listed")).join(F.broadcast(vectors), "term").groupBy("doc_id", "path", "unit", "norm", "template", "license")
    cosine = F.round(F.sum(F.col("x") * F.col("weight")) / F.col("norm"), 6)
    close = dots.agg(cosine.alias("cosine")).select("doc_id", "path", "unit", "license", "cosine").where(F.col("cosine") >= least)
    best = F.min(F.struct((-F.col("cosine")).alias("less"), "license"))
    own = materialize(close.groupBy("doc_id", "path").agg(best.alias("best"), F.min(F.when(F.col("unit") == 0, F.struct((-F.col("cosine")).alias("less"), "license"))).alias("whole")), "licences")
    speaks = F.coalesce("whole", F.when(F.col("path").rlike(FILE_NAME), F.col("best")))
    directories = own.where(F.col("path").isNotNull() & speaks.isNotNull()).groupBy(parent(F.col("path")).alias("dir"))
    directories = directories.agg(F.min(F.struct(speaks["less"].alias("less"), F.col("path"), speaks["license"].alias("license"))).alias("s")).select("dir", F.col("s.license").alias("dir_license"))
    found = _join(names, own, ["doc_id", "path"], "left").select("doc_id", "path", F.col("best.license").alias("own_license"), (-F.col("best.less")).alias("cosine"))
    # A directory's nearest licence is found once for each directory that holds files, not for each file;
    # the root, above all of them, has one licence at most and is kept out of the join.
    folders = files.where("path is not null").select(parent(F.col("path")).alias("folder")).distinct()
    above = folders.select("folder", F.posexplode(ancestors(F.col("folder"))).alias("depth", "dir")).where("dir <> ''")
    nearest = above.join(directories, "dir").groupBy("folder").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("n"))
    root = directories.where("dir = ''").select("dir", "dir_license").first() or (None, None)  # one row at most
    resolved = folders.join(nearest, "folder", "left")
    resolved = resolved.select("folder", F.coalesce("n.dir", F.lit(root[0])).alias("from_dir"), F.coalesce("n.dir_license", F.lit(root[1])).alias("dir_license")).where("from_dir is not null")
    found = found.withColumn("_folder", F.when(F.col("own_license").isNull(), parent(F.col("path"))))
    return found.join(resolved, F.col("_folder") == F.col("folder"), "left").select(
        "doc_id",
        "path",
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(F.col("from_dir").isNotNull(), "inherited").alias("how"),
        "cosine",
        "from_dir",
    )


def sql(table: str, path: str, least: float = LEAST) -> str:
    """The same as DuckDB SQL over a table with doc_id and text; path: the expression for a row's path."""
    rows, idf, unknown = weights()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    vectors = ", ".join(f"({i}, {quote(name)}, {quote(t)}, {w!r}::DOUBLE)" for i, name, t, w in rows)
    known = ", ".join(f"({quote(t)}, {w!r}::DOUBLE)" for t, w in idf.items())
    mention, name = quote(MENTION), quote(FILE_NAME)
    parent_sql = lambda p: f"regexp_replace({p}, '/?[^/]*$', '')"
    return f"""
    WITH vectors(template, license, term, weight) AS (VALUES {vectors}),
    known(term, idf) AS (VALUES {known}),
    files AS (SELECT doc_id, {path} AS path, text FROM {table}),
    names AS (SELECT DISTINCT doc_id, path FROM files),
    units AS (SELECT doc_id, path, '' AS unit, text AS said FROM files WHERE regexp_matches(text, {mention})
      UNION SELECT doc_id, path, s AS unit, s AS said FROM (SELECT doc_id, path, unnest(regexp_split_to_array(text, {quote(BREAK)})) AS s FROM files WHERE regexp_matches(text, {mention})) WHERE regexp_matches(s, {mention})),
    terms AS (SELECT doc_id, path, unit, lower(unnest(regexp_extract_all(said, '{TERM}'))) AS term FROM units),
    tf AS (SELECT doc_id, path, unit, term, count(*) AS tf FROM terms GROUP BY ALL),
    weighed AS (SELECT tf.*, tf * coalesce(idf, {unknown!r}::DOUBLE) AS x FROM tf LEFT JOIN known USING (term)),
    norms AS (SELECT doc_id, path, unit, sqrt(sum(x * x)) AS norm FROM weighed GROUP BY ALL),
    dots AS (SELECT doc_id, path, unit, template, license, sum(x * weight) AS dot FROM weighed JOIN vectors USING (term) GROUP BY ALL),
    close AS (SELECT doc_id, path, unit, license, round(dot / norm, 6) AS cosine FROM dots JOIN norms USING (doc_id, path, unit) WHERE round(dot / norm, 6) >= {least}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY cosine DESC, license) AS k, row_number() OVER (PARTITION BY doc_id, path, unit ORDER BY cosine DESC, license) AS ku FROM close),
    own AS (SELECT doc_id, path, license, cosine FROM ranked WHERE k = 1),
    speak AS (SELECT doc_id, path, license, cosine FROM ranked WHERE unit = '' AND ku = 1
      UNION ALL SELECT * FROM own WHERE regexp_matches(path, {name}) AND NOT EXISTS (SELECT 1 FROM ranked r WHERE r.unit = '' AND r.doc_id = own.doc_id AND r.path = own.path)),
    dirs AS (SELECT {parent_sql("path")} AS dir, license FROM speak QUALIFY row_number() OVER (PARTITION BY {parent_sql("path")} ORDER BY cosine DESC, path, license) = 1),
    above AS (SELECT n.doc_id, n.path, d.dir, d.license FROM names n ANTI JOIN own USING (doc_id, path) JOIN dirs d ON d.dir = '' OR starts_with(n.path, d.dir || '/')),
    nearest AS (SELECT * FROM above QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY length(dir) DESC) = 1)
    SELECT n.doc_id, n.path, coalesce(o.license, a.license) AS license,
           CASE WHEN o.license IS NOT NULL THEN 'own' WHEN a.license IS NOT NULL THEN 'inherited' END AS how, o.cosine, a.dir AS from_dir
    FROM names n LEFT JOIN own o USING (doc_id, path) LEFT JOIN nearest a USING (doc_id, path)"""
