"""Licences of files: TF-IDF cosine of headers and licence files to templates, then inheritance by directory."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.functions.vector import bind
from quillvec.llm.common import PLAIN_WORD_GAP, ascii_lower, documents, words
from quillvec.llm.near_dup import BROADCAST_IDS
from quillvec.session import settle

THRESHOLD = 0.7
# --- fixed values: licence statements and the names of licence files -------------------------------
# (licence, statement, terms that a match must hold, terms that it must not hold)
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "fee hereby granted", "provided"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007", "affero 3 november", ""),
    ("AGPL-3.0", GNU.format("Affero General Public License", "3"), "affero 3", ""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2 0", ""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004", "apache 2 0 january", ""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache 2 0", ""),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License.", "bsd 2", ""),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary", ""),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License.", "bsd 3", ""),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "neither endorse promote", ""),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "hereby organization accompanying", ""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc 4 0", "nc sa nd"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons 4 0", "noncommercial sharealike noderivatives"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc nc 4 0", "sa nd"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons noncommercial 4 0", "sharealike noderivatives"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc sa 4 0", "nc nd"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons sharealike 4 0", "noncommercial noderivatives"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "general public 2", "lesser library affero 3"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991", "general public 2 june", "lesser library affero 3"),
    ("GPL-2.0", GNU.format("General Public License", "2"), "general public 2", "lesser library affero 3"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "general public 3", "lesser library affero 2"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007", "general public 3 june", "lesser library affero 2"),
    ("GPL-3.0", GNU.format("General Public License", "3"), "general public 3", "lesser library affero 2"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "fee hereby provided notice", ""),
    ("ISC", "Released under the ISC License.", "isc", ""),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999", "lesser 2 1 february", ""),
    ("LGPL-2.1", GNU.format("Lesser General Public License", "2.1"), "lesser 2 1", "3"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007", "lesser 3 june", ""),
    ("LGPL-3.0", GNU.format("Lesser General Public License", "3"), "lesser 3", "2"),
    ("MIT", "Released under the MIT License.", "mit", ""),
    ("MIT", "The MIT License", "mit license", ""),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "hereby charge person obtaining", "organization"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2 0", ""),
    ("MPL-2.0", "Mozilla Public License Version 2.0", "mozilla 2 0", ""),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered", ""),
]
# A text that states the first also says what states the second.
SAYS_TOO = [("BSD-3-Clause", "BSD-2-Clause"), ("ISC", "0BSD")]
LICENSE_FILES = ["license", "licence", "copying", "notice", "unlicense"]
# --- end of fixed values ---------------------------------------------------------------------------


def terms_of(statement: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", statement.lower())


VOCABULARY = sorted({t for _, s, *_ in TEMPLATES for t in terms_of(s)})
# (term, words before it in the template, words of the template) of each term that a match must hold.
PLACES = sorted({(t, terms.index(t), len(terms)) for _, s, needed, _ in TEMPLATES for terms in [terms_of(s)] for t in needed.split()})


def runs(held: Column) -> Column:
    """The runs of words of a template's length that have one of its needed terms where the template has it."""
    size = F.size(held)
    by_term = {}
    for term, before, length in PLACES:
        by_term.setdefault(term, []).append((before, length))
    table = F.create_map(*[
        x for term, places in by_term.items()
        for x in (F.lit(term), F.array(*[F.struct(F.lit(b).alias("before"), F.lit(n).alias("length")) for b, n in places]))
    ])
    at = F.filter(F.transform(held, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda o: o["t"].isin(list(by_term)))

    def aligned(o: Column) -> Column:
        def cut(p: Column) -> Column:
            start = F.greatest(o["i"] - p["before"], F.lit(0))
            end = F.least(o["i"] - p["before"] + p["length"], size)
            return F.array_join(F.slice(held, start + 1, end - start), " ")

        return F.transform(F.element_at(table, o["t"]), cut)

    return F.flatten(F.transform(at, aligned))


def term_weights(texts: DataFrame) -> dict[str, float]:
    """idf of every template term over all texts: ln((1 + texts) / (1 + texts that hold it)); "" is a term of none."""
    listed = F.array(*[F.lit(t) for t in VOCABULARY])
    found = texts.select(F.explode(F.array_intersect(listed, words(ascii_lower(F.col("text")), PLAIN_WORD_GAP))).alias("t"))
    held = {r["t"]: r["count"] for r in found.groupBy("t").count().collect()}
    total = texts.count()
    return {t: math.log((1 + total) / (1 + held.get(t, 0))) for t in ["", *VOCABULARY]}


def anchors(idf: dict[str, float], threshold: float) -> list[str]:
    """Terms without any of which no text reaches the threshold for any template.

    What a text shares with a template bounds its cosine, so the heaviest terms of a template are taken until the
    others together have less than `threshold` of its length.
    """
    found = set()
    for _, statement, *_ in TEMPLATES:
        weights = {t: (statement_terms.count(t) * idf[t]) ** 2 for statement_terms in [terms_of(statement)] for t in statement_terms}
        left = total = sum(weights.values())
        for t in sorted(weights, key=lambda t: (-weights[t], t)):
            # The bound has a little room, so that rounding never turns a match away.
            if left < (threshold - 1e-6) ** 2 * total or not total:
                break
            found.add(t)
            left -= weights[t]
    return sorted(found)


def told_terms(terms: list[str], needed: str, other: str) -> dict[str, float]:
    """What each term of a template says: the needed ones add up to 1 within rounding, another licence's one takes 2."""
    return {t: 0.0 for t in terms} | {t: 1 / len(needed.split()) for t in needed.split()} | {t: -2.0 for t in other.split()}


# Terms that are counted, those that only tell other licences too.
COUNTED = [*VOCABULARY, *sorted({t for _, _, _, other in TEMPLATES for t in other.split()} - set(VOCABULARY))]
VECTORS = (
    "array<struct<license: string, template: int, needed: array<int>, other: array<int>, terms: array<struct<place: int, weight: double>>>>"
)


def shares(held: Column, idf: dict[str, float]) -> Column:
    """What a segment's words share with each template whose needed terms they have and whose other ones they lack.

    An array of license, template, dot (with the template's unit vector), known and unknown: the squared length that
    template terms and all other words add to the segment's vector.
    """
    places = {t: i for i, t in enumerate(COUNTED)}
    vectors = []
    for i, (name, statement, needed, other) in enumerate(TEMPLATES):
        terms = terms_of(statement)
        length = math.sqrt(sum((terms.count(t) * idf[t]) ** 2 for t in set(terms))) or 1.0
        vectors.append({
            "license": name, "template": i, "needed": [places[t] for t in needed.split()], "other": [places[t] for t in other.split()],
            "terms": [{"place": places[t], "weight": terms.count(t) * idf[t] / length} for t in sorted(set(terms))],
        })
    # Constants as one text each, so that a plan holds few expressions.
    templates = F.from_json(F.lit(json.dumps(vectors)), VECTORS)
    weights = F.from_json(F.lit(json.dumps([idf.get(t, 0.0) for t in COUNTED])), "array<double>")
    listed = F.split(F.lit(" ".join(COUNTED)), " ")
    zero = F.lit(0.0)

    def matches(counts: Column, total: Column) -> Column:
        weighted = F.zip_with(counts, weights, lambda n, w: n * w)
        unknown = (total - F.aggregate(F.slice(counts, 1, len(VOCABULARY)), F.lit(0), lambda s, n: s + n)) * (idf[""] * idf[""])
        fit = F.filter(templates, lambda v: (
            F.forall(v["needed"], lambda p: F.get(counts, p) > 0) & F.forall(v["other"], lambda p: F.get(counts, p) == 0)
        ))

        def product(w: Column) -> Column:
            return F.transform(fit, lambda v: F.struct(
                v["license"].alias("license"), v["template"].alias("template"),
                F.aggregate(v["terms"], zero, lambda s, x: s + F.get(w, x["place"]) * x["weight"]).alias("dot"),
                F.aggregate(w, zero, lambda s, x: s + x * x).alias("known"), unknown.alias("unknown"),
            ))

        return bind(weighted, product)

    def counted(known: Column) -> Column:
        counts = F.transform(listed, lambda t: F.size(known) - F.size(F.array_remove(known, t)))
        return bind(counts, lambda c: matches(c, F.size(held)))

    return bind(F.filter(held, lambda t: t.isin(COUNTED)), counted)


def own_licenses(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """path, license, score of each path that states a licence: the best template over its lines, paragraphs and runs.

    A line is cut at line feeds, a paragraph at blank lines, a run is as many words as a template has, over line ends
    too, with a needed term of the template at its place; all of the text is read. A match must hold the terms that
    tell its licence from others, such as the version, and none of another's. A word outside the templates' vocabulary
    counts as a term of its own with the highest idf. Ties go to the first licence by name; a licence
    gives way to one that repeats its words (SAYS_TOO).
    """
    rows = files.select("path", F.coalesce("text", F.lit("")).alias("text"))
    idf = term_weights(rows)
    anchored = anchors(idf, threshold)
    pattern = "(?i)(?<![0-9a-z\\x80-\\x{10FFFF}])(?:" + "|".join(anchored) + ")(?![0-9a-z\\x80-\\x{10FFFF}])"
    if not anchored:
        return rows.select("path", F.lit("").alias("license"), F.lit(0.0).alias("score")).limit(0)
    # The lambda's variable holds the words, so that they are cut once a text.
    held = F.flatten(F.transform(F.array(words(ascii_lower(F.col("text")), PLAIN_WORD_GAP)), runs))
    cut = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", "\n[ \t\r]*\n"), held))
    stated = rows.where(F.col("text").rlike(pattern)).select("path", F.explode(cut).alias("segment"))
    segments = settle(stated.where(F.col("segment").rlike(pattern)), "segments")
    shared = bind(words(ascii_lower(F.col("segment")), PLAIN_WORD_GAP), lambda held: shares(held, idf))
    found = segments.select("path", F.md5("segment").alias("segment"), F.inline(shared))
    # What a segment shares with a template is found in its row, so no word leaves it; equal segments of a path are one
    # that holds its words so many times.
    copies = F.count(F.lit(1))
    scored = found.groupBy("path", "segment", "license", "template").agg(
        (copies * F.max("dot")).alias("dot"), F.sqrt(copies * copies * F.max("known") + copies * F.max("unknown")).alias("length")
    ).where("length > 0").withColumn("score", F.round(F.col("dot") / F.col("length"), 6))
    # A path has at most one row a licence from here on.
    each = scored.where(F.col("score") >= threshold).groupBy("path", "license").agg(F.max("score").alias("score"))
    ranks = each.groupBy("path").agg(F.collect_list(F.struct((-F.col("score")).alias("below"), "license")).alias("ranks"))
    repeated = lambda r: F.array_contains(
        "names", F.element_at(F.create_map(*[F.lit(x) for more, less in SAYS_TOO for x in (less, more)]), r["license"])
    )
    best = ranks.withColumn("names", F.col("ranks.license")).select(
        "path", F.array_min(F.filter("ranks", lambda r: ~F.coalesce(repeated(r), F.lit(False)))).alias("best")
    )
    return best.select("path", "best.license", (-F.col("best.below")).alias("score"))


def parents(path: str) -> Column:
    """The directories above a path, nearest last; "" is the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def license_scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For every row of `files` (path, text): path, own_license, score, license, inherited_from.

    own_license is what the file's text states (null if nothing), score its cosine. license is the same, or else that
    of the nearest directory above whose licence files (LICENSE, COPYING, NOTICE ..., alone or before ".", "-" or "_") state one; the
    licence file itself speaks for its directory. If several of a directory do, the highest score wins, then the name.
    inherited_from is that directory, "" the root. A row without path inherits nothing; a null or empty text states
    nothing; rows that share a path share its best statement; an empty table gives no rows.
    """
    own = settle(own_licenses(files.where(F.col("path").isNotNull()), threshold), "own")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    declared = own.where(F.split(name, "[-_.]")[0].isin(LICENSE_FILES)).select(
        F.element_at(parents("path"), -1).alias("dir"), "license", "score"
    )
    declares = settle(
        declared.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("below"), "license")).alias("best")).select("dir", F.col("best.license").alias("dir_license")),
        "declared",
    )
    homes = files.where(F.col("path").isNotNull()).select(F.element_at(parents("path"), -1).alias("home")).distinct()
    above = homes.select("home", F.posexplode(F.concat(parents("home"), F.array("home"))).alias("depth", "dir")).distinct()
    near = above.join(declares, "dir").groupBy("home").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("near"))
    near = settle(near.select("home", F.col("near.dir").alias("dir"), F.col("near.dir_license").alias("dir_license")), "near")
    size = near.count()
    mine = own.withColumnRenamed("license", "own_license")
    placed = files.select("path", F.element_at(parents("path"), -1).alias("home"))
    joined = placed.join(F.broadcast(near) if size <= BROADCAST_IDS // 10 else near, "home", "left").join(mine, "path", "left")
    return joined.select(
        "path",
        "own_license",
        "score",
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("dir")).alias("inherited_from"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: a source is a repository of directories of 2,000 rows, in them others of 200. Of 200 rows
    20 are LICENSE files of the outer directory and 20 of the inner one."""
    i = F.col("doc_id")
    tens = F.floor(i / 20) % 10
    outer = F.concat(F.coalesce("source", F.lit("none")), F.lit("/a"), F.floor(i / 2000).cast("string"))
    inner = F.concat(outer, F.lit("/b"), F.floor(i / 200).cast("string"))
    path = (
        F.when(tens == 0, F.concat(outer, F.lit("/LICENSE."), i.cast("string")))
        .when(tens == 5, F.concat(inner, F.lit("/LICENSE."), i.cast("string")))
        .otherwise(F.concat(inner, F.lit("/f"), i.cast("string"), F.lit(".txt")))
    )
    return docs.select("doc_id", path.alias("path"), "text")


def query(spark, sf: str) -> DataFrame:
    return license_scan(document_paths(documents(spark, sf)))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    statements = ", ".join(
        f"({i}, {quoted(name)}, {quoted(t)}, {terms.count(t)}, {told!r}::DOUBLE)"
        for i, (name, statement, needed, other) in enumerate(TEMPLATES) for terms in [terms_of(statement)]
        for t, told in sorted(told_terms(terms, needed, other).items())
    )
    places = ", ".join(f"({quoted(t)}, {before}, {length})" for t, before, length in PLACES)
    repeated = " OR ".join(
        f"(license = {quoted(less)} AND bool_or(license = {quoted(more)}) OVER (PARTITION BY home, name))" for more, less in SAYS_TOO
    )
    lowered = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = rf"list_filter(regexp_split_to_array({lowered}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
WITH files AS (
  SELECT coalesce(source, 'none') || '/a' || (doc_id // 2000)
           || CASE WHEN doc_id // 20 % 10 = 0 THEN '' ELSE '/b' || (doc_id // 200) END AS home,
         CASE WHEN doc_id // 20 % 10 IN (0, 5) THEN 'LICENSE.' || doc_id ELSE 'f' || doc_id || '.txt' END AS name,
         coalesce(text, '') AS text FROM documents),
stated(template, license, term, tf, told) AS (VALUES {statements}),
places(term, before, length) AS (VALUES {places}),
held AS (SELECT unnest(list_distinct({split.format('text')})) AS term FROM files),
total AS (SELECT count(*) AS n FROM files),
idf AS (
  SELECT term, ln((1.0 + (SELECT n FROM total)) / (1.0 + (SELECT count(*) FROM held WHERE held.term = v.term))) AS idf
  FROM (SELECT DISTINCT term FROM stated WHERE tf > 0) v),
vectors AS (
  SELECT template, license, term, told,
         CASE WHEN tf = 0 THEN 0 ELSE tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) END AS weight
  FROM stated LEFT JOIN idf USING (term)),
worded AS (SELECT home, name, {split.format('text')} AS w FROM files),
placed AS (SELECT home, name, w, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS i FROM worded),
runs AS (
  SELECT home, name, array_to_string(list_slice(w, greatest(i - before, 0) + 1, least(i - before + length, len(w))), ' ') AS segment
  FROM placed JOIN places USING (term)),
segments AS (
  SELECT home, name, segment, row_number() OVER () AS id
  FROM (SELECT home, name, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t\r]*\n'))) AS segment FROM files
        UNION SELECT home, name, segment FROM runs)),
counted AS (
  SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({split.format('segment')}) AS term FROM segments) GROUP BY ALL),
lengths AS (
  SELECT id, sqrt(sum(CASE WHEN idf IS NULL THEN tf * ln(1.0 + n) * ln(1.0 + n) ELSE tf * idf * tf * idf END)) AS length
  FROM counted LEFT JOIN idf USING (term) CROSS JOIN total GROUP BY id),
scores AS (
  SELECT id, license, round(sum(tf * coalesce(idf, 0) * weight) / any_value(length), 6) AS score
  FROM counted LEFT JOIN idf USING (term) JOIN vectors USING (term) JOIN lengths USING (id) WHERE length > 0
  GROUP BY id, template, license HAVING sum(told) > 0.99),
stating AS (
  SELECT home, name, license, score, {repeated} AS repeated
  FROM scores JOIN segments USING (id) WHERE score >= {THRESHOLD}),
own AS (
  SELECT home, name, license, score FROM (
    SELECT home, name, license, score, row_number() OVER (PARTITION BY home, name ORDER BY score DESC, license) AS place
    FROM stating WHERE NOT repeated)
  WHERE place = 1),
declared AS (
  SELECT home, license FROM (
    SELECT home, license, row_number() OVER (PARTITION BY home ORDER BY score DESC, license) AS place
    FROM own WHERE name LIKE 'LICENSE.%')
  WHERE place = 1)
SELECT f.home || '/' || f.name AS path, o.license AS own_license, o.score, coalesce(o.license, d.license, e.license) AS license,
       CASE WHEN o.license IS NULL THEN coalesce(d.home, e.home) END AS inherited_from
FROM files f LEFT JOIN own o ON f.home = o.home AND f.name = o.name LEFT JOIN declared d ON f.home = d.home
LEFT JOIN declared e ON regexp_replace(f.home, '/b[0-9]+$', '') = e.home"""


SQL = _sql()
