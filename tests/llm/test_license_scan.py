import duckdb

from quillvec.llm import license_scan as scan

FILES = [
    ("r/LICENSE", "Released under the MIT License.", 1), ("r/a/x.py", "# Licensed under the Apache License, Version 2.0.\ncode code", 1),
    ("r/a/y.py", "nothing", 1), ("r/a/b/LICENSE.md", "Title\n\nLicensed under\nCC BY-NC 4.0.\n", 1), ("r/a/b/z", None, 1),
    ("r/a/b/c/d/w", "", 1), ("q/n", "no licence", 1), (None, "Released under the MIT License.", 1), ("r/a/y.py", "nothing", 1),
    ("top", "x", 1), ("big", "word " * 50000 + "\nThis work is licensed under the GNU General Public License, version 3.", 1),
    ("m/COPYING", "Released under the MIT License.", 1), ("m/LICENSE", "This work is licensed under the GNU General Public License, version 2.", 1), ("m/f", "f", 1),
]


def test_nearest_directory_wins(spark):
    filler = [(f"z/{i}", f"some words of file {i}", 1) for i in range(60)]
    frame = spark.createDataFrame(FILES + filler, "path string, text string, license int")
    found = scan.license_scan(frame).where("path IS NULL OR path NOT LIKE 'z/%'").collect()
    got = sorted(((repr(r["path"]), r["own_license"], r["license"], r["inherited_from"]) for r in found), key=repr)
    assert got == sorted([
        ("'r/LICENSE'", "MIT", "MIT", None), ("'r/a/x.py'", "Apache-2.0", "Apache-2.0", None), ("'r/a/y.py'", None, "MIT", "r"),
        ("'r/a/y.py'", None, "MIT", "r"), ("'r/a/b/LICENSE.md'", "CC-BY-NC-4.0", "CC-BY-NC-4.0", None), ("'r/a/b/z'", None, "CC-BY-NC-4.0", "r/a/b"),
        ("'r/a/b/c/d/w'", None, "CC-BY-NC-4.0", "r/a/b"), ("'q/n'", None, None, None), ("None", None, None, None), ("'top'", None, None, None),
        ("'big'", "GPL-3.0", "GPL-3.0", None), ("'m/COPYING'", "MIT", "MIT", None), ("'m/LICENSE'", "GPL-2.0", "GPL-2.0", None),
        ("'m/f'", None, "GPL-2.0", "m"),
    ], key=repr)


def test_names_of_licence_files(spark):
    names = {"LICENSE-MIT": True, "license_mit.txt": True, "COPYING.LIB": True, "Licence": True, "LICENSES": False, "my-license": False}
    files = [(f"d{i}/{n}", "Released under the MIT License.") for i, n in enumerate(names)] + [(f"d{i}/f", "f") for i in range(len(names))]
    files += [(f"z/{i}", f"some words of file {i}") for i in range(60)]
    found = {r["path"]: r["license"] for r in scan.license_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert [found[f"d{i}/f"] for i in range(len(names))] == ["MIT" if speaks else None for speaks in names.values()]


GNU = """
 * This {} is free software; you can redistribute it and/or
 * modify it under the terms of the GNU {}
 * as published by the Free Software Foundation; either
 * version {} of the License, or (at your option) any later version.
"""
MIT = """MIT License

Copyright (c) 2021 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice."""
STATED = {
    "GPL-2.0": [GNU.format("program", "General Public License", "2"), "GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991\n x"],
    "GPL-3.0": [GNU.format("program", "General Public License", "3"), "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007"],
    "LGPL-2.1": [GNU.format("library", "Lesser General Public License", "2.1")],
    "LGPL-3.0": [GNU.format("library", "Lesser General Public License", "3")],
    "AGPL-3.0": [GNU.format("program", "Affero General Public License", "3")],
    "ISC": ["Copyright x\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, "
            "provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS"],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE"],
    "MIT": [MIT, "Copyright 2020 Foo. Released under the MIT License. See https://x.example/y", "This project is licensed under the MIT License - see LICENSE"],
    "Apache-2.0": ["                Apache License\n          Version 2.0, January 2004\n   http://www", "// Copyright A. Licensed under the Apache License, Version 2.0. All rights"],
    "BSD-2-Clause": [BSD],
    "BSD-3-Clause": [BSD + "\n3. Neither the name of Foo Inc. nor the names of its contributors may be used to endorse or promote "
                     "products\nderived from this software without specific prior written permission."],
    "CC-BY-4.0": ["Text under CC BY 4.0 unless said. Licensed under CC BY 4.0 by us"],
    "CC-BY-NC-4.0": ["Pictures are licensed under CC BY-NC 4.0 by us"],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    None: ["Read the license before use", "the general public may enter; version 2", "with MIT students"],
}


def test_versions_and_statements_inside_longer_texts(spark):
    cases = [(f"c/{i}", name, text) for i, (name, text) in enumerate((n, t) for n, texts in STATED.items() for t in texts)]
    filler = [(f"z/{i}", f"some words of file {i} and the 2 or 3 of them") for i in range(200)]
    frame = spark.createDataFrame([(p, t) for p, _, t in cases] + filler, "path string, text string")
    found = {r["path"]: r["own_license"] for r in scan.license_scan(frame).where("path LIKE 'c/%'").collect()}
    assert found == {p: name for p, name, _ in cases}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "path string, text string")
    assert scan.license_scan(empty).count() == 0


def test_anchors_turn_no_match_away():
    idf = {t: 1.0 + (len(t) % 5) for t in ["", *scan.VOCABULARY]}
    found = set(scan.anchors(idf, 0.7))
    for _, statement, *_ in scan.TEMPLATES:
        terms = scan.terms_of(statement)
        left = sum((terms.count(t) * idf[t]) ** 2 for t in set(terms) - found)
        assert left < 0.49 * sum((terms.count(t) * idf[t]) ** 2 for t in set(terms))


def test_sql(spark):
    import __spark_entry__ as entry
    from tools.compare import rows_of

    sf = "/root/testdata/sf0.001"
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    theirs = base.execute(scan.SQL).fetchdf()
    assert rows_of(entry.queries()["op4_license_scan"](spark, sf).toPandas()) == rows_of(theirs)


def test_words_of_segments_stay_in_their_rows(spark, monkeypatch):
    """Segments are scored where they are: nothing is written that has a row per word, and scores follow the formula."""
    sizes, keep = {}, scan.settle

    def counted(df, label):
        kept = keep(df, label)
        sizes[label] = kept.count()
        return kept

    monkeypatch.setattr(scan, "settle", counted)
    stated = "Released by me and us under the MIT License, some more words"
    texts = [stated + " " + " ".join(f"w{i}x{j}" for j in range(60)) for i in range(20)] + [stated]
    frame = spark.createDataFrame([(f"a/{i}", t) for i, t in enumerate(texts)] + [(f"z/{i}", f"words of file {i}") for i in range(60)], "path string, text string")
    found = {r["path"]: r for r in scan.own_licenses(frame, 0.5).collect()}
    assert max(sizes.values()) < 6 * len(texts)
    idf = scan.term_weights(frame)
    best = 0.0
    for piece in [stated] + [" ".join(scan.terms_of(stated)[i : i + n]) for n in (3, 5) for i in range(-n, 12)]:
        held = scan.terms_of(piece)
        length = sum((held.count(t) * idf[t]) ** 2 if t in idf else held.count(t) * idf[""] ** 2 for t in set(held)) ** 0.5
        for name, statement, needed, other in scan.TEMPLATES:
            terms = scan.terms_of(statement)
            if name == "MIT" and set(needed.split()) <= set(held) and not set(other.split()) & set(held):
                size = sum((terms.count(t) * idf[t]) ** 2 for t in set(terms)) ** 0.5
                best = max(best, sum(held.count(t) * idf.get(t, 0.0) * terms.count(t) * idf[t] for t in set(terms)) / size / length)
    assert found["a/20"]["license"] == "MIT" and abs(found["a/20"]["score"] - best) < 2e-6
