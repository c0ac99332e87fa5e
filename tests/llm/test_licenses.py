from pyspark.sql import functions as F

from sitescope.llm import licenses


def test_odd_documents(odd, none):
    got = {r["doc"]["doc_id"]: (r["own_license"], r["own_score"]) for r in licenses.best(odd).collect()}
    assert len(got) == 13 and got[1] == got[2] == got[3] == (None, None)
    assert licenses.license_report(odd).count() == odd.count()
    assert licenses.license_report(none).count() == 0


def test_templates_find_themselves(spark):
    rows = [(k, f"Some words first.\n\n{t}\n\nAnd the end.") for k, (_, t) in enumerate(licenses.TEMPLATES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc"]["doc_id"]: r["own_license"] for r in licenses.best(docs).collect()}
    assert got == {k: name for k, (name, _) in enumerate(licenses.TEMPLATES)}


def test_inheritance(spark):
    rows = [("LICENSE", "MIT"), ("a/LICENSE", "GPL-3.0"), ("a/b/c/x.py", None), ("a/b/y.py", "Apache-2.0"), ("z.py", None), ("ab/w.py", None), (None, None), ("a/b/LICENSE", None)]
    files = spark.createDataFrame(rows, "path string, own_license string")
    out = licenses.inherit(files, F.col("path").rlike("(^|/)LICENSE$"))
    got = {r["path"]: (r["license"], r["inherited_from"]) for r in out.collect()}
    assert got == {"LICENSE": ("MIT", None), "a/LICENSE": ("GPL-3.0", None), "a/b/c/x.py": ("unknown", "a/b"), "a/b/y.py": ("Apache-2.0", None), "z.py": ("MIT", ""), "ab/w.py": ("MIT", ""), None: (None, None), "a/b/LICENSE": ("unknown", "a/b")}


def test_anchors_are_enough():
    """A unit with fewer anchors than asked cannot reach the threshold, whatever else it holds."""
    for kind in licenses.kinds():
        idf = licenses.weights(kind.vocabulary, 100, {t: len(t) * 7 % 100 for t in kind.vocabulary})
        for counts in kind.counts:
            chosen, least = licenses.anchors(counts, idf)
            own = {t: w * w for t, w in licenses.vector(counts, idf).items()}
            few = sorted((own[t] for t in chosen), reverse=True)[: least - 1]
            assert least > 0 and sum(w for t, w in own.items() if t not in chosen) + sum(few) < licenses.THRESHOLD**2 * sum(own.values())


def test_whole_files(spark):
    """Licence files with a head of their own, other line lengths and a changed name; and texts that are not licences."""
    import textwrap

    found = licenses.whole_texts()
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense"} <= {name for name, _ in found}
    rows = [(k, "Copyright (c) 2020 Some People\n\n" + textwrap.fill(" ".join(t.split()), 60).replace("COPYRIGHT HOLDERS", "AUTHORS")) for k, (_, t) in enumerate(found)]
    rows += [(100 + k, " ".join(f"word{k * i % 83} of the and to" for i in range(400))) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc"]["doc_id"]: r["own_license"] for r in licenses.best(docs).collect()}
    assert {k: v for k, v in got.items() if v} == {k: name for k, (name, _) in enumerate(found)}


def test_every_text_has_its_own_name(spark):
    """Each version's whole text as it stands, next to its neighbours; a folder without them is an error."""
    import pytest

    found = licenses.whole_texts()
    assert len(found) == len(licenses.FILES) + len(licenses.KEPT)
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(found)], "doc_id long, text string")
    assert {r["doc"]["doc_id"]: r["own_license"] for r in licenses.best(docs).collect()} == {k: name for k, (name, _) in enumerate(found)}
    with pytest.raises(OSError):
        licenses.whole_texts("/nowhere")


def test_other_licences_get_no_name(spark):
    """Notices of other versions, which differ by a number alone, and of other licences."""
    rows = [
        "Licensed under the Apache License, Version 1.1.",
        "This work is licensed under a Creative Commons Attribution 3.0 International License.",
        "Licensed under CC BY-NC 2.5.",
        "This work is licensed under the GNU General Public License, version 1.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 9 of the License, or (at your option) any later version.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
        "Licensed under the Academic Free License version 3.0",
        "Distributed under the Boost Software License, Version 1.0.",
        "Licensed under the EUPL, Version 1.2 or later",
        "This is licensed under the Common Public License 1.0 as published by IBM.",
    ]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r["own_license"] for r in licenses.best(docs).collect()} == {None}


def test_equal_scores(spark):
    """Of a notice and a whole text that score alike the text names the document; of equal notices the first."""
    unlicense = dict(licenses.FILES)["Unlicense"]
    rows = [(1, unlicense), (2, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (3, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.")]
    got = {r["doc"]["doc_id"]: r["own_license"] for r in licenses.best(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "Unlicense", 2: "CC-BY-NC-4.0", 3: "CC-BY-NC-4.0"}
