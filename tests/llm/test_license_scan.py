"""License scans of long templates and of notices that differ from the templates."""

from pagemill.llm import op10_license_scan as op10


def scanned(spark, texts, *more, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.template): r.containment for r in op10.scan(docs, *more, **options).collect()}


def test_long_templates_without_their_beginning(spark):
    words = [f"t{i}" for i in range(1000)]
    tail = [f"p{i}" for i in range(300)]
    other = [f"q{i}" for i in range(20)]
    halves = [*words[:450], *tail, *words[450:]]
    texts = [words[20:], other + words[20:], tail + words[20:] + tail, words[:820], halves, words[:700], words[300:900], words[:20] + tail]
    found = scanned(spark, [" ".join(w) for w in texts], [("L", " ".join(words)), ("S", " ".join(words[:17]))])
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = {(i, "L"): len(shingles(w) & shingles(words)) / 996 for i, w in enumerate(texts)}
    assert {k: v for k, v in found.items() if k[1] == "L"} == {k: v for k, v in want.items() if v >= 0.8}
    assert {k for k in want if want[k] >= 0.8} == {(i, "L") for i in range(5)}
    assert {i for i, t in found if t == "S"} == {3, 4, 5, 7}


def test_notices_that_differ_from_the_templates(spark):
    full = dict(op10.TEXTS)
    texts = [
        "Released under the MIT License", 'Licensed under the Apache License, Version 2.0 (the "License")', "is licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU General Public License, version 2.", "distribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
        "Licence\n" + " ".join(full["MIT-text"].split()[10:]), " ".join(full["GPL-3.0-text"].split()[200:]), full["LGPL-2.1-text"], full["LGPL-2.0-text"], "This work is licensed under the GNU General Public License (version 3)!",
    ]
    found: dict = {}
    for i, t in scanned(spark, texts):
        found.setdefault(i, set()).add(t)
    assert found[0] == {"MIT"} and "Apache-2.0" in found[1] and found[2] == found[3] == {"GPL-2.0-notice"}
    assert found[4] == {"LGPL-2.1-header"} and found[5] == {"MIT-text"}
    assert "GPL-3.0-text" in found[6] and "GPL-2.0-text" not in found[6]
    assert "LGPL-2.1-text" in found[7] and "LGPL-2.0-text" not in found[7]
    assert "LGPL-2.0-text" in found[8] and "LGPL-2.1-text" not in found[8]
    assert found[9] == {"GPL-3.0", "GPL-3.0-notice"}


def test_templates_shorter_than_a_shingle(spark):
    short = [("one", "MIT"), ("three", "All Rights reserved."), ("none", " ...")]
    texts = ["mit", "all rights reserved", "x (MIT) y, ALL rights RESERVED, mit", "all rights are reserved", "", None]
    assert scanned(spark, texts, short) == {(0, "one"): 1.0, (1, "three"): 1.0, (2, "one"): 1.0, (2, "three"): 1.0}
    assert scanned(spark, texts, [*short, ("five", "x mit y all rights")]) == {(0, "one"): 1.0, (1, "three"): 1.0, (2, "one"): 1.0, (2, "three"): 1.0, (2, "five"): 1.0}
