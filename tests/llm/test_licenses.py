"""Patience alignment of licence notices."""

from __future__ import annotations

from gridloom.llm import licenses


def test_alignment():
    t = licenses.words(licenses.TEMPLATES["gpl-3.0"].encode())
    assert licenses.aligned(licenses.words(b"x y " + licenses.TEMPLATES["gpl-3.0"].encode() + b" z"), t) == len(t)
    assert licenses.aligned([], t) == 0 and licenses.rising([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


def test_scan(spark):
    text = "Some prose.\n" + licenses.TEMPLATES["mit"] + "\nMore prose."
    rows = [(1, text), (2, None), (3, ""), (4, "plain prose"), (4, "All rights reserved.")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    got = sorted((r.row.doc_id, r.license or "") for r in licenses.license_scan(df).collect())
    assert got == [(1, "mit"), (2, ""), (3, ""), (4, ""), (4, "all-rights-reserved")]
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_longest_common_subsequence():
    import random

    draw = random.Random(3)
    for _ in range(300):
        a, b = ([draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = licenses.common(a, b)
        assert len(got) == table[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:], strict=False))


def test_every_place_and_template(spark):
    apache, rights = licenses.TEMPLATES["apache-2.0"], licenses.TEMPLATES["all-rights-reserved"]
    rows = [
        f"A file. {apache} Code of one file. {apache} Code of the next.",  # twice, not at the ends
        "All of the rights that were reserved are all named: rights of way, reserved seats. " * 3 + rights + " They are all rights, reserved or not.",
        "All men have " + "some " * 200 + "rights, and " + "more " * 200 + "reserved them.",  # in order, pages apart
        f"Prose. {apache} Prose. {licenses.TEMPLATES['mit']} Prose.",
        apache.replace("2.0", "1.1"),
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.row.doc_id: sorted(x.license for x in r.licenses) for r in licenses.license_scan(df, templates=licenses.TEMPLATES).collect()}
    assert got == {0: ["apache-2.0"], 1: ["all-rights-reserved"], 2: [], 3: ["apache-2.0", "mit"], 4: []}


def test_usual_wordings(spark):
    """Lines as the tables and other documents have them, none copied from the templates; whole texts with changed holders."""
    from gridloom.llm import license_forms

    lines = {
        "Released under the MIT License.": {"mit"},
        "Licensed under CC BY-NC 4.0.": {"cc-by-nc-4.0"},
        "Text is available under CC-BY-SA-3.0, see below": {"cc-by-sa-3.0"},
        "http://creativecommons.org/licenses/by/4.0/": {"cc-by-4.0"},
        "Shared under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License": {"cc-by-nc-nd-4.0"},
        "SPDX-License-Identifier: Apache-2.0": {"apache-2.0"},
        "You may use it under the GNU Lesser General Public License, version 2.1": {"lgpl-2.1"},
        "GPLv3 or later": {"gpl-3.0"},
        "Distributed under the terms of the GNU GPL v2": {"gpl-2.0"},
        "BSD 3-Clause License": {"bsd-3-clause"},
        "(c) 2020 A. Writer. ALL RIGHTS RESERVED": {"all-rights-reserved"},
        "This work is licensed under the Other Public License, version 3.": set(),
        "Licensed under the Apache License, Version 1.1": set(),
        "Er kam mit dem Rad.": set(),
    }
    texts = [(x, want) for x, want in lines.items()] + [(f"Prose, and {x} More prose.", want) for x, want in lines.items()]
    for name in ("apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "mpl-2.0", "mit", "isc", "bsd-2-clause", "bsd-3-clause"):
        whole = max(license_forms.forms()[name], key=len)
        changed = " ".join(w for i, w in enumerate(whole.split()) if i % 25)
        texts.append((f"Copyright 2021 by somebody.\n{changed}\nEnd of file.", {name}))
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.row.doc_id: r for r in licenses.license_scan(df).collect()}
    for i, (text, want) in enumerate(texts):
        found = [x.license for x in got[i].licenses]
        assert set(found[:1]) == want and (len(text) > 500 or set(found) == want), (text[:90], found)
        assert got[i].license == (found[0] if found else None)
