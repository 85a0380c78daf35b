import math
import random
from collections import Counter

from pyspark.sql import functions as F

from loomgraph.llm import licences as li
from loomgraph.llm.common import Scratch


def plain_cosine(segment, template, held, files):
    weigh = lambda ws: {w: n * ((math.log((1 + files) / (1 + held.get(w, 0))) if w in li.VOCABULARY else math.log(1 + files)) + 1) for w, n in Counter(ws).items()}
    a, b = weigh(segment), weigh(li.words(template))
    return sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(x * x for x in a.values())) / math.sqrt(sum(x * x for x in b.values()))


def test_cosines_and_scan():
    held, files = {"the": 90, "and": 80, "of": 70, "license": 5}, 100
    scanner = li.Scanner(held, files)
    for text in ("Licensed under the Apache License", "the and of or", "MIT License granted unknown words here", "Licensed under CC BY-NC 4.0."):
        got = scanner.cosines(li.words(text))
        assert all(abs(g - plain_cosine(li.words(text), t, held, files)) < 1e-9 for g, (_, t) in zip(got, li.TEMPLATES))
    for name, template in li.TEMPLATES:
        around = "the house and the water of the land\n" * 50
        licence, score, share = scanner.scan(around + template + "\n" + around)
        assert licence == name and score > 0.99 and share < 0.5
    assert scanner.scan("the and of " * 1000) == (None, 0.0, 0.0) == scanner.scan(None) == scanner.scan("")


def test_skipped_texts_could_not_have_reached():
    scanner = li.Scanner({"the": 50}, 60)
    for text in ("license of the house", "warranty and permission to use", "public domain of the software", "reserved parts"):
        w = li.words(text)
        if not scanner.reachable(sorted(set(w) & set(li.VOCABULARY))):
            assert scanner.cosines(w).max() < li.LEAST


def test_a_notice_over_several_lines():
    scanner = li.Scanner({}, 10)
    text = "intro words\n" + li.TEMPLATES[1][1].replace(" ", "\n") + "\ncode follows here"
    assert scanner.scan(text)[0] == "Apache-2.0"


def test_short_forms_and_headers(spark):
    """Lines of the given documents, and headers as programmes have them, which differ from the templates."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    held = Counter(w for t in texts for w in set(li.words(t or "")))
    scanner = li.Scanner(held, len(texts))
    reserved = [t for t in texts if "All rights reserved." in (t or "").split("\n")]
    assert len(reserved) == 7 and {scanner.scan(t)[0] for t in reserved} == {"Proprietary"}
    header = "# This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    for what, licence, version, name in (
        ("program", "General Public License", "2", "GPL-2.0"), ("program", "General Public License", "3", "GPL-3.0"), ("library", "Lesser General Public License", "2.1", "LGPL-2.1"),
        ("program", "Lesser General Public License", "3", "LGPL-3.0"), ("program", "Affero General Public License", "3", "AGPL-3.0"),
    ):
        assert scanner.scan(header.format(what, licence, version))[0] == name
    assert scanner.scan("All rights reserved.\n" + li.TEMPLATES[2][1])[0] == "MIT"


NOTICES = (
    ("Apache-2.0", "Code samples by Ana Ruiz, licensed under the Apache License, Version 2.0."),
    ("MIT", "Copyright (c) 2021 Jane Doe. Released under the MIT License."),
    ("MIT", "// This file is released under the MIT License, see the LICENSE file."),
    ("Proprietary", "Copyright 2020 Example Inc. All rights reserved."),
    ("MIT", "Copyright 2020 Example Inc. All rights reserved. Released under the MIT License."),
)


def test_a_notice_inside_a_paragraph():
    for files in (1_000, 10_000, 10_000_000):
        scanner = li.Scanner({"the": files // 2, "of": files // 2, "by": files // 3, "this": files // 3, "all": files // 4}, files)
        for name, notice in NOTICES:
            for text in (notice, "the house and the water of the land " * 40 + notice + " the sea and a hill by this lake" * 40):
                licence, score, _ = scanner.scan(text)
                assert (licence, round(score, 9)) == (name, 1.0)


def test_all_words_weigh_by_their_files(spark):
    """The distributed scan is that of a scanner that knows all words; notices are altered, so that other words count."""
    altered = [
        "released under the rather mit license", "code licensed under that apache license version 2 0 rare1", "nothing rare2 here", None, "", "all known rights reserved", "licensed under some cc by nc 4 0 terms",
        "all rights rare3 reserved and released with the mit license", "reserved rare4 rights",
    ]
    texts = altered + ["rather that some known terms and water"] * 60 + ["the water and the land"] * 30
    held = Counter(w for t in texts for w in set(li.words(t or "")))
    assert {r.word: r.held for r in li.frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)).collect()} == held
    scanner, blind = li.Scanner(held, len(texts)), li.Scanner({w: n for w, n in held.items() if w in li.VOCABULARY}, len(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: r for r in li.scan_licences(df, "i", F.lit(None)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        licence, score, _ = scanner.scan(t)
        assert got[i].licence == licence and abs(got[i].score - score) < 1e-8
    assert sum(scanner.scan(t) != blind.scan(t) for t in altered) >= 3
    # The segments that leave a worker hold the best of all segments.
    for t in filter(None, altered):
        w = li.words(t)
        every = [(k, w[i : i + n]) for k, n in enumerate(scanner.sizes) for i in range(len(w) - n + 1)] + [(k, w) for k in range(len(li.TEMPLATES))]
        best = {g: max((scanner.cosines(s)[k] for k, s in every if li.GRANTS[k] == g), default=0.0) for g in (True, False)}
        want = best[True] if best[True] >= li.LEAST else best[False]
        assert abs(scanner.scan(t)[1] - (want if want >= li.LEAST else 0.0)) < 1e-8


def test_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "LICENSE", mit), (2, "a/x.py", "code " * 40), (3, "a/b/COPYING.txt", gpl), (4, "a/b/c/d/y.py", "code " * 40), (5, "a/b/own.py", "code " * 40 + "\n" + mit),
        (6, "ab/z.py", None), (7, None, "code"), (8, "solo", ""), (9, "q/notice.md", gpl), (10, "q/r.py", "more " * 30), (10, "q/r.py", "more " * 30),
    ]
    df = spark.createDataFrame(rows, "i long, path string, text string").selectExpr("*", "1 as licence", "2 as dir", "3 as speaks")
    got = {(r.i, r.licence, r.how, r.licence_dir) for r in li.scan_licences(df, "i", F.col("path")).collect()}
    assert got == {
        (1, "MIT", "own", None), (2, "MIT", "inherited", ""), (3, "GPL-3.0", "own", None), (4, "GPL-3.0", "inherited", "a/b"), (5, "MIT", "own", None),
        (6, "MIT", "inherited", ""), (7, None, "none", None), (8, "MIT", "inherited", ""), (9, "GPL-3.0", "own", None), (10, "GPL-3.0", "inherited", "q"),
    }
    assert li.scan_licences(df.limit(0), "i", F.col("path")).collect() == []


def test_inheritance_equals_a_walk_up_the_directories(spark):
    r = random.Random(4)
    rows = []
    for k in range(400):
        path = "/".join([*(r.choice("abc") for _ in range(r.randrange(5))), f"f{k}"])
        speaks = r.random() < 0.1
        rows.append((path if k % 50 else None, r.choice(["MIT", "ISC", None]), round(r.random(), 3), speaks))
    got = {(g.path, g.licence, g.score): (g.dir_licence, g.licence_dir) for g in li.inherit(spark.createDataFrame(rows, "path string, licence string, score double, speaks boolean"), Scratch(spark, "test")).collect()}
    said = {}
    for path, licence, score, speaks in rows:
        if path and speaks and licence:
            home = path.rpartition("/")[0]
            said[home] = max(said.get(home, (0.0, "")), (score, licence))
    for path, licence, score, _ in rows:
        want = (None, None)
        if path:
            at = path.rpartition("/")[0]
            while at not in said and at:
                at = at.rpartition("/")[0]
            want = (said[at][1], at) if at in said else want
        assert got[path, licence, score] == want


def test_many_directories_are_joined_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(li, "DIRECTORIES", 0)
    rows = [(f"d{k % 9}/f{k}", "MIT" if k < 9 else None, 1.0, k < 9) for k in range(300)]
    got = li.inherit(spark.createDataFrame(rows, "path string, licence string, score double, speaks boolean"), Scratch(spark, "test")).collect()
    assert len(got) == 300 and all(g.dir_licence == "MIT" and g.licence_dir == g.path.split("/")[0] for g in got)
