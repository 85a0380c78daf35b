"""Licence scans: sparse TF-IDF cosines of headers and licence files to templates, then inheritance by directories.

A file is read in segments: its lines, windows of SEGMENT words over the whole text for notices that run over several
lines, and, for each template, all windows of the template's own number of words, so that a notice is found wherever it
stands. Segments and TEMPLATES are sparse vectors of words weighted by counts and inverse document frequencies, which
are counted over all files and for all words. The best segment's template is the file's own licence if its cosine is at
least LEAST; that rights are reserved counts only without a licence.

The driver and the workers know the frequencies of the templates' words only, which give a segment's products with the
templates and its own words' part of its norm. Every other word weighs 1 at least, and as one that no file holds at
most, so a segment's cosine has bounds, and only segments that could be a file's best one leave the worker; the weights
of their other words are joined. A file is read for segments only if its words could reach LEAST with some template: a
segment's cosine is at most the norm of the template's weights on the file's words, over the norm of all its weights.

A licence file (by name, or because its notice makes up WHOLE of its words) speaks for its directory and all below it.
Distinct directories are joined with their ancestors' licences, the nearest ancestor wins, and files without a licence
of their own take their directory's. Of several licence files in a directory the greatest score wins, then the name.

Directories with a licence above them are broadcast while they are at most DIRECTORIES; beyond that, files are joined
with them by directory, and adaptive execution splits those that hold many files.

Null and empty texts have no licence of their own. A null path inherits nothing. Rows that repeat are scored alike.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from loomgraph.llm.common import Scratch, prepare

LEAST, SEGMENT, WHOLE = 0.6, 64, 0.5
#: Cosines are compared at DIGITS digits; words that a worker counts before it passes them on.
DIGITS, CLOSE, COUNTED = 9, 1e-8, 200_000
#: Rows of the directories' table up to which it is broadcast (some hundred bytes each).
DIRECTORIES = 50_000
#: Names of licence files, without regard to case.
FILE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense|copyright)([.-].*)?$"

#: Rights are reserved in notices of licences too, so this one is a file's own only if no other reaches LEAST.
RESERVED = "Proprietary"

#: Short notices of common licences, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or any later version."),
    ("LGPL-2.1", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, public domain dedication."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    (RESERVED, "All rights reserved."),
    (RESERVED, "All rights reserved. No part of this work may be reproduced without permission."),
)
GRANTS = np.array([name != RESERVED for name, _ in TEMPLATES])
_PUNCTUATION = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"})


def words(text: str) -> list[str]:
    return text.lower().translate(_PUNCTUATION).split()


VOCABULARY = tuple(sorted({w for _, t in TEMPLATES for w in words(t)}))


class Notice(NamedTuple):
    """A segment with its template: its product with the template's unit vector, the square of its template words' norm
    (of any template), its number of words, and its other words with their counts."""

    template: int
    product: float
    square: float
    size: int
    others: tuple[tuple[str, int], ...]


class Scanner:
    """Templates weighted by how many of `files` files hold each word; words that `held` lacks are in no file.

    Notices need the words of VOCABULARY only.
    """

    def __init__(self, held: dict[str, int], files: int, least: float = LEAST):
        self.least, self.held, self.files = least, held, files
        self.idf = {w: self.weight(w) for w in VOCABULARY}
        self.other = math.log(1 + files) + 1
        self.place = {w: i for i, w in enumerate(VOCABULARY)}
        self.known = frozenset(VOCABULARY)
        self.weights = np.zeros((len(TEMPLATES), len(VOCABULARY)))
        self.sizes = [len(words(t)) for _, t in TEMPLATES]
        for k, (_, t) in enumerate(TEMPLATES):
            for w, n in Counter(words(t)).items():
                self.weights[k, self.place[w]] = n * self.idf[w]
        self.weights /= np.linalg.norm(self.weights, axis=1, keepdims=True)
        # By place, with an entry more for all other words: products with the templates, and squares.
        idf = np.array([self.idf[w] for w in VOCABULARY])
        self.products = np.hstack([self.weights * idf, np.zeros((len(TEMPLATES), 1))])
        self.squares = np.append(idf * idf, 1.0)

    def weight(self, word: str) -> float:
        return math.log((1 + self.files) / (1 + self.held.get(word, 0))) + 1

    def _vector(self, segment: Sequence[str]) -> tuple[np.ndarray, float, tuple[tuple[str, int], ...]]:
        v, square, others = np.zeros(len(VOCABULARY)), 0.0, []
        for w, n in Counter(segment).items():
            if w in self.place:
                v[self.place[w]] = n * self.idf[w]
                square += v[self.place[w]] ** 2
            else:
                others.append((w, n))
        return v, square, tuple(sorted(others))

    def cosines(self, segment: Sequence[str]) -> np.ndarray:
        """Of a segment with each template."""
        v, square, others = self._vector(segment)
        square += sum((n * self.weight(w)) ** 2 for w, n in others)
        return self.weights @ v / math.sqrt(square) if square else np.zeros(len(TEMPLATES))

    def bounds(self, present: Sequence[str]) -> np.ndarray:
        """What a segment of these words can reach with each template."""
        return np.sqrt(np.square(self.weights[:, [self.place[w] for w in present]]).sum(1))

    def reachable(self, present: Sequence[str]) -> bool:
        return bool((self.bounds(present) >= self.least).any())

    def notices(self, text: str | None) -> tuple[list[Notice], int]:
        """Those segments that could be the text's best, whatever its other words weigh, and its number of words."""
        if not text:
            return [], 0
        every = words(text)
        present = self.known.intersection(every)
        bounds = self.bounds(sorted(present))
        if not present or not (bounds >= self.least).any():
            return [], len(every)
        kept: dict[Notice, float] = {}  # with the most that the cosine can be
        sure = {True: self.least, False: self.least}  # the least that the best cosine is, with and without a licence

        def add(segment: Sequence[str], templates: Sequence[int] | None = None) -> None:
            v, square, others = self._vector(segment)
            products = self.weights @ v
            if templates is None:
                templates = (int(np.where(GRANTS, products, -1.0).argmax()), int(np.where(GRANTS, -1.0, products).argmax()))
            light = math.sqrt(square + sum(n * n for _, n in others)) or 1.0
            heavy = math.sqrt(square + sum((n * self.other) ** 2 for _, n in others)) or 1.0
            for k in templates:
                if products[k] / light >= sure[bool(GRANTS[k])] - CLOSE:
                    kept[Notice(k, float(products[k]), square, len(segment), others)] = products[k] / light
                    sure[bool(GRANTS[k])] = max(sure[bool(GRANTS[k])], products[k] / heavy)

        segments = [w for w in map(words, text.split("\n")) if w and not self.known.isdisjoint(w)]
        segments += [every[i : i + SEGMENT] for i in range(0, max(1, len(every) - SEGMENT // 2), SEGMENT // 2)]
        for segment in segments:
            if self.reachable(sorted(self.known.intersection(segment))):
                add(segment)
        at = np.array([self.place.get(w, len(VOCABULARY)) for w in every])
        # Counts are no larger than their squares, so these norms are none too large.
        norms = np.append(0.0, np.cumsum(self.squares[at]))
        for k in np.flatnonzero(bounds >= self.least):
            size, grants = self.sizes[k], bool(GRANTS[k])
            if size > len(every):
                continue
            along = np.append(0.0, np.cumsum(self.products[k, at]))
            most = (along[size:] - along[:-size]) / np.sqrt(norms[size:] - norms[:-size])
            maybe = np.flatnonzero(most >= sure[grants] - CLOSE)
            for i in maybe[np.argsort(-most[maybe], kind="stable")]:
                if most[i] < sure[grants] - CLOSE:
                    break
                add(every[i : i + size], (int(k),))
        found = [x for x, most in kept.items() if most >= sure[bool(GRANTS[x.template])] - CLOSE]
        if any(GRANTS[x.template] and not x.others and x.product / math.sqrt(x.square) >= self.least for x in found):
            found = [x for x in found if GRANTS[x.template]]
        return found, len(every)

    def scan(self, text: str | None) -> tuple[str | None, float, float]:
        """(licence, cosine, the notice's share of the text's words); (None, 0, 0) below the least cosine."""
        found, size = self.notices(text)
        scored = []
        for x in found:
            c = x.product / math.sqrt(x.square + sum((n * self.weight(w)) ** 2 for w, n in x.others))
            if c >= self.least:
                scored.append((bool(GRANTS[x.template]), round(c, DIGITS), TEMPLATES[x.template][0], x.size))
        if not scored:
            return None, 0.0, 0.0
        _, best, name, of = max(scored)
        return name, min(best, 1.0), min(1.0, of / size)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with the number of texts that hold them, summed up as far as COUNTED words fit."""
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "held"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                held.update(set(words(text)))
        if len(held) >= COUNTED:
            yield out()
            held.clear()
    yield out()


_OTHER = StructType([StructField("word", StringType()), StructField("n", LongType())])
_NOTICE = StructType([StructField("licence", StringType()), StructField("grants", BooleanType()), StructField("product", DoubleType()), StructField("square", DoubleType()), StructField("size", LongType()), StructField("others", ArrayType(_OTHER))])
_ARROW = pa.list_(pa.struct([("licence", pa.string()), ("grants", pa.bool_()), ("product", pa.float64()), ("square", pa.float64()), ("size", pa.int64()), ("others", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))]))


def _notices(scanner: Scanner):
    def notices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanner.notices(t) for t in batch.column(2).to_pylist()]
            rows = [[{"licence": TEMPLATES[x.template][0], "grants": bool(GRANTS[x.template]), "product": x.product, "square": x.square, "size": x.size, "others": [{"word": w, "n": n} for w, n in x.others]} for x in xs] for xs, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for _, n in found], pa.int64()), pa.array(rows, _ARROW)], ["id", "path", "words", "notices"])

    return notices


def frequencies(files: DataFrame, text_col: str = "text") -> DataFrame:
    """[word, held]: how many files hold each word."""
    return files.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counts, "word string, held long").groupBy("word").agg(F.sum("held").alias("held"))


def best_notices(found: DataFrame, held: DataFrame, files: int) -> DataFrame:
    """[key, licence, score, size] of the best notice of each key of found (key, notices) that has one of LEAST or more."""
    spread = found.where(F.size("notices") > 0).select("key", F.posexplode("notices").alias("at", "notice"))
    weight = F.log(F.lit(1.0 + files) / (1 + F.coalesce("held", F.lit(0)))) + 1
    others = spread.select("key", "at", F.explode("notice.others").alias("other")).select("key", "at", F.col("other.word").alias("word"), F.col("other.n").alias("n"))
    rest = others.join(held, "word", "left").groupBy("key", "at").agg(F.sum(F.pow(F.col("n") * weight, F.lit(2.0))).alias("rest"))
    score = F.col("notice.product") / F.sqrt(F.col("notice.square") + F.coalesce("rest", F.lit(0.0)))
    scored = spread.join(rest, ["key", "at"], "left").withColumn("score", score).where(F.col("score") >= LEAST)
    best = scored.groupBy("key").agg(F.max(F.struct("notice.grants", F.round("score", DIGITS).alias("score"), "notice.licence", "notice.size")).alias("b"))
    return best.select("key", "b.licence", F.least("b.score", F.lit(1.0)).alias("score"), "b.size")


def _directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def inherit(found: DataFrame, scratch: Scratch) -> DataFrame:
    """found (path, licence, score, speaks) with the licence of each path's nearest ancestor directory: dir_licence, licence_dir."""
    placed = found.withColumn("dir", _directory(F.col("path")))
    speaking = placed.where("speaks and licence is not null and path is not null")
    spoken = speaking.groupBy("dir").agg(F.max(F.struct("score", "licence")).alias("best")).select(F.col("dir").alias("above"), F.col("best.licence").alias("dir_licence"))
    dirs = placed.where("path is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/")))
    ancestors = dirs.select("dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = ancestors.join(spoken, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "dir_licence")).alias("near")).select("dir", F.col("near.dir_licence").alias("dir_licence"), F.col("near.above").alias("licence_dir"))
    nearest = scratch.save(nearest, "nearest")
    return placed.join(F.broadcast(nearest) if nearest.count() <= DIRECTORIES else nearest, "dir", "left").drop("dir")


def scan_licences(files: DataFrame, id_col: str, path: Column, text_col: str = "text", whole: float = WHOLE) -> DataFrame:
    """[id_col, path, licence, how (own, inherited, none), score, licence_dir]: one row per row of files."""
    spark = files.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "licences")
    held = scratch.save(frequencies(files, text_col), "held")
    n = files.count()
    scanner = Scanner({r["word"]: r["held"] for r in held.where(F.col("word").isin(*VOCABULARY)).collect()}, n)
    texts = files.select(F.col(id_col).alias("id"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([texts.schema["id"], texts.schema["path"], StructField("words", LongType()), StructField("notices", ArrayType(_NOTICE))])
    read = scratch.save(texts.mapInArrow(_notices(scanner), schema).withColumn("key", F.monotonically_increasing_id()), "notices")
    found = read.select("key", "id", "path", "words").join(best_notices(read, held, n), "key", "left")
    found = found.select("id", "path", "licence", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce(F.least(F.lit(1.0), F.col("size") / F.col("words")), F.lit(0.0)).alias("share"))
    by_name = F.regexp_extract("path", "([^/]*)$", 1).rlike(FILE_NAMES)
    found = scratch.save(found.withColumn("speaks", F.coalesce(by_name | (F.col("share") >= whole), F.lit(False))), "found")
    out = inherit(found, scratch)
    how = F.when(F.col("licence").isNotNull(), "own").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none")
    return out.select(F.col("id").alias(id_col), "path", F.coalesce("licence", "dir_licence").alias("licence"), how.alias("how"), "score", F.when(how == "inherited", F.col("licence_dir")).alias("licence_dir"))
