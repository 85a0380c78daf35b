"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by size: class c holds items of up to 2 * 2**c shingles. A long document is no candidate
as a whole, as its similarity with a short item is next to nothing; so for each class it is read in windows of twice the
class's size that advance by half of it. A passage of an item of the class then lies in some window, of which it makes
up at least a quarter: with a containment of 0.8 the similarity is 0.19 at least in every class, whatever the document's length.
One minimum of HASHES is enough for a candidate; all of them miss with a probability of (1 - 0.19)**HASHES = 4e-5 at
worst, and of 1e-6 for a whole passage. Blocks' minima are computed once and combined for the windows of all classes.
The bound holds for shingles that stand within a window, and for items that don't repeat a shingle: an item's minima see
distinct shingles only. Shingles scattered over more than a window are found less surely.

Items that repeat a shingle are not sought by minima. Of their distinct shingles so many are looked up in every document
that one that holds LEAST of them holds one of these: none of those documents is missed, wherever the shingles stand.

A candidate is verified by exact containment: the share of the item's distinct shingles that the whole document holds.
Words are runs of letters and digits, lower-cased for A-Z; items of fewer words than WIDTH are one shingle of their own
width, looked for as such.

Items are the query set. Up to ITEMS of them (about 40 MB) are broadcast and nothing is shuffled. More go in blocks of
about ITEMS: the documents are written with a number, each block's hits are written by a job of their own, after which
the block leaves the driver and the workers, and the hits are joined by number in the end.

Null and empty texts, and items without words, contaminate nothing. Items with equal ids are separate items, and items
without an id are sought like others; they are nulls among a document's items. Rows of documents that repeat are
searched one by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, column, encoded, folding, from_row, held_in_worker, mixed, prepare, whole_row, windows, word_hashes

WIDTH, LEAST, HASHES, BASE = 5, 0.8, 48, 2
ITEMS = 20_000
#: Words are what lies between these bytes: all of ASCII but letters and digits.
APART = bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, HASHES + 1, dtype=np.uint64)
    return mixed(seeds * np.uint64(2) + np.uint64(1 << 33)) | np.uint64(1), mixed(seeds * np.uint64(2) + np.uint64(1 + (1 << 33)))


class Index:
    """Minima of a block of items, by size class and hash function."""

    def __init__(self, items: Sequence[tuple[int, str | None]]):
        self.fold, self.apart = folding(separators=APART)
        self.a, self.b = _functions()
        self.ids = [i for i, _ in items]
        hashes, at = word_hashes(encoded([t for _, t in items]), self.fold, self.apart)
        self.sets: list[np.ndarray] = []
        self.short: dict[int, dict[int, list[int]]] = {}
        classes: dict[int, list[int]] = {}
        repeating: list[int] = []
        for k in range(len(items)):
            own = hashes[at[k] : at[k + 1]]
            width = min(WIDTH, len(own))
            grams = windows(own, width) if width else own
            self.sets.append(np.unique(grams))
            if 0 < width < WIDTH:
                self.short.setdefault(width, {}).setdefault(int(grams[0]), []).append(k)
            elif width and len(self.sets[k]) < len(grams):
                repeating.append(k)
            elif width:
                c = max(0, int(np.ceil(np.log2(len(grams) / BASE))))
                classes.setdefault(c, []).append(k)
        # Of each class a sorted table of keys with their items, and a bit map of the keys' first bits.
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]] = {}
        for c, members in classes.items():
            minima = np.stack([(self.sets[k] * self.a[:, None] + self.b[:, None]).min(1) for k in members], 1)
            keys = self._keys(minima, np.arange(HASHES)[:, None]).T.ravel()
            order = np.argsort(keys, kind="stable")
            self.classes[c] = keys[order], np.repeat(members, HASHES)[order], *self._bitmap(keys)
        # Without these, a repeating item's shingles are fewer than LEAST of all.
        enough = [self.sets[k][: len(self.sets[k]) - int(np.ceil(LEAST * len(self.sets[k]) - 1e-9)) + 1] for k in repeating]
        self.repeating: tuple[np.ndarray, np.ndarray, np.ndarray, int] | None = None
        if enough:
            keys = np.concatenate(enough)
            order = np.argsort(keys, kind="stable")
            self.repeating = keys[order], np.repeat(repeating, [len(e) for e in enough])[order], *self._bitmap(keys)

    @staticmethod
    def _bitmap(keys: np.ndarray) -> tuple[np.ndarray, int]:
        """Which first bits the keys have, and the shift to them."""
        bits = max(16, int(16 * len(keys)).bit_length())
        bitmap = np.zeros(1 << bits, bool)
        bitmap[keys >> np.uint64(64 - bits)] = True
        return bitmap, 64 - bits

    @staticmethod
    def _keys(minima: np.ndarray, function: np.ndarray) -> np.ndarray:
        """Spread minima, so that those of different functions differ."""
        out = (minima ^ (function.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
        return (out ^ (out >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)

    def candidates(self, grams: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, item) pairs for the documents' shingles, `parts` being where each document starts."""
        if not self.classes or not len(grams):
            return
        lowest = min(self.classes)
        step = (BASE << lowest) // 2
        counts = -(-np.diff(parts) // step)
        owner = np.repeat(np.arange(len(counts)), counts)
        starts = parts[owner] + (np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]) * step
        blocks = np.empty((HASHES, len(starts)), np.uint64)
        hashed = np.empty_like(grams)
        for k in range(HASHES):
            np.multiply(grams, self.a[k], out=hashed)
            np.add(hashed, self.b[k], out=hashed)
            np.minimum.reduceat(hashed, starts, out=blocks[k])
        for c in range(lowest, max(self.classes) + 1):
            here = np.arange(len(owner))
            if c > lowest:  # blocks of twice the length, from every second block of a document
                first = np.flatnonzero((here - np.searchsorted(owner, owner)) % 2 == 0)
                pair = np.minimum(first + 1, len(owner) - 1)
                pair = np.where(owner[pair] == owner[first], pair, first)
                blocks, owner = np.minimum(blocks[:, first], blocks[:, pair]), owner[first]
                here = np.arange(len(owner))
            if c not in self.classes:
                continue
            keys, items, bitmap, shift = self.classes[c]
            window = blocks.copy()
            for ahead in range(1, 4):
                other = np.minimum(here + ahead, len(owner) - 1)
                np.minimum(window, blocks[:, np.where(owner[other] == owner, other, here)], out=window)
            for k in range(HASHES):
                got = self._keys(window[k], np.array([k]))
                maybe = np.flatnonzero(bitmap[got >> np.uint64(shift)])
                low, high = np.searchsorted(keys, got[maybe]), np.searchsorted(keys, got[maybe], side="right")
                for w, x, y in zip(maybe, low, high):
                    for i in items[x:y]:
                        yield int(owner[w]), int(i)

    def search(self, texts: Sequence[str | None]) -> list[dict[int, float]]:
        """For each text its items (by place in the block) with a containment of LEAST or more."""
        found: list[dict[int, float]] = [{} for _ in texts]
        raw = encoded(texts)
        at = 0
        while at < len(raw):  # some hundred kilobytes at a time, so that the minima stay small
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end] or b"") <= 1 << 19):
                size += len(raw[end] or b"")
                end += 1
            hashes, starts = word_hashes(raw[at:end], self.fold, self.apart)
            own = [hashes[starts[d] : starts[d + 1]] for d in range(end - at)]
            grams = [windows(h, WIDTH) if len(h) >= WIDTH else h[:0] for h in own]
            # A very long document goes through in pieces that overlap by a window of the largest class.
            for d, k in sorted(set(self._all_candidates(grams))):
                if k not in found[at + d]:
                    share = len(np.intersect1d(self.sets[k], grams[d])) / len(self.sets[k])
                    if share >= LEAST:
                        found[at + d][k] = share
            for width, items in self.short.items():
                wanted = np.array(sorted(items), np.uint64)
                for d, h in enumerate(own):
                    if len(h) >= width:
                        for gram in np.intersect1d(windows(h, width), wanted):
                            found[at + d].update(dict.fromkeys(items[int(gram)], 1.0))
            at = end
        return found

    def _holders(self, grams: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """(document, item) pairs for those repeating items of which a document holds a shingle that is looked up."""
        if self.repeating is None:
            return
        keys, items, bitmap, shift = self.repeating
        for d, own in enumerate(grams):
            maybe = np.unique(own[bitmap[own >> np.uint64(shift)]])
            low, high = np.searchsorted(keys, maybe), np.searchsorted(keys, maybe, side="right")
            for x, y in zip(low, high):
                for i in items[x:y]:
                    yield d, int(i)

    def _all_candidates(self, grams: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        yield from self._holders(grams)
        overlap = BASE * 2 ** (max(self.classes, default=0) + 2)
        piece = max(1 << 17, 4 * overlap)
        small = [d for d, g in enumerate(grams) if 0 < len(g) <= piece]
        if small:
            parts = np.cumsum([0] + [len(grams[d]) for d in small])
            for d, k in self.candidates(np.concatenate([grams[d] for d in small]), parts):
                yield small[d], k
        for d, g in enumerate(grams):
            if len(g) > piece:
                for start in range(0, len(g), piece - overlap):
                    part = g[start : start + piece]
                    for _, k in self.candidates(part, np.array([0, len(part)])):
                        yield d, k


def _searcher(shared):
    key = uuid.uuid4().hex

    @F.pandas_udf("items array<long>, shares array<double>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = held_in_worker(key, lambda: Index(shared.value))
        for texts in batches:
            got = index.search([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"items": pd.Series([[index.ids[k] for k in sorted(g)] for g in got], dtype=object), "shares": pd.Series([[g[k] for k in sorted(g)] for g in got], dtype=object)})

    return search


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", each: int | None = None) -> list[DataFrame]:
    """The items (item, text) in blocks of bounded size."""
    items = benchmark.select(column(item_col).cast("long").alias("item"), column(text_col).cast("string").alias("text")).where("text is not null")
    blocks = -(-items.count() // (each or ITEMS))
    # Blocks by a hash hold ITEMS rows on average; a copied item counts as often as it is there.
    return [items] * blocks if blocks < 2 else [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) for k in range(blocks)]


def _collected(items: DataFrame) -> list[tuple[int | None, str]]:
    return [(r["item"], r["text"]) for r in items.orderBy("item", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """[row, items, shares]: each row of docs as a struct, with the test items that its text holds."""
    spark = docs.sparkSession
    prepare(spark)
    blocks = item_blocks(benchmark, item_col)
    none = [F.array().cast(f"array<{kind}>").alias(name) for name, kind in (("items", "long"), ("shares", "double"))]
    if not blocks:
        return docs.select(whole_row(docs).alias("row"), *none)
    if len(blocks) == 1:
        search = _searcher(spark.sparkContext.broadcast(_collected(blocks[0])))
        return docs.select(whole_row(docs).alias("row"), search(column(text_col).cast("string")).alias("leaks")).select("row", "leaks.*")
    scratch = Scratch(spark, "leaks")
    numbered = scratch.save(docs.select(F.monotonically_increasing_id().alias("number"), whole_row(docs).alias("row")), "numbered")
    for items in blocks:
        shared = spark.sparkContext.broadcast(_collected(items))
        hits = numbered.select("number", _searcher(shared)(F.col("row").getField(text_col).cast("string")).alias("leaks"))
        hits.select("number", "leaks.*").where(F.size("items") > 0).write.mode("append").parquet(f"{scratch.path}/hits")
        shared.destroy()
    hits = spark.read.schema("number long, items array<long>, shares array<double>").parquet(f"{scratch.path}/hits")
    every = hits.groupBy("number").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("items", "shares")])
    return numbered.join(every, "number", "left").select("row", *[F.coalesce(c, empty) for c, empty in zip(("items", "shares"), none)]).toDF("row", "items", "shares")


def decontamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """[id_col, contaminated, n_items, item_ids, top_share]: one row per row of docs."""
    found = contaminated(docs.select(column(id_col).alias("id"), column(text_col).alias("text")), benchmark)
    return found.select(F.col("row.id").alias(id_col), (F.size("items") > 0).alias("contaminated"), F.size("items").alias("n_items"), F.array_sort("items").alias("item_ids"), F.coalesce(F.array_max("shares"), F.lit(0.0)).alias("top_share"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose texts hold no test item, with their columns."""
    return contaminated(docs, benchmark, text_col).where(F.size("items") == 0).select(*from_row("row", docs.columns))
