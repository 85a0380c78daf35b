"""MinHash near-duplicate detection: universal hash minima, banding, signature verification, star components.

Copies are folded first: texts with equal shingle sets form a class, and only the class's least node goes on. Signatures
are cut into bands. Buckets of at most SMALL members compare all of them. In a larger bucket one pivot, the member that
shares most buckets with others, is compared with all other members, so that n members make n - 1 comparisons. A
comparison first estimates the similarity from the signatures, then confirms on the full shingle sets.

What a pivot leaves open are pairs of its group's members in different components. In a group with at most OUTSIDE
members outside the pivot's component, these are compared with all members: two sets differ in the elements in which
their differences from the pivot (what they add, what they lack) differ, so those tell exactly whether they link. Members
of other groups get new bands of twice as many new minima, as many as miss a linked pair no more often than the first
ones: what puts unlinked texts into one bucket, such as a passage that all have, seldom does so again, and buckets, pivots
and groups follow as before. What is open after LEVELS of them is compared with all members, however many are outside.

With 40 bands of 5 minima a pair of similarity 0.8 shares no band with a probability of (1 - 0.8**5)**40 = 1.3e-7, and
none of the new ones with less than 1.3e-7 too. The estimate from 200 minima has a standard error of 0.028 there; it drops
a pair below 0.8 - 0.15, five errors away.

Null and empty texts, and texts of spaces only, have the empty set: they link with nothing. Rows that repeat an id are
one document that has all their texts: it links with whatever one of them links with, and its set size is that of the
largest. Rows without an id are documents of their own; a component's smallest id is that of those that have one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import stars
from loomgraph.llm.common import Scratch, blocks_for, column, encoded, folding, from_row, mixed, prepare, shingle_sets, whole_row

#: How far below the threshold a signature's estimate may lie before the sets are compared.
MARGIN = 0.15
#: Members of a bucket up to which all pairs are compared; members outside a pivot's component up to which they are
#: compared with the whole group (new bands cost a member what some 10,000 comparisons by differences cost, most of which
#: end with the sizes); how often bands are made anew.
SMALL, OUTSIDE, LEVELS = 16, 4_000, 2
#: Members of a group that one task compares with those outside.
DEALT = 2_000
#: Documents to a file of the tables between the steps.
EACH = 5_000


def _functions(n: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """n universal hash functions x -> a * x + b modulo 2**64, of which the high bits count; a is odd."""
    seeds = np.arange(first + 1, first + n + 1, dtype=np.uint64)
    return mixed(seeds * np.uint64(2)) | np.uint64(1), mixed(seeds * np.uint64(2) + np.uint64(1))


def minima(sets: list[np.ndarray], n: int, first: int = 0) -> np.ndarray:
    """A row of n minima for each set, as 32-bit numbers; empty sets get the greatest number."""
    out = np.full((len(sets), n), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    a, b = _functions(n, first)
    at = 0
    while at < len(full):
        end, size = at, 0
        while end < len(full) and (end == at or size + len(sets[full[end]]) <= 1 << 16):
            size += len(sets[full[end]])
            end += 1
        some = full[at:end]
        lines = np.concatenate([sets[i] for i in some])
        starts = np.cumsum([0] + [len(sets[i]) for i in some[:-1]])
        hashed = np.empty_like(lines)
        for k in range(n):
            np.multiply(lines, a[k], out=hashed)
            np.add(hashed, b[k], out=hashed)
            out[some, k] = np.minimum.reduceat(hashed, starts) >> np.uint64(32)
        at = end
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)


def _sketcher(width: int, bands: int, rows: int):
    fold, apart = folding()

    @F.pandas_udf("n long, set_a long, set_b long, bands array<long>")
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            sets = shingle_sets(encoded(batch), width, fold, apart)
            keys = band_keys(minima(sets, bands * rows), bands, rows)
            total = np.array([np.sum(s, dtype=np.uint64) for s in sets], np.uint64)
            other = np.array([np.bitwise_xor.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D))) if len(s) else 0 for s in sets], np.uint64)
            yield pd.DataFrame({"n": [len(s) for s in sets], "set_a": total.view(np.int64), "set_b": other.view(np.int64), "bands": list(keys)})

    return sketch


def _details(width: int, hashes: int):
    fold, apart = folding()

    @F.pandas_udf("sig binary, shingles binary")
    def details(texts: pd.Series) -> pd.DataFrame:
        sets = shingle_sets(encoded(texts), width, fold, apart)
        return pd.DataFrame({"sig": [s.tobytes() for s in minima(sets, hashes)], "shingles": [s.tobytes() for s in sets]})

    return details


def _enough(both, m, n, least: tuple[int, int]):
    """Whether sets of m and n shingles with `both` in common link; for numbers and columns."""
    part, whole = least
    return (whole + part) * both >= part * (m + n)


def _linked(least: tuple[int, int]):
    @F.pandas_udf("boolean")
    def linked(sig_a: pd.Series, set_a: pd.Series, sig_b: pd.Series, set_b: pd.Series) -> pd.Series:
        out = np.zeros(len(sig_a), bool)
        for i, (p, x, q, y) in enumerate(zip(sig_a, set_a, sig_b, set_b)):
            m, n = len(x) // 8, len(y) // 8
            if _enough(min(m, n), m, n, least) and np.mean(np.frombuffer(p, np.uint32) == np.frombuffer(q, np.uint32)) >= least[0] / least[1] - MARGIN:
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                out[i] = _enough(both, m, n, least)
        return pd.Series(out)

    return linked


def bands_for(least: tuple[int, int], rows: int, bands: int, more: int) -> int:
    """How many bands of `more` rows miss a pair at the threshold as seldom as `bands` bands of `rows`."""
    share = least[0] / least[1]
    return bands if share >= 1 else math.ceil(bands * math.log1p(-(share**rows)) / math.log1p(-(share**more)))


def _more_bands(bands: int, rows: int, first: int):
    @F.pandas_udf("array<long>")
    def more(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for shingles in batches:
            keys = []
            for at in range(0, len(shingles), 32):  # so that the minima of many bands stay small
                sets = [np.frombuffer(x, np.uint64) for x in shingles.iloc[at : at + 32]]
                keys += list(band_keys(minima(sets, bands * rows, first), bands, rows))
            yield pd.Series(keys, dtype=object)

    return more


def _differences():
    @F.pandas_udf("n long, total long, diffs array<long>")
    def differences(own: pd.Series, pivot: pd.Series) -> pd.DataFrame:
        """A set's size and its differences from the pivot's."""
        out = []
        for x, p in zip(own, pivot):
            diffs = np.setxor1d(np.frombuffer(x, np.int64), np.frombuffer(p, np.int64), assume_unique=True)
            out.append((len(x) // 8, len(diffs), diffs))
        return pd.DataFrame(out, columns=["n", "total", "diffs"])

    return differences


def _linked_by_differences(least: tuple[int, int]):
    """Whether members (n_a, total_a, diffs_a) and (n_b, ...) of a pivot's group link; what sizes rule out, first."""
    part, whole = least
    sizes, apart = F.col("n_a") + F.col("n_b"), F.col("total_a") + F.col("total_b")
    enough = lambda common: (whole + part) * (sizes - apart + 2 * common) >= 2 * part * sizes
    return enough(F.least("total_a", "total_b")) & enough(F.size(F.array_intersect("diffs_a", "diffs_b")))


class _Finder:
    """Components of nodes (node, n, set_a, set_b, bands) whose texts (node, text) are at hand."""

    def __init__(self, scratch: Scratch, texts: DataFrame, width: int, least: tuple[int, int], bands: int, rows: int):
        self.scratch, self.texts, self.width, self.least, self.bands, self.rows = scratch, texts, width, least, bands, rows

    def classes(self, sketched: DataFrame, nodes: int) -> DataFrame:
        """[n, set_a, set_b, component] of the classes of equal, non-empty sets; a component's name is its least node."""
        scratch, files = self.scratch, blocks_for(nodes, EACH)
        # A hot class is summed up in each task before it is shuffled.
        classes = scratch.save(sketched.where("n > 0").groupBy("n", "set_a", "set_b").agg(F.min("node").alias("rep")), "classes", files)
        placed = sketched.join(classes.select(F.col("rep").alias("node")), "node", "left_semi").select("node", F.explode("bands").alias("bucket"))
        several = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        buckets = scratch.save(placed.join(several, "bucket").select("bucket", "node", F.col("node").alias("c"), "size"), "buckets-0")
        details = self.texts.join(buckets.select("node").distinct(), "node", "left_semi")
        self.details = scratch.save(details.select("node", _details(self.width, self.bands * self.rows)("text").alias("d")).select("node", "d.*"), "details")
        joined = None
        for level in range(LEVELS + 1):
            links, groups = self._links(buckets, level, files)
            joined = self._joined(links, joined, f"bands-{level}", files)
            held, rows, wide = self._open(groups, joined, level)
            if not rows:
                break
            joined = self._joined(self._outside(held, level, files), joined, f"outside-{level}", files)
            if not wide or (buckets := self._more_buckets(held, level + 1)) is None:
                break
        scratch.drop("details")
        where = classes.join(joined, classes.rep == joined.id, "left")
        return where.select("n", "set_a", "set_b", F.coalesce("component", "rep").alias("component"))

    def _joined(self, links: DataFrame, joined: DataFrame | None, name: str, files: int) -> DataFrame:
        """The components [id, component] so far, with the links (a, b)."""
        if joined is not None:
            links = links.union(joined.select(F.col("id").alias("a"), F.col("component").alias("b")))
        return self.scratch.save(stars.components(links, self.scratch, f"stars-{name}"), f"joined-{name}", files)

    def _links(self, buckets: DataFrame, level: int, files: int) -> tuple[DataFrame, DataFrame]:
        """(links (a, b), [pivot, node] of the large buckets)."""
        little = buckets.where(F.col("size") <= SMALL)
        other = little.select("bucket", F.col("node").alias("b"), F.col("c").alias("d"))
        pairs = little.select("bucket", F.col("node").alias("a"), "c").join(other, "bucket").where("a < b and c <> d").select("a", "b")
        large = buckets.where(F.col("size") > SMALL)
        central = large.groupBy("node").agg(F.sum("size").alias("shared"))
        pivots = large.join(central, "node").groupBy("bucket").agg(F.max(F.struct("shared", "node", "c")).alias("p")).select("bucket", F.col("p.node").alias("pivot"), F.col("p.c").alias("d"))
        # Written, so that the join deals both sides anew and can split a bucket that holds a large share of the rows.
        pivots = self.scratch.save(pivots, f"pivots-{level}", files)
        groups = self.scratch.save(large.join(pivots, "bucket").select("pivot", "node", (F.col("c") != F.col("d")).alias("open")).distinct(), f"groups-{level}", files)
        pairs = pairs.union(groups.where("open").select(F.least("node", "pivot"), F.greatest("node", "pivot"))).distinct()
        left = self.details.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("shingles").alias("set_a"))
        right = self.details.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("shingles").alias("set_b"))
        links = pairs.join(left, "a").join(right, "b").where(_linked(self.least)("sig_a", "set_a", "sig_b", "set_b")).select("a", "b")
        return self.scratch.save(links, f"links-{level}", files), groups

    def _open(self, groups: DataFrame, joined: DataFrame, level: int) -> tuple[DataFrame, int, int]:
        """([pivot, node, c, home, members, outside, wide] of groups with members outside the pivot's component, home;
        their number; the number of those in groups that are left to the next level)."""
        homes = joined.select(F.col("id").alias("pivot"), F.col("component").alias("home"))
        held = groups.join(joined, F.col("node") == F.col("id"), "left").select("pivot", "node", F.coalesce("component", "node").alias("c"))
        held = held.join(homes, "pivot", "left").withColumn("home", F.coalesce("home", "pivot"))
        sizes = held.groupBy("pivot").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("c") != F.col("home")).alias("outside")).where("outside > 0")
        wide = (F.col("outside") > OUTSIDE) & F.lit(level < LEVELS)
        return self.scratch.counted(held.join(sizes, "pivot").withColumn("wide", wide), f"held-{level}", wide=F.count_if(F.col("wide")))

    def _outside(self, held: DataFrame, level: int, files: int) -> DataFrame:
        """Links (a, b) of the members outside, in groups that are not left to the next level; a group's members are
        dealt to tasks."""
        own = self.details.select("node", "shingles")
        center = self.details.select(F.col("node").alias("pivot"), F.col("shingles").alias("center"))
        few = held.where("not wide").join(own, "node").join(center, "pivot").select(*held.columns, _differences()("shingles", "center").alias("d"))
        few = self.scratch.save(few.select(*held.columns, "d.*"), f"few-{level}")
        salts = F.ceil(F.col("members") / DEALT).cast("int")
        sides = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "c", "n", "total", "diffs")]
        out = few.where("c <> home").select("pivot", "home", *sides("a"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        every = few.select("pivot", *sides("b"), F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"))
        # Of two members outside, the one with the less node asks.
        once = (F.col("c_a") != F.col("c_b")) & ((F.col("c_b") == F.col("home")) | (F.col("node_a") < F.col("node_b")))
        met = out.join(every, ["pivot", "salt"]).where(once & _linked_by_differences(self.least))
        return self.scratch.save(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), f"found-{level}", files)

    def _more_buckets(self, held: DataFrame, level: int) -> DataFrame | None:
        """Buckets [bucket, node, c, size] of new bands of the members of groups with many outside; components as they were."""
        rows = self.rows << level
        bands = bands_for(self.least, self.rows, self.bands, rows)
        nodes = held.where("wide").select("node", "c").distinct()
        more = _more_bands(bands, rows, (level << 20) + self.bands * self.rows)
        placed = nodes.join(self.details.select("node", "shingles"), "node").select("node", "c", F.explode(more("shingles")).alias("bucket"))
        sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), (F.min("c") != F.max("c")).alias("open")).where("open").drop("open")
        buckets, count = self.scratch.counted(placed.join(sizes, "bucket"), f"buckets-{level}")
        return buckets if count else None


def _sketched(rows: DataFrame, scratch: Scratch, width: int, bands: int, count: int) -> tuple[DataFrame, int]:
    """rows (node, id, text) as [node, id, n, set_a, set_b, bands], and their number."""
    return scratch.counted(rows.select("node", "id", _sketcher(width, bands, count)("text").alias("s")).select("node", "id", "s.*"), "sketched")


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """[node, row]: the rows with numbers, written so that the numbers stay."""
    return scratch.save(docs.select(F.monotonically_increasing_id().alias("node"), whole_row(docs).alias("row")), "numbered")


def _found(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, width: int, least: tuple[int, int], bands: int, rows: int) -> tuple[DataFrame, DataFrame | None]:
    """([node, id, n, component], the numbered rows). Where every row has an id of its own, that is its node and no row is numbered."""
    prepare(docs.sparkSession)
    texts = docs.select(column(id_col).alias("node"), column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    (sketched, count), numbered = _sketched(texts, scratch, width, bands, rows), None
    if not sketched.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        numbered = _numbered(docs, scratch)
        texts = numbered.select("node", F.col("row").getField(id_col).alias("id"), F.col("row").getField(text_col).cast("string").alias("text"))
        sketched, count = _sketched(texts, scratch, width, bands, rows)
    where = _Finder(scratch, texts.select("node", "text"), width, least, bands, rows).classes(sketched, count)
    nodes = sketched.select("node", "id", "n", "set_a", "set_b").join(where, ["n", "set_a", "set_b"], "left")
    return nodes.select("node", "id", "n", F.coalesce("component", "node").alias("component")), numbered


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: tuple[int, int] = (80, 100), bands: int = 40, rows: int = 5) -> DataFrame:
    """[id_col, n_shingles, component_id, kept]: one row per document; a component's least id is kept.

    `least` is the similarity (part, whole) from which two documents link. A component without an id keeps one row.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    nodes, numbered = _found(docs, scratch, id_col, text_col, width, least, bands, rows)
    if numbered is None:
        return nodes.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("component") == F.col("id")).alias("kept"))
    nodes = scratch.save(nodes, "nodes")
    # An id's texts are one document, so their components are one.
    first = nodes.where("id is not null").groupBy("id").agg(F.min("component").alias("a"), F.max("component").alias("z")).where("a <> z").select("id", "a")
    bound = stars.components(nodes.join(first, "id").select("a", F.col("component").alias("b")).distinct(), scratch, "ids")
    nodes = nodes.join(bound.select(F.col("id").alias("component"), F.col("component").alias("more")), "component", "left").withColumn("component", F.coalesce("more", "component"))
    nodes = scratch.save(nodes.select("node", "id", "n", "component"), "bound")
    names = nodes.groupBy("component").agg(F.min("id").alias("name"), F.min("node").alias("first"))
    named = nodes.where("id is not null").groupBy("id", "component").agg(F.max("n").alias("n")).join(names, "component").select("id", "n", "name", (F.col("id") == F.col("name")).alias("kept"))
    unnamed = nodes.where("id is null").join(names, "component").select("id", "n", "name", (F.col("name").isNull() & (F.col("node") == F.col("first"))).alias("kept"))
    return named.union(unnamed).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("name").alias("component_id"), "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: tuple[int, int] = (80, 100), bands: int = 40, rows: int = 5) -> DataFrame:
    """The rows of docs without copies, with their columns: of each group the row with the least id stays.

    Rows are compared by their own texts, whatever their ids: rows that repeat an id with another text stay, and of equal
    rows one does. Rows with an id stay before those without.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    nodes, numbered = _found(docs, scratch, id_col, text_col, width, least, bands, rows)
    if numbered is None:
        copies = nodes.where("component <> id").select(F.col("id").alias(id_col))
        return docs.join(copies, id_col, "left_anti").select(*[column(c) for c in docs.columns])
    stay = nodes.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "node")).alias("m")).select("m.node")
    return numbered.join(stay, "node", "left_semi").select(*from_row("row", docs.columns))
