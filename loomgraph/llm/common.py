"""What the operators share: scratch tables, the workers' large objects, distributed ranks, hashed words."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.edges import name as column
from loomgraph.plans.store import shared_folder

#: White space of every operator here: the bytes 0x20 and 0x09 to 0x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Rows and bytes of an Arrow batch: texts can be long, and a worker's memory follows its batches.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, by rows and by bytes; and the place of this package on the workers' path, for sessions that
    were started somewhere else."""
    path = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    root = str(Path(__file__).resolve().parents[2])
    if root not in path:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, path)])
    rows, size = (f"spark.sql.execution.arrow.{key}" for key in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


_HELD: dict[str, object] = {}


def held_in_worker(key: str, make: Callable[[], object]):
    """A Python worker's large object (an automaton, an index, a vocabulary), made once for all tasks that it serves.

    Workers are used again by later stages, so they hold one such object: another key's goes first.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


_SCOPES: list[list[Scratch]] = []


@contextmanager
def released() -> Iterator[None]:
    """Deletes the tables of every Scratch made inside when it is left; what is read from them must be written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for scratch in _SCOPES.pop():
            scratch.delete()


class Scratch:
    """Tables written to the shared folder. They cut lineage and outlive any executor; the JVM deletes them when it ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)
        if _SCOPES:
            _SCOPES[-1].append(self)

    def save(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """df as read back. `files` deals a table of known, small size to so many files, whatever made it."""
        (df.repartition(files) if files else df).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def counted(self, df: DataFrame, name: str, files: int | None = None, **metrics: Column) -> tuple:
        """(save(), the number of rows, the metrics), observed while they are written."""
        seen = Observation()
        kept = self.save(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]), name, files)
        return kept, seen.get["rows"], *[seen.get[k] for k in metrics]

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def delete(self) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path), True)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that none clashes with an operator's own."""
    return F.struct(*[column(c) for c in df.columns])


def from_row(row: str, columns: Sequence[str]) -> list[Column]:
    """The columns of a whole_row()."""
    return [F.col(row).getField(c).alias(c) for c in columns]


def blocks_for(rows: int, each: int = 20_000) -> int:
    return max(1, -(-rows // each))


def ranked(df: DataFrame, keys: Sequence[str], by: Column, order: Sequence[Column], blocks: int, name: str) -> DataFrame:
    """Gapless ranks from 0 within `keys`, without a key's rows in one task.

    Rows are dealt to `blocks` blocks by a hash of `by`; a window ranks the few rows of a key in a block, and the
    blocks' counts, one row for each key and block, give each block its start.
    """
    dealt = df.withColumn("__block", F.pmod(F.xxhash64(by, F.lit(17)), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__block", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    inner = Window.partitionBy(*keys, "__block").orderBy(*order)
    local = dealt.withColumn("__local", F.row_number().over(inner) - 1)
    return local.join(starts, [*keys, "__block"]).withColumn(name, (F.col("__start") + F.col("__local")).cast("long")).drop("__block", "__rows", "__start", "__local")


# Words and their hashes, vectorised over many texts.

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SEGMENT = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[str, np.ndarray] = {"of": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _SEGMENT + 4096:  # a word of a megabyte; not worth keeping
        return _powers(int(_BASE), n), _powers(pow(int(_BASE), -1, 1 << 64), n)
    if len(_POWERS["of"]) < n:
        size = _SEGMENT + 4096
        _POWERS["of"], _POWERS["inverse"] = _powers(int(_BASE), size), _powers(pow(int(_BASE), -1, 1 << 64), size)
    return _POWERS["of"], _POWERS["inverse"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def folding(lower: bool = True, separators: bytes = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(value of each byte, whether it separates words); only A-Z change their case."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    apart = np.zeros(256, bool)
    apart[list(separators)] = True
    return table, apart


def _segments(texts: Sequence[bytes | None], apart: np.ndarray) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of (text number, piece) of about a megabyte; a longer text is cut where words end."""
    which, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        at = 0
        while at < len(text):
            end = min(len(text), at + _SEGMENT)
            if end < len(text):
                gaps = np.flatnonzero(apart[np.frombuffer(text, np.uint8, end - at, at)])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:
                    more = next((k for k in range(end, len(text), _SEGMENT) if apart[np.frombuffer(text, np.uint8, min(_SEGMENT, len(text) - k), k)].any()), None)
                    end = len(text) if more is None else more + int(np.argmax(apart[np.frombuffer(text, np.uint8, min(_SEGMENT, len(text) - more), more)])) + 1
            which.append(i)
            pieces.append(text[at:end])
            size += end - at
            at = end
            if size >= _SEGMENT:
                yield which, pieces
                which, pieces, size = [], [], 0
    if pieces:
        yield which, pieces


def word_hashes(texts: Sequence[bytes | None], fold: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and for each text where its words start (one more at the end)."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    gap = bytes([int(np.argmax(apart))])
    for which, pieces in _segments(texts, apart):
        raw = np.frombuffer(gap.join(pieces) + gap, np.uint8)
        of, inverse = _tables(len(raw) + 1)
        outside = np.empty(len(raw) + 1, np.int8)
        outside[0], outside[1:] = 1, apart[raw]
        edge = np.diff(outside)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((fold[raw].astype(np.uint64) + np.uint64(1)) * of[: len(raw)], out=total[1:])
        hashes.append(mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
        cuts = np.cumsum([0] + [len(p) + 1 for p in pieces])
        np.add.at(counts, which, np.diff(np.searchsorted(starts, cuts)))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + max(n, 0)]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1)
    return mixed(out)


def shingle_sets(texts: Sequence[bytes | None], width: int, fold: np.ndarray, apart: np.ndarray) -> list[np.ndarray]:
    """For each text its sorted distinct shingles; fewer words than `width` make one shingle, no word none."""
    hashes, at = word_hashes(texts, fold, apart)
    out = []
    for i in range(len(texts)):
        own = hashes[at[i] : at[i + 1]]
        out.append(np.unique(windows(own, width)) if len(own) >= width else windows(own, len(own)) if len(own) else own)
    return out


def encoded(texts) -> list[bytes | None]:
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else None for x in texts]


def held_out(doc_id: Column) -> Column:
    """Documents that nothing learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def spread(*values: Column) -> Column:
    """A number in [0, 1) from the values, the same on every run."""
    return F.pmod(F.xxhash64(*values), F.lit(1 << 40)) / float(1 << 40)
