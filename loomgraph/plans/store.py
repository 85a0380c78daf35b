"""Where loops put their rounds: tables in a folder that driver and executors share.

The folder is the session's spark.checkpoint.dir, or the caller's. Every run writes into a fresh folder of its own, so
runs never overwrite each other's tables, and the JVM deletes those folders when it ends. A table survives the loss of
any executor, and reading it back cuts the lineage.
"""

from __future__ import annotations

import getpass
import tempfile
import uuid
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a loop's table to a partition; rounds on small graphs then take one task instead of many empty ones.
ROWS_PER_FILE = 100_000
#: Rows of a key of a resident table, and of its partitions, beyond which they are split.
HUB = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; unset, a temporary folder if all runs in one JVM, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/loomgraph-{getpass.getuser()}"


class Resident(NamedTuple):
    """Rows that stay dealt by `key`, or by it and a salt where keys are split (hubs: how many salts these have)."""

    rows: DataFrame
    key: str
    hubs: DataFrame | None

    def meets(self, state: DataFrame) -> DataFrame:
        """The rows joined with a state that has their key."""
        if self.hubs is None:
            return self.rows.join(state, self.key)
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)).alias("__salt")
        repeated = state.join(F.broadcast(self.hubs), self.key, "left").select(*state.columns, salts)
        return self.rows.join(repeated, [self.key, "__salt"]).drop("__salt")


class Store:
    """A run's tables. Those written into the caller's own folder stay; others go when the JVM ends.

    `tables` counts all that this process has written, for benchmarks.
    """

    tables = 0

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        base = folder if folder is not None else shared_folder(spark)
        self.path = f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(where)
        if folder is None:
            self._files.deleteOnExit(where)
        self._written = 0
        self._resident: list[DataFrame] = []

    def keep(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        """Writes df and returns it as read back. `partitions` bounds the files of a table known to be small.

        Its rows are dealt to them when they are there: what makes them may take many more, and is not drawn into few tasks.
        """
        return self._write(df.repartition(partitions) if partitions else df)

    def _write(self, df: DataFrame) -> DataFrame:
        self._written += 1
        Store.tables += 1
        path = f"{self.path}/t{self._written}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def measured(self, df: DataFrame, partitions: int | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
        """keep(), and aggregates of the rows that are observed while they are written: no job of their own."""
        seen = Observation()
        dealt = df.repartition(partitions) if partitions else df
        return self._write(dealt.observe(seen, *[c.alias(k) for k, c in metrics.items()])), seen.get

    def resident(self, df: DataFrame, key: str) -> Resident:
        """keep(), then dealt by a key that every round joins on: a round shuffles its state, not these rows.

        Partitions follow from the rows. A key with more than HUB rows is split: its rows are dealt to several
        partitions by a salt, and a state that meets() them is repeated for the few salts of such keys. Lost blocks are
        read again from the table. release() frees them.
        """
        kept, seen = self.measured(df, rows=F.count(F.lit(1)))
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-seen["rows"] // HUB))
        hubs = kept.groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > HUB)
        hubs, found = self.measured(hubs.select(key, F.ceil(F.col("__rows") / HUB).cast("int").alias("__salts")), 1, rows=F.count(F.lit(1)))
        by = [key]
        if found["rows"]:  # at most rows / HUB of them
            salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.coalesce("__salts", F.lit(1))).cast("int")
            kept = kept.join(F.broadcast(hubs), key, "left").withColumn("__salt", salt).drop("__salts")
            by.append("__salt")
        dealt = kept.repartition(parts, *by).persist(StorageLevel.MEMORY_AND_DISK)
        self._resident.append(dealt)
        return Resident(dealt, key, hubs if found["rows"] else None)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()

    def release(self) -> None:
        while self._resident:
            self._resident.pop().unpersist()

    def forget(self, keep_last: int = 2) -> None:
        """Deletes all tables but the last few; not for stores with resident frames."""
        for k in range(1, self._written - keep_last + 1):
            self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/t{k}"), True)


def files_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_FILE))
