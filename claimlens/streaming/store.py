"""A keyed table for streams: rows in buckets by their key's hash, and a log of committed versions.

A batch rewrites only the buckets that its keys fall into, each into a folder of the new version, and then writes the version's log entry: for every
bucket the version whose folder holds it, and for every stream its last batch.  Readers follow the last entry, so half a batch is never seen.
A batch that is run again before its entry rewrites the same folders, and one that is run again after it changes nothing.  The files that a
batch reads are those of its buckets, however many batches came before.  A table has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import remove

LOG = "version long, bucket int, held long, stream string, batch long"


class KeyedTable:
    """``keys`` decide the bucket.  The path holds ``data/bucket=../version=..`` and ``log/version=..``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: Sequence[str], buckets: int = 64):
        self.schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _log(self) -> list:
        try:  # the last entries, with a row for each bucket and stream
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log").collect()
        except Exception as e:  # before the first commit there is no log
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []

    def committed(self) -> tuple[int, dict[int, int], dict[str, int]]:
        """The last version (0: none), the version that holds each bucket, and the last batch of each stream."""
        log = self._log()
        last = max((r.version for r in log), default=0)
        now = [r for r in log if r.version == last]
        return last, {r.bucket: r.held for r in now if r.bucket is not None}, {r.stream: r.batch for r in now if r.stream is not None}

    def has(self, batch: int, stream: str = "") -> bool:
        return self.committed()[2].get(stream, -1) >= batch

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """The committed rows, of some buckets if named."""
        return self._read({b: n for b, n in self.committed()[1].items() if only is None or b in only})

    def _read(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/bucket={b}/version={n}" for b, n in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())  # a number for each bucket

    def update(self, batch: int, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], stream: str = "") -> bool:
        """``merge(old, rows)`` replaces the old rows of the touched buckets; false if that batch of the stream is committed already.

        ``rows`` are read more than once.  ``merge`` may drop old rows but must not move any to another bucket.
        """
        last, held, streams = self.committed()
        if streams.get(stream, -1) >= batch:
            return False
        version, mine = last + 1, self.touched(rows)
        full: list[int] = []  # a merge may leave a bucket empty
        if mine:
            merged = merge(self._read({b: held[b] for b in mine if b in held}), rows).select(*self.schema.names)
            words = range(-(-self.buckets // 64))
            bit, seen = F.expr("shiftleft(1L, bucket % 64)"), Observation()
            out = merged.withColumns({"bucket": self.bucket(), "version": F.lit(version)}).repartition(F.col("bucket"))
            out = out.observe(seen, *[F.bit_or(F.when(F.expr(f"bucket div 64 = {w}"), bit)).alias(f"w{w}") for w in words])
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{self.path}/data")
            full = [64 * w + i for w in words for i in range(64) if (seen.get[f"w{w}"] or 0) >> i & 1]
        now = {b: n for b, n in held.items() if b not in mine} | {b: version for b in full}
        entry = [(b, n, None, None) for b, n in sorted(now.items())] + [(None, None, s, n) for s, n in (streams | {stream: batch}).items()]
        table = self.spark.createDataFrame(entry, "bucket int, held long, stream string, batch long")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/version={version}")
        self._vacuum()
        return True

    def _vacuum(self) -> None:
        """Delete what only entries before the last two hold: a reader that began before the last commit still finds its files."""
        log = self._log()
        keep = sorted({r.version for r in log})[-2:]
        held = lambda old: {(r.bucket, r.held) for r in log if r.bucket is not None and (r.version not in keep) == old}
        for b, n in sorted(held(True) - held(False)):
            remove(self.spark, f"{self.path}/data/bucket={b}/version={n}")
        for n in sorted({r.version for r in log} - set(keep)):
            remove(self.spark, f"{self.path}/log/version={n}")


def upsert(keys: Sequence[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge by which a row replaces the old row of its keys."""
    return lambda old, rows: old.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows.dropDuplicates(list(keys)))


def insert(keys: Sequence[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that keeps the row that came first for its keys."""
    return lambda old, rows: old.unionByName(rows.dropDuplicates(list(keys)).join(old.select(*keys).distinct(), list(keys), "left_anti"))
