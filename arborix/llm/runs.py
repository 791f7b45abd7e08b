"""A family of sorted runs in levels, compacted geometrically.

A run is a bucketed, sorted table with one entry for each key. A batch becomes
a run of level 0, and can be scanned against all runs before it; ``fan_out``
runs of a level merge into one of the next, so that an entry is rewritten once
for each level. All runs have the same buckets, so a run is scanned against
others, and runs merge, bucket by bucket, by merge joins that move nothing.

Runs lie in the shared folder, not in the session's warehouse.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: How two entries of a key become one; either may be missing.
MERGES = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
}


class Runs:
    def __init__(self, spark: SparkSession, label: str, keys: list[str], merge: dict[str, str], *, fan_out: int = 2, buckets: int | None = None) -> None:
        """merge: for each other column how entries of a key in several runs become one."""
        self.spark, self.label, self.keys, self.merge, self.fan_out = spark, label, keys, merge, fan_out
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[str]] = [[]]
        self.folder = f"{common.shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        common.delete_on_exit(spark, self.folder)

    def names(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def _write(self, entries: DataFrame) -> str:
        name = f"{self.label}_{uuid.uuid4().hex}"
        rows = entries.select(*self.keys, *self.merge).repartition(self.buckets, *self.keys)
        rows.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).options(**common.WRITING).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def append(self, entries: DataFrame) -> DataFrame:
        """A batch's entries, one for each key, as a run of level 0."""
        self.levels[0].append(self._write(entries))
        return self.spark.table(self.levels[0][-1])

    def before(self) -> list[DataFrame]:
        """The runs before the last one appended."""
        last = self.levels[0][-1]
        return [self.spark.table(name) for name in self.names() if name != last]

    def compact(self) -> None:
        k = 0
        while k < len(self.levels) and len(self.levels[k]) >= self.fan_out:
            if k + 1 == len(self.levels):
                self.levels.append([])
            merged = self._write(self.merged(self.levels[k]))
            old, self.levels[k] = self.levels[k], []
            self.levels[k + 1].append(merged)
            self._drop(old)
            k += 1

    def add(self, entries: DataFrame) -> None:
        """A batch's entries, one for each key; then compaction."""
        self.append(entries)
        self.compact()

    def merged(self, names: list[str] | None = None) -> DataFrame:
        """Runs, all of them if none are named, as one entry for each key."""
        first, *rest = names or self.names()
        out = self.spark.table(first)
        for name in rest:
            out = self._pair(out, self.spark.table(name))
        return out

    def _pair(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """A union and a sum would be as short, but Spark takes a union of bucketed tables for one that is bucketed
        itself and leaves equal keys apart."""
        other = b.select(*self.keys, *[F.col(c).alias(f"__{c}") for c in self.merge]).hint("merge")
        both = a.join(other, self.keys, "full_outer")
        columns: list[Column] = [MERGES[how](F.col(c), F.col(f"__{c}")).alias(c) for c, how in self.merge.items()]
        return both.select(*self.keys, *columns)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            common.delete(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        self._drop(self.names())
        common.delete(self.spark, self.folder)
        self.levels = [[]]
