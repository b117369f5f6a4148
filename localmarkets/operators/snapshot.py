"""Keyed tables that a batch changes in part.

Rows are dealt to partitions by a hash of their key. A batch (epoch) writes the partitions that it
touches as ``epoch=N/part=p``; the newest finished epoch of a partition counts. Nothing is changed in
place: a batch that fails leaves what was there, one that runs again reads what was before it and replaces
its own. A deleted key stays as a mark in the epoch that deleted it, so that a touched partition is never
without rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from localmarkets.shared import remove

#: Partitions of a table: a batch that touches few keys rewrites few of them.
PARTS = 64


@dataclass
class Snapshot:
    """``key``: columns that are unique together; ``deal``: those of them that choose the partition."""

    spark: SparkSession
    path: str
    key: list[str]
    deal: list[str] = field(default_factory=list)
    parts: int = PARTS

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*(self.deal or self.key)), F.lit(self.parts)).cast("int")

    def _folders(self, pattern: str) -> list[str]:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        files = jvm.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(jvm.Path(f"{self.path}/{pattern}"))
        return [f.getPath().toString() for f in files or []]

    def epochs(self, before: int | None = None) -> list[int]:
        """Finished epochs."""
        found = sorted(int(p.split("/epoch=")[1].split("/")[0]) for p in self._folders("epoch=*/_SUCCESS"))
        return [e for e in found if before is None or e < before]

    def versions(self, before: int | None = None) -> dict[int, int]:
        """The epoch of each partition that counts."""
        done, out = set(self.epochs(before)), {}
        for p in self._folders("epoch=*/part=*"):
            epoch, part = (int(x) for x in p.split("/epoch=")[1].split("/part="))
            if epoch in done:
                out[part] = max(epoch, out.get(part, -1))
        return out

    def _marked(self, before: int | None, only: list[int] | None) -> DataFrame | None:
        held = {p: e for p, e in self.versions(before).items() if only is None or p in only}
        if not held:
            return None
        return self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/epoch={e}/part={p}" for p, e in sorted(held.items())])

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """Rows and ``epoch``, the one that wrote their partition; of some partitions only, if they are named. Nothing, if there is no row."""
        rows = self._marked(before, only)
        return None if rows is None else rows.where("not __gone").drop("part", "__gone")

    def touched(self, *keys: DataFrame) -> list[int]:
        """The partitions of some keys: at most ``parts`` numbers."""
        dealt = [k.select(self.part().alias("part")) for k in keys]
        rows = dealt[0]
        for more in dealt[1:]:
            rows = rows.unionByName(more)
        return sorted(r.part for r in rows.distinct().collect())

    def write(self, epoch: int, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """The whole new contents of the partitions that ``rows`` and ``gone`` (keys) are in."""
        marked = rows.withColumn("__gone", F.lit(False))
        if gone is not None:
            marked = marked.unionByName(gone.select(*self.key, F.lit(True).alias("__gone")), allowMissingColumns=True)
        marked.withColumn("part", self.part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/epoch={epoch}")

    def apply(self, epoch: int, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Rows replace or join what is there, keys ``gone`` leave; only the partitions of both are read and written."""
        named = rows.select(*self.key) if gone is None else rows.select(*self.key).unionByName(gone.select(*self.key))
        parts = self.touched(named)
        if not parts:
            return
        old = self.read(epoch, parts)
        left = None if gone is None else gone.select(*self.key).distinct().join(rows.select(*self.key), self.key, "left_anti")
        kept = rows if old is None else old.drop("epoch").join(named.distinct(), self.key, "left_anti").unionByName(rows)
        self.write(epoch, kept, left)

    def prune(self, keep: int = 2) -> None:
        """Removes partitions that none of the last ``keep`` epochs counts on."""
        done = self.epochs()
        if len(done) <= keep:
            return
        held = {(e, p) for last in done[-keep:] for p, e in self.versions(last + 1).items()}
        for folder in self._folders("epoch=*/part=*"):
            epoch, part = (int(x) for x in folder.split("/epoch=")[1].split("/part="))
            if epoch < done[-keep] and (epoch, part) not in held:
                remove(self.spark, folder)
