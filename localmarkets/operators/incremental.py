"""Resolution that goes on from run to run: only clusters that a batch touches are cut open and joined again.

Kept are the prepared listings, the accepted pairs (both ways) and the clusters, each as a ``Snapshot``.
A batch brings new, changed and removed listings. Their pairs fall, new ones are judged between the batch
and what shares a block with it, and the components are found anew among the members of the clusters that
lost or gained a pair. The listings' block keys are read once; the pairs judged, the components and the
partitions written are those of the batch. The result is that of a rebuild.

The search for titles is a block of its own kind: its ranks depend on the counts of all listings. ``search``
makes this block anew in each batch, from postings of all listings, and takes the difference to what it
accepted before; without it a rebuild has to be made without it too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from localmarkets.operators import resolve as R
from localmarkets.operators.snapshot import PARTS, Snapshot
from localmarkets.shared import cut

PAIR = "a bigint, b bigint"


def _both_ways(pairs: DataFrame, searched: bool) -> DataFrame:
    one = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    return one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("searched", F.lit(searched))


@dataclass
class Resolution:
    listings: Snapshot
    pairs: Snapshot
    found: Snapshot

    @classmethod
    def at(cls, spark: SparkSession, path: str, parts: int = PARTS) -> Resolution:
        return cls(Snapshot(spark, f"{path}/listings", ["k"], parts=parts), Snapshot(spark, f"{path}/pairs", ["u", "v", "searched"], ["u"], parts), Snapshot(spark, f"{path}/clusters", ["k"], parts=parts))

    def epoch(self) -> int:
        """The last one that all three tables finished."""
        return min(max(t.epochs(), default=-1) for t in (self.listings, self.found))

    def clusters(self) -> DataFrame:
        """(k, cluster): the smallest k of each listing's market."""
        return self.found.read(self.epoch() + 1).select("k", "cluster")

    def rebuild(self, listings: DataFrame, search: bool = True) -> None:
        rows = R.prepared_table(listings)
        epoch = self.epoch() + 1
        near = cut(R.located_matches(rows), "near")
        edges = _both_ways(near, False)
        if search:
            edges = edges.unionByName(_both_ways(R.match_pairs(rows, R.found_pairs(rows)).where("is_match"), True))
        edges = cut(edges, "accepted")
        made = cut(R.clusters(rows, edges.where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b"))), "clusters")
        for table, whole in ((self.listings, rows), (self.pairs, edges), (self.found, made)):
            # A rebuild replaces all: what it doesn't have is gone.
            old = table.read(epoch)
            table.write(epoch, whole, None if old is None else old.select(*table.key).join(whole.select(*table.key), table.key, "left_anti"))

    def update(self, changed: DataFrame, removed: DataFrame | None = None, search: bool = True) -> None:
        """``changed``: listings as they are now; ``removed``: column k."""
        now = self.epoch() + 1
        spark = changed.sparkSession
        fresh = R.prepared_table(changed)
        gone = spark.createDataFrame([], "k long") if removed is None else removed.select("k")
        gone = cut(gone.distinct().join(fresh.select("k"), "k", "left_anti"), "removed")
        touched = cut(fresh.select("k").unionByName(gone), "touched")
        held = self.listings.read(now).drop("epoch").join(touched, "k", "left_anti")
        pairs = self.pairs.read(now)
        pairs = spark.createDataFrame([], "u long, v long, searched boolean") if pairs is None else pairs.select("u", "v", "searched")
        near = cut(R.located_matches(fresh, held), "near")
        ends = lambda rows: rows.select(F.explode(F.array("u", "v")).alias("k"))
        hit = touched.withColumnRenamed("k", "u")
        lost = pairs.where("not searched").join(hit, "u", "left_semi")
        lost = lost.unionByName(lost.select(F.col("v").alias("u"), F.col("u").alias("v"), "searched"))
        won = _both_ways(near, False)
        if search:
            rows = cut(held.unionByName(fresh), "rows")
            anew = cut(_both_ways(R.match_pairs(rows, R.found_pairs(rows)).where("is_match"), True), "searched")
            before = pairs.where("searched")
            lost = lost.unionByName(before.join(anew, ["u", "v", "searched"], "left_anti"))
            won = won.unionByName(anew.join(before, ["u", "v", "searched"], "left_anti"))
        lost, won = cut(lost.distinct(), "lost"), cut(won.distinct(), "won")
        old = self.found.read(now).select("k", "cluster")
        moved = ends(lost.unionByName(won)).unionByName(touched).distinct()
        open_ = cut(old.join(moved, "k", "left_semi").select("cluster").distinct(), "open")
        members = old.join(open_, "cluster", "left_semi").select("k").join(touched, "k", "left_anti").unionByName(fresh.select("k"))
        members = cut(members, "members")
        # A pair lies within one cluster, so one end tells of both.
        inside = pairs.join(members.withColumnRenamed("k", "u"), "u", "left_semi").join(lost, ["u", "v", "searched"], "left_anti").select("u", "v").unionByName(won.select("u", "v"))
        made = cut(R.clusters(members, inside.where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()), "clusters")
        self.listings.apply(now, fresh, gone)
        self.pairs.apply(now, won, lost)
        self.found.apply(now, made, gone)
