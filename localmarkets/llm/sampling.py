"""Bounded samples of labelled rows, chosen by a hash so that the order of arrival decides nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def least_hashes(rows: DataFrame, of: int, most: int, key: Column, order: str) -> DataFrame:
    """The ``most`` rows with the least hash ``key`` (kept as column ``order``), of ``of`` rows.

    A bound on the hash lets about a quarter more than ``most`` through before they are put in order,
    so what meets in one place does not grow with the number of rows or partitions. Where far fewer
    than ``of`` rows are there, or many have one hash, fewer than ``most`` may come.
    """
    share = min(1.0, (1.25 * most + 100) / max(of, 1))
    bound = F.lit(min((1 << 63) - 1, int((2 * share - 1) * (1 << 63))))
    return rows.withColumn(order, key).where(F.col(order) <= bound).orderBy(order).limit(most)
