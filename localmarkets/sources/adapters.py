"""Source adapters: a registry row and a job from landed input to raw listings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW = ["source_event_id", "title", "description", "city", "postcode", "date"]


@dataclass(frozen=True)
class Adapter:
    key: str
    name: str
    trust: float
    extract: Callable[[DataFrame], DataFrame]


def extract_all(adapters: list[Adapter], landed: dict[str, DataFrame]) -> DataFrame:
    """Raw listings of all adapters whose input has landed, each row with its source and trust."""
    rows = [a.extract(landed[a.key]).select(*RAW).withColumns({"source_key": F.lit(a.key), "trust": F.lit(a.trust)}) for a in adapters if a.key in landed]
    return reduce(DataFrame.unionByName, rows)
