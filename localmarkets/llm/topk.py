"""Exact top-k inner products by columnar branch-and-bound.

Vectors are whole numbers. A tile of candidates is laid out vertically: a block of dimensions is one
matrix with a candidate in each column. A query adds up its products block by block; by Cauchy and
Schwarz what the remaining blocks can add is at most the product of the remaining lengths of both
vectors. The candidates with the highest sums after the first block are finished at once; their
k-th best score is a floor, and after each block only the candidates whose bound reaches the floor are
compacted into the next one. What is left at the end has exact scores, so nothing is approximate.

Queries are a stated set; they and the candidates are dealt to tiles of bounded bytes, and each block
of queries meets each tile of candidates in one task. Of the rows with one vector only the k + 1
smallest ids can be among the k best of any query (equal scores go by id, and one row may be the
query's own), so the others are left out before, in the map tasks.

Defined results: vectors that are null or hold null or non-finite components take part in nothing;
vectors meet those of as many components only (with none, the score is 0); a query is held against
every row but its own, so other rows with its id are candidates; rows that repeat a query's id and
vector repeat its result; null ids are no queries and come last among ties; components and scores
beyond 64 bits stop at its ends; an empty table gives an empty result. Only the id and vector columns
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from localmarkets.shared import cut

#: Dimensions of a block, candidates that are finished first, queries whose first block is multiplied at a time.
DIMS, FIRST, TOGETHER = 16, 32, 128
#: Bytes of a tile of candidates and of a block of queries.
TILE_BYTES, QUERY_BYTES = 4 << 20, 1 << 20
#: Sums below this are exact in doubles.
EXACT = 2.0**53
LIMIT = (1 << 63) - 1
FOUND = "query_id long, query_key long, n long, vec_id long, score long"


def whole_numbers(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: ``floor(scale * x)`` of each component x as a double; vectors with a component that isn't a number are left out."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return read.where(F.col("x").isNotNull() & F.forall("x", number)).select("vec_id", F.transform("x", lambda x: F.floor(x * float(scale))).alias("v"))


class Columns:
    """Candidates of one length in vertical layout, with the length of what remains from each block on."""

    def __init__(self, vectors: np.ndarray):
        self.n, self.d = vectors.shape
        self.blocks = [np.ascontiguousarray(vectors[:, a : a + DIMS].T) for a in range(0, self.d, DIMS)]
        self.rest = remaining(vectors)


def remaining(vectors: np.ndarray) -> np.ndarray:
    """Row b: the length of each vector from block b on (one row more than blocks, zero)."""
    ends = range(0, vectors.shape[1], DIMS)
    squares = np.array([(vectors[:, a : a + DIMS] ** 2).sum(axis=1) for a in ends] + [np.zeros(len(vectors))])
    return np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1])


def reaching(query: np.ndarray, rest: np.ndarray, begun: np.ndarray, columns: Columns, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact scores) of all candidates that reach the k-th best score; ``begun``: sums of the first block."""

    def mass(block: int, at: np.ndarray | slice) -> np.ndarray:
        return rest[block] * columns.rest[block, at] * (1 + 1e-9)

    bound = begun + mass(1, slice(None))
    few = max(FIRST, k)
    alive, floor = np.arange(columns.n), -np.inf
    if columns.n > few:
        first = np.argpartition(begun, -few)[-few:]
        exact = begun[first] + sum(query[b * DIMS : (b + 1) * DIMS] @ columns.blocks[b][:, first] for b in range(1, len(columns.blocks)))
        floor = np.partition(exact, -k)[-k]
        alive = np.flatnonzero(bound >= floor)
    total = begun[alive]
    for b in range(1, len(columns.blocks)):
        total = total + query[b * DIMS : (b + 1) * DIMS] @ columns.blocks[b][:, alive]
        on = total + mass(b + 1, alive) >= floor
        alive, total = alive[on], total[on]
    return alive, total


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Scores whose sums may pass 2^53, by Python's integers; they stop at the ends of 64 bits."""
    own = [int(x) for x in query]
    return np.array([max(-LIMIT, min(LIMIT, sum(a * int(b) for a, b in zip(own, row, strict=True)))) for row in vectors], np.int64)


def _matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of components: places in the table and their vectors (64-bit integers)."""
    lists = table.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = np.asarray(lists.offsets)
    values = lists.values.to_numpy()
    lengths = np.diff(offsets)
    out = {}
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        out[d] = at, values[offsets[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0), np.int64)
    return out


def tile_best(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Rows of ``FOUND``: the k best candidates of the tile for each query."""
    null = np.asarray(candidates.column("vec_id").is_null())
    order = candidates.column("vec_id").fill_null(LIMIT).to_numpy()
    query_ids, keys, ns = (queries.column(c).to_numpy() for c in ("query_id", "query_key", "n"))
    theirs = _matrices(candidates)
    parts: list[tuple[np.ndarray, ...]] = []

    def keep(q: int, places: np.ndarray, scores: np.ndarray, same: np.ndarray) -> None:
        best = np.lexsort((null[places], order[places], -scores))[: k + 1]
        places, scores = places[best], scores[best]
        if len(own := np.flatnonzero((order[places] == query_ids[q]) & ~null[places] & same[best])):
            places, scores = np.delete(places, own[0]), np.delete(scores, own[0])
        parts.append((np.full(min(k, len(places)), q), places[:k], scores[:k]))

    for d, (asked, wanted) in _matrices(queries).items():
        if d not in theirs:
            continue
        there, held = theirs[d]
        most = float(np.abs(wanted.astype(float)).max(initial=0)) * float(np.abs(held.astype(float)).max(initial=0)) * d
        if most >= EXACT or not d:
            for q, query in zip(asked, wanted, strict=True):
                keep(q, there, exact_scores(query, held), (held == query).all(axis=1))
            continue
        columns, points = Columns(held.astype(float)), wanted.astype(float)
        rests = remaining(points)
        for a in range(0, len(points), TOGETHER):
            begun = points[a : a + TOGETHER, :DIMS] @ columns.blocks[0]
            for i in range(len(begun)):
                at, scores = reaching(points[a + i], rests[:, a + i], begun[i], columns, k + 1)
                keep(asked[a + i], there[at], scores.astype(np.int64), (held[at] == wanted[a + i]).all(axis=1))
    q, at, scores = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    q, at = q.astype(np.int64), at.astype(np.int64)
    found = pa.array(order[at], mask=null[at])
    return pa.table({"query_id": query_ids[q], "query_key": keys[q], "n": ns[q], "vec_id": found, "score": scores.astype(np.int64)})


def exact_top_k(
    vectors: DataFrame, is_query: Column | None = None, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
    tile_bytes: int = TILE_BYTES, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row for which ``is_query`` (over vec_id) holds, the ``k`` best other rows."""
    numbers = whole_numbers(vectors, scale, id_col, vector_col)
    asked = numbers.where((F.col("vec_id") % 50 == 0) if is_query is None else is_query).groupBy(F.col("vec_id").alias("query_id"), "v").agg(F.count("*").alias("n"))
    alike = Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"))
    held = cut(numbers.withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    asked = cut(asked.withColumn("query_key", F.xxhash64("v")), "queries")
    size = F.max(F.size("v")).alias("d"), F.count("*").alias("n")
    there, wanted = held.agg(*size).first(), asked.agg(*size).first()
    tiles = max(1, -(-there["n"] * 8 * max(there["d"] or 1, 1) // tile_bytes))
    blocks = max(1, -(-wanted["n"] * 8 * max(wanted["d"] or 1, 1) // query_bytes))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = held.withColumn("tile", F.pmod(F.xxhash64("vec_id", "v"), F.lit(tiles)).cast("int")).withColumn("block", every(blocks))
    q = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks)).cast("int")).withColumn("tile", every(tiles))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        return tile_best(left, right, k)

    best = c.groupBy("block", "tile").cogroup(q.groupBy("block", "tile")).applyInArrow(met, FOUND)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("query_id", "rank", "vec_id", "score")
