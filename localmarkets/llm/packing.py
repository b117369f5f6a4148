"""Pattern packing by non-negative least squares.

Documents become token ids with an end id; only those longer than a sequence are cut, into full
pieces and a rest. The histogram of piece lengths, at most one count for each length up to a
sequence's, is all that the plan needs. Patterns of a few lengths that fill a sequence exactly are
enumerated (of three, for each longest length those with the most frequent partners, none, one or
some, whichever plans best), their repeat counts are
fitted to the histogram by non-negative least squares and rounded as far as the pieces reach, and
of what is left, patterns of more lengths that fill a sequence exactly are drawn by chance (seeded; lengths
as often as they are left) and used, and the rest is packed by best fit, many like sequences at a time.
Patterns that are drawn beforehand are fitted too, in one of the plans. Lengths are never rounded. The
plan has as many rows as patterns with different contents, however many pieces there are; pieces
take their places in it by their rank among those of their length.

Defined results: a null text is empty (the end id alone); repeated ids are separate documents told
apart by their order; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from localmarkets.llm.encoding import encoded
from localmarkets.llm.token_files import ended
from localmarkets.shared import cut

#: Tokens of a sequence.
LENGTH = 4096
#: Patterns of three that are enumerated for one longest length: a plan is made with each, the shortest stays.
PARTNERS = (0, 1, 4)
#: Pieces of a drawn pattern at most, draws of each number of pieces in a round, rounds without a find that end the drawing.
DRAWN_PIECES, DRAWS, IDLE = 24, 1024, 3
#: Steps of the fit.
ROUNDS = 400
#: Pieces of one length that a task ranks, so that a length that many pieces share is ranked by many tasks.
RANKED = 1024

#: Length, how many of it in a row.
Part = tuple[int, int]


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and its number in its task (``place``)."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for docs, ids, counts in encoded(batches, vocabulary):
            ids, counts = ended(ids, counts, end_id)
            n = -(-counts // length)
            doc = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * length
            size = np.minimum(counts[doc] - start, length)
            data = memoryview(ids.astype("<u4").tobytes())
            at = ((np.cumsum(counts) - counts)[doc] + start) * 4
            crc = [zlib.crc32(data[a : a + 4 * s]) for a, s in zip(at.tolist(), size.tolist(), strict=True)]
            columns = {"doc_id": docs.take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(size), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | {"place": pa.array(np.arange(place, place + len(doc)))})
            place += len(doc)

    return docs.select(id_col, text_col).mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long, place long")


def patterns(histogram: np.ndarray, room: int, partners: int) -> np.ndarray:
    """Multisets of one to three lengths that fill ``room`` exactly, one a row, longest first (0: no further piece).

    All of one and two; of three, for each longest length the ``partners`` whose rarer other length is most frequent.
    """
    held = np.zeros(room + 1, np.int64)
    held[: len(histogram)] = histogram[: room + 1]
    held[0] = 0
    found = [(room, 0, 0)] if held[room] else []
    for c in np.flatnonzero(held).tolist():
        rest = room - c
        if 0 < rest <= c and held[rest]:
            found.append((c, rest, 0))
        second = np.arange(-(-rest // 2), min(c, rest - 1) + 1)
        if rest > 1 and len(second):
            both = np.minimum(held[second], held[rest - second])
            best = np.argsort(-both, kind="stable")[:partners]
            found += [(c, s, rest - s) for s in second[best[both[best] > 0]].tolist()]
    return np.array(found, np.int64).reshape(-1, 3)


def drawn(left: np.ndarray, room: int, rng: np.random.Generator) -> np.ndarray:
    """Patterns of three to ``DRAWN_PIECES`` lengths that fill ``room`` exactly, as many columns (0: no further piece): all but the last
    length are drawn as often as they are left, the last is what fills the sequence, if there is such a piece."""
    lengths = np.flatnonzero(left[: room + 1])
    out = []
    if len(lengths):
        share = np.cumsum(left[lengths]) / left[lengths].sum()
        for k in range(max(3, -(-room // int(lengths[-1]))), min(DRAWN_PIECES, room // int(lengths[0])) + 1):
            some = lengths[np.minimum(np.searchsorted(share, rng.random((DRAWS, k - 1)), side="right"), len(lengths) - 1)]
            rest = room - some.sum(axis=1)
            good = (rest > 0) & (left[np.clip(rest, 0, room)] > 0)
            rows = np.zeros((int(good.sum()), DRAWN_PIECES), np.int64)
            rows[:, :k] = -np.sort(-np.column_stack([some[good], rest[good]]), axis=1)
            out.append(rows)
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, DRAWN_PIECES), np.int64)


def take(left: np.ndarray, row: np.ndarray, times: int | None) -> tuple[list[Part], int] | None:
    """Takes a pattern out of ``left`` as often as it is there, at most ``times`` (None: an eighth of that, once at least)."""
    kinds, n = np.unique(row[row > 0], return_counts=True)
    most = int((left[kinds] // n).min())
    most = min(times, most) if times is not None else max(1, most // 8) if most else 0
    if most <= 0:
        return None
    left[kinds] -= n * most
    return [(int(c), int(k)) for c, k in zip(kinds[::-1], n[::-1], strict=True)], most


def draw_out(left: np.ndarray, room: int, rng: np.random.Generator) -> list[tuple[list[Part], int]]:
    """Patterns drawn from ``left`` and taken, round after round, as long as some are found."""
    out, idle = [], 0
    while idle < IDLE and left.sum() > 2:
        rows = drawn(left, room, rng)
        found = [made for row in rows[rng.permutation(len(rows))] if (made := take(left, row, None))]
        out += found
        idle = 0 if found else idle + 1
    return out


def nnls(rows: np.ndarray, goal: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that minimises the squares of (uses of each length - goal), by accelerated projected gradients.

    Each of ``rows`` is a pattern: the lengths it uses; 0 is no length.
    """
    goal = goal.astype(float).copy()
    goal[0] = 0

    def uses(x: np.ndarray) -> np.ndarray:
        out = np.bincount(rows.ravel(), weights=np.repeat(x, rows.shape[1]), minlength=len(goal))
        out[0] = 0
        return out

    def gain(residual: np.ndarray) -> np.ndarray:
        return residual[rows].sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = gain(uses(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(gain(uses(v))))
    x, ahead, t = np.zeros(len(rows)), np.zeros(len(rows)), 1.0
    for _ in range(rounds):
        new = np.maximum(ahead + step * gain(goal - uses(ahead)), 0)
        if np.dot(ahead - new, new - x) > 0:  # going too far: start the acceleration anew
            t = 1.0
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / later * (new - x)
        x, t = new, later
    return x


def best_fit(left: np.ndarray, room: int) -> list[tuple[list[Part], int]]:
    """(parts, times) that take all of ``left`` (pieces of each length), longest first into the fullest sequence with room."""
    open_: dict[int, list[tuple[list[Part], int]]] = {}
    spaces = 0  # bit s: there are sequences with s tokens left

    def put(space: int, parts: list[Part], times: int) -> None:
        nonlocal spaces
        open_.setdefault(space, []).append((parts, times))
        spaces |= 1 << space

    for c in range(len(left) - 1, 0, -1):
        n = int(left[c])
        while n:
            fits = spaces >> c
            if not fits:  # as many as will fit of this length in each
                each = max(1, min(room // c, n))
                times = max(1, n // each)
                put(room - each * c, [(c, each)], times)
                n -= each * times
                continue
            space = c + (fits & -fits).bit_length() - 1
            parts, times = open_[space].pop()
            if not open_[space]:
                del open_[space]
                spaces &= ~(1 << space)
            each = max(1, min(space // c, n))
            take = max(1, min(times, n // each))
            if take < times:
                put(space, parts, times - take)
            put(space - each * c, [*parts, (c, each)], take)
            n -= each * take
    return [x for some in open_.values() for x in some]


def plan(histogram: np.ndarray, room: int) -> list[tuple[list[Part], int]]:
    """Patterns and how often each is used; they take each length exactly as often as ``histogram`` says."""
    left = np.zeros(room + 1, np.int64)
    left[: len(histogram)] = histogram
    made = [_plan(left.copy(), room, partners, more) for partners, more in [*((p, False) for p in PARTNERS), (1, True)]]
    rng = np.random.default_rng(0)
    alone = left.copy()
    made.append(draw_out(alone, room, rng) + best_fit(alone, room))
    return min(made, key=lambda one: sum(times for _, times in one))


def _plan(left: np.ndarray, room: int, partners: int, more: bool) -> list[tuple[list[Part], int]]:
    """``more``: drawn patterns are fitted beside the enumerated ones, and drawn again from what is left."""
    rng = np.random.default_rng(0)
    rows, out = patterns(left, room, partners), []
    if more:
        rows = np.concatenate([np.pad(rows, ((0, 0), (0, DRAWN_PIECES - rows.shape[1]))), drawn(left, room, rng)])
    if len(rows):
        x = nnls(rows, left)
        for j in np.argsort(-x, kind="stable"):
            times = int(np.rint(x[j]))
            if times <= 0:
                break
            if one := take(left, rows[j], times):
                out.append(one)
    if more:
        out += draw_out(left, room, rng)
    return out + best_fit(left, room)


def places(planned: list[tuple[list[Part], int]]) -> np.ndarray:
    """(length, first rank, each, first sequence, offset) of each part, by length and rank.

    Rank r of the length, k after the first rank, is in sequence first sequence + k // each, at offset + k % each lengths.
    """
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for parts, times in planned:
        offset = 0
        for c, each in parts:
            at = rank.get(c, 0)
            out.append((c, at, each, sequence, offset))
            rank[c] = at + each * times
            offset += c * each
        sequence += times
    found = np.array(out, np.int64).reshape(-1, 5)
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def pack(cut_pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces with sequence_id and offset. ``cut_pieces`` has to give the same rows each time it is read."""
    spark = cut_pieces.sparkSession
    counts = {r["length"]: r.n for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``length`` rows
    slots = places(plan(np.bincount(list(counts), weights=list(counts.values()), minlength=length + 1).astype(np.int64) if counts else np.zeros(length + 1, np.int64), length))
    groups = spark.createDataFrame([(c, -(-n // RANKED)) for c, n in counts.items()], "length long, groups long")
    rows = cut_pieces.join(F.broadcast(groups), "length").withColumn("part", F.pmod(F.xxhash64("place", "doc_id"), "groups")).drop("groups")
    sums = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = sums.select("length", "part", (F.sum("n").over(earlier) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "place")
    ranked = rows.withColumn("own", F.row_number().over(order)).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    first = np.searchsorted(slots[:, 0], np.arange(length + 2))  # of each length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lengths and ranks as one number each, in the order of ``slots``.
        most = max(slots[:, 1].max(initial=0), 0) + 1
        keys = slots[:, 0] * most + slots[:, 1]
        for b in batches:
            size, rank = (b.column(n).to_numpy().astype(np.int64) for n in ("length", "rank"))
            at = np.where(rank < most, np.searchsorted(keys, size * most + np.minimum(rank, most - 1), side="right"), first[size + 1]) - 1
            _, begin, each, sequence, offset = slots[at].T
            k = rank - begin
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in columns], pa.array(sequence + k // each), pa.array(offset + k % each * size)], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    return pack(cut(pieces(docs, vocabulary, end_id, length), "pieces"), length)
