"""Ranked lexical search over bit-sliced Bloom signatures.

A document's signature is a Bloom filter of its terms. A term that occurs ``tf`` times is put in once
for each level whose least count (``COUNTS``) it reaches, so that the levels that are found tell how
often it may occur. Documents of like sizes make a block; its signatures are kept by bit: a slice is
the bitmap of the documents that have the bit. The documents that may hold a term at a level are the
conjunction of the term's slices, too many of them but never too few. The sum of the terms' slices,
each weighted by what its level can add at most, is an upper bound of each document's score.

A first pass over the blocks takes each query's documents with the highest bounds; they are scored
from their texts, and the last of the best is the floor. A second pass keeps every document that isn't
provably behind the floor (bound, then id), and all of these are scored from their texts. The result is
exact; the signatures only decide which texts are read. The index is a table of the shared folder and
knows nothing of the queries; document frequencies are kept in it by term.

Terms are maximal runs of ASCII letters and digits and characters outside ASCII, A-Z in lower case.
With N documents that have a term, L terms in them, n terms in a document: w = floor(1000 ln((2N + 2) /
(2 df + 1))), m = 50 + (50 n N) div L, and a document scores the sum of w ((10^9 tf) div (1000 tf + 20 m))
over a query's distinct terms.

Defined results: null and empty texts have no term and are never found, such queries find nothing;
scores of 0 are left out; equal scores go by id, null ids last; repeated rows are found each; queries
of one text share their results; empty tables give an empty result. Of documents with one text only
the ``most`` smallest ids can be among the best, so a block names no more of them. Only the id and text
columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from localmarkets.llm.encoding import slices
from localmarkets.shared import cut

#: Least counts of the levels.
COUNTS = np.array([1, 2, 3, 5, 9, 17, 33, 65, 129, 257, 513, 1025, 4097, 1 << 14, 1 << 18], np.int64)
#: Slices of a term, bits of a signature for each entry (rounded up to a power of two), bits and documents of a block.
HASHES, SPARSE, BLOCK_BITS, BLOCK_DOCS = 6, 8, 1 << 23, 4096
#: Terms that a task counts before it tells them, bytes of text that are split at a time.
COUNTED, SPLIT = 200_000, 1 << 20
#: Terms in a block of queries (an item with more is a block of its own), numbers in a matrix of bounds.
QUERY_TERMS, CELLS = 1 << 14, 1 << 21
#: Terms of queries that are counted alone; with more of them all terms are.
ASKED_TERMS = 1 << 18
#: Documents by bound that set the floor, for each one wanted.
FIRST = 2
#: Bytes of document marks that are sent to every task; above it they are joined by a shuffle.
SENT_BYTES = 16 << 20
LAST = (1 << 63) - 1

#: Bytes of a term, A-Z in lower case; all others are blanks.
_TERM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_STEP, _ONE, _TWO = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def terms(data: bytes) -> Counter[bytes]:
    """Terms of a UTF-8 text and how often each occurs; a long text is split a stretch at a time."""
    plain, found, at = data.translate(_TERM), Counter(), 0
    while at < len(plain):
        end = plain.find(b" ", at + SPLIT)
        end = len(plain) if end < 0 else end
        found.update(plain[at:end].split())
        at = end
    return found


def places(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The ``HASHES`` bits of each term at a level, one row each, of signatures of ``bits`` (a power of two)."""
    x = hashes + np.uint64((level * int(_STEP)) % (1 << 64))
    x = (x ^ (x >> np.uint64(33))) * _ONE
    x ^= x >> np.uint64(33)
    more, shift = (x * _TWO) | np.uint64(1), np.uint64(64 - (bits.bit_length() - 1))
    return np.array([((x + np.uint64(i) * more) * _STEP) >> shift for i in range(HASHES)], np.int64)


def hashed(found: Counter[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)), np.fromiter(found.values(), np.int64, len(found))


class Block:
    """Documents whose signatures have as many bits."""

    def __init__(self, bits: int):
        self.bits, self.full = bits, max(8, min(BLOCK_DOCS, BLOCK_BITS // bits))
        self.docs: list[tuple] = []  # id, mark, number of terms, hashes, counts

    def slices(self) -> np.ndarray:
        """A row for each bit, a bit of it for each document."""
        has = np.zeros((self.bits, -(-len(self.docs) // 8) * 8), bool)
        at = np.repeat(np.arange(len(self.docs)), [len(d[3]) for d in self.docs])
        hashes, counts = (np.concatenate([d[i] for d in self.docs]) for i in (3, 4))
        for level, least in enumerate(COUNTS):
            on = counts >= least
            if not on.any():
                break
            for row in places(hashes[on], level, self.bits):
                has[row, at[on]] = True
        return np.packbits(has, axis=1, bitorder="little")

    def row(self) -> dict:
        data = self.slices().tobytes()
        return {"bits": self.bits, "size": len(data), "ids": [d[0] for d in self.docs], "marks": [d[1] for d in self.docs], "lengths": [d[2] for d in self.docs], "slices": data}


#: Rows of the index: counts of a term (of no term: documents and terms in all), or a block.
ROWS = "term string, docs long, terms long, block long, bits int, size long, ids array<long>, marks array<binary>, lengths array<long>, slices binary"
_ARROW = pa.schema([
    ("term", pa.string()), ("docs", pa.int64()), ("terms", pa.int64()), ("block", pa.int64()), ("bits", pa.int32()), ("size", pa.int64()),
    ("ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int64())), ("slices", pa.binary()),
])


def mark(text: Column) -> Column:
    """Stands for a whole text."""
    return F.unhex(F.md5(text))


@dataclass
class Index:
    """``rows``: the table; ``docs``, ``terms``: documents that have a term, and terms in all."""

    rows: DataFrame
    docs: int
    terms: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: frozenset[bytes] | None = None) -> Index:
    """Signatures and document frequencies (of all terms, or ``only`` of these) of all texts: one pass."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, told = TaskContext.get().partitionId(), 0
        open_: dict[int, Block] = {}
        counts: Counter[bytes] = Counter()
        n_docs = n_terms = 0

        def blocks(ready: list[Block]) -> Iterator[pa.RecordBatch]:
            nonlocal told
            for block in ready:
                yield pa.RecordBatch.from_pylist([{"block": (part << 32) + told} | block.row()], _ARROW)
                told += 1

        def frequencies() -> pa.RecordBatch:
            own = {"term": [*(t.decode() for t in counts), None], "docs": [*counts.values(), n_docs], "terms": [*([None] * len(counts)), n_terms]}
            size = len(counts) + 1
            columns = [pa.array(own[f.name], f.type) if f.name in own else pa.nulls(size, f.type) for f in _ARROW]
            return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

        for b in slices(batches):
            for i, m, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = terms(data or b"")
                if not found:
                    continue
                n, (hashes, tf) = found.total(), hashed(found)
                n_docs, n_terms = n_docs + 1, n_terms + n
                counts.update(found.keys() if only is None else only & found.keys())
                entries = int(np.searchsorted(COUNTS, tf, side="right").sum())
                bits = 1 << max(6, (SPARSE * entries - 1).bit_length())
                block = open_.setdefault(bits, Block(bits))
                block.docs.append((i, m, n, hashes, tf))
                if len(block.docs) == block.full:
                    yield from blocks([open_.pop(bits)])
            if len(counts) > COUNTED:
                yield frequencies()
                counts, n_docs, n_terms = Counter(), 0, 0
        yield from blocks(list(open_.values()))
        yield frequencies()

    read = docs.select(F.col(id_col).cast("long"), mark(F.col(text_col)), F.col(text_col).cast("binary"))
    rows = cut(read.mapInArrow(indexed, ROWS), "lexical-index")
    whole = rows.where("term IS NULL AND block IS NULL").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return Index(rows, whole["docs"] or 0, whole["terms"] or 0)


def query_terms(items: DataFrame, text_col: str = "text") -> DataFrame:
    """(query, term): of each distinct text (its mark) the distinct terms, as a table."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(m, t.decode()) for m, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in terms(data or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["query", "term"])

    texts = items.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t")).distinct()
    return cut(texts.select(mark(F.col("t")), F.col("t").cast("binary")).mapInArrow(split, "query binary, term string"), "query-terms")


def weighted_queries(index: Index, own: DataFrame, block_terms: int) -> DataFrame:
    """query, part (its block), terms, weights: of each query (``query_terms``) the terms that documents have."""
    wanted = own.select("term").distinct()
    frequency = index.rows.where("term IS NOT NULL").select("term", "docs").join(wanted, "term").groupBy("term").agg(F.sum("docs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.docs + 2) / (2 * F.col("df") + 1)))
    known = own.join(frequency.select("term", weight.alias("w")).where("w > 0"), "term")
    lists = known.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("t"))
    lists = cut(lists.select("query", F.col("t.term").alias("terms"), F.col("t.w").alias("weights")), "queries")
    parts = max(1, -(-(lists.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    return lists.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))


class Asked:
    """A block of queries: their distinct terms once, which of them each query has, and the floors as far as they are known."""

    def __init__(self, rows: list, floors: dict[bytes, tuple[int, int | None]] | None = None):
        number: dict[str, int] = {}
        weights: list[int] = []
        self.queries, self.of = [bytes(r["query"]) for r in rows], []
        for r in rows:
            for term, w in zip(r["terms"], r["weights"], strict=True):
                if number.setdefault(term, len(weights)) == len(weights):
                    weights.append(w)
            self.of.append(np.array([number[t] for t in r["terms"]], np.int64))
        self.terms, self.weights = [t.encode() for t in number], np.array(weights, np.int64)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.terms), np.uint64, len(number))
        self.floors = None if floors is None else [floors.get(q, (1, None)) for q in self.queries]

    def scores(self, data: bytes, numbers: list[int], docs: int, all_terms: int) -> list[int]:
        """Of the queries with these numbers, from the whole text."""
        found = terms(data)
        m = 50 + (50 * found.total() * docs) // all_terms
        part = {}
        for t in {t for k in numbers for t in self.of[k].tolist()}:
            if tf := found.get(self.terms[t], 0):
                part[t] = int(self.weights[t]) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        return [sum(part.get(t, 0) for t in self.of[k].tolist()) for k in numbers]

    def bounds(self, data: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Upper bound of each query's score (row) in each document (column); ``data``: slices of these documents."""
        docs, bits = len(n), len(data)
        sums = np.zeros((len(self.weights), docs), np.int64)
        alive, before, present = np.arange(len(self.weights)), np.zeros(docs, np.int64), None
        for level in range(len(COUNTS)):
            rows = places(self.hashes[alive], level, bits)
            has = np.bitwise_and.reduce(data[rows], axis=0)
            present = has if present is None else present & has
            some = present.any(axis=1)
            alive, present = alive[some], present[some]
            if not len(alive):
                break
            most = np.minimum(COUNTS[level + 1] - 1 if level + 1 < len(COUNTS) else n, n)
            value = (1_000_000_000 * most) // (1000 * most + 20 * m)
            sums[alive] += np.unpackbits(present, axis=1, count=docs, bitorder="little") * (value - before)
            before = value
        sums *= self.weights[:, None]
        return np.array([sums[t].sum(axis=0) for t in self.of])


def found_documents(batches: Iterator[pa.RecordBatch], asked: Asked, docs: int, all_terms: int, most: int) -> pa.RecordBatch:
    """Rows (number of a query, doc_id, mark, bound) of a task's blocks. With floors: every document not provably behind its
    query's floor; else the ``FIRST * most`` highest bounds. No more than ``most`` with one text are named."""
    count, by_floor = len(asked.queries), asked.floors is not None
    least = np.array([f[0] for f in asked.floors], np.int64) if by_floor else np.ones(count, np.int64)
    last = np.array([LAST if f[1] is None else f[1] for f in asked.floors], np.int64) if by_floor else np.full(count, LAST)
    pools: list[list[tuple]] = [[] for _ in range(count)]  # (bounds, ids, null ids, marks)

    def shrink(q: int) -> None:
        bounds, ids, null, marks = (np.concatenate([p[i] for p in pools[q]]) for i in range(4))
        order = np.lexsort((null, ids, -bounds))
        if by_floor:
            if len(order) > most:
                own, alike = np.unique(marks[order], return_inverse=True)
                first = np.argsort(alike, kind="stable")
                begins = np.searchsorted(alike[first], np.arange(len(own)))
                place = np.empty(len(order), np.int64)
                place[first] = np.arange(len(order)) - begins[alike[first]]
                order = order[place < most]  # equal texts have one bound and are in the order of ids
        elif len(order) > FIRST * most:
            order = order[: FIRST * most]
            least[q] = max(1, bounds[order[-1]])
        pools[q] = [(bounds[order], ids[order], null[order], marks[order])]

    wide = max(8, CELLS // max(1, len(asked.weights)) // 8 * 8)
    for ids, marks, lengths, data in (row for b in batches for row in zip(*b.columns, strict=True)):
        n = lengths.values.to_numpy()
        null = np.asarray(ids.values.is_null())
        ids, marks = ids.values.fill_null(LAST).to_numpy(zero_copy_only=False), np.array(marks.values.to_pylist(), dtype=object)
        m = np.array([50 + (50 * x * docs) // all_terms for x in n.tolist()], np.int64)
        table = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, -(-len(n) // 8))
        for a in range(0, len(n), wide):
            few = slice(a, min(a + wide, len(n)))
            bounds = asked.bounds(table[:, a // 8 : -(-few.stop // 8)], m[few], n[few])
            on = bounds >= least[:, None]
            if by_floor:
                on &= (bounds > least[:, None]) | (ids[few] <= last[:, None])
            q, d = np.nonzero(on)
            starts = np.searchsorted(q, np.arange(count + 1))
            for k in np.unique(q).tolist():
                at = d[starts[k] : starts[k + 1]]
                pools[k].append((bounds[k, at], ids[few][at], null[few][at], marks[few][at]))
                if sum(len(p[0]) for p in pools[k]) > 8 * FIRST * most and (not by_floor or len(pools[k]) > 64):
                    shrink(k)
    for k in range(count):
        if pools[k]:
            shrink(k)
    rows = [(k, *p[0]) for k, p in enumerate(pools) if p]
    none = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([none, *[np.full(len(r[1]), r[0]) for r in rows]])),
        pa.array(np.concatenate([none, *[r[2] for r in rows]]), mask=np.concatenate([none.astype(bool), *[r[3] for r in rows]])),
        pa.array([x for r in rows for x in r[4]], pa.binary()), pa.array(np.concatenate([none, *[r[1] for r in rows]])),
    ], names=["number", "doc_id", "mark", "bound"])


def candidates(index: Index, asked: Asked, most: int) -> DataFrame:
    """``found_documents`` of every block of the index, as a table; the blocks are read where they are."""
    n_docs, n_terms = index.docs, index.terms

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield found_documents(batches, asked, n_docs, n_terms, most)

    blocks = index.rows.where("block IS NOT NULL").select("ids", "marks", "lengths", "slices")
    return cut(blocks.mapInArrow(found, "number long, doc_id long, mark binary, bound long"), "found")


def exact_scores(index: Index, docs: DataFrame, asked: Asked, found: DataFrame, text_col: str) -> DataFrame:
    """``found`` with the exact score of each row, as a table: the texts that it names are read whole, and scored where they are read."""
    wanted = cut(found.groupBy("mark").agg(F.sort_array(F.collect_set("number")).alias("numbers")), "wanted")  # at most a block of queries
    size = wanted.agg(F.count("*").alias("n"), F.sum(F.size("numbers")).alias("of")).first()
    if size["n"] * 64 + (size["of"] or 0) * 8 <= SENT_BYTES:
        wanted = F.broadcast(wanted)
    n_docs, n_terms = index.docs, index.terms

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            numbers, marks, scores = [], [], []
            for m, data, own in zip(*[c.to_pylist() for c in b.columns], strict=True):
                numbers += own
                marks += [m] * len(own)
                scores += asked.scores(data, own, n_docs, n_terms)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(marks, pa.binary()), pa.array(scores, pa.int64())], names=["number", "mark", "score"])

    texts = docs.select(mark(F.col(text_col)).alias("mark"), F.col(text_col).cast("binary").alias("whole")).join(wanted, "mark").select("mark", "whole", "numbers")
    scores = texts.mapInArrow(scored, "number long, mark binary, score long").distinct()  # copies are scored each
    return cut(found.select("number", "doc_id", "mark").join(scores, ["number", "mark"]).where("score > 0"), "scores")


def ranked_search(
    docs: DataFrame, items: DataFrame, most: int = 50, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_terms: int = QUERY_TERMS,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``most`` best documents of each item. ``index``: of ``docs``, if it was built before."""
    own = query_terms(items, item_text)
    if index is None:
        distinct = own.select("term").distinct()
        few = distinct.limit(ASKED_TERMS + 1).count() <= ASKED_TERMS
        index = build_index(docs, id_col, text_col, frozenset(r.term.encode() for r in distinct.collect()) if few else None)
    queries = cut(weighted_queries(index, own, block_terms), "weighted")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "mark")
    by_bound = Window.partitionBy("number").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id"))
    best = None
    for part in sorted(r.part for r in queries.select("part").distinct().collect()):  # one number a block of queries
        rows = queries.where(F.col("part") == part).collect()  # within ``block_terms``, or one item
        asked = Asked(rows)
        first = candidates(index, asked, most).withColumn("k", F.row_number().over(by_bound)).where(F.col("k") <= FIRST * most)
        ranked = exact_scores(index, docs, asked, first, text_col).withColumn("rank", F.row_number().over(order))
        floors = {asked.queries[r.number]: (r.score, r.doc_id) for r in ranked.where(F.col("rank") == most).collect()}  # a row a query
        asked = Asked(rows, floors)
        found = exact_scores(index, docs, asked, candidates(index, asked, most), text_col)
        names = docs.sparkSession.createDataFrame([(k, bytearray(q)) for k, q in enumerate(asked.queries)], "number long, query binary")
        mine = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).join(F.broadcast(names), "number").select("query", "rank", "doc_id", "score")
        best = mine if best is None else best.unionByName(mine)
    asked_items = items.select(F.col(item_id).alias("item_id"), mark(F.col(item_text)).alias("query"))
    if best is None:
        best = asked_items.limit(0).select("query", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return asked_items.join(best, "query").select("item_id", "rank", "doc_id", "score")
