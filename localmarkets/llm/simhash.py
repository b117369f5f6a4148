"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: 64 bits, each set when over half of a text's shingle hashes have it. Two fingerprints
that differ in at most ``most`` bits agree on at least two of ``most + 2`` blocks, so each distinct
fingerprint goes to one bucket for each pair of blocks and its values there. In a bucket the
fingerprints are sorted by Gray rank and laid into a tree: a node holds the bits that all below it
share and that no node above it holds yet; a search adds up the differences on its way down and
leaves a whole group when they pass ``most``. A group whose members can't differ in more bits than
that is linked as one. A bucket gives a spanning star of each of its components, not its pairs, and
equal fingerprints were joined to one row before: the edges are fewer than the rows of the buckets.

Defined results: null and empty texts have fingerprint zero; null ids take part in no link and have
a null component unless an equal fingerprint has an id; repeated rows share a component; an empty
table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from localmarkets.llm.encoding import slices
from localmarkets.operators.components import connected_components
from localmarkets.shared import cut

SEED = 42
#: Fingerprints of a leaf, and children of an inner node.
LEAF, FAN = 32, 8
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 16


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased (A-Z) text; fewer words make one shingle."""
    own = text.encode().lower().split()  # both are ASCII only for bytes
    joined = b" ".join(own)
    if len(own) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if own else [], np.uint64)
    lengths = np.array([len(w) for w in own], np.int64) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def bit_majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        few = hashes[at : at + COUNTED].astype("<u8")
        counts += np.unpackbits(few.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int) -> int:
    return bit_majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (a long with the fingerprint's bits)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t or "", words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(hashed, "id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    rank = fp.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


class GrayTree:
    """Index over fingerprints that are sorted by Gray rank."""

    def __init__(self, fps: np.ndarray):
        self.fps, n = fps, len(fps)
        starts = np.arange(0, n, LEAF)
        both, some = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)
        levels = [(starts, both, some)]
        while len(levels[-1][0]) > 1:
            first = np.arange(0, len(levels[-1][0]), FAN)
            levels.append((levels[-1][0][first], np.bitwise_and.reduceat(levels[-1][1], first), np.bitwise_or.reduceat(levels[-1][2], first)))
        self.levels = []  # from the root: first member, shared bits that are new here, their values, bits still open
        above = np.zeros(1, np.uint64)
        for depth, (starts, both, some) in enumerate(reversed(levels)):
            shared = ~(both ^ some)
            parent = above[np.arange(len(starts)) // FAN] if depth else above
            self.levels.append((starts, shared & ~parent, both, np.bitwise_count(~shared).astype(np.int64)))
            above = shared
        self.ends = [np.append(x[0][1:], n) for x in self.levels]
        self.left = ~above  # of each leaf: the bits that its members are told apart by

    def united(self, most: int) -> Iterator[np.ndarray]:
        """Edges (member, first member) of the groups whose members can't differ in more bits."""
        for (starts, _, _, open_), ends in zip(self.levels, self.ends, strict=True):
            for k in np.flatnonzero((open_ <= most) & (ends - starts > 1)):
                member = np.arange(starts[k] + 1, ends[k])
                yield np.column_stack([member, np.full(len(member), starts[k])])

    def search(self, queries: np.ndarray, most: int) -> np.ndarray:
        """Edges (query, member), queries by place: each member within ``most`` bits, one for a united group."""
        out = []
        q, node, far = queries, np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for depth, (starts, new, value, open_) in enumerate(self.levels):
            if depth:
                kids = node[:, None] * FAN + np.arange(FAN)
                ok = kids < len(starts)
                q, far, node = np.repeat(q, FAN)[ok.ravel()], np.repeat(far, FAN)[ok.ravel()], kids[ok]
            far = far + np.bitwise_count((self.fps[q] ^ value[node]) & new[node])
            whole = far + open_[node] <= most
            out.append(np.column_stack([q[whole], starts[node[whole]]]))
            go = (far <= most) & ~whole
            q, node, far = q[go], node[go], far[go]
        member = self.levels[-1][0][node][:, None] + np.arange(LEAF)
        ok = member < self.ends[-1][node][:, None]
        d = far[:, None] + np.bitwise_count((self.fps[q][:, None] ^ self.fps[np.minimum(member, len(self.fps) - 1)]) & self.left[node][:, None])
        i, j = np.nonzero(ok & (d <= most))
        out.append(np.column_stack([q[i], member[i, j]]))
        return np.concatenate(out)


def components(n: int, edges: np.ndarray) -> np.ndarray:
    """Smallest place in each place's component."""
    label = np.arange(n)
    edges = edges[edges[:, 0] != edges[:, 1]]
    while len(edges):
        a, b = label[edges[:, 0]], label[edges[:, 1]]
        if (a == b).all():
            break
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, nearer := label[label]):
            label = nearer
    return label


def bucket_edges(fps: np.ndarray, ids: np.ndarray, most: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): each id that links to another in the bucket, with the smallest of its component there."""
    order = np.argsort(gray_rank(fps), kind="stable")
    tree, edges = GrayTree(fps[order]), []
    edges += tree.united(most)
    label = np.arange(len(fps))
    for at in range(0, len(fps), block):  # joined as they come: what is held stays in proportion to the bucket
        found = tree.search(np.arange(at, min(at + block, len(fps))), most)
        label = components(len(fps), np.concatenate([np.column_stack([np.arange(len(fps)), label]), found, *edges]))
        edges = []
    own = ids[order]
    least = own.copy()
    np.minimum.at(least, label, own)
    v = least[label]
    return own[own != v], v[own != v]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fingerprints, ids) of each bucket, of rows that are sorted by bucket; single ones are left out."""
    held: list[np.ndarray] = []  # parts of the bucket that is not over yet, joined once

    def bucket(last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = np.concatenate([*held, last])
        held.clear()
        if len(rows) > 1:
            yield np.ascontiguousarray(rows[:, 2]).view(np.uint64), rows[:, 3]

    for b in batches:
        rows = np.column_stack([b.column(i).to_numpy() for i in range(4)])  # pair, values, fp, id
        if not len(rows):
            continue
        if held and (held[-1][-1, :2] != rows[0, :2]).any():
            yield from bucket(rows[:0])
        *whole, rest = np.split(rows, np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1)
        for own in whole:
            yield from bucket(own)
        held.append(rest)
    if held:
        yield from bucket(held[0][:0])


def _blocks(most: int) -> list[int]:
    """Masks that part the 64 bits into ``most + 2`` blocks."""
    ends = np.linspace(0, 64, most + 3).round().astype(int).tolist()
    return [((1 << (z - a)) - 1) << a for a, z in zip(ends, ends[1:], strict=False)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def link_edges(distinct: DataFrame, most: int = 4) -> DataFrame:
    """``distinct`` (fp, id) to edges (u, v) that span the components of fingerprints within ``most`` bits."""
    masks = [a | b for a, b in combinations(_blocks(most), 2)]
    keys = F.array(*[F.struct(F.lit(i).cast("long").alias("pair"), F.col("fp").bitwiseAND(_signed(m)).alias("values")) for i, m in enumerate(masks)])
    dealt = distinct.select(F.explode(keys).alias("k"), "fp", "id").select("k.pair", "k.values", "fp", "id")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps, ids in _runs(batches):
            u, v = bucket_edges(fps, ids, most)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt.repartition("pair", "values").sortWithinPartitions("pair", "values").mapInArrow(linked, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id."""
    marked = cut(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("id").alias("id"))
    found = connected_components(link_edges(distinct.where("id is not null"), most))
    classes = distinct.join(found, distinct["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marked.join(classes, "fp").select("id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the document with the smallest id, all columns as they were; rows with a null id stay.

    Rows that repeat a kept id stay, and so do the rows of an id that stands on unlike texts: ids
    tell documents apart, and no text may go for another's sake.
    """
    marked = near_duplicates(docs, words, most, id_col, text_col).groupBy("id")
    gone = marked.agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high"), F.min("component_id").alias("component")).where("low = high AND id <> component")
    return docs.join(gone, docs[id_col] == gone["id"], "left_anti")
