"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with each run of white space as one space. An item of n
characters may differ in e = floor(n * rate) edits. It is split into e + 1 pieces; where it occurs
with at most e edits, one piece at least occurs unchanged. One pass of an Aho-Corasick automaton
finds the pieces in a text; around each hit the item is verified with Myers' bit-parallel distance.

The items are a stated query set. They are taken in blocks of at most ``BLOCK_BYTES`` characters;
each block is one pass over all texts. What one block finds or leaves is a table before the next one
begins, so a plan, a stage and a Python worker hold one block each, however large the benchmark is.

Items of fewer than ``LEAST`` characters may differ in nothing and must stand as words of their own:
neither end may cut a word, where each character of a script without spaces is a word.

Defined results: null and empty texts and items match nothing, nor do items of white space; equal items and repeated rows each give
their own matches; an empty table gives no matches. Only id and text columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from localmarkets.llm.encoding import slices
from localmarkets.shared import cut

RATE = 0.08
LEAST = 40
BLOCK_BYTES = 8 << 20
_SPACE = re.compile(r"\s+")
#: Thai, Lao, Myanmar, Khmer, kana and Han: written without spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def plain(text: str) -> str:
    return _SPACE.sub(" ", text.lower()).strip()


def _part_of_word(c: str) -> bool:
    return (c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M") and not _UNSPACED.match(c)


def parted(text: str, at: int) -> bool:
    """Whether no word goes on over this place of the text."""
    return not (0 < at < len(text) and _part_of_word(text[at - 1]) and _part_of_word(text[at]))


def split(item: str, errors: int) -> list[tuple[int, str]]:
    """(place, piece) of ``errors`` + 1 pieces that cover the item."""
    ends = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:z]) for a, z in zip(ends, ends[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(of: dict[str, int], n: int, text: str, most: int) -> tuple[int, int] | None:
    """(least distance, its first end) of the item to any part of ``text``; None if over ``most``. One addition over the bits of a column a character."""
    every, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = every, 0, n, (most + 1, 0)
    for at, c in enumerate(text):
        eq = of.get(c, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & every
        up, down = minus | ~(d | plus) & every, plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score < best[0]:
            best = (score, at + 1)
        up, down = (up << 1) & every, (down << 1) & every  # a match may begin anywhere
        plus, minus = down | ~(d | up) & every, up & d
    return best if best[0] <= most else None


class Matcher:
    """Items of one block: (id, plain text)."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(len(t) * rate) if len(t) >= LEAST else 0, masks(t)) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, errors, _) in enumerate(self.items):
            for at, piece in split(t, errors):
                pieces.setdefault(piece, []).append((k, at))
        for piece, of in pieces.items():
            self.automaton.add_word(piece, (len(piece), of))
        if pieces:
            self.automaton.make_automaton()

    def match(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item id, least distance, end in the plain text) of each item that occurs."""
        if not self.items or not text:
            return
        text, places = plain(text), {}
        for end, (n, of) in self.automaton.iter(text):
            for k, at in of:
                places.setdefault(k, []).append(end + 1 - n - at)
        for k, begins in places.items():
            item, own, errors, bits = self.items[k]
            if len(own) < LEAST:  # the one piece is the item
                if (begin := next((b for b in begins if parted(text, b) and parted(text, b + len(own))), None)) is not None:
                    yield item, 0, begin + len(own)
                continue
            best, seen = None, -len(own) - 1  # a text may begin inside the item: begins can be negative
            for begin in sorted(set(begins)):
                if begin <= seen:  # the last window reaches over this one
                    continue
                # Windows for all beginnings up to this one and ``errors`` more are joined.
                seen = begin + errors
                a = max(0, begin - errors)
                found = myers(bits, len(own), text[a : seen + len(own) + errors], errors)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], a + found[1])
                if best and best[0] == 0:
                    break
            if best:
                yield item, best[0], best[1]


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, block by block; the driver holds one block."""
    held, size = [], 0
    for r in items.select(id_col, text_col).where(F.length(text_col) > 0).toLocalIterator():
        if own := plain(r[1]):
            held.append((r[0], own))
            size += len(own)
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, distance, end: each document and item that occurs in it within the item's edits."""
    schema = "doc_id long, item_id long, distance int, match_end long"
    out, last = docs.sparkSession.createDataFrame([], schema), None
    for block in blocks(items, item_col, "text"):
        if last is not None:
            out = out.unionByName(cut(last, "matches"))

        def matched(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for b in slices(batches):
                rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for m in matcher.match(t)]
                if rows:
                    d, i, n, end = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(n, pa.int32()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "distance", "match_end"])

        last = docs.select(id_col, text_col).mapInArrow(matched, schema)
    return out if last is None else out.unionByName(last)


def keep_clean(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they were, in which no item occurs."""
    place, given = docs.columns.index(text_col), docs
    for block in blocks(items, "item_id", "text"):
        if docs is not given:
            docs = cut(docs, "clean")

        def chosen(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for b in slices(batches, place):
                yield b.filter(pa.array([next(matcher.match(t or ""), None) is None for t in b.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(chosen, docs.schema)
    return docs
