"""Suffix-array dedup: bytes covered by strings of ``SPAN`` bytes that an earlier document holds, too.

A string of SPAN bytes is dealt by its minimizer, the k-gram of least hash in it, so equal strings
meet however their documents are spread. Four passes over keyed groups:

1. each group of documents tells the hashes of its minimizers to their buckets, and how many distinct
   segments (neighbouring strings with one minimizer, as one piece of text) it would send for each;
2. a bucket answers which of them more than one document has, all others are done with, and which of
   these would bring more than ``CROWD`` segments together;
3. groups send the segments of these, each distinct segment once with its smallest document. Strings
   of a crowded minimizer go one by one to a bucket that the hash of the whole string names, so its
   different surroundings are spread over all buckets and equal strings still meet;
4. a bucket builds the suffix array of its segments and answers, for the strings of each segment,
   the smallest document that holds them; the groups remove what an earlier document holds.

The suffix array is sorted in two stages: suffixes smaller than their successors are sorted
directly, by SPAN bytes; the rest are induced by a scan of the buckets of first bytes in order, each
bucket one array operation. Adjacent common prefixes, up to SPAN bytes, then part equal strings from
others.

What a task holds follows the group and bucket sizes. A passage that a third of all documents share
is one entry a group in passes 1 and 3, not one a document; each of its strings is one entry a group.

Defined results: a null text is empty and keeps nothing; texts under SPAN bytes stay whole; rows of
the same id are one document for this purpose (no row of it loses to another) and each gives a row;
rows with a null id come after all others, so they lose to them, not to each other; an empty table
gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, GRAM = 50, 16
#: Text bytes of a group of documents, and text bytes for each bucket of minimizers.
GROUP_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20
#: Strings that are looked at in one array operation.
PART = 1 << 20
#: Segments of one minimizer, over all groups, beyond which its strings are spread.
CROWD = 1 << 15
LAST = np.iinfo(np.int64).max

_M1, _M2, _M3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words(data: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes at each place as a number; past the end there are zeros."""
    held = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(data), np.uint64)
    for r in range(min(8, len(data))):
        n = (len(data) - r + 7) // 8
        out[r::8] = held[r : r + 8 * n].view(f"{order}u8")
    return out


def minimizers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the minimizer of each string of SPAN bytes, hash of the k-gram at each place)."""
    w = words(data, "<")
    grams = len(data) - GRAM + 1
    h = w[:grams] * _M1
    second = w[GRAM - 8 : GRAM - 8 + grams] * _M2
    h ^= (second << np.uint64(31)) | (second >> np.uint64(33))
    h ^= h >> np.uint64(29)
    h *= _M3
    h ^= h >> np.uint64(32)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)  # of equal hashes the first
    width, have = SPAN - GRAM + 1, 1
    while 2 * have <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: have - width], key[width - have :])
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64), h


def string_hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hash of the SPAN bytes at each of the places."""
    w = np.append(words(data, "<"), np.zeros(SPAN, np.uint64))
    h = np.full(len(places), _M3, np.uint64)
    for at in [*range(0, SPAN - 8, 8), SPAN - 8]:
        h ^= w[places + at] * _M2
        h = ((h << np.uint64(27)) | (h >> np.uint64(37))) * _M1
    return h ^ (h >> np.uint64(32))


class Group:
    """Documents of a group in a fixed order, their bytes and what is computed from them."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        self.ids = table["id"].combine_chunks() if table.num_rows else pa.array([], pa.int64())
        self.doc = np.asarray(pc.fill_null(self.ids, int(LAST))).astype(np.int64)
        self.texts = [t or b"" for t in table["text"].to_pylist()]

    def strings(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first byte, bytes, first string, last string, hash) of the segments, part by part; places are in the part."""
        sizes = np.array([len(t) for t in self.texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(self.texts), np.uint8)
        at, docs = 0, len(sizes)
        while at < docs:  # parts of whole documents, or a part of one long document
            end = max(at + 1, int(np.searchsorted(begins, begins[at] + PART)))
            low, high = int(begins[at]), int(begins[end - 1] + sizes[end - 1])
            for a in range(low, high, PART) if end == at + 1 else [low]:
                z = min(high, a + PART + SPAN - 1) if end == at + 1 else high
                if z - a >= SPAN:
                    yield a, *self._segments(flat[a:z], begins[at:end] - a, sizes[at:end])
            at = end

    @staticmethod
    def _segments(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        least, h = minimizers(data)
        # Strings that lie in one document: their last byte comes before the next document.
        owner = np.searchsorted(begins, np.arange(len(least)), side="right") - 1
        inside = np.arange(len(least)) + SPAN <= (begins + sizes)[owner]
        place = np.flatnonzero(inside)
        if not len(place):
            return data, place, place, np.zeros(0, np.uint64)
        m = least[place]
        new = np.flatnonzero((np.diff(m) != 0) | (np.diff(place) != 1) | (np.diff(owner[place]) != 0)) + 1
        first = np.concatenate([[0], new])
        last = np.append(new, len(place)) - 1
        return data, place[first], place[last], h[m[first]]

    def owner(self, places: np.ndarray) -> np.ndarray:
        """Document (by number) of each byte place."""
        sizes = np.array([len(t) for t in self.texts], np.int64)
        some = np.flatnonzero(sizes)
        return some[np.searchsorted((np.cumsum(sizes) - sizes)[some], places, side="right") - 1]


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h % np.uint64(buckets)).astype(np.int64)


def told(group: Group, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, hash, mark) by bucket. Mark: twice the exponent of a power of two that the distinct segments don't exceed, one more where two documents of the group have it."""
    hashes, docs, kinds = [], [], []
    for a, data, first, last, h in group.strings():
        hashes.append(h)
        docs.append(group.doc[group.owner(a + first)])
        kinds.append(string_hashes(data, first) ^ (string_hashes(data, last) * _M3))
    h, doc, kind = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *docs]), np.concatenate([np.zeros(0, np.uint64), *kinds])
    order = np.lexsort((kind, h))
    h, doc, kind = h[order], doc[order], kind[order]
    fresh = np.append([True], h[1:] != h[:-1])[: len(h)]
    start = np.flatnonzero(fresh)
    if not len(start):
        return start, h, np.zeros(0, np.uint8)
    many = np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start)
    segments = np.add.reduceat(fresh | np.append([True], kind[1:] != kind[:-1]), start, dtype=np.int64)
    mark = (2 * np.ceil(np.log2(segments)) + many).astype(np.uint8)
    h = h[start]
    bucket = _buckets(h, buckets)
    order = np.argsort(bucket, kind="stable")
    return bucket[order], h[order], mark[order]


def distinct_segments(group: Group, shared: np.ndarray, crowded: np.ndarray, buckets: int) -> tuple[dict, np.ndarray, np.ndarray]:
    """The segments with a shared minimizer: (text -> number, bucket of each number, and of each occurrence (number, first byte, document) as rows).

    ``shared``: hashes in their order; ``crowded``: of which of them each string is a segment of its own.
    """
    numbers: dict[bytes, int] = {}
    bucket: list[np.ndarray] = []
    seen: list[np.ndarray] = []
    for a, data, first, last, h in group.strings():
        at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
        own = np.flatnonzero(shared[at] == h) if len(shared) else np.zeros(0, np.int64)
        if not len(own):
            continue
        alone = crowded[at[own]]
        whole, part = own[~alone], own[alone]
        n = last[part] - first[part] + 1
        strings = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        begin, end = np.concatenate([first[whole], strings]), np.concatenate([last[whole], strings])
        dealt = np.concatenate([_buckets(h[whole], buckets), _buckets(string_hashes(data, strings), buckets)])
        raw, before = data.tobytes(), len(numbers)
        number = np.array([numbers.setdefault(raw[s : e + SPAN], len(numbers)) for s, e in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)
        _, place = np.unique(number, return_index=True)
        bucket.append(dealt[place[number[place] >= before]])
        seen.append(np.column_stack([number, a + begin, group.owner(a + begin)]))
    return numbers, np.concatenate([np.zeros(0, np.int64), *bucket]), np.concatenate([np.zeros((0, 3), np.int64), *seen])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first SPAN bytes, by two-stage sorting."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # A suffix is smaller than its successor if the first byte that differs from its follower is smaller.
    turns = np.append(np.flatnonzero(text[:-1] != text[1:]), n - 1)
    rises = np.append(text[turns[:-1]] < text[turns[:-1] + 1], False)
    small = rises[np.searchsorted(turns, np.arange(n))]
    direct = sorted_directly(text, np.flatnonzero(small))
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    arrived: list[list[np.ndarray]] = [[] for _ in range(256)]
    arrived[text[n - 1]].append(np.array([n - 1]))  # its successor is the empty suffix, which comes first
    out = []
    for c in np.unique(text).tolist():
        layer = np.concatenate(arrived[c]) if arrived[c] else np.zeros(0, np.int64)
        layers = []
        while len(layer):  # predecessors with the same byte follow in the same bucket
            layers.append(layer)
            before = layer[layer > 0] - 1
            layer = before[(text[before] == c) & ~small[before]]
        bucket = np.concatenate([*layers, direct[bounds[c] : bounds[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~small[before] & (text[before] > c)]
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        start = np.flatnonzero(np.append([True], byte[1:] != byte[:-1])[: len(byte)])
        for s, part in zip(start, np.split(before, start[1:]), strict=True) if len(start) else ():
            arrived[byte[s]].append(part)
    return np.concatenate(out)


def sorted_directly(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places in the order of the SPAN bytes there: by eight bytes, then those still equal by the next eight."""
    w = np.append(words(text, ">"), np.zeros(SPAN + 8, np.uint64))
    order = np.argsort(w[places], kind="stable")
    places = places[order]
    key = w[places]
    new = np.append([True], key[1:] != key[:-1])[: len(places)]
    for at in range(8, SPAN, 8):
        tied = np.flatnonzero(~new | np.append(~new[1:], False)[: len(new)])
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        key = w[places[tied] + at]
        if SPAN - at < 8:
            key = key >> np.uint64(8 * (8 - SPAN + at))
        order = np.lexsort((key, group))
        places[tied] = places[tied][order]
        key = key[order]
        new[tied[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    return places


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal bytes, SPAN at most, from the places a and b on."""
    w = np.append(words(text, ">"), np.zeros(SPAN + 8, np.uint64))
    out = np.zeros(len(a), np.int64)
    still = np.arange(len(a))
    for at in range(0, SPAN, 8):
        x = w[a[still] + at] ^ w[b[still] + at]
        same = x == 0
        lead = 8 - (np.frexp(x[~same].astype(np.float64))[1] + 7) // 8  # whole bytes above the highest bit that differs
        out[still[~same]] = at + np.maximum(lead, 0)
        still = still[same]
    out[still] = SPAN
    return np.minimum(out, SPAN)


def least_documents(texts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the strings of each text one after another (a text of n bytes has n - SPAN + 1): the smallest document that holds the string. And where each text's strings begin."""
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.frombuffer(b"".join(texts), np.uint8)
    n = sizes - SPAN + 1
    begins, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(texts)), n)
    first = np.cumsum(n) - n
    place = np.arange(len(owner)) - first[owner] + begins[owner]
    number = np.full(len(text), -1, np.int64)  # of the string that begins at a place
    number[place] = np.arange(len(place))
    order = suffix_array(text)
    order = order[number[order] >= 0]
    starts = np.flatnonzero(np.append([True], common_prefixes(text, order[:-1], order[1:]) < SPAN))
    string = number[order]
    least = np.minimum.reduceat(docs[owner[string]], starts)
    out = np.empty(len(place), np.int64)
    out[string] = np.repeat(least, np.diff(np.append(starts, len(order))))
    return out, first


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, spans (removed runs: start, end), kept (the other bytes)."""
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    groups, buckets = max(1, -(-total // group_bytes)), max(1, -(-total // bucket_bytes))
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(groups)).alias("g"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )
    by_group = rows.groupBy("g")

    def tell(key: tuple, table: pa.Table) -> pa.Table:
        b, h, mark = told(Group(table), buckets)
        cut = np.flatnonzero(np.append([True], b[1:] != b[:-1])[: len(b)])
        parts = list(zip(cut, np.append(cut[1:], len(b)), strict=True)) if len(cut) else []
        return pa.table({"b": pa.array(b[cut], pa.int64()), "g": pa.array([key[0].as_py()] * len(parts), pa.int64()), "hashes": pa.array([_blob(h[a:z]) for a, z in parts], pa.binary()), "marks": pa.array([_blob(mark[a:z]) for a, z in parts], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        mark = np.concatenate([np.frombuffer(x, np.uint8) for x in table["marks"].to_pylist()])
        value, where, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        shared = n > 1
        shared[where[mark & 1 == 1]] = True
        crowded = np.bincount(where, weights=np.exp2(mark >> 1), minlength=len(value)) > crowd
        ends = np.cumsum([len(h) for h in hashes])[:-1]
        out = []
        for g, h, mine, many in zip(table["g"].to_pylist(), hashes, np.split(shared[where], ends), np.split(crowded[where], ends), strict=True):
            if mine.any():
                out.append((g, _blob(h[mine]), _blob(many[mine])))
        return pa.table({"g": pa.array([x[0] for x in out], pa.int64()), "hashes": pa.array([x[1] for x in out], pa.binary()), "crowded": pa.array([x[2] for x in out], pa.binary())})

    def shared_hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        h = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]])
        many = np.concatenate([np.zeros(0, bool), *[np.frombuffer(x, bool) for x in table["crowded"].to_pylist()]])
        order = np.argsort(h)
        return h[order], many[order]

    def send(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        group = Group(table)
        numbers, bucket, seen = distinct_segments(group, *shared_hashes(known), buckets)
        low, high = np.full(len(numbers), LAST), np.full(len(numbers), np.iinfo(np.int64).min)
        np.minimum.at(low, seen[:, 0], group.doc[seen[:, 2]])
        np.maximum.at(high, seen[:, 0], group.doc[seen[:, 2]])
        texts, packer = list(numbers), zstandard.ZstdCompressor(level=3)  # neighbouring segments overlap
        out: dict[str, list] = {"b": [], "low": [], "high": [], "sizes": [], "texts": [], "numbers": []}
        order = np.argsort(bucket, kind="stable")
        for few in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
            own = [texts[i] for i in few]
            for k, v in (("b", int(bucket[few[0]])), ("low", _blob(low[few])), ("high", _blob(high[few])), ("sizes", _blob(np.array([len(t) for t in own], np.int32))), ("texts", packer.compress(b"".join(own))), ("numbers", _blob(few.astype(np.int32)))):
                out[k].append(v)
        return pa.table({"b": pa.array(out["b"], pa.int64()), "g": pa.array([key[0].as_py()] * len(out["b"]), pa.int64()), **{k: pa.array(out[k], pa.binary()) for k in ("low", "high", "sizes", "texts", "numbers")}})

    def sort(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        docs_: list[int] = []
        mine = []
        unpacker = zstandard.ZstdDecompressor()
        for low, sizes, packed in zip(table["low"].to_pylist(), table["sizes"].to_pylist(), table["texts"].to_pylist(), strict=True):
            texts = unpacker.decompress(packed)
            ends = np.cumsum(np.frombuffer(sizes, np.int32).astype(np.int64)).tolist()
            own = []
            for a, z, doc in zip([0, *ends[:-1]], ends, np.frombuffer(low, np.int64).tolist(), strict=True):
                k = number.setdefault(texts[a:z], len(docs_))
                if k == len(docs_):
                    docs_.append(doc)
                elif doc < docs_[k]:
                    docs_[k] = doc
                own.append(k)
            mine.append(np.array(own, np.int64))
        least, first = least_documents(list(number), np.array(docs_, np.int64))
        # Runs of strings of a segment with one smallest document.
        change = np.append([True], least[1:] != least[:-1])
        change[first] = True
        run = np.flatnonzero(change)
        of = np.searchsorted(first, run, side="right") - 1
        begin = run - first[of]
        end = np.append(run[1:], len(least)) - first[of]
        value, at = least[run], np.searchsorted(of, np.arange(len(first) + 1))
        out: dict[str, list] = {"g": [], "segment": [], "begin": [], "end": [], "least": []}
        for g, own, high, numbers in zip(table["g"].to_pylist(), mine, table["high"].to_pylist(), table["numbers"].to_pylist(), strict=True):
            n = at[own + 1] - at[own]
            runs = np.repeat(at[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            who = np.repeat(np.arange(len(own)), n)
            use = value[runs] < np.frombuffer(high, np.int64)[who]
            if use.any():
                runs, who = runs[use], who[use]
                for k, v in (("g", g), ("segment", _blob(np.frombuffer(numbers, np.int32)[who])), ("begin", _blob(begin[runs].astype(np.int32))), ("end", _blob(end[runs].astype(np.int32))), ("least", _blob(value[runs]))):
                    out[k].append(v)
        return pa.table({"g": pa.array(out["g"], pa.int64()), **{k: pa.array(out[k], pa.binary()) for k in ("segment", "begin", "end", "least")}})

    def remove(table: pa.Table, known: pa.Table) -> pa.Table:
        """``known``: the group's shared hashes and the runs of its segments."""
        group = Group(table)
        hashes = known.filter(pc.is_valid(known["hashes"])).select(["hashes", "crowded"])
        runs = known.filter(pc.is_valid(known["segment"]))
        _, _, seen = distinct_segments(group, *shared_hashes(hashes), buckets)
        column = lambda name, kind: np.concatenate([np.zeros(0, kind), *[np.frombuffer(x, kind) for x in runs[name].to_pylist()]])
        segment, begin, end, least = column("segment", np.int32), column("begin", np.int32), column("end", np.int32), column("least", np.int64)
        order = np.argsort(segment, kind="stable")
        segment, begin, end, least = segment[order], begin[order].astype(np.int64), end[order].astype(np.int64), least[order]
        a, z = np.searchsorted(segment, seen[:, 0]), np.searchsorted(segment, seen[:, 0], side="right")
        n = z - a
        run = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place, doc = np.repeat(seen[:, 1], n), group.doc[np.repeat(seen[:, 2], n)]
        use = least[run] < doc
        run, place = run[use], place[use]
        total = sum(map(len, group.texts))
        steps = np.zeros(total + 1, np.int64)
        np.add.at(steps, place + begin[run], 1)
        np.add.at(steps, place + end[run] - 1 + SPAN, -1)
        gone = np.cumsum(steps)[:total] > 0
        at, spans, kept = 0, [], []
        for t in group.texts:
            own = np.concatenate([[False], gone[at : at + len(t)], [False]])
            edge = np.flatnonzero(own[1:] != own[:-1])
            spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
            kept.append(np.frombuffer(t, np.uint8)[~own[1:-1]].tobytes() if len(edge) else t)
            at += len(t)
        return pa.table({"id": group.ids, "n_bytes": pa.array([len(t) for t in group.texts], pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})

    asked = by_group.applyInArrow(tell, "b long, g long, hashes binary, marks binary")
    shared = asked.groupBy("b").applyInArrow(answer, "g long, hashes binary, crowded binary")
    sent = by_group.cogroup(shared.groupBy("g")).applyInArrow(send, "b long, g long, low binary, high binary, sizes binary, texts binary, numbers binary")
    runs = sent.groupBy("b").applyInArrow(sort, "g long, segment binary, begin binary, end binary, least binary")
    known = shared.unionByName(runs, allowMissingColumns=True)
    return by_group.cogroup(known.groupBy("g")).applyInArrow(remove, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
