"""Token ids of whole texts, with ids remembered for each stretch between safe cuts.

The pre-tokenizers of both vocabularies always cut where white space begins after other text and
where ASCII punctuation follows a letter. The ids of a text are therefore the ids of the stretches
between these places, joined. The distinct stretches of a batch go through the tokenizer once, and
a worker remembers a bounded number of bytes of them. Texts with white space outside ASCII, where
runs of both kinds could meet, go through the tokenizer whole. Spark's tasks are the parallel part:
a worker's tokenizer runs in one thread, so it keeps no thread's memory beside the task's.
"""

from __future__ import annotations

import ctypes
import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that a worker's remembered stretches may take; beyond that, new ones are encoded for their batch only.
REMEMBERED_BYTES = 24 << 20
#: Bytes that a remembered stretch takes besides its own: its object, its number, its place in the table and its ids.
ENTRY_BYTES = 180
#: Bytes of text that are looked at, and that are encoded, at a time.
BATCH_BYTES, ENCODED_BYTES = 2 << 20, 1 << 20
#: Stretches in one call's text.
JOINED = 2000

_SPACE, _PUNCT, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # read at the first call
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # their strings in a text are ordinary text
    return made


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places in the UTF-8 bytes where a stretch begins; ``starts``: of the texts (none is empty)."""
    space, letter = _SPACE[data], _LETTER[data]
    # Two-byte characters from U+00C0 to U+024F are letters but for the signs U+00D7 and U+00F7.
    lead = (data[:-1] >= 0xC3) & (data[:-1] <= 0xC9)
    letter[1:] |= lead & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    begin = np.zeros(len(data), bool)
    begin[1:] = (space[1:] & ~space[:-1]) | (_PUNCT[data[1:]] & letter[:-1])
    begin[starts] = True
    return np.flatnonzero(begin)


def odd_texts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Texts (by number) with white space outside ASCII: U+0085, U+00A0, U+1680, U+2000-200A, U+2028-2029, U+202F, U+205F, U+3000."""
    if not (data >= 0x80).any():
        return np.zeros(0, np.int64)
    a = data
    b, c = np.append(data[1:], 0), np.append(data[2:], [0, 0])
    odd = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    if (wide := np.isin(a, np.array([0xE1, 0xE2, 0xE3], np.uint8))).any():
        odd |= wide & (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        odd |= wide & (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        odd |= wide & (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        odd |= wide & (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return np.unique(np.searchsorted(starts, np.flatnonzero(odd), side="right") - 1)


class Encoder:
    """Encodes batches of texts to (all ids one after another, ids of each text)."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = any(t.endswith("</w>") for t in vocabulary)
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for t, i in vocabulary.items():
            self.token_bytes[i] = len(t.removesuffix("</w>")) if self.ends else len(t)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        # Ids of the remembered stretches one after another, and where each begins.
        self.flat, self.first = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)

    def _alone(self, units: list[bytes]) -> list[np.ndarray]:
        # A call's encodings hold many times the bytes of its text, so each goes before the next is made.
        return [np.array(self.tokenizer.encode_batch_fast([u.decode()], add_special_tokens=False)[0].ids, np.uint32) for u in units]

    def _normal(self, unit: bytes) -> int:
        """Bytes that the tokens of a stretch cover."""
        return len(unicodedata.normalize("NFC", unit.decode()).strip().lower().encode()) if self.ends else len(unit)

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, ids of each stretch). Those that begin with white space are joined to longer texts for fewer calls."""
        join = [i for i, u in enumerate(units) if u[0] in b" \n" and not u.isspace()]
        rest = sorted(set(range(len(units))) - set(join))
        made: list[tuple[list[int], np.ndarray, np.ndarray]] = []  # stretches, their ids, ids of each
        for g in (join[i : i + JOINED] for i in range(0, len(join), JOINED)):
            ids = self._alone([b"".join([units[i] for i in g])])[0]
            ends = np.cumsum(self.token_bytes[ids])
            want = np.cumsum([self._normal(units[i]) for i in g])
            at = np.searchsorted(ends, want)
            if len(ids) and ends[-1] == want[-1] and (ends[np.minimum(at, len(ends) - 1)] == want).all():
                made.append((g, ids, np.diff(np.concatenate([[0], at[:-1] + 1, [len(ids)]]))))
            else:
                rest += g
        alone = self._alone([units[i] for i in rest])
        made.append((rest, np.concatenate([np.zeros(0, np.uint32), *alone]), np.array([len(x) for x in alone], np.int64)))
        order, raw, own = (np.concatenate([np.asarray(m[k], np.int64 if k != 1 else np.uint32) for m in made]) for k in range(3))
        counts, first = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        counts[order], first[order] = own, np.cumsum(own) - own
        ends = np.cumsum(counts)
        return raw[np.repeat(first - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], counts

    def _remember(self, units: list[bytes], made: np.ndarray, counts: np.ndarray) -> None:
        """Keeps the first of the stretches for which there is room."""
        held = self.held + np.cumsum([ENTRY_BYTES + len(u) for u in units])
        room = int(np.searchsorted(held, REMEMBERED_BYTES, side="right"))
        if not room:
            return
        self.held = int(held[room - 1])
        n, sizes = len(self.known), counts[:room]
        used, bounds = int(self.first[n]), self.first[n] + np.cumsum(sizes)
        if bounds[-1] > len(self.flat):
            self.flat = np.append(self.flat[:used], np.zeros(int(bounds[-1]) * 5 // 4 - used, np.uint32))
        if n + room >= len(self.first):
            self.first = np.append(self.first[: n + 1], np.zeros((n + room) * 5 // 4 - n, np.int64))
        self.flat[used : bounds[-1]] = made[: int(sizes.sum())]
        self.first[n + 1 : n + room + 1] = bounds
        self.known.update(zip(units[:room], range(n, n + room), strict=True))

    def _numbers(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, first, count) for the stretches in order."""
        get, n = self.known.get, len(self.known)
        at = np.array([get(u, -1) for u in units], np.int64)
        old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        first, count = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        first[old] = self.first[at[old]]
        count[old] = self.first[at[old] + 1] - first[old]
        flat = self.flat[: self.first[n]]
        if len(new):
            own = [units[i] for i in new]
            made, counts = self._encode_units(own)
            count[new] = counts
            first[new] = len(flat) + np.cumsum(counts) - counts
            flat = np.concatenate([flat, made])
            self._remember(own, made, counts)
        return flat, first, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.zeros(len(texts), np.int64)
        some = np.flatnonzero(sizes)
        if not len(some):
            return np.zeros(0, np.uint32), counts
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        starts = (bounds[:-1] - bounds[0])[some]
        places = cuts(data, starts)
        spans = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(np.append(places, len(data)).astype(np.int32)), pa.py_buffer(data)])
        coded = spans.dictionary_encode()
        flat, first, count = self._numbers(coded.dictionary.to_pylist())
        unit = coded.indices.to_numpy()
        n = count[unit]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[unit] - (ends - n), n) + np.arange(ends[-1])]
        of = np.searchsorted(places, starts)  # first stretch of each text
        counts[some] = np.diff(np.append(ends[of] - n[of], ends[-1]))
        odd = odd_texts(data, starts)
        if len(odd):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            whole = some[odd]
            for i, x in zip(whole, self._alone([texts[int(i)].as_py() for i in whole]), strict=True):
                parts[i], counts[i] = x, len(x)
            ids = np.concatenate(parts)
        return ids, counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder: what it remembers serves the tasks that follow in the same process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tidy() -> None:
    """Gives freed memory back, so that workers that wait for the next task don't hold what the last one needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterable[pa.RecordBatch], text_col: int = 1, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut into parts of about ``most`` bytes of text. Operators that need no tokenizer let go of the worker's."""
    _ENCODERS.clear()
    tidy()
    yield from _parts(batches, text_col, most)
    tidy()


def _parts(batches: Iterable[pa.RecordBatch], text_col: int, most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(sizes), 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most)))
            yield b.slice(at, end - at)
            at = end


def encoded(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc ids, all ids, ids of each text) for parts of the batches (id, text)."""
    for b in _parts(batches, 1, ENCODED_BYTES):
        ids, counts = encoder(path).encode(b.column(1))
        yield b.column(0), ids, counts
    tidy()
