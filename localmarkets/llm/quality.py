"""Compression classifier for quality.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is read in
windows; each is compressed with either dictionary, and the sizes add up to g and b over the whole
text of n bytes. The normalised difference (b - g) / n is the one feature; a logistic curve fitted to
other labelled rows turns it into a calibrated score between 0 and 1.

Bounds: the dictionaries and the curve are fitted on the whole texts of at most ``rows`` rows of each
label, chosen by a hash of the id. The curve weighs its rows so that either label has its share of
all labelled rows; the bound on rows leaves the scores' level as it is. Scoring covers whole texts.

Defined results: null and empty texts get the score of a text without evidence (the share of good
rows among all labelled rows); null labels are left out; a row that is labelled twice counts
twice; without a row of each label every score is 0.5; of too little text for a trained dictionary
the text itself is the dictionary; an empty table gives an empty result. Only the id and text
columns are read, and the id for nothing but the output and the choice of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from localmarkets.llm.encoding import slices
from localmarkets.llm.sampling import least_hashes

ROWS, WINDOW, DICTIONARY_BYTES, LEVEL = 1500, 2048, 110 << 10, 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float  # of the logistic curve over the difference
    constant: float
    prior: float
    window: int = WINDOW


class Sizes:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, model: Model):
        self.window, self.by = model.window, []
        for data in (model.good, model.bad):
            held = zstandard.ZstdCompressionDict(data)
            held.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False))

    def difference(self, text: bytes) -> float:
        """Bytes that the good dictionary saves over the bad one, for each byte of the text."""
        parts = [text[i : i + self.window] for i in range(0, len(text), self.window)]
        g, b = (sum(len(c.compress(p)) for p in parts) for c in self.by)
        return (b - g) / len(text)


def _curve(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(model: Model | None, sizes: Sizes | None, text: str | None) -> float:
    """Of one text; ``sizes``: the model's."""
    if model is None or sizes is None:
        return 0.5
    if not text:
        return model.prior
    return float(_curve(np.float64(model.slope * sizes.difference(text.encode()) + model.constant)))


def _counts(labels: DataFrame, label_col: str) -> dict[int, int]:
    """Labelled rows of each label: two rows at most."""
    return {int(r[0]): r[1] for r in labels.where(F.col(label_col).isin(0, 1)).groupBy(label_col).count().collect()}


def _sample(docs: DataFrame, labels: DataFrame, counts: dict[int, int], rows: int, id_col: str, text_col: str, label_col: str) -> list:
    """Whole texts of at most ``rows`` rows of each label, by the order of their hash."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    texts = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Ids first, so that only the chosen rows' texts meet their labels: 2 * rows rows at most are broadcast.
    ids = [least_hashes(known.where(F.col("label") == v), counts.get(v, 0), rows, F.xxhash64("id", F.lit(3)), "o") for v in (0, 1)]
    chosen = ids[0].unionByName(ids[1])
    return texts.join(F.broadcast(chosen), "id").select("label", "text", "o").orderBy("o", "text").collect()


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    counts = _counts(labels, label_col)
    sample = _sample(docs, labels, counts, rows, id_col, text_col, label_col)
    texts = {v: [r.text.encode() for r in sample if r.label == v] for v in (0, 1)}
    if not texts[0] or not texts[1]:
        return None
    return fit_texts(texts, counts[1] / (counts[0] + counts[1]))


def fit_texts(texts: dict[int, list[bytes]], share: float) -> Model:
    """Of texts by label; ``share``: of good rows among all labelled ones. Two thirds of either make its dictionary, the rest fits the curve."""
    made = {v: _dictionary(t[: max(1, 2 * len(t) // 3)]) for v, t in texts.items()}
    model = Model(made[1], made[0], 0.0, 0.0, share)
    sizes = Sizes(model)
    held = [(sizes.difference(t), v) for v, some in texts.items() for t in (some[2 * len(some) // 3 :] or some)]
    x, y = np.array([d for d, _ in held]), np.array([v for _, v in held], float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))  # one on average
    centre = np.average(x, weights=weight)
    scale = np.sqrt(np.average((x - centre) ** 2, weights=weight)) + 1e-9
    slope, constant = _logistic(((x - centre) / scale)[:, None], y, weight).tolist()
    model.slope, model.constant = slope / scale, constant - slope * centre / scale
    return model


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of very little text, the text itself."""
    parts = [t[i : i + WINDOW] for t in texts for i in range(0, len(t), WINDOW)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, parts)) // 4)), parts, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and constant by Newton's method with a ridge on the weights; ``weight``: of each row."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * (p * (1 - p) + 1e-9))[:, None]) + keep, x.T @ (weight * (p - y)) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of each row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model) if model else None
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(model, sizes, t) for t in b.column(1).to_pylist()], pa.float64())], names=["id", "score"])

    return docs.select(id_col, text_col).mapInArrow(scored, "id long, score double")


def fold(id_col: Column, folds: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def keep_good(docs: DataFrame, model: Model | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they were, whose text scores ``least`` or more."""
    place = docs.columns.index(text_col)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model) if model else None
        for b in slices(batches, place):
            yield b.filter(pa.array([model is None or score(model, sizes, t) >= least for t in b.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(chosen, docs.schema)
