"""Language of texts by a bidirectional gated recurrent network over bytes, trained in numpy.

The bytes of a text are read in windows; one network reads each window forwards, one backwards, and
the two states at a place give the probabilities of that byte's language. A window is read from
``WARM`` bytes before its first to ``WARM`` bytes after its last place, so that the states that label
its places have seen what is around them. A document's probabilities are the mean of the logarithms
over all its places, so every byte of the whole text counts once. Training is backpropagation through
time with Adam over stretches of labelled texts.

Bounds: at most ``rows`` labelled rows that have a letter, chosen by a hash and as many of each label, are
used for training, their texts whole and of at most ``SAMPLE_BYTES``; each step draws stretches of ``SPAN``
bytes from anywhere in them. Labelling covers whole texts.

Defined results: texts that are null or have no letter give ``und`` with score 0; rows without a
label are not learned from; without any labelled row every text gives ``und``; repeated rows are
labelled alike; an empty table gives an empty result. Only id, text and label columns are read, the
label for training only and the id for nothing but the output and the choice of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from localmarkets.llm.encoding import slices

HIDDEN, SPAN, WINDOW, WARM, ROWS, STEPS, BATCH = 12, 64, 256, 8, 3000, 150, 192
#: Bytes of the texts that are learned from.
SAMPLE_BYTES = 48 << 20
#: Windows that are read side by side.
SIDE = 1024


@dataclass
class Model:
    labels: list[str]
    weights: dict[str, np.ndarray]  # of both directions: f and b


def _start(rng: np.random.Generator, hidden: int, labels: int) -> dict[str, np.ndarray]:
    made = {}
    for d in "fb":
        made[f"x{d}"] = rng.normal(0, 0.3, (3 * hidden, 256))  # update, reset, candidate of each byte
        made[f"g{d}"] = rng.normal(0, hidden**-0.5, (2 * hidden, hidden))
        made[f"c{d}"] = rng.normal(0, hidden**-0.5, (hidden, hidden))
    made |= {"o": rng.normal(0, 0.3, (labels, 2 * hidden)), "ob": np.zeros((labels, 1))}
    return {k: v.astype(np.float32) for k, v in made.items()}


def _read(w: dict[str, np.ndarray], d: str, data: np.ndarray, kept: list | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
    """States (place, hidden, row) of one direction; data: (place, row) bytes. Rows lie along the last axis, so that each operation runs over long stretches of memory. Past a row's size the backward state stays zero."""
    places, rows = data.shape
    hidden = len(w[f"c{d}"])
    x_, g_, c_ = w[f"x{d}"], w[f"g{d}"], w[f"c{d}"]
    out = np.empty((places, hidden, rows), x_.dtype)
    h = np.zeros((hidden, rows), x_.dtype)
    for t in range(places) if d == "f" else range(places - 1, -1, -1):
        x = x_[:, data[t]]
        gates = g_ @ h
        gates += x[: 2 * hidden]
        gates *= 0.5  # the logistic function by tanh
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:hidden], gates[hidden:]
        c = c_ @ (r * h)
        c += x[2 * hidden :]
        np.tanh(c, out=c)
        if kept is not None:
            kept.append((t, h, z, r, c))
        step = c - h
        step *= z
        h = np.add(h, step, out=out[t])
        if sizes is not None and d == "b":
            h *= t < sizes
    return out


def _back(w: dict[str, np.ndarray], d: str, data: np.ndarray, kept: list, upon: np.ndarray, grad: dict[str, np.ndarray]) -> None:
    """Adds the gradients of one direction; upon: (place, hidden, row) gradients of its states."""
    later = np.zeros_like(kept[0][1])
    codes = np.eye(256, dtype=later.dtype)
    for t, h, z, r, c in reversed(kept):
        later = later + upon[t]
        dc = later * z * (1 - c * c)
        dz = later * (c - h) * z * (1 - z)
        rh = w[f"c{d}"].T @ dc
        dr = rh * h * r * (1 - r)
        gates = np.concatenate([dz, dr])
        grad[f"c{d}"] += dc @ (r * h).T
        grad[f"g{d}"] += gates @ h.T
        grad[f"x{d}"] += np.concatenate([gates, dc]) @ codes[data[t]]
        later = later * (1 - z) + rh * r + w[f"g{d}"].T @ gates


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """Over the labels, which are the second axis."""
    x -= x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def loss_and_gradients(w: dict[str, np.ndarray], data: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all places of (place, row) bytes, each labelled as its row."""
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([_read(w, d, data, kept[d]) for d in "fb"], axis=1)
    logp = _log_softmax(w["o"] @ states + w["ob"])
    n, rows = data.size, np.arange(len(labels))
    upon = np.exp(logp)
    upon[:, labels, rows] -= 1
    upon /= n
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    grad["o"] = (upon @ states.transpose(0, 2, 1)).sum(axis=0)
    grad["ob"] = upon.sum(axis=(0, 2))[:, None]
    down = w["o"].T @ upon
    hidden = states.shape[1] // 2
    _back(w, "f", data, kept["f"], down[:, :hidden], grad)
    _back(w, "b", data, kept["b"], down[:, hidden:], grad)
    return float(-logp[:, labels, rows].sum() / n), grad


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = 5, rate: float = 0.02) -> Model | None:
    """From labelled texts that aren't empty; each label weighs the same, and each text of a label."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    w = _start(rng, hidden, len(names))
    texts = [t if len(t) >= SPAN else (t * (SPAN // len(t) + 1))[:SPAN] for t in texts]
    flat, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    own = np.array([names.index(v) for v in labels])
    of = [np.flatnonzero(own == i) for i in range(len(names))]
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(o, max(1, batch // len(names))) for o in of])
        at = begins[chosen] + rng.integers(0, sizes[chosen] - SPAN + 1)
        _, grad = loss_and_gradients(w, flat[at + np.arange(SPAN)[:, None]], own[chosen])
        now = rate * min(1.0, 2 * (1 - (step - 1) / steps))
        for k, g in grad.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(names, w)


def sample(docs: DataFrame, rows: int = ROWS, most_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> tuple[list[bytes], list[str]]:
    """Whole texts and labels of at most ``rows`` labelled rows that have a letter and ``most_bytes`` of their texts, dealt evenly to the labels, by the order of their hash.

    Every label is drawn from, whatever its share of all; but a text that alone is larger than its label's bytes is not.
    """
    known = docs.where(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.xxhash64(id_col, text_col, F.lit(11)).alias("o"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row a label
    if not counts:
        return [], []
    each, room = max(1, rows // len(counts)), most_bytes // len(counts)
    # A bound on the hash lets about a quarter more than ``each`` through before they are put in order.
    share = {label: min(1.0, (1.25 * each + 100) / n) for label, n in counts.items()}
    bounds = F.create_map(*[F.lit(x) for label, part in share.items() for x in (label, min((1 << 63) - 1, int((2 * part - 1) * (1 << 63))))])
    size = F.octet_length("text")
    order = Window.partitionBy("label").orderBy("o", "text")
    so_far = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    few = known.where((F.col("o") <= bounds[F.col("label")]) & (size <= room)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= each)
    found = few.withColumn("sum", so_far).where(F.col("sum") <= room).orderBy("o", "text").select("text", "label").collect()
    return [r.text.encode() for r in found], [r.label for r in found]


def label_places(model: Model, data: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Log-probabilities (place, label, row) for (place, row) bytes; those past a row's size mean nothing."""
    w = model.weights
    half = w["o"].shape[1] // 2
    return _log_softmax(w["o"][:, :half] @ _read(w, "f", data) + w["o"][:, half:] @ _read(w, "b", data, sizes=sizes) + w["ob"])


def document_probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    """(text, label): every place of every text is labelled; their log-probabilities are averaged."""
    sums = np.zeros((len(texts), len(model.labels)))
    lengths = np.array([len(t) for t in texts])
    n = -(-lengths // WINDOW)
    of = np.repeat(np.arange(len(texts)), n)
    at = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    own = np.minimum(WINDOW, lengths[of] - at)  # places that the window labels
    lead = np.minimum(WARM, at)
    size = np.minimum(own + lead + WARM, lengths[of] - at + lead)
    flat = np.frombuffer(b"".join(texts) + bytes(WINDOW + 2 * WARM), np.uint8)
    begin = np.repeat(np.cumsum(lengths) - lengths, n) + at - lead
    order = np.argsort(size, kind="stable")  # windows of like size side by side
    for i in range(0, len(order), SIDE):
        few = order[i : i + SIDE]
        place = np.arange(size[few].max())[:, None]
        logp = label_places(model, flat[begin[few] + place], None if size[few].min() == size[few].max() else size[few])
        logp *= ((place >= lead[few]) & (place < lead[few] + own[few]))[:, None, :]
        np.add.at(sums, of[few], logp.sum(axis=0).T)
    mean = sums / np.maximum(lengths, 1)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of each row."""

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            names, score = ["und"] * len(b), np.zeros(len(b))
            some = [(i, t.encode()) for i, (t, ok) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)) if ok and model]
            if some:
                p = document_probabilities(model, [t for _, t in some])
                for (i, _), own in zip(some, p, strict=True):
                    names[i], score[i] = model.labels[int(own.argmax())], own.max()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names), pa.array(score)], names=["id", "lang_pred", "score"])

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(id_col), F.col(text_col), letters.alias("letters")).mapInArrow(labelled, "id long, lang_pred string, score double")
