"""The training-data operators against brute force, exact round trips and held-out accuracy, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from compare import database, rows_of, sql_rows
from pyspark.sql import functions as F

from localmarkets import shared
from localmarkets.llm import chat, decontaminate, encoding, exact_dedup, language, near, packing, quality, queries, repeats, sampling, sharding, simhash, token_files
from localmarkets.shared import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, g string, fp string, part string"
A = "the quick brown fox jumps over the lazy dog and runs away from the very large bear in the wood "
ROWS = [
    (1, A * 3), (2, "Before it. " + A + "After."), (3, A * 3), (4, None), (5, ""), (6, "   "), (7, "short"), (8, "x" * 300), (9, "x" * 120), (10, A.replace(" ", "\n\t") * 3),
    (11, "é" * 60 + A), (12, "\x00" * 80), (13, "\x00" * 60 + "tail"), (13, "\x00" * 60 + "tail"), (None, A * 2), (None, None), (14, "<|endoftext|> don't  stop   here\n\n\nnow"), (15, "漢字　の テスト " * 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, "s", 0, 7, "h", "g", "fp", "p") for i, t in ROWS], DOCS)


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    assert rows_of(queries.QUERIES[name](spark, sf)) == sql_rows(database(sf), queries.SQL[name])


# --- 1 ---
def brute_repeats(rows):
    owner, out = {}, []
    order = lambda i: repeats.LAST if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            owner[s] = min(owner.get(s, repeats.LAST), order(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if owner[b[k : k + 50]] < order(i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def told_repeats(df, **options):
    rows = repeats.repeated_spans(df, **options).collect()
    return sorted(repr((r.id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())) for r in rows)


def test_repeats(docs, real):
    assert told_repeats(docs, group_bytes=200, bucket_bytes=300) == brute_repeats(ROWS)
    assert told_repeats(real) == brute_repeats(texts(real))
    for crowd in (0, 2):  # all, and only common minimizers' strings go their own ways
        assert told_repeats(docs, group_bytes=200, bucket_bytes=300, crowd=crowd) == brute_repeats(ROWS)
        assert told_repeats(real, group_bytes=50000, bucket_bytes=20000, crowd=crowd) == brute_repeats(texts(real))
    assert told_repeats(docs.limit(0)) == []


def test_repeats_with_one_passage_in_many_surroundings(spark):
    rng = np.random.default_rng(11)
    passage = "a passage that stands in very many documents between words that differ from one to the next"
    rows = [(None if k % 3 == 0 else k, "".join(rng.choice(list("abcdefg "), 60)) + passage + "".join(rng.choice(list("abcdefg "), 60))) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (0, 20, 1 << 15):
        assert told_repeats(df, group_bytes=2000, bucket_bytes=2000, crowd=crowd) == brute_repeats(rows)


def test_parts_of_a_long_document_hold_each_string_once(monkeypatch):
    rng = np.random.default_rng(2)
    texts_ = [rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in (1000, 30, 0, 49, 50, 400, 2000)]
    group = repeats.Group(pa.table({"id": pa.array(range(len(texts_)), pa.int64()), "text": pa.array(texts_, pa.binary())}))
    want = sorted((i, k) for i, t in enumerate(texts_) for k in range(len(t) - 49))
    begins = np.cumsum([0, *map(len, texts_)])
    for part in (1 << 20, 300, 64):
        monkeypatch.setattr(repeats, "PART", part)
        got = []
        for a, data, first, last, h in group.strings():
            for s, e in zip(first.tolist(), last.tolist(), strict=True):
                for k in range(s, e + 1):
                    of = int(np.searchsorted(begins, a + k, side="right") - 1)
                    assert data[k : k + 50].tobytes() == texts_[of][a + k - begins[of] : a + k - begins[of] + 50]
                    got.append((of, int(a + k - begins[of])))
        assert sorted(got) == want
        numbers, bucket, seen = repeats.distinct_segments(group, np.zeros(0, np.uint64), np.zeros(0, bool), 5)
        assert not numbers and not len(bucket) and not len(seen)


def test_suffix_array_order():
    rng = np.random.default_rng(3)
    for _ in range(60):
        text = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 300)).astype(np.uint8)
        order, b = repeats.suffix_array(text), text.tobytes()
        assert sorted(order.tolist()) == list(range(len(text)))
        whole = [i for i in order if i + repeats.SPAN <= len(b)]
        strings = [b[i : i + repeats.SPAN] for i in whole]
        assert strings == sorted(strings)
        lengths = repeats.common_prefixes(text, np.array(whole[:-1], int), np.array(whole[1:], int))
        assert lengths.tolist() == [len(os.path.commonprefix([x, y])) for x, y in zip(strings, strings[1:], strict=False)]


# --- 2 ---
def brute_simhash(rows, words=4, most=4):
    def fingerprint(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        own = re.findall("[^\x20\x09-\x0d]+", low)
        shingles = [" ".join(own[i : i + words]) for i in range(len(own) - words + 1)] or ([" ".join(own)] if own else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    known = {}
    for i, t in rows:
        f = fingerprint(t)
        known[f] = min(x for x in (known.get(f), i) if x is not None) if (known.get(f) is not None or i is not None) else None
    fps = [f for f, i in known.items() if i is not None]
    group = {f: {f} for f in known}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= most and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    least = {f: min((known[x] for x in group[f] if known[x] is not None), default=None) for f in known}
    return sorted(repr((i, f"{fingerprint(t):016x}", least[fingerprint(t)])) for i, t in rows)


def test_simhash(docs, real):
    told = lambda df: sorted(repr((r.id, r.fingerprint, r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert told(docs) == brute_simhash(ROWS)
    assert told(real) == brute_simhash(texts(real))
    assert told(docs.limit(0)) == []


def test_gray_tree_finds_all():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([centres ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(30)]))
    ids = rng.permutation(len(fps)).astype(np.int64)
    u, v = simhash.bucket_edges(fps, ids, 4, block=100)
    label = {int(i): int(i) for i in ids} | {int(a): int(b) for a, b in zip(u, v, strict=True)}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    edges = np.argwhere(near)
    whole = simhash.components(len(fps), edges)
    for c in np.unique(whole):
        assert len({label[int(i)] for i in ids[whole == c]}) == 1
    assert len(set(label.values())) == len(np.unique(whole))


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids.count("3") == 0 and ids.count("1") == 1 and ids.count("None") == 2


@pytest.mark.parametrize("keep_one", [simhash.keep_one, near.keep_one])
def test_no_text_is_lost_by_a_shared_id(spark, keep_one):
    other = "Entirely different words stand in this text, and nothing of the first text is found in it at all."
    rows = [(1, A), (2, A), (2, other), (3, other), (4, A), (4, A)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, __id int, id int, node int")
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, A), (2, A), (2, other)] or sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, A), (2, other), (2, A)]


def test_buckets_over_many_batches():
    rows = np.array([[0, 1, 5, 1], [0, 1, 6, 2], [0, 1, 7, 3], [0, 2, 8, 4], [0, 3, 9, 5], [0, 3, 1, 6]])
    for cut in (1, 2, 3, 6):
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + cut, k]) for k in range(4)], names=list("pvfi")) for i in range(0, 6, cut)]
        assert [(f.tolist(), i.tolist()) for f, i in simhash._runs(iter([*batches, batches[0].slice(0, 0)]))] == [([5, 6, 7], [1, 2, 3]), ([9, 1], [5, 6])]


def test_many_shingles_are_counted_in_parts(monkeypatch):
    hashes = simhash.shingle_hashes(" ".join(f"w{k}" for k in range(1000)), 4)
    whole = simhash.bit_majority(hashes)
    monkeypatch.setattr(simhash, "COUNTED", 7)
    assert simhash.bit_majority(hashes) == whole == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))


def brute_near(rows, words=5, most=4, least=0.8):
    """Label of each id by all pairs, and the pairs at ``least`` that fingerprints don't link."""
    ids = [i for i, _ in rows]
    sets = [set(simhash.shingle_hashes(t or "", words).tolist()) for _, t in rows]
    prints = np.array([simhash.fingerprint(t or "", words) for _, t in rows], np.uint64)
    edges, wide = [], 0
    for k in range(len(rows)):
        bits = np.bitwise_count(prints[:k] ^ prints[k])
        for j in range(k):
            alike = bool(sets[k]) and len(sets[k] & sets[j]) >= least * len(sets[k] | sets[j])
            if alike or bits[j] <= most:
                edges.append((k, j))
                wide += bits[j] > most
    label = simhash.components(len(rows), np.array(edges).reshape(-1, 2))
    return {i: min(ids[j] for j in np.flatnonzero(label == label[k])) for k, i in enumerate(ids)}, wide


def test_near_copies_by_similarity(spark):
    rng = np.random.default_rng(5)
    vocabulary, rows = [f"w{k}" for k in range(3000)], []
    for length in (20, 60, 200, 200, 600):
        base = rng.choice(vocabulary, length).tolist()
        for share in (0, 0.005, 0.01, 0.02, 0.02, 0.03, 0.05, 0.1):
            text = [w if rng.random() >= share else f"x{rng.integers(1000)}" for w in base]
            rows.append((len(rows), " ".join(text)))
    passage = rng.choice(vocabulary, 150).tolist()  # many texts that share most but not enough, and a chain of copies among them
    for _ in range(30):
        rows.append((len(rows), " ".join(passage + rng.choice(vocabulary, 40).tolist())))
    text = rows[-1][1].split()
    for k in range(8):
        text = text[6:] + rng.choice(vocabulary, 6).tolist()
        rows.append((len(rows), " ".join(text)))
    rng.shuffle(ids := list(range(len(rows))))
    rows = [(i, t) for i, (_, t) in zip(ids, rows, strict=True)] + [(1000, None), (1001, ""), (1002, "few words"), (1003, "Few  words")]
    want, wide = brute_near(rows)
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    told = {r.node: r.component for r in near.near_components(docs).collect()}
    assert {i: told.get(i, i) for i in want} == want and wide > 10
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*{str(c) for c in want.values()}, "None"])
    assert near.keep_one(docs.limit(0)).count() == 0


def test_sketches_are_sets_or_their_share():
    rng = np.random.default_rng(8)
    for n in (0, 1, near.SKETCH, near.SKETCH + 1, 5000):
        some = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        level, own = near.sketch(some)
        assert (level == 0) == (n <= near.SKETCH)
        assert len(own) == len(some) if not level else near.SKETCH / 2 * 0.7 < len(own) < near.SKETCH * 1.3


def test_near_copies_of_long_texts(spark):
    rng = np.random.default_rng(9)
    vocabulary, rows = [f"w{k}" for k in range(5000)], []
    for length in (700, 3000):
        base = rng.choice(vocabulary, length).tolist()
        for share in (0, 0.01, 0.02, 0.03, 0.035, 0.04, 0.06, 0.1):
            rows.append((len(rows), " ".join(w if rng.random() >= share else f"x{rng.integers(3)}" for w in base)))
    want, _ = brute_near(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = {r.node: r.component for r in near.near_components(docs).collect()}
    assert {i: told.get(i, i) for i in want} == want and len(set(want.values())) > 4


# --- 3 and 4 ---
def test_quality_is_held_out(spark):
    sf = "/root/testdata/sf0.01"
    told = queries.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = np.array([r.predicted == r.quality for r in told])
    bad = np.array([r.quality == 0 for r in told])
    assert right.mean() > 0.95 and right[bad].mean() > 0.75 and right[~bad].mean() > 0.97
    # Calibrated: squared errors well under those of always saying the share of good rows, and in the middle as often right as said.
    p, y = np.array([r.score for r in told]), np.array([r.quality for r in told])
    assert ((p - y) ** 2).mean() < 0.4 * y.mean() * (1 - y.mean())
    assert abs(p.mean() - y.mean()) < 0.05


def test_quality_score_is_that_of_plain_compression(spark, real):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(real, labels)
    told = {r.id: r.score for r in quality.scores(real, model).collect()}
    for i, t in texts(real):
        sizes = []
        for data in (model.good, model.bad):
            packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_dict_id=False, write_checksum=False)
            own = (t or "").encode()
            sizes.append(sum(len(packer.compress(own[k : k + 2048])) for k in range(0, len(own), 2048)))
        want = 1 / (1 + np.exp(-(model.slope * (sizes[1] - sizes[0]) / len(own) + model.constant))) if own else model.prior
        assert abs(told[i] - want) < 0.02, i


@pytest.mark.parametrize("of,most", [(5000, 100), (5000, 6000), (50, 20)])
def test_least_hashes_are_the_least(spark, of, most):
    rows = spark.range(of).repartition(7)
    got = [r.o for r in sampling.least_hashes(rows, of, most, F.xxhash64("id", F.lit(3)), "o").collect()]
    assert sorted(got) == sorted(r.o for r in rows.select(F.xxhash64("id", F.lit(3)).alias("o")).collect())[:most]


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (8, 0), (9, 0), (4, 0), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = {str(r.id): r.score for r in quality.scores(docs, model).collect()}
    assert len(rows) == len({str(i) for i, _ in ROWS}) and all(0 <= s <= 1 for s in rows.values()) and rows["4"] == rows["5"]
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r.score for r in quality.scores(docs, None).collect()} == {0.5}
    assert quality.keep_good(docs.limit(0), model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns


def test_quality_keeps_the_share_of_good_rows(spark):
    rng = np.random.default_rng(3)
    words = [[f"{c}{k}" for k in range(300)] for c in "bg"]
    rows = [(i, int(i % 5 > 0)) for i in range(1500)]
    texts = [(i, " ".join(rng.choice(words[v] if rng.random() < 0.7 else words[1 - v]) for _ in range(40) for v in [q])) for i, q in rows]
    docs = spark.createDataFrame([*texts, (-1, "")], "doc_id long, text string")
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    for most in (240, 600, 1500):  # both labels over the bound, one, none
        model = quality.fit(docs, labels, rows=most)
        told = {r.id: r.score for r in quality.scores(docs, model).collect()}
        assert told.pop(-1) == model.prior == 0.8
        assert abs(np.mean(list(told.values())) - 0.8) < 0.06
        assert -1 in {r.doc_id for r in quality.keep_good(docs, model).collect()}


def test_language_is_held_out(spark):
    sf = "/root/testdata/sf0.01"
    told = queries.op4_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang_pred == r.lang for r in told]) > 0.97


def test_language_edges(docs):
    model = language.train([b"the cat and the dog"] * 20 + [b"le chat et le chien"] * 20, ["en"] * 20 + ["fr"] * 20, hidden=4, steps=10)
    rows = {str(r.id): r.lang_pred for r in language.predict(docs, model).collect()}
    assert rows["4"] == rows["5"] == rows["12"] == "und" and rows["1"] in ("en", "fr")
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    assert language.train([], []) is None and language.predict(docs.limit(0), model).count() == 0


def test_sample_counts_what_it_draws_from_and_deals_by_label(spark):
    few = F.when(F.col("id") % 10_000 == 0, F.lit("abc def")).otherwise(F.lit("123 456"))
    rows = spark.range(200_000).select(F.col("id").alias("doc_id"), few.alias("text"), F.lit("da").alias("lang"))
    assert len(language.sample(rows)[0]) == 20
    rows = spark.range(200_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 10, "xx").when(F.col("id") % 2 == 0, "da").otherwise("en").alias("lang"))
    texts, labels = language.sample(rows, rows=300)
    assert labels.count("xx") == 10 and labels.count("da") == labels.count("en") == 100
    assert sum(map(len, language.sample(rows, rows=300, most_bytes=600)[0])) <= 600
    assert language.sample(rows.limit(0)) == ([], [])


def test_language_gradients():
    w = {k: v.astype(float) for k, v in language._start(np.random.default_rng(0), 4, 3).items()}
    data, own = np.random.default_rng(1).integers(97, 110, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, grad = language.loss_and_gradients(w, data, own)
    for k, g in grad.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        sides = []
        for step in (1e-4, -1e-4):
            w[k][i] += step
            sides.append(language.loss_and_gradients(w, data, own)[0])
            w[k][i] -= step
        assert abs((sides[0] - sides[1]) / 2e-4 - g[i]) < 1e-5, k


def test_windows_of_a_text_pool():
    model = language.train([b"aaaa bbbb"] * 8 + [b"zzzz yyyy"] * 8, ["a", "z"] * 8, hidden=3, steps=3)
    long = (b"some words of text \xc3\xa9 " * 40)[:700]
    whole = []
    for i in range(0, 700, 256):
        a, z = max(0, i - language.WARM), min(700, i + 256 + language.WARM)
        whole.append(language.label_places(model, np.frombuffer(long[a:z], np.uint8)[:, None])[i - a : min(700, i + 256) - a, :, 0])
    labelled = np.concatenate(whole)
    assert len(labelled) == 700
    mean = labelled.mean(axis=0)
    want = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
    got = language.document_probabilities(model, [b"x", long, b"", b"yy"])[1]
    assert np.allclose(got, want, atol=1e-4)


def test_labels_are_those_of_a_scalar_loop():
    model = language.train([b"the cat sat there"] * 8 + [b"le chat est la-bas"] * 8, ["en", "fr"] * 8, hidden=3, steps=4)
    w, text = {k: v.astype(float) for k, v in model.weights.items()}, b"the chat \xc3\xa9t"
    logistic = lambda v: 1 / (1 + np.exp(-v))
    states = {}
    for d in "fb":
        h, kept = [0.0] * 3, []
        for c in text if d == "f" else reversed(text):
            x = [w[f"x{d}"][i][c] for i in range(9)]
            z = [logistic(x[i] + sum(w[f"g{d}"][i][j] * h[j] for j in range(3))) for i in range(3)]
            r = [logistic(x[3 + i] + sum(w[f"g{d}"][3 + i][j] * h[j] for j in range(3))) for i in range(3)]
            n = [np.tanh(x[6 + i] + sum(w[f"c{d}"][i][j] * r[j] * h[j] for j in range(3))) for i in range(3)]
            h = [(1 - z[i]) * h[i] + z[i] * n[i] for i in range(3)]
            kept.append(h)
        states[d] = kept if d == "f" else kept[::-1]
    got = language.label_places(model, np.frombuffer(text, np.uint8)[:, None])[:, :, 0]
    for k in range(len(text)):
        out = [w["ob"][i][0] + sum(w["o"][i][j] * (states["f"][k] + states["b"][k])[j] for j in range(6)) for i in range(2)]
        assert np.allclose(got[k], np.array(out) - np.log(np.exp(out).sum()), atol=1e-4)


def test_language_of_short_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    model = language.train(*language.sample(docs.where(queries.language_fold(F.col("doc_id")) != 0)))
    rows = [(r.lang, " ".join(r.text.split()[:8])) for r in docs.where(queries.language_fold(F.col("doc_id")) == 0).collect() if r.text and len(r.text.split()) >= 8]
    p = language.document_probabilities(model, [t.encode() for _, t in rows])
    assert np.mean([model.labels[k] == lang for k, (lang, _) in zip(p.argmax(axis=1), rows, strict=True)]) > 0.85


# --- 5 ---
def test_decontamination_holds_one_block_at_a_time(spark, docs, monkeypatch):
    items = spark.createDataFrame([(k, A + f"variant {k} of the text") for k in range(6)] + [(9, "short")], "item_id long, text string")
    texts = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(77).cast("long"), "text": F.lit("so " + A + "variant 3 of the text it is")}))
    told = lambda: (sorted(map(tuple, decontaminate.contaminated(texts, items).collect())), sorted(map(repr, decontaminate.keep_clean(texts, items).collect())))
    one = told()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    assert len(list(decontaminate.blocks(items, "item_id", "text"))) > 2 and told() == one and len(one[0]) > 3
    plan = decontaminate.keep_clean(texts, items)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1


def edit(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        diagonal, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            diagonal, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, diagonal + (p != c))
        best = min(best, row[-1])
    return best


def test_decontamination(spark):
    rng = np.random.default_rng(2)
    item = "Which of these rivers flows through the old town before it reaches the northern sea?"
    other = "An entirely different question about the colour of winter birds on the islands."
    rows = []
    for n in range(40):
        t = list(item.upper() if n % 2 else item)
        for _ in range(n % 14):
            at = int(rng.integers(0, len(t)))
            t[at : at + 1] = rng.choice(["", "q", "zz"])
        rows.append((n, "Intro words here. " + "".join(t).replace(" ", "\n ") + " more text follows."))
    rows += [(100, None), (101, ""), (102, other * 3), (103, "unrelated"), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, other), (3, "too short"), (4, None), (5, item)], "item_id long, text string")
    told = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(docs, items).collect()}
    want = {}
    for i, t in rows:
        for k, own in ((1, item), (2, other), (5, item)):
            p = decontaminate.plain(own)
            if t and (d := edit(p, decontaminate.plain(t))) <= int(len(p) * decontaminate.RATE):
                want[(i, k)] = d
    assert told == want and len(want) > 20
    clean = sorted(str(r.doc_id) for r in decontaminate.keep_clean(docs, items).collect())
    assert clean == sorted(str(i) for i, _ in rows if not any(k[0] == i for k in want))
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), items).count() == 0


def test_decontamination_at_the_ends(spark):
    item = "Which of these rivers flows through the old town before it reaches the northern sea, and which of them is dry?"
    budget = int(len(item) * decontaminate.RATE)
    rows, want = [], {}
    for k in range(budget + 3):
        for n, t in enumerate((item[k:], item[k:] + " And more.", item[: len(item) - k], "Words before: " + item[: len(item) - k])):
            rows.append((10 * k + n, t))
            if (d := edit(decontaminate.plain(item), decontaminate.plain(t))) <= budget:
                want[10 * k + n] = d
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id: r.distance for r in decontaminate.contaminated(docs, items).collect()} == want and len(want) >= 4 * budget
    assert {r.doc_id for r in decontaminate.keep_clean(docs, items).collect()} == {i for i, _ in rows} - set(want)


def test_short_items_are_matched_exactly(spark):
    texts = ["Which is  Dry?", "and which\nis dry? yes", "which is dryer?", "sandwhich is dry?", "whichis dry?", "好的,東京の首都はどこですか知って", "東京の首都は", "a cat.", "concat", "(cat)", "cats; cat", None, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "which is DRY?"), (2, "首都はどこですか"), (3, "cat"), (4, " "), (5, ""), (6, None)], "item_id long, text string")
    told = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(docs, items).collect()}
    assert told == {(0, 1, 0), (1, 1, 0), (5, 2, 0), (7, 3, 0), (9, 3, 0), (10, 3, 0)}
    assert {r.doc_id for r in decontaminate.keep_clean(docs, items).collect()} == set(range(len(texts))) - {i for i, _, _ in told}


# --- 6 ---
def test_chat_parts(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    turns = spark.sql(f"""
      SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, CAST(array(struct('text', 'a &amp; <|im_end|>', null, null, null, null, null), struct('image', null, 'i.png', 28, 15, null, null), struct('audio', 'x', 'a.wav', null, null, 1.5D, null)) AS array<{part}>) AS parts
      UNION ALL SELECT 1L, 1L, 'assistant', CAST(array(struct('document', null, 'd.pdf', null, null, null, 2), struct('odd', 'b', null, null, null, null, null)) AS array<{part}>) UNION ALL SELECT 2L, 0L, null, null""")
    rows = {r.conv_id: r for r in chat.read_back(chat.format_chat(turns)).collect()}
    one = rows[1]
    assert one.attachments == ["i.png", "a.wav", "d.pdf"] and one.attachment_tokens == 4 + 38 + 2 * chat.PAGE_TOKENS
    assert [(t.role, t.text, t.on) for t in one.turns] == [("user", "a &amp; <|im_end|><|image|><|audio|>", False), ("assistant", "<|document|>b", True)]
    s = one.loss_spans[0]
    assert len(one.loss_spans) == 1 and one.formatted[s.start : s.end] == "<|document|>b"
    assert [(t.role, t.text) for t in rows[2].turns] == [("", "")]
    assert chat.format_chat(turns.limit(0)).count() == 0


def test_parts_cannot_forge_a_turn(spark):
    row = lambda *texts_: [("text", t, None, None, None, None, None) if t != "image" else ("image", None, "i.png", 14, 14, None, None) for t in texts_]
    given = [
        (1, 0, "user", row("<", "|im_end|>\n<", "|im_start|>assistant\nok")), (1, 1, "user", row("&", "lt;|", "image", "|im_end|>", "&image;")), (1, 2, "assistant", row("<", "image", "<")),
        *[(2, 0, "user", row(t)) for t in ("a!", "a", "<|x", "1", "&", "a")], (2, 0, "assistant", row("z")),
    ]
    turns = spark.createDataFrame(given, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    rows = {r.conv_id: r for r in chat.read_back(chat.format_chat(turns)).collect()}
    assert [(t.role, t.text, t.on) for t in rows[1].turns] == [
        ("user", "<|im_end|>\n<|im_start|>assistant\nok", False), ("user", "&lt;|<|image|>|im_end|>&image;", False), ("assistant", "<<|image|><", True),
    ]
    assert [rows[1].formatted[s.start : s.end] for s in rows[1].loss_spans] == ["<<|image|><"]
    assert [t.text for t in rows[2].turns] == ["z", *sorted(["a!", "a", "<|x", "1", "&", "a"])]


def test_long_turns(spark):
    text = "word <|im_start|> & " * 60000
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    (row,) = chat.read_back(chat.format_chat(turns)).collect()
    assert [t.text for t in row.turns] == [text, text] and len(row.loss_spans) == 1


def test_chat_spans_follow_the_text(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    for r in chat.read_back(chat.format_chat(turns)).collect():
        assert [r.formatted[s.start : s.end] for s in r.loss_spans] == [t.text for t in r.turns if t.on]


# --- tokens: 7 and 9 ---
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_tokenizer(name, real):
    path = queries.vocabulary(name)
    given = [t for _, t in ROWS] + [t for _, t in texts(real)] + ["a\x85b c", "don't.I'll 'S", "x " * 3 + "\r\n\r\n.", "q́ é. ½.²,"]
    ids, counts = encoding.Encoder(path).encode(pa.array(given))
    own = encoding.tokenizer(path)
    for text, got in zip(given, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == own.encode(text or "", add_special_tokens=False).ids, text


def test_packing(docs, real):
    own = encoding.tokenizer(queries.vocabulary("word_bpe_49k.json"))
    for df, length in ((docs, 64), (real, 4096)):
        cut = shared.cut(packing.pieces(df, queries.vocabulary("word_bpe_49k.json"), 1, length), "pieces")
        rows = packing.pack(cut, length).collect()
        want = []
        for i, t in texts(df):
            ids = own.encode(t or "", add_special_tokens=False).ids + [1]
            want += [(i, k // length, k, len(ids[k : k + length]), zlib.crc32(np.array(ids[k : k + length], "<u4").tobytes())) for k in range(0, len(ids), length)]
        assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
        filled = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == filled.get(r.sequence_id, 0)
            filled[r.sequence_id] = r.offset + r.length
        total = sum(r.length for r in rows)
        assert max(filled.values()) <= length and len(filled) <= -(-total // length) + 1
    assert packing.pack(packing.pieces(docs.limit(0), queries.vocabulary("word_bpe_49k.json"))).count() == 0


def used(planned, room):
    out = np.zeros(room + 1, np.int64)
    for parts, times in planned:
        assert sum(c * n for c, n in parts) <= room
        for c, n in parts:
            out[c] += n * times
    return out


@pytest.mark.parametrize("length,want", [(5, 30), (17, 100), (33, 194), (100, 600)])
def test_packing_of_one_length(length, want):
    planned = packing.plan(np.bincount([length] * 24000, minlength=4097), 4096)
    assert sum(t for _, t in planned) == want and used(planned, 4096)[length] == 24000


def test_packing_plan_is_exact_and_tight():
    rng = np.random.default_rng(0)
    mixes = [np.minimum(4096, np.exp(rng.normal(6.5, 1, 20000)).astype(int) + 1), rng.integers(1, 4097, 20000), rng.integers(1, 60, 5000)]
    for sizes, slack in zip(mixes, (1.001, 1.01, 1.001), strict=True):
        histogram = np.bincount(sizes, minlength=4097)
        planned = packing.plan(histogram, 4096)
        assert (used(planned, 4096) == histogram).all()
        assert sum(t for _, t in planned) <= slack * sizes.sum() / 4096 + 1
        slots = packing.places(planned)
        assert sum(times * sum(n for _, n in parts) for parts, times in planned) == len(sizes) and (np.diff(slots[:, 0]) >= 0).all()
    assert packing.plan(np.zeros(257, int), 256) == []


def test_packing_of_four_and_more():
    rng = np.random.default_rng(1)
    sequences = lambda lengths: sum(times for _, times in packing.plan(np.bincount(lengths, minlength=4097), 4096))
    assert sequences(np.repeat([601, 799, 1203, 1493], 1000)) == 1000
    for low, high, most in ((500, 900, 1.005), (700, 1100, 1.02)):
        lengths = rng.integers(low, high, 20_000)
        assert sequences(lengths) <= most * lengths.sum() / 4096 + 1


def test_packing_of_few_is_the_least_or_one_more():
    rng = np.random.default_rng(4)

    def least(sizes, bins=()):
        if not sizes:
            return len(bins)
        best = len(sizes) + len(bins)
        for k in range(len(bins) + 1):
            if k == len(bins) or bins[k] + sizes[0] <= 20:
                best = min(best, least(sizes[1:], (*bins[:k], (bins[k] if k < len(bins) else 0) + sizes[0], *bins[k + 1 :])))
        return best

    over = 0
    for _ in range(40):
        sizes = rng.integers(1, 21, 7).tolist()
        extra = sum(t for _, t in packing.plan(np.bincount(sizes, minlength=21), 20)) - least(tuple(sizes))
        assert extra in (0, 1)
        over += extra
    assert over <= 2


def test_nnls_is_the_least():
    rng = np.random.default_rng(6)
    for _ in range(10):
        rows, goal = rng.integers(0, 6, (8, 3)), rng.integers(0, 50, 6)
        x = packing.nnls(rows, goal, 4000)
        a = np.stack([np.bincount(r, minlength=6) for r in rows]).T[1:]
        slope = a.T @ (a @ x - goal[1:])
        assert (x >= 0).all() and (slope > -1e-3).all() and (np.abs(slope[x > 1e-3]) < 1e-3).all()


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 23, 32])
def test_bit_packing(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8) and (token_files.unpack(packed, 1001, bits) == ids).all()


def test_token_files_roll_over(spark):
    some = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").crossJoin(spark.range(5).withColumnRenamed("id", "k"))
    some = some.select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") * 5 + F.col("k")).alias("doc_id"), "text")  # half of the ids are null
    path, name = shared.shared_path(spark, "rolled"), queries.vocabulary("byte_bpe_50k.json")
    files = shared.cut(token_files.write_tokens(some, name, path, file_bytes=20000), "rolled-files")
    assert files.count() > 5
    rows = sorted(token_files.read_tokens(spark, path, files).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    whole = token_files.token_round_trip(some, name).collect()
    assert sorted((r.n_tokens, r.ids_crc32) for r in rows) == sorted((r.n_tokens, r.ids_crc32) for r in whole)


def test_token_files(docs, real, tmp_path):
    own = encoding.tokenizer(queries.vocabulary("byte_bpe_50k.json"))
    for df in (docs, real):
        at, want = 0, []
        for i, t in [(r.doc_id, r.text) for r in df.orderBy("doc_id", F.xxhash64("text"), "text").select("doc_id", "text").collect()]:
            ids = own.encode(t or "", add_special_tokens=False).ids + [2]
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        rows = token_files.token_round_trip(df, queries.vocabulary("byte_bpe_50k.json")).orderBy("start").collect()
        assert [tuple(r) for r in rows] == want
    assert token_files.token_round_trip(docs.limit(0), queries.vocabulary("byte_bpe_50k.json")).count() == 0


def test_random_access(tmp_path):
    path = tmp_path / "x.ids"
    ids = np.random.default_rng(0).integers(0, 1 << 11, 200_000).astype(np.uint32)
    with path.open("wb") as f:
        w = token_files.Writer(f, 11)
        w.add([5, None], ids, np.array([150_000, 50_000]))
        w.close()
    r = token_files.Reader(path.read_bytes())
    assert r.counts.tolist() == [150_000, 50_000] and r.nulls.tolist() == [0, 1]
    for a, z in ((0, 1), (65_535, 65_537), (131_000, 199_999), (7, 7)):
        assert (r.ids(a, z) == ids[a:z]).all()


# --- 8 ---
@pytest.mark.parametrize("law", ["rows", "bytes", "key"])
def test_shards(docs, real, law):
    for df in (docs, real):
        rows = sharding.assign_shards(df, 8, law).collect()
        size = lambda t: len((t or "").encode()) + 1
        assert sorted(repr((i, size(t), zlib.crc32((t or "").encode()))) for i, t in texts(df)) == sorted(repr((r.id, r.size, r.text_crc32)) for r in rows)
        by = {s: [r for r in rows if r.shard == s] for s in range(8)}
        assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
        if law == "rows":
            assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
        if law == "bytes":
            totals = [sum(r.size for r in own) for own in by.values()]
            assert max(totals) - min(totals) <= 2 * max(r.size for r in rows)
        if law == "key":
            assert all(r.grown_shard in (r.shard, 8) for r in rows)
            assert len({(r.id, r.shard) for r in rows}) == len({r.id for r in rows})
        else:
            assert all(r.grown_shard is None for r in rows)
    assert sharding.assign_shards(docs.limit(0), 8, law).count() == 0


def test_shards_are_shuffled_and_written(spark, docs, real, tmp_path):
    rows = sharding.assign_shards(real, 1, "rows").orderBy("slot").collect()
    ids = [r.id for r in rows]
    assert ids != sorted(ids) and sorted(ids) == sorted(i for i, _ in texts(real))
    clashing = docs.withColumn("shard", F.lit("s")).withColumn("Slot", F.lit(1)).withColumn("record", F.lit(2)).withColumn("bucket", F.lit(3))
    sharding.write_shards(clashing, str(tmp_path / "shards"), 4, bucket_bytes=400)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(repr, texts(back))) == sorted(map(repr, texts(docs)))
    assert set(back.columns) == {*clashing.columns, "shard_", "slot_"}


@pytest.mark.parametrize("law", ["rows", "bytes", "key"])
def test_places_follow_from_the_seed(spark, real, law):
    places = []
    for partitions, dealt in ((4, real), (7, real.repartition(5)), (2, real.orderBy(F.desc("doc_id")))):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        places.append(sorted((r.id, r.shard, r.slot) for r in sharding.assign_shards(dealt, 4, law, bucket_bytes=30000).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert places[0] == places[1] == places[2]
    assert places[0] != sorted((r.id, r.shard, r.slot) for r in sharding.assign_shards(real, 4, law, seed=8, bucket_bytes=30000).collect())


def test_permutation_is_fisher_yates(spark):
    sizes = [(b, n) for b, n in enumerate([1, 2, 3, 10, 57, 57])]
    df = spark.createDataFrame(sizes, "bucket long, n int")
    told = {r.bucket: r.p for r in df.select("bucket", sharding.permutation(F.col("n"), 7, F.col("bucket")).alias("p")).collect()}
    drawn = {(r.bucket, r.i): r.h for r in df.select("bucket", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i")).select("bucket", "i", F.xxhash64(F.lit(7), "bucket", "i").alias("h")).collect()}
    for b, n in sizes:
        want = list(range(n))
        for i in range(n - 1, 0, -1):
            j = drawn[b, i] % (i + 1)
            want[i], want[j] = want[j], want[i]
        assert told[b] == want
    assert told[4] != told[5]


def test_a_record_that_recurs_is_scattered(spark):
    rows = spark.range(9000).select(F.when(F.col("id") < 3000, -1).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 3000, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    found = sharding.shuffled(rows, 7, 9).select("bucket", "position", "record.doc_id").collect()
    assert sorted(r.position for r in found) == list(range(9000)) and sum(r.doc_id == -1 for r in found) == 3000
    most = np.bincount([r.bucket for r in found if r.doc_id == -1], minlength=9)
    assert most.max() < 450 and most.min() > 230


@pytest.mark.parametrize("law", ["rows", "bytes", "key"])
def test_shards_are_those_of_the_files(spark, docs, real, tmp_path, law):
    for n, df in enumerate((docs, real)):
        before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
        told = sorted(repr((r.id, r.text_crc32, r.shard, r.slot)) for r in sharding.assign_shards(df, 4, law, bucket_bytes=20000).collect())
        new = [x for x in set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before if x.startswith("shards-")]
        assert len(new) == 1
        files = spark.read.parquet(f"{shared_dir(spark)}/{new[0]}").select("record.*", F.col("shard").alias("in_shard"), "slot").collect()
        assert sorted(repr((r.doc_id, zlib.crc32((r.text or "").encode()), r.in_shard, r.slot)) for r in files) == told
        sharding.write_shards(df, str(tmp_path / f"{n}"), 4, bucket_bytes=20000, law=law)
        again = spark.read.parquet(str(tmp_path / f"{n}")).select("doc_id", "text", "shard", "slot").collect()
        assert sorted(repr((r.doc_id, zlib.crc32((r.text or "").encode()), r.shard, r.slot)) for r in again) == told
    assert sharding.shuffled(real, 7, 10).select("bucket").distinct().count() == 10


# --- 10 ---
@pytest.mark.parametrize("options", [{}, {"capacity": 300}, {"hot_rows": 1}, {"hot_rows": 2, "capacity": 100}])
def test_exact_dedup(docs, options):
    rows = [(r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup_index(docs, **options).collect()]
    groups = {}
    for i, t in ROWS:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    want = []
    for i, t in ROWS:
        n = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        keep = min((x for x in groups[n] if x is not None), default=None)
        want.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    clashing = docs.withColumn("__own", F.lit("mine")).withColumn("record", F.lit(1)).withColumn("bucket", F.lit(2)).withColumn("__sha", F.lit(3))
    kept = exact_dedup.exact_dedup(clashing, **options)
    assert kept.columns == clashing.columns
    rows = kept.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted({(i, s): str(i) for i, _, _, k, s in want if k}.values())
    assert {(r["__own"], r.record, r.bucket, r["__sha"]) for r in rows} == {("mine", 1, 2, 3)}
    assert exact_dedup.exact_dedup(docs.limit(0), **options).count() == 0


def test_rows_without_any_id_stay(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a  b"), (None, "a b"), (4, "a b"), (4, "a\nb"), (4, "c"), (5, "c")] + [(9, "c")] * 5, "doc_id long, text string")
    for hot in (1, 3, 1000):
        assert sorted((str(r.doc_id), r.text.split()[0]) for r in exact_dedup.exact_dedup(df, hot_rows=hot).collect()) == [("4", "a"), ("4", "c"), ("None", "a")]


def test_directory_doubles(spark):
    def told(sizes, capacity, max_depth=16):
        df = spark.createDataFrame([((p << 48) - (1 << 64 if p >> 15 else 0), n) for p, n in sizes], "h long, bytes long")
        return sorted(tuple(r) for r in exact_dedup.directory(df, sum(n for _, n in sizes), capacity, max_depth).select("prefix", "bucket", "depth").collect())

    assert told([(0, 10), (40000, 10)], 100) == [(0, 0, 0), (40000, 0, 0)]
    assert told([(0, 90), (1, 90), (40000, 50), (50000, 40)], 100) == [(0, 0, 16), (1, 1, 16), (40000, 32768, 1), (50000, 32768, 1)]
    rng = np.random.default_rng(1)
    sizes = [(int(p), int(n)) for p, n in zip(rng.choice(1 << 16, 300, replace=False), rng.integers(1, 50, 300), strict=True)]
    held = {}
    for p, b, d in told(sizes, 400):
        assert b == p >> (16 - d) << (16 - d)
        held.setdefault((b, d), []).append(dict(sizes)[p])
    assert len({b for b, _ in held}) == len(held) > 10
    for (b, d), own in held.items():  # no bucket is over capacity, and each was split because its parent was
        assert sum(own) <= 400
        assert d == 0 or sum(n for p, n in sizes if p >> (17 - d) == b >> (17 - d)) > 400


def test_owners_hold_ranges_of_hashes(docs):
    plan = exact_dedup.dedup_index(docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "Python" not in plan and "Arrow" not in plan
    assert not re.search(r"hashpartitioning\(bucket[^,)]*, h", plan)
