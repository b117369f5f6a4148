"""Exact top-k, ranked search and structure repair against brute force, with nulls, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from localmarkets.llm import lexical, queries, topk, turns


# --- 11 ---
def brute_top_k(rows, k=5):
    kept, out = [], []
    for place, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            ends = lambda x: 2**63 - 1 if x > 0 else -(2**63)
            kept.append((place, i, [math.floor(256 * x) if abs(256 * x) < 2**62 else ends(x) for x in v]))
    for place, i, v in kept:
        if i is not None and i % 50 == 0:
            scores = [(-max(-topk.LIMIT, min(topk.LIMIT, sum(a * b for a, b in zip(u, v, strict=True)))), w is None, w or 0, w) for other, w, u in kept if other != place and len(u) == len(v)]
            out += [(i, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(map(repr, out))


def top_k(df, **options):
    return sorted(repr((r.query_id, r["rank"], r.vec_id, r.score)) for r in topk.exact_top_k(df, **options).collect())


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 0.25, rng.gauss(0, 0.2)]) for _ in range(40)]) for i in range(250)]
    rows += [(50, rows[50][1])] * 3 + [(50, rows[7][1]), (None, rows[50][1]), (500, None), (550, [None] * 40), (600, [math.nan] * 40), (650, [math.inf] * 40)]
    rows += [(700, [1.0, 2.0]), (701, [3.0, 1.0]), (750, []), (751, []), (800, [1e300] * 3), (801, [1e300] * 3), (850, [-1e17] * 3)]
    return rows + [(1000 + i, rows[3][1]) for i in range(60)]  # one vector many times


def test_top_k(spark, vectors):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, v int, tile int")
    for tile, block in ((4 << 20, 1 << 20), (20000, 2000)):
        assert top_k(df, tile_bytes=tile, query_bytes=block) == brute_top_k(vectors)
    assert top_k(df.limit(0)) == []


def test_candidates_are_cut_off_but_none_that_reaches():
    rng = np.random.default_rng(1)
    near = rng.normal(0, 30, 128)
    held = np.rint(np.concatenate([near + rng.normal(0, 3, (20, 128)), rng.normal(0, 30, (3000, 128))]))
    columns, query = topk.Columns(held), np.rint(near)
    rest = topk.remaining(query[None])[:, 0]
    at, scores = topk.reaching(query, rest, query[: topk.DIMS] @ columns.blocks[0], columns, 6)
    exact = held @ query
    assert len(at) < 100 and set(np.argsort(-exact)[:6]) <= set(at.tolist())
    assert (scores == exact[at]).all()


# --- 12 ---
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_search(docs, items, most=50):
    counts = [(i, Counter(split(t))) for i, t in docs if split(t)]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 50 + (50 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(split(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scores, key=lambda x: x[:3])[:most])]
    return sorted(map(repr, out))


def search(docs, items, **options):
    return sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in lexical.ranked_search(docs, items, **options).collect())


def test_ranked_search(spark):
    rng = random.Random(5)
    pool = ["Ærø", "ærø", "kaffe", "MARKED", "marked", "x1", "漢字", "a", "b", "c", *[f"w{i}" for i in range(80)]]
    docs = [(i, " -,\n".join(rng.choices(pool, k=rng.choice([1, 3, 10, 60])))) for i in range(150)]
    docs += [(i, "same kaffe text W1 w1 w1") for i in range(200, 280)] + [(7, docs[7][1]), (None, docs[9][1]), (300, None), (301, ""), (302, " -- "), (303, "w2 " * 5000)]
    items = [(1, "Kaffe w1 marked"), (2, "Kaffe w1 marked"), (3, None), (4, "--"), (5, "nowhere"), (None, "ÆRØ Ærø 漢字"), (6, "w2 w3 w4 w5 a"), (7, "same text")]
    d = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, number string").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, part int")
    assert search(d, q) == brute_search(docs, items)
    assert search(d, q, most=3, block_terms=3) == brute_search(docs, items, 3)
    assert search(d, q, index=lexical.build_index(d)) == brute_search(docs, items)
    assert search(d.limit(0), q) == [] and search(d, q.limit(0)) == []


def test_bounds_hold_and_long_texts_are_split():
    rng = random.Random(7)
    texts = [" ".join(rng.choices([f"t{i}" for i in range(300)], k=rng.choice([5, 50, 400]))).encode() for _ in range(40)]
    block = lexical.Block(4096)
    for i, t in enumerate(texts):
        found = lexical.terms(t)
        block.docs.append((i, b"", found.total(), *lexical.hashed(found)))
    asked = lexical.Asked([{"query": bytes([k]), "terms": [f"t{i}" for i in range(k, 300, 9)], "weights": list(range(1, 1 + len(range(k, 300, 9))))} for k in range(9)])
    n = np.array([d[2] for d in block.docs], np.int64)
    docs, all_terms = len(texts), int(n.sum())
    m = np.array([50 + (50 * int(x) * docs) // all_terms for x in n], np.int64)
    bounds = asked.bounds(block.slices(), m, n)
    exact = np.array([asked.scores(t, list(range(9)), docs, all_terms) for t in texts]).T
    assert (bounds >= exact).all() and (bounds == exact).mean() > 0.3
    long = (b"word " * 300_000) + b"last"
    assert lexical.terms(long) == Counter({b"word": 300_000, b"last": 1})


# --- 13 ---
def brute_repair(rows):
    seen, faults, facts = set(), [], dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal"], 0)
    for _, role, text in rows:
        shown = text.strip(turns.SPACE)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        if fault:
            facts[fault] += 1
    numbers = [t for t, _, _ in rows if t is not None]
    facts["gaps"] = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    facts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    whole, begun, best = re.compile(r"(s?(ua)+)?\Z"), re.compile(r"s?(ua)*u?\Z"), None

    def go(i, audit, out, cost, inserted):
        nonlocal best
        initials = "".join(o[0] for o in out)
        if (best and cost > best[0]) or not begun.match(initials):
            return
        if i == len(rows) and whole.match(initials) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, "\n".join(o[1] for o in out)
        if inserted < 2:
            for role in ("user", "assistant"):
                go(i, audit + "I", [*out, (role[0], role + ":")], cost + 3, inserted + 1)
        if i < len(rows):
            go(i + 1, audit + "D", out, cost + 4, 0)
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                _, role, text = rows[i]
                if role:
                    go(i + 1, audit + "K", [*out, (role[0], f"{role}:{text}")], cost + more, 0)
                for new in ("user", "assistant"):
                    go(i + 1, audit + "R", [*out, (new[0], f"{new}:{text}")], cost + 3 + more, 0)

    go(0, "", [], 0, 0)
    return (*facts.values(), best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


def conversations(seed, many):
    rng, roles = random.Random(seed), ["user", "assistant", "system"]
    for conv in range(many):
        turn = None
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.9:
                turn = (-1 if turn is None else turn) + rng.choice([0, 1, 1, 1, 2])
            yield conv, turn, rng.choice(roles if rng.random() < 0.8 else ["tool", "", "u", None]), rng.choice(["a.", "b", "c!", " ", "", "d? \n", None])


def test_repair(spark):
    given = list(conversations(11, 150)) + [(None, 0, "user", "x."), (None, 1, "assistant", "y.")]
    df = spark.createDataFrame([(*r, 1, "s") for r in given], "conv_id long, turn long, role string, text string, known int, of string")
    groups = {}
    for conv, turn, role, text in given:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    want = {c: brute_repair(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for c, rows in groups.items()}
    assert {r[0]: tuple(r)[1:] for r in turns.repaired(df).collect()} == want
    assert turns.repaired(df.limit(0)).collect() == []


def test_damage_and_whole_query(spark, sf):
    rows = spark.createDataFrame([(1, n, "assistant", "Why? So.") for n in range(6)], "conv_id long, turn long, role string, text string")
    got = [(r.turn, r.role, r.text) for r in turns.damaged(rows, F.col("turn")).orderBy("turn").collect()]
    assert got == [(1, "assistant", ""), (2, "assistant", "Why So"), (3, "assistant", "Why? So."), (3, "assistant", "Why? So."), (4, "user", "Why? So."), (5, "assistant", "Why? So.")]
    gone = turns.repair_conversations(rows, turns.damaged(rows, F.lit(0))).collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    told = queries.QUERIES["op13_structure_repair"](spark, sf)
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    assert told.count() == given.select("conv_id").distinct().count()


def test_memory_is_what_is_undecided():
    rng, job, most = random.Random(5), turns.Repair(), 0

    def size(node):
        return 1 + sum(size(k) for k in node.kids)

    for i in range(3000):
        job.add(i, rng.choice(["user", "assistant", "system"]), rng.choice([f"x{i}.", f"x{i}", ""]), False)
        most = max(most, size(job.root))
    for i in range(3000, 9000):  # the same row again and again
        job.add(i, "user", "same.", i > 3000)
    assert most < 40 and size(job.root) < 40
    assert len(job.result()[6].replace("I", "")) == 9000
