"""Near-duplicates of texts and vectors against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from riverloom.llm import common, components, embeddings, minhash


def partition_of(rows):
    return {r[0]: r[1] for r in rows}


def union(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    random.Random(1).shuffle(links)
    found = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    got = partition_of(found.collect())
    ids = {x for p in links for x in p} - {7} | {7}
    assert got == {i: r for i, r in union(ids, links).items()}


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def similarity(a, b):
    from collections import Counter

    def shingles(t):
        w = common.split_words(t)
        return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()

    x, y = shingles(a), shingles(b)
    both = sum((x & y).values())
    either = sum((x | y).values())
    return both / either if either else 0.0


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(30):
        base = rng.choices(words, k=rng.randint(20, 200))
        docs.append(base)
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 60))):
                copy[rng.randrange(len(copy))] = "x" + str(rng.randrange(10**6))
            docs.append(copy)
    texts = [" ".join(d) for d in docs]
    texts += [texts[0].upper() + "!!", texts[1], None, None, "", "...", "one", "One.", "two words", "é é é é é é é", "line\n" * 300, "line\n" * 310]
    return list(enumerate(texts))


def test_near_duplicates_are_those_of_all_pairs(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, digest int, bands string")
    got = partition_of(minhash.near_duplicates(df).collect())
    links = [(i, j) for i, a in docs for j, b in docs if i < j and similarity(a, b) >= 0.8]
    assert got == union([i for i, _ in docs], links)
    assert len(set(got.values())) < len(docs)


def test_near_duplicates_of_repeated_null_and_absent_ids(spark):
    t = " ".join(f"a{i}" for i in range(30))
    u = " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, t), (5, t), (5, u), (9, u), (None, t), (7, t)], "doc_id long, text string")
    assert partition_of(minhash.near_duplicates(df).collect()) == {5: 5, 9: 5, 7: 5}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def changed(text, k):
    words = text.split()
    words[k] = "changed"
    return " ".join(words)


@pytest.mark.parametrize("swap", [False, True])
def test_repeated_ids_have_the_links_of_all_their_texts(spark, swap):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in ("zy" if swap else "ab"))
    rows = [(5, a), (5, b), (6, changed(b, 20)), (7, changed(a, 3)), (8, "else"), (8, None), (9, None), (8, a.upper() + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert partition_of(minhash.near_duplicates(df).collect()) == {5: 5, 6: 5, 7: 5, 8: 5, 9: 9}


def test_near_duplicates_of_repeated_ids_are_those_of_all_pairs(spark):
    rng = random.Random(9)
    docs = [(rng.randrange(60), t) for _, t in corpus(4)]
    got = partition_of(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    links = [(i, j) for i, a in docs for j, b in docs if i != j and similarity(a, b) >= 0.8]
    assert got == union({i for i, _ in docs}, links)


def test_one_row_of_each_class_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a, 1), (5, b, 2), (6, changed(b, 20), 3), (7, changed(a, 3), 4), (2, c, 5), (2, c, 6), (2, c + "!", 7), (3, c, 8), (None, a, 9), (None, a, 10), (4, None, 11), (4, None, 12), (4, "", 13), (1, "...", 14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component int")
    kept = [tuple(r) for r in minhash.keep_one(df).collect()]
    assert sorted((r[0] or 0, r[1] or "") for r in kept) == sorted([(5, a), (5, b), (2, c), (0, a), (0, a), (4, ""), (4, ""), (1, "...")])
    assert sorted(kept, key=str) == sorted((tuple(r) for r in minhash.keep_one(df.repartition(7)).collect()), key=str)
    assert minhash.keep_one(df.limit(0)).count() == 0


def test_near_duplicates_of_long_texts_and_ties(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(50_000)}" for _ in range(120_000)]
    near = [w if k % 50 else "x" + w for k, w in enumerate(long)]
    base = [f"t{k}" for k in range(40)]  # 36 runs: 32 shared ones of 40 are 0.8 exactly, 31 of 41 less
    tie, less = [*base[:36], "u1", "u2", "u3", "u4"], [*base[:35], "v1", "v2", "v3", "v4", "v5"]
    texts = [" ".join(t) for t in (long, near, base, tie, less)]
    assert similarity(texts[2], texts[3]) == 0.8 > similarity(texts[2], texts[4])
    got = partition_of(minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    links = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and similarity(a, b) >= 0.8]
    assert got == union(range(5), links) and got[1] == 0 and got[3] == 2


def test_links_that_no_star_shows(spark):
    """Members that are near each other but not to the best connected one are linked, too."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for k in rng.sample(range(150), rng.randint(0, 12)):
            copy[k] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = partition_of(minhash.near_duplicates(df).collect())
    links = [(i, j) for i in range(60) for j in range(i) if similarity(texts[i], texts[j]) >= 0.8]
    assert got == union(range(60), links)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    test_links_that_no_star_shows(spark)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    hashes, words = minhash.WordHashes(), []
    for _ in range(300):
        a = [b"w%d" % x for x in rng.integers(0, 30, 200)]
        b = list(a)
        for k in rng.choice(200, 10, replace=False):
            b[k] = b"z%d" % rng.integers(10**9)
        words += [a, b]
    doc, h, n = minhash.counted(*minhash.elements(words, hashes))
    sig = minhash.signatures(doc, h, n, len(words))
    cut = np.searchsorted(doc, np.arange(len(words) + 1))
    part = lambda k: (h[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]])
    error = [(sig[k] == sig[k + 1]).mean() - minhash.similarity(part(k), part(k + 1)) for k in range(0, len(words), 2)]
    assert abs(np.mean(error)) < 0.01


def test_signatures_of_fractional_weights():
    """A set within another of twice its weight: half of the coordinates agree."""
    n = 400
    doc = np.repeat(np.arange(2), n)
    h = np.tile(minhash.mix(np.arange(n).astype(np.uint64)), 2)
    weight = np.concatenate([np.full(n, 0.6), np.full(n, 1.2)])
    sig = minhash.signatures(doc, h, weight, 2, k=2000)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.05


@pytest.mark.parametrize("scale", [1.0, 2.0**-10, 1000.0])
def test_signatures_of_uneven_weights(scale):
    """Weights from a fourth to hundreds, at any scale: coordinates agree as often as the weighted similarity says."""
    rng = np.random.default_rng(4)
    n = 300
    h = np.tile(minhash.mix(np.arange(n).astype(np.uint64)), 2)
    x, y = rng.choice([0.25, 0.7, 1, 2, 3.5, 8, 300], n) * scale, rng.choice([0.25, 1, 2.5, 9, 250], n) * scale
    sig = minhash.signatures(np.repeat(np.arange(2), n), h, np.concatenate([x, y]), 2, k=4000, floor=0.25 * min(scale, 1))
    assert abs((sig[0] == sig[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04


def test_the_cost_of_a_weight_is_its_logarithm(monkeypatch):
    """The darts thrown for one element of a huge weight, or of a tiny one above the floor, are about TARGET."""
    thrown = []
    plain = minhash.mix
    monkeypatch.setattr(minhash, "mix", lambda x: (thrown.append(len(x)), plain(x))[1])
    for weight, floor in ((1.0, 1.0), (1e6, 1.0), (1e-3, 1e-3)):
        thrown.clear()
        minhash.signatures(np.zeros(1, np.int64), np.array([5], np.uint64), np.array([weight]), 1, floor=floor)
        assert sum(thrown) < 40_000

def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(60):
        v = rng.normal(size=16)
        for _ in range(rng.integers(1, 5)):
            rows.append((v + rng.normal(size=16) * rng.choice([0, 0.03, 0.12, 0.4]), int(rng.integers(0, 3))))
    return [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]


def brute(rows):
    links = {i: [] for i, _, _ in rows}
    clean = {}
    for i, v, _ in rows:
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
        clean[i] = np.asarray(v, float) if ok else None
    for i, _, a in rows:
        for j, _, b in rows:
            x, y = clean[i], clean[j]
            if i < j and a is not None and a == b and x is not None and y is not None and len(x) == len(y):
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[i].append(j)
                    links[j].append(i)
    parts = union(links, [(i, j) for i, x in links.items() for j in x])
    return {i: (len(links[i]), parts[i], parts[i] == i) for i in links}


@pytest.mark.parametrize("block", [4, 1024])
def test_near_vectors_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "PAIRS", 7 * block)
    monkeypatch.setattr(embeddings, "CHUNK", 50 * block)
    rows = vectors()
    n = len(rows)
    rows += [(n + k, rows[0][1], rows[0][2]) for k in range(30)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-30, 2e-30]]
    rows += [(n + k, v, 0) for k, v in enumerate(odd)] + [(n + 20, rows[0][1], None), (n + 21, rows[0][1], None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, unit string, codes int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()}
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want = brute(f32)
    assert got == want
    assert max(w[0] for w in want.values()) >= 30


def test_near_vectors_of_repeated_and_absent_ids(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [(4, v, 1), (4, w, 1), (4, v, 1), (None, v, 1), (2, w, 1), (None, None, 1), (9, [3.0, -1.0, 0.0], 1), (9, [3.0, -1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(str, ((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect())))
    want = [(4, 4, 2, False)] * 3 + [(None, 4, 2, False), (2, 4, 2, True), (None, 0, None, True), (9, 1, 9, True), (9, 1, 9, True)]
    assert got == sorted(map(str, want))
    alone = spark.createDataFrame([(None, v, 1), (None, v, 1)], "vec_id long, embedding array<double>, label int")
    assert {(r.n_links, r.component_id) for r in embeddings.near_vectors(alone).collect()} == {(1, None)}


def test_a_cosine_at_the_threshold_links(spark):
    a, b = [1.0, 0.0], [0.98, float(np.sqrt(1 - 0.98**2))]
    x, y = np.array(a), np.array(b)
    df = spark.createDataFrame([(1, a, 1), (2, b, 1), (3, [0.97, float(np.sqrt(1 - 0.97**2))], 1)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    assert x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98 and got == {1: 1, 2: 2, 3: 1}


def test_near_vectors_of_long_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=20_000)
    rows = [(1, base.tolist(), 1), (2, (base + rng.normal(size=20_000) * 0.05).tolist(), 1), (3, rng.normal(size=20_000).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.component_id for r in embeddings.near_vectors(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_near_vectors_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(df).count() == 0
