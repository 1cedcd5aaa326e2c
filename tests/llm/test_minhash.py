import random
from collections import defaultdict

import numpy as np
import pytest

from phaseframe.llm import common, minhash


def brute(rows, similarity=0.8, words=5):
    """Smallest id of each connected group of similar texts."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        n = min(words, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    return sorted((d, min(low[find(i)])) for i, (d, _) in enumerate(rows))


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(8, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            other = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 12])):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other))
    hot = [word() for _ in range(150)]
    for _ in range(120):  # one large group of near copies
        other = list(hot)
        other[rng.randrange(150)] = word()
        texts.append(" ".join(other))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(40)) for _ in range(60)]  # a shared passage is no copy
    texts += ["", None, "", "one two", "one two", "One  TWO", "x " * 3000, "   "]
    return list(enumerate(texts))


def test_classes_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 0, "k") for d, t in rows], "doc_id long, text string, n int, key string")
    got = sorted((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "a b c d e f g h"), (None, "quite another text of some words"), (2, None)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["class_size"]) for r in out) == [(0, 0, 1), (0, 1, 3), (1, 1, 3), (1, 1, 3), (2, 2, 1)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_the_similarity(weighted):
    rng = np.random.default_rng(5)
    darts = minhash.Darts(2048)
    for share in (0.2, 0.5, 0.8):
        a = rng.integers(0, 2**63, 300, dtype=np.uint64)
        b = np.concatenate([a[: int(300 * share)], rng.integers(0, 2**63, 300 - int(300 * share), dtype=np.uint64)])
        wa = rng.choice([0.5, 1, 2, 3.7, 9], 300) if weighted else np.ones(300)
        wb = np.where(rng.random(300) < 0.5, wa, wa * 1.6) if weighted else np.ones(300)
        x = dict(zip(a.tolist(), wa))
        y = dict(zip(b.tolist(), wb))
        keys = x.keys() | y.keys()
        true = sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)
        s = darts.sign([a, b], [wa, wb] if weighted else None)
        assert abs((s[0] == s[1]).mean() - true) < 0.05


def test_signature_does_not_depend_on_the_batch():
    sets = [minhash.shingles(t)[0] for t in ("a b c d e f g", "x y z", "long " * 50 + "tail of words here now")]
    darts = minhash.Darts(64)
    assert (darts.sign(sets) == np.concatenate([darts.sign([s]) for s in sets])).all()


def test_weighted_classes(spark):
    rows = [(1, "a b c d e " * 10), (2, "a b c d e " * 9), (3, "a b c d e " * 3), (4, "p q r s t u v w x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df, weighted=True).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    random.Random(0).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in common.connected_components(df, common.Scratch(spark, "t")).collect()}
    want = {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {300: 300, 301: 300, 302: 300}
    assert got == want
    assert common.connected_components(df.limit(0), common.Scratch(spark, "t")).count() == 0
