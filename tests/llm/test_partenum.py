import random
import re

import numpy as np
import pytest

from phaseframe.llm import partenum

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = {c: c + 32 for c in range(65, 91)}


def grams(text, words=3):
    ws = WORD.findall((text or "").translate(LOW))
    n = min(words, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()


def brute(rows, percent=90):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


def check(spark, rows, **more):
    docs = spark.createDataFrame([(d, t, 0, "k", 1) for d, t in rows], "doc_id long, text string, n int, node string, row int").repartition(5)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in partenum.jaccard_components(docs, **more).collect()]
    assert order(got) == order(brute(rows, more.get("percent", 90)))
    return got


def corpus(seed, bases=50):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    texts = []
    for _ in range(bases):
        base = [word() for _ in range(rng.choice([1, 2, 3, 5, 12, 20, 40, 90, 200, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):  # edits around the threshold
            other = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
                at = rng.randrange(len(other) or 1)
                other[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
            texts.append(" ".join(other))
    hot = [word() for _ in range(150)]
    for _ in range(150):  # near copies, partly just below the threshold of each other
        other = list(hot)
        for _ in range(rng.randint(1, 4)):
            other[rng.randrange(150)] = word()
        texts.append(" ".join(other))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(3, 40))) for _ in range(60)]
    texts += [texts[7]] * 80
    texts += ["", None, " \t\n", "one two", "one two", "One  TWO", "one", "x " * 3000, "x x x", "É é b c", "é é b c", "a\x1cb c d", "a b c d"]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, seed):
    got = check(spark, corpus(seed))
    assert sum(c != d for d, _, c in got) > 150


def test_another_similarity(spark):
    check(spark, corpus(3, 20), percent=80)


def test_repeated_null_ids_and_empty_table(spark):
    a, b = "a b c d e f g h", "quite another text of some words"
    check(spark, [(1, a), (1, a), (None, a), (None, b), (2, None), (None, None), (7, b), (5, b), (1, b)])
    assert partenum.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for percent in (70, 80, 90, 95):
        for _ in range(300):
            size = int(rng.choice([1, 2, 5, 9, 10, 17, 19, 30, 77, 150, 400, 1500]))
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            add = int(rng.integers(0, 1 + size * (100 - percent) // percent))
            drop = 0
            while 100 * (size - drop - 1) >= percent * (size + add) and rng.random() < 0.95:
                drop += 1
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common):
                assert set(partenum.signatures(a, percent)) & set(partenum.signatures(b, percent)), (percent, size, add, drop)
                apart = np.bitwise_count((partenum.parities(a) ^ partenum.parities(b)).view(np.uint64)).sum()
                assert apart <= len(a) + len(b) - 2 * common


def test_bands_and_schemes():
    table = partenum.bands(90, 5000)
    assert all(table[i + 1][0] == table[i][1] + 1 for i in range(len(table) - 1))
    for low, high in table:
        k = 2 * high * 10 // 190
        n1, n2, k2 = partenum.scheme(k, low)
        assert k // n1 <= k2 < n2
