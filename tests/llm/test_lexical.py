import math
import random
import re
from collections import Counter

import numpy as np

from phaseframe.llm import lexical

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = {c: c + 32 for c in range(65, 91)}


def cut(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, k=50):
    texts = [Counter(cut(t)) for _, t in docs]
    n = [sum(c.values()) for c in texts]
    size, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in texts for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, _), c, m in zip(docs, texts, n):
            score = 0
            for t in set(cut(text)):
                if t in c:
                    w = math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * (50 + (50 * m * size) // total)))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(found)[:k], 1)]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


def check(spark, docs, items, k=50, **more):
    a = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, item_id string, rank int").repartition(5)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(a, b, k, **more).collect()]
    assert order(got) == order(brute(docs, items, k))
    return got


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdéñ9", k=rng.randint(1, 4))) for _ in range(300)]
    pick = lambda size: " ".join(words[int(rng.paretovariate(0.6)) % 300] for _ in range(size))
    docs = [(k, pick(rng.randint(1, 60))) for k in range(n)]
    docs += [(k, docs[3][1]) for k in range(n, n + 150)]  # ties: a third of the rows are copies
    docs += [(n + 200, pick(20_000)), (n + 201, None), (n + 202, ""), (n + 203, " -- !?"), (None, docs[3][1]), (None, pick(30)), (5, pick(30)), (5, docs[5][1])]
    items = [(k, pick(rng.randint(1, 40))) for k in range(25)] + [(30, None), (31, ""), (32, "..."), (33, "zzz-not-there"), (None, pick(9)), (3, pick(9)), (34, docs[3][1])]
    return docs, items


def test_against_all_pairs(spark):
    docs, items = corpus(1)
    got = check(spark, docs, items)
    assert max(r[1] for r in got) == 50
    check(spark, docs, items, k=3)


def test_rounds_and_slices_give_the_same(spark, monkeypatch):
    docs, items = corpus(2, 150)
    monkeypatch.setattr(lexical, "SLICE", 300)
    monkeypatch.setattr(lexical, "HELD", 40)
    check(spark, docs, items, k=5, round_terms=60)


def test_terms():
    text = "Ärger ÄB It's a_b x y  ÉÉ Z9-9z \x7f~{q}\ttab İ"
    assert [t.decode() for t in lexical.terms(text)] == cut(text)
    assert lexical.terms(None) == []


def test_empty_tables(spark):
    assert check(spark, [], [(1, "a b")]) == []
    assert check(spark, [(1, "a b")], []) == []
    assert check(spark, [(1, None), (2, "")], [(1, "a")]) == []
    assert check(spark, [(1, "a")], [(1, "a")]) == [(1, 1, 1, 287 * (10**9 // (1000 + 20 * 100)))]


def test_radix_order():
    rng = np.random.default_rng(1)
    for top in (1, 1000, 1 << 20, 1 << 40):
        keys = rng.integers(0, top, 5000)
        assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(lexical.radix_order(np.empty(0, np.int64))) == 0
