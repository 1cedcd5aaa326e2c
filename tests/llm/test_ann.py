import math

import numpy as np
import pytest

from phaseframe.llm import ann, queries


def exact(rows, qids, k=10):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = {}
    for q in qids:
        i = int(np.flatnonzero(ids == q)[0])
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out[q] = [(int(ids[j]), d[j]) for j in order]
    return out


def search(spark, rows, **args):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")
    out = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0"), **args).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("d", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_and_scores(spark, d):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = {}
    for r in queries.op10_neighbours(spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = exact(rows, [q for q, _ in rows if q % 100 == 0])
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want]) >= 0.9
    for q in want:
        true = dict(exact(rows, [q], len(rows))[q])
        assert all(math.isclose(true[v], s, rel_tol=1e-12) for v, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))


def test_ties_copies_and_a_hot_cluster(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist(), 0) for k in range(400)]
    rows += [(k, [1.0] * 8, 0) for k in range(400, 900)]  # one vector, 500 times
    got = search(spark, rows)
    assert [v for v, _ in got[500]] == list(range(400, 410)) and all(s == 0 for _, s in got[500])
    assert [v for v, _ in got[400]] == list(range(401, 411))


def test_few_and_invalid_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [], 0), (9, [1.0], 0), (None, [1.0, 1.0], 0), (100, None, 0), (200, [0.0, 0.0], 0), (1, [0.0, 2.0], 0)]
    assert search(spark, rows) == {0: [(2, 1.0), (1, math.sqrt(2.0))]}
    assert search(spark, rows[3:6]) == {} and search(spark, [(0, [1.0], 0)]) == {}


def test_queries_short_of_neighbours_search_everything(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=4) + 50 * (k % 40)).tolist(), 0) for k in range(400)]
    got = search(spark, rows, visited=1, posted=1)
    assert all(len(v) == 10 for v in got.values()) and len(got) == 4


def test_footrule():
    rank = np.array([2, 0, 1, 3])
    assert ann._footrule(np.array([[1, 2, 0], [0, 3, 1]]), rank, 12).tolist() == [0, 2 + 2 + 2]
