import zlib

import numpy as np

from phaseframe.llm import quality, queries


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        ranks[s == v] = ranks[s == v].mean()
    n1 = y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    out = queries.op7_quality(spark, d).toPandas()
    for r in out.head(50).itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert ((out.score >= 0.7) == (out.predicted == 1)).all() and out.score.between(0, 1).all()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    x = out.merge(labels, on="doc_id")
    x = x[x.held_out]
    assert auc(x.quality.to_numpy(), x.score.to_numpy()) > 0.99
    assert (x.predicted == x.quality).mean() > 0.98


def docs_and_labels(spark):
    rows = [(k, f"Some good sentence number {k} with words. Another one follows here, as it does." if k % 3 else "$$$ ### " * (k + 1), "n", 1) for k in range(60)]
    rows += [(200, None, "n", 1), (201, "", "n", 1), (202, "word " * 60_000, "n", 1), (None, "no id", "n", 1), (1, rows[1][1], "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string, label int")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(60)] + [(3, 5, 0), (4, None, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_edge_rows(spark):
    docs, labels = docs_and_labels(spark)
    out = quality.score_documents(docs, labels).collect()
    assert len(out) == 65 and all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["doc_id"] is None and not r["held_out"] for r in out) == 1
    first = [r for r in out if r["doc_id"] == 1]
    assert len(first) == 2 and first[0]["score"] == first[1]["score"]
    kept = quality.keep_documents(docs, labels).collect()
    want = sorted((r["doc_id"] or -1) for r in out if r["predicted"] == 1)
    assert sorted((r["doc_id"] or -1) for r in kept) == want and kept[0]["x"] == "n"


def test_missing_classes_and_empty_tables(spark):
    docs, labels = docs_and_labels(spark)
    assert {r["score"] for r in quality.score_documents(docs, labels.limit(0)).collect()} == {1.0}
    assert {r["score"] for r in quality.score_documents(docs, labels.where("quality = 0")).collect()} == {0.0}
    assert quality.score_documents(docs.limit(0), labels).count() == 0


def test_scores_depend_on_the_text_alone(spark):
    docs, labels = docs_and_labels(spark)
    a = {r["doc_id"]: r["score"] for r in quality.score_documents(docs.where("doc_id < 60"), labels).collect()}
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 4 == 2]
    flipped = labels.selectExpr("doc_id", f"CASE WHEN doc_id IN ({', '.join(map(str, held))}) THEN 1 - quality ELSE quality END AS quality")
    b = {r["doc_id"]: r["score"] for r in quality.score_documents(docs.where("doc_id < 60"), flipped).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_log_ratio_is_that_of_two_gaussians():
    rng = np.random.default_rng(0)
    p = quality.N_STATS
    a, b = rng.normal(size=(p, p)) * 0.2 + np.eye(p), rng.normal(size=(p, p)) * 0.2 + np.eye(p)
    m = quality.Discriminant(np.zeros(p), np.ones(p), np.stack([np.zeros(p), np.ones(p)]), [np.linalg.cholesky(a @ a.T), np.linalg.cholesky(b @ b.T)], [np.log(np.diag(np.linalg.cholesky(c @ c.T))).sum() for c in (a, b)], 0.3)
    x = rng.normal(size=(5, p))
    dens = lambda c, mu: np.array([-0.5 * (v - mu) @ np.linalg.inv(c @ c.T) @ (v - mu) - 0.5 * np.linalg.slogdet(c @ c.T)[1] for v in x])
    assert np.allclose(m.log_ratio(x), dens(b, np.ones(p)) - dens(a, np.zeros(p)) + 0.3)


def test_classes_of_all_scripts():
    codes = np.array([ord(c) for c in "a\u00c9\u3042\u6f22\ud55c\uff21\U00020000\U0001f600\uff11\u3000"], np.uint32)
    lower, upper = quality.LOWER, quality.UPPER
    want = [lower, upper, lower, lower, lower, upper, lower, quality.SYMBOL, quality.DIGIT, quality.SPACE]
    assert quality.classes(codes).tolist() == want


def test_fit_against_plain_numpy(spark):
    """Moments, shrinkage and log densities anew from the rows, without the operator's sums and factors."""
    rng, p = np.random.default_rng(5), quality.N_STATS
    y = (rng.random(400) < 0.6).astype(int)
    x = rng.normal(size=(400, p)) @ (np.eye(p) + 0.3 * rng.normal(size=(p, p))) + np.outer(y, rng.normal(size=p)) + 7
    table = spark.createDataFrame([(int(v), row.tolist()) for v, row in zip(y, x)], "label int, x array<double>")
    model = quality.fit(table, 0.1, 0.02)
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).sum() * cov[c] for c in (0, 1)) / len(y)
    mean, scale = np.mean([x[y == c].mean(axis=0) for c in (0, 1)], axis=0), np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    z, out = (x - mean) / scale, []
    for c in (0, 1):
        s = (0.9 * cov[c] + 0.1 * pooled) / np.outer(scale, scale)
        s = 0.98 * s + 0.02 * max(np.trace(s) / len(s), 1e-3) * np.eye(len(s))
        d = z - z[y == c].mean(axis=0)
        out.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1] + np.log((y == c).mean()))
    assert np.allclose(model.log_ratio(x), out[1] - out[0], rtol=1e-5, atol=1e-6)
