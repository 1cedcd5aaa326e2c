"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text is reduced to a fixed vector of transformed statistics (lengths,
character classes, repetition, compressibility). Class means and covariances
are sums over all labelled training rows, so they are aggregated exactly and
only (classes x statistics) numbers reach the driver. Covariances are shrunk
towards the pooled one and towards a multiple of the identity; a score is the
difference of the classes' log densities, from Mahalanobis distances with the
Cholesky factors computed once, put on the 0..1 scale by a logistic curve fitted
to a histogram of that difference.

Texts are read once: the statistics are written to the shared folder, the
labels join those narrow rows. Nothing is keyed by source or text, so there is
no hot group; the join with labels is by document id.

Defined results: a null text counts as empty and is scored like any text; a
repeated document is scored again; a document with several labels trains once
for each; labels other than 0 and 1 are ignored; without training rows of one
class every score is the share of label 1 among them (1 where there are none at
all); an empty table gives no rows; extra columns are ignored. Labels,
languages, sources and ids never enter a statistic.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseframe.llm.common import Scratch, bitmap_filter, slim_batches, tidy

LOWER, UPPER, DIGIT, SPACE, BREAK, STOP, MARK, SYMBOL = range(8)
N_STATS = 22
THRESHOLD = 0.7


@functools.lru_cache(1 << 17)
def _class_of(code: int) -> int:
    ch = chr(code)
    kind = unicodedata.category(ch)
    if ch == "\n":
        return BREAK
    if ch.isspace():
        return SPACE
    if kind == "Lu":
        return UPPER
    if kind[0] in "LM":
        return LOWER
    if kind[0] == "N":
        return DIGIT
    if ch in ".,":
        return STOP
    return MARK if ch in ";:'\"!?-()" else SYMBOL


#: Classes of the first code points; those of others are looked up as they come.
_CLASSES = np.array([_class_of(code) for code in range(0x3000)], np.uint8)


def classes(codes: np.ndarray) -> np.ndarray:
    kinds = _CLASSES[np.minimum(codes, len(_CLASSES) - 1)]
    far = np.flatnonzero(codes >= len(_CLASSES))
    if len(far):
        own, at = np.unique(codes[far], return_inverse=True)
        kinds[far] = np.array([_class_of(int(c)) for c in own], np.uint8)[at]
    return kinds


def statistics(texts: list[str]) -> np.ndarray:
    """(texts, N_STATS) float64."""
    n = len(texts)
    lens = np.fromiter(map(len, texts), np.int64, n)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = classes(codes)
    doc = np.repeat(np.arange(n), lens)
    counts = np.bincount(doc * 8 + kinds, minlength=n * 8).reshape(n, 8).astype(float)
    # places where a symbol or mark follows a word character: symbols glued to words
    if len(codes):
        glued = np.flatnonzero((kinds[1:] >= MARK) & (kinds[:-1] <= STOP) & (kinds[:-1] != SPACE) & (kinds[:-1] != BREAK)) + 1
        n_glued = np.bincount(doc[glued], minlength=n).astype(float)
    else:
        n_glued = np.zeros(n)
    rest = np.empty((n, 9))
    for i, t in enumerate(texts):
        words = t.split()
        seen = Counter(words)
        pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else len(words)
        lines = t.split("\n")
        raw = t.encode("utf-8", "surrogatepass")
        top = max(seen.values(), default=0)
        cut = sum(map(len, seen))
        rest[i] = (len(words), len(seen), pairs, top, cut, len(lines), len(set(lines)), len(raw), len(zlib.compress(raw, 1)))
    words, distinct, pairs, top, cut, lines, dlines, raw, packed = rest.T
    chars = lens.astype(float)
    share = lambda a, b: np.log((a + 0.5) / (b + 1.0))
    odds = lambda a, b: np.log((a + 0.5) / (b - a + 0.5))
    letters = counts[:, LOWER] + counts[:, UPPER]
    return np.column_stack(
        [
            np.log1p(chars),
            np.log1p(words),
            np.log1p(lines),
            np.log((chars - counts[:, SPACE] - counts[:, BREAK] + 1) / (words + 1)),
            np.log((cut + 1) / (distinct + 1)),
            share(chars, lines),
            odds(counts[:, UPPER], letters),
            share(counts[:, DIGIT], chars),
            share(counts[:, SPACE], chars),
            share(counts[:, BREAK], chars),
            share(counts[:, STOP], words),
            share(counts[:, MARK], words),
            share(counts[:, SYMBOL], words),
            share(n_glued, words),
            odds(letters, chars),
            odds(distinct, words),
            np.log(distinct + 1) - 0.8 * np.log(words + 1),
            odds(np.minimum(pairs, words), words),
            share(top, words),
            odds(dlines, lines),
            np.log((packed + 1) / (raw + 1)),
            share(counts[:, UPPER], counts[:, STOP] + lines),
        ]
    )


def _stats_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.iloc[lo : lo + 256]
            x = statistics(["" if t is None else t for t in part["text"]])
            out = part.drop(columns="text")
            out = out.assign(x=list(x))
            yield out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = slim_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(tidy(_stats_of), "doc_id long, x array<double>")


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the remainder kept for testing; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Discriminant:
    """The fitted model; a few kilobytes."""

    def __init__(self, mean, scale, centers, factors, logdets, prior, a=1.0, b=0.0, constant=None):
        self.mean, self.scale, self.centers, self.factors, self.logdets = mean, scale, centers, factors, logdets
        self.prior, self.a, self.b, self.constant = prior, a, b, constant

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -50, 50)
        logp = []
        for c in (0, 1):
            y = np.linalg.solve(self.factors[c], (z - self.centers[c]).T)
            logp.append(-0.5 * (y * y).sum(axis=0) - self.logdets[c])
        return logp[1] - logp[0] + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return self._curve(self.squash(self.log_ratio(x)))

    @staticmethod
    def squash(r: np.ndarray) -> np.ndarray:
        """Keeps the order of large differences without saturating."""
        return np.sign(r) * np.log1p(np.abs(r))

    def _curve(self, s: np.ndarray) -> np.ndarray:
        return _sigmoid(self.a * s + self.b)


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if not len(batch):
            continue
        x = np.stack(batch["x"].to_numpy())
        y = batch["label"].to_numpy()
        for c in (0, 1):
            xc = x[y == c]
            if len(xc):
                flat = np.concatenate([[len(xc)], xc.sum(axis=0), (xc.T @ xc).ravel()])
                sums[c] = sums.get(c, 0) + flat
    if sums:
        yield pd.DataFrame({"label": list(sums), "sums": list(sums.values())})


def fit(labelled: DataFrame, shrink_pooled: float = 0.1, shrink_identity: float = 0.02) -> Discriminant:
    """From rows (label 0/1, x array<double>); exact class moments over all of them."""
    rows = labelled.select(F.col("label").cast("int").alias("label"), "x")
    sums = (
        rows.mapInPandas(tidy(_moments), "label int, sums array<double>")
        .select("label", F.posexplode("sums").alias("at", "v"))
        .groupBy("label", "at")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    p = N_STATS
    flat = np.zeros((2, 1 + p + p * p))
    for r in sums:
        flat[r["label"], r["at"]] = r["v"]
    n = flat[:, 0]
    if min(n) < 2:
        return Discriminant(None, None, None, None, None, None, constant=float(n[1] / n.sum()) if n.sum() else 1.0)
    means = flat[:, 1 : 1 + p] / n[:, None]
    second = flat[:, 1 + p :].reshape(2, p, p)
    cov = np.stack([second[c] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    mean, scale = means.mean(axis=0), np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    centers = (means - mean) / scale
    pooled = pooled / np.outer(scale, scale)
    factors, logdets = [], []
    for c in (0, 1):
        s = cov[c] / np.outer(scale, scale)
        s = (1 - shrink_pooled) * s + shrink_pooled * pooled
        s = (1 - shrink_identity) * s + shrink_identity * max(np.trace(s) / p, 1e-3) * np.eye(p)
        factor = np.linalg.cholesky(s)
        factors.append(factor)
        logdets.append(float(np.log(np.diag(factor)).sum()))
    model = Discriminant(mean, scale, centers, factors, logdets, float(np.log(n[1] / n[0])))

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                s = model.squash(model.log_ratio(np.stack(batch["x"].to_numpy())))
                yield pd.DataFrame({"label": batch["label"], "bin": np.rint(s * 20).astype(np.int32)})

    hist = rows.mapInPandas(tidy(ratios), "label int, bin int").groupBy("label", "bin").count().collect()
    s = np.array([r["bin"] / 20 for r in hist])
    y = np.array([r["label"] for r in hist], float)
    w = np.array([r["count"] for r in hist], float)
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))

    def loss(a: float, b: float) -> float:
        m = a * s + b
        return float((w * (np.logaddexp(0, m) - target * m)).sum() + 0.5e-3 * (a - 1) ** 2)

    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps for the logistic curve, halved until they descend
        q = _sigmoid(a * s + b)
        g = np.array([(w * (q - target) * s).sum() + 1e-3 * (a - 1), (w * (q - target)).sum()])
        v = w * q * (1 - q)
        h = np.array([[(v * s * s).sum() + 1e-3, (v * s).sum()], [(v * s).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        now, rate = loss(a, b), 1.0
        while rate > 1e-6 and loss(a - rate * step[0], b - rate * step[1]) > now:
            rate /= 2
        a, b = a - rate * step[0], b - rate * step[1]
        if np.abs(rate * step).max() < 1e-9:
            break
    model.a, model.b = max(float(a), 1e-3), float(b)
    return model


def _training_rows(table: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    given = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    given = given.where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    return table.join(given, "doc_id").select("label", "x")


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted. Learns only from rows that aren't held out."""
    scratch = Scratch(docs.sparkSession, "quality")
    table = scratch.write(document_statistics(docs, id_col, text_col), "statistics")
    train = scratch.write(_training_rows(table, labels, id_col, label_col), "train")
    model = fit(train)
    scratch.drop(train)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = model.score(np.stack(batch["x"].to_numpy())) if len(batch) else np.empty(0)
            yield batch.drop(columns="x").assign(score=s)

    out = table.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "x")
    out = out.mapInPandas(tidy(score), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject.

    Statistics for training are made of labelled documents only; then each text
    is scored where it is read, so no text is exchanged.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    given = labels.select(F.col(id_col).cast("long").alias("__id"))
    src = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    some = document_statistics(bitmap_filter(src, "__id", given), "__id", "__text")
    train = scratch.write(_training_rows(some, labels, id_col, label_col), "train")
    model = fit(train)
    scratch.drop(train)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = ["" if t is None else str(t) for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(model.score(statistics(texts)) >= threshold))

    return docs.mapInArrow(tidy(keep), docs.schema)
