"""Ranked lexical search by sort-based accumulation, in integer arithmetic.

A term is a maximal run of ASCII letters and digits and of characters beyond
ASCII, of which only A-Z are lower-cased. Each document is cut once; what it
shares with the vocabulary of the items is one row: its number of terms and the
matched terms with their occurrences. These rows give the corpus figures

    N documents with a term, L terms of all documents, df documents with a term,
    w = floor(1000 ln((2 N + 2) / (2 df + 1))),  m = 50 + (50 n N) div L,
    impact = w * ((10^9 tf) div (1000 tf + 20 m)),

and the search goes over them: the impacts of a slice of documents are
concatenated for all items that hold their terms, keyed by item and document
packed into one integer, brought together by a radix sort of the keys and
summed between their borders (``numpy.add.reduceat``). Each item's ``k`` best are
kept; as in a heap, the least of them bars what scores lower.

Scale: a document's terms lie in one row, so sums need no exchange. Each
task hands out its own best rows by item; these are range-partitioned by item
and score and selected again before the last ranking, so an item's rows of many
tasks don't meet in one. The items of a round fit ``ROUND_TERMS`` terms;
further ones are searched in further rounds over the same rows: the items are
dealt out by a hash, and only a round's share of them goes to the driver and to
the tasks. Corpus figures are sums over all documents; of them
only those of the vocabulary of a round reach the driver.

Defined results: null and empty texts have no term, count nowhere and are never
found; items without a term, or of which no term stands in a document with a
positive weight, have no rows; terms that an item repeats count once. Each row of
the items is an item of its own, rows that share an id or have none too; each
row of the documents is a document of its own. Equal scores are ranked by id,
null last; rows that share id and score get ranks of their own in any order.
Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaseframe.llm.common import Scratch, slim_batches, tidy

BEST = 50
#: Terms, with repeats between items, of the items of a round.
ROUND_TERMS = 1 << 18
#: Impacts that a task accumulates at once, and rows of best documents that it holds before it selects again.
SLICE, HELD = 2_000_000, 200_000

#: Every byte that stands in no term as a blank, A-Z as a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _cut(vocabulary: dict[bytes, int]):
    """Documents as (doc_id, n, terms of the vocabulary, their occurrences)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, often, offsets = [], [], [], [0]
            for text in batch.column("text"):
                ws = terms(text.as_py())
                hits = np.fromiter((t for t in map(vocabulary.get, ws) if t is not None), np.int32)
                t, tf = np.unique(hits, return_counts=True)
                sizes.append(len(ws))
                found.append(t)
                often.append(tf)
                offsets.append(offsets[-1] + len(t))
            flat = lambda parts, kind: np.concatenate(parts or [[]]).astype(kind)
            ends = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(flat(parts, np.int32))) for parts in (found, often)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    return run


def _figures(size: int):
    """A task's part of (term, df); N under the term -1, L under -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
            df += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], at]).astype(np.int32)), pa.array(np.concatenate([[docs, total], df[at]]))], ["term", "v"])

    return run


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative integer keys, digit by digit of 16 bits from the lowest."""
    order, top = np.arange(len(keys)), int(keys.max(initial=0))
    for shift in range(0, max(top.bit_length(), 1), 16):
        digit = ((keys[order] if shift else keys) >> shift & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


def _best(item: np.ndarray, score: np.ndarray, missing: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of each item's ``k`` highest scores, ties by (id is null, id)."""
    order = np.lexsort((doc, missing, -score, item))
    item = item[order]
    first = np.flatnonzero(np.diff(item, prepend=-1))
    rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    return order[rank < k]


def _at_least(item: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places, in order of items, whose score is no less than their item's ``k``-th highest; ``item`` ascends."""
    first = np.append(np.flatnonzero(np.diff(item, prepend=-1)), len(item))
    kept = np.ones(len(item), bool)
    for lo, hi in zip(first[:-1], first[1:]):
        if hi - lo > k:
            kept[lo:hi] = score[lo:hi] >= np.partition(score[lo:hi], hi - lo - k)[hi - lo - k]
    return np.flatnonzero(kept)


class _Search:
    """Accumulates the documents of a task for the items of a round."""

    def __init__(self, starts: np.ndarray, items: np.ndarray, weights: np.ndarray, docs: int, total: int, k: int):
        self.starts, self.items, self.weights, self.docs, self.total, self.k = starts, items, weights, docs, total, k

    def scores(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, score) of all pairs that share a term, by item and document."""
        m = 50 + (50 * n * self.docs) // self.total
        impact = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        many = self.starts[term + 1] - self.starts[term]
        at = np.repeat(np.arange(len(term)), many)
        place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + self.starts[term[at]]
        keys = self.items[place] * len(n) + doc[at]
        order = radix_order(keys)
        keys = keys[order]
        borders = np.flatnonzero(np.diff(keys, prepend=-1))
        if not len(borders):
            return keys, keys, keys
        return keys[borders] // len(n), keys[borders] % len(n), np.add.reduceat(impact[at[order]], borders)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        bar = np.ones(int(self.items.max(initial=-1)) + 1, np.int64)  # the least score that may still be one of the best

        def selected() -> tuple[np.ndarray, ...]:
            columns = [np.concatenate(c) for c in zip(*held)]
            kept = _best(*columns, self.k)
            columns = tuple(c[kept] for c in columns)
            last = np.flatnonzero(np.diff(columns[0], append=-1))
            full = last[np.diff(last, prepend=-1) == self.k]
            bar[columns[0][full]] = columns[1][full]
            return columns

        for batch in batches:
            n = batch.column("n").to_numpy()
            ids = batch.column("doc_id")
            missing, ids = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
            lists = batch.column("terms")
            lens = np.diff(lists.offsets.to_numpy())
            term = lists.flatten().to_numpy(zero_copy_only=False)
            tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), lens)
            # slices of whole documents
            work = np.cumsum(np.bincount(doc, self.starts[term + 1] - self.starts[term], len(n)))
            ends = np.append(0, np.cumsum(lens))
            lo = 0
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + SLICE, side="right")))
                own = slice(ends[lo], ends[hi])
                item, d, score = self.scores(n[lo:hi], doc[own] - lo, term[own], tf[own])
                able = np.flatnonzero(score >= bar[item])
                kept = able[_at_least(item[able], score[able], self.k)]
                item, d, score = item[kept], d[kept] + lo, score[kept]
                held.append((item, score, missing[d], ids[d]))
                if sum(len(h[0]) for h in held) > HELD:
                    held = [selected()]
                lo = hi
        if held:
            item, score, missing, ids = selected()
            columns = [pa.array(item.astype(np.int32)), pa.array(score), pa.array(ids, mask=missing)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "score", "doc_id"])


def _merged(k: int):
    """A range's best rows of each of its items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def selected() -> tuple[np.ndarray, ...]:
            columns = [np.concatenate(c) for c in zip(*held)]
            kept = _best(*columns, k)
            return tuple(c[kept] for c in columns)

        rows = 0
        for batch in batches:
            ids = batch.column("doc_id")
            held.append((batch.column("item").to_numpy(), batch.column("score").to_numpy(), np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()))
            rows += len(batch)
            if rows > HELD:
                held = [selected()]
                rows = len(held[0][0]) - HELD  # selects again after as many new rows
        if held:
            item, score, missing, ids = selected()
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(ids, mask=missing)], ["item", "score", "doc_id"])

    return run


def _round(source: DataFrame, items: list[tuple[int | None, set[bytes]]], k: int, scratch: Scratch) -> DataFrame:
    """item_id, doc_id, score, rank for the items of one round."""
    spark = source.sparkSession
    vocabulary: dict[bytes, int] = {}
    pairs = [(vocabulary.setdefault(t, len(vocabulary)), number) for number, (_, ts) in enumerate(items) for t in sorted(ts)]
    holders = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    starts = np.searchsorted(holders[:, 0], np.arange(len(vocabulary) + 1))

    rows = scratch.write(source.mapInArrow(tidy(_cut(vocabulary)), "doc_id long, n long, terms array<int>, tf array<int>").where("n > 0"), "matched")
    parts = rows.select("n", "terms").mapInArrow(tidy(_figures(len(vocabulary))), "term int, v long")
    figures = {r["term"]: r["v"] for r in parts.groupBy("term").agg(F.sum("v").alias("v")).collect()}
    docs, total = figures.pop(-1, 0), figures.pop(-2, 0)
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in figures.items():
        weights[term] = math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))

    search = _Search(starts, holders[:, 1], weights, docs, total, k)
    schema = "item int, score long, doc_id long"
    best = scratch.write(rows.mapInArrow(tidy(search), schema), "best")
    tasks = best.rdd.getNumPartitions()
    ranges = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks))
    best = best.repartitionByRange(ranges, "item", F.desc("score"), F.xxhash64("doc_id")).mapInArrow(tidy(_merged(k)), schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(number, i) for number, (i, _) in enumerate(items)], "item int, item_id long")
    return scratch.write(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = BEST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    round_terms: int = ROUND_TERMS,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of each item."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    source = slim_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t.as_py()))) for t in batch.column("text")]
            sizes = pa.array(list(map(len, found)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary())), sizes], ["item_id", "terms", "size"])

    asked = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    asked = asked.mapInArrow(tidy(distinct_terms), "item_id long, terms array<binary>, size long").where("size > 0")
    asked = scratch.write(asked, "items")
    size = asked.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()["size"]
    rounds = -(-size // round_terms)
    out = None
    for number in range(rounds):
        share = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(rounds)) == number)
        own = [(r["item_id"], set(map(bytes, r["terms"]))) for r in share.select("item_id", "terms").collect()]
        if own:
            found = _round(source, own, k, scratch)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
