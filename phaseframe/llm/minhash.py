"""Near-duplicate documents by DartMinHash signatures and banded joining.

The elements of a document are its distinct runs of five words (lower case,
split at white space), with weight 1 or their number. Each element's region,
its weight by an unbounded rank, receives hashed darts as a Poisson process that
depends on the element alone: cells of doubling rank (and weight) hold a hashed
number of darts, and each dart hashes to a weight, a rank and one of ``k``
coordinates. A document sees the darts below its elements' weights and keeps the
earliest one of each coordinate, cell by cell until every coordinate has one, so
its work is proportional to elements plus k log k instead of elements times k. Two
documents keep the same dart in a coordinate with the probability of their
weighted Jaccard similarity.

Bands of ``rows`` coordinates are hashed to bucket keys. With 40 bands of 8, a
pair at similarity 0.8 shares a bucket with probability 0.999, one at 0.4 with
0.03. Candidates must agree in two bits of as many coordinates as a pair at the
wanted similarity does, less four standard deviations, and are then verified
exactly on the element sets.

Scale: documents with equal element sets are one node from the start, combined
map-side, so any number of copies costs one row in the join. Buckets are
resolved by ``link_buckets`` without making all pairs of a group, and groups
are connected components found in written rounds. Nothing of the documents
reaches the driver. Nodes are named by a 64-bit hash of the element set.

Defined results: texts with fewer than five words have their whole word list as
one element; texts without words (null, empty) resemble nothing and stay alone;
every row is returned, a null id too; the class is the smallest id of the
group; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.llm.common import Scratch, bitmap_filter, link_buckets, slim_batches, tidy

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 8

_U = np.uint64
_FULL = _U(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit element hashes of a text in increasing order, and their numbers."""
    ws = text.lower().encode("utf-8", "surrogatepass").split()
    if not ws:
        return np.empty(0, _U), np.empty(0, np.int64)
    codes = np.fromiter(map(zlib.crc32, ws), np.uint64, len(ws))
    n = min(words, len(ws))
    h = np.zeros(len(codes) - n + 1, _U)
    for j in range(n):
        h = mix(h * _U(0x9E3779B97F4A7C15) + codes[j : j + len(h)] + _U(1))
    return np.unique(h, return_counts=True)


class Darts:
    """Signatures of k coordinates for weighted element sets."""

    FIRST = -6  # the first cell of ranks ends at 2**FIRST

    def __init__(self, k: int):
        self.k = k
        self._cdf: dict[float, np.ndarray] = {}

    def _number(self, u: np.ndarray, area: float) -> np.ndarray:
        """Poisson numbers of mean ``area`` from hashes, by the inverse distribution."""
        if area not in self._cdf:
            top = int(area + 12 * math.sqrt(area) + 24)
            logs = np.array([i * math.log(area) - area - math.lgamma(i + 1) for i in range(top)])
            self._cdf[area] = np.minimum(np.cumsum(np.exp(logs)), 1.0)
        return np.searchsorted(self._cdf[area], (u >> _U(11)).astype(np.float64) * 2.0**-53, side="right")

    def sign(self, elements: list[np.ndarray], weights: list[np.ndarray] | None = None) -> np.ndarray:
        """(sets, k) uint64. A value is a dart's level, then its rank within the
        level: its order is the order of ranks, and it names the dart. Sets must not be empty."""
        n, k = len(elements), self.k
        sig = np.full(n * k, _FULL)
        lens = np.fromiter(map(len, elements), np.int64, n)
        doc, h = np.repeat(np.arange(n), lens), np.concatenate(elements)
        w = np.concatenate(weights).astype(float) if weights is not None else None
        level = 0
        while len(h):
            span = 2.0 ** (self.FIRST if level == 0 else self.FIRST + level - 1)
            top = 1.0 if w is None else float(w.max())
            nu = 0
            while nu == 0 or 2.0 ** (nu - 1) < top:  # cells of weight: up to 1, then doubling
                low, width = (0.0, 1.0) if nu == 0 else (2.0 ** (nu - 1), 2.0 ** (nu - 1))
                rows = np.arange(len(h)) if w is None or nu == 0 else np.flatnonzero(w > low)
                cell = _U((level * 64 + nu + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
                seed = mix(h[rows] ^ cell)
                many = self._number(mix(seed + _U(0xA0761D6478BD642F)), span * width)
                hit = np.flatnonzero(many)
                many = many[hit]
                at = np.repeat(hit, many)
                j = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                dart = mix(seed[at] + (j.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
                row = rows[at]
                if w is not None:
                    place = low + width * ((mix(dart ^ _U(0xE7037ED1A0B428DB)) >> _U(11)).astype(float) * 2.0**-53)
                    ok = place < w[row]
                    dart, row = dart[ok], row[ok]
                coordinate = (dart % _U(k)).astype(np.int64)
                value = (_U(level) << _U(58)) | (mix(dart) >> _U(6))
                np.minimum.at(sig, doc[row] * k + coordinate, value)
                nu += 1
            open_ = (sig.reshape(n, k) == _FULL).any(axis=1)
            left = open_[doc]
            doc, h = doc[left], h[left]
            w = w[left] if w is not None else None
            level += 1
        return sig.reshape(n, k)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) int64 bucket keys."""
    parts = sig.reshape(len(sig), bands, rows)
    odd = mix(np.arange(1, rows + 1, dtype=_U)) | _U(1)
    acc = (mix(parts) * odd).sum(axis=2, dtype=_U)
    return mix(acc + mix(np.arange(bands, dtype=_U) + _U(77))).view(np.int64)


#: Coordinates whose lowest two bits share a long of a sketch.
PER_LONG = 32


def sketches(sig: np.ndarray) -> np.ndarray:
    """(sets, longs) int64: two bits of each coordinate."""
    n, k = sig.shape
    two = np.zeros((n, -(-k // PER_LONG) * PER_LONG), _U)
    two[:, :k] = mix(sig) & _U(3)
    shift = (np.arange(PER_LONG, dtype=_U) * _U(2))[None, None, :]
    return np.bitwise_or.reduce(two.reshape(n, -1, PER_LONG) << shift, axis=2).view(np.int64)


def sketch_agreement(k: int, similarity: float, sigmas: float = 4.0) -> int:
    """Least number of agreeing coordinates of two sketches that a pair of this
    similarity has, ``sigmas`` standard deviations below the expected one."""
    p = similarity + (1 - similarity) / 4
    return math.floor(k * p - sigmas * math.sqrt(k * p * (1 - p)))


def _signer(words: int, bands: int, rows: int, weighted: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        darts = Darts(bands * rows)

        def signed(ids: list, found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
            full = [i for i, (h, _) in enumerate(found) if len(h)]
            keys: list = [[]] * len(found)
            short: list = [[]] * len(found)
            if full:
                sig = darts.sign([found[i][0] for i in full], [found[i][1] for i in full] if weighted else None)
                for i, key, two in zip(full, band_keys(sig, bands, rows), sketches(sig)):
                    keys[i], short[i] = key, two
            names = [
                int((mix(h) * (mix(c.astype(_U)) | _U(1) if weighted else _U(1))).sum(dtype=_U).astype(np.int64)) if len(h) else None
                for h, c in found
            ]
            elements = [(h >> _U(32)).astype(np.uint32).view(np.int32) for h, _ in found]
            return pd.DataFrame(
                {
                    "doc_id": pd.array(ids, "Int64"),
                    "node": pd.array(names, "Int64"),
                    "n": pd.array([len(h) for h, _ in found], "Int32"),
                    "bands": keys,
                    "sketch": short,
                    "elements": elements,
                    "counts": [c.astype(np.int32) for _, c in found] if weighted else [[]] * len(found),
                }
            )

        for batch in batches:
            ids, found, size = [], [], 0
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids.append(None if pd.isna(doc) else int(doc))
                found.append(shingles(text or "", words))
                size += len(found[-1][0])
                if size > 100_000 or len(found) >= 256:
                    yield signed(ids, found)
                    ids, found, size = [], [], 0
            if found:
                yield signed(ids, found)

    return run


def sign_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    weighted: bool = False,
) -> DataFrame:
    """doc_id, node (hash of the element set), n, bands, sketch, elements, counts (of elements, if weighted)."""
    src = slim_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, node long, n int, bands array<long>, sketch array<long>, elements array<int>, counts array<int>"
    return src.mapInPandas(tidy(_signer(words, bands, rows, weighted)), schema)


def pairs_by_difference(posts: DataFrame, elements: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): candidates for all links between different components among the nodes of a head.

    posts: head, its component ``most``, node, comp. elements: node and its elements. With D the elements that a node has and its head
    hasn't, or the other way round, two nodes differ in |Dx| + |Dy| - 2 |Dx & Dy| elements, and they link if that is at most
    (1 - similarity) / (1 + similarity) of their sizes' sum. If x doesn't link with the head, Dx is so large that
    x and y have to share differences, which gives the least number c of those: then one of the |D| - c + 1 rarest of
    each is common to both. Copies that were changed in places of their own share none, however many they are.
    Nodes that link with the head are paired with it alone: among them there are no two components left.
    """
    t = (1 - similarity) / (1 + similarity) + 1e-9
    own = elements.select("node", F.array_distinct("elements").alias("elements"))
    both = posts.select("head", "most", "node", "comp").distinct().where("node <> head").join(own, "node")
    both = both.join(own.select(F.col("node").alias("head"), F.col("elements").alias("other")), "head")
    diff = F.concat(F.array_except("elements", "other"), F.array_except("other", "elements"))
    both = both.select("head", "most", "node", "comp", F.size("elements").alias("n"), F.size("other").alias("m"), diff.alias("diff"))
    both = both.withColumn("d", F.size("diff")).withColumn("over", F.col("d") - t * (F.col("n") + F.col("m")))
    both = scratch.write(both.drop("m"), "differences")
    single = both.select("head", "node", "comp", "n", "d", "over", F.explode("diff").alias("e"))
    shared = single.groupBy("head", "e").agg(F.count("*").alias("many")).where("many > 1")
    ranked = single.join(shared, ["head", "e"]).groupBy("head", "node", "comp", "n", "d", "over").agg(F.sort_array(F.collect_list(F.struct("many", "e"))).alias("own"))
    # differences that a node has alone come first and meet nothing
    ranked = ranked.select("head", "node", "comp", "n", "d", "over", F.size("own").alias("met"), F.posexplode("own").alias("at", "x"))
    ranked = ranked.select("head", "node", "comp", "n", "d", "over", (F.col("d") - F.col("met") + F.col("at")).alias("at"), F.col("x.e").alias("e"))
    least = lambda c: F.greatest(F.lit(1), F.ceil(c / 2))
    ranked = scratch.write(ranked.where(F.col("at") <= F.col("d") - least(F.greatest("over", F.lit(0.0)))), "ranked")
    x, y = ranked.where("over > 0").alias("x"), ranked.alias("y")
    c = least(F.col("x.d") + F.col("y.d") - t * (F.col("x.n") + F.col("y.n")))
    found = x.join(y, (F.col("x.head") == F.col("y.head")) & (F.col("x.e") == F.col("y.e")))
    found = found.where("x.comp <> y.comp AND (y.over <= 0 OR x.node < y.node)").where((F.col("x.at") <= F.col("x.d") - c) & (F.col("y.at") <= F.col("y.d") - c))
    found = found.where(F.least("x.n", "y.n") >= F.lit(similarity - 1e-12) * F.greatest("x.n", "y.n"))
    direct = both.where("over <= 0 AND comp <> most").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return direct.union(found.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    words: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    weighted: bool = False,
) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its group), class_size."""
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.write(sign_documents(docs, id_col, text_col, words, bands, rows, weighted), "signed")
    # one row stands for all with the same elements
    row = F.xxhash64("node", "doc_id")
    sets = scratch.write(
        signed.where("node IS NOT NULL").groupBy("node").agg(F.min(row).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands")), "sets"
    )
    posts = sets.select(F.posexplode("bands").alias("band", "key"), "node", "n").select("key", "node", "n", "band")
    longs = -(-bands * rows // PER_LONG)
    least = sketch_agreement(bands * rows, similarity)

    def agree(x, y):
        low = F.lit(0x5555555555555555)
        apart = F.lit(0)
        for i in range(longs):  # coordinates that differ in either bit
            odd = x(f"s{i}").bitwiseXOR(y(f"s{i}"))
            apart = apart + F.bit_count(odd.bitwiseOR(F.shiftright(odd, 1)).bitwiseAND(low))
        return apart <= bands * rows - least

    whole = signed.where("node IS NOT NULL").withColumn("row", row)
    table = whole.select("node", "row", *[F.col("sketch")[i].alias(f"s{i}") for i in range(longs)])

    def of_pairs(rows_: DataFrame, pairs: DataFrame, cols: list[str], name: str) -> DataFrame:
        """The columns of each node of the pairs, from one row each."""
        used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(sets.select("node", "row"), "node").select("row")
        own = bitmap_filter(rows_, "row", used).groupBy("node").agg(*[F.first(c).alias(c) for c in cols])
        return scratch.write(own, name)

    def both_sides(pairs: DataFrame, own: DataFrame, cols: list[str]) -> DataFrame:
        side = lambda k: own.select(F.col("node").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in cols])
        return pairs.join(side("a"), "a").join(side("b"), "b")

    def verify(pairs: DataFrame, agreed: bool) -> DataFrame:
        near = pairs
        if not agreed:
            short = [f"s{i}" for i in range(longs)]
            own = of_pairs(table, pairs, short, "sketches")
            near = both_sides(pairs, own, short).where(agree(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))).select("a", "b")
            near = scratch.write(near, "near")
        own = of_pairs(whole, near, ["elements", "counts"], "elements")
        both = both_sides(near, own, ["elements", "counts"])
        if weighted:
            common = F.expr(
                "aggregate(map_values(map_zip_with(map_from_arrays(a_elements, a_counts), map_from_arrays(b_elements, b_counts),"
                " (k, x, y) -> least(coalesce(x, 0), coalesce(y, 0)))), 0D, (s, v) -> s + v)"
            )
            total = F.expr("aggregate(a_counts, 0D, (s, v) -> s + v) + aggregate(b_counts, 0D, (s, v) -> s + v)")
        else:
            common = F.size(F.array_intersect("a_elements", "b_elements"))
            total = F.size("a_elements") + F.size("b_elements")
        found = both.withColumn("common", common).withColumn("total", total)
        return found.where(F.col("common") >= F.lit(similarity - 1e-12) * (F.col("total") - F.col("common"))).select("a", "b")

    def sizes_fit(x, y):
        if weighted:
            return F.lit(True)
        return F.least(x("n"), y("n")) >= F.lit(similarity - 1e-12) * F.greatest(x("n"), y("n"))

    def met(x, y):
        before = lambda z: F.slice(z("bands"), F.lit(1), z("band"))
        return F.exists(F.zip_with(before(x), before(y), lambda p, q: p == q), lambda same: same)

    def differing(posts_: DataFrame) -> DataFrame:
        pairs = posts_.select(F.col("head").alias("a"), F.col("node").alias("b"))
        own = of_pairs(whole, pairs, ["elements", "counts"], "members")
        if weighted:  # the i-th of an element is an element
            every = F.transform(F.arrays_zip("elements", "counts"), lambda z: F.transform(F.sequence(F.lit(1), z["counts"]), lambda i: F.xxhash64(z["elements"], i)))
            own = own.select("node", F.flatten(every).alias("elements"))
        return pairs_by_difference(posts_, own.select("node", "elements"), similarity, scratch)

    first = F.col("band") < max(1, bands // 5)
    details = whole.select("node", "bands", *[F.col("sketch")[i].alias(f"s{i}") for i in range(longs)])
    roots = link_buckets(posts, sizes_fit, verify, scratch, first, (details, agree, met), keys=sets.select(F.col("bands").alias("key")), differing=differing)
    placed = (
        signed.select("doc_id", "node")
        .join(roots, "node", "left")
        .select("doc_id", F.coalesce("root", "node").alias("root"))
    )
    placed = scratch.write(placed, "placed")
    scratch.keep_only(placed)
    groups = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return placed.join(groups, "root", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size")
    )
