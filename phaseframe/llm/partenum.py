"""Jaccard join of documents on n-gram sets by PartEnum signatures.

A document's set holds its distinct runs of three words. Sets are put into bands
of size [l, l / similarity]: similar sets lie in one band or in neighbours, so
a set takes part in its own band's scheme and in the next one's. Under a scheme two
similar sets differ in at most k elements. The hash domain is cut into n1
parts, one of which holds at most k2 = k // n1 of the differences, and each part into
n2; every choice of n2 - k2 of them is a signature, the hash of the set's elements
there. Two similar sets of a band hence share a signature with certainty. n1,
k2 and n2 are the cheapest for which a signature is expected to hold
``LEAST_ELEMENTS`` elements, since signatures of few elements meet by chance.

Candidates pass an exact necessary condition (the parities of elements by 512
hashed places differ in no more places than the sets in elements) and are then
verified on the sets themselves.

Scale: documents of equal sets are one node from the start, whatever their
number. Signatures that stand alone are dropped before any of them is joined. Of a
bucket not all pairs are made: each node is first tried against one leader, then, while
buckets hold several components, against a member of the largest; at last all pairs of
different components in a bucket that meet the condition are verified, so no
link between different components is lost. Sets are written only for nodes that share a
signature. Components are found in written rounds; nothing of the documents
reaches the driver.

Defined results: a text of fewer words has its whole word sequence as its one
element; texts without words (null, empty) have none and are linked with
nothing; every row is returned, rows that share an id or have none too; the
component is named by its smallest id that isn't null; an empty table gives no
rows; extra columns are ignored. Elements, words and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.llm.common import Scratch, bitmap_filter, connected_components, narrow_batches, once_per_key, repeated_keys, slim_batches, tidy
from phaseframe.llm.minhash import mix

WORDS = 3
PERCENT = 90
#: Elements that a signature is expected to hold at least, where the size of the sets allows it.
LEAST_ELEMENTS = 11
#: Longs of a set's parities.
PARITY_LONGS = 8
#: Rounds in which a node is tried against one other before all pairs of different components are.
HOOKS = 3

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
#: What tells the parts of a partition apart in a signature.
_PART = mix(np.arange(1, 9, dtype=_U) * _U(0xD6E8FEB86659FD93))


def elements(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct elements of a text as hashes in increasing order."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, _U)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, ws), _U, len(ws))
    n = min(words, len(ws))
    h = np.full(len(codes) - n + 1, n, _U)
    for j in range(n):
        h = mix(h * _ODD + codes[j : j + len(h)])
    return np.unique(h)


def set_name(found: np.ndarray) -> int:
    return int(mix(found).sum(dtype=_U).astype(np.int64))


@lru_cache(maxsize=None)
def bands(percent: int, size: int) -> tuple[tuple[int, int], ...]:
    """(smallest, largest) size of each band, up to the one after that of ``size``."""
    out = [(1, 100 // percent)]
    while out[-1][0] <= size:
        low = out[-1][1] + 1
        out.append((low, low * 100 // percent))
    return tuple(out)


@lru_cache(maxsize=None)
def scheme(differ: int, size: int) -> tuple[int, int, int]:
    """(n1, n2, k2) for sets of at least ``size`` elements that differ in at most ``differ``."""
    options = []
    for k2 in range(min(differ, 3) + 1):
        n1 = -(-(differ + 1) // (k2 + 1))
        for n2 in range(k2 + 1, k2 + 5):
            held = size * (n2 - k2) / (n2 * n1)
            options.append((held < LEAST_ELEMENTS, n1 * math.comb(n2, k2) if held >= LEAST_ELEMENTS else -held, n1, n2, k2))
    return min(options)[2:]


@lru_cache(maxsize=None)
def choices(n: int, k: int) -> np.ndarray:
    """The choices of ``k`` of ``n`` as rows of zeros and ones."""
    out = np.zeros((math.comb(n, k), n), _U)
    for row, parts in zip(out, itertools.combinations(range(n), k)):
        row[list(parts)] = 1
    return out


def signatures(found: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The bucket keys of a non-empty set, under its own band's scheme and the next one's."""
    table = bands(percent, 1 << max(len(found), 1).bit_length())
    own = next(i for i, (_, high) in enumerate(table) if len(found) <= high)
    sums = np.concatenate([[_U(0)], np.cumsum(mix(found ^ _ODD), dtype=_U)])
    out = []
    for tag in (own, own + 1):
        differ = 2 * table[tag][1] * (100 - percent) // (100 + percent)
        n1, n2, k2 = scheme(differ, table[max(tag - 1, 0)][0])
        cells = n1 * n2
        # parts are ranges of hashes
        borders = (np.arange(1, cells, dtype=_U) * _U((1 << 64) // cells)) if cells > 1 else np.empty(0, _U)
        ends = np.concatenate([[0], np.searchsorted(found, borders), [len(found)]])
        cell = mix((sums[ends[1:]] - sums[ends[:-1]]).reshape(n1, n2) + _PART[:n2])
        chosen = choices(n2, n2 - k2)
        place = np.arange(n1 * len(chosen), dtype=_U).reshape(n1, -1) * _ODD + _U(tag * 0x1F123BB5 + 1)
        out.append(mix(place + (cell[:, None, :] * chosen).sum(axis=2, dtype=_U)).ravel())
    return np.concatenate(out).view(np.int64)


def parities(found: np.ndarray) -> np.ndarray:
    """The parity of the number of elements by hashed place, as longs."""
    place = (mix(found + _ODD) >> _U(55)).astype(np.int64) % (64 * PARITY_LONGS)
    odd = (np.bincount(place, minlength=64 * PARITY_LONGS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _sign(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, odd = [], [], [], []
            for text in batch.column("text"):
                found = elements(text.as_py(), words)
                sizes.append(len(found))
                nodes.append(set_name(found) if len(found) else None)
                keys.append(signatures(found, percent) if len(found) else np.empty(0, np.int64))
                odd.append(parities(found))
            flat = lambda parts: pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(list(map(len, parts)))]).astype(np.int32)), pa.array(np.concatenate(parts or [np.empty(0, np.int64)]))
            )
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), flat(keys), flat(odd)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "node", "n", "keys", "odd"])

    return run


def _sets(words: int):
    """(node, elements), each text of a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, found = [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                if row not in seen:
                    seen.add(row)
                    own = elements(text.as_py(), words)
                    if len(own):
                        nodes.append(set_name(own))
                        found.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["node", "elements"])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; sets are linked where 100 * common >= ``percent`` * united."""
    scratch = Scratch(docs.sparkSession, "partenum")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = slim_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))
    signed = scratch.write(source.mapInArrow(tidy(_sign(words, percent)), "doc_id long, row long, node long, n long, keys array<long>, odd array<long>"), "signed")
    full = signed.where("node IS NOT NULL")
    nodes = scratch.write(once_per_key(full.select("node", "row", "n", "keys", "odd"), "node", scratch), "nodes")
    links = _links(source, nodes, scratch, words, percent)
    roots = scratch.write(connected_components(links, scratch), "roots")

    # the smallest id of a node, then of a component; most nodes are alone in theirs
    least = full.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    linked = scratch.write(least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "linked")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("rows")).where("rows > 1")
    names = linked.select("node", "root").join(names.select("root", "component_id"), "root").select("node", "component_id")
    placed = signed.select("doc_id", "n", "node").join(names, "node", "left")
    out = scratch.write(placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "placed")
    scratch.keep_only(out)
    return out


def _links(source: DataFrame, nodes: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of similar nodes, enough of them to connect every component of similar nodes."""
    odd = [f"s{i}" for i in range(PARITY_LONGS)]
    with narrow_batches(scratch.spark):
        shared = scratch.write(repeated_keys(nodes.select(F.col("keys").alias("key"))), "shared")
    posts = nodes.select(F.explode("keys").alias("key"), "node", "n", *[F.col("odd")[i].alias(s) for i, s in enumerate(odd)])
    buckets = scratch.write(bitmap_filter(posts, "key", shared).join(shared, "key"), "buckets")

    # the sets of nodes in buckets, from one of their rows each
    used = nodes.join(buckets.select("node").distinct(), "node").select("node", "row")
    used = scratch.write(used, "used")
    texts = bitmap_filter(source.select("row", "text"), "row", used.select("row"))
    own = texts.mapInArrow(tidy(_sets(words)), "node long, elements array<long>").join(used.select("node"), "node")
    sets = scratch.write(own.groupBy("node").agg(F.first("elements").alias("elements")), "sets")

    def fits(x: str, y: str):
        """Whether the sizes and parities of two posts allow the similarity."""
        both = F.col(f"{x}.n") + F.col(f"{y}.n")
        apart = sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in odd), F.lit(0))
        sizes = F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * percent
        return sizes & (apart * (100 + percent) <= both * (100 - percent))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        side = lambda k: sets.select(F.col("node").alias(k), F.col("elements").alias(f"of_{k}"))
        common = F.size(F.array_intersect("of_a", "of_b")).cast("long")
        both = F.size("of_a") + F.size("of_b")
        return scratch.write(pairs.join(side("a"), "a").join(side("b"), "b").where(common * 100 >= (both - common) * percent).select("a", "b"), name)

    # each node with the leader of one of its buckets
    post = F.struct("node", "n", *odd)
    lead = buckets.groupBy("key").agg(F.min(post).alias("y"))
    found = buckets.select("key", post.alias("x")).join(lead, "key").where((F.col("x.node") != F.col("y.node")) & fits("x", "y"))
    tried = scratch.write(found.groupBy(F.col("x.node").alias("b")).agg(F.min("y.node").alias("a")).select("a", "b"), "hooks")
    links = verified(tried, "links")
    for turn in range(1, HOOKS + 1):
        last = turn == HOOKS
        roots = scratch.write(connected_components(links, scratch), "roots")
        placed = buckets.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        several = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        before, buckets = buckets, scratch.write(placed.join(several, "key"), "mixed")
        scratch.drop(before)
        if buckets.isEmpty():
            break
        if last:
            pairs = buckets.select("key", "comp", post.alias("x")).join(buckets.select("key", F.col("comp").alias("other"), post.alias("y")), "key")
            pairs = pairs.where((F.col("comp") != F.col("other")) & (F.col("x.node") < F.col("y.node")) & fits("x", "y"))
            pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        else:
            drawn = F.struct(F.xxhash64("node", F.lit(turn)), post.alias("post"))
            counts = buckets.groupBy("key", "comp").agg(F.count("*").alias("members"), F.min(drawn)["post"].alias("y"))
            most = counts.groupBy("key").agg(F.max(F.struct("members", "comp", "y")).alias("most"))
            most = most.select("key", F.col("most.comp").alias("largest"), F.col("most.y").alias("y"))
            found = buckets.select("key", "comp", post.alias("x")).join(most, "key").where((F.col("comp") != F.col("largest")) & fits("x", "y"))
            found = found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.col("x.node").alias("node"), "comp")
            found = found.join(tried, ["a", "b"], "left_anti")
            pairs = found.groupBy("node").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b").distinct()
        pairs = scratch.write(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        buckets = buckets.drop("comp")
        if pairs.isEmpty():
            if last:
                break
            continue
        tried = tried.unionByName(pairs)
        links = links.unionByName(verified(pairs, "links"))
    return links
