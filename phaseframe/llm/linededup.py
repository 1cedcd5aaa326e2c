"""Fuzzy line deduplication over a whole corpus.

Lines are normalised: lower case, words of a-z, 0-9 and characters beyond ASCII,
single spaces. Equal lines are one node by a 64-bit hash. Two lines are linked if
their normalised edit similarity is at least ``similarity``, and of every
connected group of lines the first occurrence in the corpus stays: that
in the document with the smallest id, then the first line.

Candidates of lines of ``SHORT`` characters and more are joined on blocks of their
word hashes: under each of ``BANDS`` orders of all words, in which long words tend to
come first, a line posts the first word of its begin, its middle and its end. (Lines that
share a passage and differ around it have few posts in common.) Posts that meet are held against each other by a
bit of each such word; where more than a bucket's leader is tried, by the SimHash of their lines, within a
wide ``RADIUS``, and by the words' places; and by counts of pairs of characters before edits are counted. (Blocks
of the SimHash itself can't find these pairs: one changed word in a line of ten moves
eight bits of 64, and blocks narrow enough for eight bits hold every line; the README has
figures.) A pair with a shorter line is always found: the longer one is cut into one
piece more than the edits that its length allows, so one piece stands unchanged in the
other line, and near its place.

Scale: a frequent line is one node, combined map-side; buckets are resolved by
``link_buckets`` without making all pairs of a group; the posts that meet in no
bucket are mostly held back by a bitmap of fixed size before the exchange. Texts of
lines that meet are exchanged, and once the whole texts of which lines go.

Defined results: lines without a word are never dropped; lines are
split at line feeds and the others keep their order; a text of which nothing
stays is empty; null texts are empty; rows equal in id and text count as one
document and get the same result; a null id sorts last; an empty table gives no
rows; all other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseframe.llm.common import KeyMap, Scratch, bitmap_filter, link_buckets, narrow_batches, once_per_key, slim_batches, split_by_ids, tidy

SIMILARITY = 0.9
SHORT = 54
BANDS, PARTS = 20, 3
FEW = 16
#: Bits of PARTS * BANDS that the sketches of near lines may differ in: of unrelated ones half do.
SKETCH = 22
#: Of eight groups of bands, those whose posts are paired with a leader first.
EARLY = 3
#: Bits of 64 that the SimHashes of near lines may differ in: of unrelated ones half do.
RADIUS = 28
#: Weights of words in the SimHash are their lengths, up to this.
HEAVIEST = 8

#: Bytes of lower-case UTF-8 text: letters, digits and what isn't ASCII stay, line feeds too, the rest is space.
_WORDS = bytes(c if c == 10 or chr(c).isdigit() or chr(c).islower() or c > 127 else 32 for c in range(256))
_U = np.uint64
_FULL = np.uint32(0xFFFFFFFF)
#: How much later words of so many bytes come in the orders, as most short words stand in a large share of all
#: lines: in lines of at most FEW words, of which no one may decide too much, and in others.
_LATER = np.array([[6, 6, 4, 3, 2] + [1] * 12, [64, 64, 32, 12, 4] + [1] * 12], np.uint32)


def simhash(words: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SimHash of runs of weighted 32-bit word hashes, the runs beginning at ``starts``."""
    x = words.astype(_U) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits * weights.astype(np.uint8)[:, None], starts, axis=0, dtype=np.int32)
    total = np.add.reduceat(weights.astype(np.int64), starts)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def line_weights(lengths: np.ndarray) -> np.ndarray:
    """Weights of a line's distinct words in its SimHash: their lengths up to ``HEAVIEST``,
    so that short function words don't make all lines of a language alike."""
    return np.minimum(lengths, HEAVIEST)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel over the part between the common ends."""
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") for s in (a, b))
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(x[len(x) - n + head :][::-1] != y[len(y) - n + head :][::-1])
    tail = int(differ[0]) if len(differ) else n - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    m = len(a)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m  # columns of +1 and -1 steps down the table
    for c in b:
        eq = at.get(c, 0)
        down = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, low = minus | (full & ~(across | plus)), plus & across
        score += bool(up & top) - bool(low & top)
        up = (up << 1 | 1) & full
        plus = (low << 1 & full) | (full & ~(down | up))
        minus = up & down
    return score


def _most(length: int, similarity: float) -> int:
    """Edits that a pair may have whose longer line has ``length`` characters."""
    return int(length * (1 - similarity) + 1e-9)


def may_be_near(a: str, b: str, most: int) -> bool:
    """Whether the lengths and the counts of pairs of characters allow for ``most`` edits: each one changes four counts at most."""
    if abs(len(a) - len(b)) > most:
        return False
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") for s in (a, b))
    x, y = (np.bincount((c[:-1] * np.uint32(31) + c[1:]) & np.uint32(1023), minlength=1024) for c in (x, y))
    return int(np.abs(x - y).sum()) <= 4 * most


def _line_rows():
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # of a task; a line's text goes out once
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.iloc[lo : lo + 64]
                doc, no, name, length, norms = [], [], [], [], []
                for k, text in enumerate(part["text"]):
                    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(_WORDS)
                    for i, line in enumerate(raw.split(b"\n")):
                        words = line.split()
                        if not words:
                            continue
                        norm = b" ".join(words)
                        node = xxhash.xxh3_64_intdigest(norm)
                        norm = norm.decode("utf-8", "replace")
                        doc.append(k)
                        no.append(i)
                        name.append(node)
                        length.append(len(norm))
                        norms.append(None if node in seen else norm)
                        seen.add(node)
                if not doc:
                    continue
                yield pd.DataFrame(
                    {
                        "key": part["key"].to_numpy()[doc],
                        "at": part["at"].to_numpy()[doc],
                        "line": np.array(no, np.int32),
                        "node": np.array(name, np.uint64).view(np.int64),
                        "length": np.array(length, np.int32),
                        "norm": norms,
                    }
                )

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x94D049BB133111EB)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _words_of(norms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and last-but-one bytes of the words of lines, the first word of each line, and how many it has.

    A hash is made of a word's first and last eight bytes and its length.
    """
    data = "\n".join(norms).encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    stop = np.append(np.flatnonzero((raw == 32) | (raw == 10)), len(raw))
    size = np.diff(stop, prepend=-1) - 1
    eight = np.ndarray(len(raw) + 9, "<u8", bytes(8) + data + bytes(9), strides=(1,))  # the eight bytes before each place, and there
    spare = (8 - np.minimum(size, 8)).astype(_U) * _U(8)
    spare = np.minimum(spare, _U(63))
    head, tail = (eight[stop - size + 8] << spare) >> spare, eight[stop] >> spare
    codes = (head * _U(0x9E3779B97F4A7C15)) ^ _mixed(tail + size.astype(_U))
    last = np.append(np.flatnonzero(raw[stop[:-1]] == 10), len(stop) - 1)
    counts = np.diff(last, prepend=-1)
    return codes, stop, last - counts + 1, counts


def _orders(codes: np.ndarray, stop: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each band the places of all words in its orders, and the first word of each part of the lines.

    A band has an order of all words for each part, so that a frequent word that is early in one isn't in the others.
    """
    later = _LATER[np.repeat(counts > FEW, counts).view(np.int8), np.minimum(np.diff(stop, prepend=-1) - 1, _LATER.shape[1] - 1)]
    spread = (_mixed(codes) >> _U(32)).astype(np.uint32)
    odd = (_mixed(np.arange(1, BANDS * PARTS + 1, dtype=_U)) | _U(1)).astype(np.uint32).reshape(BANDS, PARTS)
    # begin and end are thirds of short lines, fifths of long ones
    edge = np.maximum(counts // 5, np.minimum(counts // 3, 7))
    parts = np.stack([starts, starts + edge, starts + counts - np.maximum(edge, 1)], axis=1).ravel()
    part = np.repeat(np.tile(np.arange(PARTS), len(starts)), np.diff(parts, append=len(codes)))
    for band in range(BANDS):
        place = spread * odd[band][part]
        place >>= np.uint32(6)
        place *= later
        yield place, parts


def band_keys(norms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lines, BANDS) keys of lines by the first word of each part: the lowest bit is 0, the next three number
    the band. And a bit of each of those words, together a sketch of the line."""
    words = _words_of(norms)
    out, bits = np.empty((len(norms), BANDS), _U), np.zeros(len(norms), _U)
    for band, (place, parts) in enumerate(_orders(*words)):
        first = np.minimum.reduceat(place, parts).reshape(-1, PARTS).astype(_U)
        key = np.full(len(norms), _U(band + 1))
        for n in range(PARTS):
            mixed = _mixed(first[:, n] + _U(1))
            key = _mixed(key * _U(0x9E3779B97F4A7C15) + mixed)
            bits |= (mixed >> _U(63)) << _U(band * PARTS + n)
        out[:, band] = key
    return (out & ~_U(15)) | (np.arange(BANDS, dtype=_U) % _U(8) << _U(1)), bits.view(np.int64)


#: Bits of a character's place in a line; longer lines give no places.
PLACE = 21


def band_places(norms: list[str]) -> np.ndarray:
    """(lines, BANDS) places of the words that made ``band_keys``, PLACE bits each."""
    codes, stop, starts, counts = _words_of(norms)
    raw = np.frombuffer("\n".join(norms).encode("utf-8", "surrogatepass"), np.uint8)
    chars = np.cumsum((raw & 0xC0) != 0x80)
    at = chars[stop - 1] - np.repeat(np.append(0, chars[stop[starts[1:] - 1]]), counts)  # where each word ends in its line
    number = np.arange(len(codes), dtype=_U)
    out = np.empty((len(norms), BANDS), np.int64)
    for band, (place, parts) in enumerate(_orders(codes, stop, starts, counts)):
        first = np.minimum.reduceat((place.astype(_U) << _U(32)) | number, parts) & _U(0xFFFFFFFF)
        where = at[first.astype(np.int64)].reshape(-1, PARTS)
        out[:, band] = (where << (PLACE * np.arange(PARTS))).sum(axis=1)
    out[np.fromiter(map(len, norms), np.int64, len(norms)) >= 1 << PLACE] = -1
    return out


def _short_keys(norm: str, similarity: float) -> set[int]:
    """Keys of pieces for pairs of lines of which the shorter has less than ``SHORT`` characters.

    A line posts its own pieces, and what equals a piece of a line as long or
    longer if the edits before it are at most as many as the pieces before it, and
    so after it: of one piece more than edits, some piece meets both.
    """
    import xxhash

    n, keys = len(norm), set()
    for length in range(n, int((n + 1) / similarity) + 2):
        most = _most(length, similarity)
        if length - most > min(n, SHORT - 1):
            break
        if most == 0 or (n >= SHORT and length > n):
            continue
        width, wide = divmod(length, most + 1)
        start = 0
        for i in range(most + 1):
            size = width + (i > most - wide)
            for at in range(max(0, start - i), min(n - size, start + i) + 1):
                if abs(start - at - (length - n)) <= most - i:
                    keys.add(xxhash.xxh3_64_intdigest(norm[at : at + size].encode("utf-8", "surrogatepass"), length << 8 | i))
            start += size
    return keys


def line_keys(norms: list[str], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, sketch) of the posts of normalised lines. Keys of pieces of short lines are odd; their sketches are
    maps of pairs of characters."""
    lengths = np.fromiter(map(len, norms), np.int64, len(norms))
    long = np.flatnonzero(lengths >= SHORT)
    owners, keys, sketches = [np.repeat(long, BANDS)], [], []
    if len(long):
        own, bits = band_keys([norms[k] for k in long])
        keys.append(own.ravel())
        sketches.append(np.repeat(bits, BANDS))
    short = np.flatnonzero(lengths - (lengths * (1 - similarity)).astype(int) <= SHORT)
    pieces = [_short_keys(norms[k], similarity) for k in short]
    sizes = [len(x) for x in pieces]
    owners.append(np.repeat(short, sizes))
    keys.append(np.array([x for own in pieces for x in own], _U) | _U(1))
    sketches.append(np.repeat(pair_maps([norms[k] for k in short]), sizes) if len(short) else np.empty(0, np.int64))
    line = np.concatenate(owners)
    order = np.argsort(line, kind="stable")
    return line[order], np.concatenate(keys).view(np.int64)[order], np.concatenate(sketches)[order]


def line_sketches(norms: list[str]) -> np.ndarray:
    """SimHashes of lines, of their distinct words."""
    codes, stop, starts, counts = _words_of(norms)
    lengths = np.diff(stop, prepend=-1) - 1
    owner = np.repeat(np.arange(len(norms)), counts)
    order = np.lexsort((codes, owner))
    same = np.zeros(len(codes), bool)
    same[1:] = (owner[order][1:] == owner[order][:-1]) & (codes[order][1:] == codes[order][:-1])
    own = order[~same]  # distinct words of each line
    sims = simhash(codes[own], line_weights(lengths[own]), np.searchsorted(owner[own], np.arange(len(norms))))
    return sims.view(np.int64)


def pair_maps(norms: list[str]) -> np.ndarray:
    """64-bit maps of the pairs of neighbouring characters of lines."""
    size = np.fromiter(map(len, norms), np.int64, len(norms))
    chars = np.frombuffer("".join(f"{x}\n" for x in norms).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
    begin = np.cumsum(size + 1) - size - 1
    twos = chars.copy()
    twos[:-1] = chars[:-1] * _U(0x9E3779B97F4A7C15) + chars[1:]
    twos[begin + size] = twos[begin]
    return np.bitwise_or.reduceat(_U(1) << (_mixed(twos) >> _U(58)), begin).view(np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of some hundred thousand characters, small enough for a processor's cache."""
    lo, size, lengths = 0, 0, batch.column("length").to_numpy(zero_copy_only=False)
    for hi in range(1, len(lengths) + 1):
        size += lengths[hi - 1]
        if size > 200_000 or hi == len(lengths):
            yield batch.slice(lo, hi - lo)
            lo, size = hi, 0


def _with_keys(similarity: float):
    """Lines with their keys, and the sketches of both kinds of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in _slices(b)):
            line, key, sketch = line_keys(batch.column("norm").to_pylist(), similarity)
            ends = np.cumsum(np.bincount(line, minlength=len(batch)))
            keys = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(key))
            two = np.zeros((2, len(batch)), np.int64)
            two[key & 1, line] = sketch
            arrays = [batch.column("node"), batch.column("length"), *map(pa.array, two), keys]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "length", "bits", "map", "keys"])

    return run


def _posts(shared):
    """Posts whose key is in the broadcast map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            key = keys.flatten().to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(shared.value.has(key))
            line, key = np.repeat(np.arange(len(batch)), np.diff(keys.offsets.to_numpy()))[hit], key[hit]
            node, length, bits, maps = (batch.column(c).to_numpy(zero_copy_only=False)[line] for c in ("node", "length", "bits", "map"))
            arrays = (key, node, length, np.where(key & 1, maps, bits))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "node", "length", "bits"])

    return run


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posts of lines (node, norm, posts of key and more) with the SimHash of the line and the places of a key's words."""
    for batch in (x for b in batches for x in _slices(b)):
        posts, norms = batch.column("posts"), batch.column("norm").to_pylist()
        own = posts.flatten()
        key = own.field("key").to_numpy(zero_copy_only=False)
        line = np.repeat(np.arange(len(batch)), np.diff(posts.offsets.to_numpy()))
        sims, at, number = np.zeros(len(key), np.int64), np.full(len(key), -1), np.zeros(len(key), np.int32)
        bands = np.zeros((len(norms), BANDS), np.int32)  # half of each band's key
        band = np.flatnonzero((key & 1) == 0)
        if len(band):
            these, which = np.unique(line[band], return_inverse=True)
            texts = [norms[k] for k in these]
            sims[band] = line_sketches(texts)[which]
            every = band_keys(texts)[0].view(np.int64)
            bands[these] = (every >> 32).astype(np.int32)
            number[band] = np.argmax(every[which] == key[band][:, None], axis=1)
            at[band] = band_places(texts)[which, number[band]]
        node, length = (batch.column(c).to_numpy(zero_copy_only=False)[line] for c in ("node", "length"))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * BANDS), pa.array(bands[line].ravel()))
        arrays = [pa.array(key), pa.array(node), pa.array(length), own.field("bits"), pa.array(sims), pa.array(at), pa.array(number), lists]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "node", "length", "bits", "sim", "at", "band", "bands"])


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``docs`` with the text less its repeated lines, and n_lines, n_dropped (lines before, lines dropped)."""
    scratch = Scratch(docs.sparkSession, "lines")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(F.col(id_col), text)
    last = F.lit(2**63 - 1)
    src = slim_batches(docs).select(key.alias("key"), F.coalesce(F.col(id_col).cast("long"), last).alias("at"), text.alias("text"))
    lines = scratch.write(
        src.mapInPandas(tidy(_line_rows()), "key long, at long, line int, node long, length int, norm string"), "lines"
    )

    texts = lines.where("norm IS NOT NULL").select("node", "length", "norm")  # of a node once in each task that has it
    keyed = once_per_key(texts, "node", scratch).mapInArrow(tidy(_with_keys(similarity)), "node long, length int, bits long, map long, keys array<long>")
    keyed = scratch.write(keyed, "keyed")

    def texts_of(nodes: DataFrame, name: str) -> DataFrame:
        """node, length and norm of the nodes."""
        return scratch.write(bitmap_filter(texts, "node", nodes).join(nodes, "node").dropDuplicates(["node"]), name)

    def narrowed() -> DataFrame:
        with narrow_batches(docs.sparkSession):
            shared = KeyMap(keyed.select(F.col("keys").alias("key")), keyed.agg(F.sum(F.size("keys"))).first()[0] or 0)
        shared = docs.sparkSession.sparkContext.broadcast(shared)
        return keyed.mapInArrow(tidy(_posts(shared)), "key long, node long, length int, bits long")

    def described(some: DataFrame) -> DataFrame:
        of_node = scratch.write(some.groupBy("node").agg(F.collect_list(F.struct("key", "bits")).alias("posts")), "of_node")
        both = texts_of(of_node.select("node"), "near").join(of_node, "node")
        return both.mapInArrow(tidy(_described), "key long, node long, length int, bits long, sim long, at long, band int, bands array<int>")

    def most(x, y) -> Column:
        return F.floor(F.greatest(x("length"), y("length")) * F.lit(1 - similarity) + F.lit(1e-9))

    def alike_in_short(x, y) -> Column:
        """What lines within the edits that their length allows have in common: their lengths, and a sketch."""
        apart, piece = F.bit_count(x("bits").bitwiseXOR(y("bits"))), x("key").bitwiseAND(F.lit(1)) == 1
        return (F.abs(x("length") - y("length")) <= most(x, y)) & (apart <= F.when(piece, 4 * most(x, y)).otherwise(SKETCH))

    def near(x, y) -> Column:
        """Further the SimHash, and the distances between the words of a key, from the line's begin to its end."""
        place = lambda z, n: F.shiftright(z("at"), PLACE * n).bitwiseAND(F.lit((1 << PLACE) - 1))
        shifts = [F.lit(0), *(place(x, n) - place(y, n) for n in range(PARTS)), x("length") - y("length")]
        moved = sum((F.abs(b - a) for a, b in zip(shifts[1:], shifts[2:])), F.abs(shifts[1]))
        placed = (x("at") < 0) | (y("at") < 0) | (moved <= most(x, y))
        return alike_in_short(x, y) & placed & (F.bit_count(x("sim").bitwiseXOR(y("sim"))) <= RADIUS)

    def verify(pairs: DataFrame, _agreed: bool) -> DataFrame:
        used = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        own = texts_of(used, "texts")
        both = pairs.join(own.select(F.col("node").alias("a"), F.col("norm").alias("na")), "a").join(
            own.select(F.col("node").alias("b"), F.col("norm").alias("nb")), "b"
        )

        def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                limit = [_most(max(len(x), len(y)), similarity) for x, y in zip(batch["na"], batch["nb"])]
                ok = [may_be_near(x, y, n) and edit_distance(x, y) <= n for x, y, n in zip(batch["na"], batch["nb"], limit)]
                yield batch.loc[ok, ["a", "b"]]

        return both.mapInPandas(tidy(alike), "a long, b long")

    early = F.shiftrightunsigned("key", 1).bitwiseAND(F.lit(7)) < EARLY
    attrs = ["node", "length", "bits"]

    def met(x, y) -> Column:
        """Whether two lines share the key of an earlier band; pieces of short lines have no order."""
        before = lambda z: F.slice(z("bands"), F.lit(1), z("band"))
        return F.exists(F.zip_with(before(x), before(y), lambda p, q: p == q), lambda same: same)

    more = (described, near, [*attrs, "sim", "at", "band", "bands"], met)
    roots = link_buckets(None, alike_in_short, verify, scratch, early, attrs=attrs, narrowed=narrowed, described=more, apart=True)
    # the first occurrence of each group stays, for groups of two occurrences and more
    grouped = lines.select("node", "key", "at", "line").join(roots, "node", "left")
    grouped = grouped.select(F.coalesce("root", "node").alias("root"), "key", F.struct("at", "key", "line").alias("place"))
    firsts = grouped.groupBy("root").agg(F.min("place").alias("first"), F.count("*").alias("many")).where("many > 1")
    dropped = (
        grouped.join(firsts.select("root", "first"), "root")
        .where("place <> first")
        .groupBy("key")
        .agg(F.collect_set("place.line").alias("__dropped"))
    )
    dropped = scratch.write(dropped, "dropped")
    scratch.keep_only(dropped)
    kept_cols = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept_cols)])  # whatever their names
    # only texts of which something may go are dealt out
    some, whole = split_by_ids(docs.select(row.alias("row"), key.alias("key"), text.alias("text")), "key", dropped.select("key"))
    # at every size: the other side grows with the texts and isn't broadcast
    some = some.join(dropped.hint("merge"), "key", "left")
    out = some.unionByName(whole.withColumn("__dropped", F.lit(None).cast("array<int>"))).withColumn("lines", F.split("text", "\n", -1))
    kept = F.expr("transform(array_except(sequence(0, size(lines) - 1), __dropped), i -> lines[i])")
    new_text = F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select(
        *[new_text.alias(c) if c == text_col else F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(kept_cols)],
        F.size("lines").alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).alias("n_dropped"),
    )
