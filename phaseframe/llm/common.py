"""Shared plumbing of the training-data operators.

Intermediate results that are read more than once are written as Parquet to the
folder that ``spark.checkpoint.dir`` names. Every executor sees that folder, so
a lost executor costs a re-read and never the lineage behind the table.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseframe.sources.checkpoints import shared_folder


#: Rows of an Arrow batch: whole texts of a few kilobytes on average, so a batch is a few megabytes.
BATCH_ROWS = 1_000


def slim_batches(df: DataFrame) -> DataFrame:
    """``df``, after making sure that its session hands texts to Python in small batches.

    Spark's default of 10,000 rows makes batches of tens of megabytes of text, held
    several times on the way. A smaller setting of the session is left alone.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Returns freed memory of a Python worker to the system; workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """``run``, a function on batches, giving back memory when it has ended."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


@contextlib.contextmanager
def narrow_batches(spark: SparkSession, rows: int = 50_000):
    """Larger batches for rows of a few numbers, while something is executed inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Parquet tables in the shared folder, with lineage cut at each of them.

    ``write`` returns the table read back. ``drop`` removes one that nothing
    reads any more. What a lazily evaluated result still needs stays until the
    driver's interpreter ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/phaseframe-{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: list[str] = []
        atexit.register(self._delete, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}-{name}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._phaseframe_path = path
        self._paths.append(path)
        return table

    def keep_only(self, *tables: DataFrame) -> None:
        """Removes all tables but these, where nothing reads the others any more."""
        kept = {getattr(t, "_phaseframe_path", None) for t in tables}
        for path in self._paths:
            if path not in kept:
                self._delete(path)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            if path := getattr(table, "_phaseframe_path", None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already; the folder is scratch space
            pass


#: Edges that a task of ``connected_components`` holds before it merges them.
HELD_EDGES = 4_000_000
#: Edges for which a task is worth while.
MERGED_EDGES = 1_000_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of these edges that aren't the smallest of their component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := label[label], label):
            label = up
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as a star forest: each node once, beside the smallest node it is joined to here."""
    a, b, rows = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _forest(np.concatenate(a), np.concatenate(b))

    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        rows += len(batch)
        if rows > HELD_EDGES:
            node, root = merged()
            a, b, rows = [node], [root], len(node)
            if rows > HELD_EDGES // 2:
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])
                a, b, rows = [], [], 0
    if rows:
        node, root = merged()
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the
    smallest node of the component.

    Tasks first merge the edges of their own files, without an exchange, into star
    forests of bounded size, and again as long as what is left fits into fewer tasks: few
    edges meet in one task so and are done. What is more goes through rounds of large star and small star, each merged
    again as it is written, until all edges are stars: a chain of length n is flat
    after O(log n) rounds. Minima are partial aggregates joined back, hence a hub
    with most of the edges is combined map-side and split by the skew join; no
    group is collected. Each round is a written table. Nothing reaches the driver
    but a count. ``max_rounds`` is far beyond the logarithm of any table's rows.
    """

    def star(pairs: DataFrame) -> DataFrame:
        # pairs (u, v): one row per direction asked for
        low = pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        return pairs.join(low, "u").select(F.col("v").alias("x"), "m", "u")

    def merged(df: DataFrame, name: str) -> DataFrame:
        with narrow_batches(scratch.spark):
            return scratch.write(df.mapInArrow(tidy(_contract), "a long, b long"), name)

    def flat(df: DataFrame) -> bool:
        """Whether every node has one edge upwards at most, and none if there are edges down to it."""
        ends = df.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(df.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").isEmpty()

    cur = merged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "forest")
    tasks = cur.rdd.getNumPartitions()
    while tasks > 1 and (fewer := -(-cur.count() // MERGED_EDGES) or 1) < tasks:  # while they fit into fewer tasks
        tasks, before = fewer, cur
        cur = merged(before.coalesce(fewer), "forest")
        scratch.drop(before)
    if tasks == 1:  # one task has merged all
        max_rounds = 0
    for _ in range(max_rounds):
        if flat(cur):
            break
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select("b", "a"))
        large = star(both).where("x > u AND x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        small = star(large)
        pairs = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select("u", "m")).where("a <> b").distinct()
        before, cur = cur, merged(pairs, "round")
        scratch.drop(before)
    else:
        if max_rounds:
            raise RuntimeError("connected_components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select("b", "b").distinct())


def _unlike(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    return [next(x for k in range(len(taken) + 1) if (x := name + "_" * k).lower() not in taken) for name in names]


def _placed(df: DataFrame, column: str, bits: int) -> tuple[DataFrame, str, str]:
    """``df`` with the word and the bit of the column's values in a map of that many bits."""
    word, bit = _unlike(df, "__word", "__bit")
    at = F.pmod(F.col(column).cast("long"), F.lit(bits))
    return df.withColumn(word, F.floor(at / 64).cast("long")).withColumn(bit, (at % 64).cast("int")), word, bit


def _bit_words(wanted: DataFrame, column: str, bits: int) -> DataFrame:
    return (
        wanted.select(F.pmod(F.col(column), F.lit(bits)).alias("p"))
        .groupBy(F.expr("p div 64").alias("__word"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS int)))").alias("__mask"))
    )


def _hit(mask: str, bit: str):
    return F.expr(f"(shiftrightunsigned(`{mask}`, `{bit}`) & 1) = 1")


def _marked(df: DataFrame, column: str, words: DataFrame, bits: int, how: str) -> tuple[DataFrame, str]:
    """``df`` joined with the words of a map; the name of the mask's column and the hit as a condition."""
    out, word, bit = _placed(df, column, bits)
    (mask,) = _unlike(df, "__mask")
    words = words.select(F.col("__word").alias(word), F.col("__mask").alias(mask))
    return out.join(F.broadcast(words), word, how), _hit(mask, bit)


def bitmap_filter(df: DataFrame, column: str, wanted: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """Rows of ``df`` whose long ``column`` may be in the column of that name of ``wanted``.

    A map of ``bits`` bits is broadcast: at most bits / 64 rows, whatever the
    size of ``wanted``. No wanted row is lost; others pass with a chance that
    grows with the number of wanted values, so an exact join has to follow. It
    keeps most rows out of that join's exchange. Let that be an inner or outer
    join: the optimiser moves semi and anti joins below the one with the map.
    """
    out, hit = _marked(df, column, _bit_words(wanted, column, bits), bits, "inner")
    return out.where(hit).select(*[F.col(f"`{c}`") for c in df.columns])


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame, scratch: Scratch, bits: int = 1 << 24) -> DataFrame:
    """``docs`` without the rows whose id is in ``gone``; rows with a null id stay.

    Documents outside a bitmap of the gone ids pass without an exchange of their
    texts; only the others meet the exact anti join.
    """
    (name,) = _unlike(docs, "__gone")
    gone = scratch.write(gone.select(F.col(id_col).cast("long").alias(name)).where(F.col(name).isNotNull()).distinct(), "gone")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    out, hit = _marked(docs, id_col, _bit_words(gone, name, bits), bits, "left")
    hit = F.coalesce(hit, F.lit(False))
    missed, some = out.where(~hit).select(*cols), out.where(hit).select(*cols)
    # an outer join: the optimiser would move an anti join below the map's join, to all texts
    exact = some.join(gone, some[id_col].cast("long") == gone[name], "left").where(F.col(name).isNull()).select(*cols)
    return missed.unionByName(exact)


def split_by_ids(docs: DataFrame, id_col: str, wanted: DataFrame, bits: int = 1 << 24) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: rows whose long id may be in the column of that name of ``wanted``, and rows whose id isn't, by a bitmap."""
    out, hit = _marked(docs, id_col, _bit_words(wanted, id_col, bits), bits, "left")
    hit, cols = F.coalesce(hit, F.lit(False)), [F.col(f"`{c}`") for c in docs.columns]
    return out.where(hit).select(*cols), out.where(~hit).select(*cols)


def once_per_key(df: DataFrame, key: str, scratch: Scratch, bits: int = 1 << 24) -> DataFrame:
    """One row of ``df`` for each value of its long column ``key``, where most values stand alone.

    Only rows whose value may stand in several, by a bitmap of those that do, are exchanged.
    """
    again = scratch.write(repeated_keys(df.select(F.col(key).alias("key"))), "again")
    out, hit = _marked(df, key, _bit_words(again, "key", bits), bits, "left")
    hit = F.coalesce(hit, F.lit(False))
    return out.where(~hit).select(*df.columns).unionByName(out.where(hit).select(*df.columns).dropDuplicates([key]))


#: Keys that a task holds before it hands them out by part.
HELD_KEYS = 1_000_000


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts)


def _dealt(parts: int):
    """Keys of a task as (part, the part's keys as bytes): a row for many keys, where a row each would cost most of an exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            keys = np.concatenate(held)
            part = _part_of(keys, parts)
            order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")
            data, ends = keys[order], np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))
            full = np.flatnonzero(np.diff(ends, prepend=0))
            offsets = np.concatenate([[0], ends[full]]) * 8
            blobs = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), blobs], ["part", "keys"])

        for batch in batches:
            column = batch.column(0)
            keys = column.flatten() if pa.types.is_list(column.type) else column
            held.append(keys.to_numpy(zero_copy_only=False))
            rows += len(keys)
            if rows > HELD_KEYS:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """The keys of a task's blobs that stand there twice or more, in increasing order."""
    once, twice, rows = [], [], 0

    def fold() -> tuple[list, list, int]:
        keys, n = np.unique(np.concatenate(once), return_counts=True)
        found = np.unique(np.concatenate([keys[n > 1], *twice]))
        return [keys], [found], len(keys)

    held = 0
    for batch in batches:
        for blob in batch.column("keys"):
            once.append(np.frombuffer(blob.as_buffer(), np.int64).copy())
            rows += len(once[-1])
            if rows - held > 4_000_000 + held:
                once, twice, held = fold()
                rows = held
    return fold()[1][0] if once else np.empty(0, np.int64)


def _key_blobs(posts: DataFrame) -> tuple[DataFrame, int]:
    """The keys of ``posts`` as blobs, with those of one part in one task, and the number of parts."""
    parts = 4 * int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = posts.select("key").mapInArrow(tidy(_dealt(parts)), "part int, keys binary")
    return dealt.repartition("part"), parts


def repeated_keys(posts: DataFrame) -> DataFrame:
    """The values of the long column ``key``, or of arrays of longs there, that stand in two rows or more.

    Nearly all keys stand alone, so combining before the exchange would only
    cost: keys are dealt out by value and counted in slices. A task holds the
    distinct keys of its part; repetitions of a frequent key are folded as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(_repeated(batches))], ["key"])

    return _key_blobs(posts)[0].mapInArrow(tidy(run), "key long")


#: Bits of a map of repeated keys: the least and the most, which are 64 MB.
FEWEST_BITS, MOST_BITS = 1 << 24, 1 << 29


class KeyMap:
    """A map of bits of the keys that stand in two rows or more of ``posts``; few others have theirs set.

    There are two bits for each key of ``posts`` at least, up to ``MOST_BITS`` in all, so that the share of lone keys that pass
    doesn't grow with the table up to there. The task that counts the keys of a part makes the part's page of the map: the keys
    themselves are neither exchanged again nor written.
    """

    def __init__(self, posts: DataFrame, keys: int):
        blobs, parts = _key_blobs(posts)
        bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (2 * keys - 1).bit_length()))
        self.parts, self.page = parts, -(-bits // (8 * parts))  # bytes of a page

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = self._at(_repeated(batches))
            at.sort()
            edges = np.searchsorted(at, np.arange(self.parts + 1) * (8 * self.page))
            for part in np.flatnonzero(np.diff(edges)):
                page = np.zeros(8 * self.page, np.uint8)
                page[at[edges[part] : edges[part + 1]] - part * len(page)] = 1
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(page, bitorder="little").tobytes()], pa.binary())], ["part", "page"])

        made = blobs.mapInArrow(tidy(run), "part int, page binary").collect()
        self.bytes = np.zeros(self.parts * self.page, np.uint8)
        for part, page in made:
            self.bytes[part * self.page : (part + 1) * self.page] = np.frombuffer(page, np.uint8)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        inside = (keys.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) % np.uint64(8 * self.page)
        return (_part_of(keys, self.parts) * np.uint64(8 * self.page) + inside).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether the keys' bits are set."""
        at = self._at(keys)
        return (self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


#: Posts of a bucket up to which all pairs of different components are made, where there is another way for more.
WIDE = 32


def link_buckets(
    posts: DataFrame, fits, verify, scratch: Scratch, first=None, detail=None, narrowed=None, attrs=None, leaders=1, described=None, keys=None, differing=None, apart=False
) -> DataFrame:
    """(node, root) for nodes linked to another one by a verified pair from one bucket.

    posts: key, node and attributes, a node at most once under a key. ``fits(x, y)``
    is a cheap necessary condition on two posts given as functions from a column
    name to a column. ``detail`` is (a table of further attributes by node, a
    condition like ``fits`` on them, and whether the posts meet in an earlier bucket
    too), consulted inside the join that makes the later pairs. ``verify(pairs,
    agreed)`` returns those of the pairs (a, b) that are links; ``agreed`` says that
    the pairs have met the condition of ``detail``.
    ``narrowed()`` may give the posts whose key stands in two or more, and somewhat more,
    where the caller knows a faster way than a filter; with ``attrs``, its columns besides ``key``,
    ``posts`` isn't read. ``keys`` may have the posts' keys as arrays in a column ``key``. ``described`` may be a function that adds
    attributes to the posts that need more than their leader, a condition for them in place of ``fits``, their attributes, and
    whether two posts meet in an earlier bucket too. ``differing(posts)`` may give pairs (a, b) for buckets of more than ``WIDE`` posts from
    their node, component ``comp``, and the ``head`` of their bucket and its component ``most``: all links between different components of nodes
    that share a head, and few others. With ``apart`` each bucket draws a member of its own to hold its posts against, so that a post
    meets as many members of a large component as it has buckets there.

    Pairs of a bucket aren't all made. First each post of some buckets (all, or
    those that the condition ``first`` selects) is paired with its bucket's
    leader and verified pairs are merged into components. A bucket whose posts
    now lie in one component needs no more. In the others, posts outside the
    bucket's largest component are paired ``leaders`` times with some member of that one, and
    then every pair of posts from *different* components is still tried, or in large buckets those of ``differing``, so no
    link between components is lost, whatever the size of a bucket.
    """
    attrs = attrs or [c for c in posts.columns if c != "key"]
    if narrowed:
        buckets = scratch.write(narrowed().select("key", *attrs), "buckets")
    else:
        with narrow_batches(scratch.spark):
            shared = scratch.write(repeated_keys(posts if keys is None else keys), "shared")
        buckets = scratch.write(bitmap_filter(posts, "key", shared).join(shared, "key").select("key", *attrs), "buckets")
        scratch.drop(shared)

    early = buckets if first is None else buckets.where(first)
    lead = early.groupBy("key").agg(F.min(F.struct("node", *[c for c in attrs if c != "node"], "key")).alias("lead"))
    stars = early.join(lead, "key").where(F.col("node") != F.col("lead.node")).where(fits(lambda c: F.col(f"lead.{c}"), F.col))
    tried = scratch.write(stars.select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links = tried if tried.isEmpty() else scratch.write(verify(tried, False), "links")
    roots = scratch.write(connected_components(links, scratch), "roots")

    # buckets that lie in several components
    comp = F.coalesce("root", "node")
    comps = buckets.join(roots, "node", "left").groupBy("key").agg(F.min(comp).alias("lo"), F.max(comp).alias("hi"))
    several = scratch.write(comps.where("lo <> hi").select("key"), "several")
    if several.isEmpty():  # no bucket has posts of different components
        return roots
    left = bitmap_filter(buckets, "key", several).join(several, "key")
    seen = None
    if described:
        describe, fits, attrs, seen = described
        left = describe(left)
    left = scratch.write(left.select("key", *attrs), "left")
    scratch.drop(buckets)
    buckets = left

    # first, some times, with one member of a bucket's largest component, another each time; then all
    for turn in (*range(1, leaders + 1), 0):
        whole = turn == 0
        placed = buckets.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).select("key", "comp", *attrs)
        placed = scratch.write(placed, "placed")
        drawn = F.struct(F.xxhash64("node", F.lit(turn), *(["key"] if apart else [])), "node")
        counts = placed.groupBy("key", "comp").agg(F.count("*").alias("members"), F.min(drawn)["node"].alias("head"))
        largest = counts.groupBy("key").agg(F.count("*").alias("comps"), F.sum("members").alias("size"), F.max(F.struct("members", "comp", "head")).alias("m"))
        mixed = placed.join(largest.where("comps > 1").select("key", "size", F.col("m.comp").alias("most"), F.col("m.head").alias("head")), "key")
        mixed = scratch.write(mixed, "mixed")
        wide = None
        if whole and differing is not None:
            wide, mixed = mixed.where(F.col("size") > WIDE).select("node", "comp", "head", "most").distinct(), mixed.where(F.col("size") <= WIDE)
        close = F.lit(True)
        if whole and seen is not None:
            close = ~seen(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
        if detail is not None:
            table, near, met = detail
            own = bitmap_filter(table, "node", mixed.select("node").distinct()).dropDuplicates(["node"])
            mixed = scratch.write(mixed.join(own, "node"), "detailed")
            close = near(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
            if whole:  # every bucket of a pair would make it: only the first one does
                close = close & ~met(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
        x = mixed.where("comp <> most").alias("x")
        y = (mixed if whole else mixed.where("node = head")).alias("y")
        pairs = (
            x.join(y, F.col("x.key") == F.col("y.key"))
            .where("x.comp <> y.comp AND (y.comp = y.most OR x.node < y.node)")
            .where(fits(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")) & close)
            .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        )
        if wide is not None and not wide.isEmpty():
            pairs = pairs.union(differing(wide).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        pairs = scratch.write(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        scratch.drop(placed, mixed)
        if pairs.isEmpty():
            continue
        more = scratch.write(verify(pairs, detail is not None), "more")
        tried = tried.union(pairs)
        if not more.isEmpty():
            links = links.union(more)
            roots = scratch.write(connected_components(links, scratch), "roots")
    return roots
