"""Approximate nearest neighbours with a permutation index.

A bounded sample of the vectors serves as pivots. A vector is represented by
its nearest pivots in order of distance and posted, with that order, in the
inverted files of its first few. A query visits the files of its own nearest
pivots; the entries of a file are ranked by the footrule distance between the
two pivot orders, and the best of them are reranked by exact distance in double
precision on the original vectors. Each file yields its nearest few, merged per
query. An entry that stands in several visited files is ranked only in the
first of them.

Scale: pivots are at most ``MAX_PIVOTS`` vectors (their number follows the
square root of the table, so files grow with the root as well). A file with
very many entries or queries, say of a cluster with a third of all rows, is cut
into blocks of bounded size; block pairs are independent tasks. Only pivots and
counts per pivot reach the driver.

Queries whose files hold fewer than k entries are searched again against all
rows in blocks, so every query gets all the neighbours there are.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do vectors whose length isn't the commonest one
(ties: the larger). Of several rows with one id the vector that sorts first
counts. Ties in distance go to the smaller id. A table without a valid vector
gives no rows; a null id takes no part; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.llm.common import Scratch, tidy

#: Bound of the sample that the index is fitted on.
MAX_PIVOTS = 2048
#: Pivots in a vector's order, files it is posted in.
ORDER, POSTED = 16, 3
#: Files a query visits: this share of all, at least so many. Vectors without structure in
#: 64 dimensions need as much for a recall over 0.9; clustered ones or fewer dimensions need less.
VISITED_SHARE, VISITED_LEAST = 0.3, 16
#: Entries and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 1_000
#: Entries of a block that are reranked: this share, at least so many.
RERANK_SHARE, RERANK_LEAST = 0.5, 400


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array<double>), one row per id, valid vectors of the commonest length."""
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)"
    return rows.where(fine).groupBy("vec_id").agg(F.min("v").alias("v"))


def _nearest_pivots(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    d = (pivots * pivots).sum(axis=1) - 2.0 * (x @ pivots.T)
    part = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(part, np.take_along_axis(d, part, axis=1).argsort(axis=1, kind="stable"), axis=1)


def _post(pivots: np.ndarray, order: int, posted: int):
    """Rows of vectors for the files they are posted in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.iloc[lo : lo + 2000]
                x = np.stack(part["v"].to_numpy())
                near = _nearest_pivots(x, pivots, order)
                rows = np.repeat(np.arange(len(x)), posted)
                yield pd.DataFrame(
                    {
                        "pivot": near[:, :posted].ravel().astype(np.int32),
                        "vec_id": part["vec_id"].to_numpy()[rows],
                        "near": list(near.astype(np.int32)[rows]),
                        "v": list(x[rows]),
                    }
                )

    return run


def _footrule(near: np.ndarray, rank: np.ndarray, clip: int) -> np.ndarray:
    """Footrule distances of entries' pivot orders to a query's ranks of all pivots; absent pivots count as ``clip``."""
    return np.abs(np.minimum(rank[near], clip) - np.arange(near.shape[1])).sum(axis=1)


def _search(pivots: np.ndarray | None, k: int, posted: int, rerank_share: float, rerank_least: int):
    """Nearest k entries of one block of a file for each query of one block; exhaustive without pivots."""

    def run(key: tuple, entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out_q, out_v, out_d = [], [], []
        if len(entries) and len(queries):
            ids = entries["vec_id"].to_numpy(np.int64)
            x = np.stack(entries["v"].to_numpy())
            q = np.stack(queries["v"].to_numpy())
            if pivots is not None:
                near = np.stack(entries["near"].to_numpy())
                clip = 4 * near.shape[1]
                orders = _nearest_pivots(q, pivots, len(pivots))
            for j, own in enumerate(queries["vec_id"].to_numpy(np.int64)):
                use = ids != own
                if pivots is not None:
                    rank = np.empty(len(pivots), np.int32)
                    rank[orders[j]] = np.arange(len(pivots), dtype=np.int32)
                    use &= rank[near[:, :posted]].min(axis=1) == rank[key[0]]
                at = np.flatnonzero(use)
                if not len(at):
                    continue
                if pivots is not None:
                    top = max(rerank_least, k, math.ceil(rerank_share * len(at)))
                    if len(at) > top:
                        score = _footrule(near[at], rank, clip)
                        at = at[np.argpartition(score, top - 1)[:top]]
                d = np.sqrt(((x[at] - q[j]) ** 2).sum(axis=1))
                best = np.lexsort((ids[at], d))[:k]
                out_q.append(np.full(len(best), own))
                out_v.append(ids[at][best])
                out_d.append(d[best])
        cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.empty(0, t)
        return pd.DataFrame({"query_id": cat(out_q, np.int64), "vec_id": cat(out_v, np.int64), "score": cat(out_d, np.float64)})

    return run


def _block_pairs(entries: DataFrame, queries: DataFrame, scratch: Scratch, search) -> DataFrame:
    """Searches each file's block pairs. ``pivot`` names the file on both sides."""
    spark = scratch.spark
    n_e = {r["pivot"]: r["n"] for r in entries.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    n_q = {r["pivot"]: r["n"] for r in queries.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    # at most MAX_PIVOTS rows
    sizes = spark.createDataFrame(
        [(p, -(-n // BLOCK_ROWS), -(-n_q.get(p, 0) // BLOCK_QUERIES)) for p, n in n_e.items() if n_q.get(p)],
        "pivot int, e_blocks int, q_blocks int",
    )
    sizes = F.broadcast(sizes)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n).cast("long")).cast("int")
    e = entries.join(sizes, "pivot").withColumn("e_block", own("e_blocks")).withColumn("q_block", each("q_blocks"))
    q = queries.join(sizes, "pivot").withColumn("q_block", own("q_blocks")).withColumn("e_block", each("e_blocks"))
    cols = ["pivot", "e_block", "q_block"]
    return (
        e.drop("e_blocks", "q_blocks")
        .groupBy(*cols)
        .cogroup(q.drop("e_blocks", "q_blocks").groupBy(*cols))
        .applyInPandas(search, "query_id long, vec_id long, score double")
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 10,
    order: int = ORDER,
    posted: int = POSTED,
    visited: int | None = None,
    rerank_share: float = RERANK_SHARE,
    rerank_least: int = RERANK_LEAST,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row its k nearest other vectors found."""
    scratch = Scratch(vectors.sparkSession, "ann")
    base = valid_vectors(vectors, id_col, vec_col)
    base = scratch.write(base, "vectors")
    dims = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if dims is None:
        return scratch.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = base.where(F.size("v") == dims["d"])
    wanted = valid_vectors(queries, id_col, vec_col).where(F.size("v") == dims["d"])
    wanted = scratch.write(wanted, "queries")
    n = dims["count"]
    n_pivots = int(min(MAX_PIVOTS, max(1, round(math.sqrt(n)))))
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).toPandas()
    pivots = np.stack(sample["v"].to_numpy())
    visited = visited or max(VISITED_LEAST, math.ceil(VISITED_SHARE * n_pivots))
    order, posted, visited = (min(m, n_pivots) for m in (order, posted, visited))
    schema = "pivot int, vec_id long, near array<int>, v array<double>"
    entries = scratch.write(base.mapInPandas(tidy(_post(pivots, order, posted)), schema), "entries")
    visits = scratch.write(wanted.mapInPandas(tidy(_post(pivots, visited, visited)), schema).drop("near"), "visits")
    found = _block_pairs(entries, visits, scratch, _search(pivots, k, posted, rerank_share, rerank_least))
    found = scratch.write(_ranked(found, k), "found")

    counts = found.groupBy("query_id").count()
    short = wanted.join(counts.where(F.col("count") >= min(k, n - 1)), wanted["vec_id"] == counts["query_id"], "left_anti")
    short = scratch.write(short, "short")
    if not short.isEmpty():
        one = F.lit(0).cast("int").alias("pivot")
        rest = _block_pairs(
            base.select(one, "vec_id", "v"), short.select(one, "vec_id", "v"), scratch, _search(None, k, posted, 1.0, k)
        )
        done = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
        found = done.unionByName(_ranked(rest, k))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
