"""Phase blocks and haplotypes from row-normalised, mirrored transitions.

A mirrored transition is symmetric, so both states of a chain always carry the
same forward score and the best step, stay or switch, does not depend on the
state. Decoding is therefore a parity: within a block a variant's allele on the
first haplotype is the number of switches after it, modulo two, as the last
variant of a block is in state 0. That is two running sums instead of a
sequential forward and backtrace pass. Blocks that hold an asymmetric matrix
are decoded by two-level scans in ``viterbi_blocks``; ``decoded`` has both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.operators.ordered import dense_index, running_sum
from phaseframe.operators.transitions import uncertain
from phaseframe.sources.checkpoints import cut


def blocks(phaseable: DataFrame, matrix: DataFrame) -> DataFrame:
    """Phaseable variants with p_idx, block_id (from 0) and the transition into them.

    A variant opens a block if the transition into it from the phaseable variant
    before is uncertain, or there is none.
    """
    p = dense_index(phaseable.select("chrom", "idx", "pos"), "chrom", "idx", [], "p_idx", 100_000)
    into = p.join(matrix, ["chrom", "idx"], "left").select(
        "chrom", (F.col("p_idx") + 1).alias("p_idx"), F.coalesce(uncertain(), F.lit(True)).alias("breaks"), "t00", "t01", "t10", "t11"
    )
    x = p.join(into, ["chrom", "p_idx"], "left").withColumn("breaks", F.coalesce("breaks", F.lit(True)).cast("long"))
    return running_sum(x, "chrom", "p_idx", F.col("breaks"), "block_id").withColumn("block_id", F.col("block_id") - 1)


def haplotypes(blocked: DataFrame) -> DataFrame:
    """h0, h1 (-1: unphased) and the forward score delta of each variant.

    Singleton blocks stay unphased, except the last block of a chromosome.
    """
    switch = F.when((F.col("breaks") == 0) & (F.col("t01") > F.col("t00")), 1).otherwise(0)
    gain = F.when(F.col("breaks") == 0, F.log(F.greatest("t00", "t01"))).otherwise(F.lit(0.0))
    x = running_sum(blocked, "chrom", "p_idx", switch, "switches")
    x = running_sum(x, "chrom", "p_idx", gain, "gains")
    per_block = x.groupBy("chrom", "block_id").agg(
        F.max("p_idx").alias("last"), F.count("*").alias("size"), F.max("switches").alias("end_switches"), F.min_by("gains", "p_idx").alias("start_gain")
    )
    final = per_block.groupBy("chrom").agg(F.max("block_id").alias("final_block"))
    x = x.join(per_block, ["chrom", "block_id"]).join(final, "chrom")
    phased = (F.col("size") > 1) | (F.col("block_id") == F.col("final_block"))
    h0 = (F.col("end_switches") - F.col("switches")) % 2
    return x.select(
        "chrom", "idx", "pos", "p_idx", "block_id", "size",
        F.when(phased, h0).otherwise(-1).cast("int").alias("h0"),
        F.when(phased, 1 - h0).otherwise(-1).cast("int").alias("h1"),
        (F.lit(float(np.log(0.5))) + F.col("gains") - F.col("start_gain")).alias("delta"),
    )


def phase_sets(haps: DataFrame) -> DataFrame:
    """Phased variants with ``ps``, the ordinal (from 0) of their block among the emitted ones."""
    emitted = dense_index(haps.where("h0 >= 0").select("chrom", "block_id").distinct(), "chrom", "block_id", [], "ps", 100_000)
    return haps.where("h0 >= 0").join(emitted, ["chrom", "block_id"])


def block_table(haps: DataFrame) -> DataFrame:
    """Emitted blocks: chrom, start and end position, n."""
    return haps.where("h0 >= 0").groupBy("chrom", "block_id").agg(
        F.min("pos").alias("block_start"), F.max("pos").alias("block_end"), F.count("*").alias("n")
    )


def viterbi(t: np.ndarray) -> np.ndarray:
    """States of the best path of one block; t[k] is the matrix into step k + 1, its rows the states
    stepped to, as in the reference. Ties go to state 0; an impossible step counts as 1e-20."""
    n = len(t) + 1
    score, back = np.log([0.5, 0.5]), np.zeros((n, 2), np.int8)
    logs = np.log(np.where(t == 0, 1e-20, t)).transpose(0, 2, 1)
    for k in range(1, n):
        step = score[:, None] + logs[k - 1]
        back[k] = step.argmax(axis=0)
        score = step.max(axis=0)
        score -= score.max()
    out = np.empty(n, np.int8)
    out[-1] = score.argmax()
    for k in range(n - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return out


#: Variants of a chunk of a long block.
CHUNK = 4096


def _logs(cells: np.ndarray) -> list[list[float]]:
    """Rows (from 0 to 0, from 1 to 0, from 0 to 1, from 1 to 1) of logarithms of matrices whose rows are the states stepped to."""
    return np.log(np.where(cells == 0, 1e-20, cells)).reshape(-1, 4).tolist()


def compose(logs: list[list[float]]) -> tuple[float, float, float, float]:
    """The steps as one: the best score from state i to state j, as (00, 01, 10, 11). Max-plus products associate."""
    a00, a01, a10, a11 = 0.0, -np.inf, -np.inf, 0.0
    for s00, s10, s01, s11 in logs:
        a00, a01, a10, a11 = max(a00 + s00, a01 + s10), max(a00 + s01, a01 + s11), max(a10 + s00, a11 + s10), max(a10 + s01, a11 + s11)
    return a00, a01, a10, a11


def forward(logs: list[list[float]], start: tuple[float, float]) -> tuple[np.ndarray, tuple[float, float]]:
    """Back pointers of the steps from a score of either state, and the scores at the end."""
    x, y = start
    back = np.empty((len(logs), 2), np.int8)
    for k, (s00, s10, s01, s11) in enumerate(logs):
        back[k] = y + s10 > x + s00, y + s11 > x + s01
        x, y = max(x + s00, y + s10), max(x + s01, y + s11)
        x, y = (0.0, y - x) if x > y else (x - y, 0.0)
    return back, (x, y)


def trace(back: np.ndarray, end: int) -> np.ndarray:
    """States before, between and after the steps."""
    out = np.empty(len(back) + 1, np.int8)
    out[-1] = end
    for k in range(len(back) - 1, -1, -1):
        out[k] = back[k, out[k + 1]]
    return out


def viterbi_blocks(blocked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """h0 of blocks that hold an asymmetric matrix, in chunks of ``chunk`` variants: the best path equals that of ``viterbi``.

    A chunk's steps are composed to one max-plus matrix; these are scanned along the block, a row for a chunk, which gives
    each chunk its scores at the start. With them a chunk knows for either state at its end the state before it; these
    maps are scanned back from the block's end. Then each chunk is traced by itself. No group holds a block's variants.
    """
    odd = F.max((F.col("breaks") == 0) & ((F.col("t00") != F.col("t11")) | (F.col("t01") != F.col("t10"))))
    wanted = blocked.groupBy("chrom", "block_id").agg(odd.alias("odd")).where("odd")
    cells = F.struct("p_idx", "idx", F.array("t00", "t01", "t10", "t11").alias("t"), (F.col("breaks") != 0).alias("opens"))
    rows = blocked.join(wanted, ["chrom", "block_id"], "left_semi").withColumn("chunk", F.floor(F.col("p_idx") / chunk).cast("long"))
    rows = rows.groupBy("chrom", "block_id", "chunk").agg(F.sort_array(F.collect_list(cells)).alias("rows"))  # at most ``chunk`` each
    first = F.col("rows")[0]["opens"]
    steps = F.transform(F.when(first, F.slice("rows", 2, chunk)).otherwise(F.col("rows")), lambda r: r["t"])
    chunks = cut(rows.select("chrom", "block_id", "chunk", first.alias("first"), F.transform("rows", lambda r: r["idx"]).alias("idx"), F.flatten(steps).alias("t")), "chunks")
    keys = ["chrom", "block_id", "chunk"]
    if chunks.isEmpty():
        return chunks.sparkSession.createDataFrame([], "chrom string, idx long, block_id long, h0 int")

    def logs_of(t) -> list[list[float]]:
        return _logs(np.asarray(t, float).reshape(-1, 2, 2)) if len(t) else []

    def composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [compose(logs_of(t)) for t in pdf["t"]]
            yield pdf[keys].assign(**{c: [f[k] for f in found] for k, c in enumerate(("a00", "a01", "a10", "a11"))})

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, y, starts = pdf.sort_values("chunk"), float(np.log(0.5)), float(np.log(0.5)), []
        for a00, a01, a10, a11 in zip(pdf["a00"], pdf["a01"], pdf["a10"], pdf["a11"]):
            starts.append((x, y))
            x, y = max(x + a00, y + a10), max(x + a01, y + a11)
            x, y = x - max(x, y), y - max(x, y)
        return pdf[keys].assign(x=[s[0] for s in starts], y=[s[1] for s in starts])

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for t, x, y in zip(pdf["t"], pdf["x"], pdf["y"]):
                back, (x, y) = forward(logs_of(t), (x, y))
                found.append((int(trace(back, 0)[0]), int(trace(back, 1)[0]), int(y > x)))
            yield pdf[keys].assign(**{c: np.array([f[k] for f in found], np.int32) for k, c in enumerate(("from0", "from1", "best"))})

    def scan_back(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk", ascending=False)
        state, ends = int(pdf["best"].iloc[0]), []
        for zero, one in zip(pdf["from0"], pdf["from1"]):
            ends.append(state)
            state = int(one if state else zero)
        return pdf[keys].assign(end=np.array(ends, np.int32))

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for chrom, block, first, idx, t, x, y, end in zip(*(pdf[c] for c in ("chrom", "block_id", "first", "idx", "t", "x", "y", "end"))):
                states = trace(forward(logs_of(t), (x, y))[0], end)
                parts.append(pd.DataFrame({"chrom": chrom, "idx": np.asarray(idx), "block_id": block, "h0": states[0 if first else 1 :].astype(np.int32)}))
            if parts:
                yield pd.concat(parts)

    spark = chunks.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # by number: a block's chunks are few bytes, so all blocks would be put together in a task
    by_block = lambda df: df.repartition(tasks, "chrom", "block_id").groupBy("chrom", "block_id")
    key = "chrom string, block_id long, chunk long, "
    scores = chunks.select(*keys, "t").mapInPandas(composed, key + "a00 double, a01 double, a10 double, a11 double")
    scores = by_block(scores).applyInPandas(scan, key + "x double, y double")
    chunks = cut(chunks.join(scores, keys), "scored")
    ends = chunks.select(*keys, "t", "x", "y").mapInPandas(maps, key + "from0 int, from1 int, best int")
    ends = by_block(ends).applyInPandas(scan_back, key + "end int")
    return chunks.join(ends, keys).mapInPandas(traced, "chrom string, idx long, block_id long, h0 int")


def decoded(blocked: DataFrame) -> DataFrame:
    """``haplotypes``, with h0 and h1 of blocks that hold an asymmetric matrix from ``viterbi_blocks``.

    The delta of those blocks stays that of the symmetric path.
    """
    odd = viterbi_blocks(blocked).select("chrom", "idx", F.col("h0").alias("own"))
    haps = haplotypes(blocked).join(odd, ["chrom", "idx"], "left")
    return haps.withColumn("h0", F.coalesce("own", "h0")).withColumn("h1", F.coalesce(1 - F.col("own"), "h1")).drop("own")
