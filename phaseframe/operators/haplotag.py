"""Read haplotagging by a naive-Bayes log-likelihood ratio, with methylation as the second source."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.operators.intervals import first_at_or_after


def read_llr(obs: DataFrame, haps: DataFrame, error_rate: float = 1e-3) -> DataFrame:
    """Reads with two known states or more at phased variants: n, match0, match1, llr, last_idx.

    The prior and the transitions of both haplotypes are equal in a mirrored
    matrix, so the ratio is that of the matching states.
    """
    x = obs.where("state >= 0").join(haps.where("h0 >= 0").select("chrom", "idx", "h0"), ["chrom", "idx"])
    gain = math.log((1 - error_rate) / error_rate)
    return (
        x.groupBy("chrom", "read_id")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("state") == F.col("h0")).alias("match0"),
            F.count_if(F.col("state") != F.col("h0")).alias("match1"),
            F.max("idx").alias("last_idx"),
        )
        .where("n > 1")
        .withColumn("llr", (F.col("match0") - F.col("match1")) * F.lit(gain))
    )


def tags(llr: DataFrame, threshold: float = 4.0) -> DataFrame:
    """hp 1 or 2, null if undecided."""
    return llr.withColumn("hp", F.when(F.col("llr") >= threshold, 1).when(F.col("llr") <= -threshold, 2))


def methylation_tags(assigned: DataFrame, haps: DataFrame) -> DataFrame:
    """Tags of reads assigned to a haplotype of a region between two anchors.

    assigned: chrom, read_id, hap (1 or 2), a_idx, a_state, b_idx, b_state. The
    assignment's states are held against the phase at both anchors; hp is null
    where they disagree. The first assignment of a read counts: hap 1 before 2.
    """
    h = haps.where("h0 >= 0").select("chrom", F.col("idx"), "h0")
    at = lambda n: h.select("chrom", F.col("idx").alias(f"{n}_idx"), F.col("h0").alias(f"{n}_h0"))
    x = assigned.join(at("a"), ["chrom", "a_idx"], "left").join(at("b"), ["chrom", "b_idx"], "left")
    fits = lambda flip: (F.col("a_state") == F.abs(F.lit(flip) - F.col("a_h0"))) & (F.col("b_state") == F.abs(F.lit(flip) - F.col("b_h0")))
    hp = F.when(fits(0), 1).when(fits(1), 2)
    first = F.min(F.struct("hap", "a_idx", hp.alias("hp"), F.greatest("a_idx", "b_idx").alias("last_idx")))
    return x.groupBy("chrom", "read_id").agg(first.alias("f")).select("chrom", "read_id", "f.hp", "f.last_idx")


def assign_blocks(tagged: DataFrame, haps: DataFrame) -> DataFrame:
    """The ordinal of the first emitted block that ends at or after the read's last variant; one past the last block beyond."""
    ends = haps.where("h0 >= 0").groupBy("chrom", "block_id").agg(F.max("idx").alias("block_end"))
    joined = first_at_or_after(tagged, ends, "chrom", "last_idx", "block_end")
    from phaseframe.operators.ordered import dense_index

    numbered = dense_index(ends, "chrom", "block_end", [], "block", 100_000).select("chrom", "block_end", "block")
    n = numbered.groupBy("chrom").agg((F.max("block") + 1).alias("__n"))
    return joined.join(numbered, ["chrom", "block_end"], "left").join(n, "chrom", "left").withColumn("block", F.coalesce("block", "__n")).drop("__n")


def of_reads(df: DataFrame, reads: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose read is among ``reads`` (chrom, read_id), or isn't."""
    return df.join(reads.select("chrom", "read_id"), ["chrom", "read_id"], "left_semi" if inside else "left_anti")


def combined_tags(direct: DataFrame, methylated: DataFrame) -> DataFrame:
    """Sequence first, methylation where that is undecided or missing."""
    m = methylated.select("chrom", "read_id", F.col("hp").alias("m_hp"), F.col("last_idx").alias("m_last"))
    out = direct.select("chrom", "read_id", "hp", "last_idx").join(m, ["chrom", "read_id"], "full")
    return out.select(
        "chrom", "read_id", F.coalesce("hp", "m_hp").alias("hp"), F.when(F.col("hp").isNotNull(), F.col("last_idx")).otherwise(F.coalesce("m_last", "last_idx")).alias("last_idx")
    )


def tagged_reads(obs: DataFrame, haps: DataFrame, assigned: DataFrame | None, config) -> DataFrame:
    """chrom, read_id, hp, last_idx of all reads seen: by sequence, else by the methylation that assigned them, else null."""
    direct = tags(read_llr(obs, haps, config.error_rate), config.llr_threshold).select("chrom", "read_id", "hp", "last_idx")
    if assigned is not None:  # held against the phase only where sequence says nothing
        direct = combined_tags(direct, methylation_tags(of_reads(assigned, direct.where("hp IS NOT NULL"), inside=False), haps))
    return direct.where("last_idx IS NOT NULL")
