"""From alignments to observations: the allele that each read carries at each variant it covers.

Reads and variants meet in a bin join of narrow rows, without sequences; the variants of a
read are then gathered beside its sequence, which is exchanged once. Direct calls are made for
whole batches by a merge of operations and variants. Only pairs that they leave open
meet the reference around their variant and are realigned in batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.config import PhasingConfig
from phaseframe.operators import calls, realign
from phaseframe.operators.intervals import points_in_intervals, usual_width
from phaseframe.operators.variants import alignment_filter, is_homopolymer
from phaseframe.sources.checkpoints import cut
from phaseframe.sources.text import reference_windows


def variant_windows(variants: DataFrame, chunks: DataFrame, config: PhasingConfig, chunk: int = 100_000) -> DataFrame:
    """Variants with their two alleles, the reference around them and whether they are next to a homopolymer.

    Columns: chrom, idx, pos, ref, allele_a, allele_b, wide (longest allele), flank, win_start, ref_seq, homopolymer.
    """
    alleles = F.concat(F.array("ref"), F.col("alts"))
    x = variants.select("chrom", "idx", "pos", "ref", F.get(alleles, F.col("gt")[0]).alias("allele_a"), F.get(alleles, F.col("gt")[1]).alias("allele_b"))
    x = x.withColumn("wide", F.greatest(F.length("ref"), F.length("allele_a"), F.length("allele_b")))
    x = x.withColumn("flank", F.when(F.col("wide") == 1, config.flank_snv).otherwise(config.flank_indel))
    x = x.withColumn("win_start", F.greatest(F.col("pos") - 1 - F.col("flank"), F.lit(0)))
    x = x.withColumn("win_end", F.col("pos") + F.length("ref") + F.col("flank") + F.col("wide"))
    x = reference_windows(x, chunks, chunk).drop("win_end")
    around = F.col("pos") - 5 - F.col("win_start")
    near = F.substring("ref_seq", (F.greatest(around, F.lit(0)) + 1).cast("int"), (10 + F.least(around, F.lit(0))).cast("int"))
    return x.withColumn("homopolymer", F.coalesce(is_homopolymer(near), F.lit(False)))


def _pairs(windows: DataFrame, reads: DataFrame) -> DataFrame:
    """aln with the variants that the alignment covers, in order, each by what a call needs of it."""
    spans = reads.select("chrom", "aln", "read_start", "read_end")
    width = usual_width(spans, "read_start", "read_end")
    found = points_in_intervals(calls.spec(windows), spans, "chrom", "at", "read_start", "read_end", width, split=["aln"])
    return found.groupBy("aln").agg(F.sort_array(F.collect_list("spec")).alias("variants"))


def _called(windows: DataFrame, alignments: DataFrame, config: PhasingConfig) -> DataFrame:
    reads = alignment_filter(alignments, config.min_mapq)
    reads = reads.withColumn("aln", F.xxhash64("chrom", "read_name", "flag", "read_start", "cigar"))
    reads = reads.select("chrom", "read_name", "flag", "read_start", "read_end", "cigar", "seq", F.col("quals").cast("array<tinyint>").alias("quals"), "aln")
    return calls.called(reads.join(_pairs(windows, reads), "aln"), config)


def covered(variants: DataFrame, alignments: DataFrame, chunks: DataFrame, config: PhasingConfig, chunk: int = 100_000) -> DataFrame:
    """Filtered alignments with the direct calls of the variants they cover, see ``calls.called``."""
    return _called(cut(variant_windows(variants, chunks, config, chunk), "windows"), alignments, config)


def _pending(open_: DataFrame, windows: DataFrame) -> DataFrame:
    """What the realigner needs of open calls: the read's window, and of the reference what stands beside each allele."""
    x = open_.join(windows.withColumnRenamed("chrom", "__c").withColumnRenamed("idx", "__i"), (F.col("chrom") == F.col("__c")) & (F.col("idx") == F.col("__i")))
    p = F.col("pos") - 1 - F.col("win_start")  # of the variant in the reference window
    piece = lambda first, n: F.substring("ref_seq", (F.greatest(first, F.lit(0)) + 1).cast("int"), F.greatest(n + F.least(first, F.lit(0)), F.lit(0)).cast("int"))
    right = lambda allele: piece(p + F.length("ref"), F.col("down") + F.col("wide") - F.length(allele))
    return x.select(
        F.col("aln").alias("read_id"), "idx", F.col("window").alias("read_window"), piece(p - F.col("up"), F.col("up")).alias("left_flank"),
        "allele_a", "allele_b", right("allele_a").alias("right_a"), right("allele_b").alias("right_b"), "homopolymer", "gap_open", "gap_extend",
    )


def observe(variants: DataFrame, alignments: DataFrame, chunks: DataFrame, config: PhasingConfig, chunk: int = 100_000) -> DataFrame:
    """chrom, read_id (the read's name), idx, state (-1: unknown), direct, strand (1: reverse).

    variants: chrom, idx, pos, ref, alts, gt (sorted). alignments: as the readers give them. chunks: the reference.
    Supplementary records share the read's name; of a variant that several cover, the call of the last one counts.
    """
    windows = cut(variant_windows(variants, chunks, config, chunk), "windows")
    x = cut(_called(windows, alignments, config), "calls")
    direct = x.select("chrom", F.col("read_name").alias("read_id"), "read_start", "aln", "strand", F.explode("calls").alias("c")).select("chrom", "read_id", "read_start", "aln", "strand", "c.idx", "c.state")
    open_ = x.select("chrom", "aln", "gap_open", "gap_extend", F.explode(F.filter("calls", lambda c: c["state"].isNull())).alias("c"))
    open_ = open_.select("chrom", "aln", "gap_open", "gap_extend", "c.idx", "c.window", "c.up", "c.down")
    again = realign.realigned_states(_pending(open_, windows)).select(F.col("read_id").alias("aln"), "idx", F.col("state").alias("found"))
    out = direct.join(again, ["aln", "idx"], "left").withColumn("direct", F.col("state").isNotNull())
    out = out.withColumn("state", F.coalesce("state", "found", F.lit(-1)))
    last = F.max(F.struct("read_start", "aln", "state", "direct", "strand")).alias("l")
    return out.groupBy("chrom", "read_id", "idx").agg(last).select("chrom", "read_id", "idx", "l.state", "l.direct", "l.strand")
