"""Variant filters, classes, multi-allelic splitting and annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseframe.config import PhasingConfig


def het_filter(variants: DataFrame, config: PhasingConfig, split_complex: bool = False) -> DataFrame:
    """Heterozygous calls without a missing allele, of the wanted kinds and allele lengths.

    A SNP has only alleles of one base; anything else is an indel.
    ``split_complex`` skips ids with '_', which mark parts of a complex call in
    files whose header declares a level field.
    """
    lengths = F.transform(F.concat(F.array("ref"), F.col("alts")), F.length)
    het = (F.col("gt")[0] != F.col("gt")[1]) & ~F.exists("gt", lambda g: g < 0)
    keep = het & (F.array_max(lengths) <= config.max_allele_length)
    if config.snvs_only:
        keep &= F.array_max(lengths) == 1
    if not config.multiallelics:
        keep &= F.size("alts") == 1
    if split_complex:
        keep &= ~F.col("id").contains("_")
    return variants.where(keep)


def variant_type(ref: Column, alts: Column) -> Column:
    """MULTI first, then by the lengths of reference and alternative."""
    n, m = F.length(ref), F.length(alts[0])
    return (
        F.when(F.size(alts) > 1, "MULTI")
        .when((n == 1) & (m == 1), "SNP")
        .when((n > 1) & (m == 1), "DEL")
        .when((n == 1) & (m > 1), "INS")
        .otherwise("Other")
    )


def prepared(variants: DataFrame) -> DataFrame:
    """Upper-case alleles, sorted genotype, class."""
    return (
        variants.withColumn("ref", F.upper("ref"))
        .withColumn("alts", F.transform("alts", F.upper))
        .withColumn("gt", F.sort_array("gt"))
        .withColumn("vtype", variant_type(F.col("ref"), F.col("alts")))
    )


def split_multiallelic(variants: DataFrame) -> DataFrame:
    """A row per alternative allele, numbered from 1."""
    return variants.select("*", F.posexplode("alts").alias("alt_no", "alt")).withColumn("alt_no", F.col("alt_no") + 1)


def merge_multiallelic(split: DataFrame) -> DataFrame:
    """The alternatives of a (chrom, pos, ref) together, in order of their numbers."""
    return split.groupBy("chrom", "pos", "ref").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("alt_no", "alt"))), lambda s: s["alt"]).alias("alts")
    )


def annotate_frequency(variants: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Left join of af on (chrom, pos, ref, alt)."""
    return variants.join(frequencies, ["chrom", "pos", "ref", "alt"], "left")


def rare(variants: DataFrame, below: float = 0.01) -> DataFrame:
    """A missing frequency is not rare."""
    return variants.where(F.col("af") < below)


def quality_pass(variants: DataFrame, structural: bool = False) -> DataFrame:
    """Calls that pass with genotype quality over 20; structural ones that aren't breakends, from 20."""
    if structural:
        return variants.where("svtype IS NOT NULL AND svtype <> 'BND' AND gq >= 20")
    return variants.where("filter = 'PASS' AND gq > 20")


def is_homopolymer(seq: Column, k: int = 4) -> Column:
    """Whether some character stands k times in a row."""
    return seq.rlike(r"(.)\1{" + str(k - 1) + "}")


def alignment_filter(reads: DataFrame, min_mapq: int, methylated: bool = False) -> DataFrame:
    """Mapped, primary or supplementary, not duplicate or failed (0x704), of enough mapping quality."""
    keep = (F.col("flag").bitwiseAND(0x704) == 0) & (F.col("mapq") >= min_mapq)
    return reads.where(keep & F.col("has_mods")) if methylated else reads.where(keep)


def primary_methylated(reads: DataFrame) -> DataFrame:
    """Primary alignments (neither secondary nor supplementary, 0x900) with modification tags."""
    return reads.where((F.col("flag").bitwiseAND(0x900) == 0) & F.col("has_mods"))


def without_phase_sets(calls: DataFrame) -> DataFrame:
    """Calls without their phase set, as they are compared."""
    return calls.drop("ps")


def rename_samples(calls: DataFrame, names: dict[str, str], column: str = "sample") -> DataFrame:
    """Samples by their new names; others keep theirs."""
    return calls.replace(names, subset=[column])
