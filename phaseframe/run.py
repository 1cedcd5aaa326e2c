"""Command line: from calls, alignments and a reference to phased calls, blocks and tagged reads.

    python -m phaseframe.run --vcf calls.vcf --bam reads.bam --reference ref.fa --chrom chr1 --pacbio --output_vcf out

Outputs are folders of text files, as parallel tasks write them; a chromosome's rows are in order. Where a name ends
in .vcf.gz or .bam the output is one compressed file with an index beside it. Alignments from a BAM file stay BAM.
"""

from __future__ import annotations

import argparse
import dataclasses
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseframe.config import PhasingConfig
from phaseframe.operators import haplotag, observe, transitions
from phaseframe.operators import variants as vr
from phaseframe.operators.ordered import dense_index, inversions, order_report
from phaseframe.plans import pipeline
from phaseframe.sources import bam, checkpoints, sinks, text

log = logging.getLogger("phaseframe")

BATCH_BYTES = 64 << 20
#: Intermediate results that can be written.
TABLES = ("transition_matrix", "transition_matrix_meth", "read_states", "variant_read_mapping", "allele_coverage", "unphaseable_variants")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="phaseframe", description=__doc__.split("\n")[0])
    p.add_argument("--vcf", required=True)
    p.add_argument("-b", "--bam", required=True, help="BAM, or SAM text if the name doesn't end in .bam")
    p.add_argument("-r", "--reference", required=True)
    p.add_argument("-c", "--chrom")
    p.add_argument("-m", "--methylation_calls")
    p.add_argument("--sample", type=int, default=0)
    kind = p.add_mutually_exclusive_group(required=True)
    kind.add_argument("--ont", action="store_true")
    kind.add_argument("--pacbio", action="store_true")
    p.add_argument("--snvs_only", action="store_true")
    p.add_argument("--multiallelics", action="store_true")
    p.add_argument("--use_all_methylated_sites", action="store_true")
    p.add_argument("--max_allele_length", type=int, default=50_000)
    p.add_argument("--min_allele_count", type=int, default=1)
    p.add_argument("--min_base_quality", type=int, default=0)
    p.add_argument("--min_mapq", type=int, default=20)
    p.add_argument("--flank_snv", type=int)
    p.add_argument("--flank_indel", type=int)
    for name in ("vcf", "blocks", "bam", "read_assignments", "differentially_methylated_sites"):
        p.add_argument(f"--output_{name}")
    for name in TABLES:
        p.add_argument(f"--output_{name}", help="table of an intermediate result")
    p.add_argument("--checkpoints", help="folder for stage tables that a later run reads again")
    p.add_argument("--force", action="store_true", help="make stage tables anew")
    p.add_argument("--log")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--version", action="version", version="phaseframe 0.2")
    return p


def config_of(args: argparse.Namespace) -> PhasingConfig:
    flanks = {k: getattr(args, k) for k in ("flank_snv", "flank_indel") if getattr(args, k) is not None}
    same = ("snvs_only", "multiallelics", "use_all_methylated_sites", "max_allele_length", "min_allele_count", "min_base_quality", "min_mapq")
    return PhasingConfig.for_technology("ont" if args.ont else "pacbio", chrom=args.chrom, **{k: getattr(args, k) for k in same}, **flanks)


def start_log(path: str | None, verbose: bool) -> None:
    handlers: list[logging.Handler] = ([logging.FileHandler(path, mode="w")] if path else []) + ([logging.StreamHandler()] if verbose else [])
    logging.basicConfig(handlers=handlers or [logging.NullHandler()], level=logging.INFO, force=True, format="{asctime} [{levelname}] {message}", style="{")


def read_inputs(spark: SparkSession, args: argparse.Namespace, config: PhasingConfig) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All records of the calls, numbered; the variants to be phased with their indices and record numbers; alignments and reference."""
    records = text.read_vcf(spark, args.vcf, config.chrom, sample=args.sample).withColumn("record", F.monotonically_increasing_id())
    records = checkpoints.cut(records, "records")  # numbers of rows hold for one reading
    kept = vr.het_filter(records, config, split_complex=text.vcf_has_info(spark, args.vcf, "LV"))
    variants = dense_index(vr.prepared(kept).drop("line"), "chrom", "pos", ["id", "ref", "record"])
    if is_bam(args.bam):
        bam.register(spark)
        reads = spark.read.format("bam").load(args.bam)
        reads = reads.where(F.col("chrom") == config.chrom) if config.chrom else reads
    else:
        reads = text.read_sam(spark, args.bam, config.chrom)
    return records, variants, reads, text.read_fasta(spark, args.reference, chrom=config.chrom)


def is_bam(path: str) -> bool:
    return path.endswith(".bam")


def write_alignments(spark: SparkSession, args: argparse.Namespace, reads: DataFrame, tags: DataFrame) -> None:
    """The alignments with HP tags: BAM for BAM, with all that a record holds; SAM lines for SAM lines."""
    if not is_bam(args.bam):
        sinks.tagged_sam_lines(reads.withColumnRenamed("read_name", "read_id"), tags).select("value").write.mode("overwrite").text(args.output_bam)
        return
    raw = spark.read.format("bam").option("raw", "true").load(args.bam)
    raw = raw.where(F.col("chrom") == args.chrom) if args.chrom else raw
    header = bam.read_header(args.bam)
    hp = tags.select("chrom", F.col("read_id").alias("read_name"), "hp")
    out = raw.select("chrom", "read_name", "flag", "read_start", "record").join(hp, ["chrom", "read_name"], "left")
    out = bam.coordinate_order(out, header).select("record", "hp")
    out.write.format("bam").option("header", header.text).option("single", args.output_bam.endswith(".bam")).mode("overwrite").save(args.output_bam)


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """Phases and writes what was asked for; returns variants, observations, haplotypes and read tags."""
    config = config_of(args)
    records, variants, reads, chunks = read_inputs(spark, args, config)
    variants = checkpoints.cut(variants, "variants")
    inputs = checkpoints.fingerprint(spark, args.vcf, args.bam, args.reference)

    def stage(name: str, make, *more: str) -> DataFrame:
        if args.checkpoints:
            key = checkpoints.key_of(dataclasses.asdict(config), args.sample, inputs, *more)
            return checkpoints.stage(spark, args.checkpoints, name, make, args.force, key)
        return checkpoints.cut(make(), name)

    if moved := inversions(order_report(reads, "chrom", "read_start")):
        log.warning("%s isn't sorted: %d alignments begin before the one ahead of them", args.bam, moved)
    log.info("Observing alleles of %d variants", variants.count())
    obs = stage("observations", lambda: observe.observe(variants, reads, chunks, config))
    assigned = sites = filled = None
    phaseable, matrix = None, None
    if args.methylation_calls:
        log.info("Phasing with methylation calls from %s", args.methylation_calls)
        calls = text.read_methylation(spark, args.methylation_calls)
        found = pipeline.phase_with_methylation(variants, obs, text.modification_calls(reads), calls, config)
        haps = stage("haplotypes_methylation", lambda: found["haplotypes"], checkpoints.fingerprint(spark, args.methylation_calls))
        assigned, sites, phaseable, matrix, filled = (found[k] for k in ("assignments", "differing_sites", "phaseable", "transitions", "filled_transitions"))
        for r in found["filled"].collect():  # one row per chromosome
            log.info("%s: methylation decides %d of %d undecided steps", r["chrom"], r["n_filled"], r["n_uncertain"])
    else:
        log.info("Phasing from reads alone")
        if any(getattr(args, f"output_{n}") for n in TABLES):
            phaseable, matrix = pipeline.sequence_stage(variants, obs, config)
            haps = stage("haplotypes", lambda: pipeline.decode_stage(phaseable, matrix))
        else:
            haps = stage("haplotypes", lambda: pipeline.phase(variants, obs, config))
    tags = haplotag.assign_blocks(haplotag.tagged_reads(obs, haps, assigned, config), haps)
    if args.output_vcf:
        log.info("Writing phased calls to %s", args.output_vcf)
        calls = records.withColumn("gt", F.sort_array("gt")).join(variants.select("record", "idx"), "record", "left").select("record", "chrom", "pos", "gt", "line", "idx")
        header = [r["value"] for r in text.vcf_header(spark, args.vcf).collect()]  # lines of one header
        sample = (text.vcf_samples(spark, args.vcf) or ["sample"])[args.sample]
        sinks.write_vcf(sinks.phased_vcf_lines(calls, haps), args.output_vcf, sample, header)
    if args.output_blocks:
        log.info("Writing phase blocks to %s", args.output_blocks)
        sinks.write_tsv(sinks.block_bed(haps, variants).select("chrom", "bed_start", "bed_end").orderBy("chrom", "bed_start"), args.output_blocks)
    if args.output_read_assignments:
        log.info("Writing read assignments to %s", args.output_read_assignments)
        names = vr.alignment_filter(reads, 0).select("chrom", F.col("read_name").alias("read_id")).distinct()
        sinks.write_tsv(sinks.read_assignments(names.join(tags, ["chrom", "read_id"], "left")), args.output_read_assignments)
    if args.output_bam:
        log.info("Writing tagged alignments to %s", args.output_bam)
        write_alignments(spark, args, reads, tags)
    if args.output_differentially_methylated_sites:
        log.info("Writing differing sites to %s", args.output_differentially_methylated_sites)
        none = spark.createDataFrame([], "chrom string, start long, end long, score double, hap string, coverage int, mod_count int, unmod_count int, ratio double")
        sinks.write_tsv(sites if sites is not None else none, args.output_differentially_methylated_sites, header=True)
    tables = {
        "transition_matrix": lambda: matrix,
        "transition_matrix_meth": lambda: filled,
        "read_states": lambda: obs,
        "variant_read_mapping": lambda: obs.where("state >= 0").select("chrom", "idx", "read_id"),
        "allele_coverage": lambda: transitions.allele_coverage(obs),
        "unphaseable_variants": lambda: variants.select("chrom", "idx", "pos").join(phaseable.select("chrom", "idx"), ["chrom", "idx"], "left_anti"),
    }
    for name, table in tables.items():
        path = getattr(args, f"output_{name}")
        if path and (df := table()) is not None:
            log.info("Writing the table %s to %s", name, path)
            if name == "read_states":
                sinks.write_read_states(df, path)
                continue
            order = [c for c in ("chrom", "idx", "read_id") if c in df.columns]
            sinks.write_tsv(df.orderBy(*order), path, header=True)
    return {"variants": variants, "observations": obs, "haplotypes": haps, "tags": tags}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    start_log(args.log, args.verbose)
    # alignments are long rows: batches to Python are bounded by bytes
    run(SparkSession.builder.appName("phaseframe").config("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES).getOrCreate(), args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
