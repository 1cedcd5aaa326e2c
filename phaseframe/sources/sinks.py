"""Text outputs: phased calls, block intervals, read assignments, sites, tagged alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseframe.operators.decode import phase_sets
from phaseframe.operators.ordered import dense_index
from phaseframe.sources import bgzf, bgzip


def phased_vcf_lines(calls: DataFrame, haps: DataFrame) -> DataFrame:
    """VCF body lines with a phase set, with chrom, pos and the number of the record if it has one; calls: chrom, idx (null: not phased), pos, gt and either line, the
    record as it was read, or id, ref, alts. Phased rows carry a|b, others a/b.

    A record keeps all of its fields; of the sample GT is replaced and PS is added, or replaced.
    """
    place = [c for c in ("chrom", "pos", "record") if c in calls.columns]
    x = calls.join(phase_sets(haps).select("chrom", "idx", "h0", "h1", "ps"), ["chrom", "idx"], "left")
    # the sorted genotype's alleles in the order of the haplotypes
    at = lambda h: F.col("gt")[F.col(h)].cast("string")
    name = lambda k: F.when(F.col("gt")[k] < 0, ".").otherwise(F.col("gt")[k].cast("string"))
    on, ps = F.col("ps").isNotNull(), F.coalesce(F.col("ps").cast("string"), F.lit("."))
    genotype = F.when(on, F.concat(at("h0"), F.lit("|"), at("h1"))).otherwise(F.concat(name(0), F.lit("/"), name(1)))
    if "line" not in calls.columns:
        fields = ["chrom", F.col("pos").cast("string"), "id", "ref", F.array_join("alts", ","), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:PS")]
        return x.select(*place, F.concat_ws("\t", *fields, F.concat_ws(":", genotype, ps)).alias("value"))
    f = F.split("line", "\t")
    keys, values = F.split(F.get(f, F.lit(8)), ":"), F.split(F.get(f, F.lit(9)), ":")
    kept = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda z: ~z["k"].isin("GT", "PS"))
    form = F.concat_ws(":", F.lit("GT"), F.transform(kept, lambda z: z["k"]), F.lit("PS"))
    sample = F.concat_ws(":", genotype, F.transform(kept, lambda z: F.coalesce(z["v"], F.lit("."))), ps)
    rest = F.slice(f, 11, 1_000_000)
    return x.select(*place, F.concat_ws("\t", F.slice(f, 1, 8), form, sample, rest).alias("value"))


VCF_HEADER = (
    "##fileformat=VCFv4.2",
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=PS,Number=1,Type=Integer,Description="Phase set">',
)


def write_vcf(lines: DataFrame, path: str, sample: str, header: list[str] | None = None) -> None:
    """One sorted file per range of positions; the header is a file that sorts first. ``header``: that of the input, to
    which the phase set is added. A path that ends in .gz becomes one file of blocked gzip with a tabix index."""
    spark = lines.sparkSession
    columns = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])
    if header:
        own = [h for h in header if h.startswith("##") and not h.startswith("##FORMAT=<ID=PS,")]
        columns = next((h for h in header if h.startswith("#CHROM")), columns)
    head = [*(own if header else VCF_HEADER[:2]), VCF_HEADER[2], columns]
    body = lines.orderBy(*[c for c in ("chrom", "pos", "record") if c in lines.columns]).select("value")
    if path.endswith(".gz"):
        bgzip.register(spark)
        body.write.format("bgzip").option("header", "\n".join(head)).option("single", "true").mode("overwrite").save(path)
        return
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/0-header")
    body.write.mode("overwrite").text(f"{path}/1-body")


def block_bed(haps: DataFrame, variants: DataFrame) -> DataFrame:
    """chrom, bed_start, bed_end of the emitted blocks; a block starts at the variant after the previous block's last one."""
    ends = haps.where("h0 >= 0").groupBy("chrom", "block_id").agg(F.max("idx").alias("last_idx"), F.max("pos").alias("bed_end"))
    ends = dense_index(ends, "chrom", "last_idx", [], "n", 100_000)
    before = ends.select("chrom", (F.col("n") + 1).alias("n"), (F.col("last_idx") + 1).alias("first_idx"))
    least = haps.groupBy("chrom").agg(F.min("idx").alias("__least"))
    x = ends.join(before, ["chrom", "n"], "left").join(least, "chrom").withColumn("idx", F.coalesce("first_idx", "__least"))
    return x.join(variants.select("chrom", "idx", F.col("pos").alias("bed_start")), ["chrom", "idx"])


def write_fasta(contigs: DataFrame, path: str, width: int = 60) -> str:
    """``path``, a FASTA file of contigs (chrom, seq) in lines of ``width`` bases, with its index beside it.

    A task writes its contigs as a file of its own; these are strung together, and offsets are running sums of sizes.
    """
    spark = contigs.sparkSession
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    x = contigs.select("chrom", F.length("seq").cast("long").alias("length"), F.concat(F.lit(">"), "chrom", F.lit("\n"), lines).alias("value"))
    x = x.orderBy("chrom")
    x.select("value").write.mode("overwrite").text(f"{path}-parts")
    system, place = bgzf.resolve(path)
    with system.open_output_stream(place, compression=None) as sink:
        for part in bgzf.files(f"{path}-parts", (".txt",)):
            file = bgzf.File(part)
            for at in range(0, file.size, bgzf.WINDOW):
                sink.write(file.read_at(at, min(bgzf.WINDOW, file.size - at)))
    system.delete_dir(place + "-parts")
    rows, at = [], 0
    for r in x.select("chrom", "length").collect():  # one row of a contig
        at += len(r["chrom"]) + 2
        rows.append(f"{r['chrom']}\t{r['length']}\t{at}\t{width}\t{width + 1}\n")
        at += r["length"] + -(-r["length"] // width)
    with system.open_output_stream(place + ".fai", compression=None) as sink:
        sink.write("".join(rows).encode())
    return path


def write_read_states(obs: DataFrame, path: str) -> None:
    """A JSON object a read: chrom, read_id and its states by variant number."""
    x = obs.groupBy("chrom", F.col("read_id").cast("string").alias("read_id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("idx").cast("string"), "state")))).alias("states"))
    x.write.mode("overwrite").json(path)


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    """Tab-separated; an empty table still gets its header."""
    df.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


def read_assignments(tagged: DataFrame) -> DataFrame:
    """read, H1 | H2 | none, block | none."""
    hp: Column = F.when(F.col("hp") == 1, "H1").when(F.col("hp") == 2, "H2").otherwise("none")
    return tagged.select(
        F.col("read_id").cast("string").alias("read"), hp.alias("haplotype"), F.when(F.col("hp").isNotNull(), F.col("block").cast("string")).otherwise("none").alias("block")
    )


def tagged_sam_lines(alignments: DataFrame, tagged: DataFrame) -> DataFrame:
    """SAM body lines with HP:i tags on the tagged reads; alignments: chrom, read_id, line."""
    x = alignments.join(tagged.select("chrom", "read_id", "hp"), ["chrom", "read_id"], "left")
    return x.select("chrom", "read_id", F.when(F.col("hp").isNull(), F.col("line")).otherwise(F.concat("line", F.lit("\tHP:i:"), F.col("hp").cast("string"))).alias("value"))
