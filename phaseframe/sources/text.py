"""Readers of text formats: VCF, SAM, FASTA, BED, GTF, GFF3, methylation tables, evaluation tables.

All are ``spark.read`` with expressions, so files of any number and size are read
in parallel splits; region arguments are filters. For repeated work convert once
with ``to_parquet``: partitioned by chromosome and sorted by position, later
region filters prune files and row groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, MapType, StructField, StructType

from phaseframe.sources import bgzf, bgzip


def _at(k: int) -> Column:
    """A field of the split line, null where there are fewer: region filters may be evaluated before headers are dropped."""
    return F.get(F.col("f"), F.lit(k))


def _in_region(df: DataFrame, chrom: str | None, start: int | None, end: int | None, low: str, high: str | None = None) -> DataFrame:
    """Rows on a chromosome that touch [start, end)."""
    if chrom is not None:
        df = df.where(F.col("chrom") == chrom)
    if start is not None:
        df = df.where(F.col(high or low) > start)
    return df.where(F.col(low) < end) if end is not None else df


def vcf_header(spark: SparkSession, path: str) -> DataFrame:
    if bgzip.is_blocked(path):
        return spark.createDataFrame([(line,) for line in bgzip.read_header(path)[0]], "value string")
    return spark.read.text(path).where(F.col("value").startswith("#"))


def vcf_has_info(spark: SparkSession, path: str, field: str) -> bool:
    """Whether the header declares an INFO field, such as allele traversals (AT) or a snarl level (LV)."""
    return not vcf_header(spark, path).where(F.col("value").startswith(f"##INFO=<ID={field},")).isEmpty()


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    line = vcf_header(spark, path).where(F.col("value").startswith("#CHROM")).first()
    return line["value"].split("\t")[9:] if line else []


def read_vcf(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None, sample: int = 0) -> DataFrame:
    """Calls of one sample: chrom, pos (1-based), id, ref, alts, qual, filter, info, gt (-1: missing), phased, ps, gq, allele_traversal, line (the record)."""
    f = F.split("value", "\t")
    if bgzip.is_blocked(path):  # read by the index beside it, if there is one
        bgzip.register(spark)
        region = {"chrom": chrom, "start": None if start is None else max(start - 2, 0), "end": end}
        x = spark.read.format("bgzip").options(**{k: v for k, v in region.items() if chrom is not None and v is not None}).load(path)
    else:
        x = spark.read.text(path)
    x = x.where(~F.col("value").startswith("#")).select(f.alias("f"), "value")
    # key=value pairs, flags with an empty value; the last of repeated keys
    info = F.map_from_entries(
        F.transform(F.filter(F.split(_at(7), ";"), lambda kv: kv != ""), lambda kv: F.struct(F.substring_index(kv, "=", 1), F.when(kv.contains("="), F.regexp_replace(kv, "^[^=]*=", "")).otherwise("")))
    )
    keys, values = F.split(_at(8), ":"), F.split(F.get(F.col("f"), F.lit(9 + sample)), ":")
    field = lambda k: F.get(values, F.array_position(keys, k).cast("int") - 1)
    gt = F.transform(F.split(field("GT"), r"[/|]"), lambda a: F.when(a == ".", -1).otherwise(a.try_cast("int")))
    at = F.when(F.col("info").isNotNull(), F.try_element_at("info", F.lit("AT")))
    out = x.select(
        _at(0).alias("chrom"), _at(1).cast("long").alias("pos"), _at(2).alias("id"), _at(3).alias("ref"),
        F.split(_at(4), ",").alias("alts"), _at(5).try_cast("double").alias("qual"), _at(6).alias("filter"),
        info.alias("info"), gt.alias("gt"), field("GT").contains("|").alias("phased"), field("PS").try_cast("long").alias("ps"), field("GQ").try_cast("int").alias("gq"), F.col("value").alias("line"),
    )
    out = out.withColumn("allele_traversal", F.transform(F.split(at, ","), lambda a: F.filter(F.split(a, "[<>]"), lambda n: n != "")))
    return _in_region(out, chrom, None if start is None else start - 1, end, "pos")


def _tag(kind: str) -> Column:
    hit = F.filter(F.slice("f", 12, 1_000_000), lambda t: t.startswith(kind + ":"))
    return F.regexp_replace(F.get(hit, F.lit(0)), r"^..:[^:]*:", "")


def read_sam(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Alignments: read_name, flag, chrom, read_start (0-based), read_end (exclusive), mapq, cigar, seq, quals, is_forward, mm, ml, line."""
    x = spark.read.text(path).where(~F.col("value").startswith("@")).select("value", F.split("value", "\t").alias("f"))
    spans = F.regexp_extract_all(_at(5), F.lit(r"(\d+)[MDN=X]"), 1)
    span = F.aggregate(spans, F.lit(0).cast("long"), lambda a, n: a + n.cast("long"))
    quals = F.when(_at(10) != "*", F.transform(F.filter(F.split(_at(10), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33))
    begin = _at(3).cast("long") - 1
    out = x.select(
        _at(0).alias("read_name"), _at(1).cast("int").alias("flag"), _at(2).alias("chrom"), begin.alias("read_start"),
        (begin + span).alias("read_end"), _at(4).cast("int").alias("mapq"), _at(5).alias("cigar"), _at(9).alias("seq"),
        quals.alias("quals"), (_at(1).cast("int").bitwiseAND(16) == 0).alias("is_forward"), _tag("MM").alias("mm"), _tag("ML").alias("ml"),
        F.col("value").alias("line"),
    )
    return _in_region(out, chrom, start, end, "read_start", "read_end")


def _modified(mm: str | None, ml: str | None, seq: str | None, forward: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """Query indices and probabilities of 5mC of one read; None without an entry of that kind."""
    entries = [e for e in (mm or "").split(";") if e]
    at = next((k for k, e in enumerate(entries) if e.startswith("C+m")), None)
    if at is None:
        return None
    steps = np.array(entries[at].split(",")[1:], np.int64)
    skipped = sum(e.count(",") for e in entries[:at])
    given = np.array((ml or "").split(",")[1 + skipped :][: len(steps)], np.int64)
    # the k-th call is on cytosine number sum of steps so far, plus k
    nth = (np.cumsum(steps) + np.arange(len(steps)))[: len(given)]
    bases = np.frombuffer((seq or "").encode(), np.uint8)
    sites = np.flatnonzero(bases == ord("C")) if forward else np.flatnonzero(bases == ord("G"))[::-1]
    inside = nth < len(sites)
    return sites[nth[inside]], given[inside] / 256.0


def modification_calls(alignments: DataFrame) -> DataFrame:
    """``calls``: map from query index to probability of 5mC, from the C+m entry of MM and ML.

    MM counts the cytosines of the read as sequenced; on the reverse strand
    those are the guanines of the stored sequence from its end. Linear in bases and calls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            found = [_modified(*row) for row in zip(column("mm"), column("ml"), column("seq"), column("is_forward"))]
            ends = np.cumsum([0] + [0 if f is None else len(f[0]) for f in found])
            offsets = pa.array([None if f is None else int(e) for f, e in zip(found, ends)] + [int(ends[-1])], pa.int32())
            every = [f for f in found if f is not None]
            keys, values = (np.concatenate([f[k] for f in every] or [[]]) for k in (0, 1))
            calls = pa.MapArray.from_arrays(offsets, pa.array(keys.astype(np.int32)), pa.array(values.astype(float)))
            yield pa.RecordBatch.from_arrays([*batch.columns, calls], [*batch.schema.names, "calls"])

    return alignments.mapInArrow(run, StructType([*alignments.schema.fields, StructField("calls", MapType(IntegerType(), DoubleType()))]))


def read_fai(path: str) -> list[tuple[str, int, int, int, int]]:
    """name, length, offset of the first base, bases and bytes of a line, of the index beside a FASTA file."""
    if not bgzf.exists(path + ".fai"):
        raise FileNotFoundError(f"{path}.fai: a FASTA file is read by its index; make one with an indexer of FASTA files")
    rows = (line.split("\t")[:5] for line in bgzf.read_file(path + ".fai").decode().splitlines() if line)
    return [(name, *map(int, numbers)) for name, *numbers in rows]


#: Bases that a window takes into its join at once.
STRETCH = 1_000

#: Bases that are worth a task of their own, on however few cores.
TASK_BASES = 32_000_000


def read_fasta(spark: SparkSession, path: str, chunk: int = 100_000, chrom: str | None = None, chunks_per_task: int = 64) -> DataFrame:
    """Sequence in chunks: chrom, chunk_no, chunk_start (0-based), seq (upper case); wanted stretches join on chunk numbers.

    The index beside the file (.fai) says where bases lie, so a chunk is a range of bytes, and a task a run of chunks,
    of ``chunks_per_task`` at least: no contig is read as a whole. Without an index, or where it doesn't fit the file, that is an error.
    """
    contigs = [c for c in read_fai(path) if chrom is None or c[0] == chrom]
    if any(length < 0 or bases <= 0 or width < bases for _, length, _, bases, width in contigs):
        raise ValueError(f"{path}.fai is damaged")
    x = spark.createDataFrame(contigs, "chrom string, length long, first long, bases long, width long").where("length > 0")
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / chunk).cast("int"))).alias("chunk_no"))
    low = F.col("chunk_no").cast("long") * chunk
    high = F.least(low + chunk, F.col("length"))
    byte = lambda base: F.col("first") + F.floor(base / F.col("bases")) * F.col("width") + base % F.col("bases")
    x = x.select("chrom", "chunk_no", low.alias("chunk_start"), (high - low).alias("n"), byte(low).alias("at"), (byte(high - 1) + 1).alias("end"))
    tasks = max(1, -(-sum(-(-c[1] // chunk) for c in contigs) // chunks_per_task))
    # a task hands on sixteen chunks at a time, so it may have more than those where all cores are busy or bases are few
    tasks = min(tasks, max(4 * spark.sparkContext.defaultParallelism, -(-sum(c[1] for c in contigs) // TASK_BASES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = bgzf.File(path)
        for batch in batches:
            for lo in range(0, len(batch), 16):
                part = batch.slice(lo, 16)
                found = []
                for n, at, end in zip(*(part.column(c).to_pylist() for c in ("n", "at", "end"))):
                    seq = file.read_at(at, end - at).translate(None, b"\r\n").upper()
                    if len(seq) != n:
                        raise ValueError(f"{path}.fai doesn't fit the file")
                    found.append(seq.decode())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, pa.string())], ["chrom", "chunk_no", "chunk_start", "seq"])

    # rows are tiny; neighbours stay together
    return x.repartitionByRange(tasks, "at").mapInArrow(run, "chrom string, chunk_no int, chunk_start long, seq string")


def reference_windows(windows: DataFrame, chunks: DataFrame, chunk: int = 100_000) -> DataFrame:
    """``windows`` (chrom, win_start, win_end) with ``ref_seq``, joined on the stretches of the chunks that they touch.

    A chunk is first cut into stretches of ``STRETCH`` bases, so that a window takes a short text and not a whole chunk into
    the join. A base is a byte; in a string, characters would be counted from its start. Spark takes a text for twenty bytes,
    so by its own estimate it would send a whole reference to all executors: the hint keeps both sides in an exchange.
    """
    size = STRETCH if chunk % STRETCH == 0 else chunk
    w = windows.withColumn("__id", F.xxhash64("chrom", "win_start", "win_end"))
    touch = w.select("chrom", "win_start", "win_end", "__id").distinct().withColumn(
        "__at", F.explode(F.sequence(F.floor(F.col("win_start") / size), F.floor((F.col("win_end") - 1) / size)))
    )
    cuts = F.transform(F.sequence(F.lit(0), F.lit(chunk // size - 1)), lambda k: F.substring("__bytes", (k * size + 1), F.lit(size)))
    x = chunks.withColumn("__bytes", F.col("seq").cast("binary")).select("chrom", (F.col("chunk_no").cast("long") * (chunk // size)).alias("__first"), F.posexplode(cuts))
    x = x.select("chrom", (F.col("__first") + F.col("pos")).alias("__at"), F.col("col").alias("__bytes"))
    part = touch.hint("merge").join(x, ["chrom", "__at"])
    low = F.greatest(F.col("win_start") - F.col("__at") * size, F.lit(0))
    text = F.substring("__bytes", (low + 1).cast("int"), (F.least(F.col("win_end") - F.col("__at") * size, F.lit(size)) - low).cast("int")).cast("string")
    whole = part.groupBy("__id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__at", text.alias("t")))), lambda s: s["t"]), "").alias("ref_seq"))
    return w.join(whole, "__id", "left").drop("__id")


METHYLATION = "chrom string, site_start long, site_end long, score double, hap string, coverage int, mod_count int, unmod_count int, ratio double"


def read_methylation(spark: SparkSession, path: str) -> DataFrame:
    """Site table of nine columns behind comment lines."""
    return spark.read.schema(METHYLATION).option("sep", "\t").option("comment", "#").csv(path).where("site_start IS NOT NULL")


def read_bed(spark: SparkSession, paths: str | list[str], names: list[str]) -> DataFrame:
    """The first columns of BED files: chrom, start, end and what else is named; ``source`` is the file."""
    kinds = ["string", "long", "long"] + ["string"] * (len(names) - 3)
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(paths).withColumn("source", F.input_file_name())


def read_gtf_blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """chrom, block_start, block_end: columns 1, 4 and 5."""
    schema = "chrom string, a string, b string, block_start long, block_end long"
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(paths).select("chrom", "block_start", "block_end")


def read_gff3_genes(spark: SparkSession, path: str) -> DataFrame:
    schema = "chrom string, source string, feature string, start long, end long, score string, strand string, phase string, attributes string"
    x = spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)
    return x.withColumn("gene_name", F.regexp_extract("attributes", r"(?:^|;)gene_name=([^;]*)", 1))


def read_tables(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """Union of tab-separated tables with headers, over chromosomes, samples or tools; ``source`` is the file."""
    r = spark.read.option("sep", "\t").option("header", True)
    r = r.schema(schema) if schema else r.option("inferSchema", True)
    return r.csv(paths).withColumn("source", F.input_file_name())


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """chrom, read_id, idx, state of what ``sinks.write_read_states`` has written."""
    x = spark.read.schema("chrom string, read_id string, states map<string, int>").json(path)
    return x.select("chrom", "read_id", F.explode("states").alias("idx", "state")).withColumn("idx", F.col("idx").cast("long"))


def to_parquet(df: DataFrame, path: str, order: str) -> None:
    df.repartitionByRange("chrom", order).sortWithinPartitions("chrom", order).write.mode("overwrite").partitionBy("chrom").parquet(path)
