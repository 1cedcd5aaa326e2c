"""Registered queries on text formats, methylation of reads, comparison of phasings and the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe import fixtures as fx
from phaseframe.operators import cigar, evaluate, haplotag, intervals, ordered, transitions
from phaseframe.operators import methylation as meth
from phaseframe.operators import variants as vr
from phaseframe.plans.catalogue import _matrix, _with, phased, query
from phaseframe.plans.catalogue_reads import _BR
from phaseframe.plans.catalogue_sites import _BLK, _blk
from phaseframe.sources import bam, bgzf, checkpoints, sinks, text


def _folder(s, name: str) -> str:
    """A folder for files that a query writes and reads again."""
    return checkpoints.scratch(s, name)


# ------------------------------------------------------------- text formats, written and read again


def _vcf(s, d) -> str:
    """The raw calls as a file with a header."""
    raw = fx.raw_variants(s, d)
    gt = F.concat_ws("/", *[F.when(F.col(c) < 0, ".").otherwise(F.col(c).cast("string")) for c in ("gt_a", "gt_b")])
    body = raw.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", F.concat_ws(",", "alt1", "alt2"), F.lit("30"), "filter", F.lit("LV=1;DB"), F.lit("GT:GQ"), F.concat(gt, F.lit(":"), F.col("gq").cast("string"))))
    path = _folder(s, "vcf")
    head = ["##fileformat=VCFv4.2", '##INFO=<ID=LV,Number=1,Type=Integer,Description="Level">', "#" + "\t".join([*"CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split(), f"n{raw.count()}"])]
    s.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(f"{path}/0")
    body.write.text(f"{path}/1")
    return f"{path}/*"


@query("vcf_scan", _with("raw") + "SELECT chrom, pos, id, ref, concat_ws(',', alt1, alt2) AS alts, filter, gt_a, gt_b, gq FROM raw WHERE pos BETWEEN 100000 AND 900000")
def _(s, d):
    x = text.read_vcf(s, _vcf(s, d), "chr1", 100_000, 900_001)
    return x.where("pos >= 100000").select("chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alts"), "filter", F.col("gt")[0].alias("gt_a"), F.col("gt")[1].alias("gt_b"), "gq")


@query("vcf_header", _with("raw") + "SELECT TRUE AS has_level, FALSE AS has_traversal, concat('n', CAST(count(*) AS VARCHAR)) AS sample FROM raw")
def _(s, d):
    path = _vcf(s, d)
    return s.createDataFrame([(text.vcf_has_info(s, path, "LV"), text.vcf_has_info(s, path, "AT"), text.vcf_samples(s, path)[0])], "has_level boolean, has_traversal boolean, sample string")


@query("phased_vcf", _with("phase") + """SELECT v.pos, concat_ws(chr(9), 'chr1', CAST(v.pos AS VARCHAR), 'x', 'A', 'C', '50', 'q10', 'DB', 'GT:DP:PS',
  CASE WHEN e.h0 IS NULL THEN '0/1:7:.' ELSE e.h0 || '|' || (1 - e.h0) || ':7:' || e.ps END) AS value FROM variants v LEFT JOIN emitted e USING (idx)""")
def _(s, d):
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("x"), F.lit("A"), F.lit("C"), F.lit("50"), F.lit("q10"), F.lit("DB"), F.lit("GT:DP"), F.lit("0/1:7"))
    calls = fx.variants(s, d).select("chrom", "idx", "pos", F.array(F.lit(0), F.lit(1)).alias("gt"), line.alias("line"))
    return sinks.phased_vcf_lines(calls, phased(s, d)).select("pos", "value")


def _sam(s, d) -> str:
    x = fx.block_reads(s, d)
    star = F.lit("*")
    body = x.select(F.concat_ws("\t", "read_name", F.col("flag").cast("string"), "chrom", (F.col("read_start") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", star, F.lit("0"), F.lit("0"), "seq", F.expr("repeat(if(qual = 0, '!', '?'), length(seq))")))
    path = _folder(s, "sam")
    body.write.text(path)
    return path


@query("sam_scan", f"WITH {_BR} SELECT read_name, flag, chrom, read_start, read_end, mapq, cigar, seq, CAST(qual AS INT) AS qual FROM br WHERE chrom = 'chr2' AND read_end > 1000 AND read_start < 3000")
def _(s, d):
    x = text.read_sam(s, _sam(s, d), "chr2", 1000, 3000)
    return x.select("read_name", "flag", "chrom", "read_start", "read_end", "mapq", "cigar", "seq", F.array_min("quals").alias("qual"))


#: Contigs out of the parts, each part a piece of twelve bases, and windows on them out of the suppliers.
_CONTIGS = "pieces AS (SELECT concat('ctg', CAST(p_size % 5 AS {s})) AS chrom, p_partkey, substring('ACGTTGCAACGGTTACCATG', CAST(1 + (p_partkey * 7 + p_size) % 8 AS INT), 12) AS piece FROM {{part}}), windows AS (SELECT concat('ctg', CAST(s_suppkey % 5 AS {s})) AS chrom, (s_suppkey * 37) % 200 AS win_start, (s_suppkey * 37) % 200 + 20 + s_suppkey % 60 AS win_end FROM {{supplier}})"


@query(
    "fasta_windows",
    "WITH " + _CONTIGS.format(s="VARCHAR").format(part="part", supplier="supplier") + ", contigs AS (SELECT chrom, string_agg(piece, '' ORDER BY p_partkey) AS seq FROM pieces GROUP BY chrom)"
    " SELECT w.chrom, w.win_start, substring(seq, CAST(w.win_start + 1 AS INT), CAST(w.win_end - w.win_start AS INT)) AS ref_seq FROM windows w JOIN contigs USING (chrom)",
)
def _(s, d):
    """Windows of a file with an index, whose text comes from a table."""
    tables = {t: s.read.parquet(f"{d}/{t}.parquet") for t in ("part", "supplier")}
    sql = "WITH " + _CONTIGS.format(s="STRING")
    contigs = s.sql(sql + " SELECT * FROM pieces", **tables).groupBy("chrom").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "piece"))), lambda x: x["piece"]), "").alias("seq"))
    path = sinks.write_fasta(contigs, f"{_folder(s, 'fasta')}/ref.fa", 60)
    windows = s.sql(sql + " SELECT * FROM windows", **tables)
    return text.reference_windows(windows, text.read_fasta(s, path, 50, chunks_per_task=4), 50).select("chrom", "win_start", "ref_seq")


# ------------------------------------------------------------- blocked files with indices

_BLOCK_SQ = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:500000000\n@SQ\tSN:chr2\tLN:500000000\n"


def _bam(s, d, single: bool, hp=None) -> str:
    """The reads of the sequence fixture as BAM: one file with its index, or a folder of files."""
    bam.register(s)
    path = f"{_folder(s, 'bam')}.bam"
    # qualities are made behind the exchange, as in fx.block_modified_reads
    x = fx.with_quals(bam.coordinate_order(fx.block_reads(s, d).drop("quals", "is_forward"), bam.header_of_text(_BLOCK_SQ)))
    columns = ["read_name", "flag", "chrom", "read_start", "mapq", "cigar", "seq", "quals"] + ([hp.alias("hp")] if hp is not None else [])
    x.select(*columns).write.format("bam").option("header", _BLOCK_SQ).option("single", single).mode("overwrite").save(path)
    return path


_BAM = ["read_name", "flag", "chrom", "read_start", "read_end", "mapq", "cigar", "seq", "array_min(quals) AS qual"]


@query("bam_region", f"WITH {_BR} SELECT read_name, flag, chrom, read_start, read_end, mapq, cigar, seq, CAST(qual AS INT) AS qual FROM br WHERE chrom = 'chr2' AND read_end > 1000 AND read_start < 3000")
def _(s, d):
    """Alignments that touch a region, by the index."""
    x = s.read.format("bam").load(_bam(s, d, True))
    return x.where((F.col("chrom") == "chr2") & (F.col("read_end") > 1000) & (F.col("read_start") < 3000)).selectExpr(*_BAM)


@query("bam_pieces", f"WITH {_BR} SELECT read_name, flag, chrom, read_start, read_end, mapq, cigar, seq, CAST(qual AS INT) AS qual FROM br")
def _(s, d):
    """Whole files in many pieces, whose first records are looked for: their index is taken away."""
    path = _bam(s, d, False)
    for f in bgzf.files(path, (".bai",)):
        bgzf.resolve(f)[0].delete_file(bgzf.resolve(f)[1])
    return s.read.format("bam").option("split_bytes", 40_000).load(path).selectExpr(*_BAM)


@query("tagged_bam", f"WITH {_BR} SELECT read_name, flag, read_start, CASE WHEN hap = 0 THEN 2 WHEN ok % 3 = 0 THEN 1 END AS hp FROM br")
def _(s, d):
    """Haplotype tags written over others that were there, in a second file, and read back."""
    path = _bam(s, d, True, F.lit(1))
    x = s.read.format("bam").option("raw", "true").load(path)
    hap = fx.block_reads(s, d).select("read_name", "flag", "chrom", "read_start", F.when(F.col("hap") == 0, 2).when(F.col("ok") % 3 == 0, 1).alias("hp"))
    x = x.select("read_name", "flag", "chrom", "read_start", "record").join(hap, ["read_name", "flag", "chrom", "read_start"])
    out = f"{_folder(s, 'tagged')}.bam"
    header = bam.read_header(path)
    bam.coordinate_order(x, header).select("record", "hp").write.format("bam").option("header", header.text).option("single", "true").mode("overwrite").save(out)
    return s.read.format("bam").option("tags", "HP").load(out).select("read_name", "flag", "read_start", F.col("HP").cast("int").alias("hp"))


@query("vcf_region", _with("raw") + "SELECT chrom, pos, id, ref, concat_ws(',', alt1, alt2) AS alts, filter, gt_a, gt_b, gq FROM raw WHERE pos BETWEEN 100000 AND 900000")
def _(s, d):
    """A region of a compressed file, by its index."""
    raw = text.read_vcf(s, _vcf(s, d))
    path = f"{_folder(s, 'vcf')}.vcf.gz"
    sinks.write_vcf(raw.select("chrom", "pos", F.col("line").alias("value")), path, "one")
    x = text.read_vcf(s, path, "chr1", 100_000, 900_001)
    return x.select("chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alts"), "filter", F.col("gt")[0].alias("gt_a"), F.col("gt")[1].alias("gt_b"), "gq")


@query("order_report", _with("reads") + "SELECT count(*) AS n, CAST(0 AS BIGINT) AS inversions, min(read_start) AS first, max(read_start) AS last FROM reads")
def _(s, d):
    """That a sorted table is sorted, by one row of each of its files."""
    x = checkpoints.cut(fx.reads(s, d).select("chrom", "read_start").orderBy("chrom", "read_start"), "sorted")
    report = checkpoints.cut(ordered.order_report(x.repartitionByRange(6, "chrom", "read_start").sortWithinPartitions("chrom", "read_start"), "chrom", "read_start"), "report")
    whole = report.agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return whole.select("n", F.lit(ordered.inversions(report)).cast("long").alias("inversions"), "first", "last")


_SITE = "SELECT chrom, site_start, site_end, CAST(round(ratio, 3) AS DOUBLE) AS ratio, coverage FROM meth"


@query("methylation_scan", _with("meth") + _SITE)
def _(s, d):
    path = _folder(s, "sites")
    x = fx.methylation_sites(s, d)
    body = x.select(F.concat_ws("\t", "chrom", F.col("site_start").cast("string"), F.col("site_end").cast("string"), F.lit("1.5"), F.lit("Total"), F.col("coverage").cast("string"), F.lit("1"), F.lit("2"), F.format_string("%.3f", "ratio")))
    s.createDataFrame([("\n".join(["##a", "##b", "#c"]),)], "value string").coalesce(1).write.text(f"{path}/0")
    body.write.text(f"{path}/1")
    return text.read_methylation(s, f"{path}/*").select("chrom", "site_start", "site_end", "ratio", "coverage")


@query("differing_sites_table", _with("meth") + "SELECT chrom, site_start AS start, coverage FROM meth WHERE coverage > 20")
def _(s, d):
    path = _folder(s, "differing")
    sinks.write_tsv(fx.methylation_sites(s, d).where("coverage > 20").select("chrom", F.col("site_start").alias("start"), "coverage"), path, header=True)
    return text.read_tables(s, [path], "chrom string, start long, coverage int").drop("source")


@query("bed_scan", _with("genes") + "SELECT chrom, gene_start, gene_end, gene FROM genes")
def _(s, d):
    path = _folder(s, "bed")
    sinks.write_tsv(fx.genes(s, d).select("chrom", "gene_start", "gene_end", "gene"), path)
    return text.read_bed(s, path, ["chrom", "gene_start", "gene_end", "gene"]).drop("source")


@query("gtf_blocks", "WITH " + _BLK.format(orders="orders") + " SELECT chrom, block_start, block_end FROM blk")
def _(s, d):
    path = _folder(s, "gtf")
    sinks.write_tsv(_blk(s, d).select("chrom", F.lit("phase").alias("a"), F.lit("exon").alias("b"), "block_start", "block_end", F.lit(".").alias("c")), path)
    return text.read_gtf_blocks(s, path)


@query("gff3_genes", _with("genes") + "SELECT chrom, gene_start AS start, gene AS gene_name FROM genes")
def _(s, d):
    path = _folder(s, "gff")
    dot = F.lit(".")
    x = fx.genes(s, d).select("chrom", F.lit("x").alias("a"), F.lit("gene").alias("b"), "gene_start", "gene_end", dot.alias("c"), dot.alias("d"), dot.alias("e"), F.concat(F.lit("ID=1;gene_name="), "gene", F.lit(";level=2")).alias("f"))
    sinks.write_tsv(x, path)
    return text.read_gff3_genes(s, path).select("chrom", "start", "gene_name")


@query("table_union", "SELECT c_custkey AS sample, c_nationkey AS tool FROM customer")
def _(s, d):
    x, path = s.read.parquet(f"{d}/customer.parquet"), _folder(s, "union")
    for k in (0, 1):
        sinks.write_tsv(x.where(F.col("c_custkey") % 2 == k).select(F.col("c_custkey").alias("sample"), F.col("c_nationkey").alias("tool")), f"{path}/{k}", header=True)
    return text.read_tables(s, [f"{path}/0", f"{path}/1"], f"sample {x.schema['c_custkey'].dataType.simpleString()}, tool {x.schema['c_nationkey'].dataType.simpleString()}").drop("source")


@query("checkpoint_reload", _with("obs") + "SELECT chrom, idx, count(*) FILTER (WHERE state = 0) AS c0, count(*) FILTER (WHERE state = 1) AS c1 FROM obs GROUP BY chrom, idx")
def _(s, d):
    path = _folder(s, "stages")
    checkpoints.stage(s, path, "coverage", lambda: transitions.allele_coverage(fx.observations(s, d)))

    def never() -> DataFrame:
        raise AssertionError("a complete stage is read, not made")

    return checkpoints.stage(s, path, "coverage", never)


@query("json_states", _with("obs") + "SELECT read_id, idx, state FROM obs")
def _(s, d):
    """Read states as one JSON object per read, and back."""
    path = _folder(s, "states")
    sinks.write_read_states(fx.observations(s, d), path)
    return text.read_states(s, path).select(F.col("read_id").cast("long").alias("read_id"), "idx", "state")


# ------------------------------------------------------------- methylation of reads

_CALLS = (
    "sited AS (" + " UNION ALL ".join(f"SELECT read_name, chrom, b{k} * 100 + {at} AS site, CASE WHEN (b{k} + {n} + hap) % 2 = 1 THEN 254 ELSE 2 END / 256.0::DOUBLE AS p FROM kept WHERE (ok + b{k}) % 17 <> 0" for k in range(3) for n, at in enumerate(fx.METHYLATED)) + ")"
)


@query("read_methylation", f"WITH {_BR}, {_CALLS} SELECT * FROM sited")
def _(s, d):
    """Probabilities of modification of reads at the sites they cover."""
    reads = cigar.with_offsets(vr.alignment_filter(fx.block_modified_reads(s, d), 20).select("chrom", "read_name", "read_start", "read_end", "cigar", "calls"))
    width = intervals.usual_width(vr.alignment_filter(fx.block_reads(s, d), 20), "read_start", "read_end")
    x = intervals.points_in_intervals(fx.block_methylation_sites(s, d).select("chrom", "site_start"), reads.drop("cigar"), "chrom", "site_start", "read_start", "read_end", width)
    p = cigar.methylation_probability(F.col("offs"), (F.col("site_start") - F.col("read_start")).cast("int"), F.col("calls"))
    return x.select("read_name", "chrom", F.col("site_start").alias("site"), p.alias("p")).where("p >= 0")


_TAGS = "tags AS (SELECT o_orderkey AS read_id, 'ACCGTCCGACGC' AS seq, o_orderkey % 2 = 0 AS is_forward, concat('C+h,0;C+m,', CAST(o_orderkey % 2 AS {s}), ',1;') AS mm, concat('C,9,', CAST(o_orderkey % 200 AS {s}), ',', CAST(o_custkey % 256 AS {s})) AS ml FROM {{orders}})"


@query(
    "modification_tags",
    "WITH " + _TAGS.format(s="VARCHAR").format(orders="orders") + """, at_ AS (SELECT read_id, is_forward, read_id % 2 AS first, CAST(string_split(ml, ',')[3] AS INT) AS p1, CAST(string_split(ml, ',')[4] AS INT) AS p2 FROM tags)
SELECT read_id, CASE WHEN is_forward THEN [1, 2, 5, 6, 9, 11] ELSE [10, 7, 3] END[first + 1] AS q, p1 / 256.0::DOUBLE AS p FROM at_
UNION ALL SELECT read_id, CASE WHEN is_forward THEN [1, 2, 5, 6, 9, 11] ELSE [10, 7, 3] END[first + 3], p2 / 256.0::DOUBLE FROM at_ WHERE is_forward OR first + 3 <= 3""",
)
def _(s, d):
    x = s.sql("WITH " + _TAGS.format(s="STRING") + " SELECT * FROM tags", orders=s.read.parquet(f"{d}/orders.parquet"))
    return text.modification_calls(x).select("read_id", F.explode("calls").alias("q", "p"))


@query("union_of_sites", _with("meth") + "SELECT site_start, 'hap1' AS hap, ratio FROM meth WHERE coverage % 3 = 0 UNION ALL SELECT site_start, 'hap2', ratio FROM meth WHERE coverage % 3 = 1 UNION ALL SELECT site_start, 'Total', ratio FROM meth")
def _(s, d):
    x = fx.methylation_sites(s, d)
    one = lambda df, name: df.select("site_start", F.lit(name).alias("hap"), "ratio")
    return meth.sites_once(["site_start", "hap"], one(x.where("coverage % 3 = 0"), "hap1"), one(x.where("coverage % 3 = 1"), "hap2"), one(x, "Total"))


@query("sites_once_in_order", "SELECT DISTINCT CAST(event_id % 900 AS BIGINT) AS start, CAST(user_id % 3 AS INT) AS hap FROM events ORDER BY 1, 2")
def _(s, d):
    x = s.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 900).cast("long").alias("start"), (F.col("user_id") % 3).cast("int").alias("hap"))
    return meth.sites_once(["start", "hap"], x)


@query(
    "filled_count",
    _with("normal") + "SELECT 'chr1' AS chrom, count(*) AS n_uncertain, count(*) FILTER (WHERE idx % 2 = 0) AS n_filled FROM normal WHERE t00 = 0.5 AND t01 = 0.5 AND t10 = 0.5 AND t11 = 0.5 AND idx < (SELECT max(idx) - 1 FROM variants) HAVING count(*) > 0",
)
def _(s, d):
    from phaseframe.plans import methylation

    before = checkpoints.cut(transitions.normalize(transitions.mirror(_matrix(s, d))), "transitions")
    even = F.col("idx") % 2 == 0
    after = before.select("chrom", "idx", *[F.when(even & transitions.uncertain(), v).otherwise(F.col(c)).alias(c) for c, v in (("t00", 0.9), ("t01", 0.1), ("t10", 0.1), ("t11", 0.9))])
    v = fx.variants(s, d)
    return methylation.filled(methylation.uncertain_steps(v, before), methylation.uncertain_steps(v, after))


# ------------------------------------------------------------- reads and variants

@query("read_variant_range", _with("obs") + "SELECT read_id, idx FROM obs WHERE idx BETWEEN 20 AND 60")
def _(s, d):
    """Variants of a range and the reads that cover them."""
    v = fx.variants(s, d).where("idx BETWEEN 20 AND 60").withColumn("at", F.col("pos") - 1)
    return intervals.points_in_intervals(v, fx.reads(s, d).where("mapq >= 20"), "chrom", "at", "read_start", "read_end").select("read_id", "idx")


@query("primary_methylated_reads", _with("reads") + "SELECT read_id FROM reads WHERE flag & 2304 = 0 AND has_mods")
def _(s, d):
    return vr.primary_methylated(fx.reads(s, d)).select("read_id")


@query("unsorted_reads", _with("reads") + "SELECT read_id FROM (SELECT read_id, read_start, max(read_start) OVER (ORDER BY read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM reads) x WHERE read_start < before")
def _(s, d):
    return ordered.out_of_order(fx.reads(s, d), "chrom", "read_id", "read_start").select("read_id")


@query("strip_phase_sets", _with("phase") + "SELECT 'chr1' AS chrom, idx, pos, h0 FROM emitted")
def _(s, d):
    from phaseframe.operators import decode

    return vr.without_phase_sets(decode.phase_sets(phased(s, d))).select("chrom", "idx", "pos", "h0")


@query("sample_rename", "SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 'three' ELSE concat('s', CAST(c_nationkey AS VARCHAR)) END AS sample FROM customer")
def _(s, d):
    x = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("sample"))
    return vr.rename_samples(x, {"s3": "three"})


@query("tagged_membership", _with("obs") + "SELECT DISTINCT read_id FROM obs WHERE read_id % 7 < 2")
def _(s, d):
    """Reads that methylation has assigned."""
    obs = fx.observations(s, d)
    assigned = obs.where("read_id % 7 < 2").select("chrom", "read_id").distinct()
    return haplotag.of_reads(obs, assigned).select("read_id").distinct()


_MT = """firsts AS (SELECT read_id, min(idx) AS a_idx, max(idx) AS b_idx, count(*) AS n, 1 + read_id % 2 AS hap FROM obs WHERE read_id % 3 = 0 GROUP BY read_id),
assigned AS (SELECT *, CASE WHEN read_id % 5 = 0 THEN 0 ELSE 1 END AS a_state, CASE WHEN read_id % 4 = 0 THEN 0 ELSE 1 END AS b_state FROM firsts)"""


@query("methylation_tags", _with("phase", extra=_MT) + """SELECT read_id, CASE WHEN a_state = a.h0 AND b_state = b.h0 THEN 1 WHEN a_state = 1 - a.h0 AND b_state = 1 - b.h0 THEN 2 END AS hp
FROM assigned s LEFT JOIN emitted a ON a.idx = s.a_idx LEFT JOIN emitted b ON b.idx = s.b_idx""")
def _(s, d):
    x = fx.observations(s, d).where("read_id % 3 = 0").groupBy("chrom", "read_id").agg(F.min("idx").alias("a_idx"), F.max("idx").alias("b_idx"))
    state = lambda k: F.when(F.col("read_id") % k == 0, 0).otherwise(1)
    x = x.select("chrom", "read_id", (1 + F.col("read_id") % 2).alias("hap"), "a_idx", state(5).alias("a_state"), "b_idx", state(4).alias("b_state"))
    return haplotag.methylation_tags(x, phased(s, d)).select("read_id", "hp")


@query("read_assignments", _with("phase", extra="""llr AS (SELECT read_id, count(*) AS n, count(*) FILTER (WHERE o.state = e.h0) AS match0, count(*) FILTER (WHERE o.state <> e.h0) AS match1, max(o.idx) AS last_idx
  FROM obs o JOIN emitted e ON e.idx = o.idx WHERE o.state >= 0 GROUP BY read_id HAVING count(*) > 1),
hp AS (SELECT *, CASE WHEN (match0 - match1) * ln(0.999 / 0.001) >= 4 THEN 'H1' WHEN (match0 - match1) * ln(0.999 / 0.001) <= -4 THEN 'H2' ELSE 'none' END AS haplotype FROM llr)""")
    + """SELECT CAST(read_id AS VARCHAR) AS read, haplotype, CASE WHEN haplotype = 'none' THEN 'none' ELSE CAST(coalesce((SELECT min(ps) FROM blocks b WHERE b.last_idx >= hp.last_idx), (SELECT max(ps) + 1 FROM blocks)) AS VARCHAR) END AS block FROM hp""")
def _(s, d):
    h = phased(s, d)
    return sinks.read_assignments(haplotag.assign_blocks(haplotag.tags(haplotag.read_llr(fx.observations(s, d), h)), h))


@query("tagged_sam", _with("reads") + "SELECT read_id, concat('r', CAST(read_id AS VARCHAR), CASE WHEN read_id % 3 = 0 THEN '' ELSE concat(chr(9), 'HP:i:', CAST(read_id % 3 AS VARCHAR)) END) AS value FROM reads")
def _(s, d):
    r = fx.reads(s, d)
    lines = r.select("chrom", "read_id", F.concat(F.lit("r"), F.col("read_id").cast("string")).alias("line"))
    tagged = r.where("read_id % 3 > 0").select("chrom", "read_id", (F.col("read_id") % 3).alias("hp"))
    return sinks.tagged_sam_lines(lines, tagged).select("read_id", "value")


# ------------------------------------------------------------- evaluation

_ALLELES = "calls AS (SELECT p_partkey AS pos, substring('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) AS ref, substring('CGTA', CAST(1 + p_partkey % 4 AS INT), 1) AS alt FROM {part} WHERE p_partkey % 7 > 0), truth AS (SELECT p_partkey AS pos, substring('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) AS ref, substring('CGTA', CAST(1 + p_partkey % 4 AS INT), 1) AS alt, p_size FROM {part} WHERE p_partkey % 5 > 0)"


@query("concordant_truth", "WITH " + _ALLELES.format(part="part") + " SELECT t.pos FROM calls c JOIN truth t ON c.pos = t.pos AND c.ref = t.ref AND c.alt = CASE WHEN t.p_size % 9 = 0 THEN 'N' ELSE t.alt END")
def _(s, d):
    part = s.read.parquet(f"{d}/part.parquet")
    x = lambda name: s.sql("WITH " + _ALLELES + f" SELECT 'chr1' AS chrom, * FROM {name}", part=part)
    truth = x("truth").withColumn("alt", F.when(F.col("p_size") % 9 == 0, "N").otherwise(F.col("alt"))).drop("p_size")
    return evaluate.concordant(x("calls"), truth, ["chrom", "pos"]).select("pos")


_SHARED = "shared AS (SELECT idx FROM variants WHERE idx % 3 < 2), pts AS (SELECT ps, pos, o, lag(o) OVER (PARTITION BY ps ORDER BY pos) AS prev FROM (SELECT e.ps, e.pos, (e.h0 + v.truth) % 2 AS o FROM emitted e JOIN variants v USING (idx) JOIN shared USING (idx)) x), points AS (SELECT *, (o <> prev)::INT AS switch FROM pts WHERE prev IS NOT NULL)"


@query("switch_errors_shared", _with("phase", extra=_SHARED) + "SELECT 'chr1' AS chrom, sum(switch)::BIGINT AS all_switches, count(*) AS all_assessed_pairs, sum(switch)::DOUBLE / count(*) AS all_switch_rate FROM points")
def _(s, d):
    from phaseframe.operators import decode

    shared = fx.variants(s, d).where("idx % 3 < 2")
    sets = decode.phase_sets(phased(s, d)).withColumnRenamed("ps", "block").join(shared.select("chrom", "idx"), ["chrom", "idx"], "left_semi")
    return evaluate.switch_errors(evaluate.switch_points(sets, shared.select("chrom", "pos", F.col("truth").alias("truth_h0")), ["chrom"]), ["chrom"])


_GAIN = "gain AS (SELECT c_nationkey AS sample, sum(c_custkey % 13) AS seq_phased, sum(c_custkey % 17) AS meth_phased FROM customer GROUP BY c_nationkey)"


@query("methylation_gain", f"WITH {_GAIN} SELECT sample, (meth_phased - seq_phased)::BIGINT AS gain FROM gain")
def _(s, d):
    x = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("sample"), "c_custkey")
    one = lambda k: x.groupBy("sample").agg(F.sum(F.col("c_custkey") % k).alias("phased"))
    return evaluate.gains(one(13), one(17), ["sample"], "phased").select("sample", F.col("gain").cast("long").alias("gain"))


@query(
    "block_join_analysis",
    _with("phase", "meth", extra="blk AS (SELECT ps // 5 AS block, min(block_start) AS block_start, max(block_end) AS block_end FROM blocks GROUP BY ps // 5), inner_ AS (SELECT m.block, p.block_start AS s, p.block_end AS e, lag(p.block_end) OVER (PARTITION BY m.block ORDER BY p.block_start) AS before FROM blk m JOIN blocks p ON p.block_start >= m.block_start AND p.block_end <= m.block_end)")
    + "SELECT block, s AS block_start, s - before AS gap, (SELECT count(*) FROM meth t WHERE t.site_start < i.s AND t.site_end > i.before) AS n_sites FROM inner_ i WHERE before IS NOT NULL",
)
def _(s, d):
    from phaseframe.operators import decode

    blocks = checkpoints.cut(decode.block_table(phased(s, d)), "blocks")
    large = ordered.dense_index(blocks, "chrom", "block_start", [], "ps").groupBy("chrom", F.expr("ps div 5").alias("block"))
    return evaluate.joined_gaps(blocks, large.agg(F.min("block_start").alias("block_start"), F.max("block_end").alias("block_end")), fx.methylation_sites(s, d)).select("block", "block_start", "gap", "n_sites")


@query("first_fit_rows")
def _(s, d):
    """Rows of a display in which the genes of a chromosome don't overlap."""
    return evaluate.first_fit_rows(fx.genes(s, d).select("chrom", "gene_start", "gene_end", "suppkey"), "gene_start", "gene_end", ["suppkey"])
