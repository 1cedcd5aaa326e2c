"""Text and binary readers, outputs, checkpoints."""

import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from phaseframe.operators import decode
from phaseframe.sources import bam, checkpoints, sinks, text

VCF = """##fileformat=VCFv4.2
##INFO=<ID=AT,Number=R,Type=String,Description="x">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
c1\t100\tv1\tA\tG\t30.5\tPASS\tAF=0.1;DB\tGT:GQ\t0/1:50\t1|1:9
c1\t200\tv2\tAC\tA,ACC\t.\tPASS\tAT=>1>2>3,>1>3;AF=0.2\tGT:PS\t1|2:100\t./.:.
c2\t5\tv3\tT\tC\t1\tq10\t.\tGT\t0/.\t0/1
"""


@pytest.fixture()
def files(tmp_path):
    def write(name, body):
        p = tmp_path / name
        p.write_text(body)
        return str(p)

    return write


def test_vcf(spark, files):
    path = files("a.vcf", VCF)
    x = {r["id"]: r for r in text.read_vcf(spark, path).collect()}
    assert x["v1"]["gt"] == [0, 1] and not x["v1"]["phased"] and x["v1"]["gq"] == 50 and x["v1"]["info"] == {"AF": "0.1", "DB": ""}
    assert x["v2"]["alts"] == ["A", "ACC"] and x["v2"]["gt"] == [1, 2] and x["v2"]["phased"] and x["v2"]["ps"] == 100 and x["v2"]["qual"] is None
    assert x["v2"]["allele_traversal"] == [["1", "2", "3"], ["1", "3"]] and x["v3"]["gt"] == [0, -1]
    assert text.vcf_has_info(spark, path, "AT") and not text.vcf_has_info(spark, path, "LV")
    assert text.vcf_samples(spark, path) == ["S1", "S2"]
    assert [r["id"] for r in text.read_vcf(spark, path, "c1", 150, 250).collect()] == ["v2"]
    assert text.read_vcf(spark, path, sample=1).where("id = 'v1'").first()["gt"] == [1, 1]


SAM = """@HD\tVN:1.6
r1\t0\tc1\t11\t60\t2S4M2D3M1I2M\t*\t0\t0\tACCGTCCATCGA\tIIIIIIIIIIII\tNM:i:1\tMM:Z:C+m,0,1;\tML:B:C,255,128
r2\t16\tc1\t31\t60\t8M\t*\t0\t0\tGGATCCGA\t*\tMM:Z:C+h,0;C+m?,1,0;\tML:B:C,9,64,32
r3\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII
"""


def test_sam_and_modifications(spark, files):
    x = text.read_sam(spark, files("a.sam", SAM))
    got = {r["read_name"]: r for r in text.modification_calls(x).collect()}
    assert (got["r1"]["read_start"], got["r1"]["read_end"]) == (10, 21) and got["r1"]["quals"] == [40] * 12
    assert got["r1"]["calls"] == {1: 255 / 256, 5: 0.5}  # first cytosine, then one skipped
    assert got["r2"]["calls"] == {1: 64 / 256, 0: 32 / 256} and got["r2"]["quals"] is None and not got["r2"]["is_forward"]
    assert got["r3"]["calls"] is None
    assert [r["read_name"] for r in text.read_sam(spark, files("b.sam", SAM), "c1", 25, 40).collect()] == ["r2"]


def test_fasta_windows(spark, files):
    path = files("a.fa", ">c1 some text\nacgtAC\nGTAC\n>c2\nTTTT\n")
    with pytest.raises(FileNotFoundError):
        text.read_fasta(spark, path)
    files("a.fa.fai", "c1\t10\t14\t6\t7\nc2\t4\t30\t4\t5\n")
    chunks = text.read_fasta(spark, path, chunk=4)
    assert {(r["chrom"], r["chunk_no"]): r["seq"] for r in chunks.collect()} == {("c1", 0): "ACGT", ("c1", 1): "ACGT", ("c1", 2): "AC", ("c2", 0): "TTTT"}
    assert {r["chrom"] for r in text.read_fasta(spark, path, chrom="c2").collect()} == {"c2"}
    w = spark.createDataFrame([("c1", 2, 9), ("c1", 4, 5), ("c2", 0, 4)], "chrom string, win_start long, win_end long")
    got = {(r["chrom"], r["win_start"]): r["ref_seq"] for r in text.reference_windows(w, chunks, 4).collect()}
    assert got == {("c1", 2): "GTACGTA", ("c1", 4): "A", ("c2", 0): "TTTT"}


def test_interval_tables(spark, files):
    bed = files("a.bed", "#c\nc1\t1\t5\tg1\nc1\t7\t9\tg2\n")
    assert [(r["start"], r["gene"]) for r in text.read_bed(spark, bed, ["chrom", "start", "end", "gene"]).orderBy("start").collect()] == [(1, "g1"), (7, "g2")]
    gff = files("a.gff3", "##gff\nc1\tx\tgene\t1\t9\t.\t+\t.\tID=a;gene_name=ABC;z=1\n")
    assert text.read_gff3_genes(spark, gff).first()["gene_name"] == "ABC"
    gtf = files("a.gtf", "c1\tx\tblock\t10\t90\t.\t+\t.\tid\n")
    assert tuple(text.read_gtf_blocks(spark, gtf).first()) == ("c1", 10, 90)
    meth = files("m.tsv", "#1\n#2\nc1\t5\t6\t50.0\tTotal\t20\t10\t10\t50.0\n")
    assert text.read_methylation(spark, meth).first()["ratio"] == 50.0
    tsv = [files(f"{t}.tsv", f"tool\tn\n{t}\t{k}\n") for k, t in enumerate("ab")]
    assert sorted((r["tool"], r["n"]) for r in text.read_tables(spark, tsv).collect()) == [("a", 0), ("b", 1)]


def _block(data):
    raw = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = raw.compress(data) + raw.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def test_bam(spark, tmp_path):
    name, seq = b"read1\0", "ACGTA"
    packed = bytes((bam._SEQ.index(a) << 4) | bam._SEQ.index(b) for a, b in zip(seq[::2], seq[1::2] + "="))
    tags = b"NMC\x01" + b"MMZC+m,0;\0" + b"MLBC" + struct.pack("<i", 1) + b"\xff"
    rec = struct.pack("<iiBBHHHiiii", 0, 99, len(name), 60, 0, 2, 16, 5, -1, -1, 0) + name + struct.pack("<II", 4 << 4, 1 << 4 | 1) + packed + bytes([30] * 5) + tags
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 1000) + (struct.pack("<i", len(rec)) + rec) * 2
    (tmp_path / "a.bam").write_bytes(_block(data[:50]) + _block(data[50:]) + _block(b""))
    bam.register(spark)
    got = spark.read.format("bam").load(str(tmp_path / "a.bam")).collect()
    assert len(got) == 2
    r = got[0]
    assert (r["read_name"], r["flag"], r["chrom"], r["read_start"], r["read_end"], r["cigar"], r["seq"]) == ("read1", 16, "c1", 99, 103, "4M1I", seq)
    assert r["quals"] == [30] * 5 and not r["is_forward"] and r["mm"] == "C+m,0;" and r["ml"] == "C,255"


def test_outputs(spark, tmp_path):
    v = spark.createDataFrame([("c", k, 10 * k + 1) for k in range(4)], "chrom string, idx long, pos long")
    m = spark.createDataFrame([("c", 0, 0.9, 0.1, 0.1, 0.9), ("c", 1, 0.1, 0.9, 0.9, 0.1), ("c", 2, 0.5, 0.5, 0.5, 0.5)], "chrom string, idx long, t00 double, t01 double, t10 double, t11 double")
    haps = decode.haplotypes(decode.blocks(v, m))
    calls = v.select("chrom", "idx", "pos", F.lit("id").alias("id"), F.lit("A").alias("ref"), F.array(F.lit("G")).alias("alts"), F.array(F.lit(0), F.lit(1)).alias("gt"))
    lines = [r["value"].split("\t") for r in sinks.phased_vcf_lines(calls, haps).orderBy("pos").collect()]
    assert [x[9] for x in lines] == ["1|0:0", "1|0:0", "0|1:0", "0|1:1"]
    sinks.write_vcf(sinks.phased_vcf_lines(calls, haps), str(tmp_path / "out.vcf"), "S")
    back = text.read_vcf(spark, f"{tmp_path}/out.vcf/*")
    assert [(r["pos"], r["ps"]) for r in back.orderBy("pos").collect()] == [(1, 0), (11, 0), (21, 0), (31, 1)]
    assert [(r["bed_start"], r["bed_end"]) for r in sinks.block_bed(haps, v).orderBy("bed_start").collect()] == [(1, 21), (31, 31)]
    tagged = spark.createDataFrame([("c", 1, 1, 5), ("c", 2, None, None)], "chrom string, read_id long, hp int, block long")
    assert [tuple(r) for r in sinks.read_assignments(tagged).orderBy("read").collect()] == [("1", "H1", "5"), ("2", "none", "none")]
    sam = spark.createDataFrame([("c", 1, "x"), ("c", 2, "y")], "chrom string, read_id long, line string")
    assert [r["value"] for r in sinks.tagged_sam_lines(sam, tagged).orderBy("read_id").collect()] == ["x\tHP:i:1", "y"]
    sinks.write_tsv(tagged.limit(0), str(tmp_path / "empty"), header=True)


def test_checkpoints(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert checkpoints.stage(spark, str(tmp_path), "a", make).count() == 3
    assert checkpoints.stage(spark, str(tmp_path), "a", make, force=True).count() == 3 and len(made) == 2
    assert checkpoints.cut(spark.range(4), "t").count() == 4


PLAIN_SESSION = """
from pyspark.sql import SparkSession
from phaseframe.sources import checkpoints
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
df = checkpoints.cut(spark.range(5), "x")
assert df.count() == 5 and checkpoints.shared_folder(spark) == checkpoints.shared_folder(spark)
print(checkpoints.shared_folder(spark).removeprefix("file://"), "done")
"""


def test_a_session_without_a_shared_folder(tmp_path):
    import os
    import subprocess
    import sys

    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", PLAIN_SESSION], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.endswith(" done\n"), done.stderr[-2000:]
    assert not os.path.exists(done.stdout.split()[-2])


def test_short_chunks_make_no_task_each_and_windows_cross_stretches(spark, tmp_path):
    seq = "".join("ACGT"[(k * k // 3 + k) % 4] for k in range(60_000))
    contigs = spark.createDataFrame([("c", seq)], "chrom string, seq string")
    path = sinks.write_fasta(contigs, f"{tmp_path}/r.fa")
    chunks = text.read_fasta(spark, path, 50, chunks_per_task=4)
    assert chunks.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < 1200 // 4
    places = [(0, 20), (40, 160), (999, 1001), (1999, 4002), (59_990, 60_050), (60_000, 60_010)]
    w = spark.createDataFrame([("c", a, b) for a, b in places], "chrom string, win_start long, win_end long")
    for size in (50, 2_000, 100_000):
        got = {(r["win_start"], r["win_end"]): r["ref_seq"] for r in text.reference_windows(w, text.read_fasta(spark, path, size), size).collect()}
        assert all((got[p] or "") == seq[p[0] : p[1]] for p in places)


def test_the_reference_is_never_broadcast(spark):
    chunks = spark.range(3).selectExpr("'c' AS chrom", "CAST(id AS INT) AS chunk_no", "id * 2000 AS chunk_start", "repeat('ACGTT', 400) AS seq")
    windows = spark.createDataFrame([("c", 998, 1003), ("c", 3998, 4004)], "chrom string, win_start long, win_end long")
    x = text.reference_windows(windows, chunks, 2000)
    assert {r["win_start"]: r["ref_seq"] for r in x.collect()} == {998: "TTACG", 3998: "TTACGT"}
    plan = x._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert re.search(r"SortMergeJoin \[[^\]]*__at", plan) and not re.search(r"BroadcastHashJoin \[[^\]]*__at", plan)
