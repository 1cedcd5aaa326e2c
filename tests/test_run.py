"""The command line on files made from the sequence fixture, and phasing over gaps by methylation."""

import pytest
from pyspark.sql import functions as F

from phaseframe import fixtures as fx
from phaseframe import run
from phaseframe.plans import catalogue, catalogue_reads
from phaseframe.sources import text


@pytest.fixture(scope="module")
def files(spark, tiny, tmp_path_factory):
    """A VCF with two unphaseable records, a SAM and a FASTA file."""
    folder = tmp_path_factory.mktemp("inputs")
    v = fx.block_variants(spark, tiny).orderBy("chrom", "pos").collect()
    rows = [f"{r['chrom']}\t{r['pos']}\t{r['id']}\t{r['ref']}\t{r['alts'][0]}\t50\tq10\tDB\tGT:DP\t0/1:7" for r in v]
    rows.insert(3, "chr1\t200\thom\tA\tC\t.\tPASS\t.\tGT\t1/1")
    rows.insert(4, "chr1\t201\tnone\tA\tC\t.\tPASS\t.\tGT\t./.")
    head = ["##fileformat=VCFv4.2", '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tone"]
    (folder / "calls.vcf").write_text("\n".join(head + rows) + "\n")
    reads = fx.block_reads(spark, tiny).collect()
    lines = [f"{r['read_name']}\t{r['flag']}\t{r['chrom']}\t{r['read_start'] + 1}\t{r['mapq']}\t{r['cigar']}\t*\t0\t0\t{r['seq']}\t{chr(33 + r['qual']) * len(r['seq'])}" for r in reads]
    (folder / "reads.sam").write_text("@HD\tVN:1.6\n" + "\n".join(lines) + "\n")
    blocks = 1 + max(r["b"] for r in v)
    (folder / "ref.fa").write_text("".join(f">{c}\n" + (fx.BLOCK + "\n") * blocks for c in ("chr1", "chr2")))
    first = len(">chr1\n")
    starts = (first, first + blocks * (len(fx.BLOCK) + 1) + len(">chr2\n"))
    (folder / "ref.fa.fai").write_text("".join(f"{c}\t{blocks * len(fx.BLOCK)}\t{at}\t{len(fx.BLOCK)}\t{len(fx.BLOCK) + 1}\n" for c, at in zip(("chr1", "chr2"), starts)))
    return folder


def agreement(rows):
    """Share of neighbours of a block with the planted orientation. rows: chrom, block, pos, h0, truth, in order."""
    same = [(a[3] + a[4]) % 2 == (b[3] + b[4]) % 2 for a, b in zip(rows, rows[1:]) if a[:2] == b[:2]]
    return sum(same) / len(same)


def test_files_to_files(spark, tiny, files, tmp_path):
    out = {k: str(tmp_path / k) for k in ("vcf", "blocks", "bam", "read_assignments", "differentially_methylated_sites")}
    argv = ["--vcf", str(files / "calls.vcf"), "--bam", str(files / "reads.sam"), "--reference", str(files / "ref.fa"), "--pacbio", "--log", str(tmp_path / "log"), "--checkpoints", str(tmp_path / "stages")]
    argv += [x for k, path in out.items() for x in (f"--output_{k}", path)]
    args = run.parser().parse_args(argv)
    run.start_log(args.log, False)
    found = run.run(spark, args)
    assert found["variants"].count() == fx.block_variants(spark, tiny).count()
    want = {(r["chrom"], r["read_id"], r["idx"]): r["state"] for r in catalogue_reads._observed(spark, tiny).collect()}
    assert {(r["chrom"], r["read_id"], r["idx"]): r["state"] for r in found["observations"].collect()} == want

    lines = [r["value"] for r in spark.read.text(f"{out['vcf']}/*").collect()]
    body = sorted((x.split("\t") for x in lines if not x.startswith("#")), key=lambda f: (f[0], int(f[1])))
    given = [x.split("\t") for x in (files / "calls.vcf").read_text().splitlines() if not x.startswith("#")]
    assert [f[:8] for f in body] == sorted((f[:8] for f in given), key=lambda f: (f[0], int(f[1])))
    assert sum(x.startswith("##FORMAT=<ID=PS") for x in lines) == 1 and any("ID=DP" in x for x in lines)
    by = {(f[0], f[2]): f for f in body}
    assert by["chr1", "hom"][8:] == ["GT:PS", "1/1:."] and by["chr1", "none"][8:] == ["GT:PS", "./.:."]
    truth = {(r["chrom"], r["pos"]): r["truth"] for r in fx.block_variants(spark, tiny).collect()}
    phased = [(f[0], int(f[9].split(":")[2]), int(f[1]), int(f[9][0]), truth[f[0], int(f[1])]) for f in body if "|" in f[9]]
    assert all(f[8] == "GT:DP:PS" and f[9].split(":")[1] == "7" for f in body if f[2].startswith("b"))
    assert len(phased) > 0.9 * len(truth) and agreement(phased) > 0.95
    assert spark.read.csv(out["blocks"], sep="\t").count() == len({p[:2] for p in phased})
    tags = {r[0]: r[1] for r in spark.read.csv(out["read_assignments"], sep="\t").collect()}
    sam = [r["value"] for r in spark.read.text(out["bam"]).collect()]
    assert len(sam) == 1500 and {x.split("\t")[0] for x in sam if x.endswith("HP:i:1")} <= {k for k, v in tags.items() if v == "H1"}
    assert sum(v != "none" for v in tags.values()) > 0.5 * len(tags)
    assert [r["value"] for r in spark.read.text(out["differentially_methylated_sites"]).collect()][:1] in ([], ["chrom\tstart\tend\tscore\thap\tcoverage\tmod_count\tunmod_count\tratio"])
    assert "Writing phased calls" in (tmp_path / "log").read_text()


def test_technology_is_needed():
    with pytest.raises(SystemExit):
        run.parser().parse_args(["--vcf", "a", "--bam", "b", "--reference", "c"])
    args = run.parser().parse_args(["--vcf", "a", "--bam", "b", "--reference", "c", "--ont", "--flank_snv", "5"])
    assert run.config_of(args).flank_snv == 5 and run.config_of(args).flank_indel == 200


def test_methylation_joins_blocks(spark, tiny):
    truth = fx.block_variants(spark, tiny).select("chrom", "idx", "truth")
    rows = {}
    for name in ("phase_from_alignments", "phase_with_methylation"):
        x = catalogue.QUERIES[name](spark, tiny).join(truth, ["chrom", "idx"]).where("h0 >= 0").orderBy("chrom", "idx").collect()
        rows[name] = [(r["chrom"], r["block_id"], r["idx"], r["h0"], r["truth"]) for r in x]
        assert len(x) > 90 and agreement(rows[name]) > 0.95
    blocks = {n: len({r[:2] for r in x}) for n, x in rows.items()}
    assert blocks["phase_with_methylation"] < blocks["phase_from_alignments"]
    filled = catalogue.QUERIES["filled_transitions"](spark, tiny).agg(F.sum("n_filled")).first()[0]
    assert filled == blocks["phase_from_alignments"] - blocks["phase_with_methylation"]


def test_phasing_does_not_depend_on_partitions(spark, tiny):
    found = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, catalogue.QUERIES["phase_from_alignments"](spark, tiny).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_a_vcf_keeps_its_records(spark, files):
    assert text.read_vcf(spark, str(files / "calls.vcf")).where("line IS NULL").count() == 0


def test_bam_to_bam(spark, tiny, files, tmp_path):
    """BAM and compressed VCF in and out; two records of one position without an id; tables; stages by parameters."""
    from phaseframe.sources import bam, bgzip, checkpoints

    bam.register(spark)
    bgzip.register(spark)
    sq = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:100000\n@SQ\tSN:chr2\tLN:100000\n"
    reads = fx.block_reads(spark, tiny).select("read_name", "flag", "chrom", "read_start", "mapq", "cigar", "seq", "quals")
    bam_path, vcf_path = str(tmp_path / "reads.bam"), str(tmp_path / "calls.vcf.gz")
    bam.coordinate_order(reads, bam.header_of_text(sq)).write.format("bam").option("header", sq).option("single", "true").mode("overwrite").save(bam_path)
    lines = (files / "calls.vcf").read_text().splitlines()
    first = next(x for x in lines if x.startswith("chr1\t") and "\tb" in x).split("\t")
    twins = ["\t".join([*first[:2], ".", first[3], alt, *first[5:9], gt]) for alt, gt in (("GG", "1/1:3"), ("TT", "0/1:4"))]
    first[2] = "."
    lines = [x for x in lines if x.startswith("#")] + sorted([x for x in lines if not x.startswith("#") and x.split("\t")[:2] != first[:2]] + ["\t".join(first), *twins], key=lambda x: (x.split("\t")[0], int(x.split("\t")[1])))
    body = spark.createDataFrame([(x,) for x in lines if not x.startswith("#")], "value string").coalesce(1)
    body.write.format("bgzip").option("header", "\n".join(x for x in lines if x.startswith("#"))).option("single", "true").mode("overwrite").save(vcf_path)

    out = {k: str(tmp_path / f"out{v}") for k, v in {"vcf": ".vcf.gz", "bam": ".bam", "read_assignments": "_assignments", "transition_matrix": "_matrix", "read_states": "_states", "variant_read_mapping": "_mapping", "allele_coverage": "_coverage", "unphaseable_variants": "_unphaseable"}.items()}
    argv = ["--vcf", vcf_path, "--bam", bam_path, "--reference", str(files / "ref.fa"), "--pacbio", "--chrom", "chr1", "--log", str(tmp_path / "log"), "--checkpoints", str(tmp_path / "stages")]
    args = run.parser().parse_args(argv + [x for k, path in out.items() for x in (f"--output_{k}", path)])
    run.start_log(args.log, False)
    found = run.run(spark, args)

    given = [x.split("\t") for x in lines if x.startswith("chr1\t")]
    got = [r["line"].split("\t") for r in text.read_vcf(spark, out["vcf"]).collect()]
    assert sorted(f[:8] for f in got) == sorted(f[:8] for f in given)  # each record once
    same = [f for f in got if f[:2] == first[:2]]
    assert {f[4]: f[9] for f in same}["GG"].startswith("1/1:") and all(f[9].split(":")[-1] == "." for f in same if f[4] == "GG")
    assert [r["pos"] for r in text.read_vcf(spark, out["vcf"], "chr1", 500, 1500).orderBy("pos").collect()] == sorted(int(f[1]) for f in given if 500 <= int(f[1]) < 1500)

    tags = {r[0]: r[1] for r in spark.read.csv(out["read_assignments"], sep="\t").collect()}
    tagged = spark.read.format("bam").option("tags", "HP").load(out["bam"])
    hp = {r["read_name"]: r["HP"] for r in tagged.where("flag & 1796 = 0").collect()}
    assert tagged.count() == reads.where("chrom = 'chr1'").count() and len(hp) > 500
    assert {k: {"H1": 1, "H2": 2, "none": None}[tags[k]] for k in hp if k in tags} == {k: v for k, v in hp.items() if k in tags} and {1, 2} <= set(hp.values())

    table = lambda name: spark.read.csv(out[name], sep="\t", header=True)
    assert text.read_states(spark, out["read_states"]).count() == found["observations"].count() and set(table("allele_coverage").columns) >= {"chrom", "idx", "c0", "c1"}
    assert table("transition_matrix").count() > 20 and table("variant_read_mapping").count() > 500 and table("unphaseable_variants").columns == ["chrom", "idx", "pos"]
    assert "isn't sorted" not in (tmp_path / "log").read_text()

    # other parameters and other inputs make other stages
    stages = lambda: {p.name for p in (tmp_path / "stages").iterdir()}
    before = stages()
    again = run.run(spark, run.parser().parse_args(argv))
    assert stages() == before and again["observations"].count() == found["observations"].count()
    fewer = run.run(spark, run.parser().parse_args([*argv, "--min_mapq", "50"]))
    assert len(stages()) == 2 * len(before) and fewer["observations"].count() < found["observations"].count()
    key = checkpoints.fingerprint(spark, bam_path)
    with open(bam_path, "ab") as f:
        f.write(bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"))
    assert checkpoints.fingerprint(spark, bam_path) != key
