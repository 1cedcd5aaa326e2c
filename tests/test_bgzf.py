"""Blocked gzip: blocks, indices, BAM by region and in pieces, compressed outputs."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from phaseframe.sources import bam, bgzf, bgzip, parts, text

SQ = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:c1\tLN:2000000\n@SQ\tSN:c2\tLN:900000\n"
SCHEMA = "read_name string, flag int, chrom string, read_start long, read_end long, mapq int, cigar string, seq string, quals array<int>, mm string, ml string, hp int"


def reads(n=3000, seed=1, long=0):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        chrom, top = rng.choice([("c1", 1_900_000), ("c1", 1_900_000), ("c2", 850_000)])
        size = rng.randint(20, 300) if k >= long else 150_000
        start = rng.randrange(top)
        quals = None if k % 7 == 0 else [rng.randint(0, 60) for _ in range(size)]
        mm, ml = ("C+m,0,1;", "C,1,2") if k % 5 == 0 else (None, None)
        out.append((f"r{k}", 16 * (k % 2), chrom, start, start + size + 5, 60, f"{size - 10}M5D10M", "".join(rng.choices("ACGTN", k=size)), quals, mm, ml, k % 3 or None))
    out.append(("lost", 4, None, None, None, 0, "*", "ACG", None, None, None, None))
    return out


@pytest.fixture()
def written(spark, tmp_path):
    def write(rows, single=True, name="a.bam"):
        bam.register(spark)
        df = spark.createDataFrame(rows, SCHEMA).repartition(7)
        path = str(tmp_path / name)
        ordered = bam.coordinate_order(df, bam.header_of_text(SQ))
        ordered.write.format("bam").option("header", SQ).option("single", single).mode("overwrite").save(path)
        return path

    return write


def columns(rows):
    return sorted((r[0], r[1], r[2], -1 if r[3] is None else r[3], r[5], r[6], r[7], r[8], r[9], r[10]) for r in rows)


NAMES = ["read_name", "flag", "chrom", "read_start", "mapq", "cigar", "seq", "quals", "mm", "ml"]


def test_written_and_read_in_pieces(spark, written):
    rows = reads()
    for single in (True, False):
        path = written(rows, single, f"{single}.bam")
        for index in (True, False):
            if not index:
                for f in bgzf.files(path, (".bam",)):
                    bgzf.resolve(f)[0].delete_file(bgzf.resolve(f + ".bai")[1])
            df = spark.read.format("bam").option("split_bytes", 60_000).load(path)
            assert df.rdd.getNumPartitions() > (3 if single else 7)
            got = df.select(*NAMES).collect()
            assert columns([(*r[:4], None, *r[4:]) for r in map(tuple, got)]) == columns(rows)


def test_regions(spark, written):
    rows = reads()
    path = written(rows)
    df = spark.read.format("bam").load(path)
    for chrom, start, end in (("c1", 100_000, 130_000), ("c2", 0, 5_000), ("c2", 800_000, 10**9), ("c1", 1_999_990, 2_000_000), ("c3", 0, 10)):
        got = df.where((F.col("chrom") == chrom) & (F.col("read_end") > start) & (F.col("read_start") < end))
        assert sorted(r["read_name"] for r in got.collect()) == sorted(r[0] for r in rows if r[2] == chrom and r[4] > start and r[3] < end)


def test_only_the_blocks_of_a_region_are_inflated(written, monkeypatch):
    path = written(reads(20_000))
    seen = []
    inflate = bgzf.inflate
    monkeypatch.setattr(bgzf, "inflate", lambda block: seen.append(1) or inflate(block))
    reader = bam._Reader({"path": path})
    every = sum(len(b) for p in reader.partitions() for b in reader.read(p))
    whole, seen[:] = len(seen), []
    reader = bam._Reader({"path": path})
    reader.chrom, reader.start, reader.end = "c1", 500_000, 510_000
    some = sum(len(b) for p in reader.partitions() for b in reader.read(p))
    assert every == 20_001 and 0 < some < 300 and len(seen) < whole / 8


def test_records_over_many_blocks(spark, written):
    rows = reads(60, long=12)
    path = written(rows)
    bgzf.resolve(path)[0].delete_file(path + ".bai")
    df = spark.read.format("bam").option("split_bytes", 30_000).load(path)
    assert df.rdd.getNumPartitions() > 10
    assert sorted(r["seq"] for r in df.select("seq").collect()) == sorted(r[7] for r in rows)


def test_first_record_is_found_from_every_block(written):
    path = written(reads(2000))
    file, header = bgzf.File(path), bam.read_header(path)
    stream, starts = bgzf.Stream(file, header.first), []
    while True:
        at = stream.tell()
        size = stream.read(4)
        if len(size) < 4:
            break
        starts.append(at)
        stream.read(int.from_bytes(size, "little"))
    at = header.first >> 16
    while (block := bgzf.next_block(file, at, file.size)) is not None:
        want = next((s for s in starts if s >> 16 >= block), None)
        assert bam.first_record(file, block, file.size, header.lengths) == want
        at = block + 1


def test_tags_are_kept_and_replaced(spark, written, tmp_path):
    path = written(reads(200))
    raw = spark.read.format("bam").option("raw", "true").load(path)
    out = str(tmp_path / "tagged.bam")
    hp = F.when(F.col("read_name") == "r5", 2).when(F.col("read_name") == "r6", 1)
    tagged = bam.coordinate_order(raw.withColumn("hp", hp), bam.read_header(path)).select("record", "hp")
    tagged.write.format("bam").option("header", bam.read_header(path).text).option("single", True).mode("overwrite").save(out)
    again = {r["read_name"]: r for r in spark.read.format("bam").option("raw", "true").load(out).collect()}
    before = {r["read_name"]: r for r in raw.collect()}
    for name, r in again.items():
        at = bam._offset_of_tags(r["record"])
        tags = {n: r["record"][low:high] for n, _, low, high in bam._tag_spans(r["record"], at)}
        assert (int.from_bytes(tags["HP"], "little") if "HP" in tags else None) == {"r5": 2, "r6": 1}.get(name)
        assert [r[c] for c in NAMES] == [before[name][c] for c in NAMES]
    assert list(bam._Reader({"path": out}).partitions()) and len(again) == 201


def test_existing_files_and_empty_tables(spark, written, tmp_path):
    path = written([])
    assert spark.read.format("bam").load(path).count() == 0
    with pytest.raises(Exception):
        spark.createDataFrame([], SCHEMA).write.format("bam").option("header", SQ).option("single", True).mode("append").save(path)


def test_index_holds_every_record():
    rng = random.Random(3)
    index, places = bgzf.Index(), []
    for k, start in enumerate(sorted(rng.randrange(5_000_000) for _ in range(2000))):
        end = start + rng.choice([1, 50, 20_000, 300_000])
        index.add(0, start, end, k << 16, (k + 1) << 16)
        places.append((start, end))
    for again in (index, bgzf.parse_index(index.bai(2)), bgzf.parse_index(index.tbi(["x"], 2, (1, 2, 0)))):
        for _ in range(200):
            low = rng.randrange(5_000_000)
            high = low + rng.choice([1, 1000, 100_000])
            held = again.stretches(0, low, high)
            wanted = [k for k, (a, b) in enumerate(places) if a < high and b > low]
            assert all(any(a <= k << 16 < b for a, b in held) for k in wanted)
            assert sum(b - a for a, b in held) >> 16 < len(wanted) + 900
    assert index.sorted and again.stretches(1, 0, 10) == []


def test_csi_with_finer_and_more_levels():
    """A third kind of index, for long contigs: other bins, and the least offset in each of them."""
    rng = random.Random(5)
    places = []
    bins = {}
    for k, start in enumerate(sorted(rng.randrange(1 << 32) for _ in range(500))):
        end = start + rng.choice([1, 5_000, 2_000_000])
        bins.setdefault(bgzf.bin_of(start, end, 12, 7), []).append((k << 16, (k + 1) << 16))
        places.append((start, end))
    names = b"c1\0"
    aux = struct.pack("<7i", 2, 1, 2, 0, ord("#"), 0, len(names)) + names
    body = struct.pack("<i", len(bins)) + b"".join(struct.pack("<IQi", b, s[0][0], len(s)) + b"".join(struct.pack("<2Q", *x) for x in s) for b, s in bins.items())
    again = bgzf.parse_index(parts.compressed_index(b"CSI\1" + struct.pack("<3i", 12, 7, len(aux)) + aux + struct.pack("<i", 1) + body))
    assert again.names == ["c1"] and (again.min_shift, again.depth) == (12, 7)
    for _ in range(200):
        low = rng.randrange(1 << 32)
        high = low + rng.choice([1, 100_000, 50_000_000])
        held = again.stretches(0, low, high)
        assert all(any(a <= k << 16 < b for a, b in held) for k, (s, e) in enumerate(places) if s < high and e > low)


def lines(n=5000, seed=2):
    rng = random.Random(seed)
    return sorted((("c1", "c2")[rng.random() < 0.3], rng.randint(1, 3_000_000), rng.choice(["A", "ACGT", "A" * 50]), k) for k in range(n))


def test_vcf_in_blocks(spark, tmp_path):
    rows = lines()
    head = '##fileformat=VCFv4.2\n##INFO=<ID=LV,Number=1,Type=Integer,Description="x">\n#' + "\t".join("CHROM POS ID REF ALT QUAL FILTER INFO FORMAT s".split())
    bgzip.register(spark)
    body = spark.createDataFrame([(c, p, "\t".join([c, str(p), f"v{k}", ref, "T", ".", "PASS", ".", "GT", "0/1"])) for c, p, ref, k in rows], "chrom string, pos long, value string")
    for single in (True, False):
        path = str(tmp_path / f"{single}.vcf.gz")
        body.repartition(6).orderBy("chrom", "pos").select("value").write.format("bgzip").option("header", head).option("single", single).mode("overwrite").save(path)
        if single:
            assert len(gzip.open(path).read().splitlines()) == len(rows) + 3
        df = spark.read.format("bgzip").option("split_bytes", 5000).load(path)
        assert df.rdd.getNumPartitions() > 6
        assert sorted(r["value"].split("\t")[2] for r in df.collect()) == sorted(f"v{k}" for *_, k in rows)
        for chrom, start, end in (("c1", 100_000, 200_000), ("c2", 2_900_000, 4_000_000), ("c9", 0, 5)):
            got = text.read_vcf(spark, path, chrom, start, end)
            assert sorted(r["id"] for r in got.collect()) == sorted(f"v{k}" for c, p, _, k in rows if c == chrom and start - 1 < p < end)
        assert text.vcf_has_info(spark, path, "LV") and text.vcf_samples(spark, path) == ["s"]
        assert text.read_vcf(spark, path).count() == len(rows)


def test_a_damaged_block_is_told():
    import io

    sink = io.BytesIO()
    w = bgzf.Writer(sink)
    w.write(b"x" * 1000)
    w.flush()
    data = bytearray(sink.getvalue())
    assert bgzf.inflate(bytes(data)) == b"x" * 1000
    data[-5] ^= 1
    with pytest.raises(ValueError):
        bgzf.inflate(bytes(data))
