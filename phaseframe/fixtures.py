"""Phasing-shaped inputs derived from the driver's star-schema tables.

Plain integer arithmetic only, so other engines can derive the same rows. Each
table is SQL text over one source table, with ``//`` for integer division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phaseframe.operators.intervals import points_in_intervals
from phaseframe.operators.ordered import dense_index
from pyspark.sql import functions as F

#: Variant calls: single-base, deletion, insertion and multi-allelic ones.
RAW_VARIANTS = """
SELECT 'chr1' AS chrom,
  1000 * p_partkey + 30000 * (p_partkey // 40) + (p_partkey * 31) % 700 + 1 AS pos,
  CASE WHEN p_partkey % 53 = 0 THEN concat('v_', CAST(p_partkey AS STRING)) ELSE concat('v', CAST(p_partkey AS STRING)) END AS id,
  CASE WHEN p_size % 10 = 7 THEN concat(substring('acgt', CAST(p_partkey % 4 AS INT) + 1, 1), substring('CATGACAT', 1, p_size % 4 + 1))
       ELSE substring('acgt', CAST(p_partkey % 4 AS INT) + 1, 1) END AS ref,
  CASE WHEN p_size % 10 = 7 THEN substring('ACGT', CAST(p_partkey % 4 AS INT) + 1, 1)
       WHEN p_size % 10 = 8 THEN concat(substring('ACGT', CAST(p_partkey % 4 AS INT) + 1, 1), substring('GGATCCAA', 1, p_size % 5 + 1))
       ELSE substring('ACGT', CAST((p_partkey + 1) % 4 AS INT) + 1, 1) END AS alt1,
  CASE WHEN p_size % 10 = 9 THEN substring('ACGT', CAST((p_partkey + 2) % 4 AS INT) + 1, 1) END AS alt2,
  CASE WHEN p_partkey % 41 = 0 THEN -1 WHEN p_partkey % 5 = 0 THEN 1 ELSE CAST((p_partkey + p_size) % 2 AS INT) END AS gt_a,
  CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE CAST(1 - (p_partkey + p_size) % 2 AS INT) END AS gt_b,
  p_partkey % 3 = 0 AS phased,
  CAST((p_partkey * 7) % 60 AS INT) AS gq,
  CASE WHEN p_partkey % 11 = 0 THEN 'LowQual' ELSE 'PASS' END AS filter,
  CASE WHEN p_partkey % 97 = 0 THEN 'BND' WHEN p_size % 10 = 7 THEN 'DEL' WHEN p_size % 10 = 8 THEN 'INS' END AS svtype,
  p_partkey AS partkey, p_size AS size
FROM {part}"""

#: Called sites with a class and a true allele order.
SITES = """
SELECT 'chr1' AS chrom, p_partkey AS partkey,
  1000 * p_partkey + 30000 * (p_partkey // 40) + (p_partkey * 31) % 700 + 1 AS pos,
  CASE WHEN p_size % 10 < 7 THEN 'SNP' WHEN p_size % 10 = 7 THEN 'DEL' WHEN p_size % 10 = 8 THEN 'INS' ELSE 'MULTI' END AS vtype,
  CAST(p_size % 2 AS INT) AS truth
FROM {part}"""

READS = """
SELECT 'chr1' AS chrom, o_orderkey AS read_id,
  (o_orderkey * 7919 + o_custkey * 104729) % {max_pos} AS read_start,
  (o_orderkey * 7919 + o_custkey * 104729) % {max_pos} + 2000 + 1500 * (o_orderkey % 9) AS read_end,
  CAST((o_orderkey * 17 + o_custkey) % 61 AS INT) AS mapq,
  CAST(o_orderkey % 2 AS INT) AS hap,
  CAST((o_orderkey // 2) % 2 AS INT) AS strand,
  CAST(16 * ((o_orderkey // 2) % 2) + CASE WHEN o_orderkey % 50 = 0 THEN 256 ELSE 0 END
    + CASE WHEN o_orderkey % 51 = 0 THEN 1024 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 2048 ELSE 0 END AS INT) AS flag,
  o_orderkey % 3 <> 0 AS has_mods
FROM {orders}"""

METH_SITES = """
SELECT 'chr1' AS chrom, 347 * event_id AS site_start, 347 * event_id + 1 AS site_end,
  CAST(5 + user_id % 40 AS INT) AS coverage, value - 100 * floor(value / 100) AS ratio
FROM {events}"""

GENES = """
SELECT 'chr1' AS chrom, 20000 * s_suppkey + (s_suppkey * 37) % 9000 AS gene_start,
  20000 * s_suppkey + (s_suppkey * 37) % 9000 + 4000 + 3000 * (s_suppkey % 11) AS gene_end,
  concat('gene', CAST(s_suppkey // 2 AS STRING)) AS gene, s_suppkey AS suppkey
FROM {supplier}"""


def _sql(spark: SparkSession, text: str, **tables) -> DataFrame:
    return spark.sql(text.replace(" // ", " div "), **tables)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the orders, dealt out over all cores: a small file is one split, and an order becomes a read of hundreds of bases."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(tasks, "o_orderkey")


def raw_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _sql(spark, RAW_VARIANTS, part=_table(spark, sf_dir, "part"))
    alts = F.when(F.col("alt2").isNull(), F.array("alt1")).otherwise(F.array("alt1", "alt2"))
    return df.withColumn("alts", alts).withColumn("gt", F.array("gt_a", "gt_b"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_index(_sql(spark, SITES, part=_table(spark, sf_dir, "part")), "chrom", "pos", ["partkey"])


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _sql(spark, SITES, part=_table(spark, sf_dir, "part")).agg(F.max("pos")).first()[0]
    return _sql(spark, READS, orders=_orders(spark, sf_dir), max_pos=top or 1)


def observations(spark: SparkSession, sf_dir: str, min_mapq: int = 20) -> DataFrame:
    """Alleles that reads carry: read_id, idx, state (-1 unknown), direct, strand, hap, truth."""
    joined = points_in_intervals(
        variants(spark, sf_dir).withColumn("at", F.col("pos") - 1),
        reads(spark, sf_dir).where(F.col("mapq") >= min_mapq),
        "chrom",
        "at",
        "read_start",
        "read_end",
    )
    r, i = F.col("read_id"), F.col("idx")
    state = (
        F.when((r * 7 + i * 11) % 29 == 0, -1)
        .when((r * 5 + i * 3) % 37 == 0, 1 - (F.col("truth") + F.col("hap")) % 2)
        .otherwise((F.col("truth") + F.col("hap")) % 2)
        .cast("int")
    )
    return joined.select(
        "chrom", "read_id", "idx", "pos", "vtype", "truth", "hap", "strand", state.alias("state"), ((r + i) % 13 != 0).alias("direct")
    )


def methylation_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, METH_SITES, events=_table(spark, sf_dir, "events"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, GENES, supplier=_table(spark, sf_dir, "supplier"))


# ------------------------------------------------------------- alignments with sequences
# Two chromosomes of blocks of 100 bases, each block the same text but for one variant. A read covers
# three blocks; two blocks of forty have no variant, so no read links those beside them.

#: The text of a block.
BLOCK = "TAACGGCGCGTTAGCGACGGCAAGGCGACGAACACTATAACACAGAGCATGACATACCAGGTAGCCGTCTTGACCACGCAAGAGTTGCTGTGCGACGGCG"
#: By kind: offset in the block, reference and alternative allele.
ALLELES = ((17, "C", "T"), (57, "C", "A"), (30, "A", "AGT"), (45, "AG", "CT"), (77, "GCAA", "G"))
N_BLOCKS = "(SELECT 5 * greatest(count(*) // 150, 2) + 3 FROM {orders})"
_CHROMS = "(SELECT 'chr1' AS chrom UNION ALL SELECT 'chr2' AS chrom) c"
_CASE = lambda k: "CASE b % 5 " + " ".join(f"WHEN {n} THEN {a[k]!r}" for n, a in enumerate(ALLELES)) + " END"

BLOCK_VARIANTS = (
    "SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY b) - 1 AS idx, b, 100 * b + " + _CASE(0) + " + 1 AS pos, concat('b', CAST(b AS STRING)) AS id,\n"
    "  " + _CASE(1) + " AS ref, " + _CASE(2) + " AS alt, CAST((b * 7 + b // 3) % 2 AS INT) AS truth\n"
    "FROM (SELECT p_partkey AS b FROM {part} WHERE p_partkey < " + N_BLOCKS + ") p CROSS JOIN " + _CHROMS + " WHERE b % 40 NOT IN (18, 19)"
)


def _piece(k: int) -> tuple[str, str]:
    """SQL for the sequence and the CIGAR of the k-th block of a read; b{k} is its number, c{k} the allele it carries."""
    skip = 10 if k == 0 else 0
    text, b, c = BLOCK, f"b{k}", f"c{k}"
    seqs, cigars = [], []
    for kind, (at, ref, alt) in enumerate(ALLELES):
        head, tail = text[skip:at], text[at + len(ref) :]
        bases = f"CASE WHEN n{k} = 1 THEN 'N' WHEN {c} = 1 THEN '{alt}' ELSE '{ref}' END" if len(ref) == len(alt) == 1 else f"CASE WHEN {c} = 1 AND w{k} = 1 THEN 'AGA' WHEN {c} = 1 THEN '{alt}' ELSE '{ref}' END"
        seqs.append(f"WHEN {kind} THEN concat('{head}', {bases}, '{tail}')")
        n = at - skip + 1
        step = f"{len(alt) - 1}I" if len(alt) > len(ref) else f"{len(ref) - 1}D" if len(alt) < len(ref) else ""
        if step:
            cigars.append(f"WHEN {kind} THEN CASE WHEN {c} = 1 THEN '{n}M{step}{100 - at - len(ref)}M' ELSE '{100 - skip}M' END")
    plain = f"{b} % 40 IN (18, 19)"
    seq = f"CASE WHEN {plain} THEN '{text[skip:]}' ELSE CASE {b} % 5 {' '.join(seqs)} END END"
    return seq, f"CASE WHEN {plain} THEN '{100 - skip}M' ELSE CASE {b} % 5 {' '.join(cigars)} ELSE '{100 - skip}M' END END"


_PIECES = [_piece(k) for k in range(3)]
_FLAGS = ", ".join(
    f"CAST(((first_block + {k}) * 7 + (first_block + {k}) // 3 + hap + CASE WHEN (ok * 5 + (first_block + {k}) * 3) % 37 = 0 THEN 1 ELSE 0 END) % 2 AS INT) AS c{k}, first_block + {k} AS b{k},"
    f" CASE WHEN (ok * 3 + first_block + {k}) % 31 = 0 THEN 1 ELSE 0 END AS n{k}, CASE WHEN (ok + first_block + {k}) % 13 = 0 AND (first_block + {k}) % 5 = 2 THEN 1 ELSE 0 END AS w{k}"
    for k in range(3)
)
_READ_COLUMNS = (
    "SELECT chrom, ok, concat('r', CAST(ok AS STRING)) AS read_name, hap, flag, mapq, 100 * b0 + 10 AS read_start, 100 * b0 + 300 AS read_end,\n"
    "  b0, b1, b2, c0, c1, c2, n0, n1, n2, w0, w1, w2, clip, CASE WHEN ok % 29 = 0 THEN 0 ELSE 30 END AS qual"
)
_READ_TEXTS = (
    ",\n  concat(CASE WHEN clip > 0 THEN concat(CAST(clip AS STRING), 'S') ELSE '' END, " + ", ".join(p[1] for p in _PIECES) + ") AS cigar,\n"
    "  concat(substring('AAAA', 1, clip), " + ", ".join(p[0] for p in _PIECES) + ") AS seq"
)
_READ_FACTS = (
    "\nFROM (SELECT *, " + _FLAGS + " FROM (\n"
    "  SELECT o_orderkey AS ok, CASE WHEN o_orderkey % 3 = 0 THEN 'chr2' ELSE 'chr1' END AS chrom, (o_orderkey * 7919 + o_custkey * 104729) % (" + N_BLOCKS + " - 3) AS first_block,\n"
    "    CAST((o_orderkey // 4) % 2 AS INT) AS hap, CAST(o_custkey % 4 AS INT) AS clip, CAST((o_orderkey * 17 + o_custkey) % 61 AS INT) AS mapq,\n"
    "    CAST(16 * ((o_orderkey // 2) % 2) + CASE WHEN o_orderkey % 50 = 0 THEN 256 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 2048 ELSE 0 END AS INT) AS flag\n"
    "  FROM {orders}) a) f"
)
BLOCK_READS = _READ_COLUMNS + _READ_TEXTS + _READ_FACTS


#: Offsets of cytosines in a block that may be methylated, on the haplotype h of block b where b + (number of the offset) + h is odd.
METHYLATED = (25, 65, 92)


def _made_piece(k: int, kind: int, c: int, n: int, w: int) -> tuple[str, str]:
    """Sequence and CIGAR of ``_piece`` for a block of the kind with the allele c."""
    skip, (at, ref, alt) = 10 if k == 0 else 0, ALLELES[kind]
    if len(ref) == len(alt) == 1:
        bases = "N" if n == 1 else alt if c == 1 else ref
    else:
        bases = ref if c != 1 else "AGA" if w == 1 else alt
    step = f"{len(alt) - 1}I" if len(alt) > len(ref) else f"{len(ref) - 1}D" if len(alt) < len(ref) else ""
    cigar = f"{at - skip + 1}M{step}{100 - at - len(ref)}M" if step and c == 1 else f"{100 - skip}M"
    return BLOCK[skip:at] + bases + BLOCK[at + len(ref) :], cigar


def _made_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``BLOCK_READS`` with ``sites``, the query indices of the methylated offsets; the few texts that a block can have are looked
    up by their number. The cases written out are so long a method that the JVM never compiles it, and all else that is done
    with a read runs in the same one."""
    from phaseframe.operators.cigar import flat_operations

    x = _sql(spark, _READ_COLUMNS + _READ_FACTS, orders=_orders(spark, sf_dir))
    picked: tuple[list, list] = [], []
    before, sites = F.col("clip"), []  # bases of the read before the block
    for k in range(3):
        made = [_made_piece(k, kind, c, n, w) for kind in range(5) for c in (0, 1) for n in (0, 1) for w in (0, 1)]
        skip = 10 if k == 0 else 0
        made.append((BLOCK[skip:], f"{100 - skip}M"))  # a block without a variant
        number = ((F.col(f"b{k}") % 5 * 2 + F.col(f"c{k}")) * 2 + F.col(f"n{k}")) * 2 + F.col(f"w{k}")
        x = x.withColumn(f"__{k}", F.when((F.col(f"b{k}") % 40).isin(18, 19), len(made) - 1).otherwise(number).cast("int"))
        for column, texts in zip(picked, zip(*made)):
            column.append(F.get(F.lit(list(texts)), F.col(f"__{k}")))
        ops = list(zip(*flat_operations([cigar for _, cigar in made])))
        for at in METHYLATED:  # no variant stands there
            own = [next(q + at - skip - r for piece, op, size, q, r in ops if piece == m and op == "M" and r <= at - skip < r + size) for m in range(len(made))]
            sites.append((before + F.get(F.lit([int(q) for q in own]), F.col(f"__{k}"))).cast("int"))
        before = before + F.get(F.lit([len(seq) for seq, _ in made]), F.col(f"__{k}"))
    clip = F.when(F.col("clip") > 0, F.concat(F.col("clip").cast("string"), F.lit("S"))).otherwise("")
    x = x.withColumn("cigar", F.concat(clip, *picked[1])).withColumn("seq", F.concat(F.substring(F.lit("AAAA"), F.lit(1), F.col("clip")), *picked[0])).withColumn("sites", F.array(*sites))
    return x.drop(*[f"__{k}" for k in range(3)])


def block_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, idx, b, pos, id, ref, alts, gt, vtype, truth (allele of haplotype 0)."""
    v = _sql(spark, BLOCK_VARIANTS, part=_table(spark, sf_dir, "part"), orders=_table(spark, sf_dir, "orders"))
    alts = F.array("alt")
    from phaseframe.operators.variants import variant_type

    return v.select("chrom", "idx", "b", "pos", "id", "ref", alts.alias("alts"), F.array(F.lit(0), F.lit(1)).alias("gt"), variant_type(F.col("ref"), alts).alias("vtype"), "truth")


def block_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments as the readers give them, with what they were made from and ``calls`` of modified bases."""
    return with_quals(_made_reads(spark, sf_dir).drop("sites"))


def with_quals(x: DataFrame) -> DataFrame:
    return x.withColumn("quals", F.array_repeat("qual", F.length("seq"))).withColumn("is_forward", F.col("flag").bitwiseAND(16) == 0)


def n_blocks(spark: SparkSession, sf_dir: str) -> int:
    """Blocks of a chromosome. What is made of this number is a range, whose size Spark knows: rows exploded from
    one row would count as one, and be sent to the driver and all executors as a small table."""
    return _sql(spark, "SELECT " + N_BLOCKS + " AS n", orders=_table(spark, sf_dir, "orders")).first()["n"]


def block_reference(spark: SparkSession, sf_dir: str, chunk: int = 100_000) -> DataFrame:
    """chrom, chunk_no, chunk_start, seq."""
    n = n_blocks(spark, sf_dir)
    rows = spark.range((n * len(BLOCK) - 1) // chunk + 1).select(F.col("id").cast("int").alias("chunk_no"))
    rows = rows.withColumn("chrom", F.explode(F.array(F.lit("chr1"), F.lit("chr2")))).withColumn("chunk_start", F.col("chunk_no").cast("long") * chunk)
    size = F.least(F.lit(chunk), F.lit(n * len(BLOCK)) - F.col("chunk_start")).cast("int")
    return rows.select("chrom", "chunk_no", "chunk_start", F.substring(F.lit(BLOCK * (chunk // len(BLOCK))), F.lit(1), size).alias("seq"))


def block_methylation_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, site_start, site_end, coverage, mod_count, unmod_count, ratio: half of the reads are methylated everywhere."""
    x = spark.range(2 * len(METHYLATED) * n_blocks(spark, sf_dir)).withColumn("b", F.expr(f"id div {2 * len(METHYLATED)}"))
    x = x.withColumn("chrom", F.when(F.col("id") % 2 == 0, "chr1").otherwise("chr2"))
    x = x.withColumn("site_start", F.col("b") * len(BLOCK) + F.get(F.lit(list(METHYLATED)), F.expr(f"(id div 2) % {len(METHYLATED)}").cast("int")))
    cover = (F.lit(16) + 2 * (F.col("b") % 10)).cast("int")
    return x.select("chrom", "site_start", (F.col("site_start") + 1).alias("site_end"), cover.alias("coverage"), (cover / 2).cast("int").alias("mod_count"), (cover / 2).cast("int").alias("unmod_count"), F.lit(50.0).alias("ratio"))


def block_modified_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``block_reads`` with ``calls``: map from query index to probability at the methylated offsets, missing in one block of 17."""
    x = with_quals(_made_reads(spark, sf_dir))

    def call(k: int, n: int):
        b = F.col(f"b{k}")
        p = F.when((b + n + F.col("hap")) % 2 == 1, 254.0).otherwise(2.0) / 256
        return F.struct(F.col("sites")[len(METHYLATED) * k + n].alias("q"), F.when((F.col("ok") + b) % 17 != 0, p).alias("p"))

    every = F.array(*[call(k, n) for k in range(3) for n in range(len(METHYLATED))])
    return x.withColumn("calls", F.map_from_entries(F.filter(every, lambda c: c["p"].isNotNull()))).select(*block_reads(spark, sf_dir).columns, "calls")
