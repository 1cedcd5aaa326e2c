"""Registered queries on alignments, methylation sites, intervals and tool comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe import fixtures as fx
from phaseframe.operators import cigar, decode, evaluate, intervals, methylation, realign, transitions
from phaseframe.operators import variants as vr
from phaseframe.plans.catalogue import _PAIRS_SQL, _matrix, _mean_coverage, _mirror_sql, _phaseable, _with, phased, query
from phaseframe.sources.checkpoints import cut

# ------------------------------------------------------------- alignments

#: CIGAR strings by read, varied by arithmetic on the order key.
_CIGAR = """cig AS (SELECT o_orderkey AS read_id, concat(CAST(o_orderkey % 5 AS {s}), 'S', CAST(10 + o_orderkey % 40 AS {s}), '=1X', CAST(1 + o_custkey % 4 AS {s}), 'I',
  CAST(20 + o_custkey % 30 AS {s}), '=', CAST(1 + o_orderkey % 3 AS {s}), 'D', CAST(30 + o_orderkey % 20 AS {s}), 'M') AS cigar,
  5 + o_orderkey % 60 AS at_ FROM {{orders}})"""


def _cigars(s, d) -> DataFrame:
    text = "WITH " + _CIGAR.format(s="STRING") + " SELECT * FROM cig"
    return s.sql(text, orders=s.read.parquet(f"{d}/orders.parquet"))


_CIG = _CIGAR.format(s="VARCHAR").format(orders="orders")
_OPS = """ops AS (SELECT read_id, at_, unnest(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]')) AS tok, generate_subscripts(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]'), 1) AS k FROM cig),
parsed AS (SELECT read_id, at_, k, right(tok, 1) AS op, CAST(left(tok, length(tok) - 1) AS INT) AS len FROM ops),
offs AS (SELECT *, coalesce(sum(CASE WHEN op IN ('M','=','X','I','S') THEN len ELSE 0 END) OVER w, 0)::INT AS q,
  coalesce(sum(CASE WHEN op IN ('M','=','X','D','N') THEN len ELSE 0 END) OVER w, 0)::INT AS r
  FROM parsed WINDOW w AS (PARTITION BY read_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("cigar_offsets", f"WITH {_CIG}, {_OPS} SELECT read_id, op, len, q, r FROM offs")
def _(s, d):
    return cigar.explode_offsets(_cigars(s, d)).select("read_id", "op", "len", "q", "r")


@query("cigar_query_index", f"WITH {_CIG}, {_OPS} SELECT c.read_id, min(CASE WHEN op IN ('D','N') THEN q ELSE q + c.at_ - r END)::BIGINT AS qpos FROM cig c LEFT JOIN offs o ON o.read_id = c.read_id AND op IN ('M','=','X','D','N') AND r <= c.at_ AND c.at_ < r + len GROUP BY c.read_id")
def _(s, d):
    x = cigar.with_offsets(_cigars(s, d))
    return x.select("read_id", cigar.query_index(F.col("offs"), F.col("at_")).cast("long").alias("qpos"))


_RATES = "rates AS (SELECT read_id, sum(CASE WHEN op IN ('I','D') THEN len ELSE 0 END)::DOUBLE / sum(len) AS indel_rate, sum(CASE WHEN op = 'X' THEN len ELSE 0 END)::DOUBLE / sum(len) AS mismatch_rate FROM parsed GROUP BY read_id)"


def _rates(s, d) -> DataFrame:
    indel, mismatch = cigar.rates(cigar.parse(F.col("cigar")))
    return _cigars(s, d).select("read_id", indel.alias("indel_rate"), mismatch.alias("mismatch_rate"))


@query("cigar_rates", f"WITH {_CIG}, {_OPS}, {_RATES} SELECT * FROM rates")
def _(s, d):
    return _rates(s, d)


@query("gap_penalties", f"WITH {_CIG}, {_OPS}, {_RATES} SELECT read_id, CASE WHEN indel_rate < 0.005 THEN 7 WHEN indel_rate < 0.02 THEN 5 WHEN indel_rate < 0.05 THEN 4 ELSE 3 END AS gap_open, CASE WHEN indel_rate < 0.005 THEN 2 ELSE 1 END AS gap_extend FROM rates")
def _(s, d):
    opening, extend = cigar.gap_penalties(F.col("indel_rate"))
    return _rates(s, d).select("read_id", opening.alias("gap_open"), extend.alias("gap_extend"))


#: Read sequences: 24 bases repeated from a window of a fixed string.
_SEQ = """seqs AS (SELECT o_orderkey AS read_id, substring('ACGTTGCAAACCCGGGTTTTACGATCGATTTTGACCAGTACGTACCCCAGT', CAST(1 + o_orderkey % 20 AS INT), 24) AS seq,
  CAST(4 + o_custkey % 12 AS INT) AS qpos, CAST(o_custkey % 9 AS INT) AS qual, substring('ACGT', CAST(1 + o_orderkey % 4 AS INT), 1) AS a,
  substring('ACGT', CAST(1 + (o_orderkey + 1 + o_custkey % 3) % 4 AS INT), 1) AS b, CAST(o_custkey % 4 AS INT) AS inserted FROM {orders})"""
_SEQ_SQL = "WITH " + _SEQ.format(orders="orders") + "\n"


def _seqs(s, d) -> DataFrame:
    return s.sql("WITH " + _SEQ + " SELECT * FROM seqs", orders=s.read.parquet(f"{d}/orders.parquet"))


@query("snv_calls", _SEQ_SQL + "SELECT read_id, CASE WHEN qual <= 3 THEN -1 WHEN substring(seq, qpos + 1, 1) = a THEN 0 WHEN substring(seq, qpos + 1, 1) = b THEN 1 END AS state FROM seqs")
def _(s, d):
    return _seqs(s, d).select("read_id", cigar.call_snv(F.col("seq"), F.col("qual"), F.col("qpos"), F.col("a"), F.col("b"), 3).alias("state"))


@query("snv_calls_context", _SEQ_SQL + "SELECT read_id, CASE WHEN least(qual, qual + 1, 5) <= 3 THEN -1 WHEN substring(seq, qpos, 3) = 'A' || a || 'C' THEN 0 WHEN substring(seq, qpos, 3) = 'A' || b || 'C' THEN 1 END AS state FROM seqs")
def _(s, d):
    quals = F.array_repeat(F.lit(99), 30)
    quals = F.transform(quals, lambda q, i: F.when(i == F.col("qpos") - 1, F.col("qual")).when(i == F.col("qpos"), F.col("qual") + 1).when(i == F.col("qpos") + 1, 5).otherwise(q))
    left, right = F.lit("A"), F.lit("C")
    return _seqs(s, d).select("read_id", cigar.call_snv_context(F.col("seq"), quals, F.col("qpos"), left, right, F.col("a"), F.col("b"), 3).alias("state"))


@query("insertion_calls", _SEQ_SQL + "SELECT read_id, CASE WHEN inserted = 0 THEN 0 WHEN substring(seq, qpos + 2, inserted) = repeat(b, inserted) THEN 1 END AS state FROM seqs")
def _(s, d):
    alt = F.concat("a", F.expr("repeat(b, inserted)"))
    return _seqs(s, d).select("read_id", cigar.call_insertion(F.col("seq"), F.col("qpos"), F.col("qpos") + 1 + F.col("inserted"), alt).alias("state"))


@query("deletion_calls", _SEQ_SQL + "SELECT read_id, CASE WHEN greatest(4 - qual, 0) = 0 THEN 0 WHEN greatest(4 - qual, 0) = inserted THEN 1 END AS state FROM seqs")
def _(s, d):
    ref = F.concat("a", F.expr("repeat(b, inserted)"))
    return _seqs(s, d).select("read_id", cigar.call_deletion(F.lit(4), F.col("qual"), ref, F.col("a")).alias("state"))


@query("homopolymer_sites", _SEQ_SQL + "SELECT read_id, list_has_any([contains(substring(seq, 1, qpos), repeat(x, 4)) FOR x IN ['A','C','G','T']], [TRUE]) AS homopolymer FROM seqs")
def _(s, d):
    return _seqs(s, d).select("read_id", vr.is_homopolymer(F.substring("seq", F.lit(1), F.col("qpos"))).alias("homopolymer"))


@query("realigned_states")
def _(s, d):
    pending = _seqs(s, d).select(
        "read_id", F.lit(0).cast("long").alias("idx"), F.substring("seq", 3, 17).alias("read_window"), F.substring("seq", F.lit(1), F.col("qpos")).alias("left_flank"),
        F.col("a").alias("allele_a"), F.col("b").alias("allele_b"), F.expr("substring(seq, qpos + 2, 24)").alias("right_flank"),
        F.lit(5).alias("gap_open"), F.lit(1).alias("gap_extend"), vr.is_homopolymer(F.col("seq")).alias("homopolymer"),
    )
    return realign.realigned_states(pending)


# ------------------------------------------------------------- methylation

_REGIONS = "regions AS (SELECT 'chr1' AS chrom, p_partkey AS region_id, 20000 * p_partkey AS pos_a, 20000 * p_partkey + 6000 AS pos_b FROM part)"
_KEPT = "kept AS (SELECT * FROM meth WHERE coverage >= 10 AND ratio > 20 AND ratio < 80)"
_IN = "hits AS (SELECT r.region_id, m.site_start, m.coverage, m.ratio FROM regions r JOIN kept m ON m.site_start >= r.pos_a - 5001 AND m.site_end <= r.pos_b + 4999)"


def _regions(s, d) -> DataFrame:
    p = s.read.parquet(f"{d}/part.parquet")
    return p.select(F.lit("chr1").alias("chrom"), F.col("p_partkey").alias("region_id"), (F.col("p_partkey") * 20000).alias("pos_a"), (F.col("p_partkey") * 20000 + 6000).alias("pos_b"))


def _hits(s, d) -> DataFrame:
    return methylation.region_sites(_regions(s, d), methylation.site_filter(fx.methylation_sites(s, d)))


@query("site_filter", _with("meth", extra=_KEPT) + "SELECT site_start, coverage, round(ratio, 6) AS ratio FROM kept")
def _(s, d):
    return methylation.site_filter(fx.methylation_sites(s, d)).select("site_start", "coverage", F.round("ratio", 6).alias("ratio"))


@query("region_sites", _with("meth", extra=f"{_KEPT}, {_REGIONS}, {_IN}") + "SELECT region_id, site_start FROM hits")
def _(s, d):
    return _hits(s, d).select("region_id", "site_start")


@query(
    "site_cap",
    _with("meth", extra=f"{_KEPT}, {_REGIONS}, {_IN}, counted AS (SELECT *, count(*) OVER (PARTITION BY region_id) AS n FROM hits), narrowed AS (SELECT * FROM counted WHERE n <= 15 OR (ratio > 45 AND ratio < 55 AND coverage > 15 AND coverage < 45))")
    + "SELECT region_id, site_start FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY (site_start * 7919) % 1000003, site_start) AS r FROM narrowed) x WHERE r <= 15",
)
def _(s, d):
    return methylation.site_cap(_hits(s, d), ["region_id"], 15).select("region_id", "site_start")


#: Read states at the two anchors of a region, and methylation probabilities of reads at sites.
_STATES = "states AS (SELECT o_custkey % 60 AS region_id, o_orderkey AS read_id, CAST((o_orderkey // 3 + o_custkey) % 3 - 1 AS INT) AS s0, CAST((o_orderkey // 7) % 3 - 1 AS INT) AS s1 FROM {orders})"
_PROBS = "probs AS (SELECT user_id % 40 AS region_id, event_id % 16 AS read_id, (event_id // 16) % 12 AS site, CAST((event_id // 16) % 2 AS INT) AS hap, CAST((event_id * 37 + user_id * 11) % 256 AS DOUBLE) / 256 AS p FROM {events})"


def _states(s, d) -> DataFrame:
    return s.sql("WITH " + _STATES.replace(" // ", " div ") + " SELECT * FROM states", orders=s.read.parquet(f"{d}/orders.parquet"))


def _probs(s, d) -> DataFrame:
    return s.sql("WITH " + _PROBS.replace(" // ", " div ") + " SELECT * FROM probs", events=s.read.parquet(f"{d}/events.parquet"))


@query("pattern_counts", "WITH " + _STATES.format(orders="orders") + " SELECT region_id, s0, s1, count(*) AS n FROM states GROUP BY ALL")
def _(s, d):
    return _states(s, d).groupBy("region_id", "s0", "s1").agg(F.count("*").alias("n"))


@query(
    "anchor_patterns",
    "WITH " + _STATES.format(orders="orders") + """, known AS (SELECT region_id, s0, s1, count(*) AS n FROM states WHERE NOT (s0 = -1 AND s1 = -1) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY n DESC, s0, s1) AS r FROM known),
firsts AS (SELECT region_id, s0 AS a0, s1 AS a1 FROM ranked WHERE r = 1),
others AS (SELECT k.*, (s0 = a0 AND s0 >= 0) OR (s1 = a1 AND s1 >= 0) AS clash FROM ranked k JOIN firsts USING (region_id) WHERE r > 1),
seconds AS (SELECT region_id, s0 AS b0, s1 AS b1 FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY clash, CASE WHEN clash THEN -r ELSE r END) AS k FROM others) x WHERE k = 1),
both_ AS (SELECT region_id, a0, a1, coalesce(b0, -1) AS b0, coalesce(b1, -1) AS b1 FROM firsts LEFT JOIN seconds USING (region_id))
SELECT region_id, CASE WHEN a0 >= 0 THEN a0 WHEN b0 >= 0 THEN 1 - b0 ELSE -1 END AS a0, CASE WHEN a1 >= 0 THEN a1 WHEN b1 >= 0 THEN 1 - b1 ELSE -1 END AS a1,
  CASE WHEN b0 >= 0 THEN b0 WHEN a0 >= 0 THEN 1 - a0 ELSE -1 END AS b0, CASE WHEN b1 >= 0 THEN b1 WHEN a1 >= 0 THEN 1 - a1 ELSE -1 END AS b1 FROM both_""",
)
def _(s, d):
    return methylation.anchor_patterns(_states(s, d))


_P = "WITH " + _PROBS.format(events="events")
_SUMS = ", sums AS (SELECT region_id, hap, site, sum(log10(greatest(p, 1e-20))) AS m, sum(log10(greatest(1 - p, 1e-20))) AS u FROM probs WHERE p >= 0 GROUP BY ALL), called AS (SELECT *, CASE WHEN m > log10(0.5) AND m - u > 3 THEN 'M' WHEN u > log10(0.5) AND u - m > 3 THEN 'U' END AS call FROM sums)"


@query("site_hap_sums", _P + _SUMS + " SELECT region_id, hap, site, round(m, 6) AS log_meth, round(u, 6) AS log_unmeth, call FROM called")
def _(s, d):
    x = methylation.site_sums(_probs(s, d), ["region_id", "hap", "site"])
    return x.withColumn("log_meth", F.round("log_meth", 6)).withColumn("log_unmeth", F.round("log_unmeth", 6))


@query("dms_sites", _P + " SELECT region_id, hap, site, count(*) AS coverage, count(*) FILTER (WHERE p > 0.5) AS mod_count, count(*) FILTER (WHERE NOT p > 0.5) AS unmod_count, round(100.0 * count(*) FILTER (WHERE p > 0.5) / count(*), 6) AS ratio FROM probs WHERE p >= 0 GROUP BY ALL")
def _(s, d):
    return methylation.site_table(_probs(s, d), ["region_id", "hap", "site"]).withColumn("ratio", F.round("ratio", 6))


_FRACTIONS = "frac AS (SELECT idx, hap, avg(state) AS fraction, count(*) AS coverage FROM obs WHERE state >= 0 GROUP BY ALL)"


@query("hap_allele_fraction", _with("obs", extra=_FRACTIONS) + "SELECT 'chr1' AS chrom, idx, hap, round(fraction, 9) AS fraction, coverage FROM frac")
def _(s, d):
    return methylation.hap_fractions(fx.observations(s, d), ["chrom", "idx", "hap"]).withColumn("fraction", F.round("fraction", 9))


_FRACTION_STEPS = (
    _FRACTIONS + """, ends AS (SELECT a.idx, a.hap, a.fraction AS fa, a.coverage AS cov_a, b.fraction AS fb, b.coverage AS cov_b, round_even(a.fraction, 0)::INT AS ra, round_even(b.fraction, 0)::INT AS rb
  FROM frac a JOIN frac b ON b.idx = a.idx + 1 AND b.hap = a.hap),
weighed AS (SELECT *, CASE WHEN ra = rb THEN greatest(fa, 1e-20) * greatest(fb, 1e-20) WHEN ra = 0 THEN greatest(1 - fa, 1e-20) * greatest(fb, 1e-20) ELSE greatest(fa, 1e-20) * greatest(1 - fb, 1e-20) END AS q FROM ends),
cells AS (SELECT idx, hap, cov_a, cov_b, CASE WHEN ra = 0 THEN greatest(1 - q, 1e-20) ELSE 1e-20 END AS t00, CASE WHEN ra = 0 THEN q ELSE 1e-20 END AS t01,
  CASE WHEN ra = 0 THEN 1e-20 WHEN rb = 1 THEN greatest(1 - q, 1e-20) ELSE q END AS t10, CASE WHEN ra = 0 THEN 1e-20 WHEN rb = 1 THEN q ELSE greatest(1 - q, 1e-20) END AS t11 FROM weighed),
sided AS (""" + _mirror_sql("cells", "idx, hap, cov_a, cov_b", True) + ")"
)
_MEAN = ", ".join(f"round((x.t{c} * (x.cov_a + x.cov_b) / 2.0::DOUBLE + y.t{c} * (y.cov_a + y.cov_b) / 2.0::DOUBLE) / ((x.cov_a + x.cov_b + y.cov_a + y.cov_b) / 2.0::DOUBLE), 9) AS t{c}" for c in ("00", "01", "10", "11"))


@query("methyl_transition", _with("obs", extra=_FRACTION_STEPS) + f"SELECT 'chr1' AS chrom, x.idx, {_MEAN} FROM sided x JOIN sided y USING (idx) WHERE x.hap = 0 AND y.hap = 1 AND least(x.cov_a, x.cov_b, y.cov_a, y.cov_b) >= 1")
def _(s, d):
    f = methylation.hap_fractions(fx.observations(s, d), ["chrom", "idx", "hap"])
    nxt = f.select("chrom", (F.col("idx") - 1).alias("idx"), "hap", F.col("fraction").alias("f_b"), F.col("coverage").alias("cov_b"))
    x = f.select("chrom", "idx", "hap", F.col("fraction").alias("f_a"), F.col("coverage").alias("cov_a")).join(nxt, ["chrom", "idx", "hap"])
    t = methylation.fraction_transitions(x)
    mean = methylation.weighted_mean(t.where("hap = 0"), t.where("hap = 1"), ["chrom", "idx"], 1)
    return mean.select("chrom", "idx", *[F.round(c, 9).alias(c) for c in transitions.CELLS])


@query("methyl_assign")
def _(s, d):
    start = F.when(F.col("read_id") < 2, F.col("read_id").cast("int")).otherwise(-1)
    return methylation.assign_reads(_probs(s, d).withColumn("hap", start))


# ------------------------------------------------------------- inference


_PAIR_MATRIX = (
    "paired AS (" + _PAIRS_SQL.format(on="y.idx = x.idx + 2") + "), pcells AS (SELECT idx_a AS idx, n00::DOUBLE + 1e-20 AS t00, n01::DOUBLE + 1e-20 AS t01, n10::DOUBLE + 1e-20 AS t10, n11::DOUBLE + 1e-20 AS t11 FROM paired),"
    " psided AS (" + _mirror_sql("pcells", "idx", False) + "), c_ AS (SELECT idx, t00 / (t00 + t01) AS c00, t01 / (t00 + t01) AS c01, t10 / (t10 + t11) AS c10, t11 / (t10 + t11) AS c11 FROM psided),"
    " abc AS (SELECT a.chrom, a.idx, a.t00 AS a00, a.t01 AS a01, a.t10 AS a10, a.t11 AS a11, b.t00 AS b00, b.t01 AS b01, b.t10 AS b10, b.t11 AS b11, c00, c01, c10, c11"
    " FROM normal a JOIN normal b ON b.idx = a.idx + 1 JOIN c_ c ON c.idx = a.idx)"
)
_FIRST = lambda i, j: f"(a{i}{j} * (b{j}0 * c{i}0 + b{j}1 * c{i}1))"
_SECOND = lambda j, k: f"(b{j}{k} * (a0{j} * c0{k} + a1{j} * c1{k}))"
_TRIPLE = ", ".join(
    f"round(CASE WHEN {f(i, '0')} + {f(i, '1')} > 0 THEN {f(i, j)} / ({f(i, '0')} + {f(i, '1')}) ELSE 0.5 END, 9) AS {n}{i}{j}"
    for n, f in (("ab", _FIRST), ("bc", _SECOND)) for i in "01" for j in "01"
)


@query("triple_reestimate", _with("normal", extra=_PAIR_MATRIX) + f"SELECT chrom, idx, {_TRIPLE} FROM abc")
def _(s, d):
    n = cut(transitions.normalize(transitions.mirror(_matrix(s, d))), "transitions")
    cells = lambda k: [F.col(f"t{c}").alias(f"{k}{c}") for c in ("00", "01", "10", "11")]
    a = n.select("chrom", "idx", *cells("a"))
    b = n.select("chrom", (F.col("idx") - 1).alias("idx"), *cells("b"))
    pairs = fx.variants(s, d).select("chrom", F.col("idx").alias("idx_a"), (F.col("idx") + 2).alias("idx_b"))
    c = transitions.normalize(transitions.mirror(transitions.to_matrix(transitions.pairwise_counts(fx.observations(s, d), pairs))))
    c = c.select("chrom", F.col("idx_a").alias("idx"), *cells("c"))
    new = transitions.reestimated_triples(a.join(b, ["chrom", "idx"]).join(c, ["chrom", "idx"]))
    return new.select("chrom", "idx", *[F.round(x, 9).alias(x) for x in new.columns if x not in ("chrom", "idx")])


@query("lbp_transitions")
def _(s, d):
    from phaseframe.plans.pipeline import rephased

    mean = _mean_coverage(s, d).first()[0] or 0.0
    return rephased(cut(_phaseable(s, d).select("chrom", "idx", "pos", "vtype"), "phaseable"), cut(fx.observations(s, d), "observations"), 2, mean)


@query("connected_blocks")
def _(s, d):
    from phaseframe.plans.pipeline import connected, phaseable_matrix

    p = cut(_phaseable(s, d).select("chrom", "idx", "pos", "vtype"), "phaseable")
    obs = cut(fx.observations(s, d), "observations")
    return connected(p, phaseable_matrix(p, obs), obs)


@query("full_pipeline")
def _(s, d):
    from phaseframe.config import PhasingConfig
    from phaseframe.plans.pipeline import phase

    return phase(fx.variants(s, d), fx.observations(s, d), PhasingConfig.for_technology("ont", min_allele_count=2))


# ------------------------------------------------------------- intervals

_BLK = "blk AS (SELECT 'chr1' AS chrom, o_orderkey AS block, 15000 * o_orderkey AS block_start, 15000 * o_orderkey + 3000 + 5000 * (o_custkey % 5) AS block_end FROM {orders})"


def _blk(s, d) -> DataFrame:
    return s.sql("WITH " + _BLK + " SELECT * FROM blk", orders=s.read.parquet(f"{d}/orders.parquet"))


_G = _with("genes", extra=_BLK.format(orders="orders"))
_OVER = "b.block_start < g.gene_end AND g.gene_start < b.block_end"


@query("interval_count", _G + f"SELECT g.suppkey, (SELECT count(*) FROM blk b WHERE {_OVER}) AS n FROM genes g")
def _(s, d):
    return evaluate.overlap_counts(fx.genes(s, d), _blk(s, d), "chrom", "gene_start", "gene_end", "block_start", "block_end", ["suppkey"]).select("suppkey", "n")


@query("interval_semi", _G + f"SELECT g.suppkey FROM genes g WHERE EXISTS (SELECT 1 FROM blk b WHERE {_OVER})")
def _(s, d):
    return intervals.overlaps(fx.genes(s, d), _blk(s, d), "chrom", "gene_start", "gene_end", "block_start", "block_end").select("suppkey").distinct()


@query("interval_contained", _G + "SELECT g.suppkey, (SELECT count(*) FROM blk b WHERE b.block_start <= g.gene_start AND b.block_end >= g.gene_end) AS n_within FROM genes g")
def _(s, d):
    return evaluate.coverage_shares(fx.genes(s, d), _blk(s, d), ["suppkey"]).select("suppkey", "n_within")


@query("interval_overlap_bp", _G + f"SELECT g.gene, sum(least(g.gene_end, b.block_end) - greatest(g.gene_start, b.block_start))::BIGINT AS bp FROM genes g JOIN blk b ON {_OVER} GROUP BY g.gene")
def _(s, d):
    return evaluate.overlap_bp(fx.genes(s, d), _blk(s, d), "chrom", "gene_start", "gene_end", "block_start", "block_end", ["gene"])


@query("gene_extent", _with("genes") + "SELECT gene, min(gene_start) AS start, max(gene_end) AS \"end\" FROM genes GROUP BY gene")
def _(s, d):
    return evaluate.extents(fx.genes(s, d), ["gene"], "gene_start", "gene_end")


@query("locus_reads", _with("reads") + "SELECT read_id, hap FROM reads WHERE read_end > 500000 AND read_start < 900000")
def _(s, d):
    return fx.reads(s, d).where("read_end > 500000 AND read_start < 900000").select("read_id", "hap")


@query("locus_depth", _with("reads") + "SELECT w.win, count(*) AS n FROM (SELECT unnest(range(read_start // 10000, (read_end - 1) // 10000 + 1)) AS win FROM reads) w GROUP BY w.win")
def _(s, d):
    r = fx.reads(s, d)
    return r.select(F.explode(F.expr("sequence(read_start div 10000, (read_end - 1) div 10000)")).alias("win")).groupBy("win").agg(F.count("*").alias("n"))


# ------------------------------------------------------------- tools and sets

#: Sites that tools phased, by nation parity; error and phased counts by customer.
_TOOLS = "tools AS (SELECT p_partkey AS pos, concat('tool', CAST(t AS {s})) AS tool FROM {{part}} CROSS JOIN (SELECT 0 AS t UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k WHERE p_partkey % (t + 7) <> 0 AND (p_partkey * (t + 3)) % 11 <> 0)"


def _tools(s, d) -> DataFrame:
    return s.sql("WITH " + _TOOLS.format(s="STRING") + " SELECT 'chr1' AS chrom, * FROM tools", part=s.read.parquet(f"{d}/part.parquet"))


_T = "WITH " + _TOOLS.format(s="VARCHAR").format(part="part") + "\n"


@query("shared_sites", _T + "SELECT 'chr1' AS chrom, pos FROM tools GROUP BY pos HAVING count(DISTINCT tool) = 4")
def _(s, d):
    return evaluate.sites_in_all(_tools(s, d), ["chrom", "pos"], "tool", 4)


@query("target_semi", _T + "SELECT DISTINCT pos FROM tools a WHERE tool = 'tool0' AND EXISTS (SELECT 1 FROM tools b WHERE b.tool = 'tool3' AND b.pos = a.pos)")
def _(s, d):
    t = _tools(s, d)
    return t.where("tool = 'tool0'").join(t.where("tool = 'tool3'"), ["chrom", "pos"], "left_semi").select("pos").distinct()


@query("site_difference", _T + "SELECT pos FROM tools WHERE tool = 'tool1' EXCEPT SELECT pos FROM tools WHERE tool = 'tool2'")
def _(s, d):
    t = _tools(s, d)
    return t.where("tool = 'tool1'").select("pos").subtract(t.where("tool = 'tool2'").select("pos"))


@query("site_union", _T + "SELECT pos FROM tools WHERE tool = 'tool1' UNION SELECT pos FROM tools WHERE tool = 'tool2'")
def _(s, d):
    t = _tools(s, d)
    return t.where("tool = 'tool1'").select("pos").union(t.where("tool = 'tool2'").select("pos")).distinct()


@query("tool_join", _T + "SELECT a.pos, b.pos IS NOT NULL AS in1, c.pos IS NOT NULL AS in2 FROM (SELECT pos FROM tools WHERE tool = 'tool0') a LEFT JOIN (SELECT pos FROM tools WHERE tool = 'tool1') b USING (pos) LEFT JOIN (SELECT pos FROM tools WHERE tool = 'tool2') c USING (pos)")
def _(s, d):
    t = _tools(s, d)
    one = lambda k: t.where(f"tool = 'tool{k}'").select("pos", F.lit(True).alias(f"in{k}"))
    x = t.where("tool = 'tool0'").select("pos").join(one(1), "pos", "left").join(one(2), "pos", "left")
    return x.select("pos", F.coalesce("in1", F.lit(False)).alias("in1"), F.coalesce("in2", F.lit(False)).alias("in2"))


_STATS = "stats AS (SELECT c_nationkey AS tool, c_custkey AS sample, 1000 + c_custkey % 977 AS het, 700 + c_custkey % 613 AS phased, c_custkey % 29 AS switches, CAST(c_custkey % 509 AS DOUBLE) / 7 AS seconds FROM {customer})"


def _stats(s, d) -> DataFrame:
    return s.sql("WITH " + _STATS + " SELECT * FROM stats", customer=s.read.parquet(f"{d}/customer.parquet"))


_S = "WITH " + _STATS.format(customer="customer") + "\n"


@query("frac_phased_interval", _S + "SELECT tool, round(quantile_cont(f, 0.025), 9) AS low, round(quantile_cont(f, 0.5), 9) AS mid, round(quantile_cont(f, 0.975), 9) AS high FROM (SELECT tool, phased::DOUBLE / het AS f FROM stats) x GROUP BY tool")
def _(s, d):
    x = evaluate.interval_quantiles(_stats(s, d).withColumn("f", F.col("phased") / F.col("het")), ["tool"], "f")
    return x.select("tool", *[F.round(c, 9).alias(c) for c in ("low", "mid", "high")])


@query("switch_rate_by_tool", _S + "SELECT tool, round(sum(switches)::DOUBLE / sum(phased), 9) AS per_phased FROM stats GROUP BY tool")
def _(s, d):
    return _stats(s, d).groupBy("tool").agg(F.round(F.sum("switches") / F.sum("phased"), 9).alias("per_phased"))


@query("runtime_summary", _S + "SELECT tool, round(sum(seconds), 6) AS total, round(min(seconds), 6) AS low, round(max(seconds), 6) AS high, round(avg(seconds), 6) AS mean, round(quantile_cont(seconds, 0.5), 6) AS median, round(stddev_samp(seconds), 6) AS std FROM stats GROUP BY tool")
def _(s, d):
    x = evaluate.summary(_stats(s, d), ["tool"], "seconds")
    return x.select("tool", *[F.round(c, 6).alias(c) for c in ("total", "low", "high", "mean", "median", "std")])


@query("fold_vs_baseline", _S + "SELECT s.tool, round(avg(s.phased::DOUBLE / b.m), 9) AS fold FROM stats s CROSS JOIN (SELECT avg(phased) AS m FROM stats WHERE tool = 0) b GROUP BY s.tool")
def _(s, d):
    x = _stats(s, d)
    base = x.where("tool = 0").agg(F.avg("phased").alias("m"))
    return x.join(F.broadcast(base)).groupBy("tool").agg(F.round(F.avg(F.col("phased") / F.col("m")), 9).alias("fold"))  # base is one row


@query("sex_mode", "SELECT concat('chr', CAST(c_nationkey AS VARCHAR)) AS chrom, round(avg(c_custkey % 40), 6) AS depth, CASE WHEN avg(c_custkey % 40) >= 19.2 THEN 'present' ELSE 'absent' END AS mode FROM customer GROUP BY c_nationkey")
def _(s, d):
    x = s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("chr"), F.col("c_nationkey").cast("string")).alias("chrom"), (F.col("c_custkey") % 40).alias("depth"))
    return evaluate.sex_mode(x, 76.8).withColumn("depth", F.round("depth", 6))


@query("coverage_histogram", _with("meth") + "SELECT CAST(least(greatest(floor((coverage - 0) / 2.5) + 1, 1), 20) AS INT) AS bin, count(*) AS n FROM meth GROUP BY 1")
def _(s, d):
    return evaluate.histogram(fx.methylation_sites(s, d), "coverage", 0.0, 50.0, 20)


@query("clipped_coverage", _with("meth") + "SELECT site_start, least(coverage, 30) AS coverage FROM meth")
def _(s, d):
    return fx.methylation_sites(s, d).select("site_start", F.least("coverage", F.lit(30)).alias("coverage"))


_HR = "ratios AS (SELECT event_id % 700 AS site, CAST(user_id % 2 AS INT) AS hap, avg(value) AS ratio FROM {events} GROUP BY event_id % 700, user_id % 2)"


@query("hap_ratio_join", "WITH " + _HR.format(events="events") + " SELECT a.site, round(a.ratio, 6) AS ratio_1, round(coalesce(b.ratio, 0), 6) AS ratio_2 FROM ratios a LEFT JOIN ratios b ON b.site = a.site AND b.hap = 1 WHERE a.hap = 0")
def _(s, d):
    x = s.sql("WITH " + _HR + " SELECT * FROM ratios", events=s.read.parquet(f"{d}/events.parquet"))
    b = x.where("hap = 1").select("site", F.col("ratio").alias("ratio_2"))
    out = x.where("hap = 0").select("site", F.col("ratio").alias("ratio_1")).join(b, "site", "left").fillna(0.0, ["ratio_2"])
    return out.select("site", F.round("ratio_1", 6).alias("ratio_1"), F.round("ratio_2", 6).alias("ratio_2"))


@query("dms_dedup_mean", _with("meth") + "SELECT site_start // 5000 AS region, round(avg(ratio), 6) AS ratio, count(*) AS n FROM meth GROUP BY site_start // 5000")
def _(s, d):
    return fx.methylation_sites(s, d).groupBy(F.expr("site_start div 5000").alias("region")).agg(F.round(F.avg("ratio"), 6).alias("ratio"), F.count("*").alias("n"))


@query("phase_join_by_methylation", _with("phase", extra=_BLK.format(orders="orders")) + "SELECT m.block, count(p.ps) AS joined FROM blk m LEFT JOIN blocks p ON p.block_start >= m.block_start AND p.block_end <= m.block_end GROUP BY m.block")
def _(s, d):
    seq = decode.block_table(phased(s, d)).select("chrom", F.col("block_start").alias("s"), F.col("block_end").alias("e"), "block_id")
    big = _blk(s, d)
    inside = intervals.overlaps(seq, big, "chrom", "s", "e", "block_start", "block_end", how="within").groupBy("block").agg(F.count("*").alias("joined"))
    return big.select("block").join(inside, "block", "left").select("block", F.coalesce("joined", F.lit(0)).alias("joined"))
