"""The registered phasing queries and, for each that SQL can express, its SQL.

Inputs are the derived tables of ``phaseframe.fixtures``; the SQL derives the
same rows in common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseframe import fixtures as fx
from phaseframe.config import PhasingConfig
from phaseframe.operators import decode, evaluate, haplotag, intervals, ordered, transitions
from phaseframe.operators import variants as vr
from phaseframe.sources.checkpoints import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# ------------------------------------------------------------- shared SQL

_RAW = "raw AS (" + fx.RAW_VARIANTS.format(part="part").replace("STRING", "VARCHAR") + ")"
_VARIANTS = "sites AS (" + fx.SITES.format(part="part") + "), variants AS (SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY pos, partkey) - 1 AS idx, pos, vtype, truth, partkey FROM sites)"
_READS = "reads AS (" + fx.READS.replace("{max_pos}", "(SELECT max(pos) FROM sites)").format(orders="orders") + ")"
_OBS = """joined AS (
  SELECT r.read_id, v.idx, v.pos, v.vtype, v.truth, r.hap, r.strand FROM variants v JOIN reads r
  ON r.mapq >= 20 AND r.read_start <= v.pos - 1 AND v.pos - 1 < r.read_end
), obs AS (
  SELECT 'chr1' AS chrom, read_id, idx, pos, vtype, truth, hap, strand,
    CASE WHEN (read_id * 7 + idx * 11) % 29 = 0 THEN -1
         WHEN (read_id * 5 + idx * 3) % 37 = 0 THEN 1 - (truth + hap) % 2
         ELSE (truth + hap) % 2 END AS state,
    (read_id + idx) % 13 <> 0 AS direct
  FROM joined
)"""
_ADJ = """stepped AS (
  SELECT read_id, idx, state, lead(idx) OVER w AS nidx, lead(state) OVER w AS nstate, direct, lead(direct) OVER w AS ndirect
  FROM obs WINDOW w AS (PARTITION BY read_id ORDER BY idx)
), adjacent AS (
  SELECT idx, count(*) FILTER (WHERE state = 0 AND nstate = 0) AS n00, count(*) FILTER (WHERE state = 0 AND nstate = 1) AS n01,
    count(*) FILTER (WHERE state = 1 AND nstate = 0) AS n10, count(*) FILTER (WHERE state = 1 AND nstate = 1) AS n11
  FROM stepped WHERE nidx = idx + 1 AND state >= 0 AND nstate >= 0 AND (direct OR NOT ndirect) GROUP BY idx
)"""
_MATRIX = """matrix AS (
  SELECT 'chr1' AS chrom, v.idx, coalesce(n00, 0)::DOUBLE + 1e-20 AS t00, coalesce(n01, 0)::DOUBLE + 1e-20 AS t01,
    coalesce(n10, 0)::DOUBLE + 1e-20 AS t10, coalesce(n11, 0)::DOUBLE + 1e-20 AS t11
  FROM variants v LEFT JOIN adjacent a USING (idx) WHERE v.idx < (SELECT max(idx) FROM variants)
)"""


def _mirror_sql(source: str, keep: str, normalized: bool) -> str:
    erased, norm = ("0.5", "TRUE") if normalized else ("1e-20", "FALSE")
    return f"""SELECT {keep},
  CASE rule WHEN 0 THEN t00 WHEN 1 THEN t11 WHEN 3 THEN {erased} ELSE t00 END AS t00,
  CASE rule WHEN 0 THEN t01 WHEN 1 THEN t10 WHEN 3 THEN {erased} ELSE t01 END AS t01,
  CASE rule WHEN 0 THEN t01 WHEN 1 THEN t10 WHEN 3 THEN {erased} ELSE t10 END AS t10,
  CASE rule WHEN 0 THEN t00 WHEN 1 THEN t11 WHEN 3 THEN {erased} ELSE t11 END AS t11
FROM (SELECT *, CASE
    WHEN g0 < g1 AND (m1 > 1 OR m0 <= 1 OR {norm}) AND dis THEN 1
    WHEN g0 > g1 AND (m0 > 1 OR m1 <= 1 OR {norm}) AND dis THEN 0
    WHEN g0 < g1 AND m1 = 1 AND m0 > 1 AND NOT {norm} THEN 0
    WHEN g0 > g1 AND m0 = 1 AND m1 > 1 AND NOT {norm} THEN 1
    WHEN t00 = t10 AND t01 = t11 THEN 3
    WHEN NOT dis AND abs(t00 - t01) > abs(t10 - t11) THEN 0
    WHEN NOT dis AND abs(t00 - t01) < abs(t10 - t11) THEN 1
    WHEN NOT dis AND g0 > g1 THEN 0 WHEN NOT dis AND g0 < g1 THEN 1
    WHEN NOT dis THEN 3 ELSE 2 END AS rule
  FROM (SELECT *, greatest(t00, t01) / least(t00, t01) AS g0, greatest(t10, t11) / least(t10, t11) AS g1,
          greatest(t00, t01) AS m0, greatest(t10, t11) AS m1, (t00 >= t01) <> (t10 >= t11) AS dis FROM {source}) a) b"""


_NORMAL = (
    "mirrored AS (" + _mirror_sql("matrix", "chrom, idx", False) + "), normal AS (SELECT chrom, idx, t00 / (t00 + t01) AS t00, t01 / (t00 + t01) AS t01,"
    " t10 / (t10 + t11) AS t10, t11 / (t10 + t11) AS t11 FROM mirrored)"
)
_STRAND = """single AS (
  SELECT DISTINCT idx FROM (SELECT idx, state FROM obs WHERE state >= 0 GROUP BY idx, state HAVING min(strand) = max(strand)) s
), phaseable AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS p_idx FROM variants WHERE idx NOT IN (SELECT idx FROM single))"""
_BLOCKS = """bridge AS (
  SELECT p_idx, idx, lead(idx) OVER (ORDER BY p_idx) AS nidx FROM phaseable
), far AS (
  SELECT b.idx, count(*) FILTER (WHERE x.state = 0 AND y.state = 0) AS n00, count(*) FILTER (WHERE x.state = 0 AND y.state = 1) AS n01,
    count(*) FILTER (WHERE x.state = 1 AND y.state = 0) AS n10, count(*) FILTER (WHERE x.state = 1 AND y.state = 1) AS n11
  FROM bridge b JOIN obs x ON x.idx = b.idx AND x.state >= 0 JOIN obs y ON y.idx = b.nidx AND y.read_id = x.read_id AND y.state >= 0
  WHERE b.nidx > b.idx + 1 GROUP BY b.idx
), pmatrix AS (
  SELECT 'chr1' AS chrom, b.idx,
    CASE WHEN b.nidx = b.idx + 1 THEN m.t00 ELSE coalesce(f.n00, 0)::DOUBLE + 1e-20 END AS t00,
    CASE WHEN b.nidx = b.idx + 1 THEN m.t01 ELSE coalesce(f.n01, 0)::DOUBLE + 1e-20 END AS t01,
    CASE WHEN b.nidx = b.idx + 1 THEN m.t10 ELSE coalesce(f.n10, 0)::DOUBLE + 1e-20 END AS t10,
    CASE WHEN b.nidx = b.idx + 1 THEN m.t11 ELSE coalesce(f.n11, 0)::DOUBLE + 1e-20 END AS t11
  FROM bridge b LEFT JOIN matrix m ON m.idx = b.idx LEFT JOIN far f ON f.idx = b.idx WHERE b.nidx IS NOT NULL
), pmirror AS (""" + _mirror_sql("pmatrix", "chrom, idx", False) + """), pnormal AS (
  SELECT idx, t00 / (t00 + t01) AS t00, t01 / (t00 + t01) AS t01, t10 / (t10 + t11) AS t10, t11 / (t10 + t11) AS t11 FROM pmirror
), into_ AS (
  SELECT p.idx, p.pos, p.p_idx, n.t00, n.t01,
    CASE WHEN n.idx IS NULL OR (n.t00 = 0.5 AND n.t01 = 0.5 AND n.t10 = 0.5 AND n.t11 = 0.5) THEN 1 ELSE 0 END AS breaks
  FROM phaseable p LEFT JOIN phaseable q ON q.p_idx = p.p_idx - 1 LEFT JOIN pnormal n ON n.idx = q.idx
), blocked AS (
  SELECT *, sum(breaks) OVER (ORDER BY p_idx) - 1 AS block_id FROM into_
), walked AS (
  SELECT *, CASE WHEN breaks = 0 AND t01 > t00 THEN 1 ELSE 0 END AS sw, count(*) OVER (PARTITION BY block_id) AS size,
    max(block_id) OVER () AS final FROM blocked
), haps AS (
  SELECT *, CASE WHEN size > 1 OR block_id = final THEN
      (coalesce(sum(sw) OVER (PARTITION BY block_id ORDER BY p_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) % 2)::INT ELSE -1 END AS h0
  FROM walked
), emitted AS (SELECT *, dense_rank() OVER (ORDER BY block_id) - 1 AS ps FROM haps WHERE h0 >= 0),
blocks AS (SELECT ps, min(pos) AS block_start, max(pos) AS block_end, max(idx) AS last_idx, count(*) AS n FROM emitted GROUP BY ps)"""
_BASE = {
    "raw": [_RAW], "variants": [_VARIANTS], "reads": [_VARIANTS, _READS], "obs": [_VARIANTS, _READS, _OBS],
    "adjacent": [_VARIANTS, _READS, _OBS, _ADJ], "matrix": [_VARIANTS, _READS, _OBS, _ADJ, _MATRIX],
    "normal": [_VARIANTS, _READS, _OBS, _ADJ, _MATRIX, _NORMAL],
    "phase": [_VARIANTS, _READS, _OBS, _ADJ, _MATRIX, _STRAND, _BLOCKS],
    "strand": [_VARIANTS, _READS, _OBS, _STRAND],
    "meth": ["meth AS (" + fx.METH_SITES.format(events="events") + ")"],
    "genes": ["genes AS (" + fx.GENES.format(supplier="supplier").replace("STRING", "VARCHAR") + ")"],
}


def _with(*bases: str, extra: str = "") -> str:
    parts = list(dict.fromkeys(p for b in bases for p in _BASE[b])) + ([extra] if extra else [])
    return "WITH " + ",\n".join(parts) + "\n"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


# ------------------------------------------------------------- variants

_PICK = "SELECT id, pos, ref, alt1, alt2, gt_a, gt_b FROM raw"
_HET = "gt_a <> gt_b AND gt_a >= 0 AND gt_b >= 0"


def _pick(df: DataFrame) -> DataFrame:
    return df.select("id", "pos", "ref", "alt1", "alt2", "gt_a", "gt_b")


@query("het_variant_filter", _with("raw") + f"{_PICK} WHERE {_HET} AND alt2 IS NULL AND greatest(length(ref), length(alt1)) <= 50000 AND id NOT LIKE '%\\_%' ESCAPE '\\'")
def _(s, d):
    return _pick(vr.het_filter(fx.raw_variants(s, d), PhasingConfig(), split_complex=True))


@query("het_snv_filter", _with("raw") + f"{_PICK} WHERE {_HET} AND greatest(length(ref), length(alt1), coalesce(length(alt2), 0)) = 1")
def _(s, d):
    return _pick(vr.het_filter(fx.raw_variants(s, d), PhasingConfig(snvs_only=True, multiallelics=True)))


@query(
    "variant_classify",
    _with("raw") + """SELECT id, upper(ref) AS ref, upper(alt1) AS alt, least(gt_a, gt_b) AS g0, greatest(gt_a, gt_b) AS g1,
  CASE WHEN alt2 IS NOT NULL THEN 'MULTI' WHEN length(ref) = 1 AND length(alt1) = 1 THEN 'SNP' WHEN length(ref) > 1 AND length(alt1) = 1 THEN 'DEL'
       WHEN length(ref) = 1 AND length(alt1) > 1 THEN 'INS' ELSE 'Other' END AS vtype FROM raw""",
)
def _(s, d):
    x = vr.prepared(fx.raw_variants(s, d))
    return x.select("id", "ref", F.col("alts")[0].alias("alt"), F.col("gt")[0].alias("g0"), F.col("gt")[1].alias("g1"), "vtype")


@query("variant_index", _with("variants") + "SELECT chrom, idx, pos, vtype FROM variants")
def _(s, d):
    return fx.variants(s, d).select("chrom", "idx", "pos", "vtype")


@query("variant_quality", _with("raw") + "SELECT id, 'small' AS kind FROM raw WHERE filter = 'PASS' AND gq > 20 UNION ALL SELECT id, 'structural' FROM raw WHERE svtype <> 'BND' AND gq >= 20")
def _(s, d):
    v = fx.raw_variants(s, d)
    small = vr.quality_pass(v).select("id", F.lit("small").alias("kind"))
    return small.unionByName(vr.quality_pass(v, structural=True).select("id", F.lit("structural").alias("kind")))


@query("alignment_filter", _with("reads") + "SELECT read_id, flag, mapq FROM reads WHERE flag & 1796 = 0 AND mapq >= 20")
def _(s, d):
    return vr.alignment_filter(fx.reads(s, d), 20).select("read_id", "flag", "mapq")


@query("methylated_read_filter", _with("reads") + "SELECT read_id, flag FROM reads WHERE flag & 1796 = 0 AND mapq >= 20 AND has_mods")
def _(s, d):
    return vr.alignment_filter(fx.reads(s, d), 20, methylated=True).select("read_id", "flag")


@query("alignment_count", _with("reads") + "SELECT chrom, count(*) AS n FROM reads GROUP BY chrom")
def _(s, d):
    return fx.reads(s, d).groupBy("chrom").agg(F.count("*").alias("n"))


@query("multiallelic_split", _with("raw") + "SELECT id, 1 AS alt_no, alt1 AS alt FROM raw UNION ALL SELECT id, 2, alt2 FROM raw WHERE alt2 IS NOT NULL")
def _(s, d):
    return vr.split_multiallelic(fx.raw_variants(s, d)).select("id", "alt_no", "alt")


@query("multiallelic_merge", _with("raw") + "SELECT chrom, pos, ref, concat_ws(',', alt1, alt2) AS alts FROM raw")
def _(s, d):
    merged = vr.merge_multiallelic(vr.split_multiallelic(fx.raw_variants(s, d)))
    return merged.select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"))


_AF = "af AS (SELECT chrom, pos, ref, alt1 AS alt, (partkey % 1000) / 20000.0 AS af FROM raw WHERE partkey % 4 <> 0)"


def _annotated(s, d):
    raw = fx.raw_variants(s, d)
    v = vr.split_multiallelic(raw).select("chrom", "pos", "id", "ref", "alt")
    af = raw.where("partkey % 4 <> 0").select("chrom", "pos", "ref", F.col("alt1").alias("alt"), ((F.col("partkey") % 1000) / 20000.0).alias("af"))
    return vr.annotate_frequency(v, af)


_ANNOTATED = "split AS (SELECT chrom, pos, id, ref, alt1 AS alt FROM raw UNION ALL SELECT chrom, pos, id, ref, alt2 FROM raw WHERE alt2 IS NOT NULL)"


@query("af_annotate", _with("raw", extra=f"{_AF}, {_ANNOTATED}") + "SELECT s.id, s.alt, af.af::DOUBLE AS af FROM split s LEFT JOIN af USING (chrom, pos, ref, alt)")
def _(s, d):
    return _annotated(s, d).select("id", "alt", F.col("af").cast("double").alias("af"))


@query("rare_variants", _with("raw", extra=f"{_AF}, {_ANNOTATED}") + "SELECT s.id, s.alt FROM split s JOIN af USING (chrom, pos, ref, alt) WHERE af < 0.01")
def _(s, d):
    return vr.rare(_annotated(s, d)).select("id", "alt")


@query("phased_het_sites", _with("raw") + f"SELECT chrom, pos FROM raw WHERE {_HET} AND phased")
def _(s, d):
    return vr.het_filter(fx.raw_variants(s, d), PhasingConfig(multiallelics=True)).where("phased").select("chrom", "pos")


@query("concat_calls", _with("raw") + "SELECT chrom, pos, id FROM (SELECT chrom, pos, id FROM raw WHERE svtype IS NULL UNION ALL SELECT chrom, pos, id FROM raw WHERE svtype IS NOT NULL AND gq >= 20) u ORDER BY chrom, pos")
def _(s, d):
    v = fx.raw_variants(s, d)
    return v.where("svtype IS NULL").select("chrom", "pos", "id").unionByName(v.where("svtype IS NOT NULL AND gq >= 20").select("chrom", "pos", "id")).orderBy("chrom", "pos")


# ------------------------------------------------------------- reads and transitions


@query("read_variant_overlap", _with("reads") + "SELECT r.read_id, v.idx FROM variants v JOIN reads r ON r.read_start <= v.pos - 1 AND v.pos - 1 < r.read_end WHERE r.mapq >= 20")
def _(s, d):
    return fx.observations(s, d).select("read_id", "idx")


@query("allele_coverage", _with("obs") + "SELECT chrom, idx, count(*) FILTER (WHERE state = 0) AS c0, count(*) FILTER (WHERE state = 1) AS c1 FROM obs GROUP BY chrom, idx")
def _(s, d):
    return transitions.allele_coverage(fx.observations(s, d))


@query("mean_allele_coverage", _with("obs") + "SELECT sum(CASE WHEN state >= 0 THEN 1 ELSE 0 END) / (2.0 * (SELECT count(*) FROM variants)) AS mean_coverage FROM obs")
def _(s, d):
    return _mean_coverage(s, d)


def _mean_coverage(s, d) -> DataFrame:
    per = transitions.allele_coverage(fx.observations(s, d)).agg(F.sum(F.col("c0") + F.col("c1")).alias("c"))
    n = fx.variants(s, d).agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(n)).select((F.col("c") / (2.0 * F.col("n"))).alias("mean_coverage"))  # one row each


@query("strand_table", _with("obs") + "SELECT chrom, idx, state, strand, count(*) AS n FROM obs WHERE state >= 0 GROUP BY ALL")
def _(s, d):
    return transitions.strand_table(fx.observations(s, d))


@query("single_strand_variants", _with("strand") + "SELECT 'chr1' AS chrom, idx FROM single")
def _(s, d):
    return transitions.single_strand_variants(fx.observations(s, d))


@query("anti_unphaseable", _with("strand") + "SELECT chrom, idx, pos, p_idx FROM phaseable")
def _(s, d):
    return ordered.dense_index(_phaseable(s, d), "chrom", "idx", [], "p_idx", 100_000).select("chrom", "idx", "pos", "p_idx")


@query("adjacent_transitions", _with("adjacent") + "SELECT 'chr1' AS chrom, * FROM adjacent")
def _(s, d):
    return transitions.adjacent_counts(fx.observations(s, d))


_PAIRS_SQL = """SELECT 'chr1' AS chrom, x.idx AS idx_a, y.idx AS idx_b, count(*) FILTER (WHERE x.state = 0 AND y.state = 0) AS n00,
  count(*) FILTER (WHERE x.state = 0 AND y.state = 1) AS n01, count(*) FILTER (WHERE x.state = 1 AND y.state = 0) AS n10,
  count(*) FILTER (WHERE x.state = 1 AND y.state = 1) AS n11
FROM obs x JOIN obs y ON y.read_id = x.read_id AND {on} WHERE x.state >= 0 AND y.state >= 0 GROUP BY ALL"""


@query("pairwise_transitions", _with("obs") + _PAIRS_SQL.format(on="y.idx = x.idx + 2"))
def _(s, d):
    pairs = fx.variants(s, d).select("chrom", F.col("idx").alias("idx_a"), (F.col("idx") + 2).alias("idx_b"))
    return transitions.pairwise_counts(fx.observations(s, d), pairs)


def _bridges(s, d) -> DataFrame:
    """Neighbouring phaseable variants that aren't neighbours."""
    p = ordered.dense_index(_phaseable(s, d), "chrom", "idx", [], "p_idx", 100_000)
    nxt = p.select("chrom", (F.col("p_idx") - 1).alias("p_idx"), F.col("idx").alias("idx_b"))
    return p.join(nxt, ["chrom", "p_idx"]).where("idx_b > idx + 1").select("chrom", F.col("idx").alias("idx_a"), "idx_b")


@query("bridging_transitions", _with("strand", extra="bridge AS (SELECT idx, lead(idx) OVER (ORDER BY p_idx) AS nidx FROM phaseable)") + _PAIRS_SQL.format(on="TRUE JOIN bridge b ON b.idx = x.idx AND b.nidx = y.idx AND b.nidx > b.idx + 1"))
def _(s, d):
    return transitions.pairwise_counts(fx.observations(s, d), _bridges(s, d))


@query("mirrored_transitions", _with("normal") + "SELECT * FROM mirrored")
def _(s, d):
    return transitions.mirror(_matrix(s, d))


@query("normalized_transitions", _with("normal") + "SELECT * FROM normal")
def _(s, d):
    return transitions.normalize(transitions.mirror(_matrix(s, d)))


def _matrix(s, d) -> DataFrame:
    return transitions.transition_matrix(fx.variants(s, d), fx.observations(s, d))


def _phaseable(s, d) -> DataFrame:
    return fx.variants(s, d).join(transitions.single_strand_variants(fx.observations(s, d)), ["chrom", "idx"], "left_anti")


_HALF = "t00 = 0.5 AND t01 = 0.5 AND t10 = 0.5 AND t11 = 0.5"
_ISLANDS = "SELECT 'chr1' AS chrom, min({i}) AS first, max({i}) AS last, count(*) AS n FROM (SELECT {i}, {i} - row_number() OVER (ORDER BY {i}) AS g FROM {t}) x GROUP BY g"


@query("uncertain_islands", _with("normal", extra=f"unsure AS (SELECT idx FROM normal WHERE {_HALF})") + _ISLANDS.format(i="idx", t="unsure"))
def _(s, d):
    n = cut(transitions.normalize(transitions.mirror(_matrix(s, d))), "transitions")
    return ordered.islands(n.where(transitions.uncertain()), "chrom", "idx")


@query(
    "difficult_islands",
    _with("obs", extra="hard AS (SELECT v.idx FROM variants v LEFT JOIN (SELECT idx, count(*) FILTER (WHERE state = 0) AS c0, count(*) FILTER (WHERE state = 1) AS c1 FROM obs GROUP BY idx) c USING (idx) WHERE vtype <> 'SNP' OR least(coalesce(c0, 0), coalesce(c1, 0)) < 2)")
    + _ISLANDS.format(i="idx", t="hard"),
)
def _(s, d):
    obs = fx.observations(s, d)
    return ordered.islands(transitions.difficult(fx.variants(s, d), transitions.allele_coverage(obs), 2), "chrom", "idx")


# ------------------------------------------------------------- phasing


def phased(s, d) -> DataFrame:
    """Haplotypes of the derived variants by the sequence-only plan."""
    from phaseframe.plans.pipeline import phaseable_matrix

    obs = cut(fx.observations(s, d), "observations")
    p = fx.variants(s, d).join(transitions.single_strand_variants(obs), ["chrom", "idx"], "left_anti")
    p = cut(p.select("chrom", "idx", "pos"), "phaseable")
    m = cut(transitions.normalize(transitions.mirror(phaseable_matrix(p, obs))), "transitions")
    return cut(decode.haplotypes(decode.blocks(p, m)), "haplotypes")


@query("phase_states", _with("phase") + "SELECT 'chr1' AS chrom, idx, pos, block_id::BIGINT AS block_id, h0, CASE WHEN h0 < 0 THEN -1 ELSE 1 - h0 END AS h1 FROM haps")
def _(s, d):
    return phased(s, d).select("chrom", "idx", "pos", "block_id", "h0", "h1")


@query("phase_sets", _with("phase") + "SELECT 'chr1' AS chrom, idx, pos, ps, h0 FROM emitted")
def _(s, d):
    return decode.phase_sets(phased(s, d)).select("chrom", "idx", "pos", "ps", "h0")


@query("phase_blocks", _with("phase") + "SELECT 'chr1' AS chrom, block_start, block_end, n FROM blocks")
def _(s, d):
    return decode.block_table(phased(s, d)).select("chrom", "block_start", "block_end", "n")


@query("block_n50", _with("phase", extra="lens AS (SELECT block_end - block_start AS len FROM blocks)") + "SELECT 'chr1' AS chrom, max(len) AS n50 FROM (SELECT len, sum(len) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS r, sum(len) OVER () AS t FROM lens) x WHERE 2 * r >= t AND len IS NOT NULL")
def _(s, d):
    return evaluate.block_n50(decode.block_table(phased(s, d)), ["chrom"], F.col("block_end") - F.col("block_start"))


@query("phase_stats", _with("phase") + "SELECT 'chr1' AS chrom, (SELECT count(*) FROM variants) AS heterozygous_variants, count(*) AS phased, count(*)::DOUBLE / (SELECT count(*) FROM variants) AS phased_fraction, count(DISTINCT ps) AS n_blocks FROM emitted")
def _(s, d):
    h = phased(s, d).where("h0 >= 0").groupBy("chrom").agg(F.count("*").alias("phased"), F.count_distinct("block_id").alias("n_blocks"))
    v = fx.variants(s, d).groupBy("chrom").agg(F.count("*").alias("heterozygous_variants"))
    return v.join(h, "chrom").withColumn("phased_fraction", F.col("phased") / F.col("heterozygous_variants"))


_POINTS = """pts AS (SELECT ps, pos, o, lag(o) OVER (PARTITION BY ps ORDER BY pos) AS prev FROM (SELECT e.ps, e.pos, (e.h0 + v.truth) % 2 AS o FROM emitted e JOIN variants v USING (idx) {where}) x),
points AS (SELECT *, (o <> prev)::INT AS switch FROM pts WHERE prev IS NOT NULL)"""


def _points(s, d, only: str | None = None) -> DataFrame:
    v = fx.variants(s, d)
    truth = v.where(only) if only else v
    return evaluate.switch_points(
        decode.phase_sets(phased(s, d)).withColumnRenamed("ps", "block"), truth.select("chrom", "pos", F.col("truth").alias("truth_h0")), ["chrom"]
    )


_SWITCH = "SELECT 'chr1' AS chrom, sum(switch)::BIGINT AS all_switches, count(*) AS all_assessed_pairs, sum(switch)::DOUBLE / count(*) AS all_switch_rate FROM points"


@query("switch_errors", _with("phase", extra=_POINTS.format(where="")) + _SWITCH)
def _(s, d):
    return evaluate.switch_errors(_points(s, d), ["chrom"])


@query("switch_errors_complex", _with("phase", extra=_POINTS.format(where="WHERE v.vtype <> 'SNP'")) + _SWITCH)
def _(s, d):
    return evaluate.switch_errors(_points(s, d, "vtype <> 'SNP'"), ["chrom"])


@query("errors_per_window", _with("phase", extra=_POINTS.format(where="")) + "SELECT 'chr1' AS chrom, pos // 10000 AS \"window\", sum(switch)::BIGINT AS switches, count(*) AS pairs FROM points GROUP BY pos // 10000")
def _(s, d):
    return evaluate.errors_per_window(_points(s, d), ["chrom"])


@query("errors_per_gene", _with("phase", "genes", extra=_POINTS.format(where="")) + "SELECT g.gene, sum(switch)::BIGINT AS switches, count(*) AS pairs FROM points p JOIN genes g ON g.gene_start <= p.pos AND p.pos < g.gene_end GROUP BY g.gene")
def _(s, d):
    hit = intervals.points_in_intervals(_points(s, d), fx.genes(s, d), "chrom", "pos", "gene_start", "gene_end")
    return hit.groupBy("gene").agg(F.sum("switch").alias("switches"), F.count("*").alias("pairs"))


_BED = "bed AS (SELECT ps, block_end, coalesce(lag(last_idx) OVER (ORDER BY ps) + 1, (SELECT min(idx) FROM phaseable)) AS first_idx FROM blocks)"


@query("block_bed", _with("phase", extra=_BED) + "SELECT 'chr1' AS chrom, v.pos AS bed_start, b.block_end AS bed_end FROM bed b JOIN variants v ON v.idx = b.first_idx")
def _(s, d):
    from phaseframe.sources import sinks

    return sinks.block_bed(phased(s, d), fx.variants(s, d)).select("chrom", "bed_start", "bed_end")


@query("block_gaps", _with("phase") + "SELECT 'chr1' AS chrom, block_start, block_start - lag(block_end) OVER (ORDER BY block_start) AS gap FROM blocks")
def _(s, d):
    return evaluate.block_gaps(decode.block_table(phased(s, d))).select("chrom", "block_start", "gap")


_LLR = """llr AS (SELECT read_id, count(*) AS n, count(*) FILTER (WHERE o.state = e.h0) AS match0, count(*) FILTER (WHERE o.state <> e.h0) AS match1, max(o.idx) AS last_idx
  FROM obs o JOIN emitted e ON e.idx = o.idx WHERE o.state >= 0 GROUP BY read_id HAVING count(*) > 1),
tagged AS (SELECT *, (match0 - match1) * ln(0.999 / 0.001) AS llr FROM llr)"""


@query("read_llr", _with("phase", extra=_LLR) + "SELECT 'chr1' AS chrom, read_id, n, match0, match1, last_idx, round(llr, 6) AS llr FROM tagged")
def _(s, d):
    x = haplotag.read_llr(fx.observations(s, d), phased(s, d))
    return x.withColumn("llr", F.round("llr", 6))


_HP = "CASE WHEN llr >= 4 THEN 1 WHEN llr <= -4 THEN 2 END"


@query(
    "haplotag",
    _with("phase", extra=_LLR) + f"""SELECT 'chr1' AS chrom, read_id, {_HP} AS hp,
  coalesce((SELECT min(ps) FROM blocks b WHERE b.last_idx >= t.last_idx), (SELECT max(ps) + 1 FROM blocks)) AS block FROM tagged t""",
)
def _(s, d):
    h = phased(s, d)
    tagged = haplotag.tags(haplotag.read_llr(fx.observations(s, d), h))
    return haplotag.assign_blocks(tagged, h).select("chrom", "read_id", "hp", "block")


@query("hap_counts", _with("phase", extra=_LLR) + f"SELECT {_HP} AS hp, count(*) AS n FROM tagged GROUP BY 1")
def _(s, d):
    return haplotag.tags(haplotag.read_llr(fx.observations(s, d), phased(s, d))).groupBy("hp").agg(F.count("*").alias("n"))


@query("block_asof", _with("variants") + "SELECT v.idx, (SELECT min(w.pos) FROM variants w WHERE w.idx % 40 = 39 AND w.pos >= v.pos) AS block_end FROM variants v")
def _(s, d):
    v = fx.variants(s, d)
    ends = v.where("idx % 40 = 39").select("chrom", F.col("pos").alias("block_end"))
    return intervals.first_at_or_after(v.select("chrom", "idx", "pos"), ends, "chrom", "pos", "block_end", width=16_384).select("idx", "block_end")
