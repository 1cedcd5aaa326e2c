"""The phasing plan: matrix, difficult runs, block joining, gaps filled by methylation, decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.config import PhasingConfig
from phaseframe.operators import decode, inference, ordered, transitions
from phaseframe.operators.variants import alignment_filter
from phaseframe.plans import methylation
from phaseframe.sources.checkpoints import cut


def phaseable_matrix(phaseable: DataFrame, obs: DataFrame) -> DataFrame:
    """Raw transitions between neighbouring phaseable variants: adjacent counts, or final states across a gap."""
    p = ordered.dense_index(phaseable.select("chrom", "idx"), "chrom", "idx", [], "p_idx", 100_000)
    nxt = p.select("chrom", (F.col("p_idx") - 1).alias("p_idx"), F.col("idx").alias("idx_b"))
    steps = p.join(nxt, ["chrom", "p_idx"])
    near = steps.where("idx_b = idx + 1").select("chrom", "idx").join(transitions.adjacent_counts(obs), ["chrom", "idx"], "left")
    gaps = steps.where("idx_b > idx + 1").select("chrom", F.col("idx").alias("idx_a"), "idx_b")
    far = gaps.join(transitions.pairwise_counts(obs, gaps), ["chrom", "idx_a", "idx_b"], "left").withColumnRenamed("idx_a", "idx").drop("idx_b")
    return transitions.to_matrix(near.unionByName(far))


def _indexed(phaseable: DataFrame) -> DataFrame:
    return ordered.dense_index(phaseable.select("chrom", "idx", "pos", "vtype"), "chrom", "idx", [], "p_idx", 100_000)


def _pair_counts(pairs: DataFrame, p: DataFrame, obs: DataFrame) -> DataFrame:
    """Counts of final states for pairs (i, j) of p_idx."""
    at = lambda n, k: p.select("chrom", F.col("p_idx").alias(n), F.col("idx").alias(k))
    x = pairs.join(at("i", "idx_a"), ["chrom", "i"]).join(at("j", "idx_b"), ["chrom", "j"])
    found = transitions.pairwise_counts(obs, x.select("chrom", "idx_a", "idx_b").distinct())
    return x.join(found, ["chrom", "idx_a", "idx_b"], "left").fillna(0, ["n00", "n01", "n10", "n11"])


def rephased(phaseable: DataFrame, obs: DataFrame, min_allele_count: int, mean_coverage: float, damping: float = 0.0, matrix: DataFrame | None = None) -> DataFrame:
    """New transitions of runs of difficult variants by belief propagation: chrom, idx and cells. ``matrix``: that of
    ``phaseable_matrix``, if it is there already."""
    p = cut(_indexed(phaseable), "indexed")
    hard = transitions.difficult(p, transitions.allele_coverage(obs), min_allele_count)
    runs = cut(ordered.islands(p.join(hard, ["chrom", "idx"], "left_semi"), "chrom", "p_idx"), "runs")
    n = p.groupBy("chrom").agg(F.count("*").alias("n_phaseable"))
    pairs = inference.window_pairs(inference.run_windows(runs, n))
    counted = _pair_counts(pairs, p, obs)
    # neighbours use the adjacent counts of the matrix
    m = (phaseable_matrix(phaseable, obs) if matrix is None else matrix).select("chrom", F.col("idx").alias("idx_a"), *[F.col(f"t{c}").alias(f"m{c}") for c in ("00", "01", "10", "11")])
    counted = counted.join(m, ["chrom", "idx_a"], "left")
    cells = [F.when(F.col("j") == F.col("i") + 1, F.col(f"m{c}") - transitions.EPSILON).otherwise(F.col(f"n{c}").cast("double")).alias(f"n{c}") for c in ("00", "01", "10", "11")]
    new = inference.rephase(counted.select("chrom", "cluster", "part", "first", "last", "i", "j", *cells), mean_coverage, damping=damping)
    return new.join(p.select("chrom", "p_idx", "idx"), ["chrom", "p_idx"]).drop("p_idx")


def connected(phaseable: DataFrame, matrix: DataFrame, obs: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """Changes that join phase blocks: chrom, idx, drop and new cells. ``matrix`` is mirrored and normalised, or raw.
    ``variants`` are all of them, phaseable or not (the phaseable ones, if not given)."""
    p = cut(_indexed(phaseable), "indexed")
    steps = cut(transitions.normalize(transitions.mirror(matrix)).join(p.select("chrom", "idx", "p_idx"), ["chrom", "idx"]), "steps")
    total = p.groupBy("chrom").agg(F.count("*").cast("int").alias("total"))
    total = total.join((phaseable if variants is None else variants).groupBy("chrom").agg((F.max("idx") + 1).cast("int").alias("variants")), "chrom")
    unsure = steps.where(transitions.uncertain()).join(total, "chrom").where(F.col("idx") < F.col("variants") - 2)
    runs = ordered.islands(unsure, "chrom", "p_idx").select("chrom", "first", "last")
    from pyspark.sql import Window

    w = Window.partitionBy("chrom").orderBy("first")
    opens = F.coalesce(F.col("first") - F.lag("last").over(w) > 4, F.lit(True)).cast("int")
    runs = runs.withColumn("o", opens).withColumn("cluster", F.sum("o").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("o")
    runs = cut(inference.numbered_parts(runs), "runs")
    near = runs.select("chrom", "cluster", "part", F.explode(F.sequence(F.greatest(F.col("first") - 1, F.lit(0)), F.col("last") + 3)).alias("i")).distinct()
    cells = [f"t{c}" for c in ("00", "01", "10", "11")]
    own = near.join(steps.withColumnRenamed("p_idx", "i"), ["chrom", "i"]).select("chrom", "cluster", "part", F.lit("step").alias("kind"), "i", (F.col("i") + 1).alias("j"), *cells)
    a, last = F.col("first"), F.col("last")
    across = F.array(
        F.struct(a.alias("i"), (last + 1).alias("j")), F.struct((a - 1).alias("i"), (a + 1).alias("j")), F.struct(a.alias("i"), (a + 2).alias("j"))
    )
    pairs = runs.select("chrom", "cluster", "part", F.explode(across).alias("x")).select("chrom", "cluster", "part", "x.i", "x.j").distinct()
    pairs = _pair_counts(pairs, p, obs).select(
        "chrom", "cluster", "part", F.lit("pair").alias("kind"), "i", "j", *[F.col(f"n{c[1:]}").cast("double").alias(c) for c in cells]
    )
    none = F.lit(None).cast("double")
    spans = runs.select("chrom", "cluster", "part", F.lit("run").alias("kind"), F.col("first").alias("i"), F.col("last").alias("j"), *[none.alias(c) for c in cells])
    numbers = near.join(p.select("chrom", F.col("p_idx").alias("i"), "idx"), ["chrom", "i"]).select("chrom", "cluster", "part", F.lit("at").alias("kind"), "i", F.col("idx").alias("j"), *[none.alias(c) for c in cells])
    windows = own.unionByName(pairs).unionByName(spans).unionByName(numbers).join(total, "chrom")
    return inference.connect(windows).join(p.select("chrom", "p_idx", "idx"), ["chrom", "p_idx"]).drop("p_idx")


def _replaced(matrix: DataFrame, new: DataFrame) -> DataFrame:
    cells = ["t00", "t01", "t10", "t11"]
    n = new.select("chrom", "idx", *[F.col(c).alias(f"n{c}") for c in cells])
    return matrix.join(n, ["chrom", "idx"], "left").select("chrom", "idx", *[F.coalesce(f"n{c}", c).alias(c) for c in cells])


def sequence_stage(variants: DataFrame, obs: DataFrame, config: PhasingConfig) -> tuple[DataFrame, DataFrame]:
    """Phaseable variants and the row-normalised transitions between them, from what reads carry alone."""
    obs = cut(obs, "observations")
    phaseable = variants.select("chrom", "idx", "pos", "vtype")
    if config.ont:
        phaseable = phaseable.join(transitions.single_strand_variants(obs), ["chrom", "idx"], "left_anti")
    seen = transitions.allele_coverage(obs).agg(F.sum(F.col("c0") + F.col("c1")).alias("c")).first()["c"] or 0
    mean = seen / max(1, 2 * variants.count())
    phaseable = cut(phaseable, "phaseable")
    raw = cut(phaseable_matrix(phaseable, obs), "raw")
    raw = cut(_replaced(raw, rephased(phaseable, obs, config.min_allele_count, mean, config.damping, raw)), "matrix")
    changes = cut(connected(phaseable, raw, obs, variants), "changes")
    left = cut(phaseable.join(changes.where("drop").select("chrom", "idx"), ["chrom", "idx"], "left_anti"), "left")
    # a variant before a dropped one steps over the gap with its new transition
    return left, cut(_replaced(transitions.normalize(transitions.mirror(raw)), changes.where("NOT drop")), "joined")


def decode_stage(phaseable: DataFrame, matrix: DataFrame) -> DataFrame:
    return decode.decoded(cut(decode.blocks(phaseable, matrix), "blocks")).select("chrom", "idx", "pos", "block_id", "h0", "h1")


def phase(variants: DataFrame, obs: DataFrame, config: PhasingConfig) -> DataFrame:
    """Haplotypes of all phaseable variants: chrom, idx, pos, block_id, h0, h1."""
    return decode_stage(*sequence_stage(variants, obs, config))


def phase_with_methylation(
    variants: DataFrame, obs: DataFrame, alignments: DataFrame, sites: DataFrame, config: PhasingConfig
) -> dict[str, DataFrame]:
    """``haplotypes`` over gaps that methylation fills, read ``assignments``, ``differing_sites``, the number of ``filled`` transitions per
    chromosome, ``phaseable`` variants and their ``transitions`` before methylation and ``filled_transitions`` after it.

    Alignments need ``calls``, see ``sources.text.modification_calls``.
    """
    obs = cut(obs, "observations")
    left, matrix = sequence_stage(variants, obs, config)
    reads = alignment_filter(alignments, config.min_mapq)
    results = cut(methylation.methylation_results(left, matrix, obs, reads, sites, config, variants), "methylation")
    new = cut(transitions.normalize(_replaced(matrix, methylation.steps(results))), "filled")
    return {
        "haplotypes": decode_stage(left, new),
        "phaseable": left,
        "transitions": matrix,
        "filled_transitions": new,
        "assignments": methylation.assignments(results),
        "differing_sites": methylation.differing_sites(results),
        "filled": methylation.filled(methylation.uncertain_steps(left, matrix, variants), methylation.uncertain_steps(left, new, variants)),
    }
