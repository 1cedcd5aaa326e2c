"""Allele coverage and 2x2 transition counts between variants, and the mirror rule.

A transition row has the counts of reads that carry allele r at a variant and
allele c at the next one, in four scalar columns t00 t01 t10 t11, each raised by
``EPSILON`` so that unseen cells stay positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-20
CELLS = ("t00", "t01", "t10", "t11")


def allele_coverage(obs: DataFrame) -> DataFrame:
    """Reads per variant and allele: c0, c1."""
    return obs.groupBy("chrom", "idx").agg(
        F.count_if(F.col("state") == 0).alias("c0"), F.count_if(F.col("state") == 1).alias("c1")
    )


def strand_table(obs: DataFrame) -> DataFrame:
    return obs.where("state >= 0").groupBy("chrom", "idx", "state", "strand").agg(F.count("*").alias("n"))


def single_strand_variants(obs: DataFrame) -> DataFrame:
    """Variants of which a seen allele comes from one strand only: artefacts of nanopore reads."""
    return (
        obs.where("state >= 0")
        .groupBy("chrom", "idx", "state")
        .agg(F.min("strand").alias("lo"), F.max("strand").alias("hi"))
        .where("lo = hi")
        .select("chrom", "idx")
        .distinct()
    )


def _cells(a: str, b: str) -> list[Column]:
    return [
        F.count_if((F.col(a) == int(r)) & (F.col(b) == int(c))).alias(f"n{r}{c}") for r in "01" for c in "01"
    ]


def adjacent_counts(obs: DataFrame) -> DataFrame:
    """Counts between neighbours idx, idx + 1 of the same read.

    A pair counts if both states are known and the later one was realigned, or
    neither was. The case realigned-then-direct never counts: when the direct
    call is made its predecessor is still open, and the realignment pass only
    looks back from the realigned variant.
    """
    w = Window.partitionBy("chrom", "read_id").orderBy("idx")
    x = (
        obs.select("chrom", "read_id", "idx", "state", "direct")
        .withColumn("next_idx", F.lead("idx").over(w))
        .withColumn("next_state", F.lead("state").over(w))
        .withColumn("next_direct", F.lead("direct").over(w))
        .where("next_idx = idx + 1 AND state >= 0 AND next_state >= 0 AND (direct OR NOT next_direct)")
    )
    return x.groupBy("chrom", "idx").agg(*_cells("state", "next_state"))


def pairwise_counts(obs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts for arbitrary pairs (chrom, idx_a, idx_b) by final states."""
    o = obs.where("state >= 0").select("chrom", "read_id", "idx", "state")
    a = pairs.join(o.withColumnRenamed("idx", "idx_a").withColumnRenamed("state", "sa"), ["chrom", "idx_a"])
    b = o.withColumnRenamed("idx", "idx_b").withColumnRenamed("state", "sb")
    return a.join(b, ["chrom", "idx_b", "read_id"]).groupBy("chrom", "idx_a", "idx_b").agg(*_cells("sa", "sb"))


def to_matrix(counts: DataFrame) -> DataFrame:
    cells = [(F.coalesce(F.col(f"n{c[1:]}"), F.lit(0)).cast("double") + F.lit(EPSILON)).alias(c) for c in CELLS]
    return counts.select(*[c for c in counts.columns if not c.startswith("n0") and not c.startswith("n1")], *cells)


def transition_matrix(variants: DataFrame, obs: DataFrame) -> DataFrame:
    """Row per variant but the last of its chromosome, uncovered ones at EPSILON."""
    last = variants.groupBy("chrom").agg(F.max("idx").alias("__last"))
    base = variants.join(last, "chrom").where(F.col("idx") < F.col("__last")).select("chrom", "idx")
    return to_matrix(base.join(adjacent_counts(obs), ["chrom", "idx"], "left"))


def mirror(matrix: DataFrame, normalized: bool = False) -> DataFrame:
    """The mirror rule on the cells t00 t01 t10 t11.

    Rows of a matrix should oppose each other. The row that tells the alleles
    apart more clearly is reversed into the other, where both rows point to
    different columns; where they agree on a column the row with the larger gap
    wins. What tells nothing is erased. Log ratios are compared as ratios.
    """
    t = {c: F.col(c) for c in CELLS}
    gap = lambda a, b: F.greatest(a, b) / F.least(a, b)
    l0, l1 = gap(t["t00"], t["t01"]), gap(t["t10"], t["t11"])
    m0, m1 = F.greatest(t["t00"], t["t01"]), F.greatest(t["t10"], t["t11"])
    distinct = (t["t00"] >= t["t01"]) != (t["t10"] >= t["t11"])
    norm, erased = F.lit(normalized), F.lit(0.5 if normalized else EPSILON)
    d0, d1 = F.abs(t["t00"] - t["t01"]), F.abs(t["t10"] - t["t11"])
    rule = (
        F.when((l0 < l1) & ((m1 > 1) | (m0 <= 1) | norm) & distinct, 1)
        .when((l0 > l1) & ((m0 > 1) | (m1 <= 1) | norm) & distinct, 0)
        .when((l0 < l1) & (m1 == 1) & (m0 > 1) & ~norm, 0)
        .when((l0 > l1) & (m0 == 1) & (m1 > 1) & ~norm, 1)
        .when((t["t00"] == t["t10"]) & (t["t01"] == t["t11"]), 3)
        .when(~distinct & (d0 > d1), 0)
        .when(~distinct & (d0 < d1), 1)
        .when(~distinct & (l0 > l1), 0)
        .when(~distinct & (l0 < l1), 1)
        .when(~distinct, 3)
        .otherwise(2)
    )  # 0: the first row wins, 1: the second, 2: unchanged, 3: erased
    # a column of its own: inlined into the cells the rule would multiply the plan
    ruled, r = matrix.withColumn("__rule", rule), F.col("__rule")
    pick = lambda own, win0, win1: F.when(r == 0, win0).when(r == 1, win1).when(r == 3, erased).otherwise(own)
    return ruled.select(
        *[c for c in matrix.columns if c not in CELLS],
        pick(t["t00"], t["t00"], t["t11"]).alias("t00"),
        pick(t["t01"], t["t01"], t["t10"]).alias("t01"),
        pick(t["t10"], t["t01"], t["t10"]).alias("t10"),
        pick(t["t11"], t["t00"], t["t11"]).alias("t11"),
    )


def normalize(matrix: DataFrame) -> DataFrame:
    c = F.col
    r0, r1 = c("t00") + c("t01"), c("t10") + c("t11")
    cells = [(c("t00") / r0).alias("t00"), (c("t01") / r0).alias("t01"), (c("t10") / r1).alias("t10"), (c("t11") / r1).alias("t11")]
    return matrix.select(*[x for x in matrix.columns if x not in CELLS], *cells)


def uncertain() -> Column:
    """All four cells are one half."""
    return (F.col("t00") == 0.5) & (F.col("t01") == 0.5) & (F.col("t10") == 0.5) & (F.col("t11") == 0.5)


def difficult(variants: DataFrame, coverage: DataFrame, min_allele_count: int) -> DataFrame:
    """Variants that aren't SNPs or of which an allele has fewer reads than asked for."""
    x = variants.join(coverage, ["chrom", "idx"], "left")
    low = F.least(F.coalesce("c0", F.lit(0)), F.coalesce("c1", F.lit(0)))
    return x.where((F.col("vtype") != "SNP") | (low < min_allele_count)).select("chrom", "idx")


def reestimated_triples(triples: DataFrame) -> DataFrame:
    """Transitions A to B and B to C given A to C.

    Columns a.., b.., c.. (00 01 10 11): row-normalised matrices A-B, B-C, A-C.
    Each path through B is weighted by how well A-C supports where it ends.
    """
    a, b, c = ({k: F.col(f"{n}{k}") for k in ("00", "01", "10", "11")} for n in "abc")

    def first(i: str, j: str) -> Column:
        return a[i + j] * (b[j + "0"] * c[i + "0"] + b[j + "1"] * c[i + "1"])

    def second(j: str, k: str) -> Column:
        return b[j + k] * (a["0" + j] * c["0" + k] + a["1" + j] * c["1" + k])

    out = []
    for name, f in (("ab", first), ("bc", second)):
        for i in "01":
            total = f(i, "0") + f(i, "1")
            out += [F.when(total > 0, f(i, j) / total).otherwise(0.5).alias(f"{name}{i}{j}") for j in "01"]
    keep = [x for x in triples.columns if not (len(x) == 3 and x[0] in "abc" and x[1:].isdigit())]
    return triples.select(*keep, *out)
