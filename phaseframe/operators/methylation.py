"""Methylation operators: site filters, anchors, read assignment, transitions from methylation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaseframe.operators.intervals import overlaps
from phaseframe.operators.transitions import CELLS, mirror

LOG_HALF = float(np.log10(0.5))


def site_filter(sites: DataFrame) -> DataFrame:
    """Covered ten times or more and clearly between unmethylated and methylated."""
    return sites.where((F.col("coverage") >= 10) & (F.col("ratio") > 20) & (F.col("ratio") < 80))


def site_cap(sites: DataFrame, keys: list[str], most: int = 25_000) -> DataFrame:
    """Regions with more than ``most`` sites keep the intermediate, normally covered ones; if those are still
    too many, the first by a hash of the position. The cap is part of the method."""
    w = Window.partitionBy(*keys)
    x = sites.withColumn("__n", F.count("*").over(w))
    x = x.where((F.col("__n") <= most) | ((F.col("ratio") > 45) & (F.col("ratio") < 55) & (F.col("coverage") > 15) & (F.col("coverage") < 45)))
    order = (F.col("site_start") * 7919) % 1_000_003
    x = x.withColumn("__r", F.row_number().over(w.orderBy(order, "site_start")))
    return x.where(F.col("__r") <= most).drop("__n", "__r")


def region_sites(regions: DataFrame, sites: DataFrame, margin: int = 5_000) -> DataFrame:
    """Sites in [first position - margin - 1, second position + margin - 1]; regions: chrom, region_id, pos_a, pos_b."""
    r = regions.withColumn("__from", F.col("pos_a") - margin - 1).withColumn("__to", F.col("pos_b") + margin)
    found = overlaps(sites, r, "chrom", "site_start", "site_end", "__from", "__to")
    return found.where("site_start >= __from AND site_end <= __to - 1").drop("__from", "__to")


def anchor_patterns(states: DataFrame) -> DataFrame:
    """The two anchor haplotypes per region from (s0, s1) patterns at its first two variants.

    First the commonest pattern with a known state; then the commonest that
    shares no known allele with it, or if every one conflicts the rarest.
    Unknown states are filled by the complement of the other. Ties: smaller
    s0, then s1.
    """
    known = states.where("NOT (s0 = -1 AND s1 = -1)").groupBy("region_id", "s0", "s1").agg(F.count("*").alias("n"))
    w = Window.partitionBy("region_id").orderBy(F.desc("n"), "s0", "s1")
    ranked = known.withColumn("r", F.row_number().over(w))
    top = ranked.where("r = 1").select("region_id", F.col("s0").alias("a0"), F.col("s1").alias("a1"))
    rest = ranked.where("r > 1").join(top, "region_id")
    clash = ((F.col("s0") == F.col("a0")) & (F.col("s0") >= 0)) | ((F.col("s1") == F.col("a1")) & (F.col("s1") >= 0))
    second = rest.groupBy("region_id").agg(
        F.coalesce(F.min_by(F.when(~clash, F.struct("s0", "s1")), F.when(~clash, F.col("r"))), F.max_by(F.struct("s0", "s1"), "r")).alias("b")
    )
    fill = lambda x, other: F.when((F.col(x) >= 0), F.col(x)).when(F.col(other) >= 0, 1 - F.col(other)).otherwise(-1)
    out = top.join(second, "region_id", "left").select("region_id", "a0", "a1", F.coalesce("b.s0", F.lit(-1)).alias("b0"), F.coalesce("b.s1", F.lit(-1)).alias("b1"))
    return out.select("region_id", *[fill(x, y).cast("int").alias(x) for x, y in (("a0", "b0"), ("a1", "b1"), ("b0", "a0"), ("b1", "a1"))])


def site_sums(meth: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of log10 p and log10 (1 - p) over the reads of a haplotype, and the call at each site.

    meth: keys.., site, p. 'methylated' needs a sum over log10(1/2) and a ratio over 3.
    """
    x = meth.where("p >= 0").groupBy(*keys).agg(
        F.sum(F.log10(F.greatest("p", F.lit(1e-20)))).alias("log_meth"),
        F.sum(F.log10(F.greatest(1 - F.col("p"), F.lit(1e-20)))).alias("log_unmeth"),
    )
    m, u = F.col("log_meth"), F.col("log_unmeth")
    call = lambda a, b: (a > LOG_HALF) & (a - b > 3)
    return x.withColumn("call", F.when(call(m, u), "M").when(call(u, m), "U"))


def site_table(meth: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage, modified and unmodified counts, percentage; p over one half is modified."""
    x = meth.where("p >= 0").groupBy(*keys).agg(F.count("*").alias("coverage"), F.count_if(F.col("p") > 0.5).alias("mod_count"))
    return x.withColumn("unmod_count", F.col("coverage") - F.col("mod_count")).withColumn("ratio", 100 * F.col("mod_count") / F.col("coverage"))


def sites_once(order: list[str], *tables: DataFrame) -> DataFrame:
    """The rows of all tables, each once, in order: of several haplotypes, rounds or regions. Tables have the same columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.dropDuplicates().orderBy(*order)


def hap_fractions(states: DataFrame, keys: list[str]) -> DataFrame:
    """Mean state and coverage per key over known states."""
    return states.where("state >= 0").groupBy(*keys).agg(F.avg("state").alias("fraction"), F.count("*").alias("coverage"))


def assign_reads_in_region(p: np.ndarray, hap: np.ndarray, max_rounds: int = 100, log: list | None = None) -> np.ndarray:
    """Haplotype (0, 1 or -1) of the reads of a region.

    p: reads x sites, probability of methylation, NaN where unknown; hap: reads
    assigned from the start, -1 those to be assigned, -2 those left out. Each round sums log10
    probabilities per haplotype and site, calls a site methylated or not, takes the sites where
    the haplotypes differ and assigns a read to the likelier haplotype over them; it ends when
    nothing changes. ``log`` gets the differing sites and the assignment of each round.
    """
    read, site = np.nonzero(~np.isnan(p))
    return assign_pairs_in_region(read, site, p[read, site], p.shape[1], hap, max_rounds, log)


def assign_pairs_in_region(read: np.ndarray, site: np.ndarray, p: np.ndarray, sites: int, hap: np.ndarray, max_rounds: int = 100, log: list | None = None) -> np.ndarray:
    """``assign_reads_in_region`` from the known probabilities alone, pairs of a read and one of the ``sites`` in order of reads:
    reads are short beside their region, so a round takes as long as there are pairs and not reads times sites."""
    hap = hap.copy()
    lp, lq = np.log10(p + 1e-20), np.log10(1 - p + 1e-20)
    for _ in range(max_rounds):
        free = hap == -1
        if not free.any():
            break
        owner = hap[read]
        sums = [tuple(np.bincount(site[on], x[on], sites) for x in (lp, lq)) for on in (owner == 0, owner == 1)]
        meth = [(m > LOG_HALF) & (m - u > 3) for m, u in sums]
        differ = meth[0] != meth[1]
        if log is not None:
            log.append((np.flatnonzero(differ), hap.copy()))
        at = np.flatnonzero((owner == -1) & differ[site])
        score = []
        for h in (0, 1):
            m, u = (x[site[at]] for x in sums[h])
            score.append(np.bincount(read[at], np.where(meth[h][site[at]], lp[at] + m, lq[at] + u), len(hap)))
        new = np.where((score[0] > score[1]) & (score[0] > LOG_HALF), 0, np.where((score[1] > score[0]) & (score[1] > LOG_HALF), 1, -1))[free]
        if (new == -1).all():
            break
        hap[free] = new
    return hap


def assign_reads(meth: DataFrame) -> DataFrame:
    """meth: region_id, read_id, site, p, hap (0, 1 or -1 at the start). A region is one matrix, bounded by the site cap and the coverage."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="read_id", columns="site", values="p", aggfunc="first", dropna=False).sort_index()
        start = pdf.groupby("read_id")["hap"].first().reindex(wide.index).to_numpy()
        p = np.where(wide.to_numpy(float) < 0, np.nan, wide.to_numpy(float))
        return pd.DataFrame({"region_id": pdf["region_id"].iloc[0], "read_id": wide.index, "hap": assign_reads_in_region(p, start).astype(np.int32)})

    return meth.groupBy("region_id").applyInPandas(run, "region_id long, read_id long, hap int")


def fraction_transitions(fractions: DataFrame) -> DataFrame:
    """Transition of one haplotype from the allele fractions f_a, f_b at its ends.

    The states are the rounded fractions (halves to even). With q the
    probability of the rounded pair, the row of the first state gets q in the
    column of the second and 1 - q in the other; two reference alleles give q
    from the fractions as they are. The other row follows by the mirror rule.
    """
    tiny = F.lit(1e-20)
    a, b = F.bround("f_a").cast("int"), F.bround("f_b").cast("int")
    fa, fb = F.greatest("f_a", tiny), F.greatest("f_b", tiny)
    na, nb = F.greatest(1 - F.col("f_a"), tiny), F.greatest(1 - F.col("f_b"), tiny)
    q = F.when((a == 0) & (b == 0), fa * fb).when((a == 1) & (b == 1), fa * fb).when((a == 0) & (b == 1), na * fb).otherwise(fa * nb)
    rest = F.greatest(1 - q, tiny)
    cells = {
        "t00": F.when((a == 0), rest).otherwise(tiny),
        "t01": F.when((a == 0), q).otherwise(tiny),
        "t10": F.when((a == 1) & (b == 1), rest).when((a == 1) & (b == 0), q).otherwise(tiny),
        "t11": F.when((a == 1) & (b == 1), q).when((a == 1) & (b == 0), rest).otherwise(tiny),
    }
    keep = [c for c in fractions.columns if c not in CELLS]
    return mirror(fractions.select(*keep, *[v.alias(k) for k, v in cells.items()]), normalized=True)


def weighted_mean(one: DataFrame, two: DataFrame, keys: list[str], min_allele_count: int) -> DataFrame:
    """Mean of two haplotypes' transitions weighted by coverage, where all four coverages reach the minimum.

    one, two: keys, cov_a, cov_b and cells.
    """
    names = ["cov_a", "cov_b", *CELLS]
    x = one.select(*keys, *[F.col(c).alias(f"x_{c}") for c in names]).join(two.select(*keys, *[F.col(c).alias(f"y_{c}") for c in names]), keys)
    low = F.least("x_cov_a", "x_cov_b", "y_cov_a", "y_cov_b")
    wx, wy = (F.col("x_cov_a") + F.col("x_cov_b")) / 2, (F.col("y_cov_a") + F.col("y_cov_b")) / 2
    mean = lambda c: (F.col(f"x_{c}") * wx + F.col(f"y_{c}") * wy) / (wx + wy + 1e-100)
    return x.where(low >= min_allele_count).select(*keys, *[mean(c).alias(c) for c in CELLS])
