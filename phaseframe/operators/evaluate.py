"""Evaluation of phasings: blocks, N50, switch errors, windows, tool comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phaseframe.operators.intervals import overlap_counts, overlap_length, overlaps
from phaseframe.operators.ordered import BUCKET
from phaseframe.operators.quantiles import quantiles


def block_n50(blocks: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """Largest length L such that blocks of at least L hold half of the total; by distinct lengths, so a window holds few rows."""
    x = blocks.groupBy(*keys, length.alias("length")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    running = F.sum(F.col("length") * F.col("n")).over(w.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(F.col("length") * F.col("n")).over(w)
    return x.withColumn("r", running).withColumn("t", total).where("2 * r >= t").groupBy(*keys).agg(F.max("length").alias("n50"))


def switch_points(query: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring sites of a block phased in both: whether the orientation switches between them.

    query: keys, block, pos, h0; truth: keys, pos, truth_h0.
    """
    both = query.join(truth, [*keys, "pos"]).withColumn("o", (F.col("h0") + F.col("truth_h0")) % 2)
    w = Window.partitionBy(*keys, "block").orderBy("pos")
    return (
        both.withColumn("prev", F.lag("o").over(w)).where("prev IS NOT NULL").withColumn("switch", (F.col("o") != F.col("prev")).cast("int"))
    )


def switch_errors(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(
        F.sum("switch").alias("all_switches"), F.count("*").alias("all_assessed_pairs"),
        (F.sum("switch") / F.count("*")).alias("all_switch_rate"),
    )


def errors_per_window(points: DataFrame, keys: list[str], width: int = 10_000) -> DataFrame:
    """Tumbling windows over position."""
    return points.groupBy(*keys, F.floor(F.col("pos") / width).cast("long").alias("window")).agg(
        F.sum("switch").alias("switches"), F.count("*").alias("pairs")
    )


def interval_quantiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """2.5, 50 and 97.5 percentiles, exact with linear interpolation."""
    return quantiles(df, keys, value, {"low": 0.025, "mid": 0.5, "high": 0.975})


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    c = F.col(value)
    plain = df.groupBy(*keys).agg(F.sum(c).alias("total"), F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
    middle = quantiles(df, keys, value, {"median": 0.5})
    x, y = plain.alias("x"), middle.alias("y")
    both = x.join(y, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys] or F.lit(True), "left")
    return both.select(*[F.col(f"x.{k}").alias(k) for k in keys], "total", "low", "high", "mean", "median", "std")


def extents(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(start).alias("start"), F.max(end).alias("end"))


def overlap_bp(a: DataFrame, b: DataFrame, chrom: str, a_start: str, a_end: str, b_start: str, b_end: str, by: list[str]) -> DataFrame:
    found = overlaps(a, b, chrom, a_start, a_end, b_start, b_end)
    return found.groupBy(*by).agg(F.sum(overlap_length(a_start, a_end, b_start, b_end)).alias("bp"))


def coverage_shares(regions: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """Per region: overlapped at all, contained in one block."""
    args = ("chrom", "gene_start", "gene_end", "block_start", "block_end", key)
    some = overlap_counts(regions, blocks, *args).withColumnRenamed("n", "n_overlap")
    full = overlap_counts(regions, blocks, *args, how="within").select(*key, F.col("n").alias("n_within"))
    return some.join(full, key)


def block_gaps(blocks: DataFrame) -> DataFrame:
    """Distance from each block to the one before on its chromosome, in two levels (bucket, then bucket ends)."""
    x = blocks.withColumn("__b", F.floor(F.col("block_start") / BUCKET).cast("long"))
    w = Window.partitionBy("chrom", "__b").orderBy("block_start")
    ends = x.groupBy("chrom", "__b").agg(F.max_by("block_end", "block_start").alias("__e"))
    ends = ends.withColumn("__prev", F.lag("__e").over(Window.partitionBy("chrom").orderBy("__b"))).drop("__e")
    x = x.withColumn("__l", F.lag("block_end").over(w)).join(ends, ["chrom", "__b"])
    return x.withColumn("gap", F.col("block_start") - F.coalesce("__l", "__prev")).drop("__b", "__l", "__prev")


def sites_in_all(tables: DataFrame, keys: list[str], tool: str, n_tools: int) -> DataFrame:
    """Distinct sites that every tool has."""
    return tables.select(*keys, tool).distinct().groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") == n_tools).select(*keys)


def sex_mode(depths: DataFrame, coverage: float) -> DataFrame:
    """Per chromosome: diploid calling if the mean depth reaches a quarter of the coverage."""
    return depths.groupBy("chrom").agg(F.avg("depth").alias("depth")).withColumn(
        "mode", F.when(F.col("depth") >= coverage / 4, "present").otherwise("absent")
    )


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """Counts per equal bin, values outside clipped into the outer ones."""
    at = F.least(F.greatest(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)), F.lit(1)), F.lit(bins))
    return df.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def concordant(query: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Sites of the query that the truth has with the same alleles (ref, alt)."""
    return query.join(truth, [*keys, "ref", "alt"], "left_semi")


def gains(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``gain``: what a second run has more of a value than a first one."""
    x = before.select(*keys, F.col(value).alias("__a")).join(after.select(*keys, F.col(value).alias("__b")), keys)
    return x.select(*keys, (F.col("__b") - F.col("__a")).alias("gain"))


def joined_gaps(blocks: DataFrame, joined: DataFrame, sites: DataFrame) -> DataFrame:
    """Gaps between neighbouring blocks that a larger block joins: block, block_start (after the gap), gap, n_sites in it."""
    inner = blocks.select("chrom", F.col("block_start").alias("s"), F.col("block_end").alias("e"))
    inside = overlaps(inner, joined.select("chrom", "block", "block_start", "block_end"), "chrom", "s", "e", "block_start", "block_end", how="within")
    w = Window.partitionBy("chrom", "block").orderBy("s")
    gaps = inside.withColumn("before", F.lag("e").over(w)).where("before IS NOT NULL").select("chrom", "block", "before", "s")
    counted = overlap_counts(gaps, sites.select("chrom", "site_start", "site_end"), "chrom", "before", "s", "site_start", "site_end", ["block", "before"])
    return counted.select("chrom", "block", F.col("s").alias("block_start"), (F.col("s") - F.col("before")).alias("gap"), F.col("n").alias("n_sites"))


def first_fit_rows(df: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """``row``: the first display row in which an interval overlaps none before it; a chromosome's intervals are one picture."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([start, end, *keys])
        ends: list[int] = []
        rows = []
        for a, b in zip(pdf[start], pdf[end]):
            k = next((k for k, e in enumerate(ends) if e <= a), len(ends))
            ends[k : k + 1] = [b]
            rows.append(k)
        return pdf[["chrom", *keys]].assign(row=pd.array(rows, "int32"))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select("chrom", *keys).schema.fields)
    return df.groupBy("chrom").applyInPandas(run, f"{kinds}, row int")
