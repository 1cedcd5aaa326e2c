"""Interval joins as equi-joins on position bins, never a nested loop.

Intervals are half-open and 0-based unless said otherwise. An interval is
posted in every bin it touches; a point has one bin, so a pair of point and
interval meets once. Two intervals may share several bins: the pair is kept in
the bin where the later of the two starts lies, which is one of them, so no
deduplication is needed. Bins near the usual interval length keep both the posting
factor and the number of pairs compared per pair found near two, see ``usual_width``; a deep spot on a chromosome is one hot bin, which ``split`` deals out by its
depth, and else the skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 16_384


def _bin(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width)).cast("long")


def usual_width(intervals: DataFrame, start: str, end: str) -> int:
    """The mean length of the intervals, from 64 to ``BIN``: a pass over two columns. It is a matter of speed alone."""
    mean = intervals.agg(F.avg((F.col(end) - F.col(start)).cast("double")).alias("m")).first()["m"]
    return int(min(max(mean or BIN, 64), BIN))


def _binned(df: DataFrame, start: str, end: str, width: int, name: str = "__bin") -> DataFrame:
    last = F.greatest(F.col(start), F.col(end) - 1)
    return df.withColumn(name, F.explode(F.sequence(_bin(F.col(start), width), _bin(last, width))))


#: Intervals of a bin beyond which it is split.
DEEP = 200_000


def _split_deep(points: DataFrame, intervals: DataFrame, chrom: str, by: list[str], depth: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``__salt``: a bin with more than ``depth`` intervals is dealt out by a hash of the columns ``by``
    into as many shares as it takes, and its points are copied to each.

    Depths come from a count by bin. Of the table of deep bins there is a row for each ``depth`` intervals at most.
    """
    depths = intervals.groupBy(chrom, "__bin").agg(F.count("*").alias("n")).where(F.col("n") > depth)
    deep = depths.select(F.col(chrom).alias("__deep_chrom"), F.col("__bin").alias("__deep_bin"), F.ceil(F.col("n") / depth).cast("int").alias("__shares"))

    def marked(df: DataFrame) -> DataFrame:
        on = (df[chrom] == F.col("__deep_chrom")) & (df["__bin"] == F.col("__deep_bin"))
        return df.join(deep, on, "left").withColumn("__shares", F.coalesce("__shares", F.lit(1))).drop("__deep_chrom", "__deep_bin")

    p = marked(points).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))).drop("__shares")
    i = marked(intervals).withColumn("__salt", F.pmod(F.xxhash64(*by), F.col("__shares")).cast("int")).drop("__shares")
    return p, i


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, chrom: str, at: str, start: str, end: str, width: int = BIN, split: list[str] | None = None, depth: int = DEEP
) -> DataFrame:
    """Pairs with start <= at < end. ``split``: columns of the intervals that deal out the intervals of a deep bin."""
    p = points.withColumn("__bin", _bin(F.col(at), width))
    i = _binned(intervals, start, end, width)
    keys = [chrom, "__bin"]
    if split:
        p, i = _split_deep(p, i, chrom, split, depth)
        keys.append("__salt")
    return p.join(i, keys).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("__bin", "__salt")


def overlaps(
    a: DataFrame, b: DataFrame, chrom: str, a_start: str, a_end: str, b_start: str, b_end: str, width: int = BIN, how: str = "overlap"
) -> DataFrame:
    """Pairs of intervals that overlap, or of which b contains a (how='within'). Columns of a and b differ but for chrom."""
    x, y = _binned(a, a_start, a_end, width), _binned(b, b_start, b_end, width)
    both = x.join(y, [chrom, "__bin"])
    home = _bin(F.greatest(a_start, b_start), width) == F.col("__bin")
    if how == "within":
        fit = (F.col(b_start) <= F.col(a_start)) & (F.col(b_end) >= F.col(a_end))
    else:
        fit = (F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end))
    return both.where(home & fit).drop("__bin")


def overlap_counts(
    a: DataFrame, b: DataFrame, chrom: str, a_start: str, a_end: str, b_start: str, b_end: str, key: list[str], how: str = "overlap"
) -> DataFrame:
    """Every row of a with the number ``n`` of intervals of b on it, 0 kept. ``key`` names a's rows."""
    found = overlaps(a.select(chrom, a_start, a_end, *key), b.select(chrom, b_start, b_end), chrom, a_start, a_end, b_start, b_end, how=how)
    n = found.groupBy(*key).agg(F.count("*").alias("n"))
    return a.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def overlap_length(a_start: str, a_end: str, b_start: str, b_end: str) -> Column:
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def _next_low(bins: DataFrame, chrom: str, stretch: int = 4096) -> DataFrame:
    """``bins`` (chrom, __bin, __low) with ``__next``, the first ``__low`` of a later bin.

    In two levels, like ``ordered.running_sum``: within a stretch of bins, then over one row per stretch. Windows run from the
    last row to the first, as a frame that grows takes one step a row and one that shrinks is taken anew for each.
    """
    x = bins.withColumn("__part", F.floor(F.col("__bin") / stretch).cast("long"))
    later = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(F.desc(keys[-1])).rowsBetween(Window.unboundedPreceding, -1)
    beyond = x.groupBy(chrom, "__part").agg(F.min("__low").alias("__first"))
    beyond = beyond.withColumn("__beyond", F.last("__first", ignorenulls=True).over(later(chrom, "__part"))).drop("__first")
    x = x.withColumn("__inside", F.last("__low", ignorenulls=True).over(later(chrom, "__part", "__bin"))).join(beyond, [chrom, "__part"])
    return x.withColumn("__next", F.coalesce("__inside", "__beyond")).drop("__part", "__inside", "__beyond")


def first_at_or_after(left: DataFrame, right: DataFrame, chrom: str, at: str, value: str, width: int = 64) -> DataFrame:
    """As-of join forward: ``left`` with the smallest ``value`` of right that is >= ``at``, null beyond the last.

    Within a bin of ``width`` the answer comes from an equi-join; else it is the
    smallest value of the next bin that has one, known from windows over stretches
    of bins, see ``_next_low``.
    """
    r = right.select(chrom, F.col(value).alias("__v"), _bin(F.col(value), width).alias("__bin")).distinct()
    x = left.withColumn("__bin", _bin(F.col(at), width))
    bins = x.select(chrom, "__bin").distinct().join(r.groupBy(chrom, "__bin").agg(F.min("__v").alias("__low")), [chrom, "__bin"], "full")
    bins = _next_low(bins, chrom).select(chrom, "__bin", "__next")
    own = (
        x.select(chrom, "__bin", at).distinct().join(r, [chrom, "__bin"]).where(F.col("__v") >= F.col(at))
        .groupBy(chrom, at).agg(F.min("__v").alias("__own"))
    )
    out = x.join(bins, [chrom, "__bin"], "left").join(own, [chrom, at], "left")
    return out.withColumn(value, F.coalesce("__own", "__next")).drop("__bin", "__next", "__own")
