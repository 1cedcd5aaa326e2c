"""Exact quantiles by distributed selection.

``percentile`` holds all distinct values of a group in one task. Here each wanted order statistic
is closed in by histograms: a round counts the values of the range that still holds it in equal
bins, a partial aggregate, and the bin in which its rank falls is the next range. Once a
range has few values, or one only, these are numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaseframe.sources.checkpoints import cut

BINS = 1024
#: Values of a range that are numbered in one window.
FEW = 10_000


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: DataFrame, bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys, rank, x: the values of these ranks (from 0) of each group. ``ranks``: keys and rank, each below the group's number
    of values. Nulls and NaN aren't counted."""
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    whole = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    w, r = whole.alias("w"), ranks.alias("r")
    targets = r.join(w, [F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys] or F.lit(True))  # one row without keys
    targets = cut(targets.select(*[F.col(f"r.{k}").alias(k) for k in keys], "rank", "lo", "hi", F.lit(0).cast("long").alias("before"), "n"), "ranges")

    def inside(t: DataFrame) -> DataFrame:
        x, y = rows.alias("x"), t.alias("t")
        fits = (F.col("x.v") >= F.col("t.lo")) & (F.col("x.v") <= F.col("t.hi"))
        for k in keys:
            fits &= F.col(f"x.{k}").eqNullSafe(F.col(f"t.{k}"))
        return x.join(y, fits).select(*[F.col(f"t.{k}").alias(k) for k in keys], "rank", "lo", "hi", "before", "v")

    while not (wide := targets.where((F.col("n") > few) & (F.col("lo") < F.col("hi")))).isEmpty():
        # halves first, so that a range of all doubles doesn't overflow
        span = F.col("hi") / 2 - F.col("lo") / 2
        share = F.when(span > 0, (F.col("v") / 2 - F.col("lo") / 2) / span).when(F.col("v") > F.col("lo"), 1.0).otherwise(0.0)
        binned = inside(wide).withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
        counts = binned.groupBy(*keys, "rank", "before", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        below = Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for a bin
        counts = counts.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(below), F.lit(0)))
        hit = counts.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        done = targets.where((F.col("n") <= few) | (F.col("lo") >= F.col("hi")))
        targets = cut(done.unionByName(hit.select(*targets.columns)), "ranges")
    known = targets.where("lo = hi").select(*keys, "rank", F.col("lo").alias("x"))
    number = F.row_number().over(Window.partitionBy(*keys, "rank").orderBy("v")) - 1 + F.col("before")
    counted = inside(targets.where("lo < hi")).withColumn("at", number).where("at = rank")
    return known.unionByName(counted.select(*keys, "rank", F.col("v").alias("x")))


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys and a column for each of ``wanted`` (name: share), exact with linear interpolation between neighbouring ranks."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    n = cut(rows.groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    n = n if keys else n.where("n > 0")
    places = F.array(*[(F.lit(p) * (F.col("n") - 1)) for p in wanted.values()])
    at = n.select(*keys, F.posexplode(places).alias("q", "place"))
    ends = at.select(*keys, F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    found = cut(order_statistics(df, keys, value, ends, bins, few), "found")
    side = lambda name: found.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.col("rank").alias(name), F.col("x").alias(f"x_{name}"))
    x = at.withColumn("__low", F.floor("place")).withColumn("__high", F.ceil("place"))
    for name in ("low", "high"):
        s = side(name)
        on = x[f"__{name}"] == s[name]
        for k in keys:
            on &= x[k].eqNullSafe(s[f"{name}_{k}"])
        x = x.join(s, on).drop(name, *[f"{name}_{k}" for k in keys])
    x = x.withColumn("x", F.col("x_low") + (F.col("place") - F.col("__low")) * (F.col("x_high") - F.col("x_low")))
    return x.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == i, F.col("x"))).alias(name) for i, name in enumerate(wanted)])

