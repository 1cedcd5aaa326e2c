"""Ordered operators that stay distributed: dense indices, running sums, islands.

A window over a whole chromosome is one task. Here it runs in two levels: rows
are grouped into buckets of an order column, each bucket is numbered or summed
by itself, and one row per bucket carries what came before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1_000_000


def dense_index(df: DataFrame, chrom: str, pos: str, ties: list[str], name: str = "idx", width: int = BUCKET) -> DataFrame:
    """Row numbers from 0 per chromosome in the order of (pos, ties)."""
    x = df.withColumn("__b", F.floor(F.col(pos) / width).cast("long"))
    before = Window.partitionBy(chrom).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offset = x.groupBy(chrom, "__b").count().withColumn("__off", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy(chrom, "__b").orderBy(pos, *ties)
    out = x.withColumn("__n", F.row_number().over(inside) - 1).join(offset, [chrom, "__b"])
    return out.withColumn(name, (F.col("__n") + F.col("__off")).cast("long")).drop("__b", "__n", "__off")


def running_sum(df: DataFrame, chrom: str, idx: str, value: Column, name: str, width: int = 100_000) -> DataFrame:
    """Sum of ``value`` over the rows of the chromosome up to and including each row, in idx order."""
    x = df.withColumn("__v", value).withColumn("__b", F.floor(F.col(idx) / width).cast("long"))
    before = Window.partitionBy(chrom).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offset = x.groupBy(chrom, "__b").agg(F.sum("__v").alias("__s")).withColumn("__off", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    inside = Window.partitionBy(chrom, "__b").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    out = x.withColumn("__r", F.sum("__v").over(inside)).join(offset, [chrom, "__b"])
    return out.withColumn(name, F.col("__r") + F.col("__off")).drop("__v", "__b", "__r", "__off")


def islands(df: DataFrame, chrom: str, idx: str) -> DataFrame:
    """Runs of consecutive idx values among the rows: chrom, first, last, n."""
    x = dense_index(df.select(chrom, idx), chrom, idx, [], "__k", 100_000)
    return (
        x.groupBy(chrom, (F.col(idx) - F.col("__k")).alias("__run"))
        .agg(F.min(idx).alias("first"), F.max(idx).alias("last"), F.count("*").alias("n"))
        .drop("__run")
    )


def out_of_order(df: DataFrame, chrom: str, idx: str, value: str, width: int = 100_000) -> DataFrame:
    """Rows whose value is below that of an earlier row of the chromosome, in idx order: in two levels, like ``running_sum``."""
    x = df.withColumn("__b", F.floor(F.col(idx) / width).cast("long"))
    before = Window.partitionBy(chrom).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    tops = x.groupBy(chrom, "__b").agg(F.max(value).alias("__t")).withColumn("__before", F.max("__t").over(before)).drop("__t")
    inside = Window.partitionBy(chrom, "__b").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__own", F.max(value).over(inside)).join(tops, [chrom, "__b"])
    return x.where(F.col(value) < F.greatest("__own", "__before")).drop("__b", "__own", "__before")


def order_report(df: DataFrame, chrom: str, value: str) -> DataFrame:
    """A row per partition that isn't empty: part, n, inversions (rows whose value is below that of the row before, on one
    chromosome), and the first and last row's chromosome and value. Rows are taken as they lie, without an exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, down, first, last = 0, 0, None, None
        for batch in batches:
            if not len(batch):
                continue
            names, values = batch.column(0).to_pandas().to_numpy(), batch.column(1).fill_null(-1).to_numpy()
            if last is not None:
                down += int(names[0] == last[0] and values[0] < last[1])
            down += int(((names[1:] == names[:-1]) & (values[1:] < values[:-1])).sum())
            n, first, last = n + len(batch), first or (names[0], int(values[0])), (names[-1], int(values[-1]))
        if n:
            row = [TaskContext.get().partitionId(), n, down, *first, *last]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names_)

    names_ = ["part", "n", "inversions", "first_chrom", "first", "last_chrom", "last"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    src = df.select(F.col(chrom).cast("string"), F.col(value).cast("long"))
    return src.mapInArrow(run, "part int, n long, inversions long, first_chrom string, first long, last_chrom string, last long")


def inversions(report: DataFrame) -> int:
    """Inversions of the whole table, also between partitions; one row of the report stands for a partition."""
    before = Window.orderBy("part")
    between = ((F.lag("last_chrom").over(before) == F.col("first_chrom")) & (F.lag("last").over(before) > F.col("first"))).cast("long")
    return report.select((F.col("inversions") + F.coalesce(between, F.lit(0))).alias("d")).agg(F.sum("d")).first()[0] or 0
