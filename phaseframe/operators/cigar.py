"""CIGAR operators, gap penalties and allele calls, all as column expressions.

``ops`` is array<struct<op string, len int>>. Query and reference cursors follow
the format: M = X advance both, I and S the query, D and N the reference.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def parse(cigar: Column) -> Column:
    found = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1)
    return F.transform(found, lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.regexp_extract(x, r"\d+", 0).cast("int").alias("len")))


_STEPS = re.compile(r"(\d+)([MIDNSHP=X])")
OFFSETS = "array<struct<op:string,len:int,q:int,r:int>>"


def flat_operations(cigars: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The operations of all CIGARs, one behind another: number of the CIGAR, letter, length, and the query and
    reference offsets they start at, by running sums over all of them at once."""
    parts = [_STEPS.findall(c) if c else [] for c in cigars]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    letters = np.array([op for p in parts for _, op in p], "U1") if counts.sum() else np.empty(0, "U1")
    sizes = np.fromiter((int(n) for p in parts for n, _ in p), np.int64, len(letters))
    first = np.repeat(np.cumsum(counts) - counts, counts)

    def before(moves: str) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(np.where(np.isin(letters, list(moves)), sizes, 0))])
        return total[:-1] - total[first] if len(first) else np.empty(0, np.int64)

    return np.repeat(np.arange(len(cigars)), counts), letters, sizes, before("M=XIS"), before("M=XDN")


def _offset_lists(cigars: list[str | None]) -> pa.Array:
    """The operations of each CIGAR with the query and reference offsets they start at."""
    read, letters, sizes, q, r = flat_operations(cigars)
    ends = np.searchsorted(read, np.arange(len(cigars) + 1))
    values = pa.StructArray.from_arrays([pa.array(letters.tolist(), pa.string()), *[pa.array(x.astype(np.int32)) for x in (sizes, q, r)]], ["op", "len", "q", "r"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def with_offsets(df: DataFrame, cigar: str = "cigar", name: str = "offs") -> DataFrame:
    """``df`` with each alignment's operations and the query and reference offsets they start at; linear in the operations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs = _offset_lists(batch.column(batch.schema.get_field_index(cigar)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, offs], [*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, _parse_datatype_string(OFFSETS))]))


def query_index(offs: Column, at: Column) -> Column:
    """Query index aligned to a reference offset; inside a deletion the index after the last aligned base; null outside."""
    hit = F.filter(offs, lambda o: o["op"].isin("M", "=", "X", "D", "N") & (o["r"] <= at) & (at < o["r"] + o["len"]))
    one = F.get(hit, F.lit(0))
    return F.when(one["op"].isin("D", "N"), one["q"]).otherwise(one["q"] + at - one["r"])


def rates(ops: Column) -> tuple[Column, Column]:
    """Indel and mismatch rate per operation base; null without any."""
    total = lambda letters: F.aggregate(F.filter(ops, lambda o: o["op"].isin(*letters)), F.lit(0), lambda a, o: a + o["len"])
    every = total("MIDNSHP=X")
    each = lambda n: F.when(every > 0, n / every)
    return each(total("ID")), each(total("X"))


def gap_penalties(indel_rate: Column) -> tuple[Column, Column]:
    """Opening and extension by how error-prone a read is."""
    opening = F.when(indel_rate < 0.005, 7).when(indel_rate < 0.02, 5).when(indel_rate < 0.05, 4).otherwise(3)
    return opening, F.when(indel_rate < 0.005, 2).otherwise(1)


def call_snv(seq: Column, qual: Column, qpos: Column, a: Column, b: Column, min_quality: int) -> Column:
    """0 or 1 for the allele, -1 for a base of too low quality, null for another base (to be realigned)."""
    base = F.substring(seq, qpos + 1, F.lit(1))
    return F.when(qual <= min_quality, -1).when(base == a, 0).when(base == b, 1)


def call_snv_context(seq: Column, quals: Column, qpos: Column, left: Column, right: Column, a: Column, b: Column, min_quality: int) -> Column:
    """Nanopore reads: three bases with the reference's neighbours, the lowest of three qualities."""
    word = F.substring(seq, qpos, F.lit(3))
    low = F.array_min(F.slice(quals, qpos, 3))
    return F.when(low <= min_quality, -1).when(word == F.concat(left, a, right), 0).when(word == F.concat(left, b, right), 1)


def call_insertion(seq: Column, qpos: Column, qnext: Column, alt: Column, ref_length: Column | None = None) -> Column:
    """No inserted bases: 0; exactly those the alternative has after the reference's: 1; others null (to be realigned)."""
    inserted = F.substring(seq, qpos + 2, qnext - qpos - 1)
    start = F.lit(2) if ref_length is None else ref_length + 1
    return F.when(qnext - qpos <= 1, 0).when(inserted == F.substring(alt, start, F.length(alt)), 1)


def call_deletion(ref_span: Column, query_span: Column, ref: Column, alt: Column) -> Column:
    """Deleted bases between two positions against the alleles' difference in length."""
    deleted = F.greatest(ref_span - query_span, F.lit(0))
    return F.when(deleted == 0, 0).when(deleted == F.length(ref) - F.length(alt), 1)


def methylation_probability(offs: Column, at: Column, calls: Column) -> Column:
    """Probability of modification of the base aligned to ``at``; -1 where none is aligned or called.

    ``calls`` is map<int, double> from query index to probability.
    """
    aligned = F.filter(offs, lambda o: o["op"].isin("M", "=", "X") & (o["r"] <= at) & (at < o["r"] + o["len"]))
    one = F.get(aligned, F.lit(0))
    return F.coalesce(F.try_element_at(calls, one["q"] + at - one["r"]), F.lit(-1.0))


def explode_offsets(df: DataFrame, cigar: str = "cigar") -> DataFrame:
    out = with_offsets(df, cigar, "__offs").withColumn("o", F.explode("__offs"))
    return out.select(*[c for c in df.columns], "o.op", "o.len", "o.q", "o.r")
