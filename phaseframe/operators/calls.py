"""Direct allele calls of whole batches of reads: a read's variants meet its CIGAR by a sorted merge.

The operations of all reads of a batch lie one behind another, keyed by read and reference
offset; so do the variants, and one search of sorted keys in sorted keys places them all. What
follows are array operations over the pairs of the batch. Work grows with operations plus variants.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseframe.config import PhasingConfig
from phaseframe.operators.cigar import flat_operations

#: Kinds of variants as to how they are called: one base for another, inserted and deleted bases, anything else.
SNV, INSERTION, DELETION, OTHER = 0, 1, 2, 3
#: A state that only realignment can tell.
OPEN = 2
SPEC = "array<struct<at:bigint,idx:bigint,span:int,kind:int,wide:int,flank:int,size_b:int,bases:string,tail:string>>"
CALLS = "array<struct<idx:bigint,q:int,state:int,window:string,up:int,down:int>>"


def spec(windows: DataFrame) -> DataFrame:
    """chrom, at (0-based) and ``spec``: what a call needs of a variant, without any stretch of the reference.

    bases: before it, of either allele, after it (single bases only). tail: digest of what an insertion adds.
    """
    span, b = F.length("ref"), F.length("allele_b")
    same = F.col("ref") == F.col("allele_a")
    single = (F.col("wide") == 1) & (span == 1)
    kind = F.when(single, SNV).when(same & (span < b), INSERTION).when(same & (span > b), DELETION).otherwise(OTHER)

    def around(k: int) -> Column:
        place = F.col("pos") - 1 - F.col("win_start") + k
        base = F.substring("ref_seq", (place + 1).cast("int"), F.lit(1))
        return F.when((place >= 0) & (base != ""), base).otherwise(F.lit(" "))

    bases = F.when(single, F.concat(around(-1), "allele_a", "allele_b", around(1)))
    tail = F.when(kind == INSERTION, F.md5(F.substring("allele_b", span + 1, b).cast("binary")))
    at = F.col("pos") - 1
    fields = [at.alias("at"), "idx", span.alias("span"), kind.cast("int").alias("kind"), "wide", "flank", b.alias("size_b"), bases.alias("bases"), tail.alias("tail")]
    return windows.select("chrom", at.alias("at"), F.struct(*fields).alias("spec"))


def _text(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and bytes of a column of strings; nulls are empty."""
    array = array.fill_null("")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)


class _Merge:
    """Query indices of reference offsets of the reads of a batch."""

    def __init__(self, cigars: list[str | None]):
        self.read, self.op, self.size, self.q, self.r = flat_operations(cigars)
        on_reference = np.isin(self.op, list("M=XDN")) & (self.size > 0)
        self._read, self._size, self._q, self._r = (x[on_reference] for x in (self.read, self.size, self.q, self.r))
        self._gap = np.isin(self.op[on_reference], list("DN"))
        self._width = int((self._r + self._size).max(initial=0)) + 1
        self._keys = self._read * self._width + self._r

    def query(self, read: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The aligned index; in a gap of the read that behind the last aligned base; -1 outside."""
        hit = np.searchsorted(self._keys, read * self._width + np.clip(at, 0, self._width - 1), side="right") - 1
        ok = (hit >= 0) & (at >= 0)
        hit = np.maximum(hit, 0)
        if not len(self._keys):
            return np.full(len(read), -1)
        ok &= (self._read[hit] == read) & (at < self._r[hit] + self._size[hit])
        return np.where(ok, self._q[hit] + np.where(self._gap[hit], 0, at - self._r[hit]), -1)


def _penalties(merge: _Merge, reads: int) -> tuple[np.ndarray, np.ndarray]:
    """Opening and extension of gaps by a read's share of inserted and deleted bases."""
    every = np.bincount(merge.read, merge.size, reads)
    gaps = np.bincount(merge.read, merge.size * np.isin(merge.op, list("ID")), reads)
    rate = np.where(every > 0, gaps / np.maximum(every, 1), 1.0)
    return np.select([rate < 0.005, rate < 0.02, rate < 0.05], [7, 5, 4], 3), np.where(rate < 0.005, 2, 1)


def called(reads: DataFrame, config: PhasingConfig) -> DataFrame:
    """chrom, read_name, read_start, aln, strand, gap_open, gap_extend and ``calls`` of the variants of each read:
    idx, q (-1: none), state (-1: not callable, null: to be realigned; then also the read's ``window`` and how far it reaches
    before and after the variant). ``reads``: alignments with ``aln`` and ``variants``, an array of ``spec`` by position."""
    ont, least = config.ont, config.min_base_quality

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        merge = _Merge(column("cigar").to_pylist())
        lists = column("variants")
        n = np.diff(lists.offsets.to_numpy())
        v = lists.flatten()
        field = lambda name: v.field(name).to_numpy(zero_copy_only=False)
        read = np.repeat(np.arange(len(batch)), n)
        at = field("at") - column("read_start").to_numpy()[read]
        span, kind, wide, flank, size_b = (field(c).astype(np.int64) for c in ("span", "kind", "wide", "flank", "size_b"))
        text, data = _text(column("seq"))
        first, size = text[:-1][read], np.diff(text)[read]
        quals = column("quals")
        q_offsets, q_values = quals.offsets.to_numpy().astype(np.int64), quals.values.to_numpy(zero_copy_only=False).astype(np.int64)
        q_first, q_size = q_offsets[:-1][read], np.where(np.asarray(quals.is_null()), 0, np.diff(q_offsets))[read]

        q = merge.query(read, at)
        state = np.full(len(read), OPEN)

        def base(place: np.ndarray) -> np.ndarray:
            """Of the pair's read; 0 outside."""
            inside = (place >= 0) & (place < size)
            return np.where(inside, data[np.minimum(first + np.clip(place, 0, None), len(data) - 1)], 0)

        def quality(place: np.ndarray) -> np.ndarray:
            """Of the pair's read; a high one where there is none."""
            inside = (place >= 0) & (place < q_size)
            return np.where(inside, q_values[np.minimum(q_first + np.clip(place, 0, None), max(len(q_values) - 1, 0))] if len(q_values) else 0, 1 << 20)

        bases_at, bases = _text(v.field("bases"))
        known = lambda k: np.where(kind == SNV, bases[np.minimum(bases_at[:-1] + k, len(bases) - 1)], 1)
        a, b = (base(q) == known(k) for k in (1, 2))
        low = quality(q)
        if ont:
            around = (base(q - 1) == known(0)) & (base(q + 1) == known(3))
            a, b = a & around, b & around
            low = np.minimum(np.minimum(quality(q - 1), low), quality(q + 1))
        single = kind == SNV
        state[single] = np.select([low <= least, a, b], [-1, 0, 1], OPEN)[single]

        after = merge.query(read, at + np.where(kind == DELETION, span, 1))
        inserted = after - q - 1
        grows = (kind == INSERTION) & (after >= 0)
        state[grows & (inserted <= 0)] = 0
        tails = v.field("tail")
        for k in np.flatnonzero(grows & (inserted > 0) & (inserted == size_b - span) & (q >= 0)):
            low_end = first[k] + q[k] + 1
            if hashlib.md5(data[low_end : low_end + inserted[k]].tobytes()).hexdigest() == tails[int(k)].as_py():
                state[k] = 1
        deleted = np.where(after >= 0, np.maximum(span - (after - q), 0), 0)
        shrinks = kind == DELETION
        state[shrinks & (deleted == 0)] = 0
        state[shrinks & (deleted > 0) & (deleted == span - size_b)] = 1
        state[(q < 0) | (q >= size)] = -1

        open_ = state == OPEN
        start, end = np.maximum(q - flank, 0), np.minimum(size, q + wide + flank)
        windows: list[str | None] = [None] * len(read)
        for k in np.flatnonzero(open_):
            windows[k] = data[first[k] + start[k] : first[k] + end[k]].tobytes().decode()
        number = lambda x: pa.array(x.astype(np.int32), mask=~open_)
        fields = {
            "idx": v.field("idx"), "q": pa.array(q.astype(np.int32)), "state": pa.array(state.astype(np.int32), mask=open_), "window": pa.array(windows, pa.string()),
            "up": number(q - start), "down": number(end - (q + wide)),
        }
        found = pa.StructArray.from_arrays(list(fields.values()), list(fields))
        opening, extend = _penalties(merge, len(batch))
        columns = [column(c) for c in ("chrom", "read_name", "read_start", "aln", "strand")] + [pa.array(opening.astype(np.int32)), pa.array(extend.astype(np.int32))]
        calls = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), found)
        return pa.RecordBatch.from_arrays([*columns, calls], ["chrom", "read_name", "read_start", "aln", "strand", "gap_open", "gap_extend", "calls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield one(batch)

    strand = (F.col("flag").bitwiseAND(16) != 0).cast("int").alias("strand")
    src = reads.select("chrom", "read_name", F.col("read_start").cast("long").alias("read_start"), "aln", strand, "cigar", "seq", F.col("quals").cast("array<tinyint>").alias("quals"), F.col("variants").cast(SPEC).alias("variants"))
    return src.mapInArrow(run, f"chrom string, read_name string, read_start long, aln long, strand int, gap_open int, gap_extend int, calls {CALLS}")
