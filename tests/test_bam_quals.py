"""Qualities of alignments on their way into and out of records, without an object for each number."""

import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from phaseframe.sources import bam

HEADER = bam.header_of_text("@SQ\tSN:chr1\tLN:1000000\n")


def _batch(quals, seqs) -> pa.RecordBatch:
    n = len(seqs)
    rows = {
        "read_name": [f"r{k}" for k in range(n)], "flag": [0] * n, "chrom": ["chr1"] * n, "read_start": list(range(n)), "mapq": [60] * n,
        "cigar": [f"{len(s)}M" for s in seqs], "seq": seqs,
    }
    return pa.RecordBatch.from_arrays([*[pa.array(c) for c in rows.values()], pa.array(quals, pa.list_(pa.int32()))], [*rows, "quals"])


def _records(batch) -> list[bytes]:
    records = [r for r, *_ in bam._codec(HEADER).encode(batch)]
    assert all(struct.unpack_from("<i", r)[0] == len(r) - 4 for r in records)
    return [r[4:] for r in records]


def test_qualities_come_back(spark):
    quals, seqs = [[1, 2, 3, 93], None, [0, 254], [], [7]], ["ACGT", "ACG", "AC", "", "T"]
    batch = _batch(quals, seqs)
    for low, n in ((0, 5), (1, 3), (2, 2), (1, 1), (3, 0)):  # slices keep their offsets
        found = [bam.decode(r, HEADER.names) for r in _records(batch.slice(low, n))]
        assert [x[bam.QUALS] for x in found] == [q or None for q in quals[low : low + n]]
        assert [x[7] for x in found] == [s or "*" for s in seqs[low : low + n]]
    column = bam._list_array(tuple(np.array(q, np.uint8) if q is not None else None for q in quals))
    assert column.to_pylist() == quals and column.type == pa.list_(pa.int32())
    assert bam._list_array((None, None)).to_pylist() == [None, None]


def test_qualities_that_are_none_are_refused(spark):
    with pytest.raises(pa.ArrowInvalid):
        _records(_batch([[256]], ["A"]))
    with pytest.raises(TypeError):
        _records(_batch([[None]], ["A"]))


def test_no_object_for_each_quality(spark):
    size, n = 20_000, 200
    batch = _batch([[30] * size] * n, ["A" * size] * n)
    tracemalloc.start()
    for _ in bam._codec(HEADER).encode(batch):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6, peak
