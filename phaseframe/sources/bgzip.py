"""Lines of blocked gzip text (.vcf.gz, .bed.gz) as a data source, after ``register``.

``spark.read.format('bgzip')`` gives ``value``, lines without those of the header. Files are cut at blocks, a task
begins after the first line end of its piece; with ``chrom``, ``start`` and ``end`` (0-based, half open) as options
and an index (.tbi, .csi) beside the file only the stretches of that region are read, and only its lines are given.
``df.write.format('bgzip')`` takes ``value`` in order of position, with the options ``header`` (lines), ``single`` and
``preset``: ``vcf`` or ``bed``, which columns the index is made of.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from phaseframe.sources import bgzf, parts

SUFFIXES = (".gz", ".bgz")
SPLIT_BYTES = 64 << 20
BATCH_LINES = 10_000
#: Fixed values of the index: form and columns (name, start, end) of the presets.
PRESETS = {"vcf": (2, (1, 2, 0)), "bed": (0x10000, (1, 2, 3))}


def is_blocked(path: str) -> bool:
    """Whether the path names files of blocked gzip."""
    return path.endswith(SUFFIXES) and all(bgzf.block_size(bgzf.File(p).read_at(0, 512)) for p in bgzf.files(path, SUFFIXES))


def read_header(path: str) -> tuple[list[str], int]:
    """The lines with # at the top of the first file, and the virtual offset behind them."""
    stream = bgzf.Stream(bgzf.File(bgzf.files(path, SUFFIXES)[0]))
    lines, at = [], stream.tell()
    while (line := stream.line()).startswith(b"#"):
        lines.append(line.decode())
        at = stream.tell()
    return lines, at


def _place(line: bytes, preset: str) -> tuple[str, int, int]:
    f = line.split(b"\t", 4)
    if preset == "bed":
        return f[0].decode(), int(f[1]), int(f[2])
    return f[0].decode(), int(f[1]) - 1, int(f[1]) - 1 + max(len(f[3]), 1)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.preset = options["path"], options.get("preset", "vcf")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.chrom, self.start, self.end = options.get("chrom"), int(options.get("start", 0)), int(options.get("end", 1 << 60))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in bgzf.files(self.path, SUFFIXES):
            _, first = read_header(path)
            index, size = bgzf.index_of(path) if self.chrom else None, bgzf.File(path).size
            if index is None or not index.names:
                out += [InputPartition((path, low, high, low == first, False)) for low, high in bgzf.plain_ranges(first, size, self.split)]
            elif self.chrom in index.names:
                found = index.stretches(index.names.index(self.chrom), self.start, min(self.end, 1 << 31))
                out += [InputPartition((path, low, high, True, True)) for low, high in bgzf.indexed_ranges(found, index.starts(), self.split)]
        return out

    def lines(self, path: str, low: int, high: int, at_line: bool, exact: bool) -> Iterator[bytes]:
        """Lines that begin in the piece. Unless ``at_line``, that is after its first line end; so where its upper border
        isn't ``exact``, a mere block, a line that begins right there is read here."""
        file = bgzf.File(path)
        if not at_line:
            at = bgzf.next_block(file, low >> 16, min(high >> 16, file.size))
            if at is None:
                return
            stream = bgzf.Stream(file, at << 16)
            stream.line()
        else:
            stream = bgzf.Stream(file, low)
        border = high if exact else self._border(file, high)
        while (at := stream.tell()) < border or (not exact and at == border):
            line = stream.line()
            if not line and stream.tell() == at:
                return
            if line and not line.startswith(b"#"):
                yield line

    @staticmethod
    def _border(file: bgzf.File, high: int) -> int:
        """The block at which the next piece begins."""
        at = bgzf.next_block(file, high >> 16, file.size) if high >> 16 < file.size else None
        return (file.size if at is None else at) << 16

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no piece of any file
            return
        held: list[str] = []
        for line in self.lines(*partition.value):
            if self.chrom:
                chrom, start, end = _place(line, self.preset)
                if chrom != self.chrom or end <= self.start or start >= self.end:
                    continue
            held.append(line.decode())
            if len(held) == BATCH_LINES:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])


def _codec(options: dict) -> parts.Codec:
    preset = options.get("preset", "vcf")
    form, columns = PRESETS[preset]
    header = options.get("header", "")
    header = header + "\n" if header and not header.endswith("\n") else header

    def records(batch: pa.RecordBatch) -> Iterator[tuple[bytes, str, int, int]]:
        for line in batch.column(batch.schema.get_field_index("value")).to_pylist():
            data = line.encode()
            yield data + b"\n", *_place(data, preset)

    return parts.Codec(".gz", ".tbi", header.encode(), records, lambda index, names: parts.compressed_index(index.tbi(names, form, columns)))


class BgzipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bgzip"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> parts.PartsWriter:
        return parts.PartsWriter(self.options["path"], overwrite, _codec(self.options), str(self.options.get("single", "")).lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BgzipSource)
