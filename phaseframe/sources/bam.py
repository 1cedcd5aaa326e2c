"""BAM files as a data source: ``spark.read.format('bam').load(path)`` and ``df.write.format('bam')``, after ``register``.

Reading. A file is many tasks: with an index beside it (.bai, .csi) they begin at records that the index
names; without one each looks for the first record of its piece of the file, a chain of plausible records. Filters on
``chrom``, ``read_start`` and ``read_end`` become stretches of the file by the index, and only
the blocks that they touch are read. Options: ``split_bytes`` (of the compressed file, for a task), ``raw`` (a column
``record`` with the record's bytes, all tags included), ``tags`` (names of integer tags that become columns, by comma).

Writing. Rows have ``record``, or the decoded columns; ``hp`` (optional, null: none) becomes the HP tag in place of
one that is there. Options: ``header`` (SAM header text with its @SQ lines), ``single`` (one file instead of a folder
of files, strung together at the commit). Sorted rows (``coordinate_order``) get an index.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from phaseframe.sources import bgzf, parts

SCHEMA = (
    "read_name string, flag int, chrom string, read_start long, read_end long, mapq int, cigar string, seq string,"
    " quals array<int>, is_forward boolean, mm string, ml string"
)
#: Place of ``quals`` in it.
QUALS = 8
SPLIT_BYTES = 64 << 20
BATCH_RECORDS = 1_000
#: Fixed values of the format: letters of bases and operations, and the sizes of numbers by type letter.
_SEQ = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_CODES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}

_PAIRS = np.array([[ord(_SEQ[b >> 4]), ord(_SEQ[b & 15])] for b in range(256)], np.uint8)
_NIBBLE = np.full(256, 15, np.uint8)
_NIBBLE[[ord(c) for c in _SEQ]] = np.arange(16)
_NIBBLE[[ord(c.lower()) for c in _SEQ]] = np.arange(16)
_STEP = re.compile(r"(\d+)([MIDNSHP=X])")


# ------------------------------------------------------------- headers and records


@dataclass
class Header:
    text: str
    names: list[str]
    lengths: list[int]
    #: Virtual offset of the first record.
    first: int = 0

    def encoded(self) -> bytes:
        text = self.text.encode()
        refs = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in zip(self.names, self.lengths))
        return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.names)) + refs


def header_of_text(text: str) -> Header:
    """The header of a SAM text."""
    refs = [dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f) for line in text.splitlines() if line.startswith("@SQ")]
    return Header(text, [r["SN"] for r in refs], [int(r["LN"]) for r in refs])


def read_header(path: str) -> Header:
    """The header of a file, or of the first file of a folder."""
    stream = bgzf.Stream(bgzf.File(bgzf.files(path, (".bam",))[0]))
    number = lambda: struct.unpack("<i", stream.read(4))[0]
    if stream.read(4) != b"BAM\1":
        raise ValueError(f"{path} is not a BAM file")
    text = stream.read(number()).rstrip(b"\0").decode()
    names, lengths = [], []
    for _ in range(number()):
        names.append(stream.read(number())[:-1].decode())
        lengths.append(number())
    return Header(text, names, lengths, stream.tell())


def _tag_spans(raw: bytes, at: int) -> Iterator[tuple[str, str, int, int]]:
    """Name, type and place of each tag's value."""
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        low = at + 3
        if kind in "ZH":
            at = raw.index(b"\0", low) + 1
        elif kind == "B":
            at = low + 5 + struct.unpack_from("<i", raw, low + 1)[0] * _SIZES[chr(raw[low])]
        else:
            at = low + _SIZES[kind]
        yield name, kind, low, at


def _modifications(raw: bytes, at: int) -> tuple[str | None, str | None]:
    """The MM and ML tags as texts."""
    found = {}
    for name, kind, low, high in _tag_spans(raw, at):
        if name in ("MM", "Mm", "ML", "Ml"):
            if kind == "B":
                sub = chr(raw[low])
                values = struct.unpack_from(f"<{(high - low - 5) // _SIZES[sub]}{_CODES[sub]}", raw, low + 5)
                found[name.upper()] = sub + "".join(f",{v}" for v in values)
            else:
                found[name.upper()] = raw[low : high - 1].decode()
    return found.get("MM"), found.get("ML")


def _numbers(raw: bytes, wanted: list[str]) -> list[int | None]:
    """Integer tags by name."""
    found = {name: struct.unpack_from("<" + _CODES[kind], raw, low)[0] for name, kind, low, _ in _tag_spans(raw, _offset_of_tags(raw)) if name in wanted and kind in "cCsSiI"}
    return [found.get(name) for name in wanted]


def _offset_of_tags(raw: bytes) -> int:
    name_len, n_ops, length = raw[8], struct.unpack_from("<H", raw, 12)[0], struct.unpack_from("<i", raw, 16)[0]
    return 32 + name_len + 4 * n_ops + (length + 1) // 2 + length


def _span(raw: bytes) -> int:
    """Bases of the reference that a record covers."""
    n_ops = struct.unpack_from("<H", raw, 12)[0]
    return sum(x >> 4 for x in struct.unpack_from(f"<{n_ops}I", raw, 32 + raw[8]) if x & 15 in (0, 2, 3, 7, 8))


def decode(raw: bytes, names: list[str]) -> tuple:
    """A record, without its size, as the columns of ``SCHEMA``."""
    row = _decoded(raw, names)
    return (*row[:QUALS], None if row[QUALS] is None else row[QUALS].tolist(), *row[QUALS + 1 :])


def _decoded(raw: bytes, names: list[str]) -> tuple:
    """The same with the qualities as an array of bytes."""
    ref, pos, name_len, mapq, _, n_ops, flag, length = struct.unpack_from("<iiBBHHHi", raw)
    at = 32 + name_len
    ops = [(x >> 4, _OPS[x & 15]) for x in struct.unpack_from(f"<{n_ops}I", raw, at)]
    at += 4 * n_ops
    seq = _PAIRS[np.frombuffer(raw, np.uint8, (length + 1) // 2, at)].tobytes()[:length].decode() if length else "*"
    at += (length + 1) // 2
    quals = np.frombuffer(raw, np.uint8, length, at)
    span = sum(n for n, o in ops if o in "MDN=X")
    return (
        raw[32 : 31 + name_len].decode(), flag, names[ref] if ref >= 0 else None, pos, pos + span, mapq, "".join(f"{n}{o}" for n, o in ops) or "*", seq,
        None if not length or quals[0] == 255 else quals, not flag & 16, *_modifications(raw, at + length),
    )


def _list_array(quals: tuple[np.ndarray | None, ...]) -> pa.Array:
    """Arrays of bytes as a column of lists, without an object for each number."""
    sizes = np.fromiter((0 if q is None else len(q) for q in quals), np.int64, len(quals))
    there = [q for q in quals if q is not None]
    values = np.concatenate(there).astype(np.int32) if there else np.empty(0, np.int32)
    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values), mask=pa.array([q is None for q in quals]))


def _byte_arrays(column: pa.Array) -> list[np.ndarray | None]:
    """A column of lists of numbers up to 255 as arrays of bytes."""
    offsets, first = column.offsets.to_numpy(), column.offsets[0].as_py()
    values = column.values.slice(first, int(offsets[-1]) - first)
    # as numpy does for lists: no number is wrapped, no null becomes one
    values = values.cast(pa.uint8()).to_numpy(zero_copy_only=False) if not values.null_count else None
    if values is None:
        raise TypeError("a quality is null")
    return [values[a:b] if there else None for a, b, there in zip(offsets[:-1] - first, offsets[1:] - first, column.is_valid().to_pylist())]


def encode(row: dict, numbers: dict[str, int]) -> bytes:
    """A record, without its size, of decoded columns; mates are unknown."""
    name = (row["read_name"] or "*").encode() + b"\0"
    cigar = [(int(n), _OPS.index(o)) for n, o in _STEP.findall(row["cigar"] or "")]
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    codes = _NIBBLE[np.frombuffer(seq.encode() + b"=" * (len(seq) % 2), np.uint8)]
    quals = np.full(len(seq), 255, np.uint8) if row.get("quals") is None else np.asarray(row["quals"], np.uint8)
    ref = numbers.get(row["chrom"], -1)
    start = -1 if row["read_start"] is None else row["read_start"]
    span = sum(n for n, o in cigar if o in (0, 2, 3, 7, 8))
    fixed = struct.pack("<iiBBHHHiiii", ref, start, len(name), row["mapq"] or 0, bgzf.bin_of(max(start, 0), max(start, 0) + max(span, 1)) & 0xFFFF, len(cigar), row["flag"] or 0, len(seq), -1, -1, 0)
    tags = b""
    if row.get("mm") is not None:
        tags += b"MMZ" + row["mm"].encode() + b"\0"
    if row.get("ml") is not None:
        kind, *values = row["ml"].split(",")
        tags += b"MLB" + kind.encode() + struct.pack(f"<i{len(values)}{_CODES[kind]}", len(values), *map(int, values))
    ops = struct.pack(f"<{len(cigar)}I", *[n << 4 | o for n, o in cigar])
    return fixed + name + ops + (codes[::2] << 4 | codes[1::2]).tobytes() + quals.tobytes() + tags


def with_haplotype(raw: bytes, hp: int | None) -> bytes:
    """The record with HP:i as given, or without the tag."""
    at = _offset_of_tags(raw)
    kept = b"".join(raw[low - 3 : high] for name, _, low, high in _tag_spans(raw, at) if name != "HP")
    return raw[:at] + kept + (b"" if hp is None else b"HPi" + struct.pack("<i", hp))


# ------------------------------------------------------------- reading


@dataclass
class Piece(InputPartition):
    """Records that begin between two virtual offsets; ``search``: ``low`` is a mere place in the file."""

    path: str
    low: int
    high: int
    search: bool

    def __init__(self, path: str, low: int, high: int, search: bool):
        super().__init__((path, low, high, search))
        self.path, self.low, self.high, self.search = path, low, high, search


def _plausible(raw: bytes, at: int, lengths: list[int]) -> int:
    """Where the record at ``at`` ends, if it may be one; 0 if not, -1 if too little of it is here to say."""
    if at + 36 > len(raw):
        return -1
    size, ref, pos, name_len, _, _, n_ops, _, length, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", raw, at)
    fits = lambda r, p: r == -1 and p >= -1 or 0 <= r < len(lengths) and -1 <= p <= lengths[r]
    if not (name_len > 1 and length >= 0 and fits(ref, pos) and fits(mate, mate_pos) and size >= 32 + name_len + 4 * n_ops + (length + 1) // 2 + length):
        return 0
    name = raw[at + 36 : at + 36 + name_len]
    if len(name) < name_len:
        return -1
    return at + 4 + size if name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1]) else 0


def first_record(file: bgzf.File, low: int, end: int, lengths: list[int], chain: int = 8) -> int | None:
    """Virtual offset of the first record that begins in a block at or after ``low`` and before ``end``: the first place
    from which ``chain`` plausible records follow each other, or all up to the end of the file."""
    at = bgzf.next_block(file, low, end)
    while at is not None and at < end:
        stream = bgzf.Stream(file, at << 16)
        raw = stream.read(1)
        if not raw or stream._block >= end:
            return None
        block, own = stream._block, len(stream._data)
        after = stream._next
        raw += stream.read(own - 1)
        done = False
        for i in range(own):
            place, n = i, 0
            while n < chain:
                found = _plausible(raw, place, lengths)
                while found == -1 and not done:
                    more = stream.read(1 << 18)
                    done, raw = not more, raw + more
                    found = _plausible(raw, place, lengths)
                if found <= 0:
                    break
                place, n = found, n + 1
                if place > len(raw) and not done:  # skip what is between
                    more = stream.read(place - len(raw) + (1 << 16))
                    done, raw = len(more) < place - len(raw) + (1 << 16), raw + more
            if n == chain or n and done and place == len(raw):
                return block << 16 | i
        at = after
    return None


def _tag_names(options: dict) -> list[str]:
    return [t for t in options.get("tags", "").split(",") if t]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.raw = options["path"], str(options.get("raw", "")).lower() == "true"
        self.tags = _tag_names(options)
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.chrom: str | None = None
        self.start, self.end = 0, 1 << 60

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """The region; Spark evaluates all of them again."""
        for f in filters:
            column = getattr(f, "attribute", None)
            match f:
                case EqualTo() if column == ("chrom",):
                    self.chrom = f.value
                case GreaterThan() | GreaterThanOrEqual() if column == ("read_end",):
                    self.start = max(self.start, f.value - isinstance(f, GreaterThanOrEqual))
                case GreaterThan() | GreaterThanOrEqual() if column == ("read_start",):
                    self.start = max(self.start, f.value)
                case LessThan() | LessThanOrEqual() if column == ("read_start",):
                    self.end = min(self.end, f.value + isinstance(f, LessThanOrEqual))
            yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in bgzf.files(self.path, (".bam",)):
            header, index, size = read_header(path), bgzf.index_of(path), bgzf.File(path).size
            if index is None:
                out += [Piece(path, low, high, low != header.first) for low, high in bgzf.plain_ranges(header.first, size, self.split)]
                continue
            stretches = [(header.first, (size + 1) << 16)]
            if self.chrom is not None:
                known = self.chrom in header.names
                stretches = index.stretches(header.names.index(self.chrom), self.start, min(self.end, 1 << 31)) if known else []
            out += [Piece(path, low, high, False) for low, high in bgzf.indexed_ranges(stretches, index.starts(), self.split)]
        return out

    def records(self, piece: Piece, header: Header) -> Iterator[bytes]:
        """The piece's records in the region."""
        file, low = bgzf.File(piece.path), piece.low
        if piece.search:
            found = first_record(file, low >> 16, piece.high >> 16, header.lengths)
            if found is None:
                return
            low = found
        stream = bgzf.Stream(file, low)
        wanted = None if self.chrom is None else header.names.index(self.chrom) if self.chrom in header.names else -2
        while stream.tell() < piece.high and len(size := stream.read(4)) == 4:
            raw = stream.read(struct.unpack("<i", size)[0])
            if wanted is not None:
                ref, pos = struct.unpack_from("<ii", raw)
                if ref != wanted or pos >= self.end or (self.start > 0 and pos + max(_span(raw), 1) < self.start):
                    continue
            yield raw

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no piece of any file
            return
        header = read_header(partition.path)
        schema = pa.schema([
            ("read_name", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("read_start", pa.int64()), ("read_end", pa.int64()), ("mapq", pa.int32()),
            ("cigar", pa.string()), ("seq", pa.string()), ("quals", pa.list_(pa.int32())), ("is_forward", pa.bool_()), ("mm", pa.string()), ("ml", pa.string()),
            *[(t, pa.int64()) for t in self.tags], *([("record", pa.binary())] if self.raw else []),
        ])
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [_list_array(c) if k == QUALS else pa.array(c, f.type) for k, (c, f) in enumerate(zip(zip(*held), schema))]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for raw in self.records(partition, header):
            held.append((*_decoded(raw, header.names), *(_numbers(raw, self.tags) if self.tags else ()), *((raw,) if self.raw else ())))
            if len(held) == BATCH_RECORDS:
                yield batch()
                held = []
        if held:
            yield batch()


# ------------------------------------------------------------- writing


def _codec(header: Header) -> parts.Codec:
    numbers = {n: k for k, n in enumerate(header.names)}

    def records(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, int, int]]:
        used = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if "record" not in batch.schema.names or n in ("record", "hp")]
        columns = {n: _byte_arrays(c) if n == "quals" and pa.types.is_list(c.type) else c.to_pylist() for n, c in used}
        tagged = columns.get("hp")
        for k in range(len(batch)):
            raw = columns["record"][k] if "record" in columns else encode({n: c[k] for n, c in columns.items()}, numbers)
            if tagged is not None:
                raw = with_haplotype(raw, tagged[k])
            ref, pos = struct.unpack_from("<ii", raw)
            yield struct.pack("<i", len(raw)) + raw, ref, max(pos, 0), max(pos, 0) + max(_span(raw), 1)

    return parts.Codec(".bam", ".bai", header.encoded(), records, lambda index, _: index.bai(len(header.names)))


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA + "".join(f", `{t}` long" for t in _tag_names(self.options)) + (", record binary" if str(self.options.get("raw", "")).lower() == "true" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> parts.PartsWriter:
        single = str(self.options.get("single", "")).lower() == "true"
        return parts.PartsWriter(self.options["path"], overwrite, _codec(header_of_text(self.options.get("header", ""))), single)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def coordinate_order(df: DataFrame, header: Header) -> DataFrame:
    """Rows in the order of the header's references and of positions, in ranges; those on no reference last."""
    numbers = F.create_map(*[F.lit(v) for pair in zip(header.names, range(len(header.names))) for v in pair]) if header.names else None
    rank = F.coalesce(F.try_element_at(numbers, F.col("chrom")) if header.names else F.lit(None).cast("int"), F.lit(1 << 30))
    by = _free(df, "__rank")
    return df.withColumn(by, rank).orderBy(by, "read_start", "read_name", "flag").drop(by)


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
