"""Writing of blocked gzip files by tasks: each writes a part with its header and index, and either the
parts stay, a folder of complete files, or the commit strings their blocks together to one file with one index.

Rows have to come in order for an index; of rows out of order none is made.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from phaseframe.sources import bgzf

#: Bytes that are copied at once.
COPIED = 16 << 20


@dataclass
class Codec:
    """How a kind of file is written. ``encode`` gives, for a batch, records with their reference (number or name; None
    for none), start and end; ``index`` the bytes of an index over references in order of appearance or of the header."""

    suffix: str
    index_suffix: str
    header: bytes
    encode: Callable[[pa.RecordBatch], Iterator[tuple[bytes, int | str | None, int, int]]]
    index: Callable[[bgzf.Index, list[str]], bytes]


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    begins: int
    ends: int
    index: bgzf.Index
    names: list[str]


def _squeezed(data: bytes) -> bytes:
    sink = io.BytesIO()
    writer = bgzf.Writer(sink)
    writer.write(data)
    writer.flush()
    return sink.getvalue() + bgzf.EOF_BLOCK


class PartsWriter(DataSourceArrowWriter):
    """``single``: one file under ``path``, else a folder of files."""

    def __init__(self, path: str, overwrite: bool, codec: Codec, single: bool):
        self.path, self.overwrite, self.codec, self.single = path.rstrip("/"), overwrite, codec, single
        self.folder = f"{self.path}-parts-{uuid.uuid4().hex}" if single else self.path
        system, place = bgzf.resolve(self.path)
        there = system.get_file_info(place).type
        if there != fs.FileType.NotFound and not overwrite and (single or there == fs.FileType.File):
            raise FileExistsError(self.path)
        self.stale = [f for f in bgzf.files(self.path, (codec.suffix, codec.index_suffix))] if overwrite and there == fs.FileType.Directory else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        number = TaskContext.get().partitionId()
        path = f"{self.folder}/part-{number:05d}-{uuid.uuid4().hex}{self.codec.suffix}"
        system, place = bgzf.resolve(path)
        system.create_dir(bgzf.resolve(self.folder)[1], recursive=True)
        index, names = bgzf.Index(), {}
        with system.open_output_stream(place, compression=None) as sink:
            writer = bgzf.Writer(sink)
            writer.write(self.codec.header)
            writer.flush()
            begins = writer.written
            for batch in iterator:
                for record, ref, start, end in self.codec.encode(batch):
                    at = writer.tell() if len(record) <= bgzf.BLOCK - (writer.tell() & 0xFFFF) or not writer.tell() & 0xFFFF else None
                    if at is None:
                        writer.flush()
                        at = writer.tell()
                    writer.write(record)
                    index.add(-1 if ref is None else ref if isinstance(ref, int) else names.setdefault(ref, len(names)), start, end, at, writer.tell())
            writer.flush()
            sink.write(bgzf.EOF_BLOCK)
        if not self.single and index.sorted:
            with system.open_output_stream(place + self.codec.index_suffix, compression=None) as sink:
                sink.write(self.codec.index(index, list(names)))
        return Part(number, path, begins, writer.written, index, list(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        if not self.single:
            kept = {bgzf.resolve(p.path)[1] for p in parts}
            for path in self.stale:
                system, place = bgzf.resolve(path)
                if place not in kept:
                    system.delete_file(place)
            return
        system, place = bgzf.resolve(self.path)
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)
        whole, names = bgzf.Index(), {}
        with system.open_output_stream(place, compression=None) as sink:
            header = bgzf.Writer(sink)
            header.write(self.codec.header)
            header.flush()
            at = header.written
            for part in parts:
                own, source = bgzf.resolve(part.path)
                with own.open_input_file(source) as f:
                    for low in range(part.begins, part.ends, COPIED):
                        sink.write(f.read_at(min(COPIED, part.ends - low), low))
                index = part.index
                if part.names:  # numbers of this file for those of the part
                    numbers = [names.setdefault(n, len(names)) for n in part.names]
                    order = sorted(range(len(numbers)), key=numbers.__getitem__)
                    bins, least = [{} for _ in names], [{} for _ in names]
                    for k in order:
                        bins[numbers[k]], least[numbers[k]] = index.bins[k], index.least[k]
                    at_number = lambda p: p if p is None or p[0] >= 1 << 31 else (numbers[p[0]], p[1])  # noqa: E731, B023
                    index = bgzf.Index(bins, least, sorted=index.sorted and order == list(range(len(order))), first=at_number(index.first), _last=at_number(index._last))
                whole.extend(index, at - part.begins)
                at += part.ends - part.begins
            sink.write(bgzf.EOF_BLOCK)
        if whole.sorted:
            with system.open_output_stream(place + self.codec.index_suffix, compression=None) as sink:
                sink.write(self.codec.index(whole, list(names)))
        system.delete_dir(bgzf.resolve(self.folder)[1])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.single:
            system, place = bgzf.resolve(self.folder)
            if system.get_file_info(place).type == fs.FileType.Directory:
                system.delete_dir(place)
            return
        for part in messages:
            if part is not None:
                system, place = bgzf.resolve(part.path)
                system.delete_file(place)


def compressed_index(data: bytes) -> bytes:
    return _squeezed(data)
