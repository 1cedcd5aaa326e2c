"""Blocked gzip files: gzip members of at most 64 KB, each with its own size in an extra field.

A virtual offset is the file offset of a block, shifted by 16 bits, plus a place in
its inflated bytes; it is where a reader can start. An index names, for bins of
positions that halve in size by eight, the stretches of virtual offsets that hold
their records, and for every 16 kb the first record that reaches into them.

Paths are opened by pyarrow's file systems: local, ``file:``, ``hdfs:``, ``s3:``, ``gs:``.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs

#: Fixed values of the format: the empty last block, the inflated size that blocks are cut at, the finest bins and the levels above them.
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 0xFF00
MIN_SHIFT, DEPTH = 14, 5
#: Bytes of a file that are fetched at once.
WINDOW = 1 << 20


# ------------------------------------------------------------- files


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def files(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The file, the files of the folder that end so, or those that match a pattern in the last part of the path."""
    system, place = resolve(path)
    folder, last = posixpath.split(place)
    if any(c in last for c in "*?["):
        found = [i.path for i in system.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(posixpath.basename(i.path), last)]
    elif system.get_file_info(place).type == fs.FileType.Directory:
        found = [i.path for i in system.get_file_info(fs.FileSelector(place)) if i.path.endswith(suffixes)]
    else:
        return [path]
    return sorted(path[: len(path) - len(place)] + f if path.endswith(place) else f for f in found)


class File:
    """Random access to a file through a window of it."""

    def __init__(self, path: str):
        system, place = resolve(path)
        self._file = system.open_input_file(place)
        self.size, self._at, self._window = self._file.size(), 0, b""

    def read_at(self, at: int, n: int) -> bytes:
        low = at - self._at
        if low < 0 or low + n > len(self._window):
            self._at, self._window, low = at, self._file.read_at(max(n, WINDOW), at), 0
        return self._window[low : low + n]


def exists(path: str) -> bool:
    system, place = resolve(path)
    return system.get_file_info(place).type == fs.FileType.File


def read_file(path: str) -> bytes:
    system, place = resolve(path)
    with system.open_input_file(place) as f:
        return f.read()


# ------------------------------------------------------------- blocks


def block_size(head: bytes) -> int:
    """The size of the block that begins so; 0 where none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    extra, at = struct.unpack("<H", head[10:12])[0], 12
    while at + 4 <= min(12 + extra, len(head)):
        length = struct.unpack("<H", head[at + 2 : at + 4])[0]
        if head[at : at + 2] == b"BC" and length == 2 and at + 6 <= len(head):
            return struct.unpack("<H", head[at + 4 : at + 6])[0] + 1
        at += 4 + length
    return 0


def inflate(block: bytes) -> bytes:
    extra = struct.unpack("<H", block[10:12])[0]
    data = zlib.decompress(block[12 + extra : -8], -15)
    if struct.unpack("<II", block[-8:]) != (zlib.crc32(data), len(data)):
        raise ValueError("a block is damaged")
    return data


def next_block(file: File, at: int, end: int) -> int | None:
    """Where the first block at or after ``at``, and before ``end``, begins: a header whose size leads to another one or to the end of the file."""
    while at < min(end, file.size):
        piece = file.read_at(at, min(1 << 17, file.size - at))
        low = piece.find(b"\x1f\x8b\x08\x04")
        while low >= 0 and at + low < end:
            size = block_size(piece[low : low + 512] if low + 512 <= len(piece) else file.read_at(at + low, 512))
            after = at + low + size
            if size and (after == file.size or block_size(file.read_at(after, 512))):
                return at + low
            low = piece.find(b"\x1f\x8b\x08\x04", low + 1)
        at += max(len(piece) - 3, 1)
    return None


class Stream:
    """Inflated bytes from a virtual offset on."""

    def __init__(self, file: File, start: int = 0):
        self.file, self._next = file, start >> 16
        self._block, self._data, self._i = start >> 16, b"", 0
        if start & 0xFFFF:
            self._load()
            self._i = start & 0xFFFF

    def _load(self) -> bool:
        """The next block that isn't empty."""
        while self._next < self.file.size:
            size = block_size(self.file.read_at(self._next, 512))
            if not size:
                raise ValueError(f"no block at {self._next}")
            self._block = self._next
            self._data, self._i = inflate(self.file.read_at(self._next, size)), 0
            self._next += size
            if self._data:
                return True
        self._block, self._data, self._i = self._next, b"", 0
        return False

    def tell(self) -> int:
        """The virtual offset of the next byte."""
        return self._block << 16 | self._i if self._i < len(self._data) else self._next << 16

    def read(self, n: int) -> bytes:
        """``n`` bytes, fewer at the end."""
        out = self._data[self._i : self._i + n]
        self._i += len(out)
        if len(out) == n:
            return out
        parts, left = [out], n - len(out)
        while left and self._load():
            parts.append(self._data[:left])
            self._i = len(parts[-1])
            left -= self._i
        return b"".join(parts)

    def line(self) -> bytes:
        """The next line without its end; empty at the end of the file (``tell`` tells)."""
        parts = []
        while True:
            end = self._data.find(b"\n", self._i)
            if end >= 0:
                parts.append(self._data[self._i : end])
                self._i = end + 1
                return b"".join(parts)
            parts.append(self._data[self._i :])
            if not self._load():
                return b"".join(parts)


class Writer:
    """Blocks written to an open sink. A record begins a new block where it doesn't fit into the present one."""

    def __init__(self, sink, level: int = 6):
        self._sink, self._level, self._held = sink, level, bytearray()
        self.written = 0

    def tell(self) -> int:
        return self.written << 16 | len(self._held)

    def write(self, record: bytes) -> None:
        if self._held and len(self._held) + len(record) > BLOCK:
            self.flush()
        self._held += record
        while len(self._held) > BLOCK:
            self._put(bytes(self._held[:BLOCK]))
            del self._held[:BLOCK]

    def flush(self) -> None:
        if self._held:
            self._put(bytes(self._held))
            self._held.clear()

    def _put(self, data: bytes) -> None:
        squeeze = zlib.compressobj(self._level, zlib.DEFLATED, -15)
        body = squeeze.compress(data) + squeeze.flush()
        head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
        self._sink.write(head + body + struct.pack("<II", zlib.crc32(data), len(data)))
        self.written += len(body) + 26


# ------------------------------------------------------------- indices


def _first_bin(level: int) -> int:
    return ((1 << 3 * level) - 1) // 7


def bin_of(start: int, end: int, min_shift: int = MIN_SHIFT, depth: int = DEPTH) -> int:
    """The smallest bin that holds [start, end)."""
    last = max(end - 1, start)
    for level in range(depth, 0, -1):
        shift = min_shift + 3 * (depth - level)
        if start >> shift == last >> shift:
            return _first_bin(level) + (start >> shift)
    return 0


@dataclass
class Index:
    """Per reference: bins with their stretches (first, end) of virtual offsets, and the least offset by window of 16 kb."""

    bins: list[dict[int, list[tuple[int, int]]]] = field(default_factory=list)
    least: list[dict[int, int]] = field(default_factory=list)
    min_shift: int = MIN_SHIFT
    depth: int = DEPTH
    names: list[str] = field(default_factory=list)
    sorted: bool = True
    _last: tuple[int, int] | None = None
    first: tuple[int, int] | None = None

    def _grow(self, ref: int) -> None:
        while len(self.bins) <= ref:
            self.bins.append({})
            self.least.append({})

    def add(self, ref: int, start: int, end: int, begins: int, ends: int) -> None:
        """A record on [start, end) of a reference (below 0: on none), between two virtual offsets."""
        place = (ref if ref >= 0 else 1 << 31, start)
        self.first = self.first or place
        if self._last is not None and place < self._last:
            self.sorted = False
        self._last = place
        if ref < 0:
            return
        self._grow(ref)
        stretches = self.bins[ref].setdefault(bin_of(start, end), [])
        if stretches and stretches[-1][1] >> 16 == begins >> 16:
            stretches[-1] = (stretches[-1][0], ends)
        else:
            stretches.append((begins, ends))
        for window in range(start >> MIN_SHIFT, (max(end - 1, start) >> MIN_SHIFT) + 1):
            self.least[ref].setdefault(window, begins)

    def extend(self, other: Index, by: int) -> None:
        """The index of a part that begins ``by`` bytes later than it counts from, behind this one's."""
        if other.first is not None:
            self.sorted &= other.sorted and (self._last is None or self._last <= other.first)
            self.first, self._last = self.first or other.first, other._last
        shift = by << 16
        for ref, bins in enumerate(other.bins):
            self._grow(ref)
            for number, stretches in bins.items():
                self.bins[ref].setdefault(number, []).extend((a + shift, b + shift) for a, b in stretches)
            for window, at in other.least[ref].items():
                self.least[ref].setdefault(window, at + shift)

    def stretches(self, ref: int, start: int, end: int) -> list[tuple[int, int]]:
        """Merged stretches that hold all records touching [start, end)."""
        if ref >= len(self.bins):
            return []
        windows = sorted(self.least[ref])
        at = bisect_left(windows, (start >> MIN_SHIFT) + 1)
        floor = self.least[ref][windows[at - 1]] if at else 0
        found = []
        for level in range(self.depth + 1):
            shift = self.min_shift + 3 * (self.depth - level)
            low, high = start >> shift, (max(end, start + 1) - 1) >> shift
            for number in [b for b in self.bins[ref] if _first_bin(level) + low <= b <= min(_first_bin(level) + high, _first_bin(level + 1) - 1)]:
                found += [(max(a, floor), b) for a, b in self.bins[ref][number] if b > floor]
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out

    def starts(self) -> list[int]:
        """Virtual offsets at which records are known to begin."""
        found = {a for bins in self.bins for stretches in bins.values() for a, _ in stretches}
        return sorted(found | {at for least in self.least for at in least.values() if at})

    def _body(self) -> bytes:
        out = []
        for bins, least in zip(self.bins, self.least):
            out.append(struct.pack("<i", len(bins)))
            for number, stretches in sorted(bins.items()):
                out.append(struct.pack(f"<Ii{2 * len(stretches)}Q", number, len(stretches), *[v for s in stretches for v in s]))
            filled, last = [], 0
            for window in range(max(least, default=-1) + 1):
                last = least.get(window, last)
                filled.append(last)
            out.append(struct.pack(f"<i{len(filled)}Q", len(filled), *filled))
        return b"".join(out)

    def bai(self, references: int) -> bytes:
        self._grow(references - 1)
        return b"BAI\1" + struct.pack("<i", references) + self._body()

    def tbi(self, names: list[str], form: int, columns: tuple[int, int, int], meta: str = "#") -> bytes:
        """The inflated index of a text: ``form`` 2 is VCF; columns of name, start and end count from 1."""
        self._grow(len(names) - 1)
        listed = b"".join(n.encode() + b"\0" for n in names)
        return b"TBI\1" + struct.pack("<8i", len(names), form, *columns, ord(meta), 0, len(listed)) + listed + self._body()


def parse_index(data: bytes) -> Index:
    """A BAI, TBI or CSI file; the latter two may be compressed."""
    if data[:2] == b"\x1f\x8b":
        parts, at = [], 0
        while at < len(data):
            size = block_size(data[at : at + 512])
            parts.append(inflate(data[at : at + size]))
            at += size
        data = b"".join(parts)
    kind, at, index = data[:4], 4, Index()
    take = lambda form: struct.unpack_from("<" + form, data, at)

    def names_of(listed: bytes) -> list[str]:
        return [n.decode() for n in listed.split(b"\0")[:-1]]

    if kind == b"CSI\1":
        index.min_shift, index.depth, extra = take("3i")
        if extra >= 28:
            index.names = names_of(data[at + 12 + 28 : at + 12 + extra])
        at += 12 + extra
        (references,) = take("i")
        at += 4
    elif kind == b"TBI\1":
        references, *_, listed = take("8i")
        index.names = names_of(data[at + 32 : at + 32 + listed])
        at += 32 + listed
    elif kind == b"BAI\1":
        (references,) = take("i")
        at += 4
    else:
        raise ValueError("neither BAI, TBI nor CSI")
    most = _first_bin(index.depth + 1)
    for ref in range(references):
        index._grow(ref)
        (bins,) = take("i")
        at += 4
        for _ in range(bins):
            number, loffset, n = take("IQi") if kind == b"CSI\1" else (take("I")[0], 0, take("Ii")[1])
            at += 16 if kind == b"CSI\1" else 8
            offsets = take(f"{2 * n}Q")
            at += 16 * n
            if number < most:  # others hold counts
                index.bins[ref][number] = list(zip(offsets[::2], offsets[1::2]))
        if kind != b"CSI\1":
            (windows,) = take("i")
            index.least[ref] = {w: v for w, v in enumerate(struct.unpack_from(f"<{windows}Q", data, at + 4)) if v}
            at += 4 + 8 * windows
    return index


def index_of(path: str) -> Index | None:
    """The index beside a file, if there is one."""
    for name in (path + ".bai", path[:-4] + ".bai", path + ".tbi", path + ".csi"):
        if exists(name):
            return parse_index(read_file(name))
    return None


# ------------------------------------------------------------- ranges of a file as tasks


def indexed_ranges(stretches: list[tuple[int, int]], starts: list[int], split: int) -> Iterator[tuple[int, int]]:
    """The stretches cut at known starts of records, into pieces of about ``split`` compressed bytes."""
    for low, high in stretches:
        at = low
        for start in starts[bisect_left(starts, low) :]:
            if start >= high:
                break
            if (start >> 16) - (at >> 16) >= split:
                yield at, start
                at = start
        yield at, high


def plain_ranges(first: int, size: int, split: int) -> Iterator[tuple[int, int]]:
    """Pieces of a file without index; a task looks for the first record of its piece. ``first`` is the offset of the first record."""
    borders = [first, *[b << 16 for b in range(split, size, split) if b << 16 > first], (size + 1) << 16]
    yield from zip(borders[:-1], borders[1:])
