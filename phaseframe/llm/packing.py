"""Packing of tokenised documents into fixed windows, best fit decreasing.

Documents longer than a window are first cut into full windows; what is left of
each document is placed, longest first, into the open window with the smallest
remaining capacity that still holds it. A segment tree over remaining
capacities finds that window in O(log window) steps.

Scale: packing is independent per *block* of at most ``block_pieces`` pieces of
one input partition, so there is no shuffle and memory is bounded by a block,
whatever the size of the table or of a source. A block closes with one partly
filled window on the whole, which for thousands of pieces is a small padding.

Defined results: a null or empty text is the end token alone; a repeated row is
packed again like any other; a null id stays null; an empty table gives no
rows; extra columns are ignored. Texts are never shortened.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.llm.common import slim_batches, tidy

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
)


class CapacityTree:
    """Open windows by remaining capacity, as the leaves of a segment tree."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.any = bytearray(2 * self.size)

    def add(self, capacity: int, window_no: int) -> None:
        self.open[capacity].append(window_no)
        node = self.size + capacity
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest window with capacity >= need, removed from the tree."""
        any_, node = self.any, self.size + need
        if not any_[node]:
            while True:  # up, until a subtree to the right holds a larger capacity
                if node == 1:
                    return None
                if not node & 1 and any_[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.size:
                node = 2 * node if any_[2 * node] else 2 * node + 1
        capacity = node - self.size
        window_no = self.open[capacity].pop()
        if not self.open[capacity]:
            any_[node] = 0
            node >>= 1
            while node and not (any_[2 * node] or any_[2 * node + 1]):
                any_[node] = 0
                node >>= 1
        return capacity, window_no


def best_fit_decreasing(lengths: Iterable[int], window: int) -> tuple[list[int], list[int], int]:
    """Window number and offset of each piece, and how many windows there are.

    ``lengths`` come in decreasing order and are at most ``window``.
    """
    tree, where, offsets, used = CapacityTree(window), [], [], 0
    for n in lengths:
        found = tree.take(n)
        if found is None:
            capacity, no = window, used
            used += 1
        else:
            capacity, no = found
        where.append(no)
        offsets.append(window - capacity)
        if capacity > n:
            tree.add(capacity - n, no)
    return where, offsets, used


class WordTokenizer:
    """Token ids of whole texts, with a cache of pre-tokens.

    The vocabulary's rules work on one pre-token at a time, so ids of a text are
    the ids of its pre-tokens in a row. For texts in plain Latin letters the
    pre-tokens are cut out of a slice of texts at once, named by their lower-case
    letters, up to eight, or a 64-bit hash of them, and each distinct one is encoded
    once. Letters of longer ones are compared with those that have the name; what
    differs has a number of its own. Any other text (other scripts, combining marks, control characters, special
    tokens) is encoded whole by the library. Both give the same ids.
    """

    #: More pre-tokens than this empty the cache.
    LIMIT = 400_000
    CHARS = 1 << 19

    _OTHER = re.compile("[^\\t\\n\\r -~¡-ÿ]|<\\|")
    _SUFFIXES = (b"re", b"ve", b"ll", b"s", b"t", b"m", b"d")
    _SPACE, _LETTER, _NUMBER, _MARK = range(4)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        suffix = self.whole.model.end_of_word_suffix
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        latin = [chr(c) for c in range(256)]
        self.kind = np.array(
            [
                self._SPACE if c in "\t\n\r " else self._LETTER if c.isalpha() else self._NUMBER if c.isnumeric() else self._MARK
                for c in latin
            ],
            np.uint8,
        )
        self.lower = np.array([ord(c.lower()) for c in latin], np.uint8)
        self.code = np.array([int.from_bytes(hashlib.blake2b(bytes([c]), digest_size=8).digest(), "little") for c in range(256)], np.uint64)
        self.base = 0x9E3779B97F4A7C15
        self.power = self.inverse = np.empty(0, np.uint64)
        self._reset()

    def _reset(self) -> None:
        self.slots = np.zeros(4 * self.LIMIT, np.uint64)  # hash of the pre-token, 0: free
        self.number = np.zeros(4 * self.LIMIT, np.int32)
        self.known = 0
        self.flat = np.empty(0, np.int32)
        self.begin = np.zeros(1, np.int64)
        self.letters = np.empty(0, np.uint8)
        self.letter_begin = np.zeros(1, np.int64)
        self.unnamed: dict[bytes, int] = {}  # pre-tokens whose name another one has

    def _find(self, names: np.ndarray) -> np.ndarray:
        """Numbers of the pre-tokens with these hashes; -1 for new ones."""
        out = np.full(len(names), -1, np.int64)
        left = np.arange(len(names))
        slot = names % np.uint64(len(self.slots))
        while len(left):
            there = self.slots[slot]
            hit = there == names[left]
            out[left[hit]] = self.number[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) % np.uint64(len(self.slots))
        return out

    def _keep(self, words: list[str]) -> None:
        """Encodes new pre-tokens in one call; the end-of-word mark tells them apart."""
        ids = np.asarray(self.whole.encode(" ".join(words), add_special_tokens=False).ids, np.int32)
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(words):
            raise ValueError("pre-tokens and end-of-word marks differ")
        self.begin = np.concatenate([self.begin, self.begin[-1] + stop])
        self.flat = np.concatenate([self.flat, ids])
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.letter_begin = np.concatenate([self.letter_begin, self.letter_begin[-1] + np.cumsum(sizes)])
        self.letters = np.concatenate([self.letters, np.frombuffer("".join(words).encode("latin-1"), np.uint8)])
        self.known += len(words)

    def _learn(self, names: np.ndarray, words: list[str]) -> None:
        number, left = np.arange(self.known, self.known + len(words)), np.arange(len(words))
        self._keep(words)
        slot = names % np.uint64(len(self.slots))
        while len(left):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = names[left[free]]
            won = self.slots[slot] == names[left]
            self.number[slot[won]] = number[left[won]]
            left, slot = left[~won], (slot[~won] + np.uint64(1)) % np.uint64(len(self.slots))

    def _names(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Names of pre-tokens: a bijection of up to eight letters, a hash of more."""
        size = stop - start
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))[start].astype(np.uint64)
        short = size < 8
        eight[short] &= (np.uint64(1) << (size[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        long = np.flatnonzero(size > 8)
        if len(long):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(self.code[raw] * self.power[: len(raw)])])
            a, b = start[long], stop[long]
            eight[long] = (sums[b] - sums[a]) * self.inverse[a] + size[long].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        names = (eight ^ (eight >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.maximum(names ^ (names >> np.uint64(29)), np.uint64(1))

    def _misnamed(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Pre-tokens whose letters aren't those of the one found by their name."""
        size, first = stop - start, self.letter_begin[found]
        wrong = self.letter_begin[found + 1] - first != size
        long = np.flatnonzero((size > 8) & ~wrong)  # shorter ones of one length have one name if they are equal, and only then
        if len(long):
            n = size[long]
            before = np.cumsum(n) - n
            step = np.arange(int(n.sum()))
            apart = raw[step + np.repeat(start[long] - before, n)] != self.letters[step + np.repeat(first[long] - before, n)]
            wrong[long] = np.logical_or.reduceat(apart, before)
        return np.flatnonzero(wrong)

    def _pre_tokens(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one positions of the pre-tokens of lower-case bytes."""
        kind = self.kind[raw]
        before = np.concatenate([[self._SPACE], kind[:-1]])
        first = (kind != self._SPACE) & ((kind != before) | (kind == self._NUMBER))
        quotes = np.flatnonzero(first[:-1] & (raw[:-1] == 39) & (kind[1:] == self._LETTER))
        for q in quotes.tolist():  # a quote that opens a run takes a suffix such as 's with it
            ahead = raw[q + 1 : q + 3].tobytes()
            size = next((len(x) for x in self._SUFFIXES if ahead.startswith(x)), 0)
            if size:
                first[q + 1] = False
                after = q + 1 + size
                if after < len(raw) and kind[after] == self._LETTER:
                    first[after] = True
        start = np.flatnonzero(first)
        # a pre-token ends at the next one or at white space
        gap = np.flatnonzero((kind == self._SPACE) & (before != self._SPACE))
        stop = np.append(start[1:], len(raw))
        at = np.searchsorted(gap, start)
        stop = np.minimum(stop, np.append(gap, len(raw))[at])
        return start, stop

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        raw = self.lower[np.frombuffer((" ".join(texts) + " ").encode("latin-1"), np.uint8)]
        if len(raw) > len(self.power):
            n = max(len(raw), self.CHARS + (1 << 16))
            self.power = np.cumprod(np.full(n, self.base, np.uint64))
            self.inverse = np.cumprod(np.full(n, pow(self.base, -1, 1 << 64), np.uint64))
        start, stop = self._pre_tokens(raw)
        if not len(start):
            return [np.empty(0, np.int32) for _ in texts]
        names = self._names(raw, start, stop)
        found = self._find(names)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh, where = np.unique(names[new], return_index=True)
            if self.known + len(fresh) > self.LIMIT:
                self._reset()
                fresh, where = np.unique(names, return_index=True)
                new = np.arange(len(names))
            data, at = raw.tobytes(), new[where]
            self._learn(fresh, [data[i:j].decode("latin-1") for i, j in zip(start[at].tolist(), stop[at].tolist())])
            found[new] = self._find(names[new])
        for i in self._misnamed(raw, start, stop, found).tolist():
            word = raw[start[i] : stop[i]].tobytes()
            if word not in self.unnamed:
                self.unnamed[word] = self.known
                self._keep([word.decode("latin-1")])
            found[i] = self.unnamed[word]
        first, n = self.begin[found], self.begin[found + 1] - self.begin[found]
        total = np.cumsum(n)
        ids = self.flat[np.arange(total[-1]) + np.repeat(first - (total - n), n)]
        done = np.concatenate([[0], total])[np.searchsorted(start, np.cumsum(lens))]
        return np.split(ids, done[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        other = [i for i, t in enumerate(texts) if self._OTHER.search(t)]
        if other:
            for i, e in zip(other, self.whole.encode_batch([texts[i] for i in other], add_special_tokens=False)):
                out[i] = np.asarray(e.ids, np.int32)
        part, size = [], 0
        for i in [i for i in range(len(texts)) if out[i] is None] + [None]:
            if part and (i is None or size + len(texts[i]) > self.CHARS):
                for k, ids in zip(part, self._slice([texts[k] for k in part])):
                    out[k] = ids
                part, size = [], 0
            if i is not None:
                part.append(i)
                size += len(texts[i])
        return out


def _packer(tokenizer_path: str, window: int, end_id: int, block_pieces: int, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        tok = WordTokenizer(tokenizer_path)
        next_id = TaskContext.get().partitionId() << 40
        rest: list[tuple] = []

        def frame(rows: list[tuple]) -> pd.DataFrame:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            return out if with_ids else out.drop(columns="ids")

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal next_id, rest
            if not rest:
                return
            rest.sort(key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1], r[3]))
            where, offsets, used = best_fit_decreasing([r[2] for r in rest], window)
            placed = [(*r[:5], next_id + w, o, r[5]) for r, w, o in zip(rest, where, offsets)]
            for lo in range(0, used and len(placed), 1024):
                yield frame(placed[lo : lo + 1024])
            next_id += used
            rest = []

        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                texts = ["" if t is None else t for t in part["text"]]
                full = []
                for doc, ids in zip(part["doc_id"], tok.encode(texts)):
                    doc = None if pd.isna(doc) else int(doc)
                    ids = np.append(ids, np.int32(end_id)).astype("<u4")
                    total = len(ids)
                    for start in range(0, total, window):
                        piece = ids[start : start + window]
                        kept = piece.astype(np.int32) if with_ids else None
                        row = (doc, start, len(piece), zlib.crc32(piece.tobytes()), total)
                        if len(piece) == window:
                            full.append((*row, next_id, 0, kept))
                            next_id += 1
                        else:
                            rest.append((*row, kept))
                if full:
                    yield frame(full)
                if len(rest) >= block_pieces:
                    yield from flush()
        yield from flush()

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    block_pieces: int = 16_384,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: where it stands in its document and in its sequence.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, ``with_ids``, the token ids. ``sequence_id`` carries the input partition
    in its upper bits, so it is unique without any exchange. ``block_pieces``
    bounds the pieces held at once; with ids, memory is at most that many times
    the window.
    """
    schema = PIECES if with_ids else PIECES.removesuffix(", ids array<int>")
    rows = slim_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(tidy(_packer(tokenizer_path, window, end_id, block_pieces, with_ids)), schema)
