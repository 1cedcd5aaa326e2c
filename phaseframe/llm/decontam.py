"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens in which numbers, units after a number and
names (words inside a sentence of which only the first letter is a capital) are typed placeholders; their values
are slots. Words that may be names or not, a capital word that opens a sentence and one all in capitals,
are read both ways: windows that hold such words stand once with the words themselves and once with names in their place.
Windows of ``window`` tokens are hashed; windows of documents are
joined by hash with those of benchmark items. Matches of a document and an item
on one diagonal (document position less item position) are one alignment. It is
contamination if it has ``min_windows`` windows (or all but one of a shorter
item's: its first word may look like a name inside another sentence) and its slots are consistent: equal item values always stand against equal document
values. With equal slots throughout it is 'verbatim', else 'reparameterised': the
same question with other numbers, names or units.

Windows need ``min_literal`` tokens that are not placeholders. Items shorter
than a window are matched whole, at their own length. Items with fewer than
``min_literal`` literal tokens can't be told from ordinary text: they are found
where they are a whole text, with equal slots.

Scale: only benchmark windows are gathered, into a bitmap of at most 2**28 bits
whatever the benchmark's size; document windows outside it never leave their
task, the rest are joined by hash in full. A passage in a third of all documents
gives that many short rows, grouped per document.

Defined results: null or empty texts contain nothing; rows of the same id and text
count as one; rows that share an id, or have none, with other texts are documents of their own and give a result row each,
and so are rows of the benchmark; documents without contamination give no row; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.llm.common import Scratch, slim_batches, tidy

WINDOW, MIN_LITERAL, MIN_WINDOWS = 10, 5, 4
MAX_BITS = 1 << 28

#: Words and signs that are units when they follow a number.
UNITS = frozenset(
    "% ° $ € £ mm cm m km in ft yd mi mg g kg t lb oz ml l s sec second seconds min minute minutes h hr hour hours day"
    " days week weeks month months year years mph kmh percent degrees dollar dollars cent cents euro euros pound pounds"
    " meter meters metre metres mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres"
    " cm2 m2 km2 w kw kwh v a hz khz mhz ghz kb mb gb tb".split()
)
_U = np.uint64
_LITERAL, _NUMBER, _CAPITAL, _NOTHING, _CAPITALS = range(5)
_CORE_HEAD, _CORE_TAIL = re.compile(r"[^\w$€£%°+-]*"), re.compile(r"[^\w$€£%°]+$")
_IS_NUMBER = re.compile(r"[+\-$€£]?\d[\d.,:/]*%?")
_PLACEHOLDERS = {"num": 1, "unit": 2, "name": 3}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Codes of the placeholders, by type.
_TYPED = mix(np.arange(4, dtype=_U))


_SPACE, _WORD, _DIGIT, _ALPHA, _UPPER, _LOWER, _SIGN, _END = (1 << k for k in range(8))
_BASE = 0x9E3779B97F4A7C15
_power = _inverse = np.ones(1, _U)


@functools.lru_cache(1 << 17)
def _char(code: int) -> tuple[int, int]:
    """Class bits of a code point, and its lower-case one."""
    c = chr(code)
    bits = _SPACE * c.isspace() | _DIGIT * c.isdecimal() | _ALPHA * c.isalpha() | _WORD * (c.isalnum() or c == "_")
    bits |= _UPPER * (c.isupper() or c.istitle()) | _LOWER * c.islower() | _SIGN * (c in ",.;:!?") | _END * (c in ".!?:")
    return bits, ord(c.lower()) if len(c.lower()) == 1 else code


#: Classes and lower case of the first code points; those of others are looked up as they come.
_BITS, _FOLD = (np.array(x) for x in zip(*map(_char, range(0x3000))))
_BITS, _FOLD = _BITS.astype(np.uint8), _FOLD.astype(np.uint32)


def _chars(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = np.minimum(codes, len(_BITS) - 1)
    bits, fold = _BITS[near], _FOLD[near]
    far = np.flatnonzero(codes >= len(_BITS))
    if len(far):
        own, at = np.unique(codes[far], return_inverse=True)
        known = np.array([_char(int(c)) for c in own], np.int64)[at]
        bits[far], fold[far] = known[:, 0], known[:, 1]
    return bits, fold


def _letter(fold: np.ndarray) -> np.ndarray:
    """A 64-bit code of lower-case code points."""
    x = fold.astype(_U) * _U(0xD6E8FEB86659FD93)
    return (x ^ (x >> _U(32))) * _U(0xBF58476D1CE4E5B9)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    global _power, _inverse
    if n > len(_power):
        size = max(n, 1 << 19)
        _power = np.cumprod(np.full(size, _BASE, _U))
        _inverse = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), _U))
    return _power, _inverse


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def word_code(core: str) -> int:
    """Code of a word without its signs: a polynomial in its lower-case letters."""
    letters = _letter(_chars(_codes(core))[1])
    power, inverse = _powers(len(letters))
    return int(mix((letters * power[: len(letters)]).sum(dtype=_U)[None] * inverse[:1] + _U(len(letters)))[0])


_UNIT_CODES = np.sort(np.array([word_code(u) for u in UNITS], _U))


class Canonical:
    """The words of a slice of texts, cut and classed in whole arrays.

    A word ends at white space and between a digit and a letter. Words of letters,
    or letters before one sign, are classed by counts of character classes; each other
    one (digits, signs inside or around) by its string, once while it is remembered.
    """

    LIMIT = 300_000

    def __init__(self):
        self.odd: dict[str, tuple[int, bool, int, int]] = {}

    def _classed(self, word: str) -> tuple[int, bool, int, int]:
        """Kind, whether it ends a sentence, and where its core begins and ends."""
        if (found := self.odd.get(word)) is None:
            if len(self.odd) >= self.LIMIT:
                self.odd = {}
            head = _CORE_HEAD.match(word).end()
            core = _CORE_TAIL.sub("", word[head:])
            if not core:
                kind = _NOTHING
            elif _IS_NUMBER.fullmatch(core):
                kind = _NUMBER
            elif core[0].isupper() and core[1:].islower():  # not shouting, not an initial
                kind = _CAPITAL
            elif len(core) > 1 and core.isalpha() and core.isupper():
                kind = _CAPITALS
            else:
                kind = _LITERAL
            ends = word.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":")
            found = self.odd[word] = (kind, ends, head, head + len(core))
        return found

    def read(self, texts: list[str]) -> None:
        self.text = "\n".join(texts)
        codes = _codes(self.text)
        bits, fold = _chars(codes)
        n = len(codes)
        before = np.empty(n, np.uint8)
        before[:1] = _SPACE
        before[1:] = bits[:-1]
        blank = (bits & _SPACE) != 0
        letter = lambda b: (b & (_WORD | _DIGIT)) == _WORD
        digit = lambda b: (b & _DIGIT) != 0
        under = codes == 95
        glued = (letter(bits) & ~under & digit(before)) | (digit(bits) & letter(before) & ~np.concatenate([[False], under[:-1]])[:n])
        self.start = np.flatnonzero(~blank & (((before & _SPACE) != 0) | glued))
        gap = np.flatnonzero(blank & ((before & _SPACE) == 0))
        stop = np.append(self.start[1:], n)[: len(self.start)]
        self.stop = np.minimum(stop, np.append(gap, n)[np.searchsorted(gap, self.start)])
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.bound = np.searchsorted(self.start, np.concatenate([[0], ends]))
        power, inverse = _powers(n)
        running = lambda x, t: np.concatenate([np.zeros(1, t), np.cumsum(x, dtype=t)])
        alpha, upper, lower = (running((bits & c) != 0, np.int32) for c in (_ALPHA, _UPPER, _LOWER))
        sums = running(_letter(fold) * power[:n], _U)
        i, j = self.start, self.stop
        last = bits[j - 1] if len(j) else np.empty(0, np.uint8)
        letters = alpha[j] - alpha[i]
        signed = (letters == j - i - 1) & (letters > 0) & ((last & _SIGN) != 0)
        plain = (letters == j - i) | signed
        self.end = e = j - signed
        self.begin = i.copy()
        first = np.minimum(i + 1, e)
        capital = ((bits[i] & _UPPER) != 0) & (lower[e] > lower[first]) & (upper[e] == upper[first])
        capitals = (e - i > 1) & (upper[e] - upper[i] == e - i)
        self.kind = np.where(capital, _CAPITAL, np.where(capitals, _CAPITALS, _LITERAL)).astype(np.int8)
        self.closes = signed & ((last & _END) != 0)
        for k in np.flatnonzero(~plain).tolist():
            self.kind[k], self.closes[k], head, tail = self._classed(self.text[i[k] : j[k]])
            self.begin[k], self.end[k] = i[k] + head, i[k] + tail
        i, e = self.begin, self.end
        self.code = mix((sums[e] - sums[i]) * inverse[np.minimum(i, max(0, n - 1))] + (e - i).astype(_U))

    def __call__(self, doc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, placeholder types (0: literal) and numbers of the words of a text, and which literal ones may be names."""
        at = np.arange(self.bound[doc], self.bound[doc + 1])
        kinds, keep = self.kind[at], None
        if not len(at) or (kinds == _NOTHING).all():
            return np.empty(0, _U), np.empty(0, np.int8), at[:0], np.empty(0, bool)
        opening = np.empty(len(at), bool)
        opening[0] = True
        opening[1:] = self.closes[at[:-1]]
        if (kinds == _NOTHING).any():
            keep = np.flatnonzero(kinds != _NOTHING)
            # a sign alone that ends a sentence passes that on to the next token
            at, kinds, opening = at[keep], kinds[keep], np.maximum.reduceat(opening, np.append(0, keep[:-1] + 1))
        types = np.zeros(len(at), np.int8)
        number = kinds == _NUMBER
        types[number] = _PLACEHOLDERS["num"]
        types[(kinds == _CAPITAL) & ~opening] = _PLACEHOLDERS["name"]
        after = np.flatnonzero(number[:-1] & ~number[1:]) + 1
        if len(after):
            codes = self.code[at[after]]
            near = _UNIT_CODES[np.minimum(np.searchsorted(_UNIT_CODES, codes), len(_UNIT_CODES) - 1)]
            types[after[near == codes]] = _PLACEHOLDERS["unit"]
        codes = np.where(types == 0, self.code[at], _TYPED[types])
        return codes, types, at, (types == 0) & ((kinds == _CAPITALS) | ((kinds == _CAPITAL) & opening))

    def slots(self, types: np.ndarray, at: np.ndarray, start: int, size: int) -> list[str]:
        """Values of a window's placeholders, in order, with their types."""
        return [f"{types[i]}:{self.text[self.begin[at[i]] : self.end[at[i]]].lower()}" for i in range(start, start + size) if types[i]]


def window_hashes(codes: np.ndarray, types: np.ndarray, size: int, min_literal: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows with enough literal tokens. A hash is a
    polynomial in the window's codes, from running sums."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, _U)
    power, inverse = _powers(len(codes))
    sums = np.zeros(len(codes) + 1, _U)
    np.cumsum(codes * power[: len(codes)], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * inverse[:n] + _U(size)
    literal = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(types == 0, out=literal[1:])
    ok = np.flatnonzero(literal[size:] - literal[:-size] >= min_literal)
    return ok, mix(h[ok])


_ROWS = "id long, row long, pos int, windows int, size int, h long, slots array<string>"


def _windows(window: int, min_literal: int, lengths: list[int] | None, bitmap):
    """Windows of texts; of documents (with a bitmap) those that it lets pass, of each length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canonical = Canonical()
        bits = bitmap.value if bitmap is not None else None
        mask = _U(len(bits) * 8 - 1) if bits is not None else None
        for batch in batches:
            rows: list[tuple] = []
            for part in _slices(batch):
                canonical.read([t or "" for t in part["text"]])
                for k, (i, row) in enumerate(zip(part["id"], part["row"])):
                    codes, types, at, loose = canonical(k)
                    name = _PLACEHOLDERS["name"]
                    both = [(codes, types, None)]
                    if loose.any():
                        both.append((np.where(loose, _TYPED[name], codes), np.where(loose, np.int8(name), types), np.concatenate([[0], np.cumsum(loose)])))
                    if len(codes) and np.count_nonzero(types == 0) < min_literal:  # such an item is only found as a text of its own
                        sizes = [-len(codes)]
                    else:
                        sizes = lengths if lengths is not None else [min(window, len(codes))]
                    for size in sizes:
                        if 0 <= size < min_literal:
                            continue
                        total = 0
                        for own, kinds, before in both:
                            if before is not None and size < 0:
                                continue
                            start, h = window_hashes(own, kinds, abs(size), min_literal if size > 0 else 0)
                            if before is None:
                                total = len(start)
                            else:  # others stand there already
                                new = before[start + size] > before[start]
                                start, h = start[new], h[new]
                            if bits is not None and len(start):
                                p = h & mask
                                hit = np.flatnonzero((bits[(p >> _U(3)).astype(np.int64)] >> (p & _U(7)).astype(np.uint8)) & 1)
                                start, h = start[hit], h[hit]
                            for s, x in zip(start.tolist(), h.view(np.int64).tolist()):
                                rows.append((None if pd.isna(i) else int(i), row, s, total, size, x, canonical.slots(kinds, at, s, abs(size))))
                if len(rows) > 20_000:
                    yield _frame(rows)
                    rows = []
            if rows:
                yield _frame(rows)

    return run


def _slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of a batch of some hundred thousand characters, small enough for a processor's cache."""
    lo, size = 0, 0
    for hi, text in enumerate(batch["text"], 1):
        size += len(text or "")
        if size > 200_000 or hi == len(batch):
            yield batch.iloc[lo:hi]
            lo, size = hi, 0


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["id", "row", "pos", "windows", "size", "h", "slots"])
    out["id"] = out["id"].astype("Int64")
    return out


def _bitmap(items: DataFrame) -> np.ndarray:
    """Bits of the item windows' hashes; at most MAX_BITS / 64 rows reach the driver."""
    n = max(1, items.count())
    size = min(MAX_BITS, max(1 << 16, 1 << (64 * n - 1).bit_length()))
    words = (
        items.select(F.expr(f"h & {size - 1}L").alias("p"))
        .groupBy(F.expr("p div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS int)))").alias("mask"))
        .toPandas()
    )
    out = np.zeros(size // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)
    return out.astype("<i8").view(np.uint8)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    min_literal: int = MIN_LITERAL,
    min_windows: int = MIN_WINDOWS,
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, n_windows, item_windows, at (first token), kind."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    def named(df: DataFrame, id_name: str, text_name: str) -> DataFrame:
        i, text = F.col(id_name).cast("long"), F.coalesce(F.col(text_name).cast("string"), F.lit(""))
        return df.select(i.alias("id"), text.alias("text"), F.xxhash64(i, text).alias("row"))

    items = named(benchmark, item_col, item_text_col)
    items = scratch.write(items.mapInPandas(tidy(_windows(window, min_literal, None, None)), _ROWS), "items")
    lengths = sorted(r["size"] for r in items.where("size > 0").select("size").distinct().collect())  # at most `window` values
    bitmap = spark.sparkContext.broadcast(_bitmap(items))
    found = named(slim_batches(docs), id_col, text_col).mapInPandas(tidy(_windows(window, min_literal, lengths, bitmap)), _ROWS)
    d = found.select(F.col("id").alias("doc_id"), F.col("row").alias("drow"), F.col("pos").alias("dpos"), "size", "h", F.col("slots").alias("dslots"))
    i = items.select(F.col("id").alias("item_id"), F.col("row").alias("irow"), F.col("pos").alias("ipos"), F.col("windows").alias("item_windows"), "size", "h", F.col("slots").alias("islots"))
    aligned = (
        d.join(i, ["h", "size"])
        .withColumn("diagonal", F.col("dpos") - F.col("ipos"))
        .groupBy("drow", "irow", "diagonal", "item_windows")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("item_id").alias("item_id"),
            F.count_distinct("ipos").alias("n_windows"),
            F.min("dpos").alias("at"),
            F.min("size").alias("size"),
            F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("islots", "dslots")))).alias("slots"),
        )
        .where(F.col("n_windows") >= F.least(F.lit(min_windows), F.greatest(F.col("item_windows") - 1, F.lit(1))))
        .where("size(array_distinct(transform(slots, s -> s.islots))) = size(slots)")
        .where("size > 0 OR forall(slots, s -> s.islots = s.dslots)")
        .withColumn("kind", F.expr("if(forall(slots, s -> s.islots = s.dslots), 'verbatim', 'reparameterised')"))
    )
    best = F.max(F.struct("n_windows", F.col("kind") == "verbatim", -F.col("at"), "item_windows", "at", "kind"))
    return (
        aligned.groupBy("drow", "irow")
        .agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), best.alias("b"))
        .select("doc_id", "item_id", "b.n_windows", "b.item_windows", "b.at", "b.kind")
    )
