"""Local realignment of reads to the two alleles of a variant.

Semi-global affine alignment, gaps at the reference's ends free, +5 for a match
and -4 for a mismatch of A C G T; a gap of length k costs open + (k - 1) *
extend. The allele with the higher score is the state, -1 on a tie. For single
bases the opening penalty is doubled, next to a homopolymer it is two less.

Pairs are aligned side by side: one step of the table is an array operation over all
pairs of a batch, sorted by length so that little of it is padding. Reads that show the same
bases around a variant are one pair: a task aligns it once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MATCH, MISMATCH = 5, -4
#: Cells of a table row that are worked on together.
BATCH_CELLS = 100_000
#: Characters of pairs whose states a task remembers.
REMEMBERED = 64_000_000
_LOW = -(10**8)


def scores(queries: list[str], refs: list[str], gap_open: np.ndarray, gap_extend: np.ndarray) -> np.ndarray:
    """Best score of each whole query against a stretch of its reference."""
    rows, cols = np.array(list(map(len, queries))), np.array(list(map(len, refs)))
    m, n = int(rows.max(initial=0)), int(cols.max(initial=0))
    q = np.zeros((len(queries), m), np.uint8)
    r = np.ones((len(refs), n), np.uint8)
    for k, (a, b) in enumerate(zip(queries, refs)):
        q[k, : len(a)] = np.frombuffer(a.encode(), np.uint8)
        r[k, : len(b)] = np.frombuffer(b.encode(), np.uint8)
    at = np.arange(n + 1, dtype=np.int32)
    opening, extend = (np.asarray(x, np.int32)[:, None] for x in (gap_open, gap_extend))
    h = np.zeros((len(queries), n + 1), np.int32)  # free leading gap in the reference
    down = np.full_like(h, _LOW)
    best, across = np.empty_like(h), np.empty_like(h)
    slope = at * extend
    for i in range(m):
        open_ = rows > i
        down = np.maximum(h - opening, down - extend)  # a gap in the reference
        best[:, 0] = down[:, 0]
        np.maximum(h[:, :-1] + np.where(r == q[:, i : i + 1], MATCH, MISMATCH), down[:, 1:], out=best[:, 1:])
        # a gap in the query: the best earlier column, less opening and extension
        lead = np.maximum.accumulate(best + slope, axis=1)
        across[:, 0] = _LOW
        np.subtract(lead[:, :-1] - opening, slope[:, 1:] - extend, out=across[:, 1:])
        new = np.maximum(best, across)
        h = new if open_.all() else np.where(open_[:, None], new, h)
    return np.where(at <= cols[:, None], h, _LOW).max(axis=1)  # free trailing gap in the reference


def states(
    windows: list[str], lefts: list[str], alleles_a: list[str], alleles_b: list[str], rights_a: list[str], rights_b: list[str],
    gap_open: np.ndarray, gap_extend: np.ndarray, homopolymer: np.ndarray,
) -> np.ndarray:
    """0, 1 or -1 for each pair of a read's window and a variant."""
    single = np.array([len(a) == len(b) == 1 for a, b in zip(alleles_a, alleles_b)], bool)
    opening = np.where(single, 2 * np.asarray(gap_open), gap_open) - 2 * np.asarray(homopolymer, bool)
    refs = [[x + a + y for x, a, y in zip(lefts, alleles, rights)] for alleles, rights in ((alleles_a, rights_a), (alleles_b, rights_b))]
    out = np.empty(len(windows), np.int32)
    size = np.array([max(len(x), len(y)) for x, y in zip(*refs)] or [0]) + 1
    order = np.argsort(size[: len(windows)], kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * size[order[hi]] <= BATCH_CELLS:
            hi += 1
        part = order[lo:hi]
        pick = lambda xs: [xs[k] for k in part]  # noqa: E731, B023
        a, b = (scores(pick(windows), pick(ref), opening[part], np.asarray(gap_extend)[part]) for ref in refs)
        out[part] = np.where(a > b, 0, np.where(b > a, 1, -1))
        lo = hi
    return out


def states_once(rows: list[tuple], known: dict[tuple, int]) -> np.ndarray:
    """``states`` of pairs given as tuples of its arguments; those in ``known``, which grows, aren't aligned again."""
    new = [r for r in dict.fromkeys(rows) if r not in known]
    if new:
        *texts, opening, extend, homopolymer = map(list, zip(*new))
        found = states(*texts, np.array(opening, np.int32), np.array(extend, np.int32), np.array(homopolymer, bool))
        known.update(zip(new, found.tolist()))
    return np.array([known[r] for r in rows], np.int32)


def realigned_states(pending: DataFrame) -> DataFrame:
    """pending: read_id, idx, read_window, left_flank, allele_a, allele_b, right_a and right_b (or right_flank for both),
    gap_open, gap_extend, homopolymer.

    Only pairs whose direct call was undecided come here; rows are independent. The read_id keeps its type.
    """
    same = "right_flank" in pending.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, int] = {}
        size = 0
        for pdf in batches:
            text = lambda c: pdf[c].fillna("").tolist()  # noqa: E731, B023
            rights = [text("right_flank")] * 2 if same else [text("right_a"), text("right_b")]
            rows = list(zip(
                text("read_window"), text("left_flank"), text("allele_a"), text("allele_b"), *rights,
                pdf["gap_open"].tolist(), pdf["gap_extend"].tolist(), pdf["homopolymer"].fillna(False).astype(bool).tolist(),
            ))
            if size > REMEMBERED:
                known, size = {}, 0
            before = len(known)
            found = states_once(rows, known)
            size += sum(len(t) for r in itertools.islice(known, before, None) for t in r[:6])
            yield pd.DataFrame({"read_id": pdf["read_id"], "idx": pdf["idx"], "state": found})

    return pending.mapInPandas(run, f"read_id {pending.schema['read_id'].dataType.simpleString()}, idx long, state int")
