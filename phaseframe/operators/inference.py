"""Belief propagation over hard-to-phase runs, and the joining of phase blocks.

Both work on small graphs that are cut out of the chromosome by windows over
the variants. Windows that touch share transitions and must run in order;
those are one cluster. Clusters don't touch. A long cluster is cut into parts of a bounded number of
windows, which run side by side until none sees another change of its neighbour, see ``in_parts``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaseframe.sources.checkpoints import cut

#: Windows of a part of a cluster.
PART = 256

EPSILON = 1e-20


def mirror(t: np.ndarray, normalized: bool = False) -> np.ndarray:
    """The mirror rule for one 2x2 matrix; see ``transitions.mirror``."""
    gaps = t.max(axis=1) / t.min(axis=1)
    tops = t.max(axis=1)
    distinct = (t[0, 0] >= t[0, 1]) != (t[1, 0] >= t[1, 1])
    wins: int | None = None
    if gaps[0] != gaps[1]:
        strong = int(gaps[1] > gaps[0])
        if distinct and (tops[strong] > 1 or tops[1 - strong] <= 1 or normalized):
            wins = strong
        elif tops[strong] == 1 and tops[1 - strong] > 1 and not normalized:
            wins = 1 - strong  # a single read doesn't overrule several
    if wins is None:
        if (t[0] == t[1]).all():
            return np.full((2, 2), 0.5 if normalized else EPSILON)
        if distinct:
            return t.copy()
        d = np.abs(t[:, 0] - t[:, 1])
        key = d if d[0] != d[1] else gaps
        if key[0] == key[1]:
            return np.full((2, 2), 0.5 if normalized else EPSILON)
        wins = int(key[1] > key[0])
    out = t.copy()
    out[1 - wins] = t[wins, ::-1]
    return out


def row_normal(t: np.ndarray) -> np.ndarray:
    return t / t.sum(axis=1, keepdims=True)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def propagate(n: int, edges: dict[tuple[int, int], np.ndarray], damping: float = 0.0, tol: float = 1e-10, rounds: int = 500) -> np.ndarray:
    """Beliefs (n, 2) of the layers; layer 0 is fixed to the reference allele.

    edges: counts by (i, j), i < j. Factors are log row-normalised counts,
    weighted by an edge's coverage over itself plus the median coverage.
    Messages are updated all at once until they move less than ``tol``; damping mixes their logarithms.
    """
    cells = np.array(list(edges.values()), float).reshape(1, len(edges), 2, 2)
    return propagate_many(n, list(edges), cells, damping, tol, rounds)[0]


def propagate_many(n: int, at: list[tuple[int, int]], cells: np.ndarray, damping: float = 0.0, tol: float = 1e-10, rounds: int = 500) -> np.ndarray:
    """``propagate`` on graphs with the same edges ``at``, side by side: cells are graphs x edges x 2 x 2. A graph whose messages
    have come to rest is taken out, so its beliefs are those it would have alone."""
    phi = np.zeros((n, 2))
    phi[0] = [0.0, -np.inf]
    src, dst = (np.array([e[k ^ side] for e in at for side in (0, 1)], int) for k in (0, 1))

    def collected(msg: np.ndarray) -> np.ndarray:
        total = np.repeat(phi[None], len(msg), axis=0)
        for e, j in enumerate(dst):
            total[:, j] += msg[:, e]
        return total

    last = np.full((len(cells), len(src), 2), np.log(0.5))
    if at:
        cover = cells.sum(axis=3).max(axis=2)
        weight = cover / (cover + np.median(cover, axis=1, keepdims=True))
        f = np.log(cells / cells.sum(axis=3, keepdims=True) + 1e-300) * weight[:, :, None, None]
        fac = np.stack([f, f.transpose(0, 1, 3, 2)], axis=2).reshape(len(cells), len(src), 2, 2)
        back, going, msg = np.arange(len(src)) ^ 1, np.arange(len(cells)), last
        for _ in range(rounds):
            with np.errstate(invalid="ignore"):
                inner = collected(msg)[:, src] - msg[:, back]
            new = _log_sum(inner[:, :, :, None] + fac, 2)
            new -= _log_sum(new, 2)[:, :, None]
            if damping:
                new = (1 - damping) * new + damping * msg
                new -= _log_sum(new, 2)[:, :, None]
            rests = np.abs(np.exp(new) - np.exp(msg)).max(axis=(1, 2)) < tol
            last[going] = msg = new
            if rests.any():
                going, msg, fac = going[~rests], msg[~rests], fac[~rests]
                if not len(going):
                    break
    total = collected(last)
    return np.exp(total - _log_sum(total, 2)[:, :, None])


def belief_transition(parent: np.ndarray, child: np.ndarray, coverage: float) -> np.ndarray:
    """Transition that carries the parent's beliefs into the child's, times the mean coverage, mirrored."""
    t = np.ones((2, 2))
    if parent[0] != 0.5:
        for r in (0, 1):
            for c in (0, 1):
                t[r, c] = max((parent[r] + child[c] - 1) / (2 * parent[r] - 1), 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        t = t / t.sum(axis=1, keepdims=True) + 1e-300
    return mirror(np.nan_to_num(t, nan=0.5) * coverage)


def numbered_parts(windows: DataFrame, order: str = "first", size: int | None = None) -> DataFrame:
    """``windows`` (chrom, cluster) with ``part``: each ``size`` windows of a cluster in order."""
    number = F.row_number().over(Window.partitionBy("chrom", "cluster").orderBy(order)) - 1
    return windows.withColumn("part", F.floor(number / (size or PART)).cast("long"))


def in_parts(rows: DataFrame, run: Callable[[pd.DataFrame, dict], tuple[pd.DataFrame, dict]], columns: str, reads: str | None = None) -> DataFrame:
    """What ``run`` gives for the parts of each cluster, as if these ran one after another.

    ``run(pdf, given)`` takes a part's rows and the matrices by p_idx that the part before has left changed, and returns
    rows and the matrices that the next part may read. At first all parts run at once with nothing given. Then those
    run again whose predecessor leaves something else than they were given, until there are none. A part's outcome depends
    on what precedes it alone, so after k rounds the first k parts of a cluster are final, and the fixed point is the
    sequential result. A change rarely outlives a few windows, hence few rounds are needed, whatever the length of a cluster.
    ``reads``: a column of which a part's smallest value is the first p_idx that the part reads; what is handed over below it makes no part run again.
    """
    keys = ["chrom", "cluster", "part"]
    names = [c.split()[0] for c in columns.split(", ")]

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf["carried"].iloc[0]
        cells = np.array([] if left is None else [list(c) for c in left], float).reshape(-1, 5)
        out, gives = run(pdf.drop(columns=["carried"]), {int(c[0]): c[1:].reshape(2, 2) for c in cells})
        # one row more, for what is handed over
        handed = [[float(v) for v in (p, *t.ravel())] for p, t in sorted(gives.items())]
        columns_ = {n: [*out[n].tolist(), None] for n in names}
        key = {k: [pdf[k].iloc[0]] * (len(out) + 1) for k in keys}
        low = -1 if reads is None else int(pdf[reads].min())
        return pd.DataFrame(key | {"low": [low] * (len(out) + 1), "carried": [None] * len(out) + [handed]} | columns_)

    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def ran(df: DataFrame, name: str) -> DataFrame:
        # by number: parts are small in bytes and long in work, so they would be put together in a task
        return cut(df.repartition(tasks, *keys).groupBy(*keys).applyInPandas(group, "chrom string, cluster long, part long, low long, carried array<array<double>>, " + columns), name)

    none = F.lit(None).cast("array<array<double>>")
    rows = cut(rows.withColumn("cluster", F.col("cluster").cast("long")), "windows")  # read again by each round
    out = ran(rows.withColumn("carried", none), "parts")
    later = out.where("carried IS NOT NULL AND part > 0").select(*keys, "low")
    if not later.isEmpty():
        given = later.withColumn("before", F.array().cast("array<array<double>>"))
        while True:
            leaves = out.where("carried IS NOT NULL").select("chrom", "cluster", (F.col("part") + 1).alias("part"), "carried")
            heard = leaves.join(given, keys).withColumn("carried", F.expr("filter(carried, c -> c[0] >= low)"))
            changed = cut(heard.where("NOT carried <=> before").select(*keys, "carried"), "changed")
            if changed.isEmpty():
                break
            again = ran(rows.join(changed, keys), "again")
            out = cut(out.join(changed.select(*keys), keys, "left_anti").unionByName(again), "parts")
            given = cut(given.join(changed, keys, "left").select(*keys, "low", F.coalesce("carried", "before").alias("before")), "given")
    return out.where("carried IS NULL").drop("carried", "low")


def run_windows(runs: DataFrame, n_phaseable: DataFrame, flank: int = 2) -> DataFrame:
    """Windows around runs of difficult variants: chrom, cluster, part, first, last (p_idx of the run).

    A run needs two variants before it and is cut where fewer than two would follow.
    """
    x = runs.join(n_phaseable, "chrom").withColumn("last", F.least("last", F.col("n_phaseable") - 4))
    x = x.where((F.col("first") >= flank) & (F.col("last") >= F.col("first")) & (F.col("first") <= F.col("n_phaseable") - 4))
    w = Window.partitionBy("chrom").orderBy("first")
    opens = F.coalesce(F.col("first") - flank > F.lag("last").over(w) + flank, F.lit(True)).cast("int")
    x = x.withColumn("opens", opens).withColumn("cluster", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered_parts(x.select("chrom", "cluster", "first", "last"))


def window_pairs(windows: DataFrame, flank: int = 2) -> DataFrame:
    """Pairs of layers whose counts a window needs: chrom, cluster, part, first, last, i, j (p_idx)."""
    lo, hi = F.col("first") - flank, F.col("last") + flank
    x = windows.withColumn("i", F.explode(F.sequence(lo, hi - 1))).withColumn("j", F.explode(F.sequence(F.col("i") + 1, hi)))
    near_start, near_end = F.col("i") < F.col("first"), F.col("j") > F.col("last")
    return x.where((F.col("j") == F.col("i") + 1) | ((near_start | near_end) & (F.col("j") - F.col("i") >= 2)))


def rephase(counts: DataFrame, mean_coverage: float, flank: int = 2, damping: float = 0.0) -> DataFrame:
    """New transitions of difficult runs.

    counts: chrom, cluster, part, first, last, i, j and n00 n01 n10 n11 per pair of
    layers; for neighbours the adjacent counts. Returns chrom, p_idx (of the
    earlier variant) and cells. The outcome is that of a cluster's windows in order on shared
    transitions. A window reads one that the window before has changed only where one variant lies between their runs.
    """

    def run(pdf: pd.DataFrame, given: dict[int, np.ndarray]) -> tuple[pd.DataFrame, dict[int, np.ndarray]]:
        cells = pdf[["n00", "n01", "n10", "n11"]].to_numpy(float).reshape(-1, 2, 2) + EPSILON
        shared = {i: t for i, j, t in zip(pdf["i"], pdf["j"], cells) if j == i + 1}
        shared |= {p: t for p, t in given.items() if p in shared}
        changed: dict[int, np.ndarray] = {}
        windows, depth, end = [], [], -1
        for (first, last), part in sorted(pdf.assign(row=range(len(pdf))).groupby(["first", "last"])):
            lo, n = first - flank, last - first + 1 + 2 * flank
            edges = {}
            part = part.sort_values(["i", "j"])
            for i, j, row in zip(part["i"], part["j"], part["row"]):
                t = mirror(shared[i]) if j == i + 1 else mirror(cells[row])
                if j == i + 1:
                    shared[i] = t
                elif (np.abs(row_normal(t) - 0.5) <= 5.01e-6).all():
                    continue
                edges[i - lo, j - lo] = t
            # what the window before changes ends with its run; a window that reads it waits for that one
            depth.append(depth[-1] + 1 if windows and end >= lo else 0)
            windows.append((lo, n, range(lo, end + 1) if depth[-1] else (), edges))
            end = int(last)
        for d in range(max(depth, default=-1) + 1):
            alike: dict[tuple, list[tuple]] = {}
            for w in (w for w, k in zip(windows, depth) if k == d):
                lo, n, heard, edges = w
                edges.update({(p - lo, p - lo + 1): mirror(changed[p]) for p in heard})
                alike.setdefault((n, *edges), []).append(w)
            for (n, *at), group in alike.items():
                for (lo, *_), beliefs in zip(group, propagate_many(n, at, np.array([list(w[3].values()) for w in group]), damping)):
                    for k in range(flank - 1, n - flank):
                        changed[lo + k] = belief_transition(beliefs[k], beliefs[k + 1], mean_coverage)
        rows = [(p, *t.ravel()) for p, t in sorted(changed.items())]
        return pd.DataFrame(rows, columns=["p_idx", "t00", "t01", "t10", "t11"]), {p: t for p, t in changed.items() if p == end}

    if "part" not in counts.columns:
        counts = counts.withColumn("part", F.lit(0).cast("long"))
    return in_parts(counts, run, "p_idx long, t00 double, t01 double, t10 double, t11 double", "i").select("chrom", "p_idx", "t00", "t01", "t10", "t11")


def reestimate(t1: np.ndarray, t2: np.ndarray, t3: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both steps of A-B-C given A-C: each step weighted by how well A-C supports the paths it is on."""
    new1 = t1 * (t2[None, :, :] * t3[:, None, :]).sum(axis=2)
    new2 = t2 * (t1[:, :, None] * t3[:, None, :]).sum(axis=0)
    return row_normal(new1 + EPSILON), row_normal(new2 + EPSILON)


def _triple(step: dict, pair: dict, at: dict, p: int, variants: int):
    """Re-estimated (first, second, across) for p, p+1, p+2; None if nothing can be said. ``at``: variant numbers by p."""
    t1, t2, t3 = step.get(p), step.get(p + 1), pair.get((p, p + 2))
    if p < 0 or at.get(p + 2, variants) > variants - 2 or t1 is None or t2 is None:
        return None
    both = lambda t: t.argmax(axis=1)[0] != t.argmax(axis=1)[1]
    if (both(t1) and both(t2)) or t3 is None or t3.sum(axis=1).max() < 1:
        return None
    t3 = row_normal(mirror(t3))
    new1, new2 = reestimate(row_normal(t1), row_normal(t2), t3)
    return mirror(new1, True), mirror(new2, True), t3


def _verdict(new1: np.ndarray, new2: np.ndarray, t3: np.ndarray) -> str:
    """'skip' the middle variant, 'keep' it with both new steps, or 'none'."""
    same = lambda t: t.argmax(axis=1)[0] == t.argmax(axis=1)[1] and t.max(axis=1).min() > 0
    end = new2[new1[0].argmax()].argmax()
    agrees = end == t3.argmax()
    if (same(new1) or same(new2) or not agrees) and t3.max() > 0.5:
        return "skip"
    return "keep" if new1.max() > 0.5 and new2.max() > 0.5 and agrees else "none"


def connect(windows: DataFrame) -> DataFrame:
    """Joins blocks over runs of uncertain transitions.

    windows: chrom, cluster, part, total (phaseable variants of the chromosome), variants (all of
    them), kind ('step': i to i + 1 with normalised cells; 'pair': i to j with counts;
    'run': uncertain transitions i..j; 'at': the variant number j of i), i, j, t00 t01 t10 t11.
    Bounds at a chromosome's ends are in variant numbers. Returns chrom, p_idx, drop (whether the variant becomes unphaseable) and, if it doesn't, the
    new transition from it.

    Over a long run the variants before and after it are linked directly, if
    reads connect them, and those between are dropped. Over a short one the
    neighbouring triples are re-estimated: an informative step across drops
    the middle variant where the two-step path is undecided or disagrees, and
    replaces both steps where it agrees. The outcome is that of a cluster's runs in order.
    """

    def run(pdf: pd.DataFrame, given: dict[int, np.ndarray]) -> tuple[pd.DataFrame, dict[int, np.ndarray]]:
        total, variants = int(pdf["total"].iloc[0]), int(pdf["variants"].iloc[0])
        at = {int(i): int(j) for k, i, j in zip(pdf["kind"], pdf["i"], pdf["j"]) if k == "at"}
        cells = pdf[["t00", "t01", "t10", "t11"]].to_numpy(float).reshape(-1, 2, 2)
        step = {int(i): t for k, i, t in zip(pdf["kind"], pdf["i"], cells) if k == "step"}
        pair = {(int(i), int(j)): t + EPSILON for k, i, j, t in zip(pdf["kind"], pdf["i"], pdf["j"], cells) if k == "pair"}
        runs = sorted((int(i), int(j)) for k, i, j in zip(pdf["kind"], pdf["i"], pdf["j"]) if k == "run")
        step |= given
        new: dict[int, np.ndarray] = {}
        gone: set[int] = set()
        uniform = np.full((2, 2), 0.5)
        for a, last in runs:
            b = last + 1 if last > a else a + 2
            if b >= total:
                continue
            if b - a > 2:
                t = mirror(pair.get((a, b), np.full((2, 2), EPSILON)))
                if row_normal(t).max() > 0.5 and step.get(b - 1, uniform).max() == 0.5:
                    step[a] = new[a] = row_normal(t)
                    gone.update(range(a + 1, b))
                continue
            if not (a > 0 and 0 < at.get(a, 0) < variants - 2):
                continue
            found = _triple(step, pair, at, a - 1, variants)
            act = _verdict(*found) if found else "none"
            if act == "skip":
                step[a - 1] = new[a - 1] = found[2]
                gone.add(a)
            elif act == "keep":
                step[a - 1], step[a] = new[a - 1], new[a] = found[0], found[1]
            elif at[a] < variants - 3:
                found = _triple(step, pair, at, a, variants)
                act = _verdict(*found) if found else "none"
                if act == "skip":
                    step[a] = new[a] = found[2]
                    gone.add(a + 1)
                elif act == "keep":
                    step[a], step[a + 1] = new[a], new[a + 1] = found[0], found[1]
        rows = [(p, False, *row_normal(t).ravel()) for p, t in sorted(new.items()) if p not in gone]
        rows += [(p, True, None, None, None, None) for p in sorted(gone)]
        out = pd.DataFrame(rows, columns=["p_idx", "drop", "t00", "t01", "t10", "t11"])
        # of what the last run has changed, the next one may read the step behind it
        return out, {p: t for p, t in new.items() if runs and p > runs[-1][1]}

    if "part" not in windows.columns:
        windows = windows.withColumn("part", F.lit(0).cast("long"))
    found = in_parts(windows, run, "p_idx long, drop boolean, t00 double, t01 double, t10 double, t11 double", "i")
    # between parts, as within one: dropped variants have no transition, and later runs overrule earlier ones
    cells = F.struct("part", "t00", "t01", "t10", "t11")
    found = found.groupBy("chrom", "p_idx").agg(F.max("drop").alias("drop"), F.max(cells).alias("c"))
    return found.select("chrom", "p_idx", "drop", *[F.when(~F.col("drop"), F.col(f"c.{t}")).alias(t) for t in ("t00", "t01", "t10", "t11")])
