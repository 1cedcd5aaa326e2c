"""Belief propagation with shortcuts, joining of blocks and parts of clusters, against plain sequential versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phaseframe.operators import inference

TINY = 1e-20


def plain_beliefs(n, edges, tolerance=1e-12, damping=0.0):
    """Message by message: products of incoming messages but the one from the receiver, through the edge's factor."""
    size = {e: max(sum(t[0]), sum(t[1])) for e, t in edges.items()}
    order = sorted(size.values())
    middle = (order[(len(order) - 1) // 2] + order[len(order) // 2]) / 2
    factor = {}
    for (i, j), t in edges.items():
        power = size[i, j] / (size[i, j] + middle)
        factor[i, j] = [[(t[a][b] / sum(t[a])) ** power for b in (0, 1)] for a in (0, 1)]
        factor[j, i] = [[factor[i, j][b][a] for b in (0, 1)] for a in (0, 1)]
    beside = {i: [b for a, b in factor if a == i] for i in range(n)}
    own = [[1.0, 0.0]] + [[1.0, 1.0]] * (n - 1)
    message = {e: [0.5, 0.5] for e in factor}
    for _ in range(5000):
        new = {}
        for i, j in factor:
            held = [own[i][a] * math.prod(message[k, i][a] for k in beside[i] if k != j) for a in (0, 1)]
            out = [sum(held[a] * factor[i, j][a][b] for a in (0, 1)) for b in (0, 1)]
            out = [x / sum(out) for x in out]
            if damping:
                out = [math.exp((1 - damping) * math.log(x) + damping * math.log(y)) for x, y in zip(out, message[i, j])]
                out = [x / sum(out) for x in out]
            new[i, j] = out
        moved = max(abs(new[e][a] - message[e][a]) for e in new for a in (0, 1))
        message = new
        if moved < tolerance:
            break
    beliefs = [[own[i][a] * math.prod(message[k, i][a] for k in beside[i]) for a in (0, 1)] for i in range(n)]
    return np.array([[b / sum(x) for b in x] for x in beliefs])


@pytest.mark.parametrize("damping", [0.0, 0.3])
def test_beliefs_on_windows_with_shortcuts(damping):
    """Edges as windows have them: all neighbours, and from the two variants before and to the two behind the run."""
    rng = np.random.default_rng(4)
    loops = 0
    for n in (5, 6, 8, 11):
        for _ in range(4):
            truth = rng.integers(0, 2, n)
            edges = {}
            for i in range(n):
                for j in range(i + 1, n):
                    if j == i + 1 or ((i < 2 or j >= n - 2) and rng.random() < 0.7):
                        agree = truth[i] == truth[j]
                        t = rng.integers(0, 4, (2, 2)) + rng.integers(5, 30) * (np.eye(2) if agree else 1 - np.eye(2)) + TINY
                        edges[i, j] = t
            loops += len(edges) - (n - 1)
            got = inference.propagate(n, edges, damping)
            assert np.allclose(got, plain_beliefs(n, edges, damping=damping), atol=1e-8)
    assert loops > 60


def test_parts_of_clusters_of_difficult_runs_equal_the_sequence(spark):
    rng = np.random.default_rng(5)
    runs, at = [], 3
    for _ in range(40):
        size = int(rng.integers(1, 4))
        runs.append(("c", at, at + size - 1))
        at += size + int(rng.choice([1, 1, 1, 2, 3, 9]))  # mostly one variant between: the next window reads what this one changes
    runs += [("d", 5, 6), ("d", 8, 8)]
    r = spark.createDataFrame(runs, "chrom string, first long, last long")
    n = spark.createDataFrame([("c", at + 10), ("d", 40)], "chrom string, n_phaseable long")
    cell = lambda k: (F.pmod(F.xxhash64("chrom", "i", "j", F.lit(k)), F.lit(17)) * (1 + 2 * (F.pmod(F.xxhash64("i"), F.lit(2)) == k % 3).cast("int"))).cast("double")
    windows = inference.run_windows(r, n).drop("part")
    found = []
    for size in (1000, 1, 3):
        pairs = inference.window_pairs(inference.numbered_parts(windows, size=size)).select("chrom", "cluster", "part", "first", "last", "i", "j", *[cell(k).alias(f"n{c}") for k, c in enumerate(("00", "01", "10", "11"))])
        found.append(sorted(map(tuple, inference.rephase(pairs, 12.0).collect())))
        assert pairs.agg(F.max("part")).first()[0] >= (3 if size < 1000 else 0)
    assert found[0] == found[1] == found[2] and len(found[0]) > 80


# ------------------------------------------------------------- joining of blocks


def plain_join(step, count, number, variants):
    """Runs of undecided steps one after another. step: matrices by place, of places 0.. ; count(a, b): reads between two
    places; number: variants by place. Returns changed matrices and dropped places."""
    total, step = len(number), {k: t.copy() for k, t in step.items()}
    flat = lambda t: bool((t == 0.5).all())
    places = [k for k in sorted(step) if flat(step[k]) and number[k] < variants - 2]
    changed, dropped = {}, set()

    def set_step(k, t):
        step[k] = changed[k] = t

    def between(a, b):
        t = inference.mirror(count(a, b) + TINY)
        return t / t.sum(axis=1, keepdims=True)

    def look(p):
        """What the steps p, p + 1 become given reads across both: (first, second, across), or None."""
        if number[p + 2] > variants - 2:
            return None
        first, second = step[p], step[p + 1]
        if len(set(first.argmax(axis=1))) == 2 and len(set(second.argmax(axis=1))) == 2:
            return None
        seen = count(p, p + 2) + TINY
        if seen.sum(axis=1).max() < 1:
            return None
        across = between(p, p + 2)
        paths = np.einsum("ab,bc,ac->abc", first, second, across)
        one, two = paths.sum(axis=2) + TINY, paths.sum(axis=0) + TINY
        one, two = (inference.mirror(t / t.sum(axis=1, keepdims=True), True) for t in (one, two))
        return one, two, across

    def judge(p):
        """Whether something was done about the place p + 1."""
        seen = look(p)
        if seen is None:
            return False
        one, two, across = seen
        end = int(two[int(one[0].argmax())].argmax())
        lame = any(len(set(t.argmax(axis=1))) == 1 and t.max(axis=1).min() > 0 for t in (one, two))
        if (lame or end != int(across.argmax())) and across.max() > 0.5:
            set_step(p, across)
            dropped.add(p + 1)
        elif one.max() > 0.5 and two.max() > 0.5 and end == int(across.argmax()):
            set_step(p, one)
            set_step(p + 1, two)
        else:
            return False
        return True

    while places:
        a = places.pop(0)
        b = a + 1
        while places and places[0] == b:
            b += 1
            places.pop(0)
        if b == a + 1:
            b += 1
        if b >= total:
            continue
        if b - a > 2:
            t = between(a, b)
            if t.max() > 0.5 and step[b - 1].max() == 0.5:
                set_step(a, t)
                dropped |= set(range(a + 1, b))
        elif a > 0 and 0 < number[a] < variants - 2:
            if not judge(a - 1) and number[a] < variants - 3:
                judge(a)
    return {k: t for k, t in changed.items() if k not in dropped}, dropped


def chain(rng, total):
    """Normalised steps, some undecided or lame, and reads across."""
    kinds = {"keep": [[0.9, 0.1], [0.1, 0.9]], "switch": [[0.2, 0.8], [0.8, 0.2]], "flat": [[0.5, 0.5], [0.5, 0.5]], "lame": [[0.7, 0.3], [0.6, 0.4]]}
    names = rng.choice(list(kinds), total, p=[0.3, 0.15, 0.45, 0.1])
    step = {k: np.array(kinds[n]) for k, n in enumerate(names[:-1])}
    reads = {}

    def count(a, b):
        if (a, b) not in reads:
            agree = rng.random() < 0.5
            clear = rng.choice([0, 0, 3, 9])
            reads[a, b] = rng.integers(0, 2, (2, 2)) * rng.integers(0, 2) + clear * (np.eye(2) if agree else 1 - np.eye(2))
        return reads[a, b].astype(float)

    number = np.cumsum(rng.integers(1, 3, total)) - 1
    return step, count, number.tolist(), int(number[-1]) + 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_blocks_are_joined_as_in_sequence(spark, seed):
    rng = np.random.default_rng(seed)
    rows, want = [], {}
    for chrom in "abcdef":
        total = int(rng.integers(20, 70))
        step, count, number, variants = chain(rng, total)
        flat = [k for k, t in step.items() if (t == 0.5).all() and number[k] < variants - 2]
        runs = []
        for k in flat:
            if runs and runs[-1][1] == k - 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        changed, dropped = plain_join(step, count, number, variants)
        want |= {(chrom, k): None for k in dropped} | {(chrom, k): t for k, t in changed.items()}
        cluster, before = 0, -99
        for first, last in runs:
            cluster += first - before > 4
            before = last
            rows.append((chrom, cluster, "run", first, last, None, first))
            for i in range(max(first - 1, 0), min(last + 4, total)):
                rows.append((chrom, cluster, "at", i, number[i], None, first))
                if i in step:
                    rows.append((chrom, cluster, "step", i, i + 1, step[i], first))
            for i, j in ((first, last + 1), (first - 1, first + 1), (first, first + 2)):
                if i >= 0 and j < total:
                    rows.append((chrom, cluster, "pair", i, j, count(i, j), first))
        rows = [(*r, total, variants) if len(r) == 7 else r for r in rows]
    found = []
    for size in (1000, 1, 2):
        seen, firsts = set(), {}
        for r in rows:
            if r[2] == "run":
                firsts.setdefault(r[:2], []).append(r[3])
        table = []
        for chrom, cluster, kind, i, j, t, first, total, variants in rows:
            part = firsts[chrom, cluster].index(first) // size
            key = (chrom, cluster, part, kind, i, j)
            if key not in seen:
                seen.add(key)
                table.append((chrom, cluster, part, total, variants, kind, i, j, *(t.ravel().tolist() if t is not None else [None] * 4)))
        df = spark.createDataFrame(table, "chrom string, cluster long, part long, total int, variants int, kind string, i long, j long, t00 double, t01 double, t10 double, t11 double")
        found.append({(r["chrom"], r["p_idx"]): None if r["drop"] else np.array([r["t00"], r["t01"], r["t10"], r["t11"]]) for r in inference.connect(df).collect()})
    for got in found:
        assert got.keys() == want.keys() and len(got) > 40
        for k, t in got.items():
            assert (t is None) == (want[k] is None) and (t is None or np.allclose(t.reshape(2, 2), want[k] / want[k].sum(axis=1, keepdims=True), rtol=1e-12)), k


def test_parts_are_dealt_out_by_number(spark, monkeypatch):
    seen = []
    write = inference.cut
    monkeypatch.setattr(inference, "cut", lambda df, name: (seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())), write(df, name))[1])
    rows = spark.createDataFrame([("c", k, 0, k) for k in range(40)], "chrom string, cluster long, part long, v long")
    out = inference.in_parts(rows, lambda pdf, given: (pdf[["v"]], {}), "v long")
    assert sorted(r["v"] for r in out.collect()) == list(range(40))
    # few bytes: without a number of its own the exchange would be read by one task
    assert all("RepartitionByExpression" in plan for name, plan in seen if name == "parts")


def test_parts_run_again_for_what_they_read_alone(spark):
    """A part hands over a matrix below the first p_idx that the next one reads: nothing there changes, so no part runs twice."""
    rows = spark.createDataFrame([("c", 0, part, 10 * part + k) for part in range(6) for k in range(3)], "chrom string, cluster long, part long, i long")

    def run(pdf, given):
        first = int(pdf["i"].min())
        return pdf[["i"]].assign(heard=float(sum(t[0, 0] for t in given.values()))), {first + reach: np.full((2, 2), 1.0)}

    found = {}
    for reach in (5, 10):  # before and at the first of the next part
        names = []
        write = inference.cut
        try:
            inference.cut = lambda df, name: (names.append(name), write(df, name))[1]
            out = inference.in_parts(rows, run, "i long, heard double", "i")
        finally:
            inference.cut = write
        found[reach] = names.count("again"), sum(r["heard"] for r in out.collect())
    assert found == {5: (0, 0.0), 10: (1, 15.0)}


def test_graphs_side_by_side_are_as_alone():
    """Each graph rests in its own round, whatever the others do."""
    rng = np.random.default_rng(8)
    at = [(i, j) for i in range(7) for j in range(i + 1, 7) if j == i + 1 or i < 2 or j > 4]
    cells = rng.integers(0, 40, (30, len(at), 2, 2)) + TINY
    cells[::3] = np.where(np.eye(2) > 0, 30.0, TINY)
    for damping in (0.0, 0.3):
        many = inference.propagate_many(7, at, cells, damping)
        for t, got in zip(cells, many):
            np.testing.assert_array_equal(got, inference.propagate(7, dict(zip(at, t)), damping))
            np.testing.assert_allclose(got, plain_beliefs(7, dict(zip(at, t)), damping=damping), atol=1e-6)
