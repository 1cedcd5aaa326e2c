"""Operators that work in parts what the semantics define in sequence: equal to plain sequential versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phaseframe.config import PhasingConfig
from phaseframe.operators import calls, cigar, decode, ordered


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_in_chunks_are_viterbi(spark, seed):
    rng = np.random.default_rng(seed)
    rows, want, idx = [], {}, 0
    for block in range(4):
        n = int(rng.choice([1, 2, 40, 150]))
        t = rng.random((n - 1, 2, 2))
        t /= t.sum(axis=2, keepdims=True)
        mirrored = rng.random(n - 1) < 0.5  # runs of symmetric matrices give ties
        t[mirrored, 1] = t[mirrored, 0, ::-1]
        t[rng.random(n - 1) < 0.05, 0, 0] = 0.0
        for k in range(n):
            cells = [0.5] * 4 if k == 0 else t[k - 1].ravel().tolist()
            rows.append(("c", idx + k, idx + k, block, int(k == 0), *cells))
        odd = any(m[0, 0] != m[1, 1] or m[0, 1] != m[1, 0] for m in t)
        if odd:
            want |= dict(zip(range(idx, idx + n), decode.viterbi(t).tolist()))
        idx += n
    blocked = spark.createDataFrame(rows, "chrom string, idx long, p_idx long, block_id long, breaks long, t00 double, t01 double, t10 double, t11 double")
    for chunk in (1, 7, 4096):
        assert {r["idx"]: r["h0"] for r in decode.viterbi_blocks(blocked, chunk).collect()} == want


def test_composed_steps_associate():
    rng = np.random.default_rng(3)
    logs = decode._logs(rng.random((60, 2, 2)))
    a, b = decode.compose(logs[:25]), decode.compose(logs[25:])
    both = (max(a[0] + b[0], a[1] + b[2]), max(a[0] + b[1], a[1] + b[3]), max(a[2] + b[0], a[3] + b[2]), max(a[2] + b[1], a[3] + b[3]))
    assert np.allclose(both, decode.compose(logs))


# ------------------------------------------------------------- calls


def plain_index(ops, at):
    """Operation by operation."""
    q = r = 0
    for n, o in ops:
        if o in "M=X" and r <= at < r + n:
            return q + at - r
        if o in "DN" and r <= at < r + n:
            return q
        q += n if o in "M=XIS" else 0
        r += n if o in "M=XDN" else 0
    return None


def plain_call(read, v, ont, least):
    """State of one variant in one read, base by base; 2: open."""
    ops = [(int(n), o) for n, o in cigar._STEPS.findall(read["cigar"])]
    seq, quals, at = read["seq"], read["quals"], v["pos"] - 1 - read["read_start"]
    q = plain_index(ops, at)
    if q is None or q >= len(seq):
        return -1
    ref, a, b = v["ref"], v["allele_a"], v["allele_b"]
    if len(ref) == len(a) == len(b) == 1:
        around = range(max(q - 1, 0), min(q + 2, len(seq))) if ont else [q]
        if quals is not None and min(quals[k] for k in around) <= least:
            return -1
        word = "".join(seq[k] for k in around)
        left, right = (v["left"], v["right"]) if ont else ("", "")
        return {left + a + right: 0, left + b + right: 1}.get(word, 2)
    if ref == a and len(ref) < len(b):
        after = plain_index(ops, at + 1)
        if after is None:
            return 2
        added = seq[q + 1 : after]
        return 0 if not added else 1 if added == b[len(ref) :] else 2
    if ref == a and len(ref) > len(b):
        after = plain_index(ops, at + len(ref))
        lost = 0 if after is None else max(0, len(ref) - (after - q))
        return 0 if lost == 0 else 1 if lost == len(ref) - len(b) else 2
    return 2


def made(seed):
    """A reference, variants of all kinds on it and reads with operations of all kinds."""
    rng = random.Random(seed)
    ref = "".join(rng.choices("ACGT", k=3000))
    variants = []
    for pos in sorted(rng.sample(range(1, 2990), 250)):
        base, size = ref[pos - 1], rng.choice([1, 1, 2, 5])
        span = ref[pos - 1 : pos - 1 + rng.choice([1, 1, 1, 3, 6])]
        a, b = rng.choice([(base, rng.choice("ACGT")), (base, base + "".join(rng.choices("ACGT", k=size))), (span, span[0]), (span, "TTTT"), ("C", "G")])
        if a == b:
            continue
        own = base if len(a) == 1 and a != base and rng.random() < 0.5 else a
        variants.append({"pos": pos, "ref": own, "allele_a": a, "allele_b": b, "left": ref[pos - 2] if pos > 1 else " ", "right": ref[pos]})
    reads = []
    for k in range(120):
        start = rng.randrange(2700)
        cigar_, seq, r = "", "", start
        for n, o in [(rng.randint(0, 5), "S")] + [(rng.randint(1, 40), rng.choice("M=XMMIDN")) for _ in range(rng.randint(1, 14))] + [(rng.randint(0, 4), "S"), (3, "H")]:
            if n:
                cigar_ += f"{n}{o}"
            if o in "M=X":
                seq += "".join(c if rng.random() < 0.9 else rng.choice("ACGT") for c in ref[r : r + n])
            elif o in "IS":
                seq += "".join(rng.choices("ACGT", k=n))
            r += n if o in "M=XDN" else 0
        quals = None if k % 9 == 0 else [rng.randint(0, 3) for _ in seq]
        reads.append({"read_name": f"r{k}", "read_start": start, "read_end": r, "cigar": cigar_, "seq": seq, "quals": quals})
    return ref, variants, reads


@pytest.mark.parametrize("ont", [False, True])
def test_calls_of_a_batch_are_those_of_single_pairs(spark, ont):
    ref, variants, reads = made(5)
    config = PhasingConfig.for_technology("ont" if ont else "pacbio", min_base_quality=0)
    v = spark.createDataFrame([("c", k, x["pos"], x["ref"], x["allele_a"], x["allele_b"]) for k, x in enumerate(variants)], "chrom string, idx long, pos long, ref string, allele_a string, allele_b string")
    v = v.withColumn("wide", F.greatest(F.length("ref"), F.length("allele_a"), F.length("allele_b"))).withColumn("flank", F.lit(5))
    v = v.withColumn("win_start", F.greatest(F.col("pos") - 6, F.lit(0))).withColumn("ref_seq", F.substring(F.lit(ref), (F.col("win_start") + 1).cast("int"), F.lit(40)))
    a = spark.createDataFrame([("c", r["read_name"], 0, k, r["read_start"], r["read_end"], r["cigar"], r["seq"], r["quals"]) for k, r in enumerate(reads)], "chrom string, read_name string, flag int, aln long, read_start long, read_end long, cigar string, seq string, quals array<int>")
    specs = calls.spec(v).collect()
    lists = [(k, [s["spec"] for s in specs if r["read_start"] <= s["at"] < r["read_end"]]) for k, r in enumerate(reads)]
    lists = spark.createDataFrame([(k, x) for k, x in lists if x], f"aln long, variants {calls.SPEC}")
    out = calls.called(a.join(lists, "aln").repartition(3), config).select("read_name", "read_start", F.explode("calls").alias("c")).select("read_name", "c.*").collect()
    by = {r["read_name"]: r for r in reads}
    assert len(out) > 1000 and {r["state"] for r in out} == {-1, 0, 1, None}
    for r in out:
        read, x = by[r["read_name"]], variants[r["idx"]]
        want = plain_call(read, x, ont, 0)
        assert (2 if r["state"] is None else r["state"]) == want, (r, read, x)
        if want == 2:
            wide, q = max(map(len, (x["ref"], x["allele_a"], x["allele_b"]))), r["q"]
            assert r["window"] == read["seq"][max(q - 5, 0) : q + wide + 5] and r["up"] == q - max(q - 5, 0) and r["down"] == min(len(read["seq"]), q + wide + 5) - q - wide


def test_calls_of_a_long_read_are_linear():
    import time

    def cigar_of(n):
        return "".join(f"{k % 7 + 1}{'MID'[k % 3]}" for k in range(n))

    took = []
    for n in (50_000, 400_000):
        text = cigar_of(n)
        began = time.process_time()
        merge = calls._Merge([text])
        at = np.arange(0, merge._width - 1, 3)
        got = merge.query(np.zeros(len(at), np.int64), at)
        took.append(time.process_time() - began)
        ops = [(int(k), o) for k, o in cigar._STEPS.findall(text[:2000])]
        assert [None if x < 0 else int(x) for x in got[:20]] == [plain_index(ops, int(x)) for x in at[:20]]
    assert took[1] < 30 * took[0] + 0.5


def test_order_is_told_without_an_exchange(spark):
    rows = [("a", k) for k in range(50)] + [("b", k) for k in range(30)]
    df = spark.createDataFrame(rows, "chrom string, pos long")
    flat = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "chrom string, pos long")
    assert ordered.inversions(ordered.order_report(flat, "chrom", "pos")) == 0
    rows[10], rows[30] = rows[30], rows[10]
    mixed = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "chrom string, pos long")
    want = sum(a[0] == b[0] and b[1] < a[1] for a, b in zip(rows, rows[1:]))
    report = ordered.order_report(mixed, "chrom", "pos")
    assert ordered.inversions(report) == want > 0 and report.agg(F.sum("n")).first()[0] == 80
    assert ordered.inversions(ordered.order_report(df.where("false"), "chrom", "pos")) == 0


@pytest.mark.parametrize("few, bins", [(10_000, 1024), (5, 4), (1, 16)])
def test_quantiles_by_selection(spark, few, bins):
    from phaseframe.operators.quantiles import quantiles

    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=501) ** 9, "b": np.repeat([2.0, 3.0], [400, 7]), "c": np.array([5.0]), None: rng.integers(0, 9, 90).astype(float), "e": np.array([-1.7e308, 1.7e308, 0.0])}
    rows = [(k, float(v)) for k, g in groups.items() for v in g] + [("a", None), ("b", float("nan")), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    wanted = {"low": 0.025, "mid": 0.5, "top": 1.0}
    got = {r["k"]: r for r in quantiles(df, ["k"], "v", wanted, bins, few).collect()}
    assert got.keys() == groups.keys()
    for k, g in groups.items():
        if k != "e":
            assert np.allclose([got[k][n] for n in wanted], np.quantile(g, list(wanted.values())), rtol=1e-12)
    assert got["e"]["mid"] == 0.0 and got["e"]["top"] == 1.7e308
    whole = quantiles(df.where("k = 'a'"), [], "v", wanted, bins, few).collect()
    assert len(whole) == 1 and np.isclose(whole[0]["mid"], np.median(groups["a"]))
    assert quantiles(df.where("false"), ["k"], "v", wanted, bins, few).count() == 0


def test_modification_tags_of_a_long_read_are_linear():
    import time

    from phaseframe.sources.text import _modified

    took = []
    for n in (10_000, 100_000):
        began = time.process_time()
        at, p = _modified("C+h,0;C+m" + ",1" * n + ";", "C,7" + ",128" * n, "GCTC" * n, True)
        took.append(time.process_time() - began)
        assert len(at) == n and at[:3].tolist() == [3, 7, 11] and set(p) == {0.5}
    assert took[1] < 40 * took[0] + 0.2


def test_a_deep_spot_is_dealt_out(spark):
    from phaseframe.operators import intervals

    rng = random.Random(8)
    reads = [("c", k, s := rng.randrange(2_000_000), s + rng.randint(1, 30_000)) for k in range(600)]
    reads += [("c", 1000 + k, 500_000 + k % 50, 500_200 + k % 70) for k in range(300)]  # a third on one bin
    points = [("c", rng.randrange(2_000_000)) for _ in range(200)] + [("c", 500_000 + 9 * k) for k in range(20)] + [("d", 5)]
    i = spark.createDataFrame(reads, "chrom string, rid long, start long, end long")
    p = spark.createDataFrame(points, "chrom string, at long")
    want = sorted((a, r) for c, a in points for d, r, s, e in reads if c == d and s <= a < e)
    for split, depth in ((None, 1), (["rid"], 40), (["rid"], 10**6)):
        got = intervals.points_in_intervals(p, i, "chrom", "at", "start", "end", split=split, depth=depth)
        assert got.columns == ["chrom", "at", "rid", "start", "end"]
        assert sorted((r["at"], r["rid"]) for r in got.collect()) == want
    binned = intervals._binned(i, "start", "end", intervals.BIN)
    _, dealt = intervals._split_deep(p.withColumn("__bin", F.lit(0).cast("long")), binned, "chrom", ["rid"], 40)
    assert binned.groupBy("chrom", "__bin").count().agg(F.max("count")).first()[0] > 300
    assert dealt.groupBy("chrom", "__bin", "__salt").count().agg(F.max("count")).first()[0] < 75
