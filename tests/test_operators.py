"""Literal cases and properties of the phasing operators."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phaseframe.config import PhasingConfig
from phaseframe.operators import cigar, decode, evaluate, haplotag, inference, intervals, methylation, ordered, realign, transitions
from phaseframe.operators import variants as vr

TINY = 1e-20

# one row per rule of the mirror table, (raw matrix, wanted); counts are raised by TINY
MIRROR = [
    ((1, 0, 0, 3), (3, 0, 0, 3)),
    ((3, 0, 0, 1), (3, 0, 0, 3)),
    ((5, 1, 2, 4), (5, 1, 1, 5)),
    ((1, 3, 9, 1), (1, 9, 9, 1)),
    ((0, 0, 0, 0), (0, 0, 0, 0)),
    ((2, 2, 2, 2), (0, 0, 0, 0)),
    ((5, 1, 3, 1), (5, 1, 1, 5)),
    ((3, 1, 5, 1), (1, 5, 5, 1)),
    ((1, 2, 1, 2), (0, 0, 0, 0)),
    ((4, 2, 5, 3), (4, 2, 2, 4)),
    ((2, 4, 4, 2), (2, 4, 4, 2)),
    ((3, 6, 2, 1), (3, 6, 2, 1)),
    # a single supporting read doesn't overrule several
    ((4, 2, 0, 1), (4, 2, 2, 4)),
    ((1, 0, 2, 4), (4, 2, 2, 4)),
]


def test_mirror_rules(spark):
    rows = [(k, *(x + TINY for x in raw)) for k, (raw, _) in enumerate(MIRROR)]
    df = spark.createDataFrame(rows, "idx int, t00 double, t01 double, t10 double, t11 double")
    got = {r["idx"]: (r["t00"], r["t01"], r["t10"], r["t11"]) for r in transitions.mirror(df).collect()}
    for k, (raw, want) in enumerate(MIRROR):
        assert got[k] == tuple(x + TINY for x in want), (raw, got[k])
        assert tuple(inference.mirror(np.array(raw, float).reshape(2, 2) + TINY).ravel()) == got[k]


def test_mirror_in_both_forms_on_all_small_counts(spark):
    cases = list(itertools.product(range(4), repeat=4))
    rows = [(k, *(x + TINY for x in c)) for k, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "idx int, t00 double, t01 double, t10 double, t11 double")
    for normalized in (False, True):
        x = transitions.normalize(df) if normalized else df
        raw = {r["idx"]: (r["t00"], r["t01"], r["t10"], r["t11"]) for r in x.collect()}
        got = {r["idx"]: (r["t00"], r["t01"], r["t10"], r["t11"]) for r in transitions.mirror(x, normalized).collect()}
        for k in raw:
            assert tuple(inference.mirror(np.array(raw[k]).reshape(2, 2), normalized).ravel()) == got[k]
        norm = transitions.normalize(transitions.mirror(x, normalized)).collect()
        assert all(abs(r["t00"] + r["t01"] - 1) < 1e-12 and r["t00"] == r["t11"] and r["t01"] == r["t10"] for r in norm)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 4)), min_size=1, max_size=12))
def test_parity_is_viterbi(chain):
    t = np.array([[[p / 10, 1 - p / 10], [1 - p / 10, p / 10]] if p != 5 else [[0.6, 0.4], [0.4, 0.6]] for p, _ in chain])
    switches = (t[:, 0, 1] > t[:, 0, 0]).astype(int)
    parity = [int(switches[k:].sum() % 2) for k in range(len(t))] + [0]
    assert decode.viterbi(t).tolist() == parity


def _chain(spark, states):
    """Variants 0.. and matrices between them: 'k' keep, 's' switch, 'u' uncertain."""
    cells = {"k": (0.9, 0.1, 0.1, 0.9), "s": (0.2, 0.8, 0.8, 0.2), "u": (0.5,) * 4}
    v = spark.createDataFrame([("c", k, 100 * k) for k in range(len(states) + 1)], "chrom string, idx long, pos long")
    m = spark.createDataFrame([("c", k, *cells[x]) for k, x in enumerate(states)], "chrom string, idx long, t00 double, t01 double, t10 double, t11 double")
    return v, m


def test_blocks_and_haplotypes(spark):
    v, m = _chain(spark, "kskuusk")
    got = [(r["block_id"], r["h0"], r["h1"]) for r in decode.haplotypes(decode.blocks(v, m)).orderBy("idx").collect()]
    assert got == [(0, 1, 0), (0, 1, 0), (0, 0, 1), (0, 0, 1), (1, -1, -1), (2, 1, 0), (2, 0, 1), (2, 0, 1)]
    sets = {r["idx"]: r["ps"] for r in decode.phase_sets(decode.haplotypes(decode.blocks(v, m))).collect()}
    assert sets == {0: 0, 1: 0, 2: 0, 3: 0, 5: 1, 6: 1, 7: 1}
    v, m = _chain(spark, "ku")  # the last block is phased even as a singleton
    assert [r["h0"] for r in decode.haplotypes(decode.blocks(v, m)).orderBy("idx").collect()] == [0, 0, 0]


def test_asymmetric_blocks_are_decoded_step_by_step(spark):
    v, m = _chain(spark, "ks")
    m = m.withColumn("t11", F.when(F.col("idx") == 1, 0.1).otherwise(F.col("t11")))
    got = {r["idx"]: r["h0"] for r in decode.viterbi_blocks(decode.blocks(v, m)).collect()}
    assert got == dict(enumerate(decode.viterbi(np.array([[[0.9, 0.1], [0.1, 0.9]], [[0.2, 0.8], [0.8, 0.1]]])).tolist()))


def test_adjacent_counts_rule(spark):
    rows = [("c", 1, 0, 0, True), ("c", 1, 1, 1, True), ("c", 1, 2, 1, False), ("c", 1, 3, 0, True), ("c", 1, 5, 0, True), ("c", 2, 0, -1, True), ("c", 2, 1, 0, True), ("c", 2, 2, 0, False)]
    df = spark.createDataFrame(rows, "chrom string, read_id long, idx long, state int, direct boolean")
    got = {r["idx"]: (r["n00"], r["n01"], r["n10"], r["n11"]) for r in transitions.adjacent_counts(df).collect()}
    assert got == {0: (0, 1, 0, 0), 1: (1, 0, 0, 1)}  # realigned then direct (2 to 3) never counts


def test_islands_and_dense_index(spark):
    df = spark.createDataFrame([("c", x) for x in (0, 1, 2, 5, 7, 8, 250_000)], "chrom string, idx long")
    got = sorted((r["first"], r["last"], r["n"]) for r in ordered.islands(df, "chrom", "idx").collect())
    assert got == [(0, 2, 3), (5, 5, 1), (7, 8, 2), (250_000, 250_000, 1)]
    assert ordered.islands(df.limit(0), "chrom", "idx").count() == 0
    pos = spark.createDataFrame([("c", p) for p in (5, 3_000_000, 999_999, 1_000_000, 5)], "chrom string, pos long").withColumn("t", F.monotonically_increasing_id())
    assert sorted((r["pos"], r["idx"]) for r in ordered.dense_index(pos, "chrom", "pos", ["t"]).collect()) == [(5, 0), (5, 1), (999_999, 2), (1_000_000, 3), (3_000_000, 4)]


def test_interval_joins_against_loops(spark):
    rng = np.random.default_rng(0)
    a = [("c", k, int(s), int(s + w)) for k, (s, w) in enumerate(zip(rng.integers(0, 400, 60), rng.integers(1, 80, 60)))]
    b = [("c", int(s), int(s + w)) for s, w in zip(rng.integers(0, 400, 60), rng.integers(1, 80, 60))]
    da = spark.createDataFrame(a, "chrom string, k int, s long, e long")
    db = spark.createDataFrame(b, "chrom string, bs long, be long")
    plain = sorted((k, x, y) for _, k, s, e in a for _, x, y in b if s < y and x < e)
    got = intervals.overlaps(da, db, "chrom", "s", "e", "bs", "be", width=16)
    assert sorted((r["k"], r["bs"], r["be"]) for r in got.collect()) == plain
    inside = intervals.overlaps(da, db, "chrom", "s", "e", "bs", "be", width=16, how="within")
    assert sorted((r["k"], r["bs"], r["be"]) for r in inside.collect()) == sorted((k, x, y) for _, k, s, e in a for _, x, y in b if x <= s and y >= e)
    points = da.select("chrom", F.col("k").alias("p"), F.col("s").alias("at"))
    hit = intervals.points_in_intervals(points, db, "chrom", "at", "bs", "be", width=16)
    assert hit.count() == sum(x <= s < y for _, _, s, _ in a for _, x, y in b)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    n = {r["k"]: r["n"] for r in evaluate.overlap_counts(da, db, "chrom", "s", "e", "bs", "be", ["k"]).collect()}
    assert n == {k: sum(s < y and x < e for _, x, y in b) for _, k, s, e in a}
    nxt = {r["k"]: r["v"] for r in intervals.first_at_or_after(da, db.select("chrom", F.col("bs").alias("v")), "chrom", "s", "v", width=16).collect()}
    assert nxt == {k: min((x for _, x, _ in b if x >= s), default=None) for _, k, s, _ in a}


CIGARS = ["5S10=1X3I20=", "10=2D10=", "20M", "3S4M2N5M1S", "4H6M", "8I"]


def test_cigar_cursors(spark):
    for c in CIGARS:
        import re

        ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", c)]
        pairs, q, r = {}, 0, 0
        for n, o in ops:
            if o in "M=X":
                pairs |= {r + k: q + k for k in range(n)}
            elif o in "DN":
                pairs |= {r + k: q for k in range(n)}
            q += n * (o in "M=XIS")
            r += n * (o in "M=XDN")
        df = cigar.with_offsets(spark.createDataFrame([(c, k) for k in range(-1, 45)], "cigar string, at int"))
        got = df.select("at", cigar.query_index(F.col("offs"), F.col("at")).alias("q")).collect()
        assert {x["at"]: x["q"] for x in got} == {k: pairs.get(k) for k in range(-1, 45)}, c


def test_allele_calls(spark):
    df = spark.createDataFrame([("ACGT", 30, 1), ("ACGT", 5, 1), ("ACGT", 30, 2)], "seq string, qual int, qpos int")
    got = [r[0] for r in df.select(cigar.call_snv(F.col("seq"), F.col("qual"), F.col("qpos"), F.lit("C"), F.lit("T"), 5)).collect()]
    assert got == [0, -1, None]  # a quality equal to the threshold is too low
    df = spark.createDataFrame([(0, "A", 1), (2, "AGT", 3), (2, "AGG", 3), (3, "AGT", 4)], "q int, alt string, nxt int")
    got = [r[0] for r in df.select(cigar.call_insertion(F.lit("CGTACG"), F.lit(0), F.col("nxt"), F.col("alt"))).collect()]
    assert got == [0, 1, None, None]
    df = spark.createDataFrame([(5, 5), (5, 3), (5, 4), (3, 5)], "r int, q int")
    assert [r[0] for r in df.select(cigar.call_deletion(F.col("r"), F.col("q"), F.lit("ACG"), F.lit("A"))).collect()] == [0, 1, None, 0]
    assert [r[0] for r in spark.createDataFrame([("ACCCCG",), ("ACCC",), ("NNNN",)], "s string").select(vr.is_homopolymer(F.col("s"))).collect()] == [True, False, True]


def _slow_score(query, ref, go, ge):
    """Semi-global affine alignment with explicit gap lengths."""
    n, m = len(query), len(ref)
    low = -(10**9)
    h = [[low] * (m + 1) for _ in range(n + 1)]
    h[0] = [0] * (m + 1)
    for i in range(1, n + 1):
        for j in range(m + 1):
            best = low
            if j:
                best = h[i - 1][j - 1] + (5 if query[i - 1] == ref[j - 1] else -4)
            best = max([best] + [h[i - k][j] - go - (k - 1) * ge for k in range(1, i + 1)])
            best = max([best] + [h[i][j - k] - go - (k - 1) * ge for k in range(1, j + 1)])
            h[i][j] = best
    return max(h[n])


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=9), st.text("ACGT", min_size=1, max_size=9), st.integers(2, 8), st.integers(1, 2))
def test_aligner_against_the_slow_one(query, ref, go, ge):
    assert realign.scores([query], [ref], [go], [ge])[0] == _slow_score(query, ref, go, ge)


def test_realigned_states(spark):
    rows = [(1, 0, "TTGACCA", "TTGA", "C", "G", "CA", 5, 1, False), (1, 1, "TTGAGCA", "TTGA", "C", "G", "CA", 5, 1, False), (1, 2, "TTGAACA", "TTGA", "C", "G", "CA", 5, 1, False)]
    df = spark.createDataFrame(rows, "read_id long, idx long, read_window string, left_flank string, allele_a string, allele_b string, right_flank string, gap_open int, gap_extend int, homopolymer boolean")
    assert {r["idx"]: r["state"] for r in realign.realigned_states(df).collect()} == {0: 0, 1: 1, 2: -1}


def test_equal_pairs_are_aligned_once(monkeypatch):
    aligned = []
    plain = realign.states
    monkeypatch.setattr(realign, "states", lambda *a: (aligned.append(len(a[0])), plain(*a))[1])
    base = ("TTGACCA", "TTGA", "C", "G", "CA", "CA", 5, 1, False)
    rows = [base, ("TTGAGCA", *base[1:]), ("TTGAACA", *base[1:]), (*base[:6], 7, 1, False)]
    known: dict = {}
    want = plain(*map(list, zip(*[r[:6] for r in rows])), *(np.array([r[k] for r in rows]) for k in (6, 7, 8)))
    assert realign.states_once(rows[:2] * 30, known).tolist() == want[:2].tolist() * 30
    assert realign.states_once(rows * 20, known).tolist() == want.tolist() * 20
    assert aligned == [2, 2]


def test_beliefs_equal_enumeration_on_a_chain():
    rng = np.random.default_rng(3)
    edges = {(k, k + 1): rng.integers(1, 9, (2, 2)).astype(float) for k in range(4)}
    got = inference.propagate(5, edges)
    median = np.median([t.sum(axis=1).max() for t in edges.values()])
    p = np.zeros((5, 2))
    for s in itertools.product((0, 1), repeat=5):
        if s[0]:
            continue
        w = 1.0
        for (i, j), t in edges.items():
            c = t.sum(axis=1).max()
            w *= (t / t.sum(axis=1, keepdims=True))[s[i], s[j]] ** (c / (c + median))
        for k, x in enumerate(s):
            p[k, x] += w
    assert np.allclose(got, p / p.sum(axis=1, keepdims=True), atol=1e-9)


def test_triples_agree_in_both_forms(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    for k in range(20):
        t = [inference.row_normal(rng.integers(1, 9, (2, 2)).astype(float)) for _ in range(3)]
        rows.append((k, *[x for m in t for x in m.ravel().tolist()]))
        want.append(np.concatenate([x.ravel() for x in inference.reestimate(*t)]))
    names = [f"{n}{c}" for n in "abc" for c in ("00", "01", "10", "11")]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} double" for n in names))
    out = [f"{n}{c}" for n in ("ab", "bc") for c in ("00", "01", "10", "11")]
    for r in transitions.reestimated_triples(df).collect():
        assert np.allclose([r[c] for c in out], want[r["k"]])


def test_connecting_over_a_long_and_a_short_run(spark):
    keep, flat = (0.9, 0.1, 0.1, 0.9), (0.5,) * 4
    step = [("c", 1, 12, "step", i, i + 1, *(flat if i in (4, 5, 6) else keep)) for i in range(10)]
    pair = [("c", 1, 12, "pair", 4, 7, 6.0, 0.0, 1.0, 7.0)]
    rows = step + pair + [("c", 1, 12, "run", 4, 6, None, None, None, None)]
    short = [("c", 2, 12, "step", i, i + 1, *(flat if i == 4 else keep)) for i in range(2, 8)] + [("c", 2, 12, "pair", 3, 5, 5.0, 0.0, 0.0, 5.0), ("c", 2, 12, "run", 4, 4, None, None, None, None)]
    schema = "chrom string, cluster long, total int, variants int, kind string, i long, j long, t00 double, t01 double, t10 double, t11 double"
    numbered = lambda rs: [(*r[:3], 12, *r[3:]) for r in rs + [(*rs[0][:3], "at", i, i, None, None, None, None) for i in range(12)]]
    rows, short = numbered(rows), numbered(short)
    long = {r["p_idx"]: r for r in inference.connect(spark.createDataFrame(rows, schema)).collect()}
    assert {p for p, r in long.items() if r["drop"]} == {5, 6} and long[4]["t00"] > 0.8
    got = {r["p_idx"]: r for r in inference.connect(spark.createDataFrame(short, schema)).collect()}
    assert got and all(not r["drop"] for p, r in got.items() if p < 4)


def test_methylation_assignment_separates_planted_groups(spark):
    truth = np.arange(24) % 2  # a read must be almost certain over all differing sites together
    p = np.where((truth[:, None] + np.arange(15)[None, :]) % 2 == 1, 0.9995, 0.0005)
    hap = np.full(24, -1)
    hap[:6] = truth[:6]
    assert (methylation.assign_reads_in_region(p, hap) == truth).all()
    rows = [(1, k, s, float(p[k, s]), int(hap[k])) for k in range(24) for s in range(15)]
    got = {r["read_id"]: r["hap"] for r in methylation.assign_reads(spark.createDataFrame(rows, "region_id long, read_id long, site long, p double, hap int")).collect()}
    assert got == dict(enumerate(truth.tolist()))


def test_haplotag_falls_back_to_methylation(spark):
    haps = spark.createDataFrame([("c", k, 0, k % 2, 1 - k % 2) for k in range(6)], "chrom string, idx long, block_id long, h0 int, h1 int")
    obs = spark.createDataFrame([("c", 1, k, k % 2) for k in range(3)] + [("c", 2, k, 1 - k % 2) for k in range(2)] + [("c", 3, 0, 0), ("c", 3, 1, 0)], "chrom string, read_id long, idx long, state int")
    direct = haplotag.tags(haplotag.read_llr(obs, haps))
    assert {r["read_id"]: r["hp"] for r in direct.collect()} == {1: 1, 2: 2, 3: None}
    assigned = spark.createDataFrame([("c", 3, 1, 0, 1, 1, 0), ("c", 4, 2, 0, 0, 1, 0)], "chrom string, read_id long, hap int, a_idx long, a_state int, b_idx long, b_state int")
    both = haplotag.combined_tags(direct, haplotag.methylation_tags(assigned, haps))
    assert {r["read_id"]: r["hp"] for r in both.collect()} == {1: 1, 2: 2, 3: 2, 4: None}


@pytest.mark.parametrize("lengths, want", [([10], 10), ([1, 2, 3, 4], 3), ([5, 5, 5], 5), ([100, 1, 1], 100)])
def test_n50(spark, lengths, want):
    df = spark.createDataFrame([("c", x) for x in lengths], "chrom string, l long")
    assert evaluate.block_n50(df, ["chrom"], F.col("l")).first()["n50"] == want


def test_config():
    assert PhasingConfig.for_technology("ont").flank_indel == 200 and PhasingConfig().flank_snv == 33
    with pytest.raises(ValueError):
        PhasingConfig(technology="other")
    assert math.isclose(PhasingConfig().error_rate, 1e-3)


def test_plan_decodes_asymmetric_blocks(spark, monkeypatch):
    """Blocks of the plan with asymmetric matrices against all paths, rows being the states stepped to."""
    from itertools import product

    from phaseframe.config import PhasingConfig
    from phaseframe.plans import pipeline

    cells = [(0.6, 0.4, 0.1, 0.9), (0.2, 0.8, 0.7, 0.3), (0.5, 0.5, 0.5, 0.5), (0.9, 0.1, 0.6, 0.4), (0.3, 0.7, 0.9, 0.1)]
    variants = spark.createDataFrame([("c", k, 100 * k, "SNP") for k in range(6)], "chrom string, idx long, pos long, vtype string")
    obs = spark.createDataFrame([("c", r, k, r % 2, True) for r in range(8) for k in range(6)], "chrom string, read_id long, idx long, state int, direct boolean")
    schema = "chrom string, idx long, drop boolean, t00 double, t01 double, t10 double, t11 double"
    changes = spark.createDataFrame([("c", k, False, *x) for k, x in enumerate(cells)], schema)
    monkeypatch.setattr(pipeline, "rephased", lambda *a: changes.where("drop").drop("drop"))
    monkeypatch.setattr(pipeline, "connected", lambda *a: changes)
    got = {r["idx"]: (r["h0"], r["h1"]) for r in pipeline.phase(variants, obs, PhasingConfig()).collect()}
    t = np.array(cells).reshape(-1, 2, 2)
    for at, n in ((0, 3), (3, 3)):
        best = max(product((0, 1), repeat=n), key=lambda h: sum(np.log(t[at + k][h[k + 1], h[k]]) for k in range(n - 1)))
        assert [got[at + k] for k in range(n)] == [(h, 1 - h) for h in best]


def test_as_of_join_takes_each_bin_once_and_crosses_stretches(spark):
    right = [3, 70, 4_000, 900_000, 2_000_000]
    left = [0, 3, 4, 71, 5_000, 899_999, 900_001, 1_999_999, 2_000_000, 2_000_001]
    da, db = spark.createDataFrame([("c", v) for v in left], "chrom string, at long"), spark.createDataFrame([("c", v) for v in right], "chrom string, v long")
    joined = intervals.first_at_or_after(da, db, "chrom", "at", "v", width=16)
    assert {r["at"]: r["v"] for r in joined.collect()} == {x: min((v for v in right if v >= x), default=None) for x in left}
    # a frame that shrinks is summed up anew for each row
    assert "unboundedfollowing" not in joined._jdf.queryExecution().toString().lower()


def test_width_of_bins_follows_the_intervals(spark):
    made = lambda sizes: spark.createDataFrame([(10, 10 + n) for n in sizes], "a long, b long")
    assert intervals.usual_width(made([290, 300, 310]), "a", "b") == 300
    assert intervals.usual_width(made([1]), "a", "b") == 64
    assert intervals.usual_width(made([10**9]), "a", "b") == intervals.usual_width(made([]), "a", "b") == intervals.BIN


def test_blocks_are_dealt_out_by_number(spark, monkeypatch):
    """A block's chunks are few bytes: without a number of their own all blocks would be scanned in one task."""
    rows = [("c", 10 * b + k, 10 * b + k, int(k == 0), b, 0.6, 0.4, 0.1, 0.9) for b in range(6) for k in range(10)]
    blocked = spark.createDataFrame(rows, "chrom string, p_idx long, idx long, breaks long, block_id long, t00 double, t01 double, t10 double, t11 double")
    plans, write = {}, decode.cut
    monkeypatch.setattr(decode, "cut", lambda df, name: (plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}), write(df, name))[1])
    out = decode.viterbi_blocks(blocked, chunk=4)
    assert out.count() == 60 and "RepartitionByExpression" in plans["scored"]
    assert "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString()
