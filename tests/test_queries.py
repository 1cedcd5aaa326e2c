"""Registered phasing queries against their SQL on the smallest tables."""

import re

import duckdb
import pytest

from phaseframe.operators import inference, realign
from phaseframe.plans import catalogue, catalogue_more, catalogue_reads, catalogue_sites  # noqa: F401
from verify import TABLES, canonical


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, con, tiny, name):
    df = catalogue.QUERIES[name](spark, tiny)
    rel = con.sql(catalogue.ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), rel.columns)


def plain_score(query, ref, gap_open, gap_extend):
    """Best score of the whole query in the reference, cell by cell."""
    low, n = -(10**9), len(ref)
    h, down = [0] * (n + 1), [low] * (n + 1)
    for c in query:
        new, across, best = [], low, low
        for j in range(n + 1):
            down[j] = max(h[j] - gap_open, down[j] - gap_extend)
            diag = h[j - 1] + (5 if ref[j - 1] == c else -4) if j else low
            across = max(best - gap_open, across - gap_extend) if j else low
            best = max(diag, down[j])
            new.append(max(best, across))
            best = new[-1]
        h = new
    return max(h)


def test_realigned_states_against_a_loop(spark, tiny):
    from phaseframe.plans.catalogue_sites import _seqs

    rows = {r["read_id"]: r for r in _seqs(spark, tiny).collect()}
    got = {r["read_id"]: r["state"] for r in catalogue.QUERIES["realigned_states"](spark, tiny).collect()}
    for k in sorted(rows)[:150]:
        r = rows[k]
        window, left, right = r["seq"][2:19], r["seq"][: r["qpos"]], r["seq"][r["qpos"] + 1 :]
        run = any(r["seq"][i] * 4 == r["seq"][i : i + 4] for i in range(21))
        a, b = (plain_score(window, left + x + right, 10 - 2 * run, 1) for x in (r["a"], r["b"]))
        assert got[k] == (0 if a > b else 1 if b > a else -1), (k, a, b)


def test_assigned_reads_against_a_loop(spark, tiny):
    """Rounds of read assignment with plain sums instead of arrays."""
    import math
    from collections import defaultdict

    from phaseframe.plans.catalogue_sites import _probs

    regions = defaultdict(lambda: defaultdict(dict))
    for r in _probs(spark, tiny).orderBy("p").collect():
        regions[r["region_id"]][r["read_id"]].setdefault(r["site"], []).append(r["p"])
    got = {(r["region_id"], r["read_id"]): r["hap"] for r in catalogue.QUERIES["methyl_assign"](spark, tiny).collect()}
    assert set(got) == {(g, r) for g, reads in regions.items() for r in reads}
    log = lambda p: (math.log10(p + 1e-20), math.log10(1 - p + 1e-20))
    for g, reads in regions.items():
        if any(len(ps) > 1 for sites in reads.values() for ps in sites.values()):
            continue  # which of several calls counts isn't defined
        hap = {r: (r if r < 2 else -1) for r in reads}
        while any(h < 0 for h in hap.values()):
            sums = [{s: tuple(sum(log(reads[r][s][0])[k] for r in reads if hap[r] == h and s in reads[r]) for k in (0, 1)) for s in {s for x in reads.values() for s in x}} for h in (0, 1)]
            on = [{s: m > math.log10(0.5) and m - u > 3 for s, (m, u) in x.items()} for x in sums]
            differ = [s for s in on[0] if on[0][s] != on[1][s]]
            new = {}
            for r in (r for r in reads if hap[r] < 0):
                score = [sum(log(reads[r][s][0])[0 if on[h][s] else 1] + sums[h][s][0 if on[h][s] else 1] for s in differ if s in reads[r]) for h in (0, 1)]
                for h in (0, 1):
                    if score[h] > score[1 - h] and score[h] > math.log10(0.5):
                        new[r] = h
            if not new:
                break
            hap |= new
        assert {r: got[g, r] for r in reads} == hap


def test_beliefs_on_trees_are_exact():
    """On a chain, sums over all paths give the beliefs that messages end with."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    for n in (2, 4, 6):
        edges = {(i, i + 1): rng.integers(1, 30, (2, 2)).astype(float) for i in range(n - 1)}
        cover = {e: t.sum(axis=1).max() for e, t in edges.items()}
        middle = np.median(list(cover.values()))
        factor = {e: (t / t.sum(axis=1, keepdims=True)) ** (cover[e] / (cover[e] + middle)) for e, t in edges.items()}
        want = np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=n):
            if path[0] == 0:
                p = np.prod([factor[i, i + 1][path[i], path[i + 1]] for i in range(n - 1)])
                want[np.arange(n), path] += p
        want /= want.sum(axis=1, keepdims=True)
        assert np.allclose(inference.propagate(n, edges), want, atol=1e-8)


def test_first_fit_rows(spark, tiny):
    rows = {r["suppkey"]: r["row"] for r in catalogue.QUERIES["first_fit_rows"](spark, tiny).collect()}
    from phaseframe import fixtures as fx

    placed = []
    for g in sorted(fx.genes(spark, tiny).collect(), key=lambda g: (g["gene_start"], g["gene_end"], g["suppkey"])):
        free = next(k for k in range(99) if all(k != row or end <= g["gene_start"] for row, end in placed))
        assert rows[g["suppkey"]] == free
        placed.append((free, g["gene_end"]))


def test_full_plan_recovers_the_planted_phase(spark, tiny):
    """Neighbours of a block have the planted orientation, but for the planted read errors."""
    from phaseframe import fixtures as fx

    out = catalogue.QUERIES["full_pipeline"](spark, tiny).join(fx.variants(spark, tiny).select("idx", "truth"), "idx").where("h0 >= 0").toPandas().sort_values("idx")
    assert len(out) > 150
    orient = (out.h0 + out.truth) % 2
    same = [a == b for (x, a), (y, b) in zip(zip(out.block_id, orient), list(zip(out.block_id, orient))[1:]) if x == y]
    assert sum(same) / len(same) > 0.97


def test_every_read_is_realigned(spark, con, tiny):
    got = [r["read_id"] for r in catalogue.QUERIES["realigned_states"](spark, tiny).select("read_id").collect()]
    assert sorted(got) == [r[0] for r in con.sql("SELECT o_orderkey FROM orders ORDER BY 1").fetchall()]


#: No read links the variants beside two empty blocks of forty, and none covers the last block; the last variant of a phase block is on
#: haplotype 0. On the smallest tables some links are too thin for that.
PLANTED = """planted AS (SELECT chrom, idx, pos, b, truth, (b + 20) // 40 + CASE WHEN b = max(b) OVER () THEN 1 ELSE 0 END AS block_id FROM bv),
ends AS (SELECT *, last_value(truth) OVER (PARTITION BY chrom, block_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_truth FROM planted)
SELECT chrom, idx, pos, block_id, (truth + last_truth) % 2 AS h0, 1 - (truth + last_truth) % 2 AS h1 FROM ends"""


def test_alignments_are_phased_as_planted(spark):
    """Every variant of both chromosomes, from CIGARs and sequences to haplotypes."""
    from phaseframe.plans.catalogue_reads import _BV

    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("orders", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want = sorted(c.sql(f"WITH {_BV}, {PLANTED}").fetchall())
    got = sorted(tuple(r) for r in catalogue.QUERIES["phase_from_alignments"](spark, folder).select("chrom", "idx", "pos", "block_id", "h0", "h1").collect())
    assert got == want and len(got) > 900


def test_reads_of_a_small_file_are_dealt_out(spark):
    from phaseframe import fixtures as fx

    for made in (fx.reads, fx.block_reads, fx.block_modified_reads):
        assert made(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_looked_up_reads_are_those_of_the_sql(spark, tiny):
    from phaseframe import fixtures as fx

    want = fx._sql(spark, fx.BLOCK_READS, orders=fx._orders(spark, tiny))
    made = fx._made_reads(spark, tiny)
    got = made.drop("sites")
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    for r in made.where("ok % 7 = 0").collect():  # calls are on cytosines, or on what the variant's neighbours leave of them
        assert [r["seq"][q] for q in r["sites"]] == [fx.BLOCK[at] for _ in range(3) for at in fx.METHYLATED]
    # the cases written out make a method of more than 8,000 bytes, which the JVM's compiler leaves out
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", fx.block_reads(spark, tiny)._jdf.queryExecution().explainString(mode))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000, sizes


def test_sites_and_reference_arent_taken_for_small_tables(spark, tiny):
    """Rows exploded from one row count as one: sites of any number were sent to the driver and all executors."""
    from phaseframe import fixtures as fx

    sites = fx.block_methylation_sites(spark, tiny)
    rows, n = sites.collect(), fx.n_blocks(spark, tiny)
    want = {(c, 100 * b + k, 100 * b + k + 1, 16 + 2 * (b % 10), 8 + b % 10, 8 + b % 10, 50.0) for c in ("chr1", "chr2") for b in range(n) for k in fx.METHYLATED}
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert int(str(sites._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 20 * len(rows)
    text = "".join(r["seq"] for r in fx.block_reference(spark, tiny, 1000).where("chrom = 'chr2'").orderBy("chunk_no").collect())
    assert text == fx.BLOCK * n
