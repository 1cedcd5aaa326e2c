"""Long methylation regions as tables: the rows of one matrix a region."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from phaseframe.plans import methylation


def planted(rng, n_reads, n_sites, n_layers):
    """Reads of two haplotypes over a region's sites and variants; few of them carry the first two variants."""
    top = 100 * n_sites
    sites = pd.DataFrame({"site_start": np.arange(n_sites) * 100 + 50})
    sites = sites.assign(site_end=sites.site_start + 1, coverage=20, mod_count=10, ratio=50.0)
    variant_at = np.linspace(60, top - 60, n_layers).astype(int)
    truth = rng.integers(0, 2, n_layers)
    kind = rng.integers(0, 3, n_sites)  # sites of no use: methylated on both
    reads = []
    for k in range(n_reads):
        hap, start = int(rng.integers(0, 2)), int(rng.integers(0, max(top - 900, 1)))
        end = start + int(rng.integers(300, 900))
        cigar = f"5S{(end - start) // 2}M3I{end - start - (end - start) // 2}M"
        half = (end - start) // 2
        at, p = [], []
        for j, pos in enumerate(sites.site_start):
            if start <= pos < end and rng.random() < 0.9:
                high = kind[j] == 2 or (kind[j] == hap)
                high = high if rng.random() < 0.97 else not high
                off = pos - start
                at.append(5 + off + (3 if off >= half else 0))
                p.append(float(rng.uniform(0.95, 0.999) if high else rng.uniform(0.001, 0.05)))
        layers = [int(i) for i, v in enumerate(variant_at) if start <= v < end]
        states = [int(truth[i] ^ hap) if rng.random() < 0.9 else -1 for i in layers]
        reads.append((f"r{k}", start, end, cigar, at, p, layers or None, states if layers else None))
    return pd.DataFrame(reads, columns=["read_id", "read_start", "read_end", "cigar", "call_at", "call_p", "layers", "states"]), sites, [10 + 3 * i for i in range(n_layers)]


def row_of(r):
    near = lambda v: None if v is None or v != v else round(float(v), 9)
    return tuple(near(r[c]) if c in ("t00", "t01", "t10", "t11", "ratio") else (None if r[c] is None or r[c] != r[c] else r[c] if isinstance(r[c], str) else int(r[c])) for c in methylation._NAMES if c not in ("chrom", "region_id"))


def test_large_regions_as_matrices(spark):
    rng = np.random.default_rng(7)
    want, reads_rows, site_rows = [], [], []
    for region, shape in enumerate([(60, 30, 9), (200, 120, 14), (40, 10, 5), (5, 4, 5)]):
        reads, sites, idxs = planted(rng, *shape)
        rows = methylation.region_result(reads, sites, idxs, 1)
        blank = dict.fromkeys(methylation._NAMES)
        want += [(region, *row_of(blank | r)) for r in rows]
        reads_rows += [("c", region, *(v if v is not None else None for v in r), idxs) for r in reads.itertuples(index=False)]
        site_rows += [("c", region, int(s.site_start), int(s.site_end), 20, 10, 50.0) for s in sites.itertuples(index=False)]
    schema = "chrom string, region_id long, read_id string, read_start long, read_end long, cigar string, call_at array<int>, call_p array<double>, layers array<int>, states array<int>, idxs array<long>"
    reads = spark.createDataFrame([tuple(r) for r in reads_rows], schema).repartition(5).withColumn("rid", F.monotonically_increasing_id())
    own = spark.createDataFrame(site_rows, "chrom string, region_id long, site_start long, site_end long, coverage int, mod_count int, ratio double")
    out = methylation.large_regions(methylation.cut(reads, "reads"), own, 1)
    assert out.columns == methylation._NAMES
    got = [(r["region_id"], *row_of(r.asDict())) for r in out.collect()]
    order = lambda rows: sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
    assert order(got) == order(want)
    kinds = {k: sum(r[1] == k for r in got) for k in ("assign", "step", "site")}
    assert kinds["assign"] > 80 and kinds["step"] > 3 and kinds["site"] > 100, kinds


def test_probabilities_of_all_reads_of_a_region_as_one_by_one():
    rng = np.random.default_rng(3)
    for shape in [(60, 30, 9), (1, 40, 5), (30, 1, 5)]:
        reads, sites, _ = planted(rng, *shape)
        odd = [("x", 10, 40, "8I", [1], [0.5], None, None), ("y", 10, 60, "20M5D25M", [], [], None, None), ("z", 10**6, 10**6 + 9, "9M", [0, 8], [0.1, 0.9], None, None)]
        reads = pd.concat([reads, pd.DataFrame(odd, columns=reads.columns)], ignore_index=True)
        at = sites["site_start"].to_numpy(np.int64)
        want = [methylation.site_probabilities((r.read_start, r.read_end, r.cigar, np.asarray(r.call_at, np.int64), np.asarray(r.call_p, float)), at) for r in reads.itertuples()]
        np.testing.assert_array_equal(methylation.region_probabilities(reads, at), np.array(want))
    assert np.isfinite(want).any()


def dense_assignment(p, hap):
    """The rounds on whole matrices, reads x sites."""
    hap, known = hap.copy(), ~np.isnan(p)
    fill = np.where(known, p, 0.5)
    lp, lq = (np.where(known, np.log10(x + 1e-20), 0.0) for x in (fill, 1 - fill))
    for _ in range(100):
        free = hap == -1
        sums = [(lp[hap == h].sum(axis=0), lq[hap == h].sum(axis=0)) for h in (0, 1)]
        call = [(m > np.log10(0.5)) & (m - u > 3) for m, u in sums]
        differ = call[0] != call[1]
        x, y = (((np.where(c, lp + m, lq + u) * known)[:, differ]).sum(axis=1) for c, (m, u) in zip(call, sums))
        new = np.where((x > y) & (x > np.log10(0.5)), 0, np.where((y > x) & (y > np.log10(0.5)), 1, -1))
        if (new[free] == -1).all():
            return hap
        hap = np.where(free, new, hap)
    return hap


def test_regions_take_their_pairs_and_tell_of_a_site_once():
    rng = np.random.default_rng(11)
    repeated = 0
    for shape in [(60, 30, 9), (200, 120, 14), (150, 400, 40)]:
        reads, sites, idxs = planted(rng, *shape)
        at = sites["site_start"].to_numpy(np.int64)
        p, (read, site, known) = methylation.region_probabilities(reads, at), methylation.region_pairs(reads, at)
        assert len(known) == np.isfinite(p).sum() and len(known) < p.size / 2
        start = rng.choice([-2, -1, -1, -1, 0, 1], len(reads))
        np.testing.assert_array_equal(methylation.meth.assign_pairs_in_region(read, site, known, len(at), start), dense_assignment(p, start))
        every, once = (methylation.region_table(reads, sites, idxs, 1, once=k) for k in (False, True))
        rows = lambda t: [row_of(r) for r in t.to_dict("records")]
        assert set(rows(every)) == set(rows(once)) and len(set(rows(once))) == len(once)
        repeated += len(every) - len(once)
    assert repeated > 100
