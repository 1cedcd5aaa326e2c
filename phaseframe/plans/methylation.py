"""Phasing over gaps by methylation: regions around uncertain transitions, read assignment, new transitions.

A region is a run of uncertain transitions with two phaseable variants before it and two
after. Its reads, their alleles at the region's variants and their methylation at intermediate
sites are gathered by region. Regions are independent. A region of up to ``MATRIX_CELLS`` reads times
sites is one matrix in one task. Larger ones, stretches that reads hardly phase, are worked on all at once
as tables of single probabilities: each round adds what the reads that have just been assigned
contribute to the sums of their haplotype by site, and scores the reads that are still free. No
read is left out and none of their groups is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.config import PhasingConfig
from phaseframe.operators import cigar, inference, ordered, transitions
from phaseframe.operators import methylation as meth
from phaseframe.operators.intervals import overlaps, points_in_intervals, usual_width
from phaseframe.sources.checkpoints import cut

_RESULT = (
    "kind string, chrom string, region_id long, read_id string, hap int, a_idx long, a_state int, b_idx long, b_state int, idx long,"
    " t00 double, t01 double, t10 double, t11 double, site_start long, site_end long, coverage int, mod_count int, ratio double"
)
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def uncertain_steps(phaseable: DataFrame, matrix: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """Uncertain transitions between phaseable variants: chrom, p_idx, idx. Those from the last two variants of a chromosome aren't looked at."""
    p = ordered.dense_index(phaseable.select("chrom", "idx"), "chrom", "idx", [], "p_idx", 100_000)
    top = (phaseable if variants is None else variants).groupBy("chrom").agg(F.max("idx").alias("top"))
    unsure = matrix.where(transitions.uncertain()).select("chrom", "idx")
    return p.join(unsure, ["chrom", "idx"], "left_semi").join(top, "chrom").where(F.col("idx") < F.col("top") - 1).select("chrom", "p_idx", "idx")


def filled(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per chromosome: uncertain transitions before and how many of them have been filled; both from ``uncertain_steps``."""
    x = before.groupBy("chrom").agg(F.count("*").alias("n_uncertain"))
    y = after.groupBy("chrom").agg(F.count("*").alias("left"))
    return x.join(y, "chrom", "left").select("chrom", "n_uncertain", (F.col("n_uncertain") - F.coalesce("left", F.lit(0))).alias("n_filled"))


def regions(phaseable: DataFrame, matrix: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """chrom, region_id, a, b (p_idx of the outermost variants), pos_a, pos_b."""
    p = ordered.dense_index(phaseable.select("chrom", "idx", "pos"), "chrom", "idx", [], "p_idx", 100_000)
    last = p.groupBy("chrom").agg(F.max("p_idx").alias("last_p"))
    runs = ordered.islands(uncertain_steps(phaseable, matrix, variants), "chrom", "p_idx")
    x = runs.join(last, "chrom").select("chrom", F.col("first").alias("region_id"), (F.col("first") - 2).alias("a"), (F.col("last") + 2).alias("b"), "last_p")
    x = x.where("a >= 0 AND b <= last_p").drop("last_p")
    at = lambda k: p.select("chrom", F.col("p_idx").alias(k), F.col("pos").alias(f"pos_{k}"))
    return x.join(at("a"), ["chrom", "a"]).join(at("b"), ["chrom", "b"]).select("chrom", "region_id", "a", "b", "pos_a", "pos_b")


def region_reads(found: DataFrame, alignments: DataFrame, margin: int) -> DataFrame:
    """Alignments that touch a region widened by the margin, with region_id."""
    r = found.select("chrom", "region_id", (F.greatest(F.col("pos_a") - margin, F.lit(0))).alias("__from"), (F.col("pos_b") + margin + 1).alias("__to"))
    return overlaps(alignments, r, "chrom", "read_start", "read_end", "__from", "__to").drop("__from", "__to")


def site_probabilities(read: tuple, sites: np.ndarray) -> np.ndarray:
    """Probabilities of modification of a read at reference positions, NaN where no called base is aligned.

    read: read_start, read_end, CIGAR, query indices of calls (sorted) and their probabilities.
    """
    start, end, text, at, p = read
    out = np.full(len(sites), np.nan)
    ops = cigar._offset_lists([text]).flatten()
    kinds = np.array(ops.field("op").to_pylist())
    size, q, r = (ops.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("len", "q", "r"))
    aligned = np.flatnonzero(np.isin(kinds, ["M", "=", "X"]))
    inside = np.flatnonzero((sites >= start) & (sites <= end))
    if not len(aligned) or not len(inside) or not len(at):
        return out
    off = sites[inside] - start
    k = np.searchsorted(r[aligned], off, side="right") - 1
    op = aligned[np.maximum(k, 0)]
    hit = (k >= 0) & (off < r[op] + size[op])
    query = q[op] + off - r[op]
    near = np.minimum(np.searchsorted(at, query), len(at) - 1)
    hit &= at[near] == query
    out[inside[hit]] = p[near[hit]]
    return out


def region_probabilities(reads: pd.DataFrame, at: np.ndarray) -> np.ndarray:
    """``region_pairs`` as a matrix, reads x sites, NaN where nothing is known."""
    out = np.full((len(reads), len(at)), np.nan)
    read, site, p = region_pairs(reads, at)
    out[read, site] = p
    return out


def region_pairs(reads: pd.DataFrame, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``site_probabilities`` of many reads at sites in order, where they are known: number of the read, number of the site,
    probability, by read and site. Operations, calls and pairs of read and site lie one behind another, keyed by read, and
    are placed by a search of sorted keys."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    start, end = (reads[c].to_numpy(np.int64) for c in ("read_start", "read_end"))
    low, high = np.searchsorted(at, start, side="left"), np.searchsorted(at, end, side="right")
    n = np.maximum(high - low, 0)
    if not n.sum():
        return none
    read = np.repeat(np.arange(len(reads)), n)
    site = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    off = at[site] - start[read]
    owner, op, size, q, r = cigar.flat_operations(reads["cigar"].tolist())
    aligned = np.isin(op, ["M", "=", "X"])
    owner, size, q, r = owner[aligned], size[aligned], q[aligned], r[aligned]
    sizes = [0 if c is None else len(c) for c in reads["call_at"]]
    if not len(owner) or not sum(sizes):
        return none
    width = int(max(off.max(), r.max())) + 1
    k = np.searchsorted(owner * width + r, read * width + off, side="right") - 1
    on = np.maximum(k, 0)
    hit = (k >= 0) & (owner[on] == read) & (off < r[on] + size[on])
    read, site, query = read[hit], site[hit], (q[on] + off - r[on])[hit]
    whole = lambda c, kind: np.concatenate([np.asarray(v, kind) for v in reads[c] if v is not None])
    calls, p = whole("call_at", np.int64), whole("call_p", float)
    width = int(max(query.max(initial=0), calls.max())) + 1
    keys, wanted = np.repeat(np.arange(len(reads)), sizes) * width + calls, read * width + query
    near = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = (keys[near] == wanted) & ~np.isnan(p[near])
    return read[hit], site[hit], p[near[hit]]


#: Reads times sites that a region may have to be worked on as one matrix.
MATRIX_CELLS = 20_000_000


def _pattern_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The two anchor haplotypes from reads' states at the first two variants; see ``methylation.anchor_patterns``."""
    known = first[(first != -1).any(axis=1)]
    return _pattern(*np.unique(known, axis=0, return_counts=True)) if len(known) else None


def _pattern(found: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from the patterns and their numbers."""
    order = sorted(range(len(found)), key=lambda k: (-n[k], *found[k]))
    a = found[order[0]].copy()
    if len(order) == 1:
        return a, np.where(a >= 0, 1 - a, -1)
    clash = lambda k: bool(((found[k] == a) & (a != -1)).any())
    b = found[next((k for k in order[1:] if not clash(k)), order[-1])].copy()
    a, b = np.where((a == -1) & (b >= 0), 1 - b, a), np.where((b == -1) & (a >= 0), 1 - a, b)
    return a, b


def _fits(states: np.ndarray, hap: np.ndarray) -> np.ndarray:
    """Reads that have the haplotype's alleles at both variants, or at one and none at the other."""
    same = [(states[:, k] == hap[k]) for k in (0, 1)]
    part = [same[k] & (hap[k] != -1) & (states[:, 1 - k] == -1) for k in (0, 1)]
    return (same[0] & same[1]) | part[0] | part[1]


def _hap_transition(f_a: float, f_b: float) -> np.ndarray:
    """Transition of one haplotype from the share of alternative alleles at both ends; see ``methylation.fraction_transitions``."""
    tiny, a, b = 1e-20, int(np.round(f_a)), int(np.round(f_b))
    left = 1 - f_a if (a, b) == (0, 1) else f_a
    right = 1 - f_b if (a, b) == (1, 0) else f_b
    q = max(left, tiny) * max(right, tiny)
    t = np.full((2, 2), tiny)
    t[a, b if a != b or a else 1] = q
    t[a, 1 - (b if a != b or a else 1)] = max(1 - q, tiny)
    return inference.mirror(t, True)


def region_table(reads: pd.DataFrame, sites: pd.DataFrame, idxs: list[int], min_allele_count: int, once: bool = False) -> pd.DataFrame:
    """Assignments, differing sites and new transitions of one region. A site is told of by each round in which it differs; with
    ``once`` only by those after which its row has changed.

    reads: read_id, read_start, read_end, cigar, call_at, call_p, layers, states. sites: site_start, site_end,
    coverage, mod_count, ratio, in order.
    """
    n = len(idxs)
    states = np.full((len(reads), n), -1)
    whole = [k for k, v in enumerate(reads["layers"]) if v is not None and len(v)]
    if whole:
        lists = [reads[c].to_numpy()[whole] for c in ("layers", "states")]
        layers, own = (np.concatenate([np.asarray(v, int) for v in x]) for x in lists)
        states[np.repeat(whole, [len(v) for v in lists[0]]), layers] = own
    both = _pattern_of(states[:, :2])
    if both is None:
        return pd.DataFrame(columns=_NAMES)
    at = sites["site_start"].to_numpy(np.int64)
    read, site, p = region_pairs(reads, at)
    hap = np.where((states[:, :2] == -1).all(axis=1), -1, -2)
    for h in (1, 0):  # a read that fits both counts for the first
        hap[_fits(states, both[h])] = h
    log: list = []
    hap = meth.assign_pairs_in_region(read, site, p, len(at), hap, log=log)
    done = hap >= 0
    own = np.where(hap == 1, 1, 0)[done]
    out = [{"kind": "assign", "read_id": reads["read_id"].to_numpy()[done], "hap": hap[done] + 1, "a_idx": idxs[0], "a_state": np.array(both)[own, 0], "b_idx": idxs[1], "b_state": np.array(both)[own, 1]}]
    told = np.full((3, len(at)), -1)  # coverage by haplotype when last told; it only grows, with the reads themselves
    parts: list[tuple] = []
    for differ, before in log:
        for h in (0, 1):
            on = before[read] == h
            cover, mod = (np.bincount(x, minlength=len(at))[differ] for x in (site[on], site[on & (p > 0.5)]))
            new = told[h, differ] != cover if once else slice(None)
            told[h, differ] = cover
            ratio = np.where(cover > 0, 100.0 * mod / np.maximum(cover, 1), np.nan)
            parts.append((np.full(len(cover), h + 1)[new], differ[new], cover[new], mod[new], ratio[new]))
        new = differ[told[2, differ] < 0] if once else differ
        told[2, differ] = 0
        parts.append((np.zeros(len(new), np.int64), new, *(sites[c].to_numpy()[new] for c in ("coverage", "mod_count", "ratio"))))
    if parts:
        haps, differ, cover, mod, ratio = (np.concatenate(x) for x in zip(*parts))
        out.append({"kind": "site", "hap": haps, "site_start": at[differ], "site_end": sites["site_end"].to_numpy(np.int64)[differ], "coverage": cover, "mod_count": mod, "ratio": ratio})
    known = np.where(states == -1, np.nan, states)
    cover = [(~np.isnan(known[hap == h])).sum(axis=0) for h in (0, 1)]
    share = [np.nansum(known[hap == h], axis=0) / np.maximum(cover[h], 1) for h in (0, 1)]
    steps_ = []
    for i in range(2, n - 2):
        ends = [cover[h][i : i + 2] for h in (0, 1)]
        if min(e.min() for e in ends) < max(min_allele_count, 1):
            continue
        w = [e.mean() for e in ends]
        t = sum(_hap_transition(share[h][i], share[h][i + 1]) * w[h] for h in (0, 1)) / (sum(w) + 1e-100)
        steps_.append({"kind": "step", "idx": idxs[i], **dict(zip(("t00", "t01", "t10", "t11"), map(float, t.ravel())))})
    tables = [pd.DataFrame(x) for x in [*out, steps_] if len(x)]
    return pd.concat([x for x in tables if len(x)] or [pd.DataFrame(columns=_NAMES)], ignore_index=True).reindex(columns=_NAMES)


def region_result(reads: pd.DataFrame, sites: pd.DataFrame, idxs: list[int], min_allele_count: int) -> list[dict]:
    """The rows of ``region_table``."""
    return region_table(reads, sites, idxs, min_allele_count).to_dict("records")


def methylation_results(phaseable: DataFrame, matrix: DataFrame, obs: DataFrame, alignments: DataFrame, sites: DataFrame, config: PhasingConfig, variants: DataFrame | None = None) -> DataFrame:
    """All regions' rows, told apart by ``kind``: 'assign', 'site' and 'step'.

    alignments: chrom, read_name, read_start, read_end, cigar, calls (map from query index to probability), already
    filtered; sites: chrom, site_start, site_end, coverage, mod_count, ratio.
    """
    p = cut(ordered.dense_index(phaseable.select("chrom", "idx", "pos"), "chrom", "idx", [], "p_idx", 100_000), "indexed")
    found = cut(regions(phaseable, matrix, variants), "regions")
    layers = found.select("chrom", "region_id", "a", F.explode(F.sequence("a", "b")).alias("p_idx"))
    layers = cut(layers.join(p.select("chrom", "p_idx", "idx"), ["chrom", "p_idx"]).select("chrom", "region_id", (F.col("p_idx") - F.col("a")).cast("int").alias("layer"), "idx"), "layers")
    idxs = layers.groupBy("chrom", "region_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("layer", "idx"))), lambda x: x["idx"]).alias("idxs"))

    sites = sites.select("chrom", "site_start", "site_end", "coverage", "mod_count", "ratio")
    near = meth.region_sites(found, meth.site_filter(sites), config.max_meth_distance)
    if not config.use_all_methylated_sites:
        near = meth.site_cap(near, ["chrom", "region_id"], config.max_sites)
    own = near.select("chrom", "region_id", "site_start", "site_end", "coverage", "mod_count", "ratio")

    calls = F.sort_array(F.map_entries("calls"))  # once a read, which lies in several regions
    reads = alignments.where("calls IS NOT NULL").select(
        "chrom", F.col("read_name").alias("read_id"), "read_start", "read_end", "cigar",
        F.transform(calls, lambda c: c["key"]).alias("call_at"), F.transform(calls, lambda c: c["value"]).alias("call_p"),
    )
    reads = region_reads(found, reads, config.max_meth_distance)
    carried = layers.join(obs.select("chrom", "read_id", "idx", "state"), ["chrom", "idx"]).groupBy("chrom", "region_id", "read_id")
    carried = carried.agg(F.collect_list("layer").alias("layers"), F.collect_list("state").alias("states"))
    reads = reads.join(carried, ["chrom", "region_id", "read_id"], "left").select(
        "chrom", "region_id", "read_id", "read_start", "read_end", "cigar", "layers", "states", "call_at", "call_p",
    )
    least = config.min_allele_count

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(columns=_NAMES)
        numbers = right["idx"][right["layer"].notna()].astype(int)  # the region's variants stand among its sites
        right = right[right["layer"].isna()]
        if len(left):
            left = left.sort_values(["read_id", "read_start"], kind="stable").reset_index(drop=True)
            right = right.sort_values("site_start", kind="stable").reset_index(drop=True)
            out = region_table(left, right, numbers.sort_values().tolist(), least, once=True)
        out = out.assign(chrom=key[0], region_id=key[1])
        whole = ["region_id", "hap", "a_idx", "a_state", "b_idx", "b_state", "idx", "site_start", "site_end", "coverage", "mod_count"]
        return out.astype({c: "Int64" for c in whole} | {c: "float64" for c in ("t00", "t01", "t10", "t11", "ratio")})

    reads, own = cut(reads.withColumn("rid", F.monotonically_increasing_id()), "reads"), cut(own, "sites")
    cells = reads.groupBy("chrom", "region_id").count().join(own.groupBy("chrom", "region_id").agg(F.count("*").alias("sites")), ["chrom", "region_id"])
    large = cut(cells.where(F.col("count") * F.col("sites") > MATRIX_CELLS).select("chrom", "region_id"), "large")
    if large.isEmpty():
        return _small(reads, own, layers, run)
    keys = ["chrom", "region_id"]
    small = _small(reads.join(large, keys, "left_anti"), own.join(large, keys, "left_anti"), layers.join(large, keys, "left_anti"), run)
    return small.unionByName(large_regions(reads.join(large, keys, "left_semi").join(idxs, keys), own.join(large, keys, "left_semi"), least))


def _small(reads: DataFrame, own: DataFrame, layers: DataFrame, run) -> DataFrame:
    spark, keys = reads.sparkSession, ["chrom", "region_id"]
    # by number: rows of a region are few bytes and much work
    tasks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = own.unionByName(layers, allowMissingColumns=True)
    deal = lambda df: df.repartition(tasks, *keys).groupBy(*keys)
    return deal(reads.drop("rid")).cogroup(deal(own)).applyInPandas(run, _RESULT)


def _probabilities(reads: DataFrame, own: DataFrame) -> DataFrame:
    """chrom, region_id, rid, site_start, p: what reads say about the sites they cover."""
    place = lambda df: df.withColumn("key", F.concat_ws(":", "chrom", F.col("region_id").cast("string")))
    spans = place(reads).select("key", "rid", "read_start", (F.col("read_end") + 1).alias("read_end"))
    on = points_in_intervals(place(own).select("key", "site_start"), spans, "key", "site_start", "read_start", "read_end", usual_width(spans, "read_start", "read_end"), split=["rid"])
    on = on.groupBy("rid").agg(F.sort_array(F.collect_list("site_start")).alias("sites"))  # of one read

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for chrom, region, rid, start, end, text, at, v, sites in zip(*(pdf[c] for c in ("chrom", "region_id", "rid", "read_start", "read_end", "cigar", "call_at", "call_p", "sites"))):
                sites = np.asarray(sites, np.int64)
                p = site_probabilities((start, end, text, np.asarray(at, np.int64), np.asarray(v, float)), sites)
                known = ~np.isnan(p)
                parts.append(pd.DataFrame({"chrom": chrom, "region_id": region, "rid": rid, "site_start": sites[known], "p": p[known]}))
            if parts:
                yield pd.concat(parts)

    cols = ["chrom", "region_id", "rid", "read_start", "read_end", "cigar", "call_at", "call_p", "sites"]
    return reads.join(on, "rid").select(*cols).mapInPandas(run, "chrom string, region_id long, rid long, site_start long, p double")


def large_regions(reads: DataFrame, own: DataFrame, min_allele_count: int, max_rounds: int = 100) -> DataFrame:
    """The rows of ``region_result`` for all these regions at once, round by round."""
    keys = ["chrom", "region_id"]
    reads, by_region = cut(reads, "large"), lambda df, *more: df.groupBy(*keys, *more)
    p = cut(_probabilities(reads, own), "probabilities")
    state = lambda k: F.coalesce(F.get(F.col("states"), F.array_position(F.col("layers"), k).cast("int") - 1), F.lit(-1))
    ends = cut(reads.select(*keys, "rid", state(0).cast("int").alias("s0"), state(1).cast("int").alias("s1")), "ends")

    def anchors(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s0", "s1"])
        a, b = _pattern(pdf[["s0", "s1"]].to_numpy(), pdf["n"].to_numpy())
        return pdf[keys].head(1).assign(a0=int(a[0]), a1=int(a[1]), b0=int(b[0]), b1=int(b[1]))

    # a region has nine patterns at most
    counts = by_region(ends.where("s0 <> -1 OR s1 <> -1"), "s0", "s1").agg(F.count("*").alias("n"))
    found = cut(by_region(counts).applyInPandas(anchors, "chrom string, region_id long, a0 int, a1 int, b0 int, b1 int"), "anchors")

    def fits(h: str):
        s, x = (F.col("s0"), F.col("s1")), (F.col(f"{h}0"), F.col(f"{h}1"))
        part = [(s[k] == x[k]) & (x[k] != -1) & (s[1 - k] == -1) for k in (0, 1)]
        return ((s[0] == x[0]) & (s[1] == x[1])) | part[0] | part[1]

    start = F.when(fits("a"), 0).when(fits("b"), 1).when((F.col("s0") == -1) & (F.col("s1") == -1), -1).otherwise(-2)
    hap = cut(ends.join(found, keys).select(*keys, "rid", start.alias("hap")), "haps")

    log = lambda c: F.log10(c + F.lit(1e-20))
    sums = ["m", "u", "cover", "mods"]
    new, total, logs = hap.where("hap >= 0"), None, []
    for _ in range(max_rounds):
        free = hap.where("hap = -1")
        if free.isEmpty():
            break
        added = by_region(p.join(new.select("rid", "hap"), "rid"), "hap", "site_start").agg(
            F.sum(log(F.col("p"))).alias("m"), F.sum(log(1 - F.col("p"))).alias("u"), F.count("*").alias("cover"), F.count_if(F.col("p") > 0.5).alias("mods")
        )
        if total is not None:
            added = by_region(total.unionByName(added), "hap", "site_start").agg(*[F.sum(c).alias(c) for c in sums])
        total = cut(added, "sums")
        open_ = total.join(free.select(*keys).distinct(), keys, "left_semi")
        both = by_region(open_, "site_start").agg(*[F.coalesce(F.max(F.when(F.col("hap") == h, F.col(c))), F.lit(0)).alias(f"{c}{h}") for h in (0, 1) for c in sums])
        call = lambda h: (F.col(f"m{h}") > meth.LOG_HALF) & (F.col(f"m{h}") - F.col(f"u{h}") > 3)
        differ = cut(both.withColumn("c0", call(0)).withColumn("c1", call(1)).where("c0 <> c1"), "differ")
        logs.append(differ)
        # p is sorted neither by region nor by site: reads that are free meet the differing sites of their region
        side = lambda h: F.sum(F.when(F.col(f"c{h}"), log(F.col("p")) + F.col(f"m{h}")).otherwise(log(1 - F.col("p")) + F.col(f"u{h}")))
        score = p.join(free.select("rid"), "rid").join(differ, [*keys, "site_start"]).groupBy("rid").agg(side(0).alias("x"), side(1).alias("y"))
        best = F.when((F.col("x") > F.col("y")) & (F.col("x") > meth.LOG_HALF), 0).when((F.col("y") > F.col("x")) & (F.col("y") > meth.LOG_HALF), 1)
        new = cut(free.drop("hap").join(score, "rid").select(*keys, "rid", best.alias("hap")).where("hap IS NOT NULL"), "assigned")
        if new.isEmpty():
            break
        # reads that are free in a region where nothing has changed stay free for good
        going = new.select(*keys).distinct()
        stay = free.join(going, keys, "left_semi").join(new.select("rid"), "rid", "left_anti")
        hap = cut(hap.where("hap >= 0").unionByName(new.select(hap.columns)).unionByName(stay.select(hap.columns)), "haps")
    done = cut(hap.where("hap >= 0"), "done")

    kinds = dict(x.split() for x in _RESULT.split(", "))
    rows = lambda df, **own: df.select(*[own.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in _NAMES])
    place = {"chrom": F.col("chrom"), "region_id": F.col("region_id")}
    who = reads.select("rid", "read_id", "idxs", "layers", "states").join(done, "rid").join(found, keys)
    of = lambda k: F.when(F.col("hap") == 0, F.col(f"a{k}")).otherwise(F.col(f"b{k}"))
    out = rows(who, kind=F.lit("assign"), **place, read_id=F.col("read_id"), hap=F.col("hap") + 1, a_idx=F.col("idxs")[0], a_state=of(0), b_idx=F.col("idxs")[1], b_state=of(1))
    ends_at = own.select(*keys, "site_start", "site_end", F.col("coverage").alias("all_cover"), F.col("mod_count").alias("all_mods"), F.col("ratio").alias("all_ratio"))
    for differ in logs:
        at = differ.join(ends_at, [*keys, "site_start"])
        span = place | {"kind": F.lit("site"), "site_start": F.col("site_start"), "site_end": F.col("site_end")}
        for h in (0, 1):
            c, m = F.col(f"cover{h}"), F.col(f"mods{h}")
            out = out.unionByName(rows(at, **span, hap=F.lit(h + 1), coverage=c, mod_count=m, ratio=F.when(c > 0, 100.0 * m / c)))
        out = out.unionByName(rows(at, **span, hap=F.lit(0), coverage=F.col("all_cover"), mod_count=F.col("all_mods"), ratio=F.col("all_ratio")))

    # shares of the alternative allele by haplotype and variant, then steps between neighbours
    known = who.select(*keys, "hap", F.explode(F.arrays_zip("layers", "states")).alias("x"), "idxs").where("x.states >= 0")
    share = by_region(known, F.col("x.layers").alias("layer")).agg(
        F.first("idxs").alias("idxs"), *[F.count_if(F.col("hap") == h).alias(f"n{h}") for h in (0, 1)], *[F.coalesce(F.avg(F.when(F.col("hap") == h, F.col("x.states"))), F.lit(0.0)).alias(f"f{h}") for h in (0, 1)]
    )
    share = cut(share, "shares")
    names = ("n0", "n1", "f0", "f1")
    nxt = share.select(*keys, (F.col("layer") - 1).alias("layer"), *[F.col(c).alias(f"next_{c}") for c in names])
    pairs = share.join(nxt, [*keys, "layer"]).where((F.col("layer") >= 2) & (F.col("layer") < F.size("idxs") - 2))
    pairs = pairs.where(F.least("n0", "n1", "next_n0", "next_n1") >= max(min_allele_count, 1)).select(*keys, F.col("idxs")[F.col("layer")].alias("idx"), *names, *[f"next_{c}" for c in names])

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for r in pdf.itertuples(index=False):
                w = [(r.n0 + r.next_n0) / 2, (r.n1 + r.next_n1) / 2]
                t = sum(_hap_transition(f, g) * x for f, g, x in ((r.f0, r.next_f0, w[0]), (r.f1, r.next_f1, w[1]))) / (sum(w) + 1e-100)
                found.append((r.chrom, r.region_id, r.idx, *map(float, t.ravel())))
            yield pd.DataFrame(found, columns=[*keys, "idx", "t00", "t01", "t10", "t11"])

    made = pairs.mapInPandas(step, "chrom string, region_id long, idx long, t00 double, t01 double, t10 double, t11 double")
    return out.unionByName(rows(made, kind=F.lit("step"), **place, **{c: F.col(c) for c in ("idx", "t00", "t01", "t10", "t11")}))


def differing_sites(results: DataFrame) -> DataFrame:
    """Sites that told haplotypes apart, of each haplotype (hap1, hap2) and in all (Total), each once and in order."""
    x = results.where("kind = 'site'").select(
        "chrom", F.col("site_start").alias("start"), F.col("site_end").alias("end"), "ratio", F.when(F.col("hap") == 0, "Total").otherwise(F.concat(F.lit("hap"), F.col("hap").cast("string"))).alias("hap"),
        "coverage", "mod_count", (F.col("coverage") - F.col("mod_count")).alias("unmod_count"),
    )
    return meth.sites_once(["chrom", "start", "hap"], x.select("chrom", "start", "end", F.col("ratio").alias("score"), "hap", "coverage", "mod_count", "unmod_count", "ratio"))


def assignments(results: DataFrame) -> DataFrame:
    return results.where("kind = 'assign'").select("chrom", "read_id", "hap", "a_idx", "a_state", "b_idx", "b_state")


def steps(results: DataFrame) -> DataFrame:
    return results.where("kind = 'step'").select("chrom", "idx", "t00", "t01", "t10", "t11")
