"""Registered queries from alignments with sequences on two chromosomes: allele calls, observations, methylation, phasing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe import fixtures as fx
from phaseframe.config import PhasingConfig
from phaseframe.operators import observe
from phaseframe.plans.catalogue import query


def _sql_of(text: str) -> str:
    return text.format(orders="orders", part="part").replace("STRING", "VARCHAR")


_BV = "bv AS (" + _sql_of(fx.BLOCK_VARIANTS) + ")"
_BR = "br AS (" + _sql_of(fx.BLOCK_READS) + "), kept AS (SELECT * FROM br WHERE flag & 1796 = 0 AND mapq >= 20)"
#: Each block of a read with the allele that the read was made with.
_MADE = "made AS (" + " UNION ALL ".join(f"SELECT chrom, read_name, flag, qual, b{k} AS b, c{k} AS c, n{k} AS n, w{k} AS w FROM kept" for k in range(3)) + ")"
_STATES = (
    "called AS (SELECT m.chrom, read_name AS read_id, idx, CASE WHEN flag & 16 <> 0 THEN 1 ELSE 0 END AS strand, v.b % 5 AS kind, c, n, w, qual FROM made m JOIN bv v USING (chrom, b)),"
    " states AS (SELECT chrom, read_id, idx, strand,"
    " CASE WHEN kind < 2 AND (qual = 0 OR n = 1) THEN -1 ELSE c END AS state,"
    " CASE WHEN kind < 2 THEN qual = 0 OR n = 0 WHEN kind = 2 THEN NOT (c = 1 AND w = 1) ELSE kind <> 3 END AS direct FROM called)"
)
CONFIG = PhasingConfig()


def _inputs(s, d):
    return fx.block_variants(s, d), fx.block_reads(s, d), fx.block_reference(s, d)


def _observed(s, d) -> DataFrame:
    return observe.observe(*_inputs(s, d), CONFIG)


@query("block_variants", f"WITH {_BV} SELECT chrom, idx, pos, ref, alt, truth FROM bv")
def _(s, d):
    return fx.block_variants(s, d).select("chrom", "idx", "pos", "ref", F.col("alts")[0].alias("alt"), "truth")


@query("direct_calls", f"WITH {_BV}, {_BR}, {_MADE}, {_STATES} SELECT chrom, read_id, idx, CASE WHEN direct THEN state END AS state FROM states")
def _(s, d):
    x = observe.covered(*_inputs(s, d), CONFIG)
    return x.select("chrom", F.col("read_name").alias("read_id"), F.explode("calls").alias("c")).select("chrom", "read_id", "c.idx", "c.state")


@query("observed_states", f"WITH {_BV}, {_BR}, {_MADE}, {_STATES} SELECT * FROM states")
def _(s, d):
    return _observed(s, d)


# ------------------------------------------------------------- phasing from alignments

@query("phase_from_alignments")
def _(s, d):
    from phaseframe.plans.pipeline import phase

    v, a, r = _inputs(s, d)
    return phase(v, observe.observe(v, a, r, CONFIG), CONFIG)


def _with_methylation(s, d) -> dict[str, DataFrame]:
    from phaseframe.plans.pipeline import phase_with_methylation

    v, _, r = _inputs(s, d)
    a = fx.block_modified_reads(s, d)
    return phase_with_methylation(v, observe.observe(v, a, r, CONFIG), a, fx.block_methylation_sites(s, d), CONFIG)


@query("phase_with_methylation")
def _(s, d):
    return _with_methylation(s, d)["haplotypes"]


@query("filled_transitions")
def _(s, d):
    return _with_methylation(s, d)["filled"]
