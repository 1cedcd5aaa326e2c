"""What a large group of near lines costs, and the map of keys that stand in several rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from phaseframe.llm import common
from phaseframe.llm.common import Scratch


def test_posts_outside_the_largest_component_meet_several_of_its_members(spark, monkeypatch):
    """Nodes are linked if their last three digits are near; each posts under most of ten keys. The components are the same."""
    rng = random.Random(4)
    nodes = [1000 * k + min(999, max(0, int(rng.gauss(500, 150)))) for k in range(300)]
    posts = spark.createDataFrame([(key, n) for n in nodes for key in rng.sample(range(10), 8)], "key long, node long").cache()
    near = lambda pairs, _: pairs.where("abs(a % 1000 - b % 1000) <= 120")

    def linked(apart):
        made, write = [], Scratch.write
        monkeypatch.setattr(Scratch, "write", lambda self, df, name: (out := write(self, df, name), made.append(out.count() if name == "pairs" else 0))[0])
        roots = common.link_buckets(posts, lambda x, y: F.lit(True), near, Scratch(spark, "groups"), F.col("key") == 0, apart=apart)
        groups = {}
        for r in roots.distinct().collect():
            groups.setdefault(r["root"], set()).add(r["node"])
        monkeypatch.undo()
        return sorted(map(sorted, groups.values())), sum(made)

    (one, many), (same, few) = linked(False), linked(True)
    assert same == one and len(one[0]) > 250
    assert few < 0.8 * many, (few, many)


def test_map_holds_repeated_keys_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(common, "FEWEST_BITS", 1 << 10)
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 40_000) & ~15
    rows = [(keys[k : k + 20].tolist(),) for k in range(0, len(keys), 20)] + [(keys[:3_000:3].tolist(),)] * 3
    found = common.KeyMap(spark.createDataFrame(rows, "key array<long>").repartition(5), 43_000)
    assert found.has(keys[:3_000:3]).all()
    lone = np.setdiff1d(keys, keys[:3_000:3])
    assert 8 * len(found.bytes) >= 86_000 and found.has(lone).mean() < 0.03
    assert not common.KeyMap(spark.createDataFrame([], "key array<long>"), 0).has(keys).any()
