"""Pairs of a large group of changed copies, found by what each has and its head hasn't."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phaseframe.llm import common, minhash
from phaseframe.llm.common import Scratch

BASE = 140


def _copies(n: int, edits: tuple[int, int], seed: int = 3, hot: int = BASE) -> list[np.ndarray]:
    """Copies of one set, each with some runs of five elements changed; of runs that begin alike some are changed alike."""
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        own = np.arange(BASE)
        for _ in range(rng.integers(*edits)):
            at = rng.integers(hot - 5)
            own[at : at + 5] = 1000 + 100 * at + np.arange(5) if rng.random() < 0.3 else 100_000 + 1000 * k + 5 * at + np.arange(5)
        out.append(np.unique(own))
    return out


def _links(sets: list[np.ndarray], similarity: float) -> set[tuple[int, int]]:
    has = np.zeros((len(sets), max(x.max() for x in sets) + 1), np.float32)
    for k, x in enumerate(sets):
        has[k, x] = 1
    common_, n = has @ has.T, np.array([len(x) for x in sets])
    near = common_ >= similarity * (n[:, None] + n - common_) - 1e-9
    return {(int(a), int(b)) for a, b in np.argwhere(np.triu(near, 1))}


def _found(spark, sets, similarity, head):
    elements = spark.createDataFrame([(k, [int(e) for e in x]) for k, x in enumerate(sets)], "node long, elements array<int>")
    posts = elements.select(F.lit(head).cast("long").alias("head"), F.lit(head).cast("long").alias("most"), "node", F.col("node").alias("comp"))
    rows = minhash.pairs_by_difference(posts, elements, similarity, Scratch(spark, "differences")).collect()
    return {(min(r), max(r)) for r in rows}


@pytest.mark.parametrize("head", [0, 7])
@pytest.mark.parametrize("similarity", [0.8, 0.65])
def test_no_component_is_parted(spark, head, similarity):
    sets = _copies(150, (0, 9), hot=60)
    pairs, links = _found(spark, sets, similarity, head), _links(sets, similarity)
    with_head = {a + b - head for a, b in links if head in (a, b)}
    # both ends linked with the head: one component without their pair
    wanted = {(a, b) for a, b in links if head in (a, b) or not {a, b} <= with_head}
    assert wanted and wanted <= pairs
    assert len(wanted) > len(with_head)


def test_copies_changed_in_places_of_their_own_make_few_pairs(spark):
    sets = [np.unique(np.where(np.isin(np.arange(BASE), np.random.default_rng(k).choice(BASE, 16, replace=False)), 10_000 + BASE * k + np.arange(BASE), np.arange(BASE))) for k in range(600)]
    assert not _links(sets, 0.8)
    assert len(_found(spark, [np.arange(BASE), *sets], 0.8, 0) - {(0, k) for k in range(601)}) < 600  # of 179,700


def _texts(n: int) -> list[str]:
    """Copies of one text, with two to four words changed each: some pairs link, most are just too far apart."""
    rng, out = np.random.default_rng(11), []
    for k in range(n):
        words = [f"w{i}" for i in range(140)]
        for at in rng.choice(140, rng.integers(2, 5), replace=False):
            words[at] = f"x{k}y{at}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("weighted", [False, True])
def test_wide_buckets_give_the_same_classes(spark, monkeypatch, weighted):
    docs = spark.createDataFrame(list(enumerate(_texts(300))), "doc_id long, text string")

    def classes(wide):
        monkeypatch.setattr(common, "WIDE", wide)
        made, write = [], Scratch.write
        monkeypatch.setattr(Scratch, "write", lambda self, df, name: (made.append((name, out := write(self, df, name), out.count() if name == "pairs" else 0)), out)[1])
        rows = sorted(tuple(r) for r in minhash.near_duplicates(docs, weighted=weighted).collect())
        monkeypatch.undo()
        return rows, sum(n for _, _, n in made)

    every, all_pairs = classes(1 << 30)
    some, few_pairs = classes(8)
    assert some == every
    assert few_pairs < all_pairs / 3, (few_pairs, all_pairs)
