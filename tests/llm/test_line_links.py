"""Line groups against edit similarity of all pairs, whatever finds the candidates."""

import random

from phaseframe.llm import linededup
from tests.llm.test_linededup import brute


def edited(rng, line, edits):
    for _ in range(edits):
        k = rng.randrange(len(line))
        line = line[:k] + rng.choice(["", "q", line[k] + "z"]) + line[k + 1 :]
    return line


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


def test_long_lines_with_few_edits(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        base = words(rng, rng.choice([16, 25, 60]))
        for edits in (0, 1, 2, len(base) // 40):
            rows.append((len(rows), edited(rng, base, edits)))
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r["doc_id"]: r["text"] for r in out} == want and sum(not t for t in want.values()) >= 175


def short_rows(longest):
    rng = random.Random(6)
    rows = [(0, "all rights reserved 2019 by example\nmenu\nhome page"), (1, "all rights reserved 2020 by example\nmenus\nhome page"), (2, "all rights reserved 2018 by example\nhome pages")]
    for _ in range(80):
        base = words(rng, rng.randint(1, 12))[:longest].strip()
        for edits in range(0, 2 + len(base) // 10):
            rows.append((len(rows), edited(rng, base, edits) or "x"))
    rng.shuffle(rows)
    return rows


def test_short_lines(spark):
    """All pairs are found, however many edits the similarity allows, if a line is shorter than SHORT."""
    rows = short_rows(linededup.SHORT - 7)
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == brute(rows)


def test_somewhat_longer_lines(spark):
    """With as many edits as the similarity allows some pairs are missed; no line goes that all pairs would keep."""
    rows = short_rows(1_000)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    gone = [d for d, t in want.items() if not t]
    assert all(t or not want[d] for d, t in got.items())
    assert sum(not got[d] for d in gone) >= 0.8 * len(gone)


def test_recall_by_length_and_edits():
    """Share of pairs of a line and an edited copy, within the similarity, that share a key and pass the sketch and places."""
    rng = random.Random(8)
    lines = [words(rng, rng.choice([10, 14, 22, 45, 90])) for _ in range(400)]
    for least, change in ((0.97, lambda x: edited(rng, x, 1)), (0.95, lambda x: edited(rng, x, 2)), (0.95, lambda x: edited(rng, x, len(x) // 40)), (0.85, lambda x: edited(rng, x, len(x) // 20))):
        pairs = [(x, " ".join(y.split())) for x in lines if (y := change(x)) != x]
        own = [linededup.line_keys([p[k] for p in pairs]) for k in (0, 1)]
        keys = [[set() for _ in pairs] for _ in own]
        for side, (line, key, _) in zip(keys, own):
            for i, k in zip(line.tolist(), key.tolist()):
                side[i].add(k)
        found = sum(bool(a & b) for a, b in zip(*keys))
        assert found >= least * len(pairs), (found, len(pairs))
