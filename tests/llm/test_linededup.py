import random
import re

from phaseframe.llm import linededup


def normal(line):
    return " ".join(re.sub("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", line.lower()).split())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, similarity=0.9):
    """Texts after line dedup: lines linked by the edit similarity of all pairs alone, then first occurrences."""
    lines = sorted({normal(x) for _, t in rows for x in (t or "").split("\n")} - {""})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            most = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
            if abs(len(a) - len(b)) <= most and linededup.edit_distance(a, b) <= most:
                root[find(a)] = find(b)
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept = []
        for x in (t or "").split("\n"):
            group = find(normal(x)) if normal(x) else None
            if group is None or group not in seen:
                kept.append(x)
            seen.add(group)
        out[d] = "\n".join(kept)
    return out


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=5))
    passages = [[word() for _ in range(rng.choice([3, 20, 80, 150]))] for _ in range(12)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            base = list(rng.choice(passages)) if rng.random() < 0.6 else [word() for _ in range(12)]
            if rng.random() < 0.4:
                base[rng.randrange(len(base))] = word()
            lines.append(" ".join(base))
        rows.append((d, "\n".join(lines)))
    rows += [(100, ""), (101, None), (102, "\n\n---\n---\n"), (103, "Same Line, here!\nsame line here\n  SAME   line; here"), (104, "x " * 20_000), (105, "X " * 20_000), (None, "same line here\nonly in the last")]
    return rows


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(400):
        a = "".join(rng.choices("abcé", k=rng.randint(0, 12)))
        b = "".join(rng.choices("abcé", k=rng.randint(0, 12))) if rng.random() < 0.5 else a[: rng.randint(0, 12)] + "x" + a[rng.randint(0, 12) :]
        assert linededup.edit_distance(a, b) == distance(a, b), (a, b)


def test_lines_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 7, "k") for d, t in rows], "doc_id long, text string, node int, key string")
    out = linededup.dedup_lines(docs).collect()
    want = brute(rows)
    assert {r["doc_id"]: r["text"] for r in out} == want
    assert all(r["node"] == 7 and r["key"] == "k" for r in out)
    by = {r["doc_id"]: r for r in out}
    assert by[102]["text"] == "\n\n---\n---\n" and by[102]["n_dropped"] == 0
    assert by[103]["text"] == "Same Line, here!" and by[103]["n_dropped"] == 2 and by[103]["n_lines"] == 3
    assert by[None]["text"] == "only in the last" and by[105]["text"] == ""


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a line of text\nb"), (1, "a line of text\nb"), (2, "a line of text\nc")]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, "a line of text\nb")] * 2 + [(2, "c")]
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_group_of_near_lines_keeps_one(spark):
    rng = random.Random(2)
    base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(200)]
    rows = []
    for d in range(150):
        other = list(base)
        other[d] = "changed"
        rows.append((d, " ".join(other)))
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == brute(rows)
