import random
import re

import pytest

from phaseframe.llm import decontam, queries

ITEM = "A farmer called Smith has 12 cows and sells 5 of them at 30 dollars each, how much does Smith get for the cows in total?"
PLAIN = "the quick brown fox jumps over a lazy dog while seven small birds are looking on from the fence."
CASES = [
    (0, "Intro text here. " + ITEM + " The end.", {(0, "verbatim")}),
    (1, ITEM.replace("Smith", "Jones").replace("12", "7").replace("30", "45").replace("dollars", "euros"), {(0, "reparameterised")}),
    (2, ITEM.replace("Smith", "Jones", 1).replace("12", "7"), set()),  # two values for one slot
    (3, "Nothing of the kind. " * 40, set()),
    (4, "", set()),
    (5, None, set()),
    (6, "so we say " + PLAIN + " again", {(1, "verbatim")}),
    (6, "so we say " + PLAIN + " again", {(1, "verbatim")}),
    (7, " ".join(PLAIN.split()[:8]), set()),
    (8, PLAIN.upper() + "!!", {(1, "verbatim")}),
    (9, "word " * 40_000 + PLAIN, {(1, "verbatim")}),
    (None, PLAIN, {(1, "verbatim")}),
    (11, "Too short!", {(5, "verbatim")}),
    (12, "It is too short to tell.", set()),
    (13, " 12 + 30 = ?", {(6, "verbatim")}),
    (14, "12 + 31 = ?", set()),
    (10, "short item of only seven words yes. Then more.", {(2, "verbatim")}),
]
ITEMS = [(0, ITEM), (1, PLAIN), (2, "Short item of only seven words yes."), (3, ""), (4, None), (5, "too short"), (6, "12 + 30 = ?")]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_planted_cases(spark, bench):
    docs = spark.createDataFrame([(k, t, 1) for k, t, _ in CASES], "doc_id long, text string, item_id int")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(k, i, kind) for k, _, found in CASES for i, kind in found}


def test_empty_tables(spark, bench):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert decontam.contaminated(docs, bench).count() == 0
    full = spark.createDataFrame([(1, PLAIN)], "doc_id long, text string")
    assert decontam.contaminated(full, bench.limit(0)).count() == 0


def test_against_brute_force(spark, tiny):
    """Every document with 13 words of an item in a row, and no other."""
    docs = [(r["doc_id"], r["text"].lower().split()) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"].lower().split()) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    runs = {}
    for i, w in items:
        for k in range(len(w) - 12):
            runs.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = {(d, i) for d, w in docs for k in range(len(w) - 12) for i in runs.get(tuple(w[k : k + 13]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op4_decontamination(spark, tiny).collect()}
    assert want and got == want


UNITS = set("km kg m dollars euros hours minutes".split())


def plain_tokens(text):
    """(literal or placeholder, value) of each token, word by word."""
    out, opening, number = [], True, False
    text = re.sub(r"(?<=\d)(?=[^\W\d_])|(?<=[^\W\d_])(?=\d)", " ", text)
    for word in text.split():
        core = re.sub(r"^[^\w$%+-]+|[^\w$%]+$", "", word)
        if core:
            low = core.lower()
            if re.fullmatch(r"[+\-$]?\d[\d.,:/]*%?", core):
                out.append(("NUM", low))
            elif number and low in UNITS:
                out.append(("UNIT", low))
            elif core[0].isupper() and core[1:].islower() and not opening:
                out.append(("NAME", low))
            else:
                out.append((low, None))
            number = out[-1][0] == "NUM"
            opening = False
        opening = opening or word.rstrip("\"')]")[-1:] in ".!?:"
    return out


def plain_matches(doc, item, window=10, literal=5, least=4):
    d, i = plain_tokens(doc), plain_tokens(item)
    size = min(window, len(i))
    fine = [k for k in range(len(i) - size + 1) if sum(v is None for _, v in i[k : k + size]) >= literal]
    lines = {}
    for k in fine:
        for j in range(len(d) - size + 1):
            if [t for t, _ in d[j : j + size]] == [t for t, _ in i[k : k + size]]:
                pairs = {(x[0], x[1], y[1]) for x, y in zip(i[k : k + size], d[j : j + size]) if x[1]}
                lines.setdefault(j - k, []).append(pairs)
    for hits in lines.values():
        slots = set().union(*hits)
        if len(hits) >= min(least, max(len(fine) - 1, 1)) and len({(t, v) for t, v, _ in slots}) == len(slots):
            return True
    return False


def test_changed_questions_against_brute_force(spark):
    """Numbers, names and units of questions replaced one for one, or one of several alike, against windows compared in a loop."""
    rng = random.Random(3)
    names, words = ["Anna", "Boris", "Clara", "David"], "apples pears trains rides sells buys every carries toward market village river cost when does arrive after".split()
    items, docs = [], []
    for k in range(30):
        name, a, b, unit = rng.choice(names), rng.randint(2, 90), rng.randint(2, 90), rng.choice(sorted(UNITS))
        body = [rng.choice(words) for _ in range(rng.randint(8, 25))]
        for piece in (name, f"{a} {unit}", str(b), name, str(a)):
            body.insert(rng.randint(1, len(body)), piece)
        items.append((k, "Today " + " ".join(body) + "?"))
    for k, (_, text) in enumerate(items * 3):
        new = re.sub(r"\d+", lambda m: str(int(m[0]) + 100), text) if rng.random() < 0.6 else text
        new = re.sub("|".join(names), lambda m: names[names.index(m[0]) - 1], new) if rng.random() < 0.6 else new
        new = re.sub(r"\d+", "7", new, count=1) if rng.random() < 0.4 else new
        new = new.replace(rng.choice(words), "otherwise") if rng.random() < 0.3 else new
        docs.append((k, f"Some words before it. {new} And some words after that one."))
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == {(d, i) for d, t in docs for i, x in items if plain_matches(t, x)} and 40 < len(got) < 90


def test_names_that_open_sentences_and_names_in_capitals(spark):
    items = [
        (0, "Tom has 5 red apples in a box. Tom gives 2 of them to the boy. Tom eats 1 on the way home."),
        (1, "If IBM sells 40 machines a week to its clients, how many machines does IBM sell in 6 weeks?"),
    ]
    docs = [
        (0, "Before it. Anna has 7 red apples in a box. Anna gives 3 of them to the boy. Anna eats 4 on the way home. After it."),
        (1, "If SAP sells 30 machines a week to its clients, how many machines does SAP sell in 5 weeks?"),
        (2, "Anna has 7 red apples in a box. Boris gives 3 of them to the boy. Clara eats 4 on the way home."),  # three for one
        (3, items[0][1].replace("Tom", "Anna")),
        (4, items[1][1]),
        (5, "Red is a colour. Tom has nothing to do with it. The way home is long, and the box stands in the room."),
    ]
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in found.collect()}
    assert got == {(0, 0): "reparameterised", (1, 1): "reparameterised", (3, 0): "reparameterised", (4, 1): "verbatim"}


def test_rows_that_share_an_id_or_have_none(spark):
    a, b = ITEM.replace("12", "7"), ITEM.replace("12", "9").replace("Smith", "Jones")
    for ids in ((1, 2), (1, 1), (None, None)):
        docs = spark.createDataFrame([(ids[0], a), (ids[1], b), (ids[1], b)], "doc_id long, text string")
        for items in ([(0, ITEM)], [(0, ITEM), (0, PLAIN)], [(None, ITEM), (None, PLAIN)]):
            found = decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
            assert [(r["doc_id"], r["item_id"], r["kind"]) for r in sorted(found, key=lambda r: r["doc_id"] or 0)] == [(i, items[0][0], "reparameterised") for i in ids]
