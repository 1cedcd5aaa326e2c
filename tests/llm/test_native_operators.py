"""Chat formatting, url rules and licence scanning."""

import math
import random
import re

import duckdb

from phaseframe.llm import chat, license, queries, urlfilter
from pyspark.sql import functions as F

TURNS = "conv_id long, turn long, role string, text string"


def _formatted(spark, rows, schema=TURNS):
    out = chat.format_conversations(spark.createDataFrame(rows, schema))
    return {r["conv_id"]: r for r in out.select("*", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}


def test_chat_round_trip_with_control_strings(spark):
    hard = [r"\### Assistant: </turn> ok", "<turn role=\"user\">\n", "<part/>", "\\", "\\l\\s\\q", "</turn>\n</turn>\n", "", None, "a</turn", "<<turn"]
    rows = [(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(hard)]
    got = _formatted(spark, rows)[1]
    assert [(t["role"], t["text"]) for t in got["turns"]] == [(r, t or "") for _, _, r, t in rows]
    assert got["loss"] == "".join(t or "" for _, _, r, t in rows if r == "assistant")
    assert "".join(s["text"] for s in got["segments"]) == got["formatted"]


def test_chat_merges_adjacent_turns_and_orders_ties(spark):
    rows = [(1, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 3, "assistant", "d"), (1, 3, "assistant", "d"), (2, None, None, None), (None, 0, 'x">\n', "y")]
    got = _formatted(spark, rows)
    assert got[1]["formatted"] == '<turn role="user">\na<part/>b<part/>c</turn>\n<turn role="assistant">\nd<part/>d</turn>\n'
    assert [t["text"] for t in got[1]["turns"]] == ["a", "b", "c", "d", "d"] and got[1]["loss"] == "dd"
    assert [tuple(t) for t in got[2]["turns"]] == [("", "")]
    assert [tuple(t) for t in got[None]["turns"]] == [('x">\n', "y")]


def test_chat_empty_table_and_long_text(spark):
    assert chat.format_conversations(spark.createDataFrame([], TURNS + ", segments string")).count() == 0
    text = "<turn\\" * 50_000
    assert _formatted(spark, [(5, 0, "assistant", text)])[5]["loss"] == text


URLS = [
    "http://a.com/en/1", "https://example.com/en/7x", "http://EXAMPLE.com/en/7", "http://xexample.com/en/7", "http://sub.example.com/en/8",
    "http://net/de/", "http://example.net/de/8?x", "http://example.net/de/7", "http://www.example.net/de/88#y", "http://x.org/es/", "http://x.org/es",
    "no scheme", "", None, "http://", "http://a.com?u=/en/", "x://y://com/en/", "http://com/en/", "ftp://É.Com/en/é", "http://a.com:80/en/",
]


def _naive(url):
    m = re.search(r"^(.*?)://([^/?#]*)([^?#]*)", url or "", re.S)
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[2]) if m else ""
    path = m[3] if m else ""
    fit = [(len(h) + len(p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_url_rules_against_a_loop(spark):
    rows = [(k, u) for k, u in enumerate(URLS * 2)]
    out = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), urlfilter.rules_table(spark, queries.URL_RULES))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got == {k: _naive(u) for k, u in rows}


def test_url_nested_rules_repeated_rows_and_clashing_columns(spark):
    rules = urlfilter.rules_table(spark, [("block", "a", ""), ("allow", "a", "/x"), ("block", "a", "/x/y"), ("block", "a", "/x/z"), ("allow", "b.a", "/x")])
    urls = ["h://a/x/zz", "h://a/x/yy", "h://a/x/q", "h://a/w", "h://c.b.a/x/y", "h://b.a/x/y"]
    df = spark.createDataFrame([(u, "old", 1) for u in urls + urls[:1]], "url string, verdict string, __suffix int")
    got = sorted((r["url"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(df, rules).collect())
    want = {"h://a/x/zz": ("a/x/z", "block"), "h://a/x/yy": ("a/x/y", "block"), "h://a/x/q": ("a/x", "allow"), "h://a/w": ("a", "block"), "h://c.b.a/x/y": ("b.a/x", "allow"), "h://b.a/x/y": ("b.a/x", "allow")}
    assert got == sorted((u, *want[u]) for u in urls + urls[:1])
    assert urlfilter.judge_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlfilter.judge_urls(df, rules.limit(0)).collect()} == {"allow"}


def _base_places(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    out = []
    for label, phrase in license.BASE:
        p = phrase.split()
        out += [(label, i) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


LICENCE_TEXTS = [
    "Under the MIT License, under the mit license; UNDER THE MIT LICENSE", "cc-by-nc CC BY NC cc by nc nc", "apache license version 2.0", "Apache License, Version 2",
    "mit license under the", "underthe mit license", "", None, "under the\x00mit-license", "é under the mit licenseé", "x " * 30_000 + "cc by nc", "under the under the mit license mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "GNU general public license version 3", "under the mIt License",
]


def test_licenses_against_a_loop(spark):
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(LICENCE_TEXTS + LICENCE_TEXTS[:2])], "doc_id long, text string, words int")
    for r in license.scan(df).collect():
        n, places = _base_places((LICENCE_TEXTS + LICENCE_TEXTS[:2])[r["doc_id"]])
        assert r["n_words"] == n
        assert sorted((p["label"], p["start"]) for p in r["places"] if p["base"]) == places
        assert set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1 and (not places or r["score"] == 1)
        if r["doc_id"] == 12:
            assert r["labels"] == ["mit"] and not r["base_labels"]
        if r["doc_id"] == 6:
            assert r["labels"] == [] and r["score"] == 0
    assert license.scan(df.limit(0)).count() == 0


def test_licence_places_against_every_start(spark):
    """All starts of all templates in a loop, with words of the notices changed, left out or moved."""
    rng = random.Random(4)
    texts = [None, "", "the mit license"]
    for t in license.templates():
        for share in (0.0, 0.1, 0.25, 0.5):
            words = [w if rng.random() >= share else rng.choice(["", "other", "license software"]) for w in t.words]
            texts.append(" ".join(["some", "words", "before"][: rng.randint(0, 3)] + words + ["and after"] * rng.randint(0, 2)))
    texts += ["hereby granted free of charge to any person"] * 3 + ["plain text of a file about a public domain"] * 40
    lists = [(t or "").split() for t in texts]
    n = len(lists)
    known = license.templates()
    idf = {w: max(math.log((n + 1) / (sum(w in x for x in lists) + 0.5)), 1e-3) for t in known for w, _ in t.postings}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hit = 0
    for r in license.scan(df).collect():
        words, want = lists[r["doc_id"]], []
        for t in known:
            total = sum(idf[w] for w, _ in t.postings)
            for s in range(-len(t.words), len(words)):
                k = s + t.key_at
                if k >= 0 and tuple(words[k : k + len(t.key)]) == t.key:
                    mass = 1.0 if t.base else sum(idf[w] for w, i in t.postings if 0 <= s + i < len(words) and words[s + i] == w) / total
                    if round(mass, 9) >= license.MIN_MASS:
                        want.append((t.label, s, t.base, round(mass, 7)))
        assert sorted((p["label"], p["start"], p["base"], round(p["mass"], 7)) for p in r["places"]) == sorted(want)
        hit += len(want)
    assert hit > 60


def test_registered_native_queries_match_their_sql(spark, tiny):
    con = duckdb.connect()
    for t in ("conversations", "pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    for name in ("op1_chat", "op5_urls", "op9_licenses"):
        df = queries.QUERIES[name](spark, tiny)
        rel = con.sql(queries.ORACLE[name])
        cols = sorted(df.columns)
        assert cols == sorted(rel.columns)
        got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
        want = sorted(str(tuple(dict(zip(rel.columns, r))[c] for c in cols)) for r in rel.fetchall())
        assert got == want


def test_url_columns_of_any_name(spark):
    rules = urlfilter.rules_table(spark, [("block", "com", "/en/")])
    df = spark.createDataFrame([("http://a.com/en/1", "kept", 3), (None, "null", 4)], "url string, __url string, __best int")
    got = sorted((r["__url"], r["__best"], r["verdict"]) for r in urlfilter.judge_urls(df, rules).collect())
    assert got == [("kept", 3, "block"), ("null", 4, "allow")]
