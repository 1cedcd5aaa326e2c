"""Each stage on its own input, against brute force where that is feasible."""

import corpus_pipeline
import pytest
from phaseframe.llm import decontam, quality
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_minhash import brute as brute_classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tiny, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tiny).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        tables.append(docs)
    return [t.collect() for t in tables], tables


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    for t in stages[1][:5]:
        assert t.columns == COLUMNS


def test_quality_stage(spark, tiny, stages):
    scored = quality.score_documents(spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet"))
    want = {r["doc_id"] for r in scored.where("predicted = 1").collect()}
    before, after = stages[0][0], stages[0][1]
    assert {r["doc_id"] for r in after} == want and 0 < len(want) < len(before)
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(texts[r["doc_id"]] == r["text"] for r in after)


def test_line_stage(stages):
    before, after = stages[0][1], stages[0][2]
    want = brute_lines([(r["doc_id"], r["text"]) for r in before])
    had = {r["doc_id"]: r["text"] for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == {d: t for d, t in want.items() if t or not had[d]}
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_stage(stages):
    before, after = stages[0][2], stages[0][3]
    classes = brute_classes([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == {d for d, c in classes if d == c}


def test_leak_stage(spark, tiny, stages):
    before, after = stages[0][3], stages[0][4]
    found = decontam.contaminated(stages[1][3], spark.read.parquet(f"{tiny}/benchmark.parquet")).collect()
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {r["doc_id"] for r in found}


def test_packing_stage_and_run(spark, tiny, stages):
    before, pieces = stages[0][4], stages[0][5]
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in before}
    total = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert sum(p["length"] for p in pieces) == sum(total.values()) == sum(len(p["ids"]) for p in pieces)
    key = lambda p: (p["doc_id"], p["start"], p["length"], p["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, tiny).collect())) == sorted(map(key, pieces))


def test_empty_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tiny)
        assert out.count() == 0
        docs = docs if "sequence_id" in out.columns else out


def test_near_stage_keeps_one_row_of_repeated_and_null_ids(spark, tiny):
    words = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(3, words), (3, words), (3, other), (None, words), (None, other + " end"), (5, words + " end"), (1, "alone"), (None, ""), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, docs, tiny)
    assert out.columns == COLUMNS
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(3, words), (3, other), (1, "alone"), (None, ""), (None, "")], key=str)
