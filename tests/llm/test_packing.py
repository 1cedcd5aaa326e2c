import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from phaseframe.llm import packing, queries


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    for _ in range(300):
        w = rng.choice([5, 8, 13, 64])
        lengths = sorted((rng.randint(1, w) for _ in range(rng.randint(0, 60))), reverse=True)
        where, offsets, used = packing.best_fit_decreasing(lengths, w)
        room = []
        for n, k, o in zip(lengths, where, offsets):
            fit = [r for r in room if r >= n]
            if fit:
                assert room[k] == min(fit)
            else:
                assert k == len(room)
                room.append(w)
            assert o == w - room[k]
            room[k] -= n
        assert used == len(room)


TEXTS = [
    "plain words, and more.", "", None, "   \n\t ", "It's we'll 'sample 's ''s DON'T x's's 12 3½ ²", "İstanbul ΣΑΣ é", "漢字 and kana かな", "<|endoftext|> in text",
    "a\x0bb\x1cc\xa0d\x85e", "word " * 30_000, "ÀÈ ÑO ß ÿ × ÷ ¿qué?", "x" * 5_000, "!!! ??? ...", "'", "don't" * 300,
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_tokenizer_gives_the_library_ids(reference):
    tok = packing.WordTokenizer(queries.tokenizer_path())
    texts = [t or "" for t in TEXTS]
    want = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tok.encode(texts)] == want
    tok.LIMIT = 3  # the cache is emptied again and again
    assert [x.tolist() for t in texts for x in tok.encode([t])] == want


def test_pieces_cover_each_document_once(spark, reference):
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)] + [(3, TEXTS[0], 1), (None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(2)
    pieces = packing.pack(df, queries.tokenizer_path(), window=64, block_pieces=5).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"] <= 64
    for k, t in enumerate(TEXTS):
        ids = reference.encode(t or "", add_special_tokens=False).ids + [2]
        if k != 3:
            ps = sorted(by_doc[k], key=lambda p: p["start"])
            assert [i for p in ps for i in p["ids"]] == ids
            assert all(p["doc_tokens"] == len(ids) for p in ps)
    assert len(by_doc[3]) == 2 and len(by_doc[None]) == 1
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 64


def test_little_padding_and_empty_table(spark, tiny):
    df = queries.op2_packing(spark, tiny)
    used, n = df.selectExpr("sum(length)", "count(DISTINCT sequence_id)").first()
    assert used / (n * packing.WINDOW) > 0.97
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer_path()).count() == 0


def test_words_of_one_name_keep_their_own_ids(reference, monkeypatch):
    """The Thue-Morse word and its complement have one polynomial hash modulo a power of two."""
    tok = packing.WordTokenizer(queries.tokenizer_path())
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    texts = [one, one.translate(str.maketrans("ab", "ba")), f"{one} and {one.translate(str.maketrans('ab', 'ba'))}"]
    want = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert want[0] != want[1] and [x.tolist() for x in tok.encode(texts)] == want
    whole = packing.WordTokenizer._names

    def clashing(self, raw, start, stop):
        return np.where(stop - start > 8, np.uint64(77), whole(self, raw, start, stop))

    monkeypatch.setattr(packing.WordTokenizer, "_names", clashing)
    tok, texts = packing.WordTokenizer(queries.tokenizer_path()), ["considerable advantages of independence, independent of consideration", "independence advantages, considerable"]
    assert [x.tolist() for x in tok.encode(texts)] == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
