import hashlib
import random

import pyarrow as pa
import pytest

from meshwork.llm import pieces

P = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

PATH = P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "▁", "▁▁", "▁a", " " * 40, "a  b", " a", "x▁y", "a\t b", "\0a", "word " * 4000, "é日😀 \n\r\n", "a b", "　x", "x" * 3000]


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice(" \n\t▁aeé日😀\0 .,th<>") for _ in range(rng.randint(0, 30))) for _ in range(400)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_same_as_the_library(spark):
    rows = list(enumerate(texts())) + [(None, "no id"), (3, "twice"), (3, "twice")]
    out = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y"), PATH).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = []
    for i, t in rows:
        ids = sp.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)


def test_ids_and_text_themselves(spark):
    df = spark.createDataFrame([(1, "hello  world", 9)], "doc_id long, text string, n_tokens int")
    r = pieces.encode(df, PATH, digests=False).first()
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert r.ids == sp.encode("hello  world") and r.decoded == "hello  world" and r.n_tokens == len(r.ids)


def test_empty_table_and_bounded_cache(spark, monkeypatch):
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    monkeypatch.setattr(pieces, "KEEP", 3)
    with open(PATH, "rb") as f:
        seg = pieces.Segmenter(f.read())
    for t in ("a b c d e f", "f e d c b a", "a a a"):
        ids, text, n = next(iter(pieces.encode_texts(seg, pa.array([t]))))
        assert [int(i) for i in ids.split(",")] == seg.sp.encode(t) and text == t and n == len(seg.sp.encode(t))
