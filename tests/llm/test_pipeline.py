import hashlib
from collections import Counter

import corpus_pipeline as P
import public_tokenizers
import sentencepiece

import __spark_entry__
from meshwork.llm import mixing, quality, rules, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_stage_on_what_the_one_before_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality_classifier", "quality_rules", "simhash_dedup", "source_mixing", "sentencepiece"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        if name == "quality_classifier":
            assert ids(out) == ids(quality.classify(docs, labels).where("kept"))
        elif name == "quality_rules":
            assert ids(out) == ids(rules.ledger(docs).where("failed = 0"))
        elif name == "simhash_dedup":
            assert ids(out) == Counter({r.component_id: 1 for r in simhash.near_duplicates(docs).collect()})
        elif name == "source_mixing":
            assert ids(out) == Counter({r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies})
        if name != "sentencepiece":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            docs = out
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r.doc_id, len(i := sp.encode(r.text)), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in out.collect()) == want
    assert Counter(map(tuple, P.run(spark, sf_dir).collect())) == Counter(map(tuple, out.collect()))


def test_odd_rows_pass_every_stage(spark, sf_dir, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(None, None, None, None, None), (None, text, None, "s", 5), (1, "", "en", "s", 0), (2, text, "en", None, 9), (2, text, "en", None, 9), (3, "long words here " * 20_000, "en", "t", 1)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, DOCS).selectExpr("*", "1 as fp", "'x' as size", "2 as component_id", "map('k', 1) as __score")
        for name, stage in P.STAGES:
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert n >= 0
            if name != "sentencepiece":
                assert out.columns == docs.columns
                docs = out


def test_registered():
    found = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in found) for k in range(1, 11)] == [1] * 10 and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)
