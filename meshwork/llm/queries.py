"""The opN_ queries: each operator applied to its whole table, with the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshwork.llm.text import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwork.llm.chat import digests, format_chats

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(rows.union(extra)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwork.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwork.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwork.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwork.llm import warc

    return warc.read(warc.write(table(spark, sf_dir, "pages")), payloads=False).drop("url")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwork.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwork.llm.flac import read_back, store

    return read_back(store(table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwork.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    from meshwork.llm.pieces import encode

    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return encode(docs, model_path)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_encode(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from meshwork.llm.rules import ledger, verdict

    rows = ledger(table(spark, sf_dir, "documents"))
    base, kept = ~verdict(F.col("failed"), 1), verdict(F.col("failed"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & kept).alias("kept"), "failed")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f) and name != "op2_encode"}


def oracle_sql() -> dict[str, str]:
    from meshwork.llm.oracles import ORACLES

    return dict(ORACLES)
