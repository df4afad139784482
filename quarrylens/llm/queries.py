"""The registered queries of the numbered operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import byte_bpe, decontaminate, html_text, merkle, near_dup, oracles, packing, prefix_trie, quality, repeats, secrets, token_counts, token_files, warc
from quarrylens.llm._shared import table


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are installed; operators take the path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.round_trip(table(spark, sf_dir, "pages")))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(table(spark, sf_dir, "documents")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.digest(near_dup.near_duplicates(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    words = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.digest(byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), *words), *words))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    received = merkle.without_newlines(F.col("doc_id"), F.col("text"))
    return merkle.digest(merkle.prove(table(spark, sf_dir, "documents"), received))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_files, op2_secrets, op3_packing, op4_warc, op5_repeats, op6_quality, op7_decontaminate, op8_near_dup, op9_token_counts, op10_html_text, op11_prefix_trie, op12_byte_bpe, op13_merkle, pipeline)}
ORACLES: dict[str, str] = {"op2_secrets": oracles.op2(), "op4_warc": oracles.OP4, "op5_repeats": oracles.OP5, "op8_near_dup": oracles.OP8, "op11_prefix_trie": oracles.OP11, "op13_merkle": oracles.OP13}
