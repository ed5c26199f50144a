"""The registered queries of the text operators: each applies one, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import format_conversations, read_back
from .common import Scratch, read_table
from .decontaminate import leaks
from .fingerprints import fingerprints
from .language_id import language_id
from .minhash import near_duplicates
from .oracles import ORACLES as ORACLES
from .packing import pack
from .secrets import find_secrets
from .sharding import shard_documents
from .token_files import token_files
from .warc import archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """The word vocabulary file, where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=4)


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read_table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), vocabulary())


def op4_chat_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(extra)
    return read_back(Scratch(spark, "chat").write(format_conversations(rows), "formatted"))


def op5_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read_table(spark, sf_dir, "documents"), vocabulary())


def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents"))


def op8_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))


def op10_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_minhash_dedup, op2_warc_index, op3_best_fit_packing, op4_chat_assembly, op5_minimax_shards, op6_token_files, op7_secret_ownership, op8_benchmark_tiling, op9_language_id, op10_imatch_fingerprints)
}
