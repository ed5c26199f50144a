"""A corpus pipeline: each stage works on all that the one before it kept.

Defined results, of all stages: columns of any name and type stay as they are but
for ``text`` and ``n_chars`` in the secrets stage; the last stage returns pieces
instead. Empty tables give empty ones, texts are worked on whole, however long. A
null text has no language and goes with the first stage; where no document has a
label the first stage can't tell languages and keeps all. Rows without doc_id are
near duplicates of nothing; rows that repeat a doc_id and its text stay once, rows of
one doc_id with different texts are judged one by one in the later stages. Ties don't
matter: of near duplicates the smallest doc_id stays, and leaks and secrets depend on
the text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.common import Scratch, read_table
from framewright.llm.decontaminate import without_leaks
from framewright.llm.language_id import known_language
from framewright.llm.minhash import deduplicated
from framewright.llm.packing import pack
from framewright.llm.queries import vocabulary
from framewright.llm.secrets import redact


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those whose best language has a score under 0.5, go; without any labelled document all stay."""
    return known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays, once."""
    return deduplicated(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages that cover half of a benchmark item of five words or more go."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by marks, and n_chars follows."""
    return redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 2048 ids."""
    return pack(docs, vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}_{name}")
    return docs


#: SQL can't express these stages; the tests hold them against brute force.
ORACLE_SQL = None
