"""A corpus from raw documents: language, near and exact repeats, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next one's documents. Columns of documents beyond ``COLUMNS`` are left out.
Empty documents give an empty corpus; rows with a null id stay unless a stage rejects their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontamination, language, near_dedup, pieces, suffix_dedup
from cairn.workspace import cleaned, cut_to, let_go

#: Predictions below this are no language of the corpus; with two votes out of four languages, chance is 0.25.
LEAST_SCORE = 0.3
#: Documents of whose words more are hit by benchmark passages go whole; of others the passages are cut out.
MOST_COVERAGE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(docs: DataFrame) -> DataFrame:
    """Columns of documents, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts that are of no language of the corpus.

    If no document names a language, there is nothing to reject by, and all texts with a letter stay.
    """
    let_go(spark)
    model = language.train(docs)
    if not model.members:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language.identify(docs, model)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of documents with a similarity of 0.8 or more stays."""
    let_go(spark)
    return near_dedup.deduplicate(docs, num=80).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay where they stand first."""
    let_go(spark)
    return _measured(suffix_dedup.remove_repeats(docs))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go, and documents that are mostly such passages."""
    let_go(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _measured(decontamination.decontaminate(docs, items, max_coverage=MOST_COVERAGE))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    let_go(spark)
    import public_tokenizers

    return pieces.digests(docs, public_tokenizers.path(pieces.MODEL))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("SentencePiece encoding and decoding", encode),
]

#: The first stage is a fitted model, which SQL does not express; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with cleaned(spark) as kept:  # a stage's own tables go once its result is written
            docs, path = cut_to(stage(spark, docs, sf_dir), name.split()[0].lower())
            kept.append(path)
    return docs
