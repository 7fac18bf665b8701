"""From raw documents to token ids: five stages, each over all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.  All but the
last return the columns of documents.

Every stage takes null and empty texts (kept; they are not toxic, have no copies and hold no
benchmark item, and encode to no ids), rows without an id (kept, but for toxic ones, copies
of each other and those with a benchmark item), repeated rows (of which near-duplicate
removal keeps one), ties (the smallest id stays, except that a repeated line stays in the
largest), very long texts, empty tables (an empty result) and further columns of any name,
which all stages but the last pass on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontamination, line_dedup, ngram_join, toxicity
from tessera.llm._common import delete_path, documents, read_table, workspace, write_table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return toxicity.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of many documents stay in one of them; n_chars follows the text."""
    kept = line_dedup.without_repeated_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", toxicity_filter), ("line_dedup", repeated_lines), ("ngram_jaccard", near_duplicates), ("decontamination", benchmark_leaks), ("byte_bpe", token_ids)]

#: The first, fourth and fifth stage cannot be put into SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it have written is deleted as soon as the next one has read it."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with workspace(spark):
            out = stage(spark, docs, sf_dir)
            path = write_table(out, f"pipeline-{name}", kept=True)
        docs = read_table(spark, path, out.schema)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
