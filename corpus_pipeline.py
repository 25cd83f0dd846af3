"""A training corpus in five stages: toxic documents go, recurring lines go, one of each group of near duplicates stays, sources
are mixed to their weights, and the result is encoded.

Each stage reads all that the stage before kept, as a Parquet table in the shared folder, so a lost executor costs its own
tasks only. No stage drops a row for its id, null or repeated; what a stage decides on is the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from colophon.llm import bpe, lines, mixing, simhash, toxicity
from colophon.llm.queries import HELD_OUT, TOXIC, TOXIC_FOLDS
from colophon.llm.shared import BLANKS, fold_of, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of a document's words in lines of earlier documents from which it is a copy.
COPY_SHARE = 0.8
#: The mix depends on a trained machine and on hashes, so no SQL engine has the rows; tests hold them against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; null and empty texts stay. Labels outside the held-out fold teach."""
    taught = fold_of(F.col("doc_id"), TOXIC_FOLDS) != HELD_OUT
    machine = toxicity.fit(docs.filter(taught), table(spark, sf_dir, "labels").filter(taught))
    return toxicity.score(docs, machine, into="_score").filter(F.col("_score") < TOXIC).select(*COLUMNS)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines whose template stands in an earlier document, which keeps them. A document with at least
    ``COPY_SHARE`` of its words in such lines is a copy: its recurring short lines go too, and so does the document if nothing
    is left. What is left of a copy is its own, so no line of the corpus is lost."""
    cleaned = lines.dedup(docs.select(*COLUMNS), copies=COPY_SHARE)
    left = cleaned.filter((F.col("dropped_lines") == 0) | F.col("text").isNull() | (F.length(F.btrim("text", F.lit(BLANKS))) > 0))
    changed = F.when(F.col("dropped_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return simhash.representatives(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it; at a source's cut, the document of which at least half is taken."""
    mixed = mixing.mix(docs.select(*COLUMNS))
    times = mixing.copies(F.col("size"), F.col("taken"))
    return mixed.filter(times > 0).withColumn("_n", F.explode(F.sequence(F.lit(1), times))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text with their number, their digest and that of the decoded bytes."""
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    summary = tokenizer.digest(tokenizer.encode(F.col("text")), with_ids=True)
    return docs.select("doc_id", "lang", "source", "n_chars", summary.alias("_s")).select("doc_id", "lang", "source", "n_chars", "_s.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("line_dedup", drop_recurring_lines), ("simhash", drop_near_duplicates),
    ("mixing", mix_sources), ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
