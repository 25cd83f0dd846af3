"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from colophon.llm import bpe, crosspolytope, interpolation, licenses, lines, mixing, prefixtrie, quality, simhash, tokencounts, toxicity, urllists, whitening
from colophon.llm.shared import fold_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOXIC_FOLDS, HELD_OUT, TOXIC = 4, 2, 0.3


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


@query("op7_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text by the multilingual rank file, decoded again; no SQL twin, checked against a library."""
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer)


@query("op8_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored by a machine trained on the labelled rows outside fold 2 of 4; tested on that fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold_of(F.col("doc_id"), TOXIC_FOLDS) == HELD_OUT
    machine = toxicity.fit(docs.filter(~held_out), labels.filter(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


@query("op1_license_scan", licenses.oracle())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wordings in every whole text: base phrases with their places, and all labels with the best score."""
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op3_quality_rules", quality.oracle())
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures of every whole text and the verdict by cutoffs proven on the labelled documents."""
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from every document; the order is by a hash, so there is no SQL twin."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op2_line_templates", lines.oracle())
def line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without the lines whose template recurs in an earlier document: line counts and a digest."""
    return lines.digests(lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op5_simhash")
def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every whole text; no SQL twin (XXH64), tested against all pairs."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@query("op10_embedding_links")
def embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every embedding; found by hashing, so tested for recall against all pairs."""
    return crosspolytope.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op9_url_lists", urllists.oracle())
def url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries that were active on the day it was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures, log = (spark.sql(text, pages=pages) for text in (urllists.CAPTURES, urllists.LOG))
    return urllists.judge(captures, log).select("page_id", "host", "fetched", "lists", "n_entries", "blocked")


@query("op4_deleted_interpolation")
def deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored by pair and word counts of the texts outside fold 2 of 7; fold 5 is held out for the weights."""
    fold = fold_of(F.col("doc_id"), 7)
    role = F.when(fold == 2, interpolation.SCORE_ONLY).when(fold == 5, interpolation.DELETED).otherwise(interpolation.FIT)
    scored = interpolation.score(table(spark, sf_dir, "documents"), role)
    held_out = (fold == 2).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op13_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text by the byte-level vocabulary; no SQL twin, checked against the library."""
    counter = tokencounts.TokenCounter(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return tokencounts.token_counts(table(spark, sf_dir, "documents"), counter)


@query("op12_whitening")
def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the 32 leading components of all; no SQL twin, checked against a dense solver."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op11_prefix_trie", prefixtrie.oracle())
def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie over all conversations, each opened with the first turns of the first one of its group of five."""
    turns = prefixtrie.numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefixtrie.trie(*prefixtrie.with_openings(turns))
