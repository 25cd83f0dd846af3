from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs or full rows; a column named like an inner one comes along."""
    from pyspark.sql import functions as F

    def make(rows, source="src0", lang="en"):
        full = [r if len(r) == 5 else (*r, lang, source, len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).withColumn("key", F.lit("x")).withColumn("n_words", F.lit(-1))

    return make
