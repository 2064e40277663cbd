from __future__ import annotations

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text[, lang]) with the columns of documents and one that could clash."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "src0") for r in rows]
        df = spark.createDataFrame(full, "doc_id BIGINT, text STRING, lang STRING, source STRING")
        return df.withColumn("n_chars", F.length("text").cast("long")).withColumn("score", F.lit(1)).withColumn(
            "row", F.lit("x"))
    return make
