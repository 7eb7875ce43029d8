import pytest

KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a table like `documents` from (doc_id, text) or (doc_id, text, source)."""

    def build(*rows, extra=()):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, KINDS)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("mine"))
        return df

    return build
