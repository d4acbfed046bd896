import os

import pytest
from pyspark.sql import types as T

from rolecall.llm.storage import Staging

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(autouse=True)
def package_on_workers(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


@pytest.fixture()
def staging(spark):
    return Staging(spark, "test")


@pytest.fixture()
def docs(spark):
    """A documents table from (doc_id, text[, source]) rows."""

    def make(rows, **extra):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name, column in extra.items():
            df = df.withColumn(name, column)
        return df

    return make
