import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("sig", T.StringType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows ``(doc_id, text)`` as documents, with a null and a column whose name operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, "x") for i, t in rows], DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
