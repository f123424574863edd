import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from llm_data import CLASHING, EDGE_TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def edge_docs(spark):
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
        + [T.StructField(name, T.StringType()) for name in ["lang", "source", *CLASHING]]
    )
    rows = [(i, t, None, None if i == 4 else "s1", *[None] * len(CLASHING)) for i, t in EDGE_TEXTS]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(spark, edge_docs):
    return spark.createDataFrame([], edge_docs.schema)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, y int")
