import pytest
from corpus_data import EDGES, documents


@pytest.fixture(scope="session")
def edges(spark):
    return documents(spark, EDGES).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def sample(spark):
    """The given documents of the smallest size."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet").cache()
