import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from corpus import DOCS, make_documents  # noqa: E402


@pytest.fixture(scope="session")
def documents():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, documents):
    return spark.createDataFrame(documents, DOCS).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
