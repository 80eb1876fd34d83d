import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture()
def docs(spark):
    """``docs(texts)``: a documents table, ids from 0, with columns that clash with results."""

    def make(texts, ids=None, extra=""):
        rows = [(k if ids is None else ids[k], t, None, None, None) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make
