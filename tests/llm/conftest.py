import pytest
from cases import EDGE_TEXTS


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge cases with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en" if k % 2 else None, "src", 7, "k", k) for k, (i, t) in enumerate(EDGE_TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, k1 string, row int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
