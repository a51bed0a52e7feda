import pytest
from edge_rows import EDGES, SCHEMA

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="session")
def edges(spark):
    """Odd rows, with a column whose name an operator uses."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(EDGES, SCHEMA).withColumns({"n_words": F.lit("clash"), "rank": F.lit(1), "size": F.lit(2), "spans": F.lit("x"), "label": F.lit(0)})


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
