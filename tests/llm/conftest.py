import random

import pyarrow.parquet as pq
import pytest

from tests_llm_cases import odd_rows

SF001 = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, kept string, n long, node long, ids string, length long, label string, score string, piece int"


@pytest.fixture(scope="session")
def base_rows():
    """The whole smallest table, then rows with nulls, empty, long, tied and repeated texts."""
    t = pq.read_table(f"{SF001}/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in t]
    return rows + odd_rows(random.Random(5), rows)


@pytest.fixture(scope="session")
def docs(spark, base_rows):
    extra = (7, "x", 1, 2, "y", 3, "z", "w", 4)  # columns whose names clash with results and inner names
    df = spark.createDataFrame([r + extra for r in base_rows], COLUMNS).repartition(5).cache()
    df.count()
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
