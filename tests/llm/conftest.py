import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))



@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents table with extra columns whose names clash with the operators' own."""

    def make(rows):
        schema = "doc_id long, text string, key long, score double, n_shingles int, component_id long, toxic int, start string"
        return spark.createDataFrame([(d, t, 1, None, 3, 5, 1, "x") for d, t in rows], schema)

    return make
