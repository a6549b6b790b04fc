"""Tables of a few rows for the operators, and brute-force versions beside them."""

import os

import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("TESTDATA not present")
    return SF_DIR


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text) pairs."""

    def make(*rows):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make
