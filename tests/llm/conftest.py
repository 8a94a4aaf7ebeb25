import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents of (doc_id, text) pairs, with the columns of the table and one more."""
    def make(rows):
        return spark.createDataFrame([(i, t, None, "s", None, "x") for i, t in rows], DOCS + ", pos string")
    return make
