import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loamfield.session import local_session

    return local_session(cores="4", app="llm-tests", shuffle_partitions=4)


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text) pairs, with columns whose names clash with results."""

    def make(rows, more=True):
        rows = [(i, t, "en", "s", len(t) if t is not None else None, True, 7) for i, t in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words int")
        return df if more else df.select("doc_id", "text", "lang", "source", "n_chars")

    return make
