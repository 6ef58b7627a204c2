import pytest
from pyspark import cloudpickle

import citeloom

cloudpickle.register_pickle_by_value(citeloom)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, lang) rows, with extra columns of clashing names."""
    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("row", "part", "key", "id", "component", "size", "shard", "rate", "score", "tokens", "words", "a", "n"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make
