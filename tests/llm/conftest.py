import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from spanframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests", **{"spark.sql.shuffle.partitions": "4"})


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """A documents table from (doc_id, text) pairs, with the other columns null but for ``lang``."""

    def build(rows, lang=None, **extra):
        out = spark.createDataFrame([(i, t, lang, None, None) for i, t in rows], SCHEMA)
        for name, value in extra.items():
            from pyspark.sql import functions as F
            out = out.withColumn(name, F.lit(value))
        return out

    return build


#: Rows that every operator has to bear: nulls, empty, blank, very long, repeated.
LONG = "word and another one, " * 200_000
HARD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "Same text here.\nTwice even."), (5, "Same text here.\nTwice even."), (6, "Same text here.\nTwice even."),
        (None, "no id"), (None, None), (7, "éß漢字 \U0001F389 ́ mixed 123")]
